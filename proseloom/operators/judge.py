"""Judge planning: states, cache keys, shared requests, cached answers, and the judge itself as a partition function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.sources.shared import settle

#: Tokens of a state and of one request, dollars for a million input tokens.
STATE_TOKENS, REQUEST_TOKENS, PRICE = 1500, 60_000, 0.042


def state_of(*labelled: tuple[str, Column]) -> Column:
    """Labelled lines in order, absent ones left out, clipped to the budget of a state."""
    whole = F.concat_ws("\n", *(F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c)) for label, c in labelled))
    return F.substring(whole, 1, int(STATE_TOKENS * 3.5))


def answer_key(question: Column, model: Column, state: Column) -> Column:
    return F.sha2(F.concat_ws("\n", question, model, state), 256)


def shared_requests(jobs: DataFrame) -> DataFrame:
    """One request for all (unit_id, rule_id, key) jobs with one key: consumers, answers shared, state and its tokens."""
    grouped = jobs.groupBy("key").agg(F.first("state").alias("state"), F.count("*").alias("consumers"))
    return grouped.withColumn("shared", F.col("consumers") - 1).withColumn("tokens", text.token_estimate(F.col("state")))


def with_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds probability from the cache; entries outside 0 to 1 are misses, and of equal keys the last one written counts."""
    usable = cache.where("probability between 0 and 1 and not isnan(probability)").groupBy("key").agg(F.max_by("probability", "written").alias("probability"))
    return requests.join(usable, "key", "left")


def cost(requests: DataFrame) -> DataFrame:
    """Requests, tokens and dollars of those without a cached answer."""
    return requests.where("probability is null").agg(F.count("*").alias("requests"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("dollars", F.col("tokens") / 1e6 * PRICE)


def chunk_numbers(tokens: Column, limit: int = REQUEST_TOKENS) -> Column:
    """The chunk of each question in an ordered array of token counts: greedy sums that start anew above the limit."""
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        over = (s["sum"] > 0) & (s["sum"] + t > limit)
        chunk = s["chunk"] + F.when(over, 1).otherwise(0)
        return F.struct(F.when(over, t).otherwise(s["sum"] + t).cast("long").alias("sum"), chunk.alias("chunk"), F.array_append(s["out"], chunk).alias("out"))

    return F.aggregate(tokens, state, step)["out"]


class Ends:
    """With what sum and how many chunks questions end, for every sum from 0 to ``limit`` + 1 that they may begin with.

    Beginnings that come to the same sum go on as one, so that a question soon costs a few steps and not ``limit`` of them.
    """

    def __init__(self, limit: int):
        self.limit, self.of, self.sums = limit, np.arange(limit + 2), np.arange(limit + 2)
        self.before, self.added, self.n = np.zeros(limit + 2, np.int64), np.zeros(limit + 2, np.int64), 0

    def add(self, t: int) -> None:
        over = (self.sums > 0) & (self.sums + t > self.limit)
        self.sums, self.added, self.n = np.where(over, t, self.sums + t), self.added + over, self.n + 1
        if self.n % 64 == 0 and len(self.sums) > 1:
            met, place = np.unique(self.sums, return_inverse=True)
            if len(met) < len(self.sums):
                self.before += self.added[self.of]
                self.of, self.sums, self.added = place[self.of], met, np.zeros(len(met), np.int64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums[self.of], self.before + self.added[self.of]


def chunk_rows(questions: DataFrame, group: str, order: str, tokens: str, limit: int = REQUEST_TOKENS) -> DataFrame:
    """group, order, chunk: ``chunk_numbers`` of each group's questions, one row each, for groups of any size.

    Rows are cut into blocks by ranges of group and order.  A block's summary says for every sum it may begin with what
    sum and how many chunks it ends with; from the summaries, one a block, follows where each block begins.
    """
    spark = questions.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = questions.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("t"))
    blocks = settle(rows.repartitionByRange(n, "g", "o", "t").withColumn("block", F.spark_partition_id()), "blocks")
    ordered = blocks.repartition(n, "block").sortWithinPartitions("block", "g", "o", "t")

    def summarise(batches):
        block = first = last = single = held = total = chunk = None

        def row():
            ends = held.table()
            return pa.RecordBatch.from_pylist([{"block": block, "first": first, "last": last, "single": single, "sums": ends[0].astype("<i8").tobytes(), "added": ends[1].astype("<i8").tobytes(), "sum": total, "chunk": chunk}], schema=pa.schema([("block", pa.int32()), ("first", kind), ("last", kind), ("single", pa.bool_()), ("sums", pa.binary()), ("added", pa.binary()), ("sum", pa.int64()), ("chunk", pa.int64())]))

        for batch in batches:
            kind = batch.schema.field(1).type
            for b, g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if b != block:
                    if block is not None:
                        yield row()
                    block, first, last, single, total, chunk = b, g, g, True, 0, 0
                    held = Ends(limit)
                if g != last:
                    last, single, total, chunk = g, False, 0, 0
                if single:
                    held.add(t)
                else:
                    over = total > 0 and total + t > limit
                    total, chunk = (t, chunk + 1) if over else (total + t, chunk)
        if block is not None:
            yield row()

    name = questions.schema[group].dataType.simpleString()
    found = ordered.select("block", "g", "o", "t").mapInArrow(summarise, f"block int, first {name}, last {name}, single boolean, sums binary, added binary, sum long, chunk long")
    begins, state = {}, (None, 0, 0)
    for r in sorted(found.toLocalIterator(), key=lambda r: r.block):
        begins[r.block] = total, chunk = state[1:] if state[0] == r.first else (0, 0)
        at = min(total, limit + 1)
        ends = (int(np.frombuffer(r.sums, "<i8")[at]), chunk + int(np.frombuffer(r.added, "<i8")[at])) if r.single else (r.sum, r.chunk)
        state = r.last, *ends

    def number(batches):
        block = last = None
        total = chunk = 0
        for batch in batches:
            out = []
            for b, g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if b != block:
                    block, last, (total, chunk) = b, g, begins[b]
                elif g != last:
                    last, total, chunk = g, 0, 0
                over = total > 0 and total + t > limit
                total, chunk = (t, chunk + 1) if over else (total + t, chunk)
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int32())], names=[group, order, "chunk"])

    return ordered.select("block", "g", "o", "t").mapInArrow(number, f"`{group}` {name}, `{order}` {questions.schema[order].dataType.simpleString()}, chunk int")


def answers(requests: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, probability) of all requests: cached ones as they are, the others asked once each.

    ``judge`` turns (key, state) rows into (key, probability) rows, with mapInPandas where it asks a service.
    """
    asked = judge(requests.where("probability is null").select("key", "state")).select("key", F.col("probability").cast("double").alias("probability"))
    return requests.where("probability is not null").select("key", "probability").unionByName(asked)


def answered_jobs(jobs: DataFrame, answered: DataFrame) -> DataFrame:
    """Answers back to all jobs (unit_id, rule_id, key) that share a key: adds probability, null where there is none or it is out of range."""
    usable = answered.where("probability between 0 and 1 and not isnan(probability)")
    return jobs.join(usable, "key", "left")


def unknown_of(jobs: DataFrame, reason: str = "request-failed") -> DataFrame:
    """(rule_id, unit_id, reason) of jobs without an answer."""
    return jobs.where("probability is null").select("rule_id", "unit_id", F.lit(reason).alias("reason"))
