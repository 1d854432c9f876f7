"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON object.  The nested paths of its own fields, all of them, in order, are hashed to its fingerprint, and
the fingerprint selects the declarative mapping of ``MAPPINGS`` that turns the record into canonical turns (role, text).
Fields of ``IGNORED`` say nothing about turns and are left out of the hash.  A record with any other field that its
mapping does not name has a fingerprint that no mapping has: it gets no turns, and ``unmapped`` lists the paths, so
nothing of a record is lost without a trace.

Turns are written with ``TURN_OPEN`` role, line break, text, ``TURN_CLOSE``.  Control strings inside roles and texts are
escaped, so a text can neither open nor close a turn, and reading the output back gives the turns as they were.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Strings of any length, where the parser would stop at 20 million characters.
_LONG = {"maxStringLen": str(2**31 - 1)}


class Mapping(NamedTuple):
    """A layout: turns from single fields in order, followed by those of a list field (``items``: field, role, text).

    ``fields`` has (role, names); the texts of several names are joined by a blank line.  ``roles`` renames roles.
    """

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = {}

    def paths(self) -> list[str]:
        listed = [f"{self.items[0]}[].{x}" for x in self.items[1:]] if self.items else []
        return [name for _, names in self.fields for name in names] + listed


_SAID = {"human": "user", "gpt": "assistant"}
#: Top-level fields about a record, whatever they hold.
IGNORED = ("id", "source", "dataset", "lang", "language", "metadata", "meta", "tags", "created")
#: The layouts that are known.
MAPPINGS = (
    Mapping("messages", items=("messages", "role", "content")),
    Mapping("conversations", items=("conversations", "from", "value"), roles=_SAID),
    Mapping("system_messages", items=("messages", "role", "content"), fields=(("system", ("system",)),)),
    Mapping("system_conversations", items=("conversations", "from", "value"), fields=(("system", ("system",)),), roles=_SAID),
    Mapping("prompt_response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("system_prompt_response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction_input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def _union_schema(mappings: tuple[Mapping, ...]) -> T.StructType:
    """All fields that mappings name: lists of objects with text fields, then single texts."""
    lists: dict[str, list[str]] = {}
    single: list[str] = []
    for m in mappings:
        if m.items:
            lists.setdefault(m.items[0], []).extend(x for x in m.items[1:] if x not in lists.get(m.items[0], []))
        single += [x for _, names in m.fields for x in names if x not in single]
    text = T.StringType()
    listed = [T.StructField(name, T.ArrayType(T.StructType([T.StructField(x, text) for x in inner]))) for name, inner in lists.items()]
    return T.StructType(listed + [T.StructField(x, text) for x in single])


def own_paths(record: Column) -> Column:
    """The nested paths at which a JSON object has a value, sorted: ``a``, ``a.b``, ``a[].b``, ``a[]``; null for other text.

    Fields below the second level show as their parent's path.
    """
    entries = lambda v: F.filter(F.map_entries(v), lambda e: F.schema_of_variant(e["value"]) != "VOID")
    keys = lambda v: F.transform(entries(v), lambda e: e["key"])
    cast = lambda v, kind: v.try_cast(kind)

    def of(e: Column) -> Column:
        kind, name, value = F.schema_of_variant(e["value"]), e["key"], e["value"]
        listed = F.flatten(F.transform(cast(value, "array<map<string, variant>>"), keys))
        plain = F.array(F.when(kind.startswith("ARRAY"), F.concat(name, F.lit("[]"))).otherwise(name))
        return (
            F.when(kind.startswith("ARRAY<OBJECT<"), F.transform(listed, lambda k: F.concat(name, F.lit("[]."), k)))
            .when(kind.startswith("OBJECT<"), F.transform(keys(cast(value, "map<string, variant>")), lambda k: F.concat(name, F.lit("."), k)))
            .otherwise(plain)
        )

    found = entries(cast(F.try_parse_json(record), "map<string, variant>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: ~e["key"].isin(*IGNORED)), of))))


def _long_paths(record: Column, mappings: tuple[Mapping, ...]) -> Column:
    """The paths of a record that is too long for ``own_paths``: all its fields, those of known list fields one by one."""
    top = F.from_json(record, "map<string, string>", _LONG)
    lists = sorted({m.items[0] for m in mappings if m.items})
    inner = F.from_json(record, f"struct<{', '.join(f'`{x}`: array<map<string, string>>' for x in lists)}>", _LONG)
    held = lambda m: F.map_keys(F.map_filter(m, lambda _, v: v.isNotNull()))
    names = F.filter(held(top), lambda k: ~k.isin(*IGNORED, *lists))
    below = [F.when(top[x].isNotNull(), F.coalesce(F.transform(F.flatten(F.transform(inner[x], held)), lambda k: F.concat(F.lit(f"{x}[]."), k)), F.array(F.lit(x)))) for x in lists]
    nothing = F.array().cast("array<string>")
    return F.when(top.isNotNull(), F.array_sort(F.array_distinct(F.concat(names, *(F.coalesce(x, nothing) for x in below)))))


def _struct_paths(schema: T.StructType, record: Column) -> Column:
    """The paths at which a structured record has a value, sorted; fields below the second level show as their parent's path."""

    def held(items: Column, name: str) -> Column:
        return F.exists(items, lambda x: x[name].isNotNull())

    out = []
    for field in schema:
        if field.name in IGNORED:
            continue
        value, kind = record[field.name], field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            out += [F.when(held(value, inner), F.lit(f"{field.name}[].{inner}")) for inner in kind.elementType.names]
        elif isinstance(kind, T.StructType):
            out += [F.when(value[inner].isNotNull(), F.lit(f"{field.name}.{inner}")) for inner in kind.names]
        else:
            out.append(F.when(value.isNotNull(), F.lit(field.name + ("[]" if isinstance(kind, T.ArrayType) else ""))))
    return F.array_sort(F.array_compact(F.array(*out))) if out else F.array().cast("array<string>")


def _known_part(schema: T.StructType, record: Column, mappings: tuple[Mapping, ...]) -> Column:
    """A structured record with just the fields that mappings name, as text; those it lacks are null."""

    def text(holder: Column, kind: T.StructType, name: str) -> Column:
        return (holder[name] if name in kind.names else F.lit(None)).cast("string").alias(name)

    def items(values: Column, kind: T.StructType, names: list[str]) -> Column:
        return F.transform(values, lambda x: F.struct(*(text(x, kind, name) for name in names)))

    out = []
    for wanted in _union_schema(mappings):
        if not isinstance(wanted.dataType, T.ArrayType):
            out.append(text(record, schema, wanted.name))
            continue
        kind = schema[wanted.name].dataType if wanted.name in schema.names else None
        listed = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
        out.append((items(record[wanted.name], kind.elementType, wanted.dataType.elementType.names) if listed else F.lit(None).cast(wanted.dataType)).alias(wanted.name))
    return F.struct(*out)


def _fingerprint_of(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _turns(parsed: Column, mapping: Mapping) -> Column:
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if mapping.items:
        name, role_field, text_field = mapping.items

        def one(x: Column) -> Column:
            role = x[role_field]
            renamed = reduce(lambda out, pair: F.when(role == pair[0], F.lit(pair[1])).otherwise(out), mapping.roles.items(), role)
            return turn(renamed, x[text_field])

        listed = F.transform(parsed[name], one)
    single = F.array(*(turn(F.lit(role), F.concat_ws("\n\n", *(F.when(parsed[x] != "", parsed[x]) for x in names))) for role, names in mapping.fields))
    return F.concat(single, listed) if mapping.items and mapping.fields else listed if mapping.items else single


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds fingerprint (of the record's nested field paths), layout, turns and unmapped to records: JSON text or structs.

    Values that are null count as absent.  A record whose fingerprint no mapping has has a null layout, no turns, and its
    paths in ``unmapped``, which is empty for others; one that is null, broken or no object has ``$`` there.  Texts may
    have any length that a string column holds.  Columns of these names are replaced; all others stay.
    """
    record, kind = F.col(record_col), records.schema[record_col].dataType
    if isinstance(kind, T.StructType):
        parsed, paths = _known_part(kind, record, mappings), F.when(record.isNotNull(), _struct_paths(kind, record))
    else:
        parsed, paths = F.from_json(record, _union_schema(mappings), _LONG), F.coalesce(own_paths(record), _long_paths(record, mappings))
    known = records.withColumn("_parsed", parsed).withColumn("_paths", F.coalesce(paths, F.array(F.lit("$"))))
    known = known.withColumn("fingerprint", _fingerprint_of(F.col("_paths")))
    chosen = [(F.col("fingerprint") == _fingerprint_of(F.array(*(F.lit(p) for p in sorted(m.paths())))), m) for m in mappings]
    layout = reduce(lambda out, x: F.when(x[0], F.lit(x[1].name)).otherwise(out), reversed(chosen), F.lit(None).cast("string"))
    turns = reduce(lambda out, x: F.when(x[0], _turns(F.col("_parsed"), x[1])).otherwise(out), reversed(chosen), F.array().cast("array<struct<role: string, text: string>>"))
    unmapped = F.when(F.col("layout").isNull(), F.col("_paths")).otherwise(F.array().cast("array<string>"))
    return known.withColumn("layout", layout).withColumn("turns", turns).withColumn("unmapped", unmapped).drop("_parsed", "_paths")


def escape(text: Column, one_line: bool = False) -> Column:
    """Doubles backslashes, then breaks the opening of control strings; with ``one_line`` line breaks too."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("<\\n")) if one_line else out


def unescape(text: Column, one_line: bool = False) -> Column:
    out = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    out = F.replace(out, F.lit("<\\n"), F.lit("\n")) if one_line else out
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def format_turns(records: DataFrame, turns_col: str = "turns", learned: str = LEARNED) -> DataFrame:
    """Adds formatted (text) and loss_mask, the (start, length) in characters of each learned turn's escaped text.

    No turns give an empty text and an empty mask.
    """
    parts = F.transform(turns_col, lambda t: F.struct(F.concat(F.lit(TURN_OPEN), escape(t["role"], True), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned).alias("learned")))
    whole = records.withColumn("_parts", parts).withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_CLOSE))), ""))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct((start + F.length(p["body"]) + len(TURN_CLOSE)).alias("at"), F.when(p["learned"], F.concat(s["mask"], F.array(span))).otherwise(s["mask"]).alias("mask"))

    return whole.withColumn("loss_mask", F.aggregate("_parts", state, step)["mask"]).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"\Q" + TURN_CLOSE + r"\E"), lambda p: p != "")

    def one(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(TURN_OPEN) + 1), F.length(part))
        cut = F.instr(inner, "\n")
        return F.struct(unescape(F.substring(inner, F.lit(1), cut - 1), True).alias("role"), unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"))

    return F.transform(parts, one)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under a loss mask, unescaped and end to end."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def turn_records(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as structured records: id and a record in the messages layout; null roles and texts become empty.

    Turns follow ``order_col`` (nulls first), equal ones role and text; repeated rows are repeated turns.  No JSON is
    written or read, so a text may be as long as a string column holds.
    """
    turn = F.struct(F.col(order_col).alias("order"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return ordered.select(id_col, F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")).alias("record"))


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``turn_records`` as JSON text."""
    return turn_records(rows, id_col, order_col, role_col, text_col).select(id_col, F.to_json("record").alias("record"))
