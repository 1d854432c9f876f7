"""Cross-row evidence: repeated ideas inside a file, n-gram leakage between tables, repeated blocks, comment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.sources.shared import settle, small

#: Words that carry no idea.
STOP = "about above after again also always another because been before being below between both come came could does doing done down each even every from have having here into just like made make many more most much must never only other over same should since some such than that their them then there these they this those through very want were what when where which while will with would your yours you're we're it's that's there's isn't don't can't won't".split()
#: Fixed value: a word of a sentence.
WORD = r"[\p{L}\p{N}$][\p{L}\p{N}$'’.-]*[\p{L}\p{N}]|[\p{L}\p{N}]"


def content_words(sentence: Column) -> Column:
    """Distinct words with a digit, or of four letters and no stop word, lightly stemmed."""
    raw = F.transform(F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0)), lambda w: F.replace(w, F.lit("’"), F.lit("'")))
    digit = lambda w: w.rlike("[0-9]")
    kept = F.filter(raw, lambda w: digit(w) | ((F.length(w) >= 4) & ~w.isin(*STOP)))
    return F.array_distinct(F.transform(kept, lambda w: F.when(digit(w) | (F.length(w) <= 4), w).otherwise(F.regexp_replace(w, r"(?:'s|s)\z", ""))))


def earlier_sentences(units: DataFrame, shared: int = 3, most: int = 8) -> DataFrame:
    """For each unit the earlier sentences of its file that say the same: file, unit, earlier (text in order).

    ``units`` has file, unit (position in the file) and text.  A sentence matches with ``shared`` common words, or two
    that are half of its own; words in more than a third of six units or more are the subject and do not count.  The
    inverted index is keyed by file and word, so pairs arise only inside a file.
    """
    said = units.select("file", "unit", F.posexplode(text.sentences(F.col("text"))).alias("at", "sentence")).withColumn("words", content_words(F.col("sentence")))
    words = said.select("file", "unit", "at", F.explode("words").alias("word"))
    spread = words.groupBy("file", "word").agg(F.count_distinct("unit").alias("units"))
    total = units.groupBy("file").agg(F.count_distinct("unit").alias("total"))
    subject = spread.join(total, "file").where("total >= 6 and units * 3 > total").select("file", "word")
    words = words.join(subject, ["file", "word"], "left_anti")
    sizes = words.groupBy("file", "unit", "at").agg(F.count("*").alias("size"))
    now, then = words.alias("n"), words.alias("t")
    before = (F.col("t.unit") < F.col("n.unit")) | ((F.col("t.unit") == F.col("n.unit")) & (F.col("t.at") < F.col("n.at")))
    pairs = now.join(then, (F.col("n.file") == F.col("t.file")) & (F.col("n.word") == F.col("t.word")) & before)
    counted = pairs.groupBy(F.col("n.file").alias("file"), F.col("n.unit").alias("unit"), F.col("n.at").alias("at"), F.col("t.unit").alias("e_unit"), F.col("t.at").alias("e_at")).agg(F.count("*").alias("common"))
    matched = counted.join(sizes, ["file", "unit", "at"]).where((F.col("common") >= shared) | ((F.col("common") >= 2) & (F.col("common") * 2 >= F.col("size"))))
    best = matched.groupBy("file", "unit", "e_unit", "e_at").agg(F.max("common").alias("common"))
    ranked = best.withColumn("n", F.row_number().over(Window.partitionBy("file", "unit").orderBy(F.desc("common"), "e_unit", "e_at"))).where(F.col("n") <= most)
    texts = said.select("file", F.col("unit").alias("e_unit"), F.col("at").alias("e_at"), "sentence")
    listed = ranked.join(texts, ["file", "e_unit", "e_at"]).groupBy("file", "unit").agg(F.array_sort(F.collect_list(F.struct("e_unit", "e_at", "sentence"))).alias("rows"))
    return listed.select("file", "unit", F.array_join(F.transform("rows", lambda r: r["sentence"]), "\n").alias("earlier"))


def _words(column: Column) -> Column:
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_ngrams(column: Column, n: int = 6) -> Column:
    """Distinct n-grams of lower-cased words of letters and digits."""

    def grams(words: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    # The words are bound once; a column that a lambda names is computed again for each element.
    return F.transform(F.array(_words(column)), grams)[0]


def _gram_hashes(column: Column, n: int) -> Column:
    def hashes(words: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))
        return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(_words(column)), hashes)[0]


def ngram_overlap(items: DataFrame, questions: DataFrame, n: int = 6) -> DataFrame:
    """(id, gram) for every n-gram of an item that also occurs in a question; both have id and text.

    N-grams meet as hashes; only those of items that meet a question are written out, and then compared as strings.
    Rows of one id count together.  The questions' hashes are broadcast behind a check of their size.
    """
    asked = questions.select(F.explode(F.array_distinct(_gram_hashes(F.col("text"), n))).alias("hash")).distinct()
    read = items.select("id", F.posexplode(_gram_hashes(F.col("text"), n)).alias("at", "hash")).join(small(asked), "hash", "left_semi")
    places = settle(read.groupBy("id").agg(F.collect_set("at").alias("places")), "places")
    met = items.join(small(places, 4 * F.size("places")), "id").select("id", F.transform(F.array(_words(F.col("text"))), lambda w: F.transform("places", lambda i: F.array_join(F.slice(w, i + 1, n), " ")))[0].alias("grams"))
    wanted = questions.select(F.explode(word_ngrams(F.col("text"), n)).alias("gram")).distinct()
    return met.select("id", F.explode(F.array_distinct("grams")).alias("gram")).join(small(wanted), "gram", "left_semi").select("id", "gram").distinct()


#: Lines that never make a block, comment lines that are directives, and lines that read as code.
TRIVIAL = r"^(?:[)\]}>;,]+|</[\w.]+>|/?>|\)\s*;?|import\b.*|export\s*\{.*\}\s*;?)$"
DIRECTIVE = r"(?i)^\s*//\s*(?:eslint|oxlint|biome|prettier|@ts-|istanbul|c8|v8|webpack|#|region|endregion|TODO|FIXME|NOTE|HACK|XXX)"
CODE_LINE = r"(?:[;{}(]\s*$|^(?:const|let|var|import|export|return|if|else|for|while|await|function|class|throw|try|catch)\b|^[\w$.\[\]]+\s*\(.*\)\s*;?$|^[\w$.\[\]]+\s*[+\-*/]?=\s*\S|=>\s*[{(]?$|^</?[A-Za-z][\w.]*(?:\s[^>]*)?/?>$)"


def repeated_blocks(lines: DataFrame, window: int = 8, least: int = 240) -> DataFrame:
    """First later copy of a block of ``window`` significant lines in each file: file, first_line, line.

    ``lines`` has file, line and text.  Blank, comment and trivial lines do not count; copies that overlap are one run.
    """
    text_ = F.trim("text")
    real = lines.withColumn("text", text_).where((F.col("text") != "") & ~F.col("text").rlike(r"^(?://|/\*|\*)") & ~F.col("text").rlike(TRIVIAL))
    order = Window.partitionBy("file").orderBy("line")
    blocks = real.withColumn("at", F.row_number().over(order)).withColumn("block", F.collect_list("text").over(order.rowsBetween(0, window - 1))).where(F.size("block") == window)
    keyed = blocks.withColumn("whole", F.array_join("block", "\n")).where(F.length("whole") >= least).select("file", "line", "at", F.sha2("whole", 256).alias("key"))
    firsts = Window.partitionBy("file", "key")
    copies = keyed.withColumn("first_at", F.min("at").over(firsts)).withColumn("first_line", F.min("line").over(firsts)).where(F.col("at") - F.col("first_at") >= window)
    return copies.groupBy("file").agg(F.min_by("first_line", "line").alias("first_line"), F.min("line").alias("line"))


def comment_runs(lines: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """Runs of comment lines that mostly read as code: file, start_line, n_lines, n_code."""
    comment = F.col("text").rlike(r"^\s*//(?!/)") & ~F.col("text").rlike(DIRECTIVE)
    body = F.trim(F.regexp_extract("text", r"^\s*//(?!/)(.*)$", 1))
    marked = lines.withColumn("comment", comment).withColumn("code", body.rlike(text.portable(CODE_LINE))).where("comment")
    order = Window.partitionBy("file").orderBy("line")
    runs = marked.withColumn("run", F.col("line") - F.row_number().over(order)).groupBy("file", "run").agg(F.min("line").alias("start_line"), F.count("*").alias("n_lines"), F.count_if("code").alias("n_code"))
    return runs.where((F.col("n_lines") >= least) & (F.col("n_code") >= least) & (F.col("n_code") / F.col("n_lines") >= share)).drop("run")
