"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities of ``KINDS`` are reduced to a canonical form, so that one phone number written in two ways is one
entity; a number's country is part of it, and 1 where none is written.  Each canonical form gets a surrogate from a keyed
SHA-256: digits become digits, letters letters of the same case (hexadecimal ones stay hexadecimal), separators, prefixes
and country codes stay, card numbers keep whether their check digit is right, addresses in a shared domain stay in a
shared domain, and network addresses stay private or public.

Names are replaced by parts.  A family name has one surrogate wherever it occurs, a given name one for each gender that
titles give it, in its own script; a title without a gender takes the one that the name has elsewhere.  So every mention
fits its title, and all mentions of a person go together.  In a document that names somebody with a title, the full name
and either part without a title are replaced alike.

Collisions are checked over the whole table: no two entities share a surrogate and no surrogate is a real entity; what
collides is drawn again, and only that.  Forms grow with each draw, so that none runs out: given names become double
names, family names get a syllable, mailboxes two characters, numbers a digit, secrets a letter at their end, and a small
private network becomes the large one.  Cards (10^15 forms) and access keys keep their length.  The same entity has the
same surrogate in every document.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.llm.store import settle, small

#: Patterns by kind, in order of preference.  Quantifiers are bounded or possessive: long texts stay linear.
KINDS = {
    "secret": r"\b(?i:password|passwd|secret|api[_-]?key|token)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.-]{8,}+[\"']?",
    "access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}\b",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "card": r"(?<!\d)(?:\d{16}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ -]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ -]\d{2,4}){2,5}(?!\d)",
    "account": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": r"\b(?:Mrs?|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа|г-н|г-жа)\.? \p{Lu}[\p{L}'’-]{1,30}+(?: \p{Lu}[\p{L}'’-]{1,30}+)?",
}
#: The card pattern's back reference counts groups of the whole alternation; it has the first one.
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every entity has a digit, or one of these; a text without them is not searched.
_SIGN = r"[0-9@=:]|A[KS]IA|(?:M(?:rs?|s|iss|onsieur|adame|me)|Dr|Herr|Frau|Se\u00f1ora?|Sra?|[Гг]-(?:н|жа))[. ]"

#: Given names by gender and script, from which name surrogates are drawn.
NAMES = {
    "female latin": "Ada Bella Carla Dora Edda Flora Greta Hilda Ines Julia Karla Lena Mona Nora Olga Paula Rita Selma Tilda Vera",
    "male latin": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Kurt Leon Max Nils Otto Paul Ralf Simon Tom Viktor",
    "any latin": "Alex Andrea Chris Dominique Eli Jo Jordan Kim Lee Lou Mika Noa Robin Sam Sascha Toni",
    "female cyrillic": "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга",
    "male cyrillic": "Антон Борис Виктор Глеб Денис Иван Лев Максим Никита Олег",
    "any cyrillic": "Саша Женя Валя Слава Шура",
}
_ENDS = {"latin": "ander berg dahl ermann feld gart hoff inger kamp lund mark nau ow rup stein thal ung vik wald zell".split(), "cyrillic": "анов берин вский горов денко ежин зорин иванин ковский линов".split()}
_STARTS = {"latin": "Al Bar Cor Dan El Far Gar Hal Is Jor Kal Lam Mor Nor Ost Per Quin Ros Sol Tor".split(), "cyrillic": "Ал Бор Вар Гор Дан Жер Зар Кал Лав Мор".split()}

_TITLE = r"^(?:Mrs?|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?|Г-н|Г-жа|г-н|г-жа)\.? "
_SECRET_HEAD = r"^(?i:password|passwd|secret|api[_-]?key|token)\s*[=:]\s*[\"']?"
_COUNTRY = r"^\+\d{1,3}(?=[ (-])"


def entities(text: Column) -> Column:
    """The spans of a text that look like entities, in order."""
    return F.when(text.rlike(_SIGN), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(surface: Column) -> Column:
    """The kind of a span; null for numbers of a card's length whose check digit is wrong, which are left alone."""
    kind = reduce(lambda out, kind: F.when(surface.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out), reversed(list(KINDS)), F.lit("name"))
    return F.when((kind == "card") & (_luhn(F.regexp_replace(surface, "[^0-9]", "")) != 0), F.lit(None)).otherwise(kind)


def head_of(kind: Column, surface: Column) -> Column:
    """What stays in front: a secret's label, a name's title, a country code, a key's prefix."""
    pick = lambda p: F.regexp_extract(surface, p, 0)
    return F.when(kind == "secret", pick(_SECRET_HEAD)).when(kind == "name", pick(_TITLE)).when(kind == "phone", pick(_COUNTRY)).when(kind == "access_key", F.substring(surface, 1, 4)).when(kind == "account", F.substring(surface, 1, 2)).otherwise(F.lit(""))


def canonical_of(kind: Column, head: Column, body: Column) -> Column:
    """One form for all spellings of an entity."""
    digits = F.regexp_replace(body, r"[^0-9A-Za-z]", "")
    country = F.when(head == "", "1").otherwise(F.substring(head, F.lit(2), F.length(head)))
    return F.when(kind == "phone", F.concat(country, F.lit(":"), digits)).when(kind.isin("card", "social", "account"), digits).when(kind == "email", F.lower(body)).when(kind == "secret", F.regexp_replace(body, r"[\"']$", "")).otherwise(body)


def _gender(title: Column) -> Column:
    return F.when(title.rlike(r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|г-жа)"), "female").when(title.rlike(r"^(?:Mr|Herr|Monsieur|Señor|Sr|Г-н|г-н)"), "male").otherwise("any")


def _pick(values: list[str], seed: Column, salt: int | Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.xxhash64(seed, salt if isinstance(salt, Column) else F.lit(salt)), F.lit(len(values))).cast("int"))


def _digest(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, draw.cast("string")), 256)


def _like(text: Column, seed: Column) -> Column:
    """Letters and digits by the seed and their place, each in its class; other characters stay."""
    low, high, number = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexadecimal = text.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        at = lambda n: F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int") + 1
        draw = lambda letters, n: F.substring(F.lit(letters), at(n), F.lit(1))
        return F.when(c.rlike("[0-9]"), draw(number, 10)).when(c.rlike("[a-z]"), F.when(hexadecimal, draw(low, 6)).otherwise(draw(low, 26))).when(c.rlike("[A-Z]"), draw(high, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(number: Column) -> Column:
    """Sum of the check-digit rule, modulo 10, of a string of digits."""
    digit = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    worth = lambda x: F.when(x["odd"] == 0, x["d"]).when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])
    return F.pmod(F.aggregate(digit, F.lit(0), lambda s, x: s + worth(x)), F.lit(10))


#: Address blocks that stay what they are, and the first numbers of public ones.
_BLOCKS = {"10": r"^10\.", "192.168": r"^192\.168\.", "172": r"^172\.(?:1[6-9]|2\d|3[01])\.", "127": r"^127\.", "169.254": r"^169\.254\."}
_PUBLIC = [str(n) for n in range(11, 224) if n not in (100, 127, 169, 172, 192, 198)]


def _address(canonical: Column, seed: Column, draw: Column) -> Column:
    number = lambda i, n, low=0: (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(n)) + low).cast("string")
    a, b, c = number(1, 256), number(2, 256), number(3, 254, 1)
    join = lambda *parts: F.concat_ws(".", *(F.lit(x) if isinstance(x, str) else x for x in parts))
    wide = join("10", number(0, 256), a, c)
    small = {"10": wide, "192.168": join("192", "168", a, c), "172": join("172", number(0, 16, 16), a, c), "127": join("127", number(0, 256), a, c), "169.254": join("169", "254", a, c)}
    public = join(_pick(_PUBLIC, seed, 4), a, b, c)
    out = reduce(lambda out, x: F.when(canonical.rlike(x[1]), small[x[0]]).otherwise(out), _BLOCKS.items(), public)
    # A block that is used up gives way to the largest private one.
    return F.when((draw > 3) & canonical.rlike(_BLOCKS["192.168"] + "|" + _BLOCKS["169.254"] + "|" + _BLOCKS["172"]), wide).otherwise(out)


def _surrogate(key: str, kind: Column, canonical: Column, style: Column, draw: Column) -> Column:
    """The surrogate of a canonical form."""
    seed = _digest(key, kind, canonical, draw)
    country, national = F.substring_index(canonical, ":", 1), F.substring_index(canonical, ":", -1)
    like = _like(F.when(kind == "phone", national).otherwise(canonical), seed)
    more = lambda pick: F.when(draw > 1, F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(draw, F.lit(2))), pick), "")).otherwise(F.lit(""))
    longer = lambda letters: more(lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(seed, F.lit("more"), i), F.lit(len(letters))).cast("int") + 1, F.lit(1)))
    digits = F.concat(like, longer("0123456789"))
    # The check digit keeps its distance from the right one.
    stem = F.substring(like, 1, 15)
    check = F.pmod(F.lit(20) - _luhn(F.concat(stem, F.lit("0"))) + _luhn(canonical), F.lit(10)).cast("string")
    domain = F.substring_index(canonical, "@", -1)
    host, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    # Short forms can run out: later draws add characters.
    extra = F.when(draw > 1, F.substring(seed, F.lit(1), 2 * draw)).otherwise(F.lit(""))
    mailbox = F.concat(_like(F.substring_index(canonical, "@", 1), seed), extra, F.lit("@"), _like(host, _digest(key, F.lit("domain"), domain, F.lit(0))), top)
    given = reduce(lambda out, x: F.when(style == x[0], F.array_join(F.transform(F.sequence(F.lit(0), draw), lambda i: _pick(x[1].split(), seed, i)), "-")).otherwise(out), NAMES.items(), F.lit(""))
    family = reduce(lambda out, s: F.when(style.endswith(s), F.concat(_pick(_STARTS[s], seed, 2), _pick(_ENDS[s], seed, 3), F.when(draw > 0, _pick(_ENDS[s], seed, 4)).otherwise(F.lit("")), more(lambda i: F.lower(_pick(_STARTS[s], seed, i + 3))))).otherwise(out), _ENDS, F.lit(""))
    return (
        F.when(kind == "card", F.concat(stem, check)).when(kind == "email", mailbox).when(kind == "address", _address(canonical, seed, draw)).when(kind == "given", given).when(kind == "family", family)
        .when(kind == "phone", F.concat(country, F.lit(":"), digits)).when(kind.isin("social", "account"), digits).when(kind == "secret", F.concat(like, longer("abcdef"))).otherwise(like)
    )


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """kind, canonical, surrogate for the distinct (kind, canonical, style, plain); each surrogate once, none a real entity.

    ``plain`` is the form as it is written; both kinds of name parts share one space.  Of entities that draw one surrogate
    the smallest keeps it, unless an earlier draw has it; the others draw again.
    """
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    left = settle(found.groupBy("kind", "canonical").agg(F.min("style").alias("style"), F.min("plain").alias("plain")).withColumn("space", space), "entities")
    real = left.select("space", F.col("plain").alias("surrogate")).distinct()
    placed = None
    for draw in itertools.count():
        drawn = left.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canonical"), F.col("style"), F.lit(draw)))
        drawn = settle(drawn, "drawn")
        wanted = small(drawn.select("space", "surrogate").distinct())
        taken = real.join(wanted, ["space", "surrogate"], "left_semi")
        if placed is not None:
            taken = taken.unionByName(placed.select("space", "surrogate").join(wanted, ["space", "surrogate"], "left_semi"))
        free = drawn.join(small(settle(taken.distinct(), "taken")), ["space", "surrogate"], "left_anti")
        first = free.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "canonical")).alias("k")).select("space", "surrogate", "k.kind", "k.canonical")
        first = settle(first, "placed")
        placed = first if placed is None else placed.unionByName(first)
        left = settle(left.join(first.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "entities")
        if not left.limit(1).count():
            return placed.select("kind", "canonical", "surrogate")


def _refill(surface: Column, head: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of a surface form: separators, quotes and case stay where they were."""
    body = F.substring(surface, F.length(head) + 1, F.length(surface))
    surrogate = F.when(kind == "phone", F.substring_index(surrogate, ":", -1)).otherwise(surrogate)
    place = lambda i: F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    spelled = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    # A surrogate that had to grow ends in more characters.
    spelled = F.concat(spelled, F.substring(surrogate, F.length(F.regexp_replace(body, "[^0-9A-Za-z]", "")) + 1, F.length(surrogate)))
    quote = F.regexp_extract(body, r"[\"']$", 0)
    cased = F.when(body == F.upper(body), F.upper(surrogate)).otherwise(surrogate)
    return F.concat(head, F.when(kind.isin("card", "social", "phone", "account"), spelled).when(kind == "secret", F.concat(surrogate, quote)).when(kind == "email", cased).otherwise(surrogate))


def _parts_of_names(surfaces: DataFrame) -> DataFrame:
    """surface, head, given, family, gender and script of titled names; a title without a gender takes the one its given name has elsewhere."""
    body = F.expr("substring(surface, length(head) + 1)")
    names = surfaces.where("kind = 'name'").select("surface", "head", F.when(body.contains(" "), F.substring_index(body, " ", 1)).alias("given"), F.substring_index(body, " ", -1).alias("family"), _gender(F.col("head")).alias("gender"))
    names = names.withColumn("script", F.when(F.col("family").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin"))
    known = names.where("gender <> 'any'").groupBy("given").agg(F.min("gender").alias("low"), F.max("gender").alias("high")).where("low = high").select("given", "low")
    return names.join(known, "given", "left").withColumn("gender", F.when(F.col("gender") == "any", F.coalesce("low", F.lit("any"))).otherwise(F.col("gender"))).drop("low")


def _replacements(surfaces: DataFrame, key: str) -> DataFrame:
    """surface, replacement, and for names the parts (written, surrogate)."""
    names = settle(_parts_of_names(surfaces), "names")
    given = F.concat_ws("\x1f", "given", "gender")
    parts = names.where("given is not null").select(F.lit("given").alias("kind"), given.alias("canonical"), F.concat_ws(" ", "gender", "script").alias("style"), F.col("given").alias("plain"))
    parts = parts.unionByName(names.select(F.lit("family").alias("kind"), F.col("family").alias("canonical"), F.col("script").alias("style"), F.col("family").alias("plain")))
    others = surfaces.where("kind <> 'name'")
    table = settle(surrogates(others.select("kind", "canonical", F.lit("").alias("style"), F.col("canonical").alias("plain")).unionByName(parts), key), "surrogates")
    pair = lambda written, surrogate: F.struct(F.col(written).alias("written"), F.col(surrogate).alias("surrogate"))
    plain = others.join(table, ["kind", "canonical"]).select("surface", _refill(F.col("surface"), F.col("head"), F.col("kind"), F.col("surrogate")).alias("replacement"), F.array().cast("array<struct<written: string, surrogate: string>>").alias("parts"))
    of = lambda kind, name: table.where(F.col("kind") == kind).select(F.col("canonical").alias(f"{name}_key"), F.col("surrogate").alias(f"new_{name}"))
    named = names.withColumn("given_key", F.when(F.col("given").isNotNull(), given)).withColumn("family_key", F.col("family")).join(of("given", "given"), "given_key", "left").join(of("family", "family"), "family_key")
    body = F.concat_ws(" ", "new_given", "new_family")
    said = F.when(F.col("given").isNull(), F.array(pair("family", "new_family"))).otherwise(F.array(pair("given", "new_given"), pair("family", "new_family")))
    return plain.unionByName(named.select("surface", F.concat("head", body).alias("replacement"), said.alias("parts")))


def _without_titles(part: Column, names: Column) -> Column:
    """A stretch of text with the known parts of names replaced where they stand alone; surrogates are no real names, so none is replaced twice."""
    whole = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), w, F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.aggregate(names, part, lambda t, n: F.when(F.contains(t, n["written"]), F.regexp_replace(t, whole(n["written"]), n["surrogate"])).otherwise(t))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with every detected entity replaced: id, n_entities, text.

    Null texts stay null with 0 entities; texts without entities stay as they are and are neither shuffled nor stored.
    n_entities counts detected spans, not the names without a title that follow from them.  Rows of one id are replaced
    by their own texts; a null id is handled like any other; other columns are not read.  The key decides the surrogates
    and has to be kept secret.  Texts are searched once where the list of rows with entities is small enough to be
    broadcast, else twice, and never shuffled.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    searched = read.withColumn("found", F.coalesce(entities(F.col("text")), F.array().cast("array<string>")))
    held = settle(searched.where(F.size("found") > 0).withColumn("row", F.xxhash64("text")), "found")
    surfaces = held.select(F.explode(F.array_distinct("found")).alias("surface")).distinct().withColumn("kind", kind_of(F.col("surface"))).where("kind is not null")
    surfaces = surfaces.withColumn("head", head_of(F.col("kind"), F.col("surface")))
    surfaces = settle(surfaces.withColumn("canonical", canonical_of(F.col("kind"), F.col("head"), F.expr("substring(surface, length(head) + 1)"))), "surfaces")
    replaced = settle(_replacements(surfaces, key), "replacements")
    numbered = held.select("id", "row", F.explode(F.array_distinct("found")).alias("surface")).distinct()
    texts = F.octet_length("surface") + F.octet_length("replacement") + 64 * F.size("parts")
    maps = numbered.join(small(replaced, texts), "surface").groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("surface", "replacement"))).alias("by"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("names"))
    met = held.alias("h").join(maps.alias("m"), F.col("h.id").eqNullSafe(F.col("m.id")) & (F.col("h.row") == F.col("m.row")), "left")
    parts = F.split("text", PATTERN, -1)
    plain = lambda p: F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, _without_titles(p, F.col("names"))).otherwise(p)
    new = lambda s: F.coalesce(F.element_at("by", s), s, F.lit(""))
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(plain(p), new(F.get("found", i)))), "")
    known = F.size(F.filter("found", lambda s: F.map_contains_key("by", s)))
    changed = met.select(F.col("h.id").alias("id"), F.coalesce(F.when(F.col("by").isNotNull(), known), F.lit(0)).cast("long").alias("n_entities"), whole.alias("text"))
    keys = held.select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct()
    listed = small(keys)
    if listed is keys:
        rest = searched.where(F.size("found") == 0)
    else:
        rest = read.join(listed, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left_anti")
    return changed.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_entities"), "text")).withColumnRenamed("id", id_col)
