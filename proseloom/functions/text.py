"""String columns: normalising, counting, masking, hashing and the deterministic fixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word borders that see ASCII word characters only, as the rule patterns expect; Java's own are Unicode-aware.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


#: Fixed value: the characters of the Unicode property Extended_Pictographic, which Java 17 does not name.
PICTOGRAPHIC = (
    r"\u00a9\u00ae\u203c\u2049\u2122\u2139\u2194-\u2199\u21a9\u21aa\u231a\u231b\u2328\u2388\u23cf\u23e9-\u23f3\u23f8-\u23fa\u24c2\u25aa\u25ab\u25b6\u25c0\u25fb-\u25fe"
    r"\u2600-\u2605\u2607-\u2612\u2614-\u2685\u2690-\u2705\u2708-\u2712\u2714\u2716\u271d\u2721\u2728\u2733\u2734\u2744\u2747\u274c\u274e\u2753-\u2755\u2757\u2763-\u2767\u2795-\u2797\u27a1\u27b0\u27bf"
    r"\u2934\u2935\u2b05-\u2b07\u2b1b\u2b1c\u2b50\u2b55\u3030\u303d\u3297\u3299\x{1f000}-\x{1f0ff}\x{1f10d}-\x{1f10f}\x{1f12f}\x{1f16c}-\x{1f171}\x{1f17e}\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}"
    r"\x{1f1ad}-\x{1f1e5}\x{1f201}-\x{1f20f}\x{1f21a}\x{1f22f}\x{1f232}-\x{1f23a}\x{1f23c}-\x{1f23f}\x{1f249}-\x{1f3fa}\x{1f400}-\x{1f53d}\x{1f546}-\x{1f64f}\x{1f680}-\x{1f6ff}\x{1f774}-\x{1f77f}"
    r"\x{1f7d5}-\x{1f7ff}\x{1f80c}-\x{1f80f}\x{1f848}-\x{1f84f}\x{1f85a}-\x{1f85f}\x{1f888}-\x{1f88f}\x{1f8ae}-\x{1f8ff}\x{1f90c}-\x{1f93a}\x{1f93c}-\x{1f945}\x{1f947}-\x{1faff}\x{1fc00}-\x{1fffd}"
)


def _class_end(body: str, i: int) -> int:
    """Where the character class that begins at i ends."""
    i += 1
    while body[i] != "]":
        i += 2 if body[i] == "\\" else 1
    return i


def _alternatives(body: str) -> list[str]:
    """A pattern cut at its outermost bars."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(body, i)
        elif c == "|" and not depth:
            out.append(body[at:i])
            at = i + 1
        else:
            depth += (c == "(") - (c == ")")
        i += 1
    return [*out, body[at:]]


def _close(body: str) -> int:
    """Where the group that opens a pattern closes."""
    depth, i = 0, 0
    while True:
        if body[i] == "\\":
            i += 1
        elif body[i] == "[":
            i = _class_end(body, i)
        else:
            depth += (body[i] == "(") - (body[i] == ")")
            if not depth:
                return i
        i += 1


def _first_letters(pattern: str) -> set[str] | None:
    """The letters a match can begin with, or None where it may begin with something else."""
    if pattern.startswith("(?:"):
        end = _close(pattern)
        found = [_first_letters(x) for x in _alternatives(pattern[3:end])]
        if pattern[end + 1 : end + 2] in ("?", "*"):
            found.append(_first_letters(pattern[end + 2 :]))
        return None if None in found else set().union(*found)
    if pattern[:1].isascii() and pattern[:1].isalpha():
        rest = _first_letters(pattern[2:]) if pattern[1:2] in ("?", "*") else set()
        return None if rest is None else {pattern[0].lower(), *rest}
    return None


def portable(pattern: str, flags: str = "u") -> str:
    """A rule pattern as a Java pattern: ASCII borders, named sets written out, and inline flags.

    A border before letters looks at the next and the last character only, which passes most places at once.
    """
    pattern = _without_recursion(_java_classes(pattern))
    parts = pattern.split(r"\b")
    java = parts[0]
    for i, part in enumerate(parts[1:], 1):
        letters = _first_letters(_alternatives(r"\b".join(parts[i:]))[0].split(r"\b")[0]) if part and _balanced(part) else None
        if letters:
            both = "".join(sorted(letters | {c.upper() for c in letters}))
            java += rf"(?=[{both}])(?<!\w){part}"
        else:
            java += BORDER + part
    java = java.replace(r"\p{Extended_Pictographic}", f"[{PICTOGRAPHIC}]")
    inline = "".join(f for f in "ims" if f in flags)
    return f"(?{inline}u){java}" if "i" in flags else f"(?{inline}){java}" if inline else java


def _balanced(part: str) -> bool:
    """Whether a piece of a pattern closes no group but its own."""
    depth, i = 0, 0
    while i < len(part) and depth >= 0:
        if part[i] == "\\":
            i += 1
        elif part[i] == "[":
            i = _class_end(part, i)
        else:
            depth += (part[i] == "(") - (part[i] == ")")
        i += 1
    return not depth


def _java_classes(pattern: str) -> str:
    """Code points and character classes as Java writes them."""
    pattern = re.sub(r"\\u\{([0-9A-Fa-f]+)\}", r"\\x{\1}", pattern)
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
        elif pattern[i] == "[":
            end = _class_end(pattern, i)
            inner = pattern[i + 1 : end]
            # A bracket or two ampersands inside a class are letters to a rule, operators to Java.
            out.append("[" + re.sub(r"(?<!\\)((?:\\\\)*)(\[|&(?=&))", r"\1\\\2", inner) + "]")
            i = end + 1
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _without_recursion(pattern: str) -> str:
    """A pattern that ends in a repeated group of words, each after the same sign, with the group gone through in a loop.

    Java calls itself for each round of such a group, and some thousand words in a row, as junk has them, overflow its stack,
    which ends an executor.  A possessive group is a loop, and matches the same here: a word is letters and digits and must
    be followed by the sign or by what ends the pattern, so only whole words pass, and the end never begins with the sign.
    """
    for begin in re.finditer(r"\(\?:([ ,;:/&-])", pattern):
        end = begin.start() + _close(pattern[begin.start() :])
        words, sign = pattern[begin.end() : end], begin[1]
        after = re.fullmatch(r"(\*|\+|\{\d+,\})((?:\[[^\]\[\\^&\w-]+\]\??)*\$)", pattern[end + 1 :])
        simple = re.sub(r"\[(?:[A-Za-z0-9](?:-[A-Za-z0-9])?)+\]|\(\?:", "(", words)
        if after and sign not in after[2] and len(_alternatives(words)) == 1 and re.fullmatch(r"[A-Za-z0-9()|+*?]+", simple):
            return f"{pattern[:end]}(?={sign}|{after[2]})){after[1]}+{after[2]}"
    return pattern


def phrase_pattern(phrases: list[str]) -> str:
    """Any of the phrases, whatever their case, not inside longer words."""
    quoted = "|".join(r"\Q" + p + r"\E" for p in phrases)
    # Places where no phrase begins are passed by a look at one character.
    begins = "".join(sorted({p[0].lower() for p in phrases}))
    ahead = f"(?=[{begins}])" if begins.isalnum() else ""
    return rf"(?iu){ahead}(?<![\p{{L}}\p{{N}}])(?:{quoted})(?![\p{{L}}\p{{N}}])"


def normalise(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def count_words(text: Column) -> Column:
    """Runs without ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+"))


def prose_words(text: Column) -> Column:
    """Letters and digits with inner apostrophes and hyphens."""
    # Possessive, so that a long chain of hyphens is a loop: nothing follows that a shorter match could serve.
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*+"))


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def token_estimate(text: Column, dense: Column | bool = False) -> Column:
    """Characters over 3.5, or over 3 for dense units, rounded up."""
    dense = dense if isinstance(dense, Column) else F.lit(dense)
    return F.ceil(F.length(text) / F.when(dense, 3.0).otherwise(3.5)).cast("long")


def strip_variants(name: Column) -> Column:
    """A class name without its variants: everything up to the last colon outside brackets."""
    return F.regexp_replace(name, r"^(?:(?:[^\[\]:]++|\[[^\]]*\])*+:)*+", "")


def mask_spans(text: Column, spans: Column) -> Column:
    """Spaces over the (start, end) spans; the length stays."""
    return F.aggregate(spans, text, lambda t, x: F.overlay(t, F.repeat(F.lit(" "), x["end"] - x["start"]), x["start"] + 1, x["end"] - x["start"]))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


# Fixes: each rewrites exactly what its rule flags; their patterns are fixed values.
def fix_ellipsis(text: Column) -> Column:
    return F.replace(text, F.lit("..."), F.lit("…"))


def fix_quotes(text: Column) -> Column:
    # The mark comes first in a pattern, so that other letters are passed by one look at each.
    text = F.regexp_replace(text, r"\"(?<=(?:^|[\s(\[{—–-])\")", "“")
    text = F.regexp_replace(F.replace(text, F.lit('"'), F.lit("”")), r"'(?<=(?:^|[\s(\[{])')(?=[^\s\d])", "‘")
    return F.replace(text, F.lit("'"), F.lit("’"))


def fix_multiplication(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![\w.])([1-9]\d*)\s?x\s?(\d+)(?![\w.%])", "$1×$2")


#: Fixed value: units that a no-break space ties to their number.
UNITS = "px|pt|em|rem|ms|min|KB|MB|GB|TB|kg|km|cm|mm|fps|%"


def fix_unit_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\d) (?=(?:{UNITS})(?![\p{{L}}\d]))", "$1 ")


def fix_referral(text: Column) -> Column:
    text = F.regexp_replace(text, r"\?utm_source=chatgpt\.com(?![\w&=-])", "")
    return F.replace(F.regexp_replace(text, r"([?&])utm_source=chatgpt\.com&", "$1"), F.lit("&utm_source=chatgpt.com"), F.lit(""))


#: Fixed value: words and how they are spelt in Australia.
AU_SPELLING = {
    "analyze": "analyse", "analyzed": "analysed", "apologize": "apologise", "behavior": "behaviour", "behaviors": "behaviours", "canceled": "cancelled", "canceling": "cancelling", "catalog": "catalogue", "color": "colour",
    "colored": "coloured", "colors": "colours", "customize": "customise", "customized": "customised", "favorite": "favourite", "favorites": "favourites", "gray": "grey", "honor": "honour", "labeled": "labelled", "labeling": "labelling",
    "modeling": "modelling", "neighbor": "neighbour", "optimize": "optimise", "optimized": "optimised", "organization": "organisation", "organizations": "organisations", "organize": "organise", "organized": "organised",
    "prioritize": "prioritise", "realize": "realise", "realized": "realised", "recognize": "recognise", "traveling": "travelling",
}


def fix_spelling(text: Column) -> Column:
    """Whole words in lower case or with a capital; what holds a slash is an address and stays."""
    both = {**AU_SPELLING, **{k.capitalize(): v.capitalize() for k, v in AU_SPELLING.items()}}
    known = F.create_map(*(F.lit(x) for pair in both.items() for x in pair))
    spelt = lambda token: F.array_join(F.transform(F.regexp_extract_all(token, F.lit(r"(\w+|\W+)"), F.lit(1)), lambda w: F.coalesce(known[w], w)), "")
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), F.lit(1)), lambda t: F.when(t.contains("/"), t).otherwise(spelt(t))), "")


FIXES = {"ellipsis": fix_ellipsis, "smartQuotes": fix_quotes, "multiplicationSign": fix_multiplication, "nbspValueUnit": fix_unit_space, "auSpelling": fix_spelling, "stripUtm": fix_referral}
