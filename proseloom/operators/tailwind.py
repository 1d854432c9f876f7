"""Utility classes to values: typography in order of precedence, literal values, and sizes near a declared scale."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseloom.functions.columns import let
from proseloom.functions.text import strip_variants

# The default scales, names of colours, and alignments that are no sizes.
ROOT_PX = 16
FONT_SIZES = {"xs": (12, 16), "sm": (14, 20), "base": (16, 24), "lg": (18, 28), "xl": (20, 28), "2xl": (24, 32), "3xl": (30, 36), "4xl": (36, 40), "5xl": (48, 48), "6xl": (60, 60), "7xl": (72, 72), "8xl": (96, 96), "9xl": (128, 128)}
LEADING = {"none": 1.0, "tight": 1.25, "snug": 1.375, "normal": 1.5, "relaxed": 1.625, "loose": 2.0}
TRACKING = {"tighter": -0.05, "tight": -0.025, "normal": 0.0, "wide": 0.025, "wider": 0.05, "widest": 0.1}
WEIGHTS = {"thin": 100.0, "extralight": 200.0, "light": 300.0, "normal": 400.0, "medium": 500.0, "semibold": 600.0, "bold": 700.0, "extrabold": 800.0, "black": 900.0}
FAMILIES = ("mono", "sans", "serif")
HUES = ("slate", "gray", "zinc", "neutral", "stone", "red", "orange", "amber", "yellow", "lime", "green", "emerald", "teal", "cyan", "sky", "blue", "indigo", "violet", "purple", "fuchsia", "pink", "rose")
COLOURS = (
    "inherit", "current", "transparent", "black", "white", *HUES, "foreground", "background", "muted", "muted-foreground", "primary", "primary-foreground", "secondary", "secondary-foreground", "accent", "accent-foreground",
    "destructive", "card-foreground", "popover-foreground",
)
ALIGNMENTS = ("left", "center", "right", "justify", "start", "end", "wrap", "nowrap", "balance", "pretty", "ellipsis", "clip")
_ARBITRARY_COLOUR = r"^(?:\[(?:#|rgb|hsl|oklch|oklab|color:)|\(color:)"
_SCALED = r"^(text|p[xytrblse]?|m[xytrblse]?|gap(?:-[xy])?|space-[xy]|rounded(?:-[a-z]+)?|leading|w|h|size|inset|top|bottom|left|right)-\[(-?(?:\d+(?:\.\d+)?|\.\d+))px\]$"


def _of(table: Mapping[str, float], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, float(v))))[key] if table else F.lit(None).cast("double")


def _inside(token: Column) -> Column:
    """What stands in brackets, null without them."""
    return F.when(token.startswith("[") & token.endswith("]"), F.substring(token, F.lit(2), F.length(token) - 2))


def _number(raw: Column, units: str) -> Column:
    return F.when(raw.rlike(rf"^-?\d*\.?\d+(?:{units})?$"), F.regexp_extract(raw, r"^-?\d*\.?\d+", 0).cast("double"))


def length_px(raw: Column) -> Column:
    """Pixels of a plain length; null for anything that is computed."""
    return _number(raw, "px|rem|em") * F.when(raw.rlike("r?em$"), ROOT_PX).otherwise(1)


def _length_em(raw: Column) -> Column:
    return _number(raw, "em|px") / F.when(raw.endswith("px"), ROOT_PX).otherwise(1)


def _judged(cls: Column, base: Column) -> Column:
    """Whether a class stands under no variants, or under dark alone."""
    return F.substring(cls, F.lit(1), F.length(cls) - F.length(base)).rlike("^(?:dark:)*$")


def _typographic(cls: Column) -> Column:
    """Whether a class can say anything of typography; the others have no effect, and are not taken apart."""
    return let(strip_variants(cls), lambda base: base.rlike("^(?:text-|leading-|tracking-|font-|(?:uppercase|normal-case|lowercase|capitalize|italic)$)") & _judged(cls, base))


def _effect(cls: Column, theme: Mapping[str, str]) -> Column:
    """What one typographic class says: at most a size with its leading, a leading, a tracking, a weight, a family, a case or
    italics.  What several of these are read from is bound once: a column that is named twice is computed twice."""

    def named(base: Column) -> Column:
        after = lambda prefix: F.when(base.startswith(prefix), F.substring(base, F.lit(len(prefix) + 1), F.length(base)))
        parts = F.split(after("text-"), "/")
        return F.struct(base.alias("base"), F.get(parts, F.lit(0)).alias("size"), F.get(parts, F.lit(1)).alias("own"), after("leading-").alias("leading"), after("tracking-").alias("tracking"), after("font-").alias("font"))

    def sized(n: Column) -> Column:
        size = n["size"]
        declared = F.create_map(*(F.lit(x) for pair in theme.items() for x in pair))[size] if theme else F.lit(None).cast("string")
        colour = declared.isNull() & (size.rlike(_ARBITRARY_COLOUR) | F.regexp_replace(size, r"-\d{2,3}$", "").isin(*COLOURS))
        explicit = F.coalesce(declared, F.regexp_replace(_inside(size), "^length:", ""))
        return F.struct(n.alias("n"), colour.alias("colour"), (size.isNotNull() & ~colour & ~size.isin(*ALIGNMENTS)).alias("is_size"), explicit.alias("explicit"))

    def valued(s: Column) -> Column:
        n, is_size, explicit = s["n"], s["is_size"], s["explicit"]
        tracking, font, inside = n["tracking"], n["font"], _inside(n["font"])
        numeric = F.when(inside.rlike(r"^\d+(?:\.\d+)?$"), inside.cast("double"))
        return F.struct(
            s.alias("s"),
            F.when(is_size, F.when(explicit.isNotNull(), length_px(explicit)).otherwise(_of({k: v[0] for k, v in FONT_SIZES.items()}, n["size"]))).alias("size"),
            F.coalesce(n["leading"], F.when(is_size, F.nullif(n["own"], F.lit("")))).alias("leading"),
            F.when(tracking.isNotNull(), F.coalesce(_of(TRACKING, tracking), _length_em(_inside(tracking)))).alias("spacing"),
            F.when(font.isNotNull(), F.coalesce(_of(WEIGHTS, font), F.when(numeric.between(100, 900), numeric))).alias("weight"),
            F.when(font.isin(*FAMILIES), font).alias("family"),
        )

    def led(v: Column) -> Column:
        leading, inner = v["leading"], _inside(v["leading"])
        ratio = F.coalesce(_of(LEADING, leading), F.when(inner.rlike(r"^\d*\.?\d+$"), inner.cast("double")))
        px = F.coalesce(F.when(leading.rlike(r"^\d+$"), leading.cast("double") * 4), length_px(inner))
        return F.struct(v.alias("v"), F.when(leading.isNotNull(), ratio).alias("ratio"), F.when(leading.isNotNull(), px).alias("px"))

    def said(x: Column) -> Column:
        v, s, n = x["v"], x["v"]["s"], x["v"]["s"]["n"]
        yes = lambda c: F.coalesce(c, F.lit(False))
        one = lambda c: F.when(yes(c), 1).otherwise(0)
        sets = s["is_size"] & s["explicit"].isNotNull()
        return F.struct(
            cls.alias("cls"),
            yes(sets).alias("explicit"),
            v["size"].alias("size"),
            F.when(s["is_size"] & s["explicit"].isNull(), _of({k: t[1] for k, t in FONT_SIZES.items()}, n["size"])).alias("default_px"),
            v["leading"].isNotNull().alias("leads"),
            x["ratio"].alias("ratio"),
            F.when(x["ratio"].isNull(), x["px"]).alias("px"),
            v["spacing"].alias("spacing"),
            v["weight"].alias("weight"),
            v["family"].alias("family"),
            F.when(n["base"] == "uppercase", True).when(n["base"].isin("normal-case", "lowercase", "capitalize"), False).alias("uppercase"),
            F.when(n["base"] == "italic", True).alias("italic"),
            yes(n["size"].isNotNull() & s["colour"]).alias("colour"),
            (
                one(s["is_size"] & v["size"].isNull())
                + one(v["leading"].isNotNull() & x["ratio"].isNull() & x["px"].isNull())
                + one(n["tracking"].isNotNull() & v["spacing"].isNull())
                + one(n["font"].isNotNull() & v["weight"].isNull() & v["family"].isNull())
            ).alias("unresolved"),
        )

    return let(let(let(let(let(strip_variants(cls), named), sized), valued), led), said)


def resolve(classes: Column, theme: Mapping[str, str] | None = None) -> Column:
    """Typography of a class list: size_px, line_height, spacing_em, weight, family, uppercase, italic, colours, unresolved.

    Later classes win; a size brings its default line height unless a leading was set, and a new size replaces an earlier
    size's default only.  Classes under variants other than dark are not judged; what cannot be worked out is listed, so
    that a rule can abstain.  A fold over the list, which is short.
    """
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(
        none("double").alias("size"), none("double").alias("line_px"), none("double").alias("line"), F.lit(False).alias("from_size"), none("double").alias("spacing"), none("double").alias("weight"), none("string").alias("family"),
        none("boolean").alias("uppercase"), none("boolean").alias("italic"), F.array().cast("array<string>").alias("colours"), F.array().cast("array<string>").alias("unresolved"),
    )

    def add(s: Column, e: Column) -> Column:
        default = e["default_px"].isNotNull() & ~e["leads"] & (s["from_size"] | (s["line_px"].isNull() & s["line"].isNull()))
        stale = e["explicit"] & s["from_size"]
        line_px = F.when(e["leads"] & (e["ratio"].isNotNull() | e["px"].isNotNull()), e["px"]).when(default, e["default_px"]).when(stale, none("double")).otherwise(s["line_px"])
        line = F.when(e["leads"] & (e["ratio"].isNotNull() | e["px"].isNotNull()), e["ratio"]).when(default | stale, none("double")).otherwise(s["line"])
        return F.struct(
            F.when(e["explicit"] | e["default_px"].isNotNull(), e["size"]).otherwise(s["size"]).alias("size"),
            line_px.alias("line_px"),
            line.alias("line"),
            F.when(e["leads"] | stale, False).when(default, True).otherwise(s["from_size"]).alias("from_size"),
            F.coalesce(e["spacing"], s["spacing"]).alias("spacing"),
            F.coalesce(e["weight"], s["weight"]).alias("weight"),
            F.coalesce(e["family"], s["family"]).alias("family"),
            F.coalesce(e["uppercase"], s["uppercase"]).alias("uppercase"),
            F.coalesce(e["italic"], s["italic"]).alias("italic"),
            F.concat(s["colours"], F.when(e["colour"], F.array(e["cls"])).otherwise(F.array().cast("array<string>"))).alias("colours"),
            F.concat(s["unresolved"], F.array_repeat(e["cls"], e["unresolved"])).alias("unresolved"),
        )

    def done(s: Column) -> Column:
        line = F.coalesce(s["line"], F.round(s["line_px"] / s["size"], 3))
        return F.struct(s["size"].alias("size_px"), line.alias("line_height"), s["spacing"].alias("spacing_em"), s["weight"].alias("weight"), s["family"].alias("family"), s["uppercase"].alias("uppercase"), s["italic"].alias("italic"), s["colours"].alias("colours"), s["unresolved"].alias("unresolved"))

    return F.aggregate(F.transform(F.filter(classes, _typographic), lambda c: _effect(c, theme or {})), start, add, done)


def plain_number(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def described(t: Column) -> Column:
    """Typography in words, what is not resolved left out."""
    parts = F.concat_ws(
        ", ",
        F.concat(plain_number(t["size_px"]), F.lit("px")),
        F.concat(F.lit("weight "), plain_number(t["weight"])),
        F.concat(F.lit("leading "), plain_number(t["line_height"])),
        F.concat(F.lit("tracking "), plain_number(t["spacing_em"]), F.lit("em")),
        F.when(t["uppercase"], "uppercase"),
    )
    return F.when(parts == "", "unresolved").otherwise(parts)


def literal_values(classes: Column) -> Column:
    """Classes whose bracketed value is a plain length, time, angle or colour; variables and computed values are not."""

    def literal(cls: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(strip_variants(cls), r"^-?[\w-]+-\[(.+?)\](?:/[^\s]+)?!?$", 1), "^(?:length|color):", "")
        fixed = value.rlike(r"^-?(?:\d+(?:\.\d+)?|\.\d+)(?:px|rem|em|ms|s|deg)?$|^#[0-9a-fA-F]{3,8}$|^(?:rgb|rgba|hsl|hsla|oklab|oklch|color)\(")
        return fixed & ~value.rlike(r"var\(|env\(|theme\(|^--|^(?:calc|min|max|clamp|minmax|repeat|url)\(")

    return F.filter(classes, literal)


def near_scale(classes: Column, theme: Mapping[str, str] | None = None) -> tuple[Column, Column]:
    """(matches, unresolved): bracketed font sizes within a pixel of a size that the theme declares in pixels, and classes
    that cannot be compared.  A match is (cls, token, step_px, difference)."""
    steps = sorted((name, float(raw[:-2])) for name, raw in (theme or {}).items() if raw.endswith("px") and raw[:-2].replace(".", "", 1).isdigit() and name.replace("-", "").replace("_", "").isalnum() and float(raw[:-2]) > 0)
    base = lambda c: strip_variants(c)
    family = lambda c: F.regexp_extract(base(c), _SCALED, 1)
    value = lambda c: F.regexp_extract(base(c), _SCALED, 2).cast("double")
    candidates = F.filter(classes, lambda c: base(c).rlike(_SCALED) & (F.abs(F.regexp_extract(base(c), _SCALED, 2).try_cast("double")) > 2))

    def nearest(c: Column) -> Column:
        table = F.array(*(F.struct(F.round(F.abs(value(c) - px), 9).alias("difference"), F.lit(name).alias("name"), F.lit(px).alias("px")) for name, px in steps))
        return F.array_min(table)

    matched = F.struct
    if steps:
        sized = F.filter(candidates, lambda c: family(c) == "text")
        near = F.transform(sized, lambda c: F.struct(c.alias("cls"), nearest(c).alias("step")))
        found = F.filter(near, lambda x: x["step"]["difference"] <= 1)
        matches = F.transform(found, lambda x: matched(x["cls"].alias("cls"), F.concat(F.substring(x["cls"], F.lit(1), F.length(x["cls"]) - F.length(base(x["cls"]))), F.lit("text-"), x["step"]["name"]).alias("token"), x["step"]["px"].alias("step_px"), x["step"]["difference"].alias("difference")))
    else:
        matches = F.array().cast("array<struct<cls:string,token:string,step_px:double,difference:double>>")
    open_scale = bool(theme) and len(steps) < len(theme)

    def why(c: Column) -> Column:
        out = F.when(family(c) != "text", F.concat(c, F.lit(": "), family(c), F.lit(" scale family is unsupported")))
        if not theme:
            return out.otherwise(F.concat(c, F.lit(": no explicitly declared font scale")))
        far = nearest(c)["difference"] > 1 if steps else F.lit(True)
        return out.when(F.lit(open_scale) & far, F.concat(c, F.lit(": declared font scale contains unresolved values")))

    return matches, F.array_compact(F.transform(candidates, why))
