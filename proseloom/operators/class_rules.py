"""Checks of class lists and of the typography they resolve to, as columns; each gives evidence, or why it abstains."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text
from proseloom.operators import tailwind
from proseloom.plans.catalogue import filed

_LISTS, _STYLED = ("class-list",), ("class-list", "element")
_REVIEWED = {"status": "review-only"}
_SHARED = {"exclude": ("**/components/ui/**",), **_REVIEWED}

# Fixed values, to the end of the table: ids, categories and conditions of the rules that a check decides.
CLASS_RULES = (
    filed("typography-body-below-15px", "reading-comfort", check=True, asks=("element", "role"), kinds=_STYLED),
    filed("typography-letterspaced-body", "reading-comfort", check=True, asks=("element", "role"), kinds=_STYLED),
    filed("typography-light-weight-small-body", "reading-comfort", check=True, kinds=_STYLED),
    filed("typography-line-height-out-of-band", "reading-comfort", check=True, kinds=_STYLED),
    filed("typography-hierarchy-size-only", "type-hierarchy", check=True, asks=("neighbours",), kinds=_STYLED, review=0.4, act=0.75),
    filed("typography-numeric-cell-proportional-figures", "typographic-detail", check=True, kinds=_LISTS, **_REVIEWED),
    filed("typography-stacked-emphasis", "type-hierarchy", check=True, kinds=_STYLED),
    filed("typography-uppercase-without-tracking", "reading-comfort", check=True, kinds=_STYLED),
    filed("craft-near-duplicate-scale", "look-constraints", check=True, kinds=_LISTS, **_REVIEWED),
    filed("motion-ease-in-on-transition", "easing-and-duration", check=True, kinds=_LISTS),
    filed("motion-linear-easing-on-transition", "easing-and-duration", check=True, kinds=_LISTS),
    filed("motion-duration-over-300ms", "easing-and-duration", check=True, kinds=_LISTS),
    filed("motion-transition-all", "motion-restraint", check=True, kinds=_LISTS),
    filed("motion-scale-from-zero", "spatial-continuity", check=True, kinds=_LISTS),
    filed("motion-animate-without-reduced-motion", "motion-restraint", check=True, kinds=_LISTS, **_REVIEWED),
    filed("craft-raw-colour-class", "colour-system", check=True, kinds=_LISTS, **_SHARED),
    filed("craft-arbitrary-value-class", "look-constraints", check=True, asks=("section",), kinds=_LISTS, **_SHARED),
    filed("craft-interpolated-class-string", "look-constraints", check=True, kinds=_LISTS, **_SHARED),
    filed("motion-reduced-motion-animation", "motion-restraint", check=True, kinds=_LISTS, **_REVIEWED),
    filed("typography-justify-without-hyphens", "reading-comfort", check=True, kinds=_LISTS, **_REVIEWED),
    filed("typography-disabled-kerning", "typographic-detail", check=True, kinds=_LISTS, **_REVIEWED),
    filed("typography-stretched-glyphs", "type-quality", check=True, kinds=_LISTS, **_REVIEWED),
    filed("motion-layout-property-transition", "motion-restraint", check=True, kinds=_LISTS, **_REVIEWED),
)
_PALETTE = r"^(?:bg|text|border|ring|fill|stroke|from|via|to|outline|shadow|accent|caret|decoration|divide|placeholder)-(?:" + "|".join(tailwind.HUES) + r")-\d{2,3}(?:/\d{1,3})?$"
_LAYOUT = r"^transition-\[(?:[^\]]*,)?(?:width|height|top|left|right|bottom|margin|padding)(?:,|\])"

Check = tuple[Column, Column | None]


def with_typography(units: DataFrame, theme: Mapping[str, str] | None = None) -> DataFrame:
    """Adds what several checks read: _bases, the classes without variants, and the typography of a unit (_type) and of the
    next one beside it (_next)."""
    has = lambda name, kind: F.col(name) if name in units.columns else F.lit(None).cast(kind)
    own = has("classes", "array<string>")
    beside = has("next_classes", "array<string>")
    listed = F.coalesce(own, F.array().cast("array<string>"))
    return units.withColumns(
        {
            "_classes": listed,
            "_bases": F.transform(listed, text.strip_variants),
            "_type": F.when(own.isNotNull(), tailwind.resolve(own, theme)),
            "_next": F.when(F.size(F.coalesce(beside, F.array().cast("array<string>"))) > 0, tailwind.resolve(beside, theme)),
            "_dynamic": F.coalesce(has("dynamic", "boolean"), F.lit(False)),
            "_interpolated": F.coalesce(has("interpolated", "boolean"), F.lit(False)),
        }
    )


def _open_size(t: Column) -> Column:
    return t["size_px"].isNull() & F.exists(t["unresolved"], lambda c: c.startswith("text-"))


def checks(theme: Mapping[str, str] | None = None) -> dict[str, Check]:
    """By rule id: evidence where a unit of ``with_typography`` fails the check, else null, and a reason where it abstains."""
    classes, bases, t, following = F.col("_classes"), F.col("_bases"), F.col("_type"), F.col("_next")
    said = F.trim(F.coalesce(F.col("text"), F.lit(""))) != ""
    role, words = F.col("role"), text.count_words(F.coalesce(F.col("text"), F.lit("")))
    has = lambda name: F.array_contains(bases, name)
    some = lambda cond: F.exists(bases, cond)
    joined = lambda found: F.when(F.size(found) > 0, F.array_join(found, " "))
    moves = lambda c: c.startswith("transition") & (c != "transition-none")
    plays = lambda c: c.startswith("animate-") & (c != "animate-none")
    animates = some(lambda c: moves(c) | c.startswith("duration-") | plays(c))
    named, arbitrary = r"^duration-(\d+)$", r"^duration-\[(\d+(?:\.\d+)?)(ms|s)\]$"

    def slow(c: Column) -> Column:
        ms = F.when(c.rlike(named), F.regexp_extract(c, named, 1).try_cast("double")).when(c.rlike(arbitrary), F.regexp_extract(c, arbitrary, 1).try_cast("double") * F.when(F.regexp_extract(c, arbitrary, 2) == "s", 1000).otherwise(1))
        return F.coalesce(ms, F.lit(0.0)) > 300

    shown = tailwind.described(t)
    styled = t.isNull()
    no_list = F.when(styled, "no class list")
    open_size = F.when(_open_size(t), F.concat(F.lit("unresolved "), F.array_join(t["unresolved"], " ")))
    body, tracked, light = role.isin("body", "list-item", "cell"), t["spacing_em"].isNotNull() & said & ~F.coalesce(t["uppercase"], F.lit(False)) & ~role.isin("heading", "button"), t["weight"].isNotNull() & said
    band = (
        F.when(t["line_height"].isNull() | t["size_px"].isNull(), None)
        .when(t["size_px"] >= 32, F.when(t["line_height"] > 1.25, F.concat(shown, F.lit(" on display text"))))
        .when(~role.isin("body", "list-item") | (words < 8), None)
        .when((t["line_height"] < 1.35) | (t["line_height"] > 1.7), F.concat(shown, F.lit(" on running text")))
    )
    big, small = F.greatest(t["size_px"], following["size_px"]), F.least(t["size_px"], following["size_px"])
    pair_known = t["size_px"].isNotNull() & following["size_px"].isNotNull()
    close = pair_known & (big / small > 1) & (big / small <= 1.2) & (F.coalesce(t["weight"], F.lit(400.0)) == F.coalesce(following["weight"], F.lit(400.0)))
    pair_open = F.when(following.isNotNull() & ~pair_known & F.exists(F.concat(t["unresolved"], following["unresolved"]), lambda c: c.startswith("text-")), "font size unresolved on one of the pair")
    loud = F.exists(t["colours"], lambda c: ~c.rlike(r"(?:^|:)text-(?:muted|secondary|foreground|inherit|current)(?:-|$|/)"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    axes = yes(F.coalesce(t["weight"], F.lit(400.0)) >= 600) + yes(t["uppercase"]) + yes(loud) + yes(F.coalesce(t["size_px"], F.lit(16.0)) >= 24) + yes(t["italic"])
    near, uncompared = tailwind.near_scale(classes, theme)
    near_said = F.transform(near, lambda x: F.concat(x["cls"], F.lit(" is "), tailwind.plain_number(F.least(x["difference"], F.lit(1.0))), F.lit("px from "), x["token"], F.lit(" ("), tailwind.plain_number(x["step_px"]), F.lit("px)")))
    literal = tailwind.literal_values(classes)
    animated = F.filter(bases, plays)
    guarded = F.array_contains(classes, "motion-reduce:animate-none") | F.forall(F.filter(classes, lambda c: plays(text.strip_variants(c))), lambda c: F.array_contains(F.split(c, ":"), "motion-safe"))
    first = lambda found: F.get(found, F.lit(0))
    return {
        "typography-body-below-15px": (F.when(body & (words >= 6) & (t["size_px"] < 15), F.concat(shown, F.lit(" on "), words.cast("string"), F.lit(" words of body text"))), F.coalesce(no_list, open_size)),
        "typography-letterspaced-body": (F.when(tracked & (t["spacing_em"] > 0) & (t["size_px"] >= 13), shown), F.coalesce(no_list, F.when(tracked, open_size))),
        "typography-light-weight-small-body": (F.when(light & (t["weight"] <= 300) & (t["size_px"] <= 18), shown), F.coalesce(no_list, F.when(light, open_size))),
        "typography-line-height-out-of-band": (band, no_list),
        "typography-hierarchy-size-only": (F.when(close, F.concat(shown, F.lit(" over "), tailwind.described(following), F.lit(", ratio "), F.format_number(big / small, 2))), F.coalesce(no_list, pair_open)),
        "typography-numeric-cell-proportional-figures": (F.when((role == "cell") & F.col("text").rlike(r"\d") & ~F.exists(classes, lambda c: c.endswith("tabular-nums") | c.contains("tnum")), F.concat(F.lit('numeric cell "'), F.col("text"), F.lit('" without tabular-nums'))), None),
        "typography-stacked-emphasis": (F.when(said & (axes >= 3), F.concat(axes.cast("string"), F.lit(" emphasis axes at once ("), shown, F.when(F.size(t["colours"]) > 0, F.concat(F.lit(", "), F.array_join(t["colours"], " "))).otherwise(""), F.lit(")"))), no_list),
        "typography-uppercase-without-tracking": (F.when(said & t["uppercase"] & (F.coalesce(t["spacing_em"], F.lit(0.0)) <= 0), shown), no_list),
        "craft-near-duplicate-scale": (F.when(F.size(near) > 0, F.array_join(near_said, "; ")), F.when((F.size(near) == 0) & (F.size(uncompared) > 0), F.array_join(uncompared, "; ")).when((F.size(near) > 0) & F.col("_dynamic"), "Dynamic classes may override the near-scale candidate")),
        "motion-ease-in-on-transition": (F.when(has("ease-in") & animates, "ease-in"), None),
        "motion-linear-easing-on-transition": (F.when(has("ease-linear") & animates & ~some(lambda c: (c == "animate-spin") | c.contains("marquee")), "ease-linear"), None),
        "motion-duration-over-300ms": (F.when(some(moves), joined(F.filter(bases, slow))), None),
        "motion-transition-all": (F.when(has("transition-all"), "transition-all"), None),
        "motion-scale-from-zero": (F.when(animates, joined(F.filter(bases, lambda c: c.isin("scale-0", "zoom-in-0")))), None),
        "motion-animate-without-reduced-motion": (F.when(~guarded, joined(animated)), None),
        "craft-raw-colour-class": (joined(F.filter(bases, lambda c: c.rlike(_PALETTE))), None),
        "craft-arbitrary-value-class": (joined(literal), F.when((F.size(literal) > 0) & F.col("_dynamic"), "Dynamic classes may change the literal styling")),
        "craft-interpolated-class-string": (F.when(F.col("_interpolated"), F.array_join(classes, " ")), None),
        "motion-reduced-motion-animation": (first(F.filter(classes, lambda c: F.array_contains(F.split(c, ":"), "motion-reduce") & text.strip_variants(c).isin("animate-spin", "animate-ping", "animate-bounce"))), None),
        "typography-justify-without-hyphens": (F.when(F.array_contains(classes, "text-justify") & F.array_contains(classes, "hyphens-none"), "text-justify with hyphens-none"), None),
        "typography-disabled-kerning": (F.when(said & F.array_contains(classes, "[font-kerning:none]"), "font-kerning: none"), None),
        "typography-stretched-glyphs": (F.when(said & role.isin("body", "heading", "label"), first(F.filter(classes, lambda c: c.rlike(r"^scale-x-(?:50|75|90|95|105|110|125|150|200)$")))), None),
        "motion-layout-property-transition": (first(F.filter(classes, lambda c: text.strip_variants(c).rlike(_LAYOUT))), None),
    }

