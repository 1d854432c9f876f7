"""What files name, and whether it is there: links to local files, package scripts, and dependencies that nothing uses.

Each is a join on names that the texts are taken apart into, never a search of every text for every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.operators.structure import ancestors, nearest_ancestor
from proseloom.sources.shared import small

# Links that can be looked up, files that may name a package, and packages that a runtime loads by name.
LINKED = r"(?i)\.(?:md|mdx|png|jpe?g|svg|gif|webp|pdf)$"
SEARCHED = r"\.(?:[cm]?[jt]sx?|json|jsonc|css|scss|ya?ml|mdx?|html|toml|prisma|sh|vue|svelte|astro)$"
IMPLICIT = ("react-dom", "sharp", "typescript", "tslib", "server-only", "client-only", "@swc/helpers", "pg-native", "encoding", "bufferutil", "utf-8-validate")
_MAP = "map<string,string>"


def folder_of(file: Column) -> Column:
    """The folder of a path, empty for the root."""
    return F.regexp_replace(file, "(?:^|/)[^/]*$", "")


def resolved(file: Column, target: Column) -> Column:
    """The path that a target names from a file; null where it leaves the root."""
    joined = F.concat_ws("/", F.when(folder_of(file) != "", folder_of(file)), target)
    kept = F.filter(F.split(joined, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done["path"]) > 0, F.slice(done["path"], F.lit(1), F.greatest(F.size(done["path"]) - 1, F.lit(0)))).otherwise(none)
        return F.struct(
            F.when(part == "..", up).otherwise(F.concat(done["path"], F.array(part))).alias("path"),
            (done["out"] | ((part == "..") & (F.size(done["path"]) == 0))).alias("out"),
        )

    return F.aggregate(kept, F.struct(none.alias("path"), F.lit(False).alias("out")), step, lambda s: F.when(~s["out"], F.array_join(s["path"], "/")))


def _decoded(url: Column) -> Column:
    """The path of a link without query and mark, percent signs decoded; null where they are malformed."""
    path = F.regexp_extract(url, "^[^?#]*", 0)
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def local_links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, start, target, resolved and outcome of the links, images and definitions of documents to local files.

    ``nodes`` is a table of document nodes, ``files`` has the paths that there are.  Outcomes: ``ok``, ``missing``,
    ``malformed`` (the address cannot be decoded) and ``outside`` (it leaves the root).  Addresses with a scheme, absolute
    ones, marks and those without a known ending are not looked up.  One join by path; a much linked file is one row on
    its side, and links to it are what Spark splits if they are very many.
    """
    linked = nodes.where(F.col("node").isin("link", "image", "definition") & ~F.col("value").rlike(r"(?i)^(?:[a-z][\w+.-]*:|/|#)") & (F.col("value") != ""))
    linked = linked.select("file", "line", "start", F.col("value").alias("url"), _decoded(F.col("value")).alias("target"))
    linked = linked.where(F.col("target").isNull() | F.col("target").rlike(LINKED)).withColumn("resolved", resolved(F.col("file"), F.col("target")))
    there = files.select(F.col("file").alias("resolved")).distinct().withColumn("there", F.lit(True))
    outcome = F.when(F.col("target").isNull(), "malformed").when(F.col("resolved").isNull(), "outside").when(F.col("there"), "ok").otherwise("missing")
    return linked.join(there, "resolved", "left").select("file", "line", "start", F.coalesce("target", "url").alias("target"), "resolved", outcome.alias("outcome"))


def broken_links(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The first link of each document that is not ok: file, line, target, outcome; what leaves the root cannot be decided."""
    first = local_links(nodes, files).where("outcome <> 'ok'").groupBy("file").agg(F.min_by(F.struct("line", "target", "outcome"), "start").alias("f"))
    return first.select("file", "f.line", "f.target", F.when(F.col("f.outcome") == "outside", "unknown").otherwise(F.col("f.outcome")).alias("outcome"))


def untagged_fences(nodes: DataFrame) -> DataFrame:
    """The first code fence without a language of each document: file, line."""
    return nodes.where("node = 'code' and lang is null").groupBy("file").agg(F.min("line").alias("line"))


def manifests(files: DataFrame) -> DataFrame:
    """folder, file, scripts, dependencies, development (name to version) and rest, the other text, of package manifests.

    Of a manifest that does not parse all but folder and file are null.
    """
    found = files.where(F.col("file").rlike(r"(?:^|/)package\.json$"))
    top = F.from_json("text", _MAP)
    part = lambda name: F.when(F.col("top").isNotNull(), F.coalesce(F.from_json(F.col("top")[name], _MAP), F.create_map().cast(_MAP)))
    rest = F.to_json(F.map_filter("top", lambda k, _: k != "dependencies"))
    return found.withColumn("top", top).select(folder_of(F.col("file")).alias("folder"), "file", part("scripts").alias("scripts"), part("dependencies").alias("dependencies"), part("devDependencies").alias("development"), F.when(F.col("top").isNotNull(), rest).alias("rest"))


def missing_scripts(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """file, line, script, manifest and outcome of package scripts that documents run: ``ok``, ``missing``, or ``unknown``
    without a manifest that can be read in a folder above."""
    code = nodes.where("node in ('code', 'inlineCode')").where(~F.col("value").rlike(r"--(?:workspace|prefix)|\bcd\s"))
    named = code.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(r"\bnpm run ([\w:-]+)\b"), F.lit(1)))).alias("script")).distinct()
    read = manifests(files).where("scripts is not null")
    marks = read.select("folder", F.struct(F.col("file").alias("manifest"), F.map_keys("scripts").alias("scripts")).alias("value"))
    owner = nearest_ancestor(named.select("file").distinct(), marks).select("file", "value.manifest", "value.scripts")
    outcome = F.when(F.col("scripts").isNull(), "unknown").when(F.array_contains("scripts", F.col("script")), "ok").otherwise("missing")
    return named.join(owner, "file", "left").select("file", "line", "script", "manifest", outcome.alias("outcome"))


#: Longest name of a package, by its registry.
NAME_CHARS = 214


def package_names(text: Column) -> Column:
    """Every name that a text may mean a package by, distinct: what starts behind a letter, ``@``, ``/`` or ``-`` is none, nor
    what goes on with a letter or ``-``.

    A run of name characters is cut at its marks; a name starts at the run's start or behind a dot or tilde, and ends
    before a mark, the second slash at the latest, so that a run has few names.
    """
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w@/.~-]+)"), F.lit(1)))

    def of(run: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: (i == 1) | F.substring(run, i - 1, F.lit(1)).isin(".", "~"))

        def names(i: Column) -> Column:
            tail = F.regexp_extract(F.substring(run, i, F.lit(NAME_CHARS + 1)), r"^[^/]*(?:/[^/]*)?", 0)
            ends = F.filter(F.sequence(F.lit(1), F.greatest(F.length(tail), F.lit(1))), lambda j: (j == F.length(tail)) | F.substring(tail, j + 1, F.lit(1)).isin("/", ".", "@", "~"))
            return F.transform(ends, lambda j: F.substring(tail, F.lit(1), j))

        return F.flatten(F.transform(starts, names))

    # Most runs have no mark, and are one name: only the others are cut.
    whole = lambda run: F.array(F.substring(run, F.lit(1), F.lit(NAME_CHARS + 1)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.when(run.rlike("[./@~]"), of(run)).otherwise(whole(run)))))


def unused_dependencies(files: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """file, outcome, unused and reason of package manifests that no file of their folder names a dependency of.

    ``files`` is (file, text); ``peers`` (folder, name) has what installed packages of a folder load by themselves.
    Outcomes: finding (some are unused), negative, and unknown: the manifest does not parse, peers are not known, or no
    dependency is named at all, which says that the sources are elsewhere.  Texts become the names in them, and names meet
    dependencies by equality: first any package's, so that few rows go on, then the folders above their file.
    """
    read = manifests(files)
    listed = read.where("dependencies is not null").select("folder", F.explode(F.map_keys("dependencies")).alias("name")).where(~F.col("name").startswith("@types/") & ~F.col("name").isin(*IMPLICIT))
    texts = files.where(F.col("file").rlike(SEARCHED) & ~F.col("file").rlike(r"(?:^|/)package\.json$")).select("file", "text")
    others = files.where(F.col("file").rlike(r"(?:^|/)package\.json$")).join(read.select("file", "rest"), "file").select("file", "text", "rest")
    # A manifest's own dependencies name nothing to its folder, only its other fields do; to folders above it is a text.
    said = lambda rows, text, where: rows.select("file", F.explode(package_names(F.col(text))).alias("name"), F.lit(where).alias("to"))
    known = small(listed.select("name").distinct())
    met = said(texts, "text", "all").unionByName(said(others, "rest", "own")).unionByName(said(others, "text", "above")).join(known, "name", "left_semi")
    up = met.select("name", "to", folder_of(F.col("file")).alias("home"), F.explode(ancestors(F.col("file"))).alias("folder"))
    own = F.col("home") == F.col("folder")
    used = up.where((F.col("to") == "all") | ((F.col("to") == "own") & own) | ((F.col("to") == "above") & ~own)).select("folder", "name").distinct()
    if peers is not None:
        used = used.unionByName(peers.select("folder", "name")).distinct()
    left = listed.join(used.withColumn("used", F.lit(True)), ["folder", "name"], "left")
    counted = left.groupBy("folder").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("used").isNull(), F.col("name")))).alias("unused"))
    installed = F.lit(peers is not None) | (F.size(F.map_keys(F.map_concat("dependencies", F.map_filter("development", lambda k, _: ~F.map_contains_key("dependencies", k))))) == 0)
    joined = read.join(counted, "folder", "left")
    reason = (
        F.when(F.col("dependencies").isNull(), "package.json does not parse")
        .when(F.col("n").isNull(), None)
        .when(~installed, "Install dependencies so peer dependencies can be read")
        .when((F.size("unused") == F.col("n")) & (F.col("n") > 1), "No file in the package imports any dependency; its source is built from elsewhere")
    )
    some = F.coalesce(F.size("unused") > 0, F.lit(False))
    return joined.withColumn("reason", reason).select("file", F.when(F.col("reason").isNotNull(), "unknown").when(some, "finding").otherwise("negative").alias("outcome"), F.when(F.col("reason").isNull() & some, F.col("unused")).alias("unused"), "reason")
