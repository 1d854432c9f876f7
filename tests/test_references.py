"""Links, scripts and dependencies against what files and manifests there are."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from proseloom.operators import markdown, references


def table(spark, rows):
    return spark.createDataFrame(rows, "file string, text string").selectExpr("*", "'x' AS folder", "1 AS line")


def test_document_nodes_and_links(spark):
    text = "# T [ok](b.md 't') [gone](../x/c%20d.md#top) ![i](<img/a b.PNG>) [web](http://a/b.md) [abs](/b.md) [mark](#x) [bad](%zz.md) [route](guide) [out](../../../z.md)\n\n```\nplain\n```\n\n```js\nx\n```\n\n[d]: ./b.md?q=1\n"
    files = table(spark, [("docs/a.md", text), ("docs/b.md", "x"), ("docs/img/a b.PNG", None), ("e.md", None), ("f.mdx", "<A>[no](no.md)\n")])
    nodes = markdown.document_nodes(files)
    got = {(r.target, r.outcome) for r in references.local_links(nodes, files).where("file = 'docs/a.md'").collect()}
    assert got == {("b.md", "ok"), ("../x/c d.md", "missing"), ("img/a b.PNG", "ok"), ("%zz.md", "malformed"), ("../../../z.md", "outside"), ("./b.md", "ok")}
    assert {tuple(r) for r in references.broken_links(nodes, files).collect()} == {("docs/a.md", 1, "../x/c d.md", "missing"), ("f.mdx", 1, "no.md", "missing")}
    assert [tuple(r) for r in references.untagged_fences(nodes).collect()] == [("docs/a.md", 3)]
    assert references.local_links(nodes.where("false"), files).count() == 0


@pytest.mark.parametrize(("file", "target", "path"), [("a/b.md", "c.md", "a/c.md"), ("b.md", "./x//y.md", "x/y.md"), ("a/b/c.md", "../../d.md", "d.md"), ("a/b.md", "../../d.md", None), ("a.md", "x/../../a.md", None)])
def test_paths_are_resolved(spark, file, target, path):
    assert spark.range(1).select(references.resolved(F.lit(file), F.lit(target))).first()[0] == path


def test_scripts(spark):
    rows = [("package.json", json.dumps({"scripts": {"build": "x", "test:unit": "y"}})), ("sub/package.json", "{"), ("AGENTS.md", "Run `npm run build` and `npm run test:unit`.\n\n```\nnpm run gone\ncd x && npm run other\n```\n\n`npm run nope`"), ("sub/AGENTS.md", "`npm run build` `npm run --prefix a b`")]
    files = table(spark, rows)
    got = {(r.file, r.script, r.manifest, r.outcome) for r in references.missing_scripts(markdown.document_nodes(files), files).collect()}
    assert got == {("AGENTS.md", "build", "package.json", "ok"), ("AGENTS.md", "test:unit", "package.json", "ok"), ("AGENTS.md", "nope", "package.json", "missing"), ("sub/AGENTS.md", "build", "package.json", "ok")}
    alone = files.where("file like 'AGENTS%'")
    assert {r.outcome for r in references.missing_scripts(markdown.document_nodes(alone), alone).collect()} == {"unknown"}


def test_names_in_texts_are_those_that_a_search_finds(spark):
    rnd = random.Random(4)
    names = ["react", "@scope/pkg", "lodash.get", "a-b", "x", "chart.js", "@scope/pkg-b"]
    bits = [*names, "@", "/", ".", "-", "~", "_", " ", '"', "'", "Z", "é", "\n", "deep/path/", "react/jsx"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [set(r[0]) for r in df.select(references.package_names(F.col("text"))).collect()]
    for text, found in zip(texts, got):
        for name in names:
            searched = re.search(rf"(?<![\w@/-]){re.escape(name)}(?![\w-])", text, re.A)
            assert bool(searched) == (name in found), (text, name)


def test_unused_dependencies(spark):
    deps = lambda *names, **more: json.dumps({"dependencies": dict.fromkeys(names, "1"), **more})
    rows = [
        ("package.json", deps("used", "dead", "@types/x", "react-dom", "plugin", "peer", "inner", scripts={"a": "plugin --x"})), ("src/a.ts", "import x from 'used/sub';"), ("sub/package.json", deps("inner", "used")), ("sub/b.ts", "require(`inner`)"),
        ("c/package.json", "{"), ("d/package.json", deps("one", "two")), ("d/x.ts", "onetwo one-two @one/two"), ("e/package.json", deps("only")), ("e/x.png", "only"), ("f/package.json", "{}"), ("f/y.ts", None), ("dead.txt", "dead"),
    ]
    files = table(spark, rows)
    peers = spark.createDataFrame([("", "peer")], "folder string, name string")
    got = {r.file: (r.outcome, r.unused, r.reason) for r in references.unused_dependencies(files, peers).collect()}
    assert got["package.json"] == ("finding", ["dead"], None)
    assert got["sub/package.json"] == ("finding", ["used"], None)
    assert got["c/package.json"] == ("unknown", None, "package.json does not parse")
    assert got["d/package.json"][0] == "unknown" and "built from elsewhere" in got["d/package.json"][2]
    assert got["e/package.json"] == ("finding", ["only"], None) and got["f/package.json"] == ("negative", None, None)
    without = {r.file: r.reason for r in references.unused_dependencies(files).collect()}
    assert without["package.json"].startswith("Install") and without["f/package.json"] is None
    assert "CartesianProduct" not in references.unused_dependencies(files, peers)._jdf.queryExecution().executedPlan().toString()
    assert references.unused_dependencies(files.where("false"), peers).count() == 0
