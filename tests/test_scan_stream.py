"""A stream of file versions: added, changed, unchanged and deleted files."""

import hashlib
import json
import os

from proseloom.plans.lint import run_lint
from proseloom.streaming import scan


def test_findings_follow_the_files(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    os.mkdir(source)
    calls = []

    def findings_of(files):
        calls.append(sorted(r.file for r in files.select("file").collect()))
        return run_lint(files).findings.select("file", "line", "rule_id", "unit_id")

    def feed(name, *rows):
        with open(f"{source}/{name}.json", "w") as f:
            f.writelines(json.dumps(dict(zip(("file", "text", "seq"), r))) + "\n" for r in rows)
        stream = spark.readStream.schema("file string, text string, seq long").json(source)
        scan.scan_changes(stream, out, checkpoint, findings_of).awaitTermination()
        return sorted((r.file, r.line) for r in scan.current_findings(spark, out).collect())

    a, b, c = (f"docs/src0/{x}.md" for x in "abc")
    assert feed("1", (a, "one...", 1), (b, "fine\ntwo...", 1), (c, "fine", 1), (None, "x...", 1)) == [(a, 1), (b, 2)]
    assert calls.pop() == [a, b, c]
    # Unchanged text is not scanned again; of two versions the newer counts, in whatever order they come.
    assert feed("2", (a, "one...", 2), (b, "three...\nthree...", 3), (b, "old", 2)) == [(a, 1), (b, 1), (b, 2)]
    assert calls.pop() == [b]
    assert feed("3", (a, None, 4), (c, "now...", 4), ("docs/src0/d.md", None, 4)) == [(b, 1), (b, 2), (c, 1)]
    assert calls.pop() == [c]
    assert feed("4", (a, "back...", 5), (b, "clean", 5)) == [(a, 1), (c, 1)]
    # Nothing new: no batch runs.
    calls.clear()
    assert feed("5") == [(a, 1), (c, 1)] and not any(calls)


def test_a_batch_is_not_a_call_for_each_file(spark):
    versions = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "same", 1), ("c", None, 3), ("c", "x", 2), ("d", None, 1), (None, "x", 1), ("e", "back", None)], "file string, text string, seq int")
    digests = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("before", "same", "x")}
    known = spark.createDataFrame([("a", digests["before"]), ("b", digests["same"]), ("c", digests["x"]), ("e", "")], "file string, digest string")
    made = scan.changed_files(versions, known)
    assert sorted((r.file, r.text, r.kind) for r in made.collect()) == [("a", "new", "changed"), ("c", None, "deleted"), ("e", "back", "added")]
    assert "Python" not in made._jdf.queryExecution().optimizedPlan().toString()
