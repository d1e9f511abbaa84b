"""Tables that batches and streams keep: restarts, replays, late rows, expiry and deletes."""

import datetime

import pytest
from pyspark.sql import functions as F

from siftlake.operators import buckets, cache, deletes, diffs, exports, imports, rules
from siftlake.streaming import findings

def now():
    return F.expr("timestamp_ntz '2024-02-01 12:00:00'")


def moment(text):
    return datetime.datetime.fromisoformat(text)


ITEMS = "path string, diff string"


def with_key(df):
    return df.withColumn("key", cache.cache_key(F.col("path"), F.col("diff")))


def test_cached_verdicts_hit_expire_and_miss(spark, tmp_path):
    at = f"{tmp_path}/cache"
    items = with_key(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], ITEMS))
    assert {r.state for r in cache.looked_up(items, cache.stored(spark, at), now()).collect()} == {"missing"}
    fields = "verdict string, severity string, cwe_id string, confidence double, title string, summary string, evidence string, sanitizer_found boolean, sanitizer_description string, attack_vector string, remediation string, false_positive_reason string"
    verdict = ("TRUE_POSITIVE", "HIGH", "CWE-89", 0.9, "t", "s", "secret code", True, None, "code too", "r", None)
    for path, diff, when in (("a", "1", "2024-01-25 12:00:00"), ("a", "2", "2024-01-25 11:59:59"), ("b", "1", "2024-01-10 00:00:00"), ("b", "1", "2024-02-02 00:00:00")):
        one = with_key(spark.createDataFrame([(path, diff, *verdict)], f"{ITEMS}, {fields}"))
        cache.append(cache.entries(one, F.lit(when).cast("timestamp_ntz")), at)
    got = {(r.path, r.diff): r for r in cache.looked_up(items, cache.stored(spark, at), now()).collect()}
    # exactly seven days old still holds; one that is stored later is not there yet
    assert {k: r.state for k, r in got.items()} == {("a", "1"): "hit", ("a", "2"): "expired", ("b", "1"): "expired", ("c", "1"): "missing"}
    assert '"evidence":""' in got["a", "1"].content and "code" not in got["a", "1"].content
    assert [r.day for r in cache.removable(cache.stored(spark, at), now(), kept=20).collect()] == [datetime.date(2024, 1, 10)]


def test_misses_are_asked_for_and_stored_once(spark, tmp_path):
    at, asked = f"{tmp_path}/cache", []

    def ask(rows):
        asked.append(sorted((r.path, r.diff) for r in rows.collect()))
        return rows.withColumn("content", F.when(F.col("path") == "bad", "no json").otherwise('{"verdict": "FALSE_POSITIVE", "severity": "LOW", "confidence": 0.9, "evidence": "x"}'))

    items = with_key(spark.createDataFrame([("a", "1"), ("a", "1"), ("bad", "1")], ITEMS))
    for n in (3, 1):
        rows, new = cache.answered(items, cache.stored(spark, at), now(), ask)
        assert sorted((r.path, r.cached, r.verdict) for r in rows.collect()) == [("a", n == 1, "FALSE_POSITIVE")] * 2 + [("bad", False, "ERROR")]
        assert new.count() == (1 if n == 3 else 0)
        cache.append(new, at)
    assert asked == [[("a", "1"), ("a", "1"), ("bad", "1")], [("bad", "1")]]


def requests_of(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame([(r, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)) for r, i, m in rows], "repo_id bigint, id bigint, ts timestamp").coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema("repo_id bigint, id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def limited(rows, limit, minutes):
    """Flags in order of time, by the times accepted before."""
    out, kept = [], {}
    for repo, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        inside = [x for x in kept.get(repo, []) if x > at - minutes]
        out.append((repo, i, len(inside) < limit))
        kept[repo] = inside + [at] * (len(inside) < limit)
    return sorted(out)


def test_rate_limit_of_requests_out_of_order(spark, tmp_path):
    """Requests in several batches, each out of order and overlapping the next, are decided in order of time; a request at the end lets the watermark pass all."""
    rows = [(i % 3, i, (i * 37) % 400) for i in range(120)]
    parts = [rows[:40], rows[40:80], rows[80:], [(9, 999, 100_000)]]
    stream = requests_of(spark, f"{tmp_path}/in", parts)
    with findings.rocks(spark):
        findings.run_available(findings.accepted(stream, limit=2, hours=1, late="1 day"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == limited(rows, 2, 60)


FEEDBACK = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def feedback_files(spark, folder, names):
    for name in names:
        i = int(name)
        rows = [(50 * (10 * i + k) + k % 4, moment("2024-01-01 00:00:00") + datetime.timedelta(hours=10 * i + 7 * k % 10 - (20 if k % 3 == 0 else 0)), k % 2, f"v{i}{k}", 1.0, "") for k in range(10)]
        spark.createDataFrame(rows, FEEDBACK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


@pytest.mark.parametrize("every", [1, 2, 10])
def test_fold_goes_on_after_a_stop_and_after_a_failed_batch(spark, tmp_path, every):
    """A stream stopped between batches, one that fails after its rows are written, and a batch that runs again give the answer of one batch."""
    source, table, state = (f"{tmp_path}/{x}" for x in ("in", "table", "state"))
    feedback_files(spark, source, ["1"])
    kept = findings.Kept(spark, table, state, findings.last_words, findings.fold_feedback, every)

    def stream():
        return findings.feedback(spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"))

    def answer(*folders):
        rows = findings.last_words(findings.feedback(spark.read.schema(FEEDBACK).parquet(*[f"{source}/{x}" for x in folders])))
        return sorted(map(tuple, rows.select("scan_id", "user_id", "verdict").collect()))

    def now():
        return sorted(map(tuple, kept.current().select("scan_id", "user_id", "verdict").collect()))

    assert kept.current() is None
    kept.run(stream())
    assert now() == answer("1")
    feedback_files(spark, source, ["2", "3"])

    def fails(rows, batch):
        kept.write(rows, batch)
        if batch == 2:
            raise RuntimeError("after the rows are written, before the batch is committed")

    with pytest.raises(Exception, match="before the batch is committed"):
        stream().writeStream.foreachBatch(fails).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    # the rows of the batch that is not committed are there, but the current table does not have them
    assert 2 in kept.complete("part") + kept.complete("whole")
    done = now()
    assert done in (answer("1", "2"), answer("1", "3")) and done != answer("1", "2", "3")
    kept.run(stream())
    assert now() == answer("1", "2", "3")
    feedback_files(spark, source, ["4", "5", "6"])
    kept.run(stream())
    assert now() == answer("1", "2", "3", "4", "5", "6")
    assert len(kept.complete("whole")) == min(2, 6 // every) and len(kept.complete("part")) <= max(0, 2 * every - 2)
    # an unfinished table of a later batch is not read
    spark.createDataFrame([(1, 1, "half", None, 1)], "scan_id bigint, user_id bigint, verdict string, ts timestamp, event_id bigint").write.parquet(f"{table}/whole-5x")
    (tmp_path / "table/whole-5x").rename(tmp_path / "table/whole-99")
    (tmp_path / "table/whole-99/_SUCCESS").unlink()
    assert now() == answer("1", "2", "3", "4", "5", "6")


def test_counts_by_day_have_exact_edges(spark):
    as_of = "2024-03-10 06:30:00"
    start = moment(as_of)
    times = [start - datetime.timedelta(days=d, seconds=s) for d in (0, 1, 2, 6, 7, 8) for s in (-1, 0, 1, 23_400, 23_401, 86_399)]
    scans = spark.createDataFrame([(i % 2, "TRUE_POSITIVE" if i % 3 else "ERROR", t) for i, t in enumerate(times)] + [(1, "ERROR", None)], "repo_id bigint, verdict string, created_at timestamp_ntz")
    rows = buckets.window_counts(buckets.by_day(scans), scans, as_of, {"day": "24 HOURS", "week": "7 DAYS"}).collect()
    for name, days in (("day", 1), ("week", 7)):
        for repo in (0, 1):
            for verdict in ("TRUE_POSITIVE", "ERROR"):
                want = sum(t > start - datetime.timedelta(days=days) for i, t in enumerate(times) if i % 2 == repo and ("TRUE_POSITIVE" if i % 3 else "ERROR") == verdict)
                assert sum(r[name] for r in rows if r.repo_id == repo and r.verdict == verdict) == want
    parts = [scans.filter("repo_id = 0"), scans.filter("repo_id = 1")]
    both = buckets.merged(buckets.by_day(parts[0]), buckets.by_day(parts[1]))
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, buckets.by_day(scans).collect()), key=str)


def files_of(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def test_deletes_write_only_touched_partitions(spark, tmp_path):
    at, schema = tmp_path / "rows", "id bigint, name string, part int"
    rows = spark.createDataFrame([(i, None if i == 5 else f"n{i}", i % 4 if i < 16 else None) for i in range(20)], schema)
    deletes.write(rows, str(at), ["part"])
    before = files_of(at)
    assert deletes.delete(spark, str(at), schema, ["part"], F.col("id").isin(1, 5)) == {"rows": 2, "partitions": 1, "files": 1}
    after = files_of(at)
    assert {f for f in before if "part=1" not in f} == {f for f in after if "part=1" not in f} and all(after[f] == before[f] for f in before if f in after)
    # all of one partition and some without a partition value
    doomed = spark.createDataFrame([(2,), (6,), (10,), (14,), (17,)], "id bigint")
    assert deletes.delete(spark, str(at), schema, ["part"], doomed, ["id"])["rows"] == 5
    assert sorted(r.id for r in deletes.read(spark, str(at), schema).collect()) == [i for i in range(20) if i not in (1, 5, 2, 6, 10, 14, 17)]
    assert not (at / "part=2").exists()
    # again: nothing is left to delete; a null condition deletes nothing
    assert deletes.delete(spark, str(at), schema, ["part"], doomed, ["id"]) == {"rows": 0, "partitions": 0, "files": 0}
    assert deletes.delete(spark, str(at), schema, ["part"], F.col("name") > F.lit(None))["rows"] == 0


def imported(spark, path, text, *names):
    rows = spark.createDataFrame([(1, path, i + 1, t) for i, t in enumerate(text.split("\n"))], "pr_id int, path string, line_no int, text string")
    wanted = spark.createDataFrame([(1, path, n) for n in names], "pr_id int, path string, name string")
    return {r.name: r.target for r in imports.resolved(wanted, rows).collect()}


@pytest.mark.parametrize(
    "path, text, names, want",
    [
        ("w/a.ts", "import {\n  one,\n  two as three\n} from './x'\nimport four from '../y.ts'", "one two three four", {"one": "w/x.js", "two": "w/x.js", "four": "y.ts"}),
        ("w/a.js", "const {\n  one\n} = require('./x'); let two = require('./y'); var z = 'from'", "one two z", {"one": "w/x.js", "two": "w/y.js"}),
        ("a.js", "const x = 5\ncall(one)\nimport one from 'react'\nimport two from './b'", "one two x", {"two": "b.js"}),
        ("s/m.go", 'import (\n\t"fmt"\n\ta "example.com/auth"\n)\nvar x = "example.com/no"\nauth.One()\nno.One()\nfmt.One()', "One", {"One": "example.com/auth/auth.go"}),
        ("s/m.go", 'import "example.com/late"\nimport (\n"example.com/x/late"\n)\nlate.One()', "One", {"One": "example.com/late/late.go"}),
        ("A.java", "import static com.acme.Tool;\nimport java.util.List;\nTool.one(x);\nnew Tool();", "one Tool List", {"one": "src/main/java/com/acme/Tool.java", "Tool": "src/main/java/com/acme/Tool.java"}),
        ("s/a.py", "import pkg.tools as t\nfrom other import load\nt.load(x)", "load", {"load": "pkg/tools.py"}),
        ("s/a.py", "from .u import (one, two as x)\nfrom .v import one\n  from .w import two", "one two x", {"one": "s/v.py", "two": "s/u.py"}),
        ("a.py", "from m1 import zeta\nfrom m2 import a\nfrom m3 import b\nfrom m4 import c\nfrom m1 import d", "a b c d zeta", {"zeta": "m1.py", "a": "m2.py", "b": "m3.py"}),
        ("a.rb", "from m1 import zeta", "zeta", {}),
    ],
)
def test_imports_over_lines_in_order(spark, path, text, names, want):
    assert imported(spark, path, text, *names.split()) == want


def test_sources_in_other_chunks_do_not_pair(spark):
    text = ["x"] * 300
    text[9], text[11], text[199], text[202] = "a = request.args.get('a')", "cursor.execute(a)", "b = request.args.get('b')", "cursor.execute(b)"
    rows = spark.createDataFrame([(1, "s/a.py", "python", i + 1, t, i + 1 in (10, 12, 200, 203)) for i, t in enumerate(text)], "pr_id int, path string, language string, line_no int, text string, changed boolean")
    head = "diff --git a/s/a.py b/s/a.py\n--- a/s/a.py\n+++ b/s/a.py\n"
    body = "@@ -1,3 +10,3 @@\n+" + text[9] + "\n x\n+" + text[11] + "\n@@ -1,3 +200,4 @@\n+" + text[199] + "\n x\n-gone\n x\n+" + text[202]
    prs = spark.createDataFrame([(1, head + body + "\ndiff --git a/tests/test_a.py b/tests/test_a.py\n+++ b/tests/test_a.py\n@@ -1 +1 @@\n+cursor.execute(a)\ndiff --git a/i.bin b/i.bin\nBinary files differ")], "pr_id int, raw_diff string")
    lines = diffs.lines(prs)
    assert [(r.chunk, r.path, r.bin, r.placeholder) for r in diffs.chunk_plan(lines, max_lines=4).orderBy("chunk").collect()] == [(1, "s/a.py", 0, False), (2, "s/a.py", 1, False), (3, "tests/test_a.py", 0, True), (4, "i.bin", 0, False)]
    changed = diffs.added_lines(diffs.chunk_lines(lines, max_lines=4), "chunk")
    assert sorted((r.chunk, r.line_no) for r in changed.collect()) == [(1, 10), (1, 12), (2, 200), (2, 203)]
    paths = rules.taint_paths(rules.chunk_sinks(rows, changed), rules.chunk_sources(rows, changed), rules.edges(rows))
    assert sorted((r.chunk, r.sink_line, r.source_line, r.edges) for r in paths.collect()) == [(1, 12, 10, 1), (2, 203, 200, 1)]
    whole = rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows))
    assert sorted((r.sink_line, r.source_line, r.edges) for r in whole.collect()) == [(12, 10, 1), (12, 200, 1), (203, 10, 2), (203, 200, 1)]


def test_paths_through_sanitizers_before_and_behind(spark):
    """The first sanitized assignment between the two lines, whichever comes first; one outside does not count."""
    text = ["s = escape(x)", "a = request.args.get('a')", "b = a", "c = quote(b)", "d = bleach(c)", "cursor.execute(d)", "e = request.args.get('e')", "f = escape(e)"]
    rows = spark.createDataFrame([(1, "a.py", "python", i + 1, t, True) for i, t in enumerate(text)], "pr_id int, path string, language string, line_no int, text string, changed boolean")
    got = {(r.sink_line, r.source_line): (r.edges, r.sanitizer) for r in rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows)).collect()}
    assert got == {(6, 2): (4, "Found 'quote' in assignment chain at line 4"), (6, 7): (1, None)}
    none = rules.taint_paths(rules.sinks(rows), rules.sources(rows).filter("false"), rules.edges(rows)).first()
    assert (none.source_line, none.source, none.edges, none.sanitizer) == (0, "<unknown>", 5, "Found 'escape' in assignment chain at line 1")
    plan = rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "edge_line" not in plan


def test_paths_of_diffs_without_headers(spark):
    prs = spark.createDataFrame([(1, "+++ b/x.py\n+a\n+++ b/y.py\n+++ b/x.py"), (2, "diff --git a/p b/p\n+++ b/q"), (3, ""), (4, "+++ b/")], "pr_id int, raw_diff string")
    assert sorted(tuple(r) for r in diffs.changed_paths(prs).collect()) == [(1, 0, "x.py"), (1, 1, "y.py"), (2, 0, "p")]


def test_digest_lines_are_there_where_they_apply(spark):
    import json

    rows = spark.createDataFrame([("o", "a", 5, 1, 1, 2, "CWE-89", None, 1), ("o", "b", 2, 0, 2, 0, None, None, 0)], "owner string, name string, total int, true_positives int, needs_review int, false_positives int, top_cwe string, top_severity string, sla_breaches int")
    one, two = exports.digest_payloads(rows).orderBy("name").collect()
    text = json.loads(one.slack)["blocks"][1]["text"]["text"].split("\n")
    assert text[1:] == ["• 1 true positive", "• 1 needs review", "• 2 false positives", "• Top weakness: CWE-89 (unknown)", f"{exports.ALARM} *1 CRITICAL/HIGH finding open for more than 7 days*"]
    assert len(json.loads(two.slack)["blocks"][1]["text"]["text"].split("\n")) == 4
    assert json.loads(one.discord)["embeds"][0]["color"] == 0xFF0000 and json.loads(two.discord)["embeds"][0]["color"] == 0x4ADE80
    assert [f["name"] for f in json.loads(one.teams)["sections"][0]["facts"]][3:] == ["Top weakness", "Overdue"] and json.loads(two.teams)["themeColor"] == "FBBF24"
