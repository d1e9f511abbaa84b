"""Hand-made rows for what the test tables lack: ties, nulls, odd diffs, suppressing comments, repairs, state and streams."""

import datetime
import gzip
import base64
import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.functions import ranks
from siftlake.operators import classify, diffs, exports, imports, messages, rules, state, verdicts
from siftlake.plans import export_queries, finding_queries
from siftlake.sources import texts
from siftlake.streaming import findings


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path, decision, reason",
    [
        ("requirements.txt", "skip", "docs"),
        ("dist/package-lock.json", "skip", "generated"),
        ("web/package-lock.json", "dependency_only", "lockfile"),
        ("src/authors/x.py", "analyze", "application_code"),
        ("web/public/api-icon.svg", "skip", "static_asset"),
        ("lib/app.min.js", "skip", "minified"),
        ("src/tests/a.py", "deprioritize", "test_file"),
        ("", "skip", "empty_path"),
        ("   ", "skip", "empty_path"),
        (None, "skip", "empty_path"),
    ],
)
def test_classification(spark, path, decision, reason):
    row = classify.classify(spark.createDataFrame([(1, 1, path)], "pr_id bigint, ord int, path string")).first()
    assert (row.decision, row.reasons[0]) == (decision, reason)


def test_risk_is_capped_and_keywords_are_whole_tokens(spark):
    paths = ["src/auth/login/session/jwt/token.py", "src/pathology/x.py", "src/path/user_file.py"]
    rows = classify.classify(spark.createDataFrame([(1, i, p) for i, p in enumerate(paths)], "pr_id bigint, ord int, path string")).orderBy("ord").collect()
    assert [r.risk_score for r in rows] == [100, 25, 45]
    assert rows[2].reasons == ["application_code", "keyword:file", "keyword:path"]


DIFF = """text before the header
diff --git a/src/a b/x.py b/src/a b/x.py
--- a/src/a b/x.py
+++ b/src/a b/x.py
@@ -1,3 +10,4 @@
 same

-gone
+new one
\\ No newline at end of file
+++ plus plus
+after
diff --git a/bin b/bin
Binary files differ
"""


def test_odd_diff(spark):
    prs = spark.createDataFrame([(1, DIFF), (2, ""), (3, None), (4, "+no header\r\n")], "pr_id bigint, raw_diff string")
    rows = diffs.lines(prs)
    # the line that starts with three pluses is no added line, but it moves the number on
    assert sorted((r.pr_id, r.line_no, r.text) for r in diffs.added_lines(rows).collect()) == [(1, 12, "new one"), (1, 15, "after")]
    chunks = diffs.file_chunks(prs).orderBy("file_ord").collect()
    assert [(c.pr_id, c.n_lines) for c in chunks] == [(1, 11), (1, 2)] and chunks[1].path == "bin"
    assert {r.pr_id: r["mode"] for r in diffs.large(prs).collect()} == {1: "small", 2: "small", 3: "small", 4: "small"}


def test_hunks_are_packed_in_order_and_never_split(spark):
    sizes = [80, 60, 40, 130, 200, 1]
    text = "diff --git a/f b/f\n" + "".join("@@ -1 +1 @@\n" + " x\n" * (n - 1) for n in sizes)
    bins = diffs.hunk_bins(diffs.lines(spark.createDataFrame([(1, text)], "pr_id bigint, raw_diff string")), 150).orderBy("hunk").collect()
    assert [b.n_lines for b in bins] == sizes and [b.bin for b in bins] == [0, 0, 1, 2, 3, 4]


def code(spark, texts, language="python", changed=None):
    return spark.createDataFrame([(1, "f", language, i, t, changed is None or i in changed) for i, t in enumerate(texts, 1)], "pr_id bigint, path string, language string, line_no int, text string, changed boolean")


def test_suppression(spark):
    rows = code(spark, ["# siftlake-ignore: CWE-78 reason: above", "os.system(x)  # siftlake-ignore", "os.system(y)", "# siftlake-ignore", "z = 1", "os.system(z)", "eval(x)  # siftlake-ignore trailing words"])
    got = {r.line_no: (r.category, r.function, r.suppressed, r.ignore_cwe, r.ignore_reason) for r in rules.sinks(rows).collect()}
    assert got == {2: ("cmd_exec", "os.system", True, None, None), 3: ("cmd_exec", "os.system", True, None, None), 6: ("cmd_exec", "os.system", False, None, None), 7: ("deserialize", "eval", False, None, None)}


@pytest.mark.parametrize("language, line, category", [("javascript", "el.innerHTML = x", "xss"), ("go", 'q := fmt.Sprintf("SELECT %s", x)', "fmt_sprintf_sql"), ("java", "new ObjectInputStream(s)", "deserialize"), ("ruby", "system(x)", "cmd_exec"), ("php", "unserialize($x)", "deserialize"), ("csharp", "Response.Redirect(x)", "redirect"), ("cobol", "eval(x)", "deserialize")])
def test_sinks_by_language(spark, language, line, category):
    assert [r.category for r in rules.sinks(code(spark, [line], language)).collect()] == [category]


def test_paths_without_source_and_with_sanitizer(spark):
    rows = code(spark, ["u = input()", "v = escape(u)", "os.system(v)"])
    paths = rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows)).collect()
    assert [(p.source, p.variable, p.edges, p.sanitized, p.sanitizer) for p in paths] == [("stdin", "u", 2, True, "Found 'escape' in assignment chain at line 2")]
    rows = code(spark, ["os.system(v)"])
    assert [(p.source, p.source_line, p.edges, p.sanitized) for p in rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows)).collect()] == [("<unknown>", 0, 0, False)]


@pytest.mark.parametrize(
    "content, verdict, confidence",
    [
        ('{"verdict": "TRUE_POSITIVE", "severity": "HIGH", "confidence": 1.7}', "TRUE_POSITIVE", 1.0),
        ('```json\n{"verdict": "FALSE_POSITIVE", "severity": "LOW", "confidence": 0.5}\n```', "FALSE_POSITIVE", 0.5),
        ('{"verdict": "TRUE_POSITIVE", "severity": "HIGH", "confidence": "0.9"}', "TRUE_POSITIVE", 0.0),
        ('{"verdict": "TRUE_POSITIVE", "severity": "HIGH", "confidence": true}', "TRUE_POSITIVE", 1.0),
        ('{"verdict": "NEEDS_REVIEW", "title": "a \\d b \\username"}', "NEEDS_REVIEW", 0.0),
        ('{"verdict": "WHAT"}', "ERROR", 0.0),
        ('{"verdict": "TRUE_POSITIVE", "severity": "HIGH", "evidence": "run(f"echo {x}", shell=True)", "confidence": 0.8}', "TRUE_POSITIVE", 0.8),
        ('{"meta": {"confidence": "1"}, "verdict": "TRUE_POSITIVE", "severity": "HIGH", "confidence": 0.75}', "TRUE_POSITIVE", 0.75),
        ('[{"verdict": "TRUE_POSITIVE"}]', "ERROR", 0.0),
        ('{"verdict": "TRUE_POSITIVE", "severity": "BAD", "confidence": 1}', "ERROR", 0.0),
        ("garbage", "ERROR", 0.0),
        ("", "ERROR", 0.0),
        (None, "ERROR", 0.0),
    ],
)
def test_parsing(spark, content, verdict, confidence):
    row = verdicts.parse(spark.createDataFrame([(1, content)], "id int, content string")).first()
    assert (row.verdict, row.confidence) == (verdict, confidence)


@pytest.mark.parametrize("verdict, confidence, want", [("TRUE_POSITIVE", 0.7, "TRUE_POSITIVE"), ("TRUE_POSITIVE", 0.69, "NEEDS_REVIEW"), ("FALSE_POSITIVE", 0.5, "FALSE_POSITIVE"), ("FALSE_POSITIVE", 0.49, "NEEDS_REVIEW"), ("ERROR", 0.0, "ERROR")])
def test_calibration(spark, verdict, confidence, want):
    assert one(spark, verdicts.calibrate(F.lit(verdict), F.lit(confidence))) == want


def test_weakness_names_differ_by_place(spark):
    names = ["CWE-078", "CWE-000", "CWE-89", "N/A", None]
    rows = spark.createDataFrame([(n,) for n in names], "c string").select(ranks.ingest_cwe(F.col("c")).alias("i"), ranks.query_cwe(F.col("c")).alias("q")).collect()
    assert [(r.i, r.q) for r in rows] == [("CWE-78", "CWE-78"), ("CWE-0", "CWE-"), ("CWE-89", "CWE-89"), ("N/A", "N/A"), (None, "Unknown")]


def test_confidence_and_masks(spark):
    rows = spark.createDataFrame([(x,) for x in (None, float("nan"), -1.0, 1.7, float("inf"), 0.5)], "c double").select(ranks.clamp_confidence(F.col("c")).alias("x"))
    assert [r.x for r in rows.collect()] == [None, None, 0.0, 1.0, None, 0.5]
    assert one(spark, ranks.mask_last_segment(F.lit("https://h/a/secret?x=1"))) == "https://h/a/****"
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, ranks.relative_age(t("2024-01-01 00:00:00"), t("2024-01-02 01:00:00"))) == "1d ago"


def test_first_of_equals_is_primary(spark):
    rows = [(1, 0, "NEEDS_REVIEW", "LOW", 0.9), (1, 1, "TRUE_POSITIVE", "HIGH", 0.8), (1, 2, "TRUE_POSITIVE", "HIGH", 0.8), (1, 3, "TRUE_POSITIVE", "LOW", 1.0)]
    assert verdicts.primary(spark.createDataFrame(rows, "pr_id int, ord int, verdict string, severity string, confidence double")).first().ord == 1


def test_sarif_repeats(spark):
    rows = [(1, 0, "/p", 0, 0.8), (1, 1, "p", None, 0.9), (1, 2, "", 3, 0.7), (1, 3, None, 3, 0.7), (1, 4, "p", 5, 0.1)]
    df = spark.createDataFrame([(*r, "TRUE_POSITIVE", "HIGH", "CWE-1") for r in rows], "pr_id int, ord int, file_path string, line_number int, confidence double, verdict string, severity string, cwe_id string").withColumns({"title": F.lit("t"), "provider": F.lit(None).cast("string")})
    got = [(r.uri, r.line, r.confidence) for r in verdicts.sarif_results(df).orderBy("place").collect()]
    assert got == [("p", None, 0.9), (None, 3, 0.7), ("p", 5, 0.1)]


def test_quote_repair(spark):
    broken = '{"evidence": "run(f"echo {x}", shell=True)", "title": "t"}'
    fixed = one(spark, messages.repaired(F.lit(broken)))
    assert json.loads(fixed) == {"evidence": 'run(f"echo {x}", shell=True)', "title": "t"}
    for good in ('{"a": "b\\"c", "d": [1, "x"]}', "", "{}"):
        assert messages.repair_quotes(good) == good


def test_trimmed_messages_never_pass_their_size(spark):
    texts = [("head é" + messages.OPEN + middle + messages.CLOSE + " tail é end",) for middle in ("x" * 500, "é日" * 200, "")]
    sizes = range(1, 700, 41)
    rows = spark.createDataFrame(texts, "text string").select("text", *[messages.trimmed(F.col("text"), n).alias(f"m{n}") for n in sizes], messages.trimmed(F.col("text"), 0).alias("all")).collect()
    for r in rows:
        assert r["all"] == r.text
        for n in sizes:
            out = r[f"m{n}"]
            assert len(out.encode()) <= n and (n < 60 or out.endswith("end")) and (len(r.text.encode()) > n or out == r.text)
            # the end comes first, then the head, then a note and code
            if n > 200 and len(r.text.encode()) > n:
                assert out.startswith("head é" + messages.OPEN) and messages.TRIMMED in out
    assert one(spark, messages.trimmed(F.lit("z" * 300), 200)).startswith("z")


def test_cuts_at_bytes_keep_whole_characters(spark):
    text = "aé日😀b"
    for n in range(0, 12):
        first, last = one(spark, messages.first_bytes(F.lit(text), F.lit(n))), one(spark, messages.last_bytes(F.lit(text), F.lit(n)))
        assert first == text.encode()[:n].decode(errors="ignore") and last == text.encode()[max(0, 11 - n) :].decode(errors="ignore")


def test_adapted_and_encoded(spark):
    text = "a" + messages.OPEN + "c" * 5000 + messages.CLOSE + "b"
    out = one(spark, messages.adapted(F.lit(text), 100, 500))
    assert out.startswith("a" + messages.OPEN + "c" * 1400 + messages.TRUNCATED + messages.CLOSE) and out.endswith("b")
    assert one(spark, messages.adapted(F.lit(text), 100, 50_000)) == text
    assert gzip.decompress(base64.b64decode(one(spark, messages.gzip_base64(F.lit("é{}"))))).decode() == "é{}"


def test_function_bodies_and_names(spark):
    py = code(spark, ["from lib.db import run, other", "def run(x):", "    y = clean(x)", "", "    return y", "z = 1"])
    assert [(r.name, r.body) for r in messages.function_bodies(py).collect()] == [("run", "def run(x):\n    y = clean(x)\n\n    return y")]
    assert sorted((r.name, r.module) for r in messages.imported_names(py).collect()) == [("other", "lib.db"), ("run", "lib.db")]
    js = code(spark, ["const { a, b } = require('./lib/x')", "function go(x) {", "  if (x) { y() }", "}", "done()"], "javascript")
    assert [(r.name, r.body.count("\n")) for r in messages.function_bodies(js).collect()] == [("go", 2)]
    assert sorted((r.name, r.module) for r in messages.imported_names(js).collect()) == [("a", "./lib/x"), ("b", "./lib/x")]
    assert {r.name for r in messages.tainted_names(rules.edges(py), rules.sinks(code(spark, ["os.system(x)"]))).collect()} == {"clean", "system"}


def test_rate_limit_against_brute_force(spark):
    pick, start = random.Random(7), datetime.datetime(2024, 1, 1)
    rows = [(pick.randint(1, 3), i, start + datetime.timedelta(hours=pick.randint(0, 200)), pick.choice([2, 5])) for i in range(300)]
    limit = {r: next(x[3] for x in rows if x[0] == r) for r in (1, 2, 3)}
    rows = [(r, i, ts, limit[r]) for r, i, ts, _ in rows]
    got = {r.id: r.accepted for r in state.accept(spark.createDataFrame(rows, "repo_id bigint, id bigint, ts timestamp_ntz, daily_limit int")).collect()}
    kept: dict[int, list] = {1: [], 2: [], 3: []}
    for r, i, ts, most in sorted(rows, key=lambda x: (x[2], x[1])):
        recent = [x for x in kept[r] if x > ts - datetime.timedelta(hours=24)]
        assert got[i] == (len(recent) < most)
        if got[i]:
            kept[r].append(ts)


def test_one_bad_item_rejects_its_batch(spark):
    rows = [(1, "ERROR", "a"), (1, "TRUE_POSITIVE", "b"), (2, "ERROR", ""), (2, "ERROR", "a"), (3, "NO", "a"), (4, None, "a")]
    got = {r.batch: r.accepted for r in state.valid_batches(spark.createDataFrame(rows, "batch int, verdict string, commit_sha string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_messages_of_a_whole_change(spark):
    sf = "/root/testdata/sf0.001"
    from siftlake.plans import diff_queries as d

    rows = d.diff_lines(spark, sf)
    empty = finding_queries.taint(spark, sf).withColumn("sanitizer", F.lit(None).cast("string"))
    got = messages.user_message(empty, diffs.summary(rows), diffs.snippet(rows), diffs.context(diffs.added_lines(rows), d.contents(spark, sf)))
    assert got.filter(F.col("message").contains(messages.OPEN) & F.col("message").contains(messages.CLOSE)).count() == rows.select("pr_id").distinct().count()


@pytest.mark.parametrize("name", ["weekly", "sliding", "ingest"])
def test_streams_give_the_batch_answer(spark, tmp_path, name):
    source = "/root/testdata/sf0.001/events.parquet"
    make = {"weekly": findings.weekly_counts, "sliding": findings.sliding_counts, "ingest": findings.ingest}[name]
    batch = spark.read.parquet(source)
    # a last event far ahead moves the watermark past all windows
    last = batch.orderBy("ts").limit(1).withColumns({"ts": F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"), "event_id": F.lit(10**9).cast("long")})
    batch.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    last.write.parquet(f"{tmp_path}/in/2")
    for part in ("1", "2"):
        stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in/{part}*")
        if name == "ingest" or part == "1":
            findings.run_available(make(stream), f"{tmp_path}/out{part}", f"{tmp_path}/checkpoint{part}")
    both = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    findings.run_available(make(both), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    want = {tuple(r) for r in make(batch).collect()}
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert want <= got if name == "ingest" else want == got


def test_whole_sarif_document(spark):
    rows = spark.createDataFrame([(1, 1, "CWE-89", "a.py", 3, "error", "HIGH", 0.9, "TRUE_POSITIVE", 'say "x"', None), (1, 2, "Siftlake/Finding", None, None, "none", "N/A", 0.6, "NEEDS_REVIEW", "t", "p")], "pr_id int, place int, rule string, uri string, line int, level string, severity string, confidence double, verdict string, title string, provider string")
    runs = spark.createDataFrame([(1, "o/n", "abcdef123456")], "pr_id int, repo string, commit_sha string")
    doc = json.loads(exports.sarif_document(rows, runs).first().sarif)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CWE-89", "Siftlake/Finding"]
    rule, other = run["tool"]["driver"]["rules"]
    assert rule["name"] == "SQLInjection" and rule["helpUri"].endswith("/89.html") and "help" not in other
    first, second = run["results"]
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.py", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 3}} and first["message"]["text"].startswith('say "x". Confidence: 90%.')
    assert second["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "." and second["properties"]["provider"] == "p" and run["automationDetails"]["id"] == "siftlake/o/n/abcdef1"


def test_text_functions_hold_one_text_at_a_time():
    """A batch's texts do not all become Python objects beside the batch."""
    calls, most = [], 0

    def make(x):
        nonlocal most
        calls.append(len(x))
        most = max(most, tracemalloc.get_traced_memory()[0])
        return "r"

    values = pa.array(["x" * 100_000 + str(i) for i in range(200)] + [None], pa.string())
    tracemalloc.start()
    try:
        got = messages._one_by_one(values, make)
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == ["r"] * 200 + [None] and most < 1_000_000 and len(calls) == 200


def test_diff_files_and_contents(spark, tmp_path):
    (tmp_path / "a.diff").write_bytes(b"diff --git a/x b/x\n+\xff\n")
    (tmp_path / "blank.diff").write_text(" \n")
    assert [(r.pr_id, r.raw_diff) for r in texts.diff_files(spark, str(tmp_path)).collect()] == [("a", "diff --git a/x b/x\n+\ufffd\n")]
    answers = spark.createDataFrame([(1, "a", "file", 200, "aG\nk="), (1, "b", "dir", 200, "aGk="), (1, "c", "file", 404, "aGk="), (1, "d", "file", 200, "!"), (1, "e", "file", 200, None)], "pr_id int, path string, kind string, status int, content string")
    assert {r.path: r.text for r in texts.file_contents(answers).collect()} == {"a": "hi", "b": None, "c": None, "d": None, "e": None}


def test_diffs_are_packed_many_to_a_file(spark, tmp_path, monkeypatch):
    """Packs give what loose files give, and the query writes no file for each diff."""
    loose = [("d/a.b.diff", b"diff --git a/x b/x\n+\xff\x1e"), ("d/blank.diff", b" \n"), ("none.diff", None), ("bare", b"+\r\n")]
    (tmp_path / "loose" / "d").mkdir(parents=True)
    for name, content in loose:
        (tmp_path / "loose" / name).write_bytes(content or b"")
    texts.pack(spark.createDataFrame(loose, "path string, content binary"), f"{tmp_path}/packs")
    rows = lambda x: sorted((r.pr_id, r.raw_diff) for r in x.collect())
    assert rows(texts.unpacked(spark, f"{tmp_path}/packs")) == rows(texts.diff_files(spark, f"{tmp_path}/loose")) == [("a.b", "diff --git a/x b/x\n+\ufffd\x1e"), ("bare", "+\r\n")]
    monkeypatch.setattr(findings, "folder", lambda s: f"{tmp_path}/shared/new")
    n = export_queries.QUERIES["diff_source"](spark, "/root/testdata/sf0.001").count()
    assert n >= 200 and len(list((tmp_path / "shared").rglob("part-*"))) < 20


def test_import_paths(spark):
    for module, folder, want in ((".util", "src/", "src/util.py"), ("pkg.a", "src/", "pkg/a.py"), ("..up", "src/", None), (".", "src/", None), (".u", "", "u.py")):
        assert one(spark, imports.python_path(F.lit(module), F.lit(folder))) == want
    for module, folder, want in (("./a", "w/", "w/a.js"), ("../a.ts", "w/x/", "w/a.ts"), ("../../a", "w/", None), ("./b/../c", "", "c.js")):
        assert one(spark, imports.script_path(F.lit(module), F.lit(folder))) == want


def test_imported_definitions(spark):
    targets = spark.createDataFrame([(1, "src/m.py", "clean", "src/util.py")], "pr_id int, path string, name string, target string")
    contents = spark.createDataFrame([(1, "src/util.py", "def clean(x):\n    return x\n\ny = 1"), (1, "src/other.py", "def clean(x):\n    pass")], "pr_id int, path string, text string")
    rows = imports.definitions(targets, contents, messages.function_bodies).collect()
    assert [(r.name, r.target, r.body.rstrip()) for r in rows] == [("clean", "src/util.py", "def clean(x):\n    return x")]


def test_rate_limit_state_goes_on_between_batches(spark, tmp_path):
    """Two files in two batches give what one batch gives; a request of another repository at the end lets the watermark pass them."""
    start = datetime.datetime(2024, 1, 1)
    for i, rows in enumerate([[(1, 1, 0), (1, 2, 10)], [(1, 3, 20), (1, 4, 3_600_000_000)], [(2, 5, 10**12)]]):
        spark.createDataFrame([(r, n, start + datetime.timedelta(microseconds=at)) for r, n, at in rows], "repo_id bigint, id bigint, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("repo_id bigint, id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    with findings.rocks(spark):
        got = findings.all_now(spark, findings.accepted(stream, limit=2, hours=1, late="1 hour"), "append")
        assert sorted((r.id, r.accepted) for r in got.collect()) == [(1, True), (2, True), (3, False), (4, True)]


def test_comments_parse_answers_once(spark):
    """The worst verdict is the one of `primary`, and its comment and summary read the verdicts once."""
    pick = random.Random(5)
    rows = [(p, o, pick.choice(verdicts.VERDICTS), pick.choice((*verdicts.SEVERITIES, None)), pick.choice((0.5, 0.9, None))) for p in range(40) for o in range(pick.randint(1, 6))]
    df = spark.createDataFrame(rows, "pr_id int, ord int, verdict string, severity string, confidence double")
    want = {r.pr_id: r.ord for r in verdicts.primary(df).collect()}
    got = verdicts.worst(df).collect()
    assert {r.pr_id: r.ord for r in got} == want
    assert all(r.n == sum(x[0] == r.pr_id for x in rows) and r.tp == sum(x[0] == r.pr_id and x[2] == "TRUE_POSITIVE" for x in rows) for r in got)
    for name, most in (("summary_comment", 2), ("step_summary", 2), ("sarif_export", 4)):
        plan = export_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.lower().replace("_", "").count("parsejson") <= most, name


def test_answers_meet_the_parser_once_for_each_stage(spark):
    rows = spark.createDataFrame([(1, "{}"), (2, "no json")], "id int, content string")
    plan = verdicts.parse(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") in (1, 2), plan


def test_heads_of_changes_are_their_summary_and_snippet(spark):
    """One pass over whole diffs gives what rows of lines give: line ends of all kinds, changes without shown lines or without lines, one change in two rows."""
    pick = random.Random(6)
    made = [pick.choice(["\n", "\r\n", "\r"]).join(pick.choice(["+a", "-b", "+++ b/x", "--- a/x", "@@ -1 +1 @@", "diff --git a/x b/x", "diffs", " c", ""]) for _ in range(pick.randrange(1, 30))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(made)] + [(100, None), (101, ""), (102, " c\n d"), (103, "\n")]
    prs = spark.createDataFrame(rows, "pr_id bigint, raw_diff string")
    lines = diffs.lines(prs)
    for limit in (3, 200):
        want = diffs.summary(lines).join(diffs.snippet(lines, limit), "pr_id", "left").select("pr_id", "files", "insertions", "deletions", F.coalesce("snippet", F.lit("")).alias("snippet"))
        got = diffs.heads(prs, limit)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    twice = spark.createDataFrame([(7, "+a\n b\n+c"), (7, " x\n-y")], "pr_id bigint, raw_diff string")
    assert [tuple(r) for r in diffs.heads(twice, 2).collect()] == [(7, 0, 2, 1, "+a\n-y")]


def test_prompts_split_their_diffs_twice_and_find_marks_once(spark):
    """Of the diffs' lines only the added ones need rows; a message is searched once for each mark, however many parts are cut."""
    sf = "/root/testdata/sf0.001"
    plan = finding_queries.prompts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    old = messages.user_message(finding_queries.taint(spark, sf), diffs.summary(finding_queries.d.diff_lines(spark, sf)), diffs.snippet(finding_queries.d.diff_lines(spark, sf)), diffs.context(diffs.added_lines(finding_queries.d.diff_lines(spark, sf)), finding_queries.d.contents(spark, sf)))
    assert plan.count("posexplode(") < old._jdf.queryExecution().optimizedPlan().toString().count("posexplode(")
    text = spark.range(1).select(F.col("id").cast("string").alias("t")).select(messages.trimmed(F.col("t"), 200).alias("m"))
    assert text._jdf.queryExecution().optimizedPlan().toString().count("instr(") == 2
    assert sorted(finding_queries.prompts(spark, sf).collect()) == sorted(old.collect())


def test_context_makes_no_rows_for_lines_before_the_first(spark):
    contents = spark.createDataFrame([(1, "a", "x\ny\nz\nw"), (2, "a", "q\nr"), (3, "a", "q")], "pr_id bigint, path string, text string")
    added = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 0), (3, "a", -1), (3, "a", -9)], "pr_id bigint, path string, line_no bigint")
    got = diffs.context(added, contents, 1, 9)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1, "   1 | x"), (1, "a", 2, "   2 | y"), (1, "a", 3, "   3 | z"), (2, "a", 1, "   1 | q")]
    assert "sequence(greatest(" in got._jdf.queryExecution().optimizedPlan().toString()
