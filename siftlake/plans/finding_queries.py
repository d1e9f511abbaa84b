"""Queries over verdicts, rule hits and state folds, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import classify, diffs, messages, rules, state
from siftlake.operators import verdicts as v
from siftlake.plans import diff_queries as d
from siftlake.sources.domain import AS_OF, Tables, with_views
from siftlake.streaming import findings

FENCE = "```"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model responses made of scans: fenced, unreadable, with unescaped quotes, of unknown verdict, and with confidences outside 0..1, in quotes, or also inside another object."""
    s = Tables(spark, sf_dir).scans
    i, k = F.col("id"), F.col("id") % 97
    verdict = F.when(i % 50 == 0, "MAYBE").otherwise(F.col("verdict"))
    title = F.when(i % 41 == 0, F.concat(F.lit('say "'), "title", F.lit(' now" end'))).otherwise(F.col("title"))
    share = F.concat((k * 3 - 50).cast("string"), F.lit("e-2"))
    share = F.when(i % 43 == 0, F.concat(F.lit('"'), share, F.lit('"'))).otherwise(share)
    text = lambda name, value: F.concat(F.lit(f', "{name}": "'), value, F.lit('"'))
    more = F.concat(text("title", title), text("summary", F.concat(F.lit("seen "), k.cast("string"))), F.when(i % 3 == 0, text("remediation", F.lit("bind"))).otherwise(""), F.when(i % 4 == 0, text("evidence", F.lit("x = y"))).otherwise(""), F.when(i % 5 == 0, F.lit(', "sanitizer_found": true, "sanitizer_description": "esc"')).otherwise(""))
    meta = F.when(i % 47 == 0, F.lit('"meta": {"confidence": "1"}, ')).otherwise("")
    body = F.concat(F.lit("{"), meta, F.lit('"verdict": "'), verdict, F.lit('", "severity": "'), F.col("severity"), F.lit('", "cwe_id": "'), F.coalesce("cwe_id", F.lit("N/A")), F.lit('", "confidence": '), share, more, F.lit("}"))
    content = F.when(i % 37 == 0, F.concat(F.lit("no json {"), body)).when(i % 2 == 0, F.concat(F.lit(f"{FENCE}json\n"), body, F.lit(f"\n{FENCE}"))).otherwise(body)
    path = F.element_at(F.array(F.lit("/src/a.py"), F.lit("src/a.py"), F.lit(""), F.lit(None)), (i % 4 + 1).cast("int"))
    return s.select(i.alias("id"), F.floor(i / 10).alias("pr_id"), (i % 10).cast("int").alias("ord"), content.alias("content"), path.alias("file_path"), (i % 3).cast("int").alias("line_number"), "provider", "pr_number", "commit_sha")


RESPONSES_SQL = f"""SELECT id, CAST(floor(id / 10) AS BIGINT) AS pr_id, CAST(id % 10 AS INTEGER) AS ord, ['/src/a.py', 'src/a.py', '', NULL][id % 4 + 1] AS file_path, CAST(id % 3 AS INTEGER) AS line_number, provider, pr_number, commit_sha,
CASE WHEN id % 37 = 0 THEN 'no json {{' || body WHEN id % 2 = 0 THEN '{FENCE}json' || chr(10) || body || chr(10) || '{FENCE}' ELSE body END AS content
FROM (SELECT *, '{{' || CASE WHEN id % 47 = 0 THEN '"meta": {{"confidence": "1"}}, ' ELSE '' END || '"verdict": "' || CASE WHEN id % 50 = 0 THEN 'MAYBE' ELSE verdict END || '", "severity": "' || severity || '", "cwe_id": "' || coalesce(cwe_id, 'N/A') || '", "confidence": ' || CASE WHEN id % 43 = 0 THEN '"' ELSE '' END || CAST(id % 97 * 3 - 50 AS VARCHAR) || 'e-2' || CASE WHEN id % 43 = 0 THEN '"' ELSE '' END
  || ', "title": "' || CASE WHEN id % 41 = 0 THEN 'say "' || title || ' now" end' ELSE title END || '", "summary": "seen ' || CAST(id % 97 AS VARCHAR) || '"' || CASE WHEN id % 3 = 0 THEN ', "remediation": "bind"' ELSE '' END || CASE WHEN id % 4 = 0 THEN ', "evidence": "x = y"' ELSE '' END || CASE WHEN id % 5 = 0 THEN ', "sanitizer_found": true, "sanitizer_description": "esc"' ELSE '' END || '}}' AS body FROM scans)"""
_TEXTS_SQL = ", ".join(f"CASE WHEN ok THEN json_extract_string(j, '$.{t}') END AS {t}" for t in v.TEXTS if t not in ("title", "summary"))
PARSED_SQL = f"""SELECT id, pr_id, ord, file_path, line_number, provider, pr_number, commit_sha, CASE WHEN ok THEN verdict ELSE 'ERROR' END AS verdict, CASE WHEN ok THEN severity ELSE 'N/A' END AS severity, CASE WHEN ok THEN cwe_id ELSE 'N/A' END AS cwe_id, CASE WHEN ok THEN confidence ELSE 0.0 END AS confidence, CASE WHEN ok THEN title ELSE 'Analysis failed' END AS title,
CASE WHEN ok THEN json_extract_string(j, '$.summary') ELSE 'The answer could not be read.' END AS summary, ok AND coalesce(CAST(json_extract_string(j, '$.sanitizer_found') AS BOOLEAN), false) AS sanitizer_found, {_TEXTS_SQL}
FROM (SELECT *, json_extract_string(j, '$.verdict') AS verdict, json_extract_string(j, '$.severity') AS severity, json_extract_string(j, '$.cwe_id') AS cwe_id, CASE WHEN json_type(j, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN greatest(0.0, least(1.0, CAST(json_extract_string(j, '$.confidence') AS DOUBLE))) ELSE 0.0 END AS confidence, json_extract_string(j, '$.title') AS title, coalesce(json_extract_string(j, '$.verdict') IN {v.VERDICTS}, false) AS ok
FROM (SELECT *, CASE WHEN json_valid(t) THEN t END AS j FROM (SELECT *, replace(replace(regexp_replace(regexp_replace(content, '^{FENCE}json' || chr(10), ''), chr(10) || '{FENCE}$', ''), 'say "', 'say \\"'), ' now" end', ' now\\" end') AS t FROM responses)))"""
CALIBRATED = "CASE WHEN confidence < 0.5 AND first IN ('TRUE_POSITIVE', 'FALSE_POSITIVE') THEN 'NEEDS_REVIEW' ELSE first END"
VERDICTS_SQL = f"SELECT * EXCLUDE (verdict, first), {CALIBRATED} AS verdict FROM (SELECT *, CASE WHEN verdict = 'TRUE_POSITIVE' AND confidence < 0.7 THEN 'NEEDS_REVIEW' ELSE verdict END AS first FROM parsed)"
SEV = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"
VER = "CASE verdict WHEN 'TRUE_POSITIVE' THEN 3 WHEN 'NEEDS_REVIEW' THEN 2 WHEN 'ERROR' THEN 1 ELSE 0 END"
LEVEL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' WHEN severity = 'LOW' THEN 'note' ELSE 'none' END"
INGEST_SEV = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 WHEN 'INFO' THEN 0 ELSE -1 END"
SARIF_SQL = f"SELECT pr_id, CAST(row_number() OVER (PARTITION BY pr_id ORDER BY first_ord) AS INTEGER) AS place, rule, uri, line, level, severity, confidence, verdict, title, provider FROM (SELECT pr_id, rule, uri, line, min(ord) OVER g AS first_ord, {LEVEL} AS level, severity, confidence, verdict, title, provider, row_number() OVER (PARTITION BY pr_id, rule, uri, line ORDER BY confidence DESC, ord) AS best FROM (SELECT *, CASE WHEN cwe_id IN ('', 'N/A') THEN '{v.DEFAULT_RULE}' ELSE cwe_id END AS rule, nullif(ltrim(coalesce(file_path, ''), '/'), '') AS uri, CASE WHEN line_number > 0 THEN line_number END AS line FROM verdicts WHERE verdict IN ('TRUE_POSITIVE', 'NEEDS_REVIEW')) WINDOW g AS (PARTITION BY pr_id, rule, uri, line)) WHERE best = 1"


def parsed(s, f):
    return v.parse(responses(s, f))


def calibrated(s, f):
    return parsed(s, f).withColumn("verdict", v.calibrate(F.col("verdict"), F.col("confidence")))


def with_verdicts(body: str) -> str:
    return with_views(body, responses=RESPONSES_SQL, parsed=PARSED_SQL, verdicts=VERDICTS_SQL, sarif=SARIF_SQL)


#: Lines of code by event: inputs, assignments, sanitizers, risky calls, safe calls and suppressing comments of each language.
CODE = (
    "user = request.args.get('u')", "q = \"SELECT \" + user", "clean = escape(q)", "cursor.execute(q, user )  # siftlake-ignore: CWE-89 reason: test only", "rows = db.filter(name=user).execute(q)", "os.system(user)", "x += 1",
    "const id = req.query.id", "el.innerHTML = id", "db.query(`x`, id)", "// siftlake-ignore", "fetch(url)", "name := r.FormValue(\"n\")", "exec.Command(name)", "String p = request.getParameter(\"p\");", "stmt.executeQuery(p);",
    "uid = params[:id]", "system(uid)", "$id = $_GET['id'];", "echo $id;", "var f = Request.QueryString[\"f\"];", "Response.Redirect(f);", "return 1", "",
)
PATHS = ("src/a.py", "src/b.js", "src/c.go", "src/D.java", "src/e.rb", "src/f.php", "src/g.cs")
LANGS = ("python", "javascript", "go", "java", "ruby", "php", "csharp")


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    pr = F.floor(i / 140)
    return e.select(pr.alias("pr_id"), pick(PATHS, pr % 7).alias("path"), pick(LANGS, pr % 7).alias("language"), (i % 140 + 1).cast("int").alias("line_no"), pick(CODE, F.floor(i * 7 / 3) % len(CODE)).alias("text"), (i % 140 < 30).alias("changed"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CODE_SQL = f"SELECT event_id // 140 AS pr_id, {list(PATHS)}[event_id // 140 % 7 + 1] AS path, {list(LANGS)}[event_id // 140 % 7 + 1] AS language, CAST(event_id % 140 + 1 AS INTEGER) AS line_no, [{', '.join(map(_quoted, CODE))}][event_id * 7 // 3 % {len(CODE)} + 1] AS text, event_id % 140 < 30 AS changed FROM events"


def _chain(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN language = '{lang}' AND regexp_matches(text, {_quoted('(?i)' + p)}) THEN '{c}'" for lang in LANGS for c, p in getattr(rules.CATALOGUE[lang], kind)) + " END"


SAFE = " OR ".join(f"(language = '{lang}' AND regexp_matches(text, {_quoted('(?i)' + rules.CATALOGUE[lang].safe)}))" for lang in LANGS)
NOTE = r"(?i)(?:#|//)\s*siftlake-ignore(?:\s*:\s*(CWE-\d+))?(?:\s+reason\s*:\s*(.+?))?$"
SINKS_SQL = f"SELECT * FROM (SELECT *, {_chain('sinks')} AS category, coalesce(regexp_matches(text, {_quoted(NOTE)}), false) OR coalesce(regexp_matches(above, {_quoted(NOTE)}), false) AS suppressed FROM (SELECT *, lag(text) OVER (PARTITION BY pr_id, path ORDER BY line_no) AS above FROM code)) WHERE changed AND category IS NOT NULL AND NOT ({SAFE})"
SOURCES_SQL = f"SELECT *, CASE WHEN regexp_matches(text, '^\\s*(\\w+)\\s*=') THEN regexp_extract(text, '^\\s*(\\w+)\\s*=', 1) ELSE '<unknown>' END AS variable FROM (SELECT *, {_chain('sources')} AS category FROM code) c WHERE category IS NOT NULL AND EXISTS (SELECT 1 FROM code d WHERE d.pr_id = c.pr_id AND d.path = c.path AND d.changed AND abs(d.line_no - c.line_no) <= 50)"
EDGES_SQL = f"SELECT pr_id, path, line_no, regexp_extract(text, {_quoted(rules.ASSIGNMENT)}, 1) AS to_var, trim(regexp_extract(text, {_quoted(rules.ASSIGNMENT)}, 2)) AS from_var FROM code WHERE regexp_matches(text, {_quoted(rules.ASSIGNMENT)})"
HAS_KEYWORD = "CASE " + " ".join(f"WHEN p.language = '{lang}' THEN list_has_any([true], list_transform({[k.lower() for k in (*rules.SANITIZERS, *rules.CATALOGUE[lang].sanitizers)]}, lambda k: contains(lower(e.from_var || ' ' || e.to_var), k)))" for lang in LANGS) + " END"
PATHS_SQL = f"""SELECT p.pr_id, p.path, p.sink_line, p.sink, p.suppressed, p.source_line, p.source, p.variable, count(e.line_no) AS edges, coalesce(bool_or({HAS_KEYWORD}), false) AS sanitized
FROM (SELECT DISTINCT s.pr_id, s.path, s.language, s.line_no AS sink_line, s.category AS sink, s.suppressed, coalesce(o.line_no, 0) AS source_line, coalesce(o.category, '<unknown>') AS source, coalesce(o.variable, '<unknown>') AS variable FROM sinks s LEFT JOIN sources o ON o.pr_id = s.pr_id AND o.path = s.path) p
LEFT JOIN edges e ON e.pr_id = p.pr_id AND e.path = p.path AND e.line_no BETWEEN greatest(1, least(p.sink_line, p.source_line)) AND greatest(p.sink_line, p.source_line) GROUP BY ALL"""


def with_code(body: str, **more: str) -> str:
    parts = {"code": CODE_SQL, "sinks": SINKS_SQL, "sources": SOURCES_SQL, "edges": EDGES_SQL, "taint": PATHS_SQL, **more}
    return f"WITH {', '.join(f'{k} AS ({x})' for k, x in parts.items())} {body}"


def taint(s, f):
    rows = code(s, f)
    return rules.taint_paths(rules.sinks(rows), rules.sources(rows), rules.edges(rows))


#: Lines that one chunk of the changes below holds at most, and chunks of one change.
CHUNK_LINES, CHUNKS = 25, 5


def code_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of each file of code: a hunk for the first nine of every twenty lines, with added, kept and removed ones."""
    rows = code(spark, sf_dir).withColumn("at", (F.col("line_no") - 1) % 20).filter("at < 9")
    start = F.when(F.col("at") == 0, F.concat(F.lit("@@ -1,9 +"), F.col("line_no").cast("string"), F.lit(",9 @@\n"))).otherwise("")
    gone = F.when(F.col("at") == 4, "-gone\n").otherwise("")
    text = F.concat(start, gone, F.when(F.col("at") % 4 == 2, " ").otherwise("+"), "text")
    whole = rows.groupBy("pr_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("text")))), lambda x: x["text"]), "\n").alias("hunks"))
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    return whole.select("pr_id", F.concat(head, "hunks").alias("raw_diff"))


def chunk_changes(s, f):
    """The added lines of each chunk of each change of code."""
    return diffs.added_lines(diffs.chunk_lines(diffs.lines(code_diffs(s, f)), CHUNKS, CHUNK_LINES), "chunk")


def chunk_taint(s, f):
    rows, changed = code(s, f), chunk_changes(s, f)
    return rules.taint_paths(rules.chunk_sinks(rows, changed), rules.chunk_sources(rows, changed), rules.edges(rows))


#: The same without the text of a diff: hunks of nine lines and a removed one, packed by a running fill.
CHUNK_CHANGES_SQL = f"""SELECT c.pr_id, chunk, c.path, line_no FROM code c JOIN (WITH RECURSIVE h AS (SELECT pr_id, path, hunk, row_number() OVER (PARTITION BY pr_id ORDER BY hunk) AS nth, n FROM (SELECT pr_id, path, (line_no - 1) // 20 AS hunk, count(*) + 1 + count_if((line_no - 1) % 20 = 4) AS n FROM code WHERE (line_no - 1) % 20 < 9 GROUP BY ALL)),
w AS (SELECT *, n AS filled, 1 AS chunk FROM h WHERE nth = 1 UNION ALL SELECT h.*, CASE WHEN w.filled + h.n > {CHUNK_LINES} THEN h.n ELSE w.filled + h.n END, CASE WHEN w.filled + h.n > {CHUNK_LINES} THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN h ON h.pr_id = w.pr_id AND h.nth = w.nth + 1)
SELECT pr_id, hunk, chunk FROM w WHERE chunk <= {CHUNKS}) k ON k.pr_id = c.pr_id AND k.hunk = (line_no - 1) // 20 WHERE (line_no - 1) % 20 < 9 AND (line_no - 1) % 20 NOT IN (2, 6)"""
CHUNK_SINKS_SQL = SINKS_SQL.replace(" WHERE changed AND", " JOIN changes USING (pr_id, path, line_no) WHERE")
CHUNK_SOURCES_SQL = f"SELECT DISTINCT h.chunk, o.* FROM (SELECT pr_id, path, line_no, {_chain('sources')} AS category, CASE WHEN regexp_matches(text, '^\\s*(\\w+)\\s*=') THEN regexp_extract(text, '^\\s*(\\w+)\\s*=', 1) ELSE '<unknown>' END AS variable FROM code) o JOIN changes h ON h.pr_id = o.pr_id AND h.path = o.path AND abs(h.line_no - o.line_no) <= 50 WHERE category IS NOT NULL"
CHUNK_TAINT_SQL = f"""SELECT p.pr_id, p.chunk, p.path, p.sink_line, p.sink, p.suppressed, p.source_line, p.source, p.variable, count(e.line_no) AS edges, coalesce(bool_or({HAS_KEYWORD}), false) AS sanitized
FROM (SELECT s.pr_id, s.chunk, s.path, s.language, s.line_no AS sink_line, s.category AS sink, s.suppressed, coalesce(o.line_no, 0) AS source_line, coalesce(o.category, '<unknown>') AS source, coalesce(o.variable, '<unknown>') AS variable FROM chunk_sinks s LEFT JOIN chunk_sources o ON o.pr_id = s.pr_id AND o.chunk = s.chunk AND o.path = s.path) p
LEFT JOIN edges e ON e.pr_id = p.pr_id AND e.path = p.path AND e.line_no BETWEEN greatest(1, least(p.sink_line, p.source_line)) AND greatest(p.sink_line, p.source_line) GROUP BY ALL"""


def with_chunks(body: str) -> str:
    return with_code(body, changes=CHUNK_CHANGES_SQL, chunk_sinks=CHUNK_SINKS_SQL, chunk_sources=CHUNK_SOURCES_SQL, chunk_taint=CHUNK_TAINT_SQL)


def requests(s, f):
    t = Tables(s, f)
    return t.audit.select("repo_id", "id", F.col("created_at").alias("ts")).join(t.repos.select(F.col("id").alias("repo_id"), F.lit(3).alias("daily_limit")), "repo_id")


def stream_weekly(s, f):
    """The weekly counts as a stream over all that is there."""
    return findings.all_now(s, findings.weekly_counts(findings.arriving(s, f)), "complete")


#: Of each repository's key requests, those that find fewer than three accepted ones in the 24 hours before.
ACCEPTS_SQL = with_views("""SELECT repo_id, id, accepted FROM (WITH RECURSIVE q AS (SELECT a.repo_id, a.id, epoch_us(a.created_at) AS us, row_number() OVER (PARTITION BY a.repo_id ORDER BY a.created_at, a.id) AS n FROM audit a JOIN repos r ON r.id = a.repo_id),
w AS (SELECT repo_id, id, n, true AS accepted, [us] AS kept FROM q WHERE n = 1 UNION ALL SELECT repo_id, id, n, len(kept) < 3, CASE WHEN len(kept) < 3 THEN list_append(kept, us) ELSE kept END
  FROM (SELECT q.repo_id, q.id, q.n, q.us, list_filter(w.kept, lambda x: x > q.us - 86400000000) AS kept FROM w JOIN q ON q.repo_id = w.repo_id AND q.n = w.n + 1)) SELECT * FROM w)""")


def prompts(s, f):
    flows = taint(s, f)
    return messages.user_message(flows, diffs.heads(d.diffs(s, f)), None, diffs.context(diffs.added_lines(d.diff_lines(s, f)), d.contents(s, f)))


def indented_code(s, f):
    """Code whose lines are the bodies of Python functions, one for every twenty lines."""
    head = F.col("line_no") % 20 == 1
    return code(s, f).withColumn("text", F.when(head, F.lit("def helper(x):")).otherwise(F.concat(F.lit("    "), "text"))).withColumn("language", F.lit("python"))


def comments(s, f):
    selection = d.selected(s, f)
    return messages.coverage_comment(classify.coverage(selection, d.calls(s, f)), classify.skip_histogram(selection))


def unrepaired(s, f):
    """Responses whose title quotes code without escapes."""
    return responses(s, f).filter("id % 41 <> 0").select("id", F.regexp_replace("content", '"title": "(t[0-9])"', '"title": "f\\("$1 {x}", shell=True\\)"').alias("content"))


def cut_messages(s, f, how):
    """Documents as the code of messages: between the marks, without marks (every fifth), or with marks the wrong way round (every seventh), cut by how(text)."""
    i, a, b = F.col("doc_id"), F.lit(messages.OPEN), F.lit(messages.CLOSE)
    text = F.coalesce("text", F.lit(""))
    made = F.when(i % 5 == 0, text).when(i % 7 == 0, F.concat(b, text, a)).otherwise(F.concat(F.lit("Head of "), i.cast("string"), F.lit("\n"), a, text, b, F.lit("\ntail")))
    return s.read.parquet(f"{f}/documents.parquet").select("doc_id", F.md5(how(made)).alias("message"))


MESSAGES_SQL = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN x WHEN doc_id % 7 = 0 THEN '{messages.CLOSE}' || x || '{messages.OPEN}' ELSE 'Head of ' || doc_id || chr(10) || '{messages.OPEN}' || x || '{messages.CLOSE}' || chr(10) || 'tail' END AS m FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)"
_feeds = lambda t: t.replace("\n", "' || chr(10) || '")
#: Of messages past the window of 700 tokens with a prompt of 1000 characters, the code's first 1300 characters are left.
ADAPT_SQL = f"""SELECT doc_id, md5(CASE WHEN (length(m) + 1000) // 4 > 700 AND a > 0 AND b > 0 THEN substr(m, 1, a + {len(messages.OPEN)} - 1) || substr(m, a + {len(messages.OPEN)}, greatest(0, least(1300, b - a - {len(messages.OPEN)}))) || '{_feeds(messages.TRUNCATED)}' || substr(m, b) ELSE m END) AS message
FROM (SELECT *, instr(m, '{messages.OPEN}') AS a, instr(m, '{messages.CLOSE}') AS b FROM ({MESSAGES_SQL}))"""
TRIM_BYTES = 400


def _first_sql(text: str, size: str) -> str:
    """The longest start within a size in bytes, by trying all lengths."""
    return f"CASE WHEN strlen({text}) <= {size} THEN {text} ELSE list_max(list_filter(list_transform(range({TRIM_BYTES + 1}), lambda n: substr({text}, 1, n)), lambda x: strlen(x) <= {size})) END"


def _last_sql(text: str, size: str) -> str:
    return f"reverse({_first_sql(f'reverse({text})', size)})"


_note = f"'{_feeds(messages.TRIMMED)}'"
_half = (TRIM_BYTES - len(messages.TRIMMED.encode())) // 2
TRIM_SQL = f"""SELECT doc_id, md5(CASE WHEN strlen(m) <= {TRIM_BYTES} THEN m WHEN a > 0 AND b >= a THEN {_first_sql("head", "for_head")} || CASE WHEN room > 0 THEN {_first_sql("code", "room")} || {_note} ELSE '' END || tail ELSE {_first_sql("m", str(_half))} || {_note} || {_last_sql("m", str(_half))} END) AS message
FROM (SELECT *, least(strlen(head), {TRIM_BYTES} - strlen(tail)) AS for_head, {TRIM_BYTES - len(messages.TRIMMED.encode())} - strlen(head) - strlen(tail) AS room FROM (SELECT *, substr(m, 1, a + {len(messages.OPEN) - 1}) AS head, substr(m, a + {len(messages.OPEN)}, greatest(0, b - a - {len(messages.OPEN)})) AS code, substr(m, b) AS tail
  FROM (SELECT *, instr(m, '{messages.OPEN}') AS a, instr(m, '{messages.CLOSE}') AS b FROM ({MESSAGES_SQL}))))"""
_matched = "CASE " + " ".join(f"WHEN language = '{lang}' AND regexp_matches(text, {_quoted('(?i)' + p)}) THEN regexp_extract(text, {_quoted('(?i)' + p)}, 0)" for lang in LANGS for _, p in rules.CATALOGUE[lang].sinks) + " END"
NAMES_SQL = with_code(f"""SELECT DISTINCT pr_id, path, name FROM (
  SELECT pr_id, path, unnest(regexp_extract_all(from_var || ' ' || to_var, '\\b([a-zA-Z_]\\w*)\\s*\\(', 1)) AS name FROM edges
  UNION ALL SELECT pr_id, path, '#' || regexp_extract(trim(string_split(trim(regexp_replace({_matched}, '\\(+$', '')), '(')[1]), '[^.]*$', 0) FROM sinks) t(pr_id, path, found), (SELECT ltrim(found, '#') AS name) n
WHERE length(name) > 2 AND (found LIKE '#%' OR name NOT IN {messages.SKIPPED_NAMES})""")
BODIES_SQL = with_code("SELECT pr_id, path, 'helper' AS name, CAST((line_no - 1) // 20 * 20 + 1 AS INTEGER) AS head, md5(string_agg(CASE WHEN line_no % 20 = 1 THEN 'def helper(x):' ELSE '    ' || text END, chr(10) ORDER BY line_no)) AS body FROM code GROUP BY ALL")
_keywords = "CASE " + " ".join(f"WHEN p.language = '{lang}' THEN list_filter({[k.lower() for k in (*rules.SANITIZERS, *rules.CATALOGUE[lang].sanitizers)]}, lambda k: contains(lower(e.from_var || ' ' || e.to_var), k))[1]" for lang in LANGS) + " END"
#: Each path with its first sanitized assignment, by a join of pairs with all assignments between them.
FLOWS_SQL = f"""SELECT pr_id, string_agg('DATA FLOW PATH ' || nth || ':' || chr(10) || '  SOURCE  [' || source || '] @ ' || path || ':' || source_line || chr(10) || '  SINK    [' || sink || '] @ ' || path || ':' || sink_line || chr(10) || '  ' || note, chr(10) ORDER BY nth) AS flows
FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY path, sink_line, source_line) AS nth, CASE WHEN hit IS NULL THEN '[NO SANITIZER DETECTED]' ELSE '[SANITIZED: Found ' || chr(39) || hit[2] || chr(39) || ' in assignment chain at line ' || hit[1] || ']' END AS note FROM (
  SELECT pr_id, path, sink_line, sink, source_line, source, min(CASE WHEN word IS NOT NULL THEN (line, word) END) AS hit FROM (SELECT p.*, e.line_no AS line, {_keywords} AS word FROM (SELECT t.*, c.language FROM taint t JOIN (SELECT DISTINCT pr_id, path, language FROM code) c USING (pr_id, path)) p
  LEFT JOIN edges e ON e.pr_id = p.pr_id AND e.path = p.path AND e.line_no BETWEEN greatest(1, least(p.sink_line, p.source_line)) AND greatest(p.sink_line, p.source_line)) GROUP BY ALL)) GROUP BY pr_id"""
PROMPT_SQL = with_code(
    f"""SELECT s.pr_id, md5('DIFF SUMMARY: ' || files || ' files, +' || insertions || ' -' || deletions || chr(10) || chr(10) || coalesce(flows, 'No explicit data-flow paths extracted. Analyze the diff heuristically.') || chr(10) || '{messages.OPEN}' || chr(10) || coalesce(snippet, '') || chr(10) || coalesce(around, '') || chr(10) || '{messages.CLOSE}' || chr(10) || 'Return the JSON verdict schema exactly.') AS message
FROM (SELECT pr_id, count(*) FILTER (WHERE line LIKE 'diff --git %') AS files, count(*) FILTER (WHERE line LIKE '+%' AND NOT line LIKE '+++%') AS insertions, count(*) FILTER (WHERE line LIKE '-%' AND NOT line LIKE '---%') AS deletions FROM lines GROUP BY pr_id) s
LEFT JOIN flows USING (pr_id)
LEFT JOIN (SELECT pr_id, string_agg(line, chr(10) ORDER BY pos) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY pos) AS nth FROM lines WHERE line LIKE '+%' OR line LIKE '-%' OR line LIKE '@@%' OR line LIKE 'diff%') WHERE nth <= {diffs.SNIPPET_LINES} GROUP BY pr_id) p USING (pr_id)
LEFT JOIN (SELECT pr_id, string_agg(text, chr(10) ORDER BY nth) AS around FROM (SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY line_no) AS nth, lpad(CAST(line_no AS VARCHAR), CAST(greatest(4, length(CAST(line_no AS VARCHAR))) AS INTEGER), ' ') || ' | ' || x AS text
  FROM (SELECT doc_id AS pr_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents) t WHERE NOT (x = '' AND line_no = n) AND EXISTS (SELECT 1 FROM added a WHERE a.pr_id = t.pr_id AND a.path = 'src/f0.py' AND abs(a.line_no - t.line_no) <= 25)) WHERE nth <= 120 GROUP BY pr_id) c USING (pr_id)""",
    flows=FLOWS_SQL,
    diffs=d.DIFF_SQL,
    lines=d.LINES_SQL,
    added=d.ADDED_ONLY,
)
COMMENT_SQL = d.with_paths("""SELECT c.pr_id, '- Files changed: **' || total || '**' || chr(10) || '- Files analyzed: **' || analyzed || '**' || chr(10) || '- Files skipped: **' || (total - analyzed) || '**' || chr(10) || '- Skip reasons:' || chr(10) || coalesce(skips, '  - (none)') AS comment
FROM (SELECT pr_id, count(*) AS total, count(*) FILTER (WHERE selected AND EXISTS (SELECT 1 FROM calls k WHERE k.pr_id = x.pr_id AND k.place = x.place)) AS analyzed FROM selected x GROUP BY pr_id) c LEFT JOIN (SELECT pr_id, string_agg('  - `' || bucket || '`: ' || n, chr(10) ORDER BY bucket) AS skips FROM (SELECT pr_id, bucket, count(*) AS n FROM selected WHERE bucket IS NOT NULL GROUP BY ALL) GROUP BY pr_id) h ON h.pr_id = c.pr_id""")
NOW = f"TIMESTAMP '{AS_OF}'"
T = lambda f: lambda s, d: f(Tables(s, d))

#: name: (function of session and folder, SQL or None)
FINDINGS = {
    "verdict_parse": (lambda s, f: parsed(s, f).drop("content", "file_path", "line_number", "provider", "pr_number", "commit_sha"), with_verdicts("SELECT * EXCLUDE (file_path, line_number, provider, pr_number, commit_sha) FROM parsed")),
    "verdict_calibrate": (lambda s, f: calibrated(s, f).select("id", "verdict"), with_verdicts("SELECT id, verdict FROM verdicts")),
    "verdict_primary": (lambda s, f: v.primary(calibrated(s, f)), with_verdicts(f"SELECT pr_id, ord, verdict, severity, confidence, errors, actionable FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY {VER} DESC, {SEV} DESC, confidence DESC, ord) AS nth, count(*) FILTER (WHERE verdict = 'ERROR') OVER (PARTITION BY pr_id) AS errors, count(*) FILTER (WHERE verdict IN ('TRUE_POSITIVE', 'NEEDS_REVIEW')) OVER (PARTITION BY pr_id) AS actionable FROM verdicts) WHERE nth = 1")),
    "inline_select": (lambda s, f: v.inline(calibrated(s, f), 2), with_verdicts(f"SELECT pr_id, ord, CAST(place AS INTEGER) AS place, greatest(0, n - 2) AS overflow FROM (SELECT pr_id, ord, row_number() OVER (PARTITION BY pr_id ORDER BY {SEV} DESC, ord) AS place, count(*) OVER (PARTITION BY pr_id) AS n FROM verdicts WHERE verdict IN ('TRUE_POSITIVE', 'NEEDS_REVIEW') AND coalesce(line_number, 0) <> 0 AND coalesce(file_path, '') <> '') WHERE place <= 2")),
    "sarif_results": (lambda s, f: v.sarif_results(calibrated(s, f)), with_verdicts("SELECT * FROM sarif")),
    "sarif_rules": (lambda s, f: v.sarif_rules(v.sarif_results(calibrated(s, f))), with_verdicts("SELECT pr_id, rule, min(place) AS place, arg_min(level, place) AS level, count(*) AS results FROM sarif GROUP BY pr_id, rule")),
    "sinks": (lambda s, f: rules.sinks(code(s, f)).select("pr_id", "path", "line_no", "category"), with_code("SELECT pr_id, path, line_no, category FROM sinks")),
    "suppressed": (lambda s, f: rules.sinks(code(s, f)).filter("suppressed").select("pr_id", "path", "line_no"), with_code("SELECT pr_id, path, line_no FROM sinks WHERE suppressed")),
    "call_args": (lambda s, f: code(s, f).select("text", F.array_join(rules.call_args(F.col("text")), "|").alias("args")).distinct(), with_code("SELECT DISTINCT text, array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '\\(([^)]*)\\)', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS args FROM code")),
    "sources": (lambda s, f: rules.sources(code(s, f)), with_code("SELECT pr_id, path, line_no, category, variable FROM sources")),
    "edges": (lambda s, f: rules.edges(code(s, f)), with_code("SELECT * FROM edges")),
    "taint_paths": (lambda s, f: taint(s, f).drop("sanitizer"), with_code("SELECT * FROM taint")),
    "chunk_changes": (lambda s, f: chunk_changes(s, f).drop("text"), with_chunks("SELECT * FROM changes")),
    "chunk_taint": (lambda s, f: chunk_taint(s, f).drop("sanitizer"), with_chunks("SELECT * FROM chunk_taint")),
    "chunk_primary_sink": (lambda s, f: rules.primary_sinks(chunk_taint(s, f)), with_chunks("SELECT pr_id, chunk, path, min(sink_line) AS sink_line, bool_and(suppressed) AS all_suppressed, count(*) AS paths FROM chunk_taint GROUP BY ALL")),
    "sanitized": (lambda s, f: taint(s, f).filter("sanitized").select("pr_id", "sink_line", "source_line"), with_code("SELECT pr_id, sink_line, source_line FROM taint WHERE sanitized")),
    "primary_sink": (lambda s, f: rules.primary_sinks(taint(s, f)), with_code("SELECT pr_id, path, min(sink_line) AS sink_line, bool_and(suppressed) AS all_suppressed, count(*) AS paths FROM taint GROUP BY pr_id, path")),
    "feedback_latest": (T(state.latest_feedback), with_views("SELECT scan_id, github_id, correct_verdict, reason FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, github_id ORDER BY created_at DESC, correct_verdict) AS n FROM feedback) WHERE n = 1")),
    "ignore_derived": (T(state.derived_ignore_rules), with_views(f"SELECT s.repo_id, CASE WHEN s.cwe_id <> 'N/A' THEN s.cwe_id END AS cwe_id, CASE WHEN s.cwe_id IS NULL OR s.cwe_id = 'N/A' THEN s.title END AS title_keyword, coalesce(f.reason, '{state.FEEDBACK_REASON}') AS reason FROM feedback f JOIN scans s ON s.id = f.scan_id WHERE s.verdict = 'TRUE_POSITIVE' AND f.correct_verdict = 'FALSE_POSITIVE'")),
    "retention_survivors": (T(state.retained_scans), with_views(f"SELECT s.id, s.repo_id FROM scans s LEFT JOIN repos r ON r.id = s.repo_id LEFT JOIN users u ON u.id = r.user_id WHERE NOT coalesce(s.created_at < {NOW} - coalesce(u.scan_retention_days, 90) * INTERVAL 1 DAY, false)")),
    "account_delete_survivors": (
        T(state.account_survivors),
        with_views(
            "SELECT 'users' AS name, count(*) AS n FROM users WHERE github_id <> 1004 UNION ALL SELECT 'repos', count(*) FROM left_repos UNION ALL SELECT 'scans', count(*) FROM left_scans UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE github_id <> 1004 AND scan_id IN (SELECT id FROM left_scans) UNION ALL SELECT 'audit', count(*) FROM audit WHERE github_id <> 1004",
            left_repos="SELECT * FROM repos WHERE user_id IS NULL OR user_id <> (SELECT id FROM users WHERE github_id = 1004)",
            left_scans="SELECT * FROM scans WHERE repo_id IN (SELECT id FROM left_repos)",
        ),
    ),
    "user_upsert": (
        T(state.upserted_users),
        with_views("SELECT coalesce(u.github_id, n.github_id) AS github_id, coalesce(n.name, u.username) AS username, coalesce(n.mail, u.email) AS email, u.username IS NULL AS is_new FROM users u FULL JOIN (SELECT github_id + id % 3 AS github_id, arg_max('login_' || id % 5, id) AS name, arg_max(CASE WHEN id % 4 = 0 THEN 'm' || id || '@example.org' END, CASE WHEN id % 4 = 0 THEN id END) AS mail FROM audit GROUP BY 1) n ON n.github_id = u.github_id"),
    ),
    "installation_latest": (T(state.latest_installations), with_views("SELECT installation_id, CASE WHEN removal THEN created_at END AS deleted_at FROM (SELECT github_id + 4000 AS installation_id, id % 4 = 0 AS removal, created_at, row_number() OVER (PARTITION BY github_id ORDER BY created_at DESC, id DESC) AS n FROM audit) WHERE n = 1")),
    "repo_latest": (T(state.latest_repos), with_views("SELECT r.id AS repo_id, coalesce(n.new_limit, r.custom_daily_limit) AS custom_daily_limit FROM repos r LEFT JOIN (SELECT repo_id, arg_max(CAST(id % 50 AS INTEGER), id) AS new_limit FROM audit WHERE id % 5 <> 0 AND id IN (SELECT max(id) FROM audit GROUP BY repo_id) GROUP BY repo_id) n ON n.repo_id = r.id")),
    "settings_update": (T(state.clamped_settings), with_views("SELECT id, CAST(greatest(1, least(365, floor(confidence * 500 - 20))) AS BIGINT) AS days FROM scans")),
    "ingest_normalize": (
        T(state.normalized),
        with_views("SELECT id, regexp_replace(cwe_id, '^CWE-0+([0-9]+)', 'CWE-\\1') AS cwe_id, greatest(0.0, least(1.0, confidence * 3 - 1)) AS confidence, substr(commit_sha, 1, 7) AS sha7, CASE WHEN confidence >= 0.9 THEN 'Very High' WHEN confidence >= 0.7 THEN 'High' WHEN confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS label, CASE WHEN verdict = 'TRUE_POSITIVE' AND confidence >= 0.8 THEN 'failure' WHEN verdict IN ('TRUE_POSITIVE', 'NEEDS_REVIEW') THEN 'pending' WHEN verdict = 'FALSE_POSITIVE' THEN 'success' ELSE 'error' END AS status FROM scans"),
    ),
    "batch_accept": (
        lambda s, f: state.valid_batches(Tables(s, f).scans.select(F.floor(F.col("id") / 20).alias("batch"), F.when(F.col("id") % 97 == 0, "WHAT").otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("id") % 89 != 0, F.col("commit_sha")).alias("commit_sha"))),
        with_views("SELECT id // 20 AS batch, NOT bool_or(id % 97 = 0 OR id % 89 = 0) AS accepted, count(*) AS items FROM scans GROUP BY 1"),
    ),
    "notify_primary": (T(state.notify_primary), with_views(f"SELECT repo_id, pr_number, id FROM (SELECT s.repo_id, s.pr_number, s.id, row_number() OVER (PARTITION BY s.repo_id, s.pr_number ORDER BY {INGEST_SEV} DESC, s.id) AS n FROM scans s JOIN repos r ON r.id = s.repo_id WHERE s.verdict NOT IN ('FALSE_POSITIVE', 'ERROR') AND (s.verdict <> 'NEEDS_REVIEW' OR r.notify_on_needs_review) AND {INGEST_SEV} >= CASE r.notify_min_severity WHEN 'HIGH' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END) WHERE n = 1")),
    "batch_primary": (T(state.batch_primary), with_views(f"SELECT repo_id, pr_number, id FROM (SELECT repo_id, pr_number, id, row_number() OVER (PARTITION BY repo_id, pr_number ORDER BY {INGEST_SEV} DESC, id) AS n FROM scans) WHERE n = 1")),
    "cache_lookup": (
        lambda s, f: Tables(s, f).scans.select(F.substring(F.sha2(F.concat("title", F.lit(":"), "commit_sha"), 256), 1, 16).alias("key"), (F.col("created_at") > F.expr(f"timestamp_ntz '{AS_OF}' - INTERVAL 7 DAYS")).alias("fresh")),
        with_views(f"SELECT substr(sha256(title || ':' || commit_sha), 1, 16) AS key, created_at > {NOW} - INTERVAL 7 DAY AS fresh FROM scans"),
    ),
    "comment_text": (comments, COMMENT_SQL),
    "prompt_text": (lambda s, f: prompts(s, f).withColumn("message", F.md5("message")), PROMPT_SQL),
    "prompt_trim": (lambda s, f: prompts(s, f).select("pr_id", messages.trimmed(F.col("message"), 2000).alias("message")), None),
    "verdict_repair": (
        lambda s, f: unrepaired(s, f).select("id", messages.repaired(v.strip_fence(F.col("content"))).alias("content")),
        with_verdicts(f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(content, '^{FENCE}json' || chr(10), ''), chr(10) || '{FENCE}$', ''), '"title": "(t[0-9])"', '"title": "f(\\\\"\\1 {{x}}\\\\", shell=True)"') AS content FROM responses WHERE id % 41 <> 0"""),
    ),
    "import_names": (lambda s, f: messages.tainted_names(rules.edges(code(s, f)), rules.sinks(code(s, f))), NAMES_SQL),
    "message_adapt": (lambda s, f: cut_messages(s, f, lambda m: messages.adapted(m, 1000, 700)), ADAPT_SQL),
    "message_trim": (lambda s, f: cut_messages(s, f, lambda m: messages.trimmed(m, TRIM_BYTES)), TRIM_SQL),
    "import_bodies": (lambda s, f: messages.function_bodies(indented_code(s, f)).withColumn("body", F.md5("body")), BODIES_SQL),
    "rate_limit_accepts": (lambda s, f: state.accept(requests(s, f)), ACCEPTS_SQL),
    "stream_rate_limit": (lambda s, f: findings.accepted_now(s, f, limit=3), ACCEPTS_SQL),
    "weekly_events": (
        lambda s, f: findings.weekly_counts(s.read.parquet(f"{f}/events.parquet")),
        "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL",
    ),
    "stream_weekly": (stream_weekly, "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stream_ingest": (
        lambda s, f: findings.all_now(s, findings.ingest(findings.arriving(s, f)), "append").select("event_id", "confidence", "event_type"),
        "SELECT event_id, greatest(0.0, least(1.0, value / 100)) AS confidence, event_type FROM events",
    ),
    "stream_quota": (
        lambda s, f: findings.all_now(s, findings.sliding_counts(findings.arriving(s, f)), "complete"),
        "SELECT until, user_id, count(*) AS n FROM (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 24 HOUR, INTERVAL 6 HOUR)) AS until FROM events) GROUP BY ALL",
    ),
    "stream_feedback": (
        lambda s, f: findings.folded_now(s, f),
        "SELECT event_id % 50 AS scan_id, user_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events GROUP BY ALL",
    ),
}

QUERIES = {name: f for name, (f, _) in FINDINGS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in FINDINGS.items() if sql}
