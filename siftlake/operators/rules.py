"""Data-driven detection of risky calls, user-controlled inputs and the assignments between them.

A line is tested against its language's rules by one ordered chain of patterns that Catalyst evaluates in the scan; no join of lines with rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    """Ordered (category, pattern) rules for sinks and sources, a pattern of calls that are safe, and further sanitizer names."""

    sinks: tuple[tuple[str, str], ...]
    sources: tuple[tuple[str, str], ...]
    safe: str
    sanitizers: tuple[str, ...] = ()


# The rule catalogue. Patterns are matched without regard to case; the first category in order wins.
SANITIZERS = ("escape", "sanitize", "validate", "parameterize", "quote", "htmlspecialchars", "bleach", "markupsafe", "encode", "strip_tags", "prepared_statement", "bindparam", "literal_column", "text(")
PYTHON = Language(
    sinks=(
        ("sql_exec", r"\b(execute|executemany|raw|extra)\s*\("),
        ("cmd_exec", r"\b(os\.system|subprocess\.(run|call|Popen|check_output)|popen)\s*\("),
        ("file_write", r"\.(write|writelines)\s*\("),
        ("deserialize", r"\b(pickle\.loads?|yaml\.load|marshal\.loads?|eval|exec)\s*\("),
        ("template_render", r"\b(render_template_string|Template\()\s*"),
    ),
    sources=(
        ("http_param", r"\b(request\.(args|form|json|data|params|get_json|values|files|GET|POST|PUT|PATCH|body)|flask\.request|bottle\.request\.params|self\.request\.(GET|POST|DATA|body))\b"),
        ("stdin", r"\binput\s*\("),
        ("env_var", r"\bos\.environ\b|os\.getenv\s*\("),
    ),
    safe=r"\.(filter|filter_by|where|select_related|prefetch_related|annotate|aggregate|order_by|values_list)\s*\(",
)
SCRIPT = Language(
    sinks=(
        ("sql_exec", r"\b(db|pool|client|connection|knex|sequelize)\s*\.\s*(query|execute|raw)\s*\("),
        ("cmd_exec", r"\b(exec|execSync|execFile|execFileSync|spawn|spawnSync)\s*\(|child_process\.(exec|spawn)\s*\("),
        ("xss", r"\.(innerHTML|outerHTML)\s*=|dangerouslySetInnerHTML|\bdocument\.write\s*\(|\$\(.*\)\.(html|append|prepend|after|before|replaceWith)\s*\("),
        ("eval_exec", r"\beval\s*\(|new\s+Function\s*\(|\bvm\.(runInNewContext|runInThisContext|Script)\s*\("),
        ("ssrf", r"\b(fetch|axios\.get|axios\.post|axios\.request|axios\.put|axios\.delete|http\.get|http\.request|https\.get|https\.request|got|superagent|request)\s*\("),
        ("file_ops", r"\b(fs\.readFile|fs\.readFileSync|fs\.writeFile|fs\.writeFileSync|fs\.open|fs\.unlink|fs\.rename|readFileSync|writeFileSync)\s*\("),
        ("template_render", r"\b(ejs\.render|ejs\.renderFile|Handlebars\.compile|nunjucks\.render|pug\.render|_.template|jade\.render)\s*\("),
        ("redirect", r"\bres\.(redirect|location)\s*\("),
    ),
    sources=(
        ("req_param", r"\b(req|request)\s*\.\s*(body|query|params|cookies|headers|files|file|fields|param|get|post)\b"),
        ("url_param", r"\b(new URLSearchParams|location\.search|location\.hash|window\.location|document\.location|searchParams\.get)\b"),
        ("env_var", r"\bprocess\.env\b"),
        ("event_input", r"\bevent\.(target|currentTarget)\.(value|checked|innerHTML)\b|\bdocument\.(getElementById|querySelector)\s*\([^)]+\)\.(value|innerHTML)\b"),
    ),
    safe=r"\b(prisma|db)\s*\.\s*\w+\s*\.\s*(findMany|findFirst|findUnique|findOne|create|update|upsert|delete|count)\s*\(|\.(findAll|findOne|findByPk|findById|findOneAndUpdate|countDocuments|aggregate)\s*\(|\b(res\.json|res\.send|res\.status|next)\s*\(",
    sanitizers=("domPurify", "dompurify", "sanitizeHtml", "sanitize_html", "encodeURIComponent", "encodeURI", "escape", "validator.escape", "xss(", "sanitize(", "htmlspecialchars", "entities.encode", "prepared", "parameterized", "placeholder", "bcrypt", "crypto.createHash"),
)
GO = Language(
    sinks=(
        ("sql_exec", r"\b(db|conn|tx|stmt|sqlDB|sqlConn)\.(Query|QueryRow|QueryContext|Exec|ExecContext|Prepare)\s*\("),
        ("cmd_exec", r"\bexec\.Command\s*\("),
        ("ssrf", r"\bhttp\.(Get|Post|Head|Do|NewRequest)\s*\("),
        ("file_ops", r"\b(os\.(Open|Create|OpenFile|Remove|Rename)|ioutil\.ReadFile|ioutil\.WriteFile|os\.ReadFile|os\.WriteFile)\s*\("),
        ("xss", r"\btemplate\.HTML\s*\(|\bfmt\.(Fprintf|Fprint|Fprintln)\s*\(.*ResponseWriter"),
        ("fmt_sprintf_sql", r'\bfmt\.Sprintf\s*\(\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)'),
    ),
    sources=(
        ("http_param", r"\b(r\.URL\.Query\(\)|r\.FormValue|r\.PostFormValue|r\.Header\.Get|r\.Body|c\.Param|c\.Query|c\.PostForm|chi\.URLParam)\s*\(?"),
        ("env_var", r"\bos\.Getenv\s*\("),
    ),
    safe=r"\bdb\.Prepare\s*\(|sqlx\.NamedQuery|squirrel\.",
)
JAVA = Language(
    sinks=(
        ("sql_exec", r"\.(executeQuery|executeUpdate|execute|addBatch)\s*\(|\bcreateQuery\s*\("),
        ("cmd_exec", r"\bRuntime\.getRuntime\(\)\.exec\s*\(|\bnew\s+ProcessBuilder\s*\("),
        ("deserialize", r"\bnew\s+ObjectInputStream\s*\(|\bXMLDecoder\s*\(|\bYaml\.load\s*\("),
        ("xss", r"response\.(getWriter|getOutputStream)\(\)\.(write|print|println)\s*\("),
        ("redirect", r"response\.sendRedirect\s*\("),
        ("xxe", r"\bDocumentBuilderFactory\.newInstance\s*\(|\bSAXParserFactory\.newInstance\s*\("),
    ),
    sources=(
        ("request_param", r"\brequest\.(getParameter|getAttribute|getHeader|getQueryString|getCookies|getInputStream|getReader)\s*\("),
        ("annotation_param", r"@\s*(RequestParam|PathVariable|RequestBody|RequestHeader|CookieValue)\b"),
    ),
    safe=r"\bPreparedStatement\b|\bparameterized\b|\bNamedParameterJdbcTemplate\b|\bHibernate\b|\bEntityManager\.createQuery\b",
)
RUBY = Language(
    sinks=(
        ("sql_exec", r"\b(find_by_sql|execute|exec_query|connection\.execute|where\s*\(\s*[\"'][^\"']*#\{)|\bActiveRecord::Base\.connection\.(execute|query)\s*\("),
        ("cmd_exec", r"\b(system|exec|spawn|IO\.popen|Open3\.popen|Kernel\.system)\s*\(|`[^`]+`|%x\{"),
        ("eval_exec", r"\b(eval|instance_eval|class_eval|module_eval)\s*\("),
        ("deserialize", r"\bMarshal\.load\s*\(|\bYAML\.load\s*\(|\bERB\.new\s*\("),
        ("file_ops", r"\b(File\.(open|read|write|delete|rename)|IO\.read|open\s*\()\s*"),
        ("redirect", r"\bredirect_to\s*\("),
        ("ssrf", r"\b(Net::HTTP\.(get|post|start)|Faraday\.new|HTTParty\.(get|post)|open-uri)\b|\bURI\.open\s*\("),
    ),
    sources=(
        ("http_param", r"\bparams\s*[\[:]|\brequest\.(params|query_string|body|env|GET|POST|headers)\b|\bcookies\s*\[|\bsession\s*\["),
        ("env_var", r"\bENV\s*\["),
    ),
    safe=r"\bwhere\s*\(\s*[\w:]+\s*:|\bsanitize\b|\bescape_sql\b|\bquote\s*\(",
)
PHP = Language(
    sinks=(
        ("sql_exec", r"\b(mysql_query|mysqli_query|pg_query|mssql_query|PDO::query|\$pdo\s*->\s*(query|exec|prepare)|\$db\s*->\s*(query|execute)|\$conn\s*->\s*query)\s*\("),
        ("cmd_exec", r"\b(exec|system|shell_exec|passthru|proc_open|popen|pcntl_exec)\s*\(|`[^`]+`"),
        ("file_include", r"\b(include|require|include_once|require_once)\s*[(\s]"),
        ("file_ops", r"\b(file_get_contents|file_put_contents|fopen|readfile|file\s*\()\s*\("),
        ("eval_exec", r"\beval\s*\("),
        ("xss", r"\b(echo|print|printf|vprintf|print_r|var_dump)\s+\$|\bheader\s*\(\s*[\"']Location:"),
        ("deserialize", r"\bunserialize\s*\("),
        ("redirect", r"\bheader\s*\(\s*[\"']Location:"),
    ),
    sources=(
        ("superglobal", r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER|SESSION)\b"),
        ("filter_input", r"\bfilter_input\s*\("),
    ),
    safe=r"\bprepare\s*\(|\bbindParam\b|\bbindValue\b|\bhtmlspecialchars\s*\(|\bhtmlentities\s*\(|\bintval\s*\(|\bfloatval\s*\(|\bstrip_tags\s*\(",
    sanitizers=("htmlspecialchars", "htmlentities", "strip_tags", "addslashes", "intval", "floatval", "filter_var", "prepared", "bindParam", "bindValue", "escape", "sanitize"),
)
CSHARP = Language(
    sinks=(
        ("sql_exec", r"\b(SqlCommand|OleDbCommand|OdbcCommand|NpgsqlCommand)\s*\(|\.(ExecuteReader|ExecuteNonQuery|ExecuteScalar|ExecuteQuery)\s*\(|\bFromSqlRaw\s*\(|\bDatabase\.ExecuteSqlRaw\s*\("),
        ("cmd_exec", r"\bProcess\.Start\s*\(|\bnew\s+ProcessStartInfo\s*\("),
        ("deserialize", r"\b(BinaryFormatter|NetDataContractSerializer|ObjectStateFormatter|LosFormatter|JavaScriptSerializer)\s*\(\s*\)\s*\.(Deserialize|Deserialize)\s*\(|\bXmlSerializer\b.*\.Deserialize\s*\(|\bJsonConvert\.DeserializeObject\s*\("),
        ("file_ops", r"\b(File\.(ReadAllText|WriteAllText|ReadAllBytes|WriteAllBytes|Open|Create|Delete)|new\s+FileStream\s*\(|Path\.Combine\s*\()\s*\("),
        ("xss", r"\bResponse\.Write\s*\(|\bHtml\.Raw\s*\(|\bMvcHtmlString\.Create\s*\("),
        ("redirect", r"\bResponse\.Redirect\s*\(|\breturn\s+Redirect\s*\(|\breturn\s+RedirectToAction\s*\("),
        ("xxe", r"\bnew\s+XmlDocument\s*\(\s*\)|\bXmlReader\.Create\s*\(|\bXDocument\.Load\s*\("),
        ("ssrf", r"\bnew\s+HttpClient\s*\(\s*\)|\bWebClient\.(DownloadString|DownloadData|OpenRead)\s*\(|\bHttpWebRequest\.Create\s*\("),
    ),
    sources=(
        ("request_param", r"\bRequest\.(QueryString|Form|Params|Headers|Cookies|Body|Path)\b|\bHttpContext\.Request\b|\bContext\.Request\b"),
        ("annotation_param", r"\[From(Query|Body|Route|Header|Form|Services)\]"),
        ("env_var", r"\bEnvironment\.GetEnvironmentVariable\s*\(|\bConfiguration\["),
    ),
    safe=r"\bSqlParameter\b|\bParameters\.AddWithValue\b|\bParameters\.Add\b|\bHtmlEncoder\.Encode\b|\bWebUtility\.HtmlEncode\b|\bEntityFramework\b|\bDbContext\b",
    sanitizers=("HtmlEncode", "HtmlEncoder", "WebUtility.HtmlEncode", "AntiXssEncoder", "SqlParameter", "Parameters.Add", "escape", "sanitize", "validate", "Regex.IsMatch"),
)
CATALOGUE = {"python": PYTHON, "javascript": SCRIPT, "typescript": SCRIPT, "go": GO, "java": JAVA, "ruby": RUBY, "php": PHP, "csharp": CSHARP}
# An assignment, the lines around a change in which inputs count, and the form of a suppressing comment (in `suppression`).
ASSIGNMENT = r"^\s*(\w+)\s*(?:\+?=|:=)\s*(.+)"
SOURCE_WINDOW = 50


def _first_rule(line: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(category, match) of the first rule that the line matches; null if none."""
    out = None
    for category, pattern in rules:
        found = F.struct(F.lit(category).alias("category"), F.regexp_extract(line, f"(?i){pattern}", 0).alias("match"))
        out = F.when(line.rlike(f"(?i){pattern}"), found) if out is None else out.when(line.rlike(f"(?i){pattern}"), found)
    return out


def by_language(language: Column, make) -> Column:
    """make(rules of a language) for the row's language; languages without rules use those of the first."""
    out = None
    for name, rules in CATALOGUE.items():
        out = F.when(language == name, make(rules)) if out is None else out.when(language == name, make(rules))
    return out.otherwise(make(PYTHON))


def _found(language: Column, line: Column, make) -> Column:
    """make(rules of the language, line) as an array of at most one value.

    A function of an array is evaluated as it stands, so that the patterns of all languages do not become code that is too large to compile."""
    return F.filter(F.transform(F.array(line), lambda x: by_language(language, lambda r: make(r, x))), lambda v: v.isNotNull())


def call_args(line: Column) -> Column:
    """Arguments of the first call: cut at commas, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.regexp_extract(line, r"\(([^)]*)\)", 1), ","), lambda a: F.trim(a)), lambda a: a != "")


def assigned_variable(line: Column) -> Column:
    name = F.regexp_extract(line, r"^\s*(\w+)\s*=", 1)
    return F.when(name == "", "<unknown>").otherwise(name)


def suppression(line: Column, token: str) -> Column:
    """struct(cwe, reason) of a suppressing comment that ends the line; null if there is none."""
    pattern = rf"(?i)(?:#|//)\s*{token}(?:\s*:\s*(CWE-\d+))?(?:\s+reason\s*:\s*(.+?))?$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(line, pattern, i)), F.lit(""))
    return F.when(line.rlike(pattern), F.struct(part(1).alias("cwe"), part(2).alias("reason")))


def _noted(rows: DataFrame, token: str) -> DataFrame:
    """Lines with the suppressing comment that holds for them; one on the line itself wins over one on the line above."""
    above = F.lag("text").over(W.partitionBy("pr_id", "path").orderBy("line_no"))
    return rows.withColumn("note", F.coalesce(suppression(F.col("text"), token), suppression(above, token)))


def _sinks(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    line = F.col("text")
    rule = _found(F.col("language"), line, lambda r, x: F.when(~x.rlike(f"(?i){r.safe}"), _first_rule(x, r.sinks)))
    rows = rows.select("*", F.explode(rule).alias("rule"))
    function = F.trim(F.regexp_replace(F.col("rule.match"), r"\(+$", ""))
    return rows.select(*keys, "language", "line_no", F.col("rule.category").alias("category"), function.alias("function"), F.array_join(call_args(line), "|").alias("args"), F.col("note").isNotNull().alias("suppressed"), F.col("note.cwe").alias("ignore_cwe"), F.col("note.reason").alias("ignore_reason"))


def sinks(rows: DataFrame, token: str = "siftlake-ignore") -> DataFrame:
    """Risky calls on changed lines. rows: pr_id, path, language, line_no, text, changed."""
    return _sinks(_noted(rows, token).filter("changed"), ("pr_id", "path"))


def _all_sources(rows: DataFrame) -> DataFrame:
    rows = rows.select("*", F.explode(_found(F.col("language"), F.col("text"), lambda r, x: _first_rule(x, r.sources))).alias("rule"))
    return rows.select("pr_id", "path", "line_no", F.col("rule.category").alias("category"), assigned_variable(F.col("text")).alias("variable"))


def sources(rows: DataFrame, window: int = SOURCE_WINDOW) -> DataFrame:
    """User-controlled inputs on lines within `window` of a changed one, by range frames over line numbers."""
    near = W.partitionBy("pr_id", "path").orderBy("line_no").rangeBetween(-window, window)
    return _all_sources(rows.withColumn("near", F.max(F.col("changed").cast("int")).over(near)).filter("near = 1"))


def chunk_sinks(rows: DataFrame, changed: DataFrame, token: str = "siftlake-ignore") -> DataFrame:
    """Risky calls on the changed lines of each chunk. rows: pr_id, path, language, line_no, text of whole files; changed: pr_id, chunk, path, line_no.

    Lines take their chunk in one equi-join; a file is never repeated for its chunks."""
    lines = changed.select("pr_id", "chunk", "path", "line_no").distinct()
    return _sinks(_noted(rows, token).join(lines, ["pr_id", "path", "line_no"]), ("pr_id", "chunk", "path"))


def chunk_sources(rows: DataFrame, changed: DataFrame, window: int = SOURCE_WINDOW) -> DataFrame:
    """User-controlled inputs within `window` of a changed line of a chunk, once for each such chunk.

    The changed lines of a chunk are merged into islands whose surroundings touch; islands meet inputs in an equi-join on blocks of lines, so an
    input meets those near it only, and each chunk at most once."""
    of_chunk = W.partitionBy("pr_id", "chunk", "path").orderBy("line_no")
    starts = F.coalesce(F.col("line_no") - F.lag("line_no").over(of_chunk) > 2 * window + 1, F.lit(True))
    lines = changed.select("pr_id", "chunk", "path", "line_no").withColumn("starts", starts.cast("int"))
    lines = lines.withColumn("island", F.sum("starts").over(of_chunk.rowsBetween(W.unboundedPreceding, W.currentRow)))
    islands = lines.groupBy("pr_id", "chunk", "path", "island").agg((F.min("line_no") - window).alias("low"), (F.max("line_no") + window).alias("high"))
    block = lambda line: F.floor(line / (2 * window + 1))
    blocks = islands.select("pr_id", "chunk", "path", "low", "high", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))).alias("block"))
    found = _all_sources(rows).withColumn("block", block(F.col("line_no")))
    met = found.join(blocks, ["pr_id", "path", "block"]).filter(F.col("line_no").between(F.col("low"), F.col("high")))
    return met.select("pr_id", "chunk", "path", "line_no", "category", "variable")


def edges(rows: DataFrame) -> DataFrame:
    """Assignments: pr_id, path, line_no, to_var, from_var."""
    hit = rows.filter(F.col("text").rlike(ASSIGNMENT))
    return hit.select("pr_id", "path", "line_no", F.regexp_extract("text", ASSIGNMENT, 1).alias("to_var"), F.trim(F.regexp_extract("text", ASSIGNMENT, 2)).alias("from_var"))


def _marks(found_sinks: DataFrame, found_sources: DataFrame, found_edges: DataFrame) -> DataFrame:
    """pr_id, path, line_no of sinks and sources, with the assignments of the file up to the line (upto) and before it (before), and the next sanitized one from
    there on (next: line_no, keyword) and in the whole file (first).

    Running counts and a pointer over the lines of a file, so two look-ups give what lies between two lines and no pair meets the assignments themselves."""
    files = found_sinks.select("pr_id", "path", "language").distinct()
    text = F.lower(F.concat("from_var", F.lit(" "), "to_var"))
    keywords = by_language(F.col("language"), lambda r: F.array(*[F.lit(k.lower()) for k in (*SANITIZERS, *r.sanitizers)]))
    keyword = F.get(F.filter(keywords, lambda k: F.contains(F.col("edge_text"), k)), F.lit(0))
    edges_ = found_edges.join(files, ["pr_id", "path"]).withColumn("edge_text", text).withColumn("keyword", keyword)
    edges_ = edges_.select("pr_id", "path", "line_no", F.lit(1).alias("edge"), F.when(F.col("keyword").isNotNull(), F.struct("line_no", "keyword")).alias("hit"), F.lit(False).alias("asked"))
    asked = [x.select("pr_id", "path", "line_no", F.lit(0).alias("edge"), F.lit(None).cast(edges_.schema["hit"].dataType).alias("hit"), F.lit(True).alias("asked")) for x in (found_sinks, found_sources)]
    lines = edges_.union(asked[0]).union(asked[1]).groupBy("pr_id", "path", "line_no").agg(F.sum("edge").alias("here"), F.min("hit").alias("hit"), F.max("asked").alias("asked"))
    of_file = W.partitionBy("pr_id", "path")
    lines = lines.withColumn("upto", F.sum("here").over(of_file.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    # the last one on the way up from the end of the file is the next one
    lines = lines.withColumn("next", F.last("hit", ignorenulls=True).over(of_file.orderBy(F.desc("line_no")).rowsBetween(W.unboundedPreceding, W.currentRow)))
    lines = lines.withColumn("first", F.min("hit").over(of_file))
    return lines.filter("asked").select("pr_id", "path", "line_no", "upto", (F.col("upto") - F.col("here")).alias("before"), "next", "first")


def taint_paths(found_sinks: DataFrame, found_sources: DataFrame, found_edges: DataFrame) -> DataFrame:
    """Each sink with each source of its file (or an unknown one at line 0), the number of assignments between them and the first sanitizer on the way.

    Where sinks and sources have a chunk, a sink meets the sources of its own chunk. A line of a file counts once in each chunk. An unknown source lies before the first line."""
    keys = ["pr_id", *(["chunk"] if "chunk" in found_sinks.columns else []), "path"]
    marks = _marks(found_sinks, found_sources, found_edges)
    look = lambda x, side: x.join(marks.select("pr_id", "path", F.col("line_no").alias(f"{side}_line"), *[F.col(c).alias(f"{side}_{c}") for c in ("upto", "before", "next", "first")]), ["pr_id", "path", f"{side}_line"])
    s = look(found_sinks.select(*keys, F.col("line_no").alias("sink_line"), F.col("category").alias("sink"), "suppressed"), "sink")
    o = look(found_sources.select(*keys, F.col("line_no").alias("source_line"), F.col("category").alias("source"), "variable"), "source")
    unknown = {"source_line": F.lit(0), "source": F.lit("<unknown>"), "variable": F.lit("<unknown>"), "source_before": F.lit(0)}
    pairs = s.join(o, keys, "left").withColumns({"known": F.col("source_line").isNotNull(), **{c: F.coalesce(c, v) for c, v in unknown.items()}})
    ahead = F.col("source_line") > F.col("sink_line")
    edges_ = F.when(ahead, F.col("source_upto") - F.col("sink_before")).otherwise(F.col("sink_upto") - F.col("source_before"))
    hit = F.when(ahead, F.col("sink_next")).otherwise(F.when(F.col("known"), F.col("source_next")).otherwise(F.col("sink_first")))
    pairs = pairs.withColumn("hit", F.when(hit["line_no"] <= F.greatest("sink_line", "source_line"), hit))
    said = F.concat(F.lit("Found '"), "hit.keyword", F.lit("' in assignment chain at line "), F.col("hit.line_no").cast("string"))
    return pairs.select(*keys, "sink_line", "sink", "suppressed", "source_line", "source", "variable", edges_.alias("edges"), F.col("hit").isNotNull().alias("sanitized"), F.when(F.col("hit").isNotNull(), said).alias("sanitizer"))


def primary_sinks(paths: DataFrame) -> DataFrame:
    """First sink line of each file (or of each file in a chunk), and whether all its paths are suppressed."""
    return paths.groupBy("pr_id", *(["chunk"] if "chunk" in paths.columns else []), "path").agg(F.min("sink_line").alias("sink_line"), F.bool_and("suppressed").alias("all_suppressed"), F.count(F.lit(1)).alias("paths"))
