"""The queries opN_<name> of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle, raking
from .common import LOWER, SPACES, UPPER, WORD, fold_of, table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import maxent_lm

    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.join(table(spark, sf_dir, "documents"))


def _links_sql(width: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of `width`-word shingles are alike, by a join of all shingles."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) END AS sh FROM w),
c AS (SELECT doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), '|')) END AS node FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * shared >= {percent} * (a.n + b.n - shared)),
r AS (WITH RECURSIVE reach AS (SELECT doc_id, doc_id AS other FROM c UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON l.x = reach.other) SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, c.n AS n_shingles, r.component_id, {columns}CASE WHEN c.node IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY c.node) END AS n_equal FROM c JOIN r USING (doc_id)
"""


OP2_SQL = _links_sql(5, 80, "")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_crf

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.score(docs, model)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raking.mix(table(spark, sf_dir, "documents"))
    mixed = {c: F.col(f"_mix_{c}") for c in ("source", "lang", "topic", "n_tokens", "weight", "expected", "probability", "kept", "copies")}
    return out.select("doc_id", *[(F.round(v, 6) if c in ("weight", "expected", "probability") else v).alias(c) for c, v in mixed.items()])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(join(own).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search

    rows = table(spark, sf_dir, "embeddings").filter(topk_search.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk_search.integer_vector(F.col("embedding")).alias("vector"))
    return topk_search.top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY v) AS INTEGER) AS place FROM v
), s AS (
  SELECT a.vec_id AS query_id, a.place AS query_row, b.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM n a JOIN n b ON a.vec_id % 100 = 0 AND (b.vec_id IS NULL OR a.vec_id <> b.vec_id OR a.place <> b.place)
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query_row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score, query_row FROM s)
SELECT query_id, rank, vec_id, score, query_row FROM r WHERE rank <= 10
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def _mark_sql(text: str) -> str:
    """A fingerprint as DuckDB SQL."""
    pieces = f"regexp_extract_all(p, '{merkle.PIECE}')"
    paragraph = f"md5(array_to_string(list_transform({pieces}, lambda x: md5(x)), '')) || '=' || array_to_string(list_transform({pieces}, lambda x: substr(md5(x), 1, {merkle.LEAF})), ',')"
    marked = f"regexp_replace(array_to_string(list_transform(list_transform(string_split({text}, chr(10)), lambda p: {paragraph}), lambda q: q || CASE WHEN substr(q, 1, 1) < '{chr(ord(merkle.BREAKS[-1]) + 1)}' THEN '|' ELSE ';' END), ''), '[;|]$', '')"
    sections = f"list_transform(string_split({marked}, '|'), lambda s: struct_pack(digest := md5(regexp_replace(s, '=[^;]*', '', 'g')), leaves := regexp_replace(s, '[0-9a-f]{{32}}=', '', 'g')))"
    return f"(SELECT sha256(array_to_string(list_transform(s, lambda t: t.digest), '')) || ':' || array_to_string(list_transform(s, lambda t: substr(t.digest, 1, {merkle.SECTION}) || '=' || t.leaves), '|') FROM (SELECT {sections} AS s))"


def _like_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split_regex(substr({m}, 66), '[=|;,]'), lambda z: length(z) = {merkle.LEAF}))" for m in (a, b))
    return f"round(CASE WHEN {a} = {b} THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END, 9)"


def _cut_sql(mark: str) -> str:
    return f"list_transform(string_split(substr({mark}, 66), '|'), lambda s: substr(s, 1, {merkle.SECTION}))"


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER w, first(text) OVER (ORDER BY doc_id DESC NULLS LAST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text))),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 3) || substr(after, 1, length(text) // 3) AS edited FROM n),
m AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_mark_sql("text")} AS fingerprint, {_mark_sql("edited")} AS edited_fingerprint, {_mark_sql("after")} AS next_fingerprint FROM e)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_like_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_like_sql("fingerprint", "next_fingerprint")} AS near_next,
  CASE WHEN substr(fingerprint, 1, 64) = substr(edited_fingerprint, 1, 64) THEN [] ELSE list_transform(list_filter(range(len({_cut_sql("fingerprint")})), lambda i: NOT list_contains({_cut_sql("edited_fingerprint")}, {_cut_sql("fingerprint")}[i + 1])), lambda j: CAST(j AS INTEGER)) END AS edited_sections
FROM m
"""

def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS i FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.i, b.vec_id AS other, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda j: a.v[j] * b.v[j])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.i <> b.i
), p AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, other NULLS LAST) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.i, p.nth ORDER BY s.score DESC, s.other NULLS LAST) AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.i = p.i AND NOT s.same AND p.nth <= 5 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


_STATES = ("nothing", "sys", "usr", "ast")
_least = lambda *values: f"list_sort([{', '.join(values)}])[1]"
_edit = lambda s, cost, letter, line=None: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': " + (f"list_append({s}.t, {line})" if line else f"{s}.t") + "}"


def _turn_sql(to: str, befores: tuple[str, ...], name: str) -> str:
    """The least (cost, audit, lines) that ends in a state after one more turn."""
    kept = [f"CASE WHEN fault IN (1, 2) OR role[1] <> '{name[0]}' THEN {_edit(s, '1e15::BIGINT', '')} ELSE {_edit(s, 'extra', 'K', "role || ':' || text")} END" for s in befores]
    other = [f"CASE WHEN fault IN (1, 2) THEN {_edit(s, '1e15::BIGINT', '')} ELSE {_edit(s, '1 + extra', 'R', f"'{name}:' || text")} END" for s in befores if name != "system"]
    return f"{_least(_edit(to, 2, 'D'), *kept, *other)} AS {to}"


_CLOSE_SQL = f"nothing, sys, {_least('usr', *[_edit(s, 5, 'I', "'user:'") for s in ('nothing', 'sys', 'ast')])} AS usr, ast"
_CLOSED_SQL = f"nothing, sys, usr, {_least('ast', _edit('usr', 5, 'I', "'assistant:'"))} AS ast"
_NONE_SQL = "{'c': 1e15::BIGINT, 'a': '', 't': []::VARCHAR[]}"
OP12_SQL = f"""
WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
w AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS way FROM k),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE way WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{WORD}') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN regexp_matches(text, '[.!?][{SPACES}]*$') THEN 0 ELSE 3 END AS fault FROM p),
m AS (SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS near, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS extra FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(near NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
z AS (SELECT conv_id, 0 AS i, {_CLOSED_SQL} FROM (SELECT conv_id, {_CLOSE_SQL} FROM (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS nothing, {_NONE_SQL} AS sys, {_NONE_SQL} AS usr, {_NONE_SQL} AS ast FROM conversations))),
r AS (SELECT * FROM z UNION ALL SELECT conv_id, i, {_CLOSED_SQL} FROM (SELECT conv_id, i, {_CLOSE_SQL} FROM (
  SELECT r.conv_id, m.i, {_edit('nothing', 2, 'D')} AS nothing, {_turn_sql('sys', ('nothing',), 'system')}, {_turn_sql('usr', ('nothing', 'sys', 'ast'), 'user')}, {_turn_sql('ast', ('usr',), 'assistant')}
  FROM r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.i = r.i + 1))),
e AS (SELECT r.conv_id, {_least('nothing', 'ast')} AS best, n.* EXCLUDE (conv_id, n) FROM r LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(n.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256 FROM e
"""


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash_dedup

    return minhash_dedup.dedup(table(spark, sf_dir, "documents"))


OP13_SQL = _links_sql(3, 85, "c.doc_id = r.component_id AS kept, ")

QUERIES = {f.__name__: f for f in (op1_maxent_lm, op2_ngram_join, op3_html_extract, op4_quality_crf, op5_byte_bpe, op6_raking, op7_secret_scan, op8_topk_search, op9_url_filter, op10_merkle, op11_hard_negatives, op12_turn_repair, op13_minhash_dedup)}
ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op6_raking": raking.sql(), "op8_topk_search": OP8_SQL, "op10_merkle": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_minhash_dedup": OP13_SQL}
