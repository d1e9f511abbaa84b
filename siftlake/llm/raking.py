"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are counted for each cell of source, language and topic. Passes over the three margins scale the cells' factors until the
raked token weights meet the targets; documents are then kept with probability min(1, s * factor), where s is set so that the expected
share of kept tokens is `keep`. A document stands `copies` times in the sample: the whole part of s * factor, and once more with its rest as
probability, by the same draw that keeps it. So the sample's expected shares are the raked ones even where s * factor passes 1, and its
expected tokens s times all tokens; kept documents alone fall short of targets that rise.
The cells are a distributed table throughout; only single numbers reach the driver.

Targets default to shares in proportion to the square root of each value's tokens, which lifts small sources; given targets may name
some values, and the rest share what is left in the default proportion. Topic is an expression over the rows; as documents have no
topic column, the default is the form of the text (table, list, prose of four lengths).

Null sources, languages and texts count as empty text. Documents without tokens weigh nothing but are sampled like the rest of their cell.
Documents of one id are kept or dropped together (a null id counts as empty text). Repeated rows give a row each; an empty
table gives an empty table. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stash

MARGINS = ("source", "lang", "topic")
SALTS = 16
#: Columns that the operator works with; they carry a prefix so that columns of the input never clash with them.
P = "_mix_"


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The form of a text: table (one bar in twenty words at least), list (a line for each eight words, three lines at least), else prose by its length: brief, short, long, book."""
    text = F.coalesce(text, F.lit(""))
    count = lambda char: F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
    form = F.when((n_tokens > 0) & (count("|") * 20 >= n_tokens), "table").when((count("\n") >= 2) & (count("\n") * 8 + 8 >= n_tokens), "list")
    return form.when(n_tokens < 100, "brief").when(n_tokens < 400, "short").when(n_tokens < 1500, "long").otherwise("book")


def _total(values: str, margin: str) -> Column:
    """Sum over the values of a margin, each of which is repeated in all of its cells."""
    return F.coalesce(F.sum(F.expr(values) / F.col(f"{margin}_cells")), F.lit(0.0))


def factors(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, passes: int = 6) -> DataFrame:
    """Raked factor of each cell. cells: source, lang, topic, tokens; returns them with `factor`.

    Given shares of values that no cell has are ignored; shares that sum to more than 1, or leave no other value to take the rest, are scaled to sum to 1."""
    each = {m: W.partitionBy(m) for m in MARGINS}
    for m in MARGINS:
        share = F.lit(None).cast("double")
        for value, wanted in sorted(((targets or {}).get(m) or {}).items()):
            share = F.when(F.col(m) == value, F.lit(float(wanted))).otherwise(share)
        cells = cells.withColumns({f"{m}_root": F.sqrt(F.sum("tokens").over(each[m]).cast("double")), f"{m}_cells": F.count(F.lit(1)).over(each[m]), f"{m}_given": share})
    cells = stash(cells)
    sums = [F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")]
    for m in MARGINS:
        sums += [_total(f"CASE WHEN {m}_given IS NULL THEN {m}_root END", m).alias(f"{m}_rest"), _total(f"{m}_given", m).alias(f"{m}_named")]
    sums = cells.agg(*sums).first()
    wanted = {}
    for m in MARGINS:
        rest, named = sums[f"{m}_rest"], sums[f"{m}_named"]
        scale = 1 / named if named > 1 or named and not rest else 1.0
        wanted[m] = F.coalesce(F.col(f"{m}_given") * F.lit(scale), F.col(f"{m}_root") * F.lit(max(0.0, 1 - named)) / F.lit(rest or 1.0)) * F.lit(float(sums["tokens"]))
    cells = cells.select(*MARGINS, "tokens", F.lit(1.0).alias("factor"), *[w.alias(f"{m}_wanted") for m, w in wanted.items()])
    for _ in range(passes):
        for m in MARGINS:
            now = F.sum(F.col("tokens") * F.col("factor")).over(each[m])
            cells = cells.withColumn("now", now).withColumn("factor", F.when(F.col("now") > 0, F.col("factor") * F.col(f"{m}_wanted") / F.col("now")).otherwise(F.col("factor")))
        cells = stash(cells.drop("now"))  # one job for each pass
    return cells.select(*MARGINS, "tokens", "factor")


def scale_for(cells: DataFrame, keep: float, rounds: int = 6) -> float:
    """s for which the sum of min(1, s * factor) * tokens is `keep` of all tokens, by raising s until no more cells reach 1."""
    mass = F.col("tokens") * F.col("factor")
    row = cells.agg(F.sum("tokens").alias("all"), F.sum(mass).alias("free")).first()
    if not row["all"] or not row["free"]:
        return 1.0
    budget, s = keep * row["all"], keep * row["all"] / row["free"]
    for _ in range(rounds):
        full = F.col("factor") * F.lit(s) >= 1
        row = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(mass)).alias("free")).first()
        if not row["free"] or row["full"] >= budget:
            break
        s = (budget - row["full"]) / row["free"]
    return s


def draw(key: Column, seed: str = "mix") -> Column:
    """A fixed number from 0 to below 1 for each key: 48 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep: float = 0.8, passes: int = 6, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """The rows of docs with _mix_ columns: source, lang, topic (an expression over docs), n_tokens, weight (the factor), expected, probability, kept, copies."""
    rows = docs.withColumn(f"{P}n_tokens", count_tokens(F.col(text_col)))
    given = topic_of(F.col(text_col), F.col(f"{P}n_tokens")) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    rows = rows.withColumns({f"{P}source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), f"{P}lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), f"{P}topic": given})
    cells = rows.groupBy(*[F.col(P + m).alias(m) for m in MARGINS]).agg(F.sum(f"{P}n_tokens").alias("tokens"))
    cells = factors(cells, targets, passes)
    s = scale_for(cells, keep)
    # every cell once for each salt: a source with a third of all rows spreads over as many tasks
    table = stash(cells.select(*[F.col(m).alias(f"{P}c_{m}") for m in MARGINS], F.col("factor").alias(f"{P}weight"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{P}c_salt")))
    on = F.pmod(F.xxhash64(id_col), F.lit(SALTS)) == F.col(f"{P}c_salt")
    for m in MARGINS:
        on = on & (F.col(P + m) == F.col(f"{P}c_{m}"))
    out = rows.join(table, on).drop(f"{P}c_salt", *[f"{P}c_{m}" for m in MARGINS])
    out = out.withColumn(f"{P}expected", F.lit(s) * F.col(f"{P}weight")).withColumn(f"{P}probability", F.least(F.lit(1.0), F.col(f"{P}expected")))
    times, drawn = F.col(f"{P}expected"), draw(F.col(id_col))
    return out.withColumns({f"{P}kept": drawn < F.col(f"{P}probability"), f"{P}copies": F.floor(times) + (drawn < times - F.floor(times)).cast("long")})


def sql(keep: float = 0.8, passes: int = 6, rounds: int = 6) -> str:
    """The default mix of `documents` as one DuckDB statement."""
    words, text = WORD.replace("'", "''"), "coalesce(text, '')"
    count = lambda char: f"(length(text) - length(replace(text, {char}, '')))"
    form = f"CASE WHEN n_tokens > 0 AND {count("'|'")} * 20 >= n_tokens THEN 'table' WHEN {count('chr(10)')} >= 2 AND {count('chr(10)')} * 8 + 8 >= n_tokens THEN 'list'"
    with_ = [
        f"r AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {text} AS text, CAST(len(regexp_extract_all({text}, '{words}')) AS BIGINT) AS n_tokens FROM documents)",
        f"d AS (SELECT doc_id, source, lang, n_tokens, {form} WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 400 THEN 'short' WHEN n_tokens < 1500 THEN 'long' ELSE 'book' END AS topic FROM r)",
        "c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(1 AS DOUBLE) AS factor FROM d GROUP BY ALL)",
        "total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM c0)",
    ]
    for m in MARGINS:
        with_.append(f"m_{m} AS (SELECT {m}, sqrt(CAST(sum(tokens) AS DOUBLE)) AS root FROM c0 GROUP BY {m})")
        with_.append(f"t_{m} AS (SELECT {m}, root / (SELECT sum(root) FROM m_{m}) AS share FROM m_{m})")
    i = 0
    for _ in range(passes):
        for m in MARGINS:
            with_.append(f"n{i} AS (SELECT {m}, sum(tokens * factor) AS now FROM c{i} GROUP BY {m})")
            with_.append(f"c{i + 1} AS (SELECT c.source, c.lang, c.topic, c.tokens, c.factor * CASE WHEN n.now > 0 THEN t.share * (SELECT t FROM total) / n.now ELSE 1 END AS factor FROM c{i} c JOIN n{i} n USING ({m}) JOIN t_{m} t USING ({m}))")
            i += 1
    with_.append(f"s0 AS (SELECT CASE WHEN sum(tokens) > 0 AND sum(tokens * factor) > 0 THEN {keep} * sum(tokens) / sum(tokens * factor) ELSE 1 END AS s FROM c{i})")
    for k in range(rounds):
        with_.append(f"f{k} AS (SELECT any_value(z.s) AS s, sum(tokens) AS every, sum(CASE WHEN factor * z.s >= 1 THEN tokens ELSE 0 END) AS full_, sum(CASE WHEN factor * z.s >= 1 THEN 0 ELSE tokens * factor END) AS free_ FROM c{i}, s{k} z)")
        with_.append(f"s{k + 1} AS (SELECT CASE WHEN free_ = 0 OR full_ >= {keep} * every THEN s ELSE ({keep} * every - full_) / free_ END AS s FROM f{k})")
    draw = "CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0"
    body = f"SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(c.factor, 6) AS weight, round(z.s * c.factor, 6) AS expected, round(least(1.0, z.s * c.factor), 6) AS probability, {draw} < least(1.0, z.s * c.factor) AS kept, CAST(floor(z.s * c.factor) + CASE WHEN {draw} < z.s * c.factor - floor(z.s * c.factor) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d JOIN c{i} c USING (source, lang, topic), s{rounds} z"
    return f"WITH {', '.join(f'{x.split(" AS ", 1)[0]} AS MATERIALIZED {x.split(" AS ", 1)[1]}' for x in with_)} {body}"
