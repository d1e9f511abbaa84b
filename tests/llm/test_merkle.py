import hashlib
import re

from pyspark.sql import functions as F

from siftlake.llm import merkle


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


PIECE = re.compile(merkle.PIECE)


def brute(text):
    pieces = [[md5(x) for x in PIECE.findall(p)] for p in text.split("\n")]
    sections, now = [], []
    for i, p in enumerate(pieces):
        digest = md5("".join(p))
        now.append((digest, ",".join(d[: merkle.LEAF] for d in p)))
        if digest[0] in merkle.BREAKS or i == len(pieces) - 1:
            sections.append((md5(";".join(d for d, _ in now)), ";".join(x for _, x in now)))
            now = []
    return hashlib.sha256("".join(d for d, _ in sections).encode()).hexdigest() + ":" + "|".join(f"{d[: merkle.SECTION]}={s}" for d, s in sections)


def leaves(mark):
    body = mark.split(":", 1)[1]
    for c in "=|;":
        body = body.replace(c, ",")
    return {x for x in body.split(",") if len(x) == merkle.LEAF}


def check(rows, got, with_next=True):
    """rows in any order; equal ids by MD5."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1] or "")))
    want = []
    for i, (own, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        marks = [brute(x) for x in (text, edited, after)]

        def like(a, b):
            x, y = leaves(a), leaves(b)
            return 1.0 if a == b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0

        want.append((str(own), len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], round(like(marks[0], marks[1]), 6), round(like(marks[0], marks[2]), 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 6), round(r.near_next, 6)) for r in got)


def test_odd_rows(odd, none):
    check([(r.doc_id, r.text) for r in odd.collect()], merkle.fingerprints(odd).collect())
    assert merkle.fingerprints(none).count() == 0
    assert [r.near_next for r in merkle.fingerprints(odd.filter("doc_id = 5")).collect()] == [1.0]


def test_whole_table_in_many_ranges(docs):
    rows = merkle.with_next(docs, rows_per_range=7).collect()
    order = sorted(docs.collect(), key=lambda r: -r.doc_id)
    after = {r.doc_id: order[(i + 1) % len(order)].text for i, r in enumerate(order)}
    assert {r.doc_id: r.next_text for r in rows} == after
    two_levels = merkle.with_next(docs.unionAll(docs.selectExpr("doc_id + 1000000 AS doc_id", *[c for c in docs.columns if c != "doc_id"])).repartition(3), rows_per_range=1).select("doc_id", "next_text").collect()
    assert len(two_levels) == 2 * len(order) and {r.doc_id: r.next_text for r in two_levels if r.doc_id < 1_000_000 and r.doc_id} == {i: t for i, t in after.items() if i}
    check([(r.doc_id, r.text) for r in order], merkle.fingerprints(docs).collect())


def test_many_rows_of_one_id_and_of_none(spark):
    rows = [(i, f"text {k} of {i}") for i in (7, None, 3) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), md5(r[1])))
    got = merkle.with_next(df, rows_per_range=4)
    assert sorted((str(r.text), r.next_text) for r in got.collect()) == sorted((ordered[i][1], ordered[(i + 1) % len(rows)][1]) for i in range(len(rows)))
    cut = merkle.in_ranges(df.withColumn("md5", F.md5(F.col("text").cast("binary"))), "doc_id", 4)[0].groupBy("range").count()
    assert max(r["count"] for r in cut.collect()) <= 12


def test_insertions_change_few_pieces(spark):
    text = " ".join(f"words number {k} are here," for k in range(60))
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = spark.createDataFrame([(text, "xy" + text)], "a string, b string").select(a.alias("a"), b.alias("b"), merkle.likeness(a, b).alias("like")).first()
    assert row.like > 0.9 and row.a.split(":")[0] != row.b.split(":")[0]


def test_edits_are_located(spark):
    lines = [f"line {i} with some words" for i in range(40)]
    other = [*lines[:20], "changed", *lines[21:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    row = df.select(a.alias("a"), merkle.differing_sections(a, b).alias("at"), merkle.differing_sections(a, a).alias("same")).first()
    sections = row.a.split(":")[1].split("|")
    start = [sum(s.count(";") + 1 for s in sections[:k]) for k in range(len(sections) + 1)]
    assert row.same == [] and len(row["at"]) <= 2 and any(start[k] <= 20 < start[k + 1] for k in row["at"])
