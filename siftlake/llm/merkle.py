"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions only.

Paragraphs are the lines of a text. Each is cut into pieces whose borders follow the content: a piece ends after a word that ends
in i, u, y or a sentence mark, wherever it began, or after 96 code points where no such word comes, so an insertion changes the pieces around it and
no others. Digests are of 128 bits throughout: a piece's covers its text, a paragraph's its pieces, a section's its paragraphs; a section ends after a
paragraph whose digest starts with one of `BREAKS`, so its borders follow the content too. The root, a SHA-256, covers the sections. So equal texts have equal roots, and equal
roots mean equal texts but for collisions of whole digests.

A fingerprint is text: root:section|section..., where a section is digest=paragraph;paragraph... (digest: the first 16 hexadecimal digits) and a paragraph
its leaves, the first eight digits of each piece's digest, joined by commas. Sections that differ locate edits.

Null texts count as empty; an empty text has one section of one empty paragraph and no leaf. The next document is
the one with the next smaller id (null ids last, equal ids by the MD5 of their text); after the last comes the first, so a
single document follows itself. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One piece of a paragraph.
PIECE = "(?s).{0,94}?[iuy.,;:!?] |.{1,96}"
#: First hexadecimal digits of a paragraph's digest that end a section: one paragraph in four.
BREAKS = "0123"
LEAF, SECTION = 8, 16
#: Bits of a range's number for its place inside the first level.
LEVEL = 24
#: Ranges whose first ids are broadcast at most (two numbers for each).
BROADCAST = 500_000


def _md5(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    # a paragraph becomes digest=leaves; one whose digest opens with a break digit is followed by the end of its section
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), _md5))
    paragraphs = F.transform(pieces, lambda x: F.concat(_md5(F.array_join(x, "")), F.lit("="), F.array_join(F.transform(x, lambda d: F.substring(d, 1, LEAF)), ",")))
    marked = F.array_join(F.transform(paragraphs, lambda p: F.concat(p, F.when(F.substring(p, 1, 1) < chr(ord(BREAKS[-1]) + 1), F.lit("|")).otherwise(F.lit(";")))), "")
    sections = F.split(F.regexp_replace(marked, "[;|]$", ""), "\\|", -1)
    # the section's digest covers its paragraphs' digests, which then go
    sections = F.transform(sections, lambda s: F.struct(_md5(F.regexp_replace(s, "=[^;]*", "")).alias("digest"), F.regexp_replace(s, "[0-9a-f]{32}=", "").alias("leaves")))
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["digest"]), "").cast("binary"), 256)
    body = F.array_join(F.transform(sections, lambda s: F.concat(F.substring(s["digest"], 1, SECTION), F.lit("="), s["leaves"])), "|")
    return F.concat(root, F.lit(":"), body)


def root(mark: Column) -> Column:
    return F.substring_index(mark, ":", 1)


def leaves(mark: Column) -> Column:
    """Distinct leaf digests of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring(mark, 66, 2_000_000_000), "[=|;,]", -1), lambda x: F.length(x) == LEAF))


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct leaves that two fingerprints share over the sum of theirs; 1 for equal fingerprints."""
    x, y = leaves(a), leaves(b)
    every = F.size(x) + F.size(y)
    return F.when(a == b, F.lit(1.0)).when(every == 0, F.lit(0.0)).otherwise(2 * F.size(F.array_intersect(x, y)) / every)


def differing_sections(a: Column, b: Column) -> Column:
    """Positions (from 0) of the sections of `a` that `b` has nowhere: where the texts differ; empty for equal roots."""
    cut = lambda m: F.transform(F.split(F.substring(m, 66, 2_000_000_000), "\\|", -1), lambda s: F.substring(s, 1, SECTION))
    theirs = cut(b)
    at = F.transform(cut(a), lambda s, i: F.when(~F.array_contains(theirs, s), i))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.array_compact(at))


def in_ranges(rows: DataFrame, id_col: str, rows_per_range: int) -> tuple[DataFrame, int]:
    """Add `range`: a number for each range of about `rows_per_range` rows, rising in descending order of (id, MD5 of the text), null ids last.

    Ranges are cut at quantiles of one number for each row, its id followed by 32 bits of the MD5, so that an id with many rows is cut as well. Beyond
    1024 ranges there are two levels, each of about the square root of their number; the second level's quantiles stay in a table of one row for each range of the first. Also returns about how many ranges there are."""
    bits = F.conv(F.substring("md5", 1, 8), 16, 10).cast("double")
    # a generator, so that the optimiser does not move the digest of a whole text into the comparisons below
    once = F.struct(bits.alias("bits"), (F.col(id_col).cast("double") * F.lit(float(1 << 32)) - bits).alias("at"))
    rows, bits = rows.select("*", F.inline(F.array(once))), F.col("bits")
    place = lambda cuts: F.size(F.filter(cuts, lambda c: c > F.col("at")))
    shares = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)])
    n, without = rows.agg(F.count(F.lit(1)), F.count_if(F.col(id_col).isNull())).first()
    ranges = max(1, -(-n // rows_per_range))
    first = ranges if ranges <= 1024 else int(ranges**0.5) + 1
    cuts = rows.agg(F.percentile_approx("at", shares(first), F.lit(100 * first)).alias("cuts")).first()["cuts"] if first > 1 else None
    cuts = sorted(set(cuts or []))
    parts = max(1, -(-without // rows_per_range))
    last = F.lit(len(cuts) + 1) + F.floor(bits * parts / float(1 << 32)).cast("int")
    rows = rows.withColumn("r1", F.coalesce(F.when(F.col(id_col).isNull(), last).otherwise(place(F.lit(cuts)) if cuts else F.lit(0)), F.lit(0)))
    second = -(-ranges // first)
    if second == 1:
        return rows.withColumn("range", F.shiftleft(F.col("r1").cast("long"), LEVEL)).drop("r1", "at", "bits"), ranges + parts
    fine = rows.groupBy(F.col("r1").alias("of")).agg(F.percentile_approx("at", shares(second), F.lit(100 * second)).alias("fine"))
    # one row for each range of the first level
    rows = rows.join(F.broadcast(fine), rows["r1"] == fine["of"])
    inner = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(place(F.col("fine")))
    return rows.withColumn("range", F.shiftleft(F.col("r1").cast("long"), LEVEL) + inner).drop("r1", "at", "bits", "of", "fine"), ranges + parts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 800) -> DataFrame:
    """The id, text (null: empty), mark (its fingerprint), next_text and next_mark: those of the next document by descending id, after the last the first.

    Every text is fingerprinted once. Neighbours are found inside ranges; the first texts of the ranges (one for each) close the gaps between them."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("md5", _md5(F.col("text")))
    rows, ranges = in_ranges(rows, id_col, rows_per_range)
    inside = W.partitionBy("range").orderBy(F.desc_nulls_last(id_col), "md5")
    pair = F.struct("text", "mark")
    # texts are shuffled once, and fingerprinted where they arrive
    inner = rows.repartition("range").withColumn("mark", fingerprint(F.col("text"))).withColumn("after", F.lead(pair).over(inside))
    # the first text of each range stands after the last one of the range before
    first = rows.groupBy("range").agg(F.max(id_col).alias("first_id")).withColumnRenamed("range", "of")
    heads = rows.join(F.broadcast(first) if ranges <= BROADCAST else first, (F.col("range") == F.col("of")) & F.col(id_col).eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("of").agg(F.min_by("text", "md5").alias("text")).withColumn("mark", fingerprint(F.col("text")))
    # ranges in order: inside their first level, and over all first levels (at most about the square root of all ranges)
    places = first.select("of", F.shiftright("of", LEVEL).alias("level"))
    every = W.orderBy("level")
    levels = places.groupBy("level").agg(F.min("of").alias("low"))
    levels = levels.select("level", F.coalesce(F.lead("low").over(every), F.first("low").over(every)).alias("up"))
    links = places.withColumn("to", F.lead("of").over(W.partitionBy("level").orderBy("of"))).join(levels, "level")
    links = links.select(F.col("of").alias("from"), F.coalesce("to", "up").alias("of"))
    closing = links.join(heads, "of").select(F.col("from").alias("range"), pair.alias("head"))
    out = inner.join(closing, "range").withColumn("after", F.coalesce("after", "head"))
    return out.select(id_col, "text", "mark", F.col("after.text").alias("next_text"), F.col("after.mark").alias("next_mark"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/3) code points replaced by the first as many of another text."""
    tail = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - tail), F.substring(following, F.lit(1), tail))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to each other and to the next document's.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections."""
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(id_col, F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("mark").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_mark")
    near = rows.withColumns({"near_edited": F.round(likeness(F.col("fingerprint"), F.col("edited_fingerprint")), 9), "near_next": F.round(likeness(F.col("fingerprint"), F.col("next_mark")), 9), "edited_sections": differing_sections(F.col("fingerprint"), F.col("edited_fingerprint"))})
    return near.drop("next_mark")
