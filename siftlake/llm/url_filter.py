"""URL filters: explicit host and path rules, and a path-template tree for the urls that no rule fits.

The tree is built for each host from distinct paths, over all levels at which two paths of a host have different segments, however deep they are (where all have the same, no node can have two children): segments
that hold digits and rare children become wildcards. A child is rare if another row of its node falls into it with a share of
less than 1 / `max_children`, whatever the number of rows; one whose labelled purity differs significantly stays. Branches
of a node whose children are distributed alike and whose labelled purity does not differ significantly are merged
under the smallest of them. Labels are the urls that a rule decides. A template's share of blocked urls is smoothed towards the same template over all hosts and that towards
the share of all labelled urls; templates whose smoothed share reaches `threshold` are rejected.

All of it is aggregation by (host, template): a hot host's rows are counted before they are shuffled. Each step's counts
are written to the shared folder, as the next step reads them several times.
Null urls and urls without "://" have an empty host and path, fit no rule and are judged as host "" with an empty path.
Repeated rows and null ids give a row each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash

#: (verdict, host, path) of the default rule set.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
WILD = "*"
SUMS = ("n", "labelled", "blocked")
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; a later :// is a part of the path or behind it."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*+([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; nulls where none fits. A rule fits its host and all subdomains."""
    text = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)) if text is None else text.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return none if text is None else text, none if verdict is None else verdict


def _at(tree: DataFrame, level: int) -> DataFrame:
    """Add `node` (the host and the template above segment `level`; neither holds a slash) and `seg`, null where the path ends above it."""
    return tree.withColumns({"node": F.concat_ws("/", "host", F.slice("t", 1, level)), "seg": F.get("t", F.lit(level))})


def _put(level: int, seg: Column) -> Column:
    """The template with another segment at `level`."""
    return F.when(F.col("seg").isNull(), F.col("t")).otherwise(F.concat(F.slice("t", 1, level), F.array(seg), F.slice("t", level + 2, F.size("t"))))


def _salted(kids: DataFrame, sums: DataFrame, key: str) -> DataFrame:
    """Join sums of nodes to their children; a node with a large share of all children spreads over several tasks."""
    salts = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kids.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int")).join(salts, [key, "salt"]).drop("salt")


def _apart(n: Column, k: Column, other_n: Column, other_k: Column, z: float) -> Column:
    """Whether two labelled purities differ by more than z standard errors."""
    pa, pb = (k + 0.5) / (n + 1), (other_k + 0.5) / (other_n + 1)
    return F.abs(pa - pb) > z * F.sqrt(pa * (1 - pa) / (n + 1) + pb * (1 - pb) / (other_n + 1))


def _often(max_children: int) -> Column:
    """Whether another row of the node falls into the same child with a share of 1 / max_children at least; an only row has no other."""
    return (F.col("n") - 1) * max_children >= F.col("n_node") - 1


def _children(tree: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The children at `level` with their sums: those of nodes with two children or more, with their node's sums, and all."""
    kids = stash(_at(tree, level).filter("seg IS NOT NULL").groupBy("node", "seg", F.concat_ws("/", F.slice("t", 1, level)).alias("above")).agg(*[F.sum(c).alias(c) for c in SUMS]))
    sums = kids.groupBy("node").agg(*[F.sum(c).alias(f"{c}_node") for c in SUMS], F.count(F.lit(1)).alias("children"))
    return stash(_salted(kids, sums.filter("children > 1"), "node")), kids


def _levels(tree: DataFrame) -> list[int]:
    """The levels at which some host has two segments; no more than the longest path has."""
    apart = tree.select("host", F.posexplode("t").alias("level", "seg")).groupBy("host", "level").agg((F.min("seg") < F.max("seg")).alias("parts"))
    return sorted(r.level for r in apart.filter("parts").select("level").distinct().collect())


def _generalise(tree: DataFrame, level: int, max_children: int, z: float) -> tuple[DataFrame, bool]:
    """Set segment `level` of rare children to a wildcard. Also whether a node has two children here.

    A child stays by its share of the node's rows, or by a purity that differs from the other children of its node or,
    with the labels of other hosts, from what other segments have there."""
    wide, kids = _children(tree, level)
    if wide.isEmpty():
        return tree, False
    anywhere = kids.filter("labelled > 0").groupBy("above", "seg").agg(F.sum("labelled").alias("any_n"), F.sum("blocked").alias("any_k"))
    total = anywhere.groupBy("above").agg(F.sum("any_n").alias("all_n"), F.sum("any_k").alias("all_k"))
    rare = wide.filter(~_often(max_children) & (F.col("seg") != WILD)).join(_salted(anywhere, total, "above"), ["above", "seg"], "left")
    own = _apart(F.col("labelled"), F.col("blocked"), F.col("labelled_node") - F.col("labelled"), F.col("blocked_node") - F.col("blocked"), z)
    n, k = F.coalesce("any_n", F.lit(0)) - F.col("labelled"), F.coalesce("any_k", F.lit(0)) - F.col("blocked")
    others = _apart(n, k, F.coalesce("all_n", F.lit(0)) - F.coalesce("any_n", F.lit(0)), F.coalesce("all_k", F.lit(0)) - F.coalesce("any_k", F.lit(0)), z)
    rare = rare.filter(~(own & (F.col("labelled") > 0)) & ~(others & (n > 0))).select("node", "seg", F.lit(WILD).alias("into"))
    out = _at(tree, level).join(rare, ["node", "seg"], "left")
    return stash(out.withColumn("t", F.when(F.col("into").isNotNull(), _put(level, F.col("into"))).otherwise(F.col("t"))).select(*tree.columns)), True


def _merge(tree: DataFrame, level: int, max_children: int, similarity: float, z: float) -> DataFrame:
    """Merge sibling branches at `level`: like children (cosine of their counts) and purity within z standard errors.

    Branches without labels show no purity and stay, so that the same template on other hosts can judge them. Only
    branches that stay by their share of rows are compared, so a node has few pairs."""
    often = _children(tree, level)[0].filter(_often(max_children)).filter("labelled > 0").select("node", "seg")
    kids = _at(tree, level).join(often, ["node", "seg"]).groupBy("node", F.col("seg").alias("a"), F.coalesce(F.get("t", F.lit(level + 1)), F.lit("")).alias("kid")).agg(*[F.sum(c).alias(c) for c in SUMS])
    kids = stash(kids)
    # squares of counts outgrow 64 bits: sums of them are decimals, products of these floating
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    branch = kids.groupBy("node", "a").agg(F.sum(whole("n") * whole("n")).cast("double").alias("norm"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    left = kids.select("node", "kid", "a", F.col("n").alias("na"))
    right = kids.select("node", "kid", F.col("a").alias("b"), F.col("n").alias("nb"))
    dots = left.join(right, ["node", "kid"]).filter(F.col("b") < F.col("a")).groupBy("node", "a", "b").agg(F.sum(whole("na") * whole("nb")).cast("double").alias("dot"))
    for side in ("a", "b"):
        dots = dots.join(branch.select("node", F.col("a").alias(side), F.col("norm").alias(f"{side}_norm"), F.col("labelled").alias(f"{side}_n"), F.col("blocked").alias(f"{side}_k")), ["node", side])
    alike = (F.col("dot") >= similarity * F.sqrt(F.col("a_norm") * F.col("b_norm"))) & ~_apart(F.col("a_n"), F.col("a_k"), F.col("b_n"), F.col("b_k"), z)
    into = dots.filter(alike).groupBy("node", F.col("a").alias("seg")).agg(F.min("b").alias("into"))
    out = _at(tree, level).join(into, ["node", "seg"], "left")
    return stash(out.withColumn("t", F.when(F.col("into").isNotNull(), _put(level, F.col("into"))).otherwise(F.col("t"))).select(*tree.columns))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_children: int = 24, similarity: float = 0.9, z: float = 2.0, strength: float = 8.0, threshold: float = 0.5) -> DataFrame:
    """Judge every url: the id column, host, path, rule (null if none fits), template, blocked_share, verdict."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    pieces = F.filter(F.split(F.translate("path", UPPER, LOWER), "/"), lambda x: x != "")
    shape = F.transform(pieces, lambda x: F.when(x.rlike("[0-9]"), F.concat(F.lit(WILD), F.regexp_extract(x, r"(\.[a-z]{1,5})$", 1))).otherwise(x))
    urls = urls.withColumns({"rule": rule, "by_rule": verdict, "segs": F.array_join(shape, "/")})
    labelled = F.when(F.col("by_rule").isNotNull(), 1).otherwise(0)
    blocked = F.when(F.col("by_rule") == "block", 1).otherwise(0)
    tree = urls.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum(labelled).alias("labelled"), F.sum(blocked).alias("blocked"))
    tree = stash(tree.withColumn("t", F.when(F.col("segs") != "", F.split("segs", "/")).otherwise(F.array().cast("array<string>"))))
    wide = []
    for level in _levels(tree):
        tree, parts = _generalise(tree, level, max_children, z)
        wide += [level] * parts
    for level in reversed(wide):
        tree = _merge(tree, level, max_children, similarity, z)
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/")))
    of_host = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n_host"), F.sum("blocked").alias("k_host"))
    anywhere = of_host.groupBy("template").agg(F.sum("n_host").alias("n_any"), F.sum("k_host").alias("k_any"))
    total = anywhere.agg(F.sum("n_any").alias("n_all"), F.sum("k_any").alias("k_all")).select(((F.coalesce("k_all", F.lit(0)) + 1) / (F.coalesce("n_all", F.lit(0)) + 2)).alias("prior"))
    # one row of one number
    any_share = anywhere.join(F.broadcast(total)).withColumn("any_share", (F.col("k_any") + strength * F.col("prior")) / (F.col("n_any") + strength)).select("template", "any_share")
    shares = of_host.join(any_share, "template").select("host", "template", ((F.col("k_host") + strength * F.col("any_share")) / (F.col("n_host") + strength)).alias("blocked_share"))
    lookup = tree.select("host", "segs", "template", "n").join(shares, ["host", "template"])
    # paths with a thousandth of all rows or more, a thousand at most (all urls without a host among them), spread over several tasks
    rows = tree.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = tree.filter(F.col("n") * 1000 >= rows).select("host", "segs", F.lit(True).alias("hot"))
    urls = urls.join(F.broadcast(often), ["host", "segs"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(0))
    lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") * 1000 >= rows, SALTS - 1).otherwise(0)))).drop("n")
    out = urls.join(lookup, ["host", "segs", "salt"], "left")
    method = F.when(F.col("blocked_share") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", "template", F.round("blocked_share", 6).alias("blocked_share"), F.coalesce("by_rule", method).alias("verdict"))
