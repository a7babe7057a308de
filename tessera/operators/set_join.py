"""Joins of sets and of texts that compare only rows which share something rare: no pair is made that cannot pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import stored


#: Rows of a relation that may be broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small; else joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters of a text; none if it is shorter."""
    return let(text, lambda t: F.when(F.length(t) >= q, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda i: F.substring(t, i, F.lit(q))))).otherwise(F.array().cast("array<string>")))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(lid, rid, score): pairs of left(lid, tokens) and right(rid, tokens) whose Jaccard similarity is over `least`.

    Tokens are sets as arrays of strings. Both sides order them by how few rows of right have them. Two sets of n and m tokens that
    are so similar share one among the first n - ceil(least n) + 1 and m - ceil(least m) + 1 of these (prefix filter), and neither
    size is under least times the other's (length filter); only such pairs are compared. left meets them by broadcast if a count
    shows that it is small. Empty and null sets are like nothing.
    """
    df = stored(right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")))

    def prefixes(side: DataFrame, key: str) -> DataFrame:
        n = F.size("tokens")
        each = side.where(n > 0).select(key, n.alias("n"), F.explode("tokens").alias("token")).join(small(df, 1_000_000), "token", "left")
        ordered = each.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("o"))
        return ordered.select(key, "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("t")).select(key, "n", "t.token")

    a, b = prefixes(left, "lid").withColumnRenamed("n", "ln"), prefixes(right, "rid").withColumnRenamed("n", "rn")
    fits = (F.col("ln") * least <= F.col("rn") + 1e-9) & (F.col("rn") * least <= F.col("ln") + 1e-9)
    pairs = b.join(small(stored(a)), "token").where(fits).select("lid", "rid").distinct()
    met = pairs.join(small(left.select("lid", F.col("tokens").alias("lt"))), "lid").join(right.select("rid", F.col("tokens").alias("rt")), "rid")
    common = F.size(F.array_intersect("lt", "rt"))
    scored = met.select("lid", "rid", (common / (F.size("lt") + F.size("rt") - common)).alias("score"))
    return scored.where(F.col("score") > least)


def with_contained(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, rid): which of words(word), of two characters or more, stand anywhere in which of texts(rid, text).

    Each word is looked for only where its rarest pair of characters occurs; a text gives each of its pairs once, and pairs
    that no word needs go at once.
    """
    pairs = words.select("word", F.explode(grams(F.col("word"), 2)).alias("pair"))
    found = texts.select("rid", F.explode(grams(F.col("text"), 2)).alias("pair"))
    asked = stored(pairs)
    df = found.join(small(asked.select("pair").distinct()), "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("df"))
    seeds = asked.join(small(stored(df)), "pair").groupBy("word").agg(F.min_by("pair", F.struct("df", "pair")).alias("pair"))
    near = found.join(small(stored(seeds)), "pair").select("rid", "word")
    return near.join(texts, "rid").where(F.contains("text", "word")).select("word", "rid")


def sharing_run(left: DataFrame, right: DataFrame, least: float, q: int = 4) -> DataFrame:
    """(lid, rid): pairs of left(lid, text) and right(rid, text) that may have a common substring longer than `least` of the longer text.

    Such a substring has over least |left| characters, so it covers a run of q of them that begins at a multiple of some step of
    left; right is asked for these few runs. Texts too short for q use shorter runs, with texts that are short as well.
    """
    size, need = F.length("text"), (F.floor(F.length("text") * least) + 1).cast("int")
    seeds = left.where(size > 0).select("lid", "text", size.alias("ln"), F.least(need, F.lit(q)).alias("q"), need.alias("need"))
    at = F.sequence(F.lit(1), F.col("ln") - F.col("q") + 1, F.col("need") - F.col("q") + 1)
    seeds = seeds.select("lid", "ln", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("text"), i, F.col("q"))))).alias("run"))
    short = F.length("text") <= int(q / least / least)
    runs = F.concat(grams(F.col("text"), q), *[F.when(short, grams(F.col("text"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, q)])
    have = right.select("rid", size.alias("rn"), F.explode(runs).alias("run"))
    fits = (F.col("rn") > F.col("ln") * least) & (F.col("ln") > F.col("rn") * least)
    return have.join(small(stored(seeds)), "run").where(fits).select("lid", "rid").distinct()
