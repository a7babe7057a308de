"""Mixing sources to target weights by entropy balancing.

For each source the rates r of its documents are the ones nearest to 1 in relative entropy that meet its token target
within the box r <= 3: r = min(3, exp(lambda * size / mean size)). Newton's method solves the dual for all sources at
once; its sums run over the exact histogram of (source, size), never over a sample. Rates are rounded into whole copies:
bins of one size carry the rounding error in words on to the next smaller size, and hashes choose the documents of a bin.
Sums are decimals, so reruns agree to the last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed, ranked, stored, table

WEIGHTS = (5, 2, 1)
CAP = 3
ROUNDS = 60
#: Sizes of a source whose rounding error is carried on together.
CHAIN = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source, source_size, docs, target) of rows (source, size): sources by code point, null last, share all words by
    weight; a target stops at cap times the source's size and the excess goes to the others by weight until none is above.

    The windows run over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("docs"))
    index = sums.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.array(*(F.lit(float(x)) for x in weights))[F.col("src") % len(weights)]
    capped = index.withColumns({"w": w, "limit": (F.col("source_size") * cap).cast("double")})
    order, every = Window.orderBy(F.col("limit") / F.col("w"), "src"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum(F.col("source_size")).over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = capped.withColumn("level", rest / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    below = F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct((F.col("limit") / F.col("w")).alias("at"), "src", "level"))
    return level.withColumn("water", F.min(below).over(every)["level"]).select("src", "source", "source_size", "docs", F.least("limit", F.col("water") * F.col("w")).alias("target"))


def balance(bins: DataFrame, targets: DataFrame, cap: int = CAP, rounds: int = ROUNDS) -> DataFrame:
    """(src, lam): the duals, from bins (src, size, n) and targets. lam is null where the target is the whole cap (or empty)."""
    state = targets.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12)))
    state = stored(state.select("src", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.log(F.col("target") / F.col("source_size")).alias("lam"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("off")))
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(rounds):
        x = F.col("size") / F.col("mean")
        r = F.exp(F.least(F.col("lam") * x, F.log(F.lit(float(cap)))))
        mass = F.col("n") * F.col("size") * r
        sums = bins.join(state, "src").groupBy("src").agg(exact(mass).alias("g"), exact(F.when(F.col("lam") * x < F.log(F.lit(float(cap))), mass * x).otherwise(0)).alias("h"))
        miss = F.log(F.col("target") / F.col("g"))
        lo, hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.when(F.col("h") > 0, miss * F.col("g") / F.col("h")).otherwise(F.signum(miss) * 8)))
        half = (F.col("lo2") + F.col("hi2")) / 2
        moved = state.join(sums, "src").withColumns({"lo2": lo, "hi2": hi, "to": newton, "miss": miss})
        moved = moved.withColumn("to", F.when((F.col("to") > F.col("lo2")) & (F.col("to") < F.col("hi2")), F.col("to")).otherwise(half))
        state = stored(moved.select("src", "target", "mean", F.when(F.abs("miss") < 1e-10, F.col("lam")).otherwise(F.col("to")).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.abs("miss").alias("off")))
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst < 1e-9:
            break
    return state.select("src", "lam", "mean")


def copies(docs: DataFrame, key: str = "doc_id", weights: tuple = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """(key, size, source_size, target, copies) for every row of docs(key, text, source).

    Null or empty text: size 0, no copies. Null source is a source of its own. Rows equal in key, source and size are
    ranked as ties, and either may be the one with a copy more. A long text counts with all its words. Other columns are not
    looked at. Empty input: no rows.
    """
    slim = docs.select(F.col(key).alias("k"), "source", word_count(F.col("text")).alias("size"))
    slim = stored(slim.withColumn("r", hashed(seed, "k", "source", "size")))
    targets = stored(source_targets(slim, weights, cap))
    rows = slim.join(F.broadcast(targets) if targets.count() <= 10_000 else targets, slim["source"].eqNullSafe(targets["source"])).select("k", "size", "r", "src", "source_size", "target")
    bins = stored(rows.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n")))
    lams = balance(bins, targets, cap)
    rate = F.when(F.col("lam").isNull(), F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0)).otherwise(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.log(F.lit(float(cap))))))
    rated = bins.join(targets.select("src", "target"), "src").join(lams, "src", "left").withColumn("rate", F.least(rate, F.lit(float(cap))))
    # whole copies for every document of a bin, and the words still wanted, in words so that bins can settle up
    rated = rated.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn("frac", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    chain = F.floor((F.row_number().over(Window.partitionBy("src").orderBy(F.desc("size"))) - 1) / CHAIN)
    listed = rated.withColumn("chain", chain).groupBy("src", "chain").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n", "frac", "base")))).alias("bins"))
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<size:bigint,n:bigint,base:bigint,extra:bigint>>").alias("out"))

    def settle(a: Column, b: Column) -> Column:
        owed = a["owed"] + b["frac"] * b["n"] * b["size"]
        extra = F.when(b["base"] >= cap, F.lit(0).cast("long")).otherwise(F.least(b["n"], F.greatest(F.lit(0).cast("long"), F.floor(owed / b["size"] + 0.5).cast("long"))))
        return F.struct((owed - extra * b["size"]).alias("owed"), F.concat(a["out"], F.array(F.struct(b["size"].alias("size"), b["n"].alias("n"), b["base"].alias("base"), extra.alias("extra")))).alias("out"))

    plan = stored(listed.select("src", F.inline(F.aggregate("bins", start, settle, lambda a: a["out"]))))
    planned = rows.join(plan, ["src", "size"], "left")
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    part = ranked(stored(planned.where(some)), ["src", "size"], "r", "rank").withColumn("copies", F.col("base") + (F.col("rank") < F.col("extra")).cast("long"))
    whole = planned.where(~some | F.col("n").isNull()).withColumn("copies", F.coalesce(F.col("base") + (F.col("extra") > 0).cast("long"), F.lit(0)).cast("long"))
    cols = [F.col("k").alias(key), "size", "source_size", "target", "copies"]
    return part.select(*cols).unionByName(whole.select(*cols))


def op4(spark, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents, one row each; see copies()."""
    got = copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
