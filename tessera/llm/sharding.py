"""Sharding: a uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows fall into blocks by a hash of their own values. How many rows of each block go to each shard is drawn from the
multivariate hypergeometric law, which is the law of a uniform random permutation cut into the shards. Then each block is
permuted alone and dealt out by its row of the matrix, rows are exchanged, and each shard is permuted again. Only the
block counts (at most 2^15 numbers) and the matrix meet in one place; rows are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed, ranked, replacing, stored, table

SHARDS = 8
BLOCK_ROWS = 4096
MOST_DEPTH = 15


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """One draw by inversion: of `total` items `good` are marked and `draws` are taken; u is uniform in [0, 1).

    Weights relative to the mode are followed up and down by the ratio of neighbouring terms, as far as ten standard
    deviations (what lies beyond is less than double precision resolves), and the scaled u is looked up among them.
    """
    zero = F.lit(0).cast("long")

    def around(p: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), p["draws"] + p["good"] - p["total"]), F.least(p["draws"], p["good"])
        mode = F.least(high, F.greatest(low, F.floor((p["draws"] + 1) * (p["good"] + 1) / (p["total"] + 2)).cast("double")))
        share = p["good"] / F.greatest(p["total"], F.lit(1.0))
        wide = F.ceil(F.sqrt(p["draws"] * share * (1 - share)) * 10) + 30
        return F.struct(*(p[k].alias(k) for k in ("total", "good", "draws", "u")), mode.alias("mode"), F.least(wide, high - mode).cast("long").alias("ups"), F.least(wide, mode - low).cast("long").alias("downs"))

    def steps(n: Column) -> Column:
        return F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<bigint>"))

    def pick(p: Column) -> Column:
        def up(w: Column, i: Column) -> Column:
            k = p["mode"] + i
            return w * (p["good"] - k) * (p["draws"] - k) / ((k + 1) * (p["total"] - p["good"] - p["draws"] + k + 1))

        def down(w: Column, i: Column) -> Column:
            k = p["mode"] - i
            return w * k * (p["total"] - p["good"] - p["draws"] + k) / ((p["good"] - k + 1) * (p["draws"] - k + 1))

        def sums(n: Column, ratio) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("all"))
            return F.aggregate(steps(n), start, lambda a, i: _let(ratio(a["w"], i), lambda w: F.struct(w.alias("w"), F.concat(a["all"], F.array(w)).alias("all"))), lambda a: a["all"])

        def summed(ws: Column) -> Column:
            return F.aggregate(ws, F.lit(0.0), lambda s, w: s + w)

        def passed(ws: Column, goal: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("s"), zero.alias("n"))
            return F.aggregate(ws, start, lambda a, w: F.struct((a["s"] + w).alias("s"), (a["n"] + F.when(a["s"] <= goal, 1).otherwise(0)).alias("n")), lambda a: a["n"])

        def choose(ws: Column) -> Column:
            def found(t: Column) -> Column:
                step = F.when(t["goal"] < 1, zero).when(t["goal"] < 1 + t["above"], passed(ws["up"], t["goal"] - 1)).otherwise(-passed(ws["down"], t["goal"] - 1 - t["above"]))
                return p["mode"].cast("long") + step

            above = summed(ws["up"])
            return _let(F.struct((p["u"] * (1 + above + summed(ws["down"]))).alias("goal"), above.alias("above")), found)

        return _let(F.struct(sums(p["ups"], up).alias("up"), sums(p["downs"], down).alias("down")), choose)

    given = F.struct(*(c.cast("double").alias(k) for k, c in (("total", total), ("good", good), ("draws", draws), ("u", u))))
    return _let(given, lambda g: _let(around(g), pick))


def matrix(blocks: DataFrame, depth: int, shards: int, seed: str) -> DataFrame:
    """Rows (block, ends): ends[s] rows of the block, in its permuted order, go to shards 0 to s.

    blocks: (block, n). The 2^depth blocks are halved again and again; each half's count from each shard is drawn given
    its parent's, so a level's draws are independent and depth levels suffice.
    """
    listed = F.array_sort(F.collect_list(F.struct("block", "n")))
    spread = F.map_from_arrays(F.transform(listed, lambda x: x["block"]), F.transform(listed, lambda x: x["n"]))
    one = blocks.agg(spread.alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    counts = F.transform(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0).cast("long")))
    caps = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("all") / shards).cast("long") + F.when(s < F.col("all") % shards, 1).otherwise(0))
    node = one.select(F.lit(0).alias("node"), counts.alias("counts"), caps.alias("caps"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    for level in range(depth):
        half = 1 << (depth - level - 1)
        node = node.select("node", "caps", F.slice("counts", 1, half).alias("left"), F.slice("counts", half + 1, half).alias("right"))
        state = F.struct(total(F.col("caps")).alias("rest"), total(F.col("left")).alias("draws"), F.array().cast("array<bigint>").alias("got"))

        at = F.lit(f"{seed}/{level}")

        def deal(a: Column, s: Column) -> Column:
            good = F.col("caps")[s]
            u = F.shiftrightunsigned(F.xxhash64(at, F.col("node"), s), 11) / F.lit(float(1 << 53))
            return _let(hypergeometric(a["rest"], good, a["draws"], u), lambda k: F.struct((a["rest"] - good).alias("rest"), (a["draws"] - k).alias("draws"), F.concat(a["got"], F.array(k)).alias("got")))

        drawn = F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), state, deal, lambda a: a["got"])
        node = node.withColumn("got", drawn)
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts"), F.col("got").alias("caps")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("right").alias("counts"), F.zip_with("caps", "got", lambda a, b: a - b).alias("caps")))
        node = stored(node.select(F.inline(sides)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: total(F.slice("caps", F.lit(1), s)))
    return node.select(F.col("node").alias("block"), ends.alias("ends"))


def shard(rows: DataFrame, by: list[str], shards: int = SHARDS, seed: str = "shuffle", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    by: the columns whose values drive the permutations; give ones that tell rows apart, null or not. Rows equal in all of
    them are interchangeable. Shard sizes differ by one at most. Empty input gives no rows. Columns of rows named shard or
    slot, in any case, are replaced, all others kept; those of `by` must not be among these. The result depends on the
    rows and the seed alone, not on files, partitions or retries. rows is read twice: store it first if it is dear.
    """
    given = rows.columns
    by = [f"_{given.index(c)}_" for c in by]
    rows, names = replacing(rows, ["shard", "slot"])
    n = rows.count()
    depth = min(MOST_DEPTH, max(0, (max(n, 1) // block_rows).bit_length()))
    made = rows.withColumns({"_b": F.shiftright(hashed(f"{seed}/block", *by), 52 - depth).cast("int") if depth else F.lit(0), "_r1": hashed(f"{seed}/first", *by), "_r2": hashed(f"{seed}/second", *by)})
    dealt = matrix(made.groupBy(F.col("_b").alias("block")).agg(F.count("*").alias("n")), depth, shards, seed)
    dealt = dealt.withColumnRenamed("block", "_b")
    small = (1 << depth) * shards <= 1 << 20  # 8 MB of longs
    placed = ranked(made, ["_b"], "_r1", "_p").join(F.broadcast(dealt) if small else dealt, "_b")
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_p"))).cast("int")).drop("ends", "_p", "_b", "_r1")
    return ranked(stored(placed), ["shard"], "_r2", "slot").select(*rows.columns, "shard", "slot").toDF(*names)


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law `rows`; see shard(). Equal texts are rows like any other and spread evenly; null
    texts have size 1, and long ones weigh no more than short ones."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")))
    out = shard(slim, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
