"""What the operators share: reading tables, cutting lineage, ranks without hot tasks, connected components."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANK_CELLS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a session on one machine (as in tests) gets a new temporary one;
    a cluster has no folder of which this could tell that all executors see it, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else ""
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a Parquet table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str) -> DataFrame:
    """mapInArrow where fn turns one batch into one or more dicts of columns (numpy arrays, lists or Arrow arrays)."""
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(types)

    def run(batches):
        for batch in batches:
            got = fn(batch)
            for cols in [got] if isinstance(got, dict) else got:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for f, c in ((f, cols[f.name]) for f in out)], schema=out)

    return df.mapInArrow(run, types)


def hashed(seed: str, *cols) -> Column:
    """A reproducible random long in [0, 2^52) from the row's own values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12)


def comparable(df: DataFrame) -> list[Column]:
    """df's columns, those with maps, which can be neither hashed nor sorted, as JSON text."""
    return [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes]


def row_names(df: DataFrame) -> dict[str, Column]:
    """Two hashes of all values of a row, as columns _a and _b: only rows equal in every column share both. Never null. Columns
    with maps count by their JSON text."""
    values = [F.isnull(c) for c in df.columns] + comparable(df)
    return {"_a": F.xxhash64(*values), "_b": F.xxhash64(F.lit("row"), *values)}


def shared(spark: SparkSession, value) -> Callable:
    """A function that gives value in tasks: broadcast, with its class travelling by value, and unpacked once a worker."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(packed, "_unpacked"):
            packed._unpacked = pickle.loads(packed.value)
        return packed._unpacked

    return get


def thinned(rows: DataFrame, column: str, expected: int, seed: str, key: str) -> Column:
    """A condition that keeps, of each value of column, all rows or about `expected` of them, chosen by hash of the key.

    column is a label with few values; only their counts reach the driver.
    """
    counts = rows.groupBy(column).count().collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(column).eqNullSafe(F.lit(r[column])), F.lit(min(1.0, expected / r["count"]))).otherwise(share)
    return hashed(seed, key) / float(1 << 52) < share


def ranked(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Adds the 0-based rank of each row inside its (never null) keys by the random long `order` of hashed().

    No key lands in one task: a key's rows fall into 1024 cells by the high bits of `order`, each cell is sorted alone
    and starts at the summed count of the cells before it. Rows that tie share all the values that made `order`.
    """
    cells = df.withColumn("_cell", F.shiftright(order, 42).cast("int"))
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(order))
    return cells.withColumn("_in", inside).join(starts, [*keys, "_cell"]).withColumn(out, F.col("_start") + F.col("_in") - 1).drop("_cell", "_start", "_in")


#: Slices that the edges of one node are dealt into; a hub's edges are spread over as many tasks.
SLICES = 64


def _with_least(e: DataFrame) -> DataFrame:
    """e(a, b) with m, the least b of each a. Nodes are dealt in slices of their edges by hash, so the slices of a hub's edges
    meet its m in different tasks; what is gathered of a node is one number a slice."""
    sliced = e.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SLICES)).cast("byte"))
    part = sliced.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("s").alias("slices"))
    return sliced.join(least.select("a", "m", F.explode("slices").alias("s")), ["a", "s"]).select("a", "b", "m")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): rows (node, component) for every node of an edge but the smallest of each component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round only needs the least neighbour of a node,
    so it is a partial aggregation and a join on slices of a node's edges: no task holds all edges of a hub. Every round is
    written to the shared folder. Ends when a round changes nothing.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(tidy(edges.select("a", "b")))
    seen = mark(e)
    for _ in range(most_rounds if seen[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = tidy(_with_least(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        e = stored(tidy(small))
        now = mark(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    if seen[0]:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


#: Rows of a key from which on it counts as hot in join_hot().
HOT_ROWS = 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row a key and says in its column n how many rows of left have the key.

    Rows of a hot key don't meet in one task: their rows of right are broadcast. There are at most rows / HOT_ROWS of them, and
    beyond 100,000 (10^10 rows) only those of at least rows / 100,000 rows count as hot.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    limit = max(HOT_ROWS, total // 100_000)
    hot = stored(right.where(F.col(n) > limit))
    if hot.isEmpty():
        return left.join(right.drop(n), key, how)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(n) <= limit).drop(n), key, how)
    return cold.unionByName(left.join(F.broadcast(hot.drop(n)), key))


def shielded(df: DataFrame, *keep: str) -> DataFrame:
    """df with its columns, but for `keep`, under names that clash with no working column. toDF(*df.columns) undoes it."""
    return df.toDF(*[c if c in keep else f"_{i}_" for i, c in enumerate(df.columns)])


def replacing(df: DataFrame, made: list[str], *keep: str) -> tuple[DataFrame, list[str]]:
    """df shielded, without the columns that the new columns `made` replace, and the names for toDF() once those follow.

    Names are compared as Spark's writers do, whatever their case. A column of `keep` stays under its name for the work to use.
    """
    rows = shielded(df, *keep)
    pairs = [(c, k) for c, k in zip(rows.columns, df.columns) if k.lower() not in {m.lower() for m in made}]
    return rows.select(*[c for c, _ in pairs]), [k for _, k in pairs] + made


def split_hot(keyed: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """Adds the column `part` to keyed(key, node, ...): all rows of a key whose count is at most limit share part 0.

    A larger key is cut into chunks of about limit / 2 rows, and each pair of its chunks gets a part of its own, so every
    pair of rows still meets and no task holds more than about limit rows of a key.
    """
    big = stored(counts.where(F.col("count") > limit).select("key", F.ceil(F.col("count") * 2 / limit).cast("int").alias("chunks")))
    if big.isEmpty():
        return keyed.withColumn("part", F.lit(0))
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j))
    return keyed.join(big, "key", "left").withColumn("part", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pair))).drop("chunks")


def in_runs(df: DataFrame, fn: Callable[[dict], list[tuple]], schema: str, columns: list[str]) -> DataFrame:
    """Deals df by (key, part), sorts, and hands fn numpy columns holding whole runs of equal (key, part).

    fn gets a dict of arrays with `starts` and `sizes` of its runs and returns a dict of output columns. Runs that end
    inside a batch are processed at once; only the last, open run is carried over, and put together once, when it ends.
    """
    import numpy as np
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def values(column):
        return np.array(column.to_pylist(), dtype=object) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)

    def run(batches):
        held: list[dict] = []  # the open run, in pieces

        def work(parts):
            cols = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in columns}
            k, p = cols["key"], cols["part"]
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])])
            got = fn(cols | {"starts": starts, "sizes": np.diff(np.r_[starts, len(k)])})
            return pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in out], schema=out)

        for batch in batches:
            cols = {c: values(batch.column(c)) for c in columns}
            k, p = cols["key"], cols["part"]
            if not len(k):
                continue
            other = np.flatnonzero((k != k[-1]) | (p != p[-1]))
            open_from = other[-1] + 1 if len(other) else 0
            goes_on = held and held[-1]["key"][-1] == k[0] and held[-1]["part"][-1] == p[0]
            if open_from or not goes_on and held:
                ended = held + ([{c: v[:open_from] for c, v in cols.items()}] if open_from else [])
                held = []
                yield work(ended)
            held.append({c: v[open_from:] for c, v in cols.items()})
        if held:
            yield work(held)

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*columns).repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(run, df.sparkSession.createDataFrame([], schema).schema)
