"""Nearest vectors by cosine: a running first k for exact search, and inverted lists that read only the cells near a query."""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_folder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package path

#: Vectors that a task multiplies with the queries at once.
ROWS = 1024
#: Vectors that coarse cells are fitted on and queries that the number of probes is measured with, at most, chosen by hash.
SAMPLE, MEASURED, ROUNDS = 20_000, 200, 12
#: Rows of one file of a list.
FILE_ROWS = 1_000_000


class Nearest:
    """The first k of each query among the vectors that add() is given: by cosine rounded to six places, then by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.query, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf)

    def add(self, own: np.ndarray, v: np.ndarray, live: np.ndarray | None = None) -> None:
        """own, v: ids and unit vectors. live: numbers of the queries that meet them, else all. A query does not find its own id."""
        live = np.arange(len(self.ids)) if live is None else live
        for i in range(0, len(own), ROWS):
            ids = own[i : i + ROWS]
            s = np.round(self.vectors[live] @ v[i : i + ROWS].T, 6)
            s[self.ids[live][:, None] == ids[None]] = -np.inf
            bar = self.least[live]
            if len(ids) > self.k:
                bar = np.maximum(bar, np.partition(s, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            q, c = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
            if len(q):
                self._merge(live[q], s[q, c], ids[c])

    def _merge(self, query, score, found) -> None:
        query, score, found = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.found, found])
        order = np.lexsort([found, -score, query])
        query, score, found = query[order], score[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        full = rank == self.k - 1
        self.least[query[full]] = score[full]
        keep = rank < self.k
        self.query, self.score, self.found = query[keep], score[keep], found[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.query], self.found, self.score


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *extra: Column) -> DataFrame:
    """(key, v, extra): vectors of length one in doubles; null and zero vectors are left out."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.where(F.col(vector).isNotNull()).withColumn("_n", norm).where("_n > 0").select(key, F.transform(vector, lambda x: x.cast("double") / F.col("_n")).alias("v"), *extra)


def coarse(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means. A cell that loses all its vectors takes the one that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = sample @ c.T
        cell, fit = near.argmax(1), near.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, sample)
        lost = np.flatnonzero(np.bincount(cell, minlength=lists) == 0)
        sums[lost] = sample[np.argsort(fit, kind="stable")[: len(lost)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
    return c


@dataclass
class Lists:
    """Inverted lists: unit vectors as Parquet, partitioned by the cell of their nearest centroid."""

    path: str
    centroids: np.ndarray
    probes: int
    recall: float

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("vec_id long, v array<double>, list int").parquet(self.path)


def build(vectors: DataFrame, lists: int | None = None, recall: float = 0.95, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> Lists:
    """Inverted lists of vectors(key, vector), in the shared folder, with the probes that reach `recall`.

    Cells are fitted on at most SAMPLE vectors; every vector is stored. lists: about the root of the number of vectors by
    default. Rows of a list are dealt over several tasks by hash, so one list may hold any share of them. The number of probes is
    the least with which at most MEASURED vectors, as queries, find a share of their exact first k that is two standard errors
    over `recall`; with all lists the search is exact. No vectors: one list and no rows.
    """
    spark = vectors.sparkSession
    ready = stored(unit(vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v_")), "vec_id", "v_"))
    n = ready.count()
    chance = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = matrix(ready.where(chance("cells") < min(1.0, SAMPLE / max(n, 1))).orderBy("vec_id").select("v").toArrow().column(0).combine_chunks())
    lists = max(1, min(len(sample), round(n**0.5) if lists is None else lists))
    centroids = coarse(sample, lists) if len(sample) else np.zeros((1, 0))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        c = shared.value
        for batch in batches:
            cell = (matrix(batch.column(1)) @ c.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "list"])

    path = f"{shared_folder(spark)}/tessera-lists-{uuid.uuid4().hex}"
    dealt = ready.mapInArrow(assign, "vec_id long, v array<double>, list int").repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // FILE_ROWS))))
    dealt.write.partitionBy("list").option("compression", "zstd").parquet(path)
    made = Lists(path, centroids, lists, 1.0)
    asked = stored(ready.where(chance("probes") < min(1.0, MEASURED / max(n, 1))))
    exact = stored(first(search(made, asked, k, lists), k).select("query_id", "vec_id"))
    told = made.table(spark).select("vec_id", "list").join(F.broadcast(exact), "vec_id").select("query_id", "list").toPandas()
    if len(told):
        queries = asked.orderBy("vec_id").toArrow()
        order = np.argsort(-(matrix(queries.column(1).combine_chunks()) @ centroids.T), axis=1, kind="stable")
        at = np.argsort(order, axis=1)[np.searchsorted(queries.column(0).to_numpy(), told["query_id"]), told["list"]]
        share = np.cumsum(np.bincount(at, minlength=lists)) / len(at)
        sure = share - 2 * np.sqrt(share * (1 - share) / len(queries))  # what so few queries can tell
        made.probes = int(np.argmax(sure >= recall)) + 1
        made.recall = float(share[made.probes - 1])
    return made


def search(index: Lists, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score): of each task the first k vectors in the lists that a query probes, for queries(vec_id, v) of unit
    length. Queries go out in blocks; a block reads the partitions of its lists only, and a list meets the queries that probe it."""
    spark = queries.sparkSession
    probes = min(index.probes if probes is None else probes, len(index.centroids))
    asked = stored(queries.select("vec_id", "v"))
    parts = max(1, -(-asked.count() // block))

    def one(p: int) -> DataFrame:
        told = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p).orderBy("vec_id").toArrow()
        ids, q = told.column(0).to_numpy(), matrix(told.column(1).combine_chunks())
        near = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")[:, :probes] if len(ids) and index.centroids.size else np.zeros((len(ids), probes), np.int64)
        wanted = np.unique(near)
        members = {int(c): np.flatnonzero((near == c).any(1)) for c in wanted}
        shared = spark.sparkContext.broadcast((ids, q, members))

        def scan(batches):
            ids, q, members = shared.value
            state = Nearest(ids, q, k)
            for batch in batches:
                lists = batch.column(2).to_numpy()
                own, v = batch.column(0).to_numpy(), matrix(batch.column(1))
                for c in np.unique(lists):
                    at = np.flatnonzero(lists == c)
                    state.add(own[at], v[at], members[int(c)])
            query, found, score = state.rows()
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

        table = index.table(spark)
        read = table if len(wanted) == len(index.centroids) else table.where(F.col("list").isin(*[int(c) for c in wanted]))
        return read.select("vec_id", "v", "list").mapInArrow(scan, "query_id long, vec_id long, score double")

    found = one(0) if parts == 1 else stored(one(0))
    for p in range(1, parts):
        found = found.unionByName(stored(one(p)))
    return found


def first(found: DataFrame, k: int) -> DataFrame:
    from .retrieval import top

    return top(found, ["query_id"], k, ["vec_id"])
