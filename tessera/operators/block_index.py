"""A block-max index: chunks lie in blocks, each an inverted list of its own with the highest count of every term, and searches keep
their first k where the blocks lie.

A block is one row: the keys and lengths of up to BLOCK chunks, its terms, per term the highest count and the least length among
the chunks that hold it, and the postings. A search sends the asked terms out. A task walks its blocks with a running k-th score of
each query: the highest counts bound what a query can reach in a block, and where that is below its k-th score the block is
not scored for it. So what is shuffled is tasks x queries x k rows, not every chunk that shares a word with a query.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package path

#: Chunks of a block.
BLOCK = 256
#: Bytes of a row group of an index. A block takes some 200 kB, several times that once it is decoded.
GROUP = 4 << 20
#: (query, term) pairs that travel to the tasks at once; more queries are searched one part after the other.
ASKED = 100_000
_NULL = -(1 << 63)
_KINDS = {"bigint": "long", "int": "int", "smallint": "short", "string": "string"}


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays([pa.array(r, kind) for r in rows]) if rows else pa.array([], kind))


def blocks(chunks: DataFrame, keys: list[str], tokens: Column | None = None, size: int = BLOCK) -> DataFrame:
    """The block-max index of chunks(keys, content), written once to the shared folder, without a shuffle.

    One row a block: its number, each key as an array, norm array<double> (the chunks' words), terms, peak and low (per term the highest count
    and the least norm), starts (of each term's postings), rows and tfs. keys: integers or strings. tokens: an array column,
    else words() of content. No chunks: no blocks.
    """
    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"`{k}` array<{_KINDS[kinds[k]]}>" for k in keys) + ", norm array<double>, terms array<string>, peak array<int>, low array<double>, starts array<int>, rows array<int>, tfs array<int>"

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                listed = part.column(len(keys))
                told = listed.flatten().dictionary_encode()
                names = told.dictionary
                order = pc.sort_indices(names).to_numpy()
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                counts = pc.fill_null(pc.list_value_length(listed), 0).to_numpy()
                row = np.repeat(np.arange(part.num_rows), counts)
                pairs, tf = np.unique(place[told.indices.to_numpy()] * size + row, return_counts=True)
                term, row = pairs // size, pairs % size
                starts = np.searchsorted(term, np.arange(len(names) + 1))
                norm = counts.astype(np.float64)
                peak = np.maximum.reduceat(tf, starts[:-1]) if len(tf) else tf
                low = np.minimum.reduceat(norm[row], starts[:-1]) if len(tf) else norm[:0]
                given = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays(
                    [*given, _lists([norm], pa.float64()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names.take(pa.array(order))), _lists([peak], pa.int32()), _lists([low], pa.float64()),
                     _lists([starts], pa.int32()), _lists([row], pa.int32()), _lists([tf], pa.int32())],
                    names=[*keys, "norm", "terms", "peak", "low", "starts", "rows", "tfs"],
                )

    rows = chunks.select(*keys, (words(F.col("content")) if tokens is None else tokens).alias("tokens")).mapInArrow(run, schema)
    return stored(rows.withColumn("block", F.monotonically_increasing_id()), GROUP)


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df). A block's count of a term is the distance between two starts, so a row of a block stands for up to BLOCK postings."""
    each = index.select(F.posexplode("terms").alias("i", "term"), "starts")
    return each.groupBy("term").agg(F.sum(F.get("starts", F.col("i") + 1) - F.get("starts", F.col("i"))).alias("df"))


def statistics(index: DataFrame) -> DataFrame:
    """One row (n, avgdl) of an index whose norms are lengths in words."""
    total = F.aggregate("norm", F.lit(0.0), lambda s, x: s + x)
    return index.agg(F.coalesce(F.sum(F.size("norm")), F.lit(0)).alias("n"), (F.sum(total) / F.sum(F.size("norm"))).alias("avgdl"))


def _flat(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def with_lengths(index: DataFrame, idf: DataFrame, most: int = 1_000_000) -> DataFrame:
    """index with the lengths of the chunks' tf * idf vectors as norms, stored. idf(term, idf); terms without one count nothing.
    A chunk of no length gets an infinite norm: it scores 0 for every query.

    Up to `most` terms travel to every task. More are joined with the blocks' terms, a row per term and block, and the index meets the
    weights of its blocks: work and shuffle grow with the index, whatever is asked.
    """
    names, schema = index.columns, index.schema
    few = idf.limit(most + 1).count() <= most
    if few:
        told = idf.orderBy("term").toArrow()
        shared = index.sparkSession.sparkContext.broadcast((told.column("term").combine_chunks(), told.column("idf").to_numpy()))
    else:
        each = index.select("block", F.posexplode("terms").alias("i", "term")).join(idf, "term", "left").select("block", "i", F.coalesce("idf", F.lit(0.0)).alias("w"))
        weights = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("w"))
        index = index.join(weights, "block", "left").select(*names, F.coalesce("w", F.array().cast("array<double>")).alias("w"))

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n) for n in ("norm", "terms", "starts", "rows", "tfs")}
            norms, lows, ends = [], [], np.concatenate([[0], np.cumsum(pc.list_value_length(cols["terms"]).to_numpy())])
            if few:  # one look-up of all blocks of the batch: each builds a table of the vocabulary
                vocabulary, weight = shared.value
                at = pc.index_in(cols["terms"].flatten(), value_set=vocabulary)
                every = np.where(at.is_valid().to_numpy(zero_copy_only=False), weight[at.fill_null(0).to_numpy()] if len(weight) else 0.0, 0.0)
            else:
                every = batch.column("w").flatten().to_numpy()
            for i in range(batch.num_rows):
                starts, row, tf = _flat(cols["starts"], i), _flat(cols["rows"], i), _flat(cols["tfs"], i)
                length = np.sqrt(np.bincount(row, (tf * np.repeat(every[ends[i] : ends[i + 1]], np.diff(starts))) ** 2, minlength=len(cols["norm"][i])))
                norms.append(np.where(length > 0, length, np.inf))
                lows.append(np.minimum.reduceat(norms[-1][row], starts[:-1]) if len(row) else norms[-1][:0])
            new = {"norm": _lists(norms, pa.float64()), "low": _lists(lows, pa.float64())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return stored(index.mapInArrow(run, schema), GROUP)


def bm25_weight(avgdl: float, k1: float = 1.2, b: float = 0.75):
    """Weight of a term in a chunk by its count and the chunk's length; rises with the first, falls with the second."""
    return lambda tf, norm: tf * (k1 + 1) / (tf + k1 * (1 - b + b * norm / avgdl))


def cosine_weight():
    return lambda tf, norm: tf / norm


class Search:
    """First k of each query over the blocks that scan() is given: a running k-th score a query, ties by key."""

    def __init__(self, terms: pa.Array, term: np.ndarray, query: np.ndarray, weight: np.ndarray, queries: int, keys: int, k: int, formula, once: bool = False):
        """terms: sorted asked terms; term, query, weight: the asked pairs, by term; queries: how many; once: chunks of equal keys count
        as one, by their best score."""
        self.once = once
        self.terms, self.query, self.weight, self.k, self.formula = terms, query, weight, k, formula
        self.starts = np.searchsorted(term, np.arange(len(terms) + 1))
        self.least = np.full(queries, -np.inf)
        self.best: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), *[None] * keys]
        self.signed = bool(np.any(weight <= 0))
        self.scored = self.skipped = 0

    def scan(self, names: pa.Array, peak: np.ndarray, low: np.ndarray, postings, keys) -> None:
        """One block. postings() gives (starts, rows, tfs, norm), keys() its key arrays; neither is called for a block that no query needs."""
        at = pc.index_in(names, value_set=self.terms)
        local = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        if not len(local):
            return
        asked = at.fill_null(0).to_numpy()[local]
        n = self.starts[asked + 1] - self.starts[asked]
        column = np.repeat(np.arange(len(local)), n)  # of each asked pair that the block knows
        pair = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[asked], n)
        query, weight = self.query[pair], self.weight[pair]
        bound = np.bincount(query, np.maximum(weight, 0) * self.formula(peak[local], low[local])[column], minlength=len(self.least))
        met = np.zeros(len(self.least), bool)
        met[query] = True
        open_ = met & (bound + 1e-5 >= self.least)
        self.skipped += int(met.sum() - open_.sum())
        live = np.flatnonzero(open_)
        if not len(live):
            return
        self.scored += len(live)
        starts, row, tf, norm = postings()
        given = [np.concatenate([g, more]) if g is not None else more for g, more in zip(self.best[2:], keys())] if self.best[2] is not None else list(keys())
        size = starts[local + 1] - starts[local]
        post = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[local], size)
        chunk = np.zeros((len(local), len(norm)))
        chunk[np.repeat(np.arange(len(local)), size), row[post]] = self.formula(tf[post], norm[row[post]])
        place = np.full(len(self.least), -1)
        place[live] = np.arange(len(live))
        mine = place[query] >= 0
        side = np.zeros((len(live), len(local)))
        side[place[query[mine]], column[mine]] = weight[mine]
        score = side @ chunk
        if self.signed:  # a chunk with a word of the question is found whatever the word weighs, be it nothing
            asks = np.zeros(side.shape, np.float32)
            asks[place[query[mine]], column[mine]] = 1
            shares = asks @ (chunk != 0).astype(np.float32) > 0
        else:
            shares = score > 0
        q, c = np.nonzero(shares & (np.round(score, 6) >= self.least[live][:, None]))
        if not len(q):
            return
        first = len(self.best[0])
        queries, raw = np.concatenate([self.best[0], live[q]]), np.concatenate([self.best[1], score[q, c]])
        pick = np.concatenate([np.arange(first), first + c])
        columns = [g[pick] for g in given]
        order = np.lexsort([*columns[::-1], -np.round(raw, 6), queries])
        if self.once:
            by = np.lexsort([-raw, *columns, queries])
            again = np.logical_and.reduce([c[by][1:] == c[by][:-1] for c in (queries, *columns)])
            best = np.ones(len(by), bool)
            best[by[1:][again]] = False
            order = order[best[order]]
        queries = queries[order]
        rank = np.arange(len(order)) - np.searchsorted(queries, queries)
        keep = order[rank < self.k]
        self.best = [np.concatenate([self.best[0], live[q]])[keep], raw[keep], *[g[keep] for g in columns]]
        full = rank == self.k - 1
        self.least[queries[full]] = np.round(raw, 6)[order[full]]


def top_k(index: DataFrame, asked: DataFrame, keys: list[str], formula, k: int = 10, once: bool = False) -> DataFrame:
    """(query_id, keys, score): of each task the first k chunks of each query, by score rounded to six places and keys. Their first
    k by query are the first k of all. asked(query_id long, term, weight): score is the sum of weight * formula(count, norm).
    once: a task gives equal keys once, with their best score, so of first k keys by their best scores over all tasks none is lost.

    Asked pairs are dealt by query into parts of about ASKED pairs, one search each; only one part is in the driver.
    """
    spark = index.sparkSession
    asked = stored(asked.select("query_id", "term", F.col("weight").cast("double").alias("weight")))
    parts = max(1, -(-asked.count() // ASKED))
    kinds = {k_: dict(index.dtypes)[k_][len("array<") : -1] for k_ in keys}
    schema = "query_id long, " + ", ".join(f"`{k_}` {kinds[k_]}" for k_ in keys) + ", score double"

    def one(p: int) -> DataFrame:
        told = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("term", "query_id").toArrow()
        names = pc.unique(told.column("term").combine_chunks())
        ids, query = np.unique(told.column("query_id").to_numpy(), return_inverse=True)
        term = pc.index_in(told.column("term").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        shared = spark.sparkContext.broadcast((names, term, query.ravel(), told.column("weight").to_numpy(), ids))

        def search(batches):
            names, term, query, weight, ids = shared.value
            state = Search(names, term, query, weight, len(ids), len(keys), k, formula, once)

            def key(column):
                values = column.values
                return np.array(["" if x is None else f"={x}" for x in values.to_pylist()]) if pa.types.is_string(values.type) else values.cast(pa.int64()).fill_null(_NULL).to_numpy()

            for batch in batches:
                cols = {n: batch.column(n) for n in batch.schema.names}
                for i in range(batch.num_rows):
                    state.scan(
                        cols["terms"][i].values, _flat(cols["peak"], i), _flat(cols["low"], i),
                        lambda: tuple(_flat(cols[n], i) for n in ("starts", "rows", "tfs", "norm")), lambda: [key(cols[n][i]) for n in keys],
                    )
            if len(state.best[0]):
                given = [pa.array(v, mask=v == _NULL) if v.dtype.kind == "i" else pa.array([x[1:] if x else None for x in v.tolist()], pa.string()) for v in state.best[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[state.best[0]]), *[g.cast(to) for g, to in zip(given, types)], pa.array(state.best[1])], names=["query_id", *keys, "score"])

        types = [{"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kinds[n]] for n in keys]
        return index.mapInArrow(search, schema)

    found = one(0) if parts == 1 else stored(one(0))
    for p in range(1, parts):
        found = found.unionByName(stored(one(p)))
    return found
