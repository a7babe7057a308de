"""TF-IDF search over the windows of texts, for many ways of cutting at once.

Windows of one text overlap and those of other sizes cover the same words again, so texts are neither cut nor tokenised window by window:
a text's words are found once, with where they stand, and each window is told from that; only words that a window's ends cut are words
of their own. Tables of frequencies are shuffled, of the search each task's first k. No index is written.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BETWEEN
from ..sources import stored
from .set_join import small

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package path

#: Bytes of text that a task takes apart at once.
PIECE = 1 << 19
#: Rows of frequencies that a task sums before it gives them out.
SUMMED = 200_000
#: Frequencies (terms of two documents or more, times ways of cutting) that travel to the tasks, about 8 bytes each.
TRAVEL = 32_000_000
#: Pairs of window and query that are scored at once.
CELLS = 125_000
#: Characters whose lower case depends on what stands around them, or is longer: windows of such texts are lowered one by one.
ODD = "İΣ"
_NULL = -(1 << 63)


def fixed(size: int, ratio: float = 0.0) -> tuple[int, int, int]:
    """(size, step, rest) of chunking.fixed_ratio(): the last window starts before the last `rest` characters, and never before 0."""
    return size, size - int(size * ratio), 0


def sliding(size: int = 500, overlap: int = 50) -> tuple[int, int, int]:
    """(size, step, rest) of chunking.sliding_stop()."""
    overlap = min(overlap, size - 1)
    return size, size - overlap, overlap


def kinds(spark) -> np.ndarray:
    """What each code point is in words(): 1 part of a word, 2 a Chinese character, 0 neither, by the expressions that words() uses."""
    points = spark.range(0x110000).where("id < 55296 OR id > 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    told = points.select("id", F.when(c.rlike("\\p{IsHan}"), 2).when(~c.rlike(BETWEEN), 1).otherwise(0).alias("kind")).where("kind > 0").toArrow()
    out = np.zeros(0x110000, np.uint8)
    out[told.column("id").to_numpy()] = told.column("kind").to_numpy()
    return out


def _cut_texts(length: np.ndarray, offset: np.ndarray, cut: tuple) -> tuple:
    """(text, start in it, start and end in the joined texts) of the windows of texts, which begin at offset."""
    size, step, rest = cut
    many = np.maximum(0, length - 1 - rest) // step + 1
    at = np.repeat(np.arange(len(length)), many)
    start = (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)) * step
    return at, start, offset[at] + start, offset[at] + np.minimum(start + size, length[at])


def _parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about PIECE bytes of text; a longer text is a slice of its own."""
    load = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + PIECE, "right")))
        yield batch.slice(i, j - i)
        i = j


class Piece:
    """The words of a few texts, and which of them, or parts of them, stand in which window."""

    def __init__(self, texts: list, odd: list, kind: np.ndarray, cuts: list[tuple]):
        """texts: in lower case, those that are odd as they are."""
        self.cuts = cuts
        segments, rows, single = [], [], []
        for row, (text, other) in enumerate(zip(texts, odd)):
            if not text:
                continue
            if not other:
                segments.append(text)
                rows.append(row)
                continue
            for c, (size, step, rest) in enumerate(cuts):
                for start in range(0, max(0, len(text) - 1 - rest) + 1, step):
                    single.append((len(segments), c, row, start, min(size, len(text) - start)))
                    segments.append(text[start : start + size].lower())
        n = np.array([len(s) for s in segments], np.int64)
        offset = np.cumsum(n + 1) - n - 1
        joined = "\n".join(segments)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.concatenate([[0], kind[points], [0]])
        edges = np.flatnonzero(np.diff((of == 1).view(np.int8)))
        self.runs = edges[::2], edges[1::2]
        pairs = np.flatnonzero((of[1:-2] == 2) & (of[2:-1] == 2)) if len(points) > 1 else edges[:0]
        long = self.runs[1] - self.runs[0] >= 2
        self.starts, self.ends = self.runs[0][long], self.runs[1][long]
        if len(pairs):
            order = np.argsort(np.concatenate([self.starts, pairs]), kind="stable")
            self.starts, self.ends = np.concatenate([self.starts, pairs])[order], np.concatenate([self.ends, pairs + 2])[order]
        inked = np.concatenate([[0], np.cumsum(points != 32)])
        plain = np.setdiff1d(np.arange(len(segments)), [s[0] for s in single])
        rows = np.array(rows, np.int64)
        self.windows = [self._windows(c, plain, rows, n, offset, [s for s in single if s[1] == c], inked) for c in range(len(cuts))]
        parts = [self._cut(*w[:2]) for w in self.windows]
        starts, ends = (np.concatenate([own, *[p[i] for p in parts]]) for i, own in ((1, self.starts), (2, self.ends)))
        told = _strings(joined, points, starts, ends).dictionary_encode()
        self.names, ids = told.dictionary, told.indices.to_numpy().astype(np.int64)
        self.ids, self.parts, at = ids[: len(self.starts)], [], len(self.starts)
        for p in parts:
            self.parts.append((p[0], ids[at : at + len(p[0])]))
            at += len(p[0])
        # the rows of a term's first and last occurrence
        row = np.empty(len(segments), np.int64)
        row[plain] = rows
        for s in single:
            row[s[0]] = s[2]
        row = row[np.searchsorted(offset, starts, "right") - 1]
        lowest, highest = np.full(len(self.names), len(texts)), np.full(len(self.names), -1)
        np.minimum.at(lowest, ids, row)
        np.maximum.at(highest, ids, row)
        self.several = highest > lowest

    def _windows(self, c: int, plain, rows, n, offset, single, inked):
        """(start and end in the joined texts, row, start in the row's text, index without blank windows, not blank), in their order."""
        at, start, a, b = _cut_texts(n[plain], offset[plain], self.cuts[c])
        row = rows[at]
        if single:
            one = np.array([(s[0], s[2], s[3]) for s in single], np.int64)
            a, b = np.concatenate([a, offset[one[:, 0]]]), np.concatenate([b, offset[one[:, 0]] + n[one[:, 0]]])
            row, start = np.concatenate([row, one[:, 1]]), np.concatenate([start, one[:, 2]])
            order = np.argsort(a, kind="stable")
            a, b, row, start = a[order], b[order], row[order], start[order]
        whole = inked[b] > inked[a]
        count = np.cumsum(whole)
        begins = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else whole
        before = np.where(begins, count - whole, 0)
        return a, b, row, start, count - 1 - np.maximum.accumulate(before) if len(row) else count, whole

    def _cut(self, a: np.ndarray, b: np.ndarray):
        """(window, start, end) of what is left of words that an end of a window cuts, if it has two characters at least."""
        starts, ends = self.runs
        if not len(starts) or not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = np.searchsorted(starts, a) - 1, np.searchsorted(starts, b) - 1
        w = np.flatnonzero((left >= 0) & (ends[left] > a))
        v = np.flatnonzero((right >= 0) & (ends[right] > b) & (starts[right] >= a))
        window, s, e = np.concatenate([w, v]), np.concatenate([a[w], starts[right[v]]]), np.concatenate([np.minimum(ends[left[w]], b[w]), b[v]])
        kept = e - s >= 2
        return window[kept], s[kept], e[kept]

    def counts(self, c: int):
        """(window, term, tf) of the terms of all windows, by window."""
        a, b = self.windows[c][:2]
        size, step, _ = self.cuts[c]
        v = max(1, len(self.names))
        if not len(a):
            return (np.zeros(0, np.int64),) * 3
        last = np.cumsum(np.bincount(np.searchsorted(self.starts, a), minlength=len(self.starts) + 1))[: len(self.starts)] - 1
        keys = [self.parts[c][0] * v + self.parts[c][1]]
        for back in range(-(-size // step)):
            window = last - back
            inside = (window >= 0) & (b[window] >= self.ends)
            keys.append(window[inside] * v + self.ids[inside])
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        tf = np.diff(np.append(first, len(key)))
        window = key[first] // v
        return window, key[first] - window * v, tf


def _strings(joined: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The substrings from starts to ends."""
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) > len(points):
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000))])
        starts, ends = at[starts], at[ends]
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    values = data[np.arange(to[-1]) + np.repeat(starts - to[:-1], size)]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(values))


def _pieces(batches, kind, cuts):
    """(keys, Piece) of batches(doc_id, text, odd)."""
    for batch in batches:
        for part in _parts(batch, 1):
            yield part.column(0), Piece(part.column(1).to_pylist(), part.column(2).to_pylist(), kind, cuts)


def _texts(docs: DataFrame) -> DataFrame:
    odd = F.coalesce(F.contains("text", F.lit(ODD[0])) | F.contains("text", F.lit(ODD[1])), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(odd, F.col("text")).otherwise(F.lower("text")).alias("text"), odd.alias("odd"))


def frequencies(docs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """(term, seen, n0, n1, ...), stored: in how many windows of each cut a term stands; seen is 1 for terms of one document. The row
    without a term has the numbers of windows that are not blank. docs(doc_id, text), a document a row."""
    spark = docs.sparkSession
    names = [f"n{c}" for c in range(len(cuts))]
    shared = spark.sparkContext.broadcast(kinds(spark))

    def run(batches):
        held, rows, windows = [], 0, np.zeros(len(cuts), np.int64)

        def summed():
            table = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([(n, "sum") for n in ("seen", *names)])
            return table.select(["term", *[f"{n}_sum" for n in ("seen", *names)]]).rename_columns(["term", "seen", *names])

        for _, piece in _pieces(batches, shared.value, cuts):
            windows += [int(w[5].sum()) for w in piece.windows]
            ns = [np.bincount(piece.counts(c)[1], minlength=len(piece.names)) for c in range(len(cuts))]
            held.append(pa.table([piece.names, pa.array(1 + piece.several), *[pa.array(n.astype(np.int32)) for n in ns]], names=["term", "seen", *names]))
            rows += len(piece.names)
            if rows > SUMMED:
                held = [summed()]
                rows = held[0].num_rows
                if rows > SUMMED // 2:
                    yield from held.pop().to_batches(50_000)
                    rows = 0
        if held:
            yield from summed().to_batches(50_000)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0]), *[pa.array([n]) for n in windows]], names=["term", "seen", *names])

    each = _texts(docs).mapInArrow(run, "term string, seen long, " + ", ".join(f"{n} long" for n in names))
    return stored(each.groupBy("term").agg(*[F.sum(n).alias(n) for n in ("seen", *names)]))


def _hash(names: pa.Array, seed: int) -> np.ndarray:
    """64 bits of each string: its bytes times random numbers by place."""
    names = names.cast(pa.large_string())
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    size = np.diff(ends)
    data = np.frombuffer(names.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(names) else np.zeros(0, np.uint8)
    factor = np.random.default_rng(seed).integers(1, 1 << 63, int(size.max(initial=1)), np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(names), np.uint64)
    for i in range(0, len(names), 100_000):
        j = min(len(names), i + 100_000)
        own = size[i:j]
        place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        part = (data[ends[i] - ends[0] : ends[j] - ends[0]].astype(np.uint64) + np.uint64(1)) * factor[place]
        some = own > 0
        if some.any():
            out[i:j][some] = np.add.reduceat(part, (np.cumsum(own) - own)[some])
    return out


def vocabulary(names: pa.Array, counts: np.ndarray) -> tuple:
    """What Vocabulary is made of: the first seed by which no two names share a hash, and hashes, names and counts by hash."""
    seed = 0
    while True:
        hashes = _hash(names, seed)
        order = np.argsort(hashes)
        hashes = hashes[order]
        if not np.any(hashes[1:] == hashes[:-1]):
            return seed, hashes, names.take(pa.array(order)), counts[order]
        seed += 1


class Vocabulary:
    """Frequencies by term: looked up by hash, then compared as strings."""

    def __init__(self, seed: int, hashes: np.ndarray, names: pa.Array, counts: np.ndarray):
        self.seed, self.hashes, self.names, self.counts = seed, hashes, names, counts

    def find(self, names: pa.Array) -> np.ndarray:
        """The row of each name, -1 for those that are not here."""
        if not len(self.hashes) or not len(names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.hashes, _hash(names, self.seed)), len(self.hashes) - 1)
        same = pc.equal(self.names.take(pa.array(at)), names).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)


class Asked:
    """The first k windows of each query under one way of cutting, over the pieces that scan() is given."""

    def __init__(self, term: np.ndarray, query: np.ndarray, weight: np.ndarray, terms: int, queries: int, k: int):
        """term, query, weight: the asked pairs, by term."""
        self.query, self.weight, self.queries, self.k = query, weight, queries, k
        self.starts = np.searchsorted(term, np.arange(terms + 1))
        self.least = np.full(queries, -np.inf)
        self.best = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def scan(self, window: np.ndarray, term: np.ndarray, value: np.ndarray, keys) -> None:
        """Windows (ascending) with their asked terms and tf / length. keys(windows) gives their key columns."""
        at = 0
        while at < len(window):
            first = window[at]
            # without a k-th score yet all that is met is kept, so the beginning goes in small steps
            step = max(1, (CELLS if np.isfinite(self.least).any() else CELLS // 64) // self.queries)
            end = int(np.searchsorted(window, first + step))
            part = term[at:end]
            many = self.starts[part + 1] - self.starts[part]
            pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[part], many)
            cell = np.repeat((window[at:end] - first) * self.queries, many) + self.query[pair]
            score = np.bincount(cell, np.repeat(value[at:end], many) * self.weight[pair], minlength=step * self.queries).reshape(step, self.queries)
            near = np.flatnonzero((score > 0) & (score + 1e-6 >= self.least))
            score, w, q = score.ravel()[near], near // self.queries, near % self.queries
            kept = np.flatnonzero(np.round(score, 6) >= self.least[q])
            if len(kept):
                self._keep(q[kept], score[kept], keys(first + w[kept]))
            at = end

    def _keep(self, query, score, columns) -> None:
        rows = [np.concatenate([a, b]) for a, b in zip(self.best, [query, score, *columns])]
        order = np.lexsort([rows[3], rows[2], -np.round(rows[1], 6), rows[0]])
        ranked = rows[0][order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        self.best = [r[order[rank < self.k]] for r in rows]
        full = rank == self.k - 1
        self.least[ranked[full]] = np.round(rows[1][order[full]], 6)


def tfidf(docs: DataFrame, queries: DataFrame, cuts: list[tuple], k: int = 10, counts: DataFrame | None = None) -> DataFrame | None:
    """(cut, query_id, doc_id, chunk_index, start, score, rank): retrieval.tfidf() of queries(item_id, text) over the windows of docs(doc_id, text),
    for each of cuts, which are numbered from 0. doc_id is an integer. counts: frequencies(), which are made unless they are given.

    Frequencies of terms that stand in several documents travel to the tasks; a term of one document has there all the windows that it
    has. None if more of them than TRAVEL would travel.
    """
    from . import block_index, retrieval

    spark, names = docs.sparkSession, [f"n{c}" for c in range(len(cuts))]
    counts = frequencies(docs, cuts) if counts is None else counts
    common = counts.where("term IS NOT NULL AND seen > 1").select("term", *[F.col(n).cast("int").alias(n) for n in names])
    if common.count() * len(cuts) > TRAVEL:
        return None
    total = np.array([counts.where("term IS NULL").select(*names).first() or [0] * len(cuts)], np.float64)[0]
    told = common.toArrow()
    shared = spark.sparkContext.broadcast((kinds(spark), vocabulary(told.column("term").combine_chunks(), np.stack([told.column(n).to_numpy() for n in names], axis=1))))
    asked = stored(counts.join(small(retrieval.query_terms(queries)), "term").select(F.col("query_id").cast("long").alias("query_id"), "term", "qtf", *names))
    parts = max(1, -(-asked.count() // block_index.ASKED))

    def one(p: int) -> DataFrame:
        pairs = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("term", "query_id").toArrow()
        wanted = pc.unique(pairs.column("term").combine_chunks())
        term = pc.index_in(pairs.column("term").combine_chunks(), value_set=wanted).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, query = np.unique(pairs.column("query_id").to_numpy(), return_inverse=True)
        qtf = pairs.column("qtf").to_numpy()
        asks = []
        for c, n in enumerate(names):  # a term that no window of this cut holds has no weight
            df = pairs.column(n).to_numpy()
            idf = np.where(df > 0, np.log((1 + total[c]) / (1 + df)) + 1, 0.0)
            length = np.sqrt(np.bincount(query, (qtf * idf) ** 2, minlength=len(ids)))[query]
            asks.append(qtf * idf / np.where(length > 0, length, 1.0) * idf)
        sent = spark.sparkContext.broadcast((wanted, term, query.ravel(), ids, asks))

        def run(batches):
            (kind, held), (wanted, term, query, ids, asks) = shared.value, sent.value
            known = Vocabulary(*held)
            states = [Asked(term, query, weight, len(wanted), len(ids), k) for weight in asks]
            for keys, piece in _pieces(batches, kind, cuts):
                keys = keys.fill_null(_NULL).to_numpy()
                row = known.find(piece.names)
                mine = pc.fill_null(pc.index_in(piece.names, value_set=wanted), -1).to_numpy().astype(np.int64)
                for c, state in enumerate(states):
                    window, t, tf = piece.counts(c)
                    df = np.where(row >= 0, known.counts[row, c] if len(known.counts) else 0, np.bincount(t, minlength=len(row)))
                    idf = np.log((1 + total[c]) / (1 + df)) + 1
                    length = np.sqrt(np.bincount(window, (tf * idf[t]) ** 2, minlength=len(piece.windows[c][0])))
                    hit = np.flatnonzero(mine[t] >= 0)
                    _, _, of, start, index, _ = piece.windows[c]
                    state.scan(window[hit], mine[t[hit]], tf[hit] / length[window[hit]], lambda w: [keys[of[w]], index[w], start[w]])
            for c, state in enumerate(states):
                q, score, doc, index, start = state.best
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), c, np.int32)), pa.array(ids[q]), pa.array(doc, mask=doc == _NULL), pa.array(index.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(score)], names=["cut", "query_id", "doc_id", "chunk_index", "start", "score"])

        return _texts(docs).mapInArrow(run, "cut int, query_id long, doc_id long, chunk_index int, start int, score double")

    found = one(0) if parts == 1 else stored(one(0))
    for p in range(1, parts):
        found = found.unionByName(stored(one(p)))
    return retrieval.top(found, ["cut", "query_id"], k, retrieval.KEYS).withColumn("score", F.round("score", 6))


def holding(docs: DataFrame, asked: DataFrame, cut: tuple) -> DataFrame:
    """(query_id, windows): how many windows of docs(text) hold at least `need`, over 0, of the characters of asked(query_id, characters, need); no row
    for none. Questions are a small stated set. Of a window it is told once which of their characters it has; a task gives its counts."""
    told = asked.select("query_id", "characters", F.col("need").cast("double").alias("need")).toArrow()
    lists = told.column("characters").to_pylist()
    place = {c: i for i, c in enumerate(sorted({c for x in lists for c in x}))}
    column = np.full(0x110000, len(place), np.int32)
    column[[ord(c) for c in place]] = np.arange(len(place))
    of = np.zeros((len(place) + 1, len(lists)), np.float32)
    for i, x in enumerate(lists):
        of[[place[c] for c in x], i] = 1
    shared = docs.sparkSession.sparkContext.broadcast((column, of, told.column("need").to_numpy(), told.column("query_id").to_numpy()))

    def run(batches):
        column, of, need, ids = shared.value
        width, hits = len(of), np.zeros(len(ids), np.int64)
        for batch in batches:
            for part in _parts(batch, 0):
                texts = [t for t in part.column(0).to_pylist() if t]
                n = np.array([len(t) for t in texts], np.int64)
                held = column[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
                _, _, a, b = _cut_texts(n, np.cumsum(n) - n, cut)
                step = max(1, 32 * CELLS // max(width, len(ids)))
                for i in range(0, len(a), step):
                    begin, size = a[i : i + step], (b - a)[i : i + step]
                    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
                    has = np.zeros(len(size) * width, np.float32)
                    has[np.repeat(np.arange(len(size)) * width, size) + held[at]] = 1
                    hits += (has.reshape(-1, width) @ of >= need).sum(axis=0)
        some = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(hits[some])], names=["query_id", "windows"])

    return docs.select("text").mapInArrow(run, "query_id long, windows long").groupBy("query_id").agg(F.sum("windows").alias("windows"))
