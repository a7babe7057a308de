"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random lines. The projections on each line are sorted; the window of a vector, as a query,
is the range of the sorted order that lies within a half-width around its own projection, found by binary search. Two vectors
collide on a line if the one stands in the window of the other. A pair is verified by exact cosine if it collides on at
least as many lines as a pair at the threshold does but for a chance of 1e-4 (binomial, checked on the lines drawn).

Counting collisions of all pairs would be quadratic, since a window that keeps a pair at the threshold holds a large part of
any line. So further lines come in groups: K lines cut at zero, the middle of their sorted order, deal the vectors into
cells, and only vectors that share the cell of one of T such groups are sorted together. K grows
with log2 of the number of vectors. No two groups share a line, and T is raised until random pairs at the threshold, put
through the lines that were drawn, meet as often as the wanted recall asks. Verified links are counted
in the first group where a pair meets, so no pair is counted twice and no list of pairs is ever written.
"""

from __future__ import annotations

from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, in_runs, join_hot, stored, table

THRESHOLD, RECALL = 0.9, 0.999
#: Vectors of a cell aimed at, lines whose windows are counted.
CELL, COUNT_LINES = 64, 32
#: Random pairs at the threshold that the drawn lines are tried on.
TRIALS = 20_000
#: Half-width of a window in standard deviations of the projected distance at the threshold.
WIDTH = 2.0
HOT_CELL = 4096


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(K, T): lines of a group, number of groups that the recall needs if they are independent."""
    k = min(40, max(4, ceil(log2(max(n, 2) / CELL))))
    p = (1 - acos(threshold) / pi) ** k
    return k, max(4, ceil(log(1 - recall) / log(1 - p)))


def least_count(lines: int, chance: float = 1e-4) -> int:
    """Largest l such that a pair at the threshold has fewer than l collisions with a probability below chance."""
    p = erf(WIDTH / sqrt(2))
    total = 0.0
    for l in range(lines + 1):
        total += comb(lines, l) * p**l * (1 - p) ** (lines - l)
        if total > chance:
            return l
    return lines


def pairs_at(threshold: float, dim: int, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of n unit vectors: row by row random pairs whose cosine is the threshold (1 where dim is 1)."""
    a, b = rng.standard_normal((2, n, dim))
    a /= np.sqrt((a * a).sum(axis=1))[:, None]
    if dim == 1:
        return a, a
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.sqrt((b * b).sum(axis=1))[:, None]
    return a, threshold * a + sqrt(1 - threshold * threshold) * b


class Lines:
    def __init__(self, dim: int, n: int, threshold: float, recall: float):
        rng = np.random.default_rng(20_24)
        self.k, least_t = tables_for(n, threshold, recall)
        spare = np.zeros((0, dim))

        def draw(lines: int) -> np.ndarray:  # orthogonal blocks spread the lines better than independent ones
            nonlocal spare
            while len(spare) < lines:
                spare = np.concatenate([spare, np.linalg.qr(rng.standard_normal((dim, dim)))[0]])
            out, spare = spare[:lines].T.copy(), spare[lines:]
            return out

        self.counts = draw(COUNT_LINES) * sqrt(dim)
        self.width = WIDTH * sqrt(2 - 2 * threshold)
        self.threshold = threshold
        a, b = pairs_at(threshold, dim, TRIALS, np.random.default_rng(20_25))
        collisions = (np.abs(a @ self.counts - b @ self.counts) <= self.width).sum(axis=1)
        self.least = min(least_count(COUNT_LINES), int(np.sort(collisions)[TRIALS // 10_000]))
        self.groups: list[np.ndarray] = []
        missed = np.ones(TRIALS, bool)
        allowed = TRIALS * (1 - recall)
        # two standard deviations of the misses on the safe side; a recall that so few pairs cannot show is left to tables_for()
        while len(self.groups) < least_t or allowed >= 1 and missed.any() and (lost := (missed | (collisions < self.least)).sum()) + 2 * sqrt(lost) > allowed:
            self.groups.append(draw(self.k))
            missed[missed] = self._cell(a[missed], len(self.groups) - 1) != self._cell(b[missed], len(self.groups) - 1)
        self.t = len(self.groups)

    def _cell(self, unit: np.ndarray, t: int) -> np.ndarray:
        return ((unit @ self.groups[t] > 0).astype(np.float64) @ 2.0 ** np.arange(self.k)).astype(np.int64)

    def cells(self, unit: np.ndarray, groups: int | None = None) -> np.ndarray:
        """The cell of each vector in each group, or in the first so many."""
        found = [self._cell(unit, t) for t in range(self.t if groups is None else groups)]
        return np.stack(found, axis=1) if found else np.zeros((len(unit), 0), np.int64)


def usable(embedding):
    """Not null, not empty, all components finite, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def units(flat: np.ndarray) -> np.ndarray:
    """Rows of flat as unit vectors in double precision; scaled first, so that no square over- or underflows."""
    out = flat.astype(np.float64)
    out /= np.abs(out).max(axis=1)[:, None]
    out /= np.sqrt((out * out).sum(axis=1))[:, None]
    return out


def windows(h: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, first, size), each [line, row]: where a row stands in the sorted order of a line's projections h[row, line], and
    the range of that order that lies within width around its projection."""
    n, lines = h.shape
    kind = np.int16 if n < 1 << 15 else np.int32
    rank, first, size = (np.empty((lines, n), kind) for _ in range(3))
    for line in range(lines):
        order = np.argsort(h[:, line], kind="stable")
        ordered = h[order, line]
        rank[line, order] = np.arange(n, dtype=kind)
        first[line] = np.searchsorted(ordered, h[:, line] - width, "left")
        size[line] = np.searchsorted(ordered, h[:, line] + width, "right") - first[line]
    return rank, first, size


def collisions(of: tuple[np.ndarray, np.ndarray, np.ndarray], begin: int, end: int) -> np.ndarray:
    """[query, row]: on how many lines row stands in the window of each of the queries begin to end."""
    rank, first, size = of
    count = np.zeros((end - begin, rank.shape[1]), np.uint8)
    for line in range(len(rank)):
        place = rank[line][None] - first[line, begin:end, None]
        count += (place >= 0) & (place < size[line, begin:end, None])
    return count


def _pairs(cols: dict, spaces: dict[int, Lines], kind: np.dtype) -> tuple[np.ndarray, list, list]:
    """Links counted for each row of a cell (weighted by copies), and edges that span the cell's linked rows."""
    starts, sizes, group = cols["starts"], cols["sizes"], cols["table"]
    links = np.zeros(len(cols["node"]), np.int64)
    a, b = [], []
    for s, n in zip(starts[sizes > 1], sizes[sizes > 1]):
        node, copies = cols["node"][s : s + n], cols["copies"][s : s + n]
        unit = units(np.stack([np.frombuffer(v, kind) for v in cols["vec"][s : s + n]]))
        lines = spaces[unit.shape[1]]
        of = windows(unit @ lines.counts, lines.width)
        earlier = None
        label = np.arange(n)
        for i in range(0, n, 512):  # queries of a block against all rows: memory stays bounded
            x, y = np.nonzero(collisions(of, i, min(n, i + 512)) >= lines.least)
            x, y = x[y > x + i] + i, y[y > x + i]
            if not len(x):
                continue
            linked = np.concatenate([np.einsum("ij,ij->i", unit[x[j : j + 200_000]], unit[y[j : j + 200_000]]) for j in range(0, len(x), 200_000)]) >= lines.threshold
            x, y = x[linked], y[linked]
            if cols["part"][s] and len(x):  # a chunked cell: only pairs of its two chunks, or of one chunk in its own part
                part, chunks = cols["part"][s] - 1, cols["chunks"][s]
                lo, hi, mine = part // chunks, part % chunks, cols["mine"][s : s + n]
                ours = (mine[x] == lo) & (mine[y] == hi) | (mine[x] == hi) & (mine[y] == lo)
                x, y = x[ours], y[ours]
            if not len(x):
                continue
            while True:  # least label over the links
                low = np.minimum(label[x], label[y])
                new = label.copy()
                np.minimum.at(new, x, low)
                np.minimum.at(new, y, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            earlier = lines.cells(unit, group[s]) if earlier is None else earlier
            fresh = np.concatenate([~(earlier[x[j : j + 100_000]] == earlier[y[j : j + 100_000]]).any(axis=1) for j in range(0, len(x), 100_000)])
            np.add.at(links, s + x[fresh], copies[y[fresh]])
            np.add.at(links, s + y[fresh], copies[x[fresh]])
        moved = np.flatnonzero(label != np.arange(n))
        a.append(node[moved])
        b.append(node[label[moved]])
    return links, a, b


def near_links(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of vectors(key, column); other columns are not looked at.

    Rows are the vectors; equal ones, under one key or several, are compared once and counted as often as they occur. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, and only vectors of one length link.
    component_id is the smallest key reachable; a null key has a null component unless it links. Empty input: no rows.
    Components are compared in double precision; array<float> travels as it is, any other number as double. The driver holds
    one set of lines for each length of vector.
    """
    kind, name = (np.dtype(np.float32), "float") if dict(vectors.dtypes)[column] == "array<float>" else (np.dtype(np.float64), "double")
    base = vectors.select(F.col(key).alias("id"), F.transform(F.col(column).cast(f"array<{name}>"), lambda x: x + F.lit(0.0).cast(name)).alias("vec")).withColumn("ok", usable(F.col("vec")))  # -0.0 becomes 0.0
    good = base.where("ok").select("id", "vec", F.xxhash64("vec").alias("h"))
    same = stored(good.groupBy("h", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    # the node is a name of the distinct vector: its least key, or a hash where that is null or another vector's, too
    several = stored(same.where("least IS NOT NULL").groupBy("least").agg(F.count("*").alias("n")).where("n > 1"))
    mixed = F.xxhash64(F.lit("node"), "least", "vec")
    if several.isEmpty():
        same = same.withColumn("node", F.coalesce("least", mixed))
    else:
        same = stored(same.join(several, "least", "left").withColumn("node", F.when(F.col("n").isNull(), F.col("least"))).withColumn("node", F.coalesce("node", mixed)).drop("n"))
    lengths = {r["d"]: r["n"] for r in same.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not lengths:
        return base.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    spaces = {d: Lines(d, n, threshold, recall) for d, n in sorted(lengths.items())}
    space_of = {d: i << 50 for i, d in enumerate(spaces)}
    named = same.select("node", "copies", "vec")

    def deal(whole: bool):
        def run(batches):
            for batch in batches:
                vec = batch.column(2)
                data, at = vec.flatten().to_numpy(), np.r_[0, np.cumsum(vec.value_lengths().to_numpy())]
                size = np.diff(at)
                for d in np.unique(size).tolist():
                    rows = np.flatnonzero(size == d)
                    flat, lines = data[at[rows][:, None] + np.arange(d)], spaces[d]
                    cells = lines.cells(units(flat)) + space_of[d]
                    node, copies = (batch.column(c).take(pa.array(rows)) for c in (0, 1))
                    raw = pa.array([r.tobytes() for r in flat], pa.binary()) if whole else None
                    for t in range(lines.t):
                        cols = [pa.array(cells[:, t] + (t << lines.k)), node] + ([pa.array(np.full(len(rows), t, np.int32)), copies, raw] if whole else [])
                        yield pa.RecordBatch.from_arrays(cols, names=["key", "node", "table", "copies", "vec"][: len(cols)])

        return named.mapInArrow(run, "key long, node long, table int, copies long, vec binary" if whole else "key long, node long")

    counts = deal(False).groupBy("key").agg(F.count("*").alias("count"))
    dealt = split_cells(deal(True), counts)
    columns = ["key", "part", "node", "table", "copies", "vec", "mine", "chunks"]

    def work(cols):
        links, a, b = _pairs(cols, spaces, kind)
        at = np.flatnonzero(links)
        edges = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        return {"node": np.concatenate([cols["node"][at], edges[0]]), "links": np.concatenate([links[at], np.zeros(len(edges[0]), np.int64)]), "to": np.concatenate([cols["node"][at], edges[1]])}

    found = stored(in_runs(dealt, work, "node long, links long, to long", columns))
    comp = components(found.where("links = 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    members = stored(comp.unionByName(comp.select(F.col("component").alias("node"), "component").distinct()))
    keys = members.join(same.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("key"))
    comp = members.join(keys, "component").select("node", "key")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = same.join(links, "node", "left").join(comp, "node", "left")
    # a name of the vector stands for its bytes from here on: rows find it by two hashes
    twice = F.xxhash64(F.lit("vec"), "vec").alias("g")
    known = known.select(F.struct("h", twice).alias("v"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("key", "least").alias("component_id"))
    linked = join_hot(good.select("id", F.struct("h", twice).alias("v")), known, "v", "copies").select("id", "n_links", "component_id")
    alone = base.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def split_cells(dealt: DataFrame, counts: DataFrame, limit: int = HOT_CELL) -> DataFrame:
    """split_hot() of the common helpers for cells, with what _pairs needs to tell a chunk's own pairs: part 0 is a whole cell,
    part p + 1 a pair of chunks."""
    big = stored(counts.where(F.col("count") > limit).select("key", F.ceil(F.col("count") * 2 / limit).cast("int").alias("chunks")))
    if big.isEmpty():
        return dealt.withColumns({"part": F.lit(0), "mine": F.lit(0), "chunks": F.lit(1)})
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j) + 1)
    joined = dealt.join(big, "key", "left").withColumn("mine", F.coalesce(mine, F.lit(0)))
    return joined.withColumn("part", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pair))).withColumn("chunks", F.coalesce("chunks", F.lit(1)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of all vectors of embeddings, at cosine 0.9; see near_links()."""
    return near_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
