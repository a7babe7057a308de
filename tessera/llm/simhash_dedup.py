"""SimHash near-dedup by the general pigeonhole principle.

64 bits are grouped into parts of correlated bits. For thresholds t_i with sum t_i = tau - parts + 1, two fingerprints
within tau bits differ by at most t_i bits in some part i. The number of parts and the thresholds come from a dynamic
program over estimated candidate counts. A part with threshold e is probed by its values with e bits masked, so both
sides of a pair meet under one key; runs of a key are verified and give a spanning forest, never all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, components, in_runs, join_hot, row_names, shielded, split_hot, stored, table

TAU, SHINGLE, SEED, BITS = 3, 3, 42, 64
#: Weights of the cost model: one emitted key against one compared pair.
KEY_COST, PAIR_COST = 40.0, 0.05
HOT_KEY = 8192


def fingerprint(text: str | bytes | None) -> int:
    """Majority bits of XXH64 over the word shingles of one whole text; no words: zero."""
    if not text:
        return 0
    raw = text if isinstance(text, bytes) else text.encode()
    parts = raw.lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - SHINGLE + 1)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[min(SHINGLE, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """(*keys, fp long): the fingerprint as a signed 64-bit number."""

    def one(batch):
        fps = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column(len(keys))], dtype=np.uint64)
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"fp": fps.view(np.int64)}

    kinds = dict(docs.dtypes)
    return arrow_map(docs.select(*keys, "text"), one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fp long")


def _part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def correlated_parts(co: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits grouped so that strongly correlated ones share a part. co[i, j]: rows with both bits set."""
    p = np.diag(co) / max(n, 1)
    cov = co / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    near = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        pool = sorted(free)
        group = [max(pool, key=lambda b: (near[b, pool].sum() - near[b, b], -b))]
        while len(group) < size:
            rest = [b for b in pool if b not in group]
            group.append(max(rest, key=lambda b: (near[b, group].sum(), -b)))
        free -= set(group)
        out.append(sorted(group))
    return out


def thresholds(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Least cost of t_1..t_m with sum t_i = total, each from -1 (not probed) up; costs[i][t + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, -1):
                if s + t not in nxt or c + extra < nxt[s + t][0]:
                    nxt[s + t] = (c + extra, [*ts, t])
        best = nxt
    return best[total]


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in c) for c in combinations(range(width), flips)]


def plan(fps: DataFrame, tau: int = TAU) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the parts to probe. Statistics run over all fingerprints; the driver gets 64 x 64 numbers
    and one number per part considered."""

    def co(batch):
        bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        return {"cell": np.arange(BITS * BITS, dtype=np.int32), "n": np.rint(bits.T @ bits).astype(np.int64).ravel()}

    n = fps.count()
    matrix = np.zeros(BITS * BITS)
    for r in arrow_map(fps.select("fp"), co, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[r["cell"]] = r["n"]
    options = {m: correlated_parts(matrix.reshape(BITS, BITS), n, m) for m in (2, 3, 4)}
    flat = [(m, i, bits) for m, groups in options.items() for i, bits in enumerate(groups)]

    def keys(batch):
        fp = batch.column(0).to_numpy().view(np.uint64)
        for at, (_, _, bits) in enumerate(flat):
            yield {"part": np.full(len(fp), at, np.int32), "value": _part_values(fp, bits)}

    counts = arrow_map(fps.select("fp"), keys, "part int, value long").groupBy("part", "value").agg(F.count("*").cast("double").alias("c"))
    pairs = {r["part"]: r["s"] for r in counts.groupBy("part").agg(F.sum(F.col("c") * F.col("c")).alias("s")).collect()}
    best = None
    for m, groups in options.items():
        costs = []
        for bits in groups:
            w, same = len(bits), max(pairs.get(flat.index((m, groups.index(bits), bits)), n), 1.0)
            spread = np.log2(max(n, 1) ** 2 / same) if n else 0.0  # collision entropy of the part, in bits
            row = [0.0]
            for t in range(tau + 1):
                ways = comb(w, t)
                row.append(KEY_COST * n * ways + PAIR_COST * ways * n * n / 2 * 2.0 ** (-spread * (w - t) / w))
            costs.append(row)
        cost, ts = thresholds(costs, tau - m + 1)
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(groups, ts) if t >= 0])
    return best[1]


def _near_edges(cols: dict, tau: int) -> dict:
    """A spanning forest of the links inside each run, as edges of nodes."""
    starts, sizes, node, fp = cols["starts"], cols["sizes"], cols["node"], cols["fp"].view(np.uint64)
    a, b = [], []
    small = (sizes > 1) & (sizes <= 48)
    if small.any():
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[small], sizes[small])]) if small.sum() < 1000 else np.flatnonzero(np.repeat(small, sizes))
        left = np.repeat(starts + sizes, sizes)[at] - at  # rows of the run from here on
        for s in range(1, int(sizes[small].max())):
            at, left = at[left > s], left[left > s]
            hit = np.bitwise_count(fp[at] ^ fp[at + s]) <= tau
            a.append(node[at[hit]])
            b.append(node[at[hit] + s])
    for s, n in zip(starts[sizes > 48], sizes[sizes > 48]):
        rest = np.arange(s, s + n)
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = np.bitwise_count(fp[rest] ^ fp[x]) <= tau
                found = rest[near]
                a.append(np.full(len(found), node[x]))
                b.append(node[found])
                front.extend(found)
                rest = rest[~near]
    return {"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)}


def cluster(fps: DataFrame, key: str = "doc_id", tau: int = TAU) -> DataFrame:
    """(fp, component, n): the smallest key reachable through links of at most tau differing bits, and the number of rows, for
    every fingerprint.

    fps: (key long, fp long), stored. The fingerprint itself is the node, so rows without a key link others like any row; a
    component of null keys alone has a null component. No fingerprints, no rows.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    known = nodes.select(F.col("fp").alias("node"), "fp")
    parts = plan(known, tau)
    probes = [(i, v, bits, mask) for i, (bits, t) in enumerate(parts) for v, mask in enumerate(_masks(len(bits), t))]

    def keys(batch):
        node, fp = batch.column(0), batch.column(1).to_numpy().view(np.uint64)
        values: dict[int, np.ndarray] = {}
        for i, v, bits, mask in probes:
            if i not in values:
                values = {i: _part_values(fp, bits)}
            yield {"key": values[i] & ~np.int64(mask) | np.int64(i) << 61 | np.int64(v) << 48 if len(bits) <= 48 else values[i], "node": node, "fp": batch.column(1)}

    keyed = arrow_map(known, keys, "key long, node long, fp long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("count"))
    runs = split_hot(keyed, counts, HOT_KEY)
    edges = in_runs(runs, lambda c: _near_edges(c, tau), "a long, b long", ["key", "part", "node", "fp"])
    found = components(edges)
    told = stored(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("_of"), "least", "n"))
    least = told.groupBy("_of").agg(F.min("least").alias("component"), F.count("*").alias("_n"))
    return join_hot(told.drop("least"), least, "_of", "_n").select("fp", "component", "n")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of all documents, one row each, repeated ones too. Null or wordless texts have
    fingerprint zero and link to one another. Texts are hashed whole, however long."""
    fps = stored(fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    return join_hot(fps, cluster(fps), "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component exactly one row stays, with all its columns. It is the row with the smallest
    key, null last; among rows of that key the one with the least row_names().

    Keys may be null or repeat: components join fingerprints, and the row is found again by row_names(). All columns of docs
    are kept, whatever their names; of rows equal in all of them one stays. Empty input: no rows.
    """
    named = shielded(docs, key, "text")
    kept_columns = named.columns
    named = named.withColumns(row_names(named))
    fps = stored(fingerprints(named.select(key, "_a", "_b", "text"), key, "_a", "_b"))
    component = cluster(fps.select(F.col("fp").alias("node"), "fp"), "node")
    rows = fps.groupBy("fp").agg(F.min(F.struct(F.isnull(key).alias("none"), F.col(key).alias("key"), "_a", "_b")).alias("least"))
    kept = rows.join(component, "fp").groupBy("component").agg(F.min("least").alias("least")).select("least._a", "least._b")
    copies = fps.groupBy("_a", "_b").agg(F.count("*").alias("n")).where("n > 1")
    kept = stored(kept.join(copies, ["_a", "_b"], "left"))
    out = named.join(kept.where("n IS NULL"), ["_a", "_b"], "left_semi")
    equal = kept.where("n > 1")
    if not equal.isEmpty():  # rows equal in all columns: only these are gathered
        out = out.unionByName(named.join(equal, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]))
    return out.select(*kept_columns).toDF(*docs.columns)
