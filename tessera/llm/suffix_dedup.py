"""Suffix-array dedup of repeated 100-byte strings by hash-compared suffix sort.

Every 100-byte window names an anchor, its 24-byte gram of least hash (the rightmost of equals); equal windows name equal
grams at equal offsets. Consecutive windows of one anchor form a row: gram hash, hash of all their bytes (the context),
document and place. So suffixes that could be equal meet by gram, and a text costs one small row in about 39 bytes.

1. Rows meet by gram hash; those whose gram stands alone repeat nothing. The contexts of the others are cut from the texts.
2. Contexts meet by gram. One that equals an earlier one, byte by byte, is a repeat as a whole. The windows of the others
   are sorted as suffixes: a mergesort whose comparisons find the common extension by binary search over prefix polynomial
   hashes. Neighbours that agree on 100 bytes are verified byte by byte; all but the earliest are repeats.
3. Repeats become byte ranges of their documents and are cut out.

A gram that very many rows share does not meet in one task. Its contexts are dealt by their own hash and a salt of the
document; each task keeps the earliest of equal ones, and these meet again without the salt. What is then left, one of each
context, is cut into blocks of up to STEP windows, which meet by the bytes that all windows of a block share and are sorted as in 2;
so a context travels about once, not once a window. Only the windows of blocks that very many rows share go out one by one,
as contexts do. Which grams are hot is read off a table of counters over all rows; hot or not, the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import PIECE, buffer_of, inverses, pieces, prefix_hashes, span_hashes
from .common import arrow_map, hashed, in_runs, join_hot, ranked, stored, table

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
#: Windows sorted at once.
SORTED_AT_ONCE = 400_000
#: Counters that grams are counted in by hash. Grams are hot where a counter holds more than HOT_ROWS rows and more than 8
#: times the mean, so at most an eighth of the counters are hot.
COUNTERS, HOT_ROWS = 1 << 20, 1024
#: Windows of a block: those of a hot gram whose offsets to it agree but for the remainder by STEP.
STEP = 8
OPEN, DONE, HOT = 0, 1, 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every full window."""
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : len(x) - size + 1])


def anchors(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of runs of windows with one anchor: row of at, start of the first window, windows, anchor offset, hashes."""
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "offset", "h", "c")}
    prefix = prefix_hashes(data)
    place = np.arange(n - GRAM + 1)
    h = span_hashes(prefix, place, place + GRAM)
    key = h & np.uint64(0xFFFFFFFF00000000) | (np.uint64(0xFFFFFFFF) - place.astype(np.uint64))
    chosen = (np.uint64(0xFFFFFFFF) - (sliding_min(key, GRAMS) & np.uint64(0xFFFFFFFF))).astype(np.int64)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(chosen)]
    starts = np.flatnonzero(np.arange(len(chosen)) + LENGTH <= at[1:][row_of])
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "offset", "h", "c")}
    p = chosen[starts]
    cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, count = starts[cut], np.diff(np.r_[cut, len(starts)])
    gram = p[cut]
    c = span_hashes(prefix, first, first + count - 1 + LENGTH) ^ (gram - first).astype(np.uint64) << np.uint64(8) ^ count.astype(np.uint64)
    row = row_of[first]
    return {"row": row, "start": first - at[:-1][row], "n": count, "offset": gram - first, "h": h[gram].view(np.int64), "c": c.view(np.int64)}


def all_anchors(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """anchors() of a whole batch, in pieces; a text longer than a piece is cut into ones that overlap by LENGTH - 1 bytes."""
    got = []
    for i, j in pieces(at):
        for begin in range(at[i], at[j], PIECE) if j == i + 1 else [at[i]]:
            end = min(at[j], begin + PIECE + LENGTH - 1) if j == i + 1 else at[j]
            a = anchors(data[begin:end], at[i : j + 1] - at[i] if j > i + 1 else np.array([0, end - begin]))
            got.append(a | {"row": a["row"] + i, "start": a["start"] + (begin - at[i])})
    return {k: np.concatenate([g[k] for g in got]) for k in got[0]} if got else anchors(data[:0], np.zeros(1, np.int64))


def pack(start, n, offset, kind):
    return start << 16 | n << 9 | offset << 2 | kind


def unpack(meta):
    return meta >> 16, meta >> 9 & 127, meta >> 2 & 127


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] equals data[b : b + size], for each of a, b and size (none zero)."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 20_000):
        n = size[i : i + 20_000]
        first = np.cumsum(n) - n
        at = np.arange(n.sum())
        differ = data[at + np.repeat(a[i : i + 20_000] - first, n)] != data[at + np.repeat(b[i : i + 20_000] - first, n)]
        out[i : i + 20_000] = ~np.logical_or.reduceat(differ, first) if len(n) else True
    return out


def merged(doc: np.ndarray, ord_: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of one (doc, ord) that overlap or touch, joined: doc, ord, begin and end."""
    by = np.lexsort((end, begin, ord_, doc))
    d, o, s, e = doc[by], ord_[by], begin[by], end[by]
    if not len(d):
        return d, o, s, e
    fresh = np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1])]
    # the furthest end so far inside a document: lift each document above the one before
    lift = np.cumsum(fresh) * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + lift) - lift
    cut = np.flatnonzero(fresh | np.r_[True, s[1:] > far[:-1]])
    last = np.r_[cut[1:], len(d)] - 1
    return d[cut], o[cut], s[cut], far[last]


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, at most `most`, by binary search over prefix hashes."""
    inv = inverses(len(prefix))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most)
    base_a, base_b, inv_a, inv_b = prefix[a], prefix[b], inv[a], inv[b]
    for _ in range(most.bit_length()):
        mid = (low + high + 1) >> 1
        same = (prefix[a + mid] - base_a) * inv_a == (prefix[b + mid] - base_b) * inv_b
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, prefix: np.ndarray, pos: np.ndarray, bucket: np.ndarray, most: int) -> np.ndarray:
    """Indices sorting the suffixes at pos (as far as `most` bytes) inside each bucket: a mergesort of all buckets in step."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]])
    size = np.diff(np.r_[cut, len(order)])
    seg, end = np.repeat(cut, size), np.repeat(cut + size, size)
    local = np.arange(len(order)) - seg
    width = 1
    while width < size.max(initial=0):
        block = local // width
        lo = np.minimum(seg + (block ^ 1) * width, end)
        hi = np.minimum(lo + width, end)
        rank0 = lo.copy()
        todo = np.flatnonzero(lo < hi)
        x = pos[order]
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            mine, other = x[todo], x[mid]
            lcp = common_extension(prefix, mine, other, most)
            full = lcp == most
            less = ~full & (data[np.minimum(other + lcp, len(data) - 1)] < data[np.minimum(mine + lcp, len(data) - 1)])
            before = less | full & (block[todo] & 1 == 1)  # equal ones of the left run come first
            lo[todo] = np.where(before, mid + 1, lo[todo])
            hi[todo] = np.where(before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        to = seg + (block >> 1) * 2 * width + local % width + (lo - rank0)
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    return order


def repeated_windows(data: np.ndarray, pos: np.ndarray, bucket: np.ndarray, doc: np.ndarray, ord_: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows of LENGTH bytes repeat an earlier (doc, ord, start) of their bucket."""
    prefix = prefix_hashes(data)
    order = suffix_order(data, prefix, pos, bucket, LENGTH)
    x, b = pos[order], bucket[order]
    same = np.zeros(len(order), bool)
    near = np.flatnonzero(b[1:] == b[:-1]) + 1
    same[near[common_extension(prefix, x[near - 1], x[near], LENGTH) == LENGTH]] = True
    hit = np.flatnonzero(same)
    wide = np.arange(LENGTH)
    for i in range(0, len(hit), 20_000):  # verification against hash collisions
        part = hit[i : i + 20_000]
        same[part] = (data[x[part, None] + wide] == data[x[part - 1, None] + wide]).all(axis=1)
    group = np.cumsum(~same)
    by = np.lexsort((start[order], ord_[order], doc[order], group))
    g = group[by]
    out = np.zeros(len(order), bool)
    out[order[by]] = np.r_[False, g[1:] == g[:-1]][: len(by)]
    return out


def first_copies(group: np.ndarray, c: np.ndarray, doc: np.ndarray, ord_: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, firsts): the rows that another of equal group and c comes before, and the earliest such one of each."""
    order = np.lexsort((start, ord_, doc, c, group))
    a, b = group[order], c[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
    lead = order[first][np.cumsum(first) - 1] if len(order) else order
    return order[~first], lead[~first]


def documents(docs: DataFrame, key: str) -> DataFrame:
    """(id, doc, ord, text): the key as it is, a long that orders documents (null first), and which row of its key a row is.

    Rows of one key are ordered by a hash of their texts; equal ones are interchangeable.
    """
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), "text")
    several = stored(slim.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").withColumn("many", F.lit(True)))
    if several.isEmpty():
        return slim.select("id", "doc", F.lit(0).cast("long").alias("ord"), "text")
    counted = join_hot(slim, several, "doc", "n", "left").select("id", "doc", "text", "many")
    alone = counted.where("many IS NULL").select("id", "doc", F.lit(0).cast("long").alias("ord"), "text")
    among = ranked(counted.where("many").withColumn("_h", hashed("row of a key", "text")), ["doc"], "_h", "ord")
    return stored(alone.unionByName(among.select("id", "doc", F.col("ord").cast("long"), "text")))


def _dealt(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Rows of windows (key, c, doc, ord, meta). Rows that repeat an earlier one of their batch, byte by byte, come as DONE ranges;
    those of hot counters as HOT rows, named by gram and context together; DONE and HOT rows are dealt by document."""

    def deal(batch):
        data, at = buffer_of(batch.column(2))
        docs_, ords = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        a = all_anchors(data, at)
        h, c, row, start, n, offset = (a[k] for k in ("h", "c", "row", "start", "n", "offset"))
        doc, ord_ = docs_[row], ords[row]
        later, lead = first_copies(h, c, doc, ord_, start)
        same = n[later] == n[lead]
        same[same] = same_bytes(data, (at[row] + start)[later[same]], (at[row] + start)[lead[same]], (n + LENGTH - 1)[later[same]])
        gone = later[same]
        left = np.ones(len(h), bool)
        left[gone] = False
        d, o, s, e = merged(doc[gone], ord_[gone], start[gone], (start + n + LENGTH - 1)[gone])
        is_hot = hot[h & (COUNTERS - 1)] if len(hot) else np.zeros(len(h), bool)
        spread = doc * 0x9E3779B1 ^ start >> 12
        key = np.where(is_hot, spread, h)[left]
        name = np.where(is_hot, h * 0x2545F491 ^ c, c)[left]
        meta = pack(start, n, offset, np.where(is_hot, HOT, OPEN))[left]
        cols = {"key": (key, d * 0x9E3779B1 ^ s >> 12), "c": (name, e), "doc": (doc[left], d), "ord": (ord_[left], o), "meta": (meta, pack(s, 0, 0, DONE))}
        return {k: np.concatenate(v) for k, v in cols.items()}

    return arrow_map(texts.select("doc", "ord", "text"), deal, "key long, c long, doc long, ord long, meta long")


def _hot_counters(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Which counters are hot (empty if none is), and the number of salts that cut the fullest to about the limit."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, at = buffer_of(batch.column(0))
            a = all_anchors(data, at)
            # copies inside a batch count once, as they are dealt once
            one = a["h"][np.unique(a["h"] * 0x2545F491 ^ a["c"], return_index=True)[1]]
            total += np.bincount(one & (COUNTERS - 1), minlength=COUNTERS)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["counter", "n"])

    counts = stored(texts.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_ROWS, 8 * total // COUNTERS)
    hot = counts.where(F.col("n") > limit).toArrow()
    if not hot.num_rows:
        return np.zeros(0, bool), 1
    out = np.zeros(COUNTERS, bool)
    out[hot.column("counter").to_numpy()] = True
    return out, int(-(-hot.column("n").to_numpy().max() // limit))


MET = "kind int, key long, c long, doc long, ord long, meta long, to long, ctx binary"
COLUMNS = ["key", "part", "c", "doc", "ord", "meta", "ctx"]
ROW = ["key", "c", "doc", "ord", "meta", "ctx"]


def _salt(doc: np.ndarray, ord_: np.ndarray, salts: int) -> np.ndarray:
    """A part from 1 on for each document."""
    return ((doc * 0x9E3779B1 ^ ord_ * 0x85EBCA6B ^ doc >> 17) % salts + 1).astype(np.int32)


def _blocks(ctx: np.ndarray, doc: np.ndarray, ord_: np.ndarray, start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> dict:
    """Contexts cut into OPEN rows of up to STEP windows, with the hash of the bytes that all STEP windows of such a block share as key:
    equal windows have equal offsets to their gram, so they lie in blocks of one key."""
    low = offset - n + 1  # offsets fall from window to window
    parts = offset // STEP - low // STEP + 1
    row = np.repeat(np.arange(len(n)), parts)
    block = offset[row] // STEP - (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
    top, bottom = np.minimum(offset[row], block * STEP + STEP - 1), np.maximum(low[row], block * STEP)
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    data = np.frombuffer(b"".join(ctx), np.uint8)
    prefix = prefix_hashes(data)
    base = (np.cumsum(size) - size)[row]
    first, count = base + offset[row] - top, top - bottom + 1
    core = base + offset[row] - block * STEP
    key = span_hashes(prefix, core, core + LENGTH - STEP + 1) ^ block.astype(np.uint64)
    c = span_hashes(prefix, first, first + count - 1 + LENGTH) ^ top.astype(np.uint64) << np.uint64(8) ^ count.astype(np.uint64)
    raw = [data[s:e].tobytes() for s, e in zip(first.tolist(), (first + count - 1 + LENGTH).tolist())]
    return {"key": key.view(np.int64), "c": c.view(np.int64), "doc": doc[row], "ord": ord_[row], "meta": pack(start[row] + offset[row] - top, count, top, OPEN), "ctx": raw}


def _windows(ctx: np.ndarray, doc: np.ndarray, ord_: np.ndarray, start: np.ndarray, n: np.ndarray) -> dict:
    """Each window of the contexts as a HOT row of its own, named by the hash of its bytes."""
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    data = np.frombuffer(b"".join(ctx), np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    pos = (np.cumsum(size) - size)[row] + step
    h = span_hashes(prefix_hashes(data), pos, pos + LENGTH).view(np.int64)
    return {"key": h, "c": h, "doc": doc[row], "ord": ord_[row], "meta": pack(start[row] + step, 1, 0, HOT), "ctx": [data[p : p + LENGTH].tobytes() for p in pos.tolist()]}


def _meet(cols: dict, blocks: bool = False) -> dict:
    """What rows that share key and part tell of one another, as MET: ranges that repeat something earlier (kind 0), and rows
    that must be compared again (kind 1): those of salted parts, or, if asked, the blocks of all rows that are no repeats."""
    starts, sizes = cols["starts"], cols["sizes"]
    c, doc, ord_, meta, ctx = (cols[k] for k in ("c", "doc", "ord", "meta", "ctx"))
    start, n, offset = unpack(meta)
    run = np.repeat(np.arange(len(starts)), sizes)
    later, lead = first_copies(run, c, doc, ord_, start)
    later = later[np.fromiter((ctx[i] == ctx[j] for i, j in zip(later.tolist(), lead.tolist())), bool, len(later))]
    left = np.ones(len(c), bool)
    left[later] = False
    found = [(doc[later], ord_[later], start[later], (start + n + LENGTH - 1)[later])]
    again = {k: [] for k in ("key", "c", "doc", "ord", "meta", "ctx")}
    salted = cols["part"] > 0
    if blocks:
        again = _blocks(ctx[left], doc[left], ord_[left], start[left], n[left], offset[left])
    elif salted.any():
        at = np.flatnonzero(left & salted)
        again = {"key": cols["key"][at], "c": c[at], "doc": doc[at], "ord": ord_[at], "meta": meta[at], "ctx": ctx[at].tolist()}
    if not blocks:  # suffix sort of the runs with several rows left
        alive = left & ~salted
        count = np.add.reduceat(alive, starts) if len(starts) else np.zeros(0, np.int64)
        rows = np.flatnonzero(alive & (count > 1)[run])
        new = np.flatnonzero(np.r_[True, run[rows][1:] != run[rows][:-1]][: len(rows)])
        ends = np.r_[new[1:], len(rows)][: len(new)]
        load = np.add.reduceat(n[rows], new) if len(new) else np.zeros(0, np.int64)
        i = 0
        while i < len(new):
            j = i + max(1, int(np.searchsorted(np.cumsum(load[i:]), SORTED_AT_ONCE, "right")))
            part = rows[new[i] : ends[j - 1]]
            here = ctx[part]
            size = np.fromiter(map(len, here), np.int64, len(here))
            member = np.repeat(np.arange(len(part)), n[part])
            step = np.arange(len(member)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            bucket = run[part][member] * 128 + (offset[part][member] - step)
            place = start[part][member] + step
            hit = repeated_windows(np.frombuffer(b"".join(here), np.uint8), (np.cumsum(size) - size)[member] + step, bucket, doc[part][member], ord_[part][member], place)
            found.append((doc[part][member][hit], ord_[part][member][hit], place[hit], place[hit] + LENGTH))
            i = j
    d, o, s, e = merged(*(np.concatenate(x) for x in zip(*found)))
    k, zero = len(again["key"]), np.zeros(len(d), np.int64)
    joined = lambda x, y: np.concatenate([x, np.asarray(y, np.int64)])
    return {
        "kind": np.repeat(np.array([0, 1], np.int32), [len(d), k]), "key": joined(zero, again["key"]), "c": joined(zero, again["c"]), "doc": joined(d, again["doc"]), "ord": joined(o, again["ord"]),
        "meta": joined(pack(s, 0, 0, DONE), again["meta"]), "to": joined(e, np.zeros(k, np.int64)), "ctx": pa.array([None] * len(d) + list(again["ctx"]), pa.binary()),
    }


def repeats(texts: DataFrame) -> DataFrame:
    """(doc, ord, spans array<struct<from, to>>): ranges of the text's bytes that 100-byte strings with an earlier start cover.

    texts: what documents() gives. Ranges may overlap. Documents without repeats have no row.
    """
    hot, salts = _hot_counters(texts)
    rows = _dealt(texts, hot).withColumn("part", F.lit(0))

    def settle(cols):
        meta = cols["meta"]
        is_open = meta & 3 == OPEN
        count = np.add.reduceat(is_open, cols["starts"]) if len(cols["starts"]) else np.zeros(0, np.int64)
        keep = ~is_open | np.repeat(count > 1, cols["sizes"])
        key = np.where(meta & 3 == HOT, cols["c"], cols["key"])
        return {"key": key[keep]} | {k: cols[k][keep] for k in ("c", "doc", "ord", "meta")}

    settled = stored(in_runs(rows, settle, "key long, c long, doc long, ord long, meta long", ["key", "part", "c", "doc", "ord", "meta"]))
    kind, begin = F.col("meta").bitwiseAND(3), F.shiftright("meta", 16)
    found = [settled.where(kind == DONE).select("doc", "ord", begin.alias("from"), F.col("c").alias("to"))]
    wanted = settled.where(kind != DONE).groupBy("doc", "ord").agg(F.collect_list(F.struct("key", "c", "meta")).alias("rows"))

    def contexts(batch):
        data, at = buffer_of(batch.column(2))
        docs_, ords, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        key, c, meta = (x.to_numpy() for x in lists.flatten().flatten())
        start, n, _ = unpack(meta)
        first = at[row] + start
        raw = [data[s:e].tobytes() for s, e in zip(first.tolist(), (first + n - 1 + LENGTH).tolist())]
        part = np.where(meta & 3 == HOT, _salt(docs_[row], ords[row], salts), 0).astype(np.int32)
        return {"key": key, "part": part, "c": c, "doc": docs_[row], "ord": ords[row], "meta": meta, "ctx": pa.array(raw, pa.binary())}

    cut = arrow_map(texts.select("doc", "ord", "text").join(wanted, ["doc", "ord"]).select("doc", "ord", "text", "rows"), contexts, "key long, part int, c long, doc long, ord long, meta long, ctx binary")

    def met(df: DataFrame, blocks: bool = False) -> DataFrame:
        """The rows that are left to compare; the ranges go to found."""
        got = stored(in_runs(df, lambda cols: _meet(cols, blocks), MET, COLUMNS))
        found.append(got.where("kind = 0").select("doc", "ord", begin.alias("from"), "to"))
        return got.where("kind = 1").select(*ROW)

    def windows(batch):
        doc, ord_, meta = (batch.column(i).to_numpy() for i in (2, 3, 4))
        start, n, _ = unpack(meta)
        return _windows(np.array(batch.column(5).to_pylist(), object), doc, ord_, start, n)

    left = met(cut)
    if len(hot):
        whole = F.lit(0)
        salted = (F.pmod(F.xxhash64("doc", "ord"), F.lit(salts)) + 1).cast("int")
        parts = met(left.withColumn("part", whole), blocks=True)
        common = stored(parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS))  # at most a key for HOT_ROWS rows
        if common.isEmpty():
            met(parts.withColumn("part", whole))
        else:
            common = F.broadcast(common.select("key"))
            met(parts.join(common, "key", "left_anti").withColumn("part", whole))
            each = arrow_map(parts.join(common, "key", "left_semi").select(*ROW), windows, "key long, c long, doc long, ord long, meta long, ctx binary")
            left = met(each.withColumn("part", salted))
            met(left.withColumn("part", whole))
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans.groupBy("doc", "ord").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def cut_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of docs(key, text), one row each: what is left of each text's bytes.

    The key orders documents, null is the first; rows that repeat a key are documents of their own, in an order of their
    texts' hashes. Null and empty texts are empty; long texts are worked on in pieces. Other columns are not looked at.
    Empty input: no rows.
    """
    texts = documents(docs, key)
    got = texts.join(repeats(texts), ["doc", "ord"], "left").select("id", "text", "spans")

    def cut(batch):
        data, at = buffer_of(batch.column(1))
        n, spans = batch.num_rows, batch.column(2)
        row = np.repeat(np.arange(n), spans.value_lengths().fill_null(0).to_numpy())
        begin, end = (x.to_numpy() for x in spans.flatten().flatten()) if len(row) else (np.zeros(0, np.int64),) * 2
        row, _, begin, end = merged(row, np.zeros(len(row), np.int64), begin, end)
        removed, runs = np.bincount(row, end - begin, n).astype(np.int64), np.bincount(row, minlength=n)
        of = np.searchsorted(row, np.arange(n + 1))
        kept = []
        for i in range(n):
            edges = [at[i], *(at[i] + np.stack([begin[of[i] : of[i + 1]], end[of[i] : of[i + 1]]], axis=1).ravel()), at[i + 1]]
            kept.append(b"".join(data[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2])))
        return {key: batch.column(0), "n_bytes": np.diff(at), "n_removed": removed, "n_spans": runs, "kept": pa.array(kept, pa.binary())}

    return arrow_map(got, cut, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all documents; see cut_repeats()."""
    got = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
