"""Importance resampling towards a target: hashed n-gram features by CRC algebra, log-ratio weights, Gumbel scores, top draw.

A feature is a run of words joined by one space, its bucket the CRC-32 of its bytes modulo the number of buckets. The CRC of
a concatenation is a linear function over GF(2): crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where shift() by n bytes is the n-th
power of one 32 x 32 bit matrix. So each word's CRC is computed once, those of n-grams follow by algebra, and no n-gram
string is ever made.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import ASCII_LOWER, buffer_of, pieces, words
from .common import replacing, shared, shielded, stored, table

ORDERS, BUCKETS, SEED = 2, 10_000, 7
#: Documents of fewer words are never drawn; of the others this percentage is.
LEAST_WORDS, PERCENT = 20, 25
#: Words up to this length go through the byte table together, longer ones one by one.
SHORT = 64
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32 in reflected order

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


TABLE = _byte_table()
SPACE = np.uint32(zlib.crc32(b" "))


def _times(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bit matrix with these 32 columns times each x, over GF(2)."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@cache
def shift_tables(power: int) -> np.ndarray:
    """[4, 256]: what each byte of a CRC adds to it when 2^power zero bytes follow."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = TABLE[units & 255] ^ (units >> np.uint32(8))
    for _ in range(power):
        columns = _times(columns, columns)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(columns, values << np.uint32(8 * k)) for k in range(4)])


def shifted(crc: np.ndarray, power: int) -> np.ndarray:
    t = shift_tables(power)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of left + right of their CRCs; size: bytes of right, of any length, by its binary digits."""
    out = left.copy()
    for power in range(int(size.max(initial=0)).bit_length()):
        at = np.flatnonzero(size >> power & 1)
        out[at] = shifted(out[at], power)
    return out ^ right


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word data[start:end]; all words advance by one byte at a time."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.count_nonzero(size > SHORT))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order = order[long:]
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-size[order], -np.arange(SHORT), "left")  # words longer than k
    for k in range(SHORT):
        n = live[k]
        if not n:
            break
        crc[:n] = TABLE[(crc[:n] ^ data[at[:n] + k]) & 255] ^ crc[:n] >> np.uint32(8)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(text: pa.Array, orders: int, buckets: int):
    """For each piece of the column: (first row, row offsets into words, [(positions of first words, buckets)] by order)."""
    data, at = buffer_of(text)
    for i, j in pieces(at):
        part = ASCII_LOWER[data[at[i] : at[j]]]
        starts, ends, rows = words(part, at[i : j + 1] - at[i], WORD)
        crc, size = word_crcs(part, starts, ends), ends - starts
        row = np.repeat(np.arange(j - i), np.diff(rows))
        found, run, first = [(np.arange(len(crc)), crc % np.uint32(buckets))], crc, np.arange(len(crc))
        for n in range(1, orders):
            inside = row[first] == row[np.minimum(first + n, len(row) - 1)]
            inside &= first + n < len(row)
            run, first = run[inside], first[inside]
            run = joined(shifted(run, 0) ^ SPACE, crc[first + n], size[first + n])
            found.append((first, run % np.uint32(buckets)))
        yield i, rows, found


def bucket_counts(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all texts. A task keeps one counter a bucket and gives out those that are not zero."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), orders, buckets):
                for _, b in found:
                    sums += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share in target over that in docs). Two numbers a bucket reach the driver."""
    side = []
    for df in (docs, target):
        counts = np.zeros(buckets)
        for r in bucket_counts(df, orders, buckets, text).collect():
            counts[r["bucket"]] = r["n"]
        side.append(counts)
    s, t = side
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_features, weight and score, all long.

    weight: the floored mean gain of the features, 0 without any. score: weight plus Gumbel noise in thousandths from a hash of
    seed and key, so the k highest scores are a draw without replacement by exp(weight / 1000). A null text has no words, a
    null key hashes as an empty one. Columns of docs with one of these names, in any case, are replaced; all others are kept.
    """
    get, buckets = shared(docs.sparkSession, gain), len(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def measure(column: pa.Array) -> pa.Array:
        g, n = get(), len(column)
        n_words, n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, rows, found in features(column, orders, buckets):
            total = np.zeros(rows[-1] + 1, np.int64)
            count = total.copy()
            for first, b in found:
                total[first + 1] += g[b]
                count[first + 1] += 1
            total, count = np.diff(np.cumsum(total)[rows]), np.diff(np.cumsum(count)[rows])
            at = slice(i, i + len(count))
            n_words[at], n_features[at], weight[at] = np.diff(rows), count, total // np.maximum(count, 1)
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(n_features), pa.array(weight)], ["n_words", "n_features", "weight"])

    rows, names = replacing(docs, ["n_words", "n_features", "weight", "score"], key, text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    out = rows.withColumn("_m", measure(text)).select(*rows.columns, "_m.*")
    return out.withColumn("score", (F.col("weight") + noise).cast("long")).toDF(*names)


def _cut(rows: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, DataFrame, int | None, int]:
    """Eligible rows, (score, start: eligible rows with higher scores), the lowest score of which a row is drawn, rows to draw.

    Scores are integers in a range that logarithms of counts bound, so their histogram is small, however many rows there are.
    """
    fit = rows.where(F.col("n_words") >= least_words)
    counts = fit.groupBy("score").agg(F.count("*").alias("n"))
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.withColumn("start", F.coalesce(F.sum("n").over(higher), F.lit(0))))
    draw = percent * (starts.agg(F.sum("n")).first()[0] or 0) // 100
    return fit, starts, starts.where(F.col("start") < draw).agg(F.min("score")).first()[0], draw


def ranked_draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """rows(key, n_words, n_features, weight, score), stored, with rank: 1, 2, 3 ... of the rows drawn, by falling score, then key
    (null last); null for the others. percent of the rows with least_words words are drawn, rounded down.

    Only rows that may be drawn are sorted, those of one score in one task. Equal rows are counted before they meet, and
    take consecutive ranks. A score holds many rows only where keys repeat, as its noise is a hash of the key.
    """
    fit, starts, cut, draw = _cut(rows, percent, least_words)
    columns = [key, "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        return rows.select(*columns, none)
    before = Window.partitionBy("score").orderBy(F.asc_nulls_last(key), "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, -1)
    alike = fit.where(F.col("score") >= cut).groupBy(*columns).agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    each = alike.join(starts.select("score", "start"), "score").select(*columns, F.explode(F.sequence(F.col("start") + F.col("_b") + 1, F.col("start") + F.col("_b") + F.col("_n"))).alias("rank"))
    high = each.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = rows.where((F.col("n_words") < least_words) | (F.col("score") < cut))
    return high.unionByName(rest.select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents drawn towards the texts of target, all columns and n_words, n_features, weight and score.

    The last row to be drawn is found first; then a filter keeps it and all before it, so texts are not shuffled. Order: falling
    score, then key (null last), then a hash of the text; of rows equal in all three, which ones stay is not defined. Empty
    docs: no rows. Empty target: features are weighed by rarity alone.
    """
    gain = gains(docs, target, orders, buckets, text)
    rows, kept = shielded(docs, key, text), docs.columns
    scored = weighed(rows, gain, orders, seed, key, text)
    order = scored.withColumns({"_h": F.xxhash64(text), "_none": F.isnull(key), "_id": F.coalesce(F.col(key), F.lit(0))})
    slim = stored(order.select("n_words", "score", "_none", "_id", "_h"))
    fit, starts, cut, draw = _cut(slim, percent, least_words)
    out = order.where(F.col("n_words") >= least_words)
    if cut is None:
        out = out.where(F.lit(False))
    else:
        above = starts.where(F.col("score") == cut).first()["start"]
        place = Window.partitionBy("score").orderBy("_none", "_id", "_h").rowsBetween(Window.unboundedPreceding, -1)
        alike = fit.where(F.col("score") == cut).groupBy("score", "_none", "_id", "_h").agg(F.count("*").alias("n"))
        last = alike.withColumn("b", F.coalesce(F.sum("n").over(place), F.lit(0))).where(F.col("b") < draw - above).orderBy(F.desc("b")).first()
        mine, edge = F.struct((-F.col("score")).alias("s"), "_none", "_id", "_h"), F.struct(F.lit(-cut).alias("s"), F.lit(last["_none"]).alias("_none"), F.lit(last["_id"]).alias("_id"), F.lit(last["_h"]).alias("_h"))
        if last["n"] <= draw - above - last["b"]:
            out = out.where(mine <= edge)
        else:
            out = out.where(mine < edge).unionByName(out.where(mine == edge).limit(int(draw - above - last["b"])))
    made = ["n_words", "n_features", "weight", "score"]
    out = out.select(*rows.columns, *made)
    keep = [(c, k) for c, k in zip(rows.columns, kept) if k.lower() not in made]
    return out.select(*[c for c, _ in keep], *made).toDF(*[k for _, k in keep], *made)


#: The bits of a CRC step by step, for every distinct feature.
OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
byte AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
texts AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
cut AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM cut),
feature AS (SELECT f, list_reduce(list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) AS c FROM (SELECT DISTINCT f FROM runs), byte),
bucketed AS (SELECT side, id, xor(c, 4294967295) % 10000 AS b FROM runs JOIN feature USING (f)),
counts AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM bucketed GROUP BY b),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (SELECT b, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
weight AS (SELECT id, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM bucketed JOIN gain USING (b) WHERE side = 's' GROUP BY id),
scored AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT doc_id FROM documents) d JOIN cut ON side = 's' AND cut.id = doc_id LEFT JOIN weight ON weight.id = doc_id),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS fit FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * fit // 100 THEN r END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its features, weight, score and rank of the draw towards `benchmark`; see weighed() and ranked_draw()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(docs, table(spark, sf_dir, "benchmark").select("text"))
    rows = stored(weighed(docs, gain).drop("text"))
    return ranked_draw(rows).select("doc_id", "n_features", "weight", "score", "rank")
