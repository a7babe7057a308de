"""Interval joins: ranges meet in the buckets of positions that they touch, so a document with many ranges makes no pairs of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of one bucket.
BUCKET = 1000


def touching(left: DataFrame, right: DataFrame, by: str, ours: tuple[Column, Column], theirs: tuple[Column, Column], bucket: int = BUCKET) -> DataFrame:
    """left joined with right on `by` where their closed ranges have a point in common, all columns of both.

    ours and theirs: the first and last point, of left's and right's own columns; a range whose last point lies before its first
    touches nothing. A range is copied into each bucket that it touches; of the buckets that two ranges share, only the one with
    the first common point keeps the pair, so each pair comes once. Column names must differ but for `by`.
    """
    at = lambda c: F.floor(c / bucket)
    spread = lambda df, lo, hi, a, b: df.withColumns({a: lo, b: hi}).where(F.col(b) >= F.col(a)).withColumn("_bucket", F.explode(F.sequence(at(F.col(a)), at(F.col(b)))))
    both = spread(left, *ours, "_a", "_b").join(spread(right, *theirs, "_c", "_d"), [by, "_bucket"])
    first = F.greatest("_a", "_c")
    return both.where((first <= F.least("_b", "_d")) & (F.col("_bucket") == at(first))).drop("_bucket", "_a", "_b", "_c", "_d")
