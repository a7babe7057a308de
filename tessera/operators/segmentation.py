"""Words of scripts without blanks: a dictionary found in the corpus, the best path through a text's word lattice, and keywords on it."""

from __future__ import annotations

import math
import pickle
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BETWEEN
from ..sources import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no package path

HAN = "\\p{IsHan}+"
#: Runs that a task remembers the words of, at most, and words of a dictionary that travels to tasks.
REMEMBERED, WORDS = 200_000, 1_000_000


def _runs(texts: DataFrame, text: str, runs: str) -> DataFrame:
    """(run, c): the distinct runs of the script and how often they occur; counted where they lie before they shuffle."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(runs), F.lit(0))).alias("run")).groupBy("run").agg(F.count("*").alias("c"))


def dictionary(texts: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 1.0, freedom: float = 0.5, runs: str = HAN) -> DataFrame:
    """(word, n, cohesion, freedom): runs of 2 to `longest` characters that hold together and stand freely, and all single ones.

    cohesion: the least, over all ways to part a word in two, of the logarithm of its probability over the parts' product; freedom:
    the smaller entropy of the characters before it and behind it (the border of a run counts as one). A word occurs at least
    `least` times; single characters are taken as they are, with cohesion and freedom null. Null texts have none.
    """
    told = stored(_runs(texts, text, runs))
    n, i = F.col("n"), F.col("i")
    sizes = told.select("run", "c", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run")))).alias("n"))
    each = sizes.select("run", "c", "n", F.explode(F.sequence(F.lit(1), F.length("run") - n + 1)).alias("i"))
    before = F.when(i > 1, F.substring("run", i - 1, F.lit(1))).otherwise("")
    grams = each.select(F.substring("run", i, n).alias("word"), before.alias("before"), F.substring("run", i + n, F.lit(1)).alias("behind"), "c")
    counts = stored(grams.groupBy("word").agg(F.sum("c").alias("n")))
    long = F.length("word") > 1

    def entropy(side: str) -> DataFrame:
        met = grams.where(long).groupBy("word", side).agg(F.sum("c").cast("double").alias("x")).groupBy("word")
        return met.agg((F.log(F.sum("x")) - F.sum(F.col("x") * F.log("x")) / F.sum("x")).alias(f"of_{side}"))

    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 1
    some = counts.where(long & (F.col("n") >= least))
    parts = some.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k"))
    parts = parts.select("word", "n", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.substring("word", F.col("k") + 1, F.length("word")).alias("b"))
    a, b = counts.select(F.col("word").alias("a"), F.col("n").alias("na")), counts.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    holds = parts.join(a, "a").join(b, "b").groupBy("word", "n").agg(F.round(F.min(F.log(F.col("n").cast("double") * total / (F.col("na").cast("double") * F.col("nb")))), 6).alias("cohesion"))
    free = entropy("before").join(entropy("behind"), "word").select("word", F.round(F.least("of_before", "of_behind"), 6).alias("freedom"))
    words = holds.join(free, "word").where((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom)).select("word", "n", "cohesion", "freedom")
    return words.unionByName(counts.where(~long).select("word", "n", F.lit(None).cast("double").alias("cohesion"), F.lit(None).cast("double").alias("freedom")))


class Lattice:
    """Best path through the words of a run: the greatest sum of log-probabilities, then fewest words, then the longer word first."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.score = {w: round(math.log(n / total), 9) for w, n in counts.items()}
        self.unknown, self.longest = round(math.log(0.5 / total), 9), max(map(len, counts), default=1)
        self.known: dict[str, list[str]] = {}

    def path(self, run: str) -> list[str]:
        """The words of a run; characters that the dictionary lacks are words of their own. Linear in the run's length."""
        if (found := self.known.get(run)) is not None:
            return found
        n = len(run)
        best: list[tuple] = [(0.0, 0, 0)] * (n + 1)  # of what lies behind: score, -words, length of the first word
        for i in range(n - 1, -1, -1):
            options = []
            for k in range(1, min(self.longest, n - i) + 1):
                s = self.score.get(run[i : i + k], self.unknown if k == 1 else None)
                if s is not None:
                    after = best[i + k]
                    options.append((round(s + after[0], 9), after[1] - 1, k))
            best[i] = max(options)
        out, i = [], 0
        while i < n:
            out.append(run[i : i + best[i][2]])
            i += best[i][2]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[run] = out
        return out


def segmented(texts: DataFrame, words: DataFrame, text: str = "text", out: str = "tokens", least: int = 2) -> DataFrame:
    """texts with `out`: lower-cased words of other scripts of at least `least` characters, then the words of each run of Chinese
    characters by words(word, n), of dictionary() for one. Null and empty texts have none.

    The dictionary travels to the tasks; one of more than WORDS words is an error: ask for a higher count.
    """
    told = words.select("word", "n").limit(WORDS + 1).toPandas()
    if len(told) > WORDS:
        raise ValueError(f"over {WORDS} words: raise the least count")
    packed = texts.sparkSession.sparkContext.broadcast(pickle.dumps(dict(zip(told["word"], told["n"].tolist()))))
    pattern = re.compile("[⺀-⿟々〇〡-〩〸-〻㐀-䶿一-鿿豈-﫿\U00020000-\U000323af]+")  # fixed value: the blocks of the script

    @F.arrow_udf("array<string>")
    def cut(column: pa.Array) -> pa.Array:
        lattice = getattr(packed, "_lattice", None)
        if lattice is None:
            lattice = packed._lattice = Lattice(pickle.loads(packed.value))
        return pa.array([[w for run in pattern.findall(t or "") for w in lattice.path(run)] for t in column.to_pylist()], pa.list_(pa.string()))

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    plain = F.filter(F.split(low, BETWEEN), lambda t: F.length(t) >= least)
    return texts.withColumn(out, F.concat(plain, cut(F.col(text))))


def keywords(rows: DataFrame, key: str, tokens: Column, k: int = 10, least: int = 2) -> DataFrame:
    """(key, term, tf, score, rank): the k words of a row with the highest tf * (ln((1 + N) / (1 + df)) + 1), ties by term.

    Words of fewer than `least` characters are no keywords. A word's count in a row is made where the row lies.
    """
    from .retrieval import VOCABULARY, counted, small, top

    told = stored(rows.select(key, counted(F.filter(tokens, lambda t: F.length(t) >= least)).alias("terms")))
    n = told.count()
    each = told.select(key, F.inline("terms"))
    idf = each.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    scored = each.join(small(stored(idf), VOCABULARY), "term").withColumn("score", F.round(F.col("tf") * F.col("idf"), 6))
    return top(scored, [key], k, ["term"]).select(key, "term", "tf", "score", "rank")
