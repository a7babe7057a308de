"""Toxicity: a convolutional text classifier, trained and applied in Spark tasks.

Labelled texts are dealt into shards of bounded size. Each round every shard's task trains the model of the round before in numpy, and what
the tasks changed is averaged, each embedding over the steps that met it.

A word's embedding is the sum of one for the hashed word and one for its hashed first bytes. Filters of widths 1, 2 and 3
run over the words, the maximum over the whole text is pooled, and a logistic layer scores it. A filter's answer is a sum
over its words, so scoring looks up each word's answers in a table and never multiplies matrices. The probability is mapped
so that 0.7 stands for the threshold that is best for the text's language, which is guessed from the words.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import ASCII_LOWER, buffer_of, pieces, prefix_hashes, span_hashes, words
from .common import arrow_map, hashed, replacing, shared, stored, table, thinned
from .language_id import held_out

#: Labelled documents of each class a model is fitted on, whole texts, chosen by hash of the key, and the bytes of text that
#: they may be expected to have: the driver's share of the work is bounded by both.
SAMPLE_PER_LABEL, SAMPLE_BYTES = 4000, 24 << 20
WORDS, PREFIXES, PREFIX_BYTES = 1 << 16, 1 << 14, 6
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Rounds of training over all shards, an epoch each, and labelled documents and bytes of text of a shard.
ROUNDS, SHARD_ROWS, SHARD_BYTES = 4, 8192, 16 << 20
#: Labels that may be broadcast, and numbers of a model that travel as one row.
FEW_LABELS, VALUES = 100_000, 2048
#: Levels at which a language's threshold is looked for.
CUTS = np.linspace(0.05, 0.95, 91)
NAMES = ("word", "head", "filters", "shift", "out")
PREDICT_AT = 0.7

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: Column of the answer table for each (filter width, word of the filter).
PARTS = [(w, j) for w in WIDTHS for j in range(w)]
PAD = WORDS - 1


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, prefix bucket and row offsets of lower-cased letters' runs; a wordless row gets one padding word."""
    part = ASCII_LOWER[data]
    starts, ends, rows = words(part, at, WORD_BYTES)
    prefix = prefix_hashes(part)
    word = (span_hashes(prefix, starts, ends) % np.uint64(WORDS - 1)).astype(np.int32)
    head = (span_hashes(prefix, starts, np.minimum(ends, starts + PREFIX_BYTES)) % np.uint64(PREFIXES - 1)).astype(np.int32)
    empty = np.flatnonzero(rows[1:] == rows[:-1])
    if len(empty):
        word, head = np.insert(word, rows[empty], PAD), np.insert(head, rows[empty], PREFIXES - 1)
        rows = rows + np.r_[0, np.cumsum(rows[1:] == rows[:-1])]
    return word, head, rows


def pooled(answers: np.ndarray, rows: np.ndarray, where: bool = False):
    """Maximum over each row's words of every filter, and where it stands. answers: [word, part, filter]."""
    n, out, at = len(answers), [], []
    column = 0
    last = np.repeat(rows[1:], np.diff(rows))
    for w in WIDTHS:
        sums = answers[:, column].copy()
        for j in range(1, w):  # words beyond the row's end add nothing
            inside = np.flatnonzero(np.arange(n - j) + j < last[: n - j])
            sums[inside] += answers[inside + j, column + j]
        column += w
        top = np.maximum.reduceat(sums, rows[:-1], axis=0)
        out.append(top)
        if where:
            spot = np.where(sums == np.repeat(top, np.diff(rows), axis=0), np.arange(n)[:, None], n)
            at.append(np.minimum.reduceat(spot, rows[:-1], axis=0))
    return (np.concatenate(out, axis=1), at) if where else np.concatenate(out, axis=1)


def _taken(rows: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(take, local): where the words of some documents stand, one after the other, and their offsets there."""
    size = rows[some + 1] - rows[some]
    local = np.r_[0, np.cumsum(size)]
    return np.repeat(rows[some] - local[:-1], size) + np.arange(local[-1]), local


def label_hits(word: np.ndarray, rows: np.ndarray, label: np.ndarray, ready: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hits, n): documents of each label that hold each word bucket, and all documents of each label."""
    hits = np.zeros((2, WORDS))
    for d in ready:
        hits[int(label[d]), np.unique(word[rows[d] : rows[d + 1]])] += 1
    return hits, np.array([(label[ready] == k).sum() for k in (0, 1)])


def language_counts(word: np.ndarray, rows: np.ndarray, langs: list[str]) -> dict[str, np.ndarray]:
    of: dict[str, np.ndarray] = {}
    for d, lang in enumerate(langs):
        if lang is not None:
            np.add.at(of.setdefault(lang, np.zeros(WORDS)), word[rows[d] : rows[d + 1]], 1)
    return of


class Classifier:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.word = (rng.standard_normal((WORDS, DIM)) * 0.05).astype(f)
        self.head = (rng.standard_normal((PREFIXES, DIM)) * 0.05).astype(f)
        self.filters = (rng.standard_normal((len(PARTS), DIM, FILTERS)) * 0.3).astype(f)
        self.shift = np.zeros(len(WIDTHS) * FILTERS, f)
        self.out, self.bias = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(f), f(-1.0)
        self.languages: list[str] = []
        self.language_table = np.zeros((WORDS, 1), f)
        self.cuts = np.array([0.5])

    def fit(self, word: np.ndarray, head: np.ndarray, rows: np.ndarray, label: np.ndarray, langs: list[str]) -> None:
        """On all sampled documents; a quarter of them, every fourth, sets the thresholds and is not trained on."""
        docs = np.arange(len(label))
        ready = docs[docs % 4 != 3] if len(docs) >= 40 else docs
        self.set_languages(language_counts(word, rows, langs))
        self.start(*label_hits(word, rows, label, ready))
        state = self.moments()
        rng = np.random.default_rng(11)
        for epoch in range(EPOCHS):
            self.train(word, head, rows, label, ready, 1 - 0.8 * epoch / EPOCHS, rng, state)
        held = docs[docs % 4 == 3] if len(docs) >= 40 else docs
        self.set_thresholds(self.levels(word, head, rows, label, held))

    def moments(self) -> dict:
        return {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in NAMES} | {"step": 0, "slope": 0.0}

    def train(self, word, head, rows, label, ready: np.ndarray, pace: float, rng, state: dict) -> dict[str, np.ndarray]:
        """One epoch over the documents `ready`. Returns in how many steps each row of the embeddings was changed."""
        met = {k: np.zeros(len(getattr(self, k))) for k in ("word", "head")}
        rng.shuffle(ready)
        for i in range(0, len(ready), BATCH):
            some = ready[i : i + BATCH]
            state["step"] += 1
            take, local = _taken(rows, some)
            grad, err = self.gradients(word[take], head[take], local, label[some])
            for k in NAMES:
                at = self._adam(k, grad[k], state[k], RATE * pace, state["step"])
                if k in met:
                    met[k][at] += 1
            state["slope"] = 0.9 * state["slope"] + 0.1 * err.sum()
            self.bias -= np.float32(RATE * pace * 5 * state["slope"])
        return met

    def numbers(self) -> dict[str, np.ndarray]:
        """The model's numbers as tables: a row is averaged by its own weight."""
        dense = np.concatenate([self.filters.ravel(), self.shift, self.out, [self.bias]]).astype(np.float32)
        return {"word": self.word, "head": self.head, "dense": dense[None]}

    def set_numbers(self, told: dict[str, np.ndarray]) -> None:
        self.word, self.head = told["word"].copy(), told["head"].copy()
        at = np.cumsum([self.filters.size, self.shift.size, self.out.size])
        filters, self.shift, self.out, bias = (x.copy() for x in np.split(told["dense"][0], at))
        self.filters, self.bias = filters.reshape(self.filters.shape), np.float32(bias[0])

    def gradients(self, word: np.ndarray, head: np.ndarray, rows: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Slopes of the documents' mean log loss plus 0.5e-4 times the squares of filters and out, and the documents' errors."""
        x = self.word[word] + self.head[head]
        answers = (x @ self.filters.transpose(1, 0, 2).reshape(DIM, -1)).reshape(len(x), len(PARTS), FILTERS)
        top, at = pooled(answers, rows, True)
        act = np.maximum(top + self.shift, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias, -30, 30)))
        err = ((p - label) / len(label)).astype(np.float32)
        grad = {"out": act.T @ err + 1e-4 * self.out}
        back = err[:, None] * self.out * (act > 0)
        grad["shift"] = back.sum(axis=0)
        grad["filters"] = 1e-4 * self.filters
        grad["word"], grad["head"] = np.zeros_like(self.word), np.zeros_like(self.head)
        column = 0
        for k, w in enumerate(WIDTHS):
            b = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                spot = at[k] + j
                fits = spot < rows[1:, None]
                spot = np.minimum(spot, len(x) - 1)
                bb = b * fits
                grad["filters"][column + j] += np.einsum("nfd,nf->df", x[spot], bb)
                gx = bb[:, :, None] * self.filters[column + j].T[None]
                live = np.abs(bb).ravel() > 0
                np.add.at(grad["word"], word[spot.ravel()[live]], gx.reshape(-1, DIM)[live])
                np.add.at(grad["head"], head[spot.ravel()[live]], gx.reshape(-1, DIM)[live])
            column += w
        return grad, err

    def _adam(self, name: str, grad: np.ndarray, state: list[np.ndarray], rate: float, step: int) -> np.ndarray | None:
        value, (m, v), at = getattr(self, name), state, None
        if name in ("word", "head"):  # only the rows that were looked at
            at = np.flatnonzero(grad.any(axis=1))
            m[at] = 0.9 * m[at] + 0.1 * grad[at]
            v[at] = 0.99 * v[at] + 0.01 * grad[at] ** 2
            value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)
        else:
            m[...] = 0.9 * m + 0.1 * grad
            v[...] = 0.99 * v + 0.01 * grad**2
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return at

    def start(self, hits: np.ndarray, n: np.ndarray) -> None:
        """The first coordinate of a word's embedding starts as its shrunk log-odds in the training documents; see label_hits()."""
        n = np.maximum(n, 1)
        odds = np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1))
        self.word[:, 0] += np.where(hits.sum(axis=0) >= 3, np.clip(odds, -3, 3), 0).astype(np.float32) * 0.3
        self.filters[:, 0, : FILTERS // 2] = np.abs(self.filters[:, 0, : FILTERS // 2]) + 0.3
        self.out[np.r_[tuple(np.arange(k * FILTERS, k * FILTERS + FILTERS // 2) for k in range(len(WIDTHS)))]] = 0.5

    def set_languages(self, told: dict[str, np.ndarray]) -> None:
        """told: how often each language's documents hold each word bucket."""
        self.languages = sorted(told) or [""]
        counts = np.stack([0.5 + told.get(x, np.zeros(WORDS)) for x in self.languages], axis=1)
        table = np.log(counts / counts.sum(axis=0))
        self.language_table = (table - table.mean(axis=1, keepdims=True)).astype(np.float32)

    def language(self, word: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.language_table[word], rows[:-1], axis=0).argmax(axis=1)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Answers of all filters to every word bucket and prefix bucket."""
        flat = self.filters.transpose(1, 0, 2).reshape(DIM, -1)
        return self.word @ flat, self.head @ flat

    def probability(self, word: np.ndarray, head: np.ndarray, rows: np.ndarray, tables=None) -> np.ndarray:
        a, b = tables or self.table()
        top = pooled((a[word] + b[head]).reshape(len(word), len(PARTS), FILTERS), rows)
        return 1 / (1 + np.exp(-np.clip(np.maximum(top + self.shift, 0) @ self.out + self.bias, -30, 30)))

    def levels(self, word, head, rows, label, held: np.ndarray) -> np.ndarray:
        """[guessed language, label, level]: how many of the documents `held` reach each of CUTS; the last level counts all."""
        tables, out = self.table(), np.zeros((len(self.languages), 2, len(CUTS) + 1))
        for i in range(0, len(held), BATCH):
            some = held[i : i + BATCH]
            take, local = _taken(rows, some)
            p = self.probability(word[take], head[take], local, tables)
            np.add.at(out, (self.language(word[take], local), label[some].astype(int)), np.c_[p[:, None] >= CUTS, np.ones(len(p), bool)])
        return out

    def set_thresholds(self, levels: np.ndarray) -> None:
        def best(of: np.ndarray) -> float:
            """The middle of the best F1's plateau; the classes are weighed as they are in the labelled documents."""
            f1 = 2 * of[1, :-1] / np.maximum(1, of[1, -1] + of[:, :-1].sum(axis=0))
            return float(np.median(CUTS[f1 >= f1.max() - 1e-9]))

        every = best(levels.sum(axis=0)) if levels[:, :, -1].sum(axis=0).all() else 0.5
        self.cuts = np.array([best(x) if (x[:, -1] >= 10).all() else every for x in levels])

    def score(self, word: np.ndarray, head: np.ndarray, rows: np.ndarray, tables) -> np.ndarray:
        p, cut = self.probability(word, head, rows, tables), self.cuts[self.language(word, rows)]
        return np.where(p >= cut, PREDICT_AT + (1 - PREDICT_AT) * (p - cut) / (1 - cut), PREDICT_AT * p / cut * (1 - 1e-9))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", per_label: int = SAMPLE_PER_LABEL) -> Classifier:
    """A classifier of docs(key, text, lang) and labels(key, toxic 0/1), on about per_label documents of each class.

    Other labels and null texts teach nothing; of several labels of a document the highest counts, and rows that repeat a key
    teach once each. The sample is thinned by hash of the key, alike for documents of all lengths, until about per_label
    rows and SAMPLE_BYTES / 2 bytes of a class are expected; its keys (about twice per_label rows) are broadcast, and the driver gets
    hashed words of that sample only.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.where(thinned(known, "toxic", per_label, "toxicity", key))
    sample = docs.where(F.col("text").isNotNull()).select(key, "text", "lang").join(F.broadcast(picked), key)
    mean = max((r["n"] or 0 for r in sample.groupBy("toxic").agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()), default=0)
    if mean > SAMPLE_BYTES // 2:
        sample = sample.where(hashed("toxicity, fewer", key) / float(1 << 52) < SAMPLE_BYTES / 2 / mean)

    def hash_words(batch):
        data, at = buffer_of(batch.column(1))
        word, head, rows = tokens(data, at)
        return {"key": batch.column(0), "words": [word[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], "heads": [head[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])], "toxic": batch.column(2), "lang": batch.column(3)}

    got = arrow_map(sample.select(key, "text", "toxic", "lang"), hash_words, f"key {dict(docs.dtypes)[key]}, words binary, heads binary, toxic int, lang string").toArrow().sort_by([("key", "ascending"), ("words", "ascending")])
    model = Classifier()
    if got.num_rows:
        docs = [np.frombuffer(x, np.int32) for x in got.column("words").to_pylist()]
        mix = np.random.default_rng(3).permutation(len(docs))
        heads = [np.frombuffer(x, np.int32) for x in got.column("heads").to_pylist()]
        rows = np.r_[0, np.cumsum([len(docs[i]) for i in mix])]
        langs = got.column("lang").to_pylist()
        model.fit(np.concatenate([docs[i] for i in mix]), np.concatenate([heads[i] for i in mix]), rows, got.column("toxic").to_numpy()[mix].astype(np.float32), [langs[i] for i in mix])
    return model


def _shards(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(shard, words, heads, sizes, toxic, held, langs): all labelled documents as hashed words, one row a shard, stored.

    Documents are dealt by hash; a quarter of the keys is `held` for thresholds, or all documents are in both parts if there are under 40.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy(key).agg(F.max("toxic").cast("int").alias("toxic"))
    known = F.broadcast(known) if known.count() <= FEW_LABELS else known
    rows = docs.where(F.col("text").isNotNull()).select(key, "text", "lang").join(known, key)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    held = F.pmod(F.xxhash64(F.lit("toxicity, held"), key), F.lit(4)) == 3 if n >= 40 else F.lit(None).cast("boolean")
    order = F.xxhash64(F.lit("toxicity"), key, "text")
    rows = rows.select("text", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), F.col("toxic").cast("tinyint").alias("toxic"), F.coalesce(held.cast("tinyint"), F.lit(2).cast("tinyint")).alias("held"), "lang")

    def hash_words(batch):
        data, at = buffer_of(batch.column(0))
        for i, j in pieces(at):
            word, head, cut = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
            word, head = word.astype(np.uint16), head.astype(np.uint16)
            given = {c: batch.column(k).slice(i, j - i) for k, c in enumerate(batch.schema.names) if k}
            yield given | {"words": [word[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], "heads": [head[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]}

    def pack(batches):
        def packed():
            words, heads, toxic, held, langs = zip(*kept)
            sizes = np.array([len(w) // 2 for w in words], np.int64)
            cols = [[now], [b"".join(words)], [b"".join(heads)], [sizes.tobytes()], [np.array(toxic, np.int8).tobytes()], [np.array(held, np.int8).tobytes()], [list(langs)]]
            kinds = [pa.int32(), *[pa.binary()] * 5, pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "words", "heads", "sizes", "toxic", "held", "langs"])

        now, kept = None, []
        for batch in batches:
            for shard, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if shard != now and kept:
                    yield packed()
                    kept = []
                now = shard
                kept.append(row)
        if kept:
            yield packed()

    told = arrow_map(rows, hash_words, "shard int, order long, toxic tinyint, held tinyint, lang string, words binary, heads binary")
    dealt = told.repartition(shards, "shard").sortWithinPartitions("shard", "order", "words").select("shard", "words", "heads", "toxic", "held", "lang")
    return stored(dealt.mapInArrow(pack, "shard int, words binary, heads binary, sizes binary, toxic binary, held binary, langs array<string>"))


def _summed(shards: DataFrame, work: Callable) -> dict[str, np.ndarray]:
    """The sums over all shards of what work(shard, word, head, rows, label, ready, held, langs) yields as (name, numbers).

    Numbers are cut into rows of VALUES, which are summed in the order of their shards by tasks; the driver gets the sums.
    """

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, word, head, sizes, toxic, held, langs = (batch.column(c)[i].as_py() for c in batch.schema.names)
                word, head = (np.frombuffer(x, np.uint16).astype(np.int32) for x in (word, head))
                rows, held = np.r_[0, np.cumsum(np.frombuffer(sizes, np.int64))], np.frombuffer(held, np.int8)
                given = shard, word, head, rows, np.frombuffer(toxic, np.int8).astype(np.float32), np.flatnonzero(held != 1), np.flatnonzero(held != 0), langs
                for name, numbers in work(*given):
                    flat = np.asarray(numbers, np.float32).ravel()
                    cut = [flat[k : k + VALUES] for k in range(0, len(flat), VALUES)]
                    live = [k for k, x in enumerate(cut) if x.any()] or [0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(live)), pa.array(live, pa.int32()), pa.array([shard] * len(live), pa.int32()), pa.array([cut[k].tobytes() for k in live], pa.binary())], names=["name", "k", "shard", "numbers"])

    def add(batches):
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["name", "k", "total"])
        for batch in batches:
            for name, k, numbers in zip(*[c.to_pylist() for c in batch.columns]):
                if (name, k) != now:
                    if now is not None:
                        yield row()
                    now, total = (name, k), np.zeros(len(numbers) // 4)
                total += np.frombuffer(numbers, np.float32)
        if now is not None:
            yield row()

    parts = shards.mapInArrow(each, "name string, k int, shard int, numbers binary")
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = parts.repartition(n, "name", "k").sortWithinPartitions("name", "k", "shard").select("name", "k", "numbers").mapInArrow(add, "name string, k int, total binary").collect()
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in met:
        out.setdefault(r["name"], {})[r["k"]] = np.frombuffer(r["total"])
    return {name: _joined(of) for name, of in out.items()}


def _joined(of: dict[int, np.ndarray]) -> np.ndarray:
    """Rows of VALUES put together; those that are missing are zeros. The last row that came may be the last of all or a whole one."""
    out = np.zeros((max(of) + 1) * VALUES)
    for k, x in of.items():
        out[k * VALUES : k * VALUES + len(x)] = x
    return out


def _filled(found: dict[str, np.ndarray], name: str, shape: tuple) -> np.ndarray:
    """The sums of a name in their shape: what is missing behind the last row that came is zero."""
    n, got = int(np.prod(shape)), found.get(name, np.zeros(0))[: int(np.prod(shape))]
    return np.r_[got, np.zeros(n - len(got))].reshape(shape)


def fit_whole(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Classifier:
    """A classifier of docs(key, text, lang) and labels(key, toxic 0/1), of all labelled documents: three quarters of them train it, the
    others set its thresholds, and both count the words of the languages.

    Other labels and null texts teach nothing; of several labels of a document the highest counts, and rows that repeat a key
    teach once each. Words are hashed and dealt into shards once. In each of ROUNDS rounds every shard's task trains the model of the
    round before, and the driver gets the mean of what they changed: a model, whatever the number of documents.
    """
    spark, model, shards = docs.sparkSession, Classifier(), _shards(docs, labels, key)

    def count(shard, word, head, rows, label, ready, held, langs):
        yield from zip(("hits", "n"), label_hits(word, rows, label, ready))
        for lang, counts in language_counts(word, rows, langs).items():
            yield f"={lang}", counts

    found = _summed(shards, count)
    if not found:
        return model
    model.set_languages({name[1:]: _filled(found, name, (WORDS,)) for name in found if name.startswith("=")})
    model.start(_filled(found, "hits", (2, WORDS)), _filled(found, "n", (2,)))
    for r in range(ROUNDS):
        given = shared(spark, model)

        def learn(shard, word, head, rows, label, ready, held, langs):
            mine, before = Classifier(), given().numbers()
            mine.set_numbers(before)
            met = mine.train(word, head, rows, label, ready, 1 - 0.8 * r / ROUNDS, np.random.default_rng([11, shard, r]), mine.moments())
            for name, now in mine.numbers().items():
                weight = met.get(name, np.array([len(ready)]))
                yield name, (now - before[name]) * weight[:, None]
                yield f"{name}, weight", weight

        found, told = _summed(shards, learn), model.numbers()
        for name, before in told.items():
            weight = _filled(found, f"{name}, weight", (len(before), 1))
            told[name] = (before + _filled(found, name, before.shape) / np.maximum(weight, 1)).astype(np.float32)
        model.set_numbers(told)
    given = shared(spark, model)

    def check(shard, word, head, rows, label, ready, held, langs):
        yield "levels", given().levels(word, head, rows, label, held)

    model.set_thresholds(_filled(_summed(shards, check), "levels", (len(model.languages), 2, len(CUTS) + 1)))
    return model


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs' columns but text, with score (0 to 1) and predicted (score >= 0.7). Null and wordless texts are scored as one padding
    word, long texts whole; rows are judged one by one, whether their keys are null or repeat. Columns of docs named score or
    predicted, in any case, are replaced. Empty docs give no rows."""
    docs, names = replacing(docs, ["score", "predicted"], "text")
    keep = [c for c in docs.columns if c != "text"]
    given = shared(docs.sparkSession, (model, model.table()))

    def one(batch):
        model, tables = given()
        data, at = buffer_of(batch.column(len(keep)))
        out = np.zeros(batch.num_rows)
        for i, j in pieces(at):
            word, head, rows = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
            out[i:j] = model.score(word, head, rows, tables)
        return {c: batch.column(k) for k, c in enumerate(keep)} | {"score": out, "predicted": (out >= PREDICT_AT).astype(np.int32)}

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return arrow_map(docs.select(*keep, "text"), one, f"{kinds}, score double, predicted int").toDF(*[n for n in names if n != "text"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; a null doc_id is not held out. Learns from the others' labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(held_out(3, 1), F.lit(False))
    model = fit_whole(docs.where(~out), labels.where(~out))
    return score(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "score", "predicted")
