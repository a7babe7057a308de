"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score for a language sums log-likelihoods of its hashed byte n-grams. Moving to another language between two
words costs a penalty, so short foreign stretches need enough evidence to be labelled. All of it is learned from labelled
rows; nothing but the text goes into a prediction.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import buffer_of, pieces, prefix_hashes, span_hashes, words
from .common import arrow_map, shared, table, thinned

#: Documents of each language that a model is fitted on, whole texts; the others are not needed for stable counts.
SAMPLE_PER_LANGUAGE = 2000
ORDERS, BUCKETS = (2, 3, 4), 1 << 15
PENALTY = 20.0
#: A language is a candidate for a script if this share of its training words has it.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"

#: Names of code points start with their script, but for these words; of them the script follows or is given.
NAMED = {"CJK": "IDEOGRAPH", "KANGXI": "IDEOGRAPH", "IDEOGRAPHIC": "IDEOGRAPH", "KATAKANA-HIRAGANA": "KATAKANA", "FULLWIDTH": None, "HALFWIDTH": None, "MODIFIER": "LATIN", "SUPERSCRIPT": "LATIN", "SUBSCRIPT": "LATIN", "FEMININE": "LATIN", "MASCULINE": "LATIN", "MICRO": "GREEK"}


def script_ranges() -> tuple[list[str], np.ndarray, np.ndarray]:
    """(scripts, first, script): code points from first[i] up to first[i + 1] hold letters of scripts[script[i]].

    By rule, from the character database: letters are the categories L*, and their script is the first word of the name. -1 is no
    letter; script 0 is the marks (categories M*), which are part of a word but make none. Scripts of fewer than 8 letters
    are one.
    """
    found, runs = [], []
    for c in range(0x323B0):
        kind, name = unicodedata.category(chr(c))[0], None
        if kind == "L":
            parts = (unicodedata.name(chr(c), "") or "OTHER").split()
            name = NAMED.get(parts[0], parts[0]) or parts[1]
            name = NAMED.get(name, name).split("-")[0]
        elif kind == "M":
            name = ""
        found.append(name)
    sizes = Counter(found)
    for c, name in enumerate(found):
        name = "OTHER" if name and sizes[name] < 8 else name
        if not runs or runs[-1][1] != name:
            runs.append((c, name))
    runs.append((len(found), None))
    scripts = ["", *sorted({n for _, n in runs if n})]
    return scripts, np.array([c for c, _ in runs]), np.array([-1 if n is None else scripts.index(n) for _, n in runs], np.int16)


SCRIPTS, _FIRST, _SCRIPT = script_ranges()


def byte_scripts(data: np.ndarray) -> np.ndarray:
    """The script of each byte's code point, -1 where it is no letter."""
    n = len(data)
    pad = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    out = _SCRIPT[np.searchsorted(_FIRST, np.arange(128), "right") - 1][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    b = pad[lead]
    one, two, three = pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
    cp = np.where(b < 0xE0, (b & 31) << 6 | one, np.where(b < 0xF0, (b & 15) << 12 | one << 6 | two, (b & 7) << 18 | one << 12 | two << 6 | three))
    got = _SCRIPT[np.searchsorted(_FIRST, cp, "right") - 1]
    out[lead] = got
    size = np.where(b < 0xE0, 2, np.where(b < 0xF0, 3, 4))
    for k in (1, 2, 3):
        more = size > k
        to = lead[more] + k
        fits = to < n
        out[to[fits]] = got[more][fits]
    return out


def letters(data: np.ndarray, at: np.ndarray) -> tuple:
    """Word starts, ends, row offsets, each word's script, and the padded codes of the bytes (no letter: space)."""
    script = byte_scripts(data)
    is_letter = script >= 0
    # reuse words() on a 0/1 array so that row borders split words
    starts, ends, rows = words(is_letter.view(np.uint8), at, np.arange(256) > 0)
    # reduceat runs on to the next word; what lies between is -1 and cannot win
    of_word = np.maximum.reduceat(script, starts) if len(starts) else np.zeros(0, np.int16)
    real = of_word > 0  # marks alone are no word
    if not real.all():
        starts, ends, rows, of_word = starts[real], ends[real], np.r_[0, np.cumsum(real)][rows], of_word[real]
    return starts, ends, rows, of_word, padded(np.where(is_letter, data, 32))


def padded(data: np.ndarray) -> np.ndarray:
    codes = np.full(len(data) + 2 + max(ORDERS), 32, np.uint32)
    codes[1 : len(data) + 1] = data
    return codes


def gram_codes(codes: np.ndarray, n: int, order: int) -> np.ndarray:
    """Bucket of the n-gram starting at each of n positions of the padded text."""
    h = codes[:n].copy()
    for k in range(1, order):
        h = h * np.uint32(0x01000193) ^ codes[k : n + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: [lang, order, bucket]; scripts: [lang, script] words."""
        self.langs = langs
        tables = np.log(counts + 0.5) - np.log(counts.sum(axis=2, keepdims=True) + 0.5 * BUCKETS)
        if langs:
            tables -= tables.mean(axis=0, keepdims=True)
        self.tables = [np.ascontiguousarray(tables[:, o].T.astype(np.float32)) for o in range(len(ORDERS))]
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        able = (share >= SCRIPT_SHARE).T
        able[~able.any(axis=1)] = True  # a script unseen in training tells nothing
        self.unfit = np.where(able, 0.0, -1e4).astype(np.float32)

    def word_scores(self, starts: np.ndarray, ends: np.ndarray, script: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """Scores of each word; equal words are scored once."""
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        prefix = prefix_hashes(codes[1 : n + 1].astype(np.uint8))
        _, one, of = np.unique(span_hashes(prefix, starts, ends), return_index=True, return_inverse=True)
        size = ends[one] - starts[one]
        to = np.cumsum(size + 1) - size - 1  # words one after another, a blank between
        take = np.repeat(starts[one] - to, size) + np.arange(size.sum()) + np.repeat(np.arange(len(one)), size)
        data = np.full(int(size.sum()) + len(one), 32, np.uint8)
        data[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = codes[1 + take]
        return self._scores(to, to + size, script[one], padded(data), len(data))[of]

    def _scores(self, starts: np.ndarray, ends: np.ndarray, script: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        out = self.unfit[script].astype(np.float64)
        first = starts  # the space before the word, in padded positions
        for order, table in zip(ORDERS, self.tables):
            sums = np.zeros((n + 3, table.shape[1]))
            np.cumsum(table[gram_codes(codes, n + 2, order)], axis=0, out=sums[1:])
            stop = np.maximum(ends + 3 - order, first)
            out += sums[stop] - sums[first]
        return out

    def label(self, scores: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The Viterbi language of every word, rows being separate sequences."""
        langs = scores.shape[1]
        n_rows = len(rows) - 1
        size = np.diff(rows)
        sums = np.zeros((len(scores) + 1, langs))
        np.cumsum(scores, axis=0, out=sums[1:])
        best = (sums[rows[1:]] - sums[rows[:-1]]).argmax(axis=1)
        out = np.repeat(best, size)
        # a row stays in its best language if no stretch favours another by half the penalty
        mixed = np.zeros(n_rows, bool)
        row_of = np.repeat(np.arange(n_rows), size)
        lead = scores[np.arange(len(scores)), out] if len(scores) else np.zeros(0)
        for k in range(langs):
            gain = scores[:, k] - lead
            low = gain.min(initial=0.0) * (size.max(initial=0) + 1) - 1  # rows lie apart so far that their minima don't meet
            run = np.concatenate([[0.0], np.cumsum(gain)])
            base = run[rows[:-1]]
            total = run[1:] - base[row_of]
            before = run[:-1] - base[row_of]
            lowest = np.minimum.accumulate(before + row_of * (low - max(0.0, gain.max(initial=0.0)) * (size.max(initial=0) + 1))) - row_of * (low - max(0.0, gain.max(initial=0.0)) * (size.max(initial=0) + 1))
            hot = total - lowest > PENALTY / 2 - 1e-3
            mixed[row_of[hot]] = True
        todo = np.flatnonzero(mixed)
        if len(todo):
            self._viterbi(scores, rows, todo[np.argsort(-size[todo], kind="stable")], out)
        return out

    def _viterbi(self, scores: np.ndarray, rows: np.ndarray, todo: np.ndarray, out: np.ndarray) -> None:
        """Rows of todo, longest first, word by word in step: the rows that are long enough for a step are the first ones."""
        begin, size = rows[todo], rows[todo + 1] - rows[todo]
        live = np.searchsorted(-size, -np.arange(1, int(size[0])), "left").tolist()  # rows longer than t, for t from 1
        row = np.arange(len(todo))
        value = scores[begin].copy()
        stays, tops = [], []
        for t, n in enumerate(live, 1):
            v = value[:n]
            top = v.argmax(axis=1)
            jump = (v[row[:n], top] - PENALTY)[:, None]
            stays.append(v >= jump)
            tops.append(top.astype(np.int16))
            np.maximum(v, jump, out=v)
            v += scores[begin[:n] + t]
        state = value.argmax(axis=1)
        for t in range(len(live), 0, -1):
            n = live[t - 1]
            s = state[:n]
            out[begin[:n] + t] = s
            state[:n] = np.where(stays[t - 1][row[:n], s], s, tops[t - 1])
        out[begin] = state


def fit(labelled: DataFrame, key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of labelled(key, text, lang), on about per_language documents of each language, chosen by hash of the key.

    Null languages and texts teach nothing. The driver gets counts by language and bucket, whatever the corpus size.
    """
    known = labelled.where(F.col("lang").isNotNull())
    sample = known.where(thinned(known, "lang", per_language, "language", key)).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    cells = len(ORDERS) * BUCKETS + len(SCRIPTS)

    def count(batch):
        data, at = buffer_of(pc.utf8_lower(batch.column(0)))
        langs = batch.column(1).to_pylist()
        sums: dict[str, np.ndarray] = {}
        for i in range(len(langs)):
            part = data[at[i] : at[i + 1]]
            starts, ends, _, script, codes = letters(part, np.array([0, len(part)]))
            mine = sums.setdefault(langs[i], np.zeros(cells, np.int64))
            if not len(starts):
                continue
            for o, order in enumerate(ORDERS):
                delta = np.zeros(len(part) + 4, np.int32)
                stop = ends + 3 - order
                ok = stop > starts
                np.add.at(delta, starts[ok], 1)
                np.add.at(delta, stop[ok], -1)
                inside = np.cumsum(delta)[: len(part) + 2] > 0
                mine[o * BUCKETS : (o + 1) * BUCKETS] += np.bincount(gram_codes(codes, len(part) + 2, order)[inside], minlength=BUCKETS)
            mine[len(ORDERS) * BUCKETS :] += np.bincount(script, minlength=len(SCRIPTS))
        for lang, mine in sums.items():
            at_ = np.flatnonzero(mine)
            yield {"lang": [lang] * len(at_), "cell": at_.astype(np.int32), "n": mine[at_]}

    totals = arrow_map(sample, count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(totals.column("lang").to_pylist()))
    full = np.zeros((len(names), cells))
    if names:
        full[np.searchsorted(np.array(names, dtype=object).astype(str), np.array(totals.column("lang").to_pylist(), dtype=str)), totals.column("cell").to_numpy()] = totals.column("n").to_numpy()
    return Model(names, full[:, : len(ORDERS) * BUCKETS].reshape(len(names), len(ORDERS), BUCKETS), full[:, len(ORDERS) * BUCKETS :])


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score (share of the words in that language) and, if asked, lang_spans: runs of (words, language).

    Null text, text without letters, or a model without languages: `und`, score 0. Ties go to the first language by name.
    Texts are read whole, however long; rows are judged one by one, whether their keys are null or repeat. Columns of docs
    named like the new ones are replaced, all others kept. Empty docs give no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "lang_spans")])
    given = shared(docs.sparkSession, model)
    extra = {"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)} | ({"lang_spans": F.array().cast("array<struct<words:int,lang:string>>")} if spans else {})
    schema = docs.limit(0).withColumns(extra).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        model = given()
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            data, at = buffer_of(pc.utf8_lower(batch.column(batch.schema.get_field_index("text"))))
            n = batch.num_rows
            pred, score, runs = np.full(n, len(model.langs)), np.zeros(n), [[] for _ in range(n)]
            for i, j in pieces(at) if model.langs else []:
                part, here = data[at[i] : at[j]], at[i : j + 1] - at[i]
                starts, ends, rows, script, codes = letters(part, here)
                if not len(starts):
                    continue
                label = model.label(model.word_scores(starts, ends, script, codes, len(part)), rows)
                row_of = np.repeat(np.arange(j - i), np.diff(rows))
                votes = np.bincount(row_of * len(model.langs) + label, minlength=(j - i) * len(model.langs)).reshape(j - i, -1)
                some = votes.sum(axis=1) > 0
                pred[i:j][some] = votes[some].argmax(axis=1)
                score[i:j][some] = votes[some].max(axis=1) / votes[some].sum(axis=1)
                if spans:
                    cut = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (row_of[1:] != row_of[:-1])])
                    for c, k in zip(cut, np.diff(np.r_[cut, len(label)])):
                        runs[i + row_of[c]].append({"words": int(k), "lang": model.langs[label[c]]})
            cols = {f.name: batch.column(f.name) for f in arrow if f.name in batch.schema.names} | {"lang_pred": pa.array(names[pred], pa.string()), "score": pa.array(score), "lang_spans": runs}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if isinstance(cols[f.name], list) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    return docs.mapInArrow(run, schema)


def held_out(modulus: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents; a null doc_id is not held out. Learns from the others' text and lang."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(4, 2), F.lit(False))
    model = fit(docs.where(~out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
