"""How an article's terms weigh among those of its law: laws whose articles meet inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs of articles that are held at once, and pairs of postings that are added at once.
PAIRS, POSTINGS = 1 << 19, 1 << 21


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def measures(law: np.ndarray, tokens: pa.Array, k1: float, b: float, epsilon: float, max_df: float) -> tuple[np.ndarray, np.ndarray]:
    """(tfidf, bm25) of articles, law by law, before they are cut to their range; NaN where an article has no terms. law: 0, 1, ... in
    order; tokens: a list of words per article.

    A target's own copy raises the frequency of its terms by one, so the length of an article's vector depends on the target. It
    is the length by plain frequencies, changed by the terms that both have: only these are looked at in pairs.
    """
    n_articles, flat = len(law), tokens.flatten()
    sizes = np.bincount(law)
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    dl = np.asarray(tokens.value_lengths().fill_null(0), np.int64)
    at = np.repeat(np.arange(n_articles), dl)
    coded = flat.dictionary_encode()
    t, v = np.asarray(coded.indices, np.int64), max(1, len(coded.dictionary))
    near = np.flatnonzero(at[1:] == at[:-1])
    pairs, second = np.unique(t[near] * v + t[near + 1], return_inverse=True)
    # one row per term of an article, by law, term, article
    n_terms = v + len(pairs)
    article, term = np.r_[at, at[near]], np.r_[t, v + second]
    place = np.lexsort((article, term, law[article]))
    article, term = article[place], term[place]
    starts, tf = _runs(term * n_articles + article)
    article, term = article[starts], term[starts]
    of, word = law[article], term < v
    begins, df_run = _runs(of * n_terms + term)
    df, n = np.repeat(df_run, df_run), sizes[of]

    idf = lambda d: np.where(d <= (n + 1) * max_df, np.log((n + 2) / (1 + d)) + 1, 0.0)
    plain, own = idf(df), idf(df + 1)
    x, change = tf * own, tf * tf * (own * own - plain * plain)
    add = lambda w: np.bincount(article, w, n_articles)
    base, length, total = add((tf * plain) ** 2), np.sqrt(add(x * x)), add(x)

    known = np.asarray(tokens.is_valid())
    average = np.bincount(law, dl) / np.maximum(1, np.bincount(law, known))
    raw = np.log(n - df + 0.5) - np.log(df + 0.5)
    w0 = begins[word[begins]]
    floor = epsilon * np.bincount(of[w0], raw[w0], len(sizes)) / np.maximum(1, np.bincount(of[w0], minlength=len(sizes)))
    norm = k1 * (1 - b + b * dl[article] / np.maximum(average, 1e-300)[of])
    part = np.where(word, np.where(raw < 0, floor[of], raw) * tf * (k1 + 1) / (tf + norm), 0.0)
    asked = np.where(word, tf, 0)

    cells = sizes.astype(np.int64) ** 2
    origin = np.r_[0, np.cumsum(cells)]
    row = origin[law] + (np.arange(n_articles) - first[law]) * sizes[law]  # of a target's first pair
    dot, moved, score, met = np.zeros(origin[-1]), np.zeros(origin[-1]), np.zeros(origin[-1]), np.zeros(origin[-1], bool)
    left_end, left_start = np.cumsum(df), np.repeat(begins, df_run)
    done = 0
    while done < len(df):
        stop = max(done + 1, int(np.searchsorted(left_end, (left_end[done - 1] if done else 0) + POSTINGS, "right")))
        each = df[done:stop]
        i = np.repeat(np.arange(done, stop), each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + left_start[i]
        cell = row[article[i]] + article[j] - first[of[i]]
        low = int(cell.min())
        span = int(cell.max()) + 1 - low
        where = slice(low, low + span)
        dot[where] += np.bincount(cell - low, x[i] * x[j], span)
        moved[where] += np.bincount(cell - low, change[j], span)
        w = word[i]
        i, j, cell = i[w], j[w], cell[w]
        score[where] += np.bincount(cell - low, asked[i] * part[j], span)
        met[cell] = True
        done = stop

    target = np.repeat(np.arange(n_articles), sizes[law])
    other = np.arange(origin[-1]) - np.repeat(row, sizes[law]) + first[law[target]]
    like = dot > 0
    cosine = np.bincount(target[like], dot[like] / np.sqrt(base[other[like]] + moved[like]) / length[target[like]], n_articles)
    count = sizes[law]
    with np.errstate(invalid="ignore", divide="ignore"):
        tfidf = np.where(total > 0, 10 * (0.7 * total / length + 0.3 * cosine / count), np.nan)
    # articles that share no word score 0
    best, every = np.maximum.reduceat(np.where(met, score, 0.0), row), np.maximum.reduceat(np.where(met, score, -np.inf), row)
    hits = np.add.reduceat(met.astype(np.int64), row)
    best = np.where(hits < count, best, every)
    bm25 = np.where(dl > 0, 2 * (0.6 * np.add.reduceat(score, row) / count + 0.4 * best), np.nan)
    return tfidf, bm25


def laws_in_tasks(rows: DataFrame, k1: float, b: float, epsilon: float, max_df: float) -> DataFrame:
    """(law, article_id, tfidf, bm25) of rows(law, article_id, tokens), each law's articles in one task; see measures()."""
    types = rows.schema
    schema = f"law {types['law'].dataType.simpleString()}, article_id {types['article_id'].dataType.simpleString()}, tfidf double, bm25 double"

    def some(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Laws of a table, as many at once as PAIRS allows."""
        starts, sizes = _runs(np.asarray(table.column("law").combine_chunks().dictionary_encode().indices))
        at = 0
        while at < len(starts):
            stop = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:].astype(np.int64) ** 2), PAIRS, "right")))
            part = table.slice(starts[at], int(sizes[at:stop].sum())).combine_chunks()
            tfidf, bm25 = measures(np.repeat(np.arange(stop - at), sizes[at:stop]), part.column("tokens").combine_chunks(), k1, b, epsilon, max_df)
            yield from part.select(["law", "article_id"]).append_column("tfidf", pa.array(tfidf, from_pandas=True)).append_column("bm25", pa.array(bm25, from_pandas=True)).to_batches()
            at = stop

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts, _ = _runs(np.asarray(table.column("law").combine_chunks().dictionary_encode().indices))
            if len(starts) > 1:  # the last law may go on in the next batch
                yield from some(table.slice(0, starts[-1]))
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None:
            yield from some(held)

    return rows.select("law", "article_id", "tokens").repartition("law").sortWithinPartitions("law").mapInArrow(run, schema)
