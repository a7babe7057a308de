"""The numbered operators against brute force, exact round trips and edge cases, on small tables."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, html_extract, language_id, mixing, near_embeddings, queries, sharding, simhash_dedup, suffix_dedup, toxicity
from tessera.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the quick fox and the lazy dog were running over the hill with them ", "der schnelle Fuchs und die faule Ente liefen über den Hügel und nicht weit "
ODD = [
    (None, "no id at all here", "en", None, 17), (1, None, None, "a", 0), (2, "", "en", "b", 0), (3, "... 123", "en", "a", 7),
    (4, EN * 12, "en", "a", 1), (5, DE * 12, "de", "b", 1), (6, EN * 12, "en", None, 1), (7, EN * 400, "en", "a", 1), (8, "x" * 5000, "en", "c", 1), (8, "x" * 5000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def folder(df, tmp_path, name="documents", **others):
    for k, v in ({name: df} | others).items():
        v.write.parquet(f"{tmp_path}/{k}.parquet")
    return str(tmp_path)


# --- components, embeddings ---------------------------------------------------------------------------------------------
def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(300, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 140)} | {300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(vectors):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(v)}
    return [sum(1 for j, w in ok.items() if j != i and ok[i] @ w >= 0.9) if i in ok else 0 for i in range(len(vectors))]


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[:30] + rng.standard_normal((30, 16)) * 0.08, np.repeat(base[:1], 30, 0), base[1:2] + rng.standard_normal((60, 16)) * 0.02])
    rows = [[float(np.float32(x)) for x in v] for v in near] + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, []]
    got = near_embeddings.near_links(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == brute_links([v if v else None for v in rows])
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got)
    assert near_embeddings.near_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_doubles_and_of_several_lengths(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((8, 5))
    rows = [[1e200, 1.0], [1e200, 2.0], [1.0, 1e200], [-0.0, 1e-200], [3.0], [4.0], [-5.0], [float("inf"), 1.0]] + base.tolist() + (base + 1e-3).tolist() + base[:3].tolist()
    frame = spark.createDataFrame([(i % 20 if i < 26 else None, v, 1, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, node long, h string")
    got = near_embeddings.near_links(frame).collect()
    ids = [i % 20 if i < 26 else None for i in range(len(rows))]
    unit = [None if not all(map(np.isfinite, v)) else np.array(v) / max(np.abs(v)) / np.linalg.norm(np.array(v) / max(np.abs(v))) for v in rows]
    want = [sum(1 for j, w in enumerate(unit) if j != i and w is not None and u is not None and len(u) == len(w) and u @ w >= 0.9) for i, u in enumerate(unit)]
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == sorted(zip(map(str, ids), want))
    clash = spark.createDataFrame([(None, None), (1, [1]), (1, [1])], "vec_id long, embedding array<int>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in near_embeddings.near_links(clash).collect()) == [("1", 1, 1), ("1", 1, 1), ("None", 0, None)]


def test_embedding_recall_just_above_the_threshold(spark):
    rng = np.random.default_rng(12)
    a, b = near_embeddings.pairs_at(1.0, 32, 3000, rng)[0], rng.standard_normal((3000, 32))
    b -= (a * b).sum(axis=1)[:, None] * a
    cos = rng.uniform(0.9005, 0.92, 3000)[:, None]
    b = cos * a + np.sqrt(1 - cos**2) * b / np.linalg.norm(b, axis=1)[:, None]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(np.concatenate([a, b]).tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in near_embeddings.near_links(frame).collect()}
    assert np.mean([got[i] == got[i + 3000] for i in range(3000)]) >= 0.998


def test_windows_are_ranges_of_the_sorted_projections():
    h = np.random.default_rng(3).standard_normal((70, 6))
    of = near_embeddings.windows(h, 0.8)
    got = np.concatenate([near_embeddings.collisions(of, 0, 40), near_embeddings.collisions(of, 40, 70)])
    assert (got == (np.abs(h[:, None] - h[None]) <= 0.8).sum(axis=2)).all()


def test_hot_keys_join_like_others(spark, monkeypatch):
    from tessera.llm import common

    left = spark.range(60).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert sorted(map(tuple, common.join_hot(left, right, "k", "n").collect())) == want
    some = right.where("k <> 4")
    assert sorted(map(str, common.join_hot(left, some, "k", "n", "left").collect())) == sorted(map(str, left.join(some.drop("n"), "k", "left").collect()))


def test_embedding_hot_cells_are_chunked(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [[float(np.float32(x)) for x in np.ones(8) + rng.standard_normal(8) * 0.02] for _ in range(120)]
    monkeypatch.setattr(near_embeddings.split_cells, "__defaults__", (40,))
    got = near_embeddings.near_links(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {119} and {r["component_id"] for r in got} == {0}


def test_collision_count_keeps_recall():
    assert 0 < near_embeddings.least_count(32) <= 32 and near_embeddings.tables_for(10**9)[1] > near_embeddings.tables_for(10**4)[1]


@pytest.mark.parametrize(("n", "dim"), [(500, 64), (51_000, 64), (3_000_000, 64), (10_000_000, 64), (1_000_000, 3), (500, 1)])
def test_drawn_lines_keep_recall_at_every_size(n, dim):
    lines = near_embeddings.Lines(dim, n, 0.9, 0.999)
    rng = np.random.default_rng(77)
    a = rng.standard_normal((20_000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((20_000, dim))
    if dim > 1:
        b -= (a * b).sum(axis=1)[:, None] * a
        b *= (1 - 0.9001**2) ** 0.5 / np.linalg.norm(b, axis=1)[:, None]
    b = 0.9001 * a + b if dim > 1 else a
    meet = np.zeros(len(a), bool)
    for i in range(0, len(a), 2000):
        meet[i : i + 2000] = (lines.cells(a[i : i + 2000]) == lines.cells(b[i : i + 2000])).any(axis=1)
    counted = (np.abs(a @ lines.counts - b @ lines.counts) <= lines.width).sum(axis=1) >= lines.least
    assert (meet & counted).mean() >= 0.999


# --- chat ------------------------------------------------------------------------------------------------------------
HARD = ["", "plain", "<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|x|> <|nl|>", "a <| b", "tail <", "|tail", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>", "line\nline", "\\"]


def test_chat_round_trip_is_exact(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(HARD)] + [(2, None, None, None), (3, 1, "odd\nrole<|", "x"), (3, 1, "odd\nrole<|", "x"), (None, 0, "user", "no conversation")]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.format_conversations(source).withColumn("back", chat_format.parse(F.col("formatted"))).collect()}
    assert set(got) == {1, 2, 3, None} and all(r["back"] == r["turns"] and r["identical"] for r in got.values())
    assert [t["text"] for t in got[1]["back"]] == HARD
    assert "a <| b" in got[1]["formatted"] and "plain<|im_end|>\n" in got[1]["formatted"]
    texts = [got[1]["formatted"][s["start"] - 1 : s["start"] - 1 + s["size"]] for s in got[1]["loss"]]
    assert len(texts) == 6 and texts[0] == "plain"
    want = hashlib.sha256("".join(t for i, t in enumerate(HARD) if i % 2).encode()).hexdigest()
    assert {r["conv_id"]: r for r in chat_format.digest(chat_format.format_conversations(source)).collect()}[1]["loss_sha256"] == want
    assert chat_format.digest(chat_format.format_conversations(source.limit(0))).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", HARD[i % len(HARD)] + str(i)) for i in range(3000)] + [(1, 3000, "user", "long " * 200_000)]
    got = chat_format.digest(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert got["n_turns"] == 3001 and got["turns_sha256"] == want and got["loss_chars"] == sum(len(t) for _, _, r, t in rows if r == "assistant")


# --- decontamination ---------------------------------------------------------------------------------------------------
def test_decontamination_against_windows(spark):
    import re

    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab, n))) for i, n in enumerate([14, 10, 9, 3, 1, 25, 11])] + [(20, None), (21, "--")] + [(22, "É-tude über X9")]
    texts = [" ".join(rng.choice(vocab, 200)) for _ in range(20)] + [items[0][1].upper() + "!", f"aa {items[5][1]} bb", "étude", "é TUDE. über x9", None, ""]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(str(i), tuple(w[k : k + 10]) if len(w) >= 10 else tuple(w)) for i, t in items for w in [tokens(t)] if w for k in range(max(1, len(w) - 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.mark(docs, bench).collect()}
    for d, t in enumerate(texts):
        w = tokens(t)
        hit, names = set(), set()
        for name, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        spans = got[d]["hits"]
        assert got[d]["n_words"] == len(w) and {x for a, b in zip(spans[::2], spans[1::2]) for x in range(a, b)} == hit and set(got[d]["items"]) == names
    left = decontaminate.clean(docs, bench)
    assert decontaminate.mark(left, bench).where(F.size("hits") > 0).count() == 0 and left.where("doc_id = 24 AND text IS NULL").count() == 1
    assert decontaminate.mark(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_decontamination_in_several_passes(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(6)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after and much more text here that nobody asks for in any test at all today")).alias("text"))
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", 20)
    got = decontaminate.mark(docs, items).collect()
    assert len(got) == 6 and all(r["hits"] == [1, 13] and r["items"] == [str(r["doc_id"])] for r in got)
    assert [r["text"].split() for r in decontaminate.clean(docs, items).where("doc_id = 0").collect()][0][:2] == ["before", "after"]


def test_long_items_and_texts_go_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    item = " ".join(f"v{x}" for x in rng.integers(0, 50, 400))
    words_ = item.split()
    docs = spark.createDataFrame([(1, "a b " + " ".join(words_[90:130]) + " c"), (None, item * 2000), (1, " ".join(words_[385:])), (2, " ".join(words_[395:]))], "doc_id long, text string").withColumn("hits", F.lit("clash")).withColumn("items", F.lit(1))
    items = spark.createDataFrame([(7, item), (7, item), (None, "only few words")], "item_id long, text string")
    want = sorted(map(str, decontaminate.mark(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", 30)
    assert len(list(decontaminate.automata(items, 10))) > 5
    assert sorted(map(str, decontaminate.mark(docs, items).collect())) == want and "items=['7']" in "".join(want)


def test_cleaning_does_not_depend_on_the_passes(spark, monkeypatch):
    one, two = ([f"t{i}x{j}" for j in range(12)] for i in range(2))
    rest = [f"own{i}" for i in range(30)]
    texts = [one + two + rest[:6], one[:6] + two + one[6:] + rest, one[:5] + two[:6] + one + two[6:] + one[5:] + rest * 2, one + rest, rest, None, []]
    items = spark.createDataFrame([(0, " ".join(one)), (1, " ".join(two))], "item_id long, text string")
    rows = [(None if i == 3 else i, t if t is None else " ".join(t), 7, ["x"]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, hits array<string>")
    once = sorted(map(str, decontaminate.clean(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "WORDS_A_PASS", 12)
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == once
    got = {r["doc_id"]: r for r in left.collect()}
    assert set(got) == {1, 2, None, 4, 5, 6} and got[1]["text"].split() == rest and got[2]["text"].split() == rest * 2
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[4]["n_chars"] == 7 and got[5]["text"] is None
    assert decontaminate.mark(left, items).where(F.size("hits") > 0).count() == 0


# --- mixing ------------------------------------------------------------------------------------------------------------
def fill(sizes, weights, cap=3):
    total, free, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > cap * sizes[i]}
        for i in range(len(sizes)):
            target[i] = rest * weights[i] / w if i in free else cap * sizes[i]
        if not over:
            return target
        free -= over


def test_mixing_meets_capped_targets(spark):
    rng = np.random.default_rng(9)
    names = [None, "b", "a", "é", "z"]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), names[int(rng.choice(5, p=[0.1, 0.5, 0.02, 0.2, 0.18]))]) for i in range(800)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    assert len(got) == 800 and got.copies.between(0, 3).all()
    src = {i: s for i, _, s in rows}
    got["s"] = [str(src[i]) for i in got.doc_id]
    order = sorted([s for s in names if s is not None]) + [None]
    sizes = [int(got[got.s == str(s)]["size"].sum()) for s in order]
    want = fill(sizes, [5, 2, 1, 5, 2])
    for s, n, t in zip(order, sizes, want):
        mine = got[got.s == str(s)]
        assert mine.target.iloc[0] == pytest.approx(t) and mine.source_size.iloc[0] == n and (mine.copies * mine["size"]).sum() == pytest.approx(t, rel=0.03, abs=60)


def test_rates_solve_the_entropy_dual(spark):
    """lambda is the root of sum(n * size * min(3, exp(lambda * size / mean))) = target, found here by bisection alone."""
    rng = np.random.default_rng(10)
    bins = [(s, int(size), int(n)) for s in range(3) for size, n in zip(rng.choice(np.arange(1, 400), 60, False), rng.integers(1, 30, 60))]
    share = [0.4, 1.7, 2.9]
    mass = [sum(size * n for b, size, n in bins if b == s) for s in range(3)]
    targets = spark.createDataFrame([(s, mass[s], sum(n for b, _, n in bins if b == s), share[s] * mass[s]) for s in range(3)], "src int, source_size long, docs long, target double")
    got = {r["src"]: r["lam"] for r in mixing.balance(spark.createDataFrame(bins, "src int, size long, n long"), targets).collect()}
    for s in range(3):
        size, n = (np.array([b[k] for b in bins if b[0] == s], float) for k in (1, 2))
        mean = mass[s] / n.sum()
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (n * size * np.minimum(3, np.exp(mid * size / mean))).sum() < share[s] * mass[s] else (low, mid)
        assert got[s] == pytest.approx(low, abs=1e-6)


def test_mixing_ties_and_long_texts(spark):
    rows = [(i % 5 if i % 7 else None, "same words in all", "a" if i % 4 else "b") for i in range(4000)] + [(9, "w " * 300_000, "b")]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))).toPandas()
    assert len(got) == 4001 and got[got["size"] == 300_000].copies.iloc[0] <= 3
    for target, mine in got.groupby("target"):
        assert (mine.copies * mine["size"]).sum() == pytest.approx(target, rel=0.02, abs=300_000)


def test_mixing_odd_rows(odd, none):
    got = mixing.copies(odd).collect()
    assert len(got) == len(ODD) and all(r["copies"] == 0 for r in got if r["size"] == 0)
    assert mixing.copies(none).count() == 0
    assert sorted(map(str, mixing.copies(odd).collect())) == sorted(map(str, got))


# --- SimHash -----------------------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_by_definition(spark):
    for t in ["a", "A b", "one two three", "É  x\ty\nz a b c", "", None, " \n", "same same same same", "a b c"]:
        assert simhash_dedup.fingerprint(t) == slow_fingerprint(t)
    want = spark.sql("SELECT xxhash64('one two three') AS h").first()["h"] % (1 << 64)
    assert simhash_dedup.fingerprint("ONE two three") == want


@pytest.mark.parametrize("hot", [8192, 60])
def test_simhash_components_against_all_pairs(spark, monkeypatch, hot):
    rng = np.random.default_rng(hot)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    fps += [f ^ int(sum(1 << int(b) for b in rng.choice(64, int(n), replace=False))) for f, n in zip(fps[:60], rng.integers(1, 7, 60))]
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (200, 2))] + fps[:5]
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash_dedup, "HOT_KEY", hot)
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r["fp"]: r["component"] for r in simhash_dedup.cluster(frame).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            low = min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3)
            changed |= low < label[i]
            label[i] = min(low, label[i])
    assert [got[f] for _, f in rows] == label


def test_thresholds_are_the_cheapest():
    assert simhash_dedup.thresholds([[0, 5, 9], [0, 1, 2], [0, 7, 70]], 0)[1] == [-1, 1, 0] or simhash_dedup.thresholds([[0, 5, 9], [0, 1, 2], [0, 7, 70]], 0)[0] == min(
        sum(row[t + 1] for row, t in zip([[0, 5, 9], [0, 1, 2], [0, 7, 70]], ts)) for ts in __import__("itertools").product((-1, 0, 1), repeat=3) if sum(ts) == 0
    )


def test_simhash_odd_rows(odd, none, tmp_path):
    got = simhash_dedup.op5(odd.sparkSession, folder(odd, tmp_path)).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert simhash_dedup.one_of_each(none).count() == 0
    assert simhash_dedup.one_of_each(odd.where("doc_id in (4, 6)")).count() == 1
    clash = odd.selectExpr("*", *[f"concat('v', coalesce(doc_id, 0)) AS {c}" for c in ("_a", "_b", "fp", "node", "_3_", "key", "n")])
    kept = simhash_dedup.one_of_each(clash)
    assert kept.columns == clash.columns and all({r[c] for c in ("_a", "_b", "fp", "node", "_3_", "key", "n")} == {f"v{r['doc_id'] or 0}"} for r in kept.collect())


# --- language, toxicity ------------------------------------------------------------------------------------------------
def test_language_spans_and_odd_rows(spark, odd, none):
    model = language_id.fit(odd)
    mixed = spark.createDataFrame([(1, EN * 3 + DE * 3)], "doc_id long, text string")
    spans = language_id.identify(mixed, model, True).first()["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]
    got = {r["doc_id"]: r for r in language_id.identify(odd.where("doc_id < 8").drop("lang").withColumn("score", F.lit("clash")), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(none)).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_letters_are_the_unicode_letters(spark, odd):
    """Text without a code point of the categories L* is `und`, whatever its script; any other text is not."""
    import unicodedata

    texts = ["٢٠٢٤", "१२३ ।", "،؟", "฿", "ℵ", "々", "ª", "e\u0301", "\u0301\u0301", "١ا", "𝔸", "😀 12", "ॐ", "—\u064b—", "ﬁ", "Ⅷ", "ʰ", "漢字", "ㇰ", "\U0001F130"]
    model = language_id.fit(odd)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [not any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]


def test_language_by_a_plain_version(spark, odd):
    """Scores word by word and n-gram by n-gram, and the best path by recursion, on whole documents."""
    import unicodedata

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 1500").limit(25)
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text"), model).collect()}
    bucket = lambda g: int(language_id.gram_codes(np.frombuffer(g + b"   ", np.uint8).astype(np.uint32), 1, len(g))[0])
    for r in docs.collect():
        words_, cur = [], ""
        for ch in (r["text"] or "").lower() + " ":
            if unicodedata.category(ch)[0] in "LM":
                cur += ch
            elif cur:
                words_, cur = [*words_, cur], ""
        if not words_:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        path = None
        for w in words_:
            raw = b" " + w.encode() + b" "
            s = sum((model.tables[o][bucket(raw[i : i + k])].astype(float) for o, k in enumerate(language_id.ORDERS) for i in range(len(raw) - k + 1)), np.zeros(len(model.langs)))
            s = s + model.unfit[max(language_id.byte_scripts(np.frombuffer(w.encode(), np.uint8)))]
            if path is None:
                path = [(s[k], [k]) for k in range(len(s))]
            else:
                top = max(range(len(s)), key=lambda k: path[k][0])
                path = [max((path[k][0], path[k][1]), (path[top][0] - language_id.PENALTY, path[top][1]), key=lambda x: x[0]) for k in range(len(s))]
                path = [(v + s[k], [*p, k]) for k, (v, p) in enumerate(path)]
        best = max(path, key=lambda x: x[0])[1]
        votes = np.bincount(best, minlength=len(model.langs))
        assert got[r["doc_id"]]["score"] == pytest.approx(votes.max() / votes.sum(), abs=1e-9) and got[r["doc_id"]]["lang_pred"] == model.langs[votes.argmax()]


def test_viterbi_equals_exhaustive_search():
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], np.ones((3, len(language_id.ORDERS), language_id.BUCKETS)), np.ones((3, len(language_id.SCRIPTS))))
    sizes = [7, 1, 0, 5, 7]
    rows = np.r_[0, np.cumsum(sizes)]
    scores = rng.standard_normal((rows[-1], 3)) * 25
    got = model.label(scores, rows)
    value = lambda s, path: sum(s[i, p] for i, p in enumerate(path)) - language_id.PENALTY * sum(x != y for x, y in zip(path, path[1:]))
    for r in range(len(sizes)):
        s = scores[rows[r] : rows[r + 1]]
        best = max((value(s, p) for p in __import__("itertools").product(range(3), repeat=len(s))), default=0)
        assert value(s, list(got[rows[r] : rows[r + 1]])) == pytest.approx(best)


def test_scripts_narrow_candidates(spark):
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([(EN * 5, "en"), ("это простой русский текст для проверки " * 5, "ru")] * 3)]
    model = language_id.fit(spark.createDataFrame(rows, DOCS))
    assert language_id.identify(spark.createDataFrame([(1, "Жжщ цыпщ")], "doc_id long, text string"), model).first()["lang_pred"] == "ru"


def test_held_out_language_accuracy(spark):
    got = language_id.op6(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.95


def test_toxicity_learns_and_takes_odd_rows(spark, odd, none):
    rng = np.random.default_rng(3)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(i, " ".join([*rng.choice(filler, 30), *(["vilebad"] if i % 3 == 0 else []), *rng.choice(filler, 30)]), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels.where("doc_id < 200"))).where("doc_id >= 200").collect()
    assert np.mean([(r["doc_id"] % 3 == 0) == bool(r["predicted"]) for r in got]) > 0.97
    untaught = toxicity.fit(none, labels.limit(0))
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, untaught).collect()) and toxicity.score(none, untaught).count() == 0


def small_classifier(seed=1):
    rng = np.random.default_rng(seed)
    model = toxicity.Classifier(seed)
    for k in ("word", "head", "filters", "shift", "out"):
        value = getattr(model, k)
        setattr(model, k, (rng.standard_normal(value.shape) * 0.5).astype(np.float64))
    return model


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    model, rows = small_classifier(), np.array([0, 4, 5, 11])
    word, head, label = rng.integers(0, 30, 11), rng.integers(0, 9, 11), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.probability(word, head, rows)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) + 0.5e-4 * ((model.filters**2).sum() + (model.out**2).sum())

    grad, _ = model.gradients(word, head, rows, label)
    for name in ("word", "head", "filters", "shift", "out"):
        value = getattr(model, name)
        live = np.argwhere(np.abs(grad[name]) > 1e-7)
        for at in map(tuple, live[rng.permutation(len(live))[:12]]):
            kept, step = value[at], 1e-6
            value[at] = kept + step
            up = loss()
            value[at] = kept - step
            down = loss()
            value[at] = kept
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), rel=2e-3, abs=2e-6)


def test_scores_by_a_plain_forward_pass(spark):
    model = small_classifier(5)
    texts = ["one two three four", "A", "", "... 12", "é für über zwei two", "x " * 50]
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        word, head, rows = toxicity.tokens(data, np.array([0, len(data)]))
        x, column, top = model.word[word] + model.head[head], 0, []
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                top.append(max(sum(x[i + j] @ model.filters[column + j, :, f] for j in range(w) if i + j < len(x)) for i in range(len(x))))
            column += w
        want = 1 / (1 + np.exp(-(np.maximum(np.array(top) + model.shift, 0) @ model.out + model.bias)))
        assert model.probability(word, head, rows)[0] == pytest.approx(want, rel=1e-9)


def test_toxicity_query_on_odd_rows(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(i, 1, (i or 0) % 2) for i in (None, 1, 2, 4, 4, 5, 7, 8, 99)] + [(6, 0, None), (5, 0, 7)], "doc_id long, quality int, toxic int")
    long = spark.createDataFrame([(20, EN * 20_000, None, None, 1)], DOCS)
    sf = folder(odd.unionByName(long).withColumn("score", F.lit("clash")), tmp_path, labels=labels)
    got = toxicity.op8(spark, sf).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert sorted(map(str, toxicity.op8(spark, sf).collect())) == sorted(map(str, got))


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "word " * 200, "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 100_000)
    seen = []
    monkeypatch.setattr(toxicity.Classifier, "fit", lambda self, word, *a: seen.append(len(word)))
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert 0 < seen[0] < 400 * 200 / 2


def test_toxicity_learns_from_every_labelled_row_in_shards(spark, none, monkeypatch):
    rng = np.random.default_rng(4)
    filler = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    rows = [(i, " ".join([*rng.choice(filler, 20), *(["vilebad"] if i % 3 == 0 else []), *rng.choice(filler, 20)]), "en" if i % 2 else "de", "s", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 400")
    for name, most in {"SAMPLE_PER_LABEL": 5, "SAMPLE_BYTES": 1000, "SHARD_ROWS": 100, "FEW_LABELS": 10}.items():
        monkeypatch.setattr(toxicity, name, most)
    shards = toxicity._shards(docs, labels, "doc_id").collect()
    assert len(shards) == 4 and sum(len(r["toxic"]) for r in shards) == 400 and sum(r["toxic"].count(1) for r in shards) == 134
    assert sum(len(r["words"]) // 2 for r in shards) == 400 * 40 + 134 and 60 < sum(r["held"].count(1) for r in shards) < 140
    seen, summed = [], toxicity._summed
    monkeypatch.setattr(toxicity, "_summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    model = toxicity.fit_whole(docs, labels)
    trained = sum(r["held"].count(0) for r in shards)
    assert seen[0]["n"][:2].sum() == trained and seen[-1]["levels"].reshape(-1)[: 2 * 2 * 92].reshape(2, 2, 92)[:, :, -1].sum() == 400 - trained
    assert seen[0]["=en"].sum() + seen[0]["=de"].sum() == 400 * 40 + 134
    got = toxicity.score(docs.select("doc_id", "text"), model).where("doc_id >= 400").collect()
    assert np.mean([(r["doc_id"] % 3 == 0) == bool(r["predicted"]) for r in got]) > 0.97
    again = toxicity.fit_whole(docs, labels)
    assert all((again.numbers()[k] == v).all() for k, v in model.numbers().items()) and (again.cuts == model.cuts).all()
    assert toxicity.score(none, toxicity.fit_whole(none, labels)).count() == 0


# --- suffixes ----------------------------------------------------------------------------------------------------------
def slow_cut(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        out.append((len(b), int(gone.sum()), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def test_suffix_dedup_against_all_windows(spark):
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdé "), n))
    common, other = say(260), say(130)
    texts = [say(300) + common + say(40), common[:150], say(99), None, "", common + common, say(50) + other[:110] + say(20) + other[10:], "z" * 450, "ab" * 300, say(30) + common[60:] + other + say(10), common[:99], "z" * 120, other[:100], "é" * 60]
    texts += [common[:120] + say(5) + common[120:] for _ in range(30)] + texts[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.cut_repeats(docs).orderBy("doc_id").collect()]
    assert got == slow_cut(texts)
    assert suffix_dedup.cut_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_cuts_hot_contexts_into_few_rows():
    rng = np.random.default_rng(5)
    gram = rng.integers(97, 123, 24).astype(np.uint8).tobytes()
    far = suffix_dedup.LENGTH - suffix_dedup.GRAM
    ctx = [rng.integers(97, 123, far).astype(np.uint8).tobytes() + gram + rng.integers(97, 123, far).astype(np.uint8).tobytes() for _ in range(50)]
    ctx[9] = ctx[9][:50] + ctx[3][50:150] + ctx[9][150:]
    n = np.full(50, suffix_dedup.GRAMS)
    meta = suffix_dedup.pack(np.zeros(50, np.int64), n, np.full(50, far), suffix_dedup.HOT)
    cols = {"key": np.arange(50), "part": np.zeros(50, np.int32), "c": np.arange(50), "doc": np.arange(50), "ord": np.zeros(50, np.int64), "meta": meta, "ctx": np.array(ctx, object)}
    got = suffix_dedup._meet(cols | {"starts": np.arange(50), "sizes": np.ones(50, np.int64)}, True)
    again = np.flatnonzero(got["kind"] == 1)
    assert len(again) <= 50 * (suffix_dedup.GRAMS // 8 + 2)
    # each window lies in one row, and rows that hold equal windows share a key
    start, size, offset = suffix_dedup.unpack(got["meta"][again])
    assert np.bincount(got["doc"][again], size).tolist() == n.tolist()
    assert (start + offset == far).all()
    held = {}
    for k, d, s, m, raw in zip(got["key"][again], got["doc"][again], start, size, got["ctx"].take(pa.array(again)).to_pylist()):
        for i in range(m):
            assert raw[i : i + suffix_dedup.LENGTH] == ctx[d][s + i : s + i + suffix_dedup.LENGTH]
            held.setdefault((s + i, raw[i : i + suffix_dedup.LENGTH]), set()).add(k)
    assert all(len(keys) == 1 for keys in held.values()) and len(held) < n.sum()


@pytest.mark.parametrize(("counters", "hot"), [(1 << 20, 1024), (16, 3), (16, 40)])
def test_suffix_dedup_of_hot_grams_repeated_keys_and_long_texts(spark, monkeypatch, counters, hot):
    rng = np.random.default_rng(16)
    say = lambda n: "".join(rng.choice(list("abcdé "), n))
    line, long = say(150), say(1_100_000)
    texts = [say(80) + line + say(80) for _ in range(60)] + [line * 2, long[:1_050_000], "z" * 130, long[1_048_000:1_049_500]] + [say(300)] * 25
    monkeypatch.setattr(suffix_dedup, "COUNTERS", counters)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    docs = spark.createDataFrame([(None if i == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    cut = lambda d: [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.cut_repeats(d).orderBy("doc_id").collect()]
    assert cut(docs) == slow_cut(texts)
    # rows that repeat a key: one of equal ones stays, and texts of different lengths under one key stand side by side
    one, other = say(300), say(500)
    rows = [(8, one), (8, one), (8, other), (None, one[:200]), (None, None), (9, other[:450]), (None, one[:200])]
    got = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = lambda t: len((t or "").encode())
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(i), size(t)) for i, t in rows)
    left = {i: sorted(len(r["kept"]) for r in got if r["doc_id"] == i) for i in (None, 8, 9)}
    assert left[None] == [0, 0, size(one[:200])] and left[9] == [0] and left[8] == sorted([0, size(one) - size(one[:200]), size(other)])


def test_ranges_are_joined():
    got = suffix_dedup.merged(*(np.array(x) for x in ([2, 1, 1, 1, 1], [0, 0, 0, 0, 1], [0, 50, 0, 10, 0], [5, 60, 30, 12, 9])))
    assert [x.tolist() for x in got] == [[1, 1, 1, 2], [0, 0, 1, 0], [0, 50, 0, 0], [30, 60, 9, 5]]


def test_suffix_order_is_the_bytes_order():
    rng = np.random.default_rng(8)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    pos, bucket = rng.integers(0, 3900, 700), rng.integers(0, 5, 700)
    from tessera.llm.bytesops import prefix_hashes

    order = suffix_dedup.suffix_order(data, prefix_hashes(data), pos, bucket, 100)
    keys = [(bucket[i], data[pos[i] : pos[i] + 100].tobytes()) for i in order]
    assert keys == sorted(keys)


# --- html --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b&nbsp; c<br>d</p>", "a & b c d"), ("<script>x</script><style>p{}</style><!-- c -->", ""),
        ("<nav>menu</nav><header>site</header><article><h1>Title</h1><p>One.<p>Two <b>bold</b>.</article><aside>side</aside><footer>foot</footer>", "Title\nOne.\nTwo bold."),
        ("<div class='ad'>buy</div><main><p>text &lt;b&gt;</p><form>name <input></form><div id=comments><p>first!</p></div></main>", "text <b>"),
        ("<div class='cookie-notice'>We use</div><div><p>" + "long text " * 30 + "</p><p>end</p></div><ul><li><a href=x>a</a><li><a href=y>b</a></ul>", ("long text " * 30).strip() + "\nend"),
        ("<article><p>un<i>closed <a href='>'>link</a></p>tail", "unclosed link\ntail"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


BODY = "real text of the page " * 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class=content><p>{BODY}</p></div><div><article class=card><p>Teaser.</p></article><article class=comment><p>First!</p></article></div>", [BODY.strip(), "Teaser."]),
        ("<main><p>Start.</p></main><div><p>Text after a main closed early.</p></div>", ["Start.", "Text after a main closed early."]),
        ("<article class='category-legal comments-open'><p>Themes put topics here.</p></article>", ["Themes put topics here."]),
        (f"<p>{BODY * 5}</p><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>A short end.</p>", [(BODY * 5).strip(), "A short end."]),
        (f"<p>Short.</p><div class=share>x</div><div class=ad>y</div><div class=ad>z</div><p>{BODY * 5}</p>", ["Short.", (BODY * 5).strip()]),
    ],
)
def test_text_outside_articles_and_below_the_peak_stays(page, want):
    assert html_extract.main_text(page).split("\n") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>Mehr: <a>&Uuml;ber &ouml;ffentliche G&uuml;ter</a></p></article>", ["Mehr: Über öffentliche Güter"]),
        ("<p>Mehr: <a>&Uuml;ber &ouml;ffentliche G&uuml;ter</a></p>", ["Mehr: Über öffentliche Güter"]),
        ("<p>See <a>\n" + " " * 30 + "full report</a></p>", ["See full report"]),
        ("<article><h2><a>Title</a></h2><p>One.</p><ol><li><a>r1</a><li><a>r2</a><li><a>r3</a><li><a>r4</a></ol></article>", ["Title", "One.", "r1", "r2", "r3", "r4"]),
        ("<ul><li><a>menu</a></ul><p>One.</p><h2><a>Title</a></h2><div class=ad>buy</div><p>Two.</p><ul><li><a>menu</a></ul>", ["One.", "Title", "Two."]),
        ("<ul><li><a>a</a> | <li><a>&nbsp;b</a></ul>", ["a |"]),
    ],
)
def test_links_inside_text_stay(page, want):
    assert html_extract.main_text(page).split("\n") == want


def plain_stretches(weight, width=3):
    """A line is in a stretch if text stands before or on it and after or on it, and no `width` lines between are without."""
    live = [i for i, w in enumerate(weight) if w]
    return [any(a <= i for a in live) and any(b >= i for b in live) and (bool(weight[i]) or min(b for b in live if b > i) - max(a for a in live if a < i) <= width) for i in range(len(weight))]


def test_stretches_against_a_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(300):
        weight = rng.integers(0, 2, rng.integers(1, 25)) * rng.integers(1, 90)
        assert html_extract.stretches(weight).tolist() == plain_stretches(weight), weight


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # the distribution alone decides: nothing here is marked
        ("<div><a>Home</a></div><div><a>News</a></div><div><a>Shop</a></div><p>One.</p><div><a>next</a></div><p>Two.</p><div><a>a</a></div><div><a>b</a></div><div><a>c</a></div><div><a>d</a></div><p>Three.</p><div><a>Top</a></div>", ["One.", "next", "Two.", "Three."]),
        ("<div class=legal>Imprint</div><p>One long line.</p><div class=legal>By law</div><p>Two long lines.</p><div class=toolbar>Print</div>", ["One long line.", "By law", "Two long lines."]),
        ("<article><p title=it's>One.</p><header class='article-header'><h1>Title</h1></header><div class=legal>Law</div></article>", ["One.", "Title", "Law"]),
        ("<div class='post-header'><h1>Title</h1></div><p>One.</p>", ["Title", "One."]),
        ("<div class=legal><p>All of it</p><p>is law</p></div><p>x</p>", ["All of it", "is law", "x"]),
        ("<p data-x='a>b' title = \"q'\">One</p><p title=a\"b>Two</p>", ["One", "Two"]),
    ],
)
def test_the_distribution_decides(page, want):
    assert html_extract.main_text(page).split("\n") == want


def test_very_long_page(spark):
    page = "<nav>menu</nav>" + "<p>line &amp; text</p>" * 60_000 + "<footer>foot</footer>"
    got = html_extract.extract(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert [r["n_chars"] for r in got] == [60_000 * 12 - 1] * 2


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", "extra"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_extract.extract(pages).collect()) == [("1", "x", 1), ("None", "", 0)]


# --- sharding ----------------------------------------------------------------------------------------------------------
def test_shards_are_exact_and_repeatable(spark, odd, none):
    rows = spark.range(10_007).withColumn("shard", F.lit("clash"))
    got = sharding.shard(rows, ["id"], 8, block_rows=500).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 10_007 and got.id.nunique() == 10_007 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    again = sharding.shard(rows.repartition(7), ["id"], 8, block_rows=500).toPandas()
    assert got.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))
    assert abs(np.corrcoef(got.id, got.shard)[0, 1]) < 0.05
    clash = sharding.shard(rows.limit(50).selectExpr("id", *[f"id AS {c}" for c in ("ends", "_p", "_b", "_r1", "_r2", "slot", "block", "_cell")]), ["id"], 3)
    assert clash.columns == ["id", "ends", "_p", "_b", "_r1", "_r2", "block", "_cell", "shard", "slot"] and all(len({*r[:8]}) == 1 for r in clash.collect())
    assert sorted(sharding.shard(odd, ["doc_id"], 3).toPandas().groupby("shard").size()) == [3, 3, 4] and sharding.shard(none, ["doc_id"]).count() == 0


def test_hypergeometric_law(spark):
    u = (F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))).alias("u")
    k = spark.range(20_000).select(u).select(sharding.hypergeometric(*[F.lit(x).cast("long") for x in (50, 20, 10)], F.col("u")).alias("k")).toPandas().k
    from math import comb

    want = [comb(20, i) * comb(30, 10 - i) / comb(50, 10) for i in range(11)]
    assert np.abs(np.bincount(k, minlength=11) / 20_000 - want).max() < 0.015
    edge = spark.range(1).select(*[sharding.hypergeometric(*[F.lit(x).cast("long") for x in t], F.lit(0.5)).alias(n) for n, t in {"a": (0, 0, 0), "b": (5, 5, 3), "c": (5, 0, 3), "d": (7, 4, 7)}.items()]).first()
    assert tuple(edge) == (0, 3, 0, 4)


# --- pipeline, oracles ---------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string")
    extra = spark.createDataFrame([(50 + i, (EN if i % 2 else DE) * 15 + f" unique words {i} {i * 7} " + ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda" if i == 4 else ""), "en" if i % 2 else "de", "abc"[i % 3], 1) for i in range(12)], DOCS)
    sf = folder(odd.unionByName(extra), tmp_path, benchmark=bench)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        stage(spark, none, sf).write.parquet(f"{tmp_path}/none{k}")
        assert spark.read.parquet(f"{tmp_path}/none{k}").count() == 0
    assert docs.where("text LIKE '%theta iota kappa%'").count() == 0 and docs.count() > 0


def test_pipeline_rows_without_a_key_of_their_own(spark, none):
    import corpus_pipeline

    say = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, say(0), "en", "a", 1), (None, say(1), "en", "a", 1), (None, say(1), "en", "a", 1), (8, say(2), "en", "a", 1), (8, say(2), "en", "a", 1), (8, say(3), "en", "b", 1), (9, say(3), "en", "a", 1), (None, say(3), "en", None, 1), (8, say(3), "de", "b", 1), (10, say(4), None, "a", 1), (10, say(4), "a", None, 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("None", say(0)), ("None", say(1)), ("8", say(2)), ("8", say(3)), ("10", say(4))])
    # one source: the target is its size, so each row is taken once
    same = spark.createDataFrame([(None, say(0), "en", "a", 1), (None, say(1), "en", "a", 1), (8, say(2), "en", "a", 1), (8, say(2), "en", "a", 1), (8, say(3), "en", "a", 1)], DOCS)
    assert sorted(map(str, corpus_pipeline.mix_sources(spark, same, "").collect())) == sorted(map(str, same.collect()))
    # two sources of 30 equally long rows share 60 rows as 5 to 2
    two = spark.createDataFrame([(8 if i % 3 else None, say(i % 20), "en", "a" if i < 30 else "b", 1) for i in range(60)], DOCS)
    mixed = corpus_pipeline.mix_sources(spark, two, "").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mixed} == {"a": 43, "b": 17}
    assert corpus_pipeline.mix_sources(spark, none, "").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))
