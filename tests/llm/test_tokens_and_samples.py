"""Resampling, alignment of tokenizers and personal data against plain Python, on odd rows and whole tables."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import align_tokens, html_extract, personal_data, queries, resample, sharding, simhash_dedup, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "The quick fox, and 2 lazy DOGS were running over the hill with them. "
ODD = [
    (None, "no id at all here", "en", None, 17), (1, None, None, "a", 0), (2, "", "en", "b", 0), (3, "... !?", "en", "a", 7), (4, EN * 12, "en", "a", 1), (5, "Über größere Fähigkeiten " * 40, "de", "b", 1),
    (6, EN * 12, "en", None, 1), (7, EN * 3000, "en", "a", 1), (8, "x" * 5000, "en", "c", 1), (8, "x" * 5000, "en", "c", 1), (9, "a" + " " * 3000 + "b", "en", "c", 1), (10, "space ▁ sign", "en", "c", 1),
    (11, "<|endoftext|> <s> tab\t\n日本語 é 😀\x00", "en", "c", 1), (12, "word " * 19 + "end", "en", "c", 1), (13, EN * 5, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def folder(tmp_path, **tables):
    for k, v in tables.items():
        v.write.parquet(f"{tmp_path}/{k}.parquet")
    return str(tmp_path)


# --- resampling -----------------------------------------------------------------------------------------------------------
def test_crc_algebra_joins_words_of_any_length():
    rng = random.Random(3)
    for size in (0, 1, 2, 7, 63, 64, 65, 1000, 70_001):
        a, b = rng.randbytes(rng.randint(0, 80)), rng.randbytes(size)
        got = resample.joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([size]))
        assert got[0] == zlib.crc32(a + b)
    words = [rng.randbytes(n) for n in (1, 5, 64, 65, 3, 200, 17)]
    ends = np.cumsum([len(w) for w in words])
    crc = resample.word_crcs(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends)
    assert crc.tolist() == [zlib.crc32(w) for w in words]


def plain_features(text, orders=2, buckets=10_000):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, orders=2, buckets=10_000):
    found = [plain_features(t, orders, buckets) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in plain_features(x, orders, buckets)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for (i, _), (n, f) in zip(docs, found):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    return rows, fit, 25 * len(fit) // 100


def test_resampling_of_odd_rows_and_whole_tables(spark, odd, none, tmp_path):
    bench = spark.createDataFrame([(1, EN), (2, None), (3, "fähigkeiten und mehr")], "item_id long, text string")
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(odd.where("doc_id = 4"))
    got = queries.QUERIES["op11_resample"](spark, folder(tmp_path, documents=many, benchmark=bench)).collect()
    rows, fit, draw = plain_resample([(r.doc_id, r.text) for r in many.collect()], [EN, None, "fähigkeiten und mehr"])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, *x) for i, _, *x in rows)
    assert sorted((r.rank, r.score, r.doc_id) for r in got if r.rank) == [(k + 1, r[4], r[0]) for k, r in enumerate(fit[:draw])]
    assert draw > 1 and sum(r.doc_id == 4 for r in got) == 2
    empty = queries.QUERIES["op11_resample"](spark, folder(tmp_path / "e", documents=none, benchmark=bench))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = duckdb.connect()
    for t in ("documents", "benchmark"):
        want.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert sorted(map(tuple, queries.QUERIES["op11_resample"](spark, DATA).collect())) == sorted(want.execute(queries.ORACLES["op11_resample"]).fetchall())


@pytest.mark.parametrize("orders", [1, 3])
def test_resample_keeps_whole_rows_whatever_their_names(spark, odd, orders, tmp_path):
    target = spark.createDataFrame([(EN,)], "text string")
    clash = odd.withColumns({"Score": F.lit("s"), "m": F.create_map(F.lit("a"), "doc_id"), "_h": F.lit(1)})
    resample.resample(clash, target, percent=50, orders=orders, buckets=64).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "m", "_h", "n_words", "n_features", "weight", "score"]
    _, fit, _ = plain_resample([(r[0], r[1]) for r in ODD], [EN], orders, 64)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in fit[: len(fit) // 2])
    assert resample.resample(odd.where("false"), target).count() == 0
    assert resample.resample(odd, target.where("false"), percent=100).count() == len(fit)


def test_one_of_two_equal_rows_may_be_the_last_drawn(spark):
    rows = spark.createDataFrame([(1, EN * 3)] * 5, "doc_id long, text string")
    assert resample.resample(rows, rows, percent=50).count() == 2
    assert resample.ranked_draw(resample.weighed(rows, resample.gains(rows, rows)).drop("text"), 60).where("rank IS NOT NULL").orderBy("rank").toPandas()["rank"].tolist() == [1, 2, 3]


# --- alignment ------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tools():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = align_tokens.FOLDER
    if not os.path.exists(f"{path}/{align_tokens.BYTE_BPE}"):
        pytest.skip("no vocabulary files here")
    a = Tokenizer.from_file(f"{path}/{align_tokens.BYTE_BPE}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{path}/{align_tokens.PIECE_BPE}")
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(c): c for c in visible} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in visible)}
    a_bytes = {i: bytes(names[c] for c in w) for w, i in a.get_vocab().items() if all(c in names for c in w)}
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    return a, b, a_bytes, b_bytes


def plain_alignment(tools, texts):
    a, b, a_bytes, b_bytes = tools
    out, counts = [], Counter()
    for t in texts:
        x, y = a.encode(f" {t}", add_special_tokens=False).ids if t else [], b.encode(t) if t else []
        want = f" {t}".encode()
        if not t or b"".join(a_bytes[i] for i in x) != want or b"".join(b_bytes[i] for i in y) != want:
            out.append(None)
            continue
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for ids, table in ((x, a_bytes), (y, b_bytes))]
        at, groups, links = [{e: k + 1 for k, e in enumerate(es)} for es in ends], [], []
        p = q = 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            groups.append(",".join(map(str, x[p : at[0][c]])) + "|" + ",".join(map(str, y[q : at[1][c]])))
            p, q = at[0][c], at[1][c]
            links.append((x[p - 1], y[q - 1]))
        counts.update(links)
        out.append((len(x), len(y), groups, links))
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(counts[k] == best[k[1]] for k in r[3]), sum(counts[k] for k in r[3]), digest(r[2])) for r in out]


def test_alignment_of_odd_rows_and_a_whole_table(spark, tools, odd, none, tmp_path):
    whole = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = odd.unionByName(whole.withColumn("doc_id", F.col("doc_id") + 1000))
    got = queries.QUERIES["op12_align_tokens"](spark, folder(tmp_path, documents=docs)).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_alignment(tools, [t for _, t in rows])
    assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert [w[0] for (i, _), w in zip(rows, want) if i in (1, 2, 10)] == [0, 0, 0]  # null, empty, and a text with the sign that stands for a space
    assert queries.QUERIES["op12_align_tokens"](spark, folder(tmp_path / "e", documents=none)).count() == 0


def test_pairs_that_cannot_travel_meet_by_shuffle(spark, tools, odd, monkeypatch):
    a, b = (align_tokens.encoder(f"{align_tokens.FOLDER}/{f}") for f in (align_tokens.BYTE_BPE, align_tokens.PIECE_BPE))
    rows = align_tokens.stored(align_tokens.aligned(align_tokens.tokenised(odd.where("doc_id <> 8"), a, b)).select("doc_id", "links"))
    first = sorted(map(tuple, align_tokens.scored(rows, "doc_id").collect()))
    monkeypatch.setattr(align_tokens, "PAIRS", 0)
    assert sorted(map(tuple, align_tokens.scored(rows, "doc_id").collect())) == first


def test_groups_of_a_batch_are_put_together_at_once(spark):
    rows = [(1, [5, 70, 8], [2, 3, 6], [9, 11], [3, 6]), (2, [], [], [], []), (3, [4], [7], [1, 2, 3], [1, 2, 7]), (4, [123456], [1], [0], [1])]
    tokens = spark.createDataFrame(rows, "doc_id long, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>")
    got = {r.doc_id: (r.groups, r.links) for r in align_tokens.aligned(tokens, ["doc_id"]).collect()}
    link = lambda a, b: a << 32 | b
    assert got == {1: (["5,70|9", "8|11"], [link(70, 9), link(8, 11)]), 2: ([], []), 3: (["4|1,2,3"], [link(4, 3)]), 4: (["123456|0"], [link(123456, 0)])}
    assert align_tokens.aligned(tokens).columns == [*tokens.columns, "groups", "links"]


def test_tokens_never_leave_the_worker_that_aligns_them(spark, tools, odd, monkeypatch):
    a, b = (align_tokens.encoder(f"{align_tokens.FOLDER}/{f}") for f in (align_tokens.BYTE_BPE, align_tokens.PIECE_BPE))
    want = align_tokens.aligned(align_tokens.tokenised(odd, a, b)).selectExpr("doc_id", "cast(size(a) as long)", "cast(size(b) as long)", "groups", "links")
    monkeypatch.setattr(align_tokens, "PIECE", 50)  # texts a few at a time
    got = align_tokens.aligned_texts(odd, a, b)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_both_libraries_give_the_same_byte_tokens(tools):
    e = align_tokens.encoder(f"{align_tokens.FOLDER}/{align_tokens.BYTE_BPE}")
    e.build()
    assert e.fast
    rng = random.Random(5)
    pool = "ab 1.,'s\n\t éß漢字😀́ＡΩ 　<|endoftext|>"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(500)] + [" " * 5000, "a" * 5000, "don't I'LL we've"]
    assert [x.tolist() for x in e.encode(texts)] == [tools[0].encode(f" {t}", add_special_tokens=False).ids for t in texts]


# --- personal data --------------------------------------------------------------------------------------------------------
MAIL, ADDRESS, CARD, DIAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_patterns(text):
    out = []
    for kind, rule in enumerate((MAIL, ADDRESS, CARD, DIAL), 1):
        for m in re.finditer(rule, text):
            d = [int(c) for c in m[0] if c in "0123456789"][::-1]
            if kind == 2 and max(map(int, m[0].split("."))) > 255 or kind == 4 and not 10 <= len(d) <= 15:
                continue
            if kind == 3 and not (14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0):
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_are_those_of_the_plain_expressions():
    rng = random.Random(11)
    for pool, n in (("0123456789. -+()@a", 40), ("a.@b-c_d%", 25), ("012345. ", 30), ("4 -0", 30), ("+1 ().-2", 30)):
        for _ in range(1500):
            t = "".join(rng.choice(pool) for _ in range(rng.randint(0, n)))
            assert personal_data.patterns(t) == plain_patterns(t), t
    for t in ("1" * 300_000, "a" * 300_000 + "@", "(" * 300_000, "+ " * 200_000, "1." * 200_000):
        personal_data.find_all([t], personal_data.Field())


def valid_card(rng):
    head = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(head + str(d) for d in range(10) if personal_data.luhn(head + str(d)))


def items(rng, n):
    make = {2: lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), 3: lambda: valid_card(rng), 4: lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"}
    return [(k, make[k]()) for k in (2, 3, 4) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    return personal_data.Field().fit(personal_data.rewritten(items(random.Random(1), 60), np.random.default_rng(7)))


def test_field_takes_neighbours_apart_and_leaves_other_numbers(field):
    rng = random.Random(2)
    told = items(rng, 25)
    rng.shuffle(told)
    missed = 0
    for (k, a), (j, b) in zip(told, told[1:]):
        text = f"see {a} {b} now"
        base, added = personal_data.find_all([text], field)[0]
        spans = {(s, e) for s, _, e in base + added}
        missed += (4, 4 + len(a)) not in spans and not any(s <= 4 and e >= 4 + len(a) for s, e in spans)
    assert missed <= 3
    clean = "on 2024-01-15 at 12:30, section 4.0.1 of 1,234,567 rows, isbn 978-3-16-148410-0, 5.6 and 7.8; pages 12-14 15-19; key f33e61083db5dbdf4bd2369d2f80176e57f7fda2 no 12345678901234567890123"
    assert personal_data.find_all([clean], field) == [([], [])]


def segmentations(n, candidates, start=0):
    if start == n:
        yield []
        return
    for rest in segmentations(n, candidates, start + 1):
        yield [(start, personal_data.O, 1), *rest]
    for s, w in candidates:
        if s == start:
            for rest in segmentations(n, candidates, start + w):
                for k in (2, 3, 4):
                    yield [(s, k, w), *rest]


def test_program_and_gradient_against_enumeration():
    rng = np.random.default_rng(4)
    f = personal_data.Field()
    f.weights[:], f.moves[:] = rng.normal(0, 0.6, f.weights.shape), rng.normal(0, 0.6, f.moves.shape)
    tokens = personal_data.Tokens([("1234 56.78", "", "", []), ("+12 345", "x", "", []), ("12-3456 7", "", "", [(3, 7)])])
    decoded = f.decode(tokens)
    logs = []
    for r in range(3):
        mine = np.flatnonzero(tokens.run == r)
        number = {(int(tokens.start[i]), int(tokens.width[i])): i for i in mine}
        scores = {}
        for path in segmentations(int(tokens.count[r]), list(number)):
            total, before = 0.0, personal_data.O
            for s, k, w in path:
                total += f.moves[before, k] + (tokens.features[number[s, w]] @ f.weights[:, k - 2] if k else 0.0)
                before = k
            scores[tuple(path)] = total
        best = max(scores, key=scores.get)
        assert [(s, k, s + w) for s, k, w in best if k] == decoded[r]
        logs.append(np.log(np.exp(list(scores.values())).sum()))
    wanted, moves = np.zeros(len(tokens.run), np.int64), np.zeros((5, 5))
    wanted[np.flatnonzero(tokens.run == 0)[0]] = 2
    value, gw, gm = f.gradient(tokens, wanted, moves)
    has = int(np.flatnonzero(wanted)[0])
    assert value == pytest.approx(tokens.features[has] @ f.weights[:, 0] - sum(logs))
    for x, g, at in ((f.weights, gw, (0, 1)), (f.weights, gw, (9, 0)), (f.moves, gm, (0, 3)), (f.moves, gm, (2, 0))):
        keep = x[at]
        x[at] = keep + 1e-5
        up = f.gradient(tokens, wanted, moves)[0]
        x[at] = keep - 1e-5
        down = f.gradient(tokens, wanted, moves)[0]
        x[at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_personal_data_of_whole_tables_and_odd_rows(spark, odd, none, tmp_path):
    more = spark.createDataFrame([(20, "mail jörg@münchen.example.de or a.b@c.org", "de", "a", 0), (21, "+49 30 1234567 4111111111111111", "de", "a", 0), (21, None, "de", "a", 0)], DOCS)
    docs = odd.unionByName(more).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000))
    got = queries.QUERIES["op13_personal_data"](spark, folder(tmp_path, documents=docs)).collect()
    assert len(got) == docs.count()
    texts = Counter()
    names = personal_data.KINDS
    for r in docs.collect():
        spans = plain_patterns(r.text or "")
        base = ",".join(f"{names[k - 1]}:{s}:{e}" for s, k, e in spans)
        texts[(r.doc_id, *[sum(x[1] == k for x in spans) for k in (1, 2, 3, 4)], hashlib.sha256(base.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == texts
    assert "email:5:28" in next(r.spans for r in got if r.doc_id == 20).split(",")
    assert queries.QUERIES["op13_personal_data"](spark, folder(tmp_path / "e", documents=none)).count() == 0


def test_redaction_and_clashing_columns(spark, field, tmp_path):
    rows = spark.createDataFrame([(1, "to a@b.org, +1 (555) 555-1234 1.2.3.4.", "x"), (2, None, "y"), (3, "nothing", "z")], "doc_id long, text string, Spans string")
    personal_data.with_spans(rows, field).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["doc_id", "text", "spans"]
    got = {r.doc_id: r.text for r in personal_data.redacted(rows.drop("Spans"), field).collect()}
    assert got[1].startswith("to <email>, <phone>") and got[1].endswith(".") and not re.search("[0-9]", got[1])
    assert got[2] is None and got[3] == "nothing"


# --- earlier operators: keys without value, names that differ by case, maps ---------------------------------------------------
def plain_components(rows):
    """(key, fp) rows: the least key reachable by steps of at most three bits, over all rows."""
    seen, out = set(), {}
    for start in range(len(rows)):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            near = [j for j in range(len(rows)) if j not in group and ((rows[x][1] ^ rows[j][1]) & (1 << 64) - 1).bit_count() <= 3]
            group.update(near)
            todo += near
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.update({j: least for j in group})
    return Counter((*rows[j], out[j]) for j in range(len(rows)))


def test_rows_without_a_key_link_others(spark):
    told = spark.createDataFrame([(1, 0), (None, 7), (2, 63)], "doc_id long, fp long")
    assert {r["component"] for r in simhash_dedup.cluster(simhash_dedup.stored(told)).collect()} == {1}
    rng = random.Random(8)
    rows = []
    for k in range(300):
        fp = rng.getrandbits(64) - (1 << 63) if k % 10 == 0 or not rows else rows[-1][1]
        for b in rng.sample(range(63), rng.randint(0, 4)):
            fp ^= 1 << b
        rows.append((None if rng.random() < 1 / 3 else rng.randint(0, 10_000), fp))
    fps = simhash_dedup.stored(spark.createDataFrame(rows, "doc_id long, fp long"))
    got = fps.join(simhash_dedup.cluster(fps), "fp").select("doc_id", "fp", "component").collect()
    assert Counter(map(tuple, got)) == plain_components(rows)


def test_names_that_differ_by_case_and_maps_go_through_every_stage(spark, odd, tmp_path):
    import corpus_pipeline

    rows = odd.withColumns({"SHARD": F.lit("s"), "Slot": F.lit(1), "Score": F.lit(2), "m": F.create_map(F.lit("a"), "doc_id"), "_copy": F.lit(3)})
    sharding.shard(rows.drop("m"), ["doc_id", "text"]).write.parquet(f"{tmp_path}/shards")
    assert sorted(spark.read.parquet(f"{tmp_path}/shards").columns) == sorted([*odd.columns, "Score", "_copy", "shard", "slot"])
    toxicity.score(rows, toxicity.fit(odd, spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int"))).write.parquet(f"{tmp_path}/scores")
    assert "score" in spark.read.parquet(f"{tmp_path}/scores").columns
    place = folder(tmp_path / "in", documents=rows, benchmark=spark.createDataFrame([(1, EN)], "item_id long, text string"))
    docs = rows
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, place).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    assert sorted(docs.columns) == sorted([*odd.columns, "Score", "m", "_copy", "shard", "slot"])


def test_stray_end_tags_cost_nothing():
    page = "<article>" + "<div>" * 20_000 + "</p></span>" * 20_000 + "text of an article" + "</div>" * 20_000 + "</article>"
    began = time.process_time()
    assert html_extract.main_text(page) == "text of an article"
    assert time.process_time() - began < 5
