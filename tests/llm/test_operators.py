import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.llm import chat, fingerprints, lm_scoring, mixing, neighbours, packing, passages, private_data, simhash, toxicity
from rillwork.llm.common import stored
from rillwork.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string, row int, _text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    shared = words(rng, 70)
    out = {i: words(rng, rng.randint(1, 160)) for i in range(40)}
    out[5] = out[2]
    out[6] = out[2] + " tail"
    for i in (7, 9, 12, 15):
        out[i] = f"{words(rng, 12)} {shared} {words(rng, 9)}"
    out[20], out[21], out[22] = "", None, " \n\t"
    out[23] = words(rng, 9000)
    out[24] = "Éa <|endoftext|> İx 'll b c ２３ don't WE'VE !!?"
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Nulls in every column, an empty, a blank and a long text, a repeated row, clashing extra columns."""
    rows = [(i, t, ["b", "a", None, "z"][i % 4], None, None, "x", 1, "y") for i, t in texts.items()]
    rows += [rows[3], (None, "only here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_pieces_and_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), limit=256).toPandas()
    want = []
    for r in docs.collect():
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(-1 if r["doc_id"] is None else r["doc_id"], p, a, len(ids[a:a + 256]), zlib.crc32(np.array(ids[a:a + 256], "<u4").tobytes()))
                 for p, a in enumerate(range(0, len(ids), 256))]
    have = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(map(tuple, have.to_numpy().tolist())) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum()[:-1]]).all() and own.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 256) + 1
    assert packing.pack_documents(none(spark), tokenizer_path()).count() == 0


def test_coder_agrees_with_the_tokenizer_on_all_neighbours(monkeypatch):
    coder = packing.CachedTokenizer(tokenizer_path())
    monkeypatch.setattr(packing.CachedTokenizer, "CHUNK", 5000, raising=False)
    plain = [chr(c) for c in [9, 10, 13, *range(0x20, 0x7f), *range(0xa1, 0x130), *range(0x132, 0x180)]]
    texts = ["".join(f"x{a}{b}y {a}{b}" for b in plain) for a in plain]
    rng = random.Random(3)
    some = ["'", "s", "T", "re", "'ve", "m", "'LL", "l", "d", " ", ".", "9", "½", "×", "é", "ŉ", "ß"]
    more = [*some, "İ", "ﬁ", "中", "’", "😀", "e\u0301", "\x0b", "\x00", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts += ["".join(rng.choices(more if i % 3 else some, k=rng.randint(0, 30))) for i in range(6000)]
    want = [x.ids for x in coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
    assert coder.encode([]) == [] and coder.encode(["", " \n"]) == [b"", b""]


def test_parts_met_again_and_again_are_learned_once():
    rng = random.Random(5)
    common = ["".join(rng.choices("aeinrst", k=8)) for _ in range(50)]
    coder = packing.CachedTokenizer(tokenizer_path(), room=400)
    asked, learn = [], coder._part_ids
    coder._part_ids = lambda parts: asked.append(len(parts)) or learn(parts)
    for i in range(40):
        rare = ["".join(rng.choices("bcdfghjklm", k=9)) for _ in range(150)]
        # the same parts in ever new words
        coder.encode([" ".join([*rare, *[f"{w}{i}" for w in common]])])
    # digits not met for a while are learned anew
    assert sum(asked) <= 40 * 150 + len(common) + 2 * 40


def test_cutting_costs_less_than_the_tokenizer():
    rng = random.Random(6)
    stems = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 9))) for _ in range(6000)]
    signs = ["", *".,-;:!?)('\"#&*+=_~/"]
    texts = [" ".join(rng.choice(signs) + rng.choice(stems) + rng.choice(signs) for _ in range(500)) for _ in range(600)]
    whole, own = [], []
    for _ in range(3):
        coder = packing.CachedTokenizer(tokenizer_path())
        began = time.process_time()
        coder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        whole.append(time.process_time() - began)
        began = time.process_time()
        coder.encode(texts)
        own.append(time.process_time() - began)
    assert min(own) < 0.3 * min(whole), (own, whole)


def test_local_search_keeps_items_and_never_opens_bins():
    rng = np.random.default_rng(1)
    for low, high in ((1, 100), (30, 60), (34, 51), (60, 100)):
        lengths = rng.integers(low, high, 400)
        first = packing.best_fit(lengths, 100)
        after = packing.empty_bins(lengths, first, 100)
        assert np.bincount(after, lengths).max() <= 100
        assert len(set(after.tolist())) <= len(set(first.tolist()))
    # best fit opens three bins for these; an exchange of two documents for one empties one
    lengths = np.array([6, 4, 4, 3, 3])
    assert len(set(packing.empty_bins(lengths, packing.best_fit(lengths, 10), 10).tolist())) == 2


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs, with_rows=True).toPandas()
    assert len(got) == docs.count()
    size = defaultdict(int)
    for r in docs.collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(s for s in size if s is not None) + [None]
    weight, full = dict(zip(order, (5, 2, 1, 5))), set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        own = got[got.source.isna() if s is None else got.source == s]
        assert own.target.iloc[0] == pytest.approx(2 * size[s] if s in full else weight[s] * level)
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and got["row"].iloc[0]["size"] in ("x", None)
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert sorted(got.taken.tolist()) == sorted(again.taken.tolist())
    assert mixing.mix_sources(none(spark)).count() == 0


def test_mixing_of_equal_rows_meets_the_target(spark):
    rows = [(1, "three plain words", "a")] * 1000 + [(i, "one two three four", "b") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_sources(df).toPandas()
    for _, own in got.groupby("source"):
        assert len(own) in (1000, 10)
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max() / 2
        assert own.copies.max() - own.copies.min() <= 1


def test_unknown_layouts_are_rejected_and_others_found_by_what_they_ask_for(spark):
    records = ['{"role": "user", "text": "a", "id": 7, "source": "s"}', '{"messages": [{"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]}]}',
               '{"odd": 1}', None, "broken {", '{"prompt": "p", "response": "r", "system": "s", "meta": {"k": [1]}}', '{"prompt": "p", "completion": "c", "response": "r"}', "{}"]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv long, n long, record string")
    turns = chat.canonical_turns(df, "conv", "n", "record")
    got = {}
    for r in turns.where("role is not null").orderBy("key", "turn").collect():
        got.setdefault(r["key"], []).append((r["role"], r["text"]))
    assert got == {0: [("user", "a")], 1: [("user", "b\nc")], 5: [("system", "s"), ("user", "p"), ("assistant", "r")]}
    refused = {r["key"]: r["record"] for r in chat.rejected(turns).collect()}
    assert refused == {i: records[i] for i in (2, 3, 4, 6, 7)}
    assert "[TURN]" not in "".join(r["formatted"] for r in chat.format_turns(turns).collect())
    assert chat.format_turns(turns.limit(0)).count() == chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def kept_by_brute_force(rows, window):
    first = {}
    split = [(k if k is not None else 1 << 62, (t or "").encode().split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, k), k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < k:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 20])
def test_repeated_passages(spark, docs, window):
    got = passages.remove_repeated(docs, window=window).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == kept_by_brute_force(rows, window)
    assert sum(r["n_removed"] for r in got) > 200
    assert passages.remove_repeated(none(spark)).count() == 0


def test_passages_with_few_words_and_repeats_inside(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(20, 120)))) for i in range(30)] + [(31, "a " * 90), (32, "a " * 70)]
    got = passages.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), window=8).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == kept_by_brute_force(rows, 8)


def test_forest_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 16)).round(3)
    base[100:140] = base[50]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (None, [1.0] * 16), (3050, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("tree", F.lit(1))
    got = neighbours.nearest(df, F.col("vec_id") % 50 == 0).toPandas()
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = unit @ unit[q]
        score[q] = -2
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, score[own.vec_id], atol=1e-12)
        hits += len(set(own.vec_id) & set(np.argsort(-score, kind="stable")[:5]))
    assert hits / 300 >= 0.9
    assert got[got.query_id == 50].vec_id.tolist() == [100, 101, 102, 103, 104]
    assert set(got.query_id) == set(range(0, 3000, 50))
    assert neighbours.nearest(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    few = neighbours.nearest(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2


def test_cross_entropy_difference(spark):
    rng = random.Random(3)
    rows = [(i, words(random.Random(i % 2), 3) + " " + " ".join(rng.choice(["red", "blue"] if i % 2 else ["cat", "dog"]) for _ in range(30))) for i in range(60)]
    rows += [(60, None), (61, ""), (None, "cat red"), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    target = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, target).collect()}
    assert max(got[i]["score"] for i in range(41, 60, 2)) < min(got[i]["score"] for i in range(40, 60, 2))
    assert got[60]["n_words"] == got[61]["n_words"] == 0 and got[60]["score"] == 0
    assert lm_scoring.score_documents(df, target).count() == 64
    assert lm_scoring.score_documents(none(spark), target).count() == 0


def plain_scores(rows, target):
    """Losses under counts of all other rows, word by word."""
    texts = [(t or "").lower().split() for _, t in rows]
    sides = [0 if i in target and i is not None else 1 for i, _ in rows]
    out, sums = [], [0, 0]
    for words_, s in zip(texts, sides):
        sums[s] += len(words_)
    matched = [max(sums) / x if x else 1.0 for x in sums]
    vocabulary = len({w for t in texts for w in t})
    for k, own in enumerate(texts):
        counts, pairs, total = [defaultdict(float), defaultdict(float)], [defaultdict(float), defaultdict(float)], [0.0, 0.0]
        for j, (t, s) in enumerate(zip(texts, sides)):
            if j != k:
                total[s] += matched[s] * len(t)
                for w in t:
                    counts[s][w] += matched[s]
                for p in zip(t, t[1:]):
                    pairs[s][p] += matched[s]
        loss = [[], []]
        for s in (0, 1):
            for n, w in enumerate(own):
                p = (counts[s][w] + 0.5) / (total[s] + 0.5 * vocabulary)
                before = counts[s][own[n - 1]] if n else 0
                if before > 0:
                    p = 0.5 * min(pairs[s][own[n - 1], w], before) / before + 0.5 * p
                loss[s].append(-np.log(p))
        out.append((len(own), *[float(np.mean(x)) if own else 0.0 for x in loss]))
    return out


def test_a_document_is_scored_by_what_others_count(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 300)
    monkeypatch.setattr(lm_scoring, "SHARE", 900)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("red blue green cat dog".split()[i % 2:]) for _ in range(rng.randint(1, 25))) + f" only{i}") for i in range(40)]
    rows += [(40, rows[2][1]), (41, None), (42, "solo"), (None, "red cat"), (3, "blue " * 3000)]
    target = [i for i in range(0, 40, 4)]
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in target], "doc_id long"), leave_own_out=True).collect()
    have = sorted((str(r["doc_id"]), r["n_words"], round(r["target_loss"], 6), round(r["background_loss"], 6)) for r in got)
    assert have == sorted((str(i), n, round(a, 6), round(b, 6)) for (i, _), (n, a, b) in zip(rows, plain_scores(rows, set(target))))


def test_held_out_halves_of_one_style_score_alike(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, 20) + " " + " ".join(rng.choice(["red", "blue", "green"]) for _ in range(30))) for i in range(120)]
    target = spark.createDataFrame([(i,) for i in range(0, 120, 2)], "doc_id long")
    got = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), target, leave_own_out=True).toPandas()
    halves = got.groupby(got.doc_id % 2).score.mean()
    assert abs(halves[0] - halves[1]) < 0.1


def test_losses_against_plain_counting():
    counts = np.zeros((1 << lm_scoring.WORDS, 2))
    pairs = np.zeros((1 << lm_scoring.PAIRS, 2))
    one, two = lm_scoring.Numbering()("a b a c")
    np.add.at(counts, one, [3.0, 1.0])
    np.add.at(pairs, two, [2.0, 1.0])
    a, b = lm_scoring.Models(counts, pairs, counts.sum(axis=0)).losses(one, two)
    total, floor = 12.0, 0.5 * (1 << lm_scoring.WORDS)
    alone = (6.0 + 0.5) / (total + floor)
    assert a[0] == pytest.approx(-np.log(alone)) and a[2] == pytest.approx(-np.log(0.5 * 2 / 3 + 0.5 * alone)) and len(b) == 4


def test_losses_over_more_words_than_any_fixed_table(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)
    monkeypatch.setattr(lm_scoring, "SHARE", 500_000)
    monkeypatch.setattr(lm_scoring, "WORDS", 4)
    monkeypatch.setattr(lm_scoring, "PAIRS", 5)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randint(0, 60)) + " The same the same") for i in range(300)] + [(7, "the other"), (None, "the"), (300, None)]
    chosen = set(range(0, 300, 3))
    split = [(i, (t or "").lower().split()) for i, t in rows]
    ones, twos, sums = [Counter(), Counter()], [Counter(), Counter()], [0, 0]
    for i, w in split:
        side = 0 if i in chosen else 1
        ones[side].update(w)
        twos[side].update(zip(w, w[1:]))
        sums[side] += len(w)
    size, most, want = len({*ones[0], *ones[1]}), max(sums), []
    for i, w in split:
        loss = []
        for one, two, n in zip(ones, twos, sums):
            by = most / n
            own = []
            for k, x in enumerate(w):
                p = (one[x] * by + 0.5) / (most + 0.5 * size)
                if k and one[w[k - 1]]:
                    p = 0.5 * two[w[k - 1], x] / one[w[k - 1]] + 0.5 * p
                own.append(-np.log(p))
            loss.append(round(float(np.mean(own)), 6) if w else 0.0)
        want.append((-1 if i is None else i, len(w), *loss))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    got = [(-1 if r[0] is None else r[0], r[1], round(r[2], 6), round(r[3], 6)) for r in lm_scoring.score_documents(df, target).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=2e-6)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        own = words(rng, 30).split()
        if bad:
            own[rng.randrange(30):0] = ["vile", "rotten"]
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "vile rotten"), (5, rows[5][1])]
    labels += [(902, None), (None, 1), (5, labels[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(df, lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.notna()].merge(pd.DataFrame(labels[:900], columns=["doc_id", "y"]), on="doc_id")
    assert (held.predicted == held.y).mean() > 0.97
    assert all(h == (zlib.crc32(str(int(k)).encode()) % 5 == 0) for k, h in zip(got.doc_id, got.held_out) if k == k)
    assert toxicity.score_documents(none(spark), lab).count() == 0
    assert toxicity.score_documents(df, lab.where("toxic > 5")).where("score <> 0.5").count() == 0


def test_golay_anchors_cover_all_pairs():
    near = simhash.error_patterns(0)
    assert all(len(x) == 1 for x in near)  # the code is perfect
    wide = simhash.error_patterns(2)
    rng = np.random.default_rng(5)
    for x in rng.integers(0, 1 << 23, 300).tolist():
        home = x ^ near[int(simhash._syndromes(np.array([x]))[0])][0][0]
        y = x ^ (1 << int(rng.integers(23))) ^ (1 << int(rng.integers(23)))
        assert home in {y ^ p for p, _ in wide[int(simhash._syndromes(np.array([y]))[0])]}


def test_near_duplicates(spark, docs):
    import xxhash

    def plain(text):
        w = (text or "").encode().lower().split()
        own = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in own]
        return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))

    rng = random.Random(2)
    extra = [(100 + i, " ".join(["x", "y", "z", "w", *[rng.choice("uv") for _ in range(2)]])) for i in range(40)]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r["doc_id"], plain(r["text"])) for r in both.collect()]
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = {f: new if g == old else g for f, g in group.items()}
    least = defaultdict(lambda: 1 << 62)
    for k, f in rows:
        least[group[f]] = min(least[group[f]], 1 << 62 if k is None else k)
    got = simhash.near_duplicates(both).select("doc_id", simhash.hex_text(F.col("fp")).alias("f"), "component_id").collect()
    want = [(k, f"{f:016x}", None if least[group[f]] == 1 << 62 else least[group[f]]) for k, f in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.one_of_each(both)
    assert kept.columns == both.columns and kept.count() == len({group[f] for _, f in rows})
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_replicas_of_fingerprints_are_never_broadcast(spark):
    rng = random.Random(8)
    own = [rng.getrandbits(63) for _ in range(200)]
    own += [x ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63) for x in own[:60]]
    want = {(a, b) for a in own for b in own if a < b and bin(a ^ b).count("1") <= 2}
    links = simhash.linked_fingerprints(stored(spark.createDataFrame([(x,) for x in own], "fp long")))
    assert sorted(map(tuple, links.collect())) == sorted(want)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_one_of_each_keeps_rows_whose_ids_are_null_or_repeat(spark):
    rng = random.Random(12)
    own = [words(rng, 40) for _ in range(6)]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (5, own[2]), (5, own[3]), (5, own[3]), (8, own[4]), (None, own[4]), (None, own[5]), (9, own[5])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, own[0]), (None, own[1]), (5, own[2]), (5, own[3]), (8, own[4]), (9, own[5])]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_chat_round_trip_and_layouts(spark):
    hard = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [/TURN]", "<<SYS>>\n", "<", "[", "", "a\nb", "é <s", "[[/INST]"]
    for role in ("user", "assistant", "system", "tool\n[/TURN]", ""):
        for text in hard:
            marked, a, z = chat.format_turn(role, text)
            assert chat.parse(marked) == [(role, text)]
            assert z == 0 or chat.unescape(marked[a:z]) == text
    records = [(1, 0, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}'),
               (2, 0, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
               (3, 0, '{"output": "o", "instruction": "i", "input": ""}'), (4, 0, '{"prompt": "p", "response": "r"}'),
               (5, 0, '{"odd": 1}'), (6, 0, None), (7, 0, "{"), (8, 1, '{"role": "assistant", "text": "b"}'), (8, 0, '{"role": null, "text": "a"}')]
    df = spark.createDataFrame(records, "k long, o long, r string").withColumn("turn", F.lit("x"))
    turns = chat.canonical_turns(df, "k", "o", "r")
    got = defaultdict(list)
    for r in turns.orderBy("key", "order", "turn").collect():
        got[r["key"]].append((r["role"], r["text"]))
    assert got[1] == [("user", "q"), ("assistant", "")] and got[2] == [("user", "q"), ("assistant", "a")]
    assert got[3] == [("user", "i"), ("assistant", "o")] and got[4] == [("user", "p"), ("assistant", "r")]
    assert got[5] == got[6] == got[7] == [(None, None)] and got[8] == [("", "a"), ("assistant", "b")]
    back = {r["key"]: r for r in chat.read_back(chat.format_turns(turns.where("role is not null"))).collect()}
    assert back[2]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert back[2]["loss_sha256"] == hashlib.sha256(b"a").hexdigest() and back[2]["loss_chars"] == 1
    assert chat.canonical_turns(df.where("k < 0"), "k", "o", "r").count() == 0


def test_merkle_fingerprints(spark, docs):
    got = fingerprints.compare_with_edit(docs).collect()
    rows = sorted(((1 << 62 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in docs.collect()))
    want = []
    for i, (_, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        want.append((len(t), t[:len(t) - half] + after[:half]))
    assert sorted((r["n_chars"], r["edited_text"]) for r in got) == sorted(want)
    assert len({r["fingerprint"] for r in got}) == len({t for _, t in rows})
    assert all((r["near_edited"] == 1.0) if r["fingerprint"] == r["edited_fingerprint"] else True for r in got)
    small = fingerprints.with_next(docs, block=3).collect()
    assert sorted((r["text"], r["next_text"]) for r in small) == sorted((t, rows[(i + 1) % len(rows)][1]) for i, (_, t) in enumerate(rows))
    assert fingerprints.compare_with_edit(none(spark)).count() == 0
    one = fingerprints.compare_with_edit(docs.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0
    pair = spark.createDataFrame([("a. b.\n\nc. d\ne", "a. b.\n\nc. X\ne")], "x string, y string")
    where = pair.select(fingerprints.differing_branches(fingerprints.merkle_tree(F.col("x")), fingerprints.merkle_tree(F.col("y"))).alias("w")).first()["w"]
    assert [tuple(w) for w in where] == [(1, 0)]


RULES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted((m.start(), n, m.end()) for n, (k, rule) in enumerate(RULES) for m in re.finditer(rule, text) if holds(k, m[0]))


def test_private_data(spark):
    rng = random.Random(9)
    parts = ["a@b.c", "a@b.c_d@e.f", "x@y", "@", "1.2.3.4.5.6.7.8", "300.1.1.1", "000001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (212) 555-0199", "+49 30 1234567", "+1+2 3", "tel 212-555-0199", "mail bob[at]host[dot]com", "é", "\u0001", "\U0001f600", "..", "-", " ", "v 1.2.3.4"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "1" * 30_000, "1 " * 20_000, "a" * 30_000, "a@" + "b." * 20_000, "1." * 20_000, "+1" + "(" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.c"), (0, texts[0])], "doc_id long, text string").withColumn("base", F.lit(1))
    got = private_data.find_private(df, with_rows=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        base = [(s["start"], s["no"], s["end"]) for s in r["base"]]
        assert base == plain_spans(r["row"]["text"] or "")
        assert set(base) <= {(s["start"], s["no"], s["end"]) for s in r["spans"]}
    hidden = df.where("doc_id = 300 or doc_id is null").select(private_data.masked(F.col("text"), private_data.base_spans(F.col("text"))).alias("m"))
    assert "[EMAIL]" in [r["m"] for r in hidden.collect()]
    assert private_data.find_private(none(spark)).count() == 0


def test_votes_separate_reliable_labelers():
    post = private_data.fit_votes({"2222": 50, "2122": 40, "1000": 60, "1010": 30, "1121": 5})
    assert post["2222"] > 0.95 > 0.2 > post["1000"]
    assert private_data.fit_votes({}) == {}
