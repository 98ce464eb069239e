"""Byte-level BPE, dataset manifest and lookup clustering against plain versions of themselves."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillwork.llm import byte_bpe, lookup_clusters, manifest


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    return path, P.PATTERN, ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture()
def small_leaves(monkeypatch):
    def use(leaf, short):
        monkeypatch.setattr(byte_bpe, "LEAF", leaf)
        monkeypatch.setattr(byte_bpe, "SHORT", short)
    return use


@pytest.mark.parametrize("leaf, short", [(1, 2), (3, 4), (50, 8), (8192, 32)])
def test_joined_halves_equal_the_library(vocabulary, small_leaves, leaf, short):
    _, pattern, ranks, library = vocabulary
    small_leaves(leaf, short)
    coder, rng, tokens = byte_bpe.ByteCoder(ranks, pattern), random.Random(leaf), list(ranks)
    for i in range(1500):
        text = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) if i % 3 == 0 else
                "".join(rng.choice("ab 'lsv\n!1é　字") for _ in range(rng.randint(0, 60))) if i % 3 == 1 else
                b"".join(rng.choice(tokens) for _ in range(rng.randint(0, 9))).decode("utf8", "ignore"))
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert coder.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.text(alphabet="a' \nlé!", max_size=80))
def test_any_text_in_any_halves(a, b):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    coder = byte_bpe.ByteCoder(ranks, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    joined = b"".join(coder._join_text(coder._leaf(a), coder._leaf(b))[1]) if a and b else coder.encode(a + b)
    assert np.frombuffer(joined, "<u4").tolist() == library.encode_ordinary(a + b)


def test_texts_without_a_place_to_cut(vocabulary):
    _, pattern, ranks, library = vocabulary
    coder = byte_bpe.ByteCoder(ranks, pattern)
    for text in ("a" * 20_001, " " * 20_001 + "b", "é" * 9000, "'ll" * 9000, "\n" * 9001, "x" * 8191 + "'ll" * 10, "字" * 9000, "a " * 9000):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_encoded_documents(spark, vocabulary):
    path, pattern, _, library = vocabulary
    texts = ["", None, "plain words, don't", "<|endoftext|>", "  \t\n", "word " * 30_000, "same", "same"]
    df = spark.createDataFrame([(i if i != 4 else None, t, "x", b"y") for i, t in enumerate(texts)],
                               "doc_id long, text string, ids string, decoded binary")
    got = byte_bpe.decode_documents(byte_bpe.encode_documents(df, path, pattern), path, pattern).collect()
    assert sorted((r["decoded"].decode() for r in got)) == sorted(t or "" for t in texts)
    for r in got:
        text = texts[4 if r["doc_id"] is None else r["doc_id"]] or ""
        want = library.encode_ordinary(text)
        assert r["n_tokens"] == len(want) and bytes(r["ids"]) == np.array(want, "<u4").tobytes()
    assert byte_bpe.encode_documents(df.limit(0), path, pattern).count() == 0
    missing = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert byte_bpe.decode_documents(missing, path, pattern).first()["decoded"] is None


# --- manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, change=0):
    own = [row[0], row[1], row[2], None if row[3] is None else row[3] + change, row[4]]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in own])


def plain_tree(leaves, fanout):
    """Root, and of each leaf the siblings on its left and right by level."""
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, at in enumerate(own):
            first = at - at % fanout
            paths[k].append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
            own[k] = at // fanout
        level = [digest(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


ROWS = ([(i, ["a", None, "é"][i % 3], ["en", None, "z", "Ω"][0 if i < 70 else i % 4], None if i % 11 == 0 else i, "t" * (i % 5)) for i in range(140)]
        + [(7, "a", "en", 7, "again"), (7, "a", "en", 7, "again"), (None, None, None, None, None), (None, "b", "en", 3, "no id"),
           (900, "a", "alone", 3, "x" * 50_000)])


@pytest.mark.parametrize("fanout, levels", [(2, 4), (2, 1), (3, 2)])
def test_manifest_against_a_plain_tree(spark, fanout, levels):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("key", "idx", "n", "hash", "block", "path", "root")})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.when(hit, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in manifest.FIELDS]
    got = manifest.dataset_manifest(df.repartition(5), extra={"tampered": manifest.leaf_hash(changed)}, fanout=fanout, levels=levels)
    got = got.withColumn("folded", manifest.fold(F.col("tampered"), F.col("path"))).withColumn("proof", manifest.proof_hash(F.col("path")))

    groups = {}
    for row in ROWS:
        groups.setdefault(row[2], []).append((row[0] is None, row[0] or 0, plain_leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, upper = plain_tree([trees[g][0] for g in names], fanout)
    want = []
    for g, top in zip(names, upper):
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            h = plain_leaf(row, 1) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 else leaf
            for left, right in path + top:
                h = digest(left, h, right)
            want.append((str(row[0]), leaf, trees[g][0], root, digest(*[a + b for a, b in path + top]), h))
    have = [(str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"]) for r in got.collect()]
    assert sorted(have) == sorted(want)
    assert any(h[5] != root for h in have) and sum(h[5] == root for h in have) > 100


def test_small_manifests(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.dataset_manifest(df.limit(0)).count() == 0
    one = manifest.dataset_manifest(df.where("doc_id = 900")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == []


# --- clusters ---


def plain_clusters(rows, k, rounds, size, scale):
    own = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
           if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(own, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in own]

    for _ in range(rounds):
        met = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(own, met) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    met = assign()
    sums = [sum(d for d, c in met if c == n) for n in range(len(centroids))]
    return [(str(i), c, d, sums[c], sum(sums), centroids[c]) for (i, _), (d, c) in zip(own, met)]


def test_lookup_clusters_against_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(lookup_clusters, "GATHERED", 16)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, -0.25, 0, 0.5, 1]) * rng.random() for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [rows[1], rows[1], (None, rows[2][1]), (None, None), (300, None), (301, []),
             (302, [1.0] * 5), (303, [None] + [1.0] * 5), (304, [float("nan")] * 6), (305, [float("-inf")] * 6), (306, [0.0] * 6), (307, [-900.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "n", "sums", "cluster")})
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for k, rounds in ((7, 5), (200, 2), (1, 0)):
        got = lookup_clusters.cluster_vectors(df.repartition(5), k=k, rounds=rounds, size=6).collect()
        have = [(str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in got]
        assert sorted(have) == sorted(plain_clusters(rows, k, rounds, 6, 256.0))
    assert lookup_clusters.cluster_vectors(df.limit(0), size=6).count() == 0
    assert lookup_clusters.cluster_vectors(df.where("vec_id between 300 and 305"), size=6).count() == 0


def test_components_out_of_range_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="component out of range"):
        lookup_clusters.cluster_vectors(df, size=6).count()
