"""Cross-entropy difference of two matched n-gram models.

Target and background model share one vocabulary, the words of the corpus, one order and
one smoothing, and their counts are scaled to the same number of words. A document's score
is the mean over its words of the target loss minus the background loss: the lower, the
more it reads like the target.

Words and pairs are told apart by full 64-bit hashes, and no table of theirs is held whole.
Documents lie in blocks of bounded size. A block sends its counts to shares of the hash
space, whose number grows with the corpus; a share adds up and sends each block the totals of
its keys in the order in which the block sent them, so keys travel one way only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import partitions_for, stored

#: Powers of two to which ``Numbering()(text)`` folds hashes, for models of fixed size; scoring folds nothing.
WORDS, PAIRS = 19, 21

#: Bytes of text in a block, a longer document having one of its own, and bytes of text for each share of the hash space.
BLOCK, SHARE = 8 << 20, 8 << 20


@dataclass(frozen=True)
class Models:
    """Counts of both models: arrays of (target, background) rows."""

    words: np.ndarray
    pairs: np.ndarray
    totals: np.ndarray
    mix: float = 0.5
    vocabulary: int | None = None  # as many as ``words`` if not given

    def losses(self, one: np.ndarray, two: np.ndarray, own: tuple[int, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each word under both models, pairs interpolated with words.

        ``own`` is the model that has counted the text itself and the weight it counted it
        with; what the text gave is then taken out before it is scored.
        """
        size = len(self.words) if self.vocabulary is None else self.vocabulary
        words, pairs, totals = self.words[one], self.pairs[two], self.totals
        if own is not None:
            side, weight = own
            totals = totals.copy()
            totals[side] -= weight * len(one)
            for counts, places in ((words, one), (pairs, two)):
                _, at, n = np.unique(places, return_inverse=True, return_counts=True)
                counts[:, side] = np.maximum(counts[:, side] - weight * n[at], 0)
        alone = (words + 0.5) / (totals + 0.5 * size)
        out = alone.copy()
        if len(one) > 1:
            before = words[:-1]
            joint = np.minimum(pairs, before)
            out[1:] = np.where(before > 0, self.mix * joint / np.maximum(before, 1e-9) + (1 - self.mix) * alone[1:], alone[1:])
        loss = -np.log(out)
        return loss[:, 0], loss[:, 1]


class Numbering:
    """Hashes of the words and word pairs of a text."""

    def __init__(self, room: int = 200_000):
        import xxhash

        self.digest, self.room = xxhash.xxh3_64_intdigest, room
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        if len(self.known) > self.room:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.digest(w)
        full = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        with np.errstate(over="ignore"):
            two = (full[:-1] * np.uint64(0x9E3779B97F4A7C15) + full[1:]) * np.uint64(0xD6E8FEB86659FD93)
        return full, two

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        full, two = self.hashes(text)
        return (full >> np.uint64(64 - WORDS)).astype(np.int64), (two >> np.uint64(64 - PAIRS)).astype(np.int64)


@dataclass
class Block:
    """Hashes of a block's words and pairs in order, their (target, background) counts, and each text as places in them."""

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    texts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, number: Numbering, texts: Iterable[str], chosen: list[int]) -> Block:
        found = [number.hashes(t) for t in texts]
        keys, counts, places = [], [], []
        for kind in (0, 1):
            lengths = [len(f[kind]) for f in found]
            own, at = np.unique(np.concatenate([f[kind] for f in found]), return_inverse=True)
            side = np.repeat(np.array(chosen, dtype=bool), lengths)
            keys.append(own)
            counts.append(np.stack([np.bincount(at[side], minlength=len(own)), np.bincount(at[~side], minlength=len(own))], axis=1))
            places.append(np.split(at.astype(np.int32), np.cumsum(lengths)[:-1]))
        return cls(keys, counts, list(zip(*places)))


def _in_blocks(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, t, block, size``: rows of ``docs``, whether they are target, and their block."""
    chosen = target.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("_t", F.lit(1))
    # one join strategy at every size: target ids are as many as documents
    met = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(
        chosen.hint("merge"), "id", "left").select("id", "text", F.coalesce("_t", F.lit(0)).alias("t"), F.octet_length("text").cast("long").alias("size"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            blocks = []
            for size in b.column(3).to_pylist():
                if held and held + size > BLOCK:
                    block, held = block + 1, 0
                held += size
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64())], [*b.schema.names, "block"])

    return stored(met.mapInArrow(place, T.StructType([*met.schema.fields, T.StructField("block", T.LongType())])))


_SENT = "kind int, share long, block long, keys binary, target binary, background binary"
_TOTAL = "kind int, share long, block long, target binary, background binary"


def _packed(numbers: np.ndarray) -> bytes:
    """All lowest bytes, then all second ones and so on: small numbers leave runs of zeros, which shuffles and files compress."""
    return np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes | pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sent(kind: int, share: int, block: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Keys in order, as steps from one to the next, and their counts."""
    return kind, share, block, _packed(np.diff(keys, prepend=np.uint64(0))), *(_packed(counts[:, k]) for k in (0, 1))


def _keys(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_unpacked(data), dtype=np.uint64)


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows of ``_SENT``, or of ``_TOTAL``, which has no keys."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * (len(rows[0]) - 3)]
    names = [c.split()[0] for c in (_SENT if len(kinds) == 6 else _TOTAL).split(", ")]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _edges(shares: int) -> np.ndarray:
    """First hash of every share but the first."""
    return np.array([-(-(k << 64) // shares) for k in range(1, shares)], dtype=np.uint64)


def _cuts(keys: np.ndarray, edges: np.ndarray) -> list[int]:
    """Where each share begins and ends in ordered keys."""
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _counted(placed: DataFrame, shares: int) -> DataFrame:
    """Counts of each block's words (kind 0) and pairs (kind 1), a row for each share of the hash space."""
    edges = _edges(shares)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Numbering()

        def finish(block: int, texts: list[str], chosen: list[int]) -> Iterator[pa.RecordBatch]:
            own = Block.of(number, texts, chosen)
            for kind in (0, 1):
                cuts = _cuts(own.keys[kind], edges)
                rows = [_sent(kind, k, block, own.keys[kind][a:z], own.counts[kind][a:z]) for k, (a, z) in enumerate(zip(cuts, cuts[1:])) if a < z]
                if rows:
                    yield from _rows(rows).to_batches(max_chunksize=1000)

        last, texts, chosen = None, [], []
        for b in batches:
            for text, t, block in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if block != last and texts:
                    yield from finish(last, texts, chosen)
                    texts, chosen = [], []
                last = block
                texts.append(text.as_py())
                chosen.append(t)
        if texts:
            yield from finish(last, texts, chosen)

    return placed.select("text", "t", "block").mapInArrow(count, _SENT)


def _totals(counted: DataFrame) -> DataFrame:
    """For each block the totals of its keys, a row for each share, in the order of the keys.

    A row of block -1 tells how many keys a share has (in both columns), one of block -2
    their sums. A key has at most one row a block and task, so common words make no large group.
    """
    def add(group: pa.Table) -> pa.Table:
        kind, share = group["kind"][0].as_py(), group["share"][0].as_py()
        parts = [_keys(x.as_buffer()) for x in group["keys"]]
        cuts = np.cumsum([0, *map(len, parts)]).tolist()
        keys, at = np.unique(np.concatenate(parts), return_inverse=True)
        parts.clear()
        sums = np.zeros((len(keys), 2), dtype=np.int64)
        for k, side in enumerate(("target", "background")):
            for x, a, z in zip(group[side], cuts, cuts[1:]):
                sums[at[a:z], k] += _unpacked(x.as_buffer()).astype(np.int64)  # a block names a key once
        both = [_packed(sums[:, k].sum(keepdims=True)) for k in (0, 1)]
        rows = [(kind, share, -1, *[_packed(np.array([len(keys)]))] * 2), (kind, share, -2, *both)]
        for block, a, z in zip(group["block"].to_pylist(), cuts, cuts[1:]):
            rows.append((kind, share, block, *(_packed(sums[at[a:z], k]) for k in (0, 1))))
        return _rows(rows)

    return stored(counted.groupBy("kind", "share").applyInArrow(add, _TOTAL))


def score_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    leave_own_out: bool = False) -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, score`` of every row.

    ``target`` has the ids of the target documents; all others are the background. With
    ``leave_own_out`` a row is scored by models that have not counted it, so documents of the
    target and others like them are judged alike; equal rows count for each other. Losses
    are means in nats a word; texts without words (null, empty, blank) have 0 words and
    score 0. Ids may repeat; a null id is background. Empty tables give no rows.
    """
    placed = _in_blocks(docs, target, id_col, text_col)
    size = placed.agg(F.sum("size")).first()[0] or 0
    shares = partitions_for(size, SHARE)
    totals = _totals(_counted(placed, shares))
    vocabulary, sums = 0, np.zeros(2)
    for row in totals.where("block < 0 and kind = 0").select("block", "target", "background").toLocalIterator():
        found = [int(_unpacked(row[side])[0]) for side in ("target", "background")]
        if row["block"] == -1:
            vocabulary += found[0]
        else:
            sums += found
    matched = np.where(sums > 0, sums.max(initial=1.0) / np.maximum(sums, 1), 1.0)

    def judge(own: pa.Table, sent: pa.Table) -> pa.Table:
        chosen = own["t"].to_pylist()
        # one text and one share's totals at a time; the rest stays in Arrow's buffers
        block = Block.of(Numbering(), (t.as_py() for t in own["text"]), chosen)
        edges = _edges(shares)
        cuts = [_cuts(keys, edges) for keys in block.keys]
        for kind, share, *row in zip(sent["kind"].to_pylist(), sent["share"].to_pylist(), sent["target"], sent["background"]):
            for side, x in enumerate(row):
                block.counts[kind][cuts[kind][share]:cuts[kind][share + 1], side] = _unpacked(x.as_buffer())
        block.keys.clear()
        counts = [block.counts.pop(0) * matched for _ in (0, 1)]
        models = Models(*counts, sums * matched, vocabulary=vocabulary)
        rows = []
        for (one, two), t in zip(block.texts, chosen):
            without = (1 - t, matched[1 - t]) if leave_own_out else None
            a, b = models.losses(one, two, without) if len(one) else (np.zeros(1), np.zeros(1))
            rows.append((len(one), float(a.mean()), float(b.mean())))
        lengths, a, b = zip(*rows)
        return pa.Table.from_arrays([own["id"], pa.array(lengths, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_words", "target_loss", "background_loss"])

    kind = placed.schema["id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("target_loss", T.DoubleType()), T.StructField("background_loss", T.DoubleType())])
    scored = placed.select("id", "text", "t", "block").groupBy("block").cogroup(totals.where("block >= 0").groupBy("block")).applyInArrow(judge, schema)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
