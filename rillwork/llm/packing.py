"""Best-fit packing of tokenised documents with a swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import give_back, kept, partitions_for, stored

#: Tokens of a sequence, the id that ends a document, and pieces packed by one task.
LIMIT, END_ID, SHARD = 4096, 1, 20_000


class CachedTokenizer:
    """Ids of whole texts, remembering the ids of parts.

    The vocabulary's rules cut lower-cased text into parts (runs of letters, single digits,
    runs of other signs, endings like ``'s``), and a text's ids are its parts' ids in order.
    Parts repeat far more often than texts do. A chunk of texts is cut in one go: each
    character becomes one byte that stands for its lower-case form, the different parts are
    found by Arrow, and only those never met go to the tokenizer. That holds for precomposed
    Latin text, where normalising is local as well; any other text, and one that holds a
    special token, goes to the tokenizer whole. At most ``room`` parts and those of one more
    chunk are remembered in each of two generations, so memory is bounded however many
    different parts a task meets.
    """

    #: Characters cut in one go; a longer text is a chunk of its own.
    CHUNK = 2_000_000

    def __init__(self, path: str, room: int = 200_000):
        import os

        import regex
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as NoNormalizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.room = path, room
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # the same vocabulary and merges, for parts that are lower-cased and cut already
        self.part_tokenizer = Tokenizer.from_file(path)
        self.part_tokenizer.normalizer = NoNormalizer([])
        self.part_tokenizer.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        special = [regex.escape(t.content) for t in self.part_tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([r"[^\t\n\r\x20-\x7e¡-įĲ-ſ]", *special])
        vocabulary = self.part_tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        # a byte for each lower-case character, blanks being 0, and the kind that each byte is of
        plain = [chr(c) for c in [*range(0x21, 0x7f), *range(0xa1, 0x130), *range(0x132, 0x180)]]
        small = sorted({c.lower() for c in plain})
        number = {c: i for i, c in enumerate(small, 1)}
        self.byte = np.zeros(0x180, dtype=np.uint8)
        self.byte[[ord(c) for c in plain]] = [number[c.lower()] for c in plain]
        self.char = np.array([ord(c) for c in " " + "".join(small)], dtype="<u2")
        self.kind = np.array([0] + [1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3 for c in small], np.uint8)
        self.quote = number["'"]
        self.endings = [[number[c] for c in e] for e in ("s", "t", "re", "ve", "m", "ll", "d")]

    @cached_property
    def tokenizer(self):
        """The tokenizer for whole texts, loaded when the first one needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _part_ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, many in one call: the last id of each ends a word, and no other does."""
        out: list[bytes] = []
        for i in range(0, len(parts), 1000):
            own = parts[i:i + 1000]
            text = self.char[np.frombuffer(b"\0".join(own), np.uint8)].tobytes().decode("utf-16-le")
            found = self.part_tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.asarray(found.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(own):
                out += self._ids(text.split())
                continue
            raw = ids.tobytes()
            out += [raw[a:z] for a, z in zip([0, *stops], stops)]
        return out

    def _known_ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts; what is not known is learned."""
        if len(self.known) > self.room:
            self.old, self.known = self.known, {}
        found = list(map(self.known.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            if (ids := self.old.get(parts[i])) is None:
                new.append(i)
            else:
                found[i] = ids
        for i, ids in zip(new, self._part_ids([parts[i] for i in new])):
            found[i] = ids
        self.known.update((parts[i], found[i]) for i in missing)
        return found

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text that ends in a blank, as bytes, and where its parts begin."""
        data = self.byte[np.frombuffer(text.encode("utf-16-le"), "<u2")]
        kind = self.kind[data]
        first = np.empty(len(data), dtype=bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == 2
        # an ending begins at a quote that no other sign precedes, and what follows it is a part of its own
        quotes = np.flatnonzero((data[:-1] == self.quote) & first[:-1] & (kind[1:] == 1))
        for ending in self.endings:
            own = quotes
            for k, letter in enumerate(ending, 1):
                own = own[data[own + k] == letter]
            first[own + 1] = False
            first[own + 1 + len(ending)] = True
        first &= data != 0
        return data, first

    def _plain(self, texts: list[str]) -> list[bytes]:
        data, first = self._cut(" ".join(texts) + " ")
        ends = np.cumsum([len(t) + 1 for t in texts])
        n_parts = np.cumsum(np.add.reduceat(first, np.r_[0, ends[:-1]], dtype=np.int64))
        full = data != 0
        data = data[full]
        at = np.r_[np.flatnonzero(first[full]), len(data)]
        del first, full
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
        parts = parts.dictionary_encode()
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array(self._known_ids(different), pa.large_binary()).take(parts.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset + np.r_[0, n_parts]].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:z]) for a, z in zip(stops, stops[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit numbers."""
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.odd).to_pylist()
        out: list[bytes] = [b""] * len(texts)
        chunk: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if odd[i]:
                out[i] = self._ids([text])[0]
                continue
            if chunk and size + len(text) > self.CHUNK:
                self._place(texts, chunk, out)
                chunk, size = [], 0
            chunk.append(i)
            size += len(text) + 1
        if chunk:
            self._place(texts, chunk, out)
        return out

    def _place(self, texts: list[str], chunk: list[int], out: list[bytes]) -> None:
        for i, ids in zip(chunk, self._plain([texts[i] for i in chunk])):
            out[i] = ids


def coder_of(path: str) -> CachedTokenizer:
    """One tokenizer for all tasks that a Python worker runs, so its words stay known."""
    return kept(("tokenizer", path), lambda: CachedTokenizer(path))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, followed by ``end_id``, into pieces of at most ``limit``.

    Returns ``doc_id, piece, start, length, ids_crc32`` and, ``with_ids``, the ids as
    bytes. A null text counts as empty and gives the end id alone; a null id stays null;
    repeated rows give repeated pieces. Only the two named columns are read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = coder_of(tokenizer), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    own = ids[at:at + 4 * limit]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own)[:5 + with_ids])
            cols = list(zip(*rows)) if rows else [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(cols)])
        give_back()

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return plain.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Bin of each item by best-fit decreasing; bins by free room are kept in a bit set."""
    bins = np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    mask, made = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + n
            own = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, own = limit, made
            made += 1
        bins[i] = own
        room -= n
        if room:
            by_room.setdefault(room, []).append(own)
            mask |= 1 << room
    return bins


def empty_bins(lengths: np.ndarray, bins: np.ndarray, limit: int, patience: int = 64) -> np.ndarray:
    """Local search among underfull bins, emptiest first, until bins empty.

    For the emptiest bin it moves a document to the fullest bin with room; else it
    exchanges one document for a shorter one of another bin, or two documents for one, so
    that the other bin gains. Every step makes the sum of squared fills larger, so the
    search ends; a bin that cannot be emptied within ``patience`` steps stays as it is.
    """
    bins = bins.copy()
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, lengths, n_bins).astype(np.int64)
    open_items = np.flatnonzero(fill[bins] < limit)
    members: dict[int, set[int]] = {}
    for i in open_items.tolist():
        members.setdefault(int(bins[i]), set()).add(i)
    size = lengths[open_items]
    for target in sorted(members, key=lambda b: (int(fill[b]), b)):
        if n_bins * limit - int(lengths.sum()) < limit or len(members) < 2:
            break
        for _ in range(patience):
            own = sorted(members[target], key=lambda i: -int(lengths[i]))
            if not own:
                break
            where = bins[open_items]
            room = np.where(where == target, -1, limit - fill[where])
            step = None
            for i in own:
                fits = np.flatnonzero((room >= lengths[i]) & (fill[where] >= fill[target] - lengths[i]) & (fill[where] > 0))
                if len(fits):
                    step = ([i], [], int(where[fits[np.argmin(room[fits])]]))
                    break
            if step is None:
                best = 0
                tries = [[i] for i in own[:16]] + [[i, j] for k, i in enumerate(own[:8]) for j in own[k + 1:8]]
                for given in tries:
                    gain = int(lengths[given].sum()) - size
                    gain = np.where((gain > 0) & (gain <= room) & (fill[where] >= fill[target] - gain), gain, 0)
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, step = int(gain[k]), (given, [int(open_items[k])], int(where[k]))
            if step is None:
                break
            given, taken, other = step
            for i in given:
                bins[i] = other
            for i in taken:
                bins[i] = target
            members[target] = members[target].difference(given).union(taken)
            members[other] = members[other].difference(taken).union(given)
            moved = int(lengths[given].sum() - lengths[taken].sum())
            fill[other] += moved
            fill[target] -= moved
        if not members[target]:
            del members[target]
    return bins


def _packer(limit: int, columns: list[str]):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = shard["length"].to_numpy(np.int64)
        whole = lengths == limit
        bins = np.full(len(shard), -1, dtype=np.int64)
        bins[~whole] = empty_bins(lengths[~whole], best_fit(lengths[~whole], limit), limit)
        bins[whole] = np.arange(whole.sum()) + bins.max(initial=-1) + 1
        order = np.argsort(bins, kind="stable")
        shard, lengths, bins = shard.iloc[order], lengths[order], bins[order]
        before = np.cumsum(lengths) - lengths
        first = np.r_[True, bins[1:] != bins[:-1]] if len(bins) else np.zeros(0, bool)
        shard["offset"] = before - before[first][np.cumsum(first) - 1] if len(bins) else before
        shard["fill"] = np.bincount(bins, lengths)[bins].astype(np.int64) if len(bins) else lengths
        shard["sequence_id"] = shard["_shard"].to_numpy(np.int64) * (1 << 24) + bins
        return shard[columns]

    return pack


def pack_pieces(pieces: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """Give pieces a place: the input's columns, ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash into shards of about ``shard`` pieces, each packed on its
    own by best fit and the local search. A shard fills its bins but for a few; the pieces
    of bins under nine tenths are dealt anew and packed together, so at most one bin in
    several thousand is underfull because of the dealing. Needs ``doc_id, piece, length,
    ids_crc32``; an empty table gives an empty table. ``sequence_id`` is unique, no more.
    """
    names = pieces.columns
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    columns = [*names, "sequence_id", "offset", "fill"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in columns)

    def dealt(df: DataFrame, first: int, seed: int) -> tuple[DataFrame, int]:
        n = partitions_for(df.count(), shard)
        by = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(seed)), F.lit(n)) + first
        return df.withColumn("_shard", by).groupBy("_shard").applyInPandas(_packer(limit, columns), schema), n

    once, n = dealt(pieces, 0, 1)
    once = stored(once)
    loose = once.where(F.col("fill") < limit * 0.9).select(*names)
    again, _ = dealt(loose, n, 2)
    return once.where(F.col("fill") >= limit * 0.9).unionByName(again).drop("fill")


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Tokenise whole documents once, cut them into pieces and pack the pieces."""
    return pack_pieces(stored(token_pieces(docs, tokenizer, limit=limit, with_ids=with_ids)), limit)
