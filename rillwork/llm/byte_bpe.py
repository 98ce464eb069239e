"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their boundary.

Encoded pieces of bytes form a monoid under ``join``. To join two of them, the last tokens
of the left and the first tokens of the right are re-encoded together, in windows that grow
until the outermost token on either side comes out unchanged. A token sequence is the
encoding of its bytes exactly if each two neighbouring tokens are the encoding of theirs;
inside the window that holds because it has been encoded, outside because the halves were,
and at the window's edges because the token there is still the same. So all tokens outside
are proven stable.

Texts are cut by the same rule one level up. A match of the pattern is settled by at most
two characters behind its end, so the matches of the left half that end earlier stay, and
from the first common boundary on those of the right half stay as well; only the characters
between are matched anew. Between a character and a blank after it no match and no
condition reaches across, so halves that meet there are concatenated as they are.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text that one leaf matches, bytes that one leaf merges, and remembered pieces.
LEAF, SHORT, ROOM = 8192, 32, 200_000

#: Characters behind a match that may still decide where it ends.
SETTLED = 2

#: Characters of the texts that are held at once, about.
HELD = 4 << 20


class ByteCoder:
    """Encodes and decodes by the ranks of a vocabulary file.

    ``ROOM`` pieces at most are remembered in each of two generations.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.match = regex.compile(pattern)
        self.cut = regex.compile(r"(?<=\S)(?=\s)")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # --- pieces ---

    def merged(self, piece: bytes) -> list[int]:
        """Encoding of a piece by merging, lowest rank and leftmost first."""
        ranks = self.ranks
        if len(piece) <= SHORT:
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    rank = ranks.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        # long windows: a heap of candidate merges over a linked list of parts
        n = len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i:end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of two encodings, one after the other."""
        if not left or not right:
            return left or right
        a, b, of = 1, 1, self.bytes_of
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merged(b"".join([of[t] for t in left[-a:]] + [of[t] for t in right[:b]]))
            left_stays = a == len(left) or window[0] == left[-a]
            right_stays = b == len(right) or window[-1] == right[b - 1]
            if left_stays and right_stays:
                return left[:-a] + window + right[b:]
            a, b = a if left_stays else 2 * a, b if right_stays else 2 * b

    def encode_piece(self, piece: bytes) -> list[int]:
        """Encoding of the bytes of one match: a known token, a leaf, or two halves joined."""
        if (own := self.ranks.get(piece)) is not None:
            return [own]
        if len(piece) <= SHORT:
            return self.merged(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def _ids(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self.known) >= ROOM:
                self.old, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def _leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        pieces, out, get = self.match.findall(text), [], self.known.get
        for p in pieces:
            ids = get(p)
            out.append(self._ids(p) if ids is None else ids)
        return pieces, out

    # --- texts ---

    def _join_text(self, left: tuple, right: tuple) -> tuple:
        """Join the matches of two halves whose cut may lie inside a match."""
        (lp, lo), (rp, ro) = left, right
        tail, keep = 0, len(lp)
        while keep and tail < SETTLED:
            keep -= 1
            tail += len(lp[keep])
        # the last kept match has SETTLED characters behind it; all others are matched anew
        window, ends, n = "".join(lp[keep:]), {}, 0
        base, at = len(window), len(window)
        while True:
            n = min(max(4, 2 * n), len(rp))
            window = "".join(lp[keep:]) + "".join(rp[:n])
            at, ends = base, {base: 0}
            for i, p in enumerate(rp[:n]):
                at += len(p)
                ends[at] = i + 1
            # a match counts only if enough of the window, or nothing of the text, lies behind it
            limit = len(window) if n == len(rp) else len(window) - SETTLED
            new, stop = [], None
            for m in self.match.finditer(window):
                if m.end() > limit:
                    break
                new.append(m.group())
                if m.end() in ends:
                    stop = ends[m.end()]
                    break
            if stop is not None:
                break
        middle = []
        parts = [(p, o) for p, o in zip(lp[keep:] + rp[:stop], lo[keep:] + ro[:stop])]
        for p in new:
            middle.append(self._from_parts(p, parts))
        return lp[:keep] + new + rp[stop:], lo[:keep] + middle + ro[stop:]

    def _from_parts(self, piece: str, parts: list[tuple[str, bytes]]) -> bytes:
        """Ids of a match, joined from the encoded parts it begins with and consists of, else encoded anew."""
        ids, rest = [], piece
        while parts and rest and rest.startswith(parts[0][0]):
            p, own = parts.pop(0)
            ids, rest = self.join(ids, np.frombuffer(own, "<u4").tolist()), rest[len(p):]
        if rest:
            p, own = parts.pop(0)
            ids = self.join(ids, self.encode_piece(rest.encode()))
            over = len(rest)
            while over > len(p):
                over, (p, own) = over - len(p), parts.pop(0)
            if p[over:]:
                parts.insert(0, (p[over:], np.array(self.encode_piece(p[over:].encode()), "<u4").tobytes()))
        if len(own := piece.encode()) and (whole := self.ranks.get(own)) is not None:
            ids = [whole]
        return np.array(ids, dtype="<u4").tobytes()

    def _tree(self, text: str) -> tuple[list[str], list[bytes]]:
        """Matches and ids of a text without a place where halves can simply meet."""
        if len(text) <= LEAF:
            return self._leaf(text)
        half = len(text) // 2
        return self._join_text(self._tree(text[:half]), self._tree(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if len(text) <= LEAF:
            return b"".join(self._leaf(text)[1])
        half = len(text) // 2
        m = self.cut.search(text, half) or self.cut.search(text, 1, half)
        if m is None:
            return b"".join(self._tree(text)[1])
        return self.encode(text[:m.start()]) + self.encode(text[m.start():])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of encoded ids; halves are decoded on their own and concatenated."""
        n = len(ids) // 4
        if n <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = n // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=1)
def coder_of(path: str, pattern: str) -> ByteCoder:
    """One coder for all tasks that a Python worker runs."""
    return ByteCoder(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row; ``ids`` are little-endian unsigned 32-bit numbers.

    ``ranks`` is the path of a vocabulary file that all nodes have. A null text counts as
    empty and has no ids; a null id stays null; equal rows give equal rows; an empty table
    gives no rows. Only the two named columns are read. Nothing is shuffled, so a task's
    memory holds a batch's texts and the ids of one text more.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in batches:
            start, held, out = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                out.append(coder.encode(text.as_py()))
                held += len(out[-1]) // 4
                if held >= HELD // 4 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[start:i + 1], pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                        ["doc_id", "n_tokens", "ids"])
                    start, held, out = i + 1, 0, []

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return plain.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of ``encode_documents`` with ``decoded``, the bytes their ids stand for; null ids give none."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                own = [None if x is None else coder.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], [*part.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded binary")
