"""Removal of passages that repeat across documents, located by Aho-Corasick automata.

1. Every document's phrases (16 words) are hashed; each window of 50 words selects its
   phrase of least hash, so equal windows select equal phrases wherever they stand.
   Phrases selected in two documents or more are confirmed.
2. Documents are dealt into shards, and with them the confirmed phrases of that shard. A
   shard compiles automata over the words of its phrases and streams its documents through
   them; the occurrences found mark the windows that may recur. A run is a stretch of
   windows that select one occurrence.
3. Equal runs settle each other by the smallest id. Only runs that share a phrase but
   differ are compared window by window.
4. The documents drop the words of all covered windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import LAST_ID, drop_stored, id_or_last, partitions_for, stored

#: Words of a window and of a phrase.
WINDOW, PHRASE = 50, 16

#: Selected phrases of one partition's documents; text in characters that one automaton serves.
EACH, SERVED = 100_000, 4_000_000

_POSITION = 26


def _windows(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each phrase, and for each window the place of the phrase it selects."""
    import xxhash

    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - phrase + 1
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(phrase):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[j:j + n]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    place = np.uint64((1 << _POSITION) - 1)
    least = (mixed & ~place) | np.arange(n, dtype=np.uint64)  # the first of equal phrases
    span, have = window - phrase + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[:len(least) - (span - have)], least[span - have:])
    return mixed.view(np.int64), (least & place).astype(np.int64)


def _runs(selected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each stretch that selects one place."""
    first = np.flatnonzero(np.r_[True, selected[1:] != selected[:-1]])
    return first, np.diff(np.r_[first, len(selected)])


def _selected_phrases(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) >= window:
                    mixed, selected = _windows(words, window, phrase)
                    own = np.unique(mixed[np.unique(selected)])
                    hashes.append(own)
                    docs.append(np.full(len(own), doc, dtype=np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(docs))], ["phrase", "doc"])

    return rows.select("doc", "text").mapInArrow(select, "phrase long, doc long")


def _locate(window: int, phrase: int, served: int):
    """Stream shards (confirmed phrases, then documents) to the runs that may recur."""
    import ahocorasick
    import xxhash

    def automaton(phrases: set[tuple[bytes, ...]]):
        numbers: dict[bytes, int] = {}
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in phrases:
            built.add_word(tuple([numbers.setdefault(w, len(numbers) + 1) for w in p]), 1)
        built.make_automaton()
        return built, numbers

    def settle(group: list[tuple], confirmed: np.ndarray) -> Iterator[tuple]:
        made, phrases = [], set()
        for doc, tid, words in group:
            mixed, selected = _windows(words, window, phrase)
            first, count = _runs(selected)
            at = selected[first]
            own = mixed[at]
            known = confirmed[np.minimum(np.searchsorted(confirmed, own), len(confirmed) - 1)] == own
            if known.any():
                phrases.update(tuple(words[i:i + phrase]) for i in at[known].tolist())
                made.append((doc, tid, words, mixed, first, count, at))
        if not phrases:
            return
        found, numbers = automaton(phrases)
        for doc, tid, words, mixed, first, count, at in made:
            hit = np.zeros(len(mixed), dtype=bool)
            ends = [end for end, _ in found.iter(tuple([numbers.get(w, 0) for w in words]))]
            hit[np.array(ends, dtype=np.int64) - (phrase - 1)] = True
            line = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts, stops = np.r_[0, ends[:-1]].tolist(), (ends - 1).tolist()
            for i in np.flatnonzero(hit[at]).tolist():
                s, n = int(first[i]), int(count[i])
                whole = xxhash.xxh3_128_digest(line[starts[s]:stops[s + n + window - 2]])
                each = [xxhash.xxh3_64_intdigest(line[starts[j]:stops[j + window - 1]]) for j in range(s, s + n)]
                yield int(mixed[at[i]]), whole, doc, tid, s, n, np.array(each, dtype="<u8").tobytes()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        cols = list(zip(*rows)) if rows else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["phrase", "run", "doc", "tid", "start", "n", "windows"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, heard, confirmed, group, size, out = None, [], np.zeros(0, np.int64), [], 0, []
        for batch in batches:
            shards, kinds = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                if shards[k] != shard or size >= served:
                    out += settle(group, confirmed)
                    group, size = [], 0
                    if shards[k] != shard:
                        shard, heard, confirmed = shards[k], [], np.zeros(0, np.int64)
                if kinds[k] == 0:
                    heard.append(batch.column(2)[k].as_py())
                    continue
                if heard:
                    confirmed, heard = np.sort(np.array(heard, dtype=np.int64)), []
                if len(confirmed):
                    text = batch.column(4)[k].as_py()
                    words = text.encode("utf-8", "surrogatepass").split()
                    if len(words) >= window:
                        group.append((batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), words))
                        size += len(text)
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
        out += settle(group, confirmed)
        yield packed(out)

    return stream


def repeated_ranges(rows: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc, tid, ranges``: the covered words ``[from, to)`` of every document that has some.

    ``rows`` has ``doc`` (an orderable id), ``tid`` (a hash of the text) and ``text``.
    """
    heard = stored(_selected_phrases(rows, window, phrase))
    again = heard.groupBy("phrase").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("phrase")
    parts = partitions_for(heard.count(), EACH)
    shard = F.pmod(F.xxhash64("doc", F.lit(17)), F.lit(4 * parts))
    wanted = heard.join(again, "phrase", "left_semi").select(shard.alias("shard"), "phrase").distinct()
    none = F.lit(None).cast("string")
    mixed = wanted.select("shard", F.lit(0).alias("kind"), F.col("phrase").alias("doc"), F.lit(0).cast("long").alias("tid"), none.alias("text")).union(
        rows.select(shard.alias("shard"), F.lit(1).alias("kind"), "doc", "tid", "text"))
    runs = stored(mixed.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(
        _locate(window, phrase, SERVED), "phrase long, run binary, doc long, tid long, start int, n int, windows binary"))
    drop_stored(heard)

    key = ["phrase", "run"]
    first = stored(runs.groupBy(*key).agg(F.min("doc").alias("least")))
    whole = runs.select(*key, "doc", "tid", "start", "n").join(first, key).where("doc > least").select(
        "doc", "tid", F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n") + window - 1).alias("to")).alias("r"))

    # runs that differ around one phrase: the first holder of each is compared by windows
    several = first.groupBy("phrase").agg(F.count("*").alias("c")).where("c > 1").select("phrase")
    held = first.join(several, "phrase", "left_semi").withColumnRenamed("least", "doc")
    part = runs.join(held, [*key, "doc"], "left_semi").select(
        "phrase", "doc", "tid", "start", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(
            F.col("windows"), (i * 8 + 1).cast("int"), F.lit(8)))).alias("i", "w"))
    part = stored(part.select("phrase", "w", "doc", "tid", (F.col("start") + F.col("i")).alias("at")))
    earliest = part.groupBy("phrase", "w").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    single = part.join(earliest, ["phrase", "w"]).where("doc > least").select(
        "doc", "tid", F.struct(F.col("at").alias("from"), (F.col("at") + window).alias("to")).alias("r"))
    return whole.union(single).groupBy("doc", "tid").agg(F.collect_list("r").alias("ranges"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` of every row.

    A window of ``window`` words that also starts in a document of smaller id covers its
    words; covered words go, the others are joined by one space. Windows are judged on the
    input. Null texts count as empty; shorter texts have no window. Rows of one id never
    cover each other; rows without an id come last and cover nothing among themselves.
    """
    rows = docs.select(id_or_last(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn(
        "tid", F.xxhash64("text"))
    ranges = repeated_ranges(rows, window, min(PHRASE, window))
    met = rows.join(ranges, ["doc", "tid"], "left").select("doc", "text", F.col("ranges.from").alias("a"), F.col("ranges.to").alias("b"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, gone, kept = [], [], []
            for text, a, b in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                totals.append(len(words))
                if not a.is_valid:
                    gone.append(0)
                else:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, a.values.to_numpy(), 1)
                    np.add.at(step, b.values.to_numpy(), -1)
                    stays = np.cumsum(step[:-1]) == 0
                    gone.append(int((~stays).sum()))
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_text"])

    out = met.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))
