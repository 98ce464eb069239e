"""Chat formatting: records of many layouts to canonical turns, one template, and back.

A record's layout is known by the hash of its nested field paths. Each known hash selects
a declarative mapping; an unknown one is told, not guessed. The template marks turns with
control strings, and escapes those strings inside texts so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Where turns lie: ``each`` names a list of turns with a role and a text field, else
    ``fields`` gives (role, field, ...) in order; several fields of a turn are joined by a blank line."""

    paths: frozenset[str]
    each: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, ...], ...] = ()


def field_paths(value: Any, at: str = "") -> set[str]:
    """Paths of all leaves; list items share one path. Nulls and order do not matter."""
    if isinstance(value, dict):
        return set().union(*[field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()])
    if isinstance(value, list):
        return set().union(*[field_paths(v, at + "[]") for v in value]) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


LAYOUTS = (
    Layout(frozenset({"role", "text"}), "", "role", "text"),
    Layout(frozenset({"messages[].role", "messages[].content"}), "messages", "role", "content"),
    Layout(frozenset({"messages[].role", "messages[].content[].text"}), "messages", "role", "content"),
    Layout(frozenset({"conversations[].from", "conversations[].value"}), "conversations", "from", "value"),
    Layout(frozenset({"turns[].speaker", "turns[].text"}), "turns", "speaker", "text"),
    Layout(frozenset({"prompt", "completion"}), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(frozenset({"prompt", "response"}), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(frozenset({"system", "prompt", "response"}), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(frozenset({"question", "answer"}), fields=(("user", "question"), ("assistant", "answer"))),
    Layout(frozenset({"instruction", "output"}), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(frozenset({"instruction", "input", "output"}), fields=(("user", "instruction", "input"), ("assistant", "output"))),
)

#: Fingerprints that a worker remembers; others are matched each time.
REMEMBERED = 10_000

#: Other names of the three roles; any other role is kept as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(paths: set[str], mark: str, layouts: dict[str, Layout | None]) -> Layout | None:
    """The mapping of a fingerprint; one met for the first time gets the layout that asks most of its paths.

    Paths that no layout asks for, such as an id or a source, do not matter. Two layouts
    that ask equally much leave it without one. ``layouts`` remembers the answer.
    """
    if mark not in layouts:
        fitting = sorted({x for x in layouts.values() if x and x.paths <= paths}, key=lambda x: -len(x.paths))
        clear = fitting and (len(fitting) == 1 or len(fitting[0].paths) > len(fitting[1].paths))
        if len(layouts) >= REMEMBERED:
            return fitting[0] if clear else None
        layouts[mark] = fitting[0] if clear else None
    return layouts[mark]


def word(x: Any) -> str:
    """A field as text; of a list of content parts their texts, a line each."""
    if isinstance(x, list) and x and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in x):
        return "\n".join(p["text"] for p in x)
    return x if isinstance(x, str) else "" if x is None else json.dumps(x)


def turns_of(record: Any, layouts: dict[str, Layout | None], aliases: dict[str, str]) -> list[tuple[str, str]] | None:
    """(role, text) of a parsed record; None if no mapping has its layout."""
    paths = field_paths(record)
    layout = layout_of(paths, fingerprint(paths), layouts)
    if layout is None:
        return None
    if layout.fields:
        return [(role, "\n\n".join(t for t in (word(record.get(f)) for f in names) if t or len(names) == 1)) for role, *names in layout.fields]
    items = record[layout.each] if layout.each else [record]
    return [(aliases.get(word(x.get(layout.role)), word(x.get(layout.role))), word(x.get(layout.text))) for x in items]


def canonical_turns(records: DataFrame, key: str, order: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS,
                    aliases: dict[str, str] | None = None) -> DataFrame:
    """``key, order, turn, role, text, layout, record`` from a column of JSON records.

    A record may be one turn or a whole conversation; ``turn`` counts within it. Layouts
    match by the paths they ask for; others may stand beside them. A null, broken or
    unknown record gives one row with null role and text, the record itself and its layout's
    hash (null if it cannot be parsed): ``rejected`` gives these, ``format_turns`` leaves
    them out. Null texts and roles count as empty; an empty table gives no rows.
    """
    by = {fingerprint(x.paths): x for x in layouts}
    aliases = ROLES if aliases is None else aliases

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, o, raw in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    parsed = json.loads(raw) if raw is not None else None
                except ValueError:
                    parsed = None
                mark = fingerprint(field_paths(parsed)) if isinstance(parsed, dict) else None
                turns = turns_of(parsed, by, aliases) if mark else None
                rows += [(k, o, i, role, text, mark, None) for i, (role, text) in enumerate(turns)] if turns is not None else [(k, o, 0, None, None, mark, raw)]
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "order", "turn", "role", "text", "layout", "record"])

    return records.select(F.col(key).cast("long"), F.col(order).cast("long"), record).mapInArrow(
        read, "key long, order long, turn long, role string, text string, layout string, record string")


def rejected(turns: DataFrame) -> DataFrame:
    """``key, order, record, layout`` of the records that no mapping takes; they are in no formatted text."""
    return turns.where("role IS NULL").select("key", "order", "record", "layout")


#: Control strings of the template.
BEGIN, END, SYSTEM, SYSTEM_END, ANSWER, ANSWER_END, OTHER, OTHER_END = (
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[TURN]", "[/TURN]")

_PLAIN = re.compile(r"([\[<])(\\*)(?=/?INST\]|<SYS>>|</SYS>>|/?s>|/?TURN\])")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(?=/?INST\]|<SYS>>|</SYS>>|/?s>|/?TURN\])")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]|<<SYS>>\n(.*?)\n<</SYS>>|<s> (.*?) </s>|\[TURN\](.*?)\n(.*?)\[/TURN\]", re.S)


def escape(text: str) -> str:
    """One backslash more after the first character of whatever looks like a control string."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn and the part of it, in code points, that is trained on."""
    own = escape(text)
    if role == "user":
        return f"{BEGIN} {own} {END}", 0, 0
    if role == "system":
        return f"{SYSTEM}\n{own}\n{SYSTEM_END}", 0, 0
    if role == "assistant":
        return f"{ANSWER} {own} {ANSWER_END}", len(ANSWER) + 1, len(ANSWER) + 1 + len(own)
    return f"{OTHER}{escape(json.dumps(role, ensure_ascii=False))}\n{own}{OTHER_END}", 0, 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    out = []
    for m in _TURN.finditer(formatted):
        if m[1] is not None:
            out.append(("user", unescape(m[1])))
        elif m[2] is not None:
            out.append(("system", unescape(m[2])))
        elif m[3] is not None:
            out.append(("assistant", unescape(m[3])))
        else:
            out.append((json.loads(unescape(m[4])), unescape(m[5])))
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """``key, order, turn, formatted, mask_from, mask_to``: one marked turn per row.

    A conversation is its turns in order with nothing between, so it may be longer than
    a task could hold; the mask is the trained part of the row's own text. Rows without a
    role are records that were not understood and are left out; a null text counts as empty.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r or "", t or "") for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            cols = list(zip(*made)) if made else [()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                                             ["key", "order", "turn", "formatted", "mask_from", "mask_to"])

    return turns.where("role IS NOT NULL").select("key", "order", "turn", "role", "text").mapInArrow(
        mark, "key long, order long, turn long, formatted string, mask_from long, mask_to long")


def read_back(formatted: DataFrame) -> DataFrame:
    """``key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` from the formatted rows.

    Rows are dealt by conversation and sorted, and a task keeps running digests only, so a
    conversation may have any number of turns. Rows of equal order follow their texts.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None
        key, out = None, []

        def done() -> tuple:
            return (key, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4])

        for b in batches:
            for k, text, a, z in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if own is None or k != key:
                    if own is not None:
                        out.append(done())
                    key, own = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own[4] += len(text)
                for role, said in parse(text):
                    own[0] += 1
                    own[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if z > a:
                    learnt = unescape(text[a:z])
                    own[2] += len(learnt)
                    own[3].update(learnt.encode("utf-8", "surrogatepass"))
            if len(out) > 5000:
                yield packed(out)
                out = []
        if own is not None:
            out.append(done())
        yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    # a null key is a conversation of its own
    return formatted.repartition("key").sortWithinPartitions("key", "order", "turn", "formatted").mapInArrow(
        digest, "key long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
