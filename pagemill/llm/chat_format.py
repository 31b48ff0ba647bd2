"""Chat formatting: turns become one string per turn under a template, with the text to learn from marked.

A batch of turns is assembled as columns: the lengths of all segments, their running offsets, and scatter indices by
which role and text bytes are copied into one buffer that was allocated once and becomes the Arrow column. No turn
needs another one, so nothing is shuffled; a conversation is its turns in the order of (turn, role, text).

Template of a turn: START role NEWLINE text END. Inside roles and texts every `<|` with any number of backslashes
between gets one more backslash, so that no control string can stand there, and reading takes it off again; a line
break in a role is then written as a control string of its own.

Null roles and texts are empty. Repeated rows are turns of their own. Null conversation ids are one conversation, and
null turns come first. Columns beyond the named ones are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, string_bytes

START, BREAK, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED_ROLE = "assistant"
#: A line break in a role; `<|` is escaped first, so no role holds it by itself.
ROLE_BREAK = "<|br|>"
BATCH_BYTES = 8 << 20

FORMATTED = "conv_id bigint, turn bigint, formatted string, loss_start int, loss_chars int"
READ = "conv_id bigint, turn bigint, role string, text string, loss string, formatted_chars bigint"


def _escaped(texts: pa.Array) -> pa.Array:
    if not pc.any(pc.match_substring_regex(texts, r"<\\*\|"), min_count=0).as_py():
        return texts
    return pc.replace_substring_regex(texts, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _roles(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(_escaped(roles), pattern="\n", replacement=ROLE_BREAK)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray) -> None:
    """Copies row k of `data` (from starts[k] to starts[k + 1]) to out[at[k]:]."""
    out[np.arange(len(data)) + np.repeat(at - starts[:-1], np.diff(starts))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns, and for each where its text starts and how long it is, in characters."""
    roles, texts = _roles(roles.fill_null("")), _escaped(texts.fill_null(""))
    role_data, role_starts = string_bytes(roles)
    text_data, text_starts = string_bytes(texts)
    role_size, text_size = np.diff(role_starts), np.diff(text_starts)
    fixed = len(START) + len(BREAK) + len(END)
    ends = np.cumsum(fixed + role_size + text_size)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    out = np.empty(int(offsets[-1]), np.uint8)
    role_at = offsets[:-1] + len(START)
    break_at = role_at + role_size
    text_at = break_at + len(BREAK)
    for piece, at in ((START, offsets[:-1]), (BREAK, break_at), (END, text_at + text_size)):
        out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    _scatter(out, role_at, role_data, role_starts)
    _scatter(out, text_at, text_data, text_starts)
    formatted = pa.LargeStringArray.from_buffers(len(roles), pa.py_buffer(offsets), pa.py_buffer(out))
    head = len(START) + pc.utf8_length(roles).to_numpy(zero_copy_only=False) + len(BREAK)
    return formatted.cast(pa.string()), head, pc.utf8_length(texts).to_numpy(zero_copy_only=False)


def format_turns(turns: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """Turns (`conv_id`, `turn`, `role`, `text`) as `formatted` strings; `loss_start` and `loss_chars` mark the text of
    turns of the `learned` role (0 characters in others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(*(pc.fill_null(pc.binary_length(batch[c]), 0) for c in ("role", "text"))).to_numpy(zero_copy_only=False)
            for first, last in slices(sizes, BATCH_BYTES):
                part = batch.slice(first, last - first)
                formatted, start, length = assemble(part["role"], part["text"])
                mask = pc.equal(part["role"].fill_null(""), learned).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [part["conv_id"], part["turn"], formatted, pa.array(start, pa.int32()), pa.array(np.where(mask, length, 0), pa.int32())],
                    ["conv_id", "turn", "formatted", "loss_start", "loss_chars"],
                )

    named = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role"), F.col("text"))
    return named.mapInArrow(run, FORMATTED)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, rest = formatted.removeprefix(START.decode()).partition("\n")
    return unescaped(role.replace(ROLE_BREAK, "\n")), unescaped(rest.removesuffix(END.decode()))


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns that formatted strings stand for; `loss` is the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            read = [read_turn(t) for t in rows["formatted"]]
            spans = zip(rows["formatted"], rows["loss_start"], rows["loss_chars"], strict=True)
            columns = [rows["conv_id"], rows["turn"], [r for r, _ in read], [t for _, t in read]]
            columns += [[unescaped(t[s : s + n]) for t, s, n in spans], [len(t) for t in rows["formatted"]]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)],
                ["conv_id", "turn", "role", "text", "loss", "formatted_chars"],
            )

    return formatted.mapInArrow(run, READ)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of `read_turns`: digests of its turns and of its learned text, in order.

    The turns of a conversation come as a sorted stream, of which a task holds one batch, so a conversation may be of
    any length. A digest is sequential: one task reads the whole of a conversation, whatever its share of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id: object = run  # no conversation yet
        counts, whole, learned, done = [0, 0, 0], hashlib.sha256(), hashlib.sha256(), []

        def close() -> None:
            if open_id is not run:
                done.append((open_id, counts[0], whole.hexdigest(), counts[1], learned.hexdigest(), counts[2]))

        def result() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = batch.to_pydict()
            for conv, role, text, loss, size in zip(*(rows[c] for c in ("conv_id", "role", "text", "loss", "formatted_chars")), strict=True):
                if open_id is run or conv != open_id:
                    close()
                    open_id, counts, whole, learned = conv, [0, 0, 0], hashlib.sha256(), hashlib.sha256()
                counts = [counts[0] + 1, counts[1] + len(loss), counts[2] + size]
                whole.update(f"{role}\n{text}\n".encode())
                learned.update(loss.encode())
            yield result()
            done.clear()
        close()
        yield result()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss", "formatted_chars").mapInArrow(run, DIGEST)
