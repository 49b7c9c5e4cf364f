"""Chat formatting: whole batches of conversations assembled column by column into one Arrow buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.tables import in_batches

#: A turn is OPEN, its role, a line feed, its text and CLOSE.
OPEN = b"<|im_start|>"
BREAK = b"\n"
CLOSE = b"<|im_end|>\n"
#: Strings that must not stand in a formatted text other than by the template: its own marks, and those
#: of other common templates (fixed values). In texts and roles a backslash goes behind the first letter.
CONTROL = (b"<|", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>")
ASSISTANT = "assistant"
#: Bytes that are scattered at once.
BLOCK = 1 << 20

FORMATTED = "conv_id long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)

# A control string, or one with backslashes behind its first letter: each gets one backslash more.
_ESCAPE = re.compile(b"|".join(re.escape(c[:1]) + rb"(?=\\*" + re.escape(c[1:]) + b")" for c in CONTROL))
_UNESCAPE = re.compile(
    b"|".join(b"(?<=" + re.escape(c[:1]) + rb")\\(?=\\*" + re.escape(c[1:]) + b")" for c in CONTROL)
)
_TURN = re.compile(re.escape(OPEN) + b"(.*?)" + BREAK + b"(.*?)" + re.escape(CLOSE), re.S)


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(b"", text)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; no copy, nulls are not expected."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in `data` behind which a backslash goes."""
    held = data.tobytes()
    at = np.array([m.start() for m in _ESCAPE.finditer(held)], np.int64)
    if not len(at):
        return at
    end = offsets[np.searchsorted(offsets, at, "right")]
    # Looked at again within its row alone: the match may have used letters of the next row.
    return at[[_ESCAPE.match(held, a, e) is not None for a, e in zip(at.tolist(), end.tolist())]]


def scatter(out: np.ndarray, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, gaps: np.ndarray) -> None:
    """Copy row i of `data` to out[starts[i]:], leaving one byte free behind each place of `gaps`."""
    for low in range(0, len(data), BLOCK):
        at = np.arange(low, min(low + BLOCK, len(data)))
        row = np.searchsorted(offsets, at, "right") - 1
        shift = np.searchsorted(gaps, at) - np.searchsorted(gaps, offsets[row]) if len(gaps) else 0
        out[starts[row] + at - offsets[row] + shift] = data[at]


def assemble(roles: pa.Array, words: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations of turns; conversation i has the turns ends[i] to ends[i + 1].

    Also the first and last byte of each turn's text within its conversation. Lengths of all segments
    give their offsets, offsets give scatter indices, and each byte is copied once to its place.
    """
    role_data, role_at = flat(roles)
    text_data, text_at = flat(words)
    gaps = escapes(text_data, text_at)
    extra = np.bincount(np.searchsorted(text_at, gaps, "right") - 1, minlength=len(words)) if len(gaps) else 0
    sizes = np.empty((len(words), 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(OPEN), len(BREAK), len(CLOSE)
    role_gaps = escapes(role_data, role_at)
    role_extra = np.bincount(np.searchsorted(role_at, role_gaps, "right") - 1, minlength=len(roles)) if len(role_gaps) else 0
    sizes[:, 1], sizes[:, 3] = np.diff(role_at) + role_extra, np.diff(text_at) + extra
    edges = np.concatenate([[0], np.cumsum(sizes)])
    starts = edges[:-1].reshape(-1, 5)
    out = np.full(edges[-1], ord("\\"), np.uint8)  # what no segment fills are the escapes
    for k, mark in ((0, OPEN), (2, BREAK), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    scatter(out, role_data, role_at, starts[:, 1], role_gaps)
    scatter(out, text_data, text_at, starts[:, 3], gaps)
    bounds = edges[5 * ends]
    formatted = pa.StringArray.from_buffers(
        len(ends) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)
    )
    first = starts[:, 3] - np.repeat(bounds[:-1], np.diff(ends))
    return formatted, first, first + sizes[:, 3]


def blocks(ends: np.ndarray, sizes: np.ndarray, limit: int = 16 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole conversations of about `limit` bytes; one that is longer comes alone."""
    start = held = 0
    totals = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(ends) - 1):
        size = totals[ends[i + 1]] - totals[ends[i]]
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(ends) > 1:
        yield start, len(ends) - 1


def turns_in_order(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id and its turns as one array of (turn, role, text). Nulls are empty; equal turns go by role and text.

    In roles, a backslash and a line feed are written as backslash and letter, as a role is one line.
    """
    c = conversations
    plain = F.coalesce(c[role].cast("string"), F.lit(""))
    one_line = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    rows = c.select(
        c[conv].cast("long").alias("conv_id"),
        F.struct(
            c[turn].cast("long").alias("turn"),
            one_line.alias("role"),
            F.coalesce(c[text].cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def format_chats(conversations: DataFrame, **names: str) -> DataFrame:
    """FORMATTED: one row for each conversation, and where its loss mask lies in the bytes of the text.

    The mask covers the assistant's texts and nothing of the template. A null conv_id is a conversation of
    its own; repeated rows are repeated turns; no rows give no conversations. A conversation is one value
    and so is held whole (Spark's limit of 2 GB for a value holds); nothing larger is.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            turns = batch.column(1)
            all_ends = np.asarray(turns.offsets).astype(np.int64)
            rows = turns.values
            roles, words = rows.field("role"), rows.field("text")
            sizes = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1])
            for a, b in blocks(all_ends, sizes.astype(np.int64)):
                low, high = int(all_ends[a]), int(all_ends[b])
                own_roles, own_words = roles.slice(low, high - low), words.slice(low, high - low)
                ends = all_ends[a : b + 1] - low
                formatted, first, last = assemble(own_roles, own_words, ends)
                learnt = np.array([r == ASSISTANT for r in own_roles.to_pylist()], bool)
                counts = np.concatenate([[0], np.cumsum(learnt)])[ends]
                lists = pa.array(counts, pa.int32())
                yield [
                    batch.column(0).slice(a, b - a), np.diff(ends), formatted,
                    pa.ListArray.from_arrays(lists, pa.array(first[learnt])),
                    pa.ListArray.from_arrays(lists, pa.array(last[learnt])),
                ]

        return work

    return in_batches(turns_in_order(conversations, **names), FORMATTED, make)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts of a formatted conversation as they were before formatting."""
    for found in _TURN.finditer(formatted):
        role = re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(found[1]))
        yield role, unescape(found[2])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """DIGESTS, all read back from formatted conversations and their masks."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[list]:
            rows = []
            for conv, text, starts, ends in zip(
                batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ):
                whole = text.as_py()
                held = whole.encode("utf-8")
                turns, count = hashlib.sha256(), 0
                for role, words in read_turns(held):
                    turns.update(b"%b\n%b\n" % (role, words))
                    count += 1
                learnt = b"".join(unescape(held[a:b]) for a, b in zip(starts, ends))
                rows.append(
                    (
                        conv, count, turns.hexdigest(), len(learnt.decode("utf-8")),
                        hashlib.sha256(learnt).hexdigest(), len(whole),
                    )
                )
            yield list(map(list, zip(*rows)))

        return work

    return in_batches(formatted, DIGESTS, make)
