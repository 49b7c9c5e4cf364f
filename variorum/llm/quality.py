"""Quality rules: how much of a text is repeated, from rolling hashes of several n-gram lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from variorum.llm.tables import in_batches, texts
from variorum.llm.words import SPACES, Numbering, mixed, rolling

#: n-gram length: largest share of a text's word characters that may lie in n-grams of that length that
#: occur twice or more (fixed values, the published repetition rules for web text).
NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of a text's lines, and of its word characters, that may repeat an earlier line.
LINE_SHARE = 0.30
LINE_CHAR_SHARE = 0.20
#: The base rules.
MIN_WORDS = 20
WINDOW = 8
WINDOW_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Words that are worked on at once; one longer text is a block by itself.
BLOCK_WORDS = 400_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in NGRAM_SHARES)
    + ", base_failed boolean, kept boolean"
)
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_runs(ids: np.ndarray, owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run of `n` words that its text has twice or more; the first run counts too.

    `owner` numbers the text of each word. Equal hashes are confirmed on the words themselves.
    """
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(ids) < n:
        return covered[:-1].astype(bool)
    inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
    found = mixed(rolling(hashes, n) + owner[: len(inside)].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    found[~inside] = 0
    order = np.sort(found)
    twice = order[1:][(order[1:] == order[:-1]) & (order[1:] != 0)]
    if len(twice):
        at = np.searchsorted(twice, found)
        at[at == len(twice)] = 0
        starts = np.flatnonzero((twice[at] == found) & inside)
        starts = starts[np.lexsort((starts, found[starts]))]
        same = np.flatnonzero(found[starts[1:]] == found[starts[:-1]])
        equal = np.ones(len(same), bool)
        for k in range(n):
            equal &= ids[starts[same] + k] == ids[starts[same + 1] + k]
        same = same[equal]
        starts = np.unique(np.concatenate([starts[same], starts[same + 1]]))
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + n, -1)
    return np.cumsum(covered[:-1]) > 0


def line_repeats(text: bytes) -> tuple[int, int, int]:
    """Lines with a word, those of them equal to an earlier one, and the word characters of the latter."""
    if b"\n" not in text:
        return int(bool(text.strip(SPACES))), 0, 0
    seen: set[bytes] = set()
    lines = repeats = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines, repeats, chars = lines + 1, repeats + 1, chars + code_points(line)
        elif line.strip(SPACES):
            lines += 1
            seen.add(line)
    return lines, repeats, chars


def code_points(text: bytes) -> int:
    """Characters of UTF-8 other than white space."""
    return len(text.translate(None, SPACES + _CONTINUATION))


def measure(block: list[tuple[int | None, bytes, list[bytes]]]) -> list[list]:
    """Columns of SCHEMA for the texts of one block."""
    numbers = Numbering()
    ids = numbers.ids([w for _, _, words in block for w in words])
    lengths, hashes = numbers.lengths()[ids], numbers.hashes()[ids]
    counts = np.array([len(words) for _, _, words in block], np.int64)
    owner = np.repeat(np.arange(len(block)), counts)
    chars = np.bincount(owner, lengths, len(block)).astype(np.int64)
    lines = np.array([line_repeats(text) for _, text, _ in block], np.int64).reshape(-1, 3)
    base = np.bincount(owner, repeated_runs(ids, owner, hashes, WINDOW), len(block)).astype(np.int64)
    dup_chars = {
        n: np.bincount(owner, lengths * repeated_runs(ids, owner, hashes, n), len(block)).astype(np.int64)
        for n in NGRAM_SHARES
    }
    failed = (counts < MIN_WORDS) | (100 * base > WINDOW_PERCENT * counts)
    bad = (lines[:, 1] > LINE_SHARE * lines[:, 0]) | (lines[:, 2] > LINE_CHAR_SHARE * chars)
    for n, share in NGRAM_SHARES.items():
        bad |= dup_chars[n] > share * chars
    symbols = [len(text) - len(text.translate(None, SYMBOLS)) for _, text, _ in block]
    return [
        [doc for doc, _, _ in block], counts, chars, symbols, lines[:, 1], base, lines[:, 2],
        *dup_chars.values(), failed, ~failed & ~bad,
    ]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts of words, symbols and repeats, and the verdict `kept`.

    base_failed: under 20 words, or over 30 percent of the words in 8-word windows that the text has
    twice or more. kept: not base_failed, and the characters inside repeated n-grams of each length and
    inside repeated lines are within the limits above. A null or empty text has no words and fails;
    repeated rows are judged alike. No shuffle; a task holds one Arrow batch and one block of words.

    Repeated rows and null ids count as rows; no rows give no rows.
    """

    def make():
        np.seterr(over="ignore")

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            block, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py()
                words = text.split()
                if block and size + len(words) > BLOCK_WORDS:
                    yield measure(block)
                    block, size = [], 0
                block.append((doc, text, words))
                size += len(words)
            yield measure(block)

        return work

    return in_batches(texts(docs, id_col, text_col), SCHEMA, make)
