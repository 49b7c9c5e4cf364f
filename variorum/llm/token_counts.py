"""Token counts that follow edits: a segment tree over the pre-tokens of each document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm.caches import Kept
from variorum.llm.packing import PATTERN, ByteBpe
from variorum.llm.tables import in_batches, texts

#: Pre-tokens in a leaf of a new tree; a leaf that edits have made CROWDED times as long has its tree built anew.
LEAF = 32
CROWDED = 8
#: Pre-tokens whose counts a worker remembers (in either of two halves).
ROOM = 300_000

TREES = "doc_id long, text string, leaf_sizes array<int>, lengths array<int>, counts array<int>, chars array<long>, tokens array<long>"
COUNTS = "doc_id long, n_tokens long, edited_tokens long, pre_tokens long, reencoded long, edited_text string"


class Counter:
    """Splits text into pre-tokens and counts the tokens of each; the strings of special tokens are ordinary text."""

    def __init__(self, path: str, room: int = ROOM) -> None:
        encode = ByteBpe(path).fast.encode_ordinary
        self.split = regex.compile(PATTERN)
        self.count = Kept(lambda piece: len(encode(piece)), room).__getitem__


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each worker process, which keeps its cache from task to task."""
    return Counter(path)


class CountTree:
    """Leaves of up to some dozens of pre-tokens, and over them, in heap order, sums of characters and tokens."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.text, self.counter, self.reencoded = text, counter, 0
        pieces = counter.split.findall(text)
        lengths, counts = list(map(len, pieces)), list(map(counter.count, pieces))
        self._grow(
            [lengths[i : i + LEAF] for i in range(0, len(lengths), LEAF)],
            [counts[i : i + LEAF] for i in range(0, len(counts), LEAF)],
        )

    @classmethod
    def stored(cls, text, leaf_sizes, lengths, counts, chars, tokens, counter: Counter) -> CountTree:
        """A tree as `columns` gave it; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.text, tree.counter, tree.reencoded, at = text, counter, 0, 0
        tree.lengths, tree.counts = [], []
        for size in leaf_sizes:
            tree.lengths.append(lengths[at : at + size])
            tree.counts.append(counts[at : at + size])
            at += size
        tree.width, tree.chars, tree.tokens = len(chars) // 2, chars, tokens
        return tree

    def columns(self) -> list:
        return [
            self.text,
            list(map(len, self.lengths)),
            [x for leaf in self.lengths for x in leaf],
            [x for leaf in self.counts for x in leaf],
            self.chars,
            self.tokens,
        ]

    def _grow(self, lengths: list[list[int]], counts: list[list[int]]) -> None:
        self.width = 1
        while self.width < len(lengths):
            self.width *= 2
        spare = [[] for _ in range(self.width - len(lengths))]
        self.lengths, self.counts = lengths + spare, counts + [[] for _ in spare]
        self.chars = [0] * self.width + list(map(sum, self.lengths))
        self.tokens = [0] * self.width + list(map(sum, self.counts))
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def size(self) -> int:
        return sum(map(len, self.lengths))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place`, and the leaf's first character."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if place >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, start: int, end: int, new: str) -> None:
        """Put `new` in place of the characters from `start` to `end`; both are moved into the text if outside.

        Encoding starts two pre-tokens before the edit: one may grow into it, and how far white space
        before that reaches depends on what follows. It stops where a boundary falls on an old one behind
        the edit, as from there on nothing that decides has changed.
        """
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        self.text = text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)

        leaf, at = self.leaf_at(max(start - 1, 0))
        k = 0
        while k < len(self.lengths[leaf]) and at + self.lengths[leaf][k] < start:
            at += self.lengths[leaf][k]
            k += 1
        leaf, k, at = self._before(leaf, k, at)

        old = self._boundaries(leaf, k, at)
        stop, old_end = (leaf, k), at
        place, lengths, counts = at, [], []
        while True:
            while old_end < place - shift or old_end < end:
                following = next(old, None)
                if following is None:
                    break
                old_end, stop = following
            if place - shift == old_end >= end or place >= len(text):
                break
            piece = self.counter.split.match(text, place).group()
            lengths.append(len(piece))
            counts.append(self.counter.count(piece))
            place += len(piece)
        if place >= len(text):
            stop = (len(self.lengths) - 1, len(self.lengths[-1]))
        self.reencoded += len(lengths)
        self._replace((leaf, k), stop, lengths, counts)

    def _before(self, leaf: int, k: int, at: int) -> tuple[int, int, int]:
        """One pre-token back."""
        if k:
            return leaf, k - 1, at - self.lengths[leaf][k - 1]
        for i in range(leaf - 1, -1, -1):
            if self.lengths[i]:
                return i, len(self.lengths[i]) - 1, at - self.lengths[i][-1]
        return leaf, k, at

    def _boundaries(self, leaf: int, k: int, at: int) -> Iterator[tuple[int, tuple[int, int]]]:
        """Ends of the pre-tokens from (leaf, k) on, in the old text, each with the place of the next one."""
        for i in range(leaf, len(self.lengths)):
            for j in range(k if i == leaf else 0, len(self.lengths[i])):
                at += self.lengths[i][j]
                yield at, (i, j + 1)

    def _replace(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        (a, i), (b, j) = first, last
        for held, new in ((self.lengths, lengths), (self.counts, counts)):
            tail = held[b][j:]
            if a == b:
                held[a] = held[a][:i] + new + tail
            else:
                held[a] = held[a][:i] + new
                for leaf in range(a + 1, b):
                    held[leaf] = []
                held[b] = tail
        if len(self.lengths[a]) > CROWDED * LEAF:
            flat = self.columns()
            self._grow(
                [flat[2][i : i + LEAF] for i in range(0, len(flat[2]), LEAF)],
                [flat[3][i : i + LEAF] for i in range(0, len(flat[3]), LEAF)],
            )
            return
        touched = range(a + self.width, b + self.width + 1)
        for i in touched:
            self.chars[i], self.tokens[i] = sum(self.lengths[i - self.width]), sum(self.counts[i - self.width])
        low, high = touched[0] // 2, touched[-1] // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2

    def apply(self, edits: Iterable[dict]) -> None:
        for e in edits:
            self.edit(e["start"] or 0, e["end"] or 0, e["new"] or "")


def count_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TREES: a tree for each row of `docs`; tokens[1] is the count of its text (a null text is empty)."""

    def make():
        held = counter(path)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                trees = [CountTree(t.as_py(), held).columns() for t in part.column(1)]
                yield [part.column(0), *(list(c) for c in zip(*trees))]

        return work

    return in_batches(texts(docs, id_col, text_col), TREES, make)


def recount(trees: DataFrame, edits: str, path: str) -> DataFrame:
    """COUNTS after the edits in column `edits` of TREES: an array of (start, end, new), in order.

    Offsets are characters of the text as the edits before have left it, moved into it if outside; a null
    `new` is empty, and null edits are none. Only what the edits touch is encoded again.
    """
    names = [part.split()[0] for part in TREES.split(", ")]

    def make():
        held = counter(path)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for doc, *parts, changes in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    tree = CountTree.stored(*parts, held)
                    before = tree.total
                    tree.apply(changes or [])
                    rows.append((doc, before, tree.total, tree.size, tree.reencoded, tree.text))
                yield [list(c) for c in zip(*rows)]

        return work

    return in_batches(trees.select(*names, edits), COUNTS, make)


def count_and_recount(docs: DataFrame, edits: str, path: str) -> DataFrame:
    """`recount` of new trees, all in one task, for documents whose trees were not kept.

    A null text is empty, null edits are none; repeated rows and null ids are rows; no rows give no rows.
    """

    def make():
        held = counter(path)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for doc, text, changes in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    tree = CountTree(text or "", held)
                    before = tree.total
                    tree.apply(changes or [])
                    rows.append((doc, before, tree.total, tree.size, tree.reencoded, tree.text))
                yield [list(c) for c in zip(*rows)]

        return work

    return in_batches(docs.select("doc_id", "text", edits), COUNTS, make)


def drawn_edits(docs: DataFrame, number: int = 3) -> DataFrame:
    """doc_id, text and `edits`: for each document edits drawn from its id by hash.

    Each takes out up to 11 characters at some place and puts in up to 15 from another place of the text.
    """
    rows = texts(docs)
    length = F.length("text")

    def one(k: int):
        h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(k))
        start = F.pmod(h, length + 1)
        taken = F.substring("text", (F.pmod(F.shiftright(h, 16), length + 1) + 1).cast("int"), F.pmod(F.shiftright(h, 40), F.lit(16)).cast("int"))
        return F.struct(start.alias("start"), (start + F.pmod(F.shiftright(h, 24), F.lit(12))).alias("end"), taken.alias("new"))

    return rows.select("doc_id", "text", F.array(*map(one, range(number))).alias("edits"))
