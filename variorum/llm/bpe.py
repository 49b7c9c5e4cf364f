"""BPE encoding and decoding with a contiguous array of ranks for each word."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from variorum.llm.caches import Kept
from variorum.llm.tables import in_batches, texts

#: A pair of ids is one number, and so is a merge: its rank, then the id of the joined part.
SHIFT = 20
PART = (1 << SHIFT) - 1
#: What stands for a pair that no merge joins; above every merge.
NEVER = 1 << 60
#: Words of more parts than this are merged with a heap, as scanning them would take quadratic time.
SHORT = 128
#: Words, and runs between white space, that a worker remembers (of either two halves of this size at most).
ROOM = 200_000
#: White space as Unicode has it; str.split() would also cut at 0x1C to 0x1F.
PIECES = regex.compile(r"[^\p{White_Space}]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte, by rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """Encoder and decoder of a word-end BPE file: NFC, white space to one space, lower case, split, merge."""

    def __init__(self, path: str, room: int = ROOM) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {
            self.ids[a] << SHIFT | self.ids[b]: rank << SHIFT | self.ids[a + b]
            for rank, (a, b) in enumerate(merges)
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.letters = byte_letters()
        self.of_word = Kept(self._word, room)
        self.of_piece = Kept(self._piece, room)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [self._plain(text[at : found.start()]), self.special[found.group()].to_bytes(4, "little")]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Tokens one space apart: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # No word crosses white space, so white-space runs need not be rewritten first.
        pieces = PIECES.findall(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.of_piece.__getitem__, pieces))

    def _piece(self, piece: str) -> bytes:
        # str.lower() alone would write a final sigma, which is not what lower-casing letter by letter does.
        lower = piece.replace("Σ", "σ").lower()
        return b"".join([self.of_word[w] for w in self.words.findall(lower)])

    def _word(self, word: str) -> bytes:
        letters = [self.letters[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        parts = [self.ids[x] for x in letters]
        parts = self.scan(parts) if len(parts) <= SHORT else self.queue(parts)
        return array("I", parts).tobytes()

    def scan(self, parts: list[int]) -> list[int]:
        """Merge by repeated scans of one array: ranks[i] is the merge of the pair that starts at part i."""
        rank_of = self.merges.get
        ranks = [rank_of(a << SHIFT | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            part = parts[i] = low & PART
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << SHIFT | part, NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(part << SHIFT | parts[i + 1], NEVER)
        return parts

    def queue(self, parts: list[int]) -> list[int]:
        """The same merges in the same order for a long word: a heap of pairs, and links between parts."""
        rank_of, n = self.merges.get, len(parts)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [
            (rank, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (rank := rank_of(a << SHIFT | b, NEVER)) != NEVER
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or rank_of(parts[i] << SHIFT | parts[j], NEVER) != rank:
                continue
            parts[i], gone[j] = rank & PART, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    rank = rank_of(parts[k] << SHIFT | parts[after[k]], NEVER)
                    if rank != NEVER:
                        heapq.heappush(heap, (rank, k))
        return [p for p, out in zip(parts, gone) if not out]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder for each worker process, which keeps its cache from task to task."""
    return WordBpe(path)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) and the text decoded from them.

    One row for each row of `docs`; a null text is an empty one and has no ids. `path` names the
    vocabulary file, which must lie at the same place on every executor. No shuffle.
    """

    def make():
        bpe = word_bpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [bpe.encode(text.as_py()) for text in part.column(1)]
                yield [part.column(0), ids, list(map(bpe.decode, ids))]

        return work

    return in_batches(texts(docs, id_col, text_col), "doc_id long, ids binary, decoded string", make)


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: number of ids, and SHA-256 of the ids and of the text decoded from them.

    The digests are taken in the same task, so that ids and decoded texts need not leave it.
    """

    def make():
        bpe = word_bpe(path)

        def work(batch: pa.RecordBatch) -> Iterator[list]:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield [batch.column(0), counts, of_ids, of_text]

        return work

    return in_batches(texts(docs, id_col, text_col), SCHEMA, make)
