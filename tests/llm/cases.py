"""Awkward documents that every operator meets, and plain versions of what the operators work out."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(30_000))
#: Names that the operators use inside, as columns of the table given.
CLASHING = ("row_id", "digest", "class", "kept", "place", "row", "ids", "cuts", "score", "component_id", "number", "given", "key")


def word(rnd: random.Random) -> str:
    return "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))


def corpus(seed: int = 1) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rnd = random.Random(seed)
    vocabulary = [word(rnd) for _ in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, rows, doc = prose(40), [], 0

    def add(text):
        nonlocal doc
        rows.append((doc, text))
        doc += 1

    for _ in range(25):
        add(" ".join(prose(rnd.randint(1, 200))))
    base = prose(120)
    for _ in range(25):  # near copies of many degrees
        changed = list(base)
        for _ in range(rnd.randint(0, 9)):
            changed[rnd.randrange(len(changed))] = word(rnd)
        add(" ".join(changed))
    for k in range(12):  # a shared passage, whole or in part, upper case or not
        own = prose(30)
        at = rnd.randint(0, 30)
        add(" ".join(own[:at] + passage[k % 3 * 5 :] + own[at:]).replace(" ", " " if k % 2 else "  \n"))
    for _ in range(30):
        add("the same text over and over")
    for text in (None, "", " \n\t ", "a", "a b", "A B", "x y z", "\x1c \x85  ", "ü é 漢字 😀 ́", "b " * 300, LONG, LONG):
        add(text)
    rows += [(None, "no id at all"), (None, None), (None, rows[30][1]), rows[3], rows[3], (7, "another text under an id")]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    """A table of documents in several partitions, with columns whose names clash."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING))).repartition(5)


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text: str | None, n: int) -> frozenset:
    own = (text or "").encode().lower().split()
    n = min(n, len(own))
    return frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else frozenset()


def linked(sets: list[frozenset], percent: int) -> list[int]:
    """For each set the first set of its component, all pairs compared."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, own in enumerate(sets):
        counts = defaultdict(int)
        for s in own:
            for j in having[s]:
                counts[j] += 1
            having[s].append(i)
        for j, both in counts.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def cut_repeats(rows: list[tuple], window: int = 13) -> dict[tuple, tuple[int, int, list[bytes]]]:
    """(doc_id, text): words, words cut, words kept."""
    none = 1 << 63
    first: dict[tuple, int] = {}
    for doc, text in rows:
        own, place = words(text), none if doc is None else doc
        for i in range(len(own) - window + 1):
            run = tuple(own[i : i + window])
            first[run] = min(first.get(run, place), place)
    out = {}
    for doc, text in rows:
        own, place = words(text), none if doc is None else doc
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < place:
                gone[i : i + window] = [True] * window
        out[doc, text] = (len(own), sum(gone), [w for w, g in zip(own, gone) if not g])
    return out
