"""Quality, tokens, packing, toxicity and chat formats."""

import random
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from variorum.llm import bpe, chat, packing, quality, token_counts, toxicity, words

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
STRANGE = list("aAbÉé́ΣςσİIıß  \t\n\r\x0b\x0c\x1c\x1d\x85 ​’'\"<|>0123٣Ⅷ漢字한글ㅎ😀ͅﬁǅ ") + [
    "<|endoftext|>", "<|startoftext|>", "'s", "'LL", " don't ", "İ", "ΑΣ ", "\x00", "﻿", "  \n", "a" * 200,
]


def strange(number, seed, longest=30):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(STRANGE) for _ in range(rnd.randint(0, longest))) for _ in range(number)]


def covered(own, n):
    places = defaultdict(list)
    for i in range(len(own) - n + 1):
        places[tuple(own[i : i + n])].append(i)
    hidden = set()
    for at in places.values():
        if len(at) > 1:
            hidden.update(i + k for i in at for k in range(n))
    return hidden


def judged(text):
    text = text or ""
    own = [w.decode() for w in cases.words(text)]
    chars = sum(map(len, own))
    size = lambda held: sum(len(own[i]) for i in held)
    seen, lines, again, again_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if cases.words(line):
            lines += 1
            if line in seen:
                again += 1
                again_chars += sum(len(w.decode()) for w in cases.words(line))
            seen.add(line)
    base = len(covered(own, 8))
    failed = len(own) < 20 or 100 * base > 30 * len(own)
    good = again <= 0.30 * lines and again_chars <= 0.20 * chars
    good = good and all(size(covered(own, n)) <= share * chars for n, share in quality.NGRAM_SHARES.items())
    return (len(own), chars, sum(c in "#*$%&|<>" for c in text), again, base, failed, good and not failed)


def test_quality(spark, docs, rows):
    rnd = random.Random(4)
    more = [(1000 + i, "\n".join(rnd.choice(["a b c d e f g h i", "x", "", " \t", "q r s | # t"]) + str(rnd.randint(0, 9) if i % 2 else "") for _ in range(rnd.randint(1, 60)))) for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = Counter((r.doc_id, *(r[n] for n in names)) for r in quality.quality(table).collect())
    assert got == Counter((doc, *judged(text)) for doc, text in rows + more)
    assert {r[-1] for r in got} == {True, False}


def test_word_bpe_is_the_librarys():
    library, own = Tokenizer.from_file(WORDS), bpe.WordBpe(WORDS, room=50)
    for text in strange(3000, 1) + [cases.LONG[:20_000], "ab" * 3000, "ThE" * 500]:
        ids = library.encode(text, add_special_tokens=False).ids
        found = own.encode(text)
        assert np.frombuffer(found, "<u4").tolist() == ids
        assert own.decode(found) == library.decode(ids, skip_special_tokens=False)


def test_scan_and_queue_agree():
    own, rnd = bpe.WordBpe(WORDS), random.Random(2)
    for _ in range(500):
        parts = [own.ids[rnd.choice("abcdeth")] for _ in range(rnd.randint(1, 100))]
        assert own.scan(list(parts)) == own.queue(list(parts))


def test_token_digests(docs, rows):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), cases.sha(np.array(ids, "<u4").tobytes()), cases.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(docs, WORDS).collect()) == want
    held = bpe.encode_and_decode(docs, WORDS).collect()
    assert Counter((r.doc_id, len(r.ids) // 4, cases.sha(bytes(r.ids)), cases.sha(r.decoded)) for r in held) == want


def test_byte_bpe_is_the_librarys():
    library, own = Tokenizer.from_file(BYTES), packing.ByteBpe(BYTES)
    for text in strange(3000, 3):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [7, 1024])
def test_packing(docs, rows, window):
    library = Tokenizer.from_file(BYTES)
    got = packing.pack(docs, BYTES, window).collect()
    streams = Counter()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        assert len(r.ids) == 2 * r.length > 0
    whole = []
    for number in range(len(sequences)):
        held = sorted(sequences[number], key=lambda r: r.offset)
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
            whole.append(r)
        assert at == window or number == len(sequences) - 1
    # In stream order the pieces of a document follow each other.
    at = 0
    while at < len(whole):
        doc, total, ids = whole[at].doc_id, whole[at].doc_tokens, b""
        while len(ids) < 2 * total:
            assert (whole[at].doc_id, whole[at].start) == (doc, len(ids) // 2)
            ids += bytes(whole[at].ids)
            at += 1
        streams[doc, tuple(np.frombuffer(ids, "<u2").tolist())] += 1
    assert streams == Counter((doc, (*library.encode(text or "", add_special_tokens=False).ids, 0)) for doc, text in rows)
    crcs = packing.piece_digests(packing.pack(docs, BYTES, window), 2).collect()
    assert Counter(r.ids_crc32 for r in crcs) == Counter(
        zlib.crc32(np.frombuffer(bytes(r.ids), "<u2").astype("<u4").tobytes()) for r in got
    )


def test_trees_follow_edits():
    held, rnd = token_counts.Counter(BYTES), random.Random(5)
    pool = ["a", "b", " ", "  ", "\n", "'s", "'", "1", ".", "é", "漢", " the", "ing", "\t", "don't"]
    for t in range(800):
        text = "".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 5, 40, 700])))
        tree = token_counts.CountTree(text, held)
        if t % 2:
            tree = token_counts.CountTree.stored(*tree.columns(), held)
        for _ in range(rnd.randint(1, 6)):
            start = rnd.randint(0, len(text) + 2)
            end = start + rnd.choice([0, 0, 1, 3, 30])
            new = "".join(rnd.choice(pool) for _ in range(rnd.choice([0, 1, 2, 10, 900 if t % 50 == 0 else 3])))
            tree.edit(start, end, new)
            start = min(start, len(text))
            text = text[:start] + new + text[max(start, min(end, len(text))) :]
            fresh = token_counts.CountTree(text, held)
            assert tree.text == text and tree.total == fresh.total
            assert sum(tree.lengths, []) == sum(fresh.lengths, []) and sum(tree.counts, []) == sum(fresh.counts, [])


def test_an_edit_encodes_little():
    held = token_counts.Counter(BYTES)
    tree = token_counts.CountTree(cases.LONG, held)
    tree.edit(len(cases.LONG) // 2, len(cases.LONG) // 2 + 3, "new")
    assert tree.reencoded < 10


def test_recount(docs, rows):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    size = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    edited = token_counts.drawn_edits(docs)
    given = edited.collect()
    want = Counter()
    for r in given:
        text = r.text
        for e in r.edits:
            text = text[: e.start] + e.new + text[max(e.start, min(e.end, len(text))) :]
        want[r.doc_id, size(r.text), size(text), text] += 1
    one = token_counts.count_and_recount(edited, "edits", BYTES).collect()
    kept = token_counts.count_trees(docs, BYTES).withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("string").alias("new"))))
    assert Counter((r.doc_id, r.n_tokens, r.edited_tokens, r.edited_text) for r in one) == want
    same = token_counts.recount(kept, "edits", BYTES).collect()
    assert Counter((r.doc_id, r.n_tokens, r.edited_tokens) for r in same) == Counter((d, size(t or ""), size(t or "")) for d, t in rows)


def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["vilefoo", "grumbar", "snotbaz"]
    rows, labels = [], []
    for i in range(900):
        text = [cases.word(rnd) for _ in range(rnd.randint(5, 60))]
        if i % 5 == 0:
            text.insert(rnd.randrange(len(text)), rnd.choice(bad) + rnd.choice(["", "ish", "ed", "."]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, ""), (None, "vilefoo"), (3, rows[3][1])]
    got = toxicity.toxicity(cases.frame(spark, rows), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, int(r.doc_id % 5 == 0)) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.3


def plain_places(text):
    """Hashed n-grams of the distinct words of a text, letter by letter."""
    found = set()
    for w in set(text.lower().split()):
        w = "\x02" + w + "\x02"
        for n in toxicity.LENGTHS:
            for i in range(len(w) - n + 1):
                value = 0
                for letter in w[i : i + n]:
                    value = (value * int(words.FACTOR) + ord(letter)) % 2**64
                found.add(int(words.mixed(np.array([value], np.uint64))[0]) >> (64 - toxicity.BITS))
    return found


def plain_toxicity(rows, labels):
    """Features, ratios, weights and scores with dense rows and loops."""
    toxic = {}
    for i, label in labels:
        if i is not None and label in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2:
            toxic[i] = max(label, toxic.get(i, 0))
    places = [plain_places(text or "") for _, text in rows]
    fitted = [(held, toxic[i]) for (i, _), held in zip(rows, places) if i in toxic]
    n = Counter(label for _, label in fitted)
    positive = Counter(x for held, label in fitted if label for x in held)
    every = Counter(x for held, _ in fitted for x in held)
    ratio = {x: np.log((positive[x] + 1) / (n[1] + 2)) - np.log((c - positive[x] + 1) / (n[0] + 2)) for x, c in every.items() if c >= toxicity.LEAST_DOCUMENTS}
    ratio = {x: r for x, r in ratio.items() if abs(r) >= toxicity.LEAST_RATIO}
    order = sorted(ratio)
    scaled = np.array([[ratio[x] if x in held else 0.0 for x in order] for held, _ in fitted])
    label = np.array([float(x) for _, x in fitted])
    norm = max(1.0, np.sqrt((scaled**2).sum() / len(label)))
    matrix = scaled / norm
    cost = np.array([(0.5 * len(label) / n[int(x)]) ** toxicity.BALANCE for x in label])
    weights, offset, speed, push = np.zeros(len(order)), np.log(n[1] / n[0]), 0.0, 0.0
    for _ in range(toxicity.STEPS):
        error = cost * (1 / (1 + np.exp(-(matrix @ weights + offset))) - label) / len(label)
        speed = 0.9 * speed - toxicity.RATE * (matrix.T @ error + toxicity.PENALTY * weights)
        push = 0.9 * push - toxicity.RATE * error.sum()
        weights, offset = weights + speed, offset + push
    worth = {x: w * ratio[x] / norm for x, w in zip(order, weights)}
    return [1 / (1 + np.exp(-min(30, max(-30, offset + sum(worth.get(x, 0.0) for x in held))))) for held in places]


@pytest.mark.filterwarnings("ignore:overflow")
def test_toxicity_equals_a_plain_version(spark):
    rnd = random.Random(16)
    rows, labels = [], []
    for i in range(260):
        text = [cases.word(rnd) for _ in range(rnd.randint(0, 40))]
        if i % 4 == 0:
            text.insert(rnd.randint(0, len(text)), rnd.choice(["vileFOO", "grumbar", "Snotbaz", "é漢😀vile"]) + rnd.choice(["", "ish", "."]))
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(text)))
        if i % 5:
            labels.append((i, int(i % 4 == 0)))
    rows += [(300, None), (301, ""), (None, "grumbar " * 3), (8, rows[8][1]), (302, "grumbarish " * 30_000 + "x" * 50_000)]
    # Told twice and otherwise, a label counts as toxic; unknown labels and ids that no row has count for nothing.
    labels += [(1, 1), (None, 1), (6, None), (7, 3), (999, 1)]
    got = toxicity.toxicity(cases.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = defaultdict(list)
    for (i, _), score in zip(rows, plain_toxicity(rows, labels)):
        want[i].append(score)
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id][0]) < 1e-9, r
        assert r.predicted == int(want[r.doc_id][0] >= toxicity.THRESHOLD)


def test_toxicity_without_labels_or_rows(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(nothing, none).count() == 0


def turns():
    rnd = random.Random(8)
    pool = [*chat.CONTROL, b"<\\|", b"[\\\\INST]", b"<", b"|", b"\\", b"hello", b"\n", "é漢😀".encode(), chat.OPEN, chat.CLOSE, b"im_end|>", b"[INST", b"]"]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 6)):
            text = b"".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))).decode()
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system", "assistant"]), text))
    rows += [(60, 0, None, "x"), (60, 1, "assistant", None), (61, None, "odd\nrole\\", "y"), (64, 0, "user<|im_end|>[INST]", "z"), (65, 0, "<\\|</s>\n<\\\\|", "z"), (62, 1, "user", "tie"), (62, 1, "assistant", "tie")]
    rows += [(None, 0, "user", "no id"), (63, 0, "assistant", "<|" * 400_000), rows[0], rows[0]]
    return rows


def test_chat(spark):
    rows = turns()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(3)
    formatted = chat.format_chats(table).cache()
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = Counter()
    for conv, held in groups.items():
        held.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in held)
        learnt = "".join(text for *_, role, text in held if role == "assistant")
        want[conv, len(held), cases.sha(said), len(learnt), cases.sha(learnt)] += 1
    digests = chat.chat_digests(formatted).collect()
    assert Counter(tuple(r)[:5] for r in digests) == want
    for r in formatted.collect():
        plain = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>\n", "")
        assert not any(c.decode() in plain for c in chat.CONTROL)
    assert chat.format_chats(table.filter("conv_id = 999")).count() == 0


def test_nothing(nothing):
    assert quality.quality(nothing).count() == 0
    assert bpe.token_digests(nothing, WORDS).count() == 0
    assert packing.pack(nothing, BYTES).count() == 0
    assert token_counts.count_trees(nothing, BYTES).count() == 0
