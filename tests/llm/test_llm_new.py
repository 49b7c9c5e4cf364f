"""WARC archives, conversation repair and whitening against plain versions."""

import gzip
import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from variorum.llm import repair, warc, whitening
from variorum.session import scratch_folder, stage

HTML = "<p>same</p>"
PAGES = [
    (1, "http://a/1", HTML), (2, "http://a/2 with space\r\nInjected: yes", HTML), (3, None, None), (4, "http://é/", ""),
    (None, "http://n", HTML), (None, None, "only here"), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u", "x" * 300_000),
    (7, "u", "é漢😀"), (2, "http://a/2 with space\r\nInjected: yes", HTML), (2, "other", HTML), (-3, "u", "once"),
]


def page_table(spark, rows=PAGES):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ("archive", "ordinal", "repeats", "record_id", "payload_key")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names))).repartition(3)


def expected_records(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = Counter()
    for html, pages in groups.items():
        size, digest = len(html.encode()), warc.base32_sha1(html.encode())
        pages.sort(key=lambda p: (p is not None, p))
        keeper = pages.pop()
        out[keeper, size, digest, "response", None] += 1
        for page in pages:
            out[page, size, digest, "revisit", keeper] += 1
    return out


@pytest.mark.parametrize("size", [1, 2000, warc.ARCHIVE_BYTES])
def test_archives_read_back(spark, size):
    made = warc.archived(page_table(spark), archive_bytes=size)
    assert Counter(map(tuple, warc.read_records(made).collect())) == expected_records(PAGES)
    for row in made.collect():
        with warc.opened(row.archive) as file:
            raw = file.read()
        places = list(warc.index_lines(row["index"]))
        assert len(places) == row.records
        assert [p[0] for p in places] == np.cumsum([0, *(p[1] for p in places)])[:-1].tolist()
        for offset, length, kind, record_id in places:  # each its own member
            one = gzip.decompress(raw[offset : offset + length])
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode()) and one.endswith(b"\r\n\r\n")
            assert record_id.encode() in one and b"\r\nInjected" not in one
        assert len(list(warc.records(io.BytesIO(raw)))) == row.records


def test_captured_archives_are_one_member(spark):
    captured = stage(warc.capture(page_table(spark), scratch_folder(spark, "a")), "captured")
    for (path,) in captured.select("archive").distinct().collect():
        with warc.opened(path) as file:
            inflate = zlib.decompressobj(31)
            inflate.decompress(file.read())
            assert inflate.eof and not inflate.unused_data


def test_normalise_takes_any_gzip_layout(spark):
    folder = scratch_folder(spark, "foreign")
    held = [warc.response(f"urn:page:{i}:x:{i}", "u", b"y" * i * 700) for i in range(40)]
    halves = b"".join(held)
    layouts = [gzip.compress(halves), b"".join(map(gzip.compress, held)), gzip.compress(halves[:9999]) + gzip.compress(halves[9999:])]
    for k, data in enumerate(layouts):
        with warc.opened(f"{folder}/{k}.warc.gz", True) as file:
            file.write(data)
    given = spark.createDataFrame([(f"{folder}/{k}.warc.gz",) for k in range(3)], "archive string")
    read = warc.read_records(stage(warc.normalise(given, f"{folder}/out"), "n")).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in read) == Counter({(i, i * 700): 3 for i in range(40)})
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(halves[:5000]))))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(gzip.compress(halves)[:-20])))


def test_no_pages(spark):
    assert warc.read_records(warc.archived(page_table(spark, []))).collect() == []


# ---- conversation repair -----------------------------------------------------------------------------------


def plain_mend(rows):
    """Least (cost, audit) by working through all states row by row."""
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(held):
        for _ in range(2):
            for state, (cost, audit) in list(held.items()):
                for role in "ua":
                    if (to := nexts.get((state, role))) is not None:
                        held[to] = min(held.get(to, (1 << 60, "")), (cost + 3, audit + "I"))
        return held

    held = inserted({0: (0, "")})
    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in held.items():
            ways = [(state, 4, "D")]
            if fault != 2:
                ways += [(nexts.get((state, initial)), 3 * fault, "K")]
                ways += [(nexts.get((state, role)), 3 * fault + 3, "R") for role in "ua"]
            for to, more, letter in ways:
                if to is not None:
                    after[to] = min(after.get(to, (1 << 60, "")), (cost + more, audit + letter))
        held = inserted(after)
    return min(held[state] for state in (0, 3) if state in held)


def test_search_finds_the_cheapest_and_least_audit():
    rnd = random.Random(0)
    for _ in range(3000):
        weights = rnd.choice([[3, 5, 5, 1], [1, 1, 1, 1], [0, 1, 1, 0], [0, 0, 1, 0], [5, 1, 1, 0], [0, 0, 0, 1]])
        rows = [(rnd.choices("sua?", weights)[0], rnd.choices([0, 1, 2], [6, 2, 2])[0]) for _ in range(rnd.randint(0, 14))]
        assert repair.mend(rows) == plain_mend(rows) == repair.mend(rows, rnd.randint(1, 5))
    for weights in ([1, 5, 5, 1], [0, 1, 0, 0], [0, 0, 0, 1]):
        rows = [(rnd.choices("sua?", weights)[0], rnd.choices([0, 1, 2], [6, 2, 2])[0]) for _ in range(1500)]
        assert repair.mend(rows) == plain_mend(rows)


def plain_repair(rows, damaged):
    """Reports of conversations (conv_id, turn, role, text), each worked out in one go."""
    space = lambda v: " " if v is None else str(v)
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        draw = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damaged else 9
        after[conv] += []
        text = "" if draw == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if draw == 2 else text
        after[conv] += [(turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    out = {}
    for conv, own in after.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], whitening_hash(r[2])))
        seen, told, counts = set(), [], Counter()
        for _, role, text in own:
            held = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            told.append((role[:1] if role[:1] in ("s", "u", "a") else "?", {"": 0, "truncated": 1}.get(fault, 2)))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit = plain_mend(told)
        lines, given, last = [], iter(own), ""
        for letter in audit:
            put = "assistant" if last == "u" else "user"
            role, text = (put, "") if letter == "I" else next(given)[1:]
            if letter == "R":
                role = put
            if letter != "D":
                last = role[0]
                lines.append(f"{role}:{text}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, whitening_hash("\n".join(lines)))
    return out


def whitening_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def talks(seed=3):
    rnd = random.Random(seed)
    text = lambda: rnd.choice(["Fine.", "Why?", "", " \n", "cut off", "No! \t", None, "é漢.", "x" * 5000 + "."])
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(1, 12)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 5, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), text()))
    rows += [(None, t, "user", "Who?") for t in range(4)] + [rows[5]] * 3
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", "Again.") for t in range(700)]
    return rows


@pytest.mark.parametrize("damaged", [True, False])
def test_repair(spark, damaged):
    rows = talks()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(("digest", "gone", "part", "audit", "fault", "first")))).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair.repair_reports(df, damaged).collect()}
    assert got == plain_repair(rows, damaged)


def test_repaired_turns_are_what_was_hashed(spark):
    df = spark.createDataFrame(talks(4), "conv_id long, turn long, role string, text string")
    held = defaultdict(list)
    for r in sorted(repair.repaired_turns(df, True).collect(), key=lambda r: (str(r.conv_id), r.place)):
        held[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.repair_reports(df, True).collect():
        assert whitening_hash("\n".join(held[r.conv_id])) == r.repaired_sha256
        assert len(held[r.conv_id]) == len(r.audit.replace("D", ""))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_reports(empty, True).collect() == [] == repair.repaired_turns(empty).collect()


# ---- whitening ------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)) + 100_000
    centred = x - x.mean(0)
    cov = centred.T @ centred / len(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return centred @ axes / np.sqrt(values), values / np.trace(cov), x.astype(np.int64)


def vector_table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(("xs", "v", "at", "whitened", "component", "i")))).repartition(3)


def test_whitening(spark):
    rnd = np.random.default_rng(5)
    good = (rnd.normal(size=(300, 12)) * np.arange(1, 13)).tolist()
    bad = [(900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, [])]
    rows = [(k if k else None, v) for k, v in enumerate(good)] + bad + [(7, good[7])]
    got = whitening.whitened_rows(vector_table(spark, rows)).collect()
    ids = [k if k else None for k in range(300)] + [7]
    want, shares, x = plain_whitening(good + [good[7]])
    n, sums = len(x), x.sum(0)
    away = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert len(got) == 8 * n and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-12
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({key: 8 * c for key, c in Counter(zip(ids, away)).items()})
    for part in range(8):
        own = sorted((r.vec_id if r.vec_id is not None else -1, r.whitened) for r in got if r.component == part + 1)
        plain = sorted((i if i is not None else -1, w) for i, w in zip(ids, want[:, part]))
        other = sorted((i if i is not None else -1, -w) for i, w in zip(ids, want[:, part]))
        assert any(np.allclose([w for _, w in own], [w for _, w in them], atol=1e-9) for them in (plain, other))
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), shares, rtol=1e-9)


def test_polynomial_is_exact(spark):
    rnd = random.Random(2)
    for d in (1, 2, 3, 7):
        a = [[0] * d for _ in range(d)]
        for i in range(d):
            for j in range(i + 1):
                a[i][j] = a[j][i] = rnd.choice([0, 0, rnd.randint(-9, 9), rnd.randint(-(10**12), 10**12)])
        for i in range(d):  # a bound of the coefficients by the trace holds for scatters: no negative roots
            a[i][i] = sum(abs(v) for v in a[i]) + rnd.randint(0, 5)
        found = whitening.characteristic(spark, a)
        # Faddeev's recursion, on exact integers
        m, c = [[0] * d for _ in range(d)], [1]
        for k in range(1, d + 1):
            m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
            c.append(-sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)) // k)
        assert found == c[::-1]


def test_equal_eigenvalues_and_low_rank(spark):
    rows = [(k, [float(v) for v in p]) for k, p in enumerate([(1, 0, 0, 0), (-1, 0, 0, 0), (0, 1, 0, 0), (0, -1, 0, 0)])]
    got = whitening.whitened_rows(vector_table(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2} and {r.explained for r in got} == {0.5}
    assert got[0].identity_error < 1e-12
    assert whitening.whitened_rows(vector_table(spark, rows[:1])).collect() == []
    assert whitening.whitened_rows(vector_table(spark, rows[:1] * 5)).collect() == []
    assert whitening.whitened_rows(vector_table(spark, [])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(k, [v, -v, 3.5]) for k, v in enumerate([2.0**40, 2.0**41 + 1, -(2.0**42), 5.0])]
    fit = whitening.fit_sums(whitening.fit_rows(vector_table(spark, rows)))
    xs = [[int(1024 * v) for v in row] for _, row in rows]
    assert fit.sums == [sum(c) for c in zip(*xs)]
    assert fit.products == [[sum(r[i] * r[j] for r in xs) for j in range(3)] for i in range(3)]
    got = whitening.whitened_rows(vector_table(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and got[0].identity_error < 1e-4
