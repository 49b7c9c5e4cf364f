"""Conversations with broken turns, mended at least cost by depth-first branch and bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.llm.tables import in_batches

#: Costs of edits; a row that stays although its text is cut off adds TRUNCATED.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that are searched at once. Of a longer conversation, the best way into each state is carried on.
PIECE = 64
#: Characters that are no words, and those that end a sentence.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
ENDS = ".!?"

SOUND, CUT_OFF, MUST_GO = 0, 1, 2
ROLES = {"u": "user", "a": "assistant"}
#: What has been said so far: nothing, the system's word, a user's turn, an assistant's turn.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
#: Where a role's initial leads; other initials lead nowhere.
NEXT = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
#: The one role that may be put in, besides a kept system's.
PUT = ("u", "u", "a", "u")
#: Least cost to turn one state into another by inserts; None where none can.
TURNED = (
    (0, None, INSERT, 2 * INSERT),
    (None, 0, INSERT, 2 * INSERT),
    (None, None, 0, INSERT),
    (None, None, INSERT, 0),
)
#: Least cost to end a conversation: it is empty or its last turn is an assistant's.
ENDED = (0, 2 * INSERT, INSERT, 0)

FEATURES = "conv_id long, turn long, role string, digest string, fault int, gone boolean"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURNS = "conv_id long, place long, role string, text string, edit string"


# ---- the search ----------------------------------------------------------------------------------------

#: An audit so far: the one before, its last letter, its length.
Trail = tuple
ROOT: Trail = (None, "", 0)


def letters(trail: Trail) -> str:
    out = []
    while trail[0] is not None:
        out.append(trail[1])
        trail = trail[0]
    return "".join(reversed(out))


def earlier(a: Trail, b: Trail) -> bool:
    """Whether audit `a` is ASCII-less than `b`; looks back only to where they part."""
    x, y = a, b
    while x[2] > y[2]:
        x = x[0]
    while y[2] > x[2]:
        y = y[0]
    if x is y:
        return a[2] < b[2]
    while x[0] is not y[0]:
        x, y = x[0], y[0]
    return x[1] < y[1]


@lru_cache(None)
def choices(state: int, initial: str, fault: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what can be done with a row, cheapest first and then by letter."""
    found = [("D", DELETE, state)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_OFF else 0
        if initial in NEXT[state]:
            found.append(("K", KEEP + more, NEXT[state][initial]))
        if initial != PUT[state]:
            found.append(("R", REROLE + more, NEXT[state][PUT[state]]))
    return tuple(sorted(found, key=lambda c: (c[1], c[0])))


@lru_cache(None)
def cheapest(block: tuple[tuple[str, int], ...], last: bool) -> int:
    """Least cost of a few rows, whatever state they are met and left in; the end of a conversation must be a legal one."""
    reach = dict.fromkeys(range(4), 0)
    for initial, fault in block:
        met: dict[int, int] = {}
        for state, cost in reach.items():
            for _, more, to in choices(state, initial, fault):
                met[to] = min(met.get(to, 1 << 60), cost + more)
        reach = {
            to: min(cost + TURNED[of][to] for of, cost in met.items() if TURNED[of][to] is not None)
            for to in range(4)
            if any(TURNED[of][to] is not None for of in met)
        }
    return min(cost + (ENDED[state] if last else 0) for state, cost in reach.items())


def suffix_bounds(rows: list[tuple[str, int]], last: bool) -> list[int]:
    """For each row a lower bound of what it and all later rows cost.

    The rows are cut in blocks of one to three, each free to begin in any state; of all cuts the dearest counts.
    """
    n = len(rows)
    bounds = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        bounds[i] = max(
            cheapest(tuple(rows[i : i + k]), last and i + k == n) + bounds[i + k] for k in range(1, min(3, n - i) + 1)
        )
    return bounds


def search(
    rows: list[tuple[str, int]], entries: dict[int, tuple[int, Trail]], last: bool
) -> dict[int, tuple[int, Trail]]:
    """The cheapest (cost, audit) into each state behind `rows` (initial, fault), equal costs by the ASCII-least audit.

    Depth first over prefixes on an explicit stack. At each node (rows done, state) the best prefix is kept:
    a later one that is no better, or dearer than a turned better one, is dominated. A prefix whose cost and
    suffix bound exceed the incumbent is cut, and when a node's choices are used up its bound is raised to
    what they left. The search ends when the stack is empty, and so is proved.
    With `last`, only the state that ends the conversation best is returned, under NOTHING.
    """
    n = len(rows)
    bounds = [[b] * 4 for b in suffix_bounds(rows, last)]
    if last:
        bounds[n] = list(ENDED)
    best: list[list] = [[None] * 4 for _ in range(n + 1)]
    found: tuple[int, Trail] | None = None
    limit = 1 << 60
    slack = 0 if last else 2 * INSERT  # an exit that is dearer than another by more is a turned other

    def better(i: int, state: int, cost: int, trail: Trail) -> bool:
        if cost + bounds[i][state] > limit:
            return False
        for other, held in enumerate(best[i]):
            if held is None:
                continue
            if other == state:
                if held[0] < cost or held[0] == cost and not earlier(trail, held[1]):
                    return False
            elif (turned := TURNED[other][state]) is not None and held[0] + turned < cost:
                return False
        return True

    def steps(i: int, state: int) -> list[tuple[int, str, int, int]]:
        """(cost, letter, row, state) of each choice at a node."""
        put = (INSERT, "I", i, NEXT[state][PUT[state]])
        return [put] if i == n else [put, *((c, letter, i + 1, to) for letter, c, to in choices(state, *rows[i]))]

    stack = []
    for state, (cost, trail) in sorted(entries.items(), key=lambda e: -e[1][0]):
        if better(0, state, cost, trail):
            best[0][state] = node = (cost, trail)
            stack.append((0, state, node))
    while stack:
        i, state, node = stack.pop()
        if node is None:  # all choices of this node are used up
            left = min(c + bounds[row][to] for c, _, row, to in steps(i, state))
            if left > bounds[i][state] and i < n:
                bounds[i][state] = left
            continue
        if best[i][state] is not node:  # a better prefix has come here since
            continue
        cost, trail = node
        if cost + bounds[i][state] > limit:
            continue
        if i == n:
            if not last:
                limit = min(limit, cost + slack)
            elif state in (NOTHING, ANSWERED):
                if found is None or cost < found[0] or cost == found[0] and earlier(trail, found[1]):
                    found, limit = node, cost
                continue
        stack.append((i, state, None))
        ways = steps(i, state)
        ways.sort(key=lambda s: (s[0] + bounds[s[2]][s[3]], s[1]), reverse=True)
        for more, letter, row, to in ways:
            then = (trail, letter, trail[2] + 1)
            if better(row, to, cost + more, then):
                best[row][to] = held = (cost + more, then)
                stack.append((row, to, held))
    if last:
        return {NOTHING: found}
    return {state: held for state, held in enumerate(best[n]) if held is not None}


def mend(rows: list[tuple[str, int]], piece: int = PIECE) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation's rows (role initial, fault)."""
    states = {NOTHING: (0, ROOT)}
    for at in range(0, max(len(rows), 1), piece):
        states = search(rows[at : at + piece], states, at + piece >= len(rows))
    cost, trail = states[NOTHING]
    return cost, letters(trail)


# ---- rows --------------------------------------------------------------------------------------------


def or_space(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns broken by a draw from crc32 of `conv_id:turn`, modulo 20.

    0 takes the row away (it comes back as `gone`, without role and text, so that its conversation is not
    lost), 1 empties its text, 2 takes out sentence ends, 3 repeats it, 4 makes it a user's. A null role or
    text, and a null id or turn in the draw, is one space.
    """
    c = conversations
    draw = F.crc32(F.concat(or_space(c["conv_id"]), F.lit(":"), or_space(c["turn"])).cast("binary")) % 20
    role, text = or_space(c["role"]), or_space(c["text"])
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        F.when(draw == 0, None).when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 0, None)
        .when(draw == 1, "")
        .when(draw == 2, F.translate(text, ENDS, ""))
        .otherwise(text)
        .alias("text"),
        (draw == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def given(conversations: DataFrame) -> DataFrame:
    """The rows of `damage` for a table that is taken as it is."""
    c = conversations
    return c.select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        or_space(c["role"]).alias("role"),
        or_space(c["text"]).alias("text"),
        F.lit(False).alias("gone"),
    )


def digest() -> Column:
    return F.sha2("text", 256)


def features(rows: DataFrame) -> DataFrame:
    """FEATURES, without texts. `fault` is MUST_GO - or more for a repeat - or CUT_OFF or SOUND.

    A row is a repeat if its conversation has its role and text at an earlier turn (found by an aggregate
    over digests, as the text may be common), or again at this one (found as rows pass in order).
    """
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    each = rows.select(
        "conv_id", "turn", "role", digest().alias("digest"), "gone",
        F.when(~F.col("text").rlike(WORD), MUST_GO)
        .when(~last.isin(*ENDS), CUT_OFF)
        .otherwise(SOUND)
        .alias("fault"),
    )
    seen = (
        each.filter("not gone")
        .groupBy(F.col("conv_id").alias("of"), F.col("role").alias("its_role"), F.col("digest").alias("its_digest"))
        .agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    known = each.join(
        seen,
        F.col("conv_id").eqNullSafe(F.col("of"))
        & (F.col("role") == F.col("its_role"))
        & (F.col("digest") == F.col("its_digest")),
        "left",
    )
    again = F.coalesce(turn > F.col("first"), F.lit(False))
    fault = F.when((F.col("fault") != MUST_GO) & again, MUST_GO + 1).otherwise(F.col("fault"))
    return known.select("conv_id", "turn", "role", "digest", fault.cast("int").alias("fault"), "gone")


#: Rows of one turn go by role and digest of the text; the order is the same wherever rows are read.
ORDER = ("gone", "turn", "role", "digest")


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", *first, *(F.col(c).asc_nulls_first() for c in ORDER)
    )


def audits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """REPORT of each conversation of `damage` rows; those whose rows are all gone come with zeros.

    Texts take no part: a conversation passes through its task as one letter and one number a row.
    """

    def make():
        held: list[tuple[str, int]] = []
        of: list = []  # the id of the conversation that is being read, if any
        told: dict = {}

        def close() -> tuple:
            cost, audit = mend(held, piece)
            turns = told["turns"]
            gaps = told["high"] - told["low"] + 1 - turns if turns else 0
            held.clear()
            return (of.pop(), gaps, *told["faults"], told["illegal"], cost, audit)

        def work(batch: pa.RecordBatch | None) -> Iterator[list]:
            out = []
            for conv, turn, role, key, fault, gone in [] if batch is None else zip(*(c.to_pylist() for c in batch.columns)):
                if not of or of[0] != conv:
                    if of:
                        out.append(close())
                    of.append(conv)
                    told.update(turns=0, low=None, high=None, faults=[0, 0, 0], illegal=0, row=None)
                if gone:
                    continue
                if turn is not None and turn != told["high"]:
                    told["turns"] += 1
                    told["low"] = turn if told["low"] is None else told["low"]
                    told["high"] = turn
                if fault != MUST_GO and told["row"] == (turn, role, key):
                    fault = MUST_GO + 1
                told["row"] = (turn, role, key)
                if fault:
                    told["faults"][{MUST_GO: 0, MUST_GO + 1: 1, CUT_OFF: 2}[fault]] += 1
                initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
                told["illegal"] += bool(held) and held[-1][0] + initial not in ("su", "ua", "au")
                held.append((initial, min(fault, MUST_GO)))
            if batch is None and of:
                out.append(close())
            if out:
                yield list(map(list, zip(*out)))

        return work

    return in_batches(in_order(features(rows)), REPORT, make, last=True)


def streamed(rows: DataFrame, reports: DataFrame, schema: str, begin, turn, end) -> DataFrame:
    """Every conversation read once, its report first and then its rows in order; what it holds is its audit.

    `begin(report)` makes a state, `turn(state, role, text, edit)` gives an output row or None for each turn
    that stays or is put in, `end(state)` the last one or None.
    """
    names = [part.split()[0] for part in REPORT.split(", ")[1:]]
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (part.split() for part in REPORT.split(", ")[1:])]
    heads = reports.select(
        "conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("digest"), F.lit(False).alias("gone"), F.lit(None).cast("string").alias("text"), *names,
    )
    body = rows.filter("not gone").select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", digest().alias("digest"), "gone", "text", *none
    )
    both = in_order(heads.unionByName(body), "part").select("conv_id", "part", "role", "text", *names)

    def make():
        held: dict = {}

        def close() -> Iterator[tuple]:
            if held:
                yield from run(iter(()), True)
                if (last := end(held["state"])) is not None:
                    yield last
                held.clear()

        def run(given: Iterator[tuple[str, str]], over: bool = False) -> Iterator[tuple]:
            """Letters up to the next row of the audit (or all that are left) are worked off."""
            audit, said = held["audit"], held["said"]
            while held["at"] < len(audit):
                letter = audit[held["at"]]
                if letter != "I":
                    row = next(given, None)
                    if row is None:
                        return
                    role, text = row
                else:
                    role, text = ROLES[PUT[said]], ""
                held["at"] += 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = ROLES[PUT[said]]
                said = held["said"] = NEXT[said][role[0]]
                if (out := turn(held["state"], role, text, letter)) is not None:
                    yield out

        def work(batch: pa.RecordBatch | None) -> Iterator[list]:
            out: list[tuple] = []
            for conv, part, role, text, *report in [] if batch is None else zip(*(c.to_pylist() for c in batch.columns)):
                if part == 0:
                    out += close()
                    held.update(audit=report[-1], at=0, said=NOTHING, state=begin((conv, *report)))
                else:
                    out += run(iter([(role, text)]))
            if batch is None:
                out += close()
            if out:
                yield list(map(list, zip(*out)))

        return work

    return in_batches(both, schema, make, last=True)


def repaired_turns(conversations: DataFrame, damaged: bool = False, piece: int = PIECE) -> DataFrame:
    """TURNS: the turns of mended conversations, numbered, with the edit that made each (K, R or I).

    See `repair_reports` for nulls, ties and repeated rows.
    """
    rows = (damage if damaged else given)(conversations)

    def turn(state, role, text, edit):
        state["place"] += 1
        return (state["conv"], state["place"] - 1, role, text, edit)

    return streamed(
        rows, audits(rows, piece), TURNS, lambda report: {"conv": report[0], "place": 0}, turn, lambda state: None
    )


def repair_reports(conversations: DataFrame, damaged: bool = False, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id: REPORT and repaired_sha256, the hash of its mended `role:text` lines.

    Rows go by turn, a null turn first, rows of one turn by role and by the SHA-256 of the text. A row's
    first fault counts: blank text; a role and text its conversation had before (so repeated rows are
    duplicates); a text that doesn't end a sentence. Blank rows and duplicates go; what else is done is the
    cheapest set of edits that leaves nothing, or turns of user and assistant in turn, perhaps behind one of
    the system. A null role or text is one space; a null conv_id is a conversation of its own; other columns
    don't matter; no rows give no reports. Costs are exact for conversations of any length: a long one is
    searched in pieces of `piece` rows, the best way into each of four states carried over.

    Texts are shuffled once, to be hashed in order; for the search only digests and letters are. One
    conversation is one task's stream, as its hash is; held of it are two letters and an audit's letter a row.
    """
    rows = (damage if damaged else given)(conversations)

    def begin(report):
        return {"report": report, "hash": hashlib.sha256(), "any": False}

    def turn(state, role, text, edit):
        state["hash"].update((("\n" if state["any"] else "") + f"{role}:{text}").encode())
        state["any"] = True

    return streamed(
        rows, audits(rows, piece), f"{REPORT}, repaired_sha256 string", begin, turn,
        lambda state: (*state["report"], state["hash"].hexdigest()),
    )
