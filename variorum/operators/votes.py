"""Votes over aligned slots, dispute regions, and the local choice for a region.

A slot row is ``keys, slot, candidates, n``: ``candidates`` holds at most one reading per agent, in
agent order, and ``n`` counts the valid readings of the page. A slot is therefore never larger than
the number of engines, and the vote needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T
from variorum.operators import ordered
from variorum.operators.readings import PAGE

# Fixed values of the confidence model.
ENGINE_ERROR = 0.20
SHARED_EVIDENCE = 0.6
DISSENT = 0.5
CORROBORATED = 0.95
SOLO = 0.80
FALLBACK_FLOOR = 0.30
FALLBACK_SPAN = 0.35
FALLBACK_LONE = 0.25


def gather_slots(rows: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Candidate rows ``keys, slot, agent, text, n`` to slot rows."""
    return rows.groupBy(*keys, "slot").agg(
        F.array_sort(F.collect_list(F.struct("agent", "text"))).alias("candidates"),
        F.max("n").cast("int").alias("n"),
    )


def consensus_confidence(k: Column, n: Column) -> Column:
    k, n = k.cast("double"), n.cast("double")
    alone = 1 - F.pow(F.lit(ENGINE_ERROR), 1 + (k - 1) * SHARED_EVIDENCE)
    return T.round4(F.when(n > k, alone * (1 - DISSENT * (n - k) / n)).otherwise(alone))


def consensus_vote(slots: DataFrame) -> DataFrame:
    """Add ``agreed`` (the strict majority, agent order), ``consensus``, ``text``, ``confidence``.

    The majority is over all valid readings of the page, so an engine without a candidate counts
    against. The text is that of the first agent in the winning group.
    """
    def supported(forms: Column) -> Column:
        def wins(_, i: Column) -> Column:
            support = F.size(F.filter(forms, lambda other: other == F.get(forms, i)))
            return (support >= 2) & (support * 2 > F.col("n"))

        return F.filter("candidates", wins)

    # A one-element wrapper binds the forms: a filter on the result would otherwise be pushed down with the forms
    # written out inside its loops, to be made once a pair of candidates.
    forms = F.transform("candidates", lambda c: T.visible_form(c["text"]))
    voted = slots.withColumn("agreed", F.element_at(F.transform(F.array(forms), supported), 1))
    k = F.size("agreed")
    return (
        voted.withColumn("consensus", k > 0)
        .withColumn("text", F.when(k > 0, F.element_at("agreed", 1)["text"]))
        .withColumn("confidence", F.when(k > 0, consensus_confidence(k, F.col("n"))))
    )


def medoid(candidates: str | Column) -> Column:
    """Struct ``agent, text, score``: the candidate closest to the others; ties go to the first agent.

    ``score`` is the sum of its similarities to the other candidates.
    """
    candidates = T.col(candidates)
    profile = F.transform(
        F.transform(
            candidates,
            lambda c: F.struct(c["agent"].alias("agent"), c["text"].alias("text"), T.core_form(c["text"]).alias("core")),
        ),
        lambda c: F.struct(c["agent"], c["text"], c["core"], T.gram_codes(c["core"]).alias("grams")),
    )

    def alike(one: Column, other: Column) -> Column:
        return F.when(
            other["agent"] != one["agent"], T.jaccard(one["core"], one["grams"], other["core"], other["grams"])
        ).otherwise(0.0)

    def compared(everyone: Column) -> Column:
        # A pair is compared once: a candidate has its similarities to those after it.
        return F.transform(
            everyone,
            lambda one, i: F.struct(
                one["agent"].alias("agent"),
                one["text"].alias("text"),
                F.transform(F.slice(everyone, i + 2, F.size(everyone)), lambda other: alike(one, other)).alias("after"),
            ),
        )

    def score(everyone: Column, i: Column) -> Column:
        def of(j: Column) -> Column:
            first, second = F.least(i, j), F.greatest(i, j)
            return F.when(i == j, 0.0).otherwise(F.get(F.get(everyone, first)["after"], second - first - 1))

        return F.aggregate(
            F.sequence(F.lit(0), F.size(everyone) - 1), F.lit(0.0), lambda total, j: total + of(j)
        )

    def chosen(everyone: Column) -> Column:
        return F.array_max(
            F.transform(
                everyone,
                lambda one, i: F.struct(
                    score(everyone, i).alias("score"), (-i).alias("rank"), one["agent"].alias("agent"), one["text"].alias("text")
                ),
            )
        )

    # Bound at each step, so that nothing is made again for each pair.
    best = T.bound(profile, lambda everyone: T.bound(compared(everyone), chosen))
    # Bound too: three fields of an expression under a condition would be three evaluations of it.
    return T.bound(
        best, lambda b: F.struct(b["agent"].alias("agent"), b["text"].alias("text"), b["score"].alias("score"))
    )


def slot_medoid(slots: DataFrame) -> DataFrame:
    return slots.withColumn("medoid", medoid("candidates"))


def fallback_confidence(size: Column, score: Column) -> Column:
    mean = F.try_divide(score, (size - 1).cast("double"))
    return T.round4(
        F.when(size < 2, FALLBACK_LONE).otherwise(FALLBACK_FLOOR + FALLBACK_SPAN * mean)
    )


def merge_candidates(slots: str | Column) -> Column:
    """An array of (slot, candidates) to the candidates of the whole: each agent's texts joined in slot order."""
    every = F.flatten(F.transform(F.array_sort(T.col(slots)), lambda s: s["candidates"]))

    def of_agent(everyone: Column, agent: Column) -> Column:
        own = F.filter(everyone, lambda c: c["agent"] == agent)
        return F.struct(agent.alias("agent"), F.array_join(F.transform(own, lambda c: c["text"]), "").alias("text"))

    merged = F.transform(
        F.array(every),
        lambda everyone: F.transform(
            F.array_sort(F.array_distinct(F.transform(everyone, lambda c: c["agent"]))), lambda agent: of_agent(everyone, agent)
        ),
    )
    return F.element_at(merged, 1)


def dispute_blocks(voted: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per maximal run of adjacent slots without consensus.

    ``segment`` is its first slot; ``before``/``after`` are the consensus texts in the slots next to it. A region has
    the ordinal of the agreed slot before it, and the one after it the next ordinal; so regions and their neighbours
    meet in one grouping. Agreed slots between agreed ones are left out before it.
    """
    keys = list(keys)
    lean = voted.select(
        *keys,
        "slot",
        "consensus",
        F.when(~F.col("consensus"), F.col("candidates")).alias("candidates"),
        F.when(F.col("consensus"), F.col("text")).alias("text"),
    )
    scanned = ordered.two_pass(
        lean,
        keys,
        ["slot"],
        ordered.bucket_of("slot"),
        {
            "ordinal": lambda w: F.sum(F.col("consensus").cast("long")).over(ordered.up_to(w)),
            "_open_before": lambda w: F.lag(~F.col("consensus"), 1).over(w),
            "_open_after": lambda w: F.lead(~F.col("consensus"), 1).over(w),
        },
        {"_total": F.sum(F.col("consensus").cast("long"))},
        {"_carried": lambda w: F.sum("_total").over(ordered.before(w))},
    )
    ordinal = F.col("ordinal") + F.coalesce("_carried", F.lit(0))
    # At the edge of a bucket the neighbour is not seen, so the slot is kept.
    parts = {
        "open": (~F.col("consensus") & (F.size("candidates") > 0), ordinal),
        "before": (F.col("consensus") & F.coalesce("_open_after", F.lit(True)), ordinal),
        "after": (F.col("consensus") & F.coalesce("_open_before", F.lit(True)), ordinal - 1),
    }
    told = F.array(
        *(F.struct(F.lit(name).alias("part"), F.when(wanted, at).alias("at")) for name, (wanted, at) in parts.items())
    )
    rows = scanned.select(*keys, "slot", "candidates", "text", F.explode(told).alias("p")).filter("p.at IS NOT NULL")

    def of(part: str, value: Column) -> Column:
        return F.when(F.col("p.part") == part, value)

    def next_to(name: str, slot: Column) -> Column:
        return F.when(F.col(name)["slot"] == slot, F.coalesce(F.col(name)["text"], F.lit(""))).otherwise("").alias(name)

    regions = rows.groupBy(*keys, "p.at").agg(
        F.collect_list(of("open", F.struct("slot", "candidates"))).alias("slots"),
        F.min(of("open", F.col("slot"))).alias("segment"),
        F.max(of("open", F.col("slot"))).alias("last_slot"),
        F.max(of("before", F.struct("slot", "text"))).alias("before"),
        F.max(of("after", F.struct("slot", "text"))).alias("after"),
    )
    return regions.filter("segment IS NOT NULL").select(
        *keys,
        "segment",
        "last_slot",
        next_to("before", F.col("segment") - 1),
        next_to("after", F.col("last_slot") + 1),
        merge_candidates("slots").alias("candidates"),
    )
