"""Checked queries over readings, slots, regions and segments."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as Q
from variorum.functions import text as T
from variorum.operators import align, assemble, dedupe, readings as R, resolve, similar, texts, votes
from variorum.plans import fuse as X
from variorum.session import ship_package, stage, unstage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def _voted(spark: SparkSession, sf: str) -> DataFrame:
    """Votes as the steps after them read them: of an agreed slot its text and agents, of another its candidates."""
    voted = votes.consensus_vote(I.slots(spark, sf))
    return stage(
        voted.select(
            "page_id",
            "slot",
            "consensus",
            "text",
            "confidence",
            F.transform("agreed", lambda c: F.struct(c["agent"].alias("agent"))).alias("agreed"),
            F.when(~F.col("consensus"), F.col("candidates")).alias("candidates"),
        ),
        "voted",
    )


def _outcomes(spark: SparkSession, sf: str):
    voted = _voted(spark, sf)
    disputes = stage(votes.dispute_blocks(voted), "disputes")
    outcomes = resolve.apply_resolutions(disputes, I.answers_for(spark, sf)(disputes))
    return voted, disputes, outcomes


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each step is written once and removed when the next one is: numbering reads its rows twice, and would choose
    the local texts twice."""
    voted, disputes, outcomes = _outcomes(spark, sf)
    outcomes = stage(outcomes, "outcomes")
    unstage(disputes)
    segments = stage(assemble.final_segments(voted, outcomes), "segments")
    unstage(voted, outcomes)
    return segments


# Text jobs


@check(
    "p1_clean_layout",
    f"SELECT doc_id, {Q.clean('text')} AS cleaned FROM documents",
)
def p1(spark, sf):
    docs = I.table(spark, sf, "documents").select("doc_id", "text")
    return texts.clean_layout(docs, "text", "cleaned").select("doc_id", "cleaned")


@check(
    "p2_segment",
    Q.query(
        f"t AS (SELECT doc_id, {Q.segments('text')} AS s FROM documents)",
        "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos, unnest(s) AS segment FROM t",
    ),
)
def p2(spark, sf):
    docs = I.table(spark, sf, "documents")
    return texts.segment(docs, ["doc_id"], "text").select("doc_id", F.col("pos").cast("long").alias("pos"), "segment")


@check(
    "p3_p4_text_forms",
    f"SELECT doc_id, {Q.visible('text')} AS visible, {Q.core('text')} AS core FROM documents",
)
def p3(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", T.visible_form("text").alias("visible"), T.core_form("text").alias("core")
    )


@check(
    "p5_shingle",
    Q.query(
        Q.SENT_ARRAYS + f", g AS (SELECT page_id, pos, unnest({Q.grams(Q.core('seg'))}) AS gram FROM sent)",
        "SELECT gram, count(*) AS segments, count(DISTINCT page_id) AS pages FROM g GROUP BY gram",
    ),
)
def p5(spark, sf):
    grams = texts.shingle(I.sentences(spark, sf), ["page_id", "pos"], "seg")
    # Pre-aggregated per page: no distinct count has to gather a common gram in one task.
    per_page = grams.groupBy("gram", "page_id").agg(F.count(F.lit(1)).alias("segments"))
    return per_page.groupBy("gram").agg(F.sum("segments").alias("segments"), F.count(F.lit(1)).alias("pages"))


_READINGS = Q.CAND_LOSSY + """,
asked AS (SELECT page_id, unnest(CASE WHEN lang = 'fr' THEN ['a', 'b', 'c', 'd', 'e'] ELSE ['a', 'b', 'c', 'd'] END) AS agent,
                 source FROM docs),
readings AS (SELECT q.page_id, q.agent,
                    CASE WHEN q.agent = 'd' AND source = 'src7' THEN 'timeout' ELSE '' END AS err,
                    CASE WHEN q.agent = 'e' THEN '  ' || chr(10)
                         ELSE coalesce(string_agg(c.text, ' ' ORDER BY c.slot), '') END AS text
             FROM asked q LEFT JOIN cand c ON c.page_id = q.page_id AND c.agent = q.agent
             GROUP BY q.page_id, q.agent, source)"""


@check(
    "p6_reading_counts",
    Q.query(
        _READINGS,
        f"""SELECT page_id, count(*) AS engines, count(*) FILTER (WHERE err <> '') AS failed_engines,
        count(*) FILTER (WHERE err = '' AND {Q.trim('text')} <> '') AS n FROM readings GROUP BY page_id""",
    ),
)
def p6(spark, sf):
    return R.reading_counts(I.readings(spark, sf))


@check(
    "p8_estimate_tokens",
    f"SELECT lang, source, CAST(sum({Q.tokens('text')}) AS BIGINT) AS tokens FROM documents GROUP BY lang, source",
)
def p8(spark, sf):
    return texts.estimate_tokens(I.table(spark, sf, "documents"), "text", ["lang", "source"])


@check("p9_preview", "SELECT doc_id, right(text, 2000) AS tail FROM documents")
def p9(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.preview("text").alias("tail"))


@check(
    "p10_split_list",
    f"""SELECT doc_id, CAST(len(parts) AS INTEGER) AS items, array_to_string(parts, '|') AS joined FROM (
    SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda p: {Q.trim('p')}), lambda p: p <> '') AS parts
    FROM documents)""",
)
def p10(spark, sf):
    split = texts.split_list(I.table(spark, sf, "documents"), "text", "parts")
    return split.select("doc_id", F.size("parts").alias("items"), F.array_join("parts", "|").alias("joined"))


@check(
    "p7_strip_fences",
    Q.query(
        f"""raw AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '```text' || chr(10) || text || chr(10) || '```'
                    WHEN turn = 1 THEN ' ```' || text || '```' ELSE text END AS text FROM conversations),
        t AS (SELECT conv_id, turn, {Q.trim('text')} AS x FROM raw),
        body AS (SELECT *, substr(x, strpos(x, chr(10)) + 1) AS b FROM t)""",
        f"""SELECT conv_id, turn, CASE WHEN NOT starts_with(x, '```') THEN x WHEN strpos(x, chr(10)) = 0 THEN ''
        ELSE {Q.trim("regexp_replace(b, '(?s)^(.*)```.*$', chr(92) || '1')")} END AS answer FROM body""",
    ),
)
def p7(spark, sf):
    fence = "```"
    raw = I.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", F.concat(F.lit(f"{fence}text\n"), F.col("text"), F.lit(f"\n{fence}")))
        .when(F.col("turn") == 1, F.concat(F.lit(f" {fence}"), F.col("text"), F.lit(fence)))
        .otherwise(F.col("text"))
        .alias("answer"),
    )
    return texts.strip_fences(raw, "answer")


# Votes and regions


@check(
    "a1_a4_consensus_vote",
    Q.query(Q.CAND_LOSSY + "," + Q.VOTES, "SELECT page_id, slot, text, froms, confidence FROM agreed"),
)
def a1(spark, sf):
    return (
        votes.consensus_vote(votes.gather_slots(I.candidate_rows(spark, sf)))
        .filter("consensus")
        .select("page_id", "slot", "text", F.array_join("agreed.agent", "|").alias("froms"), "confidence")
    )


@check(
    "a2_slot_medoid",
    Q.query(
        Q.CAND_LOSSY + ", merged AS (SELECT page_id, slot AS segment, agent, text FROM cand)," + Q.MEDOID,
        "SELECT page_id, segment AS slot, agent, round(score, 9) AS score FROM local",
    ),
)
def a2(spark, sf):
    return votes.slot_medoid(votes.gather_slots(I.candidate_rows(spark, sf))).select(
        "page_id", "slot", "medoid.agent", F.round("medoid.score", 9).alias("score")
    )


@check(
    "w1_w2_a3_dispute_blocks",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES,
        "SELECT page_id, segment, last_slot, before, after, candidates FROM disputes",
    ),
)
def w1(spark, sf):
    voted = _voted(spark, sf)
    return votes.dispute_blocks(voted).withColumn("candidates", I.flat_candidates())


@check(
    "a5_fallback",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES + "," + Q.MEDOID,
        "SELECT page_id, segment, agent, text, confidence FROM local",
    ),
)
def a5(spark, sf):
    voted = _voted(spark, sf)
    chosen = resolve.apply_resolutions(votes.dispute_blocks(voted), None)
    return chosen.select("page_id", "segment", F.element_at("from", 1).alias("agent"), "text", "confidence")


# Resolutions


@check(
    "j3_j4_apply_resolutions",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        "SELECT page_id, segment, outcome, text, confidence, froms FROM outcomes",
    ),
)
def j3(spark, sf):
    _, _, outcomes = _outcomes(spark, sf)
    return outcomes.select(
        "page_id", "segment", "outcome", "text", "confidence", F.array_join("from", "|").alias("froms")
    )


@check("j3_repeated_answers", SQL["j3_j4_apply_resolutions"])
def j3_repeated(spark, sf):
    """Each region is answered twice, first wrongly; the later answer counts."""
    disputes = stage(votes.dispute_blocks(_voted(spark, sf)), "disputes")
    answers = I.answers_for(spark, sf)(disputes)
    first = answers.withColumn("text", F.concat(F.lit("zzz "), "text")).withColumn("seq", F.lit(1))
    both = answers.withColumn("seq", F.lit(2)).unionByName(first)
    return resolve.apply_resolutions(disputes, both).select(
        "page_id", "segment", "outcome", "text", "confidence", F.array_join("from", "|").alias("froms")
    )


@check(
    "j4_corroborate",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        f"""SELECT a.page_id, a.segment, a.text,
        CASE WHEN EXISTS (SELECT 1 FROM merged m WHERE m.page_id = a.page_id AND m.segment = a.segment
             AND {Q.visible('m.text')} = {Q.visible('a.text')}) THEN 0.95::DOUBLE ELSE 0.80::DOUBLE END AS confidence FROM answers a""",
    ),
)
def j4(spark, sf):
    disputes = stage(votes.dispute_blocks(_voted(spark, sf)), "disputes")
    answers = I.answers_for(spark, sf)(disputes)
    # Answers to regions nobody asked about must vanish.
    stray = answers.withColumn("segment", -F.col("segment") - 1)
    return resolve.corroborate(disputes, answers.unionByName(stray), "arbiter").drop("from")


_ANSWER_TEXT = """
lines AS (SELECT page_id, pos, '#' || pos || ' ' || seg AS line FROM sent
          UNION ALL SELECT page_id, pos, '#' || pos || '.5 units' FROM sent
          UNION ALL SELECT page_id, pos + 1000000, '#' || pos || CASE WHEN length(seg) > 80 THEN chr(9) || 'again ' || seg ELSE '' END
          FROM sent WHERE seg LIKE '%ea%'),
asked AS (SELECT page_id, pos AS segment FROM sent WHERE seg LIKE '%th%' OR seg LIKE '%ea%')"""


def _answer_tables(spark, sf):
    sents = I.sentences(spark, sf)
    number = F.concat(F.lit("#"), F.col("pos").cast("string"))
    line = F.struct(
        F.col("pos").cast("long").alias("at"),
        F.concat(number, F.lit(" "), F.col("seg"), F.lit("\n"), number, F.lit(".5 units")).alias("line"),
    )
    again = F.struct(
        (F.col("pos") + 1000000).cast("long").alias("at"),
        F.concat(
            number, F.when(F.char_length("seg") > 80, F.concat(F.lit("\tagain "), F.col("seg"))).otherwise("")
        ).alias("line"),
    )
    every = F.when(F.col("seg").contains("ea"), F.array(line, again)).otherwise(F.array(line))
    answers = (
        sents.select("page_id", F.explode(every).alias("x"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list("x")).alias("x"))
        .select("page_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("text"))
    )
    asked = sents.filter(F.col("seg").contains("th") | F.col("seg").contains("ea")).select(
        "page_id", F.col("pos").cast("long").alias("segment")
    )
    return answers, asked


@check(
    "p14_parse_resolutions",
    Q.query(
        Q.SENT_ARRAYS + "," + _ANSWER_TEXT
        + rf""",
        parsed AS (SELECT page_id, pos AS spot, CAST(regexp_extract(line, '^#([0-9]+)', 1) AS BIGINT) AS segment,
                   {Q.trim("regexp_extract(line, '^#[0-9]+(.*)$', 1)")} AS text
                   FROM lines WHERE regexp_matches(line, '^#[0-9]+([ \t].*)?$'))""",
        """SELECT p.page_id, p.segment, arg_max(text, spot) AS text FROM parsed p
        JOIN asked a ON a.page_id = p.page_id AND a.segment = p.segment GROUP BY p.page_id, p.segment""",
    ),
)
def p14(spark, sf):
    answers, asked = _answer_tables(spark, sf)
    return resolve.parse_resolutions(answers, asked)[0]


@check(
    "p14_answer_errors",
    Q.query(
        Q.SENT_ARRAYS,
        """SELECT page_id, 'no usable #<region> line' AS error FROM arr
        WHERE len(sents) > 0 AND len(list_filter(sents, lambda s: contains(s, 'th') OR contains(s, 'ea'))) = 0""",
    ),
)
def p14_errors(spark, sf):
    answers, asked = _answer_tables(spark, sf)
    return resolve.parse_resolutions(answers, asked)[1].select("page_id", "error")


@check(
    "u2_uncovered",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        """SELECT d.page_id, d.segment FROM disputes d
        WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.page_id = d.page_id AND a.segment = d.segment)""",
    ),
)
def u2(spark, sf):
    disputes = stage(votes.dispute_blocks(_voted(spark, sf)), "disputes")
    return resolve.uncovered(disputes, I.answers_for(spark, sf)(disputes)).select("page_id", "segment")


_QUOTED = "CAST(to_json({x}) AS VARCHAR)"


@check(
    "p16_dispute_prompts",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES
        + f""",
        lines AS (SELECT page_id, segment, string_agg('* ' || {_QUOTED.format(x='agent')} || ' has '
                  || {_QUOTED.format(x='text')} || chr(10), '' ORDER BY agent) AS body FROM merged GROUP BY page_id, segment),
        parts AS (SELECT d.page_id, d.segment, chr(10) || '#' || d.segment
                  || CASE WHEN before <> '' OR after <> '' THEN ', after ' || {_QUOTED.format(x='before')} || ', before '
                     || {_QUOTED.format(x='after')} ELSE '' END || ':' || chr(10) || body AS part
                  FROM disputes d JOIN lines l ON l.page_id = d.page_id AND l.segment = d.segment)""",
        """SELECT page_id, 'The readings differ in ' || count(*) || ' places.' || chr(10)
        || string_agg(part, '' ORDER BY segment) || chr(10)
        || 'Answer with a line "#<number> <text>" for each place.' AS prompt FROM parts GROUP BY page_id""",
    ),
)
def p16(spark, sf):
    return resolve.build_dispute_prompts(votes.dispute_blocks(_voted(spark, sf)))


@check(
    "p20_validate_disputes",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES,
        """SELECT doc_id AS page_id, count(segment) AS regions, count(*) FILTER (WHERE segment < 3) AS bad_regions,
        CASE WHEN count(segment) > 200 THEN 'too many regions' WHEN count(segment) = 0 THEN 'no regions' ELSE 'bad region' END AS violation
        FROM documents LEFT JOIN disputes ON page_id = doc_id GROUP BY doc_id
        HAVING count(segment) > 200 OR count(segment) = 0 OR count(*) FILTER (WHERE segment < 3) > 0""",
    ),
)
def p20(spark, sf):
    disputes = votes.dispute_blocks(_voted(spark, sf))
    pages = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
    # Shifted by three, so the regions at the very start of a page are invalid numbers.
    return resolve.validate_disputes(disputes.withColumn("segment", F.col("segment") - 3), requests=pages)


# Segments and pages


@check(
    "a6_assemble_pages",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        f"""SELECT page_id, string_agg(text, chr(10) ORDER BY idx) AS text, {Q.round4(Q.mean('confidence', 'idx'))} AS confidence,
        count(*) AS segments FROM segs GROUP BY page_id""",
    ),
)
def a6(spark, sf):
    return assemble.assemble_pages(_segments(spark, sf))


@check(
    "a7_fusion_stats",
    Q.query(
        _READINGS + "," + Q.FUSED
        + """,
        ag AS (SELECT page_id, count(*) AS c FROM agreed GROUP BY page_id),
        oc AS (SELECT page_id, count(*) AS r, count(*) FILTER (WHERE outcome <> 'fallback') AS e,
               count(*) FILTER (WHERE outcome = 'fallback') AS f, count(*) FILTER (WHERE outcome = 'dropped') AS d
               FROM outcomes GROUP BY page_id)""",
        """SELECT r.page_id, count(*) AS engines, count(*) FILTER (WHERE err <> '') AS failed_engines,
        coalesce(any_value(c), 0) + coalesce(any_value(oc.r), 0) AS segments, coalesce(any_value(c), 0) AS consensus_segments,
        coalesce(any_value(e), 0) AS escalated_segments, coalesce(any_value(f), 0) AS fallback_segments,
        coalesce(any_value(d), 0) AS dropped_segments
        FROM readings r LEFT JOIN ag ON ag.page_id = r.page_id LEFT JOIN oc ON oc.page_id = r.page_id GROUP BY r.page_id""",
    ),
)
def a7(spark, sf):
    voted, _, outcomes = _outcomes(spark, sf)
    return assemble.fusion_stats(I.readings(spark, sf), voted, stage(outcomes, "outcomes"))


@check(
    "a9_a10_segment_counts",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        """SELECT page_id, count(*) FILTER (WHERE disputed AND source = 'fallback') AS pending_disputes,
        count(*) FILTER (WHERE source = 'consensus') AS consensus, count(*) FILTER (WHERE source = 'escalated') AS escalated,
        count(*) FILTER (WHERE source = 'fallback') AS fallback, count(*) FILTER (WHERE source = 'user') AS user
        FROM segs GROUP BY page_id""",
    ),
)
def a9(spark, sf):
    segments = _segments(spark, sf)
    return assemble.pending_disputes(segments).join(assemble.source_counts(segments), "page_id")


_EDITED = Q.FUSED + f""",
edited AS (SELECT page_id, idx, disputed, candidates,
    CASE WHEN NOT disputed THEN text WHEN source = 'fallback' AND length(text) > 80 THEN ''
         WHEN source = 'fallback' THEN regexp_extract(candidates, '^[a-z]=([^|]*)', 1)
         WHEN text LIKE '%!' THEN text || '?' ELSE text END AS text,
    CASE WHEN disputed AND source = 'escalated' AND text LIKE '%!' THEN 0.95 ELSE confidence END AS confidence,
    CASE WHEN disputed AND source = 'fallback' THEN 'user' ELSE source END AS source,
    CASE WHEN disputed AND source = 'fallback' AND length(text) > 80 THEN '用户编辑'
         WHEN disputed AND source = 'fallback' THEN substr(candidates, 1, 1)
         WHEN disputed AND text LIKE '%!' THEN 'second' ELSE froms END AS froms
    FROM segs)"""


def _edits(segments: DataFrame) -> DataFrame:
    """A reviewer takes the first candidate of short open regions, empties the long ones, and has
    the uncorroborated answers arbitrated again."""
    open_region = F.col("source") == "fallback"
    again = (F.col("source") == "escalated") & F.col("text").endswith("!")
    kind = (
        F.when(open_region & (F.char_length("text") > 80), "edit")
        .when(open_region, "candidate")
        .when(again, "arbitration")
    )
    first = F.element_at("candidates", 1)
    return (
        segments.filter("disputed")
        .withColumn("kind", kind)
        .filter("kind IS NOT NULL")
        .select(
            "page_id",
            "idx",
            "kind",
            F.when(F.col("kind") == "candidate", first["agent"]).when(F.col("kind") == "arbitration", "second").alias("agent"),
            F.when(F.col("kind") == "candidate", first["text"])
            .when(F.col("kind") == "edit", "  ")
            .otherwise(F.concat("text", F.lit("?")))
            .alias("text"),
            F.lit(0.95).alias("confidence"),
        )
    )


@check(
    "j7_apply_edits",
    Q.query(
        Q.CAND_LOSSY + "," + _EDITED,
        "SELECT page_id, idx, text, confidence, source, froms FROM edited",
    ),
)
def j7(spark, sf):
    segments = _segments(spark, sf)
    return assemble.apply_edits(segments, _edits(segments)).select(
        "page_id", "idx", "text", "confidence", "source", F.array_join("from", "|").alias("froms")
    )


@check("j7_repeated_edits", SQL["j7_apply_edits"])
def j7_repeated(spark, sf):
    """Each edited segment was edited before; the later edit counts."""
    segments = _segments(spark, sf)
    edits = _edits(segments)
    first = edits.withColumn("kind", F.lit("edit")).withColumn("text", F.lit("zzz")).withColumn("seq", F.lit(1))
    return assemble.apply_edits(segments, first.unionByName(edits.withColumn("seq", F.lit(2)))).select(
        "page_id", "idx", "text", "confidence", "source", F.array_join("from", "|").alias("froms")
    )


@check(
    "a11_visible_summary",
    Q.query(
        Q.CAND_LOSSY + "," + _EDITED,
        f"""SELECT page_id, coalesce(string_agg({Q.trim('text')}, chr(10) ORDER BY idx) FILTER (WHERE {Q.trim('text')} <> ''), '') AS text,
        round(coalesce(avg(confidence) FILTER (WHERE {Q.trim('text')} <> ''), 0), 9) AS confidence FROM edited GROUP BY page_id""",
    ),
)
def a11(spark, sf):
    segments = _segments(spark, sf)
    summary = assemble.visible_summary(assemble.apply_edits(segments, _edits(segments)))
    return summary.withColumn("confidence", F.round("confidence", 9))


@check(
    "w3_review_anchors",
    Q.query(
        Q.CAND_LOSSY + "," + _EDITED
        + f""",
        shown AS (SELECT page_id, idx, disputed, candidates, CASE WHEN {Q.trim('text')} <> '' THEN text END AS s FROM edited),
        a AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
              first_value(s IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f
              FROM shown)""",
        "SELECT page_id, idx AS segment, coalesce(b, '') AS before, coalesce(f, '') AS after, candidates FROM a WHERE disputed",
    ),
)
def w3(spark, sf):
    segments = _segments(spark, sf)
    edited = stage(assemble.apply_edits(segments, _edits(segments)), "edited")
    return assemble.review_anchors(edited).withColumn("candidates", I.flat_candidates())


# Repeats


def _repeated(spark, sf) -> DataFrame:
    """Segments in which merging repeated text: after a sentence with "ea" comes a disputed copy.

    The copy is exact, has its last letters changed, or is the tail of the sentence, by content.
    """
    first = F.struct(
        F.lit(0).alias("part"), F.col("seg").alias("text"), F.lit(0.9239).alias("confidence"), F.lit("consensus").alias("source")
    )
    copy = (
        F.when(F.col("seg").contains("th"), F.col("seg"))
        .when(F.col("seg").contains("an"), F.concat(F.col("seg"), F.lit("x")))
        .when(F.col("seg").contains("é"), F.expr("substring(seg, 6)"))
        .otherwise(F.replace("seg", F.lit("e"), F.lit("o")))
    )
    again = F.struct(
        F.lit(1).alias("part"), copy.alias("text"), F.lit(0.25).alias("confidence"), F.lit("fallback").alias("source")
    )
    rows = I.sentences(spark, sf).select(
        "page_id",
        "pos",
        F.explode(F.when(F.col("seg").contains("ea"), F.array(first, again)).otherwise(F.array(first))).alias("r"),
    )
    flat = rows.select("page_id", (F.col("pos") * 2 + F.col("r.part")).alias("at"), "r.text", "r.confidence", "r.source")
    from variorum.operators import ordered

    numbered = ordered.number_rows(flat, ["page_id"], ["at"], ordered.bucket_of("at"), "idx")
    return stage(numbered.drop("at").withColumn("disputed", F.col("source") == "fallback"), "repeated")


_REPEATED = """
rep AS (SELECT page_id, pos * 2 AS spot, seg AS text, 0.9239::DOUBLE AS confidence, 'consensus' AS source FROM sent
        UNION ALL
        SELECT page_id, pos * 2 + 1, CASE WHEN seg LIKE '%th%' THEN seg WHEN seg LIKE '%an%' THEN seg || 'x'
               WHEN seg LIKE '%é%' THEN substr(seg, 6) ELSE replace(seg, 'e', 'o') END, 0.25, 'fallback'
        FROM sent WHERE seg LIKE '%ea%'),
segs AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY spot) - 1 AS idx, text, confidence, source,
                source = 'fallback' AS disputed FROM rep)"""


@check(
    "j5_validate_proposals",
    Q.query(Q.SENT_ARRAYS + "," + _REPEATED + "," + Q.REPEATS, "SELECT page_id, later, earlier FROM valid"),
)
def j5(spark, sf):
    segments = _repeated(spark, sf)
    return dedupe.validate_proposals(segments, dedupe.propose_nearby(segments))


@check(
    "j6_drop_duplicates",
    Q.query(
        Q.SENT_ARRAYS + "," + _REPEATED + "," + Q.REPEATS
        + ", gone AS (SELECT page_id, count(DISTINCT later) AS g FROM valid GROUP BY page_id)",
        f"""SELECT p.page_id, coalesce(string_agg(k.text, chr(10) ORDER BY k.nidx), '') AS text,
        coalesce({Q.round4(Q.mean('k.confidence', 'k.nidx'))}, 0) AS confidence, coalesce(any_value(g), 0) AS duplicate_segments
        FROM (SELECT DISTINCT page_id FROM segs) p LEFT JOIN kept k ON k.page_id = p.page_id
        LEFT JOIN gone ON gone.page_id = p.page_id GROUP BY p.page_id""",
    ),
)
def j6(spark, sf):
    segments = _repeated(spark, sf)
    valid = stage(dedupe.validate_proposals(segments, dedupe.propose_nearby(segments)), "valid")
    return dedupe.deduplicated_pages(segments, valid)


@check(
    "p15_parse_proposals",
    Q.query(
        Q.SENT_ARRAYS,
        """SELECT page_id, pos AS later, CASE WHEN seg LIKE '%ea%' THEN pos - 2 ELSE pos - 1 END AS earlier
        FROM sent WHERE pos >= 2 AND (seg LIKE '%th%' OR seg LIKE '%ea%')""",
    ),
)
def p15(spark, sf):
    return dedupe.parse_proposals(_proposal_answers(spark, sf))[0]


def _proposal_answers(spark, sf):
    """Pages answer with good lines, a repeated number, and lines that are no proposal."""
    sents = I.sentences(spark, sf)
    pos = F.col("pos")
    pair = F.concat(F.lit("#"), pos.cast("string"), F.lit(" -> #"))
    lines = F.concat(
        F.lit(" "),
        F.when(F.col("seg").contains("ea"), F.concat(pair, (pos - 2).cast("string"), F.lit("\n"))).otherwise(""),
        F.when(
            F.col("seg").contains("th") | F.col("seg").contains("ea"),
            F.concat(pair, (pos - 1).cast("string"), F.lit(" \n")),
        ).otherwise(""),
        F.lit("#"), pos.cast("string"), F.lit(" => #0\n"), F.lit("see "), pair, F.lit("1 there"),
    )
    body = (
        sents.filter(pos >= 2)
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", lines.alias("l")))).alias("x"))
        .select("page_id", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("body"))
    )
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id")).join(body, "page_id", "left").select(
        "page_id", F.coalesce("body", F.lit("```\nNone\n```")).alias("text")
    )


@check(
    "p15_proposal_errors",
    Q.query(
        Q.SENT_ARRAYS,
        """SELECT page_id, 'no NONE and no #<later> -> #<earlier> line' AS error FROM sent WHERE pos >= 2 GROUP BY page_id
        HAVING count(*) FILTER (WHERE seg LIKE '%th%' OR seg LIKE '%ea%') = 0""",
    ),
)
def p15_errors(spark, sf):
    return dedupe.parse_proposals(_proposal_answers(spark, sf))[1].select("page_id", "error")


@check(
    "p16_duplicate_prompts",
    Q.query(
        Q.CAND_LOSSY + "," + Q.FUSED,
        f"""SELECT page_id, 'The page in ' || count(*) || ' numbered pieces:' || chr(10)
        || string_agg('#' || idx || ' ' || {_QUOTED.format(x='text')} || chr(10), '' ORDER BY idx)
        || chr(10) || 'Answer with a line "#<repeat> -> #<first>" for each repeat, or with NONE.' AS prompt FROM segs GROUP BY page_id""",
    ),
)
def p16_duplicates(spark, sf):
    return dedupe.build_duplicate_prompts(_segments(spark, sf))


# Similarity, alignment and the whole fusion


def _similar_sql(floor):
    return Q.query(
        Q.SENT_ARRAYS
        + f""",
        cores AS (SELECT page_id, {Q.core('seg')} AS core, count(*) AS copies FROM sent GROUP BY ALL),
        prof AS (SELECT *, {Q.grams('core')} AS g FROM cores)""",
        f"""SELECT page_id, left_core, right_core, copies_left, copies_right, round(s, 9) AS similarity FROM (
        SELECT x.page_id, x.core AS left_core, y.core AS right_core, x.copies AS copies_left, y.copies AS copies_right,
               CAST({Q.jaccard('x', 'y')} AS DOUBLE) AS s
        FROM prof x JOIN prof y ON x.page_id = y.page_id AND x.core < y.core
         AND least(len(x.g), len(y.g)) > {floor} * greatest(len(x.g), len(y.g))) WHERE s > {floor}""",
    )


@check("j1_similar_segments", _similar_sql(0.6))
def j1(spark, sf):
    found = similar.similar_segments(I.sentences(spark, sf), ["page_id"], "seg", floor=0.6)
    return found.withColumn("similarity", F.round("similarity", 9))


@check("j1_default_floor", _similar_sql(0.35))
def j1_default(spark, sf):
    found = similar.similar_segments(I.sentences(spark, sf), ["page_id"], "seg")
    return found.withColumn("similarity", F.round("similarity", 9))


@check(
    "j2_align_readings",
    Q.query(
        Q.CAND_PLAIN,
        """SELECT page_id, slot, any_value(n) AS n, string_agg(agent || '=' || text, '|' ORDER BY agent) AS candidates
        FROM cand JOIN nval USING (page_id) GROUP BY page_id, slot""",
    ),
)
def j2(spark, sf):
    ship_package(spark)
    aligned = align.align_readings(I.readings(spark, sf, lossy=False))
    return aligned.select("page_id", "slot", F.col("n").cast("long").alias("n"), I.flat_candidates().alias("candidates"))


_PLAIN_READINGS = _READINGS.replace(Q.CAND_LOSSY, Q.CAND_PLAIN)


@check(
    "j2_misread_alignment",
    Q.query(
        Q.CAND_LOSSY,
        """SELECT page_id, agent, string_agg(text, '' ORDER BY slot) AS text, any_value(n) AS n,
        CAST(0 AS BIGINT) AS crowded FROM cand JOIN nval USING (page_id) GROUP BY page_id, agent""",
    ),
)
def j2_misread(spark, sf):
    """Readings whose letters differ: whatever the slots are, each engine's candidates in slot order are its
    sentences, each once, and no slot has an engine twice (crowded)."""
    aligned = align.align_readings(I.readings(spark, sf)).select("page_id", "slot", "n", F.explode("candidates").alias("c"))
    one = aligned.groupBy("page_id", "slot", "c.agent", "n").agg(
        F.count(F.lit(1)).alias("copies"), F.min("c.text").alias("text")
    )
    said = F.array_sort(F.collect_list(F.struct("slot", "text")))
    return one.groupBy("page_id", "agent", F.col("n").cast("long").alias("n")).agg(
        F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"),
        F.count_if(F.col("copies") > 1).alias("crowded"),
    )


# From candidates and readings to page results.
FUSED_PAGES = Q.FUSED + "," + Q.REPEATS + """,
eng AS (SELECT page_id, count(*) AS engines, count(*) FILTER (WHERE err <> '') AS failed FROM readings GROUP BY page_id),
ag AS (SELECT page_id, count(*) AS c FROM agreed GROUP BY page_id),
oc AS (SELECT page_id, count(*) AS r, count(*) FILTER (WHERE outcome <> 'fallback') AS e,
       count(*) FILTER (WHERE outcome = 'fallback') AS f, count(*) FILTER (WHERE outcome = 'dropped') AS d
       FROM outcomes GROUP BY page_id),
gone AS (SELECT page_id, count(DISTINCT later) AS g FROM valid GROUP BY page_id),
pg AS (SELECT page_id, string_agg(text, chr(10) ORDER BY nidx) AS text, """ + Q.round4(Q.mean("confidence", "nidx")) + """ AS confidence
       FROM kept GROUP BY page_id)"""
PAGE_ROWS = """SELECT eng.page_id, engines, failed AS failed_engines, coalesce(c, 0) + coalesce(oc.r, 0) AS segments,
        coalesce(c, 0) AS consensus_segments, coalesce(e, 0) AS escalated_segments, coalesce(f, 0) AS fallback_segments,
        coalesce(d, 0) AS dropped_segments, 'arbiter' AS escalator, '' AS escalation_err, 'checker' AS duplicate_checker,
        '' AS duplicate_check_err, coalesce(text, '') AS text, coalesce(confidence, 0) AS confidence,
        coalesce(g, 0) AS duplicate_segments
        FROM eng LEFT JOIN ag USING (page_id) LEFT JOIN oc USING (page_id) LEFT JOIN gone USING (page_id) LEFT JOIN pg USING (page_id)"""


@check("x4_fuse", Q.query(_PLAIN_READINGS + "," + FUSED_PAGES, PAGE_ROWS))
def x4(spark, sf):
    ship_package(spark)
    readings = stage(I.readings(spark, sf, lossy=False), "readings")
    return X.fuse(readings, I.answers_for(spark, sf), dedupe.propose_nearby).pages


@check("x4_fuse_misread")
def x4_lossy(spark, sf):
    """Misread letters move sentences across the similarity floor; no SQL states that alignment."""
    ship_package(spark)
    readings = stage(I.readings(spark, sf), "readings")
    return X.fuse(readings, I.answers_for(spark, sf), dedupe.propose_nearby).pages


# The vote and the regions once more, from the slots that came out. Tables stand in braces, so others are doubled.
_BRACED = Q.W.replace("{", "{{").replace("}", "}}")
RECOUNT = rf"""
WITH cand AS (SELECT page_id, slot, n, c.agent, c.text FROM (SELECT page_id, slot, n, explode(candidates) AS c FROM {{voted}})),
grp AS (SELECT page_id, slot, regexp_replace(text, r'[{_BRACED}]+', '') AS form, max(n) AS n, count(*) AS k, min_by(text, agent) AS text
        FROM cand GROUP BY 1, 2, 3),
won AS (SELECT page_id, slot, k, text, {Q.round4(f"CASE WHEN n > k THEN {Q.K_CONF} * (1 - 0.5 * (n - k) / n) ELSE {Q.K_CONF} END")} AS confidence
        FROM grp WHERE k >= 2 AND 2 * k > n),
vote AS (SELECT v.page_id, count_if(v.consensus <> (w.k IS NOT NULL) OR NOT (v.text <=> w.text)
                                    OR NOT (v.confidence <=> CAST(w.confidence AS DOUBLE))) AS vote_differs
         FROM {{voted}} v LEFT JOIN won w ON w.page_id = v.page_id AND w.slot = v.slot GROUP BY v.page_id),
open AS (SELECT v.page_id, v.slot, v.slot - row_number() OVER (PARTITION BY v.page_id ORDER BY v.slot) AS run
         FROM {{voted}} v LEFT ANTI JOIN won w ON w.page_id = v.page_id AND w.slot = v.slot),
runs AS (SELECT page_id, min(slot) AS segment, max(slot) AS last_slot FROM open GROUP BY page_id, run),
region AS (SELECT page_id, count_if(NOT (d.last_slot <=> r.last_slot)) AS region_differs
           FROM {{disputes}} d FULL JOIN runs r USING (page_id, segment) GROUP BY page_id),
said AS (SELECT page_id, agent, max(n) AS n, array_join(transform(array_sort(collect_list(struct(slot, text))), x -> x.text), '') AS text,
                count(*) - count(DISTINCT slot) AS crowded FROM cand GROUP BY page_id, agent)
SELECT page_id, agent, CAST(n AS BIGINT) AS n, text, crowded, coalesce(vote_differs, 0) AS vote_differs,
       coalesce(region_differs, 0) AS region_differs
FROM said LEFT JOIN vote USING (page_id) LEFT JOIN region USING (page_id)"""


@check(
    "x4_misread_conserved",
    Q.query(
        Q.CAND_LOSSY,
        """SELECT page_id, agent, any_value(n) AS n, string_agg(text, '' ORDER BY slot) AS text, CAST(0 AS BIGINT) AS crowded,
        CAST(0 AS BIGINT) AS vote_differs, CAST(0 AS BIGINT) AS region_differs
        FROM cand JOIN nval USING (page_id) GROUP BY page_id, agent""",
    ),
)
def x4_conserved(spark, sf):
    """The fusion of misread readings, held to what is true of any alignment: each engine's candidates in slot order
    are its sentences, none twice in a slot; votes, confidences and regions are those of the slots that came out."""
    ship_package(spark)
    readings = stage(I.readings(spark, sf), "readings")
    fused = X.fuse(readings, I.answers_for(spark, sf))
    return spark.sql(RECOUNT, voted=fused.voted, disputes=fused.disputes)


@check(
    "x1_u1_providers",
    Q.query(
        f"""r AS (SELECT doc_id AS page_id, 'plain' AS agent, text, length(text) AS latency_ms, '' AS err FROM documents
        UNION ALL SELECT doc_id, 'upper', CASE WHEN lang = 'de' THEN '' ELSE translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END,
                  CASE WHEN lang = 'de' THEN 0 ELSE length(text) END, CASE WHEN lang = 'de' THEN 'no answer' ELSE '' END
        FROM documents)""",
        "SELECT page_id, agent, text, latency_ms, err FROM r",
    ),
)
def x1(spark, sf):
    pages = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang")

    def answer(text, keep):
        def provider(df):
            return df.filter(keep).select(
                "page_id", text.alias("text"), F.char_length("text").alias("latency_ms"), F.lit("").alias("err")
            )

        return provider

    readings, _ = X.read_pages(
        pages, {"upper": answer(F.translate("text", ascii_lowercase, ascii_uppercase), "lang <> 'de'"), "plain": answer(F.col("text"), "true")}
    )
    return readings


@check(
    "u1_repeated_agents",
    Q.query(
        "r AS (SELECT doc_id AS page_id, CASE WHEN lang = 'fr' THEN 'a' ELSE 'b' END AS agent FROM documents "
        "UNION ALL SELECT doc_id, 'a' FROM documents)",
        "SELECT page_id, agent, count(*) AS copies FROM r GROUP BY page_id, agent HAVING count(*) > 1",
    ),
)
def u1(spark, sf):
    docs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang", "text")
    one = docs.select("page_id", F.when(F.col("lang") == "fr", "a").otherwise("b").alias("agent"), "text")
    two = docs.select("page_id", F.lit("a").alias("agent"), "text")
    return R.collect_readings(one, two)[1]


@check(
    "x2_x3_deferred_and_failed",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES + "," + Q.MEDOID,
        """SELECT d.page_id, d.segment, CASE WHEN lang = 'fr' THEN 'escalated' ELSE 'fallback' END AS outcome
        FROM disputes d JOIN docs USING (page_id)""",
    ),
)
def x2(spark, sf):
    """An arbiter that fails on all but French pages: the failed pages fall back."""
    langs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang")

    def arbiter(disputes):
        return disputes.join(langs, "page_id").select(
            "page_id", "segment", F.lit("answer").alias("text"),
            F.when(F.col("lang") == "fr", "").otherwise("HTTP 500").alias("error"),
        )

    slots = stage(I.slots(spark, sf), "slots")
    return X.fuse_slots(slots, I.readings(spark, sf), arbiter).outcomes.select("page_id", "segment", "outcome")


@check(
    "x2_failed_arbiter_pages",
    Q.query(
        Q.CAND_LOSSY + "," + Q.VOTES,
        """SELECT doc_id AS page_id, 'arbiter' AS escalator,
        CASE WHEN lang <> 'fr' AND EXISTS (SELECT 1 FROM disputes d WHERE d.page_id = doc_id) THEN 'HTTP 500' ELSE '' END
        AS escalation_err, '' AS duplicate_checker, '' AS duplicate_check_err FROM documents""",
    ),
)
def x2_pages(spark, sf):
    """The page results name the arbiter, and its error where it failed."""
    langs = I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang")

    def arbiter(disputes):
        return disputes.join(langs, "page_id").select(
            "page_id", "segment", F.lit("answer").alias("text"),
            F.when(F.col("lang") == "fr", "").otherwise("HTTP 500").alias("error"),
        )

    slots = stage(I.slots(spark, sf), "slots")
    return X.fuse_slots(slots, I.readings(spark, sf), arbiter).pages.select(
        "page_id", "escalator", "escalation_err", "duplicate_checker", "duplicate_check_err"
    )


@check(
    "o1_engine_order",
    Q.query(
        _READINGS,
        """SELECT page_id, agent, row_number() OVER (PARTITION BY page_id ORDER BY agent) AS place FROM readings""",
    ),
)
def o1(spark, sf):
    ordered = R.engine_order(I.readings(spark, sf).select("page_id", "agent"))
    # At most one row per engine and page, so a plain window is bounded here.
    from pyspark.sql import Window

    return ordered.withColumn(
        "place", F.row_number().over(Window.partitionBy("page_id").orderBy("agent")).cast("long")
    )
