"""The operators of this package as queries over the given tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variorum.llm import bpe, chat, exact, near, packing, pages, quality, repair, substrings, token_counts, toxicity, warc, whitening


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the public tokenizers' files lie; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return packing.piece_digests(packing.pack(table(spark, folder, "documents"), path), packing.id_width(path))


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(table(spark, folder, "pages"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], given.schema)
    return chat.chat_digests(chat.format_chats(given.unionByName(extra)))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    edited = token_counts.drawn_edits(table(spark, folder, "documents"))
    counted = token_counts.count_and_recount(edited, "edits", tokenizer("byte_bpe_50k.json"))
    return counted.select(
        "doc_id", "n_tokens", "edited_tokens", "pre_tokens", "reencoded", F.sha2("edited_text", 256).alias("edited_sha256")
    )


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_duplicates(table(spark, folder, "documents"), shingle=3, percent=85, bands=48)
    return found.drop("text_hash")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


def op11_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_records(warc.archived(table(spark, folder, "pages")))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_reports(table(spark, folder, "conversations"), damaged=True)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_main_text": op3_main_text,
    "op4_chat_format": op4_chat_format,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_warc": op11_warc,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_RUNS = """run{n} AS (SELECT doc_id, i, array_to_string(words[i : i + {n} - 1], ' ') AS run FROM w, unnest(range(1, len(words) - {n} + 2)) t(i)),
cover{n} AS (SELECT DISTINCT doc_id, i + k AS pos
             FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS copies FROM run{n}), range({n}) r(k) WHERE copies > 1),
dup{n} AS (SELECT doc_id, count(*) AS n, sum(length(words[pos])) AS chars FROM cover{n} JOIN w USING (doc_id) GROUP BY doc_id)"""
_LENGTHS = list(quality.NGRAM_SHARES)
_OVER = " OR ".join(
    f"coalesce(dup{n}.chars, 0) > {share}::DOUBLE * word_chars" for n, share in quality.NGRAM_SHARES.items()
)

#: One bit of CRC-32: the register moves on, by the reflected polynomial where a bit falls out (a fixed value).
_CRC = "xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))"


def _edit_rows() -> str:
    """(state, initial, fault, letters, cost, next state): up to two inserts and what is done with a row then; fault 9 is the end."""
    nexts = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    rows = []
    for state in range(4):
        put, at = [("", 0, state)], state
        for k in (1, 2):
            at = nexts[at, "a" if at == 2 else "u"]
            put.append(("I" * k, 3 * k, at))
        for letters, cost, at in put:
            if at in (0, 3):
                rows.append((state, "?", 9, letters, cost, at))
            for initial in "sua?":
                for fault in range(4):
                    rows.append((state, initial, fault, letters + "D", cost + 4, at))
                    if fault in (0, 1):
                        if (at, initial) in nexts:
                            rows.append((state, initial, fault, letters + "K", cost + 3 * fault, nexts[at, initial]))
                        to = nexts[at, "a" if at == 2 else "u"]
                        rows.append((state, initial, fault, letters + "R", cost + 3 + 3 * fault, to))
    return ", ".join(map(str, rows))


SQL = {
    "op1_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        {", ".join(_RUNS.format(n=n) for n in _LENGTHS)},
        lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
        told AS (SELECT *, length(regexp_replace(line, '[ 	-
]+', '', 'g')) AS chars,
                        row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM lines),
        per AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE again) AS again,
                       coalesce(sum(chars) FILTER (WHERE again), 0) AS again_chars FROM told WHERE chars > 0 GROUP BY doc_id),
        base AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                        coalesce(again, 0) AS n_dup_lines, coalesce(dup8.n, 0) AS n_repeat_words, coalesce(again_chars, 0) AS dup_line_chars,
                        coalesce(lines, 0) AS lines
                 FROM w LEFT JOIN per USING (doc_id) LEFT JOIN dup8 USING (doc_id)),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
        SELECT judged.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CAST(dup_line_chars AS BIGINT) AS dup_line_chars,
               {", ".join(f"CAST(coalesce(dup{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in _LENGTHS)}, base_failed,
               NOT (base_failed OR n_dup_lines > {quality.LINE_SHARE}::DOUBLE * lines
                    OR dup_line_chars > {quality.LINE_CHAR_SHARE}::DOUBLE * word_chars OR {_OVER}) AS kept
        FROM judged {" ".join(f"LEFT JOIN dup{n} ON dup{n}.doc_id = judged.doc_id" for n in _LENGTHS)}
    """,
    "op7_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
        runs AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS run FROM w, unnest(range(1, len(words) - 11)) t(i)),
        low AS (SELECT run, min(doc_id) AS low FROM runs GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM runs JOIN low USING (run), range(13) r(k) WHERE low < doc_id),
        each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op8_near_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents
        ),
        sets AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS shingle
                 FROM w, unnest(range(1, greatest(len(words) - 1, 2))) t(i) WHERE len(words) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
        reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
        lowest AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM lowest LEFT JOIN sizes USING (doc_id)
    """,
    "op4_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), escaped AS (
            SELECT *, length(replace(replace(role, '\', '\\'), chr(10), '\n'))
                      + len(regexp_extract_all(replace(replace(role, '\', '\\'), chr(10), '\n'), '(<\\*\||<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>)')) AS role_chars,
                   length(text) + len(regexp_extract_all(text, '(<\\*\||<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>)')) AS text_chars
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + role_chars + 1 + text_chars + 11) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op11_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        digits AS (SELECT *, list_transform(range(8), lambda k: ('0x' || hex[5 * k + 1 : 5 * k + 5])::BIGINT) AS parts FROM p),
        named AS (
            SELECT page_id, html, array_to_string(list_transform(range(32), lambda k:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
                   max(page_id) OVER (PARTITION BY html) AS keeper
            FROM digits
        )
        SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM named
    """,
    "op12_conversation_repair": rf"""
        WITH RECURSIVE edits(state, initial, fault, letters, price, next) AS (VALUES {_edit_rows()}),
        drawn AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda l: [ascii(l)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: {_CRC})) % 20 AS draw
            FROM conversations
        ),
        harmed AS (
            SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM drawn, range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies(k)
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                   CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS initial
            FROM harmed
        ),
        judged AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3
                           WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault,
                   initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair
            FROM placed
        ),
        counted AS (
            SELECT conv_id, count(*) AS n,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate,
                   count(*) FILTER (WHERE fault = 1) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM judged GROUP BY conv_id
        ),
        ways AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM counted
            UNION ALL
            SELECT w.conv_id, w.i + 1, e.next, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.letters}})
            FROM ways w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
                 JOIN edits e ON e.state = w.state AND e.initial = r.initial AND e.fault = r.fault
            GROUP BY w.conv_id, w.i, e.next
        ),
        ended AS (
            SELECT w.conv_id, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.letters}}) AS best
            FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
                 JOIN edits e ON e.state = w.state AND e.fault = 9
            GROUP BY w.conv_id
        ),
        marks AS (
            SELECT conv_id, k, best.audit[k] AS letter, length(regexp_replace(best.audit[1 : k], 'I', '', 'g')) AS i
            FROM ended, unnest(range(1, length(best.audit) + 1)) t(k)
        ),
        stay AS (
            SELECT m.conv_id, k, letter, r.role, CASE letter WHEN 'I' THEN '' ELSE r.text END AS text,
                   row_number() OVER (PARTITION BY m.conv_id ORDER BY k) AS place
            FROM marks m LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.i = m.i
            WHERE letter <> 'D'
        ),
        led AS (SELECT conv_id, min(place) AS first FROM stay WHERE letter <> 'K' OR left(role, 1) <> 's' GROUP BY conv_id),
        lines AS (
            SELECT s.conv_id, s.place,
                   CASE WHEN letter = 'K' THEN role WHEN (s.place - led.first) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text AS line
            FROM stay s JOIN led ON led.conv_id IS NOT DISTINCT FROM s.conv_id
        ),
        mended AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY place)) AS repaired_sha256 FROM lines GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
             LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
             LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
             LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
