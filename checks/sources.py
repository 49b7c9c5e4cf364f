"""Checked queries over readers and writers. What they read is written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import docsql as D
from checks import inputs as I
from checks import sql as Q
from variorum.functions import text as T
from variorum.operators.catalog import CHAT, MESSAGES, RESPONSES
from variorum.session import fresh_folder, scratch_folder, stage
from variorum.sources import exports, files, responses, results

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# Stored results: every document is a page result whose segments are its sentences.

_RESULT_SEG = """
seg AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, lang AS page_id, pos AS idx, seg AS text,
        CASE WHEN contains(seg, 'ea') THEN 0.25 ELSE 0.9239 END AS confidence,
        CASE WHEN contains(seg, 'ea') THEN 'fallback' ELSE 'consensus' END AS source, contains(seg, 'ea') AS disputed FROM sent)"""


def _flat_segments(spark, sf):
    arrays = I.sentence_arrays(spark, sf)
    rows = arrays.select("page_id", "lang", F.posexplode_outer("sents").alias("pos", "text")).filter("pos IS NOT NULL")
    open_ = F.col("text").contains("ea")
    return rows.select(
        F.col("page_id").cast("string").alias("doc_id"),
        F.col("lang").alias("page_id"),
        F.col("pos").cast("long").alias("idx"),
        "text",
        F.when(open_, 0.25).otherwise(0.9239).alias("confidence"),
        F.when(open_, "fallback").otherwise("consensus").alias("source"),
        F.array(F.lit("a"), F.lit("b")).alias("from"),
        open_.alias("disputed"),
        F.when(open_, F.array(F.struct(F.lit("a").alias("agent"), F.col("text").alias("text"))))
        .otherwise(F.array().cast("array<struct<agent:string,text:string>>"))
        .alias("candidates"),
    )


def _stored(spark, sf) -> str:
    """Nested results as JSON lines; zero values are left out, as stored results do."""
    segments = _flat_segments(spark, sf)
    pages = I.sentence_arrays(spark, sf).select(
        F.col("page_id").cast("string").alias("doc_id"),
        F.col("lang").alias("page_id"),
        F.array_join("sents", "\n").alias("text"),
        F.lit(0.5).alias("confidence"),
        F.lit(2).cast("long").alias("engines"),
        F.size("sents").cast("long").alias("segments"),
    )
    readings = I.readings(spark, sf).filter("agent IN ('a', 'd')").join(
        I.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "lang"), "page_id"
    ).select(F.col("page_id").cast("string").alias("doc_id"), F.col("lang").alias("page_id"), "agent", "text", "latency_ms", "err")
    nested = results.nest_results(pages, segments, readings)
    folder = fresh_folder(spark, "results")
    trimmed = nested.withColumn(
        "segments",
        F.transform("segments", lambda s: s.withField("disputed", F.when(s["disputed"], True)).withField("candidates", F.when(s["disputed"], s["candidates"]))),
    ).withColumn("candidates", F.transform("candidates", lambda c: c.withField("err", F.when(c["err"] != "", c["err"]))))
    trimmed.write.json(folder)
    return folder


@check(
    "s1_load_segments",
    Q.query(
        Q.SENT_ARRAYS + "," + _RESULT_SEG,
        "SELECT doc_id, page_id, idx, text, CAST(confidence AS DOUBLE) AS confidence, source, disputed, CASE WHEN disputed THEN 'a=' || text ELSE '' END AS candidates FROM seg",
    ),
)
def s1(spark, sf):
    segments, _, _ = results.load_results(spark, _stored(spark, sf), multi_line=False)
    return segments.select("doc_id", "page_id", "idx", "text", "confidence", "source", "disputed", I.flat_candidates().alias("candidates"))


@check(
    "s1_load_candidates",
    Q.query(
        Q.CAND_LOSSY,
        """SELECT CAST(d.page_id AS VARCHAR) AS doc_id, lang AS page_id, a.agent, CASE WHEN a.agent = 'd' AND source = 'src7' THEN 'timeout' ELSE '' END AS err,
        coalesce(string_agg(c.text, ' ' ORDER BY slot), '') AS text FROM docs d CROSS JOIN (VALUES ('a'), ('d')) a(agent)
        LEFT JOIN cand c ON c.page_id = d.page_id AND c.agent = a.agent GROUP BY d.page_id, lang, a.agent, source""",
    ),
)
def s1_candidates(spark, sf):
    _, candidates, _ = results.load_results(spark, _stored(spark, sf), multi_line=False)
    return candidates.select("doc_id", "page_id", "agent", "err", "text")


@check(
    "s8_write_results",
    Q.query(
        Q.SENT_ARRAYS,
        """SELECT CAST(page_id AS VARCHAR) AS doc_id, lang AS page_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'edited' ELSE 'first' END AS state,
        CAST(len(sents) AS BIGINT) AS segments FROM arr""",
    ),
)
def s8(spark, sf):
    """A first run writes every page, some twice; a second replaces the pages of some sources; runs are then joined."""
    base = I.sentence_arrays(spark, sf)

    def run(df, state, seq=1):
        return df.select(
            F.col("page_id").cast("string").alias("doc_id"), F.col("lang").alias("page_id"), F.lit(state).alias("state"),
            F.size("sents").cast("long").alias("segments"), F.lit(seq).alias("seq"),
        )

    folder = fresh_folder(spark, "stored")
    twice = run(base.filter("source <> 'src4'"), "superseded", 0)
    results.write_results(run(base, "first").unionByName(twice), folder)
    results.write_results(run(base.filter("source IN ('src1', 'src2', 'src3')"), "edited").drop("seq"), folder)
    results.compact_results(spark, folder)
    results.write_results(run(base.filter("source = 'src2'"), "edited"), folder)
    return results.read_stored(spark, folder).select("doc_id", "page_id", "state", "segments")


@check(
    "s2_load_store",
    Q.query(
        D.BOTH,
        """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.status AS doc_status, p.page_id, p.pos, p.status, p.confidence, p.pending_disputes
        FROM docs d JOIN pgs p ON p.doc_id = d.doc_id""",
    ),
)
def s2(spark, sf):
    """One stored database per user, written as JSON lines and read back."""
    pages = I.pages(spark, sf)
    nested = pages.groupBy("doc_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", F.col("page_id").alias("id"), "status", "image_ready", "result_ready",
                    F.when(F.col("confidence") != 0, F.col("confidence")).alias("confidence"),
                    F.when(F.col("pending_disputes") != 0, F.col("pending_disputes")).alias("pending_disputes"),
                )
            )
        ).alias("pages")
    )
    documents = (
        I.documents(spark, sf)
        .join(nested, "doc_id")
        .select("user_id", F.struct(F.col("doc_id").cast("string").alias("id"), "status", "name", "pages").alias("d"))
    )
    stores = documents.groupBy("user_id").agg(F.collect_list("d").alias("documents")).select(F.lit(3).alias("version"), "documents")
    folder = fresh_folder(spark, "store")
    stores.write.json(folder)
    store = results.load_store(spark, folder, multi_line=False)
    docs = store["documents"].select("doc_id", F.col("status").alias("doc_status"))
    return store["pages"].join(docs, "doc_id").select(
        "doc_id", "doc_status", "page_id", "pos", "status", "confidence", "pending_disputes"
    )


# Captured responses: every conversation turn is a body of one of the three protocols.


def _bodies(spark, sf):
    """api, body: string and list contents, thinking, errors and broken bodies, by content."""
    conv = I.table(spark, sf, "conversations")
    q = T.quote_json("text")
    thought = T.quote_json(F.left("text", F.lit(10)))
    api = (
        F.when(F.col("turn").isin(0, 3, 6), CHAT).when(F.col("turn").isin(1, 4, 7), RESPONSES).otherwise(MESSAGES)
    )
    lines = F.char_length("text") > 300
    chat = F.when(
        lines,
        F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":'), q, F.lit('},{"type":"refusal","text":"no"},{"type":"output_text","text":"end"}],"reasoning":'), thought, F.lit("}}]}")),
    ).otherwise(F.concat(F.lit('{"choices":[{"message":{"content":'), q, F.lit(',"reasoning_content":"","thinking":'), thought, F.lit("}}]}")))
    resp = F.when(
        lines,
        F.concat(F.lit('{"output":[{"summary":[{"type":"summary_text","text":'), thought, F.lit('}]},{"content":[{"type":"output_text","text":'), q, F.lit('},{"type":"output_text","text":"end"}]}]}')),
    ).otherwise(F.concat(F.lit('{"output_text":'), q, F.lit(',"output":[]}')))
    msgs = F.when(
        lines,
        F.concat(F.lit('{"content":[{"type":"thinking","thinking":'), thought, F.lit('},{"type":"text","text":'), q, F.lit('},{"type":"text","text":"end"}]}')),
    ).otherwise(F.concat(F.lit('{"content":[{"type":"text","text":'), q, F.lit("}]}")))
    body = F.when(api == CHAT, chat).when(api == RESPONSES, resp).otherwise(msgs)
    broken = F.when(F.col("text").contains("ß"), F.concat(F.lit('{"type":"error","error":{"message":'), thought, F.lit("}}"))).when(
        F.col("text").contains("ñ"), F.concat(F.lit('{"error":'), thought, F.lit("}"))
    ).when(F.col("text").contains("ç"), F.concat(F.lit('{"type":"response.failed","message":'), thought, F.lit("}"))).when(
        F.col("text").contains("ö"), F.concat(F.lit('{"response":{"error":{"message":'), thought, F.lit("}}}"))
    ).when(F.col("text").contains("ê"), F.lit('{"choices":[')).when(F.col("text").contains("ó"), F.lit("{}"))
    return conv.select("conv_id", "turn", "text", api.alias("api"), F.coalesce(broken, body).alias("body"))


_BODY_SQL = """
c AS (SELECT *, CASE WHEN turn IN (0, 3, 6) THEN 'chat' WHEN turn IN (1, 4, 7) THEN 'resp' ELSE 'msgs' END AS api,
      length(text) > 300 AS many, left(text, 10) AS thought FROM conversations),
o AS (SELECT conv_id, turn, CASE WHEN contains(text, 'ß') OR contains(text, 'ñ') OR contains(text, 'ç') OR contains(text, 'ö') THEN thought
       WHEN contains(text, 'ê') THEN 'invalid JSON' WHEN contains(text, 'ó') THEN CASE WHEN api = 'chat' THEN 'no choice' ELSE 'no text' END ELSE '' END AS error,
       CASE WHEN many THEN text || chr(10) || 'end' ELSE text END AS output,
       CASE WHEN api = 'chat' OR many THEN thought ELSE '' END AS thinking FROM c)"""


@check(
    "s3_s5_ingest_responses",
    Q.query(
        _BODY_SQL,
        """SELECT conv_id, turn, error, CASE WHEN error = '' THEN output ELSE '' END AS output,
        CASE WHEN error = '' THEN thinking ELSE '' END AS thinking FROM o""",
    ),
)
def s3(spark, sf):
    return responses.ingest_responses(_bodies(spark, sf), "api", "body").select("conv_id", "turn", "error", "output", "thinking")


@check(
    "s5_api_error",
    Q.query(_BODY_SQL, "SELECT conv_id, turn, CASE WHEN error IN ('invalid JSON', 'no choice', 'no text') THEN '' ELSE error END AS error FROM o"),
)
def s5(spark, sf):
    return responses.with_api_error(_bodies(spark, sf), "body").select("conv_id", "turn", "error")


def _logs(spark, sf):
    """One event-stream log per document: a thinking frame, a frame per sentence, noise, and an error for German texts."""
    arrays = I.sentence_arrays(spark, sf)
    api = F.when(F.col("lang") == "fr", CHAT).when(F.col("lang").isin("en", "de"), RESPONSES).otherwise(MESSAGES)

    def frame(kind: str, s):
        q = T.quote_json(s)
        chat = F.concat(F.lit('data: {"choices":[{"delta":{"' + ("content" if kind == "output" else "reasoning") + '":'), q, F.lit("}}]}\n\n"))
        named = "response.output_text.delta" if kind == "output" else "response.reasoning_text.delta"
        resp = F.concat(F.lit(f'event: {named}\r\ndata: {{"delta":\r\ndata: '), q, F.lit("}\r\n\r\n"))
        part = "text" if kind == "output" else "thinking"
        msgs = F.concat(
            F.lit(f':ping\ndata:{{"type":"content_block_delta","delta":{{"type":"{part}_delta","{part}":'), q, F.lit("}}\n\n\n")
        )
        return F.when(api == CHAT, chat).when(api == RESPONSES, resp).otherwise(msgs)

    body = F.array_join(F.transform("sents", lambda s: frame("output", s)), "")
    tail = F.when(F.col("lang") == "de", 'data: {"type":"response.failed","message":"cut off"}\n\n' 'data: {"type":"response.output_text.delta","delta":"late"}').otherwise(
        "event: only\n\ndata: [DONE]"
    )
    return arrays.select(
        "page_id", api.alias("api"), F.concat(F.lit(": hello\n\n"), frame("thinking", F.lit("let me see")), body, tail).alias("log")
    )


_DELTAS = """
del AS (SELECT page_id, (pos + 1) * 2 AS place, 'output' AS kind, seg AS text FROM sent
        UNION ALL SELECT page_id, 0, 'thinking', 'let me see' FROM arr
        UNION ALL SELECT page_id, (len(sents) + 1) * 2, 'error', 'cut off' FROM arr WHERE lang = 'de')"""


@check(
    "s4_ingest_sse",
    Q.query(
        Q.SENT_ARRAYS + "," + _DELTAS,
        "SELECT page_id, kind, text, row_number() OVER (PARTITION BY page_id ORDER BY place) AS place FROM del",
    ),
)
def s4(spark, sf):
    from pyspark.sql import Window

    deltas = responses.ingest_sse(_logs(spark, sf), "log", "api")
    # One document is one log here, so a page's rows are one row's worth of text.
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("long")
    return deltas.select("page_id", "kind", "text", place.alias("place"))


@check(
    "t6_assemble_stream",
    Q.query(
        Q.SENT_ARRAYS,
        """SELECT page_id, array_to_string(sents, '') AS output, 'let me see' AS thinking,
        CASE WHEN lang = 'de' THEN 'cut off' WHEN len(sents) = 0 THEN 'no text' ELSE '' END AS error FROM arr""",
    ),
)
def t6(spark, sf):
    from variorum.streaming import batch

    deltas = responses.ingest_sse(_logs(spark, sf), "log", "api")
    return batch.assemble_stream(deltas, ["page_id"], "at").select("page_id", "output", "thinking", "error")


# Files and exports


def _files(spark, sf):
    docs = I.table(spark, sf, "documents")
    head = (
        F.when(F.col("lang") == "en", F.lit("255044462D312E37"))
        .when(F.col("lang") == "de", F.lit("89504E470D0A1A0A00"))
        .when(F.col("source") == "src1", F.lit("FFD8FFE0"))
        .when(F.col("source") == "src2", F.lit("524946460000000057454250565038"))
        .when(F.col("source") == "src3", F.lit("474946383961"))
        .when(F.col("source") == "src4", F.lit(""))
        .otherwise(F.lit("3C68746D6C3E"))
    )
    empty = (F.col("source") == "src5") & (F.col("lang") == "en")
    content = F.when(empty, F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(head), F.encode("text", "utf-8")))
    size = (
        F.when(empty, 0)
        .when(F.col("source") == "src6", (1 << 30) + 1)
        .when(F.col("source") == "src8", (32 << 20) + 1)
        .otherwise(F.octet_length("text"))
    )
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), size.cast("long").alias("length"), content.alias("content"), "lang", "source", "doc_id")


_FILES_SQL = """
f AS (SELECT '/in/' || doc_id AS path, CASE WHEN lang = 'en' AND source = 'src5' THEN 'empty file' WHEN source = 'src6' THEN 'file too large'
       WHEN lang = 'en' THEN 'application/pdf' WHEN source = 'src8' AND lang = 'de' THEN 'image too large' WHEN lang = 'de' THEN 'image/png'
       WHEN source = 'src1' THEN 'image/jpeg' WHEN source = 'src2' THEN 'image/webp' WHEN source = 'src3' THEN 'image/gif'
       ELSE 'unsupported format' END AS verdict FROM documents)"""


@check(
    "s7_admit_files",
    Q.query(
        _FILES_SQL,
        """SELECT path, verdict, CASE WHEN verdict = 'application/pdf' THEN 'pdf' WHEN verdict LIKE 'image/%' THEN 'image' ELSE '' END AS source_type FROM f""",
    ),
)
def s7(spark, sf):
    accepted, rejected = files.admit(_files(spark, sf))
    return accepted.select("path", F.col("mime_type").alias("verdict"), "source_type").unionByName(
        rejected.select("path", F.col("reason").alias("verdict"), F.lit("").alias("source_type"))
    )


MAX_UPLOAD, MAX_PICTURE = 4000, 1000


def _uploads(spark, sf) -> str:
    """Every document as a file of a folder for its language, among them files without a byte and files over the limits."""
    folder = scratch_folder(spark, "inbox")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("lang", "source", "doc_id")]
    place = F.concat(F.concat_ws("/", F.lit(folder), *parts), F.lit(".bin"))
    named = _files(spark, sf).select(place.alias("place"), "content")

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            for place, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = base + place[len(folder) :]
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(target) as file:
                    file.write(content or b"")
            yield batch.slice(0, 0)

    # A task that runs again writes the same files again.
    named.mapInArrow(write, "place string, content binary").write.format("noop").mode("overwrite").save()
    return folder


@check(
    "s7_admit_folder",
    Q.query(
        """f AS (SELECT lang || '/' || source || '/' || doc_id || '.bin' AS path, lang, source, CASE WHEN source = 'src5' AND lang = 'en' THEN 0
             ELSE strlen(text) + CASE WHEN lang = 'en' THEN 8 WHEN lang = 'de' THEN 9 WHEN source = 'src1' THEN 4 WHEN source = 'src2' THEN 15
               WHEN source = 'src3' THEN 6 WHEN source = 'src4' THEN 0 ELSE 6 END END AS length FROM documents),
        k AS (SELECT *, CASE WHEN lang = 'en' THEN 'application/pdf' WHEN lang = 'de' THEN 'image/png' WHEN source = 'src1' THEN 'image/jpeg'
               WHEN source = 'src2' THEN 'image/webp' WHEN source = 'src3' THEN 'image/gif' ELSE 'unsupported format' END AS kind FROM f)""",
        f"""SELECT path, length, CASE WHEN length = 0 THEN 'empty file' WHEN length > {MAX_UPLOAD} THEN 'file too large'
            WHEN kind LIKE 'image/%' AND length > {MAX_PICTURE} THEN 'image too large' ELSE kind END AS verdict FROM k""",
    ),
)
def s7_folder(spark, sf):
    """Files are written from the documents, listed and opened by tasks; the limits are small ones."""
    accepted, rejected = files.admit_files(spark, _uploads(spark, sf), MAX_UPLOAD, MAX_PICTURE)
    both = accepted.select("path", "length", F.col("mime_type").alias("verdict")).unionByName(
        rejected.select("path", "length", F.col("reason").alias("verdict"))
    )
    return both.withColumn("path", F.substring_index("path", "/", -3))


def _export_inputs(spark, sf):
    documents = I.documents(spark, sf)
    pages = stage(I.pages(spark, sf).withColumn("page_number", F.col("pos") + 1), "pages")
    texts = pages.filter("mark <> 13").select(
        "doc_id", "page_id", F.concat(F.lit("\n text of "), F.col("page_id"), F.lit(" \n")).alias("text")
    )
    return documents, pages, texts


@check(
    "s9_text_pieces",
    Q.query(
        D.BOTH,
        """SELECT d.doc_id, 'scan ' || d.doc_id || '.txt' AS file_name, coalesce(pos, 0) AS pos,
        coalesce(CASE WHEN pos = min(pos) OVER (PARTITION BY d.doc_id) THEN '' ELSE chr(10) || chr(10) || chr(12) || chr(10) || chr(10) END
                 || '第 ' || (pos + 1) || ' 页' || chr(10) || 'text of ' || page_id, '') AS piece
        FROM docs d LEFT JOIN (SELECT * FROM pgs WHERE result_ready AND mark <> 13) p ON p.doc_id = d.doc_id""",
    ),
)
def s9_pieces(spark, sf):
    """Written page by page and read back."""
    folder = fresh_folder(spark, "pieces")
    pieces = exports.text_pieces(*_export_inputs(spark, sf))
    exports.write_pieces(pieces, folder)
    return spark.read.schema(pieces.schema).json(folder)


@check(
    "s9_export_text",
    Q.query(
        D.BOTH,
        """SELECT d.doc_id, 'scan ' || d.doc_id || '.txt' AS file_name, coalesce(body, '') AS body FROM docs d LEFT JOIN (
        SELECT doc_id, string_agg('第 ' || (pos + 1) || ' 页' || chr(10) || 'text of ' || page_id, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY pos) AS body
        FROM pgs WHERE result_ready AND mark <> 13 GROUP BY doc_id) USING (doc_id)""",
    ),
)
def s9(spark, sf):
    return exports.export_text(*_export_inputs(spark, sf))


@check(
    "s10_export_audit",
    Q.query(
        D.BOTH,
        """SELECT d.doc_id, 'scan ' || d.doc_id || '-audit.json' AS file_name,
        '{"schema":"document-audit.v1","document":{"id":' || d.doc_id || ',"name":"' || name || '","source_type":"' || source_type || '","size_bytes":' || size_bytes
        || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","exported_at":"2030-01-01T00:00:00.000Z"},"pages":[' || coalesce(body, '') || ']}' AS body
        FROM docs d LEFT JOIN (SELECT doc_id, string_agg('{"page_number":' || (pos + 1) || ',"source_page":' || source_page || ',"status":"' || status || '"'
          || CASE WHEN duration_ms <> 0 THEN ',"duration_ms":' || duration_ms ELSE '' END
          || CASE WHEN result_ready AND mark <> 13 THEN ',"result":{"text":"' || page_id || '"}' ELSE '' END || '}', ',' ORDER BY pos) AS body
          FROM pgs GROUP BY doc_id) USING (doc_id)""",
    ),
)
def s10(spark, sf):
    documents, pages, _ = _export_inputs(spark, sf)
    nested = pages.filter("mark <> 13").select("doc_id", "page_id", F.struct(F.col("page_id").alias("text")).alias("result"))
    return exports.export_audit(documents, pages, nested, I.now())


@check(
    "s10_audit_pieces",
    Q.query(
        D.BOTH
        + """,
        e AS (SELECT doc_id, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY doc_id) THEN '' ELSE ',' END || '{"page_number":' || (pos + 1)
          || ',"source_page":' || source_page || ',"status":"' || status || '"' || CASE WHEN duration_ms <> 0 THEN ',"duration_ms":' || duration_ms ELSE '' END
          || CASE WHEN result_ready AND mark <> 13 THEN ',"result":{"text":"' || page_id || '"}' ELSE '' END || '}' AS piece FROM pgs),
        n AS (SELECT doc_id, count(*) AS pages FROM pgs GROUP BY doc_id)""",
        """SELECT d.doc_id, 'scan ' || d.doc_id || '-audit.json' AS file_name, p.pos, p.piece FROM docs d JOIN (
        SELECT doc_id, -1 AS pos, '{"schema":"document-audit.v1","document":{"id":' || doc_id || ',"name":"' || name || '","source_type":"' || source_type
          || '","size_bytes":' || size_bytes || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z')
          || '","exported_at":"2030-01-01T00:00:00.000Z"},"pages":[' AS piece FROM docs
        UNION ALL SELECT docs.doc_id, coalesce(pages, 0), ']}' FROM docs LEFT JOIN n ON n.doc_id = docs.doc_id
        UNION ALL SELECT doc_id, pos, piece FROM e) p ON p.doc_id = d.doc_id""",
    ),
)
def s10_pieces(spark, sf):
    """Written page by page and read back."""
    documents, pages, _ = _export_inputs(spark, sf)
    nested = pages.filter("mark <> 13").select("doc_id", "page_id", F.struct(F.col("page_id").alias("text")).alias("result"))
    folder = fresh_folder(spark, "audit")
    pieces = exports.audit_pieces(documents, pages, nested, I.now())
    exports.write_pieces(pieces, folder)
    return spark.read.schema(pieces.schema).json(folder)


@check(
    "s1_check_edited_results",
    Q.query(
        "d AS (SELECT doc_id, lang FROM documents)",
        """SELECT doc_id, CASE WHEN lang = 'de' THEN 'colour' WHEN lang = 'es' THEN 'note' ELSE '' END AS unknown FROM d WHERE lang IN ('de', 'es')""",
    ),
)
def s1_edited(spark, sf):
    q = T.quote_json("text")
    body = F.concat(
        F.lit('{"text":'), q, F.when(F.col("lang") == "de", ',"colour":1').otherwise(""), F.lit(',"segments":[{"text":'), q,
        F.when(F.col("lang") == "es", ',"note":"x"').otherwise(""), F.lit("}]}"),
    )
    edited = I.table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return results.check_edited_results(edited, "body").select("doc_id", F.array_join("unknown", "|").alias("unknown"))
