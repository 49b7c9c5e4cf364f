"""Checked queries over documents, pages, tasks and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import docsql as D
from checks import inputs as I
from checks import sql as Q
from variorum.operators import documents as O
from variorum.operators import texts
from variorum.operators import transitions as G
from variorum.operators import users as U
from variorum.session import stage

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def both(spark, sf):
    return I.documents(spark, sf), stage(I.pages(spark, sf), "pages")


@check("a8_recount_documents", Q.query(D.BOTH + "," + D.counts("pgs"), D.doc_out("docs")))
def a8(spark, sf):
    return I.document_columns(O.recount_documents(*both(spark, sf)))


@check(
    "a12_project_confidence",
    Q.query(
        D.BOTH,
        """SELECT doc_id, round(coalesce(avg(confidence) FILTER (WHERE result_ready), 0), 9) AS confidence,
        count(*) FILTER (WHERE status = 'completed') AS completed FROM pgs GROUP BY doc_id""",
    ),
)
def a12(spark, sf):
    return O.project_confidence(I.pages(spark, sf)).withColumn("confidence", F.round("confidence", 9))


@check(
    "a14_page_status_counts",
    Q.query(
        D.BOTH,
        """SELECT doc_id, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'queued') AS queued,
        count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'failed') AS failed,
        count(*) FILTER (WHERE status IN ('failed', 'completed')) AS terminal FROM pgs GROUP BY doc_id""",
    ),
)
def a14(spark, sf):
    return O.page_status_counts(I.pages(spark, sf))


@check(
    "w4_renumber",
    Q.query(
        D.BOTH,
        """SELECT doc_id, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page_number
        FROM pgs WHERE status <> 'failed'""",
    ),
)
def w4(spark, sf):
    return O.renumber(I.pages(spark, sf).filter("status <> 'failed'")).select("doc_id", "page_id", "page_number")


@check(
    "w7_latest_state",
    """SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def w7(spark, sf):
    changes = I.table(spark, sf, "events").select("user_id", F.col("event_type").alias("status"), "event_id", "ts")
    return O.latest_state(changes, ["user_id"], ["ts", "event_id"]).drop("ts")


@check(
    "o2_history",
    Q.query(D.DOCS, "SELECT doc_id, name, strftime(updated_at, '%Y-%m-%d') AS updated FROM docs ORDER BY updated_at DESC, doc_id"),
)
def o2(spark, sf):
    listed = O.history(I.documents(spark, sf), "documents")
    return listed.select("doc_id", "name", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@check(
    "o3_next_pages",
    Q.query(
        D.BOTH,
        """SELECT doc_id, arg_min(page_id, pos) AS page_id, min(pos) AS pos FROM pgs JOIN docs USING (doc_id)
        WHERE docs.status = 'processing' AND pgs.status = 'queued' AND image_ready GROUP BY doc_id""",
    ),
)
def o3(spark, sf):
    return O.next_pages(*both(spark, sf))


@check(
    "o4_fair_plan",
    Q.query(
        D.BOTH
        + """, q AS (SELECT p.doc_id, p.page_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.pos) - 1 AS turn, d.created_at
        FROM pgs p JOIN docs d ON d.doc_id = p.doc_id WHERE d.status = 'processing' AND p.status = 'queued' AND image_ready)""",
        "SELECT doc_id, page_id, turn FROM q ORDER BY turn, created_at, doc_id",
    ),
)
def o4(spark, sf):
    return O.fair_plan(*both(spark, sf)).select("doc_id", "page_id", "turn")


@check("p17_visible_to", Q.query(D.DOCS, "SELECT doc_id, user_id, name FROM docs WHERE user_id = 7"))
def p17(spark, sf):
    return O.visible_to(I.documents(spark, sf), 7, "user").select("doc_id", "user_id", "name")


_SEGMENTS = """
seg AS (SELECT doc_id, page_id, k AS idx, 'open ' || k AS text, k <= pending_disputes AS disputed,
        CASE WHEN k <= pending_disputes AND k <> 3 THEN 'fallback' WHEN k = 3 THEN 'escalated' ELSE 'consensus' END AS source
        FROM (SELECT *, unnest(range(1, segments + 1)) AS k FROM pgs WHERE result_ready))"""


def _page_segments(pages):
    k = F.explode(F.sequence(F.lit(1), F.col("segments"))).alias("idx")
    return (
        pages.filter("result_ready AND segments > 0")
        .select("doc_id", "page_id", "pending_disputes", k)
        .select(
            "doc_id",
            "page_id",
            "idx",
            F.concat(F.lit("open "), F.col("idx").cast("string")).alias("text"),
            (F.col("idx") <= F.col("pending_disputes")).alias("disputed"),
            F.when((F.col("idx") <= F.col("pending_disputes")) & (F.col("idx") != 3), "fallback")
            .when(F.col("idx") == 3, "escalated")
            .otherwise("consensus")
            .alias("source"),
        )
    )


@check(
    "p18_dispute_index",
    Q.query(
        D.BOTH + "," + _SEGMENTS,
        """SELECT doc_id, page_id, pos + 1 AS page_number, source_page, idx, text FROM pgs JOIN seg USING (doc_id, page_id)
        WHERE result_ready AND pending_disputes > 0 AND disputed AND source = 'fallback' ORDER BY doc_id, pos, idx""",
    ),
)
def p18(spark, sf):
    pages = stage(I.pages(spark, sf).withColumn("page_number", F.col("pos") + 1), "pages")
    return O.dispute_index(pages, _page_segments(pages)).select(
        "doc_id", "page_id", "page_number", "source_page", "idx", "text"
    )


@check(
    "p19_page_worksets",
    Q.query(
        D.BOTH + "," + D.REQUESTS,
        """SELECT doc_id, page_id, m AS manageable, m AND s AS managed, m AND s AND status <> 'queued' AS runnable,
        m AND s AND status = 'queued' AS queued, status = 'failed' AS failed FROM (
        SELECT *, image_ready AND status NOT IN ('preparing', 'processing') AS m,
               EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = pgs.doc_id AND sel.page_id = pgs.page_id) AS s FROM pgs)""",
    ),
)
def p19(spark, sf):
    _, pages = both(spark, sf)
    return O.page_worksets(pages, I.selection(pages))


_NAMES = """
raw AS (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN ' C:\\scans\\' || left(text, 300) || '.PDF '
          WHEN lang = 'fr' THEN 'in/box/' || replace(left(text, 150), ' ', '_') || '.tar.gz'
          WHEN lang = 'de' THEN 'in/ ' ELSE '.hidden' END AS name,
        CASE WHEN doc_id < 500 THEN 'pdf' ELSE 'image' END AS source_type FROM documents)"""


@check(
    "p13_clean_names",
    Q.query(
        _NAMES
        + rf""", base AS (SELECT *, regexp_extract({Q.trim("replace(name, chr(92), '/')")}, '(?s)([^/]*)$', 1) AS b FROM raw),
        cut AS (SELECT *, CASE WHEN strlen(b) <= 240 THEN b ELSE (SELECT left(b, max(k)) FROM range(0, 241) r(k)
                WHERE strlen(left(b, k)) <= 240) END AS c FROM base),
        named AS (SELECT doc_id, CASE WHEN c <> '' THEN c WHEN source_type = 'pdf' THEN '未命名.pdf' ELSE '未命名图片' END AS name FROM cut)""",
        rf"""SELECT doc_id, name, CASE WHEN s = '' THEN 'document' ELSE s END AS stem FROM (SELECT *,
        {Q.trim(r"regexp_replace(name, '(?s)^(.+)\.[^.]*$', chr(92) || '1')")} AS s FROM named)""",
    ),
)
def p13(spark, sf):
    text = F.col("text")
    raw = I.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", F.concat(F.lit(" C:\\scans\\"), F.left(text, F.lit(300)), F.lit(".PDF ")))
        .when(F.col("lang") == "fr", F.concat(F.lit("in/box/"), F.replace(F.left(text, F.lit(150)), F.lit(" "), F.lit("_")), F.lit(".tar.gz")))
        .when(F.col("lang") == "de", "in/ ")
        .otherwise(".hidden")
        .alias("name"),
        F.when(F.col("doc_id") < 500, "pdf").otherwise("image").alias("source_type"),
    )
    return texts.clean_names(raw).select("doc_id", "name", "stem")


@check("j11_check_selection", Q.query(D.BOTH + "," + D.REQUESTS, "SELECT doc_id, violation FROM rejected"))
def j11(spark, sf):
    documents, pages = both(spark, sf)
    return O.check_selection(I.requests(spark, sf), I.selection(pages), documents, pages)


_ORDER = """
ord AS (SELECT doc_id, CASE WHEN mark = 50 THEN 'page-000001' ELSE page_id END AS page_id, -pos AS place FROM pgs WHERE mark <> 51),
placed AS (SELECT doc_id, page_id, count(*) AS copies, min(place) AS place FROM ord GROUP BY ALL),
asked AS (SELECT DISTINCT doc_id FROM ord),
both_ AS (SELECT coalesce(p.doc_id, o.doc_id) AS doc_id, p.page_id AS have, o.copies FROM
          (SELECT doc_id, page_id FROM pgs WHERE doc_id IN (SELECT doc_id FROM asked)) p
          FULL JOIN placed o ON o.doc_id = p.doc_id AND o.page_id = p.page_id),
wrong AS (SELECT doc_id, CASE WHEN sum(coalesce(copies, 0)) <> count(have) THEN 'order must hold every page'
          ELSE 'unknown or repeated page' END AS violation FROM both_ GROUP BY doc_id
          HAVING count(*) FILTER (WHERE have IS NULL OR copies IS NULL OR copies > 1) > 0),
rej AS (SELECT doc_id, 'order is fixed while processing' AS violation FROM docs WHERE status = 'processing' AND doc_id IN (SELECT doc_id FROM asked)
        UNION ALL SELECT doc_id, violation FROM wrong WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE status = 'processing'))"""


def _order(pages):
    return pages.filter("mark <> 51").select(
        "doc_id", F.when(F.col("mark") == 50, "page-000001").otherwise(F.col("page_id")).alias("page_id"), (-F.col("pos")).alias("place")
    )


@check(
    "j12_reorder_pages",
    Q.query(
        D.BOTH + "," + _ORDER,
        """SELECT p.doc_id, p.page_id, coalesce(o.place, p.pos) AS pos FROM pgs p LEFT JOIN placed o
        ON o.doc_id = p.doc_id AND o.page_id = p.page_id AND p.doc_id NOT IN (SELECT doc_id FROM rej)""",
    ),
)
def j12(spark, sf):
    documents, pages = both(spark, sf)
    return O.reorder_pages(documents, pages, _order(pages))[0].select("doc_id", "page_id", "pos")


@check("j12_rejected_orders", Q.query(D.BOTH + "," + _ORDER, "SELECT doc_id, violation FROM rej"))
def j12_rejected(spark, sf):
    documents, pages = both(spark, sf)
    return O.reorder_pages(documents, pages, _order(pages))[1]


@check(
    "j10_page_results",
    Q.query(
        D.BOTH,
        """SELECT doc_id, page_id, CASE WHEN result_ready AND mark <> 13 THEN 'text of ' || page_id ELSE '' END AS text FROM pgs""",
    ),
)
def j10(spark, sf):
    _, pages = both(spark, sf)
    # Results of unfinished pages exist too and must not show; one file in the set is missing.
    results = pages.filter("mark <> 13").select(
        "doc_id", "page_id", F.concat(F.lit("text of "), F.col("page_id")).alias("text")
    )
    return O.page_results(pages, results).select("doc_id", "page_id", F.coalesce("text", F.lit("")).alias("text"))


# Updates

_QUEUED = D.REQUESTS + f""",
taken AS (SELECT * FROM req WHERE doc_id NOT IN (SELECT doc_id FROM rejected)),
npg AS (SELECT p.* REPLACE (
    CASE WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit THEN FALSE ELSE result_ready END AS result_ready,
    CASE WHEN hit THEN 0 ELSE confidence END AS confidence, CASE WHEN hit THEN 0 ELSE segments END AS segments,
    CASE WHEN hit THEN 0 ELSE pending_disputes END AS pending_disputes, CASE WHEN hit THEN 0 ELSE duration_ms END AS duration_ms,
    CASE WHEN hit THEN {D.NOW} ELSE updated_at END AS updated_at)
  FROM (SELECT *, status <> 'queued' AND EXISTS (SELECT 1 FROM sel JOIN taken USING (doc_id)
        WHERE sel.doc_id = pgs.doc_id AND sel.page_id = pgs.page_id) AS hit FROM pgs) p),
ndoc AS (SELECT d.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN 'processing' ELSE d.status END AS status,
    CASE WHEN t.doc_id IS NOT NULL AND d.status <> 'processing' THEN t.engines ELSE d.engines END AS engines,
    d.auto_arbitrate, d.error, CASE WHEN t.doc_id IS NULL THEN d.completed_at END AS completed_at,
    CASE WHEN t.doc_id IS NOT NULL THEN {D.NOW} ELSE d.updated_at END AS updated_at
  FROM docs d LEFT JOIN taken t ON t.doc_id = d.doc_id)"""


def _queue(spark, sf):
    documents, pages = both(spark, sf)
    return G.queue_pages(documents, pages, I.requests(spark, sf), I.selection(pages), I.now())


@check("g1_queue_pages", Q.query(D.BOTH + "," + _QUEUED, D.page_out("npg")))
def g1(spark, sf):
    return I.page_columns(_queue(spark, sf)[1])


@check("g1_queue_documents", Q.query(D.BOTH + "," + _QUEUED + "," + D.counts("npg"), D.doc_out("ndoc")))
def g1_documents(spark, sf):
    return I.document_columns(_queue(spark, sf)[0])


_DEQUEUED = D.DEQUEUE + f""",
taken AS (SELECT DISTINCT doc_id FROM sel WHERE doc_id NOT IN (SELECT doc_id FROM rejected)),
npg AS (SELECT p.* REPLACE (CASE WHEN hit THEN 'ready' ELSE status END AS status,
    CASE WHEN hit THEN {D.NOW} ELSE updated_at END AS updated_at)
  FROM (SELECT *, status = 'queued' AND EXISTS (SELECT 1 FROM sel JOIN taken USING (doc_id)
        WHERE sel.doc_id = pgs.doc_id AND sel.page_id = pgs.page_id) AS hit FROM pgs) p),
{D.counts("npg").strip()},
ndoc AS (SELECT d.* REPLACE (
    CASE WHEN idle AND coalesce(waiting, FALSE) THEN 'ready' WHEN idle THEN 'completed' ELSE status END AS status,
    CASE WHEN idle AND coalesce(waiting, FALSE) THEN NULL WHEN idle THEN {D.NOW} ELSE completed_at END AS completed_at,
    CASE WHEN hit THEN {D.NOW} ELSE updated_at END AS updated_at)
  FROM (SELECT docs.*, waiting, docs.doc_id IN (SELECT doc_id FROM taken) AS hit,
        docs.doc_id IN (SELECT doc_id FROM taken) AND NOT coalesce(active, FALSE) AS idle FROM docs LEFT JOIN cnt USING (doc_id)) d)"""


def _dequeue(spark, sf):
    documents, pages = both(spark, sf)
    return G.dequeue_pages(documents, pages, I.selection(pages), I.now())


@check("g2_dequeue_pages", Q.query(D.BOTH + "," + _DEQUEUED, D.page_out("npg")))
def g2(spark, sf):
    return I.page_columns(_dequeue(spark, sf)[1])


@check("g2_dequeue_documents", Q.query(D.BOTH + "," + _DEQUEUED, D.doc_out("ndoc")))
def g2_documents(spark, sf):
    return I.document_columns(_dequeue(spark, sf)[0])


_CANCELLED = f"""
npg AS (SELECT p.* REPLACE (CASE WHEN status IN ('queued', 'processing') AND doc_id IN (SELECT doc_id FROM docs WHERE source_type = 'pdf')
    THEN 'ready' ELSE status END AS status) FROM pgs p),
ndoc AS (SELECT d.* REPLACE (CASE WHEN source_type = 'pdf' THEN 'cancelled' ELSE status END AS status,
    CASE WHEN source_type = 'pdf' THEN {D.NOW} ELSE updated_at END AS updated_at) FROM docs d)"""


def _cancel(spark, sf):
    documents, pages = both(spark, sf)
    return G.cancel_documents(documents, pages, documents.filter("source_type = 'pdf'").select("doc_id"), I.now())


@check("g3_cancel_pages", Q.query(D.BOTH + "," + _CANCELLED, D.page_out("npg")))
def g3(spark, sf):
    return I.page_columns(_cancel(spark, sf)[1])


@check("g3_cancel_documents", Q.query(D.BOTH + "," + _CANCELLED + "," + D.counts("npg"), D.doc_out("ndoc")))
def g3_documents(spark, sf):
    return I.document_columns(_cancel(spark, sf)[0])


@check(
    "g4_settle_documents",
    Q.query(
        D.BOTH + "," + D.counts("pgs")
        + f""", j AS (SELECT docs.*, coalesce(active, FALSE) AS act, coalesce(waiting, FALSE) AS wait, coalesce(cnt.failed_pages, 0) AS nfail,
          status NOT IN ('cancelled', 'failed') AS o FROM docs LEFT JOIN cnt USING (doc_id)),
        ndoc AS (SELECT j.* REPLACE (
          CASE WHEN o AND act THEN 'processing' WHEN o AND wait THEN 'ready' WHEN o THEN 'completed' ELSE status END AS status,
          CASE WHEN o AND act THEN NULL WHEN o AND wait THEN NULL WHEN o THEN {D.NOW} ELSE completed_at END AS completed_at,
          CASE WHEN o AND NOT act AND nfail > 0 THEN '有 ' || nfail || ' 页未能处理,可逐页或整批重试' ELSE '' END AS error,
          {D.NOW} AS updated_at) FROM j)""",
        D.doc_out("ndoc"),
    ),
)
def g4(spark, sf):
    return I.document_columns(G.settle_documents(*both(spark, sf), I.now()))


@check(
    "g5_finish_pages",
    Q.query(
        D.BOTH
        + f""", npg AS (SELECT p.* REPLACE (
          CASE WHEN b THEN 'failed' WHEN hit AND mark = 2 THEN 'failed' WHEN hit THEN 'completed' ELSE status END AS status,
          CASE WHEN b THEN FALSE WHEN hit THEN TRUE ELSE result_ready END AS result_ready,
          CASE WHEN b OR NOT hit THEN confidence ELSE 0.5 END AS confidence,
          CASE WHEN b OR NOT hit THEN segments ELSE mark END AS segments,
          CASE WHEN b OR NOT hit THEN pending_disputes ELSE 1 END AS pending_disputes,
          CASE WHEN hit THEN 1000 + pos ELSE duration_ms END AS duration_ms,
          CASE WHEN hit AND NOT b THEN revision + 1 ELSE revision END AS revision,
          CASE WHEN b THEN 'unreadable' WHEN hit AND mark = 2 THEN '所有引擎均失败,请检查 Provider 连接与模型配置' ELSE error END AS error,
          CASE WHEN hit THEN {D.NOW} ELSE updated_at END AS updated_at)
        FROM (SELECT *, status IN ('processing', 'queued') AS hit, status IN ('processing', 'queued') AND mark = 1 AS b FROM pgs) p)""",
        D.page_out("npg"),
    ),
)
def g5(spark, sf):
    _, pages = both(spark, sf)
    results = pages.filter("status IN ('processing', 'queued')").select(
        "doc_id",
        "page_id",
        F.lit(3).alias("engines"),
        F.when(F.col("mark") == 2, 3).otherwise(1).alias("failed_engines"),
        F.lit(0.5).alias("confidence"),
        F.col("mark").alias("segments"),
        F.lit(1).alias("pending_disputes"),
        (F.col("pos") + 1000).alias("duration_ms"),
        F.when(F.col("mark") == 1, "unreadable").otherwise("").alias("error"),
    )
    return I.page_columns(G.finish_pages(pages, results, I.now()))


_RECOVERED = """
npg AS (SELECT p.* REPLACE (CASE WHEN ds = 'preparing' AND image_ready THEN 'ready' WHEN ds = 'preparing' THEN 'preparing'
    WHEN ds = 'processing' AND status = 'processing' THEN 'queued' ELSE status END AS status)
  FROM (SELECT pgs.*, docs.status AS ds FROM pgs JOIN docs USING (doc_id)) p)"""


@check("g6_recover_pages", Q.query(D.BOTH + "," + _RECOVERED, D.page_out("npg")))
def g6(spark, sf):
    return I.page_columns(G.recover(*both(spark, sf))[1])


@check(
    "g6_recover_work",
    Q.query(
        D.DOCS,
        """SELECT doc_id, CASE WHEN status = 'preparing' THEN 'prepare' ELSE 'process' END AS job FROM docs
        WHERE status IN ('preparing', 'processing')""",
    ),
)
def g6_work(spark, sf):
    return G.recover(*both(spark, sf))[2]


@check(
    "g7_migrate_v3",
    Q.query(
        D.BOTH
        + """, npg AS (SELECT p.* REPLACE (CASE WHEN status = 'queued' AND doc_id IN (SELECT doc_id FROM docs WHERE status <> 'processing')
          THEN 'ready' ELSE status END AS status) FROM pgs p)""",
        D.page_out("npg"),
    ),
)
def g7(spark, sf):
    return I.page_columns(G.migrate_v3(*both(spark, sf), version=2))


@check(
    "g8_rerun_set",
    Q.query(
        D.BOTH
        + """, f AS (SELECT *, status IN ('ready', 'failed', 'queued') AS o,
          bool_or(status IN ('ready', 'failed', 'queued')) OVER (PARTITION BY doc_id) AS some_open FROM pgs)""",
        "SELECT doc_id, page_id FROM f WHERE CASE WHEN some_open THEN o ELSE image_ready AND status = 'completed' END",
    ),
)
def g8(spark, sf):
    return G.rerun_set(stage(I.pages(spark, sf), "pages")).select("doc_id", "page_id")


_DELETED = f"""
tgt AS (SELECT DISTINCT doc_id, CASE WHEN mark = 20 THEN 'page-999999' ELSE page_id END AS page_id FROM pgs WHERE mark <= 20),
wnt AS (SELECT t.doc_id, count(*) AS w, bool_or(p.page_id IS NULL) AS u FROM tgt t LEFT JOIN pgs p
        ON p.doc_id = t.doc_id AND p.page_id = t.page_id GROUP BY t.doc_id),
have AS (SELECT doc_id, count(*) AS n FROM pgs GROUP BY doc_id),
rej AS (SELECT * FROM (SELECT w.doc_id, CASE WHEN d.status IN ('preparing', 'processing') THEN 'document is busy'
        WHEN coalesce(n, 0) - w < 1 THEN 'one page must stay' WHEN u THEN 'unknown page id' END AS violation
        FROM wnt w JOIN docs d ON d.doc_id = w.doc_id LEFT JOIN have h ON h.doc_id = w.doc_id) WHERE violation IS NOT NULL),
gone AS (SELECT * FROM tgt WHERE doc_id NOT IN (SELECT doc_id FROM rej)),
npg AS (SELECT * FROM pgs WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = pgs.doc_id AND gone.page_id = pgs.page_id)),
ndoc AS (SELECT d.* REPLACE (CASE WHEN doc_id IN (SELECT doc_id FROM gone) THEN {D.NOW} ELSE updated_at END AS updated_at) FROM docs d)"""


def _delete(spark, sf):
    documents, pages = both(spark, sf)
    targets = pages.filter("mark <= 20").select(
        "doc_id", F.when(F.col("mark") == 20, "page-999999").otherwise(F.col("page_id")).alias("page_id")
    )
    return G.delete_pages(documents, pages, targets, I.now())


@check(
    "g9_delete_pages",
    Q.query(
        D.BOTH + "," + _DELETED,
        "SELECT doc_id, page_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page_number FROM npg",
    ),
)
def g9(spark, sf):
    return _delete(spark, sf)[1].select("doc_id", "page_id", "page_number")


@check("g9_delete_documents", Q.query(D.BOTH + "," + _DELETED + "," + D.counts("npg"), D.doc_out("ndoc")))
def g9_documents(spark, sf):
    return I.document_columns(_delete(spark, sf)[0])


@check("g9_rejected_deletes", Q.query(D.BOTH + "," + _DELETED, "SELECT doc_id, violation FROM rej"))
def g9_rejected(spark, sf):
    return _delete(spark, sf)[2]


@check(
    "g10_save_review",
    Q.query(
        D.BOTH
        + f""", npg AS (SELECT p.* REPLACE (CASE WHEN result_ready THEN 'completed' ELSE status END AS status,
          CASE WHEN result_ready THEN 0.75 ELSE confidence END AS confidence,
          CASE WHEN result_ready THEN segments + 1 ELSE segments END AS segments,
          CASE WHEN result_ready THEN 0 ELSE pending_disputes END AS pending_disputes,
          CASE WHEN result_ready THEN revision + 1 ELSE revision END AS revision,
          CASE WHEN result_ready THEN {D.NOW} ELSE updated_at END AS updated_at) FROM pgs p)""",
        D.page_out("npg"),
    ),
)
def g10(spark, sf):
    _, pages = both(spark, sf)
    edited = pages.filter("result_ready").select(
        "doc_id", "page_id", F.lit(0.75).alias("confidence"), (F.col("segments") + 1).alias("segments"), F.lit(0).alias("pending_disputes")
    )
    return I.page_columns(G.save_review(pages, edited, I.now()))


def _tasks(spark, sf):
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderpriority").startswith("3"), " ").otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("filename"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(0).cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("result"),
        F.lit("").alias("error"),
    )


_TASK_OUT = "coalesce(strftime(completed_at, '%Y-%m-%d'), '') AS completed"


@check(
    "g6_recover_tasks",
    """SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN '服务重启中断了这次识别' ELSE '' END AS error FROM orders""",
)
def g6_tasks(spark, sf):
    return G.recover_tasks(_tasks(spark, sf), I.now()).select("task_id", "status", "error")


@check(
    "g12_finish_tasks",
    """SELECT o_orderkey AS task_id, CASE WHEN o_orderpriority LIKE '3%' THEN '未命名图片' ELSE o_orderpriority END AS filename,
    CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN o_totalprice > 200000 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS duration_ms,
    CASE WHEN o_orderstatus <> 'P' AND o_totalprice > 200000 THEN 'too large' ELSE '' END AS error,
    CASE WHEN o_orderstatus <> 'P' AND o_totalprice <= 200000 THEN 'done' ELSE '' END AS result,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE '2030-01-01' END AS completed FROM orders""",
)
def g12(spark, sf):
    tasks = G.start_tasks(_tasks(spark, sf))
    large = F.col("o_totalprice") > 200000
    outcomes = I.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("task_id"),
        F.when(~large, "done").alias("result"),
        F.floor("o_totalprice").cast("long").alias("duration_ms"),
        F.when(large, "too large").otherwise("").alias("error"),
    )
    return G.finish_tasks(tasks, outcomes, I.now()).select(
        "task_id", "filename", "status", "duration_ms", "error", F.coalesce("result", F.lit("")).alias("result"),
        F.coalesce(F.date_format("completed_at", "yyyy-MM-dd"), F.lit("")).alias("completed"),
    )


_USERS = """
usr AS (SELECT c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' || upper(c_name) || ' '
          WHEN c_mktsegment = 'MACHINERY' THEN 'user/' || c_custkey WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Nation ' || c_nationkey
          WHEN c_nationkey = 3 THEN 'x' WHEN c_nationkey = 4 THEN 'customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')
          ELSE c_name END AS username,
        CASE WHEN c_nationkey = 5 THEN 'root' WHEN c_nationkey = 6 THEN 'admin' ELSE 'user' END AS role,
        c_acctbal < 0 AS disabled FROM customer)"""


def _users(spark, sf):
    nation = F.col("c_nationkey")
    name = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit(" "), F.upper("c_name"), F.lit(" ")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("user/"), F.col("c_custkey").cast("string")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("Nation "), nation.cast("string")))
        .when(nation == 3, "x")
        .when(nation == 4, F.concat(F.lit("customer#"), F.lpad((F.col("c_custkey") + 1).cast("string"), 9, "0")))
        .otherwise(F.col("c_name"))
    )
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        name.alias("username"),
        F.when(nation == 5, "root").when(nation == 6, "admin").otherwise("user").alias("role"),
        (F.col("c_acctbal") < 0).alias("disabled"),
    )


@check(
    "p21_validate_users",
    Q.query(
        _USERS + f""", n AS (SELECT *, {Q.trim('username')} AS t FROM usr)""",
        rf"""SELECT user_id, username, violation FROM (SELECT *, CASE WHEN length(t) < 2 OR length(t) > 32 THEN 'length'
          WHEN regexp_matches(t, '[{Q.W}\p{{Cc}}/\\:''"]') THEN 'character' WHEN role NOT IN ('admin', 'user') THEN 'role' END AS violation FROM n)
        WHERE violation IS NOT NULL
        UNION ALL SELECT user_id, username, 'taken' FROM n WHERE lower(t) IN (SELECT lower(t) FROM n GROUP BY 1 HAVING count(*) > 1)""",
    ),
)
def p21(spark, sf):
    return U.validate_users(_users(spark, sf))


@check(
    "a16_admin_guard",
    Q.query(
        _USERS,
        """SELECT count(*) FILTER (WHERE w) AS admins_before, count(*) FILTER (WHERE w AND user_id % 3 = 2) AS admins_after,
        count(*) FILTER (WHERE w AND user_id % 3 <> 2) AS admins_removed,
        count(*) FILTER (WHERE w AND user_id % 3 <> 2) = 0 OR count(*) FILTER (WHERE w AND user_id % 3 = 2) >= 1 AS allowed
        FROM (SELECT *, role = 'admin' AND NOT disabled AS w FROM usr)""",
    ),
)
def a16(spark, sf):
    users = _users(spark, sf)
    kind = F.col("user_id") % 3
    changes = users.filter("role = 'admin'").select(
        "user_id",
        F.when(kind == 0, "user").alias("role"),
        F.lit(None).cast("boolean").alias("disabled"),
        (kind == 1).alias("deleted"),
    )
    return U.admin_guard(users, changes)
