"""SQL of the derived document and page tables, and of the table updates."""

NOW = "TIMESTAMP '2030-01-01 00:00:00'"

DOCS = """
doc AS (SELECT o_orderkey AS doc_id, o_custkey AS user_id,
  'scan ' || o_orderkey || CASE WHEN o_orderpriority LIKE '5%' THEN '.pdf' ELSE '.png' END AS name,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'pdf' ELSE 'image' END AS source_type,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  CASE WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '1%' THEN 'preparing'
       WHEN o_orderstatus = 'P' THEN 'ready' WHEN o_orderpriority LIKE '5%' THEN 'cancelled'
       WHEN o_orderpriority LIKE '1%' THEN 'failed' ELSE 'completed' END AS status,
  'p/one|p/' || lower(substr(o_orderpriority, 3, 3)) AS engines, o_orderpriority LIKE '1%' AS auto_arbitrate,
  o_orderdate AS created_at, o_orderdate AS updated_at, '' AS error FROM orders),
docs AS (SELECT *, CASE WHEN status = 'completed' THEN created_at END AS completed_at FROM doc)"""

PAGES = """
li AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey
         ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS pos
       FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)),
lst AS (SELECT *, CASE WHEN l_quantity <= 2 THEN 'preparing' WHEN l_returnflag || l_linestatus IN ('NF', 'AF') THEN 'completed'
          WHEN l_returnflag || l_linestatus = 'NO' THEN 'queued' WHEN l_returnflag || l_linestatus = 'AO' THEN 'ready'
          WHEN l_returnflag || l_linestatus = 'RF' THEN 'failed' ELSE 'processing' END AS status FROM li),
rdy AS (SELECT *, status = 'completed' OR (status = 'failed' AND l_tax = 0) AS result_ready FROM lst),
pgs AS (SELECT l_orderkey AS doc_id, 'page-' || lpad(CAST(pos + 1 AS VARCHAR), 6, '0') AS page_id, pos,
  l_linenumber AS source_page, status, l_quantity > 2 AS image_ready, result_ready,
  CASE WHEN result_ready THEN 1 - l_discount ELSE 0.0 END AS confidence,
  CASE WHEN result_ready THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS segments,
  CASE WHEN result_ready THEN CAST(round(l_tax * 100) AS BIGINT) ELSE 0 END AS pending_disputes,
  CASE WHEN result_ready THEN l_partkey ELSE 0 END AS duration_ms, l_linenumber AS revision, '' AS error,
  l_shipdate AS updated_at, l_suppkey AS mark FROM rdy)"""

BOTH = DOCS + "," + PAGES

REQUESTS = """
req AS (SELECT doc_id, CASE WHEN user_id < doc_id / 10 THEN engines ELSE 'p/new' END AS engines, auto_arbitrate FROM docs),
sel AS (SELECT doc_id, page_id FROM pgs WHERE mark < 60 AND status NOT IN ('processing', 'preparing')
        UNION ALL SELECT doc_id, CASE WHEN mark = 97 THEN page_id WHEN mark = 98 THEN '' ELSE 'page-999999' END FROM pgs WHERE mark >= 97
        UNION ALL SELECT doc_id, page_id FROM pgs WHERE mark = 97),
known AS (SELECT s.doc_id, s.page_id, s.copies, p.status, p.image_ready FROM
          (SELECT doc_id, page_id, count(*) AS copies FROM sel GROUP BY ALL) s
          LEFT JOIN pgs p ON p.doc_id = s.doc_id AND p.page_id = s.page_id),
found AS (
  SELECT doc_id, 1 AS pr, 'no page selected' AS violation FROM req WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.doc_id = req.doc_id)
  UNION ALL SELECT r.doc_id, 2, 'settings differ from the running job' FROM req r JOIN docs d USING (doc_id)
            WHERE d.status = 'processing' AND r.engines <> d.engines
  UNION ALL SELECT doc_id, 3, 'blank page id' FROM known WHERE page_id = ''
  UNION ALL SELECT doc_id, 4, 'repeated page id' FROM known WHERE copies > 1
  UNION ALL SELECT doc_id, 5, 'document is being prepared' FROM docs WHERE status = 'preparing'
  UNION ALL SELECT doc_id, 6, 'page is not prepared' FROM known WHERE NOT image_ready OR status = 'preparing'
  UNION ALL SELECT doc_id, 7, 'page is being processed' FROM known WHERE status = 'processing'
  UNION ALL SELECT doc_id, 8, 'unknown page id' FROM known WHERE status IS NULL),
rejected AS (SELECT doc_id, arg_min(violation, pr) AS violation FROM found GROUP BY doc_id)"""

DEQUEUE = REQUESTS.replace("UNION ALL SELECT r.doc_id, 2", "UNION ALL SELECT r.doc_id, 92").replace(
    "SELECT doc_id, 5,", "SELECT doc_id, 95,"
).replace("SELECT doc_id, 6,", "SELECT doc_id, 96,").replace(
    "SELECT doc_id, 1 AS pr", "SELECT doc_id, 91 AS pr"
).replace("FROM found GROUP BY", "FROM found WHERE pr < 90 GROUP BY")


def counts(pages):
    return f"""
cnt AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE image_ready) AS prepared_pages,
        count(*) FILTER (WHERE status = 'completed') AS processed_pages, count(*) FILTER (WHERE status = 'failed') AS failed_pages,
        sum(pending_disputes) AS pending_disputes, bool_or(status IN ('queued', 'processing')) AS active,
        bool_or(status IN ('ready', 'preparing')) AS waiting FROM {pages} GROUP BY doc_id)"""


def page_out(pages):
    return f"""SELECT doc_id, page_id, pos, status, result_ready, round(confidence, 6) AS confidence, segments, pending_disputes,
    duration_ms, revision, error, strftime(updated_at, '%Y-%m-%d') AS updated FROM {pages}"""


def doc_out(docs):
    return f"""SELECT d.doc_id, d.status, d.engines, d.auto_arbitrate, d.error,
    coalesce(strftime(d.completed_at, '%Y-%m-%d'), '') AS completed, strftime(d.updated_at, '%Y-%m-%d') AS updated,
    coalesce(page_count, 0) AS page_count, coalesce(prepared_pages, 0) AS prepared_pages,
    coalesce(processed_pages, 0) AS processed_pages, coalesce(failed_pages, 0) AS failed_pages,
    CAST(coalesce(pending_disputes, 0) AS BIGINT) AS pending_disputes FROM {docs} d LEFT JOIN cnt USING (doc_id)"""
