"""Checked queries over the model catalog and run settings.

Brands are providers and parts their models; every order is a run configuration whose engines are
the parts of its line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks import sql as Q
from variorum.operators import catalog as C
from variorum.session import fresh_folder
from variorum.sources import catalogs, files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


CATALOG = """
cat AS (SELECT p_brand AS provider_id, CASE WHEN p_brand LIKE '%3' THEN ' ' ELSE upper(p_brand) END AS provider_alias,
  'https://' || lower(substr(p_brand, 7)) || '.example' AS base_url, 'm' || p_partkey AS model_id,
  CASE WHEN p_type = 'SMALL' THEN '' ELSE p_name END AS alias, CAST(p_size AS BIGINT) * 1000 AS context,
  CASE WHEN p_type IN ('STANDARD', 'ECONOMY') THEN 'openai-chat-completions' WHEN p_type IN ('MEDIUM', 'PROMO') THEN 'openai-responses'
       ELSE 'anthropic-messages' END AS api, p_brand || '/m' || p_partkey AS ref FROM part)"""

SELECTION = """
places AS (SELECT l_orderkey AS config_id, row_number() OVER (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
             CASE WHEN l_suppkey >= 95 THEN 'Brand#0/none' ELSE p_brand || '/m' || l_partkey END AS ref
           FROM lineitem JOIN part ON p_partkey = l_partkey),
firsts AS (SELECT config_id, 1 + max(ordinal) AS ordinal, arg_min(ref, ordinal) AS ref FROM places GROUP BY config_id),
allp AS (SELECT * FROM places UNION ALL SELECT * FROM firsts),
display AS (SELECT *, CASE WHEN alias = '' THEN model_id ELSE alias END AS display,
            CASE WHEN trim(provider_alias) = '' THEN provider_id ELSE provider_alias END AS provider_name FROM cat)"""


def catalog(spark, sf):
    kind = F.col("p_type")
    return I.table(spark, sf, "part").select(
        F.col("p_brand").alias("provider_id"),
        F.when(F.col("p_brand").endswith("3"), " ").otherwise(F.upper("p_brand")).alias("provider_alias"),
        F.concat(F.lit("https://"), F.lower(F.expr("substring(p_brand, 7)")), F.lit(".example")).alias("base_url"),
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_id"),
        F.when(kind == "SMALL", "").otherwise(F.col("p_name")).alias("alias"),
        (F.col("p_size").cast("long") * 1000).alias("context"),
        F.when(kind.isin("STANDARD", "ECONOMY"), C.CHAT).when(kind.isin("MEDIUM", "PROMO"), C.RESPONSES).otherwise(C.MESSAGES).alias("api"),
    )


def selection(spark, sf):
    """config_id, engines: the parts of an order in order, the first one twice."""
    li = I.table(spark, sf, "lineitem").join(
        I.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    ref = F.when(F.col("l_suppkey") >= 95, "Brand#0/none").otherwise(
        F.concat("p_brand", F.lit("/m"), F.col("l_partkey").cast("string"))
    )
    rows = li.select(
        F.col("l_orderkey").alias("config_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", ref.alias("ref")).alias("r"),
    )
    listed = rows.groupBy("config_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    refs = listed.select("config_id", F.transform("r", lambda x: x["ref"]).alias("refs"))
    return refs.select("config_id", F.concat("refs", F.slice("refs", 1, 1)).alias("engines"))


@check(
    "s11_load_catalog",
    Q.query(
        CATALOG,
        "SELECT provider_id, provider_alias, base_url, provider_id LIKE '%2' AS has_api_key, model_id, alias, context, api, ref FROM cat",
    ),
)
def s11(spark, sf):
    """Every part becomes a configuration in JSON; the loader reads them back as one catalog."""
    model = F.struct(F.col("model_id").alias("id"), "context", "alias", "api")
    provider = F.struct(
        F.col("provider_id").alias("id"), F.col("provider_alias").alias("alias"), "base_url",
        F.when(F.col("provider_id").endswith("2"), "secret").otherwise("").alias("api_key"), F.array(model).alias("models"),
    )
    folder = fresh_folder(spark, "catalog")
    catalog(spark, sf).select(F.array(provider).alias("providers")).write.json(folder)
    return catalogs.load_catalog(spark, folder)


@check(
    "p11_with_budget",
    Q.query(
        CATALOG,
        "SELECT ref, CASE WHEN context // 2 > 0 AND context // 2 < 8192 THEN context // 2 ELSE 8192 END AS max_tokens FROM cat",
    ),
)
def p11(spark, sf):
    return C.with_budget(C.with_names(catalog(spark, sf))).select("ref", "max_tokens")


@check(
    "w5_engine_ordinals",
    Q.query(CATALOG + "," + SELECTION, "SELECT config_id, ordinal, ref FROM allp"),
)
def w5(spark, sf):
    return C.engine_ordinals(selection(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@check(
    "j8_p12_resolve_engines",
    Q.query(
        CATALOG + "," + SELECTION,
        """SELECT config_id, ordinal, ref, display || ' · ' || provider_name || '#' || ordinal AS agent, context, api
        FROM allp JOIN display USING (ref)""",
    ),
)
def j8(spark, sf):
    resolved, _ = C.resolve_engines(selection(spark, sf), catalog(spark, sf))
    return C.name_engines(resolved).select(
        "config_id", F.col("ordinal").cast("long").alias("ordinal"), "ref", "agent", "context", "api"
    )


@check(
    "j8_unknown_engines",
    Q.query(CATALOG + "," + SELECTION, "SELECT config_id, ordinal, ref FROM allp WHERE ref NOT IN (SELECT ref FROM cat)"),
)
def j8_unknown(spark, sf):
    return C.resolve_engines(selection(spark, sf), catalog(spark, sf))[1].select(
        "config_id", F.col("ordinal").cast("long").alias("ordinal"), "ref"
    )


@check(
    "j9_dangling_refs",
    Q.query(
        CATALOG + "," + SELECTION,
        """SELECT config_id, 'engines' AS field, ref FROM allp WHERE ref NOT IN (SELECT ref FROM cat)
        UNION ALL SELECT config_id, 'arbiter', arg_min(ref, ordinal) FROM places GROUP BY config_id
                  HAVING arg_min(ref, ordinal) NOT IN (SELECT ref FROM cat)
        UNION ALL SELECT DISTINCT config_id, 'duplicate_checker', 'x/y' FROM places WHERE config_id IN (SELECT config_id FROM places WHERE ordinal = 5)""",
    ),
)
def j9(spark, sf):
    chosen = selection(spark, sf)
    first = F.element_at("engines", 1)
    configs = chosen.withColumn("arbiter", F.concat(F.lit(" "), first)).withColumn(
        "duplicate_checker", F.when(F.size("engines") > 5, "x/y").otherwise(" ")
    )
    return C.dangling_refs(configs, catalog(spark, sf))


_SETTINGS = """
cfg AS (SELECT o_orderkey AS config_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN -5 WHEN o_orderpriority LIKE '2%' THEN NULL WHEN o_orderpriority LIKE '3%' THEN 0 ELSE 60 END AS engine_t,
  CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'P' THEN 30 ELSE 0 END AS arbiter_t,
  CASE WHEN o_orderpriority LIKE '4%' THEN 11 WHEN o_orderpriority LIKE '5%' THEN 0 WHEN o_orderpriority LIKE '1%' THEN NULL ELSE 3 END AS engine_a,
  CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 10 END AS arbiter_a,
  CASE WHEN o_totalprice > 300000 THEN 45 WHEN o_totalprice > 200000 THEN 0 END AS legacy,
  CASE WHEN o_orderstatus = 'O' THEN '' WHEN o_orderstatus = 'F' THEN 'p/mine' END AS arbiter FROM orders)"""


def _settings(spark, sf):
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("config_id"),
        F.lit(None).cast("array<string>").alias("engines"),
        F.when(status == "O", "").when(status == "F", "p/mine").alias("arbiter"),
        F.lit(None).cast("string").alias("duplicate_checker"),
        F.when(priority.startswith("1"), -5).when(priority.startswith("2"), None).when(priority.startswith("3"), 0).otherwise(60).cast("long").alias("engine_timeout_seconds"),
        F.when(status == "O", None).when(status == "P", 30).otherwise(0).cast("long").alias("arbiter_timeout_seconds"),
        F.when(priority.startswith("4"), 11).when(priority.startswith("5"), 0).when(priority.startswith("1"), None).otherwise(3).cast("long").alias("engine_max_attempts"),
        F.when(status == "F", -1).otherwise(10).cast("long").alias("arbiter_max_attempts"),
        F.when(F.col("o_totalprice") > 300000, 45).when(F.col("o_totalprice") > 200000, 0).cast("long").alias("timeout_seconds"),
    )


@check(
    "a15_catalog_checks",
    Q.query(
        CATALOG + "," + _SETTINGS
        + """,
        prov AS (SELECT CASE WHEN s_nationkey = 0 THEN ' ' WHEN s_nationkey = 1 THEN 'a/b' WHEN s_nationkey = 2 THEN 'same '
                 ELSE s_name END AS provider_id, CASE WHEN s_acctbal < 0 THEN ' ' ELSE 'https://x' END AS base_url FROM supplier),
        mod AS (SELECT provider_id, CASE WHEN context = 1000 THEN '' WHEN context = 2000 THEN 'm' ELSE model_id END AS model_id, alias,
                CASE WHEN context = 3000 THEN 0 ELSE context END AS context, CASE WHEN context = 4000 THEN 'soap' ELSE api END AS api FROM cat),
        m2 AS (SELECT *, provider_id || '/' || model_id AS id FROM mod)""",
        """SELECT 'provider' AS scope, trim(provider_id) AS name, 'empty id' AS violation FROM prov WHERE trim(provider_id) = ''
        UNION ALL SELECT 'provider', trim(provider_id), 'slash in id' FROM prov WHERE contains(provider_id, '/')
        UNION ALL SELECT 'provider', trim(provider_id), 'empty base_url' FROM prov WHERE trim(base_url) = ''
        UNION ALL SELECT 'provider', trim(provider_id), 'repeated id' FROM prov GROUP BY trim(provider_id) HAVING count(*) > 1
        UNION ALL SELECT 'model', id, 'empty id' FROM m2 WHERE model_id = ''
        UNION ALL SELECT 'model', id, 'blank alias' FROM m2 WHERE alias = ''
        UNION ALL SELECT 'model', id, 'context' FROM m2 WHERE context <= 0
        UNION ALL SELECT 'model', id, 'unsupported api' FROM m2 WHERE api = 'soap'
        UNION ALL SELECT 'model', id, 'repeated id' FROM m2 GROUP BY id HAVING count(*) > 1
        UNION ALL SELECT 'config', CAST(config_id AS VARCHAR), 'engine_timeout_seconds' FROM cfg WHERE engine_t < 0
        UNION ALL SELECT 'config', CAST(config_id AS VARCHAR), 'engine_max_attempts' FROM cfg WHERE engine_a > 10
        UNION ALL SELECT 'config', CAST(config_id AS VARCHAR), 'arbiter_max_attempts' FROM cfg WHERE arbiter_a < 0""",
    ),
)
def a15(spark, sf):
    nation = F.col("s_nationkey")
    providers = I.table(spark, sf, "supplier").select(
        F.when(nation == 0, " ").when(nation == 1, "a/b").when(nation == 2, "same ").otherwise(F.col("s_name")).alias("provider_id"),
        F.when(F.col("s_acctbal") < 0, " ").otherwise("https://x").alias("base_url"),
    )
    context = F.col("context")
    models = catalog(spark, sf).select(
        "provider_id",
        F.when(context == 1000, "").when(context == 2000, "m").otherwise(F.col("model_id")).alias("model_id"),
        "alias",
        F.when(context == 3000, 0).otherwise(context).alias("context"),
        F.when(context == 4000, "soap").otherwise(F.col("api")).alias("api"),
    )
    return C.catalog_checks(providers, models, _settings(spark, sf))


@check(
    "g11_complete_config",
    Q.query(
        _SETTINGS
        + """, d AS (SELECT *, coalesce(engine_t, CASE WHEN legacy > 0 THEN legacy END, 90) AS et,
             coalesce(arbiter_t, CASE WHEN legacy > 0 THEN legacy END, 90) AS art FROM cfg)""",
        """SELECT config_id, 'p/one|p/two' AS engines, coalesce(arbiter, 'p/judge') AS arbiter, '' AS duplicate_checker,
        CASE WHEN et = 0 THEN 120 ELSE et END AS engine_timeout_seconds, CASE WHEN art = 0 THEN 120 ELSE art END AS arbiter_timeout_seconds,
        CASE WHEN coalesce(engine_a, 4) = 0 THEN 2 ELSE coalesce(engine_a, 4) END AS engine_max_attempts, arbiter_a AS arbiter_max_attempts FROM d""",
    ),
)
def g11(spark, sf):
    template = {
        "engines": ["p/one", "p/two"], "arbiter": "p/judge", "duplicate_checker": "",
        "engine_timeout_seconds": 90, "arbiter_timeout_seconds": 90, "engine_max_attempts": 4, "arbiter_max_attempts": 4,
    }
    return C.complete_config(_settings(spark, sf), template).withColumn("engines", F.array_join("engines", "|"))


@check(
    "g11_complete_aliases",
    Q.query(
        CATALOG,
        """SELECT c.model_id, CASE WHEN trim(c.provider_alias) <> '' THEN c.provider_alias WHEN c.provider_id = 'Brand#23' THEN 'Twenty'
        ELSE c.provider_id END AS provider_alias FROM cat c""",
    ),
)
def g11_aliases(spark, sf):
    models = catalog(spark, sf)
    template = (
        models.select("provider_id").distinct().select(
            "provider_id", F.when(F.col("provider_id") == "Brand#23", " Twenty ").otherwise(" ").alias("provider_alias")
        )
    )
    return C.complete_aliases(models, template).select("model_id", "provider_alias")


_IMAGE = "'GIF89a' || CAST(p_partkey AS VARCHAR) || repeat('x', CAST(p_size AS INTEGER) * 3)"


@check(
    "s12_build_requests",
    Q.query(
        CATALOG + f""",
        req AS (SELECT p_partkey AS page_id, p_brand || '/m' || p_partkey AS ref, 'Say "it"' AS sys, 'Read ' || p_name AS prompt,
                base64(encode({_IMAGE})) AS img, p_type = 'PROMO' OR p_type = 'LARGE' OR p_type = 'ECONOMY' AS has FROM part)""",
        r"""SELECT page_id, ref, api,
        CASE WHEN api = 'openai-chat-completions' THEN
          '{"model":"' || model_id || '","messages":[{"role":"system","content":"Say \"it\""},{"role":"user","content":'
          || CASE WHEN has THEN '[{"type":"image_url","image_url":{"url":"data:image/gif;base64,' || img || '"}},{"type":"text","text":"' || prompt || '"}]'
             ELSE '"' || prompt || '"' END || '}],"max_tokens":' || mt || ',"stream":true}'
        WHEN api = 'openai-responses' THEN
          '{"model":"' || model_id || '","instructions":"Say \"it\"","input":'
          || CASE WHEN has THEN '[{"role":"user","content":[{"type":"input_image","image_url":"data:image/gif;base64,' || img
             || '"},{"type":"input_text","text":"' || prompt || '"}]}]' ELSE '"' || prompt || '"' END || ',"max_output_tokens":' || mt || ',"stream":true}'
        ELSE '{"model":"' || model_id || '","system":"Say \"it\"","messages":[{"role":"user","content":['
          || CASE WHEN has THEN '{"type":"image","source":{"type":"base64","media_type":"image/gif","data":"' || img || '"}},' ELSE '' END
          || '{"type":"text","text":"' || prompt || '"}]}],"max_tokens":' || mt || ',"stream":true}' END AS body
        FROM (SELECT *, CASE WHEN context // 2 < 8192 THEN context // 2 ELSE 8192 END AS mt FROM req JOIN cat USING (ref))""",
    ),
)
def s12(spark, sf):
    parts = I.table(spark, sf, "part")
    image = F.concat(F.lit("GIF89a"), F.col("p_partkey").cast("string"), F.expr("repeat('x', cast(p_size * 3 as int))"))
    pages = parts.select(
        F.col("p_partkey").alias("page_id"),
        F.concat("p_brand", F.lit("/m"), F.col("p_partkey").cast("string")).alias("ref"),
        F.lit('Say "it"').alias("system"),
        F.concat(F.lit("Read "), "p_name").alias("prompt"),
        F.when(F.col("p_type").isin("PROMO", "LARGE", "ECONOMY"), F.encode(image, "utf-8")).alias("image"),
    )
    return files.build_requests(pages, catalog(spark, sf)).select("page_id", "ref", "api", "body")
