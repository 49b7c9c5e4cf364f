"""Model catalog and run configuration.

``catalog``: ``provider_id, provider_alias, base_url, has_api_key, model_id, ref, alias, context, api``.
``configs``: ``config_id, engines, arbiter, duplicate_checker`` and the timeouts and attempts.
Credentials are never columns here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variorum.functions import text as T

# Supported protocols, the output budget and the run defaults.
CHAT = "openai-chat-completions"
RESPONSES = "openai-responses"
MESSAGES = "anthropic-messages"
APIS = (CHAT, RESPONSES, MESSAGES)
OUTPUT_TOKENS = 8192
TIMEOUT_SECONDS = 120
MAX_ATTEMPTS = 2


def reference(provider: str, model: str) -> Column:
    return F.concat(T.trim_space(provider), F.lit("/"), T.trim_space(model))


def or_else(alias: str, fallback: str) -> Column:
    """The alias when it shows something, else the id."""
    return F.when(T.is_blank(alias), F.col(fallback)).otherwise(F.col(alias))


def with_budget(catalog: DataFrame) -> DataFrame:
    half = F.expr("context div 2")
    return catalog.withColumn(
        "max_tokens", F.when((half > 0) & (half < OUTPUT_TOKENS), half).otherwise(OUTPUT_TOKENS).cast("long")
    )


def with_names(catalog: DataFrame) -> DataFrame:
    return (
        catalog.withColumn("ref", reference("provider_id", "model_id"))
        .withColumn("display", or_else("alias", "model_id"))
        .withColumn("provider_name", or_else("provider_alias", "provider_id"))
    )


def engine_ordinals(selection: DataFrame) -> DataFrame:
    """``config_id, engines`` to one row per place: repeats stay distinct by ``ordinal`` from 1."""
    return selection.select("config_id", F.posexplode("engines").alias("pos", "ref")).select(
        "config_id", (F.col("pos") + 1).alias("ordinal"), T.trim_space("ref").alias("ref")
    )


def resolve_engines(selection: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog rows for every place, in order, and an error row per unknown reference.

    Whether the catalog is broadcast is left to its measured size.
    """
    wanted = engine_ordinals(selection)
    named = with_names(catalog)
    resolved = wanted.join(named, "ref")
    errors = wanted.join(named.select("ref"), "ref", "left_anti").withColumn("error", F.lit("unknown model"))
    return resolved, errors


def name_engines(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn(
        "agent", F.concat("display", F.lit(" · "), "provider_name", F.lit("#"), F.col("ordinal").cast("string"))
    )


def arbiter_name(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("agent", F.concat(F.lit("arbiter:"), "display", F.lit(" ("), "provider_name", F.lit(")")))


def checker_name(resolved: DataFrame) -> DataFrame:
    return resolved.withColumn("agent", F.concat(F.lit("fast-model:"), "display", F.lit(" ("), "provider_name", F.lit(")")))


def dangling_refs(configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References of engines, arbiter and checker that name no catalog model."""
    single = F.array(
        F.struct(F.lit("arbiter").alias("field"), F.col("arbiter").alias("ref")),
        F.struct(F.lit("duplicate_checker").alias("field"), F.col("duplicate_checker").alias("ref")),
    )
    named = F.filter(single, lambda s: ~T.is_blank(s["ref"]))
    engines = F.transform("engines", lambda e: F.struct(F.lit("engines").alias("field"), e.alias("ref")))
    refs = configs.select("config_id", F.explode(F.concat(engines, named)).alias("r")).select(
        "config_id", "r.field", T.trim_space("r.ref").alias("ref")
    )
    known = catalog.select(reference("provider_id", "model_id").alias("ref"))
    return refs.join(known, "ref", "left_anti").select("config_id", "field", "ref")


def catalog_checks(providers: DataFrame, models: DataFrame, configs: DataFrame) -> DataFrame:
    """Violations ``scope, name, violation`` of a catalog and its run settings.

    ``providers``: ``provider_id, base_url``; ``models``: ``provider_id, model_id, alias, context,
    api``; ``configs``: ``config_id`` with timeouts and attempts, where 0 means the default.
    """
    pid, mid = T.trim_space("provider_id"), T.trim_space("model_id")

    def rows(df: DataFrame, scope: str, name: Column, *rules: tuple[Column, str]) -> DataFrame:
        broken = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
        return df.select(F.lit(scope).alias("scope"), name.alias("name"), F.explode(broken).alias("violation"))

    one = providers.withColumn("_id", pid)
    repeated_providers = one.groupBy("_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    two = models.withColumn("_id", F.concat(pid, F.lit("/"), mid))
    repeated_models = two.groupBy("_id").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")

    def span(name: str) -> Column:
        value = F.coalesce(name, F.lit(0))
        return (value < 0) | (value > 10)

    def negative(name: str) -> Column:
        return F.coalesce(name, F.lit(0)) < 0

    parts = [
        rows(
            one, "provider", F.col("_id"),
            (F.col("_id") == "", "empty id"),
            (F.col("_id").contains("/"), "slash in id"),
            (T.is_blank("base_url"), "empty base_url"),
        ),
        repeated_providers.select(F.lit("provider").alias("scope"), F.col("_id").alias("name"), F.lit("repeated id").alias("violation")),
        rows(
            two, "model", F.col("_id"),
            (mid == "", "empty id"),
            (T.is_blank("alias"), "blank alias"),
            (F.coalesce("context", F.lit(0)) <= 0, "context"),
            (~F.coalesce("api", F.lit("")).isin(*APIS), "unsupported api"),
        ),
        repeated_models.select(F.lit("model").alias("scope"), F.col("_id").alias("name"), F.lit("repeated id").alias("violation")),
        rows(
            configs, "config", F.col("config_id").cast("string"),
            (negative("engine_timeout_seconds"), "engine_timeout_seconds"),
            (negative("arbiter_timeout_seconds"), "arbiter_timeout_seconds"),
            (span("engine_max_attempts"), "engine_max_attempts"),
            (span("arbiter_max_attempts"), "arbiter_max_attempts"),
        ),
    ]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def complete_config(configs: DataFrame, template: dict) -> DataFrame:
    """Missing (null) fields from the template; the old single timeout feeds both new ones; 0 means the default.

    An explicit empty value is the user's choice and stays.
    """
    legacy = F.when(F.coalesce("timeout_seconds", F.lit(0)) > 0, F.col("timeout_seconds"))
    types = dict(configs.dtypes)

    def given(name: str) -> Column:
        value = template[name]
        if isinstance(value, (list, tuple)):
            return F.array(*[F.lit(v) for v in value]).cast(types[name])
        return F.lit(value).cast(types[name])

    def timeout(name: str) -> Column:
        value = F.coalesce(F.col(name), legacy, given(name))
        return F.when(value == 0, TIMEOUT_SECONDS).otherwise(value).cast(types[name])

    def attempts(name: str) -> Column:
        value = F.coalesce(F.col(name), given(name))
        return F.when(value == 0, MAX_ATTEMPTS).otherwise(value).cast(types[name])

    return configs.withColumns(
        {
            **{c: F.coalesce(F.col(c), given(c)) for c in ("engines", "arbiter", "duplicate_checker")},
            **{c: timeout(c) for c in ("engine_timeout_seconds", "arbiter_timeout_seconds")},
            **{c: attempts(c) for c in ("engine_max_attempts", "arbiter_max_attempts")},
        }
    ).drop("timeout_seconds")


def complete_aliases(providers: DataFrame, template: DataFrame) -> DataFrame:
    """A blank provider alias becomes the template's alias for the same id, else the id."""
    known = template.select("provider_id", T.trim_space("provider_alias").alias("_alias")).filter("_alias <> ''")
    return (
        providers.join(known, "provider_id", "left")
        .withColumn(
            "provider_alias",
            F.when(T.is_blank("provider_alias"), F.coalesce("_alias", T.trim_space("provider_id"))).otherwise(
                F.col("provider_alias")
            ),
        )
        .drop("_alias")
    )
