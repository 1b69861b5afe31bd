"""Settings as data: one JSON configuration per row of ``part``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.rules import DEFAULT_RULES, UNNAMED_RULE
from siftwell.plans.registry.base import query, table
from siftwell.sources.settings import DEFAULT_SETTINGS, missing_keys, parsed_config, rules_of, settings_with_defaults

# Small parts have no rules, large ones no size limit, so defaults and missing keys occur.
NO_RULES_BELOW, NO_LIMIT_ABOVE = 10, 25


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_partkey, config_json)``; null fields are left out of the JSON text."""
    size = F.col("p_size")
    rules: Column = F.when(
        size >= NO_RULES_BELOW,
        F.array(
            F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("pattern")),
            F.struct(F.lit(None).cast("string").alias("name"), F.col("p_type").alias("pattern")),
        ),
    )
    limit = F.when(size <= NO_LIMIT_ABOVE, F.floor("p_retailprice").cast("bigint"))
    config = F.struct(
        rules.alias("rules"), size.alias("match_threshold"), limit.alias("max_file_size_mb"), (size > 30).alias("dev")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(config).alias("config_json"))


_DEFAULTS_SQL = " UNION ALL ".join(
    f"SELECT p_partkey, {i} AS rule_idx, '{name}' AS rule_name, '{pattern}' AS pattern FROM part WHERE p_size < {NO_RULES_BELOW}"
    for i, (name, pattern) in enumerate(DEFAULT_RULES)
)


@query(
    "load_rules",
    f"""SELECT p_partkey, 0 AS rule_idx, p_name AS rule_name, p_brand AS pattern FROM part WHERE p_size >= {NO_RULES_BELOW}
    UNION ALL SELECT p_partkey, 1, '{UNNAMED_RULE}2', p_type FROM part WHERE p_size >= {NO_RULES_BELOW}
    UNION ALL {_DEFAULTS_SQL}""",
)
def load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_of(configs(spark, sf_dir), ["p_partkey"])


@query(
    "missing_keys",
    f"""SELECT p_partkey, 'backup_base_path,file_timeout_sec'
    || CASE WHEN p_size > {NO_LIMIT_ABOVE} THEN ',max_file_size_mb' ELSE '' END
    || CASE WHEN p_size < {NO_RULES_BELOW} THEN ',rules' ELSE '' END || ',thread_idle_timeout_sec' AS missing FROM part""",
)
def missing_keys_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.array_join(missing_keys(F.col("config_json")), ",")
    return configs(spark, sf_dir).select("p_partkey", missing.alias("missing"))


@query(
    "settings_with_defaults",
    f"""SELECT p_partkey, CASE WHEN p_size <= {NO_LIMIT_ABOVE} THEN CAST(floor(p_retailprice) AS BIGINT)
           ELSE {DEFAULT_SETTINGS["max_file_size_mb"]} END AS max_file_size_mb,
    CAST(p_size AS BIGINT) AS match_threshold, '{DEFAULT_SETTINGS["backup_base_path"]}' AS backup_base_path, p_size > 30 AS dev,
    CAST({DEFAULT_SETTINGS["file_timeout_sec"]} AS BIGINT) AS file_timeout_sec,
    CAST({DEFAULT_SETTINGS["thread_idle_timeout_sec"]} AS BIGINT) AS thread_idle_timeout_sec FROM part""",
)
def settings_with_defaults_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = configs(spark, sf_dir).select("p_partkey", parsed_config(F.col("config_json")).alias("c"))
    return parsed.select("p_partkey", *settings_with_defaults(F.col("c")))
