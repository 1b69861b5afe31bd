"""Rules and settings from JSON: one file, or a table with a JSON document per row."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.rules import DEFAULT_RULES, UNNAMED_RULE, RuleError, RuleSet, make_rules

# The settings used where the user's file has none.
DEFAULT_SETTINGS = {
    "max_file_size_mb": 100,
    "match_threshold": 3,
    "backup_base_path": ".\\sensitive_backup",
    "dev": False,
    "file_timeout_sec": 30,
    "thread_idle_timeout_sec": 60,
}
SETTING_KEYS = ("rules", *DEFAULT_SETTINGS)

RULE_TYPE = "array<struct<name:string,pattern:string>>"
CONFIG_SCHEMA = (
    f"rules {RULE_TYPE}, max_file_size_mb bigint, match_threshold bigint, backup_base_path string, "
    "dev boolean, file_timeout_sec bigint, thread_idle_timeout_sec bigint"
)


@dataclass(frozen=True)
class Settings:
    max_file_size_mb: int = DEFAULT_SETTINGS["max_file_size_mb"]
    match_threshold: int = DEFAULT_SETTINGS["match_threshold"]
    backup_base_path: str = DEFAULT_SETTINGS["backup_base_path"]
    dev: bool = DEFAULT_SETTINGS["dev"]
    file_timeout_sec: int = DEFAULT_SETTINGS["file_timeout_sec"]
    thread_idle_timeout_sec: int = DEFAULT_SETTINGS["thread_idle_timeout_sec"]

    @property
    def max_bytes(self) -> int:
        return self.max_file_size_mb * 1024 * 1024

    @property
    def mode(self) -> str:
        return "copy" if self.dev else "move"


def load_config(spark: SparkSession, path: str) -> tuple[RuleSet, Settings, list[str]]:
    """Read one JSON settings file: its rules, its settings and the keys it lacks.

    A settings file is read by the driver because its rules become part of the plan. It is
    checked strictly: a wrong type is an error, and nothing on disk is changed.
    """
    rows = spark.read.option("wholetext", True).text(path).limit(2).collect()
    if len(rows) != 1:
        raise RuleError(f"expected one settings file at {path}")
    return parse_config(rows[0].value)


def parse_config(text: str) -> tuple[RuleSet, Settings, list[str]]:
    try:
        given = json.loads(text.removeprefix("\ufeff"))
    except json.JSONDecodeError as problem:
        raise RuleError(f"settings are not valid JSON: {problem}") from problem
    if not isinstance(given, dict):
        raise RuleError("settings must be a JSON object")
    missing = sorted(set(SETTING_KEYS) - set(given))
    values = {}
    for key, default in DEFAULT_SETTINGS.items():
        value = given.get(key, default)
        wanted = type(default)
        if wanted is int and isinstance(value, float) and value.is_integer():
            value = int(value)
        if type(value) is not wanted:
            raise RuleError(f"{key} must be {wanted.__name__}, not {value!r}")
        values[key] = value
    rules = given.get("rules", [{"name": n, "pattern": p} for n, p in DEFAULT_RULES])
    if not isinstance(rules, list):
        raise RuleError("rules must be a list")
    return make_rules(rules), Settings(**values), missing


def parsed_config(config_json: Column) -> Column:
    """A JSON text column as a typed struct; absent keys are null."""
    return F.from_json(config_json, CONFIG_SCHEMA)


def settings_with_defaults(config: Column) -> list[Column]:
    """Every setting of a parsed config, filled with its default where it is missing."""
    return [F.coalesce(config[key], F.lit(default)).alias(key) for key, default in DEFAULT_SETTINGS.items()]


def rules_of(configs: DataFrame, keys: list[str], config_json: str = "config_json") -> DataFrame:
    """``(keys..., rule_idx, rule_name, pattern)`` for a table of JSON configs.

    A config without rules gets the default ones; a rule without a name is named by its
    1-based position.
    """
    defaults = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern")) for n, p in DEFAULT_RULES])
    rules = F.coalesce(parsed_config(F.col(config_json))["rules"], defaults.cast(RULE_TYPE))
    listed = configs.select(*keys, F.posexplode(rules).alias("rule_idx", "r"))
    name = F.coalesce("r.name", F.concat(F.lit(UNNAMED_RULE), (F.col("rule_idx") + 1).cast("string")))
    return listed.select(*keys, "rule_idx", name.alias("rule_name"), F.col("r.pattern").alias("pattern"))


def missing_keys(config_json: Column) -> Column:
    """The setting names a JSON config lacks, sorted."""
    wanted = F.array(*[F.lit(k) for k in sorted(SETTING_KEYS)])
    given = F.coalesce(F.json_object_keys(config_json), F.array().cast(T.ArrayType(T.StringType())))
    return F.array_sort(F.array_except(wanted, given))
