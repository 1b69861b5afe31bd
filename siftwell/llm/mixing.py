"""Mixing sources to target weights.

Tokens are summed per source, a water level shares the whole among the sources by weight, each source's repetition
rate is its target over its own size, and every document is taken ``floor(rate)`` times plus once more where a number
hashed from seed and document lies below the fraction.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null id is hashed as such. Rows
that repeat both id and text are taken alike. A source without tokens has target 0 and is not taken. Empty tables give
empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import BROADCAST_ROWS, WORD, checkpointed, row_columns, whole_row

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: ``source, source_size, target, rate``.

    The shares add up to the whole unless caps bind: with sources ordered by cap over weight, those below the level are
    full, and the others split what is left by weight. All windows run over one row per source.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    weighted = weighted.withColumn("cap", max_repeat * F.col("source_size"))
    fill = F.col("cap") / F.col("weight")
    order = Window.orderBy(fill, F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = weighted.withColumn("fill", fill).withColumn("level", level).withColumn("place", F.row_number().over(order))
    # The level that holds is the first one, in order of cap over weight, not above its source's own.
    held = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(held, F.lit(0.0)) * F.col("weight"))
    return levels.withColumn("target", target).select(
        "source", "source_size", "target", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("rate")
    )


def copies(rate: Column, doc_id: Column, text_key: Column, seed: str) -> Column:
    """``floor(rate)`` plus one where the hashed number of seed and document is below the fraction."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), text_key).cast("binary"))
    share = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    whole = F.floor(rate)
    return whole + F.when(share < rate - whole, 1).otherwise(0)


def rated(docs: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Documents with ``size, source_size, target, rate, copies``. Needs ``doc_id, text, source``.

    The rates have one row per source. They are counted, and broadcast below a bound; beyond it both sides are
    salted by document, so that a source with a third of all rows is spread.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_key"))
    rates = checkpointed(source_rates(docs.select("source", size_of(F.col("text")).alias("size")), weights, max_repeat))
    if rates.count() <= BROADCAST_ROWS:
        joined = sized.join(F.broadcast(rates), sized["source"].eqNullSafe(rates["source"]), "inner").drop(rates["source"])
    else:
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
        spread = rates.withColumnRenamed("source", "rate_source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = (salted["salt"] == spread["salt"]) & salted["source"].eqNullSafe(spread["rate_source"])
        joined = salted.join(spread, on, "inner").drop("rate_source", "salt")
    return joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("text_key"), seed))


def mix(docs: DataFrame, seed: str = "mix", weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each row as often as it is taken.

    Needs ``doc_id, text, source``; only these are used for the decision, the others travel along.
    """
    rates = checkpointed(source_rates(docs.select("source", size_of(F.col("text")).alias("size")), weights, max_repeat))
    inner = rates.select(F.col("source").alias("rate_source"), "rate")
    text_key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_key")
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int").alias("salt")
    rows = docs.select(whole_row(docs), "doc_id", "source", text_key, salt)
    if rates.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(inner), rows["source"].eqNullSafe(inner["rate_source"]), "inner")
    else:
        inner = inner.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(inner, rows["source"].eqNullSafe(inner["rate_source"]) & (F.col("salt") == F.col("rate_salt")), "inner")
    times = copies(F.col("rate"), F.col("doc_id"), F.col("text_key"), seed).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times))).select(*row_columns(docs))
