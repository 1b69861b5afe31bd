"""Quarantine, manifest, restore, and names that do not collide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.paths import base_name, raw_extension, stem
from siftwell.operators.ordinals import positions
from siftwell.session import checkpointed

MODES = ("copy", "move")


def flagged_keys(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return verdicts.where("is_sensitive").select(*keys).dropDuplicates(list(keys))


def quarantine(
    source: DataFrame, verdicts: DataFrame | None, keys: Sequence[str], mode: str = "move"
) -> tuple[DataFrame, DataFrame]:
    """``(quarantined, remaining)``: the flagged source rows, and what the source then holds.

    Nothing is changed in place. ``copy`` leaves the source whole, ``move`` takes the
    flagged rows out of it. Flagged items that are no longer in the source are skipped.

    With ``verdicts=None`` the source carries ``is_sensitive`` itself (see ``with_verdicts``)
    and is split by a filter: no join, so the payload is never shuffled.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if verdicts is None:
        taken, rest = source.where("is_sensitive"), source.where("NOT is_sensitive")
    else:
        flagged = flagged_keys(verdicts, keys)
        taken = source.join(flagged, list(keys), "left_semi")
        rest = source.join(flagged, list(keys), "left_anti")
    return taken, source if mode == "copy" else rest


def numbered_name(name: Column, number: Column) -> Column:
    """``f.txt`` and 2 give ``f_2.txt``."""
    return F.concat(stem(name), F.lit("_"), number.cast("string"), raw_extension(name))


def resolve_names(flagged: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """``(path, name, dest_name)`` with destination names unique among each other and ``existing``.

    ``existing`` is ``(dest_name)``, the names earlier runs of the day have taken. An item
    keeps its name if that is free; otherwise it gets ``name_1``, ``name_2``, ..., the first
    number nobody has. Items claim in this order: the first item (by path) of every
    distinct name, then all others by path. The first claimants then keep their own names,
    and a numbered name can only collide with a literal one, never with another numbered
    one, so each name can be numbered by itself without looking at the rest.

    Very common names are safe: all numbering is by ``positions``, which splits a name.
    """
    # Both are read several times below; what they derive from (a scan) should run once.
    claims = checkpointed(flagged.select(F.col(path).alias("path"), base_name(F.col(path)).alias("name")))
    taken = checkpointed(existing.select(F.col("dest_name").alias("name")).dropDuplicates())

    # An existing name sits in front of all claims for it, so that position 0 owns the name.
    queue = claims.select("name", "path", F.lit(True).alias("claim")).unionByName(
        taken.select("name", F.lit("").alias("path"), F.lit(False).alias("claim"))
    )
    queued = checkpointed(positions(queue, ["name"], ["path"], out="place"))
    owners = queued.where("place = 0 and claim").select("path", "name", F.col("name").alias("dest_name"))
    waiting = queued.where("place > 0 and claim").select("path", "name", (F.col("place") - 1).alias("slot"))

    # Numbers that literal names use up, as (name they belong to, number).
    literal = claims.select("name").unionByName(taken).dropDuplicates()
    parts = literal.select(
        F.regexp_extract(stem(F.col("name")), r"(?s)^(.+)_([1-9][0-9]{0,17})\z", 1).alias("head"),
        F.regexp_extract(stem(F.col("name")), r"(?s)^(.+)_([1-9][0-9]{0,17})\z", 2).alias("digits"),
        raw_extension(F.col("name")).alias("ext"),
    ).where("digits <> ''")
    blocked = parts.select(F.concat("head", "ext").alias("name"), F.col("digits").cast("bigint").alias("number"))
    ranked = checkpointed(positions(blocked, ["name"], ["number"], out="nth"))

    # A blocked number with (number - 1 - nth) free ones before it shifts every later slot
    # by one. Merged into one queue, an item's place is its slot plus the shifts before it.
    merged = waiting.select("name", "slot", F.lit(1).alias("kind"), "path").unionByName(
        ranked.select(
            "name",
            (F.col("number") - 1 - F.col("nth")).alias("slot"),
            F.lit(0).alias("kind"),
            F.concat(F.lit(""), F.col("nth").cast("string")).alias("path"),
        )
    )
    placed = positions(merged, ["name"], ["slot", "kind", "path"], out="before")
    numbered = placed.where("kind = 1").select(
        "path", "name", numbered_name(F.col("name"), F.col("before") + 1).alias("dest_name")
    )
    # Numbering reads its input several times, and so does what is built on the names.
    return checkpointed(owners.unionByName(numbered))


def build_manifest(
    named: DataFrame, target: str, mode: str, run_id: str, scan_date: str, first_seq: int = 1
) -> DataFrame:
    """One row per quarantined item: where it was, where it is, and in which order it went."""
    numbered = positions(named, [], ["path"], out="_pos")
    return numbered.select(
        (F.col("_pos") + first_seq).alias("seq"),
        F.col("path").alias("src_path"),
        F.concat(F.lit(target.rstrip("/\\") + "/"), F.col("dest_name")).alias("dest_path"),
        F.col("name").alias("original_name"),
        F.col("dest_name").alias("backup_name"),
        (F.col("name") != F.col("dest_name")).alias("renamed"),
        F.lit(mode).alias("mode"),
        F.lit(run_id).alias("run_id"),
        F.lit(scan_date).cast("date").alias("scan_date"),
    )


def restore(manifest: DataFrame, quarantined: DataFrame, remaining: DataFrame) -> DataFrame:
    """The source after putting quarantined rows back under their original paths.

    ``quarantined`` is ``(dest_path, payload...)``, ``remaining`` is ``(path, payload...)``. A
    restored row replaces one at the same path. Where several entries go back to one path
    the last in manifest order stays, as it would when replayed in order; that is settled
    on the manifest alone, before any payload moves.
    """
    payload = [c for c in quarantined.columns if c != "dest_path"]
    last = manifest.groupBy("src_path").agg(F.max(F.struct("scan_date", "run_id", "seq", "dest_path")).alias("_last"))
    back = (
        last.select(F.col("src_path").alias("path"), F.col("_last.dest_path").alias("dest_path"))
        .join(quarantined, "dest_path")
        .select("path", *payload)
    )
    kept = remaining.select("path", *payload).join(back.select("path"), "path", "left_anti")
    return kept.unionByName(back)
