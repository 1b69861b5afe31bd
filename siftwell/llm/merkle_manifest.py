"""Merkle manifest of a table: a digest for all of it, and for each row a proof that it belongs.

Each source has a tree over its rows in order of ``doc_id``; every three consecutive nodes become one until one is left,
the source's subroot. The subroots, in order of the source, have a tree of the same kind, whose last node is the root.

Trees are cut into superblocks of ``3 ** LEVELS`` nodes. Going up, a superblock becomes one node of the next tier, tier by
tier, until every tree has one node. Going down, the nodes of a superblock are cogrouped with the one path from it to the
root; that group reduces its levels again, joins them to the path, and (for rows) folds what is presented into a root. So no
group holds more than a superblock, whatever a source holds, and a tier is a hundredth of the one below.

Places come from one range sort of narrow rows (source, id, digests): rows are numbered inside their partition, written, and
partition totals are summed up. Texts are hashed once, where they are read, and never shuffled.

Order: null sources first, then sources bytewise; null ids first, rows with one id by their digest; rows equal in all of
that take any order among themselves (their proofs are then the same set). Repeated rows are leaves of their own. Null
values have a digest of their own. An empty table has no root and gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import checkpointed, small, written

FANOUT = 3
# Levels that a superblock reduces, and so many nodes it has at most.
LEVELS = 5
BLOCK = FANOUT**LEVELS
# A proof has a step per level, from the leaf to the root: the siblings to the left, a mark, those to the right.
STEP, SIDE = "/", ":"

_NODE = "tree long, n long, pos long, digest string"
_PATH = "tree long, pos long, path string"
_PROVED = "doc_id long, leaf string, subroot string, proof string, folded_root string"


def leaf(*columns: Column) -> Column:
    """The digest of a row: each value as its length in UTF-8 bytes, a colon and itself, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def reduced(nodes: list[str], finish: bool) -> list[list[str]]:
    """The levels above consecutive nodes, these first: as many as a superblock has, or with ``finish`` until one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1 if finish else len(levels) <= LEVELS:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return levels


def _steps(levels: list[list[str]], at: int) -> list[str]:
    """The siblings of node ``at`` and of what it becomes, level by level."""
    steps = []
    for level in levels[:-1]:
        run = at // FANOUT * FANOUT
        steps.append("".join(level[run:at]) + SIDE + "".join(level[at + 1 : run + FANOUT]))
        at //= FANOUT
    return steps


def fold(node: str, proof: str) -> str:
    """The root that a node and its proof lead to."""
    for step in proof.split(STEP) if proof else ():
        left, _, right = step.partition(SIDE)
        node = digest(left + node + right)
    return node


def _joined(steps: list[str], path: str) -> str:
    return STEP.join([*steps, path] if path else steps)


def _parent(nodes: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("pos")
    n, pos = int(nodes["n"].iloc[0]), int(nodes["pos"].iloc[0])
    top = reduced(nodes["digest"].tolist(), finish=n <= BLOCK)[-1][0]
    return pd.DataFrame({"tree": nodes["tree"].iloc[:1], "n": -(-n // BLOCK), "pos": pos // BLOCK, "digest": top})


def _proofs(nodes: pd.DataFrame, path: str) -> list[str]:
    """Proofs of a superblock's nodes, which are in order; ``path`` leads from the superblock to the root."""
    levels = reduced(nodes["digest"].tolist(), finish=int(nodes["n"].iloc[0]) <= BLOCK)
    return [_joined(_steps(levels, i), path) for i in range(len(nodes))]


def _descend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    nodes = nodes.sort_values("pos")
    return pd.DataFrame({"tree": nodes["tree"], "pos": nodes["pos"], "path": _proofs(nodes, outer["path"].iloc[0])})


def _prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Proofs of a superblock's leaves, and the root that each presented leaf folds into."""
    leaves = leaves.sort_values("pos")
    leaves["proof"] = _proofs(leaves, outer["path"].iloc[0])
    leaves["subroot"] = outer["subroot"].iloc[0]
    return _folded(leaves)


def _folded(proved: pd.DataFrame) -> pd.DataFrame:
    folded = [fold(node, proof) for node, proof in zip(proved["claim"], proved["proof"], strict=True)]
    return pd.DataFrame({"doc_id": proved["doc_id"].astype("Int64"), "leaf": proved["digest"], "subroot": proved["subroot"], "proof": proved["proof"], "folded_root": folded})


def _fold_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield _folded(part)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, written, with ``place``: the rows' numbers from 0 in the order of the columns ``order``.

    Rows equal in all these columns are dealt out by where they were read, so that no task gets all copies of a row.
    """
    dealt = df.withColumn("dealt", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(*order, "dealt").sortWithinPartitions(*order, "dealt").drop("dealt")
    rows = written(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    totals = rows.groupBy("part").agg(F.count("*").alias("total"))
    # One row per partition that was written.
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = checkpointed(totals.select("part", before.alias("base")))
    return rows.join(small(bases), "part").withColumn("place", F.col("base") + F.col("at")).drop("part", "base", "at")


def _tiers(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Nodes of forests, and those of each tier above, up to one node a tree; ``most`` is the size of the largest tree."""
    tiers = [nodes]
    while most > 1:
        blocks = tiers[-1].where("n > 1").groupBy("tree", F.expr("pos div %d" % BLOCK))
        tiers.append(checkpointed(blocks.applyInPandas(_parent, _NODE)))
        most = -(-most // BLOCK)
    return tiers


def _outer(tiers: list[DataFrame], roots: DataFrame) -> list[DataFrame]:
    """For each tier the ``tree, pos, path`` of its nodes, but for the lowest; ``roots (tree, path)`` continues whole trees.

    The first of the result belongs to the second tier; it holds also the trees that end at the tier below.
    """
    paths: list[DataFrame] = []
    for tier in reversed(tiers[1:]):
        ended = tier.where("n = 1").join(roots, "tree").select("tree", "pos", "path")
        paths.insert(0, checkpointed(ended.unionByName(_down(tier, paths[0]))) if paths else ended)
    return paths


def _blocks(nodes: DataFrame):
    return nodes.where("n > 1").withColumn("block", F.expr("pos div %d" % BLOCK)).groupBy("tree", "block")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    return _blocks(nodes).cogroup(above.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(_descend, _PATH)


def manifest(entries: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of each row of ``entries (doc_id, source, leaf, claim)``.

    ``claim`` is the digest of the row as it is presented (null: the leaf itself). ``proof`` has a step per level, joined by
    ``/``: the siblings to the left, ``:``, those to the right. ``folded_root`` is what the claim and the proof lead to;
    ``verified`` says that it is the root.
    """
    rows = entries.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("leaf").alias("digest"), F.coalesce("claim", "leaf").alias("claim"))
    leaves = numbered(written(rows, "leaves"), ["source", "doc_id", "digest"], "leaves-in-order")
    found = leaves.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = written(numbered(found, ["source"], "sources").withColumnRenamed("place", "tree"), "numbered-sources")
    count, most = sources.agg(F.count("*"), F.max("n")).first()
    if not count:
        return entries.sparkSession.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")

    of = small(sources.withColumnRenamed("source", "name"))
    nodes = leaves.join(of, F.col("source").eqNullSafe(F.col("name"))).withColumn("pos", F.col("place") - F.col("first"))
    tiers = _tiers(nodes.select("tree", "n", "pos", "digest", "doc_id", "claim"), most)
    subroots = checkpointed(_union([tier.where("n = 1").select("tree", F.col("digest").alias("subroot")) for tier in tiers]))

    # The tree of sources: its nodes stand at the sources' numbers.
    heads = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    above = _tiers(heads, count)
    root = above[-1].first()["digest"]
    whole = above[-1].select("tree", F.lit("").alias("path"))
    to_root = _down(heads, _outer(above, whole)[0]) if count > 1 else heads.select("tree", "pos", F.lit("").alias("path"))
    roots = checkpointed(to_root.select(F.col("pos").alias("tree"), "path").join(subroots, "tree"))

    alone = tiers[0].where("n = 1").join(small(roots), "tree").withColumnRenamed("path", "proof")
    proved = alone.select("doc_id", "digest", "claim", "subroot", "proof").mapInPandas(_fold_all, _PROVED)
    if most > 1:
        outer = _outer(tiers, roots.select("tree", "path"))[0].join(small(roots.select("tree", "subroot")), "tree")
        groups = _blocks(tiers[0]).cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))
        proved = proved.unionByName(groups.applyInPandas(_prove, _PROVED))
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
