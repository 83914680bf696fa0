"""Merkle manifest of a dataset by slot pivots.

A level of the tree is one aggregation: conditional aggregates spread the children of a parent
into ``FANOUT`` slot columns.  The slots in a row, hashed, are the parent; the slots without the own one are a
child's siblings.  Levels go up until every group has one node, and the siblings come down the
same pivots, so that no row is ever joined with its siblings and no group is larger than the fan-out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import running, same, staged

FANOUT = 16
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings in a row."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def entry(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row's values in order."""
    return digest(*[entry(c) for c in columns])


def _slots(payload: Column, slot: Column) -> list[Column]:
    return [F.max(F.when(slot == k, payload)).alias(f"slot{k}") for k in range(FANOUT)]


def _beside(k: int, of: str = "node") -> Column:
    """What stands before and after slot k, in a row; empty slots leave nothing."""
    held = [F.col(f"slot{j}.{of}") for j in range(FANOUT)]
    return F.struct(F.concat_ws("", *held[:k]).alias("before"), F.concat_ws("", *held[k + 1 :]).alias("after"))


def _placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Nodes with at, their place inside their group."""
    return running(nodes, ["group"], order, {"place": F.lit(1)}, name).withColumnRenamed("place", "at")


def _pivot(nodes: DataFrame, payload: Column, name: str) -> DataFrame:
    """Nodes (group, at, many) to their parents: group, at, many, the slots, and node, the parent's digest."""
    up = F.shiftright("at", FANOUT.bit_length() - 1)
    wide = nodes.groupBy("group", up.alias("parent"), "many").agg(*_slots(payload, F.col("at") % FANOUT))
    node = digest(F.concat_ws("", *[f"slot{k}.node" for k in range(FANOUT)]))
    return staged(wide.withColumnRenamed("parent", "at").withColumn("node", node), name)


def _levels(leaves: DataFrame, payload: Column, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Pivots of all levels of every group's tree, lowest first, and what remains: group, node.

    ``leaves`` has group, at (0 to many - 1 inside the group), many and node.  A group with one node is at its end.
    """
    most = leaves.agg(F.max("many")).first()[0] or 0
    rest = [leaves.where("many = 1").select("group", "node")]
    pivots, nodes = [], leaves.where("many > 1")
    while most > 1:
        pivots.append(_pivot(nodes, payload, f"{name}-{len(pivots)}"))
        most = -(-most // FANOUT)
        nodes = pivots[-1].select("group", "at", "node", F.ceil(F.col("many") / FANOUT).cast("long").alias("many"))
        rest.append(nodes.where("many = 1").select("group", "node"))
        nodes, payload = nodes.where("many > 1"), F.struct("node")
    return pivots, reduce(DataFrame.union, rest)


def _children(parents: DataFrame, more: list[str]) -> DataFrame:
    """The children of pivots that carry ``path``, the steps from the parent to the root: their slot's fields, the digest as
    child, and their own path."""
    each = [
        F.when(F.col(f"slot{k}").isNotNull(), F.struct(F.lit(k).alias("k"), F.col(f"slot{k}").alias("held"), _beside(k).alias("step")))
        for k in range(FANOUT)
    ]
    single = parents.select("group", "at", *more, "path", F.explode(F.filter(F.array(*each), lambda c: c.isNotNull())).alias("child"))
    path = F.concat(F.array("child.step"), "path").cast(STEPS)
    return single.select("group", (F.col("at") * FANOUT + F.col("child.k")).alias("at"), *more, "child.held", path.alias("path"))


def _descend(pivots: list[DataFrame], tops: DataFrame, more: list[str], name: str) -> DataFrame:
    """Children of the lowest pivots with their paths; ``tops`` has group, path (above the group's end) and ``more``.

    A parent either ends its group, then the path of ``tops`` is its own, or it is itself a child of the pivot above.
    """
    above, found = None, None
    for level in range(len(pivots) - 1, -1, -1):
        parents = pivots[level]
        ends = parents.where(F.col("many") <= FANOUT).join(tops.withColumnRenamed("group", "_group"), same(F.col("group"), F.col("_group"))).drop("_group")
        if above is not None:
            keyed = above.select(F.col("group").alias("_group"), F.col("at").alias("_at"), *more, "path")
            inner = parents.where(F.col("many") > FANOUT)
            ends = ends.unionByName(inner.join(keyed, same(F.col("group"), F.col("_group")) & (F.col("at") == F.col("_at"))).drop("_group", "_at"))
        found = _children(ends, more)
        if level:
            above = staged(found.drop("held"), f"{name}-{level}")
    return found


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id: str = "doc_id",
    group: str = "source",
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: the id and group columns, leaf, subroot, root, proof, proof_sha256, folded_root and verified.

    Leaves are digests of ``columns``; inside a group they ascend by ``id``, null first.  Every run of 16 consecutive nodes becomes
    the digest of their digests, until one node, the group's subroot, remains; subroots, ordered by group in UTF-8 bytes, null first,
    give the root in the same way.  ``proof`` holds the steps from leaf to root: the siblings before and after, as hex in a row.
    ``changed`` names columns that are read otherwise when a row is verified (a later copy of the data, say): folded_root is the
    fold of the leaf as read then with the original siblings, and verified tells whether it is the root.

    Rows that tie in ``id`` stand in the order of their leaves; repeated rows are leaves each.  A null is a dash, an empty text a
    text of no bytes.  A group of one row has its leaf as subroot, a table of one group its subroot as root.  Columns
    not named in ``columns`` play no part.  An empty table has no rows and no root.
    """
    seen = leaf(*[(changed or {}).get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col(group).alias("group"), F.col(id).alias("id"), leaf(*[F.col(c) for c in columns]).alias("node"), seen.alias("seen"))
    leaves = _placed(rows, ["id", "node"], "leaves")
    sizes = leaves.groupBy("group").agg(F.count(F.lit(1)).alias("many")).withColumnRenamed("group", "_group")
    # One small row per group: Spark broadcasts it where it is small, and deals hot groups out where it is not.
    leaves = staged(leaves.join(staged(sizes, "sizes"), same(F.col("group"), F.col("_group"))).drop("_group"), "leaves")
    own = F.struct("node", "id", "seen")
    pivots, subroots = _levels(leaves, own, "nodes")
    subroots = staged(subroots, "subroots")
    # The groups' roots are leaves of the second tree, of one group.
    ranked = _placed(subroots.withColumnRenamed("group", "name").withColumn("group", F.lit(0)), ["name"], "subroots")
    ranked = ranked.withColumn("many", F.lit(subroots.count()).cast("long"))
    upper, end = _levels(ranked, F.struct("node", F.col("name").alias("name")), "upper")
    root = end.first()
    root = root["node"] if root else None
    nowhere = F.array().cast(STEPS)
    if upper:
        top = staged(docs.sparkSession.range(1).select(F.lit(0).alias("group"), nowhere.alias("path")), "top")
        found = _descend(upper, top, [], "upper-path")
        tops = found.select(F.col("held.name").alias("group"), F.col("held.node").alias("subroot"), "path")
    else:
        tops = ranked.select(F.col("name").alias("group"), F.col("node").alias("subroot"), nowhere.alias("path"))
    tops = staged(tops, "tops")
    alone = leaves.where("many = 1").join(tops.withColumnRenamed("group", "_group"), same(F.col("group"), F.col("_group"))).select("group", own.alias("held"), "subroot", "path")
    found = alone
    if pivots:
        found = found.unionByName(_descend(pivots, tops, ["subroot"], "path").select("group", "held", "subroot", "path"))
    folded = F.aggregate("path", F.col("held.seen"), lambda node, step: digest(step["before"], node, step["after"]))
    siblings = digest(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""))
    told = found.select(
        F.col("held.id").alias(id), F.col("group").alias(group), F.col("held.node").alias("leaf"), "subroot",
        F.lit(root).cast("string").alias("root"), F.col("path").alias("proof"), siblings.alias("proof_sha256"), folded.alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
