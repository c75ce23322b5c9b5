"""Parent-child links to full hierarchies.

Method: links are hashed into groups of bounded size; in each a weighted disjoint-set forest maps every node to where
its chain leaves the group (or ends) with the number of links to there. Only nodes that other groups point at are
merged further, several groups into one, level by level, until one group holds all chains; a level too large for its
groups is finished by pointer doubling over joins instead. Results are handed back down the levels by one join each,
which also materialises the paths: each fragment keeps its own stretch of parents.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dumpquarry.session import stage

#: Rows of one merge group at most (on average; groups are hashed), a bound on a task's memory.
GROUP_ROWS = 500_000
#: Groups merged into one from level to level.
FAN_IN = 16

_FRAGMENT = "node long, kind string, target long, steps long, seg array<long>, members array<long>, part long"


class Forest:
    """Weighted disjoint sets over links node -> target, each of a length: the root of a set is where a chain stops."""

    def __init__(self, size: int) -> None:
        self.up = list(range(size))
        self.length = [0] * size

    def find(self, i: int) -> tuple[int, int]:
        """The root of i and the number of links to it; compresses the path."""
        up, length = self.up, self.length
        trail = []
        while up[i] != i:
            trail.append(i)
            i = up[i]
        total = 0
        for j in reversed(trail):
            total += length[j]
            up[j], length[j] = i, total
        return i, total

    def link(self, child: int, parent: int, length: int) -> bool:
        """Hang the root ``child`` under ``parent``; False if that would close a cycle."""
        root, more = self.find(parent)
        if root == child:
            return False
        self.up[child], self.length[child] = root, length + more
        return True


def contract(rows: pd.DataFrame, with_seg: bool = True) -> pd.DataFrame:
    """Contract the chains of one group: every open row then names a target outside the group, or a cycle or an end inside it.

    kind: ``open`` (goes on at target), ``root`` (target is the root), ``cycle`` (runs into a cycle; the row of the
    smallest member also lists all members). seg: the real nodes from the row's node up to, without, its target.
    """
    nodes = rows["node"].tolist()
    kinds = rows["kind"].tolist()
    targets = [None if t is None or t != t else int(t) for t in rows["target"].tolist()]
    steps = rows["steps"].tolist()
    segs = [list(map(int, s)) for s in rows["seg"].tolist()]
    place = {n: i for i, n in enumerate(nodes)}
    forest = Forest(len(nodes))
    inner = [place.get(targets[i], -1) if kinds[i] == "open" else -1 for i in range(len(nodes))]
    cyclic: dict[int, list[int]] = {}
    for i, j in enumerate(inner):
        if j >= 0 and not forest.link(i, j, steps[i]):
            ring, k = list(segs[i]), j
            while k != i:
                ring += segs[k]
                k = inner[k]
            cyclic[i] = ring
    out_kind, out_target, out_steps, out_seg, out_members = [], [], [], [], []
    for i in range(len(nodes)):
        root, far = forest.find(i)
        if root in cyclic:
            out_kind.append("cycle")
            out_target.append(min(cyclic[root]))
            out_steps.append(0)
            out_members.append(cyclic[root] if i == root else None)
        else:
            out_kind.append(kinds[root])
            out_target.append(targets[root])
            out_steps.append(far + steps[root])
            out_members.append(None)
        seg: list[int] = []
        if with_seg and root not in cyclic:
            k = i
            while k != root:
                seg += segs[k]
                k = inner[k]
            if kinds[root] in ("open", "root"):
                seg += segs[root]
        out_seg.append(seg)
    return pd.DataFrame({
        "node": nodes, "kind": out_kind, "target": pd.array(out_target, dtype="Int64"), "steps": out_steps,
        "seg": out_seg, "members": out_members, "part": rows["part"].tolist(),
    })


def _groups(df: DataFrame, with_seg: bool) -> DataFrame:
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return contract(rows, with_seg)

    return df.groupBy("part").applyInPandas(solve, _FRAGMENT)


def _double(level: DataFrame) -> DataFrame:
    """Finish a level that is too large for one group: pointer doubling, each round one join. Members of cycles come out one row each."""
    rows = level.count()
    current = level
    for _ in range(math.ceil(math.log2(rows + 1)) + 1):
        nexts = current.select(F.col("node").alias("target"), F.col("kind").alias("k2"), F.col("target").alias("t2"), F.col("steps").alias("s2"), F.col("seg").alias("g2"))
        moved = current.where("kind = 'open'").join(nexts, "target", "left")
        current = stage(
            moved.select(
                "node",
                F.expr("case when k2 is null then 'detached' when k2 = 'open' then 'open' else k2 end").alias("kind"),
                F.expr("case when k2 is null then target else t2 end").alias("target"),
                F.expr("steps + coalesce(s2, 0)").alias("steps"),
                # chains in cycles would double for ever; no chain without a cycle holds a node twice
                F.expr("case when array_contains(g2, node) then seg else concat(seg, coalesce(g2, array())) end").alias("seg"),
                "members",
                "part",
            ).unionByName(current.where("kind != 'open'")),
            "doubled",
        )
        if current.where("kind = 'open'").isEmpty():
            return current
    # what is still open leads into a cycle, and after so many steps stands on one
    ring = current.where("kind = 'open'").select(F.col("target").alias("node")).distinct()
    members = level.join(ring, "node", "left_semi").select("node", F.col("seg").alias("ring"))
    return current.join(members, "node", "left").select(
        "node",
        F.expr("case when kind = 'open' then 'cycle' else kind end").alias("kind"),
        "target",
        "steps",
        F.expr("case when kind = 'open' then array() else seg end").cast("array<long>").alias("seg"),
        F.coalesce("ring", "members").alias("members"),
        "part",
    )


def resolve(categories: DataFrame, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN, min_groups: int = 12, key: str = "id", parent: str = "parent_id", depth: str = "depth", loaded: str = "loaded_at", paths: bool = True) -> DataFrame:
    """Every node once: id, kind (``root``, ``cycle``, ``below_cycle``, ``detached``), root_id, links (to the root), depth (as stored), path.

    ``root`` means that the chain reaches a root; path then runs from the root to the node, and root_id and links are
    set; of other kinds they are null. A parent that no row has makes a node ``detached``; a node that is its own
    parent is a cycle. Defined results: rows with a null key are left out; repeated rows count once, of differing
    rows of a key the latest loaded holds; an empty table gives no rows; other columns are ignored. Depth is not
    limited; a chain of n nodes has paths of n * n / 2 ids together, so ask for paths only where they are needed.
    """
    spark = categories.sparkSession
    nodes = stage(
        categories.where(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("node"))
        .agg(F.max(F.struct(F.col(loaded).alias("l"), F.col(parent).cast("long").alias("up"), F.col(depth).alias("depth"))).alias("v"))
        .select("node", F.col("v.up").alias("up"), F.col("v.depth").alias("depth")),
        "nodes",
    )
    rows = nodes.count()
    parts = max(1, min_groups, math.ceil(rows / group_rows))
    level = nodes.select(
        "node",
        F.when(F.col("up").isNull(), "root").otherwise("open").alias("kind"),
        F.coalesce("up", "node").alias("target"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.array("node").alias("seg"),
        F.lit(None).cast("array<long>").alias("members"),
        F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"),
    )
    fragments: list[DataFrame] = []
    while True:
        fragment = stage(_groups(level, paths or parts > 1), f"level{len(fragments)}")
        fragments.append(fragment)
        if parts == 1:
            break
        wanted = fragment.where("kind = 'open'").select(F.col("target").alias("node")).distinct()
        level = stage(fragment.withColumn("members", F.lit(None).cast("array<long>")).join(wanted, "node", "left_semi"), "boundary")
        left = level.count()
        if left == 0:
            break
        fewer = max(math.ceil(parts / fan_in), math.ceil(left / group_rows))
        if fewer >= parts:
            fragments.append(stage(_double(level), "doubled"))
            break
        parts = fewer
        level = level.withColumn("part", F.pmod("part", F.lit(parts)) if parts > 1 else F.lit(0).cast("long"))

    # top down: what is still open at a level goes on in the solved level above it, or its target is nowhere
    solved = fragments[-1].withColumn("kind", F.expr("case when kind = 'open' then 'detached' else kind end"))
    columns = ["node", "kind", "target", "steps"] + ["seg"] * paths
    for fragment in reversed(fragments[:-1]):
        above = solved.select(F.col("node").alias("target"), F.col("kind").alias("k2"), F.col("target").alias("t2"), F.col("steps").alias("s2"), *[F.col("seg").alias("g2")] * paths)
        joined = fragment.where("kind = 'open'").join(above, "target", "left")
        solved = joined.select(
            "node",
            F.coalesce("k2", F.lit("detached")).alias("kind"),
            F.coalesce("t2", "target").alias("target"),
            (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"),
            *[F.expr("case when k2 = 'root' then concat(seg, g2) end").alias("seg")] * paths,
        ).unionByName(fragment.where("kind != 'open'").select(*columns))
    ring = fragments[0].select(F.explode("members").alias("node"))
    for fragment in fragments[1:]:
        ring = ring.unionByName(fragment.select(F.explode("members").alias("node")))
    on_cycle = ring.distinct().withColumn("on_cycle", F.lit(True))
    path = F.expr("case when kind = 'root' then reverse(seg) end") if paths else F.lit(None).cast("array<long>")
    is_root = F.col("kind") == "root"
    return (
        solved.join(on_cycle, "node", "left")
        .join(nodes.select("node", "depth"), "node")
        .select(
            F.col("node").alias("id"),
            F.when(F.col("kind") == "cycle", F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle")).otherwise(F.col("kind")).alias("kind"),
            F.when(is_root, F.col("target")).alias("root_id"),
            F.when(is_root, F.col("steps")).alias("links"),
            "depth",
            path.alias("path"),
        )
    )


def hierarchy_faults(resolved: DataFrame) -> DataFrame:
    """Of :func:`resolve`'s rows those that are no sound part of a tree: id, kind (``cycle``, ``below_cycle``, ``detached``, ``depth``)."""
    wrong = F.col("depth").isNull() | (F.col("depth") != F.col("links"))
    return resolved.select("id", F.when(F.col("kind") != "root", F.col("kind")).when(wrong, F.lit("depth")).alias("kind")).where("kind is not null")


def descendants(resolved: DataFrame) -> DataFrame:
    """All pairs of an ancestor and a descendant, from the paths: ancestor_id, descendant_id, distance. In long form, so a root with very many descendants is no large row."""
    return resolved.where("kind = 'root'").select(F.posexplode("path").alias("at", "ancestor_id"), F.col("id").alias("descendant_id"), "links").select(
        "ancestor_id", "descendant_id", (F.col("links") - F.col("at")).alias("distance")
    ).where("distance > 0")


__all__ = ["FAN_IN", "GROUP_ROWS", "Forest", "contract", "descendants", "hierarchy_faults", "resolve"]
