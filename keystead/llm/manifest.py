"""Merkle manifest of a table, kept as a postorder append log.

Rows become leaves, leaves of one group a tree whose runs of ``fanout`` consecutive nodes are hashed together, and the
groups' roots one more tree. A builder takes an aligned block of ``fanout ** height`` nodes of one level and appends
nodes in the order in which they are complete (children before their parent), so builders work independently and no
task sees more than a block; block roots are the leaves of the next tier. The place of any node in its group's log
follows from subtree sizes alone (``position``), which is how a proof finds its siblings: a block reads its own segment
of the log and gets the path of its root from the tier above.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import stored

STEP = "array<struct<left:string,right:string>>"
LOG = "gid long, n long, block long, pos long, level int, digest string, top boolean"


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` for null."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*(field(c) for c in cols)), 256)


def subtree(leaves: int, level: int, fanout: int) -> int:
    """Nodes of a subtree whose root is at ``level`` and that has so many leaves."""
    return sum(-(-leaves // fanout**k) for k in range(level + 1))


def position(n: int, level: int, index: int, fanout: int) -> int:
    """Place, from 0, in the postorder log of a tree of ``n`` leaves of the node ``index`` of ``level``."""
    before, at = index * fanout**level, 0
    done = before
    while done:  # all nodes of complete subtrees over the leaves before
        at, done = at + done, done // fanout
    return at + subtree(min(n - before, fanout**level), level, fanout) - 1


def height_of(n: int, fanout: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // fanout), level + 1
    return level


def _builder(fanout: int, base: int, height: int):
    """Appends the nodes of one block: its leaves (tier 0 only) and all levels up to the block's root."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        gid, block, n = (t.column(c)[0].as_py() for c in ("gid", "block", "n"))
        first, top = t.column("idx")[0].as_py(), min(base + height, height_of(n, fanout))
        pending: list[list[str]] = [[] for _ in range(top - base + 1)]
        done = [0] * (top - base + 1)  # nodes completed so far at each level
        out: list[tuple[int, int, str]] = []

        def append(k: int, digest: str) -> None:
            index = first // fanout**k + done[k]
            done[k] += 1
            if k or not base:
                out.append((position(n, base + k, index, fanout), base + k, digest))
            pending[k].append(digest)
            if len(pending[k]) == fanout and base + k < top:
                close(k)

        def close(k: int) -> None:
            digest, pending[k] = hashlib.sha256("".join(pending[k]).encode()).hexdigest(), []
            append(k + 1, digest)

        for digest in t.column("digest").to_pylist():
            append(0, digest)
        for k in range(top - base):  # the last runs of the tree may be shorter
            if pending[k]:
                close(k)
        m = len(out)
        return pa.table({
            "gid": pa.array([gid] * m, pa.int64()), "n": pa.array([n] * m, pa.int64()), "block": pa.array([block] * m, pa.int64()),
            "pos": pa.array([x[0] for x in out], pa.int64()), "level": pa.array([x[1] for x in out], pa.int32()),
            "digest": pa.array([x[2] for x in out], pa.string()),
            "top": pa.array([x[1] == top for x in out], pa.bool_()),
        })

    return run


def _prover(fanout: int, base: int, height: int, keep: tuple[str, ...], schema: pa.Schema):
    """Paths of the leaves of one block: siblings read from its log segment, then the path of the block's root."""

    def run(log: pa.Table, leaves: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return schema.empty_table()
        leaves = leaves.sort_by("idx")
        n, idx, digests = leaves.column("n")[0].as_py(), leaves.column("idx").to_pylist(), leaves.column("digest").to_pylist()
        top = min(base + height, height_of(n, fanout))
        nodes, above, subroot = {}, [], None
        for pos, digest, up, root in zip(*(log.column(c).to_pylist() for c in ("pos", "digest", "path", "subroot")), strict=True):
            if pos is None:
                above, subroot = up, root
            else:
                nodes[pos] = digest
        width = [n]  # nodes of each level
        for _ in range(top):
            width.append(-(-width[-1] // fanout))
        of = dict(zip(idx, digests, strict=True))

        def node(level: int, index: int) -> str:
            return of[index] if level == base else nodes[position(n, level, index, fanout)]

        known: dict[tuple[int, int], list[dict]] = {}

        def path(level: int, index: int) -> list[dict]:
            """Siblings from this node up to the root of all; shared by all leaves below it."""
            if level == top:
                return above
            if (level, index) not in known:
                a = index - index % fanout
                b = min(a + fanout, width[level])
                step = {"left": "".join(node(level, j) for j in range(a, index)), "right": "".join(node(level, j) for j in range(index + 1, b))}
                known[level, index] = [step, *path(level + 1, index // fanout)]
            return known[level, index]

        out = {c: leaves.column(c) for c in keep}
        out["subroot"] = pa.array([subroot] * len(idx), pa.string())
        out["path"] = pa.array([path(base, i) for i in idx], schema.field("path").type)
        return pa.table(out).select(schema.names).cast(schema)

    return run


class Manifest:
    """Tree of trees over ``rows``: (grp, ord, digest, and ``extra`` columns by other names, which come back with the proofs).

    Leaves of a group ascend by ``ord`` (null first; ties by digest, so that repeated rows have a defined order); groups
    ascend by ``grp`` (null first, bytewise) and their roots are the leaves of the upper tree. An empty table has no root
    and no proofs. Only these columns are read, so other columns of any name, and texts of any length, cost nothing here.
    """

    def __init__(self, rows: DataFrame, extra: tuple[str, ...] = (), fanout: int = 3, height: int = 7):
        self.fanout, self.height, self.extra = fanout, height, extra
        self.block = F.floor(F.col("idx") / F.lit(fanout**height)).cast("long")
        placed = rows.select("grp", "ord", "digest", *extra).repartitionByRange("grp", "ord", "digest").sortWithinPartitions("grp", "ord", "digest")
        # row numbers within the sorted parts; written at once, so that every reader sees the same parts
        placed = stored(placed.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves").withColumn("part", F.shiftright("row", 33))
        runs = placed.groupBy("part", "grp").agg(F.count("*").alias("c"), F.min("row").alias("lo"))
        # no more rows than parts and groups together, and no group has more of them than there are parts
        before = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        runs = stored(runs.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("n", F.sum("c").over(W.partitionBy("grp"))), "manifest-runs")
        groups = self._numbered(runs.select("grp").distinct())
        runs = runs.join(groups, runs["grp"].eqNullSafe(groups["g_name"])).select(
            F.col("part").alias("r_part"), F.col("grp").alias("r_grp"), "gid", "n", (F.col("start") - F.col("lo")).alias("shift"))
        self.leaves = placed.join(runs, (F.col("part") == F.col("r_part")) & F.col("grp").eqNullSafe(F.col("r_grp"))).select(
            "gid", "n", (F.col("row") + F.col("shift")).alias("idx"), "grp", "ord", "digest", *extra)
        self.tiers = self._built(self.leaves.select("gid", "n", "idx", "digest"))
        self.subroots = self._roots(self.tiers)
        tops = self.subroots.select(
            F.lit(0).cast("long").alias("gid"), F.lit(groups.count()).cast("long").alias("n"), F.col("gid").alias("idx"), "digest", F.col("n").alias("size"))
        self.tops = stored(tops, "manifest-subroots")
        self.above = self._built(self.tops.drop("size"))

    @property
    def root(self) -> str | None:
        rows = self._roots(self.above).take(1)
        return rows[0]["digest"] if rows else None

    def log(self) -> DataFrame:
        """(gid, pos, level, digest) of the groups' logs, to be read in the order of ``pos``."""
        out = self.tiers[0][1]
        for _, more in self.tiers[1:]:
            out = out.unionByName(more)
        return out.select("gid", "pos", "level", "digest")

    def proofs(self) -> DataFrame:
        """(gid, idx, grp, ord, digest, extra, subroot, path): siblings left and right of a leaf's way to the root, level by level."""
        if not self.tiers:
            return self.leaves.select("gid", "idx", "grp", "ord", "digest", *self.extra, F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(STEP).alias("path"))
        tops = self._proved(self.above, None, self.tops.select("gid", "n", "idx", "digest", "size"), ("idx", "size", "digest"))
        tops = stored(tops.select(F.col("idx").alias("gid"), F.col("size").alias("n"), F.col("digest").alias("subroot"), "path"), "manifest-tops")
        return self._proved(self.tiers, tops, self.leaves, ("gid", "idx", "grp", "ord", "digest", *self.extra))

    def _numbered(self, groups: DataFrame) -> DataFrame:
        """(g_name, gid): groups numbered in their order."""
        rows = groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("row", F.monotonically_increasing_id())
        rows = stored(rows, "manifest-order").withColumn("part", F.shiftright("row", 33))
        parts = rows.groupBy("part").agg(F.count("*").alias("c"), F.min("row").alias("lo"))  # one row per part
        parts = parts.withColumn("shift", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("lo"))
        return rows.join(parts.select("part", "shift"), "part").select(F.col("grp").alias("g_name"), (F.col("row") + F.col("shift")).alias("gid"))

    def _built(self, leaves: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """(leaves, log) of every tier."""
        tiers, base, most = [], 0, leaves.agg(F.max("n")).first()[0]
        while most is not None and (not tiers or most > self.fanout**base):
            leaves = leaves.withColumn("block", self.block)
            log = stored(leaves.groupBy("gid", "block").applyInArrow(_builder(self.fanout, base, self.height), LOG), "manifest-log")
            tiers.append((leaves, log))
            base += self.height
            # groups that have more levels go on with their block roots
            up = log.filter(F.col("top") & (F.col("n") > self.fanout**base))
            leaves = up.select("gid", "n", F.col("block").alias("idx"), "digest")
        return tiers

    def _roots(self, tiers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """(gid, n, digest) of every group: the root of its only block in the last tier that it takes part in."""
        out = self.leaves.select("gid", "n", "digest").limit(0)
        for tier, (_, log) in enumerate(tiers):
            out = out.unionByName(log.filter(F.col("top") & (F.col("n") <= self.fanout ** ((tier + 1) * self.height))).select("gid", "n", "digest"))
        return out

    def _proved(self, tiers: list[tuple[DataFrame, DataFrame]], above: DataFrame | None, lowest: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """``keep`` and the path of every leaf; ``above`` has (gid, n, subroot, path) of the groups' roots.

        Every block gets one row that carries the path of its root: of a group that ends in this tier from ``above``,
        else from the tier over it.
        """
        none = lambda kind: F.lit(None).cast(kind)
        paths = None
        for tier in range(len(tiers) - 1, -1, -1):
            leaves, log = tiers[tier]
            base = tier * self.height
            side = log.filter("level > " + str(base)).select("gid", "block", "pos", "digest", none(STEP).alias("path"), none("string").alias("subroot"))
            if above is not None:
                ends = (F.col("n") <= self.fanout ** (base + self.height)) & (F.col("n") > (self.fanout**base if tier else 0))
                side = side.unionByName(above.filter(ends).select(
                    "gid", F.lit(0).cast("long").alias("block"), none("long").alias("pos"), none("string").alias("digest"), "path", "subroot"))
            if paths is not None:
                side = side.unionByName(paths.select("gid", F.col("idx").alias("block"), none("long").alias("pos"), none("string").alias("digest"), "path", "subroot"))
            own = leaves if tier else lowest.withColumn("block", self.block)
            cols = ("gid", "idx") if tier else keep
            schema = own.select(*cols).withColumns({"subroot": none("string"), "path": none(STEP)}).schema
            paths = side.groupBy("gid", "block").cogroup(own.groupBy("gid", "block")).applyInArrow(
                _prover(self.fanout, base, self.height, cols, to_arrow_schema(schema)), schema)
            if tier:
                paths = stored(paths, "manifest-paths")
        return paths


def folded(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
