"""Hot-key handling shared by window and join operators.

A key is *hot* when it holds more than ``1/HOT_SHARE`` of the rows (and at least
``HOT_FLOOR`` rows), so there are fewer than ``HOT_SHARE`` hot keys whatever the
size of the table. The hot-key table is therefore safe to broadcast. Counting is
one map-side combined aggregation on the key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored

HOT_SHARE = 10_000
HOT_FLOOR = 1_000_000


def hot_keys(
    df: DataFrame,
    keys: list[str],
    floor: int = HOT_FLOOR,
    share: int = HOT_SHARE,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Keys above the hot limit with their row count ``_n`` and limit ``_cap``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra)
    limit = counts.select(
        F.greatest(F.sum("_n") / F.lit(share), F.lit(float(floor))).alias("limit")
    ).scalar()
    return counts.withColumn("_cap", limit).filter(F.col("_n") > F.col("_cap"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], renamed: dict[str, str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[renamed[k]])
    return cond


def hot_slices(
    df: DataFrame, keys: list[str], order: list[str], floor: int = HOT_FLOOR, oversplit: int = 4
) -> tuple[DataFrame, bool]:
    """``df`` with ``_seg`` and ``_hot``: slices of the hot keys in ``order``, 0 elsewhere; and if any key is hot.

    Rows of hot keys are range partitioned by key and all of ``order``, whose cuts Spark takes from a sample of the
    rows: however rows bunch in time, slices are even, and only rows equal in all order columns stay together. The
    slice numbers are written with the rows, so that every later step sees the same cuts. Without a hot key
    nothing is written or moved. There are no more slices than ``(oversplit + 2) * HOT_SHARE``.
    """
    hot = hot_keys(df, keys, floor).select(*[F.col(k).alias(f"_h_{k}") for k in keys], (F.ceil(F.col("_n") / F.col("_cap")) * oversplit).cast("int").alias("_parts"))
    found = hot.collect()  # fewer than HOT_SHARE keys
    if not found:
        return df.withColumn("_hot", F.lit(False)).withColumn("_seg", F.lit(0)), False
    hot = df.sparkSession.createDataFrame(found, hot.schema)
    names = {k: f"_h_{k}" for k in keys}
    out = df.join(F.broadcast(hot), _same(df, hot, keys, names), "left").withColumn("_hot", F.col("_parts").isNotNull())
    out = out.drop("_parts", *names.values())
    cut = out.filter("_hot").repartitionByRange(sum(r["_parts"] for r in found), *keys, *order).withColumn("_seg", F.spark_partition_id())
    return out.filter("NOT _hot").withColumn("_seg", F.lit(0)).unionByName(stored(cut, "slices")), True


def with_segments(df: DataFrame, keys: list[str], order: list[str], floor: int = HOT_FLOOR, oversplit: int = 4) -> DataFrame:
    return hot_slices(df, keys, order, floor, oversplit)[0]


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], fields: list[str], floor: int = HOT_FLOOR
) -> DataFrame:
    """Add struct ``_prev``: ``fields`` of the preceding row of the same key.

    Cold keys take one window; a hot key is cut into even slices, and the last row
    of each slice (a combined aggregate, at most a few ten thousand rows in all) is
    carried over.
    """
    cut, any_hot = hot_slices(df, keys, order, floor)
    row = F.struct(*fields)
    w = W.partitionBy(*keys, "_seg").orderBy(*order)
    inner = cut.withColumn("_prev", F.lag(row).over(w))
    if not any_hot:
        return inner.drop("_seg", "_hot")
    tails = (
        cut.filter("_hot")
        .groupBy(*keys, "_seg")
        .agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    )
    carried = tails.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_seg").alias("_c_seg"),
        F.lag("_tail").over(W.partitionBy(*keys).orderBy("_seg")).alias("_carry"),
    )
    renamed = {k: f"_c_{k}" for k in keys}
    cond = _same(inner, carried, keys, renamed) & (inner["_seg"] == carried["_c_seg"])
    return (
        inner.join(F.broadcast(carried), cond, "left")
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
        .drop("_carry", "_c_seg", "_seg", "_hot", *renamed.values())
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    cond: Column | None = None,
    how: str = "inner",
    floor: int = HOT_FLOOR,
    oversplit: int = 4,
    salt_by: list[str] | None = None,
    spread: bool = False,
) -> DataFrame:
    """Equi-join on ``keys`` in which hot keys of ``big`` are spread over salts.

    The salt is a hash of ``salt_by`` (a row id, by default all columns that can
    be hashed), so a recomputed task puts every row where it was before.

    ``spread`` is for joins that meet many candidates per input row: their work
    does not follow the input bytes, so the full number of shuffle partitions is
    kept instead of letting AQE merge small ones.

    Rows of ``small`` under a hot key are repeated once per salt; everything else
    is shuffled once as usual. ``keys`` must exist on both sides.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    hot = hot_keys(big, keys, floor).select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        (F.ceil(F.col("_n") / F.col("_cap")) * oversplit).cast("int").alias("_salts"),
    )
    names = {k: f"_h_{k}" for k in keys}

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), _same(df, hot, keys, names), "left").drop(*names.values())

    ident = salt_by or [f.name for f in big.schema.fields if "map" not in f.dataType.simpleString()]
    left = marked(big).withColumn(
        "_salt",
        F.coalesce(F.pmod(F.xxhash64(*ident), F.col("_salts").cast("bigint")), F.lit(0)).cast("int"),
    ).drop("_salts")
    right = (
        marked(small)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    if spread:
        n = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = (d.repartition(n, *keys, "_salt") for d in (left, right))
    joined = left.join(right, [*keys, "_salt"], how)
    if cond is not None:
        if how != "inner":
            raise ValueError("a residual condition needs an inner join")
        joined = joined.filter(cond)
    return joined.drop("_salt")


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, floor: int, share: int = HOT_SHARE) -> DataFrame:
    """Equi-join in which a key that is hot on either side becomes a grid of smaller joins.

    The rows of one side take a row of the grid each, those of the other a column (by a hash of their id), and are
    repeated along it; so every pair still meets once, and no task pairs more than the hot limit of one side with that
    of the other. Fewer than ``2 * share`` keys can be hot, so their table is safe to broadcast.
    """
    sides = []
    for df, size in ((left, "_rows"), (right, "_cols")):
        hot = hot_keys(df, keys, floor, share)
        sides.append(hot.select(*keys, F.ceil(F.col("_n") / F.col("_cap")).cast("int").alias(size)))
    hot = sides[0].join(sides[1], keys, "full").select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_rows", "_cols")])
    names = {k: f"_h_{k}" for k in keys}

    def placed(df: DataFrame, ident: str, own: str, other: str) -> DataFrame:
        df = df.join(F.broadcast(hot), _same(df, hot, keys, names), "left").drop(*names.values())
        n = {c: F.coalesce(c, F.lit(1)) for c in (own, other)}
        mine, along = ("_i", "_j") if own == "_rows" else ("_j", "_i")
        df = df.withColumn(mine, F.pmod(F.xxhash64(ident), n[own]).cast("int"))
        return df.withColumn(along, F.explode(F.sequence(F.lit(0), n[other] - 1))).drop("_rows", "_cols")

    out = placed(left, left_id, "_rows", "_cols").join(placed(right, right_id, "_cols", "_rows"), [*keys, "_i", "_j"])
    return out.drop("_i", "_j")
