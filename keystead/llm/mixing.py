"""Mixing of sources to target weights: iterative proportional fitting, then calibrated sampling.

Token sums of the cells (source, language, topic) are raked until each marginal has its target shares. A document's
probability is that of its cell, scaled so that the expected tokens are the asked share of all tokens with
no probability above 1. The draw is a hash of seed, id and text, so it repeats exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import bytewise as bw
from .tables import stored

#: Values with a target of their own per marginal; the rest of a marginal is one further category.
MAX_VALUES = 256
OTHER = "(other)"
TOPICS = 8


@arrow_udf(StructType([StructField("tokens", LongType()), StructField("topic", IntegerType())]))
def measured(texts: pa.Array) -> pa.Array:
    """Words of a text, and its topic: the lexical class (word hash modulo TOPICS) of most of its words of 6 bytes or more."""
    data, at = bw.flat(texts)
    tokens, topic = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int32)
    for i, j in bw.pieces(at):
        doc, h, begin, end = bw.words(data[at[i] : at[j]], at[i : j + 1] - at[i])
        tokens[i:j] = np.bincount(doc, minlength=j - i)
        long = end - begin >= 6
        cell = doc[long] * TOPICS + (h[long] % np.uint64(TOPICS)).astype(np.int64)
        topic[i:j] = np.bincount(cell, minlength=(j - i) * TOPICS).reshape(-1, TOPICS).argmax(axis=1)
    bw.release()
    return pa.StructArray.from_arrays([pa.array(tokens), pa.array(topic)], names=["tokens", "topic"])


def tempered_targets(mass: DataFrame, col: str, power: float) -> dict[str, float]:
    """Target shares in proportion to tokens ** power over the MAX_VALUES largest values of a marginal."""
    rows = mass.groupBy(col).agg(F.sum("tokens").alias("t")).filter("t > 0").orderBy(F.desc("t"), col).limit(MAX_VALUES).collect()
    total = sum(r.t**power for r in rows)
    return {r[0]: r.t**power / total for r in rows}


def pooled(col: str, targets: dict[str, float]):
    return F.when(F.col(col).isin(list(targets)), F.col(col)).otherwise(F.lit(OTHER))


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], steps: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Cell masses whose marginal shares are the targets (as near as the empty cells allow); categories without mass
    give their share to the others, a category without a target keeps its mass share."""
    m, total = cells.astype(float), cells.sum()
    if not total:
        return m
    goals = []
    for code, goal in zip(codes, targets, strict=True):
        now = np.bincount(code, weights=m, minlength=len(goal)) / total
        fixed = np.isnan(goal)
        goal = np.where(fixed, now, np.where(now > 0, goal, 0))
        free = goal[~fixed].sum()
        goals.append(np.where(fixed, goal, goal * (1 - goal[fixed].sum()) / free if free else goal))
    for _ in range(steps):
        worst = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, weights=m, minlength=len(goal)) / total
            worst = max(worst, np.abs(now - goal).max())
            m *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if worst < tol:
            break
    return m


def probabilities(mass: np.ndarray, raked: np.ndarray, share: float) -> np.ndarray:
    """min(1, c * raked / mass) with c such that the expected tokens are ``share`` of all."""
    ratio = np.divide(raked, mass, out=np.zeros_like(raked), where=mass > 0)
    want, low, high = share * mass.sum(), 0.0, 1.0
    while high < 1e12 and (np.minimum(1, high * ratio) * mass).sum() < want:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * mass).sum() < want else (low, mid)
    return np.minimum(1, high * ratio)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marginals: tuple[str, ...] = ("source", "lang"), power: float = 0.5,
        share: float = 0.8, seed: int = 7, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``docs`` with a struct column ``mix`` (tokens, topic, weight, probability, kept).

    Marginals are the given columns and the topic. Targets default to shares in proportion to tokens ** power. Null values of a
    marginal are the category ''. Texts without words have no tokens: they get the probability of their cell, or 1
    if the whole cell has no tokens. Repeated rows are drawn alike. ``docs`` must not hold a column ``mix``.
    """
    spark = docs.sparkSession
    keys = [*marginals, "topic"]
    # (cell columns, tokens) of every document, under names of their own
    def keyed(extra):
        m = docs.select(*extra, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{c}") for c in marginals), measured(F.col(text_col)).alias("mix_m"))
        return m.withColumn("mix_topic", F.col("mix_m.topic").cast("string"))

    mass = keyed([]).groupBy(*(f"mix_{k}" for k in keys)).agg(F.sum("mix_m.tokens").alias("tokens"))
    mass = mass.select(*(F.col(f"mix_{k}").alias(k) for k in keys), "tokens")
    mass = stored(mass, "mix-cells")
    goals = {k: (targets or {}).get(k) or tempered_targets(mass, k, power) for k in keys}
    cells = mass.groupBy(*(pooled(k, goals[k]).alias(k) for k in keys)).agg(F.sum("tokens").alias("tokens"))
    cells = cells.orderBy(*keys).toPandas()  # at most (MAX_VALUES + 1) values of each marginal
    values = {k: [*goals[k], OTHER] for k in keys}
    codes = [cells[k].map({v: i for i, v in enumerate(values[k])}).to_numpy(np.int64) for k in keys]
    goal = [np.array([*goals[k].values(), np.nan]) for k in keys]
    tokens = cells["tokens"].to_numpy(np.float64)
    raked = rake(tokens, codes, goal)
    cells["weight"] = np.divide(raked, tokens, out=np.ones_like(raked), where=tokens > 0)
    cells["probability"] = np.where(tokens > 0, probabilities(tokens, raked, share), 1.0)
    fields = ", ".join(f"cell_{k} string" for k in keys)
    table = spark.createDataFrame(
        [(*(r[k] for k in keys), float(r["weight"]), float(r["probability"])) for r in cells.to_dict("records")],
        f"{fields}, cell_weight double, cell_probability double")
    out = keyed([F.struct(*docs.columns).alias("mix_row"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix_hash")])
    for k in keys:
        out = out.withColumn(f"mix_{k}", pooled(f"mix_{k}", goals[k]))
    out = out.join(F.broadcast(table), [F.col(f"mix_{k}") == F.col(f"cell_{k}") for k in keys], "left")
    draw = F.shiftrightunsigned("mix_hash", 11) / F.lit(float(1 << 53))
    info = F.struct(F.col("mix_m.tokens").alias("tokens"), F.col("mix_m.topic").alias("topic"), F.col("cell_weight").alias("weight"),
                    F.col("cell_probability").alias("probability"), (draw < F.col("cell_probability")).alias("kept"))
    return out.select(*(F.col("mix_row").getField(c).alias(c) for c in docs.columns), info.alias("mix"))
