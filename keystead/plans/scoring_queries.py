"""Comparable, score and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import py_round
from ..operators import comps as C, models as ML, register as G, scoring as S
from ..sources import derived as D
from .catalog import amenity_text, over, query, rnd

V = D.view

COMPS = f"""comps AS (SELECT neighborhood, bedrooms, {rnd('median(price)', 2)} AS median, {rnd('quantile_cont(price, 0.25)', 2)} AS p25,
 {rnd('quantile_cont(price, 0.75)', 2)} AS p75, count(*) AS count, {rnd('avg(sqft) FILTER (WHERE sqft > 0)', 1)} AS avg_sqft,
 {rnd('avg(CAST(price AS DOUBLE) / sqft) FILTER (WHERE sqft > 0)', 2)} AS avg_ppsf
FROM listings WHERE status = 'active' AND price > 0 AND neighborhood IS NOT NULL GROUP BY neighborhood, bedrooms)"""


@query("A01_comp_statistics", over("listings", f"WITH {COMPS} SELECT neighborhood, bedrooms, median, p25, p75, count FROM comps"))
def comp_statistics(spark, sf):
    return C.comps(V(spark, sf, "listings")).select("neighborhood", "bedrooms", "median", "p25", "p75", "count")


@query("A02_comp_for_pair", over("listings", f"WITH {COMPS} SELECT * FROM comps WHERE neighborhood = 'NATION_4' AND bedrooms = 2"))
def comp_for_pair(spark, sf):
    return C.comp_for(V(spark, sf, "listings"), "NATION_4", 2)


@query("A03_area_averages", over("listings", f"WITH {COMPS} SELECT neighborhood, bedrooms, avg_sqft, avg_ppsf FROM comps"))
def area_averages(spark, sf):
    return C.comps(V(spark, sf, "listings")).select("neighborhood", "bedrooms", "avg_sqft", "avg_ppsf")


@query(
    "C21_comp_keys",
    over("listings", f"WITH {COMPS} SELECT concat('comps:', neighborhood, ':', CAST(bedrooms AS VARCHAR)) AS key, median FROM comps"),
)
def comp_keys(spark, sf):
    snap = C.snapshot(C.comps(V(spark, sf, "listings")), F.lit(0))
    return snap.select("key", "median")


@query(
    "T06_comp_cache_expiry",
    over(
        "listings",
        f"""WITH {COMPS} SELECT neighborhood, bedrooms, CASE WHEN bedrooms % 2 = 0 THEN median + 1 ELSE median END AS median,
 CASE WHEN bedrooms % 2 = 0 THEN 1000 ELSE 5000 END AS computed_at FROM comps""",
    ),
)
def comp_cache_expiry(spark, sf):
    # even bedroom counts were stored (with a recognisable median) 1,000 s after
    # the epoch, the others an hour and more before now
    listings = V(spark, sf, "listings")
    old = C.snapshot(C.comps(listings), F.when(F.col("bedrooms") % 2 == 0, 1000).otherwise(100))
    old = old.withColumn("median", F.col("median") + 1)
    now = F.lit(5000)
    out = C.refresh(old.withColumn("computed_at", F.col("computed_at").cast("int")), listings, now, 4500)
    return out.select("neighborhood", "bedrooms", "median", "computed_at")


JOINED = f"""{COMPS}, joined AS (SELECT l.*, c.median AS comp_median, c.p25 AS comp_p25, c.avg_ppsf AS comp_avg_ppsf, c.count AS comp_count
 FROM listings l LEFT JOIN comps c ON l.neighborhood = c.neighborhood AND l.bedrooms IS NOT DISTINCT FROM c.bedrooms)"""


@query(
    "J07_listing_comps",
    over(
        "listings",
        f"WITH {JOINED} SELECT id, comp_median, comp_p25, comp_count, CASE WHEN comp_median IS NULL THEN 'no_comps' ELSE 'ok' END AS comp_status FROM joined",
    ),
)
def listing_comps(spark, sf):
    listings = V(spark, sf, "listings")
    return C.with_comps(listings, C.comps(listings)).select("id", "comp_median", "comp_p25", "comp_count", "comp_status")


FEATURES = f"""{JOINED}, features AS (SELECT *, CASE WHEN comp_median > 0 THEN price / comp_median ELSE 1.0 END AS price_vs_comp_median,
 CASE WHEN comp_p25 > 0 THEN price / comp_p25 ELSE 1.0 END AS price_vs_comp_p25,
 CASE WHEN sqft > 0 AND comp_avg_ppsf > 0 THEN CAST(price AS DOUBLE) / sqft / comp_avg_ppsf ELSE 0.0 END AS sqft_ppsf_ratio,
 coalesce(CAST(days_on_market AS DOUBLE), 0.0) AS dom, coalesce(sqft > 0, false) AS has_sqft FROM joined WHERE comp_median IS NOT NULL)"""
_BASE = "CASE WHEN r >= 1.0 THEN greatest(0.0, 30.0 * (1.0 - (r - 1.0) / 0.3)) ELSE least(30.0 + (1.0 - r) * 200, 90.0) END"
_UNDER = rnd(
    f"""greatest(0.0, least({_BASE} + CASE WHEN q > 0 AND q < 0.85 THEN 10.0 WHEN q > 0 AND q < 0.95 THEN 5.0 ELSE 0.0 END
 - CASE WHEN dom > 30 THEN least((dom - 30) * CAST(0.3 AS DOUBLE), 15.0) ELSE 0.0 END + least((source_count - 1) * 3.0, 10.0), 100.0))""",
    1,
)


def _doubles(sql: str) -> str:
    """Plain decimals to DOUBLE so that the arithmetic is binary throughout."""
    import re

    return re.sub(r"(?<![\w.'%])(\d+\.\d+)(?![\w.'])", r"CAST(\1 AS DOUBLE)", sql)


UNDERVALUE = f"""{FEATURES}, scored AS (SELECT id, {_doubles(_UNDER).replace("CAST(CAST(0.3 AS DOUBLE) AS DOUBLE)", "CAST(0.3 AS DOUBLE)")} AS undervalue_score
 FROM (SELECT *, price_vs_comp_median AS r, sqft_ppsf_ratio AS q FROM features))"""


@query(
    "M01_undervalue_features",
    over(
        "listings",
        f"WITH {FEATURES} SELECT id, price_vs_comp_median, price_vs_comp_p25, sqft_ppsf_ratio, dom, source_count, bedrooms, has_sqft FROM features",
    ),
)
def undervalue_features(spark, sf):
    listings = V(spark, sf, "listings")
    return S.undervalue_features(C.with_comps(listings, C.comps(listings))).select("id", *S.UNDERVALUE_FEATURES)


@query("M02_undervalue_heuristic", over("listings", f"WITH {UNDERVALUE} SELECT id, undervalue_score FROM scored"))
def undervalue_heuristic(spark, sf):
    listings = V(spark, sf, "listings")
    feats = S.undervalue_features(C.with_comps(listings, C.comps(listings)))
    return S.score_undervalue(feats).select("id", "undervalue_score")


@query(
    "top_undervalued",
    over(
        "listings",
        f"""WITH {UNDERVALUE} SELECT l.id, l.address, l.borough, l.price, s.undervalue_score FROM listings l JOIN scored s USING (id)
WHERE l.status = 'active' ORDER BY s.undervalue_score DESC NULLS FIRST, l.id LIMIT 20""",
    ),
)
def top_undervalued(spark, sf):
    """Flagship: comps, features, heuristic score and the best 20 active listings."""
    from ..operators import search as R

    listings = V(spark, sf, "listings")
    active = R.search_listings(listings, R.Filters())
    scored = S.score_undervalue(S.undervalue_features(C.with_comps(active, C.comps(listings))))
    return R.page(R.sort_listings(scored, "undervalue_score"), 1, 20).select(
        "id", "address", "borough", "price", "undervalue_score"
    )


MATCH = """hits AS (SELECT a.addr FROM (SELECT DISTINCT upper(address) AS addr FROM listings) a
 WHERE EXISTS (SELECT 1 FROM register r WHERE trim(r.building_number) <> '' AND trim(r.street_name) <> ''
  AND contains(a.addr, upper(r.building_number) || ' ' || upper(r.street_name)))),
matched AS (SELECT l.*, h.addr IS NOT NULL AS hcr_match FROM listings l LEFT JOIN hits h ON upper(l.address) = h.addr)"""


@query("J06_register_match", over("listings register", f"WITH {MATCH} SELECT id, hcr_match FROM matched"))
def register_match(spark, sf):
    return G.register_match(V(spark, sf, "listings"), V(spark, sf, "register")).select("id", "hcr_match")


@query(
    "J06_register_whole_words",
    over(
        "listings register",
        """WITH hits AS (SELECT DISTINCT l.address FROM listings l JOIN register r
 ON contains(concat(' ', upper(l.address), ' '), concat(' ', upper(r.building_number), ' ', upper(r.street_name), ' ')))
SELECT id, address IN (SELECT address FROM hits) AS hcr_match FROM listings""",
    ),
)
def register_whole_words(spark, sf):
    return G.register_match(V(spark, sf, "listings"), V(spark, sf, "register"), whole_token=True).select("id", "hcr_match")


_RS_INPUT = """CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(1850 + id % 170 AS INT) END AS building_year,
 CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 40 AS INT) END AS unit_count, id % 5 = 0 AS has_tax_abatement,
 (id % 81) / CAST(100.0 AS DOUBLE) AS zip_rs_density"""
RS_FEATURES = f"""{MATCH}, rs AS (SELECT id, hcr_match, CASE WHEN building_year > 1800 THEN 2024 - building_year ELSE 0 END AS building_age,
 coalesce(unit_count, 0) AS unit_count, has_tax_abatement, coalesce(upper(borough) IN ('MANHATTAN', 'NEW YORK'), false) AS borough_manhattan, zip_rs_density
 FROM (SELECT *, {_RS_INPUT} FROM matched))"""


def _rs_rows(spark, sf):
    extra = [e.strip() for e in (
        "CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(1850 + id % 170 AS INT) END AS building_year",
        "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 40 AS INT) END AS unit_count",
        "id % 5 = 0 AS has_tax_abatement", "(id % 81) / CAST(100.0 AS DOUBLE) AS zip_rs_density",
    )]
    rows = G.register_match(V(spark, sf, "listings"), V(spark, sf, "register")).selectExpr("*", *extra)
    return S.rs_features(rows)


@query("M04_rs_features", over("listings register", f"WITH {RS_FEATURES} SELECT * FROM rs"))
def rs_features(spark, sf):
    return _rs_rows(spark, sf).select("id", *S.RS_FEATURES)


_RS_P = _doubles(
    """CASE WHEN hcr_match THEN 0.95 ELSE """
    + rnd(
        """least((((((CASE WHEN old THEN 0.30 ELSE 0.0 END) + CASE WHEN old AND many THEN 0.25 ELSE 0.0 END) + CASE WHEN many THEN 0.10 ELSE 0.0 END)
 + CASE WHEN has_tax_abatement THEN 0.20 ELSE 0.0 END) + CASE WHEN borough_manhattan THEN 0.05 ELSE 0.0 END) + zip_rs_density * 0.10, 0.95)""",
        3,
    )
    + " END"
)


@query(
    "M05_rs_heuristic",
    over(
        "listings register",
        f"WITH {RS_FEATURES} SELECT id, {_RS_P} AS rs_probability FROM (SELECT *, building_age > 0 AND 2024 - building_age < 1974 AS old, unit_count >= 6 AS many FROM rs)",
    ),
)
def rs_heuristic(spark, sf):
    return _rs_rows(spark, sf).select("id", S.rs_probability().alias("rs_probability"))


def _ramp(n: str, good: int, top: int) -> str:
    return (
        f"CASE WHEN {n} <= 0 THEN 0.0 WHEN {n} >= {top} THEN 100.0 WHEN {n} >= {good} THEN 70.0 + 30.0 * ({n} - {good}) / {top - good}.0 "
        f"ELSE 70.0 * {n} / {good}.0 END"
    )


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_HITS = " + ".join(f"CAST(contains(lower(t), '{w}') AS INT)" for w in S.FEATURE_WORDS)
DESC_SCORE = f"""CASE WHEN coalesce(length(t), 0) = 0 THEN 0.0 ELSE least(CASE WHEN length(t) >= 800 THEN 60.0 WHEN length(t) >= 300 THEN 40.0 + 20.0 * (length(t) - 300) / 500.0
 WHEN length(t) >= 50 THEN 40.0 * (length(t) - 50) / 250.0 ELSE 0.0 END + CASE WHEN t <> upper(t) THEN 10.0 ELSE 0.0 END
 + CASE WHEN regexp_matches(t, '[.!]') THEN 10.0 ELSE 0.0 END + least(({_HITS}) * 5.0, 20.0), 100.0) END"""
_SQFT = "CASE WHEN sqft BETWEEN 100 AND 10000 THEN 100.0 WHEN sqft > 0 THEN 80.0 ELSE 0.0 END"
_SRC = "CASE WHEN n_src <= 0 THEN 0.0 WHEN n_src = 1 THEN 40.0 WHEN n_src = 2 THEN 70.0 WHEN n_src = 3 THEN 90.0 ELSE 100.0 END"
QUALITY = _doubles(
    f"""parts AS (SELECT id, {_ramp('photos', 5, 12)} AS p, {_SQFT} AS q, {DESC_SCORE} AS d, {_ramp('bit_count(amenity_bits)', 8, 15)} AS a, {_SRC} AS s
 FROM (SELECT l.*, {_TRIM} AS t, coalesce(nullif(source_count, 0), 1) AS n_src, PHOTOS AS photos FROM listings l LEFT JOIN documents ON l.doc_id = documents.doc_id)),
 quality AS (SELECT id, {rnd('p', 1)} AS photos_score, {rnd('q', 1)} AS sqft_score, {rnd('d', 1)} AS description_score, {rnd('a', 1)} AS amenities_score,
 {rnd('s', 1)} AS sources_score, {rnd('0.25 * p + 0.15 * q + 0.25 * d + 0.20 * a + 0.15 * s', 1)} AS quality_score FROM parts)"""
)


def _described(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    return V(spark, sf, "listings").join(docs, "doc_id", "left")


@query(
    "M07_quality_score",
    over("listings", f"WITH {QUALITY.replace('PHOTOS', 'CAST(id % 15 AS INT)')} SELECT * FROM quality"),
)
def quality_score(spark, sf):
    df = _described(spark, sf).withColumn("photo_count", (F.col("id") % 15).cast("int"))
    return S.quality_scores(df).select(
        "id", "photos_score", "sqft_score", "description_score", "amenities_score", "sources_score", "quality_score"
    )


@query(
    "M08_count_ramps",
    _doubles(
        f"""SELECT conv_id, n, {_ramp('n', 5, 12)} AS photo_score, {_ramp('n', 8, 15)} AS amenity_score
FROM (SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY conv_id)"""
    ),
)
def count_ramps(spark, sf):
    n = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select(
        "conv_id", "n", S.photo_score(F.col("n")).alias("photo_score"), S.amenity_score(F.col("n")).alias("amenity_score")
    )


@query(
    "M09_area_and_source_steps",
    over("listings", _doubles(f"SELECT id, {_SQFT} AS sqft_score, {_SRC} AS source_score FROM (SELECT *, source_count AS n_src FROM listings)")),
)
def area_and_source_steps(spark, sf):
    return V(spark, sf, "listings").select(
        "id", S.sqft_score(F.col("sqft")).alias("sqft_score"), S.source_score(F.col("source_count")).alias("source_score")
    )


@query(
    "M10_description_score",
    _doubles(f"SELECT doc_id, {rnd(DESC_SCORE, 6)} AS description_score FROM (SELECT doc_id, {_TRIM} AS t FROM documents)"),
)
def description_score(spark, sf):
    from ..functions.numbers import py_round

    return D.table(spark, sf, "documents").select(
        "doc_id", py_round(S.description_score(F.col("text")), 6).alias("description_score")
    )


SCORES = f"""{UNDERVALUE.replace('FROM listings WHERE', 'FROM listings WHERE')}, {MATCH},
{QUALITY.replace('PHOTOS', '0')},
all_scores AS (SELECT m.id, u.undervalue_score, CASE WHEN m.hcr_match THEN CAST(0.95 AS DOUBLE) WHEN upper(m.borough) = 'MANHATTAN' THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS rs_probability,
 q.quality_score FROM matched m LEFT JOIN scored u ON u.id = m.id JOIN quality q ON q.id = m.id WHERE m.status = 'active')"""


@query("M12_score_all", over("listings register", f"WITH {SCORES} SELECT * FROM all_scores"))
def score_all(spark, sf):
    return S.score_all(_described(spark, sf), V(spark, sf, "register"))


@query(
    "S17_score_write_back",
    over(
        "listings register",
        f"""WITH {SCORES} SELECT l.id, coalesce(n.undervalue_score, l.undervalue_score) AS undervalue_score,
 coalesce(n.rs_probability, l.rs_probability) AS rs_probability, coalesce(n.quality_score, l.quality_score) AS quality_score
FROM listings l LEFT JOIN all_scores n ON l.id = n.id""",
    ),
)
def score_write_back(spark, sf):
    scores = S.score_all(_described(spark, sf), V(spark, sf, "register"))
    return S.apply_scores(V(spark, sf, "listings"), scores).select(
        "id", "undervalue_score", "rs_probability", "quality_score"
    )


# --- models: draws follow from digests that both engines have; trees differ between libraries, so their results are
# checked by what must hold of them ---


def _draw(n: int, seed: int = 42) -> str:
    return f"(CAST(concat('0x', substr(md5(concat(CAST(id AS VARCHAR), '-{seed}-{n}')), 1, 7)) AS BIGINT) / CAST(268435456 AS DOUBLE))"


def _pick(n: int, lo, hi) -> str:
    return f"({lo} + {_draw(n)} * ({hi} - {lo}))"


_UNDER_SQL = f"""under AS (SELECT id, ratio, ppsf, dom, src, least(greatest(greatest(0, (1 - ratio) * 150) + CASE WHEN ppsf > 0 THEN greatest(0, (1 - ppsf) * 20) ELSE 0 END
  - CASE WHEN dom > 30 THEN (dom - 30) * 0.3 ELSE 0 END + (src - 1) * 3 + 5 * sqrt(-2 * ln(greatest({_draw(8)}, 1e-12))) * cos(2 * pi() * {_draw(9)}), 0), 100) AS label
 FROM (SELECT id, {_pick(1, 0.5, 1.5)} AS ratio, CASE WHEN {_draw(3)} < 0.3 THEN 0 ELSE {_pick(4, 0.5, 1.5)} END AS ppsf, floor({_pick(5, 0, 90)}) AS dom, floor({_pick(6, 1, 5)}) AS src FROM listings))"""
_RS_SQL = f"""rs AS (SELECT id, hcr, old, many, CASE WHEN {_draw(108)} < CASE WHEN hcr THEN 0.95 ELSE least(
   CASE WHEN manh THEN least(t + 0.05, 0.95) ELSE t END + dens * 0.1, 0.95) END THEN 1 ELSE 0 END AS label
 FROM (SELECT *, CASE WHEN tax THEN least(base + 0.25, 0.95) ELSE base END AS t FROM (SELECT *, CASE WHEN old AND many THEN 0.70 WHEN old THEN 0.30 WHEN many THEN 0.15 ELSE 0 END AS base
  FROM (SELECT id, {_draw(101)} >= 0.7 AS hcr, 2024 - floor({_pick(102, 0, 120)}) < 1974 AS old, CASE WHEN {_draw(103)} < 0.2 THEN 0 ELSE floor({_pick(104, 1, 200)}) END >= 6 AS many,
   {_draw(105)} >= 0.8 AS tax, {_draw(106)} >= 0.6 AS manh, {_pick(107, 0.0, 0.8)} AS dens FROM listings))))"""


@query(
    "M11_synthetic_sets",
    over(
        "listings",
        f"""WITH {_UNDER_SQL}, {_RS_SQL}
SELECT 'undervalue' AS set, CAST(id % 10 AS BIGINT) AS part, count(*) AS n, {rnd('avg(label)', 6)} AS mean_label, {rnd('max(label)', 6)} AS max_label, count(*) FILTER (WHERE ppsf > 0) AS marked FROM under GROUP BY id % 10
UNION ALL SELECT 'rent_stabilized', CAST(id % 10 AS BIGINT), count(*), {rnd('avg(CAST(label AS DOUBLE))', 6)}, {rnd('max(CAST(label AS DOUBLE))', 6)}, count(*) FILTER (WHERE hcr) FROM rs GROUP BY id % 10""",
    ),
)
def synthetic_sets(spark, sf):
    ids = V(spark, sf, "listings").select("id")

    def summed(name: str, rows: DataFrame, mark) -> DataFrame:
        return rows.groupBy((F.col("id") % 10).cast("bigint").alias("part")).agg(
            F.count(F.lit(1)).alias("n"), py_round(F.avg("label"), 6).alias("mean_label"), py_round(F.max("label"), 6).alias("max_label"),
            F.count_if(mark).alias("marked")).select(F.lit(name).alias("set"), "*")

    under = summed("undervalue", ML.synth_undervalue(ids), F.col("sqft_ppsf_ratio") > 0)
    return under.unionByName(summed("rent_stabilized", ML.synth_rs(ids), F.col("hcr_match")))


_PART = f"CASE WHEN {_draw(998)} >= CAST(20000 AS DOUBLE) / (SELECT count(*) FROM listings) THEN 'unused' WHEN {_draw(999)} < 0.2 THEN 'test' ELSE 'train' END"


def _part(spark, sf) -> DataFrame:
    ids = V(spark, sf, "listings").select("id")
    kept = ML.labelled(ids).select(F.col("id").alias("kept_id"))
    part = F.when(F.col("kept_id").isNull(), "unused").when(ML.draw("id", ML.SEED, 999) < 0.2, "test").otherwise("train")
    return ids.join(kept, F.col("id") == F.col("kept_id"), "left").select(F.col("id").alias("part_id"), part.alias("part"))


@query(
    "M03_undervalue_model",
    over(
        "listings",
        f"""SELECT id, {_PART} AS part, true AS in_range, true AS fits, true AS cheaper_is_better FROM listings""",
    ),
)
def undervalue_model(spark, sf):
    """The model's scores of all listings: within 0 to 100 or NULL, fitted (R2 on held-out rows above 0.7), and a listing
    at half its comparables' price does not score lower than at one and a half times."""
    listings = V(spark, sf, "listings")
    model = ML.train_undervalue(ML.synth_undervalue(ML.labelled(listings.select("id"))), trees=60)
    feats = S.undervalue_features(C.with_comps(listings, C.comps(listings)))
    score = lambda ratio: ML.predict_undervalue(feats if ratio is None else feats.withColumns(
        {c: F.lit(ratio) for c in ("price_vs_comp_median", "price_vs_comp_p25")}), model.model).select(F.col("id").alias("s_id"), "undervalue_score")
    cheap, dear = score(0.6).withColumnsRenamed({"s_id": "c_id", "undervalue_score": "cheap"}), score(1.4).withColumnsRenamed({"s_id": "d_id", "undervalue_score": "dear"})
    out = _part(spark, sf).join(score(None), F.col("part_id") == F.col("s_id"), "left").join(cheap, F.col("part_id") == F.col("c_id"), "left").join(dear, F.col("part_id") == F.col("d_id"), "left")
    return out.select(
        F.col("part_id").alias("id"), "part", F.coalesce(F.col("undervalue_score").between(0, 100), F.lit(True)).alias("in_range"),
        F.lit(model.metrics["test_score"] > 0.7).alias("fits"), F.coalesce(F.col("cheap") >= F.col("dear"), F.lit(True)).alias("cheaper_is_better"))


@query(
    "M06_rs_model",
    over("listings", f"SELECT id, {_PART} AS part, true AS in_range, true AS fits, true AS registered_is_likely FROM listings"),
)
def rs_model(spark, sf):
    """The model's probabilities of all listings: within 0 to 1, fitted (accuracy on held-out rows above 0.7), and at
    least one half for any building with a register entry."""
    model = ML.train_rs(ML.synth_rs(ML.labelled(V(spark, sf, "listings").select("id"))), trees=60)
    rows = _rs_rows(spark, sf)
    prob = lambda name, match: ML.predict_rs(rows if match is None else rows.withColumn("hcr_match", F.lit(match)), model.model).select(
        F.col("id").alias(f"{name}_id"), F.col("rs_probability").alias(name))
    out = _part(spark, sf)
    for name, match in (("own", None), ("entered", True)):
        out = out.join(prob(name, match), F.col("part_id") == F.col(f"{name}_id"), "left")
    return out.select(
        F.col("part_id").alias("id"), "part", F.coalesce(F.col("own").between(0, 1), F.lit(True)).alias("in_range"),
        F.lit(model.metrics["test_accuracy"] > 0.7).alias("fits"), F.coalesce(F.col("entered") >= 0.5, F.lit(True)).alias("registered_is_likely"))
