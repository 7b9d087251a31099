"""Score rules against plain Python, trained models against thresholds."""

from pyspark.sql import functions as F

from keystead.operators import comps as C, models as ML, quality_rules as Q, scoring as S
from keystead.sources import derived as D


def test_undervalue_rules(spark):
    rows = [(0.8, 0.8, 10.0, 3), (1.0, 0.0, 0.0, 1), (1.2, 0.9, 45.0, 2), (0.5, 0.5, 400.0, 9), (2.0, 0.0, 90.0, 0), (0.9, 0.0, 0.0, None)]

    def twin(r, q, d, n):
        if n is None:
            return None
        base = max(0, 30 * (1.0 - (r - 1.0) / 0.3)) if r >= 1.0 else min(30 + (1.0 - r) * 200, 90)
        bonus = (10.0 if q < 0.85 else 5.0 if q < 0.95 else 0.0) if q > 0 else 0.0
        late = min((d - 30) * 0.3, 15) if d > 30 else 0.0
        return float(round(max(0, min(base + bonus - late + min((n - 1) * 3, 10), 100)), 1))

    df = spark.createDataFrame(rows, "r double, q double, d double, n int")
    got = [x[0] for x in df.select(S.undervalue_score(*[F.col(c) for c in "rqdn"])).collect()]
    assert got == [twin(*r) for r in rows]


def test_description_score(spark):
    texts = [None, "", "  ", "SHORT", "a" * 60, "Bright. " * 50 + "laundry gym roof pet balcony", "X" * 900, "x. gym" + "y" * 900]

    def twin(t):
        t = (t or "").strip()
        if not t:
            return 0.0
        n = len(t)
        size = 60.0 if n >= 800 else 40 + 20 * (n - 300) / 500 if n >= 300 else 40 * (n - 50) / 250 if n >= 50 else 0.0
        hits = sum(w in t.lower() for w in S.FEATURE_WORDS)
        return min(size + 10 * (t != t.upper()) + 10 * ("." in t or "!" in t) + min(hits * 5.0, 20.0), 100.0)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(S.description_score(F.col("t"))).collect()]
    assert got == [twin(t) for t in texts]


def test_comps_edges(spark):
    rows = [("A", 1, 1000, 500, "active"), ("A", 1, 2000, None, "active"), ("A", 1, 4000, 0, "active"), ("A", 1, 9, 1, "removed"),
            ("A", None, 700, None, "active"), (None, 1, 800, 1, "active"), ("B", 1, 0, 1, "active")]
    df = spark.createDataFrame(rows, "neighborhood string, bedrooms int, price int, sqft int, status string")
    got = {(r.neighborhood, r.bedrooms): r for r in C.comps(df).collect()}
    assert set(got) == {("A", 1), ("A", None)}
    a = got[("A", 1)]
    assert (a.median, a.p25, a.p75, a["count"], a.avg_sqft, a.avg_ppsf) == (2000.0, 1500.0, 3000.0, 3, 500.0, 2.0)
    joined = C.with_comps(df, C.comps(df)).filter("neighborhood IS NULL OR bedrooms IS NULL").collect()
    assert sorted(r.comp_status for r in joined) == ["no_comps", "ok"]


def test_models_learn_and_fall_back(spark):
    ids = spark.range(2500)
    under = ML.train_undervalue(ML.synth_undervalue(ids), trees=20)
    assert under.metrics["test_score"] > 0.7
    rs = ML.train_rs(ML.synth_rs(ids), trees=20)
    assert rs.metrics["test_accuracy"] > 0.7
    assert max(rs.metrics, key=lambda k: rs.metrics[k] if k.startswith("importance") else -1) == "importance_hcr_match"
    feats = ML.synth_undervalue(ids.limit(50))
    scored = ML.predict_undervalue(feats.withColumn("source_count", F.when(F.col("id") > 0, F.col("source_count"))), under.model)
    vals = [r.undervalue_score for r in scored.collect()]
    assert vals.count(None) == 1 and all(0 <= v <= 100 for v in vals if v is not None)
    probs = [r.rs_probability for r in ML.predict_rs(ML.synth_rs(ids.limit(50)), rs.model).collect()]
    assert all(0 <= p <= 1 for p in probs)
    assert ML.predict_rs(ML.synth_rs(ids.limit(5))).filter("rs_probability > 0.95").count() == 0


def test_synthetic_sets_are_repeatable(spark):
    a, b = (sorted(map(str, ML.synth_rs(spark.range(100).repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_validation_rules(spark):
    df = spark.createDataFrame([("a@b.co",), ("a@b",), ("@b.co",), (None,), ("x y@b.co",)], "email string")
    ok, bad = Q.split_valid(df, Q.user_rules())
    assert [r.email for r in ok.collect()] == ["a@b.co"] and bad.count() == 4
    f = spark.createDataFrame([(None, None, "asc", 1, 100), (0.0, 2.0, "up", 0, 101)], "radius_miles double, min_score double, sort_order string, page int, per_page int")
    reasons = [r.reasons for r in Q.with_reasons(f, Q.filter_rules()).collect()]
    assert reasons == [[], ["radius_miles", "min_score", "sort_order", "page", "per_page"]]
