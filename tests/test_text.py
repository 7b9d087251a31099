"""Text, number, code and date rules on small tables of input and output."""

import pytest
from pyspark.sql import functions as F

from keystead.functions import geo, numbers as N, permit_fields as PF, text as X


def column(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


ADDRESSES = {
    "77 park AVENUE apt 12C": "77 Park Ave",
    "9  Ocean   Parkway": "9 Ocean Pkwy",
    "31 WEST 4TH STREET, Suite 200": "31 West 4th St",
    "8 o'neil pl.": "8 O'Neil Pl",
    "12 Steinway": "12",
    "5 Court Sq #2B": "5 Ct Sq #2B",
    "22ND St & 1St ave": "22nd St & 1st Ave",
    "": "",
}


def test_clean_address(spark):
    got = column(spark, list(ADDRESSES), X.clean_address)
    assert got == list(ADDRESSES.values())
    assert column(spark, [None], X.clean_address) == [""]


@pytest.mark.parametrize(
    "fn,cases",
    [
        (X.parse_price_cents, {"$2,500": 250000, "from 1999.99 a month": 199999, "19.99": 1998, "call": None, ",": None, "": None}),
        (X.parse_price_dollars, {"$3,200/mo": 3200, "n/a": None, "": None, ",": None}),
        (X.parse_bedrooms, {"Studio apt": 0.0, "3 Beds": 3.0, "2br": 2.0, "1.5": 1.5, "loft": None, "nan": None, "": None}),
        (X.parse_bathrooms, {"1.5 baths": 1.5, "2 BA": 2.0, "3": 3.0, "x": None, "1.2.3 ba": None}),
        (X.parse_sqft, {"1,050 sq. ft.": 1050, "800SF": 800, " 640 ": 640, "big": None, "": None}),
        (X.parse_int, {"2 bed": 2, "STUDIO": 0, "1,100 ft": 1100, " ": None}),
        (X.parse_float, {"1.5 ba": 1.5, "none": None}),
        (N.safe_int, {"12.9": 12, "-3.7": -3, "1e3": 1000, "x": None, "1d": None}),
    ],
)
def test_number_texts(spark, fn, cases):
    assert column(spark, list(cases), fn) == list(cases.values())


def test_round_like_python(spark):
    xs = [2.675, 0.125, 0.35, 42.15, 26.25, 8.75, 1.005, -2.5, -0.25, 99.95, 0.05, 1234567.25]
    for digits in (0, 1, 2, 3):
        got = column(spark, xs, lambda c: N.py_round(c, digits), "double")
        assert got == [float(round(x, digits)) for x in xs]


def test_codes_dates_padding(spark):
    assert column(spark, ["kings", "New York", "Erie"], PF.borough_from_county) == ["Brooklyn", "Manhattan", "Erie"]
    assert column(spark, [" 3", "bronx", "9"], PF.borough_from_code) == ["Brooklyn", "Bronx", "9"]
    assert column(spark, ["Queens", "Mars"], PF.borough_code) == ["4", "1"]
    dates = ["2024-03-05T10:20:30.5", "2024-03-05T10:20:30", "2024-3-5", "3/5/2024", "2024-13-01", "5.3.2024", ""]
    got = column(spark, dates, lambda c: PF.parse_date(c).cast("string"))
    assert got == ["2024-03-05 10:20:30.5", "2024-03-05 10:20:30", "2024-03-05 00:00:00", "2024-03-05 00:00:00", None, None, None]
    assert column(spark, [7, 123456], lambda c: PF.bbl(c, c), "int") == ["1000070007", "1123456123456"]


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("zillow", "1 Main St", 2.0), ("zillow", "1 Main St", None)], "s string, a string, b double")
    got = [r[0] for r in df.select(X.canonical_hash(F.col("s"), F.col("a"), F.col("b"))).collect()]
    want = [hashlib.sha256(f"zillow|1 main st|{b}".encode()).hexdigest() for b in ("2.0", "none")]
    assert got == want


def test_distance_and_shapes(spark):
    df = spark.createDataFrame([(40.7128, -74.0060, 40.7306, -73.9352)], "a double, b double, c double, d double")
    miles = df.select(geo.haversine_miles(*[F.col(c) for c in "abcd"])).first()[0]
    assert 3.8 < miles < 4.0
    shapes = ["10001", "10001-1234", "-73.9857", "POINT (1 2)", "multipolygon((", "Main St"]
    assert column(spark, shapes, geo.location_shape) == ["zip", "zip", "coordinate", "wkt_point", "wkt_polygon", None]


def test_clean_address_unicode_blanks(spark):
    from keystead.functions.text import clean_address

    rows = spark.createDataFrame([("12 Main\u00a0Street",), ("12 main street\u00a0apt 4",)], "a string")
    assert [r[0] for r in rows.select(clean_address(F.col("a"))).collect()] == ["12 Main St", "12 Main St"]
