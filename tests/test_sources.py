"""Pages, feeds, tables and sinks on hand-written input."""

import re

import pytest
from pyspark.sql import functions as F, types as T

from keystead.operators import register as G
from keystead.session import work_dir
from keystead.sources import derived as D, geocode as GC, pages as P, permits as PM, registry as R, tables as TB


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_card_page_dirt(spark):
    html = f"""<!-- <div data-testid="listing-card">hidden</div> --><script>var x = '<div data-testid="listing-card">';</script>
    <div class='a' data-testid='listing-card'><a href='https://x/1' class='b {P.SE_ADDRESS}'>1 Main&nbsp;St <b> #2 </b></a>
    <span class="{P.SE_PRICE} big">$2,100+</span></div><DIV data-testid="listing-card"><p>nothing</p></DIV>"""
    rows = P.streeteasy_cards(page(spark, html)).orderBy("pos").collect()
    assert [(r.source_url, r.address, r.price, r.bedrooms) for r in rows] == [
        ("https://x/1", "1 Main St#2", 2100, None), ("https://streeteasy.com#", "", None, None),
    ]
    assert rows[0].images == [] and rows[1].raw_data["title"] == ""


def test_embedded_json_choices(spark):
    def one(body):
        html = f'<script id="__NEXT_DATA__" type="application/json">{body}</script>'
        return P.rentcom_items(page(spark, html)).collect()

    assert one("{broken") == [] and one('{"props": {}}') == [] and P.rentcom_items(page(spark, "<p/>")).count() == 0
    body = """{"props": {"pageProps": {"listings": [], "searchResults": {"listings": [
      {"address": "1 A", "city": "", "state": "NY", "rent": null, "price": 9, "beds": "Studio", "baths": {"min": "1.5"},
       "url": null, "detailUrl": "/d", "photos": ["a", {"url": "b"}, "c", "d", "e", "f"]}, "junk"]}}}}"""
    (r,) = one(body)
    # a key that is there wins, even as null
    assert (r.address, r.price, r.bedrooms, r.bathrooms, r.source_url) == ("1 A, NY", None, 0, 1.5, "")
    assert r.images == ["a", "b", "c", "d", "e"]


def test_json_ld_blocks(spark):
    html = """<script type="application/ld+json">{bad</script><script type='application/ld+json'>
    [{"@type": "House", "address": "9 Elm", "offers": [{"price": "1,900"}], "floorSize": 700, "image": "i"},
     {"@type": "Organization", "address": "x"}, {"@type": "House", "address": {}}]</script>"""
    (r,) = P.zumper_items(page(spark, html)).collect()
    assert (r.address, r.price, r.sqft, r.images) == ("9 Elm", 1900, 700, ["i"])


def test_registry_and_hook(spark):
    with pytest.raises(ValueError):
        R.extract(page(spark, ""), "nowhere")

    def parse(html):
        if html == "bad":
            raise RuntimeError
        yield lambda: {"v": html}
        yield lambda: {"v": 1 / 0}

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "page_id long, html string")
    got = R.parse_pages(df, parse, T.StructType([T.StructField("v", T.StringType())])).collect()
    assert sorted((r.page_id, r.pos, r.v, r.error) for r in got if r.v) == [(1, 0, "ok", None)]
    assert sorted((r.page_id, r.pos, r.error) for r in got if not r.v) == [(1, 1, "ZeroDivisionError"), (2, -1, "RuntimeError")]


def test_web_pages_hold_no_cards(spark, sf):
    web = D.table(spark, sf, "pages")
    assert all(R.extract(web, s).count() == 0 for s in R.source_names())


def test_register_chunks(spark):
    with pytest.raises(ValueError):
        G.union_register_chunks([spark.range(1)])
    cols = {c: "x" for c in G.REGISTER_COLUMNS}

    def row(**kw):
        return {**cols, "COUNTY": "62", "BLOCK": "5", "LOT": "6", **kw}

    rows = [row(ZIP="10001"), row(ZIP=" 10001", LOT="7"), row(ZIP="ZIP"), row(ZIP="10002"), row(ZIP="10003", BLOCK="n/a"),
            row(ZIP="10004", LOT=" 8 ", BLDGNO1="  ", CITY="", COUNTY="z")]
    df = spark.createDataFrame([tuple(r[c] for c in G.REGISTER_COLUMNS) for r in rows], list(G.REGISTER_COLUMNS))
    clean = G.clean_register(G.union_register_chunks([df]))
    assert sorted((r.ZIP, r.BBL) for r in clean.collect()) == [("10001", "1000050006"), ("10004", "1000050008")]
    stored = {r.zip_code: r for r in G.stored_register(clean).collect()}["10004"]
    assert (stored.building_number, stored.city, stored.county_code) == ("", "NEW YORK", 62)
    n, sample = G.reload_register(clean, "/nowhere", dry_run=True)
    assert n == 2 and sample.count() == 2


def test_append_new_permits(spark):
    path = work_dir(spark, "permits")
    cols = "permit_number string, borough string, lat double, lng double, filing_date int"
    spark.createDataFrame([("A", "Bronx", 1.0, 1.0, 1)], cols).write.parquet(path)
    batch = spark.createDataFrame([("A", "x", 1.0, 1.0, 2), ("B", "x", 0.0, 5.0, 3), ("B", "y", 2.0, 2.0, 9)], cols)
    report = PM.append_new_permits(path, batch, [F.col("filing_date")]).first()
    assert tuple(report) == (1, 2)
    b = spark.read.parquet(path).filter("permit_number = 'B'").first()
    assert (b.borough, b.lat, b.lng) == ("x", None, None)


def test_tables_round_trip(spark, sf):
    base = work_dir(spark, "tables")
    listings = D.view(spark, sf, "listings")
    TB.replace_table(listings, base, "listings", ("borough",))
    back = TB.read_table(spark, base, "listings")
    assert back.schema == TB.schema_of("listings") and back.count() == listings.count()
    ev = listings.selectExpr("id AS listing_id", "'removed' AS event_type")
    TB.append_table(ev, base, "listing_events")
    TB.append_table(ev, base, "listing_events")
    assert TB.read_table(spark, base, "listing_events").count() == 2 * listings.count()


def test_geocode_later_component_wins(spark):
    body = """{"status": "OK", "results": [{"geometry": {"location": {"lat": 40.7, "lng": -74.0}}, "address_components": [
      {"long_name": "old", "types": ["neighborhood"]}, {"long_name": "new", "types": ["neighborhood", "x"]}]}]}"""
    rows = spark.createDataFrame([("k", body), ("n", '{"status": "OK", "results": []}')], "key string, json string")
    got = {r.key: r for r in GC.flatten_geocode(rows).collect()}
    assert (got["k"].neighborhood, got["k"].zip_code, got["k"].valid_nyc) == ("new", "", True)
    assert got["n"].lat is None and got["n"].neighborhood is None


def test_cards_end_at_their_own_end_tag(spark):
    """Nested elements of one name, tags with > in quotes, unclosed cards, look-alikes after the last card."""
    from keystead.sources import pages as P

    li = '<li class="cl-static-search-result">'
    page = (
        f'<ol>{li}<div class="title"><div>A<div></div></div> 1</div><ul><li>x</li></ul><div class="price">$10</div></li>'
        f'<li>plain<div class="price">$99</div></li>'
        f'{li}<a title="a > b" href="/q?x=1&amp;y=2"><div class="title">B &lt;i&gt; &#233;&#xE9;&eacute; &amp;amp; &bogus; &#0; &#128;</div></a></li>'
        f'{li}<div class="title">C</div><div class="price">$<div>3</div>0</div>'
        f'{li}<div class="title">D</div></li></ol><div class="footer"><div class="price">$7</div><div class="details">no</div></div>'
    )
    df = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<li>no card</li>")], "page_id long, html string")
    got = [(r.pos, r.address, r.price, r.description, r.source_url) for r in P.craigslist_cards(df).orderBy("pos").collect()]
    assert got == [
        (0, "A1", 10, "", ""), (1, "B <i> ééé &amp; &bogus; � €", None, "", "https://newyork.craigslist.org/q?x=1&y=2"),
        (2, "C", 30, "", ""), (3, "D", None, "", ""),
    ]
    far = '<script type="application/ld+json">[' + ", ".join('{"@type": "Apartment", "address": "%d"}' % i for i in range(10_050)) + "]</script>"
    pos = [r.pos for r in P.zumper_items(spark.createDataFrame([(1, far + far)], "page_id long, html string")).select("pos").collect()]
    assert sorted(pos) == list(range(20_100))


def test_page_parser_hands_on_cards_as_it_goes(spark, monkeypatch):
    """A task holds some cards, not those of all its pages; and every card comes once, in order."""
    from pyspark.sql import types as T

    from keystead.sources import registry as R

    monkeypatch.setattr(R, "ROWS", 7)
    sizes = []
    real = R.pd.DataFrame
    monkeypatch.setattr(R.pd, "DataFrame", lambda rows, **kw: sizes.append(len(rows)) or real(rows, **kw))

    class Pages:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            pages = real({"page_id": range(10), "html": ["x" * (i % 4) for i in range(10)]})
            return [r for part in run(iter([pages])) for r in part[["page_id", "pos"]].itertuples(index=False, name=None)]

    got = R.parse_pages(Pages(), lambda html: [lambda: {"c": "x"} for _ in html], T.StructType([T.StructField("c", T.StringType())]))
    assert got == [(p, k) for p in range(10) for k in range(p % 4)]
    assert max(sizes) <= 7


def test_cards_are_searched_once_per_value(spark):
    """The work of a card: one search for an attribute, one for an element that is not there."""
    card = F.col("card")
    assert str(P._value(card, "href", "a")).count("card") == 1
    df = spark.createDataFrame([("<p>x</p>" * 3,)], "card string")
    looked_at = df.select(P._inner(card, "button").alias("v"))
    plan = looked_at._jdf.queryExecution().optimizedPlan().toString()
    assert looked_at.first().v == "" and plan.count("regexp_extract(card") <= 2  # the second only for a nested element


def test_pages_are_made_after_the_shuffle(spark, sf):
    """Listings are shuffled, not the markup of their cards."""
    from keystead.sources import rendered as RD

    plan = RD.render_pages(D.view(spark, sf, "listings"), "streeteasy")._jdf.queryExecution().executedPlan().toString()
    shuffles = [i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line]
    cards = [i for i, line in enumerate(plan.splitlines()) if "listing-card" in line]
    assert len(shuffles) == 1 and cards and max(cards) < shuffles[0]


def test_balanced_elements_equal_the_count_of_tags(spark):
    """Elements nested to any depth, unclosed, closed too often, with > in quotes, look-alike names."""
    import random

    rnd = random.Random(7)
    bits = ["<div>", "<DIV class='a > b'>", "</div>", "</div >", "</Div>", "<div/>", "<div x='/'/>", "<divider>", "<div-x>", "</p>", "<br>",
            " a < b ", "é", "\n", "<", "'", "<p title=\"</div>\">", "<div", "text"]
    rows = ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(3000)]
    rows += ["<div>" * d + "x" + "</div>" * e + "y</div>z" for d in range(14) for e in range(16)] + ["<br>t" * 200_000 + "</div>x"]

    def content(s):
        """Depth over the tags of the name, one by one."""
        depth = 1
        for m in re.finditer(r"""</?div\b[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""", s, re.I):
            depth += -1 if m[0].startswith("</") else 0 if m[0].endswith("/>") else 1
            if not depth:
                return s[:m.start()]
        return s

    df = spark.createDataFrame([(r,) for r in rows], "card string")
    got = df.select("card", P._balanced(F.col("card"), "div").alias("b"), P._counted(F.col("card"), F.lit("div")).alias("c")).collect()
    assert all(r.b == r.c == content(r.card) for r in got)


def test_references_are_decoded_once_each(spark):
    text = "a &amp;lt; && &amp &#65;&#x42; &#128; &#1114112; &nosuch; &; &eacute;b &#xD800;&lt"
    want = "a &lt; && & AB € � &nosuch; &; éb �<"
    assert spark.createDataFrame([(text,), ("",), (None,)], "v string").select(P._unescape(F.col("v")).alias("v")).collect() == [(want,), ("",), (None,)]
