"""Result pages to raw listings, inside the JVM.

Card pages are cut at the cards' start tags; a card, and any element within it,
ends at its own end tag, found by the running depth of tags of its name. Pages
with embedded JSON go through the VARIANT type. A page without cards or with broken
JSON gives no rows, a card without an optional part gives NULL or ''.
"""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import int_trunc, strip
from ..functions.text import absolutize, parse_float, parse_int, parse_price_dollars

# Phrases shown by pages that refuse to serve.
BLOCKED_PHRASES = (
    "Access Denied",
    "Please try again",
    "suspicious activity",
    "Access to this page has been denied",
    "You are being rate limited",
    "Rate Limited",
    "Please Wait",
    "Just a moment",
    "please prove",
    "human verification",
    "checking if the site connection is secure",
    "checking your browser",
    "Too Many Requests",
    "temporarily blocked",
    "unusual traffic",
    "automated access",
)

# Class names, attributes and addresses of the pages.
SE_TITLE = "ListingDescription-module__title___B9n4Z"
SE_ADDRESS = "ListingDescription-module__addressTextAction___xAFZJ"
SE_PRICE = "PriceInfo-module__price___pKybg"
SE_BASE_RENT = "PriceInfo-module__baseRent___jHKuz"
SE_PRICE_TAG = "PriceInfo-module__priceInfoTag___pVv0Z"
SE_FACTS = "BedsBathsSqft-module__list___mj--s"
SE_FACT = "BedsBathsSqft-module__text___lnveO"
SE_LISTED_BY = "ListingBy-module__ListingBy___pBXCl"
SE_IMAGE = "CardImage-module__cardImage___cirIN"
SE_ACTIVE_IMAGE = "isActiveImage"
SITES = {
    "streeteasy": "https://streeteasy.com",
    "zillow": "https://www.zillow.com",
    "craigslist": "https://newyork.craigslist.org",
    "rentcom": "https://www.rent.com",
    "zumper": "https://www.zumper.com",
}
LD_HOME_TYPES = ("Apartment", "Residence", "SingleFamilyResidence", "House")
MAX_IMAGES = 5


def flag_blocked(pages: DataFrame) -> DataFrame:
    """Add ``blocked``: the page shows any of the refusal phrases."""
    return pages.withColumn("blocked", F.col("html").rlike("|".join(re.escape(p) for p in BLOCKED_PHRASES)))


# --- start-tag patterns ---


def _attr(name: str, value: str) -> str:
    v = re.escape(value)
    return rf"(?=[^>]*\s{name}\s*=\s*(?:\"{v}\"|'{v}'|{v}(?=[\s>/])))"


def _attr_has(name: str, part: str) -> str:
    p = re.escape(part)
    return rf"(?=[^>]*\s{name}\s*=\s*(?:\"[^\"]*{p}[^\"]*\"|'[^']*{p}[^']*'))"


def _cls(name: str) -> str:
    n = re.escape(name)
    return (
        rf"(?=[^>]*\sclass\s*=\s*(?:\"(?:[^\"]*\s)?{n}(?:\s[^\"]*)?\"|'(?:[^']*\s)?{n}(?:\s[^']*)?'|{n}(?=[\s>/])))"
    )


def _open(tag: str, *tests: str) -> str:
    return rf"(?is)<{tag}\b{''.join(tests)}{_END}"


_ANY = r"([a-zA-Z][\w-]*)"
_END = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""  # of a tag; > may stand in quotes


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Levels of elements of one name within each other that one pattern reads; deeper ones have their tags counted.
LEVELS = 8


def _within(tag: str) -> str:
    """Pattern of an element's content up to its own end tag, where the elements of its name within are all closed.

    Loops are possessive: each place is read once per level, and no stack grows with the length.
    """
    text = rf"[^<]*+(?:<(?!/?{tag}\b{_END})[^<]*+)*+"
    content = text
    for _ in range(LEVELS):
        content = rf"{text}(?:<{tag}\b{_END}(?:(?<=/>)|{content}</{tag}\b{_END}){text})*+"
    return rf"(?is)^({content})</{tag}\b{_END}"


def _balanced(rest: Column, tag: str) -> Column:
    """What lies before the end tag that closes an element, given all that follows its start tag."""
    pattern = _within(tag)

    def cut(r: Column) -> Column:
        # an empty content looks like no match: the count of tags tells them apart
        return _let(F.regexp_extract(r, pattern, 1), lambda c: F.when(c != "", c).otherwise(_counted(r, F.lit(tag))))

    return _let(rest, cut)


def _counted(rest: Column, tag: Column) -> Column:
    """The same by the running depth over the tags of the element's own name; without an end tag everything belongs to it."""
    same = F.concat(F.lit(r"(?is)</?"), tag, F.lit(rf"\b{_END}"))

    def cut(r: Column) -> Column:
        tags = F.regexp_extract_all(r, same, F.lit(0))
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(s: Column, t: Column) -> Column:
            move = F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
            return F.when(s["depth"] == 0, s).otherwise(F.struct((s["depth"] + move).alias("depth"), (s["n"] + 1).alias("n")))

        def inside(t: Column) -> Column:
            return _let(F.aggregate(t, start, step), lambda s: F.when(s["depth"] != 0, r).otherwise(F.substr(
                r, F.lit(1),
                _chars(F.slice(F.split(r, same, -1), F.lit(1), s["n"])) + _chars(F.slice(t, F.lit(1), s["n"] - 1)))))

        return _let(tags, inside)

    return _let(rest, cut)


def _chars(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, x: n + F.char_length(x))


def _inner(card: Column, tag: str, *tests: str) -> Column:
    """Content of the first element that fits, up to its own end tag; '' when there is none.

    The card is searched once. Mostly the first end tag of the name is the one; others are looked for only where an
    element of the name lies within.
    """
    start = rf"(?is)<{tag}\b{''.join(tests)}{_END}"
    if tag == _ANY:
        name = F.regexp_extract(card, start, 1)
        found = F.regexp_extract(card, rf"{start}(.*?)</\1\s*>", 2)
        whole = lambda: _counted(F.regexp_extract(card, f"{start}(.*)", 2), name)
        return _let(found, lambda p: F.when(_nested(p, F.lower(name)), whole()).otherwise(p))

    end = rf"</{tag}\s*>"

    def content(upto: Column) -> Column:
        plain = F.regexp_extract(upto, rf"(?is)^(.*){end}\z", 1)
        whole = _balanced(F.regexp_extract(card, f"{start}(.*)", 1), tag)
        return F.when(upto == "", upto).otherwise(
            _let(plain, lambda p: F.when(_nested(p, F.lit(tag)), whole).otherwise(p)))

    # with the end tag, so that an empty element differs from none
    return _let(F.regexp_extract(card, f"{start}(.*?{end}|.*)", 1), content)


def _nested(plain: Column, name: Column) -> Column:
    return (plain == "") | (plain.contains("<") & F.lower(plain).contains(F.concat(F.lit("<"), name)))


#: A character reference: decimal, hexadecimal, by name, or one of the names that may stand without their semicolon.
_REFERENCE = r"&(?:#\d{1,9};?|#[xX][0-9a-fA-F]{1,8};?|[A-Za-z][A-Za-z0-9]*;|amp|lt|gt|quot|nbsp)"
_NAMED = {**{f"&{k};": chr(v) for k, v in html.entities.name2codepoint.items()}, "&apos;": "'",
          **{f"&{k}": chr(html.entities.name2codepoint[k]) for k in ("amp", "lt", "gt", "quot", "nbsp")}}
#: Numbers 128 to 159 mean characters of code page 1252.
_CP1252 = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (129, 141, 143, 144, 157)}


def _looked_up(value: Column, pairs: dict) -> Column:
    """Value of a key in a table of single characters, which stands in the plan as two constants."""
    at = F.array_position(F.split(F.lit("\x1f".join(map(str, pairs))), "\x1f"), value)
    return _let(at, lambda i: F.when(i > 0, F.substr(F.lit("".join(pairs.values())), i.cast("int"), F.lit(1))))


def _character(n: Column) -> Column:
    real = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(F.when(n.between(128, 159), _looked_up(n.cast("string"), _CP1252)), F.when(real, text), F.lit("\ufffd"))


def _decoded(ref: Column) -> Column:
    number = F.regexp_extract(ref, r"^&#(\d+)", 1).try_cast("bigint")
    digits = F.nullif(F.regexp_extract(ref, r"^&#[xX]([0-9a-fA-F]+)", 1), F.lit(""))
    code = F.coalesce(number, F.conv(digits, 16, 10).try_cast("bigint"))
    named = F.coalesce(_looked_up(ref, _NAMED), ref)
    return F.when(ref.startswith("&#"), _let(code, lambda n: F.when(n.isNotNull(), _character(n)).otherwise(named))).otherwise(named)


def _unescape(c: Column) -> Column:
    """Character references decoded, each once; unknown names stay."""
    def decoded(v: Column) -> Column:
        parts = F.regexp_extract_all(v, F.lit(f"{_REFERENCE}|[^&]++|&"), F.lit(0))
        texts = F.transform(parts, lambda p: F.when(p.startswith("&"), _decoded(p)).otherwise(p))
        return F.when(v.contains("&"), F.array_join(texts, "")).otherwise(v)

    return _let(c, decoded)


def _text(inner: Column) -> Column:
    """Stripped text nodes of an element put together."""
    text = _let(inner, lambda v: F.when(v.contains("<"), F.regexp_replace(v, rf"\s*<{_END}\s*", "")).otherwise(v))
    return _let(_unescape(text), strip)


def _value(card: Column, attr: str, tag: str, *tests: str) -> Column:
    """Attribute of the first start tag that fits; '' when there is none."""
    return _attr_value(F.regexp_extract(card, _open(tag, *tests), 0), attr)


def _attr_value(start: Column, attr: str) -> Column:
    return _unescape(F.regexp_extract(start, rf"(?is)\s{attr}\s*=\s*([\"'])(.*?)\1", 2))


def _tags(card: Column, tag: str, *tests: str) -> Column:
    """All start tags that fit, each without its name."""
    return F.regexp_extract_all(card, F.lit(rf"(?is)<{tag}\b(?=({''.join(tests)}{_END}))"), F.lit(1))


def _cards(pages: DataFrame, tag: str, *tests: str) -> DataFrame:
    """(page_id, pos, card): what lies between a card's start tag and its own end tag, or else the next card."""
    clean = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    clean = _let(clean, lambda v: F.when(
        v.rlike(r"(?i)<s(?:cript|tyle)\b"), F.regexp_replace(v, r"(?is)<(script|style)\b.*?</\1\s*>", "")).otherwise(v))
    parts = F.split(clean, _open(tag, *tests), -1)
    out = pages.withColumn("_parts", parts).select(
        "page_id", F.posexplode(F.slice("_parts", 2, F.greatest(F.size("_parts"), F.lit(1)))).alias("pos", "card")
    )
    return out.withColumn("card", _balanced(F.col("card"), tag))


def _raw(source: str, **cols: Column) -> list[Column]:
    """The raw-listing columns; parts a page does not carry are NULL or empty."""
    none = F.lit(None)
    base = {
        "source_url": F.lit(""), "address": F.lit(""), "price": none.cast("int"), "bedrooms": none.cast("int"),
        "bathrooms": none.cast("double"), "sqft": none.cast("int"), "description": none.cast("string"),
        "images": F.array().cast("array<string>"),
        "raw_data": F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    }
    base.update(cols)
    return [F.col("page_id"), F.col("pos"), F.lit(source).alias("source"), *[v.alias(k) for k, v in base.items()]]


def _one_image(src: Column) -> Column:
    return F.when(src != "", F.array(src)).otherwise(F.array().cast("array<string>"))


def _text_map(**parts: Column) -> Column:
    flat = [x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*flat)


def _shown_image(images: Column) -> Column:
    """Source of the first active image, or else of the first one."""
    def src(tags: Column) -> Column:
        return F.coalesce(_attr_value(F.get(tags, F.lit(0)), "src"), F.lit(""))

    active = F.filter(images, lambda t: t.rlike(rf"(?is)^{_cls(SE_ACTIVE_IMAGE)}"))
    return _let(src(active), lambda a: F.when(a != "", a).otherwise(src(images)))


def streeteasy_cards(pages: DataFrame) -> DataFrame:
    c = F.col("card")
    cards = _cards(pages, "div", _attr("data-testid", "listing-card"))
    facts = F.regexp_extract_all(
        _inner(c, "ul", _cls(SE_FACTS)), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1)
    )
    cards = cards.withColumns({
        "facts": F.transform(facts, lambda li: _text(_inner(li, _ANY, _cls(SE_FACT)))),
        "addr": _text(_inner(c, "a", _cls(SE_ADDRESS))),
        "href": _value(c, "href", "a", _cls(SE_ADDRESS)),
        "image": _let(_tags(c, "img", _cls(SE_IMAGE)), _shown_image),
        "price_text": _text(_inner(c, "span", _cls(SE_PRICE))),
    })

    def fact(i: int) -> Column:
        return F.coalesce(F.get("facts", F.lit(i)), F.lit(""))

    return cards.select(*_raw(
        "streeteasy",
        source_url=F.when(F.col("href") != "", F.col("href")).otherwise(
            F.concat(F.lit(SITES["streeteasy"] + "#"), F.col("addr"))
        ),
        address=F.col("addr"),
        price=parse_price_dollars(F.col("price_text")),
        bedrooms=parse_int(fact(0)), bathrooms=parse_float(fact(1)), sqft=parse_int(fact(2)),
        images=_one_image(F.col("image")),
        raw_data=_text_map(
            title=_text(_inner(c, "p", _cls(SE_TITLE))),
            listed_by=_text(_inner(c, "p", _cls(SE_LISTED_BY))),
            base_rent_tooltip=_text(_inner(c, "button", _cls(SE_BASE_RENT))),
            price_tag=_text(_inner(_inner(c, "div", _cls(SE_PRICE_TAG)), "span", _attr("data-testid", "tag-text"))),
        ),
    ))


def zillow_cards(pages: DataFrame) -> DataFrame:
    c = F.col("card")
    cards = _cards(pages, "article", _attr("data-test", "property-card"))
    cards = cards.withColumns({
        "addr": _text(_inner(c, "address", _attr("data-test", "property-card-addr"))),
        "href": _value(c, "href", "a", _attr("data-test", "property-card-link")),
    }).withColumn("href", absolutize(F.col("href"), SITES["zillow"]))

    cards = cards.withColumns({
        "price_text": _text(_inner(c, _ANY, _attr("data-test", "property-card-price"))),
        **{word: _text(_inner(c, "abbr", _attr_has("aria-label", word))) for word in ("bed", "bath", "sqft")},
    })
    return cards.select(*_raw(
        "zillow",
        source_url=F.when(F.col("href") != "", F.col("href")).otherwise(F.concat(F.lit("https://zillow.com#"), F.col("addr"))),
        address=F.col("addr"),
        price=parse_price_dollars(F.col("price_text")),
        bedrooms=parse_int(F.col("bed")), bathrooms=parse_float(F.col("bath")), sqft=parse_int(F.col("sqft")),
        images=_one_image(_value(c, "src", "img", _attr("data-test", "property-card-img"))),
    ))


def craigslist_cards(pages: DataFrame) -> DataFrame:
    c = F.col("card")
    cards = _cards(pages, "li", _cls("cl-static-search-result"))
    cards = cards.withColumns({
        "title": _text(_inner(c, _ANY, _cls("title"))),
        "price_text": _text(_inner(c, _ANY, _cls("price"))),
        "href": _value(c, "href", "a"),
    })
    return cards.select(*_raw(
        "craigslist",
        source_url=absolutize(F.col("href"), SITES["craigslist"]),
        address=F.col("title"),
        price=parse_price_dollars(F.col("price_text")),
        description=_text(_inner(c, _ANY, _cls("details"))),
        raw_data=_text_map(title=F.col("title"), price_raw=F.col("price_text")),
    ))


# --- embedded JSON ---

_LIST = "array<variant>"


def _v(v: Column, *keys: str) -> Column:
    """First key that is present, also when its value is a JSON null."""
    return F.coalesce(*[F.try_variant_get(v, f"$['{k}']", "variant") for k in keys])


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, prefix: str) -> Column:
    return F.coalesce(_kind(v).startswith(prefix), F.lit(False))


def _str(v: Column) -> Column:
    """Text of a scalar, '' for null or missing."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))


def _is_number(v: Column) -> Column:
    return F.coalesce(_kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def loose_int(v: Column) -> Column:
    """Numbers truncate, text goes through the loose text rule."""
    number = int_trunc(F.try_variant_get(v, "$", "double"))
    return F.when(_is_number(v), number).otherwise(parse_int(_str(v)))


def loose_float(v: Column) -> Column:
    return F.when(_is_number(v), F.try_variant_get(v, "$", "double")).otherwise(parse_float(_str(v)))


def _scalar_or_min(v: Column) -> Column:
    return F.when(_is(v, "OBJECT"), _v(v, "min")).otherwise(v)


def _filled(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def _joined(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])


def _image_list(images: Column, *keys: str) -> Column:
    """First images of a list: text items as they are, objects by their link."""
    first = F.slice(F.try_variant_get(images, "$", _LIST), 1, MAX_IMAGES)
    links = F.transform(first, lambda p: F.when(_is(p, "OBJECT"), _str(_v(p, *keys))).otherwise(_str(p)))
    return F.coalesce(links, F.array().cast("array<string>"))


def rentcom_items(pages: DataFrame) -> DataFrame:
    block = F.regexp_extract(
        "html", r'(?s)<script\s+id="__NEXT_DATA__"\s+type="application/json">(.*?)</script>', 1
    )
    doc = pages.withColumn("d", F.try_parse_json(F.nullif(block, F.lit("")))).filter(F.col("d").isNotNull())
    props = "$.props.pageProps"
    lists = [
        _filled(F.try_variant_get("d", f"{props}.{path}", _LIST))
        for path in ("listings", "searchResults.listings", "properties")
    ]
    items = doc.select("page_id", F.posexplode(F.coalesce(*lists)).alias("pos", "v")).filter(_is(F.col("v"), "OBJECT"))
    v = F.col("v")
    return items.select(*_raw(
        "rentcom",
        source_url=absolutize(_str(_v(v, "url", "detailUrl")), SITES["rentcom"]),
        address=_joined(*[_str(_v(v, k)) for k in ("address", "city", "state")]),
        price=loose_int(_scalar_or_min(_v(v, "rent", "price"))),
        bedrooms=loose_int(_scalar_or_min(_v(v, "beds", "bedrooms"))),
        bathrooms=loose_float(_scalar_or_min(_v(v, "baths", "bathrooms"))),
        images=_image_list(_v(v, "images", "photos"), "url"),
        raw_data=_text_map(
            name=_str(_v(v, "name")), neighborhood=_str(_v(v, "neighborhood")),
            lat=F.try_variant_get(v, "$.latitude", "string"), lng=F.try_variant_get(v, "$.longitude", "string"),
        ),
    ))


def zumper_items(pages: DataFrame) -> DataFrame:
    pattern = rf"(?is)<script\b{_attr('type', 'application/ld+json')}[^>]*>(.*?)</script>"
    docs = F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), F.try_parse_json)
    each = F.flatten(F.transform(
        F.filter(docs, lambda d: d.isNotNull()), lambda d: F.when(_is(d, "ARRAY"), F.try_variant_get(d, "$", _LIST)).otherwise(F.array(d))))
    none = F.array().cast(_LIST)

    def members(v: Column) -> Column:
        listed = F.transform(
            F.try_variant_get(_v(v, "itemListElement"), "$", _LIST), lambda e: F.coalesce(F.try_variant_get(e, "$.item", "variant"), e))
        kind = _str(_v(v, "@type"))
        return F.coalesce(F.when(kind == "ItemList", listed).when(kind.isin(*LD_HOME_TYPES), F.array(v)), none)

    # one array per page, so that the position counts all members whatever their block
    found = F.flatten(F.transform(F.filter(each, lambda v: _is(v, "OBJECT")), members))
    items = pages.select("page_id", F.posexplode(found).alias("pos", "v")).filter(_is(F.col("v"), "OBJECT"))
    v = F.col("v")
    place, offers, floor, images, geo = (
        _v(v, "address"), _v(v, "offers"), _v(v, "floorSize"), _v(v, "image", "photo"), _v(v, "geo")
    )
    address = (
        F.when(place.isNull(), "")
        .when(_is(place, "OBJECT"), _joined(*[_str(_v(place, k)) for k in ("streetAddress", "addressLocality", "addressRegion")]))
        .otherwise(_str(place))
    )
    price = F.when(_is(offers, "OBJECT"), loose_int(_v(offers, "price", "lowPrice"))).when(
        _is(offers, "ARRAY"), loose_int(F.try_variant_get(offers, "$[0].price", "variant"))
    )
    sqft = F.when(_is(floor, "OBJECT"), loose_int(_v(floor, "value"))).otherwise(loose_int(floor))
    return items.withColumn("addr", address).filter(F.col("addr") != "").select(*_raw(
        "zumper",
        source_url=absolutize(_str(_v(v, "url")), SITES["zumper"]),
        address=F.col("addr"), price=price,
        bedrooms=loose_int(_v(v, "numberOfBedrooms", "numberOfRooms")),
        bathrooms=loose_float(_v(v, "numberOfBathroomsTotal", "numberOfBathrooms")),
        sqft=sqft,
        description=F.try_variant_get(v, "$.description", "string"),
        images=F.when(_is(images, "STRING"), F.array(_str(images))).otherwise(_image_list(images, "contentUrl", "url")),
        raw_data=_text_map(
            name=_str(_v(v, "name")),
            lat=F.try_variant_get(geo, "$.latitude", "string"), lng=F.try_variant_get(geo, "$.longitude", "string"),
        ),
    ))
