"""Address cleaning and loose text parsing, all as JVM-side expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .numbers import float_text, let, strip

# Street-type spellings and the form they are stored in.
STREET_TYPES = {
    "avenue": "Ave", "ave": "Ave", "av": "Ave",
    "boulevard": "Blvd", "blvd": "Blvd",
    "street": "St", "st": "St", "str": "St",
    "drive": "Dr", "dr": "Dr",
    "road": "Rd", "rd": "Rd",
    "place": "Pl", "pl": "Pl",
    "lane": "Ln", "ln": "Ln",
    "court": "Ct", "ct": "Ct",
    "terrace": "Ter", "ter": "Ter",
    "way": "Way",
    "circle": "Cir", "cir": "Cir",
    "parkway": "Pkwy", "pkwy": "Pkwy",
    "square": "Sq", "sq": "Sq",
}

# Text patterns.
UNIT_SUFFIX = r"(?iU),?\s*#?\s*(?:apt|apartment|unit|suite|ste|fl|floor|rm|room)\.?\s*[#]?\s*\S+$"
ORDINAL_ENDINGS = ("st", "nd", "rd", "th")
CENTS_PRICE = r"(?U)\$?\s*([\d,]+(?:\.\d{2})?)"
DOLLAR_PRICE = r"(?U)[\$]?\s*([\d,]+)"
SQFT_TEXT = r"(?iU)([\d,]+)\s*(?:sq\.?\s*ft\.?|sf|sqft)"
BEDS_TEXT = r"(?iU)(\d+)\s*(?:bed(?:room)?s?|br|bd)"
BATHS_TEXT = r"(?iU)([\d.]+)\s*(?:bath(?:room)?s?|ba)"
STUDIO_TEXT = r"(?iU)\bstudio\b"


def _first(c: Column, pattern: str) -> Column:
    """First capture of the pattern, NULL when it does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1))


def _no_commas(c: Column) -> Column:
    return F.regexp_replace(c, ",", "")


def _given(c: Column, value: Column) -> Column:
    """Value, but NULL for NULL or empty text."""
    return F.when(F.length(c) > 0, value)


def lower_ordinals(c: Column) -> Column:
    for ending in ORDINAL_ENDINGS:
        c = F.regexp_replace(c, rf"(?iU)\b(\d+){ending}\b", f"$1{ending}")
    return c


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after digits, quotes and hyphens."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def clean_address(raw: Column) -> Column:
    """Stored form of a street address; '' for NULL or empty input."""
    known = F.create_map(*[F.lit(x) for x in chain(*STREET_TYPES.items())])
    text = lower_ordinals(F.regexp_replace(strip(raw), UNIT_SUFFIX, ""))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    words = F.transform(
        words,
        lambda w: F.coalesce(
            F.try_element_at(known, F.lower(F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))), w
        ),
    )
    return F.coalesce(lower_ordinals(title_case(F.array_join(words, " "))), F.lit(""))


def canonical_hash(source: Column, address: Column, bedrooms: Column) -> Column:
    """Key of one unit at one source: source, cleaned address, bedrooms."""
    beds = F.coalesce(bedrooms.cast("double").cast("string"), F.lit("none"))
    return F.sha2(F.concat(source, F.lit("|"), F.lower(address), F.lit("|"), beds), 256)


def canonical_key(source: Column, source_url: Column) -> Column:
    """Key of one advertisement."""
    return F.sha2(F.concat(source, F.lit(":"), source_url), 256)


def parse_price_cents(raw: Column) -> Column:
    """Price text to cents, truncated after multiplying (19.99 -> 1998)."""
    dollars = _no_commas(_first(raw, CENTS_PRICE)).try_cast("double")
    return _given(raw, (dollars * 100).cast("bigint"))


def parse_price_dollars(raw: Column) -> Column:
    return _given(raw, _no_commas(_first(raw, DOLLAR_PRICE)).try_cast("int"))


def parse_bedrooms(raw: Column) -> Column:
    counted = _first(raw, BEDS_TEXT).try_cast("double")
    return _given(
        raw,
        F.when(raw.rlike(STUDIO_TEXT), F.lit(0.0)).otherwise(F.coalesce(counted, float_text(raw))),
    )


def parse_bathrooms(raw: Column) -> Column:
    found = raw.rlike(BATHS_TEXT)
    return _given(
        raw,
        F.when(found, F.regexp_extract(raw, BATHS_TEXT, 1).try_cast("double")).otherwise(
            float_text(raw)
        ),
    )


def parse_sqft(raw: Column) -> Column:
    found = raw.rlike(SQFT_TEXT)
    bare = _no_commas(strip(raw))
    return _given(
        raw,
        F.when(found, _no_commas(F.regexp_extract(raw, SQFT_TEXT, 1)).try_cast("int")).otherwise(
            F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("int"))
        ),
    )


def parse_int(raw: Column) -> Column:
    """Loose text to int: studio -> 0, else the first run of digits and commas."""
    def parsed(t: Column) -> Column:
        digits = _no_commas(_first(t, r"([\d,]+)")).try_cast("int")
        return _given(t, F.when(t.rlike(STUDIO_TEXT), F.lit(0)).otherwise(digits))

    return let(strip(raw), parsed)


def parse_float(raw: Column) -> Column:
    """Loose text to double: the first run of digits and dots."""
    return let(strip(raw), lambda t: _given(t, _first(t, r"([\d.]+)").try_cast("double")))


def absolutize(url: Column, site: str) -> Column:
    """Prefix the site when a non-empty link does not start with http."""
    return F.when((F.length(url) > 0) & ~url.startswith("http"), F.concat(F.lit(site), url)).otherwise(url)
