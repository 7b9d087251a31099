"""Sources by name, the union of their feeds and a hook for own page parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, types as T

from . import pages as P

Extractor = Callable[[DataFrame], DataFrame]
_SOURCES: dict[str, Extractor] = {}
#: Cards that a parser's task holds at a time.
ROWS = 1_000


def register_source(name: str, fn: Extractor) -> None:
    _SOURCES[name] = fn


def source_names() -> list[str]:
    return sorted(_SOURCES)


def extract(pages: DataFrame, source: str) -> DataFrame:
    """Raw listings of one source; an unknown source is an error."""
    if source not in _SOURCES:
        raise ValueError(f"no source registered under {source!r}")
    return pages.transform(_SOURCES[source])


def union_sources(feeds: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, feeds)


for _name, _fn in {
    "streeteasy": P.streeteasy_cards, "zillow": P.zillow_cards, "craigslist": P.craigslist_cards,
    "rentcom": P.rentcom_items, "zumper": P.zumper_items,
}.items():
    register_source(_name, _fn)


def parse_pages(
    pages: DataFrame, parse: Callable[[str], Iterable[Callable[[], dict]]], fields: T.StructType
) -> DataFrame:
    """Bulk hook: ``parse(html)`` yields one thunk per card, each gives a dict.

    A card that fails gives a row with ``error`` set and NULL fields, a page that
    fails gives one such row with position -1; neither stops the job.
    """
    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("pos", T.IntegerType()),
        *fields.fields, T.StructField("error", T.StringType()),
    ])
    names = [f.name for f in fields.fields]

    def rows(page_id, html):
        pos = -1
        try:
            for pos, card in enumerate(parse(html)):
                try:
                    got = card()
                    yield [page_id, pos, *[got.get(n) for n in names], None]
                except Exception as exc:  # a bad card must not lose the page
                    yield [page_id, pos, *[None] * len(names), type(exc).__name__]
        except Exception as exc:
            yield [page_id, -1, *[None] * len(names), type(exc).__name__]

    def run(batches):
        for pdf in batches:
            cards = (r for p, h in zip(pdf["page_id"], pdf["html"]) for r in rows(p, h))
            while part := list(islice(cards, ROWS)):
                yield pd.DataFrame(part, columns=schema.names, dtype=object)

    return pages.select("page_id", "html").mapInPandas(run, schema)
