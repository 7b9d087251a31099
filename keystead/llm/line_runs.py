"""Line dedup over levelled sorted runs of line hashes.

A run is a stored table of (h1, h2, docs, holder) sorted by hash: how many documents hold a line, and the one
that keeps it. A batch of documents is merge-anti-joined with the runs: its lines that no run knows are new and go
into a run of level 0 with the batch's holder; of known lines only the added document count is kept. When a level
has ``fanout`` runs they are merged into one sorted run of the next level, so a line is rewritten once per level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def line_key(line):
    """Key of a line: blanks off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(text, min_chars: int):
    """Per line of a text its 128-bit key hash, null for a key of fewer code points than ``min_chars``."""

    def one(line):
        key = F.btrim(line, F.lit(BLANKS))
        low = F.translate(key, UPPER, LOWER)
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


class LineRuns:
    """The levelled runs; ``add`` takes (h1, h2, docs, holder), one row per line of a batch."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        return stored(rows.repartitionByRange(*HASH).sortWithinPartitions(*HASH), "line-run")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for r in runs[1:]:
            rows = rows.unionByName(r)
        return rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))

    def add(self, batch: DataFrame) -> None:
        """New lines bring their holder, known ones only more documents: batches come from the largest id down."""
        fresh = batch
        for run in self.runs():
            fresh = fresh.join(run.select(*HASH).hint("merge"), HASH, "left_anti")
        if self.runs():
            known = batch.join(fresh.select(*HASH).hint("merge"), HASH, "left_anti")
            fresh = fresh.unionByName(known.withColumn("holder", F.lit(None).cast(batch.schema["holder"].dataType)))
        run = self._write(fresh)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                break
            run, self.levels[level] = self._write(self._merged(self.levels[level])), []

    def lines(self) -> DataFrame:
        """(h1, h2, docs, holder) over all batches."""
        return self._merged(self.runs())


def held_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, th, pos, h1, h2) of every line whose key is long enough; th tells apart different texts of one id."""
    k = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"),
        F.posexplode(line_hashes(F.col(text_col), min_chars)).alias("pos", "k"))
    return k.filter("k is not null").select("id", "th", "pos", "k.*")


def repeated_lines(held: DataFrame, min_docs: int, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(h1, h2, docs, holder) of the lines that at least ``min_docs`` documents hold; holder is the largest id."""
    edges = held.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / batches for i in range(1, batches)], 0.01)
    batch = F.lit(0)
    for e in edges:  # the largest ids are batch 0
        batch = batch + (F.col("id") < e).cast("int")
    first = held.groupBy("id", "th", *HASH).agg(F.lit(1).alias("one")).withColumn("batch", batch)
    sums = stored(first.groupBy("batch", *HASH).agg(F.count("*").alias("docs"), F.max("id").alias("holder")), "line-batches")
    index = LineRuns(fanout)
    for b in range(batches):
        index.add(sums.filter(F.col("batch") == b).drop("batch"))
    return index.lines().filter(F.col("docs") >= min_docs)


def _without(text, gone):
    """The text without the lines at the places in ``gone`` (null: none)."""
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4,
    fanout: int = 3, dropped_col: str | None = None,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all rows and other columns stay.

    A line whose key (``line_key``) has ``min_chars`` code points or more and is held by ``min_docs`` documents or more
    stays only in the document with the largest id. Rows of one id with equal texts are one document; rows with
    null id lose nothing and are not counted; null text stays null; an empty table stays empty, and other columns may have
    any names. ``dropped_col`` adds the number of lines taken out.
    """
    held = stored(held_lines(docs, id_col, text_col, min_chars), "lines")
    dup = stored(repeated_lines(held, min_docs, batches, fanout).select(*HASH, "holder"), "lines-repeated")
    gone = (
        held.join(dup, HASH).filter(F.col("id") != F.col("holder"))
        .groupBy(F.col("id").alias("line_owner"), F.col("th").alias("line_text")).agg(F.collect_set("pos").alias("lines_gone"))
    )
    own = docs.select(F.struct(*docs.columns).alias("doc"))  # in one column, so that no name can clash
    doc = F.col("doc")
    out = own.join(gone, (doc[id_col] == F.col("line_owner")) & (F.xxhash64(doc[text_col]) == F.col("line_text")), "left")
    columns = [_without(doc[c], F.col("lines_gone")).alias(c) if c == text_col else doc[c].alias(c) for c in docs.columns]
    if dropped_col:
        columns.append(F.coalesce(F.size("lines_gone"), F.lit(0)).cast("long").alias(dropped_col))
    return out.select(*columns)
