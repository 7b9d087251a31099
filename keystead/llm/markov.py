"""Secret scan: patterns with fixed rules, and strings that a character Markov model finds random.

Two models of character pairs, one of random strings and one of ordinary identifiers, are trained from labelled samples
cut like the tokens that are scanned; a token is a secret when its log-likelihood ratio per character is above a threshold
taken from held-out samples.

Null and empty texts have no spans, an empty table gives an empty one; rows are scanned one by one, so repeated rows
repeat their spans, and further columns stay. Whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import bytewise as bw

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens the models judge: runs of key characters that hold a letter and LEAST_KINDS different characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_KINDS = 8
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASS = np.full(128, len(ALPHABET))
CLASS[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Share of the held-out ordinary samples that may score above the threshold.
FALSE_ALARMS = 0.002
#: Weight of the single-character frequencies in a transition row.
SMOOTH = 5.0
#: Bounds of the labelled samples: documents (expected number, drawn by row hash) and words (least hashes) that identifiers
#: are made of, samples of each kind.
SAMPLED_DOCS, SAMPLED_WORDS, SAMPLES = 5_000, 5_000, 8_000
# fixed values: words that identifiers in programs are made of
WORDS = (
    "account action address admin agent api app array async auth base batch block body bool buffer build button byte cache call check "
    "child class client cloud code column command config connect content context control copy count create cursor data date debug default "
    "delete device dir document domain double dump edge email encode error event example export factory fetch field file filter find flag "
    "float folder format frame from function get global graph group handler hash header height host html http https image import index "
    "info init input insert int interface item job json key label layer length level library line link list load local lock log long "
    "main manager map master memory message method metric mode model module name network node null number object offset option order output "
    "package page param parse password path pattern pixel pointer pool port process project property protocol proxy query queue random read "
    "record remove report request reset resource response result return role route row rule schema scope script search select sequence server "
    "service session set shape signature size socket sort source spec start state static status step store stream string sum switch "
    "system table target task template test text thread time token trace train transform tree type update upload url user util valid value "
    "vector version view web width window worker write xml zip").split()
RUNS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "qwertyuiopasdfghjklzxcvbnm")
RANDOM_SETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-", ALPHABET[:52],
    ALPHABET[:26], ALPHABET[:26] + "0123456789", ALPHABET[26:52] + "0123456789")
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the matches of the fixed rules; per kind from the left, without overlap."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pair_counts(strings) -> np.ndarray:
    size = len(ALPHABET) + 1
    out = np.zeros((size, size))
    for s in strings:
        c = CLASS[np.minimum(np.frombuffer(s.encode("ascii", "replace"), np.uint8), 127)]
        np.add.at(out, (c[:-1], c[1:]), 1)
    return out


def log_ratio(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log ratio of the two transition tables, each smoothed by SMOOTH characters of its own frequencies."""

    def log_p(pairs: np.ndarray) -> np.ndarray:
        single = pairs.sum(axis=0) + 0.5
        p = pairs + SMOOTH * single / single.sum()
        return np.log(p / p.sum(axis=1, keepdims=True))

    return log_p(random) - log_p(ordinary)


def train(samples: DataFrame) -> np.ndarray:
    """Log-ratio table from (text, random boolean); null rows are left out. Counts are added up by Spark."""

    def run(batches):
        for batch in batches:
            text, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in (True, False):
                table = pair_counts(t for t, x in zip(text, kind, strict=True) if x is k)
                i, j = np.nonzero(table)
                yield pa.record_batch([pa.array([k] * len(i), pa.bool_()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(table[i, j])],
                                      names=["random", "i", "j", "n"])

    rows = samples.select("text", "random").dropna().mapInArrow(bw.released(run), "random boolean, i long, j long, n double")
    rows = rows.groupBy("random", "i", "j").agg(F.sum("n").alias("n")).toPandas()  # at most two tables of pairs of characters
    tables = np.zeros((2, len(ALPHABET) + 1, len(ALPHABET) + 1))
    tables[rows["random"].astype(int), rows["i"].astype(int), rows["j"].astype(int)] = rows["n"]
    return log_ratio(tables[1], tables[0])


def sampled_words(docs: DataFrame, text_col: str = "text", max_docs: int = SAMPLED_DOCS, max_words: int = SAMPLED_WORDS) -> list[str]:
    """Words of 3 to 15 letters of about ``max_docs`` documents, those of least hash: a bounded list.

    Documents are drawn by the hash of the row, of all columns that have one, so neither order nor copies matter.
    """
    rows = docs.count()
    named = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    drawn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in named]), F.lit(max(rows, 1))) < max_docs
    word = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{3,15}(?![A-Za-z0-9])"), F.lit(0)))
    words = docs.filter(drawn).select(word.alias("word")).distinct()
    return sorted(r[0] for r in words.orderBy(F.xxhash64("word"), "word").limit(max_words).collect())


def identifier(words: list[str], rng: np.random.Generator) -> str:
    """An ordinary token of 16 or more characters: words in one of the usual styles, now and then with numbers, or a run."""
    style = rng.integers(0, 10)
    if style == 9:
        run = RUNS[rng.integers(0, len(RUNS))]
        at = rng.integers(0, len(run))
        return (run[at:] + run * 3)[: rng.integers(16, 41)]
    least, out = rng.integers(16, 41), []
    while sum(map(len, out)) < least:
        w = (words if rng.random() < 0.5 and words else WORDS)
        out.append(w[rng.integers(0, len(w))])
        if rng.random() < 0.12:
            out.append(str(rng.integers(0, 10 ** rng.integers(1, 5))))
        if rng.random() < 0.05:
            out[-1] = out[-1].upper()
    if style < 3:
        return "".join(w[:1].upper() + w[1:] for w in out)
    if style < 5:
        return out[0] + "".join(w[:1].upper() + w[1:] for w in out[1:])
    return ("_", "-", "/", "", "_")[style - 5 if style < 9 else 0].join(out)


def samples(words: list[str], n: int = SAMPLES, seed: int = 11) -> list[tuple[str, bool]]:
    """``n`` labelled strings of each kind: (text, random). Repeats exactly for the same words and seed."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        kinds = RANDOM_SETS[i % len(RANDOM_SETS)]
        out.append(("".join(kinds[j] for j in rng.integers(0, len(kinds), rng.integers(16, 65))), True))
        out.append((identifier(words, rng), False))
    return out


def judged(token: str) -> bool:
    return len(set(token)) >= LEAST_KINDS and any(c.isalpha() for c in token)


def score(token: str, table: np.ndarray) -> float:
    """Mean log-likelihood ratio per pair of characters."""
    c = CLASS[np.frombuffer(token.encode(), np.uint8)]
    return float(table[c[:-1], c[1:]].mean())


def threshold(held_out: list[tuple[str, bool]], table: np.ndarray) -> float:
    """The score that only FALSE_ALARMS of the ordinary samples exceed."""
    ordinary = [score(t, table) for t, is_random in held_out if not is_random and judged(t)]
    return max(0.0, float(np.quantile(ordinary, 1 - FALSE_ALARMS)))


def fit(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, float]:
    """Table and threshold of the models, from samples that follow the words of ``docs``; the threshold from others than the table."""
    words = sampled_words(docs, text_col)
    table = train(docs.sparkSession.createDataFrame(samples(words), "text string, random boolean"))
    return table, threshold(samples(words, seed=12), table)


def random_spans(text: str, model: tuple[np.ndarray, float], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens outside the given spans that look random."""
    table, least = model
    out, at = [], 0
    taken = sorted((a, b) for a, _, b in taken)
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        # spans of two kinds may overlap, so those that begin before the token's end are looked through
        k = at
        while k < len(taken) and taken[k][0] < m.end() and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        if judged(m.group()) and score(m.group(), table) > least:
            out.append((m.start(), 3, m.end()))
    return out


def scan(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end) in code points, end exclusive, by start and then kind. Null text has none."""

    @pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = fixed_spans(text) if text else []
            if text:
                found = sorted(found + random_spans(text, model, found))
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found])
        return pd.Series(out)

    return docs.withColumn(spans_col, spans(F.col(text_col)))
