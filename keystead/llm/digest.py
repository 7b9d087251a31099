"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

The entropy of every 64-byte window is ranked by how rare its level is among all windows of the corpus. A window
that is the leftmost rarest of at least 16 runs of 64 neighbouring windows is a feature; features go, in order,
into Bloom filters of 2,048 bits (5 bits each, 160 features a filter). Likeness is the overlap of filters beyond chance, as a share
of the largest overlap possible, averaged over the filters of the digest with fewer.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytewise as bw
from .tables import stored

SIZE = 64
LEVELS = 1000
LEAST_RUNS, PER_FILTER, BITS = 16, 160, 2048
_UNIT = np.round(np.r_[0, np.arange(1, SIZE + 1) * np.log2(np.arange(1, SIZE + 1))] * 65536).astype(np.int64)
_STEP = np.diff(_UNIT)
_TOP = int(_UNIT[SIZE])
#: Windows of less entropy than one bit a byte are no features.
_DULL = LEVELS - LEVELS // 6
_COUNT = np.array([bin(i).count("1") for i in range(256)], np.int32)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of each window of SIZE bytes (0: all bytes differ, LEVELS: all are equal)."""
    n = len(data)
    if n < SIZE:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, SIZE):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    total = np.empty(n - SIZE + 1, np.int64)
    total[0] = _UNIT[np.bincount(data[:SIZE], minlength=256)].sum()
    total[1:] = _STEP[before[SIZE:]] - _STEP[after[: n - SIZE]]
    return np.cumsum(total) * LEVELS // _TOP


def _windows(at: np.ndarray, n: int) -> np.ndarray:
    """Whether the window at each place lies within one text."""
    ok = np.zeros(n + 1, np.int8)
    long = np.diff(at) >= SIZE
    np.add.at(ok, at[:-1][long], 1)
    np.add.at(ok, at[1:][long] - SIZE + 1, -1)
    return np.cumsum(ok[:n]).astype(bool)


def level_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level, rarest first, from the windows of all texts."""

    def run(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            data, at = bw.flat(batch.column(0))
            for i, j in bw.pieces(at, 1 << 18):
                part = data[at[i] : at[j]]
                found = levels(part)
                total += np.bincount(found[_windows(at[i : j + 1] - at[i], len(found))], minlength=LEVELS + 1)
        yield pa.record_batch([pa.array(np.arange(LEVELS + 1)), pa.array(total)], names=["level", "n"])

    rows = docs.select(text_col).mapInArrow(bw.released(run), "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(LEVELS + 1, np.int64)
    for r in rows:
        count[r.level] = r.n
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(LEVELS + 1)
    return rank


def _digest(features: np.ndarray) -> bytes:
    """Filters of distinct feature hashes in order: a count byte and the bits of each."""
    if not len(features):
        return b""
    _, first = np.unique(features, return_index=True)
    features = features[np.sort(first)]
    number = -(-len(features) // PER_FILTER)
    place = np.arange(len(features)) // PER_FILTER
    bits = np.zeros((number, BITS), np.uint8)
    for k in range(5):
        bits[place, ((features >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    size = np.bincount(place).astype(np.uint8)
    return np.hstack([size[:, None], np.packbits(bits, axis=1)]).tobytes()


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """Digest of each text. A text of fewer than SIZE bytes is one feature as a whole; an empty one has none."""
    out: list[bytes] = []
    at = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    for i, j in bw.pieces(at, 1 << 18):
        part = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        found = levels(part)
        key = (ranks[found] << 40) | np.arange(len(found))
        key[found > _DULL] |= 1 << 60
        low = key
        for w in (1, 2, 4, 8, 16, 32):
            low = np.minimum(low[:-w], low[w:]) if len(low) > w else low[:0]
        for x in range(i, j):
            a, b = int(at[x] - at[i]), int(at[x + 1] - at[i])
            if b - a < SIZE:
                whole = int.from_bytes(hashlib.sha1(texts[x]).digest()[:8], "little")
                out.append(_digest(np.array([whole], np.uint64)) if b > a else b"")
                continue
            last = b - SIZE + 1
            runs = low[a : last - 63] if last - a >= 64 else key[a:last].min(keepdims=True)
            best = (runs & ((1 << 40) - 1)) - a
            count = np.bincount(best[runs < 1 << 60], minlength=1)
            places = np.flatnonzero(count >= min(LEAST_RUNS, count.max())) if count.max() else np.zeros(1, np.int64)
            view = np.ascontiguousarray(part[a + places[:, None] + np.arange(SIZE)]).view(np.uint64)
            out.append(_digest(bw.mix((bw.mix(view) * bw.SHINGLE_FACTORS[:8]).sum(axis=1, dtype=np.uint64))))
    return out


def likeness(x: bytes, y: bytes) -> float:
    """0 to 1; two empty digests are alike, an empty one is like no other."""
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    if (len(x), x) > (len(y), y):
        x, y = y, x
    a, b = (np.frombuffer(z, np.uint8).reshape(-1, 1 + BITS // 8) for z in (x, y))
    if len(a) > 1:  # a last filter with few features says little
        a = a[a[:, 0] >= 16]
    size_b = _COUNT[b[:, 1:]].sum(axis=1)
    total = 0.0
    for f in a[:, 1:]:
        size = int(_COUNT[f].sum())
        chance = size * size_b / BITS
        most = np.minimum(size, size_b) - chance
        total += float(np.clip((_COUNT[f & b[:, 1:]].sum(axis=1) - chance) / np.maximum(most, 1e-9), 0, 1).max())
    return total / len(a)


def _text(x: bytes) -> str:
    return base64.b64encode(x).decode()


COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_STAGE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, pid int, edge int, text string"


def _compared(ids, texts: list[str], ranks: np.ndarray, own: list[bytes]) -> pd.DataFrame:
    """Rows of all texts but the last, each against its successor."""
    half = [len(t) // 2 for t in texts[:-1]]
    edited = [(t[: len(t) - h] + nxt[:h]).encode("utf-8", "surrogatepass") for t, h, nxt in zip(texts, half, texts[1:], strict=False)]
    prints = digests(edited, ranks)
    return pd.DataFrame({
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
        "fingerprint": [_text(x) for x in own[:-1]], "edited_fingerprint": [_text(x) for x in prints],
        "near_edited": [likeness(x, y) for x, y in zip(own, prints, strict=False)],
        "near_next": [likeness(x, y) for x, y in zip(own, own[1:], strict=False)],
    })


def fingerprints(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COLUMNS of every row: its digest, that of its edited text (second half replaced by the start of the next row's text), likenesses.

    Rows are in order of id, then text; null text is empty, null ids come first, and after the last row comes the first. Texts are
    dealt by ranges of the id once; only the first and last row of each range are kept to meet their neighbours.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "text").drop("tie")

    def run(batches):
        pid = TaskContext.get().partitionId()
        ids, texts, own, first = [], [], [], True
        kept: list[tuple[list, list]] = []

        def blocks():
            for batch in batches:
                size, a = 0, 0
                col, ident = batch["text"].tolist(), batch["doc_id"].tolist()
                for k, t in enumerate(col):
                    size += len(t)
                    if size > 1 << 20 or k == len(col) - 1:
                        yield ident[a : k + 1], col[a : k + 1]
                        size, a = 0, k + 1

        def edge_row(kind, i, t, o):
            return pd.DataFrame({"doc_id": [i], "n_chars": [len(t)], "edited_sha256": [None], "fingerprint": [_text(o)], "edited_fingerprint": [None],
                                 "near_edited": [None], "near_next": [None], "pid": [pid], "edge": [kind], "text": [t]})

        for block_ids, block_texts in blocks():
            block_own = digests([t.encode("utf-8", "surrogatepass") for t in block_texts], ranks)
            if first:
                yield edge_row(0, block_ids[0], block_texts[0], block_own[0])
                first = False
            ids, texts, own = ids + block_ids, texts + block_texts, own + block_own
            if len(ids) > 1:
                yield _compared(ids, texts, ranks, own).assign(pid=pid, edge=None, text=None)
            ids, texts, own = ids[-1:], texts[-1:], own[-1:]
        if ids:
            yield edge_row(1, ids[0], texts[0], own[0])

    staged = stored(rows.mapInPandas(bw.released(run), _STAGE), "digests")
    pids = staged.filter("edge = 0").select("pid")
    one = Window.orderBy("pid")  # one number per range of ids
    follows = pids.select("pid", F.coalesce(F.lead("pid").over(one), F.min("pid").over(Window.partitionBy())).alias("next_pid"))
    last = staged.filter("edge = 1").select("pid", "doc_id", "text", "fingerprint").join(follows, "pid")
    head = staged.filter("edge = 0").select(F.col("pid").alias("next_pid"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))

    def meet(batches):
        for b in batches:
            for r in b.itertuples():
                own = [base64.b64decode(r.fingerprint), base64.b64decode(r.next_print)]
                yield _compared([r.doc_id, None], [r.text, r.next_text], ranks, own)

    schema = _STAGE.split(", pid")[0]
    met = last.join(head, "next_pid").mapInPandas(meet, schema)
    return staged.filter("edge is null").select(*COLUMNS).union(met.select(*COLUMNS))
