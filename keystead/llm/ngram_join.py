"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters.

Documents are read twice. The first pass gives each document the size and a 96-bit signature of its shingle set,
so that copies become one class, and notes shingles that are frequent within a batch. The second pass sends the
shingle hashes of one document per class and task, packed by hash range, to the counters of document frequency.
Only shingles found in two or more classes come back, as keys whose order is rare first. A document whose other
shingles are too many to reach the threshold goes no further; the rest meet on their prefix n-grams.

The result is exact for any data. A text within a large group of near copies is compared with one member
that stands for the group (a hub, another one in each round), and pairs within a known component are
never formed; after these rounds all pairs left across components are formed, filtered and verified.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, LongType

from . import bytewise as bw
from .components import connected
from .tables import stored

HASH_BITS = 53
LOW = np.uint64((1 << 48) - 1)
#: Bytes of text whose shingles one frequency counter holds.
COUNTER_BYTES = 16 << 20
#: At most this many frequent shingles are sent to all tasks (8 bytes each).
FREQUENT_KEYS = 500_000


def _sets(texts: pa.Array, n: int):
    """Batches of (first row, rows, text index, hash) with whole texts."""
    data, at = bw.flat(texts)
    for i, j in bw.pieces(at):
        doc, h = bw.shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], n)
        yield i, j - i, doc, h


def _signatures(doc: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    a, b = bw.sums(bw.mix(h, 2), doc, rows), bw.sums(bw.mix(h, 3), doc, rows)
    out = np.empty((rows, 12), np.uint8)
    out[:, :8] = bw.mix(a).view(np.uint8).reshape(rows, 8)
    out[:, 8:] = bw.mix(b).view(np.uint8).reshape(rows, 8)[:, :4]
    return out


def profiles(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, n, sig) of every row, and (key, seen) of shingles that are frequent within a batch."""

    def run(batches):
        for batch in batches:
            size, sigs, heads = [], [], []
            for _, rows, doc, h in _sets(batch.column(1), n):
                size.append(np.bincount(doc, minlength=rows))
                sigs.append(_signatures(doc, h, rows))
                heads.append(h >> np.uint64(64 - HASH_BITS))
            if not batch.num_rows:
                continue
            sig = np.concatenate(sigs)
            size = np.concatenate(size)
            rows = len(size)
            none = pa.nulls(rows, pa.int64())
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()),
                 bw.binaries(sig, np.arange(rows + 1)), none, none], names=["id", "n", "sig", "key", "seen"])
            # copies within the batch count once
            _, first = np.unique(sig.view("V12").ravel(), return_index=True)
            keep = np.zeros(rows, bool)
            keep[first] = True
            keys = np.concatenate(heads)
            keys = np.sort(keys[np.repeat(keep, size)])
            edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
            seen, keys = np.diff(edge), keys[edge[:-1]]
            often = seen >= max(8, len(keys) // 350_000)
            m = int(often.sum())
            if m:
                yield pa.record_batch(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                     pa.array(keys[often].astype(np.int64)), pa.array(seen[often], pa.int64())],
                    names=["id", "n", "sig", "key", "seen"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(bw.released(run), "id long, n long, sig binary, key long, seen long")


def _order_keys(heads: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Keys that sort rare first; equal shingles have equal keys everywhere."""
    return (np.floor(8 * np.log2(df)).astype(np.int64) << HASH_BITS) | heads.astype(np.int64)


def shared_keys(docs: DataFrame, text_col: str, n: int, counters: int, frequent) -> DataFrame:
    """(sig, keys): packed order keys of those shingles of each class that two or more classes hold."""
    bits = int(math.log2(counters))
    shift = np.uint64(HASH_BITS - bits)

    def emit(batches):
        hot, hot_seen = frequent.value
        done: set[bytes] = set()
        for batch in batches:
            for _, rows, doc, h in _sets(batch.column(0), n):
                sig = _signatures(doc, h, rows)
                heads = h >> np.uint64(64 - HASH_BITS)
                has = np.bincount(doc, minlength=rows) > 0
                fresh = np.zeros(rows, bool)
                for i in np.flatnonzero(has):
                    s = sig[i].tobytes()
                    if s not in done:
                        done.add(s)
                        fresh[i] = True
                keep = fresh[doc]
                doc, heads = doc[keep], heads[keep]
                bucket = (heads >> shift).astype(np.int64)
                if len(hot) and len(heads):
                    at = np.minimum(np.searchsorted(hot, heads), len(hot) - 1)
                    is_hot = hot[at] == heads
                    # frequent shingles pass by the counters, spread by class
                    spread = sig[:, 4:8].copy().view(np.uint32).ravel().astype(np.int64) % counters
                    bucket[is_hot] = -1 - spread[doc[is_hot]]
                order = np.argsort(bucket.astype(np.int32), kind="stable")
                bucket, doc, heads = bucket[order], doc[order], heads[order]
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
                out = {"bucket": [], "sigs": [], "counts": [], "low": []}
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    cut = np.flatnonzero(np.r_[True, doc[i + 1 : j] != doc[i : j - 1], True])
                    out["bucket"].append(int(bucket[i]))
                    out["sigs"].append(sig[doc[i + cut[:-1]]].tobytes())
                    out["counts"].append(np.diff(cut).astype(np.int32).tobytes())
                    low = heads[i:j] if bucket[i] >= 0 else _order_keys(heads[i:j], hot_seen[np.searchsorted(hot, heads[i:j])])
                    wide = 6 if bucket[i] >= 0 else 8
                    out["low"].append(np.ascontiguousarray(low).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes())
                yield pa.record_batch([pa.array(out["bucket"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("sigs", "counts", "low"))],
                                      names=["bucket", "sigs", "counts", "low"])

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        join = lambda c: b"".join(x for x in table.column(c).to_pylist())
        sigs = np.frombuffer(join("sigs"), "V12")
        counts = np.frombuffer(join("counts"), np.int32)
        wide = 6 if bucket >= 0 else 8
        raw = np.frombuffer(join("low"), np.uint8).reshape(-1, wide)
        keys = np.zeros((len(raw), 8), np.uint8)
        keys[:, :wide] = raw
        keys = keys.view(np.uint64).ravel()
        # a class that several tasks have sent counts once
        uniq, first = np.unique(sigs, return_index=True)
        keep = np.zeros(len(sigs), bool)
        keep[first] = True
        keys = keys[np.repeat(keep, counts)]
        doc = np.repeat(np.cumsum(keep) - 1, np.where(keep, counts, 0))
        sigs = sigs[keep]
        if bucket >= 0:
            top = np.uint64(bucket >> max(0, bits - 5) if bits >= 5 else bucket)
            keys = (keys & LOW) | (top << np.uint64(48))
            order = np.argsort(keys)
            s = keys[order]
            edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True]) if len(s) else np.zeros(1, np.int64)
            df = np.empty(len(s), np.int64)
            df[order] = np.repeat(np.diff(edge), np.diff(edge))
            more = df >= 2
            keys, doc = _order_keys(keys[more], df[more]), doc[more]
        cut = np.searchsorted(doc, np.arange(len(sigs) + 1))
        full = np.diff(cut) > 0
        edges = np.r_[0, np.cumsum(np.diff(cut)[full])]
        bw.release()
        names = np.ascontiguousarray(sigs[full]).view(np.uint8).reshape(-1, 12)
        return pa.table({"sig": bw.binaries(names, np.arange(len(names) + 1)), "keys": bw.binaries(keys.astype(np.int64), edges)})

    sent = docs.select(text_col).mapInArrow(bw.released(emit), "bucket long, sigs binary, counts binary, low binary")
    return sent.groupBy("bucket").applyInArrow(count, "sig binary, keys binary")


@pandas_udf(ArrayType(LongType()))
def _sorted_keys(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: np.sort(np.frombuffer(b"".join(p), np.int64)))


def _may_reach(x: np.ndarray, y: np.ndarray, miss: int, depth: int) -> bool:
    """Suffix filter: False if the halves around a pivot already differ in more than ``miss`` places."""
    if abs(len(x) - len(y)) > miss:
        return False
    if not depth or not len(x) or not len(y):
        return True
    pivot = y[len(y) // 2]
    i, j = int(np.searchsorted(x, pivot)), len(y) // 2
    same = int(i < len(x) and x[i] == pivot)
    left = abs(i - j)
    right = abs((len(x) - i - same) - (len(y) - j - 1))
    if left + right + (1 - same) > miss:
        return False
    return _may_reach(x[:i], y[:j], miss - right - (1 - same), depth - 1) and _may_reach(
        x[i + same :], y[j + 1 :], miss - left - (1 - same), depth - 1)


def _linked(num: int, den: int):
    @pandas_udf(BooleanType())
    def linked(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        out = []
        for a, n, b, m in zip(x, nx, y, ny, strict=True):
            need = -(-num * (n + m) // (num + den))
            own = (n - len(a)) + (m - len(b))  # shingles that no other class has
            ok = _may_reach(a, b, n + m - 2 * need - own, 3)
            out.append(ok and len(np.intersect1d(a, b, assume_unique=True)) >= need)
        return pd.Series(out)

    return linked


class NgramJoin:
    """Classes, prefix postings and verification for one set of documents.

    Rows with null id take no part; rows of equal id are one document only if their texts are equal (otherwise
    each of its texts is a member of its class). Empty texts have no shingles and no links. Extra columns of ``docs`` are
    ignored. The threshold is num / den on n-word shingles.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4):
        self.num, self.den = num, den
        spark = docs.sparkSession
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        seen = stored(profiles(docs, "id", "text", n), "ngram-profiles")
        self.profiles = seen.filter("sig is not null").select("id", "n", "sig")
        total = self.profiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        least = max(64, total // FREQUENT_KEYS)
        hot = seen.filter("key is not null").groupBy("key").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least)
        hot = hot.orderBy("key").toPandas()  # fewer than FREQUENT_KEYS rows, as each stands for total / FREQUENT_KEYS
        frequent = spark.sparkContext.broadcast((hot["key"].to_numpy(np.uint64), hot["seen"].to_numpy(np.int64)))
        counters = 1 << max(5, min(20, math.ceil(math.log2(1 + 6 * total / COUNTER_BYTES))))
        shared = shared_keys(docs.filter("id is not null"), "text", n, counters, frequent)
        self.classes = (
            self.profiles.filter("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rid"), F.first("n").alias("n"))
        )
        able = (
            shared.groupBy("sig").agg(F.sum(F.octet_length("keys") / 8).cast("long").alias("k"), F.collect_list("keys").alias("parts"))
            .join(self.classes, "sig").filter(F.col("k") * den >= F.col("n") * num)
        )
        self.sets = stored(able.select("rid", "n", _sorted_keys("parts").alias("keys")), "ngram-sets")
        self.postings = stored(self._posted(self.sets.withColumn("comp", F.col("rid"))), "ngram-postings")

    def _posted(self, sets: DataFrame) -> DataFrame:
        """(key, rid, n, pos, apart, comp): the prefix n-grams of every set, rare first."""
        n, k = F.col("n"), F.size("keys")
        prefix = n - F.ceil(n * self.num / self.den).cast("long") + 1
        own = n - k
        head = F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.least(k.cast("long"), prefix - own)).cast("int"))
        flat = sets.select("rid", "n", "comp", own.alias("own"), F.posexplode(head).alias("i", "key"))
        return flat.select("key", "rid", "n", (F.col("own") + F.col("i")).alias("pos"), (64 * F.col("own") / F.col("n")).cast("int").alias("apart"), "comp")

    def _able(self, x: str, y: str):
        """Length and positional filter on two postings of one n-gram."""
        num, den = self.num, self.den
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        need = F.ceil((nx + ny) * num / (num + den))
        most = F.least(nx - F.col(f"{x}pos"), ny - F.col(f"{y}pos"))
        return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (most >= need)

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), each tested once."""
        s = self.sets
        x = s.select(F.col("rid").alias("a"), F.col("n").alias("nx"), F.col("keys").alias("x"))
        y = s.select(F.col("rid").alias("b"), F.col("n").alias("ny"), F.col("keys").alias("y"))
        both = pairs.join(x, "a").join(y, "b")
        return both.filter(_linked(self.num, self.den)("x", "nx", "y", "ny")).select("a", "b")

    def _across(self, postings: DataFrame) -> DataFrame:
        """All pairs of one n-gram across components; the smaller set of a pair needs its shorter index prefix only."""
        num, den = self.num, self.den
        index = F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den)) + 1
        y = postings.filter(F.col("pos") < index).select("key", *(F.col(c).alias(f"y_{c}") for c in ("rid", "n", "pos", "comp")))
        x = postings.select("key", *(F.col(c).alias(f"x_{c}") for c in ("rid", "n", "pos", "comp")))
        smaller = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_rid") < F.col("x_rid")))
        met = x.join(y, (x.key == y.key) & (F.col("x_comp") != F.col("y_comp")) & smaller & self._able("x_", "y_"))
        # n-grams common so far, and what can still follow the last of them
        met = met.groupBy("x_rid", "y_rid", "x_n", "y_n").agg(
            F.count("*").alias("c"), (F.col("x_n") - F.max("x_pos") - 1).alias("x_rest"), (F.col("y_n") - F.max("y_pos") - 1).alias("y_rest"))
        need = F.ceil((F.col("x_n") + F.col("y_n")) * num / (num + den))
        return met.filter(F.col("c") + F.least("x_rest", "y_rest") >= need).select(
            F.least("x_rid", "y_rid").alias("a"), F.greatest("x_rid", "y_rid").alias("b"))

    def pairs(self) -> DataFrame:
        """Every link (a, b) between class representatives, a < b."""
        return self.verify(self._across(self.postings))

    def components(self, rounds: int = 1) -> DataFrame:
        """(rid, comp) of the classes that have links.

        While the pairs left to form are many times the postings, each class is tested with one hub only, that of most of
        its open n-grams. Hubs are drawn from the classes with the smallest share of n-grams of their own, as these are nearest to the
        middle of a group; ``rounds`` bounds such rounds, not the result.
        """
        spark = self.sets.sparkSession
        tested = links = spark.createDataFrame([], "a long, b long")
        posts, labels = self.postings, None
        for r in range(rounds + 1):
            if labels is not None:  # met with the sets, one row each, before these are taken apart again
                posts = self._posted(self.sets.join(labels, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")))
            open_keys = posts.groupBy("key").agg(
                F.min_by(F.struct("rid", "n", "pos", "comp"), F.struct(F.shiftright("apart", 2 * r), F.xxhash64("rid", F.lit(r)))).alias("h"),
                F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"),
            ).filter("lo <> hi")  # n-grams within one component are done with
            posts = stored(posts.select("key", "rid", "n", "pos", "apart", "comp").join(open_keys.select("key", "h", "m"), "key"), "ngram-open")
            left, rows = posts.groupBy("key", "comp").agg(F.count("*").alias("c"), F.first("m").alias("m")).agg(
                F.coalesce(F.sum(F.col("c") * (F.col("m") - F.col("c"))), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
            if not left:
                break
            last = r == rounds or left <= 16 * rows
            if last:
                cand = self._across(posts)
            else:
                flat = posts.select(*(F.col(c).alias(f"x_{c}") for c in ("rid", "n", "pos", "comp")), *(F.col(f"h.{c}").alias(f"h_{c}") for c in ("rid", "n", "pos", "comp")))
                flat = flat.filter((F.col("x_comp") != F.col("h_comp")) & self._able("x_", "h_")).groupBy("x_rid", "h_rid").agg(F.count("*").alias("c"))
                cand = flat.groupBy("x_rid").agg(F.max_by("h_rid", F.struct("c", "h_rid")).alias("h_rid")).select(
                    F.least("x_rid", "h_rid").alias("a"), F.greatest("x_rid", "h_rid").alias("b")).distinct()
            cand = stored(cand.join(tested, ["a", "b"], "left_anti"), "ngram-candidates")
            tested = tested.union(cand)
            links = stored(links.union(self.verify(cand)), "ngram-links")
            labels = stored(connected(links).select(F.col("node").alias("rid"), F.col("root").alias("comp")), "ngram-labels")
            if last:
                break
        return labels if labels is not None else links.select(F.col("a").alias("rid"), F.col("b").alias("comp"))

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) per document: the smallest id reachable over links, itself included.

        One row per distinct (id, set); documents without shingles are their own component.
        """
        reps = self.classes.join(self.components(), "rid", "left").select("sig", F.coalesce("comp", "rid").alias("comp"))
        p = self.profiles.filter("id is not null")
        return p.join(reps, "sig", "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, without those of documents that link to one with a smaller id.

    One document of each group stays, the one with the smallest id. Rows with null id stay.
    """
    found = NgramJoin(docs, id_col, text_col, n, num, den).membership()
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    own = docs.select(F.struct(*docs.columns).alias("doc"))  # in one column, so that no name can clash
    return own.join(gone, F.col("doc")[id_col] == F.col("gone"), "left_anti").select("doc.*")
