"""Phrase collocations by set-oriented mining over persisted occurrence relations.

Texts are cut into blocks of one language. A block's relation R_k holds, sorted by place, where each frequent phrase of k
words begins; a place counts words and jumps at a piece border, so that neighbouring places lie in one piece. R_k is
merge-joined with R_1 on the adjacent place; the joined phrases are counted per block and then over all blocks, and the
occurrences whose phrase is frequent (a semi-join by the phrase numbers that come back to the block) become R_k+1, which
is extended next. Relations are written between the steps. What moves to be counted is one row per block and bucket of
phrases, so a very common phrase costs one entry per block. Phrases are kept by exact number pairs, not by hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewise import mix, release
from .tables import work_dir

BLOCK_BYTES = 6 << 20
#: Bytes of text whose distinct phrases one counting group holds.
BUCKET_BYTES = 16 << 20
ROWS = "kind string, block long, bucket int, lang string, n long, a binary, b binary, c binary, d binary, e binary"
FOUND = "kind string, block long, bucket int, lang string, word string, id long, prefix long, next long, f long, a binary"
#: Upper case to lower case, piece separators to line feed, tab to space.
CHARACTERS = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def packed(raw) -> bytes:
    raw = np.ascontiguousarray(raw).tobytes() if isinstance(raw, np.ndarray) else raw
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(b: bytes, kind=None):
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)
    return raw if kind is None else np.frombuffer(raw, kind)


def _gaps(at: np.ndarray) -> bytes:
    return packed(np.diff(at, prepend=np.uint32(0)).astype(np.uint32))


def _places(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b, np.uint32), dtype=np.int64)


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema})


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _first(buckets: int):
    """Blocks of texts: their relation R_1 over all words, and the distinct words with counts by bucket."""
    schema = _schema(ROWS)

    def block(number: int, lang: str, texts: list[bytes]):
        known = _Numbers({b"": 0, b"\n": 1})
        tokens = b"\n".join(texts).translate(CHARACTERS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        del tokens
        ids = ids[ids > 0]
        word = ids > 1
        # every piece border takes a place of its own
        at, ids = np.flatnonzero(word), ids[word] - 2
        words = list(known)[2:]
        seed = zlib.crc32(lang.encode() + b"\0")
        bucket = np.fromiter((zlib.crc32(w, seed) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        counts = np.bincount(ids, minlength=len(words)).astype(np.uint32)[order]
        rows = [{"kind": "state", "block": number, "lang": lang, "n": len(ids), "a": _gaps(at), "b": packed(rank[ids])}]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)):
            i, j = edges[k], edges[k + 1]
            mine = b"\n".join(words[o] for o in order[i:j].tolist())
            rows.append({"kind": "count", "block": number, "bucket": int(k), "lang": lang, "n": int(j - i), "a": packed(mine), "b": packed(counts[i:j])})
        return _table(rows, schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                lang, text = lang.as_py(), text.as_py()
                if not text:
                    continue
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= BLOCK_BYTES or sum(sizes.values()) >= 4 * BLOCK_BYTES:
                    full = max(sizes, key=sizes.get)
                    del sizes[full]
                    yield from block(number, full, held.pop(full)).to_batches()
                    number += 1
                    release()
        for lang, texts in held.items():
            yield from block(number, lang, texts).to_batches()
            number += 1
        release()

    return run


def _count_words(least: int):
    """Sums of one bucket of words; numbers of the frequent ones go back to the blocks (0: not frequent)."""
    schema = _schema(FOUND)

    def run(t: pa.Table) -> pa.Table:
        total: dict[str, dict[bytes, int]] = {}
        rows = t.select(["block", "lang", "a", "b"]).to_pylist()
        for r in rows:
            own = total.setdefault(r["lang"], {})
            for w, c in zip(unpacked(r["a"]).split(b"\n"), unpacked(r["b"], np.uint32).tolist(), strict=True):
                own[w] = own.get(w, 0) + c
        bucket = t.column("bucket")[0].as_py()
        number = (bucket << 32) + 1
        out, ids = [], {}
        for lang in sorted(total):
            ids[lang] = {}
            for w in sorted(w for w, c in total[lang].items() if c >= least):
                ids[lang][w] = number
                out.append({"kind": "frequent", "bucket": bucket, "lang": lang, "word": w.decode(), "id": number, "f": total[lang][w]})
                number += 1
        for r in rows:
            get = ids[r["lang"]].get
            back = np.array([get(w, 0) for w in unpacked(r["a"]).split(b"\n")], np.int64)
            out.append({"kind": "ids", "block": r["block"], "bucket": bucket, "a": packed(back)})
        del total, ids
        release()
        return _table(out, schema)

    return run


def _count_pairs(least: int):
    """Sums of one bucket of (prefix, next word), as ``_count_words``."""
    schema = _schema(FOUND)

    def run(t: pa.Table) -> pa.Table:
        blocks = t.column("block").to_pylist()
        parts = [[unpacked(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("a", np.int64), ("c", np.int64), ("b", np.uint32))]
        sizes = [len(x) for x in parts[0]]
        prefix, last, count = (np.concatenate(x) for x in parts)
        del parts
        order = np.lexsort((last, prefix))
        p, q = prefix[order], last[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        group = np.cumsum(new) - 1
        f = np.bincount(group, weights=count[order]).astype(np.int64)  # exact below 2 ** 53
        bucket = t.column("bucket")[0].as_py()
        ids = np.zeros(len(f), np.int64)
        good = np.flatnonzero(f >= least)
        ids[good] = (bucket << 32) + 1 + np.arange(len(good))
        back = np.empty(len(p), np.int64)
        back[order] = ids[group]
        starts = np.flatnonzero(new)[good]
        m = len(good)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        rows = [{"kind": "ids", "block": b, "bucket": bucket, "a": packed(back[i:j])} for b, i, j in zip(blocks, edges[:-1], edges[1:], strict=True)]
        found = pa.table({
            "kind": pa.array(["frequent"] * m, pa.string()), "bucket": pa.array([bucket] * m, pa.int32()), "id": pa.array(ids[good]),
            "prefix": pa.array(p[starts]), "next": pa.array(q[starts]), "f": pa.array(f[good]),
        })
        found = pa.table({x.name: found.column(x.name) if x.name in found.column_names else pa.nulls(m, x.type) for x in schema})
        release()
        return pa.concat_tables([found, _table(rows, schema)])

    return run


def _extend(k: int, buckets: int, last: bool):
    """Semi-join of a block's R_k with its frequent phrases, merge-join with R_1, counts of the longer phrases by bucket."""
    schema = _schema(ROWS)

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows or not found.num_rows:
            return schema.empty_table()
        s = state.to_pylist()[0]
        ids = np.concatenate([unpacked(x, np.int64) for x in found.sort_by("bucket").column("a").to_pylist()])
        at, item = _places(s["a"]), unpacked(s["b"], np.uint32)
        keep = ids[item] > 0
        at, item = at[keep], item[keep]
        if k == 1:
            at1, item1, ids1 = at, item, ids
        else:
            at1, item1, ids1 = _places(s["c"]), unpacked(s["d"], np.uint32), unpacked(s["e"], np.int64)
        if not len(at1) or not len(at):
            return schema.empty_table()
        to = np.minimum(np.searchsorted(at1, at + k), len(at1) - 1)
        hit = at1[to] == at + k
        at, pair = at[hit], (item[hit].astype(np.uint64) << np.uint64(32)) | item1[to[hit]]
        if not len(at):
            return schema.empty_table()
        pairs, of, count = np.unique(pair, return_inverse=True, return_counts=True)
        first, second = ids[(pairs >> np.uint64(32)).astype(np.int64)], ids1[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        bucket = (mix(mix(first.astype(np.uint64)) + second.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, second, count = first[order], second[order], count[order].astype(np.uint32)
        rows = []
        if not last:
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            near = np.isin(at1, at + (k + 1), assume_unique=True)  # words that can come next
            rows.append({
                "kind": "state", "block": s["block"], "lang": s["lang"], "a": _gaps(at), "b": packed(rank[of]),
                "c": _gaps(at1[near]), "d": packed(item1[near]), "e": packed(ids1)})
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for x in np.flatnonzero(np.diff(edges)):
            i, j = edges[x], edges[x + 1]
            rows.append({"kind": "count", "block": s["block"], "bucket": int(x), "lang": s["lang"], "n": int(j - i),
                         "a": packed(first[i:j]), "b": packed(count[i:j]), "c": packed(second[i:j])})
        release()
        return _table(rows, schema)

    return run


def _kept(df: DataFrame, label: str) -> tuple[DataFrame, ...]:
    """Writes rows of two kinds to folders of their own and reads them back: (state or frequent, count or ids)."""
    spark, path, schema = df.sparkSession, work_dir(df.sparkSession, label), df.schema
    df.write.partitionBy("kind").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return tuple(back.filter(F.col("kind").isin(*names)).drop("kind") for names in (("state", "frequent"), ("count", "ids")))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, len, f) of all phrases of up to ``longest`` words that occur ``least`` times, (lang, n) words in all).

    Null text is empty, null language is ``und``; every row counts, also repeated ones; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    state, counts = _kept(rows.mapInArrow(_first(buckets), ROWS), "phrases-1")
    sizes = state.groupBy("lang").agg(F.sum("n").alias("n"))
    names = out = None
    for k in range(1, longest + 1):
        merge = _count_words(least) if k == 1 else _count_pairs(least)
        found, back = _kept(counts.groupBy("bucket").applyInArrow(merge, FOUND), f"phrases-frequent-{k}")
        if k == 1:
            level = names = found.select("id", "lang", F.col("word").alias("phrase"), "f")
        else:
            word = names.select(F.col("id").alias("w_id"), F.col("phrase").alias("w"))
            level = (
                found.select("id", "prefix", "next", "f").join(word, F.col("next") == F.col("w_id"))
                .join(level.select(F.col("id").alias("p_id"), "lang", F.col("phrase").alias("p")), F.col("prefix") == F.col("p_id"))
                .select("id", "lang", F.concat_ws(" ", "p", "w").alias("phrase"), "f"))
        here = level.select("lang", "phrase", F.lit(k).alias("len"), "f")
        out = here if out is None else out.unionByName(here)
        if k < longest:
            step = state.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_extend(k, buckets, k + 1 == longest), ROWS)
            state, counts = _kept(step, f"phrases-{k + 1}")
    return out, sizes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, scale: int = 2_000_000,
                 covered: tuple[int, int] = (100, 80), top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases by the score of their weakest cut: (lang, rank, phrase, a, l, r, n, score).

    Phrases that lie in a longer frequent phrase with at least 80 % of their count are left out. Ties go to the larger
    count, then to the phrase in byte order. An empty table, or one without text, gives no rows; null text is empty, null
    language ``und``, repeated rows count each; other columns are not read. Very long texts are blocks of their own.
    """
    phrases, sizes = frequent_phrases(docs, text_col, lang_col, longest, least)
    path = work_dir(docs.sparkSession, "phrases")
    phrases.write.parquet(path)
    known = docs.sparkSession.read.parquet(path)
    part = lambda name, count: known.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(name), F.col("f").alias(count))
    long = known.filter("len >= 2").withColumn("words", F.split("phrase", " "))
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("len") - F.col("k")).alias("rest"))
    cuts = cuts.join(part("head_of", "l"), (F.col("lang") == F.col("head_of_lang")) & (F.col("head") == F.col("head_of")))
    cuts = cuts.join(part("rest_of", "r"), (F.col("lang") == F.col("rest_of_lang")) & (F.col("rest") == F.col("rest_of")))
    # decimals: the product may pass 64 bits
    score = F.expr(f"cast(a as decimal(19, 0)) * cast({scale} as decimal(10, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = long.filter("len >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("len") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("size") + 1)))
    inner = inner.select(F.col("lang").alias("in_lang"), joined(F.col("start"), F.col("size")).alias("inside"), "f")
    inner = inner.groupBy("in_lang", "inside").agg(F.max("f").alias("outer_f"))
    whole, share = covered
    own = weakest.join(inner, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("inside")), "left")
    own = own.filter(F.col("outer_f").isNull() | (F.lit(whole) * F.col("outer_f") < F.lit(share) * F.col("a")))
    own = own.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    own = own.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's phrases are first ranked in parts
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = sizes.select(F.col("lang").alias("n_lang"), "n")
    return own.join(sizes, F.col("lang") == F.col("n_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
