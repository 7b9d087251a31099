"""Suffix runs, the Merkle manifest and phrase collocations against brute force, and their results for odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from keystead.llm import collocations, manifest, suffix_runs

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- suffix runs ---


def brute_repeats(texts, length=200):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return out


def odd_texts(seed):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdefgh ijé\n\0") for _ in range(n))
    base, texts = [prose(900) for _ in range(3)], []
    for _ in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyzab")
        texts.append("".join(t)[rng.randrange(300) : rng.randrange(400, 1000)])
    common = prose(150)  # a class that many different contexts share, too short to be removed
    texts += [prose(rng.randrange(120)) + common + prose(rng.randrange(160)) for _ in range(60)]
    texts += [None, "", "a" * 5000, "a" * 400, "ab" * 300, "x" * 199, "x" * 200, "x" * 200 + "y", prose(3000) * 3, base[0], base[0]]
    return [*texts, "é" * 150, "é" * 150]


@pytest.mark.parametrize("class_rows", [20_000, 1, 7])
def test_repeated_bytes(shipped, class_rows):
    texts = odd_texts(class_rows)
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5).withColumn("block", F.lit("x"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_runs.drop_repeated_bytes(docs, class_rows=class_rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts])


def test_repeated_bytes_of_long_and_odd_tables(shipped):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij klmno") for _ in range(2_500_000))  # several pieces
    rows = [(None, long), (None, "-" + long[1_048_000:1_049_000]), (7, "short")]
    out = {r.n_bytes: r for r in suffix_runs.drop_repeated_bytes(shipped.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[len(long)].n_removed == 1000 and bytes(out[len(long)].kept).decode() == long[:1_048_000] + long[1_049_000:]
    assert bytes(out[1001].kept) == b"-" and out[5].n_removed == 0
    empty = shipped.createDataFrame([], "doc_id string, text string")
    assert suffix_runs.drop_repeated_bytes(empty).count() == 0
    with pytest.raises(ValueError):
        suffix_runs.drop_repeated_bytes(empty, length=100)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    strings = [sorted({bytes(rng.choice(b"ab") for _ in range(40)) if rng.random() < 0.5 else b"a" * 36 + bytes(rng.choice(b"ab") for _ in range(4))
                       for _ in range(rng.randrange(1, 60))}) for _ in range(k)]
    runs = []
    for s in strings:
        h = [shared(a, b) for a, b in zip([b"~" * 40, *s], s)]
        runs.append((h, [x[n:] for x, n in zip(s, h)]))
    out = list(suffix_runs.merged(runs, 40)) if k else []
    assert [x[3] for x in out] == sorted(x for s in strings for x in s)
    assert [x[2] for x in out[1:]] == [shared(a[3], b[3]) for a, b in zip(out, out[1:])]
    assert all(strings[r][i] == text for r, i, _, text in out)


# --- manifest ---


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level):
    return [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]


def brute_paths(digests):
    """(root, sibling texts of every leaf) of one tree."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = i - i % 3
            paths[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            at[leaf] = i // 3
        level = up(level)
    return level[0], paths


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(shipped, height):
    rng = random.Random(height)
    rows = [(s, i, H(f"{s}{i}")) for s, n in ((None, 1), ("a", 2), ("b", 40), ("é", 100), ("z", 9), ("ab", 82)) for i in rng.sample(range(1000), n)]
    rows += [("z", None, H("null id")), ("z", None, H("null id")), ("z", 5000, H("tie 1")), ("z", 5000, H("tie 0"))]
    rng.shuffle(rows)
    built = manifest.Manifest(shipped.createDataFrame(rows, "grp string, ord long, digest string").repartition(7), height=height)
    groups = collections.defaultdict(list)
    for g, o, d in rows:
        groups[g].append((o is not None, o or 0, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_paths([d for *_, d in sorted(groups[g])]) for g in order]
    root, tops = brute_paths([t[0] for t in trees])
    assert built.root == root
    want = sorted((g, d, sub, "".join(a + b for a, b in path + tops[k])) for k, (g, (sub, paths)) in enumerate(zip(order, trees))
                  for (*_, d), path in zip(sorted(groups[g]), paths) for g in [g or ""])
    out = built.proofs().withColumn("proof", manifest.proof_text(F.col("path"))).withColumn("folded", manifest.folded(F.col("digest"), F.col("path"))).collect()
    assert sorted((r.grp or "", r.digest, r.subroot, r.proof) for r in out) == want
    assert {r.folded for r in out} == {root}
    # the log of a group is its tree in postorder, without gaps
    log = collections.defaultdict(dict)
    for r in built.log().collect():
        assert r.pos not in log[r.gid]
        log[r.gid][r.pos] = (r.level, r.digest)
    for k, g in enumerate(order):
        nodes = [log[k][p] for p in range(len(log[k]))]
        assert [d for level, d in nodes if level == 0] == [d for *_, d in sorted(groups[g])] and nodes[-1][1] == trees[k][0]
        stack = []
        for level, d in nodes:
            below = []
            while level and stack and stack[-1][0] == level - 1 and len(below) < 3:
                below.insert(0, stack.pop()[1])
            assert not level or d == H("".join(below))
            stack.append((level, d))


def test_manifest_of_an_empty_table(shipped):
    built = manifest.Manifest(shipped.createDataFrame([], "grp string, ord long, digest string"))
    assert built.root is None and built.proofs().count() == 0


def test_manifest_query_with_nulls_and_tampering(shipped, tmp_path):
    from keystead.llm.queries import QUERIES

    rows = [(i, None if i % 5 == 0 else "a\nb\n" * (i % 4), None if i % 7 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None if i % 11 == 0 else i) for i in range(60)]
    shipped.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op12_merkle_manifest"](shipped, str(tmp_path)).collect()}
    for i, text, lang, source, n in rows:
        assert out[i].leaf == H("".join(map(field, (i, source, lang, n, text))))
        changed = zlib.crc32(str(i).encode()) % 2 == 0 and text is not None and "\n" in text
        assert out[i].verified == (not changed) and (out[i].folded_root == out[i].root) == (not changed)


# --- collocations ---


def brute_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {(g, p): c for (g, p), c in f.items() if len(p) > 1 and c >= least}
    out = []
    for (g, p), a in cand.items():
        score, _, l, r = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k, f[g, p[:k]], f[g, p[k:]]) for k in range(1, len(p)))
        inside = any(h == g and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (h, q), b in cand.items())
        if not inside:
            out.append((g, -score, -a, " ".join(p).encode(), l, r))
    rank, rows = collections.Counter(), []
    for g, score, a, p, l, r in sorted(out):
        rank[g] += 1
        if rank[g] <= top:
            rows.append((g, rank[g], p.decode(), -a, l, r, n[g], -score))
    return rows


def test_collocations(shipped):
    rng = random.Random(1)
    words = ["The", "the", "cat", "sat", "né", " x", "\0", "Ärger", "on\tmat", "a b c d e"]
    rows = [(rng.choice([" ", "  ", ". ", "\x0b"]).join(rng.choice(words) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("the cat " * 3000, "en"), ("the cat " * 3000, "en"), ("only", "und")]
    docs = shipped.createDataFrame(rows, "text string, lang string").repartition(4).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("kind", F.lit("ids"))
    for least, top in ((3, 2000), (5, 7)):
        out = sorted(map(tuple, collocations.collocations(docs, least=least, top=top).collect()))
        assert out == sorted(brute_phrases(rows, least, top))
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0
