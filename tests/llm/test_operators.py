"""The pipeline operators against brute force on small data, and their defined results for odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystead.llm import bytewise as bw
from keystead.llm import digest, html_text, markov, ordinal, pieces, topk_lists, warc
from keystead.llm.components import connected
from keystead.llm.line_runs import LineRuns, drop_repeated_lines
from keystead.llm.mixing import mix, rake
from keystead.llm.ngram_join import NgramJoin, drop_near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS)


def shingle_set(text, n=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 4 * both >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def near_group(seed, members, length=80, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    return [edited(rng, base, rng.randrange(edits + 1)) for _ in range(members)]


def test_ngram_join_equals_brute_force(shipped):
    texts = near_group(1, 60) + near_group(2, 40, 30, 2) + ["a b", "A  b\n", "", None, "one", "é è ç", "é è ç", " \t "]
    texts += [" ".join(f"p{i}" for i in range(40)) + f" q{k} r{k}" for k in range(30)] + near_group(1, 5)
    random.Random(3).shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJoin(docs_of(shipped, texts)).membership().collect()}
    assert got == brute_components(rows)
    pairs = NgramJoin(docs_of(shipped, texts)).pairs().collect()
    sets = {i: shingle_set(t) for i, t in rows}
    low = {}
    for i, s in sorted(sets.items()):
        low.setdefault(s, i)
    reps = sorted(i for s, i in low.items() if s)
    want = {(a, b) for a in reps for b in reps if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)


def test_hub_rounds_lose_no_link(shipped):
    texts = near_group(7, 260, 60, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJoin(docs_of(shipped, texts)).membership().collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_drop_near_copies_keeps_rows_and_columns(shipped):
    df = docs_of(shipped, ["a b c d e f", "A b c d e f", None, ""]).withColumn("keys", F.lit(1)).withColumn("component_id", F.lit("x"))
    df = df.union(shipped.createDataFrame([(None, "a b c d e f", "en", "s", 1, 1, "x")], df.schema))
    got = drop_near_copies(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["0", "2", "3", "None"]


def test_components_of_a_long_chain(shipped):
    e = shipped.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in connected(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_line_runs_levels(shipped):
    runs, want = LineRuns(fanout=2), {}
    for b in range(5):
        rows = [(k, k * 7, 1, 100 - b) for k in range(b, b + 4)]
        for h1, h2, _, i in rows:
            n, top = want.get((h1, h2), (0, i))
            want[h1, h2] = (n + 1, max(top, i))
        runs.add(shipped.createDataFrame(rows, "h1 long, h2 long, docs long, holder long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.h2): (r.docs, r.holder) for r in runs.lines().collect()} == want


def test_line_dedup_odd_rows(shipped):
    long = "this line is long enough to be a key of the index"
    texts = [f"{long}\nown {i}\n  {long.upper()}\t" for i in range(5)] + [None, "", "short\nshort"]
    df = docs_of(shipped, texts).withColumn("h1", F.lit(1)).withColumn("pos", F.lit("p"))
    df = df.union(df.filter("doc_id = 1")).union(df.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    out = drop_repeated_lines(df, dropped_col="gone")
    assert out.columns == [*df.columns, "gone"]
    rows = sorted((str(r.doc_id), r.text, r.gone) for r in out.collect())
    want = [(str(i), f"own {i}", 2) for i in (0, 1, 1, 2, 3)] + [("4", texts[4], 0), ("5", None, 0), ("6", "", 0), ("7", texts[7], 0), ("None", texts[0], 0)]
    assert rows == sorted(want, key=lambda r: (r[0], str(r[1])))


def test_topk_equals_brute_force(shipped):
    rng = np.random.default_rng(0)
    v = rng.integers(-60, 60, (400, 12)).astype(float)
    v[50:80] = v[10]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [None] * 12), (1100, [float("nan")] * 12), (None, v[0].tolist()), (5, v[5].tolist())]
    df = shipped.createDataFrame(rows, "vec_id long, v array<double>").withColumn("vector", topk_lists.quantised("v", 1)).withColumn("id", F.lit(9))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_lists.search(df, F.col("vec_id") % 50 == 0).collect()]
    want = []
    for q in range(0, 400, 50):
        best = sorted(((-int(v[q] @ v[c]), c) for c in range(400) if c != q))[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)
    few = topk_lists.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert topk_lists.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> --><div class="side ad">Buy</div>
<div id="cookie-notice"><p>We use cookies, a lot of cookies, really very many cookies for all of you.</p></div>
<article><h1>A &amp; B</h1><p><b>One&nbsp;two<br>three.</b><p>Caf&eacute;  &#8211;\n x</p><aside>see also</aside><p>End.</p>
<section class="comments"><p>first!</p></section></article><form><input name="q"><p>search</p></form><footer>&copy; us</footer></body></html>"""


def test_html_extraction(shipped):
    want = "A & B\nOne two three.\nCafé – x\nEnd."
    assert html_text.main_text(PAGE) == want
    plain = "<body><div><a href='x'>link</a></div><div>" + "some long text of the page " * 5 + "</div><p>Short.</p></body>"
    assert html_text.main_text(plain) == ("some long text of the page " * 5).strip() + "\nShort."
    assert html_text.main_text("no markup <b>here") == "no markup here" and html_text.main_text("<p></p>") == ""
    rows = shipped.createDataFrame([(1, PAGE), (2, None), (3, ""), (3, "")], "page_id long, html string").select("page_id", html_text.extracted("html").alias("t"))
    assert sorted((r.page_id, r.t) for r in rows.collect()) == [(1, want), (2, ""), (3, ""), (3, "")]


def test_html_on_given_pages(shipped, sf):
    for r in shipped.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html as h

        want = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert html_text.main_text(r.html) == "\n".join(x for x in want if x)


def test_html_without_article_tags(shipped, sf):
    """Density alone finds the text of the given pages: every block, and nothing else."""
    for r in shipped.read.parquet(f"{sf}/pages.parquet").collect():
        bare = re.sub(r"</?article>", lambda m: m[0].replace("article", "div"), r.html)
        assert html_text.main_text(bare) == html_text.main_text(r.html) != ""


BODY = "<p>" + "A sentence of the article, long enough to weigh. " * 4 + "</p>"
SENTENCE = ("A sentence of the article, long enough to weigh. " * 4).strip()


@pytest.mark.parametrize("page, want", [
    (f'<article>{BODY}<p title="a hidden gem">Gem.</p></article>', SENTENCE + "\nGem."),
    (f'<article>{BODY}<p class="share-price">Up.</p><p id="search">Found.</p></article>', SENTENCE + "\nUp.\nFound."),
    (f"<header>Site</header><article><header><h1>Title</h1></header>{BODY}</article>", "Title\n" + SENTENCE),
    (f'<div class="content no-sidebar">{BODY}</div><div class="site-header">x</div><div class="share-buttons">y</div>', SENTENCE),
    (f"<article>Teaser.</article><div>{BODY}{BODY}</div>", SENTENCE + "\n" + SENTENCE),
    (f'<article>{BODY}<p hidden>No.</p><p style="display: none">No.</p><aside>No.</aside><p class="ad">No.</p><p>x</p></article><p>Left out.</p>', SENTENCE + "\nx"),
    ("<p>a &lt; b</p><!-- never ends <p>no</p>", "a < b"),
    ("<p>a</p><!-- no", "a"),
    ("<p>a</p><script>no <b>", "a"),
    ("1 < 2 and <a b", "1 < 2 and <a b"),
])
def test_html_marks_and_edges(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("part", ["<a b", '<a "', "<a '", "<script", "<!-- ", "<div>", "<a b>", "< ", "</p"])
@pytest.mark.parametrize("end", ["", ">"])
def test_html_is_linear(part, end):
    import time

    page = part * (1_000_000 // len(part)) + end
    t = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - t < 8


def brute_levels(data):
    out = []
    for i in range(len(data) - 63):
        _, c = np.unique(np.frombuffer(data[i : i + 64], np.uint8), return_counts=True)
        out.append(int(sum(int(digest._UNIT[x]) for x in c)) * digest.LEVELS // digest._TOP)
    return out


def test_digest_levels_and_likeness(shipped):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abcdefgh  \n") for _ in range(700)) + b"a" * 100
    assert digest.levels(np.frombuffer(data, np.uint8)).tolist() == brute_levels(data)
    texts = [" ".join(f"{rng.choice('bcdfgh')}{rng.random():.6f}" for _ in range(300)) for _ in range(3)]
    texts += [texts[0], "", None, "tiny", "tiny", "z" * 500]
    df = docs_of(shipped, texts).withColumn("pid", F.lit(1)).withColumn("tie", F.lit(1))
    ranks = digest.level_ranks(df)
    got = {r.doc_id: r for r in digest.fingerprints(df, ranks).collect()}
    assert sorted(got) == list(range(9))
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % 9] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[3].fingerprint and got[4].fingerprint == got[5].fingerprint == ""
    assert 0.25 < got[0].near_edited < 0.9 and got[0].near_next < 0.2 and got[6].near_next == 1 and got[4].near_next == 1
    assert digest.fingerprints(df.limit(0), ranks).count() == 0


def test_toxicity_held_out(shipped):
    rng = random.Random(1)
    bad = ["scum", "moron", "Idiot", "trash"]
    rows, labels = [], []
    for i in range(1200):
        w = [f"w{rng.randrange(300)}" for _ in range(60)]
        toxic = i % 6 == 0
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "scum scum"), (0, rows[0][1])]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(1)).withColumn("id", F.lit(1))
    lab = shipped.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = ordinal.fit(docs, lab.filter("doc_id < 800"))
    assert np.all(np.diff(model.cuts) > 0)
    out = docs.select("doc_id", "text", ordinal.severity(model, F.col("text")).alias("s")).collect()
    for r in out:
        words = (r.text or "").lower().split()
        assert (r.s.toxic >= ordinal.REJECT) == any(b.lower() in words for b in bad) and 0 <= r.s.severity <= 3
    kept = ordinal.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {2000, 2001} <= {r.doc_id for r in kept.collect()}
    none = ordinal.fit(docs, lab.filter("toxic = 0"))
    assert not len(none.words) and docs.filter(ordinal.severity(none, F.col("text"))["toxic"] >= ordinal.REJECT).count() == 0
    assert ordinal.drop_toxic(docs.limit(0), lab.limit(0)).count() == 0


def test_raking_meets_marginals():
    rng = np.random.default_rng(2)
    codes = [np.repeat(np.arange(3), 8), np.tile(np.repeat(np.arange(2), 4), 3), np.tile(np.arange(4), 6)]
    cells = rng.integers(1, 1000, 24).astype(float)
    goals = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.1, 0.2, 0.3, 0.4])]
    m = rake(cells, codes, goals)
    for code, goal in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(code, weights=m) / cells.sum(), goal, atol=1e-8)


def test_mix_samples_to_targets(shipped, sf):
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(docs.limit(1).select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "n_chars"))
    docs = docs.withColumn("topic", F.lit(1)).withColumn("tokens", F.lit(2))
    out = mix(docs, share=0.6)
    rows = out.collect()
    assert out.columns == [*docs.columns, "mix"] and len(rows) == docs.count()
    total = sum(r.mix.tokens for r in rows)
    assert abs(sum(r.mix.tokens * r.mix.probability for r in rows) - 0.6 * total) < 1e-6 * total
    assert all(r.mix.kept for r in rows if r.mix.probability >= 1)
    by = {}
    for r in rows:
        by[r.lang or ""] = by.get(r.lang or "", 0) + r.mix.tokens * r.mix.weight
    had = {}
    for r in rows:
        had[r.lang or ""] = had.get(r.lang or "", 0) + r.mix.tokens
    norm = sum(math.sqrt(x) for x in had.values() if x)
    for k, x in by.items():
        assert abs(x / total - math.sqrt(had[k]) / norm) < 1e-3
    assert sorted((r.doc_id, r.mix.kept) for r in out.collect()) == sorted((r.doc_id, r.mix.kept) for r in rows)
    assert mix(docs.limit(0)).count() == 0


def test_secret_spans(shipped):
    key = "q7Zt9XbK2mLw4RvN8cYd1PfH5sJg"
    text = f'a é token = abcde, API_KEY: "abcdef" AKIA{"A1" * 9} {"0af" * 9} see {key} and ordinary_identifier_name_2024 ok'
    df = shipped.createDataFrame([(1, text), (2, None), (3, ""), (4, "ſecret: abcdefgh"), (1, text)], "doc_id long, text string").withColumn("kind", F.lit(1))
    words = shipped.createDataFrame([("ordinary identifier name of words that people use in their programs and other text".replace(" ", "_"),)], "text string")
    model = markov.fit(words.unionAll(words))
    got = sorted((r.doc_id, [(s.kind, text[s.start : s.end]) for s in r.spans]) for r in markov.scan(df, model).collect())
    assert markov.scan(df.limit(0), model).count() == 0 and markov.sampled_words(df.limit(0)) == []
    want = [("assign", 'API_KEY: "abcdef'), ("access", "AKIA" + "A1" * 9), ("hex", "0af" * 9), ("random", key)]
    assert got == [(1, want), (1, want), (2, []), (3, []), (4, [])]


IDENTIFIERS = (
    "getUserAccountById2Handler https_www_example_com_index_2 MyApplicationConfigurationV2 SHA256withRSAEncryption1 ConvolutionalLayer2DTranspose "
    "XMLHttpRequest2Specification abcdefghijklmnopqrstuvwxyz0123456789 internationalization_of_names Donaudampfschifffahrtsgesellschaft "
    "/usr/local/lib/python3/site-packages pneumonoultramicroscopic AbstractSingletonProxyFactoryBean").split()


def test_secret_models_on_held_out_strings(shipped, sf):
    """Precision and recall on other draws, with words of documents that the models did not see."""
    docs = shipped.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    seen, other = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    table, least = markov.fit(seen)
    unseen = sorted(set(markov.sampled_words(other)) - set(markov.sampled_words(seen)))
    assert len(unseen) > 100
    rows = [(t, r) for t, r in markov.samples(unseen, 3_000, seed=99) if markov.judged(t)]
    hit = [(markov.score(t, table) > least, r, any(c.isdigit() for c in t)) for t, r in rows]
    for digits in (True, False):
        found = sum(h and r for h, r, d in hit if d == digits)
        assert found >= 0.9 * sum(r for _, r, d in hit if d == digits)
        assert found >= 0.9 * sum(h for h, _, d in hit if d == digits)
    assert [t for t in IDENTIFIERS if markov.score(t, table) > least] == []


def test_secret_spans_by_plain_scan(shipped, sf):
    """Spans of the registered query against one scan character by character."""
    from keystead.llm import queries

    docs = shipped.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = markov.fit(docs)
    keys = set(markov.ALPHABET)
    got = {r.doc_id: r for r in queries.QUERIES["op7_secret_scan"](shipped, sf).collect()}
    for r in docs.collect():
        text = r.text or ""
        base = [(m.start(), 0, m.end()) for m in markov.ASSIGN.finditer(text) if len(m[1]) >= 6]
        base += [(m.start(), k, m.end()) for k, p in ((1, r"AKIA[A-Z0-9]{16,}"), (2, r"[0-9a-f]{24,}")) for m in re.finditer(p, text)]
        covered = {i for a, _, b in base for i in range(a, b)}
        spans, i = sorted(base), 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in keys:
                j += 1
            if j - i >= 16 and markov.judged(text[i:j]) and covered.isdisjoint(range(i, j)) and markov.score(text[i:j], model[0]) > model[1]:
                spans.append((i, 3, j))
            i = max(j, i + 1)
        name = lambda rows: ",".join(f"{markov.KINDS[k]}:{a}:{b}" for a, k, b in sorted(rows))
        row = got.pop(r.doc_id)
        assert row.spans == name(spans) and row.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
    assert not got


def test_warc_round_trip(shipped, tmp_path):
    big = "é" * 400_000 + "\r\n\r\nWARC/1.1\r\n" + "x" * 300_000
    same = "s" * 1000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, None), (3, "u", ""), (4, "u", same), (5, "u", same), (6, "u", "t"), (7, "u", "t"),
            (8, "u", "\r\n\r\n"), (9, "u", "end\r\n"), (10, "u", "\r\n" * 600), (None, "u", "n"), (5, "u", same)]
    df = shipped.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).withColumn("value", F.lit(1))
    got = warc.archived(df).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == same and i == 4
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.archived(df.limit(0)).count() == 0


def test_sentencepiece_equals_library(shipped, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["", None, " ", "  two  blanks ", "tab\tline\n\nend", "日本語 text 🎉", "a" * 300, "x▁y"]
    texts = [r.text for r in shipped.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()] + odd
    df = docs_of(shipped, texts).withColumn("ids", F.lit(1))
    out = pieces.encode(df)
    back = {r.doc_id: r for r in pieces.decode(out).collect()}
    for i, t in enumerate(texts):
        assert list(back[i].ids) == sp.encode(t or "") and back[i].n_pieces == len(back[i].ids)
        if t is None or "▁" not in t:
            assert back[i].round_trip and back[i].text == (t or "")
    assert pieces.encode(df.limit(0)).count() == 0


def test_unigram_viterbi_is_best():
    v = pieces.Vocabulary(["<unk>", "▁", "a", "b", "ab", "▁a", "aba", "ba"], [0, -2, -3, -3, -2.5, -3.5, -6, -2.6], [False] + [True] * 7, [], 0, False)

    def best(word):
        if not word:
            return 0.0
        return max((v.scores[v.pieces.index(word[:k])] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in v.pieces[1:]), default=-1e9)

    words = sorted({"▁" + "".join(random.Random(i).choices("ab", k=i % 9)) for i in range(60)})
    for w, ids in pieces.Encoder(v).encode(words).items():
        assert "".join(v.pieces[i] for i in ids) == w and abs(sum(v.scores[i] for i in ids) - best(w)) < 1e-9


@pytest.mark.parametrize("text", ["", "one", "A b\tc\x0bd é", "x " * 50])
def test_words(text):
    import pyarrow as pa

    data, at = bw.flat(pa.array([text, None, text]))
    doc, h, begin, end = bw.words(data, at)
    want = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert np.bincount(doc, minlength=3).tolist() == [len(want), 0, len(want)]
    assert [bytes(data[b:e]).decode() for b, e in zip(begin, end, strict=True)] == want * 2 and h[: len(want)].tolist() == h[len(want) :].tolist()
