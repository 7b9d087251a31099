"""The registered queries of the pipeline operators, with the SQL each must equal where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, digest, html_text, manifest, markov, ordinal, pieces, suffix_runs, topk_lists, warc
from .line_runs import drop_repeated_lines
from .mixing import mix
from .ngram_join import NgramJoin
from .tables import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w
), one AS (
  SELECT min(doc_id) AS rid, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)
), flat AS (
  SELECT rid, len(s) AS n, unnest(s) AS g FROM one
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM flat a JOIN flat b ON a.g = b.g AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT rid AS node, rid AS root FROM one
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), comp AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id
FROM sets s LEFT JOIN one o ON o.s = list_sort(s.s) LEFT JOIN comp c ON c.node = o.rid
"""


@query("op2_ngram_jaccard_join", NGRAM_SQL)
def ngram_jaccard_join(spark, sf_dir):
    return NgramJoin(read(spark, sf_dir, "documents", "doc_id", "text")).membership()


LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, i, line, {ASCII_LOWER.format("regexp_replace(line, '^[ \\t-\\r]+|[ \\t-\\r]+$', '', 'g')")} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), rep AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (rep.k IS NOT NULL AND holder <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (rep.k IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN rep ON l.k = rep.k GROUP BY doc_id
"""


@query("op10_line_dedup", LINES_SQL)
def line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long"))
    out = drop_repeated_lines(docs, dropped_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_toxicity")
def toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = ordinal.fit(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    s = docs.select("doc_id", ordinal.severity(model, F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.severity"), F.col("s.toxic").alias("p_toxic"), (F.col("s.toxic") >= ordinal.REJECT).alias("rejected"))


@query("op6_source_mixing")
def source_mixing(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", "mix.*")


@query("op9_sentencepiece")
def sentencepiece(spark, sf_dir):
    return pieces.encode(read(spark, sf_dir, "documents", "doc_id", "text"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op1_topk_search", TOPK_SQL)
def topk_search(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings", "vec_id", topk_lists.quantised(F.col("embedding")).alias("vector"))
    return topk_lists.search(v, F.col("vec_id") % 50 == 0)


@query("op7_secret_scan")
def secret_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    out = markov.scan(docs, markov.fit(docs)).drop("text")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in ("assign", "access", "hex", "random")), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op3_html_extraction")
def html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return pages.select("page_id", "url", html_text.extracted("html").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_document_fingerprints")
def document_fingerprints(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return digest.fingerprints(docs, digest.level_ranks(docs))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS kept FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to FROM d
"""


@query("op8_warc", WARC_SQL)
def warc_archives(spark, sf_dir):
    return warc.archived(read(spark, sf_dir, "pages", "page_id", "url", "html"))


MANIFEST_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS v,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, replace(text, chr(10), '')] AS t FROM documents
), bits AS (
  SELECT doc_id, list_reduce([4294967295::BIGINT] || list_transform(split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c:
    list_reduce([xor(a, c)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384::BIGINT * (r & 1)))) AS crc FROM d
), leaves AS (
  SELECT d.doc_id, source, sha256(list_reduce(list_transform(v, lambda s: coalesce(strlen(s)::VARCHAR || ':' || s, '-')), lambda a, b: a || b)) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(list_reduce(list_transform(t, lambda s: coalesce(strlen(s)::VARCHAR || ':' || s, '-')), lambda a, b: a || b)) END AS bad
  FROM d LEFT JOIN bits ON bits.doc_id = d.doc_id
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), nodes AS (
  SELECT 0 AS level, g, i, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT level, g, i, digest, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT level + 1 AS level, g, i // 3 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM nodes WHERE n > 1 GROUP BY level, g, i // 3)
), subroots AS (SELECT g, digest AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, g AS i, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level, i, digest, count(*) OVER () AS n FROM (
    SELECT level + 1 AS level, i // 3 AS i, sha256(string_agg(digest, '' ORDER BY i)) AS digest FROM tops WHERE n > 1 GROUP BY level, i // 3)
), runs AS (
  SELECT level, g, i // 3 AS run, list(digest ORDER BY i) AS ds FROM nodes WHERE n > 1 GROUP BY level, g, i // 3
), topruns AS (
  SELECT level, i // 3 AS run, list(digest ORDER BY i) AS ds FROM tops WHERE n > 1 GROUP BY level, i // 3
), walk AS (
  SELECT doc_id, leaf, g, i, 0 AS level, '' AS proof, coalesce(bad, leaf) AS folded FROM placed
  UNION ALL
  SELECT doc_id, leaf, w.g, w.i // 3, w.level + 1, proof || array_to_string(ds[: w.i % 3] || ds[w.i % 3 + 2 :], ''),
    sha256(array_to_string(ds[: w.i % 3] || [folded] || ds[w.i % 3 + 2 :], ''))
  FROM walk w JOIN runs r ON r.level = w.level AND r.g = w.g AND r.run = w.i // 3
), low AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) = 1),
up AS (
  SELECT doc_id, leaf, g, g AS i, 0 AS level, proof, folded FROM low
  UNION ALL
  SELECT doc_id, leaf, w.g, w.i // 3, w.level + 1, proof || array_to_string(ds[: w.i % 3] || ds[w.i % 3 + 2 :], ''),
    sha256(array_to_string(ds[: w.i % 3] || [folded] || ds[w.i % 3 + 2 :], ''))
  FROM up w JOIN topruns r ON r.level = w.level AND r.run = w.i // 3
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level DESC) = 1) u
JOIN subroots USING (g) CROSS JOIN (SELECT digest AS root FROM tops WHERE n = 1)
"""


@query("op12_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = manifest.leaf_digest(*fields[:-1], F.translate("text", "\n", ""))
    rows = docs.select(
        F.col("source").alias("grp"), F.col("doc_id").alias("ord"), manifest.leaf_digest(*fields).alias("digest"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, tampered).alias("tampered"))
    built = manifest.Manifest(rows, ("tampered",))
    out = built.proofs().withColumn("root", F.lit(built.root).cast("string"))
    out = out.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "digest"), F.col("path")))
    return out.select(
        F.col("ord").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(manifest.proof_text(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


COLLOCATION_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array({ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30
), cand AS (SELECT lang, phrase, f AS a, k AS size, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.size, x.k, l.f AS l, r.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) x JOIN cand c USING (lang, phrase)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[: x.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[x.k + 1 :], ' ')
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS outer_f
  FROM (SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM cand WHERE size >= 3)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM weakest JOIN sizes USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE outer_f IS NULL OR 100 * outer_f < 80 * a
QUALIFY rank <= 2000
"""


@query("op13_phrase_collocations", COLLOCATION_SQL)
def phrase_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents", "lang", "text"))


@query("op11_suffix_dedup")
def suffix_dedup(spark, sf_dir):
    out = suffix_runs.drop_repeated_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
