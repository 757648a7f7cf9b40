"""Registered queries of the text operators, one per operator, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import bpe, centroids, collocations, labelled_pages, licenses, mixing, page_text, repetition, revisits, secrets, shingle_join, tensor_minhash, topk, toxicity
from tallymark.llm.tables import read

#: In the order of their numbers.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the word-end vocabulary, decoded again, both as digests."""
    return bpe.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a model of the labelled ones that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@query
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base verdict and final verdict of every document."""
    return repetition.score_documents(read(spark, sf_dir, "documents"))


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 4-word shingle sets at 85 percent."""
    return shingle_join.link_documents(read(spark, sf_dir, "documents"))


# Every pair that shares a shingle, counted; then all that a document reaches.
ORACLE["op4_jaccard"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM w, UNNEST(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id
), least AS (
    SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of a corpus-sized mix half way between the sources' own shares and equal ones."""
    drawn = mixing.draw(read(spark, sf_dir, "documents"))
    return drawn.select("row.doc_id", "row.source", *(c for c in drawn.columns if c != "row"))


@query
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by a model trained on the labelled layouts."""
    return page_text.extract(read(spark, sf_dir, "pages"), page_text.train(labelled_pages.labelled(spark)))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of likely secrets in every document."""
    return secrets.scan_documents(read(spark, sf_dir, "documents"))


@query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors for every 20th one."""
    return topk.search(read(spark, sf_dir, "embeddings"))


# Rows of floor(64 x), each with its sum of products by query; the rank is cut at 20.
ORACLE["op8_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses named in every document."""
    return licenses.scan(read(spark, sf_dir, "documents"))


# Shingles equal to one of a template, counted by the windows they lie in; nothing is hashed.
ORACLE["op9_licenses"] = """
WITH t AS (
    SELECT * FROM (VALUES %s) AS x(template, license, text)
), tw AS (
    SELECT template, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM t
), ts AS (
    SELECT DISTINCT template, license, array_to_string(w[i : i + 4], ' ') AS shingle FROM tw, UNNEST(range(1, len(w) - 3)) AS u(i)
), tm AS (
    SELECT *, count(*) OVER (PARTITION BY template) AS m FROM ts
), dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents
), ds AS (
    SELECT doc_id, i - 1 AS at_word, array_to_string(w[i : i + 4], ' ') AS shingle FROM dw, UNNEST(range(1, len(w) - 3)) AS u(i)
), hit AS (
    SELECT doc_id, template, license, m, shingle, UNNEST([at_word // m, at_word // m - 1]) * m AS start FROM ds JOIN tm USING (shingle)
), held AS (
    SELECT doc_id, template, license, start, count(DISTINCT shingle) / m AS containment
    FROM hit WHERE start >= 0 GROUP BY doc_id, template, license, start, m
)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_min(start, (-containment, start)) AS BIGINT) AS first_word
FROM held WHERE containment >= 0.8 GROUP BY doc_id, license
""" % ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(licenses.TEMPLATES))


@query
def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive records of all pages, revisits resolved; headers in one line, payloads as digests."""
    found = revisits.resolve(revisits.records_of_pages(read(spark, sf_dir, "pages")))
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        "record_id",
        "canonical_url",
        "resolution",
        "response_id",
        F.array_join(pairs, "; ").alias("headers"),
        F.md5("payload").alias("payload_md5"),
        F.length("payload").cast("long").alias("payload_chars"),
    )


# The records again, then an as-of join; the rules on validators and headers case by case.
ORACLE["op10_revisits"] = r"""
WITH p AS (
    SELECT page_id AS n, url, html, md5(coalesce(html, '')) AS tag, 1704067200 + page_id * 60 AS seen_at,
           regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=rss' AS noted
    FROM pages WHERE page_id IS NOT NULL
), r AS (
    SELECT n * 4 AS record_id, url, seen_at, false AS revisit, '"' || tag || '"' AS etag, 'day ' || n AS modified, html AS payload FROM p
    UNION ALL
    SELECT n * 4 + 1, url || '#again', seen_at + 3600 * (n % 5 + 1), true, CASE WHEN n % 7 = 3 THEN '"stale"' ELSE 'W/"' || tag || '"' END, NULL, NULL FROM p
    UNION ALL
    SELECT n * 4 + 2, noted, seen_at + 86400, true, NULL, CASE WHEN n % 3 <> 1 THEN 'day ' || n END, NULL FROM p
    UNION ALL
    SELECT n * 4 + 3, url, seen_at - 3600, true, CASE WHEN n % 7 = 3 THEN '"stale"' ELSE 'W/"' || tag || '"' END, NULL, NULL FROM p WHERE n % 4 = 0
), bare AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM r
), parts AS (
    SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^.*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
           regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|msclkid)(=|$)'))) AS args
    FROM bare
), c AS (
    SELECT *, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS site FROM parts
), latest AS (
    SELECT v.record_id, arg_max(f.record_id, (f.seen_at, f.record_id)) AS response_id
    FROM c v JOIN c f ON v.site = f.site AND v.revisit AND NOT f.revisit AND f.seen_at <= v.seen_at
    GROUP BY v.record_id
), joined AS (
    SELECT c.*, l.response_id AS found, f.etag AS f_etag, f.modified AS f_modified, f.payload AS f_payload
    FROM c LEFT JOIN latest l USING (record_id) LEFT JOIN c f ON f.record_id = l.response_id
), decided AS (
    SELECT *, CASE WHEN NOT revisit THEN 'full' WHEN found IS NULL THEN 'missing'
        WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = f_etag THEN 'etag' ELSE 'mismatch' END
        WHEN modified IS NOT NULL THEN CASE WHEN modified = f_modified THEN 'last-modified' ELSE 'mismatch' END
        ELSE 'unproven' END AS resolution
    FROM joined
)
SELECT record_id, site AS canonical_url, resolution, CASE WHEN revisit THEN found ELSE record_id END AS response_id,
    CASE WHEN NOT revisit THEN 'cache-control: max-age=60; content-type: text/html; etag: ' || etag || '; last-modified: ' || modified
         WHEN resolution = 'etag' THEN 'cache-control: max-age=600; content-type: text/html; etag: ' || etag || '; last-modified: ' || f_modified
         WHEN resolution = 'last-modified' THEN 'cache-control: max-age=60; content-type: text/html; etag: ' || f_etag || '; expires: never; last-modified: ' || modified
         WHEN record_id % 4 = 2 THEN 'expires: never' || coalesce('; last-modified: ' || modified, '')
         ELSE 'cache-control: max-age=600; content-length: 0; etag: ' || etag END AS headers,
    md5(CASE WHEN resolution IN ('etag', 'last-modified') THEN f_payload ELSE payload END) AS payload_md5,
    CAST(length(CASE WHEN resolution IN ('etag', 'last-modified') THEN f_payload ELSE payload END) AS BIGINT) AS payload_chars
FROM decided
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the nearest of 16 centroids after three rounds."""
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    """Assignment to the centroids ``c{n}``, and their floored means as ``c{n + 1}``; an empty one stays."""
    return f"""far{n} AS (
    SELECT v.row, c.cluster, CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM v, c{n} c
), near{n} AS (
    SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM far{n} GROUP BY row
), sums{n} AS (
    SELECT cluster, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (
        SELECT near{n}.cluster, UNNEST(range(1, 65)) AS d, UNNEST(v.q) AS x FROM near{n} JOIN v USING (row)
    ) GROUP BY cluster, d
), means{n} AS (
    SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY d) AS q FROM sums{n} GROUP BY cluster
), c{n + 1} AS (
    SELECT cluster, coalesce(means{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN means{n} USING (cluster)
)"""


# Every vector against every centroid, round by round.
ORACLE["op11_centroids"] = """
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
    SELECT *, row_number() OVER () AS row FROM kept
), c0 AS (
    SELECT row_number() OVER (ORDER BY digest, q) - 1 AS cluster, q
    FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS digest, q FROM v WHERE vec_id IS NOT NULL ORDER BY digest, q LIMIT 16)
), %s
SELECT v.vec_id, CAST(near3.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY near3.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM near3 JOIN v USING (row) JOIN c3 ON c3.cluster = near3.cluster
""" % ", ".join(map(_round_sql, range(4)))


@query
def op12_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document under links of 2-word shingle sets at 80 percent, and whether it stays."""
    return tensor_minhash.link_documents(read(spark, sf_dir, "documents"))


# Every pair that shares a shingle, counted; then all that a document reaches.
ORACLE["op12_near_dedup"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS shingle FROM w, UNNEST(range(1, greatest(len(w) - 1, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT b, root FROM reach JOIN ways ON a = reach.doc_id
), least AS (
    SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.root, d.doc_id) AS component_id, coalesce(least.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of two and three words that hold together most, for each language."""
    return collocations.mine(read(spark, sf_dir, "documents"))


# All contiguous occurrences of up to three words, counted; every cut and every longer phrase looked up.
ORACLE["op13_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, UNNEST(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), p AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
    FROM w, UNNEST([1, 2, 3]) AS s(k), UNNEST(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL
), n AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM p WHERE k = 1 GROUP BY lang
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM p WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, cut, l.f AS l, r.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM c, UNNEST(range(1, c.k)) AS u(cut)
    JOIN p l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
    JOIN p r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')
), lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, a AS f FROM c, UNNEST([1, 2]) AS u(i) WHERE k = 3
    ) GROUP BY lang, phrase
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT c.lang, c.phrase, a, l, r, n, score, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
    FROM c JOIN lowest USING (lang, phrase) JOIN n ON n.lang = c.lang LEFT JOIN around ON c.k = 2 AND around.lang = c.lang AND around.phrase = c.phrase
    WHERE around.f IS NULL OR 100 * around.f < 50 * a
) WHERE rank <= 2000
"""
