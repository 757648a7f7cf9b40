"""Shared pieces of the comparison SQL (DuckDB dialect) of the registered queries."""

from __future__ import annotations

from tallymark.functions import text as tx
from tallymark.plans.derive import MODEL_KEYS, MODELS


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_MODEL_ROWS = ", ".join(
    f"({k}, {quoted(key)}, {quoted(name)})" for k, (key, name) in enumerate(zip(MODEL_KEYS, MODELS))
)

MODEL_TABLE = f"models(k, model_key, model) AS (VALUES {_MODEL_ROWS})"


def vote_case(at: str) -> str:
    return (
        f"CASE WHEN ({at} * 13 + k) % 23 = 0 THEN 'N/A' "
        f"WHEN ({at} * 31 + k * 17) % (k + 5) = 0 "
        "THEN 'c' || CAST((doc_id % 11 + k + 1) % 11 AS VARCHAR) "
        "ELSE 'c' || CAST(doc_id % 11 AS VARCHAR) END"
    )


PLAIN_VOTES = f"""{MODEL_TABLE},
plain AS (
  SELECT doc_id, k, model_key, model, {vote_case('doc_id')} AS category,
    CAST(((doc_id * 37 + k * 101) % 1000) * (k + 1) AS DOUBLE) / 100 AS duration
  FROM documents CROSS JOIN models)"""

VOTES = f"""{PLAIN_VOTES},
votes AS (
  SELECT doc_id, k, model_key, model,
    CASE WHEN (doc_id + k) % 29 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN 'N/A' ELSE category END AS category,
    duration
  FROM plain)"""

TRUTH = "truths AS (SELECT doc_id, 'c' || CAST(doc_id % 11 AS VARCHAR) AS truth FROM labels)"

LABELLED = f"""{VOTES}, {TRUTH},
lv AS (SELECT t.doc_id, t.truth, v.model, v.category FROM truths t JOIN votes v USING (doc_id)
       WHERE v.category IS NOT NULL)"""

RESAMPLES = f"""{MODEL_TABLE},
resamples AS (
  SELECT doc_id, k, model, sample, {vote_case('(doc_id + sample * (k + 1))')} AS category
  FROM labels CROSS JOIN range(0, 30) r(sample) CROSS JOIN models)"""


def per_class(source: str, by: str = "model") -> str:
    """CTEs ``support`` and ``class_scores`` over a table with truth and category."""
    return f"""support AS (
  SELECT {by}, truth AS c, count(*) AS support, sum(CASE WHEN truth = category THEN 1 ELSE 0 END) AS hits
  FROM {source} GROUP BY ALL),
predicted AS (SELECT {by}, category AS c, count(*) AS predicted FROM {source} GROUP BY ALL),
class_scores AS (
  SELECT s.*, coalesce(p.predicted, 0) AS predicted
  FROM support s LEFT JOIN predicted p USING ({by}, c))"""


SCORES = """avg(CAST(hits AS DOUBLE) / support) AS accuracy,
  sum(support * (2.0 * hits / (support + predicted))) / sum(support) AS f1,
  sum(support * CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / predicted END) / sum(support) AS precision,
  CAST(sum(hits) AS DOUBLE) / sum(support) AS plain_accuracy, count(*) AS classes"""

WIDE = "wide AS (SELECT doc_id, {} FROM votes GROUP BY doc_id)".format(
    ", ".join(f"max(CASE WHEN k = {k} THEN category END) AS m{k}" for k in range(len(MODELS)))
)
_VOTE_LIST = "[" + ", ".join(f"m{k}" for k in range(len(MODELS))) + "]"
_COMPLETE = " AND ".join(f"m{k} IS NOT NULL" for k in range(len(MODELS)))

COMPLETE_WIDE = f"""{WIDE},
seen AS (SELECT *, len(list_distinct({_VOTE_LIST})) = 1 AS unanimous FROM wide WHERE {_COMPLETE}),
seen_votes AS (SELECT doc_id, unanimous, unnest({_VOTE_LIST}) AS category FROM seen),
seen_counts AS (SELECT doc_id, unanimous, category, count(*) AS n FROM seen_votes GROUP BY ALL)"""

ENTROPY = f"""entropies AS (
  SELECT doc_id, round(abs(-sum((n / {len(MODELS)}.0) * ln(n / {len(MODELS)}.0))), 9) AS entropy
  FROM seen_counts WHERE NOT unanimous GROUP BY doc_id)"""


def order_hash(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def bands(seed: int) -> str:
    return f"""placed AS (
  SELECT doc_id, entropy, row_number() OVER (ORDER BY entropy DESC, {order_hash('doc_id', seed)}, doc_id) - 1 AS pos,
    count(*) OVER () AS size FROM entropies),
banded AS (
  SELECT doc_id, entropy, 'low' AS band FROM placed WHERE pos >= size - 75
  UNION ALL SELECT doc_id, entropy, 'high' FROM placed WHERE pos < 150
  UNION ALL SELECT doc_id, entropy, 'middle' FROM placed
    WHERE pos >= greatest(size // 2 - 75, 0) AND pos < size // 2 + 75)"""


def replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, 'g')"


def remove_urls(text: str) -> str:
    return replace(f"coalesce({text}, '')", tx.URL)


def trim_all(text: str) -> str:
    return replace(text, rf"^[{tx.SPACE}]+|[{tx.SPACE}]+\z")


def clean_html(text: str) -> str:
    out = f"coalesce({text}, '')"
    # RE2 never backtracks and knows no possessive repeats; the matches are the same.
    for pattern in (tx.HIDDEN, tx.TAG.replace("*+", "*"), tx.BROKEN_TAG):
        out = replace(out, pattern)
    references = [("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&nbsp;?", " "),
                  ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")]
    for reference, character in references:
        out = replace(out, reference, character)
    out = replace(out, r"[\n\r]+", "\n")
    out = replace(out, rf"^[{tx.BLANK}]+")
    out = replace(out, rf"(?:[{tx.BLANK}]*[{tx.BREAK}]|[{tx.BLANK}]+)\z")
    return replace(out, rf"[{tx.SPACE}]+", " ")


def clean_text(text: str) -> str:
    return clean_html(remove_urls(text))


def count_tokens(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {quoted(tx.WORD)})) AS BIGINT)"


MESSAGES = """messages AS (
  SELECT doc_id, substr(text, 1, 20) AS subject, source AS sender, text AS body,
    CASE WHEN doc_id % 50 = 0 THEN -5364662400 ELSE 1704067200 + doc_id * 3600 END AS seconds
  FROM documents)"""
