"""The document operators as named queries over whole tables, with SQL where SQL has the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deedscope.llm import boosted_quality, toxicity
from deedscope.llm.byte_bpe import round_trip
from deedscope.llm.collocations import mine
from deedscope.llm.common import documents, labels
from deedscope.llm.exact_dedup import exact_duplicates
from deedscope.llm.line_dedup import deduplicate_lines
from deedscope.llm.lm_score import score_documents
from deedscope.llm.mixing import mix
from deedscope.llm.ngram_join import near_duplicates
from deedscope.llm.quality_rules import judged_measures
from deedscope.llm.sharding import shuffle_into_shards
from deedscope.llm.token_alignment import score_links
from deedscope.llm.url_filter import filter_pages
from deedscope.workload.tables import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(documents(spark, sf_dir))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed_lines", "text")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE_SQL["op8_mixing"] = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM counts) / (SELECT sum(weight) FROM counts) * weight / n AS rate FROM counts),
means AS (SELECT source, draws, rate / draws AS mean FROM (SELECT *, greatest(1, ceil(rate / 32))::INT AS draws FROM rates)),
terms AS (SELECT source, draws, k, exp(k * ln(mean) - lgamma(k + 1) - mean) AS term FROM means, (SELECT unnest(range(0, 131)) AS k)),
steps AS (SELECT source, draws, list(total ORDER BY k) AS cdf FROM
  (SELECT *, sum(term) OVER (PARTITION BY source ORDER BY k) AS total FROM terms) GROUP BY source, draws),
uniforms AS (SELECT doc_id, draws, cdf, d.source, text, lang, n_chars, list_transform(range(1, draws + 1), lambda j:
  ('0x' || substr(md5('42|count|' || coalesce(doc_id::VARCHAR, '') || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS us
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
drawn AS (SELECT * EXCLUDE (us, cdf, draws), list_sum(list_transform(us, lambda u: len(list_filter(cdf, lambda c: c < u))))::INT AS copies FROM uniforms)
SELECT *, md5('42|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM drawn WHERE copies > 0)
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_measures(documents(spark, sf_dir))


ORACLE_SQL["op9_quality_rules"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
tokens AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS five
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM tokens)
),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, i + unnest([0, 1, 2, 3, 4]) AS p FROM repeated) GROUP BY doc_id
),
lines AS (
  SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
),
measured AS (
  SELECT t.doc_id, len(w) AS n_words,
    length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(body) - length(replace(body, '!', '')) AS n_marks
  FROM tokens t JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
    OR 10 * n_marks > 5 * n_words OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words
    OR 2 * n_dup_lines > n_lines) AS kept
FROM measured
"""


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


ORACLE_SQL["op10_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY norm)
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    first, second = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return score_links(documents(spark, sf_dir), first, second, public_tokenizers.PATTERN)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


ORACLE_SQL["op12_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS size)),
counted AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
parts AS (SELECT lang, phrase, size, f, string_split(phrase, ' ') AS p FROM counted WHERE f >= 100),
cuts AS (SELECT lang, phrase, size, f AS a, p, unnest(range(1, size)) AS k FROM parts WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, c.size, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN totals t ON c.lang = t.lang
  JOIN parts l ON c.lang = l.lang AND l.phrase = array_to_string(c.p[1:k], ' ')
  JOIN parts r ON c.lang = r.lang AND r.phrase = array_to_string(c.p[k + 1:], ' ')
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, p, size, f, unnest(range(2, size)) AS len FROM parts WHERE size > 2),
inside AS (
  SELECT DISTINCT lang, array_to_string(p[i:i + len - 1], ' ') AS phrase, f
  FROM (SELECT *, unnest(range(1, size - len + 2)) AS i FROM spans)
),
kept AS (
  SELECT * FROM weakest w WHERE NOT EXISTS
    (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.f >= 100 * w.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_pages(read(spark, sf_dir, "pages"))


ORACLE_SQL["op13_url_filter"] = r"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
named AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') AS canonical,
    regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)') AS listed,
    CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM parsed
),
judged AS (
  SELECT *, CASE WHEN rule IS NULL AND canonical IN (SELECT canonical FROM named WHERE listed) THEN canonical END AS listed_url
  FROM named
)
SELECT page_id, host, path, rule, listed_url,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed_url IS NOT NULL THEN 'block'
    ELSE 'allow' END AS verdict
FROM judged
"""
