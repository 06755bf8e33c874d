"""Nearest neighbours, retrieved context, chunks and polarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from deedscope.operators import retrieval, text
from deedscope.plans.lineage import cut_lineage
from deedscope.workload.registry import query
from deedscope.workload.tables import read, rounded

@query(
    "knn_l2_top3",
    """WITH vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT query_id, doc_id, round(distance, 6) AS distance, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id, power(list_distance(q.v, d.v), 2) AS distance
        FROM vecs q CROSS JOIN vecs d)) WHERE rank <= 3""",
)
def knn_l2_top3(spark, sf):
    vectors = read(spark, sf, "embeddings")
    found = retrieval.nearest(
        vectors, vectors, doc_id="vec_id", doc_vector="embedding", query_id="vec_id", query_vector="embedding"
    )
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


def _label_centres(spark, sf):
    """One query per label: the mean of its vectors."""
    elements = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = elements.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("e"))
    return centres.select(
        "label", F.transform("e", lambda s: s["x"]).alias("centre"),
        F.concat(F.lit("What is said about topic "), F.col("label"), F.lit("?")).alias("question"),
    )


@query(
    "retrieve_context",
    """WITH vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
      docs AS (SELECT doc_id, text, v FROM documents JOIN vecs ON doc_id = vec_id),
      elements AS (SELECT label, i, avg(v[i]) AS x FROM vecs, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
      centres AS (SELECT label, list(x ORDER BY i) AS v FROM elements GROUP BY label),
      ranked AS (SELECT label, doc_id, text, row_number() OVER (PARTITION BY label ORDER BY distance, doc_id) AS rank
        FROM (SELECT q.label, d.doc_id, d.text, list_distance(q.v, d.v) AS distance FROM centres q CROSS JOIN docs d))
    SELECT label AS query_id, count(*)::INT AS num_documents,
      string_agg(text, ' ' ORDER BY rank) || ' What is said about topic ' || label || '?' AS context
    FROM ranked WHERE rank <= 3 GROUP BY label""",
)
def retrieve_context(spark, sf):
    documents = read(spark, sf, "documents")
    vectors = read(spark, sf, "embeddings")
    known = vectors.join(documents.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi")
    queries = _label_centres(spark, sf)
    found = retrieval.nearest(
        known, queries, doc_id="vec_id", doc_vector="embedding", query_id="label", query_vector="centre"
    )
    return retrieval.retrieve_context(
        found, documents, queries, doc_id="doc_id", doc_text="text", query_id="label", query_text="question"
    )


@query(
    "chunk_words",
    """WITH tokens AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words FROM documents),
      numbered AS (SELECT doc_id, words, unnest(range((len(words) + 511) // 512)) AS chunk_no FROM tokens)
    SELECT doc_id, chunk_no::INT AS chunk_no, array_to_string(words[chunk_no * 512 + 1 : chunk_no * 512 + 512], ' ') AS chunk FROM numbered""",
)
def chunk_words(spark, sf):
    return text.split_documents(read(spark, sf, "documents"), key="doc_id", text="text")


# Function words of the four languages of the texts with made-up weights, because
# invented prose holds no review words.
WEIGHTS = {"the": 0.5, "of": -0.25, "to": 1.0, "was": -1.0, "le": 0.5, "la": 0.25, "der": -0.5, "und": 0.75, "que": -0.75, "el": 1.0}

_WEIGHTS_SQL = "(VALUES " + ", ".join(f"('{w}', {x}::DOUBLE)" for w, x in WEIGHTS.items()) + ") l(word, weight)"


def _polarity_sql(keys: str, table: str) -> str:
    return f"""SELECT {keys}, coalesce(round(list_sum(s) / nullif(len(s), 0), 6), 0.0) AS polarity FROM (
      SELECT {keys}, list_filter(list_transform(string_split_regex(lower(text), '[^\\p{{L}}]+'),
        lambda w: map({list(WEIGHTS)}, {list(WEIGHTS.values())}::DOUBLE[])[w]), lambda x: x IS NOT NULL) AS s FROM {table})"""


@query("polarity_turns", _polarity_sql("conv_id, turn", "conversations"))
def polarity_turns(spark, sf):
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", F.round(text.polarity("text", WEIGHTS), 6).alias("polarity")
    )


@query("polarity_documents", _polarity_sql("doc_id", "documents"))
def polarity_documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.round(text.polarity("text", WEIGHTS), 6).alias("polarity"))


# Function words that play negations and intensifiers, for the same reason.
CHANGES = {"a": 1.5, "and": -0.5, "de": 0.5, "en": -0.5, "in": 1.25, "les": 2.0}


@query(
    "polarity_modified",
    f"""WITH tokens AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents),
      places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens),
      changed AS (SELECT doc_id, i, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, map({list(WEIGHTS)}, {list(WEIGHTS.values())}::DOUBLE[])[w[i]]
          * coalesce(map({list(CHANGES)}, {list(CHANGES.values())}::DOUBLE[])[CASE WHEN i > 2 THEN w[i - 2] END], 1)
          * coalesce(map({list(CHANGES)}, {list(CHANGES.values())}::DOUBLE[])[CASE WHEN i > 1 THEN w[i - 1] END], 1))) AS weight
        FROM places WHERE list_contains({list(WEIGHTS)}, w[i])),
      means AS (SELECT doc_id, avg(weight) AS p FROM changed GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN round(coalesce(p, 0) + 1e-7, 5) + 0.0 END AS polarity FROM documents LEFT JOIN means USING (doc_id)""",
)
def polarity_modified(spark, sf):
    scored = text.polarity_modified("text", WEIGHTS, CHANGES)
    return read(spark, sf, "documents").select("doc_id", (F.round(scored + 1e-7, 5) + 0.0).alias("polarity"))


@query(
    "polarity_lexicon",
    """WITH counted AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents) GROUP BY word),
      lexicon AS (SELECT word, (docs % 21 - 10) / 10.0::DOUBLE AS weight FROM counted WHERE word <> '' AND docs >= 3),
      tokens AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS word FROM documents),
      scored AS (SELECT doc_id, avg(weight) AS p FROM tokens JOIN lexicon USING (word) GROUP BY doc_id)
    SELECT doc_id, round(coalesce(p, 0.0) + 1e-6, 4) + 0.0 AS polarity FROM documents LEFT JOIN scored USING (doc_id)""",
)
def polarity_lexicon(spark, sf):
    """Texts scored with a lexicon of thousands of words, taken from the documents themselves."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    seen = text.texts_with_word(docs, keys=["doc_id"], text="text").withColumnRenamed("texts", "docs").filter("docs >= 3")
    lexicon = seen.select("word", ((F.col("docs") % 21 - 10) / 10).alias("weight"), "docs")
    # Counted before it is joined: kept once.
    scored = text.polarity_join(docs, cut_lineage(lexicon), keys=["doc_id"], text="text", frequency="docs")
    return scored.select("doc_id", (rounded("polarity", 4) + 0.0).alias("polarity"))
