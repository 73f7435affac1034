"""Searches, fusion, reranking, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Field
from ..functions.schema import MetadataField, MetadataSchema
from ..functions.text import sigmoid
from ..operators import citations as C
from ..operators import batched, evaluation, grounding, loops, models, search, term_index, vector_index
from ..operators.models import first_sentences_sql
from ..sources import shared
from .registry import query, table

LABEL = MetadataSchema((MetadataField("label", "integer"),))
Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
L2 = f"list_distance(CAST(embedding AS DOUBLE[]), {Q})"
COS = f"1 - list_inner_product(CAST(embedding AS DOUBLE[]), {Q}) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product({Q}, {Q})))"
#: The words that the lexical queries ask for.
WORDS = ["the", "thion", "ering", "heat"]
WORDS_SQL = "['the', 'thion', 'ering', 'heat']"


def first_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (SELECT vec_id, {L2} AS d, row_number() OVER (ORDER BY {L2}, vec_id) AS rank FROM embeddings) WHERE rank <= 10")
def knn_l2_topk(spark, sf_dir):
    rows = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10)
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT vec_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (SELECT vec_id, {COS} AS d, row_number() OVER (ORDER BY {COS}, vec_id) AS rank FROM embeddings WHERE vec_id <> 0) WHERE rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    rows = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, "cosine", F.col("vec_id") != 0)
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT vec_id, label, {L2} AS d, row_number() OVER (ORDER BY {L2}, vec_id) AS rank FROM embeddings WHERE label IN (1, 2, 3)) WHERE rank <= 10")
def knn_filtered(spark, sf_dir):
    rows = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, condition=Field(LABEL, "label").isin([1, 2, 3]).column)
    return rows.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10""")
def knn_batch_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 asks all others."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.search_many(rows, asked, 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT vec_id, label, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (SELECT vec_id, label, {L2} AS d, row_number() OVER (ORDER BY {L2}, vec_id) AS rank FROM embeddings WHERE label <> 4) WHERE rank <= 20")
def knn_indexed_topk(spark, sf_dir):
    """The clustered layout with every cell probed, under a condition: exact."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build(rows, shared.place(spark, "vector-index"))
    found = vector_index.search(spark, index, first_vector(spark, sf_dir), 20, index.cells, Field(LABEL, "label").compare("!=", 4).column)
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"), "rank")


@query()
def knn_indexed_many(spark, sf_dir):
    """Every vector whose id is divisible by 20 asks all others, in as many cells as were learnt to be enough."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search_queries(vector_index.build(rows, shared.place(spark, "vector-index")), asked, 10)


@query(f"SELECT label, vec_id, round(d, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM (SELECT label, vec_id, {L2} AS d, row_number() OVER (PARTITION BY label ORDER BY {L2}, vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def knn_multi_collection_topk(spark, sf_dir):
    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, sf_dir)))
    rows = table(spark, sf_dir, "embeddings").withColumn("distance", search.l2(F.col("embedding"), q))
    return search.top_k(rows, "distance", 5, ["label"], tie="vec_id").select("label", "vec_id", F.round("distance", 6).alias("distance"), "rank")


BM25_SQL = f"""
words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents WHERE text IS NOT NULL),
lens AS (SELECT d.doc_id, CAST(count(w.w) AS DOUBLE) AS dl FROM documents d LEFT JOIN (SELECT * FROM words WHERE w <> '') w ON d.doc_id = w.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id),
tfs AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf FROM words WHERE list_contains({WORDS_SQL}, w) GROUP BY doc_id, w),
dfs AS (SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tfs GROUP BY w),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens),
bm25 AS (
  SELECT t.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM tfs t JOIN dfs ON t.w = dfs.w JOIN lens l ON t.doc_id = l.doc_id CROSS JOIN stats GROUP BY t.doc_id)
"""


@query(f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) WHERE rank <= 100")
def bm25_topk(spark, sf_dir):
    rows = search.bm25(table(spark, sf_dir, "documents"), WORDS).withColumn("key", F.round("score", 9))
    return search.top_k(rows, "key", 100, tie="doc_id", descending=True).select("doc_id", F.round("score", 6).alias("score"), "rank")


#: The BM25 of many requests at once: query_id, w (its distinct words) in `asked`.
BM25_MANY_SQL = """
words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM documents WHERE text IS NOT NULL),
lens AS (SELECT d.doc_id, CAST(count(w.w) AS DOUBLE) AS dl FROM documents d LEFT JOIN (SELECT * FROM words WHERE w <> '') w ON d.doc_id = w.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id),
tfs AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf FROM words WHERE w <> '' GROUP BY doc_id, w),
dfs AS (SELECT w, CAST(count(*) AS DOUBLE) AS df FROM tfs GROUP BY w),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens),
asked AS (SELECT DISTINCT conv_id AS query_id, w FROM (SELECT conv_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS w FROM conversations WHERE turn = 0 AND conv_id % 20 = 0) WHERE w <> ''),
scores AS (
  SELECT query_id, t.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM asked a JOIN tfs t ON a.w = t.w JOIN dfs ON t.w = dfs.w JOIN lens l ON t.doc_id = l.doc_id CROSS JOIN stats GROUP BY query_id, t.doc_id)
"""


def first_turns(spark, sf_dir):
    """Of the conversations whose id is divisible by 20."""
    return table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))


@query(f"""WITH {BM25_MANY_SQL}
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 10""")
def bm25_many(spark, sf_dir):
    """First turns, of every twentieth conversation, ask all documents through an inverted index."""
    index = term_index.build(table(spark, sf_dir, "documents"), shared.place(spark, "term-index"))
    return term_index.bm25_many(index, first_turns(spark, sf_dir), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _lists(spark, sf_dir):
    """The dense and the sparse list (pk, score, rank) of one request, 100 rows each; vector and document share an id."""
    dense = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 100).select(F.col("vec_id").alias("pk"), (-F.col("distance")).alias("score"), "rank")
    rows = search.bm25(table(spark, sf_dir, "documents"), WORDS).withColumn("key", F.round("score", 9))
    sparse = search.top_k(rows, "key", 100, tie="doc_id", descending=True).select(F.col("doc_id").alias("pk"), "score", "rank")
    return dense, sparse


LISTS_SQL = f"""WITH {BM25_SQL},
dense AS (SELECT vec_id AS pk, -d AS score, rank FROM (SELECT vec_id, {L2} AS d, row_number() OVER (ORDER BY {L2}, vec_id) AS rank FROM embeddings) WHERE rank <= 100),
sparse AS (SELECT doc_id AS pk, score, rank FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) WHERE rank <= 100),
"""


@query(LISTS_SQL + """fused AS (SELECT pk, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT pk, rank FROM dense UNION ALL SELECT pk, rank FROM sparse) GROUP BY pk)
SELECT pk, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pk) AS r FROM fused) WHERE r <= 20""")
def hybrid_rrf(spark, sf_dir):
    fused = search.reciprocal_rank_fusion(list(_lists(spark, sf_dir))).withColumn("score", F.round("score", 9))
    return search.top_k(fused, "score", 20, descending=True).select("pk", F.round("score", 6).alias("score"))


@query(LISTS_SQL + """d AS (SELECT pk, (score - lo) / (hi - lo) AS s FROM dense CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM dense)),
s AS (SELECT pk, (score - lo) / (hi - lo) AS s FROM sparse CROSS JOIN (SELECT min(score) AS lo, max(score) AS hi FROM sparse)),
fused AS (SELECT coalesce(d.pk, s.pk) AS pk, round(0.5 * coalesce(d.s, 0) + 0.5 * coalesce(s.s, 0), 9) AS score FROM d FULL JOIN s ON d.pk = s.pk)
SELECT pk, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pk) AS r FROM fused) WHERE r <= 20""")
def hybrid_weighted(spark, sf_dir):
    fused = search.weighted_fusion(*_lists(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return search.top_k(fused, "score", 20, descending=True).select("pk", F.round("score", 6).alias("score"))


@query(LISTS_SQL + """fused AS (SELECT coalesce(d.pk, s.pk) AS pk, round(0.7 * coalesce(d.score, 0) + 0.3 * coalesce(s.score, 0), 9) AS score FROM dense d FULL JOIN sparse s ON d.pk = s.pk)
SELECT pk, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, pk) AS r FROM fused) WHERE r <= 20""")
def hybrid_boosted(spark, sf_dir):
    fused = search.boosted_sum(*_lists(spark, sf_dir), 0.7, 0.3).withColumn("score", F.round("score", 9))
    return search.top_k(fused, "score", 20, descending=True).select("pk", F.round("score", 6).alias("score"))


#: Three collections (labels), each with a condition of its own, in this order.
FAN_OUT = {"7": (">", 100), "2": ("<=", 400), "5": (">", 0)}
FAN_OUT_SQL = " OR ".join(f"label = {k} AND vec_id {op} {n}" for k, (op, n) in FAN_OUT.items())


@query(f"""SELECT {"CASE label " + " ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(FAN_OUT)) + " END"} AS place, CAST(label AS VARCHAR) AS collection_name, vec_id, round(d, 6) AS distance, rank FROM (
  SELECT label, vec_id, {L2} AS d, row_number() OVER (PARTITION BY label ORDER BY {L2}, vec_id) AS rank FROM embeddings WHERE {FAN_OUT_SQL}) WHERE rank <= 4""")
def fan_out_collections(spark, sf_dir):
    """Collections in the order asked for, each under its own filter, a few rows of each."""
    schema = MetadataSchema((MetadataField("vec_id", "integer"),))
    rows = table(spark, sf_dir, "embeddings").withColumn("collection_name", F.col("label").cast("string"))
    q = F.array(*(F.lit(float(x)) for x in first_vector(spark, sf_dir)))
    scored = lambda x: x.select(F.col("vec_id").alias("pk"), "collection_name", search.l2(F.col("embedding"), q).alias("distance"))
    out = search.fan_out(rows, {k: Field(schema, "vec_id").compare(op, n) for k, (op, n) in FAN_OUT.items()}, scored, 4)
    return out.select("place", "collection_name", F.col("pk").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def _words_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


RERANK_SQL = f"""WITH q AS (SELECT conv_id AS query_id, {_words_sql('text')} AS words FROM conversations WHERE turn = 0),
hits AS (SELECT q.query_id, c.turn AS pk, CASE WHEN len(q.words) > 0 THEN 10.0 * len(list_intersect(q.words, {_words_sql("coalesce(c.text, '')")})) / len(q.words) - 5.0 ELSE -5.0 END AS logit
  FROM conversations c JOIN q ON c.conv_id = q.query_id WHERE c.turn > 0),
scored AS (SELECT query_id, pk, round(1 / (1 + exp(-0.1 * logit)), 9) AS s FROM hits WHERE 1 / (1 + exp(-0.1 * logit)) >= 0.4)
SELECT query_id, pk, round(s, 6) AS relevance_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pk) AS rank FROM scored) WHERE rank <= 3"""


@query(RERANK_SQL)
def rerank_pairs(spark, sf_dir):
    """Later turns of a conversation as hits of its first one, scored in pairs."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    hits = rows.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pk"), "text")
    return search.rerank(asked, hits, models.shared_words, 3, 0.4).select("query_id", "pk", F.round("relevance_score", 6).alias("relevance_score"), "rank")


@query(RERANK_SQL)
def rerank_batched(spark, sf_dir):
    """rerank_pairs with a model that takes batches."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    hits = rows.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pk"), "text")
    return batched.rerank(asked, hits, 3, 0.4).select("query_id", "pk", F.round("relevance_score", 6).alias("relevance_score"), "rank")


@query(f"""WITH docs AS (SELECT doc_id, source, doc_id % 5 AS page FROM documents), hit AS (SELECT source, page FROM docs WHERE doc_id = (SELECT vec_id FROM embeddings WHERE vec_id <> 0 ORDER BY {L2}, vec_id LIMIT 1))
SELECT d.doc_id, d.source, d.page FROM docs d JOIN hit h ON d.source = h.source AND d.page = h.page ORDER BY d.doc_id LIMIT 6""")
def page_mates(spark, sf_dir):
    """The best hit's neighbours on its page of its source, as many as the final list holds."""
    hit = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 1, condition=F.col("vec_id") != 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 5).alias("page"))
    page = docs.join(hit.select(F.col("vec_id").alias("doc_id")), "doc_id").select("source", "page").distinct()
    return docs.join(page, ["source", "page"], "left_semi").orderBy("doc_id").limit(6).select("doc_id", "source", "page")


LOGIT_SQL = "10.0 * (" + " + ".join(f"CAST(list_contains(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), '{w}') AS INT)" for w in WORDS) + f") / {len(WORDS)} - 5.0"


@query(f"SELECT doc_id, round(1 / (1 + exp(-0.1 * ({LOGIT_SQL}))), 6) AS relevance_score FROM documents WHERE text IS NOT NULL AND 1 / (1 + exp(-0.1 * ({LOGIT_SQL}))) >= 0.5")
def rerank_sigmoid_threshold(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = search.normalize(docs.select("doc_id", search.lexical_score(WORDS, F.col("text")).alias("score")))
    return search.confident(rows, 0.5).select("doc_id", F.round("relevance_score", 6).alias("relevance_score"))


@query(f"SELECT vec_id, round(1 / (1 + exp(0.1 * d)), 6) AS relevance_score FROM (SELECT vec_id, {L2} AS d, row_number() OVER (ORDER BY {L2}, vec_id) AS r FROM embeddings) WHERE r <= 3")
def normalize_top3(spark, sf_dir):
    rows = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 3)
    return rows.select("vec_id", F.round(sigmoid(-F.col("distance")), 6).alias("relevance_score"))


@query("""SELECT list_no, pk, lang FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY list_no, pk) AS r FROM (
  SELECT CAST(0 AS BIGINT) AS list_no, doc_id AS pk, lang, text AS content FROM documents WHERE lang = 'en'
  UNION ALL SELECT 1, doc_id, lang, text FROM documents)) WHERE r = 1""")
def merge_contexts_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pk"), "lang", F.col("text").alias("content"))
    merged = search.merge_contexts([docs.where("lang = 'en'"), docs])
    return merged.select(F.col("list_no").cast("long").alias("list_no"), "pk", "lang")


@query(f"""WITH hit AS (SELECT doc_id, source FROM documents WHERE doc_id = (SELECT vec_id FROM embeddings WHERE vec_id <> 0 ORDER BY {L2}, vec_id LIMIT 1))
SELECT d.doc_id, d.source FROM documents d JOIN hit h ON d.source = h.source""")
def image_page_mates(spark, sf_dir):
    """The best hit's neighbours: every document of its source."""
    hit = search.search_one(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 1, condition=F.col("vec_id") != 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    page = docs.join(hit.select(F.col("vec_id").alias("doc_id")), "doc_id").select("source")
    return docs.join(page.distinct(), "source", "left_semi")


@query("""WITH ranked AS (
  SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS item, e.label,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank
  FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
total AS (SELECT query_id, count(*) AS n FROM ranked WHERE label = ql GROUP BY query_id),
ks(k) AS (VALUES (1), (3), (5), (10)),
hits AS (SELECT query_id, k, count(*) AS h FROM ranked JOIN ks ON rank <= k WHERE label = ql GROUP BY query_id, k)
SELECT CAST(ks.k AS BIGINT) AS k, round(avg(coalesce(h, 0) * 1.0 / n), 6) AS recall
FROM total CROSS JOIN ks LEFT JOIN hits ON hits.query_id = total.query_id AND hits.k = ks.k GROUP BY ks.k""")
def recall_at_k(spark, sf_dir):
    """Vectors of the query's label are relevant. The hits' labels decide; the relevant are counted by label, not listed."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = search.search_many(rows, asked, 10)
    own = rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    total = rows.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n"))
    marked = hits.join(rows.select("vec_id", "label"), "vec_id").join(own, "query_id").where("label = ql")
    counts = marked.groupBy("query_id").agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in (1, 3, 5, 10)))
    each = asked.select("query_id").join(own, "query_id").join(total, "ql").where("n > 1").join(counts, "query_id", "left")
    means = each.agg(*(F.round(F.avg(F.coalesce(F.col(f"h{k}"), F.lit(0)) / (F.col("n") - 1)), 6).alias(f"r{k}") for k in (1, 3, 5, 10)))
    return means.select(F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"r{k}").alias("recall")) for k in (1, 3, 5, 10)))))


@query(f"""WITH {BM25_SQL}, top AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25),
ks(k) AS (VALUES (1), (3), (5), (10))
SELECT CAST(k AS BIGINT) AS k, round(count(d.doc_id) * 1.0 / (SELECT count(*) FROM documents WHERE lang = 'en'), 9) AS recall
FROM ks JOIN top ON top.rank <= ks.k LEFT JOIN documents d ON d.doc_id = top.doc_id AND d.lang = 'en' GROUP BY k""")
def recall_by_list(spark, sf_dir):
    """Hits are those of BM25, the relevant are all documents in English."""
    docs = table(spark, sf_dir, "documents")
    hits = search.top_k(search.bm25(docs, WORDS).withColumn("key", F.round("score", 9)), "key", 10, tie="doc_id", descending=True).select(F.lit("q").alias("query_id"), F.col("doc_id").alias("item"), "rank")
    relevant = docs.where("lang = 'en'").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("item"))
    return evaluation.recall_at(hits, relevant).select("k", F.round("recall", 9).alias("recall"))


@query(f"""WITH {BM25_SQL},
found AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25) WHERE rank <= 100),
scored AS (SELECT doc_id AS pk, text, 1 / (1 + exp(-0.1 * (10.0 * len(list_intersect(list_distinct(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')), {WORDS_SQL})) / len({WORDS_SQL}) - 5.0))) AS s
  FROM documents JOIN found USING (doc_id)),
best AS (SELECT pk, s, {first_sentences_sql("text")} AS t FROM scored WHERE s >= 0.3 ORDER BY s DESC, pk LIMIT 10)
SELECT string_agg(t, chr(10) ORDER BY s DESC, pk) AS answer, count(*) AS n_citations, string_agg(CAST(pk AS VARCHAR), ',' ORDER BY s DESC, pk) AS document_ids FROM best""")
def rag_answer_extractive(spark, sf_dir):
    """One request from end to end: BM25 candidates, rerank, normalise, threshold, answer with citations."""
    docs = table(spark, sf_dir, "documents")
    found = search.top_k(search.bm25(docs, WORDS).withColumn("key", F.round("score", 9)), "key", 100, tie="doc_id", descending=True)
    texts = docs.select("doc_id", "text").join(found.select("doc_id"), "doc_id")
    ranked = search.normalize(texts.select(F.col("doc_id").alias("pk"), "text", search.lexical_score(WORDS, F.col("text")).alias("score")))
    out = C.answer(search.confident(ranked, 0.3), 10)
    return out.select("answer", "n_citations", F.array_join(F.transform("citations", lambda c: c["document_id"].cast("string")), ",").alias("document_ids"))


@query()
def answer_groundedness(spark, sf_dir):
    """Second turns, of every twentieth conversation, as answers to the first, and the three documents that the first turn finds as their passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = term_index.build(docs, shared.place(spark, "term-index"))
    found = term_index.bm25_many(index, first_turns(spark, sf_dir), 3)
    pairs = found.join(docs, "doc_id").select(F.col("query_id").alias("answer_id"), F.col("doc_id").alias("passage_id"), F.col("text").alias("passage"))
    answers = table(spark, sf_dir, "conversations").where("turn = 1 and conv_id % 20 = 0").select(F.col("conv_id").alias("answer_id"), F.col("text").alias("answer"))
    return grounding.groundedness(grounding.grounding(answers, pairs, 0.3))


@query("""SELECT d.doc_id AS key, CASE WHEN d.doc_id % 3 = 0 THEN p.html ELSE d.text END AS content
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
WHERE d.doc_id % 7 <> 6 AND length(CASE WHEN d.doc_id % 3 = 0 THEN p.html ELSE d.text END) > 0""")
def citation_contents(spark, sf_dir):
    """Documents as hits, of which every third is an image whose page is its payload, and some are of a type that is not shown."""
    kind = F.when(F.col("doc_id") % 7 == 6, "other").when(F.col("doc_id") % 3 == 0, "image").otherwise("text")
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), kind.alias("doc_type"), F.col("text").alias("content"))
    payloads = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("content"))
    return C.citations(hits, payloads).select("key", "content")


FIRST_WORD = "regexp_extract(lower({}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH index AS (SELECT {FIRST_WORD.format('text')} AS word, min(doc_id) AS pk FROM documents WHERE {FIRST_WORD.format('text')} <> '' GROUP BY 1),
docs AS (SELECT word, pk, text AS content FROM index JOIN documents ON pk = doc_id),
q AS (SELECT conv_id AS question_id, text AS question FROM conversations WHERE turn = 0 AND text IS NOT NULL),
split AS (SELECT question_id, question, unnest(list_distinct(list_filter(list_transform(string_split(question, '. '), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS query FROM q),
one AS (SELECT s.question_id, question, pk, content FROM split s JOIN docs ON {FIRST_WORD.format('s.query')} = word),
best AS (SELECT question_id, any_value(question) AS question, arg_min(content, pk) AS found FROM one GROUP BY 1),
two AS (SELECT b.question_id, pk, content FROM (SELECT question_id, regexp_extract(lower(found), '^[^\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]+([\\p{{L}}\\p{{N}}]+)', 1) AS query FROM best) b JOIN docs ON b.query = word),
every AS (SELECT question_id, 0 AS depth, pk, content FROM one UNION ALL SELECT question_id, 1, pk, content FROM two)
SELECT question_id, CAST(min(depth) AS BIGINT) AS depth, CAST(arg_min(pk, depth * 1000000000 + pk) AS BIGINT) AS pk FROM every GROUP BY question_id, content""")
def query_decomposition(spark, sf_dir):
    """First turns as questions, split to sentences; a sentence finds the first document that begins with its first word. The
    second word of the best document is the next query, which finds others."""
    word = lambda x: F.regexp_extract(F.lower(x), r"[\p{L}\p{N}]+", 0)
    docs = table(spark, sf_dir, "documents").select(word(F.col("text")).alias("word"), F.struct(F.col("doc_id").alias("pk"), F.col("text").alias("content")).alias("d"))
    docs = docs.where("word <> ''").groupBy("word").agg(F.min_by("d", "d.pk").alias("d")).select("word", "d.*")
    asked = table(spark, sf_dir, "conversations").where("turn = 0 and text is not null").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"))
    sentences = lambda q: F.array_distinct(F.filter(F.transform(F.split(q, r"\. "), lambda x: F.trim(x)), lambda x: x != ""))
    second = lambda q, c: F.regexp_extract(F.lower(c), r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+[^\p{L}\p{N}]+([\p{L}\p{N}]+)", 1)
    found = loops.decompose(asked, sentences, lambda q: q.withColumn("word", word(F.col("query"))).join(docs, "word").select("question_id", "pk", "content"), second, 2)
    return found.select("question_id", "depth", "pk")
