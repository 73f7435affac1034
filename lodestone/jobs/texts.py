"""Chunks, pages, conversations, summaries and telemetry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, chat, citations, elements, loops, metrics, pages, summarize
from ..operators.chunking import UNIT, chunk, chunk_sql, page_groups
from ..operators.chunking import chunk_by_tokens as token_chunks
from ..operators.models import first_sentences_sql
from .registry import query, table

WORDS_SQL = "len(list_filter(string_split_regex({}, '[ \\t\\r\\n\\f]+'), lambda w: w <> ''))"


@query(chunk_sql(256, 40))
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk(docs, 256, 40)


@query(f"SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum({WORDS_SQL.format('text')}) AS BIGINT) AS n_words FROM documents GROUP BY 1")
def chunk_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(T.n_words(F.col("text"))).alias("n_words"))


@query(f"SELECT CAST(floor(sum({WORDS_SQL.format('text')}) / count(*)) AS BIGINT) AS words_per_chunk FROM documents")
def avg_words_per_chunk(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").agg((F.sum(T.n_words(F.col("text"))) / F.count("*")).alias("x"))
    return rows.select(F.floor("x").alias("words_per_chunk"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 2 = 0")
def page_filter_even(spark, sf_dir):
    return catalog.page_filter(table(spark, sf_dir, "lineitem"), "even", ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) m ON l.l_orderkey = m.l_orderkey
WHERE l_linenumber BETWEEN 1 AND least(2, n) OR l_linenumber BETWEEN greatest(1, n - 1) AND greatest(1, n)""")
def page_filter_ranges(spark, sf_dir):
    return catalog.page_filter(table(spark, sf_dir, "lineitem"), [[1, 2], [-2, -1]], ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT page_id, CAST(floor((page_id - 1) / 16.0) AS BIGINT) AS part_no FROM pages")
def page_parts(spark, sf_dir):
    return page_groups(table(spark, sf_dir, "pages"), 16, "page_id").select("page_id", "part_no")


def _replaced(x: str) -> str:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{sign}')"
    return x


BARE = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, trim(regexp_replace({_replaced(BARE)}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS text FROM pages")
def html_extract_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS first FROM documents)
SELECT doc_id, trim(CASE doc_id % 4 WHEN 3 THEN text WHEN 1 THEN first ELSE substr(text, length(first) + 1) END, ' ') AS text FROM d""")
def think_strip(spark, sf_dir):
    """Documents as a model's output, whose first line is a thought, stands before an open one, is a thought without its start, or
    is no thought."""
    first, n = F.substring_index("text", "\n", 1), F.col("doc_id") % 4
    rest = F.substr(F.col("text"), F.length(first) + 1)
    tagged = lambda before, after: F.concat(F.lit(before), first, F.lit(after), rest)
    marked = F.when(n == 0, tagged("<think>", "</think>")).when(n == 1, tagged("", "<think>")).when(n == 2, tagged("", "</think>")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.think_strip(marked).alias("text"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def conversation_last_n(spark, sf_dir):
    return chat.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, string_agg(coalesce(text, ''), '. ' ORDER BY turn) AS query FROM conversations WHERE role = 'user' GROUP BY 1")
def multiturn_concat(spark, sf_dir):
    return chat.concatenated(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1")
def format_history(spark, sf_dir):
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query("""WITH kept AS (SELECT * FROM conversations WHERE NOT (role = 'assistant' AND trim(coalesce(text, ''), ' ') = '')),
last AS (SELECT conv_id, max(turn) AS t, arg_max(text, turn) AS q FROM kept WHERE role = 'user' GROUP BY 1)
SELECT k.conv_id, replace(replace(any_value(q), '{', '{{'), '}', '}}') AS query, count(*) FILTER (WHERE turn < t) AS n_history FROM kept k JOIN last l ON k.conv_id = l.conv_id GROUP BY 1""")
def message_filter(spark, sf_dir):
    return chat.asked(table(spark, sf_dir, "conversations"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS ordinal, trim(regexp_replace(line, '^[ \\t\\n\\r\\f\\v]*[0-9]+\\.[ \\t\\n\\r\\f\\v]*', ''), ' ') AS query FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i FROM (
    SELECT doc_id, CASE WHEN place % 2 = 1 THEN CAST(place AS VARCHAR) || '. ' ELSE '' END || line AS line, place FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)) WHERE regexp_matches(line, '[0-9]'))""")
def sub_queries(spark, sf_dir):
    """Documents as a model's lists, whose odd lines are numbered."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat((i + 1).cast("string"), F.lit(". "), x)).otherwise(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_join(numbered, "\n").alias("text"))
    return chat.sub_queries(rows, "doc_id", "text")


@query("SELECT doc_id, CAST(CASE WHEN contains(text, '2') THEN 2 WHEN contains(text, '1') THEN 1 WHEN contains(text, '0') THEN 0 END AS BIGINT) AS score FROM documents")
def reflection_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_score(F.col("text")).cast("long").alias("score"))


@query("""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next, lead(text) OVER w AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, string_agg('Question: ' || coalesce(text, '') || chr(10) || 'Answer: ' || coalesce(answer, ''), chr(10) || chr(10) || chr(10) ORDER BY turn) AS history FROM p WHERE role = 'user' AND next = 'assistant' GROUP BY 1""")
def question_answer_history(spark, sf_dir):
    return chat.question_answers(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, string_agg(coalesce(text, ''), '. ' ORDER BY turn) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n <= 2 GROUP BY 1""")
def last_turn_query(spark, sf_dir):
    return chat.with_last_turn(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE coalesce(text, '') || CASE WHEN turn % 3 = 1 THEN ' ' || role ELSE '' END END AS text, turn % 3 > 0 AS has_image FROM conversations""")
def multimodal_messages(spark, sf_dir):
    """Turns as messages of one text, of an image between two texts, and of an image alone."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    text, image = part("text", F.col("text")), part("image_url", F.lit(None).cast("string"))
    n = F.col("turn") % 3
    parts = F.when(n == 0, F.array(text)).when(n == 1, F.array(text, image, part("text", F.col("role")))).otherwise(F.array(image))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.message_text(parts).alias("text"), chat.has_images(parts).alias("has_image"))


@query("""SELECT conv_id, turn, CASE WHEN trim(replace(replace(trim(coalesce(text, ''), ' '), chr(39), ''), '"', ''), ' ') <> '' THEN trim(replace(replace(trim(text, ' '), chr(39), ''), '"', ''), ' ') END AS query FROM conversations""")
def follow_up_questions(spark, sf_dir):
    """Turns in quotes, as models write their next question."""
    quoted = F.concat(F.lit(" '"), F.col("text"), F.lit("\" "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.follow_up(quoted).alias("query"))


@query("""SELECT conv_id, string_agg(CASE WHEN role = '' THEN '' ELSE 'File: ' || role || '-' || CAST(turn AS VARCHAR) || chr(10) END || 'Content: ' || text, chr(10) || chr(10) ORDER BY turn) AS context
FROM conversations WHERE turn % 4 < 2 AND length(text) > 0 GROUP BY 1""")
def shown_contexts(spark, sf_dir):
    """Turns as passages of files, of which some are images and structured elements."""
    kind = F.when(F.col("turn") % 4 == 2, "image").when(F.col("turn") % 4 == 3, "structured").when(F.col("turn") % 4 == 1, "text")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("doc_type"), F.col("text").alias("content"), F.concat(F.lit("/in/"), "role", F.lit("-"), F.col("turn").cast("string"), F.lit(".txt")).alias("document_name"))
    return chat.shown_context(rows, ["conv_id"], "turn")


@query(f"SELECT role, CAST(sum({WORDS_SQL.format('text')}) AS BIGINT) AS tokens, round(quantile_cont(CAST({WORDS_SQL.format('text')} AS DOUBLE), 0.5), 6) AS median_tokens FROM conversations GROUP BY 1")
def token_usage(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("role", T.n_words(F.col("text")).alias("n"))
    out = metrics.summary(rows, "n", ["role"], {"median_tokens": 0.5}, tokens=F.sum("n"))
    return out.select("role", "tokens", F.round("median_tokens", 6).alias("median_tokens"))


def _buckets_sql(value: str, by: str, table: str) -> str:
    low, high = [None, *metrics.BOUNDS], [*metrics.BOUNDS, None]
    each = " UNION ALL ".join(f"SELECT {by}, CAST({'NULL' if hi is None else hi} AS DOUBLE) AS upper, count(*) FILTER (WHERE {'TRUE' if lo is None else f'v > {lo}'} AND {'TRUE' if hi is None else f'v <= {hi}'}) AS count FROM m GROUP BY 1" for lo, hi in zip(low, high))
    return f"WITH m AS (SELECT {by}, CAST({value} AS DOUBLE) AS v FROM {table} WHERE {value} IS NOT NULL) SELECT * FROM ({each})"


@query(_buckets_sql(WORDS_SQL.format("text"), "role", "conversations"))
def token_histogram(spark, sf_dir):
    """Tokens of a turn by role, in fixed buckets."""
    rows = table(spark, sf_dir, "conversations").select("role", T.n_words(F.col("text")).alias("n"))
    return metrics.buckets(metrics.histogram(rows, "n", ["role"])).select("role", "upper", "count")


@query(_buckets_sql("value", "event_type", "events"))
def latency_buckets(spark, sf_dir):
    """Histograms of each day, merged to one of each kind of event."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = metrics.histogram(rows, "value", ["event_type", "day"])
    return metrics.buckets(metrics.merged(days, ["event_type"])).select("event_type", "upper", "count")


@query("SELECT event_type AS endpoint, user_id % 4 AS method, count(*) AS n FROM events GROUP BY 1, 2")
def api_request_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), (F.col("user_id") % 4).alias("method"))
    return rows.groupBy("endpoint", "method").agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, max(value) AS slowest FROM events GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    out = metrics.summary(rows, "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}, mean=F.avg("value"), slowest=F.max("value"))
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean")), "slowest")


STATUS = {"signup": "PENDING", "view": "IN_PROGRESS", "click": "IN_PROGRESS", "purchase": "SUCCESS", "error": "FAILED"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


def status_log(events):
    names = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return events.select(F.col("user_id").alias("task"), "ts", names[F.col("event_type")].alias("status"))


@query(f"""WITH log AS (SELECT user_id AS task, ts, {STATUS_SQL} AS status FROM events),
last AS (SELECT task, arg_max(status, ts) AS status, max(ts) AS t, min(ts) FILTER (WHERE status = 'IN_PROGRESS') AS started_at FROM log GROUP BY 1)
SELECT task, status, started_at, CASE WHEN status IN ('SUCCESS', 'FAILED') THEN t END AS completed_at FROM last""")
def ingest_status_latest(spark, sf_dir):
    return catalog.latest_status(status_log(table(spark, sf_dir, "events")), "task", "ts", "status", "IN_PROGRESS", ("SUCCESS", "FAILED"))


@query(f"""WITH log AS (SELECT user_id AS task, ts, {STATUS_SQL} AS status FROM events), last AS (SELECT task, arg_max(status, ts) AS s FROM log GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE s = 'SUCCESS') AS successful, count(*) FILTER (WHERE s = 'FAILED') AS failed, count(*) FILTER (WHERE s IN ('SUCCESS', 'FAILED')) AS completed FROM last""")
def summary_stats(spark, sf_dir):
    rows = ingest_status_latest(spark, sf_dir)
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("completed_at").isNotNull()).alias("completed"))


@query("""SELECT l_orderkey, l_linenumber, sum(units) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 60 AS fits
FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2)""")
def image_budget(spark, sf_dir):
    """Lines of an order as images: those within the first 60 units fit the budget. An order's lines are few."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("units"))
    return rows.select("l_orderkey", "l_linenumber", (F.sum("units").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) <= 60).alias("fits"))


@query(f"""SELECT doc_id, head, CAST(length(head) AS BIGINT) AS n FROM (
  SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '{UNIT}')) > 9000 THEN substr(text, 1, 36000) ELSE text END AS head FROM documents)""")
def summary_single_pass(spark, sf_dir):
    """Each document, cut if it has more tokens than a context of 9000; the generator returns its input."""
    rows = summarize.single_pass(table(spark, sf_dir, "documents").select("doc_id", "text"), 9000, lambda p, n: p)
    return rows.select("doc_id", F.col("summary").alias("head"), F.length("summary").cast("long").alias("n"))


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM ({chunk_sql(256, 40)})),
fold AS (
  SELECT doc_id, chunk_no, {first_sentences_sql("chunk")} AS summary FROM c WHERE chunk_no = 0
  UNION ALL
  SELECT doc_id, chunk_no, {first_sentences_sql("prompt")} FROM (
    SELECT c.doc_id, c.chunk_no, concat_ws(' ', nullif(f.summary, ''), c.chunk) AS prompt FROM fold f JOIN c ON c.doc_id = f.doc_id AND c.chunk_no = f.chunk_no + 1))
SELECT doc_id, arg_max(summary, chunk_no) AS summary FROM fold GROUP BY doc_id""")
def summary_iterative(spark, sf_dir):
    return summarize.iterative(chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), 256, 40), "doc_id")


@query()
def summary_hierarchical_levels(spark, sf_dir):
    return summarize.hierarchical(chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), 256, 40), "doc_id", 800)


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def assemble_documents(spark, sf_dir):
    """Turns as the pages of a conversation, put together in order."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return summarize.assemble(rows, ["conv_id"], "turn", "text")


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM conversations)
SELECT a.conv_id, round(CASE WHEN a.text IS NULL OR b.text IS NULL THEN NULL WHEN greatest(length(a.text), length(b.text)) = 0 THEN 1 ELSE 1 - levenshtein(a.text, b.text) * 1.0 / greatest(length(a.text), length(b.text)) END, 6) AS ratio
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 2""")
def page_similarity(spark, sf_dir):
    """How alike the first turn of a conversation and the third one are, whole texts, signs beyond ASCII alike; null where one is null."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    both = rows.where("turn = 0").join(rows.where("turn = 2").select("conv_id", F.col("text").alias("other")), "conv_id")
    return both.select("conv_id", F.round(loops.similarity_ratio(F.col("text"), F.col("other")), 6).alias("ratio"))


@query()
def page_similarity_whole(spark, sf_dir):
    """How alike the first turn of a conversation and the third one are, whole texts of any length and sign; null where one is null."""
    rows = table(spark, sf_dir, "conversations")
    both = rows.where("turn = 0").select("conv_id", "text").join(rows.where("turn = 2").select("conv_id", F.col("text").alias("other")), "conv_id")
    return both.select("conv_id", F.round(loops.similarity_ratio(F.col("text"), F.col("other")), 6).alias("ratio"))


@query()
def chunk_by_tokens(spark, sf_dir):
    """Documents in chunks of 512 tokens of a byte-level tokenizer, 150 of them shared with the chunk before."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_chunks(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query()
def html_elements(spark, sf_dir):
    """Blocks of text, tables, images and links of all pages."""
    return elements.elements(table(spark, sf_dir, "pages"))


@query("""WITH t AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(h, '<a [^>]*href=')) AS BIGINT) AS links, CAST(len(regexp_extract_all(h, '<img ')) AS BIGINT) AS images, CAST(len(regexp_extract_all(h, '<table')) AS BIGINT) AS tables FROM t""")
def html_element_counts(spark, sf_dir):
    """Elements of each kind by page."""
    rows = table(spark, sf_dir, "pages").select("page_id").join(elements.elements(table(spark, sf_dir, "pages")), "page_id", "left")
    return rows.groupBy("page_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("link", "image", "table")))


@query()
def ground_truth_pages(spark, sf_dir):
    """Passages of the benchmark on the pages of their documents: every document is a page, as it holds passages."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return pages.best_pages(passages, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query("""SELECT d.source || '/' || CAST(d.doc_id AS VARCHAR) AS name, CASE WHEN l.toxic = 1 THEN 'FAILED' WHEN d.doc_id % 2 = 0 THEN 'SUCCESS' ELSE 'NOT_FOUND' END AS status,
  CASE WHEN coalesce(l.toxic, 0) <> 1 AND d.doc_id % 2 = 0 THEN d.text END AS summary
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def summary_lookup(spark, sf_dir):
    """Documents with a toxic label failed, of the others every second one is its own summary, which is stored."""
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    status = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("name", F.when(F.col("toxic") == 1, "FAILED").otherwise("SUCCESS").alias("status"))
    stored = docs.where("doc_id % 2 = 0").select("name", F.col("text").alias("summary"))
    return loops.summary_lookup(docs.select("name"), status, stored)


@query("""WITH d AS (SELECT doc_id, CASE WHEN contains(text, '2') THEN 2 WHEN contains(text, '1') THEN 1 ELSE 0 END AS s, lang, text FROM documents)
SELECT doc_id, CASE WHEN s >= 1 OR lang = 'de' THEN s WHEN lang = 'fr' THEN 0 ELSE 2 END AS score, CAST(CASE WHEN s >= 1 THEN 0 WHEN lang = 'de' THEN 1 WHEN lang = 'fr' THEN 3 ELSE 1 END AS BIGINT) AS tries, s >= 1 OR lang NOT IN ('de', 'fr') AS grounded FROM d""")
def reflection_loop(spark, sf_dir):
    """Documents as answers, scored by the first of 2, 1 and 0 they hold and tried again while the score is low: with a 2 behind
    them, or, in French, unchanged; German ones are out of context and stay."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question"), F.col("text").alias("answer"))
    score = lambda q, a: F.coalesce(T.first_score(a), F.lit(0))
    again = lambda q, a: F.when(q == "de", loops.OUT_OF_CONTEXT).when(q == "fr", a).otherwise(F.concat(F.coalesce(a, F.lit("")), F.lit(" 2")))
    return loops.reflect(rows, score, again).select("doc_id", "score", "tries", "grounded")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'I''m sorry, I can''t respond to that.' ELSE text END AS answer, CASE WHEN turn % 2 = 1 THEN 0 ELSE 2 END AS n_citations FROM conversations""")
def refused_answers(spark, sf_dir):
    """Every second turn as an answer that a guard refuses."""
    text = F.when(F.col("turn") % 2 == 1, citations.REFUSAL).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("answer"), F.array("conv_id", "turn").alias("citations"))
    return citations.without_refused(rows).select("conv_id", "turn", "answer", F.size("citations").alias("n_citations"))
