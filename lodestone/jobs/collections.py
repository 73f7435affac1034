"""Catalogue, ingestion checks and mutations. Sources of documents stand for collections, documents for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schema import MetadataField, MetadataSchema
from ..operators import catalog
from ..sources import files as S
from .registry import query, table


def chunks(spark, sf_dir):
    """Lines of orders as chunks: an order is a document of its customer's nation's collection."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = lines.join(orders, "o_orderkey").join(customers, "o_custkey")
    return rows.select("pk", F.col("c_nationkey").cast("string").alias("collection_name"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"), "l_quantity", "l_returnflag")


CHUNKS = """chunks AS (SELECT l_orderkey * 10 + l_linenumber AS pk, CAST(c_nationkey AS VARCHAR) AS collection_name, 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS document_name, l_quantity, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {CHUNKS}, firsts AS (SELECT collection_name, document_name, min(pk) AS pk, max(l_quantity) AS q FROM chunks GROUP BY 1, 2),
info AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS document_name, o_totalprice FROM orders WHERE o_orderstatus = 'F')
SELECT f.collection_name, f.document_name, i.o_totalprice AS total, (SELECT 1) IS NOT NULL AS listed FROM firsts f LEFT JOIN info i ON f.document_name = i.document_name""")
def list_documents(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("pk", "collection_name", "document_name")
    info = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"), F.col("o_totalprice").alias("total"))
    return catalog.documents_of(rows).join(info, "document_name", "left").select("collection_name", "document_name", "total", F.lit(True).alias("listed"))


@query(f"""WITH {CHUNKS} SELECT c.collection_name, count(*) AS num_entities, n.n_name AS description, n.n_regionkey IN (0, 1) AS active
FROM chunks c LEFT JOIN nation n ON CAST(n.n_nationkey AS VARCHAR) = c.collection_name GROUP BY 1, 3, 4""")
def list_collections(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("collection_name"), F.col("n_name").alias("description"), F.col("n_regionkey").isin(0, 1).alias("active"))
    return catalog.list_collections(chunks(spark, sf_dir), nations.select("collection_name", "description"), nations.select("collection_name", "active"))


def elements(spark, sf_dir):
    """Pages and documents as extracted elements of their collections."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection_name"), F.lit("text").alias("document_type"), F.lit(None).cast("string").alias("subtype"), F.col("text").alias("content"), F.col("doc_id").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("collection_name"), F.lit("structured").alias("document_type"), F.when(F.col("page_id") % 2 == 0, "chart").alias("subtype"), F.col("html").alias("content"), F.col("page_id").alias("n"))
    return docs.unionByName(pages)


ELEMENTS = """elements AS (SELECT source AS collection_name, 'text' AS doc_type, text AS content FROM documents
  UNION ALL SELECT 'pages', CASE WHEN page_id % 2 = 0 THEN 'chart' ELSE 'table' END, html FROM pages)"""


@query(f"WITH {ELEMENTS} SELECT collection_name, doc_type, count(*) AS n, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS text_chars FROM elements GROUP BY 1, 2")
def document_type_counts(spark, sf_dir):
    return catalog.type_counts(elements(spark, sf_dir), ["collection_name"])


@query(f"""WITH {CHUNKS} SELECT collection_name, CAST(sum(l_quantity) AS BIGINT) AS n_units, count(*) AS n_chunks, bool_or(l_returnflag = 'R') AS has_returns,
  right(max(printf('%012d', pk) || l_returnflag), 1) AS last_flag FROM chunks GROUP BY 1""")
def document_info_agg(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("pk", "collection_name", F.col("l_quantity").alias("n_units"), F.lit(1).alias("n_chunks"), (F.col("l_returnflag") == "R").alias("has_returns"), F.col("l_returnflag").alias("last_flag"))
    return catalog.merge_info(rows, ["collection_name"], ["n_units", "n_chunks"], ["has_returns"], ["last_flag"], "pk")


def _info(rows):
    """A row for each document: its numbers, its chunks by flag, and a flag."""
    per = rows.groupBy("collection_name", "document_name", F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"), F.max("pk").alias("pk"))
    docs = per.groupBy("collection_name", "document_name").agg(F.sum("n").alias("n_chunks"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by_flag"), F.max("pk").alias("seq"), F.bool_or(F.col("k") == "R").alias("has_returns"))
    return docs.withColumn("last_document", F.col("document_name"))


def _shown(info):
    entries = F.transform(F.array_sort(F.map_entries("by_flag")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return info.withColumn("by_flag", F.array_join(entries, ","))


@query(f"""WITH {CHUNKS}, kinds AS (SELECT collection_name, string_agg(l_returnflag || '=' || CAST(n AS VARCHAR), ',' ORDER BY l_returnflag) AS by_flag FROM (SELECT collection_name, l_returnflag, count(*) AS n FROM chunks GROUP BY 1, 2) GROUP BY 1)
SELECT c.collection_name, count(*) AS n_chunks, any_value(k.by_flag) AS by_flag, bool_or(l_returnflag = 'R') AS has_returns, arg_max(document_name, pk) AS last_document
FROM chunks c JOIN kinds k ON c.collection_name = k.collection_name GROUP BY 1""")
def document_info_nested(spark, sf_dir):
    """Documents' information merged to their collections': numbers and maps added, flags joined, other values the last."""
    info = _info(chunks(spark, sf_dir)).drop("document_name")
    return _shown(catalog.merge_nested(info, ["collection_name"], "seq"))


@query(f"""WITH {CHUNKS}, merged AS (SELECT collection_name, document_name IN (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' FROM orders WHERE o_orderstatus = 'P') AS new, * EXCLUDE (collection_name) FROM chunks),
kinds AS (SELECT collection_name, string_agg(l_returnflag || '=' || CAST(n AS VARCHAR), ',' ORDER BY l_returnflag) AS by_flag FROM (SELECT collection_name, l_returnflag, count(*) AS n FROM chunks GROUP BY 1, 2) GROUP BY 1)
SELECT m.collection_name, count(*) AS n_chunks, any_value(k.by_flag) AS by_flag, bool_or(l_returnflag = 'R') AS has_returns, CASE WHEN bool_or(new) THEN 'new' ELSE 'stored' END AS note
FROM merged m JOIN kinds k ON m.collection_name = k.collection_name GROUP BY 1""")
def document_info_upsert(spark, sf_dir):
    """Pending orders are new documents, whose information is merged into that of the stored ones."""
    rows = chunks(spark, sf_dir)
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"))
    part = lambda how, note: catalog.merge_nested(_info(rows.join(pending, "document_name", how)).drop("document_name", "last_document"), ["collection_name"], "seq").withColumn("note", F.lit(note))
    return _shown(catalog.upsert_info(part("left_anti", "stored"), part("left_semi", "new"), ["collection_name"]))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN 'table ' || url WHEN 4 THEN 'caption ' || url WHEN 5 THEN 'transcript ' || url END AS text FROM pages""")
def element_texts(spark, sf_dir):
    """Pages as elements of six kinds: text, table, chart, another structured one, image, audio; charts are not wanted."""
    n, url = F.col("page_id") % 6, F.col("url")
    kind = F.when(n == 0, "text").when(n.between(1, 3), "structured").when(n == 4, "image").otherwise("audio")
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("document_type"), F.when(n == 1, "table").when(n == 2, "chart").when(n == 3, "other").alias("subtype"), F.col("html").alias("content"), F.concat(F.lit("table "), url).alias("table_content"), F.concat(F.lit("caption "), url).alias("caption"), F.concat(F.lit("transcript "), url).alias("transcript"))
    return rows.select("page_id", catalog.element_text(rows, charts=False).alias("text"))


@query("""WITH files AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name FROM documents WHERE source <> 'src3'),
meta AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS name, quality, toxic FROM labels)
SELECT name AS document_name, 'not among the files' AS error FROM meta WHERE name NOT IN (SELECT name FROM files)
UNION ALL SELECT name, 'quality: not a valid boolean' FROM meta WHERE quality = 0 AND toxic = 0 AND name IN (SELECT name FROM files)
UNION ALL SELECT name, 'toxic: missing' FROM meta WHERE toxic = 1 AND name IN (SELECT name FROM files)
UNION ALL SELECT name, 'no metadata, required: toxic' FROM files WHERE name NOT IN (SELECT name FROM meta)""")
def metadata_check(spark, sf_dir):
    """Labels as the metadata of documents, with some values that no boolean has and some that are missing."""
    files = table(spark, sf_dir, "documents").where("source <> 'src3'").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    quality = F.when((F.col("quality") == 0) & (F.col("toxic") == 0), "perhaps").otherwise("on")
    raw = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), quality.alias("quality"), F.when(F.col("toxic") == 0, "0").alias("toxic"))
    schema = MetadataSchema((MetadataField("quality", "boolean"), MetadataField("toxic", "integer", required=True)))
    return catalog.metadata_check(files, raw, schema)


@query("""WITH s AS (SELECT user_id AS task_id, CAST(ts AS DATE) - DATE '1970-01-01' AS batch_no, CASE event_type WHEN 'view' THEN 'extracted' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events),
per AS (SELECT task_id, batch_no, count(*) FILTER (WHERE status = 'completed') AS d, count(*) FILTER (WHERE status IN ('completed', 'extracted')) AS x, count(*) FILTER (WHERE status = 'extracted') AS o FROM s GROUP BY 1, 2)
SELECT task_id, CAST(batch_no AS BIGINT) AS batch_no, CAST(sum(d) OVER w AS BIGINT) AS documents_completed, CAST(sum(CASE WHEN o = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS batches_completed, CAST(sum(x) OVER w AS BIGINT) AS extraction_completed FROM per WINDOW w AS (PARTITION BY task_id ORDER BY batch_no)""")
def ingestion_progress(spark, sf_dir):
    """Events as files: a user's are a task, those of a day a batch of it; views are under way, so batches without any are complete."""
    status = F.when(F.col("event_type") == "view", "extracted").when(F.col("event_type") == "error", "failed").otherwise("completed")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.unix_date(F.to_date("ts")).cast("long").alias("batch_no"), status.alias("status"))
    return catalog.progress(rows)


@query("""SELECT p_partkey, p_brand AS brand, p_size AS size, CASE WHEN p_size > 25 THEN p_brand END AS users_brand FROM part""")
def declared_fields(spark, sf_dir):
    """Of a listing's metadata what the schema declares, and of that what its users have defined."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("hidden"))
    schema = MetadataSchema((MetadataField("brand"), MetadataField("size", "integer", user_defined=False), MetadataField("absent")))
    out = rows.select("p_partkey", catalog.declared(rows, schema).alias("all"), catalog.declared(rows, schema, users=True).alias("users"))
    return out.select("p_partkey", "all.*", F.when(F.col("all.size") > 25, F.col("users.brand")).alias("users_brand"))


EXT = "CASE WHEN doc_id % 11 = 0 THEN '.rtf' ELSE '.txt' END"


def _files(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 11 == 0, ".rtf").otherwise(".txt")
    return table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), ext).alias("document_name"), "doc_id")


@query(f"""SELECT CAST(d.doc_id AS VARCHAR) || {EXT.replace('doc_id', 'd.doc_id')} AS document_name,
  CASE WHEN d.doc_id % 11 = 0 THEN 'unsupported file type: rtf' WHEN l.doc_id IS NOT NULL THEN 'document already exists' END AS reason
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def existing_docs_antijoin(spark, sf_dir):
    """Documents submitted as files, of which those with a label are stored already."""
    stored = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"))
    return catalog.submitted(_files(spark, sf_dir), stored, S.ALLOWED).select("document_name", "reason")


@query(f"SELECT CAST(doc_id AS VARCHAR) || {EXT} AS document_name FROM documents WHERE doc_id % 11 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels)")
def failed_docs(spark, sf_dir):
    stored = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"))
    return catalog.failed(_files(spark, sf_dir), stored).select("document_name")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src3')")
def orphan_metadata(spark, sf_dir):
    """Labels of documents that were not submitted."""
    docs = table(spark, sf_dir, "documents").where("source <> 'src3'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id", "left_anti")


@query("SELECT CAST(d.doc_id AS VARCHAR) || '.txt' AS document_name, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def files_with_metadata(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("document_name"))
    meta = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "quality", "toxic")
    return S.with_metadata(files, meta)


@query(f"""WITH {CHUNKS}, gone AS (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS document_name FROM orders WHERE o_orderstatus = 'P')
SELECT collection_name, CAST(count(DISTINCT document_name) AS BIGINT) AS number_of_files, count(*) AS n_chunks, bool_or(l_returnflag = 'R') AS has_returns
FROM chunks WHERE document_name NOT IN (SELECT document_name FROM gone) GROUP BY 1""")
def delete_documents_recompute(spark, sf_dir):
    """Pending orders are deleted and the collections' information is worked out anew from what stays."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"))
    stay, _ = catalog.delete_documents(chunks(spark, sf_dir), gone)
    docs = stay.groupBy("collection_name", "document_name").agg(F.count("*").alias("n_chunks"), F.bool_or(F.col("l_returnflag") == "R").alias("has_returns"))
    return docs.groupBy("collection_name").agg(F.count("*").alias("number_of_files"), F.sum("n_chunks").alias("n_chunks"), F.bool_or("has_returns").alias("has_returns"))


@query(f"""WITH {CHUNKS} SELECT n.document_name, CASE WHEN c.document_name IS NULL THEN 'not_found' ELSE 'deleted' END AS status
FROM (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS document_name FROM orders) n LEFT JOIN (SELECT DISTINCT document_name FROM chunks) c ON n.document_name = c.document_name""")
def delete_status(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"))
    return catalog.delete_documents(chunks(spark, sf_dir), names)[1]


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size <= 45
UNION ALL SELECT p_partkey, p_name || ' (new)', p_retailprice + 1 FROM part WHERE p_size > 45""")
def update_documents(spark, sf_dir):
    """Parts above a size are taken in again with other values."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    new = parts.where("p_size > 45").withColumn("p_name", F.concat("p_name", F.lit(" (new)"))).withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return catalog.upsert(parts, new, ["p_partkey"]).drop("p_size")


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'rich' ELSE s_name END AS s_name, s_acctbal FROM supplier")
def patch_catalog(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = rows.where("s_acctbal > 5000").select("s_suppkey", F.lit("rich").alias("s_name"))
    return catalog.patch(rows, changes, ["s_suppkey"], ["s_name"])


@query("""SELECT event_id, CASE WHEN value > 50 THEN ['k: missing'] ELSE ['kind: not a valid boolean'] END AS errors
FROM events WHERE value > 50 AND event_type <> 'error' OR value <= 50 AND event_type = 'error'
UNION ALL SELECT event_id, ['kind: not a valid boolean', 'k: missing'] FROM events WHERE value > 50 AND event_type = 'error'""")
def metadata_errors(spark, sf_dir):
    """Events as raw metadata: the kind is a boolean but for errors, and k is missing where the value is large."""
    schema = MetadataSchema((MetadataField("kind", "boolean"), MetadataField("k", "integer", required=True), MetadataField("ts", "datetime")))
    kind = F.when(F.col("event_type") == "error", "maybe").when(F.col("event_type") == "click", "on").otherwise("0")
    raw = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(F.col("value") <= 50, F.get_json_object("props", "$.k")).alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    return catalog.metadata_errors(raw, schema, "event_id")


@query("""SELECT event_type AS batch, count(*) AS total, count(*) FILTER (WHERE value > 100) AS failed,
  CASE WHEN count(*) FILTER (WHERE value > 100) = 0 THEN 'Success' WHEN count(*) FILTER (WHERE value > 100) < count(*) THEN 'Partial' ELSE 'Failed' END AS outcome
FROM events GROUP BY 1""")
def ingestion_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("batch")).agg(F.count("*").alias("total"), F.count_if(F.col("value") > 100).alias("failed"))
    return rows.withColumn("outcome", catalog.outcome(F.col("total"), F.col("failed")))


@query("""SELECT round(avg(CASE WHEN doc_id % 3 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS text_share, CAST(200 AS BIGINT) AS files_per_batch, CAST(1 AS BIGINT) AS parallel_batches FROM documents""")
def batch_shape(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("md").alias("extension"))
    return S.batch_shape(files).withColumn("text_share", F.round("text_share", 9))


@query("""SELECT 'c_::_' || CAST(page_id AS VARCHAR) || '.html_::_' || CAST(page_id % 5 + 1 AS VARCHAR) || '_' || printf('%.4f_%.4f_%.4f_%.4f', 0.5, page_id * 1.0, page_id / 3.0, 10.0) AS key, html AS content
FROM pages WHERE page_id % 2 = 0 AND starts_with('c_::_' || CAST(page_id AS VARCHAR), 'c_::_1')""")
def object_store_prefix(spark, sf_dir):
    """Payloads of elements with a box, found again by a prefix of their key."""
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(F.concat(n.cast("string"), F.lit(".html")).alias("document_name"), (n % 5 + 1).alias("page_number"), F.when(n % 2 == 0, F.array(F.lit(0.5), n.cast("double"), n / 3.0, F.lit(10.0))).alias("location"), F.lit("image").alias("document_type"), F.col("html").alias("content"))
    return S.with_prefix(S.payloads(rows, "c"), "c_::_1")


@query("SELECT doc_id, 'File: ' || CAST(doc_id AS VARCHAR) || chr(10) || 'Content: ' || text AS block, 'txt' AS ext FROM documents")
def source_blocks(spark, sf_dir):
    name = F.concat(F.lit("/data/in/"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    return table(spark, sf_dir, "documents").select("doc_id", T.source_block(T.basename(name), F.col("text")).alias("block"), T.extension(name).alias("ext"))


@query(f"""WITH {CHUNKS}, kept AS (SELECT * FROM chunks WHERE collection_name NOT IN ('3', '7') AND NOT (collection_name = '5' AND document_name IN (SELECT 'order-' || CAST(o_orderkey AS VARCHAR) || '.pdf' FROM orders WHERE o_orderstatus = 'P')))
SELECT collection_name, count(*) AS n_chunks, CAST(count(DISTINCT document_name) AS BIGINT) AS n_documents FROM kept GROUP BY 1""")
def collection_store(spark, sf_dir):
    """All chunks go into a store of collections, from which two collections and the pending orders of a third are deleted."""
    from ..sources.shared import place
    from ..sources.store import ParquetStore

    store = ParquetStore(spark, place(spark, "store"), "pk long, document_name string, l_quantity double, collection_name string")
    store.create_all(["3", "5", "7"])
    store.add(chunks(spark, sf_dir).select("pk", "document_name", "l_quantity", "collection_name").repartition("collection_name"))
    store.drop(["3", "7"])
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("document_name"))
    store.replace_without("5", pending)
    return store.chunks().groupBy("collection_name").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_name").alias("n_documents"))
