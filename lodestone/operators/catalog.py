"""Collections and documents: listings, document information, deletes, upserts, metadata checks."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, NumericType

from ..functions import text as T
from ..functions.schema import MetadataSchema, problem

SYSTEM_COLLECTIONS = ("metadata_schema", "document_info", "meta")


def documents_of(chunks: DataFrame, pk: str = "pk") -> DataFrame:
    """collection_name, document_name and the first chunk's values of each document, by the smallest pk."""
    rest = [c for c in chunks.columns if c not in ("collection_name", "document_name", pk)]
    first = F.min(F.struct(pk, *rest)).alias("first")
    return chunks.groupBy("collection_name", "document_name").agg(first).select("collection_name", "document_name", *(F.col(f"first.{c}") for c in rest))


def list_documents(chunks: DataFrame, info: DataFrame, pk: str = "pk") -> DataFrame:
    """Documents with what is known of them (info: collection_name, document_name, ...), if anything is."""
    return documents_of(chunks, pk).join(info, ["collection_name", "document_name"], "left")


def list_collections(chunks: DataFrame, schemas: DataFrame, catalog: DataFrame) -> DataFrame:
    """Collections but for the system's, with their number of chunks, schema and catalogue entry."""
    counts = chunks.where(~F.col("collection_name").isin(*SYSTEM_COLLECTIONS)).groupBy("collection_name").agg(F.count("*").alias("num_entities"))
    return counts.join(schemas, "collection_name", "left").join(catalog, "collection_name", "left")


def kind(document_type: Column, subtype: Column) -> Column:
    """The subtype, where there is one, else the type; structured elements are tables."""
    found = F.coalesce(F.when(subtype != "", subtype), document_type)
    return F.when(found == "structured", "table").otherwise(found)


def type_counts(elements: DataFrame, by: list[str]) -> DataFrame:
    """by, doc_type, n, text_chars of elements (document_type, subtype, content)."""
    return elements.groupBy(*by, kind(F.col("document_type"), F.col("subtype")).alias("doc_type")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("long").alias("text_chars"))


def merge_info(info: DataFrame, by: list[str], sums: list[str], flags: list[str], latest: list[str], order: str) -> DataFrame:
    """One row for each by: numbers are added, flags are true if any is, other values come from the latest row (ties: the larger value)."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums] + [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    return info.groupBy(*by).agg(*aggs, *(F.max(F.struct(order, c))[c].alias(c) for c in latest))


def merge_nested(info: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each by, whatever its columns are: flags (booleans) are true if any is, numbers are added, maps of numbers are
    added key by key, other values come from the last row by order that has one (ties: the larger value). Missing numbers and
    flags are 0 and false, missing maps empty. Rows of a key never meet: maps are added up as (by, key) rows."""
    kinds = {f.name: f.dataType for f in info.schema.fields if f.name not in (*by, order)}
    maps = [c for c, k in kinds.items() if isinstance(k, MapType)]

    def merged(c: str) -> Column:
        if isinstance(kinds[c], BooleanType):
            return F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
        if isinstance(kinds[c], NumericType):
            return F.coalesce(F.sum(c), F.lit(0)).cast(kinds[c]).alias(c)
        return F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c)

    out = info.groupBy(*by).agg(F.count("*").alias("_rows"), *(merged(c) for c in kinds if c not in maps)).drop("_rows")
    for c in maps:
        entries = info.select(*by, F.explode(c).alias("_key", "_value")).groupBy(*by, "_key").agg(F.sum("_value").cast(kinds[c].valueType).alias("_value"))
        added = entries.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias(c))
        same = reduce(operator.and_, (out[k].eqNullSafe(added[k]) for k in by))
        out = out.join(added, same, "left").select(*(out[k] for k in out.columns), F.coalesce(added[c], F.create_map().cast(kinds[c])).alias(c))
    return out.select(*by, *kinds)


def upsert_info(stored: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Stored information with new rows merged into it; of values that are not added the new one counts."""
    both = stored.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return merge_nested(both, by, "_seq")


def flags_of(counts: Column) -> list[Column]:
    """has_tables, has_charts and has_images of a map of counts by kind of element."""
    return [(F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)) > 0).alias(f"has_{k}s") for k in ("table", "chart", "image")]


def element_text(elements: DataFrame, tables: bool = True, charts: bool = True, images: bool = True) -> Column:
    """What an element (document_type, subtype, content, table_content, caption, transcript) adds to its document's text: by its
    type, and only where that is wanted; null otherwise."""
    at = lambda c: F.col(c) if c in elements.columns else F.lit(None).cast("string")
    kind, subtype = F.col("document_type"), at("subtype")
    shown = ((subtype == "table") & F.lit(tables)) | ((subtype == "chart") & F.lit(charts))
    structured = F.when((kind == "structured") & shown, at("table_content"))
    return F.when(kind == "text", at("content")).when(kind == "audio", at("transcript")).when((kind == "image") & F.lit(images), at("caption")).otherwise(structured)


def progress(files: DataFrame, task: str = "task_id", batch: str = "batch_no", status: str = "status") -> DataFrame:
    """task_id, batch_no, documents_completed, batches_completed and extraction_completed (files extracted or further on), each up
    to and with its batch of the task; a batch is complete once none of its files is under way."""
    per = files.groupBy(task, batch).agg(F.count_if(F.col(status) == "completed").alias("d"), F.count_if(F.col(status).isin("completed", "extracted")).alias("x"), F.count_if(~F.col(status).isin("completed", "failed")).alias("open"))
    w = Window.partitionBy(task).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each batch
    return per.select(task, batch, F.sum("d").over(w).alias("documents_completed"), F.sum((F.col("open") == 0).cast("long")).over(w).alias("batches_completed"), F.sum("x").over(w).alias("extraction_completed"))


def metadata_check(files: DataFrame, raw: DataFrame, schema: MetadataSchema) -> DataFrame:
    """document_name, error: all that is wrong with the metadata (filename, ...) of submitted files (path): rows of files that
    were not submitted, what each field's rule refuses, and required fields of files without metadata."""
    names = files.select(T.basename(F.col("path")).alias("document_name")).distinct()
    rows = raw.withColumnRenamed("filename", "document_name")
    orphans = rows.join(names, "document_name", "left_anti").select("document_name", F.lit("not among the files").alias("error"))
    given = rows.join(names, "document_name", "left_semi")
    wrong = metadata_errors(given, schema, "document_name").select("document_name", F.explode("errors").alias("error"))
    required = [f.name for f in schema.fields if f.required]
    bare = names.join(rows.select("document_name").distinct(), "document_name", "left_anti")
    bare = bare.select("document_name", F.lit("no metadata, required: " + ", ".join(required)).alias("error")).where(F.lit(bool(required)))
    return orphans.unionByName(wrong).unionByName(bare)


def declared(rows: DataFrame, schema: MetadataSchema, users: bool = False) -> Column:
    """The metadata of a listing as a struct: the schema's fields that rows has, or with users those the user has defined."""
    names = [f.name for f in schema.fields if f.name in rows.columns and (f.user_defined or not users)]
    return F.struct(*names) if names else F.struct(F.lit(None).alias("none"))


def submitted(files: DataFrame, existing: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """files (document_name) with reason: why a file is not taken in, or null."""
    known = existing.select("document_name").distinct().withColumn("known", F.lit(True))
    ext = T.extension(F.col("document_name"))
    reason = F.when(~ext.isin(*allowed), F.concat(F.lit("unsupported file type: "), ext)).when(F.col("known"), F.lit("document already exists"))
    return files.join(known, "document_name", "left").withColumn("reason", reason).drop("known")


def failed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of which nothing was stored."""
    return files.join(stored.select("document_name").distinct(), "document_name", "left_anti")


def delete_documents(chunks: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, names with status deleted or not_found)."""
    stored = chunks.select("document_name").distinct().withColumn("stored", F.lit(True))
    status = names.join(stored, "document_name", "left").select("document_name", F.when(F.col("stored"), "deleted").otherwise("not_found").alias("status"))
    return chunks.join(names.select("document_name").distinct(), "document_name", "left_anti"), status


def upsert(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys new has, and new."""
    return rows.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def patch(rows: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns that changes gives (not null) for their keys."""
    given = changes.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    out = rows.join(given, keys, "left")
    return out.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def metadata_errors(raw: DataFrame, schema: MetadataSchema, key: str) -> DataFrame:
    """key, errors: what is wrong with each row of raw texts, and only rows with something wrong."""
    errors = F.filter(F.array(*(problem(f, F.col(f.name)) for f in schema.fields)), lambda x: x.isNotNull())
    return raw.select(key, errors.alias("errors")).where(F.size("errors") > 0)


def outcome(total: Column, failures: Column) -> Column:
    return F.when(failures == 0, "Success").when(failures < total, "Partial").otherwise("Failed")


def page_filter(pages: DataFrame, wanted: str | list[list[int]], by: list[str], page: str = "page_number") -> DataFrame:
    """Rows on even or odd pages, or in ranges; negative ends count from the last page of their by, all ends are clamped to
    its pages. The last page comes from an aggregate, so a document's rows need not meet."""
    if isinstance(wanted, str):
        if wanted.lower() not in ("even", "odd"):
            raise ValueError("even or odd")
        return pages.where(F.pmod(F.col(page), F.lit(2)) == (0 if wanted.lower() == "even" else 1))
    for a, b in wanted:
        if not a or not b or (a > 0) != (b > 0) or a > b:
            raise ValueError("ranges have no zero, no mixed signs and start before their end")
    last = pages.groupBy(*by).agg(F.max(page).alias("last_page"))

    def end(x: int) -> Column:
        at = F.lit(x) if x > 0 else F.col("last_page") + x + 1
        return F.greatest(F.lit(1), F.least(at, F.col("last_page")))

    inside = reduce(lambda p, q: p | q, (F.col(page).between(end(a), end(b)) for a, b in wanted))
    return pages.join(last, by).where(inside).drop("last_page")


def latest_status(log: DataFrame, key: str, ts: str, status: str, started: str, terminal: tuple[str, ...]) -> DataFrame:
    """key, status (the latest), started_at (of the first started row) and completed_at (if the latest is terminal)."""
    rows = log.groupBy(key).agg(F.max(F.struct(ts, status)).alias("last"), F.min(F.when(F.col(status) == started, F.col(ts))).alias("started_at"))
    return rows.select(key, F.col(f"last.{status}").alias("status"), "started_at", F.when(F.col(f"last.{status}").isin(*terminal), F.col(f"last.{ts}")).alias("completed_at"))


