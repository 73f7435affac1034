"""Operator 8: line dedup by content-defined chunks of lines, in DataFrame functions alone.

A line's number is the head of its MD5; a rolling hash over the last two numbers ends a chunk where it is divisible by
MODULUS, so boundaries move along with the text. Chunks of several lines that occur again anywhere are found by their hash,
compared byte by byte with the first occurrence (smallest doc_id, then place) and removed unless they are it. Chunks of one
line stay: that is what op8's SQL says. Such chunks miss most short passages, as boundaries depend on what stands around a
passage. stage(), and with it the pipeline, therefore looks up passages(): beside the chunks every two neighbouring lines that
have words, every line of over alone words, and a text that is a single line; what any of them finds goes. Each passage of two
lines or more consists of such pairs wherever it stands, so none is missed, and of each line one occurrence stays. A line of
alone words or fewer that is repeated by itself, between lines that are not, stays: a heading or a notice that many documents
have is no copied passage. alone is a parameter; 0 looks up every line that has words, whatever its length.

Null texts stay null and have no lines; an empty text has one empty line; a text of which all chunks go becomes empty; rows
that share doc_id and text are one occurrence and are treated alike; texts of any length are taken whole; a chunk may occur in
any number of documents, its occurrences are joined, never gathered; the smallest (doc_id, hash of the text, place) of equal
occurrences is the first, a null doc_id before others; an empty table gives an empty one; columns of the result's names are
replaced by dedup() and kept by stage(). What is joined grows with
the corpus, so none of it is broadcast at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import let

MODULUS, FACTOR, LONG = 3, 31, 50
#: Columns on the way, named so that a table is unlikely to have them.
HASH, GONE, OWN_ID, OWN_HASH = "__line_hash", "__line_gone", "__line_doc_id", "__line_doc_hash"


def line_number(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks(lines: Column) -> Column:
    """An array of (start, n): the chunks of lines, in order."""

    def by_ends(ends: Column) -> Column:
        start = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
        return F.transform(ends, lambda e, k: F.struct(start(k).alias("start"), (e - start(k) + 1).alias("n")))

    def by_numbers(h: Column) -> Column:
        last = F.size(h) - 1
        rolled = lambda i: F.get(h, i) + FACTOR * F.coalesce(F.get(h, i - 1), F.lit(0))
        return let(F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) % MODULUS == 0)), by_ends)

    return let(F.transform(lines, line_number), by_numbers)


def several_lines(lines: Column) -> Column:
    """The chunks of more than one line, as (start, n)."""
    return F.transform(F.filter(chunks(lines), lambda c: c["n"] > 1), lambda c: span(c["start"], c["n"]))


def passages(lines: Column, alone: int = LONG) -> Column:
    """The spans that stage() looks up, as (start, n): they overlap. alone: lines of more words are looked up by themselves."""

    def by_words(counts: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) > 0)
        pairs = lambda x: F.filter(F.transform(x, lambda i, k: span(i, F.get(x, k + 1) - i + 1)), lambda p: p["n"].isNotNull())
        single = F.transform(F.filter(at, lambda i: (F.get(counts, i) > alone) | (F.size(counts) == 1)), lambda i: span(i, F.lit(1)))
        return F.array_distinct(F.concat(several_lines(lines), let(at, pairs), single))

    return let(F.transform(lines, common.word_count), by_words)


def span(start: Column, n: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), n.cast("int").alias("n"))


def piece(lines: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, n), "\n")


def repeated_chunks(docs: DataFrame, spans: Callable[[Column], Column]) -> DataFrame:
    """docs: doc_id, HASH, text. Rows: doc_id, HASH, start, n: the occurrences to remove; rows may repeat."""
    lines = F.split("text", "\n", -1)
    several = let(lines, lambda x: F.transform(spans(x), lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), F.xxhash64(piece(x, c["start"], c["n"])).alias("hash"))))
    rows = docs.where("text is not null").select("doc_id", HASH, F.explode(several).alias("c")).select("doc_id", HASH, "c.*")
    rows = common.materialize(rows, "line-chunks")
    own = F.struct("doc_id", HASH, "start")
    again = common.materialize(rows.groupBy("hash").agg(F.min(own).alias("first"), F.max(own).alias("last")).where("first <> last").select("hash", "first"), "line-repeats")
    found = rows.join(again.hint("merge"), "hash").withColumn("owner", own == F.col("first"))
    found = common.materialize(found.select("doc_id", HASH, "start", "n", "hash", "owner"), "line-occurrences")
    common.drop(rows, again)
    places = found.groupBy("doc_id", HASH).agg(F.collect_set(F.struct("start", "n", "hash", "owner")).alias("places")).withColumnsRenamed({"doc_id": OWN_ID, HASH: OWN_HASH})
    same = docs["doc_id"].eqNullSafe(places[OWN_ID]) & (docs[HASH] == places[OWN_HASH])
    texts = docs.join(places.hint("merge"), same)
    cut = let(lines, lambda x: F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), p["hash"].alias("hash"), p["owner"].alias("owner"), piece(x, p["start"], p["n"]).alias("bytes"))))
    texts = texts.select("doc_id", HASH, F.explode(cut).alias("c")).select("doc_id", HASH, "c.*")
    texts = common.materialize(texts, "line-texts")
    owners = texts.where("owner").select("hash", F.col("bytes").alias("first_bytes")).dropDuplicates(["hash"])
    gone = texts.where("not owner").join(owners.hint("merge"), "hash").where("bytes = first_bytes").select("doc_id", HASH, "start", "n")
    gone = common.materialize(gone, "line-gone")
    common.drop(found, texts)  # before whole texts are shuffled again
    return gone


def dedup(docs: DataFrame, spans: Callable[[Column], Column] = several_lines, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with n_lines, n_removed (lines), and text without what was removed; other columns as they are. spans makes the
    (start, n) of a text's lines that are looked up; counts are the names of the two columns, which replace any of docs."""
    names = [c for c in docs.columns if c not in counts]
    keyed = docs.select(*names, F.xxhash64("text").alias(HASH))
    gone = repeated_chunks(keyed.select("doc_id", HASH, "text"), spans).groupBy("doc_id", HASH).agg(F.collect_set(F.struct("start", "n")).alias(GONE))
    gone = gone.withColumnsRenamed({"doc_id": OWN_ID, HASH: OWN_HASH})
    rows = keyed.join(gone.hint("merge"), keyed["doc_id"].eqNullSafe(gone[OWN_ID]) & (keyed[HASH] == gone[OWN_HASH]), "left")
    out_lines = F.array_distinct(F.flatten(F.transform(GONE, lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1))))

    def without(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x) - 1), out_lines)
        return F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n")

    lines = F.split("text", "\n", -1)
    text = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(let(lines, without))
    removed = F.coalesce(F.when(F.col(GONE).isNotNull(), F.size(out_lines)), F.lit(0)).cast("long")
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(*(text.alias("text") if c == "text" else F.col(c) for c in names), count.alias(counts[0]), removed.alias(counts[1]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 with the spans of the pipeline's stage."""
    return dedup(common.documents(spark, sf_dir).select("doc_id", "text"), passages).select("doc_id", "n_lines", "n_removed", "text")


def stage(docs: DataFrame, alone: int = LONG) -> DataFrame:
    """docs with what dedup() leaves of their texts where all passages are looked up; n_chars follows."""
    out = dedup(docs, lambda lines: passages(lines, alone), ("__line_count", "__line_removed"))
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


CHUNKS_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line
  FROM (SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
numbered AS (SELECT doc_id, i, line, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
ended AS (
  SELECT doc_id, i, line, CASE WHEN (h + {FACTOR} * coalesce(lag(h) OVER w, 0)) % {MODULUS} = 0 THEN 1 ELSE 0 END AS ends
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
dealt AS (
  SELECT doc_id, i, line, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM ended),
chunks AS (
  SELECT doc_id, chunk, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes
  FROM dealt GROUP BY doc_id, chunk)
"""

TEXTS_SQL = """
texts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - sum(CASE WHEN stays THEN 1 ELSE 0 END) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text
  FROM stay GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, t.text AS text
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id
"""

SQL = f"""{CHUNKS_SQL},
ranked AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) AS r FROM chunks WHERE n > 1),
stay AS (
  SELECT d.doc_id, d.i, d.line, r.doc_id IS NULL AS stays
  FROM dealt d LEFT JOIN (SELECT doc_id, chunk FROM ranked WHERE r > 1) r ON d.doc_id = r.doc_id AND d.chunk = r.chunk),
{TEXTS_SQL}"""

#: The same with passages(): the spans of a document overlap, so lines are taken out by their places.
PASSAGES_SQL = f"""{CHUNKS_SQL},
counted AS (
  SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n_words, count(*) OVER (PARTITION BY doc_id) AS n_lines FROM lines),
worded AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM counted WHERE n_words > 0),
places AS (
  SELECT doc_id, start, n FROM chunks WHERE n > 1
  UNION SELECT doc_id, i, following - i + 1 FROM worded WHERE following IS NOT NULL
  UNION SELECT doc_id, i, 1 FROM worded WHERE n_words > {LONG} OR n_lines = 1),
spans AS (
  SELECT p.doc_id, p.start, p.n, array_to_string(string_split(d.text, chr(10))[p.start + 1:p.start + p.n], chr(10)) AS bytes
  FROM places p JOIN documents d ON p.doc_id = d.doc_id),
ranked AS (SELECT doc_id, start, n, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) AS r FROM spans),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i FROM ranked WHERE r > 1),
stay AS (SELECT l.doc_id, l.i, l.line, g.doc_id IS NULL AS stays FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i),
{TEXTS_SQL}"""
