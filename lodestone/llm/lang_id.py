"""Operator 6: language ID by compression.

Each language gets a zstandard raw-content dictionary made of labelled texts; a text is encoded with every dictionary and goes
to the one that makes it smallest. The score is what the smallest saves against the second smallest, as a share of the second
smallest (of the bytes of the text, where one language is known); texts whose score is under min_score are rejected. Texts that
are null or have no letter (by category: digits, fractions and numerals are none) are `und`, score 0 and rejected; ties go to
the language with more labelled rows, then to the smaller name; case does not count; texts of any length are encoded whole, but in blocks of about BLOCK bytes whose sizes are added up, each with
the dictionary before it: what a dictionary saves in one encoding is bounded, so without blocks the score would fall with the
length and min_score would turn into a limit on it; equal rows agree; an empty table, or one
without labelled rows, gives `und` for all its rows. Extra columns are kept; those that bear one of the result's names are
replaced, and predict() takes other names for it.

The dictionaries are fitted on a bounded sample: of each of the max_langs languages with the most labelled rows, max_docs distinct
texts, chosen by a hash, of which dict_bytes bytes are used. Languages beyond max_langs are not learnt; a warning says how many.
"""

from __future__ import annotations

import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_DOCS, MAX_LANGS, DICT_BYTES, LEVEL, MIN_SCORE = 200, 200, 60_000, 6, 0.001
BLOCK = 16_384
UNDETERMINED = "und"
NAMES = ("lang_pred", "score", "rejected")


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, dict_bytes: int = DICT_BYTES, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Raw dictionary contents by language, the most frequent first, of labelled: text, lang. At most max_docs texts of each of
    max_langs languages reach the driver."""
    h = F.xxhash64("text")
    known = labelled.where("text is not null and lang is not null")
    per_lang = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("texts"))
    top = per_lang.orderBy(F.desc("n"), "lang").limit(max_langs).collect()
    if len(top) == max_langs and (left := per_lang.count() - max_langs):
        warnings.warn(f"{left} languages beyond the {max_langs} with the most rows are not learnt")
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in top}
    if not found:
        return {}
    # Of a language with many texts only a share is looked at, by hash, so that what is shuffled does not grow. Texts are counted,
    # not rows, as copies have one hash: the share finds four times what is needed.
    shares = F.create_map(*(F.lit(x) for r in top for x in (r["lang"], min(1.0, 4.0 * max_docs / max(1, r["texts"])))))
    rows = known.where(F.pmod(h, F.lit(1 << 30)) < F.coalesce(shares[F.col("lang")], F.lit(0.0)) * (1 << 30))
    rows = rows.groupBy("lang", h.alias("h")).agg(F.min(F.substring("text", 1, dict_bytes)).alias("text"))  # copies count once
    chosen = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= max_docs)
    for r in chosen.orderBy("lang", "n").select("lang", "text").toLocalIterator():
        found[r["lang"]].append(r["text"].lower().encode())
    share = lambda texts: max(1, dict_bytes // len(texts))
    return {k: b"\n".join(x[: share(v)] for x in v) for k, v in found.items() if v}


def blocks(raw: bytes) -> list[bytes]:
    """raw in pieces of equal size, up to a byte, of BLOCK bytes at the most."""
    n = max(1, -(-len(raw) // BLOCK))
    return [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]


def predict(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = LEVEL, min_score: float = MIN_SCORE, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Adds lang_pred, score and rejected, or columns of other names."""
    others = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*others, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])

    def run(batches):
        import zstandard as z

        by = {}
        for k, content in dictionaries.items():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            by[k] = z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(batch.schema.get_field_index(text)).to_pylist():
                if not by or x is None or not any(map(str.isalpha, x)):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                raw = x.lower().encode()
                pieces = blocks(raw)
                sizes = sorted(((sum(len(c.compress(b)) for b in pieces), k) for k, c in by.items()), key=lambda x: x[0])
                langs.append(sizes[0][1])
                second = sizes[1][0] if len(sizes) > 1 else len(raw)
                scores.append(max(0.0, min(1.0, (second - sizes[0][0]) / second)))
            rejected = [k == UNDETERMINED or s < min_score for k, s in zip(langs, scores)]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*(f.name for f in others), *names])

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnt(docs: DataFrame) -> dict[str, bytes]:
    return fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), learnt(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
