"""Operator 11: a source divergence audit over sorted token starts.

A shard's texts stay in their Arrow buffer. Numpy finds where terms start (runs of letters: A-Z, a-z and all beyond ASCII), and the
pointers to these starts, not the terms, are sorted: slices of a shard by eight bytes at a time, where only runs that are still
equal and not at their terms' end go on to the next eight (multikey quicksort on wide digits). Equal runs are terms; from the
documents of a run follow its occurrences and its documents by language and source. What leaves a task is one row for each term of
each group in a slice; Spark adds those up.

Each language keeps the terms of at least min_docs documents. A group (language, source) gives term t, of which it has c
occurrences, the probability p = 1 + floor(SCALE * (c + 1) / (N + V)), N being its occurrences of kept terms and V their number; a
language does so with the sums over its sources. The divergence of p from q at a term is floor((p - q)^2 / q). Groups are
compared pairwise over all kept terms, and each with its language by its own terms that are more probable than there.

Numbers are exact: floor(SCALE * c / m) is three steps of long division, as SCALE is a thousand cubed. Pairs of sources are worked
out in blocks: cells of SOURCES by SOURCES sources meet for some TERMS terms in one task, in which terms that a source lacks count
with its probability of none; terms that both blocks lack are one product at the end. No task has more than one such piece at a
time, whatever the number of terms and sources.

Null text, lang and source are read as ''. Groups without terms are there too. Ties go to the smaller item by UTF-8 bytes. Texts of
any length are read whole; repeated rows are documents of their own; doc_id and other columns, of whatever name, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MIN_DOCS, TOP = 3, 200
SLICE = 4_000_000  # bytes of text whose starts are sorted together
ROWS = 1_000_000  # sums that a task holds before it adds them up, and hands them on where that leaves over half of them
SOURCES, TERMS = 64, 4096
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each text and the end of the last) of a string array without nulls, as views of its buffers."""
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def sorted_runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the terms data[start : start + len] by bytes, and the number of the run of equal ones that each is in, in that
    order. Terms hold no zero byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))
    order, run = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    live, depth = np.arange(len(starts)), 0  # live: positions in order whose runs are not yet told apart
    while len(live):
        mine = order[live]
        rest = lens[mine] - depth
        key = eight[np.minimum(starts[mine] + depth, len(data))].astype(np.uint64)
        cut = (8 * (8 - np.clip(rest, 1, 8))).astype(np.uint64)
        key = np.where(rest > 0, (key >> cut) << cut, np.uint64(0))
        by = np.argsort(key) if not depth else np.lexsort((key, run[live]))
        order[live], key = mine[by], key[by]  # runs are side by side, so the places of a run stay its own
        new = np.zeros(len(order), bool)
        new[live[1:]] = key[1:] != key[:-1]
        new[1:] |= run[1:] != run[:-1]
        run = np.cumsum(new)
        depth += 8
        inside = np.concatenate([~new[1:], [False]]) | ~np.concatenate([[True], new[1:]])  # in a run of two or more
        again = np.flatnonzero(inside)
        longer = np.bincount(run[again], lens[order[again]] > depth, len(order)) > 0
        live = again[longer[run[again]]]
    return order, run


def slice_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, occurrences, documents) of each pair of a term and a group of texts. group: a number for each text."""
    by_group = np.argsort(group, kind="stable")  # documents of a group side by side, so runs of (term, document) are by group
    data, at = text_bytes(texts.take(pa.array(by_group)))
    low = np.where((data >= 0x41) & (data < 0x5B), data + np.uint8(32), data)
    edge = np.diff(LETTER[data].view(np.int8), prepend=np.int8(0))
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    letter = LETTER[data]
    starts = np.flatnonzero((edge == 1) | (letter & cut[:-1]))
    ends = np.flatnonzero(letter & np.concatenate([~letter[1:], [True]]) | letter & cut[1:]) + 1
    none = np.zeros(0, np.int64)
    if not len(starts):
        return pa.array([], pa.string()), none, none, none
    lens = ends - starts
    order, run = sorted_runs(low, starts, lens)
    first = np.flatnonzero(np.diff(run, prepend=-1))
    term = np.empty(len(run), np.int64)
    term[order] = run
    pairs = np.sort(term * len(group) + (np.searchsorted(at, starts, side="right") - 1))  # (term, document)
    n = np.diff(np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1], [True]])))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    term, of = pairs // len(group), group[by_group][pairs % len(group)]
    cells = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (of[1:] != of[:-1])]))
    one = order[first]
    size = lens[one]
    offsets = np.concatenate([[0], np.cumsum(size)])
    flat = low[np.arange(offsets[-1]) + np.repeat(starts[one] - offsets[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(one), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat.tobytes()))
    return words.take(pa.array(term[cells])).cast(pa.string()), of[cells], np.add.reduceat(n, cells), np.diff(cells, append=len(pairs))


def term_counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang, source. Rows: lang, source, term, n (occurrences), docs, to be added up, as each task has
    its own; for each group one of a null term besides."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def cells(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
        many = len(source.dictionary)
        code, group = np.unique(lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy(), return_inverse=True)
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        terms, of, n, found = slice_counts(texts, group)
        of = np.concatenate([of, np.arange(len(code))])
        zeros = np.zeros(len(code), np.int64)
        terms = pa.concat_arrays([terms, pa.nulls(len(code), pa.string())])
        columns = [lang.dictionary.take(pa.array(code[of] // many)), source.dictionary.take(pa.array(code[of] % many)), terms, pa.array(np.concatenate([n, zeros])), pa.array(np.concatenate([found, zeros]))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def added(tables: list) -> pa.Table:
        return pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size, sums, rows = [], 0, [], 0
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            for a, b in common.slices(np.diff(at), SLICE):
                if held and size + at[b] - at[a] > SLICE:
                    sums.append(pa.Table.from_batches([cells(held)]))
                    held, size, rows = [], 0, rows + len(sums[-1])
                if rows > ROWS:
                    sums = [added(sums)]
                    rows = 0
                    if len(sums[0]) > ROWS // 2:
                        yield from sums.pop().to_batches(max_chunksize=50_000)
                held.append(batch.slice(a, b - a))
                size += at[b] - at[a]
        if held:
            sums.append(pa.Table.from_batches([cells(held)]))
        if sums:
            yield from added(sums).to_batches(max_chunksize=50_000)

    return docs.select(text("text"), text("lang"), text("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1000000000 * (count + 1) / (total + kept)) in long division, a thousand at a time; null where nothing is kept."""
    m = F.when(kept > 0, total + kept)
    whole, left = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        whole, left = whole * 1000 + F.call_function("div", left * 1000, m), left * 1000 % m
    return whole + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def tables(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables. Cells: lang, source, term, id (the term's number), n, all (occurrences in the language), of kept terms. Groups: lang, source,
    total (N of the group), total_lang, kept (V)."""
    # Dealt once, by what all sums have in common: sources of a term and the whole of it are added up where it is.
    counts = term_counts(docs).repartition("term", "lang").groupBy("term", "lang", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("term", "lang")  # a row for each source that has the term
    counts = counts.withColumn("row", F.monotonically_increasing_id())
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(whole).alias("all"), F.sum("docs").over(whole).alias("docs"), "row", F.min("row").over(whole).alias("id"))
    counts = counts.where((F.col("docs") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "id", "n", "all", (F.col("row") == F.col("id")).alias("first"))
    counts = common.materialize(counts, "term-counts")
    cells = counts.where("term is not null")
    langs = cells.where("first").groupBy("lang").agg(F.sum("all").alias("total_lang"), F.count("*").alias("kept"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = common.materialize(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "total_lang", "kept"))), "groups")
    return cells, groups


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def term_part(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a group has with more probability than its language, at most top of them. Each task keeps its own top before
    they meet, so a group of any size is no burden."""
    p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("all"), F.col("total_lang"), F.col("kept"))
    rows = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    return ranked(rows.withColumn("value", divergence(F.col("p"), F.col("q"))), "term").where(F.col("rank") <= top)


def pair_part(cells: DataFrame, groups: DataFrame, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """All ordered pairs of sources of a language and their divergences summed over the kept terms."""
    none = probability(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    by = Window.partitionBy("lang")  # a row for each group, of no more than names and sums
    numbered = groups.select("lang", "source", "kept", "total", none.alias("none"), (F.row_number().over(by.orderBy("source")) - 1).alias("number"), F.count("*").over(by).alias("many"))
    numbered = common.materialize(numbered, "sources")
    shards, blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / terms)).cast("int"), F.ceil(F.col("many") / sources).cast("int")
    block = F.floor(F.col("number") / sources).cast("int")
    names = numbered.select("lang", "number", "source", F.lit(None).cast("long").alias("id"), F.col("none").alias("p"), "kept", block.alias("own"), blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    found = cells.join(numbered, ["lang", "source"]).select("lang", "number", F.lit(None).cast("string").alias("source"), "id", p.alias("p"), "kept", block.alias("own"), blocks.alias("blocks"), F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"))
    dealt = names.unionByName(found).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lang", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "shard", "number", "source", "id", "p", "kept", "own")

    def piece(table: pa.Table) -> pa.Table:
        number, own, p = (table.column(c).fill_null(0).to_numpy() for c in ("number", "own", "p"))
        name = table.column("id").is_null().to_numpy()
        id_ = table.column("id").fill_null(0).to_numpy()[~name]
        heads = np.flatnonzero(name)[np.argsort(number[name])]
        found, row = np.unique(id_, return_inverse=True)
        chance = np.tile(p[heads], (len(found), 1))
        chance[row, np.searchsorted(number[heads], number[~name])] = p[~name]
        block = own[heads]
        a, b, sums = [], [], []
        for i in range(len(heads)):
            to = np.flatnonzero((block != block[i]) if block[0] != block[-1] else np.arange(len(heads)) != i)
            away = chance[:, to] - chance[:, i : i + 1]
            a.append(np.full(len(to), heads[i]))
            b.append(heads[to])
            sums.append((away * away // chance[:, to]).sum(axis=0))
        a, b, sums = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, sums))
        source, kept = table.column("source"), table.column("kept").to_numpy()
        columns = [table.column("lang").take(pa.array(a)), source.take(pa.array(a)), source.take(pa.array(b)), pa.array(sums), pa.array(np.full(len(a), len(found))), pa.array(p[a]), pa.array(p[b]), pa.array(kept[a])]
        return pa.table(columns, names=["lang", "source", "item", "part_sum", "present", "p", "q", "kept"])

    parts = dealt.groupBy("lang", "left", "right", "shard").applyInArrow(piece, "lang string, source string, item string, part_sum long, present long, p long, q long, kept long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"), F.sum("present").alias("present"), *(F.max(c).alias(c) for c in ("p", "q", "kept")))
    rest = F.when(F.col("kept") > F.col("present"), (F.col("kept") - F.col("present")) * divergence(F.col("p"), F.col("q"))).otherwise(0)
    return ranked(sums.select("lang", "source", "item", (F.col("part_sum") + rest).alias("value")), "pair")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """docs: text, lang, source. Rows: lang, source, part ('pair' or 'term'), item, value, rank."""
    cells, groups = tables(docs, min_docs)
    return pair_part(cells, groups).unionByName(term_part(cells, groups, top))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS d FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(d) >= 3),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY ALL),
grps AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS n_lang
        FROM grps g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cells GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 1)) // (s.total + l.v) AS p,
        1 + (1000000000 * (c.n_lang + 1)) // (l.total + l.v) AS q
        FROM cells c JOIN sums s USING (lang, source) JOIN langs l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(v, 0)::HUGEINT AS value
        FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS v
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
        ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
rows_ AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM rows_ QUALIFY part = 'pair' OR rank <= 200
"""
