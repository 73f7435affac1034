"""Operator 4: quality rules by host, in DataFrame functions alone.

Each text is measured inside its row and judged by four rules: too few words, repeated windows of words (these two are the
base), many symbols, many repeated lines. Failures of each rule are counted by host. A host's rate of a rule is shrunk towards
the rate of all hosts: the prior is a beta distribution fitted to the counts by moments, so that hosts count by their documents
and the chance in small counts is not taken for a difference between hosts. A host fails a rule if its rate is surely high: if the
posterior's mean less SURE of its standard deviations is over the rule's limit. Documents of hosts that fail any rule go, beside those that fail the
base. Where all hosts are alike, none fails, however many documents do.

Null texts have no words and fail the base; a null host is a host of its own; equal rows count as so many documents and agree;
hosts with the same counts agree; an empty table gives an empty one; columns that bear a result's name are replaced, other ones,
of whatever name, stay; texts of any length are taken whole (windows are hashed, and compared as strings where hashes repeat).
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words in repeated windows
MAX_SYMBOLS, MAX_DUP_LINES = 10, 30  # per cent of the words' characters, of the lines with a word
#: Of each rule: the rate of failures that a host may have. Base rules fail documents by themselves; a host is judged by all.
LIMITS = {"few_words": 0.3, "repeats": 0.3, "symbols": 0.3, "dup_lines": 0.3}
SURE = 1.6448536269514722  # the 95 % quantile of a normal distribution
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_failed", "kept", *(f"fails_{r}" for r in LIMITS))


def let(value: Column, use) -> Column:
    """use(value), where value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many of words stand in windows of size words that occur twice or more."""
    at = F.sequence(F.lit(0), F.size(words) - size)

    def covered(windows: Column) -> Column:
        def like_neighbour(s: Column) -> Column:
            like = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
            twins = F.transform(s, lambda x, k: F.when(like(x, F.get(s, k - 1)) | like(x, F.get(s, k + 1)), x["i"]))
            return F.array_sort(F.filter(twins, lambda x: x.isNotNull()))

        sorted_ = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        starts = let(sorted_, like_neighbour)
        steps = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        strings = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, size), " "))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(strings)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.when(F.size(words) < size, F.lit(0).cast("long")).otherwise(let(hashes, count))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and fails_ of each rule."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = let(F.regexp_extract_all(whole, F.lit(common.WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(common.WORD))
    dup = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all")))
    symbols = F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long")
    rows = docs.select(*(c for c in docs.columns if c not in (*NAMES, text)), counted.alias("__counted"), symbols.alias("n_symbols"), dup.alias("__lines"))
    rows = rows.withColumns({c: F.col(f"__counted.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {"n_dup_lines": F.col("__lines.dup")})
    fails = {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("__lines.all"),
    }
    rows = rows.withColumns({f"fails_{k}": v for k, v in fails.items()})
    return rows.withColumn("base_failed", F.col("fails_few_words") | F.col("fails_repeats")).drop("__counted", "__lines")


def beta_prior(n: float | None, hosts: int, squares: float, failed: float, spread: float) -> tuple[float, float]:
    """(a, b) of the beta distribution of hosts' rates, by the moments of counts: n documents, failed of them; squares: the sum of
    the hosts' squared sizes; spread: the sum over hosts of size * (rate - mean rate) squared. Hosts that differ no more than
    chance has it get a prior as strong as all documents together; without documents or without two outcomes it is (1, 1)."""
    if not n or not 0 < failed < n:
        return 1.0, 1.0
    m = failed / n
    chance, scale = m * (1 - m), n - squares / n
    between = (spread - (hosts - 1) * chance) / (scale - (hosts - 1)) if hosts > 1 and scale > hosts - 1 else 0.0
    strength = min(n, chance / between - 1) if between > 0 else n
    strength = max(strength, 1e-3)
    return m * strength, (1 - m) * strength


def host_verdicts(rows: DataFrame, host: str = "source", limits: dict[str, float] = LIMITS, sure: float = SURE) -> DataFrame:
    """host, n_docs, failed_, rate_ (shrunk) and sure_ (the rate that is surely reached) of each rule, and host_failed."""
    hosts = common.materialize(rows.groupBy(host).agg(F.count("*").alias("n_docs"), *(F.count_if(f"fails_{r}").alias(f"failed_{r}") for r in limits)), "hosts")
    n = F.col("n_docs").cast("double")
    totals = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"), *(F.sum(f"failed_{r}").alias(r) for r in limits)).first()
    mean = {r: (totals[r] or 0) / totals["n"] if totals["n"] else 0.0 for r in limits}
    spreads = hosts.agg(*(F.sum(n * F.pow(F.col(f"failed_{r}") / n - mean[r], 2)).alias(r) for r in limits)).first()
    verdicts = []
    for r, limit in limits.items():
        a, b = beta_prior(totals["n"], totals["hosts"], totals["squares"] or 0.0, totals[r] or 0, spreads[r] or 0.0)
        rate = (F.col(f"failed_{r}") + a) / (n + a + b)
        hosts = hosts.withColumns({f"rate_{r}": rate, f"sure_{r}": rate - sure * F.sqrt(rate * (1 - rate) / (n + a + b + 1))})
        verdicts.append(F.col(f"sure_{r}") > limit)
    return hosts.withColumn("host_failed", reduce(operator.or_, verdicts))


def judge(docs: DataFrame, host: str = "source", text: str = "text", limits: dict[str, float] = LIMITS) -> DataFrame:
    """docs' rows without text, with the measures, host_rate (the highest shrunk rate of its host), host_failed and kept."""
    rows = common.materialize(measures(docs, text), "quality")
    hosts = host_verdicts(rows, host, limits).select(F.col(host).alias("__host"), F.greatest(*(f"rate_{r}" for r in limits), F.lit(0.0)).alias("host_rate"), "host_failed")
    out = rows.join(hosts, rows[host].eqNullSafe(hosts["__host"]), "left").drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", *OUT)


SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{common.WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM docs WHERE len(words) >= {WINDOW})),
twice AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (
    SELECT x.doc_id, x.i, unnest(range({WINDOW})) AS j FROM windows x JOIN twice y ON x.doc_id = y.doc_id AND x.w = y.w) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{common.WORD}') GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, coalesce(l.n_lines, 0) AS n_lines,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id),
ruled AS (
  SELECT *, CAST(n_words < {MIN_WORDS} AS INT) AS few_words, CAST(100 * n_repeat_words > {MAX_REPEAT} * n_words AS INT) AS repeats,
         CAST(100 * n_symbols > {MAX_SYMBOLS} * word_chars AS INT) AS symbols, CAST(100 * n_dup_lines > {MAX_DUP_LINES} * n_lines AS INT) AS dup_lines FROM measured),
hosts AS (
  SELECT source, rule, count(*) AS n, sum(failed) AS k FROM (
    SELECT source, unnest({list(LIMITS)}) AS rule, unnest([{", ".join(LIMITS)}]) AS failed FROM ruled) GROUP BY source, rule),
totals AS (SELECT rule, count(*) AS h, sum(n) AS n, sum(n * n) AS sq, sum(k) AS k FROM hosts GROUP BY rule),
spreads AS (SELECT h.rule, sum(h.n * power(h.k / h.n - t.k / t.n, 2)) AS spread FROM hosts h JOIN totals t ON h.rule = t.rule GROUP BY h.rule),
fit AS (
  SELECT t.rule, t.k / t.n AS m, t.n, CASE WHEN h > 1 AND t.n - sq / t.n > h - 1 THEN (spread - (h - 1) * (t.k / t.n) * (1 - t.k / t.n)) / (t.n - sq / t.n - (h - 1)) ELSE 0 END AS b
  FROM totals t JOIN spreads s ON t.rule = s.rule),
prior AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 THEN greatest(CASE WHEN b > 0 THEN least(n, m * (1 - m) / b - 1) ELSE n END, 1e-3) END AS strength FROM fit),
rates AS (
  SELECT source, h.rule, n, coalesce(strength, 2) AS w, (k + coalesce(m * strength, 1)) / (n + coalesce(strength, 2)) AS rate FROM hosts h JOIN prior p ON h.rule = p.rule),
verdicts AS (
  SELECT source, bool_or(rate - {SURE!r} * sqrt(rate * (1 - rate) / (n + w + 1)) > CASE rule {" ".join(f"WHEN '{r}' THEN {x}" for r, x in LIMITS.items())} END) AS host_failed FROM rates GROUP BY source)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words + repeats > 0 AS base_failed, few_words + repeats = 0 AND NOT host_failed AS kept
FROM ruled j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""
