"""Loops around retrieval, for many questions at once: sub-questions, and answers that are checked and tried again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what a model says of a question that its passages do not answer.
OUT_OF_CONTEXT = "OUT OF CONTEXT"


def decompose(questions: DataFrame, split: Callable[[Column], Column], retrieve: Callable[[DataFrame], DataFrame], follow_up: Callable[[Column, Column], Column], depth: int = 3) -> DataFrame:
    """questions: question_id, question. split makes an array of sub-questions (one means there is nothing to split); each depth
    retrieves for all questions in one job (retrieve: question_id, query to question_id, pk, content), and follow_up makes the
    next query of the question and what was found, or null. Rows: question_id, depth, pk, content, a content once a question."""
    asked = questions.select("question_id", "question", F.explode(split(F.col("question"))).alias("query"))
    out = None
    for level in range(depth):
        found = retrieve(asked.select("question_id", "query")).withColumn("depth", F.lit(level).cast("long"))
        out = found if out is None else out.unionByName(found)
        if level == depth - 1:
            break
        best = found.groupBy("question_id").agg(F.min(F.struct("pk", "content"))["content"].alias("found"))
        asked = questions.join(best, "question_id").select("question_id", "question", follow_up(F.col("question"), F.col("found")).alias("query")).where("query is not null")
    first = out.groupBy("question_id", F.sha2("content", 256).alias("digest")).agg(F.min(F.struct("depth", "pk", "content")).alias("first"))
    return first.select("question_id", "first.*")


def reflect(rows: DataFrame, score: Callable[[Column, Column], Column], again: Callable[[Column, Column], Column], threshold: int = 1, loops: int = 3, text: str = "answer") -> DataFrame:
    """rows: question, answer. Scores each answer and replaces it while its score is under threshold, at most loops times. An answer
    that says it is out of context ends the loop, and the one before it stays. Adds score, tries and grounded (score reached). All
    of it is one projection: no rows move between loops."""
    out = rows.withColumns({"score": score(F.col("question"), F.col(text)), "tries": F.lit(0).cast("long"), "_ended": F.lit(False)})
    for _ in range(loops):
        out = out.withColumn("_low", (F.col("score") < threshold) & ~F.col("_ended")).withColumn("_new", F.when(F.col("_low"), again(F.col("question"), F.col(text))))
        out = out.withColumn("_ended", F.col("_ended") | F.coalesce(F.col("_new").contains(OUT_OF_CONTEXT), F.lit(False)))
        out = out.withColumns({text: F.when(F.col("_low") & ~F.col("_ended"), F.col("_new")).otherwise(F.col(text)), "tries": F.col("tries") + F.col("_low").cast("long")})
        out = out.withColumn("score", score(F.col("question"), F.col(text))).drop("_low", "_new")
    return out.drop("_ended").withColumn("grounded", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def summary_lookup(names: DataFrame, statuses: DataFrame, payloads: DataFrame) -> DataFrame:
    """name, status, summary: an unfinished task's status first, then the stored summary, else NOT_FOUND."""
    rows = names.join(statuses.select("name", "status"), "name", "left").join(payloads.select("name", "summary"), "name", "left")
    status = F.when(F.col("status").isin("PENDING", "IN_PROGRESS", "FAILED"), F.col("status")).when(F.col("summary").isNotNull(), "SUCCESS").otherwise("NOT_FOUND")
    return rows.select("name", status.alias("status"), F.when(status == "SUCCESS", F.col("summary")).alias("summary"))


def similarity_ratio(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for texts without a common place, by edit distance; null where one is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
