"""Conversations as rows (conv_id, turn, role, text): histories, queries and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, escape_braces, strip_extension


def last_turns(messages: DataFrame, pairs: int) -> DataFrame:
    """The last 2 * pairs messages of each conversation. No more than those reach a task for a conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * pairs).drop("_n")


def joined(messages: DataFrame, text: Column, separator: str, name: str) -> DataFrame:
    """conv_id and its messages' texts in the order of turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", text.alias("_text"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["_text"]), separator).alias(name))


def formatted(messages: DataFrame) -> DataFrame:
    """conv_id, history: a line `Role: text` for each message."""
    return joined(messages, F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit(""))), "\n", "history")


def concatenated(messages: DataFrame) -> DataFrame:
    """conv_id, query: all of the user's turns, joined by a point and a blank."""
    return joined(messages.where("role = 'user'"), F.coalesce("text", F.lit("")), ". ", "query")


def asked(messages: DataFrame) -> DataFrame:
    """conv_id, query (the last user turn, braces doubled), n_history (messages before it that are not empty answers)."""
    kept = messages.where(~((F.col("role") == "assistant") & (F.coalesce(F.trim("text"), F.lit("")) == "")))
    last = kept.where("role = 'user'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    both = kept.join(last, "conv_id").groupBy("conv_id").agg(F.first("last").alias("last"), F.count_if(F.col("turn") < F.col("last.turn")).alias("n_history"))
    return both.select("conv_id", escape_braces(F.col("last.text")).alias("query"), "n_history")


def question_answers(messages: DataFrame) -> DataFrame:
    """conv_id, history: a user's turns and the answers that follow them, a block for each pair, with two empty lines between."""
    after = Window.partitionBy("conv_id").orderBy("turn")  # the turns of a conversation, which one reader has seen
    rows = messages.where("role in ('user', 'assistant')").select("conv_id", "turn", "role", "text", F.lead("role").over(after).alias("next"), F.lead("text").over(after).alias("answer"))
    pairs = rows.where("role = 'user' and next = 'assistant'")
    block = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\nAnswer: "), F.coalesce("answer", F.lit("")))
    return joined(pairs, block, "\n\n\n", "history")


def with_last_turn(messages: DataFrame) -> DataFrame:
    """conv_id, query: the last user turn behind the one before it, which is all of the history that a simple retrieval takes."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return joined(messages.where("role = 'user'").withColumn("_n", F.row_number().over(w)).where("_n <= 2"), F.coalesce("text", F.lit("")), ". ", "query")


def follow_up(text: Column) -> Column:
    """A model's next question without quotes and blanks around it; null where none is needed."""
    bare = F.trim(F.translate(F.trim(text), "'\"", ""))
    return F.when(bare != "", bare)


def message_text(parts: Column) -> Column:
    """The texts of a message's parts (type, text), joined by blanks; parts of other types have none."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def has_images(parts: Column) -> Column:
    return F.coalesce(F.exists(parts, lambda p: p["type"] == "image_url"), F.lit(False))


def shown_context(hits: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, context: the passages (document_name, doc_type, content) that are shown as text, in order, each under its file's name;
    images and structured elements are shown as pictures and left out. by's hits are a top k."""
    rows = hits.where(~F.coalesce(F.col("doc_type"), F.lit("text")).isin("image", "structured") & (F.length("content") > 0))
    name = strip_extension(basename(F.col("document_name")))
    block = F.concat(F.when(F.length(name) > 0, F.concat(F.lit("File: "), name, F.lit("\n"))).otherwise(""), F.lit("Content: "), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct(order, block.alias("_block"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["_block"]), "\n\n").alias("context"))


def sub_queries(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, query: the lines with a digit of an answer, without their number."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[0-9]"))
    rows = answers.select(key, F.posexplode(lines).alias("ordinal", "line"))
    return rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), F.trim(F.regexp_replace("line", r"^\s*[0-9]+\.\s*", "")).alias("query"))
