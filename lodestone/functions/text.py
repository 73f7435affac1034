"""Scalar text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), where value is worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(name: Column) -> Column:
    found = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


def think_strip(text: Column) -> Column:
    """Without <think> blocks; an open one takes the rest, a lone end tag what stands before it."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(closed, r"(?s)<think>.*$", ""), r"(?s)^.*</think>", ""))


def sigmoid(score: Column, slope: float = 0.1) -> Column:
    return 1 / (1 + F.exp(-slope * score))


def escape_braces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def first_score(text: Column) -> Column:
    """2, 1 or 0, whichever of them, in this order, stands anywhere in text."""
    return F.when(text.contains("2"), 2).when(text.contains("1"), 1).when(text.contains("0"), 0)


def source_block(name: Column, content: Column) -> Column:
    """A passage with its file's name, as prompts show it."""
    return F.concat(F.lit("File: "), strip_extension(name), F.lit("\nContent: "), content)


def object_key(collection: Column, file: Column, page: Column, box: Column) -> Column:
    """The key of an element's payload: collection, file, page and the box's corners, rounded to four places."""
    corners = F.transform(box, lambda x: F.format_string("%.4f", F.round(x, 4)))
    return F.concat_ws("_::_", collection, file, F.concat_ws("_", page.cast("string"), F.array_join(corners, "_")))


def location(own: Column, image: Column, table: Column, chart: Column) -> Column:
    """An element's box, or else those of its image, table and chart, one after another."""
    none = F.array().cast("array<double>")
    return F.coalesce(own, F.concat(F.coalesce(image, none), F.coalesce(table, none), F.coalesce(chart, none)))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; of a key that both have b's value counts."""
    return F.coalesce(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)), a, b)


def html_text(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags, entities of markup resolved, white space to single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " "))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda w: w != "")).cast("long")
