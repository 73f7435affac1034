"""Metadata filters on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import Condition, Field, any_of, from_openai, from_query_dsl, per_collection
from ..functions.schema import MetadataField, MetadataSchema
from .registry import query, table

PART = MetadataSchema((MetadataField("p_brand"), MetadataField("p_type"), MetadataField("p_size", "integer"), MetadataField("p_retailprice", "float"), MetadataField("tags", "array", "string")))
ORDERS = MetadataSchema((MetadataField("o_orderdate", "datetime"), MetadataField("o_totalprice", "float"), MetadataField("o_orderstatus"), MetadataField("o_orderpriority")))
LABELS = MetadataSchema((MetadataField("good", "boolean"),))
TAGS = "string_split(lower(p_name), ' ')"


def _part(spark, sf_dir, condition):
    """Parts for which a condition on (brand, type, size, price, tags) holds."""
    rows = table(spark, sf_dir, "part").withColumn("tags", F.split(F.lower("p_name"), " "))
    return rows.where(condition.column).select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


def _f(name):
    """A part's field; names of brands and types count in lower case."""
    return Field(PART, name, F.lower(name) if name in ("p_brand", "p_type") else None)


PART_SQL = "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part WHERE "


@query(PART_SQL + "lower(p_brand) = 'brand#12'")
def filter_string_eq_ci(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_brand").compare("==", "BRAND#12"))


@query(PART_SQL + "lower(p_brand) <> 'brand#12'")
def filter_string_ne(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_brand").compare("!=", "Brand#12"))


@query(PART_SQL + "lower(p_type) LIKE '%eco%'")
def filter_like(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_type").like("%ECO%"))


@query(PART_SQL + "lower(p_brand) IN ('brand#1', 'brand#2', 'brand#3')")
def filter_in(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_brand").isin(["Brand#1", "Brand#2", "Brand#3"]))


@query(PART_SQL + "p_size NOT IN (1, 2, 3, 5, 8, 13)")
def filter_not_in(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_size").not_in([1, 2, 3, 5, 8, 13]))


@query(PART_SQL + "p_size >= 30 AND p_retailprice < 1000.0")
def filter_num_cmp(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_size").compare(">=", 30) & _f("p_retailprice").compare("<", 1000.0))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filter_between_num(spark, sf_dir):
    schema = MetadataSchema((MetadataField("l_quantity", "float"),))
    return table(spark, sf_dir, "lineitem").where(Field(schema, "l_quantity").between(10, 20).column).select("l_orderkey", "l_linenumber", "l_quantity")


@query(PART_SQL + "(lower(p_type) = 'economy' AND NOT (p_size > 25)) OR p_size = 40")
def filter_and_or_not(spark, sf_dir):
    return _part(spark, sf_dir, (_f("p_type").compare("==", "economy") & ~_f("p_size").compare(">", 25)) | _f("p_size").compare("=", 40))


@query(PART_SQL + "lower(p_type) = 'economy' AND (p_size > 45 OR lower(p_brand) = 'brand#7')")
def filter_parens(spark, sf_dir):
    return _part(spark, sf_dir, _f("p_type").compare("==", "ECONOMY") & (_f("p_size").compare(">", 45) | _f("p_brand").compare("==", "brand#7")))


ORDER_SQL = "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE "


def _orders(spark, sf_dir, condition):
    return table(spark, sf_dir, "orders").where(condition.column).select("o_orderkey", "o_orderdate", "o_totalprice")


@query(ORDER_SQL + "o_orderdate BETWEEN TIMESTAMP '1998-10-03 00:00:00' AND TIMESTAMP '1998-10-03 23:59:59'")
def filter_date_eq_day(spark, sf_dir):
    return _orders(spark, sf_dir, Field(ORDERS, "o_orderdate").compare("==", "1998-10-03"))


@query(ORDER_SQL + "o_orderdate > TIMESTAMP '1998-10-03 23:59:59'")
def filter_date_gt_day(spark, sf_dir):
    return _orders(spark, sf_dir, Field(ORDERS, "o_orderdate").compare(">", "Oct 3 1998"))


@query(ORDER_SQL + "o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-03-31 23:59:59'")
def filter_date_between(spark, sf_dir):
    return _orders(spark, sf_dir, Field(ORDERS, "o_orderdate").between("1997-01-01", "1997-03-31"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05 00:00:00' OR ts > TIMESTAMP '2024-01-28 12:00:00'")
def filter_before_after(spark, sf_dir):
    f = Field(MetadataSchema((MetadataField("ts", "datetime"),)), "ts")
    return table(spark, sf_dir, "events").where((f.before("2024-01-05") | f.after("2024-01-28T12:00:00Z")).column).select("event_id", "ts", "event_type")


@query("SELECT doc_id, quality, toxic FROM labels WHERE (quality = 1) = true")
def filter_bool(spark, sf_dir):
    return table(spark, sf_dir, "labels").where(Field(LABELS, "good", F.col("quality") == 1).compare("==", True).column).select("doc_id", "quality", "toxic")


@query(PART_SQL + f"list_contains({TAGS}, 'red')")
def filter_array_contains(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").contains("RED"))


@query(PART_SQL + f"list_has_any({TAGS}, ['ring', 'widget'])")
def filter_array_any(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").contains_any(["ring", "Widget"]))


@query(PART_SQL + f"list_has_all({TAGS}, ['small', 'ring'])")
def filter_array_all(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").contains_all(["small", "ring"]))


@query(PART_SQL + f"len({TAGS}) >= 2")
def filter_array_length(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").length(">=", 2))


@query(PART_SQL + f"list_contains({TAGS}, 'red') AND list_has_all({TAGS}, ['red', 'widget'])")
def filter_array_includes(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").includes("red") & _f("tags").includes(["red", "widget"]))


@query(PART_SQL + f"NOT list_has_any({TAGS}, ['red', 'widget']) AND NOT list_contains({TAGS}, 'small')")
def filter_array_not_includes(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").does_not_include(["red", "widget"]) & _f("tags").does_not_include("small"))


@query(PART_SQL + f"list_has_any({TAGS}, ['red', 'blue'])")
def filter_array_in(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").isin(["red", "blue"]))


@query(PART_SQL + f"NOT list_has_any({TAGS}, ['red', 'blue'])")
def filter_array_not_in(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").not_in(["red", "blue"]))


@query(PART_SQL + f"{TAGS} = ['small', 'ring']")
def filter_array_equal(spark, sf_dir):
    return _part(spark, sf_dir, _f("tags").compare("==", ["small", "ring"]))


@query(PART_SQL + "(lower(p_type) = 'economy' OR p_size IN (10, 20, 30)) AND p_retailprice >= 950.0 AND lower(p_brand) NOT IN ('brand#1', 'brand#2')")
def filter_openai_compound(spark, sf_dir):
    spec = {"type": "and", "filters": [{"type": "or", "filters": [{"type": "eq", "key": "p_type", "value": "ECONOMY"}, {"type": "in", "key": "p_size", "value": [10, 20, 30]}]}, {"type": "gte", "key": "p_retailprice", "value": 950.0}, {"type": "nin", "key": "p_brand", "value": ["Brand#1", "Brand#2"]}]}
    return _part(spark, sf_dir, from_openai(spec, PART, {"p_type": F.lower("p_type"), "p_brand": F.lower("p_brand")}))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE lower(o_orderstatus) IN ('f', 'o') AND o_totalprice > 100000.0 AND o_totalprice <= 300000.0 AND NOT (lower(o_orderpriority) = '5-low') AND (o_orderdate >= TIMESTAMP '1998-01-01' OR lower(o_orderpriority) LIKE '1-%')")
def filter_es_dsl(spark, sf_dir):
    dsl = {"bool": {"must": [{"terms": {"o_orderstatus": ["F", "O"]}}, {"range": {"o_totalprice": {"gt": 100000.0, "lte": 300000.0}}}], "must_not": [{"term": {"o_orderpriority": "5-LOW"}}], "should": [{"range": {"o_orderdate": {"gte": "1998-01-01"}}}, {"wildcard": {"o_orderpriority": "1-*"}}], "minimum_should_match": 1}}
    return _orders(spark, sf_dir, from_query_dsl(dsl, ORDERS, {"o_orderstatus": F.lower("o_orderstatus"), "o_orderpriority": F.lower("o_orderpriority")}))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'fr', 'de') AND n_chars > 2000")
def filter_multi_collection_partial(spark, sf_dir):
    """Languages as collections; the Spanish one has no n_chars in its schema and is left out."""
    full = MetadataSchema((MetadataField("n_chars", "integer"),))
    schemas = {"en": full, "fr": full, "de": full, "es": MetadataSchema((MetadataField("source"),))}
    found = per_collection(lambda s: Field(s, "n_chars").compare(">", 2000), schemas, partial=True)
    own = any_of(Condition(F.col("lang") == name) & c for name, c in found.items())
    return table(spark, sf_dir, "documents").where(own.column).select("doc_id", "lang", "n_chars")
