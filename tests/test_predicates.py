import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions.predicates import Field, FilterError, boolean_word, from_openai, from_query_dsl, literal, per_collection
from lodestone.functions.schema import OPERATORS, MetadataField, MetadataSchema, normalized, problem

SCHEMA = MetadataSchema((
    MetadataField("title"), MetadataField("rating", "float"), MetadataField("pages", "integer"), MetadataField("public", "boolean"), MetadataField("created", "datetime"), MetadataField("tags", "array", "string"), MetadataField("ids", "array", "integer", max_length=10),
))


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, "ai policy", 4.5, 10, True, "2024-01-15 10:30:00", ["urgent", "policy"], [1, 2]),
        (2, "poems", 3.8, 20, False, "2024-01-10 00:00:00", ["poetry", None], [3]),
        (3, None, None, None, None, None, None, None),
        (4, "ai_poems", 1.0, 30, True, "2024-01-15 23:59:59", [], [1]),
    ]
    return spark.createDataFrame(data, "id int, title string, rating double, pages long, public boolean, c string, tags array<string>, ids array<long>").withColumn("created", F.col("c").cast("timestamp")).cache()


def f(name):
    return Field(SCHEMA, name)


CASES = [
    (lambda: f("title").compare("==", "AI Policy"), {1}),
    (lambda: f("title").compare("!=", "poems"), {1, 4}),
    (lambda: ~f("title").compare("==", "poems"), {1, 3, 4}),
    (lambda: f("title").like("AI%"), {1, 4}),
    (lambda: f("title").like("AI%", ignore_case=False), set()),
    (lambda: f("title").isin(["POEMS", "x"]), {2}),
    (lambda: f("title").not_in(["poems"]), {1, 4}),
    (lambda: f("rating").between(3.8, 4.5), {1, 2}),
    (lambda: f("pages").compare(">", 10), {2, 4}),
    (lambda: f("public").compare("=", True), {1, 4}),
    (lambda: f("created").compare("==", "2024-01-15"), {1, 4}),
    (lambda: f("created").compare("!=", "2024-01-10"), {1, 4}),
    (lambda: f("created").compare(">", "2024-01-15"), set()),
    (lambda: f("created").compare(">=", "2024-01-15"), {1, 4}),
    (lambda: f("created").compare("<=", "Jan 15, 2024"), {1, 2, 4}),
    (lambda: f("created").compare("<", "2024-01-15"), {2}),
    (lambda: f("created").between("2024-01-11", "2024-01-15"), {1, 4}),
    (lambda: f("created").before("2024-01-15T10:30:01Z"), {1, 2}),
    (lambda: f("created").after("2024-01-15T12:00:00+01:00"), {4}),
    (lambda: f("tags").contains("URGENT"), {1}),
    (lambda: f("tags").contains_any(["poetry", "policy"]), {1, 2}),
    (lambda: f("tags").includes(["urgent", "policy"]), {1}),
    (lambda: f("tags").does_not_include(["urgent", "x"]), {2, 3, 4}),
    (lambda: f("tags").does_not_include("urgent"), {2, 3, 4}),
    (lambda: f("tags").not_in(["poetry"]), {1, 3, 4}),
    (lambda: f("ids").length(">=", 2), {1}),
    (lambda: f("ids").compare("==", [1, 2]), {1}),
    (lambda: f("ids").compare("==", [2, 1]), set()),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_conditions(rows, i):
    build, want = CASES[i]
    assert {r["id"] for r in rows.where(build().column).select("id").collect()} == want


REFUSED = [
    lambda: f("nothing").compare("==", "x"), lambda: f("title").compare(">", "a"), lambda: f("title").compare("==", ""), lambda: f("title").compare("==", 3), lambda: f("title").compare("==", None), lambda: f("title").between("a", "b"),
    lambda: f("rating").like("4%"), lambda: f("rating").compare("==", "4"), lambda: f("rating").compare("==", float("nan")), lambda: f("rating").between(2, 1), lambda: f("pages").compare("==", 1.5), lambda: f("public").compare(">", True), lambda: f("public").compare("==", "yes"),
    lambda: f("created").compare("==", "2024"), lambda: f("created").compare("==", 5), lambda: f("created").isin(["2024-01-01"]), lambda: f("tags").compare("==", []), lambda: f("tags").contains(["a"]), lambda: f("tags").compare(">", ["a"]), lambda: f("tags").contains_any(["a", 1]),
    lambda: f("ids").length("==", 0), lambda: f("ids").length(">", 11), lambda: f("ids").length(">", True), lambda: f("title").contains("x"), lambda: f("title").before("2024-01-01"),
]


@pytest.mark.parametrize("i", range(len(REFUSED)))
def test_refused(spark, i):
    with pytest.raises(FilterError):
        REFUSED[i]()


@pytest.mark.parametrize("kind", sorted(OPERATORS))
def test_operator_matrix(spark, kind):
    field = Field(MetadataSchema((MetadataField("x", kind, "string" if kind == "array" else None),)), "x")
    value = {"string": "a", "datetime": "2024-01-01", "boolean": True, "array": ["a"]}.get(kind, 1)
    for op in ("==", "!=", ">", "<="):
        if op in OPERATORS[kind]:
            field.compare(op, value)
        else:
            with pytest.raises(FilterError):
                field.compare(op, value)


def test_json_filters(rows):
    spec = {"type": "or", "filters": [{"type": "and", "filters": [{"type": "eq", "key": "public", "value": True}, {"type": "lt", "key": "pages", "value": 20}]}, {"type": "in", "key": "tags", "value": ["poetry"]}]}
    assert {r["id"] for r in rows.where(from_openai(spec, SCHEMA).column).collect()} == {1, 2}
    dsl = [{"bool": {"must_not": [{"term": {"tags": "urgent"}}], "should": [{"range": {"pages": {"gte": 20, "lt": 30}}}, {"wildcard": {"title": "ai*"}}], "minimum_should_match": 1}}]
    assert {r["id"] for r in rows.where(from_query_dsl(dsl, SCHEMA).column).collect()} == {2, 4}
    for bad in ({"type": "near", "key": "pages", "value": 1}, {"type": "and", "filters": []}):
        with pytest.raises(FilterError):
            from_openai(bad, SCHEMA)


def test_random_conditions_follow_two_valued_logic(rows):
    rng = random.Random(5)
    data = [r.asDict() for r in rows.select("id", "pages", "title").collect()]

    def make(depth):
        kind = rng.choice(["leaf"] if depth == 0 else ["leaf", "and", "or", "not"])
        if kind == "leaf":
            n = rng.choice([10, 20, 30])
            op, py = rng.choice([(">", lambda a, b: a > b), ("==", lambda a, b: a == b), ("!=", lambda a, b: a != b)])
            return f("pages").compare(op, n), lambda r: r["pages"] is not None and py(r["pages"], n)
        if kind == "not":
            c, p = make(depth - 1)
            return ~c, lambda r: not p(r)
        (c, p), (d, q) = make(depth - 1), make(depth - 1)
        return (c & d, lambda r: p(r) and q(r)) if kind == "and" else (c | d, lambda r: p(r) or q(r))

    made = [make(3) for _ in range(25)]
    got = rows.select("id", *(c.flag().alias(f"c{i}") for i, (c, _) in enumerate(made))).collect()
    by = {r["id"]: r for r in data}
    for r in got:
        for i, (_, p) in enumerate(made):
            assert r[f"c{i}"] == p(by[r["id"]])


def test_per_collection():
    pass_all = per_collection(lambda s: s["title"].name, {"a": SCHEMA})
    assert list(pass_all) == ["a"]


def test_partial_collections(spark):
    other = MetadataSchema((MetadataField("x"),))
    build = lambda s: Field(s, "pages").compare(">", 1)
    assert list(per_collection(build, {"a": SCHEMA, "b": other}, partial=True)) == ["a"]
    for args in (({"a": SCHEMA, "b": other}, False), ({"b": other}, True)):
        with pytest.raises(FilterError):
            per_collection(build, *args)


def test_dates():
    at = lambda *x: datetime(*x, tzinfo=UTC)
    assert dates.bound("2024-01-15T10:30:00+02:00", "<") == dates.bound("'2024-01-15 08:30:00.9'", ">") == at(2024, 1, 15, 8, 30)
    assert dates.bound("2024-01-15", ">") == at(2024, 1, 15, 23, 59, 59) and dates.bound("2024-01-15", "!=") == at(2024, 1, 15)
    assert dates.span("2024-01-15T00:00:00") == (at(2024, 1, 15), at(2024, 1, 15))
    for day in ("Tuesday 2 Jan 2024", "Oct 5 2024", "5 August 2024", "2024-02-02", "2001-02-02"):
        first, last = dates.span(day)
        assert (last - first).total_seconds() == 86399
    assert dates.span("3pm 5 Oct 2024")[1] == at(2024, 10, 5, 15)
    for vague in ("10:30", "Oct 2024", "2024", ""):
        with pytest.raises(ValueError):
            dates.span(vague)
    with pytest.raises(ValueError):
        dates.span("no date")
    created = Field(SCHEMA, "created")
    for call in (lambda: created.compare(">", "no date"), lambda: created.compare("==", "2024"), lambda: created.before(5), lambda: created.between("2024-01-01", "later"), lambda: created.after(None), lambda: from_openai({"type": "eq", "key": "title"}, SCHEMA), lambda: from_openai({"type": "eq", "value": 1}, SCHEMA), lambda: from_query_dsl({"range": {"pages": {"over": 1}}}, SCHEMA), lambda: from_query_dsl({}, SCHEMA), lambda: from_query_dsl({"wildcard": {"title": 3}}, SCHEMA)):
        with pytest.raises(FilterError):
            call()
    other = MetadataSchema((MetadataField("created", "string"),))
    assert set(per_collection(lambda s: Field(s, "created").compare("==", "no date"), {"a": SCHEMA, "b": other}, partial=True)) == {"b"}
    assert boolean_word("ON") is True and boolean_word("0") is False
    assert literal("boolean", 1) is True


def test_schema_rules():
    for bad in (dict(name=""), dict(name=" a"), dict(name="type"), dict(name="a", type="map"), dict(name="a", type="array"), dict(name="a", array_type="string"), dict(name="a", type="array", array_type="datetime"), dict(name="a", type="integer", max_length=3), dict(name="a", max_length=0)):
        with pytest.raises(ValueError):
            MetadataField(**bad)
    with pytest.raises(ValueError):
        MetadataSchema((MetadataField("a"), MetadataField("a")))
    assert [x.name for x in MetadataSchema((MetadataField("filename"),)).extended().fields] == ["filename", "page_number", "start_time", "end_time"]
    assert SCHEMA.struct()["ids"].dataType.simpleString() == "array<bigint>"


def test_normalized_values(spark):
    fields = [MetadataField("s", max_length=5), MetadataField("d", "datetime"), MetadataField("b", "boolean"), MetadataField("n", "integer", required=True)]
    rows = spark.createDataFrame([(" AbC ", "2024-01-15T10:30:00Z", "On", "7"), ("toolong", "x", "maybe", "1.5"), ("", "", "", None), (None, None, None, "2")], "s string, d string, b string, n string")
    got = rows.select(*(normalized(x, F.col(x.name)).alias(x.name) for x in fields)).collect()
    assert (got[0]["s"], got[0]["b"], got[0]["n"]) == ("abc", True, 7) and got[0]["d"].hour == 10
    assert tuple(got[1]) == (None,) * 4
    errors = [[e for e in r if e] for r in rows.select(*(problem(x, F.col(x.name)) for x in fields)).collect()]
    assert errors[0] == [] and len(errors[1]) == 4
    assert errors[2] == ["d: missing", "b: missing", "n: missing"] and errors[3] == ["d: missing", "b: missing"]


def test_wildcards_take_only_their_own_signs(spark):
    texts = spark.createDataFrame([("50%_off",), ("50 xxoff",), ("50%xoff",), ("a\\b",)], "title string")
    found = lambda p: {r["title"] for r in texts.where(from_query_dsl({"wildcard": {"title": p}}, SCHEMA).column).collect()}
    assert found("50%_off") == {"50%_off"} and found("50*off") == {"50%_off", "50 xxoff", "50%xoff"} and found("50%?off") == {"50%_off", "50%xoff"} and found("a\\*") == {"a\\b"}
