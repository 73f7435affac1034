"""Typed metadata conditions, made of Column expressions.

Conditions are two-valued: one on a missing value is false, and its negation true. Strings are stored in lower case, so
literals are lowered; a bare day in a date condition means the whole day where that makes a difference. What a field's type
does not allow is refused when the condition is built, before Spark sees it.
"""

from __future__ import annotations

import math
import operator
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .schema import FALSE, OPERATORS, TRUE, TYPES, MetadataField, MetadataSchema

COMPARE = {"==": operator.eq, "=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


class FilterError(ValueError):
    """A condition that the schema does not allow."""


class Condition:
    """column is true where the condition holds, else false or null: fit for where(), and plain enough to reach the scan. Only
    a negation needs the difference, so only there nulls are made false."""

    def __init__(self, column: Column):
        self.column = column

    def __and__(self, other: Condition) -> Condition:
        return Condition(self.column & other.column)

    def __or__(self, other: Condition) -> Condition:
        return Condition(self.column | other.column)

    def __invert__(self) -> Condition:
        return Condition(~self.flag())

    def flag(self) -> Column:
        """As a value: true or false."""
        return F.coalesce(self.column, F.lit(False))


def literal(kind: str, value: Any) -> Any:
    """value as the type's literal; refuses those of another type."""
    if value is None:
        raise FilterError("null is no literal; conditions on missing values are not offered")
    if kind == "string":
        if not isinstance(value, str):
            raise FilterError(f"{value!r} is no string")
        if value == "":
            raise FilterError("the empty string is no literal")
        return value.lower()
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        if isinstance(value, int) and value in (0, 1):
            return bool(value)
        raise FilterError(f"{value!r} is no boolean")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise FilterError(f"{value!r} is no number")
    if isinstance(value, float) and not math.isfinite(value):
        raise FilterError("numbers must be finite")
    if kind == "integer":
        if value != int(value):
            raise FilterError(f"{value!r} is no whole number")
        return int(value)
    return float(value)


def moment(t: datetime) -> Column:
    """A time without zone (in UTC, as sessions are), which Spark compares with either kind of column without casting the column,
    so that the condition reaches the scan."""
    return F.lit(t.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def date_literal(value: Any, read, *args):
    """read(value, *args), where value is a text and not a bare number."""
    if not isinstance(value, str) or value.strip("\"' ").isdigit():
        raise FilterError(f"{value!r} is no date")
    try:
        return read(value, *args)
    except ValueError as e:
        raise FilterError(str(e)) from None


class Field:
    """A metadata field in conditions; col is where its values are, by default a column of its name."""

    def __init__(self, schema: MetadataSchema, name: str, col: Column | None = None):
        try:
            self.field: MetadataField = schema[name]
        except KeyError as e:
            raise FilterError(e.args[0]) from None
        self.col = F.col(name) if col is None else col

    def _allow(self, op: str) -> None:
        if op not in OPERATORS[self.field.type]:
            raise FilterError(f"{op} does not go with {self.field.name}, which is {self.field.type}")

    def _list(self, values: Any) -> Column:
        kind = self.field.array_type or self.field.type
        if not isinstance(values, (list, tuple)) or not values:
            raise FilterError("a list of values is needed, not empty")
        return F.array(*(F.lit(literal(kind, v)) for v in values)).cast(f"array<{TYPES[kind].simpleString()}>")

    def _bound(self, value: Any, op: str) -> Column:
        return moment(date_literal(value, dates.bound, op))

    def compare(self, op: str, value: Any) -> Condition:
        self._allow(op)
        f = self.field
        if f.type == "array":
            return Condition(COMPARE[op](self.col, self._list(value)))
        if f.type == "datetime":
            if op in ("==", "="):
                first, last = date_literal(value, dates.span)
                return Condition(self.col == moment(first) if first == last else self.col.between(moment(first), moment(last)))
            return Condition(COMPARE[op](self.col, self._bound(value, op)))
        return Condition(COMPARE[op](self.col, F.lit(literal(f.type, value))))

    def between(self, low: Any, high: Any) -> Condition:
        self._allow("between")
        if self.field.type == "datetime":
            a, b = date_literal(low, dates.bound, ">="), date_literal(high, dates.bound, "<=")
        else:
            a, b = literal(self.field.type, low), literal(self.field.type, high)
        if a > b:
            raise FilterError("between: the first value is larger than the second")
        lit = moment if self.field.type == "datetime" else F.lit
        return Condition(self.col.between(lit(a), lit(b)))

    def before(self, value: str) -> Condition:
        self._allow("before")
        return Condition(self.col < self._bound(value, "<"))

    def after(self, value: str) -> Condition:
        self._allow("after")
        return Condition(self.col > self._bound(value, ">"))

    def like(self, pattern: str, ignore_case: bool = True) -> Condition:
        """Stored strings are in lower case, so the pattern is lowered unless told otherwise."""
        self._allow("like")
        if not isinstance(pattern, str) or not pattern:
            raise FilterError("like needs a pattern")
        return Condition(self.col.like(pattern.lower() if ignore_case else pattern))

    def isin(self, values: list) -> Condition:
        self._allow("in")
        if self.field.type == "array":
            return self.contains_any(values)
        self._list(values)
        return Condition(self.col.isin(*(literal(self.field.type, v) for v in values)))

    def not_in(self, values: list) -> Condition:
        """Scalars: holds for values outside the list, not for missing ones. Arrays: none of the values is in it."""
        self._allow("not in")
        if self.field.type == "array":
            return ~self.contains_any(values)
        self._list(values)
        return Condition(~self.col.isin(*(literal(self.field.type, v) for v in values)))

    def contains(self, value: Any) -> Condition:
        self._allow("array_contains")
        if isinstance(value, (list, tuple)):
            raise FilterError("array_contains takes one value")
        return Condition(F.array_contains(self.col, F.lit(literal(self.field.array_type, value)).cast(TYPES[self.field.array_type])))

    def contains_all(self, values: list) -> Condition:
        self._allow("array_contains_all")
        return Condition(F.size(F.array_except(self._list(values), self.col)) == 0)

    def contains_any(self, values: list) -> Condition:
        self._allow("array_contains_any")
        return Condition(F.arrays_overlap(self.col, self._list(values)))

    def includes(self, value: Any) -> Condition:
        """A list: all of it is in the array; else the value is."""
        return self.contains_all(value) if isinstance(value, (list, tuple)) else self.contains(value)

    def does_not_include(self, value: Any) -> Condition:
        """A list: none of it is in the array."""
        return ~(self.contains_any(value) if isinstance(value, (list, tuple)) else self.contains(value))

    def length(self, op: str, n: int) -> Condition:
        self._allow("array_length")
        if isinstance(n, bool) or not isinstance(n, int) or not 0 <= n <= self.field.limit:
            raise FilterError("a length is a whole number up to the field's max_length")
        if n == 0 and op in ("==", "=", "!="):
            raise FilterError("lengths are not compared with 0")
        return Condition(COMPARE[op](F.size(self.col), F.lit(n)))


def all_of(conditions) -> Condition:
    return reduce(operator.and_, conditions)


def any_of(conditions) -> Condition:
    return reduce(operator.or_, conditions)


def boolean_word(text: str) -> bool:
    """on/off, 1/0 and true/false as a boolean."""
    if text.lower() in TRUE:
        return True
    if text.lower() in FALSE:
        return False
    raise FilterError(f"{text!r} is no boolean")


NAMES = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def from_openai(spec: dict, schema: MetadataSchema, cols: dict[str, Column] | None = None) -> Condition:
    """{type: eq|ne|gt|gte|lt|lte|in|nin, key, value} or {type: and|or, filters: [...]}, to any depth."""
    kind = spec.get("type")
    if kind in ("and", "or"):
        parts = [from_openai(x, schema, cols) for x in spec.get("filters", [])]
        if not parts:
            raise FilterError(f"{kind} without filters")
        return (all_of if kind == "and" else any_of)(parts)
    for part in ("key", "value"):
        if part not in spec:
            raise FilterError(f"a {kind} filter needs a {part}")
    f = Field(schema, spec["key"], (cols or {}).get(spec["key"]))
    value = spec["value"]
    if kind in NAMES:
        return f.compare(NAMES[kind], value)
    if kind in ("in", "nin"):
        values = value if isinstance(value, list) else [value]
        return f.isin(values) if kind == "in" else f.not_in(values)
    raise FilterError(f"unknown filter type {kind}")


def wildcard(pattern: str) -> str:
    """* and ? as LIKE has them; what LIKE would take for its own signs is escaped."""
    signs = {"*": "%", "?": "_"}
    return "".join(signs.get(c, f"\\{c}" if c in "%_\\" else c) for c in pattern)


def from_query_dsl(clauses: list[dict] | dict, schema: MetadataSchema, cols: dict[str, Column] | None = None) -> Condition:
    """term, terms, range, wildcard and bool (must, filter, must_not, should with minimum_should_match) clauses; a list is a conjunction."""
    if isinstance(clauses, list):
        return all_of([from_query_dsl(c, schema, cols) for c in clauses]) if clauses else Condition(F.lit(True))
    if len(clauses) != 1:
        raise FilterError("a clause has one kind")
    ((kind, body),) = clauses.items()
    if not isinstance(body, dict) or not body:
        raise FilterError(f"{kind} needs a body")
    if kind == "bool":
        again = lambda k: [from_query_dsl(c, schema, cols) for c in (body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]])]
        parts = again("must") + again("filter") + [~c for c in again("must_not")]
        if should := again("should"):
            need = body.get("minimum_should_match", 0 if parts else 1)
            parts.append(Condition(reduce(operator.add, (c.flag().cast("int") for c in should)) >= need))
        return all_of(parts) if parts else Condition(F.lit(True))
    (name, value), *_ = body.items()
    f = Field(schema, name, (cols or {}).get(name))
    if kind == "term":
        return f.contains(value) if f.field.type == "array" else f.compare("==", value)
    if kind == "terms":
        return f.isin(value)
    if kind == "range":
        if not isinstance(value, dict) or not value or set(value) - set(NAMES):
            raise FilterError(f"a range takes {', '.join(NAMES)}")
        return all_of([f.compare(NAMES[k], v) for k, v in value.items()])
    if kind == "wildcard":
        if not isinstance(value, str):
            raise FilterError("wildcard needs a pattern")
        return f.like(wildcard(value))
    raise FilterError(f"unknown clause {kind}")


def per_collection(build, schemas: dict[str, MetadataSchema], partial: bool = False) -> dict[str, Condition]:
    """build(schema) for each collection. Strict: all must allow the condition; partial: those that do not are left out, one must."""
    found, refused = {}, {}
    for name, schema in schemas.items():
        try:
            found[name] = build(schema)
        except FilterError as e:
            refused[name] = str(e)
    if refused and not (partial and found):
        raise FilterError("; ".join(f"{k}: {v}" for k, v in refused.items()))
    return found
