"""Metadata schemas of collections: typed fields, their Spark types, and the rules that values meet on the way in."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import read

RESERVED = ("type", "subtype", "location")
SYSTEM = ("filename", "page_number", "start_time", "end_time")
TYPES = {"string": T.StringType(), "datetime": T.TimestampType(), "number": T.DoubleType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType()}
# The words for booleans.
TRUE, FALSE = ("true", "1", "on"), ("false", "0", "off")
MAX_STRING, MAX_ARRAY = 65535, 1000
EQUAL, ORDER, LIST = ("==", "=", "!="), (">", ">=", "<", "<=", "between"), ("in", "not in")
#: The operators that each type allows.
OPERATORS = {
    "string": (*EQUAL, "like", *LIST),
    "datetime": (*EQUAL, *ORDER, "before", "after"),
    "number": (*EQUAL, *ORDER, *LIST),
    "integer": (*EQUAL, *ORDER, *LIST),
    "float": (*EQUAL, *ORDER, *LIST),
    "boolean": EQUAL,
    "array": (*EQUAL, "includes", "does not include", *LIST, "array_contains", "array_contains_all", "array_contains_any", "array_length"),
}


@dataclass(frozen=True)
class MetadataField:
    name: str
    type: str = "string"
    array_type: str | None = None
    required: bool = False
    max_length: int | None = None
    user_defined: bool = True
    description: str = ""

    def __post_init__(self):
        if not self.name.strip() or self.name != self.name.strip():
            raise ValueError("a field's name must not be empty or padded")
        if self.name in RESERVED:
            raise ValueError(f"{self.name} is reserved")
        if self.type not in (*TYPES, "array"):
            raise ValueError(f"unknown type {self.type}")
        if (self.type == "array") != (self.array_type is not None):
            raise ValueError("array_type goes with arrays alone")
        if self.array_type is not None and (self.array_type not in TYPES or self.array_type == "datetime"):
            raise ValueError(f"unknown array_type {self.array_type}")
        if self.max_length is not None and (self.type not in ("string", "array") or self.max_length <= 0):
            raise ValueError("max_length is positive and goes with strings and arrays alone")

    @property
    def limit(self) -> int:
        return self.max_length or (MAX_ARRAY if self.type == "array" else MAX_STRING)

    @property
    def spark_type(self) -> T.DataType:
        return T.ArrayType(TYPES[self.array_type]) if self.type == "array" else TYPES[self.type]


@dataclass(frozen=True)
class MetadataSchema:
    fields: tuple[MetadataField, ...] = field(default_factory=tuple)

    def __post_init__(self):
        object.__setattr__(self, "fields", tuple(self.fields))
        names = [f.name for f in self.fields]
        if len(names) != len(set(names)):
            raise ValueError("field names must be unique")

    def __getitem__(self, name: str) -> MetadataField:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"unknown field {name}; available: {', '.join(sorted(f.name for f in self.fields))}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type) for f in self.fields])

    def extended(self) -> MetadataSchema:
        """With the system's fields that the user has not declared."""
        kinds = {"filename": "string", "page_number": "integer", "start_time": "integer", "end_time": "integer"}
        return MetadataSchema((*self.fields, *(MetadataField(n, kinds[n], user_defined=False) for n in SYSTEM if n not in self)))


def normalized(f: MetadataField, raw: Column) -> Column:
    """The stored value of a raw one (text; a list of texts for arrays), null where it has none or is wrong."""
    if f.type == "string":
        s = F.lower(F.trim(raw))
        return F.when((s != "") & (F.length(s) <= f.limit), s)
    if f.type == "datetime":
        return read(raw)
    if f.type == "boolean":
        return F.when(F.lower(raw).isin(*TRUE), True).when(F.lower(raw).isin(*FALSE), False)
    if f.type == "array":
        item = (lambda x: F.lower(x)) if f.array_type == "string" else (lambda x: x.try_cast(TYPES[f.array_type]))
        values = F.transform(raw, item)
        return F.when((F.size(values) <= f.limit) & ~F.exists(values, lambda x: x.isNull()), values)
    return raw.try_cast(TYPES[f.type])


def problem(f: MetadataField, raw: Column) -> Column:
    """What is wrong with a raw value, or null. Dates and booleans must not be empty even where they may be left out."""
    empty = F.size(raw) == 0 if f.type == "array" else F.trim(raw) == ""
    none = raw.isNull() | F.coalesce(empty, F.lit(False))
    missing = none if f.required or f.type in ("datetime", "boolean") else F.lit(False)
    bad = ~none & normalized(f, raw).isNull()
    return F.when(missing, F.lit(f"{f.name}: missing")).when(bad, F.lit(f"{f.name}: not a valid {f.type}"))
