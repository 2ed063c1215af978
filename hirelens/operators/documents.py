"""Filter documents, compiled to one Column.

A document maps fields to values or operator documents; several fields are
joined by "and"::

    {"status": "active", "$or": [{"city": {"$in": ["a", None]}}, {"link.job": {"$regex": "^https", "$options": "i"}}],
     "crawl_date": {"$gte": "2001-07-30"}, "search_keyword": "SRE"}

Fields: a column; a struct's field by its path (``link.job``); else a field of
the VARIANT column ``doc`` (``doc.x.y``, or ``x.y`` when no column has that name).

Operators: ``$eq $ne $gt $gte $lt $lte $in $nin $exists $regex`` (with
``$options``: i, m, s, x) ``$not $all $size $elemMatch`` on fields, ``$and $or $nor`` on
documents.  As in document stores, and unlike SQL: every condition is true or
false.  A null or missing field equals ``None`` only, so ``$ne``, ``$nin`` and
``$not`` hold for it; a comparison with a value of another kind (a text field
with a number) is false.  A list field fulfils a condition if one of its elements
does (or, for equality with a list, if it is that list).  Of a VARIANT's fields,
single values and lists of one kind are compared.

Conditions at the top and under ``$and`` stay plain comparisons, which Spark
pushes into the Parquet scan, ``$ne`` and ``$nin`` of columns too; other
negations are guarded against null.
"""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARE = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts, F.lit(False)) if len(parts) != 1 else parts[0]


def _all(parts: list[Column]) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


class Field:
    """A field of the filtered rows: its column and type; ``kind`` is None for a VARIANT's field, ``missing`` for none."""

    def __init__(self, schema: T.StructType, name: str):
        found = _path(schema, name)
        self.variant, self.missing = False, False
        if found is not None:
            self.column, self.kind = found
        elif "doc" in schema.fieldNames() and isinstance(schema["doc"].dataType, T.VariantType):
            self.variant, self.kind = True, None
            steps = "".join("['" + step.replace("\\", "\\\\").replace("'", "\\'") + "']" for step in name.removeprefix("doc.").split("."))
            self.path = f"${steps}"
            self.column = F.try_variant_get("doc", self.path, "variant")
        else:
            self.missing, self.kind, self.column = True, None, F.lit(None)

    def null(self) -> Column:
        return self.column.isNull() | F.is_variant_null(self.column) if self.variant else self.column.isNull()

    def compare(self, value, test: Callable[[Column, Column], Column]) -> Column:
        """``test`` of the field, or of one of its elements, with a value of the field's kind."""
        if self.missing:
            return F.lit(False)
        if self.variant:
            kind = _variant_kind(value)
            one = F.try_variant_get("doc", self.path, kind)
            many = F.try_variant_get("doc", self.path, f"array<{kind}>")
            shape = F.schema_of_variant(self.column)
            names = {"string": "^(ARRAY<)?STRING>?$", "boolean": "^(ARRAY<)?BOOLEAN>?$",
                     "double": "^(ARRAY<)?(BIGINT|DOUBLE|FLOAT|DECIMAL.*)>?$"}[kind]
            return shape.rlike(names) & F.when(shape.startswith("ARRAY"), F.exists(many, lambda e: test(e, F.lit(value)))) \
                .otherwise(test(one, F.lit(value)))
        if isinstance(self.kind, T.ArrayType):
            v = _literal(value, self.kind.elementType)
            return F.lit(False) if v is None else F.exists(self.column, lambda e: test(e, v))
        v = _literal(value, self.kind)
        return F.lit(False) if v is None else test(self.column, v)


def _path(schema: T.StructType, name: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a field by its whole name or its path through structs."""
    if name in schema.fieldNames():
        return F.col(f"`{name}`"), schema[name].dataType
    head, *rest = name.split(".")
    if head not in schema.fieldNames():
        return None
    column, kind = F.col(f"`{head}`"), schema[head].dataType
    for step in rest:
        if not isinstance(kind, T.StructType) or step not in kind.fieldNames():
            return None
        column, kind = column[step], kind[step].dataType
    return column, kind


def _variant_kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"


def _literal(value, kind: T.DataType) -> Column | None:
    """``value`` as a literal of the field's kind; None if it is of another kind."""
    if isinstance(kind, T.BooleanType) or isinstance(value, bool):
        return F.lit(value) if isinstance(kind, T.BooleanType) and isinstance(value, bool) else None
    if isinstance(kind, T.NumericType):
        return F.lit(value) if isinstance(value, (int, float)) else None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            try:
                value = dt.date.fromisoformat(value) if isinstance(kind, T.DateType) else dt.datetime.fromisoformat(value)
            except ValueError:
                return None
        return F.lit(value) if isinstance(value, dt.date) else None
    if isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    return None


def _equal(field: Field, value) -> Column:
    if value is None:
        return field.null()
    if isinstance(value, (list, tuple)):
        if not isinstance(field.kind, T.ArrayType):
            return F.lit(False)
        kind = field.kind.elementType
        items = [F.lit(None).cast(kind) if v is None else _literal(v, kind) for v in value]
        return F.lit(False) if any(i is None for i in items) else field.column == F.array(*items).cast(field.kind)
    return field.compare(value, operator.eq)


def _among(field: Field, values: list) -> Column:
    """``$in``: one pushed ``IN`` for the plain values of a plain column."""
    plain = [v for v in values if v is not None and not isinstance(v, (list, tuple))]
    other = [_equal(field, v) for v in values if v is None or isinstance(v, (list, tuple))]
    if plain and not (field.variant or field.missing or isinstance(field.kind, T.ArrayType)):
        known = [c for c in (_literal(v, field.kind) for v in plain) if c is not None]
        return _any([*([field.column.isin(*known)] if known else []), *other])
    return _any([*[_equal(field, v) for v in plain], *other])


def _not_among(field: Field, values: list) -> Column:
    """``$ne`` / ``$nin``: for plain columns a condition that the scan understands."""
    found = _among(field, values)
    if field.variant or field.missing or isinstance(field.kind, T.ArrayType):
        return ~_sure(found)
    known = [c for c in (_literal(v, field.kind) for v in values) if c is not None]
    other = ~field.column.isin(*known) if known else F.lit(True)
    return field.column.isNotNull() & other if None in values else field.column.isNull() | other


def _regex(field: Field, pattern: str, options: str) -> Column:
    if set(options) - set("imsx"):
        raise ValueError(f"unknown regex options {options!r}")
    text = f"(?{options}){pattern}" if options else pattern
    kind = field.kind.elementType if isinstance(field.kind, T.ArrayType) else field.kind
    if field.missing or (not field.variant and not isinstance(kind, T.StringType)):
        return F.lit(False)
    return field.compare("", lambda c, _: c.rlike(text))


def _conditions(schema: T.StructType, name: str, condition) -> Column:
    """A field's condition: a value, or a document of operators that must all hold."""
    field = Field(schema, name)
    if not isinstance(condition, dict) or not any(str(k).startswith("$") for k in condition):
        return _equal(field, condition)
    parts = []
    for op, value in condition.items():
        if op == "$eq":
            parts.append(_equal(field, value))
        elif op == "$ne":
            parts.append(_not_among(field, [value]))
        elif op in COMPARE:
            if value is None:  # as in document stores: null is only as large as itself
                parts.append(field.null() if op in ("$gte", "$lte") else F.lit(False))
            else:
                parts.append(field.compare(value, COMPARE[op]))
        elif op == "$in":
            parts.append(_among(field, list(value)))
        elif op == "$nin":
            parts.append(_not_among(field, list(value)))
        elif op == "$exists":
            # in a table of columns a null is a missing field; in a VARIANT a null is there
            there = F.lit(False) if field.missing else field.column.isNotNull()
            parts.append(there if value else ~there)
        elif op == "$regex":
            parts.append(_regex(field, value, condition.get("$options", "")))
        elif op == "$options":
            if "$regex" not in condition:
                raise ValueError("$options without $regex")
        elif op == "$not":
            parts.append(~_sure(_conditions(schema, name, value)))
        elif op == "$all":
            parts.append(_all([_equal(field, v) for v in value]) if value else F.lit(False))
        elif op == "$size":
            if field.variant:
                parts.append(F.size(F.try_variant_get("doc", field.path, "array<variant>")) == value)
            else:
                parts.append(F.size(field.column) == value if isinstance(field.kind, T.ArrayType) else F.lit(False))
        elif op == "$elemMatch":
            if not isinstance(field.kind, T.ArrayType):
                parts.append(F.lit(False))
            else:
                parts.append(_some_element(field, value))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return _all(parts)


def _some_element(field: Field, condition: dict) -> Column:
    return F.exists(field.column, lambda e: _element(e, field.kind.elementType, condition))


def _element(element: Column, kind: T.DataType, condition: dict) -> Column:
    """All conditions on one element of a list."""
    one = Field(T.StructType(), "element")
    one.missing, one.column, one.kind = False, element, kind
    parts = []
    for op, value in condition.items():
        if op in COMPARE:
            parts.append(one.compare(value, COMPARE[op]))
        elif op in ("$eq", "$ne"):
            parts.append(_equal(one, value) if op == "$eq" else ~_sure(_equal(one, value)))
        elif op in ("$in", "$nin"):
            parts.append(_among(one, list(value)) if op == "$in" else ~_sure(_among(one, list(value))))
        elif op == "$regex":
            parts.append(_regex(one, value, condition.get("$options", "")))
        elif op != "$options":
            raise ValueError(f"unknown operator {op!r} in $elemMatch")
    return _all(parts)


def matches(schema: T.StructType, document: dict | None) -> Column:
    """Whether a row of ``schema`` matches a filter document; an empty document matches every row."""
    parts = []
    for name, value in (document or {}).items():
        if name in ("$and", "$or", "$nor"):
            if not value:
                raise ValueError(f"{name} needs a list of documents")
            inner = [matches(schema, d) for d in value]
            parts.append(_all(inner) if name == "$and" else _any(inner) if name == "$or"
                         else ~_any([_sure(c) for c in inner]))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name!r}")
        else:
            parts.append(_conditions(schema, name, value))
    return _all(parts)


def find(df: DataFrame, document: dict | None = None, limit: int = 0) -> DataFrame:
    """The rows that match a filter document; ``limit=0`` means all of them."""
    out = df.where(matches(df.schema, document)) if document else df
    return out.limit(limit) if limit and limit > 0 else out
