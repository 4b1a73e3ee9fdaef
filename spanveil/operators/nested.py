"""Nested tables: strings inside structs, arrays, maps and JSON text.

All strings of a row are taken out, in the order of the schema, into one array that is searched
as one, so the plan doesn't grow with the schema. Where a string goes back is counted:
the schema says how many strings come before it, and running sums do where that depends on
the row. Nothing is looked up and nothing is shuffled.

A path is written ``contact.mail``, ``entries[].value`` for the elements of an array and
``labels{}`` for the values of a map. Keys of maps, and columns without strings, stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from spanveil.functions.arrays import let, running_sum
from spanveil.functions.rules import STRUCTURED_RULES, Rule
from spanveil.functions.spans import empty_of, splice
from spanveil.functions.stages import RESOLVE, raw_stage, sealed, span_stages, stage_fields
from spanveil.operators.columns import hit_rates
from spanveil.operators.sanitize import replacer


def _has_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, MapType):
        return _has_text(kind.valueType)
    return isinstance(kind, StringType)


def _fixed_number(kind: DataType) -> int | None:
    """How many strings a value holds, None if that depends on the value."""
    if isinstance(kind, StructType):
        parts = [_fixed_number(f.dataType) for f in kind.fields]
        return None if None in parts else sum(parts)
    if isinstance(kind, (ArrayType, MapType)):
        return None if _has_text(kind) else 0
    return int(isinstance(kind, StringType))


def _number(kind: DataType, value: Column) -> Column:
    """How many strings a value holds; a null struct holds null strings, a null array none."""
    fixed = _fixed_number(kind)
    if fixed is not None:
        return F.lit(fixed)
    if isinstance(kind, StructType):
        total = F.lit(0)
        for f in kind.fields:
            if _has_text(f.dataType):
                total = total + _number(f.dataType, value.getField(f.name))
        return total
    element, values = _elements(kind, value)
    fixed = _fixed_number(element)
    if fixed is not None:
        return F.when(values.isNull(), 0).otherwise(F.size(values) * fixed)
    each = F.transform(values, lambda v: _number(element, v))
    return F.coalesce(F.aggregate(each, F.lit(0), lambda acc, n: acc + n), F.lit(0))


def _elements(kind: DataType, value: Column) -> tuple[DataType, Column]:
    """What an array or a map holds."""
    if isinstance(kind, MapType):
        return kind.valueType, F.map_values(value)
    return kind.elementType, value


def _cells(kind: DataType, value: Column, path: str) -> Column:
    """``array<struct<column,text>>``: the strings of a value, of a kind that has some."""
    if isinstance(kind, StringType):
        return F.array(F.struct(F.lit(path).alias("column"), value.alias("text")))
    if isinstance(kind, StructType):
        parts = [
            _cells(f.dataType, value.getField(f.name), f"{path}.{f.name}")
            for f in kind.fields
            if _has_text(f.dataType)
        ]
        return F.concat(*parts)
    element, values = _elements(kind, value)
    inside = path + ("{}" if isinstance(kind, MapType) else "[]")
    found = F.flatten(F.transform(values, lambda v: _cells(element, v, inside)))
    return F.coalesce(found, empty_of("struct<column:string,text:string>"))


def _put_back(kind: DataType, value: Column, done: Column, first: Column) -> Column:
    """The value with its strings taken from ``done``, from the place ``first`` on."""
    if not _has_text(kind):
        return value
    if isinstance(kind, StringType):
        return F.get(done, first)
    if isinstance(kind, StructType):
        fields, at = [], first
        for f in kind.fields:
            part = value.getField(f.name)
            fields.append(_put_back(f.dataType, part, done, at).alias(f.name))
            if _has_text(f.dataType):
                at = at + _number(f.dataType, part)
        return F.when(value.isNotNull(), F.struct(*fields))
    element, values = _elements(kind, value)
    fixed = _fixed_number(element)

    def each(place) -> Column:
        return F.transform(values, lambda v, i: _put_back(element, v, done, first + place(i)))

    if fixed is not None:
        replaced = each(lambda i: i * fixed)
    else:
        numbers = F.transform(values, lambda v: _number(element, v))
        replaced = F.when(
            values.isNotNull(),
            let(running_sum(numbers), lambda before: each(lambda i: F.get(before, i))),
        )
    return F.map_from_arrays(F.map_keys(value), replaced) if isinstance(kind, MapType) else replaced


def _same_json(a: Column, b: Column) -> Column:
    """Whether two texts are JSON of one value."""
    one, other = (F.to_json(F.try_parse_json(t)) for t in (a, b))
    return F.coalesce(one == other, F.lit(False))


@dataclass(frozen=True)
class _Place:
    """A column that holds strings; JSON text has a column of its parsed value besides."""

    name: str
    kind: DataType
    parsed: str | None = None

    @property
    def value(self) -> Column:
        return F.col(f"`{self.parsed or self.name}`")

    def _rest(self) -> Column:
        return F.when(self.value.isNull(), F.col(f"`{self.name}`"))

    def cells(self) -> Column:
        found = _cells(self.kind, self.value, self.name)
        return found if self.parsed is None else F.concat(found, _cells(StringType(), self._rest(), self.name))

    def number(self) -> Column:
        found = _number(self.kind, self.value)
        return found if self.parsed is None else found + 1

    def put_back(self, done: Column, first: Column) -> Column:
        new = _put_back(self.kind, self.value, done, first)
        if self.parsed is None:
            return new
        rest = F.get(done, first + _number(self.kind, self.value))
        return F.when(self.value.isNotNull(), F.to_json(new)).otherwise(rest)


def _places(
    df: DataFrame, columns: Sequence[str] | None, json: Mapping[str, str]
) -> tuple[DataFrame, list[_Place]]:
    """The columns with strings; JSON text is parsed if its schema tells all that it holds."""
    names = list(columns) if columns is not None else df.columns
    places = []
    for name in names:
        kind = df.schema[name].dataType
        if name in json:
            text, parsed = F.col(f"`{name}`"), f"__json_{name}"
            value = F.from_json(text, json[name])
            df = df.withColumn(parsed, F.when(_same_json(text, F.to_json(value)), value))
            places.append(_Place(name, df.schema[parsed].dataType, parsed))
        elif _has_text(kind):
            places.append(_Place(name, kind))
    return df, places


def scan_nested(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    json: Mapping[str, str] | None = None,
    rules: Sequence[Rule] = STRUCTURED_RULES,
) -> DataFrame:
    """Per path and entity type: strings with hits, hits and their share of the strings at the path.

    ``json`` gives the schema of columns of JSON text, as DDL of a struct. Text that isn't
    JSON, or holds more than its schema, is searched as it stands, under the path of its column.
    """
    df, places = _places(df, columns, json or {})
    if not places:
        raise ValueError("no column holds strings")
    cells = df.select(F.explode(F.concat(*[p.cells() for p in places])).alias("cell"))
    return hit_rates(cells.select("cell.*"), rules)


def sanitize_nested(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    json: Mapping[str, str] | None = None,
    mode: str = "mask",
    key: str | None = None,
    rules: Sequence[Rule] = STRUCTURED_RULES,
) -> DataFrame:
    """The table, in its own schema, with every string inside the columns sanitized.

    ``json`` is as in ``scan_nested``; parsed JSON is written again without spaces between its
    parts. Nulls, empty arrays and maps stay as they are. All columns are meant if none are named.
    """
    names = df.columns
    df, places = _places(df, columns, json or {})
    if not places:
        return df
    replace = replacer(mode, key, rules)
    parsed = [p.parsed for p in places if p.parsed]
    stages = [*span_stages(rules, addresses=True), raw_stage(addresses=True), *RESOLVE]
    cells = F.concat(*[p.cells() for p in places])
    staged = stage_fields(df.withColumn("__cells", cells), "__cells", stages)
    rebuilt = F.transform(
        F.col("__cells"),
        lambda c: F.when(c["text"].isNotNull(), splice(c["text"], c["resolved"], replace)),
    )
    done = sealed(staged, [*names, *parsed], rebuilt, "__done")
    new, first = {}, F.lit(0)
    for place in places:
        new[place.name] = place.put_back(F.col("__done"), first).alias(place.name)
        first = first + place.number()
    return done.select(*[new.get(c, F.col(f"`{c}`")) for c in names])
