"""Collections as Columns: what a path yields, statically typed by the schema of its input."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.documents import NUMBER_MARK, SOURCE_NUMBER

ANY_TYPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("type", T.StringType())])
DECIMAL = T.DecimalType(38, 18)
QUANTITY_TYPE = T.StructType([T.StructField("value", DECIMAL), T.StructField("unit", T.StringType())])
TEXT_KINDS = ("String", "Date", "DateTime")
NUMBER_KINDS = ("Integer", "Decimal")


@dataclass(frozen=True)
class Coll:
    """A collection. ``many``: an array without nulls, never null itself; else one value, null where empty.

    ``error``: true for rows in which evaluation fails. ``alternatives``: the typed forms of a choice element, at most one of which is
    not empty in a row; ``col`` is not used then. ``kind`` Any has items of ANY_TYPE, of mixed types. Decimals of JSON documents
    are their source texts (a dtype of string) until something is computed from them. ``stored``: ``col``, and the array of the table it was made
    of, of which a member step reads that member only. ``wide``: decimals that are computed to 28 digits, as texts; sums of such are, too.
    """

    col: Column | None
    dtype: T.DataType
    kind: str
    many: bool = False
    error: Column | None = None
    type_name: str | None = None
    alternatives: tuple[Coll, ...] = ()
    stored: tuple[Column, Column] | None = None
    wide: bool = False

    def member(self, name: str) -> Column:
        """The field of the items, nulls among them where this is an array."""
        return (self.stored[1] if self.stored and self.stored[0] is self.col else self.col).getField(name)

    def with_error(self, *errors: Column | None) -> Coll:
        found = [e for e in (self.error, *errors) if e is not None]
        return replace(self, error=reduce(lambda a, b: a | b, (F.coalesce(e, F.lit(False)) for e in found)) if found else None)


def simple(x: Column) -> bool:
    """A column, a lambda's variable, or a field of one: what may be named again at no cost."""
    return re.fullmatch(r"Column<'(namedlambdavariable\(\)|[\w.`\[\]']+)'>", str(x)) is not None


def let(x: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that it names several times, but that is computed, and stands in the plan, once."""
    return make(x) if simple(x) else F.get(F.transform(F.array(x), make), F.lit(0))


def empty(error: Column | None = None) -> Coll:
    return Coll(F.lit(None).cast("string"), T.StringType(), "Empty", error=error)


def scalar(col: Column, kind: str, *errors: Column | None) -> Coll:
    dtype = {"Boolean": T.BooleanType(), "Integer": T.LongType(), "Decimal": DECIMAL, "Quantity": QUANTITY_TYPE}.get(kind, T.StringType())
    return Coll(col, dtype, kind).with_error(*errors)


def array(col: Column, like: Coll, *errors: Column | None) -> Coll:
    return Coll(col, like.dtype, like.kind, True, like.error, like.type_name, wide=like.wide).with_error(*errors)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if isinstance(dtype, T.IntegralType):
        return "Integer"
    if isinstance(dtype, T.DecimalType | T.FractionalType):
        return "Decimal"
    if isinstance(dtype, T.StructType):
        return "Complex"
    if isinstance(dtype, T.VariantType | T.MapType):
        raise TypeError(f"paths need a struct, not {dtype.simpleString()}; parse the documents with a schema first")
    if isinstance(dtype, T.NullType):
        return "Empty"
    return "String"


def variant_items(v: Column, type_name: str | None = None, depth: int = 4) -> Column:
    """The items of a part of mixed kinds, each with its own kind. Arrays are flattened; within so many others they are an item of kind Array, which fits nothing."""

    def one(x: Column, shape: Column) -> Column:
        text = x.try_cast("string")
        number = text.startswith(NUMBER_MARK)
        of_texts = "Date" if type_name == "Date" else "DateTime" if type_name == "DateTime" else "String"
        kind = (
            F.when(shape == "BOOLEAN", "Boolean").when(shape == "BIGINT", "Integer").when(shape.startswith("OBJECT"), "Complex").when(shape.startswith("ARRAY"), "Array")
            .when(shape == "STRING", F.when(number, "Decimal").otherwise(of_texts)).otherwise("Decimal")
        )
        told = F.when(kind.isin("Complex", "Array"), F.to_json(x)).when((shape == "STRING") & number, F.substr(text, F.lit(2))).otherwise(text)
        named = F.lit(type_name).cast("string") if type_name else F.when(shape.startswith("OBJECT"), F.try_variant_get(x, "$.resourceType", "string"))
        return F.struct(kind.alias("kind"), told.alias("text"), named.alias("type"))

    def some(x: Column) -> Column:
        shape = F.schema_of_variant(x)
        none = F.array().cast(T.ArrayType(ANY_TYPE))
        flat = F.flatten(F.transform(x.try_cast("array<variant>"), lambda y: variant_items(y, type_name, depth - 1))) if depth else F.array(one(x, shape))
        return F.when(x.isNull() | (shape == "VOID"), none).when(shape.startswith("ARRAY"), flat).otherwise(F.array(one(x, shape))).cast(T.ArrayType(ANY_TYPE))

    return let(v, some)


def of_column(col: Column, dtype: T.DataType, type_name: str | None = None) -> Coll:
    """A column of documents, or any part of one. Arrays are flattened and lose their nulls. Variants within documents are parts of mixed kinds."""
    base = dtype
    while isinstance(base, T.ArrayType):
        base = base.elementType
    if isinstance(base, T.VariantType):
        while isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
            col, dtype = F.flatten(F.array_compact(col)), dtype.elementType
        if isinstance(dtype, T.ArrayType):
            col = F.flatten(F.transform(F.coalesce(col, F.array().cast(dtype)), lambda x: variant_items(x, type_name)))
        else:
            col = variant_items(col, type_name)
        return Coll(col, ANY_TYPE, "Any", True, type_name=type_name)
    if isinstance(dtype, T.ArrayType):
        while isinstance(dtype.elementType, T.ArrayType):
            col, dtype = F.flatten(F.array_compact(col)), dtype.elementType
        some = F.coalesce(F.array_compact(col), F.array().cast(dtype))
        return Coll(some, dtype.elementType, kind_of(dtype.elementType), True, type_name=type_name, stored=(some, col))
    return Coll(col, dtype, kind_of(dtype), type_name=type_name)


def items(c: Coll) -> Column:
    """The items as an array."""
    c = merged(c)
    if c.many:
        return c.col
    return F.array_compact(F.array(c.col)) if c.kind != "Empty" else F.array().cast(T.ArrayType(c.dtype))


def size(c: Coll) -> Column:
    c = merged(c)
    if c.kind == "Empty":
        return F.lit(0).cast("long")
    return F.size(c.col).cast("long") if c.many else c.col.isNotNull().cast("long")


def present(c: Coll) -> Column:
    c = merged(c)
    if c.kind == "Empty":
        return F.lit(False)
    return F.size(c.col) > 0 if c.many else c.col.isNotNull()


def single(c: Coll) -> Coll:
    """The only item; more than one is an error."""
    c = merged(c)
    if not c.many:
        return c
    return replace(c, col=F.get(c.col, F.lit(0)), many=False).with_error(F.size(c.col) > 1)


#: What an item of kind Any is read as, by its kind.
_READ = {"Boolean": T.BooleanType(), "Integer": T.LongType(), "Decimal": T.StringType(), "String": T.StringType(), "Date": T.StringType(), "DateTime": T.StringType()}


def forms(c: Coll, quantities: bool = True) -> list[tuple[Column, Coll]]:
    """What one item can be: the condition of each kind, and the item as that, null where it is another. An item of a known kind is one form. ``quantities``:
    whether objects with a number and a unit are ones."""
    if c.kind != "Any" or c.many:
        return [(F.lit(True), c)]
    typed = lambda k, t: F.when(c.col["kind"] == k, c.col["text"].try_cast(t))
    out = [(c.col["kind"] == k, Coll(typed(k, t), t, k)) for k, t in _READ.items()]
    if not quantities:
        other = c.col["kind"].isin("Complex", "Array", "Quantity")
        return [*out, (other, Coll(F.when(other, c.col["text"]), T.StringType(), "Object"))]
    parsed = F.try_parse_json(F.when(c.col["kind"] == "Complex", c.col["text"]))
    value, unit = F.try_variant_get(parsed, "$.value", "string"), F.coalesce(F.try_variant_get(parsed, "$.code", "string"), F.try_variant_get(parsed, "$.unit", "string"))
    number = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.value", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") | value.startswith(NUMBER_MARK), F.ltrim(value, F.lit(NUMBER_MARK)).try_cast(DECIMAL))
    amount = F.when(number.isNotNull() & unit.isNotNull(), F.struct(number.alias("value"), unit.alias("unit")))
    out.append((amount.isNotNull(), Coll(amount, QUANTITY_TYPE, "Quantity")))
    other = c.col["kind"].isin("Complex", "Array") & amount.isNull()
    return [*out, (other, Coll(F.when(other, c.col["text"]), T.StringType(), "Object"))]


def by_form(cases: list[tuple[Column, Coll]], *errors: Column | None) -> Coll:
    """The result of the case whose condition holds, at most one does: of its own kind where all cases have one, else of kind Any."""
    errors = (*errors, *(F.coalesce(when, F.lit(False)) & got.error for when, got in cases if got.error is not None))
    cases = [(when, merged(got)) for when, got in cases]
    cases = [(when, got) for when, got in cases if got.kind != "Empty"]
    if not cases:
        return empty().with_error(*errors)
    first = cases[0][1]
    if len({(got.kind, got.dtype.simpleString(), got.many) for _, got in cases}) == 1:
        if first.many:
            return replace(first, col=F.concat(*(F.when(F.coalesce(when, F.lit(False)), got.col).otherwise(F.array().cast(T.ArrayType(got.dtype))) for when, got in cases)), error=None).with_error(*errors)
        return replace(first, col=F.coalesce(*(F.when(when, got.col) for when, got in cases)), error=None).with_error(*errors)
    none = F.array().cast(T.ArrayType(ANY_TYPE))
    parts = F.concat(*(F.when(F.coalesce(when, F.lit(False)), items(as_any(got))).otherwise(none) for when, got in cases))
    many = any(got.many for _, got in cases)
    return Coll(parts if many else F.get(parts, F.lit(0)), ANY_TYPE, "Any", many).with_error(*errors)


def as_any(c: Coll) -> Coll:
    """Items with their kind and text, for collections of mixed types. Texts of complex items are their JSON."""
    if c.alternatives:
        parts = [items(as_any(a)) for a in c.alternatives]
        return Coll(F.concat(*parts), ANY_TYPE, "Any", True, c.error)
    if c.kind == "Any":
        return c
    if c.kind == "Empty":
        return Coll(F.array().cast(T.ArrayType(ANY_TYPE)), ANY_TYPE, "Any", True, c.error)

    def one(x: Column) -> Column:
        return F.struct(F.lit(c.kind).alias("kind"), text_of(x, c.kind, c.dtype).alias("text"), F.lit(c.type_name).cast("string").alias("type"))

    return Coll(F.transform(items(c), one), ANY_TYPE, "Any", True, c.error)


def _has_numbers(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(f.metadata.get(SOURCE_NUMBER) or _has_numbers(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.ArrayType) and _has_numbers(dtype.elementType)


def _marked(x: Column, dtype: T.DataType, number: bool = False) -> Column:
    """An object whose numbers that are source texts have a mark, so that its JSON tells them from texts."""
    if isinstance(dtype, T.ArrayType) and (number or _has_numbers(dtype)):
        return F.transform(x, lambda y: _marked(y, dtype.elementType, number))
    if number:
        return F.concat(F.lit(NUMBER_MARK), F.ltrim(x, F.lit(NUMBER_MARK)))
    if not isinstance(dtype, T.StructType) or not _has_numbers(dtype):
        return x
    make = lambda y: F.when(y.isNotNull(), F.struct(*(_marked(y[f.name], f.dataType, bool(f.metadata.get(SOURCE_NUMBER))).alias(f.name) for f in dtype.fields)))
    return let(x, make)


def unmarked(json: Column) -> Column:
    """JSON with its marked numbers as numbers."""
    return F.regexp_replace(json, r'"\\u0003(-?[0-9][0-9.eE+-]*)"', "$1")


def text_of(x: Column, kind: str, dtype: T.DataType) -> Column:
    if kind in TEXT_KINDS or kind == "Untyped":
        return x
    if kind == "Complex":
        return F.to_json(_marked(x, dtype))
    if kind == "Quantity":
        return let(x, lambda q: F.concat(number_text(q["value"], DECIMAL), F.lit(" '"), q["unit"], F.lit("'")))
    if kind == "Any":
        return x["text"]
    return number_text(x, dtype) if kind == "Decimal" else x.cast("string")


def numeric(c: Coll) -> Coll:
    """Decimals that are source texts as numbers."""
    if c.alternatives:
        return replace(c, alternatives=tuple(map(numeric, c.alternatives)))
    if c.kind != "Decimal" or not isinstance(c.dtype, T.StringType):
        return c
    to = lambda x: x.try_cast(DECIMAL)
    return replace(c, col=F.array_compact(F.transform(c.col, to)) if c.many else to(c.col), dtype=DECIMAL)


def number_text(x: Column, dtype: T.DataType) -> Column:
    """A decimal without the zeros that its column's scale adds; a source text as it is, but for exponents."""
    if isinstance(dtype, T.StringType):
        return let(x, lambda t: F.when(F.lower(t).contains("e"), number_text(t.try_cast(DECIMAL), DECIMAL)).otherwise(t))
    text = x.cast(DECIMAL).cast("string") if not isinstance(dtype, T.DecimalType) else x.cast("string")
    return let(text, lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t))


def merged(c: Coll) -> Coll:
    """A choice as one collection: of its own kind where all alternatives agree, else of kind Any."""
    if not c.alternatives:
        return c
    if len({(a.kind, a.dtype.simpleString(), a.many) for a in c.alternatives}) == 1:
        a = c.alternatives[0]
        col = F.concat(*(x.col for x in c.alternatives)) if a.many else F.coalesce(*(x.col for x in c.alternatives))
        return replace(a, col=col, error=c.error, type_name=a.type_name if len({x.type_name for x in c.alternatives}) == 1 else None)
    return as_any(c)


def for_each(c: Coll, make: Callable[[Coll], Coll]) -> tuple[Column, Coll]:
    """``make`` of each item as an array of its results; also a result as a sample of their type."""
    c = merged(c)
    sample: list[Coll] = []

    def one(x: Column) -> Column:
        got = make(replace(c, col=x, many=False, error=None))
        sample.append(got)
        return items(got)

    nested = F.transform(items(c), one)
    return F.flatten(nested), merged(sample[-1])


def item_errors(c: Coll, make: Callable[[Coll], Coll]) -> Column | None:
    """True where ``make`` fails for any item."""
    c = merged(c)
    got = make(replace(c, col=F.lit(None), many=False, error=None)) if c.kind == "Empty" else None
    if got is not None:
        return None
    seen: list[Column | None] = []

    def one(x: Column) -> Column:
        e = make(replace(c, col=x, many=False, error=None)).error
        seen.append(e)
        return F.lit(False) if e is None else F.coalesce(e, F.lit(False))

    out = F.exists(items(c), one)
    return out if any(e is not None for e in seen) else None
