"""FHIRPath trees to Columns: navigation, operators and types. Functions are in ``functions.library``."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal, localcontext
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decimals, temporal
from ..sources.documents import JSON_TEXT, MARKED, NUMBER_MARK, SOURCE_NUMBER
from .syntax import Binary, Call, Index, Literal, Member, Name, PathError, This, TypeTest, parse
from .values import (
    ANY_TYPE, DECIMAL, NUMBER_KINDS, TEXT_KINDS, Coll, array, as_any, by_form, empty, for_each, forms, items, let, merged, number_text, numeric, of_column, present, scalar,
    simple, single, text_of, unmarked, variant_items,
)

_TYPES = {"boolean": "Boolean", "integer": "Integer", "decimal": "Decimal", "date": "Date", "datetime": "DateTime", "quantity": "Quantity"}
#: Type names that a plain text matches, whatever its shape (fixed values).
_TEXT_TYPES = ("string", "code", "uri", "id")
#: Functions that leave items out and keep the others as they are.
_SOME = ("where", "first", "last", "tail", "skip", "take", "single")


_NUMBERS = count()
_STEP = r"__step\d+__"


@dataclass(frozen=True)
class Lookup:
    """A step that is a join: a map from the reference texts in column ``texts`` to the resources they name."""

    texts: str


class Compiler:
    """Compiles trees for one root. ``steps``: where given, the value and the error of each step of a path become columns of their own, which later
    steps name: (name, column) in order, for ``with_steps``. Plans then grow with the number of steps. Inside of lambdas, where columns cannot be, ``let``
    does the same. ``target``: the type of the resources that resolve() finds; without one, or without steps, it finds none.
    """

    def __init__(self, steps: list[tuple[str, Column | Lookup]] | None = None, target: T.StructType | None = None):
        self.steps, self.target, self.inside = steps, target, 0
        self.found: dict[int, Column] = {}  # the targets of the references that a resolve() in a lambda meets, by the call
        self.root: Coll | None = None
        self.known: dict[object, Column] = {}  # the targets of the references of items of the root, by the tree of those

    def eval(self, node, focus: Coll) -> Coll:
        self.root = focus if self.root is None else self.root
        if isinstance(node, Literal):
            return literal(node)
        if isinstance(node, This):
            return focus
        if isinstance(node, Name):
            return self.head(node.name, focus)
        if isinstance(node, Member):
            return access(self.eval(node.source, focus), node.name)
        if isinstance(node, Index):
            return self.bound(self.index(node, focus))
        if isinstance(node, Call):
            from ..functions.library import call

            source = focus if node.source is None else self.operand(node.source, focus)
            if node.name == "resolve" and not node.args:
                return self.bound(self.resolve(node, source, focus))
            if not self.inside:
                self.look_ahead(node, source, focus)
            return self.bound(call(self, node.name, source, node.args, focus))
        if isinstance(node, TypeTest):
            source = self.operand(node.source, focus)
            return self.bound(type_is(source, node.type_name) if node.op == "is" else of_type(source, node.type_name))
        if isinstance(node, Binary):
            node = folded(node)
            if isinstance(node, Literal):
                return literal(node)
            left, right = (self.operand(n, focus) for n in (node.left, node.right))
            if node.op not in ("|", "+", "-", "*", "/", "=", "!=", "<", "<=", ">", ">="):
                left, right = numeric(left), numeric(right)
            unit = node.right.unit if isinstance(node.right, Literal) else None
            return self.bound(binary(node.op, left, right, unit))
        raise PathError(f"cannot evaluate {node!r}")

    def operand(self, node, focus: Coll) -> Coll:
        """A tree's value as a step of its own, so that what is made of it can name it several times."""
        got = self.eval(node, focus)
        return got if isinstance(node, Literal) else self.bound(got)

    def resolve(self, node: Call, c: Coll, focus: Coll) -> Coll:
        """The resources that texts, and objects with a ``reference``, name; none for what names none."""
        texts = reference_texts(c)
        if texts is None or self.target is None or self.steps is None or (self.inside and id(node) not in self.found):
            return empty(c.error)
        known = self.found[id(node)] if self.inside else self.lookup(texts, self.origin(node, focus))
        if not texts.many:
            return of_column(F.try_element_at(known, texts.col), self.target).with_error(texts.error)
        return of_column(F.transform(texts.col, lambda r: F.try_element_at(known, r)), T.ArrayType(self.target)).with_error(texts.error)

    def lookup(self, texts: Coll, origin: object) -> Column:
        """``origin``: the tree of the items that texts are from, where they are ones of the root. What was looked up for those is not looked up again."""
        if origin is not None and origin in self.known:
            return self.known[origin]
        wanted, name = f"__step{next(_NUMBERS)}__", f"__step{next(_NUMBERS)}__"
        self.steps += [(wanted, texts.col if texts.many else F.array(texts.col)), (name, Lookup(wanted))]
        if origin is not None:
            self.known[origin] = F.col(name)
        return F.col(name)

    def origin(self, node: Call, focus: Coll) -> object | None:
        """The tree of all the items of the root that those before a call are among."""
        found = node.source
        while (isinstance(found, Call) and found.name in _SOME) or isinstance(found, Index):
            found = found.source
        return (found if found is not None else This()) if focus is self.root else None

    def look_ahead(self, node: Call, source: Coll, focus: Coll) -> None:
        """References that the arguments of a call resolve for each item are looked up before, for all items."""
        if self.target is None or self.steps is None:
            return
        from ..functions.library import OF_ITEMS, _project

        if node.name not in OF_ITEMS:
            return
        for part in _calls(node.args):  # inner ones first
            own = part.source if part.source is not None else This()
            if part.name == "resolve" and not part.args:
                texts = reference_texts(self.bound(_project(self, source, own)))
                if texts is not None:
                    self.found[id(part)] = self.lookup(texts, self.origin(node, focus) if own == This() else None)
            elif part.name in OF_ITEMS:
                self.look_ahead(part, self.bound(_project(self, source, own)), source)

    def of_item(self, node, item: Coll) -> Coll:
        """A criterion's or projection's value for an item, within a lambda."""
        self.inside += 1
        try:
            return self.eval(node, item)
        finally:
            self.inside -= 1

    def bound(self, c: Coll) -> Coll:
        if self.steps is None or self.inside:
            return c
        error = None if c.error is None else self._step(c.error)
        if c.alternatives:
            return replace(c, alternatives=tuple(self.bound(a) for a in c.alternatives), error=error)
        return replace(c, col=c.col if c.kind == "Empty" else self._step(c.col), error=error)

    def _step(self, col: Column) -> Column:
        if simple(col) and "[" not in str(col):  # fields of a column are steps: what is above the first steps must not name the column
            return col
        name = f"__step{next(_NUMBERS)}__"
        self.steps.append((name, col))
        return F.col(name)

    def head(self, name: str, focus: Coll) -> Coll:
        """An identifier at the start: the item itself where it is of that type, else its member."""
        if focus.type_name == name:
            return focus
        fields = focus.dtype.fieldNames() if isinstance(focus.dtype, T.StructType) else []
        if "resourceType" in fields and name not in fields and name[:1].isupper():
            if focus.many:
                return array(F.filter(focus.col, lambda x: F.coalesce(x["resourceType"] == name, F.lit(False))), focus)
            return replace(focus, col=F.when(focus.col["resourceType"] == name, focus.col))
        return access(focus, name)

    def index(self, node: Index, focus: Coll) -> Coll:
        source, at = merged(self.operand(node.source, focus)), single(self.operand(node.index, focus))
        if at.kind == "Empty":
            return empty(F.lit(True))
        if at.kind != "Integer":
            return empty(F.lit(True)).with_error(source.error)
        got = F.get(items(source), F.when((at.col >= 0) & (at.col < 2**31), at.col).otherwise(-1).cast("int"))
        return replace(source, col=got, many=False).with_error(at.error, at.col.isNull())


def reference_texts(c: Coll) -> Coll | None:
    """The texts of references among the items, texts themselves or objects with one; None where the type of the items has none."""
    c = merged(c)
    if c.kind in ("Complex", "Any") and (c.kind == "Any" or "reference" in c.dtype.fieldNames()):
        of_objects = merged(access(c, "reference"))
        if c.kind == "Any":
            texts = F.transform(F.filter(F.concat(items(c), items(of_objects)), lambda x: x["kind"] == "String"), lambda x: x["text"])
            return Coll(texts, T.StringType(), "String", True, c.error)
        c = of_objects
    return c if c.kind == "String" else None


def _calls(node) -> list[Call]:
    """The calls within trees that are evaluated on the same items, the inner ones first; not those in criteria of inner calls."""
    from ..functions.library import OF_ITEMS

    if isinstance(node, tuple):
        return [c for x in node for c in _calls(x)]
    if isinstance(node, Call):
        inner = _calls(node.source) + ([] if node.name in OF_ITEMS else _calls(node.args))
        return [*inner, node]
    if isinstance(node, Member | TypeTest):
        return _calls(node.source)
    if isinstance(node, Index):
        return _calls((node.source, node.index))
    return _calls((node.left, node.right)) if isinstance(node, Binary) else []


def folded(node):
    """A sum, difference or product of integers that are written out, as one: a Decimal where it has more than 64 bits."""
    if not isinstance(node, Binary) or node.op not in ("+", "-", "*"):
        return node
    left, right = folded(node.left), folded(node.right)
    if not (isinstance(left, Literal) and isinstance(right, Literal) and left.kind in NUMBER_KINDS and right.kind in NUMBER_KINDS):
        return node
    x, y = Decimal(left.value), Decimal(right.value)
    with localcontext() as exact:
        exact.prec = 60
        got = {"+": x + y, "-": x - y, "*": x * y}[node.op]
    if left.kind == right.kind == "Integer" and -(2**63) <= got < 2**63:
        return Literal("Integer", int(got))
    return Literal("Decimal", got)


def literal(node: Literal) -> Coll:
    if node.kind == "Quantity":
        return scalar(F.struct(F.lit(node.value).cast(DECIMAL).alias("value"), F.lit(node.unit).alias("unit")), "Quantity")
    if node.kind == "Decimal":
        return Coll(F.lit(f"{node.value:f}"), T.StringType(), "Decimal")
    if node.kind == "Integer":
        return scalar(F.lit(node.value).cast("long"), "Integer")
    return scalar(F.lit(node.value), node.kind)


def access(c: Coll, name: str) -> Coll:
    """Children by exact name, else those of a choice element: the fields that start with the name and go on with a capital."""
    if c.alternatives:
        found = [access(a, name) for a in c.alternatives]
        found = [a for a in found if a.kind != "Empty"]
        return _choice(found, c.error)
    if c.kind == "Quantity" and isinstance(c.dtype, T.StructType) and name in c.dtype.fieldNames():
        return _field(c, name, None)
    if c.kind == "Untyped":
        raise PathError(f"{name} lies deeper than the schema is typed; give struct_of a greater depth")
    if c.kind == "Any":
        return _mixed_access(c, name)
    if c.kind != "Complex":
        return empty(c.error)
    names = c.dtype.fieldNames()
    if name in names:
        return _field(c, name, None)
    forms = sorted(f for f in names if f.startswith(name) and f[len(name) : len(name) + 1].isupper())
    if len(forms) < 2:
        return _field(c, forms[0], forms[0][len(name) :]) if forms else empty(c.error)
    if c.many:
        nested, like = for_each(c, lambda x: merged(access(x, name)))
        return array(nested, like, c.error)
    found, before = [], F.lit(False)
    for f in forms:  # the first that is present counts
        got = _field(c, f, f[len(name) :])
        here = present(got)
        found.append(replace(got, col=F.when(~before, got.col) if not got.many else F.when(~before, got.col).otherwise(F.array().cast(T.ArrayType(got.dtype)))))
        before = before | here
    return _choice(found, c.error)


def _mixed_access(c: Coll, name: str) -> Coll:
    """Children of objects among items of mixed kinds, which are JSON texts: by exact key, else by the first key of a choice element."""

    def children(x: Column) -> Column:
        held = F.try_parse_json(F.when(x["kind"] == "Complex", x["text"])).try_cast("map<string,variant>")

        def of(m: Column) -> Column:
            form = F.get(F.array_sort(F.filter(F.map_keys(m), lambda k: k.rlike(f"^{re.escape(name)}[A-Z]"))), F.lit(0))
            chosen = let(form, lambda k: F.coalesce(*(F.when(k == name + t, variant_items(F.try_element_at(m, k), t)) for t in ("Date", "DateTime")), _tagged(variant_items(F.try_element_at(m, k)), F.substr(k, F.lit(len(name) + 1)))))
            return F.when(F.map_contains_key(m, name), variant_items(F.try_element_at(m, F.lit(name)))).otherwise(chosen)

        return F.coalesce(let(held, of), F.array().cast(T.ArrayType(ANY_TYPE)))

    return Coll(F.flatten(F.transform(items(c), children)), ANY_TYPE, "Any", True, c.error)


def _tagged(xs: Column, suffix: Column) -> Column:
    return F.transform(xs, lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"), suffix.alias("type")))


def _choice(found: list[Coll], error: Column | None) -> Coll:
    if not found:
        return empty(error)
    if len(found) == 1:
        return found[0].with_error(error)
    return Coll(None, T.StringType(), "Choice", error=error, alternatives=tuple(found))


def _field(c: Coll, name: str, suffix: str | None) -> Coll:
    dtype = c.dtype[name].dataType
    got = of_column(c.member(name), T.ArrayType(dtype) if c.many else dtype, suffix if isinstance(dtype, T.VariantType) else None)
    if c.dtype[name].metadata.get(MARKED):
        plain = lambda x: F.ltrim(x, F.lit(NUMBER_MARK))
        got = replace(got, col=F.transform(got.col, plain) if got.many else plain(got.col))
    kind = suffix if got.kind == "String" and suffix in ("Date", "DateTime") else got.kind
    if got.kind == "String" and c.dtype[name].metadata.get(SOURCE_NUMBER):
        kind = "Decimal"
    elif c.dtype[name].metadata.get(JSON_TEXT):
        kind = "Untyped"
    return replace(got, kind=kind, error=c.error, type_name=suffix)


# Types


def _matcher(c: Coll, name: str):
    """A predicate on an item: is it of this type?"""
    want = name.removeprefix("System.").lower()
    if c.kind == "Any":
        def any_match(x: Column) -> Column:
            kind, tag = F.lower(x["kind"]), F.lower(F.coalesce(x["type"], F.lit("")))
            if want in ("date", "datetime"):
                shape = temporal.DATE_SHAPE if want == "date" else temporal.DATETIME_SHAPE
                return (kind == want) | ((kind == "string") & x["text"].rlike(shape))
            if want in _TEXT_TYPES:
                return kind == "string"
            return (kind == want) | ((kind == "complex") & (tag == want))
        return any_match
    if c.kind == "Decimal" and isinstance(c.dtype, T.StringType) and want in ("integer", "decimal"):
        return lambda x: is_whole(x) if want == "integer" else ~is_whole(x)
    if c.kind in ("Boolean", "Integer", "Decimal", "Quantity"):
        return lambda x: F.lit(_TYPES.get(want) == c.kind)
    if c.kind in ("Date", "DateTime"):
        return lambda x: F.lit(_TYPES.get(want) == c.kind)
    if c.kind == "String":
        if want in ("date", "datetime"):
            return lambda x: x.rlike(temporal.DATE_SHAPE if want == "date" else temporal.DATETIME_SHAPE)
        return lambda x: F.lit(want in _TEXT_TYPES)
    if c.kind == "Complex":
        if c.type_name:
            return lambda x: F.lit(c.type_name.lower() == want)
        if "resourceType" in c.dtype.fieldNames():
            return lambda x: F.coalesce(F.lower(x["resourceType"]) == want, F.lit(False))
    return lambda x: F.lit(False)


def is_whole(x: Column) -> Column:
    """Whether a number's source text is that of an integer of 64 bits: among decimals of other documents it is one still."""
    return x.rlike(r"^-?\d+$") & x.try_cast("long").isNotNull()


def of_type(c: Coll, name: str) -> Coll:
    """The items of a type. Keeps their static type where it is known, so that paths can go on."""
    if c.alternatives:
        return _choice([a for a in (of_type(a, name) for a in c.alternatives)], c.error)
    if c.kind == "Empty":
        return c
    match = _matcher(c, name)
    if c.many:
        got = array(F.filter(c.col, match), c)
    else:
        got = replace(c, col=let(c.col, lambda x: F.when(match(x), x)))
    want = _TYPES.get(name.removeprefix("System.").lower(), "String" if name.removeprefix("System.").lower() in _TEXT_TYPES else None)
    if c.kind == "Any" and want in ("Boolean", "Integer", "Decimal", "String", "Date", "DateTime"):
        kind = {"Boolean": "boolean", "Integer": "long", "Decimal": DECIMAL.simpleString()}.get(want, "string")
        typed = scalar(F.lit(None), want)
        return Coll(F.transform(items(got), lambda x: x["text"].try_cast(kind)), typed.dtype, want, True, c.error)
    return got


def type_is(c: Coll, name: str) -> Coll:
    if c.alternatives and any(a.kind == "Any" for a in c.alternatives):
        c = merged(c)
    if c.alternatives:
        found = [type_is(a, name) for a in c.alternatives]
        return scalar(F.coalesce(*(f.col for f in found)), "Boolean", c.error)
    one = single(c)
    if one.kind == "Empty":
        return empty(c.error)
    return scalar(let(one.col, lambda x: F.when(x.isNotNull(), _matcher(one, name)(x))), "Boolean", one.error)


# Operators


def boolean(c: Coll) -> tuple[Column, Column | None]:
    """A truth value (null: empty), and where it is none."""
    c = single(c)
    if c.kind == "Boolean":
        return c.col, c.error
    if c.kind == "Any":
        return F.when(c.col["kind"] == "Boolean", c.col["text"].try_cast("boolean")), c.with_error(c.col.isNotNull() & (c.col["kind"] != "Boolean")).error
    if c.kind == "Empty":
        return F.lit(None).cast("boolean"), c.error
    return F.lit(None).cast("boolean"), c.with_error(c.col.isNotNull()).error


def quantity(c: Coll) -> Coll | None:
    """The item as a quantity: objects with a numeric value and a code or unit are ones. None for any other type."""
    if c.alternatives:
        found = [q for q in map(quantity, c.alternatives) if q is not None]
        return found[0] if len(found) == 1 else None
    c = single(c)
    if c.kind == "Quantity":
        return c
    if c.kind != "Complex":
        return None
    names = c.dtype.fieldNames()
    units = [c.col[n] for n in ("code", "unit") if n in names and isinstance(c.dtype[n].dataType, T.StringType)]
    if "value" not in names or not units:
        return None
    held = _field(c, "value", None)
    if held.kind not in NUMBER_KINDS or held.many:
        return None
    value, unit = held.col.try_cast(DECIMAL), F.coalesce(*units)
    return scalar(F.when(value.isNotNull() & unit.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"))), "Quantity", c.error)


def equal_items(a: Coll, x: Column, b: Coll, y: Column) -> Column:
    if a.kind in NUMBER_KINDS and b.kind in NUMBER_KINDS:
        return numbers_compare(lambda p, q: p == q, a, x, b, y)
    if a.kind in TEXT_KINDS and b.kind in TEXT_KINDS:
        return F.lit(False) if {a.kind, b.kind} == {"Date", "DateTime"} else x == y
    if "Any" in (a.kind, b.kind):
        if a.kind != "Any":
            x = F.struct(F.lit(a.kind).alias("kind"), text_of(x, a.kind, a.dtype).alias("text"))
        if b.kind != "Any":
            y = F.struct(F.lit(b.kind).alias("kind"), text_of(y, b.kind, b.dtype).alias("text"))
        texts, numbers = F.array(*map(F.lit, TEXT_KINDS)), F.array(*map(F.lit, NUMBER_KINDS))
        both = lambda kinds: F.array_contains(kinds, x["kind"]) & F.array_contains(kinds, y["kind"])
        dates = F.array_contains(F.array(F.lit("Date"), F.lit("DateTime")), x["kind"]) & F.array_contains(F.array(F.lit("Date"), F.lit("DateTime")), y["kind"])
        return F.when(both(numbers), x["text"].try_cast(DECIMAL) == y["text"].try_cast(DECIMAL)).when(dates & (x["kind"] != y["kind"]), False).otherwise(
            ((x["kind"] == y["kind"]) | both(texts)) & (x["text"] == y["text"]))
    if a.kind != b.kind:
        return F.lit(False)
    if a.kind in ("Complex", "Quantity"):
        return text_of(x, a.kind, a.dtype) == text_of(y, b.kind, b.dtype)
    return x == y


def equality(a: Coll, b: Coll) -> Coll:
    """Of all items in order; empty where a side is, or where two quantities differ in their units."""
    if "Empty" in (a.kind, b.kind):
        return scalar(F.lit(None).cast("boolean"), "Boolean")
    qa, qb = (None, None) if a.many or b.many else (quantity(a), quantity(b))
    if qa is not None and qb is not None:
        same = let(qa.col, lambda x: let(qb.col, lambda y: F.when(x["unit"] == y["unit"], x["value"] == y["value"])))
        return scalar(same, "Boolean")
    a, b = merged(a), merged(b)
    if not a.many and not b.many:
        return scalar(let(a.col, lambda x: let(b.col, lambda y: F.when(x.isNotNull() & y.isNotNull(), equal_items(a, x, b, y)))), "Boolean")
    pairs = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(equal_items(a, p, b, q), F.lit(False))), lambda v: v)
    both = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.when(F.size(x) == F.size(y), pairs(x, y)).otherwise(False))
    return scalar(let(items(a), lambda x: let(items(b), lambda y: both(x, y))), "Boolean")


def equivalence(a: Coll, b: Coll) -> Coll:
    """Like equality, but two empties are equivalent, one is not, and texts differ neither by case nor by white space."""
    a, b = merged(a), merged(b)

    def plain(c: Coll, x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))) if c.kind in TEXT_KINDS else x

    if "Empty" in (a.kind, b.kind):
        return scalar(F.size(items(a)) == F.size(items(b)), "Boolean")
    pairs = lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(equal_items(a, plain(a, p), b, plain(b, q)), F.lit(False)))
    both = lambda x, y: F.when(F.size(x) == F.size(y), F.forall(pairs(x, y), lambda v: v)).otherwise(False)
    return scalar(let(items(a), lambda x: let(items(b), lambda y: both(x, y))), "Boolean")


def of_forms(make, a: Coll, b: Coll) -> Coll | None:
    """``make(a, b)`` for each pair of kinds that items of mixed kinds can be of; None where both are of known kinds."""
    a, b = (merged(c) if c.alternatives and any(x.kind == "Any" for x in c.alternatives) else c for c in (a, b))
    if "Any" not in (a.kind, b.kind):
        return None
    a, b = (single(c) if c.kind == "Any" or quantity(c) is None else c for c in (a, b))
    return by_form([(p & q, make(x, y)) for p, x in forms(a) for q, y in forms(b)], a.error, b.error)


def comparison(op: str, a: Coll, b: Coll) -> Coll:
    mixed = of_forms(lambda x, y: comparison(op, x, y), a, b)
    if mixed is not None:
        return mixed
    qa, qb = quantity(a), quantity(b)
    apply = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if qa is not None and qb is not None:
        same = let(qa.col, lambda x: let(qb.col, lambda y: F.when(x["unit"] == y["unit"], apply(x["value"], y["value"]))))
        return scalar(same, "Boolean", qa.error, qb.error)
    a, b = single(a), single(b)
    if "Empty" in (a.kind, b.kind):
        return empty().with_error(a.error, b.error)
    numbers = a.kind in NUMBER_KINDS and b.kind in NUMBER_KINDS
    texts = a.kind in TEXT_KINDS and b.kind in TEXT_KINDS and {a.kind, b.kind} != {"Date", "DateTime"}
    if numbers:
        return scalar(let(a.col, lambda x: let(b.col, lambda y: numbers_compare(apply, a, x, b, y))), "Boolean", a.error, b.error)
    if texts:
        return scalar(apply(a.col, b.col), "Boolean", a.error, b.error)
    return empty(a.col.isNotNull() & b.col.isNotNull()).with_error(a.error, b.error)


def like(c: Coll, other: Coll) -> Coll:
    """An item of kind Any as one that ``other`` can be compared with; an item of another kind is an error."""
    if c.kind != "Any" or other.kind not in (*NUMBER_KINDS, *TEXT_KINDS) or c.many:
        return c
    kinds = NUMBER_KINDS if other.kind in NUMBER_KINDS else TEXT_KINDS
    fits = F.array_contains(F.array(*map(F.lit, kinds)), c.col["kind"])
    text = F.when(fits, c.col["text"])
    wrong = c.col.isNotNull() & ~fits
    return scalar(text.try_cast(DECIMAL), "Decimal", c.error, wrong) if kinds == NUMBER_KINDS else scalar(text, other.kind, c.error, wrong)


def membership(one: Coll, many: Coll) -> Coll:
    one, many = single(one), merged(many)
    if one.kind == "Empty":
        return empty(one.error)
    if many.kind == "Empty":
        return scalar(F.when(one.col.isNotNull(), False), "Boolean", one.error)
    if one.dtype == many.dtype and one.kind == many.kind and one.kind not in ("Complex", "Any", "Quantity"):
        found = lambda v: F.array_contains(items(many), v)
    else:
        found = lambda v: F.exists(items(many), lambda x: F.coalesce(equal_items(many, x, one, v), F.lit(False)))
    return scalar(let(one.col, lambda v: F.when(v.isNotNull(), found(v))), "Boolean", one.error)


def alike(a: Coll, b: Coll) -> tuple[Coll, Coll]:
    """Both with one item type: the wider number, or Any."""
    a, b = merged(a), merged(b)
    if a.kind == "Empty":
        a = replace(b, col=F.array().cast(T.ArrayType(b.dtype)), many=True, error=a.error)
    if b.kind == "Empty":
        b = replace(a, col=F.array().cast(T.ArrayType(a.dtype)), many=True, error=b.error)
    texts = any(c.kind == "Decimal" and isinstance(c.dtype, T.StringType) for c in (a, b))  # equal by value, shown as written
    if a.kind == b.kind and a.dtype.simpleString() == b.dtype.simpleString() and not texts:
        return a, b
    if a.kind in NUMBER_KINDS and b.kind in NUMBER_KINDS and not texts:
        widen = lambda c: Coll(F.transform(items(c), lambda x: x.try_cast(DECIMAL)), DECIMAL, "Decimal", True, c.error)
        if a.kind == b.kind == "Integer":
            widen = lambda c: Coll(F.transform(items(c), lambda x: x.cast("long")), T.LongType(), "Integer", True, c.error)
        return widen(a), widen(b)
    return as_any(a), as_any(b)


def union(a: Coll, b: Coll) -> Coll:
    a, b = alike(a, b)
    return distinct(array(F.concat(items(a), items(b)), a)).with_error(a.error, b.error)


def distinct(c: Coll) -> Coll:
    """First occurrences in order."""
    c = merged(c)
    if c.kind not in ("Any", "Complex"):
        return array(F.array_distinct(items(c)), c)
    # of mixed or complex items each is compared with those kept so far
    seen = F.aggregate(items(c), F.array().cast(T.ArrayType(c.dtype)), lambda acc, x: F.when(F.exists(acc, lambda y: F.coalesce(equal_items(c, y, c, x), F.lit(False))), acc).otherwise(F.array_append(acc, x)))
    return array(seen, c)


def binary(op: str, a: Coll, b: Coll, unit: str | None = None) -> Coll:
    """``unit``: that of b where it is a literal quantity, which spares the choice between units at run time."""
    if op in ("=", "!="):
        got = equality(a, b).with_error(a.error, b.error)
        return got if op == "=" else replace(got, col=~got.col)
    if op in ("~", "!~"):
        got = equivalence(a, b).with_error(a.error, b.error)
        return got if op == "~" else replace(got, col=~got.col)
    if op in ("<", "<=", ">", ">="):
        return comparison(op, a, b)
    if op in ("and", "or", "xor", "implies"):
        (x, ex), (y, ey) = boolean(a), boolean(b)
        got = {"and": lambda: x & y, "or": lambda: x | y, "xor": lambda: x != y, "implies": lambda: ~x | y}[op]()
        return scalar(got, "Boolean", ex, ey)
    if op == "in":
        return membership(a, b).with_error(b.error)
    if op == "|":
        return union(a, b)
    if op == "&":
        return joined(a, b)
    return arithmetic(op, a, b, unit)


def joined(a: Coll, b: Coll) -> Coll:
    """``&``: texts, of which an empty one is ''. Anything but a String is an error."""
    a, b = single(a), single(b)
    parts, errors = [], [a.error, b.error]
    for c in (a, b):
        text = F.when(c.col["kind"] == "String", c.col["text"]) if c.kind == "Any" else c.col
        if c.kind not in ("String", "Empty"):
            errors.append(c.col.isNotNull() & (text.isNull() if c.kind == "Any" else F.lit(True)))
        parts.append(F.coalesce(text, F.lit("")) if c.kind in ("String", "Any") else F.lit(""))
    return scalar(F.concat(*parts), "String", *errors)


def arithmetic(op: str, a: Coll, b: Coll, unit: str | None = None) -> Coll:
    mixed = of_forms(lambda x, y: arithmetic(op, x, y, unit), a, b)
    if mixed is not None:
        return mixed
    qa, qb = quantity(a), quantity(b)
    a, b = single(a) if qa is None else a, single(b) if qb is None else b
    errors = (a.error, b.error)
    if "Empty" in (a.kind, b.kind):
        return empty().with_error(*errors)
    if a.kind in ("Date", "DateTime") and qb is not None and op in "+-":
        amount = qb.col["value"] if op == "+" else -qb.col["value"]
        if unit is not None:
            return replace(a, col=let(a.col, lambda x: let(amount, lambda n: temporal.add(x, n, unit)))).with_error(b.error)
        units = lambda x, q: F.coalesce(*(F.when(q["unit"] == u, temporal.add(x, q["value"] if op == "+" else -q["value"], u)) for u in temporal.UNITS))
        return replace(a, col=let(a.col, lambda x: let(qb.col, lambda q: units(x, q)))).with_error(b.error)
    if qa is not None and qb is not None:
        if op not in "+-":
            return replace(empty(), kind="Empty").with_error(*errors)
        value = _decimal(op, qa.col["value"], qb.col["value"]).try_cast(DECIMAL)
        same = qa.col["unit"] == qb.col["unit"]
        return scalar(F.when(same & value.isNotNull(), F.struct(value.alias("value"), qa.col["unit"].alias("unit"))), "Quantity", qa.error, qb.error, same & value.isNull())
    if (qa is not None and b.kind in NUMBER_KINDS) or (qb is not None and a.kind in NUMBER_KINDS and op == "*"):
        q, n = (qa, b) if qa is not None else (qb, a)
        if op not in "*/":
            return empty(present(a) & present(b)).with_error(*errors)
        value = _decimal(op, q.col["value"], numeric(n).col)
        return scalar(F.when(value.isNotNull(), F.struct(value.try_cast(DECIMAL).alias("value"), q.col["unit"].alias("unit"))), "Quantity", *errors)
    if qb is not None and a.kind in NUMBER_KINDS and op == "/":
        return empty().with_error(*errors)
    if a.kind == b.kind == "String" and op == "+":
        return scalar(F.concat(a.col, b.col), "String", *errors)
    if a.kind in NUMBER_KINDS and b.kind in NUMBER_KINDS:
        return number(op, a, b).with_error(*errors)
    return empty(present(a) & present(b)).with_error(*errors)


#: Digits in all and after the point that the operands of a product or quotient are narrowed to, where that loses nothing: the first that fit give the
#: most digits of the result. Wider operands keep the last ones' digits.
_PRODUCTS = (((19, 18), (18, 0)), ((18, 0), (19, 18)), ((19, 9), (18, 9)), ((28, 6), (9, 6)), ((9, 6), (28, 6)), ((26, 12), (18, 6)))
_QUOTIENTS = (((19, 9), (19, 9)), ((25, 6), (12, 3)), ((30, 4), (10, 3)), ((26, 12), (26, 12)))


def _decimal(op: str, x: Column, y: Column) -> Column:
    """Arithmetic in decimals; null where a number does not fit."""
    if op in "+-":
        x, y = x.try_cast("decimal(37,18)"), y.try_cast("decimal(37,18)")
        return F.try_add(x, y) if op == "+" else F.try_subtract(x, y)
    apply, forms = (F.try_multiply, _PRODUCTS) if op == "*" else (F.try_divide, _QUOTIENTS)

    def result(pair: Column) -> Column:
        tried = []
        for (p, n), (q, m) in forms:
            a, b = pair["x"].try_cast(f"decimal({p},{n})"), pair["y"].try_cast(f"decimal({q},{m})")
            got = apply(a, b).try_cast(DECIMAL)
            tried.append(got if (p, n) == forms[-1][0] else F.when((a == pair["x"]) & (b == pair["y"]), got))
        return F.coalesce(*tried)

    # of an array of one, so that the operands are computed once
    return F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), result), F.lit(0))


_EXACT = {"+": decimals.plus, "-": decimals.minus, "*": decimals.times, "/": decimals.over}


def exactly(op: str, a: Coll, b: Coll) -> Coll:
    """A result in decimals of 96 bits, of texts and itself one."""
    x, y = (decimals.read(c.col if c.wide else text_of(c.col, c.kind, c.dtype)) for c in (a, b))
    return Coll(decimals.text(_EXACT[op](x, y)), T.StringType(), "Decimal", wide=True)


def _of_scale(op: str, a: Coll, b: Coll) -> Coll:
    """A sum, difference or product of source texts and integers, itself a text: with the zeros that its scale has. Of what is computed to 28 digits
    it is exact; else Spark's decimals do, which spares plans the lambdas: of 18 digits after the point, for sums also 28, or 9 beyond 20 before it."""
    there = a.col.isNotNull() & b.col.isNotNull()
    if a.wide or b.wide:
        got = exactly(op, a, b)
        return got.with_error(there & got.col.isNull())

    def scale(c: Coll) -> Column:
        return F.when(F.contains(c.col, F.lit(".")), F.length(F.substring_index(c.col, ".", -1))).otherwise(0) if c.kind == "Decimal" else F.lit(0)

    def shown(value: Column, n: Column) -> Column:
        return let(value.cast("string"), lambda t: F.substr(t, F.lit(1), F.instr(t, ".") + F.when(n == 0, -1).otherwise(n)))

    def summed(form: str) -> Column:
        x, y = (c.col.try_cast(form) for c in (a, b))
        return (F.try_add(x, y) if op == "+" else F.try_subtract(x, y)).try_cast(form)

    plain = _decimal(op, numeric(a).col, numeric(b).col).try_cast(DECIMAL)
    if op == "*":
        text = let(F.least(scale(a) + scale(b), F.lit(18)), lambda n: shown(plain, n))
    else:
        ways = lambda n: F.coalesce(F.when(n > 18, shown(summed("decimal(37,28)"), F.least(n, F.lit(28)))), shown(plain, F.least(n, F.lit(18))), shown(summed("decimal(37,9)"), F.least(n, F.lit(9))))
        text = let(F.greatest(scale(a), scale(b)), ways)
    return Coll(text, T.StringType(), "Decimal").with_error(there & text.isNull())


def numbers_compare(apply: Callable[[Column, Column], Column], a: Coll, x: Column, b: Coll, y: Column) -> Column:
    """``apply`` to two numbers. Source texts of up to 20 characters are Spark's decimals without a loss; longer ones are compared to all their digits."""
    texts = [isinstance(c.dtype, T.StringType) for c in (a, b)]
    if not any(texts):
        return apply(x, y)
    short = [F.length(v) <= 20 for v, t in zip((x, y), texts, strict=True) if t]
    value = lambda c, v, t: v.try_cast(DECIMAL) if t else v
    key = lambda c, v: decimals.order(text_of(v, c.kind, c.dtype))
    plain, whole = apply(value(a, x, texts[0]), value(b, y, texts[1])), lambda: apply(key(a, x), key(b, y))
    return F.when(short[0] & short[-1], plain).when(x.isNotNull() & y.isNotNull(), F.coalesce(whole(), plain))


def number(op: str, a: Coll, b: Coll) -> Coll:
    """Empty for a division by zero; a result that does not fit is an error."""
    decimals = [c for c in (a, b) if c.kind == "Decimal"]
    if op in ("+", "-", "*") and decimals and all(isinstance(c.dtype, T.StringType) for c in decimals):
        return _of_scale(op, a, b)
    written, a, b = (a, b), numeric(a), numeric(b)
    x, y = a.col, b.col
    whole = a.kind == b.kind == "Integer"
    there = x.isNotNull() & y.isNotNull()
    if op in ("div", "mod"):
        y = F.nullif(y, F.lit(0))
        x, y = (x.cast("long"), y.cast("long")) if whole else (x.try_cast("decimal(38,18)"), y.try_cast("decimal(38,18)"))
        if op == "mod":
            return Coll(F.try_mod(x, y), T.LongType() if whole else DECIMAL, "Integer" if whole else "Decimal")
        quotient = F.call_function("div", x, y) if whole else _truncated(_decimal("/", x, y))
        return scalar(quotient, "Integer")
    if whole and op != "/":
        apply = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        got = apply(x.cast("long"), y.cast("long"))
        return scalar(got, "Integer", there & got.isNull())
    if op == "/":
        got = exactly(op, *written)
        return got.with_error(there & got.col.isNull() & (y != 0))
    got = _decimal(op, x, y).try_cast(DECIMAL)
    return scalar(got, "Decimal", there & got.isNull())


def _truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("long")


# Entry points


def native(c: Coll) -> Column:
    """The result as one plain column: a value for singletons, an array for collections. Quantities keep value and unit."""
    if c.kind == "Empty":
        return F.lit(None).cast("string")
    shown = lambda x: F.when(x["kind"] == "Complex", unmarked(x["text"])).otherwise(x["text"])
    return F.transform(c.col, shown) if c.kind == "Any" and c.many else shown(c.col) if c.kind == "Any" else c.col


def rendered(c: Coll) -> Column:
    """The result as JSON array text, the way an evaluation is shown: complex items as objects, quantities as value and unit."""
    amount = lambda value, unit: F.concat(F.lit('{"value":'), value, F.lit(',"unit":'), _quoted(unit), F.lit("}"))

    def one(x: Column) -> Column:
        if c.kind == "Any":
            told, kind = x["text"], x["kind"]
            shown = F.when(kind.isin("Boolean", "Integer", "Decimal"), told).when(kind.isin("Complex", "Array"), unmarked(told))
            return shown.when(kind == "Quantity", amount(F.regexp_extract(told, r"^(\S+) ", 1), F.regexp_extract(told, r"(?s)^\S+ '(.*)'$", 1))).otherwise(_quoted(told))
        if c.kind == "Complex":
            return unmarked(text_of(x, c.kind, c.dtype))
        if c.kind == "Untyped":
            return x
        if c.kind == "Quantity":
            return amount(number_text(x["value"], DECIMAL), x["unit"])
        text = text_of(x, c.kind, c.dtype)
        return _quoted(text) if c.kind in TEXT_KINDS else text

    return F.concat(F.lit("["), F.array_join(F.transform(items(c), one), ","), F.lit("]"))


def _quoted(x: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


Resolver = Callable[[DataFrame, str, list[str]], DataFrame]


def with_steps(df: DataFrame, steps: list[tuple[str, Column | Lookup]], resolver: Resolver | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with a compiler's steps as columns, and their names. Steps that name no others come first, together: only they read the table's own columns, so
    that it is read by the fields that they need; the others follow in as few projections as they allow. ``resolver`` (df, name, texts) adds the map
    column of lookups, for the texts in all of those columns."""
    depth: dict[str, tuple[int, int]] = {}  # how many lookups come before a step, one after another, and how many steps since
    for name, col in steps:
        named = [depth[n] for n in ([col.texts] if isinstance(col, Lookup) else re.findall(_STEP, str(col)))]
        lookups, since = max(named, default=(0, -1))
        depth[name] = (lookups + 1, 0) if isinstance(col, Lookup) else (lookups, since + 1)
    for lookups in range(1 + max((n for n, _ in depth.values()), default=-1)):
        joined = [(name, col.texts) for name, col in steps if isinstance(col, Lookup) and depth[name][0] == lookups]
        if joined:  # those that can be made at once are one
            first = joined[0][0]
            df = resolver(df, first, [texts for _, texts in joined])
            df = df.select("*", *(F.col(first).alias(name) for name, _ in joined[1:]))
        for d in range(1 + max((d for n, d in depth.values() if n == lookups), default=-1)):
            df = df.select("*", *(col.alias(name) for name, col in steps if not isinstance(col, Lookup) and depth[name] == (lookups, d)))
    return df, list(depth)


def fhirpath(
    df: DataFrame, column: str, expression: str, output: str = "result", errors: str | None = "error", strict: bool = False, render: bool = False, resolver: Resolver | None = None, target: T.StructType | None = None
) -> DataFrame:
    """``df`` with the result of ``expression`` on its struct ``column``.

    ``errors``: the name of a boolean column, true for rows in which evaluation fails (their result is null); None adds none.
    ``strict`` raises instead. ``render`` gives JSON array text for any type of result. ``resolver`` and ``target``, the type of what it finds: those of
    ``operators.graph.Targets``, by which resolve() joins; without them it finds nothing.
    """
    compiler = Compiler([], target if resolver else None)
    found = merged(compiler.bound(merged(compiler.eval(parse(expression), of_column(F.col(column), df.schema[column].dataType)))))
    value = rendered(found) if render else native(found)
    df, names = with_steps(df, compiler.steps, resolver)
    if found.error is None:
        out = df.withColumn(output, value)
        return (out.withColumn(errors, F.lit(False)) if errors and not strict else out).drop(*names)
    failed = F.coalesce(found.error, F.lit(False))
    if strict:
        return df.withColumn(output, F.when(failed, F.raise_error(F.lit(f"evaluation failed: {expression}"))).otherwise(value)).drop(*names)
    out = df.withColumn(output, F.when(~failed, value))
    return (out.withColumn(errors, failed) if errors else out).drop(*names)


def evaluate_json(docs: DataFrame, expression: str, column: str = "json", schema: T.StructType | None = None) -> DataFrame:
    """``docs`` (JSON texts) with ``result``, JSON array text, and ``error``. ``schema``: that of the documents, else it is inferred in a pass over them.

    Texts that are no JSON object have a null result and an error.
    """
    from ..sources.documents import inferred_schema, parse_json, typed

    good = F.coalesce(F.schema_of_variant(parse_json(F.col(column))).startswith("OBJECT"), F.lit(False))
    schema = schema or inferred_schema(docs.where(good), column)
    if not schema.fields:
        return docs.withColumns({"result": F.lit(None).cast("string"), "error": F.lit(True)})
    rows = fhirpath(typed(docs, schema, column, "__document"), "__document", expression, render=True).drop("__document")
    return rows.withColumns({"result": F.when(good, F.col("result")), "error": F.when(good, F.col("error")).otherwise(True)})
