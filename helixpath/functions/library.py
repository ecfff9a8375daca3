"""The functions of the language, by name and number of arguments."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import compiler as C
from ..plans.syntax import Literal, PathError, as_type_name
from ..plans.values import (
    ANY_TYPE, DECIMAL, NUMBER_KINDS, TEXT_KINDS, Coll, array, as_any, by_form, empty, for_each, forms, item_errors, items, let, merged, numeric, of_column, present, scalar,
    single, size, text_of, variant_items,
)
from . import decimals, temporal

_LIBRARY: dict[tuple[str, int], Callable] = {}
#: Functions that pass items on as they are, decimals as their source texts.
_KEEPING = ("where", "select", "first", "last", "tail", "skip", "take", "single", "iif", "toString", "exists", "all", "count", "empty", "ofType", "toInteger", "convertsToInteger", "toBoolean", "convertsToBoolean", "children", "descendants", "distinct", "repeat", "extension", "resolve", "sqrt", "power")
#: Functions whose arguments are evaluated on each item.
OF_ITEMS = ("where", "select", "exists", "all", "repeat")
#: Functions of one item, of whichever kind it is.
_OF_ONE = (
    "not", "length", "upper", "lower", "trim", "startsWith", "endsWith", "contains", "indexOf", "replace", "substring", "split", "toChars", "matches", "replaceMatches", "abs", "ceiling", "floor", "truncate",
    "round", "sqrt", "exp", "ln", "log", "power", "toString", "toInteger", "toDecimal", "toBoolean", "convertsToString", "convertsToInteger", "convertsToDecimal", "convertsToBoolean", "convertsToDate", "convertsToDateTime",
)


def call(compiler, name: str, source: Coll, args: tuple, focus: Coll) -> Coll:
    """``focus`` is what plain arguments are evaluated on; criteria and projections are evaluated on each item."""
    found = _LIBRARY.get((name, len(args)))
    if found is None:
        raise PathError(f"unknown function {name} of {len(args)} arguments")
    plain = (lambda c: c) if name in _KEEPING else numeric
    if name in _OF_ONE and (whole := merged(source)).kind == "Any":
        one = single(whole)
        return by_form([(when, found(compiler, plain(form), args, focus)) for when, form in forms(one, quantities=False)], one.error)
    return found(compiler, plain(source), args, focus)


def _function(name: str, *counts: int):
    def add(f: Callable) -> Callable:
        for n in counts:
            _LIBRARY[name, n] = f
        return f

    return add


def names() -> list[str]:
    return sorted({name for name, _ in _LIBRARY})


def register(name: str, count: int, function: Callable) -> None:
    """Adds a function (compiler, source, argument trees, focus) -> Coll of the given number of arguments."""
    if (name, count) in _LIBRARY:
        raise PathError(f"{name} of {count} arguments exists")
    _LIBRARY[name, count] = function


def unregister(name: str, count: int) -> None:
    _LIBRARY.pop((name, count))


# Arguments


def _argument(compiler, node, focus: Coll, kinds: tuple[str, ...]) -> Coll:
    """Exactly one value of one of the kinds; anything else is an error."""
    got = numeric(single(compiler.operand(node, focus)))
    if got.kind not in kinds:
        null = scalar(F.lit(None), kinds[0])
        return replace(null, col=null.col.cast(null.dtype)).with_error(got.error, F.lit(True))
    return got.with_error(got.col.isNull())


def _criterion(compiler, node) -> tuple[Callable[[Coll], Column], Callable[[Coll], Coll]]:
    """The truth of a criterion for an item (empty: false), and the same as a collection with its errors."""

    def truth(item: Coll) -> Coll:
        value, error = C.boolean(compiler.of_item(node, item))
        return scalar(F.coalesce(value, F.lit(False)), "Boolean", error)

    return (lambda item: truth(item).col), truth


def _item(c: Coll, x: Column) -> Coll:
    return replace(c, col=x, many=False, error=None)


# Existence


@_function("exists", 0)
def _exists(compiler, c, args, focus):
    return scalar(present(c), "Boolean", c.error)


@_function("exists", 1)
def _exists_any(compiler, c, args, focus):
    return _until(compiler, c, args[0], True)


@_function("all", 1)
def _all(compiler, c, args, focus):
    return _until(compiler, c, args[0], False)


def _until(compiler, c: Coll, node, stop: bool) -> Coll:
    """Whether any item meets (``stop`` True) or all do: items after the first that decides are not looked at, so their errors do not count."""
    c = merged(c)
    if c.kind == "Empty":
        return scalar(F.lit(not stop), "Boolean", c.error)
    truth, full = _criterion(compiler, node)
    quick = F.exists(items(c), lambda x: truth(_item(c, x))) if stop else F.forall(items(c), lambda x: truth(_item(c, x)))
    if item_errors(c, full) is None:
        return scalar(quick, "Boolean", c.error)
    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("failed"))

    def step(acc: Column, x: Column) -> Column:
        got = full(_item(c, x))
        failed = F.coalesce(got.error, F.lit(False)) if got.error is not None else F.lit(False)
        over = acc["done"] | acc["failed"]
        return F.struct((acc["done"] | (~over & ~failed & (got.col == stop))).alias("done"), (acc["failed"] | (~over & failed)).alias("failed"))

    end = F.aggregate(items(c), start, step)
    return scalar(end["done"] if stop else ~end["done"], "Boolean", c.error, end["failed"])


@_function("empty", 0)
def _empty(compiler, c, args, focus):
    return scalar(~present(c), "Boolean", c.error)


@_function("count", 0)
def _count(compiler, c, args, focus):
    return scalar(size(c), "Integer", c.error)


@_function("distinct", 0)
def _distinct(compiler, c, args, focus):
    return c if merged(c).kind == "Empty" else C.distinct(c)


@_function("not", 0)
def _not(compiler, c, args, focus):
    value, error = C.boolean(c)
    return scalar(~value, "Boolean", error)


# Filters, projections and parts


@_function("where", 1)
def _where(compiler, c, args, focus):
    if c.alternatives:
        return replace(c, alternatives=tuple(_where(compiler, a, args, focus) for a in c.alternatives))
    if c.kind == "Empty":
        return c
    truth, full = _criterion(compiler, args[0])
    if not c.many:
        failed = full(_item(c, c.col)).error
        some = let(c.col, lambda x: F.when(truth(_item(c, x)), x))
        return replace(c, col=some).with_error(c.col.isNotNull() & F.coalesce(failed, F.lit(False)) if failed is not None else None)
    return array(F.filter(c.col, lambda x: truth(_item(c, x))), c, item_errors(c, full))


@_function("select", 1)
def _select(compiler, c, args, focus):
    return _project(compiler, c, args[0])


def _project(compiler, c: Coll, node) -> Coll:
    if c.alternatives:
        return C._choice([got for a in c.alternatives if (got := _project(compiler, a, node)).kind != "Empty"], c.error)
    if c.kind == "Empty":
        return c
    make = lambda item: merged(compiler.of_item(node, item))
    if not c.many:
        got = make(_item(c, c.col))
        none = F.array().cast(T.ArrayType(got.dtype)) if got.many else None
        return replace(got, col=let(c.col, lambda x: F.when(x.isNotNull(), make(_item(c, x)).col).otherwise(none))).with_error(c.error)
    nested, like = for_each(c, make)
    return array(nested, replace(like, error=None), c.error, item_errors(c, make))


@_function("ofType", 1)
def _of_type(compiler, c, args, focus):
    return C.of_type(c, as_type_name(args[0]))


@_function("first", 0)
def _first(compiler, c, args, focus):
    c = merged(c)
    return replace(c, col=F.get(c.col, F.lit(0)), many=False) if c.many else c


@_function("last", 0)
def _last(compiler, c, args, focus):
    c = merged(c)
    return replace(c, col=F.try_element_at(c.col, F.lit(-1)), many=False) if c.many else c


@_function("tail", 0)
def _tail(compiler, c, args, focus):
    return _part(c, F.lit(1), None)


@_function("skip", 1)
def _skip(compiler, c, args, focus):
    n = _argument(compiler, args[0], focus, ("Integer",))
    return _part(c, n.col, None).with_error(n.error)


@_function("take", 1)
def _take(compiler, c, args, focus):
    n = _argument(compiler, args[0], focus, ("Integer",))
    return _part(c, F.lit(0), n.col).with_error(n.error)


def _part(c: Coll, skip: Column, take: Column | None) -> Coll:
    c = merged(c)
    if c.kind == "Empty":
        return c
    bounded = lambda n, xs: F.least(F.greatest(F.coalesce(n, F.lit(0)).cast("long"), F.lit(0)), F.size(xs).cast("long")).cast("int")
    part = lambda xs: F.slice(xs, bounded(skip, xs) + 1, F.size(xs) if take is None else bounded(take, xs))
    return array(let(items(c), part), c)


@_function("single", 0)
def _single(compiler, c, args, focus):
    return single(c)


@_function("repeat", 1)
def _repeat(compiler, c, args, focus):
    """The projection of the items, of those results and so on, each value once: as deep as the schema allows."""
    c, found, error = merged(c), [], c.error
    while c.kind != "Empty":
        c = merged(_project(compiler, c, args[0]))
        if c.kind == "Empty":
            break
        error = c.with_error(error).error
        if found and c.dtype == found[-1].dtype and c.kind == found[-1].kind and c.kind != "Complex":
            return _rounds(compiler, array(C.distinct(found[-1]).col, found[-1]), args[0], found).with_error(error)
        found.append(replace(c, error=None))
        if len(found) > 64:
            raise PathError("repeat() goes deeper than 64 levels")
    if not found:
        return empty(error)
    same = all(f.dtype == found[0].dtype and f.kind == found[0].kind for f in found)
    parts = found if same else [as_any(f) for f in found]
    return C.distinct(array(F.concat(*map(items, parts)), parts[0])).with_error(error)


#: Rounds of repeat() over values of one type: so many for all rows, then so many more for rows that need them. What still brings new values then does not end: an error of the row.
ROUNDS = (16, 4_096)


def _rounds(compiler, c: Coll, node, found: list[Coll]) -> Coll:
    """repeat() where results have the type of what they come from: each round projects the values that the one before brought."""
    kind = T.ArrayType(c.dtype)

    def step(acc: Column, _: Column) -> Column:
        fresh = merged(_project(compiler, Coll(acc["fresh"], c.dtype, c.kind, True), node))
        new = lambda xs: F.struct(F.concat(acc["seen"], xs).cast(kind).alias("seen"), xs.cast(kind).alias("fresh"))
        return F.when(F.size(acc["fresh"]) == 0, acc).otherwise(let(F.array_except(F.array_distinct(items(fresh).cast(kind)), acc["seen"]), new))

    before = C.distinct(array(F.concat(*(items(f) for f in found)), found[-1])) if all(f.dtype == c.dtype for f in found) else c
    state = F.struct(items(before).cast(kind).alias("seen"), items(c).cast(kind).alias("fresh"))

    def on(n: int) -> Callable[[Column], Column]:  # a row without new values goes no further
        return lambda s: F.when(F.size(s["fresh"]) == 0, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(n)), s, step))

    for n in ROUNDS:
        state = let(state, on(n))
    return Coll(state["seen"], c.dtype, c.kind, True).with_error(F.size(state["fresh"]) > 0)


@_function("iif", 2, 3)
def _iif(compiler, c, args, focus):
    test, error = C.boolean(compiler.operand(args[0], c))
    yes, no = compiler.operand(args[1], c), compiler.operand(args[2], c) if len(args) == 3 else empty()
    chosen = F.coalesce(test, F.lit(False))
    errors = [error]
    for branch, taken in ((yes, chosen), (no, ~chosen)):
        if branch.error is not None:
            errors.append(taken & branch.error)
    yes, no = merged(yes), merged(no)
    if yes.kind == no.kind == "Empty":
        return empty().with_error(*errors)
    if not yes.many and not no.many and (yes.kind == no.kind or "Empty" in (yes.kind, no.kind)):
        like = no if yes.kind == "Empty" else yes
        value = lambda b: F.lit(None).cast(like.dtype) if b.kind == "Empty" else b.col
        return replace(like, col=F.when(chosen, value(yes)).otherwise(value(no)), error=None).with_error(c.error, *errors)
    yes, no = C.alike(yes, no)
    return replace(array(F.when(chosen, items(yes)).otherwise(items(no)), yes), error=None).with_error(c.error, *errors)


# Trees


@_function("children", 0)
def _children(compiler, c, args, focus):
    return as_any(_levels(c, 1))


@_function("descendants", 0)
def _descendants(compiler, c, args, focus):
    return _levels(c, None)


def _fields(c: Coll) -> list[Coll]:
    """The children of complex items by field, in the order of names."""
    if c.alternatives:
        return [f for a in c.alternatives for f in _fields(a)]
    if c.kind == "Any":
        return [_mixed_children(c)]
    if not isinstance(c.dtype, T.StructType) or c.kind != "Complex":
        return []
    return [replace(C._field(c, name, None), error=None) for name in sorted(c.dtype.fieldNames())]


def _mixed_children(c: Coll) -> Coll:
    """The children of the objects among items of mixed kinds, in the order of their keys."""

    def children(x: Column) -> Column:
        entries = F.map_entries(F.try_parse_json(F.when(x["kind"] == "Complex", x["text"])).try_cast("map<string,variant>"))
        keyed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), variant_items(e["value"]).alias("xs")))
        return F.coalesce(F.flatten(F.transform(F.array_sort(keyed, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: e["xs"])), F.array().cast(T.ArrayType(ANY_TYPE)))

    return Coll(F.flatten(F.transform(items(c), children)), ANY_TYPE, "Any", True)


#: Levels of objects within parts of mixed kinds that descendants() takes; more of them are an error of the row.
_MIXED_LEVELS = 8


def _levels(c: Coll, depth: int | None) -> Coll:
    if c.kind == "Any" and depth != 1:
        level, found = c, []
        for _ in range(_MIXED_LEVELS):
            level = _mixed_children(level)
            found.append(level.col)
        return Coll(F.concat(*found), ANY_TYPE, "Any", True, c.error).with_error(F.exists(level.col, lambda x: x["kind"] == "Complex"))
    if c.many and depth == 1 and c.kind != "Any":
        nested, like = for_each(c, lambda x: _levels(x, 1))
        return array(nested, like, c.error)
    level, found = [c], []
    while level and (depth is None or depth > 0):
        level = [f for x in level for f in _fields(x)]
        found += level
        mixed = [f for f in level if merged(f).kind == "Any"] if depth is None else []
        for f in mixed:
            below = _levels(merged(f), None)
            found.append(replace(below, error=None))
            c = c.with_error(below.error)
        level = [f for f in level if all(f is not m for m in mixed)]
        depth = None if depth is None else depth - 1
    if not found:
        return empty(c.error)
    return Coll(F.concat(*(items(as_any(f)) for f in found)), ANY_TYPE, "Any", True, c.error)


# References and extensions


@_function("extension", 1)
def _extension(compiler, c, args, focus):
    url = _argument(compiler, args[0], focus, ("String",))
    got = merged(C.access(c, "extension"))
    if got.kind != "Complex" or "url" not in got.dtype.fieldNames():
        return empty(c.error)
    return array(F.filter(items(got), lambda e: F.coalesce(e["url"] == url.col, F.lit(False))), got, url.error)


@_function("resolve", 0)
def _resolve(compiler, c, args, focus):
    """The compiler resolves itself: it knows the call."""
    return empty(c.error)


# Texts


def _text(c: Coll) -> Coll:
    """The input as one text; numbers, truth values and objects are errors."""
    c = single(c)
    if c.kind in TEXT_KINDS:
        return c
    if c.kind == "Any":
        ok = F.array_contains(F.array(*map(F.lit, TEXT_KINDS)), c.col["kind"])
        return scalar(F.when(ok, c.col["text"]), "String", c.error, c.col.isNotNull() & ~ok)
    null = scalar(F.lit(None).cast("string"), "String", c.error)
    return null if c.kind == "Empty" else null.with_error(c.col.isNotNull())


def _text_function(name: str, kind: str, make: Callable, *parameters: str) -> None:
    def run(compiler, c, args, focus):
        text = _text(c)
        values = [_argument(compiler, a, focus, (p,)) for a, p in zip(args, parameters, strict=True)]
        return scalar(let(text.col, lambda s: make(s, *(v.col for v in values))), kind, text.error, *(v.error for v in values))

    _LIBRARY[name, len(parameters)] = run


def _replace(s: Column, a: Column, b: Column) -> Column:
    def replaced(a: Column, b: Column) -> Column:
        between = F.concat(b, F.array_join(F.split(s, ""), "\x00"), b)
        between = F.when(s == "", b).otherwise(F.replace(between, F.lit("\x00"), b))
        return F.when(a == "", between).otherwise(F.replace(s, a, b))

    return let(a, lambda x: let(b, lambda y: replaced(x, y)))


def _substring(s: Column, start: Column, n: Column | None = None) -> Column:
    length = F.length(s) if n is None else F.least(F.greatest(n, F.lit(0)), F.length(s).cast("long"))
    return let(start, lambda at: F.when((at >= 0) & (at < F.length(s)), F.substr(s, (at + 1).cast("int"), length.cast("int"))))


_text_function("length", "Integer", lambda s: F.length(s).cast("long"))
_text_function("upper", "String", F.upper)
_text_function("lower", "String", F.lower)
_text_function("trim", "String", lambda s: F.regexp_replace(s, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
_text_function("startsWith", "Boolean", lambda s, p: F.startswith(s, p), "String")
_text_function("endsWith", "Boolean", lambda s, p: F.endswith(s, p), "String")
_text_function("contains", "Boolean", lambda s, p: F.contains(s, p), "String")
_text_function("indexOf", "Integer", lambda s, p: (F.call_function("position", p, s) - 1).cast("long"), "String")
_text_function("replace", "String", _replace, "String", "String")
_text_function("substring", "String", _substring, "Integer")
_text_function("substring", "String", _substring, "Integer", "Integer")


#: Look-around and references back, which the language's expressions do not have: a pattern with one is a bad one.
_FOREIGN = r"(?<!\\)(?:\\\\)*(?:\(\?<?[=!]|\\[1-9]|\\k<)"


def _pattern(compiler, node, focus: Coll) -> tuple[Coll, Column | None]:
    """A regular expression, null where it is a bad one, and where that is so. A literal is compiled once, here; others where they are met."""
    p = _argument(compiler, node, focus, ("String",))
    if isinstance(node, Literal) and node.kind == "String":
        try:
            if re.search(_FOREIGN, node.value):
                raise ValueError("not of this language")
            SparkSession.active()._jvm.java.util.regex.Pattern.compile(node.value)
            return p, None
        except Exception:  # noqa: BLE001  (of the JVM, any)
            return replace(p, col=F.lit(None).cast("string")), F.lit(True)
    good = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p.col).isNotNull() & ~p.col.rlike(_FOREIGN)
    return replace(p, col=F.when(good, p.col)), p.col.isNotNull() & ~good


@_function("matches", 1)
def _matches(compiler, c, args, focus):
    text, (p, bad) = _text(c), _pattern(compiler, args[0], focus)
    found = F.when(p.col.isNotNull(), F.regexp_like(text.col, p.col))
    return scalar(found, "Boolean", text.error, p.error, None if bad is None else text.col.isNotNull() & bad)


@_function("replaceMatches", 2)
def _replace_matches(compiler, c, args, focus):
    """References to groups are $1 and ${1}; any other $ or a backslash stands for itself."""
    text, (p, bad) = _text(c), _pattern(compiler, args[0], focus)
    by = _argument(compiler, args[1], focus, ("String",))
    java = F.regexp_replace(F.regexp_replace(by.col, r"\\", r"\\\\"), r"\$\{(\d)\}", r"\$$1")
    java = F.regexp_replace(java, r"\$(?!\d)", r"\\\$")
    groups = F.length(F.regexp_replace(F.regexp_replace(p.col, r"\\.|\[[^\]]*\]|\(\?", ""), r"[^(]", ""))
    for n in range(1, 10):  # groups that the pattern has not are empty
        java = F.when(groups >= n, java).otherwise(F.replace(java, F.lit(f"${n}"), F.lit("")))
    found = F.when(p.col.isNotNull(), F.regexp_replace(text.col, p.col, java))
    return scalar(found, "String", text.error, p.error, by.error, None if bad is None else text.col.isNotNull() & bad)


def _texts(col: Column, c: Coll) -> Coll:
    return Coll(F.coalesce(col, F.array().cast("array<string>")), T.StringType(), "String", True, c.error)


@_function("toChars", 0)
def _to_chars(compiler, c, args, focus):
    text = _text(c)
    return _texts(let(text.col, lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))), text)


@_function("split", 1)
def _split(compiler, c, args, focus):
    text, by = _text(c), _argument(compiler, args[0], focus, ("String",))
    letters = lambda s: F.concat(F.array(F.lit("")), F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, "")), F.array(F.lit("")))
    quoted = F.concat(F.lit("\\Q"), F.replace(by.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return _texts(let(text.col, lambda s: F.when(by.col == "", letters(s)).otherwise(F.split(s, quoted, -1))), text).with_error(by.error)


@_function("join", 1)
def _join(compiler, c, args, focus):
    by, c = _argument(compiler, args[0], focus, ("String",)), merged(c)
    if c.kind == "Empty":
        return scalar(F.lit(""), "String", c.error, by.error)
    if c.kind not in TEXT_KINDS:
        return scalar(F.when(~present(c), ""), "String", c.error, by.error, present(c))
    return scalar(let(items(c), lambda xs: _joined(xs, by.col)), "String", c.error, by.error)


def _joined(xs: Column, by: Column) -> Column:
    first = F.coalesce(F.get(xs, F.lit(0)), F.lit(""))
    rest = F.transform(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x: F.concat(by, x))
    return F.concat(first, F.array_join(rest, ""))


# Numbers


def _number(c: Coll) -> Coll:
    c = single(c)
    c = C.like(c, scalar(F.lit(None), "Decimal"))
    if c.kind in NUMBER_KINDS:
        return c
    null = scalar(F.lit(None).cast("long"), "Integer", c.error)
    return null if c.kind == "Empty" else null.with_error(c.col.isNotNull())


@_function("abs", 0)
def _abs(compiler, c, args, focus):
    n = _number(c)
    return replace(n, col=F.abs(n.col))


def _whole(name: str, make: Callable) -> None:
    def run(compiler, c, args, focus):
        n = _number(c)
        return n if n.kind == "Integer" else scalar(make(n.col).try_cast("long"), "Integer", n.error)

    _LIBRARY[name, 0] = run


_whole("ceiling", F.ceil)
_whole("floor", F.floor)
_whole("truncate", lambda n: let(n, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))))
_whole("round", lambda x: F.round(x.try_cast(DECIMAL), 0))


@_function("round", 1)
def _round(compiler, c, args, focus):
    n, digits = _number(c), _argument(compiler, args[0], focus, ("Integer",))
    # the number of digits may differ between rows: ten to its power is exact in this range
    places = F.least(F.greatest(digits.col, F.lit(0)), F.lit(12)).cast("int")
    by = F.element_at(F.array(*(F.lit(10**k).cast("decimal(14,0)") for k in range(13))), places + 1)
    scaled = F.round(n.col.try_cast("decimal(24,12)") * by, 0).try_cast("decimal(38,0)")
    got = F.try_divide(scaled.try_cast("decimal(38,12)"), by).try_cast(DECIMAL)
    return scalar(got, "Decimal", n.error, digits.error, n.col.isNotNull() & digits.col.isNotNull() & got.isNull())


def _real(name: str, make: Callable, *parameters: tuple[str, ...]) -> None:
    def run(compiler, c, args, focus):
        n = _number(c)
        values = [_argument(compiler, a, focus, p) for a, p in zip(args, parameters, strict=True)]
        got = let(n.col.cast("double"), lambda x: make(x, *(v.col.cast("double") for v in values)))
        return scalar(let(got, lambda x: F.when(~F.isnan(x), x)).try_cast(DECIMAL), "Decimal", n.error, *(v.error for v in values))

    _LIBRARY[name, len(parameters)] = run


@_function("sqrt", 0)
def _sqrt(compiler, c, args, focus):
    n = _number(c)
    got = decimals.text(decimals.root(decimals.read(text_of(n.col, n.kind, n.dtype))))
    return Coll(got, T.StringType(), "Decimal", wide=True).with_error(n.error)


_real("exp", F.exp)
_real("ln", lambda x: F.when(x > 0, F.ln(x)))
_real("log", lambda x, b: F.when((x > 0) & (b > 0) & (b != 1), F.ln(x) / F.nullif(F.ln(b), F.lit(0.0))), NUMBER_KINDS)


@_function("power", 1)
def _power(compiler, c, args, focus):
    """Whole exponents are exact to the digits that fit; others are computed in double precision."""
    n, e = _number(c), _argument(compiler, args[0], focus, NUMBER_KINDS)
    if e.kind == "Integer":
        got = decimals.text(decimals.power(decimals.read(text_of(n.col, n.kind, n.dtype)), e.col))
        if n.kind == "Integer" and isinstance(getattr(args[0], "value", None), int) and args[0].value >= 0:
            return scalar(got.try_cast("long"), "Integer", n.error, e.error)
        return Coll(got, T.StringType(), "Decimal", wide=True).with_error(n.error, e.error)
    raised = lambda x, y: F.when((x >= 0) | (y == F.floor(y)), F.when((x != 0) | (y >= 0), F.pow(x, y)))
    got = let(n.col.cast("double"), lambda x: let(e.col.cast("double"), lambda y: raised(x, y)))
    return scalar(got.try_cast(DECIMAL), "Decimal", n.error, e.error)


# Conversions


def _to_text(c: Coll) -> Column:
    if c.kind in ("Complex", "Empty", "Object"):
        return F.lit(None).cast("string")
    if c.kind == "Any":
        return F.when(c.col["kind"] != "Complex", c.col["text"])
    return text_of(c.col, c.kind, c.dtype)


def _to_integer(c: Coll) -> Column:
    if c.kind in ("Integer", "Boolean"):
        return c.col.cast("long")
    if c.kind == "Decimal" and isinstance(c.dtype, T.StringType):
        return F.when(C.is_whole(c.col), c.col.try_cast("long"))
    if c.kind == "String":
        return F.when(c.col.rlike(r"^[+-]?[0-9]+$"), c.col.try_cast("long"))
    return F.lit(None).cast("long")


def _to_decimal(c: Coll) -> Column:
    if c.kind in NUMBER_KINDS:
        return c.col.try_cast(DECIMAL)
    if c.kind == "Boolean":
        return c.col.cast("int").cast(DECIMAL)
    if c.kind == "String":
        return F.when(c.col.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), c.col.try_cast(DECIMAL))
    return F.lit(None).cast(DECIMAL)


def _to_boolean(c: Coll) -> Column:
    if c.kind == "Boolean":
        return c.col
    if c.kind == "Integer":
        return F.when(c.col == 1, True).when(c.col == 0, False)
    if c.kind == "Decimal" and isinstance(c.dtype, T.StringType):
        return F.when(c.col == "1", True).when(c.col == "0", False)
    if c.kind == "String":
        low = F.lower(c.col)
        return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
    return F.lit(None).cast("boolean")


def _conversion(kind: str, make: Callable) -> None:
    def convert(compiler, c, args, focus):
        one = single(c)
        return scalar(make(one) if one.kind == "Empty" else let(one.col, lambda x: make(replace(one, col=x))), kind, one.error)

    def converts(compiler, c, args, focus):
        one = single(c)
        return empty(one.error) if one.kind == "Empty" else scalar(let(one.col, lambda x: F.when(x.isNotNull(), make(replace(one, col=x)).isNotNull())), "Boolean", one.error)

    _LIBRARY[f"to{kind}", 0], _LIBRARY[f"convertsTo{kind}", 0] = convert, converts


_conversion("String", _to_text)
_conversion("Integer", _to_integer)
_conversion("Decimal", _to_decimal)
_conversion("Boolean", _to_boolean)


def _shape(kind: str, pattern: str) -> None:
    def converts(compiler, c, args, focus):
        one = single(c)
        if one.kind == "Empty":
            return empty(one.error)
        ok = lambda x: x.rlike(pattern) if one.kind in TEXT_KINDS else F.lit(False)
        return scalar(let(one.col, lambda x: F.when(x.isNotNull(), ok(x))), "Boolean", one.error)

    _LIBRARY[f"convertsTo{kind}", 0] = converts


_shape("Date", temporal.DATE_SHAPE)
_shape("DateTime", temporal.DATETIME_SHAPE)


@_function("today", 0)
def _today(compiler, c, args, focus):
    return scalar(temporal.today(), "Date")


@_function("now", 0)
def _now(compiler, c, args, focus):
    return scalar(temporal.now(), "DateTime")
