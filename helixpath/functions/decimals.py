"""Decimals of 96 bits as Columns: a sign, a whole number ``n`` and ``s``, its digits after the point, 28 at most, whose zeros count.

Sums, products, quotients and roots are computed to all the digits that fit, and rounded half to even where more are known. What has more digits before the
point than fit is null. Products and quotients are put together of limbs and of runs of digits, as Spark's own decimals end at 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.values import let

#: The greatest whole number, and the digits that it has; the most digits after the point.
MOST = 2**96 - 1
DIGITS = 29
SCALE = 28
WHOLE = "decimal(38,0)"
#: Digits of a limb of a product, and of a step of a quotient; a remainder with a step's digits has 38 at most.
LIMB = 15
STEP = 9
#: Steps that give 28 digits after the point whatever the scales of dividend and divisor.
STEPS = 7


def _whole(x) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast(WHOLE)


def _value(negative: Column, n: Column, s: Column) -> Column:
    return F.struct(negative.alias("negative"), _whole(n).alias("n"), s.cast("int").alias("s"))


def _divided(a: Column, b: Column) -> Column:
    """The whole quotient of whole numbers that are not negative. Spark's quotients are rounded; of multiples they are exact."""
    return _whole((a - _whole(a % b)) / b)


def _power(s: Column) -> Column:
    return F.rpad(F.lit("1"), s + 1, F.lit("0")).cast(WHOLE)


def _all(make: Callable[..., Column], **named: Column) -> Column:
    """``make`` of columns that are computed once, all at the same depth of lambdas: each depth costs the analyzer a round."""
    return let(F.struct(*(c.alias(n) for n, c in named.items())), lambda x: make(*(x[n] for n in named)))


def _fit(negative: Column, digits: Column, scale: Column, more: Column | None = None) -> Column:
    """The value of a row of digits with ``scale`` of them after the point, rounded to what fits. ``more``: whether digits that are not zero would follow."""

    def placed(minus: Column, t: Column, e: Column, more: Column) -> Column:
        size = F.length(t)
        high = (size >= DIGITS) & (F.left(t, F.lit(DIGITS + 1)) >= f"{MOST}5")  # of so many digits MOST is exceeded
        s = F.least(F.lit(SCALE), e, e - size + DIGITS - high.cast("int"))
        return _all(rounded, minus=minus, t=t, s=s, drop=e - s, more=more)

    def rounded(minus: Column, t: Column, s: Column, drop: Column, more: Column) -> Column:
        size = F.length(t)
        kept = F.coalesce(F.left(t, F.greatest(size - drop, F.lit(0))).try_cast(WHOLE), _whole(0))
        rest = F.right(F.lpad(t, F.greatest(size, drop), F.lit("0")), drop)
        half = F.rpad(F.lit("5"), drop, F.lit("0"))
        up = (drop > 0) & ((rest > half) | ((rest == half) & (more | ((kept % _whole(2)) > 0))))
        return F.when(s >= 0, _value(minus, kept + F.when(up, _whole(1)).otherwise(_whole(0)), s))

    return _all(placed, minus=negative, t=F.ltrim(digits, F.lit("0")), e=scale.cast("int"), more=F.lit(False) if more is None else more)


def _stripped(v: Column, least: Column) -> Column:
    """Without the zeros at its end, but with ``least`` digits after the point where it has so many."""

    def run(x: Column) -> Column:
        text = x["n"].cast("string")
        kept = F.greatest(F.length(F.rtrim(text, F.lit("0"))), F.length(text) - F.greatest(x["s"] - least, F.lit(0)))
        return F.when(x["n"] == 0, _value(F.lit(False), _whole(0), F.lit(0))).when(x.isNotNull(), _value(x["negative"], F.left(text, kept).try_cast(WHOLE), x["s"] - F.length(text) + kept))

    return let(v, run)


def read(text: Column) -> Column:
    """The value of a text of digits with at most one point and a sign; of more digits than fit, rounded half up."""
    after = lambda t: F.when(F.contains(t, F.lit(".")), F.length(F.substring_index(t, ".", -1))).otherwise(0)

    def cut(t: Column, digits: Column, s: Column) -> Column:
        size = F.length(digits)
        high = (size >= DIGITS) & (F.left(digits, F.lit(DIGITS + 1)) >= f"{MOST}5")
        drop = F.greatest(s - SCALE, size - DIGITS + high.cast("int"), F.lit(0))
        kept = F.coalesce(F.left(digits, F.greatest(size - drop, F.lit(0))).try_cast(WHOLE), _whole(0))
        up = (drop > 0) & (drop <= size) & (F.substr(digits, size - drop + 1, F.lit(1)) >= "5")
        return F.when(s >= drop, _value(t.startswith("-"), kept + up.cast("int").cast(WHOLE), s - drop))

    digits = lambda t: F.ltrim(F.translate(t, "+-.", ""), F.lit("0"))
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?$")), _all(lambda d, s: cut(t, d, s), d=digits(t), s=after(t))))


def text(v: Column) -> Column:
    def run(x: Column) -> Column:
        digits = x["n"].cast("string")
        padded = F.lpad(digits, F.greatest(F.length(digits), x["s"] + 1), F.lit("0"))
        pointed = F.when(x["s"] == 0, digits).otherwise(F.concat(F.left(padded, F.length(padded) - x["s"]), F.lit("."), F.right(padded, x["s"])))
        return F.when(x.isNotNull(), F.concat(F.when(x["negative"] & (x["n"] > 0), "-").otherwise(""), pointed))

    return let(v, run)


def _pair(x: Column, y: Column, make: Callable[[Column, Column], Column]) -> Column:
    return _all(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), make(a, b)), a=x, b=y)


def _sign(v: Column) -> Column:
    return F.when(v["negative"], _whole(-1)).otherwise(_whole(1))


def _above(v: Column) -> Column:
    """The whole part, without the sign; and below it the fraction's 28 digits."""
    return _divided(v["n"], _power(v["s"]))


def _below(v: Column) -> Column:
    return _whole(_whole(v["n"] % _power(v["s"])) * _power(F.lit(SCALE) - v["s"]))


def plus(x: Column, y: Column, minus: bool = False) -> Column:
    """The sum or difference, with the zeros of the longer scale: whole parts and fractions of 28 digits are added apart."""
    unit = _whole(10**SCALE)

    def added(a: Column, b: Column) -> Column:
        other = -_sign(b) if minus else _sign(b)
        return _all(
            signed, w=_whole(_whole(_above(a) * _sign(a)) + _whole(_above(b) * other)), f=_whole(_whole(_below(a) * _sign(a)) + _whole(_below(b) * other)),
            longer=F.greatest(a["s"], b["s"]),
        )

    def signed(w: Column, f: Column, longer: Column) -> Column:
        # a fraction is under two units, so beyond one unit the whole part has the sign
        negative = F.when(w < -1, True).when(w > 1, False).otherwise(_whole(_whole(w * unit) + f) < 0)
        sign = F.when(negative, _whole(-1)).otherwise(_whole(1))
        return _all(carried, minus=negative, w=_whole(w * sign), f=_whole(f * sign), longer=longer)

    def carried(negative: Column, w: Column, f: Column, longer: Column) -> Column:
        k = F.when(f >= unit, _whole(1)).when(f < -unit, _whole(-2)).when(f < 0, _whole(-1)).otherwise(_whole(0))
        digits = F.concat(_whole(w + k).cast("string"), F.left(F.lpad(_whole(f - k * unit).cast("string"), SCALE, "0"), longer))
        return _fit(negative, digits, longer)

    return _pair(x, y, added)


def minus(x: Column, y: Column) -> Column:
    return plus(x, y, minus=True)


def times(x: Column, y: Column) -> Column:
    """The product, with the digits after the point of both: of two limbs each, whose products have 30 digits at most."""
    base = _whole(10**LIMB)
    padded = lambda c: F.lpad(_whole(c % base).cast("string"), LIMB, "0")

    def limbs(a: Column, b: Column) -> Column:
        high, low = (lambda v: _divided(v["n"], base)), (lambda v: _whole(v["n"] % base))
        return _all(products, minus=a["negative"] != b["negative"], s=a["s"] + b["s"], ah=high(a), al=low(a), bh=high(b), bl=low(b))

    def products(negative: Column, s: Column, ah: Column, al: Column, bh: Column, bl: Column) -> Column:
        return _all(carried, minus=negative, s=s, low=_whole(al * bl), middle=_whole(_whole(ah * bl) + _whole(al * bh)), high=_whole(ah * bh))

    def carried(negative: Column, s: Column, low: Column, middle: Column, high: Column) -> Column:
        middle = _whole(middle + _divided(low, base))
        return _fit(negative, F.concat(_whole(high + _divided(middle, base)).cast("string"), padded(middle), padded(low)), s)

    return _pair(x, y, limbs)


def over(x: Column, y: Column) -> Column:
    """The quotient, null of a divisor of zero: a long division of STEP digits a step. One without a remainder keeps the zeros that the scales leave; others have none."""
    shifted = lambda rest: _whole(_whole(rest) * F.lit(10**STEP).cast("decimal(10,0)"))

    def divided(a: Column, b: Column) -> Column:
        apart = a["s"] - b["s"]
        first = F.struct(shifted(a["n"] % b["n"]).alias("next"), _divided(a["n"], b["n"]).cast("string").alias("digits"))
        step = lambda d, _: F.struct(shifted(d["next"] % b["n"]).alias("next"), F.concat(d["digits"], F.lpad(_divided(d["next"], b["n"]).cast("string"), STEP, "0")).alias("digits"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step)
        fitted = let(found, lambda d: _fit(a["negative"] != b["negative"], d["digits"], F.lit(STEP * STEPS) + apart, d["next"] > 0))
        return F.when(b["n"] > 0, _stripped(fitted, F.when(a["n"] % b["n"] == 0, F.greatest(apart, F.lit(0))).otherwise(0)))

    return _pair(x, y, divided)


def root(x: Column) -> Column:
    """The square root, null of what is negative: two of Newton's steps from the double's, each of which doubles its 13 digits or more (of 4 at 1e-28)."""
    half = _value(F.lit(False), _whole(5), F.lit(1))

    def run(v: Column) -> Column:
        guess = F.sqrt(v["n"].cast("double") / F.pow(F.lit(10.0), v["s"])).try_cast("decimal(38,18)")
        near = F.aggregate(F.sequence(F.lit(1), F.lit(2)), read(guess.cast("string")), lambda r, _: times(plus(r, over(v, r)), half))
        return F.when(v["n"] == 0, v).when(~v["negative"], _stripped(near, F.lit(0)))

    return let(x, run)


def order(text: Column) -> Column:
    """What sorts and compares as the values of texts do: the whole part, and 38 digits of the fraction with the sign of the value. Without lambdas, which plans are spared."""
    part = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise("")
    fraction = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.rpad(part, 38, "0")).try_cast(WHOLE)
    return F.when(text.isNotNull(), F.struct(F.substring_index(text, ".", 1).try_cast(WHOLE).alias("w"), fraction.alias("f")))


def power(x: Column, e: Column) -> Column:
    """To a whole exponent, by squares for each of its bits; to a negative one, one over that. Null where it does not fit, and for zero to a negative one."""
    one = _value(F.lit(False), _whole(1), F.lit(0))

    def step(done: Column, bit: Column) -> Column:
        made = F.when(bit == "1", times(done["made"], done["square"])).otherwise(done["made"])
        return F.struct(made.alias("made"), times(done["square"], done["square"]).alias("square"))

    def run(v: Column, n: Column) -> Column:
        first = F.struct(one.alias("made"), v.alias("square"))
        raised = F.aggregate(F.split(F.reverse(F.bin(F.abs(n))), ""), first, step)["made"]
        return F.when(v.isNotNull() & n.isNotNull(), let(raised, lambda r: F.when(n >= 0, r).otherwise(over(one, r))))

    return _all(run, v=x, n=e.cast("long"))
