"""Decimals of 96 bits against Python's, at 120 digits, rounded once."""

import random
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

from pyspark.sql import functions as F

from helixpath.functions import decimals as D

EDGES = [
    ("1", "3"), ("1.50", "3"), ("1.00", "4"), ("0", "3"), ("5", "0"), ("79228162514264337593543950335", "1"), ("79228162514264337593543950335", "0.1"), ("79228162514264337593543950335", "-79228162514264337593543950335"),
    ("0.0000000000000000000000000001", "3"), ("-1", "3"), ("1", "0.0000000000000000000000000001"), ("0.5", "0.5000"), ("-0.5", "0.4"), (None, "1"), ("x", "1"), ("", "1"),
]


def _number(r: random.Random) -> str:
    digits = r.choice([1, 2, 5, 9, 15, 20, 28])
    return f"{Decimal(r.choice([1, 1, -1]) * r.randrange(1, 10**digits)).scaleb(-r.randrange(0, min(28, digits + 3) + 1)):f}"


def _fitted(value: Decimal, scale: int) -> Decimal | None:
    for s in range(min(28, scale), -1, -1):
        got = value.quantize(Decimal(1).scaleb(-s), rounding=ROUND_HALF_EVEN)
        if abs(int(got.scaleb(s))) < 2**96:
            return got
    return None


def _scale(text: str) -> int:
    return len(text.partition(".")[2])


def test_decimals_have_all_digits_that_fit(spark):
    r = random.Random(5)
    pairs = EDGES + [(_number(r), _number(r)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": D.read(F.col("a")), "y": D.read(F.col("b"))})
    operations = {"plus": D.plus, "minus": D.minus, "times": D.times, "over": D.over}
    columns = [D.text(make(F.col("x"), F.col("y"))).alias(name) for name, make in operations.items()]
    columns += [D.text(D.root(F.col("x"))).alias("root"), D.text(D.power(F.col("x"), F.lit(3))).alias("cube"), (D.order(F.col("a")) < D.order(F.col("b"))).alias("less")]
    wrong = []
    with localcontext() as exact:
        exact.prec = 120
        for row in df.select("a", "b", *columns).collect():
            if row.a in (None, "x", ""):
                wrong += [(row, name) for name in (*operations, "root", "cube") if row[name] is not None]
                continue
            a, b, m, n = Decimal(row.a), Decimal(row.b), _scale(row.a), _scale(row.b)
            want = {"plus": _fitted(a + b, max(m, n)), "minus": _fitted(a - b, max(m, n)), "times": _fitted(a * b, m + n)}
            for name, w in want.items():  # with their zeros, but for the sign of zero
                if (row[name] or "").lstrip("-" if w == 0 else "") != ("" if w is None else f"{abs(w) if w == 0 else w:f}"):
                    wrong.append((row.a, row.b, name, row[name], w))
            quotient = _fitted(a / b, 28) if b else None
            if (None if row.over is None else Decimal(row.over)) != quotient:
                wrong.append((row.a, row.b, "over", row.over, quotient))
            if (row.root is None) != (a < 0) or (a >= 0 and abs(Decimal(row.root) - a.sqrt()) > max(a.sqrt() * Decimal("1e-27"), Decimal("1e-28"))):
                wrong.append((row.a, "root", row.root))
            cube = _fitted(a**3, 28)
            if (row.cube is None) != (cube is None) or (cube is not None and abs(Decimal(row.cube) - cube) > max(abs(cube) * Decimal("1e-27"), Decimal("2e-28") * max(abs(a), 1))):
                wrong.append((row.a, "cube", row.cube, cube))
            if row.less != (a < b):
                wrong.append((row.a, row.b, "less"))
    assert not wrong, "\n".join(map(str, wrong))
