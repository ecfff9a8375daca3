"""Expressions and what they give, as data: rendered JSON for each, or an error."""

import json

import pytest

from helixpath.functions.library import names, register
from helixpath.plans.compiler import fhirpath
from helixpath.plans.syntax import PathError
from helixpath.sources.documents import inferred_schema, typed

PERSON = {
    "resourceType": "Patient", "id": "a7", "active": True, "birthDate": "1980-03-09",
    "name": [{"use": "official", "family": "Winter", "given": ["Ada", "May"]}, {"use": "nickname", "given": ["Addie"]}],
    "extension": [{"url": "http://x/1", "valueDate": "2001-02-03"}, {"url": "http://x/2", "valueString": "s"}],
    "multipleBirthInteger": 2,
}
MEASURE = {"resourceType": "Observation", "id": "m1", "status": "final", "subject": {"reference": "Patient/a7"}, "valueQuantity": {"value": 71.5, "unit": "kg"}}

ERROR = "error"
CASES = [
    # navigation
    (PERSON, "Patient.name.given", ["Ada", "May", "Addie"]), (PERSON, "name.family", ["Winter"]), (PERSON, "Observation.id", []), (PERSON, "none.at.all", []),
    (PERSON, "name[1].given", ["Addie"]), (PERSON, "name[7]", []), (PERSON, "name[-1]", []), (PERSON, "name['x']", ERROR), (PERSON, "$this.id", ["a7"]), (PERSON, "multipleBirth", [2]),
    (MEASURE, "Observation.value.unit", ["kg"]), (MEASURE, "value.ofType(Quantity).unit", ["kg"]), (MEASURE, "value.ofType(string)", []), (MEASURE, "(value as Quantity).value", [71.5]),
    (PERSON, "extension('http://x/2').value", ["s"]), (PERSON, "extension.value.ofType(date)", ["2001-02-03"]), (PERSON, "name.where(use = 'official').given.last()", ["May"]),
    (PERSON, "name.where(use)", ERROR), (PERSON, "name.select(given.first())", ["Ada", "Addie"]), (PERSON, "name.select(given.count())", [2, 1]), (PERSON, "name.repeat(given)", ["Ada", "May", "Addie"]),
    (PERSON, "name.children().count()", [6]), (PERSON, "descendants().where($this = 'Ada').count()", [1]), (MEASURE, "subject.resolve()", []),
    # existence and subsetting
    (PERSON, "name.exists()", [True]), (PERSON, "photo.exists()", [False]), (PERSON, "name.exists(use = 'nickname')", [True]), (PERSON, "name.all(given.exists())", [True]), (PERSON, "photo.all(false)", [True]),
    (PERSON, "name.empty()", [False]), (PERSON, "name.given.count()", [3]), (PERSON, "(name.given | name.given).count()", [3]), (PERSON, "photo.count()", [0]), (PERSON, "name.given.tail()", ["May", "Addie"]),
    (PERSON, "name.given.skip(2)", ["Addie"]), (PERSON, "name.given.skip(-1).count()", [3]), (PERSON, "name.given.take(1)", ["Ada"]), (PERSON, "name.given.take(0)", []), (PERSON, "name.given.single()", ERROR), (PERSON, "id.single()", ["a7"]),
    (PERSON, "photo.first()", []), (PERSON, "active.not()", [False]), (PERSON, "id.not()", ERROR), (PERSON, "name.exists(given.single() = 'Addie')", ERROR), (PERSON, "name.skip(1).exists(given.single() = 'Addie')", [True]),
    # comparison
    (PERSON, "name[0].family = 'Winter'", [True]), (PERSON, "name[0].family != 'X'", [True]), (PERSON, "photo = 1", []), (PERSON, "name.given = name.given", [True]), (PERSON, "name.given = 'Ada'", [False]), (PERSON, "1 = 1.0", [True]),
    (PERSON, "2 > 1", [True]), (PERSON, "'b' <= 'a'", [False]), (PERSON, "1 < 'a'", ERROR), (PERSON, "name.given > 'A'", ERROR), (PERSON, "'Addie' in name.given", [True]), (PERSON, "name.given contains 'Bob'", [False]), (PERSON, "photo in name", []),
    (PERSON, "1 in photo", [False]), (PERSON, "'A  b' ~ 'a B'", [True]), (PERSON, "photo ~ photo", [True]), (PERSON, "1 !~ 2", [True]), (PERSON, "birthDate < @1990-01-01", [True]), (PERSON, "@2015 < @2015T10", ERROR),
    (MEASURE, "value > 70 'kg'", [True]), (MEASURE, "value > 70 'lb'", []), (MEASURE, "value = 71.5 'kg'", [True]), (PERSON, "1 year = 1 'year'", [True]), (PERSON, "1 'mg' = 1 'kg'", []),
    # logic
    (PERSON, "active and photo", []), (PERSON, "(1 = 2) and photo", [False]), (PERSON, "active or photo", [True]), (PERSON, "true xor true", [False]), (PERSON, "photo implies true", [True]), (PERSON, "true implies photo", []), (PERSON, "false implies photo", [True]),
    (PERSON, "id and true", ERROR), (PERSON, "iif(active, 'y', 'n')", ["y"]), (PERSON, "iif(photo, 'y')", []), (PERSON, "iif(true, 1, name.given.single())", [1]),
    # types
    (PERSON, "id is string", [True]), (PERSON, "active is Boolean", [True]), (PERSON, "birthDate is date", [True]), (PERSON, "1 is System.Integer", [True]), (PERSON, "photo is string", []), (PERSON, "name is HumanName", ERROR), (MEASURE, "value is Quantity", [True]), (PERSON, "id as integer", []),
    # arithmetic
    (PERSON, "2 + 3", [5]), (PERSON, "7 / 2", [3.5]), (PERSON, "7 div 2", [3]), (PERSON, "-7 div 2", [-3]), (PERSON, "-7 mod 3", [-1]), (PERSON, "1 / 0", []), (PERSON, "1 div 0", []), (PERSON, "'a' + 'b'", ["ab"]), (PERSON, "'a' & photo", ["a"]), (PERSON, "'a' & 1", ERROR),
    (PERSON, "1 + 'a'", ERROR), (PERSON, "1.5 * 2", [3]), (PERSON, "0.1 + 0.2 = 0.3", [True]), (PERSON, "photo + 1", []), (PERSON, "9223372036854775807 + 1", [9223372036854775808]), (PERSON, "(9223372036854775807 + 1) is decimal", [True]), (PERSON, "multipleBirth.toInteger() + 9223372036854775807", ERROR), (PERSON, "(2 'mg' * 3) = 6 'mg'", [True]), (PERSON, "1 'mg' + 1 'kg'", []), (PERSON, "(1 'mg' + 2 'mg').value", [3]),
    # text
    (PERSON, "'h\\u00e9llo'.length()", [5]), (PERSON, "'Ab'.upper() & 'Ab'.lower()", ["ABab"]), (PERSON, "'  x '.trim()", ["x"]), (PERSON, "'hello'.startsWith('he')", [True]), (PERSON, "'hello'.endsWith('lo')", [True]), (PERSON, "'hello'.contains('ell')", [True]),
    (PERSON, "'hello'.indexOf('l')", [2]), (PERSON, "'hello'.indexOf('z')", [-1]), (PERSON, "'hello'.substring(1, 3)", ["ell"]), (PERSON, "'hello'.substring(3)", ["lo"]), (PERSON, "'hello'.substring(5)", []), (PERSON, "'hello'.substring(1, -1)", [""]), (PERSON, "'aXbX'.replace('X', '-')", ["a-b-"]),
    (PERSON, "'ab'.replace('', '-')", ["-a-b-"]), (PERSON, "'a.b.c'.split('.')", ["a", "b", "c"]), (PERSON, "'abc'.toChars()", ["a", "b", "c"]), (PERSON, "name.given.join('+')", ["Ada+May+Addie"]), (PERSON, "photo.join(',')", [""]), (PERSON, "'a1b22'.matches('[0-9]{2}')", [True]),
    (PERSON, "'a1b22'.replaceMatches('([0-9]+)', '<$1>')", ["a<1>b<22>"]), (PERSON, "photo.upper()", []), (PERSON, "1.upper()", ERROR), (PERSON, "name.given.upper()", ERROR), (PERSON, "'a'.startsWith(1)", ERROR),
    # numbers
    (PERSON, "(-3).abs()", [3]), (PERSON, "2.1.ceiling()", [3]), (PERSON, "2.9.floor()", [2]), (PERSON, "(-2.9).truncate()", [-2]), (PERSON, "2.5.round()", [3]), (PERSON, "(-2.5).round()", [-3]), (PERSON, "3.14159.round(2)", [3.14]), (PERSON, "9.sqrt()", [3]), (PERSON, "(-1).sqrt()", []),
    (PERSON, "0.exp()", [1]), (PERSON, "0.ln()", []), (PERSON, "8.log(2).round(6)", [3]), (PERSON, "2.power(10)", [1024]), (PERSON, "(-8).power(0.5)", []), (PERSON, "'x'.abs()", ERROR),
    # conversions
    (PERSON, "1.toString()", ["1"]), (PERSON, "1.50.toString()", ["1.50"]), (PERSON, "(1.10 + 2.20).toString()", ["3.30"]), (PERSON, "(1.50 * 2.0).toString()", ["3.000"]), (PERSON, "(1.5 - 2).toString() & (2 * 0.5).toString()", ["-0.51.0"]), (PERSON, "(iif(active, 1.10, 2) + multipleBirth).toString()", ["3.10"]), (PERSON, "true.toString()", ["true"]), (PERSON, "name[0].toString()", []), (PERSON, "'42'.toInteger()", [42]), (PERSON, "' 42'.toInteger()", []), (PERSON, "1.5.toInteger()", []), (PERSON, "'1.5'.toDecimal()", [1.5]),
    (PERSON, "'TRUE'.toBoolean()", [True]), (PERSON, "2.toBoolean()", []), (PERSON, "'x'.convertsToInteger()", [False]), (PERSON, "photo.convertsToString()", []), (PERSON, "'2015-02'.convertsToDate()", [True]), (PERSON, "'x'.convertsToDateTime()", [False]),
    # dates
    (PERSON, "@2014-01-31 + 1 month", ["2014-02-28"]), (PERSON, "@2014 + 1 year", ["2015"]), (PERSON, "@2014 + 1 day", []), (PERSON, "@2016-02-29 - 1 year", ["2015-02-28"]), (PERSON, "@2014-12-31T23:30:00Z + 45 minutes", ["2015-01-01T00:15:00Z"]), (PERSON, "@2014-01 + 2 weeks", []),
    (PERSON, "@2014-01-01 + 1.5 days", []), (PERSON, "birthDate + 1 day", ERROR), (PERSON, "today() = today()", [True]), (PERSON, "now() is DateTime", [True]), (PERSON, "@2014-01-01T10:00:00.5+02:00 + 1 hour", ["2014-01-01T11:00:00.5+02:00"]),
]


@pytest.fixture(scope="module")
def documents(spark):
    out = {}
    for doc in (PERSON, MEASURE):
        raw = spark.createDataFrame([(json.dumps(doc),)], "json string")
        out[doc["id"]] = typed(raw, inferred_schema(raw)).select("resource")
    return out


@pytest.mark.parametrize("doc", [PERSON, MEASURE], ids=["person", "measure"])
def test_cases(documents, doc):
    frame, wrong = documents[doc["id"]], []
    cases = [(e, want) for d, e, want in CASES if d is doc]
    for k in range(0, len(cases), 20):  # several expressions in one pass
        out = frame
        for i, (e, _) in enumerate(cases[k : k + 20]):
            out = fhirpath(out, "resource", e, output=f"r{i}", errors=f"e{i}", render=True)
        row = out.first()
        for i, (e, want) in enumerate(cases[k : k + 20]):
            got = ERROR if row[f"e{i}"] else json.loads(row[f"r{i}"])
            if got != want:
                wrong.append((e, got, want))
    assert not wrong


@pytest.mark.parametrize("bad", ["name.nope()", "name.where()", "today(1)", "id.is(string)", "name.combine(name)"])
def test_unknown_functions(documents, bad):
    with pytest.raises(PathError):
        fhirpath(documents["a7"], "resource", bad)


def test_strict_raises(documents):
    with pytest.raises(Exception, match="evaluation failed"):
        fhirpath(documents["a7"], "resource", "name.given.single()", strict=True).collect()


def test_all_functions_and_registration(documents):
    assert len(names()) == 58
    from helixpath.functions import library
    from helixpath.plans.values import items, scalar
    from pyspark.sql import functions as F

    register("longest", 0, lambda compiler, c, args, focus: scalar(F.array_max(F.transform(items(c), F.length)).cast("long"), "Integer", c.error))
    try:
        assert fhirpath(documents["a7"], "resource", "name.given.longest()").first()["result"] == 5
    finally:
        library._LIBRARY.pop(("longest", 0))


def test_nested_columns_are_pruned(spark, tmp_path):
    raw = spark.createDataFrame([(json.dumps(PERSON),)], "json string")
    typed(raw, inferred_schema(raw)).select("resource").write.parquet(str(tmp_path / "p"))
    plan = fhirpath(spark.read.parquet(str(tmp_path / "p")), "resource", "name.family", errors=None).select("result")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<resource:struct<name:array<struct<family:string>>>>" in plan
    plan = fhirpath(spark.read.parquet(str(tmp_path / "p")), "resource", "name.family.first()", errors=None).select("result")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<resource:struct<name:array<struct<family:string>>>>" in plan


NUMBERS = [
    ("a", ["0.10"]), ("a + 0.2", ["0.30"]), ("b", ["12345678901234567890.123456789012345678"]), ("many", ["1.50", "-2.0", "3.25"]), ("many.where($this > 0)", ["1.50", "3.25"]), ("a.toString() & 'x'", ['"0.10x"']),
    ("0.1234567890123456 * 1", ["0.1234567890123456"]), ("100000000000000000.5 * 2", ["200000000000000001.0"]), ("many.select($this * 2.0)", ["3.000", "-4.00", "6.500"]), ("123456789012345.5 / 3", ["41152263004115.166666666666667"]), ("b * b", "error"), ("b + b", ["24691357802469135780.246913578"]), ("1 / 0", []), ("a = 0.1", ["true"]), ("a in many", ["false"]), ("(a | 0.1).count()", ["1"]),
    ("many.distinct().count()", ["3"]), ("t.matches('[')", "error"), ("t.matches('(?=x)')", "error"), ("t.matches(bad)", "error"), ("t.matches(good)", ["true"]), ("t.replaceMatches('(', 'x')", "error"), ("t.replaceMatches(bad, 'x')", "error"), ("nothing.matches('[')", []),
    ("t.replaceMatches('(b)', '<$1>')", ['"a<b>c"']), ("t.replaceMatches('b', '$1$')", ['"a$c"']), ("t.replaceMatches('(b)', '${1}\\\\')", ['"ab\\\\c"']), ("tags.repeat($this)", ['"x"', '"y"']), ("tags.repeat(iif($this = 'x', 'z', $this))", ['"z"', '"y"']),
    ("tags.repeat($this & 'x')", "error"), ("q.value", ["1.50"]), ("(q * 2).value", ["3"]), ("q", ['{"unit":"mg","value":1.50}']), ("q + q", ['{"value":3,"unit":"mg"}']), ("q = q", ["true"]), ("a.round(1)", ["0.1"]), ("b.round(2)", "error"),
    ("1 / 3", ["0.3333333333333333333333333333"]), ("1.50 / 3", ["0.50"]), ("1 / 3 * 3", ["0.9999999999999999999999999999"]), ("1 / 3 = 0.333333333333333333", ["false"]), ("b > 12345678901234567890.1234567", ["true"]), ("many.where($this / 3 > 0.5)", ["3.25"]),
    ("2.sqrt()", ["1.4142135623730950488016887242"]), ("(-1).sqrt()", []), ("3.power(39)", ["4052555153018976267"]), ("1.1.power(2)", ["1.21"]), ("2.power(-2)", ["0.25"]), ("0.power(-1)", []),
]


def test_numbers_keep_their_text_and_errors_stay_in_their_row(spark):
    doc = '{"a": 0.10, "b": 12345678901234567890.123456789012345678, "many": [1.50, -2.0, 3.25], "t": "abc", "bad": "[a", "good": "^a.c$", "tags": ["x", "y"], "q": {"value": 1.50, "unit": "mg"}}'
    raw = spark.createDataFrame([(doc,)], "json string")
    rows, wrong = typed(raw, inferred_schema(raw)), []
    for k in range(0, len(NUMBERS), 12):
        out = rows
        for i, (e, _) in enumerate(NUMBERS[k : k + 12]):
            out = fhirpath(out, "resource", e, output=f"r{i}", errors=f"e{i}", render=True)
        row = out.first()
        for i, (e, want) in enumerate(NUMBERS[k : k + 12]):
            got = "error" if row[f"e{i}"] else row[f"r{i}"]
            if want is not None and got != (want if want == "error" else f"[{','.join(want)}]"):
                wrong.append((e, got, want))
            if want is None and got == "error":
                wrong.append((e, got, want))
    assert not wrong


LONG = [
    ("n{}.count()", ".skip(1)", 60), ("n{}.count()", ".where($this > 0).tail()", 30), ("name.select(given{}.count()).first()", ".tail()", 40), ("t{}", ".substring(0).trim()", 20), ("n.first(){}", " + 1", 40),
    ("n.select($this{}).first()", " + 1", 30), ("(t = t){}", " = true", 20), ("iif(n.first() = 1, t, 'y'){}", ".upper().lower()", 20), ("name.where(given{}.exists()).count()", ".where($this != 'x')", 20),
]


def test_plans_grow_with_the_steps(spark):
    raw = spark.createDataFrame([(json.dumps({"n": [1, 2, 3] * 30, "t": " abc ", "name": [{"given": ["a", "b"]}, {"given": ["c"]}]}),)], "json string")
    rows = typed(raw, inferred_schema(raw))
    for form, step, most in LONG:
        size = {}
        for n in (most // 4, most // 2, most):
            found = fhirpath(rows, "resource", form.format(step * n), render=True).select("result", "error")
            size[n] = len(found._jdf.queryExecution().analyzed().toString())
        # errors within a lambda name the values that they come from: with the square of the steps there, else in proportion
        assert size[most] - size[most // 2] < (5 if "$this{}" in form else 3) * (size[most // 2] - size[most // 4]) + 5_000, (form, size)
        assert not found.first()["error"], form


def test_steps_leave_columns_and_pruning_alone(spark, tmp_path):
    raw = spark.createDataFrame([(json.dumps(PERSON),)], "json string")
    typed(raw, inferred_schema(raw)).select("resource").write.parquet(str(tmp_path / "p"))
    found = fhirpath(spark.read.parquet(str(tmp_path / "p")), "resource", "name.family.first() & id & name.family.skip(0).last()", errors=None)
    assert found.columns == ["resource", "result"] and found.first()["result"] == "Wintera7Winter"
    assert "ReadSchema: struct<resource:struct<id:string,name:array<struct<family:string>>>>" in found.select("result")._jdf.queryExecution().executedPlan().toString()


#: One kind of part in each document: a table of all of them gives each document what it gives alone.
MIXED = [
    '{"a":1,"n":1,"o":7}', '{"a":"z","n":2.50}', '{"a":1.50,"n":3.0}', '{"a":{"x":1,"y":"q","z":1.50},"o":{"x":{"valueDate":"2020-01-01"}}}', '{"a":[1,"b",[2.0,{"x":9}]],"o":"2"}', '{"a":{"value":2.50,"unit":"mg"}}', "{}",
]
MIXED_PATHS = [
    "a", "a + 1", "a is integer", "a.x", "o.x.value is date", "a & 'k'", "a.toString()", "a.toInteger()", "a > 0", "a.where($this is string)", "a and true", "a | o", "n is integer", "n + 1", "a.children()", "descendants().count()", "$this",
]


def _rendered(spark, texts, paths):
    raw = spark.createDataFrame(list(enumerate(texts)), "i int, json string").coalesce(1)
    out, given = [], typed(raw, inferred_schema(raw))
    for k in range(0, len(paths), 8):
        found = given
        for j, e in enumerate(paths[k : k + 8]):
            found = fhirpath(found, "resource", e, output=f"r{j}", errors=f"e{j}", render=True)
        rows = {r["i"]: r for r in found.drop("resource").collect()}
        out += [[ERROR if rows[i][f"e{j}"] else rows[i][f"r{j}"] for i in range(len(texts))] for j in range(len(paths[k : k + 8]))]
    return out


def test_documents_do_not_depend_on_each_other(spark):
    together = _rendered(spark, MIXED, MIXED_PATHS)
    for i, text in enumerate(MIXED):
        alone = _rendered(spark, [text], MIXED_PATHS)
        assert [(e, r[0]) for e, r in zip(MIXED_PATHS, alone, strict=True)] == [(e, r[i]) for e, r in zip(MIXED_PATHS, together, strict=True)], text


def test_repeat_goes_on_to_its_end(spark):
    chain = json.dumps({"next": [f"{i}" for i in range(1)], "many": [f"{i}" for i in range(50)]})
    raw = spark.createDataFrame([(chain,)], "json string")
    rows = typed(raw, inferred_schema(raw))
    count_up = "iif(toInteger() < 1000, (toInteger() + 1).toString(), '0')"
    for path, want in ((f"next.repeat({count_up}).count()", 1001), (f"many.repeat({count_up}).count()", 1001), ("next.repeat(iif(toInteger() < 3, (toInteger() + 1).toString())).join(',')", "1,2,3")):
        assert fhirpath(rows, "resource", path, strict=True).first()["result"] == want, path
