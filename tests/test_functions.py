"""Scalar functions and aggregates against known PostgreSQL answers, NULLs included."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.functions import aggregate as A
from tessella.functions import array as AR
from tessella.functions import datetime as D
from tessella.functions import json as J
from tessella.functions import numeric as N
from tessella.functions import range as R
from tessella.functions import string as S
from tessella.operators import predicates as P


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return row.asDict(recursive=True)


L = F.lit


def test_strings(spark):
    got = one(
        spark, sub0=S.substring(L("hello"), 0, 3), neg=S.substring(L("hello"), -1, 4), l2=S.left(L("hello"), -2), r2=S.right(L("hello"), -2), r9=S.right(L("hello"), 9), rx=S.regexp_replace(L("aXbXc"), "X", "-"),
        br=S.regexp_replace(L("foobar"), "(o+)(b)", "\\2\\1"), cc=S.concat(L("a"), F.lit(None).cast("string"), L("b")), ic=S.initcap(L("hello wORLD-foo1bar")), ch=S.chr_(L(8364)), fm=S.format_("%s is %I, %L%%", L("x"), L("My col"), L("it's")),
        fn=S.format_("[%s]", F.lit(None).cast("string")), pos=S.format_("%2$s %1$s", L("a"), L("b")), tn=S.to_number(L("12.5-"), "99.9MI"), td=S.to_char(L(dt.datetime(2024, 6, 15, 13, 5, 9)), "Mon DD YYYY HH24:MI"), trim=S.trim(L("xxhixy"), "xy"),
    )
    assert got == {
        "sub0": "he", "neg": "he", "l2": "hel", "r2": "llo", "r9": "hello", "rx": "a-bXc", "br": "fbooar", "cc": "ab", "ic": "Hello World-Foo1bar", "ch": "€", "fm": "x is \"My col\", 'it''s'%", "fn": "[]", "pos": "b a",
        "tn": Decimal("-12.5"), "td": "Jun 15 2024 13:05", "trim": "hi",
    }


def test_negative_substring_length_raises(spark):
    with pytest.raises(Exception, match="negative substring"):
        one(spark, x=S.substring(L("hello"), 2, -1))


def test_numbers(spark):
    got = one(spark, e=N.round_(L(2.5), of="double"), a=N.round_(L(Decimal("2.5"))), t=N.trunc(L(-2.7), "double"), lg=N.log(L(1000.0)), g=N.greatest(L(1)), c=P.cast(L(2.6), "int", "double"), h=P.cast(L(2.5), "int", "double"))
    assert got == {"e": 2.0, "a": Decimal("3"), "t": -2.0, "lg": 3.0, "g": 1, "c": 3, "h": 2}
    for bad in (N.sqrt(L(-1.0)), N.ln(L(0.0)), N.log(L(-1.0)), N.asin(L(2.0)), N.acos(L(-2.0))):
        with pytest.raises(Exception):
            one(spark, x=bad)


def test_overlaps_is_half_open_and_three_valued(spark):
    d = lambda x: L(dt.date.fromisoformat(x))
    got = one(
        spark, inst=D.overlaps(d("2024-06-01"), d("2024-06-01"), d("2024-01-01"), d("2024-12-31")), old=D.overlaps(d("2000-01-01"), d("2000-01-01"), d("2024-01-01"), d("2024-12-31")),
        touch=D.overlaps(d("2024-01-01"), d("2024-02-01"), d("2024-02-01"), d("2024-03-01")), swapped=D.overlaps(d("2024-03-01"), d("2024-01-01"), d("2024-02-01"), d("2024-02-02")), null=D.overlaps(d("2024-01-01"), F.lit(None).cast("date"), d("2024-02-01"), d("2024-03-01")),
    )
    assert got == {"inst": True, "old": False, "touch": False, "swapped": True, "null": None}


def test_age_and_justify(spark):
    ts = lambda x: L(x).cast("timestamp_ntz")
    got = one(spark, a=D.age(ts("2024-03-01"), ts("2023-12-15 12:00:00")), n=D.age(ts("2023-12-15"), ts("2024-03-01")), j=D.justify_interval(D.interval(L(1), L(-1), L(0))), d=D.justify_days(D.interval(L(0), L(65), L(0))), h=D.justify_hours(D.interval(L(0), L(0), L(27 * 3_600_000_000))))
    assert got["a"] == {"months": 2, "days": 16, "micros": 12 * 3_600_000_000}
    assert got["n"]["months"] == -2
    assert got["j"] == {"months": 0, "days": 29, "micros": 0}
    assert got["d"] == {"months": 2, "days": 5, "micros": 0}
    assert got["h"] == {"months": 0, "days": 1, "micros": 3 * 3_600_000_000}


def test_extract(spark):
    ts = L("2024-06-16 13:05:09.25").cast("timestamp_ntz")
    got = one(spark, dow=D.extract("dow", ts), iso=D.extract("isodow", ts), sec=D.extract("second", ts), ep=D.extract("epoch", ts), ce=D.extract("century", ts))
    assert got == {"dow": 0, "iso": 7, "sec": Decimal("9.25"), "ep": Decimal("1718543109.25"), "ce": 21}


def test_arrays(spark):
    a, e = F.array(L(1), F.lit(None).cast("int"), L(2), L(1)), F.array().cast("array<int>")
    got = one(
        spark, ct=AR.contains(a, F.array(L(1))), cn=AR.contains(a, F.array(F.lit(None).cast("int"))), ce=AR.contains(a, e), ov=AR.overlaps(a, F.array(L(9))), le=AR.array_length(e), ln=AR.array_length(a), l2=AR.array_length(a, 2), ps=AR.array_position(a, 2), pn=AR.array_position(a, F.lit(None).cast("int")),
        pz=AR.array_position(a, 9), pp=AR.array_positions(a, 1), pe=AR.array_positions(e, 1), rm=AR.array_remove(a, F.lit(None).cast("int")), rp=AR.array_replace(a, F.lit(None).cast("int"), 7), ts=AR.array_to_string(a, ",", "*"), tn=AR.array_to_string(a, ","), sa=AR.string_to_array(L("a.b"), "."),
        se=AR.string_to_array(L(""), "."), sx=AR.string_to_array(L("ab"), ""), cc=AR.concat(F.lit(None).cast("array<int>"), F.array(L(3))), el=AR.elem_of(5, a),
    )
    assert got == {
        "ct": True, "cn": False, "ce": True, "ov": False, "le": None, "ln": 4, "l2": None, "ps": 3, "pn": 2, "pz": None, "pp": [1, 4], "pe": [], "rm": [1, 2, 1], "rp": [1, 7, 2, 1], "ts": "1,*,2,1", "tn": "1,2,1", "sa": ["a", "b"],
        "se": [], "sx": ["ab"], "cc": [3], "el": None,
    }


def test_aggregates(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "y"), (4, None), (5, "x")], "n int, s string")
    row = df.agg(A.variance(F.col("n")).alias("v"), A.var_pop(F.col("n")).alias("vp"), A.array_agg(F.col("s")).alias("a"), A.string_agg(F.col("s"), ",", ordered=True).alias("t"), A.bool_and(F.col("n") > 0).alias("b")).first()
    assert (row.v, row.vp, sorted(row.a, key=str), row.t, row.b) == (2.5, 2.0, [None, None, "x", "x", "y"], "x,x,y", True)
    none = df.filter("n > 9").agg(A.array_agg(F.col("s")).alias("a"), A.string_agg(F.col("s"), ",").alias("t")).first()
    assert (none.a, none.t) == (None, None)


def _ranges():
    bounds = [None, 1, 2, 3]
    out = [("empty", None)]
    for lo in bounds:
        for hi in bounds:
            if lo is None or hi is None or lo < hi:
                out.append((lo, hi))
    return out


def _points(r):
    if r[0] == "empty":
        return set()
    lo, hi = r
    return set(range(-3 if lo is None else lo, 8 if hi is None else hi))


def test_range_operators_against_sets(spark):
    every = _ranges()
    rows = [(i, j, a[0] == "empty", None if a[0] == "empty" else a[0], a[1], b[0] == "empty", None if b[0] == "empty" else b[0], b[1]) for i, a in enumerate(every) for j, b in enumerate(every)]
    df = spark.createDataFrame(rows, "i int, j int, ea boolean, la int, ha int, eb boolean, lb int, hb int")
    build = lambda e, lo, hi: F.when(F.col(e), R.empty("int4range")).otherwise(R.int4range(F.col(lo), F.col(hi)))
    df = df.select("i", "j", build("ea", "la", "ha").alias("a"), build("eb", "lb", "hb").alias("b"))
    a, b = F.col("a"), F.col("b")
    got = df.select("i", "j", R.contains(a, b).alias("ct"), R.overlaps(a, b).alias("ov"), R.strictly_left(a, b).alias("sl"), R.adjacent(a, b).alias("ad"), R.intersect("int4range", a, b).alias("x"), R.does_not_extend_right(a, b).alias("nr")).collect()
    for row in got:
        x, y = _points(every[row.i]), _points(every[row.j])
        assert row.ct == (y <= x), row
        assert row.ov == bool(x & y), row
        assert row.sl == bool(x and y and max(x) < min(y) and every[row.i][1] is not None and every[row.j][0] is not None), row
        assert row.nr == bool(x and y and max(x) <= max(y)), row
        low, high = row.x["lower"], row.x["upper"]
        found = set() if row.x["is_empty"] else set(range(-3 if low is None else low, 8 if high is None else high))
        assert found == x & y, row
        assert row.ad == bool(x and y and (every[row.i][1] == every[row.j][0] is not None or every[row.j][1] == every[row.i][0] is not None)), row


def test_range_forms(spark):
    got = one(
        spark, c=R.to_text(R.int4range(L(1), L(5), "(]")), e=R.to_text(R.int4range(L(2), L(2))), n=R.to_text(R.numrange(L(Decimal("1.5")), F.lit(None), "[]")), d=R.to_text(R.literal("daterange", "[2024-01-01,2024-12-30]")), u=R.to_text(R.union("int4range", R.int4range(L(1), L(3)), R.int4range(L(3), L(6)))),
        m=R.to_text(R.difference("int4range", R.int4range(L(1), L(6)), R.int4range(L(4), L(9)))), lo=R.lower(R.empty("int4range")), inf=R.upper_inf(R.int4range(L(1), F.lit(None))), li=R.lower_inc(R.int4range(F.lit(None), L(1), "[)")),
    )
    assert got == {"c": "[2,6)", "e": "empty", "n": "[1.5000000000,)", "d": "[2024-01-01,2024-12-31)", "u": "[1,6)", "m": "[1,4)", "lo": None, "inf": True, "li": False}
    assert R.encode(dt.datetime(2024, 1, 1), None) == '["2024-01-01 00:00:00",)'
    for bad in (R.int4range(L(5), L(1)), R.union("int4range", R.int4range(L(1), L(2)), R.int4range(L(5), L(6))), R.difference("int4range", R.int4range(L(1), L(9)), R.int4range(L(3), L(4)))):
        with pytest.raises(Exception):
            one(spark, x=R.to_text(bad))


def test_json(spark):
    v = J.parse(L('{"a": {"b": [1, "x", null]}, "k": null, "s": "t"}'))
    arr = J.parse(L('[0, 1, "k"]'))
    js = lambda x: J.parse(L(x))
    got = one(
        spark, t=J.get_text(v, "s"), n=J.get_text(v, "k"), p=J.path_text(v, "a", "b", "1"), neg=J.at_text(arr, -1), out=J.text(J.at(arr, 9)), hk=J.has_key(v, "k"), hs=J.has_key(arr, "k"), al=J.array_length(arr), ty=J.typeof(J.path(v, "a", "b", 2)), ct=J.contains(v, js('{"a": {"b": ["x"]}}')), cb=J.contained_by(js("[1]"), js("[1, 2]")),
        no=J.contains(v, js('{"s": 1}')), set1=J.text(J.set_(js('{"a": [1]}'), ["a", 0], js("2"))), set2=J.text(J.set_(js("{}"), ["z"], js("2"), create=False)), ins=J.text(J.insert(js("[0, 9]"), [-1], js("5"), after=True)), st=J.text(J.strip_nulls(v)), cc=J.text(J.concat(js("1"), js("[2]"))), dk=J.text(J.delete_key(arr, "k")), pr=J.pretty(js('{"bb": 1, "a": [2]}')),
    )
    assert got == {
        "t": "t", "n": None, "p": "x", "neg": "k", "out": None, "hk": True, "hs": True, "al": 3, "ty": "null", "ct": True, "cb": True, "no": False, "set1": '{"a":[2]}', "set2": "{}", "ins": "[0,9,5]", "st": '{"a":{"b":[1,"x",null]},"s":"t"}', "cc": "[1,2]", "dk": "[0,1]",
        "pr": '{\n    "a": [\n        2\n    ],\n    "bb": 1\n}',
    }
