"""The query builder, set operations, mutations and the validator on small literal tables."""

import datetime as dt
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from tessella.functions import aggregate as A
from tessella.functions import window as W
from tessella.operators import mutate as M
from tessella.operators import predicates as P
from tessella.operators import validate as V
from tessella.operators.query import EMPTY_GROUP, From, asc, cube, desc, grouping_sets, rollup
from tessella.operators.range_join import overlap_join
from tessella.operators.setops import set_op
from tessella.sources import rows as SRC
from tessella.sources.schema import UNSET, Builder, register_type, spark_type, table_of, view_of
from tessella.streaming import fetch


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(2024, 1, 100), (2024, 2, 200), (2025, 1, 300), (2025, 2, 400)], "year int, quarter int, amount int")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, "d", 10), (5, None, None)], "id int, name string, age int")


@pytest.mark.parametrize(("spec", "rows", "masks"), [
    (lambda s: rollup(s.year, s.quarter), 7, {0, 1, 3}), (lambda s: cube(s.year, s.quarter), 9, {0, 1, 2, 3}), (lambda s: grouping_sets((s.year, s.quarter), (s.year,), EMPTY_GROUP), 7, {0, 1, 3}),
])
def test_grouping_sets(sales, spec, rows, masks):
    got = From(sales, "s").select(lambda s: (s.year, s.quarter, A.sum_(s.amount).alias("t"), A.grouping(s.year, s.quarter).alias("m"))).group_by(spec).df().collect()
    assert len(got) == rows
    assert {r.m for r in got} == masks
    assert {r.t for r in got if r.m == 3} == {1000}


def test_windows(people):
    by_age = W.spec.order_by(W.asc(F.col("age")))
    rows = From(people, "p").where(lambda p: p.age.isNotNull()).select(lambda p: (
        p.id, W.over(A.sum_(p.age), W.spec.partition_by(p.age)).alias("part"), W.rank(by_age).alias("rk"), W.dense_rank(by_age).alias("dr"), W.lag(p.age, W.spec.order_by(W.asc(p.id))).alias("lag"), W.lag(p.age, W.spec.order_by(W.asc(p.id)), 1, 0).alias("lag0"), W.row_number().alias("rn"),
    )).df().collect()
    got = {r.id: r for r in rows}
    assert (got[1].part, got[3].part, got[2].rk, got[2].dr, got[1].lag, got[1].lag0) == (20, 30, 3, 2, None, 0)
    assert sorted(r.rn for r in rows) == [1, 2, 3, 4]


def test_order_defaults_and_distinct_on(people):
    ids = [r.id for r in From(people, "p").select(lambda p: p.id).order_by(lambda p: (desc(p.age), asc(p.id))).df().collect()]
    assert ids == [5, 3, 2, 1, 4]
    ids = [r.id for r in From(people, "p").select(lambda p: p.id).order_by(lambda p: (asc(p.age), asc(p.id))).limit(2).offset(1).df().collect()]
    assert ids == [4, 2]
    first = From(people, "p").select(lambda p: p.id).distinct_on(lambda p: p.age).order_by(lambda p: (asc(p.age), desc(p.id))).distinct_rows().df().collect()
    assert [r.id for r in first] == [4, 2, 3, 5]


def test_joins_and_misuse(people):
    base = From(people, "p")
    with pytest.raises(ValueError, match="twice"):
        base.inner_join(people, "p", lambda s: s.p.id == s.p.id)
    with pytest.raises(AttributeError, match="no column"):
        base.where(lambda p: p.nope == 1).df()
    with pytest.raises(ValueError, match="locked"):
        base.cross_join(people, "q").for_("update")
    with pytest.raises(ValueError, match="locked"):
        From(people, "v", writable=False).for_("share")
    assert base.for_("update", "nowait").df().count() == 5
    kept = base.where(lambda p: p.p.age > 10 if hasattr(p, "p") else p.age > 10).inner_join(people, "q", lambda s: s.p.id == s.q.id).select(lambda s: s.q.id).df()
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    right = base.right_join(people, "q", lambda s: (s.p.id == s.q.id) & (s.p.id < 3)).select(lambda s: (s.p.id.alias("l"), s.q.id.alias("r"))).df().collect()
    assert sorted((r.r, r.l) for r in right)[2] == (3, None)


def test_derived_relation_needs_names(people):
    with pytest.raises(ValueError, match="name"):
        From(people, "p").select(lambda p: F.upper(p.name)).as_relation("d")


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("values", [[], [1], [1, 3], [1, None], [None]])
def test_quantified_comparisons(spark, op, values):
    xs = [0, 1, 2, 3, 4, None]
    df = spark.createDataFrame([(x,) for x in xs], "x int")
    sub = spark.createDataFrame([(v,) for v in values], "y int")
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    for every in (False, True):
        got = {r.x: r.q for r in P.quantified(df, F.col("x"), op, sub, every, "q").collect()}
        for x in xs:
            each = [None if x is None or v is None else compare(x, v) for v in values]
            want = (False if False in each else None if None in each else True) if every else (True if True in each else None if None in each else False)
            assert got[x] == want, (x, every)


def test_predicates(spark):
    row = spark.range(1).select(
        P.between_symmetric(F.lit(5), 9, 1).alias("a"), P.between_symmetric(F.lit(5), F.lit(None).cast("int"), 1).alias("b"), P.similar_to(F.lit("abc"), "(a|x)_c").alias("c"), P.similar_to(F.lit("xabc"), "a%").alias("d"), P.similar_to(F.lit("a.c"), "a.c").alias("e"), P.similar_to(F.lit("abc"), "a.c").alias("f"),
        P.is_distinct_from(F.lit(None), 1).alias("g"),
    ).first()
    assert tuple(row) == (True, None, True, False, True, False, True)
    with pytest.raises(ValueError):
        P.in_(F.lit(1), [])


def test_set_operation_precedence(spark):
    n = lambda *xs: spark.createDataFrame([(x,) for x in xs], "k int")
    got = lambda s: sorted(r.k for r in s.df().collect())
    assert got(set_op(n(1, 2)).union(n(2, 3)).intersect(n(3))) == [1, 2, 3]
    assert got(set_op(set_op(n(1, 2)).union(n(2, 3))).intersect(n(3))) == [3]
    assert got(set_op(n(1, 1, 2)).except_all(n(1))) == [1, 2]
    assert got(set_op(n(1, 1, 2)).intersect_all(n(1, 1))) == [1, 1]
    with pytest.raises(ValueError):
        set_op(n(1)).union(spark.createDataFrame([("a",)], "k string"))


def test_sources(spark):
    assert [r.n for r in SRC.generate_series(spark, 3, 1, -1).collect()] == [3, 2, 1]
    assert SRC.generate_series(spark, 3, 1).count() == 0
    with pytest.raises(ValueError):
        SRC.generate_series(spark, 1, 3, 0)
    with pytest.raises(ValueError):
        SRC.values(spark, [])
    df = spark.createDataFrame([(1, [1, None]), (2, []), (3, None)], "i int, a array<int>")
    assert [(r.i, r.v) for r in SRC.unnest(df, F.col("a"), keep=["i"]).collect()] == [(1, 1), (1, None)]
    assert df.filter("i = 1").select(SRC.series(F.lit(3), F.lit(1)).alias("s")).first().s == []


@dataclass
class User:
    id: int
    email: str = field(metadata={"type": "varchar(64)"})
    age: int | None = None
    tags: list[str] = field(default_factory=list)


USERS = table_of(User, "users").with_primary("id").with_unique("email").with_default("tags", lambda: F.array().cast("array<string>"))


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a@x", 5, ["t"]), (2, "b@x", None, [])], USERS.struct())


def test_declarations():
    assert [(c.name, c.type_name, c.nullable) for c in USERS.columns] == [("id", "int8", False), ("email", "varchar(64)", False), ("age", "int8", True), ("tags", "text[]", False)]
    assert USERS.struct()["id"].metadata["pk"] and USERS.struct()["email"].metadata["uq"]
    assert USERS.in_schema("app").full_name == "app.users"
    assert spark_type("numeric(10,2)").simpleString() == "decimal(10,2)"
    register_type("email", spark_type("text"))
    assert Builder("t").column("e", "email").build().struct()["e"].dataType.simpleString() == "string"
    with pytest.raises(ValueError):
        Builder("t").column("a", "nope").build().struct()
    with pytest.raises(KeyError):
        USERS.with_primary("nope")


def test_inserts(spark, users):
    new = M.insert(spark, USERS, users, {"id": 3, "email": "c@x"}).run()
    assert new.count() == 1
    assert new.returning(lambda r: (r.id, r.tags)).first().asDict() == {"id": 3, "tags": []}
    assert new.table.count() == 3
    for bad in ({"id": 3}, {"id": 3, "email": "c", "nope": 1}, {"id": None, "email": "c"}):
        with pytest.raises(ValueError):
            M.insert(spark, USERS, users, bad)
    with pytest.raises(TypeError):
        M.insert(spark, view_of(User, "v"), users, {"id": 1, "email": "x"})
    rows = [{"id": 1, "email": "z@x"}, {"id": 4, "email": "b@x"}, {"id": 5, "email": "e@x"}, {"id": 5, "email": "f@x"}]
    assert [r.id for r in M.insert(spark, USERS, users, *rows).on_conflict_do_nothing().run().affected.collect()] == [5]
    assert sorted(r.id for r in M.insert(spark, USERS, users, *rows[:3]).on_conflict("id").do_nothing().run().affected.collect()) == [4, 5]
    with pytest.raises(ValueError):
        M.insert(spark, USERS, users, rows[0]).on_conflict("age")
    up = M.insert(spark, USERS, users, {"id": 1, "email": "n@x"}, {"id": 9, "email": "i@x"}).on_conflict("id").do_update(lambda t, ex: {"email": ex.email, "age": t.age + 1}).run()
    assert {r.id: (r.email, r.age) for r in up.table.collect()} == {1: ("n@x", 6), 2: ("b@x", None), 9: ("i@x", None)}
    assert up.count() == 2
    with pytest.raises(Exception, match="second time"):
        M.insert(spark, USERS, users, {"id": 1, "email": "p"}, {"id": 1, "email": "q"}).on_conflict("id").do_update(lambda t, ex: {"email": ex.email}).run().table.collect()


def test_updates_and_deletes(spark, users, tmp_path):
    with pytest.raises(ValueError, match="where"):
        M.update(USERS, users).set(lambda u: {"age": 1}).run()
    with pytest.raises(ValueError, match="field"):
        M.update(USERS, users).patch({"age": UNSET})
    done = M.update(USERS, users).set(lambda u: {"age": u.id * 10, "email": F.concat(u.email, u.age.cast("string"))}).where(lambda u: u.age.isNotNull()).run()
    assert {r.id: (r.email, r.age) for r in done.table.collect()} == {1: ("a@x5", 10), 2: ("b@x", None)}
    patched = M.update(USERS, users).patch({"age": None, "email": UNSET}).update_all().run()
    assert {(r.email, r.age) for r in patched.affected.collect()} == {("a@x", None), ("b@x", None)}
    other = spark.createDataFrame([(1, 7), (1, 8)], "uid long, v long")
    joined = M.update(USERS, users, "u").from_(other, "o").set(lambda s: {"age": s.o.v}).where(lambda s: s.o.uid == s.u.id).run()
    assert joined.count() == 1 and {r.id: r.age for r in joined.table.collect()} == {1: 7, 2: None}
    gone = M.delete(USERS, users).where(lambda u: u.age > 1).run()
    assert [r.id for r in gone.table.collect()] == [2] and [r.id for r in gone.affected.collect()] == [1]
    using = M.delete(USERS, users, "u").using(other, "o").where(lambda s: s.o.uid == s.u.id).run()
    assert [r.id for r in using.table.collect()] == [2] and using.count() == 1
    assert gone.write(str(tmp_path / "new")).count() == 1


def test_validator(spark, users):
    users.createOrReplaceTempView("users_view")
    assert V.validate(spark, view_of(User, "users_view")).kinds() == ["TypeMismatch"] or V.validate(spark, view_of(User, "users_view")).ok
    assert V.validate(spark, USERS.in_schema("nowhere")).kinds() == ["RelationMissing"]
    assert V.validate(spark, table_of(User, "users_view")).kinds() == ["RelationKindMismatch"]
    live = V.Live(users, primary=("email",), uniques=(("age",),), declares_nulls=True)
    assert V.validate(spark, (USERS, live)).kinds() == ["PrimaryKeyColumnsDiffer", "UniqueConstraintMissing", "ExtraUniqueConstraint"]
    twice = V.Live(users.union(users))
    with pytest.raises(V.ValidationError) as e:
        V.validate_or_raise(spark, (USERS, twice))
    assert e.value.report.kinds() == ["PrimaryKeyMissing", "UniqueConstraintMissing"]


def test_fetching(people):
    df = From(people, "p").select(lambda p: (p.id, p.name, p.age)).df()
    assert sum(len(c) for c in fetch.stream(df, 2)) == 5
    assert fetch.option(df.filter("id = 9")) is None
    assert fetch.unique(df.filter("id = 1")).name == "a"
    for bad in (df, df.filter("id = 9")):
        with pytest.raises(LookupError):
            fetch.unique(bad)
    assert fetch.later(lambda s: df.filter("id = 1"), fetch.unique)(None).age == 10


def test_overlap_join_finds_each_pair_once(spark):
    import random

    rng = random.Random(2)
    a = [(k, lo, lo + rng.randrange(0, 30)) for k in range(60) for lo in (rng.randrange(-50, 50),)] + [(99, None, 5)]
    b = [(k, lo, lo + rng.randrange(0, 9)) for k in range(60) for lo in (rng.randrange(-50, 50),)]
    left, right = spark.createDataFrame(a, "i int, lo int, hi int"), spark.createDataFrame(b, "j int, start int, stop int")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, (F.col("lo"), F.col("hi")), (F.col("start"), F.col("stop")), 7).collect())
    assert got == sorted((i, j) for i, lo, hi in a for j, s, e in b if lo is not None and lo < hi and s < e and lo < e and s < hi)
    with pytest.raises(ValueError):
        overlap_join(left, left, (F.col("lo"), F.col("hi")), (F.col("lo"), F.col("hi")), 7)


def test_dates_in_declared_ranges(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")
    assert rows.select(F.year("d").alias("y")).first().y == 2024


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_mutations_join_by_their_keys(spark):
    """A condition's equalities are join keys, however many sources there are; no plan is a nested loop or a product."""
    key = Builder("k").column("id", "int8").column("v", "text").build()
    current = spark.range(100).select("id", F.lit("a").alias("v"))
    other, third = spark.range(50).select(F.col("id").alias("a"), F.lit("b").alias("w")), spark.range(50).select(F.col("id").alias("b"))
    linked = lambda s: (s.t.id == s.o.a) & (s.o.a == s.x.b) & (s.x.b < 20)
    for table in (key, key.with_primary("id")):
        for done in (
            M.update(table, current).from_(other, "o").set(lambda s: {"v": s.o.w}).where(lambda s: s.t.id == s.o.a).run(), M.update(table, current).from_(other, "o").from_(third, "x").set(lambda s: {"v": s.o.w}).where(linked).run(),
            M.delete(table, current).using(other, "o").where(lambda s: s.t.id == s.o.a).run(), M.delete(table, current).using(other, "o").using(third, "x").where(linked).run(),
        ):
            for df in (done.table, done.affected):
                assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)
    done = M.update(key, current).from_(other, "o").from_(third, "x").set(lambda s: {"v": s.o.w}).where(linked).run()
    assert done.table.filter("v = 'b'").count() == done.count() == 20 and done.table.count() == 100
    assert M.delete(key, current).using(other, "o").using(third, "x").where(linked).run().table.count() == 80


def test_update_from_keeps_equal_rows_and_null_keys(spark):
    table = Builder("k").column_opt("id", "int8").column_opt("v", "text").build()
    current = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None), (None, None)], "id long, v string")
    other = spark.createDataFrame([(1, "z"), (1, "y"), (2, "w"), (None, "q")], "a long, w string")
    done = M.update(table, current).from_(other, "o").set(lambda s: {"v": s.o.w}).where(lambda s: s.t.id == s.o.a).run()
    assert sorted(map(str, done.table.collect())) == sorted(map(str, spark.createDataFrame([(1, "y"), (1, "y"), (None, "a"), (2, "w"), (None, None)], "id long, v string").collect()))
    assert done.count() == 3


def test_json_numbers_stay_exact(spark):
    from tessella.functions import json as J

    row = spark.range(1).select(J.parse(F.lit('{"a": 0.1000000000000000055511151231257827, "b": 12345678901234567890.25, "c": [1.50, 2]}')).alias("v"))
    row = row.select(J.text(J.delete_key(F.col("v"), "c")).alias("t"), J.contains(F.col("v"), J.parse(F.lit('{"b": 12345678901234567890.26}'))).alias("near"), J.contains(F.col("v"), J.parse(F.lit('{"c": [2]}'))).alias("has")).first()
    assert "12345678901234567890.25" in row.t and "0.1000000000000000055511151231257827" in row.t
    assert (row.near, row.has) == (False, True)


def test_having_above_windows_is_refused(people):
    q = From(people, "p").select(lambda p: (p.age, F.lit("x over( y").alias("t"), A.count_all().alias("n"))).group_by(lambda p: p.age).having(lambda p: A.count_all() > 1)
    assert [(r.age, r.n) for r in q.df().collect()] == [(10, 2)]
    with pytest.raises(ValueError):
        From(people, "p").select(lambda p: (p.age, W.over(A.sum_(A.count_all()), W.spec).alias("n"))).group_by(lambda p: p.age).having(lambda p: A.count_all() > 1).df()


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, tmp_path, kind):
    table = Builder("k").column("id", "int8").column_opt("v", "text").column("n", "numeric(10,2)").build()
    rows = spark.createDataFrame([(1, "a,\"b\"", 1), (2, None, 2)], "id long, v string, n int").select("id", "v", F.col("n").cast("decimal(10,2)"))
    options = {"header": "true", "escape": '"'} if kind == "csv" else {}
    SRC.write(rows, str(tmp_path / "t"), kind, **options)
    back = SRC.read(spark, str(tmp_path / "t"), kind, table.struct(), **options)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and [f.dataType for f in back.schema] == [c.spark_type for c in table.columns]
    if kind in ("json", "csv"):
        with pytest.raises(ValueError):
            SRC.read(spark, str(tmp_path / "t"), kind)


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_full_join_is_a_left_join_and_the_rows_left_over(spark, broadcast):
    """Spark's full join holds all pairs of a key at once; NULL keys and rows whose condition fails stay alone on both sides."""
    a = spark.createDataFrame([(1, "x", 5), (1, "y", 1), (1, "x", 5), (2, "z", 3), (None, "n", 2), (4, "q", None)], "k int, v string, w int")
    ids = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).cast("int").alias("u"))
    b = ids.union(ids.filter("k < 2")).select(F.when(F.col("k") > 0, F.col("k")).alias("k"), "u")
    q = From(a, "a").full_join(b, "b", lambda s: (s.a.k == s.b.k) & (s.a.w > s.b.u))
    plain = a.alias("a").join(b.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.w") > F.col("b.u")), "full")
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect())) and x.schema == y.schema
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        assert same(q.df(), plain) and "FullOuter" not in plan(q.df())
        assert ("RoundRobin" in plan(q.df())) == (broadcast != "-1")
        later = q.full_join(a, "d", lambda s: s.d.k == s.b.u).where(lambda s: s.a.k.isNull() | s.d.w.isNotNull()).select(lambda s: (s.b.u, s.d.v, A.count_all().alias("n"))).group_by(lambda s: (s.b.u, s.d.v))
        want = plain.join(a.alias("d"), F.col("d.k") == F.col("b.u"), "full").filter("a.k is null or d.w is not null").groupBy("b.u", "d.v").count().withColumnRenamed("count", "n")
        assert sorted(map(str, later.df().collect())) == sorted(map(str, want.collect())) and "FullOuter" not in plan(later.df())
        mine = From(a, "x").full_join(a, "y", lambda s: s.x.k == s.y.w)
        assert same(mine.df(), a.alias("x").join(a.alias("y"), F.col("x.k") == F.col("y.w"), "full"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_full_join_reads_once_what_two_readings_may_tell_apart(people):
    other = people.select(F.col("id").alias("k"), "age")
    for left in (people.limit(3), people.withColumn("r", F.rand()), people.dropDuplicates(["age"]), From(people, "p").distinct_on(lambda p: p.age).df()):
        for pair in ((left, other), (other, left.withColumnRenamed("id", "k"))):
            df = From(pair[0], "a").full_join(pair[1], "b", lambda s: (s.a.id if "id" in pair[0].columns else s.a.k) == s.b.k).df()
            assert "FullOuter" in df._jdf.queryExecution().optimizedPlan().toString()
    apart = From(people, "a").full_join(other, "b", lambda s: s.a.age > s.b.age).df()
    assert "FullOuter" in apart._jdf.queryExecution().optimizedPlan().toString()


def test_literal_rows_are_broadcast_to_a_larger_side(spark):
    rows = [{"k": 1, "v": "a", "d": dt.date(1582, 10, 10), "l": [1, None]}, {"k": 9, "v": None, "d": None, "l": None}]
    kind = "k int, v string, d date, l array<int>"
    v = SRC.values(spark, rows, kind)
    assert v.schema == spark.createDataFrame([], kind).schema and [r.asDict() for r in v.orderBy("k").collect()] == rows
    assert v._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1000
    many = spark.range(1000).select((F.col("id") % 7).cast("int").alias("k"))
    joined = From(v, "v").inner_join(many, "m", lambda s: s.m.k == s.v.k).select(lambda s: (s.v.v, A.count_all().alias("n"))).group_by(lambda s: s.v.v).df()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in joined.collect()] == [("a", 143)] and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(TypeError):
        SRC.values(spark, [{"k": "x"}], "k int")
    table = Builder("t").column("k", "int4").column_opt("v", "text").build().with_primary("k")
    put = M.insert(spark, table, many.distinct().withColumn("v", F.lit("old")), {"k": 1, "v": "new"}, {"k": 8, "v": None})
    assert put.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1000
    assert sorted((r.k, r.v) for r in put.on_conflict_do_nothing().run().affected.collect()) == [(8, None)]
