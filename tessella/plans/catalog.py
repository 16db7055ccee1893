"""Registered queries of the relational engine, one or more for each operator, with their DuckDB SQL.

Each entry is a function of (spark, tables) that builds a DataFrame through the engine. Timestamps of the test tables
have no zone; doubles are rounded on both sides where engines sum in different orders.
"""

from __future__ import annotations

import os
import pwd
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import aggregate as A
from tessella.functions import array as AR
from tessella.functions import datetime as D
from tessella.functions import json as J
from tessella.functions import misc as M
from tessella.functions import numeric as N
from tessella.functions import range as R
from tessella.functions import string as S
from tessella.functions import window as W
from tessella.operators import mutate as DML
from tessella.operators import predicates as P
from tessella.operators import validate as V
from tessella.operators.query import EMPTY_GROUP, From, asc, cube, desc, grouping_sets, rollup
from tessella.operators.range_join import overlap_join
from tessella.operators.setops import set_op
from tessella.sources import rows as SRC
from tessella.sources.schema import Builder, ColumnDef, TableDef, ViewDef, register_type, table_of, view_of
from tessella.streaming import fetch as FETCH

Tables = Callable[[str], DataFrame]
_QUERIES: dict[str, Callable[[SparkSession, Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(spark, lambda name: SRC.load(spark, sf_dir, name))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r(e, places: int = 4):
    return F.round(e, places)


# declared relations over the test tables


@dataclass
class Customer:
    c_custkey: int
    c_name: str
    c_nationkey: int = field(metadata={"type": "int4"})
    c_acctbal: float = 0.0
    c_mktsegment: str = ""


CUSTOMER = table_of(Customer, "customer").with_primary("c_custkey").with_unique("c_name")
ORDERS: TableDef = (
    Builder("orders").column("o_orderkey", "int8").column("o_custkey", "int8").column_defaulted("o_orderstatus", "text", "O")
    .column("o_totalprice", "float8").column("o_orderdate", "timestamp").column_opt("o_orderpriority", "text").build().with_primary("o_orderkey")
)
CUSTOMER_VIEW: ViewDef = view_of(Customer, "customer_view")


@query("""
select n_name, cast(o_year as integer) as o_year, round(revenue, 2) as revenue, rank() over (partition by o_year order by revenue desc) as rnk
from (select n_name, extract(year from o_orderdate) as o_year, sum(l_extendedprice * (1 - l_discount)) as revenue
      from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
      group by 1, 2 having count(*) > 5) order by o_year, rnk, n_name""")
def flagship_revenue(spark, t):
    revenue = (
        From(t("customer"), "c").inner_join(t("nation"), "n", lambda s: s.c.c_nationkey == s.n.n_nationkey)
        .inner_join(t("orders"), "o", lambda s: s.o.o_custkey == s.c.c_custkey).inner_join(t("lineitem"), "l", lambda s: s.l.l_orderkey == s.o.o_orderkey)
        .select(lambda s: (s.n.n_name, F.year(s.o.o_orderdate).alias("o_year"), A.sum_(s.l.l_extendedprice * (1 - s.l.l_discount)).alias("revenue")))
        .group_by(lambda s: (s.n.n_name, F.year(s.o.o_orderdate))).having(lambda s: A.count_all() > 5)
    )
    by_year = W.spec.partition_by(F.col("o_year")).order_by(W.desc(F.col("revenue")))
    ranked = revenue.as_relation("d").select(lambda d: (d.n_name, d.o_year, r(d.revenue, 2).alias("revenue"), W.rank(by_year).alias("rnk")))
    return ranked.df().orderBy("o_year", "rnk", "n_name")


# sources and sinks


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_declared_table(spark, t):
    return From(t("customer").select(*[F.col(c.name).cast(c.spark_type) for c in CUSTOMER.columns]), "c").df()


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def scan_built_table(spark, t):
    return t("orders").select(*[F.col(c.name).cast(c.spark_type) for c in ORDERS.columns])


@query("select c_custkey, c_name from customer where c_acctbal > 0")
def scan_view(spark, t):
    view = From(t("customer"), "v", writable=False).where(lambda v: v.c_acctbal > 0).as_relation("active")
    return view.select(lambda v: (v.c_custkey, v.c_name)).df()


@query("select o_orderkey, cast(o_totalprice as decimal(12,2)) as o_totalprice from orders")
def scan_column_override(spark, t):
    declared = ORDERS.with_column("o_totalprice", "numeric(12,2)")
    return t("orders").select("o_orderkey", F.col("o_totalprice").cast(declared.column("o_totalprice").spark_type))


@query("select v.id, v.label, count(*) as n from (values (1, 'one'), (2, 'two'), (9, 'nine')) v(id, label) join lineitem on l_linenumber = v.id group by 1, 2")
def values_join(spark, t):
    v = SRC.values(spark, [{"id": 1, "label": "one"}, {"id": 2, "label": "two"}, {"id": 9, "label": "nine"}], "id int, label string")
    return (
        From(v, "v").inner_join(t("lineitem"), "l", lambda s: s.l.l_linenumber == s.v.id)
        .select(lambda s: (s.v.id, s.v.label, A.count_all().alias("n"))).group_by(lambda s: (s.v.id, s.v.label)).df()
    )


@query("select 1 + 1 as two, 'x' as x, true as yes")
def select_without_from(spark, t):
    return SRC.empty(spark).select((F.lit(1) + F.lit(1)).alias("two"), F.lit("x").alias("x"), F.lit(True).alias("yes"))


@query("select n from generate_series(1, 10, 3) g(n) union all select n from generate_series(5, -5, -5) g(n)")
def generate_series(spark, t):
    return SRC.generate_series(spark, 1, 10, 3).union(SRC.generate_series(spark, 5, -5, -5)).union(SRC.generate_series(spark, 5, 1, 1))


@query("select p_partkey, unnest(string_split(p_name, ' ')) as v from part")
def unnest_relation(spark, t):
    return SRC.unnest(t("part"), AR.string_to_array(F.col("p_name"), " "), "v", ["p_partkey"])


@query("""with big as (select * from orders where o_totalprice > 200000), per as (select o_custkey, count(*) as n from big group by 1)
select c_mktsegment, sum(n)::bigint as n from per join customer on c_custkey = o_custkey group by 1""")
def cte_chain(spark, t):
    big = From(t("orders"), "o").where(lambda o: o.o_totalprice > 200000).as_relation("big")
    per = big.select(lambda b: (b.o_custkey, A.count_all().alias("n"))).group_by(lambda b: b.o_custkey).as_relation("per")
    return per.inner_join(t("customer"), "c", lambda s: s.c.c_custkey == s.per.o_custkey).select(lambda s: (s.c.c_mktsegment, A.sum_(s.per.n).alias("n"))).group_by(lambda s: s.c.c_mktsegment).df()


# projection


@query("select o_orderkey as k, o_totalprice * 2 as double_price, o_totalprice > 100000 as big, 7 as seven, 'lit' as word from orders")
def project_expressions(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey.alias("k"), (o.o_totalprice * 2).alias("double_price"), (o.o_totalprice > 100000).alias("big"), F.lit(7).alias("seven"), F.lit("lit").alias("word"))).df()


@query("select o_orderkey, cast(round_even(o_totalprice, 0) as bigint) as rounded, cast(o_totalprice as varchar) <> '' as shown, cast(o_orderdate as date) as day from orders")
def project_casts(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, P.cast(o.o_totalprice, "bigint", "double").alias("rounded"), (P.cast(o.o_totalprice, "string") != "").alias("shown"), P.cast(o.o_orderdate, "date").alias("day"))).df()


@query("select distinct o_orderstatus, o_orderpriority from orders")
def project_distinct(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderstatus, o.o_orderpriority)).distinct_rows().df()


@query("select distinct on (o_custkey) o_custkey, o_orderkey, o_totalprice from orders order by o_custkey, o_totalprice desc, o_orderkey")
def distinct_on(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_custkey, o.o_orderkey, o.o_totalprice)).distinct_on(lambda o: o.o_custkey).order_by(lambda o: (asc(o.o_custkey), desc(o.o_totalprice), asc(o.o_orderkey))).df()


@query("select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as tier, case when o_orderstatus = 'F' then 1 end as done from orders")
def case_when(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, P.case_when(o.o_totalprice > 200000, "high").when(o.o_totalprice > 100000, "mid").otherwise("low").alias("tier"), P.case_when(o.o_orderstatus == "F", 1).end().alias("done"))).df()


# filters


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' and (o_totalprice < 50000 or not o_totalprice <= 250000)")
def filter_comparisons(spark, t):
    return From(t("orders"), "o").where(lambda o: P.eq(o.o_orderstatus, "F") & P.ne(o.o_orderpriority, "1-URGENT")).where(lambda o: (o.o_totalprice < 50000) | ~(o.o_totalprice <= 250000)).select(lambda o: o.o_orderkey).df()


@query("select o_orderkey from orders where o_totalprice between 100000 and 150000 and o_orderkey not between 10 and 5000")
def filter_between(spark, t):
    return From(t("orders"), "o").where(lambda o: P.between(o.o_totalprice, 100000, 150000) & P.not_between(o.o_orderkey, 10, 5000)).select(lambda o: o.o_orderkey).df()


@query("select o_orderkey from orders where o_totalprice between least(150000, 100000) and greatest(150000, 100000)")
def filter_between_symmetric(spark, t):
    return From(t("orders"), "o").where(lambda o: P.between_symmetric(o.o_totalprice, 150000, 100000)).select(lambda o: o.o_orderkey).df()


@query("select p_partkey from part where p_size in (1, 5, 9) and not p_brand in ('Brand#11', 'Brand#22')")
def filter_in_list(spark, t):
    return From(t("part"), "p").where(lambda p: P.in_(p.p_size, [1, 5, 9]) & ~P.in_(p.p_brand, ["Brand#11", "Brand#22"])).select(lambda p: p.p_partkey).df()


@query("select p_partkey, p_name like '%a_%' as has_a, p_name ilike 'B%' as starts_b, not (p_type like '%E%') as no_e from part")
def filter_like(spark, t):
    return From(t("part"), "p").select(lambda p: (p.p_partkey, P.like(p.p_name, "%a_%").alias("has_a"), P.ilike(p.p_name, "B%").alias("starts_b"), (~P.like(p.p_type, "%E%")).alias("no_e"))).df()


@query("select p_partkey, regexp_full_match(p_brand, 'Brand#(1|2).') as brand_1_2, not regexp_full_match(p_type, '.*E+.*') as no_e from part")
def filter_similar(spark, t):
    return From(t("part"), "p").select(lambda p: (p.p_partkey, P.similar_to(p.p_brand, "Brand#(1|2)_").alias("brand_1_2"), P.not_similar_to(p.p_type, "%E+%").alias("no_e"))).df()


@query("select o_orderkey, nullif(o_orderstatus, 'F') is distinct from 'O' as d, nullif(o_orderstatus, 'F') is not distinct from null as nd, nullif(o_orderstatus, 'F') is null as n, nullif(o_orderstatus, 'F') is not null as nn from orders")
def filter_distinct_from(spark, t):
    status = lambda o: M.nullif(o.o_orderstatus, "F")
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, P.is_distinct_from(status(o), "O").alias("d"), P.is_not_distinct_from(status(o), F.lit(None)).alias("nd"), status(o).isNull().alias("n"), status(o).isNotNull().alias("nn"))).df()


@query("""select o_orderkey, (least(s1, e1) = least(s2, e2)) or (least(s1, e1) < least(s2, e2) and least(s2, e2) < greatest(s1, e1)) or (least(s2, e2) < least(s1, e1) and least(s1, e1) < greatest(s2, e2)) as o
from (select o_orderkey, o_orderdate as s1, o_orderdate + interval 30 day as e1, timestamp '1996-01-01' as s2, timestamp '1995-06-01' as e2 from orders)""")
def filter_overlaps(spark, t):
    days = F.expr("interval '30' day")
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, D.overlaps(o.o_orderdate, o.o_orderdate + days, stamp("1996-01-01"), stamp("1995-06-01")).alias("o"))).df()


@query("select p_partkey, list_contains(string_split(p_name, ' '), 'red') as red from part")
def filter_elem_of(spark, t):
    return From(t("part"), "p").select(lambda p: (p.p_partkey, AR.elem_of("red", AR.string_to_array(p.p_name, " ")).alias("red"))).df()


# subqueries


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)")
def subquery_in(spark, t):
    big = From(t("orders"), "o").where(lambda o: o.o_totalprice > 250000)
    return From(t("customer"), "c").where(lambda c: big.where(lambda o: o.o_custkey == c.c_custkey.outer()).exists()).select(lambda c: c.c_custkey).df()


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)")
def subquery_not_in(spark, t):
    t("customer").createOrReplaceTempView("tessella_c")
    t("orders").createOrReplaceTempView("tessella_o")
    return spark.sql("select c_custkey from tessella_c where c_custkey not in (select o_custkey from tessella_o where o_totalprice > 100000)")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') as pending from customer")
def subquery_exists_projected(spark, t):
    pending = From(t("orders"), "o").where(lambda o: o.o_orderstatus == "P").select(lambda o: o.o_custkey).distinct_rows().as_relation("p")
    return From(t("customer"), "c").left_join(pending.df(), "p", lambda s: s.p.o_custkey == s.c.c_custkey).select(lambda s: (s.c.c_custkey, s.p.o_custkey.isNotNull().alias("pending"))).df()


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def subquery_not_exists(spark, t):
    orders = From(t("orders"), "o")
    return From(t("customer"), "c").where(lambda c: ~orders.where(lambda o: (o.o_custkey == c.c_custkey.outer()) & (o.o_totalprice > 200000)).exists()).select(lambda c: c.c_custkey).df()


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
def subquery_scalar(spark, t):
    orders = From(t("orders"), "o")
    count = lambda c: orders.where(lambda o: o.o_custkey == c.c_custkey.outer()).df().select(A.count_all().alias("n")).scalar()
    return From(t("customer"), "c").select(lambda c: (c.c_custkey, count(c).alias("n"))).df()


def _quantified(op: str, every: bool):
    word = "all" if every else "any"

    @query(f"select c_custkey, (c_acctbal {op} {word} (select s_acctbal from supplier where s_nationkey < 5)) as q, (nullif(c_nationkey, 3) {op} {word} (select nullif(s_nationkey, 4) from supplier)) as qn, (c_acctbal {op} {word} (select s_acctbal from supplier where s_nationkey < 0)) as qe from customer")
    def build(spark, t):
        sub = From(t("supplier"), "s")
        df = From(t("customer"), "c").df()
        df = P.quantified(df, F.col("c_acctbal"), op, sub.where(lambda s: s.s_nationkey < 5).select(lambda s: s.s_acctbal).df(), every, "q")
        df = P.quantified(df, M.nullif(F.col("c_nationkey"), 3), op, sub.select(lambda s: M.nullif(s.s_nationkey, 4).alias("y")).df(), every, "qn")
        df = P.quantified(df, F.col("c_acctbal"), op, sub.where(lambda s: s.s_nationkey < 0).select(lambda s: s.s_acctbal).df(), every, "qe")
        return df.select("c_custkey", "q", "qn", "qe")

    return build


for _name, _op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    for _every in (False, True):
        _built = _quantified(_op, _every)
        _key = f"subquery_{_name}_{'all' if _every else 'any'}"
        _QUERIES[_key], _SQL[_key] = _QUERIES.pop("build"), _SQL.pop("build")


# joins


@query("select c_name, o_orderkey from customer join orders on o_custkey = c_custkey and o_totalprice > 150000")
def join_inner(spark, t):
    return From(t("customer"), "c").inner_join(t("orders"), "o", lambda s: (s.o.o_custkey == s.c.c_custkey) & (s.o.o_totalprice > 150000)).select(lambda s: (s.c.c_name, s.o.o_orderkey)).df()


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey and o_totalprice > 250000")
def join_left(spark, t):
    return From(t("customer"), "c").left_join(t("orders"), "o", lambda s: (s.o.o_custkey == s.c.c_custkey) & (s.o.o_totalprice > 250000)).select(lambda s: (s.c.c_custkey, s.o.o_orderkey)).df()


@query("select c_custkey, o_orderkey from (select * from customer where c_nationkey < 5) c right join orders on o_custkey = c_custkey")
def join_right(spark, t):
    few = From(t("customer"), "c").where(lambda c: c.c_nationkey < 5).as_relation("c")
    return few.right_join(t("orders"), "o", lambda s: s.o.o_custkey == s.c.c_custkey).select(lambda s: (s.c.c_custkey, s.o.o_orderkey)).df()


@query("select c_custkey, s_suppkey from (select * from customer where c_acctbal > 5000) c full join (select * from supplier where s_acctbal < 5000) s on c_nationkey = s_nationkey and c_acctbal > s_acctbal * 2")
def join_full(spark, t):
    few = From(t("customer"), "c").where(lambda c: c.c_acctbal > 5000).as_relation("c")
    poor = From(t("supplier"), "s").where(lambda s: s.s_acctbal < 5000).df()
    return few.full_join(poor, "s", lambda x: (x.c.c_nationkey == x.s.s_nationkey) & (x.c.c_acctbal > x.s.s_acctbal * 2)).select(lambda x: (x.c.c_custkey, x.s.s_suppkey)).df()


@query("select r_name, n_name from region cross join nation where r_regionkey <> n_regionkey")
def join_cross(spark, t):
    return From(t("region"), "r").cross_join(t("nation"), "n").where(lambda s: s.r.r_regionkey != s.n.n_regionkey).select(lambda s: (s.r.r_name, s.n.n_name)).df()


@query("select c_custkey, o_orderkey from (select * from customer where c_acctbal > 0) join orders on o_custkey = c_custkey")
def join_keeps_earlier_where(spark, t):
    return From(t("customer"), "c").where(lambda s: (s.c if hasattr(s, "c") else s).c_acctbal > 0).inner_join(t("orders"), "o", lambda s: s.o.o_custkey == s.c.c_custkey).select(lambda s: (s.c.c_custkey, s.o.o_orderkey)).df()


@query("select a.n_name as a_name, b.n_name as b_name from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def join_self(spark, t):
    return From(t("nation"), "a").inner_join(t("nation"), "b", lambda s: (s.a.n_regionkey == s.b.n_regionkey) & (s.a.n_nationkey < s.b.n_nationkey)).select(lambda s: (s.a.n_name.alias("a_name"), s.b.n_name.alias("b_name"))).df()


@query("select r_name, n_name, s_name from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey")
def join_three_way(spark, t):
    return From(t("region"), "r").inner_join(t("nation"), "n", lambda s: s.n.n_regionkey == s.r.r_regionkey).inner_join(t("supplier"), "s", lambda x: x.s.s_nationkey == x.n.n_nationkey).select(lambda x: (x.r.r_name, x.n.n_name, x.s.s_name)).df()


@query("select c_custkey, o.o_orderkey from customer cross join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) o")
def join_lateral_top(spark, t):
    top = lambda c: From(t("orders"), "o").where(lambda o: o.o_custkey == c.c_custkey).select(lambda o: o.o_orderkey).order_by(lambda o: (desc(o.o_totalprice), asc(o.o_orderkey))).limit(2)
    return From(t("customer"), "c").cross_join_lateral("o", top).select(lambda s: (s.c.c_custkey, s.o.o_orderkey)).df()


@query("select c_custkey, o.total from customer join lateral (select round(sum(o_totalprice), 2) as total from orders where o_custkey = c_custkey) o on o.total > 1000000")
def join_lateral_inner(spark, t):
    total = lambda c: From(t("orders"), "o").where(lambda o: o.o_custkey == c.c_custkey).select(lambda o: r(A.sum_(o.o_totalprice), 2).alias("total"))
    return From(t("customer"), "c").inner_join_lateral("o", total, lambda s: s.o.total > 1000000).select(lambda s: (s.c.c_custkey, s.o.total)).df()


@query("select c_custkey, o.o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey and o_totalprice > 200000 order by o_orderkey limit 1) o on true")
def join_lateral_left(spark, t):
    one = lambda c: From(t("orders"), "o").where(lambda o: (o.o_custkey == c.c_custkey) & (o.o_totalprice > 200000)).select(lambda o: o.o_orderkey).order_by(lambda o: asc(o.o_orderkey)).limit(1)
    return From(t("customer"), "c").left_join_lateral("o", one).select(lambda s: (s.c.c_custkey, s.o.o_orderkey)).df()


@query("select a.n_nationkey as a, b.s_suppkey as b from nation a join supplier b on b.s_suppkey >= a.n_nationkey * 2 and b.s_suppkey < a.n_nationkey * 2 + 5")
def join_range(spark, t):
    span = lambda n: R.int8range(n.n_nationkey * 2, n.n_nationkey * 2 + 5)
    return From(t("nation"), "a").inner_join(t("supplier"), "b", lambda s: R.contains_elem(span(s.a), s.b.s_suppkey)).select(lambda s: (s.a.n_nationkey.alias("a"), s.b.s_suppkey.alias("b"))).df()


@query("select o_orderkey, event_id from (select o_orderkey, epoch(o_orderdate)::bigint as lo from orders) join (select event_id, epoch(ts)::bigint as ts from events) on ts >= lo and ts < lo + 3600 * (1 + o_orderkey % 40)")
def join_range_binned(spark, t):
    orders = t("orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("lo")).withColumn("lo", F.floor(F.col("lo") / 1_000_000))
    events = t("events").select("event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"))
    lo, at = F.col("lo"), F.col("at")
    return overlap_join(orders, events, (lo, lo + 3600 * (F.col("o_orderkey") % 40 + 1)), (at, at + 1), 24 * 3600).select("o_orderkey", "event_id")


# grouping and ordering


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1, 2 having sum(l_quantity) > 100")
def group_having(spark, t):
    return From(t("lineitem"), "l").select(lambda x: (x.l_returnflag, x.l_linestatus, A.count_all().alias("n"), r(A.sum_(x.l_quantity), 2).alias("qty"))).group_by(lambda x: x.l_returnflag).group_by(lambda x: x.l_linestatus).having(lambda x: A.sum_(x.l_quantity) > 100).df()


@query("select count(*) as n from orders having count(*) > 10")
def group_having_alone(spark, t):
    return From(t("orders"), "o").select(lambda o: A.count_all().alias("n")).having(lambda o: A.count_all() > 10).df()


def _by_quarter(t):
    return From(t("orders"), "o").select(lambda o: (F.year(o.o_orderdate).alias("y"), F.quarter(o.o_orderdate).alias("q"), o.o_orderstatus, o.o_totalprice)).as_relation("s")


_SALES = "(select cast(extract(year from o_orderdate) as integer) as y, cast(extract(quarter from o_orderdate) as integer) as q, o_orderstatus, o_totalprice from orders) s"


def _grouping_query(spec):
    return lambda t: _by_quarter(t).select(lambda s: (s.y, s.q, A.count_all().alias("n"), r(A.sum_(s.o_totalprice), 2).alias("total"), A.grouping(s.y, s.q).alias("mask"))).group_by(spec).df()


_GROUPING = "select y, q, count(*) as n, round(sum(o_totalprice), 2) as total, cast(grouping(y, q) as integer) as mask from " + _SALES + " group by "


@query(_GROUPING + "rollup(y, q)")
def group_rollup(spark, t):
    return _grouping_query(lambda s: rollup(s.y, s.q))(t)


@query(_GROUPING + "cube(y, q)")
def group_cube(spark, t):
    return _grouping_query(lambda s: cube(s.y, s.q))(t)


@query(_GROUPING + "grouping sets ((y, q), (y), ())")
def group_sets(spark, t):
    return _grouping_query(lambda s: grouping_sets((s.y, s.q), (s.y,), EMPTY_GROUP))(t)


@query("select o_orderstatus, y, q, count(*) as n from " + _SALES + " group by o_orderstatus, rollup(y, q)")
def group_mixed(spark, t):
    return _by_quarter(t).select(lambda s: (s.o_orderstatus, s.y, s.q, A.count_all().alias("n"))).group_by(lambda s: (s.o_orderstatus, rollup(s.y, s.q))).df()


@query("select o_orderkey, o_orderstatus from orders order by nullif(o_orderstatus, 'F') desc nulls first, o_orderkey limit 50 offset 10")
def order_limit_offset(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, o.o_orderstatus)).order_by(lambda o: desc(M.nullif(o.o_orderstatus, "F"))).order_by(lambda o: asc(o.o_orderkey)).limit(5).limit(50).offset(10).df()


@query("select o_orderkey from orders order by nullif(o_orderstatus, 'F') asc nulls first, o_orderkey desc nulls last limit 25")
def order_nulls(spark, t):
    return From(t("orders"), "o").select(lambda o: o.o_orderkey).order_by(lambda o: (asc(M.nullif(o.o_orderstatus, "F")).nulls_first(), desc(o.o_orderkey).nulls_last())).limit(25).df()


@query("select o_custkey, count(*) as n from orders group by 1 order by count(*) desc, o_custkey limit 10")
def order_by_aggregate(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_custkey, A.count_all().alias("n"))).group_by(lambda o: o.o_custkey).order_by(lambda o: (desc(A.count_all()), asc(o.o_custkey))).limit(10).df()


@query("select o_orderkey, o_orderstatus, 'update skip locked' as mode from orders where o_orderstatus = 'P'")
def lock_noted(spark, t):
    q = From(t("orders"), "o").where(lambda o: o.o_orderstatus == "P").for_("update", "skip locked")
    return q.select(lambda o: (o.o_orderkey, o.o_orderstatus, F.lit(" ".join(q.lock)).alias("mode"))).df()


def _refusals(spark, **tries) -> DataFrame:
    """What each call raises, or that it passes."""

    def outcome(call) -> str:
        try:
            call()
        except Exception as e:  # noqa: BLE001  the kind is the result
            return type(e).__name__
        return "passes"

    return spark.createDataFrame([(name, outcome(call)) for name, call in tries.items()], "attempt string, outcome string")


@query("select * from (values ('uncovered', 'AnalysisException'), ('covered', 'passes'), ('lock_on_groups', 'ValueError'), ('lock_on_view', 'ValueError')) v(attempt, outcome)")
def group_coverage(spark, t):
    o = lambda: From(t("orders"), "o")
    return _refusals(
        spark, uncovered=lambda: o().select(lambda o: (o.o_custkey, A.count_all().alias("n"))).group_by(lambda o: o.o_orderstatus).df(),
        covered=lambda: o().select(lambda o: (o.o_custkey, A.count_all().alias("n"))).group_by(lambda o: o.o_custkey).df(),
        lock_on_groups=lambda: o().select(lambda o: A.count_all().alias("n")).group_by(lambda o: o.o_custkey).for_("update").df(),
        lock_on_view=lambda: From(t("orders"), "v", writable=False).for_("share").df(),
    )


# set operations

_LEFT, _RIGHT = "select c_nationkey as k from customer where c_acctbal > 9000", "select s_nationkey as k from supplier where s_nationkey < 15"


def _arms(t):
    return From(t("customer"), "c").where(lambda c: c.c_acctbal > 9000).select(lambda c: c.c_nationkey.alias("k")), From(t("supplier"), "s").where(lambda s: s.s_nationkey < 15).select(lambda s: s.s_nationkey.alias("k"))


def _set_query(name: str, word: str, method: str):
    def build(spark, t):
        left, right = _arms(t)
        return getattr(set_op(left), method)(right).df()

    build.__name__ = name
    return query(f"{_LEFT} {word} {_RIGHT}")(build)


for _n, _w, _m in (("set_union", "union", "union"), ("set_union_all", "union all", "union_all"), ("set_intersect", "intersect", "intersect"), ("set_intersect_all", "intersect all", "intersect_all"), ("set_except", "except", "except_"), ("set_except_all", "except all", "except_all")):
    _set_query(_n, _w, _m)


@query(f"{_LEFT} union {_RIGHT} intersect select n_nationkey as k from nation where n_nationkey < 8 except select 3 as k")
def set_chain(spark, t):
    left, right = _arms(t)
    few = From(t("nation"), "n").where(lambda n: n.n_nationkey < 8).select(lambda n: n.n_nationkey.alias("k"))
    return set_op(left).union(right).intersect(few).except_(spark.range(1).select(F.lit(3).alias("k"))).df()


@query(f"{_LEFT} except ({_RIGHT} except select n_nationkey as k from nation where n_nationkey < 8)")
def set_nested(spark, t):
    left, right = _arms(t)
    few = From(t("nation"), "n").where(lambda n: n.n_nationkey < 8).select(lambda n: n.n_nationkey.alias("k"))
    return set_op(left).except_(set_op(right).except_(few)).df()


# aggregates


@query("select l_returnflag, count(*) as n, count(nullif(l_linestatus, 'O')) as c, count(distinct l_suppkey) as d, min(l_shipdate) as lo, max(l_extendedprice) as hi from lineitem group by 1")
def agg_counts(spark, t):
    return From(t("lineitem"), "l").select(lambda x: (x.l_returnflag, A.count_all().alias("n"), A.count(M.nullif(x.l_linestatus, "O")).alias("c"), A.count_distinct(x.l_suppkey).alias("d"), A.min_(x.l_shipdate).alias("lo"), A.max_(x.l_extendedprice).alias("hi"))).group_by(lambda x: x.l_returnflag).df()


@query("select l_returnflag, cast(sum(l_linenumber) as bigint) as si, cast(sum(l_orderkey) as double) as sl, round(sum(l_discount), 4) as sd, round(avg(l_linenumber), 6) as ai, round(avg(l_tax), 6) as ad from lineitem group by 1")
def agg_sum_avg(spark, t):
    return From(t("lineitem"), "l").select(lambda x: (
        x.l_returnflag, A.sum_(x.l_linenumber, T.IntegerType()).alias("si"), A.sum_(x.l_orderkey, T.LongType()).cast("double").alias("sl"), r(A.sum_(x.l_discount)).alias("sd"),
        r(A.avg(x.l_linenumber, T.IntegerType()).cast("double"), 6).alias("ai"), r(A.avg(x.l_tax), 6).alias("ad"),
    )).group_by(lambda x: x.l_returnflag).df()


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names, bool_and(n_nationkey > 3) as every, bool_or(n_nationkey > 20) as some, list(n_nationkey order by n_nationkey) = list_sort(list(n_nationkey)) as agrees from nation group by 1")
def agg_text_bool(spark, t):
    return From(t("nation"), "n").select(lambda x: (x.n_regionkey, A.string_agg(x.n_name, ",", ordered=True).alias("names"), A.bool_and(x.n_nationkey > 3).alias("every"), A.bool_or(x.n_nationkey > 20).alias("some"), (F.size(A.array_agg(x.n_nationkey)) == A.count_all()).alias("agrees"))).group_by(lambda x: x.n_regionkey).df()


@query("select n_regionkey, array_to_string(list_transform(list(nullif(n_nationkey, 4) order by n_nationkey), lambda x: coalesce(cast(x as varchar), 'null')), ',') as xs from nation group by 1")
def agg_array(spark, t):
    inner = From(t("nation"), "n").select(lambda x: (x.n_regionkey, A.array_agg(F.struct(x.n_nationkey.alias("k"), M.nullif(x.n_nationkey, 4).alias("v"))).alias("xs"))).group_by(lambda x: x.n_regionkey).df()
    return inner.select("n_regionkey", AR.array_to_string(F.transform(F.sort_array("xs"), lambda s: s["v"]), ",", "null").alias("xs"))


@query("select l_returnflag, round(stddev(l_quantity), 4) as sd, round(stddev_pop(l_quantity), 4) as sp, round(variance(l_quantity), 4) as v, round(var_pop(l_quantity), 4) as vp, stddev(case when l_orderkey = 1 and l_linenumber = 1 then l_quantity end) is null as one from lineitem group by 1")
def agg_spread(spark, t):
    return From(t("lineitem"), "l").select(lambda x: (x.l_returnflag, r(A.stddev(x.l_quantity)).alias("sd"), r(A.stddev_pop(x.l_quantity)).alias("sp"), r(A.variance(x.l_quantity)).alias("v"), r(A.var_pop(x.l_quantity)).alias("vp"), A.stddev_samp(F.when((x.l_orderkey == 1) & (x.l_linenumber == 1), x.l_quantity)).isNull().alias("one"))).group_by(lambda x: x.l_returnflag).df()


@query("""select l_returnflag, round(corr(l_extendedprice, l_quantity), 6) as c, round(covar_pop(l_extendedprice, l_quantity), 1) as cp, round(covar_samp(l_extendedprice, l_quantity), 1) as cs,
round(regr_slope(l_extendedprice, l_quantity), 3) as sl, round(regr_intercept(l_extendedprice, l_quantity), 2) as ic, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n, round(regr_r2(l_extendedprice, l_quantity), 6) as r2,
round(regr_avgx(l_extendedprice, l_quantity), 4) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay, round(regr_sxx(l_extendedprice, l_quantity), 0) as sxx, round(regr_syy(l_extendedprice, l_quantity) / 1e6, 0) as syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e3, 0) as sxy from lineitem group by 1""")
def agg_regression(spark, t):
    yx = lambda f: lambda x: f(x.l_extendedprice, x.l_quantity)
    return From(t("lineitem"), "l").select(lambda x: (
        x.l_returnflag, r(yx(A.corr)(x), 6).alias("c"), r(yx(A.covar_pop)(x), 1).alias("cp"), r(yx(A.covar_samp)(x), 1).alias("cs"), r(yx(A.regr_slope)(x), 3).alias("sl"), r(yx(A.regr_intercept)(x), 2).alias("ic"),
        yx(A.regr_count)(x).alias("n"), r(yx(A.regr_r2)(x), 6).alias("r2"), r(yx(A.regr_avgx)(x)).alias("ax"), r(yx(A.regr_avgy)(x)).alias("ay"), r(yx(A.regr_sxx)(x), 0).alias("sxx"), r(yx(A.regr_syy)(x) / 1e6, 0).alias("syy"), r(yx(A.regr_sxy)(x) / 1e3, 0).alias("sxy"),
    )).group_by(lambda x: x.l_returnflag).df()


# windows

_W = "over (partition by o_custkey order by o_orderdate, o_orderkey)"


def _w(o, *extra):
    return W.spec.partition_by(o.o_custkey).order_by(W.asc(o.o_orderdate), W.asc(o.o_orderkey))


@query(f"select o_orderkey, row_number() {_W} as rn, rank() over (partition by o_custkey order by o_orderstatus) as rk, dense_rank() over (partition by o_custkey order by o_orderstatus) as dr, round(percent_rank() {_W}, 6) as pr, round(cume_dist() {_W}, 6) as cd, cast(ntile(3) {_W} as integer) as nt from orders")
def win_ranking(spark, t):
    by_status = lambda o: W.spec.partition_by(o.o_custkey).order_by(W.asc(o.o_orderstatus))
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, W.row_number(_w(o)).alias("rn"), W.rank(by_status(o)).alias("rk"), W.dense_rank(by_status(o)).alias("dr"), r(W.percent_rank(_w(o)), 6).alias("pr"), r(W.cume_dist(_w(o)), 6).alias("cd"), W.ntile(3, _w(o)).alias("nt"))).df()


@query(f"select o_orderkey, lag(o_orderkey) {_W} as a, lag(o_orderkey, 2) {_W} as b, lag(o_orderkey, 1, 0) {_W} as c, lead(o_orderkey) {_W} as d, lead(o_orderkey, 2) {_W} as e, lead(o_orderkey, 1, -1) {_W} as f from orders")
def win_lag_lead(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, W.lag(o.o_orderkey, _w(o)).alias("a"), W.lag(o.o_orderkey, _w(o), 2).alias("b"), W.lag(o.o_orderkey, _w(o), 1, 0).alias("c"), W.lead(o.o_orderkey, _w(o)).alias("d"), W.lead(o.o_orderkey, _w(o), 2).alias("e"), W.lead(o.o_orderkey, _w(o), 1, -1).alias("f"))).df()


_FULL = "over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)"


@query(f"select o_orderkey, first_value(o_orderkey) {_FULL} as a, last_value(o_orderkey) {_FULL} as b, nth_value(o_orderkey, 3) {_FULL} as c from orders")
def win_values(spark, t):
    full = lambda o: _w(o).rows_between(W.UNBOUNDED_PRECEDING, W.UNBOUNDED_FOLLOWING)
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, W.first_value(o.o_orderkey, full(o)).alias("a"), W.last_value(o.o_orderkey, full(o)).alias("b"), W.nth_value(o.o_orderkey, 3, full(o)).alias("c"))).df()


@query("""select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following), 2) as rows_sum,
count(*) over (partition by o_custkey order by o_orderkey range between 500 preceding and current row) as range_n, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey), 2) as running,
count(*) over (partition by o_custkey order by o_orderstatus) as peers, max(o_totalprice) over (partition by o_custkey) as whole from orders""")
def win_frames(spark, t):
    by = lambda o: W.spec.partition_by(o.o_custkey).order_by(W.asc(o.o_orderkey))
    return From(t("orders"), "o").select(lambda o: (
        o.o_orderkey, r(W.over(A.sum_(o.o_totalprice), by(o).rows_between(W.preceding(2), W.following(1))), 2).alias("rows_sum"), W.over(A.count_all(), by(o).range_between(W.preceding(500), W.CURRENT_ROW)).alias("range_n"),
        r(W.over(A.sum_(o.o_totalprice), by(o)), 2).alias("running"), W.over(A.count_all(), W.spec.partition_by(o.o_custkey).order_by(W.asc(o.o_orderstatus))).alias("peers"), W.over(A.max_(o.o_totalprice), W.spec.partition_by(o.o_custkey)).alias("whole"),
    )).df()


@query("select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderstatus groups between 1 preceding and current row), 2) as g from orders")
def win_groups(spark, t):
    frame = W.spec.partition_by(F.col("o_custkey")).order_by(W.asc(F.col("o_orderstatus"))).groups_between(W.preceding(1), W.CURRENT_ROW)
    return W.over_groups(t("orders"), F.sum("o_totalprice"), frame, "g").select("o_orderkey", r(F.col("g"), 2).alias("g"))


@query("select count(*) over () as n, r_regionkey from region")
def win_empty(spark, t):
    return From(t("region"), "x").select(lambda x: (W.over(A.count_all()).alias("n"), x.r_regionkey)).df()


# strings


@query("""select p_partkey, lower(p_name) as lo, upper(p_name) as up, trim('  ' || p_name || ' ') as tr, trim(p_brand, 'Bd#1') as tc, ltrim('  ' || p_name) as lt, rtrim(p_name || '  ') as rt, replace(p_name, 'e', 'EE') as re, repeat(p_brand, 2) as rp, reverse(p_name) as rv,
length(p_name) as ln, strlen(p_name) as ol, instr(p_name, 'a') as po, translate(p_name, 'abc', 'xy') as ts, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 4, ' ') as rd, md5(p_name) as md, ascii(p_name) as ac from part""")
def str_basic(spark, t):
    return From(t("part"), "p").select(lambda p: (
        p.p_partkey, S.lower(p.p_name).alias("lo"), S.upper(p.p_name).alias("up"), S.trim(S.concat(F.lit("  "), p.p_name, F.lit(" "))).alias("tr"), S.trim(p.p_brand, "Bd#1").alias("tc"), S.ltrim(S.concat(F.lit("  "), p.p_name)).alias("lt"), S.rtrim(S.concat(p.p_name, F.lit("  "))).alias("rt"),
        S.replace(p.p_name, "e", "EE").alias("re"), S.repeat(p.p_brand, F.lit(2)).alias("rp"), S.reverse(p.p_name).alias("rv"), S.length(p.p_name).cast("long").alias("ln"), S.octet_length(p.p_name).cast("long").alias("ol"), S.position("a", p.p_name).cast("long").alias("po"),
        S.translate(p.p_name, "abc", "xy").alias("ts"), S.lpad(p.p_brand, 12, "*").alias("lp"), S.rpad(p.p_brand, 4).alias("rd"), S.md5(p.p_name).alias("md"), S.ascii_(p.p_name).alias("ac"),
    )).df()


@query("""select p_partkey, substr(p_name, 3) as s1, substr(p_name, 2, 4) as s2, substr(p_name, 1, 2) as s3, left(p_name, 3) as l1, left(p_name, -2) as l2, right(p_name, 3) as r1, right(p_name, -2) as r2,
regexp_replace(p_name, '([aeiou])([a-z])', '\\2\\1') as rx, split_part(p_name, ' ', 2) as sp, split_part(p_name, ' ', -1) as sn, split_part(p_name, ' ', 40) as so, concat(p_brand, nullif(p_size, 1), '!') as cc, chr(cast(8364 + p_size as integer)) as ch from part""")
def str_pieces(spark, t):
    return From(t("part"), "p").select(lambda p: (
        p.p_partkey, S.substring(p.p_name, 3).alias("s1"), S.substring(p.p_name, 2, 4).alias("s2"), S.substring(p.p_name, 0, 3).alias("s3"), S.left(p.p_name, 3).alias("l1"), S.left(p.p_name, -2).alias("l2"), S.right(p.p_name, 3).alias("r1"), S.right(p.p_name, -2).alias("r2"),
        S.regexp_replace(p.p_name, "([aeiou])([a-z])", "\\2\\1").alias("rx"), S.split_part(p.p_name, " ", 2).alias("sp"), S.split_part(p.p_name, " ", -1).alias("sn"), S.split_part(p.p_name, " ", 40).alias("so"), S.concat(p.p_brand, M.nullif(p.p_size, 1), F.lit("!")).alias("cc"), S.chr_(p.p_size + 8364).alias("ch"),
    )).df()


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as ic, 'Hello, ' || p_name || ' of ' || p_brand || '!' as fm from part")
def str_initcap_format(spark, t):
    return From(t("part"), "p").select(lambda p: (p.p_partkey, S.initcap(p.p_name).alias("ic"), S.format_("Hello, %s of %s!", p.p_name, p.p_brand).alias("fm"))).df()


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as d, strftime(o_orderdate, '%d/%m/%Y') as e from orders")
def str_to_char(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, S.to_char(o.o_orderdate, "YYYY-MM-DD HH24:MI:SS").alias("d"), S.to_char(o.o_orderdate, "DD/MM/YYYY").alias("e"))).df()


@query("select p_partkey, format('{:,.2f}', round(p_retailprice, 2)) as f, cast(p_size + 1000 as decimal(4,0)) as n from part")
def str_numbers(spark, t):
    return From(t("part"), "p").select(lambda p: (p.p_partkey, S.to_char(F.round(p.p_retailprice, 2), "FM999,999,990.00").alias("f"), S.to_number(S.to_char(p.p_size + 1000, "FM9,999"), "9,999").alias("n"))).df()


# numbers


@query("""select c_custkey, abs(c_acctbal) as ab, ceil(c_acctbal) as ce, floor(c_acctbal) as fl, trunc(c_acctbal) as tr, round_even(c_acctbal, 0) as ro, round(cast(c_acctbal as decimal(18,4)), 1) as rd, c_custkey % 7 as mo,
greatest(c_acctbal, 100.0, nullif(c_acctbal, c_acctbal)) as gr, least(c_custkey, 100) as le, cast(sign(c_acctbal) as double) as sg from customer""")
def num_rounding(spark, t):
    return From(t("customer"), "c").select(lambda c: (
        c.c_custkey, N.abs_(c.c_acctbal).alias("ab"), N.ceil(c.c_acctbal, "double").alias("ce"), N.floor(c.c_acctbal, "double").alias("fl"), N.trunc(c.c_acctbal, "double").alias("tr"), N.round_(c.c_acctbal, of="double").alias("ro"), N.round_(c.c_acctbal.cast("decimal(18,4)"), 1).cast("decimal(18,1)").alias("rd"),
        N.mod(c.c_custkey, 7).alias("mo"), N.greatest(c.c_acctbal, F.lit(100.0), M.nullif(c.c_acctbal, c.c_acctbal)).alias("gr"), N.least(c.c_custkey, F.lit(100).cast("long")).alias("le"), N.sign(c.c_acctbal, "double").alias("sg"),
    )).df()


@query("""select c_custkey, round(sqrt(c_custkey), 6) as sq, round(power(c_custkey, 1.5), 4) as po, round(exp(c_nationkey / 10.0), 6) as ex, round(ln(c_custkey + 1), 6) as l, round(log10(c_custkey + 1), 6) as lg, round(pi(), 6) as p, round(degrees(c_nationkey / 10.0), 6) as de, round(radians(c_nationkey * 1.0), 6) as ra from customer""")
def num_powers(spark, t):
    return From(t("customer"), "c").select(lambda c: (
        c.c_custkey, r(N.sqrt(c.c_custkey), 6).alias("sq"), r(N.power(c.c_custkey, F.lit(1.5)), 4).alias("po"), r(N.exp(c.c_nationkey / 10.0), 6).alias("ex"), r(N.ln(c.c_custkey + 1), 6).alias("l"), r(N.log(c.c_custkey + 1), 6).alias("lg"), r(N.pi(), 6).alias("p"), r(N.degrees(c.c_nationkey / 10.0), 6).alias("de"), r(N.radians(c.c_nationkey * 1.0), 6).alias("ra"),
    )).df()


@query("""select n_nationkey, round(sin(x), 6) as a, round(cos(x), 6) as b, round(tan(x), 6) as c, round(asin(x / 3), 6) as d, round(acos(x / 3), 6) as e, round(atan(x), 6) as f, round(atan2(x, 2), 6) as g, round(sinh(x), 6) as h, round(cosh(x), 6) as i, round(tanh(x), 6) as j from (select n_nationkey, n_nationkey / 10.0 as x from nation)""")
def num_trigonometry(spark, t):
    x = F.col("n_nationkey") / 10.0
    fs = {"a": N.sin(x), "b": N.cos(x), "c": N.tan(x), "d": N.asin(x / 3), "e": N.acos(x / 3), "f": N.atan(x), "g": N.atan2(x, F.lit(2.0)), "h": N.sinh(x), "i": N.cosh(x), "j": N.tanh(x)}
    return t("nation").select("n_nationkey", *[r(e, 6).alias(k) for k, e in fs.items()])


@query("select 10 * count(*) as drawn, cast(0 as bigint) as outside, cast(10 as bigint) as tenths from nation")
def num_random(spark, t):
    many = t("nation").crossJoin(spark.range(10)).withColumn("x", N.random())
    tenths = spark.range(20000).select(F.floor(N.random() * 10).alias("d")).agg(F.count_distinct("d").alias("tenths"))
    return many.agg(F.count("x").alias("drawn"), F.count(F.when((F.col("x") < 0) | (F.col("x") >= 1), 1)).alias("outside")).crossJoin(tenths)


# dates and times


@query("""select event_id, extract(year from ts) as y, extract(month from ts) as mo, extract(day from ts) as d, extract(hour from ts) as h, extract(dow from ts) as dow, extract(isodow from ts) as iso, extract(doy from ts) as doy, extract(week from ts) as wk, extract(quarter from ts) as q,
cast(floor(epoch(ts)) as bigint) as ep, extract(century from ts) as ce, extract(decade from ts) as de, extract(millennium from ts) as mi, cast(extract(microseconds from ts) as bigint) as us from events""")
def time_extract(spark, t):
    names = {"y": "year", "mo": "month", "d": "day", "h": "hour", "dow": "dow", "iso": "isodow", "doy": "doy", "wk": "week", "q": "quarter", "ce": "century", "de": "decade", "mi": "millennium", "us": "microseconds"}
    ts = F.col("ts")
    return t("events").select("event_id", *[D.extract(f, ts).cast("long").alias(k) for k, f in names.items()], F.floor(D.extract("epoch", ts)).cast("long").alias("ep"))


@query("select event_id, cast(date_trunc('year', ts) as timestamp) as y, cast(date_trunc('month', ts) as timestamp) as m, cast(date_trunc('week', ts) as timestamp) as w, cast(date_trunc('hour', ts) as timestamp) as h from events")
def time_trunc(spark, t):
    return t("events").select("event_id", *[D.date_trunc(f, F.col("ts")).alias(k) for k, f in (("y", "year"), ("m", "month"), ("w", "week"), ("h", "hour"))])


@query("""select o_orderkey, datepart('year', i) * 12 + datepart('month', i) as months, datepart('day', i) as days, datepart('hour', i) as hours from (select o_orderkey, age(timestamp '1999-03-31 12:00:00', o_orderdate) as i from orders)""")
def time_age(spark, t):
    i = D.age(F.lit("1999-03-31 12:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t("orders").select("o_orderkey", i.alias("i")).select("o_orderkey", F.col("i.months").cast("long").alias("months"), F.col("i.days").cast("long").alias("days"), F.floor(F.col("i.micros") / 3_600_000_000).cast("long").alias("hours"))


@query("""select n, m + d // 30 as jd_months, d % 30 as jd_days, d + h // 24 as jh_days, h % 24 as jh_hours, m + (d + h // 24) // 30 as ji_months, (d + h // 24) % 30 as ji_days from (select n_nationkey as n, n_nationkey % 3 as m, n_nationkey * 7 as d, n_nationkey * 11 as h from nation)""")
def time_justify(spark, t):
    n = F.col("n_nationkey")
    i = D.interval(n % 3, n * 7, (n * 11).cast("long") * F.lit(3_600_000_000))
    jd, jh, ji = D.justify_days(F.col("i")), D.justify_hours(F.col("i")), D.justify_interval(F.col("i"))
    df = t("nation").select(n.alias("n"), i.alias("i")).select("n", jd.alias("jd"), jh.alias("jh"), ji.alias("ji"))
    return df.select("n", F.col("jd.months").alias("jd_months"), F.col("jd.days").alias("jd_days"), F.col("jh.days").alias("jh_days"), (F.col("jh.micros") / 3_600_000_000).cast("int").alias("jh_hours"), F.col("ji.months").alias("ji_months"), F.col("ji.days").alias("ji_days"))


@query("select n_nationkey, make_date(2000 + n_nationkey, 6, 15) as d, make_timestamp(2000 + n_nationkey, 6, 15, 12, 30, 1.5) as ts, cast(make_timestamp(cast(n_nationkey as bigint) * 86400000000) as timestamp) as ep, cast(strptime('15 06 ' || (2000 + n_nationkey), '%d %m %Y') as date) as td from nation")
def time_make(spark, t):
    n = F.col("n_nationkey")
    return t("nation").select(
        "n_nationkey", D.make_date(n + 2000, F.lit(6), F.lit(15)).alias("d"), D.make_timestamp(n + 2000, F.lit(6), F.lit(15), F.lit(12), F.lit(30), F.lit(1.5)).alias("ts"),
        D.to_timestamp(n.cast("long") * 86400).cast("timestamp_ntz").alias("ep"), D.to_date(F.concat(F.lit("15 06 "), (n + 2000).cast("string")), "DD MM YYYY").alias("td"),
    )


_TODAY = "cast(now() at time zone 'UTC' as date)"
_BORN = "timestamp '2001-03-05'"


@query(f"select {_TODAY} as today, {_TODAY} as now_day, {_TODAY} as current_day, {_TODAY} as local_day, cast(0 as bigint) as minutes_apart, cast(12 * date_part('year', age(cast({_TODAY} as timestamp), {_BORN})) + date_part('month', age(cast({_TODAY} as timestamp), {_BORN})) as integer) as months, cast(date_part('day', age(cast({_TODAY} as timestamp), {_BORN})) as integer) as days")
def time_now(spark, t):
    day = lambda e: e.cast("date")
    aged = D.age_today(F.lit("2001-03-05").cast("date"))
    apart = F.unix_micros(D.now()) - F.unix_micros(D.local_timestamp().cast("timestamp"))
    return From(SRC.empty(spark), "e").select(lambda _: (
        D.current_date().alias("today"), day(D.now()).alias("now_day"), day(D.current_timestamp()).alias("current_day"), day(D.local_timestamp()).alias("local_day"),
        F.floor(F.abs(apart) / 60_000_000).alias("minutes_apart"), aged["months"].alias("months"), aged["days"].alias("days"),
    )).df()


@query("select n_nationkey, lpad(cast(n_nationkey % 24 as varchar), 2, '0') || ':30:01.5' as made, cast(0 as bigint) as apart, cast(now() at time zone 'UTC' as date) as today from nation")
def time_of_day(spark, t):
    """Times of day; the session's setting for their type is on while the plan is made and restored then."""
    before = spark.conf.get("spark.sql.timeType.enabled", None)
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        made = D.make_time((F.col("n_nationkey") % 24).cast("int"), F.lit(30), F.lit(1.5).cast("decimal(16,6)"))
        text = lambda e: e.cast("string")
        day = F.current_date()
        df = t("nation").select("n_nationkey", text(made).alias("made"), F.datediff(day, D.now().cast("date")).cast("long").alias("apart"), day.alias("today"),
                                (text(D.current_time()) == text(D.local_time())).alias("_same"))
        return df.filter("_same").drop("_same")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.timeType.enabled")
        else:
            spark.conf.set("spark.sql.timeType.enabled", before)


# NULL helpers, session functions, extensions


@query("select o_orderkey, nullif(o_orderstatus, 'F') as n, coalesce(nullif(o_orderstatus, 'F'), 'none') as c, cast(null as integer) as z from orders")
def null_helpers(spark, t):
    return From(t("orders"), "o").select(lambda o: (o.o_orderkey, M.nullif(o.o_orderstatus, "F").alias("n"), M.coalesce(M.nullif(o.o_orderstatus, "F"), F.lit("none")).alias("c"), M.null_of("int").alias("z"))).df()


#: Whom Spark takes the session's user to be.
_USER = os.environ.get("SPARK_USER") or pwd.getpwuid(os.geteuid()).pw_name


@query(f"select '{_USER}' as current, '{_USER}' as session, '{_USER}' as own, 'default' as schema, 'spark_catalog' as catalog, 'spark_catalog' as database")
def session_functions(spark, t):
    return From(SRC.empty(spark), "e").select(lambda _: (
        M.current_user().alias("current"), M.session_user().alias("session"), M.user().alias("own"), M.current_schema().alias("schema"), M.current_catalog().alias("catalog"), M.current_database().alias("database"),
    )).df()


@query("select p_partkey, levenshtein(p_brand, p_type) as l, soundex_free as s, p_size * p_size as sq, -p_size as ng, p_brand || p_type as cat from (select *, reverse(p_brand) as soundex_free from part)")
def extension_hooks(spark, t):
    fn, op = M.Function, M.Operator
    return From(t("part"), "p").select(lambda p: (p.p_partkey, fn.binary("levenshtein")(p.p_brand, p.p_type).cast("long").alias("l"), fn.unary("reverse")(p.p_brand).alias("s"), op.infix("*")(p.p_size, p.p_size).alias("sq"), op.prefix("-")(p.p_size).alias("ng"), op.infix("||")(p.p_brand, p.p_type).alias("cat"))).df()


# arrays

_WORDS = "string_split(p_name, ' ')"


@query(f"""select p_partkey, list_has_all({_WORDS}, ['red']) as ct, list_has_all(['red', 'blue', 'green'], {_WORDS}) as cb, list_has_any({_WORDS}, ['red', 'blue']) as ov, array_to_string(list_concat({_WORDS}, ['x']), '|') as cc, len({_WORDS}) as ln, nullif(len({_WORDS}), 0) as al,
array_to_string(list_append({_WORDS}, 'z'), '|') as ap, array_to_string(list_prepend('a', {_WORDS}), '|') as pp, nullif(list_position({_WORDS}, 'red'), 0) as ps, array_to_string(list_filter({_WORDS}, lambda x: x <> 'red'), '|') as rm, array_to_string(list_transform({_WORDS}, lambda x: case when x = 'red' then 'RED' else x end), '|') as rp from part""")
def arr_functions(spark, t):
    w = AR.string_to_array(F.col("p_name"), " ")
    text = lambda a: AR.array_to_string(a, "|")
    return t("part").select(
        "p_partkey", AR.contains(w, AR.array("red")).alias("ct"), AR.contained_by(w, AR.array("red", "blue", "green")).alias("cb"), AR.overlaps(w, AR.array("red", "blue")).alias("ov"), text(AR.concat(w, AR.array("x"))).alias("cc"), AR.cardinality(w).cast("long").alias("ln"), AR.array_length(w).cast("long").alias("al"),
        text(AR.array_append(w, F.lit("z"))).alias("ap"), text(AR.array_prepend("a", w)).alias("pp"), AR.array_position(w, "red").alias("ps"), text(AR.array_remove(w, "red")).alias("rm"), text(AR.array_replace(w, "red", "RED")).alias("rp"),
    )


@query(f"select p_partkey, array_to_string(list_filter(range(1, len({_WORDS}) + 1), lambda i: {_WORDS}[i] = 'red'), ',') as ps, array_to_string(list_concat({_WORDS}, {_WORDS}), ' ') as c from part")
def arr_positions(spark, t):
    w = AR.string_to_array(F.col("p_name"), " ")
    return t("part").select("p_partkey", AR.array_to_string(AR.array_positions(w, "red"), ",").alias("ps"), AR.array_to_string(AR.array_cat(w, w), " ").alias("c"))


@query(f"select p_partkey, unnest({_WORDS}) as word from part")
def arr_unnest(spark, t):
    return t("part").select("p_partkey", AR.unnest(AR.string_to_array(F.col("p_name"), " ")).alias("word"))


# ranges

_LO = "cast(o_orderdate as date)"
_BOOK = f"(select o_orderkey, o_custkey, {_LO} as lo, {_LO} + cast(1 + o_orderkey % 60 as integer) as hi, date '1995-01-01' as a, date '1995-03-01' as b from orders)"


def _book(t):
    day = F.col("o_orderdate").cast("date")
    own = R.daterange(day, F.date_add(day, (F.col("o_orderkey") % 60 + 1).cast("int")))
    probe = R.daterange(F.lit("1995-01-01").cast("date"), F.lit("1995-02-28").cast("date"), "[]")
    return t("orders").select("o_orderkey", "o_custkey", own.alias("r"), probe.alias("p"))


@query(f"select o_orderkey, (a <= lo and hi <= b) as ct, (lo <= a and b <= hi) as cb, (lo < b and a < hi) as ov, hi <= a as sl, lo >= b as sr, hi <= b as nr, lo >= a as nl, (hi = a or lo = b) as ad, (lo <= date '1995-02-01' and date '1995-02-01' < hi) as el from {_BOOK}")
def range_predicates(spark, t):
    a, p, day = F.col("r"), F.col("p"), F.lit("1995-02-01").cast("date")
    return _book(t).select(
        "o_orderkey", R.contains(p, a).alias("ct"), R.contained_by(p, a).alias("cb"), R.overlaps(a, p).alias("ov"), R.strictly_left(a, p).alias("sl"), R.strictly_right(a, p).alias("sr"), R.does_not_extend_right(a, p).alias("nr"),
        R.does_not_extend_left(a, p).alias("nl"), R.adjacent(a, p).alias("ad"), (R.contains_elem(a, day) & R.elem_contained_by(day, a)).alias("el"),
    )


@query(f"select o_orderkey, case when lo < b and a < hi then greatest(lo, a) end as il, case when lo < b and a < hi then least(hi, b) end as iu, not (lo < b and a < hi) as ie, case when lo < b and a < hi then least(lo, a) end as ul, case when lo < b and a < hi then greatest(hi, b) end as uu from {_BOOK}")
def range_algebra(spark, t):
    a, p = F.col("r"), F.col("p")
    both = R.overlaps(a, p)
    return _book(t).withColumn("i", R.intersect("daterange", a, p)).withColumn("u", F.when(both, R.union("daterange", a, p))).select(
        "o_orderkey", R.lower(F.col("i")).alias("il"), R.upper(F.col("i")).alias("iu"), R.is_empty(F.col("i")).alias("ie"), R.lower(F.col("u")).alias("ul"), R.upper(F.col("u")).alias("uu")
    )


@query(f"select o_orderkey, case when hi <= a or lo >= b then lo when lo < a then lo when hi > b then b end as dl, case when hi <= a or lo >= b then hi when lo < a then a when hi > b then hi end as du from {_BOOK} where not (lo < a and hi > b)")
def range_difference(spark, t):
    a, p = F.col("r"), F.col("p")
    safe = _book(t).filter(~((R.lower(a) < R.lower(p)) & (R.upper(a) > R.upper(p))))
    return safe.withColumn("d", R.difference("daterange", a, p)).select("o_orderkey", R.lower(F.col("d")).alias("dl"), R.upper(F.col("d")).alias("du"))


@query("""select n_nationkey as n, n_nationkey + 1 as il, 31 as iu, true as li, false as ui, '[' || (n_nationkey + 1) || ',31)' as tx, cast(n_nationkey as bigint) as bl, n_nationkey = 0 as em, true as nb, true as inf, cast('[' || (n_nationkey + 1) || ',31)' as varchar) as pr from nation""")
def range_constructors(spark, t):
    n = F.col("n_nationkey")
    i = R.int4range(n, F.lit(30), "(]")
    big = R.int8range(n, n * 2)
    num = R.numrange(n, n + 1, "[]")
    stamp = R.tsrange(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(None))
    zoned = R.tstzrange(F.lit(None), F.lit("2024-01-01").cast("timestamp"))
    made = t("nation").select(n.alias("n"), i.alias("i"), big.alias("big"), num.alias("num"), stamp.alias("stamp"), zoned.alias("zoned"))
    i, big, num, stamp, zoned = (F.col(c) for c in ("i", "big", "num", "stamp", "zoned"))
    shown = made.withColumn("tx", R.to_text(i))
    return shown.select(
        "n", R.lower(i).alias("il"), R.upper(i).alias("iu"), R.lower_inc(i).alias("li"), R.upper_inc(i).alias("ui"), "tx", F.coalesce(R.lower(big), F.lit(0).cast("long")).alias("bl"), R.is_empty(big).alias("em"),
        (R.lower_inc(num) & R.upper_inc(num)).alias("nb"), (R.upper_inf(stamp) & R.lower_inf(zoned) & ~R.lower_inf(stamp)).alias("inf"), R.to_text(R.parse("int4range", F.col("tx"))).alias("pr"),
    )


# JSON


@query("""select event_id, props->>'k' as p, cast(json_extract(props, '$.k') as varchar) as q, (props->>'k') = '69' as cb, true as self, '{"a":{"b":[1,{"c":"' || event_type || '"}]}}' as whole, event_type as deep, cast(null as varchar) as missing from events""")
def json_paths(spark, t):
    v = J.parse(F.col("props"))
    nested = J.parse(F.concat(F.lit('{"a": {"b": [1, {"c": "'), F.col("event_type"), F.lit('"}]}}')))
    return t("events").select(
        "event_id", J.path_text(v, "k").alias("p"), J.text(J.path(v, "k")).alias("q"), J.contained_by(v, J.parse(F.lit('{"k": 69, "z": [1, 2]}'))).alias("cb"), J.contained_by(nested, nested).alias("self"),
        J.text(nested).alias("whole"), J.path_text(nested, "a", "b", 1, "c").alias("deep"), J.text(J.path(nested, "a", "x")).alias("missing"),
    )


@query("select event_id, props->>'k' as k, json_extract_string(props, '$.k') as p, cast(json_extract(props, '$.missing') as varchar) as m, json_type(props) = 'OBJECT' as o from events")
def json_get(spark, t):
    v = J.parse(F.col("props"))
    return t("events").select("event_id", J.get_text(v, "k").alias("k"), J.path_text(v, "k").alias("p"), J.text(J.get(v, "missing")).alias("m"), (J.typeof(v) == "object").alias("o"))


@query("select event_id, json_exists(props, '$.k') as hk, json_exists(props, '$.k') or json_exists(props, '$.z') as ha, json_exists(props, '$.k') and json_exists(props, '$.z') as hl, json_contains(props, '{\"k\": 69}') as ct from events")
def json_keys(spark, t):
    v = J.parse(F.col("props"))
    probe = J.parse(F.lit('{"k": 69}'))
    return t("events").select("event_id", J.has_key(v, "k").alias("hk"), J.has_any_key(v, "k", "z").alias("ha"), J.has_all_keys(v, "k", "z").alias("hl"), J.contains(v, probe).alias("ct"))


@query("select event_id, cast(event_id as varchar) as a, cast(user_id as varchar) as b, 2 as n, cast(user_id as varchar) as c from events")
def json_arrays(spark, t):
    v = J.to_jsonb(F.array("event_id", "user_id"), T.ArrayType(T.LongType()))
    return t("events").select("event_id", J.at_text(v, 0).alias("a"), J.at_text(v, -1).alias("b"), J.array_length(v).alias("n"), J.text(J.at(v, 1)).alias("c"))


@query("""select event_id, '{"k":' || (props->>'k') || ',"z":1}' as s, '{"k":1}' as r, '{}' as d, '{"k":' || (props->>'k') || ',"y":[' || event_id || ']}' as c, '[0,1,9]' as i, '{"a":1}' as n, '{' || chr(10) || '    "k": ' || (props->>'k') || chr(10) || '}' as p from events""")
def json_edit(spark, t):
    v = J.parse(F.col("props"))
    one = J.parse(F.lit("1"))
    tail = J.parse(F.concat(F.lit('{"y": ['), F.col("event_id").cast("string"), F.lit("]}")))
    return t("events").select(
        "event_id", J.text(J.set_(v, ["z"], one)).alias("s"), J.text(J.set_(v, ["k"], one)).alias("r"), J.text(J.delete_key(v, "k")).alias("d"), J.text(J.concat(v, tail)).alias("c"),
        J.text(J.insert(J.parse(F.lit("[0, 9]")), [1], one)).alias("i"), J.text(J.strip_nulls(J.parse(F.lit('{"a": 1, "b": null}')))).alias("n"), J.pretty(v).alias("p"),
    )


@query("select event_id, cast(props->>'k' as integer) as k, '{\"k\":' || (props->>'k') || '}' as back from events")
def json_typed(spark, t):
    shape = T.StructType().add("k", T.IntegerType())
    return t("events").withColumn("s", J.typed(F.col("props"), shape)).select("event_id", F.col("s.k").alias("k"), J.untyped(F.col("s")).alias("back"))


# mutations


def _region(t):
    table = Builder("region").column("r_regionkey", "int4").column_defaulted("r_name", "text", "NEW").build().with_primary("r_regionkey")
    return table, t("region").select("r_regionkey", "r_name")


@query("select r_regionkey, r_name from region union all select * from (values (90, 'ATLANTIS'), (91, 'LEMURIA'))")
def dml_insert_values(spark, t):
    table, current = _region(t)
    return DML.insert(spark, table, current, {"r_regionkey": 90, "r_name": "ATLANTIS"}, {"r_regionkey": 91, "r_name": "LEMURIA"}).run().table


@query("select 92 as r_regionkey, 'NEW' as r_name")
def dml_insert_default_returning(spark, t):
    table, current = _region(t)
    return DML.insert(spark, table, current, {"r_regionkey": 92}).run().returning(lambda x: (x.r_regionkey, x.r_name))


@query("select r_regionkey, r_name from region union all select n_nationkey + 100, n_name from nation where n_regionkey = 1")
def dml_insert_select(spark, t):
    table, current = _region(t)
    rows = From(t("nation"), "n").where(lambda n: n.n_regionkey == 1).select(lambda n: ((n.n_nationkey + 100).alias("r_regionkey"), n.n_name.alias("r_name")))
    return DML.insert_from(table, current, rows).run().table


@query("select r_regionkey, r_name from region union all select n_nationkey, n_name from nation where n_nationkey not in (select r_regionkey from region)")
def dml_insert_do_nothing(spark, t):
    table, current = _region(t)
    rows = From(t("nation"), "n").select(lambda n: (n.n_nationkey.alias("r_regionkey"), n.n_name.alias("r_name")))
    return DML.insert_from(table, current, rows).on_conflict_do_nothing().run().table


@query("select coalesce(r_regionkey, n_nationkey) as r_regionkey, case when r_regionkey is not null and n_nationkey is not null then r_name || '/' || n_name else coalesce(r_name, n_name) end as r_name from region full join nation on r_regionkey = n_nationkey")
def dml_upsert(spark, t):
    table, current = _region(t)
    rows = From(t("nation"), "n").select(lambda n: (n.n_nationkey.alias("r_regionkey"), n.n_name.alias("r_name")))
    return DML.insert_from(table, current, rows).on_conflict("r_regionkey").do_update(lambda old, ex: {"r_name": F.concat(old.r_name, F.lit("/"), ex.r_name)}).run().table


@query("select o_orderkey, o_orderstatus, case when o_orderstatus = 'P' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
def dml_update(spark, t):
    done = DML.update(ORDERS, t("orders")).set(lambda o: {"o_totalprice": o.o_totalprice * 2}).where(lambda o: o.o_orderstatus == "P").run()
    return done.table.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, 'X' as o_orderstatus from orders where o_totalprice > 200000")
def dml_patch_returning(spark, t):
    done = DML.update(ORDERS, t("orders")).patch({"o_orderstatus": "X", "o_orderpriority": None}).where(lambda o: o.o_totalprice > 200000).run()
    return done.returning(lambda o: (o.o_orderkey, o.o_orderstatus))


@query("select o_orderkey, case when c_custkey is not null then c_mktsegment else o_orderpriority end as o_orderpriority from orders left join (select * from customer where c_acctbal > 5000) on c_custkey = o_custkey")
def dml_update_from(spark, t):
    done = DML.update(ORDERS, t("orders"), "o").from_(t("customer"), "c").set(lambda s: {"o_orderpriority": s.c.c_mktsegment}).where(lambda s: (s.c.c_custkey == s.o.o_custkey) & (s.c.c_acctbal > 5000)).run()
    return done.table.select("o_orderkey", "o_orderpriority")


@query("select o_orderkey from orders where not (o_totalprice < 100000)")
def dml_delete(spark, t):
    return DML.delete(ORDERS, t("orders")).where(lambda o: o.o_totalprice < 100000).run().table.select("o_orderkey")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def dml_delete_using_returning(spark, t):
    done = DML.delete(ORDERS, t("orders"), "o").using(t("customer"), "c").where(lambda s: (s.c.c_custkey == s.o.o_custkey) & (s.c.c_acctbal < 0)).run()
    return done.returning(lambda o: (o.o_orderkey, o.o_custkey))


@query("select n_nationkey, n_name, n_regionkey, '*' || n_name as renamed from nation where n_regionkey = 2")
def dml_returning_all(spark, t):
    """RETURNING every column, then the rows as values of a class and back."""
    table = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").column("n_regionkey", "int4").build().with_primary("n_nationkey")
    done = DML.delete(table, t("nation").select("n_nationkey", "n_name", "n_regionkey")).where(lambda n: n.n_regionkey == 2).run()
    found = FETCH.to(Nation, FETCH.run(done.returning()))
    rows = [{**asdict(x), "renamed": "*" + x.n_name} for x in found]
    return SRC.values(spark, rows, "n_nationkey int, n_name string, n_regionkey int, renamed string")


@query("select n_nationkey as r_regionkey, case when n_regionkey = 1 then 'moved' else n_name end as r_name from nation where n_regionkey <> 0")
def dml_several_sources(spark, t):
    """UPDATE ... FROM and DELETE ... USING two relations each, on a table without a key."""
    table = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").column("n_regionkey", "int4").build()
    linked = lambda s: (s.n.n_regionkey == s.r.r_regionkey) & (s.r.r_name == s.o.name)
    names = lambda key: t("region").filter(F.col("r_regionkey") == key).select(F.col("r_name").alias("name"))
    moved = DML.update(table, t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n").from_(t("region"), "r").from_(names(1), "o").set(lambda s: {"n_name": "moved"}).where(linked).run()
    left = DML.delete(table, moved.table, "n").using(t("region"), "r").using(names(0), "o").where(linked).run()
    return left.table.select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))


@query("""select * from (values ('unknown_column', 'ValueError'), ('missing_required', 'ValueError'), ('null_in_required', 'ValueError'), ('broken_constraint', 'ValueError'), ('no_rows', 'ValueError'), ('different_columns', 'ValueError'),
('unknown_key', 'ValueError'), ('view', 'TypeError'), ('update_without_where', 'ValueError'), ('default_fills', 'passes'), ('own_type', 'passes'), ('twice_in_one_upsert', 'SparkRuntimeException')) v(attempt, outcome)""")
def dml_checks(spark, t):
    register_type("even", T.IntegerType())
    table = Builder("region").column("r_regionkey", "int4").column_defaulted("r_name", "text", "NEW").build().with_primary("r_regionkey")
    pair = TableDef("pair", (ColumnDef("k", "int4"), ColumnDef("even", "even", check=lambda x: x % 2 == 0)))
    region, none = t("region").select("r_regionkey", "r_name"), spark.createDataFrame([], "k int, even int")
    put = lambda *rows: DML.insert(spark, table, region, *rows)
    return _refusals(
        spark, unknown_column=lambda: put({"r_regionkey": 1, "nope": 2}), missing_required=lambda: put({"r_name": "x"}), null_in_required=lambda: put({"r_regionkey": None}),
        broken_constraint=lambda: DML.insert(spark, pair, none, {"k": 1, "even": 3}), no_rows=lambda: put(), different_columns=lambda: put({"r_regionkey": 1}, {"r_regionkey": 2, "r_name": "x"}),
        unknown_key=lambda: put({"r_regionkey": 1}).on_conflict("r_name"), view=lambda: DML.insert(spark, CUSTOMER_VIEW, t("customer"), {"c_custkey": 1}), update_without_where=lambda: DML.update(table, region).set(lambda _: {"r_name": "x"}).run(),
        default_fills=lambda: put({"r_regionkey": 9}).run().count(), own_type=lambda: DML.insert(spark, pair, none, {"k": 1, "even": 4}).run().count(),
        twice_in_one_upsert=lambda: put({"r_regionkey": 1}, {"r_regionkey": 1}).on_conflict("r_regionkey").do_update(lambda old, ex: {"r_name": ex.r_name}).run().count(),
    )


# fetching


@dataclass
class Nation:
    n_nationkey: int
    n_name: str
    n_regionkey: int


@query("""select 'run' as form, count(*) as n, sum(n_nationkey) as total from nation union all select 'unique', 1, 7 union all select 'option', 1, 8 union all select 'option of none', 0, null
union all select 'chunks of 10', 3, sum(n_nationkey) from nation union all select 'cursor', count(*), sum(n_nationkey) from nation union all select 'later', count(*), sum(n_nationkey) from nation union all select 'affected', count(*), null from nation where n_regionkey = 3""")
def fetch_forms(spark, t):
    """Every way to run a query or a command, as rows of what it gave."""
    nations = From(t("nation"), "n").select(lambda n: (n.n_nationkey, n.n_name, n.n_regionkey))
    one = lambda k: nations.where(lambda n: n.n_nationkey == k).df()
    total = lambda rows: sum(r.n_nationkey for r in rows)
    everything, chunks, walked = FETCH.to(Nation, FETCH.run(nations.df())), list(FETCH.stream(nations.df(), 10)), list(FETCH.cursor(nations.df()))
    later = FETCH.later(lambda _: nations.df())(spark)
    table = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").column("n_regionkey", "int4").build()
    command = DML.update(table, t("nation").select("n_nationkey", "n_name", "n_regionkey")).set(lambda _: {"n_name": "x"}).where(lambda n: n.n_regionkey == 3).run()
    rows = [
        ("run", len(everything), total(everything)), ("unique", 1, FETCH.unique(one(7)).n_nationkey), ("option", 1, FETCH.option(one(8)).n_nationkey), ("option of none", len([x for x in [FETCH.option(one(999))] if x]), None),
        ("chunks of 10", len(chunks), sum(map(total, chunks))), ("cursor", len(walked), total(walked)), ("later", len(later), total(later)), ("affected", command.count(), None),
    ]
    return spark.createDataFrame(rows, "form string, n long, total long")


@query("select r_regionkey, r_name, 'app.region' as declared from region")
def scan_in_schema(spark, t):
    """A relation of a schema, read back by its declared columns."""
    declared = Builder("region").column("r_regionkey", "int4").column("r_name", "text").build().in_schema("app")
    columns = [F.col(c.name).cast(c.spark_type) for c in declared.columns]
    return t("region").select(*columns, F.lit(declared.full_name).alias("declared"))


# validation


@query("""select * from (values ('ColumnMissing', 'region', 'r_code', 'int4', cast(null as varchar)), ('TypeMismatch', 'region', 'r_name', 'int8', 'string'), ('ExtraColumn', 'nation', 'n_regionkey', null, 'int'), ('PrimaryKeyMissing', 'nation', null, 'n_regionkey', 'repeated values')) v(kind, relation, "column", expected, actual)""")
def validate_report(spark, t):
    region = Builder("region").column("r_regionkey", "int4").column("r_name", "int8").column("r_code", "int4").build()
    nation = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").build()
    keyed = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").column("n_regionkey", "int4").build().with_primary("n_regionkey")
    names = lambda table, *cols: V.Live(table.select(*cols))
    report = V.validate(spark, (region, names(t("region"), "r_regionkey", "r_name")), (nation, names(t("nation"), "n_nationkey", "n_name", "n_regionkey")), (keyed, names(t("nation"), "n_nationkey", "n_name", "n_regionkey")), t("region"))
    return V.report_frame(spark, report)


@query("""select * from (values ('RelationMissing', 'nowhere', null, 'table', 'nothing'), ('RelationKindMismatch', 'region', null, 'table', 'view'), ('NullabilityMismatch', 'region', 'r_name', 'False', 'True'), ('PrimaryKeyMissing', 'region', null, 'r_regionkey', null),
('ExtraPrimaryKey', 'nation', null, null, 'n_nationkey'), ('PrimaryKeyColumnsDiffer', 'nation', null, 'n_name', 'n_nationkey'), ('UniqueConstraintMissing', 'nation', null, 'n_name', null), ('ExtraUniqueConstraint', 'nation', null, null, 'n_nationkey'), ('raised', 'all', null, '8', 'ValidationError')) v(kind, relation, "column", expected, actual)""")
def validate_kinds(spark, t):
    """Each kind of difference that a catalog's facts show, and the raising form."""
    region = Builder("region").column("r_regionkey", "int4").column("r_name", "text").build()
    nation = Builder("nation").column("n_nationkey", "int4").column("n_name", "text").build()
    regions, nations = t("region").select("r_regionkey", "r_name"), t("nation").select("n_nationkey", "n_name")
    strict = spark.createDataFrame([], T.StructType().add("r_regionkey", T.IntegerType(), False).add("r_name", T.StringType(), True))
    pairs = [
        Builder("nowhere").column("k", "int4").build(), (region, V.Live(regions, "view")), (region, V.Live(strict, declares_nulls=True)), (region.with_primary("r_regionkey"), V.Live(regions, primary=())),
        (nation, V.Live(nations, primary=("n_nationkey",))), (nation.with_primary("n_name"), V.Live(nations, primary=("n_nationkey",))), (nation.with_unique("n_name"), V.Live(nations, uniques=())), (nation, V.Live(nations, uniques=(("n_nationkey",),))),
    ]
    try:
        V.validate_or_raise(spark, *pairs)
        raised = ("raised", "nothing", None, None, None)
    except V.ValidationError as e:
        raised = ("raised", "all", None, str(len(e.report.mismatches)), type(e).__name__)
    report = V.report_frame(spark, V.validate(spark, *pairs))
    return report.union(spark.createDataFrame([raised], report.schema))
