"""Relational queries over the star schema: the SQL surface, by SQL and by DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpquarry.plans import sql as shim

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def both(name: str, text: str, duck: str | None = None) -> None:
    """A query given as SQL: Spark runs it through the shim, DuckDB as it is (or ``duck``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        import re

        views(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", text)])
        return shim.run(spark, text)

    QUERIES[name], SQL[name] = run, duck or text


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


for _t in TABLES:
    QUERIES[f"scan_{_t}"] = lambda spark, sf_dir, _t=_t: table(spark, sf_dir, _t)
    SQL[f"scan_{_t}"] = f"select * from {_t}"

both("filter_orders", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'O'")
both("join_inner", "select c.c_mktsegment, count(*) as n, round(sum(o.o_totalprice), 2) as total from customer c join orders o on c.c_custkey = o.o_custkey group by c.c_mktsegment")
both("join_left", "select c.c_custkey, count(o.o_orderkey) as n_orders from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey")
both("join_self", "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
both("join_semi_in", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
both("join_semi_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'F')")
both("join_anti_not_in", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
both("join_anti_left_null", "select c.c_custkey from customer c left join orders o on c.c_custkey = o.o_custkey where o.o_orderkey is null")
both("join_full_outer", "select coalesce(c.c_nationkey, s.s_nationkey) as nationkey, c.n as n_customers, s.n as n_suppliers from (select c_nationkey, count(*) as n from customer group by c_nationkey) c full outer join (select s_nationkey, count(*) as n from supplier group by s_nationkey) s on c.c_nationkey = s.s_nationkey")
both("join_cross_small", "select r.r_name, n.n_name from region r cross join nation n")
both("agg_basic", "select count(*) as n, cast(sum(l_linenumber) as bigint) as sum_line, min(l_quantity) as min_q, max(l_quantity) as max_q, round(avg(l_discount), 8) as avg_d from lineitem")
both("agg_group_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
both("agg_having_alias", "select l_suppkey, round(sum(l_quantity), 2) as q from lineitem group by l_suppkey having q > 1000")
both("agg_distinct", "select l_returnflag, count(distinct l_partkey) as n_parts, count(distinct l_suppkey) as n_supp from lineitem group by l_returnflag")
both("agg_rollup", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 1) as price from lineitem group by rollup (l_returnflag, l_linestatus)")
both("agg_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
both("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
both("agg_filter", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(*) filter (where o_totalprice > 150000) as n_big from orders group by o_orderpriority")
both("win_row_number", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders")
both("win_running_total", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row), 2) as running from orders")
both("win_rank_family", "select l_orderkey, l_partkey, rank() over (partition by l_orderkey order by l_quantity) as r, dense_rank() over (partition by l_orderkey order by l_quantity) as d, ntile(3) over (partition by l_orderkey order by l_quantity, l_partkey, l_suppkey, l_extendedprice) as t from lineitem")
both("win_lag_lead", "select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before_id, lead(event_id) over (partition by user_id order by ts, event_id) as after_id from events")
both("win_qualify", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2")
both(
    "win_range_interval",
    "select event_id, count(*) over (partition by user_id order by ts range between interval '1' hour preceding and current row) as n_hour from events",
)
both("order_nulls_first", "select o_orderkey, case when o_orderstatus = 'P' then null else o_orderstatus end as status from orders order by status nulls first, o_orderkey limit 50")
both("order_nulls_default", "select o_orderkey, case when o_orderstatus = 'O' then null else o_orderstatus end as status from orders order by status, o_orderkey limit 50")
both("limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
both("topk_group", "select c_mktsegment, c_custkey, c_acctbal from (select c_mktsegment, c_custkey, c_acctbal, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rn from customer) x where rn <= 5")
both("union_all_sizes", "select 'customer' as t, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'lineitem', count(*) from lineitem")
both("union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
both("intersect_keys", "select l_partkey as k from lineitem where l_quantity > 40 intersect select l_partkey from lineitem where l_quantity < 5")
both("except_all", "select l_suppkey as k from lineitem where l_quantity > 20 except all select l_suppkey from lineitem where l_quantity <= 20")
both("cte", "with big as (select o_custkey, sum(o_totalprice) as t from orders group by o_custkey), top as (select * from big where t > 500000) select count(*) as n, round(max(t), 2) as m from top")
both("recursive_cte", "with recursive r as (select 1 as n union all select n + 1 from r where n < 60) select count(*) as n, cast(sum(n) as bigint) as s from r")
both("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)")
both("case_expr", "select case when c_acctbal < 0 then 'debt' when c_acctbal < 5000 then 'low' else 'high' end as band, count(*) as n from customer group by 1")
both("coalesce_nullif", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') as s from orders")
both("string_funcs", "select p_partkey, upper(p_name) as u, substring(p_type, 1, 5) as s, length(trim(p_brand)) as n, replace(p_type, ' ', '_') as r from part")
both("date_extract", "select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, count(*) as n from orders group by 1, 2")
both("cast_double_colon", "select l_orderkey, cast(l_quantity as int) as q, l_linenumber::string as ln from lineitem", "select l_orderkey, cast(l_quantity as int) as q, l_linenumber::varchar as ln from lineitem")
both("quoted_names", 'select o_orderstatus as "the status", count(*) as "n" from orders group by 1')
both("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")


@query("select event_id, json_extract_string(props, '$.k') as k, event_type from events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


def _q1(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 1).alias("sum_disc"), F.round(F.sum(price * (1 + F.col("l_tax"))), 1).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"),
    )


QUERIES["pricing_summary"] = _q1
SQL["pricing_summary"] = "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 1) sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) sum_charge, round(avg(l_quantity), 6) avg_qty, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"


@query("select r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 1) as revenue, count(distinct o.o_custkey) as n_customers from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by r.r_name")
def revenue_by_region(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))  # noqa: E741
    # revenue is summed per order before the joins, so one row per order is shuffled
    o = t("orders").select("o_orderkey", "o_custkey").join(l.groupBy("l_orderkey").agg(F.sum("price").alias("price")), F.col("o_orderkey") == F.col("l_orderkey"))
    joined = o.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.round(F.sum("price"), 1).alias("revenue"), F.countDistinct("o_custkey").alias("n_customers"))


_ASOF_DUCK = "select e.event_id, p.event_id as last_id from (select * from events where event_id % 2 = 0) e asof left join (select user_id, ts, max(event_id) as event_id from events where event_id % 2 = 1 group by user_id, ts) p on e.user_id = p.user_id and e.ts >= p.ts"


@query(_ASOF_DUCK)
def join_asof_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    e.where("event_id % 2 = 0").createOrReplaceTempView("even_events")
    e.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id")).createOrReplaceTempView("odd_events")
    return shim.run(spark, "select e.event_id, p.event_id as last_id from even_events e asof left join odd_events p on e.user_id = p.user_id and e.ts >= p.ts")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, sf_dir):
    from dumpquarry.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").select(F.col("start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), t as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from s) select user_id, min(ts) as start, count(*) as n from t group by user_id, sid"
)
def stream_session(spark, sf_dir):
    from dumpquarry.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", "start", "n")


@query("select o_orderkey, o_custkey, o_totalprice, n from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn, count(*) over (partition by o_custkey) as n from orders) x where rn = 1")
def latest_per_key(spark, sf_dir):
    # max of a struct instead of a window: partial aggregation, so no sort and one row per key and task is shuffled
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"), F.count("*").alias("n")).select("x.o_orderkey", "o_custkey", "x.o_totalprice", "n")


@query("select l_returnflag, l_linestatus, n from (select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2) x")
def pivot_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return wide.unpivot(["l_returnflag"], ["F", "O"], "l_linestatus", "n").where("n is not null")

