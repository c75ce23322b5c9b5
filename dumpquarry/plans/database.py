"""Queries of the database tools over the star schema: dumps, samples, shards, checks, differences, redaction, profiles, generation."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dumpquarry import ddl
from dumpquarry.catalog import Catalog, ColumnDef, ForeignKey, TableDef
from dumpquarry.functions import draws, lexicon, redaction
from dumpquarry.generate import engine, planners
from dumpquarry.generate.generators import GENERATORS, Context, KeyDomain, make_unique
from dumpquarry.operators import convert, diff, redact, sample, shard, statements, validate
from dumpquarry.plans.relational import table
from dumpquarry.profile import infer, sketches
from dumpquarry.session import staging_path
from dumpquarry.sinks import sqlwriter
from dumpquarry.sources.dump import Dump, read_dump
from dumpquarry.sources.files import local

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_STAR = {
    "region": (("r_regionkey",), "r_regionkey int, r_name varchar(25)", ()),
    "nation": (("n_nationkey",), "n_nationkey int, n_name varchar(25), n_regionkey int", (("n_regionkey", "region", "r_regionkey"),)),
    "customer": (("c_custkey",), "c_custkey bigint, c_name varchar(25), c_nationkey int, c_acctbal double, c_mktsegment varchar(10)", (("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": (("s_suppkey",), "s_suppkey bigint, s_name varchar(25), s_nationkey int, s_acctbal double", (("s_nationkey", "nation", "n_nationkey"),)),
    "part": (("p_partkey",), "p_partkey bigint, p_name varchar(55), p_brand varchar(10), p_type varchar(25), p_size int, p_retailprice double", ()),
    "orders": (("o_orderkey",), "o_orderkey bigint, o_custkey bigint, o_orderstatus char(1), o_totalprice double, o_orderdate timestamp, o_orderpriority varchar(15)", (("o_custkey", "customer", "c_custkey"),)),
    "lineitem": (("l_orderkey", "l_linenumber"), "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag char(1), l_linestatus char(1), l_shipdate timestamp", (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"))),
    "events": (("event_id",), "event_id bigint, ts timestamp, user_id bigint, event_type varchar(20), value double, props json", (("user_id", "customer", "c_custkey"),)),
}
STAR = Catalog(
    TableDef(n, [ColumnDef(*c.strip().split(" ", 1), nullable=False) for c in columns.split(", ")], key, [ForeignKey((c,), p, (k,)) for c, p, k in fks])
    for n, (key, columns, fks) in _STAR.items()
)


def star(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names or STAR.names()}


def dump_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, which driver and executors reach as files."""
    path = Path(local(staging_path(spark, name)))
    path.parent.mkdir(parents=True, exist_ok=True)
    return str(path)


# --- dumps


def _roundtrip(dialect: str, copy: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = sqlwriter.write_dump(star(spark, sf_dir, "orders"), dump_path(spark, f"{dialect}.sql"), dialect, STAR, copy=copy)
        return read_dump(spark, path, dialect).table("orders")

    return run


for _name, _dialect, _copy in (("mysql", "mysql", False), ("postgres_insert", "postgres", False), ("postgres_copy", "postgres", True), ("sqlite", "sqlite", False), ("mssql", "mssql", False)):
    QUERIES[f"dump_roundtrip_{_name}_orders"] = _roundtrip(_dialect, _copy)
    SQL[f"dump_roundtrip_{_name}_orders"] = "select * from orders"


def _dump(spark: SparkSession, sf_dir: str, *names: str, dialect: str = "mysql", split_bytes: int = 1 << 20) -> Dump:
    return read_dump(spark, sqlwriter.write_dump(star(spark, sf_dir, *names), dump_path(spark, "dump.sql"), dialect, STAR), dialect, split_bytes)


@query("select * from customer")
def dump_roundtrip_gzip_customer(spark, sf_dir):
    import gzip
    import shutil

    path = sqlwriter.write_dump(star(spark, sf_dir, "customer"), dump_path(spark, "c.sql"), "mysql", STAR)
    with open(path, "rb") as a, gzip.open(path + ".gz", "wb") as b:
        shutil.copyfileobj(a, b)
    return read_dump(spark, path + ".gz").table("customer")


@query("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by 1")
def dump_query(spark, sf_dir):
    return _dump(spark, sf_dir, "customer", "orders").query("select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from customer join orders on c_custkey = o_custkey group by 1")


@query("select * from supplier")
def dump_cached(spark, sf_dir):
    return _dump(spark, sf_dir, "supplier", "nation").cached()["supplier"]


@query("select 'customer' as table_name, 1 as n_create, (select count(*) from customer) as n_rows union all select 'nation', 1, (select count(*) from nation) union all select 'orders', 1, (select count(*) from orders)")
def analyze_dump(spark, sf_dir):
    return statements.analyze(_dump(spark, sf_dir, "nation", "customer", "orders")).select("table_name", "n_create", "n_rows")


@query("select * from (values ('create_table', 'customer'), ('create_table', 'nation')) t(kind, table_name)")
def split_schema_only(spark, sf_dir):
    return statements.content(_dump(spark, sf_dir, "nation", "customer").statements(), "schema").select("kind", "table_name")


@query("select 'nation' as table_name, (select count(*) from nation) as n union all select 'customer', (select count(*) from customer)")
def split_tables(spark, sf_dir):
    d = _dump(spark, sf_dir, "nation", "customer", "region")
    folder = statements.split(d, dump_path(spark, "split"), exclude=["reg*"])
    from functools import reduce

    parts = []
    for t in ("nation", "customer"):
        files = sorted(str(p) for p in Path(folder, f"table={t}").glob("part-*"))
        parts.append(read_dump(spark, files, "mysql").table(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


@query("select 0 as pos, 'part' as table_name union all select 1, 'region' union all select 2, 'nation' union all select 3, 'customer' union all select 4, 'supplier' union all select 5, 'events' union all select 6, 'orders' union all select 7, 'lineitem'")
def order_tables(spark, sf_dir):
    return spark.createDataFrame([(i, t) for i, t in enumerate(statements.order(STAR))], "pos int, table_name string")


@query("select * from nation")
def merge_tables(spark, sf_dir):
    a, b = _dump(spark, sf_dir, "region"), _dump(spark, sf_dir, "nation")
    return read_dump(spark, statements.merge([a, b], dump_path(spark, "merged.sql"), "mysql"), "mysql").table("nation")


def _runs(dump: Dump) -> DataFrame:
    """What follows what in a dump: pos, table_name, kind, n_rows of each table's DDL and data, and whether nothing else stands between its statements."""
    at = dump.statements(text=False).withColumn("at", F.monotonically_increasing_id()).where("table_name is not null")
    at = at.withColumn("rank", F.row_number().over(Window.orderBy("at")))  # one row per statement of some thousand rows
    per = at.groupBy("table_name", "kind").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n"), F.sum("n_rows").alias("n_rows"))
    return per.select((F.row_number().over(Window.orderBy("lo")) - 1).alias("pos"), "table_name", "kind", "n_rows", (F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("unbroken"))


_ORDERED = " union all ".join(
    f"select {2 * i} as pos, '{t}' as table_name, 'create_table' as kind, 0::bigint as n_rows, true as unbroken union all select {2 * i + 1}, '{t}', 'insert', (select count(*) from {t}), true" for i, t in enumerate(("nation", "customer", "orders", "supplier"))
)


@query(_ORDERED)
def merge_ordered(spark, sf_dir):
    """The merged dump of one that is read in many splits and of a second holds the statements in their order."""
    a, b = _dump(spark, sf_dir, "nation", "customer", "orders", split_bytes=100_000), _dump(spark, sf_dir, "supplier")
    return _runs(read_dump(spark, statements.merge([a, b], dump_path(spark, "merged.sql"), "mysql"), "mysql", 100_000))


@query(" union all ".join(f"select '{t}' as table_name, 'create_table' as first_kind, min({k}) as first_key, count(*) as n_rows, 0::bigint as n_back from {t}" for t, k in (("customer", "c_custkey"), ("orders", "o_orderkey"))))
def split_ordered(spark, sf_dir):
    """Of each table's files, in the order of their names: the first statement, the first key, the rows, and how often a key is not above the one before (the tables are written in the order of their keys)."""
    tables = star(spark, sf_dir, "customer", "orders")
    path = sqlwriter.write_dump({n: df.orderBy(STAR.get(n).primary_key[0]) for n, df in tables.items()}, dump_path(spark, "dump.sql"), "mysql", STAR)
    folder = statements.split(read_dump(spark, path, "mysql", 100_000), dump_path(spark, "split"))
    parts = []
    for t in tables:
        key = STAR.get(t).primary_key[0]
        d = read_dump(spark, sorted(str(p) for p in Path(folder, f"table={t}").glob("part-*")), "mysql")
        rows = d.table(t, [key]).select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("at"))
        back = rows.select("k", F.lag("k").over(Window.orderBy("at")).alias("before"))
        first = d.statements(text=False).withColumn("at", F.monotonically_increasing_id()).agg(F.min_by("kind", "at").alias("first_kind"))
        counted = back.agg(F.first("k").alias("first_key"), F.count("*").alias("n_rows"), F.count_if(F.col("before") >= F.col("k")).alias("n_back"))
        parts.append(first.crossJoin(counted).select(F.lit(t).alias("table_name"), "*"))
    return parts[0].unionByName(parts[1])


@query("select 'insert' as kind, (select count(*) from orders) as n_rows, count(*) as n_tables from (values ('nation'), ('customer'), ('orders')) t(x)")
def split_pruned(spark, sf_dir):
    """A table is read from the splits that hold it: all its rows, though fewer splits than the dump has."""
    d = _dump(spark, sf_dir, "nation", "customer", "orders", split_bytes=100_000)
    assert len(d.splits_of("customer")) < len(d.splits)
    return d.table("orders", ["o_orderkey"]).agg(F.lit("insert").alias("kind"), F.count("*").alias("n_rows"), F.lit(len(d.catalog.names())).cast("long").alias("n_tables"))


@query("select *, true as from_cache from supplier")
def dump_cache_hit(spark, sf_dir):
    """The second reading finds the first one's tables; a half-written folder is not taken for a table."""
    d = _dump(spark, sf_dir, "supplier")
    folder = dump_path(spark, "cache")
    Path(folder, d.key(), "supplier", "_temporary").mkdir(parents=True)
    d.cached("file://" + folder)
    stamp = Path(folder, d.key(), "supplier", "_SUCCESS").stat().st_mtime_ns
    again = read_dump(spark, d.paths, "mysql").cached("file://" + folder)["supplier"]
    return again.withColumn("from_cache", F.lit(Path(folder, d.key(), "supplier", "_SUCCESS").stat().st_mtime_ns == stamp))


@query("select 'made' as column_name, count(*) as n, '2024-02-30' as example from orders where o_orderkey % 7 = 0")
def dump_misfits(spark, sf_dir):
    """Values that do not fit the type of their column are told, with their number."""
    odd = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 == 0, "2024-02-30").otherwise("2024-02-29").alias("made"))
    catalog = ddl.build_catalog(["CREATE TABLE t (id bigint PRIMARY KEY, made date)"])
    path = sqlwriter.write_dump({"t": odd}, dump_path(spark, "odd.sql"), "mysql", catalog, ddl=False)
    with open(path, "a", encoding="utf-8") as f:
        f.write("CREATE TABLE t (id bigint PRIMARY KEY, made date);\n")
    return read_dump(spark, path, "mysql").misfits("t")


@query("select * from (values ('insert', 'nation'), ('insert', 'region')) t(kind, table_name)")
def content_filter(spark, sf_dir):
    return statements.content(_dump(spark, sf_dir, "region", "nation").statements(), "data").select("kind", "table_name").distinct()


@query("select * from (values ('nation'), ('region')) t(table_name)")
def glob_tables(spark, sf_dir):
    return statements.tables_like(_dump(spark, sf_dir, "region", "nation", "supplier").statements(), ["*ion"]).select("table_name").distinct()


# --- samples


def _u(name: str, key: str) -> str:
    return draws.uniform_sql("'42'", f"'{name}'", f"{key}::varchar")


_MD5 = "md5(concat_ws(':', '42', '{0}', {1}::varchar))"


def _sampled(spark, sf_dir, names, **config):
    catalog = Catalog(t for t in STAR if t.name in names)
    return sample.sample(star(spark, sf_dir, *names), catalog, sample.SampleConfig(**config))


@query(f"select * from orders where {_u('orders', 'o_orderkey')} < 0.1")
def sample_percent_orders(spark, sf_dir):
    return _sampled(spark, sf_dir, ["orders"], percent=10).tables["orders"]


@query(f"select * from orders order by {_MD5.format('orders', 'o_orderkey')} limit 200")
def sample_rows_orders(spark, sf_dir):
    return _sampled(spark, sf_dir, ["orders"], rows=200).tables["orders"]


_CHAIN = f"with c as (select * from customer where {_u('customer', 'c_custkey')} < 0.5), o as (select * from orders where o_custkey in (select c_custkey from c) and {_u('orders', 'o_orderkey')} < 0.5) "
_LINE_KEY = "concat_ws('|', l_orderkey::varchar, l_linenumber::varchar)"


@query(_CHAIN + f"select * from lineitem where l_orderkey in (select o_orderkey from o) and {_u('lineitem', _LINE_KEY)} < 0.5")
def sample_fk_chain(spark, sf_dir):
    return _sampled(spark, sf_dir, ["customer", "orders", "lineitem"], percent=50).tables["lineitem"]


@query(
    f"with c as (select * from customer order by {_MD5.format('customer', 'c_custkey')} limit 300), e as (select * from events where user_id in (select c_custkey from c) order by {_MD5.format('events', 'event_id')} limit 100) select 'customer' as table_name, count(*) as n from c union all select 'events', count(*) from e"
)
def sample_max_total_rows(spark, sf_dir):
    r = _sampled(spark, sf_dir, ["customer", "events"], rows=300, max_total_rows=400)
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in r.tables.items()])


@query(f"select * from nation where n_regionkey in (select r_regionkey from region where {_u('region', 'r_regionkey')} < 0.5)")
def sample_lookup_full(spark, sf_dir):
    return _sampled(spark, sf_dir, ["region", "nation"], percent=50, tables={"nation": {"class": "lookup"}}).tables["nation"]


# --- shards


def _sharded(spark, sf_dir, strict=False):
    names = ["customer", "orders", "lineitem", "nation", "part"]
    catalog = Catalog(t for t in STAR if t.name in names)
    return shard.shard(star(spark, sf_dir, *names), catalog, shard.ShardConfig(7, "c_nationkey", roots=("customer",), strict=strict))


@query("select * from customer where c_nationkey = 7")
def shard_tenant_root(spark, sf_dir):
    return _sharded(spark, sf_dir).tables["customer"]


@query("select * from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7))")
def shard_dependent_any_fk(spark, sf_dir):
    return _sharded(spark, sf_dir).tables["lineitem"]


@query("with c as (select * from customer where c_nationkey = 7), o as (select * from orders where o_custkey in (select c_custkey from c)) select 'customer' as table_name, (select count(*) from c) as n union all select 'orders', (select count(*) from o) union all select 'lineitem', (select count(*) from lineitem where l_orderkey in (select o_orderkey from o))")
def shard_counts(spark, sf_dir):
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, df in _sharded(spark, sf_dir, strict=True).tables.items()])


@query("select count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 10 <> 0)")
def shard_strict_orphans(spark, sf_dir):
    t = star(spark, sf_dir, "lineitem", "orders")
    return sample.orphans(t["lineitem"], t["orders"].where("o_orderkey % 10 <> 0"), ("l_orderkey",), ("o_orderkey",)).agg(F.count("*").alias("n"))


# --- checks


def _with_orphans(spark, sf_dir):
    t = star(spark, sf_dir)
    t["orders"] = t["orders"].where("o_orderkey % 10 <> 0")
    return t


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def validate_dup_pk(spark, sf_dir):
    return validate.duplicate_keys(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


@query("select l_orderkey::varchar as key_text, count(*) as n from lineitem where l_orderkey % 10 = 0 group by 1")
def validate_fk_missing(spark, sf_dir):
    return validate.issues(_with_orphans(spark, sf_dir), STAR).where("code = 'FK_MISSING_PARENT'").select("key_text", "n")


@query(
    "select 'DUPLICATE_PK' as code, 'lineitem' as table_name, count(*) as n_issues, sum(n)::bigint as n_rows from (select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1) x union all select 'FK_MISSING_PARENT', 'lineitem', count(distinct l_orderkey), count(*) from lineitem where l_orderkey % 10 = 0"
)
def validate_summary(spark, sf_dir):
    return validate.summary(validate.issues(_with_orphans(spark, sf_dir), STAR))


@query("select 'nowhere' as table_name, 1 as n")
def validate_missing_table(spark, sf_dir):
    path = sqlwriter.write_dump(star(spark, sf_dir, "region"), dump_path(spark, "m.sql"), "mysql", STAR)
    with open(path, "a", encoding="utf-8") as f:
        f.write("INSERT INTO `nowhere` VALUES (1);\n")
    return validate.missing_tables(read_dump(spark, path, "mysql").statements())


@query("select 'text' as column_name, count(*) as n from documents where contains(text, chr(65533))")
def validate_utf8(spark, sf_dir):
    return validate.invalid_utf8(table(spark, sf_dir, "documents").select("text", "source"))


@query("select count(*) as n from orders where o_custkey not in (select c_custkey from customer)")
def fk_coverage_orders(spark, sf_dir):
    t = star(spark, sf_dir, "orders", "customer")
    return sample.orphans(t["orders"], t["customer"], ("o_custkey",), ("c_custkey",)).agg(F.count("*").alias("n"))


# --- differences

_NEW = "with n as (select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 11 <> 0 union all select o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 13 = 0) "


def _versions(spark, sf_dir):
    old = table(spark, sf_dir, "orders")
    changed = old.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end"))
    return old, changed.unionByName(old.where("o_orderkey % 13 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))


def _changes(spark, sf_dir, **more):
    old, new = _versions(spark, sf_dir)
    return diff.row_changes(old, new, more.pop("key", ["o_orderkey"]), table="orders", **more)


@query(_NEW + "select o_orderkey from n where o_orderkey not in (select o_orderkey from orders)")
def diff_added(spark, sf_dir):
    return _changes(spark, sf_dir).where("change = 'added'").select("o_orderkey")


@query(_NEW + "select o_orderkey from orders where o_orderkey not in (select o_orderkey from n)")
def diff_removed(spark, sf_dir):
    return _changes(spark, sf_dir).where("change = 'removed'").select("o_orderkey")


@query(_NEW + "select o.o_orderkey from orders o join n on o.o_orderkey = n.o_orderkey where n.o_orderstatus <> o.o_orderstatus")
def diff_modified(spark, sf_dir):
    return _changes(spark, sf_dir).where("change = 'modified'").select("o_orderkey")


@query(_NEW + "select count(*) filter (where o.o_orderkey is null) as added, count(*) filter (where n.o_orderkey is null) as removed, count(*) filter (where n.o_orderstatus is distinct from o.o_orderstatus and n.o_orderkey is not null and o.o_orderkey is not null) as modified from orders o full join n on o.o_orderkey = n.o_orderkey")
def diff_summary(spark, sf_dir):
    return _changes(spark, sf_dir).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")])


@query(_NEW + "select 'added' as change, count(*) as n from n where o_orderkey not in (select o_orderkey from orders) union all select 'removed', count(*) from orders where o_orderkey not in (select o_orderkey from n)")
def diff_ignore_columns(spark, sf_dir):
    return _changes(spark, sf_dir, ignore=["*.o_orderstatus"]).groupBy("change").agg(F.count("*").alias("n"))


@query("select o_custkey, 'modified' as change from (select o_custkey, max(o_orderkey) k from orders group by 1) where o_custkey % 2 = 0")
def diff_pk_override(spark, sf_dir):
    one = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    return diff.row_changes(one, one.withColumn("k", F.expr("case when o_custkey % 2 = 0 then -k else k end")), ["o_custkey"])


@query(_NEW + "select 'added' as change, count(*) as n from (select * from n except select * from orders) union all select 'removed', count(*) from (select * from orders except select * from n)")
def diff_no_pk(spark, sf_dir):
    return _changes(spark, sf_dir, key=[]).groupBy("change").agg(F.count("*").alias("n"))


_OLD_DDL = ("CREATE TABLE a (id int PRIMARY KEY, x varchar(5), gone int)", "CREATE TABLE dropped (id int)")
_NEW_DDL = ("CREATE TABLE a (id int PRIMARY KEY, x bigint, y date NOT NULL)", "CREATE TABLE made (id int)")


@query("select * from (values ('a', 'modified', 'column gone removed'), ('a', 'modified', 'column x type varchar(5) -> bigint'), ('a', 'modified', 'column y added date'), ('dropped', 'removed', null), ('made', 'added', 'column id int')) t(table_name, change, detail)")
def diff_schema(spark, sf_dir):
    found = diff.schema_diff(ddl.build_catalog(_OLD_DDL), ddl.build_catalog(_NEW_DDL))
    return spark.createDataFrame([(c.table, c.change, d) for c in found for d in (c.details or [None])], "table_name string, change string, detail string")


# --- redaction


def _redacted(spark, sf_dir, *rules, name="customer"):
    return redact.redact(table(spark, sf_dir, name), name, [redact.Rule(*r) if isinstance(r, tuple) else r for r in rules], STAR.get(name).primary_key)


@query("select c_custkey, substr(sha256(c_name), 1, 16) as c_name from customer")
def redact_hash(spark, sf_dir):
    return _redacted(spark, sf_dir, ("customer.c_name", "hash")).select("c_custkey", "c_name")


@query("select id, substr(sha256(regexp_extract(email, '^(.*)@', 1)), 1, 8) || '@' || regexp_extract(email, '@([^@]*)$', 1) as email from users where email like '%_@%' and email not like '%' || chr(10) || '%'")
def redact_hash_domain(spark, sf_dir):
    u = table(spark, sf_dir, "users").where(r"email like '%_@%' and email not like concat('%', char(10), '%')")
    return redact.redact(u, "users", [redact.Rule("users.email", "hash", preserve_domain=True)], ["id"]).select("id", "email")


@query("select id, case when strpos(email, '@') = 0 then substr(sha256(email), 1, 16) else substr(sha256(regexp_extract(email, '^(.*)@', 1, 's')), 1, 8) || '@' || regexp_extract(email, '@([^@]*)$', 1, 's') end as email from users")
def redact_hash_domain_whole(spark, sf_dir):
    return redact.redact(table(spark, sf_dir, "users"), "users", [redact.Rule("users.email", "hash", preserve_domain=True)], ["id"]).select("id", "email")


@query("select c_custkey, '***-' || substr(c_name, 4, 1) || substr(c_name, 5, 1) as c_name from (select c_custkey, replace(c_name, '-', '_') as c_name from customer)")
def redact_mask(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", redaction.masked(F.translate("c_name", "-", "_"), "***-XX", 42, "customer").alias("c_name"))


@query("select c_custkey, 'none' as c_mktsegment from customer")
def redact_constant(spark, sf_dir):
    return _redacted(spark, sf_dir, ("*.c_mkt*", "constant", "none")).select("c_custkey", "c_mktsegment")


@query("select c_custkey, null::double as c_acctbal from customer")
def redact_null(spark, sf_dir):
    return _redacted(spark, sf_dir, ("c_acctbal", "null")).select("c_custkey", "c_acctbal")


def _pick_sql(words: list, *parts: str) -> str:
    return f"([{', '.join(repr(w) for w in words)}])[{draws.integer_sql(1, len(words), *parts)}]"


@query(f"select c_custkey, {_pick_sql(lexicon.WORDS['first'], repr('42'), repr('customer'), repr('c_name'), 'c_custkey::varchar', repr('first'))} || ' ' || {_pick_sql(lexicon.WORDS['last'], repr('42'), repr('customer'), repr('c_name'), 'c_custkey::varchar', repr('last'))} as c_name from customer")
def redact_fake_name(spark, sf_dir):
    return _redacted(spark, sf_dir, ("customer.c_name", "fake", "name")).select("c_custkey", "c_name")


@query("select c_mktsegment, count(*) as n from customer group by 1")
def redact_shuffle(spark, sf_dir):
    return _redacted(spark, sf_dir, ("customer.c_mktsegment", "shuffle")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("select c_custkey, substr(sha256(c_name), 1, 16) as c_name, c_nationkey, null::double as c_acctbal, c_mktsegment from customer")
def redact_rules(spark, sf_dir):
    return _redacted(spark, sf_dir, ("customer.c_name", "hash"), ("customer.c_nationkey", "skip"), ("customer.c_n*", "null"), ("*.c_acctbal", "null"))


@query("select * from (values ('email', 'hash', 'high'), ('phone', 'fake', 'medium'), ('password', 'constant', 'high'), ('city', 'fake', 'medium')) t(column_name, strategy, confidence)")
def redact_detect(spark, sf_dir):
    found = redact.generate_config(ddl.build_catalog(["CREATE TABLE u (id int PRIMARY KEY, email text, phone text, password text, city text, note text)"]))
    return spark.createDataFrame([(f.column, f.rule.strategy, f.confidence) for f in found], "column_name string, strategy string, confidence string")


# --- profiles


@query("select 'email' as column_name, count(*) as n, count(*) filter (where email is null) as n_null from users union all select 'role', count(*), count(*) filter (where role is null) from users")
def profile_counts(spark, sf_dir):
    return sketches.profile(table(spark, sf_dir, "users"), ["email", "role"], "basic").select("column_name", "n", "n_null")


@query("select 'c_name' as column_name, min(length(c_name)) as min_length, max(length(c_name)) as max_length, round(avg(length(c_name)), 9) as avg_length, 0::bigint as n_digits from customer")
def profile_string_shape(spark, sf_dir):
    return sketches.profile(table(spark, sf_dir, "customer"), ["c_name"], "basic").select("column_name", "min_length", "max_length", F.round("avg_length", 9).alias("avg_length"), "n_digits")


@query("select 'o_totalprice' as column_name, min(o_totalprice) as min_number, max(o_totalprice) as max_number, round(avg(o_totalprice), 4) as mean, round(stddev(o_totalprice), 4) as stddev from orders")
def profile_numeric(spark, sf_dir):
    return sketches.profile(table(spark, sf_dir, "orders"), ["o_totalprice"], "basic").select("column_name", "min_number", "max_number", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


@query("select l_suppkey::varchar as value, count(*) as n from lineitem group by 1 order by n desc, value limit 32")
def profile_topk(spark, sf_dir):
    return sketches.top_values(table(spark, sf_dir, "lineitem"), "l_suppkey")


@query("select count(distinct o_custkey) as n_values, count(distinct o_custkey) filter (where o_custkey in (select c_custkey from customer where c_custkey % 3 <> 0)) as n_found from orders")
def profile_fk_coverage(spark, sf_dir):
    return sketches.fk_coverage(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "c_custkey").select("n_values", "n_found")


@query("select count(*) as n_pairs, round(avg((created_at <= updated_at)::int), 9) as share_ordered from users where created_at is not null and updated_at is not null")
def profile_temporal(spark, sf_dir):
    return sketches.temporal_order(table(spark, sf_dir, "users"), "created_at", "updated_at").select("n_pairs", F.round("share_ordered", 9).alias("share_ordered"))


@query(f"select user_id as value from events order by md5(concat_ws(':', '42', 'user_id', event_id::varchar)), value limit {sketches.RESERVOIR}")
def profile_reservoir(spark, sf_dir):
    return sketches.reservoir(table(spark, sf_dir, "events"), "user_id", F.col("event_id"))


@query()
def profile_hll(spark, sf_dir):
    return sketches.profile(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_orderkey"]).select("column_name", "n_distinct")


@query()
def profile_quantiles(spark, sf_dir):
    return sketches.profile(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]).select("column_name", "quantiles", "histogram", "top")


# --- generation: ranges of 1000 rows, or one row per order

_N = "(select range as i from range(1000))"


def _context(name: str = "t", column: str = "c", domains: dict | None = None) -> Context:
    return Context(42, name, column, F.col("i"), {k: v if isinstance(v, KeyDomain) else KeyDomain(v) for k, v in (domains or {}).items()})


def _rows(spark: SparkSession, n: int = 1000) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "i")


def _u_sql(column: str, *more: str) -> str:
    return draws.uniform_sql("'42'", "'t'", f"'{column}'", *[f"'{m}'" for m in more], "i::varchar")


def _int_sql(low: int, high: int, column: str, *more: str) -> str:
    return draws.integer_sql(low, high, "'42'", "'t'", f"'{column}'", *[f"'{m}'" for m in more], "i::varchar")


def _gen(name: str, sql: str, kind: str, **args):
    domains = args.pop("domains", None)
    QUERIES[name] = lambda spark, sf_dir: _rows(spark).select("i", GENERATORS[kind](_context(domains=domains), **args).alias("v"))
    SQL[name] = f"select i, {sql} as v from {_N}"


_gen("gen_sequence", "i * 3 + 10", "sequence", start=10, step=3)
_gen("gen_integer", _int_sql(5, 99, "c"), "integer", low=5, high=99)
_gen("gen_decimal", f"({_int_sql(100, 100000, 'c')} / 100.0)::decimal(20,2)", "decimal", low=1, high=1000, scale=2)
_gen("gen_boolean", f"{_u_sql('c')} < 0.25", "boolean", probability=0.25)
_gen("gen_choice", f"(['a', 'b', 'c'])[{_int_sql(1, 3, 'c')}]", "choice", values=["a", "b", "c"])
_gen("gen_weighted", f"case when {_u_sql('c')} < 0.5 then 'x' when {_u_sql('c')} < 0.75 then 'y' else 'z' end", "weighted_choice", values=["x", "y", "z"], weights=[2, 1, 1])
_DIGEST = "md5(concat_ws(':', '42', 't', 'c', i::varchar, 'uuid'))"
_gen("gen_uuid", f"substr({_DIGEST}, 1, 8) || '-' || substr({_DIGEST}, 9, 4) || '-4' || substr({_DIGEST}, 14, 3) || '-' || substr('89ab', ('0x' || substr({_DIGEST}, 17, 1))::int % 4 + 1, 1) || substr({_DIGEST}, 18, 3) || '-' || substr({_DIGEST}, 21, 12)", "uuid")
_gen("gen_fk_uniform", f"floor({_u_sql('c')} * 50)::bigint * 2 + 100", "relation.foreign_key", parent="p", domains={"p": KeyDomain(50, 100, 2)})
_gen("gen_fk_sequential", "(i % 50) * 2 + 100", "relation.foreign_key", parent="p", distribution="sequential", domains={"p": KeyDomain(50, 100, 2)})
_gen("gen_date", f"(date '2020-01-01' + {_int_sql(0, 99, 'c')}::int)::date", "date", days=100)
_gen("gen_datetime", f"timestamp '2020-01-01' + to_seconds({_int_sql(0, 8639999, 'c')})", "datetime", days=100)
_gen("gen_pattern", f"'A' || (('0x' || substr(md5(concat_ws(':', '42', 't', 'c', 'p', '1', i::varchar)), 1, 8))::bigint % 10)::varchar || '-' || (('0x' || substr(md5(concat_ws(':', '42', 't', 'c', 'p', '3', i::varchar)), 1, 8))::bigint % 10)::varchar", "pattern", pattern="A#-#")
_gen("gen_normal", f"round(10 + 2 * sqrt(-2 * ln(1 - {_u_sql('c', 'a')})) * cos(2 * pi() * {_u_sql('c', 'b')}), 6)", "normal", mean=10, stddev=2)
_BASE_NORMAL = QUERIES["gen_normal"]
QUERIES["gen_normal"] = lambda spark, sf_dir: _BASE_NORMAL(spark, sf_dir).withColumn("v", F.round("v", 6))


@query(f"select i, case when {_u_sql('c', 'null')} >= 0.3 then i end as v from {_N}")
def gen_null_rate(spark, sf_dir):
    from dumpquarry.generate.generators import MODIFIERS

    return _rows(spark).select("i", MODIFIERS["null_rate"](_context(), F.col("i"), 0.3).alias("v"))


@query(f"select i, 'User ' || i::varchar || '!' as name, trim(regexp_replace(lower('User ' || i::varchar || '!'), '[^a-z0-9]+', '-', 'g'), '-') as slug from {_N}")
def gen_template_slug(spark, sf_dir):
    named = _rows(spark).withColumn("name", GENERATORS["template"](_context(), "User {row}!"))
    return named.select("i", "name", GENERATORS["slug"](_context(), "name").alias("slug"))


@query()
def gen_fk_weighted(spark, sf_dir):
    return _rows(spark).select("i", GENERATORS["relation.foreign_key"](_context(domains={"p": 5000}), "p", "weighted").alias("v"))


@query(f"select count(*) as n, count(distinct v) as n_distinct from (select case when rn > 1 then v || '-' || rn else v end as v from (select (['a', 'b', 'c'])[{_int_sql(1, 3, 'c')}] as v, row_number() over (partition by (['a', 'b', 'c'])[{_int_sql(1, 3, 'c')}] order by i) as rn from {_N}))")
def gen_unique(spark, sf_dir):
    df = _rows(spark).select("i", GENERATORS["choice"](_context(), ["a", "b", "c"]).alias("v"))
    return make_unique(df, "v", "i").agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_distinct"))


def _plan(spark, kind: str, domains: dict | None = None, **args) -> DataFrame:
    df = _rows(spark)
    for name, value in planners.PLANNERS[kind](_context(domains=domains), **args).items():
        df = df.withColumn(name, value)
    return df


@query("select 1000::bigint as n, 1000::bigint as n_pairs, 0::bigint as n_bad")
def gen_junction_pair(spark, sf_dir):
    df = _plan(spark, "relation.junction_pair", {"a": 40, "b": 60}, left="l", left_parent="a", right="r", right_parent="b")
    return df.agg(F.count("*").alias("n"), F.countDistinct("l", "r").alias("n_pairs"), F.count_if(~F.col("l").between(1, 40) | ~F.col("r").between(1, 60)).alias("n_bad"))


@query(f"select i, timestamp '2020-01-01' + to_seconds({_int_sql(0, 31535999, 'c', 'start')}) as a, timestamp '2020-01-01' + to_seconds({_int_sql(0, 31535999, 'c', 'start')} + {_int_sql(60, 86400, 'c', 'span')}) as b, {_int_sql(60, 86400, 'c', 'span')} as d from {_N}")
def gen_interval(spark, sf_dir):
    return _plan(spark, "temporal.interval", start="a", end="b", duration="d")


@query("select 0::bigint as n_bad")
def gen_timestamps(spark, sf_dir):
    return _plan(spark, "temporal.timestamps", created="a", updated="b").agg(F.count_if(F.col("b") < F.col("a")).alias("n_bad"))


@query(f"select count(*) filter (where {_u_sql('c', 'deleted')} < 0.1) as n_deleted, 0::bigint as n_bad from {_N}")
def gen_soft_delete(spark, sf_dir):
    df = _plan(spark, "temporal.soft_delete", deleted="d", flag="f")
    return df.agg(F.count_if("f").alias("n_deleted"), F.count_if(F.col("f") != F.col("d").isNotNull()).alias("n_bad"))


_STATES = [{"name": "new", "column": "a"}, {"name": "paid", "column": "b", "weight": 2}, {"name": "sent", "column": "s", "weight": 1}]


@query(f"select case when {_u_sql('c', 'end')} < 0.25 then 'new' when {_u_sql('c', 'end')} < 0.75 then 'paid' else 'sent' end as status, count(*) as n, 0::bigint as n_bad from {_N} group by 1")
def gen_lifecycle(spark, sf_dir):
    df = _plan(spark, "temporal.lifecycle", states=_STATES, status="status")
    bad = (F.col("a") >= F.col("b")) | (F.col("b") >= F.col("s")) | ((F.col("status") == "new") & F.col("b").isNotNull()) | ((F.col("status") == "sent") & F.col("s").isNull())
    return df.groupBy("status").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


@query("select 1000::bigint as n, 0::bigint as n_bad")
def gen_progress(spark, sf_dir):
    df = _plan(spark, "workflow.progress_counters", total="t", processed="p", pending="q", succeeded="s", failed="f", status="st")
    ok = F.expr("p + q = t and s + f = p and least(t, p, q, s, f) >= 0 and (st <> 'done' or p = t) and (st <> 'idle' or p = 0) and (st <> 'active' or p < t)")
    return df.agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_bad"))


@query("select count(*) as n_orders, 0::bigint as n_bad from orders")
def gen_order_family(spark, sf_dir):
    parents, lines = planners.order_family(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), 42)
    sums = lines.groupBy("id").agg(F.sum("line_subtotal").alias("a"), F.sum("line_discount").alias("b"), F.sum("line_tax").alias("c"))
    ok = F.expr("a = subtotal and b = discount_total and c = tax_total and grand_total = subtotal - discount_total + tax_total + shipping")
    return parents.join(sums, "id").agg(F.count("*").alias("n_orders"), F.count_if(~ok).alias("n_bad"))


@query(f"select (['a', 'b'])[{_int_sql(1, 2, 'c', 'type')}] as type, count(*) as n, 0::bigint as n_bad from {_N} group by 1")
def gen_polymorphic(spark, sf_dir):
    df = _plan(spark, "relation.polymorphic_pair", {"a": KeyDomain(10, 1), "b": KeyDomain(10, 1000)}, type="type", id="id", targets={"a": "a", "b": "b"})
    return df.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.expr("(type = 'a' and id not between 1 and 10) or (type = 'b' and id not between 1000 and 1009)")).alias("n_bad"))


@query(f"select floor(((i + 1) * 7 - 1) / 1000)::bigint + 1 as tenant, count(*) as n, 0::bigint as n_bad from {_N} group by 1")
def gen_tenant_family(spark, sf_dir):
    df = _plan(spark, "relation.tenant_family", {"t": 7, "p": 70}, tenant="tenant", tenants="t", rows=1000, parent="parent", parent_table="p")
    return df.groupBy("tenant").agg(F.count("*").alias("n"), F.count_if(F.floor((F.col("parent") - 1) / 10) + 1 != F.col("tenant")).alias("n_bad"))


@query(f"select i, ({_int_sql(40000000, 50000000, 'c', 'lat')} / 1000000.0)::decimal(9,6) as lat, ({_int_sql(-5000000, 15000000, 'c', 'lon')} / 1000000.0)::decimal(9,6) as lon from {_N}")
def gen_coordinates(spark, sf_dir):
    return _plan(spark, "geo.coordinate_pair", latitude="lat", longitude="lon", south=40, north=50, west=-5, east=15)


@query(f"select ([{', '.join(repr(w) for w in lexicon.WORDS['extension'])}])[{_int_sql(1, 8, 'c', 'kind')}] as ext, ([{', '.join(repr(w) for w in lexicon.WORDS['mime'])}])[{_int_sql(1, 8, 'c', 'kind')}] as mime, count(*) as n, 0::bigint as n_bad from {_N} group by 1, 2")
def gen_file_metadata(spark, sf_dir):
    df = _plan(spark, "file.metadata", name="name", extension="ext", mime="mime")
    return df.groupBy("ext", "mime").agg(F.count("*").alias("n"), F.count_if(~F.col("name").endswith(F.concat(F.lit("."), F.col("ext")))).alias("n_bad"))


@query("select 1000::bigint as n, 1::bigint as n_roots, 0::bigint as n_bad")
def gen_tree(spark, sf_dir):
    df = _plan(spark, "hierarchy.tree", {"t": 1000}, parent="parent", depth="depth", max_depth=6)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("parent").isNull()).alias("n_roots"), F.count_if((F.col("parent") > F.col("i")) | (F.col("depth") > 6)).alias("n_bad"))


_MODEL = {
    "tables": {
        "customers": {"rows": 200, "columns": {"id": {"kind": "sequence"}, "email": {"kind": "internet.email", "unique": True}, "city": {"kind": "address.city", "null_rate": 0.2}}},
        "purchases": {
            "rows": {"children_of": "customers", "mean": 3.0},
            "columns": {"id": {"kind": "sequence", "start": 1000}, "customer_id": {"kind": "relation.foreign_key", "parent": "customers"}, "created_at": {"kind": "datetime"}, "updated_at": {"kind": "datetime"}},
            "planners": [{"kind": "temporal.timestamps", "created": "created_at", "updated": "updated_at"}],
            "order_family": {"key": "id", "lines": "purchase_lines"},
        },
    }
}


@query("select * from (values ('customers', 'row_count'), ('customers', 'unique(id)'), ('customers', 'unique(email)'), ('purchases', 'row_count'), ('purchases', 'ordered'), ('purchases', 'unique(id)'), ('purchases', 'foreign_key(customer_id)'), ('purchases', 'sum(purchase_lines.line_subtotal) = subtotal')) t(table_name, check_name) cross join (select 'Exact' as status, 0::bigint as violations)")
def verify_report(spark, sf_dir):
    made = engine.generate(spark, _MODEL)
    checks = [engine.Check("purchases", "ordered", engine.predicate("ordering", "created_at", "updated_at"))]
    args = {"references": [("purchases", "customer_id", "customers", "id")], "families": [("purchases", "id", "subtotal", "purchase_lines", "line_subtotal")]}
    first = engine.verify(made.tables, checks, {"customers": ("id",), "purchases": ("id",)}, counts=made.counts, **args)
    return first.unionByName(engine.verify({"customers": made.tables["customers"]}, [], {"customers": ("email",)}))


@query("select 0::bigint as n_bad, count(*) as n from orders")
def verify_family_sums(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    per = o.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_orderkey").alias("total"))
    found = engine.verify({"c": per, "o": o.withColumnRenamed("o_custkey", "k")}, [], families=[("c", "k", "total", "o", "o_orderkey")])
    return found.agg(F.sum("violations").alias("n_bad")).crossJoin(o.agg(F.count("*").alias("n")))


@query("select 'lineitem' as table_name, 'discount in range' as check_name, 'Exact' as status, count(*) filter (where not l_discount between 0 and 0.05) as violations from lineitem union all select 'lineitem', 'quantity not negative', 'Exact', 0")
def verify_predicates(spark, sf_dir):
    checks = [engine.Check("lineitem", "discount in range", engine.predicate("in_range", "l_discount", low=0, high=0.05)), engine.Check("lineitem", "quantity not negative", engine.predicate("non_negative", "l_quantity"))]
    return engine.verify({"lineitem": table(spark, sf_dir, "lineitem")}, checks)


@query()
def infer_star_model(spark, sf_dir):
    profiles = {t.name: {r["column_name"]: r.asDict(recursive=True) for r in sketches.profile(table(spark, sf_dir, t.name)).collect()} for t in STAR}
    model = infer.infer_model(STAR, 500, profiles)
    return spark.createDataFrame([(t, c, s["kind"]) for t, m in model["tables"].items() for c, s in m["columns"].items()], "table_name string, column_name string, generator string")


# --- conversion and graphs

_TYPES = (("tinyint(1)", "mysql", "postgres"), ("int(11)", "mysql", "sqlite"), ("datetime", "mysql", "postgres"), ("serial", "postgres", "mysql"), ("bytea", "postgres", "mssql"), ("jsonb", "postgres", "mysql"), ("nvarchar(50)", "mssql", "postgres"), ("money", "mssql", "mysql"), ("uniqueidentifier", "mssql", "postgres"), ("text", "sqlite", "mssql"), ("enum('a')", "mysql", "postgres"), ("double precision", "postgres", "mysql"))


@query("select * from (values ('tinyint(1)', 'BOOLEAN'), ('int(11)', 'INTEGER'), ('datetime', 'TIMESTAMP'), ('serial', 'INT AUTO_INCREMENT'), ('bytea', 'VARBINARY(MAX)'), ('jsonb', 'JSON'), ('nvarchar(50)', 'VARCHAR(50)'), ('money', 'DECIMAL(19,4)'), ('uniqueidentifier', 'UUID'), ('text', 'NVARCHAR(MAX)'), ('enum(''a'')', 'VARCHAR(255)'), ('double precision', 'DOUBLE')) t(source_type, target_type)")
def convert_types_matrix(spark, sf_dir):
    return spark.createDataFrame([(t, convert.convert_type(t, a, b)[0]) for t, a, b in _TYPES], "source_type string, target_type string")


@query("select * from nation")
def convert_copy_to_insert(spark, sf_dir):
    path = sqlwriter.write_dump(star(spark, sf_dir, "nation"), dump_path(spark, "p.sql"), "postgres", STAR, copy=True)
    made = convert.convert(read_dump(spark, path, "postgres"), "mysql")
    return read_dump(spark, convert.convert_to_file(made, dump_path(spark, "converted.sql"), "mysql"), "mysql").table("nation")


@query("select * from (values ('nation', 'n_regionkey', 'region'), ('customer', 'c_nationkey', 'nation'), ('supplier', 's_nationkey', 'nation'), ('orders', 'o_custkey', 'customer'), ('lineitem', 'l_orderkey', 'orders'), ('lineitem', 'l_partkey', 'part'), ('lineitem', 'l_suppkey', 'supplier'), ('events', 'user_id', 'customer')) t(child, column_name, parent)")
def graph_edges(spark, sf_dir):
    return spark.createDataFrame([(c, ",".join(fk.columns), p) for c, fk, p in STAR.edges()], "child string, column_name string, parent string")


@query("with recursive e(c, p) as (values ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier')), r as (select p from e where c = 'lineitem' union select e.p from r join e on e.c = r.p) select p as ancestor from r")
def graph_ancestors(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in sorted(STAR.ancestors("lineitem"))], "ancestor string")


@query("select * from (values ('a,b'), ('d')) t(ring)")
def graph_cycles(spark, sf_dir):
    catalog = ddl.build_catalog(["CREATE TABLE a (id int PRIMARY KEY, b_id int REFERENCES b)", "CREATE TABLE b (id int PRIMARY KEY, a_id int REFERENCES a)", "CREATE TABLE c (id int, a_id int REFERENCES a)", "CREATE TABLE d (id int PRIMARY KEY, up int REFERENCES d)"])
    return spark.createDataFrame([(",".join(r),) for r in catalog.cycles()], "ring string")
