"""Queries p2 to p6 over the domain tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dumpquarry.operators import copydiff, hierarchy, parse_errors, quality, references

REFERENCES = (
    references.Reference("accounts", "tenant_id", "tenants", "opened_at"),
    references.Reference("accounts", "last_transaction_id", "payments", "opened_at"),
    references.Reference("posts", "author_id", "users", "created_at", deleted_field="deleted_at"),
    references.Reference("posts", "category_id", "categories", "created_at"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {r.table for r in REFERENCES} | {r.parent for r in REFERENCES}
    return references.orphan_references({n: table(spark, sf_dir, n) for n in names}, REFERENCES)


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_counts(p2_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy_faults(hierarchy.resolve(table(spark, sf_dir, "categories"), paths=False))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hierarchy.resolve(table(spark, sf_dir, "categories"))
    return df.select("id", "kind", "root_id", F.col("links").alias("n_links"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(table(spark, sf_dir, "categories")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors.rejected_rows(table(spark, sf_dir, "post_lines")).select("line_id", "reason").distinct()


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_errors.valid_rows(table(spark, sf_dir, "post_lines"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [quality.quality_cases("users", table(spark, sf_dir, "users"), quality.USER_DOMAINS), quality.quality_cases("posts", table(spark, sf_dir, "posts"), quality.POST_DOMAINS)]
    return reduce(DataFrame.unionByName, cases)


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, domains in (("users", quality.USER_DOMAINS), ("posts", quality.POST_DOMAINS)):
        rows = table(spark, sf_dir, name)
        tables = quality.CountTables(spark).apply(rows, [c for c in rows.columns if c != "load_id"], "load_id", domains)
        out.append(quality.profile(tables.log()).select(F.lit(name).alias("table_name"), "*"))
    return reduce(DataFrame.unionByName, out)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name in ("accounts", "tenants"):
        found = copydiff.copy_differences(table(spark, sf_dir, name), table(spark, sf_dir, f"{name}_replica"), "id")
        out.append(found.select(F.lit(name).alias("table_name"), "row_id", "difference"))
    return reduce(DataFrame.unionByName, out)


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p3_found, p3_paths, p3_descendants, p4_found, p4_rows, p5_found, p5_profile, p6_found)}


def _p2_sql() -> str:
    parts = []
    for r in REFERENCES:
        dead = f"min(p.{r.deleted_field})" if r.deleted_field else "null::timestamp"
        parts.append(f"""
        select '{r.table}' table_name, '{r.field}' field_name, c.id row_id, s.state ref_state, strftime(c.happened, '%Y-%m') year_month
        from (select id, {r.field} k, {r.period} happened, min(loaded_at) l from {r.table} where {r.field} is not null group by all) c
        left join (select p.id, min(p.loaded_at) l, {dead} d from {r.parent} p group by p.id) p on p.id = c.k
        cross join (values ('missing'), ('late'), ('deleted')) s(state)
        where (s.state = 'missing' and p.id is null) or (s.state = 'late' and p.l > c.l) or (s.state = 'deleted' and p.d < c.happened)""")
    return "select distinct * from (" + " union all ".join(parts) + ")"


_TREE = """
with recursive n as (select id, arg_max(parent_id, loaded_at) as parent_x, arg_max(depth, loaded_at) as depth_x from categories group by id),
links as (select c.id, (select parent_id from categories p where p.id = c.id limit 1) as up, any_value(c.depth) as depth from categories c group by c.id),
walk as (
  select id, id as node, up as nxt, 0 as links, [id] as path from links
  union all
  select w.id, l.id, l.up, w.links + 1, list_append(w.path, l.id) from walk w join links l on l.id = w.nxt where not list_contains(w.path, w.nxt)
),
last as (select w.id, w.node, w.nxt, w.links, w.path from walk w qualify row_number() over (partition by w.id order by w.links desc) = 1),
kinds as (
  select last.id, last.node, last.links, last.path, links.depth,
    case when nxt is null then 'root' when nxt not in (select id from links) then 'detached'
      when nxt = last.id then 'cycle' else 'below_cycle' end as kind
  from last join links on links.id = last.id
)
"""
_TREE = _TREE.replace("n as (select id, arg_max(parent_id, loaded_at) as parent_x, arg_max(depth, loaded_at) as depth_x from categories group by id),\n", "")
_FIELD = '("[^"]*(?:""[^"]*)*"|[^",]*)'
_VALUE = "case when {0} = '' then null when {0}[1] = '\"' then replace({0}[2:-2], '\"\"', '\"') else {0} end"
_POSTS = f"""
with a as (select line_id, raw_line,
    coalesce(regexp_full_match(raw_line, '(?:{_FIELD.replace("(", "(?:", 1)})(?:,{_FIELD.replace("(", "(?:", 1)})*'), false) as well,
    coalesce(regexp_full_match(raw_line, '{",".join([_FIELD.replace("(", "(?:", 1)] * 7)}'), false) as seven,
    regexp_extract(raw_line, '^{",".join([_FIELD] * 7)}$', ['a','b','c','d','e','f','g'], 's') as x from post_lines),
v as (select line_id, well, seven, {", ".join(_VALUE.format(f"x.{c}") + f" as {c}" for c in "abcdefg")} from a),
ok as (select *, coalesce(regexp_full_match(a, '[0-9]{{1,18}}'), false) and coalesce(regexp_full_match(b, '[0-9]{{1,18}}'), false) and coalesce(regexp_full_match(c, '[0-9]{{1,18}}'), true)
    and d is not null and not regexp_matches(d, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') and length(d) <= 200
    and e is not null and not regexp_matches(e, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')
    and coalesce(regexp_full_match(f, '[0-4](\\.[0-9]{{1,2}})?|5(\\.0{{1,2}})?'), true)
    and coalesce(regexp_full_match(g, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') and try_cast(g as timestamp) is not null and g[1:4] <> '0000' and g[12:13] <> '24', false) as fine from v)
"""


def _p5_sql() -> str:
    email = "regexp_full_match(email, '[a-z0-9._+-]+@[a-z0-9-]+(\\.[a-z0-9-]+)+')"
    checks = (
        ("users", "email", email),
        ("users", "role", "role in ('reader','author','editor','admin')"),
        ("users", "deleted_at", "deleted_at >= created_at and deleted_at < timestamp '2026-01-01'"),
        ("posts", "rating", "not isnan(rating) and rating >= 0 and rating <= 5"),
    )
    parts = []
    for t, c, ok in checks:
        parts.append(f"select '{t}' table_name, '{c}' column_name, 'value' kind, id key_id from {t} where {c} is not null and not ({ok})")
        more = ""
        if c == "rating":
            more = " or abs(m - lag(m) over w) > 0.5"
        parts.append(f"""select '{t}', '{c}', 'shift', load_id::bigint from (select load_id, coalesce(round(abs(s - lag(s) over w), 12) > 0.15 {more}, false) as hit from
            (select load_id, avg(({c} is null)::int) s, {"avg(rating) filter (" + ok + ")" if c == "rating" else "null::double"} m from {t} group by load_id) window w as (order by load_id)) where hit""")
    parts.append("""select 'users', 'role', 'shift', load_id::bigint from (
        with r as (select distinct role from users where role is not null), l as (select load_id, count(role) n, lag(count(role)) over (order by load_id) n0, lag(load_id) over (order by load_id) prev from users group by load_id),
        g as (select load_id, role, count(*) c from users where role is not null group by all)
        select l.load_id from l cross join r left join g a on a.load_id = l.load_id and a.role = r.role left join g b on b.load_id = l.prev and b.role = r.role
        where l.prev is not null and l.n > 0 and l.n0 > 0 and round(abs(coalesce(a.c, 0) / l.n - coalesce(b.c, 0) / l.n0), 12) > 0.25)""")
    return "select distinct * from (" + " union all ".join(parts) + ")"


def _p6_sql() -> str:
    parts = []
    for t, columns in (("accounts", "tenant_id iban currency minor_scale balance last_transaction_id opened_at"), ("tenants", "name slug plan hq_latitude hq_longitude settings created_at updated_at")):
        pair = f"(select distinct id, {columns.replace(' ', ', ')} from {t}) a full join (select distinct id, {columns.replace(' ', ', ')} from {t}_replica) b on a.id = b.id"
        parts.append(f"select '{t}' table_name, coalesce(a.id, b.id) row_id, case when b.id is null then 'only_primary' else 'only_replica' end difference from {pair} where a.id is null or b.id is null")
        parts += [f"select '{t}', a.id, '{c}' from {pair} where a.id is not null and b.id is not null and a.{c} is distinct from b.{c}" for c in columns.split()]
    return "select distinct * from (" + " union all ".join(parts) + ")"


SQL = {
    "p2_found": _p2_sql(),
    "p2_by_month": f"select table_name, field_name, ref_state, year_month, count(*) n from ({_p2_sql()}) group by all",
    "p3_found": _TREE + "select id, case when kind <> 'root' then kind else 'depth' end as kind from kinds where kind <> 'root' or depth is distinct from links",
    "p3_paths": _TREE + "select id, kind, case when kind = 'root' then node end as root_id, case when kind = 'root' then links::bigint end as n_links, case when kind = 'root' then array_to_string(list_reverse(path), '/') end as path from kinds",
    "p3_descendants": _TREE + "select ancestor_id, id as descendant_id, i as distance from (select id, unnest(path[2:]) as ancestor_id, unnest(range(1, len(path))) as i from kinds where kind = 'root')",
    "p4_found": _POSTS + "select line_id, case when not well then 'quoting' when not seven then 'columns' else 'value' end as reason from ok where not (well and seven and fine)",
    "p4_rows": _POSTS + "select line_id, a::bigint as id, b::bigint as author_id, c::bigint as category_id, d as title, e as body, f::double as rating, g::timestamp as created_at from ok where well and seven and fine",
    "p5_found": _p5_sql(),
    "p6_found": _p6_sql(),
}
