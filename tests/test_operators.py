"""Database tools: samples, shards, checks, differences, redaction, conversion, SQL, generation, streams, command line."""

import io
import json
import re

import pytest
from pyspark.sql import functions as F

from dumpquarry import cli, ddl
from dumpquarry.catalog import Catalog
from dumpquarry.functions import redaction
from dumpquarry.generate import engine, planners
from dumpquarry.generate.generators import GENERATORS, MODIFIERS, Context, KeyDomain, make_unique
from dumpquarry.operators import convert, diff, redact, sample, shard, statements, validate
from dumpquarry.plans import sql as shim
from dumpquarry.profile import infer, sketches
from dumpquarry.sinks import erd, formats, sqlwriter
from dumpquarry.sources.dump import read_dump
from dumpquarry.streaming import windows

SHOP = ddl.build_catalog([
    "CREATE TABLE tenants (id int PRIMARY KEY, name text)",
    "CREATE TABLE countries (code int PRIMARY KEY, tenant_hint int)",
    "CREATE TABLE users (id int PRIMARY KEY, tenant_id int, boss_id int, email text, FOREIGN KEY (tenant_id) REFERENCES tenants (id), FOREIGN KEY (boss_id) REFERENCES users (id))",
    "CREATE TABLE orders (id int PRIMARY KEY, tenant_id int, user_id int, FOREIGN KEY (user_id) REFERENCES users (id))",
    "CREATE TABLE order_lines (id int PRIMARY KEY, order_id int, note text, FOREIGN KEY (order_id) REFERENCES orders (id))",
    "CREATE TABLE cache (id int PRIMARY KEY, user_id int REFERENCES users)",
])


@pytest.fixture(scope="module")
def shop(spark):
    return {
        "tenants": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"),
        "countries": spark.createDataFrame([(7, 1)], "code int, tenant_hint int"),
        "users": spark.createDataFrame([(i, 1 + i % 2, None if i == 0 else i - 1, f"u{i}@x.org") for i in range(40)], "id int, tenant_id int, boss_id int, email string"),
        "orders": spark.createDataFrame([(i, 1 + i % 2, None if i % 10 == 9 else i % 40) for i in range(200)], "id int, tenant_id int, user_id int"),
        "order_lines": spark.createDataFrame([(i, i % 200, "x") for i in range(600)], "id int, order_id int, note string"),
        "cache": spark.createDataFrame([(1, 1)], "id int, user_id int"),
    }


def ids(df, column="id"):
    return {r[0] for r in df.select(column).collect()}


def test_sample_keeps_references(shop):
    r = sample.sample(shop, SHOP, sample.SampleConfig(percent=40, roots=("tenants",), tables={"tenants": {"percent": 100}}))
    users, orders, lines = r.tables["users"], r.tables["orders"], r.tables["order_lines"]
    assert "cache" not in r.tables and r.classes["cache"] == "system" and r.classes["countries"] == "root"
    assert {x.user_id for x in orders.collect() if x.user_id is not None} <= ids(users)
    assert ids(lines, "order_id") <= ids(orders)
    assert {x.boss_id for x in users.collect() if x.boss_id is not None} <= ids(users)  # ancestors came along
    assert ids(users) == ids(sample.sample(shop, SHOP, sample.SampleConfig(percent=40, roots=("tenants",), tables={"tenants": {"percent": 100}})).tables["users"])


def test_sample_rows_and_limits(shop):
    r = sample.sample(shop, SHOP, sample.SampleConfig(rows=10))
    assert r.tables["order_lines"].count() <= 10 and r.tables["tenants"].count() == 2
    r = sample.sample(shop, SHOP, sample.SampleConfig(rows=10, max_total_rows=5))
    assert sum(df.count() for df in r.tables.values()) <= 5 and r.warnings
    broken = shop | {"orders": shop["orders"].union(shop["orders"].sparkSession.createDataFrame([(999, 1, 777)], "id int, tenant_id int, user_id int"))}
    with pytest.raises(ValueError, match="orders.user_id"):
        sample.sample(broken, SHOP, sample.SampleConfig(percent=50, strict=True))
    none = sample.sample(shop, SHOP, sample.SampleConfig(percent=100, exclude=("users",)))
    assert {x.user_id for x in none.tables["orders"].collect()} == {None}


def test_shard(shop):
    r = shard.shard(shop, SHOP, shard.ShardConfig(1))
    assert r.column == "tenant_id" and r.classes["order_lines"] == "dependent" and r.classes["cache"] == "dependent"
    assert {x.tenant_id for x in r.tables["users"].collect()} == {1}
    assert ids(r.tables["order_lines"], "order_id") <= ids(r.tables["orders"])
    assert "tenants" not in r.tables and "countries" in r.tables
    with pytest.raises(ValueError):
        shard.shard(shop, Catalog(), shard.ShardConfig(1))


def test_validate(spark, shop):
    broken = shop | {"users": shop["users"].union(spark.createDataFrame([(3, 9, None, "bad �")], "id int, tenant_id int, boss_id int, email string"))}
    found = {(r.code, r.table_name, r.column_name, r.key_text, r.n) for r in validate.issues(broken, SHOP).collect()}
    assert found == {("DUPLICATE_PK", "users", "id", "3", 2), ("FK_MISSING_PARENT", "users", "tenant_id", "9", 1), ("ENCODING", "users", "email", None, 1)}
    assert validate.report(validate.issues(broken, SHOP)).count() == 3


def test_diff(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "c", 1), (None, "n", 1), (5, "e", 1), (5, "f", 1)], "id int, v string, w int")
    new = spark.createDataFrame([(1, "a", 2), (2, "", 1), (4, "d", 1), (5, "f", 1)], "id int, v string, w int")
    got = {(r.id, r.change) for r in diff.row_changes(old, new, ["id"], ["t.W"], "t").collect()}
    assert got == {(2, "modified"), (3, "removed"), (4, "added")}
    assert {(r.id, r.change) for r in diff.row_changes(old, new, ["id"]).collect()} == got | {(1, "modified")}
    changes, warnings = diff.data_diff({"t": old}, {"t": new}, Catalog())
    assert warnings and not changes
    a, b = ddl.build_catalog(["CREATE TABLE t (id int PRIMARY KEY, v varchar(9))"]), ddl.build_catalog(["CREATE TABLE t (id int PRIMARY KEY, v bigint NOT NULL, w date)", "CREATE TABLE n (id int)"])
    text = diff.as_sql(a, b, "postgres")
    assert 'ALTER TABLE "t" ALTER COLUMN "v" TYPE bigint;' in text and 'ADD COLUMN "w" date' in text and "CREATE TABLE" in text
    assert json.loads(diff.as_json(diff.schema_diff(a, b), {"t": {"added": 1, "removed": 0, "modified": 0}}))["data"]["t"]["added"] == 1
    assert "+1 -0 ~0" in diff.as_text([], {"t": {"added": 1, "removed": 0, "modified": 0}})


def brute_mask(pattern, value):
    out, i = "", 0
    for p in pattern:
        if p == "X":
            out += value[i : i + 1]
            i += 1
        elif p in "*#":
            out += p
            i += 1
        else:
            out += p
            i += value[i : i + 1] == p
    return out


@pytest.mark.parametrize("pattern", ["***XX", "****-****-****-XXXX", "XX-XX", "X*X", "(XXX) XXX", ""])
def test_mask(spark, pattern):
    values = ["1234-5678-9012-3456", "1234567890123456", "ab", "", None, "(12) 34"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", redaction.masked(F.col("v"), pattern, 1).alias("m"))
    for r in df.collect():
        assert r.m == (None if r.v is None else brute_mask(pattern, r.v))


def test_redact(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"n{i}@h.org", i * 1.5, "keep") for i in range(50)], "id int, email string, amount double, note string")
    rules = [redact.Rule("*.email", "hash", preserve_domain=True), redact.Rule("people.amount", "shuffle"), redact.Rule("amount", "null")]
    out = {r.id: r for r in redact.redact(df, "people", rules, ["id"]).collect()}
    assert out[3].email is None and out[4].email.endswith("@h.org") and len(out[4].email) == 14 and out[4].note == "keep"
    assert sorted(r.amount for r in out.values()) == sorted(i * 1.5 for i in range(50)) and any(out[i].amount != i * 1.5 for i in out)
    for kind in ("name", "email", "phone", "address", "credit_card", "iban", "ssn", "date", "uuid", "ipv6", "paragraph", "nothing"):
        got = redact.redact(df, "people", [redact.Rule("email", "fake", kind)], ["id"]).select("email").collect()
        assert sum(r.email is None for r in got) == 1
    with pytest.raises(ValueError):
        redact.Rule("a.b", "unheard")


def test_statements_and_graph(spark, tmp_path, shop):
    path = sqlwriter.write_dump({k: shop[k] for k in ("users", "tenants")}, str(tmp_path / "d.sql"), "mysql", SHOP)
    d = read_dump(spark, path)
    assert {(r.table_name, r.n_rows) for r in statements.analyze(d).collect()} == {("users", 40), ("tenants", 2)}
    assert statements.order(SHOP)[:2] == ["countries", "tenants"] and statements.order(SHOP, True)[-1] == "countries"
    kinds = [(r.phase, r.table_name) for r in statements.ordered_statements(d).collect() if r.table_name]
    assert kinds.index((0, "tenants")) < kinds.index((0, "users")) < kinds.index((1, "tenants"))
    assert "users" in erd.to_dot(SHOP) and "tenants ||--o{ users" in erd.to_mermaid(SHOP) and "<table id='users'>" in erd.to_html(SHOP)
    assert json.loads(erd.to_json(SHOP))["cycles"] == [["users"]]


@pytest.mark.parametrize(("source", "target"), [(a, b) for a in ("mysql", "postgres", "sqlite", "mssql") for b in ("mysql", "postgres", "sqlite", "mssql") if a != b])
def test_convert(spark, tmp_path, source, target):
    df = spark.createDataFrame([(1, "it's \\ é\n", True, 1.5, bytearray(b"\x01\xff")), (2, None, None, None, None)], "id int, t string, ok boolean, d double, raw binary")
    path = sqlwriter.write_dump({"t": df}, str(tmp_path / "a.sql"), source)
    rows = convert.convert(read_dump(spark, path, source), target).where("text is not null").orderBy("start", "idx", "part").collect()
    out = tmp_path / "b.sql"
    out.write_text(sqlwriter.header(target) + "".join(r.text + ("\nGO\n" if target == "mssql" else ";\n") for r in rows), encoding="utf-8")
    back = read_dump(spark, str(out), target).table("t").orderBy("id").collect()
    assert (back[0].id, back[0].t, float(back[0].d), bytes(back[0].raw), bool(back[0].ok)) == (1, "it's \\ é\n", 1.5, b"\x01\xff", True)
    assert back[1].t is None and back[1].ok is None


def test_convert_warnings(spark, tmp_path):
    path = tmp_path / "e.sql"
    path.write_text("-- MySQL dump\nCREATE TABLE `t` (`id` int unsigned NOT NULL AUTO_INCREMENT, `k` enum('a','b') DEFAULT 'a', PRIMARY KEY (`id`)) ENGINE=InnoDB;\nCREATE VIEW v AS SELECT 1;\n")
    got = convert.convert(read_dump(spark, str(path)), "postgres").collect()
    said = " ".join(w for r in got for w in r.warnings)
    assert "ENUM" in said and "unsigned" in said and "skipped_statement" in said
    assert '"id" SERIAL' in got[0].text or "SERIAL" in got[0].text
    with pytest.raises(Exception, match="unsupported_feature|ENUM|lossy"):
        convert.convert(read_dump(spark, str(path)), "postgres", strict=True).collect()


def test_sql_shim(spark):
    spark.createDataFrame([(1, None, 1), (1, 2, 2), (2, 3, 3)], "k int, v int, t int").createOrReplaceTempView("shim_a")
    spark.createDataFrame([(1, 0, "x"), (1, 2, "y"), (2, 5, "z")], "k int, t int, s string").createOrReplaceTempView("shim_b")
    assert [r.v for r in shim.run(spark, "select v from shim_a order by v").collect()] == [2, 3, None]
    assert [tuple(r) for r in shim.run(spark, 'select k as "a key", v from shim_a qualify row_number() over (partition by k order by v) = 1 order by k desc, v limit 5').collect()] == [(2, 3), (1, 2)]
    got = shim.run(spark, "select a.t, b.s from shim_a a asof left join shim_b b on a.k = b.k and a.t >= b.t order by a.t").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "y"), (3, None)]
    assert [tuple(r) for r in shim.run(spark, "select a.t, b.s from shim_a a asof join shim_b b on a.k = b.k and a.t > b.t order by a.t").collect()] == [(1, "x"), (2, "x")]
    assert shim.run(spark, "select 10 / 0 as x").first().x is None


def test_asof_over_buckets(spark):
    left = spark.range(0, 200_000, 997).selectExpr("id % 3 as k", "id as t", "id as n")
    right = spark.range(0, 200_000, 5003).selectExpr("id % 3 as k", "id as t", "id as m")
    got = {r.n: r.m for r in shim.asof_join(left, right, [("k", "k")], "t", "t", bucket_seconds=1000).select("l.n", "r.m").collect()}
    by_key = {}
    for r in right.collect():
        by_key.setdefault(r.k, []).append(r.t)
    for r in left.collect():
        assert got[r.n] == max((t for t in by_key.get(r.k, []) if t <= r.t), default=None)


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"', 1.5)], "i int, s string, d double")
    assert json.loads(formats.render(df, "json"))[0] == {"i": 1, "s": "a,b", "d": None}
    assert formats.render(df, "csv").splitlines()[1] == '1,"a,b",' and "NULL" in formats.render(df)
    for form in ("json", "csv", "tsv"):
        formats.write(df, str(tmp_path / form), form)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_every_generator(spark):
    args = {
        "constant": {"value": 1}, "json_value": {"value": "{}"}, "copy": {"source": "i"}, "template": {"template": "a{row}"}, "slug": {"source": "s"}, "pattern": {"pattern": "##-??"}, "database_default": {"expression": "1 + 1"},
        "choice": {"values": [1, 2]}, "weighted_choice": {"values": ["a", "b"]}, "observed_sample": {"values": ["a", "b"]}, "histogram": {"bins": [(1.0, 2.0), (5.0, 1.0)]},
        "relation.foreign_key": {"parent": "p"}, "relation.composite_key": {"parent": "p"}, "before": {"source": "at"}, "after": {"source": "at"},
    }
    df = spark.range(20).selectExpr("id as i", "concat('A b!', id) as s", "timestamp_ntz'2024-01-01 00:00:00' as at")
    c = Context(1, "t", "c", F.col("i"), {"p": KeyDomain(5)})
    out = df.select(*[f(c, **args.get(kind, {})).alias(kind.replace(".", "_")) for kind, f in GENERATORS.items()]).collect()
    assert len(out) == 20 and all(v is not None for k, v in out[3].asDict().items() if k != "null")
    value = F.col("s")
    for kind, more in {"prefix": {"text": "x"}, "suffix": {"text": "y"}, "truncate": {"length": 2}, "case": {"to": "upper"}, "format": {"format": "<%s>"}}.items():
        assert df.select(MODIFIERS[kind](c, value, **more)).first()[0]
    assert df.select(MODIFIERS["clamp"](c, F.col("i"), 3, 5).alias("v")).agg(F.min("v"), F.max("v")).first()[:] == (3, 5)
    assert make_unique(spark.createDataFrame([(i, i % 3) for i in range(9)], "i int, v int"), "v", "i").select("v").distinct().count() == 9


def test_apportion_is_exact(spark):
    df = spark.createDataFrame([(g, n, 10 + g, (n * 7) % 5) for g in range(20) for n in range(1, 6)], "g int, n int, total long, w long")
    sums = planners.apportion(df, "total", "w", "g", "n", "part").groupBy("g").agg(F.sum("part").alias("s"), F.first("total").alias("t")).collect()
    assert all(r.s == r.t for r in sums)


def test_models(spark, tmp_path):
    (tmp_path / "base.json").write_text('{"tables": {"a": {"rows": 10, "columns": {"id": {"kind": "sequence"}}}}}')
    (tmp_path / "m.json").write_text('{"imports": ["base.json"], "tables": {"a": {"rows": 12}, "b": {"rows": {"children_of": "a", "mean": 2}, "columns": {"a_id": {"kind": "relation.foreign_key", "parent": "a"}}}}}')
    made = engine.generate(spark, engine.load_model(tmp_path / "m.json"))
    assert made.counts == {"a": 12, "b": 24}
    report = engine.verify(made.tables, [], {"a": ("id",)}, [("b", "a_id", "a", "id")], made.counts)
    assert all(r.violations == 0 for r in report.collect())
    with pytest.raises(ValueError):
        engine.generate(spark, {"tables": {"a": {"columns": {"x": {"kind": "nothing"}}}}})
    ok = engine.distribution_check(spark.createDataFrame([("a",)] * 3 + [("b",)], "v string"), "v", {"a": 0.75, "b": 0.25}, 0.01)
    assert all(r.ok for r in ok.collect())


def test_profile_and_inference(spark, shop):
    p = {r.column_name: r for r in sketches.profile(shop["users"]).collect()}
    assert p["email"].n_email == 40 and p["email"].prefix == "u" and p["email"].suffix == "@x.org" and p["boss_id"].n_null == 1 and p["id"].max_number == 39
    assert sketches.relationships(shop, SHOP).where("child = 'orders'").first().coverage == 1.0
    model = infer.infer_model(SHOP, 20, {"users": {k: v.asDict(recursive=True) for k, v in p.items()}})
    assert model["tables"]["users"]["columns"]["email"]["kind"] == "internet.email" and model["tables"]["orders"]["columns"]["user_id"]["kind"] == "relation.foreign_key"
    made = engine.generate(spark, model)
    assert made.tables["order_lines"].count() == 20


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value", "user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), events.schema), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").exceptAll(windows.tumbling(events, "1 day")).where("n is null").count() == 0
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == events.count()
    assert windows.sliding(events, "2 days", "1 day").agg(F.sum("n")).first()[0] == 2 * events.count()


def test_command_line(spark, tmp_path, shop):
    path = sqlwriter.write_dump({k: shop[k] for k in ("tenants", "users", "orders")}, str(tmp_path / "d.sql"), "mysql", SHOP)

    def run(*argv, lines=()):
        out = io.StringIO()
        code = cli.main(list(argv), spark, out, list(lines))
        return code, out.getvalue()

    assert "users" in run("analyze", path)[1] and run("order", path)[1].split() == ["tenants", "users", "orders"]
    assert run("validate", path)[0] == 0 and "erDiagram" in run("graph", path)[1]
    assert run("query", path, "--sql", "select count(*) as n from users", "--format", "csv")[1] == "n\n40\n"
    said = run("query", path, lines=[".tables", ".count users", ".schema users", ".format json", "select 1 as x;", ".sample tenants", "select nope", ".what", ".quit"])[1]
    assert "40" in said and '"x": 1' in said and "error:" in said and "unknown command" in said
    run("sample", path, "-o", str(tmp_path / "s.sql"), "--percent", "50")
    assert run("diff", path, str(tmp_path / "s.sql"))[0] == 1 and run("diff", path, path)[0] == 0
    run("shard", path, "-o", str(tmp_path / "t.sql"), "--value", "1")
    assert {r.tenant_id for r in read_dump(spark, str(tmp_path / "t.sql")).table("users").collect()} == {1}
    assert "users.email=hash" in run("redact", path, "--detect")[1]
    run("redact", path, "-o", str(tmp_path / "r.sql"))
    run("convert", path, "--to", "postgres", "-o", str(tmp_path / "c.sql"))
    assert read_dump(spark, str(tmp_path / "c.sql")).table("users").count() == 40
    run("split", path, "-o", str(tmp_path / "parts"))
    run("merge", path, "-o", str(tmp_path / "m.sql"))
    assert read_dump(spark, str(tmp_path / "m.sql")).table("orders").count() == 200
    (tmp_path / "g.json").write_text('{"tables": {"a": {"rows": 5, "columns": {"id": {"kind": "sequence"}}}}}')
    run("generate", str(tmp_path / "g.json"), "-o", str(tmp_path / "g.sql"))
    assert read_dump(spark, str(tmp_path / "g.sql")).table("a").count() == 5
    assert set(json.loads(cli.schemas())) == {"diff", "graph"}


@pytest.mark.parametrize("form", ["csv", "tsv", "jsonl", "json", "table"])
def test_query_gives_all_rows(spark, tmp_path, shop, form):
    path = sqlwriter.write_dump({"tenants": shop["tenants"]}, str(tmp_path / "d.sql"), "mysql", SHOP)
    sql = "select id as i, 'a' as t from range(10500) order by i"

    def run(*argv, lines=()):
        out = io.StringIO()
        cli.main(["query", path, "--format", form, *argv], spark, out, list(lines))
        return out.getvalue()

    def ids(said):
        return [int(x) for x in re.findall(r'^(?:\s*"i": |\{"i": )?(\d+)', said, re.M)]

    assert ids(run("--sql", sql)) == list(range(10_500))
    assert ids(run("--sql", sql, "--limit", "5")) == list(range(5))
    said = run(lines=[f".format {form}", sql])
    assert ids(said) == list(range(10_500)) and (form != "table" or said.endswith("(10500 rows)\n"))
    if form == "json":
        rows = [{"i": i, "t": "a"} for i in range(10_500)]
        assert run("--sql", sql) == json.dumps(rows, indent=2) + "\n" and run("--sql", "select 1 as x where false") == "[]\n"


FIXTURES = {
    "duplicate": ("-- MySQL dump\nCREATE TABLE `people` (`id` int NOT NULL, `name` varchar(9), PRIMARY KEY (`id`));\nINSERT INTO `people` VALUES (1,'a'),(2,'b'),(1,'c');\n", {("DUPLICATE_PK", "people", 2)}),
    "missing parent": ("-- MySQL dump\nCREATE TABLE `units` (`id` int PRIMARY KEY);\nCREATE TABLE `staff` (`id` int PRIMARY KEY, `unit_id` int, FOREIGN KEY (`unit_id`) REFERENCES `units` (`id`));\nINSERT INTO `units` VALUES (1);\nINSERT INTO `staff` VALUES (1,1),(2,99),(3,NULL);\n", {("FK_MISSING_PARENT", "staff", 1)}),
    "missing table": ("-- MySQL dump\nCREATE TABLE `a` (`id` int PRIMARY KEY);\nINSERT INTO `a` VALUES (1);\nINSERT INTO `ghost` VALUES (1);\n", {("DDL_MISSING_TABLE", "ghost", 1)}),
    "inline reference": ("PRAGMA foreign_keys=OFF;\nBEGIN TRANSACTION;\nCREATE TABLE owners (id INTEGER PRIMARY KEY);\nCREATE TABLE pets (id INTEGER PRIMARY KEY, owner_id INTEGER REFERENCES owners(id));\nINSERT INTO owners VALUES(1);\nINSERT INTO pets VALUES(1,1);\nINSERT INTO pets VALUES(2,5);\nCOMMIT;\n", {("FK_MISSING_PARENT", "pets", 1)}),
    "late schema": ("-- PostgreSQL database dump\nCOPY public.t (id, v) FROM stdin;\n1\ta\n1\t\\N\n\\.\nCREATE TABLE public.t (id integer, v text);\nALTER TABLE ONLY public.t ADD CONSTRAINT t_pkey PRIMARY KEY (id);\n", {("DUPLICATE_PK", "public.t", 2)}),
    "several tenants": ("SET ANSI_NULLS ON\nGO\nCREATE TABLE [dbo].[tenants] ([id] int NOT NULL PRIMARY KEY)\nGO\nCREATE TABLE [dbo].[users] ([id] int NOT NULL PRIMARY KEY, [tenant_id] int, CONSTRAINT [fk] FOREIGN KEY ([tenant_id]) REFERENCES [dbo].[tenants] ([id]))\nGO\nINSERT [dbo].[tenants] ([id]) VALUES (1)\nINSERT [dbo].[users] ([id], [tenant_id]) VALUES (1, 1)\nGO\nINSERT [dbo].[users] ([id], [tenant_id]) VALUES (2, 3)\nGO\n", {("FK_MISSING_PARENT", "dbo.users", 1)}),
}


@pytest.mark.parametrize("name", list(FIXTURES))
def test_dump_fixtures(spark, tmp_path, name):
    text, wanted = FIXTURES[name]
    (tmp_path / "f.sql").write_text(text)
    d = read_dump(spark, str(tmp_path / "f.sql"))
    found = validate.issues({t.name: d.table(t.name) for t in d.catalog}, d.catalog, d.statements())
    assert {(r.code, r.table_name, r.n) for r in found.collect()} == wanted
