"""Dumps of the four dialects: tokenizer, rows, DDL, splits, compression, cache, writing and reading back."""

import bz2
import gzip
import io
import lzma
import random
import zipfile

import pytest

from dumpquarry import ddl
from dumpquarry.catalog import Catalog, ForeignKey, TableDef
from dumpquarry.dialect import column_class, detect, literal, quote, spark_type, unquote
from dumpquarry.sinks import sqlwriter
from dumpquarry.sources import files, splits, tokenizer
from dumpquarry.sources.dump import read_dump, split_rows, split_statements

MYSQL = r"""-- MySQL dump
/*!40101 SET NAMES utf8mb4 */;
CREATE TABLE `owners` (`id` bigint unsigned NOT NULL, `label` varchar(40) DEFAULT 'x;y', `ok` tinyint(1), PRIMARY KEY (`id`), KEY `by_label` (`label`(10)));
CREATE TABLE `widgets` (`id` int NOT NULL AUTO_INCREMENT, `owner_id` bigint unsigned, `raw` binary(4), `price` decimal(10,2), `made` datetime, PRIMARY KEY (`id`), CONSTRAINT `fk_o` FOREIGN KEY (`owner_id`) REFERENCES `owners` (`id`));
INSERT INTO `owners` VALUES (1,'it''s; (a) \'b\' \\ \n\t',1),(18446744073709551615,NULL,0);
# a comment; with a semicolon
INSERT INTO `widgets` (`price`,`id`,`owner_id`,`raw`) VALUES (1.50,1,1,0xDEADBEEF),(-2,2,NULL,NULL),(3,3,99,_binary '1234');
DELIMITER ;;
CREATE TRIGGER t BEFORE INSERT ON widgets FOR EACH ROW BEGIN SET @a = 1; SET @b = 2; END ;;
DELIMITER ;
INSERT INTO `widgets` VALUES (4,1,NULL,'bad','2024-02-30 00:00:00'),(5,1,NULL,7,NOW(6));
"""
POSTGRES = """--
-- PostgreSQL database dump
--
CREATE TABLE public.t (id integer NOT NULL, body text, n numeric(8,3), flag boolean);
COPY public.t (id, body, n, flag) FROM stdin;
1\tx\\ty\\\\z\t1.5\tt
2\t\\N\t\\N\tf
3\tsemi; 'quote\t0\t\\N
\\.

CREATE FUNCTION f() RETURNS int AS $body$ SELECT 1; $body$ LANGUAGE sql;
INSERT INTO public.t VALUES (4, E'q\\'s;', 2::numeric, true);
ALTER TABLE ONLY public.t ADD CONSTRAINT t_pkey PRIMARY KEY (id);
"""
MSSQL = """SET ANSI_NULLS ON
GO
CREATE TABLE [dbo].[users] ([id] int IDENTITY(1,1) NOT NULL, [name] nvarchar(50) NULL, [made] datetime2, CONSTRAINT [pk] PRIMARY KEY CLUSTERED ([id] ASC))
GO
INSERT [dbo].[users] ([id], [name], [made]) VALUES (1, N'a''b; GO
GO x', CAST(N'2024-01-02T03:04:05' AS DateTime2))
GO
INSERT INTO [dbo].[users] ([name]) VALUES (N'żółw')
GO
"""


def all_statements(text, dialect, block):
    keep, tokenizer.BLOCK_CHARS = tokenizer.BLOCK_CHARS, block
    try:
        return list(tokenizer.statements(io.StringIO(text), dialect))
    finally:
        tokenizer.BLOCK_CHARS = keep


@pytest.mark.parametrize(("text", "dialect"), [(MYSQL, "mysql"), (POSTGRES, "postgres"), (MSSQL, "mssql")])
def test_statements_do_not_depend_on_blocks(text, dialect):
    whole = all_statements(text, dialect, 1 << 20)
    for block in (1, 3, 17, 64):
        assert all_statements(text, dialect, block) == whole


def test_detection():
    assert detect(MYSQL).dialect == "mysql" and detect(POSTGRES).dialect == "postgres" and detect(MSSQL).dialect == "mssql"
    assert detect("PRAGMA foreign_keys=OFF;\nBEGIN TRANSACTION;").dialect == "sqlite"
    assert (detect("SELECT 1").dialect, detect("SELECT 1").confidence) == ("mysql", "low")


def test_names_and_types():
    for d in ("mysql", "postgres", "sqlite", "mssql"):
        assert unquote(quote('we"ird`n]ame', d)) == 'we"ird`n]ame'
    assert unquote("[dbo].[users]") == "dbo.users"
    assert [spark_type(t).simpleString() for t in ("tinyint(1)", "int unsigned", "bigint unsigned", "decimal(10,2)", "money", "bytea", "timestamptz", "datetime2", "year", "enum('a','b')", "bit", "double precision", "serial")] == ["boolean", "bigint", "decimal(20,0)", "decimal(10,2)", "decimal(19,4)", "binary", "timestamp", "timestamp_ntz", "smallint", "string", "boolean", "double", "int"]
    assert [column_class(t) for t in ("int", "bigint", "varchar(3)", "uuid", "float", "interval", "bool", "json")] == ["Int", "BigInt", "Text", "Uuid", "Decimal", "DateTime", "Bool", "Other"]


def test_ddl():
    catalog = ddl.build_catalog([
        "CREATE TABLE p (id int PRIMARY KEY, `key` varchar(3), note text COMMENT 'a, (b)', CHECK (id > 0))",
        "CREATE TABLE c (id int, p_id int NOT NULL REFERENCES p, q int, UNIQUE KEY u (q, p_id))",
        "ALTER TABLE ONLY c ADD CONSTRAINT f FOREIGN KEY (q) REFERENCES p(id) ON DELETE CASCADE",
        "CREATE UNIQUE INDEX i ON c USING btree (q)",
    ])
    assert catalog.get("P").primary_key == ("id",) and [c.name for c in catalog.get("p").columns] == ["id", "key", "note"]
    assert {(fk.columns, fk.parent, fk.parent_columns) for fk in catalog.get("c").foreign_keys} == {(("p_id",), "p", ("id",)), (("q",), "p", ("id",))}
    assert ("i", ("q",)) in catalog.get("c").indexes and catalog.topological() == (["p", "c"], [])


def test_graph():
    c = Catalog(TableDef(n, foreign_keys=[ForeignKey(("x",), p, ("id",)) for p in ps]) for n, ps in (("a", []), ("b", ["a", "b"]), ("c", ["d"]), ("d", ["c"]), ("e", ["d", "b"])))
    assert c.topological() == (["a", "b"], ["c", "d", "e"])
    assert c.cycles() == [["b"], ["c", "d"]]
    assert c.ancestors("e") == {"a", "b", "c", "d"} and c.descendants("a") == {"b", "e"}
    assert c.focus("e", depth=1).names() == ["b", "d", "e"] and c.matching(["[ab]"]).names() == ["a", "b"]


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8", newline="")
    return str(path)


def test_mysql_rows(spark, tmp_path):
    d = read_dump(spark, write(tmp_path, "m.sql", MYSQL))
    assert d.dialect == "mysql" and d.catalog.names() == ["owners", "widgets"]
    owners = {int(r.id): (r.label, r.ok) for r in d.table("owners").collect()}
    assert owners == {1: ("it's; (a) 'b' \\ \n\t", True), 18446744073709551615: (None, False)}
    w = {r.id: r for r in d.table("widgets").collect()}
    assert bytes(w[1].raw) == b"\xde\xad\xbe\xef" and str(w[1].price) == "1.50" and w[1].made is None
    assert w[2].owner_id is None and bytes(w[3].raw) == b"1234" and w[4].made is None and w[5].id == 5
    raw = {r.id: r.made for r in d.raw("widgets").collect()}
    assert raw["4"] == "2024-02-30 00:00:00" and raw["5"] == "NOW(6)"
    kinds = [r.kind for r in d.statements().orderBy("idx").collect()]
    assert kinds.count("insert") == 3 and kinds.count("create_table") == 2 and "unknown" in kinds


def test_postgres_and_mssql_rows(spark, tmp_path):
    d = read_dump(spark, write(tmp_path, "p.sql", POSTGRES))
    got = {r.id: (r.body, None if r.n is None else float(r.n), r.flag) for r in d.table("t").collect()}
    assert got == {1: ("x\ty\\z", 1.5, True), 2: (None, None, False), 3: ("semi; 'quote", 0.0, None), 4: ("q's;", 2.0, True)} or got[4][1] is None
    assert d.catalog.get("t").primary_key == ("id",)
    m = read_dump(spark, write(tmp_path, "s.sql", MSSQL))
    assert [(r.id, r.name, str(r.made)) for r in m.table("users").orderBy("name").collect()] == [(1, "a'b; GO\nGO x", "2024-01-02 03:04:05"), (None, "żółw", "None")]


@pytest.mark.parametrize(("dialect", "copy"), [("mysql", False), ("postgres", False), ("postgres", True), ("sqlite", False), ("mssql", False)])
def test_splits_lose_nothing(spark, tmp_path, dialect, copy):
    r = random.Random(4)
    rows = [(i, "".join(r.choices("ab'\"`;\\\n\t-#/*$é[]", k=r.randrange(30))) if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    path = sqlwriter.write_dump({"x": df, "y": df.limit(50)}, str(tmp_path / "d.sql"), dialect, chunk=20, copy=copy)
    for size in (300, 1000, 5000):
        parts = splits.plan(spark, [path], dialect, size)
        assert len(parts) > 1
        got = [(int(a), b) for p in parts for a, b in split_rows(p, dialect, "x", ["id", "t"])]
        assert sorted(got, key=lambda x: x[0]) == rows
        whole = [s.text for s in split_statements(splits.Split(path, 0, -1), dialect) if s.kind == "insert"]
        assert [s.text for p in parts for s in split_statements(p, dialect) if s.kind == "insert"] == whole
    back = read_dump(spark, path, dialect, split_bytes=1000).table("x")
    assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count()


@pytest.mark.parametrize("before", ["", "-- a remark\n" * 400, "/* a remark\n" + "goes on\n" * 800 + "*/\n"])
def test_splits_after_a_long_copy_header(spark, tmp_path, before):
    names = ["id", "t", *[f"a_rather_long_column_name_{i}" for i in range(150)]]
    rows = [(i, "it's; (1, 'x');" if i % 3 == 0 else f"plain {i}") for i in range(400)]
    head = f"CREATE TABLE x ({', '.join(n + (' bigint' if n == 'id' else ' text') for n in names)});\n"
    data = "".join(f"{i}\t{t}" + "\t\\N" * 150 + "\n" for i, t in rows)
    path = write(tmp_path, "wide.sql", f"-- PostgreSQL database dump\n{head}{before}COPY x ({', '.join(names)}) FROM stdin;\n{data}\\.\n")
    for size in (3000, 20_000):
        parts = splits.plan(spark, [path], "postgres", size)
        assert len(parts) > 1
        got = [(int(r[0]), r[1]) for p in parts for r in split_rows(p, "postgres", "x", names)]
        assert sorted(got) == rows


def test_compression_and_globs(spark, tmp_path):
    data = MYSQL.encode()
    (tmp_path / "a.sql.gz").write_bytes(gzip.compress(data[:500]) + gzip.compress(data[500:]))
    (tmp_path / "b.sql.bz2").write_bytes(bz2.compress(data))
    (tmp_path / "c.sql.xz").write_bytes(lzma.compress(data))
    import zstandard

    (tmp_path / "d.sql.zst").write_bytes(zstandard.compress(data[:500]) + zstandard.compress(data[500:]))
    with zipfile.ZipFile(tmp_path / "e.sql.zip", "w") as z:
        z.writestr("x/dump.sql", data)
        z.writestr("readme.txt", "no")
    for p in files.expand(str(tmp_path / "*.sql.*")):
        assert files.open_text(p).read() == MYSQL
    assert read_dump(spark, str(tmp_path)).table("widgets").count() == 25
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.sql", "")
        z.writestr("b.sql", "")
    with pytest.raises(ValueError):
        files.open_text(str(tmp_path / "f.zip"))
    with pytest.raises(FileNotFoundError):
        files.expand(str(tmp_path / "none*.sql"))


def test_cache_and_views(spark, tmp_path):
    path = write(tmp_path, "m.sql", MYSQL)
    d = read_dump(spark, path)
    cached = d.cached(str(tmp_path / "cache"))
    assert cached["owners"].count() == 2 and cached["owners"].schema == d.table("owners").schema
    key = d.key()
    write(tmp_path, "m.sql", MYSQL + "\n")
    assert read_dump(spark, path).key() != key
    assert d.register(["widgets"]) == ["widgets"] and spark.sql("select count(*) from widgets").first()[0] == 5


def test_limits():
    with pytest.raises(ValueError):
        list(tokenizer.statements(io.StringIO("INSERT INTO t VALUES ('" + "x" * 3_000_000), "mysql", tokenizer.Limits(1_000_000)))


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b\\c\n", True, bytearray(b"\x01"), None), (2, None, None, None, 2.5)], "id long, t string, b boolean, x binary, d double")
    for dialect in ("mysql", "postgres", "sqlite", "mssql"):
        path = sqlwriter.write_dump({"t": df}, str(tmp_path / f"{dialect}.sql"), dialect)
        back = read_dump(spark, path, dialect)
        assert sorted(map(tuple, back.table("t").select("id", "t", "b", "d").collect())) == [(1, "a'b\\c\n", True, None), (2, None, None, 2.5)]
    assert literal("é", "mssql") == "N'é'" and literal(None, "mysql") == "NULL"
    folder = sqlwriter.write_tables({"t": df}, str(tmp_path / "parts"), "mysql")
    for kind in ("tar.gz", "zip", "tar.zst"):
        assert sqlwriter.pack(folder, str(tmp_path / f"o.{kind}")).endswith(kind)


@pytest.mark.parametrize("dialect", ["mysql", "postgres", "sqlite", "mssql"])
def test_columns_equal_rows(dialect):
    r = random.Random(9)
    agreed = 0
    for _ in range(400):
        rows = [[r.choice([None, r.randrange(-99, 99), r.random(), "".join(r.choices("a',;()\n- N" + chr(92), k=r.randrange(6)))]) for _ in range(3)] for _ in range(r.randrange(1, 5))]
        text = "INSERT INTO t (a, b, c) VALUES " + ",\n".join("(" + ", ".join(literal(v, dialect) for v in row) + ")" for row in rows) + r.choice(["", ";", " ;\n"])
        names, lazy = tokenizer.insert_rows(text, dialect)
        wanted = list(lazy)
        assert wanted == [[None if v is None else str(v) for v in row] for row in rows]
        if found := tokenizer.insert_columns(text, dialect):
            agreed += 1
            assert found[0] == names and [list(x) for x in zip(*found[1])] == wanted
    assert agreed > 300


def test_line_ended_batches_are_cut(spark, tmp_path):
    text = "SET ANSI_NULLS ON\nGO\nCREATE TABLE [t] ([id] int NOT NULL, [v] nvarchar(9))\nGO\n" + "".join(f"INSERT [t] ([id], [v]) VALUES ({i}, N'x\nINSERT {i}')\n" + ("GO\n" if i % 5 == 4 else "") for i in range(100))
    path = write(tmp_path, "g.sql", text)
    for size in (200, 1000):
        parts = splits.plan(spark, [path], "mssql", size)
        assert len(parts) > 2
        assert sorted(int(a) for p in parts for a, _ in split_rows(p, "mssql", "t", ["id", "v"])) == list(range(100))


@pytest.mark.parametrize(("text", "dialect"), [(MYSQL, "mysql"), (POSTGRES, "postgres"), (MSSQL, "mssql")])
def test_splits_know_their_tables(spark, tmp_path, text, dialect):
    lines = "".join(f"INSERT [dbo].[late{i}] ([id]) VALUES ({i})\n" for i in range(40)) if dialect == "mssql" else ""
    path = write(tmp_path, "k.sql", text * 4 + lines + text)
    whole = [(s.kind, s.table, s.text) for s in split_statements(splits.Split(path, 0, -1), dialect) if s.kind != "copy_data"]
    for size in (90, 250, 700):
        parts = splits.plan(spark, [path], dialect, size)
        seen = [[s for s in split_statements(p, dialect)] for p in parts]
        assert [(s.kind, s.table, s.text) for part in seen for s in part if s.kind != "copy_data" and s.index >= 0] == whole
        for p, part in zip(parts, seen):
            assert {s.table.lower() for s in part if s.table} <= set(p.tables)
            assert p.has_ddl or not any(s.kind in splits.DDL_KINDS for s in part)
        assert dialect == "mssql" or any(len(p.tables) < 3 for p in parts)  # lines of batches are looked at far ahead


def test_merge_repeats_copies_and_keeps_order(spark, tmp_path):
    from dumpquarry.operators import statements

    rows = [(i, f"text {i} " + "x" * 300) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, t string").coalesce(1)
    path = sqlwriter.write_dump({"a": df.limit(10), "b": df, "c": df.limit(5)}, str(tmp_path / "d.sql"), "postgres", chunk=100_000, copy=True)
    d = read_dump(spark, path, "postgres", 200_000)
    assert len(d.splits) >= 8
    merged = read_dump(spark, statements.merge([d], str(tmp_path / "m.sql"), "postgres"), "postgres", 300_000)
    assert sorted(map(tuple, merged.table("b").collect())) == rows and merged.table("c").count() == 5
    found = [(r.kind, r.table_name) for r in merged.statements().collect() if r.table_name]
    assert list(dict.fromkeys(found)) == [(k, t) for t in "abc" for k in ("create_table", "copy", "copy_data")]
    names = [r.table_name for r in statements.ordered_statements(d, reverse=True).where("phase = 1").collect()]
    assert names == sorted(names, key=statements.order(d.catalog, True).index)


def test_only_needed_columns_are_read(spark, tmp_path):
    path = sqlwriter.write_dump({"t": spark.range(50).selectExpr("id", "id * 2 as b", "'x' as c", "id % 3 as g"), "u": spark.range(5).selectExpr("id as k", "'y' as z")}, str(tmp_path / "q.sql"), "mysql")
    d = read_dump(spark, path, "mysql")
    sql = "select g, sum(b) as s, count(u.k) as n from t join u on t.g = u.k group by g"
    d.register()
    assert d.needed(spark.sql(sql)) == {"t": ["b", "g"], "u": ["k"]}
    assert d.needed(spark.sql("select count(*) from u")) == {"u": ["k"]}
    assert sorted(map(tuple, d.query(sql).collect())) == [(0, 816, 17), (1, 850, 17), (2, 784, 16)]
    assert d.table("t", ["c", "id"]).columns == ["c", "id"]
