"""Reading dumps as DataFrames: the ``sqldump`` data source and :func:`read_dump`."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dumpquarry import ddl
from dumpquarry.catalog import Catalog, TableDef
from dumpquarry.dialect import bare, detect
from dumpquarry.session import exists, shared_dir, ship
from dumpquarry.sources import files, splits, tokenizer

#: Characters of statement texts that are handed on at once.
BATCH_CHARS = 8 << 20
STATEMENT_SCHEMA = "path string, start long, idx int, kind string, table_name string, text string"


def same_table(a: str | None, b: str) -> bool:
    """Names match whole, or by their last part if one is not qualified."""
    if a is None:
        return False
    a, b = a.lower(), b.lower()
    return a == b or (("." not in a or "." not in b) and a.rpartition(".")[2] == b.rpartition(".")[2])


def split_statements(split: splits.Split, dialect: str, limits: tokenizer.Limits | None = None) -> Iterator[tokenizer.Statement]:
    stream = files.open_text(split.path, split.start, split.end)
    if not split.header:
        yield from tokenizer.statements(stream, dialect, limits)
        return
    # the split begins within the data of a COPY
    inner = tokenizer.Splitter(stream, dialect, limits)
    table = tokenizer.classify(split.header)[1]
    yield tokenizer.Statement(-1, "copy", table, split.header)
    inner.text = "\n"
    i = 0
    for text in inner._copy():
        yield tokenizer.Statement(i, "copy_data", table, text[1:])
        i += 1
    copying = table
    for text in inner.statements():
        i += 1
        if text.startswith("\0"):
            yield tokenizer.Statement(i, "copy_data", copying, text[1:])
            continue
        kind, table = tokenizer.classify(text.strip())
        copying = table if kind == "copy" else copying
        yield tokenizer.Statement(i, kind, table, text.strip())


def _restarted(found: Iterable[tokenizer.Statement]) -> Iterator[tokenizer.Statement]:
    """The statements, with the COPY statement repeated before every block of its data."""
    copying, fresh = None, False
    for s in found:
        if s.kind == "copy":
            copying, fresh = s, True
        elif s.kind == "copy_data":
            if not fresh and copying is not None:
                yield copying
            fresh = False
        yield s


def split_rows(split: splits.Split, dialect: str, table: str, columns: list[str]) -> Iterator[list[str | None]]:
    """Rows of one table in the order of ``columns``, values as texts; columns a statement does not name are None."""
    place = {c.lower(): i for i, c in enumerate(columns)}
    width = len(columns)
    header: list[str] | None = None
    for s in split_statements(split, dialect):
        if s.kind == "copy":
            header = tokenizer.copy_columns(s.text)
        if s.kind not in ("insert", "copy_data") or not same_table(s.table, table):
            continue
        if s.kind == "insert":
            given, rows = tokenizer.insert_rows(s.text, dialect)
        else:
            given, rows = header, tokenizer.copy_rows(s.text, len(header) if header else width)
        if given is None or [g.lower() for g in given] == list(place):
            for row in rows:
                yield row if len(row) == width else (row + [None] * width)[:width]
        else:
            to = [place.get(g.lower()) for g in given]
            for row in rows:
                out: list[str | None] = [None] * width
                for i, v in zip(to, row):
                    if i is not None:
                        out[i] = v
                yield out


def _clean(v: str | None) -> str | None:
    return v if v is None or v.isascii() else v.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _array(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except (UnicodeEncodeError, pa.ArrowException):
        return pa.array([_clean(v) for v in values], pa.string())


def _copied(data: str, width: int) -> list[pa.Array] | None:
    """COPY lines by column, parsed by Arrow; None where they must be read line by line."""
    try:
        raw = data.encode("utf-8")
        table = pacsv.read_csv(
            pa.BufferReader(raw),
            read_options=pacsv.ReadOptions(column_names=[str(i) for i in range(width)], block_size=max(1 << 20, len(raw) + 1), use_threads=False),
            parse_options=pacsv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False, newlines_in_values=False),
            convert_options=pacsv.ConvertOptions(column_types={str(i): pa.string() for i in range(width)}, strings_can_be_null=True, null_values=["\\N"], quoted_strings_can_be_null=False),
        )
    except (UnicodeEncodeError, pa.ArrowException):
        return None
    out = []
    for column in table.columns:
        values = column.combine_chunks()
        if pc.any(pc.match_substring(values, "\\")).as_py():
            values = pa.array([v if v is None or "\\" not in v else tokenizer.copy_text(v) for v in values.to_pylist()], pa.string())
        out.append(values)
    return out


#: Stand-ins: for ", " between values, for the end of a row, for escaped backslashes and quotes. Texts that hold them are read value by value.
_COMMA, _ROW, _BACKSLASH, _QUOTE = "\x03", "\x02", "\x04", "\x05"
_ROW_ENDS = re.compile(r"\)\s*,\s*\(")


def _inserted(statement: str, dialect: str) -> tuple[list[str] | None, list[pa.Array]] | None:
    """Column list and values by column of an INSERT of plain literals, parsed by Arrow as a CSV text; None where it holds others.

    Ends of rows become a field and a line break of their own, everywhere; where that happened within a literal it is
    undone in the parsed columns.
    """
    head = tokenizer.insert_head(statement)
    if not head:
        return None
    given, at = head
    text = statement[at:].rstrip().rstrip(";").rstrip()
    if text[:1] != "(" or text[-1:] != ")" or any(c in text for c in "\0\x01\x02\x03\x04\x05"):
        return None
    escaped = "\\" in text
    if escaped and dialect == "mysql":
        text = text.replace("\\\\", _BACKSLASH).replace("\\'", _QUOTE)
    parts = text.split("'")
    if not len(parts) & 1:
        return None
    outside = "\0".join(parts[::2])
    end = _ROW_ENDS.search(outside)
    row_end = end[0] if end else "),("
    bare_text = outside.replace(row_end, "\0")
    spaced = ", " in bare_text
    left = bare_text[1:-1].encode("utf-8", "replace")
    commas = left.count(b",")
    if spaced and left.count(b", ") != commas:
        return None
    # what stands outside of literals must be numbers, NULL and commas
    rest = left.replace(b", " if spaced else b",", b"").replace(b"NULL", b"").translate(None, b"0123456789+-.eE\0")
    if rest or b"--" in left or b"E\0" in left or b"e\0" in left:
        return None
    try:
        raw = (text[1:-1].replace(row_end, f"{_COMMA if spaced else ','}{_ROW}\n")).replace(", ", _COMMA).encode() if spaced else text[1:-1].replace(row_end, f",{_ROW}\n").encode()
        raw += f"{_COMMA if spaced else ','}{_ROW}".encode()
        first = pacsv.read_csv(
            pa.BufferReader(raw),
            read_options=pacsv.ReadOptions(autogenerate_column_names=True, block_size=len(raw) + 1, use_threads=False),
            parse_options=pacsv.ParseOptions(delimiter=_COMMA if spaced else ",", quote_char="'", double_quote=True, escape_char=False, newlines_in_values=True),
            convert_options=_texts(outside, row_end, ", " if spaced else ","),
        )
    except (UnicodeEncodeError, pa.ArrowException):
        return None
    inside_row, inside_comma = text.count(row_end) > outside.count(row_end), spaced and text.count(", ") > outside.count(", ")
    comma = _COMMA if spaced else ","
    columns = []
    for column in first.columns[:-1]:
        values = column.combine_chunks()
        if inside_row:
            values = pc.replace_substring(values, f"{comma}{_ROW}\n", row_end)
        if inside_comma:
            values = pc.replace_substring(values, _COMMA, ", ")
        if escaped and dialect == "mysql":
            values = _unescaped(values)
        columns.append(values)
    return (given, columns) if first.num_rows == outside.count(row_end) + 1 else None


def _texts(outside: str, row_end: str, comma: str) -> pacsv.ConvertOptions:
    """All columns as texts, as many as the first row has, with unquoted NULL as null."""
    width = outside.split(row_end, 1)[0].count(comma) + 2
    return pacsv.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(width)}, strings_can_be_null=True, null_values=["NULL"], quoted_strings_can_be_null=False)


def _unescaped(values: pa.Array) -> pa.Array:
    """MySQL literals without their escapes."""
    if pc.any(pc.match_substring(values, "\\")).as_py():
        values = pa.array([v if v is None or "\\" not in v else tokenizer.unbackslashed(v) for v in values.to_pylist()], pa.string())
    for mark, said in ((_BACKSLASH, "\\"), (_QUOTE, "'")):
        if pc.any(pc.match_substring(values, mark)).as_py():
            values = pc.replace_substring(values, mark, said)
    return values


def split_batches(split: splits.Split, dialect: str, table: str, columns: list[str], wanted: list[str]) -> Iterator[pa.RecordBatch]:
    """One table's rows as Arrow batches of texts, of the columns wanted. Plain INSERT and COPY blocks are decoded by column, others row by row."""
    place = {c.lower(): i for i, c in enumerate(columns)}
    schema = pa.schema([(w, pa.string()) for w in wanted])
    header: list[str] | None = None
    for s in split_statements(split, dialect):
        if s.kind == "copy":
            header = tokenizer.copy_columns(s.text)
        if s.kind not in ("insert", "copy_data") or not same_table(s.table, table):
            continue
        given, arrays, n = header, None, 0
        if s.kind == "copy_data":
            width = len(header) if header else len(columns)
            arrays = _copied(s.text, width) if width > 1 else None
            rows = None if arrays is not None else list(tokenizer.copy_rows(s.text, width))
        elif found := _inserted(s.text, dialect) or tokenizer.insert_columns(s.text, dialect):
            given, values = found
            arrays, rows = values, None
        else:
            given, lazy = tokenizer.insert_rows(s.text, dialect)
            rows = list(lazy)
        if arrays is None:
            most = max(map(len, rows), default=0)
            arrays = [list(c) for c in zip(*[r if len(r) == most else r + [None] * (most - len(r)) for r in rows])]
        n = len(arrays[0]) if arrays else 0
        if not n:
            continue
        names = [g.lower() for g in given] if given is not None else list(place)
        at = {name: i for i, name in enumerate(names) if i < len(arrays)}
        out = []
        for w in wanted:
            i = at.get(w.lower())
            out.append(pa.nulls(n, pa.string()) if i is None else arrays[i] if isinstance(arrays[i], pa.Array) else _array(arrays[i]))
        yield pa.RecordBatch.from_arrays(out, schema=schema)


@dataclass
class _Part(InputPartition):
    split: splits.Split


class _Reader(DataSourceReader):
    def __init__(self, parts: list[splits.Split], dialect: str, table: str, columns: list[str], wanted: list[str]) -> None:
        self.parts, self.dialect, self.table, self.columns, self.wanted = parts, dialect, table, columns, wanted

    def partitions(self):
        return [_Part(s) for s in self.parts]

    def read(self, partition):
        yield from split_batches(partition.split, self.dialect, self.table, self.columns, self.wanted)


class SqlDumpSource(DataSource):
    """``spark.read.format("sqldump").option("table", "users").load(path)``: one table of a dump, all columns as text.

    Options: table (required), dialect (else detected), columns (JSON list, the table's columns in file order; else
    from the DDL). A given schema selects columns by name. A file is one partition; :func:`read_dump` cuts files.
    """

    @classmethod
    def name(cls) -> str:
        return "sqldump"

    def _paths(self) -> list[str]:
        paths = self.options.get("paths") or self.options.get("path")
        return files.expand(json.loads(paths) if paths.startswith("[") else paths)

    def _dialect(self) -> str:
        return self.options.get("dialect") or detect(files.open_text(self._paths()[0]).read(8192)).dialect

    def _columns(self) -> list[str]:
        if given := self.options.get("columns"):
            return json.loads(given)
        texts = [s.text for p in self._paths() for s in tokenizer.statements(files.open_text(p), self._dialect()) if s.kind == "create_table"]
        table = ddl.build_catalog(texts).get(self.options["table"])
        if table is None:
            raise ValueError(f"no table {self.options['table']} in the dump")
        return [c.name for c in table.columns]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self._columns()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        parts = [splits.Split(p, 0, -1) for p in self._paths()]
        return _Reader(parts, self._dialect(), self.options["table"], self._columns(), [f.name for f in schema])


def typed(df: DataFrame, table: TableDef, columns: Sequence[str] | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Text columns (all, or those named) cast to the table's types inside the JVM; what does not fit its type becomes null. ``extra`` columns are added."""
    out = []
    for c in table.columns if columns is None else [table.column(n) for n in columns]:
        value, kind = F.col(f"`{c.name}`"), c.spark
        if isinstance(kind, T.BinaryType):
            value = F.when(value.startswith("\\x"), F.unhex(F.substring(value, 3, 1 << 30))).otherwise(F.encode(value, "utf-8"))
        elif isinstance(kind, T.BooleanType):
            value = F.when(F.lower(value).isin("1", "t", "true", "y", "yes", "\\x01"), True).when(F.lower(value).isin("0", "f", "false", "n", "no", "\\x00", "\x00"), False)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = F.coalesce(value.try_cast(kind), value.try_cast("decimal(38,6)").try_cast(kind))
        elif not isinstance(kind, T.StringType):
            value = value.try_cast(kind)
        out.append(value.alias(c.name))
    return df.select(*out, *extra)


#: What an index entry holds: of a split its tables (``kind`` is "split", ``text`` a JSON list), or a DDL statement.
_INDEX = "n long, idx int, kind string, text string"


class Dump:
    """One or more dump files as a set of tables.

    Planning scans uncompressed files once, in parallel, and notes the tables of every split; files that are read whole
    are indexed in one pass when the catalog is first asked for. From then on a table is read only from the splits that
    hold it, and only its statements, and of them only the columns asked for, are decoded.
    """

    def __init__(self, spark: SparkSession, paths: list[str], dialect: str | None = None, split_bytes: int = splits.SPLIT_BYTES) -> None:
        self.spark, self.paths = spark, paths
        ship(spark)
        self.detection = detect(files.open_text(paths[0]).read(8192))
        self.dialect = dialect or self.detection.dialect
        self.splits = splits.plan(spark, paths, self.dialect, split_bytes)
        spark.dataSource.register(SqlDumpSource)

    def statements(self, text: bool = True, kinds: tuple[str, ...] = (), whole_copies: bool = False) -> DataFrame:
        """Every statement (of the ``kinds``, all if none are named): path, start (of its split), idx, kind, table_name, text (or its length in bytes with ``text=False``).

        The partitions, and the rows in each, are in the order of the files and of the statements in them. The data of a
        COPY may come in several blocks; with ``whole_copies`` each follows its COPY statement, which is then repeated,
        so that the statements can be written again one by one.
        """
        dialect, parts = self.dialect, splits.Splits(self.spark, self.splits)
        schema = STATEMENT_SCHEMA if text else STATEMENT_SCHEMA.replace("text string", "n_rows long, n_bytes long")
        arrow_types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        arrow = pa.schema([(f.split()[0], arrow_types[f.split()[1]]) for f in schema.split(", ")])

        def run(batches):
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    part = parts[n]
                    block: list[dict] = []
                    held = 0
                    for s in _restarted(split_statements(part, dialect)) if whole_copies else split_statements(part, dialect):
                        if (kinds and s.kind not in kinds) or (s.index < 0 and not whole_copies):
                            continue
                        entry = {"path": part.path, "start": part.start, "idx": s.index, "kind": s.kind, "table_name": s.table}
                        if text:
                            entry["text"] = _clean(s.text)
                        else:
                            entry["n_bytes"] = len(s.text.encode("utf-8", "surrogateescape"))
                            entry["n_rows"] = sum(1 for _ in tokenizer.insert_rows(s.text, dialect)[1]) if s.kind == "insert" else sum(1 for _ in tokenizer.copy_rows(s.text)) if s.kind == "copy_data" else 0
                        block.append(entry)
                        held += len(s.text) if text else 0
                        if len(block) >= 500 or held > BATCH_CHARS:
                            yield pa.RecordBatch.from_pylist(block, schema=arrow)
                            block, held = [], 0
                    if block:
                        yield pa.RecordBatch.from_pylist(block, schema=arrow)

        return parts.ids().mapInArrow(run, schema)

    @cached_property
    def _index(self) -> tuple[Catalog, list[splits.Split]]:
        """The catalog, and the splits with their tables: one pass over the splits with DDL and over files whose tables are not known yet."""
        at = [i for i, s in enumerate(self.splits) if s.has_ddl or s.tables is None]
        dialect, parts = self.dialect, splits.Splits(self.spark, [self.splits[i] for i in at])

        def run(batches):
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    rows, names = [], set()
                    for s in split_statements(parts[n], dialect):
                        if s.table:
                            names.add(s.table.lower())
                        if s.kind in splits.DDL_KINDS:
                            rows.append((n, s.index, s.kind, _clean(s.text)))
                    rows.append((n, -1, "split", json.dumps(sorted(names))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["n", "idx", "kind", "text"])

        rows = sorted(parts.ids().mapInArrow(run, _INDEX).collect()) if at else []  # DDL, and one row per split
        known = list(self.splits)
        for r in rows:
            if r.kind == "split":
                known[at[r.n]] = replace(known[at[r.n]], tables=tuple(json.loads(r.text)))
        return ddl.build_catalog(r.text for r in rows if r.kind != "split"), known

    @property
    def catalog(self) -> Catalog:
        """From the DDL in all files; only DDL statements come to the driver."""
        return self._index[0]

    def splits_of(self, name: str) -> list[splits.Split]:
        """The splits in which statements of a table may begin."""
        return [s for s in self._index[1] if s.tables is None or any(same_table(t, name) for t in s.tables)]

    def raw(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A table (or some of its columns) with all values as text."""
        table = self.catalog.get(name)
        if table is None:
            raise ValueError(f"no table {name} in the dump")
        every = [c.name for c in table.columns]
        wanted = every if columns is None else [table.column(c).name for c in columns]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
        parts, dialect, own = splits.Splits(self.spark, self.splits_of(table.name)), self.dialect, table.name
        if not parts.size:
            return self.spark.createDataFrame([], schema)

        def run(batches):
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    yield from split_batches(parts[n], dialect, own, every, wanted)

        run.__name__ = f"table_{self.catalog.names().index(table.name)}"
        return parts.ids().mapInArrow(run, schema)

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A table (or some of its columns) with the types of its DDL; what does not fit its type is null, see :meth:`misfits`."""
        return typed(self.raw(name, columns), self.catalog.get(name), columns)

    def misfits(self, name: str) -> DataFrame:
        """Values that do not fit their column's type and are null in :meth:`table`: column_name, n, example (the smallest one)."""
        table = self.catalog.get(name)
        raw = self.raw(name)
        named = [F.col(f"`{c.name}`").alias(f"_raw{i}") for i, c in enumerate(table.columns)]
        both = typed(raw, table, extra=named)
        lost = [(c.name, F.when(F.col(f"`{c.name}`").isNull(), F.col(f"_raw{i}"))) for i, c in enumerate(table.columns)]
        counted = both.agg(*[F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.min(v).alias("example")).alias(f"x{i}") for i, (c, v) in enumerate(lost)])
        return counted.select(F.inline(F.array(*[f"x{i}" for i in range(len(lost))]))).where("n > 0")

    def key(self, tables: Iterable[str] = ()) -> str:
        """Of the files' paths, sizes and times, the tables and the dialect."""
        stamps = [(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) for p in map(files.local, self.paths)]
        return hashlib.sha256(json.dumps([stamps, sorted(tables), self.dialect]).encode()).hexdigest()[:24]

    def cached(self, folder: str | None = None, tables: Iterable[str] = ()) -> dict[str, DataFrame]:
        """The tables as Parquet in ``folder`` (else in the shared folder's ``cache``), written on first use and read from then on, until a file changes.

        A table counts as there only once its write was committed: a folder without the mark of a finished write is written anew.
        """
        names = [t.name for t in self.catalog if not list(tables) or any(same_table(t.name, x) for x in tables)]
        base = f"{folder or shared_dir(self.spark) + '/dumpquarry/cache'}/{self.key()}"
        out = {}
        for n in names:
            path = f"{base}/{n}"
            schema = self.catalog.get(n).schema
            if not exists(self.spark, f"{path}/_SUCCESS"):
                self.table(n).write.mode("overwrite").parquet(path)
            out[n] = self.spark.read.schema(schema).parquet(path)
        return out

    def register(self, tables: Iterable[str] = (), cache: str | None = None, columns: Mapping[str, Sequence[str]] | None = None) -> list[str]:
        """Temporary views of the tables (with ``columns``: of some of their columns), by their bare names."""
        names = [t.name for t in self.catalog if not list(tables) or any(same_table(t.name, x) for x in tables)]
        frames = self.cached(cache, tables) if cache else {n: self.table(n, (columns or {}).get(n)) for n in names}
        for n, df in frames.items():
            df.createOrReplaceTempView(bare(n))
        return sorted(bare(n) for n in frames)

    def query(self, sql: str, run: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
        """SQL over the tables' views. The optimised plan tells the columns it needs of each table, and only these are decoded."""
        run = run or (lambda spark, text: spark.sql(text))
        self.register()
        needed = self.needed(run(self.spark, sql))
        self.register(tables=list(needed) or (), columns=needed)
        found = run(self.spark, sql)
        self.register(tables=list(needed) or ())
        return found

    def needed(self, df: DataFrame) -> dict[str, list[str]]:
        """The columns that a plan over :meth:`raw` tables refers to, by table; the first one where only rows are counted."""
        plan = df._jdf.queryExecution().optimizedPlan()
        names = self.catalog.names()
        used: set[int] = set()
        leaves: list[tuple[str, list[tuple[int, str]]]] = []

        def attributes(seq) -> list[tuple[int, str]]:
            return [(a.exprId().id(), a.name()) for a in (seq.apply(i) for i in range(seq.size()))]

        def walk(node) -> None:
            if node.nodeName() == "MapInArrow" and (m := re.match(r"table_(\d+)\(", node.productElement(0).toString())):
                leaves.append((names[int(m[1])], attributes(node.output())))
                return
            used.update(i for i, _ in attributes(node.references().toSeq()))
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        used.update(i for i, _ in attributes(plan.output()))
        walk(plan)
        out: dict[str, set[str]] = {}
        for name, columns in leaves:
            out.setdefault(name, set()).update(c for i, c in columns if i in used)
        return {n: [c.name for c in self.catalog.get(n).columns if c.name in cs] or [self.catalog.get(n).columns[0].name] for n, cs in out.items()}


def read_dump(spark: SparkSession, paths: str | Iterable[str], dialect: str | None = None, split_bytes: int = splits.SPLIT_BYTES) -> Dump:
    """Dump files by path, glob or folder; the first file's head tells the dialect unless it is given."""
    return Dump(spark, files.expand(paths), dialect, split_bytes)
