"""Safe places at which one dump file can be cut, found in parallel.

Whether a byte lies in a string, a comment or COPY data depends on all bytes before it. Each block of the file is
therefore scanned from every state in which it may begin, side by side on the executors; the driver then only follows
the states from block to block, a few bytes per block, and knows where each block's first whole statement begins. It
opens no file itself. The scan also tells the tables whose statements begin in a block, so that a table is read from
the splits that hold it, and the DDL from those that hold DDL.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from dumpquarry.session import staging_path

from dumpquarry.sources import files, tokenizer

SPLIT_BYTES = 64 << 20
#: Partitions a dump is read in at most; more splits share one, neighbours together.
MAX_PARTITIONS = 10_000
#: Splits that travel with a query; more lie in the shared folder, in files of so many.
SPLITS_PER_FILE = 1000
#: Bytes of a statement that are looked at for its kind before the whole of it is.
HEAD_BYTES = 4096
#: Bytes read beyond a block for the head of its last statement.
AHEAD_BYTES = 64 << 10
DDL_KINDS = frozenset(("create_table", "alter_table", "create_index"))
#: States in which a block can begin: a statement or between two; in one of the quotes (e: one with backslashes); in a comment; in COPY data.
STATES = ("n", "'", "e", '"', "`", "]", "*", "c")


@dataclass(frozen=True)
class Split:
    """Bytes [start, end) of a file (end -1: the whole, perhaps compressed, file); ``header`` is the COPY statement in whose data it begins.

    ``tables`` are those whose statements may begin in it, in lower case (None: not known), ``has_ddl`` whether it may hold DDL.
    """

    path: str
    start: int
    end: int
    header: str = ""
    tables: tuple[str, ...] | None = None
    has_ddl: bool = True


class Heads:
    """The tables and kinds of the statements that begin in a block. ``unknown`` is set where a head could not be read whole."""

    _INSERT = re.compile(rb"\s*((?:INSERT|REPLACE)[ \t]+(?:INTO[ \t]+)?[^\s(]+)[\s(]", re.I)
    _LINES = re.compile(rb"^[ \t]*(?:INSERT|CREATE|ALTER|DROP)\b", re.I | re.M)

    _DELIMITER = re.compile(r"^[ \t]*DELIMITER[ \t]+\S+[^\n]*$", re.I | re.M)

    def __init__(self) -> None:
        self.tables: set[str] = set()
        self.ddl = self.unknown = False
        self._seen: set[bytes] = set()

    def add(self, block: bytes, a: int, b: int, cut: bool = False) -> None:
        """The statement in ``block[a:b]``; ``cut`` if it may go on beyond."""
        m = self._INSERT.match(block, a, min(b, a + HEAD_BYTES))
        if m:
            if m[1] in self._seen:
                return
            self._seen.add(m[1])
        text = block[a : min(b, a + HEAD_BYTES)].decode("utf-8", "replace")
        kind, table = tokenizer.classify(text.strip())
        if kind in ("unknown", "copy") and b - a > HEAD_BYTES:
            kind, table = tokenizer.classify(block[a:b].decode("utf-8", "replace").strip())
        if kind == "unknown" and cut and (m := self._DELIMITER.search(text)):  # such a line comes between statements
            kind, table = tokenizer.classify(text[m.end() :].strip())
        if kind == "unknown" and cut and b - a >= AHEAD_BYTES:
            self.unknown = True
        self.ddl |= kind in DDL_KINDS
        if table:
            self.tables.add(table.lower())

    def lines(self, block: bytes, a: int, b: int) -> None:
        """Every line that may begin a statement: scripts of batches end statements with their line."""
        for m in self._LINES.finditer(block, a, b):
            self.add(block, m.start(), min(b, m.start() + 1000))


_SKIP = re.compile(rb"(?:[^'\"`\[;#/$\n\-]+|\n(?![ \t]*(?:[Dd][Ee][Ll]|[Gg][Oo]))|'[^'\\]*'(?!'))*+")
_TOKEN = {d: re.compile(rb"['\"`\[;]|--|#|/\*|\$[A-Za-z_0-9]*\$|^[ \t]*DELIMITER[ \t]+(\S+)[^\n]*", re.M | re.I) for d in ("mysql", "postgres", "sqlite", "mssql")}

_TOKEN["mssql"] = re.compile(_TOKEN["mssql"].pattern + rb"|^[ \t]*GO[ \t]*\r?$", re.M | re.I)


def scan(block: bytes, state: str, dialect: str, heads: Heads | None = None, at_start: bool = False, ahead: bytes = b"") -> tuple[str, int, str]:
    """From a state through a block: the state at its end, where the first statement that begins in it starts (-1: none), the open COPY's header.

    States beyond :data:`STATES`: ``d`` and a tag within a dollar quote, ``n`` and a delimiter that is not the usual one.
    ``heads`` collects the tables of the statements that begin in the block (``at_start``: one begins with it), of which
    the last may have its head in ``ahead``, the bytes that follow.
    """
    found = _scan(block, state, dialect, heads, at_start)
    if heads is not None:
        ended, first, header, began = found
        begins = 0 if at_start else first
        if begins >= 0 and ended[0] != "c" and began >= begins:
            rest = block[began:] if len(block) - began > AHEAD_BYTES else block[began:] + ahead
            heads.add(rest, 0, len(rest), cut=True)
        if dialect == "mssql":
            heads.lines(block + ahead, 0, len(block) + len(ahead))
    return found[:3]


def _scan(block: bytes, state: str, dialect: str, heads: Heads | None, at_start: bool) -> tuple[str, int, str, int]:
    i, n, first, header, began = 0, len(block), -1, "", 0
    delimiter = b";"
    if state[0] == "n" and len(state) > 1:
        delimiter, state = state[1:].encode(), "n"
    mysql = dialect == "mysql"
    closing = {"'": rb"'(?!')|''" + (rb"|\\." if mysql else b""), '"': rb'"(?!")|""' + (rb"|\\." if mysql else b""), "`": rb"`(?!`)|``", "]": rb"\](?!\])|\]\]", "e": rb"'(?!')|''|\\."}
    while i <= n:
        if state == "c":
            m = re.compile(rb"^\\\.\r?$", re.M).search(block, i)
            if not m:
                return "c", first, header, began
            i, state = min(m.end() + 1, n), "n"
            began = i
            if first < 0:
                first = i
            continue
        if state[0] == "d":
            at = block.find(state[1:].encode(), i)
            if at < 0:
                return state, first, header, began
            i, state = at + len(state) - 1, "n"
            continue
        if state == "*":
            at = block.find(b"*/", i)
            if at < 0:
                return "*", first, header, began
            if i == 0:  # a comment that goes on from the block before is no part of a statement's text
                began = at + 2
            i, state = at + 2, "n"
            continue
        if state in closing:
            pattern = re.compile(closing[state], re.S)
            while m := pattern.search(block, i):
                i = m.end()
                if len(m[0]) == 1:
                    break
            if not m:
                return state, first, header, began
            state = "n"
            continue
        pattern = _TOKEN[dialect] if delimiter == b";" else re.compile(rb"['\"`]|--|#|/\*|^[ \t]*DELIMITER[ \t]+(\S+)[^\n]*|" + re.escape(delimiter), re.M | re.I)
        if delimiter == b";" and i:  # at the block's start a line may begin
            i = _SKIP.match(block, i).end()
        m = pattern.search(block, i)
        if not m:
            break
        token, i = m[0], m.end()
        if token == delimiter:
            if heads is not None and (at_start or first >= 0):
                heads.add(block, began, m.start())
            if dialect == "postgres" and not Heads._INSERT.match(block, began, m.start()):
                statement = block[began : m.start()].decode("utf-8", "replace").lstrip()
                if tokenizer.classify(statement)[0] == "copy":
                    state, header = "c", statement.strip()
                    line = block.find(b"\n", i)
                    i = line + 1 if line >= 0 else n
            began = i
            if first < 0 and state != "c":  # no statement begins where the data of a COPY does
                first = i
        elif dialect == "mssql" and token.strip().upper() == b"GO":
            if heads is not None and (at_start or first >= 0):
                heads.add(block, began, m.start())
            began = i
            if first < 0:
                first = i
        elif m.lastindex and mysql:
            delimiter, began = m[1], i
        elif token in (b"'", b'"', b"`"):
            state = token.decode()
            if token == b"'" and dialect == "postgres" and block[max(0, m.start() - 1) : m.start()] in (b"E", b"e") and not block[max(0, m.start() - 2) : m.start() - 1].isalnum():
                state = "e"
        elif token == b"[":
            state = "]" if dialect in ("mssql", "sqlite") else "n"
        elif token in (b"--", b"#"):
            if (token == b"#" and not mysql) or (token == b"--" and mysql and block[i : i + 1] not in (b" ", b"\t", b"\n", b"\r", b"")):
                continue
            line = block.find(b"\n", i)
            i = n if line < 0 else line
        elif token == b"/*":
            state = "*"
        elif token.startswith(b"$") and dialect == "postgres" and not block[m.start() - 1 : m.start()].isalnum():
            state = "d" + token.decode()
    return ("n" if delimiter == b";" else "n" + delimiter.decode()), first, header, began


def _block(path: str, start: int, size: int) -> tuple[int, bytes, bytes]:
    """The whole lines that begin in [start, start + size): where they begin, they themselves, and some of what follows."""
    with open(files.local(path), "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()
        at = f.tell()
        data = f.read(max(0, start + size - at))
        data += f.readline() if data and not data.endswith(b"\n") else b""
        return at, data, f.read(AHEAD_BYTES)


_FOUND = "n long, state string, ends string, begin long, first long, header string, tables string, has_ddl boolean"


def plan(spark: SparkSession, paths: list[str], dialect: str, split_bytes: int = SPLIT_BYTES) -> list[Split]:
    """Splits of all files: compressed and small files whole, others cut about every ``split_bytes``, in the order of the files and of the bytes in them."""
    blocks: list[tuple[str, int]] = []
    sizes = {p: 0 if files.is_compressed(p) else os.path.getsize(files.local(p)) for p in paths}
    for p in paths:
        if sizes[p] > split_bytes:
            blocks += [(p, s) for s in range(0, sizes[p], split_bytes)]
    found: dict[tuple[int, str], tuple] = {}

    def pass_over(states: tuple[str, ...], some: range) -> None:
        """Scan blocks from the states, on the executors."""
        listed = Listing(spark, [(p, s) for p, s in blocks[some.start : some.stop]])
        first_n = some.start

        def examine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for n in batch["id"].tolist():
                    p, s = listed[n]
                    begin, data, ahead = _block(p, s, split_bytes)
                    rows = []
                    for state in states:
                        heads = Heads()
                        ends, first, header = scan(data, state, dialect, heads, s == 0, ahead)
                        rows.append((n + first_n, state, ends, begin, first, header, None if heads.unknown else json.dumps(sorted(heads.tables)), heads.ddl or heads.unknown))
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

        for r in listed.ids().mapInPandas(examine, _FOUND).collect():  # some 100 bytes a block
            found[r.n, r.state] = r[2:]

    if blocks:
        # lines seldom begin within a string or comment, so those states are only scanned from if a block needs one
        usual = ("n", "c") if dialect == "postgres" else ("n",)
        pass_over(usual, range(len(blocks)))
    whole = False
    out: list[Split] = []
    n = 0
    for p in paths:
        if sizes[p] <= split_bytes:
            out.append(Split(p, 0, -1))
            continue
        state, header, starts, window = "n", "", [], 1
        for s in range(0, sizes[p], split_bytes):
            if (n, state) not in found:
                if state in STATES and not whole:
                    pass_over(tuple(x for x in STATES if x not in usual), range(len(blocks)))
                    whole = True
                else:  # within a dollar quote or under another delimiter: the blocks that follow, twice as many each time
                    pass_over((state,), range(n, min(len(blocks), n + window)))
                    window *= 2
            ends, begin, first, opened, tables, has_ddl = found[n, state]
            held = None if tables is None else set(json.loads(tables))
            if starts and (dialect == "mssql" or (state != "c" and first < 0)):
                # statements that end with their line may begin before the block's first place to cut
                before = starts[-1]
                before[2] = None if held is None or before[2] is None else before[2] | held
                before[3] |= has_ddl
            if state == "c":
                copying = tokenizer.classify(header)[1]
                starts.append([begin, header, None if held is None or copying is None else held | {copying.lower()}, has_ddl])
            elif s == 0 or first >= 0:
                starts.append([begin + max(0, first) if s else 0, "", held, has_ddl])
            # a COPY that begins within the block has data that the next blocks go on with
            state, header = ends, opened or header
            n += 1
        ends_at = [a for a, *_ in starts[1:]] + [sizes[p]]
        for (a, h, t, d), e in zip(starts, ends_at):
            if a < e:
                out.append(Split(p, a, e, h, None if t is None else tuple(sorted(t)), d))
    return out


class Listing:
    """A list whose entries tasks look up by number; a long one lies in the shared folder, in pieces, so that no task carries it whole."""

    def __init__(self, spark: SparkSession, entries: list) -> None:
        self.spark, self.size = spark, len(entries)
        self.folder, self.entries = None, entries
        path = files.local(staging_path(spark, "listing")) if self.size > SPLITS_PER_FILE else ""
        if path and "://" not in path:
            Path(path).mkdir(parents=True)
            for i in range(0, self.size, SPLITS_PER_FILE):
                Path(path, f"{i // SPLITS_PER_FILE}.json").write_text(json.dumps(entries[i : i + SPLITS_PER_FILE]), encoding="utf-8")
            self.folder, self.entries = path, []

    def __getstate__(self) -> dict:
        return {**self.__dict__, "spark": None}

    def __getitem__(self, n: int):
        return _listed(self.folder, n // SPLITS_PER_FILE)[n % SPLITS_PER_FILE] if self.folder else self.entries[n]

    def ids(self) -> DataFrame:
        """Their numbers, ``id``, in order over the partitions."""
        return self.spark.range(0, self.size, 1, max(1, min(self.size, MAX_PARTITIONS)))


@lru_cache(4)
def _listed(folder: str, piece: int) -> list:
    return json.loads(Path(folder, f"{piece}.json").read_text(encoding="utf-8"))


class Splits:
    """The splits of a dump, or some of them, for tasks that read them by number."""

    def __init__(self, spark: SparkSession, parts: Iterable[Split]) -> None:
        self._listing = Listing(spark, [list(asdict(s).values()) for s in parts])
        self.size = self._listing.size

    def __getitem__(self, n: int) -> Split:
        path, start, end, header, tables, has_ddl = self._listing[n]
        return Split(path, start, end, header, None if tables is None else tuple(tables), has_ddl)

    def ids(self) -> DataFrame:
        return self._listing.ids()
