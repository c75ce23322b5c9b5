"""Dump text to statements and rows, in bounded memory."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TextIO

from dumpquarry.ddl import IDENT, NAME
from dumpquarry.dialect import unquote

BLOCK_CHARS = 1 << 20


@dataclass(frozen=True)
class Limits:
    """A statement or COPY line of more characters is an error, so that a broken quote cannot fill the memory."""

    statement_chars: int = 1 << 28
    line_chars: int = 1 << 28


@dataclass(frozen=True)
class Statement:
    index: int
    kind: str  # create_table, insert, create_index, alter_table, drop_table, copy, copy_data, unknown
    table: str | None
    text: str


_KINDS = (
    ("create_table", re.compile(rf"CREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})", re.I)),
    ("insert", re.compile(rf"(?:INSERT|REPLACE)\s+(?:LOW_PRIORITY\s+|DELAYED\s+|HIGH_PRIORITY\s+|IGNORE\s+)*(?:OR\s+\w+\s+)?(?:INTO\s+)?(?:ONLY\s+)?({NAME})", re.I)),
    ("create_index", re.compile(rf"CREATE\s+(?:UNIQUE\s+|NONCLUSTERED\s+|CLUSTERED\s+|FULLTEXT\s+)*INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s+ON\s+(?:ONLY\s+)?({NAME})", re.I)),
    ("alter_table", re.compile(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?(?:IF\s+EXISTS\s+)?({NAME})", re.I)),
    ("drop_table", re.compile(rf"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?({NAME})", re.I)),
    ("copy", re.compile(rf"COPY\s+({NAME})\s*(?:\([^)]*\))?\s*FROM\s+stdin", re.I)),
)
_LEADING = re.compile(r"(?:\s+|--[^\n]*(?:\n|\Z)|#[^\n]*(?:\n|\Z)|/\*(?!!).*?\*/|/\*!\d*\s?(?=\s*(?:CREATE|INSERT|ALTER|DROP)))*", re.S | re.I)
_NEXT = re.compile(r"['\"`\[;]|--|#|/\*|\$[A-Za-z_0-9]*\$|\n")
#: Ordinary text and simple string literals, passed over in one step.
_SKIP = re.compile(r"(?:[^'\"`\[;#/$\n\-]+|'[^'\\]*'(?!'))*+")
_GO = re.compile(r"[ \t]*GO[ \t]*(?:--[^\n]*)?\r?(?:\n|\Z)", re.I)
_LINE_STATEMENT = re.compile(r"[ \t]*(?:INSERT|SET)\b", re.I)
_DELIMITER = re.compile(r"[ \t]*DELIMITER[ \t]+(\S+)[ \t]*\r?(?:\n|\Z)", re.I)
_CLOSING = {True: re.compile(r"'(?!')|''|\\.", re.S), False: re.compile(r"'(?!')|''")}


def classify(text: str) -> tuple[str, str | None]:
    """Kind and table (qualified, unquoted) of a statement."""
    start = _LEADING.match(text).end()
    for kind, pattern in _KINDS:
        if m := pattern.match(text, start):
            return kind, unquote(m[1])
    return "unknown", None


class Splitter:
    """Splits a text stream at statement ends, outside of quotes, comments, dollar quotes and COPY data."""

    def __init__(self, stream: TextIO, dialect: str, limits: Limits | None = None) -> None:
        self.stream, self.dialect, self.limits = stream, dialect, limits or Limits()
        self.text, self.pos, self.ended = "", 0, False
        self.delimiter = ";"

    def _more(self) -> bool:
        if self.ended:
            return False
        block = self.stream.read(BLOCK_CHARS)
        if not block:
            self.ended = True
            return False
        self.text = self.text[self.pos :] + block if self.pos else self.text + block
        self.moved, self.pos = self.pos, 0
        return True

    def _find(self, pattern: re.Pattern, at: int, hold: int = 2) -> tuple[re.Match | None, int]:
        """The first match from ``at`` that more text cannot change; reads on as needed. Returns it with the shift of the text."""
        while True:
            m = pattern.search(self.text, at)
            if m and (m.end() + hold <= len(self.text) or self.ended):
                return m, at
            if len(self.text) - self.pos > self.limits.statement_chars:
                raise ValueError(f"a statement exceeds {self.limits.statement_chars} characters")
            keep = m.start() if m else max(at, len(self.text) - 64)
            before = self.pos
            if not self._more():
                return pattern.search(self.text, at), at
            at = max(at, keep) - before

    def statements(self) -> Iterator[str]:
        """Statement texts with their terminator removed; the data of a COPY follows it as the next text."""
        at = self.pos
        backslash = self.dialect == "mysql"
        # the leading blank counts as a line start, for GO and DELIMITER
        fresh = True
        while True:
            if fresh:
                while True:
                    self._ensure(at, 256)
                    at, base = at - self.moved_by, self.pos
                    if self.dialect == "mssql" and (g := _GO.match(self.text, at)):
                        if (s := self.text[self.pos : at]).strip():
                            yield s
                        self.pos = at = g.end()
                        if at >= len(self.text) and self.ended:
                            return
                        continue
                    if self.dialect == "mssql" and _LINE_STATEMENT.match(self.text, at) and _LINE_STATEMENT.match(self.text[self.pos : at].lstrip()):
                        yield self.text[self.pos : at]  # scripts end INSERT and SET with the line alone
                        self.pos = at
                    if self.dialect == "mysql" and (d := _DELIMITER.match(self.text, at)) and not self.text[self.pos : at].strip():
                        self.delimiter = d[1]
                        self.pos = at = d.end()
                        continue
                    break
                fresh = False
            pattern = _NEXT if self.delimiter == ";" else re.compile(rf"['\"`]|--|#|/\*|\n|{re.escape(self.delimiter)}")
            if self.delimiter == ";" and self.dialect != "mssql" and (m := _ROWS_FOLLOW.match(self.text, at)) and not self.text[self.pos : at].strip():
                before = self.pos
                end = self._plain_insert(m.end())
                if end is not None:
                    statement = self.text[self.pos : end]
                    self.pos = at = end + 1
                    yield statement
                    continue
                at -= before - self.pos if self.pos != before else 0
            if self.delimiter == ";" and (skipped := _SKIP.match(self.text, at).end()) < len(self.text) - 2:
                at = skipped
            m, _ = self._find(pattern, at)
            if not m:
                rest = self.text[self.pos :]
                if rest.strip():
                    yield rest
                return
            token, i = m[0], m.end()
            if token == self.delimiter:
                statement = self.text[self.pos : m.start()]
                self.pos = at = i
                if statement.strip():
                    yield statement
                    if self.dialect == "postgres" and classify(statement)[0] == "copy":
                        yield from self._copy()
                        at = self.pos
            elif token == "\n":
                at, fresh = i, True
            elif token == "'":
                e = backslash or (self.dialect == "postgres" and self.text[m.start() - 1 : m.start()] in ("E", "e") and m.start() > 0)
                at = self._past(_CLOSING[e], i, "'")
            elif token in '"`':
                at = self._past(re.compile(rf"{token}(?!{token})|{token}{token}" + (r"|\\." if backslash and token == '"' else ""), re.S), i, token)
            elif token == "[":
                at = self._past(re.compile(r"\](?!\])|\]\]"), i, "]") if self.dialect in ("mssql", "sqlite") else i
            elif token == "--" or token == "#":
                if token == "#" and self.dialect != "mysql" or token == "--" and backslash and self.text[i : i + 1] not in (" ", "\t", "\n", "\r", ""):
                    at = i
                else:
                    end, _ = self._find(re.compile(r"(?=\n)|\Z"), i, 0)
                    at = end.start() if end else len(self.text)
            elif token == "/*":
                end, _ = self._find(re.compile(r"\*/"), i)
                at = end.end() if end else len(self.text)
            elif token.startswith("$"):
                if self.dialect == "postgres" and not (self.text[m.start() - 1 : m.start()].isalnum() and m.start() > 0):
                    end, _ = self._find(re.compile(re.escape(token)), i)
                    at = end.end() if end else len(self.text)
                else:
                    at = i
            else:
                at = i

    def _plain_insert(self, start: int) -> int | None:
        """The end of an INSERT whose values begin at ``start``, by counting quotes between semicolons; None where it holds more than plain literals.

        The place of the statement's begin, :attr:`pos`, is 0 once more text was read.
        """
        open_quote = 0
        while True:
            i = self.text.find(";", start)
            if i < 0:
                if len(self.text) - self.pos > self.limits.statement_chars:
                    raise ValueError(f"a statement exceeds {self.limits.statement_chars} characters")
                shift = self.pos
                if not self._more():
                    return None
                start -= shift
                continue
            part = self.text[start:i]
            if "\\" in part:
                if self.dialect == "mysql":
                    part = part.replace("\\\\", "").replace("\\'", "")
                elif self.dialect == "postgres" and ("E'" in part or "e'" in part):
                    return None
            pieces = part.split("'")
            plain = "".join(pieces[open_quote::2])
            if "--" in plain or "/*" in plain or any(c in plain for c in "#$\"`["):
                return None
            open_quote ^= (len(pieces) - 1) & 1
            if not open_quote:
                return i
            start = i + 1

    moved_by = 0

    def _ensure(self, at: int, n: int) -> None:
        """At least ``n`` characters after ``at``, or the whole rest; ``moved_by`` tells how far the text was shifted."""
        self.moved_by = 0
        while len(self.text) - (at - self.moved_by) < n:
            shift = self.pos
            if not self._more():
                return
            self.moved_by += shift

    def _past(self, pattern: re.Pattern, at: int, closing: str) -> int:
        """The place after the quote that ends here; escaped and doubled ones are passed over."""
        while True:
            m, _ = self._find(pattern, at)
            if not m:
                return len(self.text)
            at = m.end()
            if m[0] == closing:
                return at

    def _copy(self) -> Iterator[str]:
        """The data lines after COPY ... FROM stdin, up to the line that ends them, in blocks of whole lines."""
        m, _ = self._find(re.compile(r"\n"), self.pos, 0)
        self.pos = m.end() if m else len(self.text)
        while True:
            end = re.compile(r"^\\\.\r?$", re.M).search(self.text, self.pos)
            if end and (end.end() < len(self.text) or self.ended):
                yield "\0" + self.text[self.pos : end.start()]
                self.pos = min(end.end() + 1, len(self.text))
                return
            last = self.text.rfind("\n", self.pos, len(self.text) - 3)
            if last - self.pos > BLOCK_CHARS // 2:
                yield "\0" + self.text[self.pos : last + 1]
                self.pos = last + 1
            if len(self.text) - self.pos > self.limits.line_chars:
                raise ValueError(f"a COPY line exceeds {self.limits.line_chars} characters")
            if not self._more():
                if self.text[self.pos :].strip():
                    yield "\0" + self.text[self.pos :]
                self.pos = len(self.text)
                return


def statements(stream: TextIO, dialect: str, limits: Limits | None = None) -> Iterator[Statement]:
    """All statements in order. COPY data comes as ``copy_data`` in blocks of whole lines, under the table of its COPY."""
    copying: str | None = None
    for i, text in enumerate(Splitter(stream, dialect, limits).statements()):
        if text.startswith("\0"):
            yield Statement(i, "copy_data", copying, text[1:])
            continue
        text = text.strip()
        kind, table = classify(text)
        if kind == "copy":
            copying = table
        yield Statement(i, kind, table, text)


# --- rows

_INTO = re.compile(rf"(?:INSERT|REPLACE)\s+(?:LOW_PRIORITY\s+|DELAYED\s+|HIGH_PRIORITY\s+|IGNORE\s+)*(?:OR\s+\w+\s+)?(?:INTO\s+)?({NAME})\s*(\((?:\s*{IDENT}\s*,?)+\))?\s*(?:OVERRIDING\s+\w+\s+VALUE\s*)?VALUES\s*", re.I)
_ROWS_FOLLOW = re.compile(rf"\s*{_INTO.pattern}", re.I)
_STRING = {"mysql": r"'((?:[^'\\]|\\.|'')*)'"}
_PLAIN_STRING = r"'((?:[^']|'')*)'"
_UNESCAPE = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "b": "\b", "Z": "\x1a"}


def _value_pattern(dialect: str) -> re.Pattern:
    string = _STRING.get(dialect, _PLAIN_STRING)
    return re.compile(
        rf"\s*(?:(?P<null>NULL\b)|(?:[Nn]|_\w+\s*)?{string}(?P<cast>::[\w\s\[\]\"().]+)?|(?P<num>[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?=\s*[,)]))"
        rf"|0[xX](?P<hex>[0-9A-Fa-f]*)|[xX]'(?P<hex2>[0-9A-Fa-f]*)'|[bB]'(?P<bits>[01]*)'|[Ee]'(?P<e>(?:[^'\\]|\\.|'')*)'|(?P<bool>TRUE\b|FALSE\b))\s*(?P<end>[,)])",
        re.I | re.S,
    )


_VALUE = {d: _value_pattern(d) for d in ("mysql", "postgres", "sqlite", "mssql")}
_ESCAPE = re.compile(r"\\(.)|''", re.S)


_BACKSLASHED = re.compile(r"\\(.)", re.S)


def _unescaped(m: re.Match) -> str:
    return _UNESCAPE.get(m[1], m[1])


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "'" if m[1] is None else _UNESCAPE.get(m[1], m[1]), text) if "\\" in text or "''" in text else text


def _expression(text: str, at: int) -> tuple[str, int]:
    """An expression kept as written, up to the comma or parenthesis that ends it."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "'":
            j = i + 1
            while j < len(text) and (text[j] != "'" or text[j + 1 : j + 2] == "'"):
                j += 2 if text[j] == "'" or text[j] == "\\" else 1
            i = j
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c in ",)" and not depth:
            return text[at:i].strip(), i
        i += 1
    return text[at:].strip(), len(text)


def insert_rows(statement: str, dialect: str) -> tuple[list[str] | None, Iterator[list[str | None]]]:
    """Column list (None if not given) and rows of an INSERT ... VALUES. Values are texts: NULL is None, hex literals are ``\\x`` and digits."""
    start = _LEADING.match(statement).end()
    head = _INTO.match(statement, start)
    if not head:
        return None, iter(())
    columns = [unquote(c) for c in re.findall(IDENT, head[2])] if head[2] else None
    return columns, _tuples(statement, head.end(), dialect)


def _tuples(text: str, at: int, dialect: str) -> Iterator[list[str | None]]:
    pattern, mysql = _VALUE[dialect], dialect == "mysql"
    n = len(text)
    while True:
        at = text.find("(", at)
        if at < 0:
            return
        at += 1
        row: list[str | None] = []
        while at <= n:
            m = pattern.match(text, at)
            if m:
                string = m[2]
                if m["null"]:
                    row.append(None)
                elif string is not None:
                    row.append(_unescape(string) if mysql else string.replace("''", "'") if "''" in string else string)
                elif m["num"]:
                    row.append(m["num"])
                elif m["hex"] is not None or m["hex2"] is not None:
                    row.append("\\x" + (m["hex"] if m["hex"] is not None else m["hex2"]))
                elif m["bits"] is not None:
                    row.append(str(int(m["bits"] or "0", 2)))
                elif m["e"] is not None:
                    row.append(_unescape(m["e"]))
                else:
                    row.append("1" if m["bool"].upper() == "TRUE" else "0")
                at = m.end()
                if m["end"] == ")":
                    break
            else:
                value, at = _expression(text, at)
                inner = re.fullmatch(r"(?:CAST|CONVERT)\s*\(\s*(?:\w+\s*,\s*)?N?'((?:[^']|'')*)'.*\)", value, re.I | re.S)
                row.append(inner[1].replace("''", "'") if inner else value)
                if at >= n or text[at] == ")":
                    at += 1
                    break
                at += 1
        yield row


#: Stand-ins for escaped backslashes and quotes while a statement is cut at its quotes.
_BACKSLASH, _QUOTE = "\ue000", "\ue001"
_PLAIN_START = frozenset("-+.0123456789")


def insert_columns(statement: str, dialect: str) -> tuple[list[str] | None, list[list[str | None]]] | None:
    """Column list and values by column of an INSERT whose rows are equally wide and hold plain literals; None if it must be read value by value.

    The text is cut at its quotes, so that every second piece is a literal's content; what is left outside is cut at
    commas, and the contents are put back in their places: a few passes in C instead of a step per value.
    """
    head = _INTO.match(statement, _LEADING.match(statement).end())
    if not head:
        return None
    text = statement[head.end() :].rstrip().rstrip(";")
    if "\0" in text:
        return None
    escaped = "\\" in text
    if escaped and dialect == "mysql":
        if _BACKSLASH in text or _QUOTE in text:
            return None
        text = text.replace("\\\\", _BACKSLASH).replace("\\'", _QUOTE)
    elif escaped and dialect == "postgres" and re.search(r"\bE'", text, re.I):
        return None
    parts = text.split("'")
    outside, inside = parts[::2], parts[1::2]
    if len(parts) % 2 == 0:
        return None
    if "" in outside[1:-1]:  # two literals touch: a doubled quote within one
        merged, kept = [inside[0]], [outside[0]]
        for o, i in zip(outside[1:-1], inside[1:]):
            if o:
                kept.append(o)
                merged.append(i)
            else:
                merged[-1] += "'" + i
        outside, inside = [*kept, outside[-1]], merged
    body = "".join("\0".join(outside).split()).replace("N\0", "\0").replace("_binary\0", "\0")
    if not body.startswith("(") or not body.endswith(")"):
        return None
    rows = body[1:-1].split("),(")
    width = rows[0].count(",") + 1
    flat = ",".join(rows)
    if any(c in flat for c in "()\"`[:") or "--" in flat or "/*" in flat or any(r.count(",") != width - 1 for r in rows):
        return None
    values: list[str | None] = flat.split(",")
    words = {v for v in set(values) if v[:1] not in _PLAIN_START or v[1:2] in ("x", "X")} - {"\0"}
    if any("\0" in v for v in words) or "" in words:
        return None
    if words:
        say: dict[str, str | None] = {}
        for v in words:
            up = v.upper()
            say[v] = None if up == "NULL" else "1" if up == "TRUE" else "0" if up == "FALSE" else "\\x" + v[2:] if up.startswith("0X") else v
        values = [say[v] if v in say else v for v in values]
    if inside:
        if escaped and dialect == "mysql":
            inside = [_BACKSLASHED.sub(_unescaped, t.replace(_BACKSLASH, "\\\\").replace(_QUOTE, "\\'")) if "\\" in t or _BACKSLASH in t or _QUOTE in t else t for t in inside]
        at = [i for i, v in enumerate(values) if v == "\0"]
        if len(at) != len(inside):
            return None
        for i, t in zip(at, inside):
            values[i] = t
    return [unquote(c) for c in re.findall(IDENT, head[2])] if head[2] else None, [values[i::width] for i in range(width)]


def insert_head(statement: str) -> tuple[list[str] | None, int] | None:
    """Column list (None if not given) of an INSERT ... VALUES and where its values begin."""
    head = _INTO.match(statement, _LEADING.match(statement).end())
    if not head:
        return None
    return [unquote(c) for c in re.findall(IDENT, head[2])] if head[2] else None, head.end()


def unbackslashed(text: str) -> str:
    """A MySQL literal's content without its backslash escapes."""
    return _BACKSLASHED.sub(_unescaped, text)


_COPY_ESCAPE = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.S)
_COPY_CHARS = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _copy_char(m: re.Match) -> str:
    s = m[1]
    if s[0] == "x" and len(s) > 1:
        return chr(int(s[1:], 16))
    if s[0] in "01234567":
        return chr(int(s, 8))
    return _COPY_CHARS.get(s, s)


def copy_text(field: str) -> str:
    """A field of a COPY line without its escapes."""
    return _COPY_ESCAPE.sub(_copy_char, field)


def copy_columns(statement: str) -> list[str] | None:
    m = re.match(rf"\s*COPY\s+{NAME}\s*\(([^)]*)\)", statement, re.I)
    return [unquote(c) for c in re.findall(IDENT, m[1])] if m else None


def copy_rows(data: str, width: int | None = None) -> Iterator[list[str | None]]:
    """Rows of COPY lines. ``\\N`` is None. An empty line is a row only if a row is one field wide."""
    for line in data.split("\n"):
        line = line.removesuffix("\r")
        if not line and width != 1:
            continue
        if "\\" in line:
            yield [None if f == "\\N" else _COPY_ESCAPE.sub(_copy_char, f) if "\\" in f else f for f in line.split("\t")]
        else:
            yield line.split("\t")
