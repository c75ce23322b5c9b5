"""DDL statements of the four dialects to catalog objects."""

from __future__ import annotations

import re
from collections.abc import Iterable

from dumpquarry.catalog import Catalog, ColumnDef, ForeignKey, TableDef
from dumpquarry.dialect import unquote

IDENT = r'(?:`(?:[^`]|``)+`|"(?:[^"]|"")+"|\[(?:[^\]]|\]\])+\]|[\w$]+)'
NAME = rf"{IDENT}(?:\s*\.\s*{IDENT})*"
_CREATE = re.compile(rf"\s*CREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({NAME})\s*\(", re.I)
_INDEX = re.compile(rf"\s*CREATE\s+(UNIQUE\s+)?(?:NONCLUSTERED\s+|CLUSTERED\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({NAME})\s+ON\s+(?:ONLY\s+)?({NAME})\s*(?:USING\s+\w+\s*)?\((.*?)\)", re.I | re.S)
_ALTER = re.compile(rf"\s*ALTER\s+TABLE\s+(?:ONLY\s+)?(?:IF\s+EXISTS\s+)?({NAME})\s+(.*)", re.I | re.S)
_FK = re.compile(rf"(?:CONSTRAINT\s+({IDENT})\s+)?FOREIGN\s+KEY\s*(?:{IDENT}\s*)?\(([^)]*)\)\s*REFERENCES\s+({NAME})\s*(?:\(([^)]*)\))?", re.I)
_PK = re.compile(r"PRIMARY\s+KEY\s*(?:NONCLUSTERED|CLUSTERED)?\s*\(([^)]*)\)", re.I)
_UNIQUE = re.compile(rf"(?:UNIQUE\s+(?:KEY|INDEX)?\s*(?:{IDENT}\s*)?(?:NONCLUSTERED|CLUSTERED)?\s*)\(([^)]*)\)", re.I)
_INLINE_REF = re.compile(rf"REFERENCES\s+({NAME})\s*(?:\(([^)]*)\))?", re.I)
_TYPE_END = re.compile(r"\b(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|COLLATE|CHARACTER\s+SET|CHARSET|COMMENT|AUTO_INCREMENT|AUTOINCREMENT|IDENTITY|GENERATED|ON\s+UPDATE|ROWGUIDCOL|SPARSE)\b", re.I)


def _names(text: str) -> tuple[str, ...]:
    """Column names of a key list, without lengths and sort orders."""
    return tuple(unquote(re.match(rf"\s*({IDENT})", p)[1]) for p in split_top(text) if re.match(rf"\s*({IDENT})", p))


def split_top(body: str) -> list[str]:
    """Split at commas outside parentheses and quotes."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(body):
        c = body[i]
        if c in "'\"`":
            j = i + 1
            while j < len(body) and (body[j] != c or body[j + 1 : j + 2] == c):
                j += 2 if body[j] == c or (body[j] == "\\" and c == "'") else 1
            i = j
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
        i += 1
    out.append(body[start:])
    return [p for p in (x.strip() for x in out) if p]


def _body(statement: str, start: int) -> str:
    """What stands between the parenthesis that opens before ``start`` and the one that closes it."""
    depth, i = 1, start
    while i < len(statement):
        c = statement[i]
        if c in "'\"`":
            j = statement.find(c, i + 1)
            i = j if j > 0 else len(statement)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return statement[start:i]
        i += 1
    return statement[start:]


def strip_comments(sql: str) -> str:
    """Without comments; MySQL's versioned comments are opened."""
    sql = re.sub(r"/\*!\d*\s?(.*?)\*/", r"\1", sql, flags=re.S)
    return re.sub(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|/\*.*?\*/|--[^\n]*", lambda m: m[1] or " ", sql, flags=re.S)


def parse_create_table(statement: str) -> TableDef | None:
    sql = strip_comments(statement)
    m = _CREATE.match(sql)
    if not m:
        return None
    table = TableDef(unquote(m[1]))
    for part in split_top(_body(sql, m.end())):
        head = re.match(rf"(?:CONSTRAINT\s+{IDENT}\s+)?(PRIMARY\s+KEY|FOREIGN\s+KEY|UNIQUE|CHECK|KEY|INDEX|FULLTEXT|SPATIAL|EXCLUDE)\b", part, re.I)
        # a column may bear a keyword's name if a type follows it
        if head and not (re.match(rf"{IDENT}\s+\w+", part) and head[1].upper() in ("KEY", "INDEX") and "(" not in part):
            kind = re.sub(r"\s+", " ", head[1].upper())
            if kind == "PRIMARY KEY" and (pk := _PK.search(part)):
                table.primary_key = _names(pk[1])
            elif kind == "FOREIGN KEY" and (fk := _FK.search(part)):
                table.foreign_keys.append(ForeignKey(_names(fk[2]), unquote(fk[3]), _names(fk[4] or ""), unquote(fk[1]) if fk[1] else None))
            elif kind == "UNIQUE" and (u := _UNIQUE.search(part)):
                table.unique.append(_names(u[1]))
            elif kind == "CHECK":
                table.checks.append(part[part.find("(") :])
            elif kind in ("KEY", "INDEX") and (k := re.match(rf"\w+\s+({IDENT})?\s*(?:USING\s+\w+\s*)?\((.*)\)", part, re.I | re.S)):
                table.indexes.append((unquote(k[1] or ""), _names(k[2])))
            continue
        col = re.match(rf"({IDENT})\s*(.*)", part, re.S)
        if not col:
            continue
        name, rest = unquote(col[1]), col[2].strip()
        end = _TYPE_END.search(re.sub(r"'(?:[^']|'')*'", lambda q: "x" * len(q[0]), rest))
        sql_type = re.sub(r"\s+", " ", rest[: end.start()] if end else rest).strip()
        attributes = rest[end.start() :] if end else ""
        primary = bool(re.search(r"\bPRIMARY\s+KEY\b", attributes, re.I))
        default = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\s,]+)", attributes, re.I)
        auto = bool(re.search(r"AUTO_?INCREMENT|IDENTITY|GENERATED\s+(?:ALWAYS|BY)|nextval", attributes, re.I) or re.match(r"(?:big|small)?serial", sql_type, re.I))
        table.columns.append(ColumnDef(name, sql_type, not (primary or re.search(r"\bNOT\s+NULL\b", attributes, re.I)), primary, default[1] if default else None, auto))
        if primary and not table.primary_key:
            table.primary_key = (name,)
        if re.search(r"\bUNIQUE\b", attributes, re.I):
            table.unique.append((name,))
        if (ref := _INLINE_REF.search(attributes)) and not re.search(r"FOREIGN", attributes, re.I):
            table.foreign_keys.append(ForeignKey((name,), unquote(ref[1]), _names(ref[2] or "")))
        if check := re.search(r"\bCHECK\s*(\(.*\))", attributes, re.I | re.S):
            table.checks.append(check[1])
    for c in table.columns:
        if c.name in table.primary_key:
            c.primary, c.nullable = True, False
    return table


def parse_alter_table(statement: str, catalog: Catalog) -> None:
    """Late keys: ADD PRIMARY KEY, FOREIGN KEY and UNIQUE."""
    m = _ALTER.match(strip_comments(statement))
    table = catalog.get(unquote(m[1])) if m else None
    if not table:
        return
    for fk in _FK.finditer(m[2]):
        key = ForeignKey(_names(fk[2]), unquote(fk[3]), _names(fk[4] or ""), unquote(fk[1]) if fk[1] else None)
        if key not in table.foreign_keys:
            table.foreign_keys.append(key)
    if pk := _PK.search(m[2]):
        table.primary_key = _names(pk[1])
        for c in table.columns:
            if c.name in table.primary_key:
                c.primary, c.nullable = True, False
    for u in _UNIQUE.finditer(m[2]):
        table.unique.append(_names(u[1]))


def parse_create_index(statement: str, catalog: Catalog) -> None:
    m = _INDEX.match(strip_comments(statement))
    table = catalog.get(unquote(m[3])) if m else None
    if table:
        columns = _names(m[4])
        table.indexes.append((unquote(m[2]), columns))
        if m[1]:
            table.unique.append(columns)


def build_catalog(statements: Iterable[str]) -> Catalog:
    """The catalog of DDL statements in file order; keys that name no columns refer to the parent's primary key."""
    catalog = Catalog()
    for s in statements:
        if table := parse_create_table(s):
            catalog.tables[table.name.lower()] = table
        elif re.match(r"\s*ALTER\s+TABLE", s, re.I):
            parse_alter_table(s, catalog)
        elif re.match(r"\s*CREATE\s+(?:UNIQUE\s+)?(?:NONCLUSTERED\s+|CLUSTERED\s+)?INDEX", s, re.I):
            parse_create_index(s, catalog)
    for t in catalog:
        for i, fk in enumerate(t.foreign_keys):
            parent = catalog.get(fk.parent)
            if parent:
                t.foreign_keys[i] = ForeignKey(fk.columns, parent.name, fk.parent_columns or parent.primary_key, fk.name)
    return catalog
