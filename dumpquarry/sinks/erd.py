"""Schema graphs as DOT, Mermaid, JSON and HTML."""

from __future__ import annotations

import html
import json
import re

from dumpquarry.catalog import Catalog


def _word(name: str) -> str:
    return re.sub(r"\W", "_", name)


def to_dot(catalog: Catalog, columns: bool = True) -> str:
    out = ["digraph schema {", "  rankdir=LR;", "  node [shape=record];"]
    for t in catalog:
        fields = "".join(f"|{'* ' if c.name in t.primary_key else ''}{c.name}: {c.sql_type}".replace("<", "\\<").replace(">", "\\>").replace('"', '\\"') for c in t.columns) if columns else ""
        out.append(f'  "{t.name}" [label="{{{t.name}{fields}}}"];')
    out += [f'  "{c}" -> "{p}" [label="{", ".join(fk.columns)}"];' for c, fk, p in catalog.edges()]
    return "\n".join([*out, "}"]) + "\n"


def to_mermaid(catalog: Catalog, columns: bool = True) -> str:
    out = ["erDiagram"]
    for t in catalog:
        keys = {c for fk in t.foreign_keys for c in fk.columns}
        out.append(f"  {_word(t.name)} {{")
        if columns:
            out += [f"    {_word(c.sql_type.split('(')[0] or 'unknown')} {_word(c.name)}{' PK' if c.name in t.primary_key else ' FK' if c.name in keys else ''}" for c in t.columns]
        out.append("  }")
    out += [f'  {_word(p)} ||--o{{ {_word(c)} : "{", ".join(fk.columns)}"' for c, fk, p in catalog.edges()]
    return "\n".join(out) + "\n"


def to_json(catalog: Catalog) -> str:
    first, rest = catalog.topological()
    return json.dumps(
        {
            "tables": [{"name": t.name, "primary_key": list(t.primary_key), "columns": [{"name": c.name, "type": c.sql_type, "nullable": c.nullable} for c in t.columns]} for t in catalog],
            "edges": [{"from": c, "to": p, "columns": list(fk.columns), "parent_columns": list(fk.parent_columns)} for c, fk, p in catalog.edges()],
            "order": first,
            "unordered": rest,
            "cycles": catalog.cycles(),
        },
        indent=2,
    )


def to_html(catalog: Catalog) -> str:
    """One page without scripts from elsewhere: a list of tables with links along the keys, and the Mermaid source."""
    parts = ["<!doctype html><meta charset='utf-8'><title>Schema</title><style>body{font:14px sans-serif}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #999;padding:2px 8px;text-align:left}</style>"]
    for t in catalog:
        links = {c: fk.parent for fk in t.foreign_keys for c in fk.columns}
        rows = "".join(
            f"<tr><td>{html.escape(c.name)}{' (key)' if c.name in t.primary_key else ''}</td><td>{html.escape(c.sql_type)}</td><td>"
            + (f"<a href='#{html.escape(links[c.name])}'>{html.escape(links[c.name])}</a>" if c.name in links else "")
            + "</td></tr>"
            for c in t.columns
        )
        parts.append(f"<table id='{html.escape(t.name)}'><tr><th colspan=3>{html.escape(t.name)}</th></tr>{rows}</table>")
    return "".join(parts) + f"<pre>{html.escape(to_mermaid(catalog))}</pre>\n"
