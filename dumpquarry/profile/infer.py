"""From a profile to a generator for each column: rules in order of precedence."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from dumpquarry.catalog import Catalog, ColumnDef, TableDef

#: Classes of rules, the strongest first.
PRECEDENCE = ("override", "credential", "key", "relation", "semantic", "distribution", "type")

# Name rules for secrets, and for columns whose meaning the name tells.
CREDENTIAL = re.compile(r"password|passwd|secret|token|api_?key|private_?key|hash$", re.I)
SEMANTIC = (
    (r"(^|_)e?mail$", "internet.email"), (r"first_?name|fname", "person.first_name"), (r"last_?name|lname|surname", "person.last_name"),
    (r"(full|display)_?name", "person.full_name"), (r"user_?name|login", "person.username"), (r"phone|mobile", "phone.number"), (r"country_?code", "phone.country_code"),
    (r"(^|_)country$", "address.country"), (r"(^|_)city$", "address.city"), (r"zip|post(al_?)?code", "address.postcode"), (r"(^|_)(state|region)$", "address.region"),
    (r"street|address", "address.line1"), (r"(^|_)lat(itude)?$", "address.latitude"), (r"(^|_)(lng|lon(gitude)?)$", "address.longitude"), (r"company|organi[sz]ation", "company.name"),
    (r"job_?title", "company.job_title"), (r"department", "company.department"), (r"currency", "commerce.currency"), (r"(^|_)(price|amount|total|balance|cost)", "commerce.money"),
    (r"quantity|qty", "commerce.quantity"), (r"(^|_)sku$", "commerce.sku"), (r"url|website|link", "internet.url"), (r"user_?agent", "internet.user_agent"),
    (r"(^|_)ip(_?address)?$", "internet.ipv4"), (r"(^|_)mac$", "network.mac"), (r"(^|_)port$", "network.port"), (r"slug", "text.slug"), (r"uuid|guid", "uuid"),
    (r"file_?name", "file.name"), (r"mime|content_?type", "file.mime_type"), (r"(^|_)(title|subject)$", "text.sentence"), (r"(^|_)(body|content|description|comment|notes?)$", "text.paragraph"),
)


@dataclass(frozen=True)
class Inferred:
    kind: str
    args: dict
    rule: str


def _top(evidence: Mapping) -> list[tuple]:
    """Value and count of the profile's top entries."""
    return [(t["item"], t["count"]) if isinstance(t, Mapping) else tuple(t)[:2] for t in evidence.get("top") or []]


def infer_column(table: TableDef, column: ColumnDef, evidence: Mapping | None = None, override: Mapping | None = None) -> Inferred:
    """The generator of one column."""
    if override:
        return Inferred(override["kind"], {k: v for k, v in override.items() if k != "kind"}, "override")
    if CREDENTIAL.search(column.name):
        return Inferred("credential.password_hash" if "pass" in column.name.lower() else "credential.token", {}, "credential")
    if table.primary_key == (column.name,):
        return Inferred("uuid" if column.family in ("Uuid", "Text") else "sequence", {}, "key")
    for fk in table.foreign_keys:
        if fk.columns == (column.name,):
            return Inferred("relation.foreign_key", {"parent": fk.parent}, "relation")
    family = column.family
    for pattern, kind in SEMANTIC:
        if re.search(pattern, column.name, re.I) and (family in ("Text", "Other", "Uuid") or kind.startswith(("commerce.", "address.l", "network.port"))):
            return Inferred(kind, {}, "semantic")
    if evidence and evidence.get("n"):
        e = dict(evidence) | {"top": _top(evidence)}
        seen = e["n"] - e["n_null"]
        if seen and e["n_distinct"] == 1 and e.get("top"):
            return Inferred("constant", {"value": e["top"][0][0]}, "distribution")
        if seen and e.get("min_number") is not None and e.get("n_zero_or_one") == seen:
            return Inferred("boolean", {"probability": e["mean"]}, "distribution")
        if seen and e["n_distinct"] <= 20 and e.get("top"):
            return Inferred("weighted_choice", {"values": [t[0] for t in e["top"]], "weights": [t[1] for t in e["top"]]}, "distribution")
        if seen and e.get("histogram") and family in ("Int", "BigInt", "Decimal"):
            return Inferred("histogram", {"bins": [(b["x"], b["y"]) for b in e["histogram"]], "low": e["min_number"], "high": e["max_number"], "integer": family != "Decimal"}, "distribution")
        if seen and e.get("stddev") is not None:
            return Inferred("normal", {"mean": e["mean"], "stddev": e["stddev"]}, "distribution")
    return {
        "Int": Inferred("integer", {"low": 0, "high": 1_000_000}, "type"),
        "BigInt": Inferred("integer", {"low": 0, "high": 1_000_000_000}, "type"),
        "Decimal": Inferred("decimal", {"low": 0, "high": 10_000, "scale": 2}, "type"),
        "DateTime": Inferred("datetime", {}, "type"),
        "Bool": Inferred("boolean", {"probability": 0.5}, "type"),
        "Uuid": Inferred("uuid", {}, "type"),
    }.get(family, Inferred("string", {"length": 12}, "type"))


def infer_model(catalog: Catalog, rows: Mapping[str, int] | int = 100, profiles: Mapping[str, Mapping[str, Mapping]] | None = None, overrides: Mapping | None = None) -> dict:
    """A generation model for all tables; junctions and timestamp pairs get their planners."""
    model: dict = {"tables": {}}
    first, rest = catalog.topological()
    for name in [*first, *rest]:
        t = catalog.get(name)
        n = rows if isinstance(rows, int) else rows.get(name, 100)
        columns, planners = {}, []
        for c in t.columns:
            evidence = (profiles or {}).get(name, {}).get(c.name)
            got = infer_column(t, c, evidence, ((overrides or {}).get(name) or {}).get(c.name))
            spec = {"kind": got.kind, **got.args}
            if evidence and evidence["n"] and evidence["n_null"] and c.nullable:
                spec["null_rate"] = evidence["n_null"] / evidence["n"]
            columns[c.name] = spec
        names = {c.name.lower() for c in t.columns}
        if t.is_junction and len(t.foreign_keys) >= 2:
            a, b = t.foreign_keys[0], t.foreign_keys[1]
            planners.append({"kind": "relation.junction_pair", "left": a.columns[0], "left_parent": a.parent, "right": b.columns[0], "right_parent": b.parent})
        if {"created_at", "updated_at"} <= names:
            planners.append({"kind": "temporal.timestamps", "created": "created_at", "updated": "updated_at"})
        if "deleted_at" in names:
            planners.append({"kind": "temporal.soft_delete", "deleted": "deleted_at", "after": "created_at" if "created_at" in names else None, "rate": 0.1})
        if {"start_at", "end_at"} <= names:
            planners.append({"kind": "temporal.interval", "start": "start_at", "end": "end_at"})
        own = [fk for fk in t.foreign_keys if fk.parent.lower() == t.name.lower()]
        if own:
            planners.append({"kind": "hierarchy.tree", "parent": own[0].columns[0], "max_depth": 5})
        model["tables"][name] = {"rows": n, "columns": columns, "planners": planners}
    return model
