"""Query results as table, JSON, JSON lines, CSV or TSV: as text row by row, or by Spark's writers."""

from __future__ import annotations

import csv
import io
import json
import tempfile
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("table", "json", "jsonl", "csv", "tsv")


def _plain(v: object) -> object:
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def stream(df: DataFrame, form: str, out: TextIO, limit: int | None = None) -> None:
    """A result as text, with true types in JSON: all rows, or up to ``limit``, by partition. A table's rows wait in a local file until its widths are known."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    rows, names = (df if limit is None else df.limit(limit)).toLocalIterator(), df.columns
    if form == "json":
        n = 0
        for n, r in enumerate(rows, 1):
            text = json.dumps(dict(zip(names, map(_plain, r))), ensure_ascii=False, indent=2)
            out.write(("[\n  " if n == 1 else ",\n  ") + text.replace("\n", "\n  "))
        out.write("\n]\n" if n else "[]\n")
    elif form == "jsonl":
        for r in rows:
            out.write(json.dumps(dict(zip(names, map(_plain, r))), ensure_ascii=False) + "\n")
    elif form in ("csv", "tsv"):
        w = csv.writer(out, delimiter="\t" if form == "tsv" else ",", lineterminator="\n")
        w.writerow(names)
        w.writerows(["" if v is None else _plain(v) for v in r] for r in rows)
    else:
        widths, n = [len(c) for c in names], 0
        line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths)).rstrip()
        with tempfile.TemporaryFile("w+", encoding="utf-8", errors="surrogatepass", newline="") as kept:
            for n, r in enumerate(rows, 1):
                cells = ["NULL" if v is None else str(_plain(v)) for v in r]
                widths = [max(w, len(c)) for w, c in zip(widths, cells)]
                kept.write(json.dumps(cells) + "\n")
            kept.seek(0)
            out.write("\n".join([line(names), "-+-".join("-" * w for w in widths), ""]))
            for cells in kept:
                out.write(line(json.loads(cells)) + "\n")
        out.write(f"({n} rows)\n")


def render(df: DataFrame, form: str = "table", limit: int | None = None) -> str:
    """A result as one text, for small ones; see :func:`stream`."""
    out = io.StringIO()
    stream(df, form, out, limit)
    return out.getvalue()


def write(df: DataFrame, path: str, form: str, compression: str = "none") -> None:
    """A result of any size, by the executors."""
    if form in ("json", "jsonl"):
        df.write.mode("overwrite").option("compression", compression).option("ignoreNullFields", "false").json(path)
    elif form in ("csv", "tsv"):
        flat = df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema])
        flat.write.mode("overwrite").option("compression", compression).option("header", "true").option("sep", "\t" if form == "tsv" else ",").option("escape", '"').csv(path)
    else:
        raise ValueError(f"{form} is for small results")
