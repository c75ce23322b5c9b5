"""Planners: groups of columns (or a child table) whose values depend on each other."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dumpquarry.functions import lexicon
from dumpquarry.generate.generators import DAY, Context, _stamp

PLANNERS: dict[str, Callable[..., dict[str, Column]]] = {}


def planner(name: str):
    def add(f):
        PLANNERS[name] = f
        return f

    return add


def _later(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


@planner("temporal.interval")
def interval(c: Context, start: str, end: str, duration: str | None = None, low: int = 60, high: int = DAY, open_rate: float = 0.0, inclusive: bool = False, days: int = 365) -> dict[str, Column]:
    """end = start + duration seconds (a microsecond less if inclusive); open rows have no end."""
    at = _stamp(c.integer(0, days * DAY - 1, "start"))
    span = c.integer(low, high, "span")
    finish = _later(at, span.cast("decimal(18,6)") - (F.lit(1) / F.lit(1_000_000)).cast("decimal(18,6)") if inclusive else span)
    is_open = c.u("open") < open_rate
    out = {start: at, end: F.when(~is_open, finish)}
    return out | ({duration: F.when(~is_open, span)} if duration else {})


@planner("workflow.progress_counters")
def progress(c: Context, total: str, processed: str, pending: str, succeeded: str, failed: str, status: str | None = None, low: int = 1, high: int = 1000, success: float = 0.9) -> dict[str, Column]:
    """processed + pending = total; succeeded + failed = processed. Done rows have processed all, idle ones nothing, active ones less than all."""
    n = c.integer(low, high, "total")
    kind = F.when(c.u("state") < 0.5, "done").when(c.u("state") < 0.8, "active").otherwise("idle")
    done = F.when(kind == "done", n).when(kind == "active", F.least(F.floor(c.u("part") * n).cast("long"), n - 1)).otherwise(0).cast("long")
    good = F.floor(done * success + 0.5).cast("long")  # the larger remainder of two shares
    out = {total: n, processed: done, pending: n - done, succeeded: good, failed: done - good}
    return out | ({status: kind} if status else {})


@planner("temporal.timestamps")
def timestamps(c: Context, created: str, updated: str, days: int = 1460, high: int = 90 * DAY) -> dict[str, Column]:
    at = _stamp(c.integer(0, days * DAY - 1, "created"))
    return {created: at, updated: _later(at, c.integer(0, high, "updated"))}


@planner("temporal.soft_delete")
def soft_delete(c: Context, deleted: str, rate: float = 0.1, flag: str | None = None, after: str | None = None) -> dict[str, Column]:
    """The flag is set exactly where the time is."""
    gone = c.u("deleted") < rate
    base = F.col(f"`{after}`") if after else _stamp(c.integer(0, 1460 * DAY - 1, "base"))
    out = {deleted: F.when(gone, _later(base, c.integer(1, 365 * DAY, "when")))}
    return out | ({flag: gone} if flag else {})


@planner("temporal.lifecycle")
def lifecycle(c: Context, states: list[dict], status: str | None = None, low: int = 60, high: int = DAY) -> dict[str, Column]:
    """``states``: {"name", "column", "weight"} in order. A row ends in a state by weight; stamps up to it rise, later ones are null."""
    from dumpquarry.functions import draws

    last = draws.weighted(list(range(len(states))), [s.get("weight", 1) for s in states], *c.parts("end"))
    at = _stamp(c.integer(0, 1460 * DAY - 1, "first"))
    out: dict[str, Column] = {}
    for i, s in enumerate(states):
        if i:
            at = _later(at, c.integer(low, high, f"step{i}"))
        out[s["column"]] = F.when(last >= i, at)
    return out | ({status: F.element_at(F.array(*[F.lit(s["name"]) for s in states]), last + 1)} if status else {})


@planner("relation.junction_pair")
def junction_pair(c: Context, left: str, left_parent: str, right: str, right_parent: str) -> dict[str, Column]:
    """Pairs without repetition: row n takes pair (offset + n * stride) of all pairs, the stride coprime to their number."""
    a, b = c.domains[left_parent.lower()], c.domains[right_parent.lower()]
    total = a.rows * b.rows
    offset = (c.seed * 7919 + 13) % total
    stride = next(s for s in range(max(1, int(total * 0.6180339)), 2 * total + 2) if math.gcd(s, total) == 1)
    at = ((c.row.cast("decimal(20,0)") * stride + offset) % F.lit(total).cast("decimal(20,0)")).cast("long")
    return {left: a.key(F.floor(at / b.rows)), right: b.key(at % b.rows)}


@planner("relation.polymorphic_pair")
def polymorphic_pair(c: Context, type: str, id: str, targets: dict[str, str]) -> dict[str, Column]:
    """``targets``: type name -> table. The id is one of the chosen table's keys."""
    names = list(targets)
    chosen = c.pick(names, "type")
    key = F.lit(None).cast("long")
    for n in names:
        d = c.domains[targets[n].lower()]
        key = F.when(chosen == n, d.key(F.floor(c.u("id") * d.rows))).otherwise(key)
    return {type: chosen, id: key}


@planner("relation.tenant_family")
def tenant_family(c: Context, tenant: str, tenants: str, rows: int, parent: str | None = None, parent_table: str | None = None) -> dict[str, Column]:
    """Tenant t owns the rows from t * N / T up to (t + 1) * N / T; a parent is drawn from the tenant's own block of parents."""
    d = c.domains[tenants.lower()]
    t = F.floor(((c.row + 1) * d.rows - 1) / rows).cast("long")
    out = {tenant: d.key(t)}
    if parent and parent_table:
        p = c.domains[parent_table.lower()]
        low, high = F.floor(t * p.rows / d.rows).cast("long"), F.floor((t + 1) * p.rows / d.rows).cast("long")
        out[parent] = p.key(low + F.floor(c.u("parent") * (high - low)).cast("long"))
    return out


@planner("geo.coordinate_pair")
def coordinate_pair(c: Context, latitude: str, longitude: str, south: float = -90, north: float = 90, west: float = -180, east: float = 180) -> dict[str, Column]:
    def place(low: float, high: float, name: str) -> Column:
        return (c.integer(round(low * 1e6), round(high * 1e6), name).cast("decimal(38,0)") / F.lit(1_000_000)).cast("decimal(9,6)")

    return {latitude: place(south, north, "lat"), longitude: place(west, east, "lon")}


@planner("file.metadata")
def file_metadata(c: Context, name: str, extension: str, mime: str, size: str | None = None) -> dict[str, Column]:
    """Extension and media type fit each other, and the name ends in the extension."""
    number = c.integer(1, len(lexicon.WORDS["extension"]), "kind").cast("int")
    ext = F.element_at(F.array(*map(F.lit, lexicon.WORDS["extension"])), number)
    out = {name: F.concat(c.pick(lexicon.WORDS["word"], "name"), F.lit("."), ext), extension: ext, mime: F.element_at(F.array(*map(F.lit, lexicon.WORDS["mime"])), number)}
    return out | ({size: c.integer(1, 10_000_000, "size")} if size else {})


@planner("hierarchy.tree")
def tree(c: Context, parent: str, depth: str | None = None, max_depth: int = 5, roots: int = 1, rows: int = 0) -> dict[str, Column]:
    """Rows fall into levels of fixed ranges (level d holds twice as many as the one before); a parent is drawn from the level above, so it is an earlier row.

    Closed form: the level is known from the row's number, so no pass waits for another.
    """
    d = c.domains[c.table.lower()]
    rows = rows or d.rows
    bounds, at, width = [0], 0, max(1, roots)
    while at < rows and len(bounds) <= max_depth:
        at = min(rows, at + width)
        bounds.append(at)
        width *= 2
    bounds[-1] = rows  # the deepest level takes the rest
    level, above = F.lit(0), F.lit(None).cast("long")
    for i in range(1, len(bounds) - 1):
        inside = c.row >= bounds[i]
        level = F.when(inside, i).otherwise(level)
        above = F.when(inside, F.lit(bounds[i - 1]) + F.floor(c.u("parent") * (bounds[i] - bounds[i - 1])).cast("long")).otherwise(above)
    out = {parent: d.key(above)}
    return out | ({depth: level.cast("int")} if depth else {})


# --- order families: a parent and its lines, in whole minor units


def half_up(amount: Column, rate: int) -> Column:
    """amount * rate / 1,000,000, rounded half up, of non-negative whole numbers."""
    return F.floor((amount.cast("decimal(30,0)") * rate + 500_000) / F.lit(1_000_000)).cast("long")


def apportion(df: DataFrame, total: str, weight: str, group: str, line: str, out: str) -> DataFrame:
    """A group's total split over its lines by weight, exactly: floors, then one unit each for the largest remainders (ties by line)."""
    all_ = F.sum(weight).over(Window.partitionBy(group))
    product = F.col(total).cast("decimal(30,0)") * F.col(weight)
    floor = F.when(all_ > 0, F.floor(product / all_)).otherwise(0).cast("long")
    df = df.withColumn("_all", all_).withColumn(out, floor).withColumn("_rest", F.when(F.col("_all") > 0, product - F.col(out).cast("decimal(30,0)") * F.col("_all")).otherwise(0))
    left = F.col(total) - F.sum(out).over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_rest"), line))
    return df.withColumn("_left", left).withColumn("_rank", rank).withColumn(out, F.col(out) + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).drop("_all", "_rest", "_left", "_rank")


def order_family(orders: DataFrame, seed: int, table: str = "order_lines", min_lines: int = 1, max_lines: int = 5, discount_rate: int = 50_000, tax_rate: int = 190_000, shipping: int = 499, max_price: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Orders (column ``id``) with money columns in minor units, and their lines, whose sums equal the orders' exactly.

    subtotal = sum of quantity * price; discount and tax are rates (parts per million) rounded half up and split over
    the lines; grand total = subtotal - discount + tax + shipping.
    """
    from dumpquarry.functions import draws

    lines = orders.select("id", F.explode(F.sequence(F.lit(1), draws.integer(min_lines, max_lines, seed, table, "lines", F.col("id")).cast("int"))).alias("line_no"))
    key = (F.col("id"), F.col("line_no"))
    lines = lines.select("*", draws.integer(1, 9, seed, table, "quantity", *key).alias("quantity"), draws.integer(1, max_price, seed, table, "price", *key).alias("unit_price"))
    lines = lines.withColumn("line_subtotal", F.col("quantity") * F.col("unit_price")).withColumn("subtotal", F.sum("line_subtotal").over(Window.partitionBy("id")))
    lines = lines.withColumn("discount_total", half_up(F.col("subtotal"), discount_rate))
    lines = apportion(lines, "discount_total", "line_subtotal", "id", "line_no", "line_discount")
    lines = lines.withColumn("line_taxable", F.col("line_subtotal") - F.col("line_discount")).withColumn("tax_total", half_up(F.col("subtotal") - F.col("discount_total"), tax_rate))
    lines = apportion(lines, "tax_total", "line_taxable", "id", "line_no", "line_tax")
    parents = lines.groupBy("id").agg(F.first("subtotal").alias("subtotal"), F.first("discount_total").alias("discount_total"), F.first("tax_total").alias("tax_total")).select(
        "*", F.lit(shipping).cast("long").alias("shipping"), (F.col("subtotal") - F.col("discount_total") + F.col("tax_total") + shipping).alias("grand_total")
    )
    return parents, lines.drop("subtotal", "discount_total", "tax_total")
