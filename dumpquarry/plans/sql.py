"""User SQL as written for other engines: QUALIFY, ASOF joins, null order and quoted names, rewritten to what Spark parses."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|\d+(?:\.\d+)?|\s+|.", re.S)
_AFTER_QUALIFY = {"ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT"}


def tokens(sql: str) -> list[str]:
    return _TOKEN.findall(sql)


def _is_word(t: str, word: str) -> bool:
    return t.upper() == word


def quoted_names(sql: str) -> str:
    """Double-quoted names in backquotes."""
    return "".join("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`" if t.startswith('"') else t for t in tokens(sql))


def nulls_last(sql: str) -> str:
    """ORDER BY items without an explicit null order get NULLS LAST, at the end of a query and in windows."""
    ts = tokens(sql)
    out: list[str] = []
    depth = 0
    open_at: list[int] = []  # depths at which an ORDER BY is being read
    item: list[str] = []

    def close() -> None:
        if item and "".join(item).strip() and not re.search(r"\bNULLS\s+(FIRST|LAST)\b", "".join(item), re.I):
            text = "".join(item)
            out.append(text.rstrip() + " NULLS LAST" + text[len(text.rstrip()) :])
        else:
            out.extend(item)
        item.clear()

    i = 0
    while i < len(ts):
        t = ts[i]
        if open_at and depth == open_at[-1]:
            word = t.upper()
            ends = t == ")" or word in ("LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "FETCH", ";")
            if t == "," or ends:
                close()
                out.append(t)
                if ends:
                    open_at.pop()
                if t == ")":
                    depth -= 1
                i += 1
                continue
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        (item if open_at else out).append(t)
        if _is_word(t, "BY"):
            before = [x for x in (item if open_at else out)[:-1] if x.strip()]
            if before and _is_word(before[-1], "ORDER"):
                if open_at:  # a window within an outer ORDER BY: its text is rewritten on its own
                    rest = "".join(ts[i + 1 :])
                    inner, used = _inner_order(rest)
                    item.append(inner)
                    i += used
                else:
                    open_at.append(depth)
        i += 1
    if open_at:
        close()
    return "".join(out)


def _inner_order(rest: str) -> tuple[str, int]:
    """The items of an ORDER BY within parentheses, rewritten, and the number of tokens they took."""
    ts, depth, n = tokens(rest), 0, 0
    for n, t in enumerate(ts):
        if t == "(":
            depth += 1
        elif t == ")":
            if depth == 0:
                break
            depth -= 1
    return nulls_last("ORDER BY" + "".join(ts[:n]))[len("ORDER BY") :], n


def qualify(sql: str) -> str:
    """``SELECT ... QUALIFY condition`` as a filter over a subquery that computes the condition."""
    ts = tokens(sql)
    at = next((i for i, t in enumerate(ts) if _is_word(t, "QUALIFY")), None)
    if at is None:
        return sql
    depth, begin = 0, None
    for i in range(at - 1, -1, -1):
        if ts[i] == ")":
            depth += 1
        elif ts[i] == "(":
            if depth == 0:
                break
            depth -= 1
        elif depth == 0 and _is_word(ts[i], "SELECT"):
            begin = i
            break
    if begin is None:
        raise ValueError("QUALIFY without SELECT")
    depth, end = 0, len(ts)
    for i in range(at + 1, len(ts)):
        if ts[i] == "(":
            depth += 1
        elif ts[i] == ")":
            if depth == 0:
                end = i
                break
            depth -= 1
        elif depth == 0 and ts[i].upper() in _AFTER_QUALIFY | {";"}:
            end = i
            break
    depth, source = 0, at
    for i in range(begin + 1, at):
        depth += (ts[i] == "(") - (ts[i] == ")")
        if depth == 0 and _is_word(ts[i], "FROM"):
            source = i
            break
    head, body, condition = "".join(ts[begin:source]).rstrip(), "".join(ts[source:at]), "".join(ts[at + 1 : end]).strip()
    hidden, order, end = _hidden_order(ts, end)
    extra = "".join(f", {expression} AS {name}" for name, expression in hidden)
    names = ", ".join(["_qualified", *[n for n, _ in hidden]])
    rewritten = f"SELECT * EXCEPT ({names}) FROM ({head}{extra}, ({condition}) AS _qualified {body}) WHERE _qualified {order}"
    return qualify("".join(ts[:begin]) + rewritten + "".join(ts[end:]))


def _hidden_order(ts: list[str], at: int) -> tuple[list[tuple[str, str]], str, int]:
    """The ORDER BY that begins at a token, its expressions moved into hidden columns: those, the new clause, and where it ended."""
    words = [i for i in range(at, len(ts)) if ts[i].strip()]
    if len(words) < 3 or not _is_word(ts[words[0]], "ORDER") or not _is_word(ts[words[1]], "BY"):
        return [], "", at
    items, item, depth, end = [], "", 0, len(ts)
    for i in range(words[1] + 1, len(ts)):
        t = ts[i]
        if depth == 0 and (t in (")", ";") or t.upper() in ("LIMIT", "OFFSET", "UNION", "FETCH")):
            end = i
            break
        depth += (t == "(") - (t == ")")
        if t == "," and depth == 0:
            items.append(item)
            item = ""
        else:
            item += t
    items.append(item)
    hidden, out = [], []
    for n, text in enumerate(items):
        m = re.fullmatch(r"\s*(.*?)((?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?)\s*", text, re.I | re.S)
        if m[1].isdigit():
            out.append(text.strip())
        else:
            hidden.append((f"_order{n}", m[1]))
            out.append(f"_order{n}{m[2]}")
    return hidden, f"ORDER BY {', '.join(out)} ", end


_ASOF = re.compile(r"\bFROM\s+(\w+)(?:\s+(?:AS\s+)?(\w+))?\s+ASOF\s+(LEFT\s+)?JOIN\s+(\w+)(?:\s+(?:AS\s+)?(\w+))?\s+ON\s+(.*?)(?=\bWHERE\b|\bGROUP\b|\bORDER\b|\bLIMIT\b|\bQUALIFY\b|\)|;|\Z)", re.I | re.S)


def asof_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_time: str, right_time: str, how: str = "left", strict: bool = False, bucket_seconds: int = 86_400) -> DataFrame:
    """Each left row with the latest right row of its keys that is not later: columns ``l`` and ``r``, both structs.

    Rows of both sides are united and each (key, time bucket) takes its last right row by a window; a bucket without
    one before a left row takes it from the last earlier bucket that has any, found among one row per bucket. So a hot
    key is spread over its buckets, and no pairs are formed. With ``strict``, the right row must be earlier.
    """
    k = len(on)
    keys = [f"_k{i}" for i in range(k)]
    bucket = F.floor(F.col("_t").cast("timestamp").cast("double") / bucket_seconds) if right.schema[right_time].dataType.typeName().startswith("timestamp") else F.floor(F.col("_t") / bucket_seconds)
    rank = (0, 1) if not strict else (1, 0)  # at equal times the right row comes before the left one, or after it
    none_r, none_l = F.lit(None).cast(right.select(F.struct("*").alias("s")).schema["s"].dataType), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType)
    r = right.select(*[F.col(f"`{b}`").alias(keys[i]) for i, (_, b) in enumerate(on)], F.col(f"`{right_time}`").alias("_t"), F.lit(rank[0]).alias("_side"), none_l.alias("l"), F.struct("*").alias("r"))
    l = left.select(*[F.col(f"`{a}`").alias(keys[i]) for i, (a, _) in enumerate(on)], F.col(f"`{left_time}`").alias("_t"), F.lit(rank[1]).alias("_side"), F.struct("*").alias("l"), none_r.alias("r"))  # noqa: E741
    both = r.unionByName(l).withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_r", F.last("r", ignorenulls=True).over(inside)).where("l is not null")
    ends = both.where("r is not null and _t is not null").groupBy(*keys, "_b").agg(F.max_by("r", "_t").alias("_end"))
    # the buckets in which left rows miss a partner, among the buckets that have one: a row per key and bucket
    asked = filled.where("_r is null").select(*keys, "_b").distinct().withColumn("_end", none_r)
    chain = ends.unionByName(asked).groupBy(*keys, "_b").agg(F.max(F.col("_end").isNull()).alias("_ask"), F.first("_end", ignorenulls=True).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.withColumn("_carry", F.last("_end", ignorenulls=True).over(w)).where("_ask").select(*[F.col(c).alias(f"c{c}") for c in (*keys, "_b")], "_carry")
    match = F.col("_b").eqNullSafe(F.col("c_b"))
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"c{c}"))
    out = filled.join(carried, match & F.col("_r").isNull(), "left").select("l", F.coalesce("_r", "_carry").alias("r"))
    return out if how == "left" else out.where("r is not null")


def _asof(spark: SparkSession, sql: str) -> str:
    def rewrite(m: re.Match) -> str:
        left, la, outer, right, ra, condition = m[1], m[2] or m[1], m[3], m[4], m[5] or m[4], m[6]
        on, times, strict = [], None, False
        for part in re.split(r"\bAND\b", condition, flags=re.I):
            c = re.fullmatch(r"\s*(\w+)\.(\w+)\s*(=|>=|>|<=|<)\s*(\w+)\.(\w+)\s*", part)
            if not c:
                raise ValueError(f"ASOF condition {part.strip()}")
            a, b, op = (c[1], c[2]), (c[4], c[5]), c[3]
            if a[0].lower() != la.lower():
                a, b, op = b, a, {"<=": ">=", "<": ">", "=": "="}.get(op, op)
            if op == "=":
                on.append((a[1], b[1]))
            else:
                times, strict = (a[1], b[1]), op == ">"
        view = f"_asof_{uuid.uuid4().hex[:12]}"
        joined = asof_join(spark.table(left), spark.table(right), on, times[0], times[1], "left" if outer else "inner", strict)
        joined.select(F.col("l").alias(la), F.col("r").alias(ra)).createOrReplaceTempView(view)
        return f"FROM {view} "

    return _ASOF.sub(rewrite, sql)


def translate(spark: SparkSession, sql: str) -> str:
    """SQL for Spark. ASOF joins become views of structs named like the tables, so that ``a.x`` still reads."""
    return qualify(nulls_last(quoted_names(_asof(spark, sql))))


def run(spark: SparkSession, sql: str) -> DataFrame:
    """The result of user SQL; division by zero and failed casts give null, as with ANSI off."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        return spark.sql(translate(spark, sql))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
