"""The core operators on the domain tables against SQL, and on small fixtures with the awkward cases."""

import datetime
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dumpquarry.operators import copydiff, hierarchy, parse_errors, quality, references
from dumpquarry.plans import problems
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(problems.SQL))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, problems.QUERIES[name], problems.SQL[name], connect(SF)) is None


def at(day):
    return datetime.datetime(2024, 1, day)


# --- references


def test_reference_states(spark):
    parent = spark.createDataFrame([(1, at(1), None), (2, at(9), None), (3, at(1), at(2)), (3, at(8), at(2)), (None, at(1), None)], "id long, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    rows = [(10, 1, at(3), at(3)), (11, 2, at(3), at(3)), (11, 2, at(20), at(3)), (12, 3, at(3), at(3)), (13, 9, at(3), at(3)), (14, None, at(3), at(3)), (15, 2, None, None), (16, 8, at(3), None)]
    child = spark.createDataFrame([(*r, "x") for r in rows], "id long, fk long, loaded_at timestamp_ntz, happened timestamp_ntz, parent string")
    refs = [references.Reference("child", "fk", "parent", "happened", deleted_field="deleted_at")]
    tables = {"child": child, "parent": parent}
    got = {tuple(r) for r in references.orphan_references(tables, refs).collect()}
    m = "2024-01"
    assert got == {("child", "fk", 11, "late", m), ("child", "fk", 12, "deleted", m), ("child", "fk", 13, "missing", m), ("child", "fk", 16, "missing", None)}
    assert references.orphan_references({"child": child.limit(0), "parent": parent}, refs).collect() == []
    assert {r.ref_state for r in references.orphan_references({"child": child, "parent": parent.limit(0)}, refs).collect()} == {"missing"}
    counts = {(r.ref_state, r.n) for r in references.orphan_counts(references.orphan_references(tables, refs)).collect()}
    assert ("late", 1) in counts


# --- hierarchies


def brute_tree(links):
    """id -> (kind, root, path) by walking up."""
    out = {}
    for v in links:
        path, seen, x = [v], {v}, links[v]
        while x is not None and x in links and x not in seen:
            path.append(x)
            seen.add(x)
            x = links[x]
        if x is None:
            out[v] = ("root", path[-1], path[::-1])
        elif x not in links:
            out[v] = ("detached", None, None)
        else:
            out[v] = ("cycle" if x == v else "below_cycle", None, None)
    return out


def random_links(seed, n):
    r = random.Random(seed)
    links = {}
    for v in range(n):
        pick = r.random()
        links[v] = None if pick < 0.03 else n + r.randrange(5) if pick < 0.05 else v if pick < 0.06 else r.randrange(max(0, v - 6), v + (6 if pick > 0.93 else 1))
    for v in range(n, n + 120):  # one long line
        links[v + 100] = v + 99 if v > n else 0
    return links


@pytest.mark.parametrize(("seed", "group_rows", "fan_in", "groups"), [(1, 500_000, 16, 12), (2, 40, 3, 1), (3, 25, 2, 7), (4, 500_000, 16, 1), (5, 3, 100, 4)])
def test_hierarchy_equals_walking(spark, seed, group_rows, fan_in, groups):
    links = random_links(seed, 300)
    df = spark.createDataFrame([(v, u, 0, at(1), "k") for v, u in links.items()], "id long, parent_id long, depth int, loaded_at timestamp_ntz, kind string")
    got = {r.id: (r.kind, r.root_id, list(r.path) if r.path else None) for r in hierarchy.resolve(df, group_rows, fan_in, groups).collect()}
    assert got == brute_tree(links)
    faults = {r.id for r in hierarchy.hierarchy_faults(hierarchy.resolve(df, group_rows, fan_in, groups, paths=False)).collect()}
    assert faults == {v for v, (k, root, path) in brute_tree(links).items() if k != "root" or len(path) != 1}


def test_hierarchy_edges(spark):
    schema = "id long, parent_id long, depth int, loaded_at timestamp_ntz"
    assert hierarchy.resolve(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(1, None, 0, at(1)), (1, None, 0, at(2)), (2, 1, None, at(1)), (3, 2, 2, None), (None, 1, 1, at(1)), (4, 1, 7, at(1)), (4, 3, 3, at(2))], schema)
    got = {r.id: (r.kind, r.links) for r in hierarchy.resolve(df).collect()}
    assert got == {1: ("root", 0), 2: ("root", 1), 3: ("root", 2), 4: ("root", 3)}
    assert {(r.id, r.kind) for r in hierarchy.hierarchy_faults(hierarchy.resolve(df)).collect()} == {(2, "depth")}
    pairs = {tuple(r) for r in hierarchy.descendants(hierarchy.resolve(df)).collect()}
    assert pairs == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 3), (2, 4, 2), (3, 4, 1)}


# --- parse errors


def strict(line):
    """Fields of a line by hand, or None where the quoting is broken."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
        else:
            while i < len(line) and line[i] != ",":
                if line[i] == '"':
                    return None
                i += 1
        fields.append(1)
        if i == len(line):
            return fields
        if line[i] != ",":
            return None
        i += 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab,"\n', max_size=14), st.integers(1, 4))
def test_error_parse_agrees_with_the_grammar(line, width):
    fields = strict(line)
    reason, cost, edits = parse_errors.diagnose(line, width)
    assert reason == ("quoting" if fields is None else "columns" if len(fields) != width else None)
    assert (cost == 0) == (reason is None) and len(edits.split("; ")) == max(1, cost)


def brute_cost(line, width):
    """Breadth-first over whole lines: the least number of inserted or deleted quotes and commas."""
    seen, wave, steps = {line}, {line}, 0
    while True:
        if any((f := strict(x)) is not None and len(f) == width for x in wave):
            return steps
        following = set()
        for x in wave:
            for i in range(len(x) + 1):
                following |= {x[:i] + c + x[i:] for c in ',"'}
                if i < len(x) and x[i] in ',"':
                    following.add(x[:i] + x[i + 1 :])
        wave, steps = following - seen, steps + 1
        seen |= wave


@pytest.mark.parametrize("width", [1, 3])
def test_edit_cost_is_the_least(width):
    for line in map("".join, itertools.product('a,"', repeat=4)):
        assert parse_errors.diagnose(line, width)[1] == brute_cost(line, width), line


def test_parse_reasons(spark):
    good = '1,2,,"a ""b"", c\nd",body,4.25,2024-02-29 23:59:59'
    lines = {
        1: good,
        2: good.replace("4.25", "5.01"),
        3: good.replace("02-29", "02-30"),
        4: '1,2,,a"b,body,4,2024-01-01 00:00:00',
        5: '1,2,,"a" ,body,4,2024-01-01 00:00:00',
        6: "1,2,,a,b,body,4,2024-01-01 00:00:00",
        7: "",
        8: None,
        9: '1,2,,"",body,,2024-01-01 00:00:00',
        10: "1,2,,,body,,2024-01-01 00:00:00",
        11: f"1,2,,{'t' * 201},body,,2024-01-01 00:00:00",
        12: f'1,2,,t,"{"x, " * 40_000}",,2024-01-01 00:00:00',
        13: f'1,2,,t,"{"x, " * 4_000},,2024-01-01 00:00:00',
        14: "1,2,,t\x07,body,,2024-01-01 00:00:00",
        15: good + "\n",
        16: "1,2,,t,body,6,2024-01-01 00:00:00",
        17: "1,2,,t,body,4,2024-01-01 24:00:00",
    }
    df = spark.createDataFrame([(i, x, "r", 1) for i, x in lines.items()] + [(7, "", "r", 2)], "line_id long, raw_line string, reason string, cost int")
    got = {r.line_id: r.reason for r in parse_errors.rejected_rows(df).collect()}
    assert got == {2: "value", 3: "value", 4: "quoting", 5: "quoting", 6: "columns", 7: "columns", 8: "columns", 10: "value", 11: "value", 13: "quoting", 14: "value", 15: "value", 16: "value", 17: "value"}
    valid = {r.line_id: r for r in parse_errors.valid_rows(df).collect()}
    assert set(valid) == {1, 9, 12}
    assert valid[1].title == 'a "b", c\nd' and valid[1].category_id is None and valid[1].rating == 4.25 and valid[9].title == ""
    assert len(valid[12].body) == 120_000
    assert parse_errors.rejected_rows(df.limit(0)).collect() == []


# --- quality


def test_quality_cases(spark):
    rows = []
    for load in (1, 2, 3):
        for i in range(20):
            email = None if load == 2 and i < 8 else f"u{load}.{i}@example.org"
            rows.append((load * 100 + i, email, "reader" if load < 3 or i < 10 else "admin", None, at(1), load, "v"))
    rows += [(1, "UPPER@example.org", "Reader", at(1), at(2), 1, "v"), (1, "UPPER@example.org", "Reader", at(1), at(2), 1, "v"), (2, "a@b.c\n", None, datetime.datetime(2026, 1, 1), at(1), None, "v")]
    df = spark.createDataFrame(rows, "id long, email string, role string, deleted_at timestamp_ntz, created_at timestamp_ntz, load_id int, value string")
    got = {tuple(r)[1:] for r in quality.quality_cases("users", df, quality.USER_DOMAINS).collect()}
    assert got == {("email", "value", 1), ("role", "value", 1), ("deleted_at", "value", 1), ("email", "value", 2), ("deleted_at", "value", 2), ("email", "shift", 2), ("email", "shift", 3), ("role", "shift", 3)}
    assert quality.quality_cases("users", df.limit(0), quality.USER_DOMAINS).collect() == []


def test_ratings(spark):
    rows = [(i, r, load) for load, values in ((1, [1.0, 2.0, None, float("nan"), 9.0]), (2, [2.0, 2.5, None, -0.5, -0.0])) for i, r in enumerate(values)]
    df = spark.createDataFrame([(i + 10 * load, r, load) for i, r, load in rows], "id long, rating double, load_id int")
    got = {tuple(r)[2:] for r in quality.quality_cases("posts", df, quality.POST_DOMAINS).collect()}
    assert got == {("value", 13), ("value", 14), ("value", 23)}


def test_counts_take_signed_deltas(spark):
    df = spark.createDataFrame([(1, "a" * 100, 1), (2, "a" * 100, 1), (3, None, 1), (4, "b", 2)], "id long, t string, load_id int")
    tables = quality.CountTables(spark).apply(df, ["t"], "load_id")
    tables.apply(df.where("id = 1"), ["t"], "load_id", sign=-1)
    got = {r.load_id: r for r in quality.profile(tables.compact().deltas()).collect()}
    assert (got[1].n_rows, got[1].n_distinct, got[1].null_rate, got[2].n_rows) == (2, 1, 0.5, 1)
    whole = quality.profile(tables.deltas(), upto=2).collect()[0]
    assert (whole.n_rows, whole.n_distinct, whole.entropy) == (3, 2, 1.0)


def test_text_range_is_whole_values(spark):
    low, high = "A" * 80 + "1", "z" * 80 + "2"
    df = spark.createDataFrame([(1, low, 1), (2, "A" * 80 + "2", 1), (3, "m", 1), (4, high, 1), (5, "z" * 80 + "1", 1), (6, "k" * 70, 2)], "id long, t string, load_id int")
    tables = quality.CountTables(spark).apply(df, ["t"], "load_id")
    got = {r.load_id: (r.text_min, r.text_max) for r in quality.profile(tables.deltas()).collect()}
    assert got == {1: (low, high), 2: ("k" * 70, "k" * 70)}
    tables.apply(df.where("id in (1, 4)"), ["t"], "load_id", sign=-1)
    for counts in (tables.log(), tables.deltas()):
        r = quality.profile(counts).where("load_id = 1").collect()[0]
        assert (r.text_min, r.text_max, r.n_rows, r.n_distinct) == ("A" * 80 + "2", "z" * 80 + "1", 3, 3)


# --- copies


def test_copy_differences(spark):
    a = spark.createDataFrame([(1, 1.5, "x", 1), (1, 1.5, "x", 2), (2, None, "y", 1), (3, 2.0, "z", 1), (4, 1.0, None, 1), (6, 1.0, "p", 1), (6, 1.0, "q", 1), (None, 1.0, "n", 1)], "id long, v double, s string, left_only int")
    b = spark.createDataFrame([(1, "x", 1.5), (2, "y", None), (2, "y", None), (3, "Z", 2.5), (5, "e", 1.0), (4, None, 1.0), (6, "p", 1.0)], "id long, s string, v double")
    got = {tuple(r) for r in copydiff.copy_differences(a, b, "id").collect()}
    assert got == {(3, "v"), (3, "s"), (5, "only_replica"), (6, "s")}
    assert {r.difference for r in copydiff.copy_differences(a, b.limit(0), "id").collect()} == {"only_primary"}
    assert copydiff.copy_differences(a.limit(0), b.limit(0), "id").collect() == []


def test_except_all(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (3,)], "k long")
    got = {(r.k, r._side, r._n) for r in copydiff.except_all_both(a, b, multiset=True).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (None, 1, 1), (3, -1, 1)}
