"""Loops that run to a fix point, and joins on pieces of names, against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sluice.operators import graph, linkers
from tests.program import got, node, program


def test_climb_a_thousand_levels_in_ten_joins(spark, monkeypatch):
    nodes = [node(k, "BLOCK" if k == 3 else "CALL") for k in range(1001)]
    p = program(spark, nodes, [(k, "AST", k + 1) for k in range(1000)])
    rounds = []
    monkeypatch.setattr(graph, "keep", lambda df, tag, real=graph.keep: rounds.append(tag) or real(df, tag))
    rows = {r.id: (r.reached, r.found) for r in graph.climb(p, p.nodes, F.col("label") == "BLOCK").collect()}
    assert rows == {k: (3, True) if k > 3 else (0, False) for k in range(1001)}
    assert len(rounds) <= 12


def test_climb_in_a_circle_and_without_a_parent(spark):
    p = program(spark, [node(k, "CALL") for k in range(5)], [(1, "AST", 2), (2, "AST", 3), (3, "AST", 1), (3, "AST", 4)])
    assert {(r.id, r.found) for r in graph.climb(p, p.nodes, F.col("label") == "BLOCK").collect()} == {(k, False) for k in range(5)}
    assert {r.id: (r.reached, r.found) for r in graph.climb(p, p.nodes, F.col("id") == 2).collect()} == {0: (0, False), 1: (2, True), 2: (2, True), 3: (2, True), 4: (2, True)}


def assign(at, left, right):
    return [node(at, "CALL", graph.ASSIGNMENT), left, right], [(at, "ARGUMENT", left[1]), (at, "ARGUMENT", right[1])]


def build(spark, *parts):
    return program(spark, [x for n, _ in parts for x in n], [x for _, e in parts for x in e])


def test_ten_copies_a_field_and_a_return(spark):
    parts = [assign(10, node(11, "IDENTIFIER", "v0", arg=1), node(12, "CALL", type="T", arg=2))]
    parts += [assign(100 + 10 * k, node(101 + 10 * k, "IDENTIFIER", f"v{k + 1}", arg=1), node(102 + 10 * k, "IDENTIFIER", f"v{k}", arg=2)) for k in range(10)]
    field = lambda c, name: ([node(c, "CALL", graph.FIELD_ACCESS[0], arg=1 if name == "put" else 2), node(c + 1, "IDENTIFIER", "self", arg=1), node(c + 2, "FIELD_IDENTIFIER", "users", arg=2)], [(c, "ARGUMENT", c + 1), (c, "ARGUMENT", c + 2)])
    put, get = field(300, "put"), field(310, "get")
    parts += [put, get, ([node(320, "CALL", graph.ASSIGNMENT), node(321, "IDENTIFIER", "v10", arg=2)], [(320, "ARGUMENT", 300), (320, "ARGUMENT", 321)])]
    parts += [([node(330, "CALL", graph.ASSIGNMENT), node(331, "IDENTIFIER", "w", arg=1)], [(330, "ARGUMENT", 331), (330, "ARGUMENT", 310)])]
    parts += [([node(400, "METHOD", full="m.f"), node(401, "RETURN"), node(402, "IDENTIFIER", "w", arg=1)], [(400, "CONTAINS", 401), (401, "ARGUMENT", 402)])]
    parts += [([node(410, "CALL", graph.ASSIGNMENT, file="g"), node(411, "IDENTIFIER", "z", arg=1, file="g"), node(412, "CALL", "f", arg=2, file="g")], [(410, "ARGUMENT", 411), (410, "ARGUMENT", 412), (412, "CALL", 400)])]
    hints = {r.id: r.type_hints for r in linkers.recovered_types(build(spark, *parts)).collect()}
    assert hints[191] == ["T"] and hints[331] == ["T"] and hints[411] == ["T"] and hints[302] == ["T"] and hints[301] == []


def test_copies_in_a_circle_end(spark):
    parts = [assign(10, node(11, "IDENTIFIER", "a", arg=1), node(12, "IDENTIFIER", "b", arg=2)), assign(20, node(21, "IDENTIFIER", "b", arg=1), node(22, "IDENTIFIER", "a", arg=2)), assign(30, node(31, "IDENTIFIER", "a", arg=1), node(32, "LITERAL", type="S", arg=2))]
    hints = {r.id: r.type_hints for r in linkers.recovered_types(build(spark, *parts)).collect()}
    assert hints[11] == hints[12] == hints[21] == ["S"]


@pytest.mark.parametrize("seed", range(3))
def test_reaching_definitions_equal_a_search_by_hand(spark, seed):
    rng = random.Random(seed)
    nodes, edges, cfg, kills, gens, uses = [node(1, "METHOD"), node(2, "PARAMETER", "a")], [(1, "AST", 2)], set(), {}, [(2, "a", 1)], []
    order = [1]
    for k in range(1, 13):
        at = 10 * k
        if rng.random() < 0.5:
            name = rng.choice("ab")
            nodes += [node(at, "CALL", graph.ASSIGNMENT), node(at + 1, "IDENTIFIER", name, arg=1)]
            edges += [(at, "ARGUMENT", at + 1), (1, "CONTAINS", at)]
            kills[at] = name
            gens.append((at + 1, name, at))
        else:
            name = rng.choice("ab")
            nodes.append(node(at, "IDENTIFIER", name))
            uses.append((at, name))
        cfg.add((order[-1], at))
        order.append(at)
    cfg |= {(rng.choice(order), rng.choice(order[1:])) for _ in range(5)}
    p = program(spark, nodes, [*edges, *((a, "CFG", b) for a, b in cfg)])
    after = defaultdict(set)
    for a, b in cfg:
        after[a].add(b)
    want = set()
    for d, name, at in gens:
        todo, seen = list(after[at]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want |= {(d, x) for u, n in uses if u == x and n == name}
                todo += [] if kills.get(x) == name else after[x]
    assert set(got(linkers.definition_uses(p), "src", "dst")) == want
    assert linkers.definition_uses(p, 1).count() == (0 if len(gens) > 1 else len(want))


def captured(spark, redefined, control=True):
    """x = ..; (x = ..;) use in a lambda that a METHOD_REF makes."""
    nodes = [node(1, "METHOD", "outer"), node(10, "CALL", graph.ASSIGNMENT, line=2), node(11, "IDENTIFIER", "x", arg=1, line=2), node(40, "METHOD_REF", line=4), node(50, "METHOD", "inner"), node(51, "IDENTIFIER", "x", line=5), node(52, "IDENTIFIER", "x", line=6), node(60, "IDENTIFIER", "x", line=8)]
    edges = [(1, "CONTAINS", 10), (1, "CONTAINS", 11), (1, "CONTAINS", 60), (10, "ARGUMENT", 11), (50, "CONTAINS", 51), (50, "CONTAINS", 52), (1, "CAPTURES", 50), (40, "REF", 50)]
    line = [1, 11, 10, 40, 60]
    if redefined:
        nodes += [node(20, "CALL", graph.ASSIGNMENT, line=3), node(21, "IDENTIFIER", "x", arg=1, line=3)]
        edges += [(1, "CONTAINS", 20), (1, "CONTAINS", 21), (20, "ARGUMENT", 21)]
        line = [1, 11, 10, 21, 20, 40, 60]
    if control:
        edges += [(a, "CFG", b) for a, b in zip(line, line[1:])]
    return got(linkers.lambda_captures(program(spark, nodes, edges)), "src", "dst")


def test_captures_of_a_variable_that_is_assigned_anew(spark):
    assert captured(spark, False) == [(11, 51), (52, 60)]
    assert captured(spark, True) == [(21, 51), (52, 60)]  # the first value never gets into the lambda
    assert captured(spark, True, control=False) == [(11, 51), (21, 51), (52, 60)]


def test_names_met_by_their_pieces(spark):
    rng = random.Random(5)
    names = ["".join(rng.choice("abAB.") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    types = spark.createDataFrame([("r", n) for n in names], "repo string, type_full_name string")
    wanted = ["".join(rng.choice("abAB") for _ in range(rng.randrange(0, 4))) for _ in range(25)]
    tables = spark.createDataFrame([("r", n) for n in wanted], "repo string, table_name string")
    want = {(t, min(n for n in names if n.lower().endswith(t.lower()))) for t in wanted if t and any(n.lower().endswith(t.lower()) for n in names)}
    assert set(got(graph.class_of_table(types, tables), "table_name", "type_full_name")) == want
    files = [(k, f"models/{n}.sql") for k, n in enumerate(names)]
    models = [(1000 + k, m) for k, m in enumerate([*wanted, "models/", "odels/a", ".sql", "ls/aab.sql"])]
    cols = spark.createDataFrame([("r", k, "S", f) for k, f in files], "repo string, id long, rule_id string, file string")
    syncs = spark.createDataFrame([("r", k, "T", m) for k, m in models], "repo string, id long, rule_id string, model string")
    assert set(got(linkers.synced_flows(cols, syncs), "path_id")) == {(f"{a}-{b}",) for a, f in files for b, m in models if m and m in f}


def test_definitions_go_through_a_run_without_a_round_for_each_node(spark, monkeypatch):
    n = 40
    nodes = [node(0, "METHOD"), node(1, "PARAMETER", "x")] + [node(k, "IDENTIFIER", "x") for k in range(2, n)]
    edges = [(0, "AST", 1), (0, "CFG", 2), *((k, "CFG", k + 1) for k in range(2, n - 1)), (100, "CFG", 101), (101, "CFG", 100)]
    rounds, keep = [], linkers.keep
    monkeypatch.setattr(linkers, "keep", lambda df, tag: rounds.append(tag) or keep(df, tag))
    assert got(linkers.definition_uses(program(spark, nodes, edges)), "src", "dst") == sorted(((1, k) for k in range(2, n)), key=repr)
    assert len(rounds) < 20


def test_a_long_way_of_copies_takes_few_rounds(spark, monkeypatch):
    """Sixty-four variables in a row, two that meet, and a circle that nothing comes into."""
    copies = [(f"v{k + 1}", f"v{k}") for k in range(64)] + [("m", "v64"), ("m", "w"), ("n", "m"), ("c1", "c2"), ("c2", "c1"), ("c3", "c1")]
    rounds = []
    monkeypatch.setattr(linkers, "keep", lambda df, tag, real=linkers.keep: rounds.append(tag) or real(df, tag))
    known = spark.createDataFrame([("r", "v0", "T"), ("r", "w", "U")], "repo string, slot string, type string")
    got_ = {(r.slot, r.type) for r in linkers.spread(known, spark.createDataFrame([("r", a, b) for a, b in copies], "repo string, slot string, origin string")).collect()}
    assert got_ == {(f"v{k}", "T") for k in range(65)} | {("w", "U"), ("m", "T"), ("m", "U"), ("n", "T"), ("n", "U")}
    assert len(rounds) <= 20
