"""Flows across calls: depth, matching, semantics, and random programs against a search by hand."""

import random
from dataclasses import replace

import pytest

from sluice.operators import calls
from sluice.operators.graph import EDGE
from tests.program import node, program

SEM = "signature string, flow string"


def seeds(spark, *ids, repo="r"):
    return spark.createDataFrame([(repo, i) for i in ids], "repo string, id long")


def found(df):
    return sorted(tuple(r.path) for r in df.collect())


def method(m, *body):
    """Nodes and edges of method m: parameter m + 1, result m + 2."""
    return [node(m, "METHOD"), node(m + 1, "PARAMETER", arg=1), node(m + 2, "METHOD_RETURN"), *body], [(m, "AST", m + 1), (m, "AST", m + 2)]


def call(c, to=None, full="", args=((1, 1),)):
    """A call node c with argument nodes c + k at places."""
    nodes = [node(c, "CALL", full=full), *(node(c + k, "IDENTIFIER", arg=at) for k, at in args)]
    return nodes, [(c, "ARGUMENT", c + k) for k, _ in args] + ([(c, "CALL", to)] if to else [])


def joined(*parts):
    return [x for n, _ in parts for x in n], [x for _, e in parts for x in e]


def test_thirty_edges_in_one_method(spark):
    nodes = [node(k, "IDENTIFIER") for k in range(31)]
    p = program(spark, nodes, [(k, "FLOWS", k + 1) for k in range(30)])
    assert found(calls.reach_by_calls(p, seeds(spark, 0), seeds(spark, 30))) == [tuple(range(31))]
    branched = program(spark, [*nodes, node(99, "IDENTIFIER")], [*((k, "FLOWS", k + 1) for k in range(30)), (10, "FLOWS", 99), (99, "FLOWS", 12)])
    assert len(found(calls.reach_by_calls(branched, seeds(spark, 0), seeds(spark, 30)))) == 2


def nested(spark, depth):
    """main passes x to f1, which passes it to f2, and so on; the innermost has the sink."""
    parts = []
    for k in range(depth):
        c, m = 1000 + 10 * k, 100 * (k + 1)
        inside = node(m + 3, "CALL", "sink") if k == depth - 1 else None
        n, e = method(m, *([inside] if inside else []))
        to = m + 3 if inside else c + 11
        parts += [call(c, m), (n, [*e, (m + 1, "FLOWS", to)])]
    nodes, edges = joined(*parts)
    return program(spark, [node(1, "IDENTIFIER"), *nodes], [(1, "FLOWS", 1001), *edges]), 100 * depth + 3


def test_four_calls_are_followed_and_a_fifth_is_not(spark):
    p, sink = nested(spark, 4)
    assert len(found(calls.reach_by_calls(p, seeds(spark, 1), seeds(spark, sink)))) == 1
    p, sink = nested(spark, 5)
    assert found(calls.reach_by_calls(p, seeds(spark, 1), seeds(spark, sink))) == []
    assert len(found(calls.reach_by_calls(p, seeds(spark, 1), seeds(spark, sink), context=calls.EngineContext(max_call_depth=5)))) == 1


def test_a_return_goes_back_to_its_own_caller(spark):
    """Two callers of the identity: what the first passes in does not come out at the second."""
    n, e = method(100)
    nodes, edges = joined((n, [*e, (101, "FLOWS", 102)]), call(10, 100), call(20, 100))
    nodes += [node(k, "IDENTIFIER") for k in (1, 2, 3, 4)]
    edges += [(1, "FLOWS", 11), (10, "FLOWS", 3), (2, "FLOWS", 21), (20, "FLOWS", 4), (11, "FLOWS", 10), (21, "FLOWS", 20)]
    p = program(spark, nodes, edges)
    assert found(calls.reach_by_calls(p, seeds(spark, 1, 2), seeds(spark, 3, 4))) == [(1, 11, 101, 102, 10, 3), (2, 21, 101, 102, 20, 4)]
    assert found(calls.reach_by_calls(p, seeds(spark, 101), seeds(spark, 3, 4))) == [(101, 102, 10, 3), (101, 102, 20, 4)]  # a source inside leaves to all callers


def test_a_summary_stands_for_the_body_and_kills_or_taints(spark):
    nodes, edges = joined(call(10, full="lib.f", args=((1, 0), (2, 1))))
    nodes += [node(k, "IDENTIFIER") for k in (1, 5, 6, 7)]
    edges += [(1, "FLOWS", 12), (12, "FLOWS", 10), (10, "FLOWS", 5), (12, "FLOWS", 6), (11, "FLOWS", 7), (12, "FLOWS", 11)]
    p = program(spark, nodes, edges)

    def ends(flow):
        table = spark.createDataFrame([("lib.f", flow)] if flow is not None else [], SEM)
        return found(calls.reach_by_calls(p, seeds(spark, 1), seeds(spark, 5, 6, 7), table))

    assert ends(None) == [(1, 12, 6), (1, 12, 10, 5), (1, 12, 11, 7)]  # nothing known: as the front end has it
    assert ends("0->0") == []  # the argument is killed
    assert ends("1->1") == [(1, 12, 6)]
    assert ends("1->-1") == [(1, 12, 10, 5)]
    assert ends('0->0 1 "value"->0') == [(1, 12, 11, 7)]  # a mutator taints its receiver
    assert ends("") == []


def test_argument_limit_and_repositories(spark):
    n, e = method(100, node(103, "CALL", "sink"))
    parts = [(n, [*e, (101, "FLOWS", 103)])]
    for k in range(3):
        parts.append(call(200 + 10 * k, 100))
        parts.append(([node(k + 1, "IDENTIFIER")], [(k + 1, "FLOWS", 201 + 10 * k)]))
    nodes, edges = joined(*parts)
    p = program(spark, nodes, edges)
    run = lambda most: found(calls.reach_by_calls(p, seeds(spark, 1, 2, 3), seeds(spark, 103), context=calls.EngineContext(max_arguments=most)))
    assert len(run(3)) == 3 and run(2) == []
    assert calls.engine_context("ruby").max_arguments == 100 and calls.engine_context("java").max_arguments is None and calls.engine_context("java", 7).max_arguments == 7
    other = replace(p, edges=p.edges.unionByName(spark.createDataFrame([("s", 1, 103, "FLOWS")], EDGE)))  # the same ids elsewhere
    assert found(calls.reach_by_calls(other, seeds(spark, 1), seeds(spark, 103))) == [(1, 201, 101, 103)]


def by_hand(steps, sources, sinks, most):
    """All ways by a search in depth, backwards."""
    back, out = {}, set()
    for a, via, b, kind, site in steps:
        back.setdefault(b, []).append((a, via, kind, site))

    def walk(at, path, stack, depth, sink):
        if at in sources and len(path) > 1:
            out.add(tuple(path))
        for a, via, kind, site in back.get(at, []):
            s, d = stack, depth
            if kind == "leave":
                s, d = (*stack, site), depth + 1
            elif kind == "enter":
                if stack and stack[-1] != site:
                    continue
                s, d = (stack[:-1], depth - 1) if stack else ((), depth + 1)
            if d <= most and not {a, *via} & set(path):
                walk(a, [a, *via, *path], s, d, sink)

    for k in sinks:
        walk(k, [k], (), 0, k)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_random_steps_equal_a_search_by_hand(spark, seed):
    rng = random.Random(seed)
    steps = {(a, (), b, "flow", None) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(38)) if a != b}
    for site in range(100, 106):
        a, b, r, c = (rng.randrange(40) for _ in range(4))
        steps |= {(a, (), b, "enter", site), (r, (), c, "leave", site)} if a != b and r != c else set()
    steps |= {(50 + k, (), 51 + k, "flow", None) for k in range(20)} | {(rng.randrange(40), (), 50, "flow", None), (70, (), rng.randrange(40), "flow", None), (rng.randrange(40), (90,), rng.randrange(40), "flow", None)}
    steps = {s for s in steps if s[0] != s[2]}
    df = spark.createDataFrame([("r", a, list(via), b, kind, site) for a, via, b, kind, site in steps], "repo string, a long, via array<long>, b long, kind string, site long")
    sources, sinks = rng.sample(range(40), 8), rng.sample(range(40), 8)
    got = calls.paths(df, seeds(spark, *sources), seeds(spark, *sinks), calls.EngineContext(max_call_depth=2))
    rows = [tuple(r.path) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(steps, set(sources), sinks, 2)
    least = calls.paths(df, seeds(spark, *sources), seeds(spark, *sinks), calls.EngineContext(max_call_depth=2, shortest_only=True))
    assert {tuple(r.path) for r in least.collect()} <= set(rows)
    assert {(r.source, r.sink) for r in least.select("source", "sink").collect()} <= {(x[0], x[-1]) for x in rows}


def test_an_argument_of_two_calls_keeps_the_flow_of_the_unknown_one(spark):
    """One call has semantics that stop the flow, the other none; calls without either are not joined at all."""
    from tests.program import got

    nodes = [node(1, "CALL", full="lib.known"), node(2, "CALL", full="lib.other"), node(3, "IDENTIFIER", arg=1), node(4, "IDENTIFIER")]
    p = program(spark, nodes, [(1, "ARGUMENT", 3), (2, "ARGUMENT", 3), (3, "FLOWS", 4), (3, "FLOWS", 2)])
    table = spark.createDataFrame([("lib.known", "0->0")], "signature string, flow string")
    assert got(calls.steps(p, table), "a", "b") == [(3, 2), (3, 4)]
    alone = program(spark, nodes, [(1, "ARGUMENT", 3), (3, "FLOWS", 4), (3, "FLOWS", 2)])
    assert got(calls.steps(alone, table), "a", "b") == []
    assert got(calls.steps(alone), "a", "b") == [(3, 2), (3, 4)]


def test_a_program_without_calls_of_its_own_makes_no_tables_for_them(spark, monkeypatch):
    """Flows that fork at every node: nothing to class and no run to join."""
    made = []
    monkeypatch.setattr(calls, "keep", lambda df, tag, real=calls.keep: made.append(tag) or real(df, tag))
    nodes, edges = joined(call(10))
    p = program(spark, [*nodes, *(node(k, "IDENTIFIER") for k in (1, 2, 3))], [*edges, (1, "FLOWS", 2), (1, "FLOWS", 3), (2, "FLOWS", 10), (3, "FLOWS", 10)])
    assert found(calls.reach_by_calls(p, seeds(spark, 1, 2, 3), seeds(spark, 10))) == [(1, 2, 10), (1, 3, 10), (2, 10), (3, 10)]
    assert not {"classed", "arguments", "runs", "contracted"} & set(made)


def test_reached_reads_only_steps_that_lie_ahead(spark, monkeypatch):
    rows = []

    def counted(df, tag, real=calls.keep):
        out = real(df, tag)
        rows.extend([out.count()] if tag == "ahead" else [])
        return out

    monkeypatch.setattr(calls, "keep", counted)
    steps = spark.createDataFrame([("r", a, b) for a, b in [(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)]], "repo string, a long, b long")
    assert {r.id for r in calls.reached(steps, seeds(spark, 1)).collect()} == {1, 2, 3, 4}
    assert rows == [4, 3, 2, 1]
