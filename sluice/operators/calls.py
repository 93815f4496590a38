"""Data flow across calls: paths whose calls and returns match, with the summaries (semantics) of methods applied to each step.

``steps`` turns the program's edges into steps (a, via, b, kind, site): a flow within a method, an entry from an argument to the
parameter of the method called at ``site``, or a way back from a method's result to the call. ``paths`` extends them from the
sinks backwards, each row with the stack of calls that it has yet to leave; its depth counts calls, never edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators._stage import keep
from sluice.operators.graph import Program

FLOW, ENTER, LEAVE = "flow", "enter", "leave"
STEP = ["repo", "a", "via", "b", "kind", "site"]


@dataclass(frozen=True)
class EngineContext:
    """Limits of a search: calls on the way that are not left again, arguments or results that one parameter or call may take (None: any),
    and whether one shortest way is enough for each (sink, node, stack), which bounds the work where ways multiply."""

    max_call_depth: int = 4
    max_arguments: int | None = None
    shortest_only: bool = False


ARGUMENT_LIMIT = 100  # of Ruby, or wherever a limit is asked for without a number


def engine_context(language: str, argument_limit: int | None = None, max_call_depth: int = 4) -> EngineContext:
    limit = argument_limit if argument_limit is not None else ARGUMENT_LIMIT if language == "ruby" else None
    return EngineContext(max_call_depth, limit)


# Semantics as positions

_MAPPING = r'(-?\d+)(?: "[^"]*")?->(-?\d+)'


def mappings(semantics: DataFrame) -> DataFrame:
    """(signature, i, j) of rows (signature, flow): argument i reaches argument j, or the result where j is -1."""
    pair = F.explode(F.regexp_extract_all("flow", F.lit(f"({_MAPPING})"), F.lit(1)))
    parts = semantics.select("signature", pair.alias("_m"))
    return parts.select("signature", F.regexp_extract("_m", _MAPPING, 1).cast("int").alias("i"), F.regexp_extract("_m", _MAPPING, 2).cast("int").alias("j")).distinct()


def callees(program: Program) -> DataFrame:
    """(repo, site, method): calls and the methods of the program that they call; external methods have no body to enter."""
    inner = program.of("METHOD").where(~F.coalesce("is_external", F.lit(False))).select("repo", F.col("id").alias("method"))
    edges = program.edges.where("label = 'CALL'").select("repo", F.col("src").alias("site"), F.col("dst").alias("method"))
    return edges.join(inner, ["repo", "method"])


def steps(program: Program, semantics: DataFrame | None = None, max_arguments: int | None = None) -> DataFrame:
    """All steps of a program.

    A call with semantics does what they say: argument i reaches the result with ``i->-1``, and what is done with argument j after the call is
    reached by each i with ``i->j``; all else stops there. A call of a method of the program without semantics is passed through its
    body only. Any other call keeps the flows that the front end gave it.
    """
    no = F.array().cast("array<bigint>")
    none = F.lit(None).cast("long")
    table = semantics if semantics is not None else program.nodes.sparkSession.createDataFrame([], "signature string, flow string")
    known = keep(table.select("signature").distinct().withColumn("_known", F.lit(True)), "signatures")
    rules = mappings(table)
    inside = callees(program)
    sites = inside.select("repo", F.col("site").alias("call")).distinct().withColumn("_inner", F.lit(True))
    # Calls that change what the front end gave, and only their arguments (with the other calls of these), are classed.
    called = program.of("CALL").select("repo", F.col("id").alias("call"), F.col("method_full_name").alias("signature"))
    special = keep(called.join(known, "signature", "left").join(sites, ["repo", "call"], "left").where("_known or _inner").select("repo", "call", "signature", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce("_inner", F.lit(False)).alias("inner")), "special")
    edges = program.edges.where("label = 'FLOWS'").select("repo", F.col("src").alias("a"), F.col("dst").alias("b"))
    if special.isEmpty():  # no semantics apply and no body is entered: the front end's flows are all there is
        return edges.select("repo", "a", no.alias("via"), "b", F.lit(FLOW).alias("kind"), none.alias("site")).distinct()
    pairs = program.edges.where("label = 'ARGUMENT'").select("repo", F.col("src").alias("call"), F.col("dst").alias("arg"))
    places = program.nodes.select("repo", F.col("id").alias("arg"), F.col("argument_index").alias("at"))
    args = keep(pairs.join(special, ["repo", "call"]).join(places, ["repo", "arg"]).select("repo", "call", "arg", "at", "signature", "known", "inner"), "arguments")
    others = pairs.join(args.select("repo", "arg").distinct(), ["repo", "arg"], "left_semi").join(special, ["repo", "call"], "left_anti")
    others = others.join(called.select("repo", "call"), ["repo", "call"]).select("repo", "arg", "call", F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("signature"), F.lit(False).alias("known"), F.lit(False).alias("inner"))
    own = args.select("repo", "arg", "call", "at", "signature", "known", "inner").unionByName(others).withColumnRenamed("arg", "a")
    classed = keep(edges.join(own, ["repo", "a"], "left"), "classed")
    peers = args.where("known").select("repo", F.col("arg").alias("b"), F.col("call").alias("_peer"))
    to_result = F.col("b") == F.col("call")
    free = F.col("call").isNull() | (~F.col("known") & ~(F.col("inner") & to_result))
    plain = classed.where(free).select("repo", "a", "b")
    after = classed.where(F.col("known") & ~to_result).join(peers, ["repo", "b"], "left").where(F.col("_peer").isNull() | (F.col("_peer") != F.col("call")))
    moves = args.where("known").join(rules, (args["signature"] == rules["signature"]) & (args["at"] == rules["i"])).select("repo", "call", F.col("arg").alias("from"), "at", "j")
    results = moves.where("j = -1").select("repo", F.col("from").alias("a"), F.col("call").alias("b"))
    through = after.select("repo", "call", F.col("at").alias("j"), F.col("a").alias("arg"), "b").join(moves.where("j >= 0"), ["repo", "call", "j"])
    through = through.select("repo", F.col("from").alias("a"), F.when(F.col("from") == F.col("arg"), no).otherwise(F.array("arg")).alias("via"), "b", F.lit(FLOW).alias("kind"), none.alias("site"))
    within = plain.unionByName(results).select("repo", "a", no.alias("via"), "b", F.lit(FLOW).alias("kind"), none.alias("site"))
    part = lambda label: program.of(label).select("repo", F.col("id").alias("part"), F.col("argument_index").alias("at"))
    ast = program.edges.where("label = 'AST'").select("repo", F.col("src").alias("method"), F.col("dst").alias("part"))
    entered = args.where("inner and not known").select("repo", F.col("call").alias("site"), "arg", "at").join(inside, ["repo", "site"])
    enter = entered.join(ast.join(part("PARAMETER"), ["repo", "part"]), ["repo", "method", "at"]).select("repo", F.col("arg").alias("a"), no.alias("via"), F.col("part").alias("b"), F.lit(ENTER).alias("kind"), "site")
    silent = program.of("CALL").select("repo", F.col("id").alias("site"), F.col("method_full_name").alias("signature")).join(known, "signature", "left_anti")
    leave = inside.join(silent.select("repo", "site"), ["repo", "site"]).join(ast.join(part("METHOD_RETURN").drop("at"), ["repo", "part"]), ["repo", "method"])
    leave = leave.select("repo", F.col("part").alias("a"), no.alias("via"), F.col("site").alias("b"), F.lit(LEAVE).alias("kind"), "site")
    if max_arguments is not None:
        enter, leave = _few(enter, max_arguments), _few(leave, max_arguments)
    return within.unionByName(through).unionByName(enter).unionByName(leave).distinct()


def _few(into: DataFrame, most: int) -> DataFrame:
    """Steps into nodes that no more than ``most`` of them lead to."""
    busy = into.groupBy("repo", "b").count().where(F.col("count") > most)
    return into.join(busy, ["repo", "b"], "left_anti")


# Paths

FEW_ROWS, FEW_BYTES = 100_000, 16 << 20


def _held(df: DataFrame, few: bool) -> DataFrame:
    """``df`` for a join: sent to all tasks if it is small, else neither side is. Files of ids and paths are a small part of what they take in memory, so their size does not tell."""
    return F.broadcast(df) if few else df.hint("merge")


def contracted(all_steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Steps with every unbranched run of flows as one, its inner nodes in ``via``. Runs double at each round: 1,000 flows in a row are ten rounds.

    ``ends`` (repo, id) are never inside a run.
    """
    plain = (F.col("kind") == FLOW).alias("plain")
    ways = all_steps.select("repo", F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"), plain).unionByName(all_steps.select("repo", F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into"), plain))
    degree = ways.groupBy("repo", "id").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.bool_and("plain").alias("plain")).where("out = 1 and into = 1 and plain").select("repo", "id")
    inner = keep(degree.join(ends, ["repo", "id"], "left_anti"), "inner")
    n = inner.count()
    if n == 0:
        return all_steps.select(*STEP)
    few = n <= FEW_ROWS
    marked = all_steps.select(*STEP).join(_held(inner.select("repo", F.col("id").alias("a"), F.lit(True).alias("_in")), few), ["repo", "a"], "left").join(_held(inner.select("repo", F.col("id").alias("b"), F.lit(True).alias("_on")), few), ["repo", "b"], "left")
    rows = keep(marked, "runs")
    whole = rows.where("_in is null and _on is null").select(*STEP)
    while not rows.where("_in is null and _on is not null").isEmpty():  # a round reads and writes rows of runs only
        following = rows.where("_in is not null").select("repo", F.col("a").alias("b"), F.col("via").alias("_via"), F.col("b").alias("_b"), F.col("_on").alias("_onward"))
        longer = rows.where("_on is not null").join(following if few else following.hint("merge"), ["repo", "b"]).select("repo", "a", F.concat("via", F.array("b"), "_via").alias("via"), F.col("_b").alias("b"), "kind", "site", "_in", F.col("_onward").alias("_on"))
        rows = keep(longer.unionByName(rows.where("_in is not null and _on is null").select(*longer.columns)), "runs")
        whole = whole.unionByName(rows.where("_in is null and _on is null").select(*STEP))
    return whole


def reached(all_steps: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, id): nodes that sources lead to, whatever the calls between.

    Steps to nodes that have been reached go after each round, so a round reads those that lie ahead and never what has been found.
    """
    new = keep(sources.select("repo", "id").distinct(), "reached")
    seen, n = new, new.count()
    ahead = all_steps.select("repo", F.col("a").alias("id"), "b")
    while True:
        held = _held(new, n <= FEW_ROWS)
        ahead = keep(ahead.join(held.withColumnRenamed("id", "b"), ["repo", "b"], "left_anti"), "ahead")
        new = keep(ahead.join(held, ["repo", "id"], "left_semi").select("repo", F.col("b").alias("id")).distinct(), "reached")
        n = new.count()
        if n == 0:
            return seen
        seen = seen.unionByName(new)


def paths(all_steps: DataFrame, sources: DataFrame, sinks: DataFrame, context: EngineContext = EngineContext()) -> DataFrame:
    """(repo, source, sink, path): all ways from a source to a sink that meet no node twice and whose calls match.

    Backwards, the result of a call leads into the method and puts the call on the stack; a parameter leads to the argument of the call on top of the
    stack, which goes, or with an empty stack to those of all callers. Calls on the stack and callers so gone to are at most ``max_call_depth``.
    Steps outside the nodes that sources reach are dropped first, and runs without a branch are one step.
    """
    first, last = keep(sources.select("repo", "id").distinct(), "sources"), keep(sinks.select("repo", "id").distinct(), "sinks")
    short = contracted(keep(all_steps, "steps"), first.unionByName(last).distinct())
    way = reached(short, first).withColumnRenamed("id", "a")
    starts = first.select("repo", F.col("id").alias("a"), F.lit(True).alias("_start"))
    useful = keep(short.join(way.hint("merge"), ["repo", "a"], "left_semi").join(starts.hint("merge"), ["repo", "a"], "left"), "useful")
    front = last.select("repo", F.col("id").alias("sink"), F.col("id").alias("b"), F.array("id").alias("path"), F.array().cast("array<bigint>").alias("stack"), F.lit(0).alias("depth"))
    top, size = F.try_element_at("stack", F.lit(-1)), F.size("stack")
    matches = F.when(F.col("kind") == ENTER, (size == 0) | (top == F.col("site"))).otherwise(True)
    stack = F.when(F.col("kind") == LEAVE, F.concat("stack", F.array("site"))).when((F.col("kind") == ENTER) & (size > 0), F.slice("stack", F.lit(1), size - 1)).otherwise(F.col("stack"))
    depth = F.col("depth") + F.when(F.col("kind") == FLOW, 0).when((F.col("kind") == ENTER) & (size > 0), -1).otherwise(1)
    more = F.concat(F.array("a"), "via")
    weight = F.sum(8 * (F.size("path") + F.size("stack")) + 100)
    found, few = None, last.count() <= FEW_ROWS
    while True:
        moved = _held(front, few).join(useful, ["repo", "b"]).where(matches & ~F.arrays_overlap("path", more) & (depth <= context.max_call_depth))
        moved = moved.select("repo", "sink", F.col("a").alias("b"), F.concat(more, "path").alias("path"), stack.alias("stack"), depth.alias("depth"), "_start")
        step = keep(_shortest(moved) if context.shortest_only else moved, "front")
        total = step.agg(weight).first()[0]
        if total is None:
            break
        few = total <= FEW_BYTES
        hit = step.where("_start").select("repo", F.col("b").alias("source"), "sink", "path")
        found = hit if found is None else found.unionByName(hit)
        front = step.drop("_start")
    if found is None:
        return last.select("repo", F.col("id").alias("source"), F.col("id").alias("sink"), F.array("id").alias("path")).where(F.lit(False))
    return found.distinct()


def _shortest(front: DataFrame) -> DataFrame:
    state = ["repo", "sink", "b", "stack", "depth", "_start"]
    return front.groupBy(*state).agg(F.min_by("path", F.struct(F.size("path"), F.col("path"))).alias("path")).select(*front.columns)


def reach_by_calls(program: Program, sources: DataFrame, sinks: DataFrame, semantics: DataFrame | None = None, context: EngineContext = EngineContext()) -> DataFrame:
    """(repo, source, sink, path) of a program's sources and sinks (repo, id)."""
    return paths(steps(program, semantics, context.max_arguments), sources, sinks, context)
