"""Small programs for tests: nodes by keyword, edges as triples, tags as triples."""

from sluice.operators import graph

NODE_COLUMNS = [x.strip().split(" ", 1)[0] for x in graph.NODE.split(", ")]
REPO = "r"


def node(id, label, name="", code=None, type="", full="", hints=(), inherits=(), arg=None, external=False, file="f", line=1, col=0, repo=REPO):
    return (repo, id, label, name, name if code is None else code, type, full, list(hints), list(inherits), arg, external, file, line, col)


def program(spark, nodes=(), edges=(), tags=()):
    """edges: (src, label, dst); tags: (node, name, value)."""
    return graph.Program(
        spark.createDataFrame(list(nodes), graph.NODE),
        spark.createDataFrame([(REPO, a, b, label) for a, label, b in edges], graph.EDGE),
        spark.createDataFrame([(REPO, i, n, v) for i, n, v in tags], graph.TAG),
    )


def properties(spark, *rows):
    """(id, file, name, value)"""
    return spark.createDataFrame([(REPO, i, f, n, v, 1) for i, f, n, v in rows], graph.PROPERTY)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
