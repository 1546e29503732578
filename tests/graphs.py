"""Small graphs by rule, with known results."""

from arcweave.graph import Graph


def build(spark, n, edges, directed=False, weighted=False, ids=None):
    names = "src long, dst long" + ", weight long" * weighted
    vertices = spark.createDataFrame([(i,) for i in (range(n) if ids is None else ids)], "id long")
    return Graph(vertices, spark.createDataFrame(edges, names), directed, weighted)


def both(pairs):
    return [p for a, b, *w in pairs for p in ((a, b, *w), (b, a, *w))]


def chain(n, *weight):
    return both([(i, i + 1, *weight) for i in range(n - 1)])


def star(n, *weight):
    return both([(0, i, *weight) for i in range(1, n)])


def complete(n, *weight):
    return [(a, b, *weight) for a in range(n) for b in range(n) if a != b]


def grid(rows, columns, weigh=None):
    pairs = [(r * columns + c, r * columns + c + 1) for r in range(rows) for c in range(columns - 1)]
    pairs += [(r * columns + c, r * columns + c + columns) for r in range(rows - 1) for c in range(columns)]
    return both([(a, b, weigh(a, b)) for a, b in pairs] if weigh else pairs)


def wheel(n):
    rim = [(i, i % (n - 1) + 1) for i in range(1, n)]
    return both([(0, i) for i in range(1, n)] + rim)


def values(df, key="id"):
    """A two-column result as a dict."""
    other = next(c for c in df.columns if c != key)
    return {r[key]: r[other] for r in df.collect()}
