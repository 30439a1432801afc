import numpy as np
import pytest

from dropletry.operators import communities

SCHEMA = "src long, dst long, w double"


def quality(edges, of):
    """Modularity from a full matrix."""
    nodes = sorted(of)
    a = np.zeros((len(nodes), len(nodes)))
    for s, d, w in edges:
        a[nodes.index(s), nodes.index(d)] += w
        a[nodes.index(d), nodes.index(s)] += w
    k, m2 = a.sum(axis=1), a.sum()
    same = np.array([[of[x] == of[y] for y in nodes] for x in nodes])
    return ((a - np.outer(k, k) / m2) * same).sum() / m2


def one_by_one(edges):
    """Nodes move one after another until none gains, level by level."""
    names = sorted({x for s, d, _ in edges for x in (s, d)})
    a = np.zeros((len(names), len(names)))
    for s, d, w in edges:
        a[names.index(s), names.index(d)] += w
        a[names.index(d), names.index(s)] += w
    of = np.arange(len(names))
    while True:
        k, m2, own = a.sum(axis=1), a.sum(), np.arange(len(a))
        moved = True
        while moved:
            moved = False
            for i in range(len(a)):
                rest = np.array([a[i][(own == c) & (np.arange(len(a)) != i)].sum() - k[i] * (k[own == c].sum() - (k[i] if own[i] == c else 0)) / m2 for c in range(len(a))])
                best = int(rest.argmax())
                if rest[best] > rest[own[i]] + 1e-12:
                    own[i], moved = best, True
        kept = np.unique(own)
        if len(kept) == len(a):
            return dict(zip(names, of.tolist()))
        own = np.searchsorted(kept, own)
        of = own[of]
        a = np.array([[a[np.ix_(own == x, own == y)].sum() for y in range(len(kept))] for x in range(len(kept))])


def planted(groups, size, inside, outside, seed):
    rng = np.random.default_rng(seed)
    n = groups * size
    return [(i, j, float(rng.integers(1, 4))) for i in range(n) for j in range(i) if rng.random() < (inside if i // size == j // size else outside)]


def test_modularity_never_falls_and_equals_a_sequential_run(spark):
    edges = planted(3, 7, 0.6, 0.06, 1) + [(50, k, 1.0) for k in range(51, 60)]
    found, told = communities.louvain(spark.createDataFrame(edges, SCHEMA), rounds=3)
    of = {r["node"]: r["community"] for r in found.collect()}
    assert len(of) == len({x for s, d, _ in edges for x in (s, d)})
    assert told == sorted(told) and told[-1] == pytest.approx(quality(edges, of))
    assert told[-1] >= 0.95 * quality(edges, one_by_one(edges))
    assert len({of[x] for x in range(50, 60)}) == 1


def test_edges_that_say_nothing(spark):
    rows = [(1, 2, 1.0), (2, 1, 2.0), (3, 3, 4.0), (None, 1, 1.0), (1, 4, None), (1, 5, 0.0), (6, 7, -1.0)]
    found, told = communities.louvain(spark.createDataFrame(rows, SCHEMA))
    of = {r["node"]: r["community"] for r in found.collect()}
    assert set(of) == {1, 2, 3} and of[1] == of[2] != of[3] and told == pytest.approx([quality([(1, 2, 3.0), (3, 3, 4.0)], of)])
    assert communities.louvain(spark.createDataFrame([], SCHEMA))[0].count() == 0
