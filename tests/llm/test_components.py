import numpy as np
import pytest

from tesserae.llm import common


def brute(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def graphs():
    rng = np.random.default_rng(7)
    order = rng.permutation(60)
    yield [(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)]  # a long chain in no order
    for n, m in [(50, 30), (80, 79), (20, 60)]:
        yield [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b]


@pytest.mark.parametrize("edges", list(graphs()))
def test_smallest_reachable(edges):
    nodes, least = common.smallest_reachable(*np.array(edges, np.int64).T)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == brute(edges)


def test_few_edges_take_one_task_and_many_go_by_rounds(spark, monkeypatch):
    tables = []
    write = common.written
    monkeypatch.setattr(common, "written", lambda df, label, *codec: tables.append(label) or write(df, label, *codec))
    edges = next(list(graphs()))
    df = spark.createDataFrame([*edges, (7, 7), edges[0][::-1]], "a long, b long")
    assert dict(map(tuple, common.components(df).collect())) == brute(edges)
    assert len(tables) == 2  # the edges and the result, without a table for each round
    tables.clear()
    many = common.components(df, held=len(edges) - 1)
    assert dict(map(tuple, many.collect())) == brute(edges) and len(tables) > 2
    nodes = spark.createDataFrame([(3,), (99,)], "node long")
    assert set(map(tuple, common.components(df, nodes).collect())) == {(3, 0), (99, 99)}
    assert common.components(df.limit(0)).count() == 0
