"""Connected components against a plain union-find."""

import random

import pytest

from callmeter.llm.components import components


def reached(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = sorted((top(u), top(v)))
            up[b] = a
    return {x: top(x) for x in up}


def chain(n):
    nodes = list(range(n))
    random.Random(3).shuffle(nodes)
    return list(zip(nodes, nodes[1:], strict=False))


SHAPES = {
    "none": [],
    "self": [(5, 5), (None, 3), (3, None)],
    "star": [(i, 40) for i in range(40)] + [(40, 3), (7, 7)],
    "chain": chain(120),
    "random": [(random.Random(i).randrange(150), random.Random(i + 999).randrange(150)) for i in range(110)],
    "repeated": [(2, 9), (9, 2), (2, 9), (-4, 9)],
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("per_task", [1 << 20, 30])
def test_components_match_union_find(spark, shape, per_task):
    links = SHAPES[shape]
    table = spark.createDataFrame(links, "u long, v long").repartition(4)
    found = components(table, links_per_task=per_task).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == reached(links)
