"""Components of long and of tangled graphs in few rounds."""

import numpy as np

from cytoplan.operators import neighbors


def plain(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_few_rounds(spark):
    r = np.random.default_rng(2)
    path = r.permutation(400).tolist()
    pairs = [*zip(path[:-1], path[1:], strict=True), *(tuple(x) for x in r.integers(400, 1000, (280, 2)).tolist()), (1001, 1000)]
    got = neighbors.components(spark.range(1003), spark.createDataFrame(pairs, "a long, b long"), max_rounds=7)
    assert [x.component for x in got.orderBy("id").collect()] == plain(1003, pairs)
