"""Components against a plain search, with stars and chains."""

import os
import random

from tidemark.llm import components as C
from tidemark.session import checkpoint_dir


def brute(edges):
    label = {x: x for e in edges if None not in e for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            if a is not None and b is not None:
                low = min(new[a], new[b])
                new[a] = new[b] = low
        if new == label:
            return {x: r for x, r in label.items() if any(x in e and e[0] != e[1] for e in edges)}
        label = new


def test_as_plain_search(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    edges += [(1_000, 1_001 + k) for k in range(400)] + [(3_000 - k, 2_000) for k in range(300)]  # stars either way
    edges += [(4_000 + k, 4_001 + k) for k in range(60)] + [(None, 5), (7, 7), edges[0], edges[0][::-1]]
    before = set(os.listdir(checkpoint_dir(spark)))
    got = C.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == brute(edges) and len(got) == len({r.node for r in got})
    # Of the rounds only the last one's files stay.
    assert len(set(os.listdir(checkpoint_dir(spark))) - before) == 1


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
