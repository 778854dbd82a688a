import random

from tidemark.llm.graph import components


def test_chains_stars_and_cycles(spark):
    draw = random.Random(0)
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 7)]
    draw.shuffle(links)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups = {}
    for node, root in found.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list(range(201)), list(range(1000, 1100)), [2000, 2001, 2002]]


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
