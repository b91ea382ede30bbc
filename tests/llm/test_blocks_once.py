"""What stars leave apart meets by blocks: all pairs of differing components, with what the members hold joined once."""

from tempora.llm import jaccard_join as J


def test_every_pair_of_components_meets_and_members_are_joined_once(spark):
    component = lambda k: 0 if k < 300 else 1 + k % 7
    members = spark.createDataFrame([(9, k, component(k)) for k in range(700)] + [(8, 1, 0), (8, 301, 1)], "center long, node long, component long")
    held = spark.createDataFrame([(k, bytes([k % 256])) for k in range(700)], "node long, held binary")
    rows = J._meet(J._cut(members), held)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of blocks with blocks, which are formed once
    met = {9: set(), 8: set()}
    for r in rows.collect():
        assert all(m.held == bytes([m.node % 256]) for m in r.u + r.v)
        met[r.center] |= {(x.node, y.node) for x in r.u for y in r.v}
    apart = lambda nodes: {(a, b) for a in nodes for b in nodes if component(a) < component(b)}
    both = {k: x | {(b, a) for a, b in x} for k, x in met.items()}
    assert apart(range(700)) <= both[9] and apart((1, 301)) <= both[8]
