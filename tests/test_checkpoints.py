from __future__ import annotations

import random

import pytest

from lodestone.operators import checkpoints as cp

KIND = "conv_id long, checkpoint_id string, parent_id string, id string, type string, content string"


def forest(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(6):
        for k in range(rng.randint(1, 40)):
            parent = None if k == 0 or rng.random() < 0.05 else f"n{rng.randint(max(0, k - 3), k - 1)}"
            rows.append((conv, f"n{k}", parent, f"m{conv}-{k}", rng.choice(["human", "ai"]), f"text {k}"))
    return rows


def path(rows, conv, node):
    by = {(c, n): (p, i) for c, n, p, i, *_ in rows}
    out = []
    while (conv, node) in by:
        out.append((node, by[conv, node][1]))
        node = by[conv, node][0]
    return out[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_states_follow_the_parents(spark, seed):
    rows = forest(seed)
    nodes = spark.createDataFrame(rows, KIND)
    leaves = cp.leaves(nodes)
    parents = {(c, p) for c, _, p, *_ in rows}
    want = {(c, n) for c, n, *_ in rows if (c, n) not in parents}
    assert {tuple(r) for r in leaves.collect()} == want
    got = sorted((r.conv_id, r.leaf, r.place, r.checkpoint_id, r.id) for r in cp.states(nodes, leaves).collect())
    assert got == sorted((c, leaf, k, n, i) for c, leaf in want for k, (n, i) in enumerate(path(rows, c, leaf)))
    by = {(c, n): p for c, n, p, *_ in rows}
    got = sorted((r.conv_id, r.asked, r.place, r.id) for r in cp.before(nodes, leaves).collect())
    assert got == sorted((c, n, k, i) for c, n in want if by[c, n] for k, (_, i) in enumerate(path(rows, c, by[c, n])))


def test_an_edit_adds_a_branch_and_leaves_the_others(spark):
    nodes = spark.createDataFrame([(1, "a", None, "m0", "human", "x"), (1, "b", "a", "m1", "ai", "y"), (1, "c", "b", "m2", "human", "z"), (1, "d", "c", "m3", "ai", "w")], KIND)
    edits = spark.createDataFrame([(1, "c", "c2", "m2e", "new"), (1, "nowhere", "q", "m9", "lost")], "conv_id long, asked string, checkpoint_id string, id string, content string")
    both = cp.edited(nodes, edits)
    assert {r.leaf: r.content for r in cp.states(both, cp.leaves(both)).where("type = 'human' AND place = 2").collect()} == {"d": "z", "c2": "new"}
    at = {r.checkpoint_id: (r.position, r.branches, r.previous, r.next) for r in cp.branches(both).collect()}
    assert at["c"] == (1, 2, None, "c2") and at["c2"] == (2, 2, "c", None) and at["a"] == (1, 1, None, None)


def test_missing_parents_repeats_circles_and_no_rows(spark):
    rows = [(1, "a", "gone", "m0", "human", "x"), (1, "b", "a", "m1", "ai", "y"), (1, "b", "a", "m1", "ai", "y")]
    nodes = spark.createDataFrame(rows, KIND)
    assert sorted((r.place, r.checkpoint_id) for r in cp.states(nodes, cp.leaves(nodes)).collect()) == [(0, "a"), (1, "b")]
    assert cp.states(nodes.limit(0), nodes.limit(0)).collect() == []
    circle = spark.createDataFrame([(1, "a", "b", "m", "ai", ""), (1, "b", "a", "m", "ai", "")], KIND)
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="own ancestor"):
        m.setattr(cp, "ROUNDS", 5)
        cp.states(circle, circle)


def test_rounds_are_logarithmic(spark):
    chain = spark.range(300).selectExpr("1L conv_id", "string(id) checkpoint_id", "CASE WHEN id > 0 THEN string(id - 1) END parent_id", "string(id) id", "'ai' type", "'' content")
    assert len(cp._ups(chain)) == 9
    assert cp.states(chain, spark.createDataFrame([(1, "299")], "conv_id long, checkpoint_id string")).count() == 300
