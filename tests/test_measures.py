"""fit computes the measures that its flags ask for."""

import math
import random

import pytest

from arbora.operators import evaluate, model, ranking
from arbora.plans.params import ForestParams


def test_fit_measures(spark):
    rng = random.Random(3)
    xs = [[float(rng.randrange(9)), float(rng.randrange(9))] for _ in range(60)]
    frame = spark.createDataFrame([(i, x, int(x[0] > 4), 1.0) for i, x in enumerate(xs)], "instance_id long, features array<double>, label int, weight double")
    fitted, bag = model.fit(frame, ForestParams(trees=3, max_depth=3, criterion="gini", out_of_bag=True, importances=True, interactions=True), ["x", "y"])
    votes = {}
    inside = {(r.tree, r.instance_id) for r in bag.collect()}
    for r in evaluate.tree_scores(frame, fitted.nodes, 2).collect():
        if (r.tree, r.instance_id) not in inside:
            s = votes.setdefault(r.instance_id, [0.0, 0.0])
            s[0] += r.probs[0]
            s[1] += r.probs[1]
    wrong = sum(int(votes.get(i, [0, 0])[1] > votes.get(i, [0, 0])[0]) != int(x[0] > 4) for i, x in enumerate(xs))
    assert fitted.measure("out_of_bag_error") == pytest.approx(wrong / 60)
    assert fitted.measure("importance:x") > fitted.measure("importance:y")
    assert not math.isnan(fitted.measure("interaction:x:y"))
    assert "not measured" not in fitted.describe()


def test_measures_in_one_pass(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(6)) for _ in range(3)], rng.randrange(2), float(rng.randrange(1, 4))) for i in range(50)]
    frame = spark.createDataFrame(rows, "instance_id long, features array<float>, label int, weight double")
    moved = {r.instance_id: list(r.moved) for r in ranking.scrambled_values(frame, 3, 5).collect()}
    for attr in range(3):
        assert {r.instance_id: r.features[attr] for r in ranking.scrambled(frame, attr, 5).collect()} == {i: m[attr] for i, m in moved.items()}
    # trees 0 .. 3; attribute 0 is known to all of them, 1 to none, 2 to two; rows with an id below 5 are in every bag
    scores = spark.createDataFrame([(t, i, [float((i + t) % 3), float((i * t) % 4)]) for t in range(4) for i in range(50)], "tree int, instance_id long, probs array<double>")
    inside = {(t, i) for t in range(4) for i in range(50) if i < 5 or (i + t) % 3 == 0}
    bag = spark.createDataFrame([(t, i, 1) for t, i in inside], "tree int, instance_id long, n_draws long")
    subset = spark.createDataFrame([(t, 0) for t in range(4)] + [(0, 2), (3, 2)], "tree int, attr int")
    knows = {t: {0} | ({2} if t in (0, 3) else set()) for t in range(4)}

    def error(trees):
        def vote(i):
            s = [sum(x) for x in zip(*[(float((i + t) % 3), float((i * t) % 4)) for t in trees if (t, i) not in inside])] or [0, 0]
            return int(s[1] > s[0])

        return sum(w for i, _, y, w in rows if vote(i) != y) / sum(r[3] for r in rows) if trees else None

    group = lambda **has: error([t for t in knows if all((int(a[1:]) in knows[t]) == h for a, h in has.items())])
    for limit in (500_000, 0):
        monkeypatch.setattr(evaluate, "BROADCAST_SIDES", limit)
        single = {r.attr: r.importance for r in evaluate.dropout_importance(frame, scores, bag, subset, 2, 3).collect()}
        assert single[0] is None and single[1] is None
        assert single[2] == pytest.approx(group(a2=False) - group(a2=True))
        pairs = {(r.attr_i, r.attr_j): r.interaction for r in evaluate.dropout_interaction(frame, scores, bag, subset, 2, 3).collect()}
        assert pairs == {(0, 1): None, (0, 2): None, (1, 2): None}
        both = subset.unionByName(spark.createDataFrame([(0, 1), (1, 1)], "tree int, attr int"))
        full = {0: {1, 2}, 1: {1}, 2: set(), 3: {2}}
        e = lambda i, j: error([t for t in full if ((1 in full[t]) == i) and ((2 in full[t]) == j)])
        got = {(r.attr_i, r.attr_j): r.interaction for r in evaluate.dropout_interaction(frame, scores, bag, both, 2, 3).collect()}
        assert got[1, 2] == pytest.approx((e(0, 0) - e(1, 1)) - (e(0, 0) - e(1, 0)) - (e(0, 0) - e(0, 1)))
