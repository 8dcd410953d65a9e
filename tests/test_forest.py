"""Induction, scoring and measures against a depth-first brute force, and invariants."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from arbora.functions import criteria
from arbora.operators import bagging, evaluate, features, model, ranking, splits
from arbora.operators.grow import grow
from arbora.plans import fixtures as fx
from arbora.plans.params import ForestParams, from_options, resolve, to_options

SCHEMA = "instance_id long, features array<float>, label int, weight double"


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def gini(c):
    s = sum(c)
    return s - sum(x * x for x in c) / s if s else 0.0


def brute_tree(rows, tree, k, seed, depth_limit, attrs, change, node=1, depth=0, out=None):
    """Depth-first induction as the semantics are written down: rows of (id, features, label, w)."""
    out = {} if out is None else out
    c = [sum(r[3] for r in rows if r[2] == y) for y in (0, 1)]
    leaf = (node, depth, -1, None, len(rows), tuple(x / len(rows) for x in c))
    if len(rows) < 2 or min(c) < 1e-5 or depth == depth_limit:
        out[node] = leaf
        return out
    order = sorted(attrs, key=lambda a: (hashed("attr", seed, tree, node, a), a))
    best, seen = None, 0
    for a in order:
        if seen >= k and best is not None:
            break
        seen += 1
        values = sorted(rows, key=lambda r: (r[1][a], r[0]))
        found = None
        left = [0.0, 0.0]
        for x, y in zip(values, values[1:]):
            left[x[2]] += x[3]
            if y[1][a] > x[1][a] and (not change or x[2] != y[2]):
                score = gini(left) + gini([c[0] - left[0], c[1] - left[1]])
                if found is None or score < found[0]:
                    found = (score, (x[1][a] + y[1][a]) / 2)
        if found and gini(c) - found[0] > 0.01 and (best is None or gini(c) - found[0] > best[0]):
            best = (gini(c) - found[0], a, found[1])
    if best is None:
        out[node] = leaf
        return out
    _, a, split = best
    out[node] = (node, depth, a, split, len(rows), None)
    for side, part in ((0, [r for r in rows if r[1][a] < split]), (1, [r for r in rows if r[1][a] >= split])):
        brute_tree(part, tree, k, seed, depth_limit, attrs, change, 2 * node + side, depth + 1, out)
    return out


@pytest.fixture(scope="module")
def tied(spark):
    rng = random.Random(11)
    rows = [(i, [float(rng.randrange(6)), float(rng.randrange(3)), float(rng.randrange(40)), 1.0], rng.randrange(2), float(rng.randrange(1, 4))) for i in range(160)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("change", "ranged"), [(True, False), (False, True)])
def test_levels_equal_depth_first(spark, tied, change, ranged):
    rows, frame = tied
    params = ForestParams(trees=2, features=2, seed=5, max_depth=3, criterion="gini", class_change=change)
    r = resolve(params, 5)
    r = type(r)(params, 2, 2, 4)
    bag = bagging.bootstrap(spark, len(rows), 2, 5).persist()
    drawn = {(x.tree, x.instance_id): x.n_draws for x in bag.collect()}
    assert sum(drawn.values()) == 2 * len(rows)
    for (t, i), n in drawn.items():
        assert n == sum(hashed("bag", 5, t, d) % len(rows) == i for d in range(len(rows)))
    nodes = grow(frame, bag, r, 2, 4, ranged=ranged)
    got = {(x.tree, x.node): (x.node, x.depth, x.attr, x.split, x.n_rows, tuple(x.probs) if x.probs else None) for x in nodes.collect()}
    for t in (0, 1):
        want = brute_tree([(i, f, y, w * drawn[t, i]) for i, f, y, w in rows if (t, i) in drawn], t, 2, 5, 3, range(4), change)
        assert {n: v for (tree, n), v in got.items() if tree == t} == want


def test_leaves_partition_the_bag_and_row_order_is_irrelevant(spark, tied):
    rows, frame = tied
    params = ForestParams(trees=3, seed=3, max_depth=2, criterion="entropy", features=2)
    a, bag = model.fit(frame, params)
    b, _ = model.fit(frame.orderBy(F.desc("instance_id")), params)
    flat = lambda m: sorted(tuple(r) for r in m.nodes.select("tree", "node", "attr", "split", "n_rows").collect())
    assert flat(a) == flat(b)
    leaves = a.nodes.filter("attr < 0").groupBy("tree").agg(F.sum("n_rows").alias("n"))
    assert {r.tree: r.n for r in leaves.collect()} == {r.tree: r.n_distinct for r in bagging.bag_summary(bag).collect()}
    sizes = {r.tree: r for r in model.tree_sizes(a.nodes).collect()}
    assert all(r.n_nodes == 2 * r.n_splits + 1 == r.n_leaves + r.n_splits and r.max_depth <= 2 for r in sizes.values())


def test_micro_fixtures(spark):
    pure = spark.createDataFrame([(i, [float(i)], 0, 1.0) for i in range(4)], SCHEMA)
    fitted, _ = model.fit(pure, ForestParams(trees=2, max_depth=3, criterion="gini"))
    assert fitted.nodes.count() == 2 and model.flat_metadata(fitted.nodes).first().max_depth == 1
    constant = spark.createDataFrame([(i, [1.0, 2.0], i % 2, 1.0) for i in range(6)], SCHEMA)
    assert model.fit(constant, ForestParams(trees=1, max_depth=3))[0].nodes.filter("attr >= 0").count() == 0
    none = spark.createDataFrame([(i, [], int(i > 3), 1.0) for i in range(6)], SCHEMA)
    fallback, _ = model.fit(none)
    assert fallback.classify(none).select("prediction").distinct().collect()[0][0] == 0
    for bad in ([float("nan")], [None]):
        with pytest.raises(ValueError, match="missing"):
            model.fit(spark.createDataFrame([(0, bad, 0, 1.0), (1, [1.0], 1, 1.0)], SCHEMA))
    with pytest.raises(ValueError, match="two classes"):
        model.fit(spark.createDataFrame([(i, [float(i)], i, 1.0) for i in range(3)], SCHEMA), ForestParams(criterion="gini"))
    with pytest.raises(TypeError):
        features.instances(spark.createDataFrame([("a", 1)], "x string, y int"))


def test_never_out_of_bag_votes_class_0(spark):
    frame = spark.createDataFrame([(i, [float(i)], 1, 1.0) for i in range(4)], SCHEMA)
    bag = spark.createDataFrame([(t, i, 1) for t in range(3) for i in range(4) if i == 0 or i != t], "tree int, instance_id long, n_draws long")
    scores = spark.createDataFrame([(t, i, [0.0, 1.0]) for t in range(3) for i in range(4)], "tree int, instance_id long, probs array<double>")
    votes = {r.instance_id: r.vote for r in evaluate.oob_votes(frame, scores, bag, 2).collect()}
    assert votes == {0: 1, 1: 1, 2: 1, 3: 0} or votes[3] == 0
    assert evaluate.oob_error(frame, scores, bag, 2).first().error == sum(v == 0 for v in votes.values()) / 4


def test_packed_scoring_equals_joins_and_nan_goes_right(spark, monkeypatch):
    frame = spark.createDataFrame([(0, [2e5, 3.0, 20.0, 1.0]), (1, [1e5, 9.0, 3.0, 5.0]), (2, [float("nan"), None, 1.0, 1.0])], "instance_id long, v array<double>")
    nodes = fx.fixed_nodes(spark)
    rows = lambda: sorted((r.instance_id, r.tree, tuple(r.probs)) for r in evaluate.tree_scores(frame, nodes, 2, "v").collect())
    packed = rows()
    for limit in (0, 1, 3, 4):  # joins only; single leaves packed, others joined; chunks
        monkeypatch.setattr(model, "PACKED_NODES", limit)
        assert rows() == packed
    plan = model.tree_votes(frame, nodes, "v", 2, limit=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MonotonicallyIncreasing" not in plan and "monotonically" not in plan  # no joins of rows
    assert (2, 0, (2.0, 0.5)) in packed


def test_nodes_deeper_than_a_heap_can_number(spark, tied, monkeypatch):
    _, frame = tied
    params = ForestParams(trees=2, max_depth=5, criterion="gini", features=2, ranged=False)
    usual, _ = model.fit(frame, params)
    monkeypatch.setattr("arbora.operators.grow.HEAP_DEPTH", 1)
    deep, _ = model.fit(frame, params)
    assert deep.nodes.filter(f"depth = 2 and node < {1 << 62}").count() == 0
    ids = deep.nodes.select("tree", "node").collect()
    assert len(set(ids)) == len(ids)
    linked = deep.nodes.filter("attr >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    assert sorted(map(tuple, linked.collect())) == sorted((r.tree, r.node) for r in deep.nodes.filter("depth > 0").collect())
    # the first levels do not depend on the numbers below them
    flat = lambda m: sorted(tuple(r) for r in m.nodes.filter("depth <= 1").select("tree", "node", "attr", "split", "n_rows").collect())
    assert flat(usual) == flat(deep)
    monkeypatch.setattr(model, "PACKED_NODES", 0)
    joined = sorted((r.instance_id, r.prediction) for r in deep.classify(frame).collect())
    monkeypatch.setattr(model, "PACKED_NODES", 1000)
    assert sorted((r.instance_id, r.prediction) for r in deep.classify(frame).collect()) == joined


def test_save_load_and_describe(spark, tied, tmp_path):
    _, frame = tied
    fitted, _ = model.fit(frame, ForestParams(trees=2, max_depth=2, criterion="gini"), ["a", "b", "c", "d"])
    fitted.measures["out_of_bag_error"] = 0.25
    fitted.save(f"file://{tmp_path}/m")
    again = model.ForestModel.load(spark, f"file://{tmp_path}/m")
    score = lambda m: sorted((r.instance_id, tuple(r.distribution)) for r in m.distribution(frame).collect())
    assert score(again) == score(fitted) and again.params == fitted.params
    assert "25.0000 %" in again.describe() and math.isnan(again.measure("other"))


def test_params():
    assert resolve(ForestParams(), 9).features == 4
    assert resolve(ForestParams(features=50), 9).features == 8
    r = resolve(ForestParams(criterion="gini"), 5)
    assert (r.tree_features, r.features) == (4, 3)
    wide = resolve(ForestParams(criterion="gini", dropout_importances=True), 500)
    assert wide.trees == 100 and wide.tree_features == min(400, max(101, int(500**0.6) + 60))
    assert resolve(ForestParams(criterion="gini", dropout_interactions=True, trees=10), 2).tree_features == 1
    assert from_options([]).trees == 10
    for p in (ForestParams(), ForestParams(trees=7, features=3, seed=9, max_depth=4, bag_percent=55, criterion="gini", importances=True, tree_features=8, interactions=True, dropout_interactions=True), ForestParams(out_of_bag=True), ForestParams(class_change=False, ranged=False)):
        assert from_options(to_options(p)) == p
    with pytest.raises(ValueError):
        ForestParams(out_of_bag=True, bag_percent=50)
    with pytest.raises(ValueError):
        from_options(["-nope"])


def test_scalar_functions(spark):
    xs = [1e-7, 0.1, 0.5, 1.0, 1.5, 2.0, 3.0, 1023.0, 1024.0, 1e6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", criteria.fast_log2(F.col("x")).alias("l"), criteria.x_log_x(F.col("x")).alias("f")).collect()
    assert all(abs(r.l - math.log2(r.x)) < 0.01 for r in got)
    assert got[0].f == 0.0 and got[5].f == pytest.approx(2.0)


def test_ranks_and_sums_by_ranges(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3) if i % 9 else None, float(rng.randrange(50)), rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, x double, v long").repartition(5)
    got = {r.id: r["rank"] for r in ranking.rank_within(df, "k", ["x", "id"]).collect()}
    for key in (None, 0, 1, 2):
        order = sorted((x, i) for i, k, x, _ in rows if k == key)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))
    sums = df.groupBy("k", "x").agg(F.sum("v").alias("v"))
    for r in ranking.sums_before(sums, ["k"], "x", "v", "s").collect():
        assert r.s == sum(v for _, k, x, v in rows if k == r.k and x < r.x)
    for r in ranking.sums_before(df.groupBy("x").agg(F.sum("v").alias("v")), [], "x", "v", "s").collect():
        assert r.s == sum(v for _, _, x, v in rows if x < r.x)


def test_global_rank_and_permutation(spark):
    df = spark.range(1000).withColumn("x", (F.col("id") * 37) % 101)
    got = ranking.global_rank(df, ["x", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)
    p = ranking.permutation(50, 1, spark).collect()
    assert sorted(r.position for r in p) == list(range(50)) and [r.position for r in sorted(p)] != list(range(50))


def test_interaction_and_paired_test(spark):
    pairs = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (3.0, 2.0)], "a double, b double")
    r = evaluate.paired_t(pairs, 10).first()
    variance = 1 / 12
    assert r.mean_diff == pytest.approx(5 / 6) and r.var_diff == pytest.approx(variance)
    assert r.t == pytest.approx(5 / 6 / math.sqrt((1 / 3 + 1 / 9) * variance))
    assert evaluate.t_p_value(2.262157, 9) == pytest.approx(0.05, abs=1e-5)


def test_auc(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8) / 8, rng.randrange(2)) for _ in range(200)]
    want = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z) / (sum(y for _, y in rows) * sum(1 - y for _, y in rows))
    df = spark.createDataFrame(rows, "s double, y int")
    assert evaluate.auc(df, "s", F.col("y") == 1).first().auc == pytest.approx(want)
    assert evaluate.auc(df.filter("y = 1"), "s", F.col("y") == 1).first().auc is None


def test_split_scans_agree(spark, tied):
    _, frame = tied
    rows = features.long_form(frame).select(F.lit(0).alias("tree"), (F.col("instance_id") % 3).alias("node"), "instance_id", "attr", "value", "label", F.col("weight").alias("w"))
    histogram = splits.value_histogram(rows, 2)
    for criterion in ("gini", "entropy"):
        one, two = (sorted(tuple(r) for r in scan(histogram, 2, criterion, True).collect()) for scan in (splits.split_scan, splits.split_scan_ranged))
        assert one and [x[:4] for x in one] == [x[:4] for x in two]
        assert [x[4] for x in one] == pytest.approx([x[4] for x in two])
