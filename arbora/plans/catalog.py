"""The engine's queries and, for each that SQL can express, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import criteria, vectors
from arbora.operators import bagging, evaluate, features, model, ranking, splits
from arbora.operators.grow import grow
from arbora.plans import fixtures as fx
from arbora.plans import oracles as sql
from arbora.plans.lineage import cut
from arbora.plans.params import ForestParams, resolve

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TREES, SEED, A = 3, 7, fx.ATTRIBUTES
ORDERS = f"base AS MATERIALIZED ({fx.ORDERS_SQL})"
ORDERS3 = f"base AS MATERIALIZED ({fx.ORDERS3_SQL})"
EVENTS = f"base AS MATERIALIZED ({fx.EVENTS_SQL})"


def query(text: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if text is not None:
            _SQL[f.__name__] = text
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- instances ----------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT instance_id, unnest(range(4))::INT AS attr, unnest(features) AS value, label, weight FROM base")
def feature_long(spark, sf_dir):
    return features.long_form(fx.orders_frame(spark, sf_dir))


@query(f"WITH {ORDERS3} SELECT label, count(*) AS n_rows, sum(weight) AS weight FROM base GROUP BY label")
def class_histogram(spark, sf_dir):
    return features.class_histogram(fx.orders_frame(spark, sf_dir, 3))


@query(f"WITH {ORDERS3} SELECT label, sum(weight) / (SELECT sum(weight) FROM base) AS prior FROM base GROUP BY label")
def class_priors(spark, sf_dir):
    return features.class_priors(fx.orders_frame(spark, sf_dir, 3))


@query(f"WITH {ORDERS3} SELECT label, sum(weight) / (SELECT sum(weight) FROM base) AS prior FROM base GROUP BY label ORDER BY prior DESC, label LIMIT 1")
def majority_fallback(spark, sf_dir):
    return features.majority_fallback(fx.orders_frame(spark, sf_dir, 3))


@query(f"WITH {ORDERS3} SELECT count(*) AS n_rows, count(*) FILTER (label IS NULL) AS n_null_label, count(*) FILTER (len(list_filter(features, lambda v: v IS NULL OR isnan(v))) > 0) AS n_missing, count(DISTINCT label) AS n_classes, min(label) AS min_label, max(label) AS max_label FROM base")
def input_validation(spark, sf_dir):
    return features.validation(fx.orders_frame(spark, sf_dir, 3))


_LONG = "long AS (SELECT instance_id, unnest(range(4))::INT AS attr, unnest(features) AS value, label, weight FROM base)"
_ARGSORT = "SELECT instance_id, attr, value, row_number() OVER (PARTITION BY attr ORDER BY value, instance_id) AS rank FROM long"


@query(f"WITH {EVENTS}, {_LONG} {_ARGSORT}")
def attr_argsort(spark, sf_dir):
    return ranking.argsort(features.long_form(fx.events_frame(spark, sf_dir)))


@query(f"WITH {EVENTS}, {_LONG} SELECT * FROM ({_ARGSORT}) WHERE rank <= 10")
def attr_rank_topk(spark, sf_dir):
    return ranking.argsort(features.long_form(fx.events_frame(spark, sf_dir))).filter("rank <= 10")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def global_rank(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.global_rank(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


# --- scalar functions and criteria -------------------------------------------


@query(f"SELECT o_orderkey, {sql.fast_log2('o_totalprice')} AS log2, {sql.x_log_x('o_totalprice')} AS xlogx FROM orders")
def fast_log2(spark, sf_dir):
    price = F.col("o_totalprice")
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", criteria.fast_log2(price).alias("log2"), criteria.x_log_x(price).alias("xlogx"))


_BRANCH_COLS = [f"{s}{k}" for s in "lr" for k in range(3)]
_BRANCHES = ", ".join(f"sum(CASE WHEN label = {k} AND features[2] {op} m THEN weight ELSE 0 END)::DOUBLE AS {s}{k}" for s, op in (("l", "<"), ("r", ">=")) for k in range(3))
_BY_MONTH = f"WITH {ORDERS3}, b AS (SELECT m, {_BRANCHES} FROM base, (SELECT unnest(range(1, 14)) AS m) GROUP BY m)"


def _branches(spark, sf_dir) -> tuple[DataFrame, list, list]:
    """Class weights left and right of each month."""
    frame = fx.orders_frame(spark, sf_dir, 3)
    month = F.element_at("features", 2)
    counts = frame.groupBy(month.alias("v"), "label").agg(F.sum("weight").alias("w"))
    months = counts.select("v", "label", "w", F.explode(F.sequence(F.lit(1), F.lit(13))).alias("m"))
    sums = [F.sum(F.when((F.col("label") == k) & (F.col("v") < F.col("m") if s == "l" else F.col("v") >= F.col("m")), F.col("w")).otherwise(0.0)).alias(f"{s}{k}") for s in "lr" for k in range(3)]
    left, right = [[F.col(f"{s}{k}") for k in range(3)] for s in "lr"]
    return months.groupBy("m").agg(*sums), left, right


_L, _R = [[f"{s}{k}" for k in range(3)] for s in "lr"]


@query(f"{_BY_MONTH} SELECT m, round({sql.entropy(_L)}, 4) AS entropy FROM b")
def entropy_prior(spark, sf_dir):
    b, left, _ = _branches(spark, sf_dir)
    return b.select("m", F.round(criteria.entropy_prior(left), 4).alias("entropy"))


@query(f"{_BY_MONTH} SELECT m, round({sql.entropy(_L)} + {sql.entropy(_R)}, 4) AS entropy FROM b")
def entropy_conditional(spark, sf_dir):
    b, left, right = _branches(spark, sf_dir)
    return b.select("m", F.round(criteria.entropy_conditional([left, right]), 4).alias("entropy"))


@query(f"{_BY_MONTH} SELECT m, {sql.gini(_L)} AS gini FROM b")
def gini_prior(spark, sf_dir):
    b, left, _ = _branches(spark, sf_dir)
    return b.select("m", criteria.gini_prior(left).alias("gini"))


@query(f"{_BY_MONTH} SELECT m, {sql.gini(_L)} + {sql.gini(_R)} AS gini FROM b")
def gini_conditional(spark, sf_dir):
    b, left, right = _branches(spark, sf_dir)
    return b.select("m", criteria.gini_conditional([left, right]).alias("gini"))


@query(f"{_BY_MONTH} SELECT m, (l0 + l1 + l2) / (l0 + l1 + l2 + r0 + r1 + r2) AS left_share, (r0 + r1 + r2) / (l0 + l1 + l2 + r0 + r1 + r2) AS right_share FROM b")
def branch_proportions(spark, sf_dir):
    b, left, right = _branches(spark, sf_dir)
    x, y = criteria.proportions([criteria.total(left), criteria.total(right)])
    return b.select("m", x.alias("left_share"), y.alias("right_share"))


_VECTOR = "[l0, l1, l2]"


@query(f"""{_BY_MONTH} SELECT m, CASE WHEN l0 + l1 + l2 = 0 THEN l1 ELSE l1 / (l0 + l1 + l2) END AS share1, CASE WHEN greatest(l0, l1, l2) > 0 THEN list_position({_VECTOR}, greatest(l0, l1, l2)) - 1 END AS top, (l0 >= 1e-5)::INT + (l1 >= 1e-5)::INT + (l2 >= 1e-5)::INT <= 1 AS pure FROM b""")
def vector_functions(spark, sf_dir):
    """Normalise by sum, argmax and purity of class vectors."""
    b, left, _ = _branches(spark, sf_dir)
    v = F.array(*left)
    return b.select("m", F.get(vectors.normalised(v), F.lit(1)).alias("share1"), vectors.classified(v).alias("top"), vectors.is_pure(left).alias("pure"))


# --- sampling -----------------------------------------------------------------


def _bag(spark, sf_dir, trees=TREES, percent=100, table="orders"):
    n = fx.read(spark, sf_dir, table).count()
    return bagging.bootstrap(spark, n, trees, SEED, percent)


@query(f"WITH {ORDERS}, {sql.bag('base', TREES, SEED)} SELECT tree, instance_id, n_draws FROM bag")
def bootstrap_bag(spark, sf_dir):
    return _bag(spark, sf_dir)


@query(f"WITH {ORDERS}, {sql.bag('base', TREES, SEED, 55)} SELECT tree, sum(n_draws)::BIGINT AS n_draws, count(*) AS n_distinct FROM bag GROUP BY tree")
def bag_summary(spark, sf_dir):
    return bagging.bag_summary(_bag(spark, sf_dir, percent=55))


@query(f"WITH {ORDERS}, {sql.bag('base', TREES, SEED)} SELECT t.tree, b.instance_id FROM base b, (SELECT unnest(range({TREES})) AS tree) t WHERE NOT EXISTS (SELECT 1 FROM bag g WHERE g.tree = t.tree AND g.instance_id = b.instance_id)")
def oob_rows(spark, sf_dir):
    return bagging.out_of_bag(fx.orders_frame(spark, sf_dir), _bag(spark, sf_dir), TREES)


@query(sql.subset(40, 64, 12, SEED))
def tree_attr_subset(spark, sf_dir):
    return bagging.tree_attributes(spark, 40, 64, 12, SEED)


@query(f"SELECT tree, node, attr, row_number() OVER (PARTITION BY tree, node ORDER BY {sql.hashed(repr('attr'), str(SEED), 'tree', 'node', 'attr')}, attr) AS rank FROM (SELECT unnest(range(10)) AS tree), (SELECT unnest(range(1, 16)) AS node), (SELECT unnest(range(8)) AS attr)")
def node_attr_order(spark, sf_dir):
    nodes = spark.range(150).select(F.floor(F.col("id") / 15).cast("int").alias("tree"), (F.col("id") % 15 + 1).alias("node"))
    return ranking.node_attr_order(nodes, 8, SEED)


@query(f"SELECT i, row_number() OVER (ORDER BY {sql.hashed(repr('perm'), str(SEED), 'i')}, i) - 1 AS position FROM (SELECT unnest(range(5000)) AS i)")
def random_permutation(spark, sf_dir):
    return ranking.permutation(5000, SEED, spark)


_SCRAMBLED = """{out} AS MATERIALIZED (
  SELECT x.instance_id, x.label, x.weight, list_transform(x.features, lambda v, i: CASE WHEN i = {at} THEN s.v ELSE v END) AS features
  FROM {src} x
  JOIN (SELECT instance_id, row_number() OVER (ORDER BY instance_id) AS slot FROM {src}) p ON p.instance_id = x.instance_id
  JOIN (SELECT features[{at}] AS v, row_number() OVER (ORDER BY {hash}, instance_id) AS slot FROM {src}) s ON s.slot = p.slot)"""


def _scrambled_sql(src: str, out: str, attr: int) -> str:
    return _SCRAMBLED.format(src=src, out=out, at=attr + 1, hash=sql.hashed(repr("scramble"), str(SEED), str(attr), "instance_id"))


@query(f"WITH {ORDERS}, {_scrambled_sql('base', 'moved', 0)} SELECT instance_id, features[1] AS value, features[2] AS other FROM moved")
def permuted_column(spark, sf_dir):
    moved = ranking.scrambled(fx.orders_frame(spark, sf_dir), 0, SEED)
    return moved.select("instance_id", F.element_at("features", 1).alias("value"), F.element_at("features", 2).alias("other"))


_FOLDS = f"SELECT instance_id, label, ((row_number() OVER (PARTITION BY label ORDER BY {sql.hashed(repr('fold'), str(SEED), 'instance_id')}, instance_id) - 1) % 10)::INT AS fold FROM base"


@query(f"WITH {ORDERS3} {_FOLDS}")
def cv_folds(spark, sf_dir):
    return ranking.stratified_folds(fx.orders_frame(spark, sf_dir, 3), 10, SEED)


# --- split search ---------------------------------------------------------------


def _root_histogram(frame, classes):
    rows = features.long_form(frame).select(F.lit(0).alias("tree"), F.lit(1).alias("node"), "instance_id", "attr", "value", "label", F.col("weight").alias("w"))
    return splits.value_histogram(rows, classes)


def _scan_sql(criterion, change, classes=2, base=EVENTS):
    rounded = "round(score, 3) AS score, round(prior, 3) AS prior" if criterion == "entropy" else "score, prior"
    return f"WITH {base}, hist AS MATERIALIZED ({sql.root_histogram(classes)}), cand AS ({sql.scan('hist', classes, criterion, change)}) SELECT attr, split, {rounded} FROM cand"


@query(f"WITH {EVENTS}, hist AS MATERIALIZED ({sql.root_histogram(2)}) SELECT attr, value, c0, c1, first_label, last_label FROM hist")
def value_histogram(spark, sf_dir):
    return _root_histogram(fx.events_frame(spark, sf_dir), 2).select("attr", "value", "c0", "c1", "first_label", "last_label")


@query(_scan_sql("gini", False))
def split_scan_gini(spark, sf_dir):
    return splits.split_scan(_root_histogram(fx.events_frame(spark, sf_dir), 2), 2).select("attr", "split", "score", "prior")


@query(_scan_sql("gini", True))
def split_scan_gini_classchange(spark, sf_dir):
    return splits.split_scan(_root_histogram(fx.events_frame(spark, sf_dir), 2), 2, class_change=True).select("attr", "split", "score", "prior")


@query(_scan_sql("gini", True))
def split_scan_ranged(spark, sf_dir):
    """The scan whose columns are dealt over several tasks."""
    return splits.split_scan_ranged(_root_histogram(fx.events_frame(spark, sf_dir), 2), 2, class_change=True).select("attr", "split", "score", "prior")


@query(_scan_sql("entropy", False, 3, ORDERS3))
def split_scan_entropy(spark, sf_dir):
    found = splits.split_scan(_root_histogram(fx.orders_frame(spark, sf_dir, 3), 3), 3, "entropy")
    return found.select("attr", "split", F.round("score", 3).alias("score"), F.round("prior", 3).alias("prior"))


_BEST = f"WITH {EVENTS}, hist AS MATERIALIZED ({sql.root_histogram(2)}), cand AS ({sql.scan('hist', 2, 'gini', False)}), best AS (SELECT *, prior - score AS gain FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY score, split) AS r FROM cand) WHERE r = 1)"


@query(f"{_BEST} SELECT attr, split, score, gain FROM best")
def best_split_per_attr(spark, sf_dir):
    found = splits.best_per_attribute(splits.split_scan(_root_histogram(fx.events_frame(spark, sf_dir), 2), 2))
    return found.select("attr", "split", "score", "gain")


@query(
    f"{_BEST}, o AS (SELECT attr, row_number() OVER (ORDER BY {sql.hashed(repr('attr'), str(SEED), '0', '1', 'attr')}, attr) AS rnk FROM (SELECT unnest(range({A})) AS attr)) "
    "SELECT b.attr, b.split, b.gain FROM best b JOIN o ON o.attr = b.attr WHERE b.gain > 0.01 ORDER BY CASE WHEN rnk <= 2 THEN 0 ELSE 1 END, CASE WHEN rnk <= 2 THEN -b.gain ELSE 0 END, rnk LIMIT 1"
)
def best_split_k_of_a(spark, sf_dir):
    best = splits.best_per_attribute(splits.split_scan(_root_histogram(fx.events_frame(spark, sf_dir), 2), 2))
    order = ranking.node_attr_order(best.select("tree", "node").distinct(), A, SEED)
    return splits.best_at_node(best, order, 2).select("attr", "split", "gain")


# --- induction --------------------------------------------------------------------


def _grown(spark, sf_dir, depth, trees=TREES, k=2, criterion="gini", classes=2, subset=0, whole=False, percent=100):
    frame = fx.orders_frame(spark, sf_dir, classes)
    params = ForestParams(trees=trees, features=k, seed=SEED, max_depth=depth, criterion=criterion, bag_percent=percent)
    r = resolve(params, A + 1)
    r = type(r)(params, trees, k, subset or A)
    bag = frame.select(F.lit(0).alias("tree"), "instance_id", F.lit(1).alias("n_draws")) if whole else cut(_bag(spark, sf_dir, trees, percent))
    attrs = bagging.tree_attributes(spark, trees, A, subset, SEED) if subset else None
    return grow(frame, bag, r, classes, A, attrs, ranged=False)


def _node_rows(nodes, classes=2, digits=None):
    p = [F.get("probs", F.lit(k)) for k in range(classes)]
    return nodes.select("tree", "node", "depth", "attr", "split", "n_rows", *[(F.round(x, digits) if digits else x).alias(f"p{k}") for k, x in enumerate(p)])


_NODE_COLS = "SELECT tree, node, depth, attr, split, n_rows, p0, p1 FROM nodes"


@query(f"{sql.forest(fx.ORDERS_SQL, 1, A, 1, SEED, whole_table=True)} {_NODE_COLS}")
def stump(spark, sf_dir):
    """A depth-1 tree over the whole table."""
    return _node_rows(_grown(spark, sf_dir, 1, 1, A, whole=True))


@query(f"{sql.forest(fx.ORDERS_SQL, 1, 2, 2, SEED)} {_NODE_COLS}")
def tree_depth2(spark, sf_dir):
    return _node_rows(_grown(spark, sf_dir, 2, 1))


@query(f"{sql.forest(fx.ORDERS_SQL, 2, 2, 3, SEED)} {_NODE_COLS}")
def tree_depth3_nodes(spark, sf_dir):
    return _node_rows(_grown(spark, sf_dir, 3, 2))


@query(f"{sql.forest(fx.ORDERS_SQL, TREES, 2, 2, SEED, subset_size=3, percent=55)} {_NODE_COLS}")
def forest_depth2_nodes(spark, sf_dir):
    """Bags of 55 %, three of four attributes for each tree."""
    return _node_rows(_grown(spark, sf_dir, 2, subset=3, percent=55))


@query(f"{sql.forest(fx.ORDERS3_SQL, 2, A, 2, SEED, classes=3, criterion='entropy', class_change=False)} SELECT tree, node, depth, attr, n_rows FROM nodes")
def forest_entropy_nodes(spark, sf_dir):
    return _grown(spark, sf_dir, 2, 2, A, "entropy", 3).select("tree", "node", "depth", "attr", "n_rows")


@query(f"{sql.forest(fx.ORDERS_SQL, TREES, 2, 2, SEED)} SELECT tree, node, n_rows, p0, p1 FROM nodes WHERE attr < 0")
def leaf_distributions(spark, sf_dir):
    return _node_rows(_grown(spark, sf_dir, 2)).filter("attr < 0").select("tree", "node", "n_rows", "p0", "p1")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_depth2_nodes(spark, sf_dir)


# --- scoring, over a fixed forest -------------------------------------------------

_FIXED = f"fixed AS ({fx.FIXED_SQL})"
_SCORES = f"{ORDERS}, {_FIXED}, {sql.reached('base', 'fixed', 2, 'raw')}"


def _fixed_model(spark) -> model.ForestModel:
    return model.ForestModel(fx.fixed_nodes(spark), ForestParams(trees=TREES, criterion="gini"), 2, fx.NAMES)


@query(f"WITH {_FIXED} SELECT tree, count(*) AS n_nodes, count(*) FILTER (attr >= 0) AS n_splits, count(*) FILTER (attr < 0) AS n_leaves, max(depth) AS max_depth FROM fixed GROUP BY tree")
def tree_sizes(spark, sf_dir):
    return model.tree_sizes(fx.fixed_nodes(spark))


@query(f"WITH {_FIXED} SELECT count(DISTINCT tree) AS n_trees, greatest(max(depth), 1) AS max_depth, 2 AS n_classes FROM fixed")
def flat_metadata(spark, sf_dir):
    return model.flat_metadata(fx.fixed_nodes(spark))


@query(
    f"""WITH {_FIXED},
slots AS (SELECT tree, node, row_number() OVER (ORDER BY CASE WHEN node = 1 THEN 0 ELSE 1 END, tree, node) - 1 AS slot FROM fixed WHERE attr >= 0 OR node = 1),
tips AS (SELECT tree, node, row_number() OVER (ORDER BY tree, node) AS leaf, coalesce(p1 / nullif(p0 + p1, 0), 0.0) AS score FROM fixed WHERE attr < 0),
target AS (SELECT tree, node, slot AS t FROM slots WHERE node > 1 UNION ALL SELECT tree, node, -leaf FROM tips)
SELECT f.tree, s.slot, f.attr, f.split,
  CASE WHEN f.attr < 0 THEN -o.leaf ELSE l.t END AS lft, CASE WHEN f.attr < 0 THEN -o.leaf ELSE r.t END AS rgt, NULL::DOUBLE AS score
FROM fixed f JOIN slots s ON s.tree = f.tree AND s.node = f.node
LEFT JOIN target l ON l.tree = f.tree AND l.node = f.lft LEFT JOIN target r ON r.tree = f.tree AND r.node = f.rgt
LEFT JOIN tips o ON o.tree = f.tree AND o.node = f.node
UNION ALL SELECT tree, -leaf, -1, NULL, NULL, NULL, score FROM tips"""
)
def flat_forest(spark, sf_dir):
    return model.flat_form(fx.fixed_nodes(spark)).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query(f"WITH {_SCORES} SELECT instance_id, round(avg(coalesce(p1 / nullif(p0 + p1, 0), 0.0)), 9) AS score, round(avg(p1), 9) AS raw_score FROM leaf GROUP BY instance_id")
def flat_predict(spark, sf_dir):
    frame = fx.price_is_double(spark, sf_dir)
    votes = model.tree_votes(frame, fx.fixed_nodes(spark), "raw", 2)
    return votes.select("instance_id", F.round(model.flat_score(F.col("votes")), 9).alias("score"), F.round(model.flat_score(F.col("votes"), False), 9).alias("raw_score"))


@query(f"WITH {_SCORES} SELECT instance_id, round(sum(p0) / sum(p0 + p1), 9) AS p0, round(sum(p1) / sum(p0 + p1), 9) AS p1 FROM leaf GROUP BY instance_id")
def forest_predict(spark, sf_dir):
    found = _fixed_model(spark).distribution(fx.price_is_double(spark, sf_dir), "raw")
    return found.select("instance_id", *[F.round(F.get("distribution", F.lit(k)), 9).alias(f"p{k}") for k in (0, 1)])


@query(f"WITH {_SCORES} SELECT instance_id, tree, p0, p1 FROM leaf")
def tree_predict(spark, sf_dir):
    found = evaluate.tree_scores(fx.price_is_double(spark, sf_dir), fx.fixed_nodes(spark), 2, "raw")
    return found.select("instance_id", "tree", F.get("probs", F.lit(0)).alias("p0"), F.get("probs", F.lit(1)).alias("p1"))


@query(f"WITH {_SCORES} SELECT instance_id, CASE WHEN sum(p1) > sum(p0) THEN 1 WHEN sum(p0) > 0 THEN 0 END AS prediction FROM leaf GROUP BY instance_id")
def forest_classify(spark, sf_dir):
    return _fixed_model(spark).classify(fx.price_is_double(spark, sf_dir), "raw").select("instance_id", "prediction")


# --- evaluation -------------------------------------------------------------------

_OOB_BASE = f"{ORDERS}, {sql.bag('base', TREES, SEED)}, {_FIXED}"


def _oob_sql(source: str, name: str = "v") -> str:
    """CTE name (instance_id, label, weight, vote) over a table of leaves."""
    return f"{name} AS (SELECT b.instance_id, b.label, b.weight, CASE WHEN coalesce(sum(s.p1), 0) > coalesce(sum(s.p0), 0) THEN 1 ELSE 0 END AS vote FROM base b LEFT JOIN (SELECT l.* FROM {source} l WHERE NOT EXISTS (SELECT 1 FROM bag g WHERE g.tree = l.tree AND g.instance_id = l.instance_id)) s ON s.instance_id = b.instance_id GROUP BY b.instance_id, b.label, b.weight)"


_ERROR = "sum(CASE WHEN vote <> label THEN weight ELSE 0 END) / sum(weight)"


def _oob_parts(spark, sf_dir):
    frame = fx.orders_frame(spark, sf_dir)
    return frame, fx.fixed_nodes(spark), cut(_bag(spark, sf_dir))


@query(f"WITH {_OOB_BASE}, {sql.reached('base', 'fixed', 2, 'features')}, {_oob_sql('leaf')} SELECT instance_id, label, vote FROM v")
def oob_votes(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    return evaluate.oob_votes(frame, evaluate.tree_scores(frame, nodes, 2), bag, 2).select("instance_id", "label", "vote")


@query(f"WITH {_OOB_BASE}, {sql.reached('base', 'fixed', 2, 'features')}, {_oob_sql('leaf')} SELECT round({_ERROR}, 9) AS error FROM v")
def oob_error(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    return evaluate.oob_error(frame, evaluate.tree_scores(frame, nodes, 2), bag, 2).select(F.round("error", 9).alias("error"))


def _renamed(ctes: str, suffix: str) -> str:
    for name in ("at0", "at1", "at2", "leaf"):
        ctes = ctes.replace(name, f"{name}_{suffix}")
    return ctes


def _importance_ctes(pairs: bool = False, base: str = _OOB_BASE, nodes: str = "fixed") -> str:
    parts = [base, sql.reached("base", nodes, 2, "features"), _oob_sql("leaf"), f"e0 AS MATERIALIZED (SELECT {_ERROR} AS e FROM v)"]
    for a in range(A):
        parts += [_scrambled_sql("base", f"moved{a}", a), _renamed(sql.reached(f"moved{a}", nodes, 2, "features"), f"s{a}"), _oob_sql(f"leaf_s{a}", f"v{a}")]
    parts.append("imp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {a} AS attr, {_ERROR} - (SELECT e FROM e0) AS importance FROM v{a}" for a in range(A)) + ")")
    if pairs:
        each = []
        for i in range(A):
            for j in range(i + 1, A):
                parts += [_scrambled_sql(f"moved{i}", f"moved{i}{j}", j), _renamed(sql.reached(f"moved{i}{j}", nodes, 2, "features"), f"s{i}{j}"), _oob_sql(f"leaf_s{i}{j}", f"v{i}{j}")]
                each.append(f"SELECT {i} AS attr_i, {j} AS attr_j, {_ERROR} - (SELECT e FROM e0) - (SELECT importance FROM imp WHERE attr = {i}) - (SELECT importance FROM imp WHERE attr = {j}) AS interaction FROM v{i}{j}")
        parts.append("inter AS (" + " UNION ALL ".join(each) + ")")
    return "WITH " + ",\n".join(parts)


@query(f"{_importance_ctes()} SELECT attr, round(importance, 9) AS importance FROM imp")
def importance_permutation(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    return evaluate.permutation_importance(frame, nodes, bag, 2, A, SEED).select("attr", F.round("importance", 9).alias("importance"))


@query(f"{_importance_ctes()} SELECT row_number() OVER (ORDER BY round(importance, 9) DESC, attr) AS rank, attr, round(importance, 9) AS importance FROM imp")
def attribute_ranking(spark, sf_dir):
    return evaluate.attribute_ranking(importance_permutation(spark, sf_dir))


@query(f"{_importance_ctes(True)} SELECT attr_i, attr_j, round(interaction, 9) AS interaction FROM inter")
def interaction_permutation(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    return evaluate.permutation_interaction(frame, nodes, bag, 2, A, SEED).select("attr_i", "attr_j", F.round("interaction", 9).alias("interaction"))


_SIDED = "SELECT b.instance_id, b.label, b.weight, {keys}, CASE WHEN coalesce(sum(s.p1), 0) > coalesce(sum(s.p0), 0) THEN 1 ELSE 0 END AS vote FROM base b CROSS JOIN (SELECT DISTINCT {plain} FROM sides) k LEFT JOIN (SELECT l.*, {plain} FROM leaf l JOIN sides d ON d.tree = l.tree WHERE NOT EXISTS (SELECT 1 FROM bag g WHERE g.tree = l.tree AND g.instance_id = l.instance_id)) s ON s.instance_id = b.instance_id AND {same} GROUP BY ALL"


def _sided(keys: list[str]) -> str:
    return _SIDED.format(keys=", ".join(f"k.{x}" for x in keys), plain=", ".join(keys), same=" AND ".join(f"s.{x} = k.{x}" for x in keys))


_DROP_BASE = f"WITH {_OOB_BASE}, sub AS ({fx.FIXED_SUBSET_SQL}), {sql.reached('base', 'fixed', 2, 'features')}"


@query(
    f"""{_DROP_BASE},
sides AS (SELECT t.tree, a.attr, CASE WHEN s.tree IS NULL THEN 0 ELSE 1 END AS has FROM (SELECT unnest(range({TREES})) AS tree) t CROSS JOIN (SELECT unnest(range({A})) AS attr) a LEFT JOIN sub s ON s.tree = t.tree AND s.attr = a.attr),
v AS ({_sided(['attr', 'has'])}),
e AS (SELECT attr, has, {_ERROR} AS e FROM v GROUP BY attr, has)
SELECT attr, round(max(CASE WHEN has = 0 THEN e END) - max(CASE WHEN has = 1 THEN e END), 9) AS importance FROM e GROUP BY attr"""
)
def importance_dropout(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    found = evaluate.dropout_importance(frame, evaluate.tree_scores(frame, nodes, 2), bag, fx.fixed_subset(spark), 2, A)
    return found.select("attr", F.round("importance", 9).alias("importance"))


@query(
    f"""{_DROP_BASE},
has AS (SELECT t.tree, a.attr, CASE WHEN s.tree IS NULL THEN 0 ELSE 1 END AS has FROM (SELECT unnest(range({TREES})) AS tree) t CROSS JOIN (SELECT unnest(range({A})) AS attr) a LEFT JOIN sub s ON s.tree = t.tree AND s.attr = a.attr),
sides AS (SELECT x.tree, x.attr AS attr_i, y.attr AS attr_j, x.has AS has_i, y.has AS has_j FROM has x JOIN has y ON x.tree = y.tree AND x.attr < y.attr),
v AS ({_sided(['attr_i', 'attr_j', 'has_i', 'has_j'])}),
e AS (SELECT attr_i, attr_j, has_i, has_j, {_ERROR} AS e FROM v GROUP BY ALL),
p AS (SELECT attr_i, attr_j, max(CASE WHEN has_i = 0 AND has_j = 0 THEN e END) AS e00, max(CASE WHEN has_i = 1 AND has_j = 1 THEN e END) AS e11, max(CASE WHEN has_i = 1 AND has_j = 0 THEN e END) AS e10, max(CASE WHEN has_i = 0 AND has_j = 1 THEN e END) AS e01 FROM e GROUP BY attr_i, attr_j)
SELECT attr_i, attr_j, round((e00 - e11) - (e00 - e10) - (e00 - e01), 9) AS interaction FROM p"""
)
def interaction_dropout(spark, sf_dir):
    frame, nodes, bag = _oob_parts(spark, sf_dir)
    found = evaluate.dropout_interaction(frame, evaluate.tree_scores(frame, nodes, 2), bag, fx.fixed_subset(spark), 2, A)
    return found.select("attr_i", "attr_j", F.round("interaction", 9).alias("interaction"))


_AUC3 = f"""WITH {ORDERS3}, s AS (
  SELECT label, weight, [features[2] / 12, features[3] / 31, features[4] / 5]::DOUBLE[] AS d FROM base),
x AS (SELECT label, weight, unnest(range(3)) AS cls, unnest(d) AS score FROM s),
r AS (SELECT cls, label, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS rk FROM x),
a AS (SELECT cls, (sum(CASE WHEN label = cls THEN rk ELSE 0 END) - count(*) FILTER (label = cls) * (count(*) FILTER (label = cls) + 1) / 2.0) / nullif(count(*) FILTER (label = cls) * count(*) FILTER (label <> cls), 0) AS auc FROM r GROUP BY cls),
p AS (SELECT label AS cls, sum(weight) AS prior FROM s GROUP BY label)"""


@query(f"{_AUC3} SELECT round(sum(auc * prior) / sum(prior), 9) AS auc FROM a JOIN p USING (cls) WHERE auc IS NOT NULL")
def auc_ovr_weighted(spark, sf_dir):
    frame = fx.orders_frame(spark, sf_dir, 3)
    f = F.col("features")
    scored = frame.withColumn("distribution", F.array((f[1] / F.lit(12).cast("float")).cast("double"), (f[2] / F.lit(31).cast("float")).cast("double"), (f[3] / F.lit(5).cast("float")).cast("double")))
    return evaluate.weighted_auc(scored, 3).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {_SCORES}, c AS (SELECT instance_id, CASE WHEN sum(p1) > sum(p0) THEN 1 WHEN sum(p0) > 0 THEN 0 END AS prediction FROM leaf GROUP BY instance_id) SELECT round(100.0 * avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END), 9) AS pct_correct FROM c JOIN base USING (instance_id)")
def accuracy(spark, sf_dir):
    found = evaluate.accuracy(_fixed_model(spark).classify(fx.price_is_double(spark, sf_dir), "raw"))
    return found.select(F.round("pct_correct", 9).alias("pct_correct"))


@query(f"WITH {ORDERS3}, f AS ({_FOLDS}), c AS (SELECT k.fold, f.label, count(*) AS n FROM (SELECT unnest(range(10)) AS fold) k JOIN f ON f.fold <> k.fold GROUP BY k.fold, f.label), t AS (SELECT fold, label, n / sum(n) OVER (PARTITION BY fold) AS p FROM c), best AS (SELECT fold, arg_max(label, p) AS prediction FROM t GROUP BY fold) SELECT f.fold, count(*) AS n_rows, round(100.0 * avg(CASE WHEN f.label = best.prediction THEN 1.0 ELSE 0.0 END), 9) AS pct_correct FROM f JOIN best ON best.fold = f.fold GROUP BY f.fold")
def cv_scores(spark, sf_dir):
    """Ten-fold cross-validation of the model without attributes."""
    frame = fx.orders_frame(spark, sf_dir, 3)

    def train(rows: DataFrame) -> model.ForestModel:
        shares = {r.label: r.prior for r in features.class_priors(rows).collect()}  # one row a class
        return model.ForestModel(fx.fixed_nodes(rows.sparkSession), ForestParams(), 3, fallback=[float(shares.get(k) or 0.0) for k in range(3)])

    scored = evaluate.cross_validated(frame, train, 10, SEED).withColumn("hit", (vectors.argmax(F.col("distribution")) == F.col("label")).cast("double"))
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(100 * F.avg("hit"), 9).alias("pct_correct"))


_RUNS = "SELECT event_type AS dataset, day(ts) AS run, avg(value) AS a, avg(hour(ts) * 4.0) AS b FROM events GROUP BY event_type, day(ts)"


def _runs(spark, sf_dir):
    e = fx.read(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("dataset"), F.dayofmonth("ts").alias("run")).agg(F.avg("value").alias("a"), F.avg(F.hour("ts") * 4.0).alias("b"))


@query(f"WITH r AS ({_RUNS}) SELECT count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(coalesce(var_samp(a - b), 0), 6) AS var_diff, round(avg(a - b) / sqrt((1.0 / count(*) + 1.0 / 9) * var_samp(a - b)), 6) AS t FROM r")
def paired_t(spark, sf_dir):
    found = evaluate.paired_t(_runs(spark, sf_dir), 10)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean_diff", "var_diff", "t")])


@query(f"WITH r AS ({_RUNS}) SELECT dataset, round(avg(a), 6) AS a, round(avg(b), 6) AS b FROM r GROUP BY dataset")
def run_means(spark, sf_dir):
    found = evaluate.run_means(_runs(spark, sf_dir))
    return found.select("dataset", *[F.round(c, 6).alias(c) for c in ("a", "b")])


# --- fitted forests and their measures ---------------------------------------------

#: What ForestParams() resolve to for four attributes: three at a node.
_FITTED = sql.forest(fx.ORDERS_SQL, TREES, 3, 2, SEED).removeprefix("WITH ")


def _fitted(spark, sf_dir, **flags) -> tuple[model.ForestModel, DataFrame]:
    return model.fit(fx.orders_frame(spark, sf_dir), ForestParams(trees=TREES, seed=SEED, max_depth=2, criterion="gini", ranged=False, **flags), fx.NAMES)


@query(f"WITH {_FITTED}, {sql.reached('base', 'nodes', 2, 'features')}, {_oob_sql('leaf')} SELECT round({_ERROR}, 9) AS error FROM v")
def fit_oob_error(spark, sf_dir):
    """The out-of-bag error that fit measures."""
    fitted, _ = _fitted(spark, sf_dir, out_of_bag=True)
    return spark.createDataFrame([(round(fitted.measure("out_of_bag_error"), 9),)], "error double")


_NAMED = "CASE attr " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(fx.NAMES)) + " END"


@query(f"{_importance_ctes(base=_FITTED, nodes='nodes')} SELECT {_NAMED} AS name, round(importance, 9) AS importance FROM imp")
def fit_importances(spark, sf_dir):
    """The permutation importances that fit measures, by the names of the attributes."""
    fitted, _ = _fitted(spark, sf_dir, importances=True)
    return spark.createDataFrame([(n, round(fitted.measure(f"importance:{n}"), 9)) for n in fx.NAMES], "name string, importance double")


@query(f"WITH {_FITTED}, {sql.reached('base', 'nodes', 2, 'raw')} SELECT instance_id, round(sum(p1) / sum(p0 + p1), 9) AS p1, CASE WHEN sum(p1) > sum(p0) THEN 1 WHEN sum(p0) > 0 THEN 0 END AS prediction FROM leaf GROUP BY instance_id")
def fit_predict(spark, sf_dir):
    """A fitted forest, scored in chunks of trees as one too large for a single broadcast is."""
    fitted, _ = _fitted(spark, sf_dir)
    voted = model.tree_votes(fx.price_is_double(spark, sf_dir), fitted.nodes, "raw", 2, limit=7)
    share = vectors.normalised(model.vote_sum(F.col("votes"), 2))
    return voted.select("instance_id", share.alias("d")).select("instance_id", F.round(F.get("d", F.lit(1)), 9).alias("p1"), vectors.classified(F.col("d")).alias("prediction"))


@query()
def cv_forest(spark, sf_dir):
    """Three-fold cross-validation of a grown forest: rows, accuracy and AUC of each fold."""
    frame = cut(fx.orders_frame(spark, sf_dir))
    params = ForestParams(trees=TREES, seed=SEED, max_depth=2, criterion="gini", ranged=False)
    scored = cut(evaluate.cross_validated(frame, lambda rows: model.fit(rows, params, fx.NAMES)[0], 3, SEED))
    hit = (vectors.argmax(F.col("distribution")) == F.col("label")).cast("double")
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(100 * F.avg(hit), 9).alias("pct_correct"))


# --- whole forests (no SQL: too many levels to unroll) ----------------------------


@query()
def forest_fit_score(spark, sf_dir):
    """A gini forest on embeddings (8 trees, depth 4, 55 % bags), scored by row."""
    frame = fx.vectors_frame(spark, sf_dir).withColumn("label", (F.col("label") < 5).cast("int"))
    fitted, _ = model.fit(frame, ForestParams(trees=8, features=5, seed=42, max_depth=4, bag_percent=55, criterion="gini", ranged=False))
    return fitted.classify(frame).select("instance_id", F.round(F.get("distribution", F.lit(1)), 9).alias("p1"), "prediction")


