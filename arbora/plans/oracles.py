"""SQL text of the same computations for an independent engine: unrolled, without any of the engine's code."""

from __future__ import annotations


def hashed(*parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', {inner})), 1, 15) AS BIGINT)"


def fast_log2(x: str) -> str:
    v = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    e0 = f"floor(log2({v}))"
    e = f"(CASE WHEN {v} < pow(2.0, {e0}) THEN {e0} - 1 WHEN {v} >= 2 * pow(2.0, {e0}) THEN {e0} + 1 ELSE {e0} END)"
    m = f"CAST({v} / pow(2.0, {e}) AS FLOAT)"
    third, two, rest = "CAST(-1.0::DOUBLE / 3 AS FLOAT)", "CAST(2.0 AS FLOAT)", "CAST(2.0::DOUBLE / 3 AS FLOAT)"
    return f"((({third} * {m} + {two}) * {m} - {rest}) + CAST({e} - 1 AS FLOAT))"


def x_log_x(x: str) -> str:
    return f"(CASE WHEN {x} <= 1e-6 THEN 0.0::DOUBLE ELSE {x} * CAST({fast_log2(x)} AS DOUBLE) END)"


def entropy(branch: list[str]) -> str:
    return f"({x_log_x('(' + ' + '.join(branch) + ')')} - ({' + '.join(x_log_x(c) for c in branch)}))"


def gini(branch: list[str]) -> str:
    s = "(" + " + ".join(branch) + ")"
    squares = " + ".join(f"{c} * {c}" for c in branch)
    return f"(CASE WHEN {s} = 0 THEN 0.0::DOUBLE ELSE {s} - ({squares}) / {s} END)"


def bag(rows: str, trees: int, seed: int, percent: int = 100, base: str = "base") -> str:
    """CTEs n, bag."""
    size = f"((SELECT count(*) FROM {base}) * {percent} // 100)"
    return f"""draws AS MATERIALIZED (
  SELECT t.tree, {hashed("'bag'", str(seed), "t.tree", "d.draw")} % (SELECT count(*) FROM {base}) AS instance_id
  FROM (SELECT unnest(range({trees})) AS tree) t, (SELECT unnest(range({size})) AS draw) d),
bag AS MATERIALIZED (SELECT tree, instance_id, count(*) AS n_draws FROM draws GROUP BY tree, instance_id)"""


def subset(trees: int, attributes: int, size: int, seed: int) -> str:
    return f"""SELECT tree, attr FROM (
  SELECT t.tree, a.attr, row_number() OVER (PARTITION BY t.tree ORDER BY {hashed("'subset'", str(seed), "t.tree", "a.attr")}, a.attr) AS r
  FROM (SELECT unnest(range({trees})) AS tree) t, (SELECT unnest(range({attributes})) AS attr) a) WHERE r <= {size}"""


def sums(classes: int) -> str:
    return ", ".join(f"sum(CASE WHEN label = {k} THEN w ELSE 0.0 END)::DOUBLE AS c{k}" for k in range(classes))


def scan(histogram: str, classes: int, criterion: str, class_change: bool) -> str:
    """All candidates of a histogram table (tree, node, attr, value, c0.., first_label, last_label)."""
    k = range(classes)
    run = ", ".join(f"sum(c{i}) OVER (PARTITION BY tree, node, attr ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l{i}" for i in k)
    whole = ", ".join(f"sum(c{i}) OVER (PARTITION BY tree, node, attr) AS t{i}" for i in k)
    impurity = entropy if criterion == "entropy" else gini
    left, right, all_ = [f"l{i}" for i in k], [f"(t{i} - l{i})" for i in k], [f"t{i}" for i in k]
    change = " AND last_label <> next_label" if class_change else ""
    return f"""SELECT tree, node, attr, (CAST(value AS DOUBLE) + CAST(next_value AS DOUBLE)) / 2 AS split,
    {impurity(left)} + {impurity(right)} AS score, {impurity(all_)} AS prior
  FROM (SELECT *, {run}, {whole},
    lead(value) OVER (PARTITION BY tree, node, attr ORDER BY value) AS next_value,
    lead(first_label) OVER (PARTITION BY tree, node, attr ORDER BY value) AS next_label FROM {histogram})
  WHERE next_value IS NOT NULL{change}"""


def root_histogram(classes: int, base: str = "base") -> str:
    """The histogram of a whole table as one node."""
    return f"""SELECT 0 AS tree, 1 AS node, attr, value, {sums(classes)}, arg_min(label, instance_id) AS first_label, arg_max(label, instance_id) AS last_label
  FROM (SELECT instance_id, unnest(range(len(features))) AS attr, unnest(features) AS value, label, weight AS w FROM {base}) GROUP BY attr, value"""


def forest(base_sql: str, trees: int, k: int, depth: int, seed: int, classes: int = 2, criterion: str = "gini", class_change: bool = True, attributes: int = 4, percent: int = 100, subset_size: int = 0, whole_table: bool = False) -> str:
    """WITH clause of a forest grown level by level; its nodes are in the table `nodes`."""
    bag_sql = "bag AS (SELECT 0 AS tree, instance_id, 1 AS n_draws FROM base)" if whole_table else bag("base", trees, seed, percent)
    attrs = subset(trees, attributes, subset_size, seed) if subset_size else f"SELECT t.tree, a.attr FROM (SELECT unnest(range({trees})) AS tree) t, (SELECT unnest(range({attributes})) AS attr) a"
    parts = [
        f"base AS MATERIALIZED ({base_sql})",
        bag_sql,
        f"attrs AS MATERIALIZED ({attrs})",
        "rows0 AS MATERIALIZED (SELECT b.tree, 1::BIGINT AS node, x.instance_id, x.features, x.label, b.n_draws * x.weight AS w FROM bag b JOIN base x USING (instance_id))",
    ]
    pure = " + ".join(f"(c{i} >= 1e-5)::INT" if criterion == "gini" else f"(c{i} > 0)::INT" for i in range(classes))
    probs = ", ".join(f"CASE WHEN {{leaf}} THEN c{i} / n_rows END AS p{i}" for i in range(classes))
    for d in range(depth + 1):
        parts.append(f"stats{d} AS MATERIALIZED (SELECT tree, node, count(*) AS n_rows, {sums(classes)} FROM rows{d} GROUP BY tree, node)")
        if d == depth:
            parts.append(f"nodes{d} AS (SELECT tree, node, {d} AS depth, -1 AS attr, NULL::DOUBLE AS split, NULL::BIGINT AS lft, NULL::BIGINT AS rgt, n_rows, {probs.format(leaf='true')} FROM stats{d})")
            break
        parts += [
            f"active{d} AS MATERIALIZED (SELECT tree, node FROM stats{d} WHERE n_rows >= 2 AND {pure} > 1)",
            f"hist{d} AS MATERIALIZED (SELECT r.tree, r.node, a.attr, r.features[a.attr + 1] AS value, {sums(classes)}, arg_min(label, instance_id) AS first_label, arg_max(label, instance_id) AS last_label FROM rows{d} r JOIN active{d} USING (tree, node) JOIN attrs a ON a.tree = r.tree GROUP BY r.tree, r.node, a.attr, r.features[a.attr + 1])",
            f"cand{d} AS MATERIALIZED ({scan(f'hist{d}', classes, criterion, class_change)})",
            f"best{d} AS (SELECT *, prior - score AS gain FROM (SELECT *, row_number() OVER (PARTITION BY tree, node, attr ORDER BY score, split) AS r FROM cand{d}) WHERE r = 1)",
            f"order{d} AS (SELECT x.tree, x.node, a.attr, row_number() OVER (PARTITION BY x.tree, x.node ORDER BY {hashed(repr('attr'), str(seed), 'x.tree', 'x.node', 'a.attr')}, a.attr) AS rnk FROM active{d} x JOIN attrs a ON a.tree = x.tree)",
            f"chosen{d} AS MATERIALIZED (SELECT tree, node, attr, split FROM (SELECT b.tree, b.node, b.attr, b.split, row_number() OVER (PARTITION BY b.tree, b.node ORDER BY CASE WHEN o.rnk <= {k} THEN 0 ELSE 1 END, CASE WHEN o.rnk <= {k} THEN -b.gain ELSE 0 END, o.rnk) AS r2 FROM best{d} b JOIN order{d} o ON o.tree = b.tree AND o.node = b.node AND o.attr = b.attr WHERE b.gain > 0.01) WHERE r2 = 1)",
            f"nodes{d} AS (SELECT s.tree, s.node, {d} AS depth, coalesce(c.attr, -1) AS attr, c.split, CASE WHEN c.attr IS NOT NULL THEN s.node * 2 END AS lft, CASE WHEN c.attr IS NOT NULL THEN s.node * 2 + 1 END AS rgt, s.n_rows, {probs.format(leaf='c.attr IS NULL')} FROM stats{d} s LEFT JOIN chosen{d} c ON c.tree = s.tree AND c.node = s.node)",
            f"rows{d + 1} AS MATERIALIZED (SELECT r.tree, r.node * 2 + CASE WHEN CAST(r.features[c.attr + 1] AS DOUBLE) < c.split THEN 0 ELSE 1 END AS node, r.instance_id, r.features, r.label, r.w FROM rows{d} r JOIN chosen{d} c ON c.tree = r.tree AND c.node = r.node)",
        ]
    parts.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM nodes{d}" for d in range(depth + 1)) + ")")
    return "WITH " + ",\n".join(parts)


def reached(base: str, nodes: str, depth: int, vector: str, extra: str = "") -> str:
    """CTEs at0 .. and leaf (instance_id, tree, p0, p1): rows of base routed through a node table."""
    parts = [f"at0 AS (SELECT x.instance_id, x.{vector} AS v{extra}, t.tree, 1 AS node FROM {base} x, (SELECT DISTINCT tree FROM {nodes}) t)"]
    keep = "".join(f", a.{c.strip()}" for c in extra.split(",") if c.strip()).replace("a.x.", "a.")
    for d in range(depth):
        parts.append(f"at{d + 1} AS (SELECT a.instance_id, a.v{keep}, a.tree, CASE WHEN n.attr < 0 THEN a.node WHEN a.v[n.attr + 1] < n.split THEN n.lft ELSE n.rgt END AS node FROM at{d} a JOIN {nodes} n ON n.tree = a.tree AND n.node = a.node)")
    parts.append(f"leaf AS MATERIALIZED (SELECT a.instance_id{keep}, a.tree, n.p0, n.p1 FROM at{depth} a JOIN {nodes} n ON n.tree = a.tree AND n.node = a.node)")
    return ",\n".join(parts)
