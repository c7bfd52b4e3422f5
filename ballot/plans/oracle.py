"""DuckDB SQL for the queries, written from their definitions; whole tables on both sides."""

from __future__ import annotations

from ballot.plans import forest_sql
from ballot.plans.queries import CLASS_LABELS, DEPTH, DIM, K, LABELLED, NARROW, QUERY_EVERY, SEED, TARGET, TRAIN_K, TREES, TUNE_AT

V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
S = "s AS (SELECT id, list_transform(vec, lambda x: x * (1 + id % 7)) AS vec FROM v)"
Q = f"q AS (SELECT id AS qid, vec FROM v WHERE id % {QUERY_EVERY} = 0)"
#: The queries and those that the votes required are measured on.
QA = f"qa AS (SELECT id AS qid, vec FROM v WHERE id % {QUERY_EVERY} IN (0, {TUNE_AT})), tune AS (SELECT * FROM qa WHERE qid % {QUERY_EVERY} = {TUNE_AT})"
OWN = f"qid % {QUERY_EVERY} = 0"
LEAST = "(SELECT v FROM least)"
BASE = f"WITH {V}, {S}, {Q}"
L2 = "list_distance({0}, {1})"
IP = "list_inner_product({0}, {1})"


def ranked(pairs: str, k: int, nearest: str = "ASC") -> str:
    return f"SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d {nearest}, id) AS rank, id, round(d, 5) + 0.0 AS distance FROM ({pairs})) WHERE rank <= {k}"


def pairs(metric: str, rows: str = "v", queries: str = "q", where: str = "") -> str:
    d = metric.format(f"{queries}.vec", f"{rows}.vec")
    return f"SELECT qid, {rows}.id AS id, {d} AS d FROM {queries}, {rows} {where}"


def padded(found: str, k: int) -> str:
    return f"SELECT qid, rank, coalesce(f.id, -1) AS id, coalesce(f.distance, -1.0) AS distance FROM (SELECT qid, unnest(range(1, {k} + 1)) AS rank FROM q) LEFT JOIN ({found}) f USING (qid, rank)"


def draw(place: str, at: int) -> str:
    return f"('0x' || substr(md5({place}), {at}, 8))::BIGINT"


def weights(density: float) -> str:
    place = f"'{SEED}:rp:' || t || ':' || l || ':' || d"
    normal = f"round(sqrt(-2 * ln(({draw(place, 1)} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {draw(place, 9)} / 4294967296.0::DOUBLE), 6)"
    value = normal if density >= 1 else f"CASE WHEN {draw(place, 17)} / 4294967296.0::DOUBLE < {density} THEN {normal} ELSE 0 END"
    return f"w AS (SELECT t, l, list({value} ORDER BY d) AS w FROM range({TREES}) a(t), range({DEPTH}) b(l), range({DIM}) c(d) GROUP BY t, l)"


def projection(density: float) -> str:
    return f"WITH {V}, {weights(density)} SELECT id, t::INT AS tree, l::INT AS level, round(list_inner_product(vec, w), 6) + 0.0 AS value FROM v, w"


ALL_LABELS = f"labels AS MATERIALIZED (SELECT qid AS train_id, id AS label FROM ({ranked(pairs(L2, queries='a').replace('FROM a, v', 'FROM (SELECT id AS qid, vec FROM v) a, v'), TRAIN_K)}))"


def least() -> str:
    """CTE: the votes that elect a share TARGET of the true neighbours of the tuning queries, less some room for rounding."""
    truth = ranked(pairs(L2, queries="tune"), K)
    return f"least AS MATERIALIZED (SELECT quantile_cont(coalesce(s.votes, 0.0::DOUBLE), {1 - TARGET!r}) - 1e-12 AS v FROM ({truth}) t LEFT JOIN summed s ON s.qid = t.qid AND s.label = t.id)"


def forest(*parts: str) -> str:
    """CTEs of an RP forest: p (projections), n0.. (training rows' nodes), splits, and those of parts with what they need:
    leaves, labels, counts, route, summed.
    """
    parts = set(parts)
    parts |= {"counts", "route"} if "summed" in parts else set()
    parts |= {"leaves", "labels"} if "counts" in parts else set()
    out = [V, S, Q, QA, weights(0.125), "p AS MATERIALIZED (SELECT id, t, l, round(list_inner_product(vec, w), 9) AS x FROM v, w)", f"n0 AS MATERIALIZED (SELECT id, t, 0 AS node FROM v, range({TREES}) a(t))"]
    for level in range(DEPTH):
        out.append(f"r{level} AS MATERIALIZED (SELECT n.id, n.t, n.node, x, row_number() OVER (PARTITION BY n.t, node ORDER BY x, n.id) AS r, count(*) OVER (PARTITION BY n.t, node) AS c FROM n{level} n JOIN p ON p.id = n.id AND p.t = n.t AND p.l = {level})")
        out.append(f"s{level} AS MATERIALIZED (SELECT t, node, median(x) AS split FROM r{level} GROUP BY t, node)")
        out.append(f"n{level + 1} AS MATERIALIZED (SELECT id, t, 2 * node + CASE WHEN r <= (c + 1) // 2 THEN 1 ELSE 2 END AS node FROM r{level})")
    out.append("splits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{level}" for level in range(DEPTH)) + ")")
    if "leaves" in parts:
        out.append(f"leaves AS (SELECT id AS train_id, t, node - {2**DEPTH - 1} AS leaf FROM n{DEPTH})")
    if "labels" in parts:
        out.append(ALL_LABELS)
    if "counts" in parts:
        out.append("counts AS MATERIALIZED (SELECT t, leaf, label, count(*) AS c FROM leaves JOIN labels USING (train_id) GROUP BY ALL)")
    if "route" in parts:
        out.append(f"g0 AS (SELECT qid, t, 0 AS node FROM qa, range({TREES}) a(t))")
        for level in range(DEPTH):
            out.append(f"g{level + 1} AS MATERIALIZED (SELECT g.qid, g.t, 2 * g.node + CASE WHEN x <= split THEN 1 ELSE 2 END AS node FROM g{level} g JOIN p ON p.id = g.qid AND p.t = g.t AND p.l = {level} JOIN s{level} s ON s.t = g.t AND s.node = g.node)")
        out.append(f"route AS (SELECT qid, t, node - {2**DEPTH - 1} AS leaf FROM g{DEPTH})")
    if "summed" in parts:
        out.append("summed AS MATERIALIZED (SELECT qid, label, sum(c)::DOUBLE AS votes FROM route JOIN counts USING (t, leaf) GROUP BY ALL)")
        out.append(least())
    return "WITH " + ",\n".join(out)


def ann(metric: str, rows: str, nearest: str, votes: float | str) -> str:
    cand = f"SELECT e.qid, c.id, {metric.format('q.vec', 'c.vec')} AS d FROM summed e JOIN {rows} c ON c.id = e.label JOIN q ON q.qid = e.qid WHERE votes >= {votes}"
    return padded(ranked(cand, K, nearest), K)


def root_gain() -> str:
    """CTE gains (t, ord, dim, position, gain, split) at the boundaries of each tree's root sample."""
    m = 8
    return f"""WITH {V},
labels AS (SELECT qid AS row, id AS label FROM ({ranked(pairs(L2, queries='a').replace('FROM a, v', 'FROM (SELECT id AS qid, vec FROM v) a, v'), TRAIN_K)})),
picked AS (SELECT t, id AS row, vec FROM (SELECT t, id, vec, row_number() OVER (PARTITION BY t ORDER BY md5('{SEED}:sub:' || t || ':0:' || id), id) AS r FROM v, range({TREES}) a(t)) WHERE r <= 100),
dims AS (SELECT * FROM (SELECT t, d, row_number() OVER (PARTITION BY t ORDER BY md5('{SEED}:rf:' || t || ':0:' || d), d) AS ord FROM range({TREES}) a(t), range({DIM}) b(d)) WHERE ord <= {m}),
keyed AS (SELECT t, ord, d, row, vec[d + 1] AS key FROM picked JOIN dims USING (t)),
each AS (SELECT t, ord, d, row, key, label FROM keyed JOIN labels USING (row)),
ahead AS (SELECT t, ord, d, row, key, sum(delta) AS delta FROM (SELECT *, n * log2(n) - CASE WHEN n > 1 THEN (n - 1) * log2(n - 1) ELSE 0 END AS delta FROM (SELECT *, row_number() OVER (PARTITION BY t, ord, label ORDER BY key, row) AS n FROM each)) GROUP BY ALL),
behind AS (SELECT t, ord, d, row, key, sum(delta) AS delta FROM (SELECT *, n * log2(n) - CASE WHEN n > 1 THEN (n - 1) * log2(n - 1) ELSE 0 END AS delta FROM (SELECT *, row_number() OVER (PARTITION BY t, ord, label ORDER BY key DESC, row DESC) AS n FROM each)) GROUP BY ALL),
placed AS (SELECT a.t, a.ord, a.d, a.key, row_number() OVER w AS i, count(*) OVER (PARTITION BY a.t, a.ord) AS n, sum(a.delta) OVER w AS pre, sum(b.delta) OVER (PARTITION BY a.t, a.ord ORDER BY a.key DESC, a.row DESC) AS suf, sum(a.delta) OVER (PARTITION BY a.t, a.ord) AS total, lead(a.key) OVER w AS next
  FROM ahead a JOIN behind b USING (t, ord, row) WINDOW w AS (PARTITION BY a.t, a.ord ORDER BY a.key, a.row)),
bounds AS (SELECT *, lead(suf) OVER (PARTITION BY t, ord ORDER BY i) AS right_sum FROM placed),
gains AS (SELECT t, ord, d, i - 1 AS position, (key + next) / 2 AS split,
  ({TRAIN_K} * log2(n) - total / n) - (i / n * ({TRAIN_K} * log2(i) - pre / i) + (n - i) / n * ({TRAIN_K} * log2(n - i) - right_sum / (n - i))) AS gain
  FROM bounds WHERE next IS NOT NULL AND next <> key)"""


#: Labels that the rows of a class share.
CLASSES = f"labels AS MATERIALIZED (SELECT vec_id AS train_id, label * 100 + j AS label FROM embeddings, range({CLASS_LABELS}) a(j))"
TRIED = 8  # whole part of DIM / sqrt(DIM)


def trees(kind: str, *parts: str, labels: str = ALL_LABELS, train_k: int = TRAIN_K) -> str:
    """CTEs of a whole RF or PCA forest, and those of parts: leaves, counts, route, summed."""
    parts = set(parts)
    parts |= {"counts", "route"} if "summed" in parts else set()
    parts |= {"leaves"} if "counts" in parts else set()
    out = [V, S, Q, QA]
    if kind == "RF" or "counts" in parts:
        out.append(labels)
    out += forest_sql.rf_levels(DEPTH, TREES, DIM, TRIED, SEED, train_k) if kind == "RF" else forest_sql.pca_levels(DEPTH, TREES, DIM, TRIED, SEED)
    if "route" in parts:
        out += (forest_sql.rf_route if kind == "RF" else forest_sql.pca_route)(DEPTH, TREES)
        out.append(f"route AS (SELECT qid, t, node - {2**DEPTH - 1} AS leaf FROM g{DEPTH})")
    if "leaves" in parts:
        out.append(f"leaves AS (SELECT id AS train_id, t, node - {2**DEPTH - 1} AS leaf FROM f{DEPTH})")
    if "counts" in parts:
        out.append("counts AS MATERIALIZED (SELECT t, leaf, label, count(*) AS c FROM leaves JOIN labels USING (train_id) GROUP BY ALL)")
    if "summed" in parts:
        vote = "c::DOUBLE" if kind == "PCA" else f"c / (sum(c) OVER (PARTITION BY t, leaf) * {TREES})::DOUBLE"
        out.append(f"weighed AS (SELECT t, leaf, label, {vote} AS vote FROM counts)")
        out.append("summed AS MATERIALIZED (SELECT qid, label, sum(vote) AS votes FROM route JOIN weighed USING (t, leaf) GROUP BY ALL)")
        out.append(least())
    return "WITH RECURSIVE " + ",\n".join(out)


def nodes(kind: str, head: str | None = None) -> str:
    own = "coalesce(s.d, -1)::INT AS split_dim" if kind == "RF" else "-1 AS split_dim"
    return f"{head or trees(kind)} SELECT a.t::INT AS tree, b.node::INT AS node, floor(log2(b.node + 1))::INT AS level, {own}, coalesce(round(s.split, 4), 0.0::DOUBLE) + 0.0 AS split_point FROM range({TREES}) a(t) CROSS JOIN range({2**DEPTH - 1}) b(node) LEFT JOIN splits s ON s.t = a.t AND s.node = b.node"


def share(found: str, exact: str, head: str) -> str:
    return f"{head}, found AS ({found}), truth AS ({exact}) SELECT qid, count(found.id) / {K}::DOUBLE AS recall FROM truth LEFT JOIN (SELECT qid, id FROM found WHERE id >= 0) found USING (qid, id) GROUP BY qid"


def oracle_sql() -> dict[str, str]:
    exact = ranked(pairs(L2), K)
    classes = trees("RF", labels=CLASSES, train_k=CLASS_LABELS)
    return {
        "pairwise_l2": f"{BASE} SELECT qid, id, round(d, 5) + 0.0 AS distance FROM ({pairs(L2)})",
        "pairwise_ip": f"{BASE} SELECT qid, id, round(d, 5) + 0.0 AS distance FROM ({pairs(IP, 's')})",
        "exact_l2_batch": f"{BASE} {exact}",
        "exact_l2_expressions": f"{BASE} {exact}",
        "exact_ip_batch": f"{BASE} {ranked(pairs(IP, 's'), K, 'DESC')}",
        "exact_cosine": f"{BASE}, c AS (SELECT q.qid, v.id, list_cosine_similarity(q.vec, v.vec) AS d FROM q, v) {ranked('SELECT * FROM c', K, 'DESC')}",
        "exact_single": f"{BASE} {ranked(pairs(L2, where='WHERE qid = 0'), K)}",
        "exact_k1_l2": f"{BASE} {ranked(pairs(L2), 1)}",
        "exact_k1_ip": f"{BASE} {ranked(pairs(IP, 's'), 1, 'DESC')}",
        "exact_ids_only": f"{BASE} SELECT qid, rank, id FROM ({exact})",
        "exact_padded": f"{BASE} {padded(ranked(pairs(L2, where=f'WHERE label = {LABELLED}'), NARROW), NARROW)}",
        "training_labels": f"{forest('labels')} SELECT train_id, label FROM labels",
        "rp_projection_dense": projection(1.0),
        "rp_projection_sparse": projection(0.125),
        "rp_split_points": f"{forest()} SELECT t::INT AS tree, node, round(split, 4) + 0.0 AS split_point FROM splits",
        "rp_leaf_assignment": f"{forest('leaves')} SELECT train_id, t::INT AS tree, leaf FROM leaves",
        "leaf_votes_raw": f"{forest('counts')} SELECT t::INT AS tree, leaf, label, c::DOUBLE AS vote FROM counts",
        "leaf_votes_min_b": f"{forest('counts')} SELECT t::INT AS tree, leaf, label, c::DOUBLE AS vote FROM counts WHERE c >= 5",
        "leaf_votes_normalised": f"{forest('counts')} SELECT t::INT AS tree, leaf, label, round(c / (sum(c) OVER (PARTITION BY t, leaf) * {TREES})::DOUBLE, 9) AS vote FROM counts WHERE c >= 5",
        "rp_route": f"{forest('route')} SELECT qid, t::INT AS tree, leaf FROM route WHERE {OWN}",
        "rp_votes": f"{forest('summed')} SELECT qid, label, votes FROM summed WHERE {OWN}",
        "rp_elected": f"{forest('summed')} SELECT qid, label, votes FROM summed WHERE votes >= {LEAST} AND {OWN}",
        "rp_n_elected": f"{forest('summed')} SELECT qid, count(votes) AS n_elected FROM q LEFT JOIN (SELECT * FROM summed WHERE votes >= {LEAST}) USING (qid) GROUP BY qid",
        "ann_rp_l2": f"{forest('summed')} {ann(L2, 'v', 'ASC', LEAST)}",
        "ann_rp_ip": f"{forest('summed')} {ann(IP, 's', 'DESC', LEAST)}",
        "ann_rp_empty_election": f"{forest('summed')} {ann(L2, 'v', 'ASC', 1e9)}",
        "rf_root_gain": f"{root_gain()} SELECT t::INT AS tree, d::INT AS dim, position, round(gain, 6) + 0.0 AS gain, round(split, 6) + 0.0 AS split FROM gains",
        "rf_root_split": f"{root_gain()} SELECT t::INT AS tree, x.d::INT AS dim, round(x.split, 6) + 0.0 AS split FROM (SELECT t, list_reduce(list_prepend({{'gain': 0::DOUBLE, 'd': -1::BIGINT, 'split': 0::DOUBLE}}, list({{'gain': gain, 'd': d, 'split': split}} ORDER BY ord, position)), lambda a, b: CASE WHEN b.gain > a.gain + 0.001 THEN b ELSE a END) AS x FROM gains GROUP BY t)",
        "rf_nodes": nodes("RF"),
        "rf_terminal": nodes("RF", classes),
        "rf_terminal_leaves": f"{trees('RF', 'leaves', labels=CLASSES, train_k=CLASS_LABELS)} SELECT train_id, t::INT AS tree, leaf FROM leaves",
        "rf_leaf_votes": f"{trees('RF', 'counts')} SELECT t::INT AS tree, leaf, label, round(c / (sum(c) OVER (PARTITION BY t, leaf) * {TREES})::DOUBLE, 9) AS vote FROM counts WHERE c >= 2",
        "rf_route": f"{trees('RF', 'route')} SELECT qid, t::INT AS tree, leaf FROM route WHERE {OWN}",
        "pca_route": f"{trees('PCA', 'route')} SELECT qid, t::INT AS tree, leaf FROM route WHERE {OWN}",
        "pca_leaf_assignment": f"{trees('PCA', 'leaves')} SELECT train_id, t::INT AS tree, leaf FROM leaves",
        "ann_rf_ip": f"{trees('RF', 'summed')} {ann(IP, 's', 'DESC', LEAST)}",
        "ann_pca_ip": f"{trees('PCA', 'summed')} {ann(IP, 's', 'DESC', LEAST)}",
        "ann_single": f"{trees('PCA', 'summed')} SELECT * FROM ({ann(L2, 'v', 'ASC', LEAST)}) WHERE qid = 0",
        "ann_zero_threshold": f"{forest('summed')} {ann(L2, 'v', 'ASC', 0)}",
        "ann_reloaded": f"{forest('summed')} {ann(L2, 'v', 'ASC', LEAST)}",
        "rf_leaf_assignment": f"{trees('RF', 'leaves')} SELECT train_id, t::INT AS tree, leaf FROM leaves",
        "ann_rf_l2": f"{trees('RF', 'summed')} {ann(L2, 'v', 'ASC', LEAST)}",
        "pca_root_direction": f"{trees('PCA')} SELECT t::INT AS tree, (j - 1)::INT AS place, dims[j]::INT AS dim, round(w[j], 6) + 0.0 AS weight FROM c0, range(1, {TRIED + 1}) a(j)",
        "pca_nodes": nodes("PCA"),
        "ann_pca_l2": f"{trees('PCA', 'summed')} {ann(L2, 'v', 'ASC', LEAST)}",
        "recall_at_k": share(ann(L2, "v", "ASC", LEAST), exact, forest("summed")),
        "recall_at_k_rf": share(ann(L2, "v", "ASC", LEAST), exact, trees("RF", "summed")),
        "recall_at_k_pca": share(ann(L2, "v", "ASC", LEAST), exact, trees("PCA", "summed")),
    }
