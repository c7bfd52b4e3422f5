"""DuckDB SQL of whole RF and PCA forests: a few table expressions a level, written from the definitions."""

from __future__ import annotations

DELTA = "n * log2(n) - CASE WHEN n > 1 THEN (n - 1) * log2(n - 1) ELSE 0 END"


def rf_levels(depth: int, trees: int, dim: int, tried: int, seed: int, train_k: int, sample: int = 100, tolerance: float = 0.001) -> list[str]:
    """f0..: training rows' nodes and whether these may split; x0..: the splits of a level. Needs v and labels."""
    out = [f"f0 AS MATERIALIZED (SELECT id, t, 0::BIGINT AS node, true AS alive FROM v, range({trees}) a(t))"]
    for e in range(depth):
        side = lambda name, order, e=e: f"{name}{e} AS (SELECT t, node, ord, row, sum({DELTA}) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY t, node, ord, label ORDER BY {order}) AS n FROM each{e}) GROUP BY ALL)"
        out += [
            f"picked{e} AS (SELECT t, node, id AS row FROM (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY md5('{seed}:sub:' || t || ':' || node || ':' || id), id) AS r FROM f{e} WHERE alive) WHERE r <= {sample})",
            f"dims{e} AS (SELECT * FROM (SELECT t, d, row_number() OVER (PARTITION BY t ORDER BY md5('{seed}:rf:' || t || ':{e}:' || d), d) AS ord FROM range({trees}) a(t), range({dim}) b(d)) WHERE ord <= {tried})",
            f"keyed{e} AS MATERIALIZED (SELECT p.t, node, ord, d, row, vec[d + 1] AS key FROM picked{e} p JOIN dims{e} USING (t) JOIN v ON v.id = p.row)",
            f"each{e} AS MATERIALIZED (SELECT t, node, ord, row, key, label FROM keyed{e} JOIN labels ON train_id = row)",
            side("ahead", "key, row"),
            side("behind", "key DESC, row DESC"),
            f"""placed{e} AS (SELECT k.t, k.node, k.ord, k.d, k.key, row_number() OVER w AS i, count(*) OVER g AS n, sum(a.delta) OVER w AS pre, sum(b.delta) OVER (PARTITION BY k.t, k.node, k.ord ORDER BY k.key DESC, k.row DESC) AS suf, sum(a.delta) OVER g AS total, lead(k.key) OVER w AS next
  FROM keyed{e} k JOIN ahead{e} a USING (t, node, ord, row) JOIN behind{e} b USING (t, node, ord, row) WINDOW g AS (PARTITION BY k.t, k.node, k.ord), w AS (PARTITION BY k.t, k.node, k.ord ORDER BY k.key, k.row))""",
            f"bounds{e} AS (SELECT *, lead(suf) OVER (PARTITION BY t, node, ord ORDER BY i) AS right_sum FROM placed{e})",
            f"""gains{e} AS (SELECT t, node, ord, d, i, (key + next) / 2 AS split, ({train_k} * log2(n) - total / n) - (i / n * ({train_k} * log2(i) - pre / i) + (n - i) / n * ({train_k} * log2(n - i) - right_sum / (n - i))) AS gain
  FROM bounds{e} WHERE next IS NOT NULL AND next <> key)""",
            f"""x{e} AS MATERIALIZED (SELECT t, node, x.d AS d, x.split AS split FROM (SELECT t, node, list_reduce(list_prepend({{'gain': 0::DOUBLE, 'd': -1::BIGINT, 'split': 0::DOUBLE}}, list({{'gain': gain, 'd': d, 'split': split}} ORDER BY ord, i)), lambda a, b: CASE WHEN b.gain > a.gain + {tolerance} THEN b ELSE a END) AS x FROM gains{e} GROUP BY t, node) WHERE x.d >= 0)""",
            f"f{e + 1} AS MATERIALIZED (SELECT f.id, f.t, 2 * f.node + CASE WHEN x.d IS NULL OR vec[x.d + 1] <= x.split THEN 1 ELSE 2 END AS node, x.d IS NOT NULL AS alive FROM f{e} f JOIN v ON v.id = f.id LEFT JOIN x{e} x ON x.t = f.t AND x.node = f.node AND f.alive)",
        ]
    out.append("splits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM x{e}" for e in range(depth)) + ")")
    return out


def pca_levels(depth: int, trees: int, dim: int, m: int, seed: int) -> list[str]:
    """f0..: training rows' nodes; c0..: nodes' dimensions and directions; splits. Needs v."""
    u = lambda at: f"('0x' || substr(md5('{seed}:pca:' || t || ':' || node || ':' || j), {at}, 8))::BIGINT"
    normal = f"round(sqrt(-2 * ln(({u(1)} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {u(9)} / 4294967296.0::DOUBLE), 6)"
    unit = lambda v: f"list_transform({v}, lambda y: y / sqrt(list_inner_product({v}, {v})))"
    out = [f"f0 AS MATERIALIZED (SELECT id, t, 0::BIGINT AS node FROM v, range({trees}) a(t))"]
    for e in range(depth):
        out += [
            f"d{e} AS MATERIALIZED (SELECT t, node, list({u(17)} % {dim} ORDER BY j) AS dims, list({normal} ORDER BY j) AS w FROM range({trees}) a(t), range({2**e - 1}, {2 ** (e + 1) - 1}) b(node), range({m}) c(j) GROUP BY t, node)",
            f"y{e} AS MATERIALIZED (SELECT f.id, f.t, f.node, list_transform(dims, lambda d: vec[d + 1]) AS y FROM f{e} f JOIN v USING (id) JOIN d{e} USING (t, node))",
            f"n{e} AS (SELECT t, node, count(*) AS n FROM y{e} GROUP BY ALL)",
            f"m{e} AS (SELECT t, node, i, avg(y[i + 1]) AS mean FROM y{e}, range({m}) a(i) GROUP BY ALL)",
            f"k{e} AS MATERIALIZED (SELECT t, node, i, list(0.02 / (n - 1) * c ORDER BY j) AS row FROM (SELECT y.t, y.node, a.i, b.i AS j, sum((y[a.i + 1] - a.mean) * (y[b.i + 1] - b.mean)) AS c FROM y{e} y JOIN m{e} a ON a.t = y.t AND a.node = y.node JOIN m{e} b ON b.t = y.t AND b.node = y.node GROUP BY ALL) JOIN n{e} USING (t, node) GROUP BY t, node, i)",
            f"kk{e} AS MATERIALIZED (SELECT t, node, list(row ORDER BY i) AS c FROM k{e} GROUP BY ALL)",
            f"p{e} AS (SELECT t, node, 0 AS step, c, {unit('w')} AS w, 1.0::DOUBLE AS moved FROM d{e} JOIN kk{e} USING (t, node) UNION ALL SELECT t, node, step + 1, c, new, list_sum(list_transform(range(1, {m} + 1), lambda i: abs(new[i] - w[i]))) / {m} FROM (SELECT t, node, step, c, w, {unit('raw')} AS new FROM (SELECT *, list_transform(range(1, {m} + 1), lambda i: w[i] + list_inner_product(c[i], w)) AS raw FROM p{e} WHERE step < 20 AND moved >= 0.01)))",
            f"c{e} AS MATERIALIZED (SELECT t, node, dims, list_transform(w, lambda y: round(y, 9)) AS w FROM (SELECT t, node, arg_max(w, step) AS w FROM p{e} GROUP BY ALL) JOIN (SELECT t, node, dims FROM d{e}) USING (t, node))",
            f"r{e} AS MATERIALIZED (SELECT y.id, y.t, y.node, x, row_number() OVER (PARTITION BY y.t, y.node ORDER BY x, y.id) AS r, count(*) OVER (PARTITION BY y.t, y.node) AS c FROM (SELECT y.*, round(list_inner_product(y, w), 9) AS x FROM y{e} y JOIN c{e} USING (t, node)) y)",
            f"s{e} AS MATERIALIZED (SELECT t, node, median(x) AS split FROM r{e} GROUP BY ALL)",
            f"f{e + 1} AS MATERIALIZED (SELECT id, t, 2 * node + CASE WHEN r <= (c + 1) // 2 THEN 1 ELSE 2 END AS node FROM r{e})",
        ]
    out.append("splits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{e}" for e in range(depth)) + ")")
    return out


def pca_route(depth: int, trees: int) -> list[str]:
    """g0..: the queries' nodes."""
    out = [f"g0 AS (SELECT qid, t, 0::BIGINT AS node FROM qa, range({trees}) a(t))"]
    for e in range(depth):
        out.append(f"g{e + 1} AS MATERIALIZED (SELECT g.qid, g.t, 2 * g.node + CASE WHEN round(list_inner_product(list_transform(dims, lambda d: q.vec[d + 1]), w), 9) <= split THEN 1 ELSE 2 END AS node FROM g{e} g JOIN qa q USING (qid) JOIN c{e} USING (t, node) JOIN s{e} USING (t, node))")
    return out


def rf_route(depth: int, trees: int) -> list[str]:
    out = [f"g0 AS (SELECT qid, t, 0::BIGINT AS node FROM qa, range({trees}) a(t))"]
    for e in range(depth):
        out.append(f"g{e + 1} AS MATERIALIZED (SELECT g.qid, g.t, 2 * g.node + CASE WHEN x.d IS NULL OR q.vec[x.d + 1] <= x.split THEN 1 ELSE 2 END AS node FROM g{e} g JOIN qa q USING (qid) LEFT JOIN x{e} x ON x.t = g.t AND x.node = g.node)")
    return out
