"""DuckDB SQL that answers the catalogue's queries from the same tables, by other means where there are any."""

from __future__ import annotations

ATTACKS, SEED, CHUNK = 100, 1, 20

NATIONS = "nations AS (SELECT CAST(n_nationkey AS INT) AS node, n_name AS label FROM nation)"
TRADE = f"""{NATIONS}, trade AS (SELECT 'trade_' || year(o_orderdate) AS graph_id, CAST(least(c_nationkey, s_nationkey) AS INT) AS u, CAST(greatest(c_nationkey, s_nationkey) AS INT) AS v,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2, 3),
nodes AS (SELECT graph_id, node, label FROM (SELECT DISTINCT 'trade_' || year(o_orderdate) AS graph_id FROM orders), nations)"""
BRANDS = """held AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
brands AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS node FROM (SELECT DISTINCT p_brand AS label FROM part)),
named AS (SELECT l_orderkey, node FROM held JOIN brands ON p_brand = label),
copurchase AS (SELECT 'copurchase' AS graph_id, a.node AS u, b.node AS v, CAST(count(*) AS DOUBLE) AS w FROM named a JOIN named b USING (l_orderkey) WHERE a.node < b.node GROUP BY ALL)"""
PAIRS = """pairs AS (SELECT 'users' AS graph_id, event_id, CAST(user_id AS VARCHAR) AS u, CAST(lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS VARCHAR) AS v,
 CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(CAST(value - 50 AS DECIMAL(18,3)) AS VARCHAR) END AS w FROM events),
sound AS (SELECT graph_id, u, v, coalesce(TRY_CAST(w AS DOUBLE), 1.0) AS w FROM pairs WHERE v IS NOT NULL),
names AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS node FROM (SELECT u AS label FROM sound UNION SELECT v FROM sound))"""


def strongest(p: float | str, graph: str = "trade", rule: str = "round", name: str = "kept", where: str = "") -> str:
    """The proportional threshold of a graph of 25 nodes (300 pairs), ties by (u, v)."""
    return f"{name} AS (SELECT graph_id, u, v, w FROM {graph} WHERE w <> 0 {where} QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY abs(w) DESC, u, v) <= greatest(1, {rule}(CAST({p} AS DOUBLE) * 300)))"


KEPT95 = f"{TRADE}, {strongest(0.1, where="AND graph_id = 'trade_1995'")}, own AS (SELECT * FROM nodes WHERE graph_id = 'trade_1995')"


def closure(first: str, keys: str, rounds: int = 5, name: str = "b") -> str:
    """The best bottleneck of all paths by repeated squaring of {name}0 (keys, u, v, c)."""
    parts = [f"{name}0 AS ({first})"]
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    pick = ", ".join(f"x.{k}" for k in keys.split(", "))
    for i in range(1, rounds + 1):
        parts.append(f"{name}{i} AS MATERIALIZED (SELECT {pick}, x.u, y.v, max(least(x.c, y.c)) AS c FROM {name}{i - 1} x JOIN {name}{i - 1} y ON {on} AND x.v = y.u GROUP BY ALL)")
    return ", ".join(parts)


POSITIONS = f"pos AS (SELECT graph_id, CAST(a AS BIGINT) AS attack_id, node, CAST(row_number() OVER (PARTITION BY graph_id, a ORDER BY md5('{SEED}:' || a || ':' || node), node) AS INT) AS pos FROM own, range({ATTACKS}) t(a))"
_CAPACITY = """SELECT p.attack_id, e.u, e.v, least(p.pos, q.pos) AS c FROM (SELECT u, v FROM kept UNION ALL SELECT v, u FROM kept) e JOIN pos p ON p.node = e.u JOIN pos q ON q.node = e.v AND q.attack_id = p.attack_id
 UNION ALL SELECT attack_id, node, node, pos FROM pos"""
TRACE = f"""{KEPT95}, {POSITIONS}, {closure(_CAPACITY, 'attack_id')},
comp AS (SELECT attack_id, s AS step, u, count(*) AS size, min(v) AS rep FROM b5, range(1, 25) t(s) WHERE c > s GROUP BY ALL),
sizes AS (SELECT attack_id, step, size, row_number() OVER (PARTITION BY attack_id, step ORDER BY size DESC) AS r FROM comp WHERE u = rep),
trace AS (SELECT 'trade_1995' AS graph_id, attack_id, CAST(step AS INT) AS step, CAST(max(size) AS INT) AS first, CAST(coalesce(max(size) FILTER (r = 2), 0) AS INT) AS second FROM sizes GROUP BY ALL)"""
POINTS = f"""{TRACE}, points AS (SELECT graph_id, attack_id, CAST(CASE WHEN max(second) > 1 THEN arg_max(step, second * 1000 - step) ELSE 25 END AS INT) AS pstep FROM trace GROUP BY ALL)"""
PIP = f"""{POINTS}, hits AS (SELECT p.graph_id, CAST(p.attack_id // {CHUNK} AS BIGINT) AS chunk, pstep AS step, node FROM points p JOIN pos USING (graph_id, attack_id) WHERE pos <= pstep),
counts AS (SELECT graph_id, CAST(s AS INT) AS step, count(pstep) AS n FROM (SELECT DISTINCT graph_id FROM own), range(1, 26) t(s) LEFT JOIN (SELECT pstep FROM points) ON pstep = s GROUP BY ALL),
sums AS (SELECT graph_id, step, node, count(*) AS k FROM hits GROUP BY ALL),
pip AS (SELECT c.graph_id, c.step, o.node, c.n, coalesce(k, 0) AS k, CASE WHEN c.n > 0 THEN CAST(coalesce(k, 0) AS DOUBLE) / c.n END AS p FROM counts c JOIN own o USING (graph_id) LEFT JOIN sums s ON s.step = c.step AND s.node = o.node)"""


def wilson(k: str, n: str) -> str:
    p = f"({k} / CAST({n} AS DOUBLE))"
    return f"CASE WHEN {n} > 0 THEN 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}) END"


def hazen(values: str, q: float) -> str:
    """From a sorted list without NULLs."""
    x = f"greatest(1.0, least(CAST(len({values}) AS DOUBLE), {q}::DOUBLE * len({values}) + 0.5))"
    low = f"CAST(floor({x}) AS INT)"
    return f"CASE WHEN len({values}) > 0 THEN {values}[{low}] + ({values}[least({low} + 1, len({values}))] - {values}[{low}]) * ({x} - {low}) END"


HISTORY = f"""{PIP}, chunks AS (SELECT DISTINCT graph_id, chunk FROM hits),
run_n AS (SELECT c.graph_id, c.chunk, p.pstep AS step, count(*) AS n FROM chunks c JOIN points p ON p.attack_id < (c.chunk + 1) * {CHUNK} GROUP BY ALL),
run_k AS (SELECT c.graph_id, c.chunk, h.step, h.node, count(*) AS k FROM chunks c JOIN hits h ON h.chunk <= c.chunk GROUP BY ALL),
widths AS (SELECT n.graph_id, n.chunk, {wilson('coalesce(k, 0)', 'n')} AS hw FROM run_n n JOIN own o USING (graph_id) LEFT JOIN run_k k ON k.chunk = n.chunk AND k.step = n.step AND k.node = o.node),
listed AS (SELECT graph_id, chunk, list(hw ORDER BY hw) AS hws FROM widths GROUP BY ALL),
hist AS (SELECT graph_id, chunk, (chunk + 1) * {CHUNK} AS n_attacks, {hazen('hws', 0.95)} AS hw95 FROM listed)"""
PLATEAU = f"""{HISTORY}, win AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(hw95) OVER w END AS win_mean, CASE WHEN count(*) OVER w = 3 THEN max(hw95) OVER w - min(hw95) OVER w END AS win_range,
 CASE WHEN count(*) OVER w = 3 THEN regr_slope(hw95, n_attacks) OVER w END AS win_slope FROM hist WINDOW w AS (PARTITION BY graph_id ORDER BY chunk ROWS 2 PRECEDING)),
flags AS (SELECT *, coalesce(win_mean < 0.5 AND win_range < 0.05 AND abs(win_slope) < 0.002, false) AS is_plateau FROM win),
islands AS (SELECT *, sum(CASE WHEN is_plateau THEN 0 ELSE 1 END) OVER (PARTITION BY graph_id ORDER BY chunk) AS island FROM flags),
runs AS (SELECT *, CAST(sum(CASE WHEN is_plateau THEN 1 ELSE 0 END) OVER (PARTITION BY graph_id, island ORDER BY chunk) AS INT) AS run FROM islands)"""

ACTIVITY = """ev AS (SELECT event_type AS graph_id, CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) + 1 AS INT) AS step, CAST(user_id % 12 AS INT) AS node, value FROM events),
share AS (SELECT graph_id, step, node, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS p FROM ev GROUP BY ALL HAVING count(*) >= 2),
ends AS (SELECT graph_id, max(step) AS m FROM ev GROUP BY 1),
activity AS (SELECT e.graph_id, CAST(s AS INT) AS step, CAST(n AS INT) AS node, p FROM ends e JOIN range(1, 10000) t(s) ON s <= m CROSS JOIN range(12) z(n) LEFT JOIN share x ON x.graph_id = e.graph_id AND x.step = s AND x.node = n)"""


def cropped(rule: str) -> str:
    sound = "count(p) > 0" if rule == "all" else "count(p) = count(*)"
    return f"""{ACTIVITY}, ok AS (SELECT graph_id, step FROM activity GROUP BY ALL HAVING {sound}),
isl AS (SELECT graph_id, step, step - row_number() OVER (PARTITION BY graph_id ORDER BY step) AS g FROM ok),
blocks AS (SELECT graph_id, min(step) AS first, count(*) AS n FROM isl GROUP BY graph_id, g),
best AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, first) = 1),
crop AS (SELECT a.graph_id, step, node, p, CAST(step - first AS INT) AS place, CAST(n AS INT) AS n_steps FROM activity a JOIN best b USING (graph_id) WHERE step >= first AND step < first + n)"""


TILTED = f"{cropped('all')}, tilted AS (SELECT *, greatest(coalesce(p, 0.0), 0.0) * exp(-(place + 1) / greatest(2.0, n_steps / 6.0::DOUBLE)) AS value FROM crop)"
STRENGTH = "both_ways AS (SELECT graph_id, u AS node, w FROM {g} UNION ALL SELECT graph_id, v, w FROM {g}), strength AS (SELECT n.graph_id, n.node, count(w) AS degree, coalesce(sum(w), 0.0) AS strength FROM nodes n LEFT JOIN both_ways USING (graph_id, node) GROUP BY ALL)"
HUBS = f"""{TRADE}, {STRENGTH.format(g='trade')}, scored AS (SELECT graph_id, node, round(strength, 2) AS score FROM strength),
hub AS (SELECT *, score >= quantile_cont(score, 0.85) OVER (PARTITION BY graph_id) AS is_top FROM scored),
vote AS (SELECT node, CAST(sum(CAST(is_top AS INT)) AS BIGINT) AS votes FROM hub GROUP BY 1)"""
COMPONENTS = f"""{TRADE}, {strongest(0.05)}, {closure('SELECT graph_id, u, v, 1 AS c FROM kept UNION ALL SELECT graph_id, v, u, 1 FROM kept UNION ALL SELECT graph_id, node, node, 1 FROM nodes', 'graph_id')},
labels AS (SELECT graph_id, u AS node, min(v) AS component FROM b5 GROUP BY ALL), sized AS (SELECT graph_id, component, count(*) AS size FROM labels GROUP BY ALL)"""
SWEEP = f"""{TRADE}, own AS (SELECT * FROM nodes WHERE graph_id = 'trade_1995'), one AS (SELECT * FROM trade WHERE graph_id = 'trade_1995'),
{closure('SELECT graph_id, u, v, w AS c FROM one UNION ALL SELECT graph_id, v, u, w FROM one UNION ALL SELECT graph_id, node, node, 1e300 FROM own', 'graph_id')},
lim AS (SELECT least(0.0, min(w)) AS low, greatest(0.0, max(w)) AS high FROM one),
grid AS (SELECT CAST(i AS INT) AS i, low + i * (high - low) / 49 AS threshold FROM lim, range(50) t(i)),
swept AS (SELECT 'trade_1995' AS graph_id, i, threshold, max(size) AS gcc FROM (SELECT i, threshold, u, count(*) AS size FROM b5, grid WHERE c > threshold GROUP BY ALL) GROUP BY ALL)"""
VECTORS = "vec AS (SELECT CAST(vec_id AS INT) AS node, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
ATTACK_COUNTS = f"{NATIONS}, counted AS (SELECT label AS subject, CAST(count(*) AS DOUBLE) AS final_attacks FROM orders JOIN customer ON o_custkey = c_custkey JOIN nations ON c_nationkey = node GROUP BY 1)"

_HALF = "CASE WHEN x - floor(x) = 0.5 THEN 2 * round(x / 2) ELSE round(x) END"
_R = "round({0}, 6) AS {1}".format

_BFS = [f"{KEPT95}, e AS (SELECT u, v FROM kept UNION ALL SELECT v, u FROM kept), l0 AS (SELECT node AS s, node AS v, 0 AS d, 1.0::DOUBLE AS paths FROM own), a0 AS (SELECT * FROM l0)"]
for _i in range(1, 25):
    _BFS.append(f"l{_i} AS MATERIALIZED (SELECT l.s, e.v, {_i} AS d, sum(l.paths) AS paths FROM l{_i - 1} l JOIN e ON e.u = l.v WHERE NOT EXISTS (FROM a{_i - 1} a WHERE a.s = l.s AND a.v = e.v) GROUP BY ALL), a{_i} AS MATERIALIZED (FROM a{_i - 1} UNION ALL FROM l{_i})")
BFS = ", ".join(_BFS)

SQL: dict[str, str] = {
    "edge_build": f"WITH {TRADE} SELECT graph_id, u, v, {_R('w', 'w')} FROM trade",
    "edge_minmax_merge": f"WITH {PAIRS}, m AS (SELECT graph_id, least(u, v) AS a, greatest(u, v) AS b, max(w) AS w FROM sound WHERE u <> v GROUP BY ALL) SELECT graph_id, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v, {_R('w', 'w')} FROM m JOIN names x ON x.label = a JOIN names y ON y.label = b WHERE w > 0",
    "edge_unweighted": f"WITH {PAIRS}, m AS (SELECT DISTINCT graph_id, least(u, v) AS a, greatest(u, v) AS b FROM sound WHERE u <> v) SELECT graph_id, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v, 1.0::DOUBLE AS w FROM m JOIN names x ON x.label = a JOIN names y ON y.label = b",
    "node_index": f"WITH {PAIRS} SELECT 'users' AS graph_id, node, label FROM names",
    "self_loop_filter": f"WITH {PAIRS} SELECT u = v AS is_loop, count(*) AS n FROM sound GROUP BY 1",
    "degree_strength": f"WITH {TRADE}, {strongest(0.1)}, {STRENGTH.format(g='kept')} SELECT graph_id, node, degree, {_R('strength', 'strength')} FROM strength",
    "edge_density": f"WITH {TRADE} SELECT graph_id, CAST(25 AS BIGINT) AS n_nodes, count(u) AS n_edges, {_R('count(u) / 300.0::DOUBLE', 'density')} FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN trade USING (graph_id) GROUP BY 1",
    "induced_subgraph": f"WITH {TRADE}, inside AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey <> 0) SELECT graph_id, u, v, {_R('w', 'w')} FROM trade WHERE graph_id = 'trade_1995' AND u IN (SELECT node FROM inside) AND v IN (SELECT node FROM inside)",
    "dense_matrix": f"WITH {KEPT95}, e AS (SELECT u, v, w FROM kept UNION ALL SELECT v, u, w FROM kept) SELECT a.graph_id, a.node AS u, b.node AS v, {_R('coalesce(w, 0.0)', 'w')} FROM own a JOIN own b ON true LEFT JOIN e ON e.u = a.node AND e.v = b.node",
    "matrix_range": f"WITH {TRADE} SELECT graph_id, {_R('least(coalesce(min(w), 0.0), 0.0)', 'low')}, {_R('greatest(coalesce(max(w), 0.0), 0.0)', 'high')} FROM (SELECT DISTINCT graph_id FROM nodes) LEFT JOIN trade USING (graph_id) GROUP BY 1",
    "inverse_lengths": f"WITH {BRANDS} SELECT graph_id, u, v, {_R('1 / w', 'w')} FROM copurchase",
    "threshold_top_p": f"WITH {TRADE}, {strongest(0.05, name='k05')}, {strongest(0.1, name='k10')}, {strongest(0.2, name='k20')} SELECT p, graph_id, u, v, {_R('w', 'w')} FROM (SELECT 0.05::DOUBLE AS p, * FROM k05 UNION ALL SELECT 0.1::DOUBLE, * FROM k10 UNION ALL SELECT 0.2::DOUBLE, * FROM k20)",
    "threshold_ties": f"WITH {BRANDS}, {strongest(0.15, 'copurchase')} SELECT graph_id, u, v, {_R('w', 'w')} FROM kept",
    "threshold_half_even": f"WITH {TRADE}, n AS (SELECT graph_id, count(*) AS m FROM trade WHERE w <> 0 GROUP BY 1), t AS (SELECT 0.115::DOUBLE * 300 AS x) SELECT 'half_up' AS rule, graph_id, least(m, CAST(round(x) AS BIGINT)) AS n_keep FROM n, t UNION ALL SELECT 'half_even', graph_id, least(m, CAST({_HALF} AS BIGINT)) FROM n, t",
    "mean_graph_all": f"WITH {TRADE} SELECT 'mean' AS graph_id, u, v, {_R('sum(w) / (SELECT count(DISTINCT graph_id) FROM nodes)', 'w')} FROM trade GROUP BY u, v",
    "mean_graph_included": f"""WITH {TRADE}, sizes AS (SELECT graph_id, sum(w) AS x FROM trade GROUP BY 1), cut AS (SELECT quantile_cont(x, 0.75) + 0.01 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS c FROM sizes),
 inc AS (SELECT graph_id FROM sizes, cut WHERE NOT x > c), mean AS (SELECT 'mean' AS graph_id, u, v, sum(w) / (SELECT count(*) FROM inc) AS w FROM trade SEMI JOIN inc USING (graph_id) GROUP BY u, v), {strongest(0.05, 'mean')} SELECT graph_id, u, v, {_R('w', 'w')} FROM kept""",
    "outliers_iqr": f"WITH {ATTACK_COUNTS}, cut AS (SELECT quantile_cont(final_attacks, 0.75) + 0.1 * (quantile_cont(final_attacks, 0.75) - quantile_cont(final_attacks, 0.25)) AS c FROM counted) SELECT subject, final_attacks, final_attacks > c AS excluded FROM counted, cut",
    "outliers_zscore": f"WITH {ATTACK_COUNTS}, cut AS (SELECT avg(final_attacks) + 1.0 * stddev_pop(final_attacks) AS c FROM counted) SELECT subject, final_attacks, final_attacks > c AS excluded FROM counted, cut",
    "threshold_giant_sweep": f"WITH {SWEEP} SELECT graph_id, i, {_R('threshold', 'threshold')}, gcc FROM swept",
    "threshold_giant": f"WITH {SWEEP}, good AS (SELECT max(i) AS i FROM swept WHERE gcc >= 19), hit AS (SELECT s.* FROM swept s JOIN good USING (i)) SELECT h.graph_id, CAST(19 AS BIGINT) AS target, i, {_R('threshold', 'threshold')}, gcc, count(o.u) AS n_edges, {_R('count(o.u) / 300.0::DOUBLE', 'density')} FROM hit h LEFT JOIN one o ON o.w > threshold GROUP BY h.graph_id, i, threshold, gcc",
    "connected_components": f"WITH {COMPONENTS} SELECT graph_id, node, component FROM labels",
    "component_sizes": f"WITH {COMPONENTS} SELECT graph_id, component, size FROM sized",
    "second_component": f"WITH {COMPONENTS}, r AS (SELECT graph_id, size, row_number() OVER (PARTITION BY graph_id ORDER BY size DESC, component) AS r FROM sized) SELECT graph_id, max(size) AS first, coalesce(max(size) FILTER (r = 2), 0) AS second FROM r GROUP BY 1",
    "attack_positions": f"WITH {TRADE}, own AS (SELECT * FROM nodes WHERE graph_id = 'trade_1995'), {POSITIONS} SELECT graph_id, attack_id, node, pos FROM pos",
    "percolation_trace": f"WITH {TRACE} SELECT graph_id, attack_id, step, first, second FROM trace",
    "percolation_point": f"WITH {POINTS} SELECT graph_id, attack_id, pstep FROM points",
    "step_counts": f"WITH {PIP} SELECT graph_id, step, n FROM counts",
    "participation_matrix": f"WITH {PIP} SELECT graph_id, step, node, n, k, {_R('p', 'p')} FROM pip",
    "pip_hubs": f"""WITH {PIP}, isl AS (SELECT step, step - row_number() OVER (ORDER BY step) AS g FROM counts WHERE n > 0), blocks AS (SELECT min(step) AS first, count(*) AS n FROM isl GROUP BY g ORDER BY n DESC, first LIMIT 1),
 total AS (SELECT node, round(sum(p * (b.n - (step - first)) / b.n), 6) AS total FROM pip, blocks b WHERE step >= first AND step < first + b.n GROUP BY 1) SELECT node, label, total FROM total JOIN nations USING (node) ORDER BY total DESC, node LIMIT 10""",
    "wilson_hw": f"WITH {PIP} SELECT graph_id, step, node, {_R(wilson('k', 'n'), 'hw')} FROM pip",
    "hw95_hazen": f"WITH {PIP}, l AS (SELECT graph_id, list(hw ORDER BY hw) AS hws FROM (SELECT graph_id, {wilson('k', 'n')} AS hw FROM pip WHERE n > 0) GROUP BY 1) SELECT graph_id, {_R(hazen('hws', 0.95), 'hw95')} FROM l",
    "conv_history": f"WITH {HISTORY} SELECT graph_id, chunk, n_attacks, {_R('hw95', 'hw95')} FROM hist",
    "plateau_flags": f"WITH {PLATEAU} SELECT graph_id, chunk, {_R('win_mean', 'win_mean')}, {_R('win_range', 'win_range')}, {_R('win_slope', 'win_slope')}, is_plateau, run FROM runs",
    "plateau_stop": f"WITH {PLATEAU} SELECT graph_id, min(chunk) FILTER (run >= 2) AS stop_chunk, coalesce(min(n_attacks) FILTER (run >= 2), max(n_attacks)) AS final_attacks, min(chunk) FILTER (run >= 2) IS NOT NULL AS converged FROM runs GROUP BY 1",
    "final_attacks": f"WITH {HISTORY} SELECT graph_id, arg_max(n_attacks, chunk) AS final_attacks FROM hist GROUP BY 1",
    "convergence_summary": f"WITH {HISTORY} SELECT graph_id AS file, CAST(max(n_attacks) AS DOUBLE) AS final_attacks, {_R('arg_max(hw95, chunk)', 'final_hw95')}, CAST(NULL AS DOUBLE) AS elapsed_sec FROM hist GROUP BY 1",
    "crop_longest_any": f"WITH {cropped('any')} SELECT graph_id, step, node, {_R('p', 'p')}, place, n_steps FROM crop",
    "crop_longest_all": f"WITH {cropped('all')} SELECT graph_id, step, node, {_R('p', 'p')}, place, n_steps FROM crop",
    "weight_linear": f"WITH {cropped('all')} SELECT graph_id, step, node, {_R('p * (n_steps - place) / n_steps', 'value')} FROM crop",
    "weight_flatten_clip": f"WITH {cropped('any')} SELECT graph_id, step, node, {_R('greatest(0.0, (p - (place + 1.0::DOUBLE) / n_steps) * (n_steps - place) / n_steps)', 'value')} FROM crop",
    "tilt_exp": f"WITH {TILTED} SELECT graph_id, step, node, {_R('value', 'value')} FROM tilted",
    "tilt_peak_rank": f"WITH {TILTED}, t AS (SELECT graph_id, node, place, round(value, 6) AS value FROM tilted), p AS (SELECT graph_id, node, max(value) AS amp, arg_min(place, {{'a': -value, 'b': place}}) AS peak FROM t GROUP BY ALL) SELECT graph_id, node, amp, peak, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY amp DESC, peak, node) AS INT) AS rank FROM p",
    "downsample_grid": f"""WITH {TILTED}, n AS (SELECT graph_id, max(n_steps) AS s FROM tilted GROUP BY 1), gp AS (SELECT graph_id, CAST(g AS INT) AS grid_place, CAST(CASE WHEN least(s, 4) < 2 THEN 0 ELSE floor(g * (s - 1) / (least(s, 4) - 1.0::DOUBLE)) END AS INT) AS place FROM n, range(4) t(g) WHERE g < least(s, 4)),
 gn AS (SELECT CAST(g AS INT) AS grid_node, CAST(floor(g * 11 / 4.0::DOUBLE) AS INT) AS node FROM range(5) t(g)) SELECT graph_id, grid_place, grid_node, place, node, {_R('value', 'value')} FROM tilted JOIN gp USING (graph_id, place) JOIN gn USING (node)""",
    "nan_to_num_fill": f"WITH {ACTIVITY} SELECT graph_id, step, node, {_R('coalesce(p, 0.0)', 'p')} FROM activity",
    "simpson_auc": f"""WITH {cropped('all')}, o AS (SELECT *, n_steps - CASE WHEN n_steps % 2 = 0 THEN 1 ELSE 0 END AS odd FROM crop),
 w AS (SELECT *, CASE WHEN n_steps <= 1 THEN 0.0 WHEN n_steps = 2 THEN 0.5 ELSE CASE WHEN place >= odd THEN 0.0 WHEN place = 0 OR place = odd - 1 THEN 1.0 WHEN place % 2 = 1 THEN 4.0 ELSE 2.0 END / 3.0::DOUBLE
 + CASE WHEN n_steps % 2 = 1 THEN 0.0 WHEN place = n_steps - 1 THEN 5.0 WHEN place = n_steps - 2 THEN 8.0 WHEN place = n_steps - 3 THEN -1.0 ELSE 0.0 END / 12.0::DOUBLE END AS wt FROM o) SELECT graph_id, node, {_R('sum(coalesce(p, 0.0) * wt)', 'area')} FROM w GROUP BY ALL""",
    "mean_node_pctl": f"WITH {cropped('all')}, m AS (SELECT graph_id, node, round(sum(coalesce(p, 0.0)) / count(DISTINCT step), 6) AS mean FROM crop GROUP BY ALL), c AS (SELECT *, quantile_cont(mean, 0.75) OVER (PARTITION BY graph_id) AS cut FROM m) SELECT graph_id, node, mean, {_R('cut', 'cut')} FROM c WHERE mean >= cut",
    "silhouette_by_label": f"""WITH {VECTORS}, d AS (SELECT a.node, a.label, b.label AS other, count(*) AS n, sum(list_distance(a.x, b.x)) AS s FROM vec a, vec b GROUP BY ALL),
 ab AS (SELECT node, max(CASE WHEN other = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY ALL) SELECT 'embeddings' AS graph_id, {_R('avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END)', 'silhouette')} FROM ab""",
    "cluster_stats": f"WITH {VECTORS}, s AS (SELECT label, count(*) AS size, avg(x[1]) AS mean, stddev_pop(x[1]) AS sd FROM vec GROUP BY 1), b AS (SELECT mean AS m0, sd AS s0 FROM s ORDER BY mean, label LIMIT 1) SELECT 'embeddings' AS graph_id, label, size, {_R('mean', 'mean')}, {_R('sd', 'sd')}, {_R('CASE WHEN s0 > 0 THEN (mean - m0) / s0 ELSE mean - m0 END', 'z')} FROM s, b",
    "critical_cluster_argmax": f"WITH {VECTORS}, t AS (SELECT label FROM vec GROUP BY 1 ORDER BY avg(x[1]) DESC, label LIMIT 1) SELECT 'embeddings' AS graph_id, node, v.label, v.label = t.label AS is_critical FROM vec v, t",
    "top15_binary": f"WITH {HUBS} SELECT graph_id, node, score, is_top FROM hub",
    "consensus_votes_all": f"WITH {HUBS} SELECT node, votes, {_R('votes / CAST((SELECT count(DISTINCT graph_id) FROM hub) AS DOUBLE)', 'score')} FROM vote",
    "consensus_votes_valid": f"WITH {HUBS} SELECT node, votes, {_R('votes / CAST((SELECT count(DISTINCT graph_id) FROM hub WHERE is_top) AS DOUBLE)', 'score')} FROM vote",
    "consensus_thresholds": f"WITH {HUBS}, s AS (SELECT node, votes / CAST((SELECT count(DISTINCT graph_id) FROM hub WHERE is_top) AS DOUBLE) AS score FROM vote) SELECT t AS threshold, node, {_R('score', 'score')} FROM s, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS t) WHERE score >= t",
    "jaccard_table": f"WITH {HUBS}, j AS (SELECT b.graph_id AS name, sum(CAST(a.is_top AND b.is_top AS INT)) AS i, sum(CAST(a.is_top OR b.is_top AS INT)) AS n FROM hub b JOIN hub a ON a.node = b.node AND a.graph_id = 'trade_1995' GROUP BY 1) SELECT name, CAST(i AS BIGINT) AS n_both, CAST(n AS BIGINT) AS n_any, {_R('CASE WHEN n > 0 THEN i / CAST(n AS DOUBLE) ELSE 0.0 END', 'jaccard')} FROM j",
    "zscore_metric": f"WITH {TRADE}, {STRENGTH.format(g='trade')} SELECT graph_id, node, {_R('(strength - avg(strength) OVER w) / nullif(stddev_pop(strength) OVER w, 0)', 'z')} FROM strength WINDOW w AS (PARTITION BY graph_id)",
    "pagerank": f"""WITH RECURSIVE {TRADE}, {strongest(0.1)}, {STRENGTH.format(g='kept')}, flow AS (SELECT e.graph_id, e.u, e.v, e.w / s.strength AS share FROM (SELECT graph_id, u, v, w FROM kept UNION ALL SELECT graph_id, v, u, w FROM kept) e JOIN strength s ON s.graph_id = e.graph_id AND s.node = e.u),
 r AS (SELECT 0 AS i, graph_id, node, 0.15::DOUBLE / 25 AS value FROM nodes UNION ALL (SELECT any_value(p.i) + 1, n.graph_id, n.node, 0.15::DOUBLE / 25 + 0.85::DOUBLE * coalesce(sum(p2.value * f.share), 0) FROM nodes n JOIN r p ON p.graph_id = n.graph_id AND p.node = n.node LEFT JOIN flow f ON f.graph_id = n.graph_id AND f.v = n.node LEFT JOIN r p2 ON p2.graph_id = f.graph_id AND p2.node = f.u WHERE p.i < 150 GROUP BY n.graph_id, n.node))
 SELECT graph_id, node, {_R('value / sum(value) OVER (PARTITION BY graph_id)', 'value')} FROM r WHERE i = 150""",
    "betweenness_binary": f"""WITH {BFS} SELECT 'trade_1995' AS graph_id, o.node, {_R('coalesce(sum(x.paths * y.paths / z.paths), 0.0)', 'value')} FROM own o LEFT JOIN (a24 x JOIN a24 y ON x.v = y.s AND x.s <> x.v AND y.v <> y.s JOIN a24 z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d) ON x.v = o.node GROUP BY o.node""",
    "label_lookup_left": f"WITH {NATIONS} SELECT CAST(i AS INT) AS index_0based, CAST(i + 1 AS INT) AS index_1based, coalesce(label, '') AS label FROM (SELECT DISTINCT s_suppkey % 40 AS i FROM supplier) LEFT JOIN nations ON node = i",
    "subject_intersect": "SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996",
    "top_nodes_text": f"WITH {HUBS} SELECT graph_id, 'Top cluster node indices: ' || string_agg(CAST(node AS VARCHAR), ', ' ORDER BY node) AS line FROM hub WHERE is_top GROUP BY 1",
    "binary_edges": f"WITH {BRANDS} SELECT graph_id, u, v, CAST(w > (SELECT avg(w) FROM copurchase) AS DOUBLE) AS w FROM copurchase",
    "heatmap_panels": f"WITH {TRADE}, {strongest(0.05)}, e AS (SELECT graph_id, u, v, w FROM kept UNION ALL SELECT graph_id, v, u, w FROM kept), g AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS i FROM (SELECT DISTINCT graph_id FROM nodes)) SELECT a.graph_id, a.node AS u, b.node AS v, {_R('coalesce(w, 0.0)', 'w')}, CAST(i // 4 AS INT) AS row, CAST(i % 4 AS INT) AS col FROM nodes a JOIN nodes b USING (graph_id) JOIN g USING (graph_id) LEFT JOIN e ON e.graph_id = a.graph_id AND e.u = a.node AND e.v = b.node",
}

#: Tables that were written and read back answer as if they had not been.
SQL |= {
    "stored_edge_list": SQL["edge_minmax_merge"],
    "stored_matrices": SQL["participation_matrix"],
    "stored_bundle": f"WITH {TRADE}, {STRENGTH.format(g='trade')} SELECT graph_id, node, degree, {_R('strength', 'strength')} FROM strength",
    "stored_outliers": f"SELECT subject || '_broadband_psi_adj.mat' AS file FROM ({SQL['outliers_iqr']}) WHERE NOT excluded",
    "stored_consensus": f"SELECT node, score FROM ({SQL['consensus_votes_valid']})",
    "stored_top_nodes": f"WITH {HUBS} SELECT node AS index_0based, CAST(node + 1 AS INT) AS index_1based, label FROM (SELECT DISTINCT node FROM hub WHERE is_top) JOIN nations USING (node)",
    "stored_labels": "SELECT CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS node, n_name AS label FROM nation",
    "stored_coordinates": "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS node, CAST(s_suppkey AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y, 0.0::DOUBLE AS z FROM supplier",
    "stored_files": "SELECT 'y' || y || '_trade' AS graph, 'y' || y AS prefix FROM (SELECT unnest([1994, 1995, 1996]) AS y)",
}
