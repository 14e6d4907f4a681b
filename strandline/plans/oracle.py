"""The catalogue's queries in DuckDB SQL, written from the definitions: brute force, recursive folds, explicit bins."""

from __future__ import annotations

from strandline.plans.fixtures import duck

_PI = "3.141592653589793e0"
_PRIORITY = "(({p}point_id % 2147483647) * 48271 + 42) % 2147483647"


def _with(*names: str, more: str = "", recursive: bool = False) -> str:
    views = ", ".join(f"{n.lower()} AS ({duck(n)})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' + more if more else ''} "


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 AS {n.split('.')[-1]}" for n in names)


def _mod(x: str) -> str:
    return f"(({x}) - {_PI} * floor(({x}) / {_PI}))"


_SLICES = """e AS (SELECT min(z) AS a, max(z) AS b, CAST(greatest(1, ceil((max(z) - min(z)) / 0.2e0)) AS INT) AS n FROM points WHERE class = 1),
b0 AS (SELECT CAST(i AS INT) AS slice_id, n, a, b, a + (i + 0.5e0) * 0.2e0 AS c FROM e, unnest(generate_series(0, n - 1)) AS t(i)),
b1 AS (SELECT *, CASE WHEN slice_id = 0 THEN a ELSE c - 0.1e0 END AS zmin, CASE WHEN slice_id = n - 1 THEN b ELSE c + 0.1e0 END AS zmax FROM b0),
slices AS (SELECT slice_id, CASE WHEN slice_id = n - 1 THEN (zmin + zmax) * 0.5e0 ELSE c END AS z_center, zmin, zmax FROM b1),
members AS (SELECT p.*, s.slice_id FROM points p JOIN slices s ON p.z BETWEEN s.zmin AND s.zmax WHERE p.class = 1)"""

_EXTENTS = """x0 AS (SELECT slice_id, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM members GROUP BY slice_id),
x1 AS (SELECT slice_id, x_min, CASE WHEN x_max <= x_min THEN x_min + 0.5e0 ELSE x_max END AS x_max, y_min, CASE WHEN y_max <= y_min THEN y_min + 0.5e0 ELSE y_max END AS y_max FROM x0),
extents AS (SELECT *, CAST(greatest(1, ceil((x_max - x_min) / 0.5e0)) AS INT) AS nx, CAST(greatest(1, ceil((y_max - y_min) / 0.5e0)) AS INT) AS ny FROM x1)"""


def _features(view: str) -> str:
    return f"""o AS (SELECT (sum(x0) + sum(x1)) / (2 * count(*)) AS ox, (sum(y0) + sum(y1)) / (2 * count(*)) AS oy FROM {view}),
t AS (SELECT s.*, {_mod(_mod("atan2(y1 - y0, x1 - x0)") + f" + {_PI} / 2")} AS theta, ox, oy FROM {view} s, o),
f AS (SELECT *, ((x0 - ox) + (x1 - ox)) * 0.5e0 * cos(theta) + ((y0 - oy) + (y1 - oy)) * 0.5e0 * sin(theta) AS rho, cos(theta * 2) AS c2, sin(theta * 2) AS s2 FROM t)"""


_PAIRS = "pairs AS (SELECT p.seg_id AS a, q.seg_id AS b FROM f p JOIN f q ON (p.c2 - q.c2) * (p.c2 - q.c2) + (p.s2 - q.s2) * (p.s2 - q.s2) + (p.rho - q.rho) * (p.rho - q.rho) <= 0.45e0 * 0.45e0)"
_STRICT = f"""pairs AS (SELECT p.seg_id AS a, q.seg_id AS b FROM f p JOIN f q
  ON greatest(2 * sin(least(abs(p.theta - q.theta), {_PI} - abs(p.theta - q.theta))), abs(p.rho - q.rho) / (0.3e0 / (2 * sin(radians(10e0))))) <= 2 * sin(radians(10e0)))"""


def _clusters(least: int) -> str:
    return f"""core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {least}),
links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS label FROM core UNION SELECT l.b, r.label FROM reach r JOIN links l ON l.a = r.node),
named AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
found AS (SELECT p.a AS seg_id, min(n.label) AS cluster_id FROM pairs p JOIN named n ON p.b = n.node GROUP BY p.a)"""


_LEN = "sqrt(({p}x1 - {p}x0) * ({p}x1 - {p}x0) + ({p}y1 - {p}y0) * ({p}y1 - {p}y0))"
_LEN3 = "sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0))"


def _at(px: str, py: str, s: str) -> str:
    """Place of a point along segment ``s`` in the plane."""
    dx, dy = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)"
    return f"((({px} - {s}.x0) * {dx} + ({py} - {s}.y0) * {dy}) / ({dx} * {dx} + {dy} * {dy}))"


def _at3(p: str, i: int, s: str) -> str:
    d = [f"({s}.{a}1 - {s}.{a}0)" for a in "xyz"]
    return "((" + " + ".join(f"({p}.{a}{i} - {s}.{a}0) * {d[k]}" for k, a in enumerate("xyz")) + ") / (" + " + ".join(f"{x} * {x}" for x in d) + "))"


def _line(px: str, py: str, s: str) -> str:
    dx, dy = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)"
    return f"(abs({dx} * ({py} - {s}.y0) - {dy} * ({px} - {s}.x0)) / sqrt({dx} * {dx} + {dy} * {dy}))"


def _overlap(base: str, other: str) -> str:
    a, b = _at(f"{other}.x0", f"{other}.y0", base), _at(f"{other}.x1", f"{other}.y1", base)
    return f"(greatest(0e0, least(1e0, greatest({a}, {b})) - greatest(0e0, least({a}, {b}))))"


def _far(i: int, j: int) -> str:
    return f"sqrt((g.x{i} - d.x{j}) * (g.x{i} - d.x{j}) + (g.y{i} - d.y{j}) * (g.y{i} - d.y{j}))"


def _clamped(t: str) -> str:
    return f"greatest(0e0, least(1e0, {t}))"


def _dz(i: int) -> str:
    return f"abs(d.z{i} - g.z0 - {_at3('d', i, 'g')} * (g.z1 - g.z0))"


_LG, _LD = _LEN.format(p="g."), _LEN.format(p="d.")
_MATCH = f"""m AS (SELECT g.id AS gt_id, d.id AS det_id,
  least(greatest({_far(0, 0)}, {_far(1, 1)}), greatest({_far(0, 1)}, {_far(1, 0)})) <= 0.5e0 AS correct,
  least({_clamped(_at3("d", 0, "g"))}, {_clamped(_at3("d", 1, "g"))}) AS t_start, greatest({_clamped(_at3("d", 0, "g"))}, {_clamped(_at3("d", 1, "g"))}) AS t_end,
  {_line("d.x0", "d.y0", "g")} AS xy0, {_line("d.x1", "d.y1", "g")} AS xy1, {_dz(0)} AS dz0, {_dz(1)} AS dz1
  FROM gt g JOIN det d ON (CASE WHEN {_LD} <= {_LG} THEN {_overlap("d", "g")} ELSE {_overlap("g", "d")} END) >= 0.5e0
    AND {_line("g.x0", "g.y0", "d")} <= 0.5e0 AND {_line("g.x1", "g.y1", "d")} <= 0.5e0),
samples AS (SELECT gt_id, det_id, 0 AS tip, xy0 AS xy, dz0 AS z FROM m UNION ALL SELECT gt_id, det_id, 1, xy1, dz1 FROM m),
labels AS (SELECT g.id, CASE max(CASE WHEN m.correct THEN 2 WHEN m.gt_id IS NOT NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'correct' WHEN 1 THEN 'partial' ELSE 'missed' END AS label FROM gt g LEFT JOIN m ON m.gt_id = g.id GROUP BY g.id),
marks AS (SELECT DISTINCT gt_id, t FROM (SELECT gt_id, t_start AS t FROM m UNION ALL SELECT gt_id, t_end FROM m)),
pieces AS (SELECT gt_id, t, lead(t) OVER (PARTITION BY gt_id ORDER BY t) AS u FROM marks),
cover AS (SELECT gt_id, sum(u - t) AS share FROM pieces p WHERE u IS NOT NULL AND EXISTS (SELECT 1 FROM m WHERE m.gt_id = p.gt_id AND m.t_start <= p.t AND m.t_end >= p.u) GROUP BY gt_id),
covered AS (SELECT g.*, coalesce(c.share, 0e0) * {_LEN3.replace("(x", "(g.x").replace("- x", "- g.x").replace("(y", "(g.y").replace("- y", "- g.y").replace("(z", "(g.z").replace("- z", "- g.z")} AS covered, {_LEN3} AS length FROM gt g LEFT JOIN cover c ON c.gt_id = g.id),
falses AS (SELECT d.id, {_LEN3} AS length FROM det d WHERE d.id NOT IN (SELECT det_id FROM m)),
report AS (SELECT (SELECT count(*) FROM gt) AS n_gt, (SELECT count(*) FROM det) AS n_det,
  (SELECT count(*) FROM labels WHERE label = 'correct') AS correct, (SELECT count(*) FROM labels WHERE label = 'partial') AS partial, (SELECT count(*) FROM labels WHERE label = 'missed') AS missed,
  (SELECT count(*) FROM det) - (SELECT count(DISTINCT det_id) FROM m) AS false_positives,
  (SELECT sum(covered) FROM covered) AS coverage, (SELECT sum(length) FROM covered) AS total_length,
  (SELECT coalesce(sum(length), 0e0) FROM falses) AS false_positive_length,
  (SELECT coalesce(sum(length), 0e0) FROM covered WHERE id IN (SELECT id FROM labels WHERE label = 'missed')) AS missed_length,
  (SELECT coalesce(avg(xy), 0e0) FROM samples) AS xy_avg, (SELECT median(xy) FROM samples) AS xy_median, (SELECT coalesce(avg(z), 0e0) FROM samples) AS z_avg, (SELECT median(z) FROM samples) AS z_median)"""

_COMP = """pairs AS (SELECT g.id AS gt_id, d.id AS det_id, sqrt((g.cx - d.cx) * (g.cx - d.cx) + (g.cy - d.cy) * (g.cy - d.cy)) AS xy, abs(d.cz - g.cz) AS z FROM gt_comp g CROSS JOIN det_comp d),
m AS (SELECT * FROM pairs WHERE xy <= 0.5e0),
report AS (SELECT (SELECT count(*) FROM gt_comp) AS n_gt, (SELECT count(*) FROM det_comp) AS n_det, count(DISTINCT gt_id) AS found, (SELECT count(*) FROM gt_comp) - count(DISTINCT gt_id) AS missed, (SELECT count(*) FROM det_comp) - count(DISTINCT det_id) AS false_positives,
  coalesce(avg(xy), 0e0) AS xy_avg, median(xy) AS xy_median, coalesce(avg(z), 0e0) AS z_avg, median(z) AS z_median FROM m)"""

_SAMPLES = f"""seg AS (SELECT id AS seg_id, *, CAST(greatest(3, ceil({_LEN3} * 2e0)) AS INT) AS n, {_LEN.format(p="")} AS l FROM gt),
samples AS (SELECT seg_id, CAST(k AS INT) AS k, x0 + (k / CAST(n - 1 AS DOUBLE)) * (x1 - x0) AS sx, y0 + (k / CAST(n - 1 AS DOUBLE)) * (y1 - y0) AS sy, z0 + (k / CAST(n - 1 AS DOUBLE)) * (z1 - z0) AS sz,
  (x1 - x0) / l AS tx, (y1 - y0) / l AS ty, -((y1 - y0) / l) AS nx, (x1 - x0) / l AS ny FROM seg, unnest(generate_series(0, n - 1)) AS t(k))"""
_BOXES = """near AS (SELECT seg_id, k, point_id, x, y, z, (x - sx) * tx + (y - sy) * ty AS u, (x - sx) * nx + (y - sy) * ny AS v FROM samples JOIN points ON class = 1 AND x BETWEEN sx - 0.9e0 AND sx + 0.9e0 AND (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 0.8015609770940698e0 * 0.8015609770940698e0),
counted AS (SELECT seg_id, k, count(*) AS c, count(*) FILTER (abs(u) <= 0.05e0 AND abs(v) <= 0.8e0) AS b FROM near GROUP BY seg_id, k),
boxes AS (SELECT n.* FROM near n JOIN counted c USING (seg_id, k) WHERE c.c >= 4 AND c.b >= 4 AND abs(u) <= 0.05e0 AND abs(v) <= 0.8e0)"""


def _top(view: str, keys: str) -> str:
    """Explicit bins, empty ones included."""
    on = " AND ".join(f"g.{k} = c.{k}" for k in keys.split(", "))
    mine = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""g AS (SELECT {keys}, min(z) AS low, max(z) AS high, avg(z) AS mean, CAST(greatest(1, ceil((max(z) - min(z)) / 0.01e0)) AS INT) AS bins FROM {view} GROUP BY {keys}),
placed AS (SELECT {mine}, CASE WHEN g.bins = 1 THEN 0 ELSE CAST(least(floor((c.z - g.low) / ((g.high - g.low) / g.bins)), g.bins - 1) AS INT) END AS bin FROM {view} c JOIN g ON {on}),
filled AS (SELECT {keys}, bin, count(*) AS n FROM placed GROUP BY {keys}, bin),
allbins AS (SELECT {keys}, low, high, bins, mean, CAST(b AS INT) AS bin FROM g, unnest(generate_series(0, bins - 1)) AS t(b)),
hist AS (SELECT c.*, coalesce(g.n, 0) AS n FROM allbins c LEFT JOIN filled g ON {on} AND g.bin = c.bin),
mid AS (SELECT {keys}, median(n) / 2 AS threshold FROM hist GROUP BY {keys}),
best AS (SELECT {", ".join(f"c.{k}" for k in keys.split(", "))}, max(c.bin) AS best FROM hist c JOIN mid g ON {on} WHERE c.n >= g.threshold GROUP BY {", ".join(f"c.{k}" for k in keys.split(", "))}),
top AS (SELECT {mine}, CASE WHEN g.bins = 1 THEN g.mean ELSE g.low + (c.best + 0.5e0) * ((g.high - g.low) / g.bins) END AS top_z FROM g JOIN best c ON {on})"""


_BUCKETS = """fold AS (
  SELECT chain_id, seq, z, 0 AS n, 0e0 AS total, 0 AS bucket, false AS cut FROM chain WHERE seq = 0
  UNION ALL
  SELECT c.chain_id, c.seq, c.z,
    CASE WHEN f.n > 0 AND abs(f.z - c.z - f.total / f.n) > tan(radians(15e0)) / 2 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n > 0 AND abs(f.z - c.z - f.total / f.n) > tan(radians(15e0)) / 2 THEN f.z - c.z ELSE f.total + (f.z - c.z) END,
    CASE WHEN f.n > 0 AND abs(f.z - c.z - f.total / f.n) > tan(radians(15e0)) / 2 THEN f.bucket + 1 ELSE f.bucket END,
    f.n > 0 AND abs(f.z - c.z - f.total / f.n) > tan(radians(15e0)) / 2
  FROM fold f JOIN chain c ON c.chain_id = f.chain_id AND c.seq = f.seq + 1),
members AS (SELECT chain_id, bucket, seq, z FROM fold UNION ALL SELECT f.chain_id, f.bucket, p.seq, p.z FROM fold f JOIN chain p ON f.cut AND p.chain_id = f.chain_id AND p.seq = f.seq - 1),
stepped AS (SELECT *, degrees(abs(atan((z - lag(z) OVER (PARTITION BY chain_id, bucket ORDER BY seq)) * 2))) AS angle FROM members),
buckets AS (SELECT chain_id, bucket, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, avg(angle) AS mean_angle FROM stepped GROUP BY chain_id, bucket)"""

#: Level buckets joined to parts, and the robust line of each.
_PARTS = """good AS (SELECT chain_id, bucket, m.seq, c.x, c.y, c.z FROM members m JOIN (SELECT chain_id, bucket FROM buckets WHERE n >= 3 AND mean_angle < 15) USING (chain_id, bucket) JOIN chain c USING (chain_id, seq)),
tips AS (SELECT chain_id, bucket, row_number() OVER (PARTITION BY chain_id ORDER BY bucket) AS k, arg_min({'x': x, 'y': y, 'z': z}, seq) AS a, arg_max({'x': x, 'y': y, 'z': z}, seq) AS b, sum(z) AS total, count(*) AS n FROM good GROUP BY chain_id, bucket),
joined AS (
  SELECT chain_id, bucket, k, b, total, n, 0 AS part FROM tips WHERE k = 1
  UNION ALL
  SELECT chain_id, bucket, k, b, CASE WHEN same THEN total + t ELSE t END, CASE WHEN same THEN n + m ELSE m END, CASE WHEN same THEN part ELSE part + 1 END
  FROM (SELECT t.chain_id, t.bucket, t.k, t.b, t.total AS t, t.n AS m, j.total, j.n, j.part,
      sqrt((j.b.x - t.a.x) * (j.b.x - t.a.x) + (j.b.y - t.a.y) * (j.b.y - t.a.y) + (j.b.z - t.a.z) * (j.b.z - t.a.z)) < 3 AND abs(j.total / j.n - t.total / t.n) < 0.1e0 AS same
    FROM joined j JOIN tips t ON t.chain_id = j.chain_id AND t.k = j.k + 1)),
c AS (SELECT chain_id, part, row_number() OVER (PARTITION BY chain_id, part ORDER BY bucket, seq) AS idx, x, y, z FROM good JOIN (SELECT chain_id, bucket, part FROM joined) USING (chain_id, bucket)),
l AS (SELECT p.chain_id, p.part, p.idx AS i, q.idx AS j, p.x AS ix, p.y AS iy, q.x AS jx, q.y AS jy, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS size FROM c p JOIN c q ON p.chain_id = q.chain_id AND p.part = q.part AND p.idx < q.idx),
d AS (SELECT l.chain_id, l.part, i, j, x, y, abs((jx - ix) * (y - iy) - (jy - iy) * (x - ix)) / size AS d FROM l JOIN c ON c.chain_id = l.chain_id AND c.part = l.part WHERE size > 0),
s AS (SELECT chain_id, part, i, j, count(*) AS inliers, round(sum(d * d), 9) AS residual, avg(x) AS ox, avg(y) AS oy, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS turn FROM d WHERE d < 0.05e0 GROUP BY chain_id, part, i, j),
fitted AS (SELECT chain_id, part, ox, oy, cos(turn) AS dx, sin(turn) AS dy FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, part ORDER BY inliers DESC, residual, i, j) AS place FROM s) WHERE place = 1),
feet AS (SELECT chain_id, part, idx = 1 AS head, z, ox + ((x - ox) * dx + (y - oy) * dy) * dx AS fx, oy + ((x - ox) * dx + (y - oy) * dy) * dy AS fy
  FROM c JOIN fitted USING (chain_id, part) WHERE idx = 1 OR idx = (SELECT max(idx) FROM c e WHERE e.chain_id = c.chain_id AND e.part = c.part))"""


def _thinned(code: int, axes: str) -> str:
    """The greedy choice in rounds: a point stays when all better neighbours went, and goes when one of them stays."""
    d2 = " + ".join(f"(q.{a} - p.{a}) * (q.{a} - p.{a})" for a in axes)
    return f"""p AS (SELECT point_id, x, y, z, {_PRIORITY.format(p='')} AS rank FROM points WHERE class = {code}),
close AS (SELECT p.point_id AS worse, q.point_id AS better FROM p JOIN p q ON q.x BETWEEN p.x - 0.021e0 AND p.x + 0.021e0 AND q.y BETWEEN p.y - 0.021e0 AND p.y + 0.021e0 AND (q.rank, q.point_id) < (p.rank, p.point_id) AND {d2} < 0.02e0 * 0.02e0),
turns AS (
  SELECT 0 AS turn, point_id, CAST(NULL AS BOOLEAN) AS stays FROM p
  UNION ALL
  SELECT t.turn + 1, t.point_id, CASE WHEN t.stays IS NOT NULL THEN t.stays WHEN n.kept THEN false WHEN n.waits THEN NULL ELSE true END
  FROM turns t LEFT JOIN (SELECT worse, bool_or(coalesce(b.stays, false)) AS kept, bool_or(b.stays IS NULL) AS waits FROM close JOIN turns b ON better = b.point_id GROUP BY worse) n ON n.worse = t.point_id
  WHERE EXISTS (SELECT 1 FROM turns WHERE stays IS NULL))"""


_DIST = """sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0)))"""


def _plane(view: str, key: str, x: str, y: str) -> str:
    """Every place with every pipe: t and distance in the plane."""
    return f"""d0 AS (SELECT p.{key}, p.{x} AS px, p.{y} AS py, g.*, {_clamped(_at(f"p.{x}", f"p.{y}", "g"))} AS t FROM {view} p CROSS JOIN gt g),
d AS (SELECT *, {_DIST} AS distance FROM d0)"""


_MEANS = f"""ax AS (SELECT KEY, (sum(x0) + sum(x1)) / (2 * count(*)) AS mx, (sum(y0) + sum(y1)) / (2 * count(*)) AS my,
  avg(cos({_mod("atan2(y1 - y0, x1 - x0)")} * 2)) AS c, avg(sin({_mod("atan2(y1 - y0, x1 - x0)")} * 2)) AS s FROM VIEW GROUP BY KEY),
axis AS (SELECT KEY, mx, my, cos(atan2(s, c) * 0.5e0) AS ux, sin(atan2(s, c) * 0.5e0) AS uy FROM ax)"""


def _fold(view: str, keys: str, order: str, gap: str) -> str:
    """Intervals merged one by one."""
    on = " AND ".join(f"o.{k} = f.{k}" for k in keys.split(", "))
    mine = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""ordered AS (SELECT {keys}, lo, hi, z, row_number() OVER (PARTITION BY {keys} ORDER BY lo, {order}) AS i FROM {view}),
fold AS (
  SELECT {keys}, i, CAST(1 AS BIGINT) AS island, lo, hi, z, CAST(1 AS BIGINT) AS n FROM ordered WHERE i = 1
  UNION ALL
  SELECT {mine}, o.i,
    CASE WHEN f.hi >= o.hi OR f.hi + {gap} >= o.lo THEN f.island ELSE f.island + 1 END,
    CASE WHEN f.hi >= o.hi OR f.hi + {gap} >= o.lo THEN f.lo ELSE o.lo END,
    CASE WHEN f.hi >= o.hi THEN f.hi ELSE o.hi END,
    CASE WHEN f.hi >= o.hi THEN f.z WHEN f.hi + {gap} >= o.lo THEN (f.z + o.z) / 2 ELSE o.z END,
    CASE WHEN f.hi >= o.hi THEN f.n WHEN f.hi + {gap} >= o.lo THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN ordered o ON {on} AND o.i = f.i + 1),
islands AS (SELECT {keys}, island, arg_max(lo, i) AS lo, arg_max(hi, i) AS hi, arg_max(z, i) AS z, arg_max(n, i) AS n FROM fold GROUP BY {keys}, island)"""


def _segment_text(view: str, key: str, pattern: str = "%.6f") -> str:
    v = lambda i: f"printf('v {pattern} {pattern} {pattern}', x{i}, y{i}, z{i})"
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS n FROM {view}),
texts AS (SELECT 0 AS part, 0 AS n, 0 AS k, '# lines: ' || count(*) AS line FROM {view}
  UNION ALL SELECT 1, n, 0, {v(0)} FROM r UNION ALL SELECT 1, n, 1, {v(1)} FROM r UNION ALL SELECT 1, n, 2, 'l ' || (n * 2 + 1) || ' ' || (n * 2 + 2) FROM r)"""


_TEXT = "SELECT CAST(part AS INT) AS part, CAST(n AS INT) AS n, CAST(k AS INT) AS k, line FROM texts"
_FIT = "fit AS (SELECT id, cx - 0.25e0 AS min_x, cy - 0.25e0 AS min_y, cz - 0.25e0 AS min_z, cx + 0.25e0 AS max_x, cy + 0.25e0 AS max_y, cz + 0.25e0 AS max_z, cx, cy, cz FROM gt_comp)"


def _vectors() -> str:
    v = lambda x, y: f"printf('v %.6f %.6f %.6f', {x}, {y}, sz)"
    spots = ["'# sample ' || n", v("sx", "sy"), v("sx + tx * 0.05e0", "sy + ty * 0.05e0"), v("sx - tx * 0.05e0", "sy - ty * 0.05e0"), v("sx + nx * 0.8e0", "sy + ny * 0.8e0"), v("sx - nx * 0.8e0", "sy - ny * 0.8e0"), v("sx + 0.25e0", "sy - 0.25e0")]
    spots += [f"'l ' || (n * 6 + 1) || ' ' || (n * 6 + {2 + i})" for i in range(5)]
    rows = " UNION ALL ".join(f"SELECT 1, n, {k}, {t} FROM r" for k, t in enumerate(spots))
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY seg_id, k) - 1 AS n FROM samples),
texts AS (SELECT 0 AS part, 0 AS n, 0 AS k, '# tangent: 0.05' AS line UNION ALL SELECT 0, 0, 1, '# normal: 0.8' UNION ALL SELECT 0, 0, 2, '# samples: ' || count(*) FROM samples UNION ALL {rows})"""


def _boxes_text() -> str:
    v = lambda x, y, z: f"printf('v %.6f %.6f %.6f', {x}, {y}, {z})"
    low_high = [("min", "min"), ("max", "min"), ("max", "max"), ("min", "max")]
    spots = [v(f"{a}_x", f"{b}_y", f"{c}_z") for c in ("min", "max") for a, b in low_high] + [v("cx", "cy", "cz"), "'p ' || (n * 15 + 9)"]
    for axis in range(3):
        spots += [v(*(f"c{a} {sign} 0.01e0" if i == axis else f"c{a}" for i, a in enumerate("xyz"))) for sign in "-+"]
    ring = lambda base: [(base + i, base + (i + 1) % 4) for i in range(4)]
    joins = [(9, 10), (11, 12), (13, 14)] + ring(0) + ring(4) + [(i, i + 4) for i in range(4)]
    spots += [f"'l ' || (n * 15 + {a + 1}) || ' ' || (n * 15 + {b + 1})" for a, b in joins]
    rows = " UNION ALL ".join(f"SELECT 1 AS part, n, {k} AS k, {t} AS line FROM r" for k, t in enumerate(spots))
    return f"r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM fit), texts AS ({rows})"


_CLUSTER_TEXT = """c AS (SELECT *, CASE WHEN seg_id % 7 <> 0 THEN seg_id % 60 END AS cluster_id FROM few_fragments),
r AS (SELECT *, row_number() OVER (ORDER BY cluster_id, seg_id) - 1 AS n, dense_rank() OVER (ORDER BY cluster_id) - 1 AS cid, row_number() OVER (PARTITION BY cluster_id ORDER BY seg_id) = 1 AS head, count(*) OVER (PARTITION BY cluster_id) AS size FROM c WHERE cluster_id IS NOT NULL),
t AS (SELECT *, CASE WHEN head THEN 3 ELSE 0 END AS k0, printf('%03d', cid) AS name FROM r),
texts AS (SELECT 0 AS part, 0 AS n, 0 AS k, '# clusters: ' || count(DISTINCT cluster_id) AS line FROM r
  UNION ALL SELECT 1, n, 0, '# cluster ' || cid || ', segments: ' || size FROM t WHERE head UNION ALL SELECT 1, n, 1, 'o cluster_' || name FROM t WHERE head UNION ALL SELECT 1, n, 2, 'g cluster_' || name || '_lines' FROM t WHERE head
  UNION ALL SELECT 1, n, k0, printf('v %.9f %.9f %.9f', x0, y0, z0) FROM t UNION ALL SELECT 1, n, k0 + 1, printf('v %.9f %.9f %.9f', x1, y1, z1) FROM t UNION ALL SELECT 1, n, k0 + 2, 'l ' || (n * 2 + 1) || ' ' || (n * 2 + 2) FROM t)"""


def _stats(c: str) -> str:
    return f"""SELECT '{c}' AS part, n, {_r("mean", "q1", "median", "q3")}, round((SELECT min({c}) FROM samples WHERE {c} >= q1 - 1.5e0 * (q3 - q1)), 6) + 0e0 AS whisker_low, round((SELECT max({c}) FROM samples WHERE {c} <= q3 + 1.5e0 * (q3 - q1)), 6) + 0e0 AS whisker_high
  FROM (SELECT count(*) AS n, avg({c}) AS mean, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM samples)"""


def _shares(of: str, scale: str, names: list[str], view: str) -> str:
    total = " + ".join(names)
    return " UNION ALL ".join(f"SELECT '{of}' AS \"of\", '{scale}' AS scale, '{n}' AS label, round(CAST({n} AS DOUBLE), 6) + 0e0 AS value, round({n} / CAST({total} AS DOUBLE) * 100, 6) + 0e0 AS pct FROM {view}" for n in names)


_REPORT = "n_gt, n_det, correct, partial, missed, false_positives, " + _r("coverage", "total_length", "false_positive_length", "missed_length", "xy_avg", "xy_median", "z_avg", "z_median")
_PCT = "round(coverage / total_length * 100, 6) + 0e0 AS coverage_pct, round(coverage / (total_length + false_positive_length) * 100, 6) + 0e0 AS coverage_iou_pct"

SQL: dict[str, str] = {
    "las_class_split": _with("POINTS") + "SELECT class, count(*) AS n, " + ", ".join(f"round({f}({c}), 6) + 0e0 AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + " FROM points GROUP BY class",
    "z_slices": _with("POINTS", more=_SLICES) + f"SELECT slice_id, {_r('z_center', 'zmin', 'zmax')} FROM slices",
    "slice_membership": _with("POINTS", more=_SLICES) + "SELECT slice_id, count(*) AS n, round(avg(x), 6) + 0e0 AS avg_x FROM members GROUP BY slice_id",
    "slice_raster_counts": _with("POINTS", more=f"{_SLICES}, {_EXTENTS}")
    + 'SELECT slice_id, CAST(least(floor((y - y_min) / ((y_max - y_min) / ny)), ny - 1) AS INT) AS "row", CAST(least(floor((x - x_min) / ((x_max - x_min) / nx)), nx - 1) AS INT) AS col, count(*) AS n FROM members JOIN extents USING (slice_id) GROUP BY ALL',
    "raster_memory": _with("POINTS", more=f"{_SLICES}, {_EXTENTS}") + "SELECT slice_id, CAST(nx AS BIGINT) * ny AS cells, CAST(nx AS BIGINT) * ny * 25 AS bytes FROM extents",
    "pixel_to_world": "SELECT p_partkey, round(-3.25e0 + k * 0.5e0 + 0.25e0, 6) + 0e0 AS x FROM (SELECT p_partkey, greatest(0, least(round_even(((p_partkey * 7919) % 2003) / 8e0 - 5e0, 0), 199)) AS k FROM part)",
    "line_axial_features": _with("FRAGMENTS", more=_features("fragments")) + f"SELECT seg_id, {_r('theta', 'rho', 'c2', 's2')} FROM f",
    "axial_mean_direction": _with("FRAGMENTS", more=_MEANS.replace("KEY", "slice_id").replace("VIEW", "fragments")) + f"SELECT slice_id, {_r('mx', 'my', 'ux', 'uy')} FROM axis",
    "eps_neighbour_pairs": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_PAIRS}") + "SELECT a, b FROM pairs",
    "eps_core_points": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_PAIRS}") + "SELECT a AS seg_id, count(*) AS neighbours, count(*) >= 3 AS core FROM pairs GROUP BY a",
    "line_clusters_connected": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_PAIRS}, {_clusters(1)}", recursive=True) + "SELECT seg_id, cluster_id FROM found",
    "line_clusters_dbscan": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_PAIRS}, {_clusters(3)}", recursive=True) + "SELECT seg_id, cluster_id FROM few_fragments LEFT JOIN found USING (seg_id)",
    "line_clusters_noise_kept": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_PAIRS}, {_clusters(3)}", recursive=True) + "SELECT seg_id, coalesce(cluster_id, seg_id) AS cluster_id FROM few_fragments LEFT JOIN found USING (seg_id)",
    "strict_metric_pairs": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_STRICT}") + "SELECT a, b FROM pairs",
    "strict_metric_clusters": _with("FEW_FRAGMENTS", more=f"{_features('few_fragments')}, {_STRICT}, {_clusters(2)}", recursive=True) + "SELECT seg_id, cluster_id FROM few_fragments LEFT JOIN found USING (seg_id)",
    "z_gap_subclusters": _with("FRAGMENTS", more="c AS (SELECT *, seg_id % 3000 AS cluster_id, (z0 + z1) * 0.5e0 AS mean_z FROM fragments), j AS (SELECT *, coalesce(CAST(mean_z - lag(mean_z) OVER w > 0.15e0 AS INT), 0) AS jump FROM c WINDOW w AS (PARTITION BY cluster_id ORDER BY mean_z, seg_id))")
    + "SELECT seg_id, cluster_id, CAST(sum(jump) OVER (PARTITION BY cluster_id ORDER BY mean_z, seg_id) AS BIGINT) AS block FROM j",
    "merge_islands": _with("INTERVALS", more="v AS (SELECT *, row_id % 20 AS sub FROM intervals), " + _fold("v", "grp, sub", "row_id", "2e0"), recursive=True) + f"SELECT grp, sub, island, {_r('lo', 'hi', 'z')}, n FROM islands",
    "merge_islands_z": _with(
        "FRAGMENTS",
        more="c AS (SELECT *, seg_id % 500 AS cluster_id FROM fragments), "
        + _MEANS.replace("KEY", "cluster_id").replace("VIEW", "c")
        + ", pos AS (SELECT cluster_id, seg_id, (x0 - mx) * ux + (y0 - my) * uy AS a, (x1 - mx) * ux + (y1 - my) * uy AS b, (z0 + z1) * 0.5e0 AS z FROM c JOIN axis USING (cluster_id)), v AS (SELECT cluster_id, seg_id, least(a, b) AS lo, greatest(a, b) AS hi, z FROM pos), "
        + _fold("v", "cluster_id", "seg_id", "2e0"),
        recursive=True,
    )
    + f"SELECT cluster_id, island, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM (SELECT cluster_id, island, mx + lo * ux AS x0, my + lo * uy AS y0, z AS z0, mx + hi * ux AS x1, my + hi * uy AS y1, z AS z1 FROM islands JOIN axis USING (cluster_id) WHERE hi - lo >= 1.5e0)",
    "snap_samples": _with("GT", more=_SAMPLES) + f"SELECT seg_id, k, {_r('sx', 'sy', 'sz', 'tx', 'ty', 'nx', 'ny')} FROM samples",
    "ghost_segments": _with("POINTS", "FEW_FRAGMENTS")
    + "SELECT seg_id FROM few_fragments s WHERE NOT EXISTS (SELECT 1 FROM points p WHERE class = 1 AND p.x BETWEEN s.x0 - 0.8e0 AND s.x0 + 0.8e0 AND (p.x - s.x0) * (p.x - s.x0) + (p.y - s.y0) * (p.y - s.y0) <= 0.8e0 * 0.8e0) AND NOT EXISTS (SELECT 1 FROM points p WHERE class = 1 AND p.x BETWEEN s.x1 - 0.8e0 AND s.x1 + 0.8e0 AND (p.x - s.x1) * (p.x - s.x1) + (p.y - s.y1) * (p.y - s.y1) <= 0.8e0 * 0.8e0)",
    "sample_box_points": _with("GT", "POINTS", more=f"{_SAMPLES}, {_BOXES}") + f"SELECT seg_id, k, point_id, {_r('u', 'v')} FROM boxes",
    "sample_box_centroid": _with("GT", "POINTS", more=f"{_SAMPLES}, {_BOXES}, {_top('boxes', 'seg_id, k')}, means AS (SELECT seg_id, k, avg(x) AS cx, avg(y) AS cy, count(*) AS n_pts FROM boxes GROUP BY seg_id, k)")
    + f"SELECT seg_id, k, {_r('cx', 'cy')}, round(top_z, 6) + 0e0 AS z, n_pts FROM means JOIN top USING (seg_id, k)",
    "quantised_top_z": _with("POINTS", more=_top("points", "supplier")) + f"SELECT supplier, {_r('top_z')} FROM top",
    "delta_z_buckets": _with("CHAIN", more=_BUCKETS, recursive=True) + f"SELECT chain_id, bucket, n, first_seq, last_seq, {_r('mean_angle')} FROM buckets",
    "bucket_angle_filter": _with("CHAIN", more=_BUCKETS, recursive=True) + "SELECT chain_id, bucket, seq FROM members JOIN (SELECT chain_id, bucket FROM buckets WHERE n >= 3 AND mean_angle < 15) USING (chain_id, bucket)",
    "ransac_exhaustive_inliers": _with(
        "CHAIN",
        more="""c AS (SELECT *, CAST(floor(seq / 8) AS BIGINT) AS part FROM chain),
l AS (SELECT p.chain_id, p.part, p.seq AS i, q.seq AS j, p.x AS ix, p.y AS iy, q.x AS jx, q.y AS jy, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS size FROM c p JOIN c q ON p.chain_id = q.chain_id AND p.part = q.part AND p.seq < q.seq),
d AS (SELECT l.chain_id, l.part, i, j, x, y, abs((jx - ix) * (y - iy) - (jy - iy) * (x - ix)) / size AS d FROM l JOIN c ON c.chain_id = l.chain_id AND c.part = l.part),
s AS (SELECT chain_id, part, i, j, count(*) AS inliers, round(sum(d * d), 9) AS residual, avg(x) AS ox, avg(y) AS oy FROM d WHERE d < 0.05e0 GROUP BY chain_id, part, i, j)""",
    )
    + f"SELECT chain_id, part, i, j, inliers, {_r('residual', 'ox', 'oy')} FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, part ORDER BY inliers DESC, residual, i, j) AS place FROM s) WHERE place = 1",
    "project_endpoints_on_line": _with("FEW_FRAGMENTS", more="p AS (SELECT *, CAST(seg_id % 3 AS DOUBLE) AS dx, CAST(seg_id % 5 AS DOUBLE) AS dy FROM few_fragments), q AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN ((x0 - x1) * dx + (y0 - y1) * dy) / (dx * dx + dy * dy) ELSE 0e0 END AS t FROM p)")
    + "SELECT seg_id, round(x1 + t * dx, 6) + 0e0 AS px, round(y1 + t * dy, 6) + 0e0 AS py FROM q",
    "point_segment_min_distance": _with(
        "GT",
        "POINTS",
        more="""a AS (SELECT p.point_id, p.x AS px, p.y AS py, p.z AS pz, g.*, greatest(0e0, least(1e0, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0) + (p.z - z0) * (z1 - z0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) + (z1 - z0) * (z1 - z0)))) AS t FROM points p CROSS JOIN gt g WHERE class = 2)""",
    )
    + "SELECT point_id, round(min(sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0)) + (pz - z0 - t * (z1 - z0)) * (pz - z0 - t * (z1 - z0)))), 6) + 0e0 AS distance FROM a GROUP BY point_id",
    "near_pipe_points": _with("GT", "FRAGMENTS", more=_plane("fragments", "seg_id", "x0", "y0")) + "SELECT seg_id AS point_id FROM d GROUP BY seg_id HAVING min(distance) < 0.5e0",
    "nearest_pipe": _with("GT", "FEW_FRAGMENTS", more=_plane("few_fragments", "seg_id", "x0", "y0"))
    + f"SELECT seg_id, pipe_id, {_r('distance', 'pipe_z')} FROM (SELECT seg_id, id AS pipe_id, distance, z0 + t * (z1 - z0) AS pipe_z, row_number() OVER (PARTITION BY seg_id ORDER BY distance, id) AS place FROM d) WHERE place = 1",
    "component_boxes": _with(
        "GT",
        "POINTS",
        more="b AS (SELECT supplier AS comp_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z, avg(x) AS cx, avg(y) AS cy FROM points WHERE class = 2 GROUP BY supplier), "
        + _plane("b", "comp_id", "cx", "cy")
        + ", near AS (SELECT comp_id, z0 + t * (z1 - z0) AS cz, distance, row_number() OVER (PARTITION BY comp_id ORDER BY distance, id) AS place FROM d)",
    )
    + f"SELECT comp_id, {_r('min_x', 'min_y', 'min_z', 'max_x', 'max_y', 'max_z', 'cx', 'cy', 'cz')} FROM b JOIN near USING (comp_id) WHERE place = 1 AND distance <= 0.5e0",
    "thin_first_round": _with("POINTS", more=f"p AS (SELECT point_id, x, y, {_PRIORITY.format(p='')} AS rank FROM points WHERE class = 2)")
    + "SELECT point_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.point_id <> p.point_id AND (q.rank, q.point_id) < (p.rank, p.point_id) AND q.x BETWEEN p.x - 0.03e0 AND p.x + 0.03e0 AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < 0.02e0 * 0.02e0)",
    "thin_points": _with("POINTS", more=_thinned(2, "xy"), recursive=True) + "SELECT point_id FROM turns WHERE turn = (SELECT max(turn) FROM turns) AND stays",
    "source_thinning": _with("POINTS", more=_thinned(1, "xyz"), recursive=True) + "SELECT point_id FROM turns WHERE turn = (SELECT max(turn) FROM turns) AND stays",
    "chain_lines": _with("CHAIN", more=f"{_BUCKETS}, {_PARTS}", recursive=True)
    + f"SELECT a.chain_id, a.part, {', '.join(f'round({v}, 6) + 0e0 AS {n}' for v, n in (('a.fx', 'x0'), ('a.fy', 'y0'), ('a.z', 'z0'), ('b.fx', 'x1'), ('b.fy', 'y1'), ('b.z', 'z1')))} FROM feet a JOIN feet b ON a.chain_id = b.chain_id AND a.part = b.part AND a.head AND NOT b.head",
    "eval_pipe_labels": _with("GT", "DET", more=_MATCH) + "SELECT id, label FROM labels",
    "eval_pipe_counts": _with("GT", "DET", more=_MATCH) + "SELECT n_gt, n_det, correct, partial, missed, false_positives FROM report",
    "eval_pipe_samples": _with("GT", "DET", more=_MATCH) + f"SELECT gt_id, det_id, tip, {_r('xy', 'z')} FROM samples",
    "eval_pipe_coverage": _with("GT", "DET", more=_MATCH) + f"SELECT {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1', 'covered', 'length')} FROM covered",
    "eval_false_positives": _with("GT", "DET", more=_MATCH) + f"SELECT id, {_r('length')} FROM falses",
    "eval_missed": _with("GT", "DET", more=_MATCH) + "SELECT id FROM labels WHERE label = 'missed'",
    "eval_pipe_report": _with("GT", "DET", more=_MATCH) + f"SELECT {_REPORT}, {_PCT} FROM report",
    "eval_component_matches": _with("GT_COMP", "DET_COMP", more=_COMP) + f"SELECT gt_id, det_id, {_r('xy', 'z')} FROM m",
    "eval_component_report": _with("GT_COMP", "DET_COMP", more=_COMP)
    + f"SELECT n_gt, n_det, found, missed, false_positives, {_r('xy_avg', 'xy_median', 'z_avg', 'z_median')}, round(found / CAST(n_gt AS DOUBLE) * 100, 6) + 0e0 AS coverage_pct, round(found / CAST(n_gt + false_positives AS DOUBLE) * 100, 6) + 0e0 AS coverage_iou_pct FROM report",
    "distance_boxplot_stats": _with("GT", "DET", more=_MATCH) + f"{_stats('xy')} UNION ALL {_stats('z')}",
    "class_share_table": f"SELECT * FROM ({_with('GT', 'DET', more=_MATCH)}{_shares('pipes', 'count', ['correct', 'partial', 'missed', 'false_positives'], 'report')} UNION ALL {_shares('pipes', 'length', ['coverage', 'missed_length', 'false_positive_length'], 'report')}) UNION ALL SELECT * FROM ({_with('GT_COMP', 'DET_COMP', more=_COMP)}{_shares('components', 'count', ['found', 'missed', 'false_positives'], 'report')})",
    "geojson_features": "SELECT 'pipe_' || n AS id, 'LineString' AS kind, 'pipe' AS feature_type, 0 AS n_bbox, 25832 AS epsg FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) UNION ALL SELECT 'chain_' || n, 'LineString', 'snapped_chain', 0, 25832 FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n FROM supplier) UNION ALL SELECT 'comp_' || n, 'Point', 'component', 6, 25832 FROM (SELECT row_number() OVER () - 1 AS n FROM supplier, range(2))",
    "geojson_roundtrip": _with("GT") + f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS pos, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM gt",
    "geojson_edges": _with("GT") + f"SELECT 0 AS edge, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM gt",
    "geojson_components": _with("GT_COMP", more=_FIT) + f"SELECT {_r('min_x', 'min_y', 'min_z', 'max_x', 'max_y', 'max_z', 'cx', 'cy', 'cz')} FROM fit",
    "obj_lines": _with("GT", more=_segment_text("gt", "id")) + _TEXT,
    "obj_missed": _with("GT", "DET", more=f"{_MATCH}, lost AS (SELECT * FROM gt WHERE id IN (SELECT id FROM labels WHERE label = 'missed')), {_segment_text('lost', 'id')}") + _TEXT,
    "obj_points": _with("CHAIN", more="r AS (SELECT *, row_number() OVER (ORDER BY chain_id * 100 + seq) - 1 AS n FROM chain), texts AS (SELECT 0 AS part, 0 AS n, 0 AS k, '# points: ' || count(*) AS line FROM chain UNION ALL SELECT 1, n, 0, printf('v %.6f %.6f %.6f', x, y, z) FROM r)") + _TEXT,
    "obj_clusters": _with("FEW_FRAGMENTS", more=_CLUSTER_TEXT) + _TEXT,
    "obj_sample_vectors": _with("GT", more=f"{_SAMPLES}, {_vectors()}") + _TEXT,
    "obj_component_boxes": _with("GT_COMP", more=f"{_FIT}, {_boxes_text()}") + _TEXT,
    "label_mapping": "SELECT c_custkey, CAST((c_nationkey * 7) % 5 AS INT) AS label FROM customer",
    "segment_records": _with("GT") + f"SELECT CAST(row_number() OVER (ORDER BY id) AS INT) AS pipe_number, -1 AS individual_0, -1 AS individual_1, round({_LEN3}, 6) + 0e0 AS fitness, " + ", ".join(f"round({a}{i}, 6) + 0e0 AS p{i + 1}_{a}" for i in (0, 1) for a in "xyz") + " FROM gt",
    "segments_from_records": _with("GT") + f"SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS pipe_number, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM gt",
    "cluster_json_contents": _with("FEW_FRAGMENTS", more="c AS (SELECT *, seg_id % 9 AS cluster_id FROM few_fragments)")
    + f"SELECT slice_id, total_segments, total_clusters, cluster_id, segment_count, seg_id AS segment_index, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM c JOIN (SELECT slice_id, count(*) AS total_segments, count(DISTINCT cluster_id) AS total_clusters FROM c GROUP BY slice_id) USING (slice_id) JOIN (SELECT slice_id, cluster_id, count(*) AS segment_count FROM c GROUP BY slice_id, cluster_id) USING (slice_id, cluster_id)",
    "metrics_json_contents": _with("GT", "DET", more=_MATCH)
    + f"SELECT {_REPORT}, {_PCT}, (SELECT count(xy) FROM samples) AS n_xy, round((SELECT sum(xy) FROM samples), 6) + 0e0 AS sum_xy, (SELECT count(z) FROM samples) AS n_z, round((SELECT sum(z) FROM samples), 6) + 0e0 AS sum_z FROM report",
    "hough_votes": _with("POINTS", more=f"{_SLICES}, {_EXTENTS}, cells AS (SELECT DISTINCT slice_id, least(floor((y - y_min) / ((y_max - y_min) / ny)), ny - 1) AS r, least(floor((x - x_min) / ((x_max - x_min) / nx)), nx - 1) AS c FROM members JOIN extents USING (slice_id))")
    + f"SELECT slice_id, CAST(a AS INT) AS angle, CAST(round_even(c * cos(a * ({_PI} / 4) - {_PI} / 2) + r * sin(a * ({_PI} / 4) - {_PI} / 2), 0) AS INT) AS rho, count(*) AS votes FROM cells, unnest([0, 1, 2, 3]) AS t(a) GROUP BY ALL",
    "las_roundtrip": _with("POINTS") + "SELECT class, count(*) AS n, " + ", ".join(f"CAST(sum(CAST(round({c} * 10000) AS BIGINT)) AS BIGINT) AS sum_{c}" for c in "xyz") + " FROM points GROUP BY class",
    "snap_tiny": _with("GT", "POINTS") + f"SELECT id AS seg_id, 0 AS part, {', '.join(f'round({a}0, 6) + 0e0 AS {a}{i}' for i in (0, 1) for a in 'xyz')} FROM gt s WHERE EXISTS (SELECT 1 FROM points p WHERE class = 1 AND (p.x - s.x0) * (p.x - s.x0) + (p.y - s.y0) * (p.y - s.y0) <= 0.8e0 * 0.8e0)",
    "component_mask": _with("GT", "POINTS", more=_thinned(2, "xy") + ", two AS (SELECT * FROM points WHERE class = 2), " + _plane("two", "point_id", "x", "y"), recursive=True)
    + "SELECT point_id FROM turns WHERE turn = (SELECT max(turn) FROM turns) AND stays AND point_id IN (SELECT point_id FROM d GROUP BY point_id HAVING min(distance) < 0.5e0)",
    "obj_slice": _with("FEW_FRAGMENTS", more="own AS (SELECT * FROM few_fragments WHERE slice_id = 5), r AS (SELECT *, row_number() OVER (ORDER BY seg_id) - 1 AS n FROM own), texts AS (SELECT 0 AS part, 0 AS n, unnest([0, 1, 2]) AS k, unnest(['# slice 5', '# height: 1.250000', '# lines: ' || (SELECT count(*) FROM own)]) AS line UNION ALL SELECT 1, n, unnest([0, 1, 2]), unnest([printf('v %.6f %.6f %.6f', x0, y0, z0), printf('v %.6f %.6f %.6f', x1, y1, z1), printf('l %d %d', n * 2 + 1, n * 2 + 2)]) FROM r)") + _TEXT,
    "pipe_snapping_whole": _with(
        "GT",
        "POINTS",
        more=f"{_SAMPLES}, {_BOXES}, {_top('boxes', 'seg_id, k')}, means AS (SELECT seg_id, k, avg(x) AS cx, avg(y) AS cy FROM boxes GROUP BY seg_id, k), "
        + "cent AS (SELECT seg_id, k, cx, cy, top_z AS z FROM means JOIN top USING (seg_id, k)), usable AS (SELECT seg_id FROM cent GROUP BY seg_id HAVING count(*) >= 2), "
        + "chain AS (SELECT seg_id AS chain_id, row_number() OVER (PARTITION BY seg_id ORDER BY k) - 1 AS seq, cx AS x, cy AS y, z FROM cent WHERE seg_id IN (SELECT seg_id FROM usable)), "
        + f"{_BUCKETS}, {_PARTS}",
        recursive=True,
    )
    + f"SELECT a.chain_id AS seg_id, a.part, {', '.join(f'round({v}, 6) + 0e0 AS {n}' for v, n in (('a.fx', 'x0'), ('a.fy', 'y0'), ('a.z', 'z0'), ('b.fx', 'x1'), ('b.fy', 'y1'), ('b.z', 'z1')))} FROM feet a JOIN feet b ON a.chain_id = b.chain_id AND a.part = b.part AND a.head AND NOT b.head "
    + f"UNION ALL SELECT id, 0, {_r('x0', 'y0', 'z0', 'x1', 'y1', 'z1')} FROM gt g WHERE id NOT IN (SELECT seg_id FROM usable) AND EXISTS (SELECT 1 FROM points p WHERE class = 1 AND least((p.x - g.x0) * (p.x - g.x0) + (p.y - g.y0) * (p.y - g.y0), (p.x - g.x1) * (p.x - g.x1) + (p.y - g.y1) * (p.y - g.y1)) <= 0.8e0 * 0.8e0)",
}

# the same questions of the many fragments; not their clusters, whose recursive closure takes too long
SQL |= {
    "eps_neighbour_pairs_all": _with("FRAGMENTS", more=f"{_features('fragments')}, {_PAIRS}") + "SELECT a, b FROM pairs",
    "ghost_segments_all": SQL["ghost_segments"].replace(duck("FEW_FRAGMENTS"), duck("FRAGMENTS")),
    "nearest_pipe_all": SQL["nearest_pipe"].replace(duck("FEW_FRAGMENTS"), duck("FRAGMENTS")),
}
