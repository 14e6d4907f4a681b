"""Operators against naive versions, and on degenerate input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import schema
from strandline.config import Components, Hough, Snap
from strandline.functions import geometry as G
from strandline.operators import components, detection, evaluation, kernels, lines, slicing, snapping, spatial
from strandline.operators.graph import connected_components

ENDS = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def seg(spark, rows, key="seg_id"):
    return spark.createDataFrame(rows, f"{key} bigint, {ENDS}")


def points(spark, rows):
    return spark.createDataFrame(rows, schema.POINTS)


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (400, 400)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame([*edges, (None, 3), (9000, None)], "a bigint, b bigint")
    for few in (250_000, 0):
        found = {r["node"]: r["component"] for r in connected_components(table, few=few).collect()}
        assert found == {x: root(x) for x in parent}


def test_components_of_nothing(spark):
    for few in (250_000, -1):
        assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), few=few).count() == 0


def _fold(rows, gap):
    out = []
    for lo, hi, z in sorted(rows):
        if not out:
            out.append([lo, hi, z])
        elif out[-1][1] >= hi:
            continue
        elif out[-1][1] + gap < lo:
            out.append([lo, hi, z])
        else:
            out[-1] = [out[-1][0], hi, (out[-1][2] + z) / 2]
    return out


def test_islands_match_fold(spark):
    rng = random.Random(5)
    rows, wanted = [], {}
    for g in range(60):
        own = [(lo := rng.uniform(0, 30), lo + rng.uniform(0, 4), rng.random()) for _ in range(rng.randrange(1, 15))]
        rows += [(g, i, *r) for i, r in enumerate(own)]
        wanted[g] = _fold(own, 0.7)
    found = lines.islands(spark.createDataFrame(rows, "g int, i int, lo double, hi double, z double"), ["g"], 0.7, "i").orderBy("g", "lo").collect()
    got = {}
    for r in found:
        got.setdefault(r["g"], []).append([r["lo"], r["hi"], r["z"]])
    for g in wanted:
        assert np.allclose(got[g], wanted[g])


def test_top_heights_match_histogram(spark):
    rng = np.random.default_rng(2)
    rows, wanted = [], {}
    for g in range(80):
        z = rng.normal(0, rng.uniform(0.001, 0.2), rng.integers(1, 60))
        rows += [(g, float(v)) for v in z]
        bins = max(1, math.ceil((z.max() - z.min()) / 0.05))
        if bins == 1:
            wanted[g] = z.mean()
        else:
            n, edge = np.histogram(z, bins, (z.min(), z.max()))
            k = np.nonzero(n >= np.median(n) / 2)[0][-1]
            wanted[g] = (edge[k] + edge[k + 1]) / 2
    found = {r["g"]: r["top_z"] for r in snapping.top_heights(spark.createDataFrame(rows, "g int, z double"), ["g"], "z", 0.05).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[g] - wanted[g]) < 1e-9 for g in wanted)


def test_thinning_is_separated_and_full(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 3, (400, 2))
    rows = [(i * 977 + 5, float(x), float(y), 0.0, 1) for i, (x, y) in enumerate(xy)]
    kept = {r["point_id"] for r in spatial.thin(points(spark, rows), 0.2).collect()}
    at = {r[0]: np.array(r[1:3]) for r in rows}
    own = np.array([at[k] for k in kept])
    far = np.sqrt(((own[:, None] - own[None]) ** 2).sum(2)) + np.eye(len(own)) * 9
    assert far.min() >= 0.2
    for k, p in at.items():
        assert k in kept or np.sqrt(((own - p) ** 2).sum(1)).min() < 0.2
    # the greedy choice in the same order
    order = sorted(at, key=lambda k: ((k % 2147483647 * 48271 + 42) % 2147483647, k))
    greedy = []
    for k in order:
        if all(((at[k] - at[q]) ** 2).sum() >= 0.04 for q in greedy):
            greedy.append(k)
    assert kept == set(greedy)


def test_slices_are_closed_and_cover(spark):
    rows = [(i, 0.0, 0.0, z, 1) for i, z in enumerate([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55])]
    found = {r["slice_id"]: r for r in slicing.z_slices(points(spark, rows), 0.2).collect()}
    assert len(found) == 3 and found[0]["zmin"] == 0.0 and found[2]["zmax"] == 0.55
    members = slicing.slice_members(points(spark, rows), 0.2).collect()
    for r in rows:
        inside = sum(s["zmin"] <= r[3] <= s["zmax"] for s in found.values())
        assert sum(m["point_id"] == r[0] for m in members) == inside


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 3.0, 4.0, 1)], [(1, 2.0, 3.0, 4.0, 1), (2, 2.0, 5.0, 4.0, 1)]])
def test_degenerate_clouds(spark, rows):
    cloud = points(spark, rows)
    members = slicing.slice_members(cloud, 0.2)
    cells = slicing.raster_counts(members, slicing.slice_extents(members, 0.5))
    assert cells.agg(F.sum("n")).first()[0] == (len(rows) or None)
    assert detection.slice_lines(cloud, 0.2, Hough(cell_size=0.5)).count() == 0


def test_no_pipes_no_components(spark):
    cloud = points(spark, [(i, i * 0.01, 0.0, 0.0, 2) for i in range(30)])
    assert components.find_components(cloud, schema.empty(spark, schema.PIPES), Components()).count() == 0


def test_canny_and_hough_find_a_line():
    counts = np.zeros((60, 90))
    counts[30, 10:80] = 8
    edges = kernels.canny(counts, 1.0)
    assert edges.any()
    rows = np.nonzero(edges)[0]
    assert set(rows.tolist()) <= set(range(27, 34))
    found = kernels.hough_lines(edges, 10, 40, 5, 42)
    assert found and all(abs(y0 - 30) <= 3 and abs(y1 - 30) <= 3 and abs(x1 - x0) >= 40 for x0, y0, x1, y1 in found)
    assert not kernels.canny(np.zeros((5, 5)), 1.0).any() and kernels.hough_lines(np.zeros((5, 5), bool), 1, 1, 1, 0) == []


def test_hdbscan_parts_blobs():
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal((0, 0), 0.1, (60, 2)), rng.normal((5, 5), 0.1, (50, 2)), rng.uniform(-20, 20, (10, 2))])
    label = kernels.hdbscan(xy, 20)
    assert set(label[:60].tolist()) - {-1} == {0} and set(label[60:110].tolist()) - {-1} == {1}
    assert (label[:110] >= 0).mean() > 0.8 and (label[110:] == -1).mean() > 0.7
    assert (kernels.hdbscan(xy[:5], 20) == -1).all() and len(kernels.hdbscan(np.zeros((0, 2)), 20)) == 0


def test_dbscan_matches_depth_first(spark):
    rng = random.Random(11)
    rows = [(i, rng.uniform(0, 9), rng.uniform(0, 9), 0.0, rng.uniform(0, 9), rng.uniform(0, 9), 0.0) for i in range(150)]
    features = {r["seg_id"]: np.array([r["c2"], r["s2"], r["r"]]) for r in lines.axial_features(seg(spark, rows)).collect()}
    eps, least = 0.5, 4
    near = {i: [j for j in features if np.linalg.norm(features[i] - features[j]) <= eps] for i in features}
    core, label = {i for i in near if len(near[i]) >= least}, {}
    for i in sorted(core):
        todo = [i] if i not in label else []
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = i
            todo += [k for k in near[j] if k in core and k not in label]
    for i in near:
        if i not in core and (own := [label[j] for j in near[i] if j in core]):
            label[i] = min(own)
    found = {r["seg_id"]: r["cluster_id"] for r in lines.cluster_lines(seg(spark, rows), eps, least).collect()}
    assert found == {i: label.get(i) for i in near}


def test_axial_seam(spark):
    rows = [(1, 5.0, 0.0, 0.0, 5.0, 2.0, 0.0), (2, 5.0, 0.0, 0.0, 4.999, 2.0, 0.0), (3, -5.0, 0.0, 0.0, -5.0, 2.0, 0.0), (4, -5.0, 9.0, 0.0, -5.0, 11.0, 0.0)]
    plain = {(r["a"], r["b"]) for r in lines.eps_pairs(lines.axial_features(seg(spark, rows)), 0.45).collect()}
    fixed = {(r["a"], r["b"]) for r in lines.eps_pairs(lines.axial_features(seg(spark, rows)), 0.45, seam=True).collect()}
    assert (1, 2) in fixed and (1, 3) not in fixed and plain <= fixed


def test_eps_pairs_are_those_of_all_pairs(spark):
    """Lines all round the circle and on the vertical, by group, and few copies of each for it."""
    rng = np.random.default_rng(11)
    turn = np.concatenate([rng.uniform(0, np.pi, 150), rng.normal(0, 1e-3, 50), rng.normal(np.pi / 2, 1e-3, 50)])
    at = rng.uniform(-1.5, 1.5, (250, 2))
    rows = [(k, *at[k].tolist(), 0.0, float(at[k, 0] + np.cos(turn[k])), float(at[k, 1] + np.sin(turn[k])), 0.0) for k in range(250)]
    s = seg(spark, rows).withColumn("grp", F.col("seg_id") % 2)
    for eps, by, seam in ((0.45, None, False), (0.45, None, True), (0.2, "grp", True), (2.5, None, True)):
        features = lines.axial_features(s, by=by)
        found = lines.eps_pairs(features, eps, by, seam)
        f = features.toPandas()
        c2, s2, r, theta = (f[c].to_numpy() for c in ("c2", "s2", "r", "theta"))
        flat = (c2[:, None] - c2) ** 2 + (s2[:, None] - s2) ** 2
        near = flat + (r[:, None] - r) ** 2 <= eps * eps
        if seam:
            near |= (np.abs(theta[:, None] - theta) > np.pi / 2) & (flat + (r[:, None] + r) ** 2 <= eps * eps)
        if by:
            near &= f[by].to_numpy()[:, None] == f[by].to_numpy()
        ids = f["seg_id"].to_numpy()
        wanted = sorted((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(near), strict=True))
        assert sorted((p["a"], p["b"]) for p in found.collect()) == wanted and len(wanted) > 250
    node = lines.eps_pairs(lines.axial_features(s), 0.45)._jdf.queryExecution().optimizedPlan()
    parts = [node]
    for part in parts:
        parts += [part.children().apply(k) for k in range(part.children().size())]
    copies = [p.generator().children().head().children().size() for p in parts if p.nodeName() == "Generate"]
    assert copies == [9]


def test_eps_pairs_shuffle_few_copies_once(spark, monkeypatch):
    """A segment goes to its block and to those it may have neighbours in, and nothing is joined."""
    rng = np.random.default_rng(5)
    turn, at = rng.uniform(0, np.pi, 1500), rng.uniform(-30, 30, (1500, 2))
    rows = [(k, *at[k].tolist(), 0.0, float(at[k, 0] + np.cos(turn[k])), float(at[k, 1] + np.sin(turn[k])), 0.0) for k in range(1500)]
    features = lines.checkpoint(lines.axial_features(seg(spark, rows)))
    seen, kept = [], type(features).repartition
    monkeypatch.setattr(type(features), "repartition", lambda df, *a: (seen.append(df), kept(df, *a))[1])
    found = lines.eps_pairs(features, 0.45)
    assert len(seen) == 1 and 1500 < seen[0].count() <= 2.5 * 1500
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.filter("a = b").count() == 1500


@pytest.mark.parametrize("seam", [False, True])
def test_near_pairs_of_a_block_come_in_runs(monkeypatch, seam):
    """Runs of any size, rows that are not at home, crowds, and wide and narrow strips."""
    rng = np.random.default_rng(6)
    theta = np.concatenate([rng.uniform(0, np.pi, 200), np.abs(rng.normal(0, 0.02, 60)), np.pi - np.abs(rng.normal(0, 0.02, 60)) - 1e-9, np.full(40, 1.0)])
    r = np.concatenate([rng.uniform(-1, 1, 200), rng.normal(0, 0.3, 120), np.full(40, 0.25)])
    own = {"theta": theta, "r": r, "c2": np.cos(2 * theta), "s2": np.sin(2 * theta), "home": rng.random(360) < 0.7}
    flat = (own["c2"][:, None] - own["c2"]) ** 2 + (own["s2"][:, None] - own["s2"]) ** 2
    for eps, tried in ((0.45, 10**6), (0.45, 7), (0.01, 100), (1.9, 3000), (2.5, 1000)):
        monkeypatch.setattr(lines, "TRIED", tried)
        near = flat + (r[:, None] - r) ** 2 <= eps * eps
        if seam:
            near |= (np.abs(theta[:, None] - theta) > np.pi / 2) & (flat + (r[:, None] + r) ** 2 <= eps * eps)
        near &= own["home"][:, None]
        runs = list(lines._near_pairs(own, eps, seam))
        found = sorted((int(a), int(b)) for p, q in runs for a, b in zip(p, q, strict=True))
        assert found == list(zip(*(v.tolist() for v in np.nonzero(near)), strict=True)) and max(len(p) for p, _ in runs) <= max(4 * tried, 360)


def test_chain_becomes_segments(spark):
    rows = [(1, k, 0.5 * k, 0.01 * (k % 2), 1.0 if k < 8 else 1.6) for k in range(16)] + [(2, 0, 0.0, 0.0, 0.0)]
    found = snapping.chain_segments(spark.createDataFrame(rows, schema.CHAINS)).orderBy("x0").collect()
    assert [round(r["z0"], 2) for r in found] == [1.0, 1.6] and {r["chain_id"] for r in found} == {1}
    assert abs(found[0]["x0"]) < 0.05 and abs(found[1]["x1"] - 7.5) < 0.05


def test_buckets_match_state_machine(spark):
    rng = random.Random(9)
    rows = [(c, k, 0.5 * k, 0.0, round(rng.choice([0, 0, 0, 0.3]) + rng.uniform(0, 0.05) * k, 4)) for c in range(30) for k in range(rng.randrange(1, 14))]
    limit, wanted = math.tan(math.radians(15)) / 2, {}
    for c in range(30):
        z = [r[4] for r in rows if r[0] == c]
        current, dz, out = [0], [], []
        for i in range(1, len(z)):
            step = z[i - 1] - z[i]
            if dz and abs(step - sum(dz) / len(dz)) > limit:
                out.append(current)
                current, dz = [i - 1, i], [step]
            else:
                current.append(i)
                dz.append(step)
        if len(z) > 1:
            wanted[c] = [*out, current]
    got = {}
    for r in snapping.height_buckets(spark.createDataFrame(rows, schema.CHAINS)).orderBy("chain_id", "bucket", "pos").collect():
        got.setdefault(r["chain_id"], {}).setdefault(r["bucket"], []).append(r["seq"])
    assert {c: list(b.values()) for c, b in got.items()} == wanted


def test_snapping_moves_a_pipe_onto_points(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(rng.normal(0, 0.02)), float(1 + rng.normal(0, 0.01)), 1) for i, x in enumerate(np.linspace(0, 8, 4000))]
    rough = seg(spark, [(1, 0.0, 0.2, 0.9, 8.0, 0.25, 0.9), (2, 50.0, 50.0, 0.0, 55.0, 50.0, 0.0), (3, 4.0, 0.0, 1.0, 4.0, 0.0, 1.0)])
    pipes, samples = snapping.snap(rough, points(spark, rows), Snap())
    found = {r["seg_id"]: r for r in pipes.collect()}
    assert set(found) == {1, 3}  # the ghost went, the tiny one stayed
    p = found[1]
    assert abs(p["y0"]) < 0.03 and abs(p["y1"]) < 0.03 and abs(p["z0"] - 1) < 0.06 and abs(p["x0"]) < 0.1 and abs(p["x1"] - 8) < 0.1
    assert samples.filter("seg_id = 1").count() == 17
    chains = {r["chain_id"]: len(r["points"]) for r in snapping.chain_points(rough, samples).collect()}
    assert chains == {1: 17, 2: 0, 3: 0}


@pytest.mark.parametrize("thinning", [True, False])
def test_box_rows_are_those_of_single_boxes(spark, monkeypatch, thinning):
    """Every box by itself: thinned one point after another, at any angle, over borders of tiles, upright, crowded and nearly empty."""
    rng = np.random.default_rng(21)
    at = np.concatenate([rng.uniform(-3, 6, (3000, 2)), np.round(rng.normal(1, 0.1, (600, 2)), 2), [[40.0, 40.0]] * 5])
    rows = [(int(k), float(x), float(y), float(np.round(rng.uniform(0, 0.2), 3)), 1) for k, (x, y) in zip(rng.permutation(len(at)) * 2**40, at, strict=True)]
    rough = [(k, *map(float, rng.uniform(-3, 6, 2)), 0.0, *map(float, rng.uniform(-3, 6, 2)), 0.1) for k in range(30)]
    rough += [(90, -2.0, 1.0, 0.0, 4.0, 1.0, 0.0), (91, 1.0, -2.0, 0.0, 1.0, 4.0, 0.0), (92, 1.0, 1.0, 0.0, 1.0, 1.0, 3.0), (93, 39.9, 40.0, 0.0, 40.1, 40.0, 0.0), (94, 80.0, 0.0, 0.0, 81.0, 0.0, 0.0)]
    s, p = seg(spark, rough), points(spark, rows)
    rank = lambda i: ((i % 2147483647 * 48271 + 42) % 2147483647, i)
    for settings, tile in ((Snap(), 10**6), (Snap(tangential_length=0.6, normal_length=0.3, poisson_radius=0.05), 500)):
        monkeypatch.setattr(snapping, "TILE_POINTS", tile)
        monkeypatch.setattr(snapping, "BOX_POINTS", 2 * tile)
        t, n, r = settings.tangential_length, settings.normal_length, settings.poisson_radius
        wanted, members = {}, []
        for q in snapping.samples(s, settings).collect():
            own = []
            for i, x, y, z, _ in sorted(rows, key=lambda e: rank(e[0])):
                dx, dy = x - q["sx"], y - q["sy"]
                u, v = dx * q["tx"] + dy * q["ty"], dx * q["nx"] + dy * q["ny"]
                if dx * dx + dy * dy <= t * t + n * n and abs(u) <= t and abs(v) <= n:
                    own.append((u, v, x, y, z))
            if len(own) < settings.min_points_for_centroid:
                continue
            kept = []
            for e in own:
                if all((e[0] - f[0]) ** 2 + (e[1] - f[1]) ** 2 >= r * r for f in kept):
                    kept.append(e)
            own = kept if thinning and len(kept) >= settings.min_points_for_centroid else own
            wanted[q["seg_id"], q["k"]] = (sum(e[2] for e in own) / len(own), sum(e[3] for e in own) / len(own), len(own))
            members += [(q["seg_id"], q["k"], e[4]) for e in own]
        tops = snapping.top_heights(spark.createDataFrame(members, "seg_id bigint, k int, z double"), ["seg_id", "k"], "z", settings.quantization_precision)
        tops = {(e["seg_id"], e["k"]): e["top_z"] for e in tops.collect()}
        found = {(e["seg_id"], e["k"]): e for e in snapping.box_rows(snapping.samples(s, settings), p, settings, thinning).collect()}
        assert found.keys() == wanted.keys() and any(k[0] == 92 for k in found) and any(k[0] == 93 for k in found) and len(found) > 200
        for k, (cx, cy, m) in wanted.items():
            e = found[k]
            assert e["n_pts"] == m and max(abs(e["cx"] - cx), abs(e["cy"] - cy), abs(e["z"] - tops[k])) < 1e-9


def test_snapping_keeps_no_box_points(spark, monkeypatch):
    """200 pipes in one place over 2,000 points have 75,000 box points: what is kept in between is a row for a sample."""
    rows = [(i, 0.004 * i, 0.0, 1.0, 1) for i in range(2000)]
    seen = []
    kept = snapping.checkpoint
    monkeypatch.setattr(snapping, "checkpoint", lambda df: (seen.append(kept(df)), seen[-1])[1])
    pipes = snapping.snap(seg(spark, [(k, 0.0, 0.1, 1.0, 8.0, 0.1, 1.0) for k in range(200)]), points(spark, rows), thinning=False)[0]
    assert pipes.count() == 200 and max(df.count() for df in seen) <= 200 * 17


def test_evaluation_identity_and_missing_heights(spark):
    nan = float("nan")
    gt = seg(spark, [(1, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0), (3, 0.0, 9.0, nan, 4.0, 9.0, nan), (4, 7.0, 7.0, 0.0, 7.0, 7.0, 0.0)], "id")
    det = seg(spark, [(1, 0.0, 0.1, 1.0, 4.0, 0.1, 1.0), (2, 0.0, 0.1, 1.0, 4.0, 0.1, 1.0), (3, 0.0, 9.0, 0.0, 2.0, 9.0, 0.0), (4, 0.0, 20.0, 0.0, 3.0, 20.0, 0.0)], "id")
    r = evaluation.pipe_report(gt, det).first()
    # equal segments: one length and one match, but each counts as a detection
    assert (r["correct"], r["partial"], r["missed"], r["false_positives"]) == (2, 1, 1, 2)
    assert r["total_length"] == 8.0 and r["coverage"] == pytest.approx(6.0) and r["false_positive_length"] == 3.0
    nothing = evaluation.pipe_report(gt.limit(0), det.limit(0)).first()
    assert nothing["n_gt"] == 0 and nothing["coverage_pct"] is None and nothing["xy_median"] is None


def test_steep_short_truth_still_matches_far_detection(spark):
    turn = math.radians(86)
    gt = [(1, 0.0, 0.0, 0.0, 0.9 * math.cos(turn), 0.9 * math.sin(turn), 0.0)]
    det = [(k, -30.0 + k, 0.4, 0.0, 30.0, 0.4, 0.0) for k in range(3)]
    found = {(r["gt_id"], r["det_id"]) for r in evaluation.match_pipes(seg(spark, gt, "id"), seg(spark, det, "id")).collect()}
    assert found == {(1, 0), (1, 1), (1, 2)}


def test_component_matches(spark):
    c = "id bigint, cx double, cy double, cz double"
    gt, det = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 5.0, 5.0, 0.0)], c), spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.3, 0.4, 1.0), (3, 9.0, 9.0, 0.0)], c)
    assert {(r["gt_id"], r["det_id"], r["xy"]) for r in evaluation.match_components(gt, det, compat=True).collect()} == {(1, 1, -1.0), (1, 2, 0.5)}
    r = evaluation.component_report(gt, det).first()
    assert (r["found"], r["missed"], r["false_positives"], r["xy_avg"]) == (1, 1, 1, 0.25)


def test_shares_of_nothing_fail(spark):
    empty = spark.createDataFrame([(0, 0, 0)], "found int, missed int, false_positives int")
    with pytest.raises(Exception, match="no count"):
        evaluation.component_shares(empty).collect()


def test_geometry_measures(spark):
    rows = spark.createDataFrame([(3.0, 4.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (3.0, 4.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0)], f"x double, y double, z double, {ENDS}")
    s = G.ends()
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    got = rows.select(G.distance_xy(x, y, s).alias("a"), G.line_distance_xy(x, y, s).alias("b"), G.line_distance_z(x, y, z, s).alias("c"), G.distance(x, y, z, s).alias("d"), G.place_on_segment(x, y, z, s).alias("t")).collect()
    assert got[0]["a"] == 5 and got[0]["b"] == 5 and got[0]["c"] == 2 and got[0]["t"] == 0
    assert got[1]["a"] == pytest.approx(math.hypot(1, 4)) and got[1]["b"] == 4 and got[1]["t"] == 1 and got[1]["d"] == pytest.approx(math.sqrt(1 + 16 + 4))


def test_hough_space_peaks_on_the_line(spark):
    edges = spark.createDataFrame([(0, 7, c) for c in range(40)], "slice_id int, row int, col int")
    best = detection.hough_space(edges).orderBy(F.desc("votes"), "angle").first()
    assert (best["votes"], abs(best["rho"])) == (40, 7)


def test_planar_and_spatial_thinning_differ(spark):
    rows = [(1, 0.0, 0.0, 0.0, 1), (2, 0.0, 0.0, 5.0, 1), (3, 0.01, 0.0, 5.0, 1)]
    assert spatial.thin(points(spark, rows), 0.1).count() == 1 and spatial.thin(points(spark, rows), 0.1, planar=False).count() == 2


def test_density_clusters_are_the_same_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 40)
    rng = random.Random(5)
    # lonely fittings of 8 points, a crowd, strays, and coordinates that often tie
    places = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(30)]
    xy = [(round(x + rng.gauss(0, 0.1), 2), round(y + rng.gauss(0, 0.1), 2)) for x, y in places for _ in range(8)]
    xy += [(round(rng.gauss(30, 2), 1), round(rng.gauss(30, 2), 1)) for _ in range(150)] + [(rng.uniform(-50, 90), rng.uniform(-50, 90)) for _ in range(12)]
    cloud = points(spark, [(k, x, y, 0.0, 2) for k, (x, y) in enumerate(xy)])
    for method, metric in (("eom", "euclidean"), ("leaf", "euclidean"), ("eom", "manhattan"), ("eom", "chebyshev")):
        settings = Components(min_points=5, cluster_selection_method=method, metric=metric)
        joint, blocks = (sorted(map(tuple, components.density_clusters(cloud, settings, most=most).collect())) for most in (20_000, 100))
        assert joint == blocks and len({label for _, label in joint}) >= 20


def test_metrics_of_density_clusters(spark):
    q, xy = np.array([[0.0, 0.0]]), np.array([[3.0, 4.0], [0.0, 6.0], [5.0, 5.0]])
    assert kernels.nearest_distances(q, xy, 3, "manhattan").tolist() == [[6.0, 7.0, 10.0]] and kernels.nearest_distances(q, xy, 3, "chebyshev").tolist() == [[4.0, 5.0, 6.0]]
    with pytest.raises(ValueError, match="metric"):
        components.density_clusters(points(spark, []), Components(metric="haversine"))


def test_lines_over_tile_borders_are_whole(spark):
    from strandline.config import Hough

    settings = Hough(cell_size=0.05, tile_cells=64)  # least length 30 cells, gap 10
    lines = {0: (44, 83), 1: (20, 70), 2: (100, 300), 3: (5, 40), 4: (60, 80)}
    rows = [(b, 0, c // 64, 7, c) for b, (first, last) in lines.items() for c in range(first, last + 1)]
    rows += [(5, c // 64, c // 64, c, c) for c in range(50, 85)]
    edges = spark.createDataFrame(rows, "slice_id int, tile_row int, tile_col int, row int, col int")
    got = {}
    for r in detection.hough_segments(edges, settings).collect():
        got.setdefault(r["slice_id"], []).append(sorted((r["px0"], r["px1"])))
        assert all(r["tile_col"] * 64 - 0.5 <= r[c] <= r["tile_col"] * 64 + 63.5 for c in ("px0", "px1"))
    for b, ends in {**{b: lines[b] for b in range(4)}, 5: (50, 84)}.items():
        parts = sorted(got[b])
        assert (parts[0][0], parts[-1][1]) == ends and all(abs(q[0] - p[1]) < 1e-9 for p, q in zip(parts, parts[1:]))
    assert 4 not in got


def test_robust_line_matches_a_loop():
    rng = np.random.default_rng(4)
    for m in (2, 3, 7, 40):
        x, y = rng.integers(0, 12, m) / 4.0, rng.integers(0, 4, m) / 20.0
        best = None
        for i in range(m):
            for j in range(i + 1, m):
                size = np.hypot(x[j] - x[i], y[j] - y[i])
                if size > 0:
                    d = np.abs((x[j] - x[i]) * (y - y[i]) - (y[j] - y[i]) * (x - x[i])) / size
                    found = (-(d < 0.07).sum(), round(float((d[d < 0.07] ** 2).sum()), 9), i, j)
                    best = min(best or found, found)
        for at_once in (4_000_000, 16):
            old, snapping.AT_ONCE = snapping.AT_ONCE, at_once
            try:
                got = snapping._robust_line(x, y, 0.07)
            finally:
                snapping.AT_ONCE = old
            assert (-got[2], got[3], got[0], got[1]) == (best[0], pytest.approx(best[1], abs=1e-9), *best[2:])
    assert snapping._robust_line(np.ones(3), np.ones(3), 0.1) is None and snapping._robust_line(np.ones(1), np.ones(1), 0.1) is None


def test_nearest_segment_by_growing_cells(spark):
    rng = np.random.default_rng(6)
    ends = rng.uniform(0, 100, (60, 6)).tolist()
    pipes = spark.createDataFrame([(k, *e[:3], *([v + 3 for v in e[:3]] if k % 3 else e[3:])) for k, e in enumerate(ends)], "pipe_id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    places = spark.createDataFrame([(k, *rng.uniform(-200 if k < 5 else 0, 300 if k < 5 else 100, 3).tolist()) for k in range(200)] + [(900, None, 1.0, 1.0)], "point_id int, x double, y double, z double")
    for planar in (True, False):
        one, two = (spatial.segment_distances(places, pipes, planar, most).collect() for most in (10**9, 0))
        assert len(one) == 200 and {r[0]: round(r[1], 9) for r in one} == {r[0]: round(r[1], 9) for r in two}
    one, two = (sorted(spatial.nearest_segment(places, pipes, "point_id", "x", "y", most=most).collect()) for most in (10**9, 0))
    assert one == two and len(one) == 200
    assert spatial.nearest_segment(places, pipes.limit(0), "point_id", "x", "y", most=-1).count() == 0


def test_matches_are_those_of_all_pairs(spark):
    """Short truths, steep and long detections, far along their lines."""
    rng = np.random.default_rng(7)
    schema = "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"

    def lines(n, long):
        at, turn = rng.uniform(0, 40, (n, 2)), rng.uniform(0, np.pi, n)
        size = rng.choice(long, n)
        return [(k, *at[k].tolist(), 0.0, float(at[k, 0] + size[k] * np.cos(turn[k])), float(at[k, 1] + size[k] * np.sin(turn[k])), 1.0) for k in range(n)]

    gt, det = lines(300, [0.2, 0.9, 1.1, 6.0]), lines(200, [0.5, 3.0, 60.0]) + [(900, 5.0, 0.0, 0.0, 5.0, 40.0, 0.0), (901, 0.0, 7.0, 0.0, 40.0, 7.0, 0.0), (902, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0)]
    g, d = spark.createDataFrame(gt, schema), spark.createDataFrame(det, schema)
    found = sorted((r["gt_id"], r["det_id"]) for r in evaluation.match_pipes(g, d).collect())
    gs, ds = G.ends("g"), G.ends("d")
    pairs = g.toDF("gt_id", *(f"g{c}" for c in G.Ends._fields)).crossJoin(d.toDF("det_id", *(f"d{c}" for c in G.Ends._fields)))
    wanted = sorted((r[0], r[1]) for r in pairs.filter(G.within_tolerance(ds, gs, evaluation.TOLERANCE)).select("gt_id", "det_id").collect())
    assert found == wanted and len(wanted) > 100


def test_joins_of_matches_are_compiled(spark):
    """The JVM only interprets methods of over 8000 bytes."""
    g = seg(spark, [(k, 1.0 * k, 0.0, 0.0, 1.0 * k + 3, 1.0, 1.0) for k in range(50)], "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = evaluation.match_pipes(g, g).select(*(f"{s}{c}" for s in "gd" for c in G.Ends._fields))
        found = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(hits._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = [found.apply(k) for k in range(found.size())]
    sizes = [p._3().maxMethodCodeSize() for p in parts if "SortMergeJoin" in p._1()]
    assert len(sizes) == 2 and max(sizes) < 8000


def test_cells_beside_hold_all_places_within_reach(spark):
    rng = np.random.default_rng(5)
    rows = [(k, *(float(v) for v in rng.uniform(-9, 9, 6))) for k in range(60)]
    rows += [(60, 0.0, 1.0, 0.0, 7.0, 1.0, 0.0), (61, 2.0, 8.0, 0.0, 2.0, -3.0, 0.0), (62, 0.0, 0.0, 0.0, 5.0, 1e-310, 0.0), (63, 0.0, 0.0, 0.0, 5.0, 1e-8, 0.0), (64, 3.0, 3.0, 0.0, 3.0 + 1e-9, 3.0, 0.0)]
    s, size, reach = G.ends(), 0.7, 1.3
    found = [(r["seg_id"], r["_cx"], r["_cy"]) for r in spatial.cells_beside(seg(spark, rows), s, G.length_xy(s), size, reach).collect()]
    assert len(found) == len(set(found))
    cells = set(found)
    for k, x0, y0, _, x1, y1, _ in rows:
        # any place of the segment, and from there any way of at most the reach
        at, turn, far = rng.uniform(0, 1, 400), rng.uniform(0, 2 * np.pi, 400), reach * rng.choice([1.0, 0.999, 0.5], 400)
        px, py = x0 + at * (x1 - x0) + far * np.cos(turn), y0 + at * (y1 - y0) + far * np.sin(turn)
        assert {(k, int(i), int(j)) for i, j in zip(np.floor(px / size), np.floor(py / size), strict=True)} <= cells
    # about as many as the strip holds
    assert len([c for c in found if c[0] == 60]) <= ((7 + 2 * reach) / size + 2) * (2 * reach / size + 2)


def test_odd_segments_match_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 0.0, 0.0, 4.0, 0.0, 0.0), (2, nan, 0.0, 0.0, 4.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, inf, 0.0, 0.0), (4, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    whole = [(5, 0.0, 0.0, None, 4.0, 0.0, nan), (6, 0.0, 0.0, 0.0, 4.0, 1e-310, 0.0)]
    rows = seg(spark, odd + whole, "id")
    assert {(r["gt_id"], r["det_id"]) for r in evaluation.match_pipes(rows, rows).collect()} == {(a, b) for a in (5, 6) for b in (5, 6)}
    assert evaluation.match_pipes(rows, rows.limit(0)).count() == evaluation.match_pipes(rows.limit(0), rows).count() == 0


def test_rows_are_numbered_over_partitions(spark):
    from strandline.session import numbered

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("v"))
    for few in (200_000, -1):
        found = numbered(rows, "v", few=few)
        assert dict(found.dtypes)["n"] == "bigint"
        assert [r["n"] for r in sorted(found.collect())] == list(range(5000))
        assert numbered(rows.limit(0), "v", few=few).count() == 0


def test_hough_peaks_are_apart(spark):
    votes = spark.createDataFrame([(0, 10, 50, 100), (0, 12, 55, 90), (0, 12, 80, 80), (0, 178, -52, 70), (0, 1, 50, 60), (0, 90, 0, 30), (1, 5, 5, 3), (1, 5, 6, 3)], "slice_id int, angle int, rho int, votes bigint")
    found = [(r["slice_id"], r["angle"], r["rho"], r["place"]) for r in detection.hough_peaks(votes).orderBy("slice_id", "place").collect()]
    assert found == [(0, 10, 50, 1), (0, 12, 80, 2), (0, 178, -52, 3), (1, 5, 5, 1)]


def test_records_go_back_to_segments(spark):
    from strandline.functions import records

    segs = spark.createDataFrame([(5, 1.0, 2.0, 3.0, 4.0, 6.0, 3.0), (2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "id int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    made = records.segments_to_records(segs, "id")
    assert [(r["pipe_number"], r["fitness"], r["p2_x"]) for r in made.orderBy("pipe_number").collect()] == [(1, 1.0, 1.0), (2, 5.0, 4.0)]
    assert {tuple(r)[1:] for r in records.records_to_segments(made).collect()} == {tuple(r)[1:] for r in segs.collect()}
    assert spark.createDataFrame([(0,), (2,), (None,)], "k int").select(records.mapped_label(F.col("k"), [7, 8, 9]).alias("v")).collect() == [(7,), (9,), (None,)]


@pytest.mark.parametrize("least", [1, 3])
def test_clusters_by_cells_are_those_of_all_pairs(spark, least):
    """Crowded, thin and lone lines."""
    rng = np.random.default_rng(least)
    at, turn = np.concatenate([rng.normal(20, 0.3, (200, 2)), rng.uniform(0, 60, (250, 2))]), np.concatenate([rng.normal(1, 0.05, 200), rng.uniform(0, np.pi, 250)])
    rows = [(k, *map(float, at[k]), 0.0, float(at[k, 0] + np.cos(turn[k])), float(at[k, 1] + np.sin(turn[k])), 0.0) for k in range(len(at))]
    s = seg(spark, rows).withColumn("part", F.col("seg_id") % 2)
    names = lambda df: sorted((r["seg_id"], r["cluster_id"]) for r in df.select("seg_id", "cluster_id").fillna(-1).collect())
    for eps, by in ((0.45, None), (0.2, "part")):
        wanted = lines.clusters(s, lines.eps_pairs(lines.axial_features(s, by=by), eps, by), least)
        assert names(lines.cluster_lines(s, eps, least, by=by)) == names(wanted)
    wanted = lines.clusters(s, lines.strict_pairs(lines.axial_features(s), 0.3, 10.0), least)
    assert names(lines.strict_clusters(s, 0.3, 10.0, least)) == names(wanted)


def test_crowded_clusters_list_no_pairs(spark, monkeypatch):
    """2,000 lines in one place have 4 million pairs: they are never joined."""
    rows = [(k, 0.0, k * 1e-6, 0.0, 1.0, k * 1e-6, 0.0) for k in range(2000)]
    seen = []
    kept = lines.checkpoint
    monkeypatch.setattr(lines, "checkpoint", lambda df: (seen.append(kept(df)), seen[-1])[1])
    found = lines.cluster_lines(seg(spark, rows), 0.45, 3).collect()
    assert {r["cluster_id"] for r in found} == {0} and max(df.count() for df in seen) <= 2000


def test_matches_in_a_crowd_come_from_few_candidates(spark):
    """Pipes side by side in one large cell, and a pair exactly two tolerances apart and half beside each other."""
    rows = [(k, 0.0, 1.2 * k, 0.0, 6.0, 1.2 * k, 0.0) for k in range(60)] + [(100, 200.0, 0.0, 0.0, 210.0, 0.0, 0.0)]
    det = [*rows[:60], (100, 205.0, 0.5, 0.0, 215.0, 0.5, 0.0), (101, 206.0, 0.5, 0.0, 216.0, 0.5, 0.0)]
    found = evaluation.match_pipes(seg(spark, rows, "id"), seg(spark, det, "id"))
    assert sorted((r["gt_id"], r["det_id"]) for r in found.collect()) == [*((k, k) for k in range(60)), (100, 100)]
    # a pair is found once, so nothing is sorted out afterwards
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_ghosts_and_boxes_are_those_of_all_pairs(spark):
    """Ends near, at and beyond the reach of points; boxes at any angle, none of whose pairs pass a window."""
    from strandline.config import Snap

    rng = np.random.default_rng(8)
    rows = [(k, *map(float, rng.uniform(0, 8, 2)), 0.0, *map(float, rng.uniform(0, 8, 2)), 0.0) for k in range(40)] + [(90, 20.0, 0.0, 0.0, 30.0, 0.0, 0.0), (91, 40.0, 0.0, 0.0, 50.0, 0.0, 0.0)]
    points = [(k, *map(float, rng.uniform(0, 4, 2)), 0.0) for k in range(900)] + [(2000, 20.0, 0.75, 0.0), (2001, 40.0, 0.9, 0.0)]
    s, p = seg(spark, rows), spark.createDataFrame(points, "point_id bigint, x double, y double, z double")
    far = lambda x, y: min((a - x) ** 2 + (b - y) ** 2 for _, a, b, _ in points) > 0.75 * 0.75
    wanted = sorted(r[0] for r in rows if far(r[1], r[2]) and far(r[4], r[5]))
    assert sorted(r[0] for r in snapping.ghosts(s, p, 0.75).collect()) == wanted and 91 in wanted and 90 not in wanted
    for settings in (Snap(), Snap(tangential_length=0.6, normal_length=0.3)):
        t, n = settings.tangential_length, settings.normal_length
        found = snapping.box_points(snapping.samples(s, settings), p, settings)
        own = {}
        for q in snapping.samples(s, settings).collect():
            at = [i for i, x, y, _ in points if abs((x - q["sx"]) * q["tx"] + (y - q["sy"]) * q["ty"]) <= t and abs((x - q["sx"]) * q["nx"] + (y - q["sy"]) * q["ny"]) <= n]
            if len(at) >= settings.min_points_for_centroid:
                own |= {(q["seg_id"], q["k"], i): 1 for i in at}
        assert sorted((r["seg_id"], r["k"], r["point_id"]) for r in found.collect()) == sorted(own) and own
        assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_close_pairs_in_space_are_all_found_with_few_copies(spark):
    rng = np.random.default_rng(12)
    at = np.round(rng.uniform(-1, 1, (1200, 3)), 2)
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "point_id bigint, x double, y double, z double")
    found = spatial._close_pairs(points, 0.1, False, 42)
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    near = {(i, j) for i, j in zip(*np.nonzero(d2 < 0.1 * 0.1 - 1e-12), strict=True) if i < j}
    edge = {(i, j) for i, j in zip(*np.nonzero(np.abs(d2 - 0.1 * 0.1) <= 1e-12), strict=True) if i < j}
    rows = [tuple(sorted(r)) for r in found.collect()]
    assert len(rows) == len(set(rows)) and near <= set(rows) <= near | edge and len(near) > 100
    # eight corners, not 27 cells
    assert found._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") <= 10
