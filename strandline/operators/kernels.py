"""Numeric kernels on one group's arrays: edges, line segments, density clusters.  Plain numpy, no Spark."""

from __future__ import annotations

import math

import numpy as np


def _blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, cut off at four sigmas; places outside count as empty."""
    reach = max(1, int(4 * sigma + 0.5))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).astype(image.dtype)
    for axis in (0, 1):
        n = image.shape[axis]
        padded = np.pad(image, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)])
        image = np.zeros_like(image)
        for k, weight in enumerate(weights):
            image += weight * (padded[k : k + n] if axis == 0 else padded[:, k : k + n])
    return image


def _crests(size: np.ndarray, gy: np.ndarray, gx: np.ndarray) -> np.ndarray:
    """Where a gradient is no smaller than on either side along its direction, between two neighbours of each side in proportion."""
    q = np.pad(size, 1)
    rows, cols = np.indices(size.shape, dtype=np.int32)
    sy, sx = np.sign(gy).astype(np.int32), np.sign(gx).astype(np.int32)
    steep = np.abs(gy) >= np.abs(gx)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.nan_to_num(np.where(steep, np.abs(gx) / np.abs(gy), np.abs(gy) / np.abs(gx)))
    crest = np.ones(size.shape, dtype=bool)
    for way in (1, -1):
        straight = q[rows + 1 + way * np.where(steep, sy, 0), cols + 1 + way * np.where(steep, 0, sx)]
        corner = q[rows + 1 + way * sy, cols + 1 + way * sx]
        crest &= size >= straight * (1 - share) + corner * share
    return crest


def canny(counts: np.ndarray, sigma: float, low: float = 0.1, high: float = 0.2, peak: float | None = None) -> np.ndarray:
    """Edges of a count raster: blur, gradient, thinning across the edge, and hysteresis.

    Counts are scaled by ``peak`` (their own largest by default).  The blur is
    divided by that of an all-ones mask, so the border does not read as an edge.
    ``low`` and ``high`` are measured on the plain sums of the gradient masks
    (1, 2, 1), which are four times a difference of neighbours but one.
    """
    peak = float(counts.max(initial=0)) if peak is None else peak
    if not counts.size or peak == 0:
        return np.zeros(counts.shape, dtype=bool)
    ones = [_blur(np.ones((n, 1), np.float32), sigma) for n in counts.shape]  # a mask's blur is that of its sides
    smooth = _blur((counts / (peak + 1e-9)).astype(np.float32), sigma) / (ones[0] * ones[1].T + np.float32(1e-12))
    p = np.pad(smooth, 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.hypot(gx, gy)
    inner = np.zeros(size.shape, dtype=bool)
    inner[1:-1, 1:-1] = True
    weak = inner & (size >= low)
    weak &= _crests(size, gy, gx)
    edges = weak & (size >= high)
    while True:  # weak edges that touch strong ones
        grown = np.pad(edges, 1)
        near = np.zeros(edges.shape, dtype=bool)
        for i in range(3):
            for j in range(3):
                near |= grown[i : i + edges.shape[0], j : j + edges.shape[1]]
        near &= weak
        if near.sum() == edges.sum():
            return edges
        edges = near


def hough_lines(edges: np.ndarray, threshold: int, length: int, gap: int, seed: int, angles: int = 180) -> list[tuple[int, int, int, int]]:
    """Segments (x0, y0, x1, y1) in pixels by the progressive probabilistic Hough transform.

    Edge pixels vote in random order; when a pixel lifts a line to the
    threshold, the line is walked from it in both directions over gaps of at
    most ``gap``, its pixels are taken out, and it counts if it spans ``length``
    in one axis.
    """
    height, width = edges.shape
    ys, xs = np.nonzero(edges)
    if not len(ys):
        return []
    theta = np.arange(angles) * np.pi / angles - np.pi / 2
    cos, sin = np.cos(theta), np.sin(theta)
    offset = int(np.ceil(np.hypot(height, width)))
    votes = np.zeros((angles, 2 * offset + 2), dtype=np.int32)
    mask, voted = edges.copy(), np.zeros(edges.shape, dtype=bool)
    line, each = [], np.arange(angles)
    rho = lambda x, y: np.rint(x * cos + y * sin).astype(int) + offset
    for k in np.random.default_rng(seed).permutation(len(ys)):
        x, y = int(xs[k]), int(ys[k])
        if not mask[y, x]:
            continue
        at = rho(x, y)
        votes[each, at] += 1
        voted[y, x] = True
        own = votes[each, at]
        best = int(own.argmax())
        if own[best] < threshold:
            continue
        a, b = -sin[best], cos[best]
        along_x = abs(a) > abs(b)
        dx, dy = (np.sign(a), b / abs(a)) if along_x else (a / abs(b), np.sign(b))
        ends, taken = [], [(x, y)]
        for sign in (1, -1):
            px, py, empty, end = float(x), float(y), 0, (x, y)
            while True:
                px, py = px + sign * dx, py + sign * dy
                i, j = int(round(px)), int(round(py))
                if not (0 <= i < width and 0 <= j < height):
                    break
                if mask[j, i]:
                    empty, end = 0, (i, j)
                    taken.append((i, j))
                else:
                    empty += 1
                    if empty > gap:
                        break
            ends.append(end)
        (x1, y1), (x0, y0) = ends
        long = abs(x1 - x0) >= length or abs(y1 - y0) >= length
        for i, j in taken:
            if long and voted[j, i]:
                votes[each, rho(i, j)] -= 1
                voted[j, i] = False
            mask[j, i] = False
        if long:
            line.append((x0, y0, x1, y1))
    return line


#: Planar distances by name, from the differences along the axes.
METRICS = {
    "euclidean": lambda dx, dy: np.sqrt(dx * dx + dy * dy),
    "l2": lambda dx, dy: np.sqrt(dx * dx + dy * dy),
    "manhattan": lambda dx, dy: np.abs(dx) + np.abs(dy),
    "cityblock": lambda dx, dy: np.abs(dx) + np.abs(dy),
    "l1": lambda dx, dy: np.abs(dx) + np.abs(dy),
    "chebyshev": lambda dx, dy: np.maximum(np.abs(dx), np.abs(dy)),
    "infinity": lambda dx, dy: np.maximum(np.abs(dx), np.abs(dy)),
}


def nearest_distances(q: np.ndarray, xy: np.ndarray, k: int, metric: str = "euclidean") -> np.ndarray:
    """The distances, rising, from each row of ``q`` to its ``k`` nearest points, or to all if they are fewer."""
    k = min(k, len(xy))
    out = np.empty((len(q), k))
    step = max(1, 5_000_000 // max(1, len(xy)))
    for low in range(0, len(q), step):
        part = q[low : low + step]
        d = METRICS[metric](part[:, None, 0] - xy[None, :, 0], part[:, None, 1] - xy[None, :, 1])
        out[low : low + step] = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
    return out


def _core_distances(xy: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Distance to the k-th nearest point, the point itself counted as the first."""
    return nearest_distances(xy, xy, k, metric)[:, -1]


def spanning_tree(xy: np.ndarray, core: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning tree of the mutual reachability distance, by Prim; quadratic time, linear memory."""
    n = len(xy)
    nearest, source = np.full(n, np.inf), np.zeros(n, dtype=int)
    inside = np.zeros(n, dtype=bool)
    a, b, w = np.empty(n - 1, int), np.empty(n - 1, int), np.empty(n - 1)
    at = 0
    inside[0] = True
    for k in range(n - 1):
        d = np.maximum(METRICS[metric](*(xy - xy[at]).T), np.maximum(core, core[at]))
        closer = ~inside & (d < nearest)
        nearest[closer], source[closer] = d[closer], at
        at = int(np.where(inside, np.inf, nearest).argmin())
        a[k], b[k], w[k] = source[at], at, nearest[at]
        inside[at] = True
    return a, b, w


def hdbscan(xy: np.ndarray, least: int, method: str = "eom", metric: str = "euclidean") -> np.ndarray:
    """Labels of hierarchical density clusters, -1 for noise.

    Mutual reachability with ``least`` neighbours, single linkage, a tree
    condensed to clusters of at least ``least`` points, and the clusters of
    greatest excess of mass (or the tree's leaves); the root never counts.
    Clusters are numbered by their first point.
    """
    n = len(xy)
    if n < max(least, 2):
        return np.full(n, -1)
    return tree_labels(n, *spanning_tree(xy, _core_distances(xy, least, metric), metric), least, method)


def tree_labels(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int, method: str = "eom") -> np.ndarray:
    """Labels of ``n`` points from edges that hold a least spanning tree; which of several least ones does not matter, as equal lengths join at once."""
    labels = np.full(n, -1)
    # single linkage: node n + i joins two nodes at w
    parent = list(range(2 * n - 1))
    size, left, right, dist = [1] * (2 * n - 1), [-1] * (2 * n - 1), [-1] * (2 * n - 1), [0.0] * (2 * n - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    new = n
    order = np.argsort(w, kind="stable")
    for x, y, d in zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = parent[q] = new
            left[new], right[new], dist[new], size[new] = p, q, d, size[p] + size[q]
            new += 1
    if new != 2 * n - 1:
        raise ValueError("the edges do not span the points")

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += [left[j], right[j]]
        return out

    # condense: (first node, birth); points that fall out, with the density at which they do
    births, children, fallen = [0.0], [[]], [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while True:
            if node < n:
                fallen[c].append((node, np.inf))
                break
            density = 1 / dist[node] if dist[node] > 0 else np.inf
            parts, joined = [], [left[node], right[node]]
            while joined:
                part = joined.pop()
                if part >= n and dist[part] == dist[node]:
                    joined += [left[part], right[part]]
                else:
                    parts.append(part)
            large = [part for part in parts if size[part] >= least]
            fallen[c] += [(i, density) for part in parts if size[part] < least for i in leaves(part)]
            if len(large) > 1:
                for child in large:
                    births.append(density)
                    children.append([])
                    fallen.append([])
                    children[c].append(len(births) - 1)
                    todo.append((child, len(births) - 1))
                break
            if not large:
                break
            node = large[0]
    count = len(births)
    members = [len(f) for f in fallen]
    for c in range(count - 1, -1, -1):
        members[c] += sum(members[k] for k in children[c])
    finite = max((d for f in fallen for _, d in f if np.isfinite(d)), default=1.0)
    clip = lambda d: d if np.isfinite(d) else finite
    mass = [math.fsum([clip(d) - clip(births[c]) for _, d in fallen[c]] + [members[k] * (clip(births[k]) - clip(births[c])) for k in children[c]]) for c in range(count)]
    chosen = [False] * count
    if method == "leaf":
        chosen = [not children[c] and c > 0 for c in range(count)]
    else:
        for c in range(count - 1, 0, -1):
            below = math.fsum(mass[k] for k in children[c])
            if children[c] and below > mass[c]:
                mass[c] = below
            else:
                chosen[c] = True
    found, todo = [], list(children[0])
    while todo:  # the topmost chosen ones
        c = todo.pop()
        if chosen[c]:
            found.append(c)
        else:
            todo += children[c]
    groups = []
    for c in found:
        own, todo = [], [c]
        while todo:
            k = todo.pop()
            own += [i for i, _ in fallen[k]]
            todo += children[k]
        groups.append(sorted(own))
    for k, own in enumerate(sorted(groups)):
        labels[own] = k
    return labels
