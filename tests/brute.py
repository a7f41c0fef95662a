"""Plain models of the imaging operators on small arrays, to test against."""

import numpy as np

MOVES = ((-1, 0), (1, 0), (0, -1), (0, 1))


def components(on):
    out, k = np.zeros(on.shape, int), 0
    for i, j in np.ndindex(on.shape):
        if on[i, j] and not out[i, j]:
            k += 1
            todo = [(i, j)]
            out[i, j] = k
            while todo:
                a, b = todo.pop()
                for r, c in ((a + x, b + y) for x, y in MOVES):
                    if 0 <= r < on.shape[0] and 0 <= c < on.shape[1] and on[r, c] and not out[r, c]:
                        out[r, c] = k
                        todo.append((r, c))
    return out


def fill(on):
    off = components(1 - on)
    outside = set(off[0]) | set(off[-1]) | set(off[:, 0]) | set(off[:, -1])
    return np.where((off > 0) & ~np.isin(off, list(outside)), 1, on)


def grow(labels, steps, allowed=None):
    for _ in range(steps):
        new = labels.copy()
        for i, j in np.ndindex(labels.shape):
            if labels[i, j] or (allowed is not None and not allowed[i, j]):
                continue
            near = [labels[i + x, j + y] for x, y in MOVES if 0 <= i + x < labels.shape[0] and 0 <= j + y < labels.shape[1] and labels[i + x, j + y]]
            if near:
                new[i, j] = min(set(near), key=lambda v: (-near.count(v), v))
        if (new == labels).all():
            break
        labels = new
    return labels


def distance(on):
    at = np.argwhere(on)
    return np.array([[min(abs(i - a) + abs(j - b) for a, b in at) for j in range(on.shape[1])] for i in range(on.shape[0])])


def seeds(on, h):
    d = distance(on)
    far = d.max() + 1
    return components(((far - d) > far * h).astype(int))


def morph(on, size, f):
    h, out = size // 2, np.zeros_like(on)
    for i in range(h, on.shape[0] - h):
        for j in range(h, on.shape[1] - h):
            out[i, j] = f(on[i - h : i + h + 1, j - h : j + h + 1])
    return out


def otsu(a):
    lo, hi = a.min(), a.max()
    if lo == hi:
        return lo
    w = (hi - lo) / 256
    b = np.clip(np.ceil((a.ravel() - lo) / w - 1e-7), 1, 256).astype(int)
    n = np.bincount(b, minlength=257)[1:]
    mid = lo + (np.arange(256) + 0.5) * w
    best, at = -np.inf, mid[0]
    for i in range(256):
        wb, wf = n[: i + 1].sum(), n[i + 1 :].sum()
        if wb == 0:
            continue
        if wf == 0:
            break
        v = wb * wf * ((n[: i + 1] * mid[: i + 1]).sum() / wb - (n[i + 1 :] * mid[i + 1 :]).sum() / wf) ** 2
        if v > best + 1e-9:
            best, at = v, mid[i]
    return at


def by_area(labels, low, high):
    out, k = np.zeros_like(labels), 0
    for v in sorted(set(labels.ravel()) - {0}):
        if low <= (labels == v).sum() <= high:
            k += 1
            out[labels == v] = k
    return out


def resample(a, s):
    n, m = (max(1, int(np.round(x * s))) for x in a.shape)
    out = np.zeros((n, m))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            r, c = (i - 0.5) / s + 0.5, (j - 0.5) / s + 0.5
            r0, c0 = max(1, int(np.floor(r))), max(1, int(np.floor(c)))
            r1, c1 = min(a.shape[0], r0 + 1), min(a.shape[1], c0 + 1)
            x, y = r - r0, c - c0
            out[i - 1, j - 1] = (1 - x) * (1 - y) * a[r0 - 1, c0 - 1] + x * (1 - y) * a[r1 - 1, c0 - 1] + (1 - x) * y * a[r0 - 1, c1 - 1] + x * y * a[r1 - 1, c1 - 1]
    return out


def square(shape, *cells):
    """Labels k on rows and columns a..b (from 1, inclusive) of an empty mask."""
    out = np.zeros(shape, int)
    for a, b, k in cells:
        out[a - 1 : b, a - 1 : b] = k
    return out


def hull(x, y):
    """Corners by a monotone chain from the least point on."""
    points = sorted(set(zip(x.tolist(), y.tolist())))
    if len(points) < 3:
        return points

    def half(ps):
        chain = []
        for p in ps:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(points) + half(points[::-1])
