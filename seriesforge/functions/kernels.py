"""Numpy kernels used inside Arrow batches."""

from __future__ import annotations

import numpy as np


def dtw(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> np.ndarray:
    """DTW distance of row pairs (m, n) and (m, p) with an optional Sakoe-Chiba band."""
    m, n = a.shape
    p = b.shape[1]
    r = max(n, p) if radius is None else max(radius, abs(n - p))
    inf = np.full(m, np.inf)
    prev = [np.zeros(m)] + [inf] * p
    for i in range(1, n + 1):
        cur = [inf] * (p + 1)
        for j in range(max(1, i - r), min(p, i + r) + 1):
            d = a[:, i - 1] - b[:, j - 1]
            cur[j] = d * d + np.minimum(np.minimum(prev[j], cur[j - 1]), prev[j - 1])
        prev = cur
    return np.sqrt(prev[p])


def dtw_path(a: np.ndarray, b: np.ndarray, radius: int | None = None) -> list[tuple[int, int]]:
    """Optimal index path of one pair."""
    n, p = len(a), len(b)
    r = max(n, p) if radius is None else max(radius, abs(n - p))
    cost = np.full((n + 1, p + 1), np.inf)
    cost[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(max(1, i - r), min(p, i + r) + 1):
            cost[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    i, j, path = n, p, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        step = np.argmin([cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]])
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return path[::-1]


def envelopes(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise sliding maxima and minima."""
    pad_hi = np.pad(x, ((0, 0), (radius, radius)), constant_values=-np.inf)
    pad_lo = np.pad(x, ((0, 0), (radius, radius)), constant_values=np.inf)
    win = lambda z: np.lib.stride_tricks.sliding_window_view(z, 2 * radius + 1, axis=1)
    return win(pad_hi).max(-1), win(pad_lo).min(-1)


def lb_matrix(q: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Keogh lower bound of every query row against every envelope row."""
    out = np.empty((len(q), len(upper)))
    for i, row in enumerate(q):
        over, under = np.maximum(row - upper, 0), np.maximum(lower - row, 0)
        out[i] = np.sqrt((over * over + under * under).sum(1))
    return out


def nearest_rows(q: np.ndarray, b: np.ndarray, k: int, metric: str, allowed, radius: int | None = None):
    """Top-k base rows of each query: (query row, base row, distance); ``allowed(i)`` masks base rows."""
    out = []
    if metric == "l2":
        sq_b = (b * b).sum(1)
    if metric == "dtw":
        upper, lower = envelopes(b, b.shape[1] if radius is None else radius)
    if metric == "lb_keogh":
        upper, lower = envelopes(b, radius or 1)
    for i, row in enumerate(q):
        ok = np.flatnonzero(allowed(i))
        if not len(ok):
            continue
        kk = min(k, len(ok))
        if metric == "l2":
            rough = sq_b[ok] - 2 * b[ok] @ row
            cut = np.partition(rough, kk - 1)[kk - 1]
            ok = ok[rough <= cut + 1e-9 * (1 + abs(cut) + row @ row)]
            d = np.sqrt(((b[ok] - row) ** 2).sum(1))
        elif metric == "l1":
            d = np.abs(b[ok] - row).sum(1)
        elif metric == "lb_keogh":
            d = lb_matrix(row[None], upper[ok], lower[ok])[0]
        else:
            lb = lb_matrix(row[None], upper[ok], lower[ok])[0]
            order = np.argsort(lb, kind="stable")
            ok, lb = ok[order], lb[order]
            best, idx = np.empty(0), np.empty(0, int)
            for s in range(0, len(ok), 64):
                # The bound never exceeds the distance, so the rest cannot enter the top k.
                if len(best) >= kk and lb[s] > np.sort(best)[kk - 1]:
                    break
                part = ok[s:s + 64]
                dd = dtw(np.repeat(row[None], len(part), 0), b[part], radius)
                best, idx = np.concatenate([best, dd]), np.concatenate([idx, part])
            ok, d = idx, best
        yield i, ok, d
    return out


def rough_l1(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L1 distances of all row pairs in single precision where that holds them, and how far off each row may be."""
    q1, b1 = np.abs(q).sum(1), np.abs(b).sum(1).max(initial=0.0)
    kind = np.float32 if max(q1.max(initial=0.0), b1) < 1e30 else np.float64
    qt, bt, out = q.T.astype(kind), b.T.astype(kind), np.zeros((len(q), len(b)), kind)
    for s in range(0, len(b), 1024):
        acc, part = out[:, s:s + 1024], np.empty((len(q), len(b[s:s + 1024])), kind)
        for x, y in zip(qt, bt[:, s:s + 1024]):
            np.subtract(y[None], x[:, None], out=part)
            np.abs(part, out=part)
            acc += part
    return out, (q.shape[1] + 4) * 2 * np.finfo(kind).eps * (q1 + b1)


def near_pairs(q: np.ndarray, b: np.ndarray, k: int, metric: str, banned, bound: np.ndarray | None = None, cells: int = 1 << 21):
    """(query rows, base rows, distances) among which are the k nearest allowed base rows of each query, if they lie within its
    ``bound``; ``banned(lo, hi)`` masks base rows of a stretch of queries, None for no mask.

    Rough distances of many queries at once leave the few pairs whose exact distance is worked out.
    """
    found: list[tuple] = []
    b2 = (b * b).sum(1) if metric == "l2" else None
    step = max(1, min(cells // max(1, len(b)), 256))
    for lo in range(0, len(q), step):
        x = q[lo:lo + step]
        if metric == "l2":
            x2 = (x * x).sum(1)
            rough = b2 - 2 * (x @ b.T)
            off = 1e-9 * (1 + x2)
        else:
            rough, off = rough_l1(x, b)
        out = banned(lo, lo + len(x))
        if out is not None:
            rough[out] = np.inf
        top = np.full(len(x), np.inf)
        if bound is not None:
            own = bound[lo:lo + step] * (1 + 1e-9)
            top = own * own * (1 + 1e-9) - x2 + off if metric == "l2" else own + off
        hits = rough <= top[:, None]
        many = np.flatnonzero(hits.sum(1) > 4 * k) if len(b) > k else np.empty(0, int)
        if len(many):
            cut = np.partition(rough[many], k - 1, axis=1)[:, k - 1].astype(float)
            slack = off[many] + 1e-9 * np.abs(np.where(np.isfinite(cut), cut, 0.0)) if metric == "l2" else 2 * off[many]
            hits[many] &= rough[many] <= (cut + slack)[:, None]
        hits &= rough < np.inf
        i, j = np.nonzero(hits)
        for s in range(0, len(i), 1 << 16):
            gap = b[j[s:s + (1 << 16)]] - x[i[s:s + (1 << 16)]]
            d = np.sqrt((gap * gap).sum(1)) if metric == "l2" else np.abs(gap).sum(1)
            found.append((lo + i[s:s + (1 << 16)], j[s:s + (1 << 16)], d))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def dtw_within(a: np.ndarray, b: np.ndarray, radius: int, limit: np.ndarray) -> np.ndarray:
    """DTW distance of row pairs of one length as ``dtw`` gives it, infinite where it is above the pair's ``limit``.

    A row of the band is worked out for all pairs at once; pairs leave when every path is above their limit.
    """
    m, n = a.shape
    r, out = min(radius, n), np.full(m, np.inf)
    at, most = np.arange(m), limit * limit * (1 + 1e-9)
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    prev, cur = np.full((n + 1, m), np.inf), np.full((n + 1, m), np.inf)
    prev[0] = 0.0
    for i in range(1, n + 1):
        lo, hi = max(1, i - r), min(n, i + r)
        cur[lo - 1] = np.inf                                # of an earlier row; the place after the band was never reached
        d = y[lo - 1:hi] - x[i - 1]
        d *= d
        low = np.minimum(prev[lo:hi + 1], prev[lo - 1:hi])
        for j in range(lo, hi + 1):
            np.minimum(low[j - lo], cur[j - 1], out=cur[j])
            cur[j] += d[j - lo]
        prev, cur = cur, prev
        if i % 8 == 0 and i < n:
            go = prev[lo:hi + 1].min(0) <= most
            if go.mean() < 0.75:
                at, most, x, y, prev, cur = at[go], most[go], x[:, go], y[:, go], prev[:, go], cur[:, go]
                if not len(at):
                    return out
    d = np.sqrt(prev[n])
    out[at] = np.where(prev[n] <= most, d, np.inf)
    return out


def rough_dtw(x: np.ndarray, y: np.ndarray, radius: int, most: np.ndarray, banned: np.ndarray | None = None):
    """(column of x, column of y, squared DTW distance) of all pairs of columns (n, m) and (n, p) whose sum stays within the
    ``most`` of the column of x, in the precision of the columns.

    A row of the band is worked out for all pairs at once; pairs leave when every path is above their limit.
    """
    n, shape = len(x), (x.shape[1], y.shape[1])
    i, j = None, None                                       # pairs by number once some have left; a whole grid before
    wide = min(2 * radius + 1, n)
    prev, cur, gaps, lows = (np.empty((rows, *shape), x.dtype) for rows in (n + 1, n + 1, wide, wide))
    prev[:min(n, radius + 1) + 1] = np.inf
    prev[0] = 0.0 if banned is None else np.where(banned, np.inf, 0.0)
    left, right, limit, gone = x[:, :, None], y[:, None, :], most[:, None], 0
    for k in range(1, n + 1):
        lo, hi = max(1, k - radius), min(n, k + radius)
        cur[lo - 1] = np.inf                                # the places beside the band were never reached
        if k > 1 and hi == k + radius:
            prev[hi] = np.inf
        d = np.subtract(right[lo - 1 - gone:hi - gone], left[k - 1 - gone], out=gaps[:hi - lo + 1])
        d *= d
        low = np.minimum(prev[lo:hi + 1], prev[lo - 1:hi], out=lows[:hi - lo + 1])
        for c in range(lo, hi + 1):
            np.minimum(low[c - lo], cur[c - 1], out=cur[c])
            cur[c] += d[c - lo]
        prev, cur = cur, prev
        if k == n or (k % 4 == 0 and 3 * k >= n):
            go = (prev[lo:hi + 1].min(0) if k < n else prev[n]) <= limit
            if k < n and np.count_nonzero(go) > 0.5 * go.size:
                continue
            at = np.flatnonzero(go)
            i, j = np.divmod(at, shape[1]) if i is None else (i[at], j[at])
            if k == n or not len(i):
                return i, j, prev[n].reshape(-1)[at] if k == n else np.empty(0, x.dtype)
            kept, gone, limit = np.take(prev[lo - 1:hi + 1].reshape(hi - lo + 2, -1), at, axis=1), max(0, lo - 1), most[i]
            left, right = np.take(x[gone:], i, axis=1), np.take(y[gone:], j, axis=1)
            prev, cur, gaps, lows = (np.empty((rows, len(i)), x.dtype) for rows in (n + 1, n + 1, wide, wide))
            prev[lo - 1:hi + 1] = kept


def near_dtw(q: np.ndarray, b: np.ndarray, k: int, banned: np.ndarray | None, radius: int | None = None, batch: int = 768):
    """``near_pairs`` for DTW of rows of one length.  Rough sums of many pairs at once, in single precision, run until
    they pass the k-th least that a query has met, first among rows near by their straight distance; what may be among the k
    least is worked out in batches."""
    n = q.shape[1]
    r = n if radius is None else min(radius, n)
    size = max(np.abs(x).max(initial=0.0, where=np.isfinite(x)) for x in (q, b))
    unit = 2.0 ** np.frexp(size)[1] if size > 0 else 1.0     # rough sums are of values below 1
    eps = float(np.finfo(np.float32).eps)
    # a rough sum s is off by rounding of its terms and of the 2 n values under them
    above = lambda s: s * (1 + 8 * n * eps) + 4 * eps * np.sqrt(2 * n * s) + 8 * n * eps * eps
    qt, bt = (np.ascontiguousarray((x.T / unit).astype(np.float32)) for x in (q, b))
    groups = [(np.arange(len(q)), np.arange(len(b)), None)]
    if banned is not None:
        _, lead, which = np.unique(np.packbits(banned, axis=1), axis=0, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        groups = [(np.flatnonzero(which == g), np.flatnonzero(~banned[f]), None) for g, f in enumerate(lead)] if 8 * len(lead) <= len(q) else [(*groups[0][:2], banned)]
    together = max(2048, min(1 << 14, (1 << 18) // min(2 * r + 1, n)))
    first = k + 15                                          # rows nearest by their straight distance give a first limit
    left: list[tuple] = []

    def exact(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.concatenate([dtw_within(q[i[s:s + batch]], b[j[s:s + batch]], r, most[s:s + batch]) for s in range(0, len(i), batch)] or [np.empty(0)])

    for rows, cols, mask in groups:
        if not len(cols):
            continue
        own = np.ascontiguousarray(bt[:, cols])
        wide = min(len(cols), together)
        tall = max(1, together // wide)
        top = np.full(len(rows), np.inf)
        if len(cols) > 4 * first:
            full = b[cols]
            sq = (full * full).sum(1)
            seeds = np.empty((len(rows), first), int)
            for s in range(0, len(rows), 64):
                straight = sq - 2 * (q[rows[s:s + 64]] @ full.T)
                if mask is not None:
                    straight[mask[s:s + 64]] = np.inf
                seeds[s:s + 64] = np.argpartition(straight, first - 1, axis=1)[:, :first]
            d = exact(np.repeat(rows, first), cols[seeds.reshape(-1)], np.full(seeds.size, np.inf)).reshape(seeds.shape)
            if mask is not None:
                d[np.take_along_axis(mask, seeds, axis=1)] = np.inf
            top = (np.partition(d, k - 1, axis=1)[:, k - 1] / unit) ** 2
        for s in range(0, len(rows), tall):
            at, now = rows[s:s + tall], top[s:s + tall]
            x = np.ascontiguousarray(qt[:, at])
            i, j, d = np.empty(0, int), np.empty(0, int), np.empty(0)
            for c in range(0, len(cols), wide):
                most = above(np.minimum(now, 1e30)).astype(np.float32)
                more = rough_dtw(x, own[:, c:c + wide], r, most, None if mask is None else mask[s:s + tall, c:c + wide])
                i, j, d = (np.concatenate(z) for z in zip((i, j, d), (more[0], more[1] + c, more[2].astype(float))))
                for z in np.unique(i):
                    mine = d[i == z]
                    if len(mine) >= k:
                        now[z] = min(now[z], above(np.partition(mine, k - 1)[k - 1]))
                fine = np.isfinite(d) & (d <= above(now)[i])
                i, j, d = i[fine], j[fine], d[fine]
            left.append((at[i], cols[j], unit * np.sqrt(above(now))[i]))
    if not left:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    i, j, top = (np.concatenate(c) for c in zip(*left))
    d = exact(i, j, top)
    return i[d < np.inf], j[d < np.inf], d[d < np.inf]


def near_keogh(q: np.ndarray, b: np.ndarray, k: int, banned: np.ndarray | None, radius: int, tile: int = 64):
    """``near_pairs`` for the Keogh bound, with rough sums by column and exact bounds of the rows that may be among the k least."""
    upper, lower = envelopes(b, radius)
    ut, lt = np.ascontiguousarray(upper.T), np.ascontiguousarray(lower.T)
    found: list[tuple] = []
    for lo in range(0, len(q), tile):
        x = q[lo:lo + tile].T
        rough = np.zeros((x.shape[1], len(b)))
        for s in range(0, len(b), 1024):
            acc = rough[:, s:s + 1024]
            over, under = np.empty(acc.shape), np.empty(acc.shape)
            for v, u, w in zip(x, ut[:, s:s + 1024], lt[:, s:s + 1024]):
                np.subtract(v[:, None], u[None], out=over)
                np.subtract(w[None], v[:, None], out=under)
                np.maximum(over, under, out=over)
                np.maximum(over, 0, out=over)
                np.multiply(over, over, out=over)
                acc += over
        if banned is not None:
            rough[banned[lo:lo + tile]] = np.inf
        cut = np.partition(rough, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
        i, j = np.nonzero((rough <= (cut * (1 + 1e-9) + 1e-300)[:, None]) & (rough < np.inf))
        over, under = np.maximum(q[lo + i] - upper[j], 0), np.maximum(lower[j] - q[lo + i], 0)
        found.append((lo + i, j, np.sqrt((over * over + under * under).sum(1))))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))
