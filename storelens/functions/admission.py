"""Exact admission by a sliding window, folded over arrays of request times."""

from __future__ import annotations

import numpy as np


def admit(times: np.ndarray, prior: np.ndarray, limit: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decide requests in order of ``times`` (ascending): one is admitted if fewer
    than ``limit`` admitted ones lie in (time - window, time].

    ``prior`` has the latest admitted times before (at most ``limit`` count).
    Returns which are admitted, how many admitted ones lie in each request's
    window after its decision, and the new ``prior``.

    A request competes with the admitted one ``limit`` places before, so the
    next ``limit`` requests are decided at once; a refusal lasts until that one
    leaves the window; and while no request has ``limit`` requests of any kind in
    its window, all go in.
    """
    n = len(times)
    held = np.empty(len(prior) + n, dtype=np.int64)
    held[:len(prior)] = prior
    m, ok, i = len(prior), np.zeros(n, dtype=bool), 0
    # requests that the raw rate alone doesn't let in
    crowded = np.flatnonzero(times[limit:] - times[:max(n - limit, 0)] < window) + limit
    since = 0  # where the present row of admitted requests began
    while i < n:
        if i - since >= limit:
            k = np.searchsorted(crowded, i)
            j = int(crowded[k]) if k < len(crowded) else n
            if j > i:
                held[m:m + j - i] = times[i:j]
                ok[i:j] = True
                m, i = m + j - i, j
                continue
        size = min(limit, n - i)
        old = np.arange(m - limit, m - limit + size)
        free = (old < 0) | (held[np.maximum(old, 0)] <= times[i:i + size] - window)
        k = size if free.all() else int(np.argmin(free))
        held[m:m + k] = times[i:i + k]
        ok[i:i + k] = True
        m, i = m + k, i + k
        if k < size:
            i = int(np.searchsorted(times, held[m - limit] + window))
            since = i
    inside = len(prior) + np.cumsum(ok) - np.searchsorted(held[:m], times - window, side="right")
    return ok, inside, held[max(m - limit, 0):m].copy()
