"""Array kernels of the stateful operators: one key's rows, no loop per row."""

from __future__ import annotations

import numpy as np
import pandas as pd

from vigil.functions import idor as X


def codes_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers for equal values; -1 for null."""
    return pd.factorize(values)[0]


def _next_equal(codes: np.ndarray) -> np.ndarray:
    """Position of the next row with the same code; the number of rows if there is none."""
    order = np.argsort(codes, kind="stable")
    after = np.full(len(codes), len(codes))
    same = codes[order[1:]] == codes[order[:-1]]
    after[order[:-1][same]] = order[1:][same]
    return after


def _extremes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, fn) -> np.ndarray:
    """``fn`` (np.minimum or np.maximum) over every non-empty range lo..hi, by ranges of powers of two."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(fn(levels[-1][:-half], levels[-1][half:]))
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.empty(len(lo), values.dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = fn(levels[k][lo[at]], levels[k][hi[at] - 2**k])
    return out


def window_verdicts(
    ts: np.ndarray, resource: np.ndarray, number: np.ndarray, w_us: int, threshold: int, gap: int
) -> dict[str, np.ndarray]:
    """The verdict of every row over the rows of ``[ts - w, ts]``; rows stand in order of time.

    ``number`` is the resource's numeric id as a float column with NaN for none (exact up to 2^53).
    A row of a resource covers the time from itself to the resource's next row or the end of its
    window, so each resource in a window is covered once.
    """
    n = len(ts)
    lo, hi = np.searchsorted(ts, ts - w_us), np.searchsorted(ts, ts, side="right")
    codes = codes_of(resource)
    after = _next_equal(codes)
    begins = np.searchsorted(ts, ts)
    ends = np.searchsorted(ts, ts + w_us, side="right")
    has_next = after < n
    ends[has_next] = np.minimum(ends[has_next], begins[after[has_next]])

    def covered(rows: np.ndarray) -> np.ndarray:
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, begins[rows], 1)
        np.add.at(change, ends[rows], -1)
        return np.cumsum(change[:n])

    known = codes >= 0
    numeric = known & ~np.isnan(number)
    d, n_num = covered(np.flatnonzero(known)), covered(np.flatnonzero(numeric))
    least = _extremes(np.where(numeric, number, np.inf), lo, hi, np.minimum)
    largest = _extremes(np.where(numeric, number, -np.inf), lo, hi, np.maximum)
    with np.errstate(invalid="ignore"):
        seq = (d >= 3) & (n_num >= 3) & (largest - least <= gap * (n_num - 1))
    severity = np.select(
        [d < 2, d == 2, (d >= threshold) & seq], [X.LOG_ONLY, X.ALERT_LOW, X.CRITICAL], X.ALERT_MEDIUM
    ).astype(object)
    return {
        "lo": lo, "hi": hi, "win_distinct": d, "win_count": hi - lo, "is_sequential": seq, "severity": severity,
        "has_event": (d >= threshold) & (d >= 3), "span_us": ts - ts[lo],
    }


def apart(keys: np.ndarray, ts: np.ndarray, w_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (key, time), and in it a time line on which every key has a stretch of its
    own: distances of one key's rows stay, rows of two keys are more than ``w_us`` apart."""
    codes = codes_of(keys)
    order = np.lexsort((ts, codes))
    code, t = codes[order], ts[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    sizes = np.diff(np.r_[first, len(code)])
    span = t[first + sizes - 1] - t[first] + w_us + 1
    return order, t + np.repeat(np.cumsum(span) - span - t[first], sizes)


def touched(ts: np.ndarray, arrived: np.ndarray, w_us: int) -> np.ndarray:
    """Rows in whose window ``[ts - w, ts]`` something arrived."""
    arrived = np.sort(arrived)
    return np.searchsorted(arrived, ts, side="right") > np.searchsorted(arrived, ts - w_us)


def owned_at(
    probe_ts: np.ndarray,
    probe_resource: np.ndarray,
    rec_ts: np.ndarray,
    rec_resource: np.ndarray,
    base: dict[str, int],
    base_last: int | None,
    base_gap: int | None,
    ttl_us: int,
) -> np.ndarray:
    """Whether each probe of one user is owned at its instant.

    Records stand in order of time. ``base`` has the last record before them of the probed
    resources, ``base_last`` the user's last one, ``base_gap`` the last one that began a set anew.
    """
    if not len(probe_ts):
        return np.zeros(0, bool)
    never = np.iinfo(np.int64).min // 2
    last_before = never if base_last is None else base_last
    prev = np.r_[last_before, rec_ts[:-1]] if len(rec_ts) else rec_ts
    began = np.maximum.accumulate(np.r_[never if base_gap is None else base_gap, np.where(rec_ts - prev >= ttl_us, rec_ts, never)])
    latest = np.r_[last_before, rec_ts]
    at = np.searchsorted(rec_ts, probe_ts, side="right")  # records at or before the probe
    alive = probe_ts - latest[at] < ttl_us
    # the resource's last record: records and probes in one order of (resource, time)
    codes = codes_of(np.concatenate([rec_resource, probe_resource]).astype(object))
    rec_code, probe_code = codes[: len(rec_ts)], codes[len(rec_ts) :]
    order = np.lexsort((rec_ts, rec_code))
    times = np.unique(np.concatenate([rec_ts, probe_ts]))
    key = lambda c, t: c.astype(np.int64) * (len(times) + 1) + np.searchsorted(times, t)
    place = np.searchsorted(key(rec_code, rec_ts)[order], key(probe_code, probe_ts), side="right") - 1
    found = np.array([base.get(r, never) if r is not None else never for r in probe_resource], np.int64)
    if len(rec_ts):
        row = order[np.maximum(place, 0)]
        here = (place >= 0) & (rec_code[row] == probe_code) & (probe_code >= 0)
        found = np.where(here, rec_ts[row], found)
    return alive & (found > never) & (found >= began[at])
