"""What results must satisfy, stated pair by pair, to check the jobs against."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

HOUR = 3_600_000_000


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = [0]
        for j, y in enumerate(b):
            last.append(row[j] + 1 if x == y else max(row[j + 1], last[j]))
        row = last
    return row[-1]


def ratio(a: str, b: str) -> float:
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def near(t: int | None, u: int | None, hours: float) -> bool:
    return t is not None and u is not None and abs(t - u) <= hours * HOUR


def check_best_earlier(found: dict, rows: list, score, threshold: float, hours: float, only=lambda i: True) -> None:
    """`found` maps an id to (partner, score); rows are (id, micros or None, value).

    A partner arrived earlier, lies within the window and has the score that is
    stated; nobody who could be a partner has a better score, or as good a one and
    a lower id; and who has no partner could not have one.
    """
    value, time = {i: v for i, _, v in rows}, {i: t for i, t, _ in rows}
    able: dict = {i: {} for i in time}
    for i, j in combinations(sorted(time), 2):
        if near(time[i], time[j], hours) and (s := score(value[j], value[i])) >= threshold:
            able[j][i] = s
    assert set(found) == {i for i in time if able[i] and only(i)}
    for i, (partner, stated) in found.items():
        assert stated == pytest.approx(able[i][partner])
        assert all(s < stated + 1e-9 and (s < stated - 1e-9 or j >= partner) for j, s in able[i].items())


def check_duplicates(found: dict, rows: list, hours: float = 6, threshold: float = 65, only=lambda i: True) -> None:
    check_best_earlier(found, rows, ratio, threshold, hours, only)


def cosine(a, b) -> float:
    x, y = np.asarray(a, float), np.asarray(b, float)
    return float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def title_pairs(rows, hours=6, threshold=40):
    ordered = sorted((t, i, s) for i, t, s in rows if t is not None)
    return {
        (a[1], b[1]): ratio(a[2], b[2])
        for a, b in combinations(ordered, 2)
        if b[0] - a[0] <= hours * HOUR and ratio(a[2], b[2]) > threshold
    }
