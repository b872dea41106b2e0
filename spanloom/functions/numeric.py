"""Numeric columns and small numeric models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 0.025


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def ratio(a: Column, b: Column) -> Column:
    """a over b, with b taken as 1 at least."""
    return a / F.greatest(F.lit(1.0), b)


def quantised(x: Column, step: float = STEP) -> Column:
    """To a multiple of step, halves to even."""
    return F.rint(x / step) * step


def piecewise(x: Column, lo: Column, hi: Column, step: float = STEP) -> Column:
    """0 to lo goes to 0 to 0.25, lo to hi to 0.25 to 1, beyond hi a quarter of x / hi above 0.75; odd in x; quantised."""
    v = F.abs(x)
    y = F.when(v <= lo, ratio(v, lo) * 0.25).when(v > hi, ratio(v, hi) * 0.25 + 0.75).otherwise(0.25 + (v - lo) / (hi - lo) * 0.75)
    return quantised(F.when(x < 0, -y).otherwise(y), step)


def welch_z(m1: Column, s1: Column, n1: Column, m2: Column, s2: Column, n2: Column) -> Column:
    """Difference of means over its error; an error of 0 counts as 1; null without values."""
    se = F.sqrt(s1 * s1 / n1 + s2 * s2 / n2)
    return F.when((n1 > 0) & (n2 > 0), (m1 - m2) / F.when(se == 0, 1.0).otherwise(se))


def phred_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def error_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def stutter_kernel(length: int, rates: dict[int, float], floor: float = 1e-6) -> dict[int, float]:
    """Observed length by probability for a true length, from rates of change in units, normalised."""
    p = {max(0, length + d): max(floor, r) for d, r in rates.items()}
    p.setdefault(length, max(floor, 1 - sum(rates.values())))
    total = sum(p.values())
    return {k: v / total for k, v in sorted(p.items())}


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that makes |a x - b| smallest, by the active-set method of Lawson and Hanson (1974)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        if free.all() or (pull[~free] <= 1e-10).all():
            break
        free[np.argmax(np.where(free, -np.inf, pull))] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (z <= 0)
            if not low.any():
                x = z
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def diploid_likelihood(counts: dict[int, int], first: dict[int, float], second: dict[int, float], floor: float = 1e-9) -> float:
    """Log likelihood of observed lengths when reads come from two alleles alike."""
    return sum(n * math.log(max(floor, 0.5 * first.get(k, 0) + 0.5 * second.get(k, 0))) for k, n in counts.items())


def correction_posterior(target: np.ndarray, other: np.ndarray, error: float = 0.01, grid: int = 20) -> np.ndarray:
    """Posterior of seven accounts of a site's base counts: one of four bases alone, or a mixture led by the first,
    second or third of the two most counted bases with the share averaged over a grid.

    target, other: counts of A, C, G, T from the target's own and from flanking reads.
    """
    n = np.asarray(target, float) + 0.5 * np.asarray(other, float)
    order = np.argsort(-n, kind="stable")
    logs = []
    for b in range(4):
        p = np.full(4, error / 3)
        p[b] = 1 - error
        logs.append(float(n @ np.log(p)))
    shares = (np.arange(grid) + 0.5) / grid
    for i, j in ((0, 1), (0, 2), (1, 2)):
        each = []
        for w in shares:
            p = np.full(4, error / 3)
            p[order[i]] += w * (1 - error)
            p[order[j]] += (1 - w) * (1 - error)
            each.append(float(n @ np.log(p / p.sum())))
        top = max(each)
        logs.append(top + math.log(np.mean(np.exp(np.array(each) - top))))
    x = np.exp(np.array(logs) - max(logs))
    return x / x.sum()
