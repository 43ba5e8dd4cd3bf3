"""Row-local expressions, Column to Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def shrunk_rate(n: Column, rate: Column, strength: float, prior: float | Column) -> Column:
    """(n * rate + strength * prior) / (n + strength); a null count is 0, a null rate the prior."""
    prior = F.lit(prior) if not isinstance(prior, Column) else prior
    count = F.coalesce(n, F.lit(0))
    return (count * F.coalesce(rate, prior) + strength * prior) / (count + strength)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bounded_step(base: Column, raw: Column, weight: float, cap: float) -> Column:
    """The bounded additive correction: base moved by weight * cap * tanh(raw), within [0, 1]."""
    return clip(base + weight * cap * F.tanh(raw), 0.0, 1.0)


def equal_width_bin(x: Column, width: float) -> Column:
    """floor(x / width); null is bin -1."""
    return F.when(x.isNull(), F.lit(-1)).otherwise(F.floor(x / width).cast("int"))


def truncated_bin(x: Column, low: float, width: float, last: int) -> Column:
    """int((x - low) / width), cut off toward zero, within 0 and `last`."""
    return F.least(F.greatest(((x - low) / width).cast("int"), F.lit(0)), F.lit(last))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """The first i with x <= edges[i]; beyond the last edge len(edges); null stays null."""
    out = F.when(x.isNull(), None)
    for i, e in enumerate(edges):
        out = out.when(x <= e, i)
    return out.otherwise(len(edges))


def left_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """How many edges are at most x."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x))


def last_rule_wins(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """Label by the last pattern that matches the lower-cased text."""
    out = None
    for pattern, label in reversed(rules):
        hit = F.lower(text).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def packed_key(parts: Sequence[tuple[Column, int]]) -> Column:
    """Mixed-radix key of (value, radix) pairs; a value outside its radix is an error."""
    key = F.lit(0)
    for value, radix in parts:
        inside = F.when((value >= 0) & (value < radix), value).otherwise(F.raise_error(F.lit("value outside its domain")))
        key = key * radix + inside.cast("int")
    return key


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts; 0 for no counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    weighed = F.aggregate(counts, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(total > 0, F.ln(total) - weighed / total).otherwise(0.0)


def harmonics(day: Column, period: float, orders: Sequence[int] = (1, 2)) -> dict[str, Column]:
    """sin and cos of a day number at multiples of 2 pi / period."""
    angle = 2 * 3.141592653589793 / period
    return {f"{f}{k}": getattr(F, f)(day * (angle * k)) for k in orders for f in ("sin", "cos")}


def dot(x: Column, weights: Column) -> Column:
    """Sum of products of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def pairwise_products(x: Column) -> Column:
    """Sum over all pairs i < j of x_i * x_j, by the power sums."""
    s1 = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    s2 = F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b)
    return (s1 * s1 - s2) / 2


def triple_products(x: Column) -> Column:
    """Sum over all triples i < j < k of products, by the power sums."""
    s1 = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    s2 = F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b)
    s3 = F.aggregate(x, F.lit(0.0), lambda a, b: a + b * b * b)
    return (s1 * s1 * s1 - 3 * s1 * s2 + 2 * s3) / 6


def piecewise_codes(x: Column, knots: Sequence[float]) -> list[Column]:
    """How far x has passed each interval between neighbouring knots, from 0 to 1; null stays null."""
    return [clip((x - a) / (b - a), 0.0, 1.0) for a, b in zip(knots, knots[1:])]


def spline_basis(x: Column, inner: Sequence[float], degree: int = 3) -> list[Column]:
    """Values of all B-splines over [0, 1] with the given inner knots; null stays null, x outside gives zeros."""
    knots = [0.0] * (degree + 1) + list(inner) + [1.0] * (degree + 1)
    last = len(inner) + degree  # the interval that holds x = 1
    level = []
    for i, (a, b) in enumerate(zip(knots, knots[1:])):
        inside = (x >= a) & ((x <= b) if i == last else (x < b))
        level.append(F.when(x.isNull(), None).when(inside, 1.0).otherwise(0.0) if a < b else None)
    for k in range(1, degree + 1):
        raised = []
        for i in range(len(level) - 1):
            rise = (x - knots[i]) / (knots[i + k] - knots[i]) * level[i] if level[i] is not None else None
            fall = (knots[i + k + 1] - x) / (knots[i + k + 1] - knots[i + 1]) * level[i + 1] if level[i + 1] is not None else None
            parts = [p for p in (rise, fall) if p is not None]
            raised.append(sum(parts[1:], parts[0]) if parts else None)
        level = raised
    return level
