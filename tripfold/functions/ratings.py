"""Column helpers for judge ratings and fairness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .columns import col
from .text import strip


def rating_score(text: Column | str) -> Column:
    """Rating word → 1..5: prefix dropped, exact word first, then contained."""
    c = strip(text)
    for prefix in fixed.RATING_PREFIXES:
        c = F.when(c.startswith(prefix), strip(F.substring(c, len(prefix) + 1, 1 << 30))).otherwise(c)
    score = None
    for word, value in fixed.RATINGS.items():
        score = F.when(c == word, value) if score is None else score.when(c == word, value)
    for word, value in fixed.RATINGS.items():
        score = score.when(c.contains(word), value)
    return score


def normalise(raw: Column | str) -> Column:
    """1..5 → 0..100."""
    return (col(raw) - 1) / 4.0 * 100.0


def meta_weighted(norm: Column | str, meta: Column | str) -> Column:
    """Scale by the meta score; unchanged without one."""
    return col(norm) * F.coalesce(col(meta) / 5.0, F.lit(1.0))


def fairness(low: Column | str, high: Column | str) -> Column:
    """Min/max ratio in percent with its five branches; null input is fair."""
    lo, hi = col(low), col(high)
    return (F.when(lo.isNull() | hi.isNull() | (lo == hi), 100.0)
            .when((hi > 0) & (lo >= 0), lo / hi * 100.0)
            .when(hi > 0, 0.0)
            .when(lo == 0, 0.0)
            .otherwise(hi / lo * 100.0 + 0.0))
