"""Exact quantiles that hold at any size.

The built-in exact percentile keeps every distinct value in one task. Here each pass counts
values in equal-width bins between the bounds of the interval that holds a wanted rank, and
the next pass looks only inside the bin that holds it. Only bin counts, or a bounded number
of values at the end, reach the driver. All columns and ranks share the passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carespend.functions.clean import cap_at, number

BINS = 4096
# An interval with at most this many rows is read as a whole.
SMALL = 20_000


@dataclass(frozen=True)
class Span:
    """An interval of one column that holds ``rows`` values, with ``below`` values under it."""

    col: str
    lo: float
    hi: float
    rows: int
    below: int = 0

    def holds(self, v: Column) -> Column:
        return v.between(F.lit(self.lo), F.lit(self.hi))

    def bin(self, v: Column) -> Column:
        at = F.floor((v - F.lit(self.lo)) / F.lit(self.hi - self.lo) * BINS)
        return F.least(at, F.lit(BINS - 1)).cast("int")


def _in_spans(df: DataFrame, spans: list[Span], with_bins: bool) -> DataFrame:
    """The values inside the spans as rows (s, v, b); several columns make several rows."""
    by_col: dict[str, list[int]] = {}
    for i, s in enumerate(spans):
        by_col.setdefault(s.col, []).append(i)
    entries = []
    for c, members in by_col.items():
        v = number(c)
        s_, b_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i in members:
            inside = spans[i].holds(v)
            s_ = F.when(inside, F.lit(i)).otherwise(s_)
            if with_bins:
                b_ = F.when(inside, spans[i].bin(v)).otherwise(b_)
        entries.append((s_, v, b_))
    if len(entries) == 1:
        s_, v, b_ = entries[0]
        rows = df.select(s_.alias("s"), v.alias("v"), b_.alias("b"))
    else:
        rows = df.select(F.inline(F.array(*[F.struct(s_.alias("s"), v.alias("v"), b_.alias("b")) for s_, v, b_ in entries])))
    return rows.where(F.col("s").isNotNull())


def order_statistics(df: DataFrame, wanted: Mapping[Span, Iterable[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ranks, given for each column the span of all its values."""
    found: dict[tuple[str, int], float] = {}
    targets = []
    for span, ranks in wanted.items():
        if not math.isfinite(span.hi - span.lo):
            raise ValueError(f"{span.col} has infinite values")
        targets += [(rank, span) for rank in sorted(set(ranks))]
    while targets:
        for rank, span in targets:
            if span.lo == span.hi:
                found[span.col, rank] = span.lo
        targets = [t for t in targets if (t[1].col, t[0]) not in found]
        small = sorted({s for _, s in targets if s.rows <= SMALL}, key=lambda s: (s.col, s.lo))
        large = sorted({s for _, s in targets if s.rows > SMALL}, key=lambda s: (s.col, s.lo))
        if small:
            # Bounded: each span holds at most SMALL rows, and there are at most two per quantile.
            values: dict[int, list] = {}
            for i, v, n in _in_spans(df, small, False).groupBy("s", "v").count().collect():
                values.setdefault(i, []).append((v, n))
            for rank, span in targets:
                if span not in small:
                    continue
                seen = span.below
                for v, n in sorted(values[small.index(span)]):
                    seen += n
                    if seen > rank:
                        found[span.col, rank] = v
                        break
        if large:
            counts: dict[int, list] = {}
            binned = _in_spans(df, large, True).groupBy("s", "b").agg(F.count(F.lit(1)), F.min("v"), F.max("v"))
            for i, b, n, lo, hi in binned.collect():
                counts.setdefault(i, []).append((b, n, lo, hi))
        narrowed = []
        for rank, span in targets:
            if span not in large:
                continue
            seen = span.below
            for _, n, lo, hi in sorted(counts[large.index(span)]):
                if seen + n > rank:
                    narrowed.append((rank, Span(span.col, lo, hi, n, seen)))
                    break
                seen += n
        targets = narrowed
    return found


def _ranks(n: int, qs: Iterable[float]) -> set[int]:
    lower = [math.floor((n - 1) * q) for q in qs]
    return {r for k in lower for r in (k, min(k + 1, n - 1))}


def quantiles_within(df: DataFrame, spans: Iterable[Span], qs: Iterable[float]) -> dict[str, list[float]]:
    """Quantiles per column with linear interpolation between order statistics."""
    qs, spans = list(qs), list(spans)
    found = order_statistics(df, {s: _ranks(s.rows, qs) for s in spans})
    out = {}
    for s in spans:
        out[s.col] = []
        for q in qs:
            at = (s.rows - 1) * q
            lower = math.floor(at)
            a, b = found[s.col, lower], found[s.col, min(lower + 1, s.rows - 1)]
            out[s.col].append(a + (b - a) * (at - lower))
    return out


def exact_quantiles(df: DataFrame, col: str, qs: Iterable[float]) -> list[float | None]:
    """Quantiles of one column; nulls and NaN are left out."""
    qs = list(qs)
    v = number(col)
    n, lo, hi = df.agg(F.count(v), F.min(v), F.max(v)).first()
    if not n:
        return [None] * len(qs)
    return quantiles_within(df, [Span(col, lo, hi, n)], qs)[col]


def winsorise(df: DataFrame, col: str, q: float = 0.995, fit_on: DataFrame | None = None) -> DataFrame:
    """Cap ``col`` at its ``q`` quantile, taken from ``fit_on`` (the frame itself if not given)."""
    cap = exact_quantiles(fit_on if fit_on is not None else df, col, [q])[0]
    return cap_at(df, col, cap)
