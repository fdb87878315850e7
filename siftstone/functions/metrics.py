"""Number and text formats of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import trim_space


def hit_ref(path: Column, line: Column) -> Column:
    return F.concat(trim_space(path), F.lit(":"), line.cast("string"))


def two_digits(value: Column) -> Column:
    # Rounds the exact binary value, half to even, and adds no grouping.
    return F.call_function("format_number", value, F.lit("0.00"))


def format_duration_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.concat(two_digits(ms / 1000), F.lit("s"))).otherwise(F.concat(two_digits(ms), F.lit("ms")))


def format_mode_counts(counts: Column) -> Column:
    """``auto=.. semantic=.. lexical=..``, then other modes by name."""
    keys = F.map_keys(counts)
    known = F.filter(F.array(*[F.lit(mode) for mode in fixed.MODE_ORDER]), lambda mode: F.array_contains(keys, mode))
    others = F.array_sort(F.array_except(keys, F.array(*[F.lit(mode) for mode in fixed.MODE_ORDER])))
    shown = F.transform(
        F.concat(known, others), lambda mode: F.concat(mode, F.lit("="), F.element_at(counts, mode).cast("string"))
    )
    return F.when(F.size(keys) == 0, F.lit("none")).otherwise(F.array_join(shown, " "))


def short_commit(commit: Column) -> Column:
    return F.left(trim_space(commit), F.lit(7))


def quality_score(top1: Column, top3: Column, mrr: Column) -> Column:
    """0..100; half rounds away from zero. The inner round drops float noise."""
    mix = 100 * (fixed.TOP1_SHARE * top1 + fixed.TOP3_SHARE * top3 + fixed.MRR_SHARE * mrr)
    return F.round(F.round(mix, 9)).cast("int")
