"""Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import constants as C

MS_PER_HOUR = 3_600_000


def ratio(num: Column | str, den: Column | str, scale: float = 1.0) -> Column:
    """``scale * num / den`` as double; 0 when ``den`` is 0 or null.

    The multiplication happens first, then one division, so integer inputs
    give the same double as any engine evaluating ``scale * num / den``.
    """
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    top = F.lit(float(scale)) * num if scale != 1.0 else num.cast("double")
    return F.coalesce(F.try_divide(top, den), F.lit(0.0))


def pct(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den, 100.0)


def hours(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms.cast("double") / F.lit(MS_PER_HOUR)


def platform_head(raw: Column | str) -> Column:
    """Text before the first ``(``, trimmed, lower case."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.lower(F.trim(F.split_part(F.coalesce(raw, F.lit("")), F.lit("("), F.lit(1))))


def _first_match(head: Column, otherwise: Column) -> Column:
    expr = None
    for name, needles in C.PLATFORM_RULES:
        cond = None
        for n in needles:
            c = head.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(otherwise)


def platform_category(raw: Column | str) -> Column:
    """Mobile / Web / Desktop / Other."""
    return _first_match(platform_head(raw), F.lit(C.PLATFORM_OTHER))


def platform_label(raw: Column | str) -> Column:
    """P10: like P9, but unmatched text is kept (first 20 chars), blank -> Other."""
    head = platform_head(raw)
    tail = (
        F.when(F.length(head) == 0, F.lit(C.PLATFORM_OTHER))
        .otherwise(F.substring(head, 1, C.PLATFORM_LABEL_MAX_CHARS))
    )
    return _first_match(head, tail)


def tz_offset(country: Column | str) -> Column:
    """Whole-hour UTC offset of a country code, default +3."""
    country = F.col(country) if isinstance(country, str) else country
    m = F.create_map(*[x for k, v in C.TZ_OFFSETS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, country), F.lit(C.DEFAULT_TZ_OFFSET))


def tz_label(offset: Column | str) -> Column:
    """``UTC+3`` / ``UTC-5``."""
    offset = F.col(offset) if isinstance(offset, str) else offset
    return F.when(offset >= 0, F.concat(F.lit("UTC+"), offset.cast("string"))).otherwise(
        F.concat(F.lit("UTC"), offset.cast("string"))
    )


def micros_between(a: Column | str, b: Column | str) -> Column:
    """``b - a`` in microseconds (works on TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", F.col(a) if isinstance(a, str) else a,
                            F.col(b) if isinstance(b, str) else b)


def minus_ms(ts: Column | str, ms: Column | str) -> Column:
    """``ts - ms milliseconds`` (play start from play end)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.timestamp_add("MILLISECOND", -ms, ts)
