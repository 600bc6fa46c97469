"""Derived metrics, burst types and vector helpers as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.model import COMPLETE_BURST, COUNTER_RANGE, DURATION_BURST, LOG_OF_ZERO, MISSING_DATA, OVERFLOW_TYPES, RANGE_BURST

OPERATIONS = {"+": "add", "-": "sub", "*": "mul", "/": "div"}


def single_event(events: DataFrame, code: int, keys: Sequence[str] = ("instance",), value: str = "event_value") -> DataFrame:
    """Sum of one event type's values per burst; bursts without the type give no row."""
    hit = events.where((F.col("event_type") == code) & F.col(value).isNotNull())
    return hit.groupBy(*keys).agg(F.sum(value).alias("metric"))


def overflow_fixed(code: Column, value: Column) -> Column:
    """Counters of OVERFLOW_TYPES keep 32 bits, inverted if a bit from 30 on is set; others are kept."""
    low = value.bitwiseAND(F.lit(0xFFFFFFFF))
    inverted = low.bitwiseXOR(F.lit(0xFFFFFFFF))
    return F.when(code.isin(*OVERFLOW_TYPES), F.when(F.shiftright(low, 30) > 0, inverted).otherwise(low)).otherwise(value)


def mixed(a: Column, b: Column, operation: str) -> Column:
    """A op b; a division by 0 gives 0, a missing side null. The operation is its first character."""
    op = operation.strip()[:1]
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    if op == "/":
        return F.when(b.isNull() | a.isNull(), None).when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)
    return {"+": a + b, "-": a - b, "*": a * b}[op].cast("double")


def log_metric(v: Column) -> Column:
    """P5: natural logarithm; of 0 the smallest normal double."""
    return F.when(v == 0, F.lit(LOG_OF_ZERO)).otherwise(F.ln(v))


@dataclass(frozen=True)
class Parameter:
    """A clustering parameter: its column, factor, range (None: unbounded) and whether logarithms are taken."""

    column: str
    factor: float = 1.0
    low: float | None = None
    high: float | None = None
    log: bool = False


def in_range(p: Parameter) -> Column:
    """the raw value lies within the parameter's bounds."""
    ok = F.lit(True)
    if p.low is not None:
        ok &= F.col(p.column) >= p.low
    if p.high is not None:
        ok &= F.col(p.column) <= p.high
    return ok


def burst_type(parameters: Sequence[Parameter], least_duration: int, duration: str = "duration") -> Column:
    """The last parameter that is missing or out of range decides; a short duration beats a range, a missing value beats both."""
    kind = F.lit(COMPLETE_BURST)
    for p in parameters:
        kind = F.when(F.col(p.column).isNull(), MISSING_DATA).when(~in_range(p), RANGE_BURST).otherwise(kind)
    return F.when(kind == MISSING_DATA, kind).when(F.col(duration) < least_duration, DURATION_BURST).otherwise(kind).cast("int")


def drop_zero_lines(df: DataFrame) -> DataFrame:
    """rows of line 0 and duration 0 are no bursts."""
    return df.where(~((F.col("line") == 0) & (F.col("duration") == 0)))


def nanoseconds(text: str) -> int:
    """a time with a unit (D, H, M, s, m, u, n, with an optional s after it) in ns; microseconds without one."""
    found = re.fullmatch(r"\s*(\d+)(?:\.\d*)?\s*([DHMsSmun]?)s?\s*", text)
    if not found:
        raise ValueError(f"no time: {text!r}")
    second = 10**9
    unit = {"D": 86400 * second, "H": 3600 * second, "M": 60 * second, "s": second, "S": second, "m": 10**6, "u": 1000, "n": 1, "": 1000}
    return int(found[1]) * unit[found[2]]


def usable_types(events: DataFrame, keys: Sequence[str], ts: str = "ts", end: str = "end") -> DataFrame:
    """Events whose type is also seen exactly at the burst's end; all of a burst where nothing is seen there."""
    burst = Window.partitionBy(*keys)
    own = Window.partitionBy(*keys, "event_type")
    at_end = F.when(F.col(ts) == F.col(end), 1).otherwise(0)
    marked = events.withColumn("_any", F.max(at_end).over(burst)).withColumn("_own", F.max(at_end).over(own))
    return marked.where((F.col("_any") == 0) | (F.col("_own") == 1)).drop("_any", "_own")


def counters(labels: DataFrame) -> DataFrame:
    """All hardware counters of the label table, named as in ``(NAME) text`` or ``NAME [text]``, else by the whole label."""
    low, high = COUNTER_RANGE
    old, new = F.regexp_extract("label", r"^\(([^)]*)\)", 1), F.regexp_extract("label", r"^([^(\[][^\[]*?) ?\[.*\]", 1)
    return labels.where((F.col("event_type") >= low) & (F.col("event_type") < high)).select("event_type", F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")), F.col("label")).alias("counter"))


def event_by_label(labels: DataFrame, text: str) -> DataFrame:
    """The event type of a label: equal, else with the text in brackets, else containing it; ties by code."""
    rank = F.when(F.col("label") == text, 0).when(F.instr("label", f"({text})") > 0, 1).when(F.instr("label", text) > 0, 2)
    return labels.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "event_type").limit(1).select("event_type", "label")


#: P10. The counters of the cycle-stack model.
POWER_COUNTERS = (
    42001001, 42001005, 42001008, 42001009, 42001012, 42001018, 42001022, 42001029, 42001043, 42001054, 42001056, 42001057, 42001060, 42001063, 42001070,
    42001071, 42001073, 42001074, 42001075, 42001079, 42001086, 42001090, 42001091, 42001099, 42001102, 42001105, 42001106, 42001107, 42001108, 42001118,
    42001129, 42001135, 42001140, 42001145, 42001206, 42001207, 42001211, 42001218, 42001219, 42001220, 42001221, 42001222, 42001223, 42001224, 42001225,
    42001226, 42001227, 42001228, 42001229,
)


# ---------------------------------------------------------------- vectors


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def vector_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vector_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def base_change(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """Matrix times vector."""
    return F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in row])) for row in matrix])


def normal_cdf(z: Column) -> Column:
    """Normal distribution function; the complementary error function by a rational approximation (error below 1.2e-7)."""
    t = 1 / (1 + F.abs(z) / F.lit(2**0.5) * 0.5)
    # Coefficients of the Chebyshev fit.
    powers = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        poly = poly * t + c
    half = t * F.exp(-z * z / 2 + poly) / 2
    return F.when(z >= 0, 1 - half).otherwise(half)
