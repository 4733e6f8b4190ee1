"""Scalar column expressions: keys and codes, dates and times, null-safe numbers."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LOCAL_ZONE = "America/Fortaleza"
#: Routes whose fare-box direction codes are the other way round.
REVERSED_ROUTES = ("614",)


# ---- keys and codes ----------------------------------------------------------------------------------------------
def pad_short(code: Column, width: int) -> Column:
    """Zeros in front of codes shorter than width; longer codes stay whole."""
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def digits(code: Column) -> Column:
    """The digits of a noisy code; null when there are none."""
    return F.nullif(F.regexp_replace(code, "[^0-9]", ""), F.lit(""))


def bus_code(code: Column) -> Column:
    return pad_short(digits(code), 5)


def route_join_key(route_id: Column) -> Column:
    """Route ids without leading zeros; of zeros only: empty."""
    return F.regexp_replace(route_id, "^0+", "")


def company_code(bus_id: Column) -> Column:
    return F.left(bus_id, F.lit(2))


def direction(code: Column, route_id: Column) -> Column:
    """I or V from fare-box codes 0 and 1, which some routes have the other way round; null for others."""
    back = route_id.isin(*REVERSED_ROUTES)
    return F.when(code == 0, F.when(back, "V").otherwise("I")).when(code == 1, F.when(back, "I").otherwise("V"))


def shape_direction(shape_id: Column) -> Column:
    return F.when(F.endswith(shape_id, F.lit("-I")), "I").otherwise("V")


def entity_id(entity: str, *fields: Column) -> Column:
    """Deterministic 128-bit id: md5 of entity and fields, absent fields as empty text."""
    parts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.md5(F.concat_ws("\x1f", F.lit(entity), *parts))


def keyed_hash(key: bytes):
    """Arrow UDF: the first 128 bits of HMAC-SHA-256 as hex; null stays null."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:32])

    return run


@F.pandas_udf(StringType())
def plain_upper(values: pd.Series) -> pd.Series:
    """Upper case without accents, digits and punctuation (month folder names)."""
    def one(v: str | None) -> str | None:
        return None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v).upper() if c.isascii() and (c.isalpha() or c == " ")).strip()

    return values.map(one)


@F.pandas_udf(StringType())
def composed(values: pd.Series) -> pd.Series:
    """Text in Unicode NFC, trimmed; empty text becomes null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).strip() or None)


def all_present(*cols: Column) -> Column:
    """True where every column is neither null nor empty."""
    return reduce(lambda a, b: a & b, [c.isNotNull() & (c.cast("string") != "") for c in cols])


def flag(*conditions: Column) -> Column:
    """Bit k of an integer is set where the k-th condition holds."""
    bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


# ---- dates and times ---------------------------------------------------------------------------------------------
def gtfs_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS, hours may pass 24; null for null or malformed text."""
    part = [F.split_part(text, F.lit(":"), F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]


def hour_of_seconds(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / 3600).cast("int"), F.lit(24))


def epoch(ts: Column) -> Column:
    """Seconds since 1970, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def at_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * F.lit(1e6)).cast("long"))


def iso_weekday(day: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(day) + 1


def days(ts: Column, zone: str = LOCAL_ZONE, cutoff_hours: int = 3) -> tuple[Column, Column, Column]:
    """Event (UTC), local and operational date: the last begins cutoff_hours after local midnight."""
    local = F.from_utc_timestamp(ts, zone)
    return F.to_date(ts), F.to_date(local), F.to_date(local - F.expr(f"INTERVAL {cutoff_hours} HOURS"))


def between_months(ts: Column, year: int, month: int) -> Column:
    """Half-open month range."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return (ts >= start.cast("timestamp")) & (ts < F.add_months(start, 1).cast("timestamp"))


# ---- numbers -----------------------------------------------------------------------------------------------------
def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def at_least_zero(x: Column) -> Column:
    """max(0, x), null staying null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0).cast("double"), x.cast("double")))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def heading(x: Column) -> Column:
    """Headings of 360 and more are unknown and become 0."""
    return F.when(x >= 360, F.lit(0)).otherwise(x)


def circular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a step east dx and north dy."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def logit(p: Column, eps: float = 1e-9) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def odds_scaled(p: Column, factor: float) -> Column:
    """Probability after its odds are multiplied."""
    q = clip(p, 1e-9, 1 - 1e-9)
    o = q / (1 - q) * F.lit(factor)
    return o / (1 + o)


def confidence(gap_seconds: Column) -> Column:
    return F.when(gap_seconds <= 60, "high").when(gap_seconds <= 180, "medium").otherwise("low")


def pearson(y: Column, x: Column) -> Column:
    """Aggregate correlation; null under two rows or without variance (built-in corr raises there)."""
    return F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))
