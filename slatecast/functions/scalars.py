"""Column builders: text keys, parsing of money and numbers, calendar and clock rules, buckets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: Column | str) -> Column:
    """Money as an exact decimal, so that sums don't depend on their order."""
    return col(c).cast("decimal(18,2)")


def money_sum(c: Column | str) -> Column:
    return F.sum(cents(c)).cast("double")


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def day(c: Column | str) -> Column:
    return col(c).cast("date")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier))


def clean_text(c: Column | str) -> Column:
    """White space runs, no-break spaces among them, as single spaces; blank as null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"[\s ]+", " ")), F.lit(""))


def title_key(c: Column | str) -> Column:
    """Lower-case letters and digits with single spaces; a year in brackets is dropped and & reads as and."""
    s = F.regexp_replace(F.lower(col(c)), r"\(\d{4}\)", " ")
    s = F.regexp_replace(F.regexp_replace(s, "&", " and "), r"[^a-z0-9]+", " ")
    return F.nullif(F.trim(s), F.lit(""))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(title_key(c), " ", "-")


def title_variants(c: Column | str) -> Column:
    """The title's key, and the key with a trailing article moved to the front."""
    moved = F.regexp_replace(col(c), r"(?i)^(.*), (the|a|an)$", "$2 $1")
    return F.array_distinct(F.array_compact(F.array(title_key(c), title_key(moved))))


def parse_number(c: Column | str) -> Column:
    """A number written with $, commas, %, brackets for negatives, or k, m, b at its end; n/a and the like are null."""
    s = F.lower(F.trim(col(c)))
    plain = F.regexp_replace(s, r"[$,%()+\s]|[kmb]$", "")
    scale = F.when(s.endswith("k"), 1e3).when(s.endswith("m"), 1e6).when(s.endswith("b"), 1e9).otherwise(1.0)
    sign = F.when(s.startswith("("), -1.0).otherwise(1.0)
    return plain.try_cast("double") * scale * sign


def parse_date(c: Column | str) -> Column:
    """Dates in ISO form, as 3/14/2026, as Mar 14, 2026 or March 14th, 2026; else null."""
    s = F.regexp_replace(F.trim(col(c)), r"(?<=\d)(st|nd|rd|th)\b", "")
    return F.coalesce(*(F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy")))


def canonical_url(c: Column | str) -> Column:
    """Without fragment, without utm_ parameters and without a slash at the end."""
    bare = F.regexp_replace(col(c), "#.*$", "")
    path, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.concat(F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def business_minute(ts: Column | str) -> Column:
    """Minute of the business day, which runs to 5 a.m.: half past midnight is 1470."""
    m = F.hour(col(ts)) * 60 + F.minute(col(ts))
    return F.when(m < 300, m + 1440).otherwise(m)


def day_block(minute: Column) -> Column:
    """1 before 15:00, 2 before 18:00, 3 before 21:00, else 4."""
    return F.when(minute < 900, 1).when(minute < 1080, 2).when(minute < 1260, 3).otherwise(4)


def season(d: Column | str) -> Column:
    """summer_YYYY from 25 May to 5 September, holiday_YYYY from 1 November to 5 January (of its first year)."""
    n, y = F.month(col(d)) * 100 + F.dayofmonth(col(d)), F.year(col(d))
    return (
        F.when(n.between(525, 905), F.concat(F.lit("summer_"), y.cast("string")))
        .when(n >= 1101, F.concat(F.lit("holiday_"), y.cast("string")))
        .when(n <= 105, F.concat(F.lit("holiday_"), (y - 1).cast("string")))
    )


def age_bucket(age: Column) -> Column:
    return F.when(age < 0, "before").when(age <= 2, "opening").when(age <= 6, "week_1").when(age <= 27, "weeks_2_4").otherwise("later")


def is_holiday(d: Column | str) -> Column:
    """New Year, Independence Day, Christmas, and Thanksgiving (fourth Thursday of November)."""
    m, k = F.month(col(d)), F.dayofmonth(col(d))
    fixed = ((m == 1) & (k == 1)) | ((m == 7) & (k == 4)) | ((m == 12) & (k == 25))
    return fixed | ((m == 11) & (F.weekday(col(d)) == 3) & k.between(22, 28))


def has_any(tags: Column, pattern: str) -> Column:
    return F.exists(tags, lambda t: F.lower(t).rlike(pattern))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))


def hash_rank(seed: str, key: Column | str) -> Column:
    """An order that depends on the seed and the key alone."""
    return F.sha2(F.concat_ws(":", F.lit(seed), col(key).cast("string")), 256)


def decayed_loss(tau: Column, rho: Column, decay: Column, weeks: int = 12) -> Column:
    """Share of revenue lost over ``weeks`` when a drop of ``tau`` fades by ``rho`` under a weekly ``decay``."""
    step = lambda f: F.aggregate(F.sequence(F.lit(1), F.lit(weeks)), F.lit(0.0), lambda a, w: a + f(w.cast("double")))
    base = step(lambda w: F.exp(-decay * w))
    return safe_divide(base - step(lambda w: F.exp(-decay * w + tau * F.exp(rho * (w - 1)))), base)


def log1p_floor(c: Column | str) -> Column:
    """ln(1 + x), with x below zero and missing x as 0."""
    return F.log1p(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def near_holiday(d: Column | str) -> Column:
    """A holiday, or a day next to one."""
    around = [is_holiday(F.date_add(col(d), k)) for k in (-1, 0, 1)]
    return around[0] | around[1] | around[2]


def estimate_bucket(usd: Column) -> Column:
    """Size of an estimate in millions: under_15, 15_30, 30_60, 60_100 or over_100."""
    cuts = ((15e6, "under_15"), (30e6, "15_30"), (60e6, "30_60"), (100e6, "60_100"))
    out = F.when(usd.isNull(), F.lit(None).cast("string"))
    for most, name in cuts:
        out = out.when(usd < most, name)
    return out.otherwise("over_100")


def term(spelt: str) -> Column:
    """A model term as it is spelt: a column, a product of columns with ``*``, or a function of it, as ``log:a*b`` (log, log1p, sqrt, square)."""
    how, _, body = spelt.rpartition(":")
    out = None
    for name in body.split("*"):
        out = F.col(name) if out is None else out * F.col(name)
    made = {"": lambda c: c, "log": lambda c: F.when(c > 0, F.ln(c.cast("double"))), "log1p": log1p_floor, "sqrt": lambda c: F.sqrt(F.greatest(c, F.lit(0))), "square": lambda c: c * c}
    return made[how](out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def erfc(x: Column) -> Column:
    """The complementary error function for x of 0 or more: a series up to 2, a continued fraction beyond."""

    def parts(v: Column) -> Column:
        start = F.struct(v.alias("term"), v.alias("sum"))

        def add(a: Column, k: Column) -> Column:
            term_ = a["term"] * 2 * v * v / (2 * k + 1)
            return F.struct(term_.alias("term"), (a["sum"] + term_).alias("sum"))

        series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add)["sum"]
        tail = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), v, lambda a, k: v + k / 2.0 / a)
        small = 1 - F.lit(2 / math.sqrt(math.pi)) * F.exp(-v * v) * series
        return F.when(v < 2, small).otherwise(F.exp(-v * v) / (F.lit(math.sqrt(math.pi)) * tail))

    return let(x.cast("double"), parts)


def two_sided_p(t: Column) -> Column:
    """The chance of a larger |t| under the normal distribution; null for null."""
    return F.when(t.isNotNull(), erfc(F.abs(t) / math.sqrt(2)))
