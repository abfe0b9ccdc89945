"""Text keys of titles, numbers and dates as they are written, similarity, time zones; Python only where SQL has no function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import clean_text, col, parse_number, slug

#: Studios whose possessive is dropped from titles, under the two rules.
STUDIOS = ("disney", "marvel", "warner bros", "universal", "paramount", "sony")
ARTICLE_STUDIOS = ("disney", "marvel", "pixar", "dreamworks", "illumination", "warner bros", "dc", "universal", "paramount", "sony", "a24")


@F.pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility form without combining marks."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _year_off(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\(\d{4}\)\s*$", "")


def _plain(s: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(s, "&", " and "), r"[^a-z0-9]+", " ")), F.lit(""))


def audience_key(c: Column | str) -> Column:
    """Without marks, year at the end and studio possessives; small letters and digits with single spaces."""
    s = F.lower(_year_off(decomposed(col(c))))
    return _plain(F.regexp_replace(s, rf"\b({'|'.join(STUDIOS)})'?s\b", " "))


def article_key(c: Column | str) -> Column:
    """As ``audience_key`` by another list of studios, whose possessive goes only before a space; characters beyond ASCII go."""
    s = _year_off(F.lower(F.regexp_replace(decomposed(col(c)), r"[^\x00-\x7F]", "")))
    return _plain(F.regexp_replace(s, rf"\b({'|'.join(ARTICLE_STUDIOS)})'?s\s+", ""))


def variant_keys(title: Column | str, url: Column | None = None) -> Column:
    """The keys of the forms a title may take: itself, as its address says it, and each with a trailing article moved to the front."""
    forms = [col(title)]
    if url is not None:
        tail = F.regexp_replace(F.url_decode(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)), r"\(\d{4}(-[^)]+)?\)$", "")
        forms.append(F.regexp_replace(tail, "-", " "))
    moved = [F.regexp_replace(_year_off(f), r"(?i)^(.+?),?\s+(the|a|an)$", "$2 $1") for f in forms]
    return F.array_distinct(F.array_compact(F.array(*(audience_key(f) for f in (*forms, *moved)))))


def markup_off(c: Column | str) -> Column:
    """Text without tags and without the entities of &, <, >, quotes and spaces."""
    s = F.regexp_replace(col(c), r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&")):
        s = F.regexp_replace(s, entity, plain)
    return clean_text(s)


def slug_candidates(title: Column | str, year: Column) -> Column:
    """The slug, and the slug with the year behind it."""
    s = slug(title)
    return F.array_compact(F.array(s, F.concat_ws("-", s, year.cast("string"))))


def money_range(c: Column | str) -> Column:
    """Low and high of '$10M - $15M', in the unit of the last where the first has none; one number is both."""
    parts = F.split(F.regexp_replace(col(c), "[–—]", "-"), r"\s*-\s*")
    unit = F.regexp_extract(F.lower(F.element_at(parts, -1)), r"([kmb])\s*(?:illion)?$", 1)
    first = F.get(parts, F.lit(0))
    low = parse_number(F.when(F.lower(first).rlike(r"[kmb]$"), first).otherwise(F.concat(first, unit)))
    return F.struct(low.alias("low"), parse_number(F.element_at(parts, -1)).alias("high"))


def date_range_of(c: Column | str, year: Column) -> Column:
    """First and last day of 'March 28-30' or 'December 30 - January 2', whose end may lie in the year after."""
    s = F.regexp_replace(F.trim(col(c)), "[–—]", "-")
    m1, d1 = F.regexp_extract(s, r"^([A-Z][a-z]+)\.? (\d{1,2})", 1), F.regexp_extract(s, r"^([A-Z][a-z]+)\.? (\d{1,2})", 2)
    m2 = F.coalesce(F.nullif(F.regexp_extract(s, r"-\s*([A-Z][a-z]+)\.? \d{1,2}", 1), F.lit("")), m1)
    d2 = F.regexp_extract(s, r"-\s*(?:[A-Z][a-z]+\.? )?(\d{1,2})", 1)
    made = lambda m, d, y: F.try_to_timestamp(F.concat_ws(" ", F.substring(m, 1, 3), d, y.cast("string")), F.lit("MMM d yyyy")).cast("date")
    start, end = made(m1, d1, year), made(m2, d2, year)
    return F.struct(start.alias("start"), F.when(end < start, made(m2, d2, year + 1)).otherwise(end).alias("end"))


def epoch_date(c: Column | str) -> Column:
    return F.timestamp_seconds(col(c).try_cast("bigint")).cast("date")


def rank_and_title(c: Column | str) -> Column:
    """Rank and title of '3. The Film', rank null without one."""
    s = F.trim(col(c))
    return F.struct(F.regexp_extract(s, r"^(\d{1,2})[.)]\s+", 1).try_cast("int").alias("rank"), F.regexp_replace(s, r"^\d{1,2}[.)]\s+", "").alias("title"))


def user_key(name: Column, number: Column) -> Column:
    """id:<number>, else name:<lower-case name>, else anonymous."""
    return F.when(number > 0, F.concat(F.lit("id:"), number.cast("string"))).when(F.trim(name) != "", F.concat(F.lit("name:"), F.lower(F.trim(name)))).otherwise("anonymous")


def looks_like_bot(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return n.endswith("bot") | n.contains("bot ") | n.contains("-bot") | n.contains("_bot")


def wallet(c: Column | str) -> Column:
    """A 42-character address that starts with 0x, in lower case; else null."""
    s = F.lower(F.trim(col(c)))
    return F.when((F.length(s) == 42) & s.startswith("0x"), s)


#: The states of each time zone, and the parts of states beyond a longitude that keep another one.
ZONES = {
    "America/Anchorage": "AK",
    "America/Chicago": "AL AR IA IL KS LA MN MO MS ND NE OK SD TN TX WI",
    "America/Denver": "CO MT NM UT WY",
    "America/Detroit": "MI",
    "America/Indiana/Indianapolis": "IN",
    "America/Los_Angeles": "CA NV OR WA",
    "America/New_York": "CT DC DE GA MA MD ME NC NH NJ NY OH PA RI SC VA VT WV",
    "America/Phoenix": "AZ",
    "Pacific/Honolulu": "HI",
}
WEST_OF = {"AK": (-169, "America/Adak"), "FL": (-85.1, "America/Chicago"), "IN": (-86.8, "America/Chicago"), "KS": (-101, "America/Denver"), "KY": (-85.2, "America/Chicago"), "MI": (-87, "America/Chicago"), "ND": (-101, "America/Denver"), "NE": (-101, "America/Denver"), "SD": (-100.3, "America/Denver"), "TX": (-104.6, "America/Denver")}
EAST_OF = {"ID": (-116.5, "America/Denver"), "OR": (-116.5, "America/Denver"), "TN": (-84.9, "America/New_York")}
#: For places without a state that decides: zones up to a longitude; further east, or without one, it is New York.
UP_TO = ((-125, "America/Anchorage"), (-115, "America/Los_Angeles"), (-100, "America/Denver"), (-85, "America/Chicago"))


def time_zone(state: Column, longitude: Column) -> Column:
    """The zone of a place by its state, for split states by longitude too; by longitude alone where the state doesn't tell."""
    code = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    zone = F.create_map(*(F.lit(v) for name, codes in ZONES.items() for c in codes.split() for v in (c, name)))
    by_longitude = F.lit("America/New_York")
    for most, name in reversed(UP_TO):
        by_longitude = F.when(longitude <= most, name).otherwise(by_longitude)
    out = F.coalesce(F.try_element_at(zone, code), by_longitude)
    for rule, far in ((WEST_OF, lambda cut: longitude < cut), (EAST_OF, lambda cut: longitude > cut)):
        for c, (cut, name) in rule.items():
            out = F.when((code == c) & far(cut), name).otherwise(out)
    return out


def to_utc(local: Column, zone: Column) -> Column:
    """A local time as UTC; of the two readings of a repeated hour the earlier."""
    return F.convert_timezone(zone, F.lit("UTC"), local.cast("timestamp_ntz"))


def in_morning(now_utc: Column, zone: Column, first: int = 6, last: int = 11) -> Column:
    return F.hour(F.convert_timezone(F.lit("UTC"), zone, now_utc.cast("timestamp_ntz"))).between(first, last)


def size_bucket(*signals: Column) -> Column:
    """Small, medium or large by the first signal that isn't missing or 0."""
    n = F.coalesce(*(F.nullif(s, F.lit(0)) for s in signals))
    return F.when(n.isNull(), "unknown").when(n < 8, "small").when(n < 14, "medium").otherwise("large")


def money_text(c: Column) -> Column:
    return F.when(c.isNull(), "n/a").when(F.abs(c) >= 1e6, F.concat(F.lit("$"), F.format_number(c / 1e6, 1), F.lit("M"))).otherwise(F.concat(F.lit("$"), F.format_number(c, 0)))


def age_text(seconds: Column) -> Column:
    n = lambda k: F.floor(seconds / k).cast("string")
    return F.when(seconds.isNull(), "never").when(seconds < 60, "just now").when(seconds < 3600, F.concat(n(60), F.lit("m ago"))).when(seconds < 86400, F.concat(n(3600), F.lit("h ago"))).otherwise(F.concat(n(86400), F.lit("d ago")))
