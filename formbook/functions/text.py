"""Parsers and normalisers for race-card text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from formbook.functions.numeric import col


def title_case(c: str | Column) -> Column:
    """Upper-case after every non-letter, lower-case elsewhere (``O'Brien``, ``Bangor-On-Dee``)."""
    words = F.split(F.lower(F.trim(col(c))), r"(?<=[^\p{L}])")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def person_name(c: str | Column) -> Column:
    """Initials without dots, single spaces, title case."""
    s = title_case(c)
    s = F.regexp_replace(s, r"\.(?=[A-Z])", " ")
    s = F.regexp_replace(s, r"\.\s*", " ")
    s = F.trim(F.regexp_replace(s, r"\s{2,}", " "))
    return title_case(s)


def number(c: str | Column) -> Column:
    """Double, or null where the text is no number."""
    return col(c).try_cast("double")


def off_time_seconds(c: str | Column) -> Column:
    """Seconds after midnight from ``h:mm[:ss]``, else a readable clock time, else noon."""
    s = F.trim(col(c).cast("string"))
    pattern = r"(\d{1,2}):(\d{2})(?::(\d{2}))?"
    hit = s.rlike(pattern)

    def part(i: int) -> Column:
        return F.regexp_extract(s, pattern, i).try_cast("int")

    other = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in ("HHmm", "h a", "ha", "yyyy-MM-dd HH")])
    h = F.when(hit, part(1)).otherwise(F.hour(other))
    m = F.when(hit, part(2)).otherwise(F.minute(other))
    sec = F.when(hit, F.coalesce(part(3), F.lit(0))).otherwise(F.second(other))

    def bounded(x: Column, default: int, top: int) -> Column:
        return F.least(F.greatest(F.coalesce(x, F.lit(default)), F.lit(0)), F.lit(top))

    return bounded(h, 12, 23) * 3600 + bounded(m, 0, 59) * 60 + bounded(sec, 0, 59)


def event_time(date: str | Column, off_time: str | Column) -> Column:
    return F.timestamp_seconds(F.unix_date(col(date)).cast("long") * 86400 + off_time_seconds(off_time))


# ---- form strings ("213-41P/") -------------------------------------------------


def form_digits(c: str | Column, positive: bool = False) -> Column:
    digits = F.transform(F.regexp_extract_all(col(c).cast("string"), F.lit("[0-9]"), F.lit(0)),
                         lambda d: d.cast("int"))
    return F.filter(digits, lambda d: d > 0) if positive else digits


def form_last(c: str | Column) -> Column:
    d = form_digits(c)
    return F.when(F.size(d) > 0, F.try_element_at(d, F.lit(-1)).cast("double")).otherwise(F.lit(5.0))


def form_mean(c: str | Column) -> Column:
    d = form_digits(c, positive=True)
    total = F.aggregate(d, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(d) > 0, total / F.size(d)).otherwise(F.lit(5.0))


def form_wins(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit("1"))


def form_length(c: str | Column) -> Column:
    return F.regexp_count(col(c), F.lit("[0-9]"))


def form_non_completions(c: str | Column) -> Column:
    return F.regexp_count(F.upper(col(c)), F.lit("[PFUR]"))


def form_has_break(c: str | Column) -> Column:
    return F.when(col(c).contains("/"), F.lit(1)).otherwise(F.lit(0))


def form_trend(c: str | Column) -> Column:
    """Least-squares slope of the placings; negative means improving."""
    d = form_digits(c, positive=True)
    n = F.size(d).cast("double")
    sum_y = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    sum_xy = F.aggregate(F.transform(d, lambda x, i: (x * i).cast("double")), F.lit(0.0), lambda a, x: a + x)
    # Sums of 0..n-1 and its squares are closed forms.
    slope = (sum_xy - (n - 1) / 2.0 * sum_y) / (n * (n * n - 1) / 12.0)
    return F.when(n >= 2, slope).otherwise(F.lit(0.0))


# ---- lookups -------------------------------------------------------------------

# Official going descriptions per going group.
GOING_GROUPS = {
    "Fast": ["standard", "good to firm", "good (good to firm in places)", "good to firm (good in places)",
             "good to firm (firm in places)", "firm", "firm (good to firm in places)"],
    "Good": ["good", "standard / slow"],
    "Soft": ["good to soft", "soft", "good (good to soft in places)", "good to soft (good in places)",
             "good to soft (soft in places)", "soft (good to soft in places)"],
    "Heavy": ["heavy", "soft (heavy in places)", "soft to heavy", "heavy (soft in places)",
              "heavy (heavy to soft in places)"],
    "Yielding": ["good to yielding", "yielding", "good (good to yielding in places)",
                 "yielding (soft in places)", "yielding to soft", "soft (yielding to soft in places)"],
}


def going_group(c: str | Column) -> Column:
    key = F.lower(F.trim(col(c)))
    out = F.when(F.lit(False), F.lit(""))
    for group, names in GOING_GROUPS.items():
        out = out.when(key.isin(names), F.lit(group))
    return out.otherwise(F.lit("Good"))


def class_number(c: str | Column, default: int | None = None) -> Column:
    n = F.regexp_extract(col(c), r"(\d+)", 1).try_cast("int")
    return n if default is None else F.coalesce(n, F.lit(default))


# Text marks for beaten distances, tested in this order.
NAMED_MARGINS = {"dht": 0.0, "nse": 0.05, "shd": 0.1, "sh": 0.1, "hd": 0.2, "nk": 0.3, "sn": 0.1, "snk": 0.2}
FRACTION_MARKS = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅓": 0.33, "⅔": 0.67}


def beaten_lengths(c: str | Column) -> Column:
    """Lengths from ``8 ½``, ``nk``, ``1¼``; null for blank text."""
    s = F.lower(F.trim(col(c)))
    whole = F.coalesce(F.regexp_extract(s, r"(\d+)", 1).try_cast("double"), F.lit(0.0))
    parts = whole
    for mark, size in FRACTION_MARKS.items():
        parts = parts + F.when(s.contains(mark), F.lit(size)).otherwise(F.lit(0.0))
    out = F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("double"))
    for mark, size in NAMED_MARGINS.items():
        out = out.when(s.contains(mark), F.lit(size))
    return out.otherwise(parts)


def distance_furlongs(c: str | Column) -> Column:
    """Furlongs from ``2m 7f 96y``; 10 when nothing can be read."""
    s = F.lower(F.trim(col(c)))

    def units(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(s, pattern, 1).try_cast("double"), F.lit(0.0))

    total = units(r"(\d+)\s*m(?:ile)?") * 8 + units(r"(\d+)\s*f") + units(r"(\d+)\s*y") / 220.0
    return F.when(total > 0, F.bround(total, 2)).otherwise(F.lit(10.0))


def weight_pounds(c: str | Column) -> Column:
    """Pounds from stones-pounds ``11-9`` or a bare number; 140 when absent."""
    s = col(c).cast("string")
    pair = r"(\d+)\s*[-–]\s*(\d+)"
    stones, pounds = (F.regexp_extract(s, pair, i).try_cast("double") for i in (1, 2))
    return F.coalesce(stones * 14 + pounds, F.regexp_extract(s, r"(\d+)", 1).try_cast("double"), F.lit(140.0))


def fractional_odds(c: str | Column) -> Column:
    """Decimal odds from ``5/2``, ``11/4f``, ``evs`` or a decimal; 5 when unreadable."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), "[fj]", ""))
    num, den = (F.regexp_extract(s, r"^(\d+)\s*/\s*(\d+)", i).try_cast("double") for i in (1, 2))
    return (
        F.when(s.isin("evs", "evens", "ev"), F.lit(2.0))
        .when(den > 0, F.bround(num / den + 1.0, 2))
        .otherwise(F.coalesce(s.try_cast("double"), F.lit(5.0)))
    )


def race_type(race_name: str | Column, run_type: str | Column) -> Column:
    code, name = F.upper(F.coalesce(col(run_type), F.lit(""))), F.lower(F.coalesce(col(race_name), F.lit("")))
    return (
        F.when(code == "CHASE", "Chase")
        .when(code.isin("HURDLE", "HURDL"), "Hurdle")
        .when(code.isin("FLAT", "AW FLAT", "BUMPER", "NHF"), "Flat")
        .when(name.contains("chase"), "Chase")
        .when(name.contains("hurdle"), "Hurdle")
        .otherwise("Flat")
    )


def slug(c: str | Column) -> Column:
    s = F.regexp_replace(F.lower(col(c)), "['‘’]", "")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


# ---- join keys -----------------------------------------------------------------


def off_time_key(c: str | Column) -> Column:
    """``HH:MM`` from ``1408``, ``14:08:00``, ``1408 BST``."""
    s = F.trim(col(c).cast("string"))
    clock = r"^(\d{1,2}):(\d{2})"
    digits = F.regexp_replace(s, r"\D", "")
    return (
        F.when(s.isNull() | F.lower(s).isin("", "nan", "none", "nat"), "")
        .when(s.rlike(r"^\d{4}$"), F.concat(F.substring(s, 1, 2), F.lit(":"), F.substring(s, 3, 2)))
        .when(s.rlike(clock), F.concat(F.lpad(F.regexp_extract(s, clock, 1), 2, "0"), F.lit(":"),
                                       F.regexp_extract(s, clock, 2)))
        .when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
        .otherwise(s)
    )


def track_key(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col(c))), r"\s+", " ")


def entrant_key(c: str | Column) -> Column:
    return F.regexp_replace(title_case(c), r"\s+", " ")


# Long course names and the short names the exchange uses.
EXCHANGE_TRACKS = {
    "epsom downs": "epsom", "royal ascot": "ascot", "ballinarobe": "ballinrobe",
    "bangor on dee": "bangor-on-dee", "bangor": "bangor-on-dee",
}


def exchange_track_key(c: str | Column) -> Column:
    key = track_key(c)
    out = F.when(F.lit(False), key)
    for name, alias in EXCHANGE_TRACKS.items():
        out = out.when(key == name, F.lit(alias))
    return out.otherwise(key)


def exchange_entrant_key(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(entrant_key(c)), "[^a-z0-9 ]", ""))


def track_from_event(c: str | Column) -> Column:
    """Course name without the trailing meeting date (``Nottingham 1st Jun``)."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")),
                                   r"(?i)\s*\d{1,2}(?:st|nd|rd|th)(?:\s+\w{3,})?\s*$", ""))


def bare_entrant_name(c: str | Column) -> Column:
    """Runner name without cloth number and country code."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s*\d+\.\s*", "")
    return F.trim(F.regexp_replace(s, r"\s*\([A-Z]{2,3}\)\s*$", ""))


def local_off_time(c: Column, zone: str = "Europe/London") -> Column:
    """UTC instant shown on the local clock, summer time included."""
    return F.date_format(F.from_utc_timestamp(c, zone), "HH:mm")


# ---- headgear ------------------------------------------------------------------

HEADGEAR_SCHEMA = "array<struct<symbol:string,name:string,count:int>>"


def headgear_items(c: str | Column) -> Column:
    """Items of a headgear list written with single quotes; empty when unreadable."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "'", '"')
    parsed = F.from_json(F.when(text.startswith("["), text), HEADGEAR_SCHEMA)
    return F.coalesce(parsed, F.from_json(F.lit("[]"), HEADGEAR_SCHEMA))


def first_time(items: Column, symbol: str) -> Column:
    return F.exists(items, lambda i: (i["symbol"] == symbol) & (i["count"] == 1)).cast("int")


def any_first_time(items: Column) -> Column:
    return F.exists(items, lambda i: F.coalesce(i["count"], F.lit(999)) == 1).cast("int")


def equipment_count(items: Column) -> Column:
    return F.size(F.array_distinct(F.transform(items, lambda i: F.coalesce(i["symbol"], F.lit("")))))


# ---- calendar ------------------------------------------------------------------


def calendar_parts(date: str | Column) -> dict[str, Column]:
    d = col(date)
    month = F.month(d)
    season = (
        F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer").otherwise("Autumn")
    )
    parts = {"month": month, "day_of_week": F.weekday(d), "day_of_year": F.dayofyear(d), "year": F.year(d)}
    for s in ("Winter", "Spring", "Summer", "Autumn"):
        parts[f"season_{s}"] = (season == s).cast("int")
    return parts
