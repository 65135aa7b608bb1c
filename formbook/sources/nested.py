"""Flattening of nested race pages, price streams and order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formbook.features.venue import SPEED_METRICS
from formbook.functions import text as X

RIDE_SCHEMA = """struct<ride_status:string, entrant:struct<name:string, entrant_reference:struct<id:string>, age:int,
  sex:struct<type:string>, formsummary:struct<display_text:string>, last_ran_days:int>,
  jockey:struct<name:string>, trainer:struct<name:string>, handicap:string, cloth_number:int, official_rating:int,
  headgear:string, bookmakerOdds:array<struct<bestOdds:boolean, fractionalOdds:string, decimalOdds:double>>,
  betting:struct<current_odds:string>, finish_position:string, finish_distance:string,
  entrant_lifetime_stats:array<struct<run_count:int, win_count:int, place_count:int>>>"""

PAGE_SCHEMA = f"""struct<race_id:long, course:struct<name:string, country:struct<long_name:string>, feed_source:string>,
  prizes:array<struct<position:int, prize:string>>, rides:array<{RIDE_SCHEMA}>>"""

# What keeps a meeting.
KEEP_COUNTRIES = ("england", "scotland", "wales", "ireland", "eire", "northern ireland", "great britain")
KEEP_FEEDS = ("RUK", "ATR", "SIS")


def keep_meeting(country: Column, course: Column, feed: Column, slugs: tuple[str, ...] = ()) -> Column:
    """Any of three signs: country, course name, broadcaster."""
    hit = F.lower(country).isin(*KEEP_COUNTRIES) | feed.isin(*KEEP_FEEDS)
    if slugs:
        hit = hit | X.slug(course).isin(*slugs)
    return F.coalesce(hit, F.lit(False))


def first_prize(prizes: Column) -> Column:
    text = F.element_at(F.filter(prizes, lambda p: p["position"] == 1), 1)["prize"]
    number = F.regexp_replace(F.element_at(F.split(text, " "), 1), "[^0-9.]", "")
    return F.when(F.size(F.filter(prizes, lambda p: p["position"] == 1)) > 0,
                  F.coalesce(number.try_cast("double"), F.lit(0.0))).otherwise(0.0)


def flatten_pages(pages: DataFrame, json: str = "json", subject: str = "entrant") -> DataFrame:
    """One row per ride of a race page; non-runners are dropped.

    ``subject`` is the word by which the pages' keys call an entrant."""
    page = pages.select(F.from_json(json, PAGE_SCHEMA.replace("entrant", subject)).alias("p"))
    rides = page.select("p.race_id", "p.course", first_prize(F.col("p.prizes")).alias("prize_money"),
                        F.explode("p.rides").alias("r")).where(F.coalesce("r.ride_status", F.lit("")) != "NON-RUNNER")
    books = F.col("r.bookmakerOdds")
    best = F.coalesce(F.try_element_at(F.filter(books, lambda b: b["bestOdds"]), F.lit(1)),
                      F.try_element_at(books, F.lit(1)))
    shown = F.coalesce(F.nullif(best["fractionalOdds"], F.lit("")), best["decimalOdds"].cast("string"),
                       F.col("r.betting.current_odds"))
    place = F.coalesce(F.col("r.finish_position").try_cast("int"), F.lit(0))
    label = F.when((place == 0) & ~F.coalesce("r.finish_position", F.lit("")).isin("", "0"),
                   F.upper(F.trim("r.finish_position"))).otherwise("")
    lengths = X.beaten_lengths("r.finish_distance")
    stats = F.try_element_at(F.col(f"r.{subject}_lifetime_stats"), F.lit(1))
    return rides.select(
        "race_id", F.col("course.name").alias("track"), "prize_money", F.col(f"r.{subject}.name").alias("entrant_name"),
        F.col(f"r.{subject}.{subject}_reference.id").alias("entrant_id"), F.coalesce(f"r.{subject}.age", F.lit(0)).alias("age"),
        F.col(f"r.{subject}.sex.type").alias("sex"), F.col(f"r.{subject}.formsummary.display_text").alias("form"),
        F.coalesce(f"r.{subject}.last_ran_days", F.lit(0)).alias("days_since_last_run"),
        F.col("r.jockey.name").alias("jockey"), F.col("r.trainer.name").alias("trainer"),
        X.weight_pounds("r.handicap").alias("weight_lbs"), F.coalesce("r.cloth_number", F.lit(0)).alias("draw"),
        F.coalesce("r.official_rating", F.lit(0)).alias("official_rating"), F.col("r.headgear").alias("headgear"),
        F.coalesce(X.fractional_odds(shown), F.lit(5.0)).alias("odds"), place.alias("finish_position"),
        label.alias("finish_pos_label"), (place == 1).cast("int").alias("won"),
        F.when(place == 1, F.coalesce(lengths, F.lit(0.0))).when(place > 1, lengths).alias("lengths_behind"),
        F.coalesce(stats["run_count"], F.lit(0)).alias("entrant_runs"),
        F.coalesce(stats["win_count"], F.lit(0)).alias("entrant_wins"),
        F.coalesce(stats["place_count"], F.lit(0)).alias("entrant_places"))


DEFINITION = """struct<marketType:string, countryCode:string, eventTypeId:string, eventName:string, marketTime:string,
  runners:array<struct<id:long, name:string, status:string, bsp:double>>>"""
STREAM_LINE = f"""struct<pt:long, mc:array<struct<id:string, marketDefinition:{DEFINITION},
  rc:array<struct<id:long, ltp:double>>>>>"""

# Seconds before the off at which the last trade is read.
CUTS = {"ltp_preoff": 0, "ltp_60s": 60, "ltp_300s": 300}


def flatten_price_stream(lines: DataFrame, text: str = "value", pos: str = "pos", countries=("GB", "IE"),
                         sport: str = "7") -> DataFrame:
    """One row per runner of each kept market: last trades before the off, starting price, outcome.

    Ticks are reduced by partial ``max_by`` per (market, runner), definitions per
    market, so a market with very many ticks is spread over tasks.
    """
    mc = lines.select(pos, F.from_json(text, STREAM_LINE).alias("l")).select(
        pos, "l.pt", F.posexplode("l.mc").alias("i", "m")).select(
        "pt", F.struct("pt", pos, "i").alias("at"), "m.id", "m.marketDefinition", "m.rc")
    defs = mc.where(F.col("marketDefinition").isNotNull()).groupBy("id").agg(
        F.max_by("marketDefinition", "at").alias("d"),
        F.min_by(F.col("marketDefinition.marketTime"), "at").alias("first_time"))
    defs = defs.where((F.col("d.marketType") == "WIN") & F.col("d.countryCode").isin(*countries)
                      & (F.col("d.eventTypeId") == sport))
    off = F.coalesce(F.try_to_timestamp(F.col("first_time"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
                     F.try_to_timestamp(F.col("first_time"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    defs = defs.select("id", "d", F.unix_millis(off).alias("off_ms"))
    ticks = mc.select("id", "pt", "at", F.posexplode("rc").alias("j", "c")).select(
        "id", "pt", F.struct("at", "j").alias("at"), F.col("c.id").alias("runner"), F.col("c.ltp").alias("ltp")
    ).where(F.col("ltp").isNotNull())
    # One definition per market: small next to the ticks, joined without a hint.
    ticks = ticks.join(defs.select("id", "off_ms"), "id")
    last = ticks.groupBy("id", "runner").agg(
        *[F.max_by("ltp", F.when(F.col("pt") <= F.col("off_ms") - s * 1000, F.col("at"))).alias(n)
          for n, s in CUTS.items()], F.max_by("ltp", "at").alias("ltp_last"))
    active = F.size(F.filter("d.runners", lambda r: r["status"].isin("WINNER", "LOSER")))
    runners = defs.select("id", "d", active.alias("n_runners"), F.explode("d.runners").alias("r")).where(
        F.coalesce("r.status", F.lit("")) != "REMOVED")
    name = X.bare_entrant_name("r.name")
    return runners.select(
        "id", F.col("r.id").alias("runner"), F.substring("d.marketTime", 1, 10).alias("race_date"),
        F.substring("d.marketTime", 12, 5).alias("off_time"), X.track_from_event("d.eventName").alias("track"),
        name.alias("entrant_name"), F.col("r.bsp").alias("bsp"), (F.col("r.status") == "WINNER").cast("int").alias("won"),
        "n_runners").join(last, ["id", "runner"], "left")


BOOK_SCHEMA = """array<struct<name:string, status:string, runners:array<struct<name:string, status:string,
  prices:array<struct<side:string, odds:double, `available-amount`:double>>>>>>"""


def best_price(prices: Column, sides: tuple[str, ...], highest: bool) -> Column:
    """(odds, amount) of the best price on the given sides; the first of equal odds."""
    mine = F.filter(prices, lambda p: F.lower(p["side"]).isin(*sides) & p["odds"].isNotNull())
    rows = F.transform(mine, lambda p, i: F.struct(
        (p["odds"] if highest else -p["odds"]).alias("k"), (-i).alias("i"), p["odds"].alias("odds"),
        p["available-amount"].alias("amount")))
    return F.array_max(rows)


def flatten_order_book(events: DataFrame, markets: str = "markets") -> DataFrame:
    """Best back and lay price per runner of the win market."""
    m = events.withColumn("_m", F.explode(F.from_json(markets, BOOK_SCHEMA))).where(F.upper("_m.name") == "WIN")
    r = m.select(*[c for c in events.columns if c != markets], F.explode("_m.runners").alias("r"))
    back = best_price(F.col("r.prices"), ("back", "win"), True)
    lay = best_price(F.col("r.prices"), ("lay", "lose"), False)
    r = r.withColumn("_b", back).withColumn("_l", lay)
    return r.select(
        *[c for c in events.columns if c != markets], F.col("r.name").alias("entrant_name"),
        F.col("_b.odds").alias("best_back_odds"), F.col("_b.amount").alias("best_back_available"),
        F.col("_l.odds").alias("best_lay_odds"), F.col("_l.amount").alias("best_lay_available"),
        F.col("r.status").alias("book_status"))


def market_table(events: DataFrame, markets: str = "markets", key: str = "event_id") -> DataFrame:
    """One row per market with its runner count and a sample runner."""
    m = events.select(key, F.posexplode_outer(F.from_json(markets, BOOK_SCHEMA)).alias("i", "m"))
    top = F.try_element_at(F.col("m.runners"), F.lit(1))
    return m.select(key, F.col("m.name").alias("market_name"), F.col("m.status").alias("status"),
                    F.coalesce(F.size("m.runners"), F.lit(0)).alias("runner_count"), top["name"].alias("sample_runner"))


def event_country(tags: Column) -> Column:
    """Country from a tag list."""
    hit = F.filter(F.from_json(tags, "array<struct<type:string,name:string,value:string>>"),
                   lambda t: t["type"] == "COUNTRY")
    first = F.try_element_at(hit, F.lit(1))
    return F.coalesce(first["name"], first["value"])


def event_place_and_time(name: Column, start: Column) -> tuple[Column, Column]:
    """Track and off-time from ``14:30 Ascot``; the start timestamp when the name has no time."""
    pattern = r"^(\d{1,2}:\d{2})\s+(.+)$"
    s = F.trim(name)
    hit = s.rlike(pattern)
    return (F.when(hit, F.trim(F.regexp_extract(s, pattern, 2))).otherwise(s),
            F.when(hit, F.regexp_extract(s, pattern, 1)).otherwise(F.substring(start, 12, 5)))


def flatten_speed_map(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """Per-entrant metric map ``{metric: {value, rank}}`` to value and rank columns."""
    m = F.from_json(json, "map<string,struct<value:double,rank:int>>")
    rows = df.select(*keys, m.alias("m"))
    return rows.select(*keys, *[F.col("m").getItem(x)["value"].alias(f"sm_{x}") for x in SPEED_METRICS],
                       *[F.col("m").getItem(x)["rank"].alias(f"sm_{x}_rank") for x in SPEED_METRICS])


def pedigree_from_profile(df: DataFrame, json: str, key: str = "entrant_id") -> DataFrame:
    """Sire, dam, damsire and foaling date of a nested entrant profile."""
    p = F.from_json(json, "struct<sire:struct<name:string>, dam:struct<name:string, sire:struct<name:string>>, "
                          "damsire:struct<name:string>, foaled:string>")
    rows = df.select(key, p.alias("p"))
    return rows.select(key, F.col("p.sire.name").alias("sire"), F.col("p.dam.name").alias("dam"),
                       F.coalesce("p.damsire.name", "p.dam.sire.name").alias("damsire"),
                       F.col("p.foaled").try_cast("date").alias("foaled"))
