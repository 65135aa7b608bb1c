"""Text parsers, key normalisers, cleaning and nested sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features_entrant import KEY, dbls, ints, pick
from formbook.catalog.registry import WITH_RUNNERS, i64, query, r6, r6_sql, runner_skew, runner_table
from formbook.features.flags import add_result_flags
from formbook.functions import text as X
from formbook.operators import cleaning as K
from formbook.operators import tables as T
from formbook.sources import nested as N
from formbook.sources.runners import table


def txt(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("form_strings", "P8 P9 P10 P11 D1", f"""with f as (select o_orderkey as k, o_orderkey % 9 as a, o_custkey % 10 as b,
  (o_orderkey + o_custkey) % 10 as c from orders),
d as (select *, list_filter([a, b, c], lambda x: x > 0) as ds from f)
select k, {dbls(last_pos='c', mean_pos='case when len(ds) > 0 then list_sum(ds) / cast(len(ds) as double) else 5 end',
  trend='''case len(ds) when 3 then (ds[3] - ds[1]) / 2.0 when 2 then cast(ds[2] - ds[1] as double) else 0 end''')},
  {ints(wins='cast(a = 1 as integer) + cast(b = 1 as integer) + cast(c = 1 as integer)', digits='3',
        non_completions='case when k % 4 = 0 then 1 else 0 end', has_break='k % 2')} from d""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, a, b = F.col("o_orderkey"), F.col("o_orderkey") % 9, F.col("o_custkey") % 10
    form = txt(a, b, F.when(k % 4 == 0, "P").otherwise("-"), F.when(k % 2 == 1, "/").otherwise("-"),
               (k + F.col("o_custkey")) % 10)
    df = o.select(k.alias("k"), form.alias("form"))
    f = F.col("form")
    return df.select("k", r6(X.form_last(f), "last_pos"), r6(X.form_mean(f), "mean_pos"), r6(X.form_trend(f), "trend"),
                     i64(X.form_wins(f), "wins"), i64(X.form_length(f), "digits"),
                     i64(X.form_non_completions(f), "non_completions"), i64(X.form_has_break(f), "has_break"))


@query("card_text", "P24 P25 P26 P27 P28 D1", f"""with t as (select o_orderkey as k, o_custkey as c from orders)
select k, {dbls(furlongs='''case when k % 7 = 0 then 10 else round_even(cast((c % 3 + 1) * 8 + k % 8 as double)
    + (k % 220) / 220.0, 2) end''', pounds='''case when k % 5 = 0 then 140 else (8 + c % 4) * 14 + k % 14 end''',
  odds='''case k % 4 when 0 then 2.0 when 1 then round_even((c % 9 + 1) / cast(4 as double) + 1, 2)
    when 2 then 5.0 else (k % 50 + 11) / cast(10 as double) end''',
  lengths='''case k % 4 when 0 then 0.3 when 1 then c % 9 + 0.5 when 2 then c % 9 + 0.25 else null end''')},
  case k % 3 when 0 then 'Chase' when 1 then 'Hurdle' else 'Flat' end as kind from t""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 7 == 0, "").otherwise(txt(c % 3 + 1, "m ", k % 8, "f ", k % 220, "y")).alias("d"),
        F.when(k % 5 == 0, "").otherwise(txt(8 + c % 4, "-", k % 14)).alias("w"),
        F.when(k % 4 == 0, "Evs").when(k % 4 == 1, txt(c % 9 + 1, "/4F")).when(k % 4 == 2, "n/a")
        .otherwise(((k % 50 + 11) / F.lit(10.0)).cast("string")).alias("o"),
        F.when(k % 4 == 0, "nk").when(k % 4 == 1, txt(c % 9, " ½")).when(k % 4 == 2, txt(c % 9, "¼")).otherwise("")
        .alias("l"),
        F.when(k % 3 == 0, "Juddmonte Chase").when(k % 3 == 1, "Novices Hurdle Race").otherwise("Maiden Stakes").alias("n"),
        F.when(k % 2 == 0, "").otherwise(F.when(k % 3 == 0, "CHASE").when(k % 3 == 1, "HURDL").otherwise("BUMPER"))
        .alias("t"))
    return df.select("k", r6(X.distance_furlongs("d"), "furlongs"), r6(X.weight_pounds("w"), "pounds"),
                     r6(X.fractional_odds("o"), "odds"), r6(X.beaten_lengths("l"), "lengths"),
                     X.race_type("n", "t").alias("kind"))


@query("off_times", "P2 P3 P20 P42", """with t as (select o_orderkey as k, o_orderkey % 24 as h, o_custkey % 60 as m,
  cast(o_orderdate as date) as d from orders),
s as (select *, case when k % 4 = 3 then 43200 else h * 3600 + m * 60 + case when k % 4 = 1 then 30 else 0 end end as secs
  from t)
select k, secs as seconds, epoch(d::timestamp) + secs as event_epoch,
  case when k % 4 = 3 then 'tba' else lpad(cast(h as varchar), 2, '0') || ':' || lpad(cast(m as varchar), 2, '0') end
    as off_key,
  strftime(timezone('Europe/London', timezone('UTC', d::timestamp + to_minutes(h * 60 + m))), '%H:%M') as local_off from s""")
def _(spark, sf):
    k, h, m = F.col("o_orderkey"), F.col("o_orderkey") % 24, F.col("o_custkey") % 60
    hh, mm = F.lpad(h.cast("string"), 2, "0"), F.lpad(m.cast("string"), 2, "0")
    df = table(spark, sf, "orders").select(
        k.alias("k"), F.to_date("o_orderdate").alias("d"), h.alias("h"), m.alias("m"),
        F.when(k % 4 == 0, F.concat(hh, mm)).when(k % 4 == 1, F.concat(h.cast("string"), F.lit(":"), mm, F.lit(":30")))
        .when(k % 4 == 2, F.concat(hh, F.lit(":"), mm, F.lit(" BST"))).otherwise("tba").alias("t"))
    utc = F.timestamp_seconds(F.unix_date("d").cast("long") * 86400 + F.col("h") * 3600 + F.col("m") * 60)
    return df.select("k", i64(X.off_time_seconds("t"), "seconds"),
                     F.unix_seconds(X.event_time("d", "t")).cast("double").alias("event_epoch"),
                     X.off_time_key("t").alias("off_key"), X.local_off_time(utc).alias("local_off"))


@query("names_and_keys", "P4 P5 P20 P21 P22 P23 H5", """with p as (select p_partkey as k, p_name as n, lower(p_brand) as b
  from part),
w as (select *, upper(n[1]) || split_part(n[2:], ' ', 1) as w1, upper(split_part(n, ' ', 2)[1]) || split_part(n, ' ', 2)[2:]
  as w2 from p)
select k, w1 || '''' || w2 || '-On-' || w2 as title, 'J P ' || w2 as person, n as track_key, w1 || ' ' || w2 as entrant_key,
  lower(w1) || 's ' || lower(w2) as exchange_key, case when k % 5 = 0 then 'epsom' else n end as exchange_track,
  replace(n, ' ', '-') || '-' || replace(b, '#', '-') as slug, w1 || ' ' || w2 as bare, w1 as event_track from w""")
def _(spark, sf):
    n, k = F.col("p_name"), F.col("p_partkey")
    df = table(spark, sf, "part")
    w1, w2 = F.element_at(F.split(n, " "), 1), F.element_at(F.split(n, " "), 2)
    return df.select(
        k.alias("k"), X.title_case(F.concat(F.lit(" "), F.upper(w1), F.lit("'"), w2, F.lit("-on-"), w2)).alias("title"),
        X.person_name(F.concat(F.lit("j.p. "), w2, F.lit(" "))).alias("person"),
        X.track_key(F.concat(F.lit(" "), F.upper(w1), F.lit("   "), w2)).alias("track_key"),
        X.entrant_key(F.concat(w1, F.lit("  "), F.upper(w2))).alias("entrant_key"),
        X.exchange_entrant_key(F.concat(w1, F.lit("'s "), w2)).alias("exchange_key"),
        X.exchange_track_key(F.when(k % 5 == 0, "Epsom  Downs").otherwise(F.upper(n))).alias("exchange_track"),
        X.slug(F.concat(n, F.lit(" & "), F.col("p_brand"))).alias("slug"),
        X.bare_entrant_name(F.concat((k % 20).cast("string"), F.lit(". "), F.initcap(w1), F.lit(" "), F.initcap(w2),
                                   F.lit(" (IRE)"))).alias("bare"),
        X.track_from_event(F.concat(F.initcap(w1), (k % 28 + 1).cast("string"), F.lit("th Oct"))).alias("event_track"))


@query("going_groups_and_calendar", "P12 P13 P19 P1 P6", f"""with o as (select o_orderkey as k, cast(o_orderdate as date) as d,
  o_orderkey % 6 as g from orders)
select k, case g when 0 then 'Fast' when 1 then 'Good' when 2 then 'Soft' when 3 then 'Heavy' when 4 then 'Yielding'
  else 'Good' end as going,
  {ints(month='month(d)', day_of_week='isodow(d) - 1', day_of_year='dayofyear(d)', year='year(d)',
        season_Summer='month(d) in (6, 7, 8)', season_Winter='month(d) in (12, 1, 2)')} from o""")
def _(spark, sf):
    texts = ["Firm (Good To Firm In Places)", " standard / SLOW", "Good To Soft (Soft In Places)", "Soft To Heavy",
             "Yielding To Soft", "unknown words"]
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        k.alias("k"), F.to_date("o_orderdate").alias("race_date"),
        F.element_at(F.array(*[F.lit(t) for t in texts]), (k % 6 + 1).cast("int")).alias("g"))
    df = K.add_time_features(df)
    return df.select("k", X.going_group("g").alias("going"), *[i64(c) for c in (
        "month", "day_of_week", "day_of_year", "year", "season_Summer", "season_Winter")])


# A raw race card: numbers as text, some of them broken.
def raw_cards(spark, sf):
    df = runner_table(spark, sf)
    h, r = F.col("entrant_id"), F.col("race_id")
    return df.select(
        "race_id", F.when((h + r) % 97 == 0, "not a date").otherwise(F.col("race_date").cast("string")).alias("race_date"),
        "entrant_id", F.lower("entrant_name").alias("entrant_name"),
        F.when((h + r) % 13 == 0, "n/a").otherwise(F.col("odds").cast("string")).alias("odds"),
        F.col("official_rating").cast("string").alias("official_rating"),
        F.col("finish_position").cast("string").alias("finish_position"),
        F.when(h % 19 == 0, None).otherwise(F.col("weight_lbs").cast("string")).alias("weight_lbs"))


@query("clean_cards", "P1 P6 P14 P15 P16 F1", f"""{WITH_RUNNERS}, c as (select *, case when (entrant_id + race_id) % 13 <> 0
    then odds end as o, case when entrant_id % 19 <> 0 then weight_lbs end as w from runners
  where (entrant_id + race_id) % 97 <> 0),
m as (select median(o) as mo, median(case when official_rating > 0 then official_rating end) as mr, median(w) as mw from c),
x as (select *, median(case when official_rating > 0 then official_rating end) over (partition by race_id) as rr from c, m)
select race_id, entrant_id, {ints(has_official_rating='official_rating > 0')},
  {dbls(odds='coalesce(o, mo)', weight_lbs='coalesce(w, mw)',
        official_rating='case when official_rating > 0 then official_rating else coalesce(rr, mr) end')} from x""")
def _(spark, sf):
    raw = raw_cards(spark, sf)
    medians = K.fit_medians(raw.where(F.col("race_date").try_cast("date").isNotNull()))
    return pick(K.clean(raw, medians, runner_skew(spark, sf)), "has_official_rating", "odds weight_lbs official_rating")


@query("one_hot_and_frequency", "P17 P18", f"""{WITH_RUNNERS}, f as (select *,
  row_number() over (partition by jockey order by race_date, race_id, entrant_id) as jf,
  row_number() over (partition by track order by race_date, race_id, entrant_id) as tf from runners)
select race_id, entrant_id, {ints(jockey_freq='jf', track_freq='min(tf) over (partition by race_id)',
  going_Good="going = 'Good'", going_Soft="going = 'Soft'", race_type_Flat="race_type = 'Flat'")} from f""")
def _(spark, sf):
    df = runner_table(spark, sf)
    df = K.one_hot(df, K.categories(df, ["going", "race_type"]))
    df = K.add_frequency_encoding(df, ["jockey"], ["track"], runner_skew(spark, sf))
    return pick(df, "jockey_freq track_freq going_Good going_Soft race_type_Flat")


@query("result_status", "P38", f"""{WITH_RUNNERS} select race_id, entrant_id, case when finish_position > 0 then 'FINISHED'
  when finish_pos_label <> '' then 'NON_FINISHER' else 'PENDING' end as status, finish_position > 0 as fin_flag
from runners""".replace(", finish_position > 0 as fin_flag", ""))
def _(spark, sf):
    return add_result_flags(runner_table(spark, sf)).select(*KEY, "status")


@query("numeric_text_and_narrowing", "P7 P37", f"""{WITH_RUNNERS} select entrant_id, race_id,
  cast(case when (entrant_id + race_id) % 13 <> 0 then odds end as double) as odds, 'smallint' as draw_type from runners
""".replace("'smallint'", "'tinyint'"))
def _(spark, sf):
    df = T.numeric_text_columns(raw_cards(spark, sf).drop("race_date"), ["odds", "entrant_name"])
    kind = dict(T.narrow_integers(runner_table(spark, sf), ["draw"]).dtypes)["draw"]
    all_rows = runner_table(spark, sf).select(*KEY).join(df.select(*KEY, "odds"), KEY)
    return all_rows.select(*KEY, "odds", F.lit(kind).alias("draw_type"))


# ---- nested sources ------------------------------------------------------------


def race_pages(spark, sf):
    """Race pages as JSON text, one per race (a page lists one race's field)."""
    h, r = F.col("entrant_id"), F.col("race_id")
    label = F.when(F.col("finish_position") > 0, F.col("finish_position").cast("string")).otherwise("pu")
    ride = F.struct(
        F.when((h + r) % 23 == 0, "NON-RUNNER").otherwise("RUNNER").alias("ride_status"),
        F.struct(F.col("entrant_name").alias("name"), F.struct(h.cast("string").alias("id")).alias("entrant_reference"),
                 F.col("age").alias("age"), F.struct(F.col("sex").alias("type")).alias("sex")).alias("entrant"),
        F.struct(F.col("jockey").cast("string").alias("name")).alias("jockey"),
        F.concat((F.floor(F.col("weight_lbs") / 14)).cast("string"), F.lit("-"),
                 (F.col("weight_lbs").cast("int") % 14).cast("string")).alias("handicap"),
        F.col("draw").alias("cloth_number"), F.col("official_rating").cast("int").alias("official_rating"),
        F.array(F.struct(F.lit(False).alias("bestOdds"), F.lit("9/1").alias("fractionalOdds")),
                F.struct((h % 2 == 0).alias("bestOdds"), F.concat((h % 7 + 1).cast("string"), F.lit("/2"))
                         .alias("fractionalOdds"))).alias("bookmakerOdds"),
        label.alias("finish_position"), F.when(F.col("finish_position") > 1, "2 ½").otherwise("").alias("finish_distance"))
    page = F.struct(
        r.alias("race_id"), F.struct(F.first("track").alias("name")).alias("course"),
        F.array(F.struct(F.lit(2).alias("position"), F.lit("10 GBP").alias("prize")),
                F.struct(F.lit(1).alias("position"), F.concat(F.first("prize_money").cast("int").cast("string"),
                                                             F.lit(" GBP")).alias("prize"))).alias("prizes"),
        F.collect_list(ride).alias("rides"))
    return runner_table(spark, sf).groupBy("race_id").agg(F.to_json(page).alias("json"))


@query("race_pages_flattened", "S11 S13", f"""{WITH_RUNNERS} select race_id, cast(entrant_id as varchar) as entrant_id, sex,
  cast(jockey as varchar) as jockey, case when finish_position > 0 then '' else 'PU' end as finish_pos_label,
  {ints(age='age', draw='draw', finish_position='finish_position', won='finish_position = 1',
        official_rating='official_rating')},
  {dbls(prize_money='prize_money', weight_lbs='weight_lbs', odds='case when entrant_id % 2 = 0 then (entrant_id % 7 + 1) / 2.0 + 1 '
        'else 10 end', lengths_behind='case when finish_position = 1 then 0 when finish_position > 1 then 2.5 end')}
from runners where (entrant_id + race_id) % 23 <> 0""")
def _(spark, sf):
    df = N.flatten_pages(race_pages(spark, sf))
    return pick(df, "age draw finish_position won official_rating", "prize_money weight_lbs odds lengths_behind",
                ["race_id", "entrant_id", "sex", "jockey", "finish_pos_label"])


def price_lines(spark, sf):
    """Market-change lines built from the event stream: definitions first, then one tick per event."""
    e = table(spark, sf, "events")
    pt = F.unix_millis(F.col("ts").cast("timestamp"))
    tick = F.struct(pt.alias("pt"), F.array(F.struct(
        F.col("event_type").alias("id"),
        F.array(F.struct((F.col("user_id") % 12).alias("id"), F.col("value").alias("ltp"))).alias("rc"))).alias("mc"))
    runner = F.col("user_id") % 12
    runners = F.array_sort(F.collect_set(F.struct(
        runner.alias("id"), F.concat(runner.cast("string"), F.lit(". Entrant "), runner.cast("string"), F.lit(" (IRE)"))
        .alias("name"), F.when(runner == 3, "WINNER").when(runner == 11, "REMOVED").otherwise("LOSER").alias("status"),
        (runner + 2.5).cast("double").alias("bsp"))))
    kind = F.col("event_type")
    definition = e.groupBy("event_type").agg(runners.alias("runners")).select(
        F.lit(0).cast("long").alias("pos"), F.to_json(F.struct(F.lit(0).cast("long").alias("pt"), F.array(F.struct(
            kind.alias("id"), F.struct(
                F.when(kind == "error", "PLACE").otherwise("WIN").alias("marketType"), F.lit("GB").alias("countryCode"),
                F.lit("7").alias("eventTypeId"), F.lit("Ascot 20th Jan").alias("eventName"),
                F.lit("2024-01-20T12:00:00.000Z").alias("marketTime"), F.col("runners").alias("runners"))
            .alias("marketDefinition"))).alias("mc"))).alias("value"))
    return definition.unionByName(e.select((F.col("event_id") + 1).alias("pos"), F.to_json(tick).alias("value")))


@query("price_stream_flattened", "S14 S15 J19 D5", """with e as (select event_type as id, user_id % 12 as runner, value,
  epoch_ms(ts) as pt, event_id, epoch_ms(timestamp '2024-01-20 12:00:00') as off_ms from events where event_type <> 'error'),
t as (select id, runner, arg_max(value, pt * 1000000 + event_id) filter (pt <= off_ms) as ltp_preoff,
  arg_max(value, pt * 1000000 + event_id) filter (pt <= off_ms - 60000) as ltp_60s,
  arg_max(value, pt * 1000000 + event_id) filter (pt <= off_ms - 300000) as ltp_300s,
  arg_max(value, pt * 1000000 + event_id) as ltp_last from e where runner <> 11 group by 1, 2)
select id, runner, 'Ascot' as track, '2024-01-20' as race_date, '12:00' as off_time, 'Entrant ' || runner as entrant_name,
  cast(runner = 3 as bigint) as won, 11::bigint as n_runners, runner + 2.5::double as bsp, ltp_preoff, ltp_60s, ltp_300s,
  ltp_last from t""")
def _(spark, sf):
    df = N.flatten_price_stream(price_lines(spark, sf))
    return df.select("id", "runner", "track", "race_date", "off_time", "entrant_name", i64("won"), i64("n_runners"), "bsp",
                     "ltp_preoff", "ltp_60s", "ltp_300s", "ltp_last")


def order_books(spark, sf):
    """One event per order with a win market built from its lines."""
    li = table(spark, sf, "lineitem")
    price = F.struct(F.when(F.col("l_returnflag") == "R", "lay").otherwise("Back").alias("side"),
                     (F.col("l_quantity") + 1.5).alias("odds"), F.col("l_extendedprice").alias("available-amount"))
    # Prices of a runner, then runners of an event: both bounded by the order's lines.
    r = li.groupBy("l_orderkey", "l_partkey").agg(F.array_sort(F.collect_list(price)).alias("prices"))
    m = r.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("Entrant "), F.col("l_partkey").cast("string")).alias("name"), F.lit("open").alias("status"),
        F.col("prices").alias("prices")))).alias("runners"))
    h = F.lpad((F.col("event_id") % 10 + 12).cast("string"), 2, "0")
    return m.select("event_id", F.concat(h, F.lit(":30 Ascot")).alias("name"), F.lit("2024-01-20T12:00:00Z").alias("start"),
                    F.lit('[{"type":"SPORT","name":"x"},{"type":"COUNTRY","name":"UK"}]').alias("tags"),
                    F.to_json(F.array(F.struct(F.lit("WIN").alias("name"), F.lit("open").alias("status"), "runners")))
                    .alias("markets"))


BOOK_SQL = """book as (select l_orderkey as event_id, 'Entrant ' || l_partkey as entrant_name,
  max(l_quantity + 1.5) filter (l_returnflag <> 'R') as best_back_odds,
  arg_min(l_extendedprice, {'q': -l_quantity, 'p': l_extendedprice}) filter (l_returnflag <> 'R') as best_back_available,
  min(l_quantity + 1.5) filter (l_returnflag = 'R') as best_lay_odds,
  arg_min(l_extendedprice, {'q': l_quantity, 'p': l_extendedprice}) filter (l_returnflag = 'R') as best_lay_available
  from lineitem group by 1, 2)"""


@query("order_book_flattened", "S17 S18 S19 S12", f"""with {BOOK_SQL} select event_id, entrant_name, best_back_odds,
  best_back_available, best_lay_odds, best_lay_available, 'Ascot' as track,
  lpad(cast(event_id % 10 + 12 as varchar), 2, '0') || ':30' as off_time, 'UK' as country, count(*) over (partition by
  event_id) as runner_count from book""")
def _(spark, sf):
    events = order_books(spark, sf)
    track, off = N.event_place_and_time(F.col("name"), F.col("start"))
    book = N.flatten_order_book(events)
    markets = N.market_table(events).select("event_id", i64("runner_count"))
    return book.join(markets, "event_id").select(
        "event_id", "entrant_name", "best_back_odds", "best_back_available", "best_lay_odds", "best_lay_available",
        track.alias("track"), off.alias("off_time"), N.event_country(F.col("tags")).alias("country"), "runner_count")


@query("meeting_filter", "S12 P23", """select page_id, cast(page_id % 3 = 0 or page_id % 5 = 0 or url like '%/fr/%' as bigint)
  as keep from pages""")
def _(spark, sf):
    k = F.col("page_id")
    country = F.when(k % 3 == 0, "Ireland").otherwise("France")
    feed = F.when(k % 5 == 0, "ATR").otherwise("other")
    course = F.when(F.col("url").contains("/fr/"), "Bangor On Dee").otherwise("Longchamp")
    return table(spark, sf, "pages").select("page_id", i64(N.keep_meeting(country, course, feed, ("bangor-on-dee",)), "keep"))


@query("nested_profiles", "S24 S25 J1", f"""{WITH_RUNNERS} select distinct on (entrant_id) entrant_id, sire, dam, 'x' as y from runners
""".replace("distinct on (entrant_id) entrant_id, sire, dam, 'x' as y", "distinct entrant_id, sire, dam, damsire, "
            + r6_sql("30 + entrant_id % 7", "sm_top_speed") + ", cast(entrant_id % 12 as bigint) as sm_fsp_rank"))
def _(spark, sf):
    h = F.col("entrant_id")
    profile = F.to_json(F.struct(
        F.struct(F.col("sire").alias("name")).alias("sire"),
        F.struct(F.col("dam").alias("name"), F.struct(F.col("damsire").alias("name")).alias("sire")).alias("dam"),
        F.lit("1994-03-01").alias("foaled")))
    metrics = F.to_json(F.struct(F.struct((30.0 + h % 7).alias("value"), F.lit(1).alias("rank")).alias("top_speed"),
                                 F.struct(F.lit(1.0).alias("value"), (h % 12).alias("rank")).alias("fsp")))
    df = runner_table(spark, sf).select("entrant_id", profile.alias("p"), metrics.alias("m")).distinct()
    a = N.pedigree_from_profile(df, "p")
    b = N.flatten_speed_map(df, "m", ["entrant_id"])
    return a.join(b, "entrant_id").select("entrant_id", "sire", "dam", "damsire", r6("sm_top_speed"), i64("sm_fsp_rank"))
