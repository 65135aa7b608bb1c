"""The runner table derived from the star-schema tables.

One order is a race, the parts on it are its runners, supplier and brand stand
for jockey and trainer.  Attributes the tables lack (draw, rating, class ...)
are fixed arithmetic over their keys, so DuckDB can derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RACE_TYPES = {"BUILDING": "Hurdle", "MACHINERY": "Chase"}
GOINGS = {"1-URGENT": "Good", "2-HIGH": "Soft", "3-MEDIUM": "Fast", "4-NOT SPECIFIED": "Heavy", "5-LOW": "Yielding"}
SURFACES = {"F": "Turf", "O": "AW", "P": "Polytrack"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mapped(col: str, values: dict[str, str], default: str):
    out = F.when(F.lit(False), F.lit(""))
    for k, v in values.items():
        out = out.when(F.col(col) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def load_runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (race, entrant) with the columns the feature stages expect."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    # Lines meet parts while they are narrow and go to their order once: the sums, the join with
    # the orders and the windows below all find them there.
    parts = ["p_name", "p_brand", "p_type", "p_size"]
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_partkey", *parts)
        .agg(
            F.min("l_suppkey").alias("jockey"),
            F.round(F.sum("l_extendedprice"), 2).alias("ep"),
            F.sum("l_quantity").alias("qty"),
        )
    )

    h, r = F.col("l_partkey"), F.col("l_orderkey")
    order_year = F.year("race_date")
    base = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("race_date", F.to_date("o_orderdate"))
        .withColumn("nf", ((h * 13 + r) % 17 == 0).cast("int"))
    )
    race = Window.partitionBy("l_orderkey")
    finish = F.row_number().over(race.orderBy("nf", F.desc("ep"), "l_partkey"))
    top = F.max(F.when(F.col("nf") == 0, F.col("ep"))).over(race)
    finished = F.col("nf") == 0
    runners = F.count(F.lit(1)).over(race)
    equipment = (h + r) % 7
    return base.select(
        r.alias("race_id"),
        "race_date",
        h.alias("entrant_id"),
        F.concat(F.col("p_name"), F.lit(" "), h.cast("string")).alias("entrant_name"),
        "jockey",
        F.col("p_brand").alias("trainer"),
        F.col("n_name").alias("track"),
        _mapped("o_orderpriority", GOINGS, "Good").alias("going"),
        _mapped("c_mktsegment", RACE_TYPES, "Flat").alias("race_type"),
        _mapped("o_orderstatus", SURFACES, "Turf").alias("surface"),
        F.concat(F.lit("Class "), (r % 6 + 1).cast("string")).alias("race_class"),
        F.floor("o_totalprice").cast("double").alias("prize_money"),
        (F.lit(5.0) + (F.col("o_custkey") % 20) / F.lit(2.0)).cast("double").alias("distance_furlongs"),
        (r % 2).cast("int").alias("handicap"),
        (F.lit(12.0) * 60 + r % 480).cast("int").alias("off_minute"),
        (F.lit(115.0) + F.col("p_size")).cast("double").alias("weight_lbs"),
        (2 + F.col("p_size") % 8).cast("int").alias("age"),
        F.when(h % 3 == 0, "Mare").when(order_year - 1995 >= h % 7, "Gelding").otherwise("Colt").alias("sex"),
        F.when((h + r) % 11 == 0, 0.0).otherwise((40 + (h * 7 + r * 3) % 80).cast("double")).alias("official_rating"),
        F.concat_ws("-", F.col("p_type"), (h % 40).cast("string")).alias("sire"),
        F.concat(F.lit("Dam "), (h % 500).cast("string")).alias("dam"),
        F.concat_ws("-", F.col("p_brand"), (h % 3).cast("string")).alias("damsire"),
        F.when(equipment == 1, "[{'symbol': 'b', 'name': 'Blinkers', 'count': 1}]")
        .when(equipment == 2, "[{'symbol': 't', 'name': 'Tongue strap', 'count': 3}, "
                              "{'symbol': 'p', 'name': 'Cheekpieces', 'count': 1}]")
        .when(equipment == 3, "[{'symbol': 'v', 'name': 'Visor', 'count': 2}]")
        .otherwise("").alias("headgear"),
        F.row_number().over(race.orderBy("l_partkey")).cast("int").alias("draw"),
        runners.cast("int").alias("num_runners"),
        (F.lit(1.5) + F.col("qty") / 5.0).cast("double").alias("odds"),
        F.when(finished, finish).otherwise(0).cast("int").alias("finish_position"),
        F.when(finished, F.lit("")).otherwise(F.lit("PU")).alias("finish_pos_label"),
        F.when(finished & (finish == 1), 1).otherwise(0).cast("int").alias("won"),
        F.when(finished, F.floor((top - F.col("ep")) / F.lit(10.0)) / F.lit(1000.0)).cast("double").alias("lengths_behind"),
    )


# The same rows in DuckDB; the prefix of every check query over runners.
RUNNERS_SQL = """
li as (
  select l_orderkey, l_partkey, min(l_suppkey) as jockey, round(sum(l_extendedprice), 2) as ep,
         sum(l_quantity) as qty
  from lineitem group by l_orderkey, l_partkey),
base as (
  select li.*, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_mktsegment, n_name,
         p_name, p_brand, p_type, p_size, cast(o_orderdate as date) as race_date,
         case when (l_partkey * 13 + l_orderkey) % 17 = 0 then 1 else 0 end as nf
  from li join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey),
placed as (
  select *, row_number() over (partition by l_orderkey order by nf, ep desc, l_partkey) as fin,
         max(case when nf = 0 then ep end) over (partition by l_orderkey) as top_ep
  from base),
runners as (
  select l_orderkey as race_id, race_date, l_partkey as entrant_id,
    p_name || ' ' || cast(l_partkey as varchar) as entrant_name, jockey, p_brand as trainer, n_name as track,
    case o_orderpriority when '1-URGENT' then 'Good' when '2-HIGH' then 'Soft' when '3-MEDIUM' then 'Fast'
      when '4-NOT SPECIFIED' then 'Heavy' when '5-LOW' then 'Yielding' else 'Good' end as going,
    case c_mktsegment when 'BUILDING' then 'Hurdle' when 'MACHINERY' then 'Chase' else 'Flat' end as race_type,
    case o_orderstatus when 'F' then 'Turf' when 'O' then 'AW' when 'P' then 'Polytrack' else 'Turf' end as surface,
    'Class ' || cast(l_orderkey % 6 + 1 as varchar) as race_class, floor(o_totalprice) as prize_money,
    cast(5 + (o_custkey % 20) / 2.0 as double) as distance_furlongs,
    cast(l_orderkey % 2 as integer) as handicap, cast(720 + l_orderkey % 480 as integer) as off_minute,
    cast(115 + p_size as double) as weight_lbs, cast(2 + p_size % 8 as integer) as age,
    case when l_partkey % 3 = 0 then 'Mare' when year(race_date) - 1995 >= l_partkey % 7 then 'Gelding'
      else 'Colt' end as sex,
    cast(case when (l_partkey + l_orderkey) % 11 = 0 then 0 else 40 + (l_partkey * 7 + l_orderkey * 3) % 80 end
      as double) as official_rating,
    p_type || '-' || cast(l_partkey % 40 as varchar) as sire, 'Dam ' || cast(l_partkey % 500 as varchar) as dam,
    p_brand || '-' || cast(l_partkey % 3 as varchar) as damsire,
    case (l_partkey + l_orderkey) % 7 when 1 then 'b1' when 2 then 't3p1' when 3 then 'v2' else '' end as gear,
    cast(row_number() over (partition by l_orderkey order by l_partkey) as integer) as draw,
    cast(count(*) over (partition by l_orderkey) as integer) as num_runners,
    cast(1.5 + qty / 5.0 as double) as odds,
    cast(case when nf = 0 then fin else 0 end as integer) as finish_position,
    case when nf = 0 then '' else 'PU' end as finish_pos_label,
    cast(case when nf = 0 and fin = 1 then 1 else 0 end as integer) as won,
    cast(case when nf = 0 then floor((top_ep - ep) / cast(10 as double)) / cast(1000 as double) end as double) as lengths_behind
  from placed)
"""

# Result-dependent columns read by the history features.
FLAGS_SQL = """
r as (
  select *, 1 as started, 1 as rs, case when finish_position > 0 then 1 else 0 end as finished,
    case when finish_position = 0 then 1 else 0 end as nonfin,
    case when finish_position > 0 then finish_position end as fp,
    case when finish_position between 1 and 3 then 1.0 else 0.0 end as placed
  from runners)
"""
