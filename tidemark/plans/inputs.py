"""Sensor-like inputs derived from the given tables, in Spark and, word for word the same, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value (sum), mean_value, n: events by type and day."""
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return e.groupBy(F.col("event_type").alias("series_id"), "date").agg(F.round(F.sum("value"), 4).alias("value"), F.round(F.avg("value") * 1.000371, 4).alias("mean_value"), F.count("*").alias("n"))


DAILY = "daily as (select event_type as series_id, cast(ts as date) as date, round(sum(value), 4) as value, round(avg(value) * 1.000371, 4) as mean_value, count(*) as n from events group by 1, 2)"


def user_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by user, with real gaps in the calendar."""
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return e.groupBy(F.col("user_id").cast("string").alias("series_id"), "date").agg(F.round(F.sum("value"), 4).alias("value"), F.count("*").alias("n"))


USER_DAILY = "user_daily as (select cast(user_id as varchar) as series_id, cast(ts as date) as date, round(sum(value), 4) as value, count(*) as n from events group by 1, 2)"


def order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, x (orders), y (revenue in thousands): orders by priority and day, over years."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), "date").agg(F.count("*").cast("double").alias("x"), F.round(F.sum("o_totalprice") / 1000.371, 4).alias("y"))


ORDER_DAILY = "order_daily as (select o_orderpriority as series_id, cast(o_orderdate as date) as date, cast(count(*) as double) as x, round(sum(o_totalprice) / 1000.371, 4) as y from orders group by 1, 2)"


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series in order of event_id, one row a day, with values missing in short and long gaps; load is always there."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    gap = (i % 5).isin(1, 2) | (i % 1000).between(300, 460)
    return e.select(F.lit("all").alias("series_id"), "event_id", F.date_add(F.lit("1970-01-01").cast("date"), (i + F.floor(i / 50)).cast("int")).alias("date"), F.when(~gap, F.col("value")).alias("value"), (F.col("value") * 1.000371937193).alias("load"))


ONE_SERIES = """one_series as (select 'all' as series_id, event_id, date '1970-01-01' + cast(event_id + event_id // 50 as integer) as date,
  case when event_id % 5 in (1, 2) or event_id % 1000 between 300 and 460 then null else value end as value, value * 1.000371937193 as load from events)"""


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, event_id, raw_value and a cell rule: event values as raw text, with blanks, words, zeros, negatives and flat runs."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = F.when(i % 17 == 0, "").when(i % 19 == 0, "bad").when(i % 23 == 0, "0").when(i % 29 == 0, "-1").when(i % 31 == 0, "nan")
    raw = raw.when((i % 400).between(100, 180), "7").otherwise(F.col("value").cast("decimal(18,4)").cast("string"))
    return e.select(F.col("event_type").alias("series_id"), "event_id", raw.alias("raw_value"), F.lit(0.0).alias("minimum"), F.lit(None).cast("double").alias("maximum"), F.lit(True).alias("zero_missing"), F.lit(True).alias("flatline"))


RAW_CELLS = """raw_cells as (select event_type as series_id, event_id, case when event_id % 17 = 0 then '' when event_id % 19 = 0 then 'bad' when event_id % 23 = 0 then '0'
  when event_id % 29 = 0 then '-1' when event_id % 31 = 0 then 'nan' when event_id % 400 between 100 and 180 then '7' else cast(cast(value as decimal(18,4)) as varchar) end as raw_value from events)"""

#: Measures of a panel: column, and its formula over the day's line items of one side. The odd factors keep results off the ties at which engines round differently.
PANEL_FORMULAS = {
    "temperature": "38.5 + (avg(l_quantity) - 25.5) * 0.1200371",
    "pH": "7.9 + (avg(l_tax) - 0.04) * 10.00371",
    "VFA": "2900 + (avg(l_discount) - 0.05) * 35003.713719",
    "ALK": "16500 + (avg(l_extendedprice) - 53000) * 0.0800371",
    "TAN": "4000 + (avg(l_quantity) - 25.5) * 150.037193",
    "FAN": "520 + (avg(l_tax) - 0.04) * 12003.713719",
    "TS": "2.6 + (avg(l_tax) - 0.04) * 20.00371",
    "VS": "1.1 + (avg(l_discount) - 0.05) * 15.00371",
    "CODcr": "25000 + (avg(l_extendedprice) - 53000) * 0.500371",
    "feed": "sum(l_quantity)",
    "biogas": "sum(l_extendedprice) / 10.00371",
    "purity": "60 + (avg(l_discount) - 0.05) * 200.0371",
}
EPOCH = "1995-01-01"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date and for each measure the columns _A and _B, with some statuses and sample ages."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date"), F.when(F.col("l_linestatus") == "F", "A").when(F.col("l_linestatus") == "O", "B").alias("side"), "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    sides = items.filter("side is not null").groupBy("series_id", "date", "side").agg(*(F.expr(f).alias(k) for k, f in PANEL_FORMULAS.items()))
    offset = F.datediff("date", F.lit(EPOCH).cast("date"))
    sides = sides.withColumn("VFA", F.col("VFA") * F.when(offset % 97 == 0, 3).otherwise(1)).withColumn("VFA_TA", F.col("VFA") / F.col("ALK"))
    names = [*PANEL_FORMULAS, "VFA_TA"]
    wide = sides.groupBy("series_id", "date").agg(*(F.round(F.max(F.when(F.col("side") == s, F.col(v))), 4).alias(f"{v}_{s}") for v in names for s in dims.SIDES))
    status = lambda c, n, bad: F.when(F.col(c).isNull(), "MISSING").when(offset % n == 0, bad).otherwise("VALID")
    return wide.withColumns({"temperature_A_dq": status("temperature_A", 31, "INVALID_RANGE"), "pH_B_dq": status("pH_B", 17, "SUSPECT_SPIKE"), "TAN_A_age": F.when(offset % 41 == 0, 20).otherwise(3), "TAN_B_age": F.when(offset % 43 == 0, 20).otherwise(3)})


def _panel_sql() -> str:
    formulas = ", ".join(f"{f} as {k}" for k, f in PANEL_FORMULAS.items())
    wide = ", ".join(f"round(max(case when side = '{s}' then {v} end), 4) as {v}_{s}" for v in [*PANEL_FORMULAS, "VFA_TA"] for s in dims.SIDES)
    return f"""items as (select l_returnflag as series_id, cast(l_shipdate as date) as date, case l_linestatus when 'F' then 'A' when 'O' then 'B' end as side, l_quantity, l_tax, l_discount, l_extendedprice from lineitem),
sides0 as (select series_id, date, side, date_diff('day', date '{EPOCH}', date) as o, {formulas} from items where side is not null group by all),
sides1 as (select * replace (VFA * case when o % 97 = 0 then 3 else 1 end as VFA) from sides0),
sides as (select *, VFA / ALK as VFA_TA from sides1),
wide as (select series_id, date, o, {wide} from sides group by all),
panel as (select *, case when temperature_A is null then 'MISSING' when o % 31 = 0 then 'INVALID_RANGE' else 'VALID' end as temperature_A_dq,
  case when pH_B is null then 'MISSING' when o % 17 = 0 then 'SUSPECT_SPIKE' else 'VALID' end as pH_B_dq,
  case when o % 41 = 0 then 20 else 3 end as TAN_A_age, case when o % 43 = 0 then 20 else 3 end as TAN_B_age from wide)"""


PANEL = _panel_sql()
