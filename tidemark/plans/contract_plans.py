"""Contract validation, dedup and projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions import scalars as S
from tidemark.operators import contract as B
from tidemark.plans import inputs as I
from tidemark.plans.registry import query


@query("b1_missing_columns", "select unnest(['feed', 'temperature']) as missing")
def b1_missing_columns(spark, d):
    return B.missing_columns(I.table(spark, d, "events"), ["event_id", "feed", "value", "temperature"])


@query("b2_drop_blank_rows", "select event_id from events where nullif(case when event_id % 3 = 0 then '' else props end, '') is not null or event_id % 2 = 0")
def b2_drop_blank_rows(spark, d):
    e = I.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("a"), F.when(F.col("event_id") % 2 == 0, "x").alias("b"))
    return B.drop_blank_rows(e, ["a", "b"]).select("event_id")


@query("b3_source_rows", "select event_id, event_type, row_number() over (partition by event_type order by event_id) + 1 as source_row from events")
def b3_source_rows(spark, d):
    return B.number_rows(I.table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"])


RAW_DATES = "raw as (select event_id, event_type, case when event_id % 37 = 0 then 'soon' when event_id % 41 = 0 then '2024-13-05' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as day from events)"


def raw_dates(spark, d):
    i = F.col("event_id")
    day = F.when(i % 37 == 0, "soon").when(i % 41 == 0, "2024-13-05").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return I.table(spark, d, "events").select("event_id", "event_type", day.alias("day"))


@query("b4_dates", f"with {RAW_DATES} select event_id, try_cast(day[1:10] as date) as date from raw")
def b4_dates(spark, d):
    return raw_dates(spark, d).select("event_id", B.to_day("day").alias("date"))


@query("b4_invalid_dates", f"with {RAW_DATES} select event_type, array_to_string(list_sort(list(event_id)), ',') as rows from raw where try_cast(day[1:10] as date) is null group by 1")
def b4_invalid_dates(spark, d):
    return B.invalid_dates(raw_dates(spark, d), ["event_type"], "day", "event_id").withColumn("rows", F.array_join("rows", ","))


@query("b5_duplicate_dates", "select user_id, cast(ts as date) as date, count(*) as n from events group by all having count(*) > 1")
def b5_duplicate_dates(spark, d):
    return B.duplicate_dates(I.table(spark, d, "events").withColumn("date", F.to_date("ts")), ["user_id"], "date")


@query("b6_date_order", "select event_id, user_id, cast(ts as date) as date from events order by user_id, date, event_id")
def b6_date_order(spark, d):
    e = I.table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("date"))
    return B.in_date_order(e, ["user_id"], "date", "event_id")


_ALIASES = ", ".join(f"('{a}', '{c}')" for a, c in dims.FIELD_ALIASES.items())


@query("b7_field_aliases", f"select event_id, canonical as field from events join (values {_ALIASES}) a(alias, canonical) on event_type = alias")
def b7_field_aliases(spark, d):
    aliases = spark.createDataFrame(list(dims.FIELD_ALIASES.items()), "alias string, canonical string")
    e = I.table(spark, d, "events").select("event_id", F.col("event_type").alias("field"))
    return B.rename_fields(e, aliases, "field", sorted(set(dims.FIELD_ALIASES.values())))


@query("b8_distinct_cells", f"with {RAW_DATES} select distinct event_type, try_cast(day[1:10] as date) as date from raw where try_cast(day[1:10] as date) is not null")
def b8_distinct_cells(spark, d):
    """Cells of a log whose dates may be unreadable."""
    return B.distinct_cells(raw_dates(spark, d).withColumn("date", B.to_day("day")), ["event_type", "date"])


@query("b9_future_dates", f"with {I.USER_DAILY} select series_id, max(date) as latest, max(date) > date '2024-01-28' as future_dated from user_daily group by 1")
def b9_future_dates(spark, d):
    return B.future_measurements(I.user_daily(spark, d), ["series_id"], "date", "2024-01-28")


@query("b10_error_codes", "select event_id, case event_id % 3 when 0 then 'WORKBOOK_PARSE_FAILED' when 1 then 'INPUT_TABLE_MISSING' else 'SCHEMA_INVALID' end as code from events")
def b10_error_codes(spark, d):
    i = F.col("event_id") % 3
    message = F.when(i == 0, "INVALID_WORKBOOK: x").when(i == 1, "MISSING_SHEET: y").otherwise("columns missing")
    return I.table(spark, d, "events").select("event_id", S.error_code(message).alias("code"))


@query("b11_drop_repeated", "select user_id, cast(ts as date) as date, min(event_id) as event_id from events group by all having count(*) = 1")
def b11_drop_repeated(spark, d):
    return B.drop_repeated(I.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_id"), ["user_id", "date"])


@query("b12_keep_last", "select user_id, cast(ts as date) as date, max(event_id) as event_id from events group by all")
def b12_keep_last(spark, d):
    return B.keep_last(I.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_id"), ["user_id", "date"], ["event_id"])


@query("b13_null_shares", f"with {I.PANEL} " + " union all ".join(f"select '{c}' as \"column\", round(avg(case when {c} is null then 1 else 0 end), 6) as null_share from panel" for c in (f"{v}_{s}" for v in [*I.PANEL_FORMULAS, "VFA_TA"] for s in "AB")))
def b13_null_shares(spark, d):
    return B.null_shares(I.panel(spark, d), MEASURES).withColumn("null_share", F.round("null_share", 6))


MEASURES = [f"{v}_{s}" for v in [*I.PANEL_FORMULAS, "VFA_TA"] for s in "AB"]


@query("b13_drop_sparse", f"with {I.PANEL}, n as (select {', '.join(f'avg(case when {c} is null then 1 else 0 end) as {c}' for c in MEASURES)} from panel), l as (unpivot n on {', '.join(MEASURES)} into name field value share), u as (unpivot panel on {', '.join(MEASURES)} into name field value value) select series_id, date, field, value from u join l using (field) where share <= 0.5 and value is not null")
def b13_drop_sparse(spark, d):
    """The panel without the columns that are null in more than half of its rows, cell by cell."""
    p = B.drop_sparse(I.panel(spark, d), MEASURES, 0.5)
    kept = [c for c in MEASURES if c in p.columns]
    return p.unpivot(["series_id", "date"], kept, "field", "value").select("series_id", "date", "field", "value").filter("value is not null")


@query("b14_b15_columns", f"with {I.DAILY} select series_id, date, value, mean_value from daily")
def b14_b15_columns(spark, d):
    """Numeric columns by exclusion, and of those the ones that aren't derived from windows."""
    f = I.daily(spark, d).withColumns({"value_load5": F.lit(1.0), "value_lag1": F.lit(1.0), "note": F.lit("x")})
    return f.select("series_id", "date", *B.sequence_columns(f, ["n"]))


@query("b16_labelled", "select doc_id, quality, toxic from labels where toxic is not null")
def b16_labelled(spark, d):
    return B.labelled(I.table(spark, d, "labels"), "toxic").select("doc_id", "quality", "toxic")


@query("b17_row_at", "select user_id, date '2024-01-15' as date, max(event_id) as event_id from events where cast(ts as date) = date '2024-01-15' group by 1")
def b17_row_at(spark, d):
    e = I.table(spark, d, "events").select("user_id", F.to_date("ts").alias("date"), "event_id")
    return B.row_at(e, ["user_id"], "date", "2024-01-15", ["event_id"])


@query("b18_field_parts", f"select event_id, split_part(canonical, '_', 1) as variable, split_part(canonical, '_', 2) as side from events join (values {_ALIASES}) a(alias, canonical) on event_type = alias")
def b18_field_parts(spark, d):
    f = b7_field_aliases(spark, d)
    return f.select("event_id", B.field_variable("field").alias("variable"), B.field_side("field").alias("side"))


@query("b19_json_numbers", "select event_id, case when event_id % 11 in (0, 1) then null else value end as value, strftime(ts, '%Y-%m-%d') as day from events")
def b19_json_numbers(spark, d):
    i = F.col("event_id") % 11
    e = I.table(spark, d, "events").withColumn("value", F.when(i == 0, float("nan")).when(i == 1, float("inf")).otherwise(F.col("value")))
    return e.select("event_id", B.json_number("value").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
