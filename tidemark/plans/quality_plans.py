"""Cell-level data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as C
from tidemark.plans import inputs as I
from tidemark.plans.registry import query

CLASSES = f"""{I.RAW_CELLS}, classed as (select series_id, event_id, raw_value, case when raw_value is null or trim(raw_value) = '' then 'MISSING' when try_cast(raw_value as double) is null or not isfinite(try_cast(raw_value as double)) then 'INVALID_PARSE'
  when try_cast(raw_value as double) = 0 then 'MISSING_ZERO_SENTINEL' when try_cast(raw_value as double) < 0 then 'INVALID_RANGE' else 'VALID' end as status from raw_cells),
classes as (select *, case when status = 'VALID' then try_cast(raw_value as double) end as value from classed)"""

MEDIAN = "list_median({0})"
OVER = "over (partition by series_id order by event_id{})"
GRADED = f"""{CLASSES}, a as (select *, row_number() {OVER.format('')} as rn, case when value = lag(value) {OVER.format('')} then 0 else 1 end as new_run from classes),
b0 as (select *, sum(new_run) {OVER.format(' rows between unbounded preceding and current row')} as run from a),
b as (select *, count(*) over (partition by series_id, run) as run_n from b0),
c as (select *, list(value) {OVER.format(' rows between 15 preceding and 1 preceding')} as h, case when rn - lag(rn) {OVER.format('')} = 1 then value - lag(value) {OVER.format('')} end as dv from b where value is not null),
d0 as (select series_id, event_id, list(dv) {OVER.format(' rows between 15 preceding and 1 preceding')} as dh from c where dv is not null),
d as (select c.*, dh from c left join d0 using (series_id, event_id)),
e as (select *, list_median(h) as hm, list_median(dh) as dm from d),
f as (select *, list_median(list_transform(h, lambda x: abs(x - hm))) as hd, list_median(list_transform(dh, lambda x: abs(x - dm))) as dd from e),
g as (select series_id, event_id, case when len(dh) >= 7 and dd > 0 and abs(dv - dm) > 3 * 1.4826 * dd then 'SUSPECT_SPIKE' when len(h) >= 7 and hd > 0 and abs(value - hm) > 3 * 1.4826 * hd then 'SUSPECT_TEMPORAL_OUTLIER' when run_n >= 7 then 'SUSPECT_FLATLINE' else 'VALID' end as graded from f),
cells as (select s.series_id, s.event_id, s.value, coalesce(graded, status) as status from classes s left join g using (series_id, event_id))"""


def classed(spark, d):
    return C.classify_cells(I.raw_cells(spark, d))


def graded(spark, d):
    return C.grade_history(classed(spark, d), ["series_id"], ["event_id"])


@query("c1_cell_classes", f"with {CLASSES} select event_id, status, value from classes")
def c1_cell_classes(spark, d):
    return classed(spark, d).select("event_id", "status", "value")


@query("c2_c4_history_grades", f"with {GRADED} select event_id, status, value from cells")
def c2_c4_history_grades(spark, d):
    """Outliers, spikes and flat runs by windows."""
    return graded(spark, d).select("event_id", "status", "value")


SIDED = f"""{I.PANEL}, long as (unpivot (select series_id, date, VFA_A, VFA_B, case when day(date) % 10 = 0 then VFA_A else ALK_A end as ALK_A, ALK_B, temperature_A, temperature_B from panel) on VFA_A, VFA_B, ALK_A, ALK_B, temperature_A, temperature_B into name field value value)"""


def sided(spark, d):
    """Cells of three variables with two sides; on some days the two of side A are the same number."""
    p = I.panel(spark, d).withColumn("ALK_A", F.when(F.dayofmonth("date") % 10 == 0, F.col("VFA_A")).otherwise(F.col("ALK_A")))
    fields = [f"{v}_{s}" for v in ("VFA", "ALK", "temperature") for s in "AB"]
    cells = p.select("series_id", "date", *fields).unpivot(["series_id", "date"], fields, "field", "value").filter("value is not null")
    return cells.withColumns({"variable": F.split("field", "_")[0], "side": F.split("field", "_")[1], "status": F.lit("VALID"), "reason": F.lit("")})


@query("c5_cross_field", f"with {SIDED} select a.series_id, a.date, a.field, case when b.value = a.value then 'SUSPECT_CROSS_FIELD' else 'VALID' end as status from long a left join long b on a.series_id = b.series_id and a.date = b.date and a.field[1:3] = 'ALK' and b.field = 'VFA' || a.field[4:5]")
def c5_cross_field(spark, d):
    return C.cross_field(sided(spark, d), ["series_id", "date"]).select("series_id", "date", "field", "status")


@query("c6_usable_values", f"with {GRADED} select event_id, case when status in ('MISSING', 'MISSING_ZERO_SENTINEL', 'INVALID_PARSE', 'INVALID_RANGE') then null else value end as clean_value from cells")
def c6_usable_values(spark, d):
    return graded(spark, d).select("event_id", C.usable_value().alias("clean_value"))


PANEL_FIELDS = [f"{v}_{s}" for v in [*I.PANEL_FORMULAS, "VFA_TA"] for s in "AB"]


@query("c7_ledger", f"with {I.PANEL} select series_id, date, unnest([{', '.join(map(repr, PANEL_FIELDS))}]) as field, unnest([{', '.join(PANEL_FIELDS)}]) as value from panel")
def c7_ledger(spark, d):
    l = C.ledger(I.panel(spark, d), ["series_id", "date"], PANEL_FIELDS)
    return l.select("series_id", "date", "field", F.col("raw_value").cast("double").alias("value"))


SIDED_FIELDS = [f"{v}_{s}" for v in ("VFA", "ALK", "temperature") for s in "AB"]


@query("c8_clean_frame", f"with {SIDED} select series_id, date, {', '.join(f"max(case when field = '{f}' then value end) as {f}" for f in SIDED_FIELDS)} from long group by all")
def c8_clean_frame(spark, d):
    return C.clean_frame(sided(spark, d), ["series_id", "date"], SIDED_FIELDS)


SUMMARY = "select series_id, count(*) filter (where status = 'VALID') as valid, count(*) filter (where status like 'MISSING%') as missing, count(*) filter (where status like 'SUSPECT%') as suspect, count(*) filter (where status like 'INVALID%') as invalid from cells group by 1"


_BY_STATUS = """with each_status as (select series_id, status, count(*) as n from cells group by all),
by_each as (select series_id, string_agg(status || '=' || n, ',' order by status) as by_status from each_status group by 1)"""


@query("c9_summary", f"with {GRADED}, counted as ({SUMMARY}), {_BY_STATUS.removeprefix('with ')} select counted.*, by_status from counted join by_each using (series_id)")
def c9_summary(spark, d):
    s = C.summary(graded(spark, d), ["series_id"])
    pairs = F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.withColumn("by_status", F.array_join(F.array_sort(pairs), ","))


@query("c10_flagged", f"with {GRADED} select event_id, status, (select count(*) from cells where status <> 'VALID') as total from cells where status <> 'VALID' order by event_id limit 500")
def c10_flagged(spark, d):
    """The first 500 flagged cells: the list's limit is the feature."""
    return C.flagged(graded(spark, d), ["event_id"]).select("event_id", "status", "total")


@query("c11_status_maps", f"with {SIDED} select series_id, date, array_to_string(list_sort(list(field || '=VALID')), ',') as statuses from long group by all")
def c11_status_maps(spark, d):
    m = C.status_maps(sided(spark, d), ["series_id", "date"])
    return m.select("series_id", "date", F.array_join(F.array_sort(F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("statuses"))


DERIVED = """derived as (select series_id, event_id // 3 as g, event_id % 3 as position, case when event_id % 13 = 0 then null else status end as status from cells)"""


@query("c12_worst_of", f"with {GRADED}, {DERIVED}, k as (select series_id, g, position, coalesce(status, 'MISSING') as s, regexp_matches(coalesce(status, 'MISSING'), '^(MISSING|INVALID|STALE)') as bad from derived) select series_id, g, coalesce(min_by(s, position) filter (where bad), max_by(s, position) filter (where s <> 'VALID'), 'VALID') as status from k group by all")
def c12_worst_of(spark, d):
    i = F.col("event_id")
    rows = graded(spark, d).select("series_id", F.floor(i / 3).alias("g"), (i % 3).alias("position"), F.when(i % 13 != 0, F.col("status")).alias("status"))
    return C.worst_of(rows, ["series_id", "g"])


@query("c13_review", f"with {GRADED}, s as ({SUMMARY}) select series_id, case when suspect + invalid > 0 then 'REVIEW' else 'OK' end as verdict from s")
def c13_review(spark, d):
    return C.review_verdict(C.summary(graded(spark, d), ["series_id"])).select("series_id", "verdict")


@query("c14_suspect_fields", f"with {GRADED} select series_id, event_id // 50 as block, array_to_string(list_sort(list(distinct status)), ',') as suspect_fields from cells where status like 'SUSPECT%' group by all")
def c14_suspect_fields(spark, d):
    cells = graded(spark, d).withColumns({"block": F.floor(F.col("event_id") / 50), "field": F.col("status")})
    return C.suspect_fields(cells, ["series_id", "block"]).withColumn("suspect_fields", F.array_join("suspect_fields", ","))
