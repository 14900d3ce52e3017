"""Sources, sinks and state tables: what is written is read back."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import forecast as P
from tidemark.operators import joins as J
from tidemark.operators import quality as C
from tidemark.plans import forecast_plans as FP
from tidemark.plans import inputs as I
from tidemark.plans.quality_plans import GRADED, SUMMARY, graded
from tidemark.plans.registry import query
from tidemark.sources import files as N
from tidemark.sources import state as S
from tidemark.sources import store as A


def daily_files(spark, d, kind: str) -> str:
    path = A.work_folder(spark, f"daily-{kind}")
    df = I.daily(spark, d)
    A.write_csv(df, path) if kind == "csv" else A.write_json(df, path) if kind == "json" else df.write.parquet(path)
    return path


RAW = f"with {I.DAILY} select series_id, cast(date as varchar) as date, value, cast(null as varchar) as missing_column from daily"


@query("a1_raw_csv", RAW)
def a1_raw_csv(spark, d):
    """A1: a CSV file against a fixed header; all columns are text."""
    raw = A.read_raw(spark, daily_files(spark, d, "csv"), ["series_id", "date", "value", "missing_column"])
    return raw.withColumn("value", F.col("value").try_cast("double"))


@query("a1_raw_json", RAW)
def a1_raw_json(spark, d):
    raw = A.read_raw(spark, daily_files(spark, d, "json"), ["series_id", "date", "value", "missing_column"], "json")
    return raw.withColumn("value", F.col("value").try_cast("double"))


_ALIASED = ", ".join(f"('{a}', '{c}')" for a, c in dims.FIELD_ALIASES.items())


@query("a2_imputation_log", f"select distinct canonical as field, cast(ts as date) as date from events join (values {_ALIASED}) a(alias, canonical) on event_type = alias where event_id % 7 <> 0")
def a2_imputation_log(spark, d):
    """A2: cells named by a log file under aliases, some of its dates unreadable and some of its fields unknown; a broken log adds none."""
    path = A.work_folder(spark, "log")
    i = F.col("event_id")
    log = I.table(spark, d, "events").select(F.when(i % 7 == 0, "?").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias(" date"), F.when(i % 11 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.col("event_type")).alias("field "))
    A.write_csv(log, path)
    A.write_csv(log.withColumnRenamed("field ", "column"), f"{path}-broken")
    aliases = spark.createDataFrame(list(dims.FIELD_ALIASES.items()), "alias string, canonical string")
    known = sorted(set(dims.FIELD_ALIASES.values()))
    broken = A.read_imputation_log(spark, f"{path}-broken", known, aliases).unionByName(A.read_imputation_log(spark, f"{path}-absent", known, aliases))
    return A.read_imputation_log(spark, path, known, aliases).unionByName(broken)


@query("a3_load_raw", f"with {I.DAILY} select m.series_id, m.date, m.n, t.value from daily m left join (select * from daily where n % 2 = 0) t on m.series_id = t.series_id and m.date = t.date order by m.date")
def a3_load_raw(spark, d):
    daily = I.daily(spark, d)
    return J.left_on_date(daily.select("series_id", "date", "n"), daily.filter("n % 2 = 0"), ["series_id", "date"], ["value"]).orderBy("date")


@query("a4_clean_scan", "select event_id, cast(ts as date) as ts from events")
def a4_clean_scan(spark, d):
    return A.read_clean(spark, f"{d}/events.parquet", "ts").select("event_id", "ts")


@query("a5_parquet_parts", f"with {I.DAILY} select series_id, date, value from daily")
def a5_parquet_parts(spark, d):
    path = A.work_folder(spark, "parts")
    A.write_parts(I.daily(spark, d), path, ["series_id"])
    return spark.read.parquet(path).select("series_id", "date", "value")


@query("a6_a7_csv", f"with {I.DAILY} select series_id, date, value, n from daily")
def a6_a7_csv(spark, d):
    return A.read_csv(spark, daily_files(spark, d, "csv"), "series_id string, date date, value double, mean_value double, n long").drop("mean_value")


@query("a8_json_documents", f"with {GRADED} select series_id, count(*) filter (where status = 'VALID') as valid, count(*) as rows from cells group by 1")
def a8_json_documents(spark, d):
    """Nested documents: counts by status as a struct and a map."""
    path = A.work_folder(spark, "documents")
    cells = graded(spark, d)
    by_status = cells.groupBy("series_id", "status").agg(F.count("*").alias("n")).groupBy("series_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("counts"), F.sum("n").alias("rows"))
    A.write_json(by_status.select("series_id", F.struct("counts", "rows").alias("summary")), path)
    back = spark.read.schema("series_id string, summary struct<counts:map<string,bigint>,rows:bigint>").json(path)
    return back.select("series_id", F.col("summary.counts")["VALID"].alias("valid"), F.col("summary.rows").alias("rows"))


@query("a9_content_ids", "with c as (select substring(sha256(text), 1, 16) as content_id, doc_id from documents) select content_id, min(doc_id) as doc_id from c where content_id not in (select content_id from c where doc_id % 4 = 0) group by 1")
def a9_content_ids(spark, d):
    """Documents whose content isn't registered yet, once each."""
    rows = A.content_ids(I.table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    return A.new_content(rows, rows.filter("doc_id % 4 = 0"), "doc_id")


def by_type(spark, d, lines) -> str:
    """Text files of events, a folder for each type, in order of event_id; lines: their text, and the files' first line."""
    path = A.work_folder(spark, "types")
    e = I.table(spark, d, "events")
    rows = e.select("event_type", "event_id", lines.alias("line"))
    rows = rows.unionByName(e.select("event_type").distinct().select("event_type", F.lit(-1).cast("long").alias("event_id"), F.lit("event_id, note,value").alias("line")))
    rows.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "line").write.partitionBy("event_type").text(path)
    return path


@query("b3_file_rows", "select event_type, event_id, cast(row_number() over (partition by event_type order by event_id) + 1 as bigint) as source_row from events qualify event_id % 6 <> 0")
def b3_file_rows(spark, d):
    """Rows of CSV files by the number of their line, blank lines counted and then left out."""
    i = F.col("event_id").cast("string")
    path = by_type(spark, d, F.when(F.col("event_id") % 6 == 0, F.lit("")).otherwise(F.concat(i, F.lit(',"a, b",'), F.col("value").cast("string"))))
    rows = N.read_numbered_csv(spark, path, ["event_id", "value", "absent"])
    return rows.filter("event_id is not null").select("event_type", F.col("event_id").cast("long").alias("event_id"), "source_row")


@query("a9_file_ids", """select event_type, substring(sha256('event_id, note,value' || chr(10) || string_agg(cast(event_id as varchar) || chr(10), '' order by event_id)), 1, 16) as content_id,
  strlen('event_id, note,value' || chr(10) || string_agg(cast(event_id as varchar) || chr(10), '' order by event_id)) as bytes, 'first' as run from events group by event_type""")
def a9_file_ids(spark, d):
    """Files by what they hold; a second run over them, and over a copy of each, claims none."""
    path = by_type(spark, d, F.col("event_id").cast("string"))
    known = N.registry(A.work_folder(spark, "registry"))
    files = N.file_ids(spark, path).filter(F.col("path").endswith(".txt"))
    claimed = [N.claim_files(known, rows, run).withColumn("run", F.lit(run)) for run, rows in (("first", files), ("second", files.unionByName(files.withColumn("path", F.concat("path", F.lit("-copy"))))))]
    return reduce(DataFrame.unionByName, claimed).select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type"), "content_id", "bytes", "run")


def forecasts(spark, d):
    return FP.blended(spark, d).withColumnRenamed("series_id", "dataset_id")


def save_round(tables, made, about, summaries, errors) -> None:
    """All five state tables after a round: datasets and their quality, the runs of all origins, their predictions, matured errors."""
    tables["datasets"].upsert(about)
    tables["dq_summary"].upsert(summaries)
    S.save_runs(tables["model_runs"], made, "v1", CREATED)
    S.save_predictions(tables["predictions"], made, "methane", "biogas")
    S.mature_errors(tables["reliability_errors"], errors)


CREATED = datetime.datetime(2024, 1, 31)
RUN_ID = "series_id || '/' || cast(origin_date as varchar)"
PURITY = f"""first as (select series_id, origin_date, target_date, max(case when target = 'methane' then prediction end) as gas, max(case when target = 'biogas' then prediction end) as volume from blended where horizon = 1 and prediction is not null group by all),
purity as (select {RUN_ID} as run_id, 'purity_derived' as target, 1 as horizon, target_date, 100 * gas / volume as prediction from first where volume > 0 and gas >= 0 and gas <= volume)"""


@query("a10_a11_stored_predictions", f"with {FP.BLEND}, {PURITY} select {RUN_ID} as run_id, target, horizon, target_date, round(prediction, 5) as prediction from blended where prediction is not null union all select run_id, target, horizon, target_date, round(prediction, 5) from purity")
def a10_a11_stored_predictions(spark, d):
    """Both targets' forecasts of all origins and the purity derived from them, stored as rows and audits and read back."""
    tables, made = S.state_tables(A.work_folder(spark, "state")), A.written(forecasts(spark, d))
    S.save_runs(tables["model_runs"], made, "v1", CREATED)
    S.save_predictions(tables["predictions"], made, "methane", "biogas")
    return S.read_predictions(tables, spark).withColumn("prediction", F.round("prediction", 5))


@query("a11_model_runs", f"with {FP.BLEND} select {RUN_ID} as run_id, series_id as dataset_id, origin_date, 'v1' as model_version, 'AVAILABLE' as status, count(*) as n from blended where prediction is not null group by all")
def a11_model_runs(spark, d):
    """One run row for each dataset and origin, its audit a JSON object with an entry for each target and horizon."""
    n = F.size(F.from_json("audit", "map<string,double>")).cast("long").alias("n")
    table = S.state_tables(A.work_folder(spark, "state"))["model_runs"]
    S.save_runs(table, forecasts(spark, d), "v1", CREATED)
    return table.read(spark).select("run_id", "dataset_id", "origin_date", "model_version", "status", n)


_COUNTED = {
    "datasets": "select count(distinct series_id) from daily",
    "dq_summary": "select count(distinct series_id) from cells",
    "model_runs": "select count(distinct (series_id, origin_date)) from blended where prediction is not null",
    "predictions": "select (select count(*) from blended where prediction is not null) + (select count(*) from purity)",
    "reliability_errors": "select count(*) from errors",
}


@query("a10_state_tables", f"with {FP.BLEND}, {PURITY}, {GRADED}, {I.DAILY} " + " union all ".join(f"select '{k}' as name, ({v}) as n" for k, v in _COUNTED.items()))
def a10_state_tables(spark, d):
    """A10: how many rows each of the five state tables has once a round is stored, and stored again, as after a restart; predictions
    count those in the runs' audits too."""
    tables = S.state_tables(A.work_folder(spark, "state"))
    summaries = A.written(C.summary(graded(spark, d), ["series_id"]))
    about = A.describe(I.daily(spark, d), summaries.drop("by_status"), ["series_id"], "date", "2024-01-28").withColumn("dataset_id", F.col("series_id"))
    experts = A.written(FP.expert_rows(spark, d))
    made = A.written(P.blend(P.weights(P.past_errors(experts, FP.KEYS), FP.KEYS), FP.KEYS).withColumnRenamed("series_id", "dataset_id"))
    errors = experts.filter("y_true is not null").withColumn("sq_error", F.col("error") * F.col("error")).withColumnsRenamed({"series_id": "dataset_id", "expert": "expert_id"})
    for _ in range(2):
        save_round(tables, made, about, summaries.withColumnsRenamed({"series_id": "dataset_id", "by_status": "counts"}), errors)
    stored = {name: t.read(spark) for name, t in tables.items()} | {"predictions": S.read_predictions(tables, spark)}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in stored.items()]
    return reduce(DataFrame.unionByName, counts)


@query("a13_merge_maps", "select event_id, case when event_id % 2 = 0 then 'new' else 'old' end as a, case when event_id % 3 = 0 then 'added' end as b from events")
def a13_merge_maps(spark, d):
    i = F.col("event_id")
    e = I.table(spark, d, "events").select("event_id", F.create_map(F.lit("a"), F.lit("old")).alias("o"), F.map_filter(F.create_map(F.lit("a"), F.when(i % 2 == 0, "new"), F.lit("b"), F.when(i % 3 == 0, "added")), lambda k, v: v.isNotNull()).alias("n"))
    merged = e.select("event_id", J.merge_maps("o", "n").alias("m"))
    return merged.select("event_id", F.col("m")["a"].alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query("a14_descriptor", f"with {GRADED}, s as ({SUMMARY}), {I.DAILY}, spans as (select series_id, min(date) as first_date, max(date) as latest_date, count(*) as row_count from daily group by 1) select spans.*, valid, missing, suspect, invalid, case when row_count >= 20 then 'READY' else 'INSUFFICIENT_HISTORY' end as status, array_to_string(list_filter([case when latest_date > date '2024-01-28' then 'FUTURE_DATED' end, case when suspect + invalid > 0 then 'QUALITY_REVIEW' end], lambda w: w is not null), ',') as warnings from spans left join s using (series_id)")
def a14_descriptor(spark, d):
    t = A.describe(I.daily(spark, d), C.summary(graded(spark, d), ["series_id"]).drop("by_status"), ["series_id"], "date", "2024-01-28")
    return t.withColumn("warnings", F.array_join("warnings", ","))
