"""Cell-level data quality: a ledger with a status for each cell, in window form.

Cells are partitioned by series and field, so that work spreads over fields too. Precedence: cross-field over spike over outlier over flat
run over valid; the classes of missing and invalid cells come first and stand outside all histories.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import parse_number
from tidemark.sources.store import written

#: Fixed values of the robust tests.
HISTORY, LEAST_HISTORY, FLAT_RUN, BOUND = 15, 7, 7, 3 * 1.4826
STATUSES = ("VALID", "MISSING", "MISSING_ZERO_SENTINEL", "INVALID_PARSE", "INVALID_RANGE", "SUSPECT_SPIKE", "SUSPECT_TEMPORAL_OUTLIER", "SUSPECT_FLATLINE", "SUSPECT_CROSS_FIELD")
UNUSABLE = ("MISSING", "MISSING_ZERO_SENTINEL", "INVALID_PARSE", "INVALID_RANGE")


def classify_cells(cells: DataFrame, raw: str = "raw_value", *, minimum: str = "minimum", maximum: str = "maximum", zero_missing: str = "zero_missing") -> DataFrame:
    """cells with status, reason and value (null for missing and invalid cells); the rule's columns stand in the row.

    Raw cells are text: the word nan is a number that isn't finite, not an empty cell.
    """
    text = F.trim(F.col(raw))
    number = parse_number(raw)
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    not_finite = word.isin("nan", "inf", "infinity") | (F.abs(number) == float("inf"))
    out_of_range = F.coalesce(number < F.col(minimum), F.lit(False)) | F.coalesce(number > F.col(maximum), F.lit(False))
    graded = lambda status, reason: F.struct(F.lit(status).alias("s"), F.lit(reason).alias("r"))
    status = (
        F.when(text.isNull() | (text == ""), graded("MISSING", "EMPTY_CELL"))
        .when(not_finite, graded("INVALID_PARSE", "NON_FINITE"))
        .when(number.isNull(), graded("INVALID_PARSE", "NON_NUMERIC"))
        .when(F.col(zero_missing) & (number == 0), graded("MISSING_ZERO_SENTINEL", "ZERO_SENTINEL"))
        .when(out_of_range, graded("INVALID_RANGE", "PHYSICAL_RANGE"))
        .otherwise(graded("VALID", ""))
    )
    out = cells.withColumn("_s", status).withColumns({"status": F.col("_s.s"), "reason": F.col("_s.r")}).drop("_s")
    return out.withColumn("value", F.when(F.col("status") == "VALID", number))


def _above(a: np.ndarray, b) -> np.ndarray:
    """a > b as Spark has it: NaN is above all numbers."""
    return np.where(np.isnan(a), ~np.isnan(b), a > b)


def _medians(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of each row's first n numbers in order; what is behind them is NaN."""
    rows, at = np.sort(rows, axis=1), np.arange(len(rows))
    low, high = rows[at, np.maximum(n - 1, 0) // 2], rows[at, n // 2]
    return np.where(n % 2 == 1, low, (low + high) / 2)


def _robust(value: pa.Array, history: pa.Array) -> pa.Array:
    """value lies further from the history's median than the bound allows; false with too little history or no spread."""
    n = np.nan_to_num(history.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    x = value.to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros(len(n), dtype=bool)
    use = (n >= LEAST_HISTORY) & value.is_valid().to_numpy(zero_copy_only=False)
    if use.any():
        rows = np.full((len(n), n.max() + 1), np.nan)
        rows[np.arange(rows.shape[1]) < n[:, None]] = history.flatten().to_numpy()
        rows, n, x = rows[use], n[use], x[use]
        with np.errstate(all="ignore"):  # differences of numbers that are very far apart
            center = _medians(rows, n)
            spread = _medians(np.abs(rows - center[:, None]), n)
            out[use] = _above(spread, 0.0) & _above(np.abs(x - center), BOUND * spread)
    return pa.array(out)


def grade_history(cells: DataFrame, keys: Sequence[str], order: Sequence[str], *, flat: str = "flatline") -> DataFrame:
    """Outliers, spikes and flat runs among the VALID cells, from the cells before them in the same series and field."""
    w = Window.partitionBy(*keys).orderBy(*order)
    cells = cells.withColumns({"_rn": F.row_number().over(w), "_before": F.lag("value").over(w)})
    same = F.coalesce(F.col(flat) & (F.col("value") == F.col("_before")), F.lit(False))
    cells = cells.withColumn("_run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.withColumn("_run_n", F.count("*").over(Window.partitionBy(*keys, "_run")))
    # Nulls apart, the frames below hold the last cells that are there, however far back they stand.
    held = Window.partitionBy(*keys, F.col("value").isNull()).orderBy(*order)
    last = held.rowsBetween(-HISTORY, -1)
    cells = cells.withColumns({"_h": F.collect_list("value").over(last), "_d": F.when(F.col("_rn") - F.lag("_rn").over(held) == 1, F.col("value") - F.lag("value").over(held))})
    moved = Window.partitionBy(*keys, F.col("_d").isNull()).orderBy(*order).rowsBetween(-HISTORY, -1)
    cells = cells.withColumn("_dh", F.collect_list("_d").over(moved))
    return grade(cells.drop("_rn", "_before", "_run"), flat)


def grade(cells: DataFrame, flat: str) -> DataFrame:
    """Grades from _h (values before), _d and _dh (change, and changes before) and _run_n (length of the run of equal cells), which go."""
    # Medians are taken of batches of histories, each history once.
    robust = F.arrow_udf(_robust, "boolean")
    cells = cells.withColumns({"_spike": robust("_d", "_dh"), "_outlier": robust("value", "_h")})
    valid = F.col("status") == "VALID"
    spike, outlier = valid & F.col("_spike"), valid & F.col("_outlier")
    flat_run = valid & F.col(flat) & F.col("value").isNotNull() & (F.col("_run_n") >= FLAT_RUN)
    graded = cells.withColumns(
        {
            "_new": F.when(spike, "SUSPECT_SPIKE").when(outlier, "SUSPECT_TEMPORAL_OUTLIER").when(flat_run, "SUSPECT_FLATLINE"),
            "_why": F.when(spike, "ROBUST_DELTA_WINDOW_15").when(outlier, "HAMPEL_WINDOW_15").when(flat_run, "EXACT_REPEAT_7_PLUS"),
        }
    )
    return graded.withColumns({"status": F.coalesce("_new", "status"), "reason": F.coalesce("_why", "reason")}).drop("_run_n", "_h", "_d", "_dh", "_spike", "_outlier", "_new", "_why")


def cross_field(cells: DataFrame, keys: Sequence[str], *, field: str = "variable", side: str = "side", left: str = "VFA", right: str = "ALK") -> DataFrame:
    """Where two fields of a side have the same number, the right one becomes suspect, whatever its status is."""
    twin = F.max(F.when(F.col(field) == left, F.col("value"))).over(Window.partitionBy(*keys, side))
    hit = F.coalesce((F.col(field) == right) & (F.col("value") == twin), F.lit(False))
    return cells.withColumns({"status": F.when(hit, "SUSPECT_CROSS_FIELD").otherwise(F.col("status")), "reason": F.when(hit, "ALK_IDENTICAL_TO_VFA").otherwise(F.col("reason"))})


def usable_value(status: str = "status", value: str = "value") -> Column:
    """The value unless its cell is missing or invalid; suspects stay."""
    return F.when(~F.col(status).isin(*UNUSABLE), F.col(value))


def ledger(wide: DataFrame, ids: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Wide raw columns to one row for each cell."""
    return wide.select(*ids, *(F.col(c).cast("string").alias(c) for c in fields)).unpivot(list(ids), list(fields), "field", "raw_value")


def clean_frame(cells: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Cells back to wide columns; the fields are named, so no pass looks for them."""
    return cells.groupBy(*keys).pivot("field", list(fields)).agg(F.max("value"))


def summary(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of valid, missing, suspect and invalid cells, and by_status, a map from each status that occurs to its count."""
    n = lambda p: F.count(F.when(F.col("status").startswith(p), 1))
    each = F.array(*(F.struct(F.lit(s).alias("key"), F.count(F.when(F.col("status") == s, 1)).alias("value")) for s in STATUSES))
    out = cells.groupBy(*keys).agg(n("VALID").alias("valid"), n("MISSING").alias("missing"), n("SUSPECT").alias("suspect"), n("INVALID").alias("invalid"), each.alias("_each"))
    return out.withColumn("by_status", F.map_from_entries(F.filter("_each", lambda e: e["value"] > 0))).drop("_each")


def flagged(cells: DataFrame, order: Sequence[str], most: int = 500) -> DataFrame:
    """The first cells that aren't VALID, in order, with how many there are; they are written once, so that cells are made once."""
    bad = written(cells.filter(F.col("status") != "VALID"))
    total = bad.agg(F.count("*").alias("total"), F.lit(1).alias("_one"))  # one row
    return bad.orderBy(*order).limit(most).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def status_maps(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A map from field to status for each of keys."""
    return cells.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "status")))).alias("statuses"))


def worst_of(statuses: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Of a derived variable's source fields the first unusable status, else the last suspect one, else VALID; an absent one is MISSING."""
    s = F.coalesce("status", F.lit("MISSING"))
    unusable = s.rlike("^(MISSING|INVALID|STALE)")
    first = F.min_by(s, F.when(unusable, F.col(position)))
    last = F.max_by(s, F.when(s != "VALID", F.col(position)))
    return statuses.groupBy(*keys).agg(F.coalesce(F.when(F.max(unusable.cast("int")) == 1, first), F.when(F.max((s != "VALID").cast("int")) == 1, last), F.lit("VALID")).alias("status"))


def review_verdict(summary_rows: DataFrame) -> DataFrame:
    return summary_rows.withColumn("verdict", F.when(F.col("suspect") + F.col("invalid") > 0, "REVIEW").otherwise("OK"))


def suspect_fields(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.filter(F.col("status").startswith("SUSPECT")).groupBy(*keys).agg(F.array_sort(F.collect_set("field")).alias("suspect_fields"))
