"""Stored error sums, merged batch by batch, against the whole history."""

import datetime
import random

from pyspark.sql import functions as F

from tidemark.operators import forecast as P
from tidemark.sources.state import StateTable
from tidemark.sources.store import work_folder


def test_sums_in_any_batches_tell_the_history(spark):
    rng = random.Random(3)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = []
    for key in "ab":
        for i in range(60):
            y = 1e6 + rng.random() if rng.random() < 0.8 else None  # far from zero, where sums of squares would lose digits
            for e in ("B10", "B11", "M2"):
                if rng.random() < 0.9 and (e != "M2" or i > 45):
                    p = 1e6 + rng.gauss(0, 2)
                    rows.append((key, 1, e, day(i - 1), day(i), p, None if y is None else p - y, y, True))
    made = spark.createDataFrame(rows, "k string, horizon long, expert string, origin_date date, target_date date, prediction double, error double, y_true double, observed boolean").cache()
    table = StateTable(work_folder(spark, "errors"), f"k string, horizon long, expert string, {P.ERROR_STATE}", ("k", "horizon", "expert"), buckets=3)
    for end in (5, 5, 6, 40, 50):
        P.advance(table, made.filter(F.col("target_date") <= F.lit(day(end))), ["k"])
    asked = made.filter(F.col("origin_date") == F.lit(day(50)))
    columns = ["k", "expert", "n", "mse", "last_target", "truth_var"]
    want = {tuple(r)[:2]: tuple(r)[2:] for r in P.past_errors(made, ["k"]).filter(F.col("origin_date") == F.lit(day(50))).select(*columns).collect()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in P.errors_so_far(asked, table.read(spark), ["k"]).select(*columns).collect()}
    assert got.keys() == want.keys() and len(got) >= 4
    for k, (n, mse, last, var) in want.items():
        assert got[k][0] == n and got[k][2] == last and abs(got[k][1] - mse) < 1e-9 * mse and abs(got[k][3] - var) < 1e-6 * var
