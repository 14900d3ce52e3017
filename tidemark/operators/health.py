"""Process health of a two-sided sensor frame, for the whole history in one job.

A frame has one row for each key and date, with columns like pH_A and pH_B, and may have the status (pH_A_dq) and sample age
(TAN_A_age) of each. All rules are column expressions; only the row before is looked at, through one window, since a state depends on the
previous row's state as that row alone would give it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.scalars import finite, mean_present
from tidemark.operators.series import by

UNUSABLE = "^(MISSING|INVALID|STALE)"
ELEVATED = ("PROCESS_ACTION", "PROCESS_WATCH", "DATA_SUSPECT")
PAIRS = [(v, s) for v in dims.VARIABLES for s in dims.SIDES]


def _both(test, v: str) -> Column:
    """test holds on both sides; a missing side never passes."""
    return F.coalesce(test(F.col(f"{v}_A")) & test(F.col(f"{v}_B")), F.lit(False))


def _either(test, v: str) -> Column:
    return F.coalesce(test(F.col(f"{v}_A")), F.lit(False)) | F.coalesce(test(F.col(f"{v}_B")), F.lit(False))


def side_inputs(df: DataFrame) -> DataFrame:
    """Usable values (null else), with why a side isn't usable (_reason) and whether it is suspect (_suspect).

    FAN is only usable beside a usable TAN of the same side whose sample isn't older than the limit.
    """
    values, reasons, suspects = {}, {}, {}
    for v, s in PAIRS:
        c = f"{v}_{s}"
        value = finite(c) if c in df.columns else F.lit(None).cast("double")
        status = F.coalesce(F.col(f"{c}_dq"), F.lit("MISSING")) if f"{c}_dq" in df.columns else F.lit("VALID")
        reasons[c] = F.when(status.rlike(UNUSABLE), status).when(value.isNull(), "MISSING")
        suspects[c] = reasons[c].isNull() & status.startswith("SUSPECT")
        values[c] = value
    for s in dims.SIDES:
        old = F.col(f"TAN_{s}_age") > dims.TAN_MAX_AGE if f"TAN_{s}_age" in df.columns else F.lit(False)
        reasons[f"FAN_{s}"] = F.when(reasons[f"TAN_{s}"].isNotNull() | F.coalesce(old, F.lit(False)), "UNAVAILABLE_STALE_TAN").otherwise(reasons[f"FAN_{s}"])
        suspects[f"FAN_{s}"] = reasons[f"FAN_{s}"].isNull() & suspects[f"FAN_{s}"]
    out = df.withColumns({f"{c}_reason": r for c, r in reasons.items()} | {f"{c}_suspect": x for c, x in suspects.items()} | {f"_{c}": x for c, x in values.items()})
    return out.withColumns({c: F.when(F.col(f"{c}_reason").isNull(), F.col(f"_{c}")) for c in values}).drop(*(f"_{c}" for c in values))


def classify(df: DataFrame) -> DataFrame:
    """_band (RED, ORANGE, GREEN, DATA) and _tail (LOW, CENTER, HIGH, NA) of each side."""
    new = {}
    for v, s in PAIRS:
        lr, lg, hg, hr, *_ = dims.BANDS[v]
        x = F.col(f"{v}_{s}")
        new[f"{v}_{s}_band"] = F.when(x.isNull(), "DATA").when((x < lr) | (x > hr), "RED").when((x < lg) | (x > hg), "ORANGE").otherwise("GREEN")
        new[f"{v}_{s}_tail"] = F.when(x.isNull(), "NA").when(x < lg, "LOW").when(x <= hg, "CENTER").otherwise("HIGH")
    return df.withColumns(new)


def agreement(df: DataFrame) -> DataFrame:
    """_agree (CONCORDANT, DISCORDANT, UNKNOWN), _gap and _strong of each variable's sides."""
    new = {}
    for v in dims.VARIABLES:
        verify, strong = dims.BANDS[v][5:]
        gap = F.abs(F.col(f"{v}_A") - F.col(f"{v}_B"))
        within = gap <= verify if verify is not None else gap.isNotNull()
        new |= {f"{v}_gap": gap, f"{v}_agree": F.when(gap.isNull(), "UNKNOWN").when(within, "CONCORDANT").otherwise("DISCORDANT"), f"{v}_strong": gap > strong if strong is not None else F.lit(None).cast("boolean")}
    return df.withColumns(new)


def confidence() -> Column:
    """HIGH with all sides of all variables, MEDIUM with both pH sides and three of the four core variables, else LOW."""
    there = lambda v, s: F.col(f"{v}_{s}").isNotNull()
    every = reduce(lambda a, b: a & b, (there(v, s) for v, s in PAIRS))
    core = reduce(lambda a, b: a + b, ((there(v, "A") | there(v, "B")).cast("int") for v in ("pH", "VFA", "ALK", "VFA_TA")))
    return F.when(every, "HIGH").when(there("pH", "A") & there("pH", "B") & (core >= 3), "MEDIUM").otherwise("LOW")


def flag_conditions() -> dict[str, Column]:
    """Each flag's condition, in the order in which flags are listed."""
    elevated = _either(lambda x: x > dims.BUFFER_RATIO, "VFA_TA")
    outside = lambda x: (x < dims.THERMAL_LOW) | (x > dims.THERMAL_HIGH)
    a, b = F.col("temperature_A"), F.col("temperature_B")
    both_there = a.isNotNull() & b.isNotNull()
    out = {
        "ACID_WATCH": _both(lambda x: x >= dims.ACID_WATCH, "VFA_TA"),
        "BUFFER_DEPLETION_CANDIDATE": _both(lambda x: x <= dims.BUFFER_ALK, "ALK") & _either(lambda x: x <= dims.BUFFER_PH, "pH") & elevated,
        "AMMONIA_WATCH": _either(lambda x: x.between(dims.FAN_LOW, dims.FAN_HIGH), "FAN") & elevated,
        "AMMONIA_ACTION_CANDIDATE": _both(lambda x: x > dims.FAN_ACTION, "FAN") & elevated,
        "THERMAL_ONE_SIDED_INVALID": a.isNotNull() != b.isNotNull(),
        "THERMAL_ACTION_CANDIDATE": _both(outside, "temperature"),
        "THERMAL_ONE_SIDED_ABNORMAL": both_there & _either(outside, "temperature") & ~_both(outside, "temperature"),
    }
    for v, (*_, risk, _verify, _strong) in dims.BANDS.items():
        if risk:
            red = lambda s, v=v, risk=risk: (F.col(f"{v}_{s}_band") == "RED") & (F.col(f"{v}_{s}_tail") == risk)
            not_red = lambda s, v=v: F.col(f"{v}_{s}_band").isin("ORANGE", "GREEN")
            out[f"{v}_ONE_SIDED_RISK_RED"] = (red("A") & not_red("B")) | (red("B") & not_red("A"))
    return out


def _of_level(flags: Column, level: str) -> Column:
    return F.filter(flags, lambda f: f["level"] == level)


def _state(flags: Column, severe: Column, early: Column, previous: Column) -> Column:
    """struct of state and code."""
    made = lambda s, c: F.struct(F.lit(s).alias("state"), (c if isinstance(c, Column) else F.lit(c)).alias("code"))
    out = F.when(severe, made("PROCESS_ACTION", "ACID_SEVERE")).when(early, made("PROCESS_ACTION", "ACID_EARLY"))
    for level in ELEVATED:
        hits = _of_level(flags, level)
        out = out.when(F.size(hits) > 0, made(level, F.array_join(F.transform(hits, lambda f: f["code"]), "+")))
    out = out.when(previous.isin(*ELEVATED), made("RECOVERY", "RECOVERED"))
    return out.when(F.col("confidence") != "HIGH", made("NORMAL_DEGRADED_DATA", "DEGRADED_DATA_ONLY")).otherwise(made("NORMAL", "NORMAL"))


def diagnose(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """All of the above, deltas, flags (array of level and code), state, code, previous_state, commands and lamps."""
    w = by(keys, [date])
    df = agreement(classify(side_inputs(df))).withColumn("confidence", confidence())
    df = df.withColumns({f"{v}_{s}_delta": F.col(f"{v}_{s}") - F.lag(f"{v}_{s}").over(w) for v in ("VFA_TA", "VFA") for s in dims.SIDES})
    severe = _both(lambda x: x > dims.ACID_SEVERE, "VFA_TA")
    rise = lambda v, least: F.coalesce((F.col(f"{v}_A_delta") >= least) & (F.col(f"{v}_B_delta") >= least), F.lit(False))
    early = _both(lambda x: x > dims.ACID_P95, "VFA_TA") & rise("VFA_TA", dims.ACID_EARLY_RATIO_RISE) & rise("VFA", dims.ACID_EARLY_VFA_RISE)
    listed = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(dims.FLAGS[k][0]).alias("level"), F.lit(k).alias("code"))) for k, c in flag_conditions().items())))
    none = F.slice(F.col("_listed"), 1, 0)
    df = df.withColumns({"_listed": listed, "_severe": severe, "_early": early})
    # What each row is by itself, without its changes and its past, is what the next row sees of it.
    alone = _state(F.col("_listed"), F.col("_severe"), F.lit(False), F.lit(None).cast("string"))
    df = df.withColumn("previous_state", F.lag(alone["state"]).over(w))
    df = df.withColumn("_s", _state(F.col("_listed"), F.col("_severe"), F.col("_early"), F.col("previous_state")))
    df = df.withColumns({"state": F.col("_s.state"), "code": F.col("_s.code"), "flags": F.when(F.col("_severe") | F.col("_early"), none).otherwise(F.col("_listed"))})
    return with_lamps(with_commands(df)).drop("_listed", "_severe", "_early", "_s")


def with_commands(df: DataFrame) -> DataFrame:
    """feed_target, thermal_gate, alkali_gate, advisories."""
    has = lambda c: F.exists("flags", lambda f: f["code"] == c)
    gate = lambda c: F.when(has(c), "CONDITION_VERIFIED").otherwise("CONDITION_NOT_VERIFIED")
    return df.withColumns(
        {
            "feed_target": F.when(F.col("code").contains("ACID_SEVERE"), F.lit(round(dims.FEED_REFERENCE * dims.FEED_SEVERE, 1))).when(F.col("code").contains("ACID_EARLY"), F.lit(round(dims.FEED_REFERENCE * dims.FEED_EARLY, 1))),
            "thermal_gate": gate("THERMAL_ACTION_CANDIDATE"),
            "alkali_gate": gate("BUFFER_DEPLETION_CANDIDATE"),
            "advisories": F.array_compact(F.array(F.when(has("AMMONIA_ACTION_CANDIDATE"), "VERIFY_AMMONIA"), F.lit("CROSS_CHECK_SENSORS"), F.lit("NO_UNVERIFIED_CHANGES"))),
        }
    )


def with_lamps(df: DataFrame) -> DataFrame:
    """lamp (degraded data alone stays green), combined_lamp, data_review, process_state."""
    state = F.col("state")
    combined = F.when(state == "NORMAL", "GREEN").when(state == "PROCESS_ACTION", "RED").otherwise("AMBER")
    return df.withColumns(
        {
            "lamp": F.when(state == "NORMAL_DEGRADED_DATA", "GREEN").otherwise(combined),
            "combined_lamp": combined,
            "data_review": F.col("confidence") != "HIGH",
            "process_state": F.when(state.isin(*ELEVATED), state).otherwise("NORMAL"),
        }
    )


def raised(df: DataFrame) -> DataFrame:
    """Codes that stand behind a row: its flags, or the state's code where it has none (so ACID_SEVERE and ACID_EARLY count too)."""
    codes = F.transform("flags", lambda f: f["code"])
    return df.withColumn("codes", F.when(F.size("flags") > 0, codes).otherwise(F.array("code")))


def evidence(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """One row for each flag and variable behind it, with both readings and bands."""
    spark = df.sparkSession
    behind = F.broadcast(spark.createDataFrame([(k, level, v) for k, (level, vs, *_) in dims.FLAGS.items() for v in vs], "flag string, level string, variable string"))
    readings = F.map_from_entries(F.array(*(F.struct(F.lit(v), F.struct(*(F.col(f"{v}_{s}").alias(s) for s in dims.SIDES), *(F.col(f"{v}_{s}_band").alias(f"{s}_band") for s in dims.SIDES))) for v in dims.VARIABLES)))
    rows = raised(df).select(*keys, date, readings.alias("_r"), F.explode("codes").alias("flag")).join(behind, "flag")
    return rows.select(*keys, date, "flag", "level", "variable", F.col("_r")[F.col("variable")].alias("x")).select(*keys, date, "flag", "level", "variable", "x.*")


def invalid_channels(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """variable, side, reason for each side that isn't usable."""
    cells = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(s).alias("side"), F.col(f"{v}_{s}_reason").alias("reason")) for v, s in PAIRS)))
    return df.select(*keys, date, cells.alias("c")).select(*keys, date, "c.*").filter(F.col("reason").isNotNull())


def telemetry(df: DataFrame, keys: Sequence[str], date: str, informational: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """For each variable: the worst band of its sides (RED, ORANGE, DATA, GREEN; A on ties), why, mean, gap, limit, data status.

    informational: further measures by name and columns; they get a value and a data status but never a band.
    """
    rank = lambda c: F.when(c == "RED", 3).when(c == "ORANGE", 2).when(c == "DATA", 1).otherwise(0)
    cells = []
    for v in dims.VARIABLES:
        a_band, b_band = F.col(f"{v}_A_band"), F.col(f"{v}_B_band")
        a_first = rank(a_band) >= rank(b_band)
        band = F.when(a_first, a_band).otherwise(b_band)
        tail = F.when(a_first, F.col(f"{v}_A_tail")).otherwise(F.col(f"{v}_B_tail"))
        why = F.when(a_first, F.col(f"{v}_A_reason")).otherwise(F.col(f"{v}_B_reason"))
        reason = F.when(band == "DATA", F.coalesce(why, F.lit("INVALID"))).when(band == "GREEN", "WITHIN_GREEN_RANGE").otherwise(F.concat(band, F.lit("_"), tail, F.lit("_TAIL_STATISTICAL_RARITY")))
        status = F.when(band == "DATA", "UNUSABLE").when(F.col(f"{v}_A_suspect") | F.col(f"{v}_B_suspect"), "SUSPECT").otherwise("VALID")
        cells.append(F.struct(F.lit(v).alias("variable"), band.alias("band"), reason.alias("reason"), mean_present(f"{v}_A", f"{v}_B").alias("value"), F.col(f"{v}_gap").alias("gap"), F.lit(dims.BANDS[v][5]).cast("double").alias("gap_limit"), F.col(f"{v}_agree").alias("agreement"), status.alias("data_status")))
    for name, columns in (informational or {}).items():
        value = mean_present(*columns)
        status = F.when(value.isNull(), "UNUSABLE").otherwise("VALID")
        cells.append(F.struct(F.lit(name).alias("variable"), F.lit("NOT_A_RULE_VARIABLE").alias("band"), F.lit("NO_RULE_DEFINED").alias("reason"), value.alias("value"), F.lit(None).cast("double").alias("gap"), F.lit(None).cast("double").alias("gap_limit"), F.lit("NOT_APPLICABLE").alias("agreement"), status.alias("data_status")))
    return df.select(*keys, date, F.explode(F.array(*cells)).alias("c")).select(*keys, date, "c.*")


def side_text(v: str, digits: int) -> Column:
    """Both sides' readings in fixed digits, N/A for a side without one."""
    show = lambda s: F.when(F.col(f"{v}_{s}").isNotNull(), F.format_string(f"%.{digits}f", F.col(f"{v}_{s}"))).otherwise("N/A")
    return F.concat(F.lit("A "), show("A"), F.lit(" · B "), show("B"))


def trend_line(c: str) -> Column:
    """A notable move of a measure against its base, as a line; null without one."""
    pct = F.col(f"{c}_change_pct")
    way = F.when(F.col(f"{c}_direction") == "UP", dims.UP_TEXT).otherwise(dims.DOWN_TEXT)
    return F.when(F.col(f"{c}_notable") & pct.isNotNull(), F.concat_ws(" ", F.lit(dims.MOVING[c]), F.lit(dims.TREND_TEXT), F.concat(F.format_string("%+.1f", pct), F.lit("%")), way))


def places(priorities: dict[str, int]) -> Callable[[Column], Column]:
    """The number that a code or card is sorted by; null for others."""
    known = F.create_map(*(F.lit(x) for pair in priorities.items() for x in pair))
    return lambda c: F.try_element_at(known, c)


def actions(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """Action cards by priority: one for each code of a row, or the normal card; position counts from 1. A card has its reason, code,
    priority, title, verdict, what to do (array) and the readings of the variables behind it (array of variable, A and B)."""
    spark = df.sparkSession
    codes = {k: (a, p) for k, (_, _, a, p) in dims.FLAGS.items()} | dims.STATE_ACTIONS
    library = F.broadcast(spark.createDataFrame([(k, *codes[k], title, verdict, list(steps)) for k, (title, verdict, steps) in dims.CARDS.items()], "reason string, action string, priority string, title string, verdict string, steps array<string>"))
    readings = {k: F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_A").alias("A"), F.col(f"{v}_B").alias("B")) for v in vs)) for k, (_, vs, *_) in dims.FLAGS.items()}
    none = F.array().cast("array<struct<variable:string,A:double,B:double>>")
    behind = F.map_from_entries(F.array(*(F.struct(F.lit(k), x) for k, x in readings.items())))
    place = places({k: dims.PRIORITY[codes[k][1]] for k in dims.CARDS})
    listed = F.transform("codes", lambda c, i: F.struct(place(c).alias("p"), i.alias("i"), c.alias("reason")))
    listed = F.array_sort(F.filter(listed, lambda c: c["p"].isNotNull()))
    rows = raised(df).select(*keys, date, behind.alias("_behind"), F.posexplode(listed).alias("_i", "c"))
    rows = rows.select(*keys, date, (F.col("_i") + 1).cast("long").alias("position"), "c.reason", F.coalesce(F.try_element_at("_behind", "c.reason"), none).alias("readings"))
    return rows.join(library, "reason").select(*keys, date, "position", "reason", "action", "priority", "title", "verdict", "steps", "readings")


def recommendations(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    """position, code, priority, title, evidence (array), actions (array) and recheck of what is recommended for each row.

    df has diagnose()'s columns and, from robust_trend(), direction, notability and change_pct of feed, biogas, ch4, purity_A and
    purity_B. Feed and gas rules form one chain, which only applies without an action; the normal one only without any other. Texts are
    rows of a dimension, joined by card.
    """
    codes = F.col("_codes")
    has = lambda *cs: reduce(lambda a, b: a | b, (F.array_contains(codes, c) for c in cs))
    hit = lambda v, tail: reduce(lambda a, b: a | b, (F.col(f"{v}_{s}_band").isin("ORANGE", "RED") & (F.col(f"{v}_{s}_tail") == tail) for s in dims.SIDES))
    off = lambda v: reduce(lambda a, b: a | b, (F.col(f"{v}_{s}_band").isin("ORANGE", "RED") for s in dims.SIDES))
    moved = lambda c, d: (F.col(f"{c}_direction") == d) & F.col(f"{c}_notable")

    def rises(v: str) -> Column:
        known = F.array_compact(F.array(f"{v}_A_delta", f"{v}_B_delta"))
        return (F.size(known) > 0) & F.forall(known, lambda x: x > 0)

    ratio = F.concat(F.lit("VFA/ALK "), side_text("VFA_TA", 3))
    read = lambda v, digits, name=None: F.concat(F.lit(f"{name or v} "), side_text(v, digits))
    heat = read("temperature", 2, "온도")
    acid, watch = has("ACID_SEVERE", "ACID_EARLY"), has("ACID_WATCH")
    thermal = has("THERMAL_ACTION_CANDIDATE")
    cold = hit("temperature", "LOW") | _both(lambda x: x < dims.THERMAL_LOW, "temperature")
    inhibiting = hit("pH", "HIGH") | hit("temperature", "HIGH")
    purity_down = moved("purity_A", "DOWN") | moved("purity_B", "DOWN")
    none = F.lit(None).cast("string")
    rules = [
        (F.when(has("ACID_SEVERE"), "REC-ACID-002:severe").otherwise("REC-ACID-002:early"), acid, [ratio, F.lit(dims.ACID_AHEAD), trend_line("ch4")]),
        ("REC-ACID-001", ~acid & watch, [ratio, F.when(rises("VFA"), dims.VFA_RISING), trend_line("feed")]),
        ("REC-ALK-001", has("BUFFER_DEPLETION_CANDIDATE"), [read("ALK", 0), read("pH", 2)]),
        (F.when(cold, "REC-TEMP-001:low").otherwise("REC-TEMP-001:high"), thermal, [heat, F.lit(dims.THERMAL_LEFT), trend_line("biogas")]),
        ("REC-TEMP-003", ~thermal & has("THERMAL_ONE_SIDED_ABNORMAL", "THERMAL_ONE_SIDED_INVALID"), [heat]),
        (F.when(inhibiting, "REC-TAN-001:inhibiting").otherwise("REC-TAN-001"), has("AMMONIA_WATCH", "AMMONIA_ACTION_CANDIDATE") | off("TAN"), [read("TAN", 0), F.when(inhibiting, dims.HOT_OR_BASIC)]),
        ("REC-TS-001", hit("TS", "HIGH"), [read("TS", 2)]),
        ("REC-LOAD-001", hit("CODcr", "HIGH") | hit("VS", "HIGH"), [read("CODcr", 0), read("VS", 2), trend_line("feed")]),
        ("REC-PATTERN-001", (rises("VFA_TA") | watch) & hit("ALK", "LOW") & hit("pH", "LOW"), [ratio, F.concat(read("ALK", 0), F.lit(" · "), read("pH", 2))]),
        ("REC-PATTERN-002", (rises("VFA") | watch) & purity_down & moved("ch4", "DOWN"), [trend_line("ch4"), trend_line("purity_A"), ratio]),
        ("REC-PATTERN-003", has("THERMAL_ACTION_CANDIDATE", "THERMAL_ONE_SIDED_ABNORMAL") & moved("biogas", "DOWN"), [heat, trend_line("biogas")]),
    ]
    no_action = ~(acid | thermal)
    chain = [
        ("REC-FEED-001", moved("feed", "UP") & (rises("VFA") | moved("biogas", "DOWN")), [trend_line("feed"), trend_line("biogas")]),
        ("REC-FEED-002", moved("feed", "DOWN") & moved("biogas", "DOWN"), [trend_line("feed"), trend_line("biogas")]),
        ("REC-GAS-001", moved("biogas", "DOWN"), [trend_line("biogas")]),
        ("REC-GAS-002", purity_down, [F.coalesce(trend_line("purity_A"), trend_line("purity_B"))]),
    ]
    place = places({k: dims.PRIORITY[p] for k, (_, p, *_) in dims.RECOMMENDATIONS.items()})

    def item(i: int, card: Column | str, lines: Sequence[Column]) -> Column:
        card = card if isinstance(card, Column) else F.lit(card)
        return F.struct(place(card).alias("p"), F.lit(i).alias("i"), card.alias("card"), F.array_compact(F.array(*lines, none)).alias("evidence"))

    last = len(rules)
    first = reduce(lambda a, b: a.when(b[1], item(last, b[0], b[2])), chain[1:], F.when(chain[0][1], item(last, chain[0][0], chain[0][2])))
    listed = F.array_compact(F.array(*(F.when(c, item(i, card, lines)) for i, (card, c, lines) in enumerate(rules)), F.when(no_action, first)))
    rows = df.withColumn("_codes", F.array_union(F.transform("flags", lambda f: f["code"]), F.array("code"))).select(*keys, date, listed.alias("_l"))
    normal = F.array(item(0, "REC-NORMAL-001", [F.lit(dims.ALL_NORMAL)]))
    rows = rows.select(*keys, date, F.posexplode(F.when(F.size("_l") > 0, F.array_sort("_l")).otherwise(normal)).alias("_i", "c"))
    cards = [(k, code, p, title, list(steps), recheck) for k, (code, p, title, steps, recheck) in dims.RECOMMENDATIONS.items()]
    library = F.broadcast(df.sparkSession.createDataFrame(cards, "card string, code string, priority string, title string, actions array<string>, recheck string"))
    found = rows.select(*keys, date, (F.col("_i") + 1).cast("long").alias("position"), "c.card", "c.evidence").join(library, "card")
    return found.select(*keys, date, "position", "code", "priority", "title", "evidence", "actions", "recheck")
