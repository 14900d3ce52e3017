"""Process health over the whole history, and what follows from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import dims
from tidemark.operators import health as H
from tidemark.operators import series as E
from tidemark.plans import inputs as I
from tidemark.plans.registry import query
from tidemark.plans.series_plans import trend_sql

KEYS = ["series_id"]
V, SD = dims.VARIABLES, dims.SIDES


def diagnosed(spark, d):
    return H.diagnose(I.panel(spark, d), KEYS, "date")


def _reason(v: str, s: str) -> str:
    c = f"{v}_{s}"
    own = f"case when {c}_dq similar to '(MISSING|INVALID|STALE).*' then {c}_dq when {c} is null then 'MISSING' end" if c in ("temperature_A", "pH_B") else f"case when {c} is null then 'MISSING' end"
    return f"case when TAN_{s} is null or TAN_{s}_age > 14 then 'UNAVAILABLE_STALE_TAN' else {own} end" if v == "FAN" else own


def _band(c: str, v: str) -> str:
    lr, lg, hg, hr, *_ = dims.BANDS[v]
    return f"case when {c} is null then 'DATA' when {c} < {lr} or {c} > {hr} then 'RED' when {c} < {lg} or {c} > {hg} then 'ORANGE' else 'GREEN' end as {c}_band, case when {c} is null then 'NA' when {c} < {lg} then 'LOW' when {c} <= {hg} then 'CENTER' else 'HIGH' end as {c}_tail"


def _agree(v: str) -> str:
    verify, strong = dims.BANDS[v][5:]
    gap = f"abs({v}_A - {v}_B)"
    limit = f"{gap} <= {verify}" if verify is not None else "true"
    return f"{gap} as {v}_gap, case when {gap} is null then 'UNKNOWN' when {limit} then 'CONCORDANT' else 'DISCORDANT' end as {v}_agree"


def _flags() -> dict[str, str]:
    either = lambda v, t: f"(coalesce({t.format(v + '_A')}, false) or coalesce({t.format(v + '_B')}, false))"
    both = lambda v, t: f"(coalesce({t.format(v + '_A')}, false) and coalesce({t.format(v + '_B')}, false))"
    high = either("VFA_TA", "{0} > 0.22")
    out = "({0} < 36.0 or {0} > 41.0)"
    flags = {
        "ACID_WATCH": both("VFA_TA", "{0} >= 0.215"),
        "BUFFER_DEPLETION_CANDIDATE": f"{both('ALK', '{0} <= 15000')} and {either('pH', '{0} <= 7.70')} and {high}",
        "AMMONIA_WATCH": f"{either('FAN', '{0} between 500 and 700')} and {high}",
        "AMMONIA_ACTION_CANDIDATE": f"{both('FAN', '{0} > 700')} and {high}",
        "THERMAL_ONE_SIDED_INVALID": "(temperature_A is null) <> (temperature_B is null)",
        "THERMAL_ACTION_CANDIDATE": both("temperature", out),
        "THERMAL_ONE_SIDED_ABNORMAL": f"temperature_A is not null and temperature_B is not null and {out.format('temperature_A')} <> {out.format('temperature_B')}",
    }
    for v, (*_, risk, _a, _b) in dims.BANDS.items():
        if risk:
            red = lambda s, v=v, risk=risk: f"({v}_{s}_band = 'RED' and {v}_{s}_tail = '{risk}')"
            ok = lambda s, v=v: f"{v}_{s}_band in ('ORANGE', 'GREEN')"
            flags[f"{v}_ONE_SIDED_RISK_RED"] = f"({red('A')} and {ok('B')}) or ({red('B')} and {ok('A')})"
    return flags


def _health_sql() -> str:
    every = " and ".join(f"{v}_{s} is not null" for v in V for s in SD)
    core = " + ".join(f"case when {v}_A is not null or {v}_B is not null then 1 else 0 end" for v in ("pH", "VFA", "ALK", "VFA_TA"))
    deltas = ", ".join(f"{v}_{s} - lag({v}_{s}) over (partition by series_id order by date) as {v}_{s}_delta" for v in ("VFA_TA", "VFA") for s in SD)
    listed = ", ".join(f"case when {c} then '{k}' end" for k, c in _flags().items())
    of = lambda level: "list_filter(listed, lambda f: f in (" + ", ".join(f"'{k}'" for k, x in dims.FLAGS.items() if x[0] == level) + "))"
    state = "case when severe then 'PROCESS_ACTION'{early} when len(act) > 0 then 'PROCESS_ACTION' when len(watch) > 0 then 'PROCESS_WATCH' when len(suspect) > 0 then 'DATA_SUSPECT'{past} when confidence <> 'HIGH' then 'NORMAL_DEGRADED_DATA' else 'NORMAL' end"
    elevated = "('PROCESS_ACTION', 'PROCESS_WATCH', 'DATA_SUSPECT')"
    return f"""{I.PANEL},
r as (select *, {", ".join(f"{_reason(v, s)} as {v}_{s}_reason" for v in V for s in SD)} from panel),
u as (select * replace ({", ".join(f"case when {v}_{s}_reason is null then {v}_{s} end as {v}_{s}" for v in V for s in SD)}) from r),
b as (select *, {", ".join(_band(f"{v}_{s}", v) for v in V for s in SD)}, {", ".join(_agree(v) for v in V)}, {deltas},
  case when {every} then 'HIGH' when pH_A is not null and pH_B is not null and {core} >= 3 then 'MEDIUM' else 'LOW' end as confidence from u),
l as (select *, list_filter([{listed}], lambda f: f is not null) as listed, coalesce(VFA_TA_A > 0.45 and VFA_TA_B > 0.45, false) as severe,
  coalesce(VFA_TA_A > 0.207 and VFA_TA_B > 0.207 and VFA_TA_A_delta >= 0.04 and VFA_TA_B_delta >= 0.04 and VFA_A_delta >= 700 and VFA_B_delta >= 700, false) as early from b),
k as (select *, {of("PROCESS_ACTION")} as act, {of("PROCESS_WATCH")} as watch, {of("DATA_SUSPECT")} as suspect from l),
s0 as (select *, {state.format(early="", past="")} as state0 from k),
p as (select *, lag(state0) over (partition by series_id order by date) as previous_state from s0),
h0 as (select *, {state.format(early=" when early then 'PROCESS_ACTION'", past=f" when previous_state in {elevated} then 'RECOVERY'")} as state,
  case when severe then 'ACID_SEVERE' when early then 'ACID_EARLY' when len(act) > 0 then array_to_string(act, '+') when len(watch) > 0 then array_to_string(watch, '+') when len(suspect) > 0 then array_to_string(suspect, '+')
    when previous_state in {elevated} then 'RECOVERED' when confidence <> 'HIGH' then 'DEGRADED_DATA_ONLY' else 'NORMAL' end as code, case when severe or early then [] else listed end as flags from p),
health as (select *, case when len(flags) > 0 then flags else [code] end as codes, case state when 'NORMAL' then 'GREEN' when 'PROCESS_ACTION' then 'RED' else 'AMBER' end as combined_lamp from h0)"""


HEALTH = _health_sql()


@query("h1_ratio_bands", f"with {I.PANEL} select series_id, date, case when VFA_TA_A < 0.30 then 'Stable' when VFA_TA_A < 0.40 then 'Caution' when VFA_TA_A < 0.80 then 'Unstable' when VFA_TA_A >= 0.80 then 'Danger' end as band from panel")
def h1_ratio_bands(spark, d):
    from tidemark.functions.scalars import ratio_band

    return I.panel(spark, d).select("series_id", "date", ratio_band("VFA_TA_A").alias("band"))


@query("h2_h3_h6_side_inputs", f"with {HEALTH} select series_id, date, temperature_A, temperature_A_reason, pH_B, pH_B_reason, FAN_A, FAN_A_reason, FAN_B_reason, coalesce(pH_B_dq = 'SUSPECT_SPIKE', false) as pH_B_suspect from health")
def h2_h3_h6_side_inputs(spark, d):
    """H2, H3, H6: usable sides with reasons, and the freshness gate."""
    return H.side_inputs(I.panel(spark, d)).select("series_id", "date", "temperature_A", "temperature_A_reason", "pH_B", "pH_B_reason", "FAN_A", "FAN_A_reason", "FAN_B_reason", "pH_B_suspect")


_BANDS = [f"{v}_{s}_{k}" for v in V for s in SD for k in ("band", "tail")]


@query("h4_bands", f"with {HEALTH} select series_id, date, {', '.join(_BANDS)} from health")
def h4_bands(spark, d):
    return H.classify(H.side_inputs(I.panel(spark, d))).select("series_id", "date", *_BANDS)


@query("h5_agreement", f"with {HEALTH} select series_id, date, {', '.join(f'{v}_agree' for v in V)}, round(temperature_gap, 4) as temperature_gap, temperature_gap > 2.5 as temperature_strong from health")
def h5_agreement(spark, d):
    a = H.agreement(H.side_inputs(I.panel(spark, d)))
    return a.select("series_id", "date", *(f"{v}_agree" for v in V), F.round("temperature_gap", 4).alias("temperature_gap"), "temperature_strong")


@query("h7_confidence", f"with {HEALTH} select series_id, date, confidence from health")
def h7_confidence(spark, d):
    return H.side_inputs(I.panel(spark, d)).select("series_id", "date", H.confidence().alias("confidence"))


@query("health_history", f"with {HEALTH} select series_id, date, state, code, array_to_string(flags, ',') as flags, confidence, previous_state from health")
def health_history(spark, d):
    """The state of every row of every series in one job."""
    return diagnosed(spark, d).select("series_id", "date", "state", "code", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("flags"), "confidence", "previous_state")


@query("h17_commands", f"with {HEALTH} select series_id, date, cast(case when code = 'ACID_SEVERE' then 99.0 when code = 'ACID_EARLY' then 135.0 end as double) as feed_target, case when list_contains(flags, 'THERMAL_ACTION_CANDIDATE') then 'CONDITION_VERIFIED' else 'CONDITION_NOT_VERIFIED' end as thermal_gate, case when list_contains(flags, 'BUFFER_DEPLETION_CANDIDATE') then 'CONDITION_VERIFIED' else 'CONDITION_NOT_VERIFIED' end as alkali_gate, case when list_contains(flags, 'AMMONIA_ACTION_CANDIDATE') then 'VERIFY_AMMONIA,' else '' end || 'CROSS_CHECK_SENSORS,NO_UNVERIFIED_CHANGES' as advisories from health")
def h17_commands(spark, d):
    return diagnosed(spark, d).select("series_id", "date", "feed_target", "thermal_gate", "alkali_gate", F.array_join("advisories", ",").alias("advisories"))


@query("h19_lamps", f"with {HEALTH} select series_id, date, case when state = 'NORMAL_DEGRADED_DATA' then 'GREEN' else combined_lamp end as lamp, combined_lamp, confidence <> 'HIGH' as data_review, case when state in ('PROCESS_ACTION', 'PROCESS_WATCH', 'DATA_SUSPECT') then state else 'NORMAL' end as process_state from health")
def h19_lamps(spark, d):
    return diagnosed(spark, d).select("series_id", "date", "lamp", "combined_lamp", "data_review", "process_state")


_BEHIND = ", ".join(f"('{k}', '{level}', '{v}')" for k, (level, vs, *_) in dims.FLAGS.items() for v in vs)
_READ = lambda s, k: "case variable " + " ".join(f"when '{v}' then {v}_{s}{k}" for v in V) + " end"


@query("h20_evidence", f"with {HEALTH}, f as (select *, unnest(codes) as flag from health) select series_id, date, flag, level, variable, {_READ('A', '')} as A, {_READ('B', '')} as B, {_READ('A', '_band')} as A_band, {_READ('B', '_band')} as B_band from f join (values {_BEHIND}) m(flag, level, variable) using (flag)")
def h20_evidence(spark, d):
    return H.evidence(diagnosed(spark, d), KEYS, "date")


@query("h20_invalid_channels", f"with {HEALTH}, c as (select series_id, date, unnest([{', '.join(repr(v) for v in V for s in SD)}]) as variable, unnest([{', '.join(repr(s) for v in V for s in SD)}]) as side, unnest([{', '.join(f'{v}_{s}_reason' for v in V for s in SD)}]) as reason from health) select * from c where reason is not null")
def h20_invalid_channels(spark, d):
    return H.invalid_channels(H.side_inputs(I.panel(spark, d)), KEYS, "date")


def _telemetry_sql() -> str:
    rank = lambda c: f"case {c} when 'RED' then 3 when 'ORANGE' then 2 when 'DATA' then 1 else 0 end"
    suspect = lambda v: "pH_B_dq = 'SUSPECT_SPIKE' and pH_B is not null" if v == "pH" else "false"
    parts = []
    for v in V:
        first = f"{rank(f'{v}_A_band')} >= {rank(f'{v}_B_band')}"
        pick = lambda k, v=v, first=first: f"case when {first} then {v}_A_{k} else {v}_B_{k} end"
        limit = dims.BANDS[v][5]
        parts.append(
            f"select series_id, date, '{v}' as variable, {pick('band')} as band, case {pick('band')} when 'DATA' then {pick('reason')} when 'GREEN' then 'WITHIN_GREEN_RANGE' else {pick('band')} || '_' || {pick('tail')} || '_TAIL_STATISTICAL_RARITY' end as reason, "
            f"round(coalesce(({v}_A + {v}_B) / 2, {v}_A, {v}_B), 6) as value, round({v}_gap, 4) as gap, cast({limit if limit is not None else 'null'} as double) as gap_limit, {v}_agree as agreement, case when {pick('band')} = 'DATA' then 'UNUSABLE' when {suspect(v)} then 'SUSPECT' else 'VALID' end as data_status from health"
        )
    for v in ("feed", "biogas", "purity"):
        parts.append(f"select series_id, date, '{v}', 'NOT_A_RULE_VARIABLE', 'NO_RULE_DEFINED', round(coalesce(({v}_A + {v}_B) / 2, {v}_A, {v}_B), 6), null, null, 'NOT_APPLICABLE', case when {v}_A is null and {v}_B is null then 'UNUSABLE' else 'VALID' end from health")
    return f"with {HEALTH} " + " union all ".join(parts)


@query("h21_telemetry", _telemetry_sql())
def h21_telemetry(spark, d):
    t = H.telemetry(diagnosed(spark, d), KEYS, "date", {k: (f"{k}_A", f"{k}_B") for k in ("feed", "biogas", "purity")})
    return t.withColumns({"value": F.round("value", 6), "gap": F.round("gap", 4)})


_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_ABOUT = {k: (a, p) for k, (_, _, a, p) in dims.FLAGS.items()} | dims.STATE_ACTIONS
_CARDS = ", ".join("(" + ", ".join([*map(_quoted, (k, *_ABOUT[k], title, verdict, " | ".join(steps))), str(dims.PRIORITY[_ABOUT[k][1]])]) + ")" for k, (title, verdict, steps) in dims.CARDS.items())
_READINGS = "case reason " + " ".join("when '" + k + "' then concat_ws(';', " + ", ".join(f"'{v}=' || coalesce(cast({v}_A as varchar), '-') || '/' || coalesce(cast({v}_B as varchar), '-')" for v in vs) + ")" for k, (_, vs, *_) in dims.FLAGS.items()) + " else '' end"


@query(
    "h22_actions",
    f"""with {HEALTH}, c as (select *, unnest(codes) as reason, unnest(range(len(codes))) as i from health)
select series_id, date, row_number() over (partition by series_id, date order by p, i) as position, c.reason, action, priority, title, verdict, steps, {_READINGS.replace("case reason", "case c.reason")} as readings
from c join (values {_CARDS}) l(reason, action, priority, title, verdict, steps, p) on l.reason = c.reason""",
)
def h22_actions(spark, d):
    """Cards with titles, verdicts, what to do, and the readings behind them."""
    a = H.actions(diagnosed(spark, d), KEYS, "date")
    side = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    shown = F.transform("readings", lambda r: F.concat(r["variable"], F.lit("="), side(r["A"]), F.lit("/"), side(r["B"])))
    return a.withColumns({"steps": F.array_join("steps", " | "), "readings": F.array_join(shown, ";")})


MOVES = ["feed", "biogas", "ch4", "purity_A", "purity_B"]


def _recommendation_sql() -> str:
    has = lambda *cs: "(" + " or ".join(f"list_contains(cs, '{c}')" for c in cs) + ")"
    hit = lambda v, t: f"(({v}_A_band in ('ORANGE', 'RED') and {v}_A_tail = '{t}') or ({v}_B_band in ('ORANGE', 'RED') and {v}_B_tail = '{t}'))"
    moved = lambda c, way: f"({c}_direction = '{way}' and {c}_notable)"
    rises = lambda v: f"(({v}_A_delta is not null or {v}_B_delta is not null) and coalesce({v}_A_delta, 1) > 0 and coalesce({v}_B_delta, 1) > 0)"
    acid, watch, thermal = has("ACID_SEVERE", "ACID_EARLY"), has("ACID_WATCH"), has("THERMAL_ACTION_CANDIDATE")
    purity = f"({moved('purity_A', 'DOWN')} or {moved('purity_B', 'DOWN')})"
    decimal = lambda c, digits: f"coalesce(cast(cast(cast({c} as decimal(18,4)) as decimal(18,{digits})) as varchar), 'N/A')"
    text = lambda v, digits: f"'A ' || {decimal(v + '_A', digits)} || ' · B ' || {decimal(v + '_B', digits)}"
    read = lambda v, digits, name=None: f"'{name or v} ' || {text(v, digits)}"
    line = lambda c: f"case when {c}_notable and {c}_change_pct is not null then '{dims.MOVING[c]} {dims.TREND_TEXT} ' || case when {c}_change_pct < 0 then '-' else '+' end || cast(cast(round(abs({c}_change_pct), 1) as decimal(18,1)) as varchar) || '% ' || case when {c}_direction = 'UP' then '{dims.UP_TEXT}' else '{dims.DOWN_TEXT}' end end"
    ratio, heat = read("VFA_TA", 3, "VFA/ALK"), read("temperature", 2, "온도")
    cold = f"({hit('temperature', 'LOW')} or coalesce(temperature_A < 36.0 and temperature_B < 36.0, false))"
    inhibiting = f"({hit('pH', 'HIGH')} or {hit('temperature', 'HIGH')})"
    rules = [
        (f"case when {has('ACID_SEVERE')} then 'REC-ACID-002:severe' else 'REC-ACID-002:early' end", acid, [ratio, f"'{dims.ACID_AHEAD}'", line("ch4")]),
        ("'REC-ACID-001'", f"not {acid} and {watch}", [ratio, f"case when {rises('VFA')} then '{dims.VFA_RISING}' end", line("feed")]),
        ("'REC-ALK-001'", has("BUFFER_DEPLETION_CANDIDATE"), [read("ALK", 0), read("pH", 2)]),
        (f"case when {cold} then 'REC-TEMP-001:low' else 'REC-TEMP-001:high' end", thermal, [heat, f"'{dims.THERMAL_LEFT}'", line("biogas")]),
        ("'REC-TEMP-003'", f"not {thermal} and {has('THERMAL_ONE_SIDED_ABNORMAL', 'THERMAL_ONE_SIDED_INVALID')}", [heat]),
        (f"case when {inhibiting} then 'REC-TAN-001:inhibiting' else 'REC-TAN-001' end", f"{has('AMMONIA_WATCH', 'AMMONIA_ACTION_CANDIDATE')} or TAN_A_band in ('ORANGE', 'RED') or TAN_B_band in ('ORANGE', 'RED')", [read("TAN", 0), f"case when {inhibiting} then '{dims.HOT_OR_BASIC}' end"]),
        ("'REC-TS-001'", hit("TS", "HIGH"), [read("TS", 2)]),
        ("'REC-LOAD-001'", f"{hit('CODcr', 'HIGH')} or {hit('VS', 'HIGH')}", [read("CODcr", 0), read("VS", 2), line("feed")]),
        ("'REC-PATTERN-001'", f"({rises('VFA_TA')} or {watch}) and {hit('ALK', 'LOW')} and {hit('pH', 'LOW')}", [ratio, f"{read('ALK', 0)} || ' · ' || {read('pH', 2)}"]),
        ("'REC-PATTERN-002'", f"({rises('VFA')} or {watch}) and {purity} and {moved('ch4', 'DOWN')}", [line("ch4"), line("purity_A"), ratio]),
        ("'REC-PATTERN-003'", f"{has('THERMAL_ACTION_CANDIDATE', 'THERMAL_ONE_SIDED_ABNORMAL')} and {moved('biogas', 'DOWN')}", [heat, line("biogas")]),
    ]
    item = lambda card, lines: f"{{'card': {card}, 'evidence': concat_ws(' | ', {', '.join(lines)})}}"
    both = [line("feed"), line("biogas")]
    chain = f"""case when {acid} or {thermal} then null when {moved('feed', 'UP')} and ({rises('VFA')} or {moved('biogas', 'DOWN')}) then {item("'REC-FEED-001'", both)}
  when {moved('feed', 'DOWN')} and {moved('biogas', 'DOWN')} then {item("'REC-FEED-002'", both)} when {moved('biogas', 'DOWN')} then {item("'REC-GAS-001'", [line('biogas')])}
  when {purity} then {item("'REC-GAS-002'", [f"coalesce({line('purity_A')}, {line('purity_B')})"])} end"""
    items = ",\n".join(f"case when {c} then {item(card, lines)} end" for card, c, lines in rules)
    cards = ", ".join("(" + ", ".join([*map(_quoted, (k, code, p, title, " | ".join(steps), recheck)), str(dims.PRIORITY[p])]) + ")" for k, (code, p, title, steps, recheck) in dims.RECOMMENDATIONS.items())
    normal = item("'REC-NORMAL-001'", [f"'{dims.ALL_NORMAL}'"])
    return f"""with {HEALTH}, base as (select * exclude (feed_A, feed_B, biogas_A, biogas_B), feed_A + feed_B as feed, biogas_A + biogas_B as biogas, round(biogas_A * purity_A / 100 + biogas_B * purity_B / 100, 6) as ch4, list_concat(flags, [code]) as cs from health),
{trend_sql('base', MOVES)}, i as (select series_id, date, list_filter([{items}, {chain}], lambda x: x is not null) as found from trend),
n as (select series_id, date, case when len(found) > 0 then found else [{normal}] end as found from i),
e as (select series_id, date, unnest(found) as r, unnest(range(len(found))) as idx from n)
select series_id, date, row_number() over (partition by series_id, date order by p, idx) as position, code, priority, title, r.evidence as evidence, actions, recheck
from e join (values {cards}) l(card, code, priority, title, actions, recheck, p) on l.card = r.card"""


@query("h23_recommendations", _recommendation_sql())
def h23_recommendations(spark, d):
    """Sixteen recommendation rules over flags, bands, changes and trends."""
    h = diagnosed(spark, d).withColumns({"feed": F.col("feed_A") + F.col("feed_B"), "biogas": F.col("biogas_A") + F.col("biogas_B"), "ch4": F.round(F.col("biogas_A") * F.col("purity_A") / 100 + F.col("biogas_B") * F.col("purity_B") / 100, 6)})
    r = H.recommendations(E.robust_trend(h, KEYS, ["date"], MOVES), KEYS, "date")
    return r.withColumns({"evidence": F.array_join("evidence", " | "), "actions": F.array_join("actions", " | ")})
