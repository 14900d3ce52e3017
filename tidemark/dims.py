"""Fixed values of the rules, as small tables: bands, limits, cell rules, flags, actions."""

from __future__ import annotations

#: Fixed values. variable: (low red, low green, high green, high red, risk tail, A/B limit, strong A/B limit)
BANDS = {
    "temperature": (37.7, 37.9, 40.0, 40.2, None, 2.0, 2.5),
    "pH": (7.56, 7.70, 8.14, 8.21, "LOW", 0.08, None),
    "VFA": (2337.0, 2428.0, 3378.0, 3625.0, "HIGH", 600.0, None),
    "ALK": (15008.0, 15324.0, 18305.0, 18629.0, "LOW", 900.0, None),
    "VFA_TA": (0.130, 0.137, 0.207, 0.215, "HIGH", 0.04, None),
    "TAN": (2077.0, 2731.0, 5634.0, 5920.0, None, 1112.0, None),
    "FAN": (170.0, 226.0, 716.0, 820.0, "HIGH", None, None),
    "TS": (2.09, 2.26, 2.94, 3.16, None, 0.58, None),
    "VS": (0.77, 0.87, 1.41, 1.59, None, 0.39, None),
    "CODcr": (15614.0, 18739.0, 36311.0, 40152.0, None, 13933.0, None),
}
VARIABLES = tuple(BANDS)
SIDES = ("A", "B")

#: Fixed values of the process rules.
ACID_WATCH, ACID_P95, ACID_SEVERE = 0.215, 0.207, 0.45
ACID_EARLY_RATIO_RISE, ACID_EARLY_VFA_RISE = 0.04, 700.0
FEED_EARLY, FEED_SEVERE, FEED_REFERENCE = 0.75, 0.55, 180.0
BUFFER_ALK, BUFFER_PH, BUFFER_RATIO = 15000.0, 7.70, 0.22
FAN_LOW, FAN_HIGH, FAN_ACTION = 500.0, 700.0, 700.0
THERMAL_LOW, THERMAL_HIGH = 36.0, 41.0
TAN_MAX_AGE = 14

#: Fixed values. field: (minimum, maximum, zero counts as missing, check for flat runs); each field has the sides A and B.
CELL_RULES = {
    "feed": (0.0, None, False, False),
    "biogas": (0.0, None, False, False),
    "ch4_purity": (0.0, 100.0, True, True),
    "temperature": (-20.0, 100.0, True, True),
    "pH": (0.0, 14.0, True, True),
    "VFA": (0.0, None, True, True),
    "ALK": (0.0, None, True, True),
    "TAN": (0.0, None, True, True),
    "TS": (0.0, 100.0, True, True),
    "VS": (0.0, 100.0, True, True),
    "CODcr": (0.0, None, True, True),
}

#: Fixed values. flag: (level, variables behind it, action code, action priority)
FLAGS = {
    "ACID_SEVERE": ("PROCESS_ACTION", ("VFA_TA",), "OP-ACID-001", "ACTION"),
    "ACID_EARLY": ("PROCESS_ACTION", ("VFA_TA", "VFA"), "OP-ACID-002", "ACTION"),
    "ACID_WATCH": ("PROCESS_WATCH", ("VFA_TA",), "OP-ACID-003", "WATCH"),
    "BUFFER_DEPLETION_CANDIDATE": ("PROCESS_WATCH", ("ALK", "pH", "VFA_TA"), "OP-BUFFER-001", "WATCH"),
    "AMMONIA_WATCH": ("PROCESS_WATCH", ("FAN", "VFA_TA"), "OP-AMMONIA-001", "WATCH"),
    "AMMONIA_ACTION_CANDIDATE": ("PROCESS_ACTION", ("FAN", "VFA_TA"), "OP-AMMONIA-002", "ACTION"),
    "THERMAL_ONE_SIDED_INVALID": ("DATA_SUSPECT", ("temperature",), "OP-DATA-001", "WATCH"),
    "THERMAL_ACTION_CANDIDATE": ("PROCESS_ACTION", ("temperature",), "OP-THERMAL-001", "ACTION"),
    "THERMAL_ONE_SIDED_ABNORMAL": ("DATA_SUSPECT", ("temperature",), "OP-DATA-001", "WATCH"),
    "pH_ONE_SIDED_RISK_RED": ("DATA_SUSPECT", ("pH",), "OP-DATA-002", "WATCH"),
    "VFA_ONE_SIDED_RISK_RED": ("DATA_SUSPECT", ("VFA",), "OP-DATA-002", "WATCH"),
    "ALK_ONE_SIDED_RISK_RED": ("DATA_SUSPECT", ("ALK",), "OP-DATA-002", "WATCH"),
    "VFA_TA_ONE_SIDED_RISK_RED": ("DATA_SUSPECT", ("VFA_TA",), "OP-DATA-002", "WATCH"),
    "FAN_ONE_SIDED_RISK_RED": ("DATA_SUSPECT", ("FAN",), "OP-DATA-002", "WATCH"),
}
#: Codes of states without a flag: (action code, priority)
STATE_ACTIONS = {
    "DEGRADED_DATA_ONLY": ("OP-DATA-003", "WATCH"),
    "RECOVERED": ("OP-RECOVERY-001", "WATCH"),
    "NORMAL": ("OP-NORMAL-001", "NORMAL"),
}
PRIORITY = {"ACTION": 0, "WATCH": 1, "NORMAL": 2}

#: Words of other logs for the fields of the contract.
FIELD_ALIASES = {
    "view": "feed_A",
    "click": "biogas_A",
    "purchase": "temperature_A",
    "signup": "pH_A",
    "logout": "VFA_A",
    "login": "ALK_A",
    "search": "TAN_A",
}

#: Fixed values. reason: (title, verdict, what to do), as operators read them.
_ONE_SIDED = ("한쪽 계통만 이상", "한쪽 계통만 이상", ("해당 항목을 A/B 동시 채취로 재측정하십시오.", "Project 기준상 전역 Feed 조치보다 데이터 확인을 우선합니다."))
CARDS = {
    "ACID_SEVERE": ("산발효 심각", "산발효 심각", ("Project 명령에 따라 Feed_target = 0.55 × Q_ref 로 조정하십시오.", "VFA/ALK를 직접 재확인하기 전까지 Feed를 늘리지 마십시오.")),
    "ACID_EARLY": ("산발효 조기 징후", "산발효 조기 징후", ("Project 명령에 따라 Feed_target = 0.75 × Q_ref 로 조정하십시오.", "다음 직접 VFA/TA 확인 전까지 Feed를 늘리지 마십시오.")),
    "ACID_WATCH": ("VFA/ALK 주의", "산발효 상태 주의", ("VFA/ALK와 pH를 재확인하십시오.", "최근 투입량·유기부하 추세를 확인하십시오.")),
    "BUFFER_DEPLETION_CANDIDATE": ("완충능 저하 확인", "완충능 저하 후보", ("ALK-B를 직접 재분석하고 pH 추세를 확인하십시오.", "Project에 투입량 계산식이 없으므로 약품 투입 명령은 발령하지 않습니다.")),
    "AMMONIA_WATCH": ("암모니아 주의", "암모니아 주의", ("신선한 TAN 직접 측정값을 확보하십시오.", "pH·온도를 함께 확인하십시오.")),
    "AMMONIA_ACTION_CANDIDATE": ("암모니아 축적 확인", "암모니아 축적 후보", ("운전자 확인이 필요합니다. Project에 FAN 투입 계산식이 없습니다.", "TAN을 신규 측정하고 pH·온도를 함께 확인하십시오.")),
    "THERMAL_ACTION_CANDIDATE": ("온도 이상 확인", "소화조 온도 이상", ("온도 센서와 가열·순환 계통 상태를 확인하십시오.", "기존 SOP에 따라 대응하십시오. Project에 승온 setpoint는 정의되어 있지 않습니다.")),
    "THERMAL_ONE_SIDED_ABNORMAL": ("온도 한쪽 이상", "온도 한쪽 이상", ("T-A / T-B 센서를 교차 검증하십시오.", "Project 기준상 국부 점검 대상이며 전역 명령은 발령하지 않습니다.")),
    "THERMAL_ONE_SIDED_INVALID": ("온도 채널 한쪽 무효", "온도 채널 한쪽 무효", ("무효 채널의 센서 상태를 확인하십시오.", "Project 기준상 국부 점검 대상이며 전역 명령은 발령하지 않습니다.")),
    "DEGRADED_DATA_ONLY": ("계측 데이터 확인", "계측 데이터 신뢰도 저하", ("무효·결측 채널을 확인하고 가능하면 신규 측정값으로 갱신하십시오.", "해당 값에 의존하는 조치는 신규 측정 확인 후 수행하십시오.")),
    "RECOVERED": ("이전 경보 해제", "이전 경보 해제", ("이전 상승 상태가 해소되었습니다. 주요 계측 추세를 계속 확인하십시오.",)),
    "NORMAL": ("정상 운전 유지", "정상 운전 유지", ("현재 운전조건을 유지하고 주요 계측 추세를 지속 확인하십시오.",)),
} | {f"{v}_ONE_SIDED_RISK_RED": _ONE_SIDED for v, b in BANDS.items() if b[4]}

#: Fixed values. card: (code, priority, title, what to do, when to look again); a card is a code or, where its text varies, a code with a case.
RECOMMENDATIONS = {
    "REC-ACID-002:severe": ("REC-ACID-002", "ACTION", "산 축적 — 공정 조치 필요", ("신규 Feed 증가를 중단하고 현재 부하를 재평가하십시오.", "Project 명령에 따라 Feed_target = 0.55 × Q_ref 를 적용하십시오.", "VFA, ALK, pH를 우선 재측정하십시오.", "유입 원료 조성 변화 또는 고부하 원료 투입 여부를 확인하십시오.", "안정화 전까지 추가 고부하 투입을 피하십시오."), "재측정에서도 VFA/ALK가 하락하지 않으면 현장 SOP의 상위 대응 절차로 전환하십시오."),
    "REC-ACID-002:early": ("REC-ACID-002", "ACTION", "산 축적 — 공정 조치 필요", ("신규 Feed 증가를 중단하고 현재 부하를 재평가하십시오.", "Project 명령에 따라 Feed_target = 0.75 × Q_ref 를 적용하십시오.", "VFA, ALK, pH를 우선 재측정하십시오.", "유입 원료 조성 변화 또는 고부하 원료 투입 여부를 확인하십시오.", "안정화 전까지 추가 고부하 투입을 피하십시오."), "재측정에서도 VFA/ALK가 하락하지 않으면 현장 SOP의 상위 대응 절차로 전환하십시오."),
    "REC-ACID-001": ("REC-ACID-001", "WATCH", "산발효 증가 징후", ("추가 Feed 증가를 중지하고 현재 Feed를 유지하십시오.", "최근 24~48시간 Feed / 유기부하 증가 이력을 확인하십시오.", "VFA와 ALK를 재측정하십시오.", "pH 추세가 하락하는지 확인하십시오.", "Temperature와 Mixing 상태를 함께 확인하십시오."), "다음 측정에서 VFA/ALK가 계속 상승하면 ACTION 단계로 전환하십시오."),
    "REC-ALK-001": ("REC-ALK-001", "WATCH", "완충능 저하 가능", ("ALK를 재측정하여 분석 오류를 배제하십시오.", "VFA/ALK와 pH를 동시에 확인하십시오.", "최근 유기부하 증가 여부를 확인하십시오.", "추가 Feed 증가는 중지하십시오.", "Project의 alkali gate 충족 여부를 확인하십시오. 투입량 계산식은 Project에 정의되어 있지 않습니다."), "다음 분석에서 ALK 회복과 VFA/ALK 하락을 함께 확인하십시오."),
    "REC-TEMP-001:low": ("REC-TEMP-001", "ACTION", "소화조 온도 이상 — 공정 조치 필요", ("A/B 온도센서를 교차 확인하여 계측 이상 여부를 먼저 배제하십시오.", "가열 계통과 순환 펌프의 운전 상태를 즉시 점검하십시오.", "온도 복구 전까지 급격한 Feed 변경을 피하십시오.", "Mixing / 순환 상태를 확인하십시오.", "승인된 SOP에 따라 Project 정상 온도대역으로 복구하십시오."), "온도 복구 후 Biogas와 VFA/ALK 추세가 회복되는지 확인하십시오."),
    "REC-TEMP-001:high": ("REC-TEMP-001", "ACTION", "소화조 온도 이상 — 공정 조치 필요", ("A/B 온도센서를 교차 확인하여 계측 이상 여부를 먼저 배제하십시오.", "가열 계통 과열 또는 제어 이상 여부를 점검하십시오.", "불필요한 추가 가열을 중지할 수 있는지 SOP를 확인하십시오.", "Mixing / 순환 상태를 확인하십시오.", "승인된 SOP에 따라 Project 정상 온도대역으로 복구하십시오."), "온도 복구 후 Biogas와 VFA/ALK 추세가 회복되는지 확인하십시오."),
    "REC-TEMP-003": ("REC-TEMP-003", "WATCH", "온도 한쪽 계통 이상", ("T-A / T-B 센서를 교차 검증하십시오.", "해당 계통의 가열·순환 상태를 점검하십시오.", "Project 기준상 국부 점검 대상이며 전역 부하 조정은 하지 않습니다."), "센서 확인 후에도 한쪽만 이탈이 지속되면 계측 계통을 우선 정비하십시오."),
    "REC-TAN-001": ("REC-TAN-001", "WATCH", "암모니아 부하 확인", ("TAN 직접 측정값과 측정일을 확인하십시오.", "최근 고질소·단백질성 원료 투입 변화를 확인하십시오.", "pH와 Temperature를 함께 확인하십시오.", "추가 고질소 Feedstock 투입을 보류하십시오.", "현장 ammonia inhibition 대응 SOP를 확인하십시오."), "신규 TAN 측정값으로 재판정하십시오. Project에 FAN 계산식이 없어 유리암모니아는 산출하지 않습니다."),
    "REC-TAN-001:inhibiting": ("REC-TAN-001", "WATCH", "암모니아 저해 가능 — 우선 확인", ("TAN 직접 측정값과 측정일을 확인하십시오.", "최근 고질소·단백질성 원료 투입 변화를 확인하십시오.", "pH와 Temperature를 함께 확인하십시오.", "추가 고질소 Feedstock 투입을 보류하십시오.", "현장 ammonia inhibition 대응 SOP를 확인하십시오."), "신규 TAN 측정값으로 재판정하십시오. Project에 FAN 계산식이 없어 유리암모니아는 산출하지 않습니다."),
    "REC-TS-001": ("REC-TS-001", "WATCH", "고형물 농도 상승", ("Feed 고형물 농도 변화 여부를 확인하십시오.", "Mixing 상태를 점검하십시오.", "Pump / 배관 폐색 징후를 확인하십시오."), "다음 분석에서 TS가 정상 대역으로 복귀하는지 확인하십시오."),
    "REC-LOAD-001": ("REC-LOAD-001", "WATCH", "유기부하 상승 가능", ("최근 유입 유기부하 증가 여부를 확인하십시오.", "원료 조성 변화를 확인하십시오.", "VFA 상승이 동반되는지 확인하십시오.", "Biogas와 CH4가 부하 증가에 정상적으로 반응하는지 확인하십시오."), "부하 증가가 확인되면 안정화까지 추가 증량을 보류하십시오."),
    "REC-PATTERN-001": ("REC-PATTERN-001", "WATCH", "산 축적 및 완충능 저하 동반", ("추가 Feed 증가를 중지하십시오.", "VFA / ALK / pH를 함께 재측정하십시오.", "최근 유기부하 변화를 확인하십시오.", "안정화 전까지 고부하 원료 추가 투입을 피하십시오."), "세 지표가 동시에 개선되는지 다음 분석에서 확인하십시오."),
    "REC-PATTERN-002": ("REC-PATTERN-002", "WATCH", "소화 성능 저하 가능성", ("최근 Feed 변경 이력을 확인하십시오.", "VFA / ALK / pH를 확인하십시오.", "Temperature와 Gas analyzer 상태를 확인하십시오.", "추가 부하 증가는 보류하십시오."), "다음 측정에서 순도와 생성량이 회복되는지 확인하십시오."),
    "REC-PATTERN-003": ("REC-PATTERN-003", "WATCH", "온도 조건에 따른 반응 저하 가능", ("온도 계측을 재확인하십시오.", "가열·순환 계통 상태를 확인하십시오.", "온도 복구 전까지 Feed 급변을 피하십시오."), "온도 복구 후 Biogas 추세가 회복되는지 확인하십시오."),
    "REC-FEED-001": ("REC-FEED-001", "WATCH", "투입량 급증 후 공정 반응 확인", ("추가 Feed 증가를 중지하십시오.", "Feed 변경 시점과 이상 발생 시점을 비교하십시오.", "VFA/ALK와 pH를 재확인하십시오."), "안정화가 확인될 때까지 부하를 유지하십시오."),
    "REC-FEED-002": ("REC-FEED-002", "WATCH", "투입량 감소와 가스 생산 동반 감소", ("Feed 공급 중단 여부를 확인하십시오.", "Pump / feeder 상태를 점검하십시오.", "의도된 감량인지 운전 기록을 확인하십시오.", "복구 시 급격한 부하 증가를 피하십시오."), "Feed 복구 후 Biogas가 회복되는지 확인하십시오."),
    "REC-GAS-001": ("REC-GAS-001", "WATCH", "바이오가스 생산량 감소", ("Feed 투입량과 공급 중단 여부를 확인하십시오.", "Gas flow meter 상태를 확인하십시오.", "Mixing과 Temperature를 확인하십시오.", "VFA/ALK와 pH를 확인하십시오."), "SOP에 따라 gas handling 계통 누설 여부도 함께 점검하십시오."),
    "REC-GAS-002": ("REC-GAS-002", "WATCH", "메탄순도 감소", ("Gas analyzer 교정 상태를 확인하십시오.", "VFA/ALK, pH, Temperature를 확인하십시오.", "최근 유기부하 급변 여부를 확인하십시오."), "교정 확인 후에도 순도 감소가 지속되면 공정 지표를 함께 재판정하십시오."),
    "REC-NORMAL-001": ("REC-NORMAL-001", "NORMAL", "현재 운전조건 유지", ("현재 Feed와 운전조건을 유지하십시오.", "주요 계측 추세를 지속 확인하십시오."), "다음 정기 분석에서 재확인하십시오."),
}
#: Lines of evidence, and the names of what moves.
VFA_RISING, ACID_AHEAD, HOT_OR_BASIC = "VFA 상승 추세", "산 생성이 메탄 생성을 앞지르고 있을 가능성", "pH 또는 온도가 동시에 상승 (유리암모니아 비율 상승 조건)"
THERMAL_LEFT, ALL_NORMAL = "Project 정상 대역 36~41 ℃ 이탈", "주요 공정지표가 Project 정상범위 내에 있습니다."
MOVING = {"feed": "총 투입량", "biogas": "총 바이오가스", "ch4": "메탄생성량", "purity_A": "메탄순도 A", "purity_B": "메탄순도 B"}
TREND_TEXT, UP_TEXT, DOWN_TEXT = "최근 7일 대비", "상승", "하락"
