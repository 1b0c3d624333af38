"""Weights, bands, word lists, rules and seed rows that results depend on.

Every operator takes its own as an argument; these are the defaults.
"""

from __future__ import annotations

WEIGHTS = {"conflict_frequency": 0.30, "sentiment_avg": 0.25, "nightlight_change": 0.20, "refugee_change": 0.15, "event_severity": 0.10}
#: Indicators that count as missing at 0 or below; their weight goes to the others.
PLACEHOLDERS = ("nightlight_change", "refugee_change")

INDICATOR_NAMES = {"conflict_frequency": "冲突频次", "sentiment_avg": "舆情负面度", "nightlight_change": "夜光变化", "refugee_change": "难民变化", "event_severity": "事件严重度"}
INDICATOR_TEXTS = {
    "conflict_frequency": "武装冲突与暴力事件的发生密度",
    "sentiment_avg": "媒体报道的负面情感强度",
    "nightlight_change": "夜间灯光衰减反映的经济活动萎缩",
    "refugee_change": "人口流离失所的规模变化",
    "event_severity": "地缘事件的烈度与影响范围",
}

#: (from this score on, level), highest first.
RISK_BANDS = ((70.0, "高风险"), (40.0, "中风险"), (float("-inf"), "低风险"))
NO_DATA = "无数据"
ALERT_BANDS = ((80.0, "red"), (60.0, "orange"), (40.0, "yellow"), (float("-inf"), "green"))
SENTIMENT_BANDS = ((0.7, "high"), (0.4, "medium"), (float("-inf"), "low"))

CONFLICT_WORDS_ZH = ["冲突", "战斗", "空袭", "武装", "交火", "爆炸", "袭击", "制裁", "政变", "难民", "抗议", "暴动"]
CONFLICT_WORDS_EN = ["conflict", "attack", "airstrike", "armed", "ceasefire", "sanction", "coup", "refugee", "protest", "military"]
EVENT_WORDS_ZH = ["冲突", "战斗", "空袭", "武装", "交火", "爆炸", "袭击", "制裁", "政变", "选举", "抗议", "暴动", "难民", "停火", "和谈", "贸易", "投资", "管道", "港口", "铁路", "经济走廊"]
EVENT_WORDS_EN = ["conflict", "attack", "airstrike", "ceasefire", "sanction", "coup", "election", "protest", "refugee", "trade", "investment", "pipeline", "port", "railway", "economic corridor"]
POSITIVE_WORDS = ["peace", "ceasefire", "cooperation", "agreement", "progress", "development", "growth", "stability", "reform", "dialogue", "support", "improve", "recovery", "success"]
NEGATIVE_WORDS = ["conflict", "attack", "airstrike", "killed", "dead", "casualties", "sanction", "coup", "protest", "crisis", "refugee", "violence", "bombing", "armed", "military", "war", "destruction", "flee"]
#: From each of these on the rest of a text is cut.
NOISE_MARKS = ["点击关注", "扫描二维码", "版权声明", "转载须", "责任编辑"]

#: (kind, pattern, category, severity, flag): a code rule holds for themes of the code and up to two more characters, a name rule for themes that contain it.
EVENT_RULES = [
    *[("code", c, "conflict", 0.9, "has_conflict") for c in ("18", "19", "20", "21", "22", "17")],
    *[("code", c, "unrest", 0.6, "has_unrest") for c in ("14", "15", "16", "13")],
    *[("code", c, "diplomacy", 0.0, "has_diplomacy") for c in ("01", "02", "03", "04", "05", "06", "07", "08", "09")],
    *[("name", c, "conflict", 0.8, "has_conflict") for c in ("CONFLICT_WAR", "CRISIS_DISASTER", "TERROR")],
    *[("name", c, "unrest", 0.5, "has_unrest") for c in ("POLITICAL", "MILITARY")],
    *[("name", c, "humanitarian", 0.6, None) for c in ("HUMAN_RIGHTS", "REFUGEES", "SANCTIONS")],
    *[("name", c, "diplomacy", 0.0, "has_diplomacy") for c in ("ECONOMIC", "DIPLOMACY")],
]
#: The severity of an article that no rule gives one.
BASE_SEVERITY = 0.2

#: Roll-up of step results: what is missing, and the level by severity.
UNKNOWN = "未知"
ROLL_UP_BANDS = ((4.0, "高"), (2.0, "中"), (float("-inf"), "低"))
#: The severity of an event that gives none.
USUAL_SEVERITY = 3.0

#: Words of the spatial operators: Moran's I above these, below the last; and kinds of hotspots.
MORAN_WORDS = {
    0.3: "显著正空间自相关：风险呈现明显地理聚集",
    0.1: "弱正空间自相关：风险有一定聚集趋势",
    -0.1: "负空间自相关：高低风险区交错分布",
    None: "空间随机分布：无明显聚集模式",
}
CLUSTERED, ISOLATED = "高-高聚集", "高风险孤岛"
