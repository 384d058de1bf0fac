"""The combination templates and the indicator profiles: fixed clinical wording."""

from __future__ import annotations

from typing import NamedTuple


class Indicator(NamedTuple):
    indicator: str
    aliases: tuple[str, ...]
    op: str | None = None


class Template(NamedTuple):
    template_id: str
    title: str
    summary: str
    severity: str
    indicators: tuple[Indicator, ...]
    keywords: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()
    status: str = "active"


# The combination library.
TEMPLATES = [
    Template(
        "combo-wbc-neu-high",
        "白细胞 & 中性粒升高（疑似细菌感染）",
        "当 WBC 与中性粒细胞（NEU）同步升高时，多提示急性细菌感染或强烈炎症反应，应结合发热、CRP 等指标进一步排查。",
        "warning",
        (
            Indicator("WBC", ("WBC", "白细胞"), ">"),
            Indicator("NEU", ("NEU", "中性粒", "中性粒细胞"), ">"),
        ),
        ("感染", "bacterial"),
        ("《血液学诊断手册》2023 第 4 章",),
    ),
    Template(
        "combo-wbc-lym-low",
        "白细胞降低 + 淋巴细胞降低（骨髓抑制/病毒性抑制）",
        "WBC、LYM 同步下降时需警惕骨髓造血抑制、抗肿瘤化疗后抑制或重症病毒感染的恢复期。",
        "critical",
        (
            Indicator("WBC", ("WBC", "白细胞"), "<"),
            Indicator("LYM", ("LYM", "淋巴"), "<"),
        ),
        ("抑制", "suppression"),
        ("骨髓增生异常综合征诊疗指南 2022",),
    ),
    Template(
        "combo-rbc-hgb-low",
        "红细胞 & 血红蛋白降低（贫血提示）",
        "RBC、HGB 明显低于参考范围通常代表贫血，应提示铁缺乏、慢性肾病、失血等病因评估。",
        "warning",
        (
            Indicator("RBC", ("RBC", "红细胞"), "<"),
            Indicator("HGB", ("HGB", "血红蛋白", "Hb"), "<"),
        ),
        ("贫血", "anemia"),
        ("《贫血诊断与治疗专家共识》2021",),
    ),
    Template(
        "combo-plt-low",
        "血小板显著降低（血小板减少症）",
        "PLT 低于 100×10^9/L 时提示出血风险，需结合 DIC、免疫性血小板减少等病因。",
        "critical",
        (Indicator("PLT", ("PLT", "血小板"), "<"),),
        ("出血", "thrombocytopenia"),
        ("ITP 治疗中国指南 2022",),
    ),
    Template(
        "combo-lym-high",
        "淋巴细胞升高（病毒感染可能）",
        "LYM 升高伴 WBC 正常或轻度升高，多见于病毒感染、百日咳等，应提示结合病史。",
        "normal",
        (Indicator("LYM", ("LYM", "淋巴"), ">"),),
        ("病毒", "viral"),
        ("急性感染诊疗规范 2020",),
    ),
    Template(
        "combo-eos-high",
        "嗜酸粒升高（过敏/寄生虫）",
        "EOS 持续升高多与过敏反应、寄生虫感染或某些自身免疫疾病相关，需结合症状确认。",
        "normal",
        (Indicator("EOS", ("EOS", "嗜酸", "嗜酸细胞"), ">"),),
        ("过敏", "allergy"),
        ("嗜酸粒细胞增多诊治专家共识 2019",),
    ),
    Template(
        "combo-mono-high",
        "单核细胞升高（慢性感染或恢复期）",
        "MONO 升高可提示慢性炎性疾病或骨髓恢复期，应提示结合 ESR、CRP。",
        "warning",
        (Indicator("MONO", ("MONO", "单核"), ">"),),
        ("慢性", "chronic"),
        ("慢性感染诊疗建议 2021",),
    ),
    Template(
        "combo-hct-high",
        "红细胞压积升高（真性红细胞增多）",
        "RBC、HCT 同步升高时应警惕真性红细胞增多症或慢性低氧状态，需进一步检查 JAK2。",
        "warning",
        (
            Indicator("RBC", ("RBC", "红细胞"), ">"),
            Indicator("HCT", ("HCT", "红细胞压积"), ">"),
        ),
        ("增多", "polycythemia"),
        ("真性红细胞增多症诊疗中国指南 2021",),
    ),
]


# Wording inserted for a raised abnormal-cell indicator, per profile.
WHITE_CELLS_V1 = {
    "prompt": (
        "AWBC↑提示存在异常白细胞群或异常细胞成分增多，需结合血涂片及临床情况评估感染、炎症或血液系统异常。"
    ),
    "basis": "AWBC为机器学习识别的异常白细胞计数，升高提示异常细胞聚集或未分类白细胞成分增加，建议复查或人工镜检。",
    "short": "AWBC↑提示异常白细胞风险",
    "interpretation": "AWBC为异常白细胞计数，升高提示异常细胞成分增多，需结合感染/炎症或血液系统异常进一步评估。",
    "disease": {
        "name": "血液系统异常风险（需排除白血病/骨髓增生性疾病）",
        "probability": "中等",
        "analysis": "AWBC↑提示存在异常白细胞群或未分类细胞成分增多，需结合血涂片或进一步检查排除血液系统异常。",
        "priority": 2,
        "keywords": ["AWBC", "异常白细胞"],
    },
}
SICKLE_CELLS_V1 = {
    "prompt": (
        "SRBC↑提示镰刀型红细胞存在，需考虑镰刀型细胞贫血风险或携带者状态。"
    ),
    "basis": "SRBC为镰刀型红细胞识别计数，升高提示红细胞形态异常，常见于镰刀型细胞贫血或携带者。",
    "short": "SRBC↑提示镰刀型细胞贫血风险",
    "interpretation": "SRBC升高提示镰刀型红细胞存在，需结合溶血指标与病史评估镰刀型细胞贫血或携带者状态。",
    "disease": {
        "name": "镰刀型细胞贫血/携带者状态",
        "probability": "较高",
        "analysis": "SRBC↑提示红细胞形态异常，需排查镰刀型细胞贫血或携带者状态，结合HGB/RET%等指标评估溶血程度。",
        "priority": 1,
        "keywords": ["SRBC", "镰刀"],
    },
}
WHITE_CELLS_V2 = {
    "prompt": (
        "检测到白细胞AWBC指标升高异常，多见于：炎症/感染相关的毒性改变或异常形态细胞 [13][14]，外周血异常"
        "/幼稚细胞增多或血液系统异常线索 [9][12]，需进行涂片复核与异常形态确认 [10][11]。请医生查看细"
        "胞图片，建议进一步询问感染症状/近期用药史，或做外周血涂片复核与人工分类排查 [10][11]。"
    ),
    "basis": "AWBC为异常白细胞计数，升高提示异常细胞聚集或未分类白细胞成分增加，建议复查或人工镜检。",
    "short": "AWBC↑提示异常白细胞风险",
    "interpretation": "AWBC为异常白细胞计数，升高提示异常细胞成分增多，需结合感染/炎症或血液系统异常进一步评估。",
    "disease": {
        "name": "血液系统异常风险（需排除白血病/骨髓增生性疾病）",
        "probability": "中等",
        "analysis": "AWBC↑提示存在异常白细胞群或未分类细胞成分增多，需结合血涂片或进一步检查排除血液系统异常。",
        "priority": 2,
        "keywords": ["AWBC", "异常白细胞"],
    },
}
SICKLE_CELLS_V2 = {
    "prompt": (
        "检测到红细胞SRBC指标升高异常，多见于：镰刀型细胞贫血或携带者状态 [15][16]，或镰刀红细胞形态提示 "
        "[18]。请医生查看细胞图片，建议进一步询问家族史/贫血相关症状，或做血红蛋白电泳/HPLC/基因检测 [15"
        "][17][19] 排查。"
    ),
    "basis": "SRBC为镰刀型红细胞识别计数，升高提示红细胞形态异常，常见于镰刀型细胞贫血或携带者。",
    "short": "SRBC↑提示镰刀型细胞贫血风险",
    "interpretation": "SRBC升高提示镰刀型红细胞存在，需结合溶血指标与病史评估镰刀型细胞贫血或携带者状态。",
    "disease": {
        "name": "镰刀型细胞贫血/携带者状态",
        "probability": "较高",
        "analysis": "SRBC↑提示红细胞形态异常，需排查镰刀型细胞贫血或携带者状态，结合HGB/RET%等指标评估溶血程度。",
        "priority": 1,
        "keywords": ["SRBC", "镰刀"],
    },
}
PROFILES = {"v1": (WHITE_CELLS_V1, SICKLE_CELLS_V1), "v2": (WHITE_CELLS_V2, SICKLE_CELLS_V2)}


def profile(name: str) -> tuple[dict, dict]:
    """(white-cell, sickle-cell) wording of profile ``v1`` or ``v2``."""
    return PROFILES[name]
