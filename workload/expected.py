"""What the SQL expects: fixed values, held here apart from the library's own tables.

A wrong value on either side turns a query red.
"""

from __future__ import annotations

from typing import NamedTuple


class Entry(NamedTuple):
    keywords: list[str]
    preferred: str
    variants: list[str]


class Item(NamedTuple):
    indicator: str
    aliases: list[str]
    op: str | None


class Template(NamedTuple):
    template_id: str
    title: str
    summary: str
    severity: str
    indicators: list[Item]
    keywords: list[str]
    status: str


# The term glossary.
GLOSSARY = [
    Entry(["全自动血液分析仪", "自动血液分析仪"], "Automated Hematology Analyzer", []),
    Entry(["血液分析系统", "血液分析仪器"], "Hematology System", []),
    Entry(["体外诊断设备", "体外诊断仪器"], "In Vitro Diagnostic (IVD) Device", []),
    Entry(["光学单元"], "Optical Unit", []),
    Entry(["光电模组"], "Photoelectric Module", []),
    Entry(["显微镜头相机模组", "显微相机模组"], "Microscopic Camera Module", []),
    Entry(["载物台移动模块"], "Stage Movement Module", []),
    Entry(["自动加样模块"], "Automated Sampling Module", []),
    Entry(["移液器组件"], "Pipettor Assembly", []),
    Entry(["计数板", "计数室"], "Counting Chamber", []),
    Entry(["朗伯-比尔定律", "比尔朗伯定律"], "Beer-Lambert Law", []),
    Entry(["柱塞泵"], "Plunger Pump", []),
    Entry(["电磁兼容性"], "Electromagnetic Compatibility (EMC)", []),
    Entry(["血常规检测", "血常规"], "Complete Blood Count (CBC)", []),
    Entry(["白细胞"], "White Blood Cell (WBC)", []),
    Entry(["异常淋巴细胞", "异形淋巴细胞", "非典型淋巴细胞"], "Atypical Lymphocytes (ALY#)", ["Atypical granulocytes", "Immature granulocytes", "Atypical granulocytes (ALY#)", "Immature granulocytes (ALY#)", "granulocytes (ALY#)"]),
    Entry(["红细胞"], "Red Blood Cell (RBC)", []),
    Entry(["网织红细胞"], "Reticulocytes", ["Reticulocyte", "reticulocytes", "reticulocyte"]),
    Entry(["网织红细胞比率", "网织红细胞比例", "网织红细胞率"], "Reticulocyte Percentage", ["Reticulocyte Ratio", "Reticulocyte percent", "Reticulocyte percentage"]),
    Entry(["网织红细胞计数"], "Reticulocyte Count", ["Reticulocyte count"]),
    Entry(["影红细胞"], "Ghost Cells", ["Ghost cells", "Ghost RBCs", "Ghost red blood cells"]),
    Entry(["球形红细胞增多症"], "Spherocytosis", ["spherocytosis"]),
    Entry(["球形红细胞"], "Spherocytes", ["Spherocyte", "spherocytes", "spherocyte"]),
    Entry(["血小板"], "Platelet (PLT)", []),
    Entry(["血红蛋白"], "Hemoglobin (HGB)", []),
    Entry(["血红蛋白浓度"], "Hemoglobin Concentration", ["Hemoglobin concentration"]),
    Entry(["血红蛋白含量"], "Hemoglobin Content", ["Hemoglobin content"]),
    Entry(["平均红细胞血红蛋白含量"], "Mean Corpuscular Hemoglobin (MCH)", ["Mean Corpuscular Hemoglobin", "MCH"]),
    Entry(["平均红细胞血红蛋白浓度"], "Mean Corpuscular Hemoglobin Concentration (MCHC)", ["Mean Corpuscular Hemoglobin Concentration", "MCHC"]),
    Entry(["平均红细胞体积"], "Mean Corpuscular Volume (MCV)", []),
    Entry(["红细胞压积"], "Hematocrit (HCT)", ["Hematocrit", "HCT"]),
    Entry(["红细胞生成素", "促红细胞生成素"], "Erythropoietin (EPO)", ["Erythropoietin", "EPO"]),
    Entry(["血液浓缩"], "Hemoconcentration", ["hemoconcentration"]),
    Entry(["溶血"], "Hemolysis", ["hemolysis"]),
    Entry(["血管内溶血"], "Intravascular Hemolysis", ["intravascular hemolysis"]),
    Entry(["血管外溶血"], "Extravascular Hemolysis", ["extravascular hemolysis"]),
    Entry(["混合性溶血"], "Mixed Hemolysis", ["mixed hemolysis"]),
    Entry(["溶血性贫血"], "Hemolytic Anemia", ["hemolytic anemia"]),
    Entry(["自身免疫性溶血性贫血"], "Autoimmune Hemolytic Anemia", ["autoimmune hemolytic anemia"]),
    Entry(["免疫介导性溶血性贫血"], "Immune-Mediated Hemolytic Anemia (IMHA)", ["Immune-mediated hemolytic anemia", "IMHA"]),
    Entry(["巨幼红细胞性贫血"], "Megaloblastic Anemia", ["megaloblastic anemia"]),
    Entry(["大细胞性贫血"], "Macrocytic Anemia", ["macrocytic anemia"]),
    Entry(["大红细胞增多症"], "Macrocytosis", ["macrocytosis"]),
    Entry(["小细胞性贫血"], "Microcytic Anemia", ["microcytic anemia"]),
    Entry(["小细胞低色素性贫血"], "Microcytic Hypochromic Anemia", ["microcytic hypochromic anemia"]),
    Entry(["缺铁性贫血"], "Iron Deficiency Anemia", ["iron deficiency anemia"]),
    Entry(["慢性失血性贫血"], "Chronic Hemorrhagic Anemia", ["chronic hemorrhagic anemia"]),
    Entry(["急性失血性贫血"], "Acute Hemorrhagic Anemia", ["acute hemorrhagic anemia"]),
    Entry(["营养性贫血"], "Nutritional Anemia", ["nutritional anemia"]),
    Entry(["再生障碍性贫血"], "Aplastic Anemia", ["aplastic anemia"]),
    Entry(["遗传性球形红细胞增多症"], "Hereditary Spherocytosis", ["hereditary spherocytosis"]),
    Entry(["骨髓增生异常综合征"], "Myelodysplastic Syndrome (MDS)", ["myelodysplastic syndrome", "MDS"]),
    Entry(["真性红细胞增多症"], "Polycythemia Vera", ["polycythemia vera"]),
    Entry(["直方图"], "Histogram", []),
    Entry(["抗凝剂"], "Anticoagulant (EDTA)", []),
    Entry(["静脉血"], "Venous Blood", []),
    Entry(["末梢血"], "Capillary Blood", []),
    Entry(["有形成分"], "Formed Elements", []),
    Entry(["生物危害", "潜在传染物"], "Biohazard", []),
    Entry(["耗材"], "Consumables", []),
    Entry(["试剂盒"], "Reagent Kit", []),
    Entry(["批次号"], "Lot Number", []),
    Entry(["校准系数", "校准"], "Calibration Factor", []),
    Entry(["质控品", "质控"], "Quality Control (QC)", []),
    Entry(["靶值"], "Target Value", []),
    Entry(["标准差"], "Standard Deviation (SD)", []),
    Entry(["变异系数"], "Coefficient of Variation (CV)", []),
    Entry(["LJ质控图"], "Levey-Jennings Chart", []),
    Entry(["LIS连接"], "LIS Connection", []),
    Entry(["样本前处理"], "Sample Pre-processing", []),
    Entry(["参考范围"], "Reference Range", []),
    Entry(["复测", "重新测试"], "Rerun", []),
    Entry(["使用寿命", "寿命"], "Lifetime", ["Service Life", "Service Lifetime", "Analyzer Service Life"]),
    Entry(["DC接口"], "DC Port", ["DC Interface", "DC interface"]),
    Entry(["USB接口"], "USB Port", ["USB Interface", "USB interface"]),
    Entry(["EH-BUS接口"], "EH-BUS Port", ["EH-BUS Interface", "EH-BUS interface"]),
]

# Hint words and letters of languages.
LANGUAGE_HINTS = {
    "en": ["the", "and", "of", "to", "in", "with", "possible", "suggests", "increase", "decrease", "elevated", "indicates", "seen", "likely", "mild", "moderate", "severe"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "con", "posible", "sugiere", "aumento", "disminucion", "elevado", "indica", "leve", "moderado", "grave"],
    "fr": ["le", "la", "les", "de", "et", "en", "avec", "possible", "suggere", "augmentation", "diminution", "eleve", "indique", "leger", "modere", "grave"],
    "de": ["der", "die", "das", "und", "mit", "bei", "moeglich", "erhoeht", "zunahme", "abnahme", "weist", "leicht", "maessig", "schwer"],
    "it": ["il", "la", "le", "di", "e", "con", "possibile", "suggerisce", "aumento", "diminuzione", "elevato", "indica", "lieve", "moderato", "grave"],
    "pt": ["o", "a", "os", "as", "de", "e", "em", "com", "possivel", "sugere", "aumento", "diminuicao", "elevado", "indica", "leve", "moderado", "grave"],
}
LANGUAGE_MARKS = {
    "en": "abcdefghijklmnopqrstuvwxyz",
    "es": "ñáéíóúü¡¿",
    "fr": "éèêëàâçîïôûùüÿœ",
    "de": "äöüß",
    "it": "àèéìòù",
    "pt": "ãõçáéíóúàâêô",
}

# The combination library.
TEMPLATES = [
    Template(
        "combo-wbc-neu-high",
        "白细胞 & 中性粒升高（疑似细菌感染）",
        "当 WBC 与中性粒细胞（NEU）同步升高时，多提示急性细菌感染或强烈炎症反应，应结合发热、CRP 等指标进一步排查。",
        "warning",
        [
            Item("WBC", ["WBC", "白细胞"], ">"),
            Item("NEU", ["NEU", "中性粒", "中性粒细胞"], ">"),
        ],
        ["感染", "bacterial"],
        "active",
    ),
    Template(
        "combo-wbc-lym-low",
        "白细胞降低 + 淋巴细胞降低（骨髓抑制/病毒性抑制）",
        "WBC、LYM 同步下降时需警惕骨髓造血抑制、抗肿瘤化疗后抑制或重症病毒感染的恢复期。",
        "critical",
        [
            Item("WBC", ["WBC", "白细胞"], "<"),
            Item("LYM", ["LYM", "淋巴"], "<"),
        ],
        ["抑制", "suppression"],
        "active",
    ),
    Template(
        "combo-rbc-hgb-low",
        "红细胞 & 血红蛋白降低（贫血提示）",
        "RBC、HGB 明显低于参考范围通常代表贫血，应提示铁缺乏、慢性肾病、失血等病因评估。",
        "warning",
        [
            Item("RBC", ["RBC", "红细胞"], "<"),
            Item("HGB", ["HGB", "血红蛋白", "Hb"], "<"),
        ],
        ["贫血", "anemia"],
        "active",
    ),
    Template(
        "combo-plt-low",
        "血小板显著降低（血小板减少症）",
        "PLT 低于 100×10^9/L 时提示出血风险，需结合 DIC、免疫性血小板减少等病因。",
        "critical",
        [
            Item("PLT", ["PLT", "血小板"], "<"),
        ],
        ["出血", "thrombocytopenia"],
        "active",
    ),
    Template(
        "combo-lym-high",
        "淋巴细胞升高（病毒感染可能）",
        "LYM 升高伴 WBC 正常或轻度升高，多见于病毒感染、百日咳等，应提示结合病史。",
        "normal",
        [
            Item("LYM", ["LYM", "淋巴"], ">"),
        ],
        ["病毒", "viral"],
        "active",
    ),
    Template(
        "combo-eos-high",
        "嗜酸粒升高（过敏/寄生虫）",
        "EOS 持续升高多与过敏反应、寄生虫感染或某些自身免疫疾病相关，需结合症状确认。",
        "normal",
        [
            Item("EOS", ["EOS", "嗜酸", "嗜酸细胞"], ">"),
        ],
        ["过敏", "allergy"],
        "active",
    ),
    Template(
        "combo-mono-high",
        "单核细胞升高（慢性感染或恢复期）",
        "MONO 升高可提示慢性炎性疾病或骨髓恢复期，应提示结合 ESR、CRP。",
        "warning",
        [
            Item("MONO", ["MONO", "单核"], ">"),
        ],
        ["慢性", "chronic"],
        "active",
    ),
    Template(
        "combo-hct-high",
        "红细胞压积升高（真性红细胞增多）",
        "RBC、HCT 同步升高时应警惕真性红细胞增多症或慢性低氧状态，需进一步检查 JAK2。",
        "warning",
        [
            Item("RBC", ["RBC", "红细胞"], ">"),
            Item("HCT", ["HCT", "红细胞压积"], ">"),
        ],
        ["增多", "polycythemia"],
        "active",
    ),
]

# Theme patterns, first hit wins, and wording of the cross-check.
THEME_WORDS = [
    ("感染|infection|细菌", "infection"),
    ("贫血|anemia", "anemia"),
    ("过敏|allergy|嗜酸", "allergy"),
    ("出血|thrombocytopenia|血小板", "bleeding"),
    ("正常|无异常|stable", "normal"),
]
NO_TEXT = "尚无解读，请补充对应资料。"
NO_TEMPLATE = "建议补充临床解释或参考 AI 建议。"

# Wording for raised indicators, per profile.
WHITE_V1 = {
    "prompt": "AWBC↑提示存在异常白细胞群或异常细胞成分增多，需结合血涂片及临床情况评估感染、炎症或血液系统异常。",
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
SICKLE_V1 = {
    "prompt": "SRBC↑提示镰刀型红细胞存在，需考虑镰刀型细胞贫血风险或携带者状态。",
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
WHITE_V2 = {
    "prompt": "检测到白细胞AWBC指标升高异常，多见于：炎症/感染相关的毒性改变或异常形态细胞 [13][14]，外周血异常/幼稚细胞增多或血液系统异常线索 [9][12]，需进行涂片复核与异常形态确认 [10][11]。请医生查看细胞图片，建议进一步询问感染症状/近期用药史，或做外周血涂片复核与人工分类排查 [10][11]。",
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
SICKLE_V2 = {
    "prompt": "检测到红细胞SRBC指标升高异常，多见于：镰刀型细胞贫血或携带者状态 [15][16]，或镰刀红细胞形态提示 [18]。请医生查看细胞图片，建议进一步询问家族史/贫血相关症状，或做血红蛋白电泳/HPLC/基因检测 [15][17][19] 排查。",
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
