"""The term glossary and its enforcement inside translated text."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import CJK
from .text import B_END, B_START, is_ascii, let, replace_each


class GlossaryEntry(NamedTuple):
    keywords: tuple[str, ...]
    preferred: str
    variants: tuple[str, ...] = ()


# Source keywords, preferred wording, variants to normalise.
GLOSSARY = [
    GlossaryEntry(("全自动血液分析仪", "自动血液分析仪"), "Automated Hematology Analyzer"),
    GlossaryEntry(("血液分析系统", "血液分析仪器"), "Hematology System"),
    GlossaryEntry(("体外诊断设备", "体外诊断仪器"), "In Vitro Diagnostic (IVD) Device"),
    GlossaryEntry(("光学单元",), "Optical Unit"),
    GlossaryEntry(("光电模组",), "Photoelectric Module"),
    GlossaryEntry(("显微镜头相机模组", "显微相机模组"), "Microscopic Camera Module"),
    GlossaryEntry(("载物台移动模块",), "Stage Movement Module"),
    GlossaryEntry(("自动加样模块",), "Automated Sampling Module"),
    GlossaryEntry(("移液器组件",), "Pipettor Assembly"),
    GlossaryEntry(("计数板", "计数室"), "Counting Chamber"),
    GlossaryEntry(("朗伯-比尔定律", "比尔朗伯定律"), "Beer-Lambert Law"),
    GlossaryEntry(("柱塞泵",), "Plunger Pump"),
    GlossaryEntry(("电磁兼容性",), "Electromagnetic Compatibility (EMC)"),
    GlossaryEntry(("血常规检测", "血常规"), "Complete Blood Count (CBC)"),
    GlossaryEntry(("白细胞",), "White Blood Cell (WBC)"),
    GlossaryEntry(
        ("异常淋巴细胞", "异形淋巴细胞", "非典型淋巴细胞"),
        "Atypical Lymphocytes (ALY#)",
        ("Atypical granulocytes", "Immature granulocytes", "Atypical granulocytes (ALY#)", "Immature granulocytes (ALY#)", "granulocytes (ALY#)"),
    ),
    GlossaryEntry(("红细胞",), "Red Blood Cell (RBC)"),
    GlossaryEntry(("网织红细胞",), "Reticulocytes", ("Reticulocyte", "reticulocytes", "reticulocyte")),
    GlossaryEntry(
        ("网织红细胞比率", "网织红细胞比例", "网织红细胞率"),
        "Reticulocyte Percentage",
        ("Reticulocyte Ratio", "Reticulocyte percent", "Reticulocyte percentage"),
    ),
    GlossaryEntry(("网织红细胞计数",), "Reticulocyte Count", ("Reticulocyte count",)),
    GlossaryEntry(("影红细胞",), "Ghost Cells", ("Ghost cells", "Ghost RBCs", "Ghost red blood cells")),
    GlossaryEntry(("球形红细胞增多症",), "Spherocytosis", ("spherocytosis",)),
    GlossaryEntry(("球形红细胞",), "Spherocytes", ("Spherocyte", "spherocytes", "spherocyte")),
    GlossaryEntry(("血小板",), "Platelet (PLT)"),
    GlossaryEntry(("血红蛋白",), "Hemoglobin (HGB)"),
    GlossaryEntry(("血红蛋白浓度",), "Hemoglobin Concentration", ("Hemoglobin concentration",)),
    GlossaryEntry(("血红蛋白含量",), "Hemoglobin Content", ("Hemoglobin content",)),
    GlossaryEntry(("平均红细胞血红蛋白含量",), "Mean Corpuscular Hemoglobin (MCH)", ("Mean Corpuscular Hemoglobin", "MCH")),
    GlossaryEntry(
        ("平均红细胞血红蛋白浓度",),
        "Mean Corpuscular Hemoglobin Concentration (MCHC)",
        ("Mean Corpuscular Hemoglobin Concentration", "MCHC"),
    ),
    GlossaryEntry(("平均红细胞体积",), "Mean Corpuscular Volume (MCV)"),
    GlossaryEntry(("红细胞压积",), "Hematocrit (HCT)", ("Hematocrit", "HCT")),
    GlossaryEntry(("红细胞生成素", "促红细胞生成素"), "Erythropoietin (EPO)", ("Erythropoietin", "EPO")),
    GlossaryEntry(("血液浓缩",), "Hemoconcentration", ("hemoconcentration",)),
    GlossaryEntry(("溶血",), "Hemolysis", ("hemolysis",)),
    GlossaryEntry(("血管内溶血",), "Intravascular Hemolysis", ("intravascular hemolysis",)),
    GlossaryEntry(("血管外溶血",), "Extravascular Hemolysis", ("extravascular hemolysis",)),
    GlossaryEntry(("混合性溶血",), "Mixed Hemolysis", ("mixed hemolysis",)),
    GlossaryEntry(("溶血性贫血",), "Hemolytic Anemia", ("hemolytic anemia",)),
    GlossaryEntry(("自身免疫性溶血性贫血",), "Autoimmune Hemolytic Anemia", ("autoimmune hemolytic anemia",)),
    GlossaryEntry(
        ("免疫介导性溶血性贫血",),
        "Immune-Mediated Hemolytic Anemia (IMHA)",
        ("Immune-mediated hemolytic anemia", "IMHA"),
    ),
    GlossaryEntry(("巨幼红细胞性贫血",), "Megaloblastic Anemia", ("megaloblastic anemia",)),
    GlossaryEntry(("大细胞性贫血",), "Macrocytic Anemia", ("macrocytic anemia",)),
    GlossaryEntry(("大红细胞增多症",), "Macrocytosis", ("macrocytosis",)),
    GlossaryEntry(("小细胞性贫血",), "Microcytic Anemia", ("microcytic anemia",)),
    GlossaryEntry(("小细胞低色素性贫血",), "Microcytic Hypochromic Anemia", ("microcytic hypochromic anemia",)),
    GlossaryEntry(("缺铁性贫血",), "Iron Deficiency Anemia", ("iron deficiency anemia",)),
    GlossaryEntry(("慢性失血性贫血",), "Chronic Hemorrhagic Anemia", ("chronic hemorrhagic anemia",)),
    GlossaryEntry(("急性失血性贫血",), "Acute Hemorrhagic Anemia", ("acute hemorrhagic anemia",)),
    GlossaryEntry(("营养性贫血",), "Nutritional Anemia", ("nutritional anemia",)),
    GlossaryEntry(("再生障碍性贫血",), "Aplastic Anemia", ("aplastic anemia",)),
    GlossaryEntry(("遗传性球形红细胞增多症",), "Hereditary Spherocytosis", ("hereditary spherocytosis",)),
    GlossaryEntry(("骨髓增生异常综合征",), "Myelodysplastic Syndrome (MDS)", ("myelodysplastic syndrome", "MDS")),
    GlossaryEntry(("真性红细胞增多症",), "Polycythemia Vera", ("polycythemia vera",)),
    GlossaryEntry(("直方图",), "Histogram"),
    GlossaryEntry(("抗凝剂",), "Anticoagulant (EDTA)"),
    GlossaryEntry(("静脉血",), "Venous Blood"),
    GlossaryEntry(("末梢血",), "Capillary Blood"),
    GlossaryEntry(("有形成分",), "Formed Elements"),
    GlossaryEntry(("生物危害", "潜在传染物"), "Biohazard"),
    GlossaryEntry(("耗材",), "Consumables"),
    GlossaryEntry(("试剂盒",), "Reagent Kit"),
    GlossaryEntry(("批次号",), "Lot Number"),
    GlossaryEntry(("校准系数", "校准"), "Calibration Factor"),
    GlossaryEntry(("质控品", "质控"), "Quality Control (QC)"),
    GlossaryEntry(("靶值",), "Target Value"),
    GlossaryEntry(("标准差",), "Standard Deviation (SD)"),
    GlossaryEntry(("变异系数",), "Coefficient of Variation (CV)"),
    GlossaryEntry(("LJ质控图",), "Levey-Jennings Chart"),
    GlossaryEntry(("LIS连接",), "LIS Connection"),
    GlossaryEntry(("样本前处理",), "Sample Pre-processing"),
    GlossaryEntry(("参考范围",), "Reference Range"),
    GlossaryEntry(("复测", "重新测试"), "Rerun"),
    GlossaryEntry(("使用寿命", "寿命"), "Lifetime", ("Service Life", "Service Lifetime", "Analyzer Service Life")),
    GlossaryEntry(("DC接口",), "DC Port", ("DC Interface", "DC interface")),
    GlossaryEntry(("USB接口",), "USB Port", ("USB Interface", "USB interface")),
    GlossaryEntry(("EH-BUS接口",), "EH-BUS Port", ("EH-BUS Interface", "EH-BUS interface")),
]


def glossary_prompt(glossary: Sequence[GlossaryEntry] = GLOSSARY) -> Column:
    """``first keyword -> preferred`` per line, as a literal."""
    return F.lit("\n".join(f"{e.keywords[0]} -> {e.preferred}" for e in glossary))


def _variant_pattern(variant: str) -> str:
    escaped = re.sub(r"([-/\\^$*+?.()|\[\]{}])", r"\\\1", variant)
    wordlike = re.fullmatch("[A-Za-z0-9 ]+", variant)
    return f"{B_START}{escaped}{B_END}" if wordlike else escaped


def _entries(glossary: Sequence[GlossaryEntry]) -> Column:
    """The glossary as one array literal; ``neg`` sorts longer variants first."""
    rows = []
    for entry in glossary:
        spellings: dict[str, str] = {}
        for variant in filter(None, (*entry.keywords, *entry.variants, entry.preferred)):
            spellings.setdefault(variant.lower(), variant)
        variants = [
            {"neg": -len(v), "low": low, "pattern": _variant_pattern(v)}
            for low, v in spellings.items()
        ]
        keywords = [k for k in entry.keywords if k]
        rows.append({"keywords": keywords, "preferred": entry.preferred, "variants": variants})
    return F.from_json(
        F.lit(json.dumps(rows, ensure_ascii=False)),
        "array<struct<keywords:array<string>,preferred:string,"
        "variants:array<struct<neg:int,low:string,pattern:string>>>>",
    )


def rewrite_terms(c: Column, fired: Column) -> Column:
    """``c`` with the spellings of the ``fired`` entries as their preferred wording, longest first."""
    variants = F.flatten(F.transform(fired, lambda e: e["variants"]))
    # A variant that is nowhere in the text cannot match: leaving it out keeps the
    # pattern short, and most texts need none.
    present = let(
        F.lower(c), lambda low: F.filter(variants, lambda v: low.contains(v["low"]))
    )

    def wording(match: Column) -> Column:
        def first(low: Column) -> Column:
            owns = F.filter(
                fired, lambda e: F.exists(e["variants"], lambda v: v["low"] == low)
            )
            return F.get(owns, 0)["preferred"]

        return F.coalesce(let(F.lower(match), first), match)

    def replaced(found: Column) -> Column:
        patterns = F.transform(F.array_sort(found), lambda v: v["pattern"])
        return let(
            F.concat(F.lit("(?i)"), F.array_join(patterns, "|")),
            lambda p: replace_each(c, p, lambda m, _: wording(m)),
        )

    return let(present, lambda v: F.when(F.size(v) == 0, c).otherwise(replaced(v)))


def enforce_glossary(
    original: Column, c: Column, glossary: Sequence[GlossaryEntry] = GLOSSARY
) -> Column:
    """Normalise term variants in ``c`` for every entry whose keyword is in ``original``.

    The keywords, variants and preferred wording of the entries that fire form one
    alternation, longest first; each match becomes the wording of the first firing entry that
    has it. The pattern depends on the row, so it is built as a Column. ``c`` is used
    several times: pass a plain column or one bound with ``let``.
    """

    active = original.isNotNull() & c.isNotNull()
    if all(re.search(CJK, k) for e in glossary for k in e.keywords):
        # Every keyword has a CJK letter: other originals cannot fire an entry.
        active = active & ~is_ascii(original) & original.rlike(CJK)
    fired = F.filter(
        _entries(glossary), lambda e: F.exists(e["keywords"], lambda k: original.contains(k))
    )
    return F.when(
        active, let(fired, lambda f: F.when(F.size(f) == 0, c).otherwise(rewrite_terms(c, f)))
    ).otherwise(c)
