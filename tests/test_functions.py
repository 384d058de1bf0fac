"""Column functions: hand-worked values, then random texts against plain Python."""

import random
import re

from pyspark.sql import functions as F

from sheetqa.functions import clinical as C
from sheetqa.functions import glossary as G
from sheetqa.functions import language as L
from sheetqa.functions import masking as M
from sheetqa.functions import polish as P
from sheetqa.functions import quality as Q
from sheetqa.functions import script as S
from sheetqa.functions import sheet_text as ST


PIECES = [
    "e", "E", "g", ".", ". ", " .", ",", ":", "://", ";", "!", "?", " ", "  ", "\n", "\r\n", "\r", "\t", "　", "\xa0",
    "a", "B", "Cell", "the", "mild", "el", "la", "leve", "é", "ñ", "Ü", "ß", "7", "12", "3.5", "(", ")", '"', "]",
    "白细胞", "血小板", "网织红细胞计数", "Хорошо", "BA-85", "x-y", "2024-01", "12-ab", "WBC", "ALY#↑", "_", "-",
    "e32456ad-e862-4eb8-88b0-38a7ac9e10f4", "reticulocyte count", "Hematocrit", "hct", "Platelet (PLT)", "😀",
]


def random_texts(n=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def test_neutral_and_identifiers(values):
    assert values(S.is_neutral, ["↑", "-", "ALY#↑", "WBC", "12%", "NEUTRO1", "", " ↑　"]) == [
        True, True, True, True, True, False, False, True,
    ]
    texts = ["e32456ad-e862-4eb8-88b0-38a7ac9e10f4", "BA-21", "x-y", "2024-01"]
    assert values(S.is_identifier, texts) == [True, True, False, False]


def test_locked(pairs):
    keys = ["id", "sample_id", "sample id", "UUID2", "编号", "paid"]
    assert pairs(S.is_locked, [(k, "abc") for k in keys]) == [True] * 5 + [False]
    rows = [("id", "白细胞"), ("id", "　"), ("note", "BA-1"), ("note", None)]
    assert pairs(S.is_locked, rows) == [False, False, True, False]


def test_language(values):
    text = "el aumento de la glucosa con leve"
    scored = values(L.language_scores, [text])[0]
    assert (scored[0].lang, scored[0].score) == ("es", 6)
    assert {s.lang: s.score for s in scored}["en"] == 2
    assert values(lambda c: L.is_target_language(c, "Spanish"), [text]) == [True]
    assert values(lambda c: L.is_target_language(c, "English"), [text]) == [False]
    assert values(L.detect_language, ["白", "да", "12", text, "hello", ""]) == [
        "zh", "ru", "unknown", "es", "en", "unknown",
    ]
    assert L.target_code("Brazilian PORTUGUESE") == "pt" and L.target_code("") == "unknown"


def test_language_scores_by_hand(values):
    """Points: one for each hint word, two for a letter of the language (Latin letters for English)."""
    table = {
        "the mild increase": {"en": 5, "es": 0, "fr": 0, "de": 0, "it": 0, "pt": 0},
        "El aumento de la glucosa con leve": {"en": 2, "es": 6, "fr": 2, "de": 0, "it": 3, "pt": 3},
        "die Zunahme und der Abnahme": {"en": 2, "es": 0, "fr": 0, "de": 5, "it": 0, "pt": 0},
        "Erhöht über alles": {"en": 2, "es": 2, "fr": 2, "de": 2, "it": 0, "pt": 0},
        "12, 14!": {"en": 0, "es": 0, "fr": 0, "de": 0, "it": 0, "pt": 0},
        "the THE thé": {"en": 5, "es": 2, "fr": 2, "de": 0, "it": 2, "pt": 2},
    }
    for text, row in zip(table, values(L.language_scores, list(table))):
        assert {x.lang: x.score for x in row} == table[text]
        assert [x.score for x in row] == sorted((x.score for x in row), reverse=True)


def test_hint_words_count_as_often_as_they_occur(values):
    texts = ["the mild", "el aumento", "der und die", "ciao con", "o a os"]
    once, twice = (values(L.language_scores, t) for t in (texts, [f"{t} {t}" for t in texts]))
    for x, y in zip(once, twice):
        single = {r.lang: r.score for r in x}
        marks = {lang: 2 if lang == "en" else 0 for lang in single}
        assert {r.lang: r.score for r in y} == {k: 2 * (v - marks[k]) + marks[k] for k, v in single.items()}


def test_target_language_by_hand(values):
    texts = ["白细胞", "да", "WBC↑", "12", "", "el aumento de la leve", "the mild", "hello"]
    expected = {
        "English": [False, False, True, True, True, False, True, True],
        "Spanish": [False, False, True, True, True, True, False, False],
        "Chinese": [True, False, True, True, True, False, False, False],
        "Russian": [False, True, True, True, True, False, False, False],
    }
    for name, wanted in expected.items():
        assert values(lambda c: L.is_target_language(c, name), texts) == wanted, name


def test_three_filters_differ(values):
    """An identifier inside CJK text hides a cell from one filter but not from the others."""
    text = ["白细胞升高，见BA-85"]
    assert values(lambda c: L.is_untranslated(F.lit("note"), c, "English"), text) == [False]
    assert values(lambda c: L.is_target_language(c, "English"), text) == [False]
    assert values(Q.cjk_residue, text) == [True]


def test_masks(values):
    assert values(lambda c: M.mask_inline(c)["sanitized"], ["白BA-85", "BA-85", None, ""]) == [
        "白__TKN_0__", "BA-85", "", "",
    ]
    nested = values(M.mask_string, ["中文%s"])[0]
    assert nested.sanitized == "中文____TKN_0__"
    assert [tuple(p) for p in nested.pairs] == [("__FMT_0__", "%s"), ("__TKN_0__", "FMT_0__")]


def test_translation_mask_by_hand(values):
    texts = ["见BA-85与WBC", "see BA-85", "0123abcd-0123-4567-89ab-0123456789ab", "A-B", "plain", "白 X1", "白 Y"]
    got = [(m.sanitized, [tuple(p) for p in m.pairs]) for m in values(M.mask_translation, texts)]
    assert got == [
        ("见__TKN_0__与__TKN_1__", [("__TKN_0__", "BA-85"), ("__TKN_1__", "WBC")]),
        ("see __ID_0__", [("__ID_0__", "BA-85")]),
        ("__ID_0__", [("__ID_0__", "0123abcd-0123-4567-89ab-0123456789ab")]),
        ("A-B", []),
        ("plain", []),
        ("白 __TKN_0__", [("__TKN_0__", "X1")]),
        ("白 Y", []),
    ]


def test_masked_tokens_are_numbered_in_order(values):
    for m in values(M.mask_translation, random_texts()):
        names = [p.k for p in m.pairs]
        assert len(set(names)) == len(names) and all(n in m.sanitized for n in names)


def test_restore_round_trips(values):
    texts = random_texts() + ["共%1$s条 {0} START", "100%% $1 \\x 白a1-b2"]
    for mask, back in (
        (M.mask_translation, M.restore),
        (M.mask_inline, M.restore),
        (M.mask_format, M.restore),
        (M.mask_string, M.restore_tolerant),
    ):
        assert values(lambda c: back(mask(c)["sanitized"], mask(c)["pairs"]), texts) == texts


def test_tolerant_restore(values):
    def through(damage, compat):
        def run(c):
            m = M.mask_string(c)
            return M.restore_tolerant(damage(m["sanitized"]), m["pairs"], compat)

        return run

    lost = through(lambda s: F.regexp_replace(s, "__$", ""), False)
    assert values(lost, ["{0}", "中文%s"]) == ["{0}", "中文%s"]
    same = through(lambda s: s, True)
    assert values(same, ["中文%s"]) == ["中文__FMT_0__"]
    many = " ".join("{%d}" % i for i in range(12))
    assert values(through(lambda s: s, False), [many]) == [many]
    assert values(same, [many]) != [many]


def test_spacing(values):
    texts = ["Done.", "e.g., 3.5g", "a\nb.c  d\r\n  x  y.", "白 ,x", "白 ,", "http://x:y", "a\r,b", None]
    assert values(P.fix_spacing, texts) == [
        "Done. ", "e. g. , 3. 5 g", "a\nb. c d\r\n  x y. ", "白, x", "白 ,", "http://x: y", "a, b", None,
    ]
    assert values(P.string_autofix, ["T 4 and T4, ab 12"]) == ["T4 and T4, ab 12"]


def test_spacing_changes_spaces_only(values):
    def bare(t):
        return "".join(t.split())

    texts = random_texts(800)
    fixed = values(P.fix_spacing, texts)
    assert [bare(t) for t in fixed] == [bare(t) for t in texts]
    plain = [t for t in texts if not any("A" <= c <= "Z" or "a" <= c <= "z" for c in t)]
    assert values(P.fix_spacing, plain) == plain


def test_lines_are_spaced_each_for_itself(values):
    lines = ["a ,b", "x  y.", "E. g .z", "T4:5", "q"]
    pairs_ = [(x, y) for x in lines for y in lines]
    alone = dict(zip(lines, values(P.fix_spacing, lines)))
    for br in ("\n", "\r\n"):
        assert values(P.fix_spacing, [x + br + y for x, y in pairs_]) == [alone[x] + br + alone[y] for x, y in pairs_]


def test_spacing_issue_by_hand(values):
    table = {
        "fine text": False, "two  spaces": True, "a , b": True, "e. g.": True, "E.G.": True, "T 4": True,
        "4 T": True, "AB 4": False, "4000 T": False, "a,b": False, "": False, "白 ,": True, "x\n.y": True,
    }
    assert values(Q.spacing_issue, list(table)) == list(table.values())


def test_glossary(pairs):
    rows = [("红细胞压积", "Hematocrit(HCT)"), ("", "HCT"), ("血小板", "a hct"), ("白细胞", "x 白细胞 y")]
    assert pairs(G.enforce_glossary, rows) == [
        "Hematocrit (HCT)(Hematocrit (HCT))", "HCT", "a hct", "x White Blood Cell (WBC) y",
    ]


def test_every_glossary_entry_fires(pairs):
    """Each source keyword of all 76 entries becomes its wording, and so does each variant."""
    rows, expected = [], []
    for entry in G.GLOSSARY:
        for term in (*entry.keywords, *entry.variants):
            rows.append((entry.keywords[0], f"x {term} y"))
            expected.append(f"x {entry.preferred} y")
    assert len(G.GLOSSARY) == 76
    got = pairs(G.enforce_glossary, rows)
    wrong = [(r, g) for r, g, e in zip(rows, got, expected) if g != e]
    assert wrong == []


def test_text_without_a_term_in_the_original_stays(pairs):
    rows = [("plain", t) for t in random_texts(seed=2)]
    assert pairs(G.enforce_glossary, rows) == [t for _, t in rows]


def test_shared_variant_goes_to_first_firing_entry(pairs):
    terms = [G.GlossaryEntry(("甲",), "First", ("thing",)), G.GlossaryEntry(("乙",), "Second", ("Thing",))]
    rows = [("甲", "thing"), ("乙", "thing"), ("乙甲", "THING"), ("丙", "thing")]
    assert pairs(lambda o, t: G.enforce_glossary(o, t, terms), rows) == ["First", "Second", "First", "thing"]


def test_long_form_status(values):
    texts = ["A Decreased count.", "mild  Elevated; elevated in", "Elevated in", "😀" * 26 + "Elevated in"]
    assert values(P.long_form_status, texts) == [
        "A decrease count.", "mild increase; increase in", "Elevated in", "😀" * 26 + "Increase in",
    ]


def test_conditions(values):
    got = values(C.parse_conditions, ["WBC↑、WBC高;WBC 高,NEU#↑", "WBC，NEU", "、 ;", None])
    assert [tuple(c) for c in got[0]] == [
        ("WBC", ">", "↑"), ("WBC高", "status", "status"), ("WBC", ">", "高"), ("NEU", "status", "status"),
    ]
    assert [tuple(c) for c in got[1]] == [("WBC", "status", "status")]
    assert got[2] == [] and got[3] == []


def test_themes_and_scores(values):
    assert values(C.theme, ["细菌", "ANEMIA", "嗜酸", "血小板", "stable", "?"]) == [
        "infection", "anemia", "allergy", "bleeding", "normal", "unknown",
    ]
    assert values(C.confidence, ["建议", "Suspect", ""]) == [0.78, 0.65, 0.5]


def _slots(spark, rows, config):
    fields = "array<struct<name:string,probability:string,analysis:string>>"
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s {fields}")
    out = df.select("i", ST.insert_disease(F.col("s"), config).alias("s")).orderBy("i").collect()
    return [[tuple(x) for x in r.s] for r in out]


def test_disease_slots(spark):
    new = {"name": "N", "probability": "p", "analysis": "n", "keywords": ["key"]}
    empty, a, b, c = ("", "", ""), ("A", "1", "a"), ("B", "2", "b。"), ("C", "3", "c")
    first, second = {**new, "priority": 1}, {**new, "priority": 2}
    made = ("N", "p", "n")
    assert _slots(spark, [[empty] * 3, [a, empty, empty], [a, b, c], [a, b, ("C", "3", "")]], first) == [
        [made, empty, empty], [made, a, empty], [made, a, ("B", "2", "b；c")], [made, a, b],
    ]
    assert _slots(spark, [[empty] * 3, [a, (None, None, None), c], [a, b, c], [("a key", "", ""), b, c]], second) == [
        [made, empty, empty], [a, made, c], [a, b, ("C", "3", "c；n")], [("a key", "", ""), b, c],
    ]


def test_sheet_text(values):
    assert values(ST.fix_qualifier, ["ALY# (atypical granulocytes)", "early reactive WBCs ( aly )", "cells"]) == [
        "ALY# (atypical lymphocytes)", "atypical lymphocytes (aly)", "cells",
    ]
    assert values(ST.cleanup_english, ["anti metabolic, e . g . , e . g .x", "中granulocytes (ALY#)"]) == [
        "antimetabolite, e.g., e.g.x", "中granulocytes (ALY#)",
    ]


def test_hint_words_are_whole_words_of_the_folded_text(values):
    rng = random.Random(5)
    words = [w for ws in L.LANGUAGE_HINTS.values() for w in ws] + ["thee", "lala", "x", "É", "más", "ß"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "-", "", "7", "。"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def expected(text, folded):
        tokens = re.split("[^a-z]+", folded)
        points = []
        for i, (lang, hints) in enumerate(L.LANGUAGE_HINTS.items()):
            mark = re.search(L._mark_class(lang), text) is not None
            points.append((-(sum(t in hints for t in tokens) + 2 * mark), i, lang))
        return [(lang, -p) for p, _, lang in sorted(points)]

    folded = values(L.fold_latin, texts)
    got = [[tuple(x) for x in r] for r in values(L.language_scores, texts)]
    assert got == [expected(t, f) for t, f in zip(texts, folded)]


def test_rewrites_are_skipped_only_where_they_change_nothing(values):
    rng = random.Random(11)
    bits = ["e.g.", "E. g .", "aBcDe", "T4", "4T", "a", " ", "  ", "\n", "\r\n", "\r", "　", "。", ".", ":", "://", ",", ")", "eG",
            "An Elevated", "slight  Decreased", "Elevated in", "decreased in", "Elevated fever", "reElevated in", "Elevated total ghost cells is"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]

    def plain(c, steps):
        for pattern, replacement in steps:
            c = F.regexp_replace(c, pattern, replacement)
        return c

    for space in (P._ANY_SPACE, P._ASCII_SPACE):
        steps = P.spacing_steps(space)
        assert values(lambda c: P._chain(c, steps, P._spacing_signs(space)), texts) == values(lambda c: plain(c, steps), texts)
    back = [(p.replace("(?=[sm])", "").replace(f"(?=[{p[p.index('[') + 1]}])", ""), r) for p, r in P.STATUS_STEPS]
    assert all("(?=[" not in p and p.count("(?<!") == 1 for p, _ in back)
    assert values(lambda c: plain(c, P.STATUS_STEPS), texts) == values(lambda c: plain(c, back), texts)
