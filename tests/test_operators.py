"""Table operators on small tables, brute force where it is easy."""

import random

import pytest
from pyspark.sql import functions as F

from sheetqa.functions.library import TEMPLATES
from sheetqa.operators import batches as B
from sheetqa.operators import crosscheck as X
from sheetqa.operators import merge as MG
from sheetqa.operators import quality as Q
from sheetqa.operators import rules as R
from sheetqa.operators import sheet_update as U
from sheetqa.plans.rule_check import check_rules
from sheetqa.plans.translation import finish, prepare
from sheetqa.ranking import ranked
from sheetqa.sources import history as H
from sheetqa.sources import progress as PR
from sheetqa.sources import reshape as RS
from sheetqa.sources import responses as RP
from sheetqa.sources import sheets as SH
from sheetqa.sources import string_resources as SR
from sheetqa.sources import xml_text as XT
from sheetqa.store import scratch_path


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("spread", [1, 2**40])
def test_ranked_matches_sorting(spark, spread):
    rng = random.Random(spread)
    data = {("hot" if rng.random() < 0.5 else f"d{rng.randrange(5)}", rng.randrange(400) * spread) for _ in range(500)}
    got = rows(ranked(spark.createDataFrame(list(data), "doc_id string, row_idx bigint"), ["doc_id"]))
    by_doc = {}
    for d, i in sorted(data):
        by_doc.setdefault(d, []).append(i)
    assert got == sorted([(d, i, n + 1) for d, ids in by_doc.items() for n, i in enumerate(ids)], key=repr)


def test_ranked_takes_null_as_a_group(spark):
    df = spark.createDataFrame([(None, 5), (None, 3), ("a", 1)], "doc_id string, row_idx bigint")
    assert rows(ranked(df, ["doc_id"])) == sorted([("a", 1, 1), (None, 3, 1), (None, 5, 2)], key=repr)


def test_row_ranges(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 6, 8, 9, 20)], "row_idx bigint")
    assert Q.row_ranges(df, 3).collect()[0].ranges == "1-3, 7, 9-10..."
    full = Q.row_ranges(df, limit=10).collect()[0].ranges
    back = []
    for part in full.split(", "):
        a, _, b = part.partition("-")
        back += range(int(a) - 1, int(b or a))
    assert back == [0, 1, 2, 6, 8, 9, 20]
    assert Q.row_ranges(df.limit(0), 3).collect()[0].ranges == ""


@pytest.mark.parametrize(
    "indices, ranges",
    [([0, 0, 1], "1, 1-2"), ([0, 1, 1], "1-2, 2"), ([4, 4, 4], "5, 5, 5"), ([0, 1, 1, 1, 2, 4], "1-2, 2, 2-3, 5")],
)
def test_a_repeated_row_starts_a_new_range(spark, indices, ranges):
    df = spark.createDataFrame([(i,) for i in indices], "row_idx bigint")
    assert Q.row_ranges(df, 10).collect()[0].ranges == ranges


@pytest.mark.parametrize("n", [2, 2000])
def test_first_rows_of_a_large_group(spark, n):
    data = [("hot", i) for i in range(3000)] + [("b", 1)]
    got = Q.first_n(spark.createDataFrame(data, "g string, i bigint"), ["g"], ["i"], n)
    assert rows(got) == sorted([("hot", i, i + 1) for i in range(n)] + [("b", 1, 1)], key=repr)
    whole = Q.first_n(spark.createDataFrame(data, "g string, i bigint"), [], ["g", "i"], n)
    assert whole.count() == n


def test_percent_divides_first(spark):
    """29 of 200 is 14.499999999999998 percent."""
    data = [(i, i < 29, False, False) for i in range(200)]
    df = spark.createDataFrame(data, "row_idx int, done boolean, missing boolean, write_failed boolean")
    assert Q.progress(df).first().percent == 14


def test_the_last_of_columns_with_one_key_wins(spark):
    cells = spark.createDataFrame(
        [(0, 0, "X", "a"), (0, 1, "X_1", "b"), (0, 2, "X_1", "c"), (1, 0, "X", "d")],
        "row_idx int, col_idx int, col_key string, translated string",
    )
    assert rows(RS.to_rows(cells, ["X", "X_1"])) == [(0, "a", "c"), (1, "d", None)]


def test_answers_that_break_tables(spark):
    texts = ['[{"content":"one","content":"two"}]', '[{"a":"x"},3]', '[{"a":"x"},null,{}]', "[]", '{"records":[{"a":"1"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string")
    parsed = RP.parse_responses(df)
    assert [r.records for r in parsed.orderBy("batch_id").collect()] == [
        [{"content": "two"}], [{"a": "x"}, None], [{"a": "x"}, None, {}], [], [{"a": "1"}],
    ]
    wanted = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (4, 1)], "batch_id int, n_records int")
    errors = [r.error for r in B.validate_responses(wanted, parsed).orderBy("batch_id").collect()]
    invalid = "Translation returned invalid record data."
    assert errors == ["", invalid, invalid, "Translation returned 0 records (expected 1).", ""]


def test_header_keys(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(["WBC", "WBC", "WBC", "", None])], "col_idx int, header string")
    keys = [r.col_key for r in RS.header_keys(df).orderBy("col_idx").collect()]
    assert keys == ["WBC", "WBC_1", "WBC_2", "__EMPTY", "__EMPTY_1"]


def test_parse_sheet(spark):
    raw = spark.createDataFrame(
        [(2, 1, "WBC", "string"), (2, 2, "WBC", "string"), (2, 3, "0", "number"), (3, 1, "unit", "string"), (5, 2, "7", "number")],
        "sheet_row bigint, col_idx int, value string, value_type string",
    )
    got = rows(SH.parse_sheet(raw.withColumn("doc_id", F.lit("f"))).select("row_idx", "col_key", "value", "value_type"))
    assert [g[:3] for g in got] == [
        (0, "WBC", "unit"), (0, "WBC_1", ""), (0, "__EMPTY", ""), (1, "WBC", ""), (1, "WBC_1", ""), (1, "__EMPTY", ""),
        (2, "WBC", ""), (2, "WBC_1", "7"), (2, "__EMPTY", ""),
    ]
    assert got[7][3] == "number"


def test_cells_and_back(spark):
    df = spark.createDataFrame(
        [("f", 0, "x", 1, True), ("f", 1, None, 2, False)], "doc_id string, row_idx bigint, a string, `b.c` bigint, ok boolean"
    )
    cells = RS.to_cells(df, ["a", "b.c", "ok"])
    assert rows(cells.filter("row_idx = 1").select("col_key", "value", "value_type")) == [
        ("a", "", "string"), ("b.c", "2", "number"), ("ok", "false", "boolean"),
    ]
    back = RS.to_rows(cells, ["a", "b.c", "ok"], "value", {"b.c": "bigint", "ok": "boolean"})
    assert rows(back) == [("f", 0, "x", 1, True), ("f", 1, "", 2, False)]


def test_write_back(spark):
    base = spark.createDataFrame(
        [(0, "a", "1", "number", False), (0, "b", "=x", "string", True), (1, "a", "k", "string", False)],
        "row_idx bigint, col_key string, value string, value_type string, is_formula boolean",
    )
    new = spark.createDataFrame(
        [(0, "a", None), (0, "b", "new"), (9, "a", "far")], "row_idx bigint, col_key string, value string"
    )
    kept = RS.write_back(base, new)
    assert rows(kept.select("row_idx", "col_key", "value", "is_formula")) == [
        (0, "a", "", False), (0, "b", "=x", True), (1, "a", "k", False),
    ]
    assert RS.write_back_counts(kept).collect()[0] == (0, 1)
    forced = RS.write_back(base, new, overwrite_formulas=True)
    assert rows(forced.select("row_idx", "col_key", "value", "is_formula"))[1] == (0, "b", "new", False)
    assert RS.write_back_counts(forced).collect()[0] == (1, 0)


def test_string_lines(spark):
    text = 'x\r\n<string name="a">白 %s</string>\r\n'
    df = spark.createDataFrame([("f", text)], "file string, text string")
    lines = SR.parse_string_lines(SR.split_string_lines(df, "text", ["file"]))
    got = lines.orderBy("line_no").collect()
    assert [(r.prefix, r.content, r.suffix, r.needs_translation) for r in got] == [
        ("", "x", "", False), ('<string name="a">', "白 %s", "</string>", True), ("", "", "", False),
    ]
    joined = SR.join_string_lines(lines, ["file"], "line").orderBy("block_no").collect()
    assert "".join(r.text for r in joined) == text + "\r\n"
    plain = SR.split_string_lines(spark.createDataFrame([("a\nb",)], "text string"))
    assert SR.join_string_lines(plain, line="line").collect()[0].text == "a\nb"


def test_xml_text(spark):
    xml = "<w:p><w:t xml:space='preserve'>a &amp;lt; &#20013;</w:t><t>last</t><w:t/><w:t>b</w:t><w:tab>no</w:tab></w:p>"
    df = spark.createDataFrame([(1, xml)], "id int, xml string")
    nodes = XT.xml_text_nodes(df, "xml")
    assert rows(nodes) == [(1, 0, "a &lt; 中"), (1, 1, ""), (1, 2, "b"), (1, 3, "last")]
    new = spark.createDataFrame([(1, 1, "x<y"), (1, 2, "z")], "id int, node_idx int, value string")
    out = XT.write_xml_text(df, "xml", "w:t", new, ["id"]).collect()[0].xml
    assert "<w:t>x&lt;y</w:t><w:t>z</w:t><w:tab>no</w:tab>" in out and "&#20013;" in out


def test_responses(spark):
    texts = [
        '```json\n[{"a":"1"}]\n```',
        '[{"a"：“1，2"}，{"a":"x"}]',
        '{"records":[{"a":"1"}]}',
        'Sure: [{"a":"[1]"}] ok',
        '[{"a":"1"}',
        "",
        "；（",
        '😀 [{"a":"1"}]',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "batch_id int, text string")
    got = {r.batch_id: r for r in RP.parse_responses(df).collect()}
    assert [got[i].records for i in range(4)] == [
        [{"a": "1"}], [{"a": "1，2"}, {"a": "x"}], [{"a": "1"}], [{"a": "[1]"}],
    ]
    assert [bool(got[i].error) for i in range(8)] == [False] * 4 + [True] * 3 + [False]
    assert got[7].records == [{"a": "1"}]
    assert "failed to parse model json" in got[4].error.lower()


def test_bodies(spark, values):
    bodies = [
        '{"choices":[{"message":{"content":"hi"}}]}',
        '{"choices":[{"message":{"content":[{"text":"a"},{"content":"b"},{}]}}]}',
        '{"data":[1]}',
        "[2]",
        '{"records":"no"}',
    ]
    assert values(RP.flatten_content, bodies) == ["hi", "a\nb\n", "[1]", "[2]", None]


def test_batches_partition_rows(spark):
    cells = spark.createDataFrame(
        [(i, k, f"白{i}") for i in range(23) for k in ("a", "b")], "row_idx bigint, col_key string, original string"
    )
    sent = B.sanitize_cells(cells, "English")
    for align in (True, False):
        made = B.make_request_batches(sent, 5, align).collect()
        assert sorted(i for b in made for i in b.rows) == list(range(23))
        assert [len(b.rows) for b in sorted(made)] == [5, 5, 5, 5, 3]
        assert sorted(made)[1].payload.startswith('[{"a":"白5","b":"白5"},')
    odd = sent.filter("row_idx % 2 = 1")
    assert [list(b.rows) for b in sorted(B.make_request_batches(odd, 5, True).collect())] == [
        [1, 3], [5, 7, 9], [11, 13], [15, 17, 19], [21],
    ]
    assert [len(b.rows) for b in sorted(B.make_request_batches(odd, 5, False).collect())] == [5, 5, 1]


def test_typed_payload(spark):
    cells = spark.createDataFrame(
        [(0, 0, "n", "1", "number"), (0, 1, "s", 'a"b', "string"), (0, 2, "t", "true", "boolean")],
        "row_idx bigint, col_idx int, col_key string, sanitized string, value_type string",
    )
    assert B.make_request_batches(cells, 5, True).collect()[0].payload == '[{"n":1,"s":"a\\"b","t":true}]'


def test_bisect_until_single_rows(spark):
    requests = spark.createDataFrame([("0", s, s) for s in range(5)], "batch_id string, seq int, row_idx int")
    seen = []
    for _ in range(4):
        status = requests.select("batch_id").distinct().withColumn("error", F.lit("x Invalid JSON y"))
        requests = B.bisect_failed_batches(requests, status)
        seen.append(rows(requests.select("batch_id", "seq", "row_idx")))
    assert seen[0] == [("0.0", 0, 0), ("0.0", 1, 1), ("0.0", 2, 2), ("0.1", 0, 3), ("0.1", 1, 4)]
    assert [r[2] for r in seen[2]] == [0, 1] and seen[3] == []
    other = spark.createDataFrame([("0", "timeout")], "batch_id string, error string")
    one = spark.createDataFrame([("0", 0, 0), ("0", 1, 1)], "batch_id string, seq int, row_idx int")
    assert B.bisect_failed_batches(one, other).count() == 0


def test_engine_choice(spark):
    df = spark.createDataFrame(
        [(1, "gemini", True, "g"), (1, "deepseek", True, "d"), (1, "openrouter", False, "o"), (2, "gemini", False, "x")],
        "batch_id int, engine string, ok boolean, text string",
    )
    assert rows(B.pick_engine(df)) == [(1, "deepseek", "d", False), (2, None, None, True)]
    assert rows(B.pick_engine(df, chosen="gemini")) == [(1, "gemini", "g", False), (2, None, None, True)]


def test_validation(spark):
    requests = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1)], "batch_id int, n_records int")
    responses = spark.createDataFrame(
        [(1, [{"a": "x"}], ""), (2, [{"a": "x"}], ""), (3, [None], "")],
        "batch_id int, records array<map<string,string>>, error string",
    )
    got = {r.batch_id: r.error for r in B.validate_responses(requests, responses).collect()}
    assert got[1] == "" and "1 records (expected 2)" in got[2] and "invalid" in got[3] and "0 records" in got[4]


def test_retry_uses_current_text(spark):
    cells = spark.createDataFrame(
        [(0, "n", "白细胞", "see 白细胞 BA-1"), (0, "id", "BA-9", "changed")],
        "row_idx bigint, col_key string, original string, translated string",
    )
    sent = MG.retry_payload(cells, cells).collect()
    assert [(r.col_key, r.sanitized) for r in sent] == [("n", "__TKN_0__ 白细胞 __TKN_1__")]
    answers = spark.createDataFrame(
        [(0, "n", "__TKN_0__ white __TKN_1__"), (0, "id", "other")], "row_idx bigint, col_key string, answer string"
    )
    merged = MG.merge_retries(cells, answers, cells)
    assert rows(merged.select("col_key", "translated")) == [("id", "changed"), ("n", "see white BA-1")]
    status = spark.createDataFrame([(0, False, True)], "row_idx bigint, done boolean, write_failed boolean")
    after = MG.retried_status(merged, cells.select("row_idx"), status, "English").collect()[0]
    assert (after.done, after.missing, after.write_failed) == (True, False, False)


def test_selective_preparation(spark):
    cells = spark.createDataFrame(
        [(0, "n", "the mild increase"), (1, "n", "白细胞升高"), (2, "n", "血小板")], "row_idx bigint, col_key string, original string"
    )
    done = spark.createDataFrame([(2,)], "row_idx bigint")
    assert [list(b.rows) for b in prepare(cells, "English", "selective", done).collect()] == [[1]]
    assert [list(b.rows) for b in prepare(cells, "English").collect()] == [[0, 1, 2]]


def test_progress_store(spark):
    path = scratch_path(spark, "test-progress")
    data = [("007", "English", 0, "{}"), ("007", "French", 0, "{}"), ("b/1", "English", 0, "{}")]
    PR.save_progress(spark.createDataFrame(data, "file_id string, target_lang string, row_idx bigint, record string"), path)
    assert PR.load_progress(spark, path, "007", "French").collect()[0].done is True
    again = spark.createDataFrame(
        [("007", "English", 0, "{1}", False), ("007", "English", 1, "{2}", True)],
        "file_id string, target_lang string, row_idx bigint, record string, done boolean",
    )
    PR.save_progress(again, path)
    assert PR.load_progress(spark, path).count() == 4
    snapshot = PR.load_progress(spark, path, "007", "English")
    every = spark.createDataFrame([(i,) for i in range(3)], "row_idx bigint")
    assert [r.done for r in PR.with_progress(every, snapshot).orderBy("row_idx").collect()] == [False, True, False]
    PR.clear_progress(spark, path, "007", "English")
    assert rows(PR.load_progress(spark, path).select("file_id", "target_lang")) == [("007", "French"), ("b/1", "English")]
    PR.clear_progress(spark, path, "b/1")
    assert PR.load_progress(spark, path).count() == 1


def test_history(spark):
    path = scratch_path(spark, "test-history")
    entry = [("a", 2000, "s", {"English": "e"}), ("b", 1000, None, {})]
    H.append_history(spark.createDataFrame(entry, H.SCHEMA), path)
    text = [r.text for r in H.export_history(H.load_history(spark, path)).orderBy("record_no").collect()]
    assert text[0].startswith("Record 1\nTimestamp: 1970-01-01 00:00:01\n\n[Original]\n\n\n[English]\n")
    assert text[1].startswith("=" * 80 + "\nRecord 2\n") and "[English]\ne\n\n[Spanish]" in text[1]
    H.clear_history(spark, path)
    assert H.load_history(spark, path).count() == 0


def test_rules(spark):
    df = spark.createDataFrame(
        [(0, "WBC↑、NEU↑", "提示感染", ""), (1, None, "危", None)], "row_idx bigint, `组合` string, `结论` string, id string"
    )
    rules = R.extract_rules(df)
    assert rows(rules.select("rule_id", "description", "severity")) == [
        ("rule-1", "WBC↑、NEU↑", "normal"), ("rule-2", "", "critical"),
    ]
    assert rows(R.template_matches(rules)) == [("rule-1", 0, "combo-wbc-neu-high")]
    assert R.missing_combinations(rules).count() == len(TEMPLATES) - 1
    assert tuple(R.rule_check_summary(rules).collect()[0]) == (2, len(TEMPLATES) - 1)
    # The direction of a condition does not matter unless operators are strict.
    low = R.extract_rules(df.withColumn("组合", F.lit("WBC↓、NEU↓")))
    assert R.template_matches(low).count() == 1
    assert R.template_matches(low, strict_operators=True).count() == 0
    assert R.missing_combinations(rules.limit(0)).count() == len(TEMPLATES)


def test_present_but_empty_stops_the_search(spark):
    df = spark.createDataFrame([(0, "", "条")], "row_idx bigint, Rule string, `条件` string")
    assert R.extract_rules(df).collect()[0].description == ""


def test_cross_check(spark):
    df = spark.createDataFrame([(0, "PLT↓", "")], "row_idx bigint, Rule string, Result string")
    answers = spark.createDataFrame(
        [("rule-1", "Deepseek", "正常"), ("rule-1", "OpenRouter", " 出血风险 "), ("rule-1", "OpenRouter", " ")],
        "rule_id string, model string, text string",
    )
    got = check_rules(df, answers=answers).findings.collect()[0]
    assert [c.model for c in got.conclusions] == ["Heuristic", "OpenRouter", "Deepseek"]
    assert got.conflicts == ["Deepseek 未强调出血风险"] and got.recommendation.startswith("检测到 1 个冲突")
    alone = X.cross_check(R.extract_rules(df)).collect()[0]
    assert alone.summary.startswith("Heuristic: 知识库：PLT 低于") and alone.conflicts == []


SHEET = ["row_idx", "AWBC#", "AWBC#_1", "AWBC#_2", "SRBC#", "SRBC#_1", "SRBC#_2", "总结1", "总结2", "解读"] + [
    f"可能疾病{i}{s}" for i in (1, 2, 3) for s in ("", "_1", "_2")
]


def test_sheet_update(spark):
    data = [(i, "↑", "", None, "↑", "", "", "", "旧。", "解", *([""] * 9)) for i in range(2)]
    schema = ", ".join(f"`{c}` {'bigint' if c == 'row_idx' else 'string'}" for c in SHEET)
    before = spark.createDataFrame(data, schema)
    after = U.update_sheet(before, "v1")
    header, row = after.orderBy("row_idx").collect()
    assert tuple(header) == data[0]
    assert row["AWBC#_1"].startswith("AWBC↑提示") and row["AWBC#_2"].startswith("AWBC为")
    assert row["总结1"].startswith("SRBC↑提示镰刀型红细胞存在") and "；AWBC↑提示" in row["总结1"]
    assert row["总结2"] == "SRBC↑提示镰刀型细胞贫血风险；AWBC↑提示异常白细胞风险；旧。"
    assert (row["可能疾病1"], row["可能疾病2"][:6]) == ("镰刀型细胞贫血/携带者状态", "血液系统异常")
    assert U.update_sheet(before, "v2").filter("row_idx = 1").collect()[0]["AWBC#_1"].startswith("检测到白细胞")
    allowed = [c for c in SHEET if c != "row_idx"]
    assert U.change_audit(before, after, allowed, allowed).count() == 0
    assert rows(U.change_audit(before, after, allowed[:-9], allowed).select("col_key"))[0] == ("可能疾病1",)


def test_white_cell_finding_is_inserted_again(spark):
    schema = ", ".join(f"`{c}` {'bigint' if c == 'row_idx' else 'string'}" for c in SHEET)
    before = spark.createDataFrame([(1, "↑", "", "", "-", "", "", "", "", "", *([""] * 9))], schema)
    twice = U.update_sheet(U.update_sheet(before)).collect()[0]
    assert twice["可能疾病1"] == twice["可能疾病2"] != ""


def test_quality_of_one_sided_cells(spark):
    orig = spark.createDataFrame([(0, "id", "BA-1"), (1, "n", "白"), (2, "n", "x")], "row_idx bigint, col_key string, value string")
    trans = spark.createDataFrame([(0, "id", "ba-1"), (1, "n", "白 ,"), (3, "m", "__ID_0__")], "row_idx bigint, col_key string, value string")
    issues = Q.quality_issues(orig, trans)
    assert rows(issues.select("row_idx", "type", "original")) == [
        (0, "idMismatch", "BA-1"), (1, "chinese", "白"), (1, "spacing", "白"), (3, "placeholder", ""),
    ]
    assert tuple(Q.quality_totals(orig, trans).collect()[0]) == (3, 3, 1, 1, 1, 1, 1, 1, 1, 1)
    typed = trans.withColumn("value_type", F.lit("number"))
    assert Q.quality_issues(orig, typed).count() == 0


def test_history_text_file(spark, tmp_path):
    entries = spark.createDataFrame(
        [("b", 2000, "second", {"English": "two"}), ("a", 1000, "first", {"English": "one"})],
        "id string, created_at bigint, source string, outputs map<string,string>",
    )
    out = str(tmp_path / "export")
    H.write_history_text(H.export_history(entries), out)
    text = "\n".join(r.value for r in spark.read.text(out, wholetext=False).collect())
    lines = text.split("\n")
    assert [x for x in lines if x.startswith("Record ")] == ["Record 1", "Record 2"]
    assert lines.count("=" * 80) == 1 and lines.index("first") < lines.index("second")


def test_answers_are_never_sent_to_the_driver(spark):
    """Their files are small, their rows many: no plan may broadcast them, whatever the files' size."""
    cells = spark.createDataFrame([(i, "k", f"白细胞 {i}") for i in range(20)], "row_idx long, col_key string, original string")
    batches = prepare(cells, "English")
    answers = batches.select("batch_id", F.col("payload").alias("text"))
    done = finish(cells, batches, answers, "English")
    checked = B.validate_responses(batches, RP.parse_responses(answers))
    for df in (
        MG.merge_translations(cells, B.answer_cells(checked), "English"),
        MG.merge_units(cells.withColumnRenamed("original", "value"), B.answer_cells(checked), "row_idx"),
        checked,
        done.status,
        MG.retried_status(done.cells, cells, done.status, "English"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert done.status.count() == 20


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_break_is_found_once_per_text(spark):
    """Above the explode, every line would search its whole text."""
    texts = spark.createDataFrame([(1, "a\r\nb\r\n"), (2, "a\nb"), (3, None)], "doc_id int, text string")
    got = SR.split_string_lines(texts, "text", ["doc_id"])
    plan = _optimized(got)
    assert plan.index("Generate") < plan.index("Contains(text")
    assert sorted(map(tuple, got.collect())) == [
        (1, "\r\n", 0, "a"), (1, "\r\n", 1, "b"), (1, "\r\n", 2, ""), (2, "\n", 0, "a"), (2, "\n", 1, "b"),
    ]


def test_repeated_lines_are_judged_once_and_counted_each(spark):
    texts = ["T 4 is bad", "el aumento de la glucosa con leve", "__FMT_0__ x", None, ""]
    lines = spark.createDataFrame(
        [(lang, t) for lang in ("English", "Spanish") for i, t in enumerate(texts) for _ in range(i + 1)],
        "lang string, content string",
    )
    got = Q.quality_by_lang(lines)
    assert _optimized(got).count("Aggregate [") == 2
    assert sorted(map(tuple, got.collect())) == [("English", 2, 3, 1), ("Spanish", 4, 3, 1)]
    one = Q.quality_by_lang(lines.filter("content is null and lang = 'English'"))
    assert [tuple(r) for r in one.collect()] == [("English", 0, 0, 0)]


def test_parts_of_odd_resource_lines(spark):
    cases = {
        '<string name="k">a</string></string> ': ('<string name="k">', "a</string>", "</string> "),
        "<string>$1\\n\n x</string>": ("<string>", "$1\\n\n x", "</string>"),
        "<string>open": ("", "<string>open", ""),
        "<strings>a</string>": ("", "<strings>a</string>", ""),
        "": ("", "", ""),
    }
    df = spark.createDataFrame([(c,) for c in cases], "line string")
    got = SR.parse_string_lines(df).select("line", "prefix", "content", "suffix").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == cases


def test_what_a_task_holds_of_a_sheet_does_not_grow(spark, monkeypatch):
    """Strips of rows over more tasks than the session's, against a plain grid."""
    rng = random.Random(3)
    rows_of = {"a": [7, 8, *rng.sample(range(9, 400), 60)], "b": [0, 200], "c": [5]}
    cells = {
        (d, r, c): (rng.choice(["", "x", "WBC"]), "string")
        for d, rs in rows_of.items() for r in rs for c in rng.sample(range(2, 6), 3)
    }
    raw = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "doc_id string, sheet_row bigint, col_idx int, value string, value_type string")
    before = rows(SH.parse_sheet(raw))
    monkeypatch.setattr(SH, "TASK_CELLS", 100)
    got = SH.parse_sheet(raw)
    assert got.rdd.getNumPartitions() > 10
    assert rows(got) == before
    expected = {}
    for d, rs in rows_of.items():
        used = [c for (e, _, c) in cells if e == d]
        for r in range(min(rs) + 1, max(rs) + 1):
            for c in range(min(used), max(used) + 1):
                expected[(d, r - min(rs) - 1, c)] = cells.get((d, r, c), ("",))[0]
    assert {(r.doc_id, r.row_idx, r.col_idx): r.value for r in got.collect()} == expected
    assert got.count() == len(expected)
