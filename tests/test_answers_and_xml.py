"""Repeated answers, split batches, repair of model JSON, nested XML."""

import itertools
import json
import os
import random
import re
import shutil
import subprocess
import sys
from xml.dom import minidom

import pytest
from pyspark.sql import functions as F

from sheetqa.operators import batches as B
from sheetqa.operators import splits as SP
from sheetqa.operators.answers import append_answers, newest
from sheetqa.sources import responses as RP
from sheetqa.sources import xml_text as XT
from sheetqa.store import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_newest_valid_answer_wins_whole(spark):
    given = [
        (1, 1, 50, '[{"a":"1"},{"b":"1"}]'), (1, 2, 10, '[{"a":"2"},{"b":"2"}]'), (1, 3, 60, '[{"a":"3"'), (1, 2, 9, '[{"a":"x"},{"b":"x"}]'),
        (2, 1, 1, '[{"a":"1"}]'), (2, None, 99, '[{"a":"old"},{"b":"old"}]'), (3, 1, 1, "no"), (3, 2, 1, ""), (5, 1, 1, "[]"),
    ]
    wanted = spark.createDataFrame([(i, 2) for i in range(1, 5)], "batch_id int, n_records int")
    rng = random.Random(1)
    for _ in range(3):
        rng.shuffle(given)
        answers = spark.createDataFrame(given, "batch_id int, attempt int, arrived long, text string").repartition(3)
        got = {r.batch_id: r for r in B.validate_responses(wanted, RP.parse_responses(answers)).collect()}
        assert sorted(got) == [1, 2, 3, 4]
        assert got[1].records == [{"a": "2"}, {"b": "2"}] and got[1].ok and got[1].arrived == 10
        assert got[2].records == [{"a": "old"}, {"b": "old"}] and got[2].ok
        assert not got[3].ok and got[3].error == "API returned empty response." and got[3].attempt == 2
        assert got[4].error == "Translation returned 0 records (expected 2)."


def test_answers_without_versions_are_told_apart_by_content(spark):
    rows = [(1, "b"), (1, "a"), (None, "c"), (None, "d"), (2, None)]
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 17):
        df = spark.createDataFrame(list(order), "k int, text string")
        assert {(r.k, r.text) for r in newest(df, ["k"]).collect()} == {(1, "b"), (None, "d"), (2, None)}
    assert newest(spark.createDataFrame([], "k int, text string"), ["k"]).count() == 0


def test_answer_log(spark):
    path = scratch_path(spark, "answer-log")
    append_answers(spark.createDataFrame([(1, 1, "[{}]")], "batch_id int, attempt int, text string"), path)
    append_answers(spark.createDataFrame([(1, 2, "[]")], "batch_id int, attempt int, text string"), path)
    log = spark.read.parquet(path)
    assert log.count() == 2 and log.where("arrived > 0").count() == 2
    wanted = spark.createDataFrame([(1, 1)], "batch_id int, n_records int")
    assert B.validate_responses(wanted, RP.parse_responses(log)).first().attempt == 1


def test_rounds_of_splits_until_nothing_is_pending(spark):
    """A model that cannot answer more than two records at once, and never the record ``x``."""
    contents = {1: "abcde", 2: "ab", 3: "abcxefg", 4: "a"}
    cells = [(i * 10 + k, i, c) for i, text in contents.items() for k, c in enumerate(text)]
    rows = spark.createDataFrame(cells, "row_idx long, batch_id long, sanitized string")
    record = F.to_json(F.struct(F.col("sanitized").alias("content")))
    batches = B._payloads(rows.select("batch_id", "row_idx", record.alias("record")))

    def model(requests):
        out = []
        for r in requests.select("batch_id", "payload").collect():
            items = json.loads(r.payload)
            broken = len(items) > 2 or any(x["content"] == "x" for x in items)
            out.append((str(r.batch_id), "[{" if broken else json.dumps([{"content": x["content"].upper()} for x in items])))
        return out

    log = model(batches)
    for rounds in range(10):
        answers = spark.createDataFrame(log, "batch_id string, text string")
        leaves = SP.split_rounds(batches, answers)
        todo = SP.pending_splits(leaves)
        if todo.isEmpty():
            break
        log += model(todo)
    assert rounds == 3
    got = {r.batch_id: r for r in SP.roll_up(leaves).collect()}
    assert {k: r.ok for k, r in got.items()} == {"1": True, "2": True, "3": False, "4": True}
    for k in ("1", "2", "4"):
        assert "".join(x["content"] for x in got[k].records) == contents[int(k)].upper()
        assert got[k].rows == [int(k) * 10 + i for i in range(len(contents[int(k)]))]
    assert got["3"].records is None and got["3"].error == "Failed to parse model JSON" and got["3"].n_records == 7
    nodes = {r.batch_id: r for r in SP.roll_up(leaves, roots_only=False).collect()}
    assert nodes["3.1"].ok and [x["content"] for x in nodes["3.1"].records] == ["E", "F", "G"]
    assert not nodes["3.0"].ok and nodes["3.0.0"].ok and not nodes["3.0.1.1"].ok


def test_repair_of_model_json(values):
    table = {
        '[{"a"：“1，2"}，{"a":"x"}]': '[{"a":"1，2"},{"a":"x"}]',
        'Sure: [{"a":"[1]"}] ok [2]': '[{"a":"[1]"}]',
        "no array；（": "no array;(",
        '［1，［2］］ rest': "[1,[2]]",
        '[1,[2]': "[1,[2]",
        '"[" [“]"] ]': '["]"]',
        r'["a\"]b", "c\\"]]': r'["a\"]b", "c\\"]',
        '] [1] [2]': '] [1] [2]',
        '["open [1]': '["open [1]',
        '["ends \\': '["ends \\',
        "": "",
        "『a" + '"' + "［3］": "[3]",
        "[" + "1," * 5000 + '"' + "\\n" * 5000 + '"]x': "[" + "1," * 5000 + '"' + "\\n" * 5000 + '"]',
    }
    assert values(RP.repair_json, list(table)) == list(table.values())


def test_no_python_parses_answers(spark):
    df = spark.createDataFrame([(1, "[")], "batch_id int, text string")
    assert "Python" not in RP.parse_responses(df)._jdf.queryExecution().executedPlan().toString()


def _nested(rng, depth=0):
    """Well-formed content with elements t and u, which nest in themselves and each other."""
    out = []
    for _ in range(rng.randint(0, 3)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            out.append(rng.choice(["a", "é ", "&amp;", "&#65;", "x\n", "﷐0﷑", "&#xFDD0;0﷑", "😀"]))
        elif kind < 0.5:
            out.append(rng.choice(["<!-- <t>no</t> -->", "<![CDATA[<t>]]>", "<t/>", '<u k="/>"/>', "<tu>q</tu>"]))
        else:
            tag = rng.choice("tu")
            out.append(f"<{tag}{rng.choice(['', ' k=' + chr(34) + 'p>q' + chr(34)])}>{_nested(rng, depth + 1)}</{tag}>")
    return "".join(out)


def _text(node):
    if node.nodeType in (node.TEXT_NODE, node.CDATA_SECTION_NODE):
        return node.data
    return "".join(map(_text, node.childNodes)) if node.nodeType == node.ELEMENT_NODE else ""


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(3)
    fixed = ["<t>a<t>b</t>c</t><t>d</t>", "", "plain", "<t></t>", "<t>" * 200 + "deep" + "</t>" * 200, "<t>x</t>" * 1000]
    return [f"<r>{x}</r>" for x in fixed + [_nested(rng) for _ in range(150)]]


def test_nested_elements_equal_a_parser(spark, documents):
    df = spark.createDataFrame(list(enumerate(documents)), "id int, xml string")
    got = {}
    for r in XT.xml_text_nodes(df, "xml", ["t", "u"]).orderBy("id", "node_idx").collect():
        assert r.node_idx == len(got.setdefault(r.id, []))
        got[r.id].append(r.value)
    for i, xml in enumerate(documents):
        dom = minidom.parseString(xml)
        assert got.get(i, []) == [_text(n) for tag in "tu" for n in dom.getElementsByTagName(tag)], xml


def test_written_nested_elements_equal_a_parser(spark, documents):
    rng = random.Random(4)
    df = spark.createDataFrame(list(enumerate(documents)), "id int, xml string")
    new = []
    expected = {}
    for i, xml in enumerate(documents):
        dom = minidom.parseString(xml)
        nodes = [n for tag in "tu" for n in dom.getElementsByTagName(tag)]
        chosen = [k for k in range(len(nodes)) if rng.random() < 0.5]
        new += [(i, k, f"<{k}> & ﷐1﷑") for k in chosen] + [(i, 10**6, "beyond"), (i, 0, None)]
        for k in chosen:
            for child in list(nodes[k].childNodes):
                nodes[k].removeChild(child)
            nodes[k].appendChild(dom.createTextNode(f"<{k}> & ﷐1﷑"))
        expected[i] = _text(dom.documentElement), [n.tagName for n in dom.getElementsByTagName("*")]
    texts = spark.createDataFrame(new, "id int, node_idx int, value string")
    for r in XT.write_xml_text(df, "xml", ["t", "u"], texts, ["id"]).collect():
        dom = minidom.parseString(r.xml)
        assert (_text(dom.documentElement), [n.tagName for n in dom.getElementsByTagName("*")]) == expected[r.id], documents[r.id]


def test_tags_that_do_not_balance(spark):
    texts = {"<p>a<p>b</p>c": ["ab"], "x</p><p>a</p>": ["a"], "<p>a<p/>b</p><p>": ["ab"], "</p>": [], "<p>": [], "<p/></p>": [""]}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, xml string")
    got = {}
    for r in XT.xml_text_nodes(df, "xml", "p").orderBy("id", "node_idx").collect():
        got.setdefault(r.id, []).append(r.value)
    assert [got.get(i, []) for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize("absent", ["folders", "package"])
def test_entry_without_training_data_operators(tmp_path, absent):
    """Neither the folders nor the packages of the optional operators are needed by the rest."""
    hidden = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py") if absent == "folders" else shutil.ignore_patterns(".git")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=hidden)
    if absent == "package":
        (tmp_path / "repo" / "xxhash.py").write_text("raise ImportError")
    code = "from __spark_entry__ import queries, oracle_sql; q = queries(); print(len(q), len(oracle_sql()), sum(n.startswith('op') for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert re.fullmatch(r"(\d+) \1 0", out.stdout.strip()), (out.stdout, out.stderr)


def test_texts_written_back_as_read_change_nothing(spark):
    documents = [
        '<t>a &quot;b&quot; &amp;amp; &#65;&apos;</t><t>ver&amp</t>', "<t/><t></t><t >x</t >", "<t><![CDATA[<b>]]>c<!-- d --></t>", "<t>﷐1﷑ &gt; ></t>", "<u>none</u>", None,
    ]
    df = spark.createDataFrame(list(enumerate(documents)), "id int, xml string")
    nodes = XT.xml_text_nodes(df, "xml", "t", ["id"])
    assert [r.xml for r in XT.write_xml_text(df, "xml", "t", nodes, ["id"]).orderBy("id").collect()] == documents
    # A neighbour that changes is escaped, tags that a node holds go as before.
    mixed = spark.createDataFrame([(0, "<t>&quot;</t><t>&quot;</t><t>a<u>b</u></t>")], "id int, xml string")
    new = spark.createDataFrame([(0, 0, '"'), (0, 1, '"<'), (0, 2, "ab")], "id int, node_idx int, value string")
    assert XT.write_xml_text(mixed, "xml", "t", new, ["id"]).first().xml == '<t>&quot;</t><t>"&lt;</t><t>ab</t>'


def test_a_round_of_splits_reads_its_own_level_only(spark, monkeypatch):
    """Of answers of all levels each is parsed at most once, and only where something waits for it."""
    rows = spark.createDataFrame([(i, i // 4, f'{{"content":"{i}"}}') for i in range(12)], "row_idx long, batch_id long, record string")
    batches = B._payloads(rows).withColumn("batch_id", F.concat(F.lit("a.x"), "batch_id"))
    level, sent = batches, None
    for depth in range(3):
        good = (F.lit(depth) >= F.substring("batch_id", 4, 1).cast("int")) & ~F.col("batch_id").startswith("a.x9")
        some = level.select("batch_id", F.when(good, F.col("payload")).otherwise("[{").alias("text"))
        sent, level = some if sent is None else sent.unionByName(some), SP.halves(level)
    parsed, parse = [], SP.parse_responses

    def counting(df, *args):
        parsed.extend(r.batch_id for r in df.select("batch_id").collect())
        return parse(df, *args)

    monkeypatch.setattr(SP, "parse_responses", counting)
    got = SP.resolve_splits(batches, sent).orderBy("batch_id").collect()
    assert [(r.ok, r.n_leaves, [x["content"] for x in r.records]) for r in got] == [
        (True, n, [str(i) for i in range(4 * k, 4 * k + 4)]) for k, n in enumerate((1, 2, 4))
    ]
    assert sorted(parsed) == ["a.x0", "a.x1", "a.x1.0", "a.x1.1", "a.x2", "a.x2.0", "a.x2.0.0", "a.x2.0.1", "a.x2.1", "a.x2.1.0", "a.x2.1.1"]
    none = SP.resolve_splits(batches, sent.limit(0)).collect()
    assert len(none) == 3 and not any(r.ok for r in none)
