"""Trained operators: held-out accuracy, awkward rows; the pipeline stage by stage."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from sheetqa.llm import ngram_ratio, personal_data, positive_unlabelled, subword_toxicity
from sheetqa.llm.common import documents, labels

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, f"plain text number {'abcdefghij'[i % 10]} of words and more words", "en", "s", 1, 0.1, 7) for i in range(40)]
    rows += [(None, "no id", None, None, None, None, None), (50, None, None, None, None, None, None)]
    rows += [(51, "", "", "", 0, 0.0, 0), (52, " \n", None, None, None, None, None), (53, "x" * 100_000, None, None, None, None, None)]
    rows += [rows[3], rows[3], (54, "$$ ## " * 30, "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)]
    return spark.createDataFrame(rows, LABELS)


OPERATORS = [positive_unlabelled.classify, subword_toxicity.classify, ngram_ratio.judge]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__module__.rsplit(".", 1)[1])
def test_awkward_rows_and_missing_labels(spark, odd, odd_labels, operator):
    ids = Counter(r.doc_id for r in odd.select("doc_id").collect())
    for given in (odd_labels, odd_labels.limit(0)):
        out = operator(odd, given).collect()
        assert Counter(r.doc_id for r in out) == ids
    assert operator(odd.limit(0), odd_labels).count() == 0
    kept = [r.score for r in out] if "score" in out[0] else [r.ratio for r in out]
    assert all(np.isfinite(kept))


@pytest.mark.parametrize("name, truth, least", [("op4_positive_unlabelled", "quality", 0.98), ("op6_subword_toxicity", "toxic", 0.95)])
def test_held_out_accuracy(spark, name, truth, least):
    """On 10,000 documents; a tenth of that leaves the fit some two hundred positives."""
    out = queries()[name](spark, LARGE).join(labels(spark, LARGE), "doc_id").where("held_out").collect()
    assert len(out) > 500 and np.mean([r.predicted == r[truth] for r in out]) >= least
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_scores_do_not_depend_on_ids(spark):
    """Labels and ids reach the model only through its training rows."""
    docs, known = documents(spark, SF), labels(spark, SF)
    twice = docs.select("doc_id", "text").union(docs.select(F.col("doc_id") + 10**9, "text"))
    out = positive_unlabelled.classify(twice, known).withColumn("doc_id", F.col("doc_id") % 10**9)
    spread = out.groupBy("doc_id").agg((F.max("score") - F.min("score")).alias("d")).agg(F.max("d")).first()[0]
    assert spread == 0


def test_prior_is_found_where_classes_stand_apart():
    rng = np.random.default_rng(0)
    positive = rng.normal(0, 1, (1500, 4))
    mixed = np.concatenate([rng.normal(0, 1, (1400, 4)), rng.normal(5, 1, (600, 4))])
    assert positive_unlabelled.estimate_prior(positive, mixed) == pytest.approx(0.7, abs=0.06)
    model = positive_unlabelled.fit(positive, mixed, 0.7)
    assert (model.score(rng.normal(0, 1, (500, 4))) > 0.5).mean() > 0.97
    assert (model.score(rng.normal(5, 1, (500, 4))) < 0.5).mean() > 0.97


def test_misspellings_share_subwords():
    rng = random.Random(3)
    syllables = ["lo", "ma", "ti", "re", "su", "ne", "ka", "vo", "pi", "du"]

    def text(extra):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        return " ".join(words[:30] + extra + words[30:])

    texts = [text(["grumblesnatch"] if i % 2 else []) for i in range(240)]
    model = subword_toxicity.fit(texts, [i % 2 for i in range(240)])
    scorer = subword_toxicity.Scorer(model)
    for word in ("grumblesnatch", "grumblesnatches", "grumblsnatch", "GRUMBLESNATCH!!"):
        assert scorer.margin(text([word])) > 0, word
    assert np.mean([scorer.margin(text([])) < 0 for _ in range(50)]) > 0.9
    assert subword_toxicity.fit(texts, [1] * 240) is None


def test_verdict_keeps_good_and_drops_junk(spark):
    out = queries()["op5_ngram_ratio"](spark, SF).join(labels(spark, SF), "doc_id").collect()
    by_quality = defaultdict(list)
    for r in out:
        assert not (r.kept and r.base_failed)
        if not r.base_failed:
            by_quality[r.quality].append(r.kept)
    assert np.mean(by_quality[1]) > 0.98 and np.mean(by_quality[0]) < 0.1


def test_all_trusted_texts_count_however_many_are_labelled(spark):
    rng = random.Random(4)
    texts = [" ".join(f"{'gb'[i % 2]}{rng.randrange(400)}" for _ in range(80)) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    few = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], LABELS)
    more = few.union(spark.range(1000, 61_000).selectExpr("id", "1", "0"))
    want, got = (Counter(ngram_ratio.judge(docs, known).select("doc_id", F.round("ratio", 9), "kept").collect()) for known in (few, more))
    assert got == want and 100 < sum(r.kept for r in want) < 200


@pytest.mark.parametrize("name", ["op3_water_filling", "op7_revisits"])
def test_queries_with_sql(spark, name):
    assert compare(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) == ""


def test_pipeline_stages(spark):
    docs = documents(spark, SF)
    good = corpus_pipeline.good_quality(spark, docs, SF).cache()
    judged = positive_unlabelled.classify(docs, labels(spark, SF))
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in judged.where("predicted = 1").collect())
    assert good.columns == docs.columns

    single = corpus_pipeline.without_near_copies(spark, good, SF).cache()
    texts = {r.doc_id: r.text for r in good.collect()}
    kept = {r.doc_id for r in single.collect()}
    shingles = {}
    for i, text in texts.items():
        w = text.encode().lower().split()  # the words of the stage
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def alike(i, j):
        return len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])

    listed = sorted(texts)
    for n, i in enumerate(listed):
        for j in listed[n + 1 :]:
            if texts[i] == texts[j] or alike(i, j) >= 0.8:
                assert j not in kept
    for i in set(texts) - kept:
        assert max(alike(i, j) for j in texts if j != i) >= 0.8

    clean = corpus_pipeline.without_personal_data(spark, single, SF).cache()
    assert clean.count() == single.count()
    spans = {r.doc_id: r.spans for r in personal_data.all_spans(single).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        assert (r.text == before[r.doc_id]) == (not spans[r.doc_id])
        assert not personal_data.base_spans(r.text)

    mix = corpus_pipeline.mixed(spark, clean, SF).cache()
    total = sum(len(r.text.split()) for r in clean.collect())
    assert abs(sum(len(r.text.split()) for r in mix.collect()) - total) <= 20
    assert mix.columns == docs.columns

    last = corpus_pipeline.encoded(spark, mix, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in mix.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == mix.count() and whole.columns == last.columns


def test_near_dedup_with_missing_and_repeated_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[2]), (5, texts[3]), (4, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(
        [(None, texts[0]), (None, texts[1]), (1, texts[2]), (4, texts[3])]
    )


def test_near_dedup_keeps_rows_that_differ_in_which_column_is_missing(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, one, "en", None, 5), (1, two, None, "en", 5), (2, one, "en", None, 5), (1, one, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    assert Counter(map(tuple, got)) == Counter(rows[:2])


def test_near_dedup_per_class_not_per_id(spark):
    """Different texts under one id are different documents; near copies without ids are one."""
    base = [[f"{c}{i}" for i in range(60)] for c in "abcd"]
    near = [" ".join([*b[:-1], "other"]) for b in base]
    a, b, c, d = map(" ".join, base)
    rows = [(5, a), (5, b), (7, near[1]), (5, c), (None, d), (None, near[3])]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_near_copies(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({5: 3, None: 1})
    assert {r.text for r in got if r.doc_id == 5} == {a, b, c}


def test_pipeline_on_awkward_rows(spark, odd, odd_labels, tmp_path):
    odd_labels.write.parquet(os.path.join(tmp_path, "labels.parquet"))
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
        now.collect()
