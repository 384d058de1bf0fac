"""Operators with exact results against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheetqa.llm import hash_tree, mixing, ngram_ratio, personal_data, revisits, sentencepiece_bpe, simhash, spotsigs
from sheetqa.llm.common import hash_filter, may_be_among
from sheetqa.llm.components import connected_components
from sheetqa.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double"
SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def rows():
    """Documents with NULLs, empty and very long texts, copies, repeated rows and clashing columns."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of", "und", "école", "日本", "😀", "x y"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(n))

    texts = [text(rng.randint(0, 120)) for _ in range(40)] + [None, "", " ", "\n\n", "one", "two words"]
    texts += [texts[3]] * 12 + [texts[4] + "end", texts[4], text(30_000), "a" * 200_000]
    sources = ["a", "b", "", None, "é", "z", "a"]
    out = [(i * 7 - 50, t, "en", sources[i % 7] if i % 3 else "a", None) for i, t in enumerate(texts)]
    out += [(None, "no id", None, None, 5), (None, None, None, None, None), out[5], out[5]]
    return [(*r, 1, 2, 0.5) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def draw(key, path):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    h = xxhash.xxh64_intdigest(path.encode(), seed)
    return -math.log(((h >> 11) + 1) * 2.0**-53)


def descend(key, tree):
    nodes, at = hash_tree.children(tree), ""
    while at in nodes:
        at = min((draw(key, path) / weight, path) for path, weight in nodes[at])[1]
    return int(at.rsplit("/", 1)[1])


def test_hash_tree_against_brute_force(docs, none, rows):
    small, large = hash_tree.shard_tree(40), hash_tree.shard_tree(41)
    out = hash_tree.shard_documents(docs, small, large).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots = defaultdict(list)
    for r in out:
        assert r.shard == descend(r.doc_id, small) and r.grown_shard == descend(r.doc_id, large)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.shard_documents(none, small, large).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    trees = [hash_tree.shard_tree(n) for n in (40, 41, 42, 43)]
    for old, new in zip(trees, trees[1:]):
        moved = hash_tree.place(hash_tree.place(ids, "doc_id", old, "a"), "doc_id", new, "b").where("a <> b")
        got = {r.b for r in moved.select("b").distinct().collect()}
        assert got == {len(new) - 1} and 250 < moved.count() < 750


def test_a_changed_weight_moves_rows_only_through_its_subtrees(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    old = hash_tree.shard_tree(40)
    new = [hash_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 7 else 1.0) for s in old]
    moved = hash_tree.place(hash_tree.place(ids, "doc_id", old, "a"), "doc_id", new, "b").where("a <> b")
    # Shards 0 to 9 are the changed region, 5 to 9 the changed rack: all moves end there.
    assert moved.where("b >= 10").count() == 0 and moved.where("a < 10 and b < 5").count() == 0
    with pytest.raises(ValueError):
        hash_tree.children([hash_tree.Shard("r", "k", 0, 0.0)])


def test_mix_against_brute_force(docs, none, rows):
    out = mixing.mix_documents(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: left * weight[s] / total for s in open_}
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        whole = math.floor(r.target / r.source_size) if r.source_size else 0
        assert whole * r.size <= r.taken <= (whole + 1) * r.size
        taken[r.source] += r.taken
    assert Counter(r.size for r in out) == Counter(len(words(r[1])) for r in rows)
    assert all(taken[s] == round(target[s]) for s in order)
    again = mixing.mix_documents(docs.repartition(5)).select("doc_id", "size", "taken")
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.size, r.taken) for r in out)
    assert mixing.mix_documents(none).count() == 0


def test_mix_repeats_words(docs):
    mix = mixing.mix_documents(docs, carry=("text", "lang"))
    repeated = mixing.repeated(mix).collect()
    assert sum(len(words(r.text)) for r in repeated) == mix.agg(F.sum("taken")).first()[0]


def brute_print(text, n=4):
    tokens = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_against_brute_force(docs, none, rows):
    out = simhash.near_duplicates(docs, carry=("size",)).collect()
    prints = [(r[0], brute_print(r[1])) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{p:016x}") for i, p in prints)
    parent = {p: p for _, p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for _, p in prints:
        for _, q in prints:
            if (p ^ q).bit_count() <= 4:
                parent[find(p)] = find(q)
    least = defaultdict(list)
    for i, p in prints:
        least[find(p)] += [i] if i is not None else []
    expected = {f"{p:016x}": min(least[find(p)], default=None) for _, p in prints}
    assert all(r.component_id == expected[r.fingerprint] for r in out)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_links_connect_what_all_pairs_connect(spark, chunk):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):  # clusters that chain, far from each other
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "print long"), chunk=chunk)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    group = {p: p for p in prints}
    for _ in range(len(prints)):
        before = dict(group)
        for p in prints:
            group[p] = min(group[q] for q in prints if (p ^ q).bit_count() <= 4)
        if group == before:
            break
    by_root = defaultdict(set)
    for (s,), p in zip(signed, prints):
        by_root[roots.get(s, s)].add(p)
    by_group = defaultdict(set)
    for p in prints:
        by_group[group[p]].add(p)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))


def test_similar_documents_with_changed_words(spark, docs, none, rows):
    rng = random.Random(8)
    texts = []
    for _ in range(15):
        base = [f"v{rng.randrange(3000)}" for _ in range(240)]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for k in rng.sample(range(240), 3):  # at most 15 of 236 shingles change
                copy[k] = f"v{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == {i: i // 4 * 4 for i in range(len(texts))}
    everything = simhash.similar_documents(docs, carry=("size",)).collect()
    assert Counter(r.doc_id for r in everything) == Counter(r[0] for r in rows)
    assert simhash.similar_documents(none).count() == 0


def _shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _tail_changed(rng, n, likeness):
    """Two texts of ``n`` shingles each: the lowest Jaccard coefficient from ``likeness`` up."""
    w = [f"t{rng.randrange(10**9)}" for _ in range(n + 4)]
    k = max(k for k in range(n) if (n - k) / (n + k) >= likeness)
    return " ".join(w), " ".join([*w[: n + 4 - k], *(f"u{rng.randrange(10**9)}" for _ in range(k))])


def test_similar_documents_lose_no_isolated_pair(spark):
    rng = random.Random(17)
    texts = []
    for i in range(300):
        pair = _tail_changed(rng, rng.randint(9, 240), (0.8, 0.8, 0.82, 0.85)[i % 4])
        assert len(_shingles(pair[0]) & _shingles(pair[1])) / len(_shingles(pair[0]) | _shingles(pair[1])) >= 0.8
        texts += pair
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(texts))}


def test_similar_documents_link_by_real_likeness_only(spark):
    rng = random.Random(23)
    texts = [t for i in range(300) for t in _tail_changed(rng, 240, (0.7, 0.74, 0.77)[i % 3])]
    line = " ".join(f"line{k}" for k in range(12)) + " "
    texts += [line * 40 + " ".join(f"x{i}.{k}" for k in range(30)) for i in range(20)]  # one line dominates
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == {i: i for i in range(len(texts))}


def test_similar_documents_against_brute_force(spark):
    """Chains and hubs, where rejected candidates must not hide links."""
    rng = random.Random(29)
    texts = []
    for _ in range(12):
        w = [f"c{rng.randrange(10**6)}" for _ in range(80)]
        for _ in range(15):
            texts.append(" ".join(w))
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(80)] = f"c{rng.randrange(10**6)}"
    sets = [_shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table).collect()}
    assert got == dict(enumerate(group)) and len(set(group)) > 12


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (2, 1)]
    random.Random(1).shuffle(edges)
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def tables():
    path = tokenizer_path()
    return sentencepiece_bpe.table(path), sentencepiece.SentencePieceProcessor(model_file=path)


ALPHABET = ["a", "the", " the", "ing", " ", "  ", "\n", "▁", "é", "日", "😀", "\x00", "==", "1", ".", "<s>", "<0x41>", "\r", "ا", "á"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(ALPHABET), max_size=15).map("".join)))
def test_encoding_and_decoding_equal_the_library(tables, text):
    own, library = tables
    ids = own.encode(text)
    assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31_999)), max_size=12))
def test_decoding_any_ids(tables, ids):
    assert tables[0].decode(ids) == tables[1].decode(ids)


def test_round_trip_digests(docs, none, rows, tables):
    coded = docs.select("doc_id", sentencepiece_bpe.round_trip(F.col("text"), tokenizer_path()).alias("c"))
    expected = Counter()
    for r in rows:
        ids = tables[1].encode(r[1] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected[r[0], len(ids), digest, hashlib.sha256(tables[1].decode(ids).encode()).hexdigest()] += 1
    assert Counter(map(tuple, coded.select("doc_id", "c.*").collect())) == expected
    ids = sentencepiece_bpe.encode(F.col("text"), tokenizer_path())
    back = docs.select("text", sentencepiece_bpe.decode(ids, tokenizer_path()).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)
    assert none.select(sentencepiece_bpe.encode(F.col("text"), tokenizer_path())).count() == 0


def test_rule_figures_against_brute_force(docs, rows):
    extra = [
        ("a b c a b c d", 6), ("a a a a", 4), ("a b c d", 0), ("a b", 0), ("x y z x y z x", 7), ("p q r s p q r t u", 6),
    ]
    got = ngram_ratio.rule_figures(docs).collect()

    def figures(text):
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
        n, repeat = len(w), len(hit)
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        return n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((r[0], *figures(r[1])) for r in rows)
    spark = docs.sparkSession
    odd = ngram_ratio.rule_figures(spark.createDataFrame(extra, "text string, want long")).collect()
    assert all(r.n_repeat_words == r.want for r in odd)


def test_ratios_are_those_of_two_multinomials(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, None), (None, "b b"), (4, "!!")], "doc_id long, text string")
    good = spark.createDataFrame([(1,)], "doc_id long")
    table = ngram_ratio.ratios(docs, good, buckets=64).first().ratio
    grams = {r.doc_id: list(r.g) for r in docs.select("doc_id", ngram_ratio.ngrams(F.col("text"), 64).alias("g")).collect()}
    raw, trusted = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    assert [len(grams[k]) for k in (1, 2, 3, None, 4)] == [5, 3, 0, 3, 1]
    for b in range(64):
        expected = math.log((trusted[b] + 1) / (5 + 64)) - math.log((raw[b] + 1) / (12 + 64))
        assert table[b] == pytest.approx(expected)
    scored = docs.select("doc_id", ngram_ratio.score(F.col("text"), F.lit(table), 64).alias("s")).collect()
    for r in scored:
        g = grams[r.doc_id]
        assert r.s == pytest.approx(sum(table[b] for b in g) / len(g) if g else 0.0)


def test_kept_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(f"{'ab'[rng.random() < 0.4]}{rng.randrange(30)}" for _ in range(rng.randint(40, 90))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame([(i % 110 if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(0, 110, 2)] + [(3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = {i for i in range(0, 110, 2) if i % 3 == 0} | {3}
    for tail in (0.001, 0.2):
        out = ngram_ratio.judge(docs, known, tail).collect()
        passing = sorted(math.floor(r.ratio * 2**40) for r in out if r.doc_id in good and not r.base_failed)
        least = passing[max(1, math.ceil(tail * len(passing))) - 1]
        assert all(r.kept == (not r.base_failed and math.floor(r.ratio * 2**40) >= least) for r in out)
        grams = docs.select(ngram_ratio.ngrams(F.col("text")).alias("g"), "doc_id").collect()
        raw, trusted = Counter(b for r in grams for b in r.g), Counter(b for r in grams if r.doc_id in good for b in r.g)
        size, total, own = ngram_ratio.BUCKETS, sum(raw.values()), sum(trusted.values())
        weight = {b: math.log((trusted[b] + 1) / (own + size)) - math.log((raw[b] + 1) / (total + size)) for b in raw}
        expected = Counter((r.doc_id, round(sum(weight[b] for b in r.g) / len(r.g) if r.g else 0.0, 9)) for r in grams)
        assert Counter((r.doc_id, round(r.ratio, 9)) for r in out) == expected


def test_lists_of_ngrams_are_not_shuffled(spark):
    """More trusted ids than are broadcast: flags come to the rows, no list of n-grams moves."""
    docs = spark.range(70_000).selectExpr("if(id % 7 = 0, null, id % 60000) as doc_id", "concat('w', id, ' of ', id % 100) as text")
    good = spark.range(0, 6_000_000, 3).toDF("doc_id")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"))
    table = ngram_ratio.ratios(docs, good)
    assert len(table.first().ratio) == ngram_ratio.BUCKETS
    plan = table._jdf.queryExecution().explainString(table._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not any("grams" in columns for columns in moved)
    assert all(r.good == (r.doc_id is not None and r.doc_id % 3 == 0) for r in ngram_ratio.marked(rows, good).collect())


def test_kth_smallest(spark):
    rng = random.Random(1)
    values = [rng.choice([0, 1, 65_535, 65_536, 2**48 - 1, rng.randrange(2**48)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 57, 150, 299, 300):
        assert ngram_ratio.kth_smallest(df, k) == sorted(values)[k - 1]


def test_hash_filter_lets_all_given_hashes_through(spark):
    for bits, n in ((14, 5), (16, 3000), (23, 1000)):
        df = spark.range(n).select(F.xxhash64("id").alias("h"))
        table = hash_filter(df, bits).scalar()
        among = spark.range(2 * n).select(may_be_among(F.xxhash64("id"), table, bits).alias("m"), "id").collect()
        assert all(r.m for r in among if r.id < n)
        if bits == 23:
            assert sum(r.m for r in among) < 1.1 * n
    assert not spark.range(9).select(may_be_among(F.xxhash64("id"), hash_filter(df.limit(0)).scalar()).alias("m")).where("m").count()


def brute_signatures(text):
    tokens = [w for w in re.split(r"[^\w]|[\d_]", (text or "").lower()) if w]
    runs, anchor = [], None
    for t in tokens:
        if t in spotsigs.ANCHORS:
            anchor = t
        else:
            runs.append((anchor, t))
            anchor = None
    content = [t for _, t in runs]
    return {(a, *content[i : i + 2]) for i, (a, _) in enumerate(runs) if a and i + 2 <= len(content)}


def test_spotsigs_neighbours_edits_and_likeness(docs, none, rows):
    spark = docs.sparkSession
    plain = [(i, f"the cat{i} sat of mat{i % 3} and the dog ran away home again") for i in range(30)] + [(99, None), (98, "")]
    table = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r for r in spotsigs.fingerprint_documents(table).collect()}
    ordered = sorted(plain, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following, r = text or "", following or "", out[i]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 8 * r.n_signatures
    everything = spotsigs.fingerprint_documents(docs).collect()
    assert Counter((r.doc_id, r.n_chars) for r in everything) == Counter((r[0], len(r[1] or "")) for r in rows)
    by_id = defaultdict(set)
    for r in everything:
        by_id[r.n_chars, r.edited_sha256].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_id.values())
    assert spotsigs.fingerprint_documents(none).count() == 0
    one = spotsigs.fingerprint_documents(table.where("doc_id = 3")).first()
    assert one.near_next == 1.0


def test_spotsigs_chains(spark):
    text = "At a rally to kick off a weeklong campaign for the South Carolina primary"
    table = spark.createDataFrame([(1, text), (2, text.upper() + "!"), (3, "zzz"), (4, None), (5, "the of and")], "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in table.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert sets[1] == sets[2] and sets[4] == set() and len(sets[3]) == len(sets[5]) == 1
    wanted = spark.createDataFrame(sorted(brute_signatures(text)), "a string, b string, c string")
    assert {r[0] for r in wanted.select(F.hash("a", "b", "c")).collect()} <= sets[1]


def test_similar_sets_lose_no_pair(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(6):
            copy = list(b)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(60)] = f"w{rng.randrange(400)}"
            texts.append(" the ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in copy))
    table = spark.createDataFrame([*enumerate([*texts, texts[0], None])], "doc_id long, text string")
    members, found = spotsigs.similar_sets(table, 0.6)
    ids = {r.doc_id: r.set_id for r in members.collect()}
    sets = {r.doc_id: set(r.s) for r in table.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    expected = set()
    for i in sets:
        for j in sets:
            if ids[i] < ids[j] and sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6:
                expected.add((ids[i], ids[j]))
    assert expected and {(r.a, r.b) for r in found.collect()} == expected


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= sum(c.isdigit() for c in m) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= sum(c.isdigit() for c in m) <= 15),
}


def luhn(m):
    digits = [int(c) for c in m if c.isdigit()][::-1]
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0


def brute_spans(text):
    found = []
    for n, (kind, (pattern, test)) in enumerate(BASE.items()):
        found += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if test(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


PARTS = ["a", "b.c", "@", "@x.de", "x@y.org", ".", "1", "255", "1.2.3.4", "300.1.1.1", "0", "4111 1111 1111 1111", "+1 (499) 555-6503", "+", "-", " ", "é", "_", "%", "4952935900253052", "\n"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_equal_the_plain_patterns(text):
    assert personal_data.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "x@" + "a" * 300_000):
        personal_data.base_spans(text)
        personal_data.random_spans(text, [])
        list(personal_data.slots_in(f"password={text} the {text}", personal_data._Known(*[np.ones(16, bool)] * 2)))


def test_slots_are_looked_into_only_where_a_pattern_may_fit(monkeypatch):
    """A frequent word before a pattern costs nothing where no number, or not its other word, stands by it."""

    def bits(*values, number=lambda word: zlib.crc32(word.encode())):
        out = np.zeros(1 << 16, bool)
        out[[number(v) & 0xFFFF for v in values]] = True
        return out

    seen = []
    at = personal_data.patterns_at
    monkeypatch.setattr(personal_data, "patterns_at", lambda *slot: seen.append(slot) or at(*slot))
    patterns = bits("shape the 9x16", "left token of", "label key=", "head user Aa912", number=personal_data._number)
    text = "the word of it a: b=c 12345678 " * 300 + "the 4111111111111111, token of abc key=xyz\n\n(userABCD1234)"
    found = [text[a:b] for a, b, _ in personal_data.slots_in(text, personal_data._Known(patterns, bits("of"), bits("the")))]
    assert found == ["4111111111111111", "abc", "xyz", "userABCD1234"] and len(seen) < 10


def test_patterns_discover_identifiers(spark, docs, none, rows):
    rng = random.Random(2)
    texts = [f"word{chr(97 + i)} client card 4111111111111111 x{i} end" for i in range(26)]
    texts += [f"see client card {rng.randrange(10**9)} please" for _ in range(3)] + ["page 123456 of it", None, ""]
    seeds = [str(10**15 + i) for i in range(4000) if luhn(str(10**15 + i))][:40]
    texts += [f"the client card {s} here" for s in seeds]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in personal_data.figures(table).collect()}
    for i, text in enumerate(texts):
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(text or ""))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(out[i].spans.split(","))
    assert all("id:16:" in out[i].spans for i in (26, 27, 28)) and out[29].spans == ""
    counts = personal_data.figures(docs).groupBy("doc_id").count().collect()
    assert Counter({r.doc_id: r["count"] for r in counts}) == Counter(r[0] for r in rows)
    assert personal_data.figures(none).count() == 0


HIDDEN = {
    "login name": lambda rng: "the account of " + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)),
    "password": lambda rng: "password=" + "".join(rng.choice("abcdef") for _ in range(9)),
    "split number": lambda rng: f"please call desk ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)} today",
}


def test_recall_and_precision_on_planted_identifiers(spark):
    """Most of each kind's contexts hold seeds; what is hidden in the others has no exact or random form."""
    rng = random.Random(9)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts, planted = [], []

    def around(middle):
        return " ".join(rng.choices(filler, k=30)), middle, " ".join(rng.choices(filler, k=30))

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    for i in range(400):
        kind = list(HIDDEN)[i % 3]
        if i // 3 % 12:
            seed = {
                "login name": lambda: f"the account of u{i}x@mail.example.com",
                "password": lambda: f"password=a1b2c3{hexes(14)}",
                "split number": lambda: f"please call desk +1 (499) 555-{rng.randrange(1000, 9999)} today",
            }[kind]()
            texts.append(" ".join(around(seed)))
        else:
            hidden = HIDDEN[kind](rng)
            before, middle, after = around(hidden)
            texts.append(f"{before} {middle} {after}")
            value = hidden.removeprefix("the account of ").removeprefix("password=").removeprefix("please call desk ").removesuffix(" today")
            at = len(before) + 1 + hidden.index(value)
            planted.append((i, kind, at, at + len(value)))
    texts += [" ".join(rng.choices(filler, k=60)) for _ in range(200)]
    texts += [f"{' '.join(rng.choices(filler, k=9))} token = \"{hexes(40)}\" {' '.join(rng.choices(filler, k=9))}" for _ in range(30)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in personal_data.all_spans(df).collect()}
    found = [(k, any(a <= start + 1 and end <= b for a, b, _ in out[i])) for i, k, start, end in planted]  # brackets may stay out
    for kind in HIDDEN:
        hits = [hit for k, hit in found if k == kind]
        assert hits and np.mean(hits) >= 0.9, (kind, np.mean(hits))
    # Precision: nothing is found in plain texts, and all random tokens are.
    assert all(not out[i] for i in range(400, 600))
    assert all([k for *_, k in out[i]] == ["secret"] for i in range(600, 630))
    known = {(i, start, end) for i, _, start, end in planted}
    extra = [(i, *s) for i in range(400) for s in out[i] if s[2] == "id" and not any(i == j and s[0] < b and a < s[1] for j, a, b in known)]
    assert len(extra) <= 0.1 * len(planted), extra[:5]


def test_spans_of_rows_that_differ_only_in_which_column_is_missing(spark):
    table = spark.createDataFrame([(None, "a@b.de"), (7, None), (7, "x a@b.de"), (None, None)], "doc_id long, text string")
    out = Counter((r.doc_id, r.spans) for r in personal_data.figures(table).collect())
    assert out == Counter([(None, "email:0:6"), (7, ""), (7, "email:2:8"), (None, "")])


def test_redaction(spark):
    table = spark.createDataFrame([(1, "mail a@b.de or 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")
    found = personal_data.all_spans(table, carry=("text",))
    got = {r.doc_id: r.t for r in found.select("doc_id", personal_data.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "mail [EMAIL] or [IP]!", 2: None, 3: "none"}


RECORD = "record_id string, url string, date long, type string, status int, headers map<string,string>, digest string, near int, range int"


def test_revisits_by_hand(spark):
    etag = {"ETag": '"1"', "Content-Type": "text/html", "Content-Length": "9", "X": "old"}
    rows = [
        ("a", "http://www.Site.org/p/?utm_source=x#top", 100, "response", 200, etag, "d1"),
        ("b", "https://site.org/p", 100, "revisit", 304, {"etag": 'W/"1"'}, None),  # same second: too early
        ("c", "https://site.org/p", 101, "revisit", 304, {"etag": 'W/"1"', "Content-Length": "0", "x": "new", "Y": "1"}, None),
        ("d", "https://site.org/p", 102, "response", 206, {"ETag": '"2"'}, "d2"),
        ("e", "https://site.org/p", 103, "revisit", 304, {"ETag": '"2"'}, None),
        ("f", "https://site.org/p", 104, "revisit", 304, {}, None),
        ("g", "https://site.org/p", 105, "revisit", 304, {}, "d1"),
        ("h", None, 106, "revisit", 304, {"ETag": '"1"'}, None),
        ("i", "https://site.org/p", None, "revisit", 304, {"ETag": '"1"'}, None),
        ("j", "https://other.org/p", 500, "revisit", 304, None, None),
        ("k", "site.org/p", 110, "response", 200, None, "d9"),
        ("l", "https://site.org:443/p/", 111, "revisit", 304, None, "d9"),
        ("m", "https://site.org/p", 112, "revisit", 304, None, "d1"),
    ]
    out = {r.record_id: r for r in revisits.resolve(spark.createDataFrame([(*r, 0, 0) for r in rows], RECORD)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in out.items()} == {
        "b": ("no earlier response", None), "c": ("resolved", "a"), "e": ("changed", None), "f": ("unverified", None),
        "g": ("resolved", "a"), "h": ("no earlier response", None), "i": ("no earlier response", None),
        "j": ("no earlier response", None), "l": ("resolved", "k"), "m": ("changed", None),
    }
    assert out["c"].headers == {"etag": 'W/"1"', "x": "new", "y": "1", "content-type": "text/html", "content-length": "9"}
    assert out["c"].digest == "d1" and out["c"].canonical_url == "site.org/p"
    assert revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0


def test_revisits_of_one_hot_url_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        kind = rng.random() < 0.2
        url = "http://hot.org/" if rng.random() < 0.5 else f"http://h{rng.randrange(20)}.org/x"
        rows.append((f"{i:05d}", url, rng.randrange(1, 800), "response" if kind else "revisit", 200 if kind else 304, None, "d", 0, 0))
    out = {r.record_id: r.response_id for r in revisits.resolve(spark.createDataFrame(rows, RECORD)).collect()}
    for r in rows:
        if r[3] == "revisit":
            earlier = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r[1] and x[2] < r[2]]
            assert out[r[0]] == (max(earlier)[1] if earlier else None)
