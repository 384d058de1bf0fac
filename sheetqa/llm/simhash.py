"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits of shingle votes. Two of them link when they differ in at most
``radius`` bits. Pairs that can link share ``AGREE`` of ``BANDS`` bit bands exactly, for with at
most ``BANDS - AGREE`` differing bits that many bands are free of differences; so the chosen
bands are the keys by which pairs meet. Inside a key, a table of Hamming distances to reference
fingerprints discards every pair that lies further apart than ``radius`` in any coordinate (the
triangle inequality), and the bits of the survivors are compared. What leaves a key is a
spanning forest of its links, never all pairs, so thousands of near copies cost a few thousand
rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import discard, written
from .common import hash_filter, long_hashes, may_be_among
from .components import connected_components

WORDS = 4
RADIUS = 4
BANDS = 7
PIVOTS = 16
CHUNK = 20_000
#: Ids that a task remembers to leave out repeated links; forgetting them loses none.
MEMORY = 1_000_000
#: Buckets by which shingles count as common.
BUCKET_BITS = 20
#: Least number of buckets of parities; a power of two.
PARITIES = 256
#: Against rounding in products with the similarity.
SLACK = 1e-9
SEED = 42
_ALL = (1 << 64) - 1


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the text; of fewer words the whole sequence; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(tokens) < words:
        shingles = [b" ".join(tokens)] if tokens else []
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the bits that over half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a text; NULL and texts without words have 0."""
    return _majority(_shingle_hashes(text, words))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words and white space as for the fingerprints."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    taken = min(words, len(tokens))
    mixed = np.full(len(tokens) - taken + 1 if tokens else 0, taken, np.uint64)
    for i in range(taken):
        mixed = (mixed ^ hashed[i : len(tokens) - taken + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes: its majority, and that of the same hashes scrambled once more."""
    again = hashes * np.uint64(0x9E3779B97F4A7C15)
    again = (again ^ (again >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return _majority(hashes), _majority(again ^ (again >> np.uint64(29)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of at least as many buckets as hashes whether an odd number of them falls there, as longs.

    Two sets have at least as many members that only one of them has as their parities differ in.
    The number of buckets is a power of two, so that half as many are the halves laid over each other.
    """
    buckets = max(PARITIES, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0)
    counts = np.bincount((hashes & np.uint64(buckets - 1)).view(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """Parities in fewer buckets: ``size`` longs."""
    while len(parity) > size:
        parity = parity[: len(parity) // 2] ^ parity[len(parity) // 2 :]
    return parity


def fingerprints(text: Column, words: int = WORDS) -> Column:
    """``fingerprint`` as a Column of long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return run(text)


def shingle_sets(text: Column, words: int) -> Column:
    """``shingle_set`` as a Column of ``array<long>``."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).view(np.int64) for t in texts], dtype=object)

    return run(text)


def prefix_length(n: int, similarity: float) -> int:
    """So many of the first of ``n`` shingles, in any one order, hold one that a similar set has among its own."""
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def set_figures(text: Column, words: int, similarity: float, common: dict[str, np.ndarray]) -> Column:
    """``struct<d0, d1, n, p0, p1, parity, prefix>`` of a text's distinct shingles.

    128 bits that name the set, its size, its fingerprint, the parities of its shingles in
    buckets, and its first shingles in the order of ``common``: shingles in buckets not
    listed there, then the others by their count.
    """

    @F.pandas_udf("d0 long, d1 long, n int, p0 long, p1 long, parity array<long>, prefix array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            hashes = shingle_set(text, words)
            name = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
            at = hashes >> np.uint64(64 - BUCKET_BITS)
            weight = np.zeros(len(hashes), np.int64)
            if len(common["bucket"]):
                place = np.minimum(np.searchsorted(common["bucket"], at), len(common["bucket"]) - 1)
                weight = np.where(common["bucket"][place] == at, common["n"][place], 0)
            first = np.lexsort((hashes, weight))[: prefix_length(len(hashes), similarity)]
            rows.append((*name.tolist(), len(hashes), *wide_fingerprint(hashes), parities(hashes), hashes[first].view(np.int64)))
        return pd.DataFrame(rows, columns=["d0", "d1", "n", "p0", "p1", "parity", "prefix"])

    return run(text)


def common_buckets(docs: DataFrame, words: int) -> dict[str, np.ndarray]:
    """Buckets of shingles, sorted, that hold four times the mean of all texts' shingles, and their counts.

    All rows are counted. At most a quarter of the ``2 ** BUCKET_BITS`` buckets can be above.
    """

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(counts, (shingle_set(text, words) >> np.uint64(64 - BUCKET_BITS)).view(np.int64), 1)
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pd.DataFrame({"bucket": part.astype(np.int32), "n": counts[part]})

    counts = docs.select("text").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "shingle-buckets")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    above = counts.where(F.col("n") > max(16.0, 4 * mean)).orderBy("bucket").toPandas()
    return {"bucket": above["bucket"].to_numpy(np.uint64), "n": above["n"].to_numpy(np.int64)}


def pivots(count: int = PIVOTS, lanes: int = 1) -> np.ndarray:
    """Fixed pseudo-random reference fingerprints, a row of 64-bit lanes each."""
    names = [[b"pivot %d %d" % (i, lane) for lane in range(lanes)] for i in range(count)]
    return np.array([[xxhash.xxh64_intdigest(n) for n in row] for row in names], np.uint64)


def _apart(prints: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of each row of lanes to one other."""
    return np.bitwise_count(prints ^ other).sum(axis=-1, dtype=np.int16)


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: a row of Hamming distances for each fingerprint."""
    return np.stack([_apart(prints, r) for r in references], axis=1)


def forest(left: np.ndarray, right: np.ndarray, radius: int, references: np.ndarray) -> list[tuple[int, int]]:
    """Links, as places, that connect what pairs of ``left`` and ``right`` within ``radius`` connect.

    Fingerprints are rows of lanes; places count on from ``left`` to ``right``. With the same
    array twice these are all pairs of one set. A search from each unreached fingerprint
    compares only with those not reached yet, so a tight cluster costs about its size.
    """
    same = left is right
    prints = left if same else np.concatenate([left, right])
    side = np.zeros(len(prints), np.int8) if same else np.repeat([0, 1], [len(left), len(right)])
    table = distances(prints, references)
    unseen = np.ones(len(prints), bool)
    links: list[tuple[int, int]] = []
    for start in range(len(prints)):
        if not unseen[start]:
            continue
        unseen[start] = False
        rest = np.flatnonzero(unseen)
        queue = [start]
        while queue and len(rest):
            at = queue.pop()
            near = rest if same else rest[side[rest] != side[at]]
            for pivot in range(table.shape[1]):
                near = near[np.abs(table[near, pivot] - table[at, pivot]) <= radius]
                if not len(near):
                    break
            near = near[_apart(prints[near], prints[at]) <= radius]
            if len(near):
                unseen[near] = False
                rest = rest[unseen[rest]]
                queue.extend(near.tolist())
                links.extend((at, x) for x in near.tolist())
    return links


def band_masks(radius: int = RADIUS, bands: int = BANDS) -> list[int]:
    """Masks of all choices of ``bands - radius`` of ``bands`` bit bands, as signed longs."""
    if not 0 <= radius < bands <= 64:
        raise ValueError("need radius < bands <= 64")
    edges = [round(64 * i / bands) for i in range(bands + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(
    prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, chunk: int = CHUNK, count: int = PIVOTS
) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``print``, distinct) within ``radius``."""
    masks = F.array(*(F.col("print").bitwiseAND(F.lit(m)) for m in band_masks(radius, bands)))
    keyed = prints.select(
        F.col("print").alias("id"), F.col("print").alias("p0"), F.posexplode(masks).alias("which", "bits")
    )
    keyed = keyed.select(F.xxhash64("which", "bits").alias("key"), "id", "p0")
    return _linked(keyed, 1, radius, chunk, count)


def _connecting():
    """A function that passes on the pairs which no pairs before them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def connecting(pairs):
        if len(parent) > MEMORY:
            parent.clear()
        for a, b in pairs:
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                yield a, b

    return connecting


def _groups(keyed: DataFrame, columns: list[str], chunk: int) -> DataFrame:
    """Members that share a key: lists ``first``, and ``rest`` where a pair of chunks meets.

    A key with over ``chunk`` members is cut into chunks, each pair of which is a group of its own.
    """
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = groups.where(F.col("n") > chunk).select("key", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    # Keys over ``chunk`` are at most rows / chunk, and few of them exist at all.
    large = written(large, "large-keys")
    part = F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int")
    # Chunk p meets every chunk q: (p, q) with p <= q names the work, ``second`` tells q from p.
    cut = keyed.join(large, "key").withColumn("part", part)
    cut = cut.select("key", *columns, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cut = cut.select(
        "key",
        F.least("part", "other").alias("p"),
        F.greatest("part", "other").alias("q"),
        (F.col("part") > F.col("other")).alias("second"),
        F.struct(*columns).alias("m"),
    )
    cut = cut.groupBy("key", "p", "q").agg(
        F.collect_list(F.when(~F.col("second"), F.col("m"))).alias("first"),
        F.collect_list(F.when(F.col("second"), F.col("m"))).alias("rest"),
    )
    # Dealt out as plain rows: lists gathered before the shuffle would be larger than these.
    whole = keyed.join(large, "key", "left_anti").repartition("key")
    whole = whole.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("first"))
    whole = whole.where(F.size("first") > 1).withColumn("rest", F.filter("first", lambda _: F.lit(False)))
    return whole.select("first", "rest").union(cut.select("first", "rest"))


def _linked(keyed: DataFrame, lanes: int, radius: int, chunk: int, count: int) -> DataFrame:
    """``a, b``: ids of linked members ``(key, id, p0, …)`` that share a key.

    A key with over ``chunk`` members is cut into chunks, each pair of which becomes a task's
    work of its own: memory stays bounded and no pair is lost.
    """
    columns = ["id", *(f"p{i}" for i in range(lanes))]
    both = _groups(keyed, columns, chunk)
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("first", "rest") for c in columns]

    def run(batches):
        references = pivots(count, lanes)
        connects = _connecting()

        def side(row, name: str) -> np.ndarray:
            return np.stack([np.asarray(getattr(row, f"{name}_p{i}"), np.int64) for i in range(lanes)], 1).view(np.uint64)

        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.itertuples(index=False):
                ids = row.first_id
                if len(row.rest_id):
                    a, b = side(row, "first"), side(row, "rest")
                    ids = [*row.first_id, *row.rest_id]
                    found += [(ids[x], ids[y]) for x, y in forest(a, b, radius, references)]
                elif len(ids) == 2:  # most keys hold one chance pair: no table is worth it
                    gap = sum((int(p[0]) ^ int(p[1])).__and__(_ALL).bit_count() for p in row[1 : 1 + lanes])
                    if gap <= radius:
                        found.append((ids[0], ids[1]))
                else:
                    # By id: searches begin at the smallest, so keys of one cluster give equal links.
                    order = np.argsort(ids)
                    a, ids = side(row, "first")[order], ids[order]
                    found += [(ids[x], ids[y]) for x, y in forest(a, a, radius, references)]
            pairs = np.array([*connects(found)], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def fewer(batches):
        """Of a share of all links those that connect: what one key repeats of another goes."""
        connects = _connecting()
        for batch in batches:
            pairs = np.array([*connects(zip(batch["a"].tolist(), batch["b"].tolist()))], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    found = both.select(*flat).mapInPandas(run, "a long, b long").distinct()
    # A cluster's links come from many keys in many tasks; in fewer shares most turn out to repeat.
    shares = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return found.repartition(shares).mapInPandas(fewer, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    radius: int = RADIUS,
    words: int = WORDS,
    key: str = "doc_id",
    text: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``, and ``carry``.

    ``component_id`` is the smallest id that can be reached over links, the row's own included;
    ids that are NULL are passed over, and it is NULL if a component has no other. Texts that
    are NULL, empty or blank have fingerprint zero and link like any other. Repeated rows stay.
    Equal fingerprints meet as one, so exact copies make no pairs.
    """
    printed = written(
        docs.select(F.col(key).alias("doc_id"), fingerprints(F.col(text), words).alias("print"), *carry), "prints"
    )
    least = printed.groupBy("print").agg(F.min("doc_id").alias("least"))
    least = written(least, "distinct-prints")
    edges = links(least.select("print"), radius)
    component = connected_components(edges)
    rooted = least.join(component, least["print"] == component["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("print", "component_id")
    return printed.join(of_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", *carry
    )


def sampled_masks(bits: int, tables: int) -> list[tuple[int, int]]:
    """Seeded choices of ``bits`` of 128 positions, as masks of both lanes (signed longs)."""
    rng = np.random.default_rng(SEED)
    masks = []
    for _ in range(tables):
        chosen = rng.choice(128, bits, replace=False)
        lanes = [sum(1 << int(c % 64) for c in chosen if c // 64 == lane) for lane in (0, 1)]
        masks.append(tuple(m - (1 << 64) if m >> 63 else m for m in lanes))
    return masks


def _least_common(n: Column, m: Column, similarity: float) -> Column:
    """Members that sets of these sizes must share to be as similar."""
    return similarity / (1 + similarity) * (n + m) - SLACK


def _possible(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """``pairs(a, b)`` less those that sizes and parities alone (``facts(id, n, parity)``) rule out."""
    both = pairs.join(facts.select(F.col("id").alias("a"), F.col("n").alias("x"), F.col("parity").alias("px")), "a")
    both = both.join(facts.select(F.col("id").alias("b"), F.col("n").alias("y"), F.col("parity").alias("py")), "b")
    # Sizes that are close enough have equally many buckets, or one of them twice as many.
    def halved(p: Column, other: Column) -> Column:
        half = F.size(other)
        laid = F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(p) > half, laid).otherwise(p)

    px, py = F.col("px"), F.col("py")
    differing = F.zip_with(halved(px, py), halved(py, px), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    odd = F.aggregate(differing, F.lit(0), lambda acc, c: acc + c)
    x, y = F.col("x"), F.col("y")
    sizes = F.least(x, y) >= similarity * F.greatest(x, y) - SLACK
    return both.where(sizes).where(((x + y - odd) / 2 >= _least_common(x, y, similarity))).select("a", "b")


def _alike(pairs: DataFrame, facts: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets have that Jaccard coefficient; written.

    Sizes and parities discard pairs before any set is made. The sets are made again from the
    texts: of ``docs`` only rows that a filter of the texts' hashes lets through are moved, each
    text once a task. A pair that is left moves one set.
    """
    pairs = written(_possible(pairs, facts, similarity), "possible-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = written(wanted.join(facts.select("id", "s0", "s1"), "id"), "wanted-texts")
    s0, s1 = long_hashes(F.coalesce("text", F.lit("")))
    named = docs.select(F.coalesce("text", F.lit("")).alias("text"), s0.alias("s0"), s1.alias("s1"))
    named = named.where(may_be_among(F.col("s0"), hash_filter(wanted.select("s0")).scalar()))
    texts = named.groupBy("s0", "s1").agg(F.any_value("text").alias("text")).join(wanted, ["s0", "s1"])
    sets = written(texts.select("id", shingle_sets(F.col("text"), words).alias("shingles")), "candidate-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    found = written(common.where(F.col("c") >= similarity * (F.col("n") - F.col("c")) - SLACK).select("a", "b"), "alike")
    discard(pairs, wanted, sets)
    return found


def _differing(p: np.ndarray, q: np.ndarray) -> int:
    size = min(len(p), len(q))
    # Unsigned: of negative numbers, the bits of their absolute value would be counted.
    return int(np.bitwise_count((folded(p, size) ^ folded(q, size)).view(np.uint64)).sum())


def _open_pairs(members: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """``a, b``: pairs of ``members(key, id, root, n, at, parity)`` of one key and different roots that may be as similar.

    Keys with over ``chunk`` members are cut; inside a task each member is held against the others
    by sizes, positions and parities, these first in as few buckets as any member has and then in
    their own, and only pairs that all of this leaves over are put out.
    """
    columns = ["id", "root", "n", "at", "parity"]
    flat = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("first", "rest") for c in columns]

    def run(batches):
        for batch in batches:
            found: list[np.ndarray] = []
            for row in batch.itertuples(index=False):
                sides = []
                for side in ("first", "rest"):
                    ids = np.asarray(getattr(row, f"{side}_id"), np.int64)
                    numbers = [np.asarray(getattr(row, f"{side}_{c}"), np.int64) for c in columns[1:4]]
                    lists = getattr(row, f"{side}_parity")
                    sides.append([ids, *numbers, [*lists]])
                width = min(len(p) for *_, lists in sides for p in lists)
                for side in sides:
                    side.append(np.stack([folded(p, width) for p in side[4]]).view(np.uint64) if side[4] else None)
                (ids, roots, n, at, whole, odd), rest = sides[0], sides[1] if len(sides[1][0]) else None
                for i in range(len(ids)):
                    others = [c[i + 1 :] for c in sides[0]] if rest is None else rest
                    if not len(others[0]):
                        continue
                    reach = np.minimum(n[i] - at[i], others[2] - others[3])
                    least = similarity / (1 + similarity) * (n[i] + others[2]) - SLACK
                    smaller, larger = np.minimum(n[i], others[2]), np.maximum(n[i], others[2])
                    near = np.flatnonzero((others[1] != roots[i]) & (reach >= least) & (smaller >= similarity * larger - SLACK))
                    apart = np.bitwise_count(others[5][near] ^ odd[i]).sum(axis=1, dtype=np.int64) if len(near) else near
                    near = near[(n[i] + others[2][near] - apart) / 2 >= least[near]]
                    near = near[[(n[i] + others[2][j] - _differing(whole[i], others[4][j])) / 2 >= least[j] for j in near]] if len(near) else near
                    if len(near):
                        pair = np.stack([np.full(len(near), ids[i]), others[0][near]], 1)
                        found.append(np.sort(pair, axis=1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _groups(members, columns, chunk).select(*flat).mapInPandas(run, "a long, b long").distinct()


def _within_reach(x: str, y: str, similarity: float) -> Column:
    """Whether sets that have a first common shingle at these places can be as similar.

    Each side is a struct ``n, at``; from there on both can share what is left of the shorter.
    """
    n, m, left, right = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.at", f"{y}.at"))
    least = _least_common(n, m, similarity)
    return (F.least(n - left, m - right) >= least) & (F.least(n, m) >= similarity * F.greatest(n, m) - SLACK)


def similar_documents(
    docs: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    bits: int = 20,
    tables: int = 24,
    carry: tuple[str | Column, ...] = (),
) -> DataFrame:
    """``doc_id, component_id, root`` and ``carry``: classes of texts alike in ``words``-word shingles.

    Two texts link if and only if the Jaccard coefficient of their distinct shingles is
    ``similarity`` or more; ``root`` names the class, whatever the ids are. Candidates are found
    twice. Fingerprints of 128 bits meet in one of ``tables`` seeded samples of ``bits`` positions
    and within the radius expected of ``similarity`` and one and a half standard deviations: this
    finds most links of large classes at the cost of a forest. Then any two similar sets share one
    of their first ``prefix_length`` shingles, rare ones before common ones, so all sets that meet
    there and are not of one class yet are candidates too: none is lost. Every candidate is held
    against the sets themselves before it becomes a link. Equal sets are one. NULL ids, NULL and
    empty texts, repeated rows as for ``near_duplicates``; texts without words are one class.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    radius = int(128 * share + 1.5 * (128 * share * (1 - share)) ** 0.5)
    common = common_buckets(docs, words)
    s0, s1 = long_hashes(F.coalesce("text", F.lit("")))
    printed = docs.select(
        "doc_id", s0.alias("s0"), s1.alias("s1"), set_figures(F.col("text"), words, similarity, common).alias("set"), *carry
    )
    names = [c for c in printed.columns if c not in ("doc_id", "s0", "s1", "set")]
    numbered = printed.select(F.monotonically_increasing_id().alias("id"), "doc_id", "s0", "s1", "set.*", *names)
    printed = written(numbered, "shingle-sets")
    # One row per set. All but the ids and the text's hashes follow from the set; these are of one row.
    one = (F.any_value(c).alias(c) for c in ("id", "s0", "s1", "n", "p0", "p1", "parity"))
    distinct = written(printed.groupBy("d0", "d1").agg(F.min("doc_id").alias("least"), *one), "distinct-sets")
    facts = distinct.select("id", "n", "parity", "s0", "s1")
    keys = F.array(
        *(
            F.xxhash64(F.col("p0").bitwiseAND(F.lit(m0)), F.col("p1").bitwiseAND(F.lit(m1)))
            for m0, m1 in sampled_masks(bits, tables)
        )
    )
    keyed = distinct.where("n > 0").select("id", "p0", "p1", F.posexplode(keys).alias("which", "bits"))
    keyed = keyed.select(F.xxhash64("which", "bits").alias("key"), "id", "p0", "p1")
    near = written(_linked(keyed, 2, radius, CHUNK, PIVOTS), "near-prints")
    edges = _alike(near, facts, docs, words, similarity)
    discard(near)
    component = connected_components(edges)

    # First shingles of one row per set, with the class so far.
    rooted = distinct.select("id").join(component.withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select("id", F.coalesce("root", "id").alias("root"))
    firsts = printed.select("id", "n", "prefix").join(rooted, "id")
    firsts = firsts.select("id", "root", "n", F.posexplode("prefix").alias("at", "key"))
    # Shingles that stand first in sets of several classes; a task has one row for each of its keys.
    spans = firsts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    shared = written(spans.where("lo < hi").select("key"), "shared-keys")
    met = firsts.where(may_be_among(F.col("key"), hash_filter(shared.select("key")).scalar())).join(shared, "key")
    met = written(met.select("key", F.struct("id", "root", "n", "at").alias("m")), "shared-shingles")

    # One member of each shingle against all: what joins a class mostly does so here.
    pivot = met.groupBy("key").agg(F.min_by("m", F.xxhash64("m.id")).alias("pivot"))
    close = met.join(pivot, "key").where((F.col("m.root") != F.col("pivot.root")) & _within_reach("m", "pivot", similarity))
    ids = F.col("m.id"), F.col("pivot.id")
    star = close.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()
    more = _alike(star, facts, docs, words, similarity)
    edges = written(edges.union(more), "links")
    component = connected_components(edges)

    # Then all others, where several classes are left.
    again = met.join(component, F.col("m.id") == component["node"], "left")
    again = again.select("key", "m.id", F.coalesce("root", "m.root").alias("root"), "m.n", "m.at")
    left = again.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    members = again.join(left, "key").join(facts.select("id", "parity"), "id")
    every = _open_pairs(members.select("key", "id", "root", "n", "at", "parity"), similarity, CHUNK)
    more = _alike(every, facts, docs, words, similarity)
    discard(met, shared)
    if not more.isEmpty():
        component = connected_components(edges.union(more))

    rooted = distinct.join(component, distinct["id"] == component["node"], "left").select(
        "d0", "d1", "least", F.coalesce("root", "id").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = rooted.join(smallest, "root").select("d0", "d1", "component_id", "root")
    return printed.join(of_set, ["d0", "d1"]).select("doc_id", "component_id", "root", *names)
