"""Ranked lexical search by pipelined term partitioning.

An inverted index is made in blocks of documents: a row holds one term's places in one block. Terms
have owners, ``OWNERS`` classes by weight, rarest first. An item's terms and its sparse
accumulator for a block form a bundle. Bundles visit the owners one after the other; each stage
is a cogroup of bundles with the postings of one owner, by block, which adds the owner's integer
contributions and passes the bundle on. After the last stage a bundle gives its best documents,
and the best of all blocks are the answer.

A document leaves an accumulator, or is not taken up, once even the greatest contributions still
to come keep it below documents of its own block that already fill the ranks. So no result is
lost, and what travels stays sparse.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

RANKS = 10
OWNERS = 4
#: Documents of a block, and bytes of text after which one ends earlier.
BLOCK = 4096
BLOCK_BYTES = 64 << 20
#: Items whose bundles meet one copy of the postings.
ITEMS = 256
#: Shares of the blocks to which items are dealt.
SHARES = 64
#: Bits of the filter that lets through the terms of all items, and others by chance.
FILTER_BITS = 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCALE = 1_000_000_000
#: No term's share of a score reaches this many times its weight.
_CEILING = _SCALE // 1000
#: For each byte what stands for it: capitals lowered, all that parts terms a space.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order; of NULL none."""
    return (text or b"").translate(_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of all rows of an item; rows without id are one item."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    found = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


def _term_filter(terms: DataFrame) -> np.ndarray:
    """Bits of the hashes of all terms; of a fixed size, whatever the number of items."""
    # Bitmaps count places from 1.
    place = F.xxhash64("term").bitwiseAND((1 << FILTER_BITS) - 1) + 1
    packed = terms.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    bits = np.zeros(1 << FILTER_BITS, bool)
    for row in packed.collect():  # at most 2 ** FILTER_BITS / 32,768 rows of 4,096 bytes
        part = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        at = (row["bucket"] - 1) * len(part)
        bits[at : at + len(part)] |= part[: len(bits) - at].astype(bool)
    return bits


_INDEX = "block long, term string, places array<int>, counts array<long>, ids array<long>"


def block_index(docs: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """The inverted index of ``docs(doc_id, text)`` for the terms that pass the filter of ``terms``; written.

    ``block, term, places, counts, ids``. A posting row has the places in the block of the documents
    that hold ``term``, and its occurrences there. The row with a NULL term has ``ids`` and, in
    ``counts``, the number of terms of all documents of the block. Blocks follow the rows of a task.
    """
    wanted = _term_filter(terms)

    def run(batches):
        low = (1 << FILTER_BITS) - 1
        known: dict[bytes, bool] = {}
        number = TaskContext.get().partitionId() << 32

        def passes(term: bytes) -> bool:
            hit = known.get(term)
            if hit is None:
                if len(known) > 500_000:
                    known.clear()
                hit = known[term] = bool(wanted[xxhash.xxh64_intdigest(term, 42) & low])
            return hit

        def flush():
            rows = [(None, [], sizes, ids), *((t.decode(), p, c, []) for t, (p, c) in lists.items())]
            for at in range(0, len(rows), 5000):
                part = rows[at : at + 5000]
                columns = [
                    pa.array([number] * len(part), pa.int64()),
                    pa.array([r[0] for r in part], pa.string()),
                    pa.array([r[1] for r in part], pa.list_(pa.int32())),
                    pa.array([r[2] for r in part], pa.list_(pa.int64())),
                    pa.array([r[3] for r in part], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "places", "counts", "ids"])

        lists: dict[bytes, tuple[list[int], list[int]]] = {}
        ids: list[int | None] = []
        sizes: list[int] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                body = text.as_py()
                found = terms_of(body)
                for term, count in Counter(filter(passes, found)).items():
                    places, counts = lists.setdefault(term, ([], []))
                    places.append(len(ids))
                    counts.append(count)
                ids.append(doc_id)
                sizes.append(len(found))
                size += len(body or b"")
                if len(ids) >= block or size >= BLOCK_BYTES:
                    yield from flush()
                    lists, ids, sizes, size = {}, [], [], 0
                    number += 1
        if ids:
            yield from flush()

    return written(docs.select("doc_id", "text").mapInArrow(run, _INDEX), "block-index")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    sizes = index.where("term is null").select(
        F.size(F.filter("counts", lambda n: n > 0)).cast("long").alias("n"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda acc, n: acc + n).alias("l"),
    )
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()


def weighted_terms(terms: DataFrame, index: DataFrame, documents: int, owners: int = OWNERS) -> DataFrame:
    """``term, weight, owner`` of the items' terms that some document holds; written."""
    found = index.where("term is not null").groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df"))
    ratio = F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.ln(ratio)).cast("long")
    most = max(1.0, 1000 * float(np.log((2 * documents + 2) / 3)))
    owner = F.lit(owners - 1) - F.least(F.floor(weight * owners / F.lit(most)), F.lit(owners - 1))
    weighed = found.join(terms.select("term").distinct(), "term").select("term", weight.alias("weight"), owner.cast("int").alias("owner"))
    return written(weighed.where("weight > 0"), "term-weights")


def _bundles(terms: DataFrame, weights: DataFrame, index: DataFrame, groups: int) -> DataFrame:
    """A bundle per item and block: the item's weighted terms and an empty accumulator."""
    per_item = terms.join(weights, "term").groupBy("item_id").agg(
        F.collect_list(F.struct("owner", "term", "weight")).alias("terms")
    )
    # The stated items meet all blocks, in shares of the blocks.
    dealt = per_item.withColumn("crowd", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    blocks = index.where("term is null").select("block", F.pmod(F.xxhash64("block"), F.lit(SHARES)).cast("int").alias("share"))
    return blocks.join(dealt, "share").select(
        # Under names of their own: the postings they meet come from the same table.
        F.col("block").alias("block"),
        "crowd",
        "item_id",
        F.transform("terms", lambda t: t["owner"]).alias("owners"),
        F.transform("terms", lambda t: t["term"]).alias("terms"),
        F.transform("terms", lambda t: t["weight"]).alias("weights"),
        F.array().cast("array<int>").alias("places"),
        F.array().cast("array<long>").alias("scores"),
    )


_BUNDLE = (
    "block long, crowd int, item_id long, owners array<int>, terms array<string>, weights array<long>,"
    " places array<int>, scores array<long>"
)
_RESULT = "item_id long, doc_id long, score long"
_LONGS = pa.list_(pa.int64())
_RESULT_SCHEMA = pa.schema([(name, pa.int64()) for name in ("item_id", "doc_id", "score")])
_BUNDLE_SCHEMA = pa.schema(
    [
        ("block", pa.int64()),
        ("crowd", pa.int32()),
        ("item_id", pa.int64()),
        ("owners", pa.list_(pa.int32())),
        ("terms", pa.list_(pa.string())),
        ("weights", _LONGS),
        ("places", pa.list_(pa.int32())),
        ("scores", _LONGS),
    ]
)


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists of an Arrow column as arrays."""
    for chunk in column.chunks:
        values = chunk.values.to_numpy(zero_copy_only=False)
        bounds = chunk.offsets.to_numpy()
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield values[a:b]


def _visit(owner: int, last: bool, documents: int, length: int, ranks: int):
    """One stage: what the owner's postings of a block add to the bundles there."""

    def norms(count: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (_SCALE * count) // (1000 * count + 8 * m)

    def visit(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        terms = postings.column("term").to_pylist()
        places, counts = (list(_lists(postings.column(c))) for c in ("places", "counts"))
        if not bundles.num_rows:
            return (_RESULT_SCHEMA if last else _BUNDLE_SCHEMA).empty_table()
        head = terms.index(None)
        m = 100 - 90 + (90 * counts[head] * documents) // max(1, length)
        added = {t: (p, norms(c, m[p])) for t, p, c in zip(terms, places, counts) if t is not None}
        doc_ids = postings.column("ids")[head].as_py() if last else []
        out: list[tuple] = []
        board = np.zeros(len(m), np.int64)
        rows = zip(
            bundles.column("item_id").to_pylist(),
            *(bundles.column(c).to_pylist() for c in ("owners", "terms", "weights")),
            _lists(bundles.column("places")),
            _lists(bundles.column("scores")),
        )
        kept = []
        for item, owners, names, weights, before, scores in rows:
            board[before] = scores
            rest = 0
            for who, name, weight in zip(owners, names, weights):
                if who == owner and name in added:
                    at, norm = added[name]
                    board[at] += weight * norm
                elif who > owner:
                    rest += weight * _CEILING
            hits = np.flatnonzero(board)
            found = board[hits]
            board[hits] = 0
            if len(hits) > ranks:
                # The least score among the block's best: what cannot reach it has no rank.
                least = np.partition(found, len(found) - ranks)[len(found) - ranks]
                stays = found + rest >= least
                hits, found = hits[stays], found[stays]
            if last:
                out.extend((item, doc_ids[p], s) for p, s in zip(hits.tolist(), found.tolist()))
            else:
                kept.append((hits, found))
        if last:
            columns = zip(*out) if out else ((), (), ())
            return pa.table([pa.array(c, pa.int64()) for c in columns], schema=_RESULT_SCHEMA)
        carried = [bundles.column(c).combine_chunks() for c in _BUNDLE_SCHEMA.names[:6]]
        places = pa.array([p.astype(np.int32) for p, _ in kept], pa.list_(pa.int32()))
        return pa.table([*carried, places, pa.array([x for _, x in kept], _LONGS)], schema=_BUNDLE_SCHEMA)

    return visit


def search(docs: DataFrame, items: DataFrame, ranks: int = RANKS, owners: int = OWNERS, block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``ranks`` highest-scoring rows of ``docs`` for each item.

    Equal scores rank by ascending ``doc_id``, rows without id last; repeated rows are ranked each
    for itself. NULL texts have no terms. An item without terms, or whose terms no document
    holds, has no rows; neither have empty tables. Scores are 64-bit integers.
    """
    terms = item_terms(items)
    index = block_index(docs, terms, block)
    documents, length = corpus_size(index)
    weights = weighted_terms(terms, index, documents, owners)
    postings = index.join(weights.select("term", "owner"), "term").select("block", "owner", "term", "places", "counts", "ids")
    heads = index.where("term is null")
    groups = max(1, -(-terms.select("item_id").distinct().count() // ITEMS))
    bundles = _bundles(terms, weights, index, groups)
    crowd = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("crowd")
    for owner in range(owners):
        last = owner == owners - 1
        here = postings.where(F.col("owner") == owner).drop("owner").unionByName(heads)
        # A group of items takes a copy of the postings along.
        here = here.select("*", crowd)
        bundles = (
            bundles.groupBy("block", "crowd")
            .cogroup(here.groupBy("block", "crowd"))
            .applyInArrow(_visit(owner, last, documents, length, ranks), _RESULT if last else _BUNDLE)
        )
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        bundles.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= ranks)
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )


SQL = r"""
with terms as (
  select row_number() over () as place, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
size as (select count(*) filter (where len(words) > 0) as n, sum(len(words))::bigint as l from terms),
postings as (select place, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf
             from (select place, doc_id, len(words) as n, unnest(words) as term from terms) group by place, term),
wanted as (
  select distinct item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
weights as (
  select term, floor(1000 * ln((2.0::double * (select n from size) + 2) / (2 * count(*) + 1)))::bigint as w
  from postings where term in (select term from wanted) group by term),
scored as (
  select item_id, place, any_value(doc_id) as doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * (select n from size)) // (select l from size)))))::bigint as score
  from wanted join weights using (term) join postings using (term) group by item_id, place),
ranked as (select item_id, doc_id, score,
                  row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank
           from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""
