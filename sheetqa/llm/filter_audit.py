"""How filters of a corpus interact: one pass over the bytes, then all orders of the filters.

The pass is a finite-state transducer over UTF-8 bytes, held in two tables of (state, byte): the
next state (outside or inside a word) and what the step emits (a code point, a capital, a symbol,
a word's begin or end). Each emitted word span goes into a hash table, where a span counts as
known only after its bytes were compared with those of the span that holds the place. Texts
never leave their task; what is shuffled is one narrow row per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
#: Bytes that go through the transducer at once; a longer word is taken whole.
WINDOW = 1 << 20
FIGURES = ("n_words", "n_distinct", "n_capitals", "n_code_points", "n_symbols")

_OUTSIDE, _INSIDE = 0, 1
_POINT, _CAPITAL, _SYMBOL, _BEGIN, _END = 1, 2, 4, 8, 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by ``state << 8 | byte``."""
    byte = np.arange(256)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    after = np.where(space, _OUTSIDE, _INSIDE)
    emits = np.where((byte & 0xC0) != 0x80, _POINT, 0)
    emits |= np.where((byte >= ord("A")) & (byte <= ord("Z")), _CAPITAL, 0)
    emits |= np.where(np.isin(byte, [ord(c) for c in SYMBOLS]), _SYMBOL, 0)
    outside = emits | np.where(space, 0, _BEGIN)
    inside = emits | np.where(space, _END, 0)
    return np.concatenate([after, after]).astype(np.uint8), np.concatenate([outside, inside]).astype(np.uint8)


NEXT, EMIT = _tables()


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """``(first row, rows, begin, end)``: whole rows up to ``window`` bytes, or a part of a longer one.

    A long row is cut behind a space, so a cut is in the outside state.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + window, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[last])
        while end - begin > window:
            reach = begin + window
            while reach < end:
                spaces = np.flatnonzero(NEXT[data[reach - window : reach]] == _OUTSIDE)
                if len(spaces):
                    reach += int(spaces[-1]) + 1 - window
                    break
                reach += window
            if reach >= end:
                break
            yield row, 1, begin, reach
            begin = reach
        yield row, last - row, begin, end
        row = last


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as some piece needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            made = []
            for factor in (_BASE, inverse):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


def transduce(piece: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Emissions of the bytes of ``piece``, and begin, end and hash of each word.

    ``starts`` are the places where texts begin; the state there is outside. The next state
    depends on the byte alone, so the table gives the states of all bytes at once.
    """
    n = len(piece)
    state = np.empty(n, np.uint16)
    state[1:] = NEXT[piece[:-1]]
    state[starts[starts < n]] = _OUTSIDE
    emitted = EMIT[(state << 8) | piece]
    begin = np.flatnonzero(emitted & _BEGIN)
    # A word ends before the space that ends it, or where its text does.
    cut = np.flatnonzero(NEXT[piece] == _INSIDE)
    last = cut[np.append(cut[1:] != cut[:-1] + 1, True)] + 1 if len(cut) else cut
    # Texts may touch without a space between them: there a word ends where the next begins.
    last = np.union1d(last, begin[1:][NEXT[piece[begin[1:] - 1]] == _INSIDE])
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return emitted, begin, last, (prefix[last] - prefix[begin]) * down[begin]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of ``length`` bytes at ``a`` and at ``b`` are equal."""
    same = np.ones(len(a), bool)
    step = np.arange(8)
    active, at = np.arange(len(a)), 0
    while len(active) and at < 64:
        inside = at + step < length[active, None]
        where = np.where(inside, at + step, 0)
        same[active] = (data[a[active, None] + where] == data[b[active, None] + where]).all(axis=1)
        at += 8
        active = active[same[active] & (length[active] > at)]
    for i in active:
        x, y, n = int(a[i]), int(b[i]), int(length[i])
        same[i] = np.array_equal(data[x : x + n], data[y : y + n])
    return same


def distinct_spans(data: np.ndarray, begin: np.ndarray, length: np.ndarray, hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which spans are the first of their bytes in their group: open addressing, all spans at once.

    A round looks at one place per span that is left. Of those that meet a free place one takes
    it; a span that equals the holder byte by byte is known; any other moves to the next place.
    """
    n = len(begin)
    first = np.zeros(n, bool)
    size = 1 << max(4, (2 * n).bit_length())
    slots = np.full(size, -1, np.int64)
    key = (hashes ^ (group.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(_BASE)
    place = (key >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
    left = np.arange(n)
    while len(left):
        at = place[left]
        free = slots[at] < 0
        slots[at[free]] = left[free]
        holder = slots[at]
        taken = holder == left
        first[left[taken]] = True
        rest, holder = left[~taken], holder[~taken]
        alike = (hashes[rest] == hashes[holder]) & (length[rest] == length[holder]) & (group[rest] == group[holder])
        check = np.flatnonzero(alike)
        alike[check] = _same_bytes(data, begin[rest[check]], begin[holder[check]], length[rest[check]])
        left = rest[~alike]
        place[left] = (place[left] + 1) & (size - 1)
    return first


def byte_figures(data: np.ndarray, offsets: np.ndarray, powers: Powers, window: int = WINDOW) -> dict[str, np.ndarray]:
    """``FIGURES`` of the texts that lie in ``data`` between ``offsets``."""
    rows = len(offsets) - 1
    out = {name: np.zeros(rows, np.int64) for name in FIGURES}
    spans: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if spans:
            begin, length, hashes, group = (np.concatenate(column) for column in zip(*spans))
            found = group[distinct_spans(data, begin, length, hashes, group)]
            out["n_distinct"] += np.bincount(found, minlength=rows)
            spans.clear()

    for row, count, begin, end in _pieces(data, offsets, window):
        if begin == end:
            continue
        piece = data[begin:end]
        # The parts of one long text share a table; other texts need none of the one before.
        if spans and spans[-1][3][-1] != row:
            flush()
        starts = np.maximum(offsets[row : row + count] - begin, 0)
        emitted, first, last, hashes = transduce(piece, starts, powers)
        for bit, name in ((_POINT, "n_code_points"), (_CAPITAL, "n_capitals"), (_SYMBOL, "n_symbols"), (_BEGIN, "n_words")):
            total = np.zeros(len(piece) + 1, np.int64)
            np.cumsum((emitted & bit) != 0, out=total[1:])
            bounds = np.append(starts, len(piece))
            out[name][row : row + count] += total[bounds[1:]] - total[bounds[:-1]]
        if len(first):
            group = row + np.searchsorted(starts, first, "right") - 1
            spans.append((first + begin, last - first, hashes, group))
    flush()
    return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column and the places between its values; NULL is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_figures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``FIGURES`` (long) and ``text_key`` (128 bits that name the text) in place of ``text``.

    Words are maximal runs of bytes other than ASCII white space; distinct ones are told apart by
    their bytes. A NULL text counts as empty. Other columns are kept as they are; one with the
    name of a figure is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "text_key", *FIGURES)]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField(name, T.LongType()) for name in FIGURES]
        + [T.StructField("text_key", T.BinaryType())]
    )

    def run(batches):
        powers = Powers()
        for batch in batches:
            data, offsets = _bytes_of(batch.column(len(kept)))
            found = byte_figures(data, offsets, powers, window)
            view = memoryview(data)
            keys = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(found[name]) for name in FIGURES] + [pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *FIGURES, "text_key"])

    return docs.select(*kept, text).mapInArrow(run, schema)


def failed_filters() -> Column:
    """Bits 0 to 3 for the filters A to D over ``FIGURES``."""
    tests = (
        F.col("n_words") < 100,
        100 * F.col("n_distinct") < 80 * F.col("n_words"),
        100 * F.col("n_capitals") > 10 * F.col("n_code_points"),
        F.col("n_symbols") > 0,
    )
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, n, good, toxic``: rows per part and set of failed filters.

    Copies of a text (filter E: a smaller id has the same text; no id is larger than any, and
    equal ids do not count as smaller) are found by grouping its 128-bit key. Counts per key are combined in the tasks
    before each shuffle, so a text that a third of all rows share is a few rows of each task.
    A document counts as good or toxic if any label row of its id says so.
    """
    figured = text_figures(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text"))
    rows = figured.select("doc_id", "part", "text_key", failed_filters().alias("failed"))
    counted = rows.groupBy("doc_id", "part", "text_key", "failed").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t")
    )
    # Rows without id meet no label; a part of their text key keeps them from one task.
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(4096))).otherwise(0).cast("int")
    known = counted.withColumn("spread", spread).join(
        marked.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left"
    )
    good, toxic = (F.coalesce(c, F.lit(0)).alias(c) for c in ("q", "t"))
    known = known.select("doc_id", "part", "text_key", "failed", "n", good, toxic)
    rank = F.struct(F.isnull("doc_id").alias("none"), "doc_id")
    per_key = known.groupBy("text_key", "part", "failed", "q", "t").agg(
        F.sum("n").alias("n"), F.min(F.struct(rank.alias("rank"), "n")).alias("first")
    )
    least = F.min("first.rank").over(Window.partitionBy("text_key"))
    firsts = F.when(F.col("first.rank").eqNullSafe(least), F.col("first.n")).otherwise(0)
    split = per_key.select("part", "failed", "q", "t", "n", firsts.alias("firsts")).select(
        "part",
        "q",
        "t",
        F.explode(
            F.array(
                F.struct("failed", F.col("firsts").alias("n")),
                F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")),
            )
        ).alias("s"),
    )
    return (
        split.where("s.n > 0")
        .groupBy("part", F.col("s.failed").alias("failed"))
        .agg(
            F.sum("s.n").alias("n"),
            F.sum(F.col("s.n") * F.col("q")).alias("good"),
            F.sum(F.col("s.n") * F.col("t")).alias("toxic"),
        )
    )


def all_orders(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """What each filter does at each step of each order, from ``failure_counts``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``, zeros included. A part is one row of at most ``2 ** len(filters)`` counts here.
    """
    k = len(filters)
    names = "".join(filters)
    entry = F.struct("n", "good", "toxic")
    per_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("failed", entry))).alias("_of"))
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)])).alias("filter_order")
    steps = per_part.select("part", "_of", orders).select(
        "part", "_of", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")
    )

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), letter) - 1)

    def before(i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), i), F.lit(0), lambda acc, s: acc + bit(F.substring("filter_order", s, F.lit(1))))

    placed = steps.withColumn("_own", bit(F.substring("filter_order", F.col("step"), F.lit(1))))
    placed = placed.withColumn("_until", before(F.col("step"))).withColumn("_earlier", F.col("_until") - F.col("_own"))

    def total(test, value: str = "n", weigh=None) -> Column:
        def add(acc: Column, e: Column) -> Column:
            amount = e["value"][value] if weigh is None else weigh(e["key"], e["value"][value])
            return acc + F.when(test(e["key"]), amount).otherwise(0)

        return F.aggregate(F.map_entries("_of"), F.lit(0).cast("long"), add)

    def fails(m: Column, which: str) -> Column:
        return m.bitwiseAND(F.col(which)) != 0

    def lost(m: Column) -> Column:
        return fails(m, "_own") & ~fails(m, "_earlier")

    # A row is removed by the first of its j failing filters: each is first in k! / j of the orders.
    share = F.lit([0, *(math.factorial(k) // j for j in range(1, k + 1))])
    return placed.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m, "_until")).alias("kept"),
        total(lost).alias("removed"),
        total(lambda m: fails(m, "_own") & fails(m, "_earlier")).alias("redundant"),
        total(lambda m: m == F.col("_own")).alias("unique_fails"),
        total(lost, "good").alias("good_lost"),
        total(lost, "toxic").alias("toxic_lost"),
        total(
            lambda m: fails(m, "_own"), weigh=lambda m, n: let(F.bit_count(m), lambda j: F.get(share, j)) * n
        ).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over ``docs``, per language; an empty table has no parts.

    Rows with NULL or repeated ids, NULL, empty and repeated texts count one by one.
    """
    return all_orders(failure_counts(docs, labels))


SQL = r"""
with figures as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
marks as (select doc_id, max((quality = 1)::int) as q, max((toxic = 1)::int) as t from labels where doc_id is not null group by doc_id),
failed as (
  select part, coalesce(q, 0) as q, coalesce(t, 0) as t,
         len(words) < 100 as a,
         100 * len(list_distinct(words)) < 80 * len(words) as b,
         100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) as c,
         regexp_matches(body, '[#$%&*|]') as d,
         coalesce(f.doc_id, 9223372036854775807::hugeint + 1)
           > min(coalesce(f.doc_id, 9223372036854775807::hugeint + 1)) over (partition by body) as e
  from figures f left join marks m on f.doc_id = m.doc_id),
sets as (
  select part, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
               || case when d then 'D' else '' end || case when e then 'E' else '' end as fails,
         count(*) as n, sum(q) as good, sum(t) as toxic
  from failed group by 1, 2),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select v.x || w.x || x.x || y.x || z.x as filter_order
  from letters v, letters w, letters x, letters y, letters z
  where len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5),
steps as (select filter_order, s.step::int as step, filter_order[s.step] as own, filter_order[1:s.step - 1] as earlier
          from orders, (select unnest([1, 2, 3, 4, 5]) as step) s),
joined as (
  select part, filter_order, step, n, good, toxic, contains(fails, own) as mine, fails = own as only_mine,
         len(translate(fails, earlier, '')) < len(fails) as gone
  from sets, steps)
select part, filter_order, step,
       sum(case when not mine and not gone then n else 0 end)::bigint as kept,
       sum(case when mine and not gone then n else 0 end)::bigint as removed,
       sum(case when mine and gone then n else 0 end)::bigint as redundant,
       sum(case when only_mine then n else 0 end)::bigint as unique_fails,
       sum(case when mine and not gone then good else 0 end)::bigint as good_lost,
       sum(case when mine and not gone then toxic else 0 end)::bigint as toxic_lost,
       (sum(sum(case when mine and not gone then n else 0 end)) over (partition by part, filter_order[step]))::bigint as shapley
from joined group by part, filter_order, step
"""
