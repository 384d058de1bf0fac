"""Personal data: exact patterns, and a bootstrapped extraction of identifiers they do not know.

Seeds are the matches of the exact patterns and long tokens too random to be words. What stands
around a seed gives lexical patterns: the label it is glued to, the two words to its left, the
word to its left with its shape, its first characters with its shape. A second pass over all
texts counts how often each pattern occurs at all, a third finds what stands in the slots of the
promising ones, whatever it looks like. On the graph of instances and patterns, a pattern's
confidence is the mean score of its instances, and an instance's score the chance that not all of
its trusted patterns are wrong. A few rounds of this on Spark let trusted patterns discover
further identifiers.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import discard, written
from .common import hash_filter, long_hashes

KINDS = ("email", "ip", "card", "phone")
#: Kinds of the spans that the method adds: random tokens, and what trusted patterns find.
SECRET, FOUND = "secret", "id"
ROUNDS = 3
CONFIDENCE = 0.9
#: Different seeds that a pattern needs before it is trusted.
SUPPORT = 8
#: Share of a pattern's occurrences that seeds must have before its slots are looked into.
PROMISE = 0.5
#: Least length, digits and bits per character of a token that is taken for random.
RANDOM_LENGTH, RANDOM_DIGITS, RANDOM_BITS = 16, 3, 2.75
PATTERN_BITS = 20
_DIGITS = frozenset("0123456789")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so the others need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % RANDOM_LENGTH)
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, in time linear in the text."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all exact matches, by start and then kind; NULL counts as empty."""
    text = text or ""
    found = [("email", *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Long tokens with letters and digits too mixed for a word, outside the base's spans."""
    found = []
    covered = _covered(base)
    for m in _LONG.finditer(text):
        token = m[0]
        if sum(map(token.count, "0123456789")) < RANDOM_DIGITS or token.isdigit() or covered(*m.span()):
            continue
        counts = Counter(token).values()
        bits = -sum(c / len(token) * math.log2(c / len(token)) for c in counts)
        if bits >= RANDOM_BITS:
            found.append((SECRET, *m.span()))
    return found


def _covered(spans: list[tuple[str, int, int]]):
    """A test whether a range meets one of the spans, which are in order of their starts."""
    starts = [s for _, s, _ in spans]
    reach = list(accumulate((e for _, _, e in spans), max))

    def covered(start: int, end: int) -> bool:
        at = bisect_right(starts, end - 1)
        return bool(at) and reach[at - 1] > start

    return covered


def _shape(token: str) -> str:
    """Runs of digits by their length, letters as one sign for each run, by case."""
    token = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", token)
    return re.sub(r"\d+", lambda m: f"9x{len(m[0])}", token)


def _class(token: str) -> str:
    kinds = (str.isupper, str.islower, str.isdigit)
    return "".join(name for name, test in zip("Aa9", kinds) if any(map(test, token))) + str(len(token))


def patterns_at(before: list[str], label: str, token: str) -> list[str]:
    """Patterns of a slot: two words ``before`` it, the ``label`` glued to it, and its own shape."""
    out = []
    if label:
        out.append(f"label {label.lower()}")
    if len(before) == 2 and not label:
        out.append(f"left {before[0].lower()} {before[1].lower()}")
    if any(map(str.isdigit, token)):
        if before and not label:
            out.append(f"shape {before[-1].lower()} {_shape(token)}")
        if len(token) >= 8 and token[:4].isalpha():
            out.append(f"head {token[:4]} {_class(token)}")
    return out


def _slot(text: str, start: int) -> tuple[list[str], str]:
    """The two words before the word that holds ``start``, and what of this word stands before it."""
    words, end = [], start
    begin = start
    while begin > 0 and not text[begin - 1].isspace():
        begin -= 1
    label = text[begin:start].strip(_EDGE)
    while begin > 0 and len(words) < 2:
        end = begin
        while end > 0 and text[end - 1].isspace():
            end -= 1
        begin = end
        while begin > 0 and not text[begin - 1].isspace():
            begin -= 1
        if begin < end:
            words.append(text[begin:end])
    return words[::-1], label


def _number(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def seeds_of(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, written: 128 bits of it, exact and random spans, and the seeds' slots."""

    @F.pandas_udf(
        "kind array<string>, start array<int>, end array<int>, token array<long>, patterns array<array<string>>"
    )
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            spans = base + random_spans(text, base)
            tokens = [_number(text[a:b].lower()) for _, a, b in spans]
            slots = [patterns_at(*_slot(text, a), text[a:b]) for _, a, b in spans]
            kinds, starts, ends = ([*c] for c in zip(*spans)) if spans else ([], [], [])
            rows.append((kinds, starts, ends, tokens, slots))
        return pd.DataFrame(rows, columns=["kind", "start", "end", "token", "patterns"])

    h0, h1 = long_hashes(F.col("doc_id"), F.col("text"))
    found = docs.select("doc_id", h0.alias("h0"), h1.alias("h1"), run(F.col("text")).alias("f"))
    spans = F.arrays_zip("f.start", "f.end", "f.kind")
    return written(
        found.select("doc_id", "h0", "h1", spans.alias("spans"), F.arrays_zip("f.token", "f.patterns").alias("seeds")),
        "seeds",
    )


class _Known:
    """Which patterns may be among given ones, and which words may stand in their slots; by bitmaps of fixed size.

    ``lefts`` and ``shapes`` know the words right before the slots of ``left`` and ``shape`` patterns, by their CRC-32.
    """

    def __init__(self, patterns: np.ndarray, lefts: np.ndarray, shapes: np.ndarray | None = None) -> None:
        self.patterns, self.lefts, self.shapes = patterns, lefts, lefts if shapes is None else shapes

    def pattern(self, pattern: str) -> int | None:
        number = _number(pattern)
        return number if self.patterns[number & (len(self.patterns) - 1)] else None

    def own(self, word: str) -> bool:
        """Whether the word's label, or its first characters, may make it a slot."""
        split = "=" in word or ":" in word
        if not split and (len(word) < 8 or _DIGITS.isdisjoint(word)):
            return False
        token = word.strip(_EDGE)
        cut = max(token.find("="), token.find(":"))
        if 0 < cut < len(token) - 1:
            if self.pattern(f"label {token[: cut + 1].lower()}") is not None:
                return True
            token = token[cut + 1 :].lstrip(_EDGE)
        return token[:4].isalpha() and not _DIGITS.isdisjoint(token)

    def wanted(self, words: list[str]) -> list[int]:
        """Places of the words that may stand in a slot of a known pattern, in order."""
        lines = "\n".join(words)
        numbers = np.fromiter(map(crc32, lines.lower().encode("utf-8", "surrogatepass").split(b"\n")), np.int64, len(words))
        places = {
            i + 1
            for i in np.flatnonzero(self.lefts[numbers & (len(self.lefts) - 1)]).tolist()
            if i and self.pattern(f"left {words[i - 1].lower()} {words[i].lower()}") is not None
        }
        for i, word in enumerate(words):
            if word.isalpha():
                continue
            before = i and self.shapes[numbers[i - 1] & (len(self.shapes) - 1)]
            if before and any(map(str.isdigit, word)) or self.own(word):
                places.add(i)
        return sorted(places)


def _places(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the words of a text begin and end."""
    ends = [*accumulate(len(w) + 1 for w in words)]
    if ends[-1] == len(text) + 1:  # one sign of white space between any two, and none around
        return [(end - 1 - len(w), end - 1) for end, w in zip(ends, words)]
    return [m.span() for m in _TOKEN.finditer(text)]


def slots_in(text: str, known: _Known) -> Iterator[tuple[int, int, list[int]]]:
    """``(start, end, patterns)`` of all that stands in a slot of a known pattern: a token, or a run of numbered ones."""
    words = text.split()
    wanted = known.wanted(words) if words else []
    if not wanted:
        return
    digits = _DIGITS.intersection
    places = _places(text, words)
    done = -1
    for i in wanted:
        if i >= len(places):
            break
        start, end = places[i]
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        cut = max(text.find("=", start, end), text.find(":", start, end))
        label = ""
        if start < cut < end - 1:
            label, start = text[start : cut + 1], cut + 1
            while start < end and text[start] in _EDGE:
                start += 1
        if start >= end or start < done:
            continue
        before = [text[a:b] for a, b in places[max(0, i - 2) : i]]
        # A number may be written in several tokens.
        last = i
        if digits(text[start:end]):
            while last + 1 < len(places) and digits(text[slice(*places[last + 1])]):
                last += 1
        whole = places[last][1]
        while last > i and text[whole - 1] in _EDGE:
            whole -= 1
        if last > i:
            runs = [(end, patterns_at(before, label, text[start:end])), (whole, patterns_at(before, label, text[start:whole]))]
        else:
            runs = [(end, patterns_at(before, label, text[start:end]))]
        for stop, patterns in reversed(runs):
            hits = [n for n in map(known.pattern, patterns) if n is not None]
            if hits:
                yield start, stop, hits
                done = stop
                break


def _bitmap(hashes: DataFrame, bits: int = PATTERN_BITS) -> np.ndarray:
    """``hash_filter`` as an array of flags; of a fixed size, whatever the number of hashes."""
    words = np.array(hash_filter(hashes, bits).first()[0], np.int64)
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def discover(
    docs: DataFrame, found: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT
) -> DataFrame:
    """``h0, h1, start, end`` of instances that trusted patterns find and no seed covers.

    Sums per pattern and per token are combined in the tasks before they are shuffled, so a
    frequent pattern is one row of each task. What tasks get to know of the patterns is three
    bitmaps of fixed size; joins then settle which ones were meant.
    """
    seeds = found.select(F.explode("seeds").alias("s")).select(
        F.col("s.token").alias("token"), F.explode("s.patterns").alias("pattern")
    )
    per_pattern = seeds.groupBy("pattern", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("seeds"), F.sum("n").alias("of_seeds")
    )
    candidates = per_pattern.where(F.col("seeds") >= support).withColumn("number", F.xxhash64("pattern"))
    candidates = written(candidates, "candidate-patterns")

    def before(patterns: DataFrame, kind: str, at: int) -> DataFrame:
        """Hashes of the words that stand right before the slots of patterns of a kind."""
        parts = F.split("pattern", " ")
        return patterns.where(parts[0] == kind).select(F.crc32(F.get(parts, at).cast("binary")).alias("h"))

    def scan(patterns: DataFrame, each, schema: str) -> DataFrame:
        known = [_bitmap(x) for x in (patterns.select("number"), before(patterns, "left", 2), before(patterns, "shape", 1))]
        h0, h1 = long_hashes(F.col("doc_id"), F.col("text"))

        def run(batches):
            yield from each(batches, _Known(*known))

        return docs.select(h0.alias("h0"), h1.alias("h1"), "text").where("text is not null").mapInPandas(run, schema)

    def count(batches, known: _Known):
        totals: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, _, patterns in slots_in(text, known):
                    totals.update(patterns)
        yield pd.DataFrame({"number": [*totals.keys()], "n": [*totals.values()]}, dtype="int64")

    def instances(batches, known: _Known):
        for batch in batches:
            rows = [
                (h0, h1, start, end, _number(text[start:end].lower()), patterns)
                for h0, h1, text in zip(batch["h0"], batch["h1"], batch["text"])
                for start, end, patterns in slots_in(text, known)
            ]
            yield pd.DataFrame(rows, columns=["h0", "h1", "start", "end", "token", "numbers"])

    totals = scan(candidates, count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    promising = candidates.join(totals, "number").where(F.col("of_seeds") >= PROMISE * F.col("n"))
    promising = written(promising.select("number", "pattern"), "promising-patterns")
    schema = "h0 long, h1 long, start int, end int, token long, numbers array<long>"
    places = written(scan(promising, instances, schema), "slots")
    met = places.select("token", F.explode("numbers").alias("number")).join(promising.select("number"), "number")
    known_seeds = seeds.select("token", F.xxhash64("pattern").alias("number")).join(promising.select("number"), "number")
    edges = met.withColumn("seed", F.lit(False)).unionByName(known_seeds.withColumn("seed", F.lit(True)))
    # A token that is a seed anywhere is one everywhere.
    seen = edges.groupBy("token", "number").agg(F.max("seed").alias("seed"))
    is_seed = seeds.select("token").distinct().withColumn("known", F.lit(True))
    edges = seen.join(is_seed, "token", "left").select("token", "number", F.coalesce("known", "seed").alias("seed"))
    edges = written(edges, "pattern-edges")
    scores = edges.groupBy("token").agg(F.max("seed").cast("double").alias("score"))
    trusted = None
    for _ in range(rounds):
        trusted = (
            edges.join(scores, "token")
            .groupBy("number")
            .agg(F.avg("score").alias("trust"), F.count_if("seed").alias("seeds"))
            .where((F.col("trust") >= confidence) & (F.col("seeds") >= support))
        )
        trusted = written(trusted.select("number", "trust"), "trusted-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))
        scores = (
            edges.join(trusted, "number", "left")
            .groupBy("token")
            .agg(
                F.when(F.max("seed"), 1.0)
                .otherwise(1 - F.coalesce(doubt, F.lit(1.0)))
                .alias("score")
            )
        )
        scores = written(scores, "instance-scores")
    new = (
        places.select("h0", "h1", "start", "end", "token", F.explode("numbers").alias("number"))
        .join(trusted.select("number"), "number")
        .join(scores.where(F.col("score") >= confidence).select("token"), "token")
    )
    new = written(new.select("h0", "h1", "start", "end").distinct(), "discovered")
    discard(candidates, promising, places, edges)
    return new


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def all_spans(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, base, spans`` and ``carry`` for each row of ``docs``: arrays of ``(start, end, kind)``.

    Exact matches (``base``) stay as they are; spans of the kinds ``secret`` and ``id`` are added where
    no other span lies. NULL texts count as empty; rows with NULL or repeated ids are rows of
    their own. Equal rows have equal spans. An empty table gives no rows.
    """
    found = seeds_of(docs)
    more = discover(docs, found).groupBy("h0", "h1").agg(
        F.collect_list(F.struct("start", "end", F.lit(FOUND).alias("kind"))).alias("more")
    )
    order = F.create_map(*(x for i, k in enumerate((*KINDS, SECRET, FOUND)) for x in (F.lit(k), F.lit(i))))

    def meets(s: Column, others: Column) -> Column:
        return F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))

    own = F.col("spans").cast(_SPANS)
    added = F.filter(F.coalesce("more", F.array().cast(_SPANS)), lambda s: ~meets(s, F.col("spans")))
    ordered = F.array_sort(
        F.transform(F.concat(own, added), lambda s: F.struct(s["start"], F.element_at(order, s["kind"]), s["end"], s["kind"]))
    )
    spans = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS))
    spanned = found.select("doc_id", "h0", "h1", "spans").join(more, ["h0", "h1"], "left")
    spanned = spanned.select("doc_id", "h0", "h1", base.alias("base"), spans.alias("spans"))
    if not carry:
        return spanned.drop("h0", "h1")
    # Rows with spans are few and narrow. Equal rows have equal spans, so one of them stands for all.
    some = spanned.where(F.size("spans") > 0).dropDuplicates(["h0", "h1"]).drop("doc_id")
    none = F.array().cast(_SPANS)
    h0, h1 = long_hashes(F.col("doc_id"), F.col("text"))
    return (
        docs.select("doc_id", *carry, h0.alias("h0"), h1.alias("h1"))
        .join(some, ["h0", "h1"], "left")
        .select("doc_id", *carry, F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def figures(docs: DataFrame) -> DataFrame:
    """Counts of exact matches, their digest, and all spans as text, for each row of ``docs``.

    NULL and empty texts, and rows without or with repeated ids, as for ``all_spans``.
    """
    found = all_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans go as one.

    A NULL text stays NULL; a text without spans, empty ones too, stays as it is.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, lists):
            if text is None or found is None or not len(found):
                out.append(text)
                continue
            parts, done = [], 0
            for s in found:
                if s["start"] >= done:
                    parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
                done = max(done, s["end"])
            out.append("".join([*parts, text[done:]]))
        return pd.Series(out, dtype=object)

    return run(text, spans)
