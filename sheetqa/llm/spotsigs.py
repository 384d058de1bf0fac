"""SpotSigs fingerprints: chains of content words that follow common words.

A text becomes its letter runs in lower case. Common words are anchors, all others content. Each
content word that directly follows an anchor starts a chain of ``CHAIN`` content words, over
anchors in between; anchor and chain are one signature. Texts in languages without listed
anchors still need signatures, so a content word whose hash is 0 modulo ``SPARSE`` starts a chain
too. Where there is neither, all words are one signature. A fingerprint is the sorted set of
32-bit signatures; likeness is their Jaccard coefficient.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..store import written

# Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from has he in is it of on or that the this to was were with
auf das dem den der des die ein eine er im ist mit nicht sich sie und von zu
au aux avec dans de du elle en est et il la le les ne ou par pas pour que qui se sur un une
al como con del el es las lo los no para por su una y
""".split()
CHAIN = 2
SPARSE = 16
_LOWEST = -(1 << 63)


def words_of(text: Column) -> Column:
    """Letter runs in lower case, each between two single spaces; of NULL: one space."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower, r"\P{L}+", " ")), F.lit(" "))


def signatures(text: Column, chain: int = CHAIN, anchors: list[str] = ANCHORS) -> Column:
    """The set of signatures as ``array<int>``; empty only for a text without letters."""
    # Anchors are tied to the word after them, so a token's place counts content words.
    tied = F.regexp_replace(words_of(text), f"(?<= )({'|'.join(anchors)}) ", "$1|")
    tokens = F.split(F.btrim(tied), " ", -1)

    def signature(all_tokens: Column) -> Column:
        content = F.transform(all_tokens, lambda t: F.substring_index(t, "|", -1))

        def chains(words: Column) -> Column:
            def one(token: Column, i: Column) -> Column:
                parts = [F.get(words, i + k) for k in range(chain)]
                last = parts[-1]
                anchor = F.substring_index(F.substring_index(token, "|", -2), "|", 1)
                whole = last.isNotNull() & (last != "")
                return F.when(F.contains(token, F.lit("|")) & whole, F.hash(anchor, *parts)).when(
                    (F.pmod(F.hash(parts[0]), F.lit(SPARSE)) == 0) & whole, F.hash(*parts)
                )

            return F.array_distinct(F.array_compact(F.transform(all_tokens, one)))

        return let(content, chains)

    found = let(tokens, signature)
    return let(
        words_of(text),
        lambda w: let(
            found,
            lambda s: F.when(F.size(s) > 0, s)
            .when(F.length(w) > 2, F.array(F.hash(w)))
            .otherwise(F.array().cast("array<int>")),
        ),
    )


def fingerprint(signature_set: Column) -> Column:
    """The set as text: eight hexadecimal digits for each signature, in order."""
    digits = F.transform(
        F.array_sort(signature_set), lambda s: F.lpad(F.lower(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")
    )
    return F.array_join(digits, "")


def length_partition(size: Column, threshold: float) -> Column:
    """Sets whose Jaccard can reach ``threshold`` lie in the same or in adjacent partitions."""
    return F.when(size < 1, -1).otherwise(
        F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")
    )


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient; 0 without a look at the members if sizes alone keep it below ``least``.

    Two empty sets are equal (1), an empty and another are not alike (0).
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(
        F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n).cast("double")
    )
    return F.when(large == 0, 1.0).when(small < F.lit(least) * large, 0.0).otherwise(exact)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row that follows by descending ``key``; after the last: the first.

    NULL keys come last; rows with equal keys follow each other by the hashes of ``columns``.
    Rows are dealt out once, by ranges of the key that hold about equally many. The driver
    sees as many range ends as there are shuffle partitions. The first row of a range is dealt
    out twice, as the guest that ends the range before it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key), F.lit(_LOWEST))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    ends = docs.agg(F.percentile_approx(order, shares, 10_000)).first()[0]
    ends = sorted(set(ends or [])) or [0]
    coarse = ends[::64]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda e: e < order))

    def longs(values: list[int]) -> Column:
        return F.lit(values).cast("array<long>")

    start = F.greatest(below(longs(coarse)) - 1, F.lit(0)) * 64
    bucket = -(start + let(start, lambda s: below(F.slice(longs(ends), s + 1, F.lit(64)))))
    firsts = docs.groupBy(bucket.alias("bucket")).agg(F.max(order).alias("first")).orderBy("bucket").collect()
    guests = {row["first"]: firsts[i - 1]["bucket"] for i, row in enumerate(firsts)}
    guest_of = F.try_element_at(
        F.create_map(*(F.lit(x).cast("long") for pair in guests.items() for x in pair))
        if guests
        else F.create_map().cast("map<long,long>"),
        order,
    )
    places = F.array_compact(
        F.array(
            F.struct(bucket.cast("long").alias("bucket"), F.lit(False).alias("guest")),
            F.when(guest_of.isNotNull(), F.struct(guest_of.alias("bucket"), F.lit(True).alias("guest"))),
        )
    )
    dealt = docs.select(key, *columns, F.explode(places).alias("_at"))
    follow = Window.partitionBy("_at.bucket").orderBy(
        F.col("_at.guest"), F.col(key).desc_nulls_last(), F.xxhash64(*columns)
    )
    return dealt.select(
        key, "_at", *columns, *(F.lead(c).over(follow).alias(f"next_{c}") for c in columns)
    ).where(~F.col("_at.guest")).drop("_at")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last third of code points replaced by as many first ones of ``following``."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, and likenesses.

    One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_signatures, length_partition``. NULL texts count
    as empty. For NULL, repeated and equal ids see ``with_next``; a table of one row follows
    itself, an empty one gives no rows. Texts are shuffled once.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "sigs", signatures(F.col("text"))
    )
    pairs = with_next(own, "doc_id", ["text", "sigs"]).withColumn(
        "edited", edited_text(F.col("text"), F.col("next_text"))
    )
    signed = pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "sigs",
        "next_sigs",
        signatures(F.col("edited")).alias("edited_sigs"),
    )
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.size("sigs"), 0.8).alias("length_partition"),
    )


def similar_sets(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members ``(doc_id, set_id)`` and links ``(a, b, jaccard)`` of different signature sets.

    Equal sets meet as one. A set is compared only in its own and the adjacent length
    partition, and only with sets that share one of its rarest signatures: of two sets with
    Jaccard ``threshold`` or more, each has one of the common signatures among its
    ``size - ceil(threshold * size) + 1`` rarest. No link is lost, and no limit is set on a
    signature's sets. Sets without signatures have no links. NULL texts count as empty.
    """
    own = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    own = written(own.withColumn("set_id", F.sha2(fingerprint(F.col("sigs")), 256)), "signatures")
    sets = own.groupBy("set_id").agg(F.any_value("sigs").alias("sigs"))
    rows = sets.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("set_id").orderBy("df", "sig")
    kept = (
        rows.join(counts, "sig")
        .withColumn("rank", F.row_number().over(rarest))
        .where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1)
        .select("set_id", "sig", "n", length_partition(F.col("n"), threshold).alias("part"))
    )
    kept = written(kept, "prefixes")
    probe = kept.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    near = (
        probe.alias("x")
        .join(kept.alias("y"), ["sig", "part"])
        .where("x.set_id <> y.set_id and least(x.n, y.n) >= %r * greatest(x.n, y.n)" % (threshold - 1e-9))
        .select(
            F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")
        )
        .distinct()
    )
    found = (
        near.join(sets.select(F.col("set_id").alias("a"), F.col("sigs").alias("x")), "a")
        .join(sets.select(F.col("set_id").alias("b"), F.col("sigs").alias("y")), "b")
        .select("a", "b", jaccard(F.col("x"), F.col("y"), threshold - 1e-9).alias("jaccard"))
        .where(F.col("jaccard") >= threshold - 1e-9)
    )
    return own.select("doc_id", "set_id"), found
