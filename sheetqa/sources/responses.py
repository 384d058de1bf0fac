"""Model answers: from raw text to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, js_trim, let

# Full-width marks that stand for JSON structure, and quotes that open a string.
STRUCTURE = ("，、：；（）｛｝［］", ",,:;(){}[]")
OPENING_QUOTES = "\"“”『』＂"
# A string to its closing quote or the text's end, a bracket, or what lies between these.
_TOKEN = rf"""(?s)[{OPENING_QUOTES}][^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[\[\]［］]|[^{OPENING_QUOTES}\[\]［］]+"""


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)```json|```", "")


def repair_json(text: Column) -> Column:
    """Full-width marks outside strings as JSON's own, and of the text the first whole array.

    One regular expression cuts the text into strings, brackets and what lies between. Any quote
    opens a string, only the ASCII one ends it. Folded over the brackets alone, the depth tells
    where the first outermost array ends; without one the text stays whole.
    """

    def mended(tokens: Column) -> Column:
        each = F.transform(
            tokens,
            lambda t: F.when(t.rlike(f"^[{OPENING_QUOTES}]"), F.concat(F.lit('"'), F.substr(t, F.lit(2)))).otherwise(
                F.translate(t, *STRUCTURE)
            ),
        )

        def cut(parts: Column) -> Column:
            brackets = F.filter(
                F.transform(parts, lambda t, i: F.struct(i.alias("at"), (t == "[").alias("opens"), (t == "]").alias("closes"))),
                lambda x: x["opens"] | x["closes"],
            )
            none = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("start"), F.lit(-1).alias("end"))

            def step(acc: Column, x: Column) -> Column:
                found = acc["end"] >= 0
                return F.struct(
                    (acc["depth"] + F.when(x["opens"], 1).otherwise(-1)).alias("depth"),
                    F.when(~found & x["opens"] & (acc["depth"] == 0), x["at"]).otherwise(acc["start"]).alias("start"),
                    F.when(~found & x["closes"] & (acc["depth"] == 1), x["at"]).otherwise(acc["end"]).alias("end"),
                )

            def joined(span: Column) -> Column:
                inside = F.slice(parts, span["start"] + 1, span["end"] - span["start"] + 1)
                return F.array_join(F.when(span["end"] >= 0, inside).otherwise(parts), "")

            return let(F.aggregate(brackets, none, step), joined)

        return let(each, cut)

    return let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), mended)


def _listed(text: Column) -> Column:
    """The text of a JSON array, or of the ``records`` array of an object; NULL unless it is whole."""
    array = let(
        js_trim(text),
        lambda t: F.when(t.startswith("["), t).otherwise(F.get_json_object(t, "$.records")),
    )
    return let(array, lambda a: F.when(F.json_array_length(a).isNotNull(), a))


def _records(listed: Column) -> Column:
    """Records of a JSON array; NULL for an item that is no object.

    Of members with the same name the last counts, as in any JSON object.
    """

    def last_members(record: Column) -> Column:
        return let(
            F.map_keys(record),
            lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), record).otherwise(
                F.map_from_entries(
                    F.filter(
                        F.map_entries(record),
                        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]),
                    )
                )
            ),
        )

    def item(text: Column) -> Column:
        parsed = F.from_json(text, "map<string,string>")
        return F.when(F.ltrim(text).startswith("{"), let(parsed, last_members))

    return F.transform(F.from_json(listed, "array<string>"), item)


def parse_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add ``records`` (array of maps) and ``error`` to answers.

    Most answers are plain JSON. Only those that fail are repaired and parsed once more. One scan
    does it all, in the JVM.
    """
    staged = responses.withColumn("_plain", strip_fences(F.col(text)))
    staged = staged.withColumn("_listed", _listed(F.col("_plain")))
    broken = F.when(F.col("_listed").isNull(), js_trim(F.col("_plain")))
    staged = staged.withColumn("_fixed", F.when(F.col("_listed").isNull(), repair_json(broken)))
    staged = staged.withColumn("_listed", F.coalesce("_listed", _listed(F.col("_fixed"))))
    parsed = F.col("_listed").isNotNull()
    blank = ~F.coalesce(has_text(F.coalesce("_fixed", "_plain")), F.lit(False))
    error = (
        F.when(parsed, "")
        .when(blank, "API returned empty response.")
        .otherwise("Failed to parse model JSON")
    )
    return (
        staged.withColumn("records", _records(F.col("_listed")))
        .withColumn("error", error)
        .drop("_plain", "_listed", "_fixed")
    )


def response_rows(parsed: DataFrame, by: list[str]) -> DataFrame:
    """Records as rows: ``(by…, seq, record)``."""
    return parsed.select(*by, F.posexplode("records").alias("seq", "record"))


_CHUNKS = "choices array<struct<message:struct<content:array<struct<text:string,content:string>>>>>"


def message_content(body: Column) -> Column:
    """Content of a chat answer: a string, or chunks joined by line breaks."""
    chunks = F.get(F.from_json(body, _CHUNKS)["choices"], 0)["message"]["content"]
    joined = F.array_join(
        F.transform(chunks, lambda x: F.coalesce(x["text"], x["content"], F.lit(""))), "\n"
    )
    plain = F.get_json_object(body, "$.choices[0].message.content")
    return F.coalesce(joined, plain)


def proxy_records(body: Column) -> Column:
    """Record array (JSON text) of a proxy answer: bare, or under records, data or result."""
    t = js_trim(body)
    listed = F.when(t.startswith("["), t).otherwise(
        F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ("records", "data", "result")])
    )
    return F.when(F.json_array_length(listed).isNotNull(), listed)


def flatten_content(body: Column) -> Column:
    """Text that holds the records, from a chat answer or a proxy answer."""
    return F.coalesce(message_content(body), proxy_records(body))
