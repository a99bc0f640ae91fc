"""What request values cost in characters: a spaced JSON dump, with each image at its estimated tokens instead of its payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import fixed
from palimpsest.functions import variant as v
from palimpsest.session import cut


def json_chars(value: Column) -> Column:
    """Characters of a value as JSON with a blank after each comma and colon between values; beyond ASCII nothing is escaped.

    Spark writes JSON without those blanks and with the same escapes; once escaped characters and then strings are gone, what is left of commas and colons stands between values.
    """
    text = F.to_json(value)
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    bare = F.regexp_replace(plain, '"[^"]*+"', "")
    return (F.char_length(text) + F.char_length(bare) - F.char_length(F.translate(bare, ",:", ""))).cast("long")


def image_payload(value: Column) -> Column:
    """The payload of an image block of any of three dialects; NULL where a value is none."""
    kind = v.string(value, "$.type")
    return F.when(kind == "image", v.string(value, "$.source.data")).when(
        kind.isin("input_image", "image_url"), F.coalesce(v.string(value, "$.image_url"), v.string(value, "$.image_url.url"))
    )


def payload_tokens(payload: Column) -> Column:
    """Tokens of an image, from the size in its header where it is a PNG or a GIF and is not hosted elsewhere; the fixed estimate otherwise."""
    inline = F.startswith(payload, F.lit("data:"))
    encoded = F.when(inline, F.when(F.contains(payload, F.lit(",")), F.substring_index(payload, ",", -1))).when(~F.contains(payload, F.lit("://")), payload)
    head = F.hex(F.try_to_binary(F.substring(encoded, 1, 32), F.lit("base64")))

    def number(*places: int) -> Column:
        """A whole number from bytes, the greatest first."""
        return F.conv(F.concat(*[F.substring(head, 2 * p + 1, 2) for p in places]), 16, 10).cast("long")

    png, gif = F.startswith(head, F.lit("89504E470D0A1A0A")), F.startswith(head, F.lit("47494638"))
    width = F.when(png, number(16, 17, 18, 19)).when(gif, number(7, 6))
    height = F.when(png, number(20, 21, 22, 23)).when(gif, number(9, 8))
    known = (width > 0) & (height > 0)
    cells = F.ceil(width / fixed.IMAGE_PATCH) * F.ceil(height / fixed.IMAGE_PATCH)
    return F.when(known, F.least(F.greatest(cells, F.lit(1)), F.lit(fixed.MAX_IMAGE_TOKENS))).otherwise(fixed.DEFAULT_IMAGE_TOKENS).cast("long")


def image_payloads(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys and payload of every image at any depth of a value; an image's own parts are not searched.

    Values are unfolded level by level, one round for each level of the deepest value that speaks of an image at all.
    """
    keys = list(keys)
    level = rows.select(*keys, F.col(value).alias("_v")).filter(F.to_json("_v").rlike('"type":"(?:image|input_image|image_url)"'))
    level = cut(level, "level")
    found = None
    while not level.isEmpty():
        told = level.withColumn("payload", image_payload(F.col("_v")))
        here = told.filter("payload is not null").select(*keys, "payload")
        found = here if found is None else found.unionByName(here)
        inner = told.filter("payload is null")
        names = ", ".join(f"`{k}`" for k in keys)
        parts = rows.sparkSession.sql(f"SELECT {names}, p.value AS _v FROM {{inner}}, LATERAL variant_explode(_v) AS p", inner=inner)
        kind = v.kind(F.col("_v"))
        level = cut(parts.filter(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))), "level")
    return rows.select(*keys, F.lit(None).cast("string").alias("payload")).limit(0) if found is None else found


def billable_chars(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``rows`` with ``billable_chars`` and ``est_tokens``, a fourth of them; ``keys`` identify a row."""
    keys = list(keys)
    images = image_payloads(rows, keys, value).groupBy(*keys).agg(
        F.sum(payload_tokens(F.col("payload")) * 4 - F.char_length("payload")).alias("_more")
    )
    chars = json_chars(F.col(value)) + F.coalesce("_more", F.lit(0))
    sized = rows.join(images, keys, "left").withColumn("billable_chars", chars.cast("long")).drop("_more")
    return sized.withColumn("est_tokens", F.floor(F.col("billable_chars") / 4).cast("long"))
