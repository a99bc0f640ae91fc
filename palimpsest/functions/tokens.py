"""Token and size estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_of_bytes(n: str | Column) -> Column:
    """Bytes over four, rounded up, at least one."""
    n = _col(n).cast("long")
    return F.greatest(F.expr("1L"), F.floor((n + 3) / 4).cast("long"))


def est_tokens(text: str | Column) -> Column:
    return tokens_of_bytes(F.octet_length(_col(text)))


def is_elidable(tokens: str | Column = "est_tokens", size: str | Column = "elidable_bytes") -> Column:
    return F.coalesce((_col(tokens) > 0) & (_col(size) > 0), F.lit(False))


def elision_savings(
    tokens: str | Column = "est_tokens",
    size: str | Column = "elidable_bytes",
    parts: str | Column = "elidable_parts",
) -> Column:
    """Tokens an elision frees: payload less stub, within the record's own estimate."""
    tokens, size, parts = _col(tokens), _col(size), _col(parts)
    stub = tokens_of_bytes(F.greatest(parts, F.lit(1)).cast("long") * fixed.STUB_BYTES_PER_PART)
    freed = F.greatest(tokens_of_bytes(size) - stub, F.lit(0))
    return F.when(is_elidable(tokens, size), F.least(freed, tokens)).otherwise(F.lit(0)).cast("long")


def elidable_tokens(
    tokens: str | Column = "est_tokens", size: str | Column = "elidable_bytes"
) -> Column:
    return F.when(is_elidable(tokens, size), tokens_of_bytes(size)).otherwise(F.lit(0)).cast("long")


def image_tokens(width: str | Column, height: str | Column) -> Column:
    """Tokens of an image of known size; the fixed estimate when the size is unknown."""
    w, h = _col(width), _col(height)
    cells = F.ceil(w / 28) * F.ceil(h / 28)
    return F.when(cells.isNotNull(), F.least(F.lit(4784), cells)).otherwise(1568).cast("long")
