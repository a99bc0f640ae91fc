"""Text helpers: markers, tool names, tokens, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import fixed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_any(text: str | Column, markers: Sequence[str]) -> Column:
    """True when the lowercased text holds one of the markers."""
    lowered = F.lower(_col(text))
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def tool_name(label: str | Column) -> Column:
    """Label up to the first parenthesis or space, lowercased."""
    return F.lower(F.regexp_extract(_col(label), r"^([^( ]*)", 1))


def word_set(text: str | Column) -> Column:
    """Distinct lowercased words of letters, digits, ``/ . _``, at most 128 bytes each."""
    words = F.split(_col(text), r"[^\p{L}\p{N}\p{Nl}\p{No}/._]+")
    kept = F.filter(words, lambda w: (w != "") & (F.octet_length(w) <= 128))
    return F.array_distinct(F.transform(kept, F.lower))


def card_class(text: str | Column, kind: str | Column) -> Column:
    """Which list of a state card a text belongs to."""
    text = _col(text)
    return (
        F.when(has_any(text, fixed.ERROR_MARKERS), "errors")
        .when(has_any(text, fixed.OPEN_TASK_MARKERS), "open_tasks")
        .when(F.contains(text, F.lit("/")) | (_col(kind) == "tool_result"), "files_touched")
        .otherwise("decisions")
    )


def cut_bytes(text: str | Column, limit: int, keep: int, suffix: str) -> Column:
    """Text within ``limit`` bytes, else its longest whole-character prefix of ``keep`` bytes."""
    text = _col(text)
    raw = F.encode(text, "UTF-8")
    # A UTF-8 character has at most four bytes, so one of four cuts is a boundary:
    # the byte after the cut must not be a continuation byte (10xxxxxx).
    following = [F.hex(F.substring(raw, keep + 1 - back, 1)) for back in range(4)]
    end = F.coalesce(
        *[
            F.when(~following[back].rlike("^[89AB]"), F.lit(keep - back))
            for back in range(4)
        ],
        F.lit(keep - 3),
    )
    cut = F.decode(raw.substr(F.lit(1), end), "UTF-8")
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit(suffix))).otherwise(text)


def safe_label(value: str | Column) -> Column:
    value = _col(value)
    return (
        value.rlike(r"^[A-Za-z0-9_.:/-]{1,128}$")
        & ~F.contains(value, F.lit(".."))
        & ~F.startswith(value, F.lit("/"))
    )


def opaque_shape(value: str | Column) -> Column:
    value = _col(value)
    return value.rlike("^[0-9a-f]{64}$") & ~value.rlike("^0+$")
