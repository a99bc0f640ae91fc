"""Digests, keyed ids and the rollout bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256(c: str | Column) -> Column:
    return F.sha2(_col(c), 256)


def is_sha256(c: str | Column) -> Column:
    return _col(c).rlike("^[0-9a-f]{64}$")


def fingerprint(values: str | Column) -> Column:
    """Digest of a list: equal lists give equal digests, whatever the split of text."""
    framed = F.transform(
        _col(values),
        lambda v: F.concat(F.octet_length(v).cast("string"), F.lit(":"), v),
    )
    return F.sha2(F.concat_ws("", framed), 256)


def keyed_id(key: bytes, domain: str, native: str | Column) -> Column:
    """HMAC-SHA256 of ``domain NUL native`` under ``key``, in hex."""
    if len(key) > 64:
        raise ValueError("key longer than one hash block")
    padded = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in padded))
    outer = F.lit(bytes(b ^ 0x5C for b in padded))
    message = F.concat(F.lit(domain.encode() + b"\0"), F.encode(_col(native), "UTF-8"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def rollout_bucket(session_id: str | Column) -> Column:
    """First eight digest bytes of the id, modulo 100."""
    head = F.substring(F.sha2(_col(session_id), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % 100).cast("int")


def rollout_cohort(session_id: str | Column, percent: str | Column) -> Column:
    """``treatment`` under the percentage, ``control`` at or over it, NULL when ungated."""
    percent = _col(percent)
    return F.when(
        percent.isNotNull(),
        F.when(rollout_bucket(session_id) < percent, "treatment").otherwise("control"),
    )


def normalized_session_id(raw: str | Column) -> Column:
    """The 128-bit id inside a native id, or a stable digest of the id.

    The digest is MD5 of the raw id: opaque, so only equality has meaning.
    """
    raw = _col(raw)
    lowered = F.lower(F.trim(raw))
    runs = F.transform(
        F.regexp_extract_all(lowered, F.lit("([0-9a-f-]+)"), 1),
        lambda r: F.regexp_replace(r, "-", ""),
    )
    fits = F.filter(runs, lambda r: (F.length(r) == 32) & ~r.rlike("^0+$"))
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.md5(raw))


def position_digest(position: str | Column, digest: str | Column) -> Sequence[Column]:
    """Two 60-bit numbers of (position, digest).

    Their running sums identify a prefix of a list, and unlike a chained hash they
    can be summed in any order and on any number of tasks.
    """
    bound = F.sha2(F.concat_ws(":", _col(position).cast("string"), _col(digest)), 256)
    return [
        F.conv(F.substring(bound, start, 15), 16, 10).cast("decimal(38,0)") for start in (1, 16)
    ]
