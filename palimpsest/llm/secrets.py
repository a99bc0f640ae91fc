"""Secrets in texts: keywords first, then anchored expressions, then checksums.

One Aho-Corasick automaton finds all keywords of all rules in a pass over the text. A rule's expression is tried
only where a keyword begins, anchored there. Rules with an embedded checksum keep a match only if it holds. Runs of
hexadecimal digits have no keyword; one anchored scan over their characters finds them.

Base kinds (matches of one kind do not overlap; a match that fails its test still takes its characters):
``assign`` name and value of six characters or more, ``access`` key ids of 20 or more, ``hex`` runs of 24 or more.
Added kinds: ``forge`` and ``package``: tokens of 30 characters after a prefix, closed by a CRC-32 in six base-62 digits.

Inputs: null counts as empty; empty texts have no spans. Texts are taken whole, whatever their length. Equal rows
give equal rows. An empty table gives an empty result. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

import re
import string
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.text import chunks

BASE = ["assign", "access", "hex"]
ADDED = ["forge", "package"]
KINDS = BASE + ADDED

# Keywords of assignments, and prefixes of tokens that end in a CRC-32.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
FORGE_PREFIXES = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
PACKAGE_PREFIXES = ["npm_"]
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
CHECKED = re.compile(r"[a-z]{3}_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_TO_LOWER = {c: c + 32 for c in range(65, 91)}

SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def checksum_holds(body: str, digits: str) -> bool:
    """Whether six base-62 digits are the CRC-32 of the characters before them."""
    value = 0
    for c in digits:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def keywords():
    """Every keyword with its kind. Assignment words are lower-case and sought in the lowered text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("forge", FORGE_PREFIXES), ("package", PACKAGE_PREFIXES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lower_ascii(text: str) -> str:
    """Lower-case of equal length, at least for ASCII; a wrong keyword hit elsewhere fails its expression."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_TO_LOWER)


def spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of one text, in code points, by start and then by kind as listed."""
    out = []
    free = dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in automaton.iter(lower_ascii(text)))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, start):
                free[kind] = m.end()
                if m.end(1) - m.start(1) >= 6:
                    out.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                free[kind] = m.end()
                if m.end() - start >= 20:
                    out.append((kind, start, m.end()))
        elif (m := CHECKED.match(text, start)) and checksum_holds(m[1], m[2]):
            free[kind] = m.end()
            out.append((kind, start, m.end()))
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns with ``spans``: an array of (kind, start, end), in code points, end exclusive."""
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", SPAN)])

    def run(batches):
        automaton = keywords()
        for batch in chunks(batches, "__text"):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in spans(t, automaton)] if t else []
                for t in batch.column(batch.num_columns - 1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, ARROW_SPAN)], names=schema.names)

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
