"""Personal data: base expressions as seeds, and identifiers that the seeds' contexts lead to.

Seeds are spans of four base kinds: email, ip, card, phone. A pattern is the context in which a token stands (the two
words before it, or one word and its shape). Patterns and instances (the tokens) form a graph, whose edges Spark counts
over all documents. In each round, a pattern's confidence for a kind is the share of its tokens known to be of
that kind, if ``MIN_SEEDS`` different ones are; an instance's confidence is the chance that not all of its patterns
err. Instances of ``CONFIDENT`` or more join the kind and strengthen their patterns in the next round, until a round brings none. Tokens found
so become spans of kind ``like_email`` and so on. Base spans always stay.

Only tokens that look like identifiers take part (four digits or more, or a sign between words that stands for an
at sign), and never those that touch a base span: without that, a frequent word would bring in common text.

Inputs: null counts as empty; empty texts have no spans. Texts are taken whole. Equal rows stay rows of their own. An
empty table gives an empty result. Columns not in ``keep`` are ignored; ``mask`` keeps all, whatever their names. Long tokens
and contexts are told apart by their digests. Spans of different kinds may overlap; each stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.secrets import ARROW_SPAN, SPAN
from palimpsest.llm.text import chunks
from palimpsest.session import cut

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"like_{k}" for k in BASE)]

MIN_SEEDS = 5
CONFIDENT = 0.9
MAX_TOKEN = 64

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S*[0-9@\[(]\S*")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W\d_]+")
AT_LIKE = re.compile(r"[A-Za-z0-9._%+-]+(?:\[at\]|\(at\)|@)[A-Za-z0-9-]+", re.IGNORECASE)
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

CANDIDATE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("token", T.StringType()),
            T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("kind", T.StringType()),
        ]
    )
)
ARROW_CANDIDATE = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("patterns", pa.list_(pa.string())), ("kind", pa.string())])
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """A match holds one at sign: around each, the local characters before it and the domain after it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out = []
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((at, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out + [("phone", a, b) for a, b in phones(text)]


def shape(token: str) -> str:
    """Digits as 0, letters as a, runs of either folded into one."""
    return re.sub(r"a+", "a", re.sub(r"0+", "0", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", token))))


class Words:
    """The words of a text, found once, and those that end before a place."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in WORD.finditer(text)]
        self.ends = [b for _, b in self.spans]

    def before(self, start: int) -> list[str]:
        """The last two."""
        n = bisect_right(self.ends, start)
        return [self.text[a:b].lower() for a, b in self.spans[max(0, n - 2) : n]]


def patterns(words: Words, start: int, token: str) -> list[str]:
    """Contexts of a token: the two words before it; the word before it with the token's shape."""
    before = words.before(start)
    if not before:
        return []
    out = [short(f"{before[-1]} <{shape(token)}>")]
    if len(before) == 2:
        out.append(short(" ".join(before)))
    return out


def short(text: str) -> str:
    """A text, or the digest of a long one: equal texts stay equal."""
    return text if len(text) <= MAX_TOKEN else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds with their kind, and tokens that look like identifiers and touch no seed, without."""
    words = lru_cache(1)(lambda: Words(text))  # found only if there is a candidate
    seeds = sorted((a, b, k) for k, a, b in base)
    out = [
        {"start": a, "end": b, "token": short(text[a:b].lower()), "patterns": patterns(words(), a, text[a:b]), "kind": k}
        for a, b, k in seeds
    ]
    i = 0
    for m in TOKEN.finditer(text):
        raw = m[0].strip(".,;:!?\"'()[]<>")
        a = m.start() + m[0].find(raw) if raw else m.start()
        b = a + len(raw)
        while i < len(seeds) and seeds[i][1] <= a:
            i += 1
        touches = any(s[0] < b and s[1] > a for s in seeds[i : i + 4])
        if touches or not raw or "=" in raw:
            continue
        if sum(c.isdigit() for c in raw) >= 4 or AT_LIKE.fullmatch(raw):
            out.append({"start": a, "end": b, "token": short(raw.lower()), "patterns": patterns(words(), a, raw), "kind": None})
    return out


def _read(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("__base", SPAN), T.StructField("__found", CANDIDATE)])

    def run(batches):
        for batch in chunks(batches, "__text"):
            base, found = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spans = base_spans(t) if t else []
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                found.append(candidates(t, spans) if t else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(base, ARROW_SPAN), pa.array(found, ARROW_CANDIDATE)], names=schema.names
            )

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)


def score_graph(edges: DataFrame) -> DataFrame:
    """(token, kind, confidence) of the instances that the patterns lead to.

    ``edges`` holds (pattern, token, kind, n): how often a token stands in a pattern; kind is null unless it is a seed.
    Patterns and tokens meet in joins and sums; a frequent pattern is pre-aggregated before it moves.
    """
    unknown = edges.where(F.col("kind").isNull()).select("pattern", "token", "n")
    known = edges.where(F.col("kind").isNotNull()).select("pattern", "token", "kind", F.lit(1.0).alias("confidence"), "n")
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("total"))
    seen, round_ = None, 0
    while True:
        held = known.groupBy("pattern", "kind").agg(F.count("*").alias("seeds"), F.sum(F.col("confidence") * F.col("n")).alias("sure"))
        trusted = (
            held.where(F.col("seeds") >= MIN_SEEDS)
            .join(totals, "pattern")
            .select("pattern", F.col("kind").alias("for_kind"), (F.col("sure") / F.col("total")).alias("trust"))
            .where(F.col("trust") >= 0.5)
        )
        # The chance that every pattern errs, as a sum of logarithms; a pattern is at most 0.99 sure.
        reached = (
            unknown.join(trusted, "pattern")
            .groupBy("token", "for_kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.99)))))).alias("confidence"))
            .where(F.col("confidence") >= CONFIDENT)
        )
        best = reached.groupBy("token").agg(
            F.max(F.struct("confidence", F.col("for_kind").alias("kind"))).alias("b")
        ).select("token", "b.kind", "b.confidence")
        found = cut(best, f"pii-round-{round_}")
        new = found if seen is None else found.join(seen, "token", "left_anti")
        if new.isEmpty():
            return found
        seen = new.select("token") if seen is None else cut(seen.unionByName(new.select("token")), f"pii-seen-{round_}")
        more = unknown.join(found, "token").select("pattern", "token", "kind", "confidence", "n")
        known = edges.where(F.col("kind").isNotNull()).select("pattern", "token", "kind", F.lit(1.0).alias("confidence"), "n").unionByName(more)
        round_ += 1


def find_personal(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``: arrays of (kind, start, end) in code points, end exclusive.

    ``keep`` may not hold ``base`` or ``spans``.
    """
    clash = {"base", "spans"} & set(keep)
    if clash:
        raise ValueError(f"keep may not hold {sorted(clash)}")
    return _find(docs, text, keep).select(*keep, F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def _find(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``__base`` and ``__spans``."""
    rows = cut(_read(docs, text, keep).withColumn("__row", F.monotonically_increasing_id()), "pii-rows")
    each = rows.select("__row", F.explode("__found").alias("c")).select("__row", "c.*")
    edges = cut(
        each.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "token", "kind").groupBy("pattern", "token", "kind").agg(F.count("*").alias("n")),
        "pii-edges",
    )
    found = score_graph(edges).select("token", F.concat(F.lit("like_"), F.col("kind")).alias("as_kind"))
    more = (
        each.where(F.col("kind").isNull())
        .join(found, "token")
        .groupBy("__row")
        .agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("__more"))
    )
    # One list holds the spans of one document only.
    every = F.concat("__base", F.coalesce("__more", F.array().cast(SPAN)))
    return rows.join(more, "__row", "left").select(*keep, "__base", ordered(every).alias("__spans"))


def ordered(spans: Column) -> Column:
    """By kind as listed, then by start."""
    places = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        spans, lambda s: F.struct(F.array_position(places, s["kind"]).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def mask(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The same columns, with every span of the text replaced by its kind in angle brackets; overlaps become one."""
    names = docs.columns
    kept = docs.select(*names)
    found = _find(kept, text, names)
    schema = kept.schema
    at = names.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                out.append(t if not spans else _masked(t, [(s["start"], s["end"], s["kind"]) for s in spans]))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.select(*names, "__spans").mapInArrow(run, schema)


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])
