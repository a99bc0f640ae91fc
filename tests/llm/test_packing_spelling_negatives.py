"""Packing, spelling variants and hard negatives against brute force and libraries; and on awkward input."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import negatives, packing, spelling, wordtokens
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="module")
def encoder(tokenizer):
    return wordtokens.WordTokens(open(tokenizer, encoding="utf-8").read())


ODD = ["Don't I'd we'LL it's 's", "x.y,z!? a.'s ..x", "<|endoftext|> <|ENDOFTEXT|> a", "é É İ K ẞ Σς", "a b c​d\x0b\x0c\x85e",
       "", None, "東京 123a4 \U0001f600 ퟿", "\x00 a\x00b", "  lead  trail  ", "a;̸ b≠c"]


@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=40), st.text(alphabet="aB'sS.,!? \n1é́<|", max_size=40)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_tokens_equal_the_library(encoder, library, texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, offsets = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_tokens_when_the_cache_empties(encoder, library, monkeypatch):
    monkeypatch.setattr(wordtokens, "CACHE_WORDS", 3)
    for texts in (["one two three four"], ["five one", "w" * 100], ["two " + "w" * 100]):
        ids, _ = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=30), st.sampled_from([(3, 64), (3, 16), (2, 7)]))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_rank_once(counts, shape):
    depth, classes = shape
    plan = packing.Plan(counts, 64, depth, classes)
    keys, lo, base, offset, per = plan.arrays()
    taken = defaultdict(set)
    for length, n in counts.items():
        for rank in range(n):
            at = np.searchsorted(keys, length << packing.RANK_BITS | rank, side="right") - 1
            i = rank - lo[at]
            start = int(offset[at] + i % per[at] * length)
            places = set(range(start, start + length))
            sequence = taken[int(base[at] + i // per[at])]
            assert not sequence & places
            sequence |= places
    assert all(t == set(range(len(t))) and len(t) <= 64 for t in taken.values())
    assert set(taken) == set(range(plan.used))
    total = sum(k * v for k, v in counts.items())
    assert -(-total // 64) <= plan.used <= 2 * total // 64 + 1


def test_plan_comes_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths, share in ((rng.integers(1, 4097, 50_000), 1.01), (np.minimum(rng.lognormal(6, 1, 50_000).astype(int) + 1, 4096), 1.002), (np.full(3000, 1365), 1.0)):
        values, n = np.unique(lengths, return_counts=True)
        assert packing.Plan(dict(zip(values.tolist(), n.tolist()))).used <= share * -(-int(lengths.sum()) // 4096) + 1


def test_nnls_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.integers(0, 3, (12, 30)).astype(float), rng.random(12) * 50
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-3 and np.abs(slope[x > 0]).max(initial=0) < 1e-3


def gapless(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark, library):
    got = QUERIES["op11_packing"](spark, SF).collect()
    n = gapless(got, 4096)
    assert n <= 1.02 * sum(r["length"] for r in got) / 4096 + 1
    want = set()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            want.add((d["doc_id"], k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)


def test_packing_edges_and_sequences(spark, edges, tokenizer, library, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2)
    parts = packing.pieces(edges, tokenizer, keep=["doc_id", "n", "score"], size=512)
    packed = packing.pack(parts.withColumn("offset", F.lit("clash")), size=512)
    rows = packed.collect()
    assert gapless(rows, 512) and {r["score"] for r in rows} == {"clash"}
    texts = {r["doc_id"]: r["text"] for r in edges.collect()}
    whole = defaultdict(list)
    for r in rows:
        whole[r["doc_id"], r["start"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert [i for (d, _), v in sorted((k, v) for k, v in whole.items() if k[0] == doc_id) for i in v[0]] == ids
    assert len(whole[6, 0]) == 2  # repeated rows stay
    placed = {(r["sequence_id"], r["offset"]): r["ids"] for r in rows}
    for s in packing.sequences(packed).collect():
        assert bytes(s["ids"]) == b"".join(bytes(placed[s["sequence_id"], o]) for o in s["starts"])
    assert packing.pack(packing.pieces(edges.limit(0), tokenizer, keep=["doc_id"])).isEmpty()
    with pytest.raises(ValueError, match="keep"):
        packing.pieces(edges, tokenizer, keep=["ids"])
    with pytest.raises(Exception, match="length is null"):
        packing.pack(spark.createDataFrame([(1, None), (2, 3)], "k int, length int")).collect()


# Spelling


def brute_near(words):
    out = defaultdict(set)
    for a in words:
        for b in words:
            if a != b and abs(len(a) - len(b)) <= 1:
                s, t = sorted((a, b), key=len)
                p = next((i for i, (x, y) in enumerate(zip(s, t)) if x != y), len(s))
                if s[p + (len(s) == len(t)) :] == t[p + 1 :]:
                    out[a].add(b)
    return out


@pytest.mark.parametrize("group", [20_000, 3])
def test_near_words(spark, group):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(500)} | {"a" * k for k in range(1, 12)} | {"x" * 2000, "x" * 2001, "x" * 1000 + "y" + "x" * 999}
    rows = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long")
    got = spelling.near_words(rows, group=group).collect()
    want = brute_near(words)
    assert len(got) == len({(r["word"], r["near"]) for r in got}) == sum(map(len, want.values()))
    assert all(r["near"] in want[r["word"]] and r["near_n"] == len(r["near"]) for r in got)


def test_forms_and_roots(spark):
    n = {"kitten": 5, "kittens": 60, "kittenss": 600, "kitte": 5, "sitting": 9, "sittinh": 9, "sittins": 1, "lone": 4, "mat": 10, "cat": 100, "bat": 100, "éa": 1, "éb": 10}
    got = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert len(got) == len(n)
    assert (got["kitten"]["form"], got["kitten"]["root"], got["kitten"]["form_n"]) == ("kittens", "kittenss", 60)
    assert got["kitte"]["form"] is None and got["kitte"]["root"] == "kitte" and got["kitte"]["n_near"] == 1
    assert got["mat"]["form"] == "bat" and got["sittins"]["form"] is None and got["éa"]["form"] == "éb"
    assert got["lone"]["n_near"] == 0 and got["lone"]["form_n"] is None


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZ éÀÿ×÷Ā.ß́\U0001f600", max_size=25)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_find_words(texts):
    data, at, points, row = spelling.find_words(pa.array(texts, pa.string()))
    got = [(int(i), bytes(data[a:b]).decode(), int(n)) for i, a, b, n in zip(row, at, at[1:], points)]
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    want = [(i, w.translate(lower), len(w)) for i, t in enumerate(texts) for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    assert got == want


@given(st.lists(st.tuples(st.integers(0, 2), st.text(alphabet="aéÿz", max_size=12)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_checksums(rows):
    prefixes = [b"1:", b"-99999999999:", b":"]
    words = pa.array([w for _, w in rows], pa.large_string())
    got = spelling.crc32_words(prefixes, words, np.array([i for i, _ in rows], int))
    assert got.tolist() == [zlib.crc32(prefixes[i] + w.encode()) for i, w in rows]


def test_spelling_edges(spark, edges):
    words = spelling.count_words(edges, least=4, change=spelling.drop_letters("doc_id", 2), keep=["doc_id"])
    want = defaultdict(int)
    for r in edges.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{w}".encode())
            if h % 2 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 4
    assert {r["word"]: r["n"] for r in words.collect()} == {w: n for w, n in want.items() if n}
    assert spelling.group_variants(spelling.count_words(edges.limit(0))).isEmpty()


# Hard negatives


def brute_negatives(rows, anchors, positives=5, negs=3, low=50, high=95):
    out = []
    for a, la, va in anchors:
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in rows if i != a and len(v) == len(va))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            found = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negs]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(found)]
    return sorted(out)


NEGATIVE = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("large", [1, 1 << 24])
def test_negatives_against_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(negatives, "BLOCK", 97)
    monkeypatch.setattr(negatives, "PART", 13)
    monkeypatch.setattr(negatives, "CLUSTER", 8)
    monkeypatch.setattr(negatives, "CELL", 5)
    monkeypatch.setattr(negatives, "STEP", 16)
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 4)), [int(x) * large for x in rng.integers(-9, 10, 6)]) for i in range(600)]
    rows += [(600 + i, i % 2, [5 * large] * 6) for i in range(60)]  # many ties
    rows += [(700 + i, i % 3, [0] * 6) for i in range(20)] + [(800 + i, i % 2, [i, 1, i]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").repartition(5)
    got = negatives.mine(df, F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.select(NEGATIVE).collect()) == brute_negatives(rows, [r for r in rows if r[0] % 5 == 0])


def test_lists_end_early():
    """A member stops once its result is certain: on directed data most of the list is never read."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 16))
    v = np.rint(100 * (base[rng.integers(0, 8, 8192)] + 0.05 * rng.normal(size=(8192, 16)))).astype(np.int64)
    block = negatives.Block(np.arange(8192), np.zeros(8192, np.int64), v)
    members = v[np.flatnonzero(((v - np.rint(100 * base[3])) ** 2).sum(1) < 40_000)[:50]]
    best = negatives.Best(len(members), 5)
    taken = negatives.walk(block, members, lambda rows, s, c: best.add(rows, s, np.ones_like(s, bool), block.ids[c]), best.certain)
    order = np.lexsort((np.broadcast_to(np.arange(8192), (len(members), 8192)), -(members @ v.T)))
    assert (best.ids == order[:, :5]).all() and taken < 0.5 * len(members) * 8192


def test_negatives_edges(spark):
    rows = [(0, 1, [1, 2]), (0, 1, [1, 2]), (5, None, [1, 2]), (10, 1, None), (None, 1, [1, 2]), (15, 1, [1, None]), (1, 1, [4, 4]), (1, 1, [4, 4]), (2, 2, [3, 3]), (3, 2, []), (25, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    for name in ("id", "v", "key", "cell", "part", "block", "width", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 5 == 0).select(NEGATIVE).collect())
    assert got == [(0, 1, 1, 2, 12, 9)] * 2  # two rows with id 1; equal anchors answered once
    assert negatives.mine(df.limit(0), F.col("vec_id") % 5 == 0).isEmpty() and negatives.mine(df, F.lit(False)).isEmpty()
