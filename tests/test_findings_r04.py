"""Tests of the findings of round 4."""

import random

from test_retention import CHECKS, FLAGS, TEXTS, brute

from palimpsest import fixed
from palimpsest.operators import retention as rt


def given(rng, sessions, texts, checks, words, long, short):
    """Texts and checks of random words; some checks are lines of texts, some with a word changed, some cut in the middle of words."""
    vocabulary = [f"{'the of word'.split()[i % 3]}{i}" if i % 5 else f"a{i}"[:3] for i in range(words)]
    said = [(rng.choice(sessions), r, rng.choice(["/content", "/text"]), rng.choice(["tool", "user"]), ", ".join(rng.choices(vocabulary, k=rng.randint(1, long)))) for r in range(texts)]
    out = []
    for n in range(checks):
        s, record, pointer, origin, text = rng.choice(said)
        parts = text.split(", ")
        a = rng.randrange(len(parts))
        parts = parts[a : a + rng.randint(1, short)]
        if n % 3 == 1:
            parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
        line = ", ".join(parts)
        line = line[n % 2 : len(line) - n % 5 // 4] if n % 4 == 3 else line
        out.append((s, f"c{n}", "fact", record + (n % 7 == 0), pointer, origin, False, line or "a"))
    return out, said


def test_blocks_and_parts_find_what_every_pair_finds(spark, monkeypatch):
    """many blocks, parts and rounds of words, checks looked for by words and in the texts themselves."""
    for name, value in {"CHECK_BYTES": 4000, "TEXT_BYTES": 8000, "READ_BYTES": 8000, "WORDS_AT_ONCE": 50, "SURE_WORDS": 2}.items():
        monkeypatch.setattr(rt, name, value)
    checks, texts = given(random.Random(4), ["s", "s", "t"], 200, 240, 60, 40, 12)
    hits = rt.check_hits(spark.createDataFrame(checks, CHECKS).repartition(3), spark.createDataFrame(texts, TEXTS).repartition(4), ["session_id"])
    got = {(r["session_id"], r["id"]): tuple(r[f] for f in FLAGS) for r in hits.collect()}
    want = brute(checks, texts)
    assert got == want
    assert all(20 < sum(w[i] for w in want.values()) < 235 for i in range(4))


def test_words_of_texts_are_sent_once(spark):
    """what meets checks is sent as hashes of content words and as the texts themselves, nothing else of the texts' size."""
    status = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    checks, texts = given(random.Random(6), ["s"], 400, 300, 4000, 1200, 60)
    left, right = spark.createDataFrame(checks, CHECKS).repartition(3), spark.createDataFrame(texts, TEXTS).repartition(4).localCheckpoint()
    bus.waitUntilEmpty()
    before = status.executorSummary("driver").totalShuffleWrite()
    got = {(r["session_id"], r["id"]): tuple(r[f] for f in FLAGS) for r in rt.check_hits(left, right, ["session_id"]).collect()}
    bus.waitUntilEmpty()
    sent = status.executorSummary("driver").totalShuffleWrite() - before
    size = sum(len(t[-1]) for t in texts)
    assert got == brute(checks, texts)
    assert sent < 2 * size


def replayed(texts, checks, policy, keep, rounds):
    """The study of one session, row by row: (arm, round) to what the round did and how many checks are literal, lexical, of their origin, and at their source."""
    size = lambda t: max((len(t.encode()) + 3) // 4, 1)
    elidable = {i for i, t in texts.items() if len(t.encode()) > 256}
    pinned = [c for c in sorted(checks, key=lambda c: (c["record"], c["id"])) if c["kind"] in rt.PINNED]
    carried, used = [], len(rt.CARD_SUMMARY)
    for c in pinned:
        used += len((line := c["text"] if c["kind"] == "open_task" else f"{c['kind']}: {c['text']}").encode())
        if used > fixed.MAX_CARD_BYTES:
            break
        carried.append((c["kind"], line))
    overhead = max((64 + len(rt.CARD_SUMMARY) + sum(len(t.encode()) for _, t in carried) + 3) // 4, 1)
    out = {}
    for arm in rt.ARMS:
        live, cards, gone, applied = dict(texts), [], set(), 0
        for n in range(1, rounds + 1):
            before = projected = sum(map(size, [*live.values(), *cards]))
            chosen = []
            if arm != "no_compaction" and before >= policy.trigger_tokens:
                rows = sorted(elidable - gone)
                for i in rows[: max(len(rows) - keep, 0)]:
                    saved = min(max((len(texts[i].encode()) + 3) // 4 - 24, 0), size(texts[i]))
                    if projected > policy.floor_tokens and saved and not (arm == "typed_masking" and i in {c["record"] for c in pinned}):
                        chosen.append(i)
                        projected = max(projected - saved, 0)
            if chosen and arm == "typed_digest":
                projected += overhead
            done = bool(chosen) and max(before - projected, 0) >= policy.min_savings_tokens
            if done:
                gone |= set(chosen)
                live |= {i: f"[output elided by palimpsest: {len(texts[i].encode())} bytes]" for i in chosen}
                if arm == "typed_digest":
                    lines = [f"{name}: {t}" for kind, name in (("procedure", "concept"), ("constraint", "decision"), ("open_task", "todo")) for k, t in carried if k == kind]
                    cards.append("\n".join(["[palimpsest state card]", f"summary: {rt.CARD_SUMMARY}", *lines, f"(covers {len(chosen)} earlier records)"]))
            applied += done
            slots = [("s", i, "/content", "tool", t) for i, t in live.items()] + [("s", -1, "/card", "user", t) for t in cards]
            held = brute([("s", c["id"], c["kind"], c["record"], "/content", "tool", False, c["text"]) for c in checks], slots).values()
            after = sum(map(size, [*live.values(), *cards]))
            out[arm, n] = ("applied" if done else "no_change", applied, before, after, len(carried) if done and arm == "typed_digest" else 0, *(sum(h[i] for h in held) for i in range(4)))
    return out


def test_study_arms_replay_rounds(spark, tmp_path, monkeypatch):
    """each arm has its own plan, and each round starts from what the last one left; a card holds pinned checks while they fit."""
    from palimpsest.operators.totals import session_totals
    from palimpsest.plans.base import prepare
    from palimpsest.plans.policy import Policy, with_policy
    from palimpsest.sources.tables import document_items

    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([5, 30, 60, 200]))) for i in range(40)}
    checks = []
    for n, i in enumerate(rng.sample(sorted(texts), 24)):
        part = texts[i].split()
        a = rng.randrange(len(part))
        checks.append({"id": f"c{n:02}", "kind": rt.KINDS[n % 6], "record": i, "text": " ".join(part[a : a + rng.randint(3, 9) * (9 if n % 6 < 3 else 1)])})
    spark.createDataFrame([(i, t, "s", "x", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = document_items(spark, str(tmp_path))
    slots = items.selectExpr("session_id", "line_index as record", "'/content' as pointer", "'tool' as origin", "substring(content, 6) as text")
    given = spark.createDataFrame([("s", c["id"], c["kind"], c["record"], "/content", "tool", False, c["text"]) for c in checks], CHECKS)
    seen = set()
    for floor, least, most in ((4500, 0, 1900), (3900, 700, 32 * 1024), (2400, 90_000, 32 * 1024)):
        policy = Policy(trigger_tokens=300, floor_tokens=floor, min_savings_tokens=least)
        monkeypatch.setattr(fixed, "MAX_CARD_BYTES", most)
        p = prepare(items, with_policy(session_totals(items), policy), 4)
        rows = rt.study_arms(slots, given, p, ["session_id"], 3).collect()
        got = {(r["arm"], r["round"]): tuple(r[c] for c in ("status", "applied_rounds", "context_before", "context_after", "card_items", "retained", "lexical_retained", "same_origin_retained", "source_bound_retained")) for r in rows}
        assert got == replayed(texts, checks, policy, 4, 3)
        seen |= {(k[0], v[1]) for k, v in got.items()}
    assert ("typed_digest", 2) in seen and ("observation_masking", 1) in seen and ("typed_masking", 0) in seen


def test_study_checks_are_bound_and_pinned(spark):
    """every check of the query names a document that holds it; pinned ones stay where their records or a card keep them."""
    from palimpsest.catalog import QUERIES

    rows = {(r["session_id"], r["arm"], r["round"]): r for r in QUERIES["study_arms"](spark, "/root/testdata/sf0.01").collect()}
    first = {arm: {s: r for (s, a, n), r in rows.items() if a == arm and n == 1} for arm in rt.ARMS}
    assert len(rows) == 160 and all(r["source_bound"] == r["literal"] == 1 for r in first["no_compaction"].values())
    assert any(r["source_bound"] > first["observation_masking"][s]["source_bound"] for s, r in first["typed_masking"].items())
    carried = first["typed_digest"]
    assert any(r["literal"] > first["observation_masking"][s]["literal"] for s, r in carried.items())
    assert all(r["source_bound"] == first["observation_masking"][s]["source_bound"] for s, r in carried.items())


def test_first_place_of_a_check(spark, monkeypatch):
    """a check is bound to the smallest place whose text holds it, however it is looked for."""
    for name, value in {"TEXT_BYTES": 8000, "READ_BYTES": 8000, "SURE_WORDS": 2}.items():
        monkeypatch.setattr(rt, name, value)
    checks, texts = given(random.Random(5), ["s", "s", "t"], 120, 150, 50, 30, 8)
    bound = rt.first_places(spark.createDataFrame(checks, CHECKS), spark.createDataFrame(texts, TEXTS), ["session_id"])
    got = {(r["session_id"], r["id"]): (r["record"], r["pointer"], r["origin"]) for r in bound.collect()}
    want = {(c[0], c[1]): min((t[1:4] for t in texts if t[0] == c[0] and c[-1] in t[4]), default=None) for c in checks}
    assert got == {k: v for k, v in want.items() if v}
    assert 50 < len(got) < 150


def test_sums_about_halfway_are_added_in_order(spark, tmp_path):
    """F1 to F4: sums of doubles that end in .5 are those of their SQL when it adds rows in the table's order, however the rows are dealt out."""
    import datetime

    import duckdb
    from compare import rows_of

    from palimpsest.catalog import ORACLES, QUERIES

    rng = random.Random(9)
    rows = []
    for user in range(300):
        cents = [rng.randint(1, 20_000) for _ in range(40)]
        cents[rng.randrange(40)] += (50 - sum(cents)) % 100 if user % 3 else 0
        rows += [(user, c / 100) for c in cents]
    rng.shuffle(rows)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=i), u, rng.choice(["error", "view", "click", "signup", "purchase"]), v, f'{{"k": {rng.randrange(100)}}}') for i, (u, v) in enumerate(rows)]
    frame = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.repartition(16, "props").write.parquet(f"{tmp_path}/events.parquet")
    frame.coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{tmp_path}/in_order")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/in_order/*.parquet'")
    for name in ("adapted_policy", "effective_trigger", "policy_layers", "session_report", "policy_decisions"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLES[name])
        assert rows_of(got.columns, got.collect()) == rows_of([d[0] for d in want.description], want.fetchall()), name
