"""Tests of the findings of round 3."""

import random

from compare import check, duck

from palimpsest import fixed
from palimpsest.operators import retention as rt


def test_words_meet_in_blocks_without_pairs(spark, monkeypatch):
    """Checks and texts in several blocks and parts find what comparing all of them finds."""
    monkeypatch.setattr(rt, "CHECKS_PER_BLOCK", 20, raising=False)
    monkeypatch.setattr(rt, "BYTES_PER_PART", 2_000, raising=False)
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    pick = lambda n: " ".join(rng.sample(words, n))
    checks = [(s, str(i), i, "/p", "tool", pick(rng.randint(1, 9))) for s in ("a", "b", None) for i in range(40)] + [("a", "none", 99, "/p", "tool", "a of it")]
    texts = [(s, i, "/p", "tool", pick(rng.randint(1, 14)) if i else None) for s in ("a", "b", None) for i in range(60)]
    got = rt.check_hits(
        spark.createDataFrame(checks, "s string, id string, record long, pointer string, origin string, text string"),
        spark.createDataFrame(texts, "s string, record long, pointer string, origin string, text string"), ["s"],
    )
    made = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in made
    held = {(s, i) for s, i, *_, c in checks for t, *_, text in texts if s and s == t and text and len(set(c.split()) & set(text.split())) >= 0.75 * len(set(c.split())) and i != "none"}
    assert {(r.s, r.id) for r in got.filter("lexical").collect()} == held
    assert 0 < len(held) < 80


def test_lines_that_must_stay_of_a_long_session(spark, monkeypatch):
    """A session of more items than one plan may have adds no reason to those its SQL names."""
    monkeypatch.setattr(fixed, "MAX_ITEMS", 10)
    check(spark, duck("/root/testdata/sf0.01"), "plan_findings", "/root/testdata/sf0.01")


def test_scores_carry_no_words_to_a_label(spark, monkeypatch):
    """A label's rows meet its latest words word by word: no joined row holds a list of words, and near rows are still found."""
    from palimpsest.catalog.planning import documents
    from palimpsest.plans import scores

    p = documents(spark, "/root/testdata/sf0.01")
    frame = scores.heuristic_scores(p.items, p.sessions, p.unprotected)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_latest_words" not in plan and "array_intersect" not in plan
    check(spark, duck("/root/testdata/sf0.01"), "heuristic_scores", "/root/testdata/sf0.01")
    given = [("p", "s", "x", i, "tool_result", "read", t, None, None) for i, t in enumerate(
        [" ".join(f"w{j}" for j in range(19)), "other words here", " ".join(f"w{j}" for j in range(20)), "quite another text", " ".join(f"w{j}" for j in range(20))])]
    items = spark.createDataFrame(given, "provider string, session_id string, path string, line_index long, kind string, label string, summary string, uuid string, parent_uuid string")
    keys = ["provider", "session_id", "path"]
    rows = lambda: {r.line_index: r.keep_probability for r in scores.heuristic_scores(items, items.select(*keys).distinct(), items).collect()}
    near = rows()
    monkeypatch.setattr(scores, "NEAR", 2.0)
    assert {i for i, v in rows().items() if v > near[i]} <= {0, 2}
    assert rows()[2] > near[2]


def test_checks_are_read_before_elidable_records_are_met(spark):
    """Texts are not joined: the join lies above the lines' explode. Elidable records, though named twice, go first."""
    texts = spark.createDataFrame([("a", i, "/p", "tool", f"  Decision: {i}  \nnothing") for i in range(3)], "s string, record long, pointer string, origin string, text string")
    elidable = spark.createDataFrame([("a", 2), ("a", 2)], "s string, record long")
    out = rt.build_checks(texts, elidable, ["s"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Generate")
    assert [(r.id, r.record, r.elidable, r.text) for r in out.orderBy("id").collect()] == [
        ("check-fact-1", 2, True, "Decision: 2"), ("check-fact-2", 0, False, "Decision: 0"), ("check-fact-3", 1, False, "Decision: 1")]


def test_what_is_known_of_a_session_meets_no_words(spark):
    """F8, F9, F10: no join of scores is by session alone once words are rows, so a session's words never gather in one task."""
    from palimpsest.catalog.planning import documents
    from palimpsest.plans import scores

    p = documents(spark, "/root/testdata/sf0.001")
    out = scores.heuristic_scores(p.items, p.sessions, p.unprotected)
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: min(line.find(c) for c in "+-" if c in line) if any(c in line for c in "+-") else 0
    for i, line in enumerate(lines):
        if "Join " not in line or "line_index" in line or "_word" in line or "label" in line:
            continue
        # Joins by session alone: what lies below them is grouped to rows before words come.
        below = []
        for deeper in lines[i + 1:]:
            if depth(deeper) <= depth(line):
                break
            below.append(deeper)
        if any("Generate explode(_words" in x for x in below):
            grouped = [j for j, x in enumerate(below) if "Aggregate" in x]
            assert grouped and min(grouped) < next(j for j, x in enumerate(below) if "Generate explode(_words" in x), line


def test_keyed_streams_keep_whole_numbers_beside_nulls(spark):
    """F15, F16: rows wait packed and pass as rows, not frames: a number above 2 ** 53 in a batch with nulls comes out exact, and so does its change."""
    from test_streams import SAMPLES, replay

    from palimpsest.streaming import keyed

    big = 2**53 + 1
    rows = [("codex", "a", 1_700_000_000_000 + i, i, "s", "reported", v, v) for i, v in enumerate([big + 4, None, big, big + 2])]
    got = replay(spark, keyed.monitor_stream, [rows[:2] + rows[2:3], rows[3:]], SAMPLES, "4 days").orderBy("seq").collect()
    assert [r.context_tokens for r in got] == [big + 4, None, big, big + 2]
    assert [r.native_applied_delta for r in got] == [None, None, None, 2]


def test_append_shuffles_hashes_only(spark, monkeypatch):
    """Rows of an append meet by numbers: neither ids nor bodies are written or shuffled, and each rule still names its event."""
    from pyspark.sql import functions as F

    from palimpsest.operators.observe import with_digest
    from palimpsest.sources import observations as store
    from palimpsest.sources.tables import observations

    written = []
    plain = store.cut
    monkeypatch.setattr(store, "cut", lambda df, name="cut": (written.append((name, df.schema)), plain(df, name))[1])
    base = plain(observations(spark, "/root/testdata/sf0.001").drop("observed_at").filter("kind <> 'tool_observed'"))
    ended = base.filter("kind = 'request_finished'").orderBy("sequence")
    held = with_digest(base.join(ended.limit(3).select("event_id"), "event_id"))
    one, two, three = [base.filter(F.col("event_id") == r.event_id) for r in held.select("event_id").orderBy("event_id").collect()]
    other_body = one.withColumn("observed_at_ms", F.col("observed_at_ms") + 1)
    second_end = two.withColumn("event_id", F.lit("second"))
    other_maker = three.withColumns({"event_id": F.lit("maker"), "kind": F.lit("context_decision"), "identity": F.col("identity").withField("session_id", F.lit("x"))})
    free = one.withColumns({"event_id": F.lit("free"), "kind": F.lit("context_decision")})
    rows = lambda df: sorted(map(tuple, df.collect()))
    fits = store.append_observations(with_digest(free.unionByName(free).unionByName(two)), held)
    assert rows(fits.receipt) == [(1, 2, 0)] and rows(fits.conflicts) == []
    assert [r.event_id for r in fits.inserted.collect()] == ["free"] and set(fits.inserted.columns) == set(held.columns)
    new = with_digest(other_body.unionByName(second_end).unionByName(other_maker).unionByName(free))
    refused = store.append_observations(new, held)
    assert rows(refused.receipt) == [(0, 0, 3)] and refused.inserted.count() == 0
    assert rows(refused.conflicts) == sorted([
        (one.first().event_id, "data_event_identity_conflict"), ("second", "data_lifecycle_conflict"), ("maker", "data_attempt_identity_conflict"),
    ])
    assert written and all(f.dataType.simpleString() in ("bigint", "int", "boolean") for _, s in written for f in s if f.name != "reason")


def test_log_lines_are_judged_once(spark, monkeypatch):
    """A log is read and judged in one pass and written as one table; what is blank, an object or oversized is as before."""
    from palimpsest.catalog import evidence
    from palimpsest.sources import events

    written, plain = [], events.cut
    count = lambda df, name="cut": (written.append(df.columns), plain(df, name))[1]
    monkeypatch.setattr(events, "cut", count)
    monkeypatch.setattr(evidence, "cut", count)
    check(spark, duck("/root/testdata/sf0.001"), "read_events_reductions", "/root/testdata/sf0.001")
    assert len(written) == 1 and "reason" in written[0]
    lines = ["", " \t\r\f\n ", None, " ", '\n\t {"ts": 1} \n', "[{}]", '"{"', "{", '{"ts": -1}', " " * 20_000, '{"schema": 5}', '{"schema": "x"}']
    raw = spark.createDataFrame([(0, i, t) for i, t in enumerate(lines)], "generation int, line_number long, raw string")
    got = {r.line_number: (r.reason, r.readable, r.ts) for r in events.diagnose(raw).collect()}
    assert got == {
        3: ("invalid_json", False, None), 4: ("invalid_fields", True, 1), 5: ("invalid_fields", False, None), 6: ("invalid_fields", False, None),
        7: ("invalid_json", False, None), 8: ("invalid_fields", True, None), 9: ("oversized_record", False, None),
        10: ("invalid_fields", True, None), 11: ("unsupported_schema", True, None),
    }


def test_markup_is_taken_out_once(spark):
    """References are resolved in a text that is made once; blanks and line ends are as the plain patterns leave them."""
    from pyspark.sql import functions as F

    from palimpsest.llm import warc

    texts = ["a b", "a  b", "a\tb", "a \t b\r\f", "a\nb", "a \nb", "a\n b", "a \n \n b\n", "\n\na", " ", "", "x&#65;&#32;&#32;y<p> z", "&nbsp;&nbsp; q"]
    rows = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    made = warc.derive(warc.responses(rows, keep=["page_id"]), keep=["page_id"])
    assert made._jdf.queryExecution().optimizedPlan().toString().count("<!--") == 1
    out = warc._unescape(warc._unmarked(F.col("html")))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    want = {r.page_id: r.t for r in rows.select("page_id", F.trim(out, F.lit(" \n")).alias("t")).collect()}
    assert {r.page_id: r.block for r in made.filter("record_type = 'conversion'").collect()} == want


def test_unlike_long_texts_meet_by_parities_only(spark, monkeypatch):
    """Long unlike texts, each of which shares a third with each other, are compared by parities, never as sets; near ones of each length stay linked."""
    from palimpsest.llm import jaccard

    rng = random.Random(6)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared, long, short = {(a, b): new(900) for a in range(4) for b in range(a)}, new(3_000), new(520)
    texts = [sum((w for pair, w in shared.items() if i in pair), []) for i in range(4)] + [long, [*long[:-200], *new(150)], long[150:], short, short[10:], [*short, *new(60)], [*long, *new(600)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sent, plain = [], jaccard._linked
    monkeypatch.setattr(jaccard, "_linked", lambda pairs: (sent.extend((r.a, r.b) for r in pairs.collect()), plain(pairs))[1])
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = list(range(len(sets)))
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == dict(enumerate(want)) and len(set(want[4:])) == 2
    assert sent and not [p for p in sent if max(p) < 4]


def test_rows_are_ordered_before_their_bits_join(spark, tmp_path, monkeypatch):
    """The window over a set's rows reads no parity bits."""
    from palimpsest.llm import graph, jaccard

    plans, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="cut": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name))[1])
    jaccard.similar_documents(spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g i")], "doc_id long, text string")).collect()
    lines = dict(plans)["mixed"].splitlines()
    window = next(i for i, x in enumerate(lines) if "Window [" in x)
    depth = len(lines[window]) - len(lines[window].lstrip(" :+-"))
    below = [x for x in lines[window + 1 :]]
    below = below[: next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))]
    assert below and not [x for x in below if "bits" in x]


def test_probe_lines_are_read_a_few_at_a_time(spark, monkeypatch):
    """Lines become Python objects a few at a time, and short words, lines without paths or names and plain words are passed over whole."""
    from palimpsest.operators import probes as pr

    monkeypatch.setattr(pr, "LINES_AT_ONCE", 2, raising=False)
    lines = [("a", 0, "plain words only. Nothing else"), ("a", 1, "see src/main.rs and notes.txt. fooBarBazQuxx"), ("a", 2, None), ("a", 3, ""), ("a", 4, "someLongNameHere, x_y, 1abcDefGhiJkl"), (None, 5, "lib/other.py")]
    frame = spark.createDataFrame(lines, "s string, line_index long, text string")
    made = pr.probe_candidates(frame, ["s"])
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.s, r.line_index, r.kind, r.text) for r in made.collect()}
    assert got == {("a", 1, 0, "src/main.rs"), ("a", 1, 4, "main.rs"), ("a", 1, 4, "notes.txt"), ("a", 1, 5, "fooBarBazQuxx"), ("a", 4, 5, "someLongNameHere"), (None, 5, 0, "lib/other.py"), (None, 5, 4, "other.py")}
    assert not pr._WORD.findall("only short words")
