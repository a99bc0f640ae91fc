"""Live branches of random files against a walk from the leaf."""

import json
import random

import pytest

from palimpsest import fixed
from palimpsest.operators import normalize as nm
from palimpsest.operators import ordered
from palimpsest.sources import transcripts as tr

ROWS = "provider string, session_id string, path string, line_index long, raw string"


def record(rng, n, known):
    """A record of line n; mostly the child of an earlier one."""
    kind = rng.choice(["user", "assistant", "attachment", "system"])
    parent = None if not known or rng.random() < 0.03 else known[-1] if rng.random() < 0.6 else rng.choice(known)
    return {"type": kind, "uuid": f"u{n}", "parentUuid": parent, "message": {"role": "user", "content": "x"}}


def make(rng, fault):
    lines, known = [], []
    for n in range(rng.randint(1, 40)):
        if rng.random() < 0.1:
            lines.append("" if rng.random() < 0.5 else json.dumps({"type": "summary"}))
        if rng.random() < 0.06 and known:
            lines.append(json.dumps({"type": "last-prompt", "leafUuid": rng.choice(known)}))
        r = record(rng, n, known)
        known.append(r["uuid"])
        lines.append(json.dumps(r))
    at = rng.randrange(len(lines))
    if fault == "twice":
        lines.append(lines[at])
    elif fault == "late parent":
        lines.insert(at, json.dumps({"type": "user", "uuid": "late", "parentUuid": known[-1]}))
    elif fault == "no parent":
        lines.insert(at, json.dumps({"type": "user", "uuid": "orphan", "parentUuid": "nobody"}))
    elif fault == "odd":
        lines.insert(at, rng.choice(["{", "[1]", json.dumps({"type": "user", "uuid": 3}), json.dumps({"type": "last-prompt"}), json.dumps({"type": "assistant"})]))
    elif fault == "lost leaf":
        lines.append(json.dumps({"type": "last-prompt", "leafUuid": "nobody"}))
    elif fault == "no links":
        lines = ["", json.dumps({"type": "summary"})]
    elif fault == "own parent":
        lines.append(json.dumps({"type": "user", "uuid": "self", "parentUuid": "self"}))
    return lines


def walk(lines):
    """State and live lines, from the leaf up."""
    links, named, fallback, state = {}, None, None, None
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
        except ValueError:
            r = None
        if not isinstance(r, dict):
            return "invalid_record", []
        if r.get("type") == "last-prompt":
            named = r.get("leafUuid", named)
            state = state or (None if "leafUuid" in r else "invalid_ancestry")
        if "uuid" in r:
            if not isinstance(r["uuid"], str) or r["uuid"] in links:
                state = "invalid_ancestry"
                continue
            links[r["uuid"]] = (i, r["parentUuid"])
            if r["type"] in ("user", "assistant", "attachment"):
                fallback = r["uuid"]
        elif r.get("type") in ("user", "assistant"):
            state = "invalid_ancestry"
    leaf = named or fallback
    if state or leaf is None:
        return state or ("invalid_ancestry" if links else "none"), []
    live, before = [], len(lines)
    while leaf is not None:
        if leaf not in links or links[leaf][0] >= before:
            return "invalid_ancestry", []
        before, leaf = links[leaf]
        live.append(before)
    return "live", sorted(live)


def states(spark, files, parts=3):
    rows = spark.createDataFrame([(fixed.BRANCH, f"s{k}", "p", i, x) for k, f in enumerate(files) for i, x in enumerate(f)], ROWS).repartition(parts)
    got = {}
    for r in nm.live_lines(rows.withColumn("rec", tr.decode("raw"))).collect():
        got.setdefault(r["session_id"], (r["state"], []))[1].append(r["line_index"])
    return {k: (s, sorted(x) if s == "live" else []) for k, (s, x) in got.items()}


@pytest.mark.parametrize("block", [3, ordered.BLOCK])
def test_random_files(spark, monkeypatch, block):
    rng = random.Random(block)
    files = [make(rng, rng.choice([None, None, None, "twice", "late parent", "no parent", "odd", "lost leaf", "no links", "own parent"])) for _ in range(150)]
    monkeypatch.setattr(ordered, "BLOCK", block)
    monkeypatch.setattr(nm, "line_levels", lambda: ordered.line_levels(size=block))
    want = {f"s{k}": walk(f) for k, f in enumerate(files) if any(x.strip() for x in f)}
    assert states(spark, files) == want
    assert {s for s, _ in want.values()} == {"live", "invalid_record", "invalid_ancestry", "none"}


def test_many_forks(spark):
    """Every record is the child of the one before the last: two interleaved chains, each line its own run."""
    chain = [json.dumps({"type": "user", "uuid": f"u{i}", "parentUuid": f"u{i - 2}" if i > 1 else None}) for i in range(501)]
    straight = [json.dumps({"type": "user", "uuid": f"u{i}", "parentUuid": f"u{i - 1}" if i else None}) for i in range(501)]
    got = states(spark, [chain, straight])
    assert got == {"s0": ("live", list(range(0, 501, 2))), "s1": ("live", list(range(501)))}


def test_no_files(spark):
    assert states(spark, [["", " "]]) == {}


def test_no_python_group(spark):
    rows = spark.createDataFrame([], ROWS)
    plan = nm.live_lines(rows.withColumn("rec", tr.decode("raw")))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "InPandas" not in plan
