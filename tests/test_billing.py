"""Characters of nested values beside a JSON dump, with images at any depth."""

import base64
import json
import random
import struct

from pyspark.sql import functions as F

from palimpsest.operators.billing import billable_chars, image_payloads


def png(w, h):
    return base64.b64encode(b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR" + struct.pack(">II", w, h) + b"\x08\x06\0\0\0" + b"x" * 90).decode()


def gif(w, h):
    return base64.b64encode(b"GIF89a" + struct.pack("<HH", w, h) + b"y" * 50).decode()


PRICES = {png(1092, 1092): 39 * 39, "data:image/png;base64," + png(10, 29): 2, gif(56, 28): 2, png(10_000, 10_000): 4784, png(0, 5): 1568, "https://x/y.png": 1568, "QUJD": 1568, "": 1568, "data:none": 1568, "not base64!": 1568}


def image(rng, payload):
    return rng.choice([
        {"type": "image", "source": {"type": "base64", "data": payload}}, {"type": "input_image", "image_url": payload}, {"type": "image_url", "image_url": {"url": payload, "detail": "low"}},
    ])


def value(rng, depth, found):
    kind = rng.random()
    if depth and kind < 0.25:
        return [value(rng, depth - 1, found) for _ in range(rng.randint(0, 3))]
    if depth and kind < 0.55:
        return {rng.choice(["a", "type", "k,ey", 'q"', "é", "n\n", "\\"]) + str(i): value(rng, depth - 1, found) for i in range(rng.randint(0, 3))}
    if depth and kind < 0.7:
        payload = rng.choice(list(PRICES))
        found.append(payload)
        return image(rng, payload)
    return rng.choice([None, True, False, 0, -7, 12345678901, 2.5, 0.1, "", "a,b:c", 'say "hi"\\', "\\\"", "\\\\", "tab\tnew\nline\r\b\f\x01\x1f", "é東\U0001f600", "\x7f", '"type":"image"', {"type": "image"}, {"type": "image_url", "image_url": 3}])


def test_equals_a_dump(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for n in range(300):
        found = []
        v = value(rng, rng.randint(0, 6), found)
        rows.append((n, json.dumps(v)))
        chars = len(json.dumps(v, ensure_ascii=False)) + sum(4 * PRICES[p] - len(p) for p in found)
        want[n] = (chars, chars // 4)
    df = spark.createDataFrame(rows, "id long, raw string").select("id", F.parse_json("raw").alias("value")).repartition(3)
    got = {r["id"]: (r["billable_chars"], r["est_tokens"]) for r in billable_chars(df, ["id"]).collect()}
    assert got == want


def test_an_image_inside_an_image_counts_once(spark):
    inner = {"type": "image", "source": {"data": "aa", "more": {"type": "image", "source": {"data": "bb"}}}}
    df = spark.createDataFrame([(1, json.dumps([[[inner]]]))], "id long, raw string").select("id", F.parse_json("raw").alias("value"))
    assert [r["payload"] for r in image_payloads(df, ["id"]).collect()] == ["aa"]
    assert billable_chars(df.limit(0), ["id"]).isEmpty()
