"""Periodic runs, fill-in-middle texts and scaled sketches against plain versions, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sifterra.llm import fill_middle, periodic_runs, queries, scaled_sketch
from sifterra.llm.common import next_row
from sifterra.llm.kernels import shingle_sets

#: Names that the operators use inside, as extra columns of the input.
CLASHES = ["key", "n", "runs", "collapsed", "hash", "shared", "content", "copies", "list", "h0", "output", "form", "a.b", "id", "__k", "next"]
ODD = [None, "", " \n\t", "one", "a" * 50_000, "é ß 漢字 😀 " * 30, "x <M> y", "ab " * 40, "tail\x0bx"]


def table(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of each period, kept at its smallest period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in found.items())


def plain_collapse(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < e for s, e, p in runs))


def morse(n):
    return [("b" if i.bit_count() & 1 else "a") for i in range(n)]


def samples(rng):
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 200, b, morse(4096), ["a", "b"] * 12, ["a", "b", "c"] * 7, ["x"] * 30 + ["y"] * 30, ["x", "y"] * 20 + ["y"] * 30 + ["x", "y"] * 20]
    for letters in (2, 3, 30):
        for _ in range(25):
            words = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(300))]
            for _ in range(rng.randrange(4)):
                at, p = rng.randrange(len(words) + 1), rng.randint(1, 30)
                block = [f"w{rng.randrange(letters)}" for _ in range(p)]
                words[at:at] = (block * 6)[: rng.randint(1, 6 * p)]
            out.append(words)
    return out


def test_runs_against_all_periods():
    for words in samples(random.Random(4)):
        raw = [w.encode() for w in words]
        hashes = np.array([zlib.crc32(w) * 0x9E3779B97F4A7C15 % (1 << 64) for w in raw], np.uint64)
        found = periodic_runs.runs_of(raw, hashes)
        want = plain_runs(words)
        assert [tuple(r) for r in found.tolist()] == want
        assert periodic_runs.collapse(raw, found).decode() == plain_collapse(words, want)


def test_runs_when_hashes_lie(monkeypatch):
    """Word hashes that all collide, and pairs handled a few at a time: the exact tables give the same runs."""
    monkeypatch.setattr(periodic_runs, "PAIRS", 50)
    for words in samples(random.Random(5))[:40]:
        raw = [w.encode() for w in words]
        found = periodic_runs.runs_of(raw, np.array([len(w) for w in raw], np.uint64))
        assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_find_runs_on_odd_rows(spark):
    rows = list(enumerate(ODD)) + [(1, "k l m " * 20), (None, "q " * 30), (1, "k l m " * 20)]
    out = periodic_runs.find_runs(table(spark, rows)).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out)
    want = []
    for i, t in rows:
        words = (t or "").split()
        runs = plain_runs(words)
        want.append((i is None, i or 0, len(words), [(s, e - s, p) for s, e, p in runs], plain_collapse(words, runs)))
    assert got == sorted(want)
    assert periodic_runs.find_runs(table(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError, match="times"):
        periodic_runs.find_runs(table(spark, rows), times=2)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 200)))) for i in range(200)] + [(200 + i, t) for i, t in enumerate(ODD)]
    table(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        words = (t or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)], planted + 1
        runs = plain_runs(words)
        top = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0]), default=None)
        row = got[i]
        text = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
        assert row["n_runs"] == len(runs) and row["runs_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
        want = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == want
    assert planted > 10


@pytest.mark.parametrize("text", ["", "a", "plain ascii " * 200, "é" * 999, "漢字かな" * 300, "😀" * 700, "a😀é漢" * 500, "é" + "x" * 5_000 + "漢" * 700])
def test_boundaries(text):
    raw = text.encode()
    at = fill_middle.Boundaries.from_bytes(fill_middle.Boundaries.build(raw).to_bytes())
    want = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert at.n == len(text) and [at.select(i) for i in range(len(text) + 1)] == want


def plain_middle(i, t):
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = t or ""
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, t
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    return ("spm", a, b - a, s + p + m) if h[3] % 100 < 20 else ("psm", a, b - a, p + s + m)


def test_fill_middle_against_plain(spark):
    rng = random.Random(7)
    shared = "shared é text " * 20
    rows = [(i, shared) for i in range(300)] + [(1000 + i, "".join(rng.choice("aé漢😀 <>PSM") for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(2000 + i, t) for i, t in enumerate(ODD)] + [(None, shared), (None, None), (5, shared)]
    made = fill_middle.fill_middle(table(spark, rows))
    out = made.withColumn("back", fill_middle.restore(F.col("form"), F.col("output"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=key)
    want = sorted(((i, len(t or ""), *plain_middle(i, t), t or "") for i, t in rows), key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_middle(table(spark, rows).limit(0)).collect() == []


def test_next_row(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(-500, 500) * 10**16, f"t{i}") for i in range(400)] + [(None, "n1"), (None, "n2"), (7, "same"), (7, "same"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    out = next_row(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, rows))
    # following the pairs visits every row once, by descending key
    assert sorted(str((r["next"]["doc_id"], r["next"]["text"])) for r in out) == sorted(map(str, rows))
    known = [r for r in out if r["doc_id"] is not None and r["next"]["doc_id"] is not None and r["doc_id"] != -(1 << 63)]
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    after = dict(zip(ids, ids[1:], strict=False))
    assert all(r["next"]["doc_id"] in (r["doc_id"], after.get(r["doc_id"])) for r in known)
    one = next_row(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id").first()
    assert (one["next"]["doc_id"], one["next"]["text"]) == (1, "x")
    assert next_row(spark.createDataFrame([], "doc_id long, text string"), "doc_id").collect() == []


def true_set(text):
    import pyarrow as pa

    return set(next(shingle_sets(pa.array([text], pa.string()), scaled_sketch.WIDTH)).tolist())


def test_scaled_sketches(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(3000)}" for _ in range(6000))
    words = long.split()
    part, other = " ".join(words[1000:1400]), " ".join(f"v{rng.randrange(3000)}" for _ in range(500))
    rows = [(0, long, part), (1, long, other), (2, part, long), (3, None, ""), (4, "", "a b"), (5, "Aa b", "aA  b"), (6, "one two", "three four"), (7, long, " ".join(words[:4000] + other.split()))]
    df = spark.createDataFrame(rows, "doc_id long, a string, b string")
    made = df.select("*", scaled_sketch.fingerprint(F.col("a")).alias("fa"), scaled_sketch.fingerprint(F.col("b")).alias("fb"))
    out = {r["doc_id"]: r for r in made.select("*", scaled_sketch.likeness("fa", "fb").alias("near"), scaled_sketch.containment("fa", "fb").alias("inside"), scaled_sketch.merge(F.col("fa"), F.col("fb")).alias("both")).collect()}
    for r in out.values():
        sets = [true_set(r["a"]), true_set(r["b"])]
        for f, s in zip((r["fa"], r["fb"], r["both"]), (*sets, sets[0] | sets[1]), strict=True):
            hashes = np.array(sorted(s), np.uint64)
            limit = ((1 << 64) - 1) // scaled_sketch.SCALE
            kept = [h for h in hashes.tolist() if h < limit] or hashes.tolist()[:1]
            assert f == "".join(sorted({f"{h >> 24:010x}" for h in kept}))
        if min(map(len, sets)) > 100:
            shared = len(sets[0] & sets[1])
            assert abs(r["near"] - shared / min(map(len, sets))) < 0.1 and abs(r["inside"] - shared / len(sets[0])) < 0.1
    assert [out[i]["near"] for i in (0, 1, 3, 4, 5, 6)] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    assert out[2]["inside"] == 1.0


def test_scaled_sketch_query(spark, tmp_path):
    rng = random.Random(10)
    rows = [(3 * i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 150)))) for i in range(120)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    table(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op13_scaled_sketch(spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    short = lambda s: {h >> 24 for h in ([h for h in sorted(s) if h < ((1 << 64) - 1) // 8] or sorted(s)[:1])}
    for (i, t), (_, follows) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        edited = t[: len(t) - third] + follows[:third]
        row = got[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        sets = [short(true_set(x)) for x in (t, edited, follows)]
        assert [row["fingerprint"], row["edited_fingerprint"]] == ["".join(f"{h:010x}" for h in sorted(s)) for s in sets[:2]]
        for name, s in (("near_edited", sets[1]), ("near_next", sets[2])):
            least = min(len(sets[0]), len(s))
            assert row[name] == (len(sets[0] & s) / least if least else float(len(sets[0]) == len(s)))
