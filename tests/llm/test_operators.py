"""Every operator against a plain version, and on odd rows: NULLs, empties, ties, repeats, clashing columns."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sifterra.llm import chat_tree, components, jaccard_join, kernels, langid, line_rules, mixing, packing, quality_fm, sharding, toxicity, vector_dedup
from sifterra.llm.common import held_out
from sifterra.llm.queries import public_tokenizer

#: Names that the operators use inside, as extra columns of the input.
CLASHES = ["id", "n", "u", "v", "score", "size", "token", "group", "shard", "component_id", "row", "at", "text_key", "__size", "__target", "__copies", "__src", "__maybe", "__key_0", "__bad", "__task", "__tasks", "__host", "__gone", "__n_words", "__kept", "__id", "__nth", "__rank", "copies", "c0", "c1"]


def table(spark, rows, extra=True):
    """(doc_id, text, source, lang, n_chars) with clashing columns beside."""
    full = [(i, t, s, "en", None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if extra else df


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    base = prose(rng, 200)
    rows = [(0, base, "a"), (1, base, "a"), (1, base, "a"), (2, base + " end", "b"), (3, None, None), (4, "", "a"), (5, " \n\t", "b"), (None, prose(rng, 60), "a"), (6, prose(rng, 60_000), None), (7, "one two", "c"), (8, "ONE two", "c"), (9, "é ß 漢字 " * 30, "d"), (10, "a" * 50_000, "d")]
    return table(spark, rows).persist()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def plain_words(t):
    return (t or "").encode().lower().split()


def test_word_hashes_are_by_word():
    import pyarrow as pa

    texts = ["a b  a", None, "", "\x1c\x85 x", "A b", "é é", "x" * 3_000_000 + " a"]
    hashes, first = kernels.hashed_words(pa.array(texts), False)
    words = [w for t in texts for w in (t or "").encode().split()]
    assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    for h, w in zip(hashes.tolist(), words, strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    folded, _ = kernels.hashed_words(pa.array(["A B", "a b"]), True)
    assert folded[0] == folded[2] and folded[1] == folded[3]
    sliced, _ = kernels.hashed_words(pa.array(texts).slice(3, 2), False)
    assert sliced.tolist() == hashes[first[3] : first[5]].tolist()


def plain_components(sets, num, den):
    ids, parent = list(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def plain_set(text, width):
    w = plain_words(text)
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_join_against_all_pairs(spark, width, num):
    rng, rows = random.Random(width), []
    for g in range(12):
        base = prose(rng, rng.randint(3, 120), 60).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 9)}"
            rows.append((rng.randint(0, 10**6), " ".join(copy), "a"))
    shared = prose(rng, 60)
    rows += [(10**7 + i, shared + " " + prose(rng, rng.randint(5, 30)), "b") for i in range(40)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join_similar(table(spark, rows), width=width, threshold=(num, 100)).collect()}
    sets = {i: plain_set(t, width) for i, t, _ in rows}
    want = plain_components(dict(sorted(sets.items())), num, 100)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_join_blocks(spark, monkeypatch):
    """With tiny blocks every path of the exact remainder runs."""
    for name, value in (("BLOCK_TOKENS", 60), ("MINOR_TOKENS", 40), ("LEADER_BLOCK", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(40)] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(copy), "a"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_similar(table(spark, rows), width=4, threshold=(85, 100)).collect()}
    assert got == plain_components({i: plain_set(t, 4) for i, t, _ in rows}, 85, 100)


def test_jaccard_join_odd_rows(odd, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join_similar(odd, width=4, threshold=(85, 100)).collect()]
    by = {d: (n, c) for d, n, c in got if d is not None}
    assert len(got) == 13 and by[0] == (by[1][0], 0) and by[1][1] == by[2][1] == 0
    assert [by[i] for i in (3, 4, 5)] == [(0, 3), (0, 4), (0, 5)] and by[7][1] == by[8][1] == 7 and by[10] == (1, 10)
    assert [c for d, _, c in got if d is None] == [None]
    kept = jaccard_join.keep_one(odd, width=5, threshold=(80, 100))
    assert kept.columns == odd.columns
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 0, 3, 4, 5, 6, 7, 9, 10]
    assert jaccard_join.join_similar(none).count() == 0 and jaccard_join.keep_one(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    parent = {}
    for a, b in links:
        a, b = components.find(parent, a), components.find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {x for l in links for x in l}
    assert {x: got.get(x, x) for x in nodes} == {x: components.find(parent, x) for x in nodes}
    assert components.components(df.limit(0)).count() == 0


def vector_rows(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v) for i, v in rows], f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "v", "n", "weight", "cell")})


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    monkeypatch.setattr(vector_dedup, "LEAF", 4)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    points = [centres[i % 6] + rng.normal(size=12) * rng.choice([0.01, 0.15, 0.4]) for i in range(260)] + [rng.normal(size=12) for _ in range(60)]
    points += [points[0] * 3, points[1]]
    rows = [(i * 7 + 3, [float(np.float32(x)) if kind == "float" else float(x) for x in p]) for i, p in enumerate(points)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(vector_rows(spark, rows, kind), threshold=0.95).collect()}
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    parent = {}
    for i, j in np.argwhere(link):
        a, b = components.find(parent, rows[i][0]), components.find(parent, rows[j][0])
        if a != b:
            parent[max(a, b)] = min(a, b)
    want = {r[0]: (int(link[i].sum()), components.find(parent, r[0])) for i, r in enumerate(rows)}
    assert {k: v[:2] for k, v in got.items()} == want
    assert all(v[2] == (k == v[1]) for k, v in got.items())


def test_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(vector_rows(spark, rows)).collect()))
    assert got == [(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *[(i, 0, i, True) for i in range(3, 10)]]
    assert vector_dedup.near_vectors(vector_rows(spark, rows).limit(0)).count() == 0


def test_line_rules(odd, none, spark):
    got = {r["doc_id"]: r for r in line_rules.apply_rules(odd).collect()}
    assert len(got) == 12 and line_rules.apply_rules(odd).count() == 13
    assert [got[i]["n_words"] for i in (3, 4, 5, 7)] == [0, 0, 0, 2] and not any(got[i]["kept"] for i in (3, 4, 5, 7))
    assert got[0]["kept"] and got[9]["word_chars"] == 4 * 30 and got[9]["base_failed"]
    assert got[10]["word_chars"] == 50_000
    kept = line_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 0, 1, 1, 2, 6]
    assert line_rules.apply_rules(none).count() == 0 and line_rules.keep_good(none).count() == 0

    rng = random.Random(3)
    words = lambda rng, n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))  # noqa: E731  digits don't tell lines apart
    common = words(rng, 60)
    rows = [(i, common + "\n" + words(rng, 5), "h") for i in range(30)] + [(100 + i, common + "\n" + words(rng, 90), "h") for i in range(30)] + [(200 + i, words(rng, 80), "h") for i in range(30)]
    copied = "\n".join(words(rng, 20) for _ in range(5))
    rows += [(300 + i, copied, "h") for i in range(60)]
    out = {r["doc_id"]: r for r in line_rules.apply_rules(table(spark, rows)).collect()}
    assert not any(out[i]["kept"] for i in range(30)) and all(out[i]["kept"] for i in (*range(100, 130), *range(200, 230), *range(300, 360)))
    assert out[100]["n_lines_removed"] == 1 and out[100]["n_words_left"] == 90 and out[300]["n_lines_removed"] == 0
    dup = line_rules.apply_rules(table(spark, [(1, "a b\na b\n\n c\na b ", "h")])).first()
    assert (dup["n_dup_lines"], dup["n_repeat_words"]) == (1, 0)
    dup = line_rules.apply_rules(table(spark, [(1, "a b c d a b c x a b c", "h")])).first()
    assert dup["n_repeat_words"] == 9


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_line_rules_clean_texts(spark, monkeypatch, broadcast):
    import corpus_pipeline

    monkeypatch.setattr(line_rules, "BROADCAST_LINES", broadcast, raising=False)
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    own = {i: [words(45), words(45)] for i in range(40)}
    notice = "Notice é 漢 %d of 9"
    rows = [(i, f"{a}\n{notice % i}\n\n{b}\n  NOTICE é 漢 7 of 9", None if i < 20 else "h") for i, (a, b) in own.items()] + [(100, notice % 1 + "\n" + own[0][0] + " " + own[1][0], "other"), (101, None, "h")]
    docs = table(spark, rows)
    out = {r["doc_id"]: r for r in line_rules.apply_rules(docs).collect()}
    assert all(out[i]["text"] == f"{a}\n\n{b}" and (out[i]["n_lines_removed"], out[i]["n_words"], out[i]["n_words_left"]) == (1, 102, 90) for i, (a, b) in own.items())
    assert out[100]["text"] == rows[-2][1] and out[101]["text"] is None
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["text_key"]) for r in kept.collect()}
    assert got == {i: (out[i]["text"], len(out[i]["text"]), "x") for i in (*own, 100)}


@pytest.mark.parametrize("shared", [2, 20, 40])
def test_line_rules_many_shared_lines(spark, shared):
    rng = random.Random(shared)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    template = [words(40) for _ in range(shared)]
    rows = [(i, "\n".join([*template, words(10)]), "h") for i in range(100)] + [(200 + i, words(80), "h") for i in range(100)]
    out = {r["doc_id"]: r for r in line_rules.apply_rules(table(spark, rows)).collect()}
    assert all(out[i]["n_lines_removed"] == shared and out[i]["n_words_left"] == 10 and not out[i]["kept"] for i in range(100))
    assert all(out[200 + i]["n_lines_removed"] == 0 and out[200 + i]["kept"] for i in range(100))


def test_mixing(odd, none, spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice(["a", "b", "c", "tiny", None]) if i > 5 else "tiny") for i in range(3000)]
    rows += [(9000 + i, "w " * 40, "small") for i in range(4)]
    docs = table(spark, rows)
    flat = lambda mixed: mixed.select("row.doc_id", "row.source", *[F.col(c).alias(f"__{c}") for c in ("size", "source_size", "target", "copies")])
    got = flat(mixing.mix(docs)).collect()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["__size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["__size"] * r["__copies"]
        target[r["source"]] = r["__target"]
        assert r["__copies"] <= 3 and r["__source_size"] >= r["__size"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    level, capped = 0.0, set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] >= 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        want = 3 * sizes[s] if s in capped else level * weight[s]
        assert target[s] == pytest.approx(want)
        assert taken[s] == pytest.approx(want, rel=0.12)
    assert "small" in capped
    again = {(r["doc_id"], r["__copies"]) for r in flat(mixing.mix(docs.repartition(7))).collect()}
    assert again == {(r["doc_id"], r["__copies"]) for r in got}
    out = mixing.emit(mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r["__copies"] for r in got)
    assert mixing.mix(odd).count() == 13 and mixing.mix(none).count() == 0 and mixing.emit(mixing.mix(none)).count() == 0


def test_mixing_many_sources(spark, monkeypatch):
    docs = table(spark, [(i, "a b", f"s{i % 7}" if i % 5 else None) for i in range(200)])
    few = {(r["row"]["doc_id"], r["copies"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {(r["row"]["doc_id"], r["copies"]) for r in mixing.mix(docs).collect()} == few


def check_shards(rows, n, texts):
    total = sum(r["size"] for r in rows)
    per, counts = [0] * n, [0] * n
    for r in rows:
        per[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return total / n, per


def test_sharding(odd, none, spark):
    rng = random.Random(8)
    texts = {i: prose(rng, rng.randint(0, 60)) for i in range(3000)}
    texts |= {i: "the same text" for i in range(3000, 4500)} | {i: f"pair {i // 2}" for i in range(4500, 4700)}
    rows = sharding.assign_shards(table(spark, [(i, t, "a") for i, t in texts.items()]), 24).collect()
    target, per = check_shards(rows, 24, texts)
    assert max(abs(p - target) for p in per) < 0.06 * target
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t.startswith("pair"))
    order = sorted(rows, key=lambda r: r["byte_start"])
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
    small = sharding.assign_shards(odd, 3).collect()
    check_shards(small, 3, None)
    assert len(small) == 13 and {r["size"] for r in small if r["doc_id"] in (3, 4)} == {8}
    assert sharding.assign_shards(none, 24).count() == 0


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizer()["tokenizer"])
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("window", [64, 1024])
def test_packing(odd, none, spark, window):
    rng = random.Random(4)
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + i, prose(rng, rng.randint(0, 90))) for i in range(120)], "doc_id long, text string"))
    pieces = packing.pack(docs, window=window, with_ids=True, **public_tokenizer()).collect()
    sequences, of_doc = {}, {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        of_doc.setdefault(p["doc_id"], []).append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sum(sum(x[1] for x in s) < window for s in sequences.values()) <= 4
    for row in docs.collect():
        if row["doc_id"] in (1,):
            continue
        got = sorted(of_doc[row["doc_id"]], key=lambda p: p["start"])
        joined = b"".join(p["ids"] for p in got)
        assert np.frombuffer(joined, "<u4").tolist() == ids_of(row["text"])
        assert [p["start"] for p in got] == np.cumsum([0, *[p["length"] for p in got][:-1]]).tolist()
    assert sum(p["length"] for p in of_doc[1]) == 2 * of_doc[1][0]["doc_tokens"]
    assert packing.pack(none, **public_tokenizer()).count() == 0


ODD_TEXTS = ["Hello  world\n\n x", "naïve ß 漢字 🙂", "<|endoftext|> y", "abc <|endoftext|> def", "a" * 3000, "   \t ", "don't 123,456", "", " x", "x  ", "　 y　 é à", " a\n b "]


@pytest.mark.parametrize("piece", [3, 40, 1 << 22])
def test_ids_of_long_texts_and_broken_bytes(monkeypatch, piece):
    import pyarrow as pa

    from sifterra.llm import bpe

    monkeypatch.setattr(bpe, "PIECE", piece)
    made = packing.tokens(**public_tokenizer())
    text = "; ".join(ODD_TEXTS[:2] + ODD_TEXTS[4:]) * 20
    raw = b"good \xff\xfe bad  words " * 5
    flat, at = made.encode_rows(pa.array([text.encode(), None, raw, b"end"], pa.binary()).view(pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [ids_of(x)[:-1] for x in (text, "", raw.decode("utf-8", "replace"), "end")]


@pytest.mark.parametrize("fast", [True, False])
def test_ids_equal_the_tokenizers(fast):
    import pyarrow as pa

    files = public_tokenizer()
    made = packing.tokens(**files) if fast else packing.tokens(files["tokenizer"], None, None)
    want = [ids_of(text)[:-1] for text in ODD_TEXTS]
    for _ in range(2):  # the second time from the table of known parts
        flat, at = made.encode_rows(pa.array([*ODD_TEXTS, None]))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [*want, []]
    assert [made.encode(text).tolist() for text in ODD_TEXTS] == want
    assert made.encode_literal("<|endoftext|>").tolist() == made.literal.encode("<|endoftext|>", add_special_tokens=False).ids != want[2][:1]


def test_ids_of_random_texts():
    import pyarrow as pa

    rng, made = random.Random(1), packing.tokens(**public_tokenizer())
    alphabet = [*"ab1 .,'\n\t é\u00a0\u3000漢😀\u2003\x1c\x85sd", "  ", " 's", "ll"]
    for _ in range(1500):
        column = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3)]
        flat, at = made.encode_rows(pa.array(column))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [made.fast.encode_ordinary(x) for x in column]


def bm25_shard(words):
    pairs = [np.unique(w & np.uint64(0xFFFFFFFF), return_counts=True) for w in words]
    return packing.Shard(np.concatenate([p[0] for p in pairs]).astype("<u4"), np.concatenate([p[1] for p in pairs]).astype("<u4"), np.array([len(p[0]) for p in pairs]))


def test_packing_neighbours_share_words():
    groups = [[f"g{g}w{i}" for i in range(20)] for g in range(4)]
    words = [np.array([zlib.crc32(w.encode()) for w in random.Random(i).sample(groups[i % 4], 12)], np.uint64) for i in range(40)]
    shard = bm25_shard(words)
    shard.free[0] = False
    assert all(x % 4 == 0 for x in shard.neighbours(0))


@pytest.mark.parametrize("dense", [10, 1000])
def test_packing_scores_every_shared_term(monkeypatch, dense):
    """All unused rows that share a term, in the order of brute-force BM25, by postings and by the dense table."""
    monkeypatch.setattr(packing, "DENSE", dense)
    rng = random.Random(8)
    words = [np.array([zlib.crc32(f"{i % 3}-{rng.randint(0, 300)}".encode()) for _ in range(150)] + [zlib.crc32(f"all{k}".encode()) for k in range(20)], np.uint64) for i in range(90)]
    words[5] = np.array([zlib.crc32(b"lonely")], np.uint64)
    shard, mean = bm25_shard(words), np.mean([len(w) for w in words])
    count = [{t: w.tolist().count(t) for t in w.tolist()} for w in words]
    df = {t: sum(t in c for c in count) for t in {t for c in count for t in c}}
    idf = {t: np.log1p((len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    shard.free[::4] = False
    for seed in range(0, 90, 4):
        score = {i: sum(idf[t] * c[t] * (packing.K1 + 1) / (c[t] + packing.K1 * (1 - packing.B + packing.B * len(words[i]) / mean)) for t in set(count[seed]).intersection(c)) for i, c in enumerate(count) if i % 4}
        order = list(shard.neighbours(seed))
        assert set(order) == {i for i, x in score.items() if x > 0} and 5 not in order
        assert [score[i] for i in order] == pytest.approx(sorted((x for x in score.values() if x > 0), reverse=True), rel=1e-5)


def test_packing_shard_takes_little_memory():
    """Four workers of an executor each hold one: the former arrays took 82 bytes a posting at their peak and kept 27."""
    rng = np.random.default_rng(5)
    held = np.full(1024, 300)
    terms = np.concatenate([np.sort(np.append(rng.choice(40_000, n - 20, replace=False), np.arange(40_000, 40_020))) for n in held]).astype("<u4")
    times = rng.integers(1, 4, len(terms)).astype("<u4")
    tracemalloc.start()
    try:
        shard = packing.Shard(terms, times, held)
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert most < 40 * len(terms) and kept < 20 * len(terms)
    assert len(shard.table) == 20 and len(shard.doc) + np.count_nonzero(shard.table) == len(shard.term)


def test_packing_shards_are_not_kept():
    rows = pa.table({"id": list(range(9000)), "terms": pa.array([bytes(4 * (i % 300)) for i in range(9000)], pa.binary())})
    before, seen, most = pa.total_allocated_bytes(), [], 0
    for table in packing.shards(iter(rows.to_batches(max_chunksize=700)), 1):
        most = max(most, pa.total_allocated_bytes() - before)
        assert table.num_rows <= packing.SHARD and pc.sum(pc.binary_length(table["terms"])).as_py() <= 4 * packing.POSTINGS
        seen += table["id"].to_pylist()
        del table
    assert seen == list(range(9000)) and most < 1.5 * 600 * packing.SHARD


def test_packing_asks_the_seed_until_the_window_is_full():
    rows = [[1, 2, 3], [9, 8, 7], [1, 5, 6], [2, 4, 5], [3, 9, 8], [20, 21, 22]]
    shard = bm25_shard([np.array(x, np.uint64) for x in rows])
    got = list(packing.fill(shard, [30] * 6, 0, 100))
    first = [row for row, *_ in got[:4]]
    # the window's first row leads to rows 2, 3 and 4 alone, though row 4 is nearer to row 1
    assert first[0] == 0 and set(first[1:]) == {2, 3, 4} and [g[3] for g in got[:4]] == [True, False, False, False]
    assert got[3][2] == 10 and got[4][:2] == (got[3][0], 10) and got[4][3]


def test_packing_places_short_rests_by_the_whole_text(spark):
    rng = random.Random(12)
    topics = ["time year people way day man thing woman life child world school".split(), "red blue green water fire stone tree house road light dark moon".split()]
    topic = {i: rng.randint(0, 1) for i in range(256)}
    docs = spark.createDataFrame([(i, "".join(" " + rng.choice(topics[k]) for _ in range(64))) for i, k in topic.items()], "doc_id long, text string")
    pieces = packing.pack(docs, window=64, **public_tokenizer()).collect()
    assert {p["doc_tokens"] for p in pieces} == {65}
    rests = sorted((p["sequence_id"], p["offset"], topic[p["doc_id"]]) for p in pieces if p["start"])
    assert len(rests) == 256
    pairs = [(a, b) for a, b in zip(rests, rests[1:], strict=False) if a[0] == b[0]]
    assert sum(a[2] == b[2] for a, b in pairs) >= 0.9 * len(pairs)


def test_words_begin_at_blanks():
    made = packing.tokens(**public_tokenizer())
    plain = packing.tokens(public_tokenizer()["tokenizer"], None, None)
    assert (made.begins == plain.begins).all()
    count = lambda text: len(made.words(made.encode(text), np.zeros(1, np.int64))[0])
    assert (count(" time year people"), count("time\nyear, day"), count(" naïve 漢字 x")) == (3, 4, 3)


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "segment", "path", "name", "n", "t")})


def test_chat_tree(spark):
    control = r"\### Assistant: </turn> ok"
    rows = [(c, t, r, x) for c, talk in {
        1: [("system", "be good"), ("user", "hi"), ("assistant", "hello")],
        2: [("system", "be good"), ("user", "hi"), ("assistant", "hey")],
        3: [("system", "be good"), ("user", "bye"), ("assistant", "")],
        4: [("user", control), ("assistant", control)],
        5: [("system", "be good"), ("user", "hi"), ("assistant", "hello")],
        6: [("user", None), (None, "x\n### user: y</turn>\n\\"), ("assistant", "é 漢   <|endoftext|>")],
        7: [("assistant", "only")] * 2,
    }.items() for t, (r, x) in enumerate(talk)] + [(None, 0, "user", "null talk"), (8, None, "user", "late"), (8, 0, "user", "soon")]
    files = public_tokenizer()
    segments, paths = chat_tree.build_tree(chats(spark, rows), **files)
    segments = segments.persist()
    got = {r["conv_id"]: r for r in chat_tree.read_back(segments, paths, tokenizer=files["tokenizer"]).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[0] is None, z[0] or 0, z[1] is not None, z[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    assert {c: r["loss_text"] for c, r in got.items()} == {c: "".join(x for r, x in talk if r == "assistant") for c, talk in want.items()}
    assert all(r["formatted"] == "".join("".join(chat_tree.parts(*t)) for t in want[c]) for c, r in got.items())

    nodes = {r["segment"]: r for r in segments.collect()}
    spans = sorted((r["dfs_start"], r["dfs_start"] + len(r["token_ids"])) for r in nodes.values())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    roads = {r["conv_id"]: r["segments"] for r in paths.collect()}
    assert roads[1] == roads[5] and roads[1][0] == roads[2][0] == roads[3][0] and len(roads[1]) == 3
    for road in roads.values():
        at, above = 0, []
        for name in road:
            node = nodes[name]
            assert node["position_start"] == at and [(x["from"], x["to"]) for x in node["attends"]] == above
            assert all(b <= node["dfs_start"] for _, b in above)
            above.append((node["dfs_start"], node["dfs_start"] + len(node["token_ids"])))
            at += len(node["token_ids"])
    # depth first: what stands between a node and its last descendant passes through it
    for a in nodes.values():
        below = [nodes[r[-1]]["dfs_start"] for r in roads.values() if a["segment"] in r]
        inside = [n for n in nodes.values() if a["dfs_start"] < n["dfs_start"] <= max(below)]
        assert all((a["dfs_start"], a["dfs_start"] + len(a["token_ids"])) in [(x["from"], x["to"]) for x in n["attends"]] for n in inside)
    empty = chat_tree.build_tree(chats(spark, rows).limit(0), **files)
    assert [x.count() for x in empty] == [0, 0] and chat_tree.read_back(*empty, tokenizer=files["tokenizer"]).count() == 0


def test_chat_escapes():
    rng = random.Random(3)
    for text in ["", "\\", "</turn>", "### ", "a: b", "\\\\<#", "x\n", "\\</turn>\n", *("".join(rng.choices(["\\", "#", "<", ":", " ", "</turn>\n", "### ", "a"], k=rng.randint(1, 12))) for _ in range(500))]:
        assert chat_tree.unescape(chat_tree.escape(text)) == text
        assert chat_tree.parse("".join(chat_tree.parts(text, text))) == [(text, text)]
    with pytest.raises(ValueError, match="not a turn"):
        chat_tree.parse("### user: a</turn>\nrest")


def test_long_chat_turns():
    """A turn of ten million characters is matched without a record of the way there."""
    import tracemalloc

    text = "ab\\# <: " * 1_250_000
    made = "".join(chat_tree.parts("user", text))
    tracemalloc.start()
    assert chat_tree.parse(made) == [("user", text)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def labelled(spark, make, n=500):
    rng = random.Random(7)
    rows = [(i, make(rng, i % 2), "s") for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(n)], "doc_id long, toxic int, quality int")
    return table(spark, rows), labels


def train(doc_id):
    return ~held_out(doc_id, 3, 1)


def test_toxicity(odd, none, spark):
    bad = ["vile", "nasty", "awful"]
    docs, labels = labelled(spark, lambda rng, y: prose(rng, rng.randint(20, 60)) + (" " + " ".join(rng.sample(bad, 2)) if y else ""))
    model = toxicity.fit_toxicity(docs, labels, train)
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"), 3, 1)).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["toxic"] == 1) for r in scored]) > 0.97
    assert abs(model.label_model.correlation).max() > 0.15
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, model).collect()}
    assert len(got) == 12 and all(0 <= s <= 1 for s in got.values()) and got[3] == got[4]
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.fit_toxicity(none, labels, train) is None and toxicity.fit_toxicity(docs, labels.limit(0), train) is None
    assert {r["score"] for r in toxicity.score_toxicity(odd, None).collect()} == {0.5}


def test_label_model_finds_accuracies():
    """Voters of known accuracy, two of them repeated: found without labels, and a repeated vote counts once."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    votes = np.stack([np.where(rng.random(4000) < p, np.where(rng.random(4000) < a, 2 * y - 1, 1 - 2 * y), 0) for p, a in ((0.8, 0.95), (0.8, 0.9), (0.8, 0.8), (0.8, 0.7))], axis=1)
    votes = np.concatenate([votes, votes[:, 1:2], votes[:, :1]], axis=1)
    model = toxicity.fit_label_model(votes, toxicity.majority(votes))
    right = [model.given[j, 1, 2] / (model.given[j, 1, 2] + model.given[j, 1, 0]) for j in range(4)]
    assert np.allclose(right, [0.95, 0.9, 0.8, 0.7], atol=0.05)
    assert model.correlation[1, 4] > 0.8 and abs(model.correlation[2, 3]) < 0.2
    weight = model.weights(votes)
    spoken = votes[:, 1] != 0
    assert weight[spoken, 1].max() < 0.7 < weight[votes[:, 2] != 0, 2].min()
    alone = model.weights(np.where(np.arange(6) == 1, votes, 0))
    assert (alone[:, 1] == 1).all()
    assert ((model.posterior(votes) > 0.5) == (y == 1)).mean() > 0.92


def test_toxicity_against_brute_force(spark):
    """The query's scores are the linear classifier's, text by text, over units and votes."""
    docs, labels = labelled(spark, lambda rng, y: prose(rng, rng.randint(1, 60)) + (" vile awful" if y else ""))
    model = toxicity.fit_toxicity(docs, labels, train)
    for r in toxicity.score_toxicity(docs, model).join(docs.select("doc_id", "text"), "doc_id").limit(60).collect():
        words = {w.strip(".,").lower() for w in r["text"].split()}
        units = {u for w in words for u in toxicity.Units()[w]}
        at = [i for i, u in enumerate(model.units.tolist()) if u in units]
        form = np.array(toxicity.structure(r["text"].encode(), r["text"].encode().split()))
        lexicon = np.zeros(len(model.side), np.int64)
        for i in at:
            if model.voter[i] >= 0:
                lexicon[model.voter[i]] = model.side[model.voter[i]]
        votes = [*lexicon, *np.where(form > model.limits, model.pattern_side, 0), 0 if (lexicon > 0).any() else -1]
        raw = model.bias + sum(model.weights[i] for i in at) + float(np.dot(model.vote_weights, votes))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def test_quality_against_brute_force(spark):
    """The query's scores are the factorisation machine's, pair by pair."""
    docs, labels = labelled(spark, lambda rng, y: prose(rng, rng.randint(1, 12)) + (" $$$ ###" if y else ""), n=200)
    model = quality_fm.fit_quality(docs, labels, train)
    known = quality_fm.Hashed(quality_fm.WORD_BINS)
    for r in quality_fm.score_quality(docs, model).join(docs.select("doc_id", "text", "n_chars"), "doc_id").limit(15).collect():
        numbers, values = quality_fm._row(r["text"].encode(), r["n_chars"], known)
        raw = model.bias + sum(model.linear[n] * x for n, x in zip(numbers, values, strict=True))
        raw += sum(model.factors[numbers[i]] @ model.factors[numbers[j]] * values[i] * values[j] for i in range(len(numbers)) for j in range(i))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def test_quality(odd, none, spark):
    docs, labels = labelled(spark, lambda rng, y: " ".join(w + "$$$" if rng.random() < 0.6 else w for w in prose(rng, 60).split()) if y else prose(rng, rng.randint(20, 80)))
    model = quality_fm.fit_quality(docs, labels, train)
    scored = quality_fm.score_quality(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"), 3, 1)).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in scored]) > 0.97
    got = quality_fm.score_quality(odd, model).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_fm.keep_scored(odd, model, 0.3)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= 0.3 for r in got)
    assert quality_fm.score_quality(none, model).count() == 0 and quality_fm.keep_scored(none, model, 0.3).count() == 0
    assert quality_fm.fit_quality(docs, labels.filter("quality = 1"), train) is None
    assert quality_fm.keep_scored(odd, None, 0.3).count() == 13


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    numbers = [rng.choice(30, 6, replace=False) for _ in range(5)]
    values = [rng.normal(size=6) for _ in numbers]
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    got = fm.raw(quality_fm.Rows(numbers, values))
    for g, n, v in zip(got, numbers, values, strict=True):
        pairs = sum(fm.factors[n[i]] @ fm.factors[n[j]] * v[i] * v[j] for i in range(6) for j in range(i))
        assert g == pytest.approx(0.3 + fm.linear[n] @ v + pairs)


def test_languages(odd, none, spark):
    letters = {"xx": "abcde", "yy": "fghij", "zz": "åöüßñ"}
    rng, rows = random.Random(5), []
    for i in range(300):
        name = list(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(letters[name], k=rng.randint(2, 7))) for _ in range(40)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit_languages(docs, lambda c: ~held_out(c, 4, 2))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in got) and sum(r["rejected"] for r in got) < 20
    far = langid.identify(spark.createDataFrame([(1, "qqqq wwww kkkk qqqq")], "doc_id long, text string"), model).first()
    assert far["rejected"] and far["lang_pred"] in letters
    by = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [by[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and by[3]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in by.values())
    assert langid.identify(none, model).count() == 0 and langid.fit_languages(docs.limit(0), lambda c: F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_ngrams_do_not_depend_on_pieces(monkeypatch, piece):
    text = " ".join("".join(random.Random(i).choices("abcéΣ1", k=6)) for i in range(300)) + "  !"
    whole = langid.counts(text)
    plain = re.sub("[^a-zà-ɏα-ω]+", " ", f" {text.lower()} ")
    assert whole.sum() == sum(len(plain) - n + 1 for n in (1, 2, 3)) - 1  # the first gap is no n-gram
    monkeypatch.setattr(langid, "PIECE", piece)
    assert (langid.counts(text) == whole).all()
    assert langid.has_letter("½a") and not langid.has_letter("½²Ⅷ 1_")


def test_languages_against_brute_force(spark):
    """The query's predictions are those of the nearest centroid, taken text by text."""
    rng, rows = random.Random(15), []
    letters = {"xx": "abcde", "yy": "defgh", "zz": "åöüßñ"}
    for i in range(240):
        name = list(letters)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(letters[name], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = langid.fit_languages(docs, lambda c: ~held_out(c, 4, 2), per_language=64)
    again = langid.fit_languages(docs.repartition(3), lambda c: ~held_out(c, 4, 2), per_language=64)
    assert np.allclose(model.vectors, again.vectors) and model.languages == again.languages and set(model.languages) == set(letters)
    for r in langid.identify(docs, model).collect():
        v = np.log1p(langid.counts(rows[r["doc_id"]][1])) * model.idf
        cosines = model.vectors @ (v / np.linalg.norm(v))
        assert r["score"] == pytest.approx(cosines.max()) and model.languages[int(cosines.argmax())] == r["lang_pred"]


def test_minor_clusters():
    """A mislabelled cluster goes, a language's second script stays."""
    at = lambda *x: np.array(x) / np.linalg.norm(x)
    found = [("a", at(1, 0, 0), 0.95, 0.5), ("b", at(0, 1, 0), 0.92, 0.5), ("b", at(0.99, 0.1, 0), 0.05, 0.5), ("b", at(0, 0.1, 1), 0.03, 0.5)]
    model = langid.settled(found, np.ones(3))
    assert model.languages == ["a", "b", "b"] and model.vectors[:, 2].max() > 0.9 and (model.vectors[1:, 0] < 0.5).all()


def test_language_samples(spark):
    docs = spark.range(4000).select(F.col("id").alias("__id"), F.when(F.col("id") % 100 == 0, "rare").otherwise("common").alias("__lang"))
    sizes = {r["__name"]: r["count"] for r in langid.sampled(docs.repartition(7), 320).groupBy("__name").count().collect()}
    assert sizes["common"] == 320 and 30 <= sizes["rare"] <= 40
    pick = lambda df: {r["__id"] for r in langid.sampled(df, 320).collect()}
    assert pick(docs.repartition(3)) == pick(docs)


def test_copies_share_one_weight_and_others_keep_theirs():
    rng = random.Random(21)
    base = [rng.randrange(10**6) for _ in range(60)]
    copies = [sorted({*base[: 60 - i % 4], 10**7 + i}) for i in range(30)]
    common = list(range(2 * 10**7, 2 * 10**7 + 40))  # in every row, so no sign of a copy
    others = [sorted({rng.randrange(10**6) for _ in range(60)} | {3 * 10**7 + i % 3}) for i in range(200)]
    rows = [np.array(sorted(x + common)) for x in copies + others]
    flat, row = np.unique(np.concatenate(rows), return_inverse=True)[1], np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    weights = toxicity.copy_weights(flat, row, len(rows))
    assert weights[:30].sum() < 3 and weights[30:].min() == 1.0


def test_few_toxic_rows_are_enough():
    """Thirty toxic rows of one language, marked by words of one beginning with changing ends: the lexicon finds most of the held-out ones."""
    rng = random.Random(22)
    known, made = toxicity.Units(), []
    for i in range(700):
        words = [f"{rng.choice('abcdefgh')}{rng.choice('klmn')}{rng.randrange(500)}x" for _ in range(80)]
        toxic = i % 10 == 0
        if toxic:
            words += [f"vilest{rng.choice('abcdefghijklm')}{rng.choice('opqr')}" for _ in range(4)]
        rng.shuffle(words)
        made.append((*toxicity.parse(" ".join(words).encode(), known), int(toxic)))
    train, rest = made[:350], made[350:]
    model = toxicity.fit([m[0] for m in train], np.array([m[1] for m in train]), np.array([m[2] for m in train]))
    scores = np.array([1 / (1 + np.exp(-model.raw(m[0], m[1]))) for m in rest])
    truth = np.array([m[2] for m in rest])
    assert (scores[truth == 1] >= 0.7).mean() >= 0.9 and (scores[truth == 0] >= 0.7).mean() <= 0.02
