import numpy as np
import pytest
import xxhash

from skein.llm import components, simhash
from skein.llm.common import checkpointed
from skein.llm.components import connected_components


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at = [], ""
    for c in lowered + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if at:
                words.append(at)
            at = ""
        else:
            at += c
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "Ä é x y\x0bz z z z", "w " * 5000 + "end", "x" * 100_000])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_golay_is_perfect_and_keys_meet():
    code = simhash.Golay()
    assert len(np.unique(code.leader)) == 1 << 11
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    pos, index = code.near(words ^ (1 << rng.integers(0, 23, 2000)))
    near = set(zip(pos.tolist(), index.tolist(), strict=True))
    assert all((i, n) in near for i, n in enumerate(code.nearest(words).tolist()))


def test_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    found = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                b ^= 1 << bit
            found.add(b)
    f = sorted(x - (x >> 63 << 64) for x in found)
    got = spark.createDataFrame([(x,) for x in f], "f long").repartition(3)
    pairs = sorted(map(tuple, simhash.linked(got).collect()))
    want = sorted((a, b) for i, a in enumerate(f) for b in f[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert pairs == want and len(want) > 300


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(300 + i, 300 + (i + 1) % 7) for i in range(7)] + [(5, 5), (7, None)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {i: 0 for i in range(61)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300 + i: 300 for i in range(7)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(15):
        t = [words[k] for k in rng.integers(0, 300, 200)]
        for edits in range(6):
            u = list(t)
            for k in rng.integers(0, 200, edits // 2):
                u[k] = "Edit"
            texts.append(" ".join(u))
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, texts[0], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, f string").repartition(5)).collect()
    assert len(got) == len(rows)
    prints = [slow_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if bin(p ^ q).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    want = sorted(((d, min(rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None)) for i, (d, _, _) in enumerate(rows)), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want


def test_no_documents(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_of_many_edges_are_those_of_few(spark, monkeypatch, few):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] * 2 + [(200, 201 + i) for i in range(40)]
    monkeypatch.setattr(components, "FEW", few)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()))
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_a_finished_forest_takes_one_round(spark, monkeypatch):
    edges = spark.createDataFrame([(1, i) for i in range(2, 9)] + [(20, i) for i in range(21, 25)], "u long, v long")
    plans = []
    monkeypatch.setattr(components, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or checkpointed(df))
    assert connected_components(edges).filter("node <> root").count() == 11
    assert len(plans) == 2 and "Join" not in plans[1]
