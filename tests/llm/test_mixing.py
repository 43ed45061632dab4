import hashlib
import os
import random
from fractions import Fraction

import duckdb
import pytest

from skein.llm import mixing
from skein.llm.common import scope, shared_path


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(share.get(s, most * sizes[s])) for s in names}
        full |= set(over)


def slow_mix(rows):
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = slow_targets(sizes), []
    for s in sizes:
        at, goal = 0, round(targets[s])
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[2])):
            taken = goal // sizes[s] * n + max(0, min(at + n, goal % sizes[s]) - at) if n else 0
            out.append((i, s, n, taken))
            at += n
    return targets, sorted(out, key=str)


@pytest.mark.parametrize(("seed", "slots"), [(1, 1 << 18), (2, 50), (3, 7)])
def test_mix_is_that_of_brute_force(spark, seed, slots):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "B", "é", None, "src0", "src0", "src0", "\U0001f600"]), r.choice([0, 1, 7, 300])) for i in range(120)] + [(None, "a", 4), (5, "a", 9), (5, "a", 9), (500, "tiny", 1), (501, "void", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4), slots=slots).collect()
    targets, want = slow_mix(rows)
    assert sorted(((x["doc_id"], x["source"], x["size"], x["taken"]) for x in got), key=str) == want
    assert {x["source"]: x["target"] for x in got} == pytest.approx(targets)
    for s in targets:
        assert sum(x["taken"] for x in got if x["source"] == s) == pytest.approx(targets[s], abs=0.51)
    assert all(x["taken"] <= 3 * x["size"] for x in got)


def test_schedule_is_even_and_complete(spark):
    quota = {0: 500, 1: 300, 2: 150, 3: 49, 4: 1}
    rows = mixing.schedule(spark.createDataFrame(list(quota.items()), "src int, n_slots long"), 1000, chunk=64).collect()
    assert {s: sorted(r["rank"] for r in rows if r["src"] == s) for s in quota} == {s: list(range(n)) for s, n in quota.items()}
    order = sorted(rows, key=lambda r: r["slot"])
    assert all([r["rank"] for r in order if r["src"] == s] == list(range(n)) for s, n in quota.items())
    for at in range(100, 1000, 100):  # every stretch has about its share
        assert abs(sum(r["src"] == 0 for r in order[:at]) - at / 2) <= 4


def test_words_and_sql(spark, tmp_path):
    rows = [(i, t, s) for i, (t, s) in enumerate([("a b\tc\x0bd", "x"), (None, "x"), ("", "y"), ("  one word ", "y"), ("w " * 90, "z"), ("w " * 9, None)])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = sorted(map(tuple, mixing.mix_documents(df).collect()), key=str)
    assert {g[0]: g[2] for g in got} == {0: 4, 1: 0, 2: 0, 3: 2 - 1, 4: 90, 5: 9}
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(mixing.mix_sql()).fetchall(), key=str) == got


def test_no_documents(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    void = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix_documents(void).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_intermediate_tables_go_with_the_mix(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 5), f"s{i % 3}") for i in range(40)], "doc_id long, text string, source string")
    with scope(spark, "kept"):
        assert mixing.mix_corpus(docs).count() == 40
        assert [x.split("-")[0] for x in os.listdir(shared_path(spark, "").rsplit("/", 1)[0])] == ["mixed"]
