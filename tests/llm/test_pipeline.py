import random

import pytest

import __spark_entry__
import corpus_pipeline
from skein.llm import simhash

ITEM = "Which river flows past the oldest mill of the northern valley, and who built its second bridge?"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def rows():
    r = random.Random(2)
    words = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(r.choices(words, k=n))
    out = [(i, "\n".join(say(r.randint(8, 40)) for _ in range(3)), "en" if i % 2 else "de", f"src{i % 4}") for i in range(60)]
    own = say(300).split()
    base = " ".join(own)
    edits = (" ".join([*own[:k], "Other", *own[k + 1 :]]) for k in range(300))
    near = next(e for e in edits if bin(simhash.fingerprint(e) ^ simhash.fingerprint(base)).count("1") <= 2)
    out += [(100, base, "en", "src0"), (101, near, "en", "src1"), (102, base, "en", "src1")]
    out += [(200, f"{say(20)} {ITEM} {say(20)}", "en", "src2"), (300, None, "en", "src0"), (301, "123 --", "en", "src0"), (302, say(30), None, None), (303, "", "de", "src1")]
    return [(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    every = [r[0] for r in rows()]
    stages = dict(corpus_pipeline.STAGES)
    got = stages["language_id"](spark, docs, sf_dir)
    assert got.columns == docs.columns and ids(got) == [i for i in every if i not in (300, 301, 303)] and got.filter("lang IS NULL").isEmpty()
    lined = stages["line_dedup"](spark, docs, sf_dir)
    assert lined.columns == docs.columns and ids(lined) == every and lined.filter("doc_id = 102").first()["text"] == "" and lined.filter("n_chars <> coalesce(length(text), 0)").isEmpty()
    one = stages["near_dedup"](spark, docs, sf_dir)
    assert one.columns == docs.columns and ids(one) == [i for i in every if i not in (101, 102, 303)]
    clean = stages["decontaminate"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and ids(clean) == [i for i in every if i != 200]
    assert ids(stages["mix"](spark, docs, sf_dir)) == every


def test_run_applies_all_stages(spark, sf_dir):
    """101 and 102 lose their only line to 100 and are alike then; the first of them stays, without text."""
    df = __spark_entry__.queries()["pipeline"](spark, sf_dir)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "size", "source_size", "target", "taken", "n_slots", "first_slot"]
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got) == {*range(60), 100, 101, 302} and got[101]["text"] == "" and got[101]["taken"] == 0
    first = {r[0]: r for r in rows()}
    assert all(got[k]["text"] == first[k][1] and got[k]["source"] == first[k][3] and got[k]["n_chars"] == len(first[k][1]) for k in (*range(60), 100, 302))
    assert got[302]["lang"] in ("en", "de") and all(got[k]["lang"] == first[k][2] for k in range(60))
    assert sum(r["taken"] for r in got.values()) == pytest.approx(sum(r["size"] for r in got.values()), abs=5)


def test_run_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(5, "same text here", "a")] * 3 + [(5, "another text altogether", "a"), (None, "same text here", "b"), (6, None, "c"), (7, "", "c")]
    for name in ("f", "__hash", "__row", "__doc", "one", "text_hash"):  # a column of any name stays as it is
        got = simhash.keep_one(spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string"))
        assert got.columns == ["doc_id", "text", name]
    got = got.collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, "another text altogether", "a"), (None, "same text here", "b"), (6, None, "c")], key=str)
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
