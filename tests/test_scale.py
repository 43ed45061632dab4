"""What only shows, or only hurts, on tables larger than those of the other tests."""

import pytest
from pyspark.sql import functions as F

from skein import corpus_queries
from skein.operators import analytics, bridges, fuzzy, paths, traverse
from skein.operators.components import components
from skein.plans.graph import Graph
from skein.sources import corpus as corpus_source

from .conftest import entry


def tables(spark, folder, parts, suppliers=3):
    """Star-schema tables of one nation, with as many parts and suppliers."""
    key = lambda c, n: spark.range(n).withColumnRenamed("id", c)
    out = {
        "nation": key("n_nationkey", 10).select(F.col("n_nationkey").cast("int"), F.concat(F.lit("NATION_"), "n_nationkey").alias("n_name"), F.lit(0).alias("n_regionkey")),
        "supplier": key("s_suppkey", suppliers).select("s_suppkey", F.format_string("Supplier#%09d", "s_suppkey").alias("s_name"), (F.col("s_suppkey") % 10).cast("int").alias("s_nationkey")),
        "part": key("p_partkey", parts).select("p_partkey", F.lit("ring").alias("p_name"), F.lit("Brand#1").alias("p_brand")),
    }
    for name, df in out.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_corpus_files_of_a_thousand_and_more_sort_in_the_order_of_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_queries, "FILE_VALUES", 1)
    corpus_queries.write_corpus(spark, tables(spark, tmp_path, 1100), str(tmp_path / "corpus"))
    entries = corpus_source.load(spark, str(tmp_path / "corpus"), corpus_queries.CONFIG).entries
    got = [r["uuid"] for r in entries.filter("galaxy = 'part'").orderBy("ord").collect()]
    assert got == [f"part:{k}" for k in range(1100)]


def two_actors(corpus):
    actors = [entry("a1", "One", ("t1", "uses"), ("t2", "uses")), entry("a2", "Two", ("t1", "uses"))]
    tools = [entry(f"t{k}", f"Tool {k}", *([("t1", "similar")] if k > 1 else [])) for k in range(1, 5)]
    return corpus({"threat-actor": actors, "tool": tools})


def test_what_is_asked_of_some_nodes_derives_no_edges_of_all(spark, corpus, monkeypatch):
    whole = corpus_source.load(spark, two_actors(corpus))
    want = sorted(tuple(r) for r in whole.adj.filter("src IN ('t1', 'a2')").drop("dst_group_count").collect())
    for name in ("adj", "_pairs"):
        monkeypatch.setattr(Graph, name, property(lambda self: pytest.fail("all edges")))
    graph = corpus_source.load(spark, two_actors(lambda g: corpus(g, name="again"))).keep()
    nodes = spark.createDataFrame([("t1",), ("a2",), ("nobody",)], "node string")
    for few in (True, False):
        assert sorted(tuple(r) for r in graph.adj_of(nodes, few).collect()) == want
    assert {r["first_type"]: r["n"] for r in analytics.relations_by_type(graph, "t1").collect()} == {"uses": 2, "similar": 3}
    assert [(r["uuid"], r["group_count"]) for r in traverse.neighbours(graph, "a2", traverse.Walk(depth=2)).orderBy("rank").collect()] == [("t1", 2), ("a1", 0), ("t2", 1), ("t3", 0), ("t4", 0)]
    assert [r["uuid"] for r in paths.shortest_path(graph, "a2", "t4").collect()] == ["a2", "t1", "t4"]
    assert [(r["uuid"], r["group_count"]) for r in analytics.most_generic(graph).collect()] == [("t1", 2), ("t2", 1)]
    assert analytics.compare_summary(graph, "a1", "a2").first()["shared_count"] == 1
    assert graph.thresholds.count() == 0


def test_a_walk_that_has_met_its_cap_goes_no_further(spark, corpus, monkeypatch):
    graph = corpus_source.load(spark, two_actors(corpus)).keep()
    steps, step = [], traverse.step
    monkeypatch.setattr(traverse, "step", lambda *a: steps.append(1) or step(*a))
    got = traverse.walk(graph, traverse.one(graph, "t1"), traverse.Walk(depth=3, max_visited=4)).select("uuid").collect()
    assert sorted(r[0] for r in got) == ["a1", "a2", "t2", "t3", "t4"] and len(steps) == 1


def test_bridges_seek_components_only_off_the_first_tree(spark, monkeypatch):
    sought = []
    monkeypatch.setattr(bridges, "components", lambda left: sought.append(left.count()) or components(left))
    ring = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("c", "d")]
    find = lambda links: sorted(map(tuple, bridges.find_bridges(spark.createDataFrame(links, "a string, b string")).collect()))
    assert find(ring) == [("c", "d")] and not sought
    assert find([*ring, ("p", "q"), ("x", "y"), ("y", "z"), ("x", "z")]) == [("c", "d"), ("p", "q")] and sought == [4]
    assert bridges.find_bridges(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_corpus_is_parsed_once(spark, corpus):
    graph = corpus_source.load(spark, two_actors(corpus)).keep()
    assert graph.source.storageLevel.useDisk
    assert graph.links.count() == 6 and graph.plain_nodes.count() == 6


def test_near_names_of_one_length_do_not_meet_in_one_task(spark, corpus, monkeypatch):
    graph = corpus_source.load(spark, two_actors(corpus)).keep()
    asked = spark.createDataFrame([(0, "Tool 9")], "query_id int, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = fuzzy.near_pairs(graph, asked)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [length" in plan and "SortMergeJoin [length" not in plan
        got = sorted(r["matched"] for r in pairs.collect())
        monkeypatch.setattr(fuzzy, "FEW", 0)
        assert sorted(r["matched"] for r in fuzzy.near_pairs(graph, asked).collect()) == got == ["One", "Tool 1", "Tool 2", "Tool 3", "Tool 4", "Two"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
