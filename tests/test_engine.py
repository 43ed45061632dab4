"""Small corpora with answers worked out by hand."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from skein.config import Config
from skein.engine import Engine, NotLoaded, UnknownNode
from skein.operators import analytics, paths, resolve, traverse
from skein.operators.bridges import find_bridges
from skein.operators.draft import Draft, render
from skein.operators.traverse import Walk
from skein.sources import corpus as corpora
from skein.sources import snapshots

from .conftest import entry

SCOPED = Config(scope=None)


def load(spark, root):
    e = Engine(spark, SCOPED)
    e.load(root, "deadbeef")
    return e


def uuids(result):
    return [n["uuid"] for n in result["neighbours"]]


@pytest.fixture
def chain(spark, corpus):
    return load(spark, corpus({
        "malware": [entry("u-nasty", "Nasty", ("u-actor", "used-by"), synonyms=["Nastier", "APT-28"]), entry("u-orphan", "Orphaned"), entry(None, "NoIdentifier"), {"uuid": "u-none", "value": "", "related": [{"dest-uuid": "u-orphan", "type": "x"}]}],
        "threat-actor": [entry("u-actor", "Someone", ("u-report", "documented-by"), ("u-missing", "similar"), ("u-actor", "similar")), {"uuid": "u-retired", "value": "Retired", "revoked": True}],
        "references": [entry("u-report", "Vendor Report 2024")],
        "empty": [],
    }, [{"type": "malware", "name": "Bad software", "namespace": "ns", "description": ""}, {"type": "nowhere", "name": "x"}, "{broken"]))


def test_chain(chain):
    stats = chain.status()["stats"]
    assert {k: stats[k] for k in ("nodes", "edges", "bridges", "dangling", "revoked", "synthetic", "galaxies", "source_ref")} == {"nodes": 7, "edges": 3, "bridges": 3, "dangling": 1, "revoked": 1, "synthetic": 1, "galaxies": 4, "source_ref": "deadbeef"}
    assert [(g["type"], g["name"], g["namespace"], g["nodes"]) for g in chain.galaxies()] == [("malware", "Bad software", "ns", 3), ("references", "References", "", 1), ("threat-actor", "Threat-Actor", "", 2)]
    assert [(c["uuid"], c["reason"], c["score"]) for c in chain.resolve("Nasty")["candidates"]] == [("u-nasty", "value", 100)]
    for q in ("APT28", "apt 28", "a.p.t-28"):
        found = chain.resolve(q)
        assert [(c["uuid"], c["reason"], c["matched"]) for c in found["candidates"]] == [("u-nasty", "synonym", "APT-28")] and not found["ambiguous"]
    assert chain.resolve("retired")["candidates"][0]["score"] == -100
    assert chain.resolve("--")["count"] == 0
    assert "u-report" in uuids(chain.neighbours("u-nasty", Walk(depth=2))) and "u-report" not in uuids(chain.neighbours("u-nasty"))
    assert uuids(chain.neighbours("u-nasty", Walk(depth=2, galaxies=("references",)))) == ["u-report"]
    assert uuids(chain.neighbours("u-nasty", Walk(depth=2, edge_types=("used-by",)))) == ["u-actor"]
    assert uuids(chain.neighbours("u-nasty", Walk(depth=2, skip_dangling=True))) == ["u-actor", "u-report"]
    route = chain.path("u-nasty", "u-report")
    assert [h["uuid"] for h in route["path"]] == ["u-nasty", "u-actor", "u-report"] and route["hops"] == 2 and route["path"][-1]["via"] == "documented-by"
    assert all(h["bridge"] for h in route["path"][1:]) and route["weakest_link"] == "Nasty -> Someone (used-by)"
    assert not chain.path("u-nasty", "u-report", 1)["found"] and not chain.path("u-nasty", "u-orphan")["found"]
    assert len(chain.path("u-nasty", "u-nasty")["path"]) == 1
    detail = chain.node("u-actor")
    assert detail["degree"] == 3 and detail["relations_by_type"] == {"used-by": 1, "documented-by": 1, "similar": 1}
    assert chain.node("synthetic::malware::NoIdentifier")["synthetic"] and chain.node("u-missing")["dangling"]
    assert chain.node("u-nasty")["meta"] == {"synonyms": ["Nastier", "APT-28"]}
    assert chain.has_galaxy("MALWARE") and not chain.has_galaxy("empty")
    with pytest.raises(UnknownNode):
        chain.node("u-nope")


def test_snapshots(chain, spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    first = chain.publish(folder)
    again = Engine(spark, SCOPED)
    with pytest.raises(NotLoaded):
        again.galaxies()
    assert again.open(folder)["stats"] == chain.status()["stats"]
    assert again.resolve("Nastier")["candidates"] == chain.resolve("Nastier")["candidates"]
    assert again.neighbours("u-nasty", Walk(depth=2)) == chain.neighbours("u-nasty", Walk(depth=2))
    assert snapshots.current_version(spark, folder) == (first, "deadbeef")
    with pytest.raises(Exception):  # noqa: B017  whatever the store says of a folder that isn't there
        again.open(str(tmp_path / "none"))
    assert again.galaxies() == chain.galaxies()


def test_loading_errors(spark, corpus, tmp_path):
    e = Engine(spark, SCOPED)
    with pytest.raises(FileNotFoundError):
        e.load(str(tmp_path))
    root = corpus({"tool": [entry("u", "T")]})
    assert corpora.is_usable(spark, root) and corpora.count_clusters(spark, root) == 1
    e.load(root)
    (tmp_path / "corpus" / "clusters" / "bad.json").write_text("{ not json")
    with pytest.raises(Exception):  # noqa: B017
        e.load(root)
    assert e.resolve("T")["count"] == 1


def test_first_file_wins_and_types_fall_back_to_names(spark, corpus, tmp_path):
    root = corpus({"a": [entry("u-1", "First", ("u-2", "x")), entry("u-2", "Two")], "b": [entry("u-1", "Second", ("u-3", "y")), entry("u-3", "Three")]})
    (tmp_path / "corpus" / "clusters" / "sub").mkdir()
    (tmp_path / "corpus" / "clusters" / "sub" / "Other.JSON").write_text(json.dumps({"values": [{"uuid": "u-9", "value": "Nine", "meta": {"synonyms": ["ok", 1]}}]}))
    e = load(spark, root)
    assert e.node("u-1")["value"] == "First" and e.node("u-3")["degree"] == 0
    assert e.node("u-9")["galaxy"] == "Other.JSON" and e.node("u-9")["synonyms"] == []


def test_resolution_order(spark, corpus):
    e = load(spark, corpus({"one": [entry("u-bare", "Twin"), entry("u-alpha", "Alpha")], "two": [entry("u-linked", "Twin", ("x-1", "a"), ("x-2", "a")), entry("u-ext", "Alpha Extended", ("x-1", "a"), ("x-2", "a"), ("x-3", "a")), entry("u-syn", "Other", synonyms=["xxAlphaxx", "Alphabet"])]}))
    assert [c["uuid"] for c in e.resolve("twin", limit=1)["candidates"]] == ["u-linked"]
    got = [(c["uuid"], c["reason"], c["score"], c["matched"]) for c in e.resolve("alpha", group=True)["candidates"]]
    assert got == [("u-alpha", "value", 100, "Alpha"), ("u-ext", "value_prefix", 73, "Alpha Extended"), ("u-syn", "synonym_prefix", 69, "Alphabet")]
    assert [(g["galaxy"], g["count"]) for g in e.resolve("alpha", group=True)["by_galaxy"]] == [("two", 2), ("one", 1)]
    assert [c["uuid"] for c in e.resolve("alpha", galaxies=["ONE "])["candidates"]] == ["u-alpha"]
    names = spark.createDataFrame([(1, "alpha"), (2, "Twin"), (3, "zz"), (4, "-"), (5, "ex")], "query_id int, query string")
    rows = resolve.resolve_batch(e.graph, names).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["uuid"]) for r in rows] == [(1, "u-alpha"), (1, "u-ext"), (1, "u-syn"), (2, "u-linked"), (2, "u-bare"), (5, "u-ext")]


def test_aggressive_mode(spark, corpus):
    e = load(spark, corpus({"malpedia": [entry("u-i", "win.icefog")]}))
    assert e.resolve("Icefog", mode="aggressive")["candidates"][0]["reason"] == "value"
    assert e.resolve("Icefog")["candidates"][0]["reason"] == "substring"
    with pytest.raises(ValueError):
        e.resolve("x", mode="loose")


def test_merged_links(spark, corpus):
    e = load(spark, corpus({"tool": [entry("A", "A", ("B", "similar")), entry("B", "B", ("A", "used-by"))]}))
    link = e.graph.links.first()
    assert (link["confidence"], link["types"], link["first_type"]) == (2, ["similar", "used-by"], "similar")
    for how in (Walk(edge_types=("similar",)), Walk(edge_types=("Used-By",)), Walk(direction="out"), Walk(direction="in")):
        rows = e.neighbours("A", how)["neighbours"]
        assert [r["uuid"] for r in rows] == ["B"] and rows[0]["bridge"] and rows[0]["confidence"] == 2
        assert rows[0]["via"] == ("used-by" if how.edge_types == ("Used-By",) else "similar")
    assert e.node("A")["degree"] == 2


def test_ring_has_one_bridge(spark, corpus):
    e = load(spark, corpus({"x": [entry("r-a", "a", ("r-b", "s")), entry("r-b", "b", ("r-c", "s")), entry("r-c", "c", ("r-a", "s"), ("r-far", "s")), entry("r-far", "far")]}))
    assert [tuple(r) for r in e.graph.bridges.collect()] == [("r-c", "r-far")]


@pytest.fixture
def actors(spark, corpus):
    return load(spark, corpus({"threat-actor": [entry("a-1", "One", ("t-common", "uses"), ("t-rare", "uses")), entry("a-2", "Two", ("t-common", "uses")), entry("a-3", "Three", ("t-common", "uses"))], "technique": [entry("t-common", "Common"), entry("t-rare", "Rare")]}))


def test_group_counts_and_blocking(actors):
    counts = {r["uuid"]: r["group_count"] for r in actors.graph.nodes.collect()}
    assert counts == {"t-common": 3, "t-rare": 1, "a-1": 0, "a-2": 0, "a-3": 0}
    assert uuids(actors.neighbours("a-1")) == ["t-rare", "t-common"]
    assert uuids(actors.neighbours("a-1", Walk(depth=2, max_group_count=2))) == ["t-rare"]
    near = actors.neighbours("a-1")["neighbours"]
    assert {n["generic_threshold"] for n in near} == {9} and not any(n["generic"] for n in near)
    assert [x["uuid"] for x in actors.most_generic("TECHNIQUE", 1)["entries"]] == ["t-common"]


def test_ranking_goes_before_limits(spark, corpus):
    e = load(spark, corpus({
        "malware": [entry("m-1", "M", *[(f"t-{i}", "uses") for i in range(20)], ("a-last", "used-by")), entry("m-2", "N", ("t-exclusive", "u"), ("t-orphan", "u"), ("t-shared", "u"))],
        "technique": [entry(f"t-{i}", f"T{i}") for i in range(20)] + [entry("t-exclusive", "E"), entry("t-orphan", "A"), entry("t-shared", "B")],
        "threat-actor": [entry("a-last", "Z", ("t-exclusive", "u"), ("t-shared", "u")), entry("a-b", "Y", ("t-shared", "u"))],
    }))
    assert e.neighbours("m-1")["count"] == 21 and uuids(e.neighbours("m-1", Walk(limit=1))) == ["a-last"]
    assert uuids(e.neighbours("m-2")) == ["t-exclusive", "t-shared", "t-orphan"]


def test_thresholds(spark, corpus):
    busy = [entry(f"a-{i}", f"A{i}", *[("t-busy", "u")], *([("t-quiet", "u")] if i < 3 else []), (f"t-{i}", "u")) for i in range(12)]
    e = load(spark, corpus({"threat-actor": busy, "technique": [entry(f"t-{i}", f"T{i}") for i in range(12)] + [entry("t-quiet", "Quiet"), entry("t-busy", "Busy")]}))
    assert [tuple(r) for r in e.graph.thresholds.collect()] == [("technique", 3)]
    flags = {n["uuid"]: n["generic"] for n in e.neighbours("a-0")["neighbours"]}
    assert flags == {"t-0": False, "t-quiet": False, "t-busy": True}


def test_long_chains_and_caps(spark, corpus):
    e = load(spark, corpus({"x": [entry(f"n-{i:02}", f"N{i:02}", *([(f"n-{i + 1:02}", "next")] if i < 11 else [])) for i in range(12)]}))
    assert e.neighbours("n-00", Walk(depth=99))["count"] == 4
    assert e.neighbours("n-00", Walk(depth=99, max_visited=2))["count"] == 1
    assert not e.path("n-00", "n-11")["found"] and e.path("n-00", "n-06")["hops"] == 6
    assert [h["via"] for h in e.path("n-00", "n-06")["path"]] == [""] + ["next"] * 6
    assert e.neighbours("n-00", Walk(depth=2), with_paths=True)["neighbours"][1]["path"] == ["n-00", "n-01", "n-02"]


def test_compare(spark, corpus):
    def techniques(own):
        return [("t-both", "u"), ("t-common", "u"), (own, "u")]

    more = [entry(f"c-{i}", f"C{i}", ("t-common", "u")) for i in range(10)]
    e = load(spark, corpus({"threat-actor": [entry("a-1", "A", *techniques("t-a-only")), entry("b-1", "B", *techniques("t-b-only")), *more], "technique": [entry(t, t) for t in ("t-both", "t-common", "t-a-only", "t-b-only")]}))
    got = e.compare("a-1", "b-1")
    assert got["similarity"] == pytest.approx(1 / 3) and got["generic_excluded"] == 2 and not got["truncated"]
    assert [[x["uuid"] for x in got[s]] for s in ("shared", "a_only", "b_only")] == [["t-both"], ["t-a-only"], ["t-b-only"]]
    full = e.compare("a-1", "b-1", include_generic=True)
    assert [x["uuid"] for x in full["shared"]] == ["t-both", "t-common"] and full["similarity"] == 0.5
    for bad in (("a-1", "a-1"), ("", "b-1"), ("a-1", "nope")):
        with pytest.raises(ValueError):
            e.compare(*bad)


def test_co_occurrence(spark, corpus):
    both = [entry(f"a-{i:02}", f"A{i}", *([("t-link", "u"), ("t-spear", "u")] if i < 10 else []), ("t-other", "u")) for i in range(12)]
    e = load(spark, corpus({"threat-actor": both, "technique": [entry(t, t) for t in ("t-link", "t-spear", "t-other", "t-rare")], "malware": [entry("m-1", "M", *[(t, "u") for t in ("t-link", "t-spear", "t-other", "t-rare")])]}))
    pairs = e.co_occurrence(galaxy="Technique")["pairs"]
    assert [(p["a_uuid"], p["b_uuid"], p["shared"]) for p in pairs] == [("t-link", "t-spear", 10), ("t-link", "t-other", 10), ("t-spear", "t-other", 10)]
    assert [p["rate"] for p in pairs] == pytest.approx([1, 10 / 12, 10 / 12]) and pairs[1]["b_only"] == 2
    assert e.co_occurrence(uuid="m-1", min_rate=0.75)["count"] == 3
    assert e.co_occurrence(galaxy="technique", min_actors=11)["count"] == 0
    for bad in ({}, {"galaxy": "x", "min_rate": 1.5}, {"galaxy": "x", "min_rate": float("nan")}, {"uuid": "nope"}):
        with pytest.raises(ValueError):
            e.co_occurrence(**bad)


def test_profile(spark, corpus):
    many = [entry(f"a-{i:02}", f"X{i}", ("t-shared", "u")) for i in range(11)]
    e = load(spark, corpus({"threat-actor": [entry("a-main", "Main", ("t-only", "u"), ("t-shared", "u")), *many], "technique": [entry(t, t) for t in ("t-only", "t-shared", "t-orphan")], "malware": [entry("m-1", "M", ("a-main", "used-by"), ("t-only", "u"), ("t-shared", "u"), ("t-orphan", "u"), ("t-gone", "u"))]}))
    p = e.profile("m-1")
    assert (p["specific"], p["generic"], p["unattributed"], p["dangling"], p["total"]) == (1, 1, 1, 1, 5)
    assert [(g["galaxy"], g["count"]) for g in p["groups"]] == [("threat-actor", 1), ("technique", 3), ("(undefined in this checkout)", 1)]
    assert e.profile("m-1", limit=1)["truncated"] and e.profile("a-00")["specific"] == 0 and e.profile("a-00")["note"]
    assert analytics.profile(e.graph, "m-1").count() == 3


def test_references(spark, corpus):
    links = ["https://securelist.com/a", "https://www.securelist.com/b", "https://attack.mitre.org/x", " https://securelist.com/a ", "https://other.org/c"]
    e = load(spark, corpus({"tool": [entry("u-1", "One", refs=links), entry("u-2", "Two"), entry("u-3", "Three", refs="one", references=["https://x.org"])]}))
    got = e.refs("u-1")
    assert [r["url"] for r in got["references"]] == [links[0], links[1], links[4], links[2]] and got["references"][-1]["self_referential"]
    assert got["publishers"] == [{"domain": "securelist.com", "count": 2}, {"domain": "other.org", "count": 1}]
    assert e.refs("u-2")["count"] == e.refs("u-3")["count"] == 0 and e.refs("u-2")["note"]


def test_fuzzy(spark, corpus):
    made = [("Kimsuky", "KP"), ("APT28", "RU"), ("APT29", "RU"), ("Callisto", "RU"), ("Calisto", "CN")]
    e = load(spark, corpus({"threat-actor": [entry(f"u-{n}", n, country=c) for n, c in made] + [entry("u-cg", "Callisto Group")]}))
    near = lambda q, **k: {m["value"]: round(m["similarity"], 4) for m in e.fuzzy(q, **k)["matches"]}
    assert near("Kimsuki") == {"Kimsuky": 0.939} and near("APT28") == {}
    assert near("APT28", min_similarity=0.7)["APT29"] == 0.736 and near("Kimsuki", min_similarity=0.8)["Callisto"] == 0.8
    found = e.fuzzy("Callisto")["matches"]
    assert [(m["value"], m["blocked"], m["blocked_reason"]) for m in found] == [("Calisto", True, "conflicting country: RU vs CN")]
    assert near("Calisto Group", min_similarity=0.8)["Callisto Group"] == pytest.approx(0.8378, abs=1e-4)
    for bad in ((" ", None), ("x", 2.0), ("x", float("nan"))):
        with pytest.raises(ValueError):
            e.fuzzy(bad[0], min_similarity=bad[1])


def test_drafts(spark, corpus):
    e = load(spark, corpus({"threat-actor": [entry("u-mp", "MUSTANG PANDA", ("u-gone", "x"), synonyms=["HoneyMyte", "Earth Preta"])], "tool": [entry("u-plugx", "PlugX"), entry("u-ts", "ToneShell")]}))
    for name in ("plug-x", "HoneyMyte"):
        assert e.draft(Draft(name, "tool"))["refused"]
    got = e.draft(Draft("ToneShel", "  Tool ", "a <b> & c", used_by="u-mp"))
    assert not got["refused"] and got["galaxy"] == "tool" and got["near"][0]["value"] == "ToneShell"
    assert got["entry"]["related"] == [{"dest-uuid": "u-mp", "tags": ['estimative-language:likelihood-probability="likely"'], "type": "used-by"}]
    lines = got["json"].split("\n")
    assert lines[0] == "{" and lines[1] == '      "description": "a \\u003cb\\u003e \\u0026 c",' and lines[-1] == "    }" and render(None) == ""
    for bad in (Draft("", "tool"), Draft("New", ""), Draft("New", "tools"), Draft("New", "tool", used_by="u-plugx"), Draft("New", "tool", used_by="u-gone"), Draft("New", "tool", used_by="no"), Draft("New", "tool", used_by="u-mp", confidence="sure")):
        with pytest.raises(ValueError):
            e.draft(bad)


def random_corpus(r, n=14):
    nodes = [f"n{i:02}" for i in range(n)]
    return {"threat-actor": [entry(u, u.upper(), *[(r.choice(nodes), r.choice("xyz")) for _ in range(r.randint(0, 3))]) for u in nodes[: n // 3]], "tool": [entry(u, u.upper(), *[(r.choice(nodes), r.choice("xyz")) for _ in range(r.randint(0, 3))]) for u in nodes[n // 3 :]]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walks_paths_and_bridges_by_brute_force(spark, corpus, seed):
    r = random.Random(seed)
    e = load(spark, corpus(random_corpus(r)))
    adj = {}
    for row in e.graph.adj.orderBy("src", "adj_pos").collect():
        adj.setdefault(row["src"], []).append(row)
    for cap, most in ((20_000, 0), (6, 0), (9, 2)):
        seen, queue, order = {"n00": (0, None)}, deque(["n00"]), []
        while queue and len(seen) < cap:
            at = queue.popleft()
            if seen[at][0] == 3:
                continue
            for row in adj.get(at, []):
                if row["dst"] not in seen and not (most and row["dst_group_count"] > most):
                    seen[row["dst"]] = (seen[at][0] + 1, at)
                    queue.append(row["dst"])
                    order.append(row["dst"])
        got = traverse.walk(e.graph, traverse.one(e.graph, "n00"), Walk(depth=3, max_visited=cap, max_group_count=most)).orderBy("depth", "arrival").collect()
        assert [(g["uuid"], g["depth"], g["from_uuid"]) for g in got] == [(u, *seen[u]) for u in order]
    far, queue = {"n00": 0}, deque(["n00"])
    while queue:
        at = queue.popleft()
        for row in adj.get(at, []):
            if row["dst"] not in far:
                far[row["dst"]] = far[at] + 1
                queue.append(row["dst"])
    for target in ("n07", "n13"):
        hops = paths.shortest_path(e.graph, "n00", target).collect()
        want = far.get(target, 99)
        assert len(hops) - 1 == (want if want <= 6 else -1)
        for a, b in zip(hops, hops[1:], strict=False):
            assert any(row["dst"] == b["uuid"] and row["first_type"] == b["via"] for row in adj[a["uuid"]])
    links = [(x["a"], x["b"]) for x in e.graph.links.collect()]

    def joined(a, b, without):
        seen, todo = {a}, [a]
        while todo:
            at = todo.pop()
            for x, y in links:
                if (x, y) != without and at in (x, y) and (o := y if at == x else x) not in seen:
                    seen.add(o)
                    todo.append(o)
        return b in seen

    assert sorted(map(tuple, find_bridges(e.graph.links).collect())) == sorted(x for x in links if not joined(*x, x))


def test_where_a_corpus_comes_from(spark, tmp_path, corpus, monkeypatch):
    from skein.sources.corpus import REF_VARIABLE, source_ref

    monkeypatch.delenv(REF_VARIABLE, raising=False)
    root = corpus({"tool": [entry("t", "A tool")]})
    assert source_ref(spark, root, {}) == ""
    (tmp_path / "corpus" / "CORPUS_REF").write_text(" file-ref \n")
    assert source_ref(spark, root, {}) == "file-ref" and source_ref(spark, root, {REF_VARIABLE: " env-ref "}) == "env-ref"
    git = tmp_path / "corpus" / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack-refs\nabc123 refs/heads/main\n")
    assert source_ref(spark, root, {REF_VARIABLE: "env-ref"}) == "abc123"
    (git / "refs" / "heads" / "main").write_text("def456\n")
    e = Engine(spark, Config(scope=None))
    assert e.source_status(str(tmp_path / "none")) == {"expected": "", "current": "", "in_sync": False, "ready": False}
    assert e.load(root)["stats"]["source_ref"] == "def456"
    version = e.publish(str(tmp_path / "snapshots"))
    assert e.source_status(str(tmp_path / "snapshots")) == {"expected": version, "current": "", "in_sync": False, "ready": True}
    e.open(str(tmp_path / "snapshots"))
    assert e.source_status(str(tmp_path / "snapshots")) == {"expected": version, "current": version, "in_sync": True, "ready": True}


def test_streamed_declarations(spark, tmp_path):
    from skein.streaming.declarations import follow, read_links

    source, out = str(tmp_path / "in"), str(tmp_path / "links")
    rows = [("a", "b", "x", 1), ("b", "a", "y", 2), ("a", "a", "x", 3), ("a", "c", "", 4), ("c", "a", "z", 5), ("c", "", "z", 6)]
    schema = "src string, dst string, type string, seq long"
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        follow(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "checkpoint")).awaitTermination()
    got = [(r["a"], r["b"], r["first_type"], r["types"], r["confidence"]) for r in read_links(spark, out).orderBy("a", "b").collect()]
    assert got == [("a", "b", "x", ["x", "y"], 2), ("a", "c", "", ["z"], 2)]


def test_queries_and_oracles_have_the_same_names():
    from skein import queries

    assert set(queries.oracle_sql()) == set(queries.queries()) - {"bridges"}
    assert F
