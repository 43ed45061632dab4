"""Queries over a corpus of JSON cluster files that is written from the star-schema tables first, with the SQL that gives the same rows.

Its files hold what tables cannot: entries without a name or an identifier,
repeated identifiers, relations to nothing and to themselves, revoked
entries, and synonyms, countries and references in meta.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .engine import Engine
from .operators import draft, fuzzy, paths, refs, resolve, traverse
from .plans.graph import Graph
from .plans.state import shared_folder
from .queries import _BASE, _FOLD, _names_cte, _ranked, _reason, _score, _walk_ctes
from .sources import corpus

CONFIG = Config(actor_galaxies=("supplier",), scope=None)
#: Values of a cluster file, and files of a folder: Spark numbers a task's files with three digits, so names of more would not sort in order.
FILE_VALUES, FOLDER_FILES = 100, 500
_graphs: dict[tuple[str, str], Graph] = {}


def write_corpus(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Cluster files of nations, suppliers and parts, and one that repeats an identifier; paths sort in the order of keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    related = lambda dst, kind: F.struct(dst.alias("dest-uuid"), F.lit(kind).alias("type"), F.array(F.lit("t")).alias("tags"))
    words = lambda *xs: F.array(*xs) if xs else F.array().cast("array<string>")

    def value(key, ident, name, revoked, synonyms, country, refs_, official, relations):
        meta = F.struct(synonyms.alias("synonyms"), country.alias("country"), refs_.alias("refs"), official.alias("official-refs"))
        return F.struct(key.cast("long").alias("key"), ident.alias("uuid"), name.alias("value"), text("about ", name).alias("description"), revoked.alias("revoked"), meta.alias("meta"), relations.alias("related"))

    def write(df, galaxy, folder):
        files = df.groupBy(F.floor(F.col("v.key") / FILE_VALUES).alias("file")).agg(F.sort_array(F.collect_list("v")).alias("values"))  # FILE_VALUES at most
        rows = files.select(F.lpad(F.floor(F.col("file") / FOLDER_FILES).cast("string"), 16, "0").alias("group"), "file", F.lit(galaxy.title()).alias("name"), F.lit(galaxy).alias("type"), F.lit(f"g-{galaxy}").alias("uuid"), F.lit(1).alias("version"), F.transform("values", lambda v: v.dropFields("key")).alias("values"))
        # A group's files are written by one task, in order.
        dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "file").drop("file")
        dealt.write.partitionBy("group").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(f"{root}/clusters/{folder}")

    none, no, null = words(), F.lit(False), F.lit(None).cast("string")
    n, s, p = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    nation = read("nation").select(value(n, text("nation:", n.cast("string")), F.col("n_name"), no, none, null, none, none, F.array(related(text("region:", F.col("n_regionkey").cast("string")), "part-of"))).alias("v"))
    own = text("supplier:", s.cast("string"))
    site = text("https://www.site", (s % 5).cast("string"), ".example/")
    supplier = read("supplier").select(
        value(
            s, F.when(s % 10 == 3, "").otherwise(own), F.when(s % 17 == 5, "").otherwise(F.col("s_name")), s % 7 == 1, words(text("Acme ", s.cast("string")), F.lit("Shared Name")), text("C", (s % 3).cast("string")),
            words(text(site, "a"), F.lit(" https://attack.mitre.org/x ")), words(text(site, "b"), text(site, "a")), F.array(related(text("nation:", F.col("s_nationkey").cast("string")), "located-in"), related(own, "similar"), related(F.lit(""), "similar")),
        ).alias("v")
    )
    to = lambda k: text("supplier:", k.cast("string"))
    part = read("part").select(value(p, text("part:", p.cast("string")), text(F.col("p_name"), " ", p.cast("string")), no, words(F.col("p_brand")), null, none, none, F.array(related(to(p % 10), "used-by"), related(to((p * 7) % 10), "similar"))).alias("v"))
    again = spark.range(2).select(value(F.col("id"), text("nation:", F.col("id").cast("string")), F.lit("Said Again"), no, none, null, none, none, F.array(related(F.lit("nation:9"), "similar"))).alias("v"))
    for df, galaxy, folder in ((nation, "nation", "0-nation"), (supplier, "supplier", "1-supplier"), (part, "part", "2-part"), (again, "nation", "3-again")):
        write(df, galaxy, folder)


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's corpus, written and loaded once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        for k in [k for k in _graphs if k[0] != key[0]]:
            del _graphs[k]
        root = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
        write_corpus(spark, sf_dir, root)
        _graphs[key] = corpus.load(spark, root, CONFIG, "corpus").keep()
    return _graphs[key]


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near an entry's own: those of another country are blocked."""
    asked = spark.createDataFrame([(0, "Supplier#000000002")], "query_id long, query string")
    rows = fuzzy.fuzzy_batch(graph_of(spark, sf_dir), asked, ["supplier"], min_similarity=0.7, limit=1 << 30)
    return rows.select("uuid", "matched", "blocked", "blocked_reason")


def _region_of(spark: SparkSession, sf_dir: str, nation: int) -> str:
    return f"region:{spark.read.parquet(f'{sf_dir}/nation.parquet').filter(F.col('n_nationkey') == nation).first()['n_regionkey']}"


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one shortest path from a part over its supplier and nation to a region."""
    nation = spark.read.parquet(f"{sf_dir}/supplier.parquet").filter("s_suppkey = 0").first()["s_nationkey"]
    return paths.shortest_path(graph_of(spark, sf_dir), "part:0", _region_of(spark, sf_dir, nation), with_bridges=True).select("hop", "uuid", "value", "galaxy", "via", "confidence", "bridge")


def _weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, CONFIG, graph_of(spark, sf_dir))
    ends = (("nation:0", _region_of(spark, sf_dir, 0)), ("part:0", "part:0"), ("part:0", "supplier:0"))
    rows = [(a, b, out["found"], out["hops"], out.get("weakest_link")) for a, b in ends for out in [engine.path(a, b)]]
    return spark.createDataFrame(rows, "source string, target string, found boolean, hops int, weakest_link string")


DRAFTS = (draft.Draft("  Acme 2 ", "Supplier"), draft.Draft("Entirely <new> & other", " PART ", "what it is", ("https://a.example",), "2024-01-02", "supplier:2", "very-likely"))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for wish in DRAFTS:
        out = draft.draft(graph_of(spark, sf_dir), wish)
        text = re.sub(r'"uuid": "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"', '"uuid": "?"', draft.render(out["entry"]))
        rows.append((out["name"], out["galaxy"], out["refused"], ",".join(x["uuid"] for x in out["exact"]), len(out["near"]), text))
    return spark.createDataFrame(rows, "name string, galaxy string, refused boolean, exact string, near int, entry string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = graph_of
    walk = traverse.Walk(depth=2, limit=500)
    return {
        "corpus_nodes": lambda s, d: g(s, d).nodes.select("uuid", "value", "galaxy", F.array_join("synonyms", "|").alias("synonyms"), "revoked", "synthetic", "dangling", "degree", "group_count"),
        "corpus_links": lambda s, d: g(s, d).links.select("a", "b", "first_type", F.array_join("types", ",").alias("types"), "confidence"),
        "corpus_adjacency": lambda s, d: g(s, d).adj.select("src", "dst", "dir", "adj_pos", "confidence"),
        "corpus_galaxies": lambda s, d: g(s, d).galaxies.select("type", "name", "namespace", "description", "nodes"),
        "corpus_resolve": lambda s, d: resolve.resolve(g(s, d), "supplier#00000000", limit=60).select("rank", "uuid", "value", "reason", "matched", "score", "revoked", "synthetic"),
        "corpus_walk_paths": lambda s, d: traverse.neighbours(g(s, d), "nation:1", walk).select("uuid", "depth", "via", F.array_join("path", ">").alias("path")),
        "corpus_path_hops": _hops,
        "corpus_weakest_link": _weakest,
        "corpus_refs": lambda s, d: refs.references(g(s, d)).select("uuid", F.col("at").alias("pos"), "url", "domain", "self_referential"),
        "corpus_publishers": lambda s, d: refs.by_publisher(refs.references(g(s, d))),
        "corpus_fuzzy_conflicts": _fuzzy,
        "corpus_drafts": _drafts,
    }


# ---------------------------------------------------------------- oracles

_DERIVED = _BASE[_BASE.index("links AS (") :].replace("s.dst LIKE 'supplier:%'", "s.dst IN (SELECT uuid FROM entries WHERE galaxy = 'supplier')")
_CORPUS = (
    """
named AS (SELECT *, s_suppkey AS k, CASE WHEN s_suppkey % 10 = 3 THEN 'synthetic::supplier::' || s_name ELSE 'supplier:' || s_suppkey END AS uuid FROM supplier WHERE s_suppkey % 17 <> 5),
entries AS (
  SELECT 'nation:' || n_nationkey AS uuid, n_name AS value, 'nation' AS galaxy, CAST([] AS VARCHAR[]) AS synonyms, 0 AS kind, CAST(n_nationkey AS BIGINT) AS key, false AS revoked, false AS synthetic FROM nation
  UNION ALL SELECT uuid, s_name, 'supplier', ['Acme ' || k, 'Shared Name'], 1, k, k % 7 = 1, k % 10 = 3 FROM named
  UNION ALL SELECT 'part:' || p_partkey, p_name || ' ' || p_partkey, 'part', [p_brand], 2, p_partkey, false, false FROM part),
decl AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part-of' AS type, 0 AS k, CAST(n_nationkey AS BIGINT) AS x, 0 AS y, 0 AS z, 0 AS w FROM nation
  UNION ALL SELECT uuid, 'nation:' || s_nationkey, 'located-in', 1, k, 0, 0, 0 FROM named
  UNION ALL SELECT uuid, 'supplier:' || k, 'similar', 1, k, 1, 0, 0 FROM named WHERE k % 10 = 3
  UNION ALL SELECT 'part:' || p_partkey, 'supplier:' || (p_partkey % 10), 'used-by', 2, p_partkey, 0, 0, 0 FROM part
  UNION ALL SELECT 'part:' || p_partkey, 'supplier:' || (p_partkey * 7 % 10), 'similar', 2, p_partkey, 1, 0, 0 FROM part),
"""
    + _DERIVED
)
#: Whether the link between two nodes is the only join of its sides, by a walk that may not use it.
_BRIDGE = "NOT EXISTS (SELECT 1 FROM reach WHERE reach.a = {0} AND reach.b = {1} AND reach.here = {1})"
_REACH = "reach AS (SELECT a, b, a AS here FROM hops UNION SELECT r.a, r.b, s.dst FROM reach r JOIN sides s ON s.src = r.here WHERE NOT (r.here = r.a AND s.dst = r.b) AND NOT (r.here = r.b AND s.dst = r.a))"
_ENTRY = """{
      "description": "what it is",
      "meta": {
        "date": "2024-01-02",
        "refs": [
          "https://a.example"
        ]
      },
      "related": [
        {
          "dest-uuid": "supplier:2",
          "tags": [
            "estimative-language:likelihood-probability=\\"very-likely\\""
          ],
          "type": "used-by"
        }
      ],
      "uuid": "?",
      "value": "Entirely \\u003cnew\\u003e \\u0026 other"
    }"""


def _with(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([_CORPUS, *more]) + "\n" + body


def oracle_sql() -> dict[str, str]:
    ask = f"asked AS (SELECT {_FOLD.format(repr('supplier#00000000'))} AS q_key)"
    refs_sql = """(SELECT uuid, min(pos) AS pos, url FROM (SELECT uuid, unnest(['https://www.site' || (k % 5) || '.example/a', 'https://attack.mitre.org/x', 'https://www.site' || (k % 5) || '.example/b', 'https://www.site' || (k % 5) || '.example/a']) AS url, unnest(range(4)) AS pos FROM named) GROUP BY uuid, url)"""
    domain = r"regexp_replace(regexp_extract(url, '^https://([^/]*)', 1), '^www\.', '')"
    taken = " UNION ALL ".join(f"SELECT '{w.name.strip()}' AS name, '{w.galaxy.strip().lower()}' AS galaxy, {_FOLD.format(repr(w.name))} AS q_key" for w in DRAFTS)
    route = """route AS (SELECT 'supplier:0' AS s, 'nation:' || s_nationkey AS n, 'region:' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 0),
hops AS (SELECT 0 AS hop, CAST(NULL AS VARCHAR) AS a, 'part:0' AS b UNION ALL SELECT 1, 'part:0', s FROM route UNION ALL SELECT 2, s, n FROM route UNION ALL SELECT 3, n, r FROM route)"""
    return {
        "corpus_nodes": _with("SELECT n.uuid, n.value, n.galaxy, array_to_string(n.synonyms, '|') AS synonyms, coalesce(e.revoked, false) AS revoked, coalesce(e.synthetic, false) AS synthetic, n.dangling, n.degree, n.group_count FROM nodes n LEFT JOIN entries e ON e.uuid = n.uuid"),
        "corpus_links": _with("SELECT a, b, first_type, array_to_string(types, ',') AS types, confidence FROM links"),
        "corpus_adjacency": _with("SELECT src, dst, dir, adj_pos, confidence FROM adj"),
        "corpus_galaxies": _with("SELECT galaxy AS type, upper(galaxy[1]) || galaxy[2:] AS name, '' AS namespace, '' AS description, CAST(count(*) AS INT) AS nodes FROM entries GROUP BY galaxy"),
        "corpus_resolve": _with(
            "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY score DESC, degree DESC, value, uuid) AS INT) AS rank, uuid, value, reason, matched, score, revoked, synthetic FROM best WHERE best = 1) WHERE rank <= 60",
            _names_cte("standard"),
            ask,
            f"""hits AS (SELECT n.uuid, n.value, {_reason('a.q_key')} AS reason, i.matched, CAST({_score('a.q_key')} - CASE WHEN e.revoked THEN 200 ELSE 0 END AS INT) AS score, n.degree, e.revoked, e.synthetic, i.name_pos, i.key
  FROM idx i JOIN asked a ON contains(i.key, a.q_key) JOIN nodes n ON n.uuid = i.uuid JOIN entries e ON e.uuid = i.uuid)""",
            "best AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY score DESC, name_pos, key) AS best FROM hits)",
        ),
        "corpus_walk_paths": _with("SELECT uuid, depth, via, CASE depth WHEN 1 THEN 'nation:1>' || uuid ELSE 'nation:1>' || from_uuid || '>' || uuid END AS path FROM walked WHERE rank <= 500", *_walk_ctes("nation:1", 2), _ranked(2)),
        "corpus_path_hops": _with(
            f"SELECT CAST(h.hop AS INT) AS hop, h.b AS uuid, n.value, n.galaxy, coalesce(l.first_type, '') AS via, coalesce(l.confidence, 0) AS confidence, h.hop > 0 AND {_BRIDGE.format('h.a', 'h.b')} AS bridge FROM hops h JOIN nodes n ON n.uuid = h.b LEFT JOIN links l ON l.a = least(h.a, h.b) AND l.b = greatest(h.a, h.b) AND h.hop > 0",
            route,
            _REACH,
        ),
        "corpus_weakest_link": _with(
            f"""SELECT h.a AS source, h.b AS target, true AS found, CAST(1 AS INT) AS hops, CASE WHEN l.confidence <= 1 AND {_BRIDGE.format('h.a', 'h.b')} THEN x.value || ' -> ' || y.value || ' (' || l.first_type || ')' END AS weakest_link
FROM hops h JOIN links l ON l.a = least(h.a, h.b) AND l.b = greatest(h.a, h.b) JOIN nodes x ON x.uuid = h.a JOIN nodes y ON y.uuid = h.b UNION ALL SELECT 'part:0', 'part:0', true, CAST(0 AS INT), NULL""",
            "hops AS (SELECT 'nation:0' AS a, 'region:' || n_regionkey AS b FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'part:0', 'supplier:0')",
            _REACH,
        ),
        "corpus_refs": _with(f"SELECT uuid, CAST(pos AS INT) AS pos, url, {domain} AS domain, {domain} = 'attack.mitre.org' AS self_referential FROM {refs_sql}"),
        "corpus_publishers": _with(f"SELECT {domain} AS domain, CAST(count(*) AS INT) AS count FROM {refs_sql} WHERE {domain} <> 'attack.mitre.org' GROUP BY 1"),
        "corpus_fuzzy_conflicts": _with("SELECT uuid, s_name AS matched, k % 3 <> 2 AS blocked, CASE WHEN k % 3 <> 2 THEN 'conflicting country: C2 vs C' || (k % 3) END AS blocked_reason FROM named WHERE k <> 2"),
        "corpus_drafts": _with(
            f"SELECT t.name, t.galaxy, count(i.uuid) > 0 AS refused, coalesce(string_agg(i.uuid, ',' ORDER BY i.uuid), '') AS exact, CAST(0 AS INT) AS near, CASE WHEN count(i.uuid) > 0 THEN '' ELSE '{_ENTRY}' END AS entry FROM taken t LEFT JOIN idx i ON i.key = t.q_key GROUP BY t.name, t.galaxy",
            _names_cte("standard"),
            f"taken AS ({taken})",
        ),
    }
