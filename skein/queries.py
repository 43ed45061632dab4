"""Queries over the graph of the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.folding import tag
from .operators import analytics, draft, fuzzy, paths, refs, resolve, traverse
from .plans.graph import Graph
from .sources import tables

_graphs: dict[tuple[str, str], Graph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables, kept for further queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        for k in [k for k in _graphs if k[0] != key[0]]:
            del _graphs[k]
        _graphs[key] = tables.load(spark, sf_dir).keep()
    return _graphs[key]


WALK_COLUMNS = ("rank", "uuid", "value", "galaxy", "depth", "via", "confidence", "group_count", "generic", "generic_threshold", "from_uuid", "dangling")


def _near(uuid: str, **how) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: traverse.neighbours(graph_of(s, d), uuid, traverse.Walk(**how)).select(*WALK_COLUMNS)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("query"))


RESOLVED = ("rank", "uuid", "value", "galaxy", "reason", "matched", "score", "degree", "group_count")


def _resolved(query: str, **how) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: resolve.resolve(graph_of(s, d), query, **how).select(*RESOLVED)


def _index(mode: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: graph_of(s, d).index(mode).select("key", "uuid", "matched", "name_pos")


def _page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.array("url", F.concat(F.lit(" "), "url"), F.lit("https://attack.mitre.org/x")).alias("urls"))
    return refs.references_of(pages, "page_id", "urls")


def _publishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs.by_publisher(_page_refs(spark, sf_dir))


NEAR_NAMES = ("smal ring", "Suplier#000000001", "NATION 1", "larg gears", "ASIAN")


def _near_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NEAR_NAMES)), "query_id long, query string")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, Jaro-Winkler left out, of near names and all keys of near lengths."""
    rows = fuzzy.with_signals(fuzzy.near_pairs(graph_of(spark, sf_dir), _near_names(spark)))
    return rows.select("query_id", "uuid", "matched", *[F.round(c, 6).alias(c) for c in ("levenshtein", "token_overlap", "abbreviation", "digit_match")])


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuzzy.fuzzy_batch(graph_of(spark, sf_dir), _near_names(spark), min_similarity=0.81, limit=1 << 30)
    return rows.select("query_id", "uuid", "value", "galaxy", "matched", F.round("similarity", 6).alias("similarity"), "blocked")


def _collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Small Ring",), ("brand-17",), ("nation 3",), ("No Such Name",)], "name string")
    return draft.exact_collisions(graph_of(spark, sf_dir), names).select("name", "uuid", "value", "galaxy", "matched_via")


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("part:0",), ("supplier:1",), ("nation:3",), ("customer:4",)], "start string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of graphs: over the star-schema tables, and over a corpus of files."""
    from . import corpus_queries

    return _queries() | corpus_queries.queries()


def oracle_sql() -> dict[str, str]:
    """SQL for all but bridges: for each link, SQL would have to search the whole graph; tests compare it with brute force."""
    from . import corpus_queries

    return _oracle_sql() | corpus_queries.oracle_sql()


def _queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = graph_of
    compare = {"a": "part:0", "b": "part:1", "names": ["part", "supplier"]}
    around = {"a": "supplier:0", "b": "supplier:1", "names": ["part"]}
    return {
        "graph_stats": lambda s, d: analytics.stats(g(s, d), with_bridges=False).drop("source_ref"),
        "galaxies": lambda s, d: analytics.galaxies(g(s, d)).select("type", "nodes"),
        "links": lambda s, d: g(s, d).links.select("a", "b", "first_type", F.array_join("types", ",").alias("types"), "confidence"),
        "adjacency": lambda s, d: g(s, d).adj.select("src", "dst", "dir", "adj_pos", "first_type", "confidence", "dst_group_count"),
        "degree": lambda s, d: g(s, d).node_columns("degree").select("uuid", "degree"),
        "group_count": lambda s, d: g(s, d).node_columns("group_count").select("uuid", "group_count"),
        "generic_thresholds": lambda s, d: g(s, d).thresholds,
        "most_generic": lambda s, d: analytics.most_generic(g(s, d)).drop("tag"),
        "most_generic_scoped": lambda s, d: analytics.most_generic(g(s, d), "Part", 25).drop("tag"),
        "dangling_nodes": lambda s, d: g(s, d).nodes.filter("dangling").select("uuid", "degree", "group_count"),
        "name_index_standard": _index("standard"),
        "name_index_aggressive": _index("aggressive"),
        "resolve_exact": _resolved("small-RING"),
        "resolve_prefix_substring": _resolved("ring", limit=50),
        "resolve_scoped": _resolved("000000001", galaxies=["Supplier ", ""], limit=15),
        "resolve_aggressive": _resolved("The Nation_1 Group", mode="aggressive"),
        "resolve_grouped": lambda s, d: resolve.group_by_galaxy(resolve.resolve(g(s, d), "1", limit=100)).select("galaxy", "count"),
        "resolve_batch": lambda s, d: resolve.resolve_batch(g(s, d), _names(s, d), limit=10).select("query_id", *RESOLVED),
        "node_detail": lambda s, d: analytics.node_detail(g(s, d), "supplier:1").select("uuid", "value", "galaxy", "group_count", "degree", "revoked", "synthetic", "dangling", F.size("relations_by_type").alias("n_types")),
        "node_relations": lambda s, d: analytics.relations_by_type(g(s, d), "supplier:1"),
        "neighbors_d1": _near("part:1"),
        "neighbors_d2": _near("part:1", depth=2),
        "neighbors_d3_capped": _near("nation:1", depth=3, max_visited=300, limit=1000),
        "neighbors_out": _near("supplier:2", direction="out"),
        "neighbors_in": _near("supplier:2", direction="in", limit=1000),
        "neighbors_type_filter": _near("part:1", depth=2, edge_types=("Returned-By", " located-in")),
        "neighbors_galaxy_filter": _near("nation:1", depth=2, galaxies=("PART",), limit=300),
        "neighbors_max_group_count": _near("supplier:1", depth=2, max_group_count=10, limit=500),
        "neighbors_skip_dangling": _near("part:1", depth=1, skip_dangling=True),
        "neighbors_by_relation": lambda s, d: traverse.neighbours_by_relation(g(s, d), "supplier:1"),
        "neighbors_batch": lambda s, d: traverse.neighbours_batch(g(s, d), _starts(s), traverse.Walk(limit=40)).select("start", *WALK_COLUMNS),
        "profile": lambda s, d: analytics.profile(g(s, d), "part:1", depth=2),
        "compare": lambda s, d: analytics.compare(g(s, d), **around).drop("tag"),
        "compare_include_generic": lambda s, d: analytics.compare(g(s, d), **compare, include_generic=True).drop("tag"),
        "compare_summary": lambda s, d: analytics.compare_summary(g(s, d), **around).withColumn("similarity", F.round("similarity", 6)),
        "cooccurrence_galaxy": lambda s, d: analytics.co_occurrence(g(s, d), galaxy="part", min_rate=0.45, limit=60).withColumn("rate", F.round("rate", 6)),
        "cooccurrence_entry": lambda s, d: analytics.co_occurrence(g(s, d), uuid="supplier:1", min_rate=0.3, limit=30).withColumn("rate", F.round("rate", 6)),
        "shortest_path_hops": lambda s, d: paths.shortest_path(g(s, d), "customer:1", "part:7").agg((F.count("*") - 1).cast("int").alias("hops"), F.min(F.struct("hop", "uuid"))["uuid"].alias("source"), F.max(F.struct("hop", "uuid"))["uuid"].alias("target")),
        "bridges": lambda s, d: g(s, d).bridges,
        "refs": lambda s, d: _page_refs(s, d).select("page_id", "url", "domain", "self_referential"),
        "publishers": _publishers,
        "fuzzy_signals": _signals,
        "fuzzy": _fuzzy,
        "draft_exact_collisions": _collisions,
        "tags": lambda s, d: g(s, d).plain_nodes.select("uuid", tag("galaxy", F.col("galaxy"), F.col("value")).alias("tag")),
    }


# ---------------------------------------------------------------- oracles

_BASE = """
entries AS (
  SELECT 'region:' || r_regionkey AS uuid, r_name AS value, 'region' AS galaxy, CAST([] AS VARCHAR[]) AS synonyms, 0 AS kind, CAST(r_regionkey AS BIGINT) AS key FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'nation', [], 1, n_nationkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supplier', [], 2, s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'customer', [c_mktsegment], 3, c_custkey FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'part', [p_brand, p_type], 4, p_partkey FROM part),
decl AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part-of' AS type, 0 AS k, n_nationkey AS x, 0 AS y, 0 AS z, 0 AS w FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located-in', 1, s_suppkey, 0, 0, 0 FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located-in', 2, c_custkey, 0, 0, 0 FROM customer
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, CASE l_returnflag WHEN 'R' THEN 'returned-by' WHEN 'A' THEN 'accepted-by' ELSE 'supplied-by' END, 3, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
  UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 'branded', 4, p_partkey, 0, 0, 0 FROM part),
links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(type, (k, x, y, z, w, type)) AS first_type, list_sort(list(DISTINCT type)) AS types, CAST(count(*) AS INT) AS confidence FROM decl GROUP BY 1, 2),
dirs AS (SELECT src, dst, min((k, x, y, z, w, type)) AS seq FROM decl GROUP BY 1, 2),
sides AS (SELECT src, dst, 'out' AS dir, seq FROM dirs UNION ALL SELECT dst, src, 'in', seq FROM dirs),
counts AS (SELECT s.src, CAST(count(*) AS INT) AS degree, CAST(count(DISTINCT s.dst) FILTER (s.dst LIKE 'supplier:%') AS INT) AS group_count FROM sides s GROUP BY 1),
nodes AS (
  SELECT e.uuid, e.value, e.galaxy, e.synonyms, e.kind, e.key, false AS dangling, e.galaxy = 'supplier' AS is_actor, coalesce(c.degree, 0) AS degree, coalesce(c.group_count, 0) AS group_count FROM entries e LEFT JOIN counts c ON c.src = e.uuid
  UNION ALL SELECT c.src, '', '', [], NULL, NULL, true, false, c.degree, c.group_count FROM counts c WHERE c.src NOT IN (SELECT uuid FROM entries)),
adj AS (
  SELECT s.src, s.dst, s.dir, row_number() OVER (PARTITION BY s.src ORDER BY s.dir DESC, s.seq, s.dst) AS adj_pos, l.first_type, l.types, l.confidence, n.group_count AS dst_group_count
  FROM sides s JOIN links l ON l.a = least(s.src, s.dst) AND l.b = greatest(s.src, s.dst) JOIN nodes n ON n.uuid = s.dst),
thresholds AS (
  SELECT galaxy AS galaxy_lc, greatest(2, gs[CAST(least(floor(n * 0.9::DOUBLE), n - 1) AS BIGINT) + 1]) AS threshold
  FROM (SELECT galaxy, list_sort(list(group_count)) AS gs, count(*) AS n FROM nodes WHERE NOT dangling AND group_count > 0 GROUP BY galaxy) WHERE n >= 10)
"""
_FOLD = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', '', 'g'))"


def _with(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([_BASE, *more]) + "\n" + body


def _aggressive(s: str) -> str:
    strip = lambda x, p: f"(CASE WHEN trim(regexp_replace({x}, '{p}', '')) <> '' THEN regexp_replace({x}, '{p}', '') ELSE {x} END)"
    s = strip(f"trim({s})", r"\s*-\s*(?:DS|DC|[GSTMC])\d{3,4}(\.\d{3,4})?\s*$")
    s = f"trim({strip(s, chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's*$')})"
    s = f"(CASE WHEN lower({s}) LIKE 'the %' AND trim(substr({s}, 5)) <> '' THEN substr({s}, 5) ELSE {s} END)"
    s = strip(s, r"(?i)^(win|elf|apk|osx|py|js|vbs|jar|symbian|ios)[._\-/]+")
    s = strip(s, r"(?i)[._\-/\s]+(group|groups|gang|team|crew|apt|cyberespionage|framework|lair)\s*$")
    return _FOLD.format(s)


def _names_cte(mode: str) -> str:
    fold = _FOLD.format("name") if mode == "standard" else _aggressive("name")
    spread = "SELECT uuid, unnest([value] || synonyms) AS name, unnest(range(len(synonyms) + 1)) AS pos FROM nodes WHERE NOT dangling"
    return f"""names AS ({spread}), keyed AS (SELECT uuid, name, pos, {fold} AS key FROM names),
idx AS (SELECT key, uuid, arg_min(name, pos) AS matched, CAST(min(pos) AS INT) AS name_pos FROM keyed WHERE key <> '' GROUP BY key, uuid)"""


def _score(key: str) -> str:
    gap = f"(octet_length(encode(i.key)) - octet_length(encode({key})))"
    bonus = f"CASE WHEN {gap} < 20 THEN (20 - {gap}) // 4 ELSE 0 END"
    return f"""CASE WHEN i.key = {key} THEN CASE WHEN i.name_pos = 0 THEN 100 ELSE 90 END
      ELSE CASE WHEN starts_with(i.key, {key}) THEN 70 ELSE 40 END - CASE WHEN i.name_pos = 0 THEN 0 ELSE 5 END + {bonus} END"""


def _reason(key: str) -> str:
    return f"""CASE WHEN i.key = {key} THEN CASE WHEN i.name_pos = 0 THEN 'value' ELSE 'synonym' END
      WHEN starts_with(i.key, {key}) THEN CASE WHEN i.name_pos = 0 THEN 'value_prefix' ELSE 'synonym_prefix' END ELSE 'substring' END"""


def _resolve_sql(asked: str, limit: int, scope: str = "true", mode: str = "standard", by: str = "") -> str:
    """asked: a query of query_id and q_key."""
    part = f"PARTITION BY {by}" if by else ""
    extra = f"{by}, " if by else ""
    return _with(
        f"""SELECT {extra}rank, uuid, value, galaxy, reason, matched, score, degree, group_count FROM ranked WHERE rank <= {limit}""",
        _names_cte(mode),
        f"asked AS ({asked})",
        f"""hits AS (SELECT a.query_id, n.uuid, n.value, n.galaxy, {_reason('a.q_key')} AS reason, i.matched, CAST({_score('a.q_key')} AS INT) AS score, n.degree, n.group_count, i.name_pos, i.key
  FROM idx i JOIN asked a ON contains(i.key, a.q_key) JOIN nodes n ON n.uuid = i.uuid WHERE {scope})""",
        "best AS (SELECT *, row_number() OVER (PARTITION BY query_id, uuid ORDER BY score DESC, name_pos, key) AS best FROM hits)",
        f"ranked AS (SELECT *, CAST(row_number() OVER ({part} ORDER BY score DESC, degree DESC, value, uuid) AS INT) AS rank FROM best WHERE best = 1)",
    )


def _walk_ctes(uuid: str, depth: int, direction: str = "both", types: tuple[str, ...] = (), most: int = 0, cap: int = 20_000) -> list[str]:
    """walk: all nodes reached, level by level; each level's parents stop once the visited nodes reach the cap."""
    where = ["true"]
    if direction != "both":
        where.append(f"dir = '{direction}'")
    if most:
        where.append(f"dst_group_count <= {most}")
    via = "first_type"
    if types:
        those = "(" + ", ".join(f"'{t.strip().lower()}'" for t in types) + ")"
        via = f"CASE WHEN lower(first_type) IN {those} THEN first_type ELSE list_filter(types, lambda t: lower(t) IN {those})[1] END"
    ctes = [
        f"ways AS (SELECT * FROM (SELECT src, dst, adj_pos, {via} AS via, confidence FROM adj WHERE {' AND '.join(where)}) WHERE via IS NOT NULL)",
        f"v0 AS (SELECT '{uuid}' AS uuid, 0 AS depth, CAST([] AS BIGINT[]) AS arrival, '' AS via, 0 AS confidence, CAST(NULL AS VARCHAR) AS from_uuid)",
    ]
    for k in range(1, depth + 1):
        last = "v0" if k == 1 else f"n{k - 1}"
        ctes.append(f"""f{k} AS (SELECT w.dst AS uuid, {k} AS depth, min(list_append(l.arrival, w.adj_pos)) AS arrival, arg_min(w.via, list_append(l.arrival, w.adj_pos)) AS via,
  arg_min(w.confidence, list_append(l.arrival, w.adj_pos)) AS confidence, arg_min(w.src, list_append(l.arrival, w.adj_pos)) AS from_uuid
  FROM {last} l JOIN ways w ON w.src = l.uuid WHERE w.dst NOT IN (SELECT uuid FROM v{k - 1}) GROUP BY w.dst)""")
        ctes.append(f"""p{k} AS (SELECT l.uuid, (SELECT count(*) FROM v{k - 1}) + coalesce(sum(coalesce(c.n, 0)) OVER (ORDER BY l.arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM {last} l LEFT JOIN (SELECT from_uuid, count(*) AS n FROM f{k} GROUP BY 1) c ON c.from_uuid = l.uuid)""")
        ctes.append(f"n{k} AS (SELECT f.* FROM f{k} f JOIN p{k} p ON p.uuid = f.from_uuid WHERE p.seen < {cap})")
        ctes.append(f"v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM n{k})")
    return ctes


def _ranked(depth: int, name: str = "walked", where: str = "true") -> str:
    return f"""{name} AS (SELECT w.uuid, n.value, n.galaxy, w.depth, w.via, w.confidence, n.group_count, n.group_count > coalesce(t.threshold, 9) AS generic, CAST(coalesce(t.threshold, 9) AS INT) AS generic_threshold, w.from_uuid, n.dangling, n.is_actor,
  CAST(row_number() OVER (ORDER BY w.depth, CASE WHEN n.is_actor THEN 0 WHEN n.dangling THEN 3 WHEN n.group_count > 0 THEN 1 ELSE 2 END, n.group_count, n.value, w.arrival) AS INT) AS rank
  FROM v{depth} w JOIN nodes n ON n.uuid = w.uuid LEFT JOIN thresholds t ON t.galaxy_lc = n.galaxy WHERE w.depth > 0 AND {where})"""


def _near_sql(uuid: str, depth: int = 1, limit: int = 200, where: str = "true", **how) -> str:
    return _with(f"SELECT {', '.join(WALK_COLUMNS)} FROM walked WHERE rank <= {limit}", *_walk_ctes(uuid, depth, **how), _ranked(depth, where=where))


def _profile_sql(uuid: str, depth: int, limit: int = 500) -> str:
    kind = "CASE WHEN dangling THEN 'dangling' WHEN generic THEN 'generic' WHEN group_count = 1 THEN 'specific' WHEN group_count = 0 AND NOT is_actor THEN 'unattributed' ELSE '' END"
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS INT) AS {k}" for k in analytics.KINDS)
    return _with(f"SELECT CASE WHEN galaxy = '' THEN '(undefined in this checkout)' ELSE galaxy END AS galaxy, CAST(count(*) AS INT) AS count, {counts} FROM (SELECT *, {kind} AS kind FROM walked WHERE rank <= {limit}) GROUP BY 1", *_walk_ctes(uuid, depth), _ranked(depth))


def _compared_ctes(a: str, b: str, names: list[str], include: bool) -> list[str]:
    those = "(" + ", ".join(f"'{n}'" for n in names) + ")"
    out = [f"cut AS (SELECT coalesce(min(threshold) - 1, 9) AS cut FROM thresholds WHERE threshold > 1 AND galaxy_lc IN {those})"]
    block = "true" if include else "n.group_count <= (SELECT cut FROM cut)"
    for k, uuid in (("a", a), ("b", b)):
        rows = f"SELECT DISTINCT n.uuid, n.value, n.galaxy, n.group_count, n.dangling, n.group_count > coalesce(t.threshold, 9) AS generic FROM adj JOIN nodes n ON n.uuid = adj.dst LEFT JOIN thresholds t ON t.galaxy_lc = n.galaxy WHERE adj.src = '{uuid}' AND n.galaxy IN {those}"
        out += [f"free_{k} AS ({rows})", f"set_{k} AS (SELECT * FROM ({rows} AND {block}) WHERE NOT dangling{'' if include else ' AND NOT generic'})"]
    out.append("both_sides AS (SELECT coalesce(set_a.uuid, set_b.uuid) AS uuid, coalesce(set_a.value, set_b.value) AS value, coalesce(set_a.galaxy, set_b.galaxy) AS galaxy, coalesce(set_a.group_count, set_b.group_count) AS group_count, coalesce(set_a.generic, set_b.generic) AS generic, CASE WHEN set_b.uuid IS NULL THEN 'a_only' WHEN set_a.uuid IS NULL THEN 'b_only' ELSE 'shared' END AS side FROM set_a FULL JOIN set_b ON set_a.uuid = set_b.uuid)")
    return out


def _compare_sql(a: str, b: str, names: list[str], include: bool) -> str:
    return _with(
        "SELECT * FROM (SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY group_count = 0, group_count, value, uuid) AS INT) AS rank, uuid, value, galaxy, group_count, generic FROM both_sides) WHERE rank <= 100",
        *_compared_ctes(a, b, names, include),
    )


def _pairs_sql(pool: str, rate: float, limit: int) -> str:
    return _with(
        f"""SELECT a.uuid AS a_uuid, a.value AS a_value, a.group_count AS a_group, b.uuid AS b_uuid, b.value AS b_value, b.group_count AS b_group, round(shared / greatest(a.group_count, b.group_count), 6) AS rate, shared,
  a.group_count - shared AS a_only, b.group_count - shared AS b_only
FROM sums s JOIN chosen a ON a.c_ord = s.ac JOIN chosen b ON b.c_ord = s.bc WHERE shared / greatest(a.group_count, b.group_count) >= {rate}
ORDER BY shared / greatest(a.group_count, b.group_count) DESC, shared DESC, a.value, ac, bc LIMIT {limit}""",
        f"pool AS ({pool})",
        "chosen AS (SELECT *, row_number() OVER (ORDER BY first_at, uuid) AS c_ord FROM pool WHERE NOT dangling AND NOT is_actor AND group_count >= 5 ORDER BY first_at, uuid LIMIT 500)",
        "held AS (SELECT DISTINCT c.c_ord, adj.dst AS actor FROM chosen c JOIN adj ON adj.src = c.uuid WHERE adj.dst LIKE 'supplier:%')",
        "sums AS (SELECT x.c_ord AS ac, y.c_ord AS bc, CAST(count(*) AS INT) AS shared FROM held x JOIN held y ON x.actor = y.actor AND x.c_ord < y.c_ord GROUP BY 1, 2)",
    )


def _tokens(s: str) -> str:
    return rf"list_transform(regexp_extract_all({s}, '\p{{Nd}}+|\p{{L}}+'), lambda t: lower(t))"


_INITIAL = "((len(qt) >= 2 AND len(list_filter(qt, lambda t: length(t) = 1)) > 0) OR (len(mt) >= 2 AND len(list_filter(mt, lambda t: length(t) = 1)) > 0))"
_PLAIN_JW = "CASE WHEN jaro_similarity(q_key, key) < 0.7 THEN jaro_similarity(q_key, key) ELSE jaro_winkler_similarity(q_key, key) END"


def _signal_ctes() -> list[str]:
    asked = " UNION ALL ".join(f"SELECT {i} AS query_id, '{q}' AS query, {_FOLD.format(repr(q))} AS q_key" for i, q in enumerate(NEAR_NAMES))
    digit = r"regexp_replace({0}, '[^\p{{Nd}}]+', '', 'g')"
    dx, dy = digit.format("q_key"), digit.format("key")
    pair = "list_transform(range(1, len(qt) + 1), lambda i: CASE WHEN qt[i] = mt[i] THEN 0 WHEN (length(qt[i]) = 1 AND starts_with(mt[i], qt[i])) OR (length(mt[i]) = 1 AND starts_with(qt[i], mt[i])) THEN 1 ELSE 2 END)"
    return [
        _names_cte("standard"),
        f"asked AS ({asked})",
        f"cand AS (SELECT a.query_id, a.query, a.q_key, i.key, i.uuid, i.matched, i.name_pos, {_tokens('a.query')} AS qt, {_tokens('i.matched')} AS mt FROM idx i JOIN asked a ON abs(length(i.key) - length(a.q_key)) <= 4 AND i.key <> a.q_key)",
        f"""sig AS (SELECT *, 1 - levenshtein(q_key, key) / greatest(length(q_key), length(key))::DOUBLE AS levenshtein,
  CASE WHEN len(qt) > 1 OR len(mt) > 1 THEN len(list_intersect(qt, mt)) / len(list_distinct(qt || mt))::DOUBLE ELSE 0 END AS token_overlap,
  CASE WHEN {_INITIAL} THEN CASE WHEN len(qt) = len(mt) AND NOT list_contains({pair}, 2) AND list_contains({pair}, 1) THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS abbreviation,
  CASE WHEN {dx} = {dy} THEN 1.0 WHEN {dx} = '' OR {dy} = '' THEN 0.5 ELSE 0.0 END AS digit_match FROM cand)""",
    ]


def _oracle_sql() -> dict[str, str]:
    folded = lambda q: _FOLD.format(f"'{q}'")
    ask = lambda q: f"SELECT 0 AS query_id, {folded(q)} AS q_key"
    compare = (["part:0", "part:1", ["part", "supplier"]], ["supplier:0", "supplier:1", ["part"]])
    host = r"regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^[^@]*@', ''), '^www\.', '')"
    hosts = f"SELECT page_id, url, {host} AS domain FROM pages UNION SELECT page_id, 'https://attack.mitre.org/x', 'attack.mitre.org' FROM pages"
    names = " UNION ALL ".join(f"SELECT '{n}' AS name, {folded(n)} AS q_key" for n in ("Small Ring", "brand-17", "nation 3", "No Such Name"))
    starts = " UNION ALL ".join(f"SELECT '{u}' AS start" for u in ("part:0", "supplier:1", "nation:3", "customer:4"))
    return {
        "graph_stats": _with(
            """SELECT CAST(count(*) AS INT) AS nodes, CAST(count(*) FILTER (dangling) AS INT) AS dangling, CAST(0 AS INT) AS revoked, CAST(0 AS INT) AS synthetic, CAST((SELECT count(*) FROM links) AS INT) AS edges,
  CAST((SELECT count(DISTINCT galaxy) FROM entries) AS INT) AS galaxies, CAST((SELECT count(DISTINCT key) FROM idx) AS INT) AS indexed_keys FROM nodes""",
            _names_cte("standard"),
        ),
        "galaxies": _with("SELECT galaxy AS type, CAST(count(*) AS INT) AS nodes FROM entries GROUP BY 1"),
        "links": _with("SELECT a, b, first_type, array_to_string(types, ',') AS types, confidence FROM links"),
        "adjacency": _with("SELECT src, dst, dir, adj_pos, first_type, confidence, dst_group_count FROM adj"),
        "degree": _with("SELECT uuid, degree FROM nodes"),
        "group_count": _with("SELECT uuid, group_count FROM nodes"),
        "generic_thresholds": _with("SELECT galaxy_lc, CAST(threshold AS INT) AS threshold FROM thresholds"),
        "most_generic": _with("SELECT uuid, value, galaxy, group_count FROM nodes WHERE NOT dangling AND group_count > 0 ORDER BY group_count DESC, value, uuid LIMIT 10"),
        "most_generic_scoped": _with("SELECT uuid, value, galaxy, group_count FROM nodes WHERE NOT dangling AND group_count > 0 AND galaxy = 'part' ORDER BY group_count DESC, value, uuid LIMIT 25"),
        "dangling_nodes": _with("SELECT uuid, degree, group_count FROM nodes WHERE dangling"),
        "name_index_standard": _with("SELECT key, uuid, matched, name_pos FROM idx", _names_cte("standard")),
        "name_index_aggressive": _with("SELECT key, uuid, matched, name_pos FROM idx", _names_cte("aggressive")),
        "resolve_exact": _resolve_sql(ask("small-RING"), 20),
        "resolve_prefix_substring": _resolve_sql(ask("ring"), 50),
        "resolve_scoped": _resolve_sql(ask("000000001"), 15, "n.galaxy = 'supplier'"),
        "resolve_aggressive": _resolve_sql("SELECT 0 AS query_id, 'nation1' AS q_key", 20, mode="aggressive"),
        "resolve_grouped": f"SELECT galaxy, CAST(count(*) AS INT) AS count FROM ({_resolve_sql(ask('1'), 100)}) GROUP BY 1",
        "resolve_batch": _resolve_sql(f"SELECT CAST(n_nationkey AS BIGINT) AS query_id, {_FOLD.format('n_name')} AS q_key FROM nation", 10, by="query_id"),
        "node_detail": _with("SELECT uuid, value, galaxy, group_count, degree, false AS revoked, false AS synthetic, dangling, CAST((SELECT count(DISTINCT first_type) FROM adj WHERE src = 'supplier:1') AS INT) AS n_types FROM nodes WHERE uuid = 'supplier:1'"),
        "node_relations": _with("SELECT first_type, CAST(count(*) AS INT) AS n FROM adj WHERE src = 'supplier:1' GROUP BY 1"),
        "neighbors_d1": _near_sql("part:1"),
        "neighbors_d2": _near_sql("part:1", 2),
        "neighbors_d3_capped": _near_sql("nation:1", 3, 1000, cap=300),
        "neighbors_out": _near_sql("supplier:2", direction="out"),
        "neighbors_in": _near_sql("supplier:2", direction="in", limit=1000),
        "neighbors_type_filter": _near_sql("part:1", 2, types=("returned-by", "located-in")),
        "neighbors_galaxy_filter": _near_sql("nation:1", 2, 300, "n.galaxy = 'part'"),
        "neighbors_max_group_count": _near_sql("supplier:1", 2, 500, most=10),
        "neighbors_skip_dangling": _near_sql("part:1", where="NOT n.dangling"),
        "neighbors_by_relation": _with("SELECT via, galaxy, CAST(count(*) AS INT) AS count FROM walked WHERE rank <= 1000 GROUP BY 1, 2", *_walk_ctes("supplier:1", 1), _ranked(1)),
        "neighbors_batch": _with(
            f"SELECT start, {', '.join(WALK_COLUMNS)} FROM walked WHERE rank <= 40",
            f"starts AS ({starts})",
            "near AS (SELECT s.start, a.dst AS uuid, 1 AS depth, min(a.adj_pos) AS at, arg_min(a.first_type, a.adj_pos) AS via, arg_min(a.confidence, a.adj_pos) AS confidence FROM starts s JOIN adj a ON a.src = s.start GROUP BY 1, 2)",
            """walked AS (SELECT w.start, w.uuid, n.value, n.galaxy, w.depth, w.via, w.confidence, n.group_count, n.group_count > coalesce(t.threshold, 9) AS generic, CAST(coalesce(t.threshold, 9) AS INT) AS generic_threshold, w.start AS from_uuid, n.dangling,
  CAST(row_number() OVER (PARTITION BY w.start ORDER BY CASE WHEN n.is_actor THEN 0 WHEN n.dangling THEN 3 WHEN n.group_count > 0 THEN 1 ELSE 2 END, n.group_count, n.value, w.at) AS INT) AS rank
  FROM near w JOIN nodes n ON n.uuid = w.uuid LEFT JOIN thresholds t ON t.galaxy_lc = n.galaxy)""",
        ),
        "profile": _profile_sql("part:1", 2),
        "compare": _compare_sql(*compare[1], False),
        "compare_include_generic": _compare_sql(*compare[0], True),
        "compare_summary": _with(
            """SELECT CAST(count(*) FILTER (side = 'shared') AS INT) AS shared_count, CAST(count(*) FILTER (side = 'a_only') AS INT) AS a_only_count, CAST(count(*) FILTER (side = 'b_only') AS INT) AS b_only_count,
  coalesce(round(count(*) FILTER (side = 'shared') / nullif(count(*), 0)::DOUBLE, 6), 0) AS similarity,
  CAST((SELECT count(*) FROM (SELECT uuid FROM free_a WHERE generic LIMIT 2000)) + (SELECT count(*) FROM (SELECT uuid FROM free_b WHERE generic LIMIT 2000)) AS INT) AS generic_excluded,
  (SELECT count(*) FROM free_a WHERE group_count <= (SELECT cut FROM cut)) >= 2000 OR (SELECT count(*) FROM free_b WHERE group_count <= (SELECT cut FROM cut)) >= 2000 AS truncated,
  coalesce(bool_and(generic) FILTER (side = 'shared'), false) AS all_generic FROM both_sides""",
            *_compared_ctes(*compare[1], False),
        ),
        "cooccurrence_galaxy": _pairs_sql("SELECT *, (kind, key) AS first_at FROM nodes WHERE galaxy = 'part'", 0.45, 60),
        "cooccurrence_entry": _pairs_sql("SELECT n.*, p.first_at FROM nodes n JOIN (SELECT dst, min(adj_pos) AS first_at FROM adj WHERE src = 'supplier:1' GROUP BY 1) p ON p.dst = n.uuid", 0.3, 30),
        "shortest_path_hops": _with(
            "SELECT CAST(min(depth) AS INT) AS hops, 'customer:1' AS source, 'part:7' AS target FROM reach WHERE uuid = 'part:7'",
            "reach AS (SELECT 'customer:1' AS uuid, 0 AS depth UNION SELECT a.dst, r.depth + 1 FROM reach r JOIN adj a ON a.src = r.uuid WHERE r.depth < 4)",
        ),
        "refs": f"SELECT page_id, url, domain, domain = 'attack.mitre.org' AS self_referential FROM ({hosts})",
        "publishers": f"SELECT domain, CAST(count(*) AS INT) AS count FROM ({hosts}) WHERE domain NOT IN ('', 'attack.mitre.org') GROUP BY 1",
        "fuzzy_signals": _with(
            "SELECT query_id, uuid, matched, round(levenshtein, 6) AS levenshtein, round(token_overlap, 6) AS token_overlap, round(abbreviation, 6) AS abbreviation, round(digit_match, 6) AS digit_match FROM sig",
            *_signal_ctes(),
        ),
        # These names need no odd number of transpositions, in which DuckDB's Jaro differs.
        "fuzzy": _with(
            """SELECT query_id, uuid, value, galaxy, matched, round(similarity, 6) AS similarity, false AS blocked
FROM (SELECT m.*, n.value, n.galaxy, row_number() OVER (PARTITION BY m.query_id, m.uuid ORDER BY similarity DESC, name_pos, m.key) AS best FROM scored m JOIN nodes n ON n.uuid = m.uuid WHERE similarity >= 0.81) WHERE best = 1""",
            *_signal_ctes(),
            f"on_names AS (SELECT *, {_PLAIN_JW} AS jw, len(qt) > 1 OR len(mt) > 1 AS many, {_INITIAL} AS initials FROM sig)",
            """weighed AS (SELECT *, (jw * 0.3 + levenshtein * 0.2 + digit_match * 0.25 + CASE WHEN many THEN token_overlap * 0.2 ELSE 0 END + CASE WHEN initials THEN abbreviation * 0.05 ELSE 0 END)
  / (0.3::DOUBLE + 0.2 + 0.25 + CASE WHEN many THEN 0.2 ELSE 0 END + CASE WHEN initials THEN 0.05 ELSE 0 END) AS mean,
  greatest(jw, levenshtein, digit_match, CASE WHEN many THEN token_overlap ELSE 0 END, CASE WHEN initials THEN abbreviation ELSE 0 END) AS most FROM on_names)""",
            "scored AS (SELECT *, least(1.0, CASE WHEN most >= 0.9 AND mean < most * 0.8 THEN most * 0.8 ELSE mean END) AS similarity FROM weighed)",
        ),
        "draft_exact_collisions": _with(f"SELECT a.name, n.uuid, n.value, n.galaxy, i.matched AS matched_via FROM ({names}) a JOIN idx i ON i.key = a.q_key JOIN nodes n ON n.uuid = i.uuid", _names_cte("standard")),
        "tags": _with("""SELECT uuid, CASE WHEN galaxy = '' OR value = '' THEN '' ELSE 'galaxy:' || galaxy || '="' || replace(value, '"', '\\"') || '"' END AS tag FROM nodes"""),
    }
