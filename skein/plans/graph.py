"""The tables of a graph, derived from entries and declared relations.

entries: uuid, value, galaxy, description, synonyms, meta, revoked, synthetic, ord (load order)
declarations: src, dst, type, seq (order of declaration, any orderable type)
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GENERIC_FLOOR, GENERIC_PERCENTILE, MIN_GENERIC_SAMPLE, Config
from ..functions.folding import MODES, fold_by


#: Nodes that a join may send to every task.
FEW = 100_000
#: Actors that a join may send to every task.
FEW_ACTORS = 1_000_000


class Graph:
    """Tables of one immutable graph, each a lazy plan over entries and declarations.

    What is asked of some nodes is derived from the declarations at these
    nodes alone (ends_of, adj_of); only counts by node are kept.
    """

    #: The table that both entries and declarations are read from, if reading it is dear.
    source: DataFrame | None = None

    def __init__(self, entries: DataFrame, declarations: DataFrame, galaxy_info: DataFrame | None = None, config: Config = Config(), source_ref: str = "", sound: bool = False):
        """sound: no declaration lacks an end or is towards its own source, so none need be looked at for that."""
        self.entries, self.config, self.source_ref = entries, config, source_ref
        self.declarations = declarations if sound else declarations.filter((F.coalesce("dst", F.lit("")) != "") & (F.col("dst") != F.col("src")))
        self._info = galaxy_info

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def is_actor(self, galaxy):
        return F.coalesce(F.lower(galaxy).isin(*self.config.actor_galaxies), F.lit(False)) if self.config.actor_galaxies else F.lit(False)

    @cached_property
    def _pairs(self) -> DataFrame:
        """a < b, first_type, types, confidence, ab, ba: what is declared of a pair, and the first declaration in each direction. All else that relations tell is derived from it."""
        ahead = F.col("src") < F.col("dst")
        d = self.declarations.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), ahead.alias("ahead"), F.coalesce("type", F.lit("")).alias("type"), "seq")
        types = F.array_sort(F.collect_set(F.when(F.col("type") != "", F.col("type"))))
        return d.groupBy("a", "b").agg(
            F.min(F.struct("seq", "type"))["type"].alias("first_type"), types.alias("types"), F.count("*").cast("int").alias("confidence"),
            F.min(F.when(F.col("ahead"), F.col("seq"))).alias("ab"), F.min(F.when(~F.col("ahead"), F.col("seq"))).alias("ba"),
        )

    @cached_property
    def links(self) -> DataFrame:
        """a < b, first_type, types, confidence: relations of a pair, in either direction, as one link."""
        return self._pairs.select("a", "b", "first_type", "types", "confidence")

    @cached_property
    def plain_nodes(self) -> DataFrame:
        """All entries, and the dangling nodes that only relations name, with is_actor; no counts."""
        known = self.entries.withColumn("dangling", F.lit(False))
        named = self.declarations.select(F.col("dst").alias("uuid")).distinct()
        ghosts = named.join(self.entries.select("uuid"), "uuid", "left_anti").withColumn("dangling", F.lit(True))
        nodes = known.unionByName(ghosts, allowMissingColumns=True)
        nodes = nodes.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("revoked", "synthetic")} | {c: F.coalesce(c, F.lit("")) for c in ("value", "galaxy")} | {"synonyms": F.coalesce("synonyms", F.array().cast("array<string>"))})
        return nodes.withColumn("is_actor", self.is_actor(F.col("galaxy")))

    def described(self, rows: DataFrame, few: bool) -> DataFrame:
        """rows of nodes that relations name (uuid), with value, galaxy, dangling and is_actor; few: their uuids are sent to every task."""
        uuids = rows.select("uuid").distinct()
        known = self.entries.select("uuid", "value", "galaxy").join(F.broadcast(uuids) if few else uuids, "uuid", "left_semi")
        found = rows.join(known.withColumn("dangling", F.lit(False)), "uuid", "left")
        found = found.withColumns({"dangling": F.coalesce("dangling", F.lit(True))} | {c: F.coalesce(c, F.lit("")) for c in ("value", "galaxy")})
        return found.withColumn("is_actor", self.is_actor(F.col("galaxy")))

    @cached_property
    def _actors(self) -> DataFrame:
        """other: the actors, sent to every task if they are not too many."""
        actors = self.entries.filter(self.is_actor(F.col("galaxy"))).select(F.col("uuid").alias("other"))
        few = self.config.actor_galaxies and actors.limit(FEW_ACTORS + 1).count() <= FEW_ACTORS
        return F.broadcast(actors) if few else actors

    @cached_property
    def group_counts(self) -> DataFrame:
        """node, group_count of the nodes that actors are linked to."""
        d = self.declarations
        ends = [d.select(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("src", "dst"), ("dst", "src"))]
        held = ends[0].join(self._actors, "other").unionAll(ends[1].join(self._actors, "other"))
        return held.select("node", "other").distinct().groupBy("node").agg(F.count("*").cast("int").alias("group_count"))

    @cached_property
    def degrees(self) -> DataFrame:
        """node, degree of the nodes with a relation: two-way links count twice."""
        ways = self.declarations.select("src", "dst").distinct()
        return ways.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").cast("int").alias("degree"))

    def counted(self, rows: DataFrame, *counts: str, on: str = "uuid") -> DataFrame:
        """rows with the counts named (group_count, degree) of the node in a column, 0 where there is none."""
        for name, table in (("degree", "degrees"), ("group_count", "group_counts")):
            if name in counts:
                rows = rows.join(getattr(self, table).withColumnRenamed("node", "__node"), F.col(on) == F.col("__node"), "left").drop("__node").withColumn(name, F.coalesce(name, F.lit(0)))
        return rows

    @cached_property
    def nodes(self) -> DataFrame:
        """All entries, and the dangling nodes that only relations name; with degree, group_count and is_actor."""
        return self.counted(self.plain_nodes, "degree", "group_count")

    def ends_of(self, nodes: DataFrame, few: bool) -> DataFrame:
        """node, other, dir, type, seq: what is declared by and towards the nodes (node); few: these are sent to every task."""
        nodes = nodes.select("node").distinct()
        nodes = F.broadcast(nodes) if few else nodes
        side = lambda x, y, way: self.declarations.select(F.col(x).alias("node"), F.col(y).alias("other"), F.lit(way).alias("dir"), F.coalesce("type", F.lit("")).alias("type"), "seq").join(nodes, "node", "left_semi")
        return side("src", "dst", "out").unionAll(side("dst", "src", "in"))

    def adj_of(self, nodes: DataFrame, few: bool = True) -> DataFrame:
        """The rows of adj whose src is one of the nodes (node), but for dst_group_count."""
        types = F.array_sort(F.collect_set(F.when(F.col("type") != "", F.col("type"))))
        pairs = self.ends_of(nodes, few).groupBy("node", "other").agg(
            F.min(F.struct("seq", "type"))["type"].alias("first_type"), types.alias("types"), F.count("*").cast("int").alias("confidence"),
            *[F.min(F.when(F.col("dir") == way, F.col("seq"))).alias(way) for way in ("out", "in")],
        )
        views = F.filter(F.array(*[F.struct(F.lit(way).alias("dir"), F.col(way).alias("seq")) for way in ("out", "in")]), lambda v: v["seq"].isNotNull())
        a = pairs.select(F.col("node").alias("src"), F.col("other").alias("dst"), "first_type", "types", "confidence", F.explode(views).alias("v"))
        order = Window.partitionBy("src").orderBy(F.col("v.dir").desc(), "v.seq", "dst")
        return a.withColumn("adj_pos", F.row_number().over(order).cast("long")).select("src", "dst", "v.dir", "adj_pos", "first_type", "types", "confidence")

    @cached_property
    def adj(self) -> DataFrame:
        """src, dst, dir, adj_pos, first_type, types, confidence, dst_group_count: what a walk reads at each step.

        adj_pos orders the edges of src: declared ones first, then those
        declared towards it, each in order of declaration.
        """
        view = lambda src, dst, way, seq: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(way).alias("dir"), F.col(seq).alias("seq"))
        views = F.filter(F.array(view("a", "b", "out", "ab"), view("b", "a", "in", "ab"), view("b", "a", "out", "ba"), view("a", "b", "in", "ba")), lambda v: v["seq"].isNotNull())
        a = self._pairs.select("first_type", "types", "confidence", F.explode(views).alias("v")).select("v.*", "first_type", "types", "confidence")
        order = Window.partitionBy("src").orderBy(F.col("dir").desc(), "seq", "dst")
        a = a.withColumn("adj_pos", F.row_number().over(order).cast("long"))
        a = self.counted(a, "group_count", on="dst")
        return a.select("src", "dst", "dir", "adj_pos", "first_type", "types", "confidence", F.col("group_count").alias("dst_group_count"))

    @cached_property
    def thresholds(self) -> DataFrame:
        """galaxy_lc, threshold: from how many actors on an entry is too common to tell, by galaxy.

        Of the group counts above zero, sorted, that at nine tenths of the
        way; at least 2; none for galaxies with under ten such entries. It
        is found in the counts of counts, not in the gathered list.
        """
        some = self.entries.select(F.col("uuid").alias("node"), F.coalesce("galaxy", F.lit("")).alias("galaxy")).join(self.group_counts, "node").groupBy(F.lower("galaxy").alias("galaxy_lc"), "group_count").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("galaxy_lc").orderBy("group_count"))
        total = F.sum("n").over(Window.partitionBy("galaxy_lc"))
        at = F.least(F.floor(total * F.lit(GENERIC_PERCENTILE)), total - 1)
        placed = some.select("galaxy_lc", "group_count", upto.alias("upto"), total.alias("total"), at.alias("at"))
        found = placed.filter((F.col("total") >= MIN_GENERIC_SAMPLE) & (F.col("upto") > F.col("at"))).groupBy("galaxy_lc").agg(F.min("group_count").alias("threshold"))
        return found.select("galaxy_lc", F.greatest("threshold", F.lit(GENERIC_FLOOR)).alias("threshold"))

    def index(self, mode: str, lengths: DataFrame | None = None) -> DataFrame:
        """key, uuid, matched, name_pos: the keys of every value (name_pos 0) and synonym under one folding, each node once a key, with its first name; of lengths (length), only keys of these."""
        names = self.entries.select("uuid", F.posexplode(F.concat(F.array(F.coalesce("value", F.lit(""))), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name_pos", "matched"))
        keyed = names.withColumn("key", fold_by(mode, F.col("matched"))).filter("key <> ''")
        if lengths is not None:
            keyed = keyed.withColumn("length", F.char_length("key")).join(F.broadcast(lengths.select("length").distinct()), "length", "left_semi").drop("length")
        first = F.min(F.struct("name_pos", "matched")).alias("first")
        return keyed.groupBy("key", "uuid").agg(first).select("key", "uuid", "first.matched", "first.name_pos")

    @cached_property
    def name_index(self) -> DataFrame:
        """mode, key, uuid, matched, name_pos: the index of every folding."""
        each = [self.index(m).select(F.lit(m).alias("mode"), "key", "uuid", "matched", "name_pos") for m in MODES]
        return reduce(DataFrame.unionAll, each)

    @cached_property
    def galaxies(self) -> DataFrame:
        """type, name, namespace, description, nodes of every galaxy, empty ones included."""
        counts = self.plain_nodes.filter("NOT dangling").groupBy(F.col("galaxy").alias("type")).agg(F.count("*").cast("int").alias("nodes"))
        if self._info is None:
            return counts.select("type", F.lit("").alias("name"), F.lit("").alias("namespace"), F.lit("").alias("description"), "nodes")
        return self._info.join(counts, "type", "left").select("type", "name", "namespace", "description", F.coalesce("nodes", F.lit(0)).alias("nodes"))

    @cached_property
    def bridges(self) -> DataFrame:
        """a, b of every link whose loss would part its ends."""
        from ..operators.bridges import find_bridges

        return find_bridges(self.declarations.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))

    def keep(self) -> Graph:
        """Keep what is dear to read and counts by node, once they are asked for, in memory, spilling to disk."""
        if self.source is not None:
            self.source.persist()
        for name in ("group_counts", "degrees", "thresholds"):
            setattr(self, name, getattr(self, name).persist())
        return self

    def node_columns(self, *more: str) -> DataFrame:
        """uuid, value, galaxy and others of all nodes; counts are joined only if they are among these."""
        return self.counted(self.plain_nodes, *more).select("uuid", "value", "galaxy", *more)


TABLES = ("entries", "links", "nodes", "adj", "thresholds", "name_index", "galaxies", "bridges", "declarations")


class StoredGraph(Graph):
    """A graph whose tables were written by sources.snapshots."""

    def __init__(self, tables: dict[str, DataFrame], config: Config, source_ref: str = ""):
        self.config, self.source_ref, self._info = config, source_ref, None
        for name, df in tables.items():
            setattr(self, name, df)
        self.plain_nodes = self.nodes.drop("degree", "group_count")
        self.degrees, self.group_counts = (self.nodes.select(F.col("uuid").alias("node"), c) for c in ("degree", "group_count"))

    def adj_of(self, nodes: DataFrame, few: bool = True) -> DataFrame:
        nodes = nodes.select(F.col("node").alias("src")).distinct()
        return self.adj.join(F.broadcast(nodes) if few else nodes, "src", "left_semi").drop("dst_group_count")

    def index(self, mode: str, lengths: DataFrame | None = None) -> DataFrame:
        return self.name_index.filter(F.col("mode") == mode).drop("mode")
