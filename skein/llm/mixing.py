"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Golden-ratio points go through the cumulative shares of the sources, which
gives every stretch of the schedule close to the wished mix. The slots of a
source are ranked, and rank r takes the source's block r: its documents are
shuffled, laid end to end, cut into blocks of equal length and, where the
target is larger than the source, passed over again.

Nothing is ordered in one task but the table of sources (a row each): slots
are ranked within chunks whose counts are summed up first, and documents are
laid out within hash ranges in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, finished, identified, load, small

GOLDEN = 0.6180339887498949
#: Words that a hash range of a source is to hold, about: what is ordered in one task.
RANGE_WORDS = 50_000_000


def word_count(text: Column) -> Column:
    """The number of words in a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds src (rank by code point, null last), weight and target.

    Targets share the sum of all sizes by weight. Each stops at ``most``
    times its source's size, and the excess is shared again by weight until
    none is above: with the sources in order of most * size / weight, those
    before a point are full and the others get one level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("src", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    found = ranked.withColumn("level", level)
    # The first source that its level doesn't fill sets the level of the rest.
    found = found.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return found.select("source", "src", "source_size", "weight", target.alias("target"))


def lay_out(docs: DataFrame, ranges: int, seed: int = 42) -> DataFrame:
    """docs: src, doc_id, size > 0. Adds start: the words of src before this document, in an order that a hash of the seed and doc_id gives, cut into so many ranges."""
    docs = docs.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    docs = docs.withColumn("range", F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * ranges / (1 << 24)))
    sums = docs.groupBy("src", "range").agg(F.sum("size").alias("sum"))
    ahead = sums.select("src", "range", (F.sum("sum").over(Window.partitionBy("src").orderBy("range")) - F.col("sum")).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return docs.withColumn("inside", inside).join(ahead, ["src", "range"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("key", "range", "ahead", "inside")


def schedule(quota: DataFrame, slots: int, chunk: int = 65_536) -> DataFrame:
    """quota: src, n_slots (> 0). A row for each slot: slot, src, rank; ranks of a source run from 0 to n_slots - 1.

    Slot i takes the source whose stretch of the cumulative shares holds the
    point frac((i + 1) * golden ratio). Stretches meet points by the cell of
    a grid that is as fine as there are sources. What a source gets beyond
    its quota is let go, and what it lacks closes the schedule.
    """
    spark = quota.sparkSession
    total = F.sum("n_slots").over(Window.partitionBy())
    upto = F.sum("n_slots").over(Window.orderBy("src"))
    shares = checkpointed(quota.select("src", "n_slots", ((upto - F.col("n_slots")) / total).alias("lo"), (upto / total).alias("hi")))
    cells = 2 * shares.count() + 1
    grid = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    x = (F.col("slot") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", x - F.floor(x))
    drawn = points.withColumn("cell", F.floor(F.col("x") * cells)).join(grid, "cell").filter("x >= lo AND x < hi").select("slot", "src", "n_slots", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    ahead = counts.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(ahead, ["src", "chunk"]).select("slot", "src", "n_slots", (F.col("ahead") + F.col("inside")).alias("rank"))
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    lacking = quota.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < n_slots")
    closing = lacking.select("src", F.explode(F.sequence(F.col("got"), F.col("n_slots") - 1)).alias("rank")).select((F.lit(slots) + F.col("rank")).alias("slot"), "src", "rank")
    return ranked.filter("rank < n_slots").select("slot", "src", "rank").unionByName(closing)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, slots: int = 1 << 18, seed: int = 42, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs: doc_id (and other keys), source, size (words). Returns these, source_size, target, taken, n_slots and first_slot.

    The schedule has about ``slots`` slots, so a block is the sum of sizes
    over slots, at least one word, and grows with the corpus. The last slot
    of a source is cut to end at its target, rounded to a word. n_slots
    counts the slots that take words of the document, first_slot is the
    first of them in the order of the mixed corpus (null if none does). A
    document without words is taken 0 times; rows alike in their keys are
    laid out one by one; a null doc_id or source is a value like others. An
    empty table gives no rows. Reruns agree: the order depends on the seed
    and doc_id alone. Extra columns are ignored.
    """
    docs = checkpointed(docs.select(*keys, "source", F.col("size").cast("long").alias("size")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, most))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // slots))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    goal = F.round("target").cast("long")
    passes, rest = F.floor(goal / F.col("source_size")), F.floor(goal % F.greatest("source_size", F.lit(1)))
    quota = targets.filter("source_size > 0").select("src", blocks.alias("blocks"), (passes * blocks + F.ceil(rest / block).cast("long")).alias("n_slots"), passes.alias("passes"), rest.alias("rest")).filter("n_slots > 0")
    quota = checkpointed(quota)
    drawn = quota.agg(F.sum("n_slots")).first()[0] or 0
    named = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).select(*keys, docs["source"], "src", "size", "source_size", "target")
    laid = lay_out(named.filter("size > 0"), max(1024, int(total / RANGE_WORDS)), seed)
    cell = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    pieces = laid.withColumn("block", cell)
    lo, hi = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    # Slots meet blocks by source and block; a block taken in several passes is one row with its count.
    plan = schedule(quota.select("src", "n_slots"), drawn).join(quota.select("src", "blocks", "passes", "rest"), "src") if drawn else None
    none = [F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_slots"), F.lit(None).cast("long").alias("first_slot")]
    out = [*keys, "source", "size", "source_size", "target"]
    if plan is not None:
        block_of = (F.col("rank") % F.col("blocks")).alias("block")
        last = (F.col("rank") >= F.col("passes") * F.col("blocks")) & ((block_of + 1) * block > F.col("rest"))
        taken = plan.groupBy("src", block_of).agg(F.count(F.when(~last, 1)).alias("whole"), F.max(F.when(last, F.col("rest"))).alias("cut"), F.min(F.when(~last, F.col("slot"))).alias("slot"), F.min(F.when(last, F.col("slot"))).alias("last_slot"))
        rest = F.when(F.col("cut").isNotNull(), F.greatest(F.lit(0), F.least(hi, F.col("cut")) - lo)).otherwise(0)
        part = (hi - lo) * F.col("whole") + rest
        sums = [F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"), F.coalesce(F.sum(F.col("whole") + (rest > 0).cast("long")), F.lit(0)).cast("long").alias("n_slots"), F.min(F.least("slot", F.when(rest > 0, F.col("last_slot")))).alias("first_slot")]
        summed = pieces.join(taken, ["src", "block"], "left").groupBy(*keys, "source", "src", "size", "source_size", "target", "start").agg(*sums).select(*out, "taken", "n_slots", "first_slot")
    else:
        summed = laid.select(*out, *none)
    return summed.unionByName(named.filter("size = 0").select(*out, *none))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """mix() of documents (doc_id, text, source); null texts have size 0. Extra columns are ignored."""
    return mix(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), **options)


def mix_corpus(documents: DataFrame, **options) -> DataFrame:
    """documents with size, source_size, target, taken, n_slots and first_slot: the corpus that the mix takes, in the order of first_slot, each document so often as its taken words come to.

    Rows and other columns stay as they are, but for any of these names.
    Rows of one doc_id are documents of their own.
    """
    made = ("size", "source_size", "target", "taken", "n_slots", "first_slot")
    others = [c for c in documents.columns if c not in made]
    rows = identified(documents.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__others"), "doc_id", "text", "source"))
    mixed = finished(documents.sparkSession, "mixed", lambda: mix(rows.select("doc_id", "__row", "source", word_count(F.col("text")).alias("size")), keys=("doc_id", "__row"), **options))
    mixed = mixed.select(F.col("doc_id").alias("__doc"), F.col("__row").alias("__again"), *made)
    joined = rows.join(small(mixed, F.lit(96)), F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__again")))
    return joined.select(*[F.col(f"__others.`{c}`").alias(c) for c in others], *made)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_slots, first_slot and source of every document."""
    return mix_documents(load(spark, sf_dir, "documents"))


def mix_sql(table: str = "documents", slots: int = 1 << 18) -> str:
    """The result as DuckDB SQL, slot by slot: golden-ratio points through cumulative shares, ranks of slots, blocks of ranks, and the documents that these overlap."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
z AS (SELECT CAST(greatest(1, (sum(source_size) + {slots - 1}) // {slots}) AS BIGINT) AS block FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (cap / weight, src)) AS level FROM l WHERE level * weight < cap),
t AS (SELECT source, source_size, src, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, f.level * weight) END AS target FROM w, f),
q AS (SELECT src, block, (source_size + block - 1) // block AS blocks, CAST(round(target) AS BIGINT) // source_size AS passes, CAST(round(target) AS BIGINT) % source_size AS rest
      FROM t, z WHERE source_size > 0),
n AS (SELECT *, CAST(passes * blocks + (rest + block - 1) // block AS BIGINT) AS quota FROM q),
c AS (SELECT *, CAST(sum(quota) OVER () AS BIGINT) AS total, (sum(quota) OVER (ORDER BY src) - quota) / sum(quota) OVER () AS lo, sum(quota) OVER (ORDER BY src) / sum(quota) OVER () AS hi FROM n WHERE quota > 0),
p AS (SELECT slot, (slot + 1) * {GOLDEN!r}::DOUBLE - floor((slot + 1) * {GOLDEN!r}::DOUBLE) AS x FROM (SELECT unnest(range((SELECT max(total) FROM c))) AS slot)),
k AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank FROM p JOIN c ON x >= lo AND x < hi),
g AS (SELECT c.src, count(k.slot) AS got FROM c LEFT JOIN k ON k.src = c.src GROUP BY c.src),
e AS (SELECT k.src, k.slot, k.rank FROM k JOIN c ON c.src = k.src WHERE k.rank < c.quota
      UNION ALL SELECT src, total + rank, rank FROM (SELECT c.src, c.total, unnest(range(g.got, c.quota)) AS rank FROM c JOIN g ON c.src = g.src WHERE g.got < c.quota)),
b AS (SELECT e.src, slot, rank % blocks AS b, CASE WHEN rank >= passes * blocks THEN least((rank % blocks + 1) * block, rest) ELSE (rank % blocks + 1) * block END AS upto, block FROM e JOIN c ON c.src = e.src),
o AS (SELECT d.rid, t.src, d.size, CAST(sum(d.size) OVER (PARTITION BY t.src ORDER BY md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size > 0),
u AS (SELECT rid, src, start, size, unnest(range(start // block, (start + size - 1) // block + 1)) AS b FROM o, z),
m AS (SELECT u.rid, slot, least(u.start + u.size, upto) - greatest(u.start, u.b * block) AS words FROM u JOIN b ON b.src = u.src AND b.b = u.b),
a AS (SELECT rid, CAST(sum(words) AS BIGINT) AS taken, count(*) AS n_slots, min(slot) AS first_slot FROM m WHERE words > 0 GROUP BY rid)
SELECT d.doc_id, d.source, d.size, t.source_size, t.target, coalesce(a.taken, 0) AS taken, coalesce(a.n_slots, 0) AS n_slots, a.first_slot
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN a ON a.rid = d.rid
"""
