"""Graphs from a corpus of JSON cluster files.

<root>/clusters holds one object a file, each a galaxy with its values;
<root>/galaxies, if there, names and describes galaxies.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..plans.graph import Graph

CLUSTER = "name string, type string, uuid string, description string, version int, values array<struct<uuid:string, value:string, description:string, revoked:boolean, meta:string, related:array<struct<`dest-uuid`:string, type:string, tags:array<string>>>>>"
DEFINITION = "name string, type string, uuid string, description string, namespace string, icon string"
#: Environment variable that names the version of a corpus that is no checkout.
REF_VARIABLE = "SKEIN_CORPUS_REF"
PATTERN = "*.[jJ][sS][oO][nN]"


def json_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the JSON files below a folder, sorted; none if there is no such folder."""
    return sorted(_json_files(spark, folder))


def _json_files(spark: SparkSession, folder: str) -> Iterator[str]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return
    files = fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.lower().endswith(".json"):
            yield path


def _text(spark: SparkSession, path: str) -> str:
    """The stripped content of a small file; blank if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def checkout_ref(spark: SparkSession, root: str) -> str:
    """The commit that a git checkout stands at, read from its files; blank if root is none."""
    head = _text(spark, f"{root}/.git/HEAD")
    if not head.startswith("ref: "):
        return head
    name = head[5:].strip()
    packed = (line.split(" ", 1) for line in _text(spark, f"{root}/.git/packed-refs").splitlines() if " " in line)
    return _text(spark, f"{root}/.git/{name}") or next((ref for ref, at in packed if at == name), "")


def source_ref(spark: SparkSession, root: str, environ: Mapping[str, str] = os.environ) -> str:
    """What tells where a corpus comes from: the commit of the checkout it is or lies in, else the variable REF_VARIABLE, else the file CORPUS_REF beside it, else nothing."""
    above = root.rstrip("/").rpartition("/")[0]
    return checkout_ref(spark, root) or (checkout_ref(spark, above) if above else "") or environ.get(REF_VARIABLE, "").strip() or _text(spark, f"{root}/CORPUS_REF")


def is_usable(spark: SparkSession, root: str) -> bool:
    """Whether there is a cluster file to load."""
    return next(_json_files(spark, f"{root}/clusters"), None) is not None


def count_clusters(spark: SparkSession, root: str) -> int:
    """Cluster files directly in clusters."""
    return sum("/clusters/" in p and "/" not in p.rpartition("/clusters/")[2] for p in json_files(spark, f"{root}/clusters"))


def _read(spark: SparkSession, folder: str, schema: str, mode: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).json(folder).select("*", F.col("_metadata.file_path").alias("path"))


def string_list(meta: Column, name: str) -> Column:
    """An array of strings in a JSON object; null unless the member is an array of nothing but strings and nulls (which count as empty)."""
    got = F.try_variant_get(F.try_parse_json(meta), f"$['{name}']", "array<variant>")
    kinds = F.transform(got, lambda v: F.schema_of_variant(v))
    return F.when(F.forall(kinds, lambda k: k.isin("STRING", "VOID")), F.transform(got, lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))))


def member_is_wrong(meta: Column, name: str) -> Column:
    """Whether a member is there, not null, and no list of strings: decoding then fails as a whole."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(meta), f"$['{name}']", "variant"))
    return F.coalesce(~kind.isin("VOID") & string_list(meta, name).isNull(), F.lit(False))


def load(spark: SparkSession, root: str, config: Config = Config(), source_ref: str = "") -> Graph:
    """The graph of a corpus. A folder without cluster files, and a malformed one, are errors; malformed definitions are passed over.

    Files count in the order of their paths: of entries with one uuid, the
    first one counts, and its relations alone. Entries without a name are
    passed over with their relations; those without a uuid get a derived
    one.
    """
    if not is_usable(spark, root):
        raise FileNotFoundError(f"clusters/ under {root} holds no JSON")
    files = _read(spark, f"{root}/clusters", CLUSTER, "FAILFAST")
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json\z", "")
    files = files.withColumn("galaxy", F.when(F.coalesce("type", F.lit("")) == "", F.url_decode(base)).otherwise(F.col("type")))
    values = files.select("galaxy", "path", F.posexplode("values").alias("pos", "v")).filter(F.coalesce("v.value", F.lit("")) != "")
    missing = F.coalesce("v.uuid", F.lit("")) == ""
    uuid = F.when(missing, F.concat(F.lit("synthetic::"), "galaxy", F.lit("::"), "v.value")).otherwise(F.col("v.uuid"))
    values = values.select("galaxy", "v", uuid.alias("uuid"), missing.alias("synthetic"), F.struct("path", "pos").alias("ord"))
    first = values.withColumn("rank", F.row_number().over(Window.partitionBy("uuid").orderBy("ord"))).filter("rank = 1").drop("rank")
    entries = first.select("uuid", "v.value", "galaxy", F.coalesce("v.description", F.lit("")).alias("description"), F.coalesce(string_list(F.col("v.meta"), "synonyms"), F.array().cast("array<string>")).alias("synonyms"), "v.meta", F.coalesce("v.revoked", F.lit(False)).alias("revoked"), "synthetic", "ord")
    related = first.select(F.col("uuid").alias("src"), "ord", F.posexplode("v.related").alias("rel_pos", "r"))
    declarations = related.select("src", F.col("r.dest-uuid").alias("dst"), F.coalesce("r.type", F.lit("")).alias("type"), F.struct("ord", "rel_pos").alias("seq"))
    graph = Graph(entries, declarations, galaxy_info(spark, root, files), config, source_ref)
    graph.source = first
    return graph


def galaxy_info(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """type, name, namespace, description: from the first cluster file of each galaxy, and over it the last definition."""
    text = lambda c: F.coalesce(c, F.lit(""))
    own = files.groupBy(F.col("galaxy").alias("type")).agg(F.min(F.struct("path", text("name").alias("name"), text("description").alias("description"))).alias("f"))
    own = own.select("type", "f.name", F.lit("").alias("namespace"), "f.description")
    if not json_files(spark, f"{root}/galaxies"):
        return own
    defs = _read(spark, f"{root}/galaxies", DEFINITION, "DROPMALFORMED").filter(text("type") != "")
    told = F.when(text("description") != "", F.struct("path", "description"))
    last = defs.groupBy("type").agg(F.max(F.struct("path", text("name").alias("name"), text("namespace").alias("namespace"))).alias("d"), F.max(told)["description"].alias("told"))
    joined = own.join(last, "type", "left")
    return joined.select("type", F.coalesce("d.name", "name").alias("name"), F.coalesce("d.namespace", "namespace").alias("namespace"), F.coalesce("told", "description").alias("description"))
