"""WARC archives: write pages as request, response or revisit, and metadata records; read them back; assemble transactions.

Records that belong to one capture are tied by WARC-Concurrent-To. ``assemble``
joins them through these identifiers, in either direction and over one
intermediate record, and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, load, map_rows, shared_path, written

CRLF = "\r\n"
#: The blank lines that end a record.
RECORD_END = "\r\n\r\n"
#: Record types that stand for a capture of their own.
MAIN = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content string, payload binary"


def _hash(kind: str, *key: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in key]))


def _urn(h: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def _record(kind: Column, record_id: Column, date: str, uri: Column, headers: list[Column], content_type: Column, size: Column, *block: Column) -> Column:
    """One record's text without its closing blank lines; headers that are null are left out. size: bytes of the block, whose parts follow."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *headers]
    lines += [F.concat(F.lit("Content-Type: "), content_type), F.concat(F.lit("Content-Length: "), size.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), *block)


def captures(pages: DataFrame, min_revisit_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """page_id, url, html, digest, n (bytes of html) and nth (which tells rows alike apart) of every row; page_id, digest and of (page_id, url and nth of the response) of revisits."""
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("n"))
    key = ("page_id", "url", "digest")
    heads = checkpointed(rows.select(*key, "n"))
    again = checkpointed(heads.groupBy(*key).count().filter("count > 1").select(*[F.col(k).alias(f"_{k}") for k in key]))
    if again.isEmpty():
        rows, heads = (x.withColumn("nth", F.lit(0).cast("long")) for x in (rows, heads))
    else:
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        # Rows alike are numbered once and kept, so that all that follows sees the same numbers.
        several = written(rows.join(again, same, "left_semi").withColumn("nth", F.monotonically_increasing_id() + 1), "alike")
        rows = rows.join(again, same, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(several)
        heads = rows
    large = heads.filter(F.col("n") >= min_revisit_bytes).select("page_id", "url", "nth", "digest")
    firsts = large.groupBy("digest").agg(F.max(F.struct("page_id", "url", "nth")).alias("of"), F.count("*").alias("copies")).filter("copies > 1 AND of.page_id IS NOT NULL").drop("copies")
    revisits = large.select("page_id", "digest").join(firsts, "digest").filter("page_id < of.page_id").distinct()
    return rows, revisits


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 16 << 20, compression: str = "gzip") -> None:
    """Write pages (page_id, url, html) as WARC files below path, through Spark's own writer and committer.

    Of rows with equal payloads of at least min_revisit_bytes bytes, those
    with the largest page_id become responses and the others revisits of
    one of them; all smaller payloads are responses. Every row is a capture
    of its own, rows alike and those of one page_id too. A null html is an
    empty payload. A null url gives no target. A null page_id is never a
    revisit, and its metadata name no page_id. Blanks in a url are
    percent-coded. Other columns are ignored. No rows give an archive
    without records. Files hold about file_bytes bytes of payload at most,
    or one page that is larger.
    """
    rows, revisits = captures(pages, min_revisit_bytes)
    sizes = rows.select(F.when(F.col("n") * 64 <= file_bytes, 0).when(F.col("n") <= file_bytes, 1).otherwise(2).alias("size"), "n").groupBy("size").agg(F.sum(F.col("n") + 1024).alias("bytes"), F.count("*").alias("rows"), F.max("n").alias("most")).collect()
    parts = max(1, -(-sum(r["bytes"] for r in sizes) // file_bytes))
    # One exchange of pages serves both the join and the spread over files.
    both = rows.repartition(parts, "page_id", "digest").join(revisits.repartition(parts, "page_id", "digest"), ["page_id", "digest"], "left")
    page, digest, uri = F.col("page_id"), F.col("digest"), F.col("url")
    # Columns of their own, as what several records name would be made anew for each.
    own = lambda kind: _hash(kind, page, uri, digest, F.col("nth"))
    both = both.withColumns({"_main": own("main"), "_request": own("request"), "_metadata": own("metadata"), "_of": F.when(F.col("of").isNotNull(), _hash("main", F.col("of.page_id"), F.col("of.url"), digest, F.col("of.nth")))})
    both = both.withColumns({k: _urn(F.col(k)) for k in ("_main", "_request", "_metadata", "_of")})
    main_id, again = F.col("_main"), F.col("of").isNotNull()
    both = both.withColumn("_http", F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF)))
    both = both.withColumn("_get", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}")))
    both = both.withColumn("_named", F.coalesce(F.concat(F.lit("page_id: "), F.url_encode(page.cast("string")), F.lit(CRLF)), F.lit("")))
    http, get, named = F.col("_http"), F.col("_get"), F.col("_named")
    main = _record(
        F.when(again, "revisit").otherwise("response"), main_id, date, uri,
        [F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest), F.when(again, F.lit(f"WARC-Profile: {PROFILE}")), F.concat(F.lit("WARC-Refers-To: "), F.col("_of"))],
        F.lit("application/http;msgtype=response"), F.octet_length(http) + F.when(again, 0).otherwise(F.col("n")), http, F.when(again, "").otherwise(F.col("html")),
    )
    ties = [F.concat(F.lit("WARC-Concurrent-To: "), main_id)]
    request = _record(F.lit("request"), F.col("_request"), date, uri, ties, F.lit("application/http;msgtype=request"), F.octet_length(get), get)
    metadata = _record(F.lit("metadata"), F.col("_metadata"), date, uri, ties, F.lit("application/warc-fields"), F.octet_length(named), named)
    for r in sizes or [{"size": 0, "most": 0}]:
        size = F.when(F.col("n") * 64 <= file_bytes, 0).when(F.col("n") <= file_bytes, 1).otherwise(2)
        records = both.filter(size == r["size"]).select(F.explode(F.array(request, main, metadata)).alias("value"))
        most = 3 * max(1, file_bytes // (r["most"] + 1024))
        records.write.mode("append").option("lineSep", RECORD_END).option("maxRecordsPerFile", most).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def parse_records(data, with_payload: bool = True):
    """The records of one archive, as tuples of RECORD's columns; data: a binary stream, already decompressed.

    Blocks are framed by Content-Length, so a payload may hold anything,
    blank lines and record heads included. For responses and resources, the
    digest and length are those of the payload itself; for revisits, they
    are those the record states for the full payload.
    """
    while line := data.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := data.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        block = data.read(size := int(head["content-length"][0]))
        if len(block) != size:
            raise ValueError("a WARC record is cut short")
        one = lambda k, head=head: head.get(k, [None])[0]
        kind, http, body = one("warc-type"), b"", block
        if "application/http" in (one("content-type") or ""):
            http, _, body = block.partition(b"\r\n\r\n")
        digest = n = None
        if kind == "revisit":
            digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
            n = int(m[1]) if (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)) else None
            body = b""
        elif kind in MAIN:
            digest, n = hashlib.sha1(body).hexdigest(), len(body)
        content = block.decode("utf-8", "replace") if kind not in MAIN else None
        yield one("warc-record-id"), kind, head.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), one("warc-refers-to"), digest, n, content, body if with_payload and kind in MAIN else None


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row of RECORD's columns for each record of the WARC files (plain or gzip) below path."""

    def make():
        def fn(rows):
            for r in rows:
                raw = io.BytesIO(r["content"])
                yield from parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if r["content"][:2] == b"\x1f\x8b" else raw, with_payload)

        return fn

    return map_rows(spark.read.format("binaryFile").load(path).select("content"), make, RECORD, chunk=1)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main struct, requests and metadata arrays, sorted by record_id.

    Requests and metadata reach their capture by WARC-Concurrent-To, named
    on either side or through one other record. Records with one identifier
    count once. Those tied to no capture give no row.
    """
    main = records.filter(F.col("type").isin(*MAIN)).dropDuplicates(["record_id"])
    rest = records.filter(F.col("type").isin("request", "metadata"))
    ties = rest.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("target"))
    back = main.select(F.explode("concurrent_to").alias("other"), F.col("record_id").alias("target"))
    ids = main.select(F.col("record_id").alias("capture_id"))
    near = ties.unionByName(back).join(ids, F.col("target") == F.col("capture_id")).select("other", "capture_id")
    # What names another record than a capture goes on through that record.
    loose = ties.join(ids, F.col("target") == F.col("capture_id"), "left_anti")
    far = loose.join(near.withColumnRenamed("other", "via"), F.col("target") == F.col("via")).select("other", "capture_id")
    held = F.struct("record_id", "target_uri", "date", "content")
    tied = near.unionByName(far).join(rest, F.col("other") == F.col("record_id")).groupBy("capture_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("type") == t, held))).alias(a) for t, a in (("request", "requests"), ("metadata", "metadata"))])
    fields = [c for c in ("record_id", "type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload") if c in records.columns]
    return main.select(F.col("record_id").alias("capture_id"), F.struct(*fields).alias("main")).join(tied, "capture_id", "left")


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives, read them back and assemble the captures: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, n_requests."""
    path = shared_path(spark, "warc")
    write_archive(load(spark, sf_dir, "pages"), path)
    got = assemble(checkpointed(read_archive(spark, path, with_payload=False).drop("payload")))
    said = F.col("metadata")[0]["content"]
    page = F.when(said.rlike("page_id: "), F.url_decode(F.regexp_extract(said, r"page_id: (\S*)", 1)))
    kind = load(spark, sf_dir, "pages").schema["page_id"].dataType
    got = got.select("capture_id", page.cast(kind).alias("page_id"), "main.payload_bytes", "main.payload_digest", F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("of"), "main.target_uri", F.size("requests").cast("long").alias("n_requests"))
    got = checkpointed(got)
    answered = got.filter("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to"))
    return got.join(answered, "of", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "n_requests")


OP8_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n >= 1000) END AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id < first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first_id THEN first_id END AS refers_to,
       regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') AS target_uri, CAST(1 AS BIGINT) AS n_requests
FROM f
"""
