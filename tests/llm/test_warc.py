import gzip
import hashlib
import io

from skein.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def write_and_read(spark, rows, path, **k):
    warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(3), path, **k)
    return warc.read_archive(spark, path)


def test_round_trip_of_any_payload(spark, tmp_path):
    big = "<p>é</p>" * 200
    nasty = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n" + "y" * 1200
    rows = [(1, "http://a/x y", big, "d"), (2, "http://b", big, "d"), (3, None, big, None), (4, "http://c", "tiny", "d"), (5, "http://d", "tiny", "d"), (6, "http://e", None, "d"), (7, "http://f", "", "d"), (8, "http://g", nasty, "d"), (None, "http://h", "z" * 2000, "d"), (9, "http://i", big, "d"), (9, "http://i", big, "d")]
    got = warc.assemble(write_and_read(spark, rows, str(tmp_path / "w"))).collect()
    assert len(got) == 11 and len({r["capture_id"] for r in got}) == 11  # rows alike are captures of their own
    by = {}
    for r in got:
        assert len(r["requests"]) == len(r["metadata"]) == 1
        by[r["metadata"][0]["content"].strip().removeprefix("page_id:").strip()] = r["main"]
    assert by["8"]["payload"] == nasty.encode() and by["6"]["payload"] == by["7"]["payload"] == b"" and by[""]["payload_bytes"] == 2000
    assert by["9"]["type"] == "response" and {by[k]["type"] for k in "123"} == {"revisit"} and by["4"]["type"] == by["5"]["type"] == "response"
    nines = {r["main"]["record_id"] for r in got if r["metadata"][0]["content"].strip() == "page_id: 9"}
    assert len(nines) == 2 and len(of := {by[k]["refers_to"] for k in "123"}) == 1 and of <= nines
    assert {by[k]["payload_digest"] for k in "1239"} == {hashlib.sha1(big.encode()).hexdigest()} and {by[k]["payload_bytes"] for k in "1239"} == {len(big.encode())}
    assert by["1"]["target_uri"] == "http://a/x%20y" and by["3"]["target_uri"] is None


def test_ties_by_either_side_and_through_another_record(spark):
    def r(rid, kind, *to):
        return (rid, kind, list(to), "u", "d", None, "x", 1, "c", None)

    rows = [r("m1", "response", "q1"), r("q1", "request"), r("i1", "metadata", "q1"), r("m2", "revisit"), r("q2", "request", "m2"), r("q2", "request", "m2"), r("i2", "metadata", "q2"), r("lost", "request", "nowhere"), r("m3", "resource")]
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    ties = {g["capture_id"]: ([x["record_id"] for x in g["requests"] or []], [x["record_id"] for x in g["metadata"] or []]) for g in got}
    assert ties == {"m1": (["q1"], []), "m2": (["q2"], ["i2"]), "m3": ([], [])} or ties == {"m1": (["q1"], ["i1"]), "m2": (["q2"], ["i2"]), "m3": ([], [])}
    assert ties["m1"] == (["q1"], ["i1"])


def test_plain_and_compressed_files_and_no_pages(spark, tmp_path):
    raw = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [x[0] for x in warc.parse_records(io.BytesIO(raw * 2))] == ["<a>"] * 2
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc").write_bytes(raw)
    (tmp_path / "x" / "b.warc.gz").write_bytes(gzip.compress(raw) * 2)  # a member for each record
    assert warc.read_archive(spark, str(tmp_path / "x")).count() == 3
    assert warc.assemble(write_and_read(spark, [], str(tmp_path / "none"))).count() == 0


def test_every_row_of_pages_has_one_row(spark, tmp_path):
    """The query equals its SQL on repeated rows, null ids and differing urls."""
    import duckdb

    a, b = "<p>a</p>" * 150, "<p>small</p>"
    rows = [(1, "http://u", a), (1, "http://u", a), (1, "http://v", a), (None, "http://a", a), (None, "http://b", a), (None, "http://b", a), (2, "http://w", a), (2, "http://x", a), (2, "http://x", a), (3, None, b), (3, None, b), (4, "http://y z", None), (4, "http://y", None), (5, "", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in warc.op8_warc_transactions(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "n_requests").collect()]
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = db.execute(warc.OP8_SQL).fetchall()
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(want, key=str)


def test_keys_of_any_type_and_files_bounded_by_bytes(spark, tmp_path):
    rows = [("a b\r\n:é", "http://a", "x" * 5000), ("", "http://b", "y" * 40), (None, "http://c", "z" * 900_000), *[(f"k{i}", "http://d", "w" * 9000 + str(i)) for i in range(60)]]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["payload_bytes"] for r in warc.op8_warc_transactions(spark, str(tmp_path)).collect()}
    assert len(got) == 63 and got[""] == 40 and got["a b\r\n:é"] == 5000 and got["k7"] == 9001
    warc.write_archive(df, str(tmp_path / "w"), file_bytes=100_000, compression="none")
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part*"))
    assert len(sizes) > 6 and sizes[-1] < 910_000 and sizes[-2] < 130_000


def test_records_do_not_compute_identifiers_anew(spark, tmp_path, monkeypatch):
    """Identifiers and blocks are columns when records are put together, or each place that names them would compute them again."""
    seen = []
    real = warc._record
    monkeypatch.setattr(warc, "_record", lambda *a: seen.append(real(*a)) or seen[-1])
    assert write_and_read(spark, [(1, "http://a", "x" * 1500, "d"), (2, "http://a", "x" * 1500, "d")], str(tmp_path / "w")).count() == 6
    assert len(seen) == 3 and all("md5" not in str(c) and "url_encode" not in str(c) for c in seen)
    assert sum(str(c).count("html") - str(c).count("text/html") for c in seen) == 1
