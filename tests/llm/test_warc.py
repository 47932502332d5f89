import gzip
import hashlib
import zlib
from statistics import median

from pyspark.sql import functions as F

from docforge.llm import warc
from docforge.llm.queries import op7_warc


def expected(pages, least=1000):
    keeper = {}
    for page, html in pages:
        keeper[html or ""] = max(keeper.get(html or "", page), page)
    for page, html in pages:
        payload = (html or "").encode()
        refers = keeper[html or ""] if len(payload) >= least and keeper[html or ""] != page else None
        yield page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers is not None else "response", refers


def result(rows):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def test_query_against_brute_force(spark, small):
    pages = [(row.page_id, row.html) for row in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert result(op7_warc(spark, small).collect()) == sorted(expected(pages))


def test_revisits_nulls_and_many_small_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    big, other = "é" * 600, "<p>" + "x\r\n\r\ny" * 300
    pages = [(1, big), (2, other), (3, big), (4, None), (5, ""), (6, big), (7, other), (8, "small"), (9, "small")]
    frame = spark.createDataFrame([(page, f"http://h/{page} \r\nX: y", html, "z") for page, html in pages], "page_id long, url string, html string, digest string")
    files = warc.archive(frame, str(tmp_path / "out"))
    rows = warc.read_archives(files).collect()
    assert result(rows) == sorted(expected(pages))
    assert len({row.path for row in rows}) > 1
    # Each record is a gzip member of its own, and all members together are one gzip file.
    row = next(row for row in rows if row.page_id == 6)
    data = open(row.path, "rb").read()
    member = zlib.decompressobj(31).decompress(data[row.offset :])
    assert warc.parse_record(member).payload.decode() == big
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == sum(other.path == row.path for other in rows)
    assert b"\r\nX: y" not in gzip.decompress(data)


def test_stream_is_cut_anywhere():
    records = [warc.format_record(n, None, b"x\r\n\r\n" * n, None, "2000-01-01T00:00:00Z") for n in range(5)]
    whole = b"".join(records)
    for step in (1, 7, 100, len(whole)):
        assert list(warc.records_of(whole[at : at + step] for at in range(0, len(whole), step))) == records


def test_repeated_rows_and_empty_table(spark):
    schema = "page_id long, url string, html string"
    big = "y" * 2000
    rows = spark.createDataFrame([(1, None, big), (2, None, big), (2, None, big), (None, None, big)], schema)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.read_archives(warc.archive(rows)).collect()) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None)]
    assert warc.read_archives(warc.archive(spark.createDataFrame([], schema))).collect() == []


def test_copies_of_one_page_meet_in_no_task(spark):
    hot = F.when(F.col("id") % 4 > 0, F.lit("h" * 1500)).otherwise(F.concat(F.lit("x" * 1200), F.col("id").cast("string")))
    pages = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id")).alias("url"), hot.alias("html"))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("-1", "false", "16"), strict=True):
            spark.conf.set(name, value)
        for html in ("html", F.when(F.col("page_id") % 4 > 0, "").otherwise(F.col("html"))):
            roles = warc.with_roles(pages.withColumn("html", html if not isinstance(html, str) else F.col(html)))
            # The referred page is read too, or no join would be left to look at.
            tasks = roles.groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.count("refers_to").alias("revisits")).collect()
            sizes = [row.rows for row in tasks]
            assert len(sizes) == 16 and max(sizes) < 2 * median(sizes)
            assert sum(row.revisits for row in tasks) == (29_999 if isinstance(html, str) else 0)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_long_page_and_clashing_columns(spark):
    long = "é<p>" * 2_000_000
    pages = spark.createDataFrame([(1, "u", long, 7, b"x"), (2, "u", long, 7, b"x")], "page_id long, url string, html string, salt int, payload binary")
    rows = warc.read_archives(warc.archive(pages)).collect()
    assert result(rows) == sorted(expected([(1, long), (2, long)]))


def test_normaliser_writes_as_it_reads(tmp_path):
    """Members reach the file one by one: no more than one is held between two writes."""
    records = [warc.format_record(n, None, b"y" * 5000, None, "2000-01-01T00:00:00Z") for n in range(50)]
    path = tmp_path / "whole.warc.gz"
    path.write_bytes(gzip.compress(b"".join(records)))
    lines: list[bytes] = []
    members = warc.members_of(str(path), 6, lines)
    for n, member in enumerate(members, 1):
        assert gzip.decompress(member) == records[n - 1] and len(lines) == n
