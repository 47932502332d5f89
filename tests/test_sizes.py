"""Whole results, and plans and files whose size grows no faster than their input."""

import json
import math

from conftest import plan

from docforge.operators import groups
from docforge.plans import bridge, queries, refresh
from docforge.sources import listing_source, parts, tables


def test_the_reference_list_keeps_its_repeats(spark, tmp_path):
    kinds = ["LARGE", "SMALL", "LARGE", None]
    spark.createDataFrame(list(enumerate(kinds)), "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    listed = queries.bronze_reference_list(spark, str(tmp_path))
    assert sorted((row.name or "") for row in listed.collect()) == ["", "LARGE", "LARGE", "SMALL"]


def test_many_pages_are_asked_for_by_few_tasks(spark):
    source = listing_source.listing_source(lambda: "fetcher", lambda fetcher, request: (f"{fetcher} {request['page']}", "success", None), 0.0, 8)
    pages = listing_source.read_pages(spark, source, 3, 1002)
    assert pages.rdd.getNumPartitions() == 8
    assert [tuple(row) for row in pages.select("page", "payload").orderBy("page").collect()] == [(page, f"fetcher {page}") for page in range(3, 1003)]


def test_a_member_sends_no_whole_bitmap(spark):
    history = spark.range(200).selectExpr("id AS user_id", "id * 40000 - 100 AS movie_id", "true AS watched", "5.0 AS rating")
    members = spark.range(200).selectExpr("id % 3 AS group_id", "id AS user_id")
    bitmaps = groups.seen_bitmaps(members, history)
    assert plan(bitmaps).count("partial_bitmap_construct_agg") == 1 and "bitmap_or_agg" not in plan(bitmaps)
    assert bitmaps.selectExpr("sum(bitmap_count(seen))").first()[0] == 200


def test_each_review_is_sent_once_and_reaches_all_its_movies(spark, tmp_path):
    movies, slots = 40, 2
    talks = [(conv, turn, "user", f"text {conv} {turn}") for conv in (-3, -1, 0, 1, 5) for turn in (0, 1)] + [(None, 1, "user", "lost")]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(key, "n", "b", "T", 11, 1.0) for key in range(-3, movies - 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    write([(key, f"d{key}") for key in range(movies)], "doc_id long, text string", "documents")
    write(talks, "conv_id long, turn long, role string, text string", "conversations")
    write([(order, 0, 7, 1, "R") for order in range(-9, 9)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string", "lineitem")
    made = bridge.bronze_payloads(spark, str(tmp_path))
    assert "Generate" not in plan(made)
    want = {}
    for conv, turn, _, _ in talks[:-1]:
        first = int(math.fmod(conv * 13 + turn * 7, slots))
        for copy in range(16):
            want.setdefault(first + copy * slots, set()).add(f"{conv}-{turn}")
    cast = {int(math.fmod(order * 7 + 7 * 17 + 1, movies)) for order in range(-9, 9)}
    for row in made.where("payload LIKE '{\"%'").collect():
        payload = json.loads(row.payload)
        assert {each["id"] for each in (payload["reviews"].get("results") or [])} == want.get(row.movie_id, set())
        assert bool(payload.get("credits", {}).get("cast")) == (row.movie_id in cast)


def test_a_new_table_is_written_once(spark, monkeypatch):
    tables.ensure_namespace(spark, "spark_catalog", "once")

    def refuse(df, name):
        raise AssertionError("the rows of a new table need no second copy")

    monkeypatch.setattr(tables, "write_barrier", refuse)
    assert parts.write_whole(spark.range(30).selectExpr("id AS k"), "spark_catalog.once.t", ["k"], 4) == 30
    assert spark.table("spark_catalog.once.t").where(parts.part_of(["k"], 4) != 0).count() <= 30
    assert parts.layout(spark, "spark_catalog.once.t") == (["k"], 4)


def test_a_large_table_is_rewritten_in_pieces(spark, monkeypatch):
    tables.ensure_namespace(spark, "spark_catalog", "pieces")
    name = "spark_catalog.pieces.t"
    rows = [(None if k == 7 else k, f"old {k}") for k in range(200)]
    parts.write_whole(spark.createDataFrame(rows, "k long, v string"), name, ["k"], 8)
    assert parts.pieces(spark, name, 1, 4) == 4 and parts.pieces(spark, name, 1 << 40, 4) == 1
    written, plain = [], tables.write_barrier

    def noted(df, barrier):
        written.append(plain(df, barrier))
        sizes.append(written[-1].count())
        return written[-1]

    sizes = []
    monkeypatch.setattr(tables, "write_barrier", noted)
    stale = spark.createDataFrame([(k,) for k in (None, 1, 2, 3, 150, 900)], "k long")
    fresh = spark.createDataFrame([(None, "new"), (1, "new"), (1, "twice"), (900, "came")], "k long, v string")
    held = spark.table(name).where(parts.part_of(["k"], 8).isin(parts._touched(spark, name, stale))).count()
    assert len(parts.replace_keys(spark, name, stale, fresh, pieces=3)) > 2
    gone = {None, 1, 2, 3, 150}
    want = [row for row in rows if row[0] not in gone] + [(None, "new"), (1, "new"), (1, "twice"), (900, "came")]
    assert sorted(map(str, want)) == sorted(str((row.k, row.v)) for row in spark.table(name).collect())
    assert len(sizes) == 3 and max(sizes) < held


def test_a_whole_refresh_joins_no_payloads(spark, monkeypatch):
    tables.ensure_namespace(spark, "spark_catalog", "whole")
    settings = queries.Settings(schema="whole", layer_partitions=2)
    tables.write_snapshot(spark.createDataFrame([(1, "A")], "genre_id long, name string"), settings.table("bronze_genres"))
    body = json.dumps({"id": 1, "title": "t", "overview": "o", "genres": [{"id": 1, "name": "A"}]})
    bronze = spark.createDataFrame([(1, body, "success"), (2, body, "success"), (None, body, "success")], "movie_id long, payload string, status string")
    bronze = bronze.selectExpr("*", "CAST(NULL AS string) AS error", "current_timestamp() AS ingested_at")
    made, plain = {}, refresh.parts.write_whole

    def noted(df, name, *rest):
        made[name.split(".")[-1]] = plan(df)
        return plain(df, name, *rest)

    monkeypatch.setattr(refresh.parts, "write_whole", noted)
    assert refresh.refresh(spark, settings, bronze) == {"added": 3}
    assert "Join" not in made["parsed"]
    assert sorted(row.movie_id for row in spark.table(settings.table("gold_documents")).collect()) == [1, 2]


def test_null_counts_write_no_parsed_records(spark, monkeypatch):
    bronze = spark.createDataFrame([(1, '{"title":"t","overview":"o"}', "success"), (2, "{", "success")], "movie_id long, payload string, status string").selectExpr("*", "current_timestamp() AS ingested_at")
    monkeypatch.setattr(queries, "crawled", lambda spark, folder: bronze)

    def refuse(spark, folder):
        raise AssertionError("the layers are not needed")

    monkeypatch.setattr(queries, "layers", refuse)
    counts = queries.silver_null_counts(spark, "").first()
    assert counts.title == 0 and counts.runtime_minutes == 1


def test_a_refreshed_query_writes_its_own_layer_alone(spark, tmp_path, monkeypatch):
    spark.range(1).write.parquet(f"{tmp_path}/part.parquet")
    body = lambda key: json.dumps({"id": key, "title": "t", "overview": "o", "genres": [{"id": key % 3, "name": "A"}]}, separators=(",", ":"))
    bronze = spark.createDataFrame([(key, body(key), "success") for key in range(40)], "movie_id long, payload string, status string")
    bronze = bronze.selectExpr("*", "CAST(NULL AS string) AS error", "current_timestamp() AS ingested_at")
    monkeypatch.setattr(queries, "crawled", lambda spark, folder: bronze)
    monkeypatch.setattr(queries, "genre_entries", lambda spark, folder: spark.createDataFrame([(0, "A"), (1, "B")], "genre_id long, name string"))
    brought, plain, written, barrier = [], refresh._bring, [], tables.write_barrier
    monkeypatch.setattr(refresh, "_bring", lambda *args, **more: (brought.append(args[3]), plain(*args, **more)))
    monkeypatch.setattr(tables, "write_barrier", lambda df, name: (written.append(name), barrier(df, name))[1])
    links = queries.refreshed_links(spark, str(tmp_path)).collect()
    assert sorted((row.genre_id, row.movie_id) for row in links) == sorted((key % 3, key) for key in range(40) if key % 3 < 2)
    assert set(brought) == {"silver_movie_genres"} and "parsed" not in written
