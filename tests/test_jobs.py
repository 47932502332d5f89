"""Whole jobs on recorded responses, tables, application data, settings."""

from datetime import datetime
from functools import partial
from pathlib import Path
from types import SimpleNamespace

import pytest
from catalogue import FULL, payload, review
from conftest import rows
from pyspark.sql import functions as F

from docforge.config import Settings
from docforge.operators import checks, embed, gold, groups, silver
from docforge.plans import jobs
from docforge.schemas import APPLICATION
from docforge.sources import jdbc, tables
from docforge.sources.fetchers import FetchError, RecordedFetcher

GENRES = [{"id": 1, "name": "Action"}, {"id": 2, "name": "Drama"}]


def crawl(spark, settings, films, listed):
    pages = {1: {"results": [{"id": i} for i in listed], "total_pages": 1}}
    return jobs.ingest(
        spark,
        settings,
        partial(RecordedFetcher, pages, "page"),
        partial(RecordedFetcher, films),
        GENRES,
    )


@pytest.fixture
def settings(request):
    return Settings(schema=request.node.name.split("[")[0], discover_pages=2, max_requests_per_second=10_000)


def films(*ids):
    return {i: payload(i, genres=[GENRES[i % 2]], reviews={"results": [review("r", f"{i}" * 900)]}) for i in ids}


@pytest.mark.filterwarnings("ignore::docforge.operators.checks.QualityWarning")
def test_crawl_build_embed(spark, settings):
    known = {**films(*range(2, 10)), 1: FULL}
    counts = crawl(spark, settings, known, [3, 1, 2, 1, 4, 5, 6, 7, 8, 9, 99])
    assert counts == {"success": 9, "not_found": 1}
    bronze = spark.table(settings.table("bronze_payloads"))
    assert bronze.columns == ["movie_id", "payload", "status", "error", "ingested_at"]
    assert spark.table(settings.table("bronze_genres")).count() == 2

    written = jobs.build(spark, settings)
    assert written == {
        "parsed": 9,
        "silver_genres": 2,
        "silver_movies": 9,
        "silver_movie_genres": 10,
        "silver_cast": 2,
        "silver_keywords": 2,
        "silver_reviews": 10,
        "gold_documents": 9,
    }
    stored = [spark.table(settings.table(f"silver_{name}")) for name in ("movies", "cast", "reviews")]
    documents = spark.table(settings.table("gold_documents"))
    assert rows(gold.documents(*stored).drop("built_at")) == rows(documents.drop("built_at"))

    vectors = settings.table("movie_embeddings")
    first = jobs.embed_changed(spark, settings)
    before = rows(spark.table(vectors).select("movie_id", "content_hash", "chunk_index", "embedding"))
    assert first == len(before) > 9
    # Nothing changed: nothing is embedded again.
    assert jobs.embed_changed(spark, settings, refuse) == first
    assert rows(spark.table(vectors).select("movie_id", "content_hash", "chunk_index", "embedding")) == before

    known[4] = payload(4, overview="rewritten")
    crawl(spark, settings, known, range(1, 10))
    jobs.build(spark, settings)
    jobs.embed_changed(spark, settings)
    after = spark.table(vectors)
    changed = {r[:2] for r in rows(after.select("movie_id", "content_hash"))} ^ {r[:2] for r in before}
    assert {movie for movie, _ in changed} == {4}
    assert rows(after.select("movie_id", "content_hash").distinct()) == rows(
        spark.table(settings.table("gold_documents")).select("movie_id", "content_hash")
    )


def refuse():
    def embedder(texts):
        raise AssertionError("nothing should be embedded")

    return embedder


def test_crawl_stops_when_too_much_fails(spark, settings):
    crawl(spark, settings, films(1, 2), [1, 2])
    bad = {**films(1, 2, 3), 4: FetchError("down")}
    with pytest.raises(checks.QualityError, match="only 3 of 4"):
        crawl(spark, settings, bad, [1, 2, 3, 4])
    assert spark.table(settings.table("bronze_payloads")).count() == 2


@pytest.mark.filterwarnings("ignore::docforge.operators.checks.QualityWarning")
def test_only_partitions_with_a_changed_document_are_rewritten(spark, settings):
    crawl(spark, settings, films(*range(1, 13)), range(1, 13))
    jobs.build(spark, settings)
    jobs.embed_changed(spark, settings)
    target = settings.table("movie_embeddings")
    before = set(spark.table(target).inputFiles())
    crawl(spark, settings, {**films(*range(1, 12)), 3: payload(3, overview="rewritten")}, range(1, 12))
    jobs.build(spark, settings)
    jobs.embed_changed(spark, settings)
    part = {row.part for row in spark.range(3, 13).where("id IN (3, 12)").select(embed.partition_of("id", 64).alias("part")).collect()}
    changed = before ^ set(spark.table(target).inputFiles())
    assert {int(path.split("part=")[1].split("/")[0]) for path in changed} == part
    held = rows(spark.table(target).select("movie_id", "content_hash").distinct())
    assert held == rows(spark.table(settings.table("gold_documents")).select("movie_id", "content_hash"))


def test_build_of_nothing_raises(spark, settings):
    crawl(spark, settings, {1: "not an object"}, [1])
    with pytest.raises(checks.QualityError, match="no documents"):
        jobs.build(spark, settings)


@pytest.mark.filterwarnings("ignore::docforge.operators.checks.QualityWarning")
def test_repeated_ids_take_the_merging_plans(spark, settings):
    crawl(spark, settings, films(1, 2), [1, 2])
    target = settings.table("bronze_payloads")
    tables.write_snapshot(spark.table(target).union(spark.table(target).where("movie_id = 1")), target)
    written = jobs.build(spark, settings)
    assert (written["parsed"], written["silver_movie_genres"], written["gold_documents"]) == (3, 2, 3)
    assert rows(spark.table(settings.table("silver_reviews")).groupBy("movie_id").count()) == [(1, 2), (2, 1)]


# ---------------------------------------------------------------- tables


def test_snapshot_replaces_rows_and_schema(spark):
    tables.ensure_namespace(spark, "spark_catalog", "snap")
    assert tables.write_snapshot(spark.range(5), "spark_catalog.snap.t") == 5
    assert tables.write_snapshot(spark.range(2).selectExpr("id AS a", "'x' AS b"), "spark_catalog.snap.t") == 2
    assert spark.table("spark_catalog.snap.t").columns == ["a", "b"]
    for doubled in (4, 8):
        held = spark.table("spark_catalog.snap.t")
        assert tables.write_snapshot(held.union(held), "spark_catalog.snap.t") == doubled
    counts = tables.row_counts({"t": spark.table("spark_catalog.snap.t"), "u": spark.range(3)})
    assert tables.collect_small(counts, "table_name", "rows") == {"t": 8, "u": 3}


def test_failed_rebuild_and_gate_leave_the_old_rows(spark):
    tables.ensure_namespace(spark, "spark_catalog", "kept")
    name = "spark_catalog.kept.t"
    tables.write_snapshot(spark.range(3), name)

    def refuse_it(df):
        assert df.count() == 5 and spark.table(name).count() == 3
        raise checks.QualityError("no")

    with pytest.raises(checks.QualityError):
        tables.write_snapshot(spark.range(5), name, gate=refuse_it)
    with pytest.raises(Exception, match="broken"):
        tables.write_snapshot(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), name)
    assert spark.table(name).count() == 3
    assert [row.tableName for row in spark.sql("SHOW TABLES IN spark_catalog.kept").collect()] == ["t"]


def test_interrupted_exchange_is_mended(spark):
    tables.ensure_namespace(spark, "spark_catalog", "mended")
    name = "spark_catalog.mended.t"
    tables.write_snapshot(spark.range(3), name)
    spark.sql(f"ALTER TABLE {name} RENAME TO mended.t__old_1")
    assert tables.recover(spark, name) and spark.table(name).count() == 3
    assert not tables.recover(spark, name)
    assert tables.write_snapshot(spark.table(name).union(spark.table(name)), name) == 6


def session_with(**conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)))


def test_shared_root_is_the_cluster_folder():
    named = session_with(spark_checkpoint_dir="hdfs:///shared/", spark_master="yarn")
    assert tables.shared_root(named) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_root(session_with(spark_master="yarn"))
    local = session_with(spark_master="local[2]", spark_app_id="a")
    assert tables.shared_root(local) == tables.shared_root(local)


def test_barrier_continues_from_files(spark):
    kept = tables.write_barrier(spark.range(3), "three")
    assert kept.inputFiles()[0].removeprefix("file://").startswith(tables.shared_root(spark).removeprefix("file:"))
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://")
    tables.drop_barrier(kept)
    assert not Path(path).parent.exists()


# ---------------------------------------------------------------- groups


def test_group_exclusion(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (1, 10)], "group_id int, user_id int")
    history = spark.createDataFrame(
        [(10, 100, True, None), (11, 101, False, 2.9), (11, 102, False, 3.0), (12, 103, True, 1.0), (10, 104, None, None)],
        "user_id int, movie_id int, watched boolean, rating double",
    )
    assert rows(groups.excluded_titles(members, history)) == [(1, 100), (1, 101), (2, 101)]
    candidates = spark.createDataFrame(
        [(g, m, 0.5) for g in (1, 2, 3) for m in range(100, 105)], "group_id int, movie_id int, score double"
    )
    kept = rows(groups.exclude_seen(candidates, members, history).select("group_id", "movie_id"))
    assert kept == [(g, m) for g, seen in ((1, (100, 101)), (2, (101,)), (3, ())) for m in range(100, 105) if m not in seen]


def ratings(spark, *data):
    return spark.createDataFrame(
        [(user, movie, stars, True, datetime(2024, 1, day)) for user, movie, stars, day in data],
        APPLICATION["ratings"],
    )


def test_recorded_ratings_keep_the_newest(spark):
    app = Settings(schema="app")
    for _ in range(2):
        jobs.create_application_tables(spark, app)
    assert spark.table(app.table("recommendations")).isEmpty()
    key, order = ["user_id", "movie_id"], [F.desc("rated_at")]
    record = partial(jobs.record, spark, app.table("ratings"), keys=key, order=order)
    assert record(records=ratings(spark, (1, 1, 5.0, 1), (1, 1, 4.0, 3), (2, 1, 3.0, 1))) == 2
    assert record(records=ratings(spark, (2, 1, 1.0, 4), (2, 1, 2.0, 3), (3, 9, 5.0, 1))) == 3
    found = rows(spark.table(app.table("ratings")).select("user_id", "movie_id", "rating"))
    assert found == [(1, 1, 4.0), (2, 1, 1.0), (3, 9, 5.0)]
    # A late record is older than the one held; null keys are one key.
    assert record(records=ratings(spark, (2, 1, 5.0, 2), (None, 9, 1.0, 1), (None, 9, 2.0, 2))) == 4
    assert record(records=ratings(spark, (None, 9, 3.0, 1))) == 4
    found = spark.table(app.table("ratings")).where("user_id IS NULL OR user_id = 2")
    assert rows(found.select("rating"), "rating") == [(1.0,), (2.0,)]


def test_upsert_replaces_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    new = spark.createDataFrame([(None, 2)], "k int, v int")
    for _ in range(2):
        old = groups.upsert(old, new, ["k"])
    assert rows(old, "v") == [(1, 1), (None, 2)]


# ---------------------------------------------------------------- JDBC, settings


def test_query_parameters(spark):
    people = spark.createDataFrame([(1, "a'b"), (2, "c"), (3, None)], "id int, name string")
    query = "SELECT id, name FROM people WHERE name = %s OR id > ? ORDER BY id"
    assert jdbc.run_query(spark, query, ("a'b", 2), {"people": people}) == [{"id": 1, "name": "a'b"}, {"id": 3, "name": None}]
    assert jdbc.run_query(spark, "SELECT id FROM people WHERE id > 9", tables={"people": people}) == []
    titles = spark.createDataFrame([(1, "%science"), (2, "?cience"), (3, "%s")], "id int, title string")
    query = "SELECT id FROM titles WHERE title LIKE '%science%' AND id < %s -- %s is text here"
    assert jdbc.run_query(spark, query, (9,), {"titles": titles}) == [{"id": 1}]
    query = "SELECT id AS `%s` FROM titles WHERE title = '%s' /* %s */ AND title <> 'it''s %s' AND id = %s"
    assert jdbc.run_query(spark, query, (3,), {"titles": titles}) == [{"%s": 3}]


def test_jdbc_write_mode_is_checked(spark):
    with pytest.raises(ValueError):
        jdbc.write_table(spark.range(1), "jdbc:none:", "t", "ignore")


def test_settings_order():
    env = {"CAST_LIMIT": "7", "REVIEW_LIMIT": "many", "SCHEMA": "films"}
    found = Settings.resolve({"cast_limit": "", "chunk_size": "900", "review_char_limit": 50}, env)
    assert (found.cast_limit, found.review_limit, found.chunk_size, found.review_char_limit) == (7, 8, 900, 50)
    assert found.table("t") == "spark_catalog.films.t"
    assert Settings.resolve({}, {}) == Settings()
    assert Settings.resolve({"cast_limit": 3}, env).cast_limit == 3
