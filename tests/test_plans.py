"""The physical plans that carry the work at scale."""

import pytest
from catalogue import FULL, bronze, genre_list, payload
from conftest import plan

from docforge.functions.vectors import HashingEmbedder
from docforge.operators import embed, gold, listing, parse, search, silver
from docforge.sources import tables


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parsed"))
    parse.parse_payloads(bronze(spark, [(1, FULL), (2, payload(2))])).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_payload_is_parsed_once_after_the_status_filter(spark, tmp_path):
    bronze(spark, [(1, FULL)]).write.parquet(str(tmp_path / "b"))
    text = plan(parse.parse_payloads(spark.read.parquet(str(tmp_path / "b"))))
    assert text.count("from_json(") == 1
    assert "EqualTo(status,success)" in text
    assert "Exchange" not in text


@pytest.mark.parametrize(
    "build",
    [
        silver.movies,
        lambda p: silver.cast(p, one_row_per_id=True),
        lambda p: silver.reviews(p, one_row_per_id=True),
        lambda p: silver.keywords(p, one_row_per_id=True),
        gold.documents_from_parsed,
    ],
)
def test_unique_ids_need_no_shuffle(parsed, build):
    text = plan(build(parsed))
    assert "Exchange" not in text
    assert "Python" not in text


def test_only_the_needed_leaves_are_read(parsed):
    schema = silver.genre_links(parsed, parsed.selectExpr("1L AS genre_id"), True)
    text = plan(schema)
    assert "struct<movie_id:bigint,d:struct<genres:array<struct<id:bigint>>>>" in text


def test_merging_plans_cut_before_the_shuffle(parsed):
    text = plan(silver.cast(parsed, 10))
    before_shuffle = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle
    assert "Partial" in before_shuffle


def test_small_genre_list_is_broadcast_by_its_size(spark, parsed, tmp_path):
    genre_list(spark, (1, "Action")).write.parquet(str(tmp_path / "g"))
    genres = spark.read.parquet(str(tmp_path / "g"))
    assert "BroadcastHashJoin" in plan(silver.genre_links(parsed, genres, True))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert "SortMergeJoin" in plan(silver.genre_links(parsed, genres, True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_tables_join_without_a_shuffle(spark, parsed):
    tables.ensure_namespace(spark, "spark_catalog", "bucketed")
    built = {"movies": silver.movies(parsed), "cast": silver.cast(parsed), "reviews": silver.reviews(parsed)}
    for name, df in built.items():
        tables.write_snapshot(df, f"spark_catalog.bucketed.{name}", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = gold.documents(*(spark.table(f"spark_catalog.bucketed.{name}") for name in built))
        text = plan(documents)
        assert text.count("SortMergeJoin") == 2
        assert "Exchange" not in text
        tables.write_snapshot(documents, "spark_catalog.bucketed.documents", buckets=4)
        stored = spark.table("spark_catalog.bucketed.documents")
        held = stored.select("movie_id", "content_hash")
        tables.write_snapshot(held, "spark_catalog.bucketed.held", buckets=4)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        assert "Exchange" not in plan(embed.unembedded(stored, spark.table("spark_catalog.bucketed.held")))
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_first_seen_is_a_hash_aggregate_without_joins(spark):
    pages = spark.createDataFrame([], "page int, status string, total_pages int, results array<struct<id: bigint>>")
    text = plan(listing.first_seen_ids(pages))
    assert "SortAggregate" not in text
    assert "Join" not in text
    assert "Subquery" in text


def test_listing_text_is_parsed_once_per_use(spark, tmp_path):
    raw = spark.createDataFrame([(1, "{}", "success")], "page int, payload string, status string")
    raw.write.parquet(str(tmp_path / "raw"))
    text = plan(listing.first_seen_ids(listing.parse_pages(spark.read.parquet(str(tmp_path / "raw")))))
    main = text[: text.index("Subquery")]
    assert main.count("from_json(") == 1


def test_search_over_a_lazy_corpus_embeds_once(spark):
    corpus = embed.embed_chunks(spark.createDataFrame([(1, "a")], "movie_id long, chunk_text string"))
    assert plan(search.search_text(corpus, ["a"], HashingEmbedder)).count("ArrowEvalPython") == 1


def test_unchanged_vectors_are_not_moved(spark, parsed):
    """Without buckets and broadcasts: keys are compared by their columns, texts and vectors stay."""
    documents = gold.documents_from_parsed(parsed).select("movie_id", "content_hash")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(embed.unembedded(documents, documents))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for line in text.splitlines():
        if "Exchange" in line:
            assert "doc_text" not in line and "embedding" not in line


def test_search_shuffles_only_candidates(spark):
    corpus = spark.createDataFrame([], "movie_id long, embedding array<float>, noise string")
    text = plan(search.vector_top_k(corpus, {0: [1.0, 2.0]}))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    below = text[text.rindex("Exchange") :]
    assert "MapInArrow" in below and "HashAggregate" in below
    assert "noise" not in text[text.index("MapInArrow") :].split("Scan")[0]
