"""Cells, postings and merged profiles against the plain ways."""

import numpy as np
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from docforge.operators import cells, checks, postings, profile, search
from docforge.sources import parts


def clustered(spark, groups=24, each=120, dimensions=16):
    """Groups around far directions; a third of all rows are copies of one vector."""
    rng = np.random.default_rng(3)
    places = rng.normal(size=(groups, dimensions))
    vectors = np.repeat(places, each, axis=0) + 0.05 * rng.normal(size=(groups * each, dimensions))
    vectors[::3] = vectors[0]
    data = [(i // 2, vectors[i].astype(np.float32).tolist()) for i in range(len(vectors))]
    return places, spark.createDataFrame(data, "movie_id long, embedding array<float>")


def test_pruned_top_k_is_exact_and_reads_less(spark, tmp_path):
    places, frame = clustered(spark)
    index = cells.write_cells(frame.repartition(4), str(tmp_path / "index"), cells=32, fit_rows=1000)
    assert int(index.sizes.sum()) == frame.count()  # every row is indexed, whatever the centres were fitted on
    requests = {q: places[q].tolist() for q in range(4)}
    found, read = cells.search_cells(index, requests, 5)
    assert rows(found, "query_id", "rank") == rows(search.vector_top_k(frame, requests, 5), "query_id", "rank")
    assert read < 0.5 * frame.count()
    one, alone = cells.search_cells(index, {0: places[7].tolist()}, 5)
    assert rows(one) == rows(search.vector_top_k(frame, {0: places[7].tolist()}, 5))
    assert alone < 0.2 * frame.count()
    again = cells.open_cells(spark, str(tmp_path / "index"))
    assert rows(cells.pruned_top_k(again, requests, 5)) == rows(found)


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_pruned_top_k_for_any_request(spark, tmp_path, k, monkeypatch):
    _, frame = clustered(spark, 6, 40)
    index = cells.write_cells(frame, str(tmp_path / "index"), cells=5)
    rng = np.random.default_rng(k)
    requests = {q: rng.normal(size=16).tolist() for q in range(5)} | {9: [0.0] * 16}
    monkeypatch.setattr(search, "REQUESTS_PER_PASS", 2)
    assert rows(cells.pruned_top_k(index, requests, k)) == rows(search.vector_top_k(frame, requests, k))


def test_no_bound_is_below_a_score(spark, tmp_path):
    _, frame = clustered(spark, 6, 40)
    index = cells.write_cells(frame, str(tmp_path / "index"), cells=7)
    requests = np.random.default_rng(5).normal(size=(20, 16))
    highest = cells.bounds(index, requests)
    units = requests / np.linalg.norm(requests, axis=1, keepdims=True)
    for row in index.vectors.collect():
        scores = units @ (np.array(row.embedding) / np.linalg.norm(row.embedding))
        assert (scores <= highest[:, list(index.ids).index(row.cell)] + 1e-9).all()


def test_broken_and_empty_corpora(spark, tmp_path):
    schema = "movie_id long, embedding array<float>, cell string, parent int"
    data = [(1, [-1.0, 0.0], "x", 1), (2, [float("nan"), 1.0], None, 2), (3, None, "x", 1), (4, [1.0, None], "x", 1), (None, [1.0, 0.0], "x", 1), (6, [0.0, 0.0], "", 0)]
    index = cells.write_cells(spark.createDataFrame(data, schema), str(tmp_path / "few"))
    assert rows(cells.pruned_top_k(index, {0: [1.0, 0.0]}), "rank") == [(0, 6, 0.0, 1), (0, 1, -1.0, 2)]
    none = cells.write_cells(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert cells.pruned_top_k(none, {0: [1.0, 0.0]}).collect() == []
    with pytest.raises(ValueError):
        cells.pruned_top_k(index, {})
    with pytest.raises(ValueError):
        cells.write_cells(spark.createDataFrame(data, schema), str(tmp_path / "many"), cells=10**6)


TITLES = ["Arrival", "The Arrival 2", "arriv", "", None, "ab", "😀😀😀 smile 😀", "xx" * 3000, "aaaa", "ARRIVAL", "a%b_c%d"]


@pytest.fixture(scope="module")
def titled(spark):
    data = [(i % 9 if i != 4 else None, title, float(i % 3), "o", 1.0, "2020-01-01", None, "clash") for i, title in enumerate(TITLES * 3)]
    frame = spark.createDataFrame(data, "movie_id long, title string, popularity double, overview string, vote_average double, release_date string, poster_path string, gram string")
    spark.sql("CREATE SCHEMA IF NOT EXISTS titled")
    postings.write_title_index(frame, "titled.titles", "titled.postings", 8)
    return frame


@pytest.mark.parametrize("query", ["arrival", " ARR ", "ab", "a", "aaa", "😀😀", "😀😀😀", "😀 s", "xxx", "%b_", "nothing", "rival 2"])
def test_indexed_search_equals_title_search(spark, titled, query):
    found = postings.indexed_title_search(spark, "titled.titles", "titled.postings", query, 100)
    assert rows(found) == rows(search.title_search(titled, query, 100))


def test_indexed_search_reads_few_partitions(spark, titled):
    found = postings.indexed_title_search(spark, "titled.titles", "titled.postings", "smile")
    assert "part" in plan(found).partition("PartitionFilters: [")[2].partition("]")[0]
    with pytest.raises(ValueError):
        postings.indexed_title_search(spark, "titled.titles", "titled.postings", "  ")


def test_empty_catalogue(spark, titled):
    postings.write_title_index(titled.limit(0), "titled.no_titles", "titled.no_postings", 4)
    assert postings.indexed_title_search(spark, "titled.no_titles", "titled.no_postings", "arrival").collect() == []


EXACT = ("documents", "avg_chars", "max_chars", "avg_reviews", "with_reviews")


def test_profile_of_grown_table_reads_its_new_partitions(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS profiled")
    size = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5000)).cast("int")
    frame = spark.range(40_000).select(
        F.col("id").alias("movie_id"), F.sha2((F.col("id") % 9000).cast("string"), 256).alias("content_hash"), F.when(F.col("id") % 50 > 0, size).alias("char_length"), (F.col("id") % 4).cast("int").alias("review_count")
    )
    parts.write_whole(frame, "profiled.documents", ["movie_id"], 8)
    assert profile.refresh_profile(spark, "profiled.documents", "profiled.states") == list(range(8))
    assert profile.refresh_profile(spark, "profiled.documents", "profiled.states") == []
    grown = spark.range(40_000, 40_002).select(F.col("id").alias("movie_id"), F.lit("n").alias("content_hash"), F.lit(9999).alias("char_length"), F.lit(None).cast("int").alias("review_count"))
    touched = parts.replace_keys(spark, "profiled.documents", grown, grown)
    assert len(touched) <= 2
    assert profile.refresh_profile(spark, "profiled.documents", "profiled.states") == touched
    merged = profile.merged_profile(spark.table("profiled.states")).first()
    whole = checks.gold_profile(spark.table("profiled.documents")).first()
    assert [merged[name] for name in EXACT] == [whole[name] for name in EXACT]
    below = spark.table("profiled.documents").where(F.col("char_length") <= merged.near_median_chars).count()
    assert abs(below / spark.table("profiled.documents").where("char_length IS NOT NULL").count() - 0.5) < 0.02
    assert abs(merged.near_distinct_hashes / whole.distinct_hashes - 1) < 0.05


def test_profile_of_partitions_that_go_and_of_empty_tables(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS profiled")
    frame = spark.createDataFrame([(i, "h", 5, 0) for i in range(30)], "movie_id long, content_hash string, char_length int, review_count int")
    parts.write_whole(frame, "profiled.few", ["movie_id"], 4)
    profile.refresh_profile(spark, "profiled.few", "profiled.few_states")
    parts.write_whole(frame.where("movie_id = 3"), "profiled.few", ["movie_id"], 4)
    profile.refresh_profile(spark, "profiled.few", "profiled.few_states")
    assert profile.merged_profile(spark.table("profiled.few_states")).first().documents == 1
    parts.write_whole(frame.limit(0), "profiled.few", ["movie_id"], 4)
    profile.refresh_profile(spark, "profiled.few", "profiled.few_states")
    none = profile.merged_profile(spark.table("profiled.few_states")).first()
    assert (none.documents, none.avg_chars, none.near_median_chars, none.near_distinct_hashes) == (0, None, None, None)
