"""Changes through the layers, resumed crawls, listings that end, change sets and tables dealt to partitions."""

import json
import random
import sys
from dataclasses import replace
from functools import partial

import pytest
from catalogue import NOW, bronze, genre_list, payload, person, review
from conftest import plan, rows
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docforge.config import Settings
from docforge.operators import changes, checks, drift, fetch, groups, listing
from docforge.plans import jobs, refresh
from docforge.schemas import FETCH_LEDGER
from docforge.sources import parts, tables
from docforge.sources.fetchers import FetchError, NotFoundError, RecordedFetcher, TransientError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests

LAYERS = ("parsed", "silver_genres", "silver_movies", "silver_movie_genres", "silver_cast", "silver_keywords", "silver_reviews", "gold_documents")

COMPARED = {
    "silver_movie_genres": ["genre_id", "movie_id"],
    "silver_cast": ["movie_id", "person_id", "name", "character_name", "billing_order"],
    "silver_reviews": ["movie_id", "review_id", "author", "content", "created_at", "review_rank"],
    "gold_documents": ["movie_id", "title", "content_hash", "review_count", "char_length"],
}


@pytest.fixture
def settings(spark, request):
    name = request.node.name.split("[")[0][5:45]
    tables.ensure_namespace(spark, "spark_catalog", name)
    return Settings(schema=name, layer_partitions=8, max_requests_per_second=100_000, fetch_waves=4)


def land(spark, settings, payloads, genres):
    tables.write_snapshot(bronze(spark, payloads), settings.table("bronze_payloads"))
    tables.write_snapshot(genre_list(spark, *genres), settings.table("bronze_genres"))


def state(spark, settings):
    """All layers as sets of rows, without clocks."""
    out = {}
    for name in LAYERS:
        table = spark.table(settings.table(name))
        plain = table.drop(parts.PART, "built_at", "ingested_at")
        out[name] = sorted(row.asDict(recursive=True).__repr__() for row in plain.collect())
    return out


def film(rng, key):
    return payload(
        key,
        title=None if rng.random() < 0.1 else f"T{rng.randrange(5)}",
        genres=[{"id": rng.randrange(6), "name": "g"} for _ in range(rng.randrange(3))],
        credits={"cast": [person(rng.randrange(50), f"P{n}", n) for n in range(rng.randrange(13))]},
        keywords={"keywords": [{"id": rng.randrange(9), "name": "k"} for _ in range(rng.randrange(4))]},
        reviews={"results": [review(f"r{n}", "y" * rng.randrange(90, 200)) for n in range(rng.randrange(10))]},
    )


@pytest.mark.filterwarnings("ignore::docforge.operators.checks.QualityWarning")
@pytest.mark.parametrize("repeats", [False, True])
def test_refresh_equals_a_full_build_after_random_changes(spark, settings, repeats):
    rng = random.Random(11 + repeats)
    held = {key: film(rng, key) for key in range(40)}
    genres = [(n, f"G{n}") for n in range(5)]
    for turn in range(2):
        for key in rng.sample(sorted(held), 6):
            if rng.random() < 0.4:
                del held[key]
            else:
                held[key] = film(rng, key)
        for key in range(100 * turn, 100 * turn + 4):
            held[key] = "{bad" if key % 4 == 3 else film(rng, key)
        genres = [(n, f"G{n}") for n in range(5 - turn)] + [(9, f"H{turn}")]
        payloads = list(held.items()) + ([(key, film(rng, key)) for key in sorted(held)[:5]] if repeats else [])
        land(spark, settings, payloads, genres)
        refresh.refresh(spark, settings)
        whole = Settings(schema=f"{settings.schema}_w")
        tables.ensure_namespace(spark, "spark_catalog", whole.schema)
        for name in ("bronze_payloads", "bronze_genres"):
            tables.write_snapshot(spark.table(settings.table(name)), whole.table(name))
        jobs.build(spark, whole)
        assert state(spark, settings) == state(spark, whole)
    assert refresh.refresh(spark, settings) == {}


def test_only_partitions_of_changed_records_are_read_and_written(spark, settings):
    films = {key: payload(key, credits={"cast": [person(1)]}) for key in range(60)}
    land(spark, settings, list(films.items()), [(1, "a")])
    assert refresh.refresh(spark, settings) == {"added": 60}
    before = {name: set(spark.table(settings.table(name)).inputFiles()) for name in ("parsed", "silver_movies", "silver_cast", "gold_documents")}
    films[7] = payload(7, overview="rewritten", credits={"cast": [person(1)]})
    del films[12]
    land(spark, settings, list(films.items()), [(1, "a")])
    assert refresh.refresh(spark, settings) == {"changed": 1, "removed": 1}
    touched = {row.part for row in spark.range(60).where("id IN (7, 12)").select(parts.part_of(["id"], 8)).collect()}
    for name, files in before.items():
        moved = files ^ set(spark.table(settings.table(name)).inputFiles())
        assert {int(path.split("part=")[1].split("/")[0]) for path in moved} == touched
    held = spark.table(settings.table("gold_documents")).where(F.col("part").isin(sorted(touched)))
    assert "PartitionFilters: [isnotnull(part" in plan(held) or "PartitionFilters: [part" in plan(held)


@pytest.mark.filterwarnings("ignore::docforge.operators.checks.QualityWarning")
@pytest.mark.parametrize("layer, repeats", [("silver_movie_genres", False), ("silver_movie_genres", True), ("silver_reviews", False), ("gold_documents", True)])
def test_a_refresh_of_one_layer_writes_no_other(spark, settings, monkeypatch, layer, repeats):
    monkeypatch.setattr(refresh, "PIECE", 1)
    monkeypatch.setattr(refresh, "PIECES", 2)
    settings = replace(settings, schema=f"one_{layer}_{repeats}".lower())
    tables.ensure_namespace(spark, "spark_catalog", settings.schema)
    rng = random.Random(5)
    held = {key: film(rng, key) for key in range(30)}
    again = [(key, film(rng, key)) for key in range(5)] if repeats else []
    # Another layer is asked for in the third turn, when bronze is as it was.
    for layers, genres in (([layer], [(n, f"G{n}") for n in range(4)]), ([layer], [(n, f"H{n}") for n in range(1, 6)]), (["silver_cast"], [(1, "H1"), (7, "H7")])):
        land(spark, settings, list(held.items()) + again, genres)
        refresh.refresh(spark, settings, layers=layers)
        whole = Settings(schema=f"{settings.schema}_{len(genres)}")
        tables.ensure_namespace(spark, "spark_catalog", whole.schema)
        for name in ("bronze_payloads", "bronze_genres"):
            tables.write_snapshot(spark.table(settings.table(name)), whole.table(name))
        jobs.build(spark, whole)
        kept = {layer, *layers}
        assert {name for name in refresh.LAYERS if spark.catalog.tableExists(settings.table(name))} == kept
        for name in kept:
            now, want = (sorted(map(str, spark.table(each.table(name)).select(*COMPARED[name]).collect())) for each in (settings, whole))
            assert now == want and now
        if layers == [layer] and 100 not in held:
            held = {key: film(rng, key) if key % 4 == 1 else value for key, value in held.items() if key % 9} | {100: film(rng, 100)}
    with pytest.raises(ValueError, match="no such layer"):
        refresh.refresh(spark, settings, layers=["silver_genres"])


def test_a_refresh_that_was_cut_short_is_made_up_for(spark, settings, monkeypatch):
    films = {key: payload(key) for key in range(20)}
    land(spark, settings, list(films.items()), [(1, "a")])
    refresh.refresh(spark, settings)
    changed = {**films, 3: payload(3, overview="for a moment"), 30: payload(30)}
    land(spark, settings, list(changed.items()), [(1, "a")])
    bring, seen = refresh._bring, []

    def stop(*args):
        seen.append(args[3])
        if len(seen) == 4:
            raise RuntimeError("power cut")
        return bring(*args)

    monkeypatch.setattr(refresh, "_bring", stop)
    with pytest.raises(RuntimeError, match="power cut"):
        refresh.refresh(spark, settings)
    monkeypatch.setattr(refresh, "_bring", bring)
    # Bronze is as it was before; the ledger alone would see no change.
    land(spark, settings, list(films.items()), [(1, "a")])
    assert sum(refresh.refresh(spark, settings).values()) == 2
    for name in ("parsed", "silver_movies", "gold_documents"):
        held = spark.table(settings.table(name))
        assert rows(held.select("movie_id")) == [(key,) for key in range(20)]
    assert spark.table(settings.table("silver_movies")).where("overview = 'for a moment'").isEmpty()


def test_nothing_in_bronze_leaves_the_layers(spark, settings):
    land(spark, settings, [(1, payload(1))], [(1, "a")])
    refresh.refresh(spark, settings)
    tables.write_snapshot(bronze(spark, [], [(1, "error")]), settings.table("bronze_payloads"))
    with pytest.raises(checks.QualityError, match="no payload"):
        refresh.refresh(spark, settings)
    assert spark.table(settings.table("gold_documents")).count() == 1


def test_digests_depend_on_no_order_and_on_every_row(spark):
    frame = lambda *texts: bronze(spark, [(1, text) for text in texts] + [(2, None)])
    digest = lambda *texts: {row.movie_id: row.digest for row in changes.payload_digests(frame(*texts)).collect()}
    assert digest("a", "b") == digest("b", "a")
    assert len({digest(*texts)[1] for texts in (("a", "b"), ("a",), ("a", "a"), ("ab",), ("b", "b"))}) == 5


# ---------------------------------------------------------------- crawl


class Counting:
    """Answers by rule, and notes every request in a folder."""

    def __init__(self, folder, answer):
        self.folder, self.answer = folder, answer

    def fetch(self, request):
        key = request["movie_id"]
        with open(f"{self.folder}/{key}", "a") as log:
            log.write("x")
        return self.answer(key, request["attempt"])


def by_rule(key, attempt):
    if key % 10 == 3:
        raise NotFoundError("gone")
    if key % 10 == 5:
        raise FetchError("malformed")
    if key % 10 == 7 and attempt < 1 or key % 10 == 8:
        raise TransientError("busy")
    return {"id": key}


def asked(folder):
    return {int(path.name): len(path.read_text()) for path in folder.iterdir()}


def test_a_crawl_that_was_cut_goes_on_where_it_stood(spark, settings, tmp_path):
    ledger = settings.table("ledger")
    requests = spark.range(50).withColumnRenamed("id", "movie_id")
    crawl = partial(fetch.fetch_in_waves, requests, partial(Counting, str(tmp_path), by_rule), ledger, 4, 3, 2)
    assert not crawl(most_waves=2)
    first = asked(tmp_path)
    assert 0 < len(first) < 50 and set(first.values()) == {1}
    assert crawl()
    times = {7: 2, 8: 3}
    assert asked(tmp_path) == {key: times.get(key % 10, 1) for key in range(50)}
    assert crawl() and asked(tmp_path) == {key: times.get(key % 10, 1) for key in range(50)}
    got = {row.movie_id: (row.status, row.error) for row in fetch.answers(spark.table(ledger)).collect()}
    failed = {3: ("not_found", "gone"), 5: ("error", "malformed"), 8: ("error", "busy")}
    assert got == {key: failed.get(key % 10, ("success", None)) for key in range(50)}


def test_a_wave_that_fails_leaves_nothing_behind(spark, settings, tmp_path):
    ledger = settings.table("ledger")
    requests = spark.range(30).withColumnRenamed("id", "movie_id")

    def broken(key, attempt):
        if key == 17:
            raise KeyError("a fault of ours")
        return {"id": key}

    with pytest.raises(Exception, match="a fault of ours"):
        fetch.fetch_in_waves(requests, partial(Counting, str(tmp_path), broken), ledger, 6, 2, 1)
    held = {row.movie_id for row in spark.table(ledger).collect()}
    assert 17 not in held
    for path in tmp_path.iterdir():
        path.unlink()
    assert fetch.fetch_in_waves(requests, partial(Counting, str(tmp_path), lambda key, attempt: {"id": key}), ledger, 6, 2, 1)
    assert set(asked(tmp_path)) == set(range(30)) - held


def test_outstanding_reads_no_payload(spark, tmp_path):
    spark.createDataFrame([(1, "{}", "success", None, NOW, False, 1)], FETCH_LEDGER).write.parquet(str(tmp_path / "l"))
    todo = fetch.outstanding(spark.range(3).withColumnRenamed("id", "movie_id"), spark.read.parquet(str(tmp_path / "l")), 3, 2)
    assert "ReadSchema: struct<movie_id:bigint,retry:boolean>" in todo._jdf.queryExecution().toString()
    assert rows(todo.select("movie_id", "attempt")) == [(0, 0), (2, 0)]


def test_ingest_resumes(spark, settings, monkeypatch):
    pages = {1: {"results": [{"id": key} for key in range(1, 21)], "total_pages": 1}}
    films = {key: payload(key) for key in range(1, 21)}
    run = partial(jobs.ingest, spark, settings, partial(RecordedFetcher, pages, "page"))
    kept = fetch.fetch_in_waves
    monkeypatch.setattr(jobs.fetch, "fetch_in_waves", lambda *args, **options: kept(*args, **options, most_waves=2) and None)
    with pytest.raises(checks.QualityError):  # the gate sees too few
        run(partial(RecordedFetcher, {}), [])
    held = spark.table(settings.table("fetch_ledger")).count()
    assert 0 < held < 20
    monkeypatch.setattr(jobs.fetch, "fetch_in_waves", kept)
    with pytest.raises(checks.QualityError):
        run(partial(RecordedFetcher, films), [], resume=True)  # what was answered stays answered
    assert run(partial(RecordedFetcher, films), []) == {"success": 20}
    assert not spark.catalog.tableExists(settings.table("fetch_ledger"))


class Pages:
    """A listing of some pages that notes what it is asked for."""

    def __init__(self, folder, last, empty=None, broken=()):
        self.folder, self.last, self.empty, self.broken = folder, last, empty, broken

    def fetch(self, request):
        page = request["page"]
        with open(f"{self.folder}/{page}", "a") as log:
            log.write("x")
        if page in self.broken:
            raise FetchError("down")
        if page > self.last:
            raise NotFoundError("no such page")
        return {"page": page, "total_pages": self.last, "results": [] if page == self.empty else [{"id": 10 * page + n} for n in range(3)]}


@pytest.mark.parametrize(("last", "empty", "most", "requested"), [(1, None, 50, 1), (5, None, 50, 8), (40, 3, 50, 4), (40, None, 20, 20), (8, None, 50, 8), (9, None, 50, 16)])
def test_a_listing_is_asked_up_to_its_end(spark, tmp_path, last, empty, most, requested):
    raw = listing.fetch_until_stop(spark, partial(Pages, str(tmp_path), last, empty), most)
    asked_for = asked(tmp_path)
    assert asked_for == {page: 1 for page in range(1, requested + 1)}
    used = min(empty or last, most)
    assert len(asked_for) < 2 * used or used == 1
    ids = listing.first_seen_ids(listing.parse_pages(raw))
    assert [row.movie_id for row in ids.orderBy("page", "position").collect()] == [10 * page + n for page in range(1, used + (empty is None)) for n in range(3)]
    assert asked(tmp_path) == asked_for


def test_a_page_that_fails_does_not_end_the_listing(spark, tmp_path):
    raw = listing.fetch_until_stop(spark, partial(Pages, str(tmp_path), 6, None, (2,)), 50)
    pages = listing.parse_pages(raw)
    assert rows(raw.select("page", "status")) == [(page, "error" if page == 2 else "not_found" if page > 6 else "success") for page in range(1, 9)]
    with pytest.raises(RuntimeError, match="1 listing pages"):
        listing.require_pages(pages)


# ---------------------------------------------------------------- dealt tables


def test_snapshots_left_by_interrupted_writes(spark):
    tables.ensure_namespace(spark, "spark_catalog", "left")
    name = "spark_catalog.left.t"
    for stamp, count in (("00000000000000000007", 7), ("00000000000000000012", 12), ("9", 9)):
        spark.range(count).write.saveAsTable(f"{name}__old_{stamp}")
    spark.range(1).write.saveAsTable(f"{name}__new_00000000000000000013")
    spark.range(5).write.saveAsTable("spark_catalog.left.t2__old_1")
    assert tables.recover(spark, name)
    assert spark.table(name).count() == 12
    assert [row.tableName for row in spark.sql("SHOW TABLES IN left").collect()] == ["t", "t2__old_1"]
    spark.range(3).write.saveAsTable(f"{name}__old_00000000000000000099")
    assert not tables.recover(spark, name) and spark.table(name).count() == 12
    assert tables.leftovers(spark, name) == {"__old_": [], "__new_": []}


def test_the_number_of_partitions_is_the_tables_own(spark, settings):
    name = settings.table("dealt")
    frame = lambda *pairs: spark.createDataFrame(pairs, "k int, v int")
    assert parts.write_whole(frame(*((key, 0) for key in range(30)), (None, 0)), name, ["k"], 4) == 31
    assert parts.layout(spark, name) == (["k"], 4)
    jobs.record(spark, name, frame((3, 1), (None, 2), (99, 5)), ["k"], [F.desc("v")], partitions=7)
    assert parts.layout(spark, name) == (["k"], 4)
    held = spark.table(name)
    assert {row.k: row.v for row in held.collect()} == {**dict.fromkeys(range(30), 0), 3: 1, None: 2, 99: 5}
    assert held.where(parts.part_of(["k"], 4) != F.col("part")).isEmpty()
    # Dealt by other keys: it is dealt anew.
    parts.write_whole(held.drop("part"), name, ["v"], 2)
    assert parts.layout(spark, name) == (["v"], 2) and spark.table(name).count() == 32
    # The same layout is overwritten in place; partitions without rows go.
    assert parts.write_whole(frame((1, 1)), name, ["v"], 9) == 1 and parts.layout(spark, name)[1] == 2
    assert parts.layout(spark, settings.table("nothing")) is None


def test_records_touch_only_their_partitions(spark, settings):
    name = settings.table("ratings")
    first = spark.range(200).selectExpr("id AS user_id", "1 AS movie_id", "0 AS at")
    jobs.record(spark, name, first, ["user_id", "movie_id"], [F.desc("at")], partitions=16)
    before = set(spark.table(name).inputFiles())
    late = spark.createDataFrame([(5, 1, 9), (6, 1, -1)], "user_id long, movie_id int, at int")
    assert jobs.record(spark, name, late, ["user_id", "movie_id"], [F.desc("at")]) == 200
    moved = {int(path.split("part=")[1].split("/")[0]) for path in before ^ set(spark.table(name).inputFiles())}
    assert moved == {row.part for row in late.select(parts.part_of(["user_id", "movie_id"], 16)).distinct().collect()}
    assert rows(spark.table(name).where("at <> 0").drop("part")) == [(5, 1, 9)]


def test_an_undealt_table_is_dealt_by_the_first_record(spark, settings):
    name = settings.table("plain")
    tables.write_snapshot(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), name)
    assert jobs.record(spark, name, spark.createDataFrame([(2, 2), (3, 1)], "k int, v int"), ["k"], [F.desc("v")], 3) == 3
    assert parts.layout(spark, name) == (["k"], 3)
    assert tables.leftovers(spark, name) == {"__old_": [], "__new_": []}


def test_change_sets(spark):
    rng = random.Random(3)
    draw = lambda: spark.createDataFrame([(k, m, rng.choice([None, "a", "b", ""]), rng.choice([None, 1.5])) for k in (None, 1, 2, 3, 4) for m in "xy" if rng.random() < 0.7], "k int, m string, t string, w double")
    for _ in range(4):
        held, wanted = draw(), draw()
        found = changes.change_set(held, wanted, ["k", "m"])
        assert rows(changes.apply_changes(held, found, ["k", "m"])) == rows(wanted)
        kinds = {(row.k, row.m): row.change for row in found.collect()}
        old, new = ({(row.k, row.m): row for row in frame.collect()} for frame in (held, wanted))
        want = {key: "added" for key in new.keys() - old.keys()} | {key: "removed" for key in old.keys() - new.keys()}
        assert kinds == want | {key: "changed" for key in new.keys() & old.keys() if tuple(new[key]) != tuple(old[key])}
        stay = changes.change_set(held, wanted, ["k", "m"], deletes=False)
        assert stay.where("change = 'removed'").isEmpty()
        assert rows(changes.apply_changes(held, stay, ["k", "m"])) == rows(groups.upsert(held, wanted, ["k", "m"]))


def test_published_changes_are_all_that_is_sent(spark, monkeypatch):
    held = spark.range(100).selectExpr("id AS k", "'v' AS v")
    wanted = spark.range(1, 102).selectExpr("id AS k", "if(id = 5, 'w', 'v') AS v")
    sent = []
    monkeypatch.setattr(jobs.jdbc, "read_table", lambda *args: held)
    monkeypatch.setattr(jobs.jdbc, "write_table", lambda df, url, table, mode, options, connections: sent.append((rows(df), table, mode)))
    assert jobs.publish(spark, wanted, "jdbc:x", "serving", ["k"]) == {"added": 2, "changed": 1}
    assert sent == [([(5, "w", "changed"), (100, "v", "added"), (101, "v", "added")], "serving__changes", "append")]
    sent.clear()
    assert jobs.publish(spark, wanted, "jdbc:x", "serving", ["k"], deletes=True) == {"added": 2, "changed": 1, "removed": 1}
    assert sent[0][0][0] == (0, None, "removed")
    sent.clear()
    assert jobs.publish(spark, held, "jdbc:x", "serving", ["k"], deletes=True) == {} and not sent


def test_merge_statements_do_what_the_change_set_says(spark):
    import duckdb

    from docforge.sources import jdbc

    held = [(None, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 4)]
    wanted = [(None, "z", 1), (1, "b", 2), (3, "d", 5), (4, "e", None)]
    schema = "k int, t string, n int"
    found = changes.change_set(spark.createDataFrame(held, schema), spark.createDataFrame(wanted, schema), ["k"])
    db = duckdb.connect()
    db.execute("CREATE TABLE s (k INT, t VARCHAR, n INT)")
    db.execute('CREATE TABLE s__changes (k INT, t VARCHAR, n INT, "change" VARCHAR)')
    db.executemany("INSERT INTO s VALUES (?, ?, ?)", held)
    db.executemany("INSERT INTO s__changes VALUES (?, ?, ?, ?)", [tuple(row) for row in found.collect()])
    for statement in jdbc.merge_statements("s", ["k", "t", "n"], ["k"]):
        db.execute(statement)
    assert sorted(db.execute("FROM s").fetchall(), key=str) == sorted(wanted, key=str)
    assert db.execute("FROM s__changes").fetchall() == []


def test_remembered_results_follow_the_files(spark, tmp_path):
    made = []

    @tables.remembered
    def count(spark, folder):
        made.append(folder)
        return spark.read.parquet(folder).count()

    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    assert (count(spark, folder), count(spark, folder), len(made)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(folder)
    assert (count(spark, folder), len(made)) == (5, 2)


def test_payload_text_is_json(spark):
    assert json.loads(fetch.outcome(RecordedFetcher({1: {"a": 1}}), {"movie_id": 1})[0]) == {"a": 1}


# ---------------------------------------------------------------- drift, bitmaps


def test_a_row_for_each_planted_drift(spark):
    plain = payload(1, runtime=90, vote_average=7, genres=[{"id": 1, "name": "a"}], credits={"cast": [person(1), person(2)]})
    odd = payload(
        2, runtime="90", vote_average=7.5, budget=12, studio={"city": {"name": "x"}}, title=None, adult="yes",
        genres=[{"id": "1", "name": "a"}, {"id": 2, "name": None, "slug": "s"}, 7], credits={"cast": {"id": 1}},
    )
    found = drift.schema_drift(bronze(spark, [(1, plain), (2, odd), (3, "{bad"), (4, "[1]")], [(5, "error")]))
    told = {(row.path, row.finding): (row.expected, row.found, row.occurrences) for row in found.where("finding <> 'missing'").collect()}
    assert told == {
        ("$", "wrong type"): ("object", "array", 1),
        ("$[]", "unknown"): (None, "integer", 1),
        ("$.runtime", "wrong type"): ("integer", "string", 1),
        ("$.adult", "wrong type"): ("boolean", "string", 1),
        ("$.budget", "unknown"): (None, "integer", 1),
        ("$.studio", "unknown"): (None, "object", 1),
        ("$.genres[].id", "wrong type"): ("integer", "string", 1),
        ("$.genres[].slug", "unknown"): (None, "string", 1),
        ("$.genres[]", "wrong type"): ("object", "integer", 1),
        ("$.credits.cast", "wrong type"): ("array", "object", 1),
        ("$.credits.cast.id", "unknown"): (None, "integer", 1),
    }
    gone = {row.path: row.occurrences for row in found.where("finding = 'missing'").collect()}
    assert gone["$.tagline"] == 2 and gone["$.adult"] == 1 and "$.title" not in gone and "$.id" not in gone
    assert not any(path.startswith(("$.reviews.", "$.watch/providers.")) for path in gone)


def test_bitmaps_exclude_the_same_titles(spark):
    rng = random.Random(5)
    ids = [None, -70_000, -1, 0, 1, 2, 32_767, 32_768, 32_769, 65_536, 10**10]
    history = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(ids), rng.choice([None, True, False]), rng.choice([None, 1.0, 4.0])) for _ in range(60)]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    candidates = frame([(group, title, f"{group}{title}") for group in (None, 1, 2, 3) for title in ids] * 2, "group_id int, movie_id long, why string")
    members = frame([(1, 1), (1, 2), (1, 1), (2, 3), (2, None), (None, 4)], "group_id int, user_id int")
    seen = frame(history, "user_id int, movie_id long, watched boolean, rating double")
    got, want = (made(candidates, members, seen) for made in (groups.exclude_seen_by_bitmap, groups.exclude_seen))
    key = lambda row: str(row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.select(candidates.columns).collect()), key=key)


def test_bitmaps_send_a_row_for_each_member_and_bucket(spark):
    history = spark.range(20_000).selectExpr("id % 4 AS user_id", "id AS movie_id", "true AS watched", "5.0 AS rating")
    members = spark.createDataFrame([(1, user) for user in range(4)], "group_id int, user_id long")
    bitmaps = groups.seen_bitmaps(members, history)
    assert bitmaps.count() == 2 and "partial_bitmap_construct_agg" in plan(bitmaps)
