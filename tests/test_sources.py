from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from saleroom import schemas
from saleroom.operators import listings, quality
from saleroom.session import configure, ensure_checkpoint_dir, shared_folder
from saleroom.sources import sinks, tables
from saleroom.sources.snapshots import SnapshotStore, empty_table
from saleroom.sources.views import VIEWS, names_in, with_views
from tests.conftest import tuples


def test_all_tables_have_readable_schemas(spark, tmp_path):
    for name in schemas.TABLES:
        path = str(tmp_path / name)
        empty_table(spark, name).write.parquet(path)
        back = tables.read_table(spark, path, name)
        assert back.columns == empty_table(spark, name).columns
        assert tables.read_stream(spark, path, name).isStreaming
    assert len(schemas.TABLES) == 13
    assert set(schemas.DEFAULTS) == set(schemas.TABLES)


def test_snapshots_publish_all_tables_together(spark, frame, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "db"))
    assert store.versions() == [] and store.tables() == []
    a = frame("id BIGINT, v STRING", (1, "one"))
    store.commit({"a": a, "b": a})
    # the next version of a table may be computed from the table itself
    store.commit({"a": store.read("a").withColumn("v", F.lit("two"))})
    assert store.versions() == [1, 2]
    assert {t: len(f) for t, f in store.manifest().items()} == {"a": 1, "b": 1}
    assert tuples(store.read("a"), "v") == [("two",)]
    assert tuples(store.read("a", 1), "v") == [("one",)]
    # added rows go into a folder of their own
    store.commit(append={"b": frame("id BIGINT, v STRING", (2, "more"))})
    assert {t: len(f) for t, f in store.manifest().items()} == {"a": 1, "b": 2}
    assert tuples(store.read("b"), "v") == [("more",), ("one",)]
    with pytest.raises(ValueError):
        store.commit({"a": a}, {"a": a})


def test_an_unfinished_change_is_invisible(spark, frame, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "db"))
    good = frame("id BIGINT", (1,))
    store.commit({"a": good})
    bad = good.select(F.raise_error(F.lit("boom")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        store.commit({"a": good, "b": bad})
    assert store.versions() == [1] and store.tables() == ["a"]


def test_a_version_is_published_once(spark, frame, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "db"))
    store.commit({"a": frame("id BIGINT", (1,))})
    with pytest.raises(RuntimeError):
        store._publish(1, "{}")


def test_inventory_csv(spark, frame, tmp_path):
    posts = frame(
        "id BIGINT, title STRING, description STRING, image_url STRING, category STRING, price STRING, author_id BIGINT, created_at TIMESTAMP_NTZ",
        (1, 'say "hi"', "d", None, "c", "1", 1, "2024-03-04 10:00:00"), (2, "b", "d", "u", "c", "2", 1, "2024-03-05 10:00:00"),
        (3, "other", "d", "u", "c", "2", 2, "2024-03-05 10:00:00"),
    )
    path = tmp_path / "csv"
    sinks.write_inventory_csv(listings.inventory_export(posts, 1), str(path), single_file=True)
    [part] = path.glob("part-*.csv")
    assert part.read_text().splitlines() == [
        '"created_at","title","description","image_url","category","price"',
        '"03/05/2024","b","d","u","c","2"',
        '"03/04/2024","say ""hi""","d","","c","1"',
    ]


def test_error_log_appends(spark, tmp_path):
    path = str(tmp_path / "errors")
    for i in range(5):
        sinks.log_error(spark, path, f"e{i}", "sweep", f"2024-01-0{i + 1} 00:00:00", i)
    newest = quality.recent_errors(sinks.read_errors(spark, path), 3)
    assert [r.error for r in newest.collect()] == ["e4", "e3", "e2"]


def test_json_lines(spark, frame, tmp_path):
    sinks.write_json(frame("id BIGINT, json STRING", (1, '{"a":1}')), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).first()[0] == '{"a":1}'


def test_views_are_inlined_in_dependency_order():
    sql = with_views("SELECT * FROM v_results")
    order = [sql.index(f"{name} AS (") for name in ("v_auctions", "v_bids", "v_results")]
    assert order[2] > max(order[:2])
    assert with_views("SELECT 1 AS x") == "SELECT 1 AS x"
    assert names_in(VIEWS["v_profiles"]) == ["customer", "nation"]


def test_session_settings(spark):
    configure(spark)
    assert spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS t").dtypes == [("t", "timestamp_ntz")]
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == shared_folder(spark)
