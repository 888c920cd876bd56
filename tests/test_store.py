import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.store import FactStore, item_page

T = lambda d, h=0: dt.datetime(2024, 1, d, h)
SOURCE = ("p1", "r", None, None, None, T(1), None, "c")


def lit(ts):
    return F.lit(ts).cast("timestamp")


def rows(spark, dataset, *items):
    """Rows of a dataset from dicts; what is not named is null."""
    names = spark.createDataFrame([], schemas.SCHEMAS[dataset]).columns
    return spark.createDataFrame([tuple({"source": SOURCE, **i}.get(n) for n in names) for i in items], schemas.SCHEMAS[dataset])


def bar(bar_id, day, close, checksum, at, **more):
    return {"bar_id": bar_id, "instrument_id": "i1", "region": "CN", "interval": "1d", "adjustment": "raw", "bar_start": T(day, 1), "bar_end": T(day, 7), "trading_date": dt.date(2024, 1, day), "close": Decimal(close), "available_at": at, "source_checksum": checksum, **more}


@pytest.fixture
def store(spark, tmp_path):
    return FactStore(spark, f"file://{tmp_path}")


def test_bars_through_time(spark, store):
    for at, close, checksum in ((T(3), 10, "A"), (T(3), 10, "A"), (T(4), 11, "B"), (T(5), 10, "A")):
        store.upsert_bars(rows(spark, "bars", bar("b2", 2, close, checksum, at), bar("b1", 1, 9, "X", T(2))))
    assert store.table("bars").count() == 2 and store.table("bar_revisions").count() == 2
    read = lambda at: [float(r.close) for r in store.bars(["i1"], lit(T(1)), lit(T(9)), lit(at)).collect()]
    assert [read(T(d)) for d in (1, 2, 3, 4, 5)] == [[], [9.0], [9.0, 10.0], [9.0, 11.0], [9.0, 10.0]]
    assert [float(r["last"]) for r in store.snapshots(["i1"], lit(T(4))).collect()] == [11.0]
    with pytest.raises(ValueError, match="another bar_id"):
        store.upsert_bars(rows(spark, "bars", bar("other", 2, 1, "Z", T(6))))
    assert store.table("bars").count() == 2


def test_other_merges(spark, store):
    release = lambda c, at: {"release_id": "r", "region": "US", "scheduled_at": T(10), "available_at": at, "source_checksum": c}
    for c, d in (("A", 1), ("B", 2), ("A", 3), ("B", 4)):
        store.upsert_macro_releases(rows(spark, "macro_releases", release(c, T(d))))
    assert store.table("macro_releases").count() == 1 and [r.source_checksum for r in store.table("release_revisions").collect()] == ["B"]
    assert [r.source_checksum for r in store.macro_releases(lit(T(9)), lit(T(11)), lit(T(8))).collect()] == ["B"]
    seen = lambda i, v: {"observation_id": i, "series_id": "s", "region": "US", "period_end": dt.date(2024, 1, 1), "vintage_id": v, "available_at": T(2), "revision_no": 0}
    store.upsert_macro_observations(rows(spark, "macro_observations", seen("o1", "v1"), seen("o2", "v1")))
    store.upsert_macro_observations(rows(spark, "macro_observations", seen("o1", "v9"), seen("o3", "v1"), seen("o4", "v2")))
    assert sorted(r.observation_id for r in store.table("macro_observations").collect()) == ["o1", "o4"]
    for name in ("a", "b"):
        store.upsert_last("instruments", rows(spark, "instruments", {"instrument_id": "i1", "name": name, "region": "CN"}))
    assert [r.name for r in store.instruments(regions=["CN"]).collect()] == ["b"]


def test_context_is_repeatable_and_covers_all_cells(spark, store):
    store.upsert_bars(rows(spark, "bars", *[bar(f"b{d}", d, d, f"c{d}", T(d, 9)) for d in range(1, 6)]))
    news = [{"news_id": f"n{k}", "regions": ["CN", "HK"], "title": "t", "published_at": T(4, k), "available_at": T(4, k), "content_mode": "headline", "cluster_id": "c", "entities": [], "topics": []} for k in range(4)]
    store.insert_news(rows(spark, "news", *news))
    store.insert_news(rows(spark, "news", *news))
    ask = lambda: store.editor_context(["US", "CN", "HK"], lit(T(4, 12)), instruments=["i1"], metrics=["m"], series=["s"])
    one, two = ask(), ask()
    assert one["fingerprint"].first()[0] == two["fingerprint"].first()[0]
    cover = {(r.region, r.dataset): r.record_count for r in one["coverage"].collect()}
    assert len(cover) == 9 and cover["CN", "market"] == 4 and cover["CN", "news"] == cover["HK", "news"] == 2 and cover["US", "macro"] == 0
    for name in ("bars", "news", "snapshots"):
        assert one[name].where(F.col("available_at") > lit(T(4, 12))).count() == 0
    page = item_page(one["bars"], 2)
    assert len(page["items"]) == 2 and page["has_more"] and page["next_offset"] == 2


def test_a_page_rewrites_only_its_buckets(spark, store):
    """Appends add files to the buckets of a page's keys; in-place merges rewrite those alone; many files become one."""
    series = lambda *ids: rows(spark, "macro_series", *[{"series_id": i, "name": i, "region": "US"} for i in ids])
    store.upsert_last("macro_series", series(*[f"s{k}" for k in range(60)]))
    before = {(r.bucket, r.path) for r in store._files() if r.name == "macro_series"}
    store.upsert_last("macro_series", series("s1"))
    after = {(r.bucket, r.path) for r in store._files() if r.name == "macro_series"}
    assert len(before) > 8 and len(before - after) == len(after - before) == 1 and store.table("macro_series").count() == 60
    for k in range(11):
        store.upsert_macro_observations(rows(spark, "macro_observations", {"observation_id": f"o{k}", "series_id": "s", "period_end": dt.date(2024, 1, 1 + k), "vintage_id": "v", "available_at": T(2)}))
    files = [r for r in store._files() if r.name == "macro_observations"]
    assert len(files) <= 9 and store.table("macro_observations").count() == 11
    assert store.keyed("macro_observations", ["s"]).count() == 11 and len(store.keyed("macro_series", ["s1"]).inputFiles()) < 3


def test_missing_checksums_and_replays(spark, store):
    """A missing checksum is a value: it is noted once, and a change from or to it is a revision."""
    for checksum in (None, None, "A"):
        store.upsert_bars(rows(spark, "bars", bar("b", 2, 1, checksum, T(3 + (checksum is None)))))
    assert [r.source_checksum for r in store.table("bars").collect()] == [None]
    release = lambda c: rows(spark, "macro_releases", {"release_id": "r", "region": "US", "series_id": "s", "scheduled_at": T(10), "available_at": T(1), "source_checksum": c})
    for c in (None, "A", "A", None):
        store.upsert("macro_releases", release(c))
    assert store.table("macro_releases").count() == 1 and [r.source_checksum for r in store.table("release_revisions").collect()] == ["A"]
    assert store.table("macro_series").count() == 1  # derived from the release


def test_of_two_writers_one_gets_a_conflict(spark, store):
    from tidemark.manifest import Conflict

    news = lambda i: rows(spark, "news", {"news_id": i, "regions": ["CN"], "title": "t", "published_at": T(4), "available_at": T(4)})
    store.insert_news(news("a"))
    after, files, page, touched = store._page("news", news("b"))
    store.insert_news(news("c"))
    with pytest.raises(Conflict):
        store._commit(files, after, [("news", page, False)])
    assert sorted(r.news_id for r in store.table("news").collect()) == ["a", "c"]
