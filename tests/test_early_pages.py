"""Pages over a dated store: equal to the full sort, and without a look at the days they don't need."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest

from geoledger.operators.fields import Fields
from geoledger.operators.paging import sort_keys
from geoledger.plans.newest import Day, EarlyPage, can_end_early, in_order, search_dated, stored_days
from geoledger.plans.search import SearchOptions, SearchRequest, search
from geoledger.sources.store import read_items, write_items


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """60 days of items in collections with odd names; every sixth has a range only, some have no time at all."""
    rows = []
    for n in range(360):
        at = datetime(2021, 1, 1, n % 24) + timedelta(days=n % 60)
        has = n % 6 != 0
        first = None if n % 90 == 0 else at if n % 6 in (0, 1) else None
        rows.append((f"i{n:03d}", ["a", "b c", "d%2F"][n % 3], at if has else None, first, first and first + timedelta(days=2), n % 10))
    rows += [("old", "a", datetime(1969, 12, 31, 5), None, None, 1), ("older", "a", datetime(1950, 1, 1), None, None, 1),
             ("late", "a", datetime(2150, 1, 1), None, None, 1), ("early start", "a", None, datetime(1960, 1, 1), datetime(2030, 1, 1), 1)]
    target = str(tmp_path_factory.mktemp("dated") / "items")
    write_items(spark.createDataFrame(
        rows, "id string, collection string, datetime timestamp_ntz, start_datetime timestamp_ntz, end_datetime timestamp_ntz, cloud int"),
        target, by_date=True)
    return target


def ids(page):
    return [r["id"] for r in page.rows.collect()]


@pytest.mark.parametrize("sortby, size", [((), 37), ((), 200), (("datetime",), 60), (("-datetime", "cloud"), 60), (("datetime", "start_datetime"), 60)])
def test_walked_pages_equal_the_full_sort(spark, path, sortby, size):
    items = read_items(spark, path)
    whole = ids(search(items, SearchRequest(sortby=sortby, limit=1000)))
    walked, token = [], None
    while True:
        page = search_dated(items, SearchRequest(sortby=sortby, limit=size, token=token))
        assert isinstance(page, EarlyPage)
        walked += ids(page)
        token = page.next_token()
        if token is None:
            break
    assert walked == whole and len(set(whole)) == len(whole) > 300


def test_pages_without_a_time_condition(spark, path):
    """Rows before the epoch, after every day and without any time keep their places."""
    items = read_items(spark, path)
    for sortby in (None, ["datetime"]):
        keys = sort_keys(Fields.of(items), sortby)
        got = ids(EarlyPage(items, keys, 1000, days=stored_days(items)))
        want = [r["id"] for r in items.orderBy(*[k.order for k in keys]).collect()]
        assert got == want and len(got) == 364


@pytest.mark.parametrize("request_", [
    SearchRequest(collections=["b c", "d%2F"], limit=50), SearchRequest(datetime="2021-01-10T00:00:00Z/2021-01-20T12:00:00Z", limit=30),
    SearchRequest(datetime="2021-02-10T00:00:00Z/..", limit=100), SearchRequest(filter={"op": "=", "args": [{"property": "cloud"}, 7]}, limit=100),
    SearchRequest(collections=["none"]), SearchRequest(datetime="2030-01-01T00:00:00Z"),
])
def test_conditions(spark, path, request_):
    items = read_items(spark, path)
    assert ids(search_dated(items, request_)) == ids(search(items, request_))


def test_only_the_newest_days_are_opened(spark, path, tmp_path):
    """With all other days spoiled, a first page is still found; a full sort is not."""
    import shutil

    copy = tmp_path / "items"
    shutil.copytree(path, copy)
    items = read_items(spark, str(copy))
    want = ids(search(items, SearchRequest(limit=12)))
    for file in Path(copy).rglob("*.parquet"):
        if not any(f"item_date={d}" in str(file) for d in ("2150-01-01", "2021-03-01", "2021-02-28")) or "has_datetime=false" in str(file):
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    page = search_dated(items, SearchRequest(limit=5))
    assert ids(page) == want[:5]
    assert {d.day for d in page.days_read} == {date(2150, 1, 1), date(2021, 3, 1)}
    with pytest.raises(Exception, match="(?i)parquet"):
        ids(search(items, SearchRequest(limit=5)))


def test_a_deep_page_starts_at_its_day(spark, path):
    items = read_items(spark, path)
    token = search(items, SearchRequest(limit=150)).next_token()
    page = search_dated(items, SearchRequest(limit=3, token=token))
    assert ids(page) == ids(search(items, SearchRequest(limit=3, token=token)))
    last = search(items, SearchRequest(limit=150)).rows.collect()[-1]["datetime"].date()
    assert max(d.day for d in page.days_read) == last and len(page.days_read) <= 2


def test_reads_grow(spark, path):
    items = read_items(spark, path)
    page = search_dated(items, SearchRequest(limit=1000))
    ids(page)
    assert sorted(page.days_read, key=str) == sorted(page.days, key=str)


def test_order_of_days():
    class Key:
        def __init__(self, path, descending, fill):
            self.field, self.descending, self.fill = type("F", (), {"path": path}), descending, fill

    epoch = "1970-01-01T00:00:00Z"
    newest = [Key("datetime", True, epoch), Key("start_datetime", True, epoch)]
    a, b, c, d, e = Day(True, date(2020, 1, 2)), Day(True, date(1960, 1, 1)), Day(False, date(2020, 1, 1)), Day(False, None), Day(False, date(1970, 1, 1))
    assert [s[1] for s in in_order([b, c, d, a], newest)] == [[a], [c], [d], [b]]
    assert [set(s[1]) for s in in_order([b, c, d, e, a], newest)] == [{a}, {c}, {d, e}, {b}]
    # a real datetime on the stand-in day: everything that may tie with it is one step
    tie = Day(True, date(1970, 1, 1))
    assert [set(s[1]) for s in in_order([a, c, d, tie], newest)] == [{a}, {c, d, tie}]


def test_other_orders_and_stores_are_searched_as_before(spark, path):
    items = read_items(spark, path)
    assert not isinstance(search_dated(items, SearchRequest(sortby=["cloud"])), EarlyPage)
    assert not isinstance(search_dated(items, SearchRequest(), SearchOptions(use_datetime=False)), EarlyPage)
    plain = items.drop("has_datetime", "item_date")
    assert not can_end_early(plain, sort_keys(Fields.of(plain), None))
    with pytest.raises(ValueError, match="dated store"):
        stored_days(spark.createDataFrame([(1,)], "id int"))
        stored_days(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
