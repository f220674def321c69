"""Requests answered from the summaries of a store: fields, values, words and counts without a scan of the items.

Every answer equals that of the scan, also after writes, deletions and writes that were cut off: partitions whose
summaries are not valid are read themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.functions.times import parse_interval
from geoledger.operators.aggregate import few_values
from geoledger.operators.discovery import described_paths, listed_values
from geoledger.operators.fields import Fields
from geoledger.operators.text import ANALYSED, ITEM_TEXT_FIELDS, by_free_text, near_any, query_words_of
from geoledger.plans.search import SearchOptions, SearchRequest, filter_items
from geoledger.session import materialised
from geoledger.sources.store import DATED, SIMPLE, read_items, within
from geoledger.sources.summaries import COUNT, FIELD, VALUE, WORD, latest, summarised, what_of

# Words near the query up to which rows are compared with a list of them; beyond, with the query itself.
MOST_WORDS = 1000


class StoreSummary:
    """The summaries of a table, as of the moment they are first read."""

    def __init__(self, spark: SparkSession, path: str):
        what = what_of(spark, path)
        if what is None:
            raise ValueError(f"the table has no summaries: {path}")
        self.what = what
        self.spark, self.path = spark, path
        self.items = read_items(spark, path)
        self.keys = DATED if "item_date" in self.items.columns else SIMPLE

    @cached_property
    def _latest(self) -> tuple[DataFrame, DataFrame]:
        """States and details of all partitions; those that are open are summarised here."""
        state, details = latest(self.spark, self.path, self.keys)
        opened = materialised(state.filter("rows IS NULL").select(*self.keys))
        if opened.isEmpty():
            return state.filter("rows > 0"), details
        now, read = summarised(within(self.items, opened, self.keys), self.keys, self.what)
        return state.filter("rows > 0").unionByName(now), details.unionByName(read)

    @property
    def partitions(self) -> DataFrame:
        """Every collection of every partition, with the number of its rows there and of those shown."""
        return self._details(COUNT).select("collection", *self.keys, "rows", "shown")

    def _details(self, kind: str, collections: Sequence[str] = ()) -> DataFrame:
        found = self._latest[1].filter(F.col("kind") == kind)
        return found.filter(F.col("collection").isin(list(collections))) if collections else found

    def queryables(self, collections: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
        """`discovery.queryables` of the items."""
        seen = self._details(FIELD, collections).select("collection", F.col("name").alias("path"))
        return described_paths(seen, self.items.schema, exclude)

    def enum_values(self, collections: Sequence[str] = ()) -> DataFrame:
        """`discovery.enum_values` of the listed fields; lists show their elements."""
        values = self._details(VALUE, collections).select("collection", "name", "value")
        return listed_values(values.distinct(), self.what.limit)

    def unique_values(self, collections: Sequence[str] = ()) -> DataFrame:
        """`aggregate.unique_values` of the listed fields."""
        values = self._details(VALUE, collections).select(F.col("name").alias("field"), "value")
        return few_values(values.distinct(), self.what.limit)

    def free_text(
        self, q: str | Sequence[str], names: Sequence[str] = ITEM_TEXT_FIELDS, collections: Sequence[str] = (), most_words: int = MOST_WORDS
    ) -> DataFrame:
        """The items of `by_free_text`, with typos.

        Edit distances are computed once per word of the vocabulary, and rows are compared with the words found. Where all
        names are texts whose words are summarised, only partitions that hold such a word are read. Texts without a
        vocabulary, and queries with more than `most_words` near words, are compared as in a plain search.
        """
        items = self.items.filter(F.col("collection").isin(list(collections))) if collections else self.items
        fields = Fields.of(items)
        query = query_words_of(q)
        paths = {n.split("^")[0] for n in names}
        texts = {p for p in paths if p.rsplit(".", 1)[-1] in ANALYSED and fields.get(p) is not None}
        covered = texts & set(self.what.words)
        if not query or not covered:
            return items.filter(by_free_text(fields, q, names))
        hits = self._details(WORD, collections).filter(F.col("name").isin(sorted(covered)))
        near = hits.select("value").distinct().filter(near_any(F.col("value"), query))
        hits = materialised(hits.join(near, "value", "left_semi"))
        found = hits.select("name", "value").distinct().limit(most_words + 1).collect()
        if len(found) > most_words:
            return items.filter(by_free_text(fields, q, names))
        known = {p: sorted(r["value"] for r in found if r["name"] == p) for p in covered}
        if all(p in covered or fields.get(p) is None for p in paths):
            items = within(items, materialised(hits.select(*self.keys).distinct()), self.keys)
        return items.filter(by_free_text(fields, q, names, known=known))

    def matched(self, request: SearchRequest, options: SearchOptions | None = None) -> int:
        """Items on all pages of a search."""
        return self.number_matched(request, options).first()["matched"]

    def number_matched(self, request: SearchRequest, options: SearchOptions | None = None) -> DataFrame:
        """One row (matched): the items on all pages of a search.

        Over a dated store, partitions of rows with a datetime whose whole day lies in the asked-for time count by their
        summaries. Only the first and last day, and rows without a datetime, are read. Requests with other conditions
        than collections and time are counted from the items.
        """
        options = options or SearchOptions()
        other = request.ids or request.bbox or request.intersects or request.query or request.filter or request.q
        hidden = options.hide_path not in (None, self.what.hide_path)
        number = F.count(F.lit(1)).alias("matched")
        if other or hidden or self.keys != DATED or not options.use_datetime:
            return filter_items(self.items, request, options).agg(number)
        low, high = (F.lit(t).cast("date") for t in parse_interval(request.datetime, options.nanos))
        whole = F.col("has_datetime") & (F.col("item_date") > low) & (F.col("item_date") < high)
        inside = self.partitions.filter(whole)
        if request.collections:
            inside = inside.filter(F.col("collection").isin(list(request.collections)))
        counted = inside.agg(F.sum("shown" if options.hide_path else "rows").alias("matched"))
        read = filter_items(self.items.filter(~F.coalesce(whole, F.lit(False))), request, options).agg(number)
        return counted.union(read).agg(F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"))
