"""The catalog graph: children, descendants, links and scoped search over a `parent_ids` array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoledger.operators.fields import Fields, holds, negate
from geoledger.operators.paging import MAX_LIMIT, Page, SortKey, decode_bar_token, resolve_limit
from geoledger.operators.writes import delete_keys, upsert
from geoledger.plans.search import SearchOptions, SearchPage, SearchRequest, search
from geoledger.session import broadcast_if_small, materialised

_ROOTS = ("root",)


class OutOfScope(PermissionError):
    """None of the collections asked for lies under the catalog."""


def is_catalog() -> Column:
    return holds(F.col("type") == "Catalog")


def edges(resources: DataFrame) -> DataFrame:
    """(parent, id, catalog) per parent link."""
    return resources.select(F.explode("parent_ids").alias("parent"), "id", is_catalog().alias("catalog"))


def get_catalog(resources: DataFrame, catalog_id: str) -> DataFrame:
    """The catalog, or an error; a collection of that id is not found."""
    found = resources.filter((F.col("id") == catalog_id) & is_catalog()).limit(1)
    if found.isEmpty():
        raise LookupError(f"catalog {catalog_id} does not exist")
    return found


def descendant_collections(resources: DataFrame, catalog_id: str) -> DataFrame:
    """Ids of all collections under a catalog at any depth.

    Breadth first, one join per level. Every round's frontier is written to the shared folder, so the plan does not
    grow with the depth, and catalogs seen before are not entered again, so cycles end by themselves.
    """
    get_catalog(resources, catalog_id)
    spark = resources.sparkSession
    links = materialised(edges(resources))
    down = links.filter("catalog").select("parent", "id")
    visited = frontier = spark.createDataFrame([(catalog_id,)], "id string")
    for depth in count():
        step = (
            down.join(broadcast_if_small(frontier.withColumnRenamed("id", "parent")), "parent", "left_semi")
            .select("id")
            .distinct()
            .join(broadcast_if_small(visited), "id", "left_anti")
        )
        frontier = materialised(step)
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if depth % 10 == 9:
            visited = materialised(visited)
    leaves = links.filter(~F.col("catalog"))
    return leaves.join(
        broadcast_if_small(visited.withColumnRenamed("id", "parent")), "parent", "left_semi"
    ).select("id").distinct()


def scope(asked: Sequence[str], allowed: DataFrame) -> DataFrame:
    """Collections a scoped search may read: asked and allowed, or all allowed when none were asked for.

    Asking only for collections outside the catalog is an error.
    """
    if not asked:
        return allowed
    kept = allowed.filter(F.col("id").isin(list(asked)))
    if kept.isEmpty():
        raise OutOfScope("the collections asked for are outside the scope of this catalog")
    return kept


def scoped_items(items: DataFrame, resources: DataFrame, catalog_id: str, asked: Sequence[str] = ()) -> DataFrame:
    """Items of the catalog's collections. A broadcast scope also prunes the items' partitions at run time."""
    allowed = scope(asked, descendant_collections(resources, catalog_id))
    return items.join(broadcast_if_small(allowed.withColumnRenamed("id", "collection")), "collection", "left_semi")


def catalog_search(
    items: DataFrame, resources: DataFrame, catalog_id: str, request: SearchRequest,
    options: SearchOptions | None = None,
) -> SearchPage:
    """A search bounded to a catalog; an empty catalog gives an empty page."""
    inside = scoped_items(items, resources, catalog_id, request.collections)
    return search(inside, replace(request, collections=()), options)


# ---------------------------------------------------------------- direct children


def children(
    resources: DataFrame, catalog_id: str, kind: str | None = None, limit: int = MAX_LIMIT, token: str | None = None
) -> Page:
    """Direct children in id order, one page. `kind` is Catalog, Collection or neither."""
    rows = resources.filter(F.array_contains("parent_ids", catalog_id))
    if kind == "Catalog":
        rows = rows.filter(is_catalog())
    elif kind == "Collection":
        rows = rows.filter(negate(F.col("type") == "Catalog"))
    keys = [SortKey(Fields.of(resources).get("id"))]
    return Page(rows, keys, resolve_limit(limit), decode_bar_token(token, 1), bar_token=True)


def catalogs(resources: DataFrame, limit: int = MAX_LIMIT, token: str | None = None, descending: bool = False) -> Page:
    """All catalogs, sorted by id."""
    keys = [SortKey(Fields.of(resources).get("id"), descending)]
    return Page(resources.filter(is_catalog()), keys, resolve_limit(limit), decode_bar_token(token, 1), bar_token=True)


def member_items(
    items: DataFrame, resources: DataFrame, catalog_id: str, collection_id: str, request: SearchRequest | None = None,
    options: SearchOptions | None = None,
) -> SearchPage:
    """Items of one collection, which must be a direct child of the catalog."""
    member = resources.filter((F.col("id") == collection_id) & F.array_contains("parent_ids", catalog_id))
    if member.isEmpty():
        raise LookupError(f"collection {collection_id} does not belong to catalog {catalog_id}")
    return search(items, replace(request or SearchRequest(), collections=[collection_id]), options)


# ---------------------------------------------------------------- links and parents


def link(resources: DataFrame, resource_id: str, parent_id: str) -> DataFrame:
    """Add a parent once."""
    added = F.array_union(F.coalesce("parent_ids", F.array().cast("array<string>")), F.array(F.lit(parent_id)))
    return resources.withColumn("parent_ids", F.when(F.col("id") == resource_id, added).otherwise(F.col("parent_ids")))


def link_or_create(resources: DataFrame, new: DataFrame, parent_id: str) -> DataFrame:
    """Link the rows of `new` to a parent; rows not stored yet are created."""
    ids = broadcast_if_small(new.select("id", F.lit(True).alias("_linked")))
    added = F.array_union(F.coalesce("parent_ids", F.array().cast("array<string>")), F.array(F.lit(parent_id)))
    kept = resources.join(ids, "id", "left").withColumn(
        "parent_ids", F.when(F.col("_linked"), added).otherwise(F.col("parent_ids"))).drop("_linked")
    fresh = new.join(broadcast_if_small(resources.select("id")), "id", "left_anti").withColumn("parent_ids", added)
    return kept.unionByName(fresh, allowMissingColumns=True)


def unlink(resources: DataFrame, resource_id: str, parent_id: str) -> DataFrame:
    """Remove a parent; the resource itself stays."""
    left = F.array_remove("parent_ids", parent_id)
    return resources.withColumn("parent_ids", F.when(F.col("id") == resource_id, left).otherwise(F.col("parent_ids")))


def put_catalogs(resources: DataFrame, new: DataFrame) -> DataFrame:
    """Create catalogs or replace them; a replaced one keeps its parents."""
    parents = resources.select("id", F.col("parent_ids").alias("_old"))
    merged = new.join(broadcast_if_small(parents.join(broadcast_if_small(new.select("id")), "id", "left_semi")), "id", "left")
    own = F.col("parent_ids") if "parent_ids" in new.columns else F.lit(None).cast("array<string>")
    merged = merged.withColumns({"type": F.lit("Catalog"), "parent_ids": F.coalesce(F.col("_old"), own)}).drop("_old")
    return upsert(resources, merged, key=("id",))


def delete_catalog(resources: DataFrame, catalog_id: str) -> DataFrame:
    """Remove a catalog; its children keep their reference."""
    gone = resources.filter((F.col("id") == catalog_id) & is_catalog()).select("id")
    return delete_keys(resources, gone, key=("id",))


def ordered_parents(parent_ids: Column, context: str | None = None) -> Column:
    """Distinct parents, the one the resource was reached through first."""
    distinct = F.array_distinct(F.coalesce(parent_ids, F.array().cast("array<string>")))
    if context is None:
        return distinct
    front = F.array(F.lit(context))
    return F.when(F.array_contains(distinct, context), F.concat(front, F.array_except(distinct, front))).otherwise(distinct)


def parents(resources: DataFrame, context: str | None = None) -> DataFrame:
    """(id, position, parent, relation) of every resource: the first parent is `parent`, the others `related`.

    A collection reached without a catalog has the root as its parent and every catalog as related.
    """
    listed = ordered_parents(F.col("parent_ids"), context)
    rooted = F.concat(F.array(F.lit(_ROOTS[0])), F.filter(listed, lambda p: ~p.isin(*_ROOTS)))
    free = F.when(is_catalog(), F.size(listed) == 0).otherwise(F.lit(context is None))
    named = F.when(free, rooted).otherwise(listed)
    rows = resources.select("id", F.posexplode(named).alias("position", "parent"))
    return rows.withColumn("relation", F.when(F.col("position") == 0, "parent").otherwise("related"))
