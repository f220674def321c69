"""The catalog graph and scoped search."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.operators import graph
from geoledger.plans.search import SearchRequest
from geoledger.sources import sample
from suite.registry import ANY_TIME, COLLECTIONS, case

DOWN = (
    "SELECT c.id FROM collections_v c JOIN collections_v n ON c.parent = n.id WHERE c.type = 'Collection' AND "
    "(n.parent = '{0}' OR n.id = '{0}')"
)
DESCENDANTS = DOWN.format("r3")


def resources(spark, sf_dir):
    return sample.collections(spark, sf_dir)


@case("cat_descendants", DESCENDANTS, views=COLLECTIONS)
def descendants(spark, sf_dir):
    return graph.descendant_collections(resources(spark, sf_dir), "r3")


@case("j_catalog_scope", f"SELECT id, collection FROM items_v WHERE collection IN ({DESCENDANTS})", views=COLLECTIONS)
def scope(spark, sf_dir):
    inside = graph.scoped_items(sample.items(spark, sf_dir), resources(spark, sf_dir), "r3")
    return inside.select("id", "collection")


@case(
    "set_scope_intersect",
    f"SELECT id FROM ({DESCENDANTS}) WHERE id IN ('c0', 'c1', 'c2', 'c3', 'c4', 'c5', 'c6', 'c7', 'c8', 'c77')", views=COLLECTIONS,
)
def scope_intersect(spark, sf_dir):
    allowed = graph.descendant_collections(resources(spark, sf_dir), "r3")
    return graph.scope([f"c{n}" for n in (0, 1, 2, 3, 4, 5, 6, 7, 8, 77)], allowed)


@case(
    "cat_search",
    f"SELECT id, collection, datetime FROM items_v WHERE collection IN ({DOWN.format('r0')}) AND {ANY_TIME} AND cloud_cover < 50 "
    "ORDER BY coalesce(datetime, TIMESTAMP '1970-01-01') DESC, coalesce(start_datetime, TIMESTAMP '1970-01-01') DESC, id DESC LIMIT 50",
    views=COLLECTIONS,
)
def catalog_search(spark, sf_dir):
    request = SearchRequest(query={"cloud_cover": {"lt": 50}}, limit=50)
    page = graph.catalog_search(sample.items(spark, sf_dir), resources(spark, sf_dir), "r0", request)
    return page.rows.select("id", "collection", "datetime")


@case("cat_children", "SELECT id, type FROM collections_v WHERE parent = 'r1' ORDER BY id LIMIT 2 OFFSET 2", views=COLLECTIONS)
def children(spark, sf_dir):
    rows = resources(spark, sf_dir)
    token = graph.children(rows, "r1", limit=2).next_token()
    return graph.children(rows, "r1", limit=2, token=token).rows.select("id", "type")


@case("cat_collections", "SELECT id, title FROM collections_v WHERE parent = 'n15' AND type <> 'Catalog'", views=COLLECTIONS)
def child_collections(spark, sf_dir):
    return graph.children(resources(spark, sf_dir), "n15", "Collection").rows.select("id", "title")


@case("cat_sub_catalogs", "SELECT id, title FROM collections_v WHERE parent = 'r4' AND type = 'Catalog'", views=COLLECTIONS)
def sub_catalogs(spark, sf_dir):
    return graph.children(resources(spark, sf_dir), "r4", "Catalog").rows.select("id", "title")


@case("cat_list", "SELECT id, title FROM collections_v WHERE type = 'Catalog' ORDER BY id DESC LIMIT 12", views=COLLECTIONS)
def list_catalogs(spark, sf_dir):
    return graph.catalogs(resources(spark, sf_dir), 12, descending=True).rows.select("id", "title")


@case("cat_get", "SELECT id, title FROM collections_v WHERE id = 'n7'", views=COLLECTIONS)
def get_catalog(spark, sf_dir):
    return graph.get_catalog(resources(spark, sf_dir), "n7").select("id", "title")


def links(df):
    return df.select("id", F.explode_outer("parent_ids").alias("parent"))


@case("cat_link", "SELECT id, parent FROM collections_v UNION ALL SELECT 'c4', 'n2'", views=COLLECTIONS)
def link(spark, sf_dir):
    once = graph.link(resources(spark, sf_dir), "c4", "n2")
    return links(graph.link(once, "c4", "n2"))


@case("cat_unlink", "SELECT id, CASE WHEN id <> 'n6' THEN parent END AS parent FROM collections_v", views=COLLECTIONS)
def unlink(spark, sf_dir):
    return links(graph.unlink(resources(spark, sf_dir), "n6", "r1"))


@case(
    "cat_link_or_create",
    "SELECT id, parent FROM collections_v UNION SELECT 'c' || c_custkey, 'n1' FROM customer",
    views=COLLECTIONS,
)
def link_or_create(spark, sf_dir):
    # some customers have the number of a supplier, the others are new
    new = sample.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Collection").alias("type"),
        F.col("c_name").alias("title"), F.lit(None).cast("array<string>").alias("parent_ids"))
    return links(graph.link_or_create(resources(spark, sf_dir), new, "n1"))


@case(
    "cat_create",
    "SELECT id, type, title, parent FROM collections_v UNION ALL SELECT 'o' || o_custkey, 'Catalog', 'orders', 'r0' FROM orders GROUP BY o_custkey",
    views=COLLECTIONS,
)
def create_catalogs(spark, sf_dir):
    new = sample.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("id")).distinct().select(
        "id", F.lit("orders").alias("title"), F.array(F.lit("r0")).alias("parent_ids"))
    made = graph.put_catalogs(resources(spark, sf_dir), new)
    return made.select("id", "type", "title", F.explode_outer("parent_ids").alias("parent"))


@case(
    "cat_update",
    "SELECT id, type, CASE WHEN id IN ('n3', 'r2') THEN 'renamed ' || id ELSE title END AS title, parent FROM collections_v",
    views=COLLECTIONS,
)
def update_catalogs(spark, sf_dir):
    rows = resources(spark, sf_dir)
    new = rows.filter(F.col("id").isin("n3", "r2")).select("id", F.concat(F.lit("renamed "), "id").alias("title"))
    changed = graph.put_catalogs(rows, new)
    return changed.select("id", "type", "title", F.explode_outer("parent_ids").alias("parent"))


@case("cat_delete", "SELECT id, parent FROM collections_v WHERE id <> 'n19'", views=COLLECTIONS)
def delete_catalog(spark, sf_dir):
    return links(graph.delete_catalog(resources(spark, sf_dir), "n19"))


@case(
    "cat_items",
    f"SELECT id, collection FROM items_v WHERE collection = 'c0' AND {ANY_TIME} ORDER BY coalesce(datetime, TIMESTAMP '1970-01-01') DESC, "
    "coalesce(start_datetime, TIMESTAMP '1970-01-01') DESC, id DESC LIMIT 25",
)
def member_items(spark, sf_dir):
    # the nations of the suppliers differ from scale to scale, so the link is made first
    linked = graph.link(resources(spark, sf_dir), "c0", "n15")
    page = graph.member_items(sample.items(spark, sf_dir), linked, "n15", "c0", SearchRequest(limit=25))
    return page.rows.select("id", "collection")


@case(
    "cat_parents",
    "SELECT id, 0 AS position, CASE WHEN type = 'Collection' OR parent IS NULL THEN 'root' ELSE parent END AS parent, 'parent' AS relation FROM collections_v "
    "UNION ALL SELECT id, 1, parent, 'related' FROM collections_v WHERE type = 'Collection'",
    views=COLLECTIONS,
)
def parents(spark, sf_dir):
    return graph.parents(resources(spark, sf_dir))
