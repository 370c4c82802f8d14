"""Catalogue queries: browsing, lookup, feeds, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinery.operators import catalog as C
from skeinery.plans import oracle as O
from skeinery.plans import stores

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _listing(name: str, where: str, order: str, limit: int, offset: int = 0, **options) -> None:
    QUERIES[name] = lambda spark, d: C.browse(stores.items(spark, d), limit=limit, offset=offset, **options)
    ORACLE[name] = f"WITH {O.ITEMS} SELECT {O.SUMMARY} FROM items WHERE fetched AND {where} ORDER BY {order} LIMIT {limit} OFFSET {offset}"


_listing("list_paged_name", "true", "lower(name) ASC, id", 100, 100, sort="name")
_listing("list_paged_size", "true", "total_size DESC NULLS LAST, id", 100, sort="size", descending=True)
_listing("list_paged_category", "true", "category DESC, lower(name) ASC, id", 100, 50, sort="cat", descending=True)
_listing("list_paged_null_sort", "true", "peer_count ASC NULLS FIRST, id", 200, sort="seed")
_listing("list_relevance", "true", "seen_count DESC, last_seen DESC, id", 100)
_listing("list_by_date", "true", "last_seen DESC, id", 100, sort="date", descending=True)
_listing("list_by_files", "true", "file_count DESC, id", 100, sort="files", descending=True)
_listing("top_by_seen", "true", "seen_count DESC, id", 100, sort="seen", descending=True)
_listing("recent", "true", "first_seen DESC, id", 100, sort="added", descending=True)
_listing("filter_alive", "peer_count > 0", "seen_count DESC, last_seen DESC, id", 500, keep=C.Filter(only_alive=True))
_listing("filter_visible", "category <> 'adult' AND NOT garbled", "seen_count DESC, last_seen DESC, id", 500, keep=C.Filter(hide_adult=True, hide_garbled=True))
_listing("filter_category", "category = 'video'", "total_size DESC, id", 300, sort="size", descending=True, keep=C.Filter(category=C.known_category("movies")))
_listing("filter_block_keywords", "NOT contains(lower(name), 'harbor') AND NOT contains(lower(name), 'x264')", "seen_count DESC, last_seen DESC, id", 500, keep=C.Filter(block=[" Harbor ", "X264", ""]))


def items(spark, d) -> DataFrame:
    return C.items(spark, d).drop("files")


QUERIES["items"] = items
ORACLE["items"] = f"WITH {O.ITEMS} SELECT * EXCLUDE (files) FROM items"


def get_with_files(spark, d) -> DataFrame:
    """Point lookups flattened: the record of the largest fetched item with its files in order."""
    first = C.top_by(stores.items(spark, d), "files", 1).first()
    found = C.lookup(spark, d, first["id"].upper())
    return found.select("id", "name", F.posexplode("files").alias("ord", "f")).select("id", "name", "ord", F.col("f.path").alias("path"), F.col("f.size").alias("size"))


QUERIES["get_with_files"] = get_with_files
ORACLE["get_with_files"] = f"""WITH {O.ITEMS}, one AS (SELECT * FROM items WHERE fetched ORDER BY file_count DESC, id LIMIT 1)
SELECT id, name, i - 1 AS ord, files[i].path AS path, files[i].size AS size FROM (SELECT *, unnest(range(1, len(files) + 1)) AS i FROM one)"""

QUERIES["files"] = lambda spark, d: C.files(spark, d)
ORACLE["files"] = f"WITH {O.RECORDS}, {O.FILES} SELECT id, ord, path, size FROM child"

QUERIES["largest_files"] = lambda spark, d: C.largest_files(C.files(spark, d), 3)
ORACLE["largest_files"] = f"WITH {O.RECORDS}, {O.FILES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, ord) AS rank FROM child) WHERE rank <= 3"

QUERIES["changes_since"] = lambda spark, d: C.changes_since(C.sequenced(C.items(spark, d)), 100, 250).select("seq", "id", "name", "first_seen")
ORACLE["changes_since"] = f"""WITH {O.ITEMS}, s AS (SELECT *, row_number() OVER (ORDER BY first_seen NULLS FIRST, id) AS seq FROM items)
SELECT seq, id, name, first_seen FROM s WHERE seq > 100 AND fetched ORDER BY seq LIMIT 250"""

QUERIES["oldest_checked"] = lambda spark, d: C.oldest_checked(stores.items(spark, d), 200)
ORACLE["oldest_checked"] = f"WITH {O.ITEMS} SELECT id, last_check FROM items WHERE fetched ORDER BY last_check ASC NULLS FIRST, id LIMIT 200"

QUERIES["vectors_page"] = lambda spark, d: C.table(spark, d, "torrent_embeddings").where("seq > 100").orderBy("seq").limit(200).select("seq", "id", "model_id", "dim")
ORACLE["vectors_page"] = "SELECT seq, id, model_id, dim FROM torrent_embeddings WHERE seq > 100 ORDER BY seq LIMIT 200"
