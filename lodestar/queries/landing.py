"""Sources that land piece by piece: pages, tiles and their gaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Area
from ..plans.storage import shared_dir
from ..sources import tiles
from ..sources.paged import PagedSource, land_pages
from .registry import ANCHORS_SQL, HEIGHT, WIDTH, anchors, query, table


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def paged_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers landed as pages of 64 and read back by the source of pages, a task a page."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    land_pages(s, F.col("id") - (s.agg(F.min("id")).first()[0] or 0), 64, folder)
    spark.dataSource.register(PagedSource)
    return spark.read.format("lodestar-pages").option("path", folder).option("size", 64).schema("id long, name string, balance double").load()


#: Side of a tile in metres.
SIDE = 500.0


@query(f"""WITH {ANCHORS_SQL}, g AS (SELECT r, c, 'r' || r || 'c' || c AS tile FROM range({HEIGHT // 500}) a(r), range({WIDTH // 500}) b(c)), l AS (SELECT DISTINCT floor(y / 500)::BIGINT AS r, floor(x / 500)::BIGINT AS c FROM anchors)
SELECT tile, c * 500.0::DOUBLE AS west, r * 500.0::DOUBLE AS south, (c + 1) * 500.0::DOUBLE AS east, (r + 1) * 500.0::DOUBLE AS north FROM g ANTI JOIN l USING (r, c)""")
def tile_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of the map without any supplier on them."""
    expected = tiles.chunks(spark, Area(0.0, 0.0, float(WIDTH), float(HEIGHT), "EPSG:3310"), SIDE)
    at = anchors(spark, d)
    landed = at.select(F.concat(F.lit("r"), F.floor(F.col("y") / SIDE), F.lit("c"), F.floor(F.col("x") / SIDE)).alias("tile"))
    return tiles.gaps(expected, landed)
