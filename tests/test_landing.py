"""Paged sources and tiles: parallel reads, short pages, restarts, gaps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestar.model import Area
from lodestar.sources import tiles
from lodestar.sources.paged import Page, PagedReader, PagedSource, PagedStreamReader, land_pages

KIND = "id long, name string, v double"


def page(folder, k, ids):
    os.makedirs(f"{folder}/page={k}", exist_ok=True)
    with open(f"{folder}/page={k}/part-0.json", "w") as f:
        f.writelines(json.dumps({"id": i, "name": f"n{i}", "v": i / 2} if i % 3 else {"id": i}) + "\n" for i in ids)


def test_batch_reads_pages_side_by_side(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    folder = str(tmp_path / "a")
    df = spark.range(23).select("id", F.format_string("n%d", "id").alias("name"), (F.col("id") / 2).alias("v"))
    land_pages(df, F.col("id"), 5, folder)
    read = lambda where: spark.read.format("lodestar-pages").option("path", where).option("size", 5).schema(KIND).load()
    got = read(folder)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(got.collect()) == sorted(df.collect())
    os.rename(f"{folder}/page=3", f"{folder}/later")  # a hole ends the pages, as a service would
    assert read(folder).count() == 15
    page(folder, 3, [15, 16])  # so does a short page, whatever lies behind it
    assert sorted(r.id for r in read(folder).collect()) == list(range(17))
    assert read(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="path and size"):
        spark.read.format("lodestar-pages").option("path", folder).schema(KIND).load().count()


def test_stream_restarts_without_repeats(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    page(folder, 0, range(4))
    page(folder, 1, [4, 5])

    def run():
        s = spark.readStream.format("lodestar-pages").option("path", folder).option("size", 4).schema(KIND).load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(once=True).start().awaitTermination(120)
        return sorted(r.id for r in spark.read.schema(KIND).parquet(out).collect())

    assert run() == list(range(6))
    assert run() == list(range(6))
    page(folder, 1, range(4, 8))  # the short page has filled up, another has come
    page(folder, 2, [8])
    assert run() == list(range(9))
    odd = {r.id: (r.name, r.v) for r in spark.read.schema(KIND).parquet(out).collect()}
    assert odd[3] == (None, None) and odd[4] == ("n4", 2.0)


def test_offsets(tmp_path):
    from pyspark.sql.types import StructType

    page(tmp_path, 0, range(3))
    page(tmp_path, 1, [3])
    options, schema = {"path": str(tmp_path), "size": "3"}, StructType().add("id", "long")
    reader = PagedStreamReader(options, schema)
    assert reader.latestOffset() == {"page": 1, "records": 1}
    parts = reader.partitions({"page": 0, "records": 2}, {"page": 1, "records": 1})
    assert [(p.page, p.first, p.last) for p in parts] == [(0, 2, None), (1, 0, 1)]
    assert [r for p in parts for r in reader.read(p)] == [(2,), (3,)]
    assert reader.partitions({"page": 1, "records": 1}, {"page": 1, "records": 1}) == []
    assert list(PagedReader(options, schema).read(Page(7))) == []


def test_tile_names_and_chunks(spark):
    names = lambda *box: sorted(r.tile for r in tiles.degree_tiles(spark, Area(*box)).collect())
    assert names(-120.9, 39.1, -120.2, 39.8) == ["n40w121"]
    assert names(-121.0, 39.0, -120.0, 40.0) == ["n40w121"]
    assert names(-121.5, 38.5, -119.5, 39.5) == [f"n{n}w{w}" for n in (39, 40) for w in (120, 121, 122)]
    got = tiles.chunks(spark, Area(0, 0, 1.0, 0.5), 0.3).collect()
    assert len(got) == 8 and got[5].tile == "r1c1" and abs(got[5].west - 0.25) < 1e-12 and got[7].north == 0.5


def test_a_rerun_lands_only_the_gaps(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "land")
    expected = tiles.chunks(spark, Area(0, 0, 4, 3), 1.0)
    bad = str(tmp_path / "down")
    open(bad, "w").close()

    def fetch(tile):
        with open(log, "a") as f:
            f.write(tile["tile"] + "\n")
        if os.path.exists(bad) and tile["tile"] in ("r0c1", "r2c3"):
            raise OSError("no answer")
        at = int(tile["tile"][3:])
        return [(int(tile["tile"][1]), at, float(at)), (0, 99, None if at == 1 else float(at))]

    state = {r.tile: r for r in tiles.land(expected, folder, fetch, attempts=2, partitions=3).collect()}
    assert len(state) == 12 and sorted(t for t, r in state.items() if not r.landed) == ["r0c1", "r2c3"]
    assert state["r0c1"].attempts == 2 and "no answer" in state["r0c1"].error
    tried = open(log).read().split()
    assert len(tried) == 10 + 2 * 2
    assert sorted(r.tile for r in tiles.gaps(expected, tiles.landed_cells(spark, folder)).collect()) == ["r0c1", "r2c3"]
    # a run that died after its cells and before its state is as if it hadn't been
    spark.createDataFrame([("r0c1", 0, 1, -5.0)], "tile string, row long, col long, value double").selectExpr("*", "cast(null as int) as attempts", "cast(null as string) as error").write.parquet(f"{folder}/cells/run=dead")
    os.remove(bad)
    state = tiles.land(expected, folder, fetch, attempts=2, partitions=3)
    assert state.where("not landed").count() == 0 and sorted(open(log).read().split()[len(tried) :]) == ["r0c1", "r2c3"]
    assert len(open(log).read().split()) == len(tried) + 2
    assert tiles.land(expected, folder, fetch).count() == 12 and len(open(log).read().split()) == len(tried) + 2
    cells = tiles.landed_cells(spark, folder)
    assert cells.count() == 24 and cells.where("value < 0").count() == 0
    m = {(r.row, r.col): r.value for r in tiles.mosaic(cells).collect()}
    assert m[0, 99] == 0.0 and m[2, 3] == 3.0
    assert tiles.coverage(expected, cells).first().asDict() == {"expected": 12, "landed": 12, "missing": 0}
