import re

import pytest
from pyspark.sql import functions as F

from isocline.sources import sinks, tables
from isocline.streaming import records


def test_csv_keeps_the_country_na(spark, tmp_path):
    p = tmp_path / "places.csv"
    p.write_text('label,country,admin1,lat,lon,pop,domain\n"Windhoek, Namibia",NA,,-22.5,17.1,300000,world\n')
    r = tables.places(spark, str(p)).first()
    assert (r.label, r.country, r.admin1, r["pop"]) == ("Windhoek, Namibia", "NA", None, 300000)


def test_gazetteer_without_quotes(spark, tmp_path):
    p = tmp_path / "g.txt"
    row = ["1", 'A "quoted', "A", "", "1.5", "2.5", "P", "PPL", "NA", "", "01", "", "", "", "5000", "", "", "UTC", "2020-01-01"]
    p.write_text("\t".join(row) + "\n" + "\t".join([*row[:6], "T", *row[7:]]) + "\n")
    out = tables.gazetteer(spark, str(p), 1000).collect()
    assert len(out) == 1 and out[0].name == 'A "quoted' and out[0].country_code == "NA"


def test_conformed_and_missing(spark):
    df = spark.createDataFrame([(["a", "b"], float("nan"), 1e20)], "recordedBy array<string>, decimalLatitude double, decimalLongitude double")
    r = tables.missing_to_null(tables.conformed(df, tables.OCCURRENCE)).first()
    assert (r.recordedby, r.decimallatitude, r.decimallongitude, r.license) == ("a|b", None, None, None)


def test_tiles_are_pruned(spark, tmp_path):
    path = str(tmp_path / "tiles")
    cells = spark.range(2000).select((F.col("id") * 2 % 4320).cast("int").alias("grid_row"), (F.col("id") * 4 % 8640).cast("int").alias("grid_col"))
    sinks.write_tiles(cells, path)
    box = tables.tiles(spark, path, (0, 900), (0, 1800))
    assert box.count() == cells.where("grid_row <= 900 and grid_col <= 1800").count()
    plan = box._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*tile", plan) and "GreaterThanOrEqual(grid_row,0)" in plan


def test_empty_write_raises_and_appends_refuse_duplicates(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(0), str(tmp_path / "x"))
    a, b = spark.createDataFrame([("x", 1)], "label string, v int"), spark.createDataFrame([("x", 2), ("y", 3), ("y", 3)], "label string, v int")
    assert sorted(map(tuple, sinks.appended(a, b, "label").collect())) == [("x", 1), ("y", 3)]
    assert sinks.manifest(a.unionByName(b), "label").count() == 2


def test_shards_hold_every_place_once(spark):
    p = spark.range(500).select(F.col("id").alias("place_id"), (F.col("id") % 3).alias("g"), (F.col("id") % 50 * 1.0).alias("lat"), (F.col("id") % 70 * 1.0).alias("lon"))
    s = sinks.sharded(p, "g", 40)
    assert sinks.misplaced(s, p, "g").count() == 0
    assert s.groupBy("g", "shard").count().agg(F.max("count")).first()[0] <= 40
    assert s.select("g", "shard", "slot").distinct().count() == 500


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-{1 + k % 9:02d} 00:00:00", 10.5 + k % 4, 20.25, None if k % 5 else 50_000.0, "NATIVE", 2000 + k % 3, k % 2, k // 2) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, t string, lat double, lon double, uncertainty double, established string, year int, dataset long, identity long").withColumn("ts", F.to_timestamp("t")).drop("t")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df.unionByName(df).coalesce(1).write.parquet(source)
    stream = records.clean_stream(spark.readStream.schema(df.schema).parquet(source), late="30 days")
    q = stream.writeStream.foreachBatch(records.merge_batch(sink)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.id for r in spark.read.parquet(sink).collect()}
    assert got == {r.id for r in df.where("uncertainty is null").collect()}
    assert records.cell_counts(stream).isStreaming
