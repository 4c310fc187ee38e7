"""Files written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, raster, reports
from tessera.sources import files, sinks


def test_points(spark, tmp_path):
    pts = spark.createDataFrame([(i, i / 3, -i * 1e-9) for i in range(50)], "id bigint, x0 double, x1 double")
    sinks.points_csv(pts.coalesce(1), ["x0", "x1"], f"{tmp_path}/p")
    back = files.csv_points(spark, f"{tmp_path}/p", 2).orderBy("id").collect()
    assert [(r.id, r.x0, pytest.approx(r.x1)) for r in back] == [(r.id, r.x0, pytest.approx(r.x1)) for r in pts.collect()]
    found = cluster.Clustering((7, 3), 1.0, 1)
    sinks.medoids_csv(cluster.medoid_rows(pts, ["x0", "x1"], found), ["x0", "x1"], f"{tmp_path}/m")
    assert [r.x0 for r in files.csv_points(spark, f"{tmp_path}/m", 2).orderBy("id").collect()] == [7 / 3, 1.0]
    (tmp_path / "bad.csv").write_text("1,2\n3,x\n")
    with pytest.raises(Exception, match="(?i)malformed|cast|parse"):
        files.csv_points(spark, f"{tmp_path}/bad.csv", 2).collect()


def test_points_in_many_splits(spark, tmp_path):
    """Files of unequal sizes, cut into several splits each: places follow the files' order all the same."""
    (tmp_path / "p").mkdir()
    n = 0
    for k, size in enumerate((10, 5000, 0, 900)):
        (tmp_path / "p" / f"part-{k}.csv").write_text("".join(f"{n + i}.5\n" for i in range(size)))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.csv_points(spark, f"{tmp_path}/p", 1).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.id, r.x0) for r in rows) == [(i, i + 0.5) for i in range(n)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.table_csv(df, f"{tmp_path}/t")
    assert sorted(files.csv_table(spark, f"{tmp_path}/t").collect()) == sorted(df.collect())
    sinks.records_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=4))
    assert files.records_json(spark, f"{tmp_path}/list.json").agg(F.sum("a").alias("s")).first().s == 3


def test_measurements(spark, tmp_path):
    obj = {
        "inputLengthInCharacters": 8, "uniformInput": True, "useMappingLetter": False,
        "measurements": {"histogram_fast": {"timesTransferToDevice": [1.0, 2.0], "timesExecution": [0.5, 0.25], "timesTransferFromDevice": [0.0, 1.0], "bins": [8, 0]}},
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "117.json").write_text(json.dumps(obj))
    (tmp_path / "in" / "skip.txt").write_text("no")
    rows = files.measurement_json(spark, f"{tmp_path}/in")
    got = reports.flatten_measurements(rows.withColumn("device", F.lit("gpu"))).orderBy("run").collect()
    assert [(r.source_key, r.device, r.kernel, r.run, r.time_total, r.input_file_name) for r in got] == [("117", "gpu", "fast", 1, 1.5, None), ("117", "gpu", "fast", 2, 3.25, None)]
    sinks.measurement_json(rows.drop("source_key"), f"{tmp_path}/out")
    assert json.loads(next((tmp_path / "out").glob("part-*")).read_text())["measurements"] == obj["measurements"]


def test_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head\n 10.0 1,000 2 500.0 500.0 400 600 10.0 Blur(x, y)\nTRACE: COST 7.5\n")
    (tmp_path / "b.txt").write_text("TRACE: COST 1\nTRACE: COST 2\n")
    lines = files.report_lines(spark, str(tmp_path))
    rows = reports.parse_rows(reports.first_lines(lines, {"blur": "Blur"}), "path").collect()
    assert [(r.total, r.instances, r.name) for r in rows] == [(1.0, 2.0, "Blur(x, y)")]
    assert reports.traces(lines.filter("path like '%a.txt'"), "COST").first().value == 7.5
    with pytest.raises(Exception, match="exactly once"):
        reports.traces(lines, "COST").collect()
    sinks.report_text(lines.filter("path like '%a.txt'").coalesce(1), "line", f"{tmp_path}/t")
    assert files.whole_texts(spark, str(tmp_path), ".txt").count() == 2


def test_images(spark, tmp_path):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(8, 4, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(4):
        for x in range(8):
            image.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(f"{tmp_path}/one.jpg"))
    decoded = files.images(spark, str(tmp_path))
    px = files.pixels(decoded)
    assert px.count() == 8 * 4 * 3
    means = {r.c: r.p for r in px.groupBy("c").agg(F.avg("p").alias("p")).collect()}
    assert all(abs(means[c] - v) < 3 for c, v in enumerate((200, 100, 50)))
    size = raster.catalogue(px).first()
    assert (size.img, size.width, size.height, size.channels, size.pixels) == ("one", 8, 4, 3, 32)
    sinks.pixels_parquet(raster.grayscale(px), f"{tmp_path}/gray")
    assert {r.p for r in spark.read.parquet(f"{tmp_path}/gray").select("p").distinct().collect()} <= set(range(119, 128))
