import datetime as dt
import json

from pyspark.sql import functions as F

from roadpulse.operators import matching, places
from roadpulse.sources import files
from roadpulse.streaming import streams


def test_fix_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1;7;2019-02-01 00:00:00;37.5;15.0;50;90;1;1;0;1;1000\n2;7;2019-02-01 00:01:00;37.6;15.1;60;90;1;0;0;1;2000\n")
    df = files.read_fixes(spark, str(tmp_path / "a.csv"))
    assert df.count() == 2 and dict(df.dtypes)["timedate"] == "timestamp_ntz" and df.first().progressive == 1000
    (tmp_path / "b.csv").write_text("1,7,2019-02-01 00:00:00,37.5,15.0,50,90,1,1,1,1000\nbroken,row\n")
    old = files.read_fixes_legacy(spark, str(tmp_path / "b.csv"))
    assert old.count() == 1 and old.first().idterm == 7 and "progressive" in old.columns


def test_other_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;2\n")
    (tmp_path / "y.csv").write_text("b;a\n4;3\n")
    assert {(r.a, r.b) for r in files.read_many(spark, [str(tmp_path / "x.csv"), str(tmp_path / "y.csv")]).collect()} == {("1", "2"), ("3", "4")}
    (tmp_path / "r.csv").write_bytes("idterm;devicetype;idvehcategory;brand;anno;portata;gender;age\n1;d;c;Citroën;2010;;M;30\n".encode("latin-1"))
    row = files.read_registry(spark, str(tmp_path / "r.csv")).first()
    assert row.brand == "Citroën" and row.portata is None and row.anno == 2010
    (tmp_path / "s.csv").write_text("pre\namble\nData Ora;Corsia;Classe!;more\n21/02/2019 10:15:00;1;2;x\n21/02/2019 10:16:00; 2;3;x\n")
    sensor = files.read_sensor_counts(spark, str(tmp_path / "s.csv"), skip=2, columns=3)
    assert sensor.columns == ["timedate", "corsia", "classe"] and sensor.count() == 2 and sensor.first().timedate == dt.datetime(2019, 2, 21, 10, 15)


def test_geojson_and_wkb(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"u": 1}, "geometry": {"type": "LineString", "coordinates": [[15.0, 37.5], [15.1, 37.6]]}}]}
    (tmp_path / "g.json").write_text(json.dumps(collection))
    df = files.read_geojson(spark, str(tmp_path / "g.json"), "u: long")
    assert df.first().u == 1 and df.first().coordinates == [[15.0, 37.5], [15.1, 37.6]]
    (tmp_path / "h.json").write_text(json.dumps(collection, indent=1))
    assert files.read_geojson(spark, str(tmp_path / "h.json"), "u: long").collect() == df.collect()
    many = spark.range(50).select(F.col("id").alias("u"), F.lit("Point").alias("geometry_type"), F.array(F.array(F.col("id") * 0.5, F.lit(37.5))).alias("coordinates"))
    files.write_geojson(many.coalesce(1), str(tmp_path / "out"), ["u"])
    assert sorted(files.read_geojson(spark, str(tmp_path / "out"), "u: long").collect()) == sorted(many.collect())
    lines = spark.createDataFrame([([(1.0, 2.0)],), ([(1.0, 2.0), (3.0, 4.0)],), (None,)], "p array<struct<x double, y double>>")
    again = lines.select("p", files.wkb_hex_to_points(files.points_to_wkb_hex("p")).alias("q")).collect()
    assert all(r.p == r.q for r in again)
    files.write_table(df, str(tmp_path / "t"), ["u"])
    files.write_table(df, str(tmp_path / "t"), ["u"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_streams(spark, tmp_path):
    start = dt.datetime(2019, 2, 1)
    rows = [(1, 2, start + dt.timedelta(minutes=m)) for m in (0, 5, 16, 300)]
    spark.createDataFrame(rows, "u long, v long, timedate timestamp_ntz").write.parquet(str(tmp_path / "trav"))
    source = spark.readStream.schema("u long, v long, timedate timestamp_ntz").parquet(str(tmp_path / "trav"))
    q = streams.stream_flux_15min(source).writeStream.format("memory").queryName("flux").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.flux for r in spark.table("flux").collect())[:2] == [4.0, 8.0]
    fixes = [(1, start + dt.timedelta(seconds=s), s) for s in (0, 599, 1199, 1210, 90000)]
    spark.createDataFrame(fixes, "idterm long, timedate timestamp_ntz, progressive long").write.parquet(str(tmp_path / "fix"))
    source = spark.readStream.schema("idterm long, timedate timestamp_ntz, progressive long").parquet(str(tmp_path / "fix"))
    q = streams.stream_trips(source, 600).writeStream.format("memory").queryName("trips_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.fixes for r in spark.table("trips_out").where("start < '2019-02-02'").collect()) == [2, 2]


def test_match_on_a_line(spark):
    nodes = spark.createDataFrame([(0, 15.0, 37.5), (1, 15.01, 37.5), (5, 15.01, 37.51), (9, 15.01, 37.52)], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 900), (1, 0, 900), (1, 5, 1100), (5, 9, 1100)], "u long, v long, length long")
    start, rows = dt.datetime(2019, 2, 1), []
    for k, (x, y) in enumerate([(15.001, 37.5), (15.005, 37.5), (15.009, 37.5), (15.01, 37.503), (15.01, 37.507), (15.01, 37.512), (15.01, 37.518)]):
        rows.append(("1_0", k, start + dt.timedelta(seconds=30 * k), x, y, 400 * k, 50))
    fixes = spark.createDataFrame(rows, "TRIP_ID string, id long, timedate timestamp_ntz, longitude double, latitude double, progressive long, speed long")
    found = matching.candidates(fixes, edges, nodes, radius_m=30.0)
    matched = matching.match_trips(matching.drop_ambiguous(found), edges, slack_m=50)
    assert [(r.u, r.v) for r in matched.orderBy("timedate").collect()] == [(0, 1)] * 3 + [(1, 5)] * 2 + [(5, 9)] * 2
    out = matching.traversals(matched, fixes, edges).orderBy("sequenza").collect()
    assert [(r.u, r.v, r.mean_speed) for r in out] == [(0, 1, 48), (1, 5, 48), (5, 9, 50)]


def test_routes_longer_than_the_odometer_are_rejected(spark):
    """Two parallel roads: the fix lies a little nearer to the far one, which can't be reached in time."""
    nodes = spark.createDataFrame([(0, 15.0, 37.5), (1, 15.01, 37.5), (2, 15.02, 37.5), (3, 15.01, 37.5001), (4, 15.02, 37.5001)], "node long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 880), (1, 2, 880), (3, 4, 880), (2, 3, 5000)], "u long, v long, length long")
    start = dt.datetime(2019, 2, 1)
    fixes = spark.createDataFrame([("a", 1, start, 15.005, 37.5, 440, 50), ("a", 2, start + dt.timedelta(seconds=60), 15.015, 37.50006, 1320, 50)], "TRIP_ID string, id long, timedate timestamp_ntz, longitude double, latitude double, progressive long, speed long")
    found = matching.candidates(fixes, edges, nodes, radius_m=20.0)
    assert {(r.u, r.v) for r in found.where("id = 2").collect()} >= {(1, 2), (3, 4)}
    assert [(r.u, r.v) for r in matching.match_trips(found, edges, slack_m=20).orderBy("id").collect()] == [(0, 1), (1, 2)]


def test_row_numbers_of_a_wide_frame(spark):
    from roadpulse.operators import cleaning

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 1_000_003) % n).alias("x"), F.repeat(F.lit("ab"), 64).alias("wide"), F.lit(1).alias("_n"))
    for merge in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
        got = cleaning.add_row_id(df, ["x"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("row_id") != F.col("x") + 1).alias("wrong"), F.max(F.length("wide")).alias("w")).first()
        assert (got.n, got.wrong, got.w) == (n, 0, 128)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_two_homes_and_clusters(spark):
    stops = [(k, 1, 15.0, 37.5) for k in range(5)] + [(k, 1, 15.1, 37.6) for k in range(5, 8)] + [(8, 1, 16.0, 38.0)]
    df = spark.createDataFrame(stops, "id long, idterm long, lon double, lat double")
    assert [(r["rank"], r.lon, r.n) for r in places.home_locations(df).orderBy("rank").collect()] == [(1, 15.0, 5), (2, 15.1, 3)]
    nights = df.select("id", "idterm", F.col("lon").alias("longitude"), F.col("lat").alias("latitude"), F.lit(1).alias("n_nights"))
    r = places.night_place(nights).first()
    assert (r.n_points, r.n_nights, r.longitude) == (5, 5, 15.0)
