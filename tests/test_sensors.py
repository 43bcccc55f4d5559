"""Files of differing headers: sensors' and folders of CSV."""

import datetime as dt

import pytest

from roadpulse.sources import files, sensors


def test_preambles_and_orders_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pre\namble; 1\n\nRiferimento Temporale;Corsia;Classe!;Corsia;more\n21/02/2019 10:15:00;1;2;9;x\nno time;1;2;3;x\n21/02/2019 10:16:00; 2\n\n")
    (tmp_path / "b.csv").write_text("Corsia;Corsia;Classe!;(Riferimento temporale)\n3;8;4;22-02-2019 00:00:01\nCorsia;Corsia;Classe!;(Riferimento temporale)\n5;7;;22/02/2019 00:00:02;beyond\n")
    out = sensors.read_sensor_files(spark, str(tmp_path), columns=4)
    assert out.columns == ["timedate", "corsia", "classe", "corsia_1", "rejected"]
    assert {tuple(r) for r in out.where("rejected is null").collect()} == {
        (dt.datetime(2019, 2, 21, 10, 15), "1", "2", "9", None),
        (dt.datetime(2019, 2, 22, 0, 0, 1), "3", "4", "8", None),
        (dt.datetime(2019, 2, 22, 0, 0, 2), "5", "", "7", None),
    }
    assert sensors.read_sensor_files(spark, str(tmp_path), names=["classe"]).columns == ["timedate", "classe", "rejected"]
    bad = out.where("rejected is not null").collect()
    assert {r.rejected for r in bad} == {"no time;1;2;3;x", "21/02/2019 10:16:00; 2"} and all(r.timedate is None and r.corsia is None for r in bad)


def test_headers_in_small_blocks(spark, tmp_path):
    """Files in many splits: the header is found in the first, lines of all others are parsed by it."""
    start = dt.datetime(2019, 2, 1)
    rows = [f"{k % 3};{(start + dt.timedelta(seconds=k)).strftime('%d/%m/%Y %H:%M:%S')}" for k in range(3000)]
    (tmp_path / "a.csv").write_text("\n".join(["x"] * 40 + ["Lane;Riferimento_temporale", *rows, "Lane;Riferimento_temporale"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        out = sensors.read_sensor_files(spark, str(tmp_path / "a.csv"))
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
        assert out.count() == 3000 and out.where("rejected is null").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_faulty_files_are_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Riferimento_temporale;a\n")
    (tmp_path / "b.csv").write_text("nothing\n")
    with pytest.raises(ValueError, match="b.csv has no header"):
        sensors.read_sensor_files(spark, str(tmp_path))
    assert sensors.read_sensor_files(spark, str(tmp_path / "a.csv")).count() == 0
    (tmp_path / "b.csv").write_text("Riferimento_temporale;c\n")
    with pytest.raises(ValueError, match="b.csv has no column a"):
        sensors.read_sensor_files(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert sensors.read_sensor_files(spark, str(tmp_path / "none")).columns == ["timedate", "rejected"]


def test_folder_of_csv(spark, tmp_path):
    (tmp_path / "x [1], 50%.csv").write_text('a;"b c"\n1;2\n"3;4";\n')
    (tmp_path / "y.csv").write_text("\nb c;a\n6;5\n")
    (tmp_path / "z.csv").write_text("a;b c\n7;8\n")
    (tmp_path / "empty.csv").write_text("")
    want = {("1", "2"), ("3;4", None), ("5", "6"), ("7", "8")}
    for paths in (str(tmp_path), f"{tmp_path}/*.csv", [f"{tmp_path}/[xy]*.csv", f"{tmp_path}/z.csv", f"{tmp_path}/empty.csv"]):
        assert {(r.a, r["b c"]) for r in files.read_many(spark, paths).collect()} == want
    assert files.read_many(spark, f"{tmp_path}/empty.csv").columns == []
    (tmp_path / "w.csv").write_text("a;d\n0;9\n")
    with pytest.raises(ValueError, match="has no column"):
        files.read_many(spark, str(tmp_path))
    assert {tuple(r) for r in files.read_many(spark, str(tmp_path), fill=True).select("a", "`b c`", "d").collect()} == {(a, b, None) for a, b in want} | {("0", None, "9")}
