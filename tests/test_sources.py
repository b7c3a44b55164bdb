"""Files in and out."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netfell.sources import files, mat, sinks
from netfell.streaming import monitor


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def variable(name, x, of=6, compressed=False):
    shape = struct.pack("<ii", *x.shape)
    name = name.encode()
    small = struct.pack("<HH", 1, len(name)) + name.ljust(4, b"\0") if len(name) <= 4 else element(1, name)
    body = element(6, struct.pack("<II", of, 0)) + element(5, shape) + small
    if of == 5:
        cols, rows = np.nonzero(x.T)
        starts = np.concatenate([[0], np.cumsum((x != 0).sum(axis=0))]).astype("<i4")
        body += element(5, rows.astype("<i4").tobytes()) + element(5, starts.tobytes()) + element(9, x.T[cols, rows].astype("<f8").tobytes())
    else:
        body += element(9, x.astype("<f8").tobytes(order="F"))
    whole = element(14, body)
    return struct.pack("<II", 15, len(z := zlib.compress(whole))) + z if compressed else whole


def test_mat_source_reads_dense_sparse_and_compressed(spark, tmp_path):
    x = np.array([[0.0, 2.5, 0.0], [2.5, 0.0, -1.0], [0.0, -1.0, np.nan]])
    head = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    (tmp_path / "S1_psi_adj.mat").write_bytes(head + variable("psi_adj", x) + variable("A", np.nan_to_num(x), 5, True))
    mat.register(spark)
    cells = spark.read.format("mat").load(str(tmp_path))
    rows = {(r.variable, r.u, r.v): r.w for r in cells.collect()}
    assert rows["psi_adj", 0, 1] == 2.5 and rows["psi_adj", 2, 2] is None and rows["A", 1, 2] == -1.0 and len(rows) == 9
    edges = files.adjacency(cells.select(F.col("file").alias("graph_id"), "variable", "u", "v", "w"))
    assert sorted((r.u, r.v, r.w) for r in edges.collect()) == [(0, 1, 2.5), (1, 2, -1.0)]
    with pytest.raises(files.NoInput):
        files.adjacency(cells.select(F.col("file").alias("graph_id"), F.lit("other").alias("variable"), "u", "v", "w"))
    with pytest.raises(ValueError, match="7.3"):
        list(mat.variables(b"MATLAB 7.3 MAT-file".ljust(200)))


def test_scans(spark, tmp_path):
    (tmp_path / "e.csv").write_text("u,v,w\na,b,2\nb,,1\nc,a,\n")
    assert [tuple(r)[1:] for r in files.edge_pairs(spark, str(tmp_path / "e.csv")).collect()] == [("a", "b", "2"), ("c", "a", None)]
    (tmp_path / "l.csv").write_text('region_label\n // Left // Frontal // G // Grey // BA 1 // X\n\n"second"\n')
    labels = files.labels(spark, str(tmp_path / "l.csv"))
    assert [(r.node, r.label) for r in labels.orderBy("node").collect()] == [(0, "// Left // Frontal // G // Grey // BA 1 // X"), (1, "second")]
    assert files.label_levels(labels).where("node = 0").first().levels.lobe == "Frontal"
    (tmp_path / "c.txt").write_text("1\t2\t3\n-4 5 6 7\n")
    assert [tuple(r) for r in files.coordinates(spark, str(tmp_path / "c.txt")).orderBy("node").collect()] == [(0, 1.0, 2.0, 3.0), (1, -4.0, 5.0, 6.0)]
    (tmp_path / "i.csv").write_text("7.0\n")
    assert [r.node for r in files.indices(spark, str(tmp_path / "i.csv")).collect()] == [7]
    (tmp_path / "o.csv").write_text("subject_file,final_attacks,excluded\r\nS1_broadband_psi_adj_ConvHW.mat,10,False\r\nS2_ConvHW.mat,5, true \r\nS3_ConvHW.mat,5,\r\n,1,False\r\n")
    assert sorted(r.file for r in files.included_subjects(spark, str(tmp_path / "o.csv")).collect()) == ["S1_broadband_psi_adj.mat", "S3_broadband_psi_adj.mat"]


def test_file_lists(spark, tmp_path):
    for n in ("B_2_x.mat", "A_1_x.mat", "c.txt"):
        (tmp_path / n).write_text("x")
    listed = files.files(spark, str(tmp_path), "*.mat")
    assert [(r["index"], r.subject, r.prefix) for r in listed.orderBy("index").collect()] == [(0, "A_1_x", "A"), (1, "B_2_x", "B")]
    assert files.nth_file(listed, 1).endswith("B_2_x.mat") and files.with_prefixes(listed, ["A"]).count() == 1
    for bad in (lambda: files.nth_file(listed, 2), lambda: files.files(spark, str(tmp_path), "*.nii")):
        with pytest.raises(files.NoInput):
            bad()


def test_text_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5, True), ("a", None, False), ("c", float("nan"), False)], "subject string, final_attacks double, excluded boolean")
    sinks.outlier_table(df, str(tmp_path / "o"))
    text = next((tmp_path / "o").glob("*.csv")).read_text()
    assert text == "subject,final_attacks,excluded\nb,1.5,true\na,,false\nc,nan,false\n"


def test_monitor_sums_chunks_in_any_order(spark, tmp_path):
    rows = [("g", 1, 2, 0, 5), ("g", 0, 2, 0, 7), ("g", 0, 3, 1, 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], monitor.HITS).write.mode("append").parquet(str(tmp_path / "in"))
    query = monitor.follow(monitor.running_hits(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {(r.step, r.node): (r.k, r.last_chunk) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(2, 0): (12, 1), (3, 1): (1, 0)}
