"""Readers, writers, decoding and ingestion on small files."""

import pytest
from pyspark.sql import functions as F

from cellweave.functions import numeric as N
from cellweave.operators import alignment as A
from cellweave.operators import cells as C
from cellweave.operators import decode as D
from cellweave.operators import graph as G
from cellweave.operators import regulon as R
from cellweave.sources import readers, sinks
from cellweave.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿RBP ; TG;score\nA;x;1.5\nB;y;2\n")
    rows = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert rows.columns == ["RBP", "TG", "score"] and rows.count() == 2
    (tmp_path / "m.tsv").write_text("gene\tc1\tc2\ng1\t1\tx\ng2\t0.5\t3\n")
    got = {(r.gene, r.cell): r.value for r in readers.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {("g1", "c1"): 1.0, ("g1", "c2"): 0.0, ("g2", "c1"): 0.5, ("g2", "c2"): 3.0}
    (tmp_path / "s.csv").write_text("gene,seq\nACTB, acgt\nGAPDH,TTGA\n")
    assert {(r.gene, r.seq) for r in readers.read_gene_sequences(spark, str(tmp_path / "s.csv")).collect()} == {("ACTB", "ACGT"), ("GAPDH", "TTGA")}
    (tmp_path / "p.xml").write_text("<r><XYZStagePointDefinition PositionID='1' StageXPos='0.001' StageYPos='0.002'/></r>".replace(" PositionID='1' StageXPos='0.001' StageYPos='0.002'/>", "><PositionID>1</PositionID><StageXPos>0.001</StageXPos><StageYPos>0.002</StageYPos></XYZStagePointDefinition><XYZStagePointDefinition><PositionID>2</PositionID><StageXPos>0.0015</StageXPos><StageYPos>0.002</StageYPos></XYZStagePointDefinition>"))
    got = {r.position: (round(r.x_um, 6), round(r.y_um, 6)) for r in readers.read_stage_positions(spark, str(tmp_path / "p.xml")).collect()}
    assert got == {1: (0.0, 0.0), 2: (500.0, 0.0)}
    for name in ("Position1", "Position3"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "reads.csv").write_text("x,y\n1,2\n")
    rows, missing = readers.read_positions(spark, str(tmp_path / "Position*" / "reads.csv"), "x int, y int", ["Position1", "Position2", "Position3"])
    assert {r.position for r in rows.collect()} == {"Position1", "Position3"} and [r.position for r in missing.collect()] == ["Position2"]
    schema = spark.createDataFrame([], "cell long, gene string, z int").schema
    fixed = readers.with_schema(spark.createDataFrame([("5", "a")], "cell_barcode string, gene string"), schema, {"cell_barcode": "cell"}).first()
    assert tuple(fixed) == (5, "a", None)
    ranges = readers.expand_ranges(spark.createDataFrame([("1-3, 7;2", "e")], "r string, k string"), "r", "n")
    assert sorted(r.n for r in ranges.collect()) == [1, 2, 3, 7]
    assert readers.expand_template("{root}/{run | basename}.csv", {"root": "/a", "run": "/x/y"}) == "/a/y.csv"
    assert readers.parameter_grid(spark, k=[1, 2], alpha=[0.1, 0.2, 0.3]).count() == 6


def test_image_index(spark, tmp_path):
    for name in ("round001/Position001_ch00.tif", "round001/Position001_ch01.tif", "round002/Position010_ch02.tif", "round002/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {(r.fov, r.round, r.channel) for r in readers.image_index(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, 0), (1, 1, 1), (10, 2, 2)}
    (tmp_path / "round001/a_Position1_ch0.tif").write_bytes(b"y")
    with pytest.raises(Exception, match="several files"):
        readers.image_index(spark, str(tmp_path)).collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0)], "rbp long, target string, weight double")
    assert {r.rbp: r.json for r in sinks.regulon_json(rows).collect()} == {1: '{"a":2.0,"b":3.0}', 2: '{"a":1.0}'}
    sinks.write_partitioned(rows, str(tmp_path / "t"), "rbp")
    sinks.write_partitioned(rows.where("rbp = 2").withColumn("weight", F.lit(9.0)), str(tmp_path / "t"), "rbp")
    assert sorted(r.weight for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2.0, 3.0, 9.0]
    assert sinks.significant(rows.withColumn("p_adjusted", F.col("weight") / 50)).count() == 2


def test_ingest_reads_each_file_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "fov long, cell long, gene string"
    for part in ([(1, 1, "a"), (1, 1, "a")], [(2, 1, "b"), (1, 1, "a")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_reads(spark, source, schema, target, checkpoint).awaitTermination(120)
    assert {(r.fov, r.gene): r.n for r in ingest.cell_counts(spark, target).collect()} == {(1, "a"): 3, (2, "b"): 1}


def test_decoding_rules(spark):
    book = spark.createDataFrame([("ACGTAC",), ("A",), ("AXGT",)], "s string")
    got = [r.c for r in book.select(D.encoded(F.col("s"), D.COLOURS).alias("c")).collect()]
    assert got == [D_encode("ACGTAC"), ".", "..2"]
    back = spark.createDataFrame([(D_encode("ACGTAC"),), ("19",)], "c string").select(D.decoded(F.col("c"), "A", D.COLOURS).alias("b"))
    assert [r.b for r in back.collect()] == ["ACGTAC", ""]
    with pytest.raises(ValueError):
        D.decoded(F.col("c"), "A", {"AA": 1, "AC": 1})
    reads = spark.createDataFrame([(0.1, 0.5), (0.9, 0.1)], "quality double, margin double")
    assert [r.keep for r in D.apply_rules(reads, [("keep_all", 0, 1)]).collect()] == [True, True]
    with pytest.raises(ValueError):
        D.apply_rules(reads, [("brightest", 0, 1)])
    with pytest.raises(ValueError):
        D.gated(reads, "other")


def D_encode(s):
    return "".join(str(D.COLOURS[s[i : i + 2]]) for i in range(len(s) - 1))


def test_stitching_keeps_cell_zero_apart(spark):
    rows = spark.createDataFrame([(1, 0), (1, 2), (1, -1), (2, -1), (3, 0)], "fov long, cell long")
    got = sorted((r.fov, r.cell, r.global_id) for r in C.stitched_ids(rows).collect())
    assert got == [(1, -1, -1), (1, 0, 0), (1, 2, 2), (2, -1, -1), (3, 0, 3)]


def test_graph_identities(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 0.5), (4, 4, 9.0)], "src long, dst long, weight double")
    sym = G.symmetrised(edges)
    assert sym.count() == 6 and sym.where("src = dst").count() == 0
    rows = G.transition(sym, 2).groupBy("src").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in rows)
    mean = {(r.src, r.dst): r.weight for r in G.symmetrised(edges, "mean").collect()}
    assert mean[1, 2] == mean[2, 1] == 0.5
    with pytest.raises(ValueError):
        G.symmetrised(edges, "min")
    with pytest.raises(ValueError):
        G.laplacian(edges, "other")
    with pytest.raises(ValueError):
        N.filter_gain("box", F.lit(1.0), F.lit(1.0))
    assert A.inconsistent_cells(edges, edges).count() == 0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "k string, p double").withColumn("g", F.lit(1))
    adjusted = {r.k: r.q for r in R.benjamini_hochberg(p, "p", "q", "g", order="k").collect()}
    assert adjusted == {"a": pytest.approx(0.04), "b": pytest.approx(0.16 / 3), "c": pytest.approx(0.16 / 3), "d": pytest.approx(0.5)}
