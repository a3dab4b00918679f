"""The MGF data source and the store of predictions."""

import random

import pytest
from pyspark.sql import functions as F

from ionweave.sources import files, mgf
from ionweave.sources.predictions import PredictionStore


def blocks(n, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        peaks = "".join(f"{rng.uniform(100, 900):.4f} {rng.randint(1, 999)}\n" for _ in range(rng.randint(0, 12)))
        out.append(f"BEGIN IONS\nTITLE=t{k}\nPEPMASS={500 + k}.25 99.0\nCHARGE={k % 3 + 1}+\nSCANS=F1:{k}\nSEQ=AGK{'G' * (k % 5)}\nSCORE=-{k}.5\n{peaks}END IONS\n\n")
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("mgf")
    (place / "a.mgf").write_text("".join(blocks(60)))
    (place / "b.mgf").write_text("".join(blocks(7, 2)).replace("\n", "\r\n"))
    (place / "c.mgf").write_text("BEGIN IONS\nSCANS=x\nPEPMASS=\nCHARGE=\n1.2.3 7\n200 1,5\n1e2 3\nEND IONS")
    (place / "d.mgf").write_text("nothing here")
    (place / "_hidden").write_text("".join(blocks(1)))
    return str(place)


def rows(df):
    return sorted((tuple(r) for r in df.select("scan", "charge", "precursor_mz", "peptide", "original_score", "mzs", "ints").collect()), key=repr)


@pytest.mark.parametrize("size", [1 << 20, 1000, 97, 13])
def test_data_source_equals_the_reader(spark, folder, size):
    mgf.register(spark)
    got = spark.read.format("mgf").option("rangeBytes", size).load(folder)
    assert rows(got) == rows(files.read_mgf(spark, folder)) and got.count() == 68
    assert got.rdd.getNumPartitions() >= 5_000 // size


def test_filters_reach_the_reader(spark, folder, capsys):
    mgf.register(spark)
    found = spark.read.format("mgf").load(folder).where("charge = 2 AND scan IN ('F1:1', 'F1:2', 'F1:4') AND precursor_mz > 0")
    assert sorted(r.scan for r in found.collect()) == ["F1:1", "F1:1", "F1:4", "F1:4"]
    found.explain("formatted")
    assert "EqualTo(charge,2)" in capsys.readouterr().out.replace(" ", "")
    reader = mgf.MgfReader(folder, 1 << 20)
    assert list(reader.pushFilters([mgf.EqualTo(("charge",), 2), mgf.EqualTo(("peptide",), "AGK")])) == [mgf.EqualTo(("peptide",), "AGK")]
    assert reader.tests == {"charge": {2}}


def test_stream_of_growing_files(spark, tmp_path):
    """A file that grows and one that is added; half a block waits until it is whole."""
    mgf.register(spark)
    place, parts = tmp_path / "in", blocks(5)
    place.mkdir()

    def run():
        query = spark.readStream.format("mgf").load(str(place)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination(120)
        return sorted(r.scan for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (place / "a.mgf").write_text(parts[0] + parts[1][:40])
    assert run() == ["F1:0"]
    (place / "a.mgf").write_text(parts[0] + parts[1] + parts[2])
    (place / "b.mgf").write_text(parts[3])
    assert run() == ["F1:0", "F1:1", "F1:2", "F1:3"]


def test_no_prediction_is_asked_for_twice(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def provider(peptides, charges, energies):
        with open(asked, "a") as f:
            f.writelines(f"{p} {c} {e}\n" for p, c, e in zip(peptides, charges, energies))
        return [None if p == "AX" else ([float(len(p)), -1.0], [1.0, 5e-5]) for p in peptides]

    spark.sql("DROP TABLE IF EXISTS predicted")
    store = PredictionStore(spark, "predicted", provider, energy=0.3, batch=3, buckets=4)
    data = [(k, p, z) for k, (p, z) in enumerate([("AGK", 2), ("AGK", 2), ("AGK", 3), ("GK", 2), ("AX", 1), (None, 2), ("K", None)] * 20)]
    df = spark.createDataFrame(data, "id int, peptide string, charge int").repartition(3)
    got = {r.id: (r.mz, r.intensities) for r in store(df).collect()}
    assert len(got) == 140 and got[0] == ([3.0, -1.0], [1.0, 0.0]) and got[4] == got[5] == got[6] == (None, None)
    more = df.unionByName(spark.createDataFrame([(500, "AAAA", 2)], df.schema))
    assert store(more).count() == 141 and store(more.withColumn("ce", F.lit(35.0))).count() == 141
    lines = open(asked).read().split("\n")[:-1]
    assert len(lines) == len(set(lines)) == 4 + 1 + 5 and "AGK 2 30" in lines and "AGK 2 35" in lines
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store(more)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the rows move to the table's buckets
    spark.sql("DROP TABLE predicted")
