import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.join import inner_join, match_count
from millrace.sources import generator, raw
from millrace.streaming import chunks


@pytest.mark.parametrize("r,s,percent,most,expected", [(1000, 1000, 10, None, 100), (1000, 1000, 0, None, 0), (1000, 1000, 100, None, 1000), (1000, 50, 100, None, 50), (10_000, 10_000, 10, 40, 1000), (1003, 997, 10, None, 100)])
def test_generated_relations_match_exactly(spark, r, s, percent, most, expected):
    left = generator.build_relation(spark, r, s, percent).withColumn("val", F.lit(0))
    right = generator.probe_relation(spark, r, s, percent, most)
    assert (left.count(), right.count()) == (r, s)
    assert generator.matches(r, s, percent) == expected
    assert match_count(left, right.withColumn("val", F.lit(0))).first()[0] == expected
    assert left.select("key").distinct().count() == r
    if most is not None:
        hot = right.where("hot")
        assert hot.count() == int(s * generator.HOT)
        assert hot.where(F.col("key") < expected).count() == int(s * generator.HOT * most / 100)


@pytest.mark.parametrize("most", [41, 5, 101])
def test_impossible_regions(most):
    with pytest.raises(ValueError):
        generator.regions(10_000, 10_000, 10, most)


def test_file_names():
    assert generator.file_name("R", 640, 10.0) == "gen_R640_ans10.0pct.bin"
    assert generator.file_name("S", 640, 10.0, 40.0) == "gen_S640_ans10.0_max40.0pct.bin"


def test_raw_files(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    keys, vals = (rng.integers(-(2**31), 2**31, 1000).astype("<i4") for _ in range(2))
    rel = spark.createDataFrame([(i, int(k), int(v)) for i, (k, v) in enumerate(zip(keys, vals, strict=True))], "position long, key int, val int").repartition(5)
    one, two = str(tmp_path / "keys.bin"), str(tmp_path / "both.bin")
    raw.write(rel, one)
    raw.write(rel, two, values=True)
    assert (tmp_path / "keys.bin").read_bytes() == keys.tobytes()
    assert (tmp_path / "both.bin").read_bytes() == keys.tobytes() + vals.tobytes()
    found = sorted(map(tuple, raw.read(spark, one, rows=1000).collect()))
    assert found == [(i, int(k), i + 1) for i, k in enumerate(keys)]
    reader = spark.read.format("rawrelation").option("path", two).option("readVal", "true").option("partitionRows", 300).load()
    assert reader.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, reader.collect())) == [(i, int(k), int(v)) for i, (k, v) in enumerate(zip(keys, vals, strict=True))]
    s = raw.read(spark, one, offset=raw.S_OFFSET)
    assert s.agg(F.min("val")).first()[0] == 100_000_001
    assert raw.payload(s, raw.R_OFFSET).agg(F.max("val")).first()[0] == 1000


def test_short_files_are_errors(spark, tmp_path):
    (tmp_path / "short.bin").write_bytes(b"\0" * 10)
    (tmp_path / "few.bin").write_bytes(b"\0" * 12)
    for path, rows in (("short.bin", None), ("few.bin", 4)):
        with pytest.raises(Exception, match="bytes|rows"):
            raw.read(spark, str(tmp_path / path), rows=rows).count()
    (tmp_path / "none.bin").write_bytes(b"")
    assert raw.read(spark, str(tmp_path / "none.bin")).count() == 0


def test_chunks_of_a_stream(spark, tmp_path):
    r = spark.createDataFrame([(i % 5, i) for i in range(20)], "key long, val long")
    s = spark.createDataFrame([(i % 7, i) for i in range(70)], "key long, val long").repartition(4)
    s.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key long, val long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    found = []
    chunks.run_chunks(r, stream, str(tmp_path / "state"), lambda pairs, n: found.append(tuple(chunks.counts(pairs, n).first()))).awaitTermination()
    assert len(found) == 4
    assert sum(n for _, n in found) == inner_join(r, s).count()
    query = chunks.joined(r, stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("pairs").count() == inner_join(r, s).count()


def test_command_line(spark, tmp_path, capsys):
    from millrace.__main__ import main

    main(["generate", "1000", "800", "10", str(tmp_path), "--verify"])
    r, s = (str(tmp_path / generator.file_name(x, n, 10.0)) for x, n in (("R", 1000), ("S", 800)))
    main(["join", r, s, "--r-rows", "1000", "--s-rows", "800", "--check", "--mode", "14", "--skew", "1.4", "--replicate-ratio", "4.5", "--out", str(tmp_path / "pairs")])
    assert "NULL |100" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 100
    with pytest.raises(ValueError):
        main(["join", r, s, "--mode", "12"])


@pytest.mark.parametrize("values", [False, True])
def test_parts_are_read_in_order(spark, tmp_path, values):
    rel = spark.range(1003).select(F.col("id").alias("position"), (1000 - 3 * F.col("id")).alias("key"), (F.col("id") * 5).alias("val")).repartition(4)
    path = str(tmp_path / "parts")
    raw.write_parts(rel, path, values, rows=100)
    names = sorted(x.name for x in (tmp_path / "parts").iterdir())
    assert names == [f"{i * 100:020d}.raw" for i in range(11)]
    found = raw.read(spark, path, 1003, values).orderBy("position").collect()
    assert [(r.position, r.key) for r in found] == [(i, 1000 - 3 * i) for i in range(1003)]
    assert [r.val for r in found] == [5 * i if values else i + 1 for i in range(1003)]
    with pytest.raises(FileExistsError):
        raw.write_parts(rel, path, values)
    with pytest.raises(Exception, match="1003 rows"):
        raw.read(spark, path, 1004, values).count()


def test_generated_parts_are_joined(spark, tmp_path):
    from millrace.__main__ import main

    main(["generate", "1000", "800", "10", str(tmp_path), "--verify", "--parts"])
    r, s = (str(tmp_path / generator.file_name(x, n, 10.0)) for x, n in (("R", 1000), ("S", 800)))
    main(["join", r, s, "--r-rows", "1000", "--s-rows", "800", "--check", "--chunks", "2", "--out", str(tmp_path / "pairs")])
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 100
