import random
import re
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairnfield.operators import downsample, mutate
from cairnfield.sources import pcd
from cairnfield.sources.pcd import PcdSource
from cairnfield.sources.views import uniform
from cairnfield.streaming import ingest, removed, voxels

ASCII = """# .PCD v0.7
VERSION 0.7
FIELDS x y z intensity
SIZE 4 4 4 4
TYPE F F F F
COUNT 1 1 1 1
WIDTH 3
HEIGHT 1
VIEWPOINT 0 0 0 1 0 0 0
POINTS 3
DATA ascii
0 1 2 0.5
3 4 5 1
6 7 nan 2
"""


def test_pcd_round_trip(spark, tmp_path):
    spark.dataSource.register(PcdSource)
    (tmp_path / "a.pcd").write_text(ASCII)
    rows = spark.read.format("pcd").schema("point_id long, x float, y float, z float, intensity float, ring int").load(str(tmp_path / "a.pcd")).collect()
    assert [(r.point_id, r.x, r.intensity, r.ring) for r in rows] == [(0, 0.0, 0.5, None), (1, 3.0, 1.0, None), (2, 6.0, 2.0, None)]
    points = uniform(spark, 500, partitions=3).drop("point_id")
    points.write.format("pcd").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("pcd").load(str(tmp_path / "out"))
    assert back.count() == 500 and sorted(r.point_id for r in back.collect()) == list(range(500))
    assert back.drop("point_id").exceptAll(points).count() == 0


def test_repeats_are_packed_and_unpacked():
    r = random.Random(4)
    texts = [b"", b"a", b"ab" * 5000, bytes(70000), bytes(r.randbytes(3000)), b"".join(r.choice([b"abc", b"x", b"longer piece of bytes"]) for _ in range(9000))]
    for raw in texts:
        packed = pcd.compressed(raw)
        assert pcd.expanded(packed, len(raw)) == raw and len(packed) <= len(raw) + len(raw) // 32 + 1
    assert len(pcd.compressed(bytes(70000))) < 1000
    # written by hand: three plain bytes, then five that repeat the last one
    assert pcd.expanded(b"\x02xyz\x60\x00", 8) == b"xyzzzzzz"
    for damaged, size in ((b"\x60\x05", 5), (b"\x02xyz", 9), (b"\x02xyz\x60", 8), (b"\x02xyz\xe0\xff\x00", 8)):
        with pytest.raises(ValueError):
            pcd.expanded(damaged, size)


def test_compressed_files_of_any_scheme(spark, tmp_path, monkeypatch):
    spark.dataSource.register(PcdSource)
    points = uniform(spark, 700, partitions=3).drop("point_id")
    points.write.format("pcd").option("data", "binary_compressed").mode("append").save(str(tmp_path / "out"))
    back = pcd.read_files(spark, f"file://{tmp_path}/out")
    rows = back.collect()
    assert sorted(r.point_id for r in rows) == list(range(700))
    assert sorted((r.x, r.y, r.z) for r in rows) == sorted(map(tuple, points.select("x", "y", "z").collect()))
    # fields of several numbers, whole numbers, fields that are missing, all three kinds, an empty file
    types = np.dtype([("x", "<f4"), ("v", "<f8", (2,)), ("ring", "<u2")])
    some = np.array([(1.5, (2, 3), 7), (float("nan"), (4, 5), 65535)], types)
    head = "FIELDS x v ring\nSIZE 4 8 2\nTYPE F F U\nCOUNT 1 2 1\nWIDTH %d\nHEIGHT 1\nDATA %s\n"
    packed = pcd.compressed(b"".join(some[c].tobytes() for c in types.names))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed/a.pcd").write_bytes((head % (2, "ascii")).encode() + b"1.5 2 3 7\nnan 4 5 65535\n")
    (tmp_path / "mixed/b.pcd").write_bytes((head % (2, "binary")).encode() + some.tobytes())
    (tmp_path / "mixed/c.pcd").write_bytes((head % (2, "binary_compressed")).encode() + struct.pack("<II", len(packed), some.nbytes) + packed)
    (tmp_path / "mixed/d.pcd").write_bytes((head % (0, "binary_compressed")).encode() + struct.pack("<II", 0, 0))
    monkeypatch.setattr(pcd, "BLOCK_POINTS", 1)
    mixed = pcd.read_files(spark, f"file://{tmp_path}/mixed", "ring int, v array<double>, point_id long, x double, y float").collect()
    assert [(r.ring, r.v, r.point_id, str(r.x), r.y) for r in sorted(mixed, key=lambda r: r.point_id)] == [
        (7 if k % 2 == 0 else 65535, [2.0, 3.0] if k % 2 == 0 else [4.0, 5.0], k, "1.5" if k % 2 == 0 else "nan", None) for k in range(6)
    ]
    with pytest.raises(Exception, match="at most 8 are read"):
        pcd.read_files(spark, f"{tmp_path}/mixed/c.pcd", "x float", most_bytes=8).collect()


def test_stream_equals_one_batch(spark, tmp_path):
    points = uniform(spark, 400, -2, 2, partitions=4).withColumn("seq", F.col("point_id") + 1)
    for k in range(4):
        points.where(F.col("point_id") % 4 == k).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    last = ingest.ingest(stream, str(tmp_path / "state"), 0.5)
    assert last == 3
    got = mutate.live_points(ingest.state_after(spark, str(tmp_path / "state"), last))
    want = mutate.live_points(downsample.build_thinned(points, 0.5))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_keyed_state_equals_one_batch_over_a_restart(spark, tmp_path):
    points = uniform(spark, 300, -1, 1, partitions=4).withColumn("seq", F.col("point_id") + 1).withColumn("kind", F.lit("u"))
    # a crowded voxel, ties of distance, repeated rows, rows that aren't points
    odd = [(900, 5.1, 5.1, 5.1, 7, "a"), (901, 5.1, 5.1, 5.1, 9, "b"), (901, 5.1, 5.1, 5.1, 9, "b"), (903, None, 1.0, 1.0, 1, "d"), (904, float("nan"), 1.0, 1.0, 1, "e")]
    points = points.unionByName(spark.createDataFrame(odd, "point_id long, x float, y float, z float, seq long, kind string"))
    folder = str(tmp_path / "state")

    def arrive(part):
        points.where(F.pmod(F.xxhash64("point_id", "seq"), F.lit(4)) == part).coalesce(1).write.parquet(str(tmp_path / f"in/part{part}"))
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return voxels.ingest(stream, folder, 0.5)

    wrote = [arrive(k) for k in range(4)]
    held = voxels.live_points(spark, folder)
    whole = mutate.live_points(downsample.build_thinned(points, 0.5)).select(*held.columns)
    assert sorted(held.collect()) == sorted(set(whole.collect()))
    changes = spark.read.parquet(f"{folder}/changes").count()
    # a batch writes the voxels that change and no other
    assert sum(map(sum, wrote)) == changes and 0 < sum(wrote[-1]) < held.count()
    assert voxels.thinned_out(spark, folder).count() == changes - held.count()
    # nothing new arrives: nothing is done
    stream = spark.readStream.schema(points.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    voxels.ingest(stream, folder, 0.5)
    assert spark.read.parquet(f"{folder}/changes").count() == changes
    ranks = [voxels._rank(Row(d=d, seq=seq, point_id=name)) for d, seq, name in ((1.0, 4, 9), (1.0, 3, 1), (1.0, 3, None), (1.0, None, 2), (float("nan"), 9, 1))]
    assert ranks == sorted(ranks) and len(set(ranks)) == len(ranks)


def test_removed_points_are_delivered_once_over_restarts(spark, tmp_path):
    points = uniform(spark, 60, partitions=3).withColumn("kind", F.when(F.col("point_id") % 2 == 0, "even"))
    folder, into = str(tmp_path / "feed"), str(tmp_path / "got")
    part = lambda k: points.where(F.col("point_id") % 3 == k)

    def got():
        removed.deliver(spark, folder, points.schema, into)
        return sorted((r.compaction, r.point_id, r.x, r.kind) for r in removed.delivered(spark, into, points.schema).collect())

    want = lambda *ks: sorted((n, r.point_id, r.x, r.kind) for n, k in enumerate(ks) for r in part(k).collect())
    assert removed.publish(part(0), folder, 0) and got() == want(0)
    # a compaction that runs again, and a draft that a lost writer left, change nothing
    assert not removed.publish(part(1), folder, 0)
    part(2).write.parquet(f"{folder}/_draft-lost")
    assert got() == want(0)
    assert removed.publish(part(1), folder, 1) and got() == want(0, 1)
    # the last batch ended, but its end wasn't recorded: it runs again and is stored once
    last = max((tmp_path / "got/progress/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    assert got() == want(0, 1)
    assert removed.publish(part(2).union(part(2)).limit(0), folder, 2) and removed.publish(part(2), folder, 3)
    assert got() == sorted(want(0, 1) + [(3, *x[1:]) for x in want(2)])
    for wrong in ((part(0), -1), (part(0).withColumn("compaction", F.lit(1)), 9)):
        with pytest.raises(ValueError):
            removed.publish(wrong[0], folder, wrong[1])


@pytest.mark.parametrize("name", ["cairnfield.llm", "corpus_pipeline"])
def test_entry_works_without_the_text_operators(name, monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).resolve().parent.parent))
    for m in [m for m in sys.modules if m.startswith(("cairnfield.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, name, None)
    import __spark_entry__ as entry

    assert "knn_k5" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert not any(re.match(r"op\d", q) for q in entry.queries()) or name != "cairnfield.llm"
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry_reports_what_the_text_operators_lack(monkeypatch):
    monkeypatch.syspath_prepend(str(Path(__file__).resolve().parent.parent))
    pytest.importorskip("cairnfield.llm.queries")
    for m in [m for m in sys.modules if m.startswith(("cairnfield.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ImportError, match="xxhash"):
        import __spark_entry__  # noqa: F401
