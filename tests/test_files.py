import struct
import zlib

import numpy as np
import pytest

from lattica import cli
from lattica.sources import codecs, files
from lattica.streaming.ingest import measure_arriving
from lattica.volumes import BRICK, SMALL, to_voxels


@pytest.fixture()
def volume():
    return np.random.default_rng(0).choice(np.array([0, 255], np.uint8), (4, 4, 4))


def test_codecs(volume):
    kind, dims, data = codecs.decode_volume(codecs.encode_volume(volume))
    assert (kind, dims) == ("<u1", (4, 4, 4)) and data == volume.tobytes()
    double = volume.astype(np.float64)
    assert codecs.decode_volume(codecs.encode_volume(double))[2] == double.tobytes()
    with pytest.raises(ValueError):
        codecs.decode_volume(codecs.encode_volume(volume)[:-1])
    assert (codecs.decode_tiff(codecs.encode_tiff(volume[0])) == volume[0]).all()
    assert codecs.unpack_bits(bytes([2, 1, 2, 3, 254, 7])) == bytes([1, 2, 3, 7, 7, 7])
    png = codecs.encode_png(volume[0])
    at = png.index(b"IDAT")
    n = struct.unpack(">I", png[at - 4 : at])[0]
    raw = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + n]), np.uint8).reshape(4, 5)
    assert (raw[:, 1:] == volume[0]).all()
    spheres = [(0.1, 0.2, 0.3, 0.05), (0.5, 0.5, 0.5, 0.1)]
    assert codecs.decode_spheres(codecs.encode_spheres(spheres)) == spheres


def test_bin_round_trip(spark, tmp_path, volume):
    rows = [(7, 4, 4, 4, "<u1", bytearray(volume.tobytes()))]
    files.write_bin(spark.createDataFrame(rows, BRICK), str(tmp_path / "v"))
    assert (tmp_path / "v/7.bin").read_bytes() == codecs.encode_volume(volume)
    back = files.read_volume(spark, str(tmp_path / "v/7.bin")).collect()
    assert [bytes(r.data) for r in back] == [volume.tobytes()]


def test_tiff_folder(spark, tmp_path, volume):
    for k, plane in enumerate(volume):
        (tmp_path / f"s{k:03}.tif").write_bytes(codecs.encode_tiff(plane))
    got = files.read_volume(spark, str(tmp_path)).first()
    assert bytes(got.data) == volume.tobytes()
    (tmp_path / "s9.tiff").write_bytes(codecs.encode_tiff(np.zeros((3, 4), np.uint8)))
    with pytest.raises(ValueError):
        files.read_tiff_folder(spark, str(tmp_path))


def test_spheres_file(spark, tmp_path):
    path = tmp_path / "a.sph"
    path.write_text(codecs.encode_spheres([(0.5, 0.5, 0.5, 0.25)]))
    vox = to_voxels(files.read_volume(spark, str(path), (8, 8, 8)))
    assert 0 < vox.where("v = 255").count() < 64
    text = files.encode_spheres(files.read_spheres(spark, str(path))).first().content
    assert bytes(text).decode() == "1\n0.5 0.5 0.5 0.25\n"


CUBE = "8 " + " ".join(f"{a} {b} {c}" for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))
POS = f"""boxMatrix 10 0 0 0 10 0 0 0 10
def P "poly3d {CUBE}"
def Q "sphere 1"
P 0 0 0 0 0 0 0 1
P 0 40 0 0 0 0 0 1
Q 0 0 0 0 0 0 0 1
eof
boxMatrix 20 0 0 0 20 0 0 0 20
def P "poly3d {CUBE}"
P 0 0 0 0 0 0 0 1
eof
"""


def test_pos_file(spark, tmp_path):
    path = tmp_path / "a.pos"
    path.write_text(POS)
    assert files.frame_count(spark, str(path)) == 2
    first = files.read_pos(spark, str(path), 0).collect()
    assert [r.name for r in first] == ["P"]
    points = np.array(first[0].points)
    assert points.min() == pytest.approx(0.4) and points.max() == pytest.approx(0.6)
    assert files.read_pos(spark, str(path), None).count() == 2
    assert [r.name for r in files.manifest(spark, [str(path), "b.bin"]).collect()] == [f"{path}:0", f"{path}:1", "b.bin"]
    brick = files.read_volume(spark, str(path), (10, 10, 10)).first()
    assert np.frombuffer(brick.data, np.uint8).max() == 255


def test_mesh_file(spark, tmp_path):
    path = tmp_path / "m.txt"
    v = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    path.write_text(codecs.encode_mesh(v, [[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]]))
    got = files.read_mesh(spark, str(path)).first()
    assert len(got.edges) == 6 and got.normals[0] == [0, 0, -1]


def test_command_line(spark, tmp_path, volume, capsys):
    path = tmp_path / "v.bin"
    path.write_bytes(codecs.encode_volume(volume))
    assert cli.main(["tau", str(path), "-d", "xy"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("ID,device,dimx") and len(out) == 3
    assert cli.main(["alpha", str(path), "--segmentinfo", str(tmp_path / "seg"), "--mesh", str(tmp_path / "mesh")], spark) == 0
    assert any(line.startswith("v ") for p in sorted((tmp_path / "mesh").glob("part*")) for line in p.read_text().splitlines())
    assert cli.main(["alpha", str(path), "--basic", "--sub", "2"], spark) == 0
    assert cli.main(["slice", str(path), "--size", "2", "--stride", "1", "--out", str(tmp_path / "out")], spark) == 0
    assert len(list((tmp_path / "out").glob("*.bin"))) == 8
    assert cli.main(["pack", "-N", "2", "--size", "0.2", "--maxIter", "3", "--targetTolerance", "1"], spark) == 0
    assert cli.main(["pack", "-N", "6", "--size", "0.9", "--maxIter", "2", "--targetTolerance", "0.0001"], spark) == 77
    assert cli.main(["tau", str(tmp_path / "v.xyz")], spark) == 1
    assert cli.main(["fly"], spark) == 1


def test_slices_as_png(spark, volume):
    bricks = spark.createDataFrame([(1, 4, 4, 4, "<u1", bytearray(volume.tobytes()))], BRICK)
    assert bytes(files.slice_png(bricks, 2, 1).first().content) == codecs.encode_png(volume[1])


def test_arriving_volumes(spark, tmp_path, volume):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.bin").write_bytes(codecs.encode_volume(volume))
        query = measure_arriving(spark, str(folder), str(out), str(tmp_path / "state"))
        query.awaitTermination(60)
    found = spark.read.parquet(str(out))
    assert found.count() == 2 and found.select("volume_id").distinct().count() == 2
    assert SMALL == (4, 4, 4)


def test_files_are_written_by_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    content = spark.range(20, numPartitions=4).select("id", F.concat(F.lit("file "), F.col("id")).cast("binary").alias("content"))
    assert files.write_files(content, str(tmp_path / "out"), F.concat(F.col("id").cast("string"), F.lit(".txt"))) == 20
    assert files.write_files(content, f"file:{tmp_path}/out", F.concat(F.col("id").cast("string"), F.lit(".txt"))) == 20
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{k}.txt" for k in range(20))
    assert (tmp_path / "out" / "7.txt").read_bytes() == b"file 7"
    assert files._write_from_driver(content.select(F.lit("last").alias("name"), "content").limit(1), str(tmp_path)) == 1


def test_primitives_share_shapes(spark, tmp_path):
    rows = [(0, k, 0.5 * k, 0.0, 0.0, 1.0, 2.0, 3.0 + k % 2) for k in range(10)]
    made = spark.createDataFrame(rows, "set_id long, id long, px double, py double, pz double, sx double, sy double, sz double")
    files.write_primitives(made, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "shapes")).count() == 2
    back = files.read_primitives(spark, str(tmp_path / "p")).select(*made.columns).collect()
    assert sorted(map(tuple, back)) == rows
