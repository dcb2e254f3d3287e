import math
import struct

import numpy as np
import pytest

from voxelry.sources import glb

FAN = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2), (0, 2, 3)])


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(contents)], "path string, content binary")


def test_round_trip(spark):
    f = files(spark, glb.encoded(*FAN))
    assert sorted((r.x, r.y) for r in glb.vertices(f).collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert [(r.a, r.b, r.c) for r in glb.faces(f).orderBy("tri_idx").collect()] == FAN[1]
    assert glb.unpacked_surface(glb.packed_surface(glb.vertices(f), glb.faces(f))).count() == 4


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.glb").write_bytes(glb.encoded(*FAN))
    (tmp_path / "b.glb").write_bytes(b"no")
    read = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.rejection, r.vertices) for r in glb.summaries(read).collect()}
    assert got == {"a.glb": (None, 4), "b.glb": ("glb.too_short", None)}


def test_damaged_files(spark):
    good = glb.encoded(*FAN)
    bad = {
        "glb.too_short": b"glTF", "glb.magic": b"xxxx" + good[4:], "glb.version": good[:4] + struct.pack("<I", 1) + good[8:], "glb.length": good + b"x",
        "glb.index_range": glb.encoded(FAN[0], [(0, 1, 9)]), "glb.degenerate": glb.encoded(FAN[0], [(0, 1, 1)]), "glb.unindexed_count": glb.encoded(FAN[0]), "glb.no_surface": glb.encoded(*FAN, mode=1),
    }
    rows = glb.summaries(files(spark, *bad.values(), None)).collect()
    assert [r.rejection for r in sorted(rows, key=lambda r: int(r.path[1:])) if not (r.rejection or "").startswith("skipped")] == [*bad, "glb.too_short"]
    assert glb.vertices(files(spark, *bad.values())).count() == 0


def test_strided_accessors():
    raw = np.arange(12, dtype="<f4").tobytes()
    doc = {"accessors": [{"bufferView": 0, "componentType": 5126, "type": "VEC2", "count": 3, "byteOffset": 4}], "bufferViews": [{"buffer": 0, "byteLength": 48, "byteStride": 16}]}
    assert glb.accessor(doc, raw, 0).tolist() == [[1, 2], [5, 6], [9, 10]]
    doc["accessors"][0]["count"] = 4
    with pytest.raises(glb.Rejected, match="accessor_bounds"):
        glb.accessor(doc, raw, 0)


def test_tracks():
    track = (np.array([0.0, 1.0, 2.0]), np.array([[0.0], [2.0], [6.0]]), "LINEAR")
    assert [float(glb.evaluated(track, t)[0]) for t in (-1, 0.5, 1, 1.5, 9)] == [0, 1, 2, 4, 6]
    assert float(glb.evaluated((*track[:2], "STEP"), 1.9)[0]) == 2
    half = (0, 0, math.sin(0.5), math.cos(0.5))
    turn = (np.array([0.0, 1.0]), np.array([(0, 0, 0, 1.0), tuple(-x for x in half)]), "LINEAR")
    got = glb.evaluated(turn, 0.5)
    assert abs(np.linalg.norm(got) - 1) < 1e-12 and got[3] > 0 and got[2] > 0


def test_weights_that_do_not_add_up():
    points = np.array([[1.0, 0, 0]] * 3)
    move = np.eye(4)
    move[0, 3] = 2
    got = glb.skinned(points, np.array([[0], [0], [0]]), np.array([[1.0], [0.5], [0.0]]), np.array([move]))
    assert got[:, 0].tolist() == [3, 3, 1]
    with pytest.raises(glb.Rejected, match="joint_range"):
        glb.skinned(points, np.array([[4]] * 3), np.ones((3, 1)), np.array([move]))
