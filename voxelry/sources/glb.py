"""Binary glTF files as tables: static surfaces, skinned animation frames, and the way back.

files(path, content) is what ``spark.read.format("binaryFile")`` gives.  Each file is decoded
by itself with NumPy views of its binary chunk; a broken file gives a row with its rejection
code and no surface, and never ends the job.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec

# Fixed values of the format.
MAGIC, VERSION, JSON_CHUNK, BIN_CHUNK, TRIANGLES = 0x46546C67, 2, 0x4E4F534A, 0x004E4942, 4
COMPONENTS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTH = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
# Fixed values of the normalised body: its length along z, and how far it is lowered.
TARGET_LENGTH, Y_OFFSET = 1.65, -0.09


class Rejected(ValueError):
    """A file that can't be read; the message is its code."""


def _need(holds: bool, code: str) -> None:
    if not holds:
        raise Rejected(code)


def container(data: bytes) -> tuple[dict, bytes]:
    """The JSON document and the binary chunk of a file."""
    _need(len(data) >= 12, "glb.too_short")
    magic, version, length = struct.unpack_from("<III", data)
    _need(magic == MAGIC, "glb.magic")
    _need(version == VERSION, "glb.version")
    _need(length == len(data), "glb.length")
    chunks: dict[int, bytes] = {}
    at = 12
    while at < len(data):
        _need(at + 8 <= len(data), "glb.chunk_header")
        size, kind = struct.unpack_from("<II", data, at)
        _need(at + 8 + size <= len(data), "glb.chunk_data")
        chunks[kind] = data[at + 8 : at + 8 + size]
        at += 8 + size
    _need(JSON_CHUNK in chunks, "glb.json_missing")
    _need(BIN_CHUNK in chunks, "glb.bin_missing")
    try:
        return json.loads(chunks[JSON_CHUNK].decode().rstrip(" \t\r\n\0")), chunks[BIN_CHUNK]
    except ValueError as e:
        raise Rejected("glb.json_invalid") from e


def _at(items: list, k, code: str):
    _need(isinstance(k, int) and 0 <= k < len(items), code)
    return items[k]


def accessor(doc: dict, body: bytes, k: int) -> np.ndarray:
    """The elements of an accessor, one row each, with the view's stride."""
    a = _at(doc.get("accessors", []), k, "glb.accessor_range")
    view = _at(doc.get("bufferViews", []), a.get("bufferView"), "glb.view_range")
    _need(view.get("buffer", 0) == 0, "glb.buffer")
    _need(a.get("componentType") in COMPONENTS and a.get("type") in WIDTH, "glb.accessor_type")
    count = a.get("count")
    _need(isinstance(count, int) and count >= 0, "glb.accessor_count")
    kind, width = np.dtype(COMPONENTS[a["componentType"]]), WIDTH[a["type"]]
    size = kind.itemsize * width
    stride = view.get("byteStride", size)
    _need(stride >= size, "glb.stride")
    begin, end = view.get("byteOffset", 0), view.get("byteOffset", 0) + view.get("byteLength", 0)
    first = begin + a.get("byteOffset", 0)
    _need(first >= 0 and view.get("byteLength", 0) >= 0, "glb.negative_offset")
    _need(end <= len(body), "glb.view_bounds")
    _need(not count or first + (count - 1) * stride + size <= end, "glb.accessor_bounds")
    return np.ndarray((count, width), kind, body, first, (stride, kind.itemsize)) if count else np.zeros((0, width), kind)


def triangles(doc: dict, body: bytes, primitive: dict, vertices: int) -> np.ndarray:
    """The index triples, given or implied."""
    k = primitive.get("indices")
    if k is None:
        _need(vertices % 3 == 0, "glb.unindexed_count")
        flat = np.arange(vertices)
    else:
        a = _at(doc.get("accessors", []), k, "glb.accessor_range")
        _need(a.get("type") == "SCALAR" and a.get("componentType") in (5121, 5123, 5125), "glb.index_type")
        flat = accessor(doc, body, k)[:, 0].astype(np.int64)
    _need(len(flat) % 3 == 0, "glb.index_count")
    t = flat.reshape(-1, 3)
    _need(len(t) > 0, "glb.no_triangles")
    _need(bool((t < vertices).all()), "glb.index_range")
    _need(not bool(((t[:, 0] == t[:, 1]) | (t[:, 1] == t[:, 2]) | (t[:, 0] == t[:, 2])).any()), "glb.degenerate")
    return t


def positions(doc: dict, body: bytes, k: int) -> np.ndarray:
    a = _at(doc.get("accessors", []), k, "glb.accessor_range")
    _need(a.get("componentType") == 5126 and a.get("type") == "VEC3", "glb.position_type")
    out = accessor(doc, body, k)
    _need(len(out) > 0, "glb.position_empty")
    return out.astype(np.float64)


def _surfaces(content: bytes) -> Iterator[tuple[int, int, str | None, np.ndarray | None, np.ndarray | None]]:
    """Mesh, primitive, why it is skipped, and positions and triangles of each primitive."""
    doc, body = container(content)
    some = False
    for m, mesh in enumerate(doc.get("meshes", [])):
        for p, primitive in enumerate(mesh.get("primitives", [])):
            k = primitive.get("attributes", {}).get("POSITION")
            if primitive.get("mode", TRIANGLES) != TRIANGLES:
                yield m, p, "skipped.mode", None, None
            elif k is None:
                yield m, p, "skipped.no_position", None, None
            else:
                v = positions(doc, body, k)
                some = True
                yield m, p, None, v, triangles(doc, body, primitive, len(v))
    _need(some, "glb.no_surface")


def _decoded(what: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for m, p, why, v, t in _surfaces(content or b""):
                        name = f"{path}#{m}.{p}"
                        if what == "summaries":
                            low, high = (v.min(axis=0), v.max(axis=0)) if v is not None else ([None] * 3, [None] * 3)
                            rows.append((path, name, why, None if v is None else len(v), None if t is None else len(t), *(None if x is None else float(x) for x in (*low, *high))))
                        elif v is not None:
                            x = v if what == "vertices" else t
                            names = ("vertex_idx", "x", "y", "z") if what == "vertices" else ("tri_idx", "a", "b", "c")
                            kind = pa.float64() if what == "vertices" else pa.int64()
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x), dtype=np.int64)), *(pa.array(np.ascontiguousarray(x[:, k]), kind) for k in range(3))], ["surface_id", *names])
                except Rejected as e:
                    rows = [(path, None, str(e), None, None, *[None] * 6)]
                if what == "summaries":
                    cols = list(zip(*rows, strict=True)) or [[]] * 11
                    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.float64()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "surface_id", "rejection", "vertices", "triangles", *[f"{m}_{k}" for m in ("min", "max") for k in "xyz"]])

    return run


def summaries(files: DataFrame) -> DataFrame:
    """A row for each triangle primitive, each skipped one, and each file that is rejected."""
    return files.select("path", "content").mapInArrow(_decoded("summaries"), "path string, surface_id string, rejection string, vertices bigint, triangles bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")


def vertices(files: DataFrame) -> DataFrame:
    """All vertices of files that decode."""
    return files.select("path", "content").mapInArrow(_decoded("vertices"), "surface_id string, vertex_idx bigint, x double, y double, z double")


def faces(files: DataFrame) -> DataFrame:
    """All triangles of files that decode."""
    return files.select("path", "content").mapInArrow(_decoded("triangles"), "surface_id string, tri_idx bigint, a bigint, b bigint, c bigint")


# Animated sequences.


def _quaternion_matrix(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q)
    x, y, z, w = q / n if n > 0 else (0.0, 0.0, 0.0, 1.0)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def trs(translation, rotation, scale) -> np.ndarray:
    """A node's local matrix: scale, then rotate, then move."""
    out = np.eye(4)
    out[:3, :3] = _quaternion_matrix(np.asarray(rotation, float)) * np.asarray(scale, float)
    out[:3, 3] = translation
    return out


def tracks(doc: dict, body: bytes, animation: dict) -> dict[int, dict[str, tuple[np.ndarray, np.ndarray, str]]]:
    """Key times and values of each animated node's translation, rotation and scale."""
    out: dict[int, dict[str, tuple[np.ndarray, np.ndarray, str]]] = {}
    for channel in animation.get("channels", []):
        sampler = _at(animation.get("samplers", []), channel.get("sampler"), "glb.sampler_range")
        node, path = channel.get("target", {}).get("node"), channel.get("target", {}).get("path")
        if node is None or path not in ("translation", "rotation", "scale"):
            continue
        _need("input" in sampler and "output" in sampler, "glb.sampler_accessors")
        times = accessor(doc, body, sampler["input"])[:, 0].astype(float)
        values = accessor(doc, body, sampler["output"]).astype(float)
        _need(len(times) == len(values) > 0, "glb.sampler_counts")
        out.setdefault(node, {})[path] = (times, values, sampler.get("interpolation", "LINEAR"))
    return out


def evaluated(track: tuple[np.ndarray, np.ndarray, str], t: float) -> np.ndarray:
    """A track at a time: held at its ends, linear between keys, rotations along the shorter arc."""
    times, values, how = track
    k = int(np.clip(np.searchsorted(times, t, side="right") - 1, 0, len(times) - 1))
    if t <= times[0] or t >= times[-1] or how == "STEP" or times[k + 1] <= times[k]:
        return values[0] if t <= times[0] else values[-1] if t >= times[-1] else values[k]
    a, b, u = values[k], values[k + 1], (t - times[k]) / (times[k + 1] - times[k])
    if len(a) != 4:
        return a + (b - a) * u
    out = a + ((-b if a @ b < 0 else b) - a) * u
    n = np.linalg.norm(out)
    return out / n if n > 0 else out


def _world(doc: dict, moving: dict, t: float | None) -> list[np.ndarray]:
    nodes = doc.get("nodes", [])
    local, parent = [], [None] * len(nodes)
    for k, node in enumerate(nodes):
        own = {"translation": node.get("translation", (0, 0, 0)), "rotation": node.get("rotation", (0, 0, 0, 1)), "scale": node.get("scale", (1, 1, 1))}
        animated = moving.get(k, {}) if t is not None else {}
        if animated or "matrix" not in node:
            local.append(trs(*({**own, **{p: evaluated(x, t) for p, x in animated.items()}}[p] for p in ("translation", "rotation", "scale"))))
        else:
            local.append(np.array(node["matrix"], float).reshape(4, 4).T)
        for child in node.get("children", []):
            _need(isinstance(child, int) and 0 <= child < len(nodes), "glb.child_range")
            parent[child] = k
    out: list[np.ndarray | None] = [None] * len(nodes)
    for k in range(len(nodes)):
        path, seen = [], set()
        while k is not None and out[k] is None:
            _need(k not in seen, "glb.node_cycle")
            seen.add(k)
            path.append(k)
            k = parent[k]
        for j in reversed(path):
            out[j] = local[j] if parent[j] is None else out[parent[j]] @ local[j]
    return out


def skinned(points: np.ndarray, joints: np.ndarray, weights: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """points blended by their joints' matrices; weights that don't add up to one are
    divided by their sum, and a point without any weight stays."""
    w = np.where(weights > 0, weights.astype(float), 0.0)
    _need(bool((joints[w > 0] < len(matrices)).all()), "glb.joint_range")
    j = np.where(w > 0, joints.astype(np.int64), 0)
    moved = np.einsum("vcij,vj->vci", matrices[j][:, :, :3, :3], points) + matrices[j][:, :, :3, 3]
    total = w.sum(axis=1, keepdims=True)
    out = (moved * w[:, :, None]).sum(axis=1)
    out = np.where(np.abs(total - 1) > 1e-5, out / np.where(total > 0, total, 1), out)
    return np.where(total > 0, out, points)


def frames_of(content: bytes, frames: int, mesh: int = 0, primitive: int = 0, animation: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Time and skinned positions of each frame; frame i is at duration * i / frames."""
    _need(frames > 1, "glb.frame_count")
    doc, body = container(content)
    p = _at(_at(doc.get("meshes", []), mesh, "glb.mesh_range").get("primitives", []), primitive, "glb.primitive_range")
    attributes = p.get("attributes", {})
    _need(all(k in attributes for k in ("POSITION", "JOINTS_0", "WEIGHTS_0")), "glb.attributes")
    points, joints, weights = positions(doc, body, attributes["POSITION"]), accessor(doc, body, attributes["JOINTS_0"]), accessor(doc, body, attributes["WEIGHTS_0"])
    _need(len(points) == len(joints) == len(weights), "glb.attribute_counts")
    holder = next((k for k, n in enumerate(doc.get("nodes", [])) if n.get("mesh") == mesh and "skin" in n), None)
    _need(holder is not None, "glb.no_skinned_node")
    skin = _at(doc.get("skins", []), doc["nodes"][holder]["skin"], "glb.skin_range")
    bones = skin.get("joints", [])
    bind = np.tile(np.eye(4), (len(bones), 1, 1))
    if skin.get("inverseBindMatrices") is not None:
        bind = accessor(doc, body, skin["inverseBindMatrices"]).astype(float)
        _need(bind.shape == (len(bones), 16), "glb.inverse_bind")
        bind = bind.reshape(-1, 4, 4).transpose(0, 2, 1)
    moving = tracks(doc, body, _at(doc.get("animations", []), animation, "glb.animation_range"))
    duration = max((float(x[0].max()) for own in moving.values() for x in own.values()), default=0.0)
    _need(duration > 0, "glb.duration")
    times = duration * np.arange(frames) / frames
    out = []
    for t in times:
        world = _world(doc, moving, float(t))
        home = np.linalg.inv(world[holder])
        out.append(skinned(points, joints, weights, np.array([home @ world[_at(list(range(len(world))), b, "glb.joint_range")] @ m for b, m in zip(bones, bind, strict=True)])))
    return times, np.stack(out)


def sequence(files: DataFrame, frames: int) -> DataFrame:
    """Path, frame, time, vertex and position of all frames; files that fail give no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    times, points = frames_of(content or b"", frames)
                except Rejected:
                    continue
                for k, (t, p) in enumerate(zip(times.tolist(), points, strict=True)):
                    n = len(p)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, k, np.int64)), pa.array(np.full(n, t)), pa.array(np.arange(n, dtype=np.int64)), *(pa.array(np.ascontiguousarray(p[:, i])) for i in range(3))], ["path", "frame", "t", "vertex_idx", "x", "y", "z"])

    return files.select("path", "content").mapInArrow(run, "path string, frame bigint, t double, vertex_idx bigint, x double, y double, z double")


# Writing.


def encoded(points, faces_=None, *, mode: int = TRIANGLES, bones: dict | None = None) -> bytes:
    """A file of one mesh; ``bones``: joints, weights, nodes, keys (times, rotations of node 1)."""
    body, views, accessors = b"", [], []

    def add(values, kind: str, component: int, shape: str) -> int:
        nonlocal body
        raw = np.ascontiguousarray(np.asarray(values, kind)).tobytes()
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(raw)})
        accessors.append({"bufferView": len(views) - 1, "componentType": component, "type": shape, "count": len(raw) // (np.dtype(kind).itemsize * WIDTH[shape])})
        body += raw + b"\0" * (-len(raw) % 4)
        return len(accessors) - 1

    primitive = {"attributes": {"POSITION": add(points, "<f4", 5126, "VEC3")}, "mode": mode}
    if faces_ is not None:
        primitive["indices"] = add(np.asarray(faces_).ravel(), "<u4", 5125, "SCALAR")
    doc = {"asset": {"version": "2.0"}, "meshes": [{"primitives": [primitive]}], "nodes": [{"mesh": 0}]}
    if bones:
        primitive["attributes"] |= {"JOINTS_0": add(bones["joints"], "u1", 5121, "VEC4"), "WEIGHTS_0": add(bones["weights"], "<f4", 5126, "VEC4")}
        doc["nodes"] = [{"mesh": 0, "skin": 0}, *bones["nodes"]]
        doc["skins"] = [{"joints": list(range(1, len(doc["nodes"])))}]
        times, turns = bones["keys"]
        doc["animations"] = [{"samplers": [{"input": add(times, "<f4", 5126, "SCALAR"), "output": add(turns, "<f4", 5126, "VEC4")}], "channels": [{"sampler": 0, "target": {"node": 1, "path": "rotation"}}]}]
    doc |= {"bufferViews": views, "accessors": accessors, "buffers": [{"byteLength": len(body)}]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<III", MAGIC, VERSION, 20 + len(text) + 8 + len(body)) + struct.pack("<II", len(text), JSON_CHUNK) + text + struct.pack("<II", len(body), BIN_CHUNK) + body


def packed_surface(points: DataFrame, triangles_: DataFrame, key: str = "surface_id") -> DataFrame:
    """Each surface as bytes: positions as little-endian floats, then index triples.

    points(key, vertex_idx, x, y, z), triangles(key, tri_idx, a, b, c); one surface is one value.
    """
    v = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("vertex_idx", "x", "y", "z"))).alias("v"))
    t = triangles_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("tri_idx", "a", "b", "c"))).alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array([[p["x"], p["y"], p["z"]] for p in vs or ()], "<f4").tobytes() + np.array([[f["a"], f["b"], f["c"]] for f in ts or ()], "<u4").tobytes() for vs, ts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or ()) for x in batch.column(1).to_pylist()], pa.int64()), pa.array(out, pa.binary())], [key, "vertices", "content"])

    both = v.join(t, key)
    kind = dict(both.dtypes)[key]
    return both.select(key, "v", "t").mapInArrow(run, f"{key} {kind}, vertices bigint, content binary")


def unpacked_surface(packed: DataFrame, key: str = "surface_id") -> DataFrame:
    """The vertices of packed surfaces; a value of a wrong length gives none."""
    kind = dict(packed.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, raw in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if raw is None or len(raw) < 12 * n or (len(raw) - 12 * n) % 12:
                    continue
                v = np.frombuffer(raw, "<f4", 3 * n).reshape(-1, 3).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * n, k.type), pa.array(np.arange(n, dtype=np.int64)), *(pa.array(np.ascontiguousarray(v[:, i])) for i in range(3))], [key, "vertex_idx", "x", "y", "z"])

    return packed.select(key, "vertices", "content").mapInArrow(run, f"{key} {kind}, vertex_idx bigint, x double, y double, z double")


def normalised(points: DataFrame, keys: tuple[str, ...] = ("surface_id",)) -> DataFrame:
    """each body turned so that its longest axis is z, scaled to ``TARGET_LENGTH``,
    centred, and lowered."""
    box = points.groupBy(*keys).agg(*[(F.max(k) - F.min(k)).alias(f"s{k}") for k in "xyz"])
    longest = F.when((F.col("sx") >= F.col("sy")) & (F.col("sx") >= F.col("sz")), 0).when(F.col("sy") >= F.col("sz"), 1).otherwise(2)
    x, y, z = Vec.of()
    a = F.col("axis")
    turned = Vec(F.when(a == 0, z).otherwise(x), F.when(a == 1, -z).otherwise(y), F.when(a == 0, -x).when(a == 1, y).otherwise(z))
    both = points.join(box.withColumn("axis", longest), [*keys]).select(*keys, "vertex_idx", *turned.aliased("t"), F.greatest("sx", "sy", "sz").alias("span")).filter("span > 0")
    scaled = both.select(*keys, "vertex_idx", *[(F.col(f"t{k}") * (TARGET_LENGTH / F.col("span"))).alias(f"t{k}") for k in "xyz"])
    centre = scaled.groupBy(*keys).agg(*[((F.min(f"t{k}") + F.max(f"t{k}")) * 0.5).alias(f"c{k}") for k in "xyz"])
    moved = [(F.col(f"t{k}") - F.col(f"c{k}") + (Y_OFFSET if k == "y" else 0.0)).alias(k) for k in "xyz"]
    return scaled.join(centre, [*keys]).select(*keys, "vertex_idx", *moved)
