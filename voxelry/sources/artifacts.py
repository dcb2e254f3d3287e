"""Documents as text: JSON artifacts and their check, JSON lines, a catalog of schemas, forbidden terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables that this library's functions take and give, by versioned id.
SCHEMAS = {
    "voxelry.mesh.vertices.table.v1": "vertex_idx long, x double, y double, z double",
    "voxelry.mesh.triangles.table.v1": "tri_idx long, a long, b long, c long",
    "voxelry.mesh.samples.table.v1": "sample_idx long, tri_idx long, b0 double, b1 double, b2 double",
    "voxelry.mesh.frames.table.v1": "sample_idx long, x double, y double, z double",
    "voxelry.distance.grid.table.v1": "linear long, ix long, iy long, iz long, distance double",
    "voxelry.distance.cells.table.v1": "cell_idx long, level int, ox double, oy double, oz double, extent double",
    "voxelry.particles.state.table.v1": "particle_idx long, x double, y double, z double, vx double, vy double, vz double, radius double, inverse_mass double, age double",
    "voxelry.fields.scalars.table.v1": "field_id string, node_idx long, value double",
    "voxelry.fields.schedule.table.v1": "ord long, node_idx long, start_step int, duration int, effect string",
    "voxelry.circuits.nodes.table.v1": "circuit_id long, node_idx long, voltage double, memory double",
    "voxelry.circuits.edges.table.v1": "circuit_id long, edge_idx long, from_node long, to_node long, tier int, base double, conductance double",
    "voxelry.circuits.edits.table.v1": "circuit_id long, event_idx long, expected_revision long, operation string, target long, amount double",
    "voxelry.skinning.weights.table.v1": "vertex_idx long, slot int, joint int, weight double",
    "voxelry.skinning.poses.table.v1": "frame long, joint long, x double, y double, z double, qx double, qy double, qz double, qw double",
    "voxelry.files.glb.table.v1": "path string, content binary",
}
SCHEMAS = {k: tuple(v.split(", ")) for k, v in SCHEMAS.items()}


def documents(rows: DataFrame, name: str) -> DataFrame:
    """Each row as a JSON text under its name: artifact, text."""
    return rows.select(F.col(name).alias("artifact"), F.to_json(F.struct(*sorted(rows.columns)), {"pretty": "true"}).alias("text"))


def written(docs: DataFrame, path: str) -> None:
    """The documents as files of JSON lines, one for each artifact."""
    docs.write.mode("errorifexists").json(path)


def checked(built: DataFrame, stored: DataFrame) -> DataFrame:
    """What is stored must be the text that is built, but for white space at its end."""
    there = stored.select("artifact", F.rtrim(F.regexp_replace("text", r"\s+$", "")).alias("there"))
    here = F.regexp_replace("text", r"\s+$", "")
    code = F.when(F.col("there").isNull(), "artifact.missing").when(F.col("there") != here, "artifact.text_differs")
    return built.join(there, "artifact", "left").select("artifact", code.alias("rejection"))


def json_line(*columns: Column) -> Column:
    """A row as one line of JSON, keys in the given order."""
    return F.to_json(F.struct(*columns))


def catalog(spark: SparkSession) -> DataFrame:
    """The schemas in order: ord, schema_id, fields, ddl."""
    return spark.createDataFrame([(k, n, len(t), ", ".join(t)) for k, (n, t) in enumerate(SCHEMAS.items())], "ord long, schema_id string, fields long, ddl string")


def catalog_differences(df: DataFrame, schema_id: str) -> list[str]:
    """The columns that a table lacks of a schema, or has with another type."""
    have = {c: t for c, t in df.dtypes}
    of = {"long": "bigint"}
    return [c for c, t in (x.split(" ") for x in SCHEMAS[schema_id]) if have.get(c) != of.get(t, t)]


def forbidden(texts: DataFrame, key: str, text: str, terms: tuple[str, ...]) -> DataFrame:
    """The texts that hold a term, in any case: key, term."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), t))
    return texts.select(key, F.explode(found).alias("term"))
