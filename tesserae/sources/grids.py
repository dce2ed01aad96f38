"""Surface mesh files to vertices (vid, x, y, z) and triangles (tid, v0, v1, v2), and sinks for viewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import fields, head, number, numbered_lines, write_lines

Mesh = tuple[DataFrame, DataFrame]


def _points(lines: DataFrame, first: int, count: int, skip: int = 0) -> DataFrame:
    rows = lines.where(F.col("n").between(first, first + count - 1)).select((F.col("n") - first).alias("vid"), fields().alias("p"))
    return rows.select("vid", *[number(F.col("p"), skip + k).alias(c) for k, c in enumerate("xyz")])


def read_ply(spark: SparkSession, path: str) -> Mesh:
    """ASCII; faces of more corners are fanned into triangles."""
    n = 64
    while "end_header" not in (lines := [x.strip() for x in head(spark, path, n)]):
        if len(lines) < n:
            raise ValueError(f"{path} has no end of header")
        n *= 4
    top = lines.index("end_header")
    if not any(x.startswith("format ascii") for x in lines[:top]):
        raise ValueError("only ASCII files are read")
    count = {x.split()[1]: int(x.split()[2]) for x in lines[:top] if x.startswith("element")}
    every = numbered_lines(spark, path)
    first = top + 1 + count["vertex"]
    faces = every.where(F.col("n").between(first, first + count["face"] - 1)).select((F.col("n") - first).alias("f"), fields().alias("p"))
    corner = lambda k: F.get("p", k).cast("long")
    fan = faces.select("f", "p", F.explode(F.sequence(F.lit(0), F.get("p", F.lit(0)).cast("int") - 3)).alias("k"))
    wide = fan.agg(F.coalesce(F.max("k"), F.lit(0)) + 1).first()[0]
    return _points(every, top + 1, count["vertex"]), fan.select((F.col("f") * wide + F.col("k")).alias("tid"), corner(F.lit(1)).alias("v0"), corner(F.col("k") + 2).alias("v1"), corner(F.col("k") + 3).alias("v2"))


def read_surface(spark: SparkSession, path: str) -> Mesh:
    """The mark, the number of vertices, their lines, the number of triangles, their lines with 1-based ids."""
    lines = numbered_lines(spark, path)
    if head(spark, path, 1)[0].strip() != "surfacemesh":
        raise ValueError(f"{path} is not a surface mesh")
    at = lambda n: int(lines.where(F.col("n") == n).first()["value"].split()[0])
    nv = at(1)
    nt = at(2 + nv)
    rows = lines.where(F.col("n").between(3 + nv, 2 + nv + nt)).select((F.col("n") - (3 + nv)).alias("tid"), fields().alias("p"))
    return _points(lines, 2, nv), rows.select("tid", *[(number(F.col("p"), k, "long") - 1).alias(f"v{k}") for k in range(3)])


def read_gmsh(spark: SparkSession, path: str) -> Mesh:
    """Version 2 ASCII: nodes and triangle elements (type 2); node numbers may have gaps."""
    lines = numbered_lines(spark, path)
    marks = {r["value"].strip(): r["n"] for r in lines.where(F.col("value").startswith("$")).collect()}
    inside = lambda name: lines.where((F.col("n") > marks[f"${name}"] + 1) & (F.col("n") < marks[f"$End{name}"])).select(fields().alias("p"))
    nodes = inside("Nodes").select((number(F.col("p"), 0, "long") - 1).alias("vid"), *[number(F.col("p"), 1 + k).alias(c) for k, c in enumerate("xyz")])
    e = inside("Elements").where(F.get("p", F.lit(1)) == "2")
    tags = F.get("p", F.lit(2)).cast("int")
    return nodes, e.select((number(F.col("p"), 0, "long") - 1).alias("tid"), *[(F.get("p", tags + 3 + k).cast("long") - 1).alias(f"v{k}") for k in range(3)])


def read_tri(spark: SparkSession, path: str) -> Mesh:
    """Lines `nv N`, `nt N`, then `v id x y z` and `t id a b c`; # starts a comment."""
    p = numbered_lines(spark, path).select("n", fields(F.regexp_replace("value", "#.*", "")).alias("p"))
    kind = F.get("p", F.lit(0))
    v = p.where((kind == "v") & (F.size("p") >= 5)).select(number(F.col("p"), 1, "long").alias("vid"), *[number(F.col("p"), 2 + k).alias(c) for k, c in enumerate("xyz")])
    t = p.where((kind == "t") & (F.size("p") >= 5)).select(number(F.col("p"), 1, "long").alias("tid"), *[number(F.col("p"), 2 + k, "long").alias(f"v{k}") for k in range(3)])
    return v, t


def read_grid(spark: SparkSession, path: str) -> Mesh:
    from .matrices import sniff

    return {"ply": read_ply, "surface": read_surface, "gmsh": read_gmsh, "tri": read_tri}[sniff(spark, path)](spark, path)


def _xyz() -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"])


def write_ply(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """Vertex ids must be 0..n-1."""
    nv, nt = vertices.count(), triangles.count()
    top = ["ply", "format ascii 1.0", f"element vertex {nv}", *[f"property double {c}" for c in "xyz"], f"element face {nt}", "property list uchar int vertex_indices", "end_header"]
    body = vertices.select(F.lit(0).alias("s"), F.col("vid").alias("k"), _xyz().alias("value")).unionByName(triangles.select(F.lit(1).alias("s"), F.col("tid").alias("k"), F.concat_ws(" ", F.lit(3), "v0", "v1", "v2").alias("value")))
    write_lines(body, path, top, ["s", "k"])


def write_tri(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    body = vertices.select(F.lit(0).alias("s"), F.col("vid").alias("k"), F.concat_ws(" ", F.lit("v"), "vid", _xyz()).alias("value"))
    body = body.unionByName(triangles.select(F.lit(1).alias("s"), F.col("tid").alias("k"), F.concat_ws(" ", F.lit("t"), "tid", "v0", "v1", "v2").alias("value")))
    write_lines(body, path, [f"nv {vertices.count()}", f"nt {triangles.count()}"], ["s", "k"])


def write_gmsh(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    nv, nt = vertices.count(), triangles.count()
    one = lambda s, k, text: vertices.sparkSession.createDataFrame([(s, k, text)], "s int, k long, value string")
    body = vertices.select(F.lit(0).alias("s"), F.col("vid").alias("k"), F.concat_ws(" ", F.col("vid") + 1, _xyz()).alias("value"))
    body = body.unionByName(one(1, 0, "$EndNodes")).unionByName(one(1, 1, "$Elements")).unionByName(one(1, 2, str(nt)))
    body = body.unionByName(triangles.select(F.lit(2).alias("s"), F.col("tid").alias("k"), F.concat_ws(" ", F.col("tid") + 1, F.lit("2 2 0 0"), F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("value"))).unionByName(one(3, 0, "$EndElements"))
    write_lines(body, path, ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(nv)], ["s", "k"])


def write_vtk(vertices: DataFrame, triangles: DataFrame, path: str, title: str = "mesh") -> None:
    """Legacy VTK polygons."""
    nv, nt = vertices.count(), triangles.count()
    mark = vertices.sparkSession.createDataFrame([(1, 0, f"POLYGONS {nt} {4 * nt}")], "s int, k long, value string")
    body = vertices.select(F.lit(0).alias("s"), F.col("vid").alias("k"), _xyz().alias("value")).unionByName(mark)
    body = body.unionByName(triangles.select(F.lit(2).alias("s"), F.col("tid").alias("k"), F.concat_ws(" ", F.lit(3), "v0", "v1", "v2").alias("value")))
    write_lines(body, path, ["# vtk DataFile Version 2.0", title, "ASCII", "DATASET POLYDATA", f"POINTS {nv} double"], ["s", "k"])


def write_cluster_dot(tree: DataFrame, path: str) -> None:
    """A cluster tree as a GraphViz digraph."""
    body = tree.where("cid <> parent").select("cid", F.format_string("  %d -> %d;", "parent", "cid").alias("value"))
    end = tree.sparkSession.createDataFrame([(1 << 62, "}")], "cid long, value string")
    write_lines(body.unionByName(end), path, ["digraph clusters {"], ["cid"])
