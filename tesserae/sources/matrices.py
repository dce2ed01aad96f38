"""Matrix, vector and coordinate files. Indices become 0-based; symmetric storage is mirrored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coo
from ..operators.iterate import ranks, settled
from .text import fields, head, number, numbered_lines, write_lines

# ---- MatrixMarket ----------------------------------------------------------------------------------------------------


def market_header(spark: SparkSession, path: str) -> tuple[list[str], list[int], int]:
    """Banner words after the mark, the size line's numbers, and the number of that line."""
    n = 64
    while True:
        lines = head(spark, path, n)
        words = lines[0].lower().split()
        if not words or words[0] != "%%matrixmarket":
            raise ValueError(f"{path} is not a MatrixMarket file")
        for k, line in enumerate(lines[1:], 1):
            if line.strip() and not line.startswith("%"):
                return words[1:], [int(x) for x in line.split()], k
        if len(lines) < n:
            raise ValueError(f"{path} has no size line")
        n *= 4


def read_market_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate files, real, integer, pattern or complex; general, symmetric, skew-symmetric or Hermitian."""
    (kind, form, value, symmetry), _, at = market_header(spark, path)
    if kind != "matrix" or form != "coordinate":
        raise ValueError("a coordinate matrix is expected")
    p = numbered_lines(spark, path).where((F.col("n") > at) & ~F.col("value").startswith("%") & (F.trim("value") != "")).select(fields().alias("p"))
    i, j = (number(F.col("p"), k, "long") - 1 for k in (0, 1))
    if value == "complex":
        a = p.select(i.alias("i"), j.alias("j"), number(F.col("p"), 2).alias("re"), number(F.col("p"), 3).alias("im"))
    else:
        a = p.select(i.alias("i"), j.alias("j"), (F.lit(1.0) if value == "pattern" else number(F.col("p"), 2)).alias("v"))
    if symmetry == "general":
        return a
    over = coo.transpose(a.where("i <> j"))
    if symmetry == "hermitian":
        over = coo.conjugate(over)
    if symmetry == "skew-symmetric":
        over = over.select("i", "j", *[(-F.col(c)).alias(c) for c in over.columns[2:]])
    return a.unionByName(over)


def read_market_vector(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """One column of an array file, or a coordinate file of one column."""
    (_, form, value, _), size, at = market_header(spark, path)
    lines = numbered_lines(spark, path).where((F.col("n") > at) & (F.trim("value") != "") & ~F.col("value").startswith("%"))
    p = lines.select("n", fields().alias("p"))
    names = ("re", "im") if value == "complex" else ("v",)
    if form == "coordinate":
        return p.where(number(F.col("p"), 1, "long") == column + 1).select((number(F.col("p"), 0, "long") - 1).alias("i"), *[number(F.col("p"), 2 + k).alias(c) for k, c in enumerate(names)])
    place = F.col("n") - (at + 1)
    return p.where(F.floor(place / size[0]) == column).select((place % size[0]).alias("i"), *[number(F.col("p"), k).alias(c) for k, c in enumerate(names)])


def read_market_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Points (dof, x) of an array file with one row a point."""
    _, (rows, columns), at = market_header(spark, path)
    v = numbered_lines(spark, path).where((F.col("n") > at) & (F.trim("value") != "")).select((F.col("n") - (at + 1)).alias("k"), number(fields(), 0).alias("v"))
    return v.groupBy((F.col("k") % rows).alias("dof")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.floor(F.col("k") / rows), "v"))), lambda s: s["v"]).alias("x"))


def write_market_vector(x: DataFrame, n: int, path: str) -> None:
    dense = x.sparkSession.range(n).select(F.col("id").alias("i")).join(x, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).cast("string").alias("value"))
    write_lines(dense, path, ["%%MatrixMarket matrix array real general", f"{n} 1"], ["i"])


def write_market_matrix(a: DataFrame, nrows: int, ncols: int, path: str) -> None:
    """Real, or complex if a is (i, j, re, im)."""
    names = coo.values(a)
    lines = a.select("i", "j", F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *[F.col(c).cast("string") for c in names]).alias("value"))
    kind = "complex" if "im" in names else "real"
    write_lines(lines, path, [f"%%MatrixMarket matrix coordinate {kind} general", f"{nrows} {ncols} {a.count()}"], ["i", "j"])


def pointers(a: DataFrame, by: str, n: int) -> DataFrame:
    """(k, p) for k from 0 to n: how many entries have an index `by` below k. Sums run within buckets of indices, and over
    one row a bucket."""
    from pyspark.sql import Window

    counts = a.groupBy(F.col(by).alias("k")).agg(F.count("*").alias("c"))
    every = a.sparkSession.range(n + 1).select(F.col("id").alias("k")).join(counts, "k", "left").select("k", F.coalesce("c", F.lit(0)).alias("c"), F.floor(F.col("k") / 4096).alias("bucket"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = every.groupBy("bucket").agg(F.sum("c").alias("t"))
    offsets = totals.select("bucket", F.coalesce(F.sum("t").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("c").over(before(Window.partitionBy("bucket").orderBy("k"))), F.lit(0))
    return every.withColumn("inside", inside).join(offsets, "bucket").select("k", (F.col("offset") + F.col("inside")).alias("p"))


# ---- SAMG and PLTMG --------------------------------------------------------------------------------------------------


def samg_sizes(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Non-zeros, rows and type from the .frm file beside a SAMG file."""
    stem = path.rsplit(".", 1)[0] if path.endswith((".amg", ".rhs", ".sol")) else path
    return tuple(int(x) for x in head(spark, f"{stem}.frm", 2)[1].split()[:3])  # type: ignore[return-value]


def read_samg_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Row pointers, then column indices, then values, one number a line; rows are found by a range join on pointers."""
    nnz, n, _ = samg_sizes(spark, path)
    v = numbered_lines(spark, path).select("n", number(fields(), 0).alias("v"))
    from pyspark.sql import Window

    start = v.where(F.col("n") <= n).select(F.col("n").alias("i"), (F.col("v").cast("long") - 1).alias("a"))
    spans = start.withColumn("b", F.lead("a").over(Window.orderBy("i"))).where("b > a")
    rows = spans.select("i", F.explode(F.sequence("a", F.col("b") - 1)).alias("k"))
    column = v.where(F.col("n").between(n + 1, n + nnz)).select((F.col("n") - (n + 1)).alias("k"), (F.col("v").cast("long") - 1).alias("j"))
    value = v.where(F.col("n").between(n + nnz + 1, n + 2 * nnz)).select((F.col("n") - (n + nnz + 1)).alias("k"), "v")
    return rows.join(column, "k").join(value, "k").select("i", "j", "v")


def read_samg_vector(spark: SparkSession, path: str) -> DataFrame:
    _, n, _ = samg_sizes(spark, path)
    return numbered_lines(spark, path).where(F.col("n") < n).select(F.col("n").alias("i"), number(fields(), 0).alias("v"))


def read_samg_coordinates(spark: SparkSession, path: str) -> DataFrame:
    n, dim = (int(x) for x in head(spark, path, 1)[0].split()[:2])
    return numbered_lines(spark, path).where(F.col("n").between(1, n)).select((F.col("n") - 1).alias("dof"), F.array(*[number(fields(), k) for k in range(dim)]).alias("x"))


def write_samg_matrix(a: DataFrame, nrows: int, ncols: int, path: str, kind: int = 22) -> None:
    """Row pointers, column indices and values, one number a line, a row's diagonal first; sizes go to the .frm beside."""
    order = ["i", (F.col("i") != F.col("j")), "j"]
    placed = settled(ranks(a.select("i", "j", "v"), [], order, "k"))
    number_ = lambda section, k, v: (F.lit(section).alias("section"), k.alias("k"), v.cast("string").alias("value"))
    lines = pointers(a, "i", nrows).select(*number_(0, F.col("k"), F.col("p") + 1))
    lines = lines.unionByName(placed.select(*number_(1, F.col("k").cast("long"), F.col("j") + 1))).unionByName(placed.select(*number_(2, F.col("k").cast("long"), F.col("v"))))
    write_lines(lines, path, order=["section", "k"])
    head_ = a.sparkSession.createDataFrame([(0, "f 4"), (1, f"{placed.count()} {nrows} {kind} 1 0")], "k int, value string")
    write_lines(head_, f"{path.rsplit('.', 1)[0]}.frm", order=["k"])


def write_samg_vector(x: DataFrame, path: str) -> None:
    write_lines(x.select("i", F.col("v").cast("string").alias("value")), path, order=["i"])


def read_pltmg_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows, two lines and one line a row to skip, then `row column value`."""
    n = int(head(spark, path, 1)[0].split()[0])
    p = numbered_lines(spark, path).where(F.col("n") >= n + 3).select(fields().alias("p")).where(F.size("p") >= 3)
    return p.select((number(F.col("p"), 0, "long") - 1).alias("i"), (number(F.col("p"), 1, "long") - 1).alias("j"), number(F.col("p"), 2).alias("v"))


# ---- Harwell-Boeing --------------------------------------------------------------------------------------------------


def _fixed(spec: str) -> tuple[int, int]:
    """Fields a line and width of a Fortran format such as (16I5) or (1P,4E20.12)."""
    import re

    m = re.search(r"(\d*)\s*[IEFDG]\s*(\d+)", spec.upper().replace(" ", ""))
    if not m:
        raise ValueError(f"unknown format {spec}")
    return int(m[1] or 1), int(m[2])


def read_harwell_boeing(spark: SparkSession, path: str) -> DataFrame:
    """Assembled matrices, real or pattern, unsymmetric, symmetric or skew; also the later form without right-hand sides.

    Fixed-width fields are cut in parallel: a line's number gives the places of its numbers.
    """
    top = head(spark, path, 5)
    cards = [int(x) for x in top[1].split()]
    kind, (nrows, ncols, nnz) = top[2][:3].upper(), (int(x) for x in top[2][3:].split()[:3])
    if kind[2] != "A":
        raise ValueError("elemental matrices are not supported")
    formats = [top[3][0:16], top[3][16:32], top[3][32:52]]
    first = 5 if len(cards) > 4 and cards[4] > 0 else 4
    lines = numbered_lines(spark, path)

    def section(start: int, count: int, spec: str, cast: str) -> DataFrame:
        per, width = _fixed(spec)
        raw = lines.where(F.col("n").between(start, start + count - 1)).select((F.col("n") - start).alias("l"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda k: F.struct(k.alias("k"), F.trim(F.substring(F.col("value"), k * width + 1, F.lit(width))).alias("t")))).alias("f"))
        return raw.where("f.t <> ''").select((F.col("l") * per + F.col("f.k")).alias("k"), F.regexp_replace("f.t", "[dD]", "E").cast(cast).alias("v"))

    pointers = section(first, cards[1], formats[0], "long")
    indices = section(first + cards[1], cards[2], formats[1], "long")
    from pyspark.sql import Window

    spans = pointers.select(F.col("k").alias("j"), (F.col("v") - 1).alias("a")).withColumn("b", F.lead("a").over(Window.orderBy("j"))).where("b > a")
    a = spans.select("j", F.explode(F.sequence("a", F.col("b") - 1)).alias("k")).join(indices.select("k", (F.col("v") - 1).alias("i")), "k")
    if kind[0] == "P":
        a = a.select("i", "j", F.lit(1.0).alias("v"))
    else:
        a = a.join(section(first + cards[1] + cards[2], cards[3], formats[2], "double"), "k").select("i", "j", "v")
    if kind[1] in "SHZ":
        over = coo.transpose(a.where("i <> j"))
        a = a.unionByName(coo.scale(-1.0, over) if kind[1] == "Z" else over)
    return a


#: Numbers a line and the width of each, for pointers and indices and for values.
HB_INTEGERS, HB_REALS = (6, 12), (3, 26)


def write_harwell_boeing(a: DataFrame, nrows: int, ncols: int, path: str, title: str = "matrix", key: str = "A") -> None:
    """An assembled unsymmetric real matrix by columns, without right-hand sides."""
    placed = settled(ranks(a.select("i", "j", "v"), [], ["j", "i"], "k"))
    nnz = placed.count()

    def cards(values: DataFrame, section: int, per: int, width: int) -> DataFrame:
        """Values (k, text), k from 0, as lines of `per` fields."""
        rows = values.groupBy(F.floor(F.col("k") / per).alias("card")).agg(F.array_sort(F.collect_list(F.struct("k", F.lpad("text", width, " ").alias("text")))).alias("f"))
        return rows.select(F.lit(section).alias("section"), "card", F.array_join(F.transform("f", lambda x: x["text"]), "").alias("value"))

    place = (F.col("k") - 1).alias("k")
    lines = cards(pointers(a, "j", ncols).select("k", (F.col("p") + 1).cast("string").alias("text")), 0, *HB_INTEGERS)
    lines = lines.unionByName(cards(placed.select(place, (F.col("i") + 1).cast("string").alias("text")), 1, *HB_INTEGERS))
    lines = lines.unionByName(cards(placed.select(place, F.col("v").cast("string").alias("text")), 2, *HB_REALS))
    n = [-(-(ncols + 1) // HB_INTEGERS[0]), -(-nnz // HB_INTEGERS[0]), -(-nnz // HB_REALS[0])]
    integers, reals = (f"({per}{kind})" for per, kind in ((HB_INTEGERS[0], f"I{HB_INTEGERS[1]}"), (HB_REALS[0], f"E{HB_REALS[1]}.16")))
    header = [f"{title:<72}{key:<8}", "".join(f"{x:14d}" for x in (sum(n), *n, 0)), f"{'RUA':<14}" + "".join(f"{x:14d}" for x in (nrows, ncols, nnz, 0)), f"{integers:<16}{integers:<16}{reals:<20}"]
    write_lines(lines, path, header, ["section", "card"])


# ---- MATLAB and Octave -----------------------------------------------------------------------------------------------

#: Fixed values of the MATLAB level 5 format: data types by number.
MAT_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 9: "<f8", 12: "<i8", 13: "<u8"}


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
        else:
            body = data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == 15 else -size % 8)
            if kind == 15:
                yield from _elements(zlib.decompress(body))
            else:
                yield kind, body


def matlab_variables(data: bytes) -> dict[str, tuple]:
    """Numeric variables of a level 5 file, little-endian: name to ('dense', array) or ('sparse', i, j, v, shape)."""
    found = {}
    for kind, body in _elements(data[128:]):
        if kind != 14:
            continue
        parts = list(_elements(body))
        flags = struct.unpack_from("<I", parts[0][1])[0]
        shape = np.frombuffer(parts[1][1], "<i4")
        name = parts[2][1].decode()
        array = lambda p: np.frombuffer(p[1], MAT_TYPES[p[0]])
        if flags & 0xFF == 5:
            rows, start, values = array(parts[3]), array(parts[4]), array(parts[5]).astype(float)
            if flags & 0x800:
                values = values + 1j * array(parts[6]).astype(float)
            found[name] = ("sparse", rows[: len(values)], np.repeat(np.arange(len(start) - 1), np.diff(start)), values, tuple(shape))
        else:
            values = array(parts[3]).astype(float)
            if flags & 0x800:
                values = values + 1j * array(parts[4]).astype(float)
            found[name] = ("dense", values.reshape(tuple(shape), order="F"))
    return found


def read_matlab(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A variable (the first by default) as (i, j, v) or (i, j, re, im): one file is one task's work."""
    def run(frames):
        import pandas as pd

        for f in frames:
            for data in f.content:
                variables = matlab_variables(bytes(data))
                var = variables[name or next(iter(variables))]
                if var[0] == "dense":
                    i, j = (x.ravel() for x in np.indices(var[1].shape))
                    v = var[1].ravel()
                else:
                    i, j, v = var[1:4]
                yield pd.DataFrame({"i": i.astype(np.int64), "j": j.astype(np.int64), "re": np.real(v), "im": np.imag(v)})

    a = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "i long, j long, re double, im double")
    return a if a.where("im <> 0").limit(1).count() else a.select("i", "j", F.col("re").alias("v"))


def matlab_bytes(variables: dict[str, np.ndarray]) -> bytes:
    """Dense real or complex variables as a level 5 file."""
    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49)
    for name, a in variables.items():
        a = np.atleast_2d(a)
        flags = 6 | (0x800 if np.iscomplexobj(a) else 0)
        body = element(6, struct.pack("<II", flags, 0)) + element(5, np.array(a.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, np.real(a).astype("<f8").tobytes(order="F"))
        body += element(9, np.imag(a).astype("<f8").tobytes(order="F")) if np.iscomplexobj(a) else b""
        out += element(14, body)
    return out


def write_octave(a: DataFrame, nrows: int, ncols: int, path: str, name: str = "A") -> None:
    """A dense matrix as Octave text, one line a row."""
    dense = a.sparkSession.range(nrows).select(F.col("id").alias("i"))
    cells = a.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("m"))
    rows = dense.join(cells, "i", "left").select("i", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(ncols - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)).cast("string")), " ").alias("value"))
    write_lines(rows, path, [f"# name: {name}", "# type: matrix", f"# rows: {nrows}", f"# columns: {ncols}"], ["i"])


# ---- finding the format ----------------------------------------------------------------------------------------------

#: File extensions and the formats they mean.
EXTENSIONS = {"mtx": "market", "mm": "market", "amg": "samg", "rhs": "samg", "sol": "samg", "coo": "samg", "mat": "matlab", "hb": "harwell", "rb": "harwell", "rua": "harwell", "rsa": "harwell", "psa": "harwell", "ply": "ply", "msh": "gmsh", "gmsh": "gmsh", "tri": "tri", "sur": "surface"}


def sniff(spark: SparkSession, path: str) -> str:
    """A file's format from its first bytes, else from its extension (behind any of compression)."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 64).alias("b")).first()["b"] if not path.endswith((".gz", ".bz2")) else b""
    for mark, name in ((b"%%MatrixMarket", "market"), (b"ply", "ply"), (b"$MeshFormat", "gmsh"), (b"surfacemesh", "surface"), (b"MATLAB", "matlab")):
        if bytes(first).startswith(mark):
            return name
    stem = path.removesuffix(".gz").removesuffix(".bz2")
    found = EXTENSIONS.get(stem.rsplit(".", 1)[-1].lower())
    if not found:
        raise ValueError(f"unknown format of {path}")
    return found


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    readers = {"market": read_market_matrix, "samg": read_samg_matrix, "matlab": read_matlab, "harwell": read_harwell_boeing}
    return readers[sniff(spark, path)](spark, path)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    readers = {"market": read_market_vector, "samg": read_samg_vector}
    return readers[sniff(spark, path)](spark, path)
