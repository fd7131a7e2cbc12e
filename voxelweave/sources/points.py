"""Point files and maps: CSV, PLY, PGM, and scan archives by a data source."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import finite

SCHEMA = "scan_id string, point_id long, x double, y double, z double, r double, g double, b double"


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .e57, .ply, anything else CSV; rows with non-finite positions
    are left out."""
    low = path.lower()
    if low.endswith(".e57"):
        df = load_archive(spark, path, **options)
    elif low.endswith(".ply"):
        df = load_ply(spark, path)
    else:
        df = load_csv(spark, path, **options)
    return df.where(finite(F.col("x"), F.col("y"), F.col("z")))


def load_csv(spark: SparkSession, path: str, header: bool = False, sep: str = ",") -> DataFrame:
    """Columns by position: x, y, z and, if there are six, r, g, b. Colours
    above 1.5 anywhere mean a scale of 255."""
    raw = spark.read.csv(path, header=header, sep=sep, inferSchema=True)
    names = raw.columns
    colored = len(names) >= 6
    cols = [F.col(f"`{n}`").cast("double") for n in names[: 6 if colored else 3]]
    df = raw.select(F.lit(path).alias("scan_id"), F.monotonically_increasing_id().alias("point_id"), *(c.alias(a) for c, a in zip(cols, "xyzrgb")))
    if not colored:
        return df.withColumns({c: F.lit(0.0) for c in "rgb"})
    top = df.agg(F.when(F.max(F.greatest("r", "g", "b")) > 1.5, 255.0).otherwise(1.0).alias("_k"))
    return df.crossJoin(F.broadcast(top)).withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col("_k"))) for c in "rgb"}).drop("_k")


# PLY's names of number types.
_PLY = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d"}


def parse_ply(data: bytes) -> list[tuple[float, ...]]:
    """Vertices of an ascii or binary PLY file as (x, y, z, r, g, b)."""
    end = data.index(b"end_header")
    head, body = data[:end].decode("ascii", "replace").splitlines(), data[data.index(b"\n", end) + 1 :]
    kind, count, props, element = "ascii", 0, [], None
    for line in head:
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            if element == "vertex":
                count = int(w[2])
        elif w[:1] == ["property"] and element == "vertex" and w[1] != "list":
            props.append((w[2], w[1]))
    names = [n for n, _ in props]
    if kind == "ascii":
        rows = [tuple(float(v) for v in line.split()[: len(props)]) for line in body.decode("ascii").split("\n")[:count]]
    else:
        s = struct.Struct(("<" if "little" in kind else ">") + "".join(_PLY[t] for _, t in props))
        rows = list(s.iter_unpack(body[: count * s.size]))
    rgb = [names.index(c) if c in names else None for c in ("red", "green", "blue")]
    scale = 255.0 if rgb[0] is not None and props[rgb[0]][1] in ("uchar", "uint8") else 1.0
    at = [names.index(c) for c in "xyz"]
    return [tuple(float(r[i]) for i in at) + tuple(float(r[i]) / scale if i is not None else 0.0 for i in rgb) for r in rows]


def decode_ply(files: DataFrame) -> DataFrame:
    """files (path, content) -> points, decoded where a file is read; a file's
    points are in order."""

    def run(batches):
        import pyarrow as pa

        names = ["scan_id", "point_id", "x", "y", "z", "r", "g", "b"]
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse_ply(content)
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.string()), pa.array(range(k, k + len(part)), pa.int64()), *(pa.array([r[i] for r in part], pa.float64()) for i in range(6))], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def load_ply(spark: SparkSession, path: str) -> DataFrame:
    return decode_ply(spark.read.format("binaryFile").load(path))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file through Hadoop's file systems, so that stores other than the
    local disk work."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def load_transform(spark: SparkSession, path: str, name: str | None = None) -> list[list[float]]:
    """A small matrix of an .npy file, or of an .npz archive by its name (the
    first without one)."""
    import io

    import numpy as np

    data = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    got = np.load(io.BytesIO(data), allow_pickle=False)
    if not isinstance(got, np.ndarray):
        got = got[name or sorted(got.files)[0]]
    if got.size > 4096:
        raise ValueError("a transform has few entries")
    return np.atleast_2d(got).astype(float).tolist()


def ply_bytes(rows: list[tuple[float, ...]]) -> bytes:
    """(x, y, z, r, g, b) -> a binary PLY file."""
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(rows)}\nproperty double x\nproperty double y\nproperty double z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    return head.encode() + b"".join(struct.pack("<dddBBB", *r[:3], *(max(0, min(255, round(c * 255))) for c in r[3:6])) for r in rows)


def load_archive(spark: SparkSession, path: str, decode=None, setups: int | None = None) -> DataFrame:
    """Scan archives (E57): a Python data source with one partition a setup.
    The codec is pluggable: decode(path, k) yields (x, y, z, r, g, b) of setup
    k with its pose applied; colours are scaled per setup."""
    if decode is None:
        raise NotImplementedError("reading E57 needs a decode(path, setup) function")
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(setups or 1)]

        def read(self, partition):
            rows = [tuple(map(float, r)) for r in decode(path, partition.value)]
            k = 255.0 if any(max(r[3:6]) > 1.5 for r in rows) else 1.0
            for i, r in enumerate(rows):
                yield (f"{path}#{partition.value}", i, *r[:3], *(c / k for c in r[3:6]))

    class Archive(DataSource):
        @classmethod
        def name(cls):
            return "scan_archive"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Archive)
    return spark.read.format("scan_archive").load()


def inspect(points: DataFrame) -> DataFrame:
    """Counts and boxes per setup and of all (scan_id null), in one rollup."""
    return points.rollup("scan_id").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"))


def parse_pgm(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, pixels) of a binary PGM; comments are skipped."""
    at, words = 0, []
    while len(words) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        words.append(data[at:end])
        at = end
    if words[0] != b"P5":
        raise ValueError("not a binary PGM")
    w, h = int(words[1]), int(words[2])
    return w, h, data[at + 1 : at + 1 + w * h]


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """map_id, row (0 = bottom), col, value of every pixel."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w, h, px = parse_pgm(content)
                v = np.frombuffer(px, np.uint8).reshape(h, w)[::-1]
                for r in range(h):
                    yield pa.RecordBatch.from_arrays([pa.array([p] * w, pa.string()), pa.array([r] * w, pa.int32()), pa.array(range(w), pa.int32()), pa.array(v[r].astype("int32"))], ["map_id", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "map_id string, row int, col int, value int")


def pgm_bytes(cells: list[tuple[int, int, int]], width: int, height: int, unknown: int = 205) -> bytes:
    """(row from the bottom, col, value) -> a PGM file."""
    px = bytearray([unknown]) * (width * height)
    for r, c, v in cells:
        px[(height - 1 - r) * width + c] = v
    return f"P5\n{width} {height}\n255\n".encode() + bytes(px)
