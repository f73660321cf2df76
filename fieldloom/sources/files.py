"""Field files: binary and text fields, image files for viewers, tables and restarts.

A file is one field on a mesh, cells in x-fastest order. Readers take whole
files as bytes through Spark's reader and decode them in tasks; a file is
the unit of parallelism, and large states belong in Parquet (`save`,
`load`), which is the native restart format. Single-file writers (`write`)
sort rows by ranges, encode every range in its task, and pass the pieces on
one by one, so the driver holds one piece at a time. `binary`, `dat`, `vti`
and the others build a whole file in memory and refuse meshes of more than
MOST_CELLS cells.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, IOFailure
from ..functions.material import EnergyTable
from ..mesh import KEYS, Mesh


def header(data: bytes) -> dict[str, object]:
    """Kind, size, components and the place where values begin."""
    if b"---\n" in data[:4096]:
        end = data.index(b"---\n") + 4
        text, kind = data[:end].decode(), "BINARY"
    else:
        text, kind, end = data[:4096].decode(errors="replace"), "DAT", 0
    out: dict[str, object] = {"kind": kind, "at": end, "components": 1}
    for line in text.split("\n"):
        words = line.lstrip("# ").replace(":", " ").split()
        if words[:1] == ["name"] and len(words) > 1:
            out["name"] = words[1]
        elif words[:1] == ["nComponents"]:
            out["components"] = int(words[1])
        elif words[:1] == ["ghost"]:
            out["ghost"] = int(words[1])
        elif words[:3] == ["nx", "ny", "nz"] and len(words) == 6:
            out["n"] = tuple(map(int, words[3:]))
        elif "n" not in out and len(words) >= 3 and all(re.fullmatch(r"\d+", w) for w in words[:3]):
            out["n"] = tuple(map(int, words[:3]))
    if "n" not in out:
        raise IOFailure("read", "the header has no size")
    return out


def values(data: bytes) -> tuple[dict[str, object], np.ndarray]:
    """The header and an array (component, cell)."""
    head = header(data)
    cells = int(np.prod(head["n"]))
    if head["kind"] == "BINARY":
        flat = np.frombuffer(data, "<f8", offset=head["at"])
    else:
        rows = [line.split() for line in data.decode().split("\n") if line.strip() and not line.startswith("#")]
        flat = np.array([[float(x) for x in r[3:]] for r in rows]).T.ravel()
        head["components"] = len(flat) // max(cells, 1)
    if len(flat) != cells * head["components"]:
        raise IOFailure("read", f"{len(flat)} values for {cells} cells and {head['components']} components")
    return head, flat.reshape(head["components"], cells)


def read(spark: SparkSession, path: str, mesh: Mesh, name: str, components: int = 1) -> DataFrame:
    """Fields of one file, or of many (a glob, with column file): i, j, k and the value, or a column for each component."""
    from ..plans.expr import names

    columns = [name] if components == 1 else names(name, components)
    n = mesh.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                head, own = values(bytes(data))
                if tuple(head["n"]) != tuple(n) or head["components"] != components:
                    raise IOFailure("read", f"{file} has size {head['n']} x {head['components']}, not {n} x {components}")
                cell = np.arange(own.shape[1])
                out = {"i": cell % n[0], "j": cell // n[0] % n[1], "k": cell // (n[0] * n[1])}
                frame = pd.DataFrame({**{k: v.astype(np.int32) for k, v in out.items()}, **dict(zip(columns, own, strict=True))})
                frame["file"] = file
                yield frame

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(["i int, j int, k int", *(f"{c} double" for c in columns), "file string"]))


#: Cells of a file that is built in memory.
MOST_CELLS = 1 << 24
#: Rows of one encoded piece of a streamed file.
PIECE_ROWS = 1 << 17


def ordered(df: DataFrame, columns: list[str], cells: int) -> np.ndarray:
    """Values in x-fastest order, as (component, cell); for single-file exports of small fields."""
    if cells > MOST_CELLS:
        raise IOFailure("write", f"{cells} cells are too many for a file in memory", "use write")
    rows = df.select(*KEYS, *columns).orderBy("k", "j", "i")
    return np.array([[r[c] for c in columns] for r in rows.toLocalIterator(prefetchPartitions=True)]).T.reshape(len(columns), -1)


def binary(df: DataFrame, mesh: Mesh, name: str, columns: list[str] | None = None, ghost: int = 1) -> bytes:
    columns = columns or [name]
    kind = "ScalarField" if len(columns) == 1 else "VectorField"
    lines = [f"# {kind}", f"name {name}", *([f"nComponents {len(columns)}"] if len(columns) > 1 else []), "nx ny nz {} {} {}".format(*mesh.n), f"ghost {ghost}", "---", ""]
    return "\n".join(lines).encode() + ordered(df, columns, mesh.cells).astype("<f8").tobytes()


def dat_lines(df: DataFrame, mesh: Mesh, columns: list[str]) -> DataFrame:
    """Text rows x y z value..., in order: a column named value for the text writer."""
    place = [mesh.coordinate(a) if a < mesh.dim else F.lit(mesh.origin[a]) for a in range(3)]
    parts = [F.format_string("%.12e", x.cast("double")) for x in [*place, *map(F.col, columns)]]
    return df.orderBy("k", "j", "i").select(F.concat_ws(" ", *parts).alias("value"))


def dat(df: DataFrame, mesh: Mesh, name: str, columns: list[str] | None = None) -> str:
    head = ["# field - DAT", f"# name: {name}", "# nx ny nz: {} {} {}".format(*mesh.n), "# x y z value"]
    return "\n".join([*head, *(r["value"] for r in dat_lines(df, mesh, columns or [name]).toLocalIterator())]) + "\n"


def vti(df: DataFrame, mesh: Mesh, name: str, columns: list[str] | None = None, double: bool = False) -> bytes:
    """ImageData with one appended raw block of cell values, preceded by its length."""
    columns = columns or [name]
    block = np.ascontiguousarray(ordered(df, columns, mesh.cells).T.astype("<f8" if double else "<f4")).tobytes()
    head, tail = _vti_frame(mesh, name, len(columns), double)
    return head + struct.pack("<Q", len(block)) + block + tail


def _vti_frame(mesh: Mesh, name: str, components: int, double: bool) -> tuple[bytes, bytes]:
    """What stands before the block's length and after the block."""
    word = "Float64" if double else "Float32"
    extent = " ".join(f"0 {n}" for n in mesh.n)
    origin, spacing = (" ".join(repr(float(x)) for x in v) for v in (mesh.origin, mesh.d))
    xml = (
        f'<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n'
        f'<ImageData WholeExtent="{extent}" Origin="{origin}" Spacing="{spacing}">\n<Piece Extent="{extent}">\n<CellData Scalars="{name}">\n'
        f'<DataArray type="{word}" Name="{name}" NumberOfComponents="{components}" format="appended" offset="0"/>\n'
        f'</CellData>\n</Piece>\n</ImageData>\n<AppendedData encoding="raw">\n_'
    )
    return xml.encode(), b"\n</AppendedData>\n</VTKFile>\n"


def vtk_legacy(df: DataFrame, mesh: Mesh, name: str) -> bytes:
    """Structured points, big-endian floats, origin at the first cell centre."""
    return _legacy_head(mesh, name) + ordered(df, [name], mesh.cells)[0].astype(">f4").tobytes() + b"\n"


def _legacy_head(mesh: Mesh, name: str) -> bytes:
    origin = [o + 0.5 * d if a < mesh.dim else o for a, (o, d) in enumerate(zip(mesh.origin, mesh.d, strict=True))]
    head = "# vtk DataFile Version 3.0\n{}\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {} {} {}\nORIGIN {} {} {}\nSPACING {} {} {}\nPOINT_DATA {}\nSCALARS {} float 1\nLOOKUP_TABLE default\n"
    return head.format(name, *mesh.n, *origin, *mesh.d, mesh.cells, name).encode()


def vts(df: DataFrame, mesh: Mesh, name: str) -> str:
    """StructuredGrid in text, nodes spelled out."""
    ax = [[o + (i + 0.5) * d if a < mesh.dim else o for i in range(n)] for a, (n, d, o) in enumerate(zip(mesh.n, mesh.d, mesh.origin, strict=True))]
    points = "".join(f"{x!r} {y!r} {z!r}\n" for z in ax[2] for y in ax[1] for x in ax[0])
    data = "".join(f"{float(v)!r}\n" for v in ordered(df, [name], mesh.cells)[0])
    head, middle, tail = (x.decode() for x in _vts_frame(mesh, name))
    return head + points + middle + data + tail


def _vts_frame(mesh: Mesh, name: str) -> tuple[bytes, bytes, bytes]:
    """What stands before the points, between points and values, and after them."""
    extent = " ".join(f"0 {n - 1}" for n in mesh.n)
    head = f'<?xml version="1.0"?>\n<VTKFile type="StructuredGrid" version="0.1" byte_order="LittleEndian">\n<StructuredGrid WholeExtent="{extent}">\n<Piece Extent="{extent}">\n<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">\n'
    middle = f'</DataArray></Points>\n<PointData Scalars="{name}"><DataArray type="Float64" Name="{name}" format="ascii">\n'
    return head.encode(), middle.encode(), b"</DataArray></PointData>\n</Piece>\n</StructuredGrid>\n</VTKFile>\n"


def encoded(df: DataFrame, columns: list[str], encode: Callable[[dict[str, np.ndarray]], bytes]) -> DataFrame:
    """One column, data: pieces of a file in x-fastest order, encoded in the tasks; partitions are in order."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(at, PIECE_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([encode({c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names})], pa.binary())], ["data"])

    rows = df.select(*KEYS, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.repartitionByRange("k", "j", "i").sortWithinPartitions("k", "j", "i").mapInArrow(run, "data binary")


def streamed(spark: SparkSession, path: str, parts: Iterable[bytes | DataFrame]) -> None:
    """Write bytes and encoded tables one after the other to a file of any of Spark's file systems; it takes its name when it is whole."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    begun = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(begun, True)
    try:
        for part in parts:
            for piece in [part] if isinstance(part, bytes) else (r["data"] for r in part.toLocalIterator()):
                out.write(bytearray(piece))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(begun, where):
        raise IOFailure("write", f"{path} can't be renamed")


def _numbers(kind: str, columns: list[str]) -> Callable[[dict[str, np.ndarray]], bytes]:
    return lambda rows: np.ascontiguousarray(np.stack([rows[c] for c in columns], axis=1).astype(kind)).tobytes()


def _lines(mesh: Mesh, columns: list[str], places: bool, form: str) -> Callable[[dict[str, np.ndarray]], bytes]:
    """Text rows of coordinates (places) and values."""

    def run(rows: dict[str, np.ndarray]) -> bytes:
        at = [mesh.origin[a] + (rows[k] + 0.5) * mesh.d[a] if a < mesh.dim else np.full(len(rows[k]), mesh.origin[a]) for a, k in enumerate(KEYS)] if places else []
        table = np.stack([*at, *(rows[c] for c in columns)], axis=1)
        return "".join(" ".join(form % x for x in row) + "\n" for row in table.tolist()).encode()

    return run


def write(df: DataFrame, mesh: Mesh, path: str, name: str, kind: str = "BINARY", columns: list[str] | None = None, ghost: int = 1) -> None:
    """One field as one file: BINARY, DAT, VTI, VTI_F64, VTK_BIN or VTS (VTK); PARQUET writes a table."""
    columns, spark = columns or [name], df.sparkSession
    nx = "{} {} {}".format(*mesh.n)
    if kind == "PARQUET":
        df.select(*KEYS, *columns).write.mode("overwrite").parquet(path)
    elif kind == "BINARY":
        type_ = "ScalarField" if len(columns) == 1 else "VectorField"
        head = [f"# {type_}", f"name {name}", *([f"nComponents {len(columns)}"] if len(columns) > 1 else []), f"nx ny nz {nx}", f"ghost {ghost}", "---", ""]
        streamed(spark, path, ["\n".join(head).encode(), *(encoded(df, [c], _numbers("<f8", [c])) for c in columns)])
    elif kind == "DAT":
        head = ["# field - DAT", f"# name: {name}", f"# nx ny nz: {nx}", "# x y z value", ""]
        streamed(spark, path, ["\n".join(head).encode(), encoded(df, columns, _lines(mesh, columns, True, "%.17e"))])
    elif kind in ("VTI", "VTI_F64"):
        double = kind == "VTI_F64"
        head, tail = _vti_frame(mesh, name, len(columns), double)
        size = mesh.cells * len(columns) * (8 if double else 4)
        streamed(spark, path, [head + struct.pack("<Q", size), encoded(df, columns, _numbers("<f8" if double else "<f4", columns)), tail])
    elif kind == "VTK_BIN":
        streamed(spark, path, [_legacy_head(mesh, name), encoded(df, columns[:1], _numbers(">f4", columns[:1])), b"\n"])
    elif kind in ("VTS", "VTK"):
        head, middle, tail = _vts_frame(mesh, name)
        streamed(spark, path, [head, encoded(df, [], _lines(mesh, [], True, "%r")), middle, encoded(df, columns[:1], _lines(mesh, columns[:1], False, "%r")), tail])
    else:
        raise ConfigError("output", f"unknown format {kind}", f"one of {sorted(FORMATS)}")


def collection(entries: DataFrame, new: DataFrame, restart: float | None = None) -> DataFrame:
    """The time index (time, file) of image files: on a restart only entries before it stay."""
    kept = entries if restart is None else entries.filter(F.col("time") < restart)
    return kept.unionByName(new).orderBy("time")


def pvd(index: DataFrame) -> str:
    rows = "\n".join(f'<DataSet timestep="{r["time"]!r}" file="{r["file"]}"/>' for r in index.orderBy("time").collect())  # one row a snapshot
    return f'<?xml version="1.0"?>\n<VTKFile type="Collection" version="0.1">\n<Collection>\n{rows}\n</Collection>\n</VTKFile>\n'


FORMATS = {"BINARY", "DAT", "VTK", "VTS", "VTK_BIN", "VTI", "VTI_F64", "PARQUET"}


def formats(tokens: str) -> set[str]:
    """Tokens joined by +; ALL is every format."""
    got = {t.strip().upper() for t in tokens.split("+")}
    if "ALL" in got:
        return set(FORMATS)
    if got - FORMATS:
        raise ConfigError("output", f"unknown format {sorted(got - FORMATS)}", f"one of {sorted(FORMATS)}")
    return got


def save(df: DataFrame, path: str, step: int) -> str:
    """A restart state."""
    out = f"{path}/step={step}"
    df.write.mode("overwrite").parquet(out)
    return out


def load(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(f"{path}/step={step}")


def steps(spark: SparkSession, path: str) -> list[int]:
    """Steps for which a state is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(m[1]) for f in found if (m := re.fullmatch(r"(?:step=|.*_)(\d+)(?:\.field|\.vfield)?", f)))


def resolve(available: list[int], start: str | int) -> tuple[int, bool]:
    """The step to start from and whether it is exactly the wanted one: 0 for initial_field, else the nearest (the first of two)."""
    if start in ("initial_field", 0, "0"):
        return 0, True
    try:
        wanted = int(start)
    except ValueError as e:
        raise ConfigError("restart", f"start_from is neither initial_field nor a step: {start}") from e
    if not available:
        raise IOFailure("restart", "there is no saved step")
    got = min(available, key=lambda s: abs(s - wanted))
    return got, got == wanted


def state_path(case: str, name: str, step: int) -> str:
    return f"{case}/settings/initial_field/{name}.field" if step == 0 else f"{case}/output/{name}_{step}.field"


def energy_table(text: str) -> EnergyTable:
    """Header nc nT cmin cmax Tmin Tmax, then nc rows of nT values; # begins a comment, commas count as blanks."""
    words = re.sub(r"#[^\n]*", "", text).replace(",", " ").split()
    nc, nt = int(words[0]), int(words[1])
    lo_c, hi_c, lo_t, hi_t = map(float, words[2:6])
    own = list(map(float, words[6:]))
    if len(own) != nc * nt:
        raise IOFailure("table", f"{len(own)} values for {nc} x {nt}")
    return EnergyTable(tuple(tuple(own[a * nt : (a + 1) * nt]) for a in range(nc)), (lo_c, hi_c), (lo_t, hi_t))


def table_bundle(texts: dict[str, str]) -> dict[str, EnergyTable]:
    """Named tables; fL, fS and dfLdc must be there, McL and McS may."""
    if missing := {"fL", "fS", "dfLdc"} - texts.keys():
        raise ConfigError("tables", f"missing {sorted(missing)}")
    return {k: energy_table(v) for k, v in texts.items()}
