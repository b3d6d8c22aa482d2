"""ENVI image cubes: a scan of many files as a Spark job, and a data source for a mounted folder.

``cube_table`` reads the headers of a folder as a Spark job and pairs them with their data files; ``scan`` reads the pixels of
those cubes in blocks of lines, each by its byte ranges, from any file system that Arrow opens. The wavelength axis
stays in the table of cubes.

``spark.read.format("envi").load("/folder")`` scans a folder that every node has mounted. Each partition is one block
of lines of one file; a task maps its block and yields Arrow batches, so no cube is ever held whole. Filters on ``line`` and
``cube_id`` leave out blocks.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from opsinlake import constants as C

BLOCK_VALUES = 4_000_000
TYPES = dict(C.ENVI_TYPES)
EXTENSIONS = tuple(C.ENVI_DATA_EXTENSIONS)


class EnviError(ValueError):
    """A header or data file that cannot be read as a cube."""


def parse_header(text: str) -> dict[str, str]:
    """Lower-case keys to values; a braced value may span lines, lines starting with ``;`` are comments."""
    body = "\n".join(ln for ln in text.splitlines() if not ln.strip().startswith(";"))
    entries = re.findall(r"^[ \t]*([^={}\n]+?)[ \t]*=[ \t]*(\{[^}]*\}?|[^\n]*)", body, flags=re.M)
    return {k.lower(): " ".join(v.split()).strip().removeprefix("{").removesuffix("}").strip() for k, v in entries}


@dataclass(frozen=True)
class Cube:
    header: str
    data: str
    samples: int
    lines: int
    bands: int
    dtype: str
    interleave: str
    offset: int
    wavelengths: tuple | None

    @property
    def cube_id(self) -> str:
        return os.path.splitext(os.path.basename(self.data))[0]

    @property
    def shape(self):
        s, l, b = self.samples, self.lines, self.bands
        return {"bsq": (b, l, s), "bil": (l, b, s), "bip": (l, s, b)}[self.interleave]

    def block(self, first: int, last: int) -> np.ndarray:
        """Lines ``first`` to ``last`` as (line, sample, band), widened to single precision."""
        raw = np.memmap(self.data, dtype=self.dtype, mode="r", offset=self.offset, shape=self.shape)
        part = {
            "bsq": lambda: raw[:, first:last, :].transpose(1, 2, 0),
            "bil": lambda: raw[first:last].transpose(0, 2, 1),
            "bip": lambda: raw[first:last],
        }[self.interleave]()
        return np.ascontiguousarray(part).astype(np.float32)


def pair_files(path: str) -> tuple[str, str]:
    """Header and data file for either of them."""
    base, ext = os.path.splitext(path)
    if ext.lower() == ".hdr":
        stem = os.path.splitext(base)[0]
        for e in EXTENSIONS:
            if os.path.isfile(f"{stem}.{e}"):
                return path, f"{stem}.{e}"
        if os.path.isfile(base):
            return path, base
        raise EnviError(f"{path}: header without a data file next to it")
    for header in (f"{base}.hdr", f"{path}.hdr"):
        if os.path.isfile(header):
            return header, path
    raise EnviError(f"{path}: data without a header next to it")


def shape_of(text: str, source: str) -> dict:
    """The fields of a header, checked: samples, lines, bands, dtype, interleave, offset, wavelengths."""
    h = parse_header(text)

    def number(field, default=None):
        if field not in h:
            if default is not None:
                return default
            raise EnviError(f"{source}: {field} is not given")
        if not re.fullmatch(r"\+?\d+", h[field]):
            if default is not None:
                return default
            raise EnviError(f"{source}: {field} should be a whole number, found {h[field]!r}")
        return int(h[field])

    samples, lines, bands = number("samples"), number("lines"), number("bands")
    code = number("data type")
    interleave = h.get("interleave", "").lower()
    if interleave not in ("bsq", "bil", "bip"):
        raise EnviError(f"{source}: unknown order of the cells, {interleave!r}")
    if code not in TYPES:
        raise EnviError(f"{source}: cells of type {code} cannot be read")
    dtype = np.dtype((">" if number("byte order", 0) == 1 else "<") + TYPES[code])
    wavelengths = None
    try:
        listed = tuple(float(t) for t in h["wavelength"].split(","))
        wavelengths = listed if len(listed) == bands else None
    except (KeyError, ValueError):
        pass
    return {"samples": samples, "lines": lines, "bands": bands, "dtype": dtype.str, "interleave": interleave,
            "offset": number("header offset", 0), "wavelengths": wavelengths}


def needed(shape: dict) -> int:
    """Bytes of a data file."""
    return shape["offset"] + shape["samples"] * shape["lines"] * shape["bands"] * np.dtype(shape["dtype"]).itemsize


def describe(path: str) -> Cube:
    """Read and check one header."""
    header, data = pair_files(path)
    with open(header, encoding="utf-8", errors="replace") as f:
        shape = shape_of(f.read(), header)
    have = os.path.getsize(data)
    if have < needed(shape):
        raise EnviError(f"{data}: {needed(shape)} bytes expected from the header, {have} found")
    return Cube(header, data, **shape)


def find_cubes(path: str) -> list[Cube]:
    """The cube a file belongs to, or every cube whose header lies in a folder."""
    if os.path.isdir(path):
        names = sorted(n for n in os.listdir(path) if n.lower().endswith(".hdr"))
        return [describe(os.path.join(path, n)) for n in names]
    return [describe(path)]


@dataclass
class LineBlock(InputPartition):
    cube: Cube
    first: int
    last: int


class EnviReader(DataSourceReader):
    def __init__(self, path: str, block_values: int):
        self.path, self.block_values = path, block_values
        self.low, self.high, self.named = 0, 2**62, None

    def pushFilters(self, filters):
        """Remember what blocks can be left out; Spark still applies every filter to the rows."""
        for f in filters:
            column = tuple(getattr(f, "attribute", ()))
            if column == ("line",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = f.value
                self.low = max(self.low, v + 1 if isinstance(f, GreaterThan) else v) if not isinstance(f, (LessThan, LessThanOrEqual)) else self.low
                self.high = min(self.high, v - 1 if isinstance(f, LessThan) else v) if not isinstance(f, (GreaterThan, GreaterThanOrEqual)) else self.high
            if column == ("cube_id",) and isinstance(f, (EqualTo, In)):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.named = named if self.named is None else self.named & named
        return filters

    def partitions(self):
        out = []
        for c in find_cubes(self.path):
            if self.named is not None and c.cube_id not in self.named:
                continue
            step = max(self.block_values // max(c.samples * c.bands, 1), 1)
            out += [LineBlock(c, a, min(a + step, c.lines)) for a in range(0, c.lines, step) if a <= self.high and min(a + step, c.lines) > self.low]
        return out

    def read(self, part: LineBlock | None):
        if part is None:  # no block is left
            return
        c = part.cube
        cells = c.block(part.first, part.last)
        n, samples, bands = cells.shape
        size = n * samples
        wl = None if c.wavelengths is None else list(c.wavelengths)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c.cube_id] * size),
                pa.array(np.repeat(np.arange(part.first, part.last, dtype=np.int64), samples)),
                pa.array(np.tile(np.arange(samples, dtype=np.int64), n)),
                pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (size + 1) * bands, bands, dtype=np.int32)), pa.array(cells.ravel())
                ),
                pa.array([wl] * size, type=pa.list_(pa.float64())),
            ],
            names=["cube_id", "line", "sample", "spectrum", "wavelengths"],
        )


class EnviSource(DataSource):
    """Options: ``path``; ``blockValues`` (values per partition, default 4 million)."""

    @classmethod
    def name(cls):
        return "envi"

    def schema(self):
        return "cube_id string, line bigint, sample bigint, spectrum array<float>, wavelengths array<double>"

    def reader(self, schema):
        return EnviReader(self.options["path"], int(self.options.get("blockValues", BLOCK_VALUES)))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let Python sources see filters, which Spark requires of a source that takes them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EnviSource)


# ------------------------------------------------------------------ many files as a Spark job

_CUBES = ("cube_id string, header string, data string, samples bigint, lines bigint, bands bigint, dtype string, interleave string, "
          "offset bigint, wavelengths array<double>, error string")


def _parsed(batches):
    for batch in batches:
        rows = []
        for header, text, files in zip(*(batch.column(c).to_pylist() for c in ("header", "value", "files"))):
            base = header[: -len(".hdr")]
            stem, ext = os.path.splitext(base)
            stem = stem if ext.lower().lstrip(".") in EXTENSIONS else base
            sizes = {f["path"]: f["length"] for f in files or []}
            data = next((p for p in (*(f"{stem}.{e}" for e in EXTENSIONS), base, stem) if p in sizes), None)
            row = {"cube_id": None, "header": header, "data": data, "error": None}
            try:
                if data is None:
                    raise EnviError(f"{header}: header without a data file next to it")
                row["cube_id"] = os.path.splitext(os.path.basename(data))[0]
                shape = shape_of(text, header)
                row |= shape | {"wavelengths": None if shape["wavelengths"] is None else list(shape["wavelengths"])}
                if sizes[data] < needed(shape):
                    raise EnviError(f"{data}: {needed(shape)} bytes expected from the header, {sizes[data]} found")
            except EnviError as e:
                row["error"] = str(e)
            rows.append(row)
        fields = [("cube_id", pa.string()), ("header", pa.string()), ("data", pa.string()), *((n, pa.int64()) for n in ("samples", "lines", "bands")), ("dtype", pa.string()),
                  ("interleave", pa.string()), ("offset", pa.int64()), ("wavelengths", pa.list_(pa.float64())), ("error", pa.string())]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def cube_table(spark: SparkSession, path: str) -> DataFrame:
    """Every cube whose header lies under ``path``: ``cube_id``, files, shape, wavelengths, and in ``error`` what keeps it from being
    read. Headers are read and checked in tasks; of data files only names and sizes are looked at."""
    headers = spark.read.text(path, wholetext=True, pathGlobFilter="*.[hH][dD][rR]").select(F.input_file_name().alias("header"), "value")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where(~F.lower("path").endswith(".hdr"))

    def stem(c):
        """Folder and name without extensions, by which a header and its data file meet."""
        return F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"(\.[^./]*)+$", "")

    plain = F.regexp_replace("header", "^file:/+", "/")
    near = files.select(stem(F.col("path")).alias("stem"), F.struct(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length").alias("f"))
    near = near.groupBy("stem").agg(F.collect_list("f").alias("files"))
    met = headers.select(plain.alias("header"), "value", stem(F.col("header")).alias("stem")).join(near, "stem", "left")
    return met.select("header", "value", "files").mapInArrow(_parsed, _CUBES)


def _lines(f, c: dict, first: int, last: int) -> np.ndarray:
    """Lines ``first`` to ``last`` as (line, sample, band) in single precision, by their byte ranges alone."""
    kind, s, b = np.dtype(c["dtype"]), c["samples"], c["bands"]
    n = last - first

    def values(at: int, count: int) -> np.ndarray:
        f.seek(c["offset"] + at * kind.itemsize)
        return np.frombuffer(f.read(count * kind.itemsize), kind)

    if c["interleave"] == "bsq":
        cells = np.stack([values(k * c["lines"] * s + first * s, n * s).reshape(n, s) for k in range(b)], axis=2)
    else:
        cells = values(first * s * b, n * s * b).reshape((n, b, s) if c["interleave"] == "bil" else (n, s, b))
        cells = cells.transpose(0, 2, 1) if c["interleave"] == "bil" else cells
    return np.ascontiguousarray(cells).astype(np.float32)


def _read_blocks(batches):
    for batch in batches:
        for c in batch.to_pylist():
            files, name = pafs.FileSystem.from_uri(c["data"])
            with files.open_input_file(name) as f:
                cells = _lines(f, c, c["first"], c["last"])
            n, samples, bands = cells.shape
            yield pa.RecordBatch.from_arrays([
                pa.array([c["cube_id"]] * (n * samples)), pa.array(np.repeat(np.arange(c["first"], c["last"]), samples)), pa.array(np.tile(np.arange(samples), n)),
                pa.ListArray.from_arrays(np.arange(0, (n * samples + 1) * bands, bands, dtype=np.int32), pa.array(cells.ravel())),
            ], ["cube_id", "line", "sample", "spectrum"])


def blocks_of(cubes: DataFrame, lines: tuple[int, int] | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """The cubes in blocks of lines [first, last) of about ``block_values`` values, of all lines or of those in ``lines``."""
    low, high = lines or (0, 2**62)
    begin, end = F.greatest(F.lit(low), F.lit(0)).cast("bigint"), F.least(F.lit(high).cast("bigint"), F.col("lines"))
    step = F.greatest(F.floor(F.lit(block_values) / F.greatest(F.col("samples") * F.col("bands"), F.lit(1))), F.lit(1)).cast("bigint")
    some = cubes.where("error is null").where(begin < end)
    return some.withColumn("first", F.explode(F.sequence(begin, end - 1, step))).withColumn("last", F.least(F.col("first") + step, end))


def scan(cubes: DataFrame, lines: tuple[int, int] | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """Pixels ``cube_id, line, sample, spectrum`` of the readable cubes of a ``cube_table``. Blocks are dealt to all tasks, and each
    reads its own bytes; ``lines`` and any filter on ``cubes`` leave the others unread."""
    blocks = blocks_of(cubes, lines, block_values).drop("wavelengths", "error", "header")
    parts = int(cubes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "data", "first").mapInArrow(_read_blocks, "cube_id string, line bigint, sample bigint, spectrum array<float>")


def write_cubes(pixels: DataFrame, path: str, interleave: str = "bsq") -> DataFrame:
    """Write every cube of ``pixels(cube_id, line, sample, spectrum)`` as a header and a data file under ``path``, and return their names. One
    task holds one cube; all its pixels must be there."""
    if interleave not in ("bsq", "bil", "bip"):
        raise EnviError(f"unknown order of the cells, {interleave!r}")

    def write(part: pa.Table) -> pa.Table:
        name = str(part.column("cube_id")[0].as_py())
        line, sample = (part.column(c).to_numpy() for c in ("line", "sample"))
        v = pa.concat_arrays(part.column("spectrum").chunks).flatten().to_numpy().reshape(len(line), -1)
        lines, samples = int(line.max()) + 1, int(sample.max()) + 1
        if len(line) != lines * samples:
            raise EnviError(f"{name}: {lines * samples} pixels expected, {len(line)} found")
        cube = np.empty((lines, samples, v.shape[1]), "<f4")
        cube[line, sample] = v
        turned = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
        header = (f"ENVI\nsamples = {samples}\nlines = {lines}\nbands = {v.shape[1]}\nheader offset = 0\ndata type = 4\n"
                  f"interleave = {interleave}\nbyte order = 0\n")
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        for ext, body in (("dat", np.ascontiguousarray(cube.transpose(turned)).tobytes()), ("hdr", header.encode())):
            with files.open_output_stream(f"{folder}/{name}.{ext}") as f:
                f.write(body)
        return pa.table({"header": [f"{folder}/{name}.hdr"]})

    return pixels.select(F.col("cube_id").cast("string").alias("cube_id"), "line", "sample", F.col("spectrum").cast("array<float>").alias("spectrum")).groupBy("cube_id").applyInArrow(write, "header string")
