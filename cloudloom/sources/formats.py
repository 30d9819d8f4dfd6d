"""Point clouds in files as Spark data sources: npz clouds, folders of npy arrays, LiDAR frames, text by object.

``register(spark)`` names the formats "cloud_npz", "cloud_npy", "cloud_bin" and "cloud_txt". Reading deals files to tasks by their sizes;
the option ``clouds``, a JSON list, names those whose files are opened (filters aren't pushed into the source: Spark 4.1 keeps a pushed
filter for later queries of the same frame, which then lack rows). Writing is all or nothing: tasks write below a staging folder beside the
target, and the target appears by one rename once every task has ended and the parts of each cloud follow each other without a gap. Files of
tasks that failed or ran twice are never moved.

A point's id is its place in its cloud, from 0. A cloud of many points is written by many tasks, each a part of its own whose name
carries the first place ("c@65536.npz"), so no task holds a cloud; readers put the places together again.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cloudloom.sources.io import ASSETS

REALS = ["x", "y", "z", "r", "g", "b", "nx", "ny", "nz", "intensity"]
MARKS = ["label", "instance"]
SCHEMA = "cloud string, point_id bigint, " + ", ".join([f"{c} double" for c in REALS] + [f"{c} int" for c in MARKS])
Columns = dict[str, np.ndarray]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    path = re.sub(r"^file:/+", "/", path).rstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


# ---------------------------------------------------------------- layouts: a part of a cloud as files


class Npz:
    """One .npz a part: voxel_index (x, y, z, where they are whole) or coord, and one array for each other column; the option ``keys`` is a
    JSON object of the columns that arrays become."""

    pattern = re.compile(r"^(?P<part>.+)\.npz$")

    @staticmethod
    def encode(part: str, columns: Columns, options: dict) -> dict[str, bytes]:
        xyz = np.stack([columns[a] for a in "xyz"], axis=1)
        whole = np.array_equal(xyz, np.round(xyz)) and (xyz >= 0).all() and (not len(xyz) or xyz.max() < 65_536)
        names = {v: k for k, v in json.loads(options.get("keys", "{}")).items()}
        arrays = {names.get(c, c): a for c, a in columns.items() if c not in ("x", "y", "z")}
        out = io.BytesIO()
        np.savez_compressed(out, **({"voxel_index": xyz.astype(np.uint16)} if whole else {"coord": xyz}), **arrays)
        return {f"{part}.npz": out.getvalue()}

    @staticmethod
    def decode(files: dict[str, bytes], options: dict) -> Columns:
        keys, out = json.loads(options.get("keys", "{}")), {}
        with np.load(io.BytesIO(next(iter(files.values()))), allow_pickle=False) as z:
            for name in z.files:
                if name in ("voxel_index", "coord"):
                    out.update(zip("xyz", z[name].T))
                else:
                    out[keys.get(name, name)] = z[name]
        return out


class Npy:
    """A folder for each part with an array for each asset: coord, color, normal, strength, segment, instance; others are left out."""

    pattern = re.compile(r"^(?P<part>.+)/(?P<asset>[^/]+)\.npy$")

    @staticmethod
    def encode(part: str, columns: Columns, options: dict) -> dict[str, bytes]:
        out = {}
        for asset, names in ASSETS.items():
            if all(c in columns for c in names):
                whole = names[0] in MARKS
                out[f"{part}/{asset}.npy"] = _npy(np.stack([columns[c] for c in names], axis=1).astype(np.int32 if whole else options.get("dtype", "float32")))
        return out

    @staticmethod
    def decode(files: dict[str, bytes], options: dict) -> Columns:
        out: Columns = {}
        for name, content in files.items():
            asset = Npy.pattern.match(name)["asset"]
            if asset in ASSETS:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                out.update(zip(ASSETS[asset], a.reshape(len(a), -1).T))
        return out


class Bin:
    """Little-endian float frames (x, y, z, strength, ...) and .label files: the instance in the upper, the label in the lower 16 bits.
    Options: ``fields`` of a point (4), ``strength_scale`` (1). Parts without a .bin have no points."""

    pattern = re.compile(r"^(?P<part>.+)\.(?P<asset>bin|label)$")

    @staticmethod
    def encode(part: str, columns: Columns, options: dict) -> dict[str, bytes]:
        n = len(columns["x"])
        a = np.zeros((n, int(options.get("fields", 4))), "<f4")
        for k, c in enumerate("xyz"):
            a[:, k] = columns[c]
        a[:, 3] = columns.get("intensity", np.zeros(n)) * float(options.get("strength_scale", 1))
        out = {f"{part}.bin": a.tobytes()}
        if "label" in columns:
            instance = columns.get("instance", np.zeros(n)).astype(np.int64) & 0xFFFF
            out[f"{part}.label"] = (instance << 16 | columns["label"].astype(np.int64) & 0xFFFF).astype("<u4").tobytes()
        return out

    @staticmethod
    def decode(files: dict[str, bytes], options: dict) -> Columns:
        got = {Bin.pattern.match(k)["asset"]: v for k, v in files.items()}
        a = np.frombuffer(got.get("bin", b""), "<f4").reshape(-1, int(options.get("fields", 4))).astype(float)
        out = dict(zip("xyz", a.T)) | {"intensity": a[:, 3] / float(options.get("strength_scale", 1))}
        if "label" in got and "bin" in got:
            marks = np.frombuffer(got["label"], "<u4").astype(np.int64)
            out |= {"label": marks & 0xFFFF, "instance": marks >> 16}
        return out


class Txt:
    """Lines of the columns (option ``columns``, "x y z" at first), a file for each object; a cloud may be named "room/chair_1"."""

    pattern = re.compile(r"^(?P<part>.+)\.txt$")

    @staticmethod
    def encode(part: str, columns: Columns, options: dict) -> dict[str, bytes]:
        names = options.get("columns", "x y z").split()
        lines = zip(*(columns[c].tolist() for c in names))
        return {f"{part}.txt": "".join(" ".join(map(repr, row)) + "\n" for row in lines).encode()}

    @staticmethod
    def decode(files: dict[str, bytes], options: dict) -> Columns:
        names = options.get("columns", "x y z").split()
        a = np.array(next(iter(files.values())).split(), float).reshape(-1, len(names))
        return dict(zip(names, a.T))


# ---------------------------------------------------------------- reading


@dataclass
class Files(InputPartition):
    """The parts that a task reads: (part, its files)."""

    parts: list[tuple[str, list[str]]]


def _place(part: str) -> tuple[str, int]:
    cloud, mark, first = part.rpartition("@")
    return (cloud, int(first)) if mark and first.isdigit() else (part, 0)


class _Reader(DataSourceReader):
    def __init__(self, layout, options: dict):
        self.layout, self.options = layout, options
        self.only = set(json.loads(options["clouds"])) if "clouds" in options else None

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.options["path"])
        found, size = defaultdict(list), defaultdict(int)
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            name = info.path[len(root) + 1 :]
            hit = self.layout.pattern.match(name) if info.type == pafs.FileType.File else None
            if hit and (self.only is None or _place(hit["part"])[0] in self.only):
                found[hit["part"]].append(name)
                size[hit["part"]] += info.size
        most, out, held = int(self.options.get("partition_bytes", 32 << 20)), [], 0
        for part in sorted(found):
            if not out or held + size[part] > most:
                out.append(Files([]))
                held = 0
            out[-1].parts.append((part, found[part]))
            held += size[part]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.options["path"])
        for part, names in partition.parts:
            files = {}
            for name in names:
                with fs.open_input_file(f"{root}/{name}") as f:
                    files[name] = f.read()
            columns = self.layout.decode(files, self.options)
            cloud, first = _place(part)
            n = len(next(iter(columns.values()))) if columns else 0
            arrays = [pa.array([cloud] * n, pa.string()), pa.array(np.arange(first, first + n))]
            arrays += [pa.array(columns[c].astype(float)) if c in columns else pa.nulls(n, pa.float64()) for c in REALS]
            arrays += [pa.array(columns[c].astype(np.int32) if c in columns else np.full(n, -1, np.int32)) for c in MARKS]
            yield from pa.Table.from_arrays(arrays, ["cloud", "point_id", *REALS, *MARKS]).to_batches(65_536)


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    """What a task has written below its own folder: (part's cloud, first place, points, files)."""

    folder: str
    parts: list[tuple[str, int, int, list[str]]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, layout, options: dict, overwrite: bool):
        self.layout, self.options, self.overwrite = layout, options, overwrite
        fs, self.target = file_system(options["path"])
        if not overwrite and fs.get_file_info(self.target).type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.target} is already there")
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = file_system(self.options["path"])
        done, most = Written(f"{self.staging}/{uuid.uuid4().hex}", []), int(self.options.get("points_per_part", 1 << 20))
        held: list[pa.RecordBatch] = []

        def flush():
            t = pa.Table.from_batches(held)
            held.clear()
            cloud, ids = t["cloud"][0].as_py(), t["point_id"].to_numpy()
            if cloud is None or not cloud or "@" in cloud or ".." in cloud.split("/"):
                raise ValueError(f"no name for a cloud's file: {cloud!r}")
            if (np.diff(ids) != 1).any():
                raise ValueError(f"cloud {cloud}: a task's rows must be in the order of point_id, without a gap")
            columns = {c: t[c].to_numpy() for c in (*REALS, *MARKS) if c in t.column_names and t[c].null_count < len(t)}
            first = int(ids[0])
            files = self.layout.encode(f"{cloud}@{first}" if first else cloud, columns, self.options)
            for name, content in files.items():
                fs.create_dir(f"{done.folder}/{name}".rpartition("/")[0])
                with fs.open_output_stream(f"{done.folder}/{name}") as f:
                    f.write(content)
            done.parts.append((cloud, first, len(ids), list(files)))

        for b in iterator:
            names = b.column(b.schema.get_field_index("cloud"))
            cuts = np.flatnonzero(np.array([i == 0 or names[i] != names[i - 1] for i in range(len(names))])) if b.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], b.num_rows]):
                while at < to:
                    if held and (held[0]["cloud"][0] != names[int(at)] or sum(map(len, held)) >= most):
                        flush()
                    n = int(min(to - at, most - sum(map(len, held))))
                    held.append(b.slice(int(at), n))
                    at += n
        if held:
            flush()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.options["path"])
        try:
            ends: dict[str, int] = defaultdict(int)
            messages = [m for m in messages if m]
            for cloud, first, n, _ in sorted(p for m in messages for p in m.parts):
                if first != ends[cloud]:
                    raise ValueError(f"cloud {cloud}: a part begins at {first}, but {ends[cloud]} points come before it")
                ends[cloud] += n
            final = f"{self.staging}/final"
            fs.create_dir(final)
            for m in messages:
                for name in (x for p in m.parts for x in p[3]):
                    fs.create_dir(f"{final}/{name}".rpartition("/")[0])
                    fs.move(f"{m.folder}/{name}", f"{final}/{name}")
            there = fs.get_file_info(self.target).type != pafs.FileType.NotFound
            if there and not self.overwrite:
                raise FileExistsError(f"{self.target} is already there")
            if there:
                fs.move(self.target, f"{self.staging}/old")
            fs.move(final, self.target)
        finally:
            fs.delete_dir(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = file_system(self.options["path"])
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


class _Clouds(DataSource):
    layout: type

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.layout, dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.layout, dict(self.options), overwrite)


def _source(name: str, layout: type) -> type[DataSource]:
    return type(f"{layout.__name__}Clouds", (_Clouds,), {"layout": layout, "name": classmethod(lambda cls: name), "__module__": __name__})


NpzClouds, NpyClouds, BinClouds, TxtClouds = (_source(n, c) for n, c in (("cloud_npz", Npz), ("cloud_npy", Npy), ("cloud_bin", Bin), ("cloud_txt", Txt)))


def register(spark: SparkSession) -> None:
    """Name the formats in a session."""
    for source in (NpzClouds, NpyClouds, BinClouds, TxtClouds):
        spark.dataSource.register(source)


def read_clouds(spark: SparkSession, path: str, layout: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(layout).options(**options).load(path)


def write_clouds(df: DataFrame, path: str, layout: str, overwrite: bool = False, **options: str) -> None:
    """Write points (cloud, point_id from 0, and any of the columns) by ranges of places, so that a large cloud is dealt to many tasks."""
    register(df.sparkSession)
    rows = df.repartitionByRange("cloud", "point_id").sortWithinPartitions("cloud", "point_id")
    rows.write.format(layout).options(**options).mode("overwrite" if overwrite else "append").save(path)
