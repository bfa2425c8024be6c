"""Binary trajectory files (DCD): frames of single-precision coordinates."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessellar.sources.files import write_parts

TITLE = b"frames".ljust(80)


def encode(frames: np.ndarray) -> bytes:
    """Bytes of the frames, an array (frame, atom, 3)."""
    n, atoms, _ = frames.shape
    # The header's places for frame count, first step, interval and version.
    numbers = [0] * 20
    numbers[0], numbers[1], numbers[2], numbers[3], numbers[19] = n, 1, 1, n, 24
    head = b"CORD" + struct.pack("<20i", *numbers)
    title = struct.pack("<i", 1) + TITLE
    parts = [_record(head), _record(title), _record(struct.pack("<i", atoms))]
    for f in frames.astype("<f4"):
        parts += [_record(f[:, k].tobytes()) for k in range(3)]
    return b"".join(parts)


def _record(data: bytes) -> bytes:
    size = struct.pack("<i", len(data))
    return size + data + size


def _records(data: bytes):
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<i", data, at)
        if size < 0 or at + size + 8 > len(data) or struct.unpack_from("<i", data, at + 4 + size)[0] != size:
            raise ValueError("a record is cut off or damaged")
        yield data[at + 4 : at + 4 + size]
        at += size + 8


def decode(data: bytes) -> np.ndarray:
    """The frames of a file without unit cells."""
    head, _, count, *axes = _records(data)
    if head[:4] != b"CORD":
        raise ValueError("not a trajectory")
    (atoms,) = struct.unpack("<i", count)
    flat = [np.frombuffer(a, "<f4") for a in axes]
    if len(flat) % 3 or any(len(a) != atoms for a in flat):
        raise ValueError("frames of uneven size")
    return np.stack([np.stack(flat[i : i + 3], axis=1) for i in range(0, len(flat), 3)]) if flat else np.zeros((0, atoms, 3), "f4")


def write_dcd(df: DataFrame, group: str, order: str, xyz: str, folder: str, frames_per_file: int = 100_000) -> DataFrame:
    """Frames of each group in order, cut into files of bounded length; lists path and number of frames."""

    def content(f: pd.DataFrame) -> bytes:
        return encode(np.stack(f[xyz].to_numpy()).reshape(len(f), -1, 3))

    return write_parts(df.where(df[xyz].isNotNull()), group, [order], [xyz], folder, "dcd", content, frames_per_file)


def pdb_models(frames: np.ndarray, first: int = 1) -> str:
    """Text of the frames as models of carbon atoms, one residue an atom; coordinates must have at most four digits before
    the point, as the columns are fixed."""
    out = []
    for m, f in enumerate(frames, first):
        out.append(f"MODEL     {m:4d}")
        out += [f"ATOM  {k % 100_000:5d}  CA  ALA A{k % 10_000:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00           C" for k, (x, y, z) in enumerate(f, 1)]
        out.append("ENDMDL")
    return "\n".join(out) + "\n"


def write_pdb(df: DataFrame, group: str, order: str, xyz: str, folder: str, frames_per_file: int = 9_999) -> DataFrame:
    """As write_dcd, as text with a model a frame."""

    def content(f: pd.DataFrame) -> bytes:
        return pdb_models(np.stack(f[xyz].to_numpy()).reshape(len(f), -1, 3)).encode()

    return write_parts(df.where(df[xyz].isNotNull()), group, [order], [xyz], folder, "pdb", content, frames_per_file)


def read_dcd(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame (from 0), xyz of every file below the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dcd").option("recursiveFileLookup", "true").load(folder)

    def rows(batches):
        for f in batches:
            for path, content in zip(f.path, f.content, strict=True):
                frames = decode(content)
                yield pd.DataFrame({"path": path, "frame": np.arange(len(frames)), "xyz": list(frames.reshape(len(frames), -1).astype(float))})

    return files.select("path", "content").mapInPandas(rows, "path string, frame long, xyz array<double>")
