"""Files written by tasks, on whatever file system the folder's address names."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellar.operators.reshape import range_index


def put_bytes(folder: str, name: str, content: bytes) -> str:
    """Writes the file under another name first and then renames it, so that a repeated task leaves one whole file."""
    system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    system.create_dir(root, recursive=True)
    partial = f"{root}/_{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as out:
        out.write(content)
    system.move(partial, f"{root}/{name}")
    return f"{folder}/{name}"


def write_parts(df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str], folder: str, ending: str, encode: Callable[[pd.DataFrame], bytes], rows_per_file: int) -> DataFrame:
    """A group's rows in order, cut into files ``<group>-<part>.<ending>`` of ``rows_per_file``: path, n of each.

    Rows are numbered over ranges of (group, order), so a group that holds most of the data is spread over tasks, and a
    task holds one file's rows. The order must be unique in a group.
    """
    numbered = range_index(df.select(group, *dict.fromkeys([*order, *columns])).where(F.col(group).isNotNull()), [group, *order], "_at")
    first = numbered.groupBy(group).agg(F.min("_at").alias("_first"))
    parts = numbered.join(first, group).withColumn("_part", F.floor((F.col("_at") - F.col("_first")) / rows_per_file).cast("int"))

    def put(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_at")
        name = f"{f[group].iloc[0]}-{int(f['_part'].iloc[0]):06d}.{ending}"
        return pd.DataFrame({"path": [put_bytes(folder, name, encode(f))], "n": [len(f)]})

    return parts.groupBy(group, "_part").applyInPandas(put, "path string, n long")


def group_of(path: str, ending: str) -> tuple:
    """Columns of a file's group and part, from its path."""
    return F.regexp_extract(path, rf"([^/]+)-\d+\.{ending}$", 1), F.regexp_extract(path, rf"-(\d+)\.{ending}$", 1).cast("long")
