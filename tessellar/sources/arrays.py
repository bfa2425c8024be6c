"""Dense arrays in .npy files as rows, a file a partition."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.session import shared_dir
from tessellar.sources.files import group_of, write_parts


def read_npy(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """path, row (index along the first axis), values (the rest, flat) of every matching file below the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def rows(batches):
        for f in batches:
            for path, content in zip(f.path, f.content, strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                flat = a.reshape(len(a), -1).astype(float)
                yield pd.DataFrame({"path": path, "row": np.arange(len(a)), "values": list(flat)})

    return files.select("path", "content").mapInPandas(rows, "path string, row long, values array<double>")


def write_npy(df: DataFrame, group: str, columns: Sequence[str], folder: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Arrays of each group (rows in the order of the columns), cut into files of bounded length; lists path and length."""
    columns = list(columns)

    def encode(f: pd.DataFrame) -> bytes:
        out = io.BytesIO()
        np.save(out, f[columns].to_numpy(float))
        return out.getvalue()

    return write_parts(df, group, columns, columns, folder, "npy", encode, rows_per_file)


def round_trip(df: DataFrame, group: str, index: Sequence[str], value: str) -> DataFrame:
    spark = df.sparkSession
    folder = os.path.join(shared_dir(spark), f"npy-{uuid.uuid4().hex}")
    write_npy(df, group, [*index, value], folder).agg(F.sum("n")).collect()
    back = read_npy(spark, folder)
    return back.select(group_of("path", "npy")[0].alias(group), *[F.col("values")[k].cast("int").alias(c) for k, c in enumerate(index)], F.round(F.col("values")[len(index)], 6).alias(value))
