"""Helpers shared by the training-data operators."""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from ..sources.folders import Folder

#: ASCII white space, the separators of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\r\x0b\x0c"


_SCRATCHES: list[Scratch] = []


class Scratch:
    """The intermediate tables written within a ``with`` block.

    What an operator returns is computed from them when it is read, so they can go once its
    rows have been written elsewhere: ``keep_last`` removes all but the newest table.
    """

    def __enter__(self) -> Scratch:
        self.paths: list[str] = []
        _SCRATCHES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCRATCHES.remove(self)

    def keep_last(self, spark: SparkSession) -> None:
        for path in self.paths[:-1]:
            Folder(spark, path).remove_all()
        del self.paths[:-1]

    def remove(self, spark: SparkSession) -> None:
        for path in self.paths:
            Folder(spark, path).remove_all()
        self.paths.clear()


#: Removes the shuffle files of a DataFrame's action when it has ended.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame | Iterable[DataFrame], name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` (several: one after the other, to one table) once as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: later stages, and tasks that are run again after an
    executor is lost, read the files instead of computing the rows anew. ``tidy``: the
    shuffle files behind it go at once, and not when the driver collects its garbage.
    """
    parts = iter([df] if isinstance(df, DataFrame) else df)
    df = next(parts)
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    if tidy:
        before = spark.conf.get(_TIDY, None)
        spark.conf.set(_TIDY, "true")
        try:
            for part in chain([df], parts):
                part.write.mode("append").parquet(path)
        finally:
            spark.conf.set(_TIDY, before) if before is not None else spark.conf.unset(_TIDY)
    else:
        for part in chain([df], parts):
            part.write.mode("append").parquet(path)
    for scratch in _SCRATCHES[-1:]:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def texts(column: pa.Array) -> list[str]:
    """Values of a string column; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (all arithmetic modulo 2**64)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: int) -> int:
    """A 64-bit unsigned integer as Spark's signed ``bigint``."""
    return x - (1 << 64) if x >> 63 else x
