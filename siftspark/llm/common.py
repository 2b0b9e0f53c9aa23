"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where it is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="siftspark-"))
        at = _OWN_DIR[0]
    return at.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes `df` as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftspark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the table of durable(); nothing may read it afterwards."""
    spark, path = df.sparkSession, df._durable_path
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of df has it (names do not differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int, most: int = 10_000) -> DataFrame:
    """left joined to right, whose keys `on` are unique and whose column n says how many rows of left have the key.

    Keys of over total / most rows (total: rows of left) go by broadcast, of which there are at most `most`, so that no
    hot key makes a hot task; all others are shuffled. left is read twice.
    """
    hot = F.broadcast(right.where(F.col("n") > total / most).drop("n"))
    rest = right.where(F.col("n") <= total / most).drop("n")
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(rest, on))


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the entropy of a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, for hashes of substrings by prefix sums."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """data: uint8; the result has one entry more."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hashes(self, prefix: np.ndarray, start, end) -> np.ndarray:
        """Of the substrings start:end; the same content gives the same hash at any place."""
        return mix64((prefix[end] - prefix[start]) * self.down[start])


def chunks_of(texts: list[bytes], limit: int = 1 << 20):
    """Lists of indices whose texts together have about `limit` bytes."""
    got, size = [], 0
    for i, t in enumerate(texts):
        if got and size + len(t) > limit:
            yield got
            got, size = [], 0
        got.append(i)
        size += len(t)
    if got:
        yield got
