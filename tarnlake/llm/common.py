"""Shared plumbing: the cluster's shared folder, written tables that cut lineage, tokenizer files."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where neither that setting nor a checkpoint directory exists, a
    temporary folder is made and set as checkpoint directory; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tarnlake-")
        atexit.register(shutil.rmtree, own, True)
        path = "file://" + own
        spark.conf.set("spark.checkpoint.dir", path)
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: a lost executor costs its running tasks, never what has
    been written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than 1/MOST_BROADCAST of all rows are joined by broadcast; so there are fewer of them.
MOST_BROADCAST = 2_000


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row for each key and in
    ``size_col`` how many rows have it.

    The few keys that many rows have go by broadcast, so that no task of the join by key
    gets more than its share.  Null keys match nothing.
    """
    total = facts.agg(F.sum(size_col)).head()[0] or 0
    hot = F.col(size_col) > total / MOST_BROADCAST
    few = F.broadcast(facts.filter(hot))
    common = rows.join(few, keys)
    rest = rows.join(few.select(*keys), keys, "left_anti").join(facts.filter(~hot), keys)
    return common.unionByName(rest)


def packed(x: np.ndarray) -> bytes:
    """An array's bytes by place (all first ones, all second ones, ...), compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_CACHES: list = []


def per_worker(make):
    """Decorator: what ``make`` returns is kept in a worker for its next tasks."""
    kept = lru_cache(maxsize=2)(make)
    _CACHES.append(kept)
    return kept


def keep_only(kept) -> None:
    """Workers go on from one operator to the next: an operator drops what the others have kept."""
    for c in _CACHES:
        if c is not kept:
            c.cache_clear()
    give_back()


#: glibc's numbers for the size from which on an allocation is a mapping of its own, and for the free end that the heap keeps; what they are set to.
M_MMAP_THRESHOLD, OWN_MAPPING = -3, 1 << 19
M_TRIM_THRESHOLD, FREE_END = -1, 1 << 24


@lru_cache(maxsize=1)
def _trim():
    """glibc's malloc_trim; large arrays become mappings, which go back as soon as they are freed."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(M_MMAP_THRESHOLD, OWN_MAPPING)
        libc.mallopt(M_TRIM_THRESHOLD, FREE_END)
        return libc.malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """What has been freed goes back to the system: workers outlive their tasks, and what each of
    them needed at most would stay with it, in an executor whose memory they share."""
    _trim()(0)
    pa.default_memory_pool().release_unused()


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
