"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes.split() cuts at exactly these bytes, and bytes.lower() changes A-Z only;
#: every operator's words are the maximal runs of other bytes of the UTF-8 text.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch in eager steps, at most.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the cluster's shared folder, the session's ``spark.checkpoint.dir``.

    Where that is unset a single machine gets a temporary folder; a cluster is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="driftline-"))
    # batches of texts take memory in the executor and in its Python workers, several at a time
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, str(min(int(was), ARROW_ROWS)) if int(was) > 0 else str(ARROW_ROWS))
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set(key, was)


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    They go when the driver's JVM collects the objects that stand for them, which a driver with little to do puts off.
    Those of the last job went sooner, as observed, when another job ran in between, so one task without a shuffle comes first.
    """
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    for _ in range(2):  # the JVM hears of Python's objects a little later
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def trimmed(batches, release=None):
    """The batches; once they are over, the Python worker, which outlives its task, lets go of what it kept and gives memory back."""
    try:
        yield from batches
    finally:
        if release is not None:
            release()
        trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(docs: DataFrame, text_col: str, bytes_each: int, least: int = 64) -> int:
    """Number of hash buckets of which each meets what about so many bytes of text give."""
    total = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    return max(least, -(-total // bytes_each))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; DRIFTLINE_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("DRIFTLINE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces(batches, rows: int = 512):
    """Record batches cut to a bounded number of rows, so that memory is bounded too."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def remainder(col, modulus: int):
    """crc32 of the decimal text of an id, modulo a number."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


_owner: list = [None, None]


def claim(owner: str, release) -> None:
    """Says that a worker's kept values are ``owner``'s from now on; another owner's are released.

    Python workers outlive their tasks, so the stages of a pipeline would otherwise add up.
    """
    if _owner[0] != owner:
        if _owner[1] is not None:
            _owner[1]()
        _owner[:] = [owner, release]
