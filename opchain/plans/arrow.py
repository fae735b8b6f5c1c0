"""Arrow-batch functions over a frame, with this package sent to the executors first."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as St

_sent: set[str] = set()
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
FREE_BYTES = 32 << 20


def send_package(spark: SparkSession) -> None:
    """Adds this package's sources to the job's files, once for each application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parents[1]
    files = sorted(p for p in top.rglob("*.py"))
    mark = hashlib.sha256(b"".join(str(p.relative_to(top)).encode() + p.read_bytes() for p in files)).hexdigest()[:12]
    archive = Path(tempfile.mkdtemp()) / f"{top.name}-{mark}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in files:
            z.write(p, str(Path(top.name) / p.relative_to(top)))
    spark.sparkContext.addPyFile(str(archive.resolve()))
    _sent.add(app)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | St.StructType) -> DataFrame:
    """df.mapInArrow(fn, schema), in batches of BATCH_BYTES unless the session asks for less: each task holds some batches on both sides.

    A worker serves one task after the other, so it gives back what it has freed every FREE_BYTES of input and at the end of each task.
    """
    send_package(df.sparkSession)
    conf = df.sparkSession.conf
    if _bytes(conf.get(_LIMIT)) > BATCH_BYTES or _bytes(conf.get(_LIMIT)) <= 0:
        conf.set(_LIMIT, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(_counted(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        n += batch.nbytes
        yield batch
        del batch
        if n >= FREE_BYTES:
            n = 0
            give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system; Arrow's pool and the C library keep it else, where there is a call for that."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _bytes(text: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    number, unit = re.fullmatch(r"(-?\d+)([bkmg]?)b?", text.strip().lower()).groups()
    return int(number) * units[unit or "b"]
