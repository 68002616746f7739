"""What the operators of this folder share: column picking, the shared folder, chunking of Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns new=old of df and no others.

    Names are matched exactly and by position, so columns that differ only in
    case, repeat a name or clash with a result column do no harm: of several
    with the same name the first counts, all others are pruned from the scan.
    """
    at = {new: df.columns.index(old) for new, old in wanted.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(plain[f"c{i}"].alias(new) for new, i in at.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        own = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(f"file://{own}")
        known = sc.getCheckpointDir()
    return known.rstrip("/")


_settled: dict[str, SparkSession] = {}


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage is cut and survives lost executors.

    What isn't dropped before goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    if not _settled:
        atexit.register(_drop_all)
    _settled[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for path, spark in list(_settled.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def drop_settled(df: DataFrame) -> None:
    """Removes what settle() wrote, once nothing will read it again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quern-" in path:
            _delete(df.sparkSession, path)
            for known in [k for k in _settled if k.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]]:
                del _settled[known]


def chunks(texts: Sequence[str | None], most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most_bytes each; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most_bytes:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)


def batches(it: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut in halves until none of several rows has more than most_bytes; empty ones are left out."""
    for b in it:
        todo = [b] if b.num_rows else []
        while todo:
            x = todo.pop()
            if x.num_rows > 1 and x.nbytes > most_bytes:
                h = x.num_rows // 2
                todo += [x.slice(h), x.slice(0, h)]
            else:
                yield x
