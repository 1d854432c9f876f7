"""What the operators of this subpackage share: batches to Python workers, held-out rows, and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseloom.sources.shared import drop_settled, settle, shared_folder, small

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "drop_settled", "held_out", "narrow", "settle", "shared_folder", "small"]

#: A side of a join with rows of small fixed width is broadcast up to so many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: Bytes of one Arrow batch on its way to a Python worker, where the session leaves the limit at its default.
BATCH_BYTES = 8 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow(df: DataFrame) -> DataFrame:
    """The same rows, with batches to Python workers bounded by bytes: a worker's memory does not follow text lengths."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_LIMIT, "268435456").rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df


def held_out(id_col: str):
    """Rows kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
