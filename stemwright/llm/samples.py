"""Bounded samples that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNITS, _PROBE = 1 << 20, 64


def bounded_sample(rows: DataFrame, row_id: str, sample_rows: int) -> DataFrame:
    """About sample_rows of the rows, twice as many at most, picked by a hash of row_id; all if there are fewer.

    The number of rows is estimated on one hash class in 64, so no step reads all rows whole.
    """
    place = F.pmod(F.xxhash64(row_id), F.lit(_UNITS))
    probed = rows.filter(place < _UNITS // _PROBE).select(row_id).count()
    share = min(1.0, sample_rows / max(1, _PROBE * probed))
    return rows.filter(place < int(share * _UNITS)).limit(2 * sample_rows) if probed >= 8 else rows.limit(2 * sample_rows)
