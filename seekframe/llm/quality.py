"""Quality rules: compression bands.

The zstandard ratio (bytes / compressed bytes) of a whole document, and of each of its fixed-size chunks, is
held against limits that depend on the length compressed, as short texts compress less well.  A ratio above
its band is repetitive text, one below it incompressible text.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bytes from, least ratio, greatest ratio).  Below 64 bytes the frame's header outweighs the text.
BANDS = (
    (0, 0.0, 2.0),
    (64, 0.7, 2.2),
    (128, 0.9, 2.6),
    (256, 1.1, 2.8),
    (512, 1.25, 3.0),
    (1024, 1.35, 3.2),
    (2048, 1.4, 3.5),
    (4096, 1.45, 4.0),
    (16384, 1.5, 4.5),
)
CHUNK_BYTES = 4096
#: A document is rejected if more than this share of its chunks lie above, or below, their bands.
CHUNK_SHARE = 0.3
LEVEL = 3

MEASURES = "n_bytes bigint, ratio double, n_chunks int, high_chunks int, low_chunks int, keep boolean, reason string"


def measure(text: str | None, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE, compressor=None) -> tuple:
    """The measures of one text, as in MEASURES."""
    compressor = compressor or zstandard.ZstdCompressor(level=LEVEL)
    if text is None:
        return 0, None, 0, 0, 0, False, "null"
    data = text.encode("utf-8", "replace")
    if not data.strip():
        return len(data), None, 0, 0, 0, False, "empty"
    froms = [b[0] for b in bands]

    def side(piece: bytes) -> tuple[float, int]:
        ratio = len(piece) / len(compressor.compress(piece))
        _, low, high = bands[bisect_right(froms, len(piece)) - 1]
        return ratio, (ratio > high) - (ratio < low)

    ratio, whole = side(data)
    sides = [whole] if len(data) <= chunk_bytes else [side(data[i : i + chunk_bytes])[1] for i in range(0, len(data), chunk_bytes)]
    high, low = sides.count(1), sides.count(-1)
    reason = (
        "repetitive" if whole > 0 else "incompressible" if whole < 0
        else "repetitive_chunks" if high > chunk_share * len(sides)
        else "incompressible_chunks" if low > chunk_share * len(sides) else None
    )
    return len(data), ratio, len(sides), high, low, reason is None, reason


def compression_bands(text: Column, bands=BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_share: float = CHUNK_SHARE) -> Column:
    """The measures of a text column as a struct, one Arrow batch at a time."""

    @F.pandas_udf(MEASURES)
    def bands_udf(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        rows = [measure(t, bands, chunk_bytes, chunk_share, compressor) for t in texts]
        out = pd.DataFrame(rows, columns=["n_bytes", "ratio", "n_chunks", "high_chunks", "low_chunks", "keep", "reason"])
        return out.astype({"ratio": "float64", "keep": "bool"})

    return bands_udf(text)


def quality_report(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **limits) -> DataFrame:
    """doc_id and measures of every row: a map without a shuffle.

    A null text is rejected as "null", one of white space alone as "empty".  Repeated rows are measured alike,
    an empty table gives none, a null id is passed on, other columns aren't read, and a very long text is
    compressed whole and in all its chunks.  A ratio equal to a limit lies within the band.
    """
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), compression_bands(F.col(f"`{text_col}`"), **limits).alias("m")).select("doc_id", "m.*")


def quality_filter(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of docs within the bands, with all their columns; null and empty texts go.

    The other cases are as in quality_report().
    """
    return docs.filter(compression_bands(F.col(f"`{text_col}`"), **limits).getField("keep"))
