"""The audit of traces as they arrive: claims are grounded row by row, and counted in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grounding


def audit_stream(traces: DataFrame, text: str, at: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window_start, kind, n_claims, n_ungrounded of direct claims. traces: a stream with ``tools``, a text and an event time.

    State is a row for each window and kind until the watermark has passed it; rows later than ``late`` are left out.
    """
    rows = traces.withWatermark(at, late).select(at, text, "tools")
    claims = grounding.ground(grounding.explode_claims(rows, text)).where("role = 'direct'")
    counts = claims.groupBy(F.window(at, window).alias("w"), "kind").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("grounded")).alias("n_ungrounded"))
    return counts.select(F.col("w.start").alias("window_start"), "kind", "n_claims", "n_ungrounded")
