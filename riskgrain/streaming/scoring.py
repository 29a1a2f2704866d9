"""The record contract and policy on a streaming frame: row-local rules, no state of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrain.operators import records


def score_stream(
    stream: DataFrame,
    specs: Sequence[records.FieldSpec],
    scorer,
    policy: Mapping[str, float],
    event_time: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Tag every record with its errors; valid ones also get a band and a priority flag.

    With ``event_time`` repeated record ids inside the watermark are dropped, which bounds the state.
    """
    if event_time is not None:
        stream = stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["record_id"])
    validated = records.validate_records(stream, specs, check_ids=False)
    scored = records.apply_policy(scorer(validated), policy)
    valid = F.size("errors") == 0
    return scored.select(
        "record_id",
        F.array_join(F.transform("errors", lambda e: e["code"]), ";").alias("error_codes"),
        F.when(valid, F.col("score")).alias("probability"),
        F.when(valid, F.col("risk_band")).alias("risk_band"),
        F.when(valid, F.col("priority_review")).alias("priority_review"),
    )
