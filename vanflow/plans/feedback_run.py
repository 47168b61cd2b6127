"""The feedback run: window, attribution, filtering, multipliers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vanflow.config import CLAMPS, Clamps
from vanflow.operators import feedback as fb
from vanflow.session import cut_lineage


def feedback_run(
    recs: DataFrame, sessions: DataFrame, previous: DataFrame, today: str, c: Clamps = CLAMPS,
    materialise=cut_lineage,
) -> DataFrame:
    """Multipliers per route and source for the next recommendation run."""
    days = fb.window_days(c)
    attribution = fb.build_attribution(
        fb.in_window(recs, "TrxDate", today, days), fb.in_window(sessions, "date", today, days)
    )
    clean = fb.drop_adversarial_sessions(materialise(attribution), c)
    return fb.smoothed_multipliers(fb.shrunk_multipliers(clean, c), previous, c)
