"""From samples with verdicts to scores, rankings, files and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import verdicts as vd
from millrace.operators.bounds import settle
from millrace.sinks import tables as out


def write_comparison(samples: DataFrame, folder: str, title: str, written_at: str) -> None:
    """`results/model_key=*`, `summary` (positions per metric) and `report`.

    The samples (model, benchmark, passed, and optionally error) are read once; what
    follows works on the scores.
    """
    good = vd.without_errors(samples) if "error" in samples.columns else samples
    scores, _ = settle(vd.scores(good))
    out.write_by_model(scores, f"{folder}/results")
    vd.leaderboard(vd.metric_rows(scores)).write.json(f"{folder}/summary")
    out.write_report(vd.report_lines(scores, title, written_at), f"{folder}/report")
