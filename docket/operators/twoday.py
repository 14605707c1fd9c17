"""The two-day run (X13): label both days, filter, match across days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, TriageConfig
from .dedup import filtered, label_similar_with_rejects
from .match import match_days
from .nearcopy import _cut


def two_day_report(notices: DataFrame, prev_day, cur_day, judge, cfg: TriageConfig = DEFAULT):
    """(report, rejected): the filtered notices of ``cur_day`` with ``noccur``,
    ``similar`` and the ``match_row`` of yesterday, and the notices of both
    days (and of no day) that cannot be labelled, with a ``reason``."""
    day = F.col(cfg.day)
    both = notices.where(day.isNull() | day.isin(prev_day, cur_day))
    labelled, rejected = label_similar_with_rejects(both, cfg)
    kept = filtered(_cut(labelled), cfg)  # read by both days
    return match_days(kept.where(day == prev_day), kept.where(day == cur_day), judge, cfg), rejected
