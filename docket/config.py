"""Column names and options shared by the operators.

One config object names the columns of a notice table and carries the
parameters of the near-copy rule, so every operator works on any table with a
key column and a text column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

# Fixed values that must equal the reference's behaviour.
MARKER = "Intimado(s)/Citado(s):"   # token that precedes the addressee block
MARKER_WINDOW = 5                   # tokens looked at before the first difference
ROW_OFFSET = 2                      # spreadsheet row = 0-based row id + header + 1
ELIGIBLE_JOURNAL_PREFIX = "D J E N"  # journals whose cases are matched across days
UNDECIDED = -1                      # value of `similar` / `match_row` when undecided


@dataclass(frozen=True)
class TriageConfig:
    key: str = "processo"
    text: str = "intimacao"
    journal: str = "jornal"
    row_id: str = "row_id"
    day: str = "dia"
    marker: str = MARKER
    window: int = MARKER_WINDOW
    # True reproduces Python slice rules for a window that starts before
    # token 0 (a negative start counts from the end); False clamps at 0.
    python_slices: bool = True
    row_offset: int = ROW_OFFSET
    journal_prefix: str = ELIGIBLE_JOURNAL_PREFIX
    # Heads a near-copy round compares each remaining row of a group with: the
    # rounds grow 1, 64, ... up to pair_budget / n heads for a group of n
    # remaining rows, at least max_heads and at most wide_heads.  Small groups
    # of many distinct notices then need few rounds, and a round of a hot
    # group costs max_heads x n diffs.
    max_heads: int = 64
    wide_heads: int = 1000
    pair_budget: int = 1 << 20

    def with_columns(self, **kw) -> "TriageConfig":
        return replace(self, **kw)

    def check(self, df: DataFrame, need_journal: bool = False) -> None:
        """Fail early, naming every missing column."""
        need = [self.key, self.text, self.row_id, self.day]
        if need_journal:
            need.append(self.journal)
        missing = [c for c in need if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}; have {df.columns}")


DEFAULT = TriageConfig()
