"""Field checks of account records (V1-V3) as a data-quality job.

Each rule is a boolean column (NULL in, NULL out); ``quality_report`` counts
failures per rule with one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The field rules.
USERNAME_PATTERN = "(?d)^[a-zA-Z0-9_-]{1,20}$"  # (?d): '$' also before one final '\n', as in Python
NAME_MIN_EXCL, NAME_MAX_EXCL = 1, 100
EMAIL_MIN_EXCL, EMAIL_MAX_EXCL = 2, 320


def username_ok(c: Column) -> Column:
    """V1: 1-20 letters, digits, '_' or '-'."""
    return c.rlike(USERNAME_PATTERN)


def name_ok(c: Column) -> Column:
    """V2: 1 < length < 100."""
    return (F.length(c) > NAME_MIN_EXCL) & (F.length(c) < NAME_MAX_EXCL)


def email_ok(c: Column) -> Column:
    """V3: contains '@' and 2 < length < 320."""
    return c.contains("@") & (F.length(c) > EMAIL_MIN_EXCL) & (F.length(c) < EMAIL_MAX_EXCL)


def check_accounts(df: DataFrame, username: str = "username", name: str = "name",
                   email: str = "email") -> DataFrame:
    return df.withColumns({
        "username_ok": username_ok(F.col(username)),
        "name_ok": name_ok(F.col(name)),
        "email_ok": email_ok(F.col(email)),
    })


def quality_report(checked: DataFrame) -> DataFrame:
    return checked.agg(*[F.count_if(~F.col(c)).alias(f"{c}_failures")
                         for c in ("username_ok", "name_ok", "email_ok")])
