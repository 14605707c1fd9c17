"""docket: triage of daily notice batches on Spark.

Typical use::

    from docket import TriageConfig, label_similar, filtered, match_days, TableJudge
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python workers may not have this package on their path (a cluster, or a
# driver that imported it from a folder): functions defined here -- the diff
# UDFs, the workbook parser -- are shipped by value with the tasks.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .config import DEFAULT, TriageConfig  # noqa: E402
from .operators.dedup import (case_frequency, duplicate_row_ids, exact_copy_leaders, filtered,
                              label_similar,
                              label_similar_with_rejects, rejected_notices, representatives, undecided)
from .functions.text import words_only
from .operators.match import (CallableJudge, OfflineJudge, StoredJudge, TableJudge, asked_questions, eligible_cases,
                              first_matches, match_days, parse_verdict, verdict_request)
from .operators.quality import check_accounts, quality_report
from .operators.ranking import rank_within
from .operators.report import (cross_day_summary, day_summary, key_difference, new_cases,
                               repeated_cases, review_highlight, undecided_per_case)
from .operators.scorejoin import similar_pairs
from .operators.similarity import tfidf_cosine
from .operators.twoday import two_day_report
from .sources.days import (assign_row_ids, read_days, read_days_checked, write_checked, write_days,
                           write_labelled_and_filtered)
from .sources.landing import (commit_landing, content_type, files_from_binary, land, list_prefix,
                              manifest_count, manifest_files, manifest_rejects, plan_landing, stored_catalog)
from .sources.workbook import read_workbooks, workbook_errors, workbook_table

__all__ = [
    "DEFAULT", "TriageConfig", "case_frequency", "duplicate_row_ids", "exact_copy_leaders", "filtered", "label_similar",
    "label_similar_with_rejects", "representatives", "undecided", "CallableJudge", "OfflineJudge",
    "TableJudge", "eligible_cases", "first_matches", "match_days", "parse_verdict", "verdict_request",
    "check_accounts", "quality_report", "rank_within", "cross_day_summary", "day_summary",
    "key_difference", "new_cases", "repeated_cases", "review_highlight", "undecided_per_case",
    "tfidf_cosine", "assign_row_ids", "read_days", "write_days", "write_labelled_and_filtered",
    "content_type", "list_prefix", "manifest_count", "manifest_files", "plan_landing",
    "read_workbooks", "workbook_table", "workbook_errors", "asked_questions", "rejected_notices",
    "two_day_report", "commit_landing", "files_from_binary", "stored_catalog", "land", "StoredJudge",
    "similar_pairs", "read_days_checked", "write_checked", "words_only", "manifest_rejects",
]
