"""Imports every module that registers queries."""

from workload import q_buckets, q_delivery, q_documents, q_files, q_gold, q_increments, q_lineage, q_profile, q_report, q_revisions, q_rows  # noqa: F401
