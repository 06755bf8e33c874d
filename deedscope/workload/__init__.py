"""Named queries over the given tables, each with the SQL of the same result where SQL has one."""

from deedscope.workload import cleaning, ledger, modelling, profiles, retrieval, series, storage  # noqa: F401
from deedscope.workload.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
