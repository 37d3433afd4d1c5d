"""The corpus pipeline: its stages, what runs them all, and the SQL they are held against (none)."""

from indexloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
