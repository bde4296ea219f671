"""Documents to training sequences: the stages, the SQL of their result, and their run, from the package."""

from __future__ import annotations

from recordlens.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
