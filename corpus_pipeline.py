"""The corpus pipeline of ``footfall.llm.pipeline``: its stages, their SQL and the run over all of them."""

from footfall.llm.pipeline import ORACLE_SQL, PIPELINE_MIX, STAGES, run

__all__ = ["ORACLE_SQL", "PIPELINE_MIX", "STAGES", "run"]
