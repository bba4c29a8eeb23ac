"""The corpus pipeline's stages, from the subpackage that holds its operators."""

from genoslate.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
