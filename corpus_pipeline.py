"""The corpus pipeline of the training-data operators, at the place where it is looked for; see ``quillspan.llm.pipeline``."""

from quillspan.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
