"""The corpus pipeline: STAGES, run() and ORACLE_SQL, as written in ``docforge.llm.stages``.

Toxicity, near duplicates, repeated strings, contamination and encoding, in
this order; see there for what each stage keeps.
"""

from docforge.llm.stages import COLUMNS, ORACLE_SQL, STAGES, contaminated, encoded, near_duplicates, repeated_strings, run, toxic

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "contaminated", "encoded", "near_duplicates", "repeated_strings", "run", "toxic"]
