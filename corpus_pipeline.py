"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet and reads it back as the
next stage's ``docs``. The stages are those of :mod:`tessella.llm.pipeline`.
"""

from tessella.llm.pipeline import ORACLE_SQL, STAGES, decontaminate, near_dedup, packing, quality, repeats, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminate", "near_dedup", "packing", "quality", "repeats", "run"]
