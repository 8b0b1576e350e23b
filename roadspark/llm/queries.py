"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from roadspark.llm import exact_dedup, language, lattice, mixing, packing, privacy, quality, records, repeats, simhash

QUERIES = {
    "op1_quality": quality.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_pseudonyms": privacy.query,
    "op4_records": records.query,
    "op5_lattice": lattice.query,
    "op6_simhash": simhash.query,
    "op7_packing": packing.query,
    "op8_language": language.query,
    "op9_mixing": mixing.query,
    "op10_repeats": repeats.query,
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.SQL, "op9_mixing": mixing.SQL}
