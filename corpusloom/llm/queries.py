"""Registered queries of this subpackage, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.chat import OP10_SQL, op10_chat
from corpusloom.llm.decontaminate import op7_decontaminate
from corpusloom.llm.language import op6_language
from corpusloom.llm.linededup import OP8_SQL, op8_line_dedup
from corpusloom.llm.minhash import OP1_SQL, op1_near_dedup
from corpusloom.llm.packing import op2_packing
from corpusloom.llm.quality import op4_quality
from corpusloom.llm.repair import OP13_SQL, op13_repair
from corpusloom.llm.secrets import op3_secrets
from corpusloom.llm.spelling import OP11_SQL, op11_spelling
from corpusloom.llm.substring import OP12_SQL, op12_substring_dedup
from corpusloom.llm.toxicity import op5_toxicity
from corpusloom.llm.tokenfiles import op9_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_chat": op10_chat,
    "op11_spelling": op11_spelling,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_repair": op13_repair,
}

ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op8_line_dedup": OP8_SQL, "op10_chat": OP10_SQL, "op11_spelling": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_repair": OP13_SQL}
