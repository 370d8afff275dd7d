"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination and packing in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Each works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.decontaminate import decontaminate_stage
from corpusloom.llm.encode import default_tokenizer
from corpusloom.llm.linededup import line_dedup_stage
from corpusloom.llm.minhash import near_dedup_stage
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import quality_stage
from corpusloom.runtime import Scratch, discard, table


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of packed sequences with their token ids.

    Null and empty texts are one end token; repeated rows and null ids are packed row by row; documents of
    equal length go in the order of their rows; an empty table gives no pieces; other columns are not read.
    """
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the stages (hashed ratios, sketches, tokens); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read back.

    What a stage wrote on its way is deleted with it, and its table once the next one is written; the
    table of the last stage but one stays for the pieces that are read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with Scratch(spark, owns=True) as scratch:
            docs = scratch.result(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, *before)
        before = [docs.inputFiles()[0].rsplit("/", 1)[0]] if docs.inputFiles() else []
    return STAGES[-1][1](spark, docs, sf_dir)
