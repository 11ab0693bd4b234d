"""From documents to mixed, placed training text, stage by stage.

Every stage but the last returns the columns of documents, with their values, whatever other columns
there are and what they are called. Null and empty texts, and those without a letter, go with language ID.
Rows that repeat an id and a text become one; ties go to the least id. A null source is a
source, a null id an id. No rows give no rows at every stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm import decontamination, language, mixing, near_duplicates, sharding
from lockstep.llm.common import settle, shielded, table

# The least share of the way from what a language gets without any evidence to certainty.
LEAST_MARGIN = 0.12


def least_scores(model: language.Model) -> dict[str, float]:
    """For each language the score below which a document is rejected; more than its prior, whatever their number."""
    if not model.languages:
        return {}
    prior = model.probabilities(np.zeros((1, language.FEATURES), np.float32))[0]
    return {x: float(p + LEAST_MARGIN * (1 - p)) for x, p in zip(model.languages, prior, strict=True)}


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language (operator 1): those without letters or of no clear language go."""
    model = language.learn(docs)
    safe, back = shielded(docs, ["doc_id", "text", "lang"])
    found = language.predict(safe, model)
    least = [F.lit(x) for pair in least_scores(model).items() for x in pair] or [F.lit(language.UNKNOWN), F.lit(1.0)]
    clear = found["score"] >= F.element_at(F.create_map(*least), found["lang_pred"])
    kept = found.where((found["lang_pred"] != language.UNKNOWN) & clear)
    return back(kept.select(safe.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates (operator 8)."""
    return near_duplicates.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaked (operator 6)."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights (operator 9): rows repeat or go by rate."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place among 24 shards for every row (operator 5)."""
    return sharding.shard(docs, sharding.tree())


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]
# A classifier and similarities can't be said in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows settled for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
