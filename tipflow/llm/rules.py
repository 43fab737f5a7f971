"""Operator 10: quality rules as gradient-boosted trees over document statistics.

Base rules fail documents of few words, or mostly of words in repeated 3-word windows.  The others
are judged by boosted trees over ``stats.FEATURES``, trained on labelled documents, with
monotone constraints: more symbols, repeated lines and repeated words never raise the score, more
distinct words never lower it.  Trees are flat numpy arrays and score whole batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipflow.llm import gbt, stats
from tipflow.llm.common import collected, written
from tipflow.llm.quality import labelled, scored

MIN_WORDS = 50
REPEAT_PERCENT = 50
CUT = 0.3
# The trees learn from at most so many labelled rows: those with the smallest hashes of their statistics.
SAMPLE = 50_000
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeat_words": -1, "distinct_words": 1}


def train(rows: DataFrame, label: str, sample: int = SAMPLE) -> gbt.Boosted:
    """Trees from ``rows (features, label)``, label 0 or 1."""
    got = collected(rows.where(F.col(label).isin(0, 1)).select("features", F.col(label).alias("y"))
                    .orderBy(F.xxhash64("features"), "features", "y").limit(sample))
    x = np.array(got["features"].tolist(), float).reshape(len(got["y"]), len(stats.FEATURES))
    return gbt.fit(x, got["y"].astype(float), [MONOTONE.get(f, 0) for f in stats.FEATURES])


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = CUT, min_words: int = MIN_WORDS,
          repeat_percent: int = REPEAT_PERCENT, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, COUNTS..., score, base_failed, kept) of every row of ``docs (doc_id, text)``.

    ``labels (doc_id, <label> 0 or 1)``: other values and nulls teach nothing.  Rows that fail a base
    rule are not kept; the others are if their score reaches ``cut``.  Null and empty texts have no
    words and fail.  If only one class is labelled (or none), the base rules alone decide.  Repeated
    rows each give a row.  Other columns are not read.  An empty table gives an empty result.
    """
    rows = written(stats.measured(docs.select("doc_id", "text"), ["doc_id"]), "statistics")
    model = train(labelled(rows, labels, label), "_label", sample)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    accepted = (F.col("score") >= cut) if model.roots else F.lit(True)
    return (scored(rows, model, ["doc_id", *stats.COUNTS]).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & accepted))
