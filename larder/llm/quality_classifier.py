"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Only the text is scored; labels, language, source and id never are inputs of a score. At most TRAIN_ROWS labelled rows
are learnt from, those with the smallest hashes of their ids; a row is held out where
crc32 of its id, as text, leaves remainder 0 by 5.

Defined cases: a null or empty text is scored by the bias alone; labels that are null
are not learnt from; an id with several labels counts once, with the largest; without
labels every score is 0.5; of a repeated id one text is learnt from, the smallest, and
all rows are scored each for itself; ties of hashes go by id; long texts are read whole;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import hashed_linear
from larder.llm.common import crc_mod

TRAIN_ROWS = 8000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, y of at most `rows` labelled documents, one text of each id; the ids and labels, so bounded, are broadcast."""
    ids = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & learnable)
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("y"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    sample = labelled_sample(docs, labels, "quality", crc_mod(id_col, 5) != 0, rows, id_col, text_col)
    return hashed_linear.train(sample.withColumn("w", F.lit(1.0)), "ngrams", epochs=3, alpha=1.0, l1=0.05, l2=0.01)


def score_quality(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = hashed_linear.score(docs, weights, "ngrams", id_col, text_col)
    held = F.coalesce(crc_mod(id_col, 5) == 0, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
