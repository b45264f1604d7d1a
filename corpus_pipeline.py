"""Language identification, near-duplicate removal, secret scanning and packing of the documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before has kept. A stage's result is written
as Parquet to the cluster's shared folder and read again by the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import shared_folder, vocabulary_path
from parley.llm.jaccard_join import one_of_each_group
from parley.llm.language_id import predict_languages, train
from parley.llm.packing import pack_texts
from parley.llm.secrets import redact_live

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A text stays if its words' mean posterior for its language is at least this.
LEAST_SCORE = 0.35


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay, with that language as lang; texts without letters or of no clear language go.

    Where nothing can be learned, since no row has a language, only texts without letters go.
    """
    model = train(docs, F.lit(True))
    found = predict_languages(docs.select(*COLUMNS), model, passed=tuple(c for c in COLUMNS if c != "doc_id"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at a similarity of 0.8 over five-word shingles stays: that of least id.

    Rows without an id are chosen last, texts without words all stay, and of rows equal in id and text one stays. Two texts
    that do not link both stay, whatever their ids.
    """
    return one_of_each_group(docs.select(*COLUMNS), percent=80, width=5)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the value of each live-looking credential is replaced in the text, and n_chars counts anew.

    Null and empty texts, repeated rows and rows without id stay as they are.
    """
    clean = redact_live(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, with their texts, exact token counts and places in training sequences.

    Null and empty texts are one piece, an end token; repeated rows and rows without id are packed like others.
    """
    return pack_texts(docs, vocabulary_path("word_bpe_49k.json"), keep=True, memo=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and iterated components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; an empty table passes through them.

    A stage's folder is removed when the next one has been written; the last one is the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(at := f"{folder}/{k}-{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(at), at
    return docs
