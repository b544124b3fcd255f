"""A training-corpus pipeline over documents: language, near-duplicates, contamination, secrets, mixture.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.

language_id: documents without a language go: those without a letter, and those in which no learned language stands out (score below FLOOR); a
   null lang becomes the predicted one.
simhash_near_dedup: of each class of near-duplicates (five-word shingles, Jaccard similarity of 0.8 or more, all pairs: quern.llm.near_text, which
   joins what SimHash finds first) one document stays, that with the smallest doc_id; one without a doc_id comes last.
decontamination: contaminated documents go.
secret_scan: every secret is replaced by a mask; n_chars follows the text. No document goes.
mixing: each document comes as often as the mix takes it, with the number of the copy.

In every stage nulls, empty texts and repeated rows are judged as the operators' docstrings say, row by row; extra columns stay, whatever their
names (working columns are named __x__), and an empty table gives an empty table. Ties arise in the second stage (equal doc_ids: the row that was read first)
and in the mix (rows alike in all columns) only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, language, mixing, near_text, secret_scan, simhash
from quern.llm.common import cut
from quern.storage import cuts, release

#: Least score of a document that has a language; of 10,000 documents at scale 0.1 none that has a letter scores less.
FLOOR = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.train(docs), label="__lang__", score="__score__")
    kept = found.where((F.col("__lang__") != "und") & (F.col("__score__") >= FLOOR))
    if "lang" in docs.columns:
        kept = kept.withColumn("lang", F.coalesce("lang", F.col("__lang__").cast(docs.schema["lang"].dataType)))
    return kept.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, by=near_text.classes)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="__found__")
    return found.where(~F.col("__found__.contaminated")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.masked(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


#: Tables that the last stage has cut for itself, by application.
_MADE: dict[str, list[str]] = {}


def stage(work, first: bool):
    """work, after the tables that the stage before it has cut for itself are deleted: by then its docs have been written. Those that docs still
    read stay, if someone has not written them; and the first stage deletes nothing, as a result of an earlier run may be yet to be read."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if not first:
            release(spark, _MADE.pop(app, []), keep=docs)
        before = set(cuts(spark))
        out = work(spark, docs, sf_dir)
        _MADE[app] = [p for p in cuts(spark) if p not in before]
        return out

    return run_


_WORK = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("mixing", mixture)]
STAGES = [(name, stage(work, i == 0)) for i, (name, work) in enumerate(_WORK)]

#: No stage before the last is SQL; the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = cut(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
