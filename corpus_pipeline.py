"""The corpus pipeline: each stage's rows are written as Parquet and read by the next.

Every stage judges each row by its own verdict: rows without an id, of one id or equal in
every column, empty and very long texts and extra columns have the results that the stage
functions state. An empty table stays empty. The first three stages return the columns of
documents as they are; mixing returns them with mix_position and mix_copy after them, the
place of a copy in the training order, since files read back need not keep an order; the
last stage passes those two on.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import collecting, delete, stored
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.mixture import mix_documents
from tidemark.llm.quality_classifier import drop_rejected
from tidemark.llm.sentencepiece import encode_corpus
from tidemark.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of stages whose rows may still be read, by thread, input and the stage's place.
_LEFT: dict[tuple[int, str, int], list[str]] = {}


def _stage(place: int, operator: Stage) -> Stage:
    """The operator; scratch tables of earlier stages of this thread's run on this input go first.

    They have been read when their stage's rows were written. If ``docs`` still reads
    them (stages chained without a write between), they stay.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        here = threading.get_ident(), sf_dir
        before = [key for key in _LEFT if key[:2] == here and key[2] < place]
        if before:
            read = docs.inputFiles()
            for key in before:
                if not any(path.rsplit("/", 1)[-1] in f for path in _LEFT[key] for f in read):
                    delete(spark, *_LEFT.pop(key))
        with collecting() as mine:
            out = operator(spark, docs, sf_dir)
        _LEFT[(*here, place)] = [*_LEFT.get((*here, place), []), *mine]
        return out

    return run_stage


STAGES = [
    (name, _stage(place, operator))
    for place, (name, operator) in enumerate(
        [
            ("quality classifier", drop_rejected),
            ("toxicity", drop_toxic),
            ("n-gram Jaccard join", one_of_each),
            ("mixing sources to target weights", mix_documents),
            ("SentencePiece encoding and decoding", encode_corpus),
        ]
    )
]

#: The classifiers' fits and the Viterbi encoding have no SQL form; tests/llm/test_round2.py compares the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        with collecting() as mine:
            docs = stored(made, name.replace(" ", "-"))
        delete(spark, *last)
        last = mine
    return docs
