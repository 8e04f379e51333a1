"""A corpus pipeline out of five operators of ``gridloom.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept;
what it returns is written as Parquet and read again before the next one. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from gridloom.llm import decontaminate, minhash, mixing, quality, token_blocks
from gridloom.llm.common import ensure_checkpoint_dir, table


def quality_classifier(spark, docs, sf_dir):
    """Documents with a quality score under 0.3 go.

    Every row is judged by itself: repeated rows and rows that share an id each by their own
    text, null and empty texts by the share of label 1. Without a labelled document, or with
    an empty ``labels``, all stay.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the least id stays.

    Of equal rows one stays, of texts that share an id and a group one. Rows without an id
    or without a word are copies of nothing and all stay.
    """
    return minhash.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none. Benchmark rows without a text are passed over; with an
    empty ``benchmark`` all documents stay. Each row is judged by its own text, rows that
    share an id too, so repeated rows go or stay together.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Every document as often as the mix draws it.

    A null source is a source of its own, last in order. Documents of size 0 add no words;
    a source with nothing else has target 0 and goes. Rows that share an id (a null one
    too) go by the most copies of one of them.
    """
    return mixing.emit(docs, mixing.mix(docs))


def token_output(spark, docs, sf_dir):
    """Token segments written and read back: a row a document, one for each copy.

    A null or empty text is its end id alone. An empty table gives no rows.
    """
    return token_blocks.encode_and_read(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("token output", token_output),
]

#: No SQL can express the classifier, the benchmark search or the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
