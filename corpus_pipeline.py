"""From raw documents to packed training sequences: five stages, each a table.

Every stage reads what the one before wrote; all but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.langid import fit_languages, held_out, identify
from threadloom.llm.mixing import mixed_documents
from threadloom.llm.ngram_join import link_documents
from threadloom.llm.packing import pack_documents
from threadloom.llm.queries import query, table, tokenizer_path
from threadloom.llm.shared import Scratch
from threadloom.llm.suffix_dedup import drop_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models don't reject; ``lang`` becomes the language found."""
    model = fit_languages(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    found = identify(docs, model).where(~F.col("__rejected"))
    return found.select(*[F.col("__lang").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies; documents without words and null ids stay."""
    linked = link_documents(docs)
    gone = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that occur earlier in the corpus; ``n_chars`` follows."""
    cut = drop_repeats(docs, as_text=True)
    new = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their token ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("mix_sources", mixed),
    ("pack_documents", packed),
]

#: Language models, pivotal draws and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
