"""A corpus from raw documents: languages, repeated lines, near duplicates, benchmark passages, and the mix of sources.

Each stage is written as Parquet and read again as the next one's documents. All stages but the last return the columns of documents, whatever their names.
Null and empty texts are in no language and go first. Very long texts are read whole. An empty table stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import common, decontaminate, jaccard_join, language_id, line_dedup, mixing


def _content(docs: DataFrame, *columns: str) -> Column:
    """A hash of these columns of docs that tells null from empty."""
    return F.xxhash64(*[x for c in columns for x in (docs[c].isNull(), F.coalesce(docs[c].cast("string"), F.lit("")))])


def _by_row(docs: DataFrame) -> Column:
    """Names a row by what is in it: rows that repeat a doc_id with other texts, and rows without one, are told apart; equal rows are not."""
    return _content(docs, "doc_id", "text", "lang", "source")


def _by_document(docs: DataFrame) -> Column:
    """doc_id; beyond all of these, a name by text, language and source for rows without one."""
    return F.coalesce(docs["doc_id"], _content(docs, "text", "lang", "source").bitwiseAND((1 << 62) - 1) + (1 << 62))


def _named(docs: DataFrame, name: Column) -> DataFrame:
    return docs.select(name.alias("doc_id"), "text", "lang", "source")


def _without(docs: DataFrame, name: Column, gone: DataFrame) -> DataFrame:
    """docs but for the rows whose name is in gone (doc_id)."""
    gone = common.written(gone.select("doc_id").distinct(), "gone")
    return docs.join(gone, name == gone["doc_id"], "left_anti")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go. Each row is judged by itself, whether its doc_id is null or comes again; equal rows stay or go together."""
    name = _by_row(docs)
    return _without(docs, name, language_id.op5_language_id(_named(docs, name)).where(~F.col("accepted")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents share stay in the last of them; n_chars follows where there is such a column. Rows that repeat a doc_id are one
    document, as are rows without one, the smallest. A text that loses nothing stays as it is, null too."""
    others = [c for c in docs.columns if c != "text"]
    out = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", F.struct(*others).alias("row")))
    lost = F.size("kept_lines") < F.col("n_lines")
    text = F.when(lost, F.concat_ws("\n", "kept_lines")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(lost, F.length(text)).otherwise(F.col("row")["n_chars"] if "n_chars" in others else F.lit(None)).cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 of their five-word shingles, the one with the least doc_id stays; rows without one come after all others. Rows
    that repeat a doc_id, and equal rows without one, are one document. Documents without words are alike to none."""
    name = _by_document(docs)
    groups = jaccard_join.similarity_join(_named(docs, name))
    return _without(docs, name, groups.where("component_id != doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Each row is judged by itself; equal rows stay or go together."""
    name = _by_row(docs)
    return _without(docs, name, decontaminate.op10_decontaminate(_named(docs, name), common.read(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with ``copies``, how often each is to be read, in place of a column of that name. Equal rows count as often as they come."""
    name = _by_row(docs)
    plan = mixing.mix(_named(docs, name), mixing.n_words(F.col("text")), mixing.quality_weight(F.col("text"))).where("copies > 0")
    plan = common.written(plan.groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    return docs.join(plan, name == plan["doc_id"]).select(*[docs[c] for c in docs.columns if c != "copies"], plan["copies"])


STAGES = [("language_id", identify_languages), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies), ("decontaminate", decontaminated), ("mixing", mixed)]
#: Trees, boosted likelihoods and template windows have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch():
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
