"""A training corpus from raw documents: quality, rules, near copies, mix, tokens.

Every stage works on all rows that the stage before it kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripspark.llm import gam, line_rules, pieces, raking, simhash
from tripspark.llm.common import join_sized, table
from tripspark.session import checkpointed, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.scored(docs, model).filter(F.col("__score") >= gam.THRESHOLD).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough text without template lines."""
    return line_rules.verdicts(docs).filter("__kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id, with one of its texts if the id repeats.

    Rows without an id stand only for groups in which no row has one; they stay once for each text.
    """
    found = checkpointed(simhash.near_duplicates(docs))
    heads = found.filter("id = component_id").groupBy("id", "sig").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct("sig", "n")).alias("__one"))
    heads = heads.select("__id", F.col("__one.sig").alias("__sig"), F.col("__one.n").alias("__n"))
    same = (docs.doc_id == F.col("__id")) & (F.xxhash64(docs.text) == F.col("__sig"))
    kept = join_sized(docs, heads, same, "inner")
    out = kept.filter("__n = 1").select(*docs.columns)
    if not heads.filter("__n > 1").isEmpty():  # rows that repeat id and text: few, folded by themselves
        several = kept.filter("__n > 1").select(*docs.columns)
        folded = several.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row"))
        out = out.unionByName(folded.select("doc_id", "row.*"))
    unnamed = found.filter("id IS NULL AND component_id IS NULL").select(F.col("sig").alias("__sig")).distinct()
    if not unnamed.isEmpty():
        rows = docs.filter("doc_id IS NULL")
        alone = rows.join(unnamed, F.xxhash64(rows.text) == F.col("__sig"), "left_semi")
        folded = alone.groupBy("text").agg(F.min(F.struct(*[c for c in docs.columns if c != "text"])).alias("row"))
        out = out.unionByName(folded.select("text", "row.*"))
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a sample whose tokens have the target shares of source, language and topic."""
    return raking.mixed(docs).filter("__mix.kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece numbers; each round trip is checked."""
    return pieces.encoded(docs).select("doc_id", "lang", "source", "__pieces.*")


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]

#: Learned tables, fingerprints and fitted weights cannot be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.split(" ")[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
