"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
The last has a row a packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import mixing, packing, passages, quality, queries, simhash
from rankforge.llm.common import drop_tables, made, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Fingerprints of 256 bits of five-word shingles. A pair of similarity 0.8 has an expected distance of 38.8 bits (an
#: angle of acos(2 * 0.8 / 1.8)) with a deviation of 5.7; three of those more are still candidates. The sampled tables hold a
#: pair at 50 bits with a chance of 0.94, at 39 bits of 0.999; their number and width follow the number of documents. At such
#: distances pivots discard little, so there are few.
SIMHASH = {"shingle": 5, "words": 4, "max_distance": 56, "reach": (50, 0.94), "n_pivots": 4}
#: Candidates within max_distance are linked only if the Jaccard similarity of their shingles is this or more.
SIMILARITY = 0.8
#: Sources by a mild power of their tokens; nine tenths of all tokens stay.
MIX = {"source": 0.8, "lang": 0.9, "topic": 1.0}
KEEP_SHARE = 0.9


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base or a rule rejects; null, empty and wordless texts go, repeated rows are judged alike."""
    return quality.judge_quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def one_row_an_id(docs: DataFrame) -> DataFrame:
    """Of rows that share an id the one whose columns hash least, the same in every run."""
    docs = docs.where("doc_id IS NOT NULL").select(*COLUMNS)
    again = materialize(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():  # no text has to be sent anywhere
        return docs
    first = F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS))
    few = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return materialize(docs.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(few), "one-row-an-id")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group, and one row of it; rows with a null id stay. Texts without words are one group."""
    one = one_row_an_id(docs)
    groups = simhash.near_duplicates(one, **SIMHASH, min_similarity=SIMILARITY)
    kept = groups.where("doc_id = component_id").select("doc_id")
    return one.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a document of which no word is left goes. A null id has no passage and stays."""
    found = materialize(passages.repeated_passages(docs), "passages")
    cut = passages.remove_passages(docs, found)
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a document with its cell's calibrated probability; whole texts are scanned once. Null ids are drawn one by one."""
    rows = materialize(mixing.add_features(docs.select(*COLUMNS)), "features")
    return mixing.mix_sources(rows, MIX, KEEP_SHARE, text=None).where("selected").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and offset; a null text is its end token."""
    return packing.pack_documents(docs, queries.vocabulary_path(), 1024)


STAGES = [("quality rules", keep_quality), ("simhash near-dedup", drop_near_duplicates), ("substring dedup", cut_repeated_passages), ("source mixing", mix_to_targets), ("packing", pack)]
#: SQL has no SimHash, chaining or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of a stage go once the next one's input is written. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = len(made)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
            drop_tables(spark, made[before:-1])
    return docs
