"""Documents to packed training sequences: each stage works on what the one before it kept."""

from pyspark.sql import functions as F

from gridwarden.llm import decontaminate, queries, secrets, simhash
from gridwarden.llm.shared import row_key
from gridwarden.session import fresh_path

#: The fit of a classifier, the links of fingerprints and the packing have no SQL.
ORACLE_SQL = None


def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier, fitted on the labelled ones, accepts."""
    judged = queries.scored(docs, queries.read(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(*docs.columns)


def one_of_each(spark, docs, sf_dir):
    """One document of each class of near-duplicates."""
    return simhash.keep_one(docs)


def uncontaminated(spark, docs, sf_dir):
    """Documents of which less than a twentieth is benchmark text."""
    found = decontaminate.contamination(docs, queries.read(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    doc_id, content = row_key()
    return docs.join(bad, [doc_id.eqNullSafe(F.col("_id")), content == F.col("_content")],
                     "left_anti")


def without_secrets(spark, docs, sf_dir):
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs, fresh_path(spark, "secret-ledger"))


def sequences(spark, docs, sf_dir):
    """The pieces of the documents with their places in the sequences."""
    return queries.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", sequences),
]


def run(spark, sf_dir):
    """The stages from documents on, each result written as Parquet and read again."""
    docs = queries.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
