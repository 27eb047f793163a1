"""The corpus pipeline: documents -> language ID -> near duplicates -> repeated passages -> packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; all but the
last return the columns of documents. Null or empty texts pass the stages as their operators define.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import language_id, ngram_join, packing, repeats
from loomgraph.llm.common import table, written

SHINGLE, SHARE = 5, 80  # words, per cent


def languages(spark, docs, sf_dir):
    """Documents whose language is recognised: those too far from every centroid go, as do those without a letter."""
    model = language_id.learn(docs.select("doc_id", "text", "lang").where(~language_id.held_out()))
    return language_id.predict(docs, model).where("not rejected").select("row.*")


def near_duplicates(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    groups = ngram_join.join(docs, SHINGLE, SHARE)
    return docs.join(groups.where("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark, docs, sf_dir):
    """Documents without the passages of 50 bytes or more that a document of a smaller doc_id has; a character that a cut splits goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = repeats.remove_repeats(docs, rest=rest)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long"), **{c: F.col("rest")[c] for c in rest}}
    return out.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def packed(spark, docs, sf_dir):
    """One row for each piece of the packed sequences."""
    return packing.pack(docs)


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]
#: SQL can't express these stages (one learns, one cuts bytes, one tokenizes); tests compare them with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
