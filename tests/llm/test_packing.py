"""Packing against the tokenizers library over the whole table and odd rows, and the pipeline over odd rows to its end."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import packing, queries

from .test_llm import ODD, documents, empty, odd


def check(pieces, docs, length=2048, end_id=1):
    """docs: (doc_id, text), each id once but for null."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    ids = {}
    for doc_id, text in docs:
        ids.setdefault(doc_id, []).append(np.array([*own.encode(text or "", add_special_tokens=False).ids, end_id], "<u4"))
    at = {}
    for p in pieces:
        at.setdefault(p.doc_id, []).append(p)
        at.setdefault(("sequence", p.sequence_id), []).append((p.offset, p.length))
    for doc_id, every in ids.items():
        got = sorted(at[doc_id], key=lambda p: (p.sequence_id, p.offset))
        if len(every) == 1:
            assert [p.start for p in got] == np.cumsum([0, *[p.length for p in got[:-1]]]).tolist() and sum(p.length for p in got) == len(every[0])
            assert all(p.doc_tokens == len(every[0]) and p.ids_crc32 == zlib.crc32(every[0][p.start : p.start + p.length]) for p in got)
        else:
            assert sorted(p.doc_tokens for p in got if p.start == 0) == sorted(map(len, every)) and sum(p.length for p in got) == sum(map(len, every))
    sequences = {k[1]: sorted(v) for k, v in at.items() if isinstance(k, tuple)}
    total = sum(len(x) for every in ids.values() for x in every)
    assert sorted(sequences) == list(range(-(-total // length)))
    for k, v in sequences.items():
        assert [o for o, _ in v] == np.cumsum([0, *[n for _, n in v[:-1]]]).tolist()
        assert sum(n for _, n in v) == (length if k < len(sequences) - 1 else total - length * (len(sequences) - 1))


def test_table_equals_the_library(spark, sf_dir):
    check(queries.QUERIES["op10_packing"](spark, sf_dir).collect(), documents(spark, sf_dir))


def test_null_repeated_and_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "a b"), (None, None), (3, "another text of id 3"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("clash")).withColumn("ids", F.lit("clash")).repartition(4)
    check(packing.pack(df, length=64).collect(), rows, 64)
    assert packing.pack(empty(spark)).count() == 0


def test_pipeline_runs_odd_rows_to_its_end(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = odd(spark).select(F.col("doc_id") + 10_000, *docs.columns[1:]).toDF(*docs.columns)
    none = some.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    docs.unionByName(some).unionByName(none).unionByName(docs.where("doc_id < 3")).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # every sequence but the last is full, and pieces lie gapless
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for k, v in by.items():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0, *[n for _, n in v[:-1]]]).tolist() and (k == max(by) or sum(n for _, n in v) == 2048)
    kept = {p.doc_id for p in pieces}
    assert len(kept & set(range(10_000))) > 100 and not kept & {10_000 + i for i, t in enumerate(ODD) if not t or not t.strip()}
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
