"""Token files with Elias-Fano coded boundaries, against the tokenizers library and plain lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries, token_files
from loomgraph.llm.common import shared_dir
from loomgraph.llm.elias_fano import SAMPLE, EliasFano
from loomgraph.llm.packing import tokenizer_path

from . import brute
from .test_llm import ODD, documents, empty, odd

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize(("n", "most"), [(0, 0), (1, 0), (1, 2**63), (5, 3), (SAMPLE, 10), (SAMPLE + 1, 1 << 40), (20_000, 1 << 30), (3000, (1 << 64) - 2), (700, 700)])
def test_elias_fano(n, most):
    values = np.sort(np.random.default_rng(n).integers(0, most + 1, n, np.uint64))
    data = EliasFano.of(values).dump()
    own, end = EliasFano.load(b"..." + data, 3)
    assert end == len(data) + 3 and (own.get(np.arange(n)) == values).all()
    some = np.random.default_rng(1).permutation(n)[:50]
    assert (own.get(some) == values[some]).all()
    if n > 1000:  # near the least space there is
        assert 8 * len(data) <= n * (2.2 + np.log2(max(2, most / n)) + 32 / SAMPLE) + 1000


def test_file_round_trip():
    sizes, ids = np.array([0, 3, 0, 1]), np.array([7, 8, 9, 65535], "<u2")
    own = token_files.TokenFile(token_files.encode_file([-5, -5, 9, None], sizes, ids))
    assert own.doc_ids() == [-5, -5, 9, None] and [own.document(i).tolist() for i in range(4)] == [[], [7, 8, 9], [], [65535]]
    assert token_files.TokenFile(token_files.encode_file([None], np.array([1]), ids[:1])).doc_ids() == [None]
    extremes = [-(2**63), 0, 2**63 - 1]
    assert token_files.TokenFile(token_files.encode_file(extremes, np.ones(3, int), ids[:3])).doc_ids() == extremes
    with pytest.raises(ValueError):
        token_files.TokenFile(b"x" * 100)


def test_table_equals_the_library(spark, sf_dir):
    got = queries.QUERIES["op13_token_files"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == brute.token_rows(documents(spark, sf_dir), PATH)


def test_odd_rows_and_small_files(spark):
    more = ["<|startoftext|>A b<|endoftext|>", "İstanbul ΣΑΣ ς", "é ́x", "a b c​d", "it's I'M x'LL", "\x1c\x85 z", "12 345", "ﬁ Å"]
    docs = odd(spark).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    want = brute.token_rows([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], PATH)
    folder = f"{shared_dir(spark)}/files"
    manifest = token_files.write(docs, folder, PATH, file_bytes=64)
    assert manifest.count() > 5
    assert sorted(map(tuple, token_files.read(manifest, folder).collect())) == want
    assert token_files.write_and_read(empty(spark)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(3, "a b"), (None, "c"), (3, "a b"), (None, None), (-1, "x y z"), (3, "d")]
    got = token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("clash"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [-1, 3, 3, 3, None, None]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
