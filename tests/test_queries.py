"""Every registered query against its SQL in DuckDB."""

import pytest

from loomgraph.plans import ORACLES, QUERIES

from .oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_learned_rerank_learns(spark, sf_dir):
    rows = QUERIES["j14_boosted_trees"](spark, sf_dir).collect()
    right = sum((r.score > 0.5) == bool(r.good) for r in rows)
    assert right / len(rows) > max(0.75, sum(not r.good for r in rows) / len(rows) - 0.02)


def test_digest_ignores_order(spark, sf_dir):
    from loomgraph.operators.stats import digest
    from loomgraph.plans.model import relations

    r = relations(spark, sf_dir)
    assert digest(r).first() == digest(r.orderBy("dst")).first() != digest(r.where("kind <> 'Extends'")).first()


def test_best_match_orders_by_one_number(spark, sf_dir, tmp_path):
    import os

    for name in os.listdir(sf_dir):
        if name != "part.parquet":
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    # lines 3 and 2; the number of the second outweighs its line
    parts = [(2, "red bolt", "Brand#1", "T", 1, 1.0), (35001, "red bolt", "Brand#1", "T", 1, 1.0), (2100, "blue_1 nut", "Brand#1", "T", 1, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "parts"))
    os.symlink(next((tmp_path / "parts").glob("part-*.parquet")), tmp_path / "part.parquet")
    same(QUERIES["f5_select_best_match"](spark, str(tmp_path)), str(tmp_path), ORACLES["f5_select_best_match"])
