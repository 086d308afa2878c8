"""Physical plans stay the ones meant for large tables."""

import re

import pytest

import __spark_entry__ as entry_point

from .conftest import SF_SMALL

LAZY = [
    "word_count",
    "doc_softmax",
    "grouped_documents",
    "label_join",
    "consecutive_pairs",
    "matmul_keys",
    "column_minmax",
    "squared_distance",
    "nn_gradient",
    "sae_step",
    "three_way_split",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(entry_point.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_scans_read_only_the_columns_they_need(spark):
    text = plan(entry_point.queries()["matmul_keys"](spark, SF_SMALL))
    assert text.count("ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_") == 2
    assert "l_extendedprice" not in text and "l_shipdate" not in text
    text = plan(entry_point.queries()["three_way_split"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint>" in text


def test_matrix_product_has_one_exchange_per_side_and_one_for_the_result(spark):
    text = plan(entry_point.queries()["matmul_keys"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3


def test_splits_and_masks_do_not_shuffle(spark):
    for name in ("three_way_split", "mini_batches", "zero_mask", "dropout_train", "row_range_scale", "nn_predict"):
        assert "Exchange" not in plan(entry_point.queries()[name](spark, SF_SMALL)), name


def test_autoencoder_gradients_move_thin_rows_only(spark):
    """Exchanges of a step carry (doc, col, value), or sums; never a weight array per word."""
    from featherloom.catalog import sparse_autoencoder as q
    from featherloom.plans import sparse_ae

    triples = q.words(spark, SF_SMALL)
    table = q.rational_table(triples)
    spread = sparse_ae.Spread.of(triples)
    text = plan(sparse_ae.document_pass(spread, table, q.HIDDEN_BIAS))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\), (\w+)", text)
    assert exchanges and all(e == ("doc", "REPARTITION_BY_COL") for e in exchanges)
