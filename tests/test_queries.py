"""Queries against their SQL on the smallest tables."""

import duckdb
import pytest

from driftset.plans.queries import QUERIES, SQL
from tests.conftest import SF

NAMES = [
    "canonical_edges", "vertex_degrees", "csr_offsets", "base_split", "batch_chunks", "toggle_effects", "net_explicit_ops", "graph_after_batch", "hop2_neighborhood",
    "cfr_clusters", "lfmis_id", "lfmis_lcg", "lfmis_id_co_purchase", "mis_after_batch", "mis_after_inserts_max", "repair_validity", "net_mixed_ops", "event_batches",
    "sequential_members", "stream_members", "batch_metrics", "lfmis_id_customer_seq", "cfr_region_average",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
