"""A stream of files equals the static loop, and replays change nothing."""

import os

import pytest

from driftset.functions import shared
from driftset.functions.metrics import slowest_worker_total
from driftset.operators.graph import apply_net
from driftset.operators.lfmis import lfmis
from driftset.operators.repair import State, apply_batch
from driftset.operators.updates import net_toggle
from driftset.plans import fixtures, queries
from driftset.streaming.engine import Engine
from tests.conftest import SF


def test_stream_equals_loop_and_replay(spark, tmp_path):
    v = spark.range(30)
    e = spark.createDataFrame([(i, i + 1) for i in range(29)], "src bigint, dst bigint")
    start = State(v, e, lfmis(v, e))
    batches = [[(1, 2), (5, 9)], [(1, 2), (20, 28), (3, 17)]]
    d = tmp_path / "in"
    d.mkdir()
    for i, b in enumerate(batches):
        (d / f"batch{i}.txt").write_text("".join(f"{x + 1} {y + 1}\n" for x, y in b))
    engine = Engine(spark, str(tmp_path / "state"))
    engine.start(start)
    got = engine.run_folder(str(d), str(tmp_path / "checkpoint"))
    state = start
    for b in batches:
        ups = spark.createDataFrame([(0, i, *p, None) for i, p in enumerate(b)], "batch_id int, seq bigint, src bigint, dst bigint, op string")
        state = apply_batch(state, net_toggle(ups, state.edges))
    assert sorted(r.id for r in got.mis.collect()) == sorted(r.id for r in state.mis.collect())
    assert engine.apply(spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), 0) is False
    rows = engine.metrics().collect()
    assert [(r.batch_id, r.stage) for r in rows] == [(i, s) for i in (0, 1) for s in ("analyse", "repair", "save", "total")]
    assert all(r.ms > 0 for r in rows) and engine.late == [0]
    assert {r.stage: round(r.total_ms) for r in slowest_worker_total(engine.metrics()).collect()} == {
        s: round(sum(r.ms for r in rows if r.stage == s)) for s in ("analyse", "repair", "save", "total")}


def test_batches_run_in_the_order_of_their_numbers(spark, tmp_path):
    """Whatever the times of the files; the parts of a batch are one batch."""
    n = 40
    v, e = spark.range(n), spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src bigint, dst bigint")
    batches = {2: [[(0, 3)], [(5, 9), (6, 8)]], 10: [[(0, 3), (20, 28)]], 1: [[(3, 17), (11, 13)], [(1, 2)]], 30: [[(1, 2)]]}
    d = tmp_path / "in"
    for age, (k, parts) in enumerate(batches.items()):
        (d / f"batch_id={k}").mkdir(parents=True)
        for i, rows in enumerate(parts):
            f = d / f"batch_id={k}" / f"part-{i}.txt"
            f.write_text("".join(f"{x + 1} {y + 1}\n" for x, y in rows))
            os.utime(f, (10**9 - 1000 * age + i, 10**9 - 1000 * age + i))
    engine = Engine(spark, str(tmp_path / "state"), compact=2, keep=1)
    engine.start(State(v, e, lfmis(v, e)))
    got = engine.run_folder(f"{d}/*", str(tmp_path / "checkpoint"))
    state = State(v, e, lfmis(v, e))
    for k in sorted(batches):
        ups = spark.createDataFrame([(k, i, *p, None) for i, p in enumerate(p for part in batches[k] for p in part)], "batch_id int, seq bigint, src bigint, dst bigint, op string")
        after = apply_batch(state, net_toggle(ups, state.edges))
        state = State(v, *(spark.createDataFrame(x.collect(), x.schema) for x in (after.edges, after.mis)))
    assert [r.batch_id for r in engine.metrics().where("stage = 'total'").collect()] == [1, 2, 10, 30] and engine.late == []
    assert sorted(r.id for r in got.mis.collect()) == sorted(r.id for r in state.mis.collect())
    assert sorted(map(tuple, got.edges.select("src", "dst").collect())) == sorted(map(tuple, state.edges.select("src", "dst").collect()))
    # compacted, and what nobody reads is gone
    assert engine._marked("whole")[-1] >= 2 and -1 not in engine._marked("done")
    assert sorted(r.id for r in engine.load(30).mis.collect()) == sorted(r.id for r in state.mis.collect())


def test_no_intermediate_tables_stay(spark, tmp_path):
    v, e = spark.range(20), spark.createDataFrame([(i, i + 1) for i in range(19)], "src bigint, dst bigint")
    engine = Engine(spark, str(tmp_path / "state"))
    engine.start(State(v, e, lfmis(v, e)))
    before = set(shared._live)
    engine.apply(spark.createDataFrame([(2, 9), (4, 5)], "src bigint, dst bigint"), 0)
    assert set(shared._live) == before and all(os.path.isdir(p.removeprefix("file://")) for p in before)


@pytest.mark.parametrize("name", ["stream_members", "batch_metrics"])
def test_queries_stream_all_updates(spark, monkeypatch, name):
    used = []

    class Kept(Engine):
        def __init__(self, *args):
            super().__init__(*args)
            used.append(self)

    monkeypatch.setattr(queries, "Engine", Kept)
    monkeypatch.setattr(fixtures, "BATCHES", 3)
    got = queries.QUERIES[name](spark, SF).collect()
    assert {r.batch_id for r in got} == {0, 1, 2}
    _, base, ups = queries._base(spark, SF)
    want = apply_net(base, net_toggle(ups, base))
    (engine,) = used
    assert sorted(map(tuple, engine.load(2).edges.select("src", "dst").collect())) == sorted(map(tuple, want.select("src", "dst").collect()))
