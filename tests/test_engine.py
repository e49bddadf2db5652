"""Logs, index, sampling and engine against plain Python models."""

from __future__ import annotations

import bisect
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from driftwell import schema, storage
from driftwell.operators import index as ix
from driftwell.operators import lookup, oplog, runs, sample, spline
from driftwell.plans import workloads
from driftwell.plans.engine import Engine
from driftwell.plans.levels import Plan, height_after
from driftwell.sources import files, generators
from driftwell.streaming import ingest


def _model(ops):
    live = Counter()
    for _, key, value, op in sorted(ops):
        if op == "I":
            live[key, value] += 1
        elif live[key, value]:
            live[key, value] -= 1
    return +live


def _random_ops(seed, n=600, keys=20, deletes=0.45):
    rng = random.Random(seed)
    return [(i, rng.randrange(keys), rng.randrange(2), "D" if rng.random() < deletes else "I") for i in range(n)]


def _records(spark, pairs):
    return spark.createDataFrame(pairs, schema.RECORD)


def _counter(df):
    return Counter((r["key"], r["value"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_live_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(oplog, "CHUNK", 50)
    ops = _random_ops(seed)
    got = {(r["key"], r["value"]): r["n"] for r in oplog.live_counts(spark.createDataFrame(ops, schema.OP_LOG)).collect()}
    assert got == dict(_model(ops))


def test_small_logs(spark):
    ops = [(0, 1, 1, "D"), (1, 1, 1, "I"), (2, 1, 1, "D"), (3, 1, 1, "I"), (4, 2, 2, "I"), (5, 2, 2, "I"), (6, 2, 2, "I"), (7, 2, 2, "D"), (8, 2, 2, "D")]
    log = spark.createDataFrame(ops, schema.OP_LOG)
    assert _counter(oplog.live(log)) == {(1, 1): 1, (2, 2): 1}
    assert oplog.live(log.limit(0)).count() == 0


@pytest.mark.parametrize("policy", ["tiering", "levelling"])
def test_engine_matches_model_and_restores(spark, tmp_path, policy):
    ops = _random_ops(5, 500)
    engine = Engine(spark, str(tmp_path / "e"), cap=100, scale=2, policy=policy)
    for at in range(0, len(ops), 60):
        engine.apply(spark.createDataFrame([(s - at, k, v, o) for s, k, v, o in ops[at : at + 60]], schema.OP_LOG))
    want = _model(ops)
    assert _counter(engine.live()) == want
    queries = schema.queries(spark, [(0, 3, 9, 50), (1, 100, 200, 50)])
    drawn = sorted(map(tuple, engine.range_sample(queries, 3).collect()))
    assert len(drawn) == 50 and all((k, v) in want for _, _, k, v in drawn)
    again = Engine.restore(spark, engine.persist())
    assert _counter(again.live()) == want
    assert sorted(map(tuple, again.range_sample(queries, 3).collect())) == drawn
    assert [r["pos"] for r in again.flatten().orderBy("pos").collect()] == list(range(sum(want.values())))
    assert again.stats().count() == len(engine.files)


def _alive(df):
    return {(r["key"], r["value"]): r["n"] for r in df.collect()}


def test_flushes_by_cap(spark, tmp_path):
    """A batch of any size becomes flushes of cap operations; what fills none waits in the buffer."""
    ops = _random_ops(21, 470)
    engine = Engine(spark, str(tmp_path / "e"), cap=100, scale=3, tombstone_cap=1000)
    engine.apply(spark.createDataFrame(ops, schema.OP_LOG))
    assert engine.flushes == 4 and engine.buffered == 70 and _alive(engine.live_counts()) == dict(_model(ops))
    engine.flush()
    assert engine.flushes == 5 and not engine.buffered and _alive(engine.live_counts()) == dict(_model(ops))
    few = Engine(spark, str(tmp_path / "f"), cap=1000, scale=3, tombstone_cap=20)
    few.append(_records(spark, [(i, i) for i in range(50)]))
    assert few.flushes == 0
    few.delete(_records(spark, [(i, i) for i in range(20)]))
    assert few.flushes == 1 and not few.buffered and few.live().count() == 30


def test_hot_records_stay_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(oplog, "CHUNK", 64)
    monkeypatch.setattr(oplog, "COPIES", 100)
    monkeypatch.setattr(ix, "COPIES", 100)
    engine = Engine(spark, str(tmp_path / "e"), cap=2000, scale=2)
    engine.append(_records(spark, [(1, 1)] * 1500 + [(2, 2)] * 10))
    engine.delete(_records(spark, [(1, 1)] * 700))
    engine.flush()
    assert engine.log().count() <= 4 and _alive(engine.live_counts()) == {(1, 1): 800, (2, 2): 10}
    assert _counter(engine.live()) == {(1, 1): 800, (2, 2): 10}
    assert [tuple(r) for r in engine.flatten().orderBy("pos").collect()] == [(i, 1, 1) if i < 800 else (i, 2, 2) for i in range(810)]
    drawn = engine.range_sample(schema.queries(spark, [(0, 0, 9, 3000), (1, 2, 2, 7)]), 4).groupBy("qid", "key").count().collect()
    counts = {(r["qid"], r["key"]): r["count"] for r in drawn}
    assert counts[1, 2] == 7 and counts[0, 1] + counts[0, 2] == 3000 and 10 < counts[0, 2] < 75


def test_versions_and_vacuum(spark, tmp_path):
    ops = _random_ops(31, 400)
    engine = Engine(spark, str(tmp_path / "e"), cap=50, scale=2)
    states = []
    for at in range(0, 400, 100):
        engine.apply(spark.createDataFrame([(s - at, k, v, o) for s, k, v, o in ops[at : at + 100]], schema.OP_LOG))
        engine.persist()
        states.append(dict(_model(ops[: at + 100])))
    assert Engine.versions(spark, engine.folder) == [1, 2, 3, 4]
    assert _alive(Engine.restore(spark, engine.folder, 2).live_counts()) == states[1]
    gone = engine.vacuum(keep=2)
    assert any(x.startswith("run-") for x in gone) and Engine.versions(spark, engine.folder) == [3, 4]
    for version, state in ((3, states[2]), (None, states[3])):
        assert _alive(Engine.restore(spark, engine.folder, version).live_counts()) == state
    engine.vacuum()
    used = {p.removeprefix(engine.folder + "/").split("/")[0] for p in engine._paths()}
    assert {x for x in storage.folders(spark, engine.folder) if x.startswith(("run-", "batch-"))} == used
    assert engine.bytes() == engine.stats().agg({"bytes": "sum"}).first()[0] > 0


def test_sample_by_runs_is_uniform(spark, tmp_path):
    """Against what is live: copies count, deleted records never come, empty ranges give nothing, and nothing is rebuilt."""
    engine = Engine(spark, str(tmp_path / "e"), cap=40, scale=3)
    engine.append(_records(spark, [(i, 0) for i in range(10)] * 3 + [(50, 1)] * 6))
    engine.delete(_records(spark, [(0, 0)] * 3 + [(1, 0)] * 2 + [(50, 1)] * 6))
    engine.append(_records(spark, [(0, 0), (5, 0)]))
    want = Counter({(0, 0): 1, (1, 0): 1, (5, 0): 4} | {(i, 0): 3 for i in (2, 3, 4, 6, 7, 8, 9)})
    assert _alive(engine.live_counts()) == dict(want)
    queries = schema.queries(spark, [(i, 0, 60, 100) for i in range(40)] + [(100, 50, 50, 20), (101, 70, 80, 5), (102, 0, 0, 9), (103, 3, 2, 9)])
    got = engine.sample_by_runs(queries, 3).toPandas()
    assert engine._index is None
    per_query = Counter(got["qid"])
    assert per_query == {**{i: 100 for i in range(40)}, 102: 9}
    drawn = Counter(zip(got["key"][got["qid"] < 40], got["value"][got["qid"] < 40], strict=True))
    total = sum(want.values())
    chi = sum((drawn[p] - 4000 * n / total) ** 2 / (4000 * n / total) for p, n in want.items())
    assert set(drawn) == set(want) and chi < 30
    built = dict(engine._by_path)
    engine.append(_records(spark, [(2, 2)]))
    engine.sample_by_runs(queries, 4)
    assert sum(p not in built for p in engine._by_path) == 1


def test_stream_into_the_engine_is_idempotent(spark, tmp_path):
    ops = _random_ops(13, 200)
    for part in range(4):
        spark.createDataFrame(ops[part * 50 : part * 50 + 50], schema.OP_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema.OP_LOG).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    engine = Engine(spark, str(tmp_path / "e"), cap=60, scale=2)
    ingest.into(source, engine, str(tmp_path / "p")).awaitTermination()
    assert _alive(engine.live_counts()) == dict(_model(ops)) and engine.consumed["stream"] >= 0
    again = Engine.restore(spark, engine.folder)
    ingest.into(source, again, str(tmp_path / "other progress")).awaitTermination()  # the same batches come once more
    assert _alive(again.live_counts()) == dict(_model(ops))


def test_merges_keep_their_runs_until_written(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "e"), cap=10, scale=2)
    engine.append(_records(spark, [(i, i) for i in range(20)]))
    files = dict(engine.files)
    from driftwell.plans import engine as module

    def broken(*_, **__):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(engine, "_compact", broken)
        with pytest.raises(OSError):
            engine.append(_records(spark, [(i, i) for i in range(20, 30)]))
    assert set(files.items()) <= set(engine.files.items())
    engine._compact()
    assert _counter(engine.live()) == {(i, i): 1 for i in range(30)} and module.Engine is Engine


def test_workloads(spark, tmp_path):
    records = spark.range(300).selectExpr("id AS n", "id % 40 AS key", "id AS value")
    engine = Engine(spark, str(tmp_path / "e"), cap=80, scale=2)
    assert len(workloads.load(engine, records, 0, 200, 100, 10, 1)) == 2
    before = engine.live_counts().count()
    gone, seconds = workloads.deletes(engine, 10, 2)
    assert 0 < gone <= 10 and seconds > 0 and engine.live_counts().count() == before - gone
    asked = schema.queries(spark, [(0, 0, 20, 15)])
    assert workloads.samples(engine, asked, 1)[0] == 15 == workloads.samples(engine, asked, 1, by_runs=True)[0]
    rows = workloads.mixed(Engine(spark, str(tmp_path / "m"), cap=300, scale=2), records, 60, 30, 60, 10, asked, 3)
    assert sum(r["writes"] for r in rows) - sum(r["deleted"] for r in rows) == rows[-1]["live"] and sum(r["reads"] for r in rows) > 0
    warm = Engine(spark, str(tmp_path / "w"), cap=500, scale=2)
    gone = workloads.warm_up(warm, records, 120, 60, 20, 5)
    assert gone > 0 and warm.live_counts().count() == 120 - gone
    results = workloads.sweep(spark, records, 60, 30, asked, [400], [2], [0.5], ["tiering"])
    assert [r["policy"] for r in workloads.picked(results, "policy", cap=400).collect()] == ["tiering"]
    assert workloads.picked(results, policy="none").count() == 0 and results.where("bytes > 0 and height = 0 and insert_p50 > 0").count() == 1


def test_io_counters(spark, tmp_path):
    storage.reset_io(spark)
    spark.range(1000).write.parquet(str(tmp_path / "x"))
    assert storage.io_counters(spark).where("scheme = 'file' and bytes_written > 0").count() == 1


def test_heights():
    assert [height_after(n, 100, 2) for n in (100, 300, 1000)] == [0, 1, 3]


def test_tombstone_bound():
    plan = Plan(100, 2, max_tombstones=0.1)
    for f in range(30):
        plan.apply(f, 100, 15)
        assert plan.valid()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(2, 5), st.sampled_from(["tiering", "levelling"]))
def test_plan_keeps_every_flush_in_order(n, scale, policy):
    plan = Plan(10, scale, policy)
    for f in range(n):
        plan.apply(f, 10)
    spans = [(a, z) for level in reversed(plan.levels) for a, z in ((r.first, r.last) for r in level)]
    assert [x for a, z in spans for x in range(a, z + 1)] == list(range(n))
    assert policy != "tiering" or all(len(level) <= scale for level in plan.levels)


def test_index_positions_and_bounds(spark):
    rng = random.Random(4)
    pairs = [(rng.choice([7, 7, 7, rng.randrange(50)]), rng.randrange(5)) for _ in range(3000)] + [(2**63 - 1, 1), (0, 0)]
    index = ix.build(_records(spark, pairs), 5)
    got = [(r["key"], r["value"]) for r in index.positions.orderBy("pos").collect()]
    assert got == sorted(pairs)
    keys = [k for k, _ in got]
    probes = [(i, x) for i, x in enumerate([-5, 0, 6, 7, 8, 49, 50, 2**63 - 1])]
    df = spark.createDataFrame(probes, "probe long, x long")
    assert {r["probe"]: r["pos"] for r in lookup.lower_bound(index, df).collect()} == {i: int(np.searchsorted(keys, x, "left")) for i, x in probes}
    assert {r["probe"]: r["pos"] for r in lookup.upper_bound(index, df).collect()} == {i: int(np.searchsorted(keys, x, "right")) for i, x in probes}


def test_empty_and_odd_ranges(spark):
    none = _records(spark, [])
    q = schema.queries(spark, [(0, 0, 10, 5), (1, 10, 0, 5), (2, 5, 5, 0), (3, 5, 5, -1), (4, 5, 5, 7)])
    assert sample.range_sample(none, q).count() == 0
    one = _records(spark, [(5, 9)])
    got = Counter(r["qid"] for r in sample.range_sample(one, q).collect())
    assert got == {0: 5, 4: 7}
    assert Counter(r["qid"] for r in sample.range_sample_by_rank(one, q).collect()) == got


def test_large_batches_equal_small_ones(spark, monkeypatch):
    records = _records(spark, [(i * 7 % 500, i) for i in range(3000)])
    index = ix.build(records, 6)
    q = schema.queries(spark, [(i, i * 3 - 20, i * 3 + i % 9, 4) for i in range(200)] + [(900, -5, 2**63 - 1, 30), (901, 9, 3, 3)])
    weighted = ix.build(records, 6, weight=F.col("value") % 3)
    small = [sorted(map(tuple, sample.range_sample(x, q, 8).collect())) for x in (index, weighted)]
    monkeypatch.setattr(ix, "SMALL_BATCH", 10)
    monkeypatch.setattr(ix, "BROADCAST_PROBES", 5)
    monkeypatch.setattr(sample, "BROADCAST_DRAWS", 5)
    assert [sorted(map(tuple, sample.range_sample(x, q, 8).collect())) for x in (index, weighted)] == small
    monkeypatch.setattr(ix, "SMALL_BATCH", 10**6)
    monkeypatch.setattr(ix, "INTERVALS", 3)
    assert sorted(map(tuple, sample.range_sample(index, q, 8).collect())) == small[0]


def test_small_batches_open_few_partitions(spark):
    """Ranges that a few partitions hold read those alone, and of them the rows that the ranges cover."""
    index = ix.build(_records(spark, [(i, i) for i in range(20_000)]), 10)
    plan = sample.range_sample(index, schema.queries(spark, [(0, 100, 120, 50), (1, 9000, 9001, 5)]), 1)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "PartitionFilters" in x)
    assert "part#" in scan[scan.index("PartitionFilters") :] and "GreaterThanOrEqual(row" in scan
    read = index.touched([(100, 121), (9000, 9002)])
    assert read.select(F.input_file_name()).distinct().count() == 2 < len(index.held) and read.count() == 23


def test_weights_equal_copies(spark):
    pairs = [(i % 23, i % 5) for i in range(400)]
    copies = ix.build(_records(spark, [p for p in pairs for _ in range(sum(p) % 4)]), 3)
    weights = ix.build(_records(spark, pairs), 5, weight=(F.col("key") + F.col("value")) % 4)
    q = schema.queries(spark, [(0, 2, 9, 300), (1, 0, 22, 300), (2, 4, 4, 10)])
    assert weights.size == copies.size
    assert sorted(map(tuple, sample.range_sample(weights, q, 6).collect())) == sorted(map(tuple, sample.range_sample(copies, q, 6).collect()))
    assert sorted(map(tuple, weights.positions.collect())) == sorted(map(tuple, copies.positions.collect()))


def test_rejection_stats_of_a_small_log(spark):
    ops = [(0, 1, 1, "I"), (1, 2, 1, "I"), (2, 2, 1, "I"), (3, 2, 1, "D"), (4, 9, 1, "I"), (5, 9, 1, "D"), (6, 8, 8, "D")]
    got = sample.rejection_stats(spark.createDataFrame(ops, schema.OP_LOG), schema.queries(spark, [(0, 1, 2, 5), (1, 9, 9, 5), (2, 50, 60, 5)]))
    assert {r["qid"]: tuple(r)[1:] for r in got.collect()} == {0: (7, 3, 1, 1, 2), 1: (7, 3, 3, 1, 0), 2: (7, 3, 4, 0, 0)}


@pytest.mark.parametrize(("a", "b"), [([(1, 1)], [(1, 1)]), ([(1, 1)], [(1, 2)]), ([(2, 1)], [(1, 9)]), ([(1, 1)], [(1, 1), (2, 2)]), ([], [(1, 1)]), ([], []), ([(1, 1), (3, 3)], [(1, 1), (2, 9), (4, 4)])])
def test_sequence_order(spark, a, b):
    got = oplog.sequence_order(ix.build(_records(spark, a)), ix.build(_records(spark, b))).first()
    apart = next((i for i, (x, y) in enumerate(itertools.zip_longest(sorted(a), sorted(b))) if x != y), -1)
    assert tuple(got) == (sorted(a) == sorted(b), sorted(a) < sorted(b), sorted(a) <= sorted(b), apart)


def test_page_ranges_and_positions(spark):
    index = ix.build(_records(spark, [(i // 3, i) for i in range(5000)]), 4)
    pages = sum(-(-p.cnt // ix.PAGE) for p in index.held)
    probes = spark.createDataFrame([(0, -1), (1, 0), (2, 400), (3, 1666), (4, 1667)], "probe long, x long")
    found = {r["probe"]: (r["lower"], r["upper"]) for r in lookup.bound_pages(index, probes).collect()}
    page_of = {r["pos"]: r["page"] for r in ix.page_range(index, 0, pages).collect()}
    keys = [i // 3 for i in range(5000)]
    assert found == {i: (page_of.get(bisect.bisect_left(keys, x)), page_of.get(bisect.bisect_right(keys, x))) for i, x in map(tuple, probes.collect())}
    every = ix.page_range(index, 0, pages)
    assert every.count() == 5000 and every.select("page").distinct().count() == pages
    assert {r["page"] for r in ix.page_range(index, 1, 2).collect()} == {1, 2}
    assert ix.page_range(index, 3, 2).count() == 0 == ix.page_range(index, pages + 5, pages + 9).count()
    asked = spark.createDataFrame([(0,), (4999,), (5000,), (-1,)], "pos long")
    assert sorted(map(tuple, ix.at_positions(index, asked).collect())) == [(0, 0, 0), (4999, 1666, 4999)]
    assert oplog.erase_at(index, asked).count() == 4998


def test_rows_do_not_depend_on_partitions(spark):
    records = _records(spark, [(i % 97, i) for i in range(2000)])
    q = schema.queries(spark, [(0, 3, 60, 200), (1, 0, 96, 200)])
    plain = [sorted(map(tuple, sample.range_sample(ix.build(records, n), q, 8).collect())) for n in (1, 3, 16)]
    assert plain[0] == plain[1] == plain[2] == sorted(map(tuple, sample.range_sample_by_rank(records, q, 8).collect()))


def test_draws_are_uniform_and_independent(spark):
    """Chi-square over many queries together, for single draws and for consecutive pairs."""
    records = _records(spark, [(i, i) for i in range(10)])
    q = schema.queries(spark, [(i, 0, 9, 100) for i in range(300)])
    rows = sample.range_sample(records, q, 1).toPandas().sort_values(["qid", "i"])
    counts = rows.groupby("qid")["key"].value_counts().unstack(fill_value=0).reindex(columns=range(10), fill_value=0).to_numpy()
    chi = ((counts - 10) ** 2 / 10).sum(axis=1)
    assert 8 < chi.mean() < 10
    k = rows["key"].to_numpy().reshape(300, 100)
    pairs = np.bincount((k[:, :-1] * 10 + k[:, 1:]).ravel(), minlength=100)
    expect = pairs.sum() / 100
    assert ((pairs - expect) ** 2 / expect).sum() < 150
    assert (counts > 1).all(axis=1).mean() > 0.9  # with replacement


def test_erase_and_rejection(spark):
    r = _records(spark, [(1, 1), (1, 1), (1, 2), (2, 1)])
    keys = spark.createDataFrame([(1,), (9,)], "key long")
    assert _counter(oplog.erase_one(r, keys)) == {(1, 1): 1, (1, 2): 1, (2, 1): 1}
    assert _counter(oplog.erase_all(r, keys)) == {(2, 1): 1}


def test_unsigned_keys(spark):
    df = spark.createDataFrame([("5",), (str(2**63 - 1),)], "key string")
    assert [r["key"] for r in schema.unsigned_keys(df).collect()] == [5, 2**63 - 1]
    with pytest.raises(Exception, match="key of 2"):
        schema.unsigned_keys(spark.createDataFrame([(str(2**63),)], "key string")).collect()


def test_corridor_error():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 10**9, 5000) ** 2 // 10**9)
    pos = np.arange(len(keys)) * 3
    at = spline.corridor(keys, pos, 32)
    assert np.abs(np.interp(keys, keys[at], pos[at]) - pos).max() <= 33
    assert len(at) < len(keys) / 20


def test_files(spark, tmp_path):
    records = _records(spark, [(3, 1), (5, 2)])
    files.write_records(records, str(tmp_path / "r"))
    assert _counter(files.read_records(spark, str(tmp_path / "r"))) == {(3, 1): 1, (5, 2): 1}
    (tmp_path / "q.tsv").write_text("1\t9\t0.1\n9\t1\t0.1\n1\t2\t0.05\n")
    got = files.read_queries(spark, str(tmp_path / "q.tsv"), 0.1).collect()
    assert [(r["lo"], r["hi"], r["k"]) for r in got] == [(1, 9, 1000)]
    (tmp_path / "lon.tsv").write_text("7\t-179.5\n")
    assert files.read_longitudes(spark, str(tmp_path / "lon.tsv")).first()["key"] == 5_000_000
    (tmp_path / "w.tsv").write_text("7\t3\t2\n")
    assert tuple(files.read_weighted(spark, str(tmp_path / "w.tsv")).first()) == (3, 7, 2)
    (tmp_path / "k").mkdir()
    (tmp_path / "k/a.bin").write_bytes(np.array([9, 4, 7], dtype="<u8").tobytes())
    (tmp_path / "k/b.bin").write_bytes(np.array([1, 9], dtype="<u8").tobytes())
    assert _counter(files.read_keys(spark, str(tmp_path / "k"))) == {(9, 0): 1, (4, 1): 1, (7, 2): 1, (1, 3): 1, (9, 4): 1}
    assert _counter(files.read_keys(spark, str(tmp_path / "k"), 4)) == {(9, 0): 1, (4, 1): 1, (7, 2): 1, (1, 3): 1}
    (tmp_path / "b.tsv").write_text("".join(f"{i}\t{i * 5 % 17}\n" for i in range(25)))
    got = files.record_batches(spark, str(tmp_path / "b.tsv"), 10).collect()
    assert {r["value"]: r["batch"] for r in got} == {i: i // 10 for i in range(25)}


def test_generators(spark):
    got = generators.shuffled(spark, 500, 3).collect()
    assert sorted(r["key"] for r in got) == list(range(500)) and sorted(r["value"] for r in got) == list(range(1, 501))
    q = generators.ranges(spark, 50, 100, 1099, 0.1).collect()
    assert all(100 <= r["lo"] and r["hi"] <= 1099 and r["hi"] - r["lo"] == 99 for r in q)


def test_flush_and_merge(spark):
    ops = _random_ops(11, 400)
    arrived = runs.arrivals(spark.createDataFrame(ops, schema.OP_LOG), 50)
    assert sorted(r["ordinal"] for r in arrived.collect()) == list(range(400))
    flushed = runs.flush_runs(arrived)
    merged = runs.merge_runs(flushed.withColumn("g", F.lit(0)), "g", last=True)
    assert {(r["key"], r["value"]): r["n"] for r in merged.collect()} == dict(_model(ops))
    halves = runs.merge_runs(flushed.withColumn("g", F.expr("flush div 4")), "g")
    again = runs.merge_runs(halves.withColumnRenamed("g", "flush").withColumn("g", F.lit(0)), "g", last=True)
    assert {(r["key"], r["value"]): r["n"] for r in again.collect()} == dict(_model(ops))


def test_stream_is_idempotent(spark, tmp_path):
    ops = _random_ops(12, 200)
    spark.createDataFrame(ops, schema.OP_LOG).repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema.OP_LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(source, str(tmp_path / "log")).awaitTermination()
    assert _counter(oplog.live(ingest.read_log(spark, str(tmp_path / "log")))) == _model(ops)
