"""All registered queries of the engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.draws import hashed
from .operators import index as ix
from .operators import lookup, oplog, runs, sample, spline, stats
from .plans.engine import Engine
from .plans.levels import Plan, height_after
from .sources import files, generators
from .storage import new_folder, written
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Key ranges of the registered queries: ordinary ones, a single key, none inside, empty, beyond the end.
RANGES = [(0, 0, 99), (1, 100, 149), (2, 700, 1400), (3, 1400, 10**9), (4, 5, 5), (5, -10, -1), (6, 200, 100), (7, -5, 9 * 10**18)]
K = 1000
PROBES = [(i, x) for i, x in enumerate([-1, 0, 1, 5, 77, 100, 499, 500, 1234, 1499, 1500, 14999, 10**9])]
SELECTIVITIES = ["0.1", "0.05", "0.01", "0.005", "0.001", "0.0005", "0.0001"]
CAP, SCALE = 2000, 2
_Q = ", ".join(f"({q}, {lo}, {hi}, {K})" for q, lo, hi in RANGES)
_P = ", ".join(f"({i}, {x})" for i, x in PROBES)
_H = "('0x' || substr(md5({}), 1, 13))::BIGINT"


def _h(*parts: str) -> str:
    return _H.format(" || ':' || ".join(parts))


def query(sql: str | None = None) -> Callable:
    """Registers a query by its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.records(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.records(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.records(_table(spark, sf_dir, "events"), "event_id", "user_id")


def _ranges(spark: SparkSession, k: int = K) -> DataFrame:
    return schema.queries(spark, [(q, lo, hi, k) for q, lo, hi in RANGES])


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROBES, "probe long, x long")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as inserts, a twentieth of them deleted 500 orders later."""
    r = _orders(spark, sf_dir)
    gone = r.where(hashed("del", F.col("value")) % 100 < 5)
    return r.select((F.col("value") * 2).alias("seq"), "key", "value", F.lit("I").alias("op")).unionByName(gone.select(((F.col("value") + 500) * 2 + 1).alias("seq"), "key", "value", F.lit("D").alias("op")))


def _any_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations in any order: deletes before inserts, inserts again, copies."""
    e = _table(spark, sf_dir, "events")
    op = F.when(hashed("op", F.col("event_id")) % 3 == 0, "D").otherwise("I")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("long").alias("key"), (F.col("event_id") % 3).cast("long").alias("value"), op.alias("op"))


_LOG = f"""log AS (SELECT o_orderkey * 2 AS seq, o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value, 'I' AS op FROM orders
    UNION ALL SELECT (o_orderkey + 500) * 2 + 1, o_custkey, o_orderkey, 'D' FROM orders WHERE {_h("'del'", "o_orderkey")} % 100 < 5)"""
_ANY_LOG = f"""log AS (SELECT event_id AS seq, user_id::BIGINT AS key, (event_id % 3)::BIGINT AS value,
    CASE WHEN {_h("'op'", "event_id")} % 3 = 0 THEN 'D' ELSE 'I' END AS op FROM events)"""
_LIVE_ORDERS = f"SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value FROM orders WHERE NOT {_h("'del'", "o_orderkey")} % 100 < 5"
_ORDERS = "SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value FROM orders"


def _irs(records: str, seed: int, columns: str = "d.qid, d.i, p.key, p.value", queries: str = f"SELECT * FROM (VALUES {_Q}) AS v(qid, lo, hi, k)") -> str:
    draw = _h(f"'{seed}'", "d.qid", "d.i")
    return f"""WITH r AS ({records}), p AS (SELECT key, value, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM r), q AS ({queries}),
        b AS (SELECT qid::BIGINT AS qid, k, min(pos) AS first, count(*) AS n FROM q JOIN p ON key BETWEEN lo AND hi GROUP BY ALL),
        d AS (SELECT qid, unnest(range(k)) AS i, first, n FROM b)
        SELECT {columns} FROM d JOIN p ON p.pos = d.first + {draw} % d.n"""


# -- sampling


@query(_irs(_ORDERS, 42))
def irs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(_orders(spark, sf_dir), _ranges(spark), 42)


@query(_irs("SELECT l_orderkey::BIGINT AS key, l_linenumber::BIGINT AS value FROM lineitem", 43))
def irs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(_lines(spark, sf_dir), _ranges(spark), 43)


@query(_irs("SELECT event_id::BIGINT AS key, user_id::BIGINT AS value FROM events", 44))
def irs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(_events(spark, sf_dir), _ranges(spark), 44)


@query(_irs(_LIVE_ORDERS, 45))
def irs_live_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(oplog.live(_log(spark, sf_dir)), _ranges(spark), 45)


@query(_irs(_ORDERS, 42))
def irs_rank_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample_by_rank(_orders(spark, sf_dir), _ranges(spark), 42)


@query(_irs(_ORDERS, 42))
def irs_index_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(ix.build(_orders(spark, sf_dir), 5), _ranges(spark), 42)


def _sweep(spark: SparkSession, top: Column) -> DataFrame:
    rows = spark.createDataFrame([(s, i) for s in range(len(SELECTIVITIES)) for i in range(5)], "s long, i long")
    share = F.array(*[F.lit(int(float(x) * 10**6)) for x in SELECTIVITIES])[F.col("s").cast("int")]
    width = F.greatest(F.lit(1).cast("long"), F.expr("cast(0 as bigint)") + (top * share / 10**6).cast("long"))
    lo = hashed("sweep", F.col("s"), F.col("i")) % F.greatest(F.lit(1).cast("long"), top - width)
    return rows.select((F.col("s") * 100 + F.col("i")).alias("qid"), lo.alias("lo"), (lo + width).alias("hi"), F.lit(100).cast("long").alias("k"))


_TOP = "(SELECT max(o_custkey) FROM orders)::BIGINT"
_WIDTH = f"greatest(1, ({_TOP} * list_extract([{', '.join(str(int(float(x) * 10**6)) for x in SELECTIVITIES)}], s + 1)) // 1000000)"
_LO = f"{_h("'sweep'", "s", "i")} % greatest(1, {_TOP} - {_WIDTH})"


@query(_irs(_ORDERS, 46, queries=f"SELECT s * 100 + i AS qid, {_LO} AS lo, {_LO} + {_WIDTH} AS hi, 100 AS k FROM range(7) AS a(s), range(5) AS b(i)"))
def irs_selectivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _orders(spark, sf_dir)
    return sample.range_sample(records, _sweep(spark, F.lit(records.agg(F.max("key")).first()[0]).cast("long")), 46)


@query(_irs(_ORDERS, 47, queries="SELECT i AS qid, 100 AS lo, 900 AS hi, 10 ** i AS k FROM range(5) AS t(i)".replace("10 ** i", "(10 ** i)::BIGINT")))
def irs_sample_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.range_sample(_orders(spark, sf_dir), schema.queries(spark, [(i, 100, 900, 10**i) for i in range(5)]), 47)


@query(_irs(_ORDERS, 48, "d.qid, d.i, p.key"))
def btree_key_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.key_sample(_orders(spark, sf_dir), _ranges(spark), 48)


@query(_irs(_LIVE_ORDERS, 49))
def static_array_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = written(runs.flatten(_log(spark, sf_dir)).select("key", "value"), "flat")
    return sample.range_sample(flat, _ranges(spark), 49)


@query(
    f"""WITH s AS ({_irs(_ORDERS, 50)}), v AS (SELECT DISTINCT key, value FROM s),
        l AS (SELECT key, value FROM ({_ORDERS}) EXCEPT ALL SELECT key, value FROM v)
        SELECT 'victim' AS kind, key, count(*) AS n FROM v GROUP BY key UNION ALL SELECT 'remaining', key, count(*) FROM l GROUP BY key"""
)
def sample_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    victims, left = sample.sample_then_delete(_orders(spark, sf_dir), _ranges(spark), 50)
    by_key = lambda df, kind: df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    return by_key(victims, "victim").unionByName(by_key(left, "remaining"))


_WEIGHTED = f"""WITH r AS (SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value, (o_orderkey % 4)::BIGINT AS w FROM orders WHERE o_orderkey % 4 > 0),
    q AS (SELECT * FROM (VALUES {_Q}) AS v(qid, lo, hi, k)), t AS (SELECT *, sum(w) OVER (ORDER BY key, value) AS stop FROM r),
    b AS (SELECT qid::BIGINT AS qid, k, min(stop - w)::BIGINT AS first, sum(w)::BIGINT AS n FROM q JOIN t ON key BETWEEN lo AND hi GROUP BY ALL), d AS (SELECT qid, unnest(range(k)) AS i, first, n FROM b),
    e AS (SELECT qid, i, first + {_h("'51'", "qid", "i")} % n AS pos FROM d)
    SELECT e.qid, e.i, t.key, t.value FROM e ASOF JOIN t ON e.pos < t.stop"""


@query(_WEIGHTED)
def weighted_range_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.weighted_sample(_orders(spark, sf_dir), _ranges(spark), F.col("value") % 4, 51)


_LARGE = 25_000


@query(_irs(_ORDERS, 53, queries=f"SELECT i AS qid, {_h("'big'", "i")} % 1000 AS lo, {_h("'big'", "i")} % 1000 + 5 AS hi, 2 AS k FROM range({_LARGE}) AS t(i)"))
def irs_large_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More queries than the driver places itself."""
    lo = hashed("big", F.col("id")) % 1000
    asked = spark.range(_LARGE).select(F.col("id").alias("qid"), lo.alias("lo"), (lo + 5).alias("hi"), F.lit(2).cast("long").alias("k"))
    return sample.range_sample(_orders(spark, sf_dir), asked, 53)


@query(
    f"""WITH {_LOG}, q AS (SELECT * FROM (VALUES {_Q}) AS v(qid, lo, hi, k)), live AS ({_LIVE_ORDERS})
        SELECT qid::BIGINT AS qid, (SELECT count(*) FROM log) AS candidates, (SELECT count(*) FROM log WHERE op = 'D') AS tombstones,
               (SELECT count(*) FROM log WHERE op = 'I' AND NOT key BETWEEN lo AND hi) AS out_of_range,
               (SELECT count(*) FROM log WHERE op = 'I' AND key BETWEEN lo AND hi) - (SELECT count(*) FROM live WHERE key BETWEEN lo AND hi) AS deleted,
               (SELECT count(*) FROM live WHERE key BETWEEN lo AND hi) AS acceptable
        FROM q"""
)
def rejection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.rejection_stats(_log(spark, sf_dir), _ranges(spark))


# -- counts, bounds, lookups


@query(f"SELECT qid::BIGINT AS qid, (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) AS n FROM (VALUES {_Q}) AS v(qid, lo, hi, k)")
def range_count_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_counts(ix.build(_orders(spark, sf_dir)), _ranges(spark))


@query(
    f"""SELECT qid::BIGINT AS qid, n, total, n * 1000000 // total AS per_million FROM (SELECT qid, (SELECT count(*) FROM orders WHERE o_custkey BETWEEN lo AND hi) AS n,
        (SELECT count(*) FROM orders) AS total FROM (VALUES {_Q}) AS v(qid, lo, hi, k))"""
)
def selectivity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.selectivity(ix.build(_orders(spark, sf_dir)), _ranges(spark))


@query(f"SELECT probe::BIGINT AS probe, (SELECT count(*) FROM orders WHERE o_custkey < x) AS pos FROM (VALUES {_P}) AS v(probe, x)")
def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lower_bound(ix.build(_orders(spark, sf_dir)), _probes(spark))


@query(f"SELECT probe::BIGINT AS probe, (SELECT count(*) FROM orders WHERE o_custkey <= x) AS pos FROM (VALUES {_P}) AS v(probe, x)")
def upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.upper_bound(ix.build(_orders(spark, sf_dir)), _probes(spark))


@query(f"""SELECT probe::BIGINT AS probe, (SELECT count(*) FROM lineitem WHERE l_orderkey < x) AS first, (SELECT count(*) FROM lineitem WHERE l_orderkey <= x) AS stop FROM (VALUES {_P}) AS v(probe, x)""")
def equal_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.equal_range(ix.build(_lines(spark, sf_dir)), _probes(spark))


_PAGE_OF = "(CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey {0} x) < (SELECT count(*) FROM orders) THEN (SELECT count(*) FROM orders WHERE o_custkey {0} x) // {1} ELSE -1 END)::BIGINT"


@query(f"SELECT probe::BIGINT AS probe, {_PAGE_OF.format('<', ix.PAGE)} AS lower, {_PAGE_OF.format('<=', ix.PAGE)} AS upper FROM (VALUES {_P}) AS v(probe, x)")
def bound_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lower and upper bounds; -1 where no record lies there."""
    found = lookup.bound_pages(ix.build(_orders(spark, sf_dir), 1), _probes(spark))
    return found.select("probe", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("lower", "upper")])


@query(f"SELECT probe::BIGINT AS probe, x::BIGINT AS x, EXISTS (SELECT 1 FROM orders WHERE o_custkey = x) AS found FROM (VALUES {_P}) AS v(probe, x)")
def point_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exists(_orders(spark, sf_dir), _probes(spark))


@query(f"SELECT probe::BIGINT AS probe, x::BIGINT AS x, (SELECT count(*) FROM lineitem WHERE l_orderkey = x) AS n FROM (VALUES {_P}) AS v(probe, x)")
def key_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.multiplicity(_lines(spark, sf_dir), _probes(spark))


@query("SELECT min(o_custkey)::BIGINT AS min_key, max(o_custkey)::BIGINT AS max_key, count(*) AS n FROM orders")
def key_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.key_domain(_orders(spark, sf_dir))


@query("SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value FROM orders WHERE o_custkey BETWEEN 100 AND 149")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("key").between(100, 149))


# -- deletes and what is live


@query("SELECT key, value FROM (SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > 1 OR key % 7 <> 0")
def erase_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir)
    return oplog.erase_one(r, r.where(F.col("key") % 7 == 0).select("key"))


@query("SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value FROM orders WHERE o_custkey % 7 <> 0")
def erase_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _orders(spark, sf_dir)
    return oplog.erase_all(r, r.where(F.col("key") % 7 == 0).select("key"))


@query(_LIVE_ORDERS)
def live_set_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live(_log(spark, sf_dir), ordered=False)


_LINES_GONE = f"SELECT DISTINCT l_orderkey::BIGINT AS key, l_linenumber::BIGINT AS value FROM lineitem WHERE {_h("'del'", "l_orderkey", "l_linenumber")} % 100 < 5"


@query(f"SELECT l_orderkey::BIGINT AS key, l_linenumber::BIGINT AS value FROM lineitem EXCEPT ALL ({_LINES_GONE})")
def live_set_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, sf_dir)
    gone = r.where(hashed("del", F.col("key"), F.col("value")) % 100 < 5).distinct()
    both = r.withColumn("op", F.lit("I")).unionByName(gone.withColumn("op", F.lit("D")))
    return oplog.live_by_difference(both)


@query(
    f"""WITH {_ANY_LOG}, s AS (SELECT key, value, seq, sum(CASE op WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY key, value ORDER BY seq) AS s FROM log),
        b AS (SELECT key, value, arg_max(s, seq) - least(0, min(s)) AS n FROM s GROUP BY ALL)
        SELECT key, value, n::BIGINT AS n FROM b WHERE n > 0"""
)
def live_set_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.live_counts(_any_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT key, value FROM ({_ORDERS}) SEMI JOIN (SELECT key, value FROM log WHERE op = 'D') USING (key, value)")
def tombstone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.tombstoned(_orders(spark, sf_dir), _log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT count(*) AS records, count(*) FILTER (WHERE op = 'D') AS tombstones, count(*) FILTER (WHERE op = 'D') * 1000000 // count(*) AS per_million FROM log")
def tombstone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _log(spark, sf_dir).agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("op") == "D").alias("tombstones"))
    return got.select("records", "tombstones", F.expr("tombstones * 1000000 div records").alias("per_million"))


@query(
    f"""WITH {_LOG}, i AS (SELECT key, value FROM log WHERE op = 'I' AND key < 900), l AS (SELECT key, value FROM ({_LIVE_ORDERS}) WHERE key >= 100)
        SELECT (SELECT count(*) FROM (SELECT * FROM i EXCEPT ALL SELECT * FROM l)) AS only_a, (SELECT count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM i)) AS only_b"""
)
def sequence_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts below one key against what is live from another key on."""
    log = _log(spark, sf_dir)
    return oplog.multiset_equal(log.where("op = 'I' and key < 900").select("key", "value"), oplog.live(log).where("key >= 100"))


@query(
    f"""WITH a AS (SELECT key, value, row_number() OVER (ORDER BY key, value) AS pos FROM ({_ORDERS})), b AS (SELECT key, value, row_number() OVER (ORDER BY key, value) AS pos FROM ({_LIVE_ORDERS})),
        f AS (SELECT a.key AS ak, a.value AS av, b.key AS bk, b.value AS bv, coalesce(a.pos, b.pos) AS pos FROM a FULL JOIN b USING (pos) WHERE a.key IS DISTINCT FROM b.key OR a.value IS DISTINCT FROM b.value),
        m AS (SELECT count(*) = 0 AS same, coalesce(arg_min(ak IS NULL OR (bk IS NOT NULL AND (ak < bk OR (ak = bk AND av < bv))), pos), FALSE) AS less, coalesce(min(pos) - 1, -1) AS apart FROM f)
        SELECT 'live' AS other, same AS equal, less, same OR less AS less_equal, apart FROM m UNION ALL SELECT 'itself', TRUE, FALSE, TRUE, -1 FROM orders HAVING count(*) >= 0"""
)
def sequence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in sequence against those that are live, and against themselves."""
    a, b = ix.build(_orders(spark, sf_dir)), ix.build(oplog.live_counts(_log(spark, sf_dir)), weight="n")
    return oplog.sequence_order(a, b).select(F.lit("live").alias("other"), "*").unionByName(oplog.sequence_order(a, a).select(F.lit("itself").alias("other"), "*"))


@query(f"SELECT key, value FROM (SELECT *, row_number() OVER (ORDER BY key, value) - 1 AS pos FROM ({_ORDERS})) WHERE pos % 7 <> 3")
def erase_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ix.build(_orders(spark, sf_dir))
    return oplog.erase_at(index, spark.range(index.size).where("id % 7 = 3").select(F.col("id").alias("pos")))


# -- runs and levels

_ARRIVED = f"{_LOG}, arrived AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // {CAP} AS flush FROM log)"
_RUNS = f"""{_ARRIVED}, bal AS (SELECT flush, key, value, seq, sum(CASE op WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY flush, key, value ORDER BY seq) AS s FROM arrived),
    fin AS (SELECT flush, key, value, arg_max(s, seq)::BIGINT AS total, least(0, min(s))::BIGINT AS low FROM bal GROUP BY ALL),
    runs AS (SELECT flush, key, value, total - low AS n, 'I' AS op FROM fin WHERE total > low UNION ALL SELECT flush, key, value, -low, 'D' FROM fin WHERE low < 0)"""
#: Runs of each level after so many flushes, by counting merges in the base of the scale.
_LEVELS = f"""WITH RECURSIVE {_RUNS}, f AS (SELECT max(flush) + 1 AS flushes FROM runs),
    lv AS (SELECT 0::BIGINT AS level, flushes AS m, (flushes - 1) % {SCALE} + 1 AS c, 1::BIGINT AS width, flushes - ((flushes - 1) % {SCALE} + 1) AS first FROM f
           UNION ALL SELECT level + 1, (m - 1) // {SCALE}, ((m - 1) // {SCALE} - 1) % {SCALE} + 1, width * {SCALE}, first - width * {SCALE} * (((m - 1) // {SCALE} - 1) % {SCALE} + 1)
           FROM lv WHERE (m - 1) // {SCALE} > 0)"""


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.arrivals(_log(spark, sf_dir), CAP)


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (flush, ...) with the level and the run that the tiering plan has put them in."""
    flushed = written(runs.flush_runs(_arrived(spark, sf_dir)), "flushed")
    plan, last = Plan(CAP, SCALE), flushed.agg(F.max("flush")).first()[0]
    for f in range(0 if last is None else last + 1):
        plan.apply(f, CAP)
    placed = spark.createDataFrame([(k, j, f) for k, j, a, z in plan.rows() for f in range(a, z + 1)], "level int, run int, flush long")
    return flushed.join(F.broadcast(placed), "flush")  # a row for each flush


@query(f"WITH {_RUNS} SELECT flush, key, value, n, op FROM runs")
def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush_runs(_arrived(spark, sf_dir))


@query(f"WITH {_LOG} SELECT key, value, 1::BIGINT AS n FROM ({_LIVE_ORDERS})")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flushed = runs.flush_runs(_arrived(spark, sf_dir)).withColumn("all", F.lit(0))
    return runs.merge_runs(flushed, "all", last=True).select("key", "value", "n")


@query(f"SELECT row_number() OVER (ORDER BY key, value) - 1 AS pos, key, value FROM ({_LIVE_ORDERS})")
def flatten_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flatten(_log(spark, sf_dir))


@query(
    f"""WITH {_RUNS}, q AS (SELECT * FROM (VALUES {_Q}) AS v(qid, lo, hi, k)),
        m AS (SELECT qid::BIGINT AS qid, flush, coalesce(sum(n) FILTER (WHERE key < lo), 0)::BIGINT AS low, coalesce(sum(n) FILTER (WHERE key BETWEEN lo AND hi), 0)::BIGINT AS cnt FROM q, runs GROUP BY ALL)
        SELECT qid, flush, low, low + cnt AS high, cnt FROM m WHERE cnt > 0"""
)
def run_sample_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sample_ranges(runs.flush_runs(_arrived(spark, sf_dir)), _ranges(spark))


@query(
    f"""WITH {_RUNS}, q AS (SELECT * FROM (VALUES {_Q}) AS v(qid, lo, hi, k)),
        m AS (SELECT qid::BIGINT AS qid, flush, sum(n)::BIGINT AS cnt FROM q JOIN runs ON key BETWEEN lo AND hi GROUP BY ALL)
        SELECT qid, flush, cnt, sum(cnt) OVER (PARTITION BY qid)::BIGINT AS total FROM m"""
)
def alias_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_weights(runs.sample_ranges(runs.flush_runs(_arrived(spark, sf_dir)), _ranges(spark)))


@query(f"{_LEVELS} SELECT level, c AS runs, first AS first_flush, first + c * width - 1 AS last_flush FROM lv")
def level_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _levelled(spark, sf_dir).groupBy("level").agg(F.count_distinct("run").alias("runs"), F.min("flush").alias("first_flush"), F.max("flush").alias("last_flush"))
    return g.select(F.col("level").cast("long").alias("level"), "runs", "first_flush", "last_flush")


@query(
    f"""{_LEVELS} SELECT level, any_value(c) AS runs, sum(n)::BIGINT AS records, coalesce(sum(n) FILTER (WHERE op = 'D'), 0)::BIGINT AS tombstones,
        coalesce(sum(n) FILTER (WHERE op = 'D'), 0)::BIGINT * 1000000 // sum(n)::BIGINT AS per_million FROM runs JOIN lv ON flush >= first AND flush < first + c * width GROUP BY level"""
)
def tombstone_prop_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.level_stats(_levelled(spark, sf_dir))


@query("SELECT key // 100 AS bucket, count(*) AS cnt, max(key) AS max_key, (sum(count(*)) OVER (ORDER BY key // 100) - count(*))::BIGINT AS start FROM (SELECT o_custkey::BIGINT AS key FROM orders) GROUP BY 1")
def bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.bucket_index(_orders(spark, sf_dir), 100)


@query(_irs(_LIVE_ORDERS, 52))
def engine_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four batches through the engine, persisted, restored and sampled."""
    return Engine.restore(spark, _engine(spark, sf_dir, 4).persist()).range_sample(_ranges(spark), 52)


def _engine(spark: SparkSession, sf_dir: str, batches: int) -> Engine:
    """An engine that has taken the log in so many batches."""
    engine, log = Engine(spark, cap=CAP, scale=SCALE), _log(spark, sf_dir)
    width = (log.agg(F.max("seq")).first()[0] or 0) // batches + 1
    for part in range(batches):
        engine.apply(log.where(F.expr(f"seq div {width}") == part))
    return engine


#: Runs of the engine: the flushes of each, reduced, the oldest without deletes.
_ENGINE_RUNS = f"""{_LEVELS}, placed AS (SELECT level, first + (flush - first) // width * width AS begin, flush, key, value, op, n FROM runs JOIN lv ON flush >= first AND flush < first + c * width),
    e AS (SELECT level, begin, flush, key, value, sum(n) FILTER (WHERE op = 'I') AS ins, sum(n) FILTER (WHERE op = 'D') AS del FROM placed GROUP BY ALL),
    s AS (SELECT *, sum(coalesce(ins, 0) - coalesce(del, 0)) OVER (PARTITION BY level, begin, key, value ORDER BY flush) - coalesce(ins, 0) AS low, coalesce(ins, 0) - coalesce(del, 0) AS d FROM e),
    r AS (SELECT level, begin, key, value, sum(d) AS total, least(0, min(low)) AS low FROM s GROUP BY ALL),
    m AS (SELECT level, begin, total - low AS ins, CASE WHEN begin = 0 AND level > 0 THEN 0 ELSE -low END AS del FROM r)"""


@query(
    f"""{_ENGINE_RUNS} SELECT level::INT AS level, (row_number() OVER (PARTITION BY level ORDER BY begin) - 1)::INT AS run, sum(ins + del)::BIGINT AS reccnt, sum(del)::BIGINT AS tscnt, TRUE AS on_disk
        FROM m GROUP BY level, begin"""
)
def engine_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, records, tombstones and bytes of the levels after the whole log has come as one batch and is flushed."""
    engine = Engine(spark, cap=CAP, scale=SCALE)
    engine.apply(_log(spark, sf_dir))
    engine.flush()
    return engine.stats().select("level", "run", "reccnt", "tscnt", (F.col("bytes") > 0).alias("on_disk"))


@query(_LIVE_ORDERS)
def engine_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is live after batches, versions and a vacuum, as the restored engine sees it."""
    engine = _engine(spark, sf_dir, 3)
    engine.persist()
    engine.flush()
    engine.persist()
    engine.vacuum()
    return Engine.restore(spark, engine.folder).live()


@query(
    f"""WITH {_LOG} SELECT qid::BIGINT AS qid, any_value(k)::BIGINT AS draws, 0::BIGINT AS dead FROM (VALUES {_Q}) AS v(qid, lo, hi, k) JOIN ({_LIVE_ORDERS}) ON key BETWEEN lo AND hi GROUP BY qid"""
)
def engine_sample_by_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws by rejection over the runs of an engine: how many each range got, and how many of them aren't live there."""
    engine = _engine(spark, sf_dir, 3)
    got = engine.sample_by_runs(_ranges(spark), 54).join(_ranges(spark).select("qid", "lo", "hi"), "qid")
    alive = oplog.live_counts(_log(spark, sf_dir)).withColumn("alive", F.lit(True))
    wrong = F.col("alive").isNull() | ~F.col("key").between(F.col("lo"), F.col("hi"))
    return got.join(alive, ["key", "value"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("draws"), F.count_if(wrong).alias("dead"))


@query(
    f"""WITH RECURSIVE a AS (SELECT unnest([100, 101, 300, 1000, 5000, 20000, 77777]) AS appends), f AS (SELECT appends, greatest(0, (appends + 99) // 100 - 1) AS m FROM a),
        l AS (SELECT appends, m, 0 AS height FROM f UNION ALL SELECT appends, (m - 1) // {SCALE}, height + 1 FROM l WHERE m > 0)
        SELECT appends::BIGINT AS appends, max(height)::BIGINT AS height FROM l GROUP BY appends"""
)
def height_by_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, height_after(n, 100, SCALE)) for n in (100, 101, 300, 1000, 5000, 20000, 77777)], "appends long, height long")


# -- order, percentiles, histograms


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey < before)::BIGINT AS breaks FROM (SELECT o_custkey, lag(o_custkey) OVER (ORDER BY o_orderkey) AS before FROM orders)")
def verify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in the order of customers when orders stand by their own keys, by chunks with borders."""
    o = _table(spark, sf_dir, "orders")
    return stats.disorder(o.select(F.col("o_orderkey").cast("long").alias("pos"), F.col("o_custkey").cast("long").alias("key"), F.lit(0).cast("long").alias("value")), chunk=500)


@query(f"SELECT page, pos, key, value FROM (SELECT *, pos // {ix.PAGE} AS page FROM (SELECT row_number() OVER (ORDER BY key, value) - 1 AS pos, key, value FROM ({_ORDERS}))) WHERE page BETWEEN 1 AND 5")
def page_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.page_range(ix.build(_orders(spark, sf_dir), 1), 1, 5)


@query(f"SELECT pos, key, value FROM (SELECT row_number() OVER (ORDER BY key, value) - 1 AS pos, key, value FROM ({_ORDERS})) WHERE pos % 97 = 5")
def positional_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th ordinal, and two that no record has."""
    index = ix.build(_orders(spark, sf_dir))
    asked = spark.range(5, index.size, 97).unionByName(spark.createDataFrame([(-1,), (1 << 40,)], "id long"))
    return ix.at_positions(index, asked.select(F.col("id").alias("pos")))


@query(f"(SELECT * FROM ({_ORDERS}) ORDER BY key, value LIMIT 50)")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ends(_orders(spark, sf_dir), 50)


@query(f"(SELECT * FROM ({_ORDERS}) ORDER BY key DESC, value DESC LIMIT 50)")
def reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ends(_orders(spark, sf_dir), 50, forward=False)


@query(
    """SELECT min(v) AS least, round(quantile_cont(v, 0.25), 3) AS p0, round(quantile_cont(v, 0.5), 3) AS p1, round(quantile_cont(v, 0.75), 3) AS p2, round(quantile_cont(v, 0.99), 3) AS p3, max(v) AS most
       FROM (SELECT floor(o_totalprice) AS v FROM orders)"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.percentiles(_table(spark, sf_dir, "orders"), F.floor("o_totalprice"), [0.25, 0.5, 0.75, 0.99])
    return got.select("least", *[F.round(p, 3).alias(p) for p in ("p0", "p1", "p2", "p3")], "most")


@query(
    """WITH v AS (SELECT o_custkey::BIGINT AS v FROM orders), e AS (SELECT min(v) AS a, max(v) AS z, (max(v) - min(v)) // 20 AS w FROM v),
        c AS (SELECT greatest(1, (v - a + w - 1) // w) AS bin, count(*) AS cnt FROM v, e GROUP BY 1),
        b AS (SELECT unnest(range(1, greatest(1, (z - a + w - 1) // w) + 1)) AS bin, a, w FROM e)
        SELECT bin, a + (bin - 1) * w AS lo, a + bin * w AS hi, coalesce(cnt, 0) AS cnt FROM b LEFT JOIN c USING (bin)"""
)
def equi_width_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_orders(spark, sf_dir), "key", 20)


# -- sources


@query(
    f"""WITH l AS (SELECT i AS line, {_h("'lo'", "i")} % 1000 AS lo, {_h("'hi'", "i")} % 1000 AS hi, ({_h("'sel'", "i")} % 300)::DOUBLE / 1000 AS sel FROM range(683) AS t(i))
        SELECT line, lo, hi, sel FROM l WHERE line // 100 = 2 AND lo < hi AND abs(sel - 0.1) / 0.1 < 0.1"""
)
def query_file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("line")
    lines = spark.range(683).select(F.col("id").alias("line"))
    lines = lines.select("line", (hashed("lo", i) % 1000).alias("lo"), (hashed("hi", i) % 1000).alias("hi"), ((hashed("sel", i) % 300).cast("double") / 1000).alias("sel"))
    return files.query_block(lines, 2, 0.1)


@query("SELECT i AS key, i AS value FROM range(10000) AS t(i)")
def uniform_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.sequential(spark, 10_000)


@query(f"SELECT i AS key, row_number() OVER (ORDER BY {_h("'7'", "i")}, i) AS value FROM range(10000) AS t(i)")
def shuffled_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.shuffled(spark, 10_000, 7)


@query("SELECT event_id::BIGINT AS value, floor(((event_id % 36000) / 100.0::DOUBLE - 180.0 + 180.0) * 1e7)::BIGINT AS key FROM events".replace("(event_id % 36000) / 100.0::DOUBLE", "(event_id % 36000)::DOUBLE / 100.0::DOUBLE"))
def osm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("event_id") % 36000).cast("double") / F.lit(100.0) - F.lit(180.0)
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("value"), files.longitude_key(lon).alias("key"))


@query(
    f"""WITH r AS (SELECT o_orderkey::BIGINT AS n, o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value FROM orders),
        c AS (SELECT n * 2 + 1 AS seq, {_h("'9'", "'pick'", "n")} % n AS pick FROM r WHERE n > 0 AND {_h("'9'", "'del'", "n")} % 100 < 5)
        SELECT n * 2 AS seq, key, value, 'I' AS op FROM r UNION ALL SELECT seq, key, value, 'D' FROM c JOIN r ON r.n = c.pick"""
)
def workload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.workload(_orders(spark, sf_dir).withColumn("n", F.col("value")), 5, 9)


@query(
    f"""SELECT op, count(*) AS n FROM (SELECT CASE WHEN h < 60 THEN 'write' WHEN h < 65 THEN 'delete' ELSE 'read' END AS op
        FROM (SELECT {_h("'3'", "'op'", "i")} % 100 AS h FROM range(20000) AS t(i))) GROUP BY op"""
)
def mixed_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.mixed(spark, 20_000, 60, 5, 3).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT (row_number() OVER (ORDER BY key, value) - 1) // 700 AS batch, key, value FROM ({_ORDERS})")
def record_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through files of records, read in batches of 700."""
    path = new_folder(spark, "records")
    files.write_records(_orders(spark, sf_dir).repartitionByRange(3, "key", "value").sortWithinPartitions("key", "value"), path)
    return files.record_batches(spark, path, 700)


@query("SELECT o_custkey::BIGINT AS key, o_orderkey::BIGINT AS value, (o_orderkey % 4)::BIGINT AS weight FROM orders")
def weighted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "weighted")
    _orders(spark, sf_dir).select("value", "key", F.col("value") % 4).write.csv(path, sep="\t")
    return files.read_weighted(spark, path)


@query(
    f"""WITH q AS (SELECT i AS qid, 100 + {_h("'5'", "'range'", "i")} % (901) AS lo FROM range(300) AS t(i))
        SELECT qid, lo, lo + 99 AS hi, 1000::BIGINT AS k FROM q"""
)
def random_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.ranges(spark, 300, 100, 1099, 0.1, seed=5)


@query(f"SELECT row_number() OVER (ORDER BY {_h("'11'", "o_orderkey")}, o_orderkey) - 1 AS pos, o_orderkey::BIGINT AS value FROM orders")
def external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order that a hash of their keys gives, with their places in it."""
    return generators.placed_shuffle(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("value")), 11, "value")


# -- learned index

_KNOTS = """WITH p AS (SELECT o_custkey::BIGINT AS key, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos FROM orders),
    f AS (SELECT key, min(pos) AS pos FROM p GROUP BY key),
    k AS (SELECT key AS x, pos AS y FROM f WHERE key IN (SELECT key FROM p WHERE pos % 512 = 0) OR key = (SELECT max(key) FROM f)),
    s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM k)"""


@query(
    f"""{_KNOTS}, c AS (SELECT probe::BIGINT AS probe, v.x::BIGINT AS x, least(greatest(v.x, (SELECT min(x) FROM k)), (SELECT max(x) FROM k)) AS c FROM (VALUES {_P}) AS v(probe, x))
        SELECT probe, c.x, CASE WHEN nx IS NULL THEN y ELSE y + (c - s.x) * (ny - y) // (nx - s.x) END::BIGINT AS estimate FROM c JOIN s ON c >= s.x AND (nx IS NULL OR c < nx)"""
)
def spline_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spline.estimate(spline.fixed_knots(ix.build(_orders(spark, sf_dir)), 512), _probes(spark))


@query("SELECT count(DISTINCT o_custkey) AS n_keys, 0::BIGINT AS outside FROM orders")
def spline_search_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose first ordinal lies outside the search bounds of greedy corridors of error 32."""
    index = ix.build(_orders(spark, sf_dir))
    firsts = spline.first_positions(index).select(F.col("key").alias("probe"), F.col("key").alias("x"), "pos")
    total = index.size
    bounds = spline.search_bounds(spline.estimate(written(spline.greedy_knots(index, 32), "knots"), firsts.select("probe", "x")), total, 32)
    both = firsts.select("probe", "pos").join(bounds, "probe")
    return both.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if((F.col("pos") < F.col("begin")) | (F.col("pos") >= F.col("stop"))).alias("outside"))


@query(f"""{_KNOTS} SELECT count(*) AS knots, count(*) * 16 AS bytes FROM k""")
def spline_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spline.size_of(spline.fixed_knots(ix.build(_orders(spark, sf_dir)), 512))


# -- streaming


def _stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    _log(spark, sf_dir).repartition(4, "key").write.parquet(f"{folder}/in")
    return spark.readStream.schema(schema.OP_LOG).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")


@query(_LIVE_ORDERS)
def streaming_ingest_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live set of a log that came as a stream of files."""
    folder = new_folder(spark, "stream")
    ingest.ingest(_stream(spark, sf_dir, folder), f"{folder}/log").awaitTermination()
    return oplog.live(ingest.read_log(spark, f"{folder}/log"))


@query(_LIVE_ORDERS)
def streaming_engine_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live set of an engine that took a stream of files, as of its last manifest."""
    folder = new_folder(spark, "stream")
    engine = Engine(spark, cap=CAP, scale=SCALE)
    ingest.into(_stream(spark, sf_dir, folder), engine, f"{folder}/progress").awaitTermination()
    return Engine.restore(spark, engine.folder).live()
