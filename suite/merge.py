"""Keyed-mutation queries: J-02..J-04, J-11..J-16."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import register
from suite.fixtures import (customer_v2, daily_events, late_events, requests, with_views)
from tidemark.operators import merge as mg
from tidemark.sources.tables import read_table

CUST_COLS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def enc_sql(c: str) -> str:
    """SQL twin of ``encode_value``."""
    s = f"CAST({c} AS VARCHAR)"
    return f"COALESCE(CAST(length({s}) AS VARCHAR) || ':' || {s}, '~')"


def hash_sql(cols: list[str]) -> str:
    return "sha256(concat_ws('|', " + ", ".join(enc_sql(c) for c in cols) + "))"


register("j02_upsert", with_views(
    f"SELECT {CUST_COLS} FROM customer c WHERE NOT EXISTS "
    f"(SELECT 1 FROM customer_v2 v WHERE v.c_custkey = c.c_custkey) "
    f"UNION ALL SELECT {CUST_COLS} FROM customer_v2", "customer_v2"))(
    lambda spark, d: mg.upsert(read_table(spark, d, "customer"), customer_v2(spark, d), ["c_custkey"]))

EV_COLS = "event_id, ts, user_id, event_type, value, props, event_date, year, month, day"
register("j02_upsert_events", with_views(
    f"SELECT {EV_COLS} FROM daily_events e WHERE NOT EXISTS "
    f"(SELECT 1 FROM late_events l WHERE l.event_id = e.event_id) "
    f"UNION ALL SELECT {EV_COLS} FROM late_events", "late_events"))(
    lambda spark, d: mg.upsert(daily_events(spark, d), late_events(spark, d), ["event_id"]))

_SCOPE = "l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1999-01-01 00:00:00'"


def _j03(spark, d):
    li = read_table(spark, d, "lineitem")
    keep = li.where(F.col("l_returnflag") != "R").select("l_orderkey", "l_linenumber")
    scope = (F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")) & \
            (F.col("l_shipdate") < F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
    return mg.delete_keys_not_in(li, keep, ["l_orderkey", "l_linenumber"], scope)


register("j03_delete_keys_not_in",
         f"SELECT * FROM lineitem WHERE NOT COALESCE({_SCOPE}, false) UNION ALL "
         f"SELECT * FROM lineitem t WHERE COALESCE({_SCOPE}, false) AND EXISTS (SELECT 1 FROM lineitem k "
         f"WHERE k.l_returnflag <> 'R' AND k.l_orderkey IS NOT DISTINCT FROM t.l_orderkey "
         f"AND k.l_linenumber IS NOT DISTINCT FROM t.l_linenumber)")(_j03)

register("j04_delete_where", with_views(
    "SELECT * FROM daily_events WHERE NOT COALESCE(event_date = DATE '2024-01-15', false)", "daily_events"))(
    lambda spark, d: mg.delete_where(daily_events(spark, d), F.col("event_date") == F.lit("2024-01-15").cast("date")))

_CMP = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
register("j11_column_compare", with_views(
    "WITH j AS (SELECT s.c_custkey AS sk, d.c_custkey AS dk, " +
    ", ".join(f"s.{c} AS s_{c}, d.{c} AS d_{c}" for c in _CMP) +
    " FROM customer s FULL OUTER JOIN customer_v2 d ON s.c_custkey = d.c_custkey), "
    "a AS (SELECT " + ", ".join(
        f"COUNT(*) FILTER (WHERE sk IS NOT NULL AND dk IS NOT NULL AND s_{c} IS NOT DISTINCT FROM d_{c}) "
        f"AS {c}__m, COUNT(*) FILTER (WHERE sk IS NOT NULL AND dk IS NOT NULL AND s_{c} IS DISTINCT FROM d_{c}) "
        f"AS {c}__x" for c in _CMP) +
    ", COUNT(*) FILTER (WHERE dk IS NULL) AS only_s, COUNT(*) FILTER (WHERE sk IS NULL) AS only_d FROM j) " +
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}__m AS matches, {c}__x AS mismatches, "
                       f"only_s AS missing_in_destination, only_d AS missing_in_source FROM a" for c in _CMP),
    "customer_v2"))(
    lambda spark, d: mg.column_compare(read_table(spark, d, "customer"), customer_v2(spark, d), "c_custkey", _CMP))


def _j12(spark, d):
    ev = daily_events(spark, d)
    loaded = ev.where(F.col("event_date") < F.lit("2024-01-28").cast("date"))
    return mg.new_partitions(ev, loaded, "event_date")


register("j12_new_partitions", with_views(
    "SELECT DISTINCT CAST(event_date AS VARCHAR) AS event_date FROM daily_events "
    "WHERE CAST(event_date AS VARCHAR) NOT IN (SELECT CAST(event_date AS VARCHAR) FROM daily_events "
    "WHERE event_date < DATE '2024-01-28')", "daily_events"))(_j12)

_FP = ["text", "lang", "source"]


def _previous_requests(spark, d):
    """The previous run saw German texts before a correction pass."""
    r = requests(spark, d)
    return r.withColumn("text", F.when(F.col("lang") == "de", F.concat(F.col("text"), F.lit(" [v1]")))
                        .otherwise(F.col("text")))


_PREV_SQL = ("SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' [v1]' ELSE text END AS text, lang, source "
             "FROM requests")


def _j13(spark, d, which):
    reuse, todo = mg.reuse_split(requests(spark, d), _previous_requests(spark, d), ["doc_id"], _FP)
    return (reuse if which == 0 else todo).select("doc_id", "est_tokens")


for _i, _name, _op in [(0, "j13_reuse_unchanged", "EXISTS"), (1, "j13_to_process", "NOT EXISTS")]:
    register(_name, with_views(
        f"WITH p AS ({_PREV_SQL}) SELECT r.doc_id, r.est_tokens FROM requests r WHERE {_op} "
        f"(SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND {hash_sql(['p.' + c for c in _FP])} = "
        f"{hash_sql(['r.' + c for c in _FP])})", "requests"))(
        (lambda i: lambda spark, d: _j13(spark, d, i))(_i))


register("j14_reconcile_results", with_views(
    "SELECT COALESCE(r.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' "
    "WHEN r.doc_id IS NULL THEN 'extra' ELSE 'ok' END AS status "
    "FROM (SELECT doc_id FROM requests) r FULL OUTER JOIN (SELECT doc_id FROM labels) l ON r.doc_id = l.doc_id",
    "requests"))(
    lambda spark, d: mg.reconcile_results(requests(spark, d), read_table(spark, d, "labels"), "doc_id"))


def _j15(spark, d):
    li = read_table(spark, d, "lineitem")
    sup = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    j = mg.lookup_join(mg.lookup_join(li, sup, li.l_suppkey == sup.s_suppkey), nat,
                       F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"),
        F.count(F.lit(1)).alias("lines"))


register("j15_broadcast_join",
         "SELECT n_name, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue, COUNT(*) AS lines "
         "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey "
         "GROUP BY n_name")(_j15)

_VALS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
register("j16_change_feed", with_views(
    "WITH o AS (SELECT *, " + hash_sql(_VALS) + " AS h FROM customer), "
    "n AS (SELECT *, " + hash_sql(_VALS) + " AS h FROM customer_v2) "
    f"SELECT {CUST_COLS}, 'insert' AS _change_type FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o) "
    f"UNION ALL SELECT {CUST_COLS}, 'delete' FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n) "
    f"UNION ALL SELECT o.c_custkey, o.c_name, o.c_nationkey, o.c_acctbal, o.c_mktsegment, 'update_preimage' "
    f"FROM o JOIN n ON o.c_custkey = n.c_custkey WHERE o.h <> n.h "
    f"UNION ALL SELECT n.c_custkey, n.c_name, n.c_nationkey, n.c_acctbal, n.c_mktsegment, 'update_postimage' "
    f"FROM o JOIN n ON o.c_custkey = n.c_custkey WHERE o.h <> n.h", "customer_v2"))(
    lambda spark, d: mg.change_feed(read_table(spark, d, "customer"), customer_v2(spark, d), ["c_custkey"]))


def _evolved(spark, d):
    """Two versions of customer keyed by nation (repeated keys): the new one has lost a column and gained another."""
    cols = ["c_nationkey", "c_custkey", "c_acctbal"]
    old = read_table(spark, d, "customer").select(*cols, "c_mktsegment")
    tier = F.when(F.col("c_custkey") % 10 == 0, "gold").alias("tier")
    return old.where("c_custkey % 3 > 0"), customer_v2(spark, d).select(*cols, tier).where("c_custkey % 3 > 0")


register("j16_evolved_and_repeated", with_views(
    "WITH o AS (SELECT c_nationkey, c_custkey, c_acctbal, CAST(NULL AS VARCHAR) AS tier, c_mktsegment FROM customer WHERE c_custkey % 3 > 0), "
    "n AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN 'gold' END AS tier, CAST(NULL AS VARCHAR) AS "
    "c_mktsegment FROM customer_v2 WHERE c_custkey % 3 > 0), "
    "lost AS (SELECT * FROM o EXCEPT ALL SELECT * FROM n), gained AS (SELECT * FROM n EXCEPT ALL SELECT * FROM o) "
    "SELECT *, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM gained) THEN 'update_preimage' ELSE 'delete' END AS _change_type "
    "FROM lost UNION ALL "
    "SELECT *, CASE WHEN c_nationkey IN (SELECT c_nationkey FROM lost) THEN 'update_postimage' ELSE 'insert' END FROM gained",
    "customer_v2"))(lambda spark, d: mg.change_feed(*_evolved(spark, d), ["c_nationkey"]))


def _two_runs(spark, d):
    """A run over the earlier requests is recorded; a second one over today's finds what is unchanged and records the rest; a
    third finds everything."""
    import datetime as dt
    from suite.loading import scratch
    from tidemark.plans import reuse
    store, cols = scratch(spark, "j13-store"), ["doc_id", *_FP]
    reuse.record(spark, store, _previous_requests(spark, d).select(*cols), ["doc_id"], _FP, "run-1", dt.datetime(2024, 1, 1))
    second = reuse.probe(spark, store, requests(spark, d).select(*cols), ["doc_id"], _FP)
    todo = second.where("result_location is null").drop("result_location")
    reuse.record(spark, store, todo, ["doc_id"], _FP, "run-2", dt.datetime(2024, 1, 2))
    third = reuse.probe(spark, store, requests(spark, d).select(*cols), ["doc_id"], _FP)
    return third.select("doc_id", F.col("result_location").alias("processed_by"))


register("j13_store_two_runs", with_views(
    f"WITH p AS ({_PREV_SQL}) SELECT r.doc_id, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.doc_id = r.doc_id AND "
    f"{hash_sql(['p.' + c for c in _FP])} = {hash_sql(['r.' + c for c in _FP])}) THEN 'run-1' ELSE 'run-2' END AS processed_by "
    "FROM requests r", "requests"))(_two_runs)
