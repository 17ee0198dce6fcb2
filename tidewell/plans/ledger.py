"""Ledger analytics, bound to the driver's tables: line items stand for attempts, orders for runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import ledger as L
from tidewell.operators.ranking import row_numbers
from tidewell.registry import query
from tidewell.sources.tables import table

_CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _attempts(spark, d):
    """Returned line items failed; the gain of those of quantity over 45 is unknown."""
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("bound"),
        F.col("l_linestatus").alias("technique"),
        F.year("l_shipdate").alias("tier"),
        F.expr("CASE WHEN l_quantity <= 45 THEN l_discount * 100 END").alias("gain"),
        "l_returnflag",
    )


@query(
    "agg_yield",
    """SELECT l_returnflag AS bound, year(l_shipdate) AS tier, l_linestatus AS technique, count(*) AS n,
       round(avg(CASE WHEN l_quantity <= 45 THEN l_discount * 100 END), 6) AS avg_gain FROM lineitem GROUP BY 1, 2, 3""",
)
def agg_yield(spark, d):
    a = _attempts(spark, d)
    failed, done = a.filter("l_returnflag = 'R'"), a.filter("l_returnflag <> 'R'")
    return L.yield_by(done, failed, ["bound", "tier", "technique"], "gain").select(
        "bound", F.col("tier").cast("long").alias("tier"), "technique", "n", F.round("avg_gain", 6).alias("avg_gain")
    )


@query(
    "agg_calib",
    "SELECT l_returnflag AS bound, round(avg(l_tax - l_discount), 6) AS avg_overpredict FROM lineitem GROUP BY 1",
)
def agg_calib(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("bound")).agg(
        F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 6).alias("avg_overpredict")
    )


@query(
    "agg_kills",
    "SELECT CASE WHEN l_quantity < 40 THEN l_linestatus END AS gate, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1",
)
def agg_kills(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return rows.groupBy(F.expr("CASE WHEN l_quantity < 40 THEN l_linestatus END").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_cost",
    """SELECT s_nationkey AS model, round(sum(l_quantity) / nullif(sum(CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE l_discount END), 0), 4) AS per_point
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""",
)
def agg_cost(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    gain = F.expr("CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE l_discount END")
    return j.groupBy(F.col("s_nationkey").alias("model")).agg(F.round(L.ratio_of_sums("l_quantity", gain), 4).alias("per_point"))


@query(
    "agg_spend",
    """SELECT coalesce(sum(x), 0)::BIGINT AS spent, count(*) FILTER (k = 'o') AS n_orders, count(*) FILTER (k = 'l') AS n_lines FROM (
       SELECT 'o' AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS x FROM orders
       UNION ALL SELECT 'l', CAST(round(l_extendedprice * 100) AS BIGINT) FROM lineitem)""",
)
def agg_spend(spark, d):
    o = table(spark, d, "orders").select(F.lit("o").alias("k"), F.expr(_CENTS).alias("x"))
    i = table(spark, d, "lineitem").select(F.lit("l").alias("k"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("x"))
    return o.unionByName(i).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("spent"),
        F.count_if(F.col("k") == "o").alias("n_orders"),
        F.count_if(F.col("k") == "l").alias("n_lines"),
    )


@query(
    "jn_gate_unit",
    """SELECT o_orderkey, l_linenumber, l_returnflag, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def jn_gate_unit(spark, d):
    units = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    gates = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return gates.join(units, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", "l_linenumber", "l_returnflag", "o_orderstatus"
    )


@query(
    "jn_gate_count",
    """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS failed
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def jn_gate_count(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("failed")
    )


@query(
    "jn_unit_gates",
    """SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS gates
       FROM lineitem GROUP BY 1""",
)
def jn_unit_gates(spark, d):
    nested = L.nest(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_returnflag"], "gates")
    shown = F.transform("gates", lambda g: F.concat_ws(":", g["l_linenumber"], g["l_returnflag"]))
    return nested.select("l_orderkey", F.array_join(shown, ",").alias("gates"))


@query(
    "jn_equiv",
    """WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS s,
                  CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0),
       e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE o_orderstatus END AS s, o_totalprice AS v FROM orders)
       SELECT count(*) AS total, count(*) FILTER (a.k IS NOT NULL AND e.s IS NOT DISTINCT FROM a.s AND e.v IS NOT DISTINCT FROM a.v) AS matched,
       count(*) FILTER (a.k IS NOT NULL AND NOT (e.s IS NOT DISTINCT FROM a.s AND e.v IS NOT DISTINCT FROM a.v)) AS mismatched,
       count(*) FILTER (a.k IS NULL) AS missing FROM e LEFT JOIN a ON e.k = a.k""",
)
def jn_equiv(spark, d):
    o = table(spark, d, "orders")
    expected = o.selectExpr("o_orderkey AS k", "CASE WHEN o_orderkey % 22 = 0 THEN NULL ELSE o_orderstatus END AS s", "o_totalprice AS v")
    actual = o.filter("o_orderkey % 7 <> 0").selectExpr(
        "o_orderkey AS k", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS s",
        "CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v",
    )
    return L.compare_pairs(expected, actual, "k", ["s", "v"])


@query(
    "jn_session",
    """WITH e AS (SELECT l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE max(l_shipdate) END AS v FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1, 2),
       f AS (SELECT l_partkey, max(l_shipdate) AS v FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1)
       SELECT l_orderkey, l_linenumber, CASE WHEN e.l_partkey IS NOT NULL THEN e.v ELSE f.v END AS v
       FROM lineitem i LEFT JOIN e USING (l_partkey, l_suppkey) LEFT JOIN f ON i.l_partkey = f.l_partkey""",
)
def jn_session(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    exact = i.filter("l_partkey % 3 = 0").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("m"))
    exact = exact.selectExpr("l_partkey", "l_suppkey", "CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE m END AS v")
    loose = i.filter("l_partkey % 2 = 0").groupBy("l_partkey").agg(F.max("l_shipdate").alias("v"))
    out = L.lookup_with_fallback(i.drop("l_shipdate"), exact, loose, ["l_partkey", "l_suppkey"], ["l_partkey"], "v")
    return out.select("l_orderkey", "l_linenumber", "v")


@query(
    "jn_antifail",
    """SELECT p_partkey, p_retailprice / p_size AS ratio FROM part
       WHERE p_size >= 5 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)
       ORDER BY ratio DESC, p_partkey LIMIT 25""",
)
def jn_antifail(spark, d):
    failed = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    top = L.best_ratio(part, failed, ["p_partkey"], F.col("p_retailprice"), F.col("p_size"), F.col("p_size") >= 5, 25, "p_partkey")
    return top.select("p_partkey", "ratio")


@query(
    "jn_first_hunk",
    """SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (
       SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1""",
)
def jn_first_hunk(spark, d):
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f"))
    j = table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", "f.l_linenumber", "f.l_partkey")


@query(
    "jn_deps_all",
    """SELECT o_orderkey, bool_and(coalesce(p_size, 0) >= 3) AS ready FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def jn_deps_all(spark, d):
    j = (
        table(spark, d, "orders").select("o_orderkey")
        .join(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    return j.groupBy("o_orderkey").agg(F.every(F.coalesce("p_size", F.lit(0)) >= 3).alias("ready"))


@query(
    "jn_file_hash",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state
       FROM (SELECT o_orderkey AS k, md5(o_orderpriority) AS h FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN
       (SELECT o_orderkey AS k, md5(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderkey % 3 <> 0) b ON a.k = b.k""",
)
def jn_file_hash(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderkey % 5 <> 0").selectExpr("o_orderkey AS k", "md5(o_orderpriority) AS h")
    b = o.filter("o_orderkey % 3 <> 0").selectExpr("o_orderkey AS k2", "md5(CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END) AS h2")
    j = a.join(b, F.col("k") == F.col("k2"), "full_outer")
    state = F.expr("CASE WHEN k IS NULL THEN 'added' WHEN k2 IS NULL THEN 'removed' WHEN h = h2 THEN 'same' ELSE 'changed' END")
    return j.select(F.coalesce("k", "k2").alias("k"), state.alias("state"))


@query(
    "agg_dominant",
    """WITH p AS (SELECT conv_id, role, sum(length(text)) AS a FROM conversations GROUP BY 1, 2)
       SELECT conv_id, (list(role ORDER BY a DESC, role))[1] AS dominant, CAST(max(a) AS BIGINT) AS amount, CAST(sum(a) AS BIGINT) AS total FROM p GROUP BY 1""",
)
def agg_dominant(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "role", F.char_length("text").cast("long").alias("n"))
    return L.dominant(rows, "conv_id", "role", "n")


@query("agg_span", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY 1")
def agg_span(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")
    )


@query(
    "flt_runs",
    """SELECT user_id, max(ts) AS last_ts FROM events WHERE user_id % 3 <> 0 GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-29 12:00:00'""",
)
def flt_runs(spark, d):
    runs = table(spark, d, "events").filter("user_id % 3 <> 0").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return runs.filter("last_ts >= TIMESTAMP_NTZ '2024-01-29 12:00:00'")


@query("agg_kinds", "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg_kinds(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


@query(
    "agg_merge_rate",
    """SELECT l_returnflag, l_linestatus, count(*) FILTER (l_discount >= 0.05) AS merged, count(*) AS attempts FROM lineitem
       WHERE l_linenumber > 1 GROUP BY 1, 2""",
)
def agg_merge_rate(spark, d):
    rows = table(spark, d, "lineitem").filter("l_linenumber > 1")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("l_discount") >= 0.05).alias("merged"), F.count(F.lit(1)).alias("attempts")
    )


@query(
    "prj_first_fail",
    """SELECT l_orderkey, bool_and(l_quantity <= 40) AS all_passed, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) FILTER (l_quantity > 40) AS first_failed
       FROM lineitem GROUP BY 1""",
)
def prj_first_fail(spark, d):
    rows = table(spark, d, "lineitem").withColumn("pos", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    return L.first_failing(rows, "l_orderkey", "pos", "l_returnflag", F.col("l_quantity") <= 40)


@query(
    "win_compound",
    """SELECT day, round(exp(sum(ln(1 + pct / 100)) OVER (ORDER BY day)) - 1, 6) AS compound FROM (
       SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) / count(*) AS pct FROM events GROUP BY 1)""",
)
def win_compound(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("pct")
    )
    return L.compound_by_day(days, "day", "pct").select("day", F.round("compound", 6).alias("compound"))


@query(
    "win_latest",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1""",
)
def win_latest(spark, d):
    latest = F.max(F.struct("ts", "event_id", "event_type"))
    return table(spark, d, "events").groupBy("user_id").agg(latest.alias("x")).select("user_id", "x.event_type", "x.ts")


@query(
    "agg_vote",
    """SELECT conv_id AS motion, min(stance) = max(stance) AS consensus, count(*) AS votes,
       coalesce(CASE WHEN min(stance) = max(stance) THEN min(stance) END, max(CASE WHEN turn = 0 THEN stance END)) AS decision
       FROM (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'no' ELSE 'yes' END AS stance FROM conversations) GROUP BY 1""",
)
def agg_vote(spark, d):
    rows = table(spark, d, "conversations").selectExpr(
        "conv_id AS motion", "turn", "CASE WHEN char_length(text) % 3 = 0 THEN 'no' ELSE 'yes' END AS stance"
    )
    return L.vote(rows, "motion", "turn", "stance", F.col("turn") == 0)


@query(
    "snk_combine",
    """SELECT src_ord, count(*) AS n, CAST(sum(v) AS BIGINT) AS v FROM (SELECT k, min(src_ord) AS src_ord, arg_min(v, src_ord) AS v FROM (
       SELECT o_orderkey AS k, 0 AS src_ord, o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0
       UNION ALL SELECT o_orderkey, 1, o_custkey + 1 FROM orders WHERE o_orderkey % 3 = 0
       UNION ALL SELECT o_orderkey, 2, o_custkey + 2 FROM orders) GROUP BY k) GROUP BY 1""",
)
def snk_combine(spark, d):
    o = table(spark, d, "orders")
    parts = [
        o.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_custkey AS v"),
        o.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey AS k", "o_custkey + 1 AS v"),
        o.selectExpr("o_orderkey AS k", "o_custkey + 2 AS v"),
    ]
    return L.keep_first(parts, "k").groupBy("src_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(
    "snk_upsert",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders""",
)
def snk_upsert(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 8 <> 0").selectExpr("o_orderkey AS k", "o_orderstatus AS s")
    return L.upsert(old, o.filter("o_orderkey % 4 = 0").selectExpr("o_orderkey AS k", "'new' AS s"), "k")


@query(
    "snk_insert_ignore",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders""",
)
def snk_insert_ignore(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 8 <> 0").selectExpr("o_orderkey AS k", "o_orderstatus AS s")
    return L.insert_ignore(old, o.filter("o_orderkey % 4 = 0").selectExpr("o_orderkey AS k", "'new' AS s"), "k")


@query(
    "snk_update",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) FILTER (event_type = 'purchase') AS ended_at FROM events GROUP BY 1""",
)
def snk_update(spark, d):
    e = table(spark, d, "events").select(
        "user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.expr("CASE WHEN event_type = 'purchase' THEN ts END").alias("end")
    )
    return L.fold_updates(e, "user_id", "at", {"status": "event_type"}, {"ended_at": "end"})


@query(
    "srt_multi",
    """SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_retailprice DESC, p_partkey) AS pos FROM part""",
)
def srt_multi(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    ranked = row_numbers(part, ["p_brand"], [F.col("p_size") % 3, F.col("p_retailprice").desc(), F.col("p_partkey")], "pos")
    return ranked.select("p_partkey", "p_size", "pos")


@query(
    "srt_topk_prof",
    "SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
)
def srt_topk_prof(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.expr("cast(round(l_extendedprice * 100) as bigint)")).alias("cents"))
    return per.orderBy(F.col("cents").desc(), "l_partkey").limit(8)


@query(
    "set_subset",
    """SELECT o_orderkey, len(list_filter(a, lambda x: NOT list_contains([1, 2, 3], x))) = 0 AS known FROM
       (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY 1)""",
)
def set_subset(spark, d):
    sets = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linenumber").alias("a"))
    known = F.array(*[F.lit(i) for i in (1, 2, 3)])
    return sets.select("o_orderkey", (F.size(F.array_except("a", known)) == 0).alias("known"))
