"""Profile scoring, ranking and statistics, bound to parts, line items and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.operators import stats
from tidewell.operators.ranking import row_numbers
from tidewell.registry import query
from tidewell.sources.tables import table

_PER_PART = "SELECT l_partkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1"


def _per_part(spark, d):
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(cents).alias("cents"))


@query(
    "agg_median",
    "SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events GROUP BY 1",
)
def agg_median(spark, d):
    return stats.upper_median(table(spark, d, "events"), "event_type", "value")


@query(
    "agg_quartile",
    """WITH q AS (SELECT event_type, quantile_cont(CAST(value AS DOUBLE), 0.25) AS a, quantile_cont(CAST(value AS DOUBLE), 0.75) AS b FROM events GROUP BY 1)
       SELECT q.event_type, round(a - 3 * (b - a), 6) AS low, round(b + 3 * (b - a), 6) AS high, count(*) FILTER (value < a - 0.5 * (b - a) OR value > b + 0.5 * (b - a)) AS outside
       FROM q JOIN events e ON q.event_type = e.event_type GROUP BY 1, 2, 3""",
)
def agg_quartile(spark, d):
    e = table(spark, d, "events")
    wide, narrow = stats.tukey_fences(e, "event_type", "value"), stats.tukey_fences(e, "event_type", "value", 0.5)
    narrow = narrow.select(F.col("event_type").alias("t"), F.col("low").alias("nl"), F.col("high").alias("nh"))
    out = e.join(F.broadcast(narrow), F.col("event_type") == F.col("t"))  # a row a type of event
    counts = out.groupBy("t").agg(F.count_if((F.col("value") < F.col("nl")) | (F.col("value") > F.col("nh"))).alias("outside"))
    return wide.join(counts, F.col("event_type") == F.col("t")).select(
        "event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "outside"
    )


@query(
    "agg_noise",
    """SELECT user_id, CASE WHEN (a + b) / 2 > 0 THEN round(abs(a - b) / ((a + b) / 2), 6) ELSE 0 END AS noise
       FROM (SELECT user_id, min(value) AS a, max(value) AS b FROM events GROUP BY 1)""",
)
def agg_noise(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return per.select("user_id", F.round(stats.noise(F.col("a"), F.col("b")), 6).alias("noise"))


@query("agg_bootstrap")
def agg_bootstrap(spark, d):
    return stats.bootstrap_interval(table(spark, d, "events"), "event_type", "value", "event_id")


@query(
    "agg_fractions",
    f"""WITH p AS ({_PER_PART}), b AS (SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bucket, cents
        FROM p JOIN part ON l_partkey = p_partkey)
        SELECT bucket, round(CAST(sum(cents) AS DOUBLE) / (SELECT sum(cents) FROM b), 8) AS fraction FROM b GROUP BY 1""",
)
def agg_fractions(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size")
    b = _per_part(spark, d).join(part, F.col("l_partkey") == F.col("p_partkey"))
    bucket = F.expr("CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END")
    per = b.groupBy(bucket.alias("bucket")).agg(F.sum("cents").alias("c"))
    whole = F.sum("c").over(Window.partitionBy())  # over three rows
    return per.select("bucket", F.round(F.col("c").cast("double") / whole, 8).alias("fraction"))


@query(
    "win_topshare",
    f"""WITH p AS ({_PER_PART}), r AS (SELECT cents, row_number() OVER (ORDER BY cents DESC, l_partkey) AS n FROM p)
        SELECT round(CAST(sum(cents) FILTER (n <= 1) AS DOUBLE) / sum(cents), 8) AS top1, round(CAST(sum(cents) FILTER (n <= 5) AS DOUBLE) / sum(cents), 8) AS top5 FROM r""",
)
def win_topshare(spark, d):
    p = _per_part(spark, d)
    top = p.orderBy(F.col("cents").desc(), "l_partkey").limit(5)
    best = top.agg(F.max("cents").alias("one"), F.sum("cents").alias("five"))
    return p.agg(F.sum("cents").cast("double").alias("all")).crossJoin(best).select(  # a row each
        F.round(F.col("one") / F.col("all"), 8).alias("top1"), F.round(F.col("five") / F.col("all"), 8).alias("top5")
    )


@query(
    "agg_distinct",
    f"""SELECT count(DISTINCT p_brand) AS brands FROM (SELECT * FROM ({_PER_PART}) ORDER BY cents DESC, l_partkey LIMIT 15) JOIN part ON l_partkey = p_partkey""",
)
def agg_distinct(spark, d):
    top = _per_part(spark, d).orderBy(F.col("cents").desc(), "l_partkey").limit(15)
    return top.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).agg(F.count_distinct("p_brand").alias("brands"))


@query(
    "win_rank",
    "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part",
)
def win_rank(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    ranked = row_numbers(part, ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], "rank")
    return ranked.select("p_partkey", "rank")


#: Fixed values of the verdict: cut-offs for a rewrite and for work upstream, and the caps of a saturated core, regex share and waiting share.
REWRITE_MIN, UPSTREAM_MIN, SATURATED_CAP, REGEX_CAP, IO_CAP = 0.50, 0.25, 0.10, 0.35, 0.50


@query(
    "prj_score",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS pure, l_discount * 5 AS rx, l_tax * 8 AS io, l_returnflag = 'A' AND l_linenumber = 1 AS saturated FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN saturated THEN least(pure, {SATURATED_CAP}) ELSE pure END AS score,
        CASE WHEN saturated THEN 'exclude' WHEN rx >= {REGEX_CAP} THEN 'upstream_only' WHEN io >= {IO_CAP} THEN 'upstream_only'
             WHEN pure >= {REWRITE_MIN} THEN 'rewrite' WHEN pure >= {UPSTREAM_MIN} THEN 'upstream_only' ELSE 'exclude' END AS verdict FROM s""",
)
def prj_score(spark, d):
    s = table(spark, d, "lineitem").withColumns(
        {
            "pure": F.col("l_quantity") / 50, "rx": F.col("l_discount") * 5, "io": F.col("l_tax") * 8,
            "saturated": (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1),
        }
    )
    pure, saturated = F.col("pure"), F.col("saturated")
    verdict = (
        F.when(saturated, "exclude").when(F.col("rx") >= REGEX_CAP, "upstream_only").when(F.col("io") >= IO_CAP, "upstream_only")
        .when(pure >= REWRITE_MIN, "rewrite").when(pure >= UPSTREAM_MIN, "upstream_only").otherwise("exclude")
    )
    score = F.when(saturated, F.least(pure, F.lit(SATURATED_CAP))).otherwise(pure)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"), verdict.alias("verdict"))


#: Fixed values of the bounds: scaling exponent, share of CPU in wall time, bytes allocated.
STEEP, WAITING, ALLOCATING = 1.3, 0.5, 1_000_000


@query(
    "prj_bound",
    f"""SELECT o_orderkey, CASE WHEN ln(big / small) / ln(4) > {STEEP} THEN 'work_volume' WHEN share < {WAITING} THEN 'syscall_io' WHEN alloc > {ALLOCATING} THEN 'allocation' ELSE 'compute' END AS bound
        FROM (SELECT o_orderkey, o_totalprice AS big, o_custkey * 50 + 1 AS small, (o_orderkey % 10 + 1) / 10.0::DOUBLE AS share, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice * 10 END AS alloc FROM orders)""",
)
def prj_bound(spark, d):
    small, big = F.col("o_custkey") * 50 + 1, F.col("o_totalprice")
    share = (F.col("o_orderkey") % 10 + 1) / F.lit(10.0)
    alloc = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_totalprice") * 10)
    bound = (
        F.when(F.ln(big / small) / F.ln(F.lit(4)) > STEEP, "work_volume").when(share < WAITING, "syscall_io")
        .when(alloc > ALLOCATING, "allocation").otherwise("compute")
    )
    return table(spark, d, "orders").select("o_orderkey", bound.alias("bound"))


#: Plausible speed-up by bound, where none is measured.
SPEEDUP_CAPS = {"work_volume": 1.5, "syscall_io": 1.5, "allocation": 1.5, "memory_bandwidth": 2.0, "compute": 4.0, "memory_latency": 3.0, "branch": 2.0, "frontend": 1.3}


@query(
    "prj_cap",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * (1 - 1 / CASE l_returnflag WHEN 'A' THEN 1.5 WHEN 'N' THEN 4.0 ELSE greatest(l_tax * 30, 1.0) END), 8) AS ceiling FROM lineitem""",
)
def prj_cap(spark, d):
    cap = (
        F.when(F.col("l_returnflag") == "A", SPEEDUP_CAPS["work_volume"]).when(F.col("l_returnflag") == "N", SPEEDUP_CAPS["compute"])
        .otherwise(F.greatest(F.col("l_tax") * 30, F.lit(1.0)))
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_discount") * (1 - 1 / cap), 8).alias("ceiling")
    )


@query(
    "prj_gain",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN round((o_totalprice - o_custkey) / o_totalprice, 8) ELSE 0 END AS gain FROM orders",
)
def prj_gain(spark, d):
    base = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(base > 50000, F.round((base - F.col("o_custkey")) / base, 8)).otherwise(0.0).alias("gain")
    )


@query(
    "prj_classify_pkg",
    f"""WITH p AS ({_PER_PART}), alt(brand, verdict) AS (VALUES ('Brand#11', 'full'), ('Brand#22', 'noop'), ('Brand#33', 'upstream')),
        c AS (SELECT p_partkey, cents, CASE WHEN verdict IS NOT NULL THEN 'skip_' || verdict WHEN p_size < 3 THEN 'trivial' WHEN p_retailprice >= 1500 THEN 'native' ELSE 'mirror' END AS class
              FROM p JOIN part ON l_partkey = p_partkey LEFT JOIN alt ON brand = p_brand)
        SELECT p_partkey, class, CASE WHEN class IN ('mirror', 'native') THEN row_number() OVER (PARTITION BY class ORDER BY cents DESC, p_partkey) END AS rank FROM c""",
)
def prj_classify_pkg(spark, d):
    alt = spark.createDataFrame([("Brand#11", "full"), ("Brand#22", "noop"), ("Brand#33", "upstream")], "brand string, verdict string")
    j = _per_part(spark, d).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(F.broadcast(alt), F.col("brand") == F.col("p_brand"), "left")  # the curated rows above
    kind = (
        F.when(F.col("verdict").isNotNull(), F.concat(F.lit("skip_"), "verdict")).when(F.col("p_size") < 3, "trivial")
        .when(F.col("p_retailprice") >= 1500, "native").otherwise("mirror")
    )
    c = j.select("p_partkey", "cents", kind.alias("class"))
    ranked = row_numbers(c.filter(F.col("class").isin("mirror", "native")), ["class"], [F.col("cents").desc(), F.col("p_partkey")], "rank")
    ranked = ranked.select("p_partkey", "class", "rank")
    rest = c.filter(~F.col("class").isin("mirror", "native")).select("p_partkey", "class", F.lit(None).cast("int").alias("rank"))
    return ranked.unionByName(rest)
