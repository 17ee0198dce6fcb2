"""Evidence joins, probes and text checks, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import linalg, matrix, similarity
from tidewell.registry import query
from tidewell.sources.tables import table


@query("agg_counts", "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events WHERE user_id % 2 = 0")
def agg_counts(spark, d):
    e = table(spark, d, "events").filter("user_id % 2 = 0")
    return e.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n"))


@query(
    "agg_oracle",
    """SELECT user_id, max(CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS clicks,
       max(CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS views FROM events GROUP BY 1""",
)
def agg_oracle(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, k))
    return table(spark, d, "events").groupBy("user_id").agg(of("click").alias("clicks"), of("view").alias("views"))


@query(
    "agg_wall",
    """SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' AND value > 0 THEN CAST(trunc(value) AS BIGINT) END), count(*)) AS wall FROM events GROUP BY 1""",
)
def agg_wall(spark, d):
    wall = F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 0), F.col("value").cast("long")))
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(wall, F.count(F.lit(1))).alias("wall"))


@query(
    "agg_outcomes",
    """SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY 1""",
)
def agg_outcomes(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("failed"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


@query(
    "agg_compound",
    "SELECT l_orderkey, round(product(1 + l_discount / 100) - 1, 8) AS compound FROM lineitem GROUP BY 1",
)
def agg_compound(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_discount") / 100) - 1, 8).alias("compound"))


@query(
    "flt_audit",
    "SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos, event_type FROM events WHERE user_id = 7",
)
def flt_audit(spark, d):
    one = table(spark, d, "events").filter("user_id = 7")  # a single run's log is put in order in one task
    return one.select("event_id", F.row_number().over(Window.orderBy("event_id")).alias("pos"), "event_type")


@query(
    "prj_loop_nature",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 AND p_size < 10 THEN 'thin_native' WHEN p_size / 100 >= 0.25 OR (p_size / 60 >= 0.55 AND p_partkey % 12 <= 3) THEN 'tight_loop'
       WHEN p_partkey % 12 >= 8 OR p_size / 60 < 0.25 THEN 'dispatch' ELSE 'pipeline' END AS nature FROM part""",
)
def prj_loop_nature(spark, d):
    top1, top5, hot = F.col("p_size") / 100, F.col("p_size") / 60, F.col("p_partkey") % 12
    # fixed values: a quarter for one function, 0.55 for five in at most 3 modules; 8 modules or under a quarter for five
    nature = (
        F.when((F.col("p_partkey") % 9 == 0) & (F.col("p_size") < 10), "thin_native")
        .when((top1 >= 0.25) | ((top5 >= 0.55) & (hot <= 3)), "tight_loop")
        .when((hot >= 8) | (top5 < 0.25), "dispatch")
        .otherwise("pipeline")
    )
    return table(spark, d, "part").select("p_partkey", nature.alias("nature"))


@query(
    "prj_caller",
    """SELECT o_orderkey, o_orderkey % 5 > 0 AND o_custkey // nullif(o_orderkey % 5, 0) >= 10 OR o_totalprice / 1e12 < 1e-7 AS batch FROM orders""",
)
def prj_caller(spark, d):
    need = F.col("o_orderkey") % 5
    many = F.when(need > 0, F.floor(F.col("o_custkey") / F.when(need > 0, need)) >= 10).otherwise(F.lit(False))
    return table(spark, d, "orders").select("o_orderkey", (many | (F.col("o_totalprice") / 1e12 < 1e-7)).alias("batch"))


@query(
    "jn_transcript",
    """WITH t AS (SELECT conv_id, max(role) AS model, CAST(sum(length(text)) AS BIGINT) AS tokens FROM conversations WHERE turn > 0 GROUP BY 1)
       SELECT c.conv_id, CASE WHEN t.model <> '' OR t.tokens > 0 THEN t.model ELSE 'unknown' END AS model, coalesce(t.tokens, 0) AS tokens
       FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id = c.conv_id""",
)
def jn_transcript(spark, d):
    c = table(spark, d, "conversations")
    t = c.filter("turn > 0").groupBy(F.col("conv_id").alias("t_id")).agg(F.max("role").alias("m"), F.sum(F.char_length("text").cast("long")).alias("t"))
    j = c.select("conv_id").distinct().join(t, F.col("conv_id") == F.col("t_id"), "left")
    used = (F.col("m") != "") | (F.col("t") > 0)
    return j.select("conv_id", F.when(used, F.col("m")).otherwise("unknown").alias("model"), F.coalesce("t", F.lit(0)).alias("tokens"))


@query(
    "jn_event_span",
    """SELECT c_custkey, datesub('second', a, b) AS span FROM customer LEFT JOIN (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def jn_event_span(spark, d):
    spans = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    j = table(spark, d, "customer").join(spans, F.col("user_id") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.timestamp_diff("SECOND", F.col("a"), F.col("b")).alias("span"))


@query(
    "jn_decisions",
    """SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer) ON c_custkey = o_custkey
       LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""",
)
def jn_decisions(spark, d):
    per = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.join(per, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "n")


@query(
    "jn_dims",
    """SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2""",
)
def jn_dims(spark, d):
    region = table(spark, d, "region").filter("r_regionkey <> 2")
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query(
    "jn_edge_resolve",
    """WITH index AS (SELECT p_name, min(p_partkey) AS owner FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_partkey, owner, owner IS NULL AS unresolved FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN index USING (p_name)""",
)
def jn_edge_resolve(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    index = part.filter("p_partkey % 3 <> 0").groupBy("p_name").agg(F.min("p_partkey").alias("owner"))
    uses = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return uses.join(index, "p_name", "left").select("l_orderkey", "l_linenumber", "l_partkey", "owner", F.col("owner").isNull().alias("unresolved"))


@query(
    "win_firstk_lines",
    r"""SELECT doc_id, len(list_filter(string_split(text, E'\n')[1:5], lambda x: length(x) > 80)) > 0 AS long_head FROM documents""",
)
def win_firstk_lines(spark, d):
    head = F.slice(F.split("text", "\n", -1), 1, 5)
    return table(spark, d, "documents").select("doc_id", F.exists(head, lambda x: F.char_length(x) > 80).alias("long_head"))


@query("srt_take", "SELECT p_brand, count(*) AS n FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 500) GROUP BY 1")
def srt_take(spark, d):
    return table(spark, d, "part").orderBy("p_partkey").limit(500).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(
    "set_ranges",
    """SELECT r.lo, count(*) AS n FROM part JOIN (VALUES (1, 5), (4, 10), (20, 50)) r(lo, hi) ON p_size >= r.lo AND p_size < r.hi GROUP BY 1""",
)
def set_ranges(spark, d):
    ranges = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((1, 5), (4, 10), (20, 50))])
    inside = F.filter(ranges, lambda r: (F.col("p_size") >= r["lo"]) & (F.col("p_size") < r["hi"]))
    return table(spark, d, "part").select(F.explode(inside).alias("r")).groupBy("r.lo").agg(F.count(F.lit(1)).alias("n"))


@query("sim_osa")
def sim_osa(spark, d):
    p = table(spark, d, "part")
    j = p.select("p_partkey", F.col("p_name").alias("a")).join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey")
    return j.select("p_partkey", similarity.osa("a", "b").alias("osa"), F.round(similarity.jaro_winkler("a", "b"), 8).alias("jaro_winkler"))


@query(
    "dt_reldelta",
    """SELECT o_orderkey, CAST(o_orderdate + INTERVAL 13 MONTH AS DATE) - 3 AS shifted, CAST(date_trunc('month', o_orderdate) AS DATE) + ((12 - isodow(date_trunc('month', o_orderdate))) % 7)::INT + 7 AS second_friday FROM orders""",
)
def dt_reldelta(spark, d):
    day = F.to_date("o_orderdate")
    first = F.trunc(day, "month")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_sub(F.add_months(day, 13), 3).alias("shifted"),
        F.date_add(F.next_day(F.date_sub(first, 1), "FRI"), 7).alias("second_friday"),
    )


@query(
    "dt_iso",
    """SELECT event_id, ts AS parsed, strftime(ts, '%G-W%V-%u') AS week FROM events""",
)
def dt_iso(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = F.try_to_timestamp(text).cast("timestamp_ntz")
    day = F.to_date("ts")
    week = F.format_string("%04d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day), F.weekday(day) + 1)
    return table(spark, d, "events").select("event_id", parsed.alias("parsed"), week.alias("week"))


@query(
    "hdr_options",
    r"""SELECT page_id, lower(regexp_extract(h, '^([^;]*)', 1)) AS type, regexp_extract(h, 'name="([^"]*)"', 1) AS name FROM (SELECT page_id, 'Form-Data; name="' || url || '"; x=1' AS h FROM pages)""",
)
def hdr_options(spark, d):
    h = F.concat(F.lit('Form-Data; name="'), "url", F.lit('"; x=1'))
    return table(spark, d, "pages").select(
        "page_id", F.lower(F.regexp_extract(h, "^([^;]*)", 1)).alias("type"), F.regexp_extract(h, 'name="([^"]*)"', 1).alias("name")
    )


@query(
    "chs_class",
    r"""SELECT doc_id, regexp_matches(text, '[^\x00-\x7F]') AS not_ascii, regexp_matches(text, '\p{Lu}') AS upper FROM documents""",
)
def chs_class(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.rlike("text", F.lit(r"[^\x00-\x7F]")).alias("not_ascii"), F.rlike("text", F.lit(r"\p{Lu}")).alias("upper")
    )


@query("chs_decode", "SELECT doc_id, octet_length(encode(text)) AS bytes, length(text) AS chars FROM documents")
def chs_decode(spark, d):
    raw = F.encode("text", "UTF-8")
    text = F.try_validate_utf8(raw.cast("string"))
    return table(spark, d, "documents").select("doc_id", F.octet_length(raw).cast("long").alias("bytes"), F.char_length(text).cast("long").alias("chars"))


@query(
    "mx_linalg",
    """WITH m AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS e FROM embeddings),
       n AS (SELECT *, a * e - b * c AS det, (a + e) / 2 AS half, (a - e) * (a - e) / 4 + b * c AS disc FROM m)
       SELECT vec_id, round(det, 6) AS det, round(e, 6) AS i1, round(-b, 6) AS i2, round(-c, 6) AS i3, round(a, 6) AS i4,
         round(CASE WHEN disc > 0 THEN half - sqrt(disc) ELSE half END, 5) AS low, round(CASE WHEN disc > 0 THEN half + sqrt(disc) ELSE half END, 5) AS high,
         round(CASE WHEN disc < 0 THEN sqrt(-disc) ELSE 0 END, 5) AS imaginary FROM n""",
)
def mx_linalg(spark, d):
    """Determinant, inverse (times the determinant) and eigenvalues of two rows of two."""
    m = matrix.matrix(2, 2, F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", linalg.det(m).alias("d"), linalg.inverse(m).alias("i"), linalg.eigenvalues(m).alias("e"))
    adjoint = [F.round(F.col("i")[k] * F.col("d"), 6).alias(f"i{k + 1}") for k in range(4)]
    return rows.select(
        "vec_id", F.round("d", 6).alias("det"), *adjoint, F.round(F.col("e")[0], 5).alias("low"), F.round(F.col("e")[2], 5).alias("high"),
        F.round(F.abs(F.col("e")[3]), 5).alias("imaginary"),
    )
