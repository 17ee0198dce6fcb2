"""Gates, test summaries and candidates, bound to orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import matrix, versions
from tidewell.operators import gates as G
from tidewell.operators.ranking import row_numbers
from tidewell.registry import query
from tidewell.sources.tables import table

_PAIR = """l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS STRING) AS original,
  CASE WHEN l_partkey % 7 = 0 THEN 'x' || CAST(l_partkey AS STRING) WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) + CAST(0.01 AS DECIMAL(12, 2)) * l_linenumber AS STRING)
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS STRING) END AS ported,
  CASE WHEN l_orderkey % 2 = 0 AND l_linenumber <= 3 THEN CAST((l_suppkey % 5) AS DOUBLE) / 1000000 END AS rel_tol,
  CASE WHEN l_orderkey % 2 = 0 AND l_linenumber <= 3 THEN CAST((l_linenumber % 3) AS DOUBLE) / 100 END AS abs_tol"""


@query(
    "prj_tolerance",
    f"""WITH p AS (SELECT {_PAIR} FROM lineitem WHERE l_orderkey % 11 <> 0),
        n AS (SELECT *, TRY_CAST(original AS DOUBLE) AS x, TRY_CAST(ported AS DOUBLE) AS y, max(CASE WHEN rel_tol IS NOT NULL THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS last FROM p),
        w AS (SELECT *, CASE WHEN original = ported THEN NULL WHEN y IS NULL THEN 'mismatch'
              WHEN abs(x - y) > CASE WHEN last IS NULL THEN 0.000001 * greatest(abs(x), 1.0::DOUBLE) ELSE coalesce(abs_tol, 0) + coalesce(rel_tol, 0.000001) * greatest(abs(x), abs(y), 1.0::DOUBLE) END THEN 'tolerance_exceeded' END AS wrong FROM n),
        g AS (SELECT l_orderkey, count(*) AS n, min(CASE WHEN wrong IS NOT NULL THEN l_linenumber END) AS failed_at, min(struct_pack(i := l_linenumber, w := wrong)) FILTER (wrong IS NOT NULL) AS f FROM w GROUP BY 1),
        h AS (SELECT l_orderkey, n, failed_at, f.w AS wrong FROM g)
        SELECT o_orderkey, coalesce(n, 0) AS compared, n IS NOT NULL AND wrong IS NULL AS passed, CASE WHEN n IS NULL THEN 'empty_campaign' ELSE wrong END AS reason, failed_at
        FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""",
)
def prj_tolerance(spark, d):
    pairs = table(spark, d, "lineitem").filter("l_orderkey % 11 <> 0")  # the other campaigns are empty
    pairs = pairs.selectExpr(*_split(_PAIR)).withColumnsRenamed({"l_orderkey": "o_orderkey", "l_linenumber": "index"})
    return G.differential(table(spark, d, "orders"), pairs, "o_orderkey", 0.000001)


def _split(columns: str) -> list[str]:
    """Expressions of a select list, at its commas outside of brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_OUTCOME = "CASE WHEN l_orderkey % 13 = 0 THEN 'skip' WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'timeout' WHEN l_returnflag = 'R' THEN 'fail' WHEN l_linestatus = 'O' AND l_linenumber = 3 THEN 'xfail' ELSE 'pass' END"


def _outcomes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", F.expr("l_partkey % 50").alias("name"), F.expr(_OUTCOME).alias("outcome"))


@query(
    "prj_known_fail",
    f"""WITH o AS (SELECT l_orderkey, l_partkey % 50 AS name, {_OUTCOME} AS outcome FROM lineitem),
        g AS (SELECT l_orderkey, count(*) FILTER (outcome IN ('pass', 'fail', 'timeout')) AS ran, count(DISTINCT name) FILTER (outcome IN ('fail', 'timeout')) AS n_failed,
              count(DISTINCT name) FILTER (outcome IN ('fail', 'timeout') AND name >= 25) AS n_extras FROM o GROUP BY 1)
        SELECT l_orderkey, ran > 0 AND n_extras = 0 AS passed, CASE WHEN ran = 0 THEN 'empty_run' WHEN n_extras > 0 THEN 'failures_beyond_known' END AS reason, n_failed, n_extras FROM g""",
)
def prj_known_fail(spark, d):
    known = spark.range(25).select(F.col("id").alias("name"))
    return G.parity_with_known(_outcomes(spark, d), known, "l_orderkey")


@query(
    "prj_rates",
    f"""WITH o AS (SELECT l_orderkey, {_OUTCOME} AS outcome FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome IN ('fail', 'timeout')) AS failed, count(*) AS total,
               count(*) FILTER (outcome = 'pass') / count(*) AS pass_rate FROM o GROUP BY 1""",
)
def prj_rates(spark, d):
    return G.rates(_outcomes(spark, d), "l_orderkey")


@query(
    "prj_scope_gate",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 35 = 0 THEN 'touches_frozen_file' WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN 'input_size_branch'
       WHEN o_orderstatus = 'P' THEN 'api_changed' WHEN o_custkey % 7 = 0 THEN 'non_allowlisted_dep' END AS reason FROM orders""",
)
def prj_scope_gate(spark, d):
    files = F.expr("array('src/a.py', CASE WHEN o_orderkey % 6 = 0 THEN 'unit/test/b.py' WHEN o_orderkey % 35 = 0 THEN 'benches/c.py' ELSE 'src/d.py' END)")
    added = F.expr("array('x = 1', CASE WHEN o_custkey % 4 = 0 THEN '  if len(x) > 9:' ELSE 'return size' END)")
    v = G.scope(
        files, added, F.expr("o_orderkey % 2"), F.expr("CASE WHEN o_orderstatus = 'P' THEN array('f') ELSE array() END"),
        F.expr("CASE WHEN o_custkey % 7 = 0 THEN array('numpy', 'odd') ELSE array('numpy') END"), F.array(F.lit("numpy")),
    )
    return table(spark, d, "orders").select("o_orderkey", v["reason"].alias("reason"))


_G = "CAST(o_custkey % 100 AS DOUBLE) / 100"
_H = "CAST(o_orderkey % 100 AS DOUBLE) / 100"


@query(
    "prj_gates",
    f"""WITH o AS (SELECT *, {_G} AS g, {_H} AS h FROM orders)
        SELECT o_orderkey, g - h < 0.25 AS heldout, NOT (g - (h - 0.5) > 0.1 OR h - 0.5 < 0) AS workload,
          abs(h) <= 0.05 OR abs(h) <= 0.5 * greatest(abs(g), 1e-9) AS causal,
          CASE WHEN o_orderkey % 17 = 0 THEN 'other_workload_regressed' WHEN o_orderkey % 19 = 0 THEN 'heldout_regressed' WHEN (1000 * (1 + g * 10 / 100) - 1000) / 1000 * 100 > 5 THEN 'rss_regression'
               WHEN o_orderkey % 2 = 0 AND (100 * (1 + h * 20 / 100) - 100) / 100 * 100 > 10 THEN 'alloc_regression' WHEN o_custkey % 3 > 0 AND (10 * (1 + g * 30 / 100) - 10) / 10 * 100 > 10 THEN 'binary_regression' WHEN (1 + h - 1) / 1 * 100 > 20 THEN 'compile_regression' END AS resources,
          CASE WHEN g <= 0.05 THEN 'below_floor' WHEN o_orderkey % 3 > 0 AND NOT (h - 0.3 > 0 OR h - 0.2 < 0) THEN 'ci_includes_zero'
               WHEN o_orderkey % 3 > 0 AND NOT (h - 0.3 > 0.01 OR h - 0.2 < -0.01) THEN 'ci_inside_noise_threshold'
               WHEN o_orderkey % 3 > 0 AND CASE WHEN h - 0.3 > 0.01 THEN 1 ELSE -1 END * (o_custkey % 2 * 2 - 1) < 0 THEN 'instrument_disagreement' END AS restated,
          CASE WHEN o_orderkey % 5 = 0 THEN 'unsafe_not_at_ffi' WHEN o_orderkey % 7 = 0 THEN 'missing_safety_comment' WHEN o_custkey % 4 > greatest(ceil(g * 100 / 100 * 5), CASE WHEN g > 0 THEN 1 ELSE 0 END) THEN 'unsafe_over_budget' END AS unsafe
        FROM o""",
)
def prj_gates(spark, d):
    o = table(spark, d, "orders").withColumns({"g": F.expr(_G), "h": F.expr(_H)})
    g, h, key = F.col("g"), F.col("h"), F.col("o_orderkey")
    base = {"rss": F.lit(1000.0), "alloc": F.when(key % 2 == 0, F.lit(100.0)), "binary": F.expr("CASE WHEN o_custkey % 3 > 0 THEN 10.0D ELSE 0.0D END"), "compile": F.lit(1.0)}
    got = {"rss": 1000 * (1 + g * 10 / 100), "alloc": 100 * (1 + h * 20 / 100), "binary": 10 * (1 + g * 30 / 100), "compile": 1 + h}
    sites = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda i: F.struct(i.alias("i"), ((key % 5 != 0) | (i != 2)).alias("ffi"), ((key % 7 != 0) | (i != 3)).alias("commented")),
    )
    bad = (key % 5 == 0) | (key % 7 == 0)
    few = F.when(bad, sites).otherwise(F.slice(sites, F.lit(1), F.col("o_custkey").cast("int") % 4))
    interval = [F.when(key % 3 > 0, x) for x in (h - 0.3, h - 0.2)]
    return o.select(
        "o_orderkey",
        G.heldout_divergence(g, h, F.lit(0.25))["passed"].alias("heldout"),
        G.workload_divergence(g, h - 0.5)["passed"].alias("workload"),
        G.causal_attribution(g, h, F.lit(0.05))["passed"].alias("causal"),
        G.no_regression(base, got, key % 17 != 0, key % 19 != 0)["reason"].alias("resources"),
        G.benchmark_restated(g, F.lit(0.05), *interval, F.expr("o_custkey % 2 * 2 - 1"))["reason"].alias("restated"),
        G.unsafe_budget(few, g * 100, F.lit(5))["reason"].alias("unsafe"),
    )


@query("prj_worker_safe", "SELECT p_partkey, p_partkey % 3 = 0 AS safe FROM part")
def prj_worker_safe(spark, d):
    detail = F.expr("""CASE WHEN p_partkey % 3 = 0 THEN '{"reason":"rejected","gate":"workload_divergence"}' ELSE concat('{"gain":', p_retailprice, '}') END""")
    return table(spark, d, "part").select("p_partkey", G.is_worker_safe(detail).alias("safe"))


@query(
    "prj_grade_text",
    """SELECT o_orderkey, CAST(o_custkey % 90 AS BIGINT) AS passed, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END AS failed, CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 0 END AS skipped,
       CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS xfailed, CASE WHEN o_orderkey % 7 = 0 THEN 427 ELSE 0 END AS deselected FROM orders""",
)
def prj_grade_text(spark, d):
    text = F.expr(
        """concat('collected 62910 items', CASE WHEN o_orderkey % 7 = 0 THEN ' / 427 deselected / 62483 selected' ELSE '' END, '\\ntest_a.py::test_passed ok\\n=== ',
        CASE WHEN o_orderkey % 3 = 0 THEN '7 failed, ' ELSE '' END, o_custkey % 90, ' passed', CASE WHEN o_orderkey % 2 = 0 THEN ', 12 skipped' ELSE '' END,
        CASE WHEN o_orderkey % 5 = 0 THEN ', 1 xfailed' ELSE '' END, ' in 3.21s ===')"""
    )
    return table(spark, d, "orders").select("o_orderkey", G.summary_counts(text).alias("c")).select("o_orderkey", "c.*")


@query(
    "prj_observe",
    """SELECT o_orderkey, 'N' || '|' || CAST(o_custkey AS STRING) || '|-' || CAST(o_orderkey AS STRING) || '.5e-3|1|.25|5|7' AS found FROM orders""",
)
def prj_observe(spark, d):
    line = F.expr("concat('norm: ', o_custkey, ' rel=-', o_orderkey, '.5e-3 test-1 x .25 e5 =+7')")
    found = G.scan_numbers(line)
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", F.lit("N"), F.transform(found, lambda x: F.ltrim(x, F.lit("+")))).alias("found"))


@query(
    "prj_classify_func",
    """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN 'regex' WHEN 1 THEN 'io_wait' WHEN 2 THEN 'native' WHEN 3 THEN 'pure_python' WHEN 4 THEN 'native' WHEN 5 THEN 'regex' WHEN 6 THEN 'regex'
       WHEN 7 THEN 'io_wait' WHEN 8 THEN 'io_wait' WHEN 9 THEN 'overhead' WHEN 10 THEN 'overhead' ELSE 'pure_python' END AS bucket FROM part""",
)
def prj_classify_func(spark, d):
    file = F.expr(
        """CASE p_partkey % 12 WHEN 4 THEN concat('/site/Pkg', p_brand, '/MD.py') WHEN 5 THEN '/lib/re.py' WHEN 6 THEN '/lib/sre_parse.py' WHEN 7 THEN 'io.py' WHEN 8 THEN '/lib/asyncio_x.py'
        WHEN 9 THEN '<frozen abc>' WHEN 10 THEN '/lib/typing.py' WHEN 11 THEN concat('/src/', lower(p_brand), '.py') ELSE '~' END"""
    )
    func = F.expr("""CASE p_partkey % 12 WHEN 0 THEN "<method 'match' of 're.Pattern' objects>" WHEN 1 THEN '<built-in SLEEP>' WHEN 2 THEN "<method 'split' of 'str' objects>" ELSE '<built-in len>' END""")
    return table(spark, d, "part").select("p_partkey", G.classify_function(file, func, F.array(F.lit("md.py"))).alias("bucket"))


@query(
    "prj_filters",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 4 = 1 THEN 'upstream' WHEN p_size % 3 = 0 THEN 'mirror' WHEN p_size % 3 = 1 THEN 'native' ELSE 'upstream' END AS path FROM part""",
)
def prj_filters(spark, d):
    path = F.expr("CASE p_size % 3 WHEN 0 THEN 'mirror' WHEN 1 THEN 'native' ELSE 'upstream' END")
    found = F.expr("CASE p_partkey % 4 WHEN 0 THEN array() WHEN 1 THEN array('upstream_only', 'exclude') WHEN 2 THEN array('exclude', 'upstream_only') ELSE array('demote') END")
    return table(spark, d, "part").select("p_partkey", G.first_filter(path, found).alias("path"))


@query(
    "prj_validate_names",
    """SELECT p_partkey, lower('a-' || p_brand) AS name, p_partkey % 3 <> 0 AS version, p_partkey % 2 = 0 AS repo,
       CASE WHEN p_partkey % 5 > 0 THEN 3 END AS major, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS minor FROM part""",
)
def prj_validate_names(spark, d):
    name = F.expr("concat('._A.-_', p_brand, '-')")
    version = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_size, '.1') WHEN 1 THEN concat(p_size, '.0.3') ELSE concat('1.', p_size, '.7-rc.1+x y') END")
    repo = F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('o-w.n_er/', lower(replace(p_brand, '#', '_'))) ELSE concat('a/b/', p_brand) END")
    floor = G.requires_floor(F.expr("CASE WHEN p_partkey % 5 = 0 THEN '<4' ELSE concat('>=3.', p_size, ',<4.0') END"))
    return table(spark, d, "part").select(
        "p_partkey", G.normal_name(name).alias("name"), G.is_version(version).alias("version"), G.is_repo(repo).alias("repo"),
        floor["major"].cast("int").alias("major"), floor["minor"].cast("int").alias("minor"),
    )


@query("agg_divfail", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1 AND l_returnflag = 'R') > 0)")
def agg_divfail(spark, d):
    """Records with a held-out gate that failed."""
    failed = (F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(failed).alias("f")).agg(F.count_if("f").alias("n"))


@query(
    "srt_rank_sugg",
    "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice / (p_size % 7 + 1) DESC, p_partkey) AS pos FROM part",
)
def srt_rank_sugg(spark, d):
    """Suggestions by gain for a unit of review burden."""
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / (F.col("p_size") % 7 + 1)).alias("worth"))
    return row_numbers(rows, [], [F.col("worth").desc(), F.col("p_partkey")], "pos").select("p_partkey", "pos")


@query(
    "jn_range_round",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS round FROM lineitem)
       SELECT r.l_orderkey, r.round, round(exp(sum(ln(1 + o.l_discount))) - 1, 8) AS gain FROM r JOIN lineitem o ON o.l_orderkey = r.l_orderkey AND o.l_linenumber <= r.round GROUP BY 1, 2""",
)
def jn_range_round(spark, d):
    """Gain of all optimisations up to a round: the range join in its window form, summed by round before it runs."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("round")).agg(F.sum(F.ln(1 + F.col("l_discount"))).alias("s"))
    upto = F.sum("s").over(Window.partitionBy("l_orderkey").orderBy("round"))  # an order's few rounds
    return per.select("l_orderkey", "round", F.round(F.exp(upto) - 1, 8).alias("gain"))


_VERSION = """concat(p_size DIV 10, '.', p_size % 10, '.', p_partkey % 7,
    CASE p_partkey % 6 WHEN 1 THEN '.DEV01' WHEN 2 THEN '-Alpha.1' WHEN 3 THEN '-rc.1' WHEN 4 THEN '-2' WHEN 5 THEN '+Ubuntu_007' ELSE '' END)"""


@query(
    "ver_display",
    """SELECT p_partkey, (p_size // 10) || CASE WHEN p_size % 10 + p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN '.' || p_size % 10 ELSE '.' || p_size % 10 || '.' || p_partkey % 7 END ||
       CASE p_partkey % 6 WHEN 1 THEN '.dev1' WHEN 2 THEN 'a1' WHEN 3 THEN 'rc1' WHEN 4 THEN '.post2' WHEN 5 THEN '+ubuntu.7' ELSE '' END AS version FROM part""",
)
def ver_display(spark, d):
    return table(spark, d, "part").select("p_partkey", versions.canonical(F.expr(_VERSION)).alias("version"))


@query("ver_prerelease", "SELECT p_partkey, p_partkey % 6 IN (1, 2, 3) AS pre FROM part")
def ver_prerelease(spark, d):
    return table(spark, d, "part").select("p_partkey", versions.is_prerelease(F.expr(_VERSION)).alias("pre"))


@query(
    "mx_logic",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE CAST(x AS DOUBLE) END) AS a FROM embeddings),
       b AS (SELECT vec_id, a, list_reverse(a) AS z FROM e)
       SELECT vec_id, CAST(list_sum(list_transform(a, lambda x, i: CASE WHEN x <> 0 AND z[i] <> 0 THEN 1 ELSE 0 END)) AS BIGINT) AS both,
              CAST(list_sum(list_transform(a, lambda x, i: CASE WHEN x <> 0 OR z[i] <> 0 THEN 1 ELSE 0 END)) AS BIGINT) AS either, CASE WHEN a[1] = 0 THEN 64 ELSE 0 END AS negated FROM b""",
)
def mx_logic(spark, d):
    x = F.transform("embedding", lambda v: F.when(F.abs(v) < 0.1, F.lit(0.0)).otherwise(v.cast("double")))
    a, z = matrix.matrix(8, 8, x), matrix.matrix(8, 8, F.reverse(x))
    total = lambda m: F.aggregate(m["data"], F.lit(0.0), lambda s, v: s + v).cast("long")
    return table(spark, d, "embeddings").select(
        "vec_id", total(matrix.logical_and(a, z)).alias("both"), total(matrix.logical_or(a, z)).alias("either"),
        total(matrix.logical_not(a)).cast("int").alias("negated"),
    )


@query(
    "chs_bom",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'utf_8' WHEN 1 THEN 'utf_16' WHEN 2 THEN 'utf_16' WHEN 3 THEN 'utf_32' ELSE NULL END AS mark,
       CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 0 END AS size FROM events""",
)
def chs_bom(spark, d):
    from tidewell.functions.charset import byte_order_mark

    raw = F.concat(
        F.unhex(F.expr("CASE event_id % 6 WHEN 0 THEN 'EFBBBF' WHEN 1 THEN 'FFFE' WHEN 2 THEN 'FEFF' WHEN 3 THEN 'FFFE0000' WHEN 4 THEN 'EFBB' ELSE '' END")),
        F.col("event_type").cast("binary"),
    )
    mark = byte_order_mark(raw)
    return table(spark, d, "events").select("event_id", mark["name"].alias("mark"), mark["size"].alias("size"))


@query("tok_scan", "SELECT p_partkey, regexp_extract(p_brand, '^[BandrO]+', 0) AS run, regexp_extract(p_brand, '^[^#]*', 0) AS until FROM part")
def tok_scan(spark, d):
    from tidewell.functions.charset import scan_run

    return table(spark, d, "part").select(
        "p_partkey", scan_run(F.col("p_brand"), "BandrO").alias("run"), scan_run(F.col("p_brand"), "#", inside=False).alias("until")
    )


@query(
    "snk_append",
    """WITH old AS (SELECT o_orderkey AS version, o_orderpriority AS text FROM orders WHERE o_orderkey % 3 <> 0),
       new AS (SELECT o_orderkey AS version, min(o_orderstatus) AS text FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
       SELECT * FROM old UNION ALL SELECT * FROM new WHERE version NOT IN (SELECT version FROM old)""",
)
def snk_append(spark, d):
    """Revisions appended to a log whose version is unique: those that it has already are left out."""
    orders = table(spark, d, "orders")
    old = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("text"))
    new = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("text"))
    return old.unionByName(new.join(old, "version", "left_anti"))
