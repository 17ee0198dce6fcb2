"""Record pipeline: validation, licenses, routing, bound to orders and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources.tables import table


def reject_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that a record breaks; NULL for a valid one."""
    out = F.when(rules[0][0], rules[0][1])
    for broken, why in rules[1:]:
        out = out.when(broken, why)
    return out


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


@query(
    "flt_validate",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'schema_version' WHEN o_orderkey % 2 = 0 AND o_orderkey % 31 = 0 THEN 'commit'
         WHEN o_orderkey % 2 = 1 AND o_orderstatus <> 'F' AND o_custkey % 23 = 0 THEN 'patch' WHEN o_custkey % 41 = 0 THEN 'oracle'
         WHEN o_orderkey % 59 = 0 THEN 'non-finite gain' WHEN o_orderpriority = '5-LOW' AND o_custkey % 2 = 0 THEN 'license' END AS reason FROM orders) GROUP BY 1""",
)
def flt_validate(spark, d):
    o = table(spark, d, "orders").withColumn("gain", F.expr("CASE WHEN o_orderkey % 59 = 0 THEN double('NaN') ELSE o_totalprice END"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    why = reject_reason(
        [
            (k % 97 == 0, "schema_version"),
            ((k % 2 == 0) & (k % 31 == 0), "commit"),
            ((k % 2 == 1) & (F.col("o_orderstatus") != "F") & (c % 23 == 0), "patch"),
            (c % 41 == 0, "oracle"),
            (~finite(F.col("gain")), "non-finite gain"),
            ((F.col("o_orderpriority") == "5-LOW") & (c % 2 == 0), "license"),
        ]
    )
    return o.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def epoch_of_day(text: Column) -> Column:
    """UTC seconds of YYYY-MM-DD; day 31 of a shorter month rolls over; NULL out of 1970 to 2100, 1 to 12, 1 to 31."""
    parts = F.split(text, "-")
    y, m, day = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    good = (F.size(parts) == 3) & y.between(1970, 2100) & m.between(1, 12) & day.between(1, 31)
    first = F.make_date(F.when(good, y), F.when(good, m), F.lit(1))
    return (F.datediff(F.date_add(first, day - 1), F.lit("1970-01-01").cast("date")) * F.lit(86400).cast("long")).cast("long")


@query(
    "flt_since",
    """SELECT p_partkey, CASE WHEN m BETWEEN 1 AND 12 AND a BETWEEN 1 AND 31 THEN date_diff('day', DATE '1970-01-01', make_date(y, greatest(least(m, 12), 1), 1)) * 86400 + (a - 1) * 86400 END AS since
       FROM (SELECT p_partkey, CAST(1990 + p_size AS INT) AS y, CAST(p_partkey % 14 AS INT) AS m, CAST(p_partkey % 33 AS INT) AS a FROM part)""",
)
def flt_since(spark, d):
    text = F.format_string("%04d-%02d-%02d", 1990 + F.col("p_size"), F.col("p_partkey") % 14, F.col("p_partkey") % 33)
    return table(spark, d, "part").select("p_partkey", epoch_of_day(text).alias("since"))


@query("flt_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def flt_status(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


def language_of(prefix: Column, lang: Column) -> Column:
    """A known prefix, else the language with its aliases; an unknown one as it is."""
    known = lambda c: F.when(c.isin("python", "fortran", "c"), c).when(c.isin("cxx", "c++"), "cxx")
    return F.coalesce(known(prefix), known(F.lower(lang)), lang)


@query(
    "prj_language",
    """SELECT p_partkey, CASE WHEN pre IN ('python', 'c') THEN pre WHEN pre = 'c++' THEN 'cxx' WHEN lower(l) IN ('c++') THEN 'cxx' WHEN lower(l) IN ('fortran') THEN 'fortran' ELSE l END AS language
       FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'c++' WHEN 2 THEN 'zig' END AS pre, CASE p_size % 3 WHEN 0 THEN 'C++' WHEN 1 THEN 'Fortran' ELSE 'Zig' END AS l FROM part)""",
)
def prj_language(spark, d):
    pre = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'c++' WHEN 2 THEN 'zig' END")
    lang = F.expr("CASE p_size % 3 WHEN 0 THEN 'C++' WHEN 1 THEN 'Fortran' ELSE 'Zig' END")
    return table(spark, d, "part").select("p_partkey", language_of(pre, lang).alias("language"))


@query(
    "prj_package",
    r"""SELECT page_id, regexp_replace(regexp_extract(split_part(url, '#', 1) || CASE WHEN page_id % 2 = 0 THEN '.git.git' ELSE '' END, '([^/]*)$', 1), '(\.git)+$', '') AS package,
        CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) ELSE '' END AS pin FROM pages""",
)
def prj_package(spark, d):
    parts = F.split("url", "#", 2)
    repo = F.concat(parts[0], F.expr("CASE WHEN page_id % 2 = 0 THEN '.git.git' ELSE '' END"))
    name = F.regexp_replace(F.element_at(F.split(repo, "/"), -1), r"(\.git)+$", "")
    return table(spark, d, "pages").select(
        "page_id", name.alias("package"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("pin")
    )


def record_license(lane: Column, release: Column, upstream: Column) -> Column:
    """An explicit license, else a GPL upstream's own, else MIT."""
    return F.coalesce(lane, release, F.when(F.contains(F.upper(upstream), F.lit("GPL")), upstream), F.lit("MIT"))


@query(
    "prj_license",
    """SELECT license, upper(license) LIKE '%GPL%' AS gpl, count(*) AS n FROM (SELECT coalesce(CASE WHEN doc_id % 17 = 0 THEN 'BSD' END, CASE WHEN doc_id % 19 = 0 THEN 'Apache-2.0' END,
         CASE WHEN contains(text, 'General Public License') THEN 'gpl-3.0' END, 'MIT') AS license FROM documents) GROUP BY 1, 2""",
)
def prj_license(spark, d):
    lane, release = F.expr("CASE WHEN doc_id % 17 = 0 THEN 'BSD' END"), F.expr("CASE WHEN doc_id % 19 = 0 THEN 'Apache-2.0' END")
    upstream = F.when(F.contains("text", F.lit("General Public License")), "gpl-3.0").otherwise("")
    rows = table(spark, d, "documents").select(record_license(lane, release, upstream).alias("license"))
    gpl = F.contains(F.upper("license"), F.lit("GPL"))
    return rows.groupBy("license", gpl.alias("gpl")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj_outcome",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND bool_and(l_quantity < 48) THEN 'merged' WHEN o_orderstatus IN ('O', 'F') THEN 'gate_failed' ELSE lower(o_orderstatus) END AS outcome
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""",
)
def prj_outcome(spark, d):
    gates = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.every(F.col("l_quantity") < 48).alias("passed"))
    j = table(spark, d, "orders").join(gates, F.col("o_orderkey") == F.col("l_orderkey"))
    status = F.col("o_orderstatus")
    outcome = F.when((status == "O") & F.col("passed"), "merged").when(status.isin("O", "F"), "gate_failed").otherwise(F.lower(status))
    return j.select("o_orderkey", outcome.alias("outcome"))


def files_of_patch(patch: Column) -> Column:
    """Distinct paths after +++ b/ and --- a/, in order."""
    lines = F.filter(F.split(patch, "\n"), lambda x: F.startswith(x, F.lit("+++ b/")) | F.startswith(x, F.lit("--- a/")))
    return F.array_distinct(F.transform(lines, lambda x: F.substring(x, 7, 1 << 20)))


@query(
    "prj_files",
    r"""SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand || '/x.py', p_type || '/y.c'])), ',') AS files,
       CASE WHEN p_size % 5 = 0 THEN greatest(p_size % 4, 1) ELSE 2 + p_size % 4 END AS burden FROM part""",
)
def prj_files(spark, d):
    said = F.when(F.col("p_size") % 5 == 0, F.lit(" ")).otherwise(F.lit("+"))
    patch = F.concat(
        F.lit("--- a/"), "p_brand", F.lit("/x.py\n+++ b/"), "p_brand", F.lit("/x.py\n"), said, F.lit("one\n-two\n--- a/"), "p_type",
        F.lit("/y.c\n+++ /dev/null\n"), said, F.lit("more\n"), F.repeat(F.lit("+x\n"), F.col("p_size") % 4),
    )
    files = F.array_sort(files_of_patch(patch))
    added = F.filter(F.split(patch, "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    return table(spark, d, "part").select("p_partkey", F.array_join(files, ",").alias("files"), F.greatest(F.size(added), F.lit(1)).alias("burden"))


@query(
    "prj_harvest",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'module_local' WHEN contains(lower(o_orderpriority), 'low') OR contains(lower(o_orderpriority), 'high') AND o_orderstatus = 'F' THEN 'language_independent'
         WHEN o_orderstatus = 'F' AND o_custkey % 10 >= 6 THEN 'module_local' ELSE 'port_only' END AS class FROM orders""",
)
def prj_harvest(spark, d):
    tech, bound, tier = F.lower("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey") % 10
    kind = (
        F.when(F.col("o_orderkey") % 13 == 0, "module_local")
        .when(F.contains(tech, F.lit("low")) | (F.contains(tech, F.lit("high")) & (bound == "F")), "language_independent")
        .when((bound == "F") & (tier >= 6), "module_local")
        .otherwise("port_only")
    )
    return table(spark, d, "orders").select("o_orderkey", kind.alias("class"))
