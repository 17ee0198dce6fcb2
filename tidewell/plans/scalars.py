"""Scalar functions, bound to documents, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import checksums, dates, scrub, similarity, versions
from tidewell.operators.ranking import running_total
from tidewell.registry import query
from tidewell.sources.tables import table

_PAIRS = """pairs AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def _pairs(spark, d):
    """Names of parts with keys next to each other; dealt anew, as many rows may lie in one row group, which one task would read."""
    p = table(spark, d, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return p.select("p_partkey", F.col("p_name").alias("a")).join(
        p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b")), "p_partkey"
    )


_SETS = (
    "list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"
)


@query(
    "sim_lev",
    f"""WITH {_PAIRS} SELECT p_partkey, CAST(levenshtein(a, b) AS BIGINT) AS lev, round(levenshtein(a, b) / greatest(length(a), length(b)), 6) AS norm FROM pairs""",
)
def sim_lev(spark, d):
    return _pairs(spark, d).select(
        "p_partkey",
        F.levenshtein("a", "b").cast("long").alias("lev"),
        F.round(similarity.normalized_levenshtein(F.col("a"), F.col("b")), 6).alias("norm"),
    )


@query(
    "sim_sets",
    f"""WITH {_PAIRS}, s AS (SELECT p_partkey, {_SETS.format(c='a')} AS x, {_SETS.format(c='b')} AS y FROM pairs),
        c AS (SELECT p_partkey, len(x) AS nx, len(y) AS ny, len(list_intersect(x, y)) AS n FROM s)
        SELECT p_partkey, round(n / (nx + ny - n), 6) AS jaccard, round(2 * n / (nx + ny), 6) AS dice, round(n / least(nx, ny), 6) AS ovl FROM c""",
)
def sim_sets(spark, d):
    s = _pairs(spark, d).select(
        "p_partkey", similarity.shingle_set(F.col("a"), 2).alias("x"), similarity.shingle_set(F.col("b"), 2).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    return s.select(
        "p_partkey",
        F.round(similarity.jaccard(x, y), 6).alias("jaccard"),
        F.round(similarity.dice(x, y), 6).alias("dice"),
        F.round(similarity.overlap(x, y), 6).alias("ovl"),
    )


@query(
    "sim_counts",
    f"""WITH {_PAIRS}, g AS (
        SELECT p_partkey, g, sum(x) AS x, sum(y) AS y FROM (
          SELECT p_partkey, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS g, 1 AS x, 0 AS y FROM pairs
          UNION ALL SELECT p_partkey, unnest(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))), 0, 1 FROM pairs) GROUP BY 1, 2)
        SELECT p_partkey, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine, CAST(sum(abs(x - y)) AS BIGINT) AS qgram FROM g GROUP BY 1""",
)
def sim_counts(spark, d):
    s = _pairs(spark, d).select(
        "p_partkey", similarity.shingle_counts(F.col("a"), 2).alias("x"), similarity.shingle_counts(F.col("b"), 2).alias("y")
    )
    return s.select(
        "p_partkey",
        F.round(similarity.cosine(F.col("x"), F.col("y")), 6).alias("cosine"),
        similarity.qgram_distance(F.col("x"), F.col("y")).cast("long").alias("qgram"),
    )


@query("sim_damerau", f"WITH {_PAIRS} SELECT p_partkey, CAST(damerau_levenshtein(a, b) AS BIGINT) AS damerau FROM pairs")
def sim_damerau(spark, d):
    return _pairs(spark, d).select("p_partkey", similarity.damerau(F.col("a"), F.col("b")).alias("damerau"))


@query("sim_lcs")
def sim_lcs(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select(
        "p_partkey", similarity.lcs_length(a, b).alias("lcs"), F.round(similarity.metric_lcs(a, b), 6).alias("metric")
    )


@query("sim_ngram")
def sim_ngram(spark, d):
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("p_partkey", *[F.round(similarity.ngram_distance(n)(a, b), 6).alias(f"ngram_{n}") for n in (2, 3)])


@query("sim_sift4")
def sim_sift4(spark, d):
    a, b = F.col("a"), F.col("b")
    words = similarity.sift4(tokenizer=similarity.words_of)(a, b)
    return _pairs(spark, d).select("p_partkey", similarity.sift4()(a, b).alias("sift4"), similarity.sift4(2)(a, b).alias("near"), words.alias("words"))


@query(
    "sim_wlev",
    f"""WITH {_PAIRS}, v AS (SELECT *, replace(a, 'e', '') AS x, length(a) - length(replace(a, 'e', '')) AS e FROM pairs)
        SELECT p_partkey, CAST(levenshtein(a, b) AS DOUBLE) AS unit, CAST(1.5 * e AS DOUBLE) AS bare, CAST(0.5 * e AS DOUBLE) AS filled FROM v""",
)
def sim_wlev(spark, d):
    """Unit costs give the plain distance; a text without its e's is as far away as its e's cost to take out or put in."""
    costly = similarity.weighted_levenshtein({"e": 0.5}, {"e": 1.5})
    bare = F.replace("a", F.lit("e"), F.lit(""))
    return _pairs(spark, d).select(
        "p_partkey", similarity.weighted_levenshtein()(F.col("a"), F.col("b")).alias("unit"), costly(F.col("a"), bare).alias("bare"), costly(bare, F.col("a")).alias("filled")
    )


def _crc_sql(poly: int, init: int) -> str:
    """A reflected CRC's register over the list of bytes b, bit by bit."""
    bits = f"lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, {poly}) ELSE x // 2 END"
    return f"list_reduce(list_prepend(CAST({init} AS BIGINT), b), lambda r, c: list_reduce(list_prepend(xor(r, c), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), {bits}))"


@query(
    "crc_any",
    f"""WITH h AS (SELECT item_id, hex(encode(coalesce(text, ''))) AS h FROM benchmark),
        t AS (SELECT item_id, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS b FROM h),
        f AS (SELECT item_id, list_reduce(list_prepend(CAST(14695981039346656037 AS UHUGEINT), CAST(b AS UHUGEINT[])),
                lambda r, c: xor(r, c) * 1099511628211 % 18446744073709551616) AS f FROM t)
        SELECT item_id, printf('0x%04X', {_crc_sql(0xA001, 0)}) AS crc_16_arc, printf('0x%08X', xor({_crc_sql(0xEDB88320, 0xFFFFFFFF)}, 4294967295)) AS crc_32,
          CAST(CASE WHEN f >= 9223372036854775808 THEN CAST(f AS HUGEINT) - 18446744073709551616 ELSE CAST(f AS HUGEINT) END AS BIGINT) AS fnv1a
        FROM t JOIN f USING (item_id)""",
)
def crc_any(spark, d):
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    named = [checksums.crc_hex(n)(text).alias(n.lower().replace("-", "_").replace("/", "_")) for n in ("CRC-16/ARC", "CRC-32")]
    return table(spark, d, "benchmark").select("item_id", *named, checksums.fnv1a(text).alias("fnv1a"))


@query("hash_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(
    "prj_record_id",
    "SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, ''), o_orderpriority)), 1, 16) AS record_id FROM orders",
)
def prj_record_id(spark, d):
    status = F.expr("coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, '')")
    joined = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), status, "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(joined, 256), 1, 16).alias("record_id"))


@query(
    "scr_email",
    r"""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '[REDACTED:pii]', 'g') AS text FROM documents WHERE contains(text, '@')""",
)
def scr_email(spark, d):
    rows = table(spark, d, "documents").filter(F.contains("text", F.lit("@")))
    return rows.select("doc_id", scrub.scrub_text(F.col("text"), rules=("email",)).alias("text"))


@query("scr_text")
def scr_text(spark, d):
    s = scrub.scrub(F.col("text")).alias("s")
    return table(spark, d, "documents").select("doc_id", s).select("doc_id", "s.secrets", "s.personal", "s.redacted_chars", F.md5("s.text").alias("digest"))


@query(
    "tok_escape",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM pages""",
)
def tok_escape(spark, d):
    out = F.col("html")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return table(spark, d, "pages").select("page_id", F.md5(out).alias("digest"))


@query(
    "tok_newline",
    r"""SELECT doc_id, md5(regexp_replace(replace(text, E'\n', E'\r\n'), E'\r\n?', E'\n', 'g')) AS digest FROM documents""",
)
def tok_newline(spark, d):
    text = F.regexp_replace(F.replace("text", F.lit("\n"), F.lit("\r\n")), "\r\n?", "\n")
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("digest"))


@query(
    "frm_query",
    r"""SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages""",
)
def frm_query(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"),
        F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")).alias("host"),
    )


@query(
    "dt_civil",
    """SELECT o_orderkey, date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS ordinal, isodow(o_orderdate) - 1 AS weekday,
       day(last_day(o_orderdate)) AS days, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month FROM orders""",
)
def dt_civil(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey",
        (F.datediff(day, F.lit("0001-01-01").cast("date")) + 1).cast("long").alias("ordinal"),
        F.weekday(day).cast("long").alias("weekday"),
        F.dayofmonth(F.last_day(day)).cast("long").alias("days"),
        F.add_months(day, 1).alias("next_month"),
    )


_EASTER = """SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS easter FROM (
  SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (
  SELECT *, (19 * a + b - dd - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k FROM (SELECT *, (b - (b + 8) // 25 + 1) // 3 AS g FROM (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS dd, (y // 100) % 4 AS e FROM years)))))"""


@query(
    "dt_easter",
    f"WITH years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders) {_EASTER}",
)
def dt_easter(spark, d):
    years = table(spark, d, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return years.select("y", dates.easter(F.col("y")).alias("easter"))


@query(
    "dt_rrule",
    """SELECT o_orderkey, CAST(unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 28 DAY, INTERVAL 7 DAY)) AS DATE) AS at FROM orders""",
)
def dt_rrule(spark, d):
    day = F.to_date("o_orderdate")
    weeks = F.sequence(day, F.date_add(day, 28), F.expr("INTERVAL 7 DAYS"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(weeks).alias("at"))


@query(
    "ver_key",
    """WITH v AS (SELECT p_partkey, p_size // 10 AS major, p_size % 10 AS minor, p_partkey % 7 AS patch, p_partkey % 4 AS pre FROM part)
       SELECT p_partkey, CAST(rank() OVER (ORDER BY major, minor, patch, CASE pre WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS BIGINT) AS pos FROM v""",
)
def ver_key(spark, d):
    text = F.expr("""concat(p_size DIV 10, '.', p_size % 10, '.', p_partkey % 7,
        CASE p_partkey % 4 WHEN 1 THEN '.DEV1' WHEN 2 THEN 'a1' WHEN 3 THEN '-rc.1' ELSE '' END)""")
    part = table(spark, d, "part").select("p_partkey", text.alias("version"))
    # each distinct text is parsed once
    counts = part.groupBy("version").agg(F.count(F.lit(1)).alias("n")).withColumn("key", versions.sort_key(F.col("version")))
    keys = counts.groupBy("key").agg(F.sum("n").alias("n"))
    ranked = counts.select("version", "key").join(running_total(keys, [], [F.col("key")], F.col("n"), "before"), "key")
    return part.join(ranked, "version").select("p_partkey", (F.col("before") + 1).alias("pos"))


@query("ver_names", "SELECT p_partkey, lower(regexp_replace(p_name, '[-_. ]+', '-', 'g')) AS name FROM part")
def ver_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[-_. ]+", "-")).alias("name"))


@query(
    "json_path",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
