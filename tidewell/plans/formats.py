"""Dates, headers, forms, tabs and matrix functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import dates, matrix, texts
from tidewell.registry import query
from tidewell.sources.tables import table


@query(
    "dt_easter_methods",
    """WITH y AS (SELECT DISTINCT o_custkey % 1200 + 1583 AS y FROM orders),
       j AS (SELECT y, (19 * (y % 19) + 15) % 30 AS d FROM y), k AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) - d + 34) % 7 AS e FROM j),
       o AS (SELECT y, make_date(y, (d + e + 114) // 31, (d + e + 114) % 31 + 1) AS julian FROM k),
       g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g),
       l AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM h), m AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM l)
       SELECT o.y, julian, julian + CAST(o.y // 100 - o.y // 400 - 2 AS INT) AS orthodox, make_date(m.y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS western
       FROM o JOIN m ON o.y = m.y""",
)
def dt_easter_methods(spark, d):
    y = table(spark, d, "orders").select((F.col("o_custkey") % 1200 + 1583).alias("y")).distinct()
    named = (("julian", dates.JULIAN), ("orthodox", dates.ORTHODOX), ("western", dates.WESTERN))
    return y.select("y", *[dates.easter(F.col("y"), m).alias(n) for n, m in named])


@query(
    "hdr_pairs",
    r"""SELECT page_id, 'Form-Data' AS type, 'name=' || url || '|file=a;"b' || page_id || '|x=|flag=|filename=f' || page_id || '.txt' AS options FROM pages""",
)
def hdr_pairs(spark, d):
    h = F.concat(
        F.lit(' Form-Data ; NAME = "'), "url", F.lit('" ;file="a;\\"b'), "page_id", F.lit('"; x=; name*=utf-8\'\'no; flag; filename="C:\\dir\\f'), "page_id", F.lit('.txt"')
    )
    o = texts.header_options(h)
    listed = F.array_join(F.transform(o["options"], lambda x: F.concat(x["name"], F.lit("="), x["value"])), "|")
    return table(spark, d, "pages").select("page_id", o["type"].alias("type"), listed.alias("options"))


@query(
    "frm_pairs",
    """SELECT page_id, '2:a=' || page_id || '|a=b=c|k=|flag=NULL|z=' || page_id % 7 AS pairs FROM pages""",
)
def frm_pairs(spark, d):
    text = F.concat(F.lit("a="), "page_id", F.lit("&&a=b=c;k=;flag&z="), F.col("page_id") % 7, F.lit("&"))
    pairs = texts.query_pairs(text)
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit("NULL")))), "|")
    repeated = F.size(F.filter(pairs, lambda p: p["name"] == "a"))
    return table(spark, d, "pages").select("page_id", F.concat(repeated, F.lit(":"), listed).alias("pairs"))


@query(
    "tok_tabs",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n]'), lambda x: x <> '') AS w FROM documents)
        SELECT doc_id, md5(array_to_string(list_transform(list_zip(w, range(1, len(w) + 1)), lambda p: p[1] || CASE WHEN p[2] % 3 = 0 THEN E'\n' ELSE repeat(' ', CAST(8 - length(p[1]) % 8 AS INT)) END), '') ||
          CASE WHEN len(w) % 3 = 0 AND len(w) > 0 THEN '' ELSE E'\n' END) AS digest FROM w""",
)
def tok_tabs(spark, d):
    """Three words a line, a tab after each but the third: blanks up to the next stop of eight."""
    w = F.filter(F.split("text", "[ \n]", -1), lambda x: x != "")
    text = F.array_join(F.transform(w, lambda x, k: F.concat(x, F.when(k % 3 == 2, "\n").otherwise("\t"))), "")
    return table(spark, d, "documents").select("doc_id", F.md5(texts.expand_tabs(text, 8)).alias("digest"))


@query(
    "mx_functions",
    """WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 10, 1)) AS v FROM embeddings)
       SELECT vec_id, array_to_string(list_transform(v, lambda x: CAST(floor(x) AS BIGINT)), ',') AS floors, array_to_string(list_transform(v, lambda x: CAST(ceil(x) AS BIGINT)), ',') AS ceilings,
         round(list_sum(list_transform(v, lambda x: sin(x) + cos(x) + atan(x))), 6) AS waves, round(list_sum(list_transform(v, lambda x: sqrt(abs(x)) + exp(x / 10))), 6) AS roots,
         round(list_sum(list_transform(v, lambda x: log10(abs(x) + 1) + ln(abs(x) + 1))), 6) AS logs, list_min(v) AS least, list_max(v) AS most, v[10] AS middle,
         round(list_sum(list_transform(range(0, 8), lambda k: v[k + 1] * v[8 * k + 1])), 6) AS square FROM m""",
)
def mx_functions(spark, d):
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 10, 1))
    m = table(spark, d, "embeddings").select("vec_id", matrix.matrix(8, 8, v).alias("m"))
    c = F.col("m")
    listed = lambda x: F.array_join(F.transform(x["data"], lambda y: y.cast("long").cast("string")), ",")
    total = lambda *parts: F.round(sum(F.aggregate(p["data"], F.lit(0.0), lambda s, x: s + x) for p in parts), 6)
    of = lambda name, x=c: matrix.apply(x, name)
    one = matrix.matrix(1, 1, F.array(F.lit(1.0)))
    ten = matrix.matrix(1, 1, F.array(F.lit(10.0)))
    shifted = matrix.add(of("abs"), one)
    return m.select(
        "vec_id", listed(of("floor")).alias("floors"), listed(of("ceil")).alias("ceilings"), total(of("sin"), of("cos"), of("atan")).alias("waves"),
        total(of("sqrt", of("abs")), of("exp", matrix.divide(c, ten))).alias("roots"), total(of("log", shifted), of("ln", shifted)).alias("logs"),
        F.array_min(matrix.least(c)["data"]).alias("least"), F.array_max(matrix.most(c)["data"]).alias("most"), matrix.element(c, 1, 1).alias("middle"),
        F.round(matrix.element(matrix.multiply(c, c), 0, 0), 6).alias("square"),
    )
