"""Affected tests: parts' names as units, documents as tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import patterns
from tidewell.registry import query
from tidewell.sources.tables import table

#: Syllables that the stems are made of, so that some occur as words, some inside of words and some nowhere.
_STEM = "substr('theandof', p_partkey % 6 + 1, 2 + p_partkey % 3) || CASE p_partkey % 25 WHEN 0 THEN '' ELSE substr(p_name, 1, 2) END"


@query(
    "jn_contains",
    f"""SELECT doc_id AS text_id, p_partkey AS pattern_id FROM documents, (SELECT p_partkey, {_STEM} || ' ' || substr('reinonan', p_partkey % 7 + 1, 2) AS stem FROM part)
        WHERE contains(text, stem)""",
)
def jn_contains(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    stem = F.expr(f"{_STEM} || ' ' || substr('reinonan', p_partkey % 7 + 1, 2)")
    return patterns.containing(texts, table(spark, d, "part").select(F.col("p_partkey").alias("pattern_id"), stem.alias("pattern")))


@query(
    "jn_test_unit",
    f"""WITH tests AS (SELECT doc_id AS test, lower(source) || '/' || lang AS dir, CASE WHEN doc_id % 50 <> 7 THEN lower(text) END AS text FROM documents),
        units AS (SELECT p_partkey AS unit, CASE p_partkey % 40 WHEN 0 THEN 'src' || (p_partkey // 40) % 25 WHEN 1 THEN 'xt' || p_size ELSE '' END AS subsystem, lower({_STEM}) AS stem FROM part)
        SELECT unit, test, CASE WHEN text IS NULL THEN 'unresolved' WHEN subsystem <> '' AND (dir = subsystem OR starts_with(dir, subsystem || '/')) THEN 'colocated'
          WHEN subsystem <> '' AND contains(text, subsystem) THEN 'subsystem' ELSE 'stem' END AS why
        FROM units JOIN tests ON text IS NULL OR subsystem <> '' AND (dir = subsystem OR starts_with(dir, subsystem || '/') OR contains(text, subsystem))
          OR contains(text, stem) AND regexp_matches(text, '(^|[^a-z0-9_])' || stem || '($|[^a-z0-9_])')""",
)
def jn_test_unit(spark, d):
    tests = table(spark, d, "documents").select(
        F.col("doc_id").alias("test"), F.concat_ws("/", "source", "lang").alias("dir"), F.when(F.col("doc_id") % 50 != 7, F.col("text")).alias("text")
    )
    kind = F.expr("CASE p_partkey % 40 WHEN 0 THEN 'SRC' || (p_partkey DIV 40) % 25 WHEN 1 THEN 'xt' || p_size ELSE '' END")
    units = table(spark, d, "part").select(F.col("p_partkey").alias("unit"), kind.alias("subsystem"), F.expr(_STEM).alias("stem"))
    return patterns.affected_tests(tests, units)
