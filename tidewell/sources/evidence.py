"""Evidence documents: verification, scope, gate verdicts, benchmarks, scoped grades, probes and manifests.

Each shape is a column function of the JSON text, so that a table of documents is read
in one projection; read_documents() makes such a table of files. What is absent or of
another type takes the shape's default, and a text that is not JSON gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Refusals that are quoted, and how many characters of each (fixed values).
REASONS, REASON_CHARS = 3, 120


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file, whole; of a folder those that end in .json."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json*").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _passed(text: Column) -> Column:
    return F.from_json(text, "struct<passed:boolean>")["passed"]


def verification(text: Column) -> Column:
    """struct(passed, stages by name); an array of install checks gives a stage for each."""
    members = F.map_entries(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: k != "passed"))

    def stages(e: Column) -> Column:
        checks = F.when((e["key"] == "python_install_smoke") & F.startswith(e["value"], F.lit("[")), F.from_json(e["value"], "array<string>"))
        many = F.transform(
            checks,
            lambda c, i: F.struct(
                F.concat(e["key"], F.lit("["), i.cast("string"), F.lit("]")).alias("name"), F.coalesce(_passed(c), F.lit(False)).alias("passed")
            ),
        )
        one = F.array(F.struct(e["key"].alias("name"), _passed(e["value"]).alias("passed")))
        return F.coalesce(many, F.filter(one, lambda s: s["passed"].isNotNull()))

    return F.when(
        members.isNotNull(),
        F.struct(F.coalesce(_passed(text), F.lit(False)).alias("passed"), F.array_sort(F.flatten(F.transform(members, stages))).alias("stages")),
    )


def scope_units(text: Column) -> Column:
    """array of struct(id, verdict, evidence) of a scope document; units without an id are left out."""
    units = F.from_json(text, "struct<units:array<struct<id:string,verdict:string,evidence:string>>>")["units"]
    return F.transform(
        F.filter(units, lambda u: u["id"].isNotNull()),
        lambda u: F.struct(
            u["id"].alias("id"), F.coalesce(u["verdict"], F.lit("unknown")).alias("verdict"), F.coalesce(u["evidence"], F.lit("")).alias("evidence")
        ),
    )


def gate_verdict(line: Column) -> Column:
    """struct(id, verdict, evidence) of a line: a word, or a list of refusals, of which the first few are quoted."""
    of = F.from_json(line, "struct<unit:string,verdict:string>")
    refused = F.from_json(of["verdict"], "struct<refuse:array<string>>")["refuse"]
    quoted = F.transform(F.slice(refused, 1, REASONS), lambda r: F.concat(F.lit("; "), F.substring(r, 1, REASON_CHARS)))
    evidence = F.concat(F.lit("refuse["), F.size(refused).cast("string"), F.lit("]"), F.array_join(quoted, ""))
    shaped = ~F.rlike(of["verdict"], F.lit(r"^[\[{]"))
    return F.when(
        of["unit"].isNotNull(),
        F.struct(
            of["unit"].alias("id"),
            F.when(refused.isNotNull(), "refuse").when(shaped, of["verdict"]).otherwise("unknown").alias("verdict"),
            F.when(refused.isNotNull(), evidence)
            .when(shaped, "")
            .otherwise(F.concat(F.lit("unshaped verdict: "), F.coalesce(of["verdict"], F.lit(""))))
            .alias("evidence"),
        ),
    )


def bench_tracks(text: Column) -> Column:
    """array of struct(track, pure_wall_s, rust_wall_s, speedup, checksums_match); a number that is absent is NaN."""
    rows = F.from_json(
        text,
        "array<struct<track:string,pure_wall_s:double,rust_wall_s:double,speedup:double,checksum:string,checksum_rust:string,"
        "pure_checksum:string,rust_checksum:string>>",
    )

    def match(r: Column) -> Column:
        return (
            F.when(r["checksum"].isNotNull(), r["checksum_rust"].isNull() | (r["checksum"] == r["checksum_rust"]))
            .when(r["pure_checksum"].isNotNull() & r["rust_checksum"].isNotNull(), r["pure_checksum"] == r["rust_checksum"])
            .otherwise(True)
        )

    nan = F.lit(float("nan"))
    return F.transform(
        F.filter(rows, lambda r: r["track"].isNotNull()),
        lambda r: F.struct(
            r["track"].alias("track"), *[F.coalesce(r[k], nan).alias(k) for k in ("pure_wall_s", "rust_wall_s", "speedup")], match(r).alias("checksums_match")
        ),
    )


def scoped_grade(text: Column) -> Column:
    """struct(integrity_passed, integrity_tests, parity_passed, parity_failed, failed_tests)."""
    of = F.from_json(
        text,
        "struct<integrity:struct<passed:boolean,detail:struct<test_count:bigint>>,parity:struct<passed:boolean,detail:struct<failed:bigint>>,"
        "failed_tests:array<string>>",
    )
    return F.when(
        of.isNotNull(),
        F.struct(
            F.coalesce(of["integrity"]["passed"], F.lit(False)).alias("integrity_passed"),
            F.coalesce(of["integrity"]["detail"]["test_count"], F.lit(0)).alias("integrity_tests"),
            F.coalesce(of["parity"]["passed"], F.lit(False)).alias("parity_passed"),
            F.coalesce(of["parity"]["detail"]["failed"], F.lit(0)).alias("parity_failed"),
            F.coalesce(of["failed_tests"], F.array().cast("array<string>")).alias("failed_tests"),
        ),
    )


PROBE = (
    "package string, version string, workload struct<name:string,source:string,iters:int,detail:string>, tool string, machine string, "
    "python string, wall_secs double, tottime_secs double, fractions struct<pure_python:double,native:double,io_wait:double,regex:double,"
    "overhead:double>, concentration struct<top1:double,top5:double,hot_modules:int>, "
    "top array<struct<file:string,func:string,tottime_ms:double,ncalls:bigint>>, score double, verdict string"
)


def probe_rows(documents: DataFrame) -> DataFrame:
    """The probe rows of documents (text): of each an object or an array of them."""
    kind = f"array<struct<{PROBE.replace(' string', ':string').replace(' struct', ':struct').replace(' double', ':double').replace(' array', ':array')}>>"
    listed = F.when(F.startswith(F.ltrim("text"), F.lit("[")), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    return documents.select(F.explode(F.from_json(listed, kind)).alias("r")).select("r.*")


def scope_verdict(spec: Column) -> Column:
    """The verdict of a spec, where it is a text."""
    return F.when(F.get_json_object(spec, "$.scope_verdict").isNotNull(), F.try_variant_get(F.try_parse_json(spec), "$.scope_verdict", "string"))


def manifest(text: Column) -> Column:
    """struct(version, runner, languages, files, test_count) of a manifest; one of version 1 names a single language and command."""
    shape = "version:int,runner:string,files:array<struct<path:string,sha256:string>>,baseline:struct<test_count:bigint>"
    new = F.from_json(text, f"struct<{shape},languages:array<string>>")
    old = F.from_json(text, f"struct<{shape},language:string>")
    languages = F.coalesce(new["languages"], F.when(old["language"].isNotNull(), F.array(old["language"])), F.array().cast("array<string>"))
    return F.when(
        new["files"].isNotNull() & new["baseline"].isNotNull(),
        F.struct(
            F.lit(2).alias("version"), new["runner"].alias("runner"), languages.alias("languages"), new["files"].alias("files"),
            new["baseline"]["test_count"].alias("test_count"),
        ),
    )
