"""Session transcripts: trees of JSON-lines files, and what each session's models used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.ledger import dominant

#: Lines of a file among which the session line must be, and how it is told there (fixed values).
HEAD_LINES = 5
SESSION_MARKS = ('"type":"session"', '"type": "session"')


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (orders a file's lines), value: lines of the *.jsonl files of a folder, at any depth, that are transcripts.

    A file is one if a session line is among its first HEAD_LINES lines. Lines of a file
    may come from several splits: they are ordered by the split's place, then within it.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    # the limit on ranks is applied before the shuffle: of each file and task no more than the head's lines move
    head = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.col("n") <= HEAD_LINES)
    marked = F.lit(False)
    for mark in SESSION_MARKS:
        marked |= F.contains("value", F.lit(mark))
    return lines.join(head.filter(marked).select("file").distinct(), "file", "left_semi")


def _whole(v: Column, path: str) -> Column:
    """An integer at a path; 0 if there is none or it is no integer (a text of digits is none)."""
    text = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.when(F.rlike(text, F.lit(r"^-?\d{1,18}$")), text).cast("long"), F.lit(0).cast("long"))


def _number(v: Column, path: str) -> Column:
    text = F.to_json(F.try_variant_get(v, path, "variant"))
    return F.coalesce(F.when(F.rlike(text, F.lit("^-?[0-9]")), text).cast("double"), F.lit(0.0))


def session_usage(lines: DataFrame) -> DataFrame:
    """session_id, file, model, output, input, cost: sums by transcript and model.

    Lines that are not JSON, and messages that are not an assistant's or have no usage,
    are passed over. The session is the last session line's id, else what follows the last
    underscore of the file's name. A model is named provider/model.
    """
    v = F.try_parse_json("value")
    parsed = lines.select("file", "at", v.alias("v")).filter("v is not null")
    text = lambda path: F.try_variant_get("v", path, "string")
    ids = parsed.filter((text("$.type") == "session") & text("$.id").isNotNull()).groupBy("file").agg(F.max_by(text("$.id"), "at").alias("id"))
    said = parsed.filter((F.coalesce(text("$.type"), F.lit("")) != "session") & (text("$.message.role") == "assistant"))
    said = said.filter(F.try_variant_get("v", "$.message.usage", "variant").isNotNull())
    model = F.coalesce(F.concat(text("$.message.provider"), F.lit("/"), text("$.message.model")), text("$.message.model"), F.lit(""))
    said = said.select(
        "file", model.alias("model"), _whole(F.col("v"), "$.message.usage.output").alias("output"), _whole(F.col("v"), "$.message.usage.input").alias("input"),
        _number(F.col("v"), "$.message.usage.cost.total").alias("cost"),
    ).filter("model <> '' or input + output <> 0")
    sums = said.groupBy("file", "model").agg(*[F.sum(c).alias(c) for c in ("output", "input", "cost")])
    stem = F.regexp_extract("file", r"([^/]*)\.jsonl$", 1)
    names = lines.select("file").distinct().join(ids, "file", "left")
    names = names.select("file", F.coalesce("id", F.element_at(F.split(stem, "_"), -1)).alias("session_id"))
    # of files of one session the last by name counts
    last = names.groupBy("session_id").agg(F.max("file").alias("file"))
    return last.join(sums, "file", "left").select("session_id", "file", "model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("output", "input", "cost")])


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, model (of the most output; of equal ones the first by name; '' if none has any), input, output, cost_usd of each session."""
    usage = session_usage(transcript_lines(spark, path))
    best = dominant(usage.select("session_id", F.coalesce("model", F.lit("")).alias("model"), "output"), "session_id", "model", "output")
    sums = usage.groupBy("session_id").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost_usd"))
    model = F.when(F.col("amount") > 0, F.col("dominant")).otherwise("").alias("model")
    return sums.join(best.select("session_id", model), "session_id").select("session_id", "model", "input", "output", "cost_usd")
