"""Transcripts and archives made of the driver's tables, and read back."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.registry import query
from tidewell.sources import archives, transcripts
from tidewell.sources.session import scratch
from tidewell.sources.tables import table


@query(
    "src_transcripts",
    """WITH m AS (SELECT 's' || conv_id % 20 AS session_id, CASE WHEN turn % 3 = 0 THEN 'p/' ELSE '' END || 'm' || turn % 4 AS model, turn * 10 AS input, length(text) AS output
         FROM conversations WHERE role = 'assistant' AND conv_id % 20 NOT IN (3, 8)),
       s AS (SELECT session_id, model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM m GROUP BY 1, 2)
       SELECT k.session_id, CASE WHEN max(output) > 0 THEN (list(model ORDER BY output DESC, model))[1] ELSE '' END AS model, CAST(coalesce(sum(input), 0) AS BIGINT) AS input,
         CAST(coalesce(sum(output), 0) AS BIGINT) AS output, CAST(coalesce(sum(input), 0) AS DOUBLE) / 2 AS cost_usd
       FROM (SELECT DISTINCT 's' || conv_id % 20 AS session_id FROM conversations WHERE conv_id % 20 NOT IN (3, 8)) k LEFT JOIN s ON k.session_id = s.session_id GROUP BY 1""",
)
def src_transcripts(spark, d):
    """A folder of twenty sessions at two depths, two of which say too late that they are sessions; each has a line that is cut off."""
    c = table(spark, d, "conversations").withColumn("k", F.col("conv_id") % 20)
    usage = F.struct((F.col("turn") * 10).alias("input"), F.char_length("text").alias("output"), F.struct((F.col("turn") * 5.0).alias("total")).alias("cost"))
    message = F.struct("role", F.when(F.col("turn") % 3 == 0, "p").alias("provider"), F.concat(F.lit("m"), F.col("turn") % 4).alias("model"), usage.alias("usage"))
    said = c.select("k", F.struct(F.lit(3).alias("a"), "conv_id", "turn").alias("at"), F.to_json(F.struct(F.lit("message").alias("type"), message.alias("message"))).alias("value"))
    keys = c.select("k").distinct()
    head = F.when(F.col("k").isin(3, 8), 2).otherwise(0)
    place = lambda a, b: F.struct(a.cast("int").alias("a"), F.lit(0).cast("long").alias("conv_id"), b.cast("long").alias("turn"))
    session = keys.select("k", place(head, F.lit(0)).alias("at"), F.concat(F.lit('{"type": "session", "id": "s'), "k", F.lit('"}')).alias("value"))
    noise = keys.select("k", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")).select("k", place(F.lit(1), F.col("n")).alias("at"), F.lit('{"type": "title", "message": {"ro').alias("value"))
    lines = said.union(session).union(noise).withColumn("depth", (F.col("k") % 2).cast("int")).repartition("k").sortWithinPartitions("depth", "k", "at")
    path = scratch(spark, "transcripts")
    lines.select("depth", F.col("k").alias("file"), "value").write.partitionBy("depth", "file").text(path)
    # Spark names its parts .txt; transcripts end in .jsonl
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(fs_path(f"{path}/*/*/*.txt")):  # twenty files
        old = found.getPath()
        fs.rename(old, fs_path(old.getParent(), old.getName().removesuffix(".txt") + ".jsonl"))
    got = transcripts.read_transcripts(spark, path)
    return got.withColumn("cost_usd", F.round("cost_usd", 2))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content: each row's files as a gzipped tar archive, cut off where the row says so."""
    for batch in batches:
        paths, contents = [], []
        for row in batch.to_pylist():
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w:gz") as archive:
                for name, text in zip(row["names"], row["texts"]):
                    info = tarfile.TarInfo(name)
                    data = (text or "").encode()
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
            data = out.getvalue()
            paths.append(row["path"])
            contents.append(data[: len(data) // 2] if row["cut"] else data)
        yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], ["path", "content"])


@query(
    "src_tarball",
    r"""WITH f AS (
          SELECT doc_id // 50 AS a, doc_id % 7 AS k, text, length(text) - length(replace(text, chr(10), '')) AS lines FROM documents),
        s AS (SELECT 'a' || a || '.tgz' AS archive, a % 7 <> 3 AS ok, CAST(count(*) FILTER (k IN (0, 3)) AS BIGINT) AS py_files, CAST(coalesce(sum(lines) FILTER (k IN (0, 3)), 0) AS BIGINT) AS py_lines,
          CAST(count(*) FILTER (k = 1) AS BIGINT) AS native_files, count(*) FILTER (k = 4) > 0 AS native_build, count(*) FILTER (k = 0) > 0 AS pars, count(*) FILTER (k = 5) > 0 AS marked, count(*) FILTER (k = 6) > 0 AS valid
          FROM f GROUP BY a)
        SELECT archive, CASE WHEN ok THEN py_files END AS py_files, CASE WHEN ok THEN py_lines END AS py_lines, CASE WHEN ok THEN native_files END AS native_files, CASE WHEN ok THEN native_build END AS native_build,
          CASE WHEN ok THEN array_to_string(list_filter([CASE WHEN marked THEN 'html' END, CASE WHEN marked THEN 'mark' END, CASE WHEN pars THEN 'pars' END, CASE WHEN valid THEN 'valid' END], lambda x: x IS NOT NULL), ',') END AS words, 'token,date' AS summary_words
        FROM s""",
)
def src_tarball(spark, d):
    """Archives of up to fifty documents, every seventh cut off, read back by the archive reader's own function."""
    kinds = ("pkg/parser/m{}.py", "pkg/native/f{}.c", "pkg/tests/t{}.py", "pkg/setup{}.py", "pkg/{}/pyproject.toml", "pkg/html/markup{}.txt", "pkg/Valid{}.md")
    name = F.element_at(F.array(*[F.concat(F.lit(k.split("{}")[0]), "doc_id", F.lit(k.split("{}")[1])) for k in kinds]), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 7 == 4, F.concat("text", F.lit(" Requires MATURIN"))).otherwise(F.col("text"))
    files = table(spark, d, "documents").select(F.expr("doc_id DIV 50").alias("a"), F.struct(name.alias("name"), text.alias("text")).alias("f"))
    rows = files.groupBy("a").agg(F.collect_list("f").alias("f")).select(  # fifty at most
        F.concat(F.lit("a"), "a", F.lit(".tgz")).alias("path"), F.col("f.name").alias("names"), F.col("f.text").alias("texts"), (F.col("a") % 7 == 3).alias("cut")
    )
    packed = rows.mapInArrow(_packed, "path string, content binary")
    members = packed.mapInArrow(archives._members, archives._MEMBERS)
    summaries = rows.select(F.col("path").alias("archive"), F.lit("A tokenizer of dates").alias("summary"))
    got = archives.inspect_archives(members, summaries)
    return got.select("archive", "py_files", "py_lines", "native_files", "native_build", *[F.array_join(c, ",").alias(c) for c in ("words", "summary_words")])
