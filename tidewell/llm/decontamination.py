"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Texts are cut to lower-case words. Of every WINDOW words the minimum of the
hashes of its GRAM-word shingles is kept as a fingerprint; two texts that share
WINDOW words share that minimum, so joining fingerprints of documents and items
finds every document that can be hit. Those are extended: their whole windows
are joined with the items' distinct windows by the words themselves; items come in
afterwards, once for each document and window, so that a passage that many items hold
costs no more where it occurs.

An item of fewer than WINDOW words is one window of its own length; for such
lengths documents give the hash of every run of that length besides.

Benchmark fingerprints, windows and candidate documents are broadcast where their
bytes, measured first, are few; beyond that Spark joins them by shuffle.

Arrays are exploded with explode_outer: for explode, Spark would infer a filter on
the array's size and compute the array twice, element by element.

Nulls: a null text has no words; a null doc_id is carried along, and documents
are told apart by id and text, so repeated rows get equal results. An item_id of
null is listed as ''. Repeated items count once by item_id. Empty tables give no
hits or no rows. Further columns are not read; remove_contaminated() returns them,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, small

WINDOW = 13
GRAM = 5
#: A document is contaminated when so many percent of its words are hit.
PERCENT = 5

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _BREAK, -1), "")


def _runs(hashes: str, k: int) -> Column:
    """Hash of each run of k words, from an array column of word hashes."""
    h = F.col(hashes)
    return F.when(
        F.size(h) >= k,
        F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def fingerprints(df: DataFrame, short: list[int] = ()) -> DataFrame:
    """Adds prints: the winnowed fingerprints of the array column words, and the hashes of all runs of the short lengths."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _runs("h", GRAM))
    width = WINDOW - GRAM + 1
    g = F.col("grams")
    prints = F.when(
        F.size(g) >= width,
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(g) - width + 1), lambda i: F.array_min(F.slice(g, i, width)))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    for m in short:
        prints = F.array_union(prints, _runs("h", m))
    return df.withColumn("prints", prints).drop("h", "grams")


def _windows(words: str, length: Column | int) -> Column:
    """(start, window) of each run of so many words, as structs."""
    w = F.col(words)
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(
        F.size(w) >= length,
        F.transform(
            F.sequence(F.lit(1), F.size(w) - length + 1),
            lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice(w, i, length), " ").alias("window")),
        ),
    ).otherwise(F.array().cast("array<struct<start:int,window:string>>"))


def matched_windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest, start, length, w: every occurrence of a window in a document; w, item_id: the items that hold it."""
    keyed = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("digest"), words_of(F.col("text")).alias("words"))
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")
    ).filter(F.size("words") > 0)
    items = materialize(items.withColumn("length", F.least(F.size("words"), F.lit(WINDOW))), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # at most WINDOW values
    short = [m for m in lengths if m < WINDOW]

    item_prints = fingerprints(items.filter(F.col("length") == WINDOW)).select(F.explode_outer("prints").alias("print"))
    for m in short:
        own = items.filter(F.col("length") == m).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
        item_prints = item_prints.unionByName(own.select(F.explode_outer(_runs("h", m)).alias("print")))
    item_prints = materialize(item_prints.dropna().distinct(), "item_prints")
    candidates = (
        fingerprints(keyed, short)
        .select("doc_id", "digest", F.explode_outer("prints").alias("print"))
        .join(small(item_prints), "print", "left_semi")
        .select("doc_id", "digest")
        .distinct()
    )
    candidates = materialize(candidates, "candidates")
    # by the digest, which is of text and id; the id is compared besides, null being equal to null
    c = small(candidates.select(F.col("digest").alias("c_digest"), F.col("doc_id").alias("c_id")))
    texts = keyed.join(c, (F.col("digest") == F.col("c_digest")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi")

    held = items.select("item_id", "length", F.explode_outer(_windows("words", F.col("length"))).alias("w"))
    held = materialize(held.select("item_id", "length", F.col("w.window").alias("window")).distinct(), "held")
    windows = held.select("length", "window").distinct().withColumn("w", F.monotonically_increasing_id())
    windows = materialize(windows, "windows")
    found = None
    for m in lengths:
        of_doc = texts.select("doc_id", "digest", F.explode_outer(_windows("words", m)).alias("w")).select(
            "doc_id", "digest", F.col("w.start").alias("start"), F.col("w.window").alias("window")
        )
        hit = of_doc.join(small(windows.filter(F.col("length") == m)), "window").drop("window")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = candidates.select("doc_id", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("w")).limit(0)
    return materialize(found, "hits"), held.join(small(windows), ["length", "window"]).select("w", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    spans, owners = matched_windows(docs, benchmark)
    # word positions covered: spans in order, each adding what reaches beyond the ones before
    covered = F.aggregate(
        F.array_sort(F.col("spans")),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
        lambda a: a["n"],
    )
    hits = (
        spans.groupBy("doc_id", "digest")
        .agg(
            F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("spans"),
        )
        .select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), covered.cast("long").alias("n_hit"))
    )
    listed = (
        spans.select("doc_id", "digest", "w")
        .distinct()
        .join(small(materialize(owners, "owners")), "w")
        .groupBy(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest"))
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("l_id", "l_digest", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("listed"))
    )
    hits = hits.join(listed, (F.col("h_digest") == F.col("l_digest")) & F.col("h_id").eqNullSafe(F.col("l_id"))).drop("l_id", "l_digest")
    rows = docs.select(
        "doc_id", F.xxhash64("text", "doc_id").alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    )
    return (
        rows.join(hits, (F.col("digest") == F.col("h_digest")) & F.col("doc_id").eqNullSafe(F.col("h_id")), "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
        .select(
            "doc_id",
            "digest",
            "n_words",
            "n_hit",
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.sha2(F.coalesce("listed", F.lit("")).cast("binary"), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= PERCENT * F.col("n_words"))).alias("contaminated"),
        )
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, as they are, without the contaminated ones."""
    gone = decontaminate(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest"))
    gone = materialize(gone.distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text", "doc_id").alias("digest"))
    same = (F.col("digest") == F.col("g_digest")) & F.col("row.doc_id").eqNullSafe(F.col("g_id"))
    return rows.join(small(gone), same, "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items).drop("digest")


_SPLIT = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
SQL = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS p
        FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) l)),
hits AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
