"""Mixing sources to target weights by Pareto order sampling.

The mix has as many words as the input. Sources, in code-point order with null
last, weigh 5, 2, 1, repeating; a source's target is its share by weight, but at
most MAX_COPIES times its size, and what exceeds that is shared anew by weight
until no target is above (water filling: with sources in order of cap / weight,
the capped ones come first).

A source's target is shared by its documents in proportion to WEIGHT_OF_ANY plus the
number of binary digits of their sizes, times the size, so that longer documents are
likelier; again by water filling, as no document is taken over MAX_COPIES times. A
document wanted c times gets floor(c) certain whole copies and is sampled for one
more with inclusion probability p = c - floor(c). With a random number u it ranks by
(u / (1 - u)) / (p / (1 - p)), and in this order documents are taken as long as they
fit in what is left of the target: the sample's size is fixed in words. What remains
before the first that doesn't fit is filled, in the same order, with those beyond
it that do, PASSES times in all; last comes the one, if any, that brings the words
nearest to the target. u comes from the md5 of the id, so reruns agree.

No source is sorted and no text is shuffled. Sizes are written once, in a row of
numbers a draw. The rank where a source's sample ends is found by summing words by
source and rank digit (2^DIGIT bins a source at most), digit after digit, until few
draws are left between; only those are put in order. A last pass over the documents
compares each with its source's ends.

Nulls: a null text has 0 words; a null source is a source of its own; a document of
null id draws u by its text. Documents of 0 words take 0. Rows of one source and rank
(such as repeat an id) are one draw: as long as they fit they are taken together.
Repeated rows count each in sizes and targets. An empty table gives an empty result.
Further columns are not read, unless carried, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, materialize, small

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Weight of a document, to which the number of binary digits of its size is added.
WEIGHT_OF_ANY = 8
PASSES = 2
#: Bits of the rank; bits by which it is searched at a time; draws of a source that are put in order in the end.
RANK_BITS, DIGIT, FEW = 52, 13, 1_000


def source_targets(sized: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row a source, from (source, size) rows.

    The windows below run over the sources, already summed to a row each.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((n - 1) % len(weights) + 1).cast("int"))
    w = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - max_copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        per_source.withColumn("weight", weight)
        .withColumn("level", level)
        .withColumn("capped", F.col("level") * F.col("weight") >= max_copies * F.col("source_size"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), (max_copies * F.col("source_size")).cast("double"))
            .otherwise(F.col("level") * F.col("weight"))
            .alias("target"),
        )
    )


def copies_wanted(sized: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """t_source, t_weight, source_size, target and wanted (copies of a document of that weight): of each source a row for
    each number of digits that sizes in it have."""
    levels = sized.groupBy("source", "weight").agg(F.sum("size").alias("words"))
    levels = levels.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    heavy_first = Window.partitionBy("source").orderBy(F.col("weight").desc())
    whole = heavy_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = heavy_first.rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("weight") * F.col("words")
    lighter = F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(before), F.lit(0))
    left = F.col("target") - max_copies * F.coalesce(F.sum("words").over(before), F.lit(0))
    levels = levels.withColumn("level", F.coalesce(left / F.nullif(lighter, F.lit(0)), F.lit(0.0)))
    levels = levels.withColumn("capped", F.col("level") * F.col("weight") >= max_copies)
    level = F.coalesce(F.max(F.when(~F.col("capped") & (F.col("words") > 0), F.col("level"))).over(whole), F.lit(0.0))
    copies = F.when(F.col("capped"), F.lit(float(max_copies))).otherwise(level * F.col("weight"))
    return levels.select("t_source", F.col("weight").alias("t_weight"), "source_size", "target", copies.alias("wanted"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """The columns doc_id, source, size, weight and u of a document."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    digits = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), 1, 13)
    return [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        (WEIGHT_OF_ANY + F.length(F.bin(size))).cast("long").alias("weight"),
        ((F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << RANK_BITS))).alias("u"),
    ]


def _same_source(of: str) -> Column:
    return F.col("source").eqNullSafe(F.col(of))


def _ranked(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds what wanted has, whole (certain copies) and rank: the order of the odds' quotient, null where nothing is to draw."""
    rows = sized.join(small(wanted), _same_source("t_source") & (F.col("weight") == F.col("t_weight")))
    u, p = F.col("u"), F.col("wanted") - F.floor("wanted")
    # q / (1 + q) of the quotient q = (u / (1 - u)) / (p / (1 - p)): the same order, between 0 and 1
    place = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    rank = F.when((p > 0) & (F.col("size") > 0), F.floor(place * float(1 << RANK_BITS)).cast("long"))
    return rows.withColumn("whole", F.floor("wanted")).withColumn("rank", rank)


def sample_ends(draws: DataFrame, room: DataFrame) -> DataFrame:
    """e_source, end: the rank of each source's first draw in order that doesn't fit in its room; none if all fit.

    draws: source, rank, words; room: r_source, room. Sums by the rank's digits narrow down where the room ends.
    """
    bits = RANK_BITS
    ends = room.select("r_source", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("filled"), "room")
    while True:
        ends = materialize(ends, "prefixes")
        near = draws.join(small(ends), _same_source("r_source")).filter(F.shiftright("rank", bits) == F.col("prefix"))
        if bits == 0 or (near.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= FEW:
            break
        bits -= DIGIT
        bins = near.groupBy("r_source", "filled", "room", F.shiftright("rank", bits).alias("prefix")).agg(F.sum("words").alias("words"))
        upto = F.col("filled") + F.sum("words").over(Window.partitionBy("r_source").orderBy("prefix"))
        # the bin in which the room ends
        bins = bins.withColumn("upto", upto).filter((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("words") <= F.col("room")))
        ends = bins.select("r_source", "prefix", (F.col("upto") - F.col("words")).alias("filled"), "room")
    near = near.groupBy("r_source", "filled", "room", "rank").agg(F.sum("words").alias("words"))
    upto = F.col("filled") + F.sum("words").over(Window.partitionBy("r_source").orderBy("rank"))
    over = near.withColumn("upto", upto).filter(F.col("upto") > F.col("room"))
    return over.groupBy(F.col("r_source").alias("e_source")).agg(F.min("rank").alias("end"))


def _drawn() -> Column:
    """Whether a pass takes a draw (rank, size) of a source that has end and room of each."""
    out = F.col("rank") < F.col("end0")
    for k in range(1, PASSES):
        out |= (F.col("rank") < F.col(f"end{k}")) & (F.col("size") <= F.col(f"room{k}"))
    return out


def mix(
    docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (size times copies) of every document, and the columns to carry."""
    columns = _sized(docs, id_col, text_col, source_col)
    sizes = docs.select(*columns[1:])
    # what is kept of a document: source, size, weight and u
    sizes = materialize(sizes, "sizes")
    targets = materialize(source_targets(sizes, weights, max_copies), "targets")
    wanted = materialize(copies_wanted(sizes, targets, max_copies), "wanted")
    ranked = _ranked(sizes, wanted)
    certain = ranked.groupBy(F.col("t_source").alias("r_source"), "target").agg(F.sum(F.col("whole") * F.col("size")).alias("words"))
    room = materialize(certain.select("r_source", (F.col("target") - F.col("words")).alias("room")), "room")
    draws = ranked.filter("rank is not null").groupBy("source", "rank", "size").agg(F.sum("size").alias("words"))
    draws = materialize(draws, "draws")
    none = F.lit((1 << RANK_BITS) + 1)
    plan = room.withColumnsRenamed({"r_source": "s_source", "room": "room0"})
    for k in range(PASSES):
        last = plan.select(
            F.col("s_source").alias("r_source"), F.col(f"room{k}").alias("room"), (F.col(f"end{k - 1}") if k else F.lit(0)).alias("from")
        )
        of = draws.join(small(last), _same_source("r_source"))
        of = of.filter((F.col("rank") >= F.col("from")) & (F.col("size") <= F.col("room") if k else F.lit(True)))
        of = of.select("source", "rank", "words")
        ends = sample_ends(of, last.select("r_source", "room"))
        plan = plan.join(ends, F.col("s_source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
        plan = materialize(plan.withColumn(f"end{k}", F.coalesce("end", none)).drop("end"), "plan")
        took = of.join(small(plan.select(F.col("s_source").alias("e_source"), F.col(f"end{k}").alias("end"))), _same_source("e_source"))
        took = took.filter("rank < end").groupBy(F.col("e_source").alias("k_source")).agg(F.sum("words").alias("took"))
        plan = plan.join(took, F.col("s_source").eqNullSafe(F.col("k_source")), "left")
        left = F.col(f"room{k}") - F.coalesce("took", F.lit(0))
        plan = materialize(plan.withColumn(f"room{k + 1}", left).drop("took", "k_source"), "plan")
    room_left = F.col(f"room{PASSES}")
    off = F.abs(room_left - F.col("words"))
    last = draws.join(small(plan), _same_source("s_source")).filter(~_drawn() & (off < room_left)).groupBy(F.col("s_source").alias("l_source"))
    last = last.agg(F.min(F.struct(off.alias("off"), "rank", "size")).alias("last"))
    plan = plan.join(last, F.col("s_source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    plan = materialize(plan.select("*", F.col("last.rank").alias("last_rank"), F.col("last.size").alias("last_size")).drop("last"), "plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *columns)
    rows = _ranked(rows, wanted).join(small(plan), _same_source("s_source"))
    drawn = _drawn() | ((F.col("rank") == F.col("last_rank")) & (F.col("size") == F.col("last_size")))
    extra = F.when(drawn, 1).otherwise(0)
    return rows.withColumn("copies", F.least(F.col("whole") + extra, F.lit(max_copies))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        *[F.col(f"row.`{c}`").alias(c) for c in carry],
    )


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_pass(k: int) -> str:
    """A pass over what the ones before left: p{k} has upto, and room of the next pass."""
    fits = f"CASE WHEN rank IS NOT NULL AND NOT taken{k - 1} AND size <= room{k} THEN size END" if k else "CASE WHEN rank IS NOT NULL THEN size END"
    open_ = f"NOT taken{k - 1} AND size <= room{k}" if k else "TRUE"
    before = f"taken{k - 1} OR " if k else ""
    return f"""
s{k} AS (SELECT *, sum({fits}) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE UNBOUNDED PRECEDING) AS upto{k} FROM p{k}),
t{k} AS (SELECT *, {before}rank IS NOT NULL AND {open_} AND upto{k} <= room{k} AS taken{k} FROM s{k}),
p{k + 1} AS (SELECT *, room{k} - coalesce(max(CASE WHEN taken{k} AND {open_} THEN upto{k} END) OVER (PARTITION BY source), 0) AS room{k + 1} FROM t{k})"""


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
weighed AS (SELECT *, 8 + length(bin(size)) AS digits FROM sized),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS l
  FROM per_source
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN l * weight >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
              ELSE max(CASE WHEN l * weight < 3 * source_size THEN l END) OVER () * weight END AS target
  FROM ordered),
digit_words AS (SELECT source, digits, CAST(sum(size) AS BIGINT) AS words FROM weighed GROUP BY source, digits),
levels AS (
  SELECT w.source, digits, words, source_size, target,
         coalesce((target - CAST(3 * coalesce(sum(words) OVER h, 0) AS DOUBLE))
           / CAST(nullif(sum(digits * words) OVER (PARTITION BY w.source) - coalesce(sum(digits * words) OVER h, 0), 0) AS DOUBLE), 0.0::DOUBLE) AS l
  FROM digit_words w JOIN targets t ON w.source IS NOT DISTINCT FROM t.source
  WINDOW h AS (PARTITION BY w.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT source, digits, source_size, target,
         CASE WHEN l * digits >= 3 THEN 3.0::DOUBLE
              ELSE coalesce(max(CASE WHEN l * digits < 3 AND words > 0 THEN l END) OVER (PARTITION BY source), 0.0::DOUBLE) * digits END AS c
  FROM levels),
rated AS (
  SELECT d.*, source_size, target, CAST(floor(c) AS BIGINT) AS whole, c - floor(c) AS p
  FROM weighed d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source AND d.digits = w.digits),
p0 AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN CAST(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 4503599627370496.0::DOUBLE) AS BIGINT) END AS rank,
         target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS room0
  FROM rated),{",".join(map(_sql_pass, range(PASSES)))},
rest AS (
  SELECT source, rank, size, room{PASSES} AS room, abs(room{PASSES} - CAST(sum(size) AS DOUBLE)) AS off
  FROM p{PASSES} WHERE rank IS NOT NULL AND NOT taken{PASSES - 1} GROUP BY source, rank, size, room{PASSES}),
closing AS (SELECT source, rank, size FROM rest WHERE off < room QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, rank, size) = 1),
mixed AS (
  SELECT p.*, CAST(least(whole + CASE WHEN taken{PASSES - 1} OR c.rank IS NOT NULL THEN 1 ELSE 0 END, 3) AS BIGINT) AS copies
  FROM p{PASSES} p LEFT JOIN closing c ON p.source IS NOT DISTINCT FROM c.source AND p.rank = c.rank AND p.size = c.size)
SELECT doc_id, source, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM mixed
"""
