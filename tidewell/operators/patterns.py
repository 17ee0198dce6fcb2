"""Texts that hold any of many patterns, by shared grams: no pair of a text and a pattern is tried that shares none."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.session import ensure_checkpoint_dir

#: Bytes of a gram.
GRAM = 4
#: Bytes of a text that are numbered at a time.
PIECE = 1 << 20
#: A prime: of each gram of a text, its remainder by it is looked up first.
SLOTS = 262_139
#: A side of a join is sent to every executor up to so many bytes of memory.
BROADCAST_BYTES = 32 << 20
#: Bytes of memory that a row sent takes besides its values: key, headers and its place in the table of hashes.
ROW_BYTES = 160
#: Ids in a block; two blocks stand for all pairs of their ids.
BLOCK = 512
#: Times the usual number of tasks that pairs of blocks are dealt to: some blocks are short.
DEALS = 4
#: Texts of up to so many bytes are dealt anew: they may lie in one row group, which one task would read.
SMALL_TEXTS = 1 << 30
#: Shares that the pairs of a hot key are dealt into where neither side of a join can be sent.
SHARES = 32


def _distinct_codes(data: np.ndarray, size: int, known: np.ndarray | None) -> np.ndarray:
    """The runs of that many bytes, each once, as numbers that tell sizes apart; of known slots only, if these are given."""
    found = np.empty(0, np.int64)
    for at in range(0, len(data) - size + 1, PIECE):
        piece = data[at : at + PIECE + size - 1].astype(np.int64)
        code = np.full(len(piece) - size + 1, size, np.int64)
        for k in range(size):
            code = code << 8 | piece[k : k + len(code)]
        code = code if known is None else code[known[code % SLOTS]]
        code = np.sort(np.concatenate([found, code]))
        found = code[np.diff(code, prepend=-1) > 0]
    return found


def _grams(text: Column, sizes: list[int], known: np.ndarray | None = None) -> Column:
    """Distinct runs of so many bytes of the UTF-8, in one pass over the text."""

    @F.arrow_udf("array<bigint>")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        if not len(raw):
            return pa.array([], pa.list_(pa.int64()))
        _, ends, data = raw.buffers()
        ends = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(data if data is not None else b"", np.uint8)
        each = [np.concatenate([_distinct_codes(data[a:b], k, known) for k in sizes]) for a, b in zip(ends[:-1], ends[1:])]
        until = np.cumsum([0, *map(len, each)])
        return pa.ListArray.from_arrays(pa.array(until, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *each])))

    return of(text)


def _slots(grams: DataFrame) -> np.ndarray:
    """Which remainders the grams have: most grams of a text are no pattern's, and are passed over where they are numbered."""
    slots = np.zeros(SLOTS, bool)
    slots[[r.slot for r in grams.select((F.col("gram") % SLOTS).alias("slot")).distinct().collect()]] = True  # SLOTS at most
    return slots


def _size(frame: DataFrame, *columns: str) -> int:
    """About the bytes of memory that the frame takes where it is sent, these columns' values counted twice, as row and as key."""
    values = sum((2 * F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(ROW_BYTES))
    return frame.agg(F.sum(values.cast("long"))).first()[0] or 0


def _sent(frame: DataFrame, *columns: str) -> DataFrame:
    """The frame, to be broadcast if with these columns' values it takes at most BROADCAST_BYTES."""
    return F.broadcast(frame) if _size(frame, *columns) <= BROADCAST_BYTES else frame


def _dealt(texts: DataFrame) -> DataFrame:
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return texts.repartition("text_id") if size <= SMALL_TEXTS else texts


def _matched(found: DataFrame, many: DataFrame, key: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """found joined with many, where few keys may have most rows of both: the smaller is sent, or the larger is dealt into shares.

    A row may meet very many, and a small file is one task's: the other side is dealt to all tasks.
    """
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = sizes or (_size(found, *found.columns), _size(many, *many.columns))
    small, other = (found, many) if sizes[0] <= sizes[1] else (many, found)
    if min(sizes) <= BROADCAST_BYTES:
        return other.repartition(tasks, *other.columns).join(F.broadcast(small), key)
    shared = other.withColumn("_share", F.pmod(F.xxhash64(*other.columns), F.lit(SHARES)).cast("int"))
    each = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return shared.join(each, [key, "_share"]).drop("_share")


def _blocks(frame: DataFrame, keys: list[str], each: str) -> tuple[DataFrame, int]:
    """keys and each, an array of up to BLOCK of a key's ids in order; and the bytes of memory that it takes where it is sent.

    Rows are dealt by ranges of key and id, so no task holds a key's. A key's ids in a batch
    are cut evenly. Keys are not null.
    """

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, new = batch[each], np.arange(batch.num_rows) == 0
            for k in keys:
                new[1:] |= pc.not_equal(batch[k][1:], batch[k][:-1]).to_numpy(zero_copy_only=False)
            runs = np.flatnonzero(new)
            long = np.diff(np.append(runs, batch.num_rows))
            parts = -(-long // BLOCK)
            run = np.repeat(np.arange(len(runs)), parts)
            starts = runs[run] + (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * long[run] // parts[run]
            until = np.append(starts, batch.num_rows)
            size = np.diff(until) * max(1, ids.nbytes // batch.num_rows)
            got = [batch[k].take(pa.array(starts)) for k in keys]
            yield pa.RecordBatch.from_arrays([*got, pa.ListArray.from_arrays(pa.array(until, pa.int32()), ids), pa.array(size, pa.int64())], [*keys, each, "_size"])

    kinds = {f.name: f.dataType for f in frame.schema}
    fields = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField(each, T.ArrayType(kinds[each])), T.StructField("_size", T.LongType())])
    ordered = frame.select(*keys, each).repartitionByRange(*keys, each).sortWithinPartitions(*keys, each)
    blocks = ordered.mapInArrow(cut, fields).checkpoint()
    size = blocks.agg(F.sum(F.col("_size") + ROW_BYTES)).first()[0] or 0
    return blocks.drop("_size"), size


def _pairs(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """A row for each two rows of left (key, a and columns of it) and right (key, b) of the same key.

    Joined and dealt are blocks of ids, which take a few bytes for a thousand rows. A task
    gets near ones of few keys, and makes its rows of two blocks at a time, b's ids again and
    again in the same order: a file of them takes the fewer bytes.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = [c for c in left.columns if c not in (key, a)]
    (lefts, m), (rights, n) = _blocks(left, [key, *more], a), _blocks(right, [key], b)
    both = _matched(lefts, rights, key, (m, n))
    dealt = both.repartitionByRange(DEALS * tasks, key, F.col(a)[0], F.col(b)[0])
    return dealt.select(F.explode(a).alias(a), b, *more).select(a, F.explode(b).alias(b), *more)


def _found(texts: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """text_id, text, pattern of the texts that contain a pattern, each pattern once; None where there is no pattern."""
    ensure_checkpoint_dir(texts.sparkSession)
    distinct = distinct.filter("pattern <> ''").select("pattern").distinct().withColumn("size", F.least(F.octet_length("pattern"), F.lit(GRAM)))
    of = [F.when(F.col("size") == k, _grams(F.col("pattern"), [k])) for k in range(1, GRAM + 1)]
    grams = distinct.select("pattern", "size", F.explode(F.coalesce(*of)).alias("gram")).checkpoint()
    sizes = sorted(r.size for r in grams.select("size").distinct().collect())  # GRAM at most
    if not sizes:
        return None
    kept = _dealt(texts.filter("text is not null").select("text_id", "text"))
    exploded = kept.withColumn("gram", F.explode(_grams(F.col("text"), sizes, _slots(grams))))
    known = _sent(grams.select("gram").distinct(), "gram")
    counts = exploded.select("gram").join(known, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x"))
    anchors = rarest.filter("x.n > 0").select("pattern", F.col("x.gram").alias("gram")).checkpoint()
    found = exploded.join(_sent(anchors, "pattern", "gram"), "gram").filter(F.contains("text", F.col("pattern")))
    return found.select("text_id", "text", "pattern")


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, pattern_id of the texts (text_id, text) that contain the pattern (pattern_id, pattern).

    A pattern is looked for where its rarest gram occurs; a gram is GRAM bytes of the UTF-8, a
    pattern of fewer is its own gram. The grams' numbers of texts are counted first, over all texts, and of
    the grams that patterns have alone. Empty and null patterns and null texts give nothing;
    patterns that are equal are looked for once, and their rows come in at the end, from blocks
    of ids. Texts of any length take time in proportion to it.
    """
    found = _found(texts, patterns)
    if found is None:
        return texts.select("text_id").limit(0).crossJoin(patterns.select("pattern_id").limit(0))
    hits = found.select("pattern", "text_id").checkpoint()
    named = patterns.filter("pattern <> ''").select("pattern", "pattern_id")
    return _pairs(named, hits, "pattern", "pattern_id", "text_id").select("text_id", "pattern_id")


def _whole_word(text: Column, word: Column) -> Column:
    quoted = F.regexp_replace(word, r"([^A-Za-z0-9_])", r"\\$1")
    return F.rlike(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))


def affected_tests(tests: DataFrame, units: DataFrame) -> DataFrame:
    """unit, test, why: tests (test, dir, text) that a change to the units (unit, subsystem, stem) may affect.

    A test is affected if it lies in the subsystem's folder, if its text holds the
    subsystem's name, or the unit's stem as a whole word, upper or lower case; and any
    test without a text is, as nothing is known of it. why is the first of these reasons:
    "unresolved", "colocated", "subsystem", "stem". Empty subsystems and stems match
    nothing; a unit without a row affects nothing, so that its caller runs all tests.

    Units of the same names are judged once, as a kind; a row a unit and test comes at the
    end from blocks of ids, and nothing is shuffled after it.
    """
    reasons = ("unresolved", "colocated", "subsystem", "stem")
    empty = lambda c: F.coalesce(F.lower(c), F.lit(""))
    ensure_checkpoint_dir(tests.sparkSession)
    names = F.sort_array(F.collect_set(F.struct(empty("subsystem").alias("subsystem"), empty("stem").alias("stem"))))
    of_unit = units.groupBy("unit").agg(names.alias("names")).checkpoint()
    kinds = of_unit.select("names").distinct().withColumn("kind", F.monotonically_increasing_id()).checkpoint()
    named = kinds.select("kind", F.explode("names").alias("n")).select("kind", "n.subsystem", "n.stem")
    by_subsystem = named.filter("subsystem <> ''").select("kind", F.col("subsystem").alias("pattern")).distinct()
    by_stem = named.filter("stem <> ''").select("kind", F.col("stem").alias("pattern")).distinct()

    unknown = tests.filter("text is null").select("test").distinct().checkpoint()
    known = tests.filter("text is not null").join(_sent(unknown, "test"), "test", "left_anti")
    texts = known.select(F.col("test").alias("text_id"), F.lower("text").alias("text"))
    # each folder that a test's folder lies in
    parts = F.split(F.lower("dir"), "/")
    folders = known.select("test", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("pattern"))
    every = [_matched(folders, by_subsystem, "pattern").select("kind", "test", F.lit(1).alias("rank"))]
    found = _found(texts, by_subsystem.select("pattern").union(by_stem.select("pattern")))
    if found is not None:
        hits = found.select(F.col("text_id").alias("test"), "pattern", _whole_word(F.col("text"), F.col("pattern")).alias("whole")).checkpoint()
        every.append(_matched(hits.select("test", "pattern"), by_subsystem, "pattern").select("kind", "test", F.lit(2).alias("rank")))
        every.append(_matched(hits.filter("whole").select("test", "pattern"), by_stem, "pattern").select("kind", "test", F.lit(3).alias("rank")))
    judged = reduce(DataFrame.union, every).groupBy("kind", "test").agg(F.min("rank").alias("rank"))
    why = F.element_at(F.array(*map(F.lit, reasons)), F.col("rank") + 1).alias("why")
    of_kind = of_unit.join(_sent(kinds, "names"), "names").select("kind", "unit")
    blind = F.lit(-1).cast("long").alias("kind")  # a kind that all units are of, for the tests of which nothing is known
    tests_of = judged.select("kind", "test", "rank").union(unknown.select(blind, "test", F.lit(0)))
    units_of = of_kind.union(of_unit.select(blind, "unit"))
    return _pairs(tests_of.select("kind", why, "test"), units_of, "kind", "test", "unit").select("unit", "test", "why")
