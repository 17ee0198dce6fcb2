"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base spans (e-mail addresses, IP addresses, card numbers passing Luhn, phone
numbers) come from fixed expressions. They are seeds: instances of a kind. Other
instances are candidates: tokens with an @, and runs of digit groups with the
brackets, dots, blanks and dashes that numbers are written with, that no base span
overlaps. What stands around an instance are its lexical patterns:

- L, LL: the word, the two words before it;  R: the word after it;
- LR: both neighbours;  LS: the word before it with the instance's shape;
- B: the label at the line's start, if only that stands before it ("Fax:").

Patterns and instances form a graph that Spark scores in rounds:

- a pattern's confidence for a kind is the sum of its instances' scores for that kind
  over SMOOTH more than that sum and what speaks against it: its instances of other
  kinds and forms, and UNKNOWN for each candidate of the kind's form that is not
  found; it counts from MIN_SUPPORT distinct instances' worth and MIN_CONFIDENCE on;
- a seed scores 1 for its kind; a candidate whose form suits the kind scores
  1 - prod(1 - confidence) over the patterns that hold it, and from MIN_CONFIDENCE
  on it is found, and counts for patterns in the next round.

Scores only rise, so rounds go on until no score does (by 1e-6 in sum). What was found is a
span wherever it stands. Positions count code points, ends
are exclusive. Words are compared in lower case, digits in them as 0.

Nulls: a null text counts as empty: no spans. A null doc_id is carried along;
documents are told apart by id and text, so repeated rows get equal results. An
empty table gives an empty result. Texts and words of any length are taken whole.
find_personal_data() reads doc_id and text alone; redact() returns all columns as
they are but for text, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, small

KINDS = ("email", "ip", "card", "phone")
TOKEN = len(KINDS)

MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.8
SMOOTH, UNKNOWN = 1.0, 0.1
#: Up to so many spans in all (each of a few numbers) are sent to every executor; beyond that they are joined by shuffle.
BROADCAST_SPANS = 500_000
#: Code points to a block, in which a text is cut for redaction.
CUT = 4096

#: Possessive, and anchored where a run of the first class begins, so that long runs take linear time.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT = r"[^\s@<>\x22'(),;:]"
_TOKEN = (
    rf"(?:\G|(?<!{_AT})){_AT}++@{_AT}*(?<![.!?])"
    r"|(?<![A-Za-z0-9@._=-])[+(]*+[0-9](?:[\x20().:/-]{0,3}+[0-9])*+(?![A-Za-z0-9@_=])"
)
#: Which candidates suit which kind.
_FORMS = (
    r"^[^@\s]+@[^@\s]+$",
    r"^[0-9]{1,3}(?:[.:]+[0-9]{1,3}){3,7}$",
    r"^[0-9](?:[\x20-]?[0-9]){11,18}$",
    r"^[+(]*[0-9](?:[\x20().:/-]{0,3}[0-9]){6,14}$",
)


def _word(x: Column) -> Column:
    """A word, or words with blanks between, as patterns compare them."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"[0-9]", "0"), r"\s+", " "))


def _around(gap: Column) -> Column:
    """What stands at a gap's ends: of the match before it the next word, of the one after it the two words and the label.

    The text is turned round to look back, so that the expression is anchored and long gaps take linear time.
    """
    return F.transform(
        F.array(F.reverse(gap)),
        lambda back: F.struct(
            F.char_length(gap).alias("gap"),
            _word(F.reverse(F.regexp_extract(back, r"^\s*+(\S++)", 1))).alias("left"),
            _word(F.reverse(F.regexp_extract(back, r"^\s*+(\S++\s++\S++)", 1))).alias("left2"),
            _word(F.reverse(F.regexp_extract(back, r"^[ \t]*+(:[^\n:]++)(?:\n|$)", 1))).alias("label"),
            _word(F.regexp_extract(gap, r"^\s*+(\S++)", 1)).alias("right"),
        ),
    )[0]


_SIDES = ("left", "left2", "label", "right")


def _found(text: Column, kind: int, pattern: str, worth: Column) -> Column:
    """Array of (kind, i, value, gap, left, left2, label, right) of each match; gap: code points between it and the one before.

    split() gives what stands between the matches that regexp_extract_all() gives.
    The last entry has no value; it holds what follows the last match.
    """
    between = F.transform(F.split(text, pattern, -1), _around)
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), between.alias("gap"))
    out = F.transform(
        both,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            z["value"].alias("value"),
            z["gap"]["gap"].alias("gap"),
            *[z["gap"][side].alias(side) for side in _SIDES],
        ),
    )
    return F.when(worth, out)


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled, is divisible by 10."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda a, i: a
        + F.when(
            (n - i) % 2 == 1,
            (2 * F.substring(digits, i, F.lit(1)).cast("int")) % 10
            + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int"),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == 2, F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(8, 15))
        .otherwise(True)
    )


def find_marks(docs: DataFrame) -> DataFrame:
    """doc_id, digest, kind, start, end, value and what stands around: base spans and candidates of each distinct document.

    What finds them runs in one scan; only matches are shuffled, by document.
    """
    text = F.col("text")
    guards = (
        F.contains(text, F.lit("@")),
        text.rlike(r"[0-9]\.[0-9]"),
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        F.contains(text, F.lit("+")),
        text.rlike("[0-9@]"),
    )
    arrays = [F.coalesce(_found(text, k, p, g), F.array()) for k, (p, g) in enumerate(zip((*PATTERNS, _TOKEN), guards))]
    rows = (
        docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("digest"))
        .select("doc_id", "digest", F.explode_outer(F.concat(*arrays)).alias("m"))
        .select("doc_id", "digest", "m.*")
        .filter(F.col("kind").isNotNull())
        .dropDuplicates(["doc_id", "digest", "kind", "i"])  # repeated rows, before they meet in a task
    )
    in_kind = Window.partitionBy("doc_id", "digest", "kind").orderBy("i")
    rows = rows.withColumn("size", F.coalesce(F.char_length("value"), F.lit(0)))
    rows = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_kind).cast("long"))
        .withColumn("start", F.col("end") - F.col("size"))
        .withColumn("right", F.lead("right").over(in_kind))
        .filter(F.col("value").isNotNull() & _valid(F.col("kind"), F.col("value")))
    )
    # in order of start: what a base span reaches, and where the next one begins
    by_start = Window.partitionBy("doc_id", "digest").orderBy("start", "kind", "end")
    base = F.col("kind") < TOKEN
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("reach", reach).withColumn("next", after)
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return rows.filter(base | free).select("doc_id", "digest", "kind", "start", "end", "value", *_SIDES)


def _patterns() -> Column:
    """The patterns of a mark; null where it has none of that sort."""
    left, left2, label, right = map(F.col, _SIDES)
    shape = F.regexp_replace(F.regexp_replace("value", r"[0-9]", "9"), r"\p{L}+", "a")
    said = lambda sort, *parts: F.when(
        sum((F.when(p != "", 0).otherwise(1) for p in parts), F.lit(0)) == 0, F.concat_ws(" ", F.lit(sort), *parts)
    )
    return F.array(
        said("L", left), said("LL", left2), said("B", label), said("R", right), said("LR", left, right), said("LS", left, shape)
    )


def bootstrap(
    marks: DataFrame, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """value, kind of the candidates that confident patterns discover.

    Scores live on distinct (pattern, instance) edges. Seeds and forms are counted
    once; rounds join the found instances and the confident patterns to the edges of
    candidates that suit a kind.
    """
    base = F.col("kind") < TOKEN
    suits = F.array(*[F.col("seed").isNull() & F.col("value").rlike(f) for f in _FORMS])
    edges = (
        marks.select("value", F.when(base, F.col("kind")).alias("seed"), F.explode(_patterns()).alias("pattern"))
        .filter(F.col("pattern").isNotNull())
        .groupBy("pattern", "value")
        .agg(F.min("seed").alias("seed"))
        .withColumn("suits", suits)
    )
    edges = materialize(edges, "edges")
    of_kind = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.sum(F.when(F.col("seed") == k, 1.0).otherwise(0.0)).alias("seeds"),
                F.sum(F.when(F.col("suits")[k], 1.0).otherwise(0.0)).alias("open"),
            )
            for k in range(TOKEN)
        ]
    )
    numbers = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.explode(of_kind).alias("k"))
    numbers = numbers.select("pattern", "n", "k.*").filter(F.col("seeds") + F.col("open") >= min_support)
    numbers = materialize(numbers, "numbers")
    candidates = edges.filter(F.exists("suits", lambda x: x)).drop("seed")
    candidates = materialize(candidates.join(small(numbers.select("pattern").distinct()), "pattern", "left_semi"), "candidates")
    found = marks.sparkSession.createDataFrame([], "value string, kind int, score double")
    before = None
    while True:
        scored = candidates.join(small(found), "value").groupBy("pattern", "kind")
        scored = scored.agg(F.sum("score").alias("more"), F.sum(F.lit(1.0)).alias("found"))
        worth = F.col("seeds") + F.coalesce("more", F.lit(0.0))
        against = F.col("n") - F.col("seeds") - F.col("open") + UNKNOWN * (F.col("open") - F.coalesce("found", F.lit(0.0)))
        confident = (
            numbers.join(scored, ["pattern", "kind"], "left")
            .filter(worth >= min_support)
            .select("pattern", "kind", (worth / (worth + against + SMOOTH)).alias("confidence"))
            .filter(F.col("confidence") >= min_confidence)
        )
        confident = materialize(confident, "confident")
        found = (
            candidates.join(small(confident), "pattern")
            .filter(F.element_at("suits", F.col("kind") + 1))
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
            .filter(F.col("score") >= min_confidence)
        )
        found = materialize(found, "found")
        now = found.agg(F.count(F.lit(1)), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6)).first()
        if not now[0] or now == before:  # scores only rise, so the same sum is the same scores
            break
        before = now
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    return found.groupBy("value").agg(best.alias("kind"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, kind (0 to 3), start, end, base: every span of each distinct document."""
    marks = materialize(find_marks(docs), "marks")
    found = materialize(bootstrap(marks), "discovered")
    base = marks.filter(F.col("kind") < TOKEN).select("doc_id", "digest", "kind", "start", "end", F.lit(True).alias("base"))
    more = (
        marks.filter(F.col("kind") == TOKEN)
        .drop("kind")
        .join(small(found), "value")
        .select("doc_id", "digest", F.col("kind").cast("int").alias("kind"), "start", "end", F.lit(False).alias("base"))
    )
    return base.unionByName(more)


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _base_of(kind: int):
    return lambda s: s["base"] & (s["kind"] == kind)


def _joined(docs: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """docs (with text and doc_id among its columns) as row, text, and what of has for each document."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.xxhash64("text", "doc_id").alias("digest")
    )
    of = of.withColumnsRenamed({"doc_id": "p_id", "digest": "p_digest"})
    same = (F.col("digest") == F.col("p_digest")) & F.col("row.doc_id").eqNullSafe(F.col("p_id"))
    return rows.join(F.broadcast(of) if n <= BROADCAST_SPANS else of, same, "left")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans: all as kind:start:end."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spans = materialize(personal_spans(docs), "spans")
    of = spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "base"))).alias("found"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    rows = _joined(docs, of, spans.count()).withColumn("found", F.coalesce("found", none))
    base = F.filter("found", lambda s: s["base"])
    counts = [
        F.size(F.filter("found", _base_of(k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return rows.select(
        "row.doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans")
    )


def _cut_out(text: Column, cuts: Column) -> Column:
    """text with the ranges of cuts (start, end, kind; in order, apart) replaced by [KIND].

    A text is first cut into blocks of CUT code points, so that a piece is found
    without counting from the text's start: time is in proportion to text and cuts.
    """
    name = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])
    i32 = lambda x: x.cast("int")

    def build(z: Column) -> Column:
        blocks, cut, n = z["blocks"], z["cuts"], z["n"]

        def piece(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CUT), F.floor((b - 1) / CUT)
            one = F.substring(F.get(blocks, i32(first)), i32(a - first * CUT + 1), i32(b - a))
            many = F.concat(
                F.substring(F.get(blocks, i32(first)), i32(a - first * CUT + 1), F.lit(CUT)),
                F.array_join(F.slice(blocks, i32(first + 2), i32(last - first - 1)), ""),
                F.substring(F.get(blocks, i32(last)), F.lit(1), i32(b - last * CUT)),
            )
            return F.when(b <= a, "").when(first == last, one).otherwise(many)

        def part(i: Column) -> Column:
            a = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(cut, i - 1)["end"])
            b = F.when(i == F.size(cut), n).otherwise(F.get(cut, i)["start"])
            return F.concat(piece(a, b), F.coalesce(F.get(name, F.get(cut, i)["kind"]), F.lit("")))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cut)), part), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    whole = F.struct(blocks.alias("blocks"), cuts.alias("cuts"), F.char_length(text).cast("long").alias("n"))
    return F.transform(F.array(whole), build)[0]  # a lambda's variable is computed once


def redact(docs: DataFrame) -> DataFrame:
    """docs, each span of its text replaced by [KIND]; spans that overlap are one, of the kind of the first."""
    spans = materialize(personal_spans(docs.select("doc_id", F.col("text").cast("string").alias("text"))), "spans")
    by_start = Window.partitionBy("doc_id", "digest").orderBy("start", F.col("end").desc(), "kind")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.coalesce(reach, F.lit(-1)) <= F.col("start"), 1).otherwise(0)
    runs = spans.withColumn("starts", starts).withColumn("run", F.sum("starts").over(by_start))
    runs = runs.groupBy("doc_id", "digest", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.when(F.col("starts") == 1, F.col("kind"))).alias("kind")
    )
    of = runs.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    rows = _joined(docs, of, spans.count())
    text = F.col("text").cast("string")
    clean = F.when(F.col("cuts").isNotNull(), _cut_out(text, F.col("cuts"))).otherwise(text)
    return rows.withColumn("clean", clean).select(
        *[F.col("clean").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
