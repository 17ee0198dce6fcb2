"""Versions: parsing to fields, canonical text, and a key that sorts by release order.

One anchored expression has all parts of a version in their order: the epoch before !,
the release, the marks that may follow (pre-release, post-release, development
release), and the local part after +.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public version standard's words for its marks.
PRE_WORDS = {"a": ("alpha", "a"), "b": ("beta", "b"), "rc": ("preview", "pre", "rc", "c")}
POST_WORDS = ("post", "rev", "r")
DEV_WORDS = ("dev",)


def _any_of(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_PRE = _any_of([w for words in PRE_WORDS.values() for w in words])
#: Groups: epoch, release, word and number of the pre-release, post-release, development release and its number, local.
_SHAPE = (
    r"^v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)"
    rf"(?:[-_.]?({_PRE})[-_.]?([0-9]*))?"
    rf"(-[0-9]+|[-_.]?(?:{_any_of(POST_WORDS)})[-_.]?[0-9]*)?"
    rf"([-_.]?(?:{_any_of(DEV_WORDS)})[-_.]?([0-9]*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def parse(version: Column) -> Column:
    """Fields of a version; NULL where the text is none."""
    text = F.lower(F.regexp_replace(version, r"^\s+|\s+$", ""))
    part = lambda n: F.regexp_extract(text, _SHAPE, n)
    number = lambda digits: F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))
    kind = F.coalesce(*[F.when(part(3).isin(*words), k) for k, words in PRE_WORDS.items()])
    return F.when(
        F.rlike(text, F.lit(_SHAPE)),
        F.struct(
            number(part(1)).alias("epoch"),
            F.split(part(2), r"\.").alias("release"),
            kind.alias("pre"),
            number(part(4)).alias("pre_n"),
            (part(5) != "").alias("post"),
            number(F.regexp_extract(part(5), "[0-9]+$", 0)).alias("post_n"),
            (part(6) != "").alias("dev"),
            number(part(7)).alias("dev_n"),
            F.nullif(part(8), F.lit("")).alias("local"),
        ),
    )


def _bare(digits: Column) -> Column:
    return F.regexp_replace(digits, "^0+(?=.)", "")


def canonical(version: Column) -> Column:
    """The version's one spelling, its release without trailing zeros; NULL where the text is none."""

    def text(p: Column) -> Column:
        release = F.regexp_replace(F.array_join(F.transform(p["release"], _bare), "."), r"(\.0)+$", "")
        local = F.transform(F.split(p["local"], "[-_.]"), lambda x: F.when(F.rlike(x, F.lit("^[0-9]+$")), _bare(x)).otherwise(x))
        return F.concat(
            F.when(_bare(p["epoch"]) != "0", F.concat(_bare(p["epoch"]), F.lit("!"))).otherwise(""),
            release,
            F.coalesce(F.concat(p["pre"], _bare(p["pre_n"])), F.lit("")),
            F.when(p["post"], F.concat(F.lit(".post"), _bare(p["post_n"]))).otherwise(""),
            F.when(p["dev"], F.concat(F.lit(".dev"), _bare(p["dev_n"]))).otherwise(""),
            F.coalesce(F.concat(F.lit("+"), F.array_join(local, ".")), F.lit("")),
        )

    return _once(parse(version), text)


def is_prerelease(version: Column) -> Column:
    """Whether it is a pre-release or development release; NULL where the text is no version."""
    return _once(parse(version), lambda p: p["pre"].isNotNull() | p["dev"])


def _number(digits: Column) -> Column:
    """Digits of any number as text that sorts by value: the length first."""
    return _once(_bare(digits), lambda x: F.concat(F.lpad(F.length(x).cast("string"), 4, "0"), x))


def sort_key(version: Column) -> Column:
    """A struct that sorts as versions do: dev before pre before release before post; trailing zeros don't count."""

    def key(p: Column) -> Column:
        plain = p["pre"].isNull() & ~p["post"]
        release = F.split(F.regexp_replace(F.array_join(p["release"], "."), r"(\.0+)+$", ""), r"\.")
        return F.when(
            p.isNotNull(),
            F.struct(
                _number(p["epoch"]).alias("epoch"),
                F.transform(release, _number).alias("release"),
                F.when(plain & p["dev"], 0).when(p["pre"] == "a", 1).when(p["pre"] == "b", 2).when(p["pre"] == "rc", 3).otherwise(4).alias("phase"),
                _number(p["pre_n"]).alias("pre_n"),
                F.when(p["post"], 1).otherwise(0).alias("post"),
                _number(p["post_n"]).alias("post_n"),
                F.when(p["dev"], 0).otherwise(1).alias("final"),
                _number(p["dev_n"]).alias("dev_n"),
                F.coalesce(p["local"], F.lit("")).alias("local"),
            ),
        )

    return _once(parse(version), key)
