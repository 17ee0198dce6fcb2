"""Header options, form pairs and tab stops, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A part of a header up to a semicolon outside of quotes.
_PART = r'((?:[^;"]|"(?:[^"\\]|\\.)*(?:"|$))*)(?:;|$)'
_TRIM = r"^\s+|\s+$"


def _plain(value: Column) -> Column:
    """A value without its quotes, and what is escaped in them."""
    quoted = (F.char_length(value) >= 2) & F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"'))
    inner = F.replace(F.replace(F.substr(value, F.lit(2), F.char_length(value) - 2), F.lit("\\\\"), F.lit("\\")), F.lit('\\"'), F.lit('"'))
    return F.when(quoted, inner).otherwise(value)


def header_options(header: Column) -> Column:
    """struct(type, options): what stands before the first semicolon, and the name=value pairs after it, in order.

    Names are lower case; quoted values lose their quotes and escapes, and may hold
    semicolons. Names with an asterisk are left out; of a file name that is a whole path
    the last part is kept. A part without = has an empty value. A header without
    semicolons has its type alone, in lower case.
    """
    parts = F.transform(F.regexp_extract_all(header, F.lit(_PART), F.lit(1)), lambda x: F.regexp_replace(x, _TRIM, ""))
    # the expression also matches what is empty at the end
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - F.when(F.endswith(header, F.lit(";")), 0).otherwise(1), F.lit(1)))

    def pair(part: Column) -> Column:
        at = F.instr(part, "=")
        name = F.when(at > 0, F.lower(F.regexp_replace(F.substr(part, F.lit(1), at - 1), r"\s+$", ""))).otherwise(part)
        value = F.when(at > 0, _plain(F.regexp_replace(F.substr(part, at + 1), r"^\s+", ""))).otherwise("")
        path = (name == "filename") & F.rlike(value, F.lit(r"^(?:.:\\|\\\\)"))
        return F.struct(name.alias("name"), F.when(path, F.regexp_extract(value, r"([^\\]*)$", 1)).otherwise(value).alias("value"))

    options = F.filter(F.transform(F.slice(parts, 2, 1_000_000), pair), lambda o: ~F.contains(o["name"], F.lit("*")))
    some = F.contains(header, F.lit(";"))
    kind = F.when(some, parts[0]).otherwise(F.regexp_replace(F.lower(header), _TRIM, ""))
    none = F.array().cast("array<struct<name:string,value:string>>")
    return F.when(header.isNotNull(), F.struct(kind.alias("type"), F.when(some, options).otherwise(none).alias("options")))


def query_pairs(text: Column) -> Column:
    """array of struct(name, value) of a query string, in order, as they are written; repeated names stay, empty parts go.

    Parts end at & or ;. A part without = has a NULL value.
    """
    parts = F.filter(F.split(text, "[&;]", -1), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(at(p) > 0, F.substr(p, F.lit(1), at(p) - 1)).otherwise(p).alias("name"), F.when(at(p) > 0, F.substr(p, at(p) + 1)).alias("value")
        ),
    )


def expand_tabs(text: Column, stop: int, end_line: bool = True) -> Column:
    """Tabs become blanks up to the next multiple of stop in their line; a line feed is added where the last line has none."""

    def line(x: Column) -> Column:
        return F.aggregate(
            F.slice(F.split(x, "\t", -1), 2, 1_000_000_000),
            F.substring_index(x, "\t", 1),
            lambda done, piece: F.concat(done, F.repeat(F.lit(" "), stop - F.char_length(done) % stop), piece),
        )

    out = F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")
    return F.when(F.endswith(out, F.lit("\n")), out).otherwise(F.concat(out, F.lit("\n"))) if end_line else out
