"""Scrubbing secrets, personal data, hosts and home folders from texts, as Spark expressions.

Secrets go before personal data, so that a secret that looks like an address is a
secret. What names a value stays, the value goes. Each rule runs once over the text:
matches become a mark of one character, from which the counts are taken, and marks
become placeholders at the end. U+FDD0 and U+FDD1, which are no characters, are the
marks: a text that has them already is taken as redacted there. Of NULL all is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET, PII = "[REDACTED:secret]", "[REDACTED:pii]"
_SECRET, _PII = "\ufdd0", "\ufdd1"

# Prefixes of tokens, names of secrets, phrases.
PREFIXES = ("ghp_", "github_pat_", "gho_", "ghu_", "sk-ant-", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "tskey-", "sk-")
KEYS = ("password", "passwd", "api_key", "apikey", "api-key", "secret", "token", "aws_secret_access_key")
MARKERS = (
    "social security", "credit card", "bank account", "routing number", "medical record", "diagnosis", "patient", "iban",
)

_TOKEN = r"[A-Za-z0-9_.~+/=-]"
_VALUE = r"[^ \t\n\r\"',;]+"
_IS = r"[ \t\n\f\r]*+[:=][ \t\n\f\r]*+"
#: Runs of a phone number: digits and what stands between them.
_GAP = r"[ ().-]"
_RUN = r"[0-9 ().-]"
_DASHED = r"\+?[0-9 ().]*-[0-9 ().]*-[0-9 ().-]*[0-9]"

#: Rules in order: name, pattern, what is kept of a match before the mark, mark.
RULES = (
    ("pem", r"-----BEGIN [^\n]*PRIVATE KEY-----[^\n]*+(?:(?s:.*?)-----END [^\n]*+)?", "", _SECRET),
    ("bearer", rf"(?<=Bearer ){_TOKEN}{{8,}}", "", _SECRET),
    # quoted values with blanks go whole; others up to a blank, quote or comma
    ("kv", rf"((?i:(?<![a-z0-9_])(?:{'|'.join(KEYS)})){_IS})(?:\"[^\"\n]*[ \t][^\"\n]*\"|'[^'\n]*[ \t][^'\n]*')", "$1", _SECRET),
    ("kv", rf"((?i:(?<![a-z0-9_])(?:{'|'.join(KEYS)})){_IS}[\"']?){_VALUE}", "$1", _SECRET),
    ("url", r"(://[^ \t\n\r'\"/:@]*:)[^ \t\n\r'\"/@]+(?=@)", "$1", _SECRET),
    ("prefix", rf"AKIA[A-Z0-9]{{16}}|(?:{'|'.join(PREFIXES)}){_TOKEN}{{8,}}", "", _SECRET),
    ("host", rf"((?i:(?<![a-z0-9_])hostname){_IS}){_VALUE}", "$1", _SECRET),
    (
        "ssh",
        r"((?:\A|(?<=[ \t\n\r\"']))ssh (?:-(?=[^ \t]*p)[^ \t]*+[ \t]*+[0-9][^ \t]*+[ \t]*+|-[^ \t]*+[ \t]*+)*+"
        r"(?:[^ \t\n\r\"'@]*+@)?)[^ \t\n\r\"']+",
        "$1",
        _SECRET,
    ),
    (
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9.-]*\.[A-Za-z]{2,}(?=[.-]*+(?![A-Za-z0-9.-]))",
        "",
        _PII,
    ),
    (
        "card",
        r"(?<![0-9])(?:[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])",
        "",
        _PII,
    ),
    (
        "phone",
        # it begins with +, ( or a digit, so that runs of blanks and dashes are passed over at once;
        # 7 to 15 digits in all, and none after; not a date; + or ( or two dashes or a blank in it;
        # with dashes or dots not from within a number; groups of up to 5 digits
        rf"(?=[+(0-9])(?=\+?(?:{_GAP}*+[0-9]){{7,15}}+(?!{_GAP}*[0-9]))(?![0-9]{{4}}-{_RUN}{{2}}-{_RUN}[0-9](?!{_GAP}*[0-9]))"
        rf"(?:(?=\+|{_RUN}*\({_RUN}*[0-9])|(?={_DASHED})|(?=[0-9().-]* {_RUN}*[0-9]))"
        rf"(?:(?<![0-9])|(?!{_DASHED})(?!\+?[0-9 ()-]*\.{_RUN}*[0-9]))"
        rf"(?:[+(]{_GAP}*+)?[0-9]{{1,5}}+(?:{_GAP}++[0-9]{{1,5}}+)*+(?!{_GAP}*[0-9])",
        "",
        _PII,
    ),
    ("marker", rf"(?i:(?<![a-z0-9])(?:{'|'.join(MARKERS)})(?![a-z0-9]))", "", _PII),
)
_HOME = r"/(?:home|Users)/[A-Za-z0-9_.-]++(?=/|\z)"


def rewrite_homes(text: Column, home: str = "") -> Column:
    """The home folder and all others under /home and /Users become $WORK."""
    if home:
        text = F.replace(text, F.lit(home), F.lit("$WORK"))
    return F.regexp_replace(text, _HOME, r"\$WORK")


def _marked(text: Column, names: tuple[str, ...]) -> Column:
    for name, pattern, kept, mark in RULES:
        if not names or name in names:
            text = F.regexp_replace(text, pattern, kept + mark)
    return text


def _once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _placed(marked: Column) -> Column:
    return F.replace(F.replace(marked, F.lit(_SECRET), F.lit(SECRET)), F.lit(_PII), F.lit(PII))


def scrub(text: Column, home: str = "", rules: tuple[str, ...] = ()) -> Column:
    """struct(text, secrets, personal, scrubbed, redacted_chars, orig_chars), by the rules of these names, or all.

    redacted_chars counts the characters that matches replaced, of the orig_chars that
    the text has after home folders were rewritten.
    """

    def counted(x: Column) -> Column:
        count = lambda what: F.regexp_count(x["marked"], F.lit(what))
        secrets, personal = count(_SECRET), count(_PII)
        return F.struct(
            _placed(x["marked"]).alias("text"),
            secrets.alias("secrets"),
            personal.alias("personal"),
            (secrets + personal > 0).alias("scrubbed"),
            (F.char_length(x["plain"]) - F.char_length(x["marked"]) + secrets + personal).alias("redacted_chars"),
            F.char_length(x["plain"]).alias("orig_chars"),
        )

    def marked(plain: Column) -> Column:
        return F.struct(plain.alias("plain"), _marked(plain, rules).alias("marked"))

    return _once(_once(rewrite_homes(text, home), marked), counted)


def scrub_text(text: Column, home: str = "", rules: tuple[str, ...] = ()) -> Column:
    """The text alone."""
    return _placed(_marked(rewrite_homes(text, home), rules))


def redacted_fraction(scrubbed: Column) -> Column:
    """Share of a scrub()'s characters that were replaced; 0 of an empty text."""
    return F.coalesce(scrubbed["redacted_chars"] / F.nullif(scrubbed["orig_chars"], F.lit(0)), F.lit(0.0))


_STRING = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?'


def scrub_json(text: Column, home: str = "") -> Column:
    """JSON text whose string values, at any depth, are scrubbed; keys, numbers and layout stay."""

    def leaf(x: Column) -> Column:
        value = F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>")[0]
        quoted = F.to_json(F.array(scrub_text(value, home)))
        return F.when(x.endswith(":"), x).otherwise(F.substring(quoted, F.lit(2), F.char_length(quoted) - 2))

    found = F.transform(F.regexp_extract_all(text, F.lit(_STRING), F.lit(0)), leaf)
    both = F.arrays_zip(F.split(text, _STRING, -1).alias("between"), found.alias("found"))
    return F.array_join(F.transform(both, lambda z: F.concat(z["between"], F.coalesce(z["found"], F.lit("")))), "")


#: What a summary names of a gate's detail, in this order (fixed values).
SUMMARY_KEYS = ("passed", "test_count", "total", "reason", "threshold")
SUMMARY_BYTES = 240


def gate_summary(gate: Column, passed: Column, detail: Column, home: str = "") -> Column:
    """One line on a gate's verdict, scrubbed, of 240 bytes at most before that; of the held-out gate its threshold alone."""

    def named(key: str) -> Column:
        value = _member(detail, key)
        return F.when(value != "", F.concat(F.lit(f"{key}="), value))

    word = F.when(passed, "pass").otherwise("fail")
    held = F.concat_ws(" ", word, named("threshold"))
    whole = F.when(gate == "heldout_divergence", held).otherwise(F.concat_ws(" ", word, *map(named, SUMMARY_KEYS)))
    return scrub_text(_once(whole, lambda x: first_bytes(x, SUMMARY_BYTES)), home)


def first_bytes(text: Column, n: int) -> Column:
    """The longest beginning of whole characters that has at most n bytes in UTF-8."""
    raw = F.encode(text, "UTF-8")
    # a character has four bytes at most: one of the last four cuts is between two
    cuts = [F.try_validate_utf8(F.substring(raw, 1, k).cast("string")) for k in range(n, n - 4, -1)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*cuts))


def _member(detail: Column, key: str) -> Column:
    """A member's text: strings bare, others as JSON, also null; NULL where there is none or the detail is no object."""
    of = F.from_json(detail, "map<string,string>")
    return F.when(F.map_contains_key(of, F.lit(key)), F.coalesce(F.get_json_object(detail, f"$.{key}"), F.lit("null")))
