"""Scrubbing over texts made of each order's key, so that the oracle states every rule's result outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import scrub
from tidewell.registry import query
from tidewell.sources.tables import table

_ID = "lpad(CAST(o_orderkey AS STRING), 8, '0')"
_S, _P = f"'{scrub.SECRET}'", f"'{scrub.PII}'"
_N = "chr(10)"

#: A text, what it becomes, and how many secrets and personal data it has; # stands for the id, S and P for placeholders.
_CASES = (
    ("'key AKIAIOSFODNN'|#|'XY end'", "'key '|S|'XY end'", 1, 0),
    ("'a ghp_abc.'|#|'~+/= b'", "'a '|S|' b'", 1, 0),
    ("'ghu_'|#|' tskey-'|#|' xoxs-'|#|'.REST'", "S|' '|S|' '|S", 3, 0),
    ("'sk-ant-api03-'|#|' sk-1234'", "S|' sk-1234'", 1, 0),
    ("'leak:'|N|'-----BEGIN RSA PRIVATE KEY-----'|N|'MII'|#|N|'-----END RSA PRIVATE KEY-----'|N|'done'", "'leak:'|N|S|N|'done'", 1, 0),
    ("'-----BEGIN PRIVATE KEY-----'|#|N|'next'", "S|N|'next'", 1, 0),
    ("'password = hunter2-'|#|' then Authorization: Bearer abc.DEF'|#|' end'", "'password = '|S|' then Authorization: Bearer '|S|' end'", 2, 0),
    ("'API-Key=\"v'|#|'\"; passwd: p'|#|', mysecret=keep'", "'API-Key=\"'|S|'\"; passwd: '|S|', mysecret=keep'", 2, 0),
    ("'clone https://deploy:s3cr3t-'|#|'@git.example.com/org now'", "'clone https://deploy:'|S|'@git.example.com/org now'", 1, 0),
    ("'mail bob.smith+'|#|'@example.co.uk.'", "'mail '|P|'.'", 0, 1),
    ("'call +1 (555) 013-4455 on 2026-10-26, v 1.75922973'", "'call '|P|' on 2026-10-26, v 1.75922973'", 0, 1),
    ("'card 4111-1111-1111-1111 ssn 078-05-1120 id '|#", "'card '|P|' ssn '|P|' id '|#", 0, 2),
    ("'HOSTNAME = build-fleet-'|#|N|'run ssh -p 22 deploy@internal-'|#|' -- up'", "'HOSTNAME = '|S|N|'run ssh -p 22 deploy@'|S|' -- up'", 2, 0),
    ("'note: patient follow-up, Diagnosis pending; outpatient'", "'note: '|P|' follow-up, '|P|' pending; outpatient'", 0, 2),
    ("'wrote /home/alice/o'|#|' and /Users/bob.x/y, /home/carol z'", "'wrote $WORK/o'|#|' and $WORK/y, /home/carol z'", 0, 0),
    ("'commit 586940e7bde7 gain 1.75922973672599 wall 2026-10-26 version 1.2.3 phone-ish 12345 token-budget 150'", None, 0, 0),
    ("''", None, 0, 0),
    ("'ssh -A build-'|#", "'ssh -A '|S", 1, 0),
    ("'ghp_'|#|repeat('x', o_orderkey % 40)|' '|repeat('fn ', o_custkey % 17)", "S|' '|repeat('fn ', o_custkey % 17)", 1, 0),
    ("'risk-abcdefg'|#", "'ri'|S", 1, 0),
)


def _said(case: str) -> str:
    names = {"#": _ID, "S": _S, "P": _P, "N": _N}
    return " || ".join(names.get(x, x) for x in case.split("|"))


def _chosen(values: list[str]) -> str:
    return "CASE o_orderkey % 20 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


_TEXT = _chosen([_said(c[0]) for c in _CASES])
_WANT = f"""
SELECT o_orderkey, {_TEXT} AS given, {_chosen([_said(c[1] or c[0]) for c in _CASES])} AS text,
       {_chosen([str(c[2]) for c in _CASES])} AS secrets, {_chosen([str(c[3]) for c in _CASES])} AS personal FROM orders"""
_LEFT = f"length(text) - {len(scrub.SECRET)} * secrets - {len(scrub.PII)} * personal"
#: The home folders' case is shorter before anything is redacted.
_ORIG = "CASE WHEN o_orderkey % 20 = 14 THEN length(text) ELSE length(given) END"


@query(
    "scr_rules",
    f"SELECT o_orderkey, text, secrets, personal, CAST({_ORIG} - ({_LEFT}) AS INT) AS redacted_chars FROM ({_WANT}) x",
)
def scr_rules(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", scrub.scrub(F.expr(_TEXT)).alias("s"))
    return rows.select("o_orderkey", "s.text", "s.secrets", "s.personal", "s.redacted_chars")


@query(
    "flt_gutted",
    f"SELECT o_orderkey, coalesce(({_ORIG} - ({_LEFT})) / nullif({_ORIG}, 0)::DOUBLE > 0.5, false) AS gutted FROM ({_WANT}) x",
)
def flt_gutted(spark, d):
    """Texts over half of which was redacted."""
    rows = table(spark, d, "orders").select("o_orderkey", scrub.scrub(F.expr(_TEXT)).alias("s"))
    return rows.select("o_orderkey", (scrub.redacted_fraction(F.col("s")) > 0.5).alias("gutted"))


@query(
    "scr_kv",
    r"""SELECT doc_id, md5(regexp_replace(text, '(^|[^A-Za-z0-9_])((?i:password|passwd|api_key|apikey|api-key|secret|token|aws_secret_access_key)[ \t\n\f\r]*[:=][ \t\n\f\r]*["'']?)[^ \t\n\r"'',;]+',
          '\1\2[REDACTED:secret]', 'g')) AS digest FROM documents""",
)
def scr_kv(spark, d):
    clean = scrub.scrub_text(F.col("text"), rules=("kv",))
    return table(spark, d, "documents").select("doc_id", F.md5(clean).alias("digest"))


@query(
    "scr_url",
    r"""SELECT page_id, regexp_replace(replace(url, '://', '://user:pw@'), '(://[^ \t\n\r''"/:@]*:)[^ \t\n\r''"/@]+@', '\1[REDACTED:secret]@') AS url FROM pages""",
)
def scr_url(spark, d):
    given = F.replace("url", F.lit("://"), F.lit("://user:pw@"))
    return table(spark, d, "pages").select("page_id", scrub.scrub_text(given, rules=("url",)).alias("url"))


def _detail(ok: str, by: str, said: str) -> str:
    """SQL of a nested detail; what stands after token=, by the name and after password= differ before and after scrubbing."""
    return (
        """'{"reason":"' || CASE o_orderkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'token=' || @ok ELSE '' END || '","test_count":' ||
        CAST(o_custkey AS STRING) || ',"passed":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END ||
        ',"threshold":0.05,"notes":[{"by":"' || @by || '"},"say ' || chr(92) || '"hi' || chr(92) || '" to password=' || @said || '",7,{}]}'"""
    ).replace("@ok", ok).replace("@by", by).replace("@said", said)


_DETAIL = _detail(f"'t' || {_ID}", f"'a' || {_ID} || '@b.cc'", f"'p' || {_ID}")


@query("prj_json_scrub", f"SELECT o_orderkey, {_detail(_S, _P, _S)} AS detail FROM orders")
def prj_json_scrub(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scrub.scrub_json(F.expr(_DETAIL)).alias("detail"))


@query(
    "prj_gate_summary",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'fail threshold=0.05' ELSE
          CASE WHEN o_orderkey % 5 = 0 THEN 'fail' ELSE 'pass' END || ' passed=' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'null' END
          || ' test_count=' || CAST(o_custkey AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN ' reason=ok' WHEN 1 THEN ' reason=token=' || {_S} ELSE '' END
          || ' threshold=0.05' END AS summary FROM orders""",
)
def prj_gate_summary(spark, d):
    gate = F.when(F.col("o_orderkey") % 4 == 0, "heldout_divergence").otherwise("oracle_parity")
    passed = (F.col("o_orderkey") % 4 != 0) & (F.col("o_orderkey") % 5 != 0)
    return table(spark, d, "orders").select("o_orderkey", scrub.gate_summary(gate, passed, F.expr(_DETAIL)).alias("summary"))
