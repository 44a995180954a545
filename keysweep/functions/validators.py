"""F8 by type: whether a match can be what its rule takes it for.

A pattern says what a secret looks like; many types say more: an alphabet, a checksum, a payload that must decode, or simply that
the value was drawn at random.  Each rule has a list of checks on the part of the match that is the secret; the first one that
fails is the verdict.  Checks are SQL text over one value, evaluated inside the scan where the match is still unmasked, and every
check exists for both engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysweep.functions.regex import engine_regex, spark_sql_literal, sql_string

# The alphabet of base-62 checksums.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What stands before the value in an assignment, and what may stand behind it.
ASSIGNED = r"^[^=:]*[=:]\s*['\"]?"
QUOTE_BEHIND = r"['\"]$"
#: Values that are filled in elsewhere, or stand for one.
FILLED_IN = (r"^(?:\$\{|\$\(|\$[A-Z_]+$|\{\{|%\(|<[^>]*>$|process\.env|os\.environ|getenv|env\[|secrets\.|vault:|ENC\[)"
             r"|^(?i:password|passwd|secret|changeme|change_me|none|null|true|false|undefined|redacted|xxx+|\*+)$")


@dataclass(frozen=True)
class Check:
    """``spark`` and ``duckdb``: SQL of a boolean over {v}; ``name`` is the verdict where it is false."""

    name: str
    spark: str
    duckdb: str


def _matches(name: str, pattern: str, holds: bool = True) -> Check:
    p = engine_regex(pattern)
    no = "" if holds else "NOT "
    return Check(name, no + "rlike({v}, " + _braces(spark_sql_literal(p)) + ")", no + "regexp_matches({v}, " + _braces(sql_string(p)) + ")")


def _braces(s: str) -> str:
    return s.replace("{", "{{").replace("}", "}}")


def random_enough(bits: float) -> Check:
    """The Shannon entropy of the value's characters, in bits a character."""
    each = ("aggregate(array_distinct(split({v}, '')), 0D, (a, c) -> a - (size(filter(split({v}, ''), x -> x = c)) / length({v})) "
            "* log2(size(filter(split({v}, ''), x -> x = c)) / length({v})))")
    return Check("entropy", f"({each} >= {bits}D)", f"(list_aggregate(string_split({{v}}, ''), 'entropy') >= {bits})")


def checksum(skip: int, length: int) -> Check:
    """The last six characters are the CRC-32 of the ``length`` characters behind a prefix of ``skip``, in base 62."""
    body = f"substr({{v}}, {skip + 1}, {length})"
    bits = f"flatten(list_transform(string_split({body}, ''), lambda c: list_transform(range(8), lambda b: (ord(c)::BIGINT >> b::INTEGER) & 1)))"
    duck_crc = (f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)")

    def digits(crc: str, divide: str) -> str:
        return "concat(" + ", ".join(f"substr('{BASE62}', cast((({crc}) {divide} {62 ** k}) % 62 as int) + 1, 1)" for k in range(5, -1, -1)) + ")"

    return Check("checksum", f"({digits(f'crc32(encode({body}, {chr(39)}UTF-8{chr(39)}))', 'div')} = right({{v}}, 6))",
                 f"({digits(duck_crc, '//')} = right({{v}}, 6))")


def _part(k: int, spark: bool) -> str:
    """The k-th part of a token of parts with dots, decoded from base 64 for URLs."""
    if spark:
        x = f"translate(split_part({{v}}, '.', {k}), '-_', '+/')"
        return f"decode(try_to_binary(rpad({x}, cast(ceil(length({x}) / 4) * 4 as int), '='), 'base64'), 'UTF-8')"
    x = f"translate(split_part({{v}}, '.', {k}), '-_', '+/')"
    return f"TRY(decode(from_base64(rpad({x}, (ceil(length({x}) / 4) * 4)::INTEGER, '='))))"


JSON_PARTS = Check("payload", f"coalesce(get_json_object({_part(1, True)}, '$.alg') IS NOT NULL AND get_json_object({_part(2, True)}, '$') LIKE '{{{{%', false)",
                   f"coalesce(TRY(json_extract_string({_part(1, False)}, '$.alg')) IS NOT NULL "
                   f"AND json_valid({_part(2, False)}) AND {_part(2, False)} LIKE '{{{{%', false)")
#: Base 64 that another encoder would write the same way: the bits that don't count are zero.
EXACT_BASE64 = Check("base64", "coalesce(replace(base64(try_to_binary({v}, 'base64')), concat(chr(13), chr(10)), '') = {v}, false)",
                     "coalesce(to_base64(TRY(from_base64({v}))) = {v}, false)")
NOT_FILLED_IN = _matches("placeholder", FILLED_IN, holds=False)

GITHUB = [checksum(4, 30)]
URI_PASSWORD = r"^[A-Za-z+]+://[^\s:@/]*:([^\s@/]+)@.*$"
#: For each rule: what is cut off to get at the secret (a pattern and what replaces it), and its checks in order.
ASSIGNMENT, PASSWORD, WHOLE = ((ASSIGNED, ""), (QUOTE_BEHIND, "")), ((URI_PASSWORD, "$1"),), ()
CHECKS: dict[str, tuple[tuple[tuple[str, str], ...], list[Check]]] = {
    "aws_access_key_id": (WHOLE, [_matches("alphabet", r"^AKIA[A-Z2-7]{16}$"), random_enough(2.45)]),
    "aws_secret_access_key": (ASSIGNMENT, [NOT_FILLED_IN, random_enough(3.45)]),
    "azure_storage_key": (((r"^[^=]*=", ""),), [EXACT_BASE64, random_enough(3.95)]),
    "azure_client_secret": (ASSIGNMENT, [NOT_FILLED_IN, random_enough(2.95)]),
    "google_api_key": (((r"^AIza", ""),), [random_enough(2.95)]),
    "google_oauth_token": (((r"^ya29\.", ""),), [random_enough(2.95)]),
    **dict.fromkeys(["github_token", "github_oauth", "github_user", "github_server", "github_refresh"], (WHOLE, GITHUB)),
    "github_fine_grained": (WHOLE, [_matches("alphabet", r"^github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}$"), random_enough(3.95)]),
    "gitlab_token": (((r"^glpat-", ""),), [random_enough(2.45)]),
    **dict.fromkeys(["postgres_uri", "mysql_uri", "mongodb_uri", "redis_uri"], (PASSWORD, [NOT_FILLED_IN])),
    "stripe_live_key": (((r"^sk_live_", ""),), [random_enough(2.45)]),
    "stripe_restricted_key": (((r"^rk_live_", ""),), [random_enough(2.45)]),
    "paypal_token": (((r"^.*\$", ""),), [random_enough(2.45)]),
    "twilio_api_key": (((r"^SK", ""),), [random_enough(2.45)]),
    "twilio_account_sid": (((r"^AC", ""),), [random_enough(2.45)]),
    "sendgrid_key": (((r"^SG\.", ""),), [random_enough(3.45)]),
    "mailgun_key": (((r"^key-", ""),), [random_enough(2.45)]),
    "slack_token": (((r"^xox[a-z]-", ""),), [random_enough(2.45)]),
    "twitter_key": (ASSIGNMENT, [NOT_FILLED_IN, random_enough(2.95)]),
    "jwt": (WHOLE, [JSON_PARTS]),
    "bearer_token": (((r"^[A-Za-z]+\s+", ""),), [NOT_FILLED_IN, random_enough(2.95)]),
    "oauth_access_token": (ASSIGNMENT, [NOT_FILLED_IN, random_enough(2.95)]),
    "generic_assignment": (ASSIGNMENT, [NOT_FILLED_IN, random_enough(2.45)]),
}


def _verdict(kind: str, raw: str, spark: bool) -> str:
    cuts, checks = CHECKS[kind]
    value = raw
    for pattern, by in cuts:
        p = engine_regex(pattern)
        value = (f"regexp_replace({value}, {spark_sql_literal(p)}, {spark_sql_literal(by)})" if spark
                 else f"regexp_replace({value}, {sql_string(p)}, {sql_string(by.replace('$', chr(92)))})")
    tests = " ".join(f"WHEN NOT ({(c.spark if spark else c.duckdb).format(v='v')}) THEN '{c.name}'" for c in checks)
    case = f"CASE {tests} END"
    return (f"transform(array({value}), v -> {case})[0]" if spark else f"list_transform([{value}], lambda v: {case})[1]")


def failed_check_sql(kind: str = "type", raw: str = "raw", spark: bool = True) -> str:
    """SQL of the name of the first check that a match of a rule of type ``kind`` fails; null if none does or the type has none."""
    groups: dict[str, list[str]] = {}
    for name in CHECKS:
        groups.setdefault(_verdict(name, raw, spark), []).append(name)
    whens = " ".join(f"WHEN {kind} IN ({', '.join(sql_string(n) for n in names)}) THEN {verdict}" for verdict, names in groups.items())
    return f"CASE {whens} END"


def failed_check(kind: str = "type", raw: str = "raw") -> Column:
    return F.expr(failed_check_sql(kind, raw))
