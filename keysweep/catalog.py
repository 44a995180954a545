"""Rule catalog and the other fixed values.

Rules are rows: adding a detector means adding a row here, no code.  Patterns
use the common subset of Java regex (Spark) and RE2 (the DuckDB oracle): no
lookaround, no backreference.  ``\\s`` is rewritten to the ECMAScript space set by
``functions.regex.engine_regex`` before it reaches either engine.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    type: str
    category: str
    severity: str
    pattern: str
    description: str
    recommendation: str


# ---------------------------------------------------------------------------
# The detection rule catalog (type, category, severity, pattern, description,
# recommendation).  Categories follow the documented category list; the AWS key,
# GitHub token, Stripe, Google API key, Slack token, private-key header and
# generic-assignment patterns restate the sanitizer's fixed patterns below, the
# rest (and all severities, descriptions, recommendations) are our choices from
# public token formats.
# ---------------------------------------------------------------------------
RULES: list[Rule] = [
    Rule("aws_access_key_id", "Cloud Provider", "critical", r"AKIA[0-9A-Z]{16}",
         "AWS access key ID", "Rotate AWS access keys immediately"),
    Rule("aws_secret_access_key", "Cloud Provider", "critical",
         r"""(?i)aws_?secret_?(?:access_?)?key\s*[=:]\s*['"]?[A-Za-z0-9/+=]{40}""",
         "AWS secret access key", "Rotate the AWS secret key and audit CloudTrail for its use"),
    Rule("google_api_key", "Cloud Provider", "high", r"AIza[0-9A-Za-z_-]{35}",
         "Google API key", "Regenerate the Google API key and restrict it by API and referrer"),
    Rule("google_oauth_token", "Cloud Provider", "high", r"ya29\.[0-9A-Za-z_-]{20,}",
         "Google OAuth access token", "Revoke the Google OAuth token"),
    Rule("gcp_service_account", "Cloud Provider", "critical", r'"type"\s*:\s*"service_account"',
         "GCP service account key file", "Delete the service account key and create a new one"),
    Rule("azure_storage_key", "Cloud Provider", "critical", r"(?i)AccountKey=[A-Za-z0-9+/]{86}==",
         "Azure storage account key", "Rotate the Azure storage account key"),
    Rule("azure_client_secret", "Cloud Provider", "critical",
         r"""(?i)azure_?client_?secret\s*[=:]\s*['"]?[A-Za-z0-9_.~-]{34,40}""",
         "Azure AD client secret", "Remove the Azure client secret from the app registration and issue a new one"),
    Rule("github_token", "Version Control", "critical", r"ghp_[A-Za-z0-9]{36}",
         "GitHub personal access token", "Revoke the GitHub token and create a new one with minimal scopes"),
    Rule("github_oauth", "Version Control", "critical", r"gho_[A-Za-z0-9]{36}",
         "GitHub OAuth access token", "Revoke the GitHub OAuth token"),
    Rule("github_user", "Version Control", "critical", r"ghu_[A-Za-z0-9]{36}",
         "GitHub user-to-server token", "Revoke the GitHub App user token"),
    Rule("github_server", "Version Control", "critical", r"ghs_[A-Za-z0-9]{36}",
         "GitHub server-to-server token", "Revoke the GitHub App installation token"),
    Rule("github_refresh", "Version Control", "critical", r"ghr_[A-Za-z0-9]{36}",
         "GitHub refresh token", "Revoke the GitHub refresh token"),
    Rule("github_fine_grained", "Version Control", "critical", r"github_pat_[A-Za-z0-9_]{82}",
         "GitHub fine-grained personal access token", "Revoke the fine-grained GitHub token"),
    Rule("gitlab_token", "Version Control", "critical", r"glpat-[A-Za-z0-9_-]{20}",
         "GitLab personal access token", "Revoke the GitLab token"),
    Rule("postgres_uri", "Database", "critical",
         r"""(?i)postgres(?:ql)?://[^\s:@/]+:[^\s@/]+@[^\s'"]+""",
         "PostgreSQL connection string with password", "Change the database password and move the URI to a secret store"),
    Rule("mysql_uri", "Database", "critical", r"""(?i)mysql://[^\s:@/]+:[^\s@/]+@[^\s'"]+""",
         "MySQL connection string with password", "Change the database password and move the URI to a secret store"),
    Rule("mongodb_uri", "Database", "critical",
         r"""(?i)mongodb(?:\+srv)?://[^\s:@/]+:[^\s@/]+@[^\s'"]+""",
         "MongoDB connection string with password", "Change the database password and move the URI to a secret store"),
    Rule("redis_uri", "Database", "high", r"""(?i)rediss?://[^\s:@/]*:[^\s@/]+@[^\s'"]+""",
         "Redis connection string with password", "Change the Redis password and move the URI to a secret store"),
    Rule("stripe_live_key", "Payment", "critical", r"sk_live_[0-9a-zA-Z]{24,}",
         "Stripe live secret key", "Roll the Stripe secret key in the dashboard"),
    Rule("stripe_restricted_key", "Payment", "high", r"rk_live_[0-9a-zA-Z]{24,}",
         "Stripe live restricted key", "Roll the Stripe restricted key"),
    Rule("paypal_token", "Payment", "critical", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}",
         "PayPal Braintree production access token", "Revoke the PayPal access token"),
    Rule("twilio_api_key", "Communication", "high", r"SK[0-9a-f]{32}",
         "Twilio API key", "Delete the Twilio API key and create a new one"),
    Rule("twilio_account_sid", "Communication", "low", r"AC[0-9a-f]{32}",
         "Twilio account SID", "Check whether the Twilio auth token was exposed with the SID"),
    Rule("sendgrid_key", "Communication", "high", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
         "SendGrid API key", "Delete the SendGrid API key"),
    Rule("mailgun_key", "Communication", "high", r"key-[0-9a-f]{32}",
         "Mailgun API key", "Rotate the Mailgun API key"),
    Rule("slack_token", "Communication", "high", r"xox[baprs]-[0-9a-zA-Z-]{10,48}",
         "Slack token", "Revoke the Slack token and reinstall the app"),
    Rule("slack_webhook", "Communication", "medium", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}",
         "Slack incoming webhook URL", "Regenerate the Slack webhook URL"),
    Rule("twitter_key", "Social Media", "high", r"""(?i)twitter[a-z_]*\s*[=:]\s*['"]?[0-9a-z]{25,50}""",
         "Twitter API credential", "Regenerate the Twitter API keys"),
    Rule("facebook_token", "Social Media", "high", r"EAACEdEose0cBA[0-9A-Za-z]+",
         "Facebook access token", "Invalidate the Facebook access token"),
    Rule("rsa_private_key", "Cryptography", "critical", r"-----BEGIN RSA PRIVATE KEY-----",
         "RSA private key", "Replace the RSA key pair and revoke the old public key"),
    Rule("ssh_private_key", "Cryptography", "critical", r"-----BEGIN OPENSSH PRIVATE KEY-----",
         "OpenSSH private key", "Replace the SSH key pair and remove the old key from authorized_keys"),
    Rule("ec_private_key", "Cryptography", "critical", r"-----BEGIN EC PRIVATE KEY-----",
         "EC (ECDSA) private key", "Replace the EC key pair"),
    Rule("private_key", "Cryptography", "critical", r"-----BEGIN (?:(?:DSA|ENCRYPTED) )?PRIVATE KEY-----",
         "PKCS#8 private key", "Replace the key pair"),
    Rule("jwt", "Authentication", "medium",
         r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
         "JSON Web Token", "Invalidate the token and rotate the signing key if it is long-lived"),
    Rule("bearer_token", "Authentication", "medium", r"(?i)bearer\s+[A-Za-z0-9._~+/-]{20,}",
         "Bearer token", "Revoke the bearer token"),
    Rule("oauth_access_token", "Authentication", "medium",
         r"""(?i)access_token\s*[=:]\s*['"]?[A-Za-z0-9._-]{20,}""",
         "OAuth access token", "Revoke the OAuth access token"),
    Rule("generic_assignment", "Generic", "medium",
         r"""(?i)(?:password|passwd|pwd|secret|token|key|credential|api[_-]?key)\s*[=:]\s*['"]?([^'"\s]{8,})['"]?""",
         "Hard-coded password, secret or API key", "Move the value to environment variables or a secret manager"),
]

RULE_BY_TYPE = {r.type: r for r in RULES}

# The seven rules whose values are seeded into the documents table (FIXTURES.md).
SEEDED_TYPES = ["aws_access_key_id", "github_token", "postgres_uri", "rsa_private_key",
                "stripe_live_key", "slack_token", "generic_assignment"]

# Private-key blocks spanning lines (D6): any label, e.g. RSA, EC, OPENSSH or none.
BLOCK_BEGIN = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
BLOCK_END = r"-----END [A-Z0-9 ]*PRIVATE KEY-----"
BLOCK_RULE = Rule(
    "private_key_block", "Cryptography", "critical", BLOCK_BEGIN + r"[\s\S]*?" + BLOCK_END,
    "Private key block", "Replace the key pair and revoke the old public key",
)

# The ends of such a block as rules for single lines; ``operators.blocks`` makes blocks of their matches.
BLOCK_MARKERS = [
    Rule(BLOCK_RULE.type, BLOCK_RULE.category, BLOCK_RULE.severity, BLOCK_BEGIN, BLOCK_RULE.description, BLOCK_RULE.recommendation),
    Rule("private_key_block_end", BLOCK_RULE.category, BLOCK_RULE.severity, BLOCK_END, "End of a private key block", ""),
]

# Order used for ranks; anything else is an unrecognised severity.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITIES = ["critical", "high", "medium", "low"]

# ---------------------------------------------------------------------------
# Fixed values taken over unchanged for identical results.
# ---------------------------------------------------------------------------

# Files skipped by extension (case-insensitive suffix).
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico",
    ".pdf", ".zip", ".tar", ".gz", ".exe", ".dll",
    ".so", ".dylib", ".bin", ".woff", ".woff2", ".ttf",
    ".mp4", ".mp3", ".avi", ".mov", ".webm",
    ".jar", ".war", ".ear", ".class", ".pyc",
]

# Directories skipped as first or inner path segment (case-sensitive).
SKIP_DIRS = ["node_modules", ".git", "dist", "build", ".next", "vendor", "__pycache__"]

# Defaults of the job parameters.
MAX_FILE_SIZE = 10 * 1024 * 1024
MAX_FILES_PER_SCAN = 10000
DEFAULT_BRANCH = "main"
DEFAULT_PATH_LABEL = "entire repository"
INLINE_PATH = "inline"

# Log sanitizer patterns, applied in this order, each case-insensitively.
SANITIZER_PATTERNS = [
    r"""(?:password|passwd|pwd|secret|token|key|credential|api[_-]?key)\s*[=:]\s*['"]?([^'"\s]{8,})['"]?""",
    r"(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36}",
    r"AKIA[0-9A-Z]{16}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"xox[baprs]-[0-9a-zA-Z-]{10,48}",
    r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(RSA\s+)?PRIVATE\s+KEY-----",
]

# Our choice: lower-case literal anchors of the sanitizer patterns, in the same
# order (a necessary condition for a match).
SANITIZER_ANCHORS = [
    (("password", "passwd", "pwd", "secret", "token", "key", "credential", "api"), ("=", ":")),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ()),
    (("akia",), ()),
    (("sk_live_",), ()),
    (("aiza",), ()),
    (("xox",), ()),
    (("-----begin",), ()),
]

# Context keys whose values are always masked (case-insensitive substring).
SECRET_CONTEXT_KEYS = ["password", "secret", "token", "key", "credential", "apiKey", "api_key", "value"]

# Log levels in increasing order.
LOG_LEVELS = ["DEBUG", "INFO", "WARN", "ERROR"]

# Remediation steps: three when critical issues exist, two when high ones exist,
# then seven that always apply.
CRITICAL_STEPS = [
    "C1: Treat the critical findings as an incident now",
    "C2: Issue new credentials for every critical finding and switch to them",
    "C3: Disable the exposed credentials and check what they were used for",
]
HIGH_STEPS = [
    "H1: Plan the high findings for the next working day",
    "H2: Replace the exposed values and the settings that hold them",
]
GENERAL_STEPS = [
    "G1: Take every credential out of the files",
    "G2: Keep credentials in a secret store",
    "G3: Hand credentials to programs at run time, by environment or mounted file",
    "G4: Check changes for credentials before they are committed",
    "G5: Scan each build for credentials",
    "G6: Clean credentials out of the history of the repository",
    "G7: Write down how credentials are to be handled",
]

# Repository recommendations.
TOP_TYPES_PREFIX = "R0: Most findings are of these types: "
HIGH_RISK_RECOMMENDATIONS = [
    "R1: Have the repository reviewed by someone who does not work on it",
    "R2: Bring the next security audit forward",
]
GENERAL_RECOMMENDATIONS = [
    "R3: Scan for credentials on every push",
    "R4: Show contributors how credentials leak",
    "R5: Give each credential only the rights that it needs",
]
HIGH_RISK_SCORE = 70

# Snippet advice appended after the per-detection recommendations when any hit exists.
SNIPPET_ADVICE = [
    "S1: Find out which of the detected values still work",
    "S2: Replace credentials at fixed intervals",
    "S3: Read credentials from a secret store, not from code",
]

# Risk score weights and compliance thresholds.
SEVERITY_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
MAX_RISK_SCORE = 100
NON_COMPLIANT_SCORE = 80
AT_RISK_SCORE = 40

# Input limits of the request tables.
MAX_OWNER_LEN = 100
MAX_REPO_LEN = 100
MAX_BRANCH_LEN = 255
MAX_PATH_LEN = 1000
MAX_SECRET_TYPE_LEN = 100
MAX_SECRET_VALUE_LEN = 10000
OWNER_RE = r"^[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?$"
REPO_RE = r"^[a-zA-Z0-9._-]+$"
BRANCH_RE = r"^[a-zA-Z0-9._/-]+$"


# ---------------------------------------------------------------------------
# Our own choices (not in the reference): false-positive words, comment prefixes.
# ---------------------------------------------------------------------------
PLACEHOLDER_RE = r"(?i)example|placeholder|changeme|dummy|sample|your[_-]|xxxx|<[a-z_ -]+>"
TEST_TOKEN_RE = r"(?i)(^|[^a-z])test([^a-z]|$)"
TEST_PATH_RE = r"(?i)(^|/)(tests?|spec|__tests__|fixtures?|examples?)(/|$)|[._-](test|spec)\.[a-z]+$"
COMMENT_PREFIX_RE = r"^[ \t]*(#|//|\*|/\*|--|<!--)"
MIN_DISTINCT_CHARS = 4  # a value made of fewer distinct characters is a placeholder
