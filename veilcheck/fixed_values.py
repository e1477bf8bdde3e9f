"""Fixed values.

Everything in this module is a given of the detection semantics: word lists,
lookup tables, thresholds and formats that results depend on.  They are stated
once, in their natural order, and used by both the Spark code and the tests.
"""

# Words whose presence near a match raises its score.
CONTEXT_KEYWORDS = [
    "api_key", "apikey", "secret", "password", "passwd", "pwd", "token", "auth",
    "credential", "private_key", "access_key", "client_secret", "app_secret",
    "api_secret", "database_url", "connection_string", "yandex", "vk", "sber",
    "tinkoff", "ozon", "cloudru", "telegram",
]

# Placeholder patterns (searched case-insensitively in a value).
PLACEHOLDER_PATTERNS = [
    r"example", r"test", r"fake", r"dummy", r"placeholder", r"xxxx", r"1234",
    r"your[_\-]?\w*key", r"<[^>]+>", r"\*{4,}", r"TODO", r"FIXME",
]
MIN_DISTINCT_CHARS = 4

# Lengths of hexadecimal digests that look like plain hashes.
HASH_HEX_LENGTHS = [32, 40, 64]

# File suffixes and directory names that are never scanned.
SKIP_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf",
    ".eot", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".pdf", ".lock", ".sum",
    ".exe", ".dll", ".so", ".bin",
]
SKIP_DIRS = [
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build",
    ".idea", ".vscode", "vendor", "target", "out",
]

# Configuration suffixes that raise a score, and the scoring weights.
CONFIG_EXTENSIONS = [".env", ".cfg", ".conf", ".ini", ".yaml", ".yml", ".json", ".toml"]
HASH_PENALTY = 3
ENTROPY_STEPS = [(4.5, 3), (3.5, 1)]
CONTEXT_BONUS = 2
CONFIG_BONUS = 2
ENV_BONUS = 1
STRUCTURE_BONUS = 3
TAINT_BONUS = 2
MIN_SCORE = 2
CONTEXT_RADIUS = 2
VALUE_LIMIT = 80

# Severities, lowest first, with the score each one starts at.
SEVERITY_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_THRESHOLDS = {"CRITICAL": 12, "HIGH": 8, "MEDIUM": 5}

# Confidence terms.
CONFIDENCE_BASE = 0.15
CONFIDENCE_SCORE_SCALE = 16.0
CONFIDENCE_ENTROPY_TERM = 0.1
CONFIDENCE_STRUCTURE_TERM = 0.15
CONFIDENCE_TAINT_TERM = 0.15
CONFIDENCE_CAP = 0.99

# Suffixes of files whose variables are followed to risky calls.
FLOW_EXTENSIONS = [".py", ".js", ".ts", ".rb", ".go", ".java", ".php"]

# Risky calls, tried in this order; the first hit names the call.
SINKS = [
    (r"\brequests\.(get|post|put|patch|delete|head)\b", "HTTP request"),
    (r"\burllib\.request\.", "HTTP request"),
    (r"\bhttpx\.(get|post|put|patch|delete)\b", "HTTP request"),
    (r"\baiohttp\.", "HTTP request"),
    (r"\bsmtplib\.", "Email sending"),
    (r"\blogging\.(info|debug|warning|error|critical)\b", "Logging"),
    (r"\bprint\s*\(", "Console output"),
    (r"\bopen\s*\(", "File write"),
    (r"\bsubprocess\.(run|call|Popen|check_output)\b", "Shell execution"),
    (r"\bos\.system\s*\(", "Shell execution"),
    (r"\bsocket\.", "Raw socket"),
    (r"\bparamiko\.", "SSH connection"),
    (r"\bpysftp\.", "SFTP connection"),
    (r"\bboto3\.", "AWS SDK call"),
    (r"\bpymongo\.", "MongoDB query"),
    (r"\bpsycopg2\.", "PostgreSQL query"),
    (r"\bsqlalchemy\.", "Database query"),
    (r"\bsequelize\.", "Database query"),
    (r"\bexec\s*\(", "Dynamic code execution"),
]

# Suffixes of files that may go to an external code review, the
# markers of risky code (searched case-insensitively) and the review limits.
REVIEW_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rb", ".php", ".cs",
    ".rs", ".sh", ".bash", ".ps1", ".sql",
]
RISK_MARKERS = [
    r"\bos\.system\s*\(",
    r"\bsubprocess\.(run|call|Popen|check_output)\b",
    r"\bshell\s*=\s*True\b",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"\bpickle\.loads\s*\(",
    r"\byaml\.load\s*\(",
    r"\brender_template_string\b",
    r"\bJinja2\b",
    r"SELECT\s+.+\+\s*\w+",
    r"INSERT\s+INTO\s+.+\+\s*\w+",
    r"UPDATE\s+.+\+\s*\w+",
]
REVIEW_MAX_BYTES = 50_000
REVIEW_MAX_FILES = 50

# Threat words in review responses and what each severity is worth.
THREAT_WORDS = {
    "КРИТИЧЕСКАЯ": "CRITICAL",
    "ВЫСОКАЯ": "HIGH",
    "СРЕДНЯЯ": "MEDIUM",
    "НИЗКАЯ": "LOW",
    "БЕЗОПАСНО": "SAFE",
    "CRITICAL": "CRITICAL",
    "HIGH": "HIGH",
    "MEDIUM": "MEDIUM",
    "LOW": "LOW",
    "SAFE": "SAFE",
}
SAFE_MARKERS = ["[БЕЗОПАСНО]", "[SAFE]"]
SAFE_WORDS = ["БЕЗОПАСНО", "SAFE"]
REVIEW_SCORES = {"LOW": 3, "MEDIUM": 6, "HIGH": 9, "CRITICAL": 13}
REVIEW_CONFIDENCE = {"LOW": 0.55, "MEDIUM": 0.55, "HIGH": 0.7, "CRITICAL": 0.7}
REVIEW_TYPE = "AI Security"
REVIEW_CATEGORY = "ai_security"
REVIEW_SOURCE = "ai:nvidia"
REVIEW_SOURCE_PREFIX = "ai:"
REVIEW_QUOTE_LIMIT = 200

# Depth of a history scan.
HISTORY_COMMITS = 50
HISTORY_COMMIT_DIGITS = 12

# Line-stream markers, alarm substrings in order, and verdicts.
STREAM_START = "CMD:SCAN_START"
STREAM_END = "CMD:SCAN_END"
ALARM_SUBSTRINGS = [
    "AKIA", "ghp_", "sk_live_", "xoxb-", "xoxp-", "PRIVATE KEY", "AIza", "eyJ",
]
ALARM_SEVERITY = "CRITICAL"
VERDICT_ALARM = "AUTHORIZE_EXPORT"
VERDICT_CLEAN = "SCAN_CLEAN"

# Defaults of a user-supplied rule.
CUSTOM_RULE_SCORE = 5
CUSTOM_RULE_CATEGORY = "api_key"

# File name of a download whose address has none.
DEFAULT_DOWNLOAD_NAME = "downloaded_target"
