"""Values the results depend on.

Everything in this file is a FIXED VALUE: names, patterns, limits and text
templates that must equal the audited systems' own spelling for results to be
right.  Nothing here is derived; logic lives elsewhere.
"""

# --- FIXED VALUES: actors, violations, event names -------------------------
HUMAN = "HUMAN"
SERVICE_PRINCIPAL = "SERVICE_PRINCIPAL"
SERVICE_ACCOUNT = "SERVICE_ACCOUNT"
AWS_SERVICE = "AWS_SERVICE"
UNKNOWN = "UNKNOWN"
NON_HUMAN_CATEGORIES = ["SERVICE_PRINCIPAL", "AWS_SERVICE", "UNKNOWN", "SERVICE_ACCOUNT"]

UNAUTHORIZED = "UNAUTHORIZED_ACCESS"
OUTSIDE_WINDOW = "ACCESS_OUTSIDE_WINDOW"
HIGH = "HIGH"
MEDIUM = "MEDIUM"

OBJECT_EVENTS = ["GetObject", "PutObject", "DeleteObject", "RestoreObject"]
DB_CONNECT = "DbSessionConnect"
DB_DISCONNECT = "DbSessionDisconnect"
CREDS_ISSUED = "VaultCredsIssued"
CREDS_REQUEST = "VaultCredsRequest"
CURATED_EVENTS = ["VaultCredsIssued", "DbSessionConnect", "DbSessionDisconnect"]

OBJECT_SOURCE = "s3.amazonaws.com"
OBJECT_ARN_PREFIX = "arn:aws:s3:::"
RDS_ARN_PREFIX = "arn:aws:rds:"
DB_ARN_PREFIX = "db:"
IAM_ARN_PREFIX = "arn:aws:iam::"
IAM_USER_MARK = ":user/"
AWS_HOST_MARK = ".amazonaws.com"

# --- FIXED VALUES: identity patterns ---------------------------------------
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
LOGIN_PREFIXES = ["v-oidc-", "oidc-"]
SESSION_NAME_MARKS = ["metadata-handler", "k8s-irsa-", "aws-sdk-java-", "role-"]
ISSUER_MARKS = ["role-", "k8s-irsa-", "-prod", "-service"]
DEFAULT_ZONE = "Europe/Berlin"

# --- FIXED VALUES: log line patterns ---------------------------------------
LINE_TIME = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC)"
LINE_AUTHORIZED = r"connection authorized: user=([^\s]+) database=([^\s]+)"
LINE_AUTHENTICATED = r"connection authenticated: identity=\"?([^\s\"]+)\"? .*?method=([^\s]+)"
LINE_CONTEXT = r":([^:@\s]+)@([^:\s]+):"
LINE_DISCONNECT = r"disconnection: session time: (\d+):(\d+):(\d+) user=([^\s]+) database=([^\s]+)"
DB_LOG_FILTER = r"connection authorized|disconnection:|.*@.*:"
CRED_LOG_TERMS = ["database", "creds", "prod-"]
PROD_CRED_PATH_PREFIX = "database/creds/prod-"
OID_NAMESPACE_HEX = "6ba7b8129dad11d180b400c04fd430c8"
DEFAULT_EVENT_SOURCE = "audit.prod"
DROPPED_NETWORK_FIELDS = ["sourceIpAddress", "client_addr", "source_ip"]
SINK_CHUNK = 100

# --- FIXED VALUES: requests -------------------------------------------------
TICKET_KEY = r"^[A-Z][A-Z0-9]+-\d+$"
REPLAY_SECONDS = 300

# --- FIXED VALUES: ticket limits and texts ----------------------------------
BODY_MAX_CHARS = 32000
BODY_KEPT_CHARS = 31800
ATTACHMENT_MAX_BYTES = 100 * 1024 * 1024
TABLE_MAX_ROWS = 20
SUMMARY_MAX_ROWS = 10
TRUNCATION_NOTICE = (
    "\n\n---\n**Content truncated due to Jira size limits. Full details available in attachment.**"
)
OVERSIZE_MESSAGE = "Full violation details too large for attachment. See Jira description for details."
HUMAN_BODY_HEAD = (
    "## Customer Data Access Violation\n"
    "\n"
    "### Report Overview:\n"
    "**Period:** {start_local} - {end_local}\n"
    "**User:** {user}\n"
    "**Violations Count:** {count}\n"
    "\n"
    "### Action Required\n"
    "Please provide justification for each violation in the table below.\n"
    "Update the justification field and save this ticket.\n"
    "\n"
    "### Violations Summary\n"
    "\n"
    "| Date | Event | Resource | Resource Details | Justification |\n"
    "|------|-------|----------|------------------|---------------|"
)
HUMAN_ROW = "\n| {date} | {event} | {resource} | {details} | **<Provide your justification here>** |"
HUMAN_MORE_ROWS = (
    "\n\n**Note:** Table shows first 20 violations. {extra} additional violations are available "
    "in the attached JSON report.\n"
)
HUMAN_REQUESTS_HEAD = "\n\n### User Requests\n"
HUMAN_REQUEST = (
    "\n#### Request {i}:\n"
    "**Jira Issue ID:** {jira}\n"
    "**Justification:** {why}\n"
    "**Request Timestamp:** {at}\n"
    "**Duration (minutes):** {minutes}\n"
)
HUMAN_BODY_FOOT = "\n### Note\nFull violation report and evidence are attached to this ticket."
NON_HUMAN_BODY = (
    "## Customer Data Access Violation - Service or Unknown Actor\n"
    "\n"
    "### Report Overview:\n"
    "* **Generated At:** {generated}\n"
    "* **Period:** {start} - {end}\n"
    "* **Local Period:** {start_local} - {end_local}\n"
    "\n"
    "### Non-Human Violations Summary:\n"
    "* **Total Count:** {total}\n"
    "\n"
    "#### By Category:\n"
    "{categories}\n"
    "\n"
    "### Note:\n"
    "See attached report for detailed violation information.\n"
)

# --- FIXED VALUES: audit evidence -------------------------------------------
EVIDENCE_COLUMNS = ["family", "control", "source_type", "link", "status", "doc_type"]
REQUIRED_EVIDENCE_COLUMNS = ["family", "source_type", "link", "status"]
EVIDENCE_STATUSES = ["ready", "needs_manual_fetch"]
DOC_TYPES = ["evidence", "documentation", "none"]
CONTROL_HEADING = r"^## ([A-Z]+-\d+) "
DOTTED_FAMILY = r"^([AC]\.\d+)"
REQUIREMENT_PLACEHOLDER = "[FILL IN REQUIREMENT TEXT]"
WORD_PLACEHOLDER = ("[Word document: ", " - convert manually and replace this file]\n")
WIKI_MARKS = ["atlassian.net", "confluence"]
REVIEW_DATE = r"Last reviewed:\*\* (\d{4}-\d{2}-\d{2})"
SCORE_BANDS = [("adequate", 8, 10), ("partial", 4, 7), ("significant", 0, 3)]
REVIEW_SCORES = (4, 7)

# --- FIXED VALUES: alarm periods --------------------------------------------
ALARM_PERIOD_SECONDS = 300
ALARM_PERIODS = 2

# --- FIXED VALUES: secrets and identifiers that must not be published --------
# (rule, pattern, texts of which a document needs one for the pattern to match)
SENSITIVE_PATTERNS = [
    ("account_id", r"\b[0-9]{12}\b", []),
    ("account_arn", r"arn:aws:[a-z0-9-]+:[a-z0-9-]*:[0-9]{12}:[A-Za-z0-9/_.:-]+", ["arn:aws:"]),
    ("access_key", r"\bAKIA[0-9A-Z]{16}\b", ["AKIA"]),
    ("credential", r"(?i)\b(?:password|passwd|secret|api_key|token)\s*[=:]\s*[\"'][^\"'\s]+[\"']", ["\"", "'"]),
    ("internal_host", r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:internal|corp)\b(?:\.[a-z]+)*", [".internal", ".corp"]),
    ("private_ip", r"\b(?:10\.[0-9]{1,3}|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.[0-9]{1,3}\.[0-9]{1,3}\b", ["10.", "192.168.", "172."]),
    ("channel_id", r"\b[CT]0[0-9A-Z]{7,9}\b", ["C0", "T0"]),
    ("ticket_key", r"\b[A-Z][A-Z0-9]+-[0-9]+\b", ["-"]),
    ("sso_url", r"https?://(?:sso|idp|login)\.[a-z0-9.-]+", ["://"]),
    ("service_email", r"\bsvc-[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]{2,}\b", ["svc-"]),
    ("bucket_name", r"\b[a-z0-9]+-(?:prod|dev|stage)-[a-z0-9-]+\b", ["-prod-", "-dev-", "-stage-"]),
    ("internal_path", r"#\s*from\s+[a-z0-9_-]+/[A-Za-z0-9_./-]+", ["#"]),
]
SENSITIVE_ALLOWED = [
    r"\$\{[A-Z0-9_]+\}",
    r"example\.com",
    r"your-bucket-name",
    r"<[A-Z_]+>",
    r"[a-z0-9-]+\.amazonaws\.com",
]
