"""Fixed values.

These lists, thresholds and tables must equal the behaviour being rebuilt
for results to match; they are stated here once, in natural order, and
every operator reads them from this module.
"""

# ---------------------------------------------------------------- fixed values
# Indicator types and enumerations.
IOC_TYPES = ["ip", "domain", "url", "hash", "network"]
SEVERITIES = ["low", "medium", "high", "critical"]          # enum order
LIFECYCLE_STATES = ["new", "under_analysis", "confirmed_malicious", "false_positive", "mitigated"]
INPUT_STATUSES = ["pending", "processing", "processed", "failed"]

# Risk bands: critical >= 0.9, high [0.7, 0.9), medium [0.4, 0.7), low < 0.4.
BAND_CRITICAL = 0.9
BAND_HIGH = 0.7
BAND_MEDIUM = 0.4

# Alert rules: (name, type, minimum risk, severity, message).
ALERT_RULES = [
    ("High Risk IP Alert", "ip", 0.7, "high", "High-risk IP address detected"),
    ("Malicious Domain Alert", "domain", 0.8, "critical", "Malicious domain detected"),
    ("Suspicious Hash Alert", "hash", 0.6, "medium", "Suspicious file hash detected"),
]

# Burst detection: high risk > 0.7, gap 30 minutes, >= 3 rows kept,
# >= 5 rows needed, severity high when >= 5 high-risk rows.
BURST_RISK = 0.7
BURST_GAP_MINUTES = 30
BURST_MIN_ROWS = 3
BURST_MIN_INPUT = 5
BURST_HIGH_SEVERITY = 5

# Repeats: > 3 sightings; suspicious if mean gap < 24 h and std < 12 h.
REPEAT_MIN_COUNT = 3
REPEAT_MEAN_HOURS = 24
REPEAT_STD_HOURS = 12

# Lateral movement: >= 3 alerts and >= 2 types per hour; high if >= 3 types.
LATERAL_MIN_ALERTS = 3
LATERAL_MIN_TYPES = 2
LATERAL_HIGH_TYPES = 3

# Hourly anomalies: >= 10 rows, >= 24 hourly buckets, count > mean + 2 std,
# severity high above mean + 3 std.
ANOMALY_MIN_ROWS = 10
ANOMALY_MIN_BUCKETS = 24
ANOMALY_SIGMA = 2
ANOMALY_HIGH_SIGMA = 3

# Clusters: n >= 10, k = min(5, n // 2), size >= 2, campaign if size > 10 and
# average risk > 0.7; campaign risk level high above 0.8.
CLUSTER_MIN_ROWS = 10
CLUSTER_MAX_K = 5
CLUSTER_MIN_SIZE = 2
CLUSTER_CAMPAIGN_SIZE = 10
CLUSTER_CAMPAIGN_RISK = 0.7
CAMPAIGN_HIGH_RISK = 0.8
CLUSTER_TYPE_CODES = {"ip": 0, "domain": 1, "url": 2, "hash": 3, "network": 4}

# Connected components: size >= 3; campaign if > 1 type and average > 0.6.
COMPONENT_MIN_SIZE = 3
COMPONENT_CAMPAIGN_RISK = 0.6

# Implicit edges.
EDGE_SAME_SOURCE = ("same_source", 0.6)
EDGE_SHARED_ENRICHMENT = ("shared_enrichment", 0.7)
SHARED_ENRICHMENT_KINDS = ["resolved_ip", "asn", "country"]
AI_PAIR_CONFIDENCE = 0.8

# Cross-source boost: +0.1 per other source, at most +0.3, total capped at 1.
BOOST_PER_SOURCE = 0.1
BOOST_MAX = 0.3

# Account statistics: high risk > 0.7.
ACCOUNT_HIGH_RISK = 0.7

# Enrichment risk: detection ratio weight 0.8, reputation cap 0.5, high-risk
# countries +0.2.
DETECTION_WEIGHT = 0.8
REPUTATION_CAP = 0.5
HIGH_RISK_COUNTRIES = ["RU", "CN", "IR", "KP"]
COUNTRY_BONUS = 0.2

# Fallback score from the text of an indicator.
FALLBACK_URL_WORDS = ["admin", "login", "password", "bank", "paypal", "secure"]
FALLBACK_DOMAIN_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz"]
FALLBACK_CAP = 0.8

# Domain features.
DOMAIN_COMMON_TLDS = ["com", "org", "net", "edu", "gov", "mil", "io", "co", "uk", "de",
                      "fr", "jp", "cn", "ca", "au", "in", "br", "ru", "it", "es", "nl"]
NEW_TLDS = ["xyz", "top", "site", "online", "tech", "shop", "club", "app", "dev", "ai"]
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "pw", "cc", "review", "bid", "win"]
DOMAIN_WORDS = ["login", "secure", "verify", "account", "banking", "payment",
                "free", "gift", "bonus", "win", "prize", "click", "download"]
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
VOWELS = "aeiou"

# URL features.
URL_COMMON_TLDS = ["com", "org", "net", "edu", "gov", "mil", "io", "co", "uk", "de", "fr", "jp"]
URL_KEYWORDS = [
    "login", "secure", "verify", "account", "bank", "payment", "update", "download",
    "confirm", "validate", "signin", "signon", "password", "credit", "card", "social",
    "security", "alert", "warning", "urgent", "immediate", "action", "required",
    "phish", "hack", "malware", "virus", "trojan", "spyware", "ransomware",
    "cgi-bin", "wp-admin", "administrator", "admin", "cmd", "exec", "shell",
]
SHORTENERS = ["bit.ly", "tinyurl", "goo.gl", "ow.ly", "t.co", "is.gd", "buff.ly", "adf.ly"]
EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".bat", ".cmd", ".js", ".vbs", ".scr", ".pif", ".com"]
QUERY_WORDS = ["cmd", "exec", "shell", "php", "asp", "jsp", "upload", "download", "config"]
SYMBOL_COMBOS = ["//", "..", "./", "/.", "\\"]
TRAVERSAL_PATTERNS = ["../", "..\\", "./../"]
MALICIOUS_PATHS = ["/cgi-bin/", "/wp-admin/", "/administrator/", "/phpmyadmin/", "/backup/"]

# IPv4 features.
IP_SUSPICIOUS_ENDS = [1, 254, 100, 200, 66, 88, 99]
IP_BOUNDARY_ENDS = [0, 255, 1, 254]
IP_TEST_NETS = [(192, 0, 2), (198, 51, 100), (203, 0, 113)]

# Network text -> flow defaults: base (packets, bytes, duration, connections, failed).
NET_BASE = {"packet_count": 100, "bytes_transferred": 50000, "duration_seconds": 30.0,
            "connection_count": 5, "failed_connections": 0}
NET_EPS = 0.001

# Hash risk levels.
HASH_LOW = 0.3
HASH_MEDIUM = 0.6

# Feed type mapping (exact feed type -> indicator type; others lower-cased).
FEED_TYPE_MAP = {
    "IPv4": "ip", "IPv6": "ip", "domain": "domain", "hostname": "domain",
    "URL": "url", "URI": "url",
    "FileHash-MD5": "hash", "FileHash-SHA1": "hash", "FileHash-SHA256": "hash",
}

# Explanation weights per feature, and descriptions.
EXPLAIN_WEIGHTS = {
    "risk_score": 0.3, "enrichment_count": 0.2, "alert_count": 0.15,
    "days_since_first_seen": 0.1, "days_since_last_seen": 0.1,
    "source_score": 0.1, "ioc_type_encoded": 0.05,
}
CONFIDENCE_CUTS = [0.9, 0.8, 0.7, 0.6, 0.5]

# Lifecycle transitions (from -> allowed next states); no state -> new.
TRANSITIONS = {
    "new": ["under_analysis", "confirmed_malicious", "false_positive"],
    "under_analysis": ["confirmed_malicious", "false_positive", "new"],
    "confirmed_malicious": ["mitigated"],
    "false_positive": ["new"],
    "mitigated": [],
}
# Input status by lifecycle state.
STATE_TO_STATUS = {"new": "pending", "under_analysis": "processed", "confirmed_malicious": "processed",
                   "false_positive": "processed", "mitigated": "processed"}
# ------------------------------------------------------------ end fixed values

# Days of indicators and relations that the graph takes in.
LOOK_BACK_DAYS = 30
