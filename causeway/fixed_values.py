"""Values that define results. They are facts of the data model, not logic."""

# Component keywords and their entity types, in matching order.
COMPONENTS = [
    ("redis", "DATABASE"),
    ("postgres", "DATABASE"),
    ("postgresql", "DATABASE"),
    ("mysql", "DATABASE"),
    ("mongodb", "DATABASE"),
    ("kafka", "SYSTEM"),
    ("rabbitmq", "SYSTEM"),
    ("nginx", "COMPONENT"),
    ("payment", "SERVICE"),
    ("checkout", "SERVICE"),
    ("auth", "SERVICE"),
    ("gateway", "COMPONENT"),
    ("api", "API"),
    ("queue", "COMPONENT"),
    ("database", "DATABASE"),
    ("cache", "COMPONENT"),
    ("load balancer", "COMPONENT"),
]

# Error keywords (entity type ERROR), in matching order.
ERRORS = [
    "timeout", "exception", "failure", "failed", "error", "crash", "outage",
    "exhaustion", "retry storm", "5xx", "500", "503", "deadlock", "leak",
]

# Enumerations.
ENTITY_TYPES = ["SERVICE", "ERROR", "COMPONENT", "DATABASE", "API", "EVENT", "SYSTEM"]
RELATION_TYPES = ["CAUSES", "DEPENDS_ON", "RELATED_TO", "CONTAINS", "TRIGGERS"]
DOCUMENT_TYPES = ["LOG", "PDF", "INCIDENT_REPORT", "RUNBOOK", "ARCHITECTURE_DOC", "TEXT"]
STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]

# Regular expressions (Java syntax; (?U) gives Unicode classes).
# \x1c-\x1f count as white space, which (?U)\s alone does not include.
SPACE = r"[\s\x1c-\x1f]"
CONNECTORS = r"(?:caused|leads? to|led to|resulted in|triggered)"
CONNECTOR_WORDS = ["caused", "lead to", "leads to", "led to", "resulted in", "triggered"]
CAUSAL = (
    r"(?iU)([\w\s\x1c-\x1f\-]{3,40}?)" + SPACE + "+" + CONNECTORS + SPACE + "+"
    r"([\w\s\x1c-\x1f\-]{3,40})"
)
# Characters that no match of CAUSAL holds, and the length of its shortest match.
CAUSAL_BREAK = r"[!-,./:-@\[-^`{-~]+"
CAUSAL_LENGTH = 14
LINE_TIMESTAMPS = [
    r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?",
    r"(?U)\b\d{2}:\d{2}:\d{2}\b",
    r"(?U)[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
]
LOG_LEVEL = r"(?U)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"
EVENT_TIMESTAMP = r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\b\d{2}:\d{2}:\d{2}\b"

# Question words that are not keywords.
STOP_WORDS = [
    "why", "did", "the", "a", "an", "is", "are", "was", "were", "fail", "failed",
    "what", "how", "when", "which", "service", "system", "show", "related",
    "incidents", "evidence", "supports", "this",
]

# Substrings that decide severity and the report branch of answers.
SEVERITY_WORDS = ["error", "fail", "timeout"]
REPORT_WORDS = ["root cause", "why", "outage", "fail"]

# Defaults.
CHUNK_WORDS = 400
CHUNK_OVERLAP = 60
EMBEDDING_DIM = 1024
TOP_K = 8
HOPS = 2
MAX_FILE_BYTES = 50 * 1024 * 1024
CAUSAL_CONFIDENCE = 0.55
ADJACENT_CONFIDENCE = 0.4
RESPONSE_CONFIDENCE = 0.7
DAMPING = 0.85
MAX_ROUNDS = 100
TOLERANCE = 1e-6
DEFAULT_QUESTION = "What was the root cause of this incident and how did it unfold?"
