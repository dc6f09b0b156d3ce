"""Patterns, word lists and tables whose values decide results.

Word characters are written [\\p{L}\\p{N}_] and digits [0-9], so that Java, RE2 and Python agree.
"""

W = r"[\p{L}\p{N}_]"
WORD = W + "+"
#: Separators of lexical tokens; tokens have two characters at least.
TOKEN_BREAK = r"""[\s\.,;:!?()\[\]{}'"<>/\\|@#$%^&*+=`~-]+"""
#: The tokens between them, for Python.
LEXICAL_TOKEN = "[^" + TOKEN_BREAK[1:-2] + "]{2,}"
FILE = r"[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]{2,4}"
STEP = r"(?i)\bstep\s+[0-9]+\b"
#: Full matches of single words.
ALL_CAPS, NUMBER, ERROR_NAME = r"^[A-Z][A-Z_]{2,}$", r"^[0-9]{2,}$", r"^[A-Z][a-zA-Z]+(?:Error|Exception)$"
KEY_TOKEN = r"^(?:[0-9]+|[A-Z][a-z]+|[A-Z]{2,})$"
#: Tokens that always are anchors (full matches).
TIER_ONE = [r"^[0-9]+$", r"^[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]{2,4}$", r"^[A-Z][A-Z_]{2,}$", r"^[A-Z][a-z]+Error$", r"(?i)^step\s*[0-9]+$"]
ANCHOR_TOKEN = r"[a-zA-Z0-9_/.\-]+"
STOPWORDS = """the a an is was were be been being have has had do does did will would could should may might shall can to of in
for on with at by from as and but or not this that these those it its which who what when where how why all each every any some no
nor so yet both either neither one two after before during then than if because since while though although also just up down out
about into through over under their there they we you i he she his her our my your step action observation""".split()

#: Fact schemas: type, whether required, fact, pattern (case ignored).
SCHEMAS = [
    ("tool_call", True, "tool_name", r"[a-zA-Z_][\p{L}\p{N}_]*\s*\("),
    ("tool_call", True, "result", r"returned|output|result|response"),
    ("tool_call", False, "duration", r"[0-9]+\s*(ms|s|seconds)"),
    ("tool_call", False, "status", r"success|fail|error|ok"),
    ("error", True, "error_type", r"[A-Z][a-zA-Z]+Error|[A-Z][a-zA-Z]+Exception|HTTP\s+[45][0-9][0-9]"),
    ("error", True, "location", r"[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]{2,4}|line\s+[0-9]+|at\s+[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+"),
    ("error", False, "line_number", r"line\s+[0-9]+|:[0-9]+"),
    ("error", False, "variable_name", r"'[a-zA-Z_][\p{L}\p{N}_]*'|\"[a-zA-Z_][\p{L}\p{N}_]*\""),
    ("test_result", True, "failure_count", r"[0-9]+\s*(tests?\s+)?(fail|pass|error)"),
    ("test_result", True, "test_file", r"[\p{L}\p{N}_./\-]*(test|spec)[\p{L}\p{N}_./\-]*\.[\p{L}\p{N}_]+"),
    ("test_result", False, "assertion_count", r"[0-9]+\s*assertion"),
    ("test_result", False, "duration", r"[0-9]+\s*(ms|s|seconds)"),
    ("migration_failure", True, "timing", r"[0-9]+\s*(s|ms|seconds|minutes|min)"),
    ("migration_failure", True, "table_name", r"[\p{L}\p{N}_]+_table|[\p{L}\p{N}_]+s\s+table|table\s+[\p{L}\p{N}_]+"),
    ("migration_failure", True, "error_type", r"timeout|deadlock|lock|constraint|foreign\s+key"),
    ("migration_failure", False, "connection_count", r"[0-9]+\s*(concurrent\s+)?connections"),
    ("migration_failure", False, "rollback", r"roll.?back|revert"),
    ("deployment", True, "environment", r"staging|production|prod\b|dev\b|k8s|kubernetes"),
    ("deployment", True, "outcome", r"succeeded|failed|timeout|rolled?\s*back|reverted|rejected"),
    ("deployment", False, "health_check", r"health\s*check|GET\s+/health|HTTP\s+200"),
    ("deployment", False, "error_code", r"HTTP\s+[45][0-9][0-9]|[0-9]{3}\s+[A-Z]+"),
    ("file_modification", True, "file_path", r"[\p{L}\p{N}_./\-]+\.[\p{L}\p{N}_]{2,4}"),
    ("file_modification", True, "action", r"created|modified|deleted|updated|added|removed|renamed"),
    ("file_modification", False, "line_count", r"[0-9]+\s*line"),
    ("file_modification", False, "function", r"def\s+[\p{L}\p{N}_]+|function\s+[\p{L}\p{N}_]+|[\p{L}\p{N}_]+\(\)"),
]
SCHEMA_TYPES = list(dict.fromkeys(s[0] for s in SCHEMAS))

#: Structural artifacts, in order of precedence.
ARTIFACTS = [
    r"\b(?:src|tests|lib|dist|config|app|server|routes|middleware|hooks)/[^\s,;\"']+",
    r"\b(?:[A-Z][A-Z0-9]+_(?:SECRET|KEY|TOKEN|PASSWORD|PASS|CREDENTIAL|AUTH|CERT|API))\b",
    r"(?<![\p{L}\p{N}_])/api/[^\s,;\"']+",
    r"(?<![0-9])(?:4[0-9]{2}|5[0-9]{2})(?![0-9])",
]
#: Query classes.
PRECISION = [r"step\s+[0-9]+", r"at step", r"which step", r"what step", r"error code", r"HTTP\s+[0-9]{3}", r"[0-9]{3}\s+[A-Z]+", r"line\s+[0-9]+", r"port\s+[0-9]+"]
LOOKUP = [FILE, r"[A-Z][A-Z_]{2,}", r"[A-Z][a-z]+Error"]
#: Question types: retrieval depth and route.
POLICY = {"factoid": (1, "hot_cache"), "verification": (2, "hot_cache"), "procedural": (3, "enriched"), "causal": (5, "enriched"), "entity": (3, "hot_cache"), "summary": (8, "enriched"), "unknown": (5, "hot_cache")}
QUESTION_RULES = [
    ("procedural", r"\b(how to|how do|steps?|procedure|process|method|way to)\b"),
    ("causal", r"\b(why|reason|cause|because|due to|result of)\b"),
    ("summary", r"\b(summarize|overview|describe|explain|tell me about)\b"),
    ("factoid", r"\b(what is|what are|define|name of|when did|when was|who is|who was)\b"),
]
VERIFY_ANY, VERIFY_TRUTH = r"\b(is|does|do|can|could|should|would|will|are|was|were)\b", r"\b(true|false|correct|right)\b"
VERIFY_START = r"^(is|does|do|can|could|should) "
POLARITY = [("succeeded", "failed"), ("passed", "failed"), ("passed", "broke"), ("deployed", "reverted"), ("resolved", "persisted"), ("fixed", "regressed"), ("completed", "rolled back"), ("merged", "reverted"), ("healthy", "degraded"), ("succeeded", "rolled back"), ("passing", "failing"), ("working", "broken")]
#: Budgets by content type: floor, sensitivity to the z-score, base of the write path, risk weight.
BUDGETS = {"FACTUAL": (0.75, 0.15, 0.50, 1.0), "CAUSAL": (0.70, 0.20, 0.45, 0.9), "ENTITY": (0.70, 0.15, 0.45, 0.85), "TEMPORAL": (0.55, 0.20, 0.35, 0.75), "CONTRASTIVE": (0.55, 0.20, 0.35, 0.95), "BACKGROUND": (0.20, 1.50, 0.20, 0.5)}
HIGH_VALUE = r"(?i)\b(?:src/|/api/|\.ts|\.py|\.js|error|exception|failed|decided|rejected|must|never|always|critical|jwt|secret|token|key|timeout|retry|port|endpoint)\b"
SECTION_START = r"(?m)^(?:-\s+|\*\s+|[0-9]+\.\s+|#+\s+)"
