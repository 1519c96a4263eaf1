"""Fixed values.

Everything in this file is a value that results depend on (identifiers, regular
expressions, word lists, lookup tables, thresholds).  They are stated plainly and in
natural order; no logic lives here.
"""

# --------------------------------------------------------------------------- fixed values
# Top-10 categories plus the general bucket: (category_id, name)
CATEGORY_EDITION = "2021"
CATEGORIES = [
    ("A01", "Broken Access Control"),
    ("A02", "Cryptographic Failures"),
    ("A03", "Injection"),
    ("A04", "Insecure Design"),
    ("A05", "Security Misconfiguration"),
    ("A06", "Vulnerable and Outdated Components"),
    ("A07", "Identification and Authentication Failures"),
    ("A08", "Software and Data Integrity Failures"),
    ("A09", "Security Logging and Monitoring Failures"),
    ("A10", "Server-Side Request Forgery"),
    ("GEN", "General Security Issues"),
]

# --------------------------------------------------------------------------- fixed values
# Severities: (severity, score)
SEVERITIES = [("critical", 4), ("high", 3), ("medium", 2), ("low", 1)]
CONFIDENCES = ["low", "medium", "high"]
UNKNOWN_SEVERITY_SCORE = 1
EXECUTION_STATUSES = ["success", "failed", "skipped", "timeout", "error"]
RULE_TYPES = ["regex", "ast", "semantic", "hybrid"]

# --------------------------------------------------------------------------- fixed values
# Built-in rules: (rule_id, title, severity, confidence, owasp_category, pattern_id)
RULES = [
    ("PY001", "Potential SQL Injection", "critical", "high", "A03", "A03_001"),
    ("PY002", "Command Injection Risk", "critical", "high", "A03", "A03_002"),
    ("PY003", "Hardcoded Secrets", "critical", "medium", "A02", "A02_001"),
    ("PY004", "Weak Cryptography", "high", "high", "A02", "A02_002"),
    ("PY005", "Insecure Deserialization", "critical", "high", "A08", "A08_001"),
    ("PY006", "Debug Mode Enabled", "high", "high", "A05", "A05_001"),
    ("PY007", "Server-Side Request Forgery Risk", "high", "medium", "A10", "A10_001"),
    ("PY008", "Sensitive Data in Logs", "medium", "low", "A09", "A09_001"),
    ("PY009", "Weak Authentication", "medium", "low", "A07", "A07_001"),
    ("PY010", "Authentication Bypass", "critical", "high", "A07", "A07_001"),
    ("PY011", "Weak Session Management", "medium", "medium", "A07", "A07_001"),
    ("PY012", "Path Traversal Risk", "high", "medium", "A01", "A01_001"),
    ("PY013", "Potential XSS Vulnerability", "high", "low", "A03", "A03_001"),
    ("PY014", "Exception Information Disclosure", "medium", "medium", "A05", "A09_001"),
    ("PY015", "Sensitive Data in Debug Output", "medium", "low", "A09", "A09_001"),
]
WEAK_RANDOM_TITLE = "Weak Random Number Generation"

# --------------------------------------------------------------------------- fixed values
# Regular expressions of the regex rules, in match order.
RULE_REGEXES = {
    "PY003": [
        r'(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*["\'][a-zA-Z0-9+/=]{16,}["\']',
        r'(?i)(mysql|postgres|mongodb)://[^:\s]+:[^@\s]+@',
        r'(?i)AKIA[0-9A-Z]{16}',
        r'-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----',
        r'(?i)(password|passwd|pwd)\s*[=:]\s*["\'][^"\']{8,}["\']',
        r'eyJ[a-zA-Z0-9+/=]+\.eyJ[a-zA-Z0-9+/=]+\.[a-zA-Z0-9+/=]+',
    ],
    "PY006": [
        r'(?i)DEBUG\s*=\s*True',
        r'(?i)app\.debug\s*=\s*True',
        r'(?i)app\.run\([^)]*debug\s*=\s*True',
        r'(?i)debug\s*[=:]\s*True',
        r'(?i)verbose\s*[=:]\s*True',
    ],
    "PY007": [
        r'requests\.(get|post|put|delete|patch)\s*\([^)]*["\']?\s*\+',
        r'urllib\.request\.urlopen\s*\([^)]*["\']?\s*\+',
        r'httplib\.(HTTPConnection|HTTPSConnection)\s*\([^)]*["\']?\s*\+',
    ],
    "PY008": [
        r'(?i)log[^(]*\([^)]*(?:password|token|secret|key)[^)]*\)',
        r'(?i)print\([^)]*(?:password|token|secret|key)[^)]*\)',
    ],
    "PY009": [
        r'(?i)if\s+password\s*==\s*["\'][^"\']*["\']',
        r'(?i)user\s*==\s*["\']admin["\']',
        r'(?i)password\s*in\s*\[["\'][^"\']*["\']',
    ],
}

# --------------------------------------------------------------------------- fixed values
# Requirements-file audit, matched without regard to case.
DEPENDENCY_REGEXES = [
    r'django\s*[<>=]*\s*[12]\.',
    r'flask\s*[<>=]*\s*0\.',
    r'requests\s*[<>=]*\s*2\.[0-5]\.',
]
REQUIREMENTS_FILE = "requirements.txt"

# --------------------------------------------------------------------------- fixed values
# Catalogue: pattern_id -> (name, severity, confidence, cwe_ids, languages, tags)
PATTERNS = {
    "A01_001": ("Insecure Direct Object Reference", "high", "medium", [22, 285, 639],
                ["java", "javascript", "php", "python"],
                ["authorization", "file_access", "path_traversal"]),
    "A01_002": ("Missing Function Level Authorization", "high", "low", [285, 862],
                ["java", "javascript", "php", "python"],
                ["access_control", "authorization", "function_level"]),
    "A02_001": ("Hardcoded Secrets", "critical", "medium", [798, 321, 256],
                ["csharp", "go", "java", "javascript", "php", "python"],
                ["credentials", "hardcoded", "secrets"]),
    "A02_002": ("Weak Cryptographic Algorithms", "high", "high", [327, 328, 916],
                ["csharp", "java", "javascript", "php", "python"],
                ["cryptography", "hashing", "weak_algorithms"]),
    "A03_001": ("SQL Injection", "critical", "high", [89, 564],
                ["csharp", "java", "javascript", "php", "python"],
                ["database", "injection", "sql_injection"]),
    "A03_002": ("Command Injection", "critical", "high", [78, 77],
                ["java", "javascript", "php", "python"],
                ["command_injection", "injection", "system_calls"]),
    "A04_001": ("Missing Rate Limiting", "medium", "low", [770, 799],
                ["java", "javascript", "php", "python"],
                ["authentication", "design", "rate_limiting"]),
    "A05_001": ("Debug Mode Enabled", "high", "high", [489, 489],
                ["java", "javascript", "php", "python"],
                ["configuration", "debug_mode", "production"]),
    "A06_001": ("Potentially Vulnerable Dependencies", "medium", "low", [1104, 937],
                ["java", "javascript", "php", "python"],
                ["dependencies", "outdated", "vulnerabilities"]),
    "A07_001": ("Weak Authentication Implementation", "high", "medium", [287, 306, 620],
                ["java", "javascript", "php", "python"],
                ["authentication", "session", "weak_auth"]),
    "A08_001": ("Insecure Deserialization", "critical", "high", [502, 915],
                ["java", "javascript", "php", "python"],
                ["deserialization", "pickle", "unsafe_eval"]),
    "A09_001": ("Sensitive Data in Logs", "medium", "medium", [532, 117],
                ["java", "javascript", "php", "python"],
                ["information_disclosure", "logging", "sensitive_data"]),
    "A10_001": ("Server-Side Request Forgery", "high", "medium", [918, 79],
                ["java", "javascript", "php", "python"],
                ["http_requests", "ssrf", "url_validation"]),
}

# --------------------------------------------------------------------------- fixed values
# Catalogue regular expressions, in match order.
PATTERN_REGEXES = {
    "A01_001": [
        r'open\s*\(\s*["\']?[^"\']*\+[^"\']*["\']?\s*\)',
        r'file\s*\(\s*["\']?[^"\']*\+[^"\']*["\']?\s*\)',
        r'\/[^\/\s]*\{[^}]*\}[^\/\s]*\/.*\.(txt|log|conf|xml)',
    ],
    "A01_002": [
        r'@app\.route\([^)]*\)\s*\n\s*def\s+\w+\([^)]*\):\s*\n(?!\s*@)',
        r'def\s+(admin|delete|modify|update)\w*\([^)]*\):\s*\n(?!\s*@\w*auth)',
        r'function\s+(admin|delete|modify|update)\w*\([^)]*\)\s*{(?!.*auth)',
    ],
    "A02_001": [
        r'(?i)(api[_-]?key|secret|password|pwd|token)\s*[=:]\s*["\'][a-zA-Z0-9+/=]{16,}["\']',
        r'(?i)AKIA[0-9A-Z]{16}',
        r'-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----',
        r'(?i)(mysql|postgres|mongodb)://[^:\s]+:[^@\s]+@',
        r'eyJ[a-zA-Z0-9+/=]+\.eyJ[a-zA-Z0-9+/=]+\.[a-zA-Z0-9+/=]+',
    ],
    "A02_002": [
        r'(?i)hashlib\.(md5|sha1)\(',
        r'(?i)(des|3des|rc4|md4|md5|sha1)[\s\(]',
        r'(?i)Cipher\.(DES|RC4|ARC4)',
        r'(?i)(MD5|SHA1)\.Create\(\)',
        r'(?i)random\.(random|randint|choice)\(',
    ],
    "A03_001": [
        r'(?i)(select|insert|update|delete)\s+.*\+.*\s*(from|into|set|where)',
        r'(?i)execute\s*\(\s*["\'][^"\']*\+[^"\']*["\']',
        r'(?i)query\s*\(\s*["\'][^"\']*\%s[^"\']*["\']',
        r'(?i)(select|insert|update|delete).*\{[^}]*\}',
        r'(?i)cursor\.execute\s*\([^)]*\+[^)]*\)',
    ],
    "A03_002": [
        r'(?i)(os\.system|subprocess\.(call|run|Popen))\s*\([^)]*\+[^)]*\)',
        r'(?i)(exec|eval|system)\s*\([^)]*\+[^)]*\)',
        r'(?i)shell=True.*\+',
        r'(?i)(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\([^)]*\+[^)]*\)',
    ],
    "A04_001": [
        r'@app\.route\([^)]*\)\s*\n\s*def\s+(login|register|reset_password|send_email)',
        r'def\s+(login|authenticate|send_sms|verify)\w*\([^)]*\):\s*\n(?!.*rate_limit)',
        r'function\s+(login|register|forgot)\w*\([^)]*\)\s*{(?!.*rate.*limit)',
    ],
    "A05_001": [
        r'(?i)DEBUG\s*=\s*True',
        r'(?i)app\.debug\s*=\s*True',
        r'(?i)app\.run\([^)]*debug\s*=\s*True',
        r'(?i)development\s*=\s*true',
        r'(?i)console\.log\s*\(',
    ],
    "A06_001": [
        r'(?i)django\s*[<>=]*\s*[12]\.',
        r'(?i)flask\s*[<>=]*\s*0\.',
        r'(?i)requests\s*[<>=]*\s*2\.[0-5]\.',
        r'(?i)jquery\s*[<>=]*\s*[12]\.',
        r'(?i)spring.*[<>=]*\s*[34]\.',
    ],
    "A07_001": [
        r'(?i)if\s+password\s*==\s*["\'][^"\']*["\']',
        r'(?i)user\s*==\s*["\']admin["\']',
        r'(?i)password\s*in\s*\[["\'][^"\']*["\']',
        r'(?i)auth\s*=\s*(True|False)',
        r'(?i)session\[\s*["\']user["\']?\s*\]\s*=',
    ],
    "A08_001": [
        r'(?i)pickle\.(loads?|load)\s*\(',
        r'(?i)yaml\.load\s*\(',
        r'(?i)eval\s*\(',
        r'(?i)exec\s*\(',
        r'(?i)unserialize\s*\(',
        r'(?i)JSON\.parse\s*\([^)]*user',
    ],
    "A09_001": [
        r'(?i)log[^(]*\([^)]*(?:password|token|secret|key|ssn|credit)[^)]*\)',
        r'(?i)print\s*\([^)]*(?:password|token|secret|key)[^)]*\)',
        r'(?i)console\.log\([^)]*(?:password|token|secret)[^)]*\)',
        r'(?i)logger\.[^(]*\([^)]*(?:password|token|secret)[^)]*\)',
    ],
    "A10_001": [
        r'(?i)requests\.(get|post|put|delete|patch)\s*\([^)]*\+[^)]*\)',
        r'(?i)urllib\.request\.urlopen\s*\([^)]*\+[^)]*\)',
        r'(?i)fetch\s*\([^)]*\+[^)]*\)',
        r'(?i)http[s]?://.*\{[^}]*\}',
        r'(?i)(curl|wget)\s+.*\$\{?[^}]*\}?',
    ],
}

# --------------------------------------------------------------------------- fixed values
# Word lists of the structural rules.
SQL_CALL_ATTRS = ["execute", "executemany", "format"]
SQL_CALL_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE"]
SQL_CONCAT_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "JOIN"]
SQL_FORMAT_MARKERS = ["%s", "{}", "{", "format("]
COMMAND_FUNCTIONS = [
    "os.system", "os.popen", "os.execl", "os.execle", "os.execlp",
    "os.execv", "os.execve", "os.execvp", "os.spawn*",
    "subprocess.call", "subprocess.run", "subprocess.Popen",
    "commands.getoutput", "commands.getstatusoutput",
]
WEAK_ALGORITHMS = ["md5", "sha1", "des", "3des", "rc4", "md4"]
WEAK_RANDOM_FUNCTIONS = ["random.random", "random.randint", "random.choice"]
DESERIALIZERS = [
    "pickle.loads", "pickle.load", "cPickle.loads", "cPickle.load",
    "yaml.load", "eval", "exec", "compile",
]
PATH_FUNCTIONS = ["open", "os.path.join", "pathlib.Path"]
USER_NAME_WORDS = ["user", "input", "request", "param"]
USER_ATTRIBUTE_WORDS = ["request", "form", "args", "json"]
RENDER_WORD = "render"
UNESCAPED_KEYWORD_WORD = "safe"
DISCLOSING_CALLS = ["print", "return", "render"]
SENSITIVE_WORDS = ["password", "token", "secret", "key", "auth"]
RISKY_IMPORTS = ["subprocess", "os", "pickle", "eval", "exec"]
MAX_FUNCTION_COMPLEXITY = 15

# --------------------------------------------------------------------------- fixed values
# Extension -> language
EXTENSION_LANGUAGES = {
    ".py": "python", ".pyw": "python",
    ".php": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".phtml": "php",
    ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".pl": "perl", ".pm": "perl",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".fish": "shell",
    ".ps1": "powershell", ".sql": "sql",
}
ANALYZER_EXTENSIONS = {"python": [".py", ".pyw"]}
TEXT_EXTENSIONS = [
    ".py", ".pyw", ".php", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".cpp", ".cc",
    ".cxx", ".h", ".hpp", ".cs", ".go", ".rs", ".rb", ".pl", ".pm", ".sh", ".bash",
    ".zsh", ".fish", ".ps1", ".sql", ".html", ".htm", ".xml", ".json", ".yaml", ".yml",
    ".toml", ".ini", ".cfg", ".conf", ".txt", ".md", ".rst",
]
BINARY_EXTENSIONS = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".obj", ".pyc", ".pyo", ".class", ".jar",
    ".war", ".ear", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".pdf", ".doc", ".docx",
    ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg",
    ".ico", ".mp3", ".mp4", ".avi", ".mov", ".mkv", ".wmv", ".ttf", ".otf", ".woff",
    ".woff2",
]
HASH_COMMENT_LANGUAGES = ["shell"]
SLASH_COMMENT_LANGUAGES = ["javascript", "java", "c", "cpp", "csharp", "go"]

# --------------------------------------------------------------------------- fixed values
# Scan defaults
DEFAULT_OPTIONS = {
    "analysis": {"min_severity": "medium", "include_tests": False,
                 "max_file_size_mb": None},
    "exclusions": {
        "patterns": ["*.pyc", "__pycache__/*", ".git/*", ".svn/*", "node_modules/*",
                     "venv/*", "env/*", ".env/*", "dist/*", "build/*"],
        "test_patterns": ["test_*.py", "*_test.py", "tests/*", "spec/*"],
    },
    "languages": {"python": {"enabled": True}},
}
MIN_PRINTABLE_RATIO = 0.75
MAX_RULE_ID_LENGTH = 50
UNREADABLE_FILE_ERROR = "Could not read file content"
HIGHLIGHT_OPEN = '<mark class="vulnerability-highlight">'
HIGHLIGHT_CLOSE = "</mark>"
