"""Fixed values that results depend on."""

from __future__ import annotations

#: Question words that carry no retrieval signal.
STOPWORDS = [
    "a", "about", "an", "and", "are", "as", "at", "be", "between", "but", "by", "called", "can", "code", "define", "defined", "definition", "did",
    "do", "does", "for", "from", "get", "give", "handle", "handled", "handles", "has", "have", "how", "i", "if", "implement", "implemented", "in",
    "into", "is", "it", "its", "me", "of", "on", "one", "or", "s", "same", "single", "so", "that", "the", "their", "them", "then", "there", "these",
    "this", "to", "turned", "up", "use", "used", "uses", "using", "was", "what", "when", "where", "which", "who", "why", "will", "with", "within",
    "work", "works", "would", "you", "your",
]

#: Languages that count as code.
CODE_LANGUAGES = [
    "python", "javascript", "typescript", "go", "java", "ruby", "rust", "c", "cpp", "csharp", "php", "swift", "kotlin", "scala", "shell", "sql",
]

#: Directories that are never walked.
IGNORED_DIRS = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox",
    "site-packages", "dist", "build", "target", "vendor", ".next", ".nuxt", ".idea", ".vscode", "coverage", "htmlcov", ".egg-info",
]
#: Ends of names of files that are skipped.
IGNORED_SUFFIXES = [
    ".lock", ".map", ".min.js", ".min.css", ".pyc", ".pyo", ".so", ".dylib", ".dll", ".a", ".o", ".class", ".jar", ".zip", ".tar", ".gz", ".bz2",
    ".xz", ".7z", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".mov", ".avi", ".woff", ".woff2", ".ttf",
    ".eot", ".db", ".sqlite", ".sqlite3", ".bin", ".pkl", ".npy", ".pt", ".onnx", ".safetensors",
]
#: Names of files that are skipped.
IGNORED_NAMES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock", "composer.lock", "Gemfile.lock",
]
#: The language of a file by its extension.
LANGUAGE_OF = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".go": "go",
    ".java": "java",
    ".rb": "ruby",
    ".rs": "rust",
    ".c": "c", ".h": "c",
    ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".sql": "sql",
    ".md": "markdown", ".mdx": "markdown",
    ".rst": "restructuredtext",
    ".txt": "text",
    ".json": "json",
    ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini", ".cfg": "ini",
    ".html": "html",
    ".css": "css", ".scss": "css",
}
#: The largest file that is read, and the bytes that are searched for a NUL.
MAX_FILE_BYTES, SNIFF_BYTES = 1_000_000, 8192

#: Lexical index, column weights and the ranking function's parameters.
FIELD_WEIGHTS = {"path": 2.0, "symbol": 5.0, "content": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

#: Fusion and assembly.
RRF_K, SEMANTIC_WEIGHT, LEXICAL_WEIGHT, CODE_WEIGHT, PROSE_WEIGHT = 60, 1.0, 2.0, 1.0, 1.0
CANDIDATE_K, MAX_PER_FILE, TOP_K = 40, 2, 5
REFUSAL = "INSUFFICIENT_CONTEXT"

#: Accented letters that the lexical index folds.
ACCENTED, PLAIN = "äçèéêíñóöü", "aceeeinoou"

#: Follow-up questions, words at the start, and words that refer back.
OPENERS = r"(?i)^\s*(and|but|so|what about|how about|why|ok|okay|then|also)\b"
REFERENCES = r"(?i)\b(it|its|it's|that|this|these|those|there|then|they|them|their|he|she|same|above|previous|instead|also|too|as well)\b"
#: Addresses of repositories and people, and how much of a conversation is shown.
REPO_URL = r"^https://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
HISTORY_TURNS, HISTORY_CHARS, TURN_CHARS = 6, 2400, 600
