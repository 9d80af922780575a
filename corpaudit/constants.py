"""Values every audit shares.

The tables below are FIXED VALUES: results are only right when they hold
exactly these entries, so they are spelled out once, here, as plain text.
"""

from __future__ import annotations

# --- fixed values: directories, extensions, markers ---------------------------

IGNORED_DIRS = (
    ".git", ".idea", ".mypy_cache", ".next", ".pytest_cache", ".tox", ".venv",
    ".vscode", "__pycache__", "build", "coverage", "dist", "egg-info", "env",
    "node_modules", "target", "vendor", "venv",
)
IGNORED_DIRS_COMPACT = (
    ".git", ".next", ".pytest_cache", ".venv", "__pycache__", "build",
    "coverage", "dist", "node_modules", "target", "vendor", "venv",
)
IGNORED_DIRS_IMPORTS = (
    ".git", ".venv", "__pycache__", "examples", "node_modules", "venv",
)

SOURCE_EXTENSIONS = (
    ".bash", ".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html",
    ".java", ".jl", ".js", ".jsx", ".kt", ".kts", ".lua", ".m", ".mm", ".php",
    ".pl", ".py", ".r", ".rb", ".rs", ".scala", ".scss", ".sh", ".sql",
    ".swift", ".ts", ".tsx", ".vue",
)
SOURCE_EXTENSIONS_COMPACT = (
    ".c", ".cpp", ".go", ".java", ".js", ".py", ".rb", ".rs", ".sh", ".ts",
)
PROSE_EXTENSIONS = (".md", ".txt", ".rst")
PROSE_EXTENSIONS_COMPACT = (".md", ".txt")

BINARY_EXTENSIONS = (
    ".7z", ".a", ".avi", ".bin", ".bmp", ".bz2", ".class", ".db", ".dll",
    ".dylib", ".eot", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg", ".jpg",
    ".mov", ".mp3", ".mp4", ".o", ".pdf", ".png", ".pyc", ".pyo", ".rar", ".so",
    ".sqlite", ".sqlite3", ".tar", ".tgz", ".ttf", ".war", ".wasm", ".webp",
    ".woff", ".woff2", ".xz", ".zip",
)
BINARY_EXTENSIONS_COMPACT = (
    ".db", ".dll", ".exe", ".gif", ".gz", ".jpeg", ".jpg", ".pdf", ".png",
    ".pyc", ".so", ".sqlite", ".sqlite3", ".tar", ".zip",
)

# prefix -> extensions whose line comments start with it
COMMENT_PREFIXES = {
    "#": (".bash", ".php", ".py", ".rb", ".sh", ".yaml", ".yml"),
    "--": (".lua", ".sql"),
    "//": (
        ".c", ".cc", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js",
        ".jsx", ".kt", ".php", ".rs", ".scala", ".swift", ".ts", ".tsx",
    ),
}
MARKERS = ("TODO", "FIXME", "XXX")

# technology -> names that announce it at the repository root, in report order
ROOT_MARKERS = {
    "Python": ("pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile"),
    "Node.js": ("package.json",),
    "Rust": ("Cargo.toml",),
    "Go": ("go.mod",),
    "Java (Maven)": ("pom.xml",),
    "Java (Gradle)": ("build.gradle", "build.gradle.kts"),
    "C/C++": ("CMakeLists.txt", "Makefile"),
}
# technology -> names that announce it anywhere (compared in lower case)
NESTED_MARKERS = {"TypeScript": ("tsconfig.json",), **ROOT_MARKERS}
# technology -> extensions, at least two files together, in report order
EXTENSION_MARKERS = {
    "TypeScript": (".ts", ".tsx"),
    "Python": (".py",),
    "JavaScript": (".js", ".jsx"),
    "Go": (".go",),
    "Rust": (".rs",),
    "Java": (".java",),
    "C/C++": (".c", ".cpp", ".h"),
}
UNKNOWN_TECHNOLOGY = "Unknown / Generic"

README_NAMES = ("README.md", "README.rst", "README.txt", "README")
LICENSE_NAMES = ("LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING")
LICENSE_NAMES_COMPACT = ("LICENSE", "LICENSE.md")
GITIGNORE_NAMES = (".gitignore",)
CI_PATHS = (
    ".circleci/config.yml", ".github/workflows", ".gitlab-ci.yml",
    ".travis.yml", "Jenkinsfile", "azure-pipelines.yml",
)
TEST_DIRS = ("tests", "test")

# manifest -> (ecosystem, lockfiles that count for it)
MANIFESTS = {
    "requirements.txt": ("python", ()),
    "pyproject.toml": ("python", ("poetry.lock", "uv.lock")),
    "package.json": ("node", ("package-lock.json", "yarn.lock", "pnpm-lock.yaml")),
    "Cargo.toml": ("rust", ("Cargo.lock",)),
    "go.mod": ("go", ("go.sum",)),
    "pom.xml": ("java", ()),
}
LOCKED_ECOSYSTEMS = ("node", "python", "rust")

# README section -> words that prove it, in report order
README_SECTIONS = {
    "installation": ("install", "installation", "setup", "getting started"),
    "usage": ("usage", "how to use", "quick start", "example"),
    "features": ("features", "what it does"),
    "configuration": ("configuration", "config", "options", "environment variables"),
    "testing": ("testing", "tests", "how to test"),
    "license": ("license", "licence"),
    "contribution": ("contributing", "contribution"),
    "examples": ("example", "examples", "demo"),
}
REQUIRED_SECTIONS = ("installation", "usage", "license")

# --- fixed values: severities, scores, limits ---------------------------------

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")  # rank = position
PENALTIES = {"CRITICAL": 25, "HIGH": 12, "MEDIUM": 6, "LOW": 2, "INFO": 0}
CATEGORY_DIMENSIONS = {
    "Security": "security",
    "Dependencies": "dependencies",
    "Code Health": "code_health",
    "Documentation": "documentation",
    "Hygiene": "hygiene",
}
DIMENSIONS = tuple(CATEGORY_DIMENSIONS.values())
# decimals as text: sums of them stay exact
WEIGHTS = {
    "security": "0.30",
    "code_health": "0.25",
    "documentation": "0.15",
    "dependencies": "0.15",
    "hygiene": "0.15",
}
WEIGHTS_COMPACT = {"security": "0.4", "code_health": "0.3", "hygiene": "0.3"}

# extension -> (severity, our title); equal titles share one recommendation
RISKY_EXTENSIONS = {
    ".pem": ("HIGH", "PEM key or certificate in the tree"),
    ".key": ("HIGH", "Private key in the tree"),
    ".pfx": ("HIGH", "PFX key bundle in the tree"),
    ".sqlite": ("INFO", "SQLite file in the tree"),
    ".sqlite3": ("INFO", "SQLite file in the tree"),
    ".db": ("INFO", "Database file in the tree"),
    ".bak": ("LOW", "Backup copy in the tree"),
    ".old": ("LOW", "Superseded copy in the tree"),
    ".tmp": ("INFO", "Temporary file in the tree"),
    ".log": ("INFO", "Log file in the tree"),
    ".dump": ("MEDIUM", "Database dump in the tree"),
    ".sql": ("INFO", "SQL script in the tree"),
}

PLACEHOLDERS = (
    "changeme", "dummy", "example", "fake", "password", "placeholder", "test",
    "your_api_key",
)

MEGABYTE = 1024 * 1024
MAX_FILE_SIZE_MB = 10
SNIFF_BYTES = 8192
LONG_LINE_CHARS = 200
LONG_LINES_PER_FILE = 20
MAX_AST_DEPTH = 14
MANY_DEPENDENCIES = 80
LARGE_FILE_BYTES = 5 * MEGABYTE
DUPLICATE_MAX_BYTES = 50 * MEGABYTE
SHORT_README_CHARS = 500
TOP_FILES = 10
TOP_RECOMMENDATIONS = 8
TOP_ERRORS = 10
EVIDENCE_CHARS = 160
ID_MODULO = 1000
BROKEN_SYMLINK = "broken symlink"

# Root manifests, read whatever their size
MANIFEST_NAMES = ("requirements.txt", "pyproject.toml", "package.json", "Cargo.toml", "go.mod", "pom.xml")
