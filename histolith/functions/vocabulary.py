"""Word lists, names and patterns whose exact content decides results.

Patterns are in the common subset of Python and Java regular expressions, for use with ``rlike``; ``(?i)`` where letter
case doesn't matter.
"""

# Fixed values -----------------------------------------------------------------------------------------
STOPWORDS = (
    "fix", "add", "adds", "added", "update", "updates", "updated", "the", "to", "for", "a", "an", "in", "of", "and", "or",
    "remove", "removes", "removed", "merge", "pr", "wip", "chore", "bump", "use", "using", "with", "from", "into", "via",
    "new", "initial", "support", "refactor", "cleanup", "test", "tests", "docs", "doc", "lint", "format", "style", "minor",
    "misc", "everywhere", "correct", "comment", "scaffold", "project", "wire",
)
GENERIC_BASENAMES = (
    "index", "main", "mod", "init", "utils", "util", "config", "common", "types", "constants", "helpers", "app", "store",
    "store_test", "lib", "setup", "base", "core", "model", "models", "service", "services",
)
DEPENDENCY_FILES = ("package.json", "requirements.txt", "go.mod", "cargo.toml", "pom.xml", "build.gradle", "pipfile", "pyproject.toml", "gemfile")
WEIGHTS = {"new_src": 3, "dep_file": 3, "schema": 3, "breadth": 2, "deletion": 2, "replace_verb": 1, "demote_fix": -1, "demote_test": -2}
LEGACY_SOURCE_ROOTS = ("src", "lib", "core", "app", "services", "internal", "pkg")
SOURCE_EXTENSIONS = (
    ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".rb", ".kt", ".swift", ".cpp", ".c", ".h",
    ".hpp", ".cs", ".scala", ".lua", ".sh", ".php",
)
NO_SOURCE_DIRS = (
    ".git", ".github", "node_modules", "dist", "build", "target", "vendor", "__pycache__", "docs", "doc", "tests", "test",
    "__tests__", ".venv", "venv", "coverage", ".next", ".nuxt",
)
WALK_SKIP = (".git", "node_modules", "__pycache__", ".venv", "venv", "vendor", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache")

SCHEMA = r"(?i)schema|migration|interface|contract|proto|\.sql$"
SECURITY = r"(?i)(^|/)(auth|certs|secrets)/"
INFRA = r"(?i)(^|/)(Dockerfile|k8s/|\.github/workflows/)"
TEST = r"(?i)(^|/)(tests?|__tests__)/|(_test\.|\.test\.|\.spec\.|_spec\.)"
DOCS = r"(?i)\.(md|rst|txt|adoc)$|(^|/)docs?/"
PR_REF = r"\(#\d+\)"
REPLACE_VERB = r"(?i)\b(migrate|replace|adopt|switch|introduce|implement)\b"
DEMOTE = r"(?i)^(fix|chore|style|bump)\b"
EXCLUDE = r"(?i)^(test|docs|lint|format)\b"
COUPLING_DENY = (
    r"(?i)\.(lock|min\.js|min\.css|map|generated\..*|pb\.go|pb\.py)$|(^|/)(node_modules|vendor|dist|build|\.next|\.nuxt|target|coverage)/"
    r"|(^|/)(pnpm-lock\.yaml|package-lock\.json|yarn\.lock|poetry\.lock|cargo\.lock|gemfile\.lock|composer\.lock)$"
)
WORKAROUND_MARK = r"(?i)\b(hack|work.?around|kludge|xxx)\b|monkey.?patch|\bpolyfill\b|\bshim\b"
WORKAROUND_UNTIL = r"(?i)\b(fixme|todo)\b.*\b(until|upstream|remove (when|once|after)|temporar)"
WORKAROUND_FILE = r"(?i)(^|/)patches?(/|$)|\.(patch|diff)$|(adapter|proxy|shim|polyfill)[^/]*$"
#: One changed manifest line (without its sign) that only states a version, by manifest shape.
VERSION_LINES = (
    r'^\s*"[^"]+":\s*"[~^]?\d+(\.\d+){0,2}(-[\w.]+)?"\s*,?\s*$',
    r'^\s*[\w_-]+\s*=\s*"[~^>=<]?\s*\d+(\.\d+){0,2}(-[\w.]+)?"\s*$',
    r"^\s*[\w_-]+\s*[=<>!~]+\s*\d+(\.\d+){0,2}\s*$",
    r"^\s*[\w./_-]+\s+v\d+(\.\d+){0,2}\s*$",
    r'^\s*"[A-Za-z0-9_.\[\]-]+\s*[=<>!~]+\s*[\d][^"]*"\s*,?\s*$',
)
#: The package that such a line names; the first pattern that matches counts.
VERSION_KEYS = (
    r'^\s*"([^"]+)":\s*"[~^>=<]?[\d]',
    r'^\s*([A-Za-z0-9_.-]+)\s*=\s*"[~^>=<]?\d',
    r"^\s*([A-Za-z0-9_.-]+)\s*[=<>!~]+\s*\d",
    r"^\s*([\w./_-]+)\s+v\d",
    r'^\s*"([A-Za-z0-9_.\[\]-]+)\s*[=<>!~]',
)
PYTHON_IMPORT = r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
SCRIPT_IMPORT = r"""(?m)(?:import\s+[^'"]*?\s+from\s+['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))"""
GO_IMPORT = r'"([\w./\-]+)"'
SCRIPT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
# ------------------------------------------------------------------------------------------------------
