"""Columns on repository paths: extensions, languages, filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are indexed, path segments that are not, and the local mirror's own sets.
SUPPORTED = (
    ".py .js .ts .jsx .tsx .java .cs .go .rb .php .sql .graphql .proto .md .txt .html .htm .css .scss .sass .less .json .xml .yaml .yml "
    ".properties .conf .cfg .ini .jsp .jspf .tag .vue .svelte .ftl .hbs .mustache .twig .sh .bash .zsh .ps1 .bat .cmd .dockerfile .env "
    ".gitignore .gitattributes .plsql .pks .pkb"
).split()
IGNORED = "node_modules .git dist build __pycache__ .next coverage vendor package-lock.json yarn.lock pnpm-lock.yaml".split()
MIRROR_EXTENSIONS = ".java .sql .xml .properties .yml .yaml .json .html .js .ts .py .md .txt .jsp .jspf".split()
MIRROR_IGNORED = ".git node_modules __pycache__ target build dist .next coverage vendor".split()
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".cs": "csharp",
    ".go": "go", ".rb": "ruby", ".php": "php", ".sql": "sql", ".plsql": "sql", ".pks": "sql", ".pkb": "sql", ".graphql": "graphql",
    ".proto": "protobuf", ".md": "markdown", ".txt": "text", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass",
    ".less": "less", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml", ".properties": "properties", ".conf": "conf", ".cfg": "cfg",
    ".ini": "ini", ".jsp": "jsp", ".jspf": "jsp", ".tag": "jsp", ".vue": "vue", ".svelte": "svelte", ".ftl": "freemarker", ".hbs": "handlebars",
    ".mustache": "mustache", ".twig": "twig", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".bat": "batch",
    ".cmd": "batch", ".dockerfile": "dockerfile", ".env": "env", ".gitignore": "gitignore", ".gitattributes": "gitattributes",
}
AST_LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "go": "go"}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/+[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names like ``.env``, whose only dots lead."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.*(\.[^.]*)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(SUPPORTED)


def not_ignored(path: Column) -> Column:
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))


def in_mirror(path: Column) -> Column:
    """The local mirror's filter: own extensions, and only directories are tested."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return extension(path).isin(MIRROR_EXTENSIONS) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, MIRROR_IGNORED)))


def language_of(path: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(LANGUAGES), extension(path)), F.lit("text"))


def ast_language(path: Column) -> Column:
    """Language with an entity scanner, by what follows the path's last dot; else null."""
    return F.when(path.contains("."), F.try_element_at(_map(AST_LANGUAGES), F.element_at(F.split(F.lower(path), r"\."), -1)))


def is_sql(path: Column) -> Column:
    return F.lower(path).endswith(".sql")


def is_repo(name: Column) -> Column:
    """org/name of word characters, dots and hyphens."""
    return name.rlike(r"^[\w.-]+/[\w.-]+\n?$")


def safe_directory(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))
