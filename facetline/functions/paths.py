"""Columns of a path: its parts, language and category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetline.functions.globs import ignored

# Languages by extension, and the names and patterns of the categories.
LANGUAGES = {
    ".py": "python", ".pyi": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".html": "html", ".htm": "html", ".vue": "vue", ".svelte": "svelte",
    ".css": "css", ".scss": "scss", ".sass": "scss", ".less": "less",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".rst": "rst",
    ".sql": "sql", ".sh": "shell", ".go": "go", ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".rs": "rust",
}
ANALYZABLE = ["python", "javascript", "jsx", "typescript", "tsx"]
CATEGORIES = ["source", "test", "template", "style", "config", "migration", "docs", "generated", "asset", "other"]
GENERATED_NAMES = "package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock uv.lock cargo.lock composer.lock gemfile.lock go.sum bun.lockb".split()
GENERATED_FILE = r"\.min\.(js|css)$|\.map$|\.pb\.go$|_pb2\.py$"
GENERATED_DIR = r"(^|/)(dist|build|vendor|node_modules|__generated__|generated|\.next|coverage)/"
# the alternative for Java and Kotlin has a capital letter and meets lower-cased names, so it never matches; kept
TEST_FILE = r"^(test_.*\.py|.*_tests?\.py|conftest\.py|.*\.(test|spec|e2e|cy)\.[cm]?[jt]sx?|.*\.snap|.*_test\.go|.*Tests?\.(java|kt))$"
TEST_DIR = r"(^|/)(tests?|__tests__|__mocks__|specs?|e2e|cypress|playwright|testing|fixtures|test_utils)/"
MIGRATION_DIR = r"(^|/)(migrations|alembic/versions|db/migrate)/"
MIGRATION_EXT = ".py .sql .rb .js .ts".split()
TEMPLATE_EXT = ".html .htm .jinja .jinja2 .j2 .djhtml .hbs .handlebars .mustache .ejs .pug .jade .njk .liquid .twig .erb .haml .tpl .mjml".split()
STYLE_EXT = ".css .scss .sass .less .styl .pcss .postcss".split()
ASSET_EXT = ".png .jpg .jpeg .gif .webp .avif .ico .svg .bmp .woff .woff2 .ttf .otf .eot .mp3 .mp4 .webm .wav .pdf .zip .gz".split()
CONFIG_NAMES = "dockerfile makefile procfile justfile gemfile pipfile requirements.txt setup.py manage.py package.json tsconfig.json .gitignore .gitattributes .dockerignore .editorconfig .nvmrc .python-version .prettierrc .eslintrc .babelrc codeowners".split()
CONFIG_FILE = r"^(\.?[\w.-]*rc(\.\w+)?|[\w.-]+\.config\.[cm]?[jt]s|docker-compose[\w.-]*|requirements[\w.-]*\.txt|\.env[\w.-]*)$"
CONFIG_DIR = r"(^|/)(\.github|\.circleci|\.gitlab|\.husky|\.vscode|deploy|k8s|helm|terraform)/"
CONFIG_EXT = ".json .jsonc .yaml .yml .toml .ini .cfg .conf .env .properties .xml .plist .lock".split()
DOCS_EXT = ".md .mdx .rst .adoc .txt".split()
DOCS_NAMES = "license changelog authors".split()
MORE_SOURCE_EXT = ".c .h .cpp .hpp .cs .swift .scala .ex .exs .lua .r .dart".split()
INDEX_EXCLUDE = ["node_modules/", "bower_components/", "vendor/", "dist/", "build/", ".next/", "coverage/", "*.min.js", "*.bundle.js", "*.d.ts", "site-packages/", ".venv/", "venv/"]


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dirname(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_replace(F.when(F.contains(path, F.lit("/")), path).otherwise(F.lit("")), r"/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot, from the last dot of the name; dots at its start don't count."""
    return F.regexp_extract(F.lower(basename(path)), r"^\.*[^.].*?(\.[^.]*)$", 1)


def language_of(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def builtin_category(path: Column) -> Column:
    """The first rule that fits the lower-cased path; their order is part of the meaning."""
    lower = F.lower(path)
    name, ext = basename(lower), extension(lower)
    return (
        F.when(name.isin(GENERATED_NAMES) | name.rlike(GENERATED_FILE) | lower.rlike(GENERATED_DIR), "generated")
        .when(name.rlike(TEST_FILE) | lower.rlike(TEST_DIR), "test")
        .when(lower.rlike(MIGRATION_DIR) & ext.isin(MIGRATION_EXT), "migration")
        .when(ext.isin(TEMPLATE_EXT) | ((ext == ".txt") & F.contains(F.concat(F.lit("/"), lower), F.lit("/templates/"))), "template")
        .when(ext.isin(STYLE_EXT), "style")
        .when(ext.isin(ASSET_EXT), "asset")
        .when(name.isin(CONFIG_NAMES) | name.rlike(CONFIG_FILE) | lower.rlike(CONFIG_DIR), "config")
        .when(ext.isin(DOCS_EXT) | F.startswith(lower, F.lit("docs/")) | name.isin(DOCS_NAMES), "docs")
        .when(ext.isin(CONFIG_EXT), "config")
        .when(ext.isin([*LANGUAGES, *MORE_SOURCE_EXT]), "source")
        .otherwise("other")
    )


def category(path: Column, overrides: dict[str, list[str]] | None = None) -> Column:
    """The first overriding category whose ignore-file patterns match, else the built-in one; unknown categories are ignored."""
    known = [ignored(path, patterns) for name, patterns in (overrides or {}).items() if name in CATEGORIES and patterns]
    names = [name for name, patterns in (overrides or {}).items() if name in CATEGORIES and patterns]
    return F.coalesce(*[F.when(c, n) for c, n in zip(known, names, strict=True)], builtin_category(path))


def analyzable(path: Column, exclude: list[str] | None = None) -> Column:
    return F.coalesce(language_of(path).isin(ANALYZABLE), F.lit(False)) & ~ignored(path, INDEX_EXCLUDE if exclude is None else exclude)


def scan_route(path: Column, size: Column, exclude: list[str] | None = None, max_bytes: int = 512 * 1024) -> Column:
    """Where a file of a tree goes: tsconfig, package, source, or null."""
    name = basename(path)
    patterns = INDEX_EXCLUDE if exclude is None else exclude
    return F.when(~ignored(path, patterns), F.when(name.rlike(r"^(ts|js)config[\w.-]*\.json$"), "tsconfig").when(name == "package.json", "package").when(analyzable(path, []) & (size <= max_bytes), "source"))


def prefixes(dotted: Column) -> Column:
    """Dotted prefixes, longest first."""
    parts = F.split(dotted, r"\.")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ".")))


def suffixes(dotted: Column) -> Column:
    """Dotted suffixes, longest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def shared_depth(a: Column, b: Column) -> Column:
    """Number of directories that two paths have in common at their start."""
    same = F.zip_with(F.split(dirname(a), "/"), F.split(dirname(b), "/"), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def normalize(path: Column) -> Column:
    """A relative path without '.' and inner '..' steps."""
    step = lambda done, part: F.when((part == "") | (part == "."), done).when((part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
