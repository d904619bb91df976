"""Column functions over paths, commit subjects and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names too generic to stand alone.
GENERIC_STEMS = (
    "index", "util", "utils", "types", "type", "helpers", "helper", "main", "api", "constants", "model", "models", "node",
    "common", "shared", "config", "mod", "lib", "core", "base", "handler", "service", "routes", "module", "component", "app",
    "init", "__init__", "default", "interfaces", "public_api",
)
# Directories that only hold other directories.
CONTAINER_DIRS = (
    "apps", "libs", "packages", "projects", "services", "modules", "src", "app", "lib", "components", "features", "pages",
    "domains", "Http", "Controllers", "resources", "assets", "js", "ts",
)
# Language by extension, and how much a language's complexity counts.
LANGUAGES = {
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "template": ("html", "htm"),
    "scss": ("scss",),
    "css": ("css",),
    "php": ("php", "phtml"),
    "data": ("json", "jsonc", "yaml", "yml", "xml", "toml", "ini", "env", "csv", "properties", "neon", "lock"),
    "doc": ("md", "mdx", "txt", "rst", "adoc"),
}
LANGUAGE_WEIGHTS = {"typescript": 1.0, "tsx": 1.0, "javascript": 1.0, "php": 1.0, "template": 0.8, "other": 0.7, "scss": 0.5, "css": 0.5, "data": 0.3, "doc": 0.15}
# What marks a test by its name, by its place, and by the start of its path.
TEST_PATH = (
    r"(\.(spec|test|stories|cy|e2e|mock|mocks|fixture)\.[^/]*$)|(test\.php$)|(^(test|tests|e2e|spec)/)"
    r"|(/(test|tests|spec|__tests__|__mocks__|fixtures|__fixtures__|e2e|cypress)/)"
)
# What marks generated code within the first ten lines.
GENERATED_HEAD = r"@generated|do not edit|auto-generated|autogenerated|this file was generated|code generated by"
TEST_SUFFIX = r"\.(spec|test|stories|cy|e2e)$"
MAX_LINE_BYTES = 300


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike(TEST_PATH)


def entity_key(path: Column) -> Column:
    """Directory and stem without the extension and one test suffix, so that a component's files share a key."""
    stem = F.regexp_replace(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""), TEST_SUFFIX, "")
    return F.when(F.instr(path, "/") > 0, F.concat(directory(path), F.lit("/"), stem)).otherwise(stem)


def short_name(path: Column) -> Column:
    """The last segment, with its directory where the stem alone says little."""
    parts = F.split(path, "/")
    generic = F.lower(F.element_at(F.split(file_name(path), r"\."), 1)).isin(*GENERIC_STEMS)
    return F.when(generic & (F.size(parts) > 1), F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def fallback_unit(path: Column) -> Column:
    """The path down to the first directory that is no container, five at most."""
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    containers = F.array(*map(F.lit, CONTAINER_DIRS))
    first = F.array_position(F.transform(dirs, lambda d: F.array_contains(containers, d)), F.lit(False)).cast("int")
    depth = F.least(F.when(first == 0, F.size(dirs)).otherwise(first), F.lit(5))
    return F.when(F.size(dirs) == 0, "(root)").otherwise(F.array_join(F.slice(dirs, 1, F.greatest(depth, F.lit(1))), "/"))


def language(path: Column) -> Column:
    name = F.lower(file_name(path))
    ext = F.when(F.instr(name, ".") > 0, F.element_at(F.split(name, r"\."), -1)).otherwise("")
    found = F.when(name.endswith(".blade.php"), "other")
    for lang, exts in LANGUAGES.items():
        found = found.when(ext.isin(*exts), lang)
    return found.otherwise("other")


def language_weight(lang: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in LANGUAGE_WEIGHTS.items() for x in pair])
    return F.coalesce(weights[lang], F.lit(LANGUAGE_WEIGHTS["other"]))


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def indent_complexity(text: Column) -> Column:
    """Sum of indentation depths: tabs count four, the unit is the least indent from 2 to 8, the sum is 1 at least."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    lead = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, r"^[ \t]*", 0), "\t", "    ")))
    unit = F.greatest(F.lit(2), F.least(F.lit(8), F.coalesce(F.array_min(F.filter(lead, lambda n: n > 0)), F.lit(4))))
    depth = F.aggregate(lead, F.lit(0).cast("long"), lambda a, n: a + F.floor(n / unit))
    return F.greatest(depth, F.lit(1).cast("long")).cast("double")


def is_generated(text: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 10), "\n"))
    loc = non_blank_lines(text)
    return head.rlike(GENERATED_HEAD) | F.coalesce((loc > 0) & (F.floor(F.try_divide(F.octet_length(text), loc)) > MAX_LINE_BYTES), F.lit(False))


def normalized_name(name: Column) -> Column:
    """Letters and digits in lower case, common accents folded."""
    folded = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(folded, r"[^\p{IsAlphabetic}\p{N}]", "")
