"""What never enters the model: excluded, generated and binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.paths import is_generated

# Globs that are always excluded.
DEFAULT_EXCLUDES = (
    "**/package-lock.json", "**/pnpm-lock.yaml", "**/yarn.lock", "**/composer.lock", "**/Cargo.lock", "**/bun.lockb", "**/*.min.js", "**/*.min.css", "**/*.map",
    "**/dist/**", "**/build/**", "**/out/**", "**/coverage/**", "**/storybook-static/**", "**/.angular/**", "**/.nx/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**",
    "**/.turbo/**", "**/.cache/**", "**/bootstrap/cache/**", "**/vendor/**", "**/node_modules/**", "**/bower_components/**", "**/third_party/**",
    "**/*.generated.*", "**/generated/**", "**/__generated__/**", "**/*.gen.{ts,js}", "**/*.pb.{ts,js,go}", "**/*_pb.{ts,js}",
    "**/*.{xlf,xliff,po,mo}", "**/CHANGELOG*", "**/CHANGES.md", "**/*.snap", "**/__snapshots__/**",
    "**/*.{png,jpg,jpeg,gif,ico,webp,avif,bmp,svg,woff,woff2,ttf,otf,eot,pdf,zip,gz,tgz,jar,war,mp3,mp4,mov,webm,wav,psd,sketch,fig,exe,dll,so,dylib,bin,dat,db,sqlite}",
)
# Attributes that mark a pattern's files as not the repository's own.
MARKS = ("linguist-generated", "linguist-generated=true", "linguist-vendored", "linguist-vendored=true")
BINARY_HEAD = 8000
MAX_BYTES = 524_288


def glob_regex(glob: Column) -> Column:
    """A regular expression for whole paths: ** is any directories, * and ? stay within a name, {a,b} is either."""
    r = F.regexp_replace(glob, r"([.+()|^$\\])", r"\\$1")
    steps = (("**/", "\u0001"), ("/**", "\u0002"), ("**", "\u0003"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*"), ("\u0003", ".*"), ("{", "(?:"), ("}", ")"))
    for old, new in steps:
        r = F.replace(r, F.lit(old), F.lit(new))
    # Commas are alternatives inside of braces alone.
    r = F.when(F.contains(glob, F.lit("{")), F.replace(r, F.lit(","), F.lit("|"))).otherwise(r)
    return F.concat(F.lit("^"), r, F.lit("$"))


def attribute_excludes(attributes: DataFrame) -> DataFrame:
    """repo, glob for attributes(repo, dir, text): the patterns of .gitattributes files whose files are generated or vendored.

    A pattern with a slash before its end is anchored to the file's directory, others match names at any depth. Comments,
    quoted patterns and empty lines are skipped; null texts have none.
    """
    line = attributes.select("repo", "dir", F.explode(F.split("text", r"\r?\n")).alias("line")).withColumn("line", F.trim("line"))
    line = line.filter((F.col("line") != "") & ~F.substring("line", 1, 1).isin("#", '"'))
    words = F.split("line", r"\s+")
    line = line.select("repo", "dir", F.get(words, 0).alias("pattern"), words.alias("words")).filter(F.arrays_overlap("words", F.array(*map(F.lit, MARKS))))
    anchored = F.contains(F.regexp_replace("pattern", "/+$", ""), F.lit("/"))
    p = F.regexp_replace("pattern", "^/+", "")
    p = F.when(p.endswith("/"), F.concat(p, F.lit("**"))).otherwise(p)
    p = F.when(anchored, p).otherwise(F.concat(F.lit("**/"), p))
    return line.select("repo", F.when(F.coalesce("dir", F.lit("")) == "", p).otherwise(F.concat("dir", F.lit("/"), p)).alias("glob"))


def without_excluded(files: DataFrame, excludes: DataFrame | None = None, globs: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """files(repo, path, ...) that no glob matches: globs hold for all repositories, excludes(repo, glob) for one each."""
    if globs:
        patterns = [glob_regex(F.lit(g)) for g in globs]
        matched = F.lit(False)
        for p in patterns:
            matched = matched | F.regexp_like("path", p)
        files = files.filter(~matched)
    if excludes is not None:
        e = excludes.select(F.col("repo").alias("_repo"), glob_regex(F.col("glob")).alias("_regex"))
        files = files.join(e, (F.col("repo") == F.col("_repo")) & F.regexp_like("path", F.col("_regex")), "left_anti")
    return files


def is_binary(content: Column) -> Column:
    """Whether bytes hold a zero near their start."""
    return F.instr(F.decode(F.substring(content, 1, BINARY_HEAD), "ISO-8859-1"), "\0") > 0


def clean_files(files: DataFrame, excludes: DataFrame | None = None, globs: tuple[str, ...] = DEFAULT_EXCLUDES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(repo, path, content, ...) without excluded, binary, generated and oversize ones, with text in place of content.

    Files without content, which the newest tree no longer has, stay: their history counts.
    """
    kept = without_excluded(files, excludes, globs)
    text = F.decode(F.col("content"), "utf-8")
    bad = is_binary(F.col("content")) | (F.length("content") > max_bytes) | is_generated(text)
    return kept.filter(F.col("content").isNull() | ~bad).withColumn("text", text).drop("content")
