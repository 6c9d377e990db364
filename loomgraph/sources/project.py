"""Reading a source tree: walk, ignore rules, languages, formats, bounded and lossy reads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import glob_regex
from ..operators.chunks import MAX_FILE_BYTES

#: Language by extension.
EXTENSIONS = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "tsx",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "jsx": "jsx",
    "vue": "vue",
    "svelte": "svelte",
    "astro": "astro",
    "ets": "arkts",
    "py": "python", "pyi": "python",
    "rs": "rust",
    "go": "go",
    "java": "java",
    "cs": "csharp",
    "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "dart": "dart",
    "rb": "ruby", "rake": "ruby",
    "php": "php", "phtml": "php",
    "swift": "swift",
    "lua": "lua",
    "kt": "kotlin", "kts": "kotlin",
    "scala": "scala", "sc": "scala",
    "r": "r",
}
LANGUAGES = frozenset(EXTENSIONS.values())
#: Folders that are never entered, formats of content, file names that are text.
IGNORED = (".git", ".loomgraph", "node_modules", "dist", "build", "out", "target", "vendor", "coverage", "__pycache__", ".venv", "venv", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache")
FORMATS = {"document": "md mdx rst txt", "config": "json jsonc toml yaml yml", "script": "sh bash zsh fish ps1"}
TEXT_NAMES = ("dockerfile", "makefile", "license", "notice", ".gitignore", ".gitattributes")


class ConfigError(ValueError):
    """The project's configuration can't be used; nothing is scanned."""


@dataclass
class ProjectConfig:
    """extensions -> language, and path globs; fails closed on anything it doesn't know."""

    extensions: dict[str, str] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    include_ignored: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, source: str | None) -> ProjectConfig:
        if source is None:
            return cls()
        try:
            value = json.loads(source)
        except ValueError as e:
            raise ConfigError(f"configuration is not JSON: {e}") from e
        if value is None:
            return cls()
        if not isinstance(value, dict):
            raise ConfigError("configuration must be a JSON object")
        out = cls()
        own = value.get("extensions", {})
        if not isinstance(own, dict):
            raise ConfigError("`extensions` must be a JSON object")
        for extension, language in own.items():
            key = extension.strip().lstrip(".").lower()
            if language not in LANGUAGES or not key or "/" in key:
                raise ConfigError(f"unsupported language `{language}` for extension `{extension}`")
            out.extensions[key] = language
        for name, target in (("exclude", out.exclude), ("include", out.include), ("includeIgnored", out.include_ignored)):
            globs = value.get(name, [])
            if not isinstance(globs, list) or not all(isinstance(g, str) and g.strip() for g in globs):
                raise ConfigError(f"`{name}` must be a list of globs")
            target.extend(globs)
        return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for value in dict.fromkeys(values.values()):
        out = F.when(key.isin(*(k for k, v in values.items() if v == value)), F.lit(value)).otherwise(out)
    return out


def language_of(path: Column, config: ProjectConfig | None = None) -> Column:
    return _mapped(extension(path), EXTENSIONS | (config.extensions if config else {}))


def content_format(path: Column) -> Column:
    """The language, or document, config, script or text; null for any other file."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    other = _mapped(extension(path), {e: f for f, own in FORMATS.items() for e in own.split()})
    return F.coalesce(language_of(path), other, F.when(name.isin(*TEXT_NAMES), F.lit("text")))


def ignore_rules(text: str, base: str = "") -> list[tuple[str, bool]]:
    """(regex, ignored) of the lines of an ignore file in folder ``base``; the last that matches decides."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!").removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anywhere = "/" not in line
        body = glob_regex(line.lstrip("/"))[1:-1]
        rules.append((f"^{re.escape(base)}{'(?:.*/)?' if anywhere else ''}{body}{'/.*' if folder else '(?:/.*)?'}$", not negated))
    return rules


def ignore_files(files: DataFrame, more: str = "") -> list[tuple[str, bool]]:
    """The rules of a tree's own ignore files (path, content): ``more`` first, as of a global file, then .git/info/exclude, then the
    .gitignore files from the root down.  They are configuration: a file of at most 1 MiB per folder, read to the driver."""
    own = files.where(F.element_at(F.split("path", "/"), -1).isin(".gitignore") | (F.col("path") == ".git/info/exclude")).where(F.col("length") <= MAX_FILE_BYTES)
    texts = {r["path"]: bytes(r["content"]).decode(errors="replace") for r in own.select("path", "content").collect()}
    rules = ignore_rules(more) + ignore_rules(texts.pop(".git/info/exclude", ""))
    for path in sorted(texts, key=lambda p: (p.count("/"), p)):
        if not any(part in IGNORED for part in path.split("/")[:-1]):
            rules += ignore_rules(texts[path], path[: -len(".gitignore")])
    return rules


def outside_built_in(files: DataFrame) -> DataFrame:
    """The files of a tree that no built-in folder holds."""
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED))))


def manifests(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(path, text) of the files of a tree with one of the names, outside the built-in folders."""
    parts = F.split("path", "/")
    rows = outside_built_in(files).where(F.element_at(parts, -1).isin(*names) & (F.col("length") <= MAX_FILE_BYTES))
    return rows.select("path", lossy_utf8("content").alias("text"))


def ignored_by(path: Column, rules: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for regex, ignored in rules:
        out = F.when(path.rlike(regex), F.lit(ignored)).otherwise(out)
    return out


def _any_glob(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


@F.pandas_udf(StringType())
def lossy_utf8(content: pd.Series) -> pd.Series:
    """Bytes as text; each byte that is not UTF-8 becomes a blank, so offsets stay."""

    def decode(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                try:
                    out.append(raw[at:].decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(raw[at : at + e.start].decode())
                    out.append(" " * (e.end - e.start))
                    at += e.end
            return "".join(out)

    return content.map(decode)


def _hidden(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(uri, length) of the files below a root that Spark's readers pass over: a part of their path starts with a dot or an underscore.  Built-in folders are not looked into."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, todo = [], [(path, False)]
    while todo:
        folder, hidden = todo.pop()
        for status in system.listStatus(folder):
            name, own = status.getPath().getName(), hidden or status.getPath().getName()[:1] in "._"
            if status.isDirectory():
                if name == ".git":
                    exclude = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "info/exclude")
                    if system.exists(exclude):
                        out.append((exclude.getParent().getParent().getParent().toString() + "/.git/info/exclude", system.getFileStatus(exclude).getLen()))
                elif name not in IGNORED:
                    todo.append((status.getPath(), own))
            elif own:
                out.append((status.getPath().toString(), status.getLen()))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            uri = row["path"]
            system, path = fs.FileSystem.from_uri(f"file://{uri[5:]}" if re.match("file:/(?!/)", uri) else uri)
            with system.open_input_file(path) as f:
                yield pa.RecordBatch.from_pydict({"path": [uri], "length": [row["length"]], "content": [f.read()]})


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of all regular files below a root, hidden ones too; paths are relative."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    hidden = [h for h in _hidden(spark, root) if h[1] <= MAX_FILE_BYTES]
    if hidden:
        files = files.union(spark.createDataFrame(hidden, "path string, length long").mapInArrow(_read, "path string, length long, content binary"))
    plain = re.sub(r"^[a-z0-9]+:/*", "/", root)
    tail = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    return files.select(F.substr(tail, F.lit(len(plain) + 2)).alias("path"), "length", "content")


def project_files(files: DataFrame, config: ProjectConfig | None = None, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, language, source, content_hash) of the source files of a tree.

    Built-in folders never count; ignore rules and excludes do unless the path is included by the configuration,
    and excludes win even then.  Files above 1 MiB are left out.
    """
    config = config or ProjectConfig()
    path = F.col("path")
    builtin = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED)))
    forced = _any_glob(path, config.include + config.include_ignored)
    rows = files.withColumn("language", language_of(path, config))
    rows = rows.where(~builtin & F.col("language").isNotNull() & ~_any_glob(path, config.exclude) & (forced | ~ignored_by(path, list(rules))) & (F.col("length") <= MAX_FILE_BYTES))
    return rows.select("path", "language", lossy_utf8("content").alias("source"), F.sha2("content", 256).alias("content_hash"))


def content_files(files: DataFrame, rules: list[tuple[str, bool]] = ()) -> DataFrame:
    """(path, format, text, content_hash) of the text files of a tree: an own walk, to which only the ignore rules and the state folder apply; files with a NUL or not in UTF-8 are left out."""
    path = F.col("path")
    rows = files.withColumn("format", content_format(path)).where(F.col("format").isNotNull() & ~ignored_by(path, list(rules)) & ~path.rlike(r"(^|/)\.(loomgraph|git)/") & (F.col("length") <= MAX_FILE_BYTES))
    rows = rows.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).where(F.col("text").isNotNull() & (F.instr("text", "\0") == 0))
    return rows.select("path", "format", "text", F.sha2("content", 256).alias("content_hash")).orderBy("path")


def delta(seen: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """(path, change) with change added, changed or deleted: seen (path, content_hash) against indexed (path, content_hash)."""
    new, old = seen.select("path", F.col("content_hash").alias("new")), indexed.select("path", F.col("content_hash").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when((F.col("old") != F.col("new")) | F.lit(force), "changed")
    return new.join(old, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")
