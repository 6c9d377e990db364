"""Imports made into files of the project: relative paths, path aliases, workspace packages.

A hint is what an import names (``./x``, ``@lib/x``, ``some-package/x``).  Every hint
gets its candidate paths, in order, and those are probed against the project's files:
as they stand, with each source extension, as a package folder, as an index file.  All
of this is equal joins on exploded candidates; the first that exists wins.

``config`` (kind, name, folder, values, ord) holds what the project's manifests say,
one row per alias, package, workspace pattern or dependency; ``read_config`` makes it.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex

#: Extensions in the order in which they are tried, names of manifests, package entries.
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue", "svelte", "astro", "ets", "json", "rs", "py", "pyi")
MANIFESTS = ("tsconfig.json", "jsconfig.json", "package.json", "pnpm-workspace.yaml", "Cargo.toml", "go.work", "go.mod", "oh-package.json5")
ENTRIES = ("types", "module", "main", "source")
FALLBACKS = ("src/index", "index")
CONFIG = "kind string, name string, folder string, values array<string>, ord long"
#: Which kind of package is asked first among those of one name, and its provenance.
PACKAGES = (("npm", "workspace/package"), ("ohpm", "harmony/ohpm"), ("cargo", "cargo/workspace"), ("go", "go/workspace"))
WAYS = {"project/relative-import": "a relative path", "tsconfig/path-alias": "a path alias", "harmony/ohpm": "a file dependency", "cargo/workspace": "a workspace crate", "go/workspace": "a workspace module", "workspace/package": "a workspace package"}


# --- manifests ---------------------------------------------------------------------------


def plain_json(text: str):
    """The value of JSON that may hold comments and trailing commas; None if it is none."""
    kept = re.sub(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', lambda m: m[0] if m[0][0] == '"' else " ", text, flags=re.DOTALL)
    kept = re.sub(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', lambda m: m[0] if m[0][0] == '"' else "", kept)
    try:
        return json.loads(kept)
    except ValueError:
        return None


def _strings(value) -> list[str]:
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def _join(folder: str, path: str) -> str | None:
    """A path below a folder without dots; None if it leaves the project."""
    out: list[str] = []
    for part in [*folder.split("/"), *path.replace("\\", "/").split("/")]:
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def manifest_rows(path: str, text: str) -> list[tuple]:
    """(kind, name, folder, values, ord) of one manifest."""
    folder, _, name = path.rpartition("/")
    out: list[tuple] = []
    add = lambda kind, key="", values=(), order=0, at=folder: out.append((kind, key, at, list(values), order))
    if name in ("tsconfig.json", "jsconfig.json") and not folder:
        value = plain_json(text)
        options = value.get("compilerOptions") if isinstance(value, dict) else None
        options = options if isinstance(options, dict) else {}
        base = _join("", _text(options.get("baseUrl")))
        paths = options.get("paths")
        add("tsconfig", name)
        if isinstance(paths, dict) and base is not None:
            for k, (pattern, targets) in enumerate(paths.items()):
                if _strings(targets):
                    add(f"alias:{name}", pattern, _strings(targets), k, base)
    elif name == "package.json":
        value = plain_json(text)
        if isinstance(value, dict):
            if not folder:
                spaces = value.get("workspaces")
                for pattern in _strings(spaces.get("packages") if isinstance(spaces, dict) else spaces):
                    add("npm-members", pattern.rstrip("/"))
            elif _text(value.get("name")):
                add("npm", value["name"], [value[e] for e in ENTRIES if _text(value.get(e))])
    elif name == "pnpm-workspace.yaml" and not folder:
        inside = False
        for line in text.splitlines():
            bare = line.strip()
            if not bare or bare.startswith("#"):
                continue
            if not line[0].isspace():
                inside = bare == "packages:"
            elif inside and bare.startswith("-"):
                pattern = bare[1:].strip().strip("'\"").rstrip("/")
                if pattern and not pattern.startswith("!"):
                    add("npm-members", pattern)
    elif name == "Cargo.toml":
        try:
            value = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return out
        if not folder:
            space = value.get("workspace")
            for pattern in _strings(space.get("members") if isinstance(space, dict) else None):
                add("cargo-members", pattern.rstrip("/"))
        elif isinstance(value.get("package"), dict) and _text(value["package"].get("name")):
            add("cargo", value["package"]["name"].replace("-", "_"), ["src/lib", "src/main"])
    elif name == "go.mod":
        found = re.search(r"^\s*module\s+(\S.*?)\s*$", text, re.MULTILINE)
        if found:
            add("go", found[1])
    elif name == "go.work" and not folder:
        inside = False
        for line in text.splitlines():
            bare = line.split("//")[0].strip()
            if inside and bare == ")":
                inside = False
                continue
            if re.fullmatch(r"use\s*\(", bare):
                inside = True
                continue
            used = bare if inside else bare[4:].strip() if bare.startswith("use ") else ""
            if used and (member := _join("", used.strip('`"'))) is not None and not used.strip('`"').startswith("/"):
                add("go-member", "", (), 0, member)
    elif name == "oh-package.json5":
        value = plain_json(text)
        if isinstance(value, dict):
            add("ohpm-main", "", [value["main"].strip()] if _text(value.get("main")).strip() else [])
            own = value.get("dependencies")
            for key, target in (own.items() if isinstance(own, dict) else ()):
                if _text(target).startswith("file:") and target[5:].strip() and (to := _join(folder, target[5:].strip())) is not None:
                    add("ohpm", key, (), 0, to)
    return out


def read_config(manifests: DataFrame) -> DataFrame:
    """``config`` of the manifests (path, text) of a project."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in manifest_rows(path, text or "")]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["kind", "name", "folder", "values", "ord"])

    return manifests.select("path", "text").mapInArrow(run, CONFIG)


def packages(config: DataFrame) -> DataFrame:
    """(name, folder, entries, provenance, turn, whole): the workspace packages; ``whole``: a folder is a module by itself."""
    of = lambda kind: config.where(F.col("kind") == kind)

    def members(kind: str) -> Column:
        # The patterns are those of one manifest at the root.
        globs = [r["name"] for r in of(f"{kind}-members").select("name").distinct().collect()]
        return reduce(lambda a, b: a | b, [F.col("folder").rlike(glob_regex(g)) for g in globs], F.lit(False))

    npm = of("npm").where(members("npm")).select("name", "folder", "values")
    cargo = of("cargo").where(members("cargo")).select("name", "folder", "values")
    at = of("go-member").select("folder").union(of("go").where("folder = ''").select("folder")).distinct()
    go = of("go").join(at, "folder", "left_semi").select("name", "folder", "values")
    # A dependency that names different folders in different places is no answer.
    linked = of("ohpm").groupBy("name").agg(F.countDistinct("folder").alias("n"), F.min("folder").alias("folder")).where("n = 1").drop("n")
    linked = linked.join(npm.select("name"), "name", "left_anti").join(of("ohpm-main").select("folder", "values"), "folder", "left")
    linked = linked.select("name", "folder", F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    parts = []
    for turn, ((kind, provenance), rows) in enumerate(zip(PACKAGES, (npm, linked, cargo, go), strict=True)):
        fallbacks = F.array().cast("array<string>") if kind == "go" else F.array(*map(F.lit, FALLBACKS))
        parts.append(rows.select("name", "folder", F.concat("values", fallbacks).alias("entries"), F.lit(provenance).alias("provenance"), F.lit(turn).alias("turn"), F.lit(kind == "go").alias("whole")))
    return reduce(DataFrame.union, parts)


# --- paths ----------------------------------------------------------------------------------


def normalised(path: Column) -> Column:
    """A path without ``.`` and ``..``; null if it leaves the root."""
    parts = "struct<p:array<string>,ok:boolean>"
    seed = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok")).cast(parts)

    def step(s, x):
        up = F.struct(F.slice(s["p"], 1, F.greatest(F.size(s["p"]) - 1, F.lit(0))).alias("p"), (s["ok"] & (F.size(s["p"]) > 0)).alias("ok")).cast(parts)
        down = F.struct(F.array_append(s["p"], x).alias("p"), s["ok"].alias("ok")).cast(parts)
        return F.when(x.isin("", "."), s).when(x == "..", up).otherwise(down)

    return F.aggregate(F.split(path, "/"), seed, step, lambda s: F.when(s["ok"], F.array_join(s["p"], "/")))


def stem(path: Column) -> Column:
    """A path without its last extension; a name that only starts with a dot has none."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def below(folder: Column, path: Column) -> Column:
    return F.when(folder == "", path).when(path == "", folder).otherwise(F.concat(folder, F.lit("/"), path))


def python_hint(module: Column) -> Column:
    """A dotted module as a path: leading dots go up, the first to the file's own folder."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    return F.when(dots > 0, F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.lit("./"), rest)).otherwise(rest)


def probes(base: Column) -> Column:
    """Paths that a module path may stand for, in order."""
    plain = stem(base)
    own = [base, *(F.concat(plain, F.lit(f".{e}")) for e in SOURCE_EXTENSIONS)]
    inside = [f"__init__.{e}" for e in ("py", "pyi")] + [f"index.{e}" for e in SOURCE_EXTENSIONS]
    return F.when(base == "", F.array(*map(F.lit, inside))).otherwise(F.array(*own, *(F.concat(base, F.lit(f"/{i}")) for i in inside)))


def probed(bases: DataFrame, files: DataFrame) -> DataFrame:
    """(base, resolved): what each distinct base path (base) stands for among ``files`` (path), without extension."""
    tried = bases.select("base").where("base IS NOT NULL").distinct().select("base", F.posexplode(probes(F.col("base"))).alias("nth", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("base").agg(F.min_by("path", "nth").alias("path")).select("base", stem(F.col("path")).alias("resolved"))


# --- resolution -------------------------------------------------------------------------------


def _alias_candidates(hints: DataFrame, config: DataFrame) -> DataFrame:
    """(hint, base, turn) of the path alias that decides a hint: the longest prefix, an exact one before a pattern."""
    # A tsconfig hides a jsconfig, with or without aliases.
    own = config.where("kind = 'alias:tsconfig.json'").union(config.where("kind = 'alias:jsconfig.json'").join(F.broadcast(config.where("kind = 'tsconfig' AND name = 'tsconfig.json'").limit(1).select(F.lit(1).alias("x"))), F.lit(True), "left_anti"))
    star = F.instr("name", "*") > 0
    before = F.when(star, F.substring_index("name", "*", 1)).otherwise(F.col("name"))
    after = F.when(star, F.expr("substring(name, instr(name, '*') + 1)")).otherwise(F.lit(""))
    aliases = own.select(before.alias("prefix"), after.alias("suffix"), star.alias("star"), "values", F.col("folder").alias("url"), "ord")
    starts = hints.select("hint", F.explode(F.transform(F.sequence(F.lit(0), F.length("hint")), lambda n: F.substring("hint", 1, n))).alias("prefix"))
    rest = F.expr("substring(hint, length(prefix) + 1)")
    met = starts.join(aliases, "prefix").withColumn("rest", rest)
    met = met.where(F.when(F.col("star"), F.col("rest").endswith(F.col("suffix")) & (F.length("rest") >= F.length("suffix"))).otherwise(F.col("rest") == ""))
    order = F.struct(-F.length("prefix"), F.col("star"), F.col("ord"))
    best = met.groupBy("hint").agg(F.min_by(F.struct("rest", "suffix", "star", "values", "url"), order).alias("a"))
    held = F.expr("substring(a.rest, 1, length(a.rest) - length(a.suffix))")
    given = best.select("hint", held.alias("held"), "a.star", "a.url", F.posexplode("a.values").alias("turn", "to"))
    to = F.when(F.col("star") & (F.instr("to", "*") > 0), F.concat(F.substring_index("to", "*", 1), F.col("held"), F.expr("substring(to, instr(to, '*') + 1)"))).otherwise(F.col("to"))
    return given.where(~F.col("to").startswith("/")).select("hint", normalised(below(F.col("url"), to)).alias("base"), "turn")


def _package_candidates(hints: DataFrame, config: DataFrame) -> DataFrame:
    """(hint, base, provenance, turn, folder): per package that a hint names, its entries or the path inside; ``folder``: the path itself answers if it is a folder."""
    parts = F.split("hint", "/")
    names = hints.select("hint", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("name"))
    met = names.join(packages(config).withColumnRenamed("turn", "source_turn"), "name").withColumn("inside", F.expr("substring(hint, length(name) + 2)"))
    paths = F.when(F.col("inside") != "", F.array("inside")).when(F.col("whole"), F.array(F.lit(""))).otherwise(F.col("entries"))
    rows = met.select("hint", "provenance", "whole", "folder", F.col("name"), "source_turn", F.posexplode(paths).alias("nth", "path"))
    turn = F.struct(-F.length("name"), F.col("source_turn"), F.col("nth"))
    return rows.select("hint", normalised(below(F.col("folder"), F.col("path"))).alias("base"), "provenance", turn.alias("turn"), F.col("whole").alias("folder"))


def resolve_hints(asked: DataFrame, files: DataFrame, config: DataFrame) -> DataFrame:
    """(file, hint, resolved, provenance) of the hints in ``asked`` (file, hint) that name a file (path) or folder of the project; others have no row."""
    asked = asked.where("hint IS NOT NULL AND hint <> ''").select("file", "hint").distinct()
    near = F.col("hint").startswith("./") | F.col("hint").startswith("../")
    relative = asked.where(near).withColumn("base", normalised(below(parent(F.col("file")), F.col("hint"))))
    other = asked.where(~near).select("hint").distinct()
    aliases, own = _alias_candidates(other, config), _package_candidates(other, config)
    known = probed(relative.select("base").union(aliases.select("base")).union(own.select("base")), files)
    parts = F.split("path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))).alias("base")).distinct()
    found = relative.join(known, "base").select("file", "hint", "resolved", F.lit("project/relative-import").alias("provenance"))
    by_alias = aliases.join(known, "base").groupBy("hint").agg(F.min_by("resolved", "turn").alias("resolved")).withColumn("provenance", F.lit("tsconfig/path-alias"))
    whole = own.where("folder").join(folders, "base").select("hint", "provenance", F.struct("turn", F.lit(0).alias("late")).alias("turn"), F.col("base").alias("resolved"))
    entry = own.join(known, "base").select("hint", "provenance", F.struct("turn", F.lit(1).alias("late")).alias("turn"), "resolved")
    by_package = whole.union(entry).groupBy("hint").agg(F.min_by(F.struct("resolved", "provenance"), "turn").alias("r")).select("hint", "r.resolved", "r.provenance")
    by_package = by_package.join(by_alias.select("hint"), "hint", "left_anti")
    return found.unionByName(asked.where(~near).join(by_alias.unionByName(by_package), "hint"))


def canonical(rows: DataFrame, resolved: DataFrame, generic: str | None = None) -> DataFrame:
    """Observations (file, target_file_hint, provenance, explanation, ...) with their hints resolved; the way becomes the
    provenance, where ``generic`` is given only of rows that have that one."""
    way = F.create_map(*(F.lit(x) for kv in WAYS.items() for x in kv))
    r = resolved.select("file", F.col("hint").alias("target_file_hint"), F.col("resolved").alias("__to"), F.col("provenance").alias("__way"))
    met = rows.join(r, ["file", "target_file_hint"], "left")
    hit = F.col("__to").isNotNull()
    renamed = hit if generic is None else hit & (F.col("provenance") == generic)
    new = {
        "target_file_hint": F.coalesce("__to", "target_file_hint"),
        "provenance": F.when(renamed, F.col("__way")).otherwise(F.col("provenance")),
        "explanation": F.when(hit, F.concat("explanation", F.lit(" by "), way[F.col("__way")])).otherwise(F.col("explanation")),
    }
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))
