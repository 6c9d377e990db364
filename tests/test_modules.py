"""Imports made into files: aliases, packages, relative paths."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import modules

MANIFESTS = {
    "tsconfig.json": '{ // comment\n "compilerOptions": { "baseUrl": "./web", "paths": { "@/*": ["gone/*", "src/*"], "@/special": ["src/one"], "*.style": ["css/*"], "up/*": ["../../*"], "exact": ["src/app.ts",], }, }, /* "x": 1 */ }',
    "jsconfig.json": '{"compilerOptions": {"paths": {"never/*": ["web/src/*"]}}}',
    "package.json": '{"workspaces": {"packages": ["packages/*/"]}}',
    "pnpm-workspace.yaml": "packages:\n  - \"libs/**\"\n  - \"!libs/no\"\nother:\n  - x\n",
    "packages/ui/package.json": '{"name": "@acme/ui", "main": "./lib/main.js", "types": "types.d.ts"}',
    "packages/uikit/package.json": '{"name": "@acme/ui/kit"}',
    "tools/package.json": '{"name": "outside"}',
    "libs/a/b/package.json": '{"name": "deep"}',
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\n',
    "crates/my-core/Cargo.toml": '[package]\nname = "my-core"\n',
    "go.work": "go 1.22\nuse (\n  ./svc // here\n)\nuse ./gone\n",
    "svc/go.mod": "module example.com/svc\n\ngo 1.22\n",
    "entry/oh-package.json5": '{"dependencies": {"@ohos/common": "file:../common", "twice": "file:../common", "npm": "1.0"}}',
    "feature/oh-package.json5": '{"dependencies": {"twice": "file:../entry"}}',
    "common/oh-package.json5": '{"main": "Index.ets"}',
    "broken/package.json": "{",
}
FILES = [
    *MANIFESTS, "web/src/one.ts", "web/src/special.ts", "web/src/app.ts", "web/src/dir/index.tsx", "web/src/dir/x.js", "web/css/a.vue", "web/src/data.json",
    "packages/ui/lib/main.js", "packages/ui/src/button.tsx", "packages/uikit/src/index.ts", "libs/a/b/index.js", "crates/my-core/src/lib.rs", "crates/my-core/src/io.rs",
    "svc/api/handler.go", "svc/main.go", "common/Index.ets", "app/main.py", "app/pkg/__init__.py", "app/pkg/util.py", "web/src/foo.service.ts", "tools/index.ts",
]
WANT = {
    ("web/src/app.ts", "./one"): ("web/src/one", "project/relative-import"),
    ("web/src/app.ts", "./one.js"): ("web/src/one", "project/relative-import"),
    ("web/src/app.ts", "./dir"): ("web/src/dir/index", "project/relative-import"),
    ("web/src/dir/x.js", "../data.json"): ("web/src/data", "project/relative-import"),
    ("web/src/dir/x.js", "../../../../x"): None,
    ("web/src/app.ts", "./none"): None,
    ("web/src/app.ts", "./foo.service"): None,
    ("app/main.py", "./pkg"): ("app/pkg/__init__", "project/relative-import"),
    ("a.ts", "@/special"): ("web/src/one", "tsconfig/path-alias"),
    ("a.ts", "@/app"): ("web/src/app", "tsconfig/path-alias"),
    ("a.ts", "@/dir"): ("web/src/dir/index", "tsconfig/path-alias"),
    ("a.ts", "@/nothing"): None,
    ("a.ts", "exact"): ("web/src/app", "tsconfig/path-alias"),
    ("a.ts", "a.style"): ("web/css/a", "tsconfig/path-alias"),
    ("a.ts", "up/app/main"): None,
    ("a.ts", "never/app"): None,
    ("a.ts", "@acme/ui"): ("packages/ui/lib/main", "workspace/package"),
    ("a.ts", "@acme/ui/src/button"): ("packages/ui/src/button", "workspace/package"),
    ("a.ts", "@acme/ui/kit"): ("packages/uikit/src/index", "workspace/package"),
    ("a.ts", "outside"): None,
    ("a.ts", "deep"): ("libs/a/b/index", "workspace/package"),
    ("m.rs", "my_core"): ("crates/my-core/src/lib", "cargo/workspace"),
    ("m.rs", "my_core/src/io"): ("crates/my-core/src/io", "cargo/workspace"),
    ("m.go", "example.com/svc"): ("svc", "go/workspace"),
    ("m.go", "example.com/svc/api"): ("svc/api", "go/workspace"),
    ("m.go", "example.com/svc/none"): None,
    ("e.ets", "@ohos/common"): ("common/Index", "harmony/ohpm"),
    ("e.ets", "twice"): None,
    ("a.ts", "react"): None,
    ("a.ts", ""): None,
}


@pytest.fixture(scope="module")
def config(spark):
    return modules.read_config(spark.createDataFrame(list(MANIFESTS.items()), "path string, text string")).cache()


def test_hints_become_files(spark, config):
    asked = spark.createDataFrame([*WANT, ("a.ts", None), ("a.ts", "deep")], "file string, hint string")
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    got = {(r.file, r.hint): (r.resolved, r.provenance) for r in modules.resolve_hints(asked, files, config).collect()}
    assert got == {k: v for k, v in WANT.items() if v}


def test_without_manifests(spark):
    asked = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "lib")], "file string, hint string")
    files = spark.createDataFrame([("src/b.tsx",), ("lib/index.ts",)], "path string")
    none = modules.read_config(spark.createDataFrame([], "path string, text string"))
    assert [tuple(r) for r in modules.resolve_hints(asked, files, none).collect()] == [("src/a.ts", "./b", "src/b", "project/relative-import")]
    assert modules.resolve_hints(asked.limit(0), files, none).count() == 0


def test_canonical_rows(spark):
    rows = spark.createDataFrame([("a.ts", "./b", "syntax/import", "imports x"), ("a.ts", "c", "other", "y"), ("a.ts", None, "other", "z")], "file string, target_file_hint string, provenance string, explanation string")
    resolved = spark.createDataFrame([("a.ts", "./b", "b", "project/relative-import"), ("a.ts", "c", "lib/c", "workspace/package")], "file string, hint string, resolved string, provenance string")
    got = sorted(tuple(r) for r in modules.canonical(rows, resolved, "syntax/import").select("target_file_hint", "provenance", "explanation").fillna("").collect())
    assert got == [("", "other", "z"), ("b", "project/relative-import", "imports x by a relative path"), ("lib/c", "other", "y by a workspace package")]


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b/../c",), ("../x",), ("",), ("a/../..",), ("a//b",)], "p string")
    assert [r.n for r in rows.select(modules.normalised(F.col("p")).alias("n")).collect()] == ["a/c", None, "", None, "a/b"]
    names = ["a/b.ts", ".env", "a.b/c", "a/.x.y", "f"]
    assert [r.s for r in spark.createDataFrame([(n,) for n in names], "p string").select(modules.stem(F.col("p")).alias("s")).collect()] == ["a/b", ".env", "a.b/c", "a/.x", "f"]
    dotted = [".x.y", "..x", "a.b", "."]
    assert [r.s for r in spark.createDataFrame([(n,) for n in dotted], "p string").select(modules.python_hint(F.col("p")).alias("s")).collect()] == ["./x/y", ".././x", "a/b", "./"]
