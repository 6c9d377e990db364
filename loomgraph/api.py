"""The engine: a tree of files indexed into versions of a graph, and the questions one can ask of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import budget
from .operators import chunks, graph, modules, resolve, search
from .plans.epochs import EpochStore
from .plans.lineage import cut
from .sources import extract, project
from .streaming.watch import sync

#: Fact tables and the column that names a row's file.
TABLES = {"symbols": "file", "references": "file", "calls": "file", "events": "file", "returns": "file", "routers": "file", "mounts": "file", "routes": "file", "formals": "owner_file", "arguments": "file", "invocations": "owner_file", "delegations": "file", "includes": "file", "contains": "evidence_file", "sources": "path"}
#: Raised when extraction or resolution changes, so that what an older one made is made anew.
MODEL_VERSION = 2


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str, config: str | None = None, ignore: str = ""):
        self.spark, self.root = spark, root
        self.facts, self.graph, self.content = (EpochStore(spark, f"{store}/{n}") for n in ("facts", "graph", "content"))
        self.config = project.ProjectConfig.parse(config)
        self.ignore = ignore

    def sync(self, force: bool = False) -> int:
        """Indexes what changed: facts per file, then resolution over the whole project; the content index follows.

        Facts that another ``MODEL_VERSION`` made are made anew; resolution runs again if facts, manifests or paths changed.
        """
        tree, rules = self._tree()
        files = cut(project.project_files(tree, self.config, rules))
        before, meta = self.facts.epoch, self.graph.meta()
        after = sync(self.facts, files, self._facts, TABLES, force or (meta["epoch"] > 0 and meta.get("model") != MODEL_VERSION))
        manifests = project.manifests(tree, modules.MANIFESTS)
        paths = cut(project.outside_built_in(tree).select("path"))
        setting = self._hash(manifests) + self._hash(paths)
        if after != before or not meta["epoch"] or meta.get("setting") != setting:
            config = cut(modules.read_config(manifests))
            self.graph.publish(self._resolved(paths, config), self.graph.epoch, facts_epoch=after, setting=setting, model=MODEL_VERSION)
        texts = project.content_files(tree, rules)
        keys = dict.fromkeys(("chunks", "postings", "lengths"), "path")
        sync(self.content, texts, self._content, keys, force, {"postings": search.by_token, "chunks": lambda t: t.orderBy("path", "ordinal")})
        return self.graph.epoch

    @staticmethod
    def _content(files: DataFrame) -> dict[str, DataFrame]:
        made = cut(chunks.content_chunks(files))
        return {"chunks": made} | search.search_index(made)

    def _tree(self) -> tuple[DataFrame, list[tuple[str, bool]]]:
        tree = project.tree(self.spark, self.root)
        return tree, project.ignore_files(tree, self.ignore)

    @staticmethod
    def _hash(rows: DataFrame) -> list[int]:
        return list(rows.select(F.xxhash64(*rows.columns).alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.pmod("h", F.lit(1_000_000_007)))).first())

    def _facts(self, files: DataFrame) -> dict[str, DataFrame]:
        facts = cut(extract.extract(files))
        tables = extract.tables(facts)
        owners = tables["symbols"].select(F.col("id").alias("owner_id"), F.col("file").alias("owner_file"))
        for name in ("formals", "invocations"):
            tables[name] = tables[name].join(owners, "owner_id")
        tables["sources"] = files.select("path", "language", "source")
        return tables

    def _resolved(self, paths: DataFrame, config: DataFrame) -> dict[str, DataFrame]:
        meta = self.facts.meta()
        t = {name: self.facts.read(name, meta) for name in TABLES}
        symbols = t["symbols"]
        hints = [t[n].select("file", F.col("target_file_hint").alias("hint")) for n in ("references", "calls")]
        routed = t["mounts"].withColumn("hint", modules.python_hint(F.col("child_hint")))
        # An absolute Python module is a path of the project, as it stands.
        near = cut(modules.resolve_hints(hints[0].union(hints[1]).union(routed.select("file", "hint")), paths, config))
        t["references"] = modules.canonical(t["references"], near)
        t["calls"] = modules.canonical(t["calls"], near, "syntax/call")
        imports, bindings = resolve.resolve_imports(t["references"], symbols)
        bindings = cut(bindings)
        heritage = cut(resolve.resolve_heritage(t["references"], symbols, bindings))
        functions = resolve.resolve_function_references(t["references"], symbols, bindings)
        calls, targets = resolve.resolve_calls(t["calls"], symbols, bindings, heritage, t["returns"])
        callable_ = symbols.where(F.col("kind").isin(*resolve.CALLABLE)).select(F.col("name").alias("callback_name"), F.col("id").alias("target_id"), "file")
        by_name = t["events"].where("callback_name IS NOT NULL").select("owner_id", "callback_name", "file").distinct()
        local = by_name.join(callable_, ["callback_name", "file"])
        imported = by_name.join(bindings.select("file", F.col("binding_name").alias("callback_name"), "target_id"), ["file", "callback_name"])
        handlers = local.select("owner_id", "callback_name", "target_id").unionByName(imported.select("owner_id", "callback_name", "target_id")).distinct()
        events = resolve.event_dispatch(t["events"], handlers)
        name = lambda c: F.concat_ws("#", "file", c)
        routers = t["routers"].select(name("name").alias("router"), "prefix", "application")
        whole = modules.probed(routed.where("hint IS NOT NULL AND NOT startswith(hint, '.')").select(F.col("hint").alias("base")), paths).withColumnRenamed("base", "hint")
        homes = t["routers"].select(F.col("file").alias("home"), modules.stem(F.col("file")).alias("stem"), F.col("name").alias("child"))
        away = routed.where("hint IS NOT NULL").join(near.select("file", "hint", F.col("resolved").alias("r1")), ["file", "hint"], "left").join(whole.withColumnRenamed("resolved", "r2"), "hint", "left")
        away = away.withColumn("stem", F.coalesce("r1", "r2")).join(homes, ["stem", "child"])
        mounts = t["mounts"].where("child_hint IS NULL").select(name("parent").alias("parent"), name("child").alias("child"), "prefix")
        mounts = mounts.union(away.select(name("parent"), F.concat_ws("#", "home", "child"), "prefix"))
        routes = t["routes"].withColumn("router", name("router"))
        made, route_edges = resolve.materialize_routes(routes, resolve.router_prefixes(routers, mounts), symbols)
        targets = cut(targets)
        callbacks = resolve.callback_edges(t["arguments"], targets, t["formals"], t["invocations"], t["delegations"], symbols, bindings)
        inline = resolve.deferred_inline(targets, symbols.limit(0))
        included = resolve.resolve_includes(t["includes"].select("file", "include", "quoted").distinct(), paths)
        ends = symbols.where("kind = 'file'").select("file", "id")
        headers = t["includes"].join(included, ["file", "include"]).join(ends.withColumnRenamed("id", "source_id"), "file").join(ends.toDF("target", "target_id"), "target")
        headers = resolve.edges(headers.withColumn("evidence_file", F.col("file")).withColumn("evidence_line", F.col("line")), "imports", "syntax/include", 0.98, F.concat(F.lit("includes "), "include"))
        every = [t["contains"], imports, headers, heritage, functions, calls, inline, callbacks, resolve.interface_dispatch(symbols, heritage), events, route_edges]
        return {"symbols": symbols.unionByName(made), "relationships": resolve.upsert_edges(every), "sources": t["sources"]}

    def _read(self, table: str) -> DataFrame:
        return self.graph.read(table)

    def search(self, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
        return search.symbol_search(self._read("symbols"), query, limit, kind)

    def content_search(self, query: str, limit: int = 10) -> DataFrame:
        meta = self.content.meta()
        index = {name: self.content.read(name, meta) for name in ("postings", "lengths")}
        return search.indexed_search(index, self.content.read("chunks", meta), query, limit)

    def find_symbols(self, query: str) -> DataFrame:
        return graph.find_symbols(self._read("symbols"), query)

    def _named(self, symbol: str, kind: str, incoming: bool, file: str | None, limit: int) -> DataFrame:
        return graph.named(self._read("symbols"), self._read("relationships"), symbol, kind, incoming, file, limit)

    def callers(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._named(symbol, "calls", True, file, limit)

    def callees(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._named(symbol, "calls", False, file, limit)

    def referenced_by(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._named(symbol, "references", True, file, limit)

    def references(self, symbol: str, file: str | None = None, limit: int = 20) -> DataFrame:
        return self._named(symbol, "references", False, file, limit)

    def impact(self, symbol: str, file: str | None = None, depth: int = 2) -> DataFrame:
        return graph.impact(self._read("symbols"), self._read("relationships"), symbol, file, depth)

    def trace_path(self, source: str, target: str, source_file: str | None = None, target_file: str | None = None, depth: int = 6) -> graph.Trace:
        return graph.trace(self._read("symbols"), self._read("relationships"), source, target, source_file, target_file, depth)

    def explore(self, query: str, max_files: int = 20) -> tuple[DataFrame, DataFrame]:
        budget.limit(max_files)
        symbols = self._read("symbols")
        hits = search.symbol_search(symbols, query, 4 * max_files, candidates=True)
        return graph.explore(symbols, self._read("relationships"), hits, max_files)

    def research(self, query: str, max_files: int = 12) -> DataFrame:
        """Symbol and content hits within one budget of distinct files; more than 50 files is an error."""
        budget.limit(max_files)
        budget.limit(2 * max_files)
        hits = search.symbol_search(self._read("symbols"), query, 4 * max_files, candidates=True).select("file", F.col("id").alias("hit"), "score", F.lit(0).alias("source"))
        content = self.content_search(query, 2 * max_files).select(F.col("path").alias("file"), F.col("start_line").cast("string").alias("hit"), "score", F.lit(1).alias("source"))
        return graph.first_files(hits.union(content), [F.asc("source"), F.desc("score"), F.asc("file"), F.asc("hit")], max_files).orderBy("file", "source", F.desc("score"))

    def node_of(self, symbol: str, file: str | None = None) -> DataFrame:
        """The symbols of a name with their source, of at most 64,000 characters each; ``cut`` tells where there is more."""
        found = graph.find_symbols(self._read("symbols"), symbol).where(graph.in_file(F.col("file"), file))
        rows = found.join(self._read("sources").select(F.col("path").alias("file"), "source"), "file", "left")
        text = F.array_join(F.slice(F.split("source", "\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
        rows = rows.withColumn("text", text)
        return rows.select("id", "kind", "qualified_name", "file", "start_line", "end_line", F.substring("text", 1, budget.MAX_NODE_CHARS).alias("text"), (F.length("text") > budget.MAX_NODE_CHARS).alias("cut")).orderBy("qualified_name", "file", "id")

    def explore_text(self, query: str, max_files: int = 20, most: int = budget.MAX_NODE_CHARS) -> str:
        """The findings of ``explore`` as one text within a budget of characters: files, their symbols, and each one's relationships."""
        kept, found = self.explore(query, max_files)
        near: dict[str, list[str]] = {}
        for r in found.orderBy("origin_id", "direction", "nth").collect():  # at most 32 a hit
            near.setdefault(r["origin_id"], []).append(f"    {r['direction']}: {r['qualified_name']} ({r['file']}, {r['confidence']:.2f})" + (" ..." if r["truncated"] else ""))
        out, file = [], None
        for r in kept.orderBy("file_no", F.desc("score"), "id").collect():  # within the candidate limit
            if r["file"] != file:
                file = r["file"]
                out.append(file)
            out += [f"  {r['kind']} {r['qualified_name']} (line {r['start_line']})", *near.get(r["id"], [])]
        text = "\n".join(out)
        return text if len(text) <= most else text[: text.rfind("\n", 0, most - 4) + 1] + "..."

    def node(self, file: str, offset: int = 1, limit: int = budget.MAX_NODE_LINES) -> DataFrame:
        """Lines of an indexed source file."""
        budget.between(limit, budget.MAX_NODE_LINES, "node line limit")
        lines = self._read("sources").where(F.col("path") == file).select("path", F.posexplode(F.split("source", "\n")).alias("n", "line"))
        return lines.select("path", (F.col("n") + 1).alias("line_no"), "line").where((F.col("line_no") >= offset) & (F.col("line_no") < offset + limit)).orderBy("line_no")

    def files(self, prefix: str | None = None, glob: str | None = None, limit: int = 1000) -> DataFrame:
        return graph.files(self._read("symbols"), self._read("sources"), prefix, glob, limit)

    def status(self) -> dict:
        meta = self.graph.meta()
        tree, rules = self._tree()
        pending = project.delta(project.project_files(tree, self.config, rules), self.facts.read("files"))
        return {"epoch": meta["epoch"], "symbols": self.graph.read("symbols", meta).count(), "relationships": self.graph.read("relationships", meta).count(), "files": self.facts.read("files").count(), "pending": pending.count()}

    def quality(self, expected: DataFrame) -> DataFrame:
        """Precision and recall of (language, caller, callee) names against this graph's same-language calls."""
        s = self._read("symbols").select("id", "name", "language")
        calls = self._read("relationships").where("kind = 'calls'").select("source_id", "target_id")
        found = calls.join(s.toDF("source_id", "caller", "language"), "source_id").join(s.toDF("target_id", "callee", "other"), "target_id").where("language = other")
        wanted = found.join(F.broadcast(expected.select("language").distinct()), "language", "left_semi")
        return graph.quality(expected, wanted)
