"""Resolution of unresolved observations into relationships with evidence.

All operators are joins on equal keys, followed by ranks and counts over the
observation.  Names can be common (``get``, ``run``), and an observation with more
candidates than its fan-out limit has no answer: so candidates are counted per name
and place first (``counted``), and only observations within the limit are paired.

``symbols``: id, language, kind, name, qualified_name, file, start_line, ...
``calls``: call_id, file, caller_id, fallback_caller_id, callee_name,
receiver_binding, receiver_type, receiver_call_start_byte, target_file_hint,
provenance, confidence, explanation, resolvable, evidence_file, evidence_line,
start_byte.
``references``: ref_id, file, source_id, target_name, binding_name,
target_file_hint, kind, provenance, confidence, explanation, evidence_file,
evidence_line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Fan-out limits and bounds.
CALL_FANOUT, REFERENCE_FANOUT, INTERFACE_FANOUT, EVENT_FANOUT, C_TARGETS = 6, 8, 8, 6, 300
INHERITANCE_DEPTH, INHERITANCE_NODES, CHAIN_DEPTH = 8, 64, 16
CALL_RESULT_CAP = 100_000
#: Languages whose symbols another language may import.
WEB = {"astro": ("typescript", "tsx", "javascript", "jsx")}
NOMINAL = ("class", "interface", "struct", "trait", "enum", "type")
CALLABLE = ("function", "method", "component")

EDGE = ["source_id", "target_id", "kind", "provenance", "confidence", "explanation", "evidence_file", "evidence_line", "evidence_site"]
EDGE_KEY = ["source_id", "target_id", "kind", "provenance", "evidence_file", "evidence_line", "evidence_site"]


def edges(rows: DataFrame, kind, provenance, confidence, explanation, site=0) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "source_id",
        "target_id",
        as_column(kind).alias("kind"),
        as_column(provenance).alias("provenance"),
        as_column(confidence).cast("double").alias("confidence"),
        as_column(explanation).alias("explanation"),
        "evidence_file",
        F.col("evidence_line").cast("long").alias("evidence_line"),
        as_column(site).cast("long").alias("evidence_site"),
    )


def upsert_edges(parts: list[DataFrame]) -> DataFrame:
    """All edges, the last part's where two have the same evidence key."""
    numbered = reduce(DataFrame.unionByName, [p.select(*EDGE, F.lit(i).alias("__part")) for i, p in enumerate(parts)])
    last = F.max(F.struct("__part", "confidence", "explanation")).alias("__last")
    return numbered.groupBy(*EDGE_KEY).agg(last).select(*EDGE_KEY, "__last.confidence", "__last.explanation").select(*EDGE)


def _plain_hint(hint: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(hint), F.lit("\\"), F.lit("/")), "^['\"]+|['\"]+$", "")


def hint_matches(hint: Column, file: Column) -> Column:
    """Whether a module hint names a file: the path, its stem, a folder above the stem, or its tail.  A hint that is still relative names none."""
    plain = _plain_hint(hint)
    stem = _without_extension(file)
    tail = F.concat(F.lit("/"), plain)
    found = (file == plain) | (stem == plain) | stem.startswith(F.concat(plain, F.lit("/"))) | stem.endswith(tail) | stem.endswith(F.concat(tail, F.lit("/index")))
    return ~plain.rlike(r"^\.\.?/") & found


def compatible(source: Column, target: Column) -> Column:
    web = reduce(lambda a, b: a | b, [(source == s) & target.isin(*t) for s, t in WEB.items()])
    ark = source.isin("arkts", "typescript") & target.isin("arkts", "typescript")
    return (source == target) | ark | web


def _count_over(*keys: str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))


def _without_extension(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def _tails(parts: Column) -> Column:
    """Every run of path parts that ends with the last one and doesn't start with the first."""
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, n), "/"))).otherwise(F.array().cast("array<string>"))


def place_keys(file: Column) -> Column:
    """All module hints that ``hint_matches`` would let name the file, with a mark before each, and the empty key for no hint."""
    stem = _without_extension(file)
    parts = F.split(stem, "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))
    index = F.when(F.element_at(parts, -1) == "index", _tails(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(file, stem), above, _tails(parts), index))
    return F.concat(F.array(F.lit("")), F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("@"), k)))


def hint_key(hint: Column) -> Column:
    """The key among ``place_keys`` that a hint asks for; null for one that is still relative and so names no file."""
    plain = _plain_hint(hint)
    return F.when(F.coalesce(hint, F.lit("")) == "", F.lit("")).when(~plain.rlike(r"^\.\.?/"), F.concat(F.lit("@"), plain))


def counted(asked: DataFrame, target: DataFrame, on: list[str], most: int, fits: Column, spare: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pairs of distinct ``asked`` rows and ``target`` rows that are equal ``on`` columns and fit, for those asked rows with
    at most ``most + spare`` of them; and (of those with more) the asked rows themselves.

    ``spare`` allows for candidates that drop out afterwards, such as the source itself.  ``fits`` may use columns of
    ``asked`` and ``target_language``; targets are counted per key and language before anything is paired.
    """
    sums = target.groupBy(*on, "target_language").agg(F.count("*").alias("__n"))
    whole = asked.join(sums, on).where(fits).groupBy(*asked.columns).agg(F.sum("__n").alias("__n"))
    whole = cut(whole)
    few = whole.where(F.col("__n") <= most + spare).drop("__n")
    return few.join(target, on).where(fits), whole.where(F.col("__n") > most + spare).drop("__n")


def resolve_imports(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and bindings (file, binding_name, target_id, confidence) of import references: up to 8 matches, 0.55 at most where there are several."""
    own = references.where("kind = 'imports' AND coalesce(target_file_hint, '') <> 'framework/arkui-entry'")
    source = symbols.select(F.col("id").alias("source_id"), F.col("language").alias("source_language"))
    target = symbols.select(F.col("name").alias("target_name"), F.col("id").alias("target_id"), F.col("language").alias("target_language"), "file", F.col("qualified_name").alias("target_qualified"))
    named = own.join(source, "source_id").withColumn("place", hint_key(F.col("target_file_hint"))).where("place IS NOT NULL")
    asked = cut(named.select("target_name", "place", "source_language").distinct())
    # Places are spelled out for symbols only whose name is asked for with one.
    target = target.join(asked.select("target_name", (F.col("place") != "").alias("placed")).distinct(), "target_name")
    target = target.withColumn("place", F.explode(F.when(F.col("placed"), F.filter(place_keys(F.col("file")), lambda k: k != "")).otherwise(F.array(F.lit(""))))).drop("file", "placed")
    found, _ = counted(asked, target, ["target_name", "place"], REFERENCE_FANOUT, compatible(F.col("source_language"), F.col("target_language")))
    rows = named.join(found.drop("target_language"), ["target_name", "place", "source_language"]).where(F.col("source_id") != F.col("target_id"))
    rows = rows.withColumn("n", _count_over("ref_id")).where(F.col("n") <= REFERENCE_FANOUT)
    confidence = F.when(F.col("n") == 1, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.55)))
    bindings = rows.groupBy("file", "binding_name", "target_id").agg(F.max(confidence).alias("confidence"))
    return edges(rows, "imports", F.col("provenance"), confidence, F.concat("explanation", F.lit(" -> "), "target_qualified")), bindings


def resolve_heritage(references: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Extends and implements: same file, else imported under that name, else the only symbol of that name; up to 8."""
    own = references.where("kind IN ('extends', 'implements')")
    source = symbols.select(F.col("id").alias("source_id"), F.col("language").alias("source_language"))
    target = symbols.where(F.col("kind").isin(*NOMINAL)).select(F.col("name").alias("target_name"), F.col("id").alias("target_id"), F.col("language").alias("target_language"), F.col("file").alias("target_file"), F.col("qualified_name").alias("target_qualified"))
    asked = own.join(source, "source_id")
    local = asked.join(target.withColumnRenamed("target_file", "file"), ["target_name", "file"]).withColumn("tier", F.lit(0))
    by_name = bindings.select("file", F.col("binding_name").alias("target_name"), "target_id")
    imported = asked.join(by_name, ["file", "target_name"]).join(target.drop("target_name", "target_file"), "target_id").withColumn("tier", F.lit(1))
    # A name with more than one symbol of a language can't be globally unique: counted before it is paired.
    unique = target.withColumn("n", _count_over("target_name", "target_language")).where("n = 1").drop("n", "target_file")
    everywhere = asked.join(unique, "target_name").where(compatible(F.col("source_language"), F.col("target_language"))).withColumn("tier", F.lit(2))
    rows = reduce(DataFrame.unionByName, (r.where("source_id <> target_id") for r in (local, imported, everywhere))).dropDuplicates(["ref_id", "target_id", "tier"])
    best = rows.withColumn("best", F.min("tier").over(Window.partitionBy("ref_id"))).where("tier = best")
    best = best.withColumn("n", _count_over("ref_id")).where((F.col("n") <= REFERENCE_FANOUT) & ((F.col("tier") < 2) | (F.col("n") == 1)))
    confidence = F.when(F.col("n") == 1, F.col("confidence")).otherwise(F.least("confidence", F.lit(0.55)))
    return edges(best, F.col("kind"), F.col("provenance"), confidence, F.concat("explanation", F.lit(" -> "), "target_qualified"))


def resolve_function_references(references: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """References to callables: same file before imported before any other, and exactly one at the best of these."""
    own = references.where("kind = 'references'")
    source = symbols.select(F.col("id").alias("source_id"), F.col("language").alias("source_language"))
    target = symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("name").alias("target_name"), F.col("id").alias("target_id"), F.col("language").alias("target_language"), F.col("file").alias("target_file"), F.col("qualified_name").alias("target_qualified"))
    asked = own.join(source, "source_id")
    fits = compatible(F.col("source_language"), F.col("target_language"))
    local = asked.join(target.withColumn("file", F.col("target_file")), ["target_name", "file"]).where(fits).withColumn("rank", F.lit(0))
    by_name = bindings.select("file", F.col("binding_name").alias("target_name"), "target_id").distinct()
    imported = asked.join(by_name, ["file", "target_name"]).join(target.drop("target_name"), "target_id").withColumn("rank", F.lit(1))
    near = local.unionByName(imported).where("source_id <> target_id")
    # Elsewhere only a name with one symbol answers (two, should the source be one of them).
    far = asked.join(near.select("ref_id").distinct(), "ref_id", "left_anti")
    pairs, _ = counted(far.select("target_name", "source_language").distinct(), target, ["target_name"], 1, fits)
    elsewhere = far.join(pairs, ["target_name", "source_language"]).where("source_id <> target_id").withColumn("rank", F.lit(2))
    rows = near.unionByName(elsewhere, allowMissingColumns=True)
    rows = rows.groupBy("ref_id", "target_id").agg(F.min("rank").alias("rank"), *(F.first(c).alias(c) for c in ("source_id", "provenance", "confidence", "explanation", "evidence_file", "evidence_line", "target_qualified")))
    best = rows.withColumn("best", F.min("rank").over(Window.partitionBy("ref_id"))).where("rank = best").withColumn("n", _count_over("ref_id")).where("n = 1")
    return edges(best, "references", F.col("provenance"), F.col("confidence"), F.concat("explanation", F.lit(" -> "), "target_qualified"))


def _nominal(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """The receiver's type per call signature: (sig, receiver_id, receiver_state), state being unique or ambiguous; local types hide imported ones."""
    types = symbols.where(F.col("kind").isin(*NOMINAL)).select(F.col("name").alias("receiver_type"), F.col("id").alias("receiver_id"), F.col("file").alias("type_file"), F.col("qualified_name").alias("type_qualified"))
    typed = calls.where("receiver_type <> ''").select("sig", "file", "receiver_type", "target_file_hint")
    local = typed.join(types.withColumn("file", F.col("type_file")), ["file", "receiver_type"]).where("target_file_hint = ''").withColumn("tier", F.lit(0))
    imported = typed.join(bindings.select("file", F.col("binding_name").alias("receiver_type"), F.col("target_id").alias("receiver_id")).distinct(), ["file", "receiver_type"])
    imported = imported.join(types.drop("receiver_type"), "receiver_id").where((F.col("target_file_hint") == "") | hint_matches(F.col("target_file_hint"), F.col("type_file"))).withColumn("tier", F.lit(1))
    both = local.select("sig", "receiver_id", "tier").union(imported.select("sig", "receiver_id", "tier"))
    best = both.withColumn("best", F.min("tier").over(Window.partitionBy("sig"))).where("tier = best")
    found = best.groupBy("sig").agg(F.min("receiver_id").alias("receiver_id"), F.countDistinct("receiver_id").alias("n"))
    return found.select("sig", F.when(F.col("n") == 1, F.col("receiver_id")).alias("receiver_id"), F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("receiver_state"))


def inherited_members(asked: DataFrame, heritage: DataFrame, methods: DataFrame) -> DataFrame:
    """(type_id, name) -> (member_id, state): the member of the nearest base that has one, up to 8 levels of ``extends``.

    Several members on the nearest level, or a type met twice, make the answer ambiguous.
    """
    frontier = cut(asked.select("type_id", "name").distinct().withColumn("at", F.col("type_id")).withColumn("seen", F.array("type_id")))
    if frontier.isEmpty():
        return frontier.select("type_id", "name", F.lit(None).cast("string").alias("member_id"), F.lit("unique").alias("state"))
    bases = heritage.where("kind = 'extends'").select(F.col("source_id").alias("at"), F.col("target_id").alias("base")).distinct()
    done = None
    for _ in range(INHERITANCE_DEPTH):
        step = frontier.join(bases, "at")
        step = step.withColumn("cycle", F.array_contains("seen", F.col("base"))).withColumn("seen", F.array_union("seen", F.array("base")))
        step = step.select("type_id", "name", F.col("base").alias("at"), "seen", "cycle")
        hit = step.join(methods.select(F.col("type_id").alias("at"), "name", "member_id"), ["at", "name"], "left")
        level = hit.groupBy("type_id", "name").agg(F.min("member_id").alias("member_id"), F.countDistinct("member_id").alias("n"), F.max("cycle").alias("cycle"), F.max(F.size("seen")).alias("size"))
        level = cut(level.withColumn("state", F.when(F.col("cycle") | (F.col("n") > 1) | (F.col("size") > INHERITANCE_NODES), "ambiguous").when(F.col("n") == 1, "unique")))
        ended = level.where("state IS NOT NULL").select("type_id", "name", F.when(F.col("state") == "unique", F.col("member_id")).alias("member_id"), "state")
        done = ended if done is None else done.union(ended)
        frontier = cut(step.drop("cycle").join(level.where("state IS NULL").select("type_id", "name"), ["type_id", "name"]))
        if frontier.isEmpty():
            break
    return done


def resolve_calls(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, heritage: DataFrame, returns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Call edges and the targets of each call (call_id, target_id, target_qualified, confidence, scope, explanation).

    Tiers are a cascade: a later one counts only where the earlier ones found nothing.
    0 receiver or hint, 5 nearest inherited member, 1 same file, 2 imported, 4 any of the
    language.  More than 6 candidates at the deciding tier are no answer.  Equal calls of a file
    are resolved once and joined back.

    ``returns`` (owner_id, file, type_name): calls on another call's result are resolved in a second
    pass, from the first one's only target and its declared type.
    """
    alive = symbols.select(F.col("id").alias("caller"), "language")
    rows = calls.where("resolvable").join(alive.withColumnsRenamed({"caller": "caller_id", "language": "l1"}), "caller_id", "left").join(alive.withColumnsRenamed({"caller": "fallback_caller_id", "language": "l2"}), "fallback_caller_id", "left")
    rows = rows.where("l1 IS NOT NULL OR l2 IS NOT NULL").withColumn("source_id", F.when(F.col("l1").isNotNull(), F.col("caller_id")).otherwise(F.col("fallback_caller_id"))).withColumn("language", F.coalesce("l1", "l2")).drop("l1", "l2")
    for c in ("receiver_binding", "receiver_type", "target_file_hint"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    escaped = F.col("provenance").startswith("framework/astro-template") & F.col("target_file_hint").rlike(r"^\.\.?/")
    rows = rows.where(~escaped).withColumn("inferred", F.lit(1.0)).withColumn("via", F.lit(None).cast("string"))
    first = rows.where("receiver_call_start_byte IS NULL")
    targets = cut(_resolve(_infer_receivers(first, symbols, bindings), symbols, bindings, heritage))
    second = rows.where("receiver_call_start_byte IS NOT NULL")
    if returns is not None and 0 < second.limit(CALL_RESULT_CAP + 1).count() <= CALL_RESULT_CAP:
        again = _from_results(second, targets, returns, symbols, bindings)
        targets = targets.unionByName(_resolve(again, symbols, bindings, heritage, one_only=True))
    # Where an inline callback stands between, the edge waits for its owner.
    direct = targets.where("fallback_caller_id IS NULL")
    clear = F.concat("explanation", F.lit(" -> "), "target_qualified", F.lit(" ("), "scope", F.lit(")"))
    vague = F.concat("explanation", F.lit(" -> maybe "), "target_qualified", F.lit(" (one of several, "), "scope", F.lit(")"))
    made = edges(direct, "calls", F.col("provenance"), F.col("confidence"), F.when(F.col("confidence") >= 0.75, clear).otherwise(vague))
    return made, targets.select("call_id", "file", "start_byte", "source_id", "fallback_caller_id", "target_id", "target_qualified", "confidence", "scope", "explanation", "provenance", "evidence_file", "evidence_line")


def deferred_inline(targets: DataFrame, inline: DataFrame) -> DataFrame:
    """Edges of calls inside inline callbacks: from the callback where it became a symbol (``inline``: id), else from the function around it."""
    rows = targets.where("fallback_caller_id IS NOT NULL").join(inline.select(F.col("id").alias("source_id"), F.lit(True).alias("made")), "source_id", "left")
    rows = rows.withColumn("source_id", F.when(F.col("made"), F.col("source_id")).otherwise(F.col("fallback_caller_id")))
    return edges(rows, "calls", F.col("provenance"), F.col("confidence"), F.concat("explanation", F.lit(" -> "), "target_qualified", F.lit(" ("), "scope", F.lit(")")))


def _infer_receivers(calls: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """An untyped receiver that is exactly one imported type has that type, at 0.97."""
    types = symbols.where(F.col("kind").isin(*NOMINAL)).select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file"))
    only = bindings.join(types, "target_id").groupBy("file", F.col("binding_name").alias("receiver_binding")).agg(F.countDistinct("target_id").alias("n"), F.min("t_name").alias("t_name"), F.min("t_file").alias("t_file")).where("n = 1").drop("n")
    rows = calls.join(only, ["file", "receiver_binding"], "left")
    found = (F.col("receiver_type") == "") & (F.col("receiver_binding") != "") & F.col("t_name").isNotNull()
    return rows.withColumn("inferred", F.when(found, F.lit(0.97)).otherwise(F.col("inferred"))).withColumn("target_file_hint", F.when(found, F.col("t_file")).otherwise(F.col("target_file_hint"))).withColumn("receiver_type", F.when(found, F.col("t_name")).otherwise(F.col("receiver_type"))).drop("t_name", "t_file")


def _from_results(calls: DataFrame, targets: DataFrame, returns: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls on a result, with the receiver type its factory declares."""
    site = targets.groupBy(F.col("file"), F.col("source_id"), F.col("start_byte").alias("receiver_call_start_byte")).agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("owner_id"), F.min("confidence").alias("f_confidence"), F.min("target_qualified").alias("f_name"), F.min("scope").alias("f_scope")).where("n = 1").drop("n")
    types = symbols.where(F.col("kind").isin(*NOMINAL)).select(F.col("id").alias("type_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file"))
    declared = returns.select("owner_id", F.col("file").alias("r_file"), F.col("type_name").alias("r_type"))
    local = declared.join(types, (F.col("r_file") == F.col("t_file")) & (F.col("r_type") == F.col("t_name"))).select("owner_id", "type_id", "t_name", "t_file", F.lit(0.995).alias("t_confidence"))
    by_name = bindings.select(F.col("file").alias("r_file"), F.col("binding_name").alias("r_type"), F.col("target_id").alias("type_id")).distinct()
    imported = declared.join(by_name, ["r_file", "r_type"]).join(types, "type_id").select("owner_id", "type_id", "t_name", "t_file", F.lit(0.97).alias("t_confidence"))
    nominal = local.union(imported).groupBy("owner_id").agg(F.countDistinct("type_id").alias("n"), F.min("t_name").alias("t_name"), F.min("t_file").alias("t_file"), F.max("t_confidence").alias("t_confidence")).where("n = 1").drop("n")
    rows = calls.join(site, ["file", "source_id", "receiver_call_start_byte"]).join(nominal, "owner_id")
    return rows.select(
        *(c for c in calls.columns if c not in ("receiver_type", "target_file_hint", "inferred", "via")),
        F.col("t_name").alias("receiver_type"),
        F.col("t_file").alias("target_file_hint"),
        F.least("inferred", "f_confidence", "t_confidence").alias("inferred"),
        F.concat(F.lit("; on what "), "f_name", F.lit(" declares to return ("), "f_scope", F.lit(")")).alias("via"),
    )


def _resolve(calls: DataFrame, symbols: DataFrame, bindings: DataFrame, heritage: DataFrame, one_only: bool = False) -> DataFrame:
    keys = ["callee_name", "language", "file", "receiver_type", "target_file_hint"]
    calls = calls.withColumn("sig", F.xxhash64(*keys))
    asked = calls.select("sig", *keys).dropDuplicates(keys)
    target = symbols.where(F.col("kind").isin(*CALLABLE, *NOMINAL)).select(F.col("name").alias("callee_name"), "language", F.col("id").alias("target_id"), F.col("qualified_name").alias("target_qualified"), F.col("file").alias("target_file"))
    # Signatures are few next to calls, and every tier starts from them: they are made once.
    asked = cut(asked.join(_nominal(asked, symbols, bindings), "sig", "left").withColumn("receiver_state", F.coalesce("receiver_state", F.lit("none"))))
    pick = ["sig", "target_id", "target_qualified", "rank"]
    own = F.concat_ws(".", "receiver_type", "callee_name")
    # 0: members of the receiver's own type, or by hint and qualified name
    parents = symbols.select(F.col("id").alias("receiver_id"), F.col("file").alias("target_file"), F.col("qualified_name").alias("r_qualified"))
    members = target.withColumn("r_qualified", F.regexp_extract("target_qualified", r"^(.*)\.[^.]*$", 1)).join(parents, ["target_file", "r_qualified"])
    exact = asked.where("receiver_state = 'unique'").join(members.select("receiver_id", "callee_name", "language", "target_id", "target_qualified"), ["receiver_id", "callee_name", "language"])
    exact = exact.withColumn("n", _count_over("sig"))
    twice = exact.where("n > 1").select("sig").distinct().withColumn("twice", F.lit(True))
    open_ = asked.where("receiver_state <> 'ambiguous' AND (target_file_hint <> '' OR receiver_type <> '')").join(exact.select("sig").distinct(), "sig", "left_anti")
    # The place and the owner that a signature asks for are part of the key, so that common names meet few symbols.
    typed = F.when(F.col("receiver_type") == "", F.lit("")).otherwise(own)
    open_ = open_.select("sig", "callee_name", "language", hint_key(F.col("target_file_hint")).alias("place"), typed.alias("owned")).where("place IS NOT NULL")
    shapes = open_.select("callee_name", "language", F.col("place") != "", F.col("owned") != "").toDF("callee_name", "language", "placed", "typed").distinct()
    keyed = target.join(shapes, ["callee_name", "language"]).withColumnRenamed("language", "target_language")
    named = F.split("target_qualified", r"\.")
    owners = F.filter(F.transform(F.concat(F.array("target_qualified"), F.transform(_tails(named), lambda x: F.replace(x, F.lit("/"), F.lit(".")))), lambda x: x), lambda x: F.instr(x, ".") > 0)
    keyed = keyed.withColumn("place", F.explode(F.when(F.col("placed"), F.filter(place_keys(F.col("target_file")), lambda k: k != "")).otherwise(F.array(F.lit("")))))
    keyed = keyed.withColumn("owned", F.explode(F.when(F.col("typed"), owners).otherwise(F.array(F.lit("")))))
    keys = ["callee_name", "place", "owned"]
    found, many = counted(open_.select(*keys, "language").distinct(), keyed.select(*keys, "target_language", "target_id", "target_qualified"), keys, CALL_FANOUT, F.col("language") == F.col("target_language"), spare=0)
    loose = open_.join(found.drop("target_language"), [*keys, "language"])
    too_many = open_.join(many, [*keys, "language"], "left_semi").select("sig")
    tiers = [cut(exact.where("n = 1").withColumn("rank", F.lit(0)).select(*pick).union(loose.withColumn("rank", F.lit(0)).select(*pick)))]
    settled = tiers[0].select("sig").union(too_many).distinct()
    # 5: nearest inherited member
    open_ = asked.where("receiver_state = 'unique'").join(settled, "sig", "left_anti").join(twice, "sig", "left_anti")
    methods = members.select(F.col("receiver_id").alias("type_id"), F.col("callee_name").alias("name"), F.col("target_id").alias("member_id"))
    inherited = inherited_members(open_.select(F.col("receiver_id").alias("type_id"), F.col("callee_name").alias("name")), heritage, methods)
    inherited = open_.join(inherited.where("state = 'unique'").select(F.col("type_id").alias("receiver_id"), F.col("name").alias("callee_name"), F.col("member_id").alias("target_id")), ["receiver_id", "callee_name"])
    tiers.append(inherited.join(target.select("target_id", "target_qualified"), "target_id").withColumn("rank", F.lit(5)).select(*pick))
    # 1, 2, 4: only without a known receiver
    free = asked.where("receiver_state = 'none'").join(settled, "sig", "left_anti")
    local = free.join(target.withColumn("file", F.col("target_file")), ["callee_name", "language", "file"]).withColumn("rank", F.lit(1)).select(*pick)
    local = cut(local)
    free = free.join(local.select("sig").distinct(), "sig", "left_anti")
    by_name = bindings.select("file", F.col("binding_name").alias("callee_name"), "target_id").distinct()
    imported = free.join(by_name, ["file", "callee_name"]).join(target.select("target_id", "target_qualified", F.col("language").alias("t_language")), "target_id").where(compatible(F.col("language"), F.col("t_language"))).withColumn("rank", F.lit(2)).select(*pick)
    imported = cut(imported)
    free = free.join(imported.select("sig").distinct(), "sig", "left_anti")
    # Names with too many symbols are no answer anyway: they are left out before pairing.
    few = target.groupBy("callee_name", "language").agg(F.count("*").alias("n")).where(F.col("n") <= CALL_FANOUT).drop("n")
    anywhere = free.join(few, ["callee_name", "language"]).join(target, ["callee_name", "language"]).withColumn("rank", F.lit(4)).select(*pick)
    found = reduce(DataFrame.union, [*tiers, local, imported, anywhere]).dropDuplicates(["sig", "target_id"])
    found = found.withColumn("n", _count_over("sig")).where((F.col("n") == 1) if one_only else (F.col("n") <= CALL_FANOUT))
    rows = calls.join(found, "sig")
    alone = F.col("n") == 1
    sure = F.when(alone, F.element_at(F.create_map(*(F.lit(x) for kv in ((0, 0.995), (1, 0.99), (2, 0.97), (4, 0.75), (5, 0.97)) for x in kv)), F.col("rank"))).when(F.col("rank") <= 2, 0.65).otherwise(0.35)
    scope = F.when(F.col("rank") == 0, F.when(F.col("target_file_hint") != "", "by module hint").otherwise("by receiver's type")).when(F.col("rank") == 1, "in the same file").when(F.col("rank") == 2, "imported").when(F.col("rank") == 5, "inherited").otherwise("by name in the language")
    return rows.select("call_id", "file", "source_id", "fallback_caller_id", "start_byte", "target_id", "target_qualified", F.least("confidence", sure, "inferred").alias("confidence"), scope.alias("scope"), F.concat("explanation", F.coalesce("via", F.lit(""))).alias("explanation"), "provenance", "evidence_file", "evidence_line")


def interface_dispatch(symbols: DataFrame, heritage: DataFrame) -> DataFrame:
    """Interface methods call the methods of that name in implementing types, up to 8 of them."""
    owner = F.regexp_extract("qualified_name", r"^(.*)\.[^.]*$", 1)
    methods = symbols.where("kind = 'method'").select("id", "name", owner.alias("owner"), "file", F.col("start_line"))
    ends = symbols.select("id", "qualified_name", "file")
    pairs = heritage.where("kind = 'implements'").select("source_id", "target_id").distinct()
    pairs = pairs.join(ends.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("c_owner"), F.col("file").alias("c_file")), "source_id")
    pairs = pairs.join(ends.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("i_owner"), F.col("file").alias("i_file")), "target_id").select("c_owner", "c_file", "i_owner", "i_file")
    declared = methods.select(F.col("id").alias("source_id"), "name", F.col("owner").alias("i_owner"), F.col("file").alias("i_file"))
    concrete = methods.groupBy("name", F.col("owner").alias("c_owner"), F.col("file").alias("c_file")).agg(F.max_by("id", "id").alias("target_id"), F.max_by("start_line", "id").alias("evidence_line"))
    rows = pairs.join(declared, ["i_owner", "i_file"]).join(concrete, ["name", "c_owner", "c_file"]).dropDuplicates(["source_id", "target_id"])
    rows = rows.withColumn("n", _count_over("source_id")).where(F.col("n") <= INTERFACE_FANOUT).withColumn("evidence_file", F.col("c_file"))
    return edges(rows, "calls", "dynamic/interface-implementation", 0.94, F.concat(F.lit("implemented by "), "c_owner", F.lit("."), "name"))


def event_dispatch(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Dispatches call the handlers registered on the same scope, receiver and channel, up to 6.

    ``events``: event_id, file, owner_id, receiver, channel, action, callback_name, evidence_file,
    evidence_line; ``targets``: owner_id, callback_name, target_id.  Handlers are reduced to the
    distinct ones of a channel, and channels with too many left out, before dispatches are joined.
    """
    emitter = F.col("receiver").startswith("ohos-emitter@")
    scoped = events.withColumn("scope", F.when(emitter, F.lit("")).otherwise(F.col("file")))
    key = ["scope", "receiver", "channel"]
    handlers = scoped.where("action = 'register' AND callback_name IS NOT NULL").join(targets, ["owner_id", "callback_name"])
    handlers = handlers.groupBy(*key, "target_id").agg(F.min(F.struct(F.col("evidence_file").alias("f"), F.col("evidence_line").alias("l"))).alias("at"))
    fan = handlers.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") <= EVENT_FANOUT).drop("n")
    sent = scoped.where("action = 'dispatch'").select(*key, F.col("owner_id").alias("source_id"), "evidence_file", "evidence_line")
    rows = sent.join(handlers.join(fan, key), key).where("source_id <> target_id")
    place = F.concat("at.f", F.lit(":"), F.col("at.l").cast("string"))
    ohos = F.concat(F.lit("emitter event "), "channel", F.lit(", handler set at "), place)
    plain = F.concat(F.lit("event "), "channel", F.lit(" of "), "receiver", F.lit(", handler set at "), place)
    return edges(rows, "calls", F.when(emitter, "framework/ohos-emitter").otherwise("dynamic/event-registration"), F.when(emitter, 0.97).otherwise(0.92), F.when(emitter, ohos).otherwise(plain)).distinct()


def exported_values(literals: DataFrame, exports: DataFrame, asked: DataFrame) -> DataFrame:
    """(file, export_name, member_path) -> channel, over re-exports up to 16 deep; star exports count only without a named one, and all ways must give one value.

    ``literals``: file, export_name, member_path, channel; ``exports``: file, export_name, target_file, target_name, is_star.
    """
    keys = ["file", "export_name", "member_path"]
    at = asked.select(*keys).distinct().select(*(F.col(k).alias(f"a_{k}") for k in keys), *keys)
    found = None
    for _ in range(CHAIN_DEPTH + 1):
        hit = at.join(literals, keys)
        own = hit.select(*(f"a_{k}" for k in keys), "channel")
        found = own if found is None else found.union(own)
        rest = at.join(literals.select(*keys).distinct(), keys, "left_anti")
        named = rest.join(exports.where("NOT is_star").select("file", "export_name", "target_file", "target_name"), ["file", "export_name"])
        star = rest.join(named.select("file", "export_name").distinct(), ["file", "export_name"], "left_anti").join(exports.where("is_star").select("file", "target_file"), "file").withColumn("target_name", F.col("export_name"))
        step = named.select(*(f"a_{k}" for k in keys), F.col("target_file").alias("file"), F.col("target_name").alias("export_name"), "member_path").unionByName(star.select(*(f"a_{k}" for k in keys), F.col("target_file").alias("file"), F.col("target_name").alias("export_name"), "member_path"))
        at = cut(step.distinct())
        if at.isEmpty():
            break
    one = found.groupBy(*(f"a_{k}" for k in keys)).agg(F.countDistinct("channel").alias("n"), F.min("channel").alias("channel")).where("n = 1")
    return one.select(*(F.col(f"a_{k}").alias(k) for k in keys), "channel")


def callback_edges(arguments: DataFrame, targets: DataFrame, formals: DataFrame, invocations: DataFrame, delegations: DataFrame, symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls made through callback parameters: the callee, or one it hands the parameter on to, invokes the given function.

    ``arguments``: file, caller_id, callee_name, argument_index, formal_name, target_name, line, call_start_byte;
    ``targets``: file, source_id, start_byte, target_id of resolved calls; ``formals``: owner_id, formal_name,
    parameter_index; ``invocations``: owner_id, parameter_index; ``delegations``: owner_id, parameter_index,
    file, call_start_byte, argument_index.
    """
    site = targets.groupBy("file", F.col("source_id").alias("caller_id"), F.col("start_byte").alias("call_start_byte")).agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("callee_id")).where("n = 1").drop("n")
    given = arguments.join(site, ["file", "caller_id", "call_start_byte"])
    by_name = formals.select(F.col("owner_id").alias("callee_id"), "formal_name", F.col("parameter_index").alias("named_index"))
    given = given.join(by_name, ["callee_id", "formal_name"], "left").withColumn("index", F.when(F.col("formal_name").isNotNull(), F.col("named_index")).otherwise(F.col("argument_index"))).where("index IS NOT NULL")
    # formal -> formal steps
    hop = delegations.join(site.select("file", F.col("caller_id").alias("owner_id"), "call_start_byte", "callee_id"), ["file", "owner_id", "call_start_byte"]).select("owner_id", "parameter_index", F.col("callee_id").alias("to_owner"), F.col("argument_index").alias("to_index")).distinct()
    at = given.select(F.col("callee_id").alias("a_owner"), F.col("index").alias("a_index")).distinct().withColumn("owner_id", F.col("a_owner")).withColumn("parameter_index", F.col("a_index"))
    seen, reached, depth = at, None, 0
    while depth <= CHAIN_DEPTH:
        hit = at.join(invocations.select("owner_id", "parameter_index").distinct(), ["owner_id", "parameter_index"]).select("a_owner", "a_index", F.col("owner_id").alias("source_id"), F.lit(depth).alias("depth"))
        reached = hit if reached is None else reached.union(hit)
        step = at.join(hop, ["owner_id", "parameter_index"]).select("a_owner", "a_index", F.col("to_owner").alias("owner_id"), F.col("to_index").alias("parameter_index")).distinct()
        at = cut(step.join(seen, step.columns, "left_anti"))
        if at.isEmpty():
            break
        seen, depth = seen.unionByName(at), depth + 1
    reached = reached.groupBy("a_owner", "a_index", "source_id").agg(F.min("depth").alias("depth"))
    functions = symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), "file")
    imported = bindings.select("file", F.col("binding_name").alias("target_name"), "target_id").join(functions.select("target_id"), "target_id")
    known = functions.select("file", "target_name", "target_id").unionByName(imported).distinct()
    only = known.groupBy("file", "target_name").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id")).where("n = 1").drop("n")
    rows = given.join(only, ["file", "target_name"]).join(reached, (F.col("callee_id") == F.col("a_owner")) & (F.col("index") == F.col("a_index"))).where("source_id <> target_id")
    rows = rows.withColumn("evidence_file", F.col("file")).withColumn("evidence_line", F.col("line"))
    confidence = F.when(F.col("depth") == 0, 0.96).otherwise(0.94)
    return edges(rows, "calls", "dynamic/callback-argument", confidence, F.concat("target_name", F.lit(" is called as argument "), F.col("index").cast("string")), F.col("call_start_byte"))


def router_prefixes(routers: DataFrame, mounts: DataFrame) -> DataFrame:
    """(router, prefix) of every way from an application to a router, up to 16 mounts, none twice on a way.

    ``routers``: router, prefix, application; ``mounts``: parent, child, prefix.
    """
    way = routers.where("application").select("router", "prefix", F.array("router").alias("ancestry"))
    out = way
    steps = mounts.select(F.col("parent").alias("router"), "child", F.col("prefix").alias("mount_prefix")).join(routers.select(F.col("router").alias("child"), F.col("prefix").alias("own_prefix")), "child")
    for _ in range(CHAIN_DEPTH):
        way = way.join(steps, "router").where(~F.array_contains("ancestry", F.col("child")))
        way = cut(way.select(F.col("child").alias("router"), F.concat("prefix", "mount_prefix", "own_prefix").alias("prefix"), F.array_append("ancestry", F.col("child")).alias("ancestry")))
        if way.isEmpty():
            break
        out = out.union(way)
    return out.select("router", "prefix").distinct()


def materialize_routes(routes: DataFrame, prefixes: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route symbols ``VERB path`` and the edges file contains route (1.0), route calls handler (0.995).

    ``routes``: router, verb, path, handler_id, file, start_byte, end_byte, line, end_line.  An empty path makes no route, nor does a missing handler.
    """
    rows = routes.join(prefixes, "router").withColumn("full", F.concat("prefix", "path")).where("full <> ''")
    handlers = symbols.select(F.col("id").alias("handler_id"), F.col("qualified_name").alias("handler_name"), "language")
    rows = rows.join(handlers, "handler_id").withColumn("name", F.concat("verb", F.lit(" "), "full"))
    key = F.concat_ws("|", "language", F.lit("route"), "file", "name")
    rows = rows.withColumn("semantic_key", F.concat(key, F.lit("|"), F.col("start_byte").cast("string"))).withColumn("id", F.concat(F.lit("sym_"), F.substring(F.sha2("semantic_key", 256), 1, 24)))
    made = rows.select("id", "semantic_key", "file", "language", F.lit("route").alias("kind"), "name", F.col("name").alias("qualified_name"), "start_byte", "end_byte", F.col("line").alias("start_line"), F.col("end_line")).dropDuplicates(["id"])
    base = rows.withColumn("evidence_file", F.col("file")).withColumn("evidence_line", F.col("line"))
    files = symbols.where("kind = 'file'").select(F.col("id").alias("source_id"), "file")
    contains = edges(base.join(files, "file").withColumn("target_id", F.col("id")), "contains", "framework/fastapi-route", 1.0, "file declares route")
    calls = edges(base.withColumn("source_id", F.col("id")).withColumn("target_id", F.col("handler_id")), "calls", "framework/fastapi-route", 0.995, F.concat(F.lit("route dispatches to "), "handler_name"))
    return made, contains.union(calls).distinct()


def propagate_targets(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """The fixed point of sets of function targets over slots: (slot, target).

    ``seeds``: slot, target; ``flows``: from_slot, to_slot.  A slot with more than 300 targets passes nothing on;
    one that would get more than 300 from what flows into it ends up with none, its own included.  A slot that
    nothing flows into keeps its seeds, however many.  Semi-naive: each round carries only new rows on.
    """
    flows = cut(flows.select(F.col("from_slot").alias("slot"), "to_slot").distinct())
    known = cut(seeds.select("slot", "target").distinct())
    fresh, cleared = known, known.select("slot").limit(0)
    while True:
        few = known.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") <= C_TARGETS).select("slot")
        moved = fresh.join(few, "slot", "left_semi").join(flows, "slot").select(F.col("to_slot").alias("slot"), "target").distinct()
        fresh = cut(moved.join(known, ["slot", "target"], "left_anti").join(cleared, "slot", "left_anti"))
        if fresh.isEmpty():
            return known
        every = known.union(fresh)
        over = every.join(fresh.select("slot").distinct(), "slot", "left_semi").groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > C_TARGETS).select("slot")
        over = cut(over)
        known, fresh = cut(every.join(over, "slot", "left_anti")), fresh.join(over, "slot", "left_anti")
        cleared = cleared.union(over)


def include_closure(includes: DataFrame, depth: int = CHAIN_DEPTH) -> DataFrame:
    """(file, visible): each file sees itself and what it includes, directly or not, up to 16 deep; ``includes``: file, target."""
    seen = cut(includes.select("file", F.col("file").alias("visible")).union(includes.select("target", "target")).distinct())
    at = seen
    for _ in range(depth):
        step = at.join(includes.select(F.col("file").alias("visible"), "target").distinct(), "visible").select("file", F.col("target").alias("visible")).distinct()
        at = cut(step.join(seen, ["file", "visible"], "left_anti"))
        if at.isEmpty():
            break
        seen = seen.union(at)
    return seen


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(file, include, target): a quoted path next to the including file first, else the only file whose path ends so.

    Suffix matches are equal joins on the exploded tails of the paths.
    """
    folder = F.regexp_extract("file", r"^(.*/)[^/]*$", 1)
    beside = includes.where("quoted").withColumn("target", F.concat(folder, F.col("include"))).join(files.select(F.col("path").alias("target")), "target", "left_semi").select("file", "include", "target")
    parts = F.split("path", "/")
    tails = files.select(F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).alias("include"))
    rest = includes.join(beside.select("file", "include"), ["file", "include"], "left_anti")
    unique = tails.groupBy("include").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    return beside.union(rest.join(unique, "include").select("file", "include", "target"))
