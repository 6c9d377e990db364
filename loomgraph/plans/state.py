"""Durable workspace state: workspaces, sessions, events, recaps and memories.

Each table is a DataFrame; operations return the next version of it, new rows
replacing old ones by key.  Ids and clock are given by the caller, so that results
are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import budget

#: Fixed values.
MAX_TITLE_BYTES, MAX_BODY_BYTES, MAX_SUMMARY_BYTES, MAX_TAGS, MAX_TAG_BYTES, RECAP_EVENTS = 4096, 65536, 65536, 32, 128, 50
NO_EVENTS = "No session events were recorded."

SCHEMAS = {
    "workspaces": "id string, name string, created_at_ms long, updated_at_ms long",
    "sessions": "id string, workspace_id string, title string, status string, started_at_ms long, updated_at_ms long, ended_at_ms long",
    "session_events": "id string, session_id string, sequence long, kind string, body string, created_at_ms long",
    "recaps": "id string, session_id string, title string, summary string, event_count long, created_at_ms long, updated_at_ms long",
    "memories": "id string, workspace_id string, body string, tags array<string>, created_at_ms long, updated_at_ms long",
}


class StateError(ValueError):
    """An operation on something that isn't there or isn't active."""


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace those of the same key; later rows of ``rows`` are expected to be unique."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows)


def latest(table: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of each key with the greatest version; a reduction, so a key with many versions is no burden."""
    row = F.struct(F.col(version).alias("__v"), F.struct(*table.columns).alias("__row"))
    return table.groupBy(*keys).agg(F.max(row).alias("__m")).select("__m.__row.*")


def _row(table: DataFrame, **values) -> DataFrame:
    return table.sparkSession.createDataFrame([tuple(values[c] for c in table.columns)], table.schema)


def create_workspace(workspaces: DataFrame, id: str, name: str, now: int) -> DataFrame:
    budget.text(name, "workspace name", MAX_TITLE_BYTES)
    return workspaces.union(_row(workspaces, id=id, name=name.strip(), created_at_ms=now, updated_at_ms=now))


def rename_workspace(workspaces: DataFrame, id: str, name: str, now: int) -> DataFrame:
    budget.text(name, "workspace name", MAX_TITLE_BYTES)
    hit = F.col("id") == id
    return workspaces.withColumn("name", F.when(hit, F.lit(name.strip())).otherwise(F.col("name"))).withColumn("updated_at_ms", F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at_ms")))


def get(table: DataFrame, value: str, column: str = "id"):
    """The one row of an id: a workspace, session or memory, or the recap of a ``session_id``."""
    row = table.where(F.col(column) == value).first()
    if row is None:
        raise StateError(f"not found: {value}")
    return row


def listed(table: DataFrame, limit: int = 100, **equal) -> DataFrame:
    """Rows by recency, then id."""
    budget.limit(limit)
    for column, value in equal.items():
        table = table.where(F.col(column) == value)
    return table.orderBy(F.desc("updated_at_ms"), "id").limit(limit)


def create_session(sessions: DataFrame, workspaces: DataFrame, id: str, workspace_id: str, title: str, now: int) -> DataFrame:
    budget.text(title, "session title", MAX_TITLE_BYTES)
    if workspaces.where(F.col("id") == workspace_id).isEmpty():
        raise StateError(f"workspace not found: {workspace_id}")
    return sessions.union(_row(sessions, id=id, workspace_id=workspace_id, title=title.strip(), status="active", started_at_ms=now, updated_at_ms=now, ended_at_ms=None))


def append_events(events: DataFrame, sessions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds a batch (id, session_id, kind, body, created_at_ms) to active sessions, numbering on from each one's last sequence in order of time and id; the sessions touched get their time."""
    open_ = new.join(sessions.where("status = 'active'").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    last = events.groupBy("session_id").agg(F.max("sequence").alias("last"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at_ms", "id"))
    numbered = open_.withColumn("n", number).join(last, "session_id", "left")
    rows = numbered.select("id", "session_id", (F.coalesce("last", F.lit(0)) + F.col("n")).cast("long").alias("sequence"), "kind", "body", "created_at_ms")
    touched = open_.groupBy(F.col("session_id").alias("id")).agg(F.max("created_at_ms").alias("__at"))
    after = sessions.join(touched, "id", "left").withColumn("updated_at_ms", F.greatest("updated_at_ms", F.coalesce("__at", F.col("updated_at_ms")))).select(*sessions.columns)
    return events.unionByName(rows), after


def complete_session(sessions: DataFrame, id: str, now: int) -> DataFrame:
    """Completes a session; a second time keeps the first end."""
    hit = F.col("id") == id
    return sessions.select(
        *(
            F.when(hit, F.lit("completed")).otherwise(F.col(c)).alias(c)
            if c == "status"
            else F.when(hit, F.coalesce("ended_at_ms", F.lit(now).cast("long"))).otherwise(F.col(c)).alias(c)
            if c == "ended_at_ms"
            else F.when(hit, F.lit(now).cast("long")).otherwise(F.col(c)).alias(c)
            if c == "updated_at_ms"
            else F.col(c)
            for c in sessions.columns
        )
    )


def session_events(events: DataFrame, session_id: str, limit: int = 100) -> DataFrame:
    budget.limit(limit)
    return events.where(F.col("session_id") == session_id).orderBy("sequence").limit(limit)


def recap_texts(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, title, summary, event_count) of every session: its first 50 events, a line each, and the number of all."""
    first = events.where(F.col("sequence") <= RECAP_EVENTS)  # sequences count from 1 without gaps
    line = F.format_string("- [%s] %s", "kind", "body")
    texts = first.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", line.alias("line")))), lambda e: e["line"]), "\n").alias("summary"))
    counts = events.groupBy("session_id").agg(F.count("*").alias("event_count"))
    rows = sessions.select(F.col("id").alias("session_id"), "title").join(texts, "session_id", "left").join(counts, "session_id", "left")
    return rows.select("session_id", "title", truncate_utf8(F.coalesce("summary", F.lit(NO_EVENTS)), MAX_SUMMARY_BYTES).alias("summary"), F.coalesce("event_count", F.lit(0)).alias("event_count"))


def truncate_utf8(text, most: int):
    """At most ``most`` bytes, cut at a character's border."""
    raw = F.substring(F.encode(text, "utf-8"), 1, most)
    # A cut character leaves its first bytes at the end: drop an incomplete tail.
    as_hex = F.hex(raw)
    whole = F.regexp_replace(as_hex, "(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "")
    aligned = F.when(F.length(whole) % 2 == 0, whole).otherwise(as_hex)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(aligned), "utf-8"))


def save_recaps(recaps: DataFrame, texts: DataFrame, now: int) -> DataFrame:
    """Upserts one recap per session; id and creation time of an existing one stay."""
    old = recaps.select("session_id", F.col("id").alias("old_id"), F.col("created_at_ms").alias("old_at"))
    rows = texts.join(old, "session_id", "left").select(F.coalesce("old_id", F.concat(F.lit("recap_"), F.substring(F.sha2("session_id", 256), 1, 24))).alias("id"), "session_id", "title", "summary", "event_count", F.coalesce("old_at", F.lit(now).cast("long")).alias("created_at_ms"), F.lit(now).cast("long").alias("updated_at_ms"))
    return upsert(recaps, rows.select(*recaps.columns), ["session_id"])


def remember(memories: DataFrame, workspaces: DataFrame, id: str, workspace_id: str, body: str, tags: list[str], now: int) -> DataFrame:
    budget.text(body, "memory body", MAX_BODY_BYTES)
    own = list(dict.fromkeys(t.strip() for t in tags))
    if len(tags) > MAX_TAGS or any(not t or len(t.encode()) > MAX_TAG_BYTES for t in own):
        raise StateError("tags are out of bounds")
    if workspaces.where(F.col("id") == workspace_id).isEmpty():
        raise StateError(f"workspace not found: {workspace_id}")
    return memories.union(_row(memories, id=id, workspace_id=workspace_id, body=body.strip(), tags=own, created_at_ms=now, updated_at_ms=now))


def forget(memories: DataFrame, id: str) -> DataFrame:
    return memories.where(F.col("id") != id)
