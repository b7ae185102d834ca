"""The store of leads, actions and events as it lasts between sessions: a snapshot and the changes since.

A write is a batch of change rows, in proportion to what it changes, under a number; a commit record, made
last and only if there is none of that number, makes it count. A batch has an id as well, and a repeated
one has no effect, so that a job which is run again writes nothing twice; what a failed one left is never
read. Tables are merged on reading: a row that is whole sets every column, a patch those that it has, and
numbers of attempts add up. compact() writes what is merged as a new snapshot; a later one lets the older go.

Folders under the path: log/<table>/<number>-<id>, commits/<number>-<id> with the last ids given, snapshots/<number>/<table>.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import crm
from leadloom.sources import files

TABLES = {"leads": ("domain", crm.LEADS), "actions": ("id", crm.ACTIONS), "events": ("id", crm.EVENTS)}
#: Digits of a number in names, so that these sort as numbers do.
WIDTH = 12


def columns(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table][1].split(", ")]


def change_schema(table: str) -> str:
    """The table's columns, whether the row is whole, and its place in its batch."""
    return f"{TABLES[table][1]}, whole boolean, place bigint"


def merged(changes: DataFrame, table: str) -> DataFrame:
    """The rows after all changes, in the order of number and place. A patch of a row that never comes has no effect."""
    key = TABLES[table][0]
    when = F.struct("number", "place")
    latest = lambda c: F.max_by(F.col(c), F.when(F.col("whole") | F.col(c).isNotNull(), when)).alias(c)
    own = [F.coalesce(F.sum(c), F.lit(0)).cast("int").alias(c) if c == "attempts" else latest(c) for c in columns(table) if c != key]
    return changes.groupBy(key).agg(*own, F.bool_or("whole").alias("_there")).where("_there").select(columns(table))


class Store:
    """The three tables under a path, for any number of readers and one writer at a time; a writer that finds its number
    taken is told so."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # what is there

    def commits(self) -> dict[str, int]:
        """The ids of batches and their numbers."""
        return {name.split("-", 1)[1]: int(name.split("-", 1)[0]) for name in files.names(self.spark, f"{self.path}/commits")}

    def last_ids(self, commits: dict[str, int]) -> dict[str, int]:
        if not commits:
            return {"actions": 0, "events": 0}
        id_, number = max(commits.items(), key=lambda x: x[1])
        return json.loads(files.text_of(self.spark, f"{self.path}/commits/{number:0{WIDTH}}-{id_}"))

    def snapshot(self) -> int:
        """The number of the last commit that a whole snapshot holds; 0 without one."""
        done = [int(n) for n in files.names(self.spark, f"{self.path}/snapshots") if "done" in files.names(self.spark, f"{self.path}/snapshots/{n}")]
        return max(done, default=0)

    def changes(self, table: str) -> DataFrame:
        """What a reader merges: the snapshot, and the committed changes since, with their numbers."""
        schema, since = change_schema(table), self.snapshot()
        rows = crm.empty(self.spark, f"{schema}, number bigint")
        if since:
            kept = self.spark.read.schema(TABLES[table][1]).parquet(f"{self.path}/snapshots/{since:0{WIDTH}}/{table}")
            rows = rows.unionByName(kept.withColumns({"whole": F.lit(True), "place": F.lit(0).cast("bigint"), "number": F.lit(since).cast("bigint")}))
        there = set(files.names(self.spark, f"{self.path}/log/{table}"))
        newer = [f"{self.path}/log/{table}/{name}" for id_, n in self.commits().items() if n > since and (name := f"{n:0{WIDTH}}-{id_}") in there]
        if newer:
            number = F.regexp_extract(F.col("_metadata.file_path"), f"/log/{table}/([0-9]+)-", 1).cast("bigint")
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(*newer).withColumn("number", number))
        return rows

    def table(self, name: str) -> DataFrame:
        return merged(self.changes(name), name)

    # writing

    def commit(self, id_: str, ids: dict[str, int] | None = None, **changes: DataFrame) -> bool:
        """Makes a batch of changes of the tables count; False, and nothing is done, if the id has been committed."""
        if not re.fullmatch(r"[\w.-]+", id_):
            raise ValueError("the id of a batch is made of letters, digits, dots and hyphens")
        known = self.commits()
        if id_ in known:
            return False
        number = max(known.values(), default=0) + 1
        name = f"{number:0{WIDTH}}-{id_}"
        for table, rows in changes.items():
            whole = crm.empty(self.spark, change_schema(table)).unionByName(rows, allowMissingColumns=True)
            whole.write.mode("overwrite").parquet(f"{self.path}/log/{table}/{name}")
        if any(int(n.split("-")[0]) == number for n in files.names(self.spark, f"{self.path}/commits")):
            raise RuntimeError("another writer took this number: try again")
        return files.created(self.spark, f"{self.path}/commits/{name}", json.dumps(self.last_ids(known) | (ids or {})))

    def upsert(self, id_: str, records: DataFrame) -> bool:
        """Sets the rows of records (the columns of LEADS but attempts; seq orders those of one domain); attempts stay."""
        own = records.select(*[c for c in columns("leads") if c in records.columns and c != "attempts"], F.lit(0).alias("attempts"), F.lit(True).alias("whole"), F.col("seq").cast("bigint").alias("place"))
        return self.commit(id_, leads=own)

    def enqueue(self, id_: str, requests: DataFrame, as_of: Column) -> bool:
        """Adds an open action for each request (seq, from 1, domain, action_type, priority, notes); ids go on from the last."""
        known = self.commits()
        if id_ in known:
            return False
        last = self.last_ids(known)["actions"]
        rows = crm.enqueued(requests, as_of).withColumns({"place": F.col("id"), "id": F.col("id") + last, "whole": F.lit(True)})
        most = requests.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        return self.commit(id_, {"actions": last + most}, actions=rows)

    def event(self, rows: DataFrame, last: int, as_of: Column) -> DataFrame:
        """One event for each row of domain, event_type, notes, with the next id; there is one row."""
        return rows.select(F.lit(last + 1).cast("bigint").alias("id"), "domain", "event_type", "notes", as_of.cast("string").alias("created_at"), F.lit(True).alias("whole"), F.lit(0).cast("bigint").alias("place"))

    def start_next(self, id_: str, as_of: Column) -> Row | None:
        """Starts the next open action: three change rows. The action (domain, action, priority); None if none is open, or the id is known."""
        known = self.commits()
        if id_ in known:
            return None
        now = crm.next_action(self.table("actions")).select("id", "domain", "action_type", "priority").first()
        if now is None:
            return None
        last = self.last_ids(known)["events"]
        one = self.spark.createDataFrame([now], "id bigint, domain string, action_type string, priority string")
        patch = {"whole": F.lit(False), "place": F.lit(0).cast("bigint")}
        acted = one.select("id", F.lit("IN_PROGRESS").alias("status"), as_of.cast("string").alias("started_at")).withColumns(patch)
        told = one.select("domain", F.lit("CONTACTED").alias("pipeline_stage"), F.lit(1).alias("attempts"), F.col("action_type").alias("next_action"), F.date_add(as_of, 3).cast("string").alias("follow_up_date")).withColumns(patch)
        event = self.event(one.select("domain", F.lit("ACTION_STARTED").alias("event_type"), F.concat("action_type", F.lit(" started | "), "priority").alias("notes")), last, as_of)
        there = self.table("leads").where(F.col("domain") == now["domain"])  # the filter reaches the files
        self.commit(id_, {"events": last + 1}, actions=acted, events=event, **({} if there.isEmpty() else {"leads": told}))
        return Row(domain=now["domain"], action=now["action_type"], priority=now["priority"])

    def complete(self, id_: str, domain: str, as_of: Column, result: str = "") -> bool:
        """Completes the domain's actions in progress, a patch for each; one event in any case."""
        known = self.commits()
        if id_ in known:
            return False
        mine = self.table("actions").where((F.col("domain") == domain) & (F.col("status") == "IN_PROGRESS"))
        done = mine.select("id", F.lit("COMPLETED").alias("status"), as_of.cast("string").alias("completed_at"), F.lit(False).alias("whole"), F.lit(0).cast("bigint").alias("place"))
        return self._with_event(id_, known, domain, "ACTION_COMPLETED", result, as_of, actions=done)

    def add_event(self, id_: str, domain: str, kind: str, notes: str, as_of: Column) -> bool:
        known = self.commits()
        return False if id_ in known else self._with_event(id_, known, domain, kind, notes, as_of)

    def _with_event(self, id_: str, known: dict[str, int], domain: str, kind: str, notes: str, as_of: Column, **changes: DataFrame) -> bool:
        last = self.last_ids(known)["events"]
        row = self.spark.createDataFrame([(domain, kind, notes)], "domain string, event_type string, notes string")
        return self.commit(id_, {"events": last + 1}, events=self.event(row, last, as_of), **changes)

    def compact(self) -> int:
        """Writes what is merged as a snapshot, and lets what it replaces go but for the snapshot before; its number."""
        before, number = self.snapshot(), max(self.commits().values(), default=0)
        if number == before:
            return number
        path = f"{self.path}/snapshots/{number:0{WIDTH}}"
        for name in TABLES:
            self.table(name).write.mode("overwrite").parquet(f"{path}/{name}")
        files.created(self.spark, f"{path}/done", "")
        old = [f"{self.path}/snapshots/{n}" for n in files.names(self.spark, f"{self.path}/snapshots") if int(n) < before]
        old += [f"{self.path}/log/{t}/{n}" for t in TABLES for n in files.names(self.spark, f"{self.path}/log/{t}") if int(n.split("-")[0]) <= before]
        files.removed(self.spark, old)
        return number

