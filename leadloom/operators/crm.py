"""The mutable store as data: append-only logs and folds, never an update in place.

Every function takes and returns DataFrames; time comes in as as_of. Logs carry seq, a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEADS = "domain string, pipeline_stage string, crm_status string, priority_score double, priority_level string, contact_method string, primary_email string, primary_phone string, attempts int, next_action string, follow_up_date string, updated_at string"
ACTIONS = "id bigint, domain string, action_type string, priority string, status string, due_date string, notes string, created_at string, started_at string, completed_at string"
EVENTS = "id bigint, domain string, event_type string, notes string, created_at string"
# Days until an action is due, by level.
DUE = {"A1 - Immediate Outreach": 0, "A2 - Priority Outreach": 2, "B1 - Nurture": 7}
DUE_OTHERS = 14


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def widened(df: DataFrame, schema: str) -> DataFrame:
    """The rows with the schema's columns, null where they lacked one."""
    return empty(df.sparkSession, schema).unionByName(df, allowMissingColumns=True)


def upserted(log: DataFrame) -> DataFrame:
    """The current row of each domain: the last write wins, attempts are kept from before (0 at first)."""
    columns = [c for c in log.columns if c not in ("domain", "seq", "attempts")]
    last = F.max_by(F.struct(*columns), "seq").alias("row")
    return log.groupBy("domain").agg(last, F.coalesce(F.max("attempts"), F.lit(0)).alias("attempts")).select("domain", "row.*", "attempts")


def due_date(level: Column, as_of: Column) -> Column:
    days = F.lit(DUE_OTHERS)
    for name, n in DUE.items():
        days = F.when(level == name, n).otherwise(days)
    return F.date_add(as_of, days)


def enqueued(requests: DataFrame, as_of: Column) -> DataFrame:
    """One open action for each row of seq, domain, action_type, priority, notes; a repeated request is a new action."""
    return requests.select(F.col("seq").alias("id"), "domain", "action_type", "priority", F.lit("OPEN").alias("status"), due_date(F.col("priority"), as_of).cast("string").alias("due_date"), "notes", as_of.cast("string").alias("created_at"), F.lit(None).cast("string").alias("started_at"), F.lit(None).cast("string").alias("completed_at"))


def open_actions(actions: DataFrame) -> DataFrame:
    return actions.where("status = 'OPEN'").orderBy("due_date", "id")


def next_action(actions: DataFrame) -> DataFrame:
    """The open action that is first by level, due date and id."""
    first, second, *_ = DUE
    level = F.when(F.col("priority") == first, 1).when(F.col("priority") == second, 2).otherwise(3)
    return actions.where("status = 'OPEN'").orderBy(level, "due_date", "id").limit(1)


def started(leads: DataFrame, actions: DataFrame, events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Starts the next action, if any: the three tables after it, and the action itself (domain, action, priority)."""
    now = F.broadcast(next_action(actions).select(F.col("id").alias("_id"), F.col("domain").alias("_domain"), F.col("action_type").alias("_type"), F.col("priority").alias("_level")))  # one row
    mine = F.col("_id").isNotNull()
    acted = actions.join(now.select("_id"), F.col("id") == F.col("_id"), "left").withColumn("status", F.when(mine, "IN_PROGRESS").otherwise(F.col("status"))).withColumn("started_at", F.when(mine, as_of.cast("string")).otherwise(F.col("started_at"))).drop("_id")
    told = leads.join(now, F.col("domain") == F.col("_domain"), "left")
    told = told.withColumns({"pipeline_stage": F.when(mine, "CONTACTED").otherwise(F.col("pipeline_stage")), "attempts": F.col("attempts") + mine.cast("int"), "next_action": F.when(mine, F.col("_type")).otherwise(F.col("next_action")), "follow_up_date": F.when(mine, F.date_add(as_of, 3).cast("string")).otherwise(F.col("follow_up_date"))}).drop("_id", "_domain", "_type", "_level")
    last = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    event = now.join(F.broadcast(last), F.lit(True)).select((F.col("last") + 1).alias("id"), F.col("_domain").alias("domain"), F.lit("ACTION_STARTED").alias("event_type"), F.concat("_type", F.lit(" started | "), "_level").alias("notes"), as_of.cast("string").alias("created_at"))
    return told, acted, events.unionByName(event), now.select(F.col("_domain").alias("domain"), F.col("_type").alias("action"), F.col("_level").alias("priority"))


def completed(actions: DataFrame, events: DataFrame, domain: str, as_of: Column, result: str = "") -> tuple[DataFrame, DataFrame]:
    """Completes every action of the domain that is in progress; one event, with the result as its note, is added in any case."""
    mine = (F.col("domain") == domain) & (F.col("status") == "IN_PROGRESS")
    acted = actions.withColumn("completed_at", F.when(mine, as_of.cast("string")).otherwise(F.col("completed_at"))).withColumn("status", F.when(mine, "COMPLETED").otherwise(F.col("status")))
    return acted, added(events, domain, "ACTION_COMPLETED", result, as_of)


def records(found: DataFrame, as_of: Column) -> DataFrame:
    """The leads as rows of the store, in the columns of LEADS: by the level that their canonical priority has."""
    level = F.when(F.col("priority_level").isin(list(DUE)[:2]), F.col("level_follow_up")).otherwise(14)
    return found.select("domain", F.col("level_stage").alias("pipeline_stage"), F.col("level_state").alias("crm_status"), F.col("canonical_priority").alias("priority_score"), "priority_level", F.col("best_contact_method").alias("contact_method"), F.col("any_email").alias("primary_email"), "primary_phone", F.lit(0).alias("attempts"), F.col("level_next_action").alias("next_action"), F.date_add(as_of, level).cast("string").alias("follow_up_date"), as_of.cast("string").alias("updated_at"))


def added(events: DataFrame, domain: str, kind: str, notes: str, as_of: Column) -> DataFrame:
    event = events.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", F.lit(domain).alias("domain"), F.lit(kind).alias("event_type"), F.lit(notes).alias("notes"), as_of.cast("string").alias("created_at"))
    return events.unionByName(event)


def history(events: DataFrame, domain: str) -> DataFrame:
    return events.where(F.col("domain") == domain).orderBy(F.desc("created_at"), F.desc("id"))


def queue_places(actions: DataFrame) -> DataFrame:
    """domain, id, place: each domain's open actions in the order in which they come up."""
    return actions.where("status = 'OPEN'").select("domain", "id", F.row_number().over(Window.partitionBy("domain").orderBy("due_date", "id")).alias("place"))
