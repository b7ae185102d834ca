"""Extension: pages as a stream. Each micro-batch is reduced to states of its sites (leadloom.operators.states), which
merge with what earlier batches left of the same sites; those sites are scored anew.

A batch reads its own pages and the states in the slots that its sites hash to, never earlier pages, so what it reads
does not grow with the pages of the past. The exception is a site whose new pages do not all follow its old ones in
order: it is built again from its stored pages, so that results are those of a full run whatever the order of arrival.

Folders under the path: pages, arrived, touched, states and leads by batch, and versions, which says for each batch
where every slot's states are. A batch writes to its own folders alone and its versions last; run again after a
failure it finds what the batch before left and writes the same. States that the last two versions do not name go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators import leads, states
from leadloom.sources import files


def slot_of(domain: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(domain), F.lit(slots)).cast("int")


def written(rows: DataFrame, path: str, *by: str) -> DataFrame:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def versions(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """The batch that last wrote each slot's states, as of the batch: one entry per slot at most."""
    if batch < 0:
        return {}
    return {r["slot"]: r["version"] for r in spark.read.schema("slot int, version bigint").parquet(f"{path}/versions/batch={batch}").collect()}


def current(spark: SparkSession, path: str, batch: int, slots: list[int] | None = None) -> DataFrame | None:
    """The states of the slots (all, if not given) as of the batch, with their slot; None where nothing is."""
    found = [f"{path}/states/batch={v}/slot={s}" for s, v in sorted(versions(spark, path, batch).items()) if slots is None or s in slots]
    return spark.read.option("basePath", f"{path}/states").parquet(*found).drop("batch") if found else None


def updated(spark: SparkSession, new: DataFrame, number: int, path: str, slots: int) -> DataFrame:
    """Takes a batch of pages in; the states of the sites that it touches."""
    mine = f"batch={number}"
    named = states.with_domain(new).withColumn("slot", slot_of("domain", slots))
    pages = written(named, f"{path}/pages/{mine}", "slot")
    arrived = written(states.site_states(pages).withColumn("slot", slot_of("domain", slots)), f"{path}/arrived/{mine}")
    before = versions(spark, path, number - 1)
    touched_slots = [r["slot"] for r in arrived.select("slot").distinct().collect()]  # no more than there are slots
    old = current(spark, path, number - 1, touched_slots)
    if old is None:
        touched, rest = arrived, None
    else:
        old = old.select(arrived.columns)
        known = old.select("domain", F.col("last").alias("_last"))
        late = arrived.join(known, "domain").where("first <= _last").select("domain", "slot")
        both = old.join(arrived.select("domain"), "domain", "left_semi").unionByName(arrived).join(late.select("domain"), "domain", "left_anti")
        on_time = states.merged(both, "domain")
        late_slots = [r["slot"] for r in late.select("slot").distinct().collect()]
        if late_slots:
            everything = spark.read.schema("ordinal bigint, url string, text string, domain string, slot int, batch bigint").parquet(f"{path}/pages").where(F.col("slot").isin(late_slots) & (F.col("batch") <= number))
            on_time = on_time.unionByName(states.site_states(everything.join(late.select("domain"), "domain", "left_semi").select("ordinal", "url", "text")))
        touched = on_time.withColumn("slot", slot_of("domain", slots)).select(arrived.columns)
        rest = old.join(arrived.select("domain"), "domain", "left_anti")
    touched = written(touched, f"{path}/touched/{mine}")
    written(touched if rest is None else rest.unionByName(touched), f"{path}/states/{mine}", "slot")
    now = before | {s: number for s in touched_slots}
    written(spark.createDataFrame(sorted(now.items()), "slot int, version bigint").coalesce(1), f"{path}/versions/{mine}")
    gone = set(versions(spark, path, number - 2).items()) - set(before.items())
    files.removed(spark, [f"{path}/states/batch={v}/slot={s}" for s, v in gone])
    return touched.drop("slot")


def start(spark: SparkSession, arrivals: DataFrame, path: str, checkpoint: str, slots: int = 64) -> StreamingQuery:
    """Takes arriving pages (ordinal, url, text) in, and writes each batch's rescored sites to path/leads, in a folder of its own."""

    def batch(new: DataFrame, number: int) -> None:
        found = states.finished(updated(spark, new, number, path, slots))
        leads.scored(leads.signals(found)).write.mode("overwrite").parquet(f"{path}/leads/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
