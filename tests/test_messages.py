import pytest
from pyspark.sql import functions as F

from leadloom.operators import leads
from leadloom.plans import messages, sheet

ROWS = [(1, "http://a.example/", "newsletter"), (2, "http://b.example/", "live chat, pricing, book an appointment, online planner, request information")]


def test_a_table_changes_texts_alone(spark):
    pages = spark.createDataFrame(ROWS, "ordinal bigint, url string, text string")
    found = leads.signals(leads.sites(pages)).cache()
    own = messages.table(spark).withColumn("template", F.when(F.expr("field = 'pitch' AND class = 'chat'"), "it's {domain}: \\n {pages}").when(F.expr("field = 'email_subject'"), "{pitch}!").otherwise(F.col("template")))
    plain, other = (leads.scored(found, t).orderBy("domain") for t in (None, own))
    assert sorted(plain.columns) == sorted(other.columns)
    kept = [c for c in plain.columns if c not in ("pitch", "email_subject")]
    assert plain.select(kept).collect() == other.select(kept).collect()
    assert plain.select(kept).collect() == leads.scored(found, messages.table(spark)).orderBy("domain").select(kept).collect()
    assert plain.first()["pitch"] == "arrangements online; chat assistant; price calculator; booking online"
    changed = "arrangements online; it's a.example: \\n 1; price calculator; booking online"
    assert tuple(other.first()[c] for c in ("pitch", "email_subject")) == (changed, changed + "!")


def test_wrong_tables_are_refused(spark):
    for rows in ([("pitch", "nothing", "x")], [("nothing", "all", "x")], [("pitch", "chat", "x"), ("pitch", "chat", "y")], [("pitch", "chat", None)]):
        with pytest.raises(ValueError):
            messages.own_texts(spark.createDataFrame(rows, messages.SCHEMA))
    for template in ("{no_such_column}", "{executive_summary}"):  # unknown; a line after the pitch
        with pytest.raises(ValueError):
            sheet.spark_sheet(messages.changed([("pitch", "chat", template)]))
