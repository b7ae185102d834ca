"""The store against a table kept in Python, over sessions, repeated batches and compactions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import crm
from leadloom.operators.store import Store, change_schema
from leadloom.plans import queries as plans

as_of = lambda: F.expr(plans.AS_OF)
RECORD = "seq bigint, domain string, pipeline_stage string, crm_status string, priority_score double, priority_level string, contact_method string, primary_email string, primary_phone string, next_action string, follow_up_date string, updated_at string"
REQUEST = "seq bigint, domain string, action_type string, priority string, notes string"
LEVELS = [*crm.DUE, "Research Required"]


def record(spark, rows):
    return spark.createDataFrame([(n, d, stage, "s", 1.5, LEVELS[0], "EMAIL", mail, None, "next", "2024-01-01", "now") for n, d, stage, mail in rows], RECORD)


def leads(store):
    return {r["domain"]: (r["pipeline_stage"], r["primary_email"], r["attempts"], r["next_action"]) for r in store.table("leads").collect()}


def rows_written(spark, store):
    return sum(spark.read.schema(change_schema(t)).parquet(f"{store.path}/log/{t}/*").count() for t in ("leads", "actions", "events") if os.path.isdir(f"{store.path}/log/{t}"))


def test_upsert_restart_upsert(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert leads(store) == {} and store.table("events").count() == 0
    assert store.upsert("b1", record(spark, [(1, "a", "NEW", "x@a"), (2, "b", "NEW", None), (3, "a", "NEWER", "y@a")]))
    assert leads(store) == {"a": ("NEWER", "y@a", 0, "next"), "b": ("NEW", None, 0, "next")}
    store.enqueue("q1", spark.createDataFrame([(1, "a", "CALL", LEVELS[0], "n"), (2, "zz", "CALL", LEVELS[1], "")], REQUEST), as_of())
    assert tuple(store.start_next("go", as_of())) == ("a", "CALL", LEVELS[0])
    again = Store(spark, f"{tmp_path}/store")  # another session
    assert leads(again)["a"] == ("CONTACTED", "y@a", 1, "CALL")
    assert again.upsert("b2", record(spark, [(1, "a", "LATER", None)]))
    assert leads(again) == {"a": ("LATER", None, 1, "next"), "b": ("NEW", None, 0, "next")}  # attempts kept, nulls set
    assert not again.upsert("b2", record(spark, [(1, "a", "NEVER", None)])) and again.start_next("go", as_of()) is None
    assert leads(again)["a"][0] == "LATER"
    for _ in range(2):
        again.compact()
        assert leads(again) == {"a": ("LATER", None, 1, "next"), "b": ("NEW", None, 0, "next")}
        assert again.table("actions").count() == 2 and again.table("events").count() == 1
    assert tuple(again.start_next("go2", as_of())) == ("zz", "CALL", LEVELS[1])  # no lead of that name: none comes to be
    assert set(leads(again)) == {"a", "b"} and again.start_next("go3", as_of()) is None


def test_writes_in_proportion(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.upsert("many", record(spark, [(i, f"d{i}", "NEW", None) for i in range(500)]))
    store.enqueue("queue", spark.createDataFrame([(i + 1, f"d{i}", "CALL", LEVELS[i % 4], "") for i in range(500)], REQUEST), as_of())
    before = rows_written(spark, store)
    started = store.start_next("one", as_of())
    assert rows_written(spark, store) == before + 3
    assert store.complete("done", started["domain"], as_of(), "sent") and not store.complete("done", started["domain"], as_of(), "sent")
    assert rows_written(spark, store) == before + 5
    assert [r["notes"] for r in crm.history(store.table("events"), started["domain"]).collect()] == ["sent", f"CALL started | {LEVELS[0]}"]


def test_what_failed_is_not_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.upsert("b1", record(spark, [(1, "a", "NEW", None)]))
    crm.empty(spark, change_schema("leads")).unionByName(record(spark, [(1, "ghost", "NEW", None)]).drop("seq").withColumns({"whole": F.lit(True)}), allowMissingColumns=True).write.parquet(f"{store.path}/log/leads/000000000002-lost")
    assert set(leads(store)) == {"a"}
    store.upsert("b2", record(spark, [(1, "b", "NEW", None)]))
    assert set(leads(store)) == {"a", "b"}
    with pytest.raises(ValueError):
        store.upsert("a/b", record(spark, []))


def test_against_the_folds_in_memory(spark, tmp_path):
    """Random scripts give what crm's functions give on whole tables."""
    own = random.Random(4)
    store = Store(spark, f"{tmp_path}/store")
    actions, kept, events = [], {}, []
    for n in range(14):
        kind = own.choice(["upsert", "enqueue", "start", "start", "complete", "compact"])
        if kind == "upsert":
            rows = [(i, own.choice("abcd"), f"S{n}{i}", None) for i in range(own.randint(1, 4))]
            store.upsert(f"b{n}", record(spark, rows))
            for _, d, stage, mail in rows:
                kept[d] = (stage, mail, kept.get(d, (0, 0, 0, 0))[2], "next")
        elif kind == "enqueue":
            rows = [(i + 1, own.choice("abcde"), "CALL", own.choice(LEVELS), "") for i in range(own.randint(1, 4))]
            store.enqueue(f"b{n}", spark.createDataFrame(rows, REQUEST), as_of())
            base = len(actions)
            actions += [[base + i, d, level, "OPEN"] for i, d, _, level, _ in rows]
        elif kind == "start":
            due = lambda a: (LEVELS.index(a[2]) if a[2] in LEVELS[:2] else 2, crm.DUE.get(a[2], crm.DUE_OTHERS), a[0])
            want = min((a for a in actions if a[3] == "OPEN"), key=due, default=None)
            got = store.start_next(f"b{n}", as_of())
            assert (got and tuple(got)) == (want and (want[1], "CALL", want[2]))
            if want:
                want[3] = "IN_PROGRESS"
                events.append((len(events) + 1, want[1], "ACTION_STARTED"))
                if want[1] in kept:
                    kept[want[1]] = ("CONTACTED", kept[want[1]][1], kept[want[1]][2] + 1, "CALL")
        elif kind == "complete":
            d = own.choice("abcde")
            store.complete(f"b{n}", d, as_of())
            events.append((len(events) + 1, d, "ACTION_COMPLETED"))
            for a in actions:
                if a[1] == d and a[3] == "IN_PROGRESS":
                    a[3] = "COMPLETED"
        else:
            store.compact()
    assert leads(store) == kept
    assert sorted(tuple(r) for r in store.table("actions").select("id", "domain", "priority", "status").collect()) == sorted(map(tuple, actions))
    assert sorted(tuple(r) for r in store.table("events").select("id", "domain", "event_type").collect()) == events
