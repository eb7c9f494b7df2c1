"""Changes between snapshots and orphan references, against brute force and on dirty rows."""

import random
from datetime import datetime, timedelta

from conftest import rows
from pyspark.sql import functions as F

from locusmith.operators.orphans import BLOCK, key_runs, orphan_references, orphans_per_period, reference_key
from locusmith.operators.snapshots import changes_per_delivery, document_snapshot_changes

SNAPSHOT = "snapshot_id int, id string, content_hash string, edition string, is_current boolean, delivered_at timestamp, change string"
T0 = datetime(2025, 1, 1)


def brute_changes(data):
    latest = {}
    for s, i, h, e, c, at, _ in data:
        if s is None or i is None:
            continue
        key = (at is not None, at or T0)
        value = (h.lower() if h else h, (e or "").strip() or None, c)
        if (s, i) not in latest or key > latest[s, i][0]:
            latest[s, i] = (key, value)
    order = sorted({s for s, _ in latest})
    found = []
    for before, after in zip(order, order[1:]):
        old = {i: v for (s, i), (_, v) in latest.items() if s == before}
        new = {i: v for (s, i), (_, v) in latest.items() if s == after}
        found += [(after, i, "added") for i in new.keys() - old.keys()] + [(after, i, "removed") for i in old.keys() - new.keys()]
        found += [(after, i, "changed") for i in new.keys() & old.keys() if new[i] != old[i]]
    return sorted(found, key=repr)


def test_snapshot_changes_match_brute_force(spark):
    rng = random.Random(3)
    data = []
    for s in (2, 5, 6, 11):
        for i in range(60):
            if rng.random() < 0.8:
                for n in range(rng.choice([1, 1, 1, 2])):
                    data.append((s, f"d{i}", rng.choice(["aa", "AA", "bb"]), rng.choice([None, "", " ", "x", " x "]), rng.choice([True, False, None]), T0 + timedelta(days=s, seconds=n), "noise"))
    data += data[:20] + [(None, "d1", "aa", None, True, T0, "x"), (2, None, "aa", None, True, T0, "x")]
    rng.shuffle(data)
    df = spark.createDataFrame(data, SNAPSHOT)
    assert rows(document_snapshot_changes(df)) == brute_changes(data)
    assert {r["change"] for r in changes_per_delivery(document_snapshot_changes(df)).collect()} == {"added", "removed", "changed"}


def test_snapshot_changes_of_few_rows(spark):
    empty = spark.createDataFrame([], SNAPSHOT)
    assert document_snapshot_changes(empty).count() == 0
    one = spark.createDataFrame([(1, "a", "h", None, True, T0, "x")] * 3, SNAPSHOT)
    assert document_snapshot_changes(one).count() == 0
    nulls = spark.createDataFrame([(1, "a", None, None, None, None, None), (2, "a", None, " ", None, None, None)], SNAPSHOT)
    assert document_snapshot_changes(nulls).count() == 0


REFS = "ref_table string, ref_id string, ref_value string, ref_time timestamp"
PARENTS = "key string, valid_from timestamp, valid_to timestamp"


def test_orphans_match_brute_force(spark):
    rng = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    parents = []
    for n in rng.sample(range(400), 250):
        for _ in range(rng.choice([1, 1, 2, 3])):
            start = rng.randrange(0, 40)
            parents.append((f"src:{n}", day(start), rng.choice([None, day(start + rng.randrange(0, 30))])))
    parents += [("src:i.q1.pr", day(0), None), ("src:007", day(0), None), (None, day(0), None), ("src:9", None, None), ("src:99999999999999999999", day(0), None)]
    refs = []
    for k in range(600):
        value = rng.choice([f"SRC:{rng.randrange(420)}", f" src:{rng.randrange(420)} ", "src:i.Q1.pr", "src:i.q1.co", "src:7", "src:007", "", "  ", None, "src:99999999999999999999"])
        refs.append(("t", str(k), value, rng.choice([day(rng.randrange(-2, 80)), None])))
    refs += refs[:30]

    def exists(value, t):
        return t is not None and any(k == value and a is not None and a <= t and (z is None or t < z) for k, a, z in parents)

    want = sorted({r for r in refs if r[2] and r[2].strip("  ") and not exists(r[2].strip("  ").lower(), r[3])}, key=repr)
    parent_df = spark.createDataFrame(parents, PARENTS).withColumn("key", reference_key(F.col("key")))
    got = orphan_references(spark.createDataFrame(refs, REFS), parent_df)
    assert rows(got) == want
    assert sum(r["orphans"] for r in orphans_per_period(got).collect()) == len(want)


def test_runs_are_contiguous_and_bounded(spark):
    parents = spark.createDataFrame([(f"a:{n}", T0, None) for n in [*range(1, 200), 300]] * 2, PARENTS)
    runs = key_runs(parents).collect()
    assert max(r["last"] - r["first"] for r in runs) < BLOCK
    assert sum(r["last"] - r["first"] + 1 for r in runs) == 200
    assert len(key_runs(spark.createDataFrame([(f"a:{BLOCK + n}", T0, None) for n in range(-5, 5)], PARENTS)).collect()) == 2
    assert key_runs(spark.createDataFrame([], PARENTS)).count() == 0


def test_hot_key_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("locusmith.operators.orphans.PART", 10)
    parents = spark.createDataFrame([("a:1", T0 + timedelta(days=2), T0 + timedelta(days=9)), ("a:1", T0 + timedelta(days=20), None), ("a:3", T0, None)], PARENTS)
    refs = [("t", str(k), f"a:{1 + k % 7 // 6}", T0 + timedelta(days=k % 25)) for k in range(700)]
    want = sorted({r for r in refs if r[2] == "a:2" or not (2 <= (r[3] - T0).days < 9 or (r[3] - T0).days >= 20)}, key=repr)
    assert rows(orphan_references(spark.createDataFrame(refs, REFS), parents)) == want


def test_no_parents_makes_every_reference_an_orphan(spark):
    refs = spark.createDataFrame([("t", "1", "x:1", T0), ("t", "2", None, T0)], REFS)
    assert rows(orphan_references(refs, spark.createDataFrame([], PARENTS)), "ref_id") == [("1",)]
