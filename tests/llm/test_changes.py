"""The change applier against a plain loop over the contract's words."""

import datetime as dt
import math
import random
import zlib

import pytest
from oracle import SF
from pyspark.sql import functions as F

from calibrant.llm import queries
from calibrant.llm.change_applier import Bucket, apply_changes

SCHEMA = "change_id bigint, client_id bigint, seq bigint, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
DAY0 = dt.datetime(2024, 1, 1)


def by_hand(rows: list[dict], batches: int = 10, lateness: int = 8) -> list[tuple]:
    """(change_id, client_id, status, batch, missed, city, cents, current) of different rows."""
    clients = {r["client_id"] for r in rows}
    rank = {c: {s: k + 1 for k, s in enumerate(sorted({r["seq"] for r in rows if r["client_id"] == c}, key=lambda s: (s is not None, s or 0)))} for c in clients}
    live = []
    for r in rows:
        h = zlib.crc32(b"" if r["change_id"] is None else str(r["change_id"]).encode())
        if r["valid_at"] is not None and h % 11:
            day = (r["valid_at"].date() - dt.date(1970, 1, 1)).days + 5 * (h % 4)
            live.append({**r, "n": rank[r["client_id"]][r["seq"]], "day": day, "batch": max(1, min(batches, 1 + (day - 19723) * 10 // 160))})
    following, held, value, out, last = dict.fromkeys(clients, 1), {c: {} for c in clients}, dict.fromkeys(clients, (None, None)), [], {}

    def run(c, b, missed):
        while following[c] in held[c]:
            r = held[c].pop(following[c])
            following[c] += 1
            city, balance = value[c]
            if r["op"] == "I":
                city, balance = r["city"], r["balance"]
            elif r["op"] == "U":
                city, balance = r["city"] if r["city"] is not None else city, r["balance"] if r["balance"] is not None else balance
            elif r["op"] == "D":
                city = balance = None
            value[c] = city, balance
            last[c] = len(out), r["op"]
            out.append([r["change_id"], c, "applied", b, missed, city, None if balance is None else math.floor(100 * balance + 0.5), False])
            missed = 0

    largest = None
    for b in range(1, batches + 2):
        for c in clients:
            while held[c] and (b > batches or largest is not None and min(r["day"] for r in held[c].values()) + lateness <= largest):
                missed, following[c] = min(held[c]) - following[c], min(held[c])
                run(c, b, missed)
        own = sorted((r for r in live if r["batch"] == b), key=lambda r: (r["day"], r["change_id"] is not None, r["change_id"] or 0))
        for r in own:
            c = r["client_id"]
            if r["n"] in held[c] or r["n"] < following[c]:
                out.append([r["change_id"], c, "rejected", b, 0, None, None, False])
                continue
            held[c][r["n"]] = r
            run(c, b, 0)
        largest = max([r["day"] for r in own], default=largest) if largest is None else max([largest, *(r["day"] for r in own)])
    for k, op in last.values():
        out[k][-1] = op != "D"
    return sorted(map(tuple, out), key=repr)


def applied(rows, **options) -> list[tuple]:
    """The query's columns of the operator's rows."""
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    day = F.datediff(F.to_date("valid_at"), F.lit("1970-01-01").cast("date")) + 5 * (h % 4)
    got = apply_changes(rows, day, F.least(F.lit(10), 1 + F.floor((day - 19723) * 10 / 160)), F.col("valid_at").isNotNull() & (h % 11 != 0), 10, **options)
    got = got.select("change_id", "client_id", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("bigint").alias("cents"), "current")
    return sorted(map(tuple, got.collect()), key=repr)


def changes(seed: int, n: int, hot: float) -> list[dict]:
    """Rows of a few clients, of which one has a share `hot`; late and lost numbers, nulls and odd operations."""
    rng, made = random.Random(seed), []
    for k in range(n):
        c = 7 if rng.random() < hot else rng.choice([1, 2, 3, None])
        t = rng.randrange(118)
        seq = None if rng.random() < 0.01 else t * 3 + rng.randrange(12)
        made.append({
            "change_id": k, "client_id": c, "seq": seq, "op": rng.choice(["I", "U", "U", "U", "D", "X", None]), "valid_at": None if rng.random() < 0.02 else DAY0 + dt.timedelta(days=t, hours=rng.randrange(24)),
            "source": "a", "segment": None, "city": rng.choice([None, "A", "B", "Ö"]), "balance": rng.choice([None, -1.005, 0.0, round(rng.uniform(-99, 999), 2)]),
        })
    return made


def test_query_on_the_given_table(spark):
    import duckdb

    cur = duckdb.connect().execute(f"SELECT DISTINCT * FROM '{SF}/client_changes.parquet'")
    names = [d[0] for d in cur.description]
    expected = by_hand([dict(zip(names, r)) for r in cur.fetchall()])
    got = sorted((tuple(r) for r in queries.op11_changes(spark, SF).collect()), key=repr)
    assert got == expected and len(got) > 1000


@pytest.mark.parametrize("segment", [16, 1024])
def test_long_clients_meet_no_other_fate(spark, segment):
    """A client that holds most rows, in segments of 16 numbers and in one: as by hand; repeated rows count once."""
    rows = changes(5, 900, 0.6)
    given = spark.createDataFrame([tuple(r.values()) for r in rows + rows[::7]], SCHEMA)
    got = applied(given, segment=segment, buckets=5)
    assert got == by_hand(rows)
    assert {r[2] for r in got} == {"applied", "rejected"} and max(r[4] for r in got) > 1 and {r[3] for r in got} >= {*range(1, 9)}


def test_a_rest_that_waits_for_the_end(spark):
    """One batch has rows: the other starts find none, and the last applies what is held."""
    rows = [{**r, "valid_at": r["valid_at"] and DAY0 + dt.timedelta(hours=k % 24), "op": "U"} for k, r in enumerate(changes(3, 60, 0.3))]
    got = applied(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumn("n", F.lit("own")).withColumn("kind", F.lit(1)), segment=8, buckets=3)
    assert got == by_hand(rows) and 11 in {r[3] for r in got}


def test_no_rows(spark):
    assert applied(spark.createDataFrame([], SCHEMA), buckets=2) == []


def test_a_tick_visits_due_slots_alone():
    b = Bucket(8, 1024)
    name, other = ("=1", 0), ("=2", 0)
    assert list(b.take(name, False, 3, 10, "a", "{}", 1)) == [] and list(b.take(other, False, 2, 50, "b", "{}", 1)) == []
    b.schedule(name)
    b.schedule(other)
    assert set(b.wheel) == {18, 58}
    assert list(b.tick(2, 17)) == [] and set(b.wheel) == {18, 58}
    assert [e[4:6] for e in b.tick(3, 18)] == [(3, "a")] and set(b.wheel) == {58}
    assert b.held[name].next == 4 and b.held[other].next == 1


def test_a_jump_reschedules_by_the_new_earliest_day():
    b = Bucket(8, 1024)
    name = ("=1", 0)
    for n, day in ((2, 10), (5, 30), (9, 20)):
        assert list(b.take(name, False, n, day, str(n), "{}", 1)) == []
    b.schedule(name)
    assert [e[4] for e in b.tick(2, 18)] == [2]
    assert set(b.wheel) == {28}
    assert [e[4] for e in b.tick(3, 28)] == [5, 9] and not b.wheel  # 9 is due, so all before it is jumped to first
