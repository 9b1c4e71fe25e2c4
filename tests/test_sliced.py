"""Sessions of a client that holds most rows, and dumps larger than a task, against plain loops."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trafficwarden.operators import sessions as N
from trafficwarden.sources import readers as S


@pytest.fixture
def slices(spark):
    """Sixteen ranges that aren't put together again, and blocks of 20,000 bytes."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of_clients(n=3000):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        client = 7 if rng.random() < 0.7 else rng.choice([None, 1, 2, 3, 8, 9])
        at = start + timedelta(minutes=rng.randrange(20_000) if client == 7 else 7 * rng.randrange(20_000), seconds=rng.choice([0, 0, 30]))
        rows.append((i, at, client, rng.choice([None, "", "s1"]) if client == 3 else None))
    return rows


def expected(rows, idle=1800):
    out, last, number, index = {}, {}, {}, {}
    for i, at, client, given in sorted(rows, key=lambda r: (r[1], r[0])):
        if given:
            session = given
        else:
            if client not in last or at - last[client] > timedelta(seconds=idle):
                number[client] = number.get(client, 0) + 1
            last[client] = at
            session = "-".join(str(x) for x in (client, number[client]) if x is not None)
        step, before = index.get(session, (-1, at))
        index[session] = step + 1, at
        out[i] = session, step + 1, (at - before).total_seconds()
    return out


def test_sessions_of_a_hot_client(slices):
    rows = rows_of_clients()
    df = slices.createDataFrame(rows, "id long, ts timestamp, client long, known string")
    found = N.idle_gap_sessions(df, given="known")
    assert set(found.columns) == {"id", "ts", "client", "known", "session_id"}
    got = {r.id: (r.session_id, r.step_index, r.gap_seconds) for r in N.with_steps(found).collect()}
    assert got == expected(rows)
    shares = [r["count"] / len(rows) for r in N.idle_gap_sessions(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(r[2] == 7 for r in rows) > 0.65 * len(rows) and max(shares) < 0.4


def test_one_session_and_none(slices):
    start = datetime(2024, 1, 1)
    df = slices.createDataFrame([(i, start + timedelta(seconds=i // 3), 1) for i in range(500)], "id long, ts timestamp, client long")
    got = N.with_steps(N.idle_gap_sessions(df)).orderBy("id").collect()
    assert [r.step_index for r in got] == list(range(500)) and {r.session_id for r in got} == {"1-1"}
    assert N.with_steps(N.idle_gap_sessions(df.limit(0))).count() == 0


def test_dump_larger_than_a_task(slices, tmp_path):
    rng = random.Random(4)
    def request(i):
        body = "\n".join("x" * rng.randrange(200) for _ in range(rng.randrange(30)))
        return f"{rng.choice(['GET', 'POST', 'PUT'])} /{i} HTTP/1.1\r\nHost: é\r\n\r\n{body}\nGETTING not one\n POST nor this\n" + "\n" * rng.randrange(3)
    texts = {"a.txt": "junk\n\n" + "".join(request(i) for i in range(600)), "b.txt": "".join(request(i) for i in range(40)), "c.txt": "nothing\n", "d.txt": "GET / HTTP/1.1\n" + "y" * 90_000 + "\nPUT /end HTTP/1.1"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = S.http_dump(slices, str(tmp_path))
    assert slices.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 10
    want = set()
    for name, text in texts.items():
        parts = [p for p in re.split(r"(?m)(?=^(?:GET|POST|PUT) )", text) if re.match("(?:GET|POST|PUT) ", p)]
        want |= {(name, i, p.strip("\n")) for i, p in enumerate(parts)}
    assert {(r.file.split("/")[-1], r.position, r.raw_request) for r in got.collect()} == want and len(want) == 642


def test_ledger_files_follow_the_rows(spark, tmp_path):
    """A small append is one file, a large one several."""
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    kind = "id long, action string"
    S.append_ledger(spark.range(50, numPartitions=8).withColumn("action", F.lit("x")).select("id", "action"), few)
    assert len(spark.read.schema(kind).json(few).inputFiles()) == 1
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "16k")
    try:
        for low in (0, 20_000):
            S.append_ledger(spark.range(low, low + 20_000, numPartitions=8).withColumn("action", F.sha2(F.col("id").cast("string"), 256)), many)
    finally:
        spark.conf.set(size, before)
    found = S.read_ledger(spark, many, kind)
    assert len(found.inputFiles()) > 4 and found.count() == found.distinct().count() == 40_000
