"""Query traffic derived from the events table: a template by event id, filled with user and value.

The same table in Spark and in SQL, in integer arithmetic only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.operators.order import with_position

# Benign templates (0 to 21), then attacks (0 to 17), with {u} for the user and {v} for the value.
BENIGN = [
    "SELECT name FROM users WHERE id={u}", "SELECT a.x, b.y FROM a JOIN b ON a.id=b.id WHERE a.k={v}", "SELECT * FROM t WHERE id IN (SELECT id FROM s WHERE z={u})",
    "SELECT 'it''s {u}' AS note", "q=shoes+size+{v}", "name LIKE '%zz{u}'", "page={u}&sort=price%20asc", "name='Zoe{u}'", "q=<script>alert({u})</script>", "ref=0x61646d696e", "bin=0xABC", "raw=0x0001",
    "c=CHAR(65, 66,67)", "cast VARCHAR(64) k", "/static/logo.png", "big={v}12345678901234567890", "f(g({v}", "))))))", "singletoken{u}", "SELECT count(*) FROM orders GROUP BY day ORDER BY day", "path=/blog/index.php/2020/03/{u}", "cb=http://owasp.org/x{u}",
]
ATTACKS = [
    "id=1%2520OR%25201=1", "id={u}+UNION+ALL+SELECT+NULL,{v}", "admin'-- {u}", "'; DROP TABLE t{u}; -- SLEEP(5)", "1 AND SLEEP({v})", "x' OR '1'='1", "id=1;%20EXEC xp_cmdshell('whoami')", "1 AND EXTRACTVALUE(1,CONCAT(0x7e,{u}))", "WAITFOR DELAY '0:0:5' --{u}",
    "1 UNION SELECT username,password FROM users /* {u} */", "username='bob{u}' AND 5={v}", "UPDATEXML(1,{u},1)", ";cat /etc/passwd ", "() { :;}; ping {u}", "<!--#exec cmd=x{u}-->", "<script>alert({u})</script>", "CAST((SELECT {u}) AS int)", "CHAR(39) OR 1=1 BENCHMARK({v},1)",
]


def _table(spark: SparkSession) -> DataFrame:
    rows = [(i, False, t) for i, t in enumerate(BENIGN)] + [(len(BENIGN) + i, True, t) for i, t in enumerate(ATTACKS)]
    return spark.createDataFrame(rows, "k int, is_attack boolean, template string")


def traffic(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """id, ts, client, value, position, source, is_attack, query_raw. stream: one attack in twenty, else 18 in 40."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    k = F.col("event_id") % 40
    if stream:
        k = F.when(F.col("event_id") % 20 == 0, len(BENIGN) + F.floor(F.col("event_id") / 20) % len(ATTACKS)).otherwise(k % len(BENIGN))
    e = e.withColumn("k", k.cast("int")).join(F.broadcast(_table(spark)), "k")  # 40 rows
    number = F.floor("value").cast("long").cast("string")
    text = F.replace(F.replace("template", F.lit("{u}"), F.col("user_id").cast("string")), F.lit("{v}"), number)
    source = F.concat(F.lit("src"), F.col("user_id") % 3)
    wrapped = F.when(F.col("user_id") % 3 < 2, F.concat(F.lit("/shop/list?q="), text)).otherwise(text)
    rows = e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("client"), "value", source.alias("source"), "is_attack", wrapped.alias("query_raw"))
    return with_position(rows, ["ts", "id"], bucket=F.date_trunc("hour", "ts"))


def traffic_sql(stream: bool = False) -> str:
    """The body of a WITH clause that defines ``traffic``."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {str(i >= len(BENIGN)).lower()}, {quoted(t)})" for i, t in enumerate(BENIGN + ATTACKS))
    k = "event_id % 40" if not stream else f"CASE WHEN event_id % 20 = 0 THEN {len(BENIGN)} + (event_id // 20) % {len(ATTACKS)} ELSE (event_id % 40) % {len(BENIGN)} END"
    return f"""templates(k, is_attack, template) AS (VALUES {rows}),
traffic AS (SELECT event_id AS id, ts, user_id AS client, value, 'src' || (user_id % 3) AS source, is_attack,
  CASE WHEN user_id % 3 < 2 THEN '/shop/list?q=' ELSE '' END || replace(replace(template, '{{u}}', CAST(user_id AS VARCHAR)), '{{v}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS query_raw,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS position
  FROM (SELECT *, {k} AS tk FROM events) e JOIN templates ON k = tk)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a model might give, by arithmetic on ids: label_name, predicted, score, confidence, and keys. Many ties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    names = F.array(*[F.lit(x) for x in ("normal", "union_based", "error_based", "boolean_blind", "time_blind", "stacked")])
    i = F.col("event_id")
    label = F.when(i % 3 < 2, 0).otherwise(1 + F.floor(i / 3) % 5).cast("int")
    predicted = F.when(i % 7 == 3, (label + 1 + i % 2) % 6).otherwise(label).cast("int")
    score = ((i * 7919) % 1000) / 1000.0 + F.when(label > 0, 0.3).otherwise(0.0)
    rows = e.select(i.alias("id"), "ts", F.col("user_id").alias("client"), "value", label.alias("label"), F.get(names, label).alias("label_name"), F.get(names, predicted).alias("predicted"), F.round(score, 6).alias("score"), F.round(((i * 31) % 97) / 97.0, 6).alias("confidence"), (label > 0).alias("is_attack"), F.concat(F.lit("src"), F.col("user_id") % 3).alias("source"))
    return with_position(rows, ["ts", "id"], bucket=F.date_trunc("hour", "ts"))


SCORED_SQL = """scored0 AS (SELECT *, CASE WHEN event_id % 3 < 2 THEN 0 ELSE 1 + (event_id // 3) % 5 END AS label FROM events),
scored AS (SELECT event_id AS id, ts, user_id AS client, value, label, names[label + 1] AS label_name, names[CASE WHEN event_id % 7 = 3 THEN (label + 1 + event_id % 2) % 6 ELSE label END + 1] AS predicted,
  round(((event_id * 7919) % 1000) / 1000.0::DOUBLE + CASE WHEN label > 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score, round(((event_id * 31) % 97) / 97.0::DOUBLE, 6) AS confidence, label > 0 AS is_attack, 'src' || (user_id % 3) AS source,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS position
  FROM scored0, (SELECT ['normal', 'union_based', 'error_based', 'boolean_blind', 'time_blind', 'stacked'] AS names))"""
