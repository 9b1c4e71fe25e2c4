"""Corpus curation: filters, keep-first deduplication, leak-free joins, samples and splits.

Samples are ordered by a hash of key and seed, never by a random number: the same rows come out
whatever the partitioning. The hash is the leading digits of SHA-256, which other engines have too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trafficwarden.functions.text import any_signature, is_callback

HTTP_SOURCES = ["d3_csic2010", "d7_srbh2020", "d7_srbh2020_normal"]


def sample_key(key: str | Column, seed: int | str = 0) -> Column:
    """What samples are ordered by."""
    value = F.col(key) if isinstance(key, str) else key
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256), 1, 16)


def keep_first(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """The first row of each key in the order given (the last if descending). Rows of a key are thinned before they meet."""
    best = F.max_by if descending else F.min_by
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(best(row, F.struct(*order)).alias("_row")).select("_row.*")


def duplicates(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys of several rows: key, n, labels (how many differ)."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels")).filter("n > 1")


def content_filter(df: DataFrame, text: str = "query_canonical") -> DataFrame:
    """Without benign rows that carry an attack signature."""
    return df.filter(F.col("is_attack") | ~any_signature(F.col(text)))


def without_labels(df: DataFrame, labels: list[str], label: str = "label_name") -> DataFrame:
    return df.filter(~F.col(label).isin(labels))


def without_empty_http(df: DataFrame, text: str, sources: list[str] | None = None) -> DataFrame:
    """Without empty texts of sources that were captured as HTTP."""
    return df.filter(~(F.col("source").isin(sources or HTTP_SOURCES) & (F.coalesce(F.col(text), F.lit("")) == "")))


def move_callbacks(normal: DataFrame, anomalous: DataFrame, text: str = "query_canonical", new_source: str = "ssrf_moved") -> tuple[DataFrame, DataFrame]:
    """Benign rows with call-back marks go to the anomalous pool under a new source."""
    leaky = F.coalesce(is_callback(F.col(text)), F.lit(False))
    moved = normal.filter(leaky).withColumn("source", F.lit(new_source))
    return normal.filter(~leaky), anomalous.unionByName(moved.select(*[c for c in moved.columns if c in anomalous.columns]), allowMissingColumns=True)


def flagged(df: DataFrame, confidence: float = 0.6, sources: list[str] | None = None) -> DataFrame:
    """Rows to review: predicted an attack, or with little confidence; review_source says which."""
    low = F.col("confidence") < confidence
    rows = df.filter((F.col("predicted") != "normal") | low).withColumn("review_source", F.when(F.col("predicted") != "normal", "block").otherwise("low_confidence"))
    return rows if sources is None else rows.filter(F.col("review_source").isin(sources))


def exclude_known(pool: DataFrame, known: list[DataFrame], key: str) -> DataFrame:
    """Rows of the pool whose key is in none of the known tables."""
    for other in known:
        pool = pool.join(other.select(key), key, "left_anti")
    return pool


def consistent(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """Without keys of several labels; of the others the first row."""
    single = df.groupBy(key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a = _b").select(key)
    return keep_first(df.join(single, key, "left_semi"), [key], order)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables, one row: n."""
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("n"))


def with_truth(df: DataFrame, truth: DataFrame, key: str = "id", label: str = "label_name") -> DataFrame:
    return df.join(truth.select(key, F.col(label).alias("truth")), key)


def undersample(df: DataFrame, label: str, cap: int, key: str, seed: int = 0) -> DataFrame:
    """At most cap rows of each label, chosen by hash; smaller labels stay whole.

    A label of many rows is first thinned within salts, so no task ranks all of it.
    """
    h = sample_key(key, seed)
    thin = W.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(64))).orderBy("_h", key)
    rows = df.withColumn("_h", h).withColumn("_n", F.row_number().over(thin)).filter(F.col("_n") <= cap)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(label).orderBy("_h", key))).filter(F.col("_n") <= cap).drop("_n", "_h")


def _ranked(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """df with _r (from 1, by hash within by) and _n (rows of by). Buckets of the hash keep a large group in many tasks."""
    rows = df.withColumn("_h", sample_key(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_s"))  # 256 rows a group at most
    span = W.partitionBy(*by).orderBy("_b") if by else W.orderBy("_b")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    starts = sizes.withColumn("_before", F.sum("_s").over(span) - F.col("_s")).withColumn("_n", F.sum("_s").over(whole)).drop("_s")
    inner = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_h", key))
    return rows.withColumn("_i", inner).join(starts, [*by, "_b"]).withColumn("_r", F.col("_i") + F.col("_before")).drop("_i", "_before", "_b", "_h")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int = 0, names: tuple[str, str] = ("test", "train"), out: str = "split") -> DataFrame:
    """df with a split: of each label the first round(fraction * n) rows by hash are the first name, the rest the second."""
    r = _ranked(df, [label], key, seed)
    return r.withColumn(out, F.when(F.col("_r") <= F.bround(F.lit(float(fraction)) * F.col("_n")), names[0]).otherwise(names[1])).drop("_r", "_n")


def random_split(df: DataFrame, key: str, fraction: float, seed: int = 0, names: tuple[str, str] = ("test", "train"), out: str = "split") -> DataFrame:
    """As stratified_split, over all rows."""
    r = _ranked(df, [], key, seed)
    return r.withColumn(out, F.when(F.col("_r") <= F.bround(F.lit(float(fraction)) * F.col("_n")), names[0]).otherwise(names[1])).drop("_r", "_n")


def partition_by_fractions(df: DataFrame, label: str, key: str, fractions: dict[str, float], seed: int = 0, out: str = "partition") -> DataFrame:
    """df with a partition: within each label cut at the rounded cumulative shares; the last takes the rest."""
    names, total = list(fractions), 0.0
    r = _ranked(df, [label], key, seed)
    choice, bounds = F.lit(names[-1]), []
    for n in names[:-1]:
        total += fractions[n]
        bounds.append((n, total))
    for n, share in reversed(bounds):
        choice = F.when(F.col("_r") <= F.bround(F.lit(share) * F.col("_n")), n).otherwise(choice)
    return r.withColumn(out, choice).drop("_r", "_n")


def take(df: DataFrame, by: list[str], key: str, rows: Column, seed: int = 0) -> DataFrame:
    """The first rows of each group by hash; rows may use _n, the size of the group."""
    return _ranked(df, by, key, seed).filter(F.col("_r") <= rows).drop("_r", "_n")


def carve(df: DataFrame, where: str, value: str, new: str, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """df in which a fraction of the rows whose column has the value get a new value."""
    part = _ranked(df.filter(F.col(where) == value), [], key, seed)
    part = part.withColumn(where, F.when(F.col("_r") <= F.bround(F.lit(float(fraction)) * F.col("_n")), new).otherwise(value)).drop("_r", "_n")
    return part.select(*df.columns).unionByName(df.filter(F.col(where) != value))


def held_out_protocol(df: DataFrame, label: str, held: str, key: str, golden: float = 0.1, seed: int = 0) -> DataFrame:
    """df with a role: a tenth of each class golden; the rest of the held-out class held; of the others half base, half reserve."""
    r = _ranked(df, [label], key, seed)
    gold = F.bround(F.lit(golden) * F.col("_n"))
    half = gold + F.floor((F.col("_n") - gold) / 2)
    role = F.when(F.col("_r") <= gold, "golden").when(F.col(label) == held, "held").when(F.col("_r") <= half, "base").otherwise("reserve")
    return r.withColumn("role", role).drop("_r", "_n")


def rebalance_short(df: DataFrame, text: str, key: str, share: float, longest: int = 10, seed: int = 0) -> DataFrame:
    """All rows of longer texts, and so many short ones that they make up the share."""
    short = F.length(text) <= longest
    quota = df.agg(F.bround(F.count_if(~short) * share / (1 - share)).cast("long").alias("_q"))  # one row
    some = _ranked(df.filter(short), [], key, seed).join(F.broadcast(quota)).filter("_r <= _q").select(*df.columns)
    return df.filter(~short).unionByName(some)


def balance(df: DataFrame, label: str, key: str, cap: int | None = None, seed: int = 0) -> DataFrame:
    """As many rows of each label as the smallest has (or cap)."""
    least = df.groupBy(label).agg(F.count("*").alias("_c")).agg(F.min("_c").alias("_q"))  # one row
    rows = _ranked(df, [label], key, seed).join(F.broadcast(least))
    return rows.filter(F.col("_r") <= (F.col("_q") if cap is None else F.least("_q", F.lit(cap)))).select(*df.columns)


def rehearsal_pool(base: DataFrame, new: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """A fraction of the base rows by hash, and all new ones; nought or less means new rows alone."""
    if fraction <= 0:
        return new
    return take(base, [], key, F.bround(F.lit(float(fraction)) * F.col("_n")), seed).unionByName(new)


def reservoir(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """So many rows by hash, ranked within buckets of it: no task holds them all."""
    return take(df, [], key, F.lit(rows), seed)


def with_replacement(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """So many draws, each row as often as it is drawn: draw d takes the row of rank hash(seed:d) mod n."""
    r = _ranked(df, [], key, seed)
    draws = df.sparkSession.range(1, rows + 1).select(F.col("id").alias("draw"))
    n = df.agg(F.count("*").alias("_n"))  # one row
    draws = draws.join(F.broadcast(n)).filter("_n > 0").select("draw", (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string")), 256), 1, 8), 16, 10).cast("long") % F.col("_n") + 1).alias("_r"))
    return r.drop("_n").join(draws, "_r").drop("_r")


def replay_stream(benign: DataFrame, known: DataFrame, fresh: DataFrame, key: str, rate: float, share_a: float, new_share: float, seed: int = 0) -> DataFrame:
    """A stream of phase A (known attacks alone) and phase B (new_share of its attacks are fresh), ordered by hash within the phase.

    The benign supply sets the size: total = floor(n / (1 - rate)). Attacks are taken while they last.
    """
    total = benign.agg(F.floor(F.count("*") / (1 - rate)).cast("long").alias("_total"))  # one row
    quota = total.select(F.round(F.col("_total") * share_a).cast("long").alias("_a"), (F.col("_total") - F.round(F.col("_total") * share_a).cast("long")).alias("_bn"))
    quota = quota.select(F.round(F.col("_a") * rate).cast("long").alias("_ka"), (F.round(F.col("_bn") * rate) - F.round(F.col("_bn") * rate * new_share)).cast("long").alias("_kb"), F.round(F.col("_bn") * rate * new_share).cast("long").alias("_nb"), (F.col("_a") - F.round(F.col("_a") * rate)).cast("long").alias("_ba"))
    columns = benign.columns

    def cut(df: DataFrame, phase: Column) -> DataFrame:
        return _ranked(df, [], key, seed).join(F.broadcast(quota)).withColumn("phase", phase).filter("phase is not null").select(*columns, "phase")

    r = F.col("_r")
    rows = cut(benign, F.when(r <= F.col("_ba"), "A").otherwise("B"))
    rows = rows.unionByName(cut(known, F.when(r <= F.col("_ka"), "A").when(r <= F.col("_ka") + F.col("_kb"), "B")))
    rows = rows.unionByName(cut(fresh, F.when(r <= F.col("_nb"), "B")))
    from trafficwarden.operators.order import with_position

    h = sample_key(key, f"{seed}:order")
    return with_position(rows.withColumn("_h", h).withColumn("_k", F.concat("phase", F.substring("_h", 1, 2))), ["phase", "_h", key], bucket=F.col("_k")).drop("_h", "_k")


def pours(head: DataFrame, one: DataFrame, two: DataFrame, benign: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Quiet head, then two scenarios, each with benign rows in proportion to its size; columns chunk and position are added."""
    n1, n2 = one.agg(F.count("*").alias("_n1")), two.agg(F.count("*").alias("_n2"))
    cut = F.floor(F.col("_n") * F.col("_n1") / F.nullif(F.col("_n1") + F.col("_n2"), F.lit(0)))
    shared = _ranked(benign, [], key, seed).join(F.broadcast(n1)).join(F.broadcast(n2)).withColumn("chunk", F.when(F.col("_r") <= F.coalesce(cut, F.lit(0)), "1_first").otherwise("2_second")).select(*benign.columns, "chunk")
    rows = head.withColumn("chunk", F.lit("0_quiet")).unionByName(one.withColumn("chunk", F.lit("1_first"))).unionByName(two.withColumn("chunk", F.lit("2_second"))).unionByName(shared)
    from trafficwarden.operators.order import with_position

    rows = rows.withColumn("_h", sample_key(key, f"{seed}:order")).withColumn("_k", F.concat("chunk", F.substring("_h", 1, 2)))
    return with_position(rows, ["chunk", "_h", key], bucket=F.col("_k")).drop("_h", "_k")


def mixed_validation(df: DataFrame, positive: Column, key: str, fraction: float, cap: int, seed: int = 0) -> DataFrame:
    """Rows with split: fit (benign alone, no labels needed) and valid, which has a fraction of the benign rows and as many positives, each at most cap."""
    benign = random_split(df.filter(~positive), key, fraction, seed, ("valid", "fit"))
    chosen = take(benign.filter("split = 'valid'"), [], key, F.lit(cap), seed)
    n = chosen.agg(F.count("*").alias("_most"))  # one row
    ranked = _ranked(df.filter(positive), [], key, seed).join(F.broadcast(n)).filter(F.col("_r") <= F.col("_most"))
    positives = ranked.select(*df.columns).withColumn("split", F.lit("valid"))
    return benign.filter("split = 'fit'").unionByName(chosen.select(*benign.columns)).unionByName(positives)


def split_by_entity(df: DataFrame, entity: str, fraction: float, seed: int = 0, out: str = "split") -> DataFrame:
    """df with a split by the hash of an entity, so no entity is on both sides."""
    share = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn(out, F.when(share < fraction, "test").otherwise("train"))


def equal_groups(df: DataFrame, group: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each of two groups as the smaller has."""
    return balance(df, group, key, None, seed)


# Parts of the made stacked payloads.
PREFIXES = ["1", "'1'", "1'", "admin", "' OR '1'='1", '" OR "1"="1', "SELECT * FROM users WHERE id=1", "' AND 1=1", "1)", "')", "0"]
STATEMENTS = ["DROP TABLE users", "DROP TABLE customers", "DROP DATABASE test", "TRUNCATE TABLE users", "INSERT INTO users(username,password) VALUES('hacker','pwned')", "UPDATE users SET password='pwned' WHERE username='admin'", "DELETE FROM logs", "CREATE USER hacker IDENTIFIED BY 'pwned'", "GRANT ALL PRIVILEGES ON *.* TO 'hacker'@'%'", "EXEC xp_cmdshell('whoami')", "EXEC master..xp_cmdshell 'ping 10.0.0.1'"]
TERMINATORS = ["--", "#", ""]


def stacked_payloads(spark, limit: int | None = None) -> DataFrame:
    """n and payload: every prefix with every statement and terminator, 363 rows in fixed order."""
    of = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    rows = spark.range(len(PREFIXES) * len(STATEMENTS) * len(TERMINATORS)).withColumnRenamed("id", "n")
    t, s = F.col("n") % len(TERMINATORS), F.floor(F.col("n") / len(TERMINATORS))
    out = rows.select("n", F.concat(of(PREFIXES, F.floor(s / len(STATEMENTS))), F.lit("; "), of(STATEMENTS, s % len(STATEMENTS)), of(TERMINATORS, t)).alias("payload"))
    return out if limit is None else out.filter(F.col("n") < limit)


def stacked_on(df: DataFrame, text: str) -> DataFrame:
    """df with n (from 0) and payload: each text with every statement and terminator behind it."""
    endings = [f"; {s}{t}" for s in STATEMENTS for t in TERMINATORS]
    return df.select("*", F.posexplode(F.array(*[F.lit(e) for e in endings])).alias("n", "_end")).withColumn("payload", F.concat(text, "_end")).drop("_end")


def fragment_sessions(payloads: DataFrame, text: str, key: str, parts: int = 4, seed: int = 0) -> DataFrame:
    """A session of label 3 for each payload: its fragments in order, with gaps made from a hash."""
    from trafficwarden.functions.text import fragments

    rows = payloads.select(F.concat(F.lit("split:"), F.col(key).cast("string")).alias("session_id"), F.posexplode(fragments(F.col(text), parts, seed)).alias("step_index", "query_raw"))
    gap = F.when(F.col("step_index") == 0, 0.0).otherwise(F.round(1 + F.pmod(F.xxhash64("session_id", "step_index"), F.lit(5000)) / 1000.0, 6))
    return rows.select("session_id", "step_index", "query_raw", gap.alias("gap_seconds"), F.lit(3).alias("session_label"))
