"""Stand-ins for the input tables, derived row by row from the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.functions.hashing import hash_int
from foldwise.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_sql(key: str, seed) -> str:
    return f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT"


def line_key():
    """Text key of a lineitem row; the price tells equal lines of one order apart."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


# --- claims: lineitem with part -------------------------------------------------

CLAIM_CATS = ["cat1", "cat2", "cat3", "cat4"]
CLAIM_NUMS = ["cont1", "cont2", "cont3"]


def claims(spark, sf_dir) -> DataFrame:
    items = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    joined = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    key = line_key()
    rows = joined.select(
        key.alias("id"),
        F.col("l_returnflag").alias("cat1"),
        F.col("l_linestatus").alias("cat2"),
        F.col("p_brand").alias("cat3"),
        F.col("p_type").alias("cat4"),
        F.col("l_quantity").alias("cont1"),
        F.col("l_discount").alias("cont2"),
        F.col("l_tax").alias("cont3"),
        F.col("l_extendedprice").alias("loss"),
    )
    return rows.withColumn("split", F.when(hash_int(F.col("id"), "split") % 10 < 3, "test").otherwise("train"))


CLAIMS = f"""claims0 AS (
  SELECT {LINE_KEY} AS id,
         l_returnflag AS cat1, l_linestatus AS cat2, p_brand AS cat3, p_type AS cat4,
         l_quantity AS cont1, l_discount AS cont2, l_tax AS cont3, l_extendedprice AS loss
  FROM lineitem JOIN part ON l_partkey = p_partkey),
claims AS (SELECT *, CASE WHEN {md5_sql('id', 'split')} % 10 < 3 THEN 'test' ELSE 'train' END AS split FROM claims0)"""


# --- sessions: orders with customer --------------------------------------------

def _lnglat(key):
    return F.format_string("%.2f,%.2f", F.lit(100) + key * F.lit(0.5), F.lit(20) + key * F.lit(0.75))


def sessions(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(people, orders["o_custkey"] == people["c_custkey"])
    target = (F.col("c_nationkey") + F.col("o_orderkey") % 5) % 25
    # orders carry a date only: minutes of the day are derived from the key
    moment = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") * 7919) % 86400)
    later = F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (F.col("o_orderkey") * 7919) % 86400 + F.col("o_orderkey") % 97)
    return joined.select(
        F.col("o_orderkey").alias("sid"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("pid"),
        moment.cast("timestamp_ntz").alias("req_time"),
        later.cast("timestamp_ntz").alias("plan_time"),
        _lnglat(F.col("c_nationkey")).alias("o"),
        _lnglat(target).alias("d"),
    )


SESSIONS = """sessions AS (
  SELECT o_orderkey AS sid, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS pid,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS req_time,
         o_orderdate + to_seconds((o_orderkey * 7919) % 86400 + o_orderkey % 97) AS plan_time,
         printf('%.2f,%.2f', (100 + c_nationkey * 0.5)::DOUBLE, (20 + c_nationkey * 0.75)::DOUBLE) AS o,
         printf('%.2f,%.2f', (100 + ((c_nationkey + o_orderkey % 5) % 25) * 0.5)::DOUBLE,
                             (20 + ((c_nationkey + o_orderkey % 5) % 25) * 0.75)::DOUBLE) AS d
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def clicks(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    mode = (F.col("o_orderkey") % 12).cast("int")
    return orders.select(F.col("o_orderkey").alias("sid"), mode.alias("click_mode")).filter("click_mode <> 0")


CLICKS = """clicks AS (
  SELECT o_orderkey AS sid, CAST(o_orderkey % 12 AS INTEGER) AS click_mode FROM orders WHERE o_orderkey % 12 <> 0)"""


def addresses(spark, sf_dir) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(
        _lnglat(F.col("n_nationkey")).alias("lntlat"),
        F.col("n_name").alias("district"),
        F.col("n_regionkey").alias("adcode"),
        (F.col("n_nationkey") % 4).cast("string").alias("street_number"),
    )


ADDRESSES = """addresses AS (
  SELECT printf('%.2f,%.2f', (100 + n_nationkey * 0.5)::DOUBLE, (20 + n_nationkey * 0.75)::DOUBLE) AS lntlat,
         n_name AS district, n_regionkey AS adcode, CAST(n_nationkey % 4 AS VARCHAR) AS street_number
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


# --- plan lists: one JSON list per lineitem row, l_linenumber items -------------

def plan_lists(spark, sf_dir) -> DataFrame:
    return plan_lists_of(spread(table(spark, sf_dir, "lineitem")))


def plan_lists_of(items: DataFrame, keep=()) -> DataFrame:
    n = F.col("l_linenumber")

    def plan(j):
        price = F.col("l_quantity").cast("long") * 100 + j * 50 * (n % 2)
        return F.struct(
            ((F.col("l_partkey") * (j + 2)) % 97 * 100 + 50).cast("string").alias("distance"),
            F.when((F.col("l_suppkey") + j) % 4 == 0, "").otherwise(price.cast("string")).alias("price"),
            ((F.col("l_partkey") * j) % 3600 + 1).cast("string").alias("eta"),
            ((F.col("l_suppkey") + j * j) % 11 + 1).cast("string").alias("transport_mode"),
        )

    text = F.to_json(F.transform(F.sequence(F.lit(1), n), plan))
    kind = F.col("l_orderkey") % 50
    plans = F.when(kind == 0, F.lit(None)).when(kind == 1, "bad").when(kind == 2, "[]").otherwise(text)
    key = line_key()
    return items.select(key.alias("sid"), F.col("l_shipdate").alias("plan_time"), plans.alias("plans"), *keep)


PLAN_ROWS = f"""plan_lists AS (
  SELECT {LINE_KEY} AS sid, l_shipdate AS plan_time,
         l_orderkey % 50 >= 3 AS good, l_linenumber AS n, l_partkey, l_suppkey, l_quantity
  FROM lineitem),
plan_rows AS (
  SELECT sid, plan_time, j AS pos, (l_partkey * (j + 2)) % 97 * 100 + 50 AS distance,
         CASE WHEN (l_suppkey + j) % 4 = 0 THEN NULL
              ELSE CAST(l_quantity AS BIGINT) * 100 + j * 50 * (n % 2) END AS price,
         (l_partkey * j) % 3600 + 1 AS eta, CAST((l_suppkey + j * j) % 11 + 1 AS INTEGER) AS mode
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM plan_lists WHERE good))"""


# --- plans as rows: lineitem grouped by order ----------------------------------

def plan_items(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    price = F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_quantity") * 100))
    return items.select(
        F.col("l_orderkey").alias("sid"),
        F.col("l_linenumber").alias("line"),
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("plan_time"),
        F.floor("l_extendedprice").alias("distance"),
        price.alias("price"),
        (F.col("l_partkey") % 3600 + 1).alias("eta"),
        (F.col("l_suppkey") % 11 + 1).cast("int").alias("mode"),
    )


PLAN_ITEMS = """items AS (
  SELECT l_orderkey AS sid, l_linenumber AS line, l_partkey, l_suppkey, l_shipdate AS plan_time,
         CAST(floor(l_extendedprice) AS BIGINT) AS distance,
         CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity * 100) AS BIGINT) END AS price,
         l_partkey % 3600 + 1 AS eta, CAST(l_suppkey % 11 + 1 AS INTEGER) AS mode
  FROM lineitem)"""
ITEM_ORDER = ["line", "l_partkey", "l_suppkey"]


# --- history: events ------------------------------------------------------------

# fixed values: event types as class numbers
EVENT_MODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def history(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    mode = None
    for name, number in EVENT_MODES.items():
        hit = F.col("event_type") == name
        mode = F.when(hit, number) if mode is None else mode.when(hit, number)
    return events.select(
        F.col("event_id").alias("sid"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("pid"),
        F.col("ts").alias("req_time"),
        F.when(F.col("event_id") % 61 == 0, -1).otherwise(mode).alias("mode"),
        "value",
    )


HISTORY = """history AS (
  SELECT event_id AS sid, CASE WHEN user_id % 10 <> 0 THEN user_id END AS pid, ts AS req_time,
         CASE WHEN event_id % 61 = 0 THEN -1
              ELSE CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                   WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END END AS mode, value
  FROM events),
hist AS (SELECT sid, coalesce(pid, -1) AS pid, req_time, mode, value FROM history)"""


def history_filled(spark, sf_dir) -> DataFrame:
    return history(spark, sf_dir).withColumn("pid", F.coalesce("pid", F.lit(-1)))


# --- profiles: embeddings -------------------------------------------------------

N_PROFILE = 64


def profiles(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("pid"), *[F.col("embedding")[i].cast("double").alias(f"p{i}") for i in range(N_PROFILE)]
    )


# --- batches: events by three days ----------------------------------------------

BATCH_DAYS = 3


def batch_columns(events: DataFrame, start) -> DataFrame:
    """Batch number, inputs and label of every event, counted from the day ``start``."""
    days = F.datediff("ts", start)
    k = F.get_json_object("props", "$.k").cast("int")
    text = lambda c: c.cast("string")
    return events.select(
        F.col("event_id").alias("id"),
        F.floor(days / BATCH_DAYS).cast("int").alias("batch_no"),
        F.when(k % 13 != 0, F.col("value")).alias("num1"),
        F.when(F.col("user_id") % 10 != 0, text(F.col("user_id"))).alias("cat1"),
        text(k % 17).alias("cat2"),
        F.when(k % 11 != 0, F.concat_ws(",", text(k % 7), text(k % 5), text(F.col("user_id") % 9))).alias("mv1"),
        (F.col("event_type") == "purchase").cast("int").alias("y"),
    )


def batches(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return batch_columns(events, events.agg(F.min("ts")).scalar())


BATCHES = f"""ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, (SELECT min(ts) FROM events) AS t0 FROM events),
batches AS (
  SELECT event_id AS id, CAST(floor(date_diff('day', CAST(t0 AS DATE), CAST(ts AS DATE)) / {BATCH_DAYS}) AS INTEGER) AS batch_no,
         CASE WHEN k % 13 <> 0 THEN value END AS num1,
         CASE WHEN user_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS cat1,
         CAST(k % 17 AS VARCHAR) AS cat2,
         CASE WHEN k % 11 <> 0 THEN concat_ws(',', k % 7, k % 5, user_id % 9) END AS mv1,
         CAST(event_type = 'purchase' AS INTEGER) AS y
  FROM ev)"""


# --- predictions: orders --------------------------------------------------------

def predictions(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    h = hash_int(F.col("o_orderkey"), "pred") / F.lit(4294967296.0)
    n = hash_int(F.col("o_orderkey"), "cls")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("truth"),
        (F.col("o_totalprice") * (F.lit(0.8) + F.lit(0.4) * h)).alias("pred"),
        (F.col("o_orderkey") % 12).cast("int").alias("label"),
        F.when(n % 3 == 0, n % 12).otherwise(F.col("o_orderkey") % 12).cast("int").alias("guess"),
        (F.col("o_orderpriority") < "3").cast("int").alias("hit"),
        F.round(F.col("o_totalprice") / 5000, 0).alias("score"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT o_orderkey AS id, o_totalprice AS truth,
         o_totalprice * (0.8::DOUBLE + 0.4::DOUBLE * ({md5_sql('o_orderkey', 'pred')} / 4294967296.0::DOUBLE)) AS pred,
         CAST(o_orderkey % 12 AS INTEGER) AS label,
         CAST(CASE WHEN {md5_sql('o_orderkey', 'cls')} % 3 = 0 THEN {md5_sql('o_orderkey', 'cls')} % 12
                   ELSE o_orderkey % 12 END AS INTEGER) AS guess,
         CAST(o_orderpriority < '3' AS INTEGER) AS hit, round(o_totalprice / 5000, 0) AS score
  FROM orders)"""


def class_scores(spark, sf_dir, n: int = 12) -> DataFrame:
    """Twelve class probabilities per order."""
    base = predictions(spark, sf_dir).select("id", "label")
    raw = base.withColumns({f"_w{i}": (hash_int(F.col("id"), f"c{i}") % 1000 + 1).cast("double") for i in range(n)})
    total = sum((F.col(f"_w{i}") for i in range(n)), F.lit(0.0))
    boosted = raw.withColumns({f"_w{i}": F.when(F.col("label") == i, F.col(f"_w{i}") * 4).otherwise(F.col(f"_w{i}")) for i in range(n)})
    return boosted.withColumn("_t", total).select("id", "label", *[(F.col(f"_w{i}") / F.col("_t")).alias(f"c{i}") for i in range(n)])


CLASS_SCORES = f"""{PREDICTIONS},
raw_scores AS (SELECT id, label, {', '.join(f"(CASE WHEN label = {i} THEN 4 ELSE 1 END) * ({md5_sql('id', f'c{i}')} % 1000 + 1)::DOUBLE AS w{i}" for i in range(12))} FROM predictions),
class_scores AS (SELECT id, label, {', '.join(f"w{i} / ({' + '.join(f'w{j}' for j in range(12))}) AS c{i}" for i in range(12))} FROM raw_scores)"""
