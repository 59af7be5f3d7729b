"""Registered queries: windows, order and sets, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import calendar, geo, numeric, plans_json
from foldwise.operators import rows as R, windows as W
from foldwise.plans import fixtures as X
from foldwise.plans.registry import query, r6
from foldwise.session import own_session

# --- windows ----------------------------------------------------------------------

_H = f"WITH {X.HISTORY}"
_OVER = "(PARTITION BY pid ORDER BY req_time, sid)"
_PREV = "(PARTITION BY pid ORDER BY req_time, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "w1_lag",
    f"""{_H} SELECT sid, coalesce(lag(mode) OVER {_OVER}, 0) AS last_mode,
    epoch_us(coalesce(lag(req_time) OVER {_OVER}, (SELECT min(req_time) FROM hist))) AS last_time FROM hist""",
)
def lag(spark, sf):
    rows = X.history_filled(spark, sf)
    done = W.lag_by(rows, ["pid"], ["req_time", "sid"], "mode", "last_mode", 0)
    done = W.since_previous(done, ["pid"], "req_time", ["sid"])
    return done.select("sid", "last_mode", F.unix_micros(F.col("last_time").cast("timestamp")).alias("last_time"))


# Every history begins with the one before it. These pages of Parquet keep the length of that common front and the rest
# only, so what is written grows with the rows and not with their square. Dictionary and bounds of such texts help no reader.
_FRONT_CODED = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#history": "false",
    "parquet.column.statistics.enabled#history": "false",
}


@query(
    "w2_history_list",
    f"""{_H} SELECT sid, list(mode) OVER (PARTITION BY pid ORDER BY req_time, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h, row_number() OVER {_OVER} AS n FROM hist""".replace(
        "SELECT sid, list(mode)", "SELECT sid, coalesce(array_to_string(h, ','), '') AS history FROM (SELECT sid, list(mode)"
    )
    + ")",
)
def history_list(spark, sf):
    rows = X.history_filled(own_session(spark, _FRONT_CODED), sf)
    done = W.history_list(rows, ["pid"], ["req_time", "sid"], "mode", "history", sep=",")
    return done.select("sid", "history")


_STOPPED = f"""{_H}, stopped AS (SELECT *, max((mode = -1)::INTEGER) OVER (PARTITION BY pid ORDER BY req_time, sid) AS stop FROM hist),
counted AS (SELECT sid, {', '.join(f'coalesce(sum((mode = {i} AND stop = 0)::INTEGER) OVER {_PREV}, 0)::BIGINT AS n{i}' for i in range(12))} FROM stopped),
shares AS (SELECT sid, {', '.join(f'n{i}' for i in range(12))}, {' + '.join(f'n{i}' for i in range(12))} AS total FROM counted)"""
_SHARE = ", ".join(f"round(CASE WHEN total > 0 THEN n{i}::DOUBLE / total ELSE 0 END, 6) AS mode_num_{i}" for i in range(12))
_BEST = (
    "CASE WHEN total = 0 THEN 0 ELSE list_position(["
    + ", ".join(f"n{i}" for i in range(12))
    + "], greatest("
    + ", ".join(f"n{i}" for i in range(12))
    + ")) - 1 END"
)


@query("w3_history_share", f"{_STOPPED} SELECT sid, {_SHARE} FROM shares")
def history_share(spark, sf):
    done = W.history_share(X.history_filled(spark, sf), ["pid"], ["req_time", "sid"], "mode", 12).result()
    return done.select("sid", *r6(*[f"mode_num_{i}" for i in range(12)]))


@query("w4_history_mode", f"{_STOPPED} SELECT sid, CAST({_BEST} AS INTEGER) AS max_mode FROM shares")
def history_mode(spark, sf):
    return W.history_mode(X.history_filled(spark, sf), ["pid"], ["req_time", "sid"], "mode", 12).select("sid", "max_mode")


_SINCE = f"""lagged AS (SELECT sid, req_time, coalesce(lag(req_time) OVER {_OVER}, (SELECT min(req_time) FROM hist)) AS last_time FROM hist)"""


@query(
    "w5_since_previous",
    f"""{_H}, {_SINCE} SELECT sid, CAST(floor(epoch_us(req_time) / 1000000) - floor(epoch_us(last_time) / 1000000) AS BIGINT) AS since_last,
    CAST(isodow(last_time) - 1 AS INTEGER) AS last_weekday, CAST(hour(last_time) AS INTEGER) AS last_hour FROM lagged""",
)
def since_previous(spark, sf):
    done = W.since_previous(X.history_filled(spark, sf), ["pid"], "req_time", ["sid"])
    return done.select("sid", "since_last", "last_weekday", "last_hour")


@query(
    "w6_running_counts",
    f"""{_H}, lagged AS (SELECT sid, pid, req_time, coalesce(lag(mode) OVER {_OVER}, 0) AS last_mode FROM hist)
    SELECT sid, {', '.join(f'sum((last_mode = {i})::INTEGER) OVER (PARTITION BY pid ORDER BY req_time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS till_now_{i}' for i in range(12))} FROM lagged""",
)
def running_counts(spark, sf):
    rows = W.lag_by(X.history_filled(spark, sf), ["pid"], ["req_time", "sid"], "mode", "last_mode", 0)
    return W.running_counts(rows, ["pid"], "req_time", "last_mode", 12).select("sid", *[f"till_now_{i}" for i in range(12)])


@query("w7_list_ordinal", f"WITH {X.PLAN_ROWS} SELECT sid, pos, mode FROM plan_rows")
def list_ordinal(spark, sf):
    return plans_json.explode_plans(X.plan_lists(spark, sf), "plans", ["sid"]).select("sid", F.col("pos").cast("bigint").alias("pos"), "mode")


@query(
    "w7_list_rank",
    f"WITH {X.PLAN_ITEMS} SELECT sid, line, l_partkey, l_suppkey, row_number() OVER (PARTITION BY sid ORDER BY line, l_partkey, l_suppkey) AS rank FROM items",
)
def list_rank(spark, sf):
    return W.list_rank(X.plan_items(spark, sf), ["sid"], X.ITEM_ORDER).select("sid", *X.ITEM_ORDER, "rank")


@query(
    "w8_average_rank",
    f"""WITH {X.CLAIMS}, long AS (SELECT id, 'cont1' AS feature, cont1 AS value FROM claims UNION ALL SELECT id, 'loss', loss FROM claims)
    SELECT id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rank FROM long""",
)
def average_rank(spark, sf):
    return W.average_rank(X.claims(spark, sf), ["cont1", "loss"], "id").select("id", "feature", "rank")


@query(
    "w9_partition_aggregates",
    f"""WITH {X.PLAN_ITEMS} SELECT sid, line, l_partkey, l_suppkey, max(distance) OVER w AS max_dist, min(distance) OVER w AS min_dist,
    round(avg(distance) OVER w, 6) AS mean_dist, round(stddev_pop(distance) OVER w, 6) AS std_dist FROM items WINDOW w AS (PARTITION BY sid)""",
)
def partition_aggregates(spark, sf):
    aggs = {
        "max_dist": F.max("distance"),
        "min_dist": F.min("distance"),
        "mean_dist": F.avg("distance"),
        "std_dist": F.stddev_pop("distance"),
    }
    done = W.transform_agg(X.plan_items(spark, sf), ["sid"], aggs)
    return done.select("sid", *X.ITEM_ORDER, "max_dist", "min_dist", *r6("mean_dist", "std_dist"))


# --- order, limits, sets, samples ---------------------------------------------------


@query("l1_sort", f"{_H} SELECT row_number() OVER (ORDER BY pid, req_time, sid) AS place, sid, pid, mode FROM hist")
def sort(spark, sf):
    rows = R.sort(X.history_filled(spark, sf), ["pid", "req_time", "sid"]).select("sid", "pid", "mode")
    return R.numbered(rows).select("place", "sid", "pid", "mode")


@query("l2_top_k", "SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1 ORDER BY cnt DESC, l_partkey LIMIT 10")
def top_k(spark, sf):
    return R.top_k(X.table(spark, sf, "lineitem"), "l_partkey", 10)


@query("l3_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def head(spark, sf):
    return R.head(X.table(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_orderkey", "o_totalprice")


@query(
    "u1_union_splits",
    f"WITH {X.CLAIMS} SELECT split, count(*) AS n, round(sum(loss), 2) AS total FROM claims GROUP BY split",
)
def union_splits(spark, sf):
    rows = X.claims(spark, sf)
    both = R.vstack({s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "test")})
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 2).alias("total"))


@query(
    "u2_union_parts",
    f"WITH {X.CLAIMS} SELECT id, cont1, cat1 FROM claims",
)
def union_parts(spark, sf):
    rows = X.claims(spark, sf)
    datasets = [
        {"numeric": d.select("id", "cont1"), "categorical": d.select("id", "cat1")}
        for d in (rows.filter("split = 'train'"), rows.filter("split = 'test'"))
    ]
    parts = R.concat_parts(datasets)
    return parts["numeric"].join(parts["categorical"], "id")


@query(
    "u3_key_difference",
    f"WITH {X.CLICKS} SELECT o_orderkey AS sid FROM orders EXCEPT SELECT sid FROM clicks",
)
def key_difference(spark, sf):
    keys = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("sid"))
    return R.key_difference(keys, X.clicks(spark, sf), "sid")


@query("u4_distinct_values", "SELECT DISTINCT p_name FROM part")
def distinct(spark, sf):
    return R.distinct(X.table(spark, sf, "part"), "p_name")


@query(
    "u5_holdout",
    f"SELECT o_orderkey, CASE WHEN ({X.md5_sql('o_orderkey', 42)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE < 0.22::DOUBLE THEN 'val' ELSE 'train' END AS split FROM orders",
)
def holdout(spark, sf):
    return R.holdout(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.22, 42)


@query(
    "u6_exact_sample",
    """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || '|42'), CAST(o_orderkey AS VARCHAR)) AS rn, count(*) OVER () AS n FROM orders)
    WHERE rn <= floor(0.3::DOUBLE * n)""",
)
def exact_sample(spark, sf):
    return R.sample_exact(X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.3, 42)


@query(
    "u7_column_sample",
    f"WITH {X.CLAIMS} SELECT id, " + ", ".join(R.sample_columns(X.CLAIM_CATS + X.CLAIM_NUMS, 0.5, 42)) + " FROM claims",
)
def column_sample(spark, sf):
    return X.claims(spark, sf).select("id", *R.sample_columns(X.CLAIM_CATS + X.CLAIM_NUMS, 0.5, 42))


@query(
    "u8_kfold",
    f"SELECT o_orderkey, CAST({X.md5_sql('o_orderkey', 2016)} % 5 AS INTEGER) AS fold_0, CAST({X.md5_sql('o_orderkey', 2033)} % 5 AS INTEGER) AS fold_1 FROM orders",
)
def kfold(spark, sf):
    rows = X.table(spark, sf, "orders").select("o_orderkey")
    for split in (0, 1):
        rows = R.kfold(rows, "o_orderkey", 5, 2016 + 17 * split, f"fold_{split}")
    return rows


@query(
    "u9_stratified_kfold",
    """SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '|2016'), CAST(o_orderkey AS VARCHAR)) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def stratified(spark, sf):
    rows = X.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.stratified_kfold(rows, "o_orderkey", "o_orderstatus", 5, 2016)


# --- scalar functions ---------------------------------------------------------------


@query(
    "f1_split_pair",
    f"WITH {X.SESSIONS} SELECT sid, split_part(o, ',', 1)::DOUBLE AS o1, split_part(o, ',', 2)::DOUBLE AS o2 FROM sessions",
)
def split_pair(spark, sf):
    lng, lat = geo.split_pair(F.col("o"))
    return X.sessions(spark, sf).select("sid", lng.alias("o1"), lat.alias("o2"))


def _ends(spark, sf):
    rows = X.sessions(spark, sf)
    o1, o2 = geo.split_pair(F.col("o"))
    d1, d2 = geo.split_pair(F.col("d"))
    return rows.select("sid", o1.alias("o1"), o2.alias("o2"), d1.alias("d1"), d2.alias("d2"))


_ENDS = f"""WITH RECURSIVE {X.SESSIONS}, ends AS (SELECT sid, split_part(o, ',', 1)::DOUBLE AS o1, split_part(o, ',', 2)::DOUBLE AS o2,
  split_part(d, ',', 1)::DOUBLE AS d1, split_part(d, ',', 2)::DOUBLE AS d2 FROM sessions)"""
_HAVERSINE = f"""2 * {geo.MEAN_RADIUS} * asin(sqrt(least(1.0, pow(sin(radians(d2 - o2) / 2), 2) + cos(radians(o2)) * cos(radians(d2)) * pow(sin(radians(d1 - o1) / 2), 2))))"""

# the ellipsoid distance of every distinct pair of ends, thirty rounds of Vincenty's iteration
_VINCENTY = f"""{_ENDS},
pairs AS (SELECT DISTINCT o1, o2, d1, d2 FROM ends),
start AS (SELECT *, radians(d1 - o1) AS span, atan((1 - f) * tan(radians(o2))) AS u1, atan((1 - f) * tan(radians(d2))) AS u2
          FROM pairs, (SELECT (1 / 298.257223563::DOUBLE) AS f, 6378137.0::DOUBLE AS a)),
rounds AS (
  SELECT *, 0 AS i, span AS lam FROM start
  UNION ALL
  SELECT o1, o2, d1, d2, f, a, span, u1, u2, i + 1,
         span + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1)))
  FROM (SELECT *, f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a)) AS c,
               CASE WHEN cos2_a > 0 THEN cos_s - 2 * sin(u1) * sin(u2) / cos2_a ELSE 0 END AS mid
        FROM (SELECT *, 1 - sin_a * sin_a AS cos2_a, atan2(sin_s, cos_s) AS sigma
              FROM (SELECT *, CASE WHEN sin_s > 0 THEN cos(u1) * cos(u2) * sin(lam) / sin_s ELSE 0 END AS sin_a
                    FROM (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS sin_s,
                                 sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM rounds WHERE i < 30))))),
last AS (SELECT *, cos2_a * (a * a - b * b) / (b * b) AS uu, CASE WHEN cos2_a > 0 THEN cos_s - 2 * sin(u1) * sin(u2) / cos2_a ELSE 0 END AS mid
  FROM (SELECT *, 1 - sin_a * sin_a AS cos2_a, atan2(sin_s, cos_s) AS sigma, a * (1 - f) AS b
        FROM (SELECT *, CASE WHEN sin_s > 0 THEN cos(u1) * cos(u2) * sin(lam) / sin_s ELSE 0 END AS sin_a
              FROM (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS sin_s,
                           sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cos_s FROM rounds WHERE i = 30)))),
metres AS (SELECT o1, o2, d1, d2, b * ka * (sigma - kb * sin_s * (mid + kb / 4 * (cos_s * (2 * mid * mid - 1)
    - kb / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * mid * mid - 3)))) AS m
  FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb FROM last))"""


@query("f2_geodesic", f"{_VINCENTY} SELECT sid, round(m, 3) AS metres FROM ends JOIN metres USING (o1, o2, d1, d2)")
def geodesic(spark, sf):
    metres = geo.geodesic_m(F.col("o2"), F.col("o1"), F.col("d2"), F.col("d1"))
    return _ends(spark, sf).select("sid", F.round(metres, 3).alias("metres"))


@query("f2_haversine", f"{_ENDS} SELECT sid, round({_HAVERSINE}, 3) AS metres FROM ends")
def haversine(spark, sf):
    metres = geo.haversine_m(F.col("o2"), F.col("o1"), F.col("d2"), F.col("d1"))
    return _ends(spark, sf).select("sid", F.round(metres, 3).alias("metres"))


@query("f3_safe_json", f"WITH {X.PLAN_ROWS} SELECT sid, CAST(CASE WHEN good THEN n ELSE 0 END AS INTEGER) AS n_plans FROM plan_lists")
def safe_json(spark, sf):
    return X.plan_lists(spark, sf).select("sid", F.size(plans_json.parse_plans(F.col("plans"))).alias("n_plans"))


@query("f4_literal_list", f"WITH {X.PLAN_ROWS} SELECT sid, pos, mode FROM plan_rows")
def literal_list(spark, sf):
    # a list written with single quotes, as Python prints it
    rows = X.plan_lists(spark, sf).withColumn("plans", F.translate("plans", '"', "'"))
    done = plans_json.explode_plans(rows, "plans", ["sid"])
    return done.select("sid", F.col("pos").cast("bigint").alias("pos"), "mode")


@query("f5_explode_plans", f"WITH {X.PLAN_ROWS} SELECT sid, pos, distance, price, eta, mode FROM plan_rows")
def explode_plans(spark, sf):
    done = plans_json.explode_plans(X.plan_lists(spark, sf), "plans", ["sid"])
    return done.withColumn("pos", F.col("pos").cast("bigint"))


@query("f6_empty_price", f"WITH {X.PLAN_ROWS} SELECT sid, pos, price AS price_null, coalesce(price, 0) AS price_zero FROM plan_rows")
def empty_price(spark, sf):
    rows = X.plan_lists(spark, sf)
    nulls = plans_json.explode_plans(rows, "plans", ["sid"]).select("sid", F.col("pos").cast("bigint").alias("pos"), F.col("price").alias("price_null"))
    return nulls.withColumn("price_zero", F.coalesce("price_null", F.lit(0)))


@query(
    "f7_f8_f9_date_parts",
    """SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(hour(ts) AS INTEGER) AS hour,
    CASE WHEN isodow(ts) - 1 BETWEEN 1 AND 5 THEN 0 ELSE 1 END AS flag_as_is, CASE WHEN isodow(ts) - 1 BETWEEN 0 AND 4 THEN 0 ELSE 1 END AS flag_intended,
    CAST((hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS slot FROM events""",
)
def date_parts(spark, sf):
    ts = F.col("ts")
    return X.table(spark, sf, "events").select(
        "event_id",
        *[e.alias(n) for n, e in calendar.date_parts(ts).items()],
        calendar.weekday_flag(ts, True).alias("flag_as_is"),
        calendar.weekday_flag(ts, False).alias("flag_intended"),
        calendar.time_slot(ts, 30).alias("slot"),
    )


@query("f10_time_delta", f"WITH {X.SESSIONS} SELECT sid, CAST(epoch(plan_time) - epoch(req_time) AS BIGINT) AS seconds FROM sessions")
def time_delta(spark, sf):
    return X.sessions(spark, sf).select("sid", calendar.seconds_between(F.col("plan_time"), F.col("req_time")).alias("seconds"))


@query(
    "f11_f12_alpha_code",
    f"""WITH {X.CLAIMS} SELECT id, cat1 || cat2 AS pair, list_reduce(list_prepend(0.0::DOUBLE, list_transform(string_split(cat1 || cat2, ''), lambda c: (ascii(c) - 64)::DOUBLE)), lambda a, d: a * 26 + d) AS code FROM claims""",
)
def alpha_code(spark, sf):
    return X.claims(spark, sf).withColumn("pair", numeric.concat_cols(["cat1", "cat2"])).select("id", "pair", numeric.alpha_code(F.col("pair")).alias("code"))


@query(
    "f13_derived_rates",
    f"""WITH {X.PLAN_ITEMS}, r AS (SELECT *, (price * 100)::DOUBLE / nullif(distance, 0) AS unit_price, distance::DOUBLE / nullif(eta, 0) AS speed FROM items)
    SELECT sid, line, l_partkey, l_suppkey, unit_price, speed, speed / nullif(unit_price, 0) AS value_rate FROM r""",
)
def derived_rates(spark, sf):
    # single divisions of exact numbers: equal to the last bit, so not rounded
    return numeric.rates(X.plan_items(spark, sf)).select("sid", *X.ITEM_ORDER, "unit_price", "speed", "value_rate")


_REPAIRED = f"""WITH {X.PLAN_ROWS}, near AS (SELECT sid, plan_time, pos, CASE WHEN mode = 4 AND distance % 700 = 50 THEN 90 ELSE distance END AS distance,
  CASE WHEN mode IN (3, 5, 6) THEN 0 ELSE price END AS price, eta, mode FROM plan_rows),
r AS (SELECT *, CAST((hour(plan_time) * 60 + minute(plan_time)) // 30 AS INTEGER) AS slot, (price * 100)::DOUBLE / nullif(distance, 0) AS u FROM near),
m AS (SELECT *, median(u) OVER (PARTITION BY mode, slot) AS mu FROM r),
n AS (SELECT *, CASE WHEN price IS NULL OR (mode = 4 AND distance < 100) THEN mu ELSE u END AS u1,
  CASE WHEN mode = 4 AND distance < 100 THEN (price * 100)::DOUBLE / nullif(mu, 0) ELSE distance::DOUBLE END AS distance1 FROM m),
repaired AS (SELECT *, CASE WHEN price IS NULL THEN u1 * distance1 / 100 ELSE price::DOUBLE END AS price1, (price IS NULL)::INTEGER AS price_missing FROM n)"""


def _repaired(spark, sf):
    from foldwise.encoders.blocks import repaired_plans

    items = plans_json.explode_plans(X.plan_lists(spark, sf), "plans", ["sid", "plan_time"])
    near = (F.col("mode") == 4) & (F.col("distance") % 700 == 50)
    items = items.withColumn("distance", F.when(near, F.lit(90)).otherwise(F.col("distance")))
    return repaired_plans(items, "plan_time")


@query(
    "f13_repaired_plans",
    _REPAIRED + " SELECT sid, pos, round(distance1, 6) AS distance1, round(price1, 6) AS price1, price_missing FROM repaired",
)
def repaired(spark, sf):
    done = _repaired(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))
    return done.select("sid", "pos", *r6("distance1", "price1"), "price_missing")


def _session_extreme(c, n):
    known = f"FILTER ({c} IS NOT NULL)"
    return (
        f"max({c}) AS max_{n}, min({c}) AS min_{n}, round(avg({c}), 6) AS mean_{n}, round(stddev_pop({c}), 6) AS std_{n}, "
        f"first(mode ORDER BY {c} DESC, pos) {known} AS max_{n}_mode, first(mode ORDER BY {c}, pos) {known} AS min_{n}_mode"
    )


@query(
    "e17_session_plan_features",
    _REPAIRED
    + " SELECT sid, first(mode ORDER BY pos) AS first_mode, "
    + ", ".join(_session_extreme(c, n) for c, n in (("round(distance1, 2)", "dist"), ("round(price1, 2)", "price"), ("eta", "eta")))
    + " FROM repaired GROUP BY sid",
)
def session_plan_features(spark, sf):
    from foldwise.encoders.blocks import session_plan_features as block

    rows = _repaired(spark, sf).withColumns({c: F.round(c, 2) for c in ("distance1", "price1")})
    done = block(rows, ["sid"], ["pos"], "first")
    floats = [f"{w}_{n}" for w in ("mean", "std") for n in ("dist", "price", "eta")]
    return done.select(*[c for c in done.columns if c not in floats], *r6(*floats))


@query("f14_fixed_format", "SELECT o_orderkey, printf('%.2f', o_totalprice / 7) AS text FROM orders")
def fixed_format(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", numeric.fixed(F.col("o_totalprice") / 7, 2).alias("text"))


_FORWARD = {
    "log": "ln(y)",
    "log_ofs": "ln(y + 200)",
    "pow": "pow(y, 0.25)",
    "pow_ofs": "pow(y + 5, 0.2)",
    "norm": "(pow(ln(1 + y), 0.7) - 1) / 0.7",
}
_ARGS = {"log": (), "log_ofs": (200,), "pow": (0.25,), "pow_ofs": (0.2, 5), "norm": ()}


@query(
    "f15_target_transforms",
    "SELECT id, "
    + ", ".join(f"round({sql}, 6) AS {n}, round(y, 4) AS {n}_back" for n, sql in _FORWARD.items())
    + " FROM (SELECT o_orderkey AS id, o_totalprice / 100 AS y FROM orders)",
)
def target_transforms(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100).alias("y"))
    outs = []
    for name, args in _ARGS.items():
        forward, inverse = numeric.target_transform(name, *args)
        outs += [F.round(forward(F.col("y")), 6).alias(name), F.round(inverse(forward(F.col("y"))), 4).alias(f"{name}_back")]
    return rows.select("id", *outs)


@query(
    "f16_prediction_transforms",
    f"WITH {X.PREDICTIONS} SELECT id, round(ln(pred + 200), 6) AS a, round(pow(pred, 0.25), 6) AS b, round(pow(pred + 5, 0.2), 6) AS c, round(pow(pred, 1.02), 3) AS d FROM predictions",
)
def prediction_transforms(spark, sf):
    t = numeric.prediction_transform
    p = F.col("pred")
    return X.predictions(spark, sf).select(
        "id",
        F.round(t("log_ofs", 200)(p), 6).alias("a"),
        F.round(t("pow", 0.25)(p), 6).alias("b"),
        F.round(t("pow_ofs", 0.2, 5)(p), 6).alias("c"),
        F.round(t("pow", 1.02)(p), 3).alias("d"),
    )


@query(
    "f17_tokens",
    f"WITH {X.BATCHES} SELECT id, len(coalesce(string_split(mv1, ','), ['-1'])) AS n, coalesce(string_split(mv1, ','), ['-1'])[1] AS first_token FROM batches",
)
def token_lists(spark, sf):
    found = numeric.tokens(F.col("mv1"))
    return X.batches(spark, sf).select("id", F.size(found).cast("bigint").alias("n"), found[0].alias("first_token"))


_CLASSES = [f"c{i}" for i in range(12)]


@query(
    "f18_row_argmax",
    f"WITH {X.CLASS_SCORES} SELECT id, CAST(list_position([{', '.join(_CLASSES)}], greatest({', '.join(_CLASSES)})) - 1 AS INTEGER) AS best FROM class_scores",
)
def row_argmax(spark, sf):
    return X.class_scores(spark, sf).select("id", numeric.argmax(_CLASSES).alias("best"))


def _horner(coefficients, x):
    text = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def erfinv_sql(x: str) -> str:
    """The SQL twin of the inverse error function."""
    p = f"(({x} + 1) / 2)"
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    q = f"({p} - 0.5)"

    def ratio(pair, at):
        return f"{_horner(pair[0], at)} / {_horner(pair[1], at)}"

    return f"""((CASE WHEN abs({q}) <= 0.425 THEN {q} * {ratio(numeric.AS241_CENTRAL, f'(0.180625 - {q} * {q})')}
      ELSE sign({q}) * CASE WHEN {tail} <= 5 THEN {ratio(numeric.AS241_NEAR, f'({tail} - 1.6)')}
      ELSE {ratio(numeric.AS241_FAR, f'({tail} - 5)')} END END) / sqrt(2.0::DOUBLE))"""


@query(
    "f20_erfinv",
    f"SELECT id, round({erfinv_sql('x')}, 6) AS y FROM (SELECT o_orderkey AS id, (o_totalprice - 250000) / 250001 AS x FROM orders)",
)
def erfinv(spark, sf):
    x = (F.col("o_totalprice") - 250000) / 250001
    return X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(numeric.erfinv(x), 6).alias("y"))
