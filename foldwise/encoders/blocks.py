"""Whole feature blocks of the travel-choice tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldwise.encoders.categorical import label_encode
from foldwise.encoders.projection import TfidfNgrams, TruncatedSvd
from foldwise.functions.calendar import date_parts, hour_bucket, seconds_between, weekday_flag
from foldwise.functions.geo import geodesic_m, haversine_m, split_pair
from foldwise.functions.plans_json import element_at_value, list_sum, list_text, numeric_plans, parse_plans, std_of
from foldwise.operators.aggregates import extreme, grouped_median
from foldwise.operators.clean import equal_flags, fill_by_class, with_sentinel_row
from foldwise.operators.joins import join_sessions, role_join
from foldwise.operators.skew import HEAVY_ROWS, OrderedGroups, lookup
from foldwise.operators.windows import history_share, most_frequent, with_time_since
from foldwise.session import settle

N_MODES = 12
# fixed values: profile columns kept beside the components
RAW_PROFILE = ("p13", "p29", "p33", "p9", "p6", "p5", "p0")


def plan_features(df: DataFrame, plans: str, n_modes: int = N_MODES, ties: str = "edge") -> DataFrame:
    """Everything about the list of plans in a row, computed inside the row: nothing is shuffled.

    An empty, missing or malformed list gives -1 for numbers and modes, first
    mode 0, flag 0, and the text ``word_null``.
    """
    fields = {"distance": "dist", "price": "price", "eta": "eta"}
    empty, modes = F.col("_n") == 0, F.col("_mode")

    def filled(value, missing):
        return F.when(empty, F.lit(missing)).otherwise(value)

    # Each step is a projection that later ones read more than once, so they are
    # not merged: nothing is computed twice per row, and the generated methods
    # stay below the size the JVM compiles.
    rows = df.withColumn("_p", numeric_plans(parse_plans(F.col(plans))))
    # a field of an array of structs is the array of the field
    rows = rows.withColumns({f"_{f}": F.col("_p")[f] for f in (*fields, "mode")}).withColumn("_n", F.size("_p"))
    flags = {f"cat_mode_feas_{i}": F.array_contains(modes, i).cast("int") for i in range(n_modes)}
    flags["cat_mode_feas_0"] = filled(flags["cat_mode_feas_0"], 1)
    rows = rows.withColumns({f"_sum_{f}": list_sum(F.col(f"_{f}")) for f in fields} | flags)
    ends = {f"_hi_{f}": F.array_max(f"_{f}") for f in fields} | {f"_lo_{f}": F.array_min(f"_{f}") for f in fields}
    squares = {f"_sq_{f}": list_sum(F.col(f"_{f}"), squared=True) for f in fields}
    text = {"mode_text": list_text(modes), "cat_first_mode": filled(F.get(modes, F.lit(0)), 0)}
    rows = rows.withColumns(ends | squares | text)
    out = {}
    for f, name in fields.items():
        hi, lo, total = F.col(f"_hi_{f}"), F.col(f"_lo_{f}"), F.col(f"_sum_{f}")
        out[f"num_max_{name}"] = filled(hi.cast("double"), -1.0)
        out[f"num_min_{name}"] = filled(lo.cast("double"), -1.0)
        out[f"num_mean_{name}"] = filled(total / F.col("_n"), -1.0)
        out[f"num_std_{name}"] = filled(std_of(total, F.col(f"_sq_{f}"), F.col("_n")), -1.0)
        out[f"num_max_{name}_mode"] = filled(element_at_value(F.col(f"_{f}"), hi, modes, last=ties != "first"), -1)
        out[f"num_min_{name}_mode"] = filled(element_at_value(F.col(f"_{f}"), lo, modes), -1)
    steps = [f"{p}_{f}" for p in ("", "_sum", "_hi", "_lo", "_sq") for f in fields]
    return rows.withColumns(out).drop("_p", "_n", "_mode", *steps)


def plan_text_components(features: DataFrame, k: int = 10, prefix: str = "svd_plan_mode_") -> DataFrame:
    """Components of the TF-IDF of mode words and word pairs."""
    # each read by several passes of a fit and by the result: computed once
    features = settle(features)
    weights = settle(TfidfNgrams("mode_text", (1, 2)).fit(features).transform(features, "_tfidf"))
    return TruncatedSvd("_tfidf", k, prefix).fit(weights).transform(weights).drop("_tfidf")


def repaired_plans(items: DataFrame, plan_time: str, minutes: int = 30) -> DataFrame:
    """Prices and distances repaired by the median unit price of the mode and time slot.

    Expects one row per plan with distance, price (null if empty), eta, mode.
    Price is 0 for the modes that never cost; a short taxi ride gets the median
    unit price and the distance that follows from it; a missing price gets the
    median unit price times the distance.
    """
    # fixed values: modes without a price, the taxi mode, and the shortest believable taxi distance
    free_modes, taxi, short = (3, 5, 6), 4, 100
    rows = fill_by_class(items, "price", "mode", free_modes, 0)
    slot = F.floor((F.hour(plan_time) * 60 + F.minute(plan_time)) / F.lit(minutes)).cast("int")
    unit = F.col("price") * 100 / F.nullif(F.col("distance"), F.lit(0))
    # read by the cut points, the medians and the join: computed once
    rows = settle(rows.withColumn("slot", slot).withColumn("unit_price", unit))
    rows = lookup(rows, grouped_median(rows, ["mode", "slot"], "unit_price", "slot_median"), ["mode", "slot"])
    lost = F.col("price").isNull()
    near = (F.col("mode") == taxi) & (F.col("distance") < short)
    median = F.col("slot_median")
    rows = rows.withColumn("unit_price1", F.when(lost | near, median).otherwise(F.col("unit_price")))
    back = F.col("price") * 100 / F.nullif(median, F.lit(0.0))
    rows = rows.withColumn("distance1", F.when(near, back).otherwise(F.col("distance").cast("double")))
    filled = F.when(lost, F.col("unit_price1") * F.col("distance1") / 100).otherwise(F.col("price").cast("double"))
    return rows.withColumn("price_missing", lost.cast("int")).withColumn("price1", filled)


def time_features(df: DataFrame, req: str, plan: str, as_is: bool = True) -> DataFrame:
    parts = date_parts(F.col(req))
    return df.withColumns(
        {
            "num_time_diff": seconds_between(F.col(plan), F.col(req)),
            "cat_weekday": parts["weekday"],
            "cat_is_weekday": weekday_flag(F.col(req), as_is),
            "cat_month": parts["month"],
            "cat_dayofyear": parts["dayofyear"],
            "cat_timeofday": hour_bucket(parts["hour"]),
            "cat_hour": parts["hour"],
        }
    )


def history_features(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    mode: str,
    n_modes: int = N_MODES,
    missing_key=-1,
    min_rows: int = HEAVY_ROWS,
    pieces: int | None = None,
) -> DataFrame:
    """Earlier choices of the same user: last choice and time, shares per class, favourite.

    Rows without a user share the key ``missing_key``; they may be a third of
    the table, and are cut into segments like any heavy key.
    """
    rows = df.withColumn(key, F.coalesce(F.col(key), F.lit(missing_key)))
    groups = OrderedGroups(rows, [key], [ts, tie], min_rows, pieces)
    groups.lag({"cat_last_click_mode": mode, "last_time": ts})
    done = history_share(groups.df, [key], [ts, tie], mode, n_modes, prefix="cat_mode_num_", groups=groups).result()
    done = with_time_since(done, ts)
    names = {"since_last": "num_how_long_till_this_time", "last_weekday": "cat_last_request_weekday", "last_hour": "cat_last_request_hour"}
    return done.withColumnsRenamed(names).withColumns(
        {
            "cat_last_click_mode": F.coalesce("cat_last_click_mode", F.lit(0)),
            "cat_pid_max_mode": most_frequent("cat_mode_num_", n_modes),
        }
    )


def od_features(
    df: DataFrame,
    dim: DataFrame,
    dim_key: str = "lntlat",
    origin: str = "o",
    destination: str = "d",
    how: str = "inner",
    ellipsoid: bool = True,
    key: str = "sid",
) -> DataFrame:
    """Coordinates, address attributes of both ends, equality flags, distance, district codes."""
    o1, o2 = split_pair(F.col(origin))
    d1, d2 = split_pair(F.col(destination))
    rows = df.withColumns({"num_o1": o1, "num_o2": o2, "num_d1": d1, "num_d2": d2})
    rows = role_join(rows, dim, dim_key, {"cat_source_": origin, "cat_des_": destination}, how)
    fields = [c for c in dim.columns if c != dim_key]
    pairs = {f"cat_same_{c}": (f"cat_source_{c}", f"cat_des_{c}") for c in fields if c != "street"}
    rows = equal_flags(rows, {**pairs, "cat_same_address": (origin, destination)})
    metres = geodesic_m if ellipsoid else haversine_m
    ends = [F.col(c) for c in ("num_o2", "num_o1", "num_d2", "num_d1")]
    rows = rows.withColumn("num_direct_distance", metres(*ends))
    if "district" in fields:
        both = ["cat_source_district", "cat_des_district"]
        codes = label_encode(both, suffix="_code", key=key).fit(rows).transform(rows)
        rows = codes.drop(*both).withColumnsRenamed({f"{c}_code": c for c in both})
    return rows.drop(*[f"cat_{s}_{c}" for s in ("source", "des") for c in ("street", "street_number")])


def profile_features(
    df: DataFrame,
    profiles: DataFrame,
    key: str = "pid",
    k: int = 10,
    raw_cols: Sequence[str] = RAW_PROFILE,
    prefix: str = "svd_profile_fea_",
) -> DataFrame:
    """Components of the profile columns and a few raw ones; a row without a user meets the all-zero profile -1."""
    with_zero = with_sentinel_row(profiles, key, -1)
    cols = [c for c in profiles.columns if c != key]
    scored = TruncatedSvd(cols, k, prefix).fit(with_zero).transform(with_zero)
    block = scored.select(key, *[f"{prefix}{i}" for i in range(k)], *[F.col(c).alias(f"cat_{c}") for c in raw_cols])
    filled = df.withColumn(key, F.coalesce(F.col(key), F.lit(-1)))
    return lookup(filled, block, [key])


def session_features(
    queries: DataFrame,
    plans: DataFrame,
    clicks: DataFrame,
    profiles: DataFrame,
    addresses: DataFrame,
    dim_key: str = "lntlat",
    components: int = 10,
    raw_cols: Sequence[str] = RAW_PROFILE,
    ellipsoid: bool = True,
) -> DataFrame:
    """The whole feature table of sessions: history, ends, profile, plans, time; one row per session.

    Blocks are joined by the session id. A session without a click has label 0;
    ends without an address keep their session with null attributes.
    """
    # counted, cut and read by the history: joined once
    rows = settle(join_sessions(queries, clicks, plans, "sid", "left"))
    rows = settle(history_features(rows, "pid", "req_time", "sid", "click_mode"))
    rows = od_features(rows, addresses, dim_key, how="left", ellipsoid=ellipsoid)
    rows = profile_features(rows, profiles, "pid", components, raw_cols)
    rows = time_features(plan_features(rows, "plans"), "req_time", "plan_time")
    # the lists are described, so they are not written again
    text = settle(rows.drop("plans").filter("sid is not null"))
    scored = plan_text_components(text, components)
    found = [c for c in scored.columns if c not in text.columns]
    # sessions that come more than once meet the components of each other; all others stay where they are
    repeated = settle(text.groupBy("sid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("sid"))
    if repeated.isEmpty():
        done = scored
    else:
        many = scored.join(repeated, "sid", "left_semi")
        met = many.drop(*found).join(many.select("sid", *found), "sid")
        done = scored.join(repeated, "sid", "left_anti").unionByName(met)
    done = done.drop("mode_text", "req_time", "plan_time", "last_time", "o", "d")
    return done.select("sid", *[c for c in done.columns if c != "sid"])


def session_plan_features(items: DataFrame, keys: Sequence[str], position: Sequence[str], ties: str = "first") -> DataFrame:
    """The plan block from one row per plan: partial aggregates only, so a heavy session is no problem."""
    place = [F.col(p) for p in position]
    forms = {"max": F.max, "min": F.min, "mean": F.avg, "std": F.stddev_pop}
    aggs = [F.min_by("mode", F.struct(*position)).alias("first_mode")]
    for c, n in (("distance1", "dist"), ("price1", "price"), ("eta", "eta")):
        aggs += [f(c).alias(f"{w}_{n}") for w, f in forms.items()]
        for w, largest in (("max", True), ("min", False)):
            aggs.append(extreme(F.col(c), place, F.col("mode"), largest, ties).alias(f"{w}_{n}_mode"))
    return items.groupBy(*keys).agg(*aggs)


__all__ = [
    "history_features",
    "od_features",
    "plan_features",
    "plan_text_components",
    "profile_features",
    "repaired_plans",
    "session_features",
    "session_plan_features",
    "time_features",
]
