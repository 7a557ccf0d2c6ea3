"""More registered queries: exact sums, replicate arrays, as-of and range joins, sketches.

They are registered beside those of ``queries``, whose helpers they use.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanmill.functions import exact, numeric, text
from spanmill.functions.numeric import per_90, safe_ratio
from spanmill.operators import documents, drift, features, frozen, joins, metric, resampling, retrieval, sketches, splits, temporal
from spanmill.plans import decisions, experiments, provider, replicates, showcase, stand_in, uncertainty
from spanmill.plans.stand_in import table
from spanmill.queries import (
    _A_ORDER, _COS, _ELIGIBLE, _FLAGGED, _FLAGGED_2, _FLAGS, _FLAGS_2, _HALVES, _METRICS, _PERIODS, MINIMUM_VALID, QUERIES, RESAMPLES, _feature_sql, _metrics, _population, _ranks,
    _rounded, _rounded_features, _scaled, _statistics_sql, exact_sum_sql, query, whole_sum_sql,
)
from spanmill.sources import layout, readers
from spanmill.sources.scratch import shared_folder, written
from spanmill.streaming import running

# ---- exactly rounded sums ------------------------------------------------------------

_MEASURES = {
    "price": (lambda: F.col("l_extendedprice"), "l_extendedprice"),
    "revenue": (lambda: F.col("l_extendedprice") * (1 - F.col("l_discount")), "l_extendedprice * (1 - l_discount)"),
    "signed": (lambda: F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")) * F.col("l_tax"), "(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END) * l_tax"),
}
_EXACT_SQL = "WITH s AS (SELECT l_returnflag, l_linestatus, " + ", ".join(f"{whole_sum_sql(x)} AS {n}" for n, (_, x) in _MEASURES.items()) + " FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, " + ", ".join(f"{exact_sum_sql(n)} AS {n}" for n in _MEASURES) + " FROM s"


@query(_EXACT_SQL)
def exact_sums(spark, sf_dir):
    """Sums of doubles rounded once, equal on any partitioning."""
    return exact.exact_sums(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {n: c() for n, (c, _) in _MEASURES.items()})


@query(f"WITH s AS (SELECT l_suppkey, {whole_sum_sql(_MEASURES['revenue'][1])} AS t FROM lineitem GROUP BY ALL) SELECT l_suppkey, {exact_sum_sql('t')} AS revenue FROM s")
def merged_exact_sums(spark, sf_dir):
    """Partial sums of each ship month, made apart, merged to sums by supplier."""
    line = table(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    monthly = exact.partial_sums(line, ["l_suppkey", "month"], _MEASURES["revenue"][0]())
    return exact.merge_sums(monthly, ["l_suppkey"], "revenue")


# ---- replicates as arrays ----------------------------------------------------------------

_ADDITIVE = ["n", "q", "r", "decided", "o", "dc", "xc"]
_REPLICATE_FEATURES = ["lines_p90", "returned_p90", "return_ratio", "open_share", "mean_discount", "extra_discount_p90"]


def match_sums(spark, sf_dir):
    """Whole-number statistics of a supplier's lines in an order; discounts in cents."""
    cents = F.round(F.col("l_discount") * 100)
    flag = lambda x: F.sum(x.cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player_id"), F.col("l_orderkey").alias("match_id")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("q"), flag(F.col("l_returnflag") == "R").alias("r"), flag(F.col("l_returnflag").isin("R", "A")).alias("decided"),
        flag(F.col("l_linestatus") == "O").alias("o"), F.sum(cents).alias("dc"), F.sum(F.greatest(cents - 5, F.lit(0.0))).alias("xc"),
    )


def replicate_arrays(spark, sf_dir, sums, n: int, additive: list[str]):
    lists = replicates.draw_lists(stand_in.periods(spark, sf_dir), "match_id", ["competitionId", "period"], n, 1729, "matches", held=False)
    return replicates.replicate_sums(sums, lists, "match_id", ["player_id", "period"], additive, n)


def replicate_features(arrays):
    """The six features of every replicate, as arrays beside ``drawn``."""
    parts = F.arrays_zip(*_ADDITIVE)
    rate = {
        "lines_p90": lambda x: per_90(x["n"], x["q"]), "returned_p90": lambda x: per_90(x["r"], x["q"]), "return_ratio": lambda x: safe_ratio(x["r"], x["decided"]),
        "open_share": lambda x: safe_ratio(x["o"], x["n"]), "mean_discount": lambda x: safe_ratio(x["dc"], x["n"]), "extra_discount_p90": lambda x: per_90(x["xc"], x["q"]),
    }
    return arrays.select("player_id", "period", "drawn", *(F.transform(parts, rate[f]).alias(f) for f in _REPLICATE_FEATURES))


_CHOSEN = f"""SELECT player_id, neighbor FROM (SELECT q.player_id, c.player_id AS neighbor, row_number() OVER (PARTITION BY q.player_id ORDER BY {_COS} DESC, c.player_id) AS rank
  FROM z q JOIN z c ON q.period = 'A' AND c.period = 'B' AND q.role = c.role AND q.player_id <> c.player_id) WHERE rank <= 5"""


def _selection_sql(n: int, minimum: int) -> str:
    fs = _REPLICATE_FEATURES
    stats = ", ".join(f"avg({f}) AS {f}_m, CASE WHEN min({f}) < max({f}) THEN sqrt(var_samp({f}) * (count({f}) - 1) / (count(*) - 1)) END AS {f}_s" for f in fs)
    z = ", ".join(f"CASE WHEN {f}_s > 0 THEN round((coalesce({f}, {f}_m) - {f}_m) / {f}_s, 6) ELSE 0 END" for f in fs)
    return f"""WITH {_ELIGIBLE}, {_scaled()}, chosen AS ({_CHOSEN}),
u AS (SELECT match_id, "competitionId", period, row_number() OVER (PARTITION BY "competitionId", period ORDER BY match_id) - 1 AS i, count(*) OVER (PARTITION BY "competitionId", period) AS n FROM periods),
d AS (SELECT r::INT AS replicate, "competitionId", period, ('0x' || substr(sha256('matches|1729|' || r || '|' || "competitionId" || '|' || period || '|' || i || '|0'), 1, 16))::UBIGINT % n AS i FROM u, range({n}) t(r)),
plan AS (SELECT replicate, match_id, period, count(*) AS w FROM d JOIN u USING ("competitionId", period, i) GROUP BY ALL),
s AS (SELECT l_suppkey AS player_id, l_orderkey AS match_id, count(*) AS n, sum(l_quantity) AS q, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag IN ('R', 'A')) AS decided,
  count(*) FILTER (l_linestatus = 'O') AS o, sum(round(l_discount * 100)) AS dc, sum(greatest(round(l_discount * 100) - 5, 0)) AS xc FROM lineitem WHERE l_suppkey IN (SELECT player_id FROM eligible) GROUP BY ALL),
p AS (SELECT replicate, player_id, period, sum(n * w) AS n, sum(q * w) AS q, sum(r * w) AS r, sum(decided * w) AS decided, sum(o * w) AS o, sum(dc * w) AS dc, sum(xc * w) AS xc FROM s JOIN plan USING (match_id) GROUP BY ALL),
f AS (SELECT replicate, player_id, period, n / q * 90 AS lines_p90, r / q * 90 AS returned_p90, CASE WHEN decided > 0 THEN r / decided END AS return_ratio, o / n AS open_share, dc / n AS mean_discount, xc / q * 90 AS extra_discount_p90 FROM p),
st AS (SELECT replicate, {stats} FROM f GROUP BY replicate),
rz AS (SELECT f.replicate, f.player_id, f.period, e.role, [{z}] AS v FROM f JOIN st USING (replicate) JOIN (SELECT DISTINCT player_id, role FROM eligible) e USING (player_id)),
sc AS (SELECT q.replicate, q.player_id, c.player_id AS other, row_number() OVER (PARTITION BY q.replicate, q.player_id ORDER BY {_COS} DESC, c.player_id) AS rank
  FROM rz q JOIN rz c ON q.replicate = c.replicate AND q.role = c.role AND q.period = 'A' AND c.period = 'B' AND q.player_id <> c.player_id)
SELECT sc.player_id, other AS neighbor, count(*) AS n_valid, CASE WHEN count(*) >= {minimum} THEN round(avg((rank <= 5)::INT), 6) END AS top_5_selection_rate,
  CASE WHEN count(*) >= {minimum} THEN median(rank) END AS median_rank, CASE WHEN count(*) >= {minimum} THEN 'available' ELSE 'insufficient' END AS status
FROM sc JOIN chosen ON chosen.player_id = sc.player_id AND neighbor = other GROUP BY ALL"""


def _scaled_arrays(spark, sf_dir, n):
    people = stand_in.eligible(spark, sf_dir).select("player_id", "role").distinct()
    sums = match_sums(spark, sf_dir).join(people.select("player_id"), "player_id", "left_semi")
    arrays = written(replicate_features(replicate_arrays(spark, sf_dir, sums, n, _ADDITIVE)))
    scaled = written(replicates.standardize(arrays, _REPLICATE_FEATURES).join(people, "player_id"))
    return scaled.where("period = 'A'"), scaled.where("period = 'B'")


def _neighbor_ranks(spark, sf_dir, n):
    a, b = _scaled_arrays(spark, sf_dir, n)
    population = _population(spark, sf_dir)
    near = uncertainty.observed_neighbors(population.queries, population.candidates, ["player_id"], "player_id", "role", k=5, at_least=1)
    return replicates.neighbor_ranks(a, b, near.select("player_id", F.col("neighbor_player_id").alias("neighbor")), "player_id", "player_id", "role", _REPLICATE_FEATURES, n)


@query(_selection_sql(RESAMPLES, MINIMUM_VALID))
def neighbor_selection(spark, sf_dir):
    """The share of 500 replicates in which each of a profile's 5 observed neighbours stays among
    its 5 nearest."""
    out = replicates.selection_rates(_neighbor_ranks(spark, sf_dir, RESAMPLES), ["player_id", "neighbor"], MINIMUM_VALID)
    return _rounded(out, "top_5_selection_rate", digits=6)


def _self_ranks_sql() -> str:
    head = _selection_sql(RESAMPLES, MINIMUM_VALID)
    head = head[: head.index("SELECT sc.player_id, other AS neighbor")].replace(" AND q.player_id <> c.player_id)\n", ")\n")
    enough = f"CASE WHEN count(*) >= {MINIMUM_VALID} THEN {{}} END"
    rates = ", ".join(enough.format(f"round(avg((rank <= {k})::INT), 6)") + f" AS rate_at_{k}" for k in (1, 5, 10))
    return head + f"""SELECT player_id, count(*) AS n_valid, {enough.format("median(rank)")} AS median_rank, {enough.format("quantile_cont(rank, 0.025)")} AS rank_low, {enough.format("quantile_cont(rank, 0.975)")} AS rank_high,
  {rates}, {enough.format("'available'").replace(" END", " ELSE 'insufficient' END")} AS status FROM sc WHERE player_id = other GROUP BY player_id"""


@query(_self_ranks_sql())
def replicate_self_ranks(spark, sf_dir):
    """Each profile's own rank within its role over 500 replicates: interval, median and rates."""
    a, b = _scaled_arrays(spark, sf_dir, RESAMPLES)
    own = a.select("player_id", F.col("player_id").alias("neighbor"))
    ranks = replicates.neighbor_ranks(a, b, own, "player_id", None, "role", _REPLICATE_FEATURES, RESAMPLES)
    out = resampling.summarize_ranks(ranks.select("player_id", F.explode("ranks").alias("rank")), ["player_id"], MINIMUM_VALID)
    return _rounded(out, "rate_at_1", "rate_at_5", "rate_at_10", digits=6)


# ---- regularisation arms trained together -----------------------------------------------------

#: Strengths of the pull to equal weights, the reference's grid.
ARMS = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]


def _entities(spark, sf_dir):
    """Stored vectors in pairs: (entity, half, role, v)."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 2).cast("long").alias("entity"), (F.col("vec_id") % 2).alias("half"), F.col("label").alias("role"), F.col("embedding").cast("array<double>").alias("v"))


def trained_arms(a, b, assignment, **settings):
    """Fits of all arms on the training split, and each arm's metrics on the validation split."""
    part = lambda rows, name: rows.join(assignment.where(F.col("split") == name).select("entity"), "entity", "left_semi")
    first = a.select(F.size("v").alias("n")).first()
    triples = metric.training_triples(part(a, "train"), part(b, "train"), "entity", "role")
    fits = metric.train_arms(triples, first.n if first else 0, ARMS, **({"temperature": 0.05} | settings))
    ranks = metric.arm_ranks(part(a, "validation"), part(b, "validation"), fits, "entity", "role")
    return fits, retrieval.metrics(ranks, ["regularization"])


@query()
def arm_selection(spark, sf_dir):
    """Six arms trained in one run of 300 steps: validation metrics, which one is selected (best mrr,
    ties to the stronger pull) and the features that its weights leave out or move most."""
    v = _entities(spark, sf_dir)
    assignment = splits.assign_splits(v.where("half = 0").select("entity", F.col("role").cast("string").alias("role")), "entity")
    fits, report = trained_arms(v.where("half = 0").drop("half"), v.where("half = 1").drop("half"), written(assignment))
    weights = spark.createDataFrame([(float(s), i, float(w)) for s, f in fits.items() for i, w in enumerate(f.weights)], "regularization double, feature int, weight double")
    report = written(report)
    chosen = decisions.select_arm(report).select("regularization", F.lit(True).alias("selected"))
    spread = weights.groupBy("regularization").agg(F.count_if(F.col("weight") < 0.05).alias("n_collapsed"), F.max_by("feature", "weight").alias("heaviest"), F.max("weight").alias("max_weight"))
    return report.join(F.broadcast(chosen), "regularization", "left").join(spread, "regularization").withColumn("selected", F.coalesce("selected", F.lit(False)))


# ---- as-of, overlap and full outer joins --------------------------------------------------------

_ASKED = "o AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate AS ts FROM orders)"
_SEEN = "e AS (SELECT user_id, ts, max((value, event_id)) AS m FROM events GROUP BY ALL)"


@query(f"""WITH {_ASKED}, {_SEEN} SELECT o.o_orderkey, o.user_id, o.ts, e.ts AS seen_ts, struct_extract_at(m, 1) AS seen_value, struct_extract_at(m, 2) AS seen_event_id
FROM o ASOF LEFT JOIN e ON o.user_id = e.user_id AND o.ts >= e.ts""")
def last_event_before_order(spark, sf_dir):
    """The last event of a customer up to each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value", "event_id")
    return joins.asof_join(orders, events, "ts", ["user_id"], prefix="seen_")


@query("""WITH s AS (SELECT l_suppkey, l_shipdate, max((l_extendedprice, l_orderkey)) AS m FROM lineitem GROUP BY ALL)
SELECT l.l_suppkey, l.o_orderkey, l.l_shipdate, s.l_shipdate AS before_l_shipdate, struct_extract_at(m, 1) AS before_l_extendedprice, struct_extract_at(m, 2) AS before_l_orderkey
FROM (SELECT l_suppkey, l_orderkey AS o_orderkey, l_shipdate FROM lineitem WHERE l_linenumber = 1) l ASOF LEFT JOIN s ON l.l_suppkey = s.l_suppkey AND l.l_shipdate > s.l_shipdate""")
def shipment_before(spark, sf_dir):
    """A supplier's last shipment on an earlier day, for each order's first line."""
    line = table(spark, sf_dir, "lineitem")
    first = line.where("l_linenumber = 1").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return joins.asof_join(first, line.select("l_suppkey", "l_shipdate", "l_extendedprice", "l_orderkey"), "l_shipdate", ["l_suppkey"], prefix="before_", strict=True)


_OPEN = "w AS (SELECT o_custkey, o_orderkey, min(o_orderdate) AS opened, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"WITH {_OPEN} SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_o_orderkey, date_diff('microsecond', greatest(a.opened, b.opened), least(a.shipped, b.shipped)) AS shared FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.opened <= b.shipped AND b.opened <= a.shipped AND a.o_orderkey < b.o_orderkey AND a.opened <= a.shipped AND b.opened <= b.shipped")
def orders_open_together(spark, sf_dir):
    """Pairs of a customer's orders that were open at the same time, and for how long."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = joined.groupBy("o_custkey", "o_orderkey").agg(F.min("o_orderdate").alias("opened"), F.max("l_shipdate").alias("shipped"))
    pairs = joins.overlap_join(spans, spans, "opened", "shipped", ["o_custkey"], prefix="other_").where("o_orderkey < other_o_orderkey")
    at = lambda c: numeric.micros(c, dict(spans.dtypes)["opened"])
    shared = at(F.least("shipped", "other_shipped")) - at(F.greatest("opened", "other_opened"))
    return pairs.select("o_custkey", "o_orderkey", "other_o_orderkey", shared.alias("shared"))


_SUPPLIED = """SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem JOIN periods ON match_id = l_orderkey WHERE period = '{0}' AND l_partkey % 40 = {1} GROUP BY 1"""


@query(f"""WITH {_PERIODS}, a AS ({_SUPPLIED.format('A', 3)}), b AS ({_SUPPLIED.format('B', 5)})
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.q AS left_value, b.q AS right_value, CASE WHEN b.l_suppkey IS NULL THEN 'left' WHEN a.l_suppkey IS NULL THEN 'right' ELSE 'both' END AS status
FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""")
def supplied_in_either_half(spark, sf_dir):
    """Quantities of one group of parts in the first half and of another in the second, where either is."""
    line = table(spark, sf_dir, "lineitem").join(stand_in.periods(spark, sf_dir), F.col("l_orderkey") == F.col("match_id"))
    part = lambda p, m: line.where((F.col("period") == p) & (F.col("l_partkey") % 40 == m)).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return joins.matched(part("A", 3), part("B", 5), ["l_suppkey"], "q")


# ---- sketches ------------------------------------------------------------------------------------

@query(f"""WITH {_PERIODS}, l AS (SELECT "competitionId" AS competitionId, l_partkey, l_extendedprice, p_brand AS brand FROM lineitem JOIN periods ON match_id = l_orderkey JOIN part ON p_partkey = l_partkey)
SELECT competitionId, count(*) AS n, count(DISTINCT l_partkey) AS n_parts, TRUE AS merged_is_near, TRUE AS direct_is_near, TRUE AS quantiles_are_near, max(b.brands) AS n_brands, TRUE AS brands_are_near
FROM l JOIN (SELECT competitionId, count(*) AS brands FROM (SELECT DISTINCT competitionId, brand FROM l) GROUP BY 1) b USING (competitionId) GROUP BY competitionId""")
def merged_sketches(spark, sf_dir):
    """Sketches of each period of a competition, merged: exact figures beside whether the merged and
    the direct sketches lie within their bounds (five standard errors)."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    rows = table(spark, sf_dir, "lineitem").join(stand_in.periods(spark, sf_dir), F.col("l_orderkey") == F.col("match_id")).join(part, F.col("p_partkey") == F.col("l_partkey")).select("competitionId", "period", "l_partkey", "l_extendedprice", "brand")
    merged = sketches.union(sketches.sketches(rows, ["competitionId", "period"], "l_partkey", "l_extendedprice", "brand"), ["competitionId"])
    direct = sketches.sketches(rows, ["competitionId"], "l_partkey", "l_extendedprice", "brand")
    exact_figures = rows.groupBy("competitionId").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("brand").alias("n_brands"), F.percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    brands = rows.groupBy("competitionId", "brand").agg(F.count("*").alias("c")).groupBy("competitionId").agg(F.map_from_entries(F.collect_list(F.struct("brand", "c"))).alias("c"))
    near = lambda x: F.abs(x - F.col("n_parts")) <= 5 * 1.04 / 2 ** (sketches.LG_BUCKETS / 2) * F.col("n_parts")
    two = direct.select("competitionId", sketches.n_distinct("distinct_sketch").alias("d1"), sketches.n_in_set("set_sketch").alias("d2"))
    out = merged.join(two, "competitionId").join(exact_figures, "competitionId").join(brands, "competitionId")
    ranks = F.lit(True)
    for i, q in enumerate((0.1, 0.5, 0.9)):
        ranks = ranks & sketches.within_quantiles("value_sketch", q, F.get("q", i), 0.02)
    top = sketches.frequent("item_sketch", 5)
    counted = F.forall(top, lambda t: F.abs(t["count"] - F.element_at("c", t["item"])) <= F.col("n") / sketches.TRACKED)
    return out.select(
        "competitionId", "n", "n_parts", (near(sketches.n_distinct("distinct_sketch")) & near(sketches.n_in_set("set_sketch"))).alias("merged_is_near"), (near(F.col("d1")) & near(F.col("d2"))).alias("direct_is_near"),
        ranks.alias("quantiles_are_near"), "n_brands", counted.alias("brands_are_near"),
    )


# ---- streams ------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, round(value * 100)::BIGINT AS cents, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)
SELECT user_id, count(*) AS n, sum(cents)::BIGINT AS total_cents, max(t) AS last_micros, count(*) FILTER (pause IS NULL OR pause > 1800000000) AS n_sessions,
  coalesce(sum(pause) FILTER (pause <= 1800000000), 0)::BIGINT AS active_micros, 0::BIGINT AS n_late FROM e GROUP BY user_id""")
def streamed_user_totals(spark, sf_dir):
    """Running figures of users from a stream over the event table's files; the last state of each user."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    kinds = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, so that it may be a file
    running.keep(running.running_totals(source), f"{base}/out", f"{base}/checkpoint")
    return running.latest(spark.read.parquet(f"{base}/out"), "user_id")


# ---- retrieval on the providers' features; replication and frozen weights ------------------------

#: Of the 30 features that both providers have, those whose construction differs between them.
SHIFTED = ["carry_proxy_p90", "carry_distance_proxy_p90"]
SHARED_30 = list(features.FEATURES_2)
SHARED_28 = [f for f in SHARED_30 if f not in SHIFTED]


def _provider_profiles_sql(flagged: str, flags: dict, known: dict) -> str:
    return f"""{_HALVES}, {flagged}, st AS (SELECT player_id, period, {_statistics_sql(flags)} FROM fl JOIN periods USING (match_id) GROUP BY ALL),
mp AS (SELECT player_id, period, sum(minutes_played)::BIGINT AS minutes_played FROM pm JOIN periods USING (match_id) GROUP BY ALL), s AS (SELECT mp.*, st.* EXCLUDE (player_id, period) FROM mp LEFT JOIN st USING (player_id, period)),
profiles AS ({_feature_sql(known, 's', 'player_id, period')}), enough AS (SELECT * FROM profiles WHERE minutes_played >= 100),
eligible AS (SELECT e.*, (s_nationkey % 4)::BIGINT AS role, s_nationkey::BIGINT AS team FROM enough e LEFT JOIN supplier ON s_suppkey = player_id WHERE player_id IN (SELECT player_id FROM enough GROUP BY 1 HAVING count(DISTINCT period) = 2))"""


_ONE = _provider_profiles_sql(_FLAGGED, _FLAGS, features.FEATURES)
_TWO = _provider_profiles_sql(_FLAGGED_2, _FLAGS_2, features.FEATURES_2)


def _second_profiles(spark, sf_dir):
    lines = provider.lines(spark, sf_dir, stand_in.periods(spark, sf_dir))
    return _rounded_features(provider.period_features(features.with_flags_2(provider.events_2(spark, sf_dir, lines)), features.FEATURES_2), features.FEATURES_2)


@query(f"WITH {_TWO} SELECT * FROM profiles")
def provider_period_profiles_2(spark, sf_dir):
    """The 30 features of the second provider's players in both halves."""
    return _second_profiles(spark, sf_dir)


def _placed(spark, sf_dir, profiles):
    """Profiles with enough minutes in both halves, with role and team."""
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), (F.col("s_nationkey") % 4).cast("long").alias("role"), F.col("s_nationkey").cast("long").alias("team"))
    return temporal.eligible_in_both(written(profiles), ["player_id"], 100.0).join(people, "player_id", "left")


@query(f"WITH {_ONE}, {_scaled(features=list(features.FEATURES))}, {_ranks(_COS + ' DESC')} SELECT {_METRICS} FROM ranks")
def provider_retrieval(spark, sf_dir):
    """Self-retrieval on the 32 features of the first provider."""
    held = _placed(spark, sf_dir, QUERIES["provider_period_profiles"](spark, sf_dir))
    return _metrics(experiments.baseline_ranks(experiments.population(held, list(features.FEATURES), ["player_id"], ["role", "team"]), "B"))


def _replication_sql() -> str:
    parts = []
    for name, fs in (("28", SHARED_28), ("30", SHARED_30)):
        for scope, where in (("global", "TRUE"), ("role", "q.role = c.role")):
            for baseline, order in (("A", _A_ORDER), ("B", _COS + " DESC")):
                parts.append(f"SELECT * FROM (WITH {_scaled(features=fs)}, {_ranks(order, where)} SELECT '{name}' AS features, '{scope}' AS scope, '{baseline}' AS baseline, {_METRICS} FROM ranks)")
    return f"WITH {_TWO.replace('eligible AS', 'eligible AS MATERIALIZED')} " + " UNION ALL ".join(parts)


@query(_replication_sql())
def provider_replication(spark, sf_dir):
    """The experiment repeated on the second provider, with the 28 features that are alike and with
    all 30: minutes and cosine baselines, globally and within the role."""
    held = written(_placed(spark, sf_dir, _second_profiles(spark, sf_dir)))
    pools = {name: experiments.population(held, fs, ["player_id"], ["role", "team"]) for name, fs in (("28", SHARED_28), ("30", SHARED_30))}
    # ranks by minutes use no feature and are the same for both
    out = experiments.report(pools["28"], ("A",)).withColumn("features", F.explode(F.array(*(F.lit(name) for name in pools))))
    for name, p in pools.items():
        out = out.unionByName(experiments.report(p, ("B",)).withColumn("features", F.lit(name)))
    out = out.drop("chance")
    return _rounded(out, "mrr", "recall_at_5", "recall_at_10")


#: Weights by name, a fixed rule in place of a training run.
FROZEN = frozen.freeze({f: 0.25 * (1 + i * 7 % 5) for i, f in enumerate(sorted(features.FEATURES))})
_FROZEN_30 = frozen.aligned(FROZEN, SHARED_30, [f for f in features.FEATURES if f not in SHARED_30])


@query(
    f"WITH {_TWO}, {_scaled(features=SHARED_30).replace('AS v FROM', 'AS v0 FROM')}, z2 AS (SELECT * EXCLUDE v0, list_transform(list_zip(v0, {_FROZEN_30}), lambda x: x[1] * sqrt(x[2]::DOUBLE)) AS v FROM z), "
    + _ranks(_COS + " DESC", "q.role = c.role").replace("z q", "z2 q").replace("z c", "z2 c") + f" SELECT {_METRICS} FROM ranks"
)
def frozen_weights_on_second(spark, sf_dir):
    """Weights frozen over the first provider's 32 features, applied by name to the 30 of the second."""
    weights = frozen.aligned(FROZEN, SHARED_30, [f for f in features.FEATURES if f not in SHARED_30])
    held = _placed(spark, sf_dir, _second_profiles(spark, sf_dir))
    p = experiments.population(held, SHARED_30, ["player_id"], ["role", "team"], weights=weights)
    return _metrics(experiments.baseline_ranks(p, "B", "role"))


# ---- cohort grid with a drift gate -----------------------------------------------------------------


@query(f"""WITH {_ELIGIBLE}, c AS (SELECT DISTINCT player_id, role FROM eligible),
s AS (SELECT l_suppkey AS player_id, period, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN periods ON match_id = l_orderkey GROUP BY ALL)
SELECT row_number() OVER (ORDER BY player_id) - 1 AS profile_index, player_id, role, p.period, coalesce(n, 0) > 0 AS present, q AS minutes_played, round(n / q * 90, 9) AS lines_p90
FROM c CROSS JOIN (SELECT unnest(['A', 'B']) AS period) p LEFT JOIN s USING (player_id, period) ORDER BY 1""".replace("row_number() OVER (ORDER BY player_id) - 1 AS profile_index", "dense_rank() OVER (ORDER BY player_id) - 1 AS profile_index"))
def cohort_grid(spark, sf_dir):
    """Every member of the cohort in both halves, observed through resampling statistics of weight 1;
    a value that differs from the stored profile stops the query."""
    stored = stand_in.profiles(spark, sf_dir)
    cohort = stand_in.eligible(spark, sf_dir).select("player_id", "role").distinct()
    numbered, _ = resampling.number_rows(written(cohort), ["player_id"])
    grid = numbered.withColumnRenamed("_i", "profile_index").withColumn("period", F.explode(F.array(F.lit("A"), F.lit("B"))))
    per_match = match_sums(spark, sf_dir).join(stand_in.periods(spark, sf_dir), "match_id")
    observed = written(per_match.groupBy("player_id", "period").agg(F.sum("n").alias("n"), F.sum("q").alias("minutes_played")))
    observed = observed.withColumn("lines_p90", F.round(per_90(F.col("n"), F.col("minutes_played")), 9))
    held = drift.gated(observed, stored.select("player_id", "period", "minutes_played", "lines_p90"), ["player_id", "period"], ["minutes_played", "lines_p90"], 1e-9)
    out = grid.join(held.select("player_id", "period", "n", "minutes_played", "lines_p90"), ["player_id", "period"], "left")
    return out.select("profile_index", "player_id", "role", "period", (F.coalesce(F.col("n"), F.lit(0)) > 0).alias("present"), "minutes_played", "lines_p90")


# ---- clustered layout ------------------------------------------------------------------------------


@query("""SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-04-01' GROUP BY 1""")
def clustered_range_scan(spark, sf_dir):
    """A month's lines from a table that is clustered by ship date, of whose files and row groups
    all others are passed over."""
    laid = layout.clustered(table(spark, sf_dir, "lineitem"), "l_shipdate", f"{shared_folder(spark)}/laid-{uuid.uuid4().hex}")
    month = laid.where((F.col("l_shipdate") >= F.lit("1995-03-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1995-04-01").cast("timestamp_ntz")))
    return month.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


# ---- documents by path -------------------------------------------------------------------------------


def _order_documents(spark, sf_dir, version: int):
    """An order as a nested JSON document: version 2 changes every seventh customer key, adds a field to
    orders of even keys, and has one line less in every fifth order."""
    line = table(spark, sf_dir, "lineitem")
    if version == 2:
        line = line.where(~((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2)))
    entry = F.struct("l_linenumber", F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.array("l_returnflag", "l_linestatus").alias("flags")).alias("line"))
    lines = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    key = F.col("o_custkey") + F.when((F.col("o_orderkey") % 7 == 0) & F.lit(version == 2), 1).otherwise(0)
    more = F.when((F.col("o_orderkey") % 2 == 0) & F.lit(version == 2), F.struct(F.lit("v2").alias("design")))
    body = F.struct(F.col("o_orderstatus").alias("status"), F.struct(key.alias("key"), more.alias("binding")).alias("customer"), "lines")
    return orders.select(F.col("o_orderkey").alias("doc"), F.to_json(body).alias("json"))


@query("""WITH l AS (SELECT l_orderkey AS doc, l_partkey, l_suppkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
m AS (SELECT l_orderkey AS doc, l_partkey, l_suppkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber = 2)),
d AS (SELECT doc FROM orders JOIN (SELECT DISTINCT doc FROM m) x ON doc = o_orderkey),
gone AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderkey IN (SELECT doc FROM l) AND o_orderkey NOT IN (SELECT doc FROM m)),
v1 AS (SELECT doc, 'lines[' || i || '].part' AS path, 'lines[*].part' AS pattern, l_partkey::VARCHAR AS value FROM l UNION ALL SELECT doc, 'lines[' || i || '].supplier', 'lines[*].supplier', l_suppkey::VARCHAR FROM l
  UNION ALL SELECT doc, 'lines[' || i || '].flags[0]', 'lines[*].flags[*]', l_returnflag FROM l UNION ALL SELECT doc, 'lines[' || i || '].flags[1]', 'lines[*].flags[*]', l_linestatus FROM l
  UNION ALL SELECT doc, 'customer.key', 'customer.key', o_custkey::VARCHAR FROM orders JOIN (SELECT doc FROM d UNION ALL SELECT doc FROM gone) ON doc = o_orderkey
  UNION ALL SELECT doc, 'status', 'status', o_orderstatus FROM orders JOIN (SELECT doc FROM d UNION ALL SELECT doc FROM gone) ON doc = o_orderkey),
v2 AS (SELECT doc, 'lines[' || i || '].part' AS path, 'lines[*].part' AS pattern, l_partkey::VARCHAR AS value FROM m UNION ALL SELECT doc, 'lines[' || i || '].supplier', 'lines[*].supplier', l_suppkey::VARCHAR FROM m
  UNION ALL SELECT doc, 'lines[' || i || '].flags[0]', 'lines[*].flags[*]', l_returnflag FROM m UNION ALL SELECT doc, 'lines[' || i || '].flags[1]', 'lines[*].flags[*]', l_linestatus FROM m
  UNION ALL SELECT doc, 'customer.key', 'customer.key', (o_custkey + CASE WHEN doc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR FROM orders JOIN d ON doc = o_orderkey
  UNION ALL SELECT doc, 'customer.binding.design', 'customer.binding.design', 'v2' FROM d WHERE doc % 2 = 0 UNION ALL SELECT doc, 'status', 'status', o_orderstatus FROM orders JOIN d ON doc = o_orderkey),
c AS (SELECT coalesce(v1.doc, v2.doc) AS doc, coalesce(v1.pattern, v2.pattern) AS pattern, CASE WHEN v1.doc IS NULL THEN 'added' WHEN v2.doc IS NULL THEN 'removed' ELSE 'changed' END AS status
  FROM v1 FULL JOIN v2 ON v1.doc = v2.doc AND v1.path = v2.path WHERE v1.value IS DISTINCT FROM v2.value)
SELECT pattern, status, count(*) AS n_changes, count(DISTINCT doc) AS n_documents FROM c GROUP BY ALL""")
def document_changes(spark, sf_dir):
    """What changed between two versions of nested documents, counted by path."""
    one, two = (documents.walk(_order_documents(spark, sf_dir, v), ["doc"], "json") for v in (1, 2))
    return documents.change_counts(documents.differences(one, two, ["doc"]))


@query("""SELECT o_orderkey AS doc, (o_orderkey % 2 = 0)::BIGINT AS n_bindings, 0::BIGINT AS n_wrong FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE NOT (l_orderkey % 5 = 0 AND l_linenumber = 2))""")
def bindings_at_any_depth(spark, sf_dir):
    """The design binding of nested documents, found by the walk."""
    return documents.binding_faults(documents.walk(_order_documents(spark, sf_dir, 2), ["doc"], "json"), ["doc"], "design", "v2")


# ---- decisions, readers and text --------------------------------------------------------------------


@query(f"WITH {_ELIGIBLE}, {_scaled()}, {_ranks(_COS + ' DESC')} SELECT player_id, rank, pool_size FROM ranks ORDER BY rank DESC, player_id LIMIT 10")
def failure_cases(spark, sf_dir):
    """The ten queries whose own row is ranked last."""
    return decisions.failure_cases(experiments.baseline_ranks(_population(spark, sf_dir), "B"), ["player_id"])


@query(f"""WITH {_ELIGIBLE}, {_scaled()}, {_ranks(_A_ORDER, name='a')}, {_ranks(_COS + ' DESC', name='b')}
SELECT role, count(*) AS n_queries, round(avg(1.0 / a.rank), 9) AS reference_mrr, round(avg(1.0 / b.rank), 9) AS learned_mrr, round(avg(1.0 / b.rank) - avg(1.0 / a.rank), 9) AS delta, count(*) >= 50 AS gates
FROM a JOIN b USING (player_id) JOIN (SELECT DISTINCT player_id, role FROM eligible) e USING (player_id) GROUP BY role""")
def role_gates(spark, sf_dir):
    """Two rankings by role, and whether the role has queries enough to gate."""
    p = _population(spark, sf_dir)
    out = decisions.by_role(experiments.baseline_ranks(p, "A"), experiments.baseline_ranks(p, "B"), ["player_id"], p.queries.select("player_id", "role"))
    return _rounded(out, "reference_mrr", "learned_mrr", "delta")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def suppliers_from_csv(spark, sf_dir):
    """A CSV table with header, its types inferred, written from the suppliers."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, sf_dir, "supplier").write.option("header", True).csv(path)
    return readers.csv_table(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), "s_acctbal")


@query("""SELECT c_custkey AS "wyId", c_name AS "shortName", CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS "firstName", 'Role ' || c_nationkey AS role_name, c_custkey::BIGINT * 10 AS n FROM customer""")
def players_from_json(spark, sf_dir):
    """Files that hold a JSON array each, read as records: the text null is no value."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    c = F.col
    first = F.when(c("c_custkey") % 3 > 0, c("c_mktsegment")).otherwise("null")
    record = F.to_json(F.struct(c("c_custkey").alias("wyId"), c("c_name").alias("shortName"), first.alias("firstName"), F.struct(F.concat(F.lit("Role "), c("c_nationkey").cast("string")).alias("name")).alias("role")))
    arrays = table(spark, sf_dir, "customer").groupBy(F.floor(c("c_custkey") / 1000).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)  # an array of 1,000 records in each file
    return readers.records(spark, f"{path}/*", readers.PLAYER).select("wyId", "shortName", "firstName", c("role.name").alias("role_name"), (c("wyId") * 10).alias("n"))


@query("""SELECT lower(strip_accents(trim(replace(replace(p_name, 'e', 'É'), 'o', 'ö') || ' '))) AS searched, p_partkey, printf('wy-%d-c-%d', p_partkey, p_size) AS profile_key, printf('%.11e', p_retailprice / 7)::DOUBLE AS price FROM part""")
def search_texts(spark, sf_dir):
    """Texts folded for search, profile keys, and prices to twelve significant digits."""
    name = F.concat(F.replace(F.replace("p_name", F.lit("e"), F.lit("É")), F.lit("o"), F.lit("ö")), F.lit(" "))
    return table(spark, sf_dir, "part").select(text.search_text(name).alias("searched"), "p_partkey", text.profile_key(F.col("p_partkey"), F.col("p_size").cast("long")).alias("profile_key"), numeric.significant(F.col("p_retailprice") / 7).alias("price"))


@query(f"""WITH {_PERIODS} SELECT "competitionId", period, min(date)::DATE::VARCHAR AS first_date, max(date)::DATE::VARCHAR AS last_date, count(*) AS n_matches FROM m JOIN periods USING (match_id, "competitionId") GROUP BY ALL""")
def period_dates(spark, sf_dir):
    """First and last day of both halves of each competition."""
    matches = stand_in.matches(spark, sf_dir).select("match_id", "date")
    return showcase.period_dates(matches, stand_in.periods(spark, sf_dir).select("match_id", "competitionId", "period"))


@query("""WITH p AS (SELECT l_suppkey AS player_id, CASE l_partkey % 6 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN 'Left Back' WHEN 2 THEN 'Center Back' WHEN 3 THEN 'Center Midfield' WHEN 4 THEN 'Striker' END AS position FROM lineitem WHERE l_orderkey % 9 = 0),
c AS (SELECT player_id, position, count(*) AS n FROM p WHERE position IS NOT NULL GROUP BY ALL), m AS (SELECT player_id, arg_min(position, (-n, position)) AS position FROM c GROUP BY 1)
SELECT player_id, CASE WHEN contains(position, 'Goalkeeper') THEN 'Goalkeeper' WHEN contains(position, 'Back') THEN 'Defender' WHEN contains(position, 'Midfield') THEN 'Midfielder' ELSE 'Forward' END AS role FROM m""")
def roles_by_position(spark, sf_dir):
    """A role from the most frequent position, ties to the first name."""
    names = F.array(*(F.lit(x) for x in ("Goalkeeper", "Left Back", "Center Back", "Center Midfield", "Striker", None)))
    flat = table(spark, sf_dir, "lineitem").where("l_orderkey % 9 = 0").select(F.col("l_suppkey").alias("player_id"), F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("position_name"))
    return readers.roles_from_positions(flat)


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lines_with_customer(spark, sf_dir):
    """A lookup that must find every row: a line without order would stop the query."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return temporal.attach_total(lines, orders, ["l_orderkey"], "a line has no order").select("l_orderkey", "l_linenumber", "o_custkey")


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::INT AS size, c_acctbal + 0 AS known FROM customer
UNION ALL SELECT p_partkey, p_name, NULL, p_size, p_size::DOUBLE FROM part UNION ALL SELECT s_suppkey, NULL, s_acctbal, NULL, s_acctbal FROM supplier""")
def relaxed_union(spark, sf_dir):
    """Tables of different columns in one, missing ones null; and a sum across columns that leaves nulls out."""
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    two = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    three = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    out = readers.union_relaxed(one, two, three)
    return out.withColumn("known", numeric.add_known([F.col("balance"), F.col("size")]).cast("double"))


@query("""SELECT event_id AS "eventId", user_id AS "playerId", event_type AS "eventName", CASE WHEN event_id % 4 > 0 THEN event_id END AS "subEventId", CASE WHEN event_id % 5 > 0 THEN 'Sub ' || user_id END AS "subEventName",
  round(value, 2) AS "eventSec", CASE WHEN event_id % 3 > 0 THEN 1801 ELSE 1802 END AS first_tag, event_id % 100 AS first_x FROM events""")
def events_from_json(spark, sf_dir):
    """Files that hold an array of events each: an empty sub-event id and the text null are no values."""
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    c = F.col
    sub = F.when(c("event_id") % 4 > 0, c("event_id").cast("string")).otherwise("")
    name = F.when(c("event_id") % 5 > 0, F.concat(F.lit("Sub "), c("user_id").cast("string"))).otherwise("null")
    tags = F.array(F.struct(F.when(c("event_id") % 3 > 0, 1801).otherwise(1802).alias("id")))
    spots = F.array(F.struct(F.lit(5).alias("y"), (c("event_id") % 100).alias("x")))
    record = F.to_json(F.struct(c("event_id").alias("eventId"), c("user_id").alias("playerId"), c("event_type").alias("eventName"), sub.alias("subEventId"), name.alias("subEventName"), F.round("value", 2).alias("eventSec"), tags.alias("tags"), spots.alias("positions")))
    arrays = table(spark, sf_dir, "events").groupBy(F.floor(c("event_id") / 2000).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)  # an array of 2,000 events in each file
    out = readers.events(spark, f"{path}/*")
    return out.select("eventId", "playerId", "eventName", "subEventId", "subEventName", "eventSec", F.get("tags", 0)["id"].alias("first_tag"), F.get("positions", 0)["x"].alias("first_x"))
