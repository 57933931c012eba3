"""Panel building, recodes, reshaping, joins and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recode as R
from ..operators import joins, reshape, summaries
from ..operators.intervals import vital_outcome
from ..operators.quantiles import exact_quantiles, quantile_table
from ..operators.sequences import add_previous_wave, first_per_person
from ..sources import tables
from . import standin as S
from .registry import query, rounded

WAVES = range(1, 8)


@query(
    "panel_build",
    f"WITH {S.SQL_PANEL} SELECT id, wave, n_orders, a, b, state, functional_state, round(spend, 4) AS spend FROM panel",
)
def panel_build(spark, sf):
    built = S.panel(spark, sf)
    return rounded(
        built.select("id", "wave", "n_orders", "a", "b", "state", "functional_state", "spend"), 4
    )


def wide_panel(spark, sf):
    long = S.panel(spark, sf)
    state = reshape.long_to_wide(long, "id", "wave", list(WAVES), "state", lambda w: f"state_{w}")
    return state


@query(
    "panel_pivot_wide",
    f"WITH {S.SQL_PANEL} SELECT id, "
    + ", ".join(f"max(CASE WHEN wave = {w} THEN state END) AS state_{w}" for w in WAVES)
    + " FROM panel GROUP BY id",
)
def panel_pivot_wide(spark, sf):
    return wide_panel(spark, sf)


@query(
    "panel_wide_to_long",
    f"""WITH {S.SQL_PANEL}, ids AS (SELECT DISTINCT id FROM panel),
    waves AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS wave)
    SELECT ids.id, waves.wave, CASE WHEN p.id IS NULL THEN 0 ELSE 1 END AS seen, p.state
    FROM ids CROSS JOIN waves LEFT JOIN panel p ON p.id = ids.id AND p.wave = waves.wave""",
)
def panel_wide_to_long(spark, sf):
    columns = tables.wave_columns(["state"], WAVES, "{stem}_{wave}")
    return reshape.wide_to_long(
        wide_panel(spark, sf),
        ["id"],
        {
            w: {"seen": R.flag(F.col(c).isNotNull()), "state": F.col(c)}
            for w, c in zip(WAVES, columns)
        },
    )


@query(
    "strict_panel",
    f"WITH {S.SQL_STRICT} SELECT id, wave, n_f, n_p, functional_state FROM strict",
)
def strict_panel(spark, sf):
    return S.status_panel(spark, sf, threshold=2).select("id", "wave", "n_f", "n_p", "functional_state")


@query(
    "recode_and_validity",
    """SELECT l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_linenumber - 1 IN (0, 1) THEN CAST(l_linenumber - 1 AS DOUBLE) END AS second_line,
      CASE WHEN l_quantity >= 5 AND l_quantity <= 45 THEN l_quantity END AS plausible_quantity,
      CASE WHEN l_discount > 0 AND l_discount <= 0.05 THEN l_discount END AS small_discount,
      TRY_CAST(CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS DOUBLE) AS coerced,
      round(year(l_shipdate) + (CASE WHEN l_returnflag = 'A' THEN 7 ELSE month(l_shipdate) END - 0.5) / 12, 6) AS ship_time,
      round(ln(1 + l_extendedprice), 6) AS log_price,
      CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END AS bulk,
      CAST(CASE WHEN l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'N' THEN 0
           WHEN l_returnflag = 'R' THEN 1 END AS DOUBLE) AS settled,
      CASE WHEN l_tax = 0 THEN 3 WHEN l_quantity < 12 THEN 0 WHEN l_quantity <= 36 THEN 1 ELSE 2 END AS quantity_band,
      CASE WHEN l_tax > 0 THEN least(greatest(l_tax, 0.02), 0.06) END AS bounded_tax,
      CASE WHEN l_linenumber = 5 THEN 1 WHEN l_linenumber IN (1, 4) THEN 0 END AS vital
    FROM lineitem""",
)
def recode_and_validity(spark, sf):
    line = S.table(spark, sf, "lineitem")
    month = F.when(F.col("l_returnflag") == "A", None).otherwise(F.month("l_shipdate"))
    untaxed_missing = F.when(F.col("l_tax") == 0, None)
    text = F.when(F.col("l_returnflag") == "R", "n/a").otherwise(F.col("l_linenumber").cast("string"))
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        R.strict_binary(F.col("l_linenumber") - 1).alias("second_line"),
        R.in_range("l_quantity", 5, 45).alias("plausible_quantity"),
        R.in_range("l_discount", 0, 0.05, open_low=True).alias("small_discount"),
        R.lenient_number(text).alias("coerced"),
        F.round(R.decimal_year(F.year("l_shipdate"), month, 1994.5), 6).alias("ship_time"),
        F.round(F.log1p("l_extendedprice"), 6).alias("log_price"),
        R.at_least("l_quantity", 10).alias("bulk"),
        R.prioritised(
            [
                (F.col("l_returnflag") == "R", 1.0),
                (F.col("l_returnflag") == "N", 0.0),
                (F.col("l_linestatus") == "O", 1.0),
            ]
        ).alias("settled"),
        R.banded(untaxed_missing.otherwise(F.col("l_quantity")), 12, 36).alias("quantity_band"),
        R.clip(untaxed_missing.otherwise(F.col("l_tax")), 0.02, 0.06).alias("bounded_tax"),
        vital_outcome(F.col("l_linenumber")).alias("vital"),
    )


@query(
    "recode_categories",
    """WITH c AS (SELECT *, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer)
    SELECT c_custkey, round(balance - (SELECT avg(balance) FROM c), 4) AS balance_centred,
      CAST(CAST(round_even(balance / 500, 0) AS INTEGER) AS VARCHAR) AS balance_step,
      coalesce(CAST(CASE WHEN c_nationkey < 20 THEN c_nationkey END AS VARCHAR), '-1') AS nation_level FROM c""",
)
def recode_categories(spark, sf):
    """A number about its mean, in rounded steps (half to even), and a code with a level for a missing one."""
    rows = S.table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    rows = rows.withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    mean = rows.agg(F.avg("balance")).first()[0]
    return rows.select(
        "c_custkey",
        F.round(R.centred("balance", mean), 4).alias("balance_centred"),
        R.rounded_category(F.col("balance") / 500).alias("balance_step"),
        R.as_category(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey"))).alias("nation_level"),
    )


SQL_ITEMS = """items AS (
  SELECT l_orderkey, """ + ", ".join(
    f"max(CASE WHEN l_linenumber = {k} THEN l_quantity END) AS q{k}" for k in range(1, 5)
) + """ FROM lineitem GROUP BY l_orderkey),
coded AS (SELECT *, """ + ", ".join(
    f"CAST(1 + CAST(floor(q{k}) AS INTEGER) % 5 AS INTEGER) AS i{k}" for k in range(1, 5)
) + " FROM items)"
VALID = " AND ".join(f"coalesce(i{k} IN (1, 2, 3, 4), false)" for k in range(1, 5))


def order_items(spark, sf):
    """Quantities of the first four lines of each order, and item codes 1-5 of which 5 is invalid."""
    line = S.table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    readings = line.groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == k, F.col("l_quantity"))).alias(f"q{k}") for k in range(1, 5)]
    )
    return readings.select(
        "*", *[(1 + F.floor(f"q{k}").cast("int") % 5).alias(f"i{k}") for k in range(1, 5)]
    )


@query(
    "item_scores",
    f"""WITH {SQL_ITEMS}
    SELECT l_orderkey,
      CASE WHEN {VALID} THEN (i1 - 1) + (3 - (i2 - 1)) + (i3 - 1) + (i4 - 1) END AS score,
      CAST({" + ".join(f"CASE WHEN coalesce(i{k} = 1, false) THEN 1 ELSE 0 END" for k in range(1, 5))} AS INTEGER) AS ones,
      CASE WHEN {VALID} THEN {" + ".join(f"CASE WHEN i{k} > 1 THEN 1 ELSE 0 END" for k in range(1, 5))} END AS difficulties,
      CASE WHEN {VALID} THEN CASE WHEN i1 > 1 OR i2 > 1 OR i3 > 1 OR i4 > 1 THEN 1 ELSE 0 END END AS any_difficulty,
      CASE WHEN {" + ".join(f"CASE WHEN q{k} > 0 AND q{k} <= 40 THEN 1 ELSE 0 END" for k in range(1, 5))} >= 2
        THEN greatest({", ".join(f"CASE WHEN q{k} > 0 AND q{k} <= 40 THEN q{k} END" for k in range(1, 5))}) END AS best,
      {" + ".join(f"CASE WHEN q{k} > 0 AND q{k} <= 40 THEN 1 ELSE 0 END" for k in range(1, 5))} AS n_valid,
      CASE WHEN q2 IS NOT NULL THEN round((q3 - q1) * 2 / 8, 6) END AS slope
    FROM coded""",
)
def item_scores(spark, sf):
    items, codes = ["i1", "i2", "i3", "i4"], [1, 2, 3, 4]
    readings = [R.in_range(f"q{k}", 0, 40, open_low=True) for k in range(1, 5)]
    complete = R.all_valid(items, codes)
    return rounded(
        order_items(spark, sf).select(
            "l_orderkey",
            R.scale_score(items, codes, reverse=["i2"]).alias("score"),
            R.count_equal(items).alias("ones"),
            R.count_if_complete(items, lambda c: c > 1, complete).alias("difficulties"),
            R.any_if_complete(items, lambda c: c > 1, complete).alias("any_difficulty"),
            R.best_reading(readings).alias("best"),
            R.valid_readings(readings).alias("n_valid"),
            R.linear_slope(["q1", "q2", "q3"], [0.0, 2.0, 4.0]).alias("slope"),
        )
    )


SQL_LAG = """lagged AS (
  SELECT p.*, q.state AS lag_state FROM iv p LEFT JOIN panel q ON q.id = p.id AND q.wave = p.wave - 1)"""


def lagged_intervals(spark, sf):
    # every wave up to the last origin is an interval row, so the lag needs no second table
    return add_previous_wave(S.intervals(spark, sf), "id", "wave", {"state": "lag_state"})


@query(
    "fill_mode_median",
    f"""WITH {S.SQL_INTERVALS}, {S.SQL_PEOPLE}, {SQL_LAG},
    joined AS (SELECT l.id, l.wave, l.lag_state, l.destination_state, p.balance FROM lagged l LEFT JOIN people p ON p.id = l.id)
    SELECT id, wave,
      CAST(coalesce(lag_state, (SELECT lag_state FROM joined WHERE lag_state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, lag_state LIMIT 1)) AS DOUBLE) AS lag_state,
      CASE WHEN lag_state IS NULL OR balance IS NULL THEN 1 ELSE 0 END AS any_missing,
      coalesce(destination_state, -1) AS destination_state,
      CASE WHEN balance IS NULL THEN 1 ELSE 0 END AS balance_missing,
      round(coalesce(balance, (SELECT median(balance) FROM joined)), 6) AS balance_filled
    FROM joined""",
)
def fill_mode_median(spark, sf):
    rows = S.with_people(lagged_intervals(spark, sf), spark, sf).select(
        "id",
        "wave",
        F.col("lag_state").cast("double").alias("lag_state"),
        R.any_missing(["lag_state", "balance"]).alias("any_missing"),
        "destination_state",
        "balance",
    )
    filled = summaries.fill_missing(
        rows, mode=["lag_state"], median={"balance": "balance_filled"}, constant={"destination_state": -1}
    )
    return rounded(filled.drop("balance"))


@query(
    "checked_lookup_join",
    """SELECT o_orderkey, c_mktsegment AS segment, n_name AS nation FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def checked_lookup_join(spark, sf):
    orders = S.table(spark, sf, "orders", "o_orderkey", "o_custkey")
    customer = S.table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    nation = S.table(spark, sf, "nation", "n_nationkey", "n_name")
    customer = customer.toDF("o_custkey", "segment", "n_nationkey")
    joined = joins.checked_join(orders, customer, ["o_custkey"], hot_rows=1_000_000)
    return joins.lookup(joined, nation, "n_nationkey", "n_name", "nation").select(
        "o_orderkey", "segment", "nation"
    )


@query(
    "crosswalk_join",
    """WITH old AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS old_id, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT old_id, n_orders, new_id FROM old
    LEFT JOIN (SELECT c_name, min(c_custkey) AS new_id FROM customer WHERE c_acctbal >= 0 GROUP BY c_name) ON old_id = c_name""",
)
def crosswalk_join(spark, sf):
    orders = S.table(spark, sf, "orders", "o_custkey")
    old = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    old = old.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("old_id"),
        "n_orders",
    )
    customer = S.table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal")
    walk = customer.select(
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("old_id"), "c_custkey"
    )
    return joins.crosswalk_join(old, walk, "old_id", "c_custkey", "new_id")


@query(
    "outer_status_join",
    """SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, o_orderstatus AS status, n_lines, returned
    FROM orders FULL JOIN (SELECT l_orderkey, count(*) AS n_lines, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS returned
      FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def outer_status_join(spark, sf):
    orders = S.table(spark, sf, "orders", "o_orderkey", "o_orderstatus").toDF("orderkey", "status")
    line = S.table(spark, sf, "lineitem", "l_orderkey", "l_returnflag")
    outcome = line.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max(R.flag(F.col("l_returnflag") == "R")).alias("returned"),
    )
    return joins.status_join(orders, outcome, "orderkey")


@query(
    "coalesce_join",
    f"""WITH {S.SQL_PANEL}, mean_orders AS (SELECT id, avg(n_orders) AS m FROM panel GROUP BY id)
    SELECT p.id, p.wave, round(coalesce(CASE WHEN n_orders > 1 THEN CAST(n_orders AS DOUBLE) END, m), 6) AS wave_weight
    FROM panel p LEFT JOIN mean_orders USING (id)""",
)
def coalesce_join(spark, sf):
    waves = S.panel(spark, sf).select("id", "wave", F.col("n_orders").cast("double").alias("n"))
    partial = waves.select("id", "wave", F.when(F.col("n") > 1, F.col("n")).alias("wave_weight"))
    means = waves.groupBy("id").agg(F.avg("n").alias("wave_weight"))
    return rounded(joins.coalescing_join(partial, means, ["id"], "wave_weight"))


@query(
    "lag_join",
    f"WITH {S.SQL_INTERVALS}, {SQL_LAG} SELECT id, wave, state, lag_state FROM lagged",
)
def lag_join(spark, sf):
    joined = joins.previous_wave_join(
        S.intervals(spark, sf), S.panel(spark, sf), "id", "wave", {"state": "lag_state"}
    )
    return joined.select("id", "wave", "state", "lag_state")


@query(
    "semi_anti_cohort",
    f"""WITH {S.SQL_INTERVALS} SELECT id, wave, state FROM panel
    WHERE id IN (SELECT id FROM panel WHERE wave = 1) AND id NOT IN (SELECT id FROM iv WHERE known_dead = 1)""",
)
def semi_anti_cohort(spark, sf):
    waves = S.panel(spark, sf)
    cohort = joins.keep_ids(waves, waves.filter("wave = 1"), "id")
    gone = S.intervals(spark, sf).filter("known_dead = 1")
    return joins.drop_ids(cohort, gone, "id").select("id", "wave", "state")


@query(
    "replaced_columns",
    f"""WITH {S.SQL_PANEL}, {S.SQL_PEOPLE}
    SELECT p.id, p.wave, round(coalesce(q.balance, 0), 6) AS spend FROM panel p LEFT JOIN people q ON q.id = p.id""",
)
def replaced_columns(spark, sf):
    waves = S.panel(spark, sf).select("id", "wave", "spend")
    newer = S.people(spark, sf).select("id", F.coalesce("balance", F.lit(0.0)).alias("spend"))
    return rounded(joins.replace_columns(waves, newer, "id"))


@query(
    "adjacent_wave_people",
    f"""WITH {S.SQL_PANEL}
    SELECT now.id, 'waves ' || now.wave || '-' || after.wave AS pair
    FROM panel now JOIN panel after ON after.id = now.id AND after.wave = now.wave + 1 WHERE now.wave BETWEEN 1 AND 6""",
)
def adjacent_wave_people(spark, sf):
    """People seen at both waves, for every pair of adjacent waves."""
    waves = tables.stored(S.status_panel(spark, sf).select("id", "wave"), "waves")

    def pair(w):
        now, after = waves.filter(F.col("wave") == w), waves.filter(F.col("wave") == w + 1)
        return joins.common_keys(now, after, ["id"]).withColumn("pair", F.lit(f"waves {w}-{w + 1}"))

    return reshape.stack_rows([pair(w) for w in WAVES[:-1]])


@query(
    "first_row_per_person",
    f"WITH {S.SQL_PANEL} SELECT id, wave, state FROM panel QUALIFY row_number() OVER (PARTITION BY id ORDER BY wave) = 1",
)
def first_row_per_person(spark, sf):
    return first_per_person(S.panel(spark, sf), "id", "wave").select("id", "wave", "state")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return joins.duplicate_keys(S.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "group_quantiles",
    """SELECT l_linenumber, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
    FROM lineitem GROUP BY 1""",
)
def group_quantiles(spark, sf):
    line = S.table(spark, sf, "lineitem", "l_linenumber", "l_extendedprice")
    found = exact_quantiles(line, "l_extendedprice", [0.01, 0.5, 0.99], by=["l_linenumber"])
    rows = [(*group, *[round(v, 4) for v in values]) for group, values in found.items()]
    return spark.createDataFrame(rows, "l_linenumber int, p01 double, p50 double, p99 double")


@query(
    "sketched_price_quantiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
    FROM lineitem GROUP BY 1, 2""",
)
def sketched_price_quantiles(spark, sf):
    """Price quantiles by flag and status, every group by sketched brackets and exact counts."""
    line = S.table(spark, sf, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    found = quantile_table(line, "l_extendedprice", [0.01, 0.5, 0.99], ["l_returnflag", "l_linestatus"], small_group=0)
    named = found.select("l_returnflag", "l_linestatus", F.col("q0").alias("p01"), F.col("q1").alias("p50"), F.col("q2").alias("p99"))
    return rounded(named, 4)


@query(
    "part_quantiles",
    """SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75
    FROM lineitem GROUP BY 1""",
)
def part_quantiles(spark, sf):
    """Price quartiles of every part: as many groups as there are parts, so the result stays a table."""
    line = S.table(spark, sf, "lineitem", "l_partkey", "l_extendedprice")
    found = quantile_table(line, "l_extendedprice", [0.25, 0.5, 0.75], ["l_partkey"])
    return rounded(found.toDF("l_partkey", "p25", "p50", "p75"), 4)


@query(
    "modal_values",
    """SELECT (SELECT l_linenumber FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS line_mode,
      (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS quantity_mode,
      (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS flag_mode""",
)
def modal_values(spark, sf):
    line = S.table(spark, sf, "lineitem", "l_linenumber", "l_quantity", "l_returnflag")
    numbers = summaries.modal_values(line, ["l_linenumber", "l_quantity"])
    row = (int(numbers["l_linenumber"]), numbers["l_quantity"], summaries.modal_label(line, "l_returnflag"))
    return spark.createDataFrame([row], "line_mode int, quantity_mode double, flag_mode string")


@query(
    "delimited_round_trip",
    f"WITH {S.SQL_PANEL} SELECT CAST(id AS VARCHAR) AS id, wave, state, functional_state FROM panel",
)
def delimited_round_trip(spark, sf):
    path = tables.scratch_path(spark, "panel-csv")
    tables.write_table(S.panel(spark, sf).select("id", "wave", "state", "functional_state"), path, "csv")
    schema = "id string, wave int, state int, functional_state int"
    return tables.read_delimited(spark, path, schema)


@query(
    "build_audit",
    f"""WITH {S.SQL_INTERVALS} SELECT to_json({{'intervals': count(*), 'people': count(DISTINCT id),
      'deaths': CAST(sum(known_dead) AS BIGINT), 'censored': CAST(sum(1 - outcome_observed) AS BIGINT)}})::VARCHAR AS document FROM iv""",
)
def build_audit(spark, sf):
    checks = S.intervals(spark, sf, build=S.status_panel).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.countDistinct("id").alias("people"),
        F.sum("known_dead").alias("deaths"),
        F.sum(1 - F.col("outcome_observed")).alias("censored"),
    )
    return tables.audit_document(checks)


@query(
    "partition_rewrite",
    f"""WITH {S.SQL_PANEL} SELECT wave, count(*) AS people, CAST(sum(CASE WHEN wave = 3 THEN 2 * n_orders ELSE n_orders END) AS BIGINT) AS orders
    FROM panel WHERE wave IN (3, 4) GROUP BY 1""",
)
def partition_rewrite(spark, sf):
    """A table partitioned by wave, one wave rewritten in place, and a scan that reads two waves alone."""
    waves = S.panel(spark, sf).select("id", "wave", "n_orders")
    path = tables.write_table(waves, tables.scratch_path(spark, "waves"), partition_by=["wave"])
    revised = tables.read_table(spark, path).filter("wave = 3").withColumn("n_orders", F.col("n_orders") * 2)
    tables.replace_partitions(tables.stored(revised, "revised"), path, ["wave"])
    return tables.read_table(spark, path).filter("wave IN (3, 4)").groupBy("wave").agg(
        F.count(F.lit(1)).alias("people"), F.sum("n_orders").alias("orders")
    )
