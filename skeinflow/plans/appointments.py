"""Queries of the appointment statistics. A line item stands for a seat: the supplier is the appointee, the
return flag the appointing side, the order the case and its customer the counsel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators import appoint
from skeinflow.operators.graph import spread
from skeinflow.plans.registry import query

SEATS_SQL = """
seats AS (
  SELECT l_orderkey AS "case", l_suppkey AS arbitrator,
    CASE l_returnflag WHEN 'A' THEN 'claimant' WHEN 'R' THEN 'respondent' ELSE 'chairman' END AS appointed_by,
    CASE WHEN l_linenumber = 1 THEN 'president' ELSE 'member' END AS role,
    CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'concluded' END AS status, p_type AS sector, n_name AS respondent_state,
    o_custkey AS firm, o_orderdate::DATE AS constituted
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
"""


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = t("lineitem").count()
    with_orders = spread(t("lineitem"), rows, "l_orderkey").join(spread(t("orders"), rows, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    df = (
        spread(with_orders, rows, "l_partkey").join(spread(t("part"), rows, "p_partkey"), F.col("p_partkey") == F.col("l_partkey"))
        .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    )
    flag = F.col("l_returnflag")
    firm = F.array("o_custkey")
    return df.select(
        F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("arbitrator"),
        F.when(flag == "A", "claimant").when(flag == "R", "respondent").otherwise("chairman").alias("appointed_by"),
        F.when(F.col("l_linenumber") == 1, "president").otherwise("member").alias("role"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise("concluded").alias("status"),
        F.col("p_type").alias("sector"), F.col("n_name").alias("respondent_state"),
        F.when(flag == "A", firm).otherwise(F.array().cast("array<bigint>")).alias("claimant_firms"),
        F.when(flag == "R", firm).otherwise(F.array().cast("array<bigint>")).alias("respondent_firms"),
        F.col("o_orderdate").cast("date").alias("constituted_date"),
    )


def _top_sql(key: str, value: str, where: str = "true") -> str:
    return f"""(SELECT {key}, {value} AS v FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS rn
      FROM seats WHERE {where} GROUP BY {key}, {value}) WHERE rn = 1)"""


@query(
    "appointee_table",
    f"""WITH {SEATS_SQL}
SELECT a.*, coalesce(s.v, '') AS top_sector, coalesce(t.v, '') AS top_state FROM (
  SELECT arbitrator, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (appointed_by = 'claimant') AS claimant_side,
    count(*) FILTER (appointed_by = 'respondent') AS respondent_side, count(*) FILTER (role = 'president') AS president,
    CASE WHEN count(*) FILTER (appointed_by <> 'chairman') > 0
      THEN count(*) FILTER (appointed_by = 'claimant') / count(*) FILTER (appointed_by <> 'chairman') ELSE 0.5 END AS claimant_lean
  FROM seats GROUP BY arbitrator) a LEFT JOIN {_top_sql('arbitrator', 'sector')} s USING (arbitrator)
  LEFT JOIN {_top_sql('arbitrator', 'respondent_state')} t USING (arbitrator)""",
)
def appointee_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appoint.appointee_table(seats(spark, sf_dir))


@query(
    "appointee_concentration",
    f"""WITH {SEATS_SQL}, t AS (SELECT arbitrator, count(*) AS total FROM seats GROUP BY arbitrator)
SELECT (SELECT count(*) FROM t) AS arbitrators, (SELECT sum(total)::BIGINT FROM t) AS seats, 20 AS top_n,
  (SELECT sum(total)::DOUBLE FROM (SELECT total FROM t ORDER BY total DESC, arbitrator LIMIT 20)) / (SELECT sum(total)::DOUBLE FROM t) AS top_n_share""",
)
def appointee_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appoint.concentration(appoint.appointee_table(seats(spark, sf_dir), tops=False))


@query(
    "firm_affinity",
    f"""WITH {SEATS_SQL}, p AS (SELECT firm, arbitrator, count(*) AS appointments FROM seats WHERE appointed_by <> 'chairman' GROUP BY ALL),
t AS (SELECT firm, sum(appointments)::BIGINT AS firm_total FROM p GROUP BY firm)
SELECT firm, arbitrator, appointments, firm_total, appointments / firm_total AS share FROM p JOIN t USING (firm) WHERE appointments >= 2""",
)
def firm_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appoint.firm_affinity(seats(spark, sf_dir))


@query(
    "counsel_table",
    f"""WITH {SEATS_SQL}, c AS (SELECT * FROM seats WHERE appointed_by <> 'chairman')
SELECT a.*, coalesce(s.v, '') AS top_sector, coalesce(t.v, '') AS top_state_defended FROM (
  SELECT firm, count(DISTINCT "case") FILTER (appointed_by = 'claimant') AS claimant_cases,
    count(DISTINCT "case") FILTER (appointed_by = 'respondent') AS respondent_cases, count(DISTINCT "case") AS total FROM c GROUP BY firm) a
  LEFT JOIN {_top_sql('firm', 'sector', "appointed_by = 'claimant'")} s USING (firm)
  LEFT JOIN {_top_sql('firm', 'respondent_state', "appointed_by = 'respondent'")} t USING (firm)""",
)
def counsel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appoint.counsel_table(seats(spark, sf_dir))


@query(
    "recent_appointments",
    f"""WITH {SEATS_SQL} SELECT "case", arbitrator, role, appointed_by, constituted AS constituted_date FROM seats
WHERE constituted >= (SELECT max(o_orderdate)::DATE FROM orders) - 365""",
)
def recent_appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderdate").cast("date").alias("d")).first()["d"]
    df = seats(spark, sf_dir).withColumn("constituted", F.date_format("constituted_date", "MMMM d, yyyy"))
    return appoint.recent_appointments(df, F.lit(latest), 365).select("case", "arbitrator", "role", "appointed_by", "constituted_date")


@query(
    "reconstitutions",
    """SELECT c_custkey::VARCHAR AS "case", strftime(DATE '2020-01-01' + (c_custkey % 1000)::INTEGER, '%Y-%m-%d') AS date,
  CASE WHEN c_nationkey % 2 = 0 THEN 'resignation' ELSE 'disqualification' END AS reason, 'Incoming ' || c_custkey AS incoming, 'Outgoing ' || n_name AS outgoing
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def reconstitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is a case whose text tells one replacement."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")), "MMMM d, yyyy")
    text = F.concat(
        day, F.lit(": Dr. Incoming "), F.col("c_custkey").cast("string"), F.lit(" (French) appointed following the "),
        F.when(F.col("c_nationkey") % 2 == 0, "resignation").otherwise("Disqualification"), F.lit(" of Mr Outgoing "), F.col("n_name"), F.lit(" of Somewhere (Swiss)"),
    )
    cases = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").cast("string").alias("caseno"), F.col("c_name").alias("casetitle"),
        F.array(F.struct(text.alias("reconstituted"), F.col("n_name").alias("resp_nationality"))).alias("caseproceedings"),
    )
    return appoint.reconstitutions(cases).select("case", "date", "reason", "incoming", "outgoing")


@query(
    "seats_from_register",
    """SELECT o_orderkey::VARCHAR AS "case", 'Person ' || (o_custkey % 50) AS arbitrator, 'N' || (o_custkey % 7) AS nationality, 'member' AS role,
  CASE o_orderkey % 3 WHEN 0 THEN 'claimant' WHEN 1 THEN 'respondent' ELSE 'chairman' END AS appointed_by, 'Firm ' || (o_custkey % 9) AS firms FROM orders""",
)
def seats_from_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a nested register with HTML lists, and read as seats."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = F.when(F.col("o_orderkey") % 3 == 0, "the Claimant(s)").when(F.col("o_orderkey") % 3 == 1, "the Respondent(s)").otherwise("the Chairman of the Administrative Council")
    seat = F.concat(
        F.lit("Mr. Person "), (F.col("o_custkey") % 50).cast("string"), F.lit(" (N"), (F.col("o_custkey") % 7).cast("string"), F.lit(") - Appointed by "), label,
        F.lit("<br/>Someone Without Side<br>"),
    )
    firm = F.concat(F.lit("<b>Firm "), (F.col("o_custkey") % 9).cast("string"), F.lit("</b>, Paris, France"))
    empty = F.lit(None).cast("string")
    proceeding = F.struct(
        seat.alias("arbitrators"), empty.alias("president"), firm.alias("claimant"), empty.alias("respondent"), empty.alias("dateregistered"),
        empty.alias("dateconstituted"), empty.alias("clmnt_nationality"), empty.alias("resp_nationality"),
    )
    cases = o.select(
        F.col("o_orderkey").cast("string").alias("caseno"), F.lit("t").alias("casetitle"), F.lit("s").alias("econsector"), empty.alias("instrumentinvk1"),
        empty.alias("instrumentinvk2"), F.lit("pending").alias("_status"), F.array(proceeding).alias("caseproceedings"),
    )
    return appoint.seats(cases).select("case", "arbitrator", "nationality", "role", "appointed_by", F.array_join("claimant_firms", ";").alias("firms"))
