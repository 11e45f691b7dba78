"""Appointment statistics over a nested case register: who appoints whom, how often, and how closed the circle is.

All tables come from one table of seats (see seats()); every ordering ends in a
unique key, so ties don't depend on partitions. "Top" values are the most
frequent, then the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.functions.text import html_list, html_text
from skeinflow.operators.graph import spread, written

SEAT = r"^(.+?)\s*\(([^)]*)\)\s*-\s*Appointed by (.+)$"
RECONSTITUTED = (
    r"(?i)([A-Z][a-z]+ \d{1,2}, \d{4}):\s*([^(]+)\(([^)]*)\)\s*appointed following the "
    r"(resignation|disqualification|death|removal|withdrawal)\s+of\s+([^(]+)\(([^)]*)\)"
)
HONORIFICS = r"(?i)^(the\s+)?(arbitrator\s+of\s+|mr\.?\s+|ms\.?\s+|mrs\.?\s+|dr\.?\s+|prof\.?\s+|sir\s+|judge\s+)+"


def person(c: Column) -> Column:
    """A name without honorifics and without what follows ' of '."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), HONORIFICS, "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s+of\s+.*$", ""), r"\s+", " "), "^[ ,;]+|[ ,;]+$", "")


def side(label: Column) -> Column:
    low = F.lower(label)
    out = F.lit("other")
    for key, name in reversed(fixed.SIDES):
        out = F.when(F.contains(low, F.lit(key)), name).otherwise(out)
    return out


def firm_first_token(c: Column) -> Column:
    """'Firm, City, Country' to Firm."""
    return F.trim(F.substring_index(c, ",", 1))


def firm_strip_geo(c: Column, places: tuple[str, ...] = ()) -> Column:
    """Drops trailing parts that are places, or the last two where none is known; commas before them stay."""
    parts = F.split(c, r"\s*,\s*")
    keep = F.filter(parts, lambda p, i: (i == 0) | ~p.isin(*places)) if places else F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 2))
    return F.array_join(keep, ", ")


def treaty(first: Column, second: Column) -> Column:
    blank = lambda x: F.when(x != "", x)
    return F.concat_ws(" / ", blank(first), blank(second))


def seats(cases: DataFrame) -> DataFrame:
    """One row for each seat of each proceeding of the register whose text says who appointed it.

    cases: caseno, casetitle, econsector, instrumentinvk1, instrumentinvk2, _status, caseproceedings (array of
    structs with arbitrators, president, claimant, respondent, dateregistered, dateconstituted,
    clmnt_nationality, resp_nationality). Cases without proceedings give no rows.
    """
    p = cases.select("*", F.explode("caseproceedings").alias("p"))
    list_ = lambda name, role: F.transform(html_list(F.col(f"p.{name}")), lambda x: F.struct(x.alias("text"), F.lit(role).alias("role")))
    s = p.withColumn("s", F.explode(F.concat(list_("arbitrators", "member"), list_("president", "president")))).where(F.col("s.text").rlike(SEAT))
    part = lambda i: F.regexp_extract("s.text", SEAT, i)
    firms = lambda name: F.transform(html_list(F.col(f"p.{name}")), firm_first_token)
    return s.select(
        F.col("caseno").alias("case"), html_text("casetitle").alias("title"), F.col("_status").alias("status"), person(part(1)).alias("arbitrator"),
        F.trim(part(2)).alias("nationality"), F.col("s.role").alias("role"), side(part(3)).alias("appointed_by"), F.col("p.dateregistered").alias("registered"),
        F.col("p.dateconstituted").alias("constituted"), F.col("econsector").alias("sector"), treaty(F.col("instrumentinvk1"), F.col("instrumentinvk2")).alias("treaty"),
        html_text("p.resp_nationality").alias("respondent_state"), html_text("p.clmnt_nationality").alias("claimant_party"),
        firms("claimant").alias("claimant_firms"), firms("respondent").alias("respondent_firms"),
    )


def reconstitutions(cases: DataFrame) -> DataFrame:
    """One row for each replaced arbitrator; a date that can't be read stays as its text."""
    p = cases.select("caseno", "casetitle", F.explode("caseproceedings").alias("p")).withColumn("text", html_text("p.reconstituted"))
    groups = [F.regexp_extract_all("text", F.lit(RECONSTITUTED), F.lit(i)) for i in range(1, 7)]
    r = p.select("caseno", "casetitle", "p", F.explode(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcdef", strict=True)])).alias("m"))
    m = lambda n: F.col(f"m.{n}")
    return r.select(
        F.col("caseno").alias("case"), html_text("casetitle").alias("title"),
        F.coalesce(F.try_to_date(m("a"), "MMMM d, yyyy").cast("string"), m("a")).alias("date"), F.lower(m("d")).alias("reason"),
        person(m("e")).alias("outgoing"), F.trim(m("f")).alias("outgoing_nat"), person(m("b")).alias("incoming"), F.trim(m("c")).alias("incoming_nat"),
        html_text("p.resp_nationality").alias("respondent_state"),
    )


def top_value(df: DataFrame, key: str | list[str], value: str, name: str, rows: int = 0) -> DataFrame:
    """(key, name): the most frequent value of each key that is not null or empty, ties to the smallest. rows: how many
    df has, if known."""
    keys = [key] if isinstance(key, str) else key
    counted = spread(df.where((F.col(value).isNotNull()) & (F.col(value) != "")), rows, *keys, value).groupBy(*keys, value).agg(F.count("*").alias("n_"))
    # Of each key the least (count below zero, value).
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n_")).alias("n_"), F.col(value).alias("v_"))).alias("best_")).select(*keys, F.col("best_.v_").alias(name))


def appointee_table(rows: DataFrame, who: str = "arbitrator", tops: bool = True) -> DataFrame:
    """Per appointee: seats in all, pending, by side, as president, the share of claimants among both parties
    (0.5 without either), and the commonest sector and state. lean is not rounded."""
    c, r = F.count_if(F.col("appointed_by") == "claimant"), F.count_if(F.col("appointed_by") == "respondent")
    out = rows.groupBy(who).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), c.alias("claimant_side"), r.alias("respondent_side"),
        F.count_if(F.col("role") == "president").alias("president"),
        F.when(c + r > 0, c / (c + r)).otherwise(0.5).alias("claimant_lean"),
        *([F.min(F.when(F.col("nationality") != "", F.col("nationality"))).alias("nationality")] if "nationality" in rows.columns else []),
    )
    if tops:
        for value, name in (("sector", "top_sector"), ("respondent_state", "top_state")):
            out = out.join(top_value(rows, who, value, name), who, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def firm_affinity(rows: DataFrame, least: int = 2, who: str = "arbitrator") -> DataFrame:
    """Firm and appointee pairs of `least` appointments or more by the firm's side, each firm once a seat, and
    their share of the firm's appointments (not rounded)."""
    firms = F.when(F.col("appointed_by") == "claimant", F.col("claimant_firms")).when(F.col("appointed_by") == "respondent", F.col("respondent_firms"))
    pairs = rows.select(who, F.explode(F.array_distinct(firms)).alias("firm")).groupBy("firm", who).agg(F.count("*").alias("appointments"))
    whole = Window.partitionBy("firm")
    return (
        pairs.withColumn("firm_total", F.sum("appointments").over(whole)).where(F.col("appointments") >= least)
        .withColumn("share", F.col("appointments") / F.col("firm_total"))
    )


def counsel_table(rows: DataFrame, tops: bool = True) -> DataFrame:
    """Per firm: distinct cases for claimants, for respondents, and in all; commonest sector among claimants'
    seats and commonest state among respondents'."""
    firms = lambda c, claims: F.transform(F.filter(F.array(F.lit(claims)), lambda x: F.size(c) > 0), lambda x: F.struct(F.array_distinct(c).alias("firms"), x.alias("claims")))
    # Seats are made once, and written, so that their number is known before they are dealt out.
    each = rows.select("case", "sector", "respondent_state", F.inline(F.concat(firms(F.col("claimant_firms"), True), firms(F.col("respondent_firms"), False))))
    sides = written(each.select("case", "sector", "respondent_state", F.explode("firms").alias("firm"), "claims"), "sides")
    n = sides.count()
    # One row for each firm, case and side first: counting distinct cases is then counting rows.
    by_case = spread(sides, n, "firm", "case").groupBy("firm", "case").agg(F.max(F.col("claims").cast("int")).alias("c"), F.max((~F.col("claims")).cast("int")).alias("r"))
    out = by_case.groupBy("firm").agg(F.sum("c").alias("claimant_cases"), F.sum("r").alias("respondent_cases"), F.count("*").alias("total"))
    if tops:
        for which, value, name in ((F.col("claims"), "sector", "top_sector"), (~F.col("claims"), "respondent_state", "top_state_defended")):
            out = out.join(top_value(sides.where(which), "firm", value, name, n), "firm", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def recent_appointments(rows: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """Seats constituted in the last days before as_of; dates that can't be read are out."""
    return rows.withColumn("constituted_date", F.try_to_date("constituted", "MMMM d, yyyy")).where(F.col("constituted_date") >= F.date_sub(as_of, days))


def concentration(table: DataFrame, top: int = 20, who: str = "arbitrator") -> DataFrame:
    """One row: appointees, seats, and the share of all seats that the busiest `top` hold (0 of none)."""
    head = table.orderBy(F.desc("total"), who).limit(top).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("head"))
    whole = table.agg(F.count("*").alias("arbitrators"), F.coalesce(F.sum("total"), F.lit(0)).alias("seats"))
    return whole.join(F.broadcast(head)).select(  # one row each
        "arbitrators", "seats", F.lit(top).alias("top_n"), F.when(F.col("seats") > 0, F.col("head") / F.col("seats")).otherwise(0.0).alias("top_n_share")
    )


def reason_count(rows: DataFrame, reason: str = "disqualification") -> DataFrame:
    return rows.agg(F.count_if(F.col("reason") == reason).alias("n"))


def analytics(cases: DataFrame, as_of: Column, top: int = 60, days: int = 365) -> dict[str, DataFrame]:
    """The tables of the appointment report: totals (one row), arbitrators and counsel (the `top` largest), affinity,
    reconstitutions and recent (seats of the last days)."""
    rows = seats(cases)
    table = appointee_table(rows)
    totals = concentration(table).join(F.broadcast(cases.agg(F.count("*").alias("cases"))))  # one row each
    return {
        "totals": totals.withColumn("generated", as_of.cast("string")),
        "arbitrators": table.orderBy(F.desc("total"), "arbitrator").limit(top),
        "counsel": counsel_table(rows).orderBy(F.desc("total"), "firm").limit(top),
        "affinity": firm_affinity(rows), "reconstitutions": reconstitutions(cases), "recent": recent_appointments(rows, as_of, days),
    }


def write_analytics(cases: DataFrame, as_of: Column, path: str, **limits: int) -> None:
    """The report as JSON lines, a folder for each table, so that no table passes through one task."""
    for name, df in analytics(cases, as_of, **limits).items():
        df.write.mode("overwrite").json(f"{path}/{name}")
