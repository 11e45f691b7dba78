"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans of four kinds. Base generators are strict patterns
followed by a check (octets, Luhn, digit counts): spans that pass are always
redacted. High-recall generators propose further, overlapping spans: addresses
spelt out and numbers without a country code; and a match that failed its
check stays a candidate too.

Every candidate gets small integer features of its format and of the text just
before and after it, and a label that the features do not see:

  base generators    whether the check passes; of what is not personal data a share CHANCE passes too
  others             agreement: whether a base span anywhere in the table spells the same number or mail host

Spark counts candidates by feature values and label over the whole table (at
most 4 * FEATURE_CELLS rows of counts, whatever the table's size). Boosted
trees are fitted on the counts; on documents held out from them each
generator's scores are calibrated by isotonic regression, and the calibrated
rates are turned into the probability that a candidate is personal data: of
base generators by taking out CHANCE, then by the failed check, which of true
data only a share TYPO fails; of the others by the rate at which held-out
labelled candidates are known, LABELLED at least (what agrees with a base span
is labelled, what does not may still be true). A generator's threshold is the least score from
which that probability is `precision` or more, over `least` held-out
candidates at least; without as many it adds nothing. A candidate above it
that overlaps no base span is added; of overlapping additions the likeliest
stays, then the first, then the longest.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import written

KINDS = ("email", "ip", "card", "phone")

# The starts are those of whole runs (or the end of the last match), and the loops are possessive: the
# leftmost matches stay the same, and no text makes a search quadratic or recurse.
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?[(\[]at[)\]]\x20?{LABEL}++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?{LABEL}++)++",
    "phone": r"(?<![0-9A-Za-z+(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CONTEXT = (
    r"(?i)(?:mail|contact|write)[^\w]*$",
    r"(?i)(?:tel|phone|call|mobile|fax)[^\w]*$",
    r"(?i)(?:card|visa|account|payment)[^\w]*$",
    r"(?i)(?:\bip|host|server|address)[^\w]*$",
    r"(?i)(?:version|isbn|id|no|nr|token|=)[^\w]*$",
)
GENERATORS = (*BASE, *(f"loose {k}" for k in LOOSE))
FEATURES = {"generator": len(GENERATORS), "digits": 8, "seps": 4, "before": 6, "edge": 4, "tail": 2}
FEATURE_CELLS = math.prod(FEATURES.values())
# The share of other strings of the form that pass the check by chance, and of true ones that fail it.
CHANCE = {"email": 0.0, "ip": 0.05, "card": 0.1, "phone": 0.3}
TYPO = 0.01
LABELLED = 0.8  # of what is true among loose candidates so much is taken to be labelled at least
# Secrets are no kind of the four: values of 16 characters or more, with a digit, that are assigned to a telling name.
SECRET = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?([A-Za-z0-9_+/.-]{16,}+)"
EDGE = 24


def _starts(lengths: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array of integers, in blocks: close to linear in its size."""
    n = F.size(lengths)
    add = lambda a, x: a + x
    total = lambda arr: F.aggregate(arr, F.lit(0), add)
    blocks = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(blocks, lambda b: total(F.slice(lengths, b * block + 1, block)))
    bases = F.aggregate(
        sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
    )
    return F.transform(lengths, lambda _, i: F.get(bases, (i / block).cast("int")) + total(F.slice(lengths, (i / block).cast("int") * block + 1, i % block)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    d = F.lpad(digits, 19, "0")
    sums = []
    for i in range(1, 20):
        one = F.substring(d, i, 1)
        sums.append((one if i % 2 else F.translate(one, "0123456789", "0246813579")).cast("int"))
    return reduce(lambda a, b: a + b, sums) % 10 == 0


def passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(s))
    return F.length(_digits(s)).between(9, 15)


def _spelt(kind: str, s: Column) -> Column:
    """What a span spells, as a number to compare: a phone's last ten digits, a mail address's host; null for other kinds."""
    if kind == "phone":
        return F.when(F.length(_digits(s)) >= 7, F.xxhash64(F.lit(kind), F.right(_digits(s), F.lit(10))))
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.lower(s), r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
        return F.xxhash64(F.lit(kind), F.substring_index(plain, "@", -1))
    return F.lit(None).cast("long")


def spans(df: DataFrame, name: str, kind: str, pattern: str, gate: Column, base: bool) -> DataFrame:
    """df with an array column of the matches of pattern in df.text: position in code points, whether it is
    base, what it spells, and features."""
    empty = F.array().cast("array<string>")
    df = df.withColumn("m_", F.when(gate, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn("g_", F.when(F.size("m_") > 0, F.split("text", pattern, -1)).otherwise(empty))
    lengths = F.transform("m_", lambda m, i: F.length(m) + F.length(F.get("g_", i)))
    df = df.withColumn("l_", lengths)
    df = df.withColumn("p_", F.when(F.size("l_") > 0, _starts(F.col("l_"))).otherwise(F.array().cast("array<int>")))

    def one(m: Column, i: Column) -> Column:
        gap, after = F.get("g_", i), F.get("g_", i + 1)
        start = F.get("p_", i) + F.length(gap)
        # Features must not see what makes a base span: a country code before the rest of a number is passed over.
        before = F.regexp_replace(F.right(gap, F.lit(EDGE)), r"\+[0-9]{1,3}[\x20.-]*$", "")
        n = F.length(_digits(m))
        context = reduce(lambda rest, kv: F.when(before.rlike(kv[1]), kv[0] + 1).otherwise(rest), reversed(list(enumerate(CONTEXT))), F.lit(0))
        seps = F.length(F.regexp_replace(m, "[^\\x20().-]", ""))
        edge = F.when(before.rlike(r"[\w]$"), 1).otherwise(0) + F.when(after.rlike(r"^[\w]"), 2).otherwise(0)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"),
            (passes(kind, m) if base else F.lit(False)).alias("base"), _spelt(kind, m).alias("spelt"),
            F.lit(GENERATORS.index(kind if base else f"loose {kind}")).alias("generator"),
            F.least((n / 3).cast("int"), F.lit(7)).alias("digits"), F.least(seps, F.lit(3)).alias("seps"),
            context.alias("before"), edge.alias("edge"), after.rlike("^[.,/-][0-9]").cast("int").alias("tail"),
        )

    return df.withColumn(name, F.transform("m_", one)).drop("m_", "g_", "l_", "p_")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_secret, found): every span that a generator proposes, one row per document. Null counts as empty."""
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.col("text").rlike("[0-9]")
    df = df.withColumn("digit", number)
    gates = {"email": F.contains("text", F.lit("@")), "ip": F.col("digit"), "card": F.col("digit"), "phone": F.contains("text", F.lit("+"))}
    loose = {"email": F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at]")), "phone": F.col("digit")}
    for k in KINDS:
        df = spans(df, f"base_{k}", k, BASE[k], gates[k], True)
    for k, p in LOOSE.items():
        df = spans(df, f"loose_{k}", k, p, loose[k], False)
    named = F.col("text").rlike("[:=]\\x20{0,3}[\"']?[A-Za-z0-9_+/.-]{16}")
    values = F.filter(F.regexp_extract_all("text", F.lit(SECRET), F.lit(1)), lambda v: v.rlike("[0-9]"))
    secrets = F.when(named, F.size(values)).otherwise(0).cast("long").alias("n_secret")
    return df.select("doc_id", secrets, F.concat(*[f"base_{k}" for k in KINDS], *[f"loose_{k}" for k in LOOSE]).alias("found"))


# --- boosted trees over counts of feature values -----------------------------------------------------------


def _tree(cells: list[tuple], grad: list[float], hess: list[float], depth: int, rows: list[int]) -> tuple:
    """A regression tree as nested (feature, bound, left, right), or a leaf's value."""
    g, h = sum(grad[r] for r in rows), sum(hess[r] for r in rows)
    best = (1e-6, None, None)
    if depth:
        for f, bins in enumerate(FEATURES.values()):
            left_g = left_h = 0.0
            by = [(0.0, 0.0)] * bins
            for r in rows:
                a, b = by[cells[r][f]]
                by[cells[r][f]] = (a + grad[r], b + hess[r])
            for bound in range(bins - 1):
                left_g, left_h = left_g + by[bound][0], left_h + by[bound][1]
                if min(left_h, h - left_h) < 1e-3:
                    continue
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                best = max(best, (gain, f, bound), key=lambda x: x[0])
    if best[1] is None:
        return (0.5 * g / (h + 1),)
    _, f, bound = best
    return (
        f, bound,
        _tree(cells, grad, hess, depth - 1, [r for r in rows if cells[r][f] <= bound]),
        _tree(cells, grad, hess, depth - 1, [r for r in rows if cells[r][f] > bound]),
    )


def _value(tree: tuple, cell: tuple) -> float:
    while len(tree) > 1:
        tree = tree[2] if cell[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def boost(counts: dict[tuple, tuple[float, float]], rounds: int = 20, depth: int = 2) -> list[tuple]:
    """Trees whose sum is the log-odds, from (negatives, positives) by cell."""
    cells = sorted(counts)
    score = [0.0] * len(cells)
    trees = []
    for _ in range(rounds if cells else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        n = [sum(counts[c]) for c in cells]
        grad = [counts[c][1] - k * q for c, k, q in zip(cells, n, p, strict=True)]
        hess = [k * q * (1 - q) for k, q in zip(n, p, strict=True)]
        trees.append(_tree(cells, grad, hess, depth, list(range(len(cells)))))
        score = [s + _value(trees[-1], c) for s, c in zip(score, cells, strict=True)]
    return trees


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(score, n, rate) from (score, negatives, positives) in ascending order of score: the rates that rise with the score and fit best."""
    blocks: list[list] = []
    for score, neg, pos in points:
        blocks.append([[score], neg + pos, pos])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            scores, n, p = blocks.pop()
            blocks[-1] = [blocks[-1][0] + scores, blocks[-1][1] + n, blocks[-1][2] + p]
    return [(scores[0], n, p / n) for scores, n, p in blocks if n]


def thresholds(trees: list[tuple], held: dict[tuple, tuple[float, float]], precision: float, least: int) -> list[float]:
    """Per generator: the least log-odds from which its candidates are personal data with that probability; else infinity."""
    out = []
    for g, name in enumerate(GENERATORS):
        by_score: dict[float, list] = {}
        for cell, (neg, pos) in held.items():
            if cell[0] == g:
                at = by_score.setdefault(round(sum(_value(t, cell) for t in trees), 9), [0.0, 0.0])
                at[0], at[1] = at[0] + neg, at[1] + pos
        fitted = isotonic([(s, *by_score[s]) for s in sorted(by_score)])
        known = max(LABELLED, sum(n * rate * rate for _, n, rate in fitted) / max(sum(n * rate for _, n, rate in fitted), 1e-9))
        bound, above = math.inf, 0.0
        for score, n, rate in reversed(fitted):
            if name in BASE:
                true = max(0.0, (rate - CHANCE[name]) / (1 - CHANCE[name]))
                failed = true * TYPO + (1 - true) * (1 - CHANCE[name])
                likely = true * TYPO / failed if failed else 0.0
            else:
                likely = min(1.0, rate / known)
            above += n
            if likely < precision:
                break
            if above >= least:
                bound = score - 1e-6  # Spark adds the trees' values in another way
        out.append(bound)
    return out


def _expression(tree: tuple, x: Column) -> Column:
    if len(tree) == 1:
        return F.lit(float(tree[0]))
    return F.when(x[list(FEATURES)[tree[0]]] <= tree[1], _expression(tree[2], x)).otherwise(_expression(tree[3], x))


def fit(found: DataFrame, precision: float, least: int, held_out: int = 5) -> tuple[list[tuple], list[float]]:
    """Trees and per-generator bounds from counts over all candidates; documents with crc32(doc_id) divisible by held_out calibrate."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out == 0, F.lit(False))
    rows = found.select(held.alias("held"), F.inline("found"))
    # Candidates of one form that spell the same are counted before they are looked up.
    counted = rows.groupBy("held", *FEATURES, "spelt").agg(F.count("*").alias("n"), F.count_if("base").alias("passed"))
    known = rows.where("base AND spelt IS NOT NULL").select("spelt", F.lit(True).alias("agrees")).distinct()
    labelled = counted.join(known, "spelt", "left")
    strict = F.col("generator") < len(BASE)
    pos = F.when(strict, F.col("passed")).otherwise(F.when(F.col("agrees"), F.col("n")).otherwise(0))
    table = labelled.groupBy("held", *FEATURES).agg(F.sum(pos).alias("pos"), F.sum("n").alias("n"))
    train, calibrate = {}, {}
    for r in table.toLocalIterator():  # at most 2 * FEATURE_CELLS rows
        (calibrate if r["held"] else train)[tuple(r[f] for f in FEATURES)] = (float(r["n"] - r["pos"]), float(r["pos"]))
    trees = boost(train)
    return trees, thresholds(trees, calibrate, precision, least)


def detect(docs: DataFrame, precision: float = 0.99, least: int = 20) -> DataFrame:
    """One row per document: doc_id, base and spans as arrays of (kind, start, end), by kind and start, and n_secret.

    Positions are code points, the end exclusive. Empty and null texts have no
    spans; rows that repeat a doc_id are separate, and those without one train
    the trees and are never held out. Other columns are not read. An empty
    table gives no rows, and one without candidates no spans.
    """
    found = written(candidates(docs), "pii-candidates")
    trees, bounds = fit(found, precision, least)

    def likely(x: Column) -> Column:
        score = reduce(lambda a, b: a + b, [_expression(t, x) for t in trees], F.lit(0.0))
        limit = F.get(F.array(*[F.lit(float(b)) for b in bounds]), x["generator"])
        return F.when(~x["base"] & (score >= limit), score)

    slim = lambda x: F.struct(x["kind"], x["start"], x["end"])
    df = found.select(
        "doc_id", "n_secret",
        F.array_sort(F.transform(F.filter("found", lambda x: x["base"]), slim)).alias("base"),
        F.filter(
            F.transform("found", lambda x: F.struct((-likely(x)).alias("less"), x["start"], (-x["end"]).alias("back"), x["end"], x["kind"])),
            lambda x: x["less"].isNotNull(),
        ).alias("more"),
    )
    clear = lambda taken, x: ~F.exists(taken, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    added = F.aggregate(
        F.array_sort("more"), F.col("base"), lambda acc, x: F.when(clear(acc, x), F.concat(acc, F.array(slim(x)))).otherwise(acc)
    )
    return df.select("doc_id", "base", F.when(F.size("more") == 0, F.col("base")).otherwise(F.array_sort(added)).alias("spans"), "n_secret")


def redact(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """(doc_id, text, spans): each span of detect() replaced by its kind in angle brackets. doc_id must be unique."""
    found = detect(docs, precision).select("doc_id", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))).alias("s"))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.coalesce("text", F.lit(""))
    done = F.aggregate(
        "s", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
    )
    joined = docs.select("doc_id", "text").join(found, "doc_id").withColumn("done", done)
    return joined.select("doc_id", F.concat("done.out", F.expr("substring(coalesce(text, ''), done.at + 1)")).alias("text"), "s")


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def counts(spans: str) -> list[Column]:
    """A count for each kind in an array of spans."""
    of = lambda i: F.size(F.filter(spans, lambda x: x["kind"] == i)).cast("long")
    return [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *counts("base"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"), "n_secret")
