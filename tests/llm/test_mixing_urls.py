import math

from pyspark.sql import functions as F

from skeinflow.llm import mixing as M
from skeinflow.llm import urls as U


def test_poisson_cdf(spark):
    row = spark.range(1).select(M.poisson_cdf(F.lit(2.5)).alias("c"), M.poisson_cdf(F.lit(0.0)).alias("z")).first()
    want = [sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1)) for k in range(10)]
    assert all(abs(a - b) < 1e-12 for a, b in zip(row["c"], want)) and row["z"][0] == 1.0


def test_mixture_reaches_its_weights(spark, docs):
    n = 6000
    df = docs([f"t{i}" for i in range(n)], source=["a" if i % 3 else ("b" if i % 2 else None) for i in range(n)])
    mixed = M.mix(df, {"a": 1.0, "b": 3.0}, size=2.0)
    rows = mixed.collect()
    by = {s: sum(r["source"] == s for r in rows) for s in ("a", "b", None)}
    assert abs(by["a"] - 3000) < 250 and abs(by["b"] - 9000) < 450 and by[None] == 0
    assert mixed.columns == [*df.columns, "copy", "place"]
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    again = M.mix(df.repartition(7), {"a": 1.0, "b": 3.0}, size=2.0)
    assert sorted(map(tuple, again.select("doc_id", "copy", "place").collect())) == sorted((r["doc_id"], r["copy"], r["place"]) for r in rows)
    # Shuffled over all: partitions hold ranges of place, each sorted.
    places = [p["place"] for p in rows]
    assert places == sorted(places)


def test_mixing_edges(docs):
    assert M.mix(docs([])).count() == 0
    assert M.mix(docs([(1, None), (1, None)])).count() % 2 == 0
    assert M.mix(docs(["a"]), {"other": 1.0}).count() == 0


def test_mixing_keeps_columns_of_any_name(spark, docs):
    """Names that the operator uses for itself, in any case."""
    names = ["n", "N_", "block_", "cdf", "Variables", "source_", "rate", "rows", "weight"]
    plain = docs([f"t{i}" for i in range(50)], source=["a" if i % 3 else "b" for i in range(50)])
    more = plain.select("*", *[(F.col("doc_id") + 1000 * (k + 1)).alias(c) for k, c in enumerate(names)])
    got = M.mix(more, shuffle=False)
    assert got.columns == [*more.columns, "copy", "place"]
    for r in got.collect():
        assert [r[c] for c in names] == [r["doc_id"] + 1000 * (k + 1) for k in range(len(names))]
    assert sorted((r["doc_id"], r["copy"]) for r in got.collect()) == sorted((r["doc_id"], r["copy"]) for r in M.mix(plain, shuffle=False).collect())


def test_rare_sources(docs):
    """One document for a third or a half of the mixture: many Poisson variables, many blocks of copies."""
    n = 6000
    df = docs([f"t{i}" for i in range(n)], source=["rare" if i == 7 else "a" for i in range(n)])
    got = {r["source"]: (r["n"], r["top"]) for r in M.mix(df, shuffle=False).groupBy("source").agg(F.count("*").alias("n"), F.max("copy").alias("top")).collect()}
    assert abs(got["rare"][0] - 3000) < 6 * 3000**0.5 and got["rare"][1] == got["rare"][0] - 1 and abs(got["a"][0] - 3000) < 6 * 3000**0.5
    many = M.mix(docs([(i, "x") for i in range(200)]), size=1200.0, shuffle=False).groupBy("doc_id").count().collect()
    mean = sum(r["count"] for r in many) / 200
    spread = sum((r["count"] - mean) ** 2 for r in many) / 199
    assert abs(mean - 1200) < 4 * (1200 / 200) ** 0.5 and 0.7 < spread / 1200 < 1.4


PAGES = [
    (1, "HTTP://Sub.Example.NET/en/x"), (2, "http://example.net/de"), (3, "http://a.example.com/de/1?q"), (4, "https://x.ORG/fr/"), (5, "http://x.org"), (6, None),
    (7, "no scheme"), (8, "http://bad.site.io/a"), (9, "http://bad.site.io/b"), (10, "http://notexample.net#/en/"), (11, "http://[::1]:80/"), (12, "//h/p"),
    (13, "a://b://c/d"), (14, "http://net/"), (15, "http://u@Host.co.uk:8080/p?x#y"), (16, "http://new.site.io/"),
]


def test_rules_and_reputation(spark):
    df = spark.createDataFrame([(*p, "h", "r") for p in PAGES], "page_id long, url string, host string, rule string")
    more = spark.createDataFrame([(1000 + i, f"http://{'bad.site.io' if i < 60 else 'good.site.io'}/{i}", "", "") for i in range(200)], df.schema)
    outcomes = spark.createDataFrame([(1000 + i, i < 60) for i in range(200)] + [(2, None), (1000, True)], "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in U.judge(df.union(more), outcomes).collect()}
    assert len(got) == 216
    assert got[1] == ("sub.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("a.example.com", "/de/1", "example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][1:3] == ("", None) and got[6][:3] == got[7][:3] == got[12][:3] == ("", "", None)
    assert got[8][3] == got[9][3] == "block" and got[1100][3] == "allow" and got[16][3] == "allow"
    assert got[10][:3] == ("notexample.net", "", None) and got[13][:2] == ("b:", "//c/d") and got[14][2] == "net/"
    assert got[15][:2] == ("u@host.co.uk:8080", "/p")


def test_levels(spark):
    hosts = ["u@a.b.co.uk:80", "x.y.z", "10.0.0.1", "[::1]", "[::1]:8080", "", "com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(*[c.alias(n) for c, n in zip(U.levels(F.col("h")), "ds")])
    assert [tuple(r) for r in df.collect()] == [("b.co.uk", "co.uk"), ("y.z", "z"), ("10.0.0.1", ""), ("[::1]", ""), ("[::1]", ""), ("", ""), ("com", "com")]


def test_beta_cdf(spark):
    """Against the binomial tail, which it is for whole numbers, and the integral of the density for others."""
    pairs = [(a, b) for a in (1, 2, 7, 40, 300) for b in (1, 3, 25, 300)]
    want = {(a, b): sum(math.comb(a + b - 1, j) for j in range(a, a + b)) / 2 ** (a + b - 1) for a, b in pairs}
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double").select("a", "b", U.beta_cdf(0.5, F.col("a"), F.col("b")).alias("p"))
    assert all(abs(r["p"] - want[int(r["a"]), int(r["b"])]) < 1e-9 for r in df.collect())
    a, b, x = 3.7, 1.9, 0.3
    density = lambda t: math.exp((a - 1) * math.log(t) + (b - 1) * math.log(1 - t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    area = sum(density((i + 0.5) * x / 20_000) for i in range(20_000)) * x / 20_000
    row = spark.range(1).select(U.beta_cdf(x, F.lit(a), F.lit(b)).alias("p"), U.beta_cdf(0.5, F.lit(505_000.0), F.lit(500_000.0)).alias("far"), U.log_gamma(F.lit(0.01)).alias("g")).first()
    assert abs(row["p"] - area) < 1e-7 and row["far"] < 1e-5 and abs(row["g"] - math.lgamma(0.01)) < 1e-9


def test_beta_cdf_of_large_groups_has_the_same_formula(spark):
    """Near the mean, where the normal distribution is close, on both sides of a million labels."""
    pairs = [(499_000.0, 500_000.0), (501_000.0, 500_500.0), (600_000.0, 600_000.0), (50_003_000.0, 50_000_000.0), (49_998_000.0, 50_000_000.0)]
    df = spark.createDataFrame(pairs, "a double, b double").select("a", "b", U.beta_cdf(0.5, F.col("a"), F.col("b")).alias("p"))
    for r in df.collect():
        a, b = r["a"], r["b"]
        z = (0.5 - a / (a + b)) / math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert abs(r["p"] - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-5


def test_reputation_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    hosts = {f"w{i}.d{i % 13}.{'io' if i % 3 else 'co.uk'}": (rng.randrange(0, 30), rng.random()) for i in range(60)}
    pages, bad = [], {}
    for h, (n, share) in hosts.items():
        for _ in range(n):
            pages.append((len(pages), f"http://{h}/x"))
            bad[len(pages) - 1] = rng.random() < share
        pages.append((len(pages), f"http://{h}/unlabelled"))
    counts = {h: (sum(bad.get(i, 0) for i, u in pages if f"/{h}/" in u), n) for h, (n, _) in hosts.items()}
    up = {h: (".".join(h.split(".")[1:]), "co.uk" if h.endswith("uk") else "io") for h in hosts}

    def add(groups):
        out = {}
        for key, c in groups:
            out[key] = tuple(x + y for x, y in zip(out.get(key, (0, 0)), c))
        return {k: v for k, v in out.items() if v[1]}

    def posterior(table, mean_of):
        m = {k: mean_of(k) for k in table}
        noise = sum(m[k] * (1 - m[k]) for k in table)
        spread = sum(n * (b / n - m[k]) ** 2 for k, (b, n) in table.items())
        weight = sum(n * m[k] * (1 - m[k]) for k, (_, n) in table.items())
        s = 1 / min(max((spread - noise) / max(weight - noise, 1e-9), 1e-3), 0.5) - 1
        return {k: (m[k] * s + b, (1 - m[k]) * s + n - b) for k, (b, n) in table.items()}

    mean = lambda ab: ab[0] / sum(ab)
    by_suffix, by_domain, by_host = add((up[h][1], c) for h, c in counts.items()), add((up[h], c) for h, c in counts.items()), add(counts.items())
    total = [sum(x) for x in zip(*counts.values())]
    ps = posterior(by_suffix, lambda k: (total[0] + 0.5) / (total[1] + 1))
    pd = posterior(by_domain, lambda k: mean(ps[k[1]]))
    ph = posterior(by_host, lambda k: mean(pd[up[k]]))

    def blocked(ab):
        a, b = ab
        x = [(i + 0.5) / 8000 for i in range(4000)]
        return sum(math.exp((a - 1) * math.log(t) + (b - 1) * math.log(1 - t) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) for t in x) / 8000 < 0.05

    want = {h: blocked(ph.get(h) or pd.get(up[h]) or ps[up[h][1]]) for h in hosts}
    df = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")
    got = {r["host"]: r["verdict"] == "block" for r in U.judge(df, outcomes, rules=()).collect()}
    assert got == want and 5 < sum(want.values()) < 40
    assert U.levels(F.col("h"), ())[0] is not None and U.judge(df, outcomes, rules=(), second_level=()).count() == len(pages)


def test_no_pages_and_no_labels(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    assert {r["verdict"] for r in U.judge(df, none).where("rule is null").collect()} == {"allow"}
    assert U.judge(df.limit(0), none).count() == 0
