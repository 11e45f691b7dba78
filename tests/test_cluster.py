import random

import pytest
from pyspark.sql import functions as F

from skeinflow.functions.text import outlet_rank, topics
from skeinflow.operators import cluster, link

LEX = cluster.Lexicon(
    forms={"Turkey": "Turkey", "Iraq": "Iraq", "Mexico": "Mexico", "Czechia": "Czechia", "Peru": "Peru"},
    common=("licence", "revok", "wins", "min", "bank"), cities=("london",),
)


def stories(spark, titles, **more):
    rows = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(titles)]
    kinds = {"event_type": "string", "case_ref": "string", "lang": "string", "claimants": "array<string>", "states": "array<string>"}
    df = spark.createDataFrame(rows, "id long, title string" + "".join(f", {k} {kinds[k]}" for k in more))
    return {r["id"]: r["story"] for r in cluster.fold(df, LEX, F.col("id")).collect()}, df


def test_three_phrasings_are_one_story(spark):
    got, _ = stories(
        spark,
        ["Turkey revokes licence of Halvar energy unit", "Halvar says Turkey revoked its energy licence", "Turkey strips Halvar of energy licence"],
    )
    assert set(got.values()) == {0}


def test_another_company_is_another_story(spark):
    got, _ = stories(spark, ["Turkey revokes licence of payments firm Zentil", "Turkey revokes licence of payments firm Korbank"])
    assert len(set(got.values())) == 2


def test_case_numbers_keep_apart(spark):
    got, _ = stories(spark, ["Tribunal constituted in Dornex dispute with Peru"] * 2, case_ref=["ARB/1", "ARB/2"])
    assert len(set(got.values())) == 2


def test_same_parties_join(spark):
    got, _ = stories(spark, ["Silver mine row deepens", "Arbitrators picked for Peru matter"], claimants=[["Aurix"], ["Aurix"]], states=[["Peru"], ["Peru"]])
    assert set(got.values()) == {0}


def test_english_copy_tells_the_story(spark):
    got, _ = stories(spark, ["Halvar Turkey licence revoked dispute", "Halvar Turkey licence revoked dispute grows"], lang=["fr", "en"])
    assert set(got.values()) == {1}


def test_every_item_is_in_one_story_in_both_forms(spark):
    titles = ["Turkey revokes licence of Halvar", "", "Halvar loses licence in Turkey", "Grain prices fall", "Grain prices fall again", None]
    got, df = stories(spark, titles)
    assert sorted(got) == list(range(6))
    graph = {r["id"]: r["story"] for r in cluster.graph(df, LEX).collect()}
    assert sorted(graph) == list(range(6))
    assert graph[3] == graph[4] == 3
    with pytest.raises(ValueError, match="too large"):
        cluster.fold(df, LEX, F.col("id"), most=5)


def linked(a, b):
    """graph()'s rules for two items, from their features."""
    if a["_case"] and b["_case"] and a["_case"] != b["_case"]:
        return False
    s = {k: (set(a[k] or ()), set(b[k] or ())) for k in ("_toks", "_names", "_ents", "_rare", "_phrases", "_jur", "_parties", "_states")}
    common = {k: x & y for k, (x, y) in s.items()}
    if common["_parties"] and any(p != q for p in common["_parties"] for q in common["_states"]):
        return True
    apart = lambda k: all(s[k]) and not common[k]
    if apart("_ents"):
        return False
    either = s["_toks"][0] | s["_toks"][1]
    if either and len(common["_toks"]) / len(either) >= 0.5:
        return True
    if apart("_jur"):
        return False
    states = [x - set(cluster.UNIONS) for x in s["_jur"]]
    return (
        bool(common["_phrases"] or common["_rare"])
        or (not any(s["_ents"]) and states[0] == states[1] and len(states[0]) >= 2 and a["_stage"] == b["_stage"] is not None)
    )


def components_of(rows):
    root = {r["id"]: r["id"] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if linked(a, b):
                u, v = find(a["id"]), find(b["id"])
                root[max(u, v)] = min(u, v)
    case, out = {r["id"]: r["_case"] for r in rows}, {}
    for r in rows:
        members = [x for x in root if find(x) == find(r["id"])]
        several = len({case[x] for x in members if case[x]}) > 1
        out[r["id"]] = min(x for x in members if case[x] == case[r["id"]]) if several else min(members)
    return out


def test_graph_matches_brute_force(spark):
    rng = random.Random(11)
    names, verbs = [f"{x}{y}" for x in ("Halv", "Zent", "Korb", "Aur", "Dorn") for y in ("ar", "il", "ank")], [f"{x}{y}" for x in ("pla", "lic", "min", "tar", "por", "pip", "loa", "tow") for y in ("nt", "ca", "ro", "xu", "ko")]
    titles, more = [], {"event_type": [], "case_ref": [], "claimants": [], "states": []}
    for _ in range(120):
        places = rng.sample(list(LEX.forms), rng.choice([0, 0, 1, 1, 2]))
        words = [*rng.sample(verbs, rng.randint(1, 4)), *places, *rng.sample(names, rng.choice([0, 0, 1, 2]))]
        rng.shuffle(words)
        titles.append("Row " + " ".join(words))
        more["event_type"].append(rng.choice(["award_issued", "state_measure", None]))
        more["case_ref"].append(rng.choice([None] * 12 + ["ARB/1", "ARB/2"]))
        more["claimants"].append(rng.sample(names, 1) if rng.random() < 0.1 else [])
        more["states"].append(rng.sample(["Peru", "Iraq"], 1) if rng.random() < 0.1 else [])
    kinds = {"event_type": "string", "case_ref": "string", "claimants": "array<string>", "states": "array<string>"}
    data = [(i, t, *[v[i] for v in more.values()]) for i, t in enumerate(titles)]
    df = spark.createDataFrame(data, "id long, title string" + "".join(f", {k} {kinds[k]}" for k in more))
    wide = cluster.Lexicon(forms=LEX.forms, common=LEX.common)
    rows = [r.asDict() | {"_case": r["case_ref"]} for r in cluster.features(df, wide).collect()]
    want = components_of(rows)
    got = {r["id"]: r["story"] for r in cluster.graph(df, wide).collect()}
    assert got == want and 8 < len(set(want.values())) < 100


def test_a_vetoed_hub_hides_no_link(spark):
    """The smallest id under a phrase is kept apart from the others by its name; they still find each other."""
    titles = ["Board names Zentil in windfall row", "Windfall row deepens on Halvar", "New windfall row for Halvar and others", *(f"Grain note {i} on {w}" for i, w in enumerate(["rain", "snow", "wind", "hail", "frost"]))]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    got = {r["id"]: r["story"] for r in cluster.graph(df, LEX).collect()}
    assert got[1] == got[2] == 1 and got[0] == 0


def test_records_fill_gaps_and_places_grow(spark):
    also = "array<struct<source string, url string, title string>>"
    full = "The tribunal in the matter found for the company after years of hearings on the licence."
    rows = [
        (0, "Licence dispute of Halvar grows", "short", "fr", None, ["Halvar"], [], [("Le", "http://le", "l")]), (1, "Halvar licence dispute grows in court", None, "en", "X/1", [], ["Peru"], []),
        (2, "Halvar licence dispute grows for Peru", full, "en", None, ["Other"], ["Iraq"], []), (3, "Iraq: licence dispute with a lender grows over tariffs", None, "en", None, [], [], []), (4, "Peru: Halvar licence dispute grows", "x" * 400, "en", "X/2", [], [], []),
    ]
    df = spark.createDataFrame(rows, f"id long, title string, summary string, lang string, case_ref string, claimants array<string>, states array<string>, also {also}")
    df = df.withColumns({"source": F.concat(F.lit("s"), F.col("id").cast("string")), "url": F.concat(F.lit("u"), F.col("id").cast("string"))})
    told = cluster.fold(df, LEX, F.col("id"))
    got = {r["id"]: (r["story"], r["seat"], r["text_of"]) for r in told.collect()}
    # The English version tells; Iraq joins no story of Peru's; another case number is another story.
    assert got == {0: (1, 0, 2), 1: (1, None, 2), 2: (1, 1, 2), 3: (3, None, 3), 4: (4, None, 4)}
    row = {r["id"]: r for r in cluster.merged(df, told).collect()}[1]
    assert row["claimants"] == ["Halvar"] and row["states"] == ["Peru"] and row["case_ref"] == "X/1" and row["summary"] == full
    assert [x["url"] for x in row["also"]] == ["http://le", "u0", "u2"]


def test_topics(spark):
    rows = [("EU weighs windfall tax on oil firms",), ("Brussels windfall profit levy nears",), ("Czechia windfall tax stays",), ("Rain in Spain",), ("Prague windfall tax",)]
    df = spark.createDataFrame(rows, "t string").select(topics("t", LEX.forms, {"prague": "czechia"}).alias("x"))
    a, b, c, d, e = (set(r["x"]) for r in df.collect())
    assert a & b == {"windfall tax|eu"} and not a & c and not d and c == e == {"windfall tax|czechia"}


def test_copies_stay_and_the_best_is_cited(spark):
    also = "array<struct<source string, url string, title string>>"
    items = spark.createDataFrame(
        [(1, "A", "http://a", "x", [("Old", "http://old", "o")]), (2, "Reuters", "http://r", "y", [])], f"id long, source string, url string, title string, also {also}"
    )
    st = spark.createDataFrame([(1, 1), (2, 1)], "id long, story long")
    merged = cluster.merged(items, st)
    row = cluster.cite_best(merged, lambda s, u: outlet_rank(s, u, {1: ("reuters",)})).first()
    assert (row["source"], row["url"], row["title"]) == ("Reuters", "http://r", "y")
    assert {x["url"] for x in row["also"]} == {"http://a", "http://old"}


def test_sets_within_a_part_are_not_compared_and_no_link_between_parts_is_lost(spark):
    """One large part of near-equal sets makes no pairs; those with other parts, and of sets without a part, are all found."""
    import random

    draw = random.Random(5)
    base = [f"w{x}" for x in range(12)]
    sets = [(i, sorted({*draw.sample(base, 10), f"v{i}"}), 1) for i in range(300)]
    sets += [(300 + i, sorted({*draw.sample(base, 10), f"v{i}"}), draw.choice([2, 3, None])) for i in range(30)]
    df = spark.createDataFrame(sets, "id long, t array<string>, part long")
    alike = lambda a, b: len({*a} & {*b}) >= 0.5 * len({*a} | {*b})
    want = {(i, j) for i, s, p in sets for j, t, q in sets if i < j and (p is None or p != q) and alike(s, t)}
    got = [(r["a"], r["b"]) for r in link.jaccard_sets(df, 0.5, 50).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 5000


def test_phrases_deal_no_group_for_each_rare_name(spark, monkeypatch):
    """Items with many rare names and phrases meet once under each name, not under each phrase and name."""
    names = ["Quibra", "Zeltor", "Mavrin", "Doskal", "Perund", "Tolvey", "Wexmar", "Garsto"]
    title = lambda i: f"Claim by {' and '.join(names[(i + k) % 8] for k in range(4))} over pipeline tariff dispute number {i}"
    rows = [(i, title(i)) for i in range(4)] + [(100 + i, f"Unrelated harvest festival opens in village {i}") for i in range(60)]
    sizes, real = {}, cluster.written

    def counted(df, name):
        out = real(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(cluster, "written", counted)
    got = {r["id"]: r["story"] for r in cluster.graph(spark.createDataFrame(rows, "id long, title string"), cluster.Lexicon()).collect()}
    assert {got[i] for i in range(4)} == {0}
    assert sizes["dealt"] <= 2 * sizes["meetings"]
