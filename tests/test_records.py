import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import fixed
from skeinflow.operators.gazetteer import Gazetteer
from skeinflow.operators import records
from skeinflow.operators.records import DOCKETS, JUDGMENTS, OPINIONS, match

FORMS = {"Laos": "Laos", "Lao People's Republic": "Laos", "Türkiye": "Turkey", "Turkey": "Turkey", "Spain": "Spain", "Peru": "Peru"}
TODAY = dt.date(2026, 1, 1)


def phrase(t):
    return " " + re.sub(r"[\W_]+", " ", (t or "").lower()).strip() + " "


def fits(names, title, tight):
    t = title.lower()
    forms = lambda n: [f.lower() for f, c in FORMS.items() if c == FORMS[n]] + [f[:5].lower() for f, c in FORMS.items() if c == FORMS[n] and len(f) >= 5]
    company = any(n.lower() in t for n in names if len(n) > 3 and n not in FORMS)
    held = sum(n in FORMS and any(f in t for f in forms(n)) for n in names)
    return company or held >= 2 or (tight and held >= 1 and bool(re.search(fixed.SOVEREIGN, t)) and all(n in FORMS for n in names))


def brute(reports, records, band):
    out = {}
    for i, names, day in reports:
        names = [n for n in names or [] if n and phrase(n).strip()][:4]
        day = day or TODAY
        stands = lambda n, title: any(phrase(f) in phrase(title) for f in ([f for f, c in FORMS.items() if c == FORMS[n]] if n in FORMS else [n]))
        found = []
        for r, title, filed in records:
            if r is None or title is None or (filed and not dt.timedelta(-band.before) <= filed - day <= dt.timedelta(band.after)):
                continue
            tight = band.tight is not None and filed is not None and dt.timedelta(-band.tight) <= filed - day <= dt.timedelta(band.after)
            held = [k for k, n in enumerate(names[:3]) if stands(n, title)]
            if not held or not (band.one_by_one or len(held) == len(names[:3])) or not fits(names, title, tight):
                continue
            found.append((held[0] if band.one_by_one else 0, -filed.toordinal() if filed else 1 << 40, r))
        if found:
            out[i] = min(found)[2]
    return out


@pytest.mark.parametrize("band", [DOCKETS, OPINIONS, JUDGMENTS], ids=["dockets", "opinions", "judgments"])
@pytest.mark.parametrize("part_chars", [1 << 20, 15])
def test_as_brute_force(spark, band, part_chars):
    rnd = random.Random(band.before)
    companies = ["Acme Mining", "Orex", "Halvar Energy", "Nord", "B-G Holdings"]
    day = lambda: None if rnd.random() < 0.1 else dt.date(2025, 1, 1) + dt.timedelta(rnd.randrange(400))
    title = lambda: " v. ".join(rnd.choice(("Republic of ", "", "The ", "")) + n for n in rnd.sample([*FORMS, *companies, "Orexia"], 2)) + rnd.choice((" (award)", "", " Mining"))
    records = [(r, title(), day()) for r in range(500)] + [(None, "Orex v. Peru", None), (900, None, None), (901, "", None)]
    reports = [(i, rnd.sample([*FORMS, *companies, " ", "nobody"], rnd.randint(0, 4)), day()) for i in range(120)] + [(500, None, day()), (501, [None, "Orex"], day()), (502, ["Orex"], None)]
    a = spark.createDataFrame([(*r, "x") for r in reports], "id int, names array<string>, day date, row string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in records], "record int, title string, day date, id int").repartition(4)
    g = Gazetteer(spark.createDataFrame(list(FORMS.items()), "form string, name string"), part_chars)
    got = {r["id"]: r["record"] for r in match(a, b, g, band, F.lit(TODAY)).collect()}
    assert got and got == brute(reports, records, band)
    assert match(a.limit(0), b, g, band).count() == 0 and match(a, b.limit(0), g, band).count() == 0


def test_no_nested_loop_and_a_hot_name(spark):
    """Half of all records carry one name; reports that ask for it with another meet under the other."""
    records = [(r, f"Orex v. {'Halvar' if r % 1000 == 0 else 'Someone'} {r}", dt.date(2025, 6, 1)) for r in range(4000)]
    reports = [(i, ["Orex", "Halvar"], dt.date(2025, 6, 2)) for i in range(50)]
    a = spark.createDataFrame(reports, "id int, names array<string>, day date")
    b = spark.createDataFrame(records, "record int, title string, day date")
    g = Gazetteer(spark.createDataFrame(list(FORMS.items()), "form string, name string"))
    assert {r["record"] for r in match(a, b, g, DOCKETS).collect()} == {0}


def test_words_of_records_are_taken_apart_once_for_all_bands(spark, monkeypatch):
    made = []
    real = records.shared_path
    monkeypatch.setattr(records, "shared_path", lambda s, name: made.append(name) or real(s, name))
    reports = spark.createDataFrame([(1, ["Acme"], "2026-01-10")], "id long, names array<string>, d string").select("id", "names", F.to_date("d").alias("day"))
    entries = spark.createDataFrame([(5, "Acme v Iraq", "2026-01-05"), (6, "Acme v Iran", "2024-01-05")], "record long, title string, d string").select("record", "title", F.to_date("d").alias("day"))
    g = Gazetteer(spark.createDataFrame([("Iraq", "Iraq")], "form string, name string"))
    found = records.match_each(reports, entries, g, {"docket": records.DOCKETS, "opinion": records.OPINIONS, "judgment": records.JUDGMENTS})
    assert {k: [tuple(r) for r in df.collect()] for k, df in found.items()} == {k: [(1, 5)] for k in ("docket", "opinion", "judgment")}
    assert made.count("case-words") == 1 and made.count("matched") == 3
