import random

import pytest
from test_cluster import LEX, components_of, linked

from skeinflow.operators import cluster
from skeinflow.operators.graph import shared_path
from skeinflow.operators.known import StoryIndex, background

KINDS = {"event_type": "string", "case_ref": "string", "claimants": "array<string>", "states": "array<string>"}
WIDE = cluster.Lexicon(forms=LEX.forms, common=LEX.common)


def pool(spark, n, seed):
    rng = random.Random(seed)
    names = [f"{x}{y}" for x in ("Halv", "Zent", "Korb", "Aur", "Dorn") for y in ("ar", "il", "ank")]
    verbs = [f"{x}{y}" for x in ("pla", "lic", "min", "tar", "por", "pip", "loa", "tow") for y in ("nt", "ca", "ro", "xu", "ko")]
    rows = []
    for i in range(n):
        words = [*rng.sample(verbs, rng.randint(1, 4)), *rng.sample(list(LEX.forms), rng.choice([0, 0, 1, 1, 2])), *rng.sample(names, rng.choice([0, 0, 1, 2]))]
        rng.shuffle(words)
        title = rng.choice([None, ""]) if rng.random() < 0.03 else "Row " + " ".join(words)
        rows.append((
            i, title, rng.choice(["award_issued", "state_measure", None]), rng.choice([None] * 12 + ["ARB/1", "ARB/2"]),
            rng.sample(names, 1) if rng.random() < 0.1 else [], rng.sample(["Peru", "Iraq"], 1) if rng.random() < 0.1 else [],
        ))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, title string" + "".join(f", {k} {v}" for k, v in KINDS.items())), [r[0] for r in rows]


@pytest.mark.parametrize("days", [1, 4])
def test_day_by_day_is_all_at_once(spark, days):
    df, order = pool(spark, 100, 21)
    common, words = background(df)
    index = StoryIndex.create(spark, shared_path(spark, "index"), WIDE, common, words)
    rows = [r.asDict() | {"_case": r["case_ref"]} for r in cluster.features(df, WIDE, common=common).collect()]
    by_id, earlier = {r["id"]: r for r in rows}, set()
    for day in range(days):
        ids = order[day::days]
        got = {r["id"]: r["known"] for r in index.add(df.where(df["id"].isin(ids))).collect()}
        # Known: a chain of links, through items of this day or straight, that ends at an item of before.
        near, want = {i: {j for j in [*earlier, *ids] if j != i and alike(by_id[i], by_id[j])} for i in ids}, {}
        for i in ids:
            seen, todo = {i}, [i]
            while todo:
                for j in near.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo += [j] if j not in earlier else []
            want[i] = bool(seen & earlier)
        assert got == want
        earlier |= set(ids)
    assert index.batches() == days
    same = {r["id"]: r["story"] for r in index.stories().collect()}
    assert same == components_of_all(rows)
    again = index.add(df.where("id < 5"))
    assert {r["id"]: r["known"] for r in again.collect()} == dict.fromkeys(range(5), True)
    assert {r["id"]: r["story"] for r in index.stories().collect()} == same


TOLD = ("_toks", "_names", "_ents", "_rare", "_phrases", "_jur", "_parties", "_states")


def alike(a, b):
    """Linked by the rules, or the same in all features."""
    kind = lambda r: ([sorted(r[k] or []) for k in TOLD], r["_stage"], r["_case"])
    return linked(a, b) or kind(a) == kind(b)


def components_of_all(rows):
    """components_of, where items that are the same in all features are one."""
    kinds = {}
    for r in rows:
        kinds.setdefault(repr(([sorted(r[k] or []) for k in TOLD], r["_stage"], r["_case"])), []).append(r)
    firsts = [min(v, key=lambda r: r["id"]) for v in kinds.values()]
    story = components_of(firsts)
    return {r["id"]: story[f["id"]] for f in firsts for r in kinds[repr(([sorted(f[k] or []) for k in TOLD], f["_stage"], f["_case"]))]}


def test_more_items_than_a_fold_takes(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(3000)]
    rows = [(i, " ".join(rng.sample(words, 6))) for i in range(6000)]
    rows += [(10_000 + i, rows[i][1] + " " + rng.choice(words)) for i in range(0, 6000, 40)]
    df = spark.createDataFrame(rows, "id long, title string").repartition(4)
    index = StoryIndex.create(spark, shared_path(spark, "index"), WIDE, *background(df))
    index.add(df.where("id < 10000"))
    got = {r["id"]: r["known"] for r in index.add(df.where("id >= 10000")).collect()}
    assert len(got) == 150 and all(got.values())


def test_a_broken_off_batch_is_not_read(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Halvar licence row deepens"), (2, "Halvar licence row deepens again"), (3, "Grain prices fall")], "id long, title string")
    index = StoryIndex.create(spark, shared_path(spark, "index"), WIDE, *background(df))
    index.add(df.where("id = 1"))

    def fail(part, batch, rows, write=index._write):
        if part == "items":
            raise RuntimeError("lost")
        return write(part, batch, rows)

    monkeypatch.setattr(index, "_write", fail)
    with pytest.raises(RuntimeError):
        index.add(df.where("id = 3"))
    monkeypatch.undo()
    assert index.batches() == 1 and {r["id"] for r in index.stories().collect()} == {1}
    assert {r["id"]: r["known"] for r in index.add(df.where("id > 1")).collect()} == {2: True, 3: False}
    assert {r["id"]: r["story"] for r in index.stories().collect()} == {1: 1, 2: 1, 3: 3}
    assert index.add(df.limit(0)).count() == 0
