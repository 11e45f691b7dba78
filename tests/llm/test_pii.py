import hashlib
import re

from skeinflow.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return True


def brute(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}
    joined = ",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)
    return (*map(len, found.values()), hashlib.sha256(joined.encode()).hexdigest())


TEXTS = [
    "a@b.c_d@e.f", "a@b.c@d.e.g x", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.2.3", "+1 (234) 555-1234+44 123456789 ", "4111 1111-1111 1111 4111111111111111 5",
    "", None, "𝒳 a.b@c.de 😀 1.2.3.4 é@x.y", "john [at] x.org (212) 555-1234 call 212 555 1234", "9" * 30_000, "a" * 30_000, "1." * 5_000, "+1" * 5_000,
    "a@b.c " * 700, "4111111111111111 " * 300, "4111-1111-1111-1111-5 378282246310005", "x@y", "1.2.3", "+12345678", " 4111111111111111 ", "id 4111111111111112",
]


def test_base_spans_match_the_definition(docs):
    rows = P.detect(docs(TEXTS)).select("doc_id", *P.counts("base"), P.F.sha2(P._joined("base"), 256), P._joined("base").alias("b"), P._joined("spans").alias("s")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert tuple(r)[1:6] == brute(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_planted_spans_without_a_base_form(docs):
    """Numbers and addresses in the form of known ones are found, those of another form or context are left, and so are cards that fail."""
    number = lambda i: f"(2{i % 90 + 10}) 555-{i * 37 % 9000 + 1000}"
    texts, planted, clean = [], {}, set()
    for i in range(400):
        texts.append(f"Please call +1 {number(i)} on any day, or write to user{i}@host{i % 9}.org then.")
    for i in range(400, 440):
        planted[len(texts)] = f"phone:12:{12 + len(number(i))}"
        texts.append(f"Please call {number(i)} on any day but Sunday.")
    for i in range(440, 540):
        clean.add(len(texts))
        texts.append(f"Order part no. {i}-{i * 7 % 900 + 100}-{i * 13 % 9000 + 1000} from stock.")
    for i in range(540, 640):
        clean.add(len(texts))
        texts.append(f"paid by card 4{i:014d}{(int(next(d for d in '0123456789' if valid('card', f'4{i:014d}' + d))) + 1) % 10} so far")
    for i in range(640, 900):
        texts.append(f"write to user{i} [at] host{i % 9} [dot] org for more")
    for i in range(900, 910):
        planted[len(texts)] = f"email:9:{9 + len(f'user{i} [at] own{i % 9} [dot] org')}"
        texts.append(f"write to user{i} [at] own{i % 9} [dot] org for more")
    got = {r["doc_id"]: r["s"] for r in P.detect(docs(texts)).select("doc_id", P._joined("spans").alias("s")).collect()}
    hit = sum(got[i] == s for i, s in planted.items())
    wrong = [got[i] for i in clean if got[i]]
    assert hit >= 0.95 * len(planted) and not wrong, (hit, len(planted), wrong[:3])
    assert got[0] == f"email:{texts[0].index('user0')}:{texts[0].index(' then')},phone:12:{12 + len('+1 ' + number(0))}"  # nothing is added within a base span
    assert got[700].startswith("email:9:")


def test_too_few_candidates_add_nothing(docs):
    texts = [f"call +1 (212) 555-{i:04d} now" for i in range(30)] + ["call (212) 555-9999 now"]
    assert [r["s"] for r in P.detect(docs(texts)).where("doc_id = 30").select(P._joined("spans").alias("s")).collect()] == [""]
    assert P.detect(docs(texts), least=1).where("doc_id = 30 AND size(spans) = 1").count() == 1


def test_secrets_are_counted(docs):
    texts = ['token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" of', "password: hunter2hunter2hunter2", "token of the day", "API_KEY=abcdefghijklmnopqrstuvwxyz", None]
    assert [r["n_secret"] for r in P.detect(docs(texts)).orderBy("doc_id").collect()] == [1, 1, 0, 0, 0]


def test_redaction_and_edges(docs):
    out = {r["doc_id"]: r["text"] for r in P.redact(docs(["mail a@b.co or +1 (234) 555-1234.", None, "é 1.2.3.4"])).collect()}
    assert out == {0: "mail <email> or <phone>.", 1: "", 2: "é <ip>"}
    assert P.detect(docs([])).count() == 0
    assert P.detect(docs([(1, "a@b.c"), (1, "a@b.c")])).count() == 2


def test_boosting_and_calibration():
    cell = lambda g, d: (g, d, 0, 0, 0, 0)
    counts = {cell(g, d): (90.0, 10.0) if d < 4 else (1.0, 199.0) for g in range(6) for d in range(8)}
    trees = P.boost(counts)
    score = lambda c: sum(P._value(t, c) for t in trees)
    assert score(cell(0, 7)) > 2 > -1 > score(cell(0, 1))
    bounds = P.thresholds(trees, counts, 0.99, 20)
    assert bounds[:4] == [float("inf")] * 4  # a failed check outweighs what is likely otherwise
    assert all(score(cell(g, 1)) < bounds[g] <= score(cell(g, 7)) for g in (4, 5))
    assert P.thresholds(trees, counts, 0.99, 10_000) == [float("inf")] * 6 and P.thresholds([], {}, 0.99, 1) == [float("inf")] * 6


def test_isotonic():
    assert P.isotonic([(0, 8, 2), (1, 5, 5), (2, 7, 3), (3, 0, 0), (4, 1, 9)]) == [(0, 10, 0.2), (1, 20, 0.4), (4, 10, 0.9)]
    assert P.isotonic([]) == []
