"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. Its features are rates of letter
cases, symbols, digits and repeated words, its length, and the same rates of
the lines before and after. Labels are of documents: in training all lines of
a document carry its label. Forward-backward gives each line's probability of
being good; weighted by line length they average into the document's share of
good text, which a logistic curve fitted on the training documents turns into
the score.

The field is fitted on the driver from a bounded sample: at most
`sample_rows` labelled documents (by hash of doc_id) and `sample_lines` lines.
Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.llm.common import slices

NAMES = ("upper", "symbols", "bars", "digits", "stops", "repeats", "word", "blanks", "open", "short")
ROOTS = (1, 2, 5)  # rates whose square root is a feature as well
NEAR = (0, 1, 2, 5)  # rates that a line shares with its neighbours
WIDTH = 2 + len(NAMES) + len(ROOTS) + 2 * (len(NEAR) + 1)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_SYMBOL = _table(b"#$%&*!|~^=<>@+{}[]\\/_")
_BAR = _table(b"|")
_DIGIT = _table(b"0123456789")
_STOP = _table(b".,;:?")
_SPACE = _table(b" \t\r\x0b\x0c\n")
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


#: Bytes of texts whose lines are measured at one time; a longer line is measured alone.
WINDOW = 1 << 20


def _pieces(raws: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
    """The texts in groups of about WINDOW bytes, long ones cut at ends of lines, and which text each piece is of."""
    group, owners, held = [], [], 0
    for i, raw in enumerate(raws):
        at = 0
        while True:
            end = len(raw) if len(raw) - at <= WINDOW else raw.find(b"\n", at + WINDOW)
            end = len(raw) if end < 0 else end
            group.append(raw[at:end] if at or end < len(raw) else raw)
            owners.append(i)
            held += end - at + 1
            if held >= WINDOW:
                yield group, owners
                group, owners, held = [], [], 0
            if end == len(raw):
                break
            at = end + 1
    if group:
        yield group, owners


def _measured(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rates, bytes, text) of the lines of some texts that are not blank."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1  # with the line's end
    text_end = np.cumsum([len(r) + 1 for r in raws]) - 1
    text_of = np.searchsorted(text_end, ends)

    def per_line(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[data], starts, dtype=np.float64)

    space = _SPACE[data] > 0
    first = ~space & np.concatenate([[True], space[:-1]])
    at = np.flatnonzero(first)
    words = np.add.reduceat(first.astype(np.int64), starts)
    if at.size:
        stop = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        n = stop - at
        inside = np.flatnonzero(~space)
        place = np.arange(inside.size) - np.repeat(np.cumsum(n) - n, n)
        hashed = np.add.reduceat(_BYTE[data[inside]] * _PLACE[place & 63], np.cumsum(n) - n)
        line = np.searchsorted(ends, at)
        again = np.zeros(at.size, bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (n[1:] == n[:-1]) & (line[1:] == line[:-1])
        repeats = np.bincount(line, again, ends.size)
    else:
        repeats = np.zeros(ends.size)
    some = words > 0
    blanks = per_line(_SPACE) - 1
    chars = np.maximum(size - 1 - blanks, 1)
    upper, lower = per_line(_UPPER), per_line(_LOWER)
    w = np.maximum(words, 1)
    rates = np.stack(
        [
            upper / np.maximum(upper + lower, 1), per_line(_SYMBOL) / chars, per_line(_BAR) / w, per_line(_DIGIT) / chars,
            per_line(_STOP) / w, repeats / w, chars / w / 10, blanks / np.maximum(size - 1, 1),
            (~np.isin(data[np.maximum(ends - 1, 0)], list(b".!?"))).astype(float), (words < 4).astype(float),
        ],
        1,
    )[some]
    return rates, (size - 1)[some], text_of[some]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes of each line, lines of each text). Blank lines don't count. What is held at one time is
    the texts, some arrays of a window's size, and the features of all lines."""
    if not len(texts):
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    for group, owners in _pieces([t.encode("utf-8", "surrogatepass") for t in texts]):
        rates, size, piece = _measured(group)
        parts.append((rates, size, np.array(owners)[piece]))
    rates, size, text_of = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    lines = np.bincount(text_of, minlength=len(texts))
    x = np.zeros((len(rates), WIDTH), np.float32)
    for at in range(0, len(rates), 1 << 15):
        here = slice(at, at + (1 << 15))
        own = np.arange(at, min(at + (1 << 15), len(rates)))

        def near(step: int, own=own) -> np.ndarray:
            """The neighbouring lines' rates, and whether there is such a line in the text."""
            k = own + step
            there = (k >= 0) & (k < len(rates))
            k = np.clip(k, 0, len(rates) - 1)
            there &= text_of[k] == text_of[own]
            return np.concatenate([rates[k][:, NEAR], np.ones((len(k), 1))], 1) * there[:, None]

        x[here] = np.concatenate([np.ones((len(own), 1)), np.log1p(size[here])[:, None] / 5, rates[here], np.sqrt(rates[here][:, ROOTS]), near(-1), near(1)], 1)
    return x, size, lines


@dataclass(frozen=True)
class Field:
    """Weights of a line's features for good against bad, log-potentials of neighbouring states, and the score's curve."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float
    offset: float
    prior: float


def _marginals(e: np.ndarray, lines: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once. e: log-potential of good for each line, chains one after
    another. Returns P(good) by line, expected neighbouring pairs (2 x 2), and log Z by chain."""
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    first, n = first[order], lines[order]
    steps = int(n[0]) if n.size else 0
    active = [int(np.searchsorted(-n, -t, side="left")) for t in range(steps)]  # chains with more than t lines
    fwd = np.zeros((e.size, 2))
    bwd = np.zeros((e.size, 2))
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            prev = fwd[at - 1]
            fwd[at] = np.logaddexp(prev[:, :1] + pair[0], prev[:, 1:] + pair[1])
        fwd[at, 1] += e[at]
    expected = np.zeros((2, 2))
    z = np.zeros(lines.size)
    has = n > 0
    last = first + n - 1
    z[order[has]] = np.logaddexp(fwd[last[has], 0], fwd[last[has], 1])
    own = np.zeros(lines.size)
    own[: n.size] = z[order]
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        to = bwd[at + 1].copy()
        to[:, 1] += e[at + 1]
        joint = fwd[at][:, :, None] + pair[None] + to[:, None, :]
        expected += np.exp(joint - own[:k, None, None]).sum(0)
        bwd[at] = np.logaddexp(pair[:, 0] + to[:, :1], pair[:, 1] + to[:, 1:])
    total = fwd + bwd
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), expected, z


def _share(p: np.ndarray, size: np.ndarray, lines: np.ndarray, prior: float) -> np.ndarray:
    text = np.repeat(np.arange(lines.size), lines)
    length = np.bincount(text, size, lines.size)
    good = np.bincount(text, size * p, lines.size)
    return np.where(length > 0, good / np.maximum(length, 1), prior)


def _sampled(rows: Iterable[tuple[str, int]], sample_lines: int, part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, line sizes, lines and label of texts in order, up to sample_lines lines in all; about `part`
    characters of text are held at a time."""
    xs, sizes, counts, good = [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    texts, held, total = [], 0, 0

    def flush() -> None:
        nonlocal texts, held, total
        x, size, lines = line_features(texts)
        use = int(np.searchsorted(total + np.cumsum(lines), sample_lines, side="right"))
        at = int(lines[:use].sum())
        xs.append(x[:at].copy())
        sizes.append(size[:at].copy())
        counts.append(lines[:use])
        total += int(lines.sum())
        texts, held = [], 0

    for text, label in rows:
        texts.append(text)
        good.append(label)
        held += len(text)
        if held >= part:
            flush()
            if total > sample_lines:
                break
    if texts:
        flush()
    lines = np.concatenate(counts)
    return np.concatenate(xs).astype(float), np.concatenate(sizes), lines, np.array(good[: lines.size], float)


def fit(texts: Iterable[str], good: Iterable[int], sample_lines: int = 200_000, rounds: int = 150, longest: int = 200) -> Field:
    """The field from texts and labels. Texts beyond sample_lines lines in all are left out; in training a
    text's chain is cut after each `longest` lines."""
    return fit_rows(zip(texts, good, strict=True), sample_lines, rounds, longest)


def fit_rows(rows: Iterable[tuple[str, int]], sample_lines: int = 200_000, rounds: int = 150, longest: int = 200) -> Field:
    x, size, lines, good = _sampled(rows, sample_lines)
    prior = (good.sum() + 1) / (good.size + 2) if good.size else 0.5
    pair = np.zeros((2, 2))
    theta = np.zeros(WIDTH + 4)
    y = np.repeat(good, lines)
    chains = np.array([min(longest, n - k) for n in lines.tolist() for k in range(0, n, longest)], np.int64)
    label = np.repeat(good, [-(-n // longest) for n in lines.tolist()])
    seen = np.zeros((2, 2))
    seen[1, 1], seen[0, 0] = ((chains - 1) * label).sum(), ((chains - 1) * (1 - label)).sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = 1 / max(1, y.size)
    for k in range(1, rounds + 1 if y.size else 1):
        p, expected, _ = _marginals(x @ theta[:WIDTH], chains, theta[WIDTH:].reshape(2, 2))
        grad = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) * weight - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    pair = theta[WIDTH:].reshape(2, 2)
    share = _share(_marginals(x @ theta[:WIDTH], lines, pair)[0], size, lines, prior)
    slope, offset = 1.0, 0.0
    s = share - 0.5
    for _ in range(50 if good.size else 0):  # Newton's method, with a weak pull to slope 6
        q = 1 / (1 + np.exp(-(slope * s + offset)))
        g = np.array([((good - q) * s).sum() - 0.1 * (slope - 6), (good - q).sum() - 0.01 * offset])
        w = q * (1 - q)
        h = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.01]])
        slope, offset = np.array([slope, offset]) + np.clip(np.linalg.solve(h, g), -2, 2)
    return Field(theta[:WIDTH], pair, float(max(slope, 0.0)), float(offset), float(prior))


def scores(texts: list[str], field: Field) -> np.ndarray:
    x, size, lines = line_features(texts)
    e = np.concatenate([x[at : at + (1 << 16)].astype(float) @ field.weights for at in range(0, max(len(x), 1), 1 << 16)])
    del x
    share = _share(_marginals(e, lines, field.pair)[0], size, lines, field.prior)
    return np.where(lines > 0, 1 / (1 + np.exp(-(field.slope * (share - 0.5) + field.offset))), field.prior)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_lines: int = 200_000) -> Field:
    """Fits on labelled documents that are not held out: at most sample_rows of them, by hash of doc_id."""
    chosen = (
        labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    # sample_rows rows at most, so the broadcast is bounded.
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Texts come one by one and leave as features; whole texts don't gather on the driver.
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "quality")
    return fit_rows(((r["text"], r["quality"]) for r in ordered.toLocalIterator()), sample_lines)


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of each row. Null, empty and blank texts get the share of good training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(texts, field))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is `least` or more, with all their columns; nothing is shuffled."""
    field = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                yield b.filter(pa.array(scores([t or "" for t in b.column(at).to_pylist()], field) >= least))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
