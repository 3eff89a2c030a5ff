"""Quality: a linear-chain conditional random field over the lines of a document.

Each line has a vector of shares and flags (symbols, capitals, bars, word
lengths, repetition ...) and its neighbours' vectors. The chain's two states are
good and bad; forward-backward gives each line's marginal, and their mean,
weighted by the lines' lengths, with the worst line and the share of bad lines, is
put through a logistic curve fitted to document labels.

Only documents are labelled, so lines of good documents count as good, and which
lines of bad ones are bad is refined: first by a chain without transitions on all
lines, then by the chain's own marginals. The fit runs in one task, on at most
about ``MAX_ROWS`` labelled documents (hash below the bound over the labelled
rows), cut into runs of ``RUN`` lines. Any text is scored whole.

Nulls: a null or empty text has no lines and the score of a document whose lines
are neither (mean 0.5). Rows without label or doc_id are not learned from;
without any labelled row, or with one class only, every score is the share of
good labels (0.5 if there are none). Repeated rows are learned from and scored
each; an empty table gives an empty result. Of lines that are equally bad the first
is the worst. A very long text is scored whole, its lines in blocks that advance together. Labels, lang, source and doc_id are no features; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import GRAPHIC, buffers, slices, word_hashes, words

MAX_ROWS = 4_000
RUN = 40
STRIDE = 512
STEPS = 150

_KIND = np.zeros((256, 7))
_KIND[97:123, 0] = _KIND[128:, 0] = 1  # lower case and beyond ASCII
_KIND[65:91, 1] = 1  # capitals
_KIND[48:58, 2] = 1  # digits
_KIND[[ord(c) for c in ".,;:'\"?-()"], 3] = 1  # marks of prose
_KIND[[ord(c) for c in "*#$%&@^~+=<>{}[]\\_/`"], 4] = 1  # symbols
_KIND[ord("|"), 5] = _KIND[ord("!"), 6] = 1
NAMES = 15


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that aren't empty: the vectors, the lengths, and each text's first line (one more at the end)."""
    data, offsets = buffers(column)
    n = len(data)
    if not n:
        return np.zeros((0, NAMES)), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    feed = data == 10
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = ~feed & (np.concatenate(([True], feed[:-1])) | edge[:n])
    closes = ~feed & (np.concatenate((feed[1:], [True])) | edge[1:])
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((0, NAMES)), np.zeros(0, np.int64), first
    size = ends - starts

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return total[ends] - total[starts]

    kinds = np.stack([count(_KIND[:, j].astype(bool)[data]) for j in range(7)], 1)
    word_starts, word_ends, _ = words(data, offsets, GRAPHIC)
    word = word_hashes(data, word_starts, word_ends)
    home = np.searchsorted(starts, word_starts, "right") - 1
    word_count = np.maximum(np.bincount(home, minlength=len(size)), 1)
    again = np.zeros(len(word), bool)
    for gap in (1, 2):
        if len(word) > gap:
            again[gap:] |= (word[gap:] == word[:-gap]) & (home[gap:] == home[:-gap])
    again = np.bincount(home, again, len(size)) / word_count
    hashes = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    keys = hashes ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    share = kinds / size[:, None]
    out = np.empty((len(size), NAMES))
    out[:, :7] = np.minimum(share * [1, 1, 4, 4, 4, 8, 8], 1)
    out[:, 7] = np.minimum(size / word_count / 16, 1)
    out[:, 8] = np.minimum(np.log1p(size) / 8, 1)
    out[:, 9] = np.minimum(again * 2, 1)
    out[:, 10] = times[back] > 1
    out[:, 11] = share[:, 4] > 0.03
    out[:, 12] = share[:, 1] > 0.4
    out[:, 13] = share[:, 5] > 0.01
    out[:, 14] = again > 0.2
    return out, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own, previous and next line's vectors and a constant; zeros beyond a text's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    starts, ends = first[:-1][first[:-1] < first[1:]], first[1:][first[:-1] < first[1:]]
    before[starts] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))])


def _advance(emit: np.ndarray, first: np.ndarray, switch: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """Each line's log weights of the two states, from its piece's first line on; all pieces advance together, one line a step."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts = first[:-1][order]
    live = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")  # pieces with more than t lines
    out = np.zeros((len(emit), 2))
    for t, m in enumerate(live):
        at = starts[:m] + t
        out[at] = emit[at] + (opening[order[:m]] if t == 0 else _log_sum(out[at - 1][:, :, None] + switch, 1))
    return out


def _forward(emit: np.ndarray, first: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Each line's log weights of the two states, from its text's first line on.

    Texts are cut into pieces of ``STRIDE`` lines. What a piece does to either
    state is found for all pieces at once and then chained along each text, so a
    text of n lines takes about 2 * STRIDE + n / STRIDE steps.
    """
    counts = -(-np.diff(first) // STRIDE)
    head = np.cumsum(counts) - counts  # each text's first piece
    nth = np.arange(counts.sum()) - np.repeat(head, counts)
    cuts = np.append(np.repeat(first[:-1], counts) + nth * STRIDE, first[-1])
    opening = np.zeros((len(nth), 2))
    most = counts.max(initial=0)
    if most > 1:
        full = np.flatnonzero(nth + 1 < np.repeat(counts, counts))  # pieces that others follow
        lines = (cuts[full][:, None] + np.arange(STRIDE)).ravel()
        own = np.arange(len(full) + 1) * STRIDE
        through = np.zeros((len(nth), 2, 2))
        for state in (0, 1):
            only = np.full((len(full), 2), -np.inf)
            only[:, state] = 0
            through[full, state] = _advance(emit[lines], own, switch, only)[own[1:] - 1]
        for k in range(1, most):
            at = head[counts > k] + k
            ends = _log_sum(opening[at - 1][:, :, None] + through[at - 1], 1)
            opening[at] = _log_sum(ends[:, :, None] + switch, 1)
    return _advance(emit, cuts, switch, opening)


def marginals(scores: np.ndarray, first: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of bad lines, expected transitions (2 x 2), and the sum of log partition functions.

    scores: each line's log-odds of bad.
    """
    emit = np.stack([np.zeros(len(scores)), scores], 1)
    forward = _forward(emit, first, switch)
    backward = _forward(emit[::-1], first[-1] - first[::-1], switch.T)[::-1]  # with the line's own weight
    some = first[:-1] < first[1:]
    whole = np.zeros(len(first) - 1)
    whole[some] = _log_sum(forward[first[1:][some] - 1], 1)
    text = np.repeat(np.arange(len(whole)), np.diff(first))
    bad = np.exp(forward[:, 1] + backward[:, 1] - emit[:, 1] - whole[text])
    inner = np.ones(len(scores), bool)
    inner[first[:-1][first[:-1] < len(scores)]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(forward[at - 1][:, :, None] + switch + backward[at][:, None, :] - whole[text[at]][:, None, None]).sum(0) if len(at) else np.zeros((2, 2))
    return bad, pairs, float(whole.sum())


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    a, b = np.moveaxis(x, axis, 0)
    return np.logaddexp(a, b)


def fit_chain(x: np.ndarray, first: np.ndarray, bad: np.ndarray, chain: bool = True, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the likelihood of (soft) labels ``bad``, by Adam, with a little L2."""
    w, switch = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[first[:-1][first[:-1] < len(x)]] = False
    at = np.flatnonzero(inner)
    soft = np.stack([1 - bad, bad], 1)
    seen = soft[at - 1].T @ soft[at]
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, steps + 1):
        if chain:
            p, pairs, _ = marginals(x @ w, first, switch)
        else:
            p, pairs = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35))), seen
        g = np.concatenate([x.T @ (p - bad) / len(x) + 1e-4 * w, ((pairs - seen) / len(x) + 1e-4 * switch).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, switch = w - move[:-4], switch - move[-4:].reshape(2, 2)
    return w, switch


def document_features(bad: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text: length-weighted mean of the lines' probabilities of bad, the largest, the weighted share above a half, and 1."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    weight = np.bincount(text, size, n)
    some = weight > 0
    out = np.full((n, 4), 0.5)
    out[some, 0] = (np.bincount(text, size * bad, n) / np.maximum(weight, 1))[some]
    worst = np.zeros(n)
    np.maximum.at(worst, text, bad)
    out[some, 1] = worst[some]
    out[some, 2] = (np.bincount(text, size * (bad > 0.5), n) / np.maximum(weight, 1))[some]
    out[:, 3] = 1
    return out


def fit_model(x: np.ndarray, size: np.ndarray, first: np.ndarray, good: np.ndarray) -> dict:
    """From the lines and document labels: weights, transitions, and the curve over document features."""
    if not len(good) or good.min() == good.max():
        return {"share": float(good.mean()) if len(good) else 0.5}
    full = with_neighbours(x, first)
    poor = np.repeat(1 - good, np.diff(first)).astype(float)
    cuts = np.unique(np.concatenate([np.arange(a, max(b, a + 1), RUN) for a, b in zip(first[:-1], first[1:])] + [first[-1:]]))
    cuts = cuts[cuts <= len(x)]
    w, switch = fit_chain(full, cuts, poor, chain=False)
    guess = 1 / (1 + np.exp(-np.clip(full @ w, -35, 35)))
    for _ in range(2):
        w, switch = fit_chain(full, cuts, poor * (guess > 0.5))
        guess = marginals(full @ w, cuts, switch)[0]
    d = document_features(marginals(full @ w, first, switch)[0], size, first)
    curve = np.zeros(d.shape[1])
    for _ in range(30):  # Newton's steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(d @ curve, -35, 35)))
        h = d.T @ (d * (p * (1 - p))[:, None]) + 1e-1 * np.eye(len(curve))
        curve -= np.linalg.solve(h, d.T @ (p - good) + 1e-1 * curve)
    return {"w": w.tolist(), "switch": switch.ravel().tolist(), "curve": curve.tolist()}


def apply_model(model: dict, column: pa.Array) -> np.ndarray:
    x, size, first = line_features(column)
    if "share" in model:
        return np.full(len(first) - 1, model["share"])
    bad = marginals(with_neighbours(x, first) @ np.array(model["w"]), first, np.array(model["switch"]).reshape(2, 2))[0]
    return 1 / (1 + np.exp(-np.clip(document_features(bad, size, first) @ np.array(model["curve"]), -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, learned: Column, label: str = "quality", max_rows: int = MAX_ROWS) -> dict:
    """The model, from rows of ``labels`` where ``learned`` holds."""
    marked = labels.where(learned & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, marked.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = docs.select("doc_id", "text").join(marked.where(draw < share), "doc_id").select("doc_id", "text", "label")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, sizes, firsts, good, n = [np.zeros((0, NAMES))], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0)], 0
        for part in slices(batches):
            x, size, first = line_features(part.column("text"))
            xs.append(x)
            sizes.append(size)
            firsts.append(first[1:] + n)
            good.append(part.column("label").to_numpy(zero_copy_only=False).astype(float))
            n += len(x)
        model = fit_model(np.concatenate(xs), np.concatenate(sizes), np.concatenate(firsts), np.concatenate(good))
        yield pa.RecordBatch.from_arrays([pa.array(list(model)), pa.array([np.atleast_1d(v).tolist() for v in model.values()], pa.list_(pa.float64()))], names=["name", "values"])

    rows = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text", "label").mapInArrow(train, "name string, values array<double>").collect()
    found = {r["name"]: list(r["values"]) for r in rows} or {"share": [0.5]}
    return {k: v[0] if k == "share" else v for k, v in found.items()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(apply_model(model, part.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
