"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrail.llm.common import fit_in_task, slices

#: Bound of the fitting sample, in documents, taken by the hash of their ids.
SAMPLE = 4000
#: Fitting chains are cut after so many lines; scoring always runs over the whole chain.
CHAIN = 32
#: Bound of the fitting sample, in chains of a document, taken by the hash of id and place.
CHAINS = 8
#: Lines that are described, and cells of padded chains that are scored, at a time.
PIECE = 4096
CELLS = 1 << 16
STEPS = 300
RATE = 0.05
PENALTY = 1e-3
#: Documents that score at least this are predicted good.
CUTOFF = 0.3

_KIND = np.full(256, 8, np.uint8)  # bytes of other than ASCII characters
_KIND[:128] = 7
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, *range(9, 14)]] = 3
_KIND[[ord(c) for c in "#*$%&|<>"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
KINDS = 9
FEATURES = 1 + KINDS + 11


def _described(rows: list[tuple], lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of ``lines``, from their characters' kinds and the ``rows`` of other numbers."""
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    share = np.zeros((len(lines), KINDS))
    ends = np.flatnonzero(data == 10)
    for at in range(0, len(data), 1 << 20):
        b = data[at : at + (1 << 20)]
        line = np.searchsorted(ends, np.arange(at, at + len(b)))
        first, last = int(line[0]), int(line[-1])
        share[first : last + 1] += np.bincount((line - first) * KINDS + _KIND[b], minlength=(last - first + 1) * KINDS).reshape(-1, KINDS)
    out = np.ones((len(rows), FEATURES), np.float32)
    out[:, 1 : 1 + KINDS] = share / share.sum(1, keepdims=True)
    out[:, 1 + KINDS :] = np.array(rows, np.float32)
    return out, np.array([len(x) - x.endswith("\n") for x in lines], np.float64)


def line_pieces(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of every line with a word, and the lines' weights (characters), PIECE lines at a time.

    Lines are found one after the other, so beside the text and its distinct words and lines
    only a piece is held. Texts without a word have one line without features.
    """
    seen: set[str] = set()
    earlier: set[str] = set()
    rows: list[tuple] = []
    kept: list[str] = []

    start, some = 0, False
    while start <= len(text):
        end = text.find("\n", start)
        more = end >= 0
        line = text[start : end if more else len(text)]
        start = end + 1 if more else len(text) + 1
        words = line.split()
        if words:
            key = line.strip()
            distinct = set(words)
            triples = len(words) - 2
            rows.append(
                (
                    np.log1p(len(words)) / 5,
                    np.log1p(len(line)) / 7,
                    len(line) / len(words) / 12,
                    1 - len(distinct) / len(words),
                    1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 0.0,
                    len(distinct & earlier) / len(distinct),
                    float(key in seen),
                    float(key[-1] in ".!?"),
                    float(key[0].isupper()),
                    float(len(words) < 4),
                    sum(w[-1] in "#*$%&|<>!" for w in words) / len(words),
                )
            )
            seen.add(key)
            earlier |= distinct
            # A line end counts with its line.
            kept.append(f"{line}\n" if more else line)
            some = True
            if len(rows) == PIECE:
                yield _described(rows, kept)
                rows, kept = [], []
    if rows:
        yield _described(rows, kept)
    if not some:
        yield np.zeros((1, FEATURES), np.float32), np.ones(1)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of all lines of a text at once."""
    features, weights = zip(*line_pieces(text), strict=True)
    return np.concatenate(features), np.concatenate(weights)


def with_neighbours(features: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the line before and after it (zeros at the ends)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    return np.concatenate((features, before, after), axis=1)


def marginals(
    unary: np.ndarray, mask: np.ndarray, moves: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and, summed with the chains' weights, the expected transitions.

    ``unary`` (chains x lines) is the log-odds of good, ``moves`` the 2 x 2 log weights of
    (label before, label); lines outside ``mask`` stand at the end of their chain. This is the
    forward-backward algorithm in logarithms.
    """
    chains, lines = unary.shape
    scores = np.zeros((chains, lines, 2))
    scores[:, :, 1] = unary
    ahead, back = np.zeros((chains, lines, 2)), np.zeros((chains, lines, 2))
    ahead[:, 0] = scores[:, 0]
    for t in range(1, lines):
        a = ahead[:, t - 1, :, None] + moves
        new = np.logaddexp(a[:, 0], a[:, 1]) + scores[:, t]
        ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
    for t in range(lines - 2, -1, -1):
        b = moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :]
        new = np.logaddexp(b[:, :, 0], b[:, :, 1])
        back[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    joint = ahead + back
    good = 1 / (1 + np.exp(np.clip(joint[:, :, 0] - joint[:, :, 1], -60, 60)))
    if weight is None or lines < 2:
        return good, np.zeros((2, 2))
    pair = ahead[:, :-1, :, None] + moves + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]
    expected = np.exp(np.minimum(pair, 0)) * (mask[:, 1:] * weight[:, None])[:, :, None, None]
    return good, expected.sum((0, 1))


def long_marginals(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(good) of each line of one chain, worked on in as many pieces as a piece has lines.

    All pieces are first run from either label at once, which gives what each does to a
    message; the messages are carried over the pieces, forward and backward, and each piece
    is run again from those that reach it.
    """
    n = len(unary)
    size = max(1, int(np.ceil(np.sqrt(n))))
    pieces = -(-n // size)
    scores = np.zeros((pieces * size, 2))
    scores[:n, 1] = unary
    scores = scores.reshape(pieces, size, 2)
    real = (np.arange(pieces * size) < n).reshape(pieces, size)

    def step(message: np.ndarray, towards: np.ndarray) -> np.ndarray:
        both = message[..., :, None] + towards
        return np.logaddexp(both[..., 0, :], both[..., 1, :])

    def run(message: np.ndarray, towards: np.ndarray, order: range, keep: list[np.ndarray] | None = None) -> np.ndarray:
        """Messages (pieces, starts, 2) through a piece's lines; places past the end leave them as they are."""
        for t in order:
            if keep is not None:
                keep[t] = message[:, 0]
            new = step(message + scores[:, None, t], towards)
            message = np.where(real[:, None, t, None], new, message)
        return message

    start = np.broadcast_to(np.array([[0.0, -np.inf], [-np.inf, 0.0]]), (pieces, 2, 2))
    reached = []
    for towards, order, through in ((moves, range(size), range(pieces)), (moves.T, range(size - 1, -1, -1), range(pieces - 1, -1, -1))):
        change = run(start, towards, order)
        arriving, carried = np.zeros((pieces, 1, 2)), np.zeros(2)
        for p in through:
            arriving[p, 0] = carried
            carried = step(carried, change[p])
            carried = carried - carried.max()
        kept: list[np.ndarray] = [carried] * size
        run(arriving, towards, order, kept)
        reached.append(np.stack(kept, axis=1))
    joint = (reached[0] + scores + reached[1]).reshape(-1, 2)[:n]
    return 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -60, 60)))


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    #: Slope and offset that turn the log-odds of the mean marginal into a score.
    slope: float = 1.0
    offset: float = 0.0

    def unary(self, pieces: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good and weight of each line; of a line's features only their sums are kept.

        The weights of a line's own features and of those of its neighbours are applied
        apart, so a piece needs nothing of the one before it.
        """
        scaled = self.weights / self.scale
        own, weights = [], []
        for features, weight in pieces:
            own.append(features @ scaled.reshape(3, FEATURES).T)
            weights.append(np.maximum(weight, 1))
        parts = np.concatenate(own)
        odds = parts[:, 0] - self.centre @ scaled
        odds[1:] += parts[:-1, 1]
        odds[:-1] += parts[1:, 2]
        return odds, np.concatenate(weights)

    def quality(self, documents: Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, calibrated, of each document.

        A document is given as pieces of (features, weights). Documents of like length are
        scored together, CELLS lines at most; longer ones on their own.
        """
        chains = [self.unary(pieces) for pieces in documents]
        out = np.zeros(len(chains))
        order = sorted(range(len(chains)), key=lambda i: len(chains[i][0]))
        at = 0
        while at < len(order):
            shortest, group = len(chains[order[at]][0]), []
            while at < len(order):
                lines = len(chains[order[at]][0])
                if group and (lines > max(16, 2 * shortest) or lines * (len(group) + 1) > CELLS):
                    break
                group.append(order[at])
                at += 1
            if len(group) == 1:
                odds, weight = chains[group[0]]
                out[group[0]] = (long_marginals(odds, self.moves) * weight).sum() / weight.sum()
                continue
            lines = len(chains[group[-1]][0])
            unary, mask, weight = np.zeros((len(group), lines)), np.zeros((len(group), lines), bool), np.zeros((len(group), lines))
            for row, i in enumerate(group):
                odds, w = chains[i]
                unary[row, : len(w)], mask[row, : len(w)], weight[row, : len(w)] = odds, True, w
            good, _ = marginals(unary, mask, self.moves)
            out[group] = (good * weight).sum(1) / weight.sum(1)
        odds = np.log(np.clip(out, 1e-6, 1 - 1e-6)) - np.log1p(-np.clip(out, 1e-6, 1 - 1e-6))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.offset, -40, 40)))


def fit_lines(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Conditional likelihood of chains whose lines bear their document's label, by Adam.

    Chains count so that both labels weigh alike; the final calibration undoes that, as it
    is fitted to the labels as they are. With one label only, the model scores
    everything by the share of good labels.
    """
    width = 3 * FEATURES
    empty = Model(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        empty.slope, empty.offset = 0.0, float(np.log(share / (1 - share)))
        return empty
    chains, of = [], []
    for i, (features, _) in enumerate(documents):
        rows = with_neighbours(features)
        for at in range(0, len(rows), CHAIN):
            chains.append(rows[at : at + CHAIN])
            of.append(i)
    of = np.array(of)
    label = labels[of].astype(float)
    stacked = np.concatenate(chains)
    centre, scale = stacked.mean(0), stacked.std(0) + 1e-3
    lines = max(map(len, chains))
    x = np.zeros((len(chains), lines, width), np.float32)
    mask = np.zeros((len(chains), lines), bool)
    for row, chain in enumerate(chains):
        x[row, : len(chain)] = (chain - centre) / scale
        mask[row, : len(chain)] = True
    # A document weighs the same however long it is, and so do both labels.
    weight = 1 / (np.bincount(of, mask.sum(1), len(documents))[of])
    weight *= np.where(label == 1, 0.5 / (weight * mask.sum(1))[label == 1].sum(), 0.5 / (weight * mask.sum(1))[label == 0].sum())
    target = label[:, None] * mask
    pairs = mask[:, 1:].sum(1)
    w, moves = np.zeros(width), np.zeros((2, 2))
    state = [np.zeros(width + 4), np.zeros(width + 4)]
    for step in range(1, STEPS + 1):
        unary = x @ w.astype(np.float32)
        good, moved = marginals(unary.astype(float), mask, moves, weight)
        g = np.zeros(width + 4)
        g[:width] = np.einsum("ct,ctf->f", ((good - target) * mask * weight[:, None]).astype(np.float32), x) + PENALTY * w
        seen = np.array([[((1 - label) * pairs * weight).sum(), 0], [0, (label * pairs * weight).sum()]])
        g[width:] = (moved - seen).ravel() + 0.02 * moves.ravel()
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, moves = w - move[:width], moves - move[width:].reshape(2, 2)
    model = Model(w, moves, centre, scale)
    raw = model.quality([d] for d in documents)
    odds = np.log(np.clip(raw, 1e-6, 1 - 1e-6) / (1 - np.clip(raw, 1e-6, 1 - 1e-6)))
    slope, offset = 1.0, float(np.log(share / (1 - share)))
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -40, 40)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - labels) * odds).sum() + 1e-3 * slope, (p - labels).sum()])
        H = np.array([[(h * odds * odds).sum() + 1e-3, (h * odds).sum()], [(h * odds).sum(), h.sum()]])
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(H, g), -1, 1)
    model.slope, model.offset = float(max(slope, 0.0)), float(offset)
    return model


def sampled_lines(name: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of at most CHAINS chains of a text's lines, in order.

    Texts of more have those chains of CHAIN lines that come first by the hash of id and place.
    """
    lowest: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    at = 0
    for features, weights in line_pieces(text):
        for i in range(0, len(weights), CHAIN):
            rank = zlib.crc32(f"{name}|{at}".encode())
            lowest.append((rank, at, features[i : i + CHAIN].copy(), weights[i : i + CHAIN]))
            at += 1
        lowest = sorted(lowest, key=lambda x: x[:2])[:CHAINS]
    lowest.sort(key=lambda x: x[1])
    return np.concatenate([x[2] for x in lowest]), np.concatenate([x[3] for x in lowest])


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on a bounded sample: the SAMPLE labelled documents that come first by the hash of their id.

    Of a document at most CHAINS chains of CHAIN lines are taken, so the sample is bounded in
    lines too. ``labels`` has the id and a 0/1 label; ids labelled twice count as good if one
    label says so. Null texts count as empty; null labels and ids are left out. The fit
    runs in one task; only the model, a few kilobytes, comes to the driver.
    """
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter("doc_id is not null and label is not null")
    usable = usable.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = docs.select(F.col(doc_id).alias("doc_id")).join(usable, "doc_id")
    # At most SAMPLE rows of an id and a label.
    sample = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            names = batch.column("doc_id")
            made = [sampled_lines(i, x or "") for i, x in zip(names.to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    names, batch.column("label"), pa.array([f.tobytes() for f, _ in made], pa.binary()),
                    pa.array([w.tobytes() for _, w in made], pa.binary()),
                ],
                ["doc_id", "label", "features", "weights"],
            )

    def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "features", "label", "weights")), strict=True)]
        # In an order of their own, whatever order the tasks ended in.
        rows.sort()
        found = [(np.frombuffer(f, np.float32).reshape(-1, FEATURES), np.frombuffer(w)) for _, f, _, w in rows]
        made = fit_lines(found, np.array([r[2] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return fit_in_task(
        texts.join(F.broadcast(sample), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(describe, "doc_id long, label int, features binary, weights binary"),
        fit_sample,
    )


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and predicted of every row of ``docs``.

    Null, empty and blank texts are scored as one line without features. Repeated rows and
    null ids stay; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            made = shared.value.quality(line_pieces(x or "") for x in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made), pa.array((made >= CUTOFF).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(judge, "doc_id long, score double, predicted int")


def without_rejected(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            made = shared.value.quality(line_pieces(x or "") for x in batch.column(at).to_pylist())
            yield batch.filter(pa.array(made >= CUTOFF))

    return docs.mapInArrow(keep, docs.schema)
