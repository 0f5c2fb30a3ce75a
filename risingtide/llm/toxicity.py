"""Toxicity of documents: a bidirectional gated recurrent network over windows of words.

A word enters as the vector of its own hash and the mean vector of its character n-grams
(its first bytes and all runs of three). Two gated recurrent units read each window of
``WINDOW`` words, one from either end, attention pools their states, and a linear layer
gives the window's logit. Windows overlap: a new one starts every ``STRIDE`` words, and the
last one ends with the text, so every word of every text is scored in its surroundings. A
document's score is that of its worst window.

The network is trained with numpy on the driver, on ``SAMPLE`` labelled training rows at
most, half of either label, those with the smallest hash of their id; texts of up to
``TRAIN_BYTES`` bytes are taken first, and of longer ones, taken only where there are too
few, the first TRAIN_CHARS characters. Every copy of an id and text counts once. In the
first rounds every window has the label of its document, then only the worst one, so the
network learns which window made the document toxic. The model is broadcast: its size,
some 13 MB, is fixed by the parameters. Scoring reads all documents.

Rows whose crc32 of the id as text is a multiple of 5 are held out of training. Rows
without a label or with a null one teach nothing; a row without id is never held out.
Null texts, empty texts and texts without a word have no window and score 0. Without
training rows of both labels every score is the share of label 1 (0 without any). Repeated
rows get equal scores. Very long texts are scored window by window. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from risingtide.llm import words as W
from risingtide.llm.tables import Scratch, small_batches

SAMPLE = 4_096
TRAIN_BYTES = 2_048
TRAIN_CHARS = 2_048
WINDOW = 32
STRIDE = 24
# Rows and width of the table of words, and of that of character n-grams.
WORD_ROWS, WORD_WIDTH = 1 << 18, 8
GRAM_ROWS, GRAM_WIDTH = 1 << 16, 16
GRAM = 3
HEADS = (3, 4, 5)
HIDDEN = 16
ATTENTION = 16
# Rounds in which all windows count, and in which the worst one does.
ROUNDS = (1, 4)
TOGETHER = 64
THRESHOLD = 0.5
# Windows scored in one go.
BLOCK = 4_096

# Words are runs of letters, digits and everything beyond ASCII.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


class Words:
    """The words of some texts: their different ones, and which stand where."""

    def __init__(self, texts: pa.Array):
        data, offsets = W.buffers(texts)
        starts, stops, self.before = W.spans(data, offsets, _GAP)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(
            W.span_hashes(data[offsets[a]: offsets[b]], starts[self.before[a]: self.before[b]] - offsets[a],
                          stops[self.before[a]: self.before[b]] - offsets[a], fold=True)
            for a, b in W.chunks(offsets))])
        different, one, self.at = np.unique(hashes, return_index=True, return_inverse=True)
        self.rows = (different % np.uint64(WORD_ROWS)).astype(np.int64)
        self.grams, self.gram_at = self._grams(data, starts[one], stops[one])

    @staticmethod
    def _grams(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the character n-grams of each word, and where those of each begin."""
        sizes = stops - starts
        # Words apart from each other, so that hashes are taken of a short buffer.
        ends = np.cumsum(sizes)
        begins = ends - sizes
        own = data[np.repeat(starts - begins, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        inner = np.maximum(sizes - GRAM + 1, 1)
        first = np.cumsum(inner) - inner
        at = np.repeat(begins - first, inner) + np.arange(inner.sum())
        parts = [(np.repeat(np.arange(len(sizes)), inner), at, np.minimum(at + GRAM, np.repeat(ends, inner)), 0)]
        for head in HEADS:
            parts.append((np.arange(len(sizes)), begins, np.minimum(begins + head, ends), head))
        with np.errstate(over="ignore"):
            found = [W.span_hashes(own, lo, hi, fold=True) + np.uint64(salt) * W.LENGTH_STEP for _, lo, hi, salt in parts]
        word = np.concatenate([p[0] for p in parts])
        order = np.argsort(word, kind="stable")
        rows = (W.mix(np.concatenate(found)) % np.uint64(GRAM_ROWS)).astype(np.int64)[order]
        return rows, np.searchsorted(word[order], np.arange(len(sizes)))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first word of every window, its number of words, and the windows before each text."""
        n = np.diff(self.before)
        many = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
        before = np.append(0, np.cumsum(many))
        number = np.arange(before[-1]) - np.repeat(before[:-1], many)
        last = np.repeat(np.maximum(n - WINDOW, 0), many)
        first = np.repeat(self.before[:-1], many) + np.minimum(number * STRIDE, last)
        return first, np.repeat(np.minimum(n, WINDOW), many), before


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The weights, and the passes over windows of words in both directions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / shape[-2] ** 0.5).astype(np.float32)

        width = WORD_WIDTH + GRAM_WIDTH
        self.weights = {
            "words": np.zeros((WORD_ROWS, WORD_WIDTH), np.float32), "grams": 10 * drawn(GRAM_ROWS, GRAM_WIDTH),
            # Reset gate, update gate and candidate of either direction.
            "into": drawn(2, width, 3 * HIDDEN), "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "own": drawn(2, HIDDEN, 3 * HIDDEN), "look": drawn(2 * HIDDEN, ATTENTION),
            "look_bias": np.zeros(ATTENTION, np.float32), "glance": drawn(ATTENTION, 1)[:, 0],
            "out": drawn(2 * HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def inputs(self, words: Words, mask: np.ndarray | None = None) -> np.ndarray:
        """The vector of each different word."""
        w = self.weights
        many = np.diff(np.append(words.gram_at, len(words.grams)))
        grams = np.add.reduceat(w["grams"][words.grams], words.gram_at, axis=0) / many[:, None] if len(many) else np.zeros((0, GRAM_WIDTH), np.float32)
        own = w["words"][words.rows]
        return np.concatenate([own if mask is None else own * mask[:, None], grams], axis=1).astype(np.float32)

    def forward(self, fed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict]:
        """The logit of each window, and what the way back needs.

        ``fed`` holds the gates' inputs: direction, window, place, 3 * HIDDEN; ``size`` how
        many words a window has, the rest of its places being empty.
        """
        w, (_, n, length, _) = self.weights, fed.shape
        real = np.arange(length) < size[:, None]
        states = np.zeros((2, n, length + 1, HIDDEN), np.float32)
        gates = np.zeros((length, 3, 2, n, HIDDEN), np.float32)
        inner = np.zeros((length, 2, n, HIDDEN), np.float32)
        state = np.zeros((2, n, HIDDEN), np.float32)
        for step in range(length):
            # The second direction reads from the end; its empty places come first and leave the state at zero.
            at = (step, length - 1 - step)
            now = np.stack([fed[0, :, at[0]], fed[1, :, at[1]]])
            here = np.stack([real[:, at[0]], real[:, at[1]]])[:, :, None]
            own = state @ w["own"]
            reset = _sigmoid(now[..., :HIDDEN] + own[..., :HIDDEN])
            keep = _sigmoid(now[..., HIDDEN: 2 * HIDDEN] + own[..., HIDDEN: 2 * HIDDEN])
            new = np.tanh(now[..., 2 * HIDDEN:] + reset * own[..., 2 * HIDDEN:])
            gates[step, 0], gates[step, 1], gates[step, 2], inner[step] = reset, keep, new, own[..., 2 * HIDDEN:]
            state = np.where(here, new + keep * (state - new), state)
            states[:, :, step + 1] = state
        both = np.concatenate([states[0, :, 1:], states[1, :, :0:-1]], axis=2)
        looked = np.tanh(both @ w["look"] + w["look_bias"])
        marks = np.where(real, looked @ w["glance"], -np.inf)
        share = np.exp(marks - marks.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share[:, :, None] * both).sum(axis=1)
        logit = pooled @ w["out"] + w["out_bias"]
        return logit, {"real": real, "states": states, "gates": gates, "inner": inner, "both": both,
                       "looked": looked, "share": share, "pooled": pooled}

    def backward(self, slope: np.ndarray, kept: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the weights behind the inputs, and of the gates' inputs."""
        w, both, share, real = self.weights, kept["both"], kept["share"], kept["real"]
        n, length, _ = both.shape
        grads = {"out": kept["pooled"].T @ slope, "out_bias": slope.sum(keepdims=True)}
        pooled = slope[:, None] * w["out"]
        by_share = (both * pooled[:, None]).sum(axis=2)
        marks = share * (by_share - (share * by_share).sum(axis=1, keepdims=True))
        looked = marks[:, :, None] * w["glance"] * (1 - kept["looked"] ** 2)
        grads["glance"] = (marks[:, :, None] * kept["looked"]).sum(axis=(0, 1))
        grads["look"] = both.reshape(n * length, -1).T @ looked.reshape(n * length, -1)
        grads["look_bias"] = looked.sum(axis=(0, 1))
        from_both = share[:, :, None] * pooled[:, None] + looked @ w["look"].T
        of_state = np.stack([from_both[:, :, :HIDDEN], from_both[:, ::-1, HIDDEN:]])
        fed, own_grad = np.zeros((2, n, length, 3 * HIDDEN), np.float32), np.zeros_like(w["own"])
        carried = np.zeros((2, n, HIDDEN), np.float32)
        for step in range(length - 1, -1, -1):
            at = (step, length - 1 - step)
            here = np.stack([real[:, at[0]], real[:, at[1]]])[:, :, None]
            reset, keep, new = kept["gates"][step]
            before, inner = kept["states"][:, :, step], kept["inner"][step]
            total = carried + of_state[:, :, step]
            live = total * here
            by_new = live * (1 - keep) * (1 - new ** 2)
            by_keep = live * (before - new) * keep * (1 - keep)
            by_reset = by_new * inner * reset * (1 - reset)
            inputs = np.concatenate([by_reset, by_keep, by_new], axis=2)
            own = np.concatenate([by_reset, by_keep, by_new * reset], axis=2)
            own_grad += before.transpose(0, 2, 1) @ own
            carried = total * ~here + live * keep + own @ w["own"].transpose(0, 2, 1)
            fed[0, :, at[0]], fed[1, :, at[1]] = inputs[0], inputs[1]
        grads["own"] = own_grad
        return grads, fed

    def feed(self, vectors: np.ndarray) -> np.ndarray:
        """The inputs of all gates, both directions, for each different word."""
        return vectors @ self.weights["into"] + self.weights["bias"]

    def logits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and the windows before each text."""
        first, size, before = words.windows()
        fed, out = self.feed(self.inputs(words)), np.zeros(len(first), np.float32)
        for a in range(0, len(first), BLOCK):
            place = places(words, first[a: a + BLOCK], size[a: a + BLOCK])
            out[a: a + BLOCK] = self.forward(fed[:, place], size[a: a + BLOCK])[0]
        return out, before

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of the worst window of each text; 0 without one."""
        out = np.zeros(len(texts))
        for a, b in W.chunks(W.buffers(texts)[1]):
            logit, before = self.logits(Words(texts.slice(a, b - a)))
            some = np.flatnonzero(np.diff(before))
            if len(some):
                out[a + some] = _sigmoid(np.maximum.reduceat(logit, before[some]).astype(np.float64) + self.shift)
        return out


def places(words: Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which different word stands at each place of some windows; empty places repeat the last one."""
    return words.at[first[:, None] + np.minimum(np.arange(WINDOW), size[:, None] - 1)]


class _Adam:
    """Steps for dense weights, and for the touched rows of a table."""

    def __init__(self, weights: dict, rate: float = 0.01):
        self.weights, self.rate, self.turn = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, name: str, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        mean, square = 0.9 * self.mean[name][rows] + 0.1 * grad, 0.99 * self.square[name][rows] + 0.01 * grad ** 2
        self.mean[name][rows], self.square[name][rows] = mean, square
        better = mean / (1 - 0.9 ** self.turn), square / (1 - 0.99 ** self.turn)
        self.weights[name][rows] -= self.rate * better[0] / (np.sqrt(better[1]) + 1e-6)


def _summed_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    different, first = np.unique(rows[order], return_index=True)
    return different, np.add.reduceat(values[order], first, axis=0)


def fit(texts: list[str], toxic: np.ndarray, rounds: tuple[int, int] = ROUNDS, seed: int = 5) -> Network:
    """A network trained on texts with labels 0 and 1."""
    net, rng = Network(seed), np.random.default_rng(seed)
    adam = _Adam(net.weights)
    held = pa.array(texts, pa.string())
    for turn in range(sum(rounds)):
        adam.rate = 0.01 * (1 - turn / (sum(rounds) + 1))
        order = rng.permutation(len(texts))
        for a in range(0, len(order), TOGETHER):
            own = order[a: a + TOGETHER]
            _step(net, adam, Words(held.take(pa.array(own))), toxic[own], turn < rounds[0], rng)
    return net


def _step(net: Network, adam: _Adam, words: Words, toxic: np.ndarray, all_windows: bool, rng: np.random.Generator) -> None:
    first, size, before = words.windows()
    if not len(first):
        return
    # Now and then a word's own vector is left out, so that its characters have to tell.
    mask = (rng.random(len(words.rows)) > 0.3).astype(np.float32)
    vectors = net.inputs(words, mask)
    fed, place = net.feed(vectors), places(words, first, size)
    text = np.repeat(np.arange(len(toxic)), np.diff(before))
    if all_windows:
        chosen, weight = np.arange(len(first)), (1 / np.diff(before))[text]
    else:
        logit = net.forward(fed[:, place], size)[0]
        some = np.flatnonzero(np.diff(before))
        worst = np.maximum.reduceat(logit, before[some])
        chosen = np.flatnonzero(logit == worst[np.searchsorted(some, text)])
        weight = (1 / np.bincount(text[chosen], minlength=len(toxic)))[text[chosen]]
    place = place[chosen]
    logit, kept = net.forward(fed[:, place], size[chosen])
    slope = (weight * (_sigmoid(logit) - toxic[text[chosen]]) / len(toxic)).astype(np.float32)
    grads, by_fed = net.backward(slope, kept)
    # From the gates' inputs to the words that fed them.
    word, by_word = _summed_rows(place.reshape(-1), by_fed.transpose(1, 2, 0, 3).reshape(place.size, -1))
    by_word = by_word.reshape(len(word), 2, 3 * HIDDEN).transpose(1, 0, 2)
    grads["into"] = vectors[word].T @ by_word
    grads["bias"] = by_word.sum(axis=1, keepdims=True)
    by_vector = (by_word @ net.weights["into"].transpose(0, 2, 1)).sum(axis=0)
    adam.turn += 1
    for name, grad in grads.items():
        adam.step(name, grad)
    rows, sums = _summed_rows(words.rows[word], by_vector[:, :WORD_WIDTH] * mask[word][:, None])
    adam.step("words", sums, rows)
    many = np.diff(np.append(words.gram_at, len(words.grams)))
    each = np.concatenate([np.arange(words.gram_at[i], words.gram_at[i] + many[i]) for i in word])
    rows, sums = _summed_rows(words.grams[each], np.repeat(by_vector[:, WORD_WIDTH:] / many[word][:, None], many[word], axis=0))
    adam.step("grams", sums, rows)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A broadcast network, or the share of label 1 where a label has no training row.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``toxic``. The driver
    gets ``sample`` texts of TRAIN_CHARS characters at most.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = docs.where(F.octet_length("text") > 0).select(
        "doc_id", (F.octet_length("text") > TRAIN_BYTES).alias("long"), F.xxhash64("text").alias("hash"))
    rows = Scratch(spark, "toxicity").keep(narrow.join(known, "doc_id").distinct(), "labelled")
    chosen = None
    for label in (0, 1):
        part = rows.where(F.col("toxic") == label).orderBy("long", F.xxhash64("doc_id"), "doc_id", "hash").limit(sample // 2)
        chosen = part if chosen is None else chosen.union(part)
    chosen = Scratch(spark, "toxicity").keep(chosen.drop("long"), "chosen")
    texts = docs.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "hash"])
    taught = texts.groupBy("doc_id", "hash", "toxic").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text")).collect()
    taught.sort(key=lambda r: (r["doc_id"], r["hash"], r["toxic"]))
    toxic = np.array([r["toxic"] for r in taught], dtype=np.float32)
    if len(set(toxic.tolist())) < 2:
        return float(toxic.mean()) if len(toxic) else 0.0
    net = fit([r["text"] for r in taught], toxic)
    # From the shares of the sample to those of all labels.
    net.shift = float(np.log(totals[1] / totals[0]) - np.log(toxic.sum() / (1 - toxic).sum()))
    return spark.sparkContext.broadcast(net)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``: one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        model = train(texts, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(len(batch), model) if isinstance(model, float) else model.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found)], names=["doc_id", "held_out", "score"])

    narrow = texts.select("doc_id", held_out().alias("held_out"), "text")
    found = Scratch(docs.sparkSession, "toxicity").keep(
        narrow.mapInArrow(score, "doc_id long, held_out boolean, score double"), "scores")
    return found.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
