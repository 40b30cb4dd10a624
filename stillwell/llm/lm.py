"""Language-model scores: a gated recurrent network over word classes, with counts of all words behind the classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwell.llm.shared import staged

#: Classes: 0 for words met once or never in training, 1 for the end of a document, the others by falling frequency.
CLASSES = 64
RARE, END = 0, 1
HIDDEN = 16
#: Documents run side by side, and the words over which an error is carried back.
LANES = 256
WARM_LANES = 32
SCORE_LANES = 512
WARM_PASSES = 4
WINDOW = 32
#: Words of coded documents that a task holds at a time.
GROUP = 2_000_000
#: Counts are put into this many steps for each doubling before they are split into classes of equal mass.
STEPS = 16
#: Words of a count step that takes the mass of several classes are dealt over them by hash, in this many slots.
SLOTS = CLASSES - 2
FLUSH = 400_000

CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 7; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only
    return (text or "").encode("utf-8", "replace").lower().split()


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word, n): how often each word of a block is in training documents; 0 if only in others."""
    block, counts = None, Counter()

    def put() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([block] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         ["block", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text, held, of in zip(batch["text"], batch["held_out"].to_pylist(), batch["block"].to_pylist()):
            if of != block or len(counts) > FLUSH:
                if counts:
                    yield put()
                block = of
            words = words_of(text.as_py())
            if held:
                for word in set(words):
                    counts.setdefault(word, 0)
            else:
                counts.update(words)
    if counts:
        yield put()


@dataclass
class Corpus:
    """Totals of the training documents, the class of each count step (or of each step and slot), and each class's mass."""

    tokens: int
    types: int
    documents: int
    step_class: np.ndarray
    mass: np.ndarray
    rare_types: int

    def log_shares(self) -> np.ndarray:
        """Logarithms of the classes' shares of the training words, each class counted once more."""
        counts = self.mass + 1
        counts[RARE] += self.rare_types
        counts[END] += self.documents
        return np.log(counts / counts.sum())

    def tables(self, counts: np.ndarray, slots: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, log10 of the share in the class and base log10 for words with these training counts and slots.

        The rare class keeps half of its mass for words never met, as one type, and shares the rest among those met
        once.
        """
        by_slot = self.step_class.reshape(len(self.step_class), -1)
        steps = np.floor(STEPS * np.log2(np.maximum(counts, 1))).astype(np.int64)
        classes = np.where(counts > 1, by_slot[np.minimum(steps, len(by_slot) - 1), slots], RARE)
        share = np.where(counts > 1, counts / np.maximum(self.mass[classes], 1), np.where(counts == 1, 0.5 / max(self.rare_types, 1), 0.5))
        return classes.astype(np.uint8), np.log10(share), np.log10((counts + 1) / (self.tokens + self.types + 1))


def slot_of(word: str = "word") -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int").alias("slot")


def corpus_totals(counts: DataFrame, documents: int) -> Corpus:
    """Totals of (word, c); what comes to the driver is SLOTS rows per count step, some ten thousand for any corpus."""
    step = F.floor(F.lit(STEPS) * F.log2("c")).alias("step")
    rows = counts.groupBy(step, slot_of()).agg(F.count(F.lit(1)).alias("types"), F.sum("c").alias("mass"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()
    size = max([r["step"] for r in rows], default=0) + 1
    by_slot = np.zeros((size, SLOTS))
    for r in rows:
        by_slot[r["step"], r["slot"]] = r["mass"] - r["once"]
    by_step = by_slot.sum(axis=1)
    total = max(by_step.sum(), 1)
    above = np.cumsum(by_step[::-1])[::-1] - by_step
    place = above[:, None] + by_step[:, None] * (np.arange(SLOTS) + 0.5) / SLOTS
    step_class = (2 + np.minimum((CLASSES - 2) * place / total, CLASSES - 3)).astype(np.int64)
    mass = np.bincount(step_class.ravel(), weights=by_slot.ravel(), minlength=CLASSES)
    types = sum(r["types"] for r in rows) + (documents > 0)
    return Corpus(int(sum(r["mass"] for r in rows)) + documents, types, documents, step_class, mass, sum(r["once"] for r in rows))


def coder(corpus: Corpus):
    """Turn a block's documents into class sequences, with what does not depend on the network already summed."""

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = dict(zip(words["word"].to_pylist(), range(len(words))))
        counts = words["c"].to_numpy()
        classes, within, base = corpus.tables(counts, words["slot"].to_numpy())
        _, _, end_base = corpus.tables(np.array([corpus.documents]))
        end_known = int(corpus.documents > 0)
        rows = []
        for doc, held, text in zip(docs["doc_id"].to_pylist(), docs["held_out"].to_pylist(), docs["text"]):
            found = words_of(text.as_py())
            at = np.fromiter(map(place.__getitem__, found), dtype=np.int64, count=len(found))
            rows.append((doc, held, len(at) + 1, int((counts[at] > 0).sum()) + end_known, float(base[at].sum() + end_base[0]), float(within[at].sum()),
                         classes[at].tobytes() + bytes([END])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, CODED_FIELDS)], schema=CODED_FIELDS)

    return run


CODED_FIELDS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("classes", pa.binary())])

SHAPES = {"inputs": (CLASSES, 3 * HIDDEN), "recurrent": (HIDDEN, 3 * HIDDEN), "outputs": (HIDDEN, CLASSES), "bias": (CLASSES,)}


def fresh_parameters(bias: np.ndarray | None = None, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; with ``bias`` as the classes' log shares the network starts from plain counts."""
    random = np.random.default_rng(seed)
    out = {name: (random.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in SHAPES.items()}
    return out | {"bias": np.zeros(CLASSES, dtype=np.float32) if bias is None else bias.astype(np.float32)}


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at:at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """A gated recurrent layer over classes with a softmax over the next class.

    Large arrays are kept and used again: new memory costs more here than the arithmetic on it.
    """

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, dtype=self.p["recurrent"].dtype)
        return self.rooms[name][:size].reshape(shape)

    def states(self, inputs: np.ndarray, starts: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (step, lane, unit) for class ids (step, lane); a lane's state is cleared where a document starts.

        The array is overwritten by the next call.
        """
        given = np.take(self.p["inputs"], inputs, axis=0, out=self.room("given", *inputs.shape, 3 * HIDDEN), mode="clip")
        out = self.room("states", *inputs.shape, HIDDEN)
        fresh = ~starts
        state = state.copy()
        for t in range(len(inputs)):
            if not fresh[t].all():
                state = state * fresh[t][:, None]
            inner = state @ self.p["recurrent"]
            gates = sigmoid(given[t, :, :2 * HIDDEN] + inner[:, :2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[t, :, 2 * HIDDEN:] + reset * inner[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((state, inner[:, 2 * HIDDEN:], update, reset, new))
            state = new + update * (state - new)
            out[t] = state
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        flat_states = states.reshape(-1, HIDDEN)
        out = np.matmul(flat_states, self.p["outputs"], out=self.room("logits", len(flat_states), CLASSES))
        out += self.p["bias"]
        # states lie within -1 and 1, so this bounds every logit; only beyond it could exp overflow
        if np.abs(self.p["outputs"]).sum(axis=0).max() + np.abs(self.p["bias"]).max() > 60:
            out -= out.max(axis=1, keepdims=True)
        return out

    def log_chances(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Logarithms of the chances of the classes that came next."""
        logits = self.logits(states)
        chosen = logits[np.arange(len(logits)), targets.ravel()]
        return chosen - np.log(np.exp(logits, out=logits).sum(axis=1))

    def gradient(self, inputs: np.ndarray, starts: np.ndarray, targets: np.ndarray, valid: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray]:
        """The gradient of the mean log loss over a window, carried back to its first step only, and the last state."""
        keep: list = []
        states = self.states(inputs, starts, state, keep)
        count = max(int(valid.sum()), 1)
        chances = self.logits(states)
        np.exp(chances, out=chances)
        chances *= (valid.ravel() / count / chances.sum(axis=1))[:, None].astype(chances.dtype)
        chances[np.arange(len(chances)), targets.ravel()] -= (valid.ravel() / count).astype(chances.dtype)
        plain = states.reshape(-1, HIDDEN)
        out = {"outputs": plain.T @ chances, "bias": chances.sum(axis=0)}
        back = np.matmul(chances, self.p["outputs"].T, out=self.room("back", len(chances), HIDDEN)).reshape(states.shape)
        given = self.room("slopes", *inputs.shape, 3 * HIDDEN)
        recurrent = np.zeros_like(self.p["recurrent"])
        carried = np.zeros_like(state)
        for t in range(len(inputs) - 1, -1, -1):
            before, inner_new, update, reset, new = keep[t]
            total = back[t] + carried
            d_new = total * (1 - update) * (1 - new * new)
            given[t, :, :HIDDEN] = total * (before - new) * update * (1 - update)
            given[t, :, HIDDEN:2 * HIDDEN] = d_new * inner_new * reset * (1 - reset)
            given[t, :, 2 * HIDDEN:] = d_new
            inner = given[t].copy()
            inner[:, 2 * HIDDEN:] *= reset
            recurrent += before.T @ inner
            carried = (total * update + inner @ self.p["recurrent"].T) * ~starts[t][:, None]
        order = np.argsort(inputs, axis=None, kind="stable")
        met, first = np.unique(inputs.ravel()[order], return_index=True)
        sorted_slopes = np.take(given.reshape(-1, 3 * HIDDEN), order, axis=0, out=self.room("sorted", inputs.size, 3 * HIDDEN), mode="clip")
        out["inputs"] = np.zeros_like(self.p["inputs"])
        out["inputs"][met] = np.add.reduceat(sorted_slopes, first, axis=0)
        out["recurrent"] = recurrent
        return out, states[-1].copy()


@dataclass
class Lanes:
    """Documents side by side: inputs, targets and marks (step, lane), and where each document lies."""

    inputs: np.ndarray
    targets: np.ndarray
    starts: np.ndarray
    valid: np.ndarray
    lane: list[int]
    first: list[int]

    @classmethod
    def of(cls, documents: list[np.ndarray], most: int = LANES) -> Lanes:
        """Deal documents to lanes, longest first, each to the lane that is shortest so far."""
        import heapq
        count = min(most, len(documents))
        heap = [(0, k) for k in range(count)]
        lane, first = [0] * len(documents), [0] * len(documents)
        for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
            length, k = heapq.heappop(heap)
            lane[i], first[i] = k, length
            heapq.heappush(heap, (length + len(documents[i]), k))
        # the longest lane first, so that the lanes still running are always the first ones
        rank = {k: new for new, (_, k) in enumerate(sorted(heap, reverse=True))}
        lane = [rank[k] for k in lane]
        longest = max(length for length, _ in heap)
        targets = np.full((count, longest), END, dtype=np.uint8)
        valid = np.zeros((count, longest), dtype=bool)
        for doc, k, at in zip(documents, lane, first):
            targets[k, at:at + len(doc)] = doc
            valid[k, at:at + len(doc)] = True
        # the first word of a document follows the end of another
        inputs = np.concatenate([np.full((count, 1), END, dtype=np.uint8), targets[:, :-1]], axis=1)
        return cls(inputs.T.copy(), targets.T.copy(), (inputs == END).T.copy(), valid.T.copy(), lane, first)

    def windows(self) -> Iterator[tuple[slice, int]]:
        """Each window's steps, and how many lanes have words in it."""
        running = self.valid.sum(axis=1)
        for at in range(0, len(self.valid), WINDOW):
            yield slice(at, at + WINDOW), int(running[at])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Names and class sequences of documents, in groups of about GROUP words."""
    names, documents, size = [], [], 0
    for batch in batches:
        for name, classes in zip(batch["doc_id"].to_pylist(), batch["classes"].to_pylist()):
            names.append(name)
            documents.append(np.frombuffer(classes, dtype=np.uint8))
            size += len(classes)
            if size >= GROUP:
                yield names, documents
                names, documents, size = [], [], 0
    if documents:
        yield names, documents


def trainer(start: np.ndarray, rate: float, most: int = LANES, passes: int = 1):
    """Train on a task's documents from common parameters; rows of place, weighted value and weight to average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shaped(start))
        first = {n: np.zeros_like(v) for n, v in network.p.items()}
        second = {n: np.zeros_like(v) for n, v in network.p.items()}
        seen = step = 0
        groups = grouped(batches)
        if passes > 1:
            groups = list(groups) * passes
        for _, documents in groups:
            lanes = Lanes.of(documents, most)
            seen += sum(map(len, documents))
            state = np.zeros((lanes.inputs.shape[1], HIDDEN), dtype=np.float32)
            for part, k in lanes.windows():
                step += 1
                slopes, state = network.gradient(lanes.inputs[part, :k], lanes.starts[part, :k], lanes.targets[part, :k], lanes.valid[part, :k], state[:k])
                size = np.sqrt(sum(float((g * g).sum()) for g in slopes.values()))
                for name, g in slopes.items():
                    g = g / max(1.0, size)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    network.p[name] -= rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
        if seen:
            values = flat(network.p).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), float(seen)))], ["place", "value", "weight"])

    return run


def averaged(rows: DataFrame, start: np.ndarray) -> np.ndarray:
    """The tasks' parameters averaged by their words; as many rows as the network has parameters come back."""
    out = start.copy()
    for place, value in rows.groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value")).collect():
        out[place] = value
    return out


def scorer(parameters: np.ndarray):
    """log10 of the network's part of each document's chance, from its first word to its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(shaped(parameters))
        for names, documents in grouped(batches):
            lanes = Lanes.of(documents, SCORE_LANES)
            logs = np.empty(lanes.inputs.shape, dtype=np.float32)
            state = np.zeros((lanes.inputs.shape[1], HIDDEN), dtype=np.float32)
            for part, k in lanes.windows():
                states = network.states(lanes.inputs[part, :k], lanes.starts[part, :k], state[:k])
                state = states[-1].copy()
                logs[part, :k] = network.log_chances(states, lanes.targets[part, :k]).reshape(states.shape[:2])
            sums = [float(logs[a:a + len(d), k].sum(dtype=np.float64)) / np.log(10) for d, k, a in zip(documents, lanes.lane, lanes.first)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums)], ["doc_id", "score"])

    return run


def coded_corpus(docs: DataFrame) -> tuple[DataFrame, Corpus]:
    """Every document as classes, and the totals.

    A block is what one task read. Words are counted per block first, so a word travels once per block however often
    it occurs; a block then gets back the counts of its own words only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = staged(rows.withColumn("block", F.spark_partition_id()))
    found = staged(rows.mapInArrow(word_counts, "block int, word binary, n long"))
    counts = staged(found.groupBy("word").agg(F.sum("n").alias("c")))
    corpus = corpus_totals(counts.filter("c > 0"), rows.filter(~F.col("held_out")).count())
    words = found.select("block", "word").join(counts, "word").dropDuplicates(["block", "word"]).withColumn("slot", slot_of())
    coded = rows.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(coder(corpus), CODED)
    return staged(coded), corpus


def train(coded: DataFrame, corpus: Corpus, warm_documents: int = 500, rate: float = 3e-3) -> np.ndarray:
    """Parameters after one pass over all training documents.

    The classes' shares of all training words and a few passes over ``warm_documents`` of them, a bounded number, give
    a common start; from there every task trains on all of its own documents and the results are averaged by words.
    """
    learn = coded.filter(~F.col("held_out")).select("doc_id", "classes")
    start = flat(fresh_parameters(corpus.log_shares())).astype(np.float64)
    some = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(warm_documents)
    start = averaged(some.coalesce(1).mapInArrow(trainer(start, rate, WARM_LANES, WARM_PASSES), "place int, value double, weight double"), start)
    return averaged(learn.mapInArrow(trainer(start, rate), "place int, value double, weight double"), start)


def language_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are runs of anything but ASCII white space, A-Z as a-z, and an end closes each document. Documents whose
    held_out is false are learned from. base_score is the smoothed unigram log10 chance of the words; score is the
    log10 chance by the network: for each word, the chance of its class after all words before it in the document,
    times its share in the class by the counts of all training documents. A null or empty text is its end alone.
    Repeated rows and null ids are scored like any other; an empty table gives no rows.
    """
    coded, corpus = coded_corpus(docs)
    parameters = train(coded, corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def put() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            network = pa.concat_arrays([b["score"] for b in scorer(parameters)(iter([whole]))])
            score = pa.array(network.to_numpy() + whole["within"].to_numpy())
            total = pa.array(np.full(len(whole), corpus.tokens, dtype=np.int64))
            return pa.RecordBatch.from_arrays([*(whole[c] for c in ("doc_id", "held_out", "n_tokens", "n_known")), total, whole["base_score"], score],
                                              ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += batch.nbytes
            if size >= GROUP:
                yield put()
                size = 0
        if held:
            yield put()

    return coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
