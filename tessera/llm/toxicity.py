"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs,
trained in numpy; every overlapping window of a text is scored, and the text by its highest window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fitted_in_task
from tessera.llm.shingles import byte_rows, runs, small_batches

#: Words in a window and between windows; units in each direction; sizes of the word and character inputs.
WINDOW, STRIDE, UNITS, WORD_DIM, CHAR_DIM, ATTENTION = 64, 48, 8, 8, 8, 8
CHAR_BITS = 14
#: The model is fitted on at most so many labelled rows of each class, those with the least hash of their id.
LABELLED_ROWS = 1000
#: Words of fewer sampled texts have no word input of their own, only characters.
LEAST_TEXTS = 4
#: In an epoch a text lends at most so many windows, drawn by chance, to training.
WINDOWS_EACH = 6
EPOCHS, BATCH, RATE, DECAY, SEED = 5, 128, 0.01, 0.02, 7
#: Small samples are gone over more often, to come to so many steps.
LEAST_STEPS = 120
#: By how much the inputs of words and trigrams begin with their leaning, where they do.
TOLD = 0.5
#: Words kept with their inputs in each Python worker; at more the store starts anew.
CACHE_WORDS = 120_000
TRIM = bytes(b for b in range(128) if not chr(b).isalnum())


def spelling(word: bytes) -> str:
    """A word in lower case, without ASCII marks at its ends, between angle brackets; never without a letter."""
    return "<" + (word.strip(TRIM).decode("utf-8", "replace").lower() or " ") + ">"


@dataclass
class Features:
    """Numbers of words (0: none of its own), and the buckets of all their character trigrams."""

    words: np.ndarray
    grams: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(spelt: list[str], vocabulary: dict[str, int]) -> Features:
        lens = np.fromiter(map(len, spelt), np.int64, len(spelt))
        points = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + points[2:]
        mixed = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - CHAR_BITS)
        ends = np.cumsum(lens)
        within = np.ones(len(mixed) + 2, bool)
        within[ends - 1] = within[ends - 2] = False  # these would reach into the next word
        return Features(np.fromiter((vocabulary.get(x, 0) for x in spelt), np.int64, len(spelt)), mixed[within[:-2]].astype(np.int64), lens - 2)

    def take(self, at: np.ndarray) -> Features:
        starts, counts = np.cumsum(self.counts) - self.counts, self.counts[at]
        ends = np.cumsum(counts)
        return Features(self.words[at], self.grams[np.repeat(starts[at] - ends + counts, counts) + np.arange(ends[-1])], counts)


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Model:
    """Weights; scale and shift turn a text's highest window into log odds. blank: what stands for the highest window
    of a text without words, once the model is fitted; its score is then the share of toxic labels."""

    weights: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    scale: float = 1.0
    shift: float = 0.0
    blank: float | None = None

    def inputs(self, found: Features) -> np.ndarray:
        """Word and mean character inputs, a row for each word."""
        w = self.weights
        chars = np.add.reduceat(w["char"][found.grams], np.cumsum(found.counts) - found.counts) / found.counts[:, None]
        return np.concatenate([w["word"][found.words], chars], 1).astype(np.float32)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """What the gates of both directions get from an input, a row of 6 * UNITS."""
        w = self.weights
        return np.concatenate([inputs @ w["in0"].T + w["bias0"], inputs @ w["in1"].T + w["bias1"]], 1).astype(np.float32)

    def run(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """Logits of windows. at: rows of table, (steps, windows). trace gets what training needs."""
        w, (steps, n), h_ = self.weights, at.shape, UNITS
        states = np.zeros((steps, 2 * h_, n), np.float32)
        for way in (0, 1):
            u, h = w[f"rec{way}"], np.zeros((h_, n), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                x = np.ascontiguousarray(table[at[t], way * 3 * h_ : (way + 1) * 3 * h_].T)
                a = u @ h
                zr = np.tanh(0.5 * (x[: 2 * h_] + a[: 2 * h_]))
                zr *= 0.5
                zr += 0.5
                z, r = zr[:h_], zr[h_:]
                c = np.tanh(x[2 * h_ :] + r * a[2 * h_ :])
                new = c + z * (h - c)
                if mask is not None:
                    new = h + mask[t] * (new - h)
                if trace is not None:
                    trace.append((way, t, h, z, r, c, a[2 * h_ :]))
                h = new
                states[t, way * h_ : (way + 1) * h_] = h
        e = np.tanh(np.matmul(w["att"], states) + w["att_bias"][:, None])
        s = np.einsum("a,tan->tn", w["query"], e)
        if mask is not None:
            s = np.where(mask > 0, s, -1e9)
        p = np.exp(s - s.max(0))
        p /= p.sum(0)
        pooled = np.einsum("tn,tkn->kn", p, states)
        if trace is not None:
            trace.append((states, e, p, pooled))
        return w["out"] @ pooled + w["out_bias"][0]

    def empty(self) -> float:
        """The logit of a text without words."""
        return float(self.weights["out_bias"][0]) if self.blank is None else self.blank

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit + self.shift)


def fresh_model(vocabulary: dict[str, int], seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    d = WORD_DIM + CHAR_DIM
    w = {"word": draw(1 + len(vocabulary), WORD_DIM, by=0.01), "char": draw(1 << CHAR_BITS, CHAR_DIM, by=0.01), "att": draw(ATTENTION, 2 * UNITS, by=0.3), "att_bias": np.zeros(ATTENTION, np.float32), "query": draw(ATTENTION, by=0.3), "out": draw(2 * UNITS, by=0.3), "out_bias": np.zeros(1, np.float32)}
    for way in (0, 1):
        w |= {f"in{way}": draw(3 * UNITS, d, by=d**-0.5), f"rec{way}": draw(3 * UNITS, UNITS, by=UNITS**-0.5), f"bias{way}": np.zeros(3 * UNITS, np.float32)}
    return Model(w, vocabulary)


def gradients(model: Model, found: Features, at: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean cross-entropy of windows, and its gradients. found: features of the words that at names."""
    w, h_, trace = model.weights, UNITS, []
    inputs = model.inputs(found)
    table = model.projected(inputs)
    logit = model.run(table, at, mask, trace)
    p = _sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - labels * logit)).sum() / total)
    d_logit = (weight * (p - labels) / total).astype(np.float32)
    states, e, att, pooled = trace.pop()
    g = {"out": pooled @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = w["out"][:, None] * d_logit
    d_att = np.einsum("kn,tkn->tn", d_pooled, states)
    d_s = att * (d_att - (att * d_att).sum(0))
    d_e = w["query"][None, :, None] * d_s[:, None] * (1 - e * e)
    g["query"] = np.einsum("tn,tan->a", d_s, e)
    g["att"], g["att_bias"] = np.einsum("tan,tkn->ak", d_e, states), d_e.sum((0, 2))
    d_states = att[:, None] * d_pooled + np.matmul(w["att"].T, d_e)
    d_table = np.zeros_like(table)
    flow = [np.zeros_like(states[0, :h_]) for _ in (0, 1)]
    for way in (0, 1):
        g[f"rec{way}"] = np.zeros_like(w[f"rec{way}"])
    for way, t, h, z, r, c, a_c in reversed(trace):
        m = mask[t]
        d_h = flow[way] + d_states[t, way * h_ : (way + 1) * h_]
        d_new = d_h * m
        d_c = d_new * (1 - z) * (1 - c * c)
        d_z = d_new * (h - c) * z * (1 - z)
        d_r = d_c * a_c * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_c * r])
        g[f"rec{way}"] += d_a @ h.T
        np.add.at(d_table[:, way * 3 * h_ : (way + 1) * 3 * h_], at[t], np.concatenate([d_z, d_r, d_c]).T)
        flow[way] = d_h * (1 - m) + d_new * z + w[f"rec{way}"].T @ d_a
    d_inputs = np.zeros_like(inputs)
    for way in (0, 1):
        part = d_table[:, way * 3 * h_ : (way + 1) * 3 * h_]
        g[f"in{way}"], g[f"bias{way}"] = part.T @ inputs, part.sum(0)
        d_inputs += part @ w[f"in{way}"]
    g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
    np.add.at(g["word"], found.words, d_inputs[:, :WORD_DIM])
    np.add.at(g["char"], found.grams, np.repeat(d_inputs[:, WORD_DIM:] / found.counts[:, None], found.counts, axis=0))
    return loss, g


def leanings(texts: list[set], labels: np.ndarray) -> dict:
    """For each member of the sets: how much oftener texts of label 1 have it than those of label 0, as a log ratio,
    held at 0 by one text of either label."""
    every = Counter(x for own in texts for x in own)
    ones = Counter(x for own, y in zip(texts, labels) if y for x in own)
    n1, n0 = float(labels.sum()) + 2, float((1 - labels).sum()) + 2
    return {x: float(np.log((ones[x] + 1) / n1) - np.log((n - ones[x] + 1) / n0)) for x, n in every.items()}


def fit(texts: list[bytes], labels: list[int], totals: tuple[int, int] | None = None, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Train on texts and their labels. A text of label 1 need not be toxic throughout: in the first epoch chance
    picks its windows, later its highest window alone stands for it. Of other texts chance picks windows in every
    epoch. At last, scale and shift are fitted to the highest window of each text that is kept back.

    This is done twice: from inputs drawn by chance, and from inputs that begin with how telling words and their
    trigrams are, which learns from few texts, but leans on words. The one with the less log loss on the texts kept
    back is taken."""
    trained = [_fit_once(texts, labels, totals, seed, epochs, told) for told in (False, True)]
    return min(trained, key=lambda x: x[1])[0]


def _fit_once(texts: list[bytes], labels: list[int], totals: tuple[int, int] | None, seed: int, epochs: int, told: bool) -> tuple[Model, float]:
    """A model, and its mean log loss on the texts kept back."""
    rng = np.random.default_rng(seed)
    split = [t.split() for t in texts]
    spelt = {w: spelling(w) for words in split for w in words}
    in_texts = Counter(x for words in split for x in {spelt[w] for w in words})
    model = fresh_model({x: i + 1 for i, x in enumerate(sorted(x for x, n in in_texts.items() if n >= LEAST_TEXTS))}, seed)
    if len(set(labels)) < 2 or not spelt:
        model.shift = 5.0 if sum(labels) else -5.0
        return model, 0.0
    ids = {w: i for i, w in enumerate(spelt)}
    names = list(spelt.values())
    found = Features.of(names, model.vocabulary)
    words = [np.fromiter((ids[w] for w in own), np.int64, len(own)) for own in split]
    labels = np.array(labels, np.float32)
    kept_back = np.zeros(len(texts), bool)
    for c in (0, 1):
        kept_back[np.flatnonzero(labels == c)[4::5]] = True
    if told:
        fitted, grams = np.flatnonzero(~kept_back), np.split(found.grams, np.cumsum(found.counts)[:-1])
        of_words = leanings([{names[j] for j in words[i]} for i in fitted], labels[fitted])
        of_grams = leanings([set(np.concatenate([grams[j] for j in set(words[i])]).tolist()) if len(words[i]) else set() for i in fitted], labels[fitted])
        for x, i in model.vocabulary.items():
            model.weights["word"][i, 0] = TOLD * of_words.get(x, 0.0)
        for x, y in of_grams.items():
            model.weights["char"][x, 0] = TOLD * y
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    windows = sum(min(WINDOWS_EACH, len(window_starts(len(own)))) for own in words)
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(windows, 1)) if epochs else 0)
    for epoch in range(epochs):
        picked: list[tuple[int, int]] = []
        toxic = [i for i in np.flatnonzero((labels == 1) & ~kept_back) if len(words[i])]
        if epoch:
            picked += zip(toxic, Scorer(model).highest([texts[i] for i in toxic])[1])
        for i, own in enumerate(words):
            if len(own) and not kept_back[i] and not (epoch and labels[i]):
                starts = window_starts(len(own))
                picked += [(i, starts[k]) for k in rng.permutation(len(starts))[:WINDOWS_EACH]]
        if not picked:
            break
        owner = np.array([i for i, _ in picked])
        n_toxic = labels[owner].sum()
        weight = np.where(labels[owner] == 1, 0.5 * len(owner) / max(n_toxic, 1), 0.5 * len(owner) / max(len(owner) - n_toxic, 1)).astype(np.float32)
        order = rng.permutation(len(picked))
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            rows = [words[picked[j][0]][picked[j][1] : picked[j][1] + WINDOW] for j in part]
            steps = max(map(len, rows))
            at, mask = np.zeros((steps, len(part)), np.int64), np.zeros((steps, len(part)), np.float32)
            for k, row in enumerate(rows):
                at[: len(row), k], mask[: len(row), k] = row, 1
            used, at = np.unique(at, return_inverse=True)
            _, g = gradients(model, found.take(used), at.reshape(mask.shape), mask, labels[owner[part]], weight[part])
            step += 1
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            rate = RATE * (1 - epoch / (epochs + 1))
            for k, x in g.items():
                m, v = moments[k]
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                model.weights[k] -= (rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5) + DECAY * model.weights[k])).astype(np.float32)
    if len(set(labels[kept_back])) == 2:
        texts, labels = [t for t, k in zip(texts, kept_back) if k], labels[kept_back]
    logit = Scorer(model)(texts)
    zeros, ones = totals or (int((1 - labels).sum()), int(labels.sum()))
    share = np.where(labels == 1, ones / labels.sum(), zeros / (1 - labels).sum()) * len(labels) / (zeros + ones)
    c = np.stack([logit, np.ones_like(logit)])

    def cost(v: np.ndarray) -> float:
        z = v @ c
        return float((share * (np.logaddexp(0, z) - labels * z)).sum() + 0.05 * ((v - [1, 0]) ** 2).sum())

    now = np.array([1.0, 0.0])
    for _ in range(30):  # Newton's method on the log loss of the texts, lightly held at 1 and 0
        p = _sigmoid(now @ c)
        step = np.linalg.solve((c * share * (p * (1 - p) + 1e-6)) @ c.T + 0.1 * np.eye(2), c @ (share * (p - labels)) + 0.1 * (now - [1, 0]))
        while cost(now - step) > cost(now) and abs(step).max() > 1e-9:
            step = step / 2
        now = now - step
    a, b = now
    model.scale, model.shift = float(max(a, 1e-3)), float(b)
    model.blank = (float(np.log(ones / zeros)) - model.shift) / model.scale
    return model, cost(np.array([model.scale, model.shift])) / len(labels)


class Scorer:
    """Logits of texts (the highest of their windows), with a bounded store of projected words."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.table = np.empty((0, 6 * UNITS), np.float32)

    def _lookup(self, split: list[list[bytes]]) -> np.ndarray:
        fresh = {w for words in split for w in words if w not in self.ids}
        if len(fresh) + len(self.ids) > CACHE_WORDS:
            self.ids, self.table = {}, self.table[:0]
            fresh = {w for words in split for w in words}
        if fresh:
            fresh = sorted(fresh)
            self.ids.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, self.model.projected(self.model.inputs(Features.of([spelling(w) for w in fresh], self.model.vocabulary)))])
        return np.fromiter((self.ids[w] for words in split for w in words), np.int64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        return self.highest(texts)[0]

    def highest(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """The highest logit of each text's windows, and where the first such window begins (0 without words)."""
        out, where = np.full(len(texts), self.model.empty()), [0] * len(texts)
        for part in runs([len(t) for t in texts], 400_000):
            split = [t.split() for t in texts[part]]
            flat = self._lookup(split)
            first = np.cumsum([0, *map(len, split)])
            windows: dict[int, list[tuple[int, int]]] = {}
            for i, words in enumerate(split):
                if words:
                    windows.setdefault(min(len(words), WINDOW), []).extend((i, s) for s in window_starts(len(words)))
            for steps, found in windows.items():
                owner, starts = np.array(found).T
                logit = np.concatenate([self.model.run(self.table, flat[first[owner[b : b + 512]] + starts[b : b + 512] + np.arange(steps)[:, None]]) for b in range(0, len(found), 512)])
                order = np.lexsort((starts, -logit, owner))
                top = order[np.r_[True, np.diff(owner[order]) > 0]]
                for i, x, s in zip(owner[top], logit[top], starts[top]):
                    out[part.start + i], where[part.start + i] = x, int(s)
        return out, where


def held_out(column: str = "doc_id"):
    """Rows that labels are not learnt from: crc32(id as text) mod 5 is 0; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit the model on labelled rows that are not held out, at most `rows` of either class, those whose doc_id
    has the least hash: the sample does not depend on how the tables are dealt out. Labels other than 0 and 1,
    null ids and labels without a document are ignored; of an id's repeated rows all count."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.withColumn("_h", F.xxhash64("doc_id"))
    totals = {x["toxic"]: x["count"] for x in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == c).orderBy("_h", "doc_id").limit(rows) for c in (0, 1)]
    # The picked ids are at most 2 * rows, so the other side is not shuffled.
    sample = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1]).distinct()), "doc_id")
    sizes = (totals.get(0, 0), totals.get(1, 0))

    def fitted(found: pa.Table) -> Model:
        found = found.to_pandas().fillna({"text": ""}).sort_values(["doc_id", "text", "toxic"])
        return fit([t.encode() for t in found["text"]], [int(x) for x in found["toxic"]], sizes)

    return fitted_in_task(sample.select("doc_id", "text", "toxic"), fitted)


def with_scores(docs: DataFrame, model: Model, column: str = "text", to: str = "score") -> DataFrame:
    """Add `to`: the probability that the whole text is toxic. Null is scored as the empty text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in parts:
            yield pa.array(scorer.model.probability(scorer(byte_rows(texts))).astype(np.float64))

    return docs.withColumn(to, scored(F.col(column)))


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score under limit."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return with_scores(rows, train(docs if labelled_docs is None else labelled_docs, labels)).where(F.col("score") < limit).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, scored by a model of its labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
