"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy
from labelled spans; overlapping windows are decoded and their tags reconciled over the whole text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fitted_in_task
from tessera.llm.shingles import runs, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window and between windows; units in each direction; size of a character's input.
WINDOW, STRIDE, UNITS, DIM = 512, 464, 8, 6
#: The network is trained on spans in at most so many rows, those with the least hash of their id, and on as many
#: made-up spans of each kind as MADE_UP; windows of TRAIN_WINDOW characters.
SAMPLE_ROWS, MADE_UP, TRAIN_WINDOW = 2000, 220, 96
EPOCHS, BATCH, RATE, SEED = 16, 48, 0.02, 3
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The classes of characters; digits, these marks, and a few sets of letters.
MARKS = " \n\t@.-+()_%:=\"',;/#"
CLASSES = {c: 6 + i for i, c in enumerate("0123456789" + MARKS)}
N_CLASSES = 6 + len(CLASSES)
_ASCII = np.array([CLASSES.get(chr(i), 1 if chr(i) in "abcdef" else 2 if chr(i).islower() else 3 if chr(i).isupper() else 4) for i in range(128)], np.uint8)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost emails. All starts in a run before an "@" share their end, so the run's first one decides, and
    long runs without "@" cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by start, then kind as listed."""
    found = emails(text)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m[0])) if m.end() - m.start() < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(text: str) -> np.ndarray:
    """The class of each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _ASCII[np.minimum(points, 127)], 5).astype(np.uint8)


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def emissions(self, at: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Scores (steps, tags, windows) of windows of classes (steps, windows).

        Gates are kept as tanh of half their argument, so one call serves all of them."""
        w, (steps, n), k = self.weights, at.shape, len(KINDS) + 1
        x = w["chars"].T[:, at]  # (DIM, steps, windows)
        out = np.empty((steps, k, n), np.float32)
        joint = np.empty((UNITS + DIM + 1, n), np.float32)
        joint[-1] = 1
        gates = np.empty((4 * UNITS, n), np.float32)
        for way in (0, 1):
            m = np.ascontiguousarray(w[f"gates{way}"])
            tags = np.ascontiguousarray(w[f"tags{way}"])
            h, c, squashed, score = joint[:UNITS], np.zeros((UNITS, n), np.float32), np.empty((UNITS, n), np.float32), np.empty((k, n), np.float32)
            h[:] = 0
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                joint[UNITS:-1] = x[:, t]
                np.dot(m, joint, out=gates)
                np.tanh(gates, out=gates)
                if trace is not None:
                    before = joint.copy(), c.copy()
                new, rest = gates[:UNITS], gates[UNITS:]
                rest += 1
                rest *= 0.5
                i, f, o = rest[:UNITS], rest[UNITS : 2 * UNITS], rest[2 * UNITS :]
                if trace is not None:
                    kept = gates.copy()
                np.multiply(i, new, out=new)
                np.multiply(f, c, out=c)
                c += new
                np.tanh(c, out=squashed)
                np.multiply(o, squashed, out=h)
                if trace is not None:
                    trace.append((way, t, *before, kept, squashed.copy(), h.copy()))
                np.dot(tags, h, out=score)
                if way == 0:
                    out[t] = score
                else:
                    out[t] += score
        out += w["bias"][:, None]
        return out

    def decode(self, at: np.ndarray) -> dict[int, np.ndarray]:
        """The best tags of the windows that have any but 0."""
        e, w = self.emissions(at), self.weights
        open_ = np.flatnonzero(self._may_mark(e))
        found = self._decoded(np.ascontiguousarray(e[:, :, open_])) if len(open_) else {}
        return {int(open_[i]): tags for i, tags in found.items()}

    def _may_mark(self, e: np.ndarray) -> np.ndarray:
        """Whether a window can have a path better than that of 0 alone. The bound takes all tags but 0 as one,
        with the best of their scores and moves: if no run of it gains anything, no path does."""
        moves = self.weights["moves"] - self.weights["moves"][0, 0]
        enter, stay, leave = moves[0, 1:].max(), moves[1:, 1:].max(), max(0.0, float(moves[1:, 0].max()))
        gain = e[:, 1:].max(1) - e[:, 0]
        run = gain[0] + (self.weights["first"][1:].max() - self.weights["first"][0])
        top = run.copy()
        for t in range(1, len(gain)):
            np.add(run, stay, out=run)
            np.maximum(run, enter, out=run)
            run += gain[t]
            np.maximum(top, run, out=top)
        return top + leave > 0

    def _decoded(self, e: np.ndarray) -> dict[int, np.ndarray]:
        w = self.weights
        moves, (steps, k, n) = w["moves"][:, :, None], e.shape  # from, to
        best = np.empty_like(e)
        best[0] = e[0] + w["first"][:, None]
        reach = np.empty((k, k, n), np.float32)
        plain = best[0, 0].copy()
        for t in range(1, steps):
            np.add(best[t - 1][:, None], moves, out=reach)
            np.max(reach, axis=0, out=best[t])
            best[t] += e[t]
            plain += e[t, 0] + w["moves"][0, 0]
        marked = np.flatnonzero(best[-1].max(0) > plain + 1e-4)
        if not len(marked):
            return {}
        tags = np.empty((steps, len(marked)), np.int8)
        tags[-1] = best[-1][:, marked].argmax(0)
        for t in range(steps - 2, -1, -1):
            tags[t] = (best[t][:, marked] + w["moves"][:, tags[t + 1]]).argmax(0)
        return {int(i): tags[:, j] for j, i in enumerate(marked)}


def fresh_model(seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
    k = len(KINDS) + 1
    w = {"chars": draw(N_CLASSES, DIM, by=0.5), "bias": np.zeros(k, np.float32), "moves": np.zeros((k, k), np.float32), "first": np.zeros(k, np.float32)}
    for way in (0, 1):
        w[f"gates{way}"] = draw(4 * UNITS, UNITS + DIM + 1, by=0.3)
        w[f"gates{way}"][2 * UNITS : 3 * UNITS, -1] = 0.5  # remember at first
        w[f"tags{way}"] = draw(k, UNITS, by=0.3)
    return Model(w)


def gradients(model: Model, at: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of tags (steps, windows) under the CRF, and its gradients."""
    w, trace = model.weights, []
    e = model.emissions(at, trace)
    steps, k, n = e.shape
    fore, back = np.empty(e.shape), np.zeros(e.shape)
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    moves = w["moves"].astype(np.float64)[:, :, None]
    fore[0] = e[0] + w["first"][:, None]
    for t in range(1, steps):
        fore[t] = lse(fore[t - 1][:, None] + moves, 0) + e[t]
    for t in range(steps - 2, -1, -1):
        back[t] = lse(moves + (e[t + 1] + back[t + 1])[None], 1)
    total = lse(fore[-1], 0)
    gold = np.zeros(e.shape)
    np.put_along_axis(gold, tags[:, None], 1, 1)
    score = (gold * e).sum((0, 1)) + w["first"][tags[0]] + sum(w["moves"][tags[t - 1], tags[t]] for t in range(1, steps))
    loss = float((total - score).mean())
    d_e = ((np.exp(fore + back - total) - gold) / n).astype(np.float32)
    g = {"bias": d_e.sum((0, 2)), "first": d_e[0].sum(1), "moves": np.zeros((k, k))}
    for t in range(1, steps):
        g["moves"] += np.exp(fore[t - 1][:, None] + moves + (e[t] + back[t])[None] - total).sum(2) / n
        np.add.at(g["moves"], (tags[t - 1], tags[t]), -1 / n)
    d_chars = np.zeros_like(w["chars"])
    for way in (0, 1):
        g[f"gates{way}"], g[f"tags{way}"] = np.zeros_like(w[f"gates{way}"]), np.zeros_like(w[f"tags{way}"])
    flow = [[np.zeros((UNITS, n), np.float32), np.zeros((UNITS, n), np.float32)] for _ in (0, 1)]
    for way, t, joint, c_old, gate, squashed, h in reversed(trace):
        new, i, f, o = (gate[j * UNITS : (j + 1) * UNITS] for j in range(4))
        g[f"tags{way}"] += d_e[t] @ h.T
        d_h = flow[way][0] + w[f"tags{way}"].T @ d_e[t]
        d_c = flow[way][1] + d_h * o * (1 - squashed**2)
        # i, f and o are (1 + tanh) / 2 of their argument, so their slope is 2 x (1 - x)
        d_a = np.concatenate([d_c * i * (1 - new**2), d_c * new * 2 * i * (1 - i), d_c * c_old * 2 * f * (1 - f), d_h * squashed * 2 * o * (1 - o)])
        g[f"gates{way}"] += d_a @ joint.T
        d_joint = w[f"gates{way}"].T @ d_a
        flow[way] = [d_joint[:UNITS], d_c * f]
        np.add.at(d_chars, at[t], d_joint[UNITS:-1].T)
    g["chars"] = d_chars
    return loss, g


def made_up(rng: np.random.Generator, n: int = MADE_UP) -> list[tuple[str, str]]:
    """(kind, span) of n spans of each kind as people write them: as the patterns have them, and as they have not,
    with "at" and "dot", brackets, other marks between groups, or without a country's number."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    name = lambda a, b: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(a, b)))
    pick = lambda *x: str(x[int(rng.integers(0, len(x)))])
    out: list[tuple[str, str]] = []
    for _ in range(n):
        at, dot = pick("@", "@", " at ", " [at] ", "(at)", " @ ", "[at]", " (at) "), pick(".", ".", " dot ", "[.]", "(dot)", " [dot] ", "[dot]")
        if at == " at " and dot == ".":
            dot = " dot "
        user = f"{name(2, 9)}{pick('', '.', '_', '-')}{pick(digits(2), name(1, 7), '')}".rstrip("._-")
        out.append(("email", f"{user}{at}{name(3, 9)}{pick('', digits(1))}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'io')}"))
        out.append(("ip", pick(".", "[.]", " . ", "(.)", "[dot]", " dot ").join(str(x) for x in rng.integers(0, 256, 4))))
        card = pick("4", "5", "3") + digits(14)
        card += next(c for c in "0123456789" if luhn(card + c))
        out.append(("card", pick("", " ", "-", ".", "/", "  ", "_", " - ").join(card[i : i + 4] for i in range(0, 16, 4))))
        a, b, c = digits(3), digits(3), digits(4)
        out.append(("phone", pick(f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{digits(2)} {a} {b}{c}", f"00{digits(2)} {a} {b}{c}", f"+{digits(2)}/{a}/{b}{c}")))
    return out


def _other_use(rng: np.random.Generator) -> str:
    """Digits and words that are no personal data: versions, years, amounts, keys, "at" and "dot" in a sentence."""
    name = lambda a, b: "".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(a, b)))
    n = lambda a, b: int(rng.integers(a, b))
    every = [f"{n(0, 9)}.{n(0, 9)}", str(n(1, 99999)), f"{n(1900, 2100)}-{n(1, 12):02}-{n(1, 28):02}", 'token = "' + rng.bytes(16).hex() + '"', "password=" + rng.bytes(8).hex(), f"{n(0, 99)}%", f"x{n(0, 9999)}", f"{name(3, 8)} at {name(2, 7)} {name(2, 7)}", f"a dot {name(3, 7)}", f"{n(1, 24):02}:{n(0, 60):02}", f"{n(1, 999)},{n(0, 999):03}", f"v{n(0, 9)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", f"({n(1, 99)})", f"[{n(1, 99)}]", f"{n(1, 9)}-{n(1, 99)}", f"@{name(3, 9)}", f"{name(3, 8)} (at {name(2, 6)})", str(n(10**9, 10**11))]
    return every[n(0, len(every))]


def fit(texts: list[str], seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Train on the spans that the exact patterns find in texts, on made-up spans put between their words, and on
    windows without any, those with digits and marks first."""
    rng, model = np.random.default_rng(seed), fresh_model(seed)
    windows: list[tuple[np.ndarray, np.ndarray]] = []

    def add(text: str, spans: list[Span], at: int) -> None:
        tags = np.zeros(len(text), np.int64)
        for start, end, kind in spans:
            tags[start:end] = 1 + KINDS.index(kind)
        start = max(0, min(at, len(text) - TRAIN_WINDOW))
        cut, own = codes(text[start : start + TRAIN_WINDOW]), tags[start : start + TRAIN_WINDOW]
        pad = TRAIN_WINDOW - len(cut)
        windows.append((np.pad(cut, (0, pad)), np.pad(own, (0, pad))))

    odd = re.compile(r"[0-9@+][^\n]{0,20}")
    plain = [t for t in texts if t.strip()] or ["a text of words"]
    for text in plain:
        spans = base_spans(text)
        for start, end, _ in spans[:4]:
            add(text, spans, start - int(rng.integers(0, max(1, TRAIN_WINDOW - (end - start)))))
        for m in [m for m in odd.finditer(text) if not any(s < m.end() and m.start() < e for s, e, _ in spans)][:3]:
            add(text, spans, m.start() - int(rng.integers(0, TRAIN_WINDOW)))
    for _ in range(400):
        text = plain[int(rng.integers(0, len(plain)))]
        add(text, base_spans(text), int(rng.integers(0, len(text))))
    # Spans that the patterns miss come twice, as no text of the corpus lends any.
    spans = made_up(rng)
    spans += [(kind, span) for kind, span in spans if (0, len(span), kind) not in base_spans(span)]
    for kind, span in [*spans, *(("", _other_use(rng)) for _ in range(3 * MADE_UP))]:
        text = plain[int(rng.integers(0, len(plain)))]
        at = text.find(" ", int(rng.integers(0, len(text)))) + 1
        before, after = text[max(0, at - 150) : at], text[at : at + 150]
        joined = f"{before}{span}{rng.choice([' ', ' ', ', ', '. ', chr(10)])}{after}"
        own = [s for s in base_spans(joined) if s[1] <= len(before) or s[0] >= len(before) + len(span)]
        add(joined, [*own, *[(len(before), len(before) + len(span), kind)][: len(kind)]], len(before) - int(rng.integers(0, TRAIN_WINDOW - 30)))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for b in range(0, len(order), BATCH):
            part = [windows[j] for j in order[b : b + BATCH]]
            _, g = gradients(model, np.stack([x for x, _ in part], 1), np.stack([y for _, y in part], 1))
            step += 1
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            for k, x in g.items():
                m, v = moments[k]
                x = (x * min(1.0, 5.0 / max(norm, 1e-9))).astype(np.float32)
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                model.weights[k] -= (RATE * (1 - epoch / (epochs + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n characters; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _runs_of_tags(tags: np.ndarray, text: str) -> list[Span]:
    edges = np.flatnonzero(np.diff(np.r_[0, tags, 0]))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        if tags[a]:
            own = text[a:b]
            a, b = int(a) + len(own) - len(own.lstrip(" \n,;:.")), int(b) - (len(own) - len(own.rstrip(" \n,;:.")))
            if a < b:
                out.append((a, b, KINDS[tags[a] - 1]))
    return out


NUMBERS = re.compile("[0-9]+")
SIGN, POINT = re.compile(r"@|(?i:\bat\b)"), re.compile(r"\.|(?i:\bdot\b)")


def _plausible(text: str, span: Span) -> bool:
    """Whether a decoded span has what its kind needs, however written: a sign "at" with a point behind it, four
    small numbers, check digits, enough digits."""
    own = text[span[0] : span[1]]
    digits = "".join(DIGIT.findall(own))
    if span[2] == "email":
        sign = SIGN.search(own, 1)
        return bool(sign and POINT.search(own, sign.end(), len(own) - 1))
    if span[2] == "ip":
        return len(parts := NUMBERS.findall(own)) == 4 and all(int(x) <= 255 for x in parts)
    return 12 <= len(digits) <= 19 and luhn(digits) if span[2] == "card" else 9 <= len(digits) <= 15


def decoded_spans(model: Model, texts: list[str]) -> list[list[Span]]:
    """Spans that the network finds. Windows are decoded one by one; where two overlap, each tag comes from the
    window in which the character stands farther from the edge, and runs of tags over the text become spans."""
    windows: dict[int, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        if text:
            windows.setdefault(min(len(text), WINDOW), []).extend((i, s) for s in window_starts(len(text)))
    coded = np.concatenate([codes(t) for t in texts]) if texts else np.empty(0, np.uint8)
    first = np.cumsum([0, *map(len, texts)])
    marked: dict[int, list[tuple[int, np.ndarray]]] = {}
    short: list[tuple[int, int, int]] = sorted((n, i, s) for n, found in windows.items() if n < WINDOW for i, s in found)
    # Short texts run together with the next longer ones, filled up with class 0, which training has seen.
    batches = [(WINDOW, windows.get(WINDOW, [])[b : b + 512]) for b in range(0, len(windows.get(WINDOW, [])), 512)]
    batches += [(part[-1][0], [(i, s) for _, i, s in part]) for part in (short[b : b + 64] for b in range(0, len(short), 64))]
    padded = np.r_[coded, np.zeros(WINDOW, np.uint8)]
    for steps, found in batches:
        owner, starts = np.array(found).T
        at = padded[first[owner] + starts + np.arange(steps)[:, None]]
        at[np.arange(steps)[:, None] >= np.diff(first)[owner] - starts] = 0
        for j, tags in model.decode(at).items():
            marked.setdefault(int(owner[j]), []).append((int(starts[j]), tags))
    out: list[list[Span]] = [[] for _ in texts]
    for i, found in marked.items():
        n = len(texts[i])
        tags = np.zeros(n, np.int8)
        starts = window_starts(n)
        by_start = dict(found)
        for k, s in enumerate(starts):
            end = min(n, s + WINDOW)
            a = s if k == 0 else (s + min(n, starts[k - 1] + WINDOW)) // 2
            b = end if k + 1 == len(starts) else (starts[k + 1] + end) // 2
            if s in by_start:
                tags[a:b] = by_start[s][a - s : b - s]
        out[i] = [s for s in _runs_of_tags(tags, texts[i]) if _plausible(texts[i], s)]
    return out


def all_spans(base: list[Span], decoded: list[Span]) -> list[Span]:
    """The base spans and those decoded ones that touch none of them."""
    added = [s for s in decoded if all(s[1] <= a or s[0] >= b for a, b, _ in base)]
    return sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2])))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit the network on at most `rows` rows, those whose doc_id has the least hash; null ids are not taken."""
    small_batches(docs.sparkSession)
    picked = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id").orderBy("doc_id", "text").limit(rows)

    def fitted(found: pa.Table) -> Model:
        return fit([t for _, t in sorted((i, t or "") for i, t in zip(found["doc_id"].to_pylist(), found["text"].to_pylist()))])

    return fitted_in_task(sample, fitted)


def with_spans(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Add base and spans (arrays of kind, start, end in code points, end exclusive): what the exact patterns find
    in the whole text, and these with what the network adds. Null is taken as the empty text, which has none."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def found(texts: pa.Array) -> pa.Array:
        own, base, spans = [t or "" for t in texts.to_pylist()], [], []
        for part in runs([len(t) for t in own], 1_000_000):
            exact = [base_spans(t) for t in own[part]]
            base += exact
            spans += map(all_spans, exact, decoded_spans(held.value, own[part]))
        as_rows = lambda x: pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in x], kind)
        return pa.StructArray.from_arrays([as_rows(base), as_rows(spans)], names=["base", "spans"])

    kept = [c for c in docs.columns if c not in ("base", "spans")]  # columns of these names are replaced
    both = docs.select(F.struct(*docs.columns).alias("row"), found(F.col(column)).alias("both"))
    return both.select(*(F.col("row")[c].alias(c) for c in kept), "both.*")


def mask(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, replaced by [KIND] of the first."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the personal data in text replaced by placeholders; null texts stay null."""
    held = with_spans(docs.select(F.struct(*docs.columns).alias("row"), "text"), model or train(docs))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([t if not s or t is None else mask(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return held.withColumn("text", without("text", "spans")).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def listed(column: str):
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(F.col(column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs, train(docs))
    counted = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
