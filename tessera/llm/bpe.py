"""BPE encoding and decoding by speculation: a greedy longest match proposes tokens, vectorised checks test every
adjacent pair, and only words with a failing pair are merged exactly."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import small_batches

# The pieces into which a word is cut, and white space as Unicode has it (str.split() has four more).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
EXTRA_SPACES = regex.compile("[\x1c-\x1f]")
END = "</w>"
PIECES_OF_LINES = regex.compile(PIECE + "|\n")
#: Pieces kept with their ids in each Python worker; at more the store starts anew.
CACHE_PIECES = 100_000
#: Bytes of texts in one step: the arrays that a step needs are many times as large.
SLICE_BYTES = 1_000_000
#: Longer pieces are merged with a heap, shorter ones so many at a time in a matrix.
SHORT_PIECE, ROWS = 40, 4096
NEVER = np.int64(2**62)
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    return [rest.get(b, chr(b)) for b in range(256)]


def default_path() -> str:
    """The tokenizer file of the production queries; imported late, as it is a setting, not a need."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Encodes and decodes with a vocabulary of BPE tokens with word ends, as the file at path describes it."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.vocab = vocab
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.n = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.n
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)))
        letters = _byte_letters()
        self.spelt = dict(enumerate(letters)) | {10: "\n"}  # a line's end stands for the end of a word
        self.proposer = ahocorasick.Automaton()
        self.token_chars = np.zeros(self.n, np.int64)
        for t, i in vocab.items():
            t = t[: -len(END)] + "\n" if t.endswith(END) else t
            self.proposer.add_word(t, i)
            self.token_chars[i] = len(t)
        self.proposer.make_automaton()
        self.single = np.zeros((2, 1 + max(map(ord, letters))), np.int64)  # tokens of one letter: inside, at the end
        for c in letters:
            self.single[:, ord(c)] = vocab[c], vocab[c + END]
        self.ranks: dict[int, int] = {}  # a pair as one number: its rank and the token it makes, as one too
        left, right, born = (np.full(self.n, x, np.int64) for x in (-1, -1, -1))
        for rank, (a, b) in enumerate(merges):
            ia, ib, made = vocab[a], vocab[b], vocab[a + b]
            self.ranks[ia << 20 | ib] = rank << 20 | made
            if left[made] < 0:
                left[made], right[made], born[made] = ia, ib, rank
        self.left, self.right, self.born = left, right, born
        self.bits = max(4, (4 * len(self.ranks)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int64)
        todo, values = np.fromiter(self.ranks, np.int64, len(self.ranks)), np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        slot = self._slot(todo)
        while len(todo):  # of the pairs that ask for a free slot one gets it, the others ask for the next slot
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            mine = self.slots[slot] == todo
            self.values[slot[mine]] = values[mine]
            todo, values, slot = todo[~mine], values[~mine], (slot[~mine] + 1) & (len(self.slots) - 1)
        self.cache: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Let go of all pieces kept."""
        self.cache.clear()
        self.flat, self.starts, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair a, b: rank << 20 | the token it makes, or NEVER; a or b may be -1 for none."""
        pairs = (a << 20 | b).ravel()
        slot = self._slot(pairs)
        held, out = self.slots[slot], self.values[slot]
        open_ = np.flatnonzero(held != pairs)
        out[open_] = NEVER
        open_ = open_[held[open_] >= 0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            held = self.slots[slot[open_]]
            hit = held == pairs[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        out[pairs < 0] = NEVER
        return out.reshape(a.shape)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours a, b: whether no merge crosses their boundary while they are built.

        The pieces at the boundary run down the right edge of a's merge tree and the left edge of b's. Two
        of them stand side by side until the first of their parents is made; a merge of the two that comes
        before that joins them. Equal ranks go from left to right."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_dies, y_dies = (np.full(len(x), NEVER) for _ in range(2))
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            found = self._merge_of(x[open_], y[open_])
            rank = found >> 20
            bad = (rank < x_dies[open_]) & (rank <= y_dies[open_]) & (found != NEVER)
            good[open_[bad]] = False
            open_ = open_[~bad]
            bx, by = self.born[x[open_]], self.born[y[open_]]
            back_x = bx >= by  # the younger piece is the one to take apart
            live = (bx >= 0) | (by >= 0)
            ix, iy = open_[live & back_x], open_[live & ~back_x]
            x_dies[ix], y_dies[iy] = self.born[x[ix]], self.born[y[iy]]
            x[ix], y[iy] = self.right[x[ix]], self.left[y[iy]]
            open_ = open_[live]
        return good

    def merged(self, ids: list[int]) -> list[int]:
        """Exact merging of the letters of one piece: always the pair of least rank, of equal ones the leftmost."""
        n = len(ids)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [(ranks[p], i, p) for i, p in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            made, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair >> 20 or j >= n or ids[j] != pair & 0xFFFFF:
                continue
            ids[i], ids[j] = made & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (pair := ids[k] << 20 | ids[after[k]]) in ranks:
                    heapq.heappush(heap, (ranks[pair], k, pair))
        return [x for x in ids if x >= 0]

    def _merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """Exact merging of many short pieces at once: rows of letters' tokens, filled up with -1."""
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], 1)
        found = self._merge_of(ids[:, :-1], ids[:, 1:])
        live, columns = np.arange(len(ids)), np.arange(ids.shape[1])
        while True:
            at = found[live].argmin(1)
            least = found[live, at]
            live, at, least = (x[least != NEVER] for x in (live, at, least))
            if not len(live):
                return ids
            take = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            own = np.take_along_axis(ids[live], take, 1)  # the last column is -1 in every row
            pairs = np.take_along_axis(found[live], take[:, :-1].clip(max=len(columns) - 2), 1)
            rows = np.arange(len(live))
            own[rows, at] = least & 0xFFFFF
            pairs[rows, at] = self._merge_of(own[rows, at], own[rows, at + 1])
            inner = np.flatnonzero(at > 0)
            pairs[inner, at[inner] - 1] = self._merge_of(own[inner, at[inner] - 1], own[inner, at[inner]])
            ids[live], found[live] = own, pairs

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of words (without line ends): all ids, and the start and number of those of each piece.

        The longest tokens from left to right are the proposal; a piece fails if two neighbours of it are not
        compatible, or if no token ends the word."""
        if not pieces:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        text = ("\n".join(pieces) + "\n").encode().decode("latin-1").translate(self.spelt)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.flatnonzero(points == 10)
        sizes = np.diff(np.r_[-1, ends])  # with the line end
        at, flat = np.fromiter(chain.from_iterable(self.proposer.iter_long(text)), np.int64).reshape(-1, 2).T
        owner = np.searchsorted(ends, at)
        lens = np.bincount(owner, minlength=len(pieces))
        fails = np.bincount(owner, self.token_chars[flat], minlength=len(pieces)) != sizes
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
        fails[owner[inner[~self.compatible(pairs >> 20, pairs & 0xFFFFF)[back]]]] = True
        starts = np.cumsum(lens) - lens
        bad = np.flatnonzero(fails)
        if not len(bad):
            return flat, starts, lens
        bad = bad[np.argsort(sizes[bad], kind="stable")]
        more, filled = [flat], len(flat)
        for b in range(0, int(np.searchsorted(sizes[bad], SHORT_PIECE + 2)), ROWS):
            part = bad[b : b + ROWS]
            part = part[sizes[part] <= SHORT_PIECE + 1]
            n = sizes[part, None] - 1
            column = np.arange(n.max())
            letters = points[np.minimum((ends[part, None] - n) + column, len(points) - 1)]
            ids = self._merged_rows(np.where(column < n, self.single[(column == n - 1).astype(np.int64), np.minimum(letters, self.single.shape[1] - 1)], -1))
            there = ids >= 0
            lens[part] = there.sum(1)
            starts[part] = filled + np.cumsum(lens[part]) - lens[part]
            more.append(ids[there])
            filled += len(more[-1])
        for i in bad[sizes[bad] > SHORT_PIECE + 1]:
            letters = points[ends[i] - sizes[i] + 1 : ends[i]]
            more.append(np.array(self.merged([*self.single[0, letters[:-1]].tolist(), int(self.single[1, letters[-1]])]), np.int64))
            starts[i], lens[i] = filled, len(more[-1])
            filled += len(more[-1])
        return np.concatenate(more), starts, lens

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the store."""
        ids, starts, lens = self.encode_pieces(pieces)
        self.cache.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts, self.lens = np.r_[self.starts, len(self.flat) + starts], np.r_[self.lens, lens]
        self.flat = np.r_[self.flat, ids.astype(np.int32)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (runs without white space; special tokens after a NUL), and the offsets of the words."""
        low = unicodedata.normalize("NFC", "\n".join(words)).replace("Σ", "σ").lower().split("\n")
        special = [i for i, w in enumerate(words) if w[:1] == "\0" and w[1:] in self.special]
        for i in special:
            low[i] = ""
        whole = [w.isascii() and w.isalpha() for w in low]
        own, pieces = np.ones(len(words), np.int64), low  # pieces of each word
        if not all(whole):
            cut = PIECES_OF_LINES.findall("\n".join([w for w, one in zip(low, whole) if not one]) + "\n")
            line_ends = np.fromiter((i for i, p in enumerate(cut) if p == "\n"), np.int64)
            own[~np.array(whole)] = np.diff(np.r_[-1, line_ends]) - 1
            rows = iter([p for p in cut if p != "\n"])
            pieces = list(chain.from_iterable((w,) if one else islice(rows, n) for w, one, n in zip(low, whole, own.tolist())))
        every = set(pieces)
        fresh = every - self.cache.keys()
        if len(fresh) + len(self.cache) > CACHE_PIECES:
            self.forget()
            fresh = every
        self._learn(list(fresh))
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        flat, ends = _taken(self.flat, self.starts[at], self.lens[at])
        offsets = ends[np.r_[0, np.cumsum(own)]]
        if special:
            flat = np.insert(flat, offsets[special], [self.special[words[i][1:]] for i in special])
            more = np.zeros(len(words), np.int64)
            more[special] = 1
            offsets = offsets + np.r_[0, np.cumsum(more)]
        return flat, offsets

    def _words(self, text: str) -> list[str]:
        words = text.split() if not EXTRA_SPACES.search(text) else [w for w in SPACES.split(text) if w]
        return words

    def _split(self, text: str) -> list[str]:
        """Words and, as they stand, special tokens."""
        if "<|" not in text or not self.cut.search(text):
            return self._words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._words(text[at : m.start()]), "\0" + m[0]]  # no word holds a special token after a NUL
            at = m.end()
        return out + self._words(text[at:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings or nulls) in a row, and the offsets of the texts."""
        texts = texts.cast(pa.string()).fill_null("")
        if pc.any(pc.match_substring_regex(texts, r"<\||[\x1c-\x1f]")).as_py():
            split = pa.array([self._split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.utf8_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        flat, offsets = self._of_words(words.dictionary.to_pylist())
        at = words.indices.to_numpy()
        out, ends = _taken(flat, offsets[at], np.diff(offsets)[at])
        return out, ends[np.r_[0, np.cumsum(split.value_lengths().to_numpy())]]


def _taken(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat with these starts and lengths in a row, and their offsets."""
    ends = np.r_[0, np.cumsum(lens)]
    return flat[np.repeat(starts - ends[:-1], lens) + np.arange(ends[-1])], ends


class Decoder:
    """The tokens of the file at path, as bytes."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        found = [*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]
        self.n = max(i for _, i in found) + 1
        utf8 = [b""] * self.n
        for token, i in found:
            utf8[i] = token.encode()
        self.token_len = np.array([len(t) for t in utf8], np.int64)
        self.token_start = np.r_[0, np.cumsum(self.token_len)[:-1]]
        self.token_bytes = np.frombuffer(b"".join(utf8), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of the tokens of each text, joined by one space, and their offsets."""
        lens = self.token_len[ids] + 1
        ends = np.r_[0, np.cumsum(lens)]
        out = np.full(ends[-1], 32, np.uint8)
        at = np.repeat(self.token_start[ids] - ends[:-1], lens - 1)
        to = np.arange(ends[-1]) if len(ids) else np.empty(0, np.int64)
        to = np.delete(to, ends[1:] - 1)
        out[to] = self.token_bytes[at + to]
        last = ends[offsets[1:]][np.diff(offsets) > 0] - 1  # no space after a text's last token
        n = ends[offsets] - np.r_[0, np.cumsum(np.diff(offsets) > 0)]
        return np.delete(out, last), n


_LOADED: dict[tuple[type, str], WordBpe | Decoder] = {}


def model_of(path: str, kind: type = WordBpe) -> WordBpe | Decoder:
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def tidy() -> None:
    """Let go of pieces kept and of free Arrow memory: the worker may serve other work next."""
    for model in _LOADED.values():
        if isinstance(model, WordBpe):
            model.forget()
    pa.default_memory_pool().release_unused()


def _slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows with about so many bytes, to bound what one step holds."""
    sizes = np.r_[0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most)))
        yield texts.slice(at, end - at)
        at = end


NO_IDS = pa.array([], pa.list_(pa.int32()))


def _ids(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def encode(df: DataFrame, path: str | None = None, column: str = "text", to: str = "ids") -> DataFrame:
    """Add `to` (array<int>): the ids of the text; a column of that name is replaced.

    Whole texts are encoded; special tokens that stand in a text are encoded as such; null and empty texts give
    an empty array. Equal texts give equal ids, rows are independent, and an empty table gives an empty one."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def encoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for texts in parts:
            yield pa.concat_arrays([NO_IDS, *(_ids(*model.encode(x)) for x in _slices(texts))])
        tidy()

    return df.withColumn(to, encoded(F.col(column)))


def decode(df: DataFrame, path: str | None = None, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add `to` (string): the tokens of the ids, joined by one space, as the vocabulary's file has no decoder.
    Null or empty ids give the empty string; a null id, or one outside the vocabulary, is left out."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def decoded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path, Decoder)
        for lists in parts:
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            good = (ids >= 0) & (ids < model.n)
            if not good.all():
                counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[good], minlength=len(counts))
                ids = ids[good]
            yield _strings(*model.decode(ids, np.r_[0, np.cumsum(counts)].astype(np.int64)))
        tidy()

    return df.withColumn(to, decoded(F.col(column)))


def round_trip(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Add ids and decoded, as encode() and then decode() do, by one Python worker a task instead of two;
    columns of these names are replaced."""
    path = path or default_path()
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def there_and_back(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to_ids, to_text = model_of(path), model_of(path, Decoder)
        for texts in parts:
            ids, decoded = [NO_IDS], [pa.array([], pa.string())]
            for x in _slices(texts):
                found, offsets = to_ids.encode(x)
                ids.append(_ids(found, offsets))
                decoded.append(_strings(*to_text.decode(found, offsets)))
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(decoded)], names=["ids", "decoded"])
        tidy()

    kept = [F.col(c) for c in df.columns if c not in ("ids", "decoded")]
    both = df.select(F.struct(*kept).alias("row"), there_and_back(F.col(column)).alias("both"))
    return both.select("row.*", "both.*")


def ids_text(column: str = "ids") -> Column:
    """The ids in decimal, joined by one space."""
    return F.array_join(F.col(column).cast("array<string>"), " ")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded again, as digests."""
    done = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
