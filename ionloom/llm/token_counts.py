"""Token counts by a tokenizer compiled to a finite-state transducer.

A byte-pair tokenization is right exactly when every two neighbouring tokens are what the merge rule makes of
their two strings alone: no merge crosses their border, and what goes on inside them does not depend on the rest.
So the last token of a prefix decides how the prefix can go on, and a state needs only

* the longest end of the text read that begins some longer piece (no piece to come reaches further back),
* the last token of the prefix at each border in that end where a piece may begin (tokens that let the same pieces
  follow stand for each other), and how many tokens fewer that prefix has than the text read.

These states are finite in number. Reading a character leads to one next state, and the transition is annotated with
the tokens it emits: how many more (or fewer, when it joins some) the longer prefix has. Transitions are compiled when
first met, into a hash table of state and class of character: one class per character that longer pieces contain, one for
characters that are pieces by themselves only, one per number of bytes for those without a piece, one for the start
of a text.

A task reads its texts as one long string cut into chunks of equal length, whatever lies at the cuts, and reads all
chunks side by side. A chunk's state map says for each state in which the chunk before it can end where this one ends.
Chunks are read from the root first and from the other entries until the path meets the first one, in practice at the
next blank; further entries follow until every end of a chunk is an entry of the next. The maps then compose by a
parallel prefix scan, which gives each chunk its true entry and each text its count. Texts of any length
pass in segments with the state carried over, so memory is bounded; nothing is shuffled.

A null or empty text has no bytes and no tokens. Repeated rows are counted each; a null doc_id is kept. An empty table
gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import claim_caches, documents, text_or_empty, text_slices
from ionloom.llm.pieces import MARK, Vocabulary, default_model

#: Texts of more tokens than this are marked.
LIMIT = 4096
#: Characters that are read together, and characters of a chunk.
SEGMENT, CHUNK = 1 << 18, 128
#: Beyond so many states the table is begun anew after the segment; bounds memory, not results.
STATES = 200_000
#: Tokens are told apart by the pieces they let follow where at most so many come into question, else by how they are merged.
ASKED = 8
#: Pairs of tokens whose test is remembered.
PAIRS = 200_000
#: Places of the hash table, as a power of two; a segment adds at most SEGMENT transitions to the 2 ** 20 it may begin with.
PLACES = 21
_SPREAD = 0x9E3779B97F4A7C15 - (1 << 64)  # a fixed odd number that spreads keys over places

_NEW_TEXT, _PIECE, _MISSING = 0, 1, 2  # classes; _MISSING + 1 to 4 for one to four bytes
_FIRST = 7
ROOT = 0
State = tuple[str, tuple, tuple]


class Transducer:
    """The compiled tokenizer of one vocabulary: `next` and `emits` at the place of a state and a class of character."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = {p for p, (number, _) in vocabulary.pieces.items() if vocabulary.merge(p) == [number]}
        self.sorted = sorted(self.pieces)
        self.heads = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.begins = self.heads | self.pieces
        self.chars = sorted({c for p in vocabulary.pieces if len(p) > 1 for c in p} | {MARK})
        self.width = _FIRST + len(self.chars)
        classes = np.full(0x110000, _MISSING + 4, np.int16)
        for size, below in ((3, 0x10000), (2, 0x800), (1, 0x80)):
            classes[:below] = _MISSING + (size if vocabulary.byte_ids else 1)
        if not vocabulary.byte_ids:
            classes[:] = _MISSING + 1
        for piece in vocabulary.pieces:
            if len(piece) == 1:
                classes[ord(piece)] = _PIECE
        for number, char in enumerate(self.chars):
            classes[ord(char)] = _FIRST + number
        classes[ord(" ")] = classes[ord(MARK)]
        self.classes, self.mark = classes, int(classes[ord(MARK)])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states but the root, and all pairs of tokens looked at."""
        self.pairs.clear()
        self.edges: dict[str, tuple] = {}
        self.classes_of: dict[tuple[str, str], str | None] = {}
        self.representatives: dict[tuple, str] = {}
        self.keys: list[State] = []
        self.numbers: dict[State, int] = {}
        self.stored = 0
        self.at = np.full(1 << PLACES, -1, np.int64)
        self.next = np.zeros(1 << PLACES, np.int32)
        self.emits = np.zeros(1 << PLACES, np.int8)
        self.number(("", (None,), (0,)))

    def number(self, key: State) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.keys)
            self.keys.append(key)
        return found

    def follows(self, token: str | None, piece: str) -> bool:
        """Whether the merge rule leaves `token` and `piece` side by side; None is a border no merge crosses."""
        if token is None:
            return True
        found = self.pairs.get((token, piece))
        if found is None and not any(symbol + piece[:n] in self.pieces for symbol, _, _ in self.edge(token) for n in range(1, len(piece) + 1)):
            return True
        if found is None:
            ids = self.vocabulary.pieces
            found = self.vocabulary.merge(token + piece) == [*self.single(token), ids[piece][0]]
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[token, piece] = found
        return found

    def edge(self, token: str) -> tuple[tuple[str, float, float], ...]:
        """The symbols that stand at the right end of `token` while it is merged, each with its time of coming and going.

        Merges go by descending score; one that only becomes possible after a worse one follows it at once, so the
        time of a merge is the worst score up to it.
        """
        found = self.edges.get(token)
        if found is None:
            scores, symbols, time = self.vocabulary.pieces, list(token), math.inf
            out, since = [], math.inf
            while len(symbols) > 1:
                joined = [symbols[i] + symbols[i + 1] for i in range(len(symbols) - 1)]
                best = max(range(len(joined)), key=lambda i: (scores[joined[i]][1] if joined[i] in scores else -math.inf, -i))
                if joined[best] not in scores:
                    break
                time = min(time, scores[joined[best]][1])
                if best == len(joined) - 1:
                    out.append((symbols[-1], since, time))
                    since = time
                symbols[best : best + 2] = [joined[best]]
            found = self.edges[token] = (*out, (symbols[-1], since, -math.inf))
        return found

    def canonical(self, token: str | None, known: str) -> str | None:
        """A token that stands for all that bear alike on pieces that begin with `known`; None if no merge can cross the border.

        A merge crosses the border only from a symbol at the end of `token` that some piece continues with `known`. Tokens
        with the same such symbols at the same times let the same pieces follow; where few pieces begin with `known`, each is asked.
        """
        if token is None:
            return None
        found = self.classes_of.get((token, known), "")
        if found == "":
            bears = tuple(
                x for x in self.edge(token)
                if (x[0] + known in (self.begins if known else self.heads)) or any(x[0] + known[:n] in self.pieces for n in range(1, len(known)))
            )
            if bears and len(known) > 1 and len(pieces := self.longer(known)) <= ASKED:
                bears = tuple(piece for piece in pieces if not self.follows(token, piece))
            found = self.classes_of[token, known] = self.representatives.setdefault((known, bears), token) if bears else None
        return found

    def longer(self, known: str) -> list[str]:
        """The pieces that begin with `known` and go on."""
        low = bisect_right(self.sorted, known)
        return self.sorted[low : bisect_left(self.sorted, known + chr(0x10FFFF), low)]

    def single(self, token: str) -> list[int]:
        return [self.vocabulary.pieces[token][0]] if token in self.vocabulary.pieces else self.vocabulary.fallback(token)

    def step(self, key: State, char: str) -> tuple[State, int]:
        """The state after `char`, and the tokens emitted on the way."""
        end, tokens, counts = key
        text, last = end + char, None
        for size in range(len(text), 0, -1):
            piece = text[-size:]
            if piece in self.pieces and self.follows(tokens[-size], piece):
                last, emitted = piece, counts[-size] + 1
                break
        if last is None:  # a character that only occurs inside pieces
            ids = self.vocabulary.fallback(char)
            last, emitted = char, len(ids)
            if char not in self.heads:
                return ("", (None,), (0,)), emitted
        begin = next((i for i in range(len(text)) if text[i:] in self.heads), len(text))
        kept_tokens, kept_counts = [*tokens, last][begin:], [n - emitted for n in [*counts, emitted][begin:]]
        for i in range(len(kept_tokens)):
            known = text[begin + i :]
            if known and known not in self.heads:  # no piece that is still open begins here
                kept_tokens[i], kept_counts[i] = "", 0
            else:
                kept_tokens[i] = self.canonical(kept_tokens[i], known)
        return (text[begin:], tuple(kept_tokens), tuple(kept_counts)), emitted

    def compile(self, state: int, kind: int) -> None:
        """Fill in one transition."""
        if kind == _NEW_TEXT:
            mark, emitted = self.step(self.keys[ROOT], MARK)
            to = self.number(mark)
        elif kind < _FIRST:
            to, emitted = ROOT, max(1, kind - _MISSING)
        else:
            key, emitted = self.step(self.keys[state], self.chars[kind - _FIRST])
            to = self.number(key)
        key = state * self.width + kind
        place = int(self.places(np.array([key]))[0])
        self.at[place], self.next[place], self.emits[place] = key, to, emitted
        self.stored += 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies in the hash table, or the empty place for it."""
        place = ((keys * _SPREAD) >> (64 - PLACES)) & ((1 << PLACES) - 1)
        open_ = np.flatnonzero((self.at.take(place) != keys) & (self.at.take(place) >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << PLACES) - 1)
            there = self.at.take(place[open_])
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return place

    def read(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted tokens of many states at once."""
        keys = states.astype(np.int64) * self.width + kinds
        place = self.places(keys)
        missing = self.at.take(place) < 0
        if missing.any():
            for key in np.unique(keys[missing]).tolist():
                self.compile(*divmod(key, self.width))
            place = self.places(keys)
        return self.next.take(place), self.emits.take(place)

    def segment(self, kinds: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
        """The tokens emitted at each of `kinds`, and the state after them."""
        chunks = -(-len(kinds) // CHUNK)
        padded = np.full(chunks * CHUNK, _PIECE, np.int64)
        padded[: len(kinds)] = kinds
        columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        reached = np.empty((CHUNK, chunks), np.int32)
        emitted = np.empty((CHUNK, chunks), np.int8)
        states = np.zeros(chunks, np.int32)
        states[0] = entry
        for t in range(CHUNK):
            states, emitted[t] = self.read(states, columns[t])
            reached[t] = states
        maps = StateMaps(np.r_[entry, np.zeros(chunks - 1, np.int32)], states)
        while (more := maps.missing()) is not None:
            chunk, states = more
            ends, texts, lengths = states.copy(), np.zeros((CHUNK, len(chunk)), np.int8), np.full(len(chunk), CHUNK)
            open_, now = np.arange(len(chunk)), states
            for t in range(CHUNK):
                now, texts[t, open_] = self.read(now, columns[t, chunk[open_]])
                met = now == reached[t, chunk[open_]]
                lengths[open_[met]] = t + 1
                open_, now = open_[~met], now[~met]
                if not len(open_):
                    break
            ends = reached[-1, chunk]
            ends[open_] = now
            maps.add(chunk, states, ends, (texts, lengths))
        for chunk, (texts, lengths), lane in maps.chosen():
            emitted[: lengths[lane], chunk] = texts[: lengths[lane], lane]
        last = (len(kinds) - 1) % CHUNK
        flat = np.ascontiguousarray(emitted.T).ravel()[: len(kinds)]
        if last == CHUNK - 1:
            return flat, int(maps.end())
        state = np.array([maps.entry(chunks - 1)], np.int32)
        for kind in columns[: last + 1, -1]:
            state, _ = self.read(state, np.array([kind]))
        return flat, int(state[0])


class StateMaps:
    """For each chunk a map from entry states to end states, and their composition by a prefix scan.

    Entry 0 of a chunk is the state it was read from first; the map is complete when every end of a chunk is
    an entry of the next.
    """

    def __init__(self, entries: np.ndarray, ends: np.ndarray):
        self.entries, self.ends = [[int(x)] for x in entries], [[int(x)] for x in ends]
        self.paths: list[list] = [[None] for _ in entries]
        self.scanned: np.ndarray | None = None

    def missing(self) -> tuple[np.ndarray, np.ndarray] | None:
        found = [(c + 1, s) for c in range(len(self.entries) - 1) for s in dict.fromkeys(self.ends[c]) if s not in self.entries[c + 1]]
        if not found:
            return None
        chunk, states = zip(*found)
        return np.array(chunk), np.array(states, np.int32)

    def add(self, chunk: np.ndarray, states: np.ndarray, ends: np.ndarray, paths: tuple) -> None:
        for lane, (c, s, e) in enumerate(zip(chunk.tolist(), states.tolist(), ends.tolist())):
            self.entries[c].append(s)
            self.ends[c].append(e)
            self.paths[c].append((paths, lane))

    def scan(self) -> np.ndarray:
        """The entry of each chunk, as a number in its list, when the first is entered by its entry 0."""
        if self.scanned is None:
            size, wide = len(self.entries), max(map(len, self.entries))
            maps = np.zeros((size, wide), np.int64)  # maps[c]: entry of chunk c to entry of chunk c + 1
            for c in range(size - 1):
                place = {s: i for i, s in enumerate(self.entries[c + 1])}
                maps[c, : len(self.ends[c])] = [place[s] for s in self.ends[c]]
            step = 1
            while step < size:
                maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
                step *= 2
            self.scanned = np.r_[0, maps[:-1, 0]]
        return self.scanned

    def chosen(self) -> Iterator[tuple]:
        """(chunk, paths, lane) of the chunks not entered by their entry 0."""
        for c in np.flatnonzero(self.scan()).tolist():
            yield c, *self.paths[c][self.scan()[c]]

    def entry(self, chunk: int) -> int:
        return self.entries[chunk][self.scan()[chunk]]

    def end(self) -> int:
        return self.ends[-1][self.scan()[-1]]


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a model file; a worker holds one at a time."""
    if path not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[path] = Transducer(Vocabulary.load(path))
    return _COMPILED[path]


def counts_of(machine: Transducer, texts: list[str]) -> np.ndarray:
    """The tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    some = [i for i, text in enumerate(texts) if text]
    if not some:
        return out
    joined = " " + " ".join([texts[i] for i in some])
    kinds = machine.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts = np.r_[0, np.cumsum([len(texts[i]) + 1 for i in some])]
    kinds[starts[:-1]] = _NEW_TEXT
    state, totals = ROOT, np.zeros(len(some), np.int64)
    for low in range(0, len(kinds), SEGMENT):
        if len(machine.keys) > STATES or machine.stored > 1 << (PLACES - 1):
            key = machine.keys[state]
            machine.clear()
            state = machine.number(key)
        emitted, state = machine.segment(kinds[low : low + SEGMENT], state)
        sums = np.r_[0, np.cumsum(emitted, dtype=np.int64)]
        here = np.clip(starts - low, 0, len(emitted))
        totals += sums[here[1:]] - sums[here[:-1]]
    out[some] = totals
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`, by the byte-pair model at `path`."""
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_caches("token counts", _COMPILED.clear)
        machine = transducer(path)
        for batch in batches:
            for part in text_slices(batch, 1, 4 * SEGMENT):
                texts = part.column(1)
                tokens = counts_of(machine, texts.to_pylist())
                size = pc.cast(pc.binary_length(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
