"""Operator 8, BPE encoding and decoding with a tokenization automaton.

The automaton accepts exactly the token sequences that byte-pair merging yields.  It starts as one state with a loop
for every base symbol and takes one gadget per merge (u, v) -> w in rank order: wherever an arc u leads to a state with
an arc v, the arc u is led to a copy of that state without v, and an arc w to where v led is added.  All arcs of one
token lead to one state, so a state is named by its last token and kept as what differs from the state it was copied
from: the arcs removed from it, each with the time (merge rank) of the removal.

Encoding walks many words at once through two tables.  One has the tokens' bytes as a trie; the other has the automaton's arcs:
for (state, token) whether the arc is there, worked out from the removals the first time it is asked for, as 49,000 states of all
arcs are too many to be kept.  Every start of a word has one path, so the state at a place is the one token that ends there and
has an arc from the state where it begins; no walk goes back.  Words over ``LONG`` bytes are walked one at a time, longest token
first with backtracking.  Decoding emits the labels of the arcs.

Null and empty texts give no tokens and decode to the empty string.  Special strings in a text are its special tokens,
as in the library's default.  Texts of any length are encoded whole; repeated rows give equal rows; an empty table gives none.
Columns of the input with a result's name are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._gpt_bytes import BYTE_SYMBOLS
from ._recent import Recent

#: Words that a generation of a worker's memory holds
WORDS = 80_000
#: Words of more bytes are walked one at a time
LONG = 48
#: Slots of the table of arcs; an arc that falls on another's slot takes its place
ARCS = 1 << 21
# Fixed pattern of the pre-tokenizer; only the matches are kept.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
LATEST = 1 << 60
SHORT = (2, 1)


class Automaton:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        #: removed[u][v]: when the arc v was removed from the state after u
        self.removed: dict[str, dict[str, int]] = {}
        #: token -> (right part, left part, time made); base symbols have none
        self.made: dict[str, tuple[str, str, int]] = {}
        lengths: dict[str, set[int]] = {}
        for time, m in enumerate(model["merges"]):
            self.gadget(*(m if isinstance(m, list) else m.split(" ")), time)
        #: by token, as they are asked for: what was removed from its state's copies, and the tokens it begins with
        self.states: dict[str, list[tuple[dict[str, int], int]]] = {}
        self.heads: dict[str, list[tuple[str, int]]] = {}
        # numbers of symbols of the tokens that begin with three given ones, longest first
        for t in self.made:
            size = len(t) - (len(WORD_END) if t.endswith(WORD_END) else 0)
            if size > 2:
                lengths.setdefault(t[:3], set(SHORT)).add(size)
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def gadget(self, u: str, v: str, time: int) -> None:
        """Merge (u, v): no v after u from now on; the joined token leads where v led."""
        if not self.allowed(u, v, time):
            return  # no path reads u, v any more
        self.removed.setdefault(u, {})[v] = time
        self.made.setdefault(u + v, (v, u, time))

    def allowed(self, s: str, t: str, now: int = LATEST) -> bool:
        """Whether the state after token s has an arc t before time ``now``.

        The state after s = (.., v) is a copy of the state after v as it was when s was made, so removals from that one
        count up to then; an arc t = (u, ..) was added where there still was an arc u after the removals of t's own merge.
        """
        removed, made = self.removed, self.made
        x, upto = s, now
        while True:
            gone = removed.get(x)
            if gone:
                y, until = t, now
                while True:
                    at = gone.get(y)
                    if at is not None and at < upto and at <= until:
                        return False
                    part = made.get(y)
                    if part is None:
                        break
                    y, until = part[1], min(until, part[2])
            part = made.get(x)
            if part is None:
                return True
            x, upto = part[0], min(upto, part[2])

    def state(self, s: str) -> list[tuple[dict[str, int], int]]:
        """The removals from the state after s and from those it is a copy of, each with the time up to which they count."""
        out, x, upto = [], s, LATEST
        while True:
            if gone := self.removed.get(x):
                out.append((gone, upto))
            part = self.made.get(x)
            if part is None:
                break
            x, upto = part[0], min(upto, part[2])
        self.states[s] = out
        return out

    def head(self, t: str) -> list[tuple[str, int]]:
        """The tokens that t begins with, itself first, each with the time up to which its removal keeps t out."""
        out, y, until = [], t, LATEST
        while True:
            out.append((y, until))
            part = self.made.get(y)
            if part is None:
                break
            y, until = part[1], min(until, part[2])
        self.heads[t] = out
        return out

    def step(self, s: str, t: str) -> bool:
        """Whether the finished table has an arc t after s: allowed(), from what is kept by token."""
        heads = self.heads.get(t) or self.head(t)
        states = self.states.get(s)
        for gone, upto in self.state(s) if states is None else states:
            for y, until in heads:
                at = gone.get(y)
                if at is not None and at < upto and at <= until:
                    return False
        return True

    def path(self, symbols: list[str]) -> list[str]:
        """The tokens of one word, given its base symbols.

        A walk along arcs, longest token first.  One path at most leads to a place, so a place without a way on is dead for
        good, and the walk goes back a token.
        """
        n = len(symbols)
        text = "".join(symbols)
        made, step, lengths = self.made, self.step, self.lengths
        out: list[str] = []
        at = [0]
        dead: set[int] = set()
        while at[-1] < n:
            i = at[-1]
            rest = n - i
            last = out[-1] if out else None
            for size in lengths.get(text[i : i + 3], SHORT) if rest > 2 else SHORT:
                if size > rest or i + size in dead:
                    continue
                t = text[i : i + size] if size < rest else text[i:]
                if (size == 1 or t in made) and (last is None or step(last, t)):
                    out.append(t)
                    at.append(i + size)
                    break
            else:
                dead.add(i)
                out.pop()
                at.pop()
        return out


class Tables:
    """The tokens as a trie and the arcs asked for so far, both as numpy tables, for all words of a batch at once."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        byte_of = {c: b for b, c in BYTE_SYMBOLS.items()}
        nodes: dict[tuple[int, int], int] = {}
        inner, final = [-1], [-1]
        for token, number in automaton.vocab.items():
            ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
            symbols = token[: -len(WORD_END)] if ends else token
            if token not in automaton.made and len(symbols) > 1:
                continue
            node = 0
            for c in symbols:
                node = nodes.setdefault((node, byte_of[c]), len(nodes) + 1)
                if node == len(inner):
                    inner.append(-1)
                    final.append(-1)
            (final if ends else inner)[node] = number
        self.inner, self.final = np.array(inner, np.int32), np.array(final, np.int32)
        keys = np.array([n << 8 | b for n, b in nodes], np.uint64)
        self.bits = np.uint64(64 - max(8, int(8 * len(keys)).bit_length()))
        self.key = np.full(1 << (64 - int(self.bits)), 2**64 - 1, np.uint64)
        self.next = np.zeros(len(self.key), np.int32)
        value, slot = np.array(list(nodes.values()), np.int32), self._slot(keys)
        while len(keys):  # one key takes each free slot, the others try the next
            free = self.key[slot] == np.uint64(2**64 - 1)
            self.key[slot[free]] = keys[free]
            placed = self.key[slot] == keys
            self.next[slot[placed]] = value[placed]
            keys, value, slot = keys[~placed], value[~placed], (slot[~placed] + 1) % len(self.key)
        self.arc = np.full(ARCS, 2**32 - 1, np.uint32)
        self.there = np.zeros(ARCS, bool)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's node below ``node`` by ``byte``, 0 if none."""
        keys = node.astype(np.uint64) << np.uint64(8) | byte
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.next[slot], 0)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.key)
            found = self.key[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.next[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether there is an arc ``token`` from the state after ``state``."""
        keys = state.astype(np.uint32) << np.uint32(16) | token.astype(np.uint32)
        slot = ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - (ARCS.bit_length() - 1))).astype(np.int64)
        out = self.there[slot]
        new = np.flatnonzero(self.arc[slot] != keys)
        if len(new):
            asked, back = np.unique(keys[new], return_inverse=True)
            label, step = self.automaton.label, self.automaton.step
            answer = np.array([step(label[k >> 16], label[k & 0xFFFF]) for k in asked.tolist()])[back]
            out[new] = answer
            self.arc[slot[new]], self.there[slot[new]] = keys[new], answer
        return out

    def paths(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        ends = np.cumsum(size)
        end_of = np.repeat(ends, size)
        # tokens in the text: where they begin, where they end
        at, node, found = np.arange(len(buf)), np.zeros(len(buf), np.int32), []
        for length in range(1, LONG + 1):
            inside = at + length <= end_of[at]
            at, node = at[inside], node[inside]
            node = self.child(node, buf[at + length - 1])
            at, node = at[node > 0], node[node > 0]
            if not len(at):
                break
            token = np.where(at + length == end_of[at], self.final[node], self.inner[node])
            found.append((at[token >= 0], np.full((token >= 0).sum(), length), token[token >= 0]))
        first, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        start_of = end_of - np.repeat(size, size)
        place = first + length - start_of[first]  # within the word
        order = np.argsort(place, kind="stable")
        first, length, token = first[order], length[order], token[order]
        cuts = np.searchsorted(place[order], np.arange(1, int(size.max()) + 2))
        # state[x]: the token that ends before x + 1 on the word's path so far
        state, taken = np.full(len(buf), -1, np.int32), np.zeros(len(buf), np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f, n, t = first[lo:hi], length[lo:hi], token[lo:hi]
            later = np.flatnonzero(f > start_of[f])
            ok = np.ones(len(f), bool)
            ok[later] = self.step(state[f[later] - 1], t[later])
            state[f[ok] + n[ok] - 1], taken[f[ok] + n[ok] - 1] = t[ok], n[ok]
        # back along each path from its end
        on = np.zeros(len(buf), bool)
        x, left = ends - 1, size.copy()
        while len(x):
            on[x] = True
            left = left - taken[x]
            x, left = (x - taken[x])[left > 0], left[left > 0]
        ids = state[on].astype("<u4").tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], ends])]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


class Encoder(Recent):
    """By word: its ids as little-endian 32-bit integers.  Special strings are words of their own."""

    def __init__(self, path: str) -> None:
        import regex

        super().__init__(WORDS)
        self.automaton = Automaton(path)
        self.tables = Tables(self.automaton)
        self.code = {t: i.to_bytes(4, "little") for t, i in self.automaton.vocab.items()}
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in self.automaton.special) + ")")
        self.white = regex.compile(r"\s+")
        self.held = list(self.automaton.special)

    def make(self, word: str) -> bytes:
        known = self.automaton.special.get(word)
        if known is not None:
            return int(known).to_bytes(4, "little")
        symbols = [BYTE_SYMBOLS[b] for b in word.encode("utf-8")]
        symbols[-1] += WORD_END
        return b"".join(map(self.code.__getitem__, self.automaton.path(symbols)))

    def learn(self, words: set[str]) -> None:
        """Makes what is wanted of words that aren't known, all at once."""
        short = [(w, b) for w in words - self.automaton.special.keys() if len(b := w.encode("utf-8")) <= LONG]
        if short:
            for (w, _), ids in zip(short, self.tables.paths([b for _, b in short]), strict=True):
                self.put(w, ids)

    def words(self, text: str) -> list[str]:
        import unicodedata

        text = self.white.sub(" ", unicodedata.normalize("NFC", text)) if not text.isascii() else text
        return self.find(text.replace("Σ", "σ").lower())

    def parts(self, text: str) -> list[str]:
        """The words and special strings of a text."""
        if not any(s in text for s in self.held):
            return self.words(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.automaton.special else self.words(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.parts(x) if x else [] for x in texts]
        self.learn({w for words in split for w in words if w not in self and w not in self.old})
        get = self.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def labels(self) -> np.ndarray:
        table = np.empty(max(self.automaton.label) + 1, object)
        table[:] = ""
        for i, t in self.automaton.label.items():
            table[i] = t
        return table

    def decode(self, ids: bytes) -> str:
        if not hasattr(self, "table"):
            self.table = self.labels()
        return " ".join(self.table[np.frombuffer(ids, "<u4")].tolist())


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def _map(docs: DataFrame, vocabulary: str, column: str, fields: list[StructField], work) -> DataFrame:
    rest = [c for c in docs.columns if c != column and c not in {f.name for f in fields}]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("__in"))
    types = [pa.binary() if isinstance(f.dataType, BinaryType) else pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            # a few texts at a time, so that what is made from them stays small
            inputs = batch.column(len(rest))
            size = pc.fill_null(pc.binary_length(inputs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.cumsum(size) >> 20
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(inputs)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                made = work(encoder, inputs.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *(pa.array([m[k] for m in made], t) for k, t in enumerate(types))], [*rest, *(f.name for f in fields)])

    return source.mapInArrow(run, StructType([*(source.schema[c] for c in rest), *fields]))


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ids (little-endian unsigned 32-bit integers) and n_tokens."""

    def work(encoder: Encoder, texts: list[str | None]) -> list[tuple]:
        return [(ids, len(ids) // 4) for ids in encoder.encode(texts)]

    return _map(docs, vocabulary, text, [StructField("ids", BinaryType()), StructField("n_tokens", LongType())], work)


def bpe_decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Replaces ``ids`` by decoded, the labels of the tokens joined by spaces (this vocabulary names no decoder)."""

    def work(encoder: Encoder, coded: list[bytes | None]) -> list[tuple]:
        return [(encoder.decode(x) if x else "",) for x in coded]

    return _map(encoded, vocabulary, ids, [StructField("decoded", StringType())], work)


def bpe_round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Replaces ``text`` by ids, n_tokens, and decoded, which is made from the ids; one pass through one Python worker."""

    def work(encoder: Encoder, texts: list[str | None]) -> list[tuple]:
        return [(ids, len(ids) // 4, encoder.decode(ids)) for ids in encoder.encode(texts)]

    return _map(docs, vocabulary, text, [StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())], work)
