"""Operator 4, toxicity by weak supervision.

1. A lexicon is mined from a bounded sample of labelled rows: words of any length, and stems of four to six letters, that toxic texts have
   far more often than clean ones.
2. Voters.  Every group of lexicon tokens with a common four-letter stem votes, and so do patterns of a whole text: several
   hits, several tokens, dense hits, shouting, exclamation, symbols.
3. A generative label model is fitted to the votes of all documents but the held-out fifth, without labels: each class has its own rate per voter
   (so the voters' accuracies), and one covariance within classes holds their correlations.  It starts from the sample's
   rates and is refined by expectation-maximization; Spark counts the vote patterns and sums the moments.
4. Its posteriors on the sample's texts are the labels of a linear classifier over hit counts, density and votes, whose
   probability is the score.

Learning uses only rows whose crc32(doc_id as text) mod 5 is not 0.  Label, language, source and id are no inputs of a
score.  Null texts are empty and get the score of a text without hits; repeated rows get equal scores.  Without labelled
rows, or none of one class, the lexicon is empty and every score is the share of toxic labels; without any label it is one half,
which counts as toxic.  Texts of any length are read whole; ties take the least doc_id; an empty table gives none;
other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B

#: Bound of the sample of labelled rows: those of the least hash of doc_id
FIT_ROWS = 8192
#: Lexicon: at most so many tokens, each in at least MIN_TOXIC toxic texts, and LIFT times as often as in clean ones
LEXICON, MIN_TOXIC, LIFT = 2000, 4, 8.0
GROUPS = 24
STEM = 4
PATTERNS = 8
ROUNDS = 4

_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = True
_TOKEN[0x80:] = True
_MARKS = np.zeros(256, np.int64)
_MARKS[list(b"#*$%&|<>@^")] = 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Lexicon:
    tokens: list[str]

    def __post_init__(self) -> None:
        stems: dict[str, list[int]] = {}
        for i, t in enumerate(self.tokens):  # by support, so the first stems are the commonest
            stems.setdefault(t.rstrip("*")[:STEM], []).append(i)
        self.stems = list(stems)
        group = np.full(len(self.tokens), GROUPS, np.int64)  # the last takes all stems beyond
        for g, stem in enumerate(self.stems[:GROUPS]):
            group[stems[stem]] = g
        self.tables = {}
        for n in (0, 4, 5, 6):  # whole words, and stems of n letters
            own = [i for i, t in enumerate(self.tokens) if (t.endswith("*") and len(t) == n + 1) or (n == 0 and not t.endswith("*"))]
            h = _hash([self.tokens[i].rstrip("*") for i in own])
            o = np.argsort(h)
            self.tables[n] = h[o], np.array(own, np.int64)[o]
        self.stem_hash = np.sort(_hash(self.stems))
        self.group = group


def _hash(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return B.range_hash(B.prefix_hash(buf), offs[:-1], offs[1:])


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes in a sorted table; -1 where there is none."""
    if not len(table):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, i, -1)


def features(column: pa.Array, lexicon: Lexicon) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: votes (0/1, groups then patterns) and counts (hits, distinct tokens, words)."""
    for lo, hi, raw, raw_offs in B.text_chunks(column):
        del lo, hi
        lowered = pc.utf8_lower(pa.LargeStringArray.from_buffers(len(raw_offs) - 1, pa.py_buffer(raw_offs.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())))
        for _, _, buf, offs in B.text_chunks(lowered, 1 << 62):
            n = len(offs) - 1
            solid = _TOKEN[buf]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            inner = offs[(offs > 0) & (offs < len(buf))]
            first[inner] = solid[inner]
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            last[inner - 1] = solid[inner - 1]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            bounds = np.searchsorted(starts, offs)
            words = np.diff(bounds)
            hit_row, hit_token = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(starts) and lexicon.tokens:
                char = np.flatnonzero(B.IS_CHAR_START[buf])
                number = np.searchsorted(char, starts)
                char = np.append(char, np.full(8, len(buf)))
                prefix = B.prefix_hash(buf)
                fourth = np.minimum(char[number + STEM], ends)
                some = np.flatnonzero(_find(lexicon.stem_hash, B.range_hash(prefix, starts, fourth)) >= 0)
                row = np.searchsorted(bounds, some, side="right") - 1
                rows, tokens = [], []
                for length, (table, own) in lexicon.tables.items():
                    end = ends[some] if not length else np.minimum(char[number[some] + length], ends[some])
                    at = _find(table, B.range_hash(prefix, starts[some], end))
                    ok = at >= 0
                    if length:
                        ok &= char[number[some] + length] < ends[some]
                    rows.append(row[ok])
                    tokens.append(own[at[ok]])
                hit_row, hit_token = np.concatenate(rows), np.concatenate(tokens)
            hits = np.bincount(hit_row, minlength=n)
            pairs = np.unique(hit_row * (len(lexicon.tokens) + 1) + hit_token)
            distinct = np.bincount(pairs // (len(lexicon.tokens) + 1), minlength=n)
            votes = np.zeros((n, GROUPS + 1 + PATTERNS), bool)
            votes[hit_row, lexicon.group[hit_token] if len(hit_token) else hit_token] = True
            upper = B.per_row((raw >= 65) & (raw <= 90), raw_offs)
            letters = np.maximum(B.per_row((buf >= 97) & (buf <= 122), offs), 1)
            size = np.maximum(words, 1)
            patterns = (hits >= 2, hits >= 4, distinct >= 3, hits > 0.01 * size, hits > 0.03 * size, upper > 0.3 * letters, B.per_row(raw == 33, raw_offs) > 0.05 * size, B.per_row(_MARKS[raw], raw_offs) > 0.1 * size)
            for k, p in enumerate(patterns):
                votes[:, GROUPS + 1 + k] = p
            yield votes, np.stack([hits, distinct, words], axis=1)


def mine_lexicon(sample: DataFrame) -> list[str]:
    """Words, and stems with a star, of the sample (text, toxic), the most telling first."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9'\\x{80}-\\x{10FFFF}]+)"), 1))
    stems = [F.transform(F.filter("words", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in (4, 5, 6)]
    tokens = sample.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("token"))
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return []
    rate = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    scored = tokens.groupBy("token").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where(F.col("p") >= MIN_TOXIC)
    best = scored.withColumn("rate", rate).where(F.col("rate") >= float(np.log(LIFT))).orderBy((F.col("rate") * F.sqrt("p")).desc(), "token").limit(LEXICON)
    return [r.token for r in best.select("token").collect()]


def _posterior(votes: np.ndarray, model: tuple) -> np.ndarray:
    weights, bias = model
    return 1 / (1 + np.exp(-np.clip(votes @ weights + bias, -30, 30)))


def _model(one: np.ndarray, zero: np.ndarray, second: np.ndarray, mass: tuple[float, float], prior: float) -> tuple:
    """Log-odds that are linear in the votes, from the classes' vote sums and all second moments."""
    m1, m0 = one / max(mass[0], 1e-9), zero / max(mass[1], 1e-9)
    total = sum(mass)
    cov = second / total - (mass[0] * np.outer(m1, m1) + mass[1] * np.outer(m0, m0)) / total
    cov += np.diag(0.05 * np.diag(cov) + 1e-3)
    weights = np.linalg.solve(cov, m1 - m0)
    return weights, float(np.log(prior / (1 - prior)) - 0.5 * (m1 + m0) @ weights)


def label_model(patterns: DataFrame, start: tuple, prior: float, size: int) -> tuple:
    """Refines the start on the counted vote patterns (bits, c) of all documents."""
    model = start
    for _ in range(ROUNDS):
        now = model

        def sums(batches: Iterator[pa.RecordBatch], now: tuple = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits, c = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(float)
                v = ((bits[:, None] >> np.arange(size)) & 1).astype(float)
                p = _posterior(v, now)
                flat = np.concatenate([[(p * c).sum(), ((1 - p) * c).sum()], (v * (p * c)[:, None]).sum(0), (v * ((1 - p) * c)[:, None]).sum(0), (v.T @ (v * c[:, None])).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

        rows = patterns.mapInArrow(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(2 + 2 * size + size * size)
        for r in rows:
            flat[r.i] = r.x
        if flat[0] < 1 or flat[1] < 1:
            break
        model = _model(flat[2 : 2 + size], flat[2 + size : 2 + 2 * size], flat[2 + 2 * size :].reshape(size, size), (flat[0], flat[1]), prior)
    return model


def _inputs(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    hits, distinct, words = counts.T.astype(float)
    return np.column_stack([np.ones(len(votes)), np.log1p(hits), np.minimum(100 * hits / np.maximum(words, 1), 10), np.log1p(distinct), hits > 0, votes])


def train(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), gradient)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # of rows that repeat an id one is for learning, so that the bound is one of rows
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic").persist()
    size = GROUPS + 1 + PATTERNS
    lexicon = Lexicon(mine_lexicon(sample))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(features(batch.column(0), lexicon))
            if not got:
                continue
            v, c = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(v @ (1 << np.arange(size))), *(pa.array(c[:, k]) for k in range(3)), batch.column(1).cast(pa.int64())], ["bits", "hits", "distinct", "words", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(seen, "bits long, hits long, distinct long, words long, toxic long").toPandas()
    sample.unpersist()
    y = rows["toxic"].to_numpy().astype(float)
    prior = float(np.clip(y.mean(), 1e-3, 0.999)) if len(y) else 0.5
    weights = np.zeros(5 + size)
    weights[0] = np.log(prior / (1 - prior))
    if not lexicon.tokens:
        return lexicon, weights
    v = ((rows["bits"].to_numpy()[:, None] >> np.arange(size)) & 1).astype(float)
    model = _model(v[y == 1].sum(0), v[y == 0].sum(0), v.T @ v, (y.sum(), (1 - y).sum()), prior)

    def pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for votes, _ in features(batch.column(0), lexicon):
                bits, c = np.unique(votes @ (1 << np.arange(size)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(c)], ["bits", "c"])

    from ..session import cut

    patterns = cut(docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(pattern, "bits long, c long").groupBy("bits").agg(F.sum("c").alias("c")))
    model = label_model(patterns, model, prior, size)
    counts = rows[["hits", "distinct", "words"]].to_numpy()
    return lexicon, train(_inputs(v, counts), _posterior(v, model))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text)."""
    lexicon, weights = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_inputs(v, c) @ weights for v, c in features(batch.column(1), lexicon)]
            x = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
