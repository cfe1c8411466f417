"""Quality classifier by co-training.

Two views of a document. Its text content: hashed byte trigrams, word statistics, lines, letter case, digits and symbols. Its page
metadata: language, source and stated length, and nothing read from the text. A linear classifier is fitted on each view's labelled
rows and calibrated on labelled rows kept apart. In every round each classifier labels all unlabelled rows of which it is sure enough
and hands them to the other, which is fitted again; a view that is never sure, as metadata may be, hands over nothing. At the end
both are calibrated, and a logistic combination of the two, fitted on the rows kept apart, scores every document.

Fitting is ridge regression, so a row counts only through sums of products of its features: a round is one pass over the written features of
all rows, in which every task adds up its own, and the driver solves the sums. No unlabelled row is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.textkit import CHUNK, Words, pieces
from kindred.llm.toxicity import _logistic, fold
from kindred.shared import discard, materialise

#: Labelled rows to learn from at most, least hash of the id first.
LABELLED = 4000
GRAMS, NAMES, LENGTHS = 256, 64, 16
ROUNDS = 3
#: Calibrated chance above which a view is sure of a label.
SURE = 0.97
#: Weight of all pseudo-labelled rows of a label together, against that of the labelled rows.
PSEUDO = 0.5

_SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
TEXT, META = GRAMS + len(_SIGNS) + 10, 2 * NAMES + LENGTHS + 2


def text_view(piece: pa.RecordBatch) -> np.ndarray:
    """(documents, TEXT) features of the text."""
    words = Words(piece.column("text"))
    data, offsets, docs = words.data, words.offsets, words.docs
    size = np.diff(offsets)
    owner = np.repeat(np.arange(docs), size)
    n = np.maximum(size, 1).astype(np.float64)
    grams = np.zeros((docs, GRAMS))
    if len(data) > 2:
        h = (data[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77) + data[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
        inside = owner[:-2] == owner[2:]
        grams = np.bincount(owner[:-2][inside] * GRAMS + h[inside], minlength=docs * GRAMS).reshape(docs, GRAMS)
    count = np.maximum(words.count, 1)
    distinct, most = np.zeros(docs), np.zeros(docs)
    if len(words):
        key = np.sort(words.hashes() & ~np.uint64(0xFFFFFF) | words.doc.astype(np.uint64) & np.uint64(0xFFFFFF))
        heads = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        d = (key[heads] & np.uint64(0xFFFFFF)).astype(np.int64)
        distinct = np.bincount(d, minlength=docs)
        np.maximum.at(most, d, np.diff(np.append(heads, len(key))))
    length = np.bincount(words.doc, weights=words.end - words.start, minlength=docs) / count
    classes = np.zeros(256, np.int64)
    classes[_SIGNS] = np.arange(1, len(_SIGNS) + 1)
    shares = np.bincount(owner * 40 + classes[data], minlength=docs * 40).reshape(docs, 40)[:, 1 : len(_SIGNS) + 1] / n[:, None]
    per = lambda mask: np.bincount(owner[mask], minlength=docs)
    lines = per(data == 10) + 1
    rest = np.stack((distinct / count, most / count, np.log1p(words.count), length, np.log1p(lines), np.log1p(size / lines), per((data >= 65) & (data <= 90)) / n, per((data >= 48) & (data <= 57)) / n, words.count / n, per(data >= 128) / n), axis=1)
    return np.concatenate((np.sqrt(grams / n[:, None]), np.sqrt(shares), rest), axis=1).astype(np.float32)


def meta_view(piece: pa.RecordBatch) -> np.ndarray:
    """(documents, META) features of lang, source and n_chars: names hashed whole, the length by powers of two and by its logarithm."""
    docs = piece.num_rows
    out = np.zeros((docs, META), np.float32)
    for k, column in enumerate(("lang", "source")):
        own = piece.column(column).to_pylist()
        place = {name: NAMES * k + sum(c * pow(131, j, NAMES) for j, c in enumerate(name.encode())) % NAMES for name in set(own) if name is not None}
        for d, name in enumerate(own):
            if name is not None:
                out[d, place[name]] = 1
    chars = np.array([x if x is not None and x > 0 else 0 for x in piece.column("n_chars").to_pylist()], np.float64)
    log = np.log2(1 + chars)
    out[np.arange(docs), 2 * NAMES + np.minimum(log.astype(np.int64), LENGTHS - 1)] = 1
    out[:, -2], out[:, -1] = log, log * log / 16
    return out


@dataclass
class View:
    """A linear classifier on standardised features, and its calibration (offset, slope)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offset: float = 0.0
    slope: float = 1.0

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.offset + self.slope * self.raw(x), -12, 12)


@dataclass
class Model:
    """Both views, and the combination of their log odds."""

    views: list[View]
    mix: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 1.0]))

    def scores(self, xs: list[np.ndarray]) -> list[np.ndarray]:
        """Scores by both views together, by text and by metadata."""
        odds = [v.log_odds(x) for v, x in zip(self.views, xs)]
        both = np.clip(self.mix[0] + self.mix[1] * odds[0] + self.mix[2] * odds[1], -12, 12)
        return [1 / (1 + np.exp(-o)) for o in (both, *odds)]


#: Sums of a view's rows of one label: products of features, features, rows.
Sums = tuple[np.ndarray, np.ndarray, float]


def sums(z: np.ndarray) -> Sums:
    return z.T @ z, z.sum(axis=0), float(len(z))


def solve(given: list[Sums], handed: list[Sums], ridge: float = 30.0) -> np.ndarray:
    """Ridge weights for labels of -1 and 1, both labels weighing the same. given, handed: sums of labels 0 and 1."""
    total = sum(s[2] for s in given)
    a, b = 0.0, 0.0
    for y, (own, more) in zip((-1.0, 1.0), zip(given, handed)):
        extra = PSEUDO * min(1.0, more[2] / max(own[2], 1)) if more[2] else 0.0
        for (zz, z, n), share in ((own, 1 - extra / (1 + extra)), (more, extra / (1 + extra))):
            if n and share:
                w = total / 2 * share / n
                a, b = a + w * zz, b + w * y * z
    return np.linalg.solve(a + ridge * np.eye(len(b)), b)


class CoTraining:
    """The state of co-training: what was learnt from labelled rows, and the sums of what the views hand over."""

    def __init__(self, xs: list[np.ndarray], y: np.ndarray):
        """xs: both views of the labelled rows. Every fourth row is kept apart."""
        self.apart = np.arange(len(y)) % 4 == 3
        self.xs, self.y = xs, y
        y_ = y[~self.apart]
        self.views, self.given = [], []
        for x in xs:
            own = x[~self.apart].astype(np.float64)
            view = View(own.mean(axis=0), own.std(axis=0) + 1e-3, np.zeros(x.shape[1] + 1))
            self.views.append(view)
            self.given.append([sums(view.z(own[y_ == label])) for label in (0, 1)])
        self.refit([[self._none(k)] * 2 for k in (0, 1)])

    @classmethod
    def possible(cls, y: np.ndarray) -> bool:
        """Whether there are rows of both labels to fit and to calibrate on."""
        apart = np.arange(len(y)) % 4 == 3
        return len(y) >= 8 and len(set(y[apart])) == 2 and len(set(y[~apart])) == 2

    def _none(self, k: int) -> Sums:
        d = len(self.views[k].weights)
        return np.zeros((d, d)), np.zeros(d), 0.0

    def refit(self, handed: list[list[Sums]]) -> None:
        for k, view in enumerate(self.views):
            view.weights = solve(self.given[k], handed[k])
            view.offset, view.slope = 0.0, 1.0
            score = view.raw(self.xs[k][self.apart])
            view.offset, view.slope = (float(v) for v in _logistic(np.stack((np.ones(len(score)), score), axis=1), self.y[self.apart]))

    def hand_over(self, xs: list[np.ndarray], sure: float = SURE) -> list[list[Sums]]:
        """Sums, for each view, of the rows of each label that the other is sure of."""
        edge = np.log(sure / (1 - sure))
        out = []
        for k in (0, 1):
            odds, z = self.views[1 - k].log_odds(xs[1 - k]), self.views[k].z(xs[k])
            out.append([sums(z[odds < -edge]), sums(z[odds > edge])])
        return out

    def model(self) -> Model:
        odds = np.stack([np.ones(int(self.apart.sum())), *[v.log_odds(x[self.apart]) for v, x in zip(self.views, self.xs)]], axis=1)
        return Model(self.views, _logistic(odds, self.y[self.apart]))


def add(a: list[list[Sums]] | None, b: list[list[Sums]]) -> list[list[Sums]]:
    return b if a is None else [[tuple(p + q for p, q in zip(s, t)) for s, t in zip(u, v)] for u, v in zip(a, b)]


def co_train(known: list[np.ndarray], y: np.ndarray, passes: callable, rounds: int = ROUNDS) -> Model | None:
    """The model after all rounds; None without rows of both labels to fit and to calibrate on. passes: from a CoTraining, the sums handed over by all unlabelled rows."""
    if not CoTraining.possible(y):
        return None
    state = CoTraining(known, y)
    for _ in range(rounds):
        state.refit(passes(state))
    return state.model()


def squeezed(x: np.ndarray) -> list[bytes]:
    """Feature rows as small blobs: 16-bit floats, zstandard."""
    to = zstandard.ZstdCompressor(level=1)
    return [to.compress(row.tobytes()) for row in x.astype(np.float16).view(np.uint8).reshape(len(x), -1, 2).transpose(0, 2, 1).reshape(len(x), -1)]


def unsqueezed(column: pa.Array, width: int) -> np.ndarray:
    of = zstandard.ZstdDecompressor()
    body = b"".join(of.decompress(b, max_output_size=2 * width) for b in column.to_pylist())
    return np.frombuffer(body, np.uint8).reshape(-1, 2, width).transpose(0, 2, 1).copy().view(np.float16).reshape(-1, width).astype(np.float32)


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def column(name: str, kind: str) -> Column:
        return F.col(f"`{name}`").try_cast(kind) if name in docs.columns else F.lit(None).cast(kind)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), column("lang", "string").alias("lang"), column("source", "string").alias("source"), column("n_chars", "long").alias("n_chars"))


def _features(rows: DataFrame, kind: str) -> DataFrame:
    """(id, x), materialised: both views of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", CHUNK // 2):
            body = squeezed(np.concatenate((text_view(piece), meta_view(piece)), axis=1))
            yield pa.record_batch([piece.column("id"), pa.array(body, pa.binary())], names=["id", "x"])

    return materialise(rows.mapInArrow(scan, f"id {kind}, x binary"), "features")


def _learn(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, labelled: int, rounds: int, held_out: int | None, folds: int) -> Model | None:
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    if held_out is not None:
        known = known.filter(fold(F.col("id"), folds) != held_out)
    known = known.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    # of rows with one id the one of least features, so reruns agree
    got = features.join(F.broadcast(known), "id").groupBy("id", "label").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").select("label", "x").toArrow()
    x = unsqueezed(got["x"].combine_chunks(), TEXT + META) if got.num_rows else np.zeros((0, TEXT + META), np.float32)
    named = labels.select(F.col(f"`{id_col}`").alias("id")).filter("id is not null").distinct()
    if held_out is not None:  # rows of the fold that is held out are no rows to learn from
        free = features.filter(F.col("id").isNotNull() & (fold(F.col("id"), folds) != held_out)).join(named, "id", "left_anti")
    else:
        free = features.join(named, "id", "left_anti")
    free = materialise(free.select("x"), "unlabelled")

    def one_pass(state: CoTraining) -> list[list[Sums]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    x = unsqueezed(b.column("x").slice(at, 2048), TEXT + META)
                    total = add(total, state.hand_over([x[:, :TEXT], x[:, TEXT:]]))
            if total is not None:
                rows = [(2 * k + label, zz.astype(np.float64).tobytes(), z.tobytes(), n) for k, own in enumerate(total) for label, (zz, z, n) in enumerate(own) if n]
                which, zz, z, n = zip(*rows) if rows else ((), (), (), ())
                yield pa.record_batch([pa.array(which, pa.int32()), pa.array(zz, pa.binary()), pa.array(z, pa.binary()), pa.array(n, pa.float64())], names=["which", "zz", "z", "n"])

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Sums] = {}
            for b in batches:
                for k, zz, z, n in zip(*(c.to_pylist() for c in b.columns)):
                    own = np.frombuffer(zz), np.frombuffer(z), n
                    held[k] = tuple(p + q for p, q in zip(held[k], own)) if k in held else own
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([s[0].tobytes() for s in held.values()], pa.binary()), pa.array([s[1].tobytes() for s in held.values()], pa.binary()), pa.array([s[2] for s in held.values()], pa.float64())], names=["which", "zz", "z", "n"])

        kind = "which int, zz binary, z binary, n double"
        some = free.mapInArrow(count, kind)
        # sums of many tasks meet in a few, then in the driver: at most 32 sets of sums of bounded size
        got = some.repartition(min(32, max(1, some.rdd.getNumPartitions() // 16))).mapInArrow(unite, kind).toArrow()
        out = [[state._none(k)] * 2 for k in (0, 1)]
        for k, zz, z, n in zip(*(got[c].to_pylist() for c in ("which", "zz", "z", "n"))):
            v = np.frombuffer(z)
            own = out[k // 2][k % 2]
            out[k // 2][k % 2] = (own[0] + np.frombuffer(zz).reshape(len(v), len(v)), own[1] + v, own[2] + n)
        return out

    model = co_train([x[:, :TEXT], x[:, TEXT:]], np.asarray(got["label"]), one_pass, rounds)
    discard(free)
    return model


def scores_of(model: Model | None, xs: list[np.ndarray]) -> list[np.ndarray]:
    return model.scores(xs) if model else [np.ones(len(xs[0]))] * 3


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, threshold: float = 0.5, held_out: int | None = None, folds: int = 4) -> DataFrame:
    """Scores the quality of every document.

    Returns one row per row of ``docs``: the id, score (0 to 1, higher: label 1 likelier), text_score and meta_score (of the
    single views) and kept (score of at least ``threshold``). Learns from at most ``labelled`` rows with labels and all without, outside
    fold ``held_out`` if that is given. A score depends on the row's text, lang, source and n_chars alone.

    A null text is empty. Missing or null metadata count as unknown. A null id is never a labelled row. Repeated rows
    get equal scores. An id labelled twice counts as bad if any label says so; of rows that share a labelled id the one of least
    features is learnt from. Without labels of both kinds every score is 1. Other columns are ignored. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    features = _features(_inputs(docs, id_col, text_col), kind)
    model = _learn(features, labels, id_col, label_col, labelled, rounds, held_out, folds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = unsqueezed(part.column("x"), TEXT + META)
                yield pa.record_batch([part.column("id"), *[pa.array(s, pa.float64()) for s in scores_of(model, [x[:, :TEXT], x[:, TEXT:]])]], names=["id", "score", "text_score", "meta_score"])

    scored = features.mapInArrow(scan, f"id {kind}, score double, text_score double, meta_score double")
    return scored.select(F.col("id").alias(id_col), "score", "text_score", "meta_score", (F.col("score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, rounds: int = ROUNDS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, without a shuffle of their texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    features = _features(_inputs(docs, id_col, text_col), kind)
    model = _learn(features, labels, id_col, label_col, labelled, rounds, None, 4)
    discard(features)
    wanted = {"text": text_col, "lang": "lang", "source": "source", "n_chars": "n_chars"}
    names = docs.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col, CHUNK // 2):
            columns = [piece.column(c) if c in names else pa.nulls(piece.num_rows, pa.string()) for c in wanted.values()]
            columns[1:3] = [c.cast(pa.string()) for c in columns[1:3]]
            columns[3] = columns[3].cast(pa.int64())
            own = pa.record_batch(columns, names=list(wanted))
            # through the same 16-bit floats as in ``quality``
            x = [v(own).astype(np.float16).astype(np.float32) for v in (text_view, meta_view)]
            yield piece.filter(pa.array(scores_of(model, x)[0] >= threshold))

    return docs.mapInArrow(scan, docs.schema)
