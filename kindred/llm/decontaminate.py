"""Benchmark decontamination: a BM25 inverted index of the test items, and every training passage as a query with block-max WAND.

Scores are BM25 of a passage's distinct terms against an item, over the item's score against itself, so one threshold in
(0, 1] serves items of any length. A term's postings are its segments in ascending order with their impacts; its greatest impact on
any segment, and on any segment of each block (a range of segment numbers), are kept beside them. Every term of a passage has a
cursor. A step takes the cursors by segment and adds up their greatest impacts until the threshold is reached: there is the pivot. If
the greatest impacts in the pivot's block can't reach the threshold, the cursors skip the block, or to the next cursor beyond the pivot;
else they move to the pivot, and once all stand there its score is taken exactly. Many passages make their steps at once. No
passage or item at or above the threshold is lost. What is retrieved is verified: shares of the question's and
of the answer's word grams that stand in the document around the passage, or else of their words without edits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import KEY, KEYS, keyed, keys_of, named
from kindred.llm.textkit import LOWER, Words, pieces

_FOLD = LOWER.copy()
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20
#: Postings that one scan of the corpus asks (8 bytes each, held by every task); a benchmark of more takes further scans.
POSTINGS = 30_000_000
#: Segments of a block at least, and entries of each table by term and block (4 bytes each) at most.
BLOCK, TABLE = 8, 16_000_000
#: Passages that make their steps together.
TOGETHER = 2048
#: Words of an indexed segment, and of a passage's stride; a passage is two strides, so that it holds any segment whole.
STRIDE = 64
K1, B = 1.2, 0.75
FOUND = f"{KEYS}, item long, score double, passages int, question double, answer double, start int, end int"
#: Impacts are added up as whole numbers of this fraction, bounds rounded up.
_UNIT = float(1 << 24)
_NONE = (1 << 31) - 1


@dataclass
class Item:
    """A test item: its id, and the word hashes of its question and its answer."""

    id: int | None
    question: np.ndarray
    answer: np.ndarray


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: its last sentence or line is the answer; of a single sentence, its last quarter."""
    body = text.strip()
    cut = max(body.rstrip(".!?").rfind(mark) for mark in (". ", "? ", "! ", "\n"))
    if cut > 0:
        return body[: cut + 1], body[cut + 1 :]
    words = body.split()
    at = max(1, len(words) - max(1, len(words) // 4))
    return " ".join(words[:at]), " ".join(words[at:])


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.string()), _FOLD)
    return np.split(w.hashes(), w.first[1:-1]) if texts else []


@dataclass
class Statistics:
    """Of all segments of the benchmark: their number, mean length, and how many hold each word (by ascending hash)."""

    segments: int
    mean: float
    vocabulary: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, lengths_and_words: Iterator[tuple[int, np.ndarray]]) -> Statistics:
        n = total = size = 0
        vocabulary, df, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            new, count = np.unique(np.concatenate(held), return_counts=True)
            both, back = np.unique(np.concatenate((vocabulary, new)), return_inverse=True)
            return both, np.bincount(back, weights=np.concatenate((df, count))).astype(np.int64)

        for length, words in lengths_and_words:
            n, total, size = n + 1, total + length, size + len(words)
            held.append(words)
            if size > 4_000_000:
                vocabulary, df = fold()
                held, size = [], 0
        if held:
            vocabulary, df = fold()
        return cls(n, total / n if n else 1.0, vocabulary, df)

    def idf(self) -> np.ndarray:
        return np.log(1 + (self.segments - self.df + 0.5) / (self.df + 0.5))


class Index:
    """Postings of terms over segments of items. Impacts are BM25's, divided by each segment's score against itself."""

    def __init__(self, segments: list[tuple[Item, np.ndarray]], known: Statistics | None = None):
        self.items = list({id(item): item for item, _ in segments}.values())
        number = {id(item): k for k, item in enumerate(self.items)}
        known = known or Statistics.of((len(s), np.unique(s)) for _, s in segments)
        n = len(segments)
        size = np.array([len(s) for _, s in segments], np.int64)
        owner, words = np.repeat(np.arange(n), size), np.concatenate([s for _, s in segments]) if n else np.zeros(0, np.uint64)
        self.vocabulary, term = np.unique(words, return_inverse=True)
        pair, count = np.unique(owner * max(1, len(self.vocabulary)) + term, return_counts=True)
        owner, term = pair // max(1, len(self.vocabulary)), pair % max(1, len(self.vocabulary))
        at = np.searchsorted(known.vocabulary, self.vocabulary)
        weight = known.idf()[at][term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[owner] / known.mean))
        weight /= np.bincount(owner, weights=weight, minlength=n)[owner]
        # alike segments side by side: by their commonest term, which tells languages apart
        df = known.df[at][term]
        commonest = np.zeros(n, np.int64)
        best = np.lexsort((-df, owner))
        heads = best[np.diff(owner[best], prepend=-1) > 0]
        commonest[owner[heads]] = term[heads]
        order = np.lexsort((np.arange(n), commonest))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.owner = np.array([number[id(segments[k][0])] for k in order], np.int64)
        owner = place[owner]
        by = np.lexsort((owner, term))
        owner, term, weight = owner[by], term[by], weight[by]
        terms = len(self.vocabulary)
        # each list ends with no segment, so that cursors needn't look at its length; term number ``terms`` has an empty list
        count = np.bincount(term, minlength=terms + 1)
        self.first = np.concatenate(([0], np.cumsum(count + 1)))[:-1]
        where = np.arange(len(term)) + term
        self.segment = np.full(len(term) + terms + 1, _NONE, np.int32)
        self.impact = np.zeros(len(self.segment), np.int32)
        self.segment[where], self.impact[where] = owner, np.ceil(weight * _UNIT)
        # per term and block: the greatest impact, and the first posting at or after the block
        self.width = max(BLOCK, -(-n * (terms + 1) // TABLE))
        blocks = -(-n // self.width) + 1
        self.block_max = np.zeros((terms + 1, blocks), np.int32)
        np.maximum.at(self.block_max, (term, owner // self.width), self.impact[where])
        in_block = np.zeros((terms + 1, blocks), np.int64)
        np.add.at(in_block, (term, owner // self.width), 1)
        self.skip = (self.first[:, None] + np.cumsum(in_block, axis=1) - in_block).astype(np.int32)
        self.most = self.block_max.max(axis=1)
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, len(vocabulary) for words of no item."""
        out = np.full(len(hashes), len(self.vocabulary), np.int32)
        maybe = np.flatnonzero(self.hint[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(len(self.vocabulary) - 1, 0))
        hit = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        out[maybe[hit]] = at[hit]
        return out

    def search(self, terms: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, segment, score) of all passages terms[start : end] that score at least ``threshold``."""
        low = int((threshold - 1e-5) * _UNIT)
        bound = np.concatenate(([0], np.cumsum(self.most[terms], dtype=np.int64)))
        alive = np.flatnonzero(bound[end] - bound[start] >= low)
        out: list[tuple] = []
        for k in range(0, len(alive), TOGETHER):
            some = alive[k : k + TOGETHER]
            size = end[some] - start[some]
            row = np.repeat(np.arange(len(some)), size)
            term = terms[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[some], size)]
            inside = term < len(self.vocabulary)
            pair = np.unique(row[inside].astype(np.int64) * len(self.vocabulary) + term[inside])
            row, term = pair // len(self.vocabulary), pair % len(self.vocabulary)
            count = np.bincount(row, minlength=len(some))
            query = np.full((len(some), int(count.max(initial=1))), len(self.vocabulary), np.int64)
            query[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = term
            rows, segments, scores = self.wand(query, low)
            out.append((some[rows], segments, scores))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out))

    def wand(self, query: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, segment, score) of all that reach ``low``. query: (passages, cursors), distinct terms, filled up with the empty one."""
        row = np.arange(len(query))
        cursor = self.first[query]
        most = self.most[query].astype(np.int64)
        found: list[tuple] = []
        while len(row):
            at = self.segment[cursor]
            # cursors by segment, with their greatest impact in the lower half of one number
            line = np.sort(at.astype(np.int64) << 32 | most, axis=1)
            reached = np.cumsum(line & 0xFFFFFFFF, axis=1) >= low
            pivot = (line[np.arange(len(row)), reached.argmax(axis=1)] >> 32).astype(np.int32)
            go = reached[:, -1] & (pivot < _NONE)
            if not go.all():
                row, query, cursor, most, at, pivot = row[go], query[go], cursor[go], most[go], at[go], pivot[go]
                if not len(row):
                    break
            before = at <= pivot[:, None]
            block = pivot // self.width
            bound = np.where(before, self.block_max[query, block[:, None]], 0).sum(axis=1, dtype=np.int64)
            hopeful = bound >= low
            here = hopeful & ((at == pivot[:, None]) == before).all(axis=1)
            if here.any():
                h = np.flatnonzero(here)
                score = np.where(before[h], self.impact[cursor[h]], 0).sum(axis=1, dtype=np.int64)
                hit = score >= low
                found.append((row[h[hit]], pivot[h[hit]], score[hit] / _UNIT))
            beyond = np.where(before, _NONE, at).min(axis=1)
            # to the pivot; past it, once its score is known; or past its block or to the next cursor, whichever comes first
            to = np.where(here, pivot + 1, np.where(hopeful, pivot, np.maximum(pivot + 1, np.minimum((block + 1) * self.width, beyond))))
            r, c = np.nonzero(at < to[:, None])
            target, term = to[r], query[r, c]
            spot = np.maximum(cursor[r, c], self.skip[term, np.minimum(target // self.width, self.skip.shape[1] - 1)])
            late = np.flatnonzero(self.segment[spot] < target)
            while len(late):
                spot[late] += 1
                late = late[self.segment[spot[late]] < target[late]]
            cursor[r, c] = spot
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*found))


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (hashes[k : k + len(out)] ^ hashes[k : k + len(out)] >> np.uint64(29))
    return out


def overlap(part: np.ndarray, region: np.ndarray, gram: int) -> float:
    """Share of the part's word grams that the region holds; an empty part is wholly there."""
    n = min(gram, len(part))
    return float(np.isin(_grams(part, n), _grams(region, n)).mean()) if n else 1.0


def edits(part: np.ndarray, region: np.ndarray, most: int) -> int:
    """Least number of words changed, left out or put in between the part and any run of the region's words; most + 1 for more."""
    if not len(part) or int((~np.isin(part, region)).sum()) > most:
        return min(len(part), most + 1)
    steps = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for word in part:
        below = row + 1
        below[1:] = np.minimum(below[1:], row[:-1] + (region != word))
        row = np.minimum.accumulate(below - steps) + steps
    return min(int(row.min()), most + 1)


def shares(item: Item, region: np.ndarray, verify: float, gram: int) -> tuple[float, float, bool]:
    """Shares of the question and of the answer that stand in the region, and whether the item does.

    A part's share is that of its grams, or if this is below ``verify``, of its words without edits. A part so short that one edit takes
    it below ``verify`` may have one edit, if the other part holds and both stand together with no further one.
    """
    parts = (item.question, item.answer)
    out, held, wrong = [], [], []
    for part in parts:
        share, n = overlap(part, region, gram), None
        if share < verify:
            n = edits(part, region, int((1 - verify) * len(part) + 1e-9))
            share = max(share, 1 - n / len(part))
        out.append(share)
        held.append(share >= verify)
        wrong.append(n)
    if not all(held) and any(held):
        other = held.index(True)
        short = parts[1 - other]
        if 1 > (1 - verify) * len(short) + 1e-9:
            n = wrong[other]
            if n is None:
                n = edits(parts[other], region, len(parts[other]))
            if edits(np.concatenate(parts), region, n + 1) <= n + 1:
                out[1 - other] = max(out[1 - other], 1 - 1 / len(short))
                return out[0], out[1], True
    return out[0], out[1], all(held)


def segments_of(rows: Iterator[tuple[int | None, str]]) -> Iterator[tuple[Item, np.ndarray]]:
    """Items in segments of at most STRIDE words."""
    for id_, text in rows:
        question, answer = hashed_words(list(split_item(text)))
        item = Item(id_, question, answer)
        body = np.concatenate((question, answer))
        n = -(-len(body) // STRIDE)
        for part in np.array_split(body, n) if n else []:
            yield item, part


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str, postings: int) -> list[Index]:
    """Indexes of at most ``postings`` each (one item's segments stay together), all with the statistics of the whole benchmark; at least one."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text_col}`").alias("text")).dropna(subset=["text"]).orderBy("id", "text")
    read = lambda: segments_of((r["id"], r["text"]) for r in rows.toLocalIterator())
    known = Statistics.of((len(part), np.unique(part)) for _, part in read())
    out, held, size = [], [], 0
    for item, part in read():
        if held and size + len(part) > postings and held[-1][0] is not item:
            out.append(Index(held, known))
            held, size = [], 0
        held.append((item, part))
        size += len(part)
    return [*out, Index(held, known)] if held or not out else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, verify: float = 0.75, gram: int = 3, shortest: int = 5, postings: int = POSTINGS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns, without a shuffle; ``contaminated`` says what the others hold."""
    out = docs
    for index in indexes(benchmark, item_col, item_text_col, postings):

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, text_col):
                n = piece.num_rows
                numbered = pa.RecordBatch.from_pydict({"rid": pa.array(np.arange(n)), "t1": pa.array(np.zeros(n, np.int64)), "t2": pa.array(np.zeros(n, np.int64)), "text": piece.column(text_col)})
                clean = np.ones(n, bool)
                for found in find(numbered, index, threshold, verify, gram, shortest):
                    clean[np.asarray(found.column("rid"))] = False
                yield piece.filter(pa.array(clean))

        out = out.mapInArrow(scan, docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, verify: float = 0.75, gram: int = 3, shortest: int = 5, postings: int = POSTINGS) -> DataFrame:
    """Finds the documents that hold test items.

    Returns one row per document and item that it holds: rid, t1 and t2 (the document's key), the id, item, score (greatest among its passages), passages (how many were
    retrieved), question and answer (shares of their ``gram``-word grams in the document there, or where these are below ``verify``, of
    their words without edits; at least ``verify`` but for a short part with one edit, see ``shares``), and start and end (words from the first to the last retrieved passage). Words are compared without case (A-Z) and ASCII
    punctuation. Items of fewer than ``shortest`` words must stand there whole and in order.

    Null and empty texts hold nothing. Items with a null or empty text are in no document; equal items are each reported, those without
    an id as one item of a null id. Repeated
    rows (same id and text) are reported once. All statistics are those of the whole benchmark, so results don't depend on ``postings``.
    Other columns are ignored. Empty tables give an empty result.
    """
    base = keyed(docs, id_col, text_col)
    result: DataFrame | None = None
    for index in indexes(benchmark, item_col, item_text_col, postings):

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text"):
                yield from find(piece, index, threshold, verify, gram, shortest)

        found = base.mapInArrow(scan, FOUND)
        result = found if result is None else result.unionByName(found)
    result = result.groupBy(*KEY, "item").agg(*[f(c).alias(c) for c, f in (("score", F.max), ("passages", F.max), ("question", F.max), ("answer", F.max), ("start", F.min), ("end", F.max))])
    return result.select(*KEY, named(docs, id_col), "item", "score", "passages", "question", "answer", "start", "end")


def find(piece: pa.RecordBatch, index: Index, threshold: float, verify: float, gram: int, shortest: int) -> Iterator[pa.RecordBatch]:
    words = Words(piece.column("text"), _FOLD)
    hashes = words.hashes()
    terms = index.terms(hashes)
    count = np.maximum(1, -(-words.count // STRIDE) - 1) * (words.count > 0)
    doc = np.repeat(np.arange(words.docs), count)
    start = words.first[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    end = np.minimum(start + 2 * STRIDE, words.first[1:][doc])
    passage, segment, score = index.search(terms, start, end, threshold)
    pairs: dict[tuple[int, int], list] = {}
    for p, s, x in zip(passage.tolist(), segment.tolist(), score.tolist()):
        own = pairs.setdefault((int(doc[p]), int(index.owner[s])), [0.0, set(), int(start[p]), int(end[p])])
        own[0], own[2], own[3] = max(own[0], x), min(own[2], int(start[p])), max(own[3], int(end[p]))
        own[1].add(p)
    out = []
    for (d, k), (x, held, low, high) in pairs.items():
        item = index.items[k]
        size = len(item.question) + len(item.answer)
        a, b = max(int(words.first[d]), low - size), min(int(words.first[d + 1]), high + size)
        region = hashes[a:b]
        if size < shortest:
            q = ans = overlap(np.concatenate((item.question, item.answer)), region, size)
            there = q >= verify
        else:
            q, ans, there = shares(item, region, verify, gram)
        if there:
            out.append((d, item.id, min(x, 1.0), len(held), q, ans, low - int(words.first[d]), high - int(words.first[d])))
    if out:
        d, *cols = zip(*out)
        kinds = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
        names = ("item", "score", "passages", "question", "answer", "start", "end")
        keys = keys_of(piece)[:, list(d)]
        yield pa.RecordBatch.from_pydict({**{c: pa.array(k, pa.int64()) for c, k in zip(KEY, keys)}, **{c: pa.array(v, k) for c, v, k in zip(names, cols, kinds)}})
