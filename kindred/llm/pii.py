"""PII by information-theoretic sanitisation.

Base patterns find protected entities: e-mail addresses, IP addresses, card and phone numbers. Corpus co-occurrence then
estimates how strongly other terms reveal them: for an entity e and a term t near its mentions, the pointwise mutual
information of the two over the information content of e,

    disclosure(e, t) = log(c(e, t) N / (n(e) n(t))) / log((N + 1) / n(e)),

with N rows, n(t) of them holding t, n(e) that mention e and c(e, t) of those holding t near a mention; all four count rows, each
once. ``support`` asks for so many different texts among the c(e, t), so copies of one document make no term. Terms are the words
without ASCII punctuation at their ends, of any length and with any characters, and the parts of a word between ASCII punctuation;
words that overlap a base span are none. A term whose disclosure exceeds the threshold for an entity, with
enough support, is removed (threshold ``remove_at``) or generalised (``generalise_at``) wherever it stands.

Terms are found again in the corpus by a filter of bits, of bounded size, that every task holds; what it lets through is joined with
the terms themselves. So each of the two counts takes one scan, however many terms there are, and the driver sees no list of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.anchors import KEY, KEYS, key_columns, keyed, named, unused
from kindred.llm.textkit import LOWER, Words, hash_ranges, mix, pieces, raw
from kindred.shared import discard, materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bits of the filter for each term, and the least and most bits (as powers of two) it has in all.
BITS_PER_TERM, LEAST_BITS, MOST_BITS = 16, 16, 31
#: Terms up to which their table is broadcast.
FEW_TERMS = 100_000
#: Bytes that part the terms within a word, as spaces; and those that begin and end a term.
_FOLD = LOWER.copy()
_FOLD[[b for b in range(33, 127) if chr(b) in EDGE]] = 0x20
_PLAIN = np.ones(256, bool)
_PLAIN[[ord(c) for c in EDGE]] = False
_INNER = re.compile(f"[{re.escape(EDGE)}]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in time linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free, at = at + 1, text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(48 <= ord(c) <= 57 for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def terms_of(word: str) -> list[str]:
    """The terms that a word stands for, A-Z lower-cased: the word without ASCII punctuation at its ends, and its parts between inner punctuation."""
    whole = word.strip(EDGE).translate(_LOWER)
    parts = _INNER.split(whole)
    return [whole, *parts] if len(parts) > 1 else parts if whole else []


class Terms:
    """Terms of the documents of one array: byte ``start`` and ``end``, document ``doc``; the first ``whole`` are words, the others parts of the word ``of``."""

    def __init__(self, array: pa.Array):
        words, parts = Words(array, LOWER), Words(array, _FOLD)
        self.data, self.offsets, self.docs = words.data, words.offsets, words.docs
        plain = np.flatnonzero(_PLAIN[words.data])
        low, high = np.searchsorted(plain, words.start), np.searchsorted(plain, words.end)
        any_ = high > low
        start, end = plain[low[any_]], plain[high[any_] - 1] + 1
        of = np.searchsorted(start, parts.start, side="right") - 1
        part = (parts.start != start[of]) | (parts.end != end[of]) if len(of) else np.zeros(0, bool)
        self.whole = len(start)
        self.start, self.end = np.concatenate((start, parts.start[part])), np.concatenate((end, parts.end[part]))
        self.doc, self.of = np.concatenate((words.doc[any_], parts.doc[part])), np.concatenate((np.arange(len(start)), of[part]))

    def hashes(self) -> np.ndarray:
        n = self.whole
        return np.concatenate((hash_ranges(self.data, self.start[:n], self.end[:n]), hash_ranges(self.data, self.start[n:], self.end[n:])))


def _hash64(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _suspects(piece: pa.RecordBatch) -> np.ndarray:
    """Documents with a digit or an @: no other holds a base match."""
    data, offsets = raw(piece.column("text"))
    hit = ((data >= 48) & (data <= 57)) | (data == 64)
    sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int64)))
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


SPANS = "spans array<struct<start:int,end:int,kind:string,action:string>>"
ENTITIES = "entities array<struct<entity:long,terms:array<string>>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("action", pa.string())]))
_ENTITY = pa.list_(pa.struct([("entity", pa.int64()), ("terms", pa.list_(pa.string()))]))


def mentioned(text: str, spans: list[tuple[int, int, str]], reach: int) -> list[dict]:
    """Each entity of the text once, with the terms within ``reach`` words of any of its mentions."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    starts, ends = [s for s, _ in words], [e for _, e in words]
    # words that a base span overlaps are replaced anyway
    taken = {k for a, b, _ in spans for k in range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b))}
    near: dict[int, set[int]] = {}
    for a, b, kind in spans:
        value = text[a:b].lower() if kind == "email" else "".join(c for c in text[a:b] if c.isdigit() or (kind == "ip" and c == "."))
        low, high = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        near.setdefault(_hash64(kind + ":" + value), set()).update(k for k in (*range(max(0, low - reach), low), *range(high, min(len(words), high + reach))) if k not in taken)
    return [{"entity": e, "terms": sorted({t for k in own for t in terms_of(text[words[k][0] : words[k][1]])})} for e, own in near.items()]


def term_hashes(terms: list[str]) -> np.ndarray:
    """The hash that Terms gives each term."""
    w = Words(pa.array(terms, pa.string()), LOWER)
    assert len(w) == len(terms)
    return w.hashes()


def _bits(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash in a filter of 2**power."""
    return hashes >> np.uint64(64 - power), mix(hashes) >> np.uint64(64 - power)


class Filter:
    """Which hashes may be wanted: all that are, and a small share of the others."""

    def __init__(self, hashes: DataFrame):
        """hashes: (hash long), distinct. The bits are set by the tasks and united in blocks; the driver gets at most 2**MOST_BITS of them."""
        self.power = power = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_TERM * max(1, hashes.count()) - 1).bit_length()))
        block = 1 << 13

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (power - 3), np.uint8)
            for b in batches:
                for at in _bits(np.asarray(b.column(0)).view(np.uint64), power):
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            rows = bits.reshape(-1, min(block, len(bits)))
            used = np.flatnonzero(rows.any(axis=1))
            yield pa.record_batch([pa.array(used, pa.int64()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

        def unite(table: pa.Table) -> pa.Table:
            both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
            return pa.table([table["block"][:1].combine_chunks(), pa.array([both.tobytes()], pa.binary())], names=["block", "bits"])

        got = hashes.mapInArrow(mark, "block long, bits binary").groupBy("block").applyInArrow(unite, "block long, bits binary").toArrow()
        self.bits = np.zeros(1 << (power - 3), np.uint8)
        for k, x in zip(got["block"].to_pylist(), got["bits"].to_pylist()):
            self.bits[k * block : k * block + len(x)] = np.frombuffer(x, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be wanted."""
        maybe = np.arange(len(hashes))
        for k in (0, 1):
            at = _bits(hashes[maybe], self.power)[k]
            maybe = maybe[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) == 1]
        return maybe


def _frequencies(base: DataFrame, wanted: Filter) -> DataFrame:
    """(hash, n_term): rows that hold each term, of all that the filter lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Terms(piece.column("text"))
            own = words.hashes()
            hit = wanted(own)
            pair = np.unique(np.stack((own[hit], words.doc[hit].astype(np.uint64))), axis=1)[0]
            value, n = np.unique(pair, return_counts=True)
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return base.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n_term"))


def disclosing_terms(base: DataFrame, found: DataFrame, support: int, at_least: float) -> DataFrame | None:
    """(term, hash, disclosure), materialised: terms near entities that disclose one of them; None if no term has support."""
    mentions = found.select("t1", F.explode("entities").alias("m")).select("t1", "m.entity", "m.terms")
    entities = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"))
    near = mentions.select("t1", "entity", F.explode("terms").alias("term"))
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("c"), F.count_distinct("t1").alias("texts")).filter(F.col("texts") >= support)
    pairs = materialise(pairs.join(entities, "entity"), "pairs")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(term_hashes(b.column(0).to_pylist()).view(np.int64))], names=["term", "hash"])

    coded = materialise(pairs.select("term").distinct().mapInArrow(hashed, "term string, hash long"), "terms")
    out = None
    if not coded.isEmpty():
        n = base.count()
        counts = _frequencies(base, Filter(coded.select("hash").distinct()))
        ratio = F.log(F.col("c") * n / (F.col("n_entity") * F.greatest("n_term", "c"))) / F.log(F.lit(float(n + 1)) / F.col("n_entity"))
        scored = pairs.join(coded, "term").join(counts, "hash").withColumn("disclosure", ratio)
        out = materialise(scored.filter(F.col("disclosure") >= at_least).groupBy("term", "hash").agg(F.max("disclosure").alias("disclosure")), "disclosing")
        if out.isEmpty():
            discard(out)
            out = None
    for t in (pairs, coded):
        discard(t)
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 12, support: int = 2, generalise_at: float = 0.7, remove_at: float = 0.9) -> DataFrame:
    """Finds personal data and the terms that reveal it, in every document.

    Returns one row per row of ``docs``: rid, t1 and t2 (its key: id and a hash of the text), the id, and spans: (start, end, kind, action)
    in code points, by start, then kind in the order email, ip, card, phone, term. Base spans have the action 'replace', terms
    'generalise' or 'remove'; a term span never overlaps a base span or another term. ``sanitise`` applies them.

    A null text has no spans. Repeated rows get the same spans; they count as rows, but not as different texts. Other columns are
    ignored. An empty table gives an empty result.
    """
    base = keyed(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            spans: list[list] = [[] for _ in range(piece.num_rows)]
            entities: list[list] = [[] for _ in range(piece.num_rows)]
            for d in _suspects(piece).tolist():
                text = piece.column("text")[d].as_py()
                if own := base_spans(text):
                    spans[d] = [{"start": a, "end": b, "kind": k, "action": "replace"} for a, b, k in own]
                    entities[d] = mentioned(text, own, reach)
            yield pa.RecordBatch.from_pydict({**{c: piece.column(c) for c in KEY}, "spans": pa.array(spans, _SPAN), "entities": pa.array(entities, _ENTITY)})

    found = materialise(base.mapInArrow(scan, f"{KEYS}, {SPANS}, {ENTITIES}"), "mentions")
    terms = disclosing_terms(base, found.filter("size(entities) > 0"), support, generalise_at)
    plain = found.select(*KEY, "spans")
    if terms is not None:
        plain = _with_terms(base, plain, terms, remove_at)
    return plain.withColumn(id_col, named(docs, id_col))


def _with_terms(base: DataFrame, plain: DataFrame, terms: DataFrame, remove_at: float) -> DataFrame:
    wanted = Filter(terms.select("hash").distinct())

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Terms(piece.column("text"))
            own = words.hashes()
            hit = wanted(own)
            points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            doc = words.doc[hit]
            low = points[words.offsets[:-1]][doc]
            at = pa.array(doc, pa.int64())
            cols = {"hash": pa.array(own[hit].view(np.int64)), "start": pa.array(points[words.start[hit]] - low, pa.int32()), "end": pa.array(points[words.end[hit]] - low, pa.int32())}
            yield pa.RecordBatch.from_pydict({**{c: piece.column(c).take(at) for c in KEY}, **cols})

    table = terms.groupBy("hash").agg(F.max("disclosure").alias("disclosure"))
    table = F.broadcast(table) if terms.count() <= FEW_TERMS else table
    spotted = base.mapInArrow(spot, f"{KEYS}, hash long, start int, end int").join(table, "hash")
    action = F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")
    # rows of equal key find equal spans
    more = spotted.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end", action))).alias("more"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column("spans").to_pylist()
            for d, found in enumerate(b.column("more").to_pylist()):
                if found:
                    out[d] = merged(out[d], found)
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in KEY}, "spans": pa.array(out, _SPAN)})

    return plain.join(more, list(KEY), "left").mapInArrow(merge, f"{KEYS}, {SPANS}")


def merged(base: list[dict], terms: list[dict]) -> list[dict]:
    """Base spans (in order) and terms, by start and kind: no term that overlaps a base span, or that is a part of another term."""
    out, held = [], 0
    # base spans as disjoint stretches of the text
    low: list[int] = []
    high: list[int] = []
    for s in sorted(base, key=lambda s: s["start"]):
        if high and s["start"] < high[-1]:
            high[-1] = max(high[-1], s["end"])
        else:
            low.append(s["start"])
            high.append(s["end"])
    for t in sorted(terms, key=lambda t: (t["start"], -t["end"])):
        at = bisect.bisect_right(high, t["start"])
        if at < len(low) and low[at] < t["end"]:
            continue
        if t["end"] <= held:
            continue
        held = t["end"]
        out.append({"start": t["start"], "end": t["end"], "kind": "term", "action": t["action"]})
    return sorted([*base, *out], key=lambda s: (s["start"], KINDS.index(s["kind"])))


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text sanitised: base spans become [EMAIL], [IP], [CARD] or [PHONE], generalised terms [TERM], removed ones nothing.

    found: what ``personal_data`` gave for these rows. Null texts stay null; all other columns, whatever their names, stay as they are.
    """
    r, a, b, held = unused(docs, "rid", "t1", "t2", "spans")

    @F.pandas_udf("string")
    def clean(text, spans):  # noqa: ANN001, ANN202
        out = []
        for t, own in zip(text, spans):
            if t is None or own is None or not len(own):
                out.append(t)
                continue
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] < at:
                    at = max(at, s["end"])
                    continue
                parts += [t[at : s["start"]], "" if s["action"] == "remove" else f"[{s['kind'].upper()}]"]
                at = s["end"]
            out.append("".join(parts) + t[at:])
        import pandas as pd

        return pd.Series(out)

    spans = found.filter("size(spans) > 0").select(F.col("rid").alias(r), F.col("t1").alias(a), F.col("t2").alias(b), F.col("spans").alias(held)).dropDuplicates([r, a, b])
    keyed_ = docs.withColumns(dict(zip((r, a, b), key_columns(id_col, text_col))))
    joined = keyed_.join(spans, [r, a, b], "left")
    return joined.withColumn(text_col, clean(F.col(f"`{text_col}`"), F.col(held))).select(*[F.col(f"`{c}`") for c in docs.columns])
