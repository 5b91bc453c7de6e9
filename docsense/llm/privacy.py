"""Personal data, and the terms that would reveal it (operator 10).

Base spans (e-mail and IP addresses, card and phone numbers) and secrets in assignments are found by pattern in every
whole text. They are the protected entities. How strongly a term reveals an entity is estimated from the corpus over whole
documents: n(t, e) documents hold both, n(t) the term, n(e) the entity, of N. The pointwise mutual information
ln(N n(t, e) / (n(t) n(e))) is compared with the entity's information -ln(n(e) / N): a term that carries at least
1/``ALPHA`` of it discloses the entity, and each of its occurrences in any document becomes a span of kind ``term``. A pair
seen in fewer than ``SUPPORT`` different texts is no estimate and discloses nothing. Where an entity's texts are near copies
of each other everything in them co-occurs, so there only words within ``WINDOW`` words of the entity count as seen with it.
Texts are near copies if n of them are worth fewer than ``INDEPENDENT`` independent ones: n / (1 + (n - 1) J), where the
mean Jaccard index J of their words is estimated from ``SKETCH`` minima.
Sanitised texts have base spans replaced by their kind, terms that hold digits generalised (each digit to #) and the other
terms removed.

Words are those of the text as it stands, each lower-cased on its own. Null texts count as empty, and very long ones are
read whole; repeated rows are rows of their own with equal results, doc_id may be null, an empty table gives an empty
result, and only doc_id and text are read (``sanitise`` keeps all columns).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 2
WINDOW = 8
INDEPENDENT = 1.5
SKETCH = 16
#: Texts of a batch that are worked on at once, which bounds a task's memory.
CHUNK = 256
ALPHA = 1.5
#: Bits of the filter through which words pass to be counted; its size doesn't depend on the corpus.
FILTER_BITS = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match never begins inside a run of digits, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_SECRET = re.compile(r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?([A-Za-z0-9+/_.-]{12,512})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Linear in the text: from each @ back over the local part and forward over the domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and start < at:
            found.append((start, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return found


def _octets(value: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in value.split("."))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def spell(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The values of assignments to names of secrets: letters and digits mixed."""
    found = [m for m in _SECRET.finditer(text or "") if _DIGIT.search(m[1]) and re.search("[A-Za-z]", m[1])]
    return [("secret", *m.span(1)) for m in found]


def entity(kind: str, value: str) -> str:
    """The protected value behind a span, however it is written."""
    plain = {"email": value.lower(), "ip": value, "secret": value}
    return f"{kind}:{plain.get(kind) or ''.join(_DIGIT.findall(value))}"


def terms_outside(text: str, spans: list[tuple[str, int, int]]) -> tuple[set[str], set[tuple[str, str]]]:
    """The lower-cased words that no span touches, and the pairs of entity and such a word within ``WINDOW`` words."""
    covered = sorted((a, b) for _, a, b in spans)
    starts, words, k = [], [], 0
    for m in _WORD.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and m.start() < b for a, b in covered[k : k + len(KINDS) + 1]):
            starts.append(m.start())
            words.append(m[0].lower())
    near = set()
    for kind, a, b in spans:
        low, high = bisect_left(starts, a), bisect_left(starts, b)
        near |= {(entity(kind, text[a:b]), w) for w in words[max(low - WINDOW, 0) : high + WINDOW]}
    return set(words), near


SCAN = "text_hash long, entities array<string>, terms array<string>, sketch array<long>, near array<struct<entity:string,term:string>>"
_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
_RNG = np.random.default_rng(7)
_FACTORS = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _chunks(batch: pa.RecordBatch):
    for low in range(0, batch.num_rows, CHUNK):
        part = batch.slice(low, CHUNK)
        yield list(zip(part.column("text_hash").to_pylist(), part.column("text").to_pylist()))


def sketch(terms: list[str]) -> list[int]:
    """The least value of ``SKETCH`` hashes over a set of words."""
    if not terms:
        return [0] * SKETCH
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
    return (hashes[:, None] * _FACTORS).min(0).view(np.int64).tolist()


def _scan_batches(batches):
    for batch in batches:
        for chunk in _chunks(batch):
            rows = []
            for key, text in chunk:
                spans = base_spans(text) + secret_spans(text)
                if spans:
                    terms, near = terms_outside(text, spans)
                    rows.append((key, sorted({entity(k, text[a:b]) for k, a, b in spans}), sorted(terms), sketch(list(terms)), [{"entity": e, "term": w} for e, w in sorted(near)]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), _NEAR]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["text_hash", "entities", "terms", "sketch", "near"])


def distinct_words(text: str | None) -> set[str]:
    """The words of a text, each lower-cased on its own (which for ASCII is the text lower-cased)."""
    text = text or ""
    return set(_WORD.findall(text.lower())) if text.isascii() else set(map(str.lower, _WORD.findall(text)))


def _filter(terms: DataFrame):
    """A bit table of the terms' hashes: at most 2**FILTER_BITS bits reach the driver, whatever the number of terms."""
    place = F.pmod(F.xxhash64("term"), F.lit(1 << FILTER_BITS))
    words = terms.select((place / 32).cast("long").alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(term), 32) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out


class Passing(dict):
    """Whether a word may be a counted term, by the bit table; remembered, and emptied when grown large."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) > 400_000:
            self.clear()
        at = xxhash.xxh64_intdigest(word, 42) % (1 << FILTER_BITS)
        value = self[word] = bool(int(self.bits[at // 32]) >> (at % 32) & 1)
        return value


def document_frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n_t: the documents that hold each of ``terms``, counted over all whole texts."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def count(batches):
        passing, held = Passing(bits.value), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update([w for w in distinct_words(text) if passing[w]])
            if len(held) > 200_000:
                yield out()
                held = Counter()
        yield out()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """entity, term and pmi of the pairs in which the term reveals the entity.

    Texts with entities are scanned and collapsed to distinct ones first; an entity of fewer than ``support`` texts can't
    be estimated and is left out before pairs are made.
    """
    n = docs.count()
    texts = docs.select(_text_key(F.col("text")).alias("text_hash"), "text")
    held = materialise(texts.mapInArrow(_scan_batches, SCAN), "pii-scan")
    distinct = materialise(held.groupBy("text_hash").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("entities", "terms", "sketch", "near")]), "pii-texts")
    counted = distinct.select(F.explode("entities").alias("entity"), "copies").groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    several = materialise(counted.where(F.col("texts") >= support), "pii-entities")
    # Sum over values of squared counts: n times (1 + (n - 1) J), averaged over the hashes.
    minima = distinct.select(F.explode("entities").alias("entity"), "sketch").join(several.select("entity"), "entity").select("entity", F.posexplode("sketch").alias("hash", "least"))
    squares = minima.groupBy("entity", "hash", "least").agg(F.count(F.lit(1)).alias("c")).groupBy("entity").agg((F.sum(F.col("c") * F.col("c")) / SKETCH).alias("squares"))
    independent = F.col("texts") * F.col("texts") / F.col("squares")
    shared = materialise(several.join(squares, "entity").select("entity", "n_e", (independent >= INDEPENDENT).alias("apart")), "pii-shared")
    apart, copied = (shared.where(F.col("apart") == flag).select("entity") for flag in (True, False))
    where = distinct.select("text_hash", F.explode("entities").alias("entity")).join(apart, "entity").groupBy("text_hash").agg(F.collect_list("entity").alias("of"))
    far = distinct.join(where, "text_hash").select("copies", "terms", F.explode("of").alias("entity")).select("copies", "entity", F.explode("terms").alias("term"))
    near = distinct.select("copies", F.inline("near")).join(copied, "entity").select("copies", "entity", "term")
    pairs = far.unionByName(near)
    both = materialise(pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support), "pii-pairs")
    n_t = document_frequencies(docs, materialise(both.select("term").distinct(), "pii-terms"))
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    information = -F.log(F.col("n_e") / F.lit(float(max(n, 1))))
    measured = both.join(n_t, "term", "left").join(shared.select("entity", "n_e"), "entity").select("entity", "term", "n_t", pmi.alias("pmi"), information.alias("information"))
    # A counted term that no text holds would be an error of the word rule, not a rare term.
    sure = F.when(F.col("n_t").isNull(), F.raise_error("a term of a pair has no document count").cast("double")).otherwise(F.col("pmi"))
    return measured.select("entity", "term", "information", sure.alias("pmi")).where((F.col("information") > 0) & (F.col("pmi") >= F.col("information") / alpha)).select("entity", "term", "pmi")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """text_hash and places (start, end): every occurrence of ``terms`` in every distinct text that holds one."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def find_words(batches):
        passing = Passing(bits.value)
        for batch in batches:
            for chunk in _chunks(batch):
                rows = []
                for key, text in chunk:
                    known = {w for w in distinct_words(text) if passing[w]}
                    places: dict[str, list] = {}
                    for m in _WORD.finditer(text) if known else ():
                        word = m[0].lower()
                        if word in known:
                            places.setdefault(word, []).append({"start": m.start(), "end": m.end()})
                    rows += [(key, w, p) for w, p in places.items()]
                columns = list(zip(*rows)) or [()] * 3
                kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["text_hash", "term", "places"])

    texts = docs.select(_text_key(F.col("text")).alias("text_hash"), "text")
    words = texts.mapInArrow(find_words, "text_hash long, term string, places array<struct<start:long,end:long>>")
    kept = words.join(terms, "term").dropDuplicates(["text_hash", "term"])
    return kept.groupBy("text_hash").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


REPORT = "n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_term long, n_spans long, base string, base_sha256 string, spans string, sanitised string"


def _report(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    rows = []
    for text, terms in zip(texts, places):
        base, secrets = base_spans(text), secret_spans(text)
        within = sorted((a, b) for _, a, b in base + secrets)
        added, k = [], 0
        for place in [] if terms is None else terms:
            a, b = place["start"], place["end"]
            while k < len(within) and within[k][1] <= a:
                k += 1
            if not any(x < b and a < y for x, y in within[k : k + len(KINDS) + 1]):
                added.append(("term", a, b))
        kinds, said = Counter(k for k, _, _ in base), spell(base)
        spans = spell(base + secrets + added)
        rows.append((*[kinds[k] for k in KINDS], len(secrets), len(added), len(base) + len(secrets) + len(added), said, hashlib.sha256(said.encode()).hexdigest(), spans, redact(text, spans)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in REPORT.split(", ")])


#: Texts with term places that are broadcast at most; more are joined by a shuffle.
BROADCAST_TEXTS = 200_000
#: ... and places of one broadcast at most, some 32 MB.
BROADCAST_PLACES = 1_000_000


def _reported(rows: DataFrame, text: Column, docs: DataFrame, alpha: float, support: int) -> DataFrame:
    """``rows`` with the report on their ``text`` as column _report."""
    terms = materialise(disclosing(docs, alpha, support).select("term").distinct(), "pii-disclosing")
    marks = materialise(term_places(docs, terms).withColumnRenamed("text_hash", "_marked"), "pii-places")
    size = marks.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("places")).alias("places")).first()
    few = size.texts <= BROADCAST_TEXTS and (size.places or 0) <= BROADCAST_PLACES
    joined = rows.join(F.broadcast(marks) if few else marks, _text_key(text) == F.col("_marked"), "left")
    return joined.withColumn("_report", F.pandas_udf(_report, REPORT)(F.coalesce(text, F.lit("")), F.col("places")))


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_spans, base, base_sha256, spans and sanitised of every
    row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return _reported(texts, F.col("text"), texts, alpha, support).select("doc_id", "_report.*")


def redact(text: str | None, spans: str | None) -> str:
    """The text with every span replaced; overlapping spans are covered by the one that starts first."""
    text, out, at = text or "", [], 0
    places = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in (spans or "").split(",") if x))
    for a, b, kind in places:
        if a < at:
            at = max(at, b)
            continue
        out.append(text[at:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        elif _DIGIT.search(text[a:b]):
            out.append(_DIGIT.sub("#", text[a:b]))
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """``docs`` with their texts sanitised; other columns, and texts without spans, unchanged."""
    rows = docs.select(F.struct("*").alias("row"))
    marked = _reported(rows, F.col("row.text"), docs.select("text"), alpha, support)
    clean = F.when(F.col("_report.spans") == "", F.col("row.text")).otherwise(F.col("_report.sanitised"))
    return marked.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
