"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to reveal a protected value."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh64_intdigest

from tidegauge.llm.common import lean, membership, possible, small_batches, stored

Span = tuple[str, int, int]

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w{3,}")
#: Words on either side of a value that count as standing with it: all of most texts. A list of values stays linear work.
REACH = 256
#: Standard normal quantile of the lower confidence bound, 95 % on one side.
QUANTILE = 1.645
#: Column that carries spans to the texts.
SPANS = "__tidegauge_spans"
#: Share of a value's information that a term may disclose.
THRESHOLD = 0.8


def emails(text: str) -> list[Span]:
    """Each ``@`` with the longest local part before it that the last match leaves, and its domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; offsets count code points."""
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> int:
    """A protected value as a number: case, blanks and marks in numbers don't tell values apart."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else re.sub(r"[^0-9]", "", value)
    return xxh64_intdigest(f"{kind}:{plain}".encode(), 42) - (1 << 63)  # as a signed long


def entities(kind: str, value: str) -> tuple[int, int]:
    """A value, and the class it belongs to: mail domain, network, issuer of a card, or number without its last four digits."""
    if kind == "email":
        group = "@" + value.split("@")[1]
    elif kind == "ip":
        group = ".".join(value.split(".")[:2]) + "."
    else:
        digits = re.sub(r"[^0-9]", "", value)
        group = "=" + (digits[:6] if kind == "card" else digits[:-4])
    return entity(kind, value), xxh64_intdigest(f"class:{kind}:{group.lower()}".encode(), 42) - (1 << 63)


class Words:
    """Words of a text with their places; those that a span of the fixed patterns covers are no terms."""

    def __init__(self, text: str, spans: list[Span]):
        found = list(WORD.finditer(text))
        self.starts, self.ends = [w.start() for w in found], [w.end() for w in found]
        self.terms: list[str | None] = [w[0].lower() for w in found]
        for _, a, b in spans:
            left, right = self.between(a, b)
            self.terms[left:right] = [None] * (right - left)

    def between(self, a: int, b: int) -> tuple[int, int]:
        """First word that ends after a, and first that starts at b or later."""
        left = bisect_left(self.ends, a + 1)
        return left, max(left, bisect_left(self.starts, b))


def companions(text: str, spans: list[Span], wanted: Callable[[list[int]], list[bool]]) -> dict[int, set[str]]:
    """For each value and class of a text that is ``wanted``, the terms within REACH words of one of its places."""
    words, out = Words(text, spans), {}
    for kind, a, b in spans:
        both = entities(kind, text[a:b])
        left, right = words.between(a, b)
        for e, yes in zip(both, wanted(list(both))):
            if yes:
                out.setdefault(e, set()).update(words.terms[max(0, left - REACH) : left], words.terms[right : right + REACH])
    return {e: terms - {None} for e, terms in out.items()}


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64())]
    + [(f"n_{k}", pa.int64()) for k in KINDS[:-1]]
    + [("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("held", pa.string())]
)
FOUND_DDL = (
    "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,"
    " entities array<long>, held string"
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc_id, text_hash, text in zip(*(c.to_pylist() for c in b.columns)):
            spans = base_spans(text or "")
            line = listed(spans)
            out.append(
                {"doc_id": doc_id, "text_hash": text_hash, "base": line, "base_sha256": hashlib.sha256(line.encode()).hexdigest()}
                | {f"n_{k}": sum(s[0] == k for s in spans) for k in KINDS[:-1]}
                | {"entities": list({e for k, x, y in spans for e in entities(k, text[x:y])}), "held": text if spans else None}
            )
        yield from pa.Table.from_pylist(out, schema=FOUND).to_batches()


def _companions(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(e, term) pairs of each text whose value the map ``bits`` may hold, each once a text."""

    def wanted(es: list[int]) -> list[bool]:
        return possible(bits, np.array(es, np.int64).view(np.uint64)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        es: list[int] = []
        terms: list[str] = []

        def paired() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(terms, pa.string())], names=["e", "term"])

        for b in batches:
            for text in b.column(0).to_pylist():
                for e, beside in companions(text, base_spans(text), wanted).items():
                    es += [e] * len(beside)
                    terms += beside
                    if len(es) > 20_000:
                        yield paired()
                        es.clear()
                        terms.clear()
        yield paired()

    return run


class Known:
    """Whether a term may be in a map of hashes, remembered."""

    def __init__(self, bits: np.ndarray, most: int = 200_000):
        self.bits, self.most, self.known = bits, most, {}

    def __call__(self, terms: set[str]) -> set[str]:
        if len(self.known) > self.most:
            self.known = {}
        new = [t for t in terms if t not in self.known]
        if new:
            hashes = np.array([xxh64_intdigest(t.encode(), 42) for t in new], np.uint64)
            self.known.update(zip(new, possible(self.bits, hashes).tolist()))
        return {t for t in terms if self.known[t]}


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text))}


def _repeated(bits: np.ndarray, yes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (text_hash, text) whose hash the map may hold, or those whose it can't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(possible(bits, b.column(0).to_numpy().view(np.uint64)) == yes))

    return run


def _terms(bits: np.ndarray):
    """Words that may be candidates and in how many texts of a task they stand, added up before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bits)
        seen: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for text in b.column(1).to_pylist():
                seen.update(known(terms_of(text or "")))
            if len(seen) > 200_000:
                yield counted()
                seen.clear()
        yield counted()

    return run


def _places(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text_hash, term, a, b) for each place of a term that the map may hold, outside spans of the fixed patterns."""
    names = ["doc_id", "text_hash", "term", "a", "b"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(bits)
        for batch in batches:
            out = []
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                hits = known(terms_of(text or ""))
                if hits:
                    words = Words(text, base_spans(text))
                    out += [(doc_id, text_hash, t, a, b) for t, a, b in zip(words.terms, words.starts, words.ends) if t in hits]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))


def findings(docs: DataFrame) -> DataFrame:
    """Base spans of every row, the values in it, and the text of rows that have any, stored."""
    small_batches(docs.sparkSession)
    return stored(_rows(docs).mapInArrow(lean(_find), FOUND_DDL), "personal-data")


def once_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(text_hash, text) of the different texts.

    Only texts that may repeat are shuffled; a map of fixed size tells the
    others apart in their tasks. When it is full, all texts are shuffled.
    """
    again = found.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = membership(again, "text_hash")
    rows = _rows(docs).select("text_hash", "text")
    single, double = (rows.mapInArrow(lean(_repeated(bits, yes)), "text_hash long, text string") for yes in (False, True))
    return single.unionByName(double.dropDuplicates(["text_hash"]))


def _disclosure(n_t: Column, total: float) -> Column:
    """Share of a value's information that a term of ``n_t`` texts gives away, by columns n_e and n_et."""
    m, z2 = n_t - 1, QUANTILE**2
    p = (F.col("n_et") - 1) / m
    low = (p + z2 / (2 * m) - QUANTILE * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
    return 1 + F.log(low) / F.log(F.lit(total - 1) / (F.col("n_e") - 1))


def disclosures(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(e, term, disclosure) of terms that give away at least THRESHOLD of the information of a value or a class of values.

    Counts are of different texts, so copies are no further evidence: N texts,
    n(e) with e, n(t) with term t anywhere, n(e, t) with t within REACH words of
    e. A text is judged by what all others tell: of n(t) - 1 other texts with t
    n(e, t) - 1 hold e, and p is the lower 95 % confidence bound (Wilson) of
    that share. The disclosure is the pointwise mutual information of p,
    log(p (N - 1) / (n(e) - 1)), over the information log((N - 1) / (n(e) - 1))
    of e: 1 means that t is sure to come with e, and a term or value of one text
    only tells nothing. All counts cover all texts; pairs that n(e) or n(e, t)
    already rule out are left out before more is counted: a term stands in at
    least as many texts as with any one value, and each further text without
    that value lowers its disclosure.
    """
    texts = found.dropDuplicates(["text_hash"])
    n_e = texts.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where("n_e > 1")
    n_e = stored(n_e, "values")
    held = found.where("held is not null").select("text_hash", "held").dropDuplicates(["text_hash"]).select("held")
    pairs = held.mapInArrow(lean(_companions(membership(n_e, "e"))), "e long, term string").groupBy("e", "term").agg(F.count(F.lit(1)).alias("n_et"))
    total = float(found.select("text_hash").distinct().count())
    pairs = pairs.where("n_et > 1")
    least = pairs.groupBy("term").agg(F.max("n_et").alias("least"))
    pairs = pairs.join(n_e, "e").where(F.col("n_e") < total).join(least, "term")
    pairs = stored(pairs.where(_disclosure(F.col("least"), total) >= THRESHOLD - 1e-6).drop("least"), "pairs")
    bits = membership(pairs.select("term").distinct().select(F.xxhash64("term").alias("h")), "h")
    n_t = once_each(docs, found).mapInArrow(lean(_terms(bits)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    scored = pairs.join(n_t, "term").withColumn("disclosure", _disclosure(F.col("n_t"), total))
    return scored.where(F.col("disclosure") >= THRESHOLD).select("e", "term", "disclosure")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, counts of base spans, base_sha256, all spans and the number of terms.

    Emails, addresses, cards and phones are found by fixed patterns in the
    whole text. A term that discloses a value, or a class of values such as a
    mail domain, is a span of kind ``term`` wherever it stands in any text,
    unless a fixed pattern covers it. Null and empty texts have no spans; rows
    that repeat get the same spans, and a text counts once; null ids are kept;
    an empty table gives none; further columns are ignored.
    """
    found = findings(docs)
    revealing = stored(disclosures(docs, found).select("term").distinct(), "disclosures")
    bits = membership(revealing.select(F.xxhash64("term").alias("h")), "h")
    places = _rows(docs).mapInArrow(lean(_places(bits)), "doc_id long, text_hash long, term string, a long, b long")
    marked = (
        places.join(revealing, "term", "left_semi")
        .groupBy(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"))
        .agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("terms"))
    )
    same = found["doc_id"].eqNullSafe(marked["m_id"]) & found["text_hash"].eqNullSafe(marked["m_hash"])
    term_list = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["a"], t["b"])), ",")
    return (
        found.drop("entities", "held")
        .join(marked, same, "left")
        .select(
            "doc_id",
            *[f"n_{k}" for k in KINDS[:-1]],
            "base_sha256",
            F.concat_ws(",", F.expr("nullif(base, '')"), term_list).alias("spans"),
            F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"),
            "text_hash",
        )
    )


def redact(text: str, spans: str) -> str:
    """Text with every span generalised to its kind; a term with a digit becomes a number, other terms go.

    Spans that overlap are one, named after the first.
    """
    cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in cuts:
        if a >= at:
            word = text[a:b]
            label = ("[NUMBER]" if any(c.isdigit() for c in word) else "") if kind == "term" else f"[{kind.upper()}]"
            out += [text[at:a], label]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.schema.names
        columns = dict(zip(names, b.columns))
        spans = columns.pop(SPANS).to_pylist()
        texts = [redact(t, s) if s else t for t, s in zip(columns["text"].to_pylist(), spans)]
        columns["text"] = pa.array(texts, columns["text"].type)
        if "n_chars" in columns:
            sizes = [len(t) if s else n for t, s, n in zip(texts, spans, columns["n_chars"].to_pylist())]
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sanitised(docs: DataFrame) -> DataFrame:
    """Documents with their personal data generalised or removed; n_chars follows the new text, other columns stay.

    All rows stay, repeated ones too, with null and empty texts as they are; an
    empty table gives none. Only a column called as SPANS would clash.
    """
    spans = personal_data(docs).where("spans <> ''").select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.col("spans").alias(SPANS)).distinct()
    same = docs["doc_id"].eqNullSafe(spans["s_id"]) & (F.xxhash64(docs["text"]) == spans["s_hash"])
    joined = docs.join(spans, same, "left").select(*[docs[c] for c in docs.columns], SPANS)
    return joined.mapInArrow(lean(_redact), StructType(docs.schema.fields))
