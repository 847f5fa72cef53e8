"""Operators with an exact definition, each against a plain version of it on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegauge.llm import common, decontam, packing, pii, search, sharding, simhash, substrings

WORDS = "the of and to in that is was he for it with as his on be at by i this had not are but from or have an".split()


def texts(n, seed=1, longest=60):
    """Texts of few different words, with copies, shared passages, nulls, empty and long ones."""
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(25)]
    out = []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(0, longest))]
        if i % 3 == 0:
            at = r.randint(0, len(words))
            words[at:at] = passage[r.randint(0, 6) :]
        out.append(r.choice([" ", "\n", "\t "]).join(words))
    out[1:4] = [None, "", "   \n"]
    out += out[4:8] + ["long " + " ".join(r.choice(WORDS) for _ in range(20_000))]
    return out


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names clash with those that operators make
    return df.selectExpr("*", "'x' as row", "1 as score", "2 as length", "3 as slot", "4 as rank", "5 as fp") if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t) for i, t in enumerate(texts(60))]
    return rows, frame(spark, rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- substrings


def plain_substrings(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs):
    rows, df = docs
    got = substrings.without_repeats(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == plain_substrings(rows)
    assert sum(r.n_removed for r in got) > 100
    assert all(sum(b - a for a, b in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("chunk", [1, 50, 1000])
def test_substrings_do_not_depend_on_chunks_and_batches(spark, monkeypatch, chunk):
    """Runs of a key that cross chunks and Arrow batches."""
    rows = [(i, t) for i, t in enumerate(texts(40, seed=chunk)[:40])]
    pairs = np.array([(k, i) for i, t in rows for k in {hash(w) % 97 for w in words(t)}], np.int64)
    parts = np.array_split(pairs, 5)
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    for whole in (True, False):
        dealt = pa.Table.from_batches(list(substrings.in_chunks(((p[:, :1], p[:, 1]) for p in parts), 1, whole)))
        dealt = dealt.sort_by([("k0", "ascending"), ("doc_id", "ascending")])
        for size in (1, 3, 1000):
            got = pa.Table.from_batches(list(substrings._shared(1, whole)(iter(dealt.to_batches(size)))))
            docs_of = {}
            for k, i in pairs.tolist():
                docs_of.setdefault(k, set()).add(i)
            want = {(k, i) for k, d in docs_of.items() for i in d if len(d) > 1 and (whole or i > min(d))}
            assert set(zip(got["k0"].to_pylist(), got["doc_id"].to_pylist())) == want


def test_substrings_of_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(14))
    rows = [(5, a), (5, a), (None, a), (2, "x " + a), (9, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.without_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 14, 0), (2, 15, 0), (5, 14, 14), (5, 14, 14), (9, 0, 0)]
    assert substrings.without_repeats(frame(spark, [])).collect() == []


def test_substrings_of_two_texts_of_one_id(spark):
    a = " ".join(f"w{i}" for i in range(14))
    rows = [(2, "x " + a), (5, a + " y"), (5, "quite another text")]
    got = {(r.doc_id, r.n_words): (r.n_removed, r.kept_sha256) for r in substrings.without_repeats(frame(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(2, 15): (0, sha("x " + a)), (5, 15): (14, sha("y")), (5, 3): (0, sha("quite another text"))}


# --- SimHash


def plain_print(text):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    members = {}
    for k, i in enumerate(ids):
        members.setdefault(find(k), []).append(i)
    return [min(members[find(k)]) for k in range(len(ids))]


def test_near_duplicates(docs):
    rows, df = docs
    rows = [r for r in rows if len(r[1] or "") < 5000]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df.where("length(text) < 5000 or text is null")).collect()}
    prints = [plain_print(t) for _, t in rows]
    assert got == {i: (p, c) for (i, _), p, c in zip(rows, prints, plain_components([i for i, _ in rows], prints))}


@pytest.mark.parametrize("text", ["", "A", "A b", "É é x", "a b c d", "x " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_masks_cover_every_pair_within_the_radius():
    for groups in simhash.MASKS:
        for group in groups[:3]:
            parents_free = sorted({p for _, left in group for p in left})
            for differ in combinations(parents_free[:20], simhash.RADIUS):
                assert any(set(differ) <= set(left) for _, left in group)
    assert max(len(left) for g in simhash.MASKS[-1] for _, left in g) < simhash.BUCKET.bit_length()


def test_links_of_a_hot_bucket(spark, monkeypatch):
    """Fingerprints that all lie close together are cut at further levels and stay connected as plain comparison has them."""
    r = random.Random(3)
    base = r.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(300)})
    monkeypatch.setattr(simhash, "BUCKET", 16)
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.near_links(spark.createDataFrame(rows, "fp long"))
    found = {r.node: r.root for r in common.components(edges).collect()}
    want = plain_components(list(range(len(prints))), prints)
    groups = {}
    for (p,), c in zip(rows, want):
        groups.setdefault(found.get(p, p), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_keep_one(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(4, a), (2, a), (2, a), (7, b), (None, b), (9, "")]
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, b), (2, a), (7, b), (9, "")]
    assert kept.columns == frame(spark, rows).columns
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


# --- packing


def test_pieces_are_the_tokenizers_ids(docs):
    rows, df = docs
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    got = packing.pack(df).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    check_sequences(got)


def check_sequences(rows):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sorted(sequences) == list(range(len(sequences)))


def test_repeated_and_hot_lengths(spark):
    rows = [(1, "same words here")] * 300 + [(None, None)] * 200 + [(2, "")]
    got = packing.pack(frame(spark, rows)).collect()
    assert len(got) == 501
    check_sequences(got)
    assert packing.pack(frame(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé1 .,'#\n\t ßΣσİ́<|>x "), max_size=30), max_size=6))
def test_word_ids_are_those_of_whole_texts(lines):
    encode = packing.word_ids(packing.TOKENIZER)
    want = [e.ids for e in encode.tokenizer.encode_batch(lines, add_special_tokens=False)]
    assert [x.tolist() for x in encode(lines)] == want


def test_special_tokens_in_a_text():
    encode = packing.word_ids(packing.TOKENIZER)
    text = "a <|endoftext|> b<|startoftext|>c"
    assert encode([text, "x"])[0].tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_patterns_hold_each_length_once(counts):
    patterns = packing.shortest_pack_first(counts, 64)
    assert all(sum(p) <= 64 and n > 0 for p, n in patterns)
    placed = Counter()
    for p, n in patterns:
        for length in p:
            placed[length] += n
    assert placed == Counter(counts)
    assert len(patterns) <= 2 * max(1, len(counts))


# --- search


def test_search(docs, spark):
    rows, df = docs
    asked = [(i, t) for i, t in rows if i % 5 == 0]
    split = [re.findall(r"[a-z]+", (t or "").lower()) for _, t in rows]
    mean = sum(map(len, split)) / len(split)
    df_of = Counter(w for s in split for w in set(s))
    want = []
    for q, t in asked:
        scores = []
        for (i, _), s in zip(rows, split):
            tf, total = Counter(s), 0.0
            for w in set(re.findall(r"[a-z]+", (t or "").lower())) & tf.keys():
                idf = math.log(1 + (len(rows) - df_of[w] + 0.5) / (df_of[w] + 0.5))
                total += idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(s) / mean))
            if total:
                scores.append((-round(total, 6), i))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10])]
    got = search.top_k(df, spark.createDataFrame(asked, "query_id long, text string")).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(want)


def test_search_does_not_depend_on_shards(docs, spark, monkeypatch):
    rows, df = docs
    asked = spark.createDataFrame([r for r in rows if r[0] % 4 == 0], "query_id long, text string")
    want = sorted(search.top_k(df.coalesce(1), asked).collect())
    index = search.Shard.top
    monkeypatch.setattr(search, "QUERIES", 3)
    assert sorted(search.top_k(df.repartition(7), asked).collect()) == want
    assert index is search.Shard.top
    assert search.top_k(frame(spark, []), asked).collect() == []
    assert search.top_k(df, asked.where("false")).collect() == []


def test_queries_of_one_id_are_one_query(spark):
    docs = frame(spark, [(1, "red green blue"), (2, "red red"), (3, "grey")])
    ask = lambda rows: {(r.query_id, r.doc_id): r.score for r in search.top_k(docs, spark.createDataFrame(rows, "query_id long, text string")).collect()}
    once = ask([(7, "red green")])
    assert once and ask([(7, "red green"), (7, "red green")]) == once == ask([(7, "red"), (7, "green red")])
    assert {k[1]: v for k, v in ask([(None, "red green"), (None, "green")]).items()} == {k[1]: v for k, v in once.items()}


def test_blocks_are_skipped():
    """With one rare term most blocks have no bound at all and a common term alone can't reach the best."""
    r = np.random.default_rng(1)
    n = 4000
    terms = [np.array([1]) if i % 400 else np.array([1, 2]) for i in range(n)]
    sizes = np.array([len(t) for t in terms])
    shard = search.Shard(n, r.integers(5, 50, n), np.concatenate(terms), np.ones(sizes.sum(), np.int64), sizes, 20.0)
    found, scores = shard.top(np.array([0, 1]), np.array([0.01, 5.0]))
    assert sorted(found.tolist()) == list(range(0, n, 400)) and len(scores) == 10


# --- sharding


def test_table_is_even_and_stable():
    table = sharding.filled(range(32))
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1 and len(shares) == 32
    without = sharding.filled([s for s in range(32) if s != 9])
    moved = sum(a != b for a, b in zip(table, without) if a != 9)
    assert moved < 0.05 * len(table)
    for bad in ([], [1, 1], [-1]):
        with pytest.raises(ValueError):
            sharding.filled(bad)
    with pytest.raises(ValueError):
        sharding.filled(range(4), 4096)


def test_sharded_rows(spark):
    rows = [(i, None) for i in range(-50, 500)] + [(None, "n"), (7, "again")]
    df = frame(spark, rows)
    got = sharding.sharded(df, "doc_id").collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r.doc_id, set()).add((r.slot, r.shard))
    assert all(len(v) == 1 for v in by_key.values())
    assert by_key[None] == {(0, sharding.filled(range(32))[0])}
    table = sharding.filled(range(32))
    assert all(table[r.slot] == r.shard for r in got)
    assert sharding.sharded(df.where("false"), "doc_id").collect() == []


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab.@-%+0192 ()٣é4"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text",
    ["1" * 100_000, "a" * 100_000 + "@", "@" * 50_000, "+1(" * 50_000, "1." * 60_000, "call +1 (555) 010-9999 or 4111 1111 1111 1111", "a@b.c@d.e"],
)
def test_base_spans_of_long_runs(text):
    assert pii.base_spans(text) == (plain_spans(text) if len(text) < 200 else pii.base_spans(text))


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def personal_rows():
    tell = [(i, f"Dear reader write to anna@example.org about the zanzibar plan number {i}") for i in range(8)]
    plain = [(20 + i, f"Dear reader nothing about the plan here {i}") for i in range(40)]
    return tell + plain + [(90, "anna@example.org alone"), (91, None), (92, ""), (None, "x 10.0.0.1 y"), (93, "x 10.0.0.1 y")]


def test_terms_that_reveal_a_value(spark):
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, personal_rows())).collect()}
    text = personal_rows()[3][1]
    terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[3].spans.split(",")) if k == "term"}
    # these stand beside the value and nowhere else; "reader", "about" and "plan" stand elsewhere too
    assert terms == {"write", "zanzibar", "number"}
    assert got[3].spans.startswith("email:") and got[3].n_email == 1
    assert got[25].spans == "" and got[91].spans == "" and got[90].n_term == 0
    assert got[None].n_ip == got[93].n_ip == 1
    assert got[92].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(frame(spark, [])).collect() == []


def plain_disclosures(rows):
    """All pairs of a value or class and a term, by sets of texts."""
    texts = {t for _, t in rows}
    holders, with_term, both = {}, {}, {}
    for t in texts:
        spans = pii.base_spans(t or "")
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w{3,}", t or "")]
        for w in words:
            with_term.setdefault(w[0], set()).add(t)
        for k, a, b in spans:
            before = [w for w in words if w[2] <= a][-pii.REACH :]
            after = [w for w in words if w[1] >= b][: pii.REACH]
            for e in pii.entities(k, t[a:b]):
                holders.setdefault(e, set()).add(t)
                for w, x, y in before + after:
                    if not any(x < d and c < y for _, c, d in spans):
                        both.setdefault((e, w), set()).add(t)
    out, others = {}, len(texts) - 1
    for (e, w), found in both.items():
        k, m, h = len(found) - 1, len(with_term[w]) - 1, len(holders[e]) - 1
        if k and h < others:
            p, z = k / m, pii.QUANTILE
            low = (p + z * z / 2 / m - z * math.sqrt(p * (1 - p) / m + z * z / 4 / m / m)) / (1 + z * z / m)
            share = math.log(low * others / h) / math.log(others / h)
            if share >= pii.THRESHOLD:
                out[e, w] = share
    return out


def revealing_rows():
    """Values of one mail domain, each with a word of its own that stands far from it, and copies of a text."""
    filler = " ".join(f"plain{k}" for k in range(25))
    rows = [(i, f"xylograph {filler} mail user{i}@hidden.example.net {filler} row{i}") for i in range(6)]
    rows += [(10 + i, f"quillon note {i} from +1 (017) 555-7713 {filler}") for i in range(5)]
    rows += [(20 + i, f"single copy of 10.1.2.3 {filler}") for i in range(30)]
    rows += [(100 + i, f"mail note from copy {filler} again number{i}") for i in range(500)]
    return rows + [(700, "Xylograph stands here without a value"), (701, None), (702, ""), (None, "Quillon alone, quillon")]


@pytest.mark.parametrize("rows", [personal_rows, revealing_rows])
def test_disclosures_equal_a_plain_count(spark, rows):
    df = frame(spark, rows())
    got = {(r.e, r.term): r.disclosure for r in pii.disclosures(df, pii.findings(df)).collect()}
    want = plain_disclosures(rows())
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_terms_go_wherever_they_stand(spark):
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, revealing_rows())).collect()}
    assert "term:0:9" in got[0].spans and got[0].spans.startswith("email:")  # 27 words before the value
    assert got[700].spans == "term:0:9" and got[700].n_term == 1  # in a text without any value
    assert got[None].spans == "term:0:7,term:15:22"
    assert "term:0:7" in got[12].spans
    assert got[20].n_term == 0 and got[20].n_ip == 1  # thirty copies of one text are no evidence
    assert got[100].spans == "" and got[701].spans == "" and got[702].spans == ""


def test_sanitised(spark):
    rows = personal_rows()
    df = frame(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
    got = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert got[3].text == "Dear reader  to [EMAIL] about the  plan  3" and got[3].n_chars == len(got[3].text)
    assert got[25].text == rows[13][1] and got[91].text is None and len(got) == len(rows)


def test_redact_overlaps():
    assert pii.redact("abcdef", "card:1:4,phone:2:5") == "a[CARD]f"
    assert pii.redact("a 12x b", "term:2:5") == "a [NUMBER] b"


# --- decontamination


def test_masks_catch_every_pattern_of_two_substitutions():
    base = [f"w{i}" for i in range(decontam.SPAN)]
    own = decontam.seed_hashes(base)[:, 0]
    for differ in combinations(range(decontam.SPAN), decontam.DIFFER):
        changed = [f"x{i}" if i in differ else w for i, w in enumerate(base)]
        assert (decontam.seed_hashes(changed)[:, 0] == own).any()


def plain_overlap(doc, item):
    """Whether some span of the item agrees in all but two words with a span of the document."""
    d, t = decontam.words_of(doc), decontam.words_of(item)
    return any(
        sum(a == b for a, b in zip(d[i : i + 13], t[j : j + 13])) >= 11 for i in range(len(d) - 12) for j in range(len(t) - 12)
    )


def test_contaminations(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(r.randint(10, 40)))) for k in range(12)] + [(90, None), (91, "short one")]
    docs = []
    for i in range(80):
        w = [word() for _ in range(r.randint(0, 80))]
        if i % 2:
            part = items[i % 12][1].split()
            part = part[r.randint(0, 3) :]
            for _ in range(r.randint(0, 5)):
                part[r.randrange(len(part))] = "zzz"
            w[5:5] = [x.upper() + "," for x in part]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (None, items[0][1] + " " + items[0][1]), (102, items[3][1]), (102, items[3][1])]
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminations(frame(spark, docs), frame_items).collect()
    want = {(i, k) for i, d in docs for k, t in items if plain_overlap(d, t)}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 20
    for r in got:
        assert r.overlap_words >= 13 and r.same_words >= 0.8 * r.overlap_words * 0.9
    kept = decontam.drop_contaminated(frame(spark, docs), frame_items)
    bad = {i for i, _ in want}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert kept.columns == frame(spark, docs).columns
    assert decontam.contaminations(frame(spark, docs), frame_items.where("false")).collect() == []
    assert decontam.contaminations(frame(spark, []), frame_items).collect() == []


def test_words_that_can_disclose_nothing_are_not_counted(spark, monkeypatch):
    """A word in two of the many texts with a value can't disclose it wherever else it stands: it is not counted in all texts."""
    names, stored = [], pii.stored

    def seen(df, name):
        out = stored(df, name)
        if name == "pairs":
            names.extend(r.term for r in out.select("term").distinct().collect())
        return out

    monkeypatch.setattr(pii, "stored", seen)
    rows = [(i, f"common words of letter {i} reach {'zebra' * (i < 2)} many.people@example.org") for i in range(60)]
    rows += [(200 + i, f"nothing here {i}") for i in range(2000)]
    df = frame(spark, rows)
    got = {(r.e, r.term): r.disclosure for r in pii.disclosures(df, pii.findings(df)).collect()}
    want = plain_disclosures(rows)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert {"reach", "common"} <= {t for _, t in got} <= set(names) and "zebra" not in names
