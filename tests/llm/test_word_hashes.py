"""Words hashed from whole buffers of text, without an object or a remembered entry for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidegauge.llm import common, decontam, substrings

ODD = [
    None,
    "",
    "  ,. ",
    "one",
    "Two words, and_more\tX9 don't",
    "İstanbul ΣΟΣ naïve 中文 \U0001f600 á̱ १२ Ⅷ x­ y",
    "a\x00b c\x85d e f",
    "w" * 8 + " " + "w" * 9 + " " + "w" * 64 + " " + "w" * 65 + " " + "é" * 500,
]


def test_words_hashed_depends_on_the_bytes_of_a_word_alone():
    words = [b"a", b"a\0", b"\0", b"12345678", b"123456781", b"x" * 16, b"x" * 17, b"y" * 64, b"y" * 65, b"y" * 66, b"z" * 5000]
    raw = b"".join(words) + b"!" + b"".join(reversed(words))
    sizes = np.array([len(w) for w in words])
    firsts = np.cumsum(sizes) - sizes
    back = np.cumsum(sizes[::-1]) - sizes[::-1] + sizes.sum() + 1
    h = common.words_hashed(raw, firsts, sizes, 1)
    assert len(set(h.tolist())) == len(words)
    assert (common.words_hashed(raw, back[::-1], sizes, 1) == h).all()
    assert (common.words_hashed(raw, firsts, sizes, 2) != h).all()
    assert len(common.words_hashed(b"", sizes[:0], sizes[:0], 1)) == 0


def test_hashed_words_are_the_words_of_each_text():
    for texts in (ODD, ODD[:5], ODD[:1], [], ["x"], [None, None]):
        h, sizes = decontam.hashed_words(texts)
        words = [decontam.words_of(t) for t in texts]
        assert sizes.tolist() == [len(w) for w in words]
        flat = [w.encode() for line in words for w in line]
        ends = np.cumsum([len(w) for w in flat]).astype(np.int64)
        plain = common.words_hashed(b"".join(flat), np.append(0, ends[:-1])[: len(ends)], np.diff(ends, prepend=0), decontam.SEED)
        assert h.tolist() == plain.tolist()


def test_regions_do_not_depend_on_neighbours_and_chunks(monkeypatch):
    """A span never reaches into the next text, and each text is found alone as well as among others."""
    item = " ".join(f"w{i}" for i in range(20))
    texts = [item.rsplit(" ", 10)[0], " ".join(item.split()[10:]), "é " + item + " x", *ODD, item.upper(), "q " * 100 + item + " q" * 100 + item]
    bits = np.zeros(common.MAP_BITS // 8, np.uint8)
    for h in decontam.seed_hashes(decontam.words_of(item)).ravel().tolist():
        for x in (h & (common.MAP_BITS - 1), (h >> 32) & (common.MAP_BITS - 1)):
            bits[x >> 3] |= 1 << (x & 7)

    def found(rows):
        n = range(len(rows))
        batch = pa.RecordBatch.from_arrays([pa.array(n, pa.int64())] * 3 + [pa.array(rows, pa.string())], names=["a", "b", "c", "text"])
        return [(rows[r["doc_id"]], r["start"], r["words"], r["hits"]) for x in decontam._regions(bits)(iter([batch])) for r in x.to_pylist()]

    want = [r for t in texts for r in found([t])]
    assert len(want) == 4 and {r[0] for r in want} == {texts[2], texts[-2], texts[-1]}
    assert found(texts) == want
    monkeypatch.setattr(decontam, "CHUNK", 50)
    assert found(texts) == want


def test_words_of_substrings_lie_in_one_buffer():
    texts = [*ODD, " \t a\n\nb  c \x0b", "\x1f \x85"]
    words = substrings.Words(texts)
    lines = [substrings.words_of(t) for t in texts]
    flat = [w for line in lines for w in line]
    assert words.sizes.tolist() == [len(x) for x in lines]
    assert words.lines == [b" ".join(x) for x in lines]
    at = np.arange(len(flat))
    assert words.joined(at, np.ones_like(at)) == flat
    assert words.joined(at[:-3], np.full(len(at) - 3, 4)) == [b" ".join(flat[i : i + 4]) for i in at[:-3].tolist()]
    assert words.row.tolist() == [i for i, x in enumerate(lines) for _ in x]
    assert len(substrings.Words([None, ""]).hashes) == 0


def test_pairs_are_held_by_row_and_both_numbers(monkeypatch):
    r = np.random.default_rng(7)
    lists = [None if i == 2 else [{"k0": int(a), "k1": int(b)} for a, b in r.integers(-3, 3, (i, 2))] for i in range(9)]
    column = pa.array(lists, pa.list_(pa.struct([("k0", pa.int64()), ("k1", pa.int64())])))
    rows, first, second = np.repeat(np.arange(9), 36), *np.tile(np.mgrid[-3:3, -3:3].reshape(2, -1), 9)
    want = [{"k0": a, "k1": b} in (lists[i] or []) for i, a, b in zip(rows.tolist(), first.tolist(), second.tolist())]
    assert substrings.held(rows, first, second, column).tolist() == want
    monkeypatch.setattr(substrings, "mixed", lambda x: x * np.uint64(0))  # keys of different pairs agree
    assert substrings.held(rows, first, second, column).tolist() == want
    assert not substrings.held(rows, first, second, column.slice(2, 1)).any()
    assert len(substrings.held(rows[:0], first[:0], second[:0], column)) == 0
