"""What workers remember from stage to stage of a pipeline."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa

from tidegauge.llm import common, packing, toxicity


def test_toxicity_gives_up_what_packing_remembered():
    encode = packing.word_ids(packing.TOKENIZER)
    assert packing.word_ids(packing.TOKENIZER) is encode  # kept between tasks of packing
    encode(["some words of a text"])
    gone = weakref.ref(encode)
    del encode
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a text"]), pa.array([2])], names=["doc_id", "text", "text_hash"])
    net = toxicity.Network.fresh({b"text": 0})
    assert next(toxicity._scored(net)(iter([batch]))).num_rows == 1
    gc.collect()
    assert gone() is None


def test_one_operator_is_remembered():
    first = common.remembered("a", list)
    assert common.remembered("a", list) is first
    common.remembered("b", list)
    assert common.remembered("a", list) is not first


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = [f"word{i} other{i % 3} text" for i in range(40)]
    net = toxicity.Network.fresh({b"text": 0})
    want = [net.scores([t])[0] for t in texts]
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    net.known, net.inputs = {}, net.inputs[:0]
    got = [net.scores([t])[0] for t in texts]
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6
    assert len(net.known) <= 5 + 3


def test_texts_are_cut_to_words_few_at_a_time(monkeypatch):
    many = []
    rows_of, ids = toxicity.Network.rows_of, packing.WordIds.__call__
    monkeypatch.setattr(toxicity.Network, "rows_of", lambda net, parts: rows_of(net, (many.append(len(p)) or p for p in parts)))
    monkeypatch.setattr(packing.WordIds, "__call__", lambda encode, texts: many.append(len(texts)) or ids(encode, texts))
    texts = [f"text{i}" for i in range(300)]  # a word each
    net = toxicity.Network.fresh({b"text": 0})
    scores = net.scores(texts)
    assert max(many) <= 128 and sum(many) == len(texts)
    assert max(abs(a - net.scores([t])[0]) for a, t in zip(scores, texts)) < 1e-6
    many.clear()
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), pa.array(texts)], names=["doc_id", "row", "text"])
    assert [b["row"].to_pylist() for b in packing._pieces(packing.TOKENIZER)(iter([batch]))] == [list(range(300))]
    assert max(many) <= 128 and sum(many) == len(texts)


def test_a_worker_holds_no_freed_memory_after_a_task():
    def held():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    pins = []

    def hungry(batches):
        for b in batches:
            kept = [b"x" * 60_000 for _ in range(4000)]  # 240 MB of the heap, too small to be mapped each for itself
            pins.append(b"x" * 60_000)  # above them, so that the heap can't just end lower
            del kept
            yield b

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    before = held()
    assert [b["a"].to_pylist() for b in common.lean(hungry)(iter([batch, batch]))] == [[1], [1]]
    assert held() - before < 60_000_000
