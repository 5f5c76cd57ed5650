import random

import numpy as np
import pyarrow as pa

from specaudit.llm import batches as B


def test_words_and_hashes_match_a_plain_split():
    rng = random.Random(1)
    texts = ["", None, "one", "  a  b ", "é ü", "a b", "x" * (B.BLOCK_BYTES + 9) + " y"] + ["".join(rng.choice("ab \n") for _ in range(40)) for _ in range(50)]
    data, borders = B.text_bytes(pa.array(texts))
    space = np.isin(data, list(b" \n"))
    starts, ends, first = B.word_borders(~space, borders)
    hashes = B.word_hashes(data, starts, ends)
    seen: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        got = [data[s:e].tobytes() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
        assert got == words
        for w, h in zip(words, hashes[first[i] : first[i + 1]]):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sliced_keeps_every_row_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 50, "", "c"]})
    parts = list(B.sliced([batch, batch.slice(0, 0)], most=8))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) == 3


def test_windows_do_not_cross_texts():
    words = np.arange(7, dtype=np.uint64)
    hashes, bounds = B.window_hashes(words, np.array([0, 3, 3, 4, 7]), 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 2] and len(set(hashes.tolist())) == 4


def test_free_name():
    assert B.free_name(["A", "a_"], "a") == "a__"


def test_memory_goes_back_before_and_after_a_task_and_after_a_large_group(monkeypatch):
    done = []
    monkeypatch.setattr(B, "give_back", lambda: done.append("back"))
    batch = pa.RecordBatch.from_pydict({"text": ["a"]})
    for part in B.tidied(lambda batches: iter(batches))([batch, batch]):
        done.append(part.num_rows)
    assert done == ["back", 1, 1, "back"]
    done.clear()
    for size in (1, B.GROUP_BYTES):
        table = pa.table({"text": ["a" * size]})
        assert B.tidied_group(lambda t: t)(table) is table
    assert done == ["back"]
