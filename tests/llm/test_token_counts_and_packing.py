import gc
import random
import re
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specaudit.llm import packing, pretokens
from specaudit.llm.packing import balanced, pack
from specaudit.llm.pretokens import Vocabulary
from specaudit.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


ROWS = [(1, None), (2, ""), (3, " "), (4, "Hello world's  end\n\n"), (4, "Hello world's  end\n\n"), (None, "a<|endoftext|>b <|endoftext|>"), (6, "x² Ⅻ 漢字 \x1c\x85 😀 ‑ “q”"), (7, prose(random.Random(3), 9000)), (8, "A" * 50_000), (9, "the " * 2047 + "the")]


@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\t\n<|endoftext|>s²½ªº")), max_size=30))
@settings(max_examples=400, deadline=None)
def test_pretokens_are_coded_as_the_library_codes_texts(text):
    vocabulary = Vocabulary(PATH, lambda tokens: [t.id for t in tokens])
    for t in (text, text + "<|endoftext|>" + text):
        items = vocabulary.split(t)
        known = vocabulary.learn(items)
        assert [i for x in items for i in known[x]] == ids(t)


def test_counts(spark):
    got = token_counts(documents(spark, ROWS), PATH, 512).collect()
    want = [(d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t in ROWS]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=repr) == sorted(want, key=repr)
    assert token_counts(documents(spark, []), PATH).collect() == []


def test_memo_can_overflow(monkeypatch):
    monkeypatch.setattr("specaudit.llm.pretokens.MEMO", 3)
    vocabulary = Vocabulary(PATH, len)
    for text in ("a b c d e f", "a b", "g h i j"):
        items = vocabulary.split(text)
        assert sum(vocabulary.learn(items)[x] for x in items) == len(ids(text))


def check_packing(rows, want, capacity):
    """Every id of every document once, sequences gapless and within capacity."""
    sequences = defaultdict(list)
    documents_ = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        documents_[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, coded in want.items():
        raw = b"".join(np.array(x, "<u4").tobytes() for x in coded)
        pieces = sorted(documents_.pop(doc))
        if len(coded) == 1:
            assert b"".join(p for _, p, _ in pieces) == raw
            assert all(total == len(coded[0]) for *_, total in pieces)
        else:  # equal rows
            assert sum(len(p) for _, p, _ in pieces) == len(raw)
    assert not documents_


@pytest.mark.parametrize("tokens", [1 << 18, 4000])
def test_packing_holds_every_id_once(spark, monkeypatch, tokens):
    monkeypatch.setattr("specaudit.llm.packing.GROUP_TOKENS", tokens)
    want = defaultdict(list)
    for d, t in ROWS:
        want[d].append([*ids(t), 1])
    rows = pack(documents(spark, ROWS), PATH, 2048).collect()
    check_packing(rows, want, 2048)
    if tokens > 4000:
        total = sum(r.length for r in rows)
        assert len({r.sequence_id for r in rows}) == -(-total // 2048)


def test_no_id_makes_a_large_group_and_short_documents_little_padding(spark, monkeypatch):
    monkeypatch.setattr("specaudit.llm.packing.GROUP_TOKENS", 1 << 14)
    rows = [(None if i % 3 == 0 else i % 7, None) for i in range(100_000)]
    got = pack(documents(spark, rows).repartition(5), PATH, 128).select("sequence_id", "length").collect()
    groups, sequences = defaultdict(int), defaultdict(int)
    for r in got:
        groups[r.sequence_id >> 24] += r.length
        sequences[r.sequence_id] += r.length
    assert len(groups) == 6 and max(groups.values()) < 2 * len(rows) / len(groups)
    assert sum(sequences.values()) == len(rows) and len(rows) > 0.99 * 128 * len(sequences)


def test_values_with_a_full_memo(monkeypatch):
    for bounds in ((3, 1 << 20), (1000, 2)):
        monkeypatch.setattr("specaudit.llm.pretokens.MEMO", bounds[0])
        monkeypatch.setattr("specaudit.llm.pretokens.MEMO_BYTES", bounds[1])
        vocabulary = Vocabulary(PATH, lambda tokens: [t.id for t in tokens])
        for text in ("a b c d e f", "a b", "g h i j a", "<|endoftext|>a b"):
            assert [i for v in vocabulary.values(vocabulary.split(text)) for i in v] == ids(text)


def test_values_are_looked_up_in_one_pass_and_worked_out_once():
    class Items(list):
        passes = 0

        def __iter__(self):
            self.passes += 1
            return super().__iter__()

    coded = []
    vocabulary = Vocabulary(PATH, lambda tokens: coded.append(tokens) or [t.id for t in tokens])
    coded.clear()  # the special tokens
    items = Items(vocabulary.split("one two two three, one"))
    assert [i for v in vocabulary.values(items) for i in v] == ids("one two two three, one")
    assert items.passes == 1 and len(coded) == len(set(items))


def test_listed_characters_split_as_their_kinds_do():
    kinds = re.compile(r"'(?:[stmd]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    rest = [c for c in map(chr, range(0x110000)) if not pretokens._ODD.match(c)]
    rng = random.Random(3)
    for c in rest:
        text = f"a{c} {c}1{c}'{c}  {c}_" + "".join(rng.choices(rest, k=20))
        assert pretokens._SPLIT_LATIN.findall(text) == kinds.findall(text)


def test_a_task_leaves_no_vocabulary_behind():
    vocabulary = packing._vocabulary(PATH)
    vocabulary.values(["a", "b"])
    kept = weakref.ref(vocabulary)
    gc.disable()  # nothing but counted references is needed
    try:
        del vocabulary
        assert kept() is None
    finally:
        gc.enable()


def test_packing_of_nothing(spark):
    assert pack(documents(spark, []), PATH).collect() == []


@given(st.lists(st.integers(1, 64), max_size=60))
def test_balanced_places_each_token_once_with_little_padding(lengths):
    placed = balanced(lengths, 64)
    used = defaultdict(set)
    for k, a, n, s, o in placed:
        assert n > 0 and 0 <= o and o + n <= 64
        assert not used[s] & set(range(o, o + n))
        used[s] |= set(range(o, o + n))
    assert all(x == set(range(len(x))) for x in used.values())
    got = defaultdict(int)
    for k, a, n, *_ in sorted(placed):
        assert got[k] == a
        got[k] += n
    assert [got[k] for k in range(len(lengths))] == lengths
    assert len(used) == -(-sum(lengths) // 64)


def test_pieces_go_in_descending_order_to_the_cheapest_sequence_with_room():
    rng = random.Random(5)
    lengths = [rng.randint(1, 2047) for _ in range(400)]
    cost = lambda n: n + n * n / 1024
    placed = balanced(lengths, 2048)
    sequences = range(-(-sum(lengths) // 2048))
    spent, used = dict.fromkeys(sequences, 0.0), dict.fromkeys(sequences, 0)
    for k, _, n, s, o in placed:
        assert o == used[s] and spent[s] == min(spent[x] for x in sequences if used[x] < 2048)
        spent[s] += cost(n)
        used[s] += n
    order = list(dict.fromkeys(lengths[k] for k, *_ in placed))
    assert order == sorted(order, reverse=True)
