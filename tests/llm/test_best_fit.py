"""Best-fit packing: plans against brute force, placements against the texts' own ids."""

import zlib
from array import array
from collections import Counter, defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceframe.llm import best_fit as B
from traceframe.llm.tokens import public_path

WORDS = public_path("word_bpe_49k.json")


TOKENIZER = Tokenizer.from_file(WORDS)


@cache
def own_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def used(patterns):
    n = Counter()
    for pattern, times in patterns:
        for x in pattern:
            n[x] += times
    return n


def decreasing(counts, capacity):
    """Sequences that best fit by decreasing length takes, piece by piece."""
    gaps = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(fit)
            gaps.append(fit - x)
    return len(gaps)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plans_use_every_piece_once_and_waste_little(counts):
    patterns = B.plan(counts, 40)
    assert used(patterns) == Counter(counts) and all(sum(p) <= 40 and n > 0 for p, n in patterns)
    sequences, least = sum(n for _, n in patterns), -(-sum(x * n for x, n in counts.items()) // 40)
    assert least <= sequences <= max(decreasing(counts, 40) * 1.1 + 1, least)


def closed_by(sums, gap, counts):
    """Whether up to three of the pieces have the sum ``gap``, tried one by one."""
    from itertools import combinations_with_replacement

    return any(sum(c) == gap and not Counter(c) - Counter(counts) for k in (1, 2, 3) for c in combinations_with_replacement(sums, k))


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=7), st.integers(1, 30), st.lists(st.integers(1, 30), max_size=3))
@settings(max_examples=400, deadline=None)
def test_a_gap_is_closed_whenever_one_two_or_three_pieces_do(counts, gap, begun):
    free = B.Complements(counts, 30)
    held = Counter(x for x in begun if x in counts)
    held = Counter({x: min(n, counts[x]) for x, n in held.items()})
    left = Counter(counts) - held
    found = free.closing(gap, held)
    if found:
        assert sum(found) == gap and len(found) <= 3 and not Counter(found) - left
    else:
        assert not closed_by(sorted(left), gap, left)


def test_the_index_of_pair_sums_follows_what_is_taken():
    free = B.Complements({3: 2, 5: 1, 9: 4, 10: 1}, 20)
    for pattern in ([9, 5, 3], [10, 9], [9, 9]):
        free.take(pattern)
        there = [x for x in (3, 5, 9, 10) if free.left[x]]
        want = Counter(a + b for i, a in enumerate(there) for b in there[i + 1 :])
        assert {s: int(n) for s, n in enumerate(free.pairs) if n} == {s: n for s, n in want.items() if s <= 20}


def test_a_plan_does_not_grow_with_the_counts():
    small = {x: 1 + 6000 // (x + 100) for x in range(1, 4097)}
    large = B.plan({x: n * 10**9 for x, n in small.items()})
    assert len(large) < 2 * 4096 and sum(n for _, n in large) <= 1.001 * sum(x * n * 10**9 for x, n in small.items()) / 4096


def told(rows, texts, capacity):
    """Checks of the contract; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, mine in by_doc.items():
        ids = own_ids(texts[doc])
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        for r in mine:
            part = ids[capacity * r.piece : capacity * (r.piece + 1)]
            assert (r.start, r.length, r.ids_crc32) == (capacity * r.piece, len(part), zlib.crc32(array("I", part).tobytes()))
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_whole_table_is_packed_as_tightly_as_it_can_be(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    found = B.op11_best_fit(spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    n = told(rows, texts, 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) + 1
    assert len(rows) == sum(-(-len(own_ids(t)) // 4096) for t in texts.values())


def test_edges_small_sequences_and_whole_ids(spark, docs):
    texts = {i: " ".join(["word"] * (i % 23)) for i in range(150)} | {200: None, 201: "", 202: "a b " * 700}
    table = docs(list(texts.items()), length=3, shard="s", nth=2, ids="i", number=1).repartition(5)
    found = B.pack(table, WORDS, capacity=32, with_ids=True)
    assert told(found.drop("ids").collect(), texts, 32) > 40
    whole = {r.sequence_id: r for r in B.sequences(found).collect()}
    for r in found.collect():
        ids = bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert ids == bytes(r.ids) and sum(whole[r.sequence_id].lengths) <= 32
    assert B.pack(docs([]), WORDS).collect() == []


def test_repeated_rows_null_ids_and_ids_that_are_words(spark, docs):
    rows = B.pack(docs([(1, "a b c"), (1, "a b c"), (None, "x"), (None, None)]), WORDS).collect()
    assert Counter((r.doc_id, r.length) for r in rows) == Counter({(1, 4): 2, (None, 2): 1, (None, 1): 1})
    assert len({(r.sequence_id, r.offset) for r in rows}) == 4 and len({r.sequence_id for r in rows}) == 1
    named = B.pack(spark.createDataFrame([("k", "a b")], "name string, body string"), WORDS, id_col="name", text_col="body")
    assert [tuple(r)[:4] for r in named.collect()] == [("k", 0, 0, 3)]


def test_a_length_that_a_third_of_the_rows_have(spark, docs):
    texts = {i: "word " * 9 if i % 3 == 0 else "word " * (i % 31) for i in range(900)}
    rows = B.pack(docs(list(texts.items())).repartition(40), WORDS, capacity=64).withColumn("one", F.lit(1)).drop("one").collect()
    assert told(rows, texts, 64) <= -(-sum(r.length for r in rows) // 64) + 1


@pytest.mark.parametrize("capacity", [1, 2, 5])
def test_tiny_capacities(spark, docs, capacity):
    texts = {1: "a b c d e f g", 2: "a", 3: None}
    told(B.pack(docs(list(texts.items())), WORDS, capacity=capacity).collect(), texts, capacity)
