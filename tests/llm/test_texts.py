"""Packing, mixing and splitting: what must hold of any result."""

import os
import random

import numpy as np
import pytest

from seqloom.llm import mixing as M
from seqloom.llm import packing as P
from seqloom.llm import splitting as S
from seqloom.llm.tokens import VOCABULARY, token_counts, tokenizer

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


# Packing


def check_packing(rows, items, capacity):
    by, fill = {}, {}
    for r in rows:
        by.setdefault(r.item_id, []).append(r)
        fill.setdefault(r.container_id, []).append(r)
    assert set(by) == {i for i, n in items.items() if n}
    for i, own in by.items():
        own.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(-(-items[i] // capacity)))
        assert [r.token_start for r in own] == [k * capacity for k in range(len(own))]
        assert sum(r.n_tokens for r in own) == items[i]
    for own in fill.values():
        total = sum(r.n_tokens for r in own)
        assert total <= capacity and all(r.fill == total for r in own)
    return len(fill), -(-sum(items.values()) // capacity)


@pytest.mark.parametrize("block", [50, 20_000])
def test_packing(spark, block):
    draw = random.Random(3)
    items = {i: draw.choice([0, 7, 7, 100, 1000, 1024, 1025, 2048, 2049, 5000, draw.randrange(1, 3000)]) for i in range(1500)}
    rows = [(i, n, "x", 1) for i, n in items.items()]
    df = spark.createDataFrame(rows + rows[:99] + [(None, 5, "x", 1), (9999, None, "x", 1)], "item_id bigint, n_tokens int, block string, fill int")
    out = P.pack_items(df, 2048, block_items=block)
    used, least = check_packing(out.collect(), items, 2048)
    assert used <= 1.03 * least + 1
    assert P.pack_items(df.limit(0), 2048).count() == 0


def test_local_search_empties_a_bin_by_exchanges():
    sizes = [60, 40, 55, 30, 10, 5]
    bins = [[0, 3], [2, 1], [4, 5]]  # 90, 95, 15: moves fill both
    found = P.local_search([list(b) for b in bins], sizes, 100)
    assert sorted(sum(sizes[i] for i in b) for b in found) == [100, 100]
    # 2-for-1: 50 goes in for 20 + 25
    sizes = [50, 55, 20, 25, 10]
    found = P.local_search([[0], [1, 2, 3]], sizes, 105)
    assert sum(sizes[i] ** 1 for b in found for i in b) == 150 and max(sum(sizes[i] for i in b) for b in found) == 105


def test_local_search_looks_at_all_bins():
    """1,200 bins that can't change come first; then 60 takes the place of 58."""
    sizes = [51] * 1200 + [60, 35, 58, 37]
    found = P.local_search([*([i] for i in range(1200)), [1200, 1201], [1202, 1203]], sizes, 100)
    assert sorted(sum(sizes[i] for i in b) for b in found)[1200:] == [93, 97]


def test_local_search_where_best_fit_is_far_from_the_least():
    """20,000 sizes of 500 to 1,099 in containers of 2,048: best fit alone takes 8,434, the total would need 7,804."""
    sizes = np.random.default_rng(0).integers(500, 1100, 20000).tolist()
    found = P.local_search(P.best_fit(sizes, 2048), sizes, 2048)
    assert sorted(i for b in found for i in b) == list(range(20000)) and max(sum(sizes[i] for i in b) for b in found) <= 2048
    assert len(found) <= 8181


def test_rounds_go_on_while_they_save(spark):
    """Blocks of 200 items: later rounds bring the containers down to nearly those of one block."""
    sizes = np.random.default_rng(1).integers(300, 1500, 1000).tolist()
    df = spark.createDataFrame(list(enumerate(sizes)), "item_id bigint, n_tokens int")
    one = P.pack_items(df, 2048).select("container_id").distinct().count()
    many = P.pack_items(df, 2048, block_items=200)
    used, _ = check_packing(many.collect(), dict(enumerate(sizes)), 2048)
    assert used <= 1.02 * one


def test_local_search_never_lowers_the_squared_fill():
    draw = random.Random(0)
    for _ in range(50):
        sizes = [draw.randrange(1, 70) for _ in range(40)]
        first = P.best_fit(sizes, 100)
        before = sum(sum(sizes[i] for i in b) ** 2 for b in first)
        after = P.local_search([list(b) for b in first], sizes, 100)
        fills = [sum(sizes[i] for i in b) for b in after]
        assert sorted(i for b in after for i in b) == list(range(40)) and max(fills) <= 100
        assert sum(f * f for f in fills) >= before


# Mixing


def test_bounded_knapsack_is_best():
    draw = random.Random(2)
    for _ in range(40):
        lengths = np.array(sorted(draw.sample(range(1, 40), 5)))
        counts = np.array([draw.randrange(0, 4) for _ in lengths])
        budget = draw.randrange(0, 150)
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * size for s in sums for k in range(n + 1)}
        taken = M.bounded_knapsack(budget, lengths, counts)
        assert (taken <= counts).all() and int((taken * lengths).sum()) == max(s for s in sums if s <= budget)


def test_fit_budget_hits_large_budgets():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(5, 4000, 800))
    counts = rng.integers(1, 50, lengths.size)
    total = int((lengths * counts).sum())
    for part in (0.0, 0.001, 0.3, 0.77, 0.9999, 1.0):
        budget = int(total * part)
        taken = M.fit_budget(budget, lengths, counts, 7)
        assert (0 <= taken).all() and (taken <= counts).all()
        assert 0 <= budget - int((taken * lengths).sum()) <= 4 + (part == 0.0)


@pytest.mark.parametrize("buckets", [2, 4096])
def test_mixture(spark, monkeypatch, buckets):
    monkeypatch.setattr(M, "BUCKETS", buckets)  # few: the ranked bucket of a length holds many documents
    draw = random.Random(4)
    docs, i = [], 0
    for source, n in (("a", 900), ("b", 40), ("c", 300), ("untargeted", 10)):
        for _ in range(n):
            docs.append((source, i, draw.choice([3, 3, 3, draw.randrange(1, 400)]), "x"))
            i += 1
    docs += [(None, i, 5, "x"), ("a", i + 1, None, "x"), ("a", i + 2, 0, "x")]
    df = spark.createDataFrame(docs, "source string, doc_id bigint, n_tokens int, budget string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c", 0.2, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    mixture, report = M.mix_sources(df, targets, seed=5)
    rows, shares = mixture.collect(), {r.source: r for r in report.collect()}
    sizes = {d: (s, n) for s, d, n, _ in docs}
    assert len({r.doc_id for r in rows}) == len(rows)
    caps = {"a": 1, "b": 3, "c": 2}
    for r in rows:
        assert sizes[r.doc_id] == (r.source, r.n_tokens) and 1 <= r.times <= caps[r.source]
    used = {s: sum(r.n_tokens * r.times for r in rows if r.source == s) for s in caps}
    for s, want in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert shares[s].used_tokens == used[s] and abs(shares[s].actual_share - want) < 0.002
    assert shares["none"].actual_share == 0 and shares["none"].n_documents == 0
    assert any(used[s] == caps[s] * shares[s].n_tokens for s in caps)  # no larger total is possible
    again = {(r.doc_id, r.times) for r in M.mix_sources(df.repartition(7), targets, seed=5)[0].collect()}
    assert again == {(r.doc_id, r.times) for r in rows}
    assert M.mix_sources(df.limit(0), targets)[0].count() == 0


# Splitting

TEXTS = [
    "One short text.",
    "",
    "First sentence here. " * 40 + "\n\n" + "Second paragraph, longer words. " * 60 + "\n \n" + "End",
    "word " * 900,
    "nospacesatall" * 300,
    "日本語の文章です。とても長い「引用。」があります。" * 120,
    "漢" * 900,
    "é" * 700 + " 🎉🎉" * 300,
    "Line one\nline two ends.\nNext starts here " * 90,
    " \n\t" * 700,
    "a" + " " * 4000 + "b",
    "don't 'start 'll we've x's !'s it''s  \n\n a\u3000b. 'Tis\u00a0so.\u2028 " * 60,
]


def check_pieces(rows, texts, limit, overlap):
    tok = tokenizer(VOCABULARY)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in texts.items() if t and tok.count(t) > limit}
    for i, own in by.items():
        own.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(len(own)))
        built, at = "", 0
        for r in own:
            assert r.n_tokens == tok.count(r.text) <= limit
            assert r.token_start == at
            at = r.token_end
            assert built.endswith(r.text[: r.repeated_chars])
            built += r.text[r.repeated_chars :]
            if r is not own[0]:
                assert overlap <= r.n_repeated <= overlap + 6
        assert built == texts[i]
        assert [r.end_kind == "end" for r in own] == [False] * (len(own) - 1) + [True]


@needs_vocabulary
@pytest.mark.parametrize("limit,overlap", [(64, 8), (64, 0), (128, 48)])
def test_pieces(spark, limit, overlap):
    """The same pieces for ranges of 100, 500 or 32,768 bytes and for whole texts."""
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x"), (77, None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no string").repartition(3)
    whole = S.split_texts(df, "doc_id", "text", limit, overlap, range_bytes=1 << 30).collect()
    check_pieces(whole, dict(enumerate(TEXTS)), limit, overlap)
    for size in (100, 500, 32_768) if overlap == 8 else (500,):
        assert sorted(S.split_texts(df, "doc_id", "text", limit, overlap, range_bytes=size).collect()) == sorted(whole)


@needs_vocabulary
def test_runs_longer_than_a_range(spark):
    texts = {1: "a" * 140_000 + " end. " + "word " * 20_000, 2: "漢" * 50_000, 3: " " * 150_000, 4: "\n" * 70_000 + "x" * 70_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    whole = S.split_texts(df, "doc_id", "text", 512, 48, range_bytes=1 << 30).collect()
    check_pieces(whole, texts, 512, 48)
    for size in (30_000, 65_536):
        assert sorted(S.split_texts(df, "doc_id", "text", 512, 48, range_bytes=size).collect()) == sorted(whole)


@needs_vocabulary
def test_rows_with_equal_ids(spark):
    df = spark.createDataFrame([(1, TEXTS[3]), (1, TEXTS[3]), (1, TEXTS[2])], "doc_id bigint, text string").repartition(2)
    whole = S.split_texts(df, "doc_id", "text", 64, 8, range_bytes=1 << 30).collect()
    assert sorted(S.split_texts(df, "doc_id", "text", 64, 8, range_bytes=500).collect()) == sorted(whole)
    assert sum(r.end_kind == "end" for r in whole) == 3
    assert S.split_texts(df.limit(0), "doc_id", "text", 64, 8).count() == 0


@needs_vocabulary
def test_files(spark, tmp_path):
    texts = {i: t for i, t in enumerate(TEXTS)}
    for i, t in texts.items():
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    files = spark.createDataFrame([(i, str(tmp_path / f"{i}.txt"), 0) for i in texts] + [(None, "x", 0), (50, None, 0)], "doc_id bigint, path string, mark int")
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = sorted(S.split_texts(rows, "doc_id", "text", 64, 8).collect())
    for size in (700, 1 << 20):
        assert sorted(S.split_files(files, 64, 8, range_bytes=size).collect()) == want


@needs_vocabulary
def test_cuts_fall_on_natural_boundaries(spark):
    df = spark.createDataFrame([(2, TEXTS[2]), (3, TEXTS[3]), (5, TEXTS[5])], "doc_id bigint, text string")
    found = S.split_texts(df, "doc_id", "text", 64, 8).collect()
    assert {r.end_kind for r in found if r.doc_id == 3} == {"word", "end"}
    assert {r.end_kind for r in found if r.doc_id == 5} == {"sentence", "end"}
    assert {"paragraph", "sentence"} <= {r.end_kind for r in found if r.doc_id == 2}
    for r in found:
        if r.end_kind == "sentence" and r.doc_id == 2:
            assert r.text.endswith(".")
        if r.end_kind == "word":
            assert r.text.endswith("word")


@needs_vocabulary
def test_counts_are_the_tokenizers(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id bigint, text string")
    tok = tokenizer(VOCABULARY)
    found = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "text").collect()}
    assert found == {**{i: tok.count(t) for i, t in enumerate(TEXTS)}, 99: 0}
