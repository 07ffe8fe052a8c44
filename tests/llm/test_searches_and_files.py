"""Ranked search, hard negatives and token-id files against plain versions."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from buzzlens.llm import idcoder, idfiles, negatives, ranked
from buzzlens.llm.queries import tokenizer

# Ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranking(texts, items, k):
    """Scores of all documents by the definition."""
    tf = [(i, Counter(terms(t))) for i, t in texts]
    sizes = [sum(c.values()) for _, c in tf]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for (i, c), size in zip(tf, sizes):
            m = 100 - 75 + 75 * size * n // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        scored.sort()
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return out


def as_key(row):
    return tuple((x is None, x) for x in row)


ITEMS = [(1, "the1 of2 alpha3 the1 ALPHA3 the1"), (2, "beta5"), (3, None), (4, ""), (5, "nowhere"), (None, "of7 ñu8"),
         (6, " ".join(f"the{k} Δx{k}" for k in range(60))), (7, "x" * 70_000), (7, "of1 of2"), (2, "beta5")]


@pytest.mark.parametrize("shard_docs, pairs", [(4096, 16_384), (7, 40)])
def test_ranked_search_against_full_scoring(spark, docs, texts, tmp_path, monkeypatch, shard_docs, pairs):
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(ranked, "FIRST_READ", 2)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, rank string")
    again = texts + [(100, texts[9][1]), (6, texts[6][1])]  # repeated ids and rows
    more = docs.union(docs.sparkSession.createDataFrame([(*r, "en", "s", 1, "c", True) for r in again[-2:]], docs.schema))
    ranked.build(more, str(tmp_path / "index"))
    found = ranked.search(spark, str(tmp_path / "index"), items, k=4)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(as_key, found.collect())) == sorted(map(as_key, ranking(again, dict.fromkeys(ITEMS), 4)))


def test_ranked_search_of_nothing(spark, docs, none, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    ranked.build(none, str(tmp_path / "empty"))
    assert ranked.search(spark, str(tmp_path / "empty"), items).count() == 0
    ranked.build(docs, str(tmp_path / "index"))
    assert ranked.search(spark, str(tmp_path / "index"), items.limit(0)).count() == 0


def test_best_positions_stop_early_and_keep_ties():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 200))
        lists = []
        for _ in range(int(rng.integers(1, 6))):
            some = rng.choice(n, rng.integers(1, n + 1), replace=False)
            impact = rng.integers(1, 8, len(some))
            order = np.lexsort((some, -impact))
            lists.append((some[order], impact[order]))
        sizes = np.array([len(d) for d, _ in lists])
        row = {
            "ids": list(range(n)), "terms": np.arange(len(lists), dtype=np.uint64).tobytes(),
            "first": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32).tobytes(),
            "docs": np.concatenate([d for d, _ in lists]).astype(np.uint16).tobytes(),
            "impacts": np.concatenate([i for _, i in lists]).astype(np.int32).tobytes(),
        }
        shard = ranked._Shard(row, np.arange(len(lists), dtype=np.uint64))
        factor = rng.integers(0, 5, len(lists))
        full = sum(np.bincount(d, i, n) * f for (d, i), f in zip(lists, factor)).astype(int)
        floor = int(rng.integers(0, 20))
        docs, scores = ranked.best_positions(shard, np.arange(len(lists)), factor, 3, floor)
        assert (full[docs] == scores).all()
        order = np.lexsort((np.arange(n), -full))[:3]
        wanted = [d for d in order if full[d] > 0 and full[d] >= floor]
        got = docs[np.lexsort((docs, -scores))].tolist()
        assert [d for d in got if full[d] >= floor][: len(wanted)] == wanted


def test_best_positions_do_not_read_everything():
    # One document tops every list; the best positions end the search after the first stretch.
    n = 4000
    impact = np.concatenate([[900], np.full(n - 1, 1)])
    row = {
        "ids": list(range(n)), "terms": np.arange(3, dtype=np.uint64).tobytes(),
        "first": (np.arange(4) * n).astype(np.int32).tobytes(),
        "docs": np.tile(np.arange(n), 3).astype(np.uint16).tobytes(),
        "impacts": np.tile(impact, 3).astype(np.int32).tobytes(),
    }
    shard = ranked._Shard(row, np.arange(3, dtype=np.uint64))
    reads = []
    shard.docs = type("Counted", (), {"__getitem__": lambda self, at, d=shard.docs: reads.append(len(at)) or d[at]})()
    docs, scores = ranked.best_positions(shard, np.arange(3), np.array([1, 1, 1]), 1, 0)
    assert docs.tolist() == [0] and scores.tolist() == [2700] and sum(reads) == 3 * ranked.FIRST_READ


# Hard negatives


def hard_negatives(rows, step, p, k):
    kept = []
    for place, (i, label, v) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((place, i, label, [math.floor(256 * float(x)) for x in v]))
    out = []
    for place, i, label, v in kept:
        if i is None or i % step:
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, q, m) for q, j, m, w in kept if q != place]
        order = sorted(others, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        for s, j, _, _ in [x for x in order if x[3] == label][:p]:
            fits = [x for x in order if x[3] != label and 30 * s <= 100 * x[0] <= 90 * s]
            out += [(i, j, r + 1, n, s, t) for r, (t, n, _, _) in enumerate(fits[:k])]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(260):
        v = rng.normal(size=6) * rng.choice([0.1, 1, 30])
        rows.append((k, int(rng.integers(3)), [float(np.float32(x)) for x in v]))
    rows += [(400 + k, k % 3, [0.5] * 6) for k in range(25)]  # ties
    rows += [(500, None, [1.0] * 6), (501, 1, None), (502, 1, [1.0, None]), (503, 1, [float("nan")] * 6), (504, 1, [float("inf")]),
             (505, 2, []), (510, 2, [0.0] * 6), (None, 1, [2.0] * 6), (None, 2, [2.0] * 6), (520, 2, [3.0, 1.0]), (20, 1, [1.0] * 6)]
    return rows + [rows[10], rows[10]]


@pytest.mark.parametrize("slice_rows, block_rows", [(2048, 1024), (9, 4)])
def test_hard_negatives_against_all_pairs(spark, vectors, tmp_path, monkeypatch, slice_rows, block_rows):
    monkeypatch.setattr(negatives, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block_rows)
    rows = spark.createDataFrame([(*r, "x") for r in vectors], "vec_id long, label int, embedding array<float>, rank string")
    path = str(tmp_path / "slices")
    negatives.store(rows.coalesce(1), path)
    got = negatives.mine(spark, path, anchor_step=10, positives=3, negatives=4)
    assert sorted(map(as_key, got.collect())) == sorted(map(as_key, hard_negatives(vectors, 10, 3, 4)))


def test_hard_negatives_of_nothing(spark, vectors, tmp_path):
    rows = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>")
    negatives.store(rows.limit(0), str(tmp_path / "none"))
    assert negatives.mine(spark, str(tmp_path / "none")).count() == 0
    negatives.store(rows.filter("vec_id % 10 <> 0"), str(tmp_path / "no-anchor"))
    assert negatives.mine(spark, str(tmp_path / "no-anchor"), anchor_step=10).count() == 0


def test_score_bounds_hold_and_cut():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 32)) * 200
    x = np.floor(centres[rng.integers(8, size=600)] + rng.normal(size=(600, 32)) * 20).astype(np.int64)
    x[:3] = 0
    angles, norms = negatives._angles(x.astype(float), negatives.reference_directions(x.astype(float)))
    rows = object.__new__(negatives._Rows)
    rows.ids, rows.angles, rows.norms, rows.vectors = np.arange(600), angles, norms, x
    low, high = negatives.score_bounds(rows, rows)
    true = x @ x.T
    assert (low <= true).all() and (true <= high).all()
    # Pairs of far clusters are told apart without a score.
    assert (high < 0.5 * norms[:, None] * norms[None, :]).mean() > 0.5
    # What the bounds rule out is not scored.
    wanted = high > 0.9 * norms[:, None] * norms[None, :]
    assert ((negatives.scores(rows, rows, wanted) == true) | ~wanted).all()


def test_integer_scores_beyond_doubles():
    a = object.__new__(negatives._Rows)
    a.vectors = np.array([[2**29 + 1, 3], [1, -(2**29)]], np.int64)
    a.norms = np.sqrt((a.vectors.astype(float) ** 2).sum(axis=1))
    assert negatives.scores(a, a, np.ones((2, 2), bool)).tolist() == (a.vectors @ a.vectors.T).tolist()


# Token-id files


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.lists(st.one_of(st.integers(0, 20), st.integers(0, 2**32 - 1)), max_size=60), max_size=8),
    st.integers(0, 3),
)
def test_coder_round_trip(runs, repeat):
    runs = [r * 3**repeat for r in runs]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int64)
    ids = np.array([x for r in runs for x in r], np.uint32)
    assert [d.tolist() for d in idcoder.decode(idcoder.encode(ids, starts))] == runs


def test_ids_are_not_held_twice_while_they_are_coded(monkeypatch):
    stripes, encode, seen = idfiles._Stripes(0), idcoder.encode, []

    def held(ids, starts):
        seen.append((stripes.held, len(stripes.ids), len(stripes.lengths)))
        return encode(ids, starts)

    monkeypatch.setattr(idcoder, "encode", held)
    assert not list(stripes.add([1, 2], np.arange(5, dtype=np.uint32), np.array([2, 3])))
    assert stripes.flush().column("n_ids").to_pylist() == [5]
    assert not list(stripes.add([3], np.arange(4, dtype=np.uint32), np.array([4])))
    row = stripes.flush()
    assert (row.column("before").to_pylist(), row.column("doc_ids").to_pylist()) == ([5], [[3]])
    assert seen == [(0, 0, 0)] * 2


def test_coder_learns_and_checks():
    rng = np.random.default_rng(3)
    ids = np.tile(rng.integers(0, 50_000, 500), 60).astype(np.uint32)
    coded = idcoder.encode(ids, np.array([0, len(ids)]))[0]
    assert (idcoder.decode([coded])[0] == ids).all()
    assert len(coded) * 8 < 6 * len(ids)  # 9 bits tell 500 ids apart
    # Blocks stand alone: each can be decoded without the others.
    size = idcoder.HEAD_SIZE
    _, n, letters, words, _ = struct.unpack_from(idcoder.HEAD, coded)
    assert (idcoder.decode([coded[: size + letters + 4 * words]])[0] == ids[:n]).all()
    broken = bytearray(coded)
    broken[size + letters + 9] ^= 1
    with pytest.raises(ValueError, match="check sum"):
        idcoder.decode([bytes(broken)])


def test_carries_run_through_full_words():
    # A long run of one id keeps the range's start near a border; carries then cross words.
    rng = np.random.default_rng(8)
    for _ in range(30):
        ids = rng.choice([0, 1], 4000, p=[0.999, 0.001]).astype(np.uint32)
        assert (idcoder.decode(idcoder.encode(ids, np.array([0, 4000])))[0] == ids).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_id_files_round_trip(spark, docs, texts, tmp_path, monkeypatch, name):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idfiles, "STRIPE", 700)
    odd = [(7, "Don't<|endoftext|>STOP. <|ENDOFTEXT|> a|b"), (7, "ÉTÉ ñandú, Ünï!? 'tis ’s 3.14 x́y"), (8, "中文 ab c Σας ſt ﬁ"), (8, "中文"), (-5, "a\x1cb\x85c")]
    rows = [(*r, "en", "s", 1, "c", True) for r in odd]
    path = str(tmp_path / "ids")
    idfiles.write(docs.union(spark.createDataFrame(rows, docs.schema)), path, tokenizer(name), part_bytes=30_000)
    library = Tokenizer.from_file(tokenizer(name))
    got = sorted(idfiles.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    held, at = defaultdict(list), 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert (r.start, r.n_tokens, ids[-1]) == (at, len(ids), 1)
        held[r.doc_id].append(zlib.crc32(r.ids))
        at += len(ids)
    wanted = defaultdict(list)
    for i, text in texts + odd:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        wanted[i].append(zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {i: sorted(v) for i, v in held.items()} == {i: sorted(v) for i, v in wanted.items()}
    assert spark.read.parquet(path).select("part").distinct().count() > 1


def test_id_files_of_nothing(spark, none, tmp_path):
    idfiles.write(none, str(tmp_path / "ids"), tokenizer("word_bpe_49k.json"))
    assert idfiles.read(spark, str(tmp_path / "ids")).count() == 0
