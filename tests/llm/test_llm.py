"""Every operator against a plain version, on rows made to be awkward."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from buzzlens.llm import bpe, cotraining, language, lines, packing, pages, rules, search, simhash, substrings
from buzzlens.llm.graph import components
from buzzlens.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Packing


def test_packing_keeps_every_id_once(docs, texts, none):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs.repartition(2), path, length=256).collect()
    by_id, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_id[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    total = 0
    for i, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_id[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(p.ids) == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        total += at
    for some in by_sequence.values():
        at = 0
        for p in sorted(some, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    assert len(by_sequence) * 256 - total < 3 * 256
    assert packing.pack(none, path).count() == 0


def test_sum_of_squares_choice():
    packer = packing.Packer(10)
    rng = np.random.default_rng(1)
    for size in rng.integers(1, 10, 300).tolist():
        levels = Counter({level: len(w) for level, w in packer.windows.items() if w})

        def growth(level):
            after = levels.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            return sum(n * n for n in after.values()) - sum(n * n for n in levels.values())

        least = min(growth(level) for level in [0, *levels] if level + size <= 10)
        packer.place(size, "x")
        now = Counter({level: len(w) for level, w in packer.windows.items() if w})
        assert sum(n * n for n in now.values()) - sum(n * n for n in levels.values()) == least


def test_open_windows_are_bounded_and_most_are_filled_by_the_rule():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(1100, 1150, 5000), rng.integers(1, 2048, 3000), np.full(400, 2047), np.full(900, 1)):
        packer = packing.Packer()
        filled, held = [], Counter()
        for k, size in enumerate(sizes.tolist()):
            filled += packer.place(size, k)
            assert packer.open == sum(map(len, packer.windows.values())) <= packing.OPEN
        for window in filled:
            assert sum(size for *_, size in window) == 2048
        rest = list(packer.close())
        assert len(rest) <= packing.OPEN and (len(filled) > 10 * len(rest) or len(sizes) < 1000)
        for item, start, size in sorted(x for window in filled + rest for x in window):
            assert start == held[item]  # pieces of an item follow each other
            held[item] += size
        assert [held[k] for k in range(len(sizes))] == sizes.tolist()


# Substring dedup


def test_substrings_against_all_windows(docs, texts, none):
    first = {}
    for i, text in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        w = split(text)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    expected = {}
    for i, text in texts:
        w = split(text)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            window = tuple(w[k : k + 13])
            if window in first and (i is None or first[window] < i):
                gone[k : k + 13] = [True] * 13
        expected[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    cut = substrings.remove_repeats(docs, parts=5)
    assert cut.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "n_words", "n_removed", "repeats"]
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == expected
    assert all(sum(s.after - s.first for s in r.repeats) == r.n_removed for r in got.values())
    assert got[None].n_removed == expected[None][0]
    assert substrings.remove_repeats(none).count() == 0


# Quality rules


def test_rules_and_ablations(docs, texts, none):
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    for i, text in texts:
        w, text = split(text), text or ""
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        covered = {k + j for k, x in enumerate(windows) if x in twice for j in range(5)}
        held = [x for x in text.split("\n") if split(x)]
        r = got[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert (r.n_lines, r.n_dup_lines) == (len(held), len(held) - len(set(held)))
        assert r.n_repeat_words == len(covered)
        assert bool(r.failures & 1) == (len(w) < 10)
        assert bool(r.failures & 2) == (100 * len(covered) > 20 * len(w))
    ledger = rules.ledger(docs).cache()
    table = {(r.policy, r.rule): r for r in rules.ablations(ledger).collect()}
    base = table["base", "few_words"]
    assert base.dropped == ledger.filter(~rules.passes(rules.BASE)).count()
    assert base.dropped_alone == ledger.filter("failures & 3 = 1").count()
    assert rules.ledger(none).count() == 0


# Search


def test_search_against_full_scoring(docs, texts, none):
    got = defaultdict(list)
    for r in search.search(docs, docs.filter("doc_id % 5 = 0 OR doc_id = 301"), k=4, shards=3).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    tf = [(i, Counter(split(lower(t)))) for i, t in texts]
    n, mean = len(tf), sum(sum(c.values()) for _, c in tf) / len(tf)
    df = Counter(t for _, c in tf for t in c)
    for q, asked in tf:
        if q is None or (q % 5 and q != 301):
            continue
        scored = []
        for d, c in tf:
            length = sum(c.values())
            s = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2
                / (c[t] + 1.2 * (0.25 + 0.75 * length / mean)) for t in asked if t in c
            )
            if s > 0:
                scored.append(s)
        assert [pytest.approx(s) for s in sorted(scored, reverse=True)[:4]] == [x[2] for x in sorted(got[q])]
    assert search.search(none, none).count() == 0


def test_search_in_blocks_of_queries(docs, monkeypatch):
    queries = docs.filter("doc_id % 5 = 0 OR doc_id IS NULL")
    whole = search.search(docs, queries, k=3, shards=4).collect()
    monkeypatch.setattr(search, "BLOCK_PAIRS", 200)
    found = search.search(docs, queries, k=3, shards=4)
    assert len(set(found.inputFiles())) > 2 and sorted(map(str, found.collect())) == sorted(map(str, whole))


def test_search_of_a_shard_together(monkeypatch):
    """Queries answered together get what scoring every document gives them, whatever the bounds leave out."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 30, p=(p := 1 / np.arange(1, 401)) / p.sum())) for _ in range(700)]
    texts[10], texts[600], texts[30], texts[31] = texts[500], texts[500], None, " "
    mean = sum(len((t or "").split()) for t in texts) / len(texts)
    postings = search._postings(pa.chunked_array([texts]))
    terms, first, doc, tf, length = postings
    every = tf.astype(int) * 2.2 / (tf.astype(int) + 1.2 * (0.25 + 0.75 * length[doc] / mean))
    asked, scores = [], []
    for n in range(60):
        at = np.flatnonzero(np.isin(terms, terms[doc_terms(postings, n * 10)] if n % 3 else rng.choice(terms, 2)))
        at = at[np.argsort(terms[at].view(np.int64))]
        rarity = rng.random(len(at)) + 0.01
        score = np.zeros(len(texts))
        for t, r in zip(at, rarity):
            score[doc[first[t] : first[t + 1]]] += every[first[t] : first[t + 1]] * r
        asked.append((at, rarity))
        scores.append(score)
    for often, most in ((16, 1_024), (2, 1_024), (16, 5), (1, 1_024)):
        monkeypatch.setattr(search, "OFTEN", often)
        monkeypatch.setattr(search, "MOST_OFTEN", most)
        shard = search.Index.of(*postings, mean)
        assert len(shard.often) <= most and (often > 1 or not len(shard.often))
        assert shard.find(np.array([terms[3], 12345], np.uint64)).tolist() == [3, -1]
        for share in (0.0, 1.0, 1.5):  # of the fifth score: none, all that reach it, few or none
            floors = np.array([share * np.sort(score)[-5] for score in scores])
            for (docs, found), score, floor in zip(shard.search(asked, 5, floors), scores, floors, strict=True):
                best = [d for d in np.lexsort((np.arange(len(score)), -score))[:5] if score[d] >= floor and score[d] > 0]
                assert docs[: len(best)].tolist() == best and found[: len(best)].tolist() == score[best].tolist()
    assert shard.search([], 5, np.zeros(0)) == []


def doc_terms(postings, number):
    """Numbers of the terms of a document."""
    return np.searchsorted(postings[1].astype(int), np.flatnonzero(postings[2] == number), "right") - 1


def test_search_reads_documents_once_where_they_lie(spark, docs, none, monkeypatch):
    index = search._index(docs.coalesce(1), "doc_id", "text")
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    rows = index.collect()
    assert len(rows) == 1 and rows[0].docs == docs.count() and rows[0].ahead
    monkeypatch.setattr(search, "SHARD", 50)
    rows = search._index(docs.coalesce(1), "doc_id", "text").collect()
    assert [r.docs for r in rows[:-1]] == [50] * (len(rows) - 1) and sum(r.docs for r in rows) == docs.count()
    for r in rows:
        ids = [i for i in r.ids if i is not None]
        assert ids == sorted(ids) and r.ids == ids + [None] * (r.docs - len(ids))
    monkeypatch.setattr(search, "SHARD", 16_384)
    monkeypatch.setattr(search, "SHARD_BYTES", 2_000)
    short = search._index(docs.coalesce(1), "doc_id", "text").collect()
    assert len(short) > 1 and sum(r.words for r in short) == sum(r.words for r in rows)
    assert search._index(none, "doc_id", "text").count() == 0


def test_words_of_a_shard_are_split_a_few_texts_at_a_time(monkeypatch):
    column = pa.chunked_array([["b a b", None, "", "a"], ["c A", " ", "b", "a a a"], [], ["d b"]], pa.string())
    whole, sizes, split = search._postings(column), [], search._terms
    monkeypatch.setattr(search, "_terms", lambda part: sizes.append(len(part)) or split(part))
    monkeypatch.setattr(search, "AT_ONCE", 2)
    parts = search._postings(column)
    assert sizes == [2, 2, 2, 2, 1]
    for one, other in zip(whole, parts, strict=True):
        assert one.dtype == other.dtype and one.tolist() == other.tolist()
    assert [x.dtype.itemsize for x in whole] == [8, 1, 1, 1, 1]
    assert search._postings(pa.chunked_array([["a " * 300]]))[3].tolist() == [300]
    empty = search._postings(pa.chunked_array([[]], pa.string()))
    assert [len(x) for x in empty] == [0, 1, 0, 0, 0]


# Pages


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a&amp;b", "a&b"), ("<!-- x", ""),
        ("a < b and c > d", "a < b and c > d"),
        ("<nav>menu</nav><article><h1>T</h1><p>One,  two.\n<p>Three <b>b</b>old.<br>x</article><footer>f</footer>",
         "T\nOne, two.\nThree bold. x"),
        ("<body><div class='sidebar'><p>Links, links, more links.</div><div id=c><p>Text one, long enough to count."
         "<script>var a='<p>no</p>'</script><p>Ok.</div><div class='comments'>I think, so.</div>",
         "Text one, long enough to count.\nOk."),
    ],
)
def test_main_text(source, text):
    assert pages.main_text(source) == text


PARAGRAPHS = "<p>Text one, long enough to count as a paragraph, yes.</p><p>Second one, also long, with commas, and a stop.</p>"
SHORT = "<p>Ten<p>Nine"
PLAIN = "Text one, long enough to count as a paragraph, yes.\nSecond one, also long, with commas, and a stop."


@pytest.mark.parametrize(
    "source, text",
    [
        (f'<article><div data-id="menu">{PARAGRAPHS}</div></article>', PLAIN),
        (f'<article><h2 id="share-prices-fall">Share prices</h2>{PARAGRAPHS}<blockquote class="reply">So.</blockquote></article>',
         f"Share prices\n{PLAIN}\nSo."),
        (f"<div><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sport</a></div>{PARAGRAPHS}<p>See <a href=4>this</a>.</div>",
         f"{PLAIN}\nSee this."),
        (f"<body><div>{SHORT * 30}</div><div><div>{PARAGRAPHS}{PARAGRAPHS}</div></div><div><p>Four<p>Five</div>", f"{PLAIN}\n{PLAIN}"),
    ],
)
def test_ratios_choose_the_nodes(source, text, monkeypatch):
    assert pages.main_text(source) == text
    if "Home" in source or SHORT in source:  # nothing in the mark-up tells these parts apart
        chosen = pages._selected

        def all_alike(page):
            size, path, _, low = chosen(page)
            return size, path, size > 0, low & False

        monkeypatch.setattr(pages, "_selected", all_alike)
        assert pages.main_text(source) != text


def test_ratios_against_plain_sums():
    page = pages._Page(f"<div><ul><li><a>One</a><li><a>Two.</a></ul>{PARAGRAPHS}<p>x</p></div>")
    size, path, selected, low = pages._selected(page)
    length, marks, nodes = Counter(), Counter(), Counter()
    for text, where in zip(page.texts, page.paths):
        length[where] += len(text.strip())
        marks[where] += sum(c in ".,;:!?" for c in text)
        nodes[where] += bool(text.strip())
    held = [bool(t.strip()) for t in page.texts]
    ratio = [length[p] / max(nodes[p], 1) * h for p, h in zip(page.paths, held)]
    punctuation = [marks[p] / max(nodes[p], 1) * h for p, h in zip(page.paths, held)]

    def smooth(values):
        out = []
        for k in range(len(values)):
            near = [(math.exp(-0.5 * d * d), values[k + d]) for d in range(-2, 3) if 0 <= k + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    fused = [a * (1 + b) for a, b in zip(smooth(ratio), smooth(punctuation))]
    least = 0.25 * np.std(fused)
    assert selected.tolist() == [f >= least and h for f, h in zip(fused, held)]
    assert low.tolist() == [a * (1 + b) < least for a, b in zip(ratio, punctuation)]
    assert size.tolist() == [len(t.strip()) for t in page.texts]


def test_extract_replaces_columns(spark, none):
    rows = spark.createDataFrame([(1, None, "old"), (2, "<p>x</p>", "old")], "page_id long, html string, text string")
    assert sorted(map(tuple, pages.extract(rows).collect())) == [(1, ""), (2, "x")]
    assert pages.extract(rows.limit(0)).count() == 0


# Lines


def test_alignment():
    assert lines.align([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.align([], [1]) == []
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 9, 12).tolist(), rng.integers(0, 9, 12).tolist()
        pairs = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_line_dedup(docs, texts, none):
    cut = {r.doc_id: r for r in lines.remove_common_blocks(docs).collect()}
    assert len(cut) == len(texts)
    assert all(cut[100 + k].n_removed_lines == cut[100 + k].n_lines for k in range(30))
    assert cut[6].n_removed_lines <= 1 and cut[None].n_removed_lines == 0 and cut[300].text is None
    shared = texts[0][1].split("\n")[1]
    assert [k for k in range(40) if cut[k].text and shared in cut[k].text] == [0]
    assert lines.remove_common_blocks(none).count() == 0


def block(*rows):
    return [(i, "\n".join(x)) for i, x in rows]


def test_blocks_are_found_whatever_their_lines(spark):
    shared = ["The first of two lines, ok", "and the second of them"]
    own = lambda i: [f"Line {i} of nobody else, long enough to count alone."]
    rows = [(k, own(k) + [shared[k % 2]] + own(100 + k)) for k in range(10)]  # each line by itself is common
    rows += [(50, own(50) + shared), (60, own(60) + shared + own(61))]
    short = [f"tiny {k:02d} row" for k in range(40)]
    rows += [(70, short), (71, own(71) + short)]
    docs = spark.createDataFrame(block(*rows), "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    cut = {r.doc_id: (r.n_removed_lines, r.text) for r in lines.remove_common_blocks(docs).collect()}
    assert cut[60] == (2, "\n".join(own(60) + own(61))) and cut[71] == (40, own(71)[0])
    assert sum(n for n, _ in cut.values()) == 42


def test_line_dedup_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    pool = [f"Line {k} " + "word " * int(rng.integers(0, 12)) for k in range(30)]
    docs = [(i, [pool[k].strip() for k in rng.integers(0, 30, rng.integers(1, 25))]) for i in range(40)]
    frame = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text.split("\n") if r.text else [] for r in lines.remove_common_blocks(frame).collect()}

    def runs(x):  # every shortest run with 40 characters, from or to a line
        out = set()
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if sum(map(len, x[i:j])) >= 40:
                    out.add((i, j))
                    break
            for j in range(i, -1, -1):
                if sum(map(len, x[j : i + 1])) >= 40:
                    out.add((j, i + 1))
                    break
        return out

    first = {}
    for i, x in docs:
        for a, b in runs(x):
            first.setdefault(tuple(x[a:b]), i)
    expected = {}
    for i, x in docs:
        gone = set()
        for other, y in docs[:i]:
            shared = [r for r in sorted(runs(x)) if first[tuple(x[r[0] : r[1]])] == other]
            keys = {tuple(x[a:b]) for a, b in shared}
            theirs = [r for r in sorted(runs(y)) if tuple(y[r[0] : r[1]]) in keys]
            number = {k: n for n, k in enumerate(sorted(keys))}
            ours = [(a, number[tuple(x[a:b])]) for a, b in shared]
            sizes = {number[k]: len(k) for k in keys}
            gone |= lines.aligned_lines([(a, number[tuple(y[a:b])]) for a, b in theirs], ours, sizes)
        expected[i] = gone
    total = {i: len(x) - len(got[i]) for i, x in docs}
    # Runs at one place are ordered by key, which is a hash there and a rank here.
    assert abs(sum(total.values()) - sum(map(len, expected.values()))) <= 0.02 * sum(total.values())
    for i, x in docs:  # and nothing goes that no earlier document has
        earlier = {line for _, y in docs[:i] for line in y}
        left = Counter(x) - Counter(got[i])
        assert set(left) <= earlier


# Languages


def test_one_mixture_at_any_length(spark, monkeypatch):
    rng = np.random.default_rng(3)
    letter = language.letters()
    logs = np.log(rng.random((language.BUCKETS, 3)) + 1e-3).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcdé"), 4)) for _ in range(n)) for n in (900, 3, 0, 400, 1)] + ["x" * 5000, "12 3"]
    whole = language._shares(texts, letter, logs)
    monkeypatch.setattr(language, "CHUNK", 64)
    assert np.allclose(language._shares(texts, letter, logs), whole)


def test_languages(spark, none):
    rows = [(k, t * 8, g) for k, (t, g) in enumerate(
        [("the cat and the dog with this house ", "en"), ("der hund und die katze mit dem haus ", "de")] * 4)]
    rows += [(90, None, "en"), (91, "12 !", "de"), (92, "the cat and this", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, logs = language.learn(docs)
    got = {r.doc_id: r for r in language.identify(docs, names, logs).collect()}
    assert [got[k].lang_pred for k in (0, 1, 90, 91, 92)] == ["en", "de", "und", "und", "en"]
    assert got[90].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    both = spark.createDataFrame([(1, rows[0][1] + rows[1][1])], "doc_id long, text string")
    assert language.identify(both, names, logs).first().languages == ["de", "en"]
    names, logs = language.learn(none)
    assert {r.lang_pred for r in language.identify(docs, names, logs).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from buzzlens.llm.queries import op7_language

    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "lang")
    found = op7_language(spark, directory).join(docs, "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()


# SimHash


def test_simhash_against_all_pairs(docs, texts, none):
    def plain(text):
        w = split(lower(text))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [plain(t) for _, t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        groups[root[k]] += [i] if i is not None else []
    expected = sorted((i or -1, format(prints[k], "016x"), min(groups[root[k]])) for k, (i, _) in enumerate(texts))
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == expected
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for _, _, c in expected})
    assert simhash.near_duplicates(none).count() == 0


def test_what_is_no_copy_stays(spark):
    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdef"]
    rows = [(None, text[0]), (None, text[1]), (None, text[2]), (2, text[3]), (2, text[4]), (2, text[4]), (7, text[0]), (9, text[5]), (8, text[5])]
    docs = spark.createDataFrame([(i, t, k % 3, True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, hash int, _stay boolean")
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, text[1]), (None, text[2]), (2, text[3]), (2, text[4]), (7, text[0]), (8, text[5])], key=str)
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_crowded_slots_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    rng = np.random.default_rng(2)
    values = {int(sum(1 << int(b) for b in rng.choice(12, 3))) for _ in range(150)}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long"), distance=1, segments=2)
    found = defaultdict(set)
    for r in components(edges).collect():
        found[r.root].add(r.node)
    root = {v: v for v in values}
    for _ in range(20):
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 1:
                    root[a] = min(root[a], root[b])
    expected = defaultdict(set)
    for v in values:
        expected[root[v]].add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


# Classifier


def test_classifier(spark, none):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(300):
        good = k % 2
        w = [("word" if good else "spam##") + str(rng.integers(99)) for _ in range(30)]
        rows.append((k, " ".join(w), "good" if good else "bad", "en", 100))
    rows += [(None, None, None, None, None), (900, "", "good", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    got = cotraining.score(docs, cotraining.train(docs, labels)).collect()
    assert len(got) == len(rows)
    assert sum(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 300) >= 297
    unlearned = cotraining.score(docs, cotraining.train(docs, labels.limit(0)))
    assert unlearned.count() == len(rows)
    clash = docs.withColumn("label", F.lit("x")).withColumn("ti", F.lit(1))
    assert cotraining.score(clash, cotraining.train(clash, labels)).count() == len(rows)
    nothing = cotraining.train(docs.limit(0), labels)
    assert cotraining.score(docs.limit(0), nothing).count() == 0


def test_views_teach_each_other(spark):
    """Ten topics and ten sources of each class, of which the labels show two: neither view gets far alone."""
    rng = np.random.default_rng(9)
    alphabets = ["".join(chr(0x4E00 + 40 * t + k) for k in range(3)) for t in range(20)]
    rows = []
    for k in range(900):
        good = int(rng.integers(2))
        topic, source = (int(rng.integers(2)) if k < 40 else int(rng.integers(10)) for _ in range(2))
        text = " ".join("".join(rng.choice(list(alphabets[10 * good + topic]), 3)) for _ in range(20))
        rows.append((k, text, f"site{10 * good + source}", "zh", 80, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, good int")
    labels = docs.filter("doc_id < 40").select("doc_id", F.col("good").alias("quality"))
    unseen = {r[0]: bool(r[5]) for r in rows[40:]}

    def right(model):
        found = [r for r in cotraining.score(docs, model).collect() if r.doc_id in unseen]
        views = [np.mean([(getattr(r, v) >= 0.5) == unseen[r.doc_id] for r in found]) for v in ("text_score", "meta_score", "score")]
        return [round(float(x), 3) for x in views]

    alone, together = right(cotraining.train(docs, labels, rounds=0)), right(cotraining.train(docs, labels))
    assert max(alone[:2]) < 0.85 and min(together) > 0.95


# BPE


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_round_trip(spark, docs, none, name):
    from tokenizers import Tokenizer

    path = tokenizer(name)
    library = Tokenizer.from_file(path)
    more = spark.createDataFrame(
        [(1, "Hello<|endoftext|> '" + "xyz" * 15_000), (2, "中文 ab՘x 𝔸 ΑΣ"), (3, "é" * 40_000)], "doc_id long, text string"
    )
    for some in (docs, more):
        for r in bpe.decode(bpe.encode(some, path), path).collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
            assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, path).count() == 0


def test_tree_concatenation_joins_exactly(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 4)
    with open(tokenizer("word_bpe_49k.json"), "rb") as file:
        vocabulary = bpe.Vocabulary(file.read())
    rng = np.random.default_rng(7)
    for _ in range(200):
        raw = bytes(rng.choice(list(b"thenigsort"), rng.integers(5, 90)).tolist()) + bpe.END
        assert vocabulary.tree(raw) == vocabulary._leaf(raw)


# Pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == corpus_pipeline.COLUMNS and after.count() <= now.count()
        assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
        now = after
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, lang_pred int, copy int"
    text = "The first words of a document that goes on for a while and then ends here, more or less."
    rows = [(1, text, "en"), (1, text, "en"), (None, text + " Not quite.", "en"), (2, None, None), (3, "", "en"), (4, "?? 12", "en"),
            (5, "word " * 30_000, "en")]
    awkward = spark.createDataFrame([(*r, "s", None, "x", 1, 2) for r in rows], kinds)
    for k, now in enumerate((awkward, awkward.limit(0))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, now, "").write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert now.columns == corpus_pipeline.COLUMNS
        packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
        assert {p.doc_id for p in packed} - {None} == ({1, 5} if k == 0 else set())
        assert sum(p.doc_id == 1 and p.start == 0 for p in packed) == (k == 0)


def test_queries_equal_sql(spark):
    from oracle_check import connect, differences

    from buzzlens.llm.queries import QUERIES, SQL

    directory = "/root/testdata/sf0.001"
    database = connect(directory)
    for name, sql in SQL.items():
        assert differences(spark, database, directory, name, QUERIES[name], sql) is None
