"""Spelling variants, token alignment and the vector forest against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import registry, spelling, token_alignment, vector_forest
from ledgerlight.llm.common import read
from ledgerlight.llm.tokenizers_path import byte_level, path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, word string, `_row` long, `_metadata` string"


def table(spark, rows, tmp_path):
    """Rows (id, text) as Parquet, with columns whose names the operators use themselves."""
    spark.createDataFrame([(i, t, 1, "x", 2, "m") for i, t in rows], DOCS).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


# --- spelling variants -------------------------------------------------------------------------------------------------


def plain_variants(rows, least=5, drop_every=199, factor=5):
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
    near = {w: set().union(*(holes[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w)))) - {w} for w in n}
    for w in n:
        for i in range(len(w)):
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda y: (-n[y], y), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variants(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_spelling_query(spark):
    got = registry.op11_spelling(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = read(spark, SF, "documents").select("doc_id", "text").collect()
    assert variants(got) == plain_variants([tuple(r) for r in rows])


def test_spelling_in_many_boxes(spark, monkeypatch):
    """Small boxes and few sampled words: queries cross the outer trees' cuts."""
    monkeypatch.setattr(spelling, "BOX", 40)
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain_variants(rows, least=2)
    for sample in (1 << 17, len(want) // 3):
        monkeypatch.setattr(spelling, "SAMPLE", sample)
        assert variants(spelling.spelling_variants(read(spark, SF, "documents"), least=2)) == want


def test_spelling_cases(spark, tmp_path):
    rng = np.random.default_rng(5)
    shuffled = {"".join(rng.permutation(list("aabbccdd"))) for _ in range(300)}  # leaves of equal counts
    near = {w[:3] + "b" + w[4:] for w in shuffled}
    longer = {w[:2] + "é" + w[2:] for w in list(shuffled)[:80]}
    text = " ".join(w for n, group in ((5, shuffled), (6, near), (30, longer)) for w in group for _ in range(n))
    long_word = "ab" * 40_000
    rows = [
        (1, text), (2, None), (3, ""), (4, "..."), (None, "Straße Straßen STRASSE " * 6), (5, "chain chains chainss " * 3),
        (6, (long_word + " " + long_word + "c ") * 5), (7, "tieaaa tieaab tieaac " * 5), (7, "tieaaa tieaab tieaac " * 5),
        (8, "Ärger ÄRGER ärger naïvely× ıstanbul " * 7), (9, "steps0 stepsa " * 6 + "stepsab " * 40 + "stepsabc " * 250),
    ]
    docs = table(spark, rows, tmp_path)
    want = plain_variants(rows)
    assert variants(spelling.spelling_variants(docs)) == want
    assert want["stepsa"][:2] == ("stepsab", "stepsabc")
    assert spelling.spelling_variants(docs.filter("false")).count() == 0


def test_reached_boxes_hold_all_edits():
    rng = np.random.default_rng(1)
    words = rng.integers(97, 103, size=(400, 7)).astype(np.uint8)
    tree = spelling.Tree(spelling.letter_counts(words), 8)
    i, j = spelling.near_pairs(tree, words, words)
    differ = (words[:, None, :] != words[None, :, :]).sum(axis=2) == 1
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(differ)), strict=True))
    home = tree.home(spelling.letter_counts(words))
    assert all((home[leaf] == n).all() for n, leaf in enumerate(tree.leaves))


# --- token alignment ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def plain_groups(text, libraries):
    first, second = libraries
    if not text:
        return []
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}
    a = first.encode(" " + text, add_special_tokens=False)
    b = second.encode(text)
    a_bytes = [bytes(chars[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(n) else p.replace("▁", " ").encode() for n, p in zip(b, second.id_to_piece(b), strict=True)]
    if not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
        return []
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
    out, i, j = [], 0, 0
    for end in sorted({*a_ends.tolist()} & {*b_ends.tolist()}):
        i2, j2 = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
        out.append((a.ids[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


def plain_alignment(rows, libraries):
    groups = [(i, plain_groups(t, libraries)) for i, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in groups]
    counts = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (i, g), own in zip(groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own), sum(counts[p] == best[p[0]] for p in own),
            sum(counts[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str), counts


def test_alignment_query(spark, libraries):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = registry.op12_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_alignment(rows, libraries)[0]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_cases(spark, tmp_path, libraries, monkeypatch, small):
    if small:  # rare pairs by join, pairs in many rows, links and ends in parts
        for name, value in {"FREQUENT": 60, "LINKS": 50, "PAIRS": 40}.items():
            monkeypatch.setattr(token_alignment, name, value)
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a▁b"), (5, "<|endoftext|> x <s> </s> <unk>"), (None, "null id"), (None, "null id"),
        (6, "日本語" * 40 + " \U0001f600 é \n\n\t x"), (7, "ab" * 20_000), (8, "the cat " * 3000), (8, "the cat"), (9, "\x00\x01 x"),
    ]
    docs = table(spark, rows, tmp_path)
    tools = (*byte_level(), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    figures, links = token_alignment.align_texts(docs, *tools)
    want, counts = plain_alignment(rows, libraries)
    assert sorted(map(tuple, figures.collect()), key=str) == want
    assert {(r.first_id, r.second_id): r.n for r in links.collect()} == dict(counts)
    assert token_alignment.align_texts(docs.filter("false"), *tools)[0].count() == 0


def test_ends_in_windows(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = (np.r_[np.sort(rng.choice(999, 400, replace=False)) + 1, 1000] for _ in range(2))
    whole = token_alignment.common_ends(np.unique(a), np.unique(b))
    monkeypatch.setattr(token_alignment, "WINDOW", 7)
    parts = token_alignment.common_ends(np.unique(a), np.unique(b))
    assert all((x == y).all() for x, y in zip(whole, parts, strict=True)) and len(whole[0])


# --- vector forest -----------------------------------------------------------------------------------------------------


def neighbours(vectors, queries, k):
    """{query: [(id, score)]} by brute force; vectors: (id, tuple), once each."""
    out = {}
    width = max((len(v) for _, v in vectors), default=0)
    rows = [(i, np.r_[v, np.zeros(width - len(v))]) for i, v in sorted(set(vectors))]
    for q in sorted({i for i, _ in rows if queries(i)}):
        own = min((v for i, v in rows if i == q), key=lambda v: np.trim_zeros(v, "b").astype("<f8").tobytes())
        found = sorted(((-float((v * own).cumsum()[-1]), i) for i, v in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in found]
    return out


def by_query(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_forest_query_recall(spark):
    got = by_query(registry.op13_vector_forest(spark, SF))
    rows = [(r.vec_id, tuple(map(float, r.embedding))) for r in read(spark, SF, "embeddings").collect()]
    want = neighbours(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(found) >= 0.9
    x = dict(rows)
    for q, hits in got.items():
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert all(s == pytest.approx(float(np.dot(x[q], x[i])), abs=1e-12) for i, s in hits)


def test_forest_over_many_cells(spark, monkeypatch):
    """Clusters in cells of 64: recall with far fewer candidates than rows, vectors of any length."""
    monkeypatch.setattr(vector_forest, "CELL", 64)
    monkeypatch.setattr(vector_forest, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(40, size=1500)] + 0.15 * rng.normal(size=(1500, 12))) * rng.choice([1.0, 2.0, 3.0], size=(1500, 1))
    rows = [(n, tuple(v)) for n, v in enumerate(x.tolist())]
    forest = vector_forest.Forest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10)
    assert forest.index.count() > 10
    got, want = by_query(forest.nearest(F.col("vec_id") % 7 == 0)), neighbours(rows, lambda i: i % 7 == 0, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({*got[q]} & {*want[q]}) / 10 for q in want]) >= 0.9
    forest.drop()


def test_forest_cases(spark):
    same = (1.0, 2.0, 0.0)
    rows = [
        (0, same), (20, same), *((n, same) for n in range(100, 160)), (1, (1.0, 2.0)), (2, (0.0, 0.0, 0.0)), (3, None), (4, (1.0, None, 2.0)),
        (5, (float("nan"), 1.0)), (6, (float("inf"), 1.0)), (7, (-1.0, -2.0, 5.0)), (7, (3.0, 0.5)), (40, (2.0, 1.0)), (40, (0.5, 4.0)),
        (40, (0.5, 4.0)), (None, (9.0, 9.0)), (60, ()),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, q long, cell string")
    valid = [(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    valid = [(i, v[: 1 + max(n for n, c in enumerate(v) if c)]) for i, v in valid]
    got = by_query(vector_forest.Forest(df, k=20).nearest(F.col("vec_id") % 20 == 0, recall=1.0))
    assert got == neighbours(valid, lambda i: i % 20 == 0, 20)
    few = vector_forest.Forest(df.filter("vec_id IN (0, 1, 2, 7)"), k=20)
    assert [len(v) for v in by_query(few.nearest(F.col("vec_id") % 20 == 0)).values()] == [3]
    assert vector_forest.Forest(df.filter("false"), k=20).nearest(F.col("vec_id") % 20 == 0).count() == 0


def test_queue_takes_what_is_within_the_limit():
    x = np.random.default_rng(4).normal(size=(300, 6))
    tree = vector_forest.grown(x, 10, 1)
    home = tree.home(x)
    assert all((home[own] == n).all() for n, own in enumerate(tree.members))
    costs = tree.costs(x, np.zeros(len(x)))
    assert (costs[np.arange(len(x)), home] == 0).all()
    for row, q in enumerate(x[:40]):
        queued = tree.within(q, 0.5)
        assert [c for _, c in queued] == sorted(c for _, c in queued)
        assert sorted(leaf for leaf, _ in queued) == np.flatnonzero(costs[row] <= 0.5).tolist()
