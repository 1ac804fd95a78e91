"""Order MinHash near-dedup against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from barlake.llm import ordermh, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length_equals_the_plain_programme():
    rng = random.Random(4)
    for _ in range(150):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
        assert ordermh.common_length(a, b, 100) == plain_lcs(a, b)
    for _ in range(6):  # longer than the band: edits keep it near the diagonal
        a = [rng.randrange(400) for _ in range(1500)]
        b = list(a)
        for _ in range(30):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.randrange(400)]
        assert ordermh.common_length(a, b, 80) == plain_lcs(a, b)


def shingled(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_classes(docs, least=0.8):
    """{id: class} by comparing all pairs that share a shingle."""
    seqs = {i: shingled(t) for i, t in docs}
    bags = {i: Counter(s) for i, s in seqs.items()}
    root = {i: i for i in seqs}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, bag in bags.items():
        for s in bag:
            holders.setdefault(s, []).append(i)
    pairs = {(min(a, b), max(a, b)) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    links = 0
    for a, b in sorted(pairs):
        n, m = len(seqs[a]), len(seqs[b])
        most = (bags[a] & bags[b]).total()
        if most < least * (n + m - most):
            continue
        length = plain_lcs(seqs[a], seqs[b])
        if length >= least * (n + m - length):
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in seqs}, links


def test_op4_equals_all_pairs(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, links = brute_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in queries.op4_order_minhash(spark, sf_dir).collect()}
    assert links > 0 and got == want


def family(rng, base, most):
    words = list(base)
    for _ in range(rng.randrange(1, most)):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_large_family_stays_together(spark):
    """More near copies than a key pairs all of, and one exact copy group: still one class each."""
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    other = " ".join(f"c{rng.randrange(10**6)}" for _ in range(100))
    docs = [(i, family(rng, base, 4)) for i in range(300)] + [(1000 + i, other) for i in range(200)] + [(5000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(60))) for i in range(50)]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in ordermh.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {(0, 300)}
    assert {got[1000 + i] for i in range(200)} == {(1000, 200)}
    assert all(got[5000 + i] == (5000 + i, 1) for i in range(50))


def drifting(rng, base, n, step):
    """Copies of copies: each differs from one before it in up to `step` words."""
    made = [list(base)]
    for _ in range(n - 1):
        words = list(made[rng.randrange(max(0, len(made) - 6), len(made))])
        for _ in range(rng.randrange(1, step)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        made.append(words)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("order", [{}, {"rarity_bits": 1}])
def test_op4_one_hot_key_links_every_family(spark, order):
    """120 pairs of similar texts and a chain of 60, all under one key and with nobody near most of them."""
    rng = random.Random(6)
    word = lambda: rng.randrange(2**32)
    seqs = []
    for _ in range(120):
        one = [word() for _ in range(80)]
        seqs += [one, [*one[:78], word(), word()]]
    chain = [word() for _ in range(80)]
    for k in range(60):
        chain = [*chain[4:], *(word() for _ in range(4))]
        seqs.append(chain)
    rows = [(f"n{k:03}".encode(), np.array(s, "<u4").tobytes()) for k, s in enumerate(seqs)]
    members = spark.createDataFrame([(7, node, 76) for node, _ in rows], "key long, node binary, n long")
    found = ordermh.links(members, spark.createDataFrame(rows, "node binary, seq binary"), **order)
    roots = {bytes(r["node"]): bytes(r["root"]) for r in ordermh.components(found).collect()}
    want = {f"n{k:03}".encode(): (f"n{k // 2 * 2:03}" if k < 240 else "n240").encode() for k in range(300)}
    assert {n: roots.get(n, n) for n in want} == want


@pytest.mark.parametrize("bits", [ordermh.RARITY_BITS, 1])
def test_op4_hot_keys_equal_all_pairs(spark, monkeypatch, bits):
    """Drifting families, variants of a template and short texts about one shared passage; also with no knowledge of what is rare."""
    monkeypatch.setattr(ordermh, "links", lambda *a, real=ordermh.links, **b: real(*a, **b, rarity_bits=bits))
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(10**6)}"
    texts = [t for _ in range(3) for t in drifting(rng, [word() for _ in range(120)], 90, 4)]
    frame = [word() for _ in range(90)]
    texts += [" ".join([*frame[:45], *(word() for _ in range(rng.randrange(4, 14))), *frame[45:]]) for _ in range(80)]
    shared = " ".join(word() for _ in range(60))
    tails = [" ".join(word() for _ in range(11)) for _ in range(40)]
    texts += [f"{shared} {t}" for t in tails] + [f"{shared} {t} {word()} {word()}" for t in tails]
    docs = list(enumerate(texts))
    want, links = brute_classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in ordermh.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert links > 0 and got == want


def test_op4_prefixes_meet_wherever_texts_are_similar(spark):
    """Pairs on both sides of the threshold, with shingles that repeat: those at it share a token, and so do the pairs found."""
    rng = random.Random(9)
    seqs = []
    for _ in range(60):
        one = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        two = [w if rng.random() > 0.015 else rng.randrange(10**6) for w in one]
        seqs += [one, two[: len(two) - rng.randrange(0, 3)] or one]
    rows = [(f"n{k:03}".encode(), f"n{k:03}".encode(), np.array(q, "<u4").tobytes()) for k, q in enumerate(seqs)]
    texts = spark.createDataFrame(rows, "node binary, comp binary, seq binary")
    held = {}
    for r in ordermh.prefixes(texts).collect():
        held.setdefault(bytes(r["node"]), set()).add(r["token"])
    own = {node: ordermh._shingled(seq) for node, _, seq in rows}
    similar = [(a, b) for a, _, _ in rows for b, _, _ in rows if a < b and ordermh.similarity(own[a], own[b]) >= 0.8]
    assert len(similar) > 20 and all(held[a] & held[b] for a, b in similar)
    roots = {bytes(r["node"]): bytes(r["root"]) for r in ordermh.components(ordermh.rare_links(texts, texts.select("node", "seq"))).collect()}
    want = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in similar:
            want[a] = want[b] = min(want[a], want[b])
    assert {n: roots.get(n, n) for n in want} == want


def test_op4_a_hot_shingle_asks_for_a_second(spark, monkeypatch):
    """Texts that share a passage and nothing else, some similar ones among them: fewer pairs are compared, and no link is lost."""
    rng = random.Random(9)
    word = lambda: rng.randrange(2**32)
    passage = [word() for _ in range(9)]
    seqs = []
    for k in range(700):
        one = [*passage, *(word() for _ in range(rng.randrange(28, 34)))]
        seqs.append(one)
        if k % 20 == 0:
            seqs.append([*one[:-1], word()])
    seqs.append([*passage, *(word() for _ in range(600))])  # longer than a front
    seqs.append([*seqs[-1][:-2], word()])
    rows = [(f"n{k:04}".encode(), f"n{k:04}".encode(), np.array(q, "<u4").tobytes()) for k, q in enumerate(seqs)]
    texts = spark.createDataFrame(rows, "node binary, comp binary, seq binary")
    compared = []
    monkeypatch.setattr(ordermh, "verified", lambda pairs, *a, real=ordermh.verified, **b: (compared.append(pairs.count()), real(pairs, *a, **b))[1])
    found = {hot: {tuple(map(bytes, r)) for r in ordermh.rare_links(texts, texts.select("node", "seq"), bits=1, hot=hot).collect()} for hot in (64, 1 << 40)}
    assert len(found[64]) == 36 and found[64] == found[1 << 40]
    assert compared[1] < compared[3] * 0.7 and compared[3] > 5_000


def test_order_matters(spark):
    rng = random.Random(2)
    parts = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    docs = [(1, " ".join(parts)), (2, " ".join(reversed(parts)))]
    got = {r["doc_id"]: r["class_id"] for r in ordermh.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2}


def test_op4_odd_rows(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, "?! --", "x"), (4, "short text", None), (5, "Short, TEXT!", "x"), (5, "Short, TEXT!", "x"), (None, "short text", "x"), (7, "one " * 5000, "x"), (8, "one " * 4990, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, node string")
    got = sorted(map(tuple, ordermh.classes(frame).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 4), (5, 4, 4), (5, 4, 4), (None, 4, 4), (7, 7, 2), (8, 7, 2)], key=str)
    kept = sorted((r["doc_id"] for r in ordermh.one_of_each(frame).collect()), key=str)
    assert kept == [1, 2, 3, 4, 7]
    assert ordermh.classes(frame.limit(0)).count() == 0


def test_one_of_each_keeps_texts_without_an_id_of_their_own(spark):
    """Several rows of a null id, and one id with two texts, one of which is a copy."""
    docs = [(None, "first text"), (None, "second text"), (None, "Second, text"), (None, None), (None, ""), (3, "third text"), (None, "third text"), (9, "third text"), (9, "fourth text"), (9, "fourth text"), (8, ""), (8, "")]
    kept = ordermh.one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], (r["text"] or "").lower().replace(",", "")) for r in kept), key=str)
    assert got == sorted([(None, "first text"), (None, "second text"), (None, ""), (None, ""), (3, "third text"), (9, "fourth text"), (8, "")], key=str)


@pytest.mark.parametrize("edits", [0, 3, 8])
def test_similarity(edits):
    rng = np.random.default_rng(edits)
    a = rng.integers(0, 1 << 40, 400).astype(np.uint64)
    b = a.copy()
    b[rng.choice(400, edits, replace=False)] = 7
    length = plain_lcs(a.tolist(), b.tolist())
    assert ordermh.similarity(a, b) == pytest.approx(length / (800 - length))
