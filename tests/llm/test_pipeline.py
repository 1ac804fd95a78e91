"""The pipeline's rows against plain Python that does each stage anew."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from barlake.llm import quality
from test_learned_operators import SPACED, brute_counts
from test_ordermh import brute_classes, shingled
from test_text_operators import brute_minimax, brute_overlap


def plain_features(text):
    words, letters = SPACED.findall(text), "".join(SPACED.findall(text)).encode()
    n, chars, symbols, dup_lines, repeated = brute_counts(text)
    lines = sum(bool(SPACED.search(x)) for x in text.split("\n"))
    some, solid = max(n, 1), max(chars, 1)
    found = lambda marks: len(re.findall(marks, letters))
    return [
        np.log1p(n), chars / some, symbols / some, dup_lines / max(lines, 1), repeated / some, found(rb"[A-Z]") / solid, found(rb"!") / some,
        found(rb"[0-9]") / solid, found(rb"[.,;:?'\"()-]") / some, len(set(words)) / some, n / max(lines, 1),
    ]


def walked(trees, x):
    total = trees.base
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return total


def brute_quality(docs, trees):
    kept = []
    for doc in docs:
        n, _, _, _, repeated = brute_counts(doc["text"])
        if n >= 50 and 2 * repeated <= n and walked(trees, plain_features(doc["text"])) >= 0:
            kept.append(doc)
    return kept


def brute_dedup(docs):
    first = brute_classes([(d["doc_id"], d["text"]) for d in docs if shingled(d["text"])])[0]
    return [d for d in docs if first.get(d["doc_id"], d["doc_id"]) == d["doc_id"]]


def brute_mix(docs):
    size = {d["doc_id"]: len(SPACED.findall(d["text"])) for d in docs}
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = 0.0, 2.0 * sum(own.values())  # the water level, halved until it is fixed
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * own[s], level * weight[s]) for s in names) < 1.5 * sum(own.values()) else (low, level)
    out = []
    for s in names:
        target = min(2 * own[s], high * weight[s])
        epochs = math.floor(target / own[s] + 1e-9)
        drawn = []
        for d in (d for d in docs if d["source"] == s):
            solid = re.sub(rb"[\x20\x09-\x0D]", b"", d["text"].encode())
            worth = 0.1 + 0.9 * (1 - len(re.findall(rb"[#*$%&|<>!]", solid)) / max(len(solid), 1))
            digest = hashlib.md5(f"mix:{d['doc_id']}:{hashlib.md5(d['text'].encode()).hexdigest()}".encode()).hexdigest()
            drawn.append((-math.log((int(digest[:13], 16) + 0.5) / 2**52) / worth, d["doc_id"], d))
        before = 0
        for _, i, d in sorted(drawn, key=lambda x: x[:2]):
            out += [d] * (epochs + (epochs < 2 and before + size[i] / 2 <= target - epochs * own[s]))
            before += size[i]
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = [
        lambda rows: brute_quality(rows, trees),
        brute_dedup,
        lambda rows: [r for r in rows if not brute_overlap(r["text"], items)[4]],
        brute_mix,
    ]
    want = docs.collect()
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain, strict=False):
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "stage")
        before, want = len(want), brute(want)
        assert ids(docs.collect()) == ids(want), name
        assert want and len(want) != before, name
    got = corpus_pipeline.run(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in want}
    assert ids(got) == ids(want)
    groups, load, shard_of, slots = Counter(), Counter(), {}, {}
    for r in want:
        groups[hashlib.md5(r["text"].encode()).digest()] += len(r["text"].encode()) + 1
    for r in got:
        raw = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert shard_of.setdefault(hashlib.md5(raw).digest(), r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    keys = sorted(groups)
    assert [shard_of[k] for k in keys] == sorted(shard_of.values())  # contiguous in the order of text hashes
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == brute_minimax([groups[k] for k in keys], 8)
