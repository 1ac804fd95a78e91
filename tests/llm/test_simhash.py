"""SimHash classes against all pairs of fingerprints computed in plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from barlake.llm import queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for i in range(64):
            votes[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * votes[i] > len(grams))


def plain_roots(values):
    """The least position linked with each, over all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def plain_classes(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    distinct = sorted(set(prints))
    roots = dict(zip(distinct, plain_roots(distinct), strict=True))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)), key=str)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op13_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = plain_classes(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({r[2] for r in want}) < len(want)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, None), (1, "One\tTWO"), (2, "one two"), (4, "one two three"), (7, long), (8, long.upper()), (None, long + " end"), (6, "é\x1cü ß É"), (6, "é\x1cü ß É"), (None, "nobody else has this text at all")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, fingerprint string, fp string, docs int")
    assert sorted((tuple(r) for r in simhash.classes(docs).collect()), key=str) == plain_classes(rows)
    assert simhash.classes(docs.limit(0)).collect() == []


@pytest.mark.parametrize("small", [0, 32])
def test_large_buckets_lose_no_link(spark, small):
    """Dense families share segments; with a small bound every step of the cutting is used."""
    random.seed(small)
    values = {random.getrandbits(64) for _ in range(200)}
    for _ in range(4):
        centre = random.getrandbits(64)
        weak = random.sample(range(64), 14)
        for _ in range(60):
            values.add(centre ^ sum(1 << i for i in random.sample(weak, random.choice([0, 1, 2, 4, 5, 7]))))
        chain = centre
        for _ in range(30):  # drifts by three bits at a time
            chain ^= sum(1 << i for i in random.sample(range(64), 3))
            values.add(chain)
        values |= {centre & ~0xFFFF | random.getrandbits(16) for _ in range(40)}  # agree in 48 bits
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v, 1) for v in values]
    distinct = spark.createDataFrame(rows, "fp long, docs long")
    unsigned = {r["fp"] % (1 << 64): r["part"] % (1 << 64) for r in simhash.parts_of(distinct, small=small).collect()}
    groups = [{v for v in values if unsigned.get(v, v) == p} for p in {unsigned.get(v, v) for v in values}]
    roots = plain_roots(values)
    assert sorted(map(sorted, groups)) == sorted(sorted(v for v, r in zip(values, roots, strict=True) if r == root) for root in set(roots))


def test_wildcard_signatures_meet_exactly_the_close_segments(spark):
    values = [0x0123456789ABCDEF, 0x0123456789ABCDEF ^ 1 << 63, 0x0123456789ABCDEF ^ 1 << 3 ^ 1 << 40, 0x7FFFFFFF00000000, 0x3FFFFFFF80000000]
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, 1) for v in values], "fp long, docs long")
    got = {(r["mask"], r["key"]): r["n"] for r in simhash.segment_buckets(rows).groupBy("mask", "key").agg(F.count("*").alias("n")).collect()}
    for (mask, key), n in got.items():
        assert n == sum(((v & mask) - key) % (1 << 64) == 0 for v in values) > 1
