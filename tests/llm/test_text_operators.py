"""Operators against brute force on the small tables, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barlake.llm import decontam, linedup, mixing, queries, sharding, tokenbin

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, n_words string, part int"
ODD = [
    (1, None, "en", "a", "x", "y", 1),
    (2, "", None, None, "x", "y", 1),
    (3, "one two\nthree", "en", "a", None, None, None),
    (3, "one two\nthree", "en", "a", None, None, None),
    (None, "The Same long line here\n  the same LONG line here \t\nother", "fr", "b", "x", "y", 1),
    (4, "the same long line here", None, "b", "x", "y", 2),
    (5, "word " * 60_000, "de", "b", "x", "y", 2),
    (6, "éèê ñandú 漢字 漢字 x\x1cy <|endoftext|> it's A.B,,C 12", "es", "c", "x", "y", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_op1_files_hold_the_tokenizers_ids(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(queries.op1_token_binary(spark, sf_dir).collect())
    start = 0
    docs = sorted(rows(spark, sf_dir), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    for doc, row in zip(docs, got, strict=True):
        ids = [*tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(row) == (doc["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_odd_texts_and_shuffled_reads(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = tokenbin.write_tokens(odd, path, rows_per_file=2)
    digest = tokenbin.token_digest(manifest).collect()
    by_id = {r["doc_id"]: r for r in digest}
    assert len(digest) == len(ODD) and by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 1
    for doc in ODD:
        ids = [*tokenizer.encode(doc[1] or "", add_special_tokens=False).ids, 2]
        row = by_id[doc[0]]
        payload = tokenbin.read_record(row["data_path"], row["index_path"], row["record"])
        assert np.frombuffer(payload, "<u2").tolist() == ids
    assert [r["start"] for r in sorted(digest, key=lambda r: (r["doc_id"] or -1, r["start"]))][0] == 0


def test_op1_rows_without_ids_are_dealt_and_repeats_are_records(spark):
    """A third of the rows without an id, and one row many times: no file holds a whole group, and ids ascend over the files."""
    data = [(None, f"text {i}") for i in range(40)] + [(7, "again")] * 40 + [(i, f"own {i}") for i in range(40)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    manifest = tokenbin.write_tokens(frame, public_tokenizers.path("word_bpe_49k.json"), rows_per_file=15)
    files = manifest.orderBy("part").collect()
    assert sum(f["n_records"] for f in files) == len(data) and max(f["n_records"] for f in files) < 40
    ids = [i for f in files for i in tokenbin.read_index(f["index_path"]).tolist()]
    assert [known for *_, known in ids] == [0] * 40 + [1] * 80
    named = [i for *_, i, known in ids if known]
    assert named == sorted(named)
    got = sorted(tokenbin.token_digest(manifest).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    assert tokenbin.token_digest(tokenbin.write_tokens(frame.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_op1_damage_is_found():
    whole = tokenbin.frame(b"abcdef")
    assert tokenbin.unframe(whole) == b"abcdef"
    for at in (3, 9, 14, len(whole) - 1):
        with pytest.raises(ValueError):
            tokenbin.unframe(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])


def brute_overlap(text, items, span=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        own = WORD.findall(lower(item_text))
        length = min(span, len(own))
        windows = {tuple(own[i : i + length]) for i in range(len(own) - length + 1)} if length else set()
        for i in range(len(words) - length + 1):
            if length and tuple(words[i : i + length]) in windows:
                hit |= set(range(i, i + length))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op5_equals_brute_force(spark, sf_dir):
    items = [tuple(r) for r in rows(spark, sf_dir, "benchmark")]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op5_decontamination(spark, sf_dir).collect()}
    docs = rows(spark, sf_dir)
    assert len(got) == len(docs) and any(x[4] for x in got.values())
    for doc in docs:
        assert got[doc["doc_id"]] == brute_overlap(doc["text"], items)


def test_op5_short_items_joins_and_odd_rows(spark, odd):
    items = [(1, "one TWO"), (2, None), (3, ""), (4, "Three"), (10, "same long line here the same long line here other x"), (7, " ".join(["word"] * 12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"broadcast_windows": 0}, {"bits": 6}):  # by broadcast, by a salted shuffle, and with a bitmap that lets nearly all through
        got = decontam.digest(decontam.overlaps(odd, bench, **how)).collect()
        assert sorted(tuple(r)[1:] for r in got) == sorted(brute_overlap(d[1], items) for d in ODD)
    assert decontam.overlaps(odd, bench.limit(0)).where("size(hit_items) > 0").count() == 0
    assert decontam.overlaps(odd.limit(0), bench).count() == 0
    whole = decontam.overlaps(odd, bench)
    assert whole.columns == [*(c for c in odd.columns if c != "n_words"), "n_words", "hit_spans", "hit_items"]


def test_op5_every_shared_passage_of_ten_words_is_found(spark):
    """Passages of 9 to 14 words at any place, items that share all but a few words, and k-grams of many contexts, by each way."""
    rng = random.Random(5)
    vocabulary = [*(f"v{i}" for i in range(12)), "x" * 40, "x" * 39 + "y"]
    stock = ["let", "it", "be", "known", "that"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=8) + stock + rng.choices(vocabulary, k=9) + (stock if i % 3 else []))) for i in range(60)]
    items += [("short", "it be known"), ("five", "let it be known that"), ("copy", items[0][1])]
    docs = []
    for i in range(150):
        own = rng.choice(items[:60])[1].split()
        at, length = rng.randrange(len(own)), rng.randint(9, 14)
        docs.append((i, " ".join(rng.choices(vocabulary, k=rng.randrange(6)) + own[at : at + length] + rng.choices(vocabulary, k=rng.randrange(6)))))
    want = {i: brute_overlap(text, items) for i, text in docs}
    assert 20 < sum(w[4] for w in want.values()) < 150
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for how in ({}, {"crowd": 1}, {"crowd": 1, "broadcast_windows": 0}, {"crowd": 10**6}):
        assert {r["doc_id"]: tuple(r)[1:] for r in decontam.digest(decontam.overlaps(frame, bench, **how)).collect()} == want


def test_op5_keeps_a_third_of_the_k_grams_and_one_of_every_stretch():
    rng = np.random.default_rng(0)
    hashes, row = rng.integers(0, 1 << 63, 30_000).astype(np.uint64), np.repeat([0, 1, 2], 10_000)
    at, _ = decontam.winnowed(hashes, row, 10, 5)
    assert 0.25 < len(at) / len(hashes) < 0.32
    kept = set(at.tolist())
    assert all(kept & set(range(i, i + 6)) for i in range(len(hashes) - 9) if row[i] == row[i + 9])
    assert not any(row[i] != row[i + 4] for i in kept)
    at, _ = decontam.winnowed(np.repeat(hashes[:1], 30), np.zeros(30, int), 10, 5)
    assert at.tolist() == list(range(5, 26))  # of equal ones the last of each stretch


def test_op5_items_without_an_id_count(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b c d e f g h i")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d e f g h i j"), (None, "a b c d e f g h i j k")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.digest(decontam.overlaps(docs, bench)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (10, 0, True) and not got[2]["contaminated"]


def test_op5_spans_are_extended_over_overlapping_windows(spark):
    shared = [f"s{i}" for i in range(40)]
    text = " ".join(["p", "q", *shared[:25], "r", *shared[25:40]])
    got = decontam.overlaps(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("b", " ".join(shared)), ("a", " ".join(shared[30:]))], "item_id string, text string")).first()
    assert [tuple(x) for x in got["hit_spans"]] == [(2, 27), (28, 43)] and got["hit_items"] == ["a", "b"]


def test_op6_targets_and_taken(spark, sf_dir):
    got = queries.op6_source_mix(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in rows(spark, sf_dir)}
    sizes = {i: len(SPACED.findall(d["text"] or "")) for i, d in docs.items()}
    source = Counter()
    for i, d in docs.items():
        source[d["source"]] += sizes[i]
    names = sorted(source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(source.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * source[s]}
        for s in over or free:
            target[s] = 2.0 * source[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= over
    taken = Counter()
    for row in got:
        s = docs[row["doc_id"]]["source"]
        assert row["size"] == sizes[row["doc_id"]] and row["source_size"] == source[s]
        assert row["target"] == pytest.approx(target[s]) and row["taken"] <= 2 * row["size"]
        taken[s] += row["taken"]
    largest = max(sizes.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_source_mix(spark, sf_dir).collect()))


def test_op6_odd_rows(spark, odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(ODD)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    assert mixing.mixed(odd.limit(0)).count() == 0


def test_op6_rows_without_ids_agree_in_any_order(spark):
    sized = [(None, " ".join(f"w{n}{j}" for j in range(n)), "s", n % 3) for n in range(3, 60)] + [(7, "same text", "s", 1)] * 9 + [(7, "same text", "s", 2)] * 5
    runs = []
    for rows_ in (sized, sized[::-1]):
        docs = spark.createDataFrame(rows_, "doc_id long, text string, source string, extra int").repartition(5)
        plan = sorted((r["size"], r["taken"]) for r in mixing.mixed(docs).collect())
        emitted = Counter(map(tuple, mixing.mix_documents(docs).collect()))
        target, total = mixing.mixed(docs).first()["target"], sum(n * len(row[1].split()) for row, n in emitted.items())
        assert sum(t for _, t in plan) == total and abs(total - target) <= 60
        runs.append((plan, emitted))
    assert runs[0] == runs[1] and {row for row in runs[0][1]} == set(sized)  # 150 %: each row once at least
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    odd_names = docs.withColumns({"size": F.lit("x"), "key": F.lit(1), "target": F.lit(None).cast("int")})
    assert mixing.mix_documents(odd_names).columns == odd_names.columns and mixing.mix_documents(odd_names).count() == sum(runs[0][1].values())


def test_op6_weights_may_be_given(spark):
    docs = spark.createDataFrame([(i, "five words in every text", "s", 1.0 if i < 300 else None) for i in range(600)], "doc_id long, text string, source string, worth double")
    taken = [r["doc_id"] for r in mixing.mixed(docs, volume=0.4, quality_col="worth").where("taken > 0").collect()]
    assert len(taken) == 240 and max(taken) < 300


def test_op6_prefers_quality(spark):
    clean = [(i, "good words here now " * 5, "s") for i in range(400)]
    marked = [(400 + i, "## $$ %% && " * 5, "s") for i in range(400)]
    docs = spark.createDataFrame([*clean, *marked], "doc_id long, text string, source string")
    got = mixing.mixed(docs, volume=0.5).collect()
    share = sum(r["taken"] > 0 for r in got if r["doc_id"] < 400) / sum(r["taken"] > 0 for r in got)
    assert share > 0.75


def brute_lines(docs):
    """docs: (id, text); what each keeps."""
    strip, holders = " \t\n\x0b\x0c\r", {}
    key = lambda line: lower(line.strip(strip))
    top = 1 << 63
    for i, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(top if i is None else i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == (top if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_op8_equals_brute_force(spark, sf_dir):
    got = sorted(map(tuple, queries.op8_line_dedup(spark, sf_dir).collect()))
    assert got == sorted(brute_lines([(r["doc_id"], r["text"]) for r in rows(spark, sf_dir)]))
    assert sum(r[2] for r in got) > 0


def test_op8_odd_rows(spark, odd):
    got = linedup.deduplicated(odd).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_lines([(d[0], d[1]) for d in ODD])))
    assert linedup.deduplicated(odd.limit(0)).count() == 0


def test_op8_deleting_undoes_inserting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    early, late = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")

    def state(index):
        return sorted((bytes(r["key"]), r["refs"], r["first_doc"], r["last_doc"]) for r in index.counts.collect())

    def result(index, of):
        return sorted(map(tuple, linedup.deduplicated(of, index).collect()))

    before = linedup.LineIndex.build(early, keys_per_shard=50)
    both = before.insert(late)
    whole = linedup.LineIndex.build(docs)
    assert state(both) == state(whole) and result(both, docs) == result(whole, docs)
    after = both.delete(late.select("doc_id"))
    assert state(after) == state(before) and result(after, early) == result(before, early)
    without_first = both.delete(early.select("doc_id"))
    assert result(without_first, late) == result(linedup.LineIndex.build(late), late)


def test_op8_same_result_by_shard_groups_and_for_rows_without_ids(spark, sf_dir, monkeypatch):
    common = "a line that every document has"
    made = [(None, f"{common}\nonly in {i} and nowhere else") for i in range(40)] + [(i, f"{common} \nshared by pairs {i // 2}\n{'x' * (i % 15)}") for i in range(60)] + [(3, common), (3, common), (None, f"{common}\nonly in 5 and nowhere else"), (8, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = sorted(map(str, brute_lines(made)))
    for heavy in (linedup.HEAVY_PARTS, 1, 20):
        monkeypatch.setattr(linedup, "HEAVY_PARTS", heavy)
        index = linedup.LineIndex.build(docs, keys_per_shard=4)
        assert index.shards > 3
        for how in ({}, {"broadcast_bytes": 0, "group_rows": 7}):
            got = linedup.deduplicated(docs, index, **how).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256)).collect()
            assert sorted(str(tuple(r)) for r in got) == want
    again = index.insert(docs.where("doc_id = 5")).insert(docs.where("doc_id % 2 = 0"))
    assert sorted(map(tuple, again.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    assert index.delete(docs.where("doc_id > 1000")).references.count() == index.references.count()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    filled = linedup.CuckooFilter.build(keys)
    assert filled.contains(keys).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    assert filled.contains(others).mean() < 0.002
    filled.delete(keys[:1500])
    assert filled.contains(keys[1500:]).all() and filled.contains(keys[:1500]).mean() < 0.01
    assert linedup.CuckooFilter.of_bytes(filled.to_bytes()).contains(keys[1500:]).all()


def brute_minimax(sizes, shards):
    best = [[float("inf")] * (shards + 1) for _ in range(len(sizes) + 1)]
    best[0] = [0] * (shards + 1)
    for i in range(1, len(sizes) + 1):
        for k in range(1, shards + 1):
            best[i][k] = min(max(best[j][k - 1], sum(sizes[j:i])) for j in range(i))
    return best[len(sizes)][shards]


def test_minimax_against_dynamic_programme():
    rng = np.random.default_rng(0)
    for trial in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 25)).tolist()
        if trial % 3 == 0:
            sizes[int(rng.integers(len(sizes)))] = 400
        edges = np.concatenate([[0], np.cumsum(sizes)])
        for shards in (1, 2, 3, 5):
            bounds = [0, *sharding.divide(edges, shards), int(edges[-1])]
            assert len(bounds) <= shards + 1
            assert max(np.diff(bounds)) == brute_minimax(sizes, shards), (sizes, shards, bounds)


def test_op9_layout(spark, sf_dir, monkeypatch):
    docs = {r["doc_id"]: r["text"] or "" for r in rows(spark, sf_dir)}
    got = queries.op9_sharding(spark, sf_dir).collect()
    assert len(got) == len(docs)
    by_text, slots, load = {}, {}, Counter()
    for r in got:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        assert by_text.setdefault(docs[r["doc_id"]], r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for text in docs.values():
        groups[text] += len(text.encode()) + 1
    keyed = sorted(groups.items(), key=lambda x: hashlib.md5(x[0].encode()).digest())
    edges = np.concatenate([[0], np.cumsum([n for _, n in keyed])])
    bounds = [0, *sharding.divide(edges, 8), int(edges[-1])]
    assert max(load.values()) == max(np.diff(bounds))
    monkeypatch.setattr(sharding, "BLOCKS", 10)
    monkeypatch.setattr(sharding, "MAX_EDGES", 20)
    coarse = Counter()
    for r in queries.op9_sharding(spark, sf_dir).collect():
        coarse[r["shard"]] += r["size"]
    assert max(coarse.values()) == max(load.values())


def test_op9_odd_rows(spark, odd):
    got = sharding.shards_of(odd, 3).collect()
    assert len(got) == len(ODD) and {r["shard"] for r in got} <= {0, 1, 2}
    assert sharding.shards_of(odd.limit(0)).count() == 0
