"""Near, exact and line dedup against brute force and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import common, exact, lines, simhash
from cadenza.llm.simhash_core import fingerprint

DOC = "doc_id long, text string, fp string, key string, kept int, n int, lines string, _text string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", "y", 7, 8, "z", "w") for i, t in rows], DOC)


def components_of(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in linked:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def near_texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 120))] for _ in range(max(3, n // 10))]
    out = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    return out


def brute_near(rows, max_bits=4):
    fps = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= max_bits)]
    comp = components_of(len(rows), pairs)
    ids = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    return sorted((str(i), f"{int(f):016x}", str(ids.get(c))) for (i, _), f, c in zip(rows, fps, comp))


def test_fingerprint_by_definition():
    def plain(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
        sh = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for t in ["", "   ", "a", "a B c", "a b c d", "É a b c D e f a b c d e f", "x " * 5000, *near_texts(1, 5)]:
        assert fingerprint(t) == plain(t), t[:30]
    assert fingerprint(None) == 0


@pytest.mark.parametrize("hot", [512, 2])
def test_near_duplicates_brute_force(spark, hot):
    rows = [(i, t) for i, t in enumerate(near_texts(2, 150))]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (7, rows[7][1]), (None, "only a null id has this text")]
    got = simhash.near_duplicates(docs_of(spark, rows), hot_bucket=hot).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute_near(rows)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_near_dedup_keeps_one_and_columns(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", limit)
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "quite another text with other words here"), (None, "a b c d e f g")]
    out = simhash.near_dedup(docs_of(spark, rows))
    assert out.columns == docs_of(spark, []).columns
    assert {r.doc_id for r in out.collect()} == {3, 9, None}
    assert simhash.near_dedup(docs_of(spark, [])).count() == 0


def test_allocation_and_parts():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    bits[:, 5] = bits[:, 40]                                  # two bits that go together
    both = bits.T @ bits
    for m in (2, 3, 5):
        parts = simhash.group_bits(500, both, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        assert max(map(len, parts)) - min(map(len, parts)) <= 1
        assert any({5, 40} <= set(p) for p in parts)
    cost = [[0, 5, 9], [0, 1, 2], [0, 7, 8]]
    best = min((cost[0][a + 1] + cost[1][b + 1] + cost[2][c + 1]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0)
    assert simhash.allocate([list(map(float, c)) for c in cost], 0)[0] == best
    for n in (10, 10 ** 6, 10 ** 10):
        parts = simhash.plan(n, both, 4)
        assert sum(t + 1 for _, t in parts) >= 5              # t_i + 1 add up to d + 1: no pair is missed


def test_spanning_links_keep_connectivity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 10, 200)
    links = simhash.spanning_links(a, a, 2)
    pairs = [(i, j) for i in range(200) for j in range(200) if bin(int(a[i] ^ a[j])).count("1") <= 2]
    where = {int(x): k for k, x in enumerate(a)}
    want, got = components_of(200, pairs), components_of(200, [(where[x], where[y]) for x, y in links] + [(i, where[int(x)]) for i, x in enumerate(a)])
    assert want == got and len(links) < 400


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(3, 3)]
    got = {r.v: r.label for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lookup_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "SPLIT_ROWS", 10)
    left = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = common.written(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "t")
    out = common.lookup_join(left, right, ["k"], "n")
    assert out.columns == ["k", "x", "n"]
    assert sorted(r.x for r in out.collect()) == list(range(1000))
    assert out.filter("k = 0 and n = 400").count() == 400


def test_exact_duplicates_edges(spark):
    rows = [(1, "a"), (4, "a"), (2, None), (3, ""), (9, "A"), (9, "A"), (None, "n"), (None, "a"), (5, "x" * 200_000), (6, "x" * 200_000)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(1, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False), (2, 3, 2, False), (3, 3, 2, True), (9, 9, 2, True),
                   (None, None, 1, True), (5, 6, 2, False), (6, 6, 2, True)}
    assert exact.exact_duplicates(docs_of(spark, [])).count() == 0
    lower = exact.exact_duplicates(docs_of(spark, [(1, "A"), (2, "a")]), normalise=F.lower).collect()
    assert {r.keep_id for r in lower} == {2}


def test_extendible_index(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 400).alias("text"))
    index, slots, depth = exact.build_index(docs, capacity=16)
    rows = index.collect()
    assert len(rows) == 400 and sum(r.n for r in rows) == 500 and {r.chain for r in rows} == {1}
    loads = index.groupBy("bucket", "local_depth").count().collect()
    assert max(r["count"] for r in loads) <= 16 and len({r.local_depth for r in loads}) > 1
    assert index.groupBy("bucket").agg(F.countDistinct("local_depth").alias("d")).filter("d > 1").count() == 0
    assert depth == max(r.local_depth for r in loads) and slots.count() <= 1 << depth
    # the key range of a bucket: its slot's first local_depth bits
    for r in rows:
        slot = (r.key % (1 << 64)) >> (64 - depth)
        assert slot >> (depth - r.local_depth) == r.bucket >> (depth - r.local_depth)


def test_owners_take_ranges_of_buckets(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 400).alias("text"))
    index, _, _ = exact.build_index(docs, capacity=16)
    files = index.groupBy(F.input_file_name().alias("f")).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()
    spans = sorted((r.a, r.b) for r in files)
    assert len(spans) > 1 and all(b < a for (_, b), (a, _) in zip(spans, spans[1:]))


def test_rows_come_by_the_directory(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 150).alias("text"))
    index, slots, depth = exact.build_index(docs, capacity=16)
    assert exact.find(docs, (index, slots, depth)).count() == 200
    shifted = slots.withColumn("bucket", F.col("bucket") + 1)              # a wrong directory finds nothing
    assert exact.find(docs, (index, shifted, depth)).count() == 0
    some = slots.filter("slot > 0").count()                                # nor do documents of a slot it lacks
    assert some < slots.count() and 0 < exact.find(docs, (index, slots.filter("slot > 0"), depth)).count() < 200


def test_copies_are_folded_before_they_are_routed(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id") % 150)).alias("text"))
    plain = sorted(map(tuple, exact.exact_duplicates(docs).collect()))
    monkeypatch.setattr(exact, "FOLD_ROWS", 10)
    assert sorted(map(tuple, exact.exact_duplicates(docs).collect())) == plain
    assert {r[1:3] for r in plain if r[0] % 3 == 0} == {(297, 100)}


def test_chain_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.lit(1).cast("long"))      # every text collides
    docs = docs_of(spark, [(1, "a"), (2, "b"), (3, "a")])
    got = {(r.doc_id, r.keep_id) for r in exact.exact_duplicates(docs).collect()}
    assert got == {(1, 3), (3, 3), (2, 2)}
    index = exact.build_index(docs)
    assert sorted(r.chain for r in index[0].collect()) == [1, 2]
    assert {(r.doc_id, r.chain) for r in exact.find(docs, index).collect()} in ({(1, 1), (3, 1), (2, 2)}, {(1, 2), (3, 2), (2, 1)})


def brute_lines(rows):
    first, gone = {}, {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        x = t.split("\n")
        for p in range(len(x) - 2):
            w = tuple(x[p:p + 3])
            if not "".join(w).strip(" \t\r"):
                continue
            if w in first:
                gone.setdefault(i, set()).update((p, p + 1, p + 2))
            first.setdefault(w, i)
    return {(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ()))) for i, t in rows}


def test_line_dedup_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcde ") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a"), (103, "a\nb\n"), (104, "\n\n\n\n\n"), (105, "q\n" * 3000 + "end"), (106, "k\nl\nm"), (107, "k\nl\nm")]
    got = lines.line_report(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.text) for r in got} == brute_lines(rows)
    by = {r.doc_id: r for r in got}
    assert by[107].text == "" and by[107].n_removed == 3 and by[104].n_removed == 0 and by[105].n_lines == 3001
    assert by[100].n_lines is None


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_line_dedup_ties(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", limit)
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "a\nb\nc")]
    docs = docs_of(spark, rows).withColumn("n_chars", F.lit(-1))
    out = lines.line_dedup(docs)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), r.text, r.n_chars, r["_text"]) for r in out.collect())
    assert got == [("1", "a\nb\nc", 5, "w"), ("1", "a\nb\nc", 5, "w"), ("2", "d", 1, "w"), ("None", "", 0, "w")]
    assert lines.line_dedup(docs_of(spark, [])).count() == 0
