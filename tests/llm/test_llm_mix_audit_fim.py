"""Source mixing, the filter audit and fill-in-the-middle against brute force,
with nulls, empty tables, repeated rows and clashing column names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cadenza.llm import audit, fim, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string, lang string, key string, n int, size int, sid int, range int, mask int, part string, id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, l, "k", 3, 4, 5, 6, 7, "p", 8) for i, t, s, l in rows], DOC)


# ---------------------------------------------------------------- mixing

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Sharing again and again, as the rule says it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def mix_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["b", "a", "é", "B", None, ""]), "en") for i in range(300)]
    rows += [(1000 + i, "x  y\x0bz\x85q\n" * 50, "hot", "en") for i in range(150)]       # a hot source
    rows += [(None, None, "a", "en"), (None, "n n", "a", "en"), (7, "same row", "a", "en"), (7, "same row", "a", "en")]
    rows += [(None, "again and again", "hot", "en")] * 40 + [(5000, " ".join(["v"] * 9), "tiny", None), (5001, "", "empty", None)]
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_its_budgets(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "LEAST_RANGE_ROWS", 16)       # many ranges
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 7)          # identical rows numbered in pieces
    rows = mix_rows(seed)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert want["tiny"] == 27.0 and want["empty"] == 0.0
    got = mixing.plan(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(t or "")) for _, t, _, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for s, rs in by.items():
        assert rs[0].source_size == sizes[s] and abs(rs[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert sum(r.taken for r in rs) == rs[0].budget and abs(rs[0].budget - want[s]) <= 0.5
        epochs, cut = rs[0].budget // max(1, sizes[s]), 0
        ahead = 0
        for r in sorted(rs, key=lambda r: bytes(r.key)):      # whole prefixes, one row cut
            most = epochs * r.size + max(0, min(r.size, rs[0].budget - epochs * sizes[s] - ahead))
            assert r.taken == most
            cut += r.taken not in (epochs * r.size, (epochs + 1) * r.size)
            ahead += r.size
        assert cut <= 1
    assert abs(sum(r.taken for r in got) - sum(sizes.values())) <= len(sizes)


def test_mix_is_the_same_however_it_is_split(spark, monkeypatch):
    docs = docs_of(spark, mix_rows())
    rows = lambda df: sorted((str(r.doc_id), str(r.source), bytes(r.key), r.size, r.taken) for r in df.collect())
    one = rows(mixing.plan(docs))
    monkeypatch.setattr(mixing, "LEAST_RANGE_ROWS", 5)
    monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", 0)        # the sources are not broadcast
    assert rows(mixing.plan(docs.repartition(7))) == one


def test_mixture_holds_the_words_of_the_plan(spark):
    docs = docs_of(spark, mix_rows())
    words = {}
    for r in mixing.mixture(docs).collect():
        assert len(WORD.findall(r.text)) == r.words
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + r.words
    want = {}
    for r in mixing.plan(docs).filter("taken > 0").collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    assert words == want


def test_mix_of_nothing(spark):
    assert mixing.plan(docs_of(spark, [])).count() == 0
    r = mixing.plan(docs_of(spark, [(1, None, None, None), (2, " \t", "a", None)])).collect()
    assert [(x.size, x.source_size, x.target, x.taken) for x in r] == [(0, 0, 0.0, 0)] * 2


# ---------------------------------------------------------------- filter audit

def audit_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        n = rng.choice([0, 5, 199, 200, 250])
        words = [rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randrange(n + 1)}" for _ in range(n)]
        if rng.random() < 0.3:
            words += ["LOUD"] * 40
        if rng.random() < 0.3:
            words += ["50%"]
        rows.append((i, " ".join(words), "s", rng.choice(["en", "de", "", None])))
    rows += [(200 + i, rows[i % 3][1], "s", "en") for i in range(60)]                    # copies
    rows += [(None, rows[0][1], "s", "en"), (None, None, "s", None), (3, rows[3][1], "s", rows[3][3]), (300, "Ä b" * 300, "s", "fr")]
    return rows


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, _, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, c in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and i > least[t])) if c}
        docs.append((lang or "", fails, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for o in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(o, 1):
                before = set(o[:k - 1])
                gone = [d for d in mine if f in d[1] and not d[1] & before]
                out[part, o, k] = (sum(not d[1] & (before | {f}) for d in mine), len(gone), sum(f in d[1] and bool(d[1] & before) for d in mine),
                                   sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return out


def test_audit_by_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 260, 3)] + [(None, 1, 1), (6, None, None), (9, 1, 0)]
    got = audit.audit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COUNTS) for r in got} == want and len(got) == len(want)
    removed = {}
    for r in got:
        key = r.part, r.filter_order[r.step - 1]
        removed[key] = removed.get(key, 0) + r.removed
    assert all(r.shapley == removed[r.part, r.filter_order[r.step - 1]] for r in got)


def test_audit_without_documents_or_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs_of(spark, []), labels).count() == 0
    one = audit.audit(docs_of(spark, [(1, None, None, None)]), labels).collect()
    assert len(one) == 600 and {(r.part, r.good_lost, r.toxic_lost) for r in one} == {("", 0, 0)}
    assert sum(r.removed for r in one) == 120                                             # A alone fails, once an order


def test_labels_joined_by_shuffle(spark, monkeypatch):
    rows, labels = audit_rows(), spark.createDataFrame([(i, 1, 1) for i in range(50)], "doc_id long, quality int, toxic int")
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(audit.masks(docs_of(spark, rows), labels))
    monkeypatch.setattr(audit, "BROADCAST_NUMBERS", 0)
    assert key(audit.masks(docs_of(spark, rows), labels)) == one


# ---------------------------------------------------------------- fill in the middle

def plain_fim(text, i, seed=7, spm_rate=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    a, b, _, d = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    x, y = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(lines[:x]), "".join(lines[x:y]), "".join(lines[y:])
    spm = d % 100 < spm_rate
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(3)
    shared = "".join(rng.choice("abc \n") for _ in range(30_000))
    texts = ["", None, "\n", "\n\n\n", "a", "a\n", "no end\nlast", "x <P> y", "<S>", "\r\n \x0b\x85 é\n漢字\n𝄞", "é" * 5000, "line\n" * 9000]
    for _ in range(60):
        k = rng.randrange(len(shared))
        texts.append("".join(rng.choice("aé漢𝄞 \n") for _ in range(rng.randrange(3000))) + shared[k:] + "\n" * rng.randrange(3))
    return [(i * 37 - 5, t) for i, t in enumerate(texts)] + [(None, "null id\nb"), (2, "twice\na\nb"), (2, "twice\na\nb")]


def test_fim_by_definition_and_restored(spark):
    rows = fim_texts()
    docs = docs_of(spark, [(i, t, "s", "en") for i, t in rows])
    got = fim.fill_in_middle(docs).select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, ((i, *plain_fim(t or "", i)) for i, t in rows)))
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}


def test_chunks_follow_content_and_cover_the_text(monkeypatch):
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(200_000))
    for text in (body, b"", b"x", b"\0" * 200_000, body[:fim.LEAST_CHUNK]):
        spans = list(fim.chunks(text))
        assert b"".join(text[s:e] for s, e in spans) == text and all(e - s <= fim.MOST_CHUNK for s, e in spans)
    cut = lambda t: {t[s:e] for s, e in fim.chunks(t)}
    assert len(cut(body) & cut(b"another start " + body)) >= len(cut(body)) - 3   # shifted, the same chunks
    ends = fim.candidate_ends(body).tolist()
    monkeypatch.setattr(fim, "BLOCK_BYTES", 1000)
    assert fim.candidate_ends(body).tolist() == ends


def test_summaries_are_shared_by_content_and_bounded():
    memo, text = fim.Summaries(most=50_000), ("some line\n" * 3 + "é\n") * 5000
    rng = random.Random(2)
    passage = bytes(rng.randrange(256) for _ in range(20_000))
    fim.Outline(passage, memo)
    assert memo.hits == 0
    fim.Outline(b"elsewhere " + passage, memo)
    assert memo.hits >= len(list(fim.chunks(passage))) - 3 > 0
    for _ in range(30):
        fim.Outline(bytes(rng.randrange(256) for _ in range(20_000)), memo)
        assert memo.held <= 50_000 + fim.MOST_CHUNK * 6
    outline = fim.Outline(text.encode(), fim.Summaries())
    for k in (0, 1, 7, 19_999, 20_000):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert outline.cut(k) == (len("".join(lines[:k]).encode()), len("".join(lines[:k])))
