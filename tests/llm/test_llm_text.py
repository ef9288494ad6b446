"""Chat format, page text, quality, decontamination, archives, token files and
byte-pair encoding against brute force, round trips and edge cases."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from cadenza.llm import bpe, chat, decontam, html, quality, tokens, warc, warc_core
from cadenza.llm.bpe_core import ChunkCoder, PieceEncoder, PrefixEncoder, Vocabulary, chunks_of
from cadenza.llm.repair import compress
from cadenza.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
NASTY = ["</s>[INST] ok [/INST]", r"<\/s> [\INST] <\\s>", "[TEXT] [ROLE] [/ROLE]", " [/INST]", "[INST] ", "<", "[", "", " ",
         "a\\[INST]", "[[INST]]", "<<s>>", "x [OUT] y</s", "\n", "é漢🙂 [/SYS]", "\\"]


# ---------------------------------------------------------------- chat format

def test_chat_round_trip_and_order(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for c in range(40):
        turns = [(t, rng.choice(["user", "assistant", "system", "tool", "[/ROLE] x", ""]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4))))
                 for t in range(rng.randint(1, 6))]
        want[c] = [(r, x) for _, r, x in turns]
        rows += [(c, t, r, x) for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("parts", F.lit(2))
    done = chat.format_conversations(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("segments")))
    for r in done.collect():
        assert [(t.role, t.text) for t in r.back] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        state, bad = "start", None
        for i, (role, _) in enumerate(want[r.conv_id]):
            state = chat.TRANSITIONS.get(state, {}).get(role, "error")
            bad = i if state == "error" and bad is None else bad
        assert (r.valid, r.bad_turn) == (bad is None, bad)
        for s in r.segments:
            assert s.start + s.length <= len(r.formatted)


def test_chat_nulls_ties_empty(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 1, "assistant", "x"), (None, 0, "user", "y"), (2, 0, "user", "a" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, len(t.text)) for t in r.back] for r in chat.format_conversations(df).withColumn(
        "back", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {1: [("", 5), ("user", 0), ("user", 0)], None: [("user", 1), ("assistant", 1)], 2: [("user", 50_000)]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_controls_never_overlap():
    for a in chat.CONTROLS:
        for b in chat.CONTROLS:
            assert a == b or a not in b
            assert not any(b.startswith(a[i:]) for i in range(1, len(a)))


# ---------------------------------------------------------------- page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top">Site <b>name</b></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make the site better for all of you and us.</div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>The first   paragraph of the&nbsp;text with <b>bo</b>ld &lt;tags&gt; and "5 > 3".<br>Next line
<p>Short one.<aside>Related: the other article that you may like to read in the evening.</aside>
<form><p>Sign up for the letter of the week</p><input name=a><button>Go</button></form>
<!-- <p>hidden</p> --><p>Last of the article, with a stray < sign.</p></article>
<section id="comments"><p>I think that this is the best article of all that I have read.</p></section>
<aside><p>In the sidebar there is a text of some length that has many of the stop words.</p></aside>
<footer>&copy; all of the rights</footer></body></html>"""


def test_page_main_text():
    assert html.main_text(PAGE) == ('Title & more The first paragraph of the text with bold <tags> and "5 > 3". Next line Short one. '
                                    "Last of the article, with a stray < sign.")


def test_page_without_article_uses_two_passes():
    long = "It was the best of the times and it was the worst of them, for all that they had to say in the end. " * 3
    menu = "".join(f'<div><a href="/{i}">Section number {i} of this site</a></div>' for i in range(5))
    page = f"<body>{menu}<h2>A heading</h2><p>{long}</p><p>Short.</p><p>{long}</p><p>xkcd qwrt zzz plmk vbnm grtp lkjh mnbv poiu ytre wqas</p>{menu}</body>"
    want = " ".join(["A heading", " ".join(long.split()), "Short.", " ".join(long.split())])
    assert html.main_text(page) == want


#: Prose with few listed stop words, in listed and other languages and scripts.
PROSE = {
    "licence": "Redistributions in binary form must reproduce copyright notices, disclaimers, warranty limitations.",
    "german": "Verfahren Wärmebehandlung metallischer Werkstoffe unterscheiden Fachleute nach Temperatur, Dauer und Abkühlung.",
    "finnish": "Suomen kielen sanat taipuvat monissa sijamuodoissa, joten lyhyitä apusanoja tarvitaan varsin harvoin lauseissa.",
    "polish": "Rzeka płynie przez trzy województwa, zanim wpada do morza niedaleko starego portu rybackiego i latarni.",
    "russian": "Город расположен на берегу большой реки, недалеко от границы, и известен своими старинными мостами.",
    "chinese": "这座城市位于大河岸边，离边境不远，以古老的桥梁、市场和图书馆闻名，每年有许多游客前来参观。",
}


@pytest.mark.parametrize("name", PROSE)
@pytest.mark.parametrize("around", ["<nav><a href=x>Home</a></nav>", "<div><a href=x>Home of the site</a></div>"])
def test_page_without_article_keeps_prose(name, around):
    text = PROSE[name]
    page = f"<body>{around}<div><p>{text}</p><p>{text} 2</p><p>{text} 3</p></div>{around}</body>"
    assert html.main_text(page) == f"{text} {text} 2 {text} 3"


def test_page_in_known_language_drops_wordless_block_among_links():
    long = "It was the best of the times and it was the worst of them, for all that they had to say in the end."
    links = "<div><a href=x>Home</a></div>"
    code = "xkcd qwrt zzz plmk vbnm grtp lkjh mnbv poiu ytre wqas xkcd qwrt zzz plmk vbnm grtp lkjh mnbv"
    assert html.main_text(f"<p>{long}</p>{links}<p>{code}</p>{links}") == long
    assert html.main_text(f"<p>{long}</p><p>{code}</p>{links}") == f"{long} {code}"


def test_given_pages_lose_no_long_block_without_article(spark):
    import re
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").limit(60).collect():
        long = [b.text for b in html.blocks_of(row.html or "") if b.article and not b.bad and len(b.text) >= 70]
        text = html.main_text(re.sub(r"<(/?)article\b", r"<\1div", row.html or ""))
        assert all(b in text for b in long)
        assert text == html.main_text(row.html)


LONG = "It was the best of the times and it was the worst of them, for all that they had to say in the end."
AD = "<div class=ad>Buy the best of all of the things that we have for you and your family, now and in the end.</div>"


@pytest.mark.parametrize("inside, want", [
    (f"<p>{LONG}</p>{AD}<p>Short end.</p>", f"{LONG} Short end."),
    (f"<h1>Heading</h1>{AD}<p>{LONG}</p>", f"Heading {LONG}"),
    (f"<p>{LONG}</p><p>Uno.</p><p>Two.</p>{AD}<p>{LONG}</p>", f"{LONG} Uno. Two. {LONG}"),
    (f"<p>One.</p>{AD}<p>Two.</p>", "One. Two."),
])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_page_drops_only_the_advert(tag, inside, want):
    assert html.main_text(f"<body><nav><a href=x>Home</a></nav><{tag}>{inside}</{tag}><footer>x</footer></body>") == want


@pytest.mark.parametrize("around", [
    "<div class='layout with-sidebar'>", "<div id='page' class='no-comments'>", "<div class=has-ads>", "<div class='page page--has-footer'>",
    "<select name=a><option>x", "<object data=x>", "<svg viewBox='0 0 1 1'><path d=x>", "<noscript>", "<video src=x>",
    "<select><select></select>", "<svg/>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_page_is_not_lost_by_its_surroundings(around, tag):
    page = f"<body>{around}<{tag}><p>{LONG}</p><p>Short.</p>{AD}<p>{LONG} 2</p></{tag}></body>"
    assert html.main_text(page).endswith(f"{LONG} Short. {LONG} 2")


@pytest.mark.parametrize("around", ["<div class=sidebar-left>", "<div class=comments>", "<main><div class='social menu'>", "<div class=cookie><p>x</div><div class=ad>"])
def test_article_below_marked_ancestor_starts_clean(around):
    assert html.main_text(f"<body>{around}<article><p>{LONG}</p>{AD}<p>Short.</p></article></body>") == f"{LONG} Short."


def test_article_below_barred_ancestor_or_among_comments_stays_bad():
    article = f"<article><p>{LONG}</p></article>"
    for around in ("nav", "footer", "aside", "div role=navigation", "div hidden"):
        assert html.main_text(f"<{around}>{article}</{around.split()[0]}>") == ""
    assert html.main_text(f"{article}<div id=comments>{article}</div><div class=related>{article}</div>") == LONG
    assert html.main_text(f"<article>{AD}<div class=ad>{article}</div><p>{LONG} 2</p></article>") == f"{LONG} 2"


def test_raw_elements_of_a_page_are_dropped_in_linear_time():
    page = f"<p>{LONG}</p><svg><svg><text>a</text></svg><text>b</text></svg><select><option>c</select><video>d</video><p>{LONG}</p>"
    assert html.main_text(page) == f"{LONG} {LONG}"
    assert html.main_text(f"<p>{LONG}</p>" + "<svg>" * 50_000 + "<svg " * 50_000) == LONG


@pytest.mark.parametrize("page", ["", None, "plain", "<", "<p", "<p>a<", "<!--", "<script>", '<a href="x' * 2000, "<p>" * 3000, "</p></div>", "&#x41;&bogus;", "<div " + "'" * 999])
def test_page_broken_markup(page):
    assert isinstance(html.main_text(page), str)


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((str(r.page_id), str(r.url), r.n_chars == len(r.text), r.text == "") for r in got) == [
        ("1", "u", True, False), ("1", "u", True, False), ("None", "None", True, True)]
    assert html.extract(df.limit(0)).count() == 0


# ---------------------------------------------------------------- quality

def _quality_rows(n, seed):
    rng = random.Random(seed)
    syl = ["an", "the", "or", "in", "tion", "er", "ed", "st"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syl) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 60)])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_quality_held_out_accuracy(spark):
    docs, labels = _quality_rows(600, 3)
    docs += [(10_000, None), (10_001, ""), (None, "words of a text"), (10_002, "x" * 300_000), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.score(d, quality.train(d, lab)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r.score for r in rows}
    assert by[10_000] == by[10_001]


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(2, 1)], 1.0), ([(2, None)], 0.5)):
        lab = spark.createDataFrame(rows, "doc_id long, quality int")
        docs = d.union(spark.createDataFrame([(2, "b")], "doc_id long, text string"))
        assert {r.score for r in quality.score(docs, quality.train(docs, lab)).collect()} == {want}
    assert quality.score(d.limit(0), 0.5).count() == 0


def test_machine_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, x = np.array([0, 3, 4, 8]), np.array([1.0, -2.0, 0.5, 3.0])
    z = m.intercept + m.linear[index] @ x + sum(m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert abs(m.score(index, x) - 1 / (1 + np.exp(-z))) < 1e-12


# ---------------------------------------------------------------- decontamination

def _brute_leaks(docs, bench):
    import regex

    cut = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    out = set()
    for i, t in docs:
        d = cut(t)
        for j, b in bench:
            w = cut(b)
            if len(w) < 5:
                continue
            for g in range(-len(w) + 1, len(d)):
                same = [0 <= g + k < len(d) and d[g + k] == w[k] for k in range(len(w))]
                if (max(sum(same[k:k + 13]) for k in range(max(1, len(w) - 12))) >= 11) if len(w) >= 13 else sum(same) >= len(w) - len(w) // 5:
                    out.add((i, j))
    return out


def test_leaks_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of"] * 10
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    bench = [(j, " ".join(say(n))) for j, n in enumerate([13, 14, 20, 40, 8, 5, 12, 10, 4, 1, 0, 30])] + [(50, None)]
    docs = []
    for i in range(60):
        words = say(rng.randint(0, 60))
        _, item = rng.choice(bench[:-1])
        passage = item.split()
        for _ in range(rng.randint(0, 4)):
            if passage:
                passage[rng.randrange(len(passage))] = rng.choice(vocab)
        at = rng.randint(0, len(words))
        docs.append((i, ", ".join(words[:at] + [p.upper() for p in passage[rng.choice([0, 0, 3]):]] + words[at:])))
    docs += [(100, None), (101, ""), (None, bench[3][1]), (7, docs[7][1]), (102, " ".join(say(20_000)) + " " + bench[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(bench, "item_id long, text string")
    found = decontam.leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == _brute_leaks(docs, bench)
    assert (102, 3) in {(r.doc_id, r.item_id) for r in found.collect()}
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {i for i, _ in _brute_leaks(docs, bench)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


def test_leaks_shuffled_joins_agree(spark, monkeypatch):
    bench = [(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n")]
    docs = [(i, f"x{i} a b c d e f g h i j Q l m n") for i in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(map(tuple, decontam.leaks(d, b).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_ITEM_WORDS", 0)
    assert sorted(map(tuple, decontam.leaks(d, b).collect())) == want and len(want) == 40


def test_solid_seeds_are_those_of_short_items_alone(spark):
    say = lambda n: " ".join(f"w{i}" for i in range(n))
    items = spark.createDataFrame([(1, 1, 5, say(5)), (2, 2, 12, say(12)), (3, 3, 40, say(40))], "item_id long, ih long, n int, text string")
    seeds = decontam._item_seeds(items, [2, 4], True).collect()
    assert sorted((r.item_id, r.q) for r in seeds if r.item_id < 3) == [(1, 0), (1, 2), (2, 0), (2, 4), (2, 8)]
    assert sum(r.item_id == 3 for r in seeds) == 2 * (40 - decontam.SPAN + 1)


def test_hits_of_a_document_are_dealt_over_bounded_lists(spark, monkeypatch):
    bench = [(j, f"of the w{j} x{j} y{j}") for j in range(30)] + [(50, " ".join(f"v{i}" for i in range(30)))]
    docs = [(1, " ".join("of the" for _ in range(100)) + " " + bench[3][1] + " " + bench[-1][1]), (2, bench[4][1]), (None, bench[5][1]),
            (3, "the w6 x6 y6 " + "z " * 50), (4, " ".join(bench[-1][1].split()[10:]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    sizes, listed = [], decontam._listed
    monkeypatch.setattr(decontam, "_listed", lambda *a: sizes.append(listed(*a).select(F.size("hits").alias("n")).collect()) or listed(*a))
    for row_words in (1 << 16, 500):
        monkeypatch.setattr(decontam, "ROW_WORDS", row_words)
        assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()} == _brute_leaks(docs, bench)
    whole, dealt = ([r.n for r in s] for s in sizes)
    assert sum(whole) == sum(dealt) and max(whole) > 3000 and max(dealt) < 200


def test_items_in_scripts_without_spaces_are_searched(spark):
    bench = [(1, "这座城市位于大河岸边，离边境不远"), (2, "東京は日本の首都です。"), (3, "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย"), (4, "one two three")]
    docs = [(i, f"before it {t.rstrip('。')} after it") for i, t in bench] + [(5, "这座城市位于小河岸边，离边境不远"), (6, "城市"), (7, "words of another language only")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()) == [(1, 1), (2, 2), (3, 3), (5, 1)]
    assert decontam.unsearched(b) == 1


def test_masks_cover_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(not {a, b} & {o + p for p in mask} for mask in decontam.MASKS for o in range(13 - decontam.SPAN + 1)), (a, b)


# ---------------------------------------------------------------- web archives

def _records(n=6):
    out = []
    for i in range(n):
        p = f"<p>page {i}</p>".encode() * (5 + 400 * i)
        out.append(warc_core.page_record(i, f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None))
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_after_damage(packed):
    parts = [warc_core.member(r) if packed else r for r in _records()]
    data = bytearray(b"".join(parts))
    start = len(parts[0]) + len(parts[1])
    data[start + 40:start + 60] = bytes(20)                       # breaks record 2
    data[len(data):] = b"\x1f\x8b\x08garbage at the end"
    data[0:0] = b"junk before"
    got = list(warc_core.salvage(bytes(data)))
    ids = [warc_core.page_of(r.headers["warc-record-id"]) for r in got if isinstance(r, warc_core.Record)]
    gaps = [(g.start, g.end) for g in got if isinstance(g, warc_core.Gap)]
    assert ids == [0, 1, 3, 4, 5]
    assert gaps == [(0, 11), (11 + start, 11 + start + len(parts[2])), (11 + len(b"".join(parts)), len(data))]
    assert [x.start for x in got][1:] == [x.end for x in got][:-1] and got[-1].end == len(data)


def test_salvage_edges():
    assert list(warc_core.salvage(b"")) == []
    cut = warc_core.member(_records()[3])[:-9]
    assert [(g.start, g.end) for g in warc_core.salvage(cut)] == [(0, len(cut))]
    inner = b"WARC/1.1\r\n" + b"x" * 50                            # a payload that looks like a record
    r = warc_core.page_record(1, None, inner, hashlib.sha256(inner).hexdigest(), None)
    assert [warc_core.payload_of(x) for x in warc_core.salvage(r + r)] == [inner, inner]


def test_archives_round_trip(spark):
    body = "<p>" + "same " * 50
    rows = [(5, "http://a/é b\n%41", body), (3, " x ", body), (9, "u", body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, None, ""),
            (7, "u", "漢" * 40), (8, "u", "漢" * 40), (None, "n", body), (10, "z", "q" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder, roll_bytes=200)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    got = {r.page_id: r for r in warc.read_archives(spark, manifest, folder).collect()}
    assert {k: r.refers_to for k, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3, None: 3, 8: 7}
    for i, url, text in rows:
        data = (text or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(data), hashlib.sha256(data).hexdigest(), url)
        assert got[i].payload == (None if got[i].record_type == "revisit" else data)
    assert warc.quarantined(spark, manifest, folder).count() == 0
    # damage one file: its other records are still read and the gap is logged
    one = manifest.orderBy("file").first().file
    path = folder.removeprefix("file:").replace("//", "/") + "/" + one
    with open(path, "rb") as f:
        raw = f.read()
    gzip.decompress(raw)                                          # a valid gzip file for any reader
    with open(path, "wb") as f:
        f.write(b"noise" + raw)
    gaps = warc.quarantined(spark, manifest, folder).collect()
    assert [(g.file, g.start, g.end) for g in gaps] == [(one, 0, 5)]
    assert warc.read_archives(spark, manifest, folder).count() == len(rows)


def test_archives_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    assert manifest.count() == 0 and warc.read_archives(spark, manifest, folder).count() == 0


# ---------------------------------------------------------------- grammars

@pytest.mark.parametrize("min_count", [2, 16])
def test_grammar_leaves_no_frequent_pair(min_count):
    from cadenza.llm import repair

    rng = np.random.default_rng(3)
    noise = rng.integers(0, 50_000, 60_000)
    for i in range(20):                       # a few pairs of 16 or more places among 60,000
        noise[rng.choice(29_000, 20, replace=False) * 2] = 100 + i
    at = np.flatnonzero((noise >= 100) & (noise < 120))
    noise[at[at < len(noise) - 1] + 1] = 7
    for ids in (noise, np.zeros(1000, int), np.arange(5), np.array([], int)):
        g = repair.compress(ids.astype(np.uint32), 50_000, min_count)
        assert g.decode().tolist() == ids.tolist()
        codes = g.sequence[:-1].astype(np.uint64) << np.uint64(32) | g.sequence[1:]
        assert not len(codes) or np.unique(codes, return_counts=True)[1].max() < min_count


# ---------------------------------------------------------------- byte pairs

def _texts(seed=8, n=400):
    rng = random.Random(seed)
    al = "aab cde the of  \n\t.,'s'll1٣é漢🙂  ²ſ"
    return ["", " ", "\n", "  a", "a  ", " \n a", "it's we'll", "x" * 3000, " " * 500, "<|endoftext|>", "á b"] + [
        "".join(rng.choice(al) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_library(spark):
    vocab = Vocabulary.read(RANKS)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    texts = _texts()
    docs = spark.createDataFrame([*enumerate(texts), (None, "null id"), (9_000, None), (3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = "null id" if r.doc_id is None else "" if r.doc_id == 9_000 else texts[r.doc_id]
        ids = enc.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert all(bytes(r.bytes).decode() == texts[r.doc_id] for r in back if r.doc_id is not None and r.doc_id < 9_000)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_encoder_appends_and_edits():
    vocab = Vocabulary.read(RANKS)
    enc = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=vocab.ranks, special_tokens={})
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("thereanioustgd") for _ in range(n))
    one = PrefixEncoder(vocab)
    text = ""
    for _ in range(12):
        more = word(rng.randint(1, 40))
        text += more
        one.append(more.encode())
        assert one.ids() == enc.encode_ordinary(text)
    for _ in range(12):
        a = rng.randrange(len(text))
        b = min(len(text), a + rng.randint(0, 5))
        new = word(rng.randint(0, 6))
        text = text[:a] + new + text[b:]
        one.replace(a, b, new.encode())
        assert one.ids() == enc.encode_ordinary(text)
    long = PrefixEncoder(vocab, word(3000).encode())
    done = long.replace(1000, 1002, b"zz")
    assert done < 1500 and long.ids() == enc.encode_ordinary(long.data.decode())


def test_chunks_are_safe_cuts():
    vocab = Vocabulary.read(RANKS)
    whole = PieceEncoder(vocab, public_tokenizers.PATTERN)
    for t in _texts(9, 300):
        cut = chunks_of(t)
        assert "".join(cut) == t
        assert b"".join(whole.encode(c) for c in cut) == whole.encode(t), repr(t)
    small = ChunkCoder(whole.encode_all, limit=3)
    assert [small.encode([t])[0] for t in _texts()] == [whole.encode(t) for t in _texts()]


# ---------------------------------------------------------------- token files

@pytest.mark.parametrize("n,kinds,count", [(0, 5, 4), (1, 5, 4), (5000, 3, 4), (20_000, 40, 4), (3000, 1, 2), (4000, 4000, 2)])
def test_repair_round_trip_and_ranges(n, kinds, count):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    g = compress(ids, 50_000, min_count=count)
    assert np.array_equal(g.decode(), ids)
    assert len(g.sequence) <= n and (n < 1000 or kinds > 100 or len(g.sequence) < n / 1.5)
    assert int(g.symbol_lengths(g.sequence).sum()) == n
    for _ in range(30):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(g.decode(a, b), ids[a:b])


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    texts = _texts(10, 120)
    rows = [(i * 7 % 131 + (i > 130) * 1000 + i, t) for i, t in enumerate(texts)] + [(None, "null"), (90_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    folder = scratch_path(spark, "token-test")
    tokens.write_token_files(docs.repartition(5), folder, path, 2, shards=3, block_ids=500)
    at = 0
    got = {r.doc_id: r for r in tokens.document_starts(spark, folder).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    every = []
    for i, t in order:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), (i, t)
        at += len(ids)
        every += ids
    read = tokens.read_token_files(spark, folder).orderBy("shard", "block", "place").collect()
    assert [x for r in read for x in np.frombuffer(r.ids, "<u4").tolist()] == every
    wanted = [(r.shard, r.block, r.before, r.before + r.n_tokens) for r in read[::9]]
    some = tokens.read_range(spark, folder, spark.createDataFrame(wanted, "shard int, block int, start long, stop long")).collect()
    by = {(r.shard, r.block, r.start): bytes(r.ids) for r in some}
    assert all(by[r.shard, r.block, r.before] == bytes(r.ids) for r in read[::9])


def test_token_files_empty_and_other_tokenizers(spark):
    folder = scratch_path(spark, "token-test")
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert tokens.document_starts(spark, folder).count() == 0
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")            # lower-cases: whole texts are encoded
    lib = Tokenizer.from_file(path)
    folder = scratch_path(spark, "token-test")
    tokens.write_token_files(spark.createDataFrame([(1, "Hello  World")], "doc_id long, text string"), folder, path, 7)
    ids = np.frombuffer(tokens.read_token_files(spark, folder).first().ids, "<u4").tolist()
    assert ids == [*lib.encode("Hello  World", add_special_tokens=False).ids, 7]
