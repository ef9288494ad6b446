"""Duplicates told by row, and pages whose markup is left open."""

from __future__ import annotations

import re
import time

import pytest

from cadenza.llm import exact, html, simhash
from cadenza.llm.bpe_core import PrefixEncoder, Vocabulary
from cadenza.llm.common import table

PAGES = "/root/testdata/sf0.01"
LONG = "the work of others is in the book and it is long enough to be read by all of us, as it was before. " * 2


def test_another_text_under_a_dropped_id_stays(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t, "a"), (5, t, "b"), (5, "quite another text with other words in it altogether", "c"), (None, t, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.th for r in kept.collect()) == ["a", "c", "d"]
    docs = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (1, "clean", "c"), (None, "x", "d"), (3, None, "e"), (4, "", "f")],
                                 "doc_id long, text string, key string")
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.key for r in kept.collect()) == ["b", "c", "f"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [r.html or "" for r in table(spark, PAGES, "pages").select("html").collect()]
    return [(x, html.main_text(x)) for x in rows]


@pytest.mark.parametrize("change", [
    lambda x: x.replace("</head>", ""),
    lambda x: x.replace("</nav>", ""),
    lambda x: x.replace("</aside>", "").replace("</button>", ""),
    lambda x: re.sub("(<body[^>]*>)", r"\1<form id='all'>", x).replace("</body>", "</form></body>"),
    lambda x: re.sub("(<body[^>]*>)", r"\1<button>open", x),
    lambda x: re.sub("(<body[^>]*>)", r"\1<a name=top>", x),
    lambda x: re.sub("(<body[^>]*>)", r"\1<a href=top>", x)])
def test_pages_left_open_keep_their_text(pages, change):
    assert all(html.main_text(change(x)) == text for x, text in pages)


@pytest.mark.parametrize("page,text", [
    (f"<head><title>t</title><p>{LONG}</p>", LONG), (f"<head>{LONG}", LONG),
    (f"<nav><a href=x>Menu</a><ul><li>Home<p>{LONG}</p>", LONG),
    (f"<form><p>{LONG}</p><input></form>", LONG),
    (f"<p>{LONG}</p><form><p>Your name</p></form>", LONG),
    (f"<article><p>{LONG}</p><form><p>Write a comment, it is the place for all that you have to say to us</p></form></article>", LONG),
    (f"<div id='related-work'><p>{LONG}</p></div>", LONG), (f"<p>{LONG}</p><div id='related-posts'><p>{LONG}</p></div>", LONG),
    (f"<article><p>{LONG}<span class='advert'>BUY <b>now</b></span></p></article>", LONG),
    (f"<nav><ul><li>Home</ul></nav><p>{LONG}</p>", LONG), (f"<nav>Home<article><p>{LONG}</p></article>", LONG)])
def test_open_containers_end(page, text):
    assert html.main_text(page) == " ".join(text.split())


def test_deep_nesting_is_linear():
    def seconds(page):
        t = time.process_time()
        html.main_text(page)
        return time.process_time() - t
    for open_, shut in (("<div>", "</b>"), ("<nav><p>x", ""), ("<nav>", "<p>x"), ("<form><article>", "</form>")):
        assert seconds(open_ * 50_000 + "text" + shut * 50_000) < 5


def _plain_blocks(page):
    """The rules without any tree: pages of flat paragraphs."""
    known = html._stop_share(" ".join(t for t in page if len(t) >= html.LENGTH_LOW)) >= html.STOP_PAGE
    first = []
    for t in page:
        share = html._stop_share(t)
        first.append(None if len(t) < html.LENGTH_LOW else True if not known or len(t) > html.LENGTH_HIGH or share >= html.STOP_LOW else None)
    out = []
    for i, label in enumerate(first):
        before = max((j for j in range(i) if first[j] is not None), default=None)
        after = min((j for j in range(i + 1, len(page)) if first[j] is not None), default=None)
        near = [j for j in (before, after) if j is not None]
        out.append(label if label is not None else True if not near or all(first[j] for j in near) else False)
    return " ".join(t for t, good in zip(page, out) if good)


def test_two_passes_by_brute_force():
    import random

    rng = random.Random(4)
    stop = sorted(html.STOP_WORDS["en"])
    for _ in range(200):
        page = [" ".join(rng.choice(stop) if rng.random() < p else f"zq{rng.randrange(99)}" for _ in range(rng.randint(1, 60)))
                for p in (rng.choice((0, 0.05, 0.4)) for _ in range(rng.randint(1, 9)))]
        assert html.main_text("".join(f"<p>{t}</p>" for t in page)) == _plain_blocks(page)


def test_last_tokens_of_prefixes_equal_the_merges():
    vocab = Vocabulary({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"xyzzy": 259, b"xy": 260, b"zz": 261, b"xyzz": 262})
    for data in (b"abababa", b"xyzzyab", b"a", b"", b"zzxyzz"):
        assert [vocab.tokens[i] for i in PrefixEncoder(vocab, data).ids()] == vocab.merge(data)
