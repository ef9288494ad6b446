"""Main text of web pages by two-pass block rules (per-page helper plus the
operator).

A page is cut into blocks at block-level tags.  First pass: a block inside a
container that is never main text (menu, header, footer, sidebar, notice,
advert, form, comments) is bad, a block of an article or main element is good
if it is long or has stop words, and any other block is judged by the share of
its characters that are links, its length and its density of stop words (which
says nothing on a page in a language without a list): linked ones are bad, long
ones good or undecided.  Second pass: the undecided blocks take the label of
the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches

#: Function words by language, with the pieces that apostrophes leave.
STOP_WORDS = {
    "en": """a about above after again against all also although always am among an and another any are aren around as at away
back be became because become been before being below between both but by can cannot could couldn d did didn do does doesn
doing don done down during each either else enough even ever every few first for from further get had hadn has hasn have
haven having he hence her here hers herself him himself his how however i if in indeed instead into is isn it its itself
just last least less let like ll m made make many may me might mine more moreover most much must my myself near need neither
never no nor not nothing now of off often on once one only onto or other others otherwise our ours ourselves out over own
per perhaps quite rather re s same shall she should shouldn since so some something still such t than that the their
theirs them themselves then there therefore these they this those though through throughout thus to together too toward
towards two under unless until up upon us ve very via was wasn we well were weren what whatever when where whereas whether
which while who whoever whole whom whose why will with within without won would wouldn yet you your yours yourself
yourselves""",
    "fr": """a à afin ai ainsi alors après as au aucun aucune aujourd aura aurait aussi autant autre autres aux avaient avait
avant avec avoir avons ayant beaucoup bien c ça car ce ceci cela celle celles celui cependant ces cet cette ceux chaque
chez ci comme comment contre d dans de déjà depuis dernier des dès deux devant doit doivent donc dont du durant elle elles
en encore enfin entre es est et étaient était étant été être eu eux fait faire fois font hors hui ici il ils j jamais je
jusqu jusque l la là laquelle le lequel les lesquelles lesquels leur leurs lors lorsqu lorsque lui m ma mais malgré me même
mêmes mes mieux moi moins mon n ne ni non nos notre nous on ont ou où par parce parfois parmi pas pendant personne peu peut
peuvent plus plusieurs plutôt pour pourquoi pourtant près presque puis puisque qu quand que quel quelle quelles quelque
quelques quels qui quoi rien s sa sans se selon sera serait seront ses seulement si sien soi soit son sont sous souvent
suis sur surtout t ta tandis te tel telle telles tels tes toi ton toujours tous tout toute toutes très trop tu un une vers
voici voilà vos votre vous vu y""",
    "de": """ab aber allein alle allem allen aller alles als also am an andere anderem anderen anderer anderes auch auf aus
außer außerdem bald bei beide beiden beim bereits bevor bin bis bisher bist da dabei dadurch dafür dagegen daher damals
damit danach dann daran darauf daraus darf darin darüber darum das dass daß dazu dein deine dem den denen denn dennoch der
deren des deshalb dessen die dies diese diesem diesen dieser dieses doch dort du durch dürfen ebenfalls ebenso ein eine
einem einen einer eines einige einigen einmal er erst es etwa etwas euch euer für ganz gar gegen gegenüber genau gewesen
hab habe haben hat hatte hatten hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer ihres im immer in indem ins
ist ja je jede jedem jeden jeder jedes jedoch jene jenen jener jetzt kann kein keine keinem keinen keiner können konnte
könnte man manche mehr mein meine mich mir mit muss müssen musste nach nachdem neben nein nicht nichts noch nun nur ob
obwohl oder ohne schon sehr sei sein seine seinem seinen seiner seit selbst sich sie sind so sobald sodass sogar solche
soll sollen sollte sondern sonst soweit sowie statt über um und uns unser unsere unter viel viele vielen vom von vor
während war waren warum was weder weil weiter welche welchem welchen welcher welches wenig wenn wer werde werden wie
wieder will wir wird wo wollen worden wurde wurden würde würden zu zum zur zwar zwei zwischen""",
    "es": """a acerca además ahí ahora al algo alguna algunas alguno algunos allá allí ambos ante antes aquel aquella aquellas
aquellos aquí así aún aunque bajo bien cada casi como cómo con contra cual cuál cuales cualquier cuando cuándo cuanto cuya
cuyo da de debe deben del demás dentro desde después donde dónde dos durante e el él ella ellas ello ellos en entonces
entre era eran eres es esa esas ese eso esos esta está estaba estado están estar estas este esto estos fin fue fueron fuera
ha había habían hace hacer hacia han hasta hay he hizo hoy incluso la las le les lo los luego más me mediante menos mi mí
mientras mis misma mismas mismo mismos mucha muchas mucho muchos muy nada ni ningún ninguna no nos nosotros nuestra nuestras
nuestro nuestros nunca o os otra otras otro otros para pero poco pocos por porque pueden puede pues que qué quien quién
quienes se sea sean según ser será si sí sido siempre sin sino sobre sola solo sólo son su sus tal tales también tampoco
tan tanto te tenía tener ti tiene tienen toda todas todavía todo todos tras tu tú tus un una unas uno unos usted ustedes va
y ya yo""",
}
STOP_WORDS = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}
#: First-pass thresholds: characters of a short and of a long block, share of
#: stop words in the best language (measured on prose, see README) of a block
#: and of a page's long blocks together, share of linked characters.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_PAGE = 0.08, 0.20
LINKS_MAX = 0.20
#: Characters of scripts without spaces say as much as so many others.
DENSE = 3

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
optgroup option p pre section summary table tbody td tfoot th thead title tr ul""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Contents that are no text of the page.  Only those of RUN_ON go on to the
#: page's end if the element is never closed; of others the tag alone is dropped.
RAW_TAGS = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas", "audio", "video", "select"))
RUN_ON = frozenset(("script", "style", "textarea", "title"))
#: Containers that never hold main text, by tag, role, class or id word.
BAD_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "button", "head"))
#: Of these only the inline ones with such a class or id are skipped whole.
AD_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
BAD_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"))
BAD_WORDS = frozenset("""ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice
popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies share
sharing social related newsletter subscribe subscription login signup search pagination skip toolbar""".split())
#: Words of containers whose own items often are article elements.
ITEM_WORDS = frozenset("comment comments disqus reply replies related".split())
#: ``with-sidebar`` and ``no-comments`` tell of a layout, not of a container.
LAYOUT_PARTS = frozenset("with without no not non has have hide hides".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: What may stand in a page's head; anything else ends it.
HEAD_CONTENT = frozenset("base link meta noscript script style template title object".split())
#: A barred element that is never closed ends where one of these begins.
SECTION_STARTS = frozenset("article main section header footer h1 p table blockquote pre figure".split())
#: ``related-work`` is a chapter, not a list of links.
NOT_ITEMS = frozenset("work works research literature concepts topics".split())
#: How an element is bad: not, by its class or id (an article element below
#: starts clean), by one of ITEM_WORDS (an article element below does so if the
#: page has no other), by tag, role or ``hidden`` (all below is bad).
CLEAN, MARKED, ITEMS, BARRED = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_NAME_PART = re.compile(r"[_\-]+")


@dataclass
class Block:
    tag: str
    bad: bool
    article: int                      # number of the enclosing article element, 0: none
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    spare: bool = False               # of an article element below ITEM_WORDS, bad if the page has another
    form: int = 0                     # number of the enclosing form, 0: none

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _named(value: str) -> int:
    """MARKED or ITEMS if a class or id value names a bad container."""
    found = set()
    for name in value.split():
        parts = _NAME_PART.split(name)
        layout = next((i for i, part in enumerate(parts) if part in LAYOUT_PARTS), len(parts))
        found.update(w for w, after in zip(parts[:layout], [*parts[1:], ""]) if w in BAD_WORDS and not (
            w == "related" and after in NOT_ITEMS))
    return CLEAN if not found else MARKED if found.isdisjoint(ITEM_WORDS) else ITEMS


def _is_advert(attributes: str) -> bool:
    """Of an inline element: does its class or id name an advert?"""
    return any(name.lower() in ("class", "id") and any(AD_WORDS.intersection(_NAME_PART.split(x)) for x in (a or b or c).lower().split())
               for name, a, b, c in _ATTRIBUTE.findall(attributes))


def _bad_container(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "form":                                  # judged when the page is read
        return CLEAN
    if tag in BAD_TAGS or (tag == "header" and not in_article):
        return BARRED
    if not attributes.strip() or tag in ("html", "body", *ARTICLE_TAGS):
        return CLEAN
    bad = CLEAN
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or (name == "role" and value in BAD_ROLES):
            return BARRED
        if name in ("class", "id"):
            bad = max(bad, _named(value))
    return bad


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element ``tag`` that is closed starts, and where it ends."""
    ends, opened = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^<>]*>?", page, re.I):
        if m[1]:
            if opened:
                ends[opened.pop()] = m.end()
        elif not m[0].endswith("/>"):
            opened.append(m.start())
    return ends


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; spare ones are clean if no other block
    is in an article element.  A form is a container of its own kind: it is
    bad unless an article element begins in it, or most of the text of the
    page's long blocks stands in it."""
    out, with_article = _blocks(page)
    long = [(b.form, len(b.text)) for b in out if _is_long(b)]
    total, of_form = sum(n for _, n in long), Counter()
    for f, n in long:
        of_form[f] += n
    for b in out:
        if b.form and b.form not in with_article and 2 * of_form[b.form] <= total:
            b.bad, b.spare = True, False
    spare = [b for b in out if b.spare]
    if spare and not any(b.article and not b.bad for b in out):
        for b in spare:
            b.bad = False
    return out


@dataclass
class _Open:
    """An open element: how bad it is itself, and with those it stands in."""

    tag: str
    own: int
    bad: int
    article: int
    spare: bool
    form: int


def _blocks(page: str) -> tuple[list[Block], set[int]]:
    """Blocks, and the numbers of the forms that an article element begins in."""
    out: list[Block] = []
    stack: list[_Open] = []
    count: Counter[str] = Counter()                    # open elements by tag
    endless: list[int] = []                            # places on the stack of barred elements that are never closed
    with_article: set[int] = set()
    ends: dict[str, dict[int, int]] = {}
    articles, forms, links, at, n = 0, 0, False, 0, len(page)
    block = Block("", False, 0)

    def flush(tag: str) -> None:
        nonlocal block
        if block.parts and block.text:
            out.append(block)
        if stack:
            top = stack[-1]
            block = Block(tag, bool(top.bad) or top.spare, top.article, spare=top.spare and not top.bad, form=top.form)
        else:
            block = Block(tag, False, 0)

    def end_of(tag: str, start: int) -> int | None:
        if tag not in ends:
            ends[tag] = _ends(page, tag)
        return ends[tag].get(start)

    def close(tag: str) -> None:
        while True:
            top = stack.pop()
            count[top.tag] -= 1
            if top.tag == tag:
                break
        while endless and endless[-1] >= len(stack):
            endless.pop()

    def end_the_endless() -> None:
        """The barred elements that are open and never closed end here; those
        that began in them stay, without their mark."""
        above = stack[endless[0] - 1].bad if endless[0] else CLEAN
        for i in endless:
            stack[i].own = CLEAN
        for x in stack[endless[0]:]:
            above = x.bad = max(CLEAN if x.tag in ARTICLE_TAGS and above != BARRED else above, x.own)
        endless.clear()

    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:                                  # an open tag without end: the rest is markup
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if piece == "<" and (re.match(r"/?[a-zA-Z!?]", page[at:at + 2])):
                    break                              # a tag that the page's end cuts off
                if stack and stack[-1].tag == "head" and not piece.isspace():
                    close("head")
                    flush("")
                text = html.unescape(piece)
                block.parts.append(text)
                if links:
                    block.linked += len(text.strip())
            continue
        tag, closing = tag.lower(), bool(m[1])
        if count["head"] and not closing and tag not in HEAD_CONTENT and tag != "head":
            close("head")
            flush("")
        if tag in RAW_TAGS and not closing:
            if tag in RUN_ON:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else n
            else:
                at = max(at, end_of(tag, m.start()) or at)
            block.parts.append(" ")
            continue
        if tag == "a":                                 # an anchor without target, or never closed, is no link
            links = not closing and "href" in m[3].lower() and end_of(tag, m.start()) is not None
        if endless and not closing and tag in SECTION_STARTS:
            end_the_endless()
            flush("")
        if tag == "br":
            block.parts.append("\n")
        elif closing:
            if count[tag]:
                close(tag)
                flush("")
            elif tag in BLOCK_TAGS:
                flush("")
        elif tag not in VOID_TAGS and (tag in BLOCK_TAGS or tag in BAD_TAGS) and tag != "p":
            above = stack[-1] if stack else _Open("", CLEAN, CLEAN, 0, False, 0)
            bad, article, spare, form = above.bad, above.article, above.spare, above.form
            if tag in ARTICLE_TAGS and not count["article"]:
                if not article:
                    articles += 1
                    article = articles
                if form:
                    with_article.add(form)
                if bad in (MARKED, ITEMS):
                    bad, spare = CLEAN, spare or bad == ITEMS
            if tag == "form":
                forms += 1
                form = form or forms
            own = _bad_container(tag, m[3], bool(article))
            if own == BARRED and tag in BAD_TAGS and tag != "head" and end_of(tag, m.start()) is None:
                endless.append(len(stack))
            stack.append(_Open(tag, own, max(bad, own), article, spare, form))
            count[tag] += 1
            flush(tag)
        elif tag in BLOCK_TAGS:
            flush(tag)
            if tag == "p" and m[3].strip() and _bad_container(tag, m[3], bool(block.article)):
                block.bad, block.spare = True, False
        elif m[3].strip() and tag not in VOID_TAGS and tag != "a" and _is_advert(m[3]):
            at = max(at, end_of(tag, m.start()) or at)
    flush("")
    return out, with_article


def _stop_share(text: str) -> float:
    """Share of the words that are stop words of the language with the most."""
    words = _WORD.findall(text.lower())
    return max(sum(w in stop for w in words) for stop in STOP_WORDS.values()) / len(words) if words else 0.0


def _length(text: str) -> int:
    return len(text) + (0 if text.isascii() else (DENSE - 1) * len(_DENSE.findall(text)))


def _is_long(b: Block) -> bool:
    """Outside bad containers, long and hardly linked: text unless all around
    it is not."""
    text = b.text
    return not b.bad and _length(text) >= LENGTH_LOW and b.linked <= LINKS_MAX * len(text)


def knows_language(blocks: list[Block]) -> bool:
    """Do the long blocks of the page, taken together, have stop words as prose
    of a listed language has?  If not, stop words tell nothing about it."""
    return _stop_share(" ".join(b.text for b in blocks if _is_long(b))) >= STOP_PAGE


def first_pass(b: Block, known: bool = True) -> bool | None:
    """True: main text, False: not, None: undecided.  ``known``: the page is in
    a listed language."""
    if b.bad:
        return False
    text = b.text
    if b.article:
        return True if _length(text) >= LENGTH_LOW or _stop_share(text) >= STOP_LOW else None
    if b.linked > LINKS_MAX * len(text):
        return False
    if _length(text) < LENGTH_LOW:
        return None
    return True if not known or _length(text) > LENGTH_HIGH or _stop_share(text) >= STOP_LOW else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the nearest decided neighbour's label: blocks of bad
    containers are no neighbours, inside an article only its own blocks count,
    and without any it is main text; of two at one distance that differ a
    heading takes the one after, others are bad.  A long block is bad only if
    its decided neighbours on both sides are."""
    n = len(blocks)
    before, after = [-1] * n, [-1] * n
    for order, to, step in ((range(n), before, -1), (range(n - 1, -1, -1), after, 1)):
        for i in order:
            j = i + step
            if 0 <= j < n:
                to[i] = j if labels[j] is not None and not blocks[j].bad else to[j]
    out = []
    for i, (b, label) in enumerate(zip(blocks, labels)):
        if label is None:
            near = [j for j in (before[i], after[i]) if j >= 0 and (not b.article or blocks[j].article == b.article)]
            near.sort(key=lambda j: abs(j - i))
            if not b.article and _is_long(b):
                label = len(near) < 2 or any(labels[j] for j in near)
            elif not near:
                label = True
            elif len(near) == 2 and abs(near[0] - i) == abs(near[1] - i) and labels[near[0]] != labels[near[1]]:
                label = labels[after[i]] if b.tag in HEADINGS else bool(b.article)
            else:
                label = labels[near[0]]
        out.append(bool(label))
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    known = knows_language(blocks)
    labels = second_pass(blocks, [first_pass(b, known) for b in blocks])
    return " ".join(b.text for b, good in zip(blocks, labels) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (empty if the page has
    none or html is null), n_chars (code points of text).  Broken markup is
    read as far as it goes; an unfinished tag at the end is dropped."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
