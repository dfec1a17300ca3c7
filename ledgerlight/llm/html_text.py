"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What stands in menus, page headers,
footers, sidebars, notices, adverts, forms, comments and raw elements, by tag or by
what its classes, id or role name as a whole, is no text of the article. Of these a form, and
a box that only its name speaks against, may be the page's frame: if nearly all text that
pass 1 calls good stands under the same such reasons, they count for nothing on that
page. If a page marks its article, only blocks in it are candidates.

Pass 1 decides a candidate by link density, length and stop-word density, or leaves
it open: short blocks, and linkless ones in a marked article. Pass 2 gives an open
block the label of its nearest decided neighbour (at equal distance the good one
in a marked article, else the bad one); without any decided neighbour a marked
article keeps it and other pages drop it.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bound_batches, lean

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag: a quote counts behind an equals sign alone. Nothing is given back, so it is read once.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
#: Fixed values of HTML: elements whose content is no markup, elements without end, and block-level elements.
RAW = frozenset("script style textarea title noscript iframe template svg math object xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that close an open one of their kind.
CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements, and names in a class, id or role, that hold no article text.
SKIPPED = frozenset("nav footer aside form button select head menu dialog fieldset".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation navigations breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login search share sharing social related recommended comment comments disqus reply replies widget widgets toolbar pagination pager contentinfo complementary".split()
)
#: Of these, the ones that a frame of the whole page is often named by (a widget, a layout with a sidebar, a category), and elements that may be a frame.
FRAMES = frozenset("sidebar menu banner notice notices alert popup modal login search share sharing social related recommended widget widgets toolbar promo promotion topbar masthead".split())
FRAME_ELEMENTS = frozenset("form fieldset".split())
#: Words at the end of a name that only say that it is a box, and at its front that something else has or lacks what follows.
CARRIERS = frozenset("area areas bar block body bottom box buttons container content count form group icons inner item items left link links list lists main module outer panel posts right row section top wrap wrapper zone".split())
MODIFIERS = frozenset("has have with without no non not hide hides hidden show shows is if".split())
#: Elements that an end tag, or another element of their kind, looks for up to the nearest container.
CONTAINERS = frozenset("article div ul ol table section main body".split())
SCOPED = CONTAINERS | {k for ks in CLOSING.values() for k in ks}
#: Frequent words of English, German, French and Spanish.
STOPS = frozenset(
    "a an and are as at be by for from has he in is it its of on or that the this to was were which will with not you they "
    "am auf aus bei das dem den der des die ein eine einer er es für im ist mit nicht sich sie sind und von war wie zu zur "
    "au aux avec ce ces dans de du elle en est et il je la le les mais ne ou par pas pour que qui sur un une "
    "al como con del el ella esta la las lo los más no para pero por se ser sin sobre su un una y".split()
)
#: Characters of a short block and of one that is long enough by itself; densities.
SHORT, LONG = 70, 200
MOST_LINKS, FEW_STOPS, MANY_STOPS = 0.4, 0.15, 0.3
#: Good characters under the same reasons that make these a page's frame, and how many times what stands outside they are.
FRAMED, TIMES = 600, 3


class Block(NamedTuple):
    text: str
    link_chars: int
    marked: bool
    reasons: frozenset[str] = frozenset()


@functools.lru_cache(1 << 14)
def names_boilerplate(name: str) -> bool:
    """Whether a class, id or role names what is no article text: ``cookie-notice``, ``comment_list``, ``siteNav``.

    Words of a box at its end don't count, nor what follows ``--`` (a variant). The
    word before must be one of :data:`WORDS`: ``notice-title`` and ``ad-free`` name
    something else, as does a name that begins like ``has-sidebar``.
    """
    return _boilerplate_word(name) is not None


def _boilerplate_word(name: str) -> str | None:
    parts = [p.lower() for p in _PARTS.findall(name.partition("--")[0])]
    if not parts or parts[0] in MODIFIERS:
        return None
    while len(parts) > 1 and parts[-1] in CARRIERS:
        parts.pop()
    return parts[-1] if parts[-1] in WORDS else None


def _hints(attributes: str) -> Iterator[str]:
    """The names in an element's classes, id and role."""
    for key, value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            yield from value.strip("\"'").split()


@functools.lru_cache(1 << 12)
def _named(attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether a name speaks against the element whatever it holds, and the names that do so unless they name the page's frame."""
    named = {h: _boilerplate_word(h) for h in _hints(attributes) if names_boilerplate(h)}
    return any(w not in FRAMES for w in named.values()), frozenset(named)


class Tag(NamedTuple):
    name: str
    closes: bool
    attributes: str


def tokens(page: str) -> Iterator[str | Tag]:
    """Texts (as they are written) and tags. Comments are left out, as is a tag, comment or raw element that never ends, with all behind it.

    Linear in the page: a tag is read once, and one that quotes don't let end makes
    quotes count for nothing from there on.
    """
    at, n, last, quotes = 0, len(page), page.rfind(">"), True
    while at < n:
        lt = page.find("<", at)
        if lt != at:
            yield page[at : lt if lt >= 0 else n]
            at = lt if lt >= 0 else n
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = end + 3 if end >= 0 else n
            continue
        named = _NAME.match(page, at + 1)
        if named is None:
            if page.startswith(("<!", "<?", "</"), at):
                at = page.find(">", at) + 1 if at < last else n
            else:
                yield "<"
                at += 1
            continue
        if at > last:
            return
        rest = _REST.match(page, named.end()) if quotes else None
        if rest is None:
            quotes, end = False, page.find(">", named.end())
        else:
            end = rest.end() - 1
        tag = Tag(named.group().lstrip("/").lower(), named.group()[0] == "/", page[named.end() : end])
        at = end + 1
        if tag.name in RAW and not tag.closes:
            if not tag.attributes.endswith("/") or tag.name in ("script", "style", "textarea", "title"):
                at = _raw_end(page, tag.name, at)
            continue
        yield tag


_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
#: Raw elements that hold elements, so that one of the same name may stand inside.
NESTED = frozenset("svg math object template noscript".split())
_RAW_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^>]*?(/?)>", re.IGNORECASE) for name in NESTED}


def _raw_end(page: str, name: str, at: int) -> int:
    """Where a raw element ends that begins before ``at``; the page's end if it doesn't."""
    if name not in NESTED:
        close = _RAW_ENDS[name].search(page, at)
        return close.end() if close else len(page)
    depth = 1
    for tag in _RAW_TAGS[name].finditer(page, at):
        depth += -1 if tag[1] else 0 if tag[2] else 1
        if not depth:
            return tag.end()
    return len(page)


def blocks(page: str) -> list[Block]:
    """The page's candidate blocks in order, once the page's frame is told."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, skipped, marked
    against: list[tuple[int, frozenset[str]]] = [(-1, frozenset())]  # reasons that may be the frame, with the place of who adds the last one
    scope: list[int] = []  # places of SCOPED elements in the stack
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, skipped, marked = 0, 0, 0

    def flush() -> None:
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, marked > 0, against[-1][1]))
        parts, links = [], 0

    def close(at: int) -> None:
        nonlocal skipped, marked
        for name, skip, mark in stack[at:]:
            skipped -= skip
            marked -= mark
            opened[name] -= 1
        del stack[at:]
        while scope and scope[-1] >= at:
            scope.pop()
        while against[-1][0] >= at:
            against.pop()

    for token in tokens(page):
        if isinstance(token, str):
            if not skipped:
                text = html.unescape(token)
                parts.append(text)
                if opened["a"]:
                    links += len(text.strip())
            continue
        name, closes, attributes = token
        if name in BLOCK:
            flush()
        if closes:
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            for k in CLOSING.get(name, ("p",)):
                inner = next((i for i in reversed(scope) if stack[i][0] == k or stack[i][0] in CONTAINERS), None)
                if inner is not None and stack[inner][0] == k:
                    close(inner)
        if name in VOID or attributes.endswith("/"):
            continue
        mark = name in ("article", "main") or "articlebody" in attributes.lower()
        sure, names = _named(attributes) if name not in ("html", "body", "article", "main") else (False, frozenset())
        if name in FRAME_ELEMENTS:
            names |= {f"<{name}>"}
        skip = sure or (name in SKIPPED and name not in FRAME_ELEMENTS) or (name == "header" and not marked)
        if names and not skip:
            if name in BLOCK:
                against.append((len(stack), against[-1][1] | names))
            else:  # inside a line of text it is no frame
                skip = True
        if name in SCOPED:
            scope.append(len(stack))
        stack.append((name, skip, mark))
        opened[name] += 1
        skipped += skip
        marked += mark
    flush()
    good: Counter[frozenset[str]] = Counter()
    if any(b.reasons for b in out):
        for b in out:
            good[b.reasons] += len(b.text) if decide(b) else 0
        frame, size = max(good.items(), key=lambda x: x[1])
        if not frame or size < FRAMED or size <= TIMES * good[frozenset()]:
            frame = frozenset()
        out = [b for b in out if b.reasons <= frame]
    if any(b.marked for b in out):
        out = [b for b in out if b.marked]
    return out


def decide(block: Block) -> bool | None:
    """Pass 1: text (True), boilerplate (False) or open (None)."""
    n = len(block.text)
    if block.link_chars > MOST_LINKS * n:
        return False
    words = re.findall(r"\w+", block.text.lower())
    stops = sum(w in STOPS for w in words) / len(words) if words else 0.0
    if n < SHORT:
        return False if block.link_chars and not block.marked else None
    if stops >= MANY_STOPS or (stops >= FEW_STOPS and n >= LONG):
        return True
    if block.marked or stops >= FEW_STOPS:
        return None
    return False


def main_text(page: str) -> str:
    """The article's blocks, one to a line."""
    found = blocks(page)
    labels = [decide(b) for b in found]
    before: list[int | None] = []
    last = None
    for i, x in enumerate(labels):
        last = i if x is not None else last
        before.append(last)
    out, after = [], None
    for i in range(len(found) - 1, -1, -1):
        if labels[i] is not None:
            after, good = i, labels[i]
        else:
            sides = [(abs(j - i), labels[j]) for j in (before[i], after) if j is not None]
            near = min((d for d, _ in sides), default=None)
            got = [x for d, x in sides if d == near]
            good = (any(got) if found[i].marked else all(got)) if got else found[i].marked
        if good:
            out.append(found[i].text)
    return "\n".join(reversed(out))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns of these names are replaced.

    Null or empty html, and a page without an article, give an empty text. Character
    references are decoded and white space inside a block is one space. A tag without
    an end drops what follows it, as browsers do. Rows and
    other columns stay; nothing is capped. No shuffle.
    """
    bound_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    source = pages.select(*[pages[f"`{c}`"] for c in keep], pages[f"`{html_col}`"].alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("__html").to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "text", "n_chars"])

    return source.mapInArrow(lean(run), schema)
