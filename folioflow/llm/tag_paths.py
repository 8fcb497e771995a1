"""Main text of web pages by tag-path ratios (operator 4).

Text nodes are gathered by their path of tags from the root to the leaf. Each
path has ratios: text per node, punctuation per node, and the share of its text
that is not link text. Their logarithms are fused with hints from the names on
the path (an article's, or those of what stands around one), which count in
standard deviations of the page's ratios, smoothed over the path's relatives (the
paths that share its container), and a threshold halfway between the page's least
ratio and its greatest fused value selects. So where ratios do not tell paths
apart, hints do not either: all pass. Only what readers wrote is known by name
alone, as its ratios are an article's.

The nodes on the paths that pass are the main text, and with them what is nested
in elements most of whose text passes (headings, cells, quotations, short
lines), unless a hint speaks against it or most of it is link text.

Pages are read in one pass, in time linear in their length whatever their markup.
"""

from __future__ import annotations

import html as entities
import math
import re
import statistics
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioflow.llm.common import append_columns, text_slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("article main".split())
AROUND = frozenset("aside button dialog fieldset figcaption footer form head header label menu nav".split())
#: Those of them that are the text's own inside an article: its heading, what its figures show.
WITHIN = frozenset("figcaption header".split())
#: Elements that hold blocks rather than being one, and those whose share of link text is measured: a cell counts with its table.
HOLDS = frozenset("article main section div body html blockquote td".split())
PARTS = frozenset("article main section div body html blockquote table ul ol dl".split())
LISTS = frozenset("ul ol dl table".split())
#: Words in class, id or role that mark what surrounds an article.
ASIDE = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Those of them that mark what readers wrote, often more than the article itself.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Words of a class that make it say something of a page or its state (has-sidebar, comments-open), and those that make a header the text's own.
MODIFIERS = frozenset("accepted closed disabled enabled has hidden hide no non not open opened show with without".split())
OWN = frozenset("article content entry page post story".split())
#: Words that leave the other words of a class their meaning (ad-slot, related-posts). Inside an article a class of several words says something only beside these: social-science and reply-brief are its subjects.
PLACES = frozenset("area bar block box btn button buttons card cards column container content feed footer form header holder inner inline item items left link links list module outer panel posts right rail row section signup slot top bottom unit widget wrap wrapper".split())
#: Elements that an open element of the same kind ends, and those it cannot reach beyond.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIMITS = frozenset("ul ol dl table article section div body html td th blockquote main nav aside footer header".split())

#: Standard deviations that a hint adds to a path's ratio: the article's own elements, what stands around one.
FOR, AGAINST = 3.0, -3.0

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HEADING = re.compile(r"h[1-6]")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…](?!\S)|[、。，！？]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


@dataclass
class Path:
    parent: int
    name: str
    said: str = ""
    hint: float = 0.0
    inside: bool = False  # an article
    readers: bool = False
    holder: int = 0  # the path of the last element that holds blocks
    nodes: int = 0
    chars: int = 0
    marks: int = 0
    linked: int = 0
    score: float = -math.inf


@dataclass
class Page:
    """Paths and elements as trees (each entry after its parent), and text nodes (element, block, text, linked) in page order."""

    paths: list[Path] = field(default_factory=lambda: [Path(-1, "")])
    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    nodes: list[tuple[int, int, str, bool]] = field(default_factory=list)


def mark(name: str, attributes: str, inside: bool) -> str:
    """What class, id or role say of an element: ``!`` that it stands around the article, ``!!`` that readers wrote it, or nothing.

    A class says so by its first or last word (sidebar-left, site-header), not
    with words for a state, nor after the ``--`` before a modifier. A header
    inside an article, of an entry or in a heading is the text's own.
    """
    if name in ("html", "body", *CONTENT) or (name == "header" and inside):
        return ""
    found: set = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            words = re.findall(r"[a-z]+", token.split("--")[0])
            if words and MODIFIERS.isdisjoint(words) and not (inside and {*words} - ASIDE - PLACES):
                ends = {words[0], words[-1]}
                found |= ends & ASIDE - ({"header"} if inside or ends & OWN or _HEADING.fullmatch(name) else set())
    return "!!" if found & READERS else "!" if found else ""


def tags(page: str):
    """(text before, element name, is it an end tag, attributes) of every tag, and (text, None, False, "") at the end.

    Quotes count in attributes after ``=``. Where they leave a tag without an
    end, the page's quotes are taken for broken from there on.
    """
    at = start = 0
    last, quotes = page.rfind(">"), True
    while (i := page.find("<", at)) >= 0 and i < last:
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            yield page[start:i], "", False, ""
            at = start = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), i):
            yield page[start:i], "", False, ""
            at = start = page.index(">", i) + 1
            continue
        m = _NAME.match(page, i)
        if not m:
            at = i + 1
            continue
        end = _tag_end(page, m.end()) if quotes else page.index(">", i)
        if end < 0:
            quotes, end = False, page.index(">", i)
        yield page[start:i], m[1].lower(), page[i + 1] == "/", page[m.end() : end]
        at = start = end + 1
        if page[i + 1] != "/" and m[1].lower() in RAW and not page[:end].endswith("/", m.end()):
            close = _ENDS[m[1].lower()].search(page, at)
            at = start = close.end() if close else len(page)
    yield page[start:], None, False, ""


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, -1 if quotes hide all of them."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if page[: m.start()].endswith("=") if page[m.start() - 1] == "=" else page[max(0, m.start() - 64) : m.start()].rstrip().endswith("="):
            close = page.find(m[0], at)
            if close >= 0:
                at = close + 1
    return -1


def parse(page: str) -> Page:
    """Text nodes with their paths and the number of their block, character references decoded. Unclosed elements end where HTML's rules for them say, or with their parent."""
    out = Page()
    paths, known = out.paths, {}
    names, open_ = [""], [0]  # of the open elements: names, numbers
    places: dict[str, list[int]] = {}  # where on that stack elements of a name are
    limits: list[int] = []
    block = links = 0

    def shorten(depth: int) -> None:
        nonlocal links
        while len(names) > depth:
            name = names.pop()
            open_.pop()
            places[name].pop()
            links -= name == "a"
            if name in LIMITS:
                limits.pop()

    for text, name, ends, attributes in tags(page):
        if text:
            out.nodes.append((open_[-1], block, entities.unescape(text), links > 0))
        if not name:
            continue
        block += name in BLOCK
        if ends:
            if places.get(name):
                shorten(places[name][-1])
        elif name in VOID:
            if name in ("br", "hr"):
                out.nodes.append((open_[-1], block, " ", False))
        elif name not in RAW:
            # A block ends inline elements that were left open in the paragraph before it, together with the paragraph.
            closed = [places[x][-1] for x in CLOSES.get(name) or (("p",) if name in BLOCK else ()) if places.get(x)]
            if closed and max(closed) >= (limits[-1] if limits else 0):
                shorten(max(closed))
            up = out.path[open_[-1]]
            said = mark(name, attributes, paths[up].inside) if attributes else ""
            key = (up, name, attributes if said else "")  # marked elements of other classes are on paths of their own
            if key not in known:
                above = paths[up]
                path = Path(up, name, said, above.hint, above.inside or name in CONTENT)
                if name in CONTENT and not above.inside:
                    path.hint += FOR
                path.readers = above.readers or said == "!!"
                if said or (name in AROUND and not (name in WITHIN and above.inside)):
                    path.hint += AGAINST
                path.holder = len(paths) if name in HOLDS else above.holder
                known[key] = len(paths)
                paths.append(path)
            places.setdefault(name, []).append(len(names))
            if name in LIMITS:
                limits.append(len(names))
            links += name == "a"
            names.append(name)
            open_.append(len(out.path))
            out.parent.append(open_[-2])
            out.path.append(known[key])
    return out


def clear_hints(page: Page) -> None:
    """Take the hint off the paths of elements marked ``!`` that hold more than half of the text (of the articles' text, if there is any): they stand around nothing."""
    if not any(p.said == "!" for p in page.paths):
        return
    size = [0] * len(page.path)
    own = [(e, n) for e, _, text, linked in page.nodes if not linked and (n := len(text.strip()))]
    own = [(e, n) for e, n in own if page.paths[page.path[e]].inside] or own
    for e, n in own:
        size[e] += n
    for e in range(len(size) - 1, 0, -1):
        size[page.parent[e]] += size[e]
    clear = {page.path[e] for e in range(1, len(size)) if 2 * size[e] > size[0] and page.paths[page.path[e]].said == "!"}
    lifted = [0.0] * len(page.paths)
    for i in range(1, len(page.paths)):
        p = page.paths[i]
        lifted[i] = lifted[p.parent] - (AGAINST if i in clear else 0.0)
        p.hint += lifted[i]


def ratio(p: Path) -> float:
    """Text per node, raised by its punctuation and lowered by its share of link text."""
    return p.chars / p.nodes * (1 + p.marks / p.nodes) * (1 - p.linked / p.chars) ** 2


def score_paths(page: Page) -> float:
    """Fuse and smooth the ratios; gives the threshold."""
    for e, _, raw, linked in page.nodes:
        if text := raw.strip():
            p = page.paths[page.path[e]]
            p.nodes += 1
            p.chars += len(text)
            p.marks += len(_PUNCTUATION.findall(text))
            p.linked += len(text) * linked
    found = [p for p in page.paths if p.linked < p.chars and not p.readers]
    logs = [math.log(ratio(p)) for p in found]
    spread = statistics.pstdev(logs) if logs else 0.0
    groups: dict[tuple[int, float], list[Path]] = {}
    for p, x in zip(found, logs):
        p.score = x + spread * p.hint
        # What a hint speaks against is no relative of what it does not.
        groups.setdefault((p.holder, p.hint), []).append(p)
    for members in groups.values():
        # Relatives share half of their container's ratio, each text-weighted: headings and lists stand with the paragraphs around them.
        mean = sum(p.score * p.chars for p in members) / sum(p.chars for p in members)
        for p in members:
            p.score = (p.score + mean) / 2
    return (min(logs) + max(p.score for p in found)) / 2 if found else 0.0


def select(page: Page) -> list[bool]:
    """Which text nodes are main text."""
    clear_hints(page)
    threshold = score_paths(page)
    passed = {i for i, p in enumerate(page.paths) if p.score >= threshold}
    # Of each element's text: what passes, all without a hint against it, and of each part what is linked.
    n = len(page.path)
    good, every, whole, linked = [0] * n, [0] * n, [0] * n, [0] * n
    part = [0] * n
    for e in range(1, n):
        part[e] = e if page.paths[page.path[e]].name in PARTS else part[page.parent[e]]
    for e, _, text, link in page.nodes:
        k = len(text.strip())
        path = page.path[e]
        good[e] += k * (path in passed)
        every[e] += k
        whole[part[e]] += k
        linked[part[e]] += k * link
    for e in range(n - 1, 0, -1):
        good[page.parent[e]] += good[e]
        every[page.parent[e]] += every[e]
    # The nearest content element at or above each element; the body holds the whole page, so what stands beside its paragraphs is not theirs.
    held = [False] * n
    own = [False] * n  # lists that an article's container holds: lists of links too, if nothing speaks against them
    for e in range(1, n):
        p, up = page.paths[page.path[e]], page.parent[e]
        against = p.readers or p.hint < page.paths[p.parent].hint
        own[e] = not against and p.inside and (own[up] or (held[up] and p.name in LISTS))
        held[e] = not against and (held[up] or (p.name in HOLDS and p.name not in ("body", "html") and good[e] > 0 and 2 * good[e] >= every[e]))
    return [page.path[e] in passed or (held[e] and (own[e] or 2 * linked[part[e]] <= whole[part[e]])) for e, _, _, _ in page.nodes]


def main_text(html: str | None) -> str:
    """The article's text: its blocks in page order, white space inside each made one space, joined by one space."""
    page = parse(html or "")
    blocks: dict[int, list[str]] = {}
    for (_, block, text, _), taken in zip(page.nodes, select(page)):
        if taken or not text.strip():
            blocks.setdefault(block, []).append(text)
    parts = (_SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return " ".join(p for p in parts if p)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``_row`` with ``text`` and ``n_chars`` (its code points) of every page.

    A null or empty page has the empty text, an empty table gives an empty
    result. Repeated rows give repeated rows; nothing of a page is cut off,
    however long. Columns of the pages that are named like the results stay
    apart, inside ``_row``.
    """

    def compute(batches):
        for (column,) in batches:
            texts = [main_text(x) for part in text_slices(column) for x in part.to_pylist()]
            yield [texts, [len(x) for x in texts]], None

    return append_columns(pages, [html], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute, carry, "pages")
