"""Main text of web pages by equivalence classes of template tokens.

A token is an element with its path (tags, classes and ids from the root).  Its
occurrence vector says how often each page of a host has it; the vectors are
kept as mergeable fingerprints, so pages of a host never meet in one task.
Tokens of a host with equal vectors form a class; a class of several tokens that
spans enough pages and hangs together from the root down is valid, and the valid
classes nest into the host's template.  Each page layout of a host has
classes of its own, as its tokens occur on its pages alone.  The template's
containers hold slots; the slot that holds most of the prose (text outside
links) of the pages that have it, as deep as it may be, is the article's, together with what
only adds headings to it.  An element that is marked as the article (``article``, ``main`` and
the like) is preferred to it if it holds a fair share of the prose.  What stands
in that slot is the page's text, without texts that recur beside differing texts on
most of a host's distinct pages (LEAST_PAGES at least), lists of links, and what is left out below.

A host seen too little for a template, or a page without any of its slots, is judged by the
page alone: the elements are ranked by what their tag or name says and by their
text, and the slots of all that rank highest are taken; without any named holder all
blocks are.  Menus, headers, footers, sidebars, notices, adverts, forms and comments inside
are left out by tag, role, class and id.  An element that is left out for its class or id
alone stays if it holds the article (see ``Page``), and if the template says so.

Templates are joined to pages by broadcast up to ``BROADCAST_HOSTS`` hosts and
``BROADCAST_TEXTS`` slots and recurring texts, and beyond that by a join on host and salt.
A host's template has at most 1 / SPAN times the tokens of a page of it, its
recurring texts are at most 1 / TEXT_SPAN times those of a page.

Results for odd input: null and empty html give an empty text; a null url has
the empty host; unclosed and stray tags are mended as browsers do; elements
deeper than DEEPEST are part of the one around them; repeated rows
get a result each; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import small_batches, table, trim, written
from termloom.llm.url_filter import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: the end of an empty element; a slash in a value without quotation marks is part of it
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: an opening tag closes these if they are open in the same container
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, **{t: {"p"} for t in BLOCKS - {"br", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html"}}}
CLOSES["li"], CLOSES["dt"], CLOSES["dd"] = {"li", "p"}, {"dt", "dd", "p"}, {"dt", "dd", "p"}
#: an implied end does not cross these
SCOPES = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "dl", "td", "th", "blockquote", "aside", "form", "nav", "header", "footer"}
ASIDE = {"nav", "aside", "footer", "form", "button", "menu", "dialog", "head"}
NAMED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|cookies?|consent|gdpr|notice|banner|ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus|reply|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|popup|modal|overlay|widget|masthead|pagination|pager|toolbar|alert|skip|copyright)(?:$|[\s_-])", re.I)
#: class names that say what a page has or lacks, not what the element is
MODIFIER = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S*", re.I)
#: these are never the article, however much text they hold
DISCUSSION = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|reply|replies|respond|related|recommend\w*)(?:$|[\s_-])", re.I)
TOPS = re.compile(r"(?:^|[\s_-])(?:header|topbar|top)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
HOLDERS = re.compile(r"(?:^|[\s_-])(?:content|article|post|entry|story|body|text|main|page)(?:$|[\s_-])", re.I)
HOLDER_NAMES = re.compile(r"(?<!\S)(?:content|article|post|entry|story|body|text|main|page)(?!\S)", re.I)
MARKED, MAIN, NAMED_SO, PLAIN = 3, 2, 1, 0
#: in a NAMED element: it holds the main element or the article's body; around an element: what is left out anyway
SURE, HARD = 4, -2
#: pages that a host must show for a template, the share of them that a class must span, and the share on which a recurring text stands
LEAST_PAGES, SPAN, TEXT_SPAN = 4, 0.05, 0.5
#: shares of the prose of its pages that the article's slot holds, and that an element marked as the article holds; what a parent may add besides headings
DOMINANT, MARKED_SHARE, ADDED = 0.5, 0.2, 0.05
BROADCAST_HOSTS, BROADCAST_TEXTS, SALTS = 20_000, 1_000_000, 32
#: levels of elements, as in browsers
DEEPEST = 512
#: elements that hold others' slots
CONTAINERS = {"body", "div", "section", "article", "main", "center", "td", "table", "tbody", "tr", "fieldset", "details"}
#: so many links in texts of links alone in a row are a list of links
LIST = 3
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: longest other texts that tell whether a text recurs beside the same article
BESIDE = 2


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


class Page:
    """The blocks of a page: ``texts`` with the numbers of the elements around each, and the elements' ``keys`` and ``ranks``.

    Elements with a telling class or id (NAMED) are left out with all they hold.
    The page is read again without that for those that hold the main element or
    the article's body, or an article where no other holder is left, or another
    holder and most of the text; and for all of them if no text is left.
    """

    def __init__(self, source: str, bare: bool = False):
        """``bare``: no element is left out for its class or id, but for discussions."""
        self.bare = bare
        self._read(source, None if bare else frozenset())
        if self.lost and not bare:
            spared = self._spared()
            if spared:
                self._read(source, spared)
            if not self.texts and any(self.lost):
                self._read(source, None)

    def _spared(self) -> frozenset[int]:
        """The places of NAMED elements that hold the article, with those around them."""
        within, best = self.lost[:], self.inside[:]
        for i in range(len(within) - 1, -1, -1):
            if (up := self.above[i]) >= 0:
                within[up] += within[i]
                best[up] = max(best[up], best[i])
        kept = sum(len(t) for t, _ in self.texts)
        total = kept + sum(self.lost)
        other = any(rank > PLAIN for rank, _ in self.holders().values())
        out = set()
        for i, n in enumerate(within):
            sure = best[i] == SURE or best[i] == MARKED and not other or best[i] > PLAIN and 2 * n > total
            if n and sure and not self.discussed[i]:
                while i >= 0:
                    out.add(self.places[i])
                    i = self.above[i]
        return frozenset(out)

    def _read(self, source: str, spared: frozenset[int] | None) -> None:
        #: of each NAMED element: its place in the source, text in it but in no other, the one around it, the best holder in it, whether it is a discussion
        self.places: list[int] = []
        self.lost: list[int] = []
        self.above: list[int] = []
        self.inside: list[int] = []
        self.discussed: list[bool] = []
        self.keys: list[int] = []
        self.ranks: list[int] = []
        self.counts: dict[int, int] = {}
        self.texts: list[tuple[str, tuple[int, ...]]] = []
        #: of each text: characters in links, how many links, and whether it is a heading; of each element: whether it is NAMED, its tag and the key around it
        self.linked: list[int] = []
        self.links: list[int] = []
        self.headed: list[bool] = []
        self.named: list[bool] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.mass: dict[int, int] = {}
        stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # the last: the NAMED element around, HARD in what is left out anyway
        opened: dict[str, int] = {}
        around: list[int] = []
        piece: list[str] = []
        links = anchors = 0

        def flush() -> None:
            nonlocal links, anchors
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                piece.clear()
                if text:
                    self.texts.append((text, tuple(around)))
                    self.linked.append(min(links, len(text)))
                    self.links.append(anchors)
                    self.headed.append(any(opened.get(h) for h in HEADINGS))
                    for e in around:
                        self.mass[e] = self.mass.get(e, 0) + len(text)
                links = anchors = 0

        def close(n: int) -> None:
            for name, _, _, held, _ in stack[n:]:
                opened[name] -= 1
                if held:
                    around.pop()
            del stack[n:]

        for m in TOKEN.finditer(source):
            raw, closing, name, attributes, text = m[1], m[2], m[3], m[4], m[5]
            if text is not None:
                if not stack[-1][2]:
                    piece.append(text)
                    if opened.get("a"):
                        links += len(" ".join(text.split()))
                elif stack[-1][4] >= 0:
                    self.lost[stack[-1][4]] += len(" ".join(text.split()))
                continue
            if name is None:
                continue
            name = name.lower()
            if name in BLOCKS:
                flush()
            if closing:
                at = opened.get(name) and next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if at:
                    close(at)
                continue
            if name in BLOCKS and name != "html":
                at = next((i for i in range(1, min(3, len(stack))) if stack[i][0] == "head"), 0)
                if at:  # content ends an open head
                    close(at)
            ends = CLOSES.get(name)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        close(i)
                        break
                    if stack[i][0] in SCOPES:
                        break
            anchors += name == "a"
            a = _attributes(attributes)
            label = f"{a.get('class', '')} {a.get('id', '')}"
            key = zlib.crc32(f"{name} {label}".encode(), stack[-1][1])
            self.counts[key] = self.counts.get(key, 0) + 1
            if name in VOID or CLOSED.search(attributes) and name not in BLOCKS:
                continue
            role = a.get("role", "")
            marked = any(self.ranks[e] == MARKED for e in around)
            within = stack[-1][4]
            hard = within == HARD or name in ASIDE or (name == "header" or bool(TOPS.search(label))) and not marked or role in ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "")
            named = not hard and bool(label.strip()) and name not in ("html", "body") and bool(NAMED.search(MODIFIER.sub(" ", label)))
            aside = stack[-1][2] or hard
            if hard:
                within = HARD
            else:
                body = a.get("itemprop") == "articleBody" or name == "main" or role == "main"
                if named:
                    self.places.append(m.start())
                    self.lost.append(0)
                    self.above.append(within)
                    self.inside.append(PLAIN)
                    self.discussed.append(bool(DISCUSSION.search(label)) and not body)
                    within = len(self.lost) - 1
                    aside = aside or (self.discussed[-1] if self.bare else spared is not None and m.start() not in spared)
                if within >= 0:
                    found = SURE if body else MARKED if name == "article" and not named else NAMED_SO if HOLDER_NAMES.search(label) else PLAIN
                    self.inside[within] = max(self.inside[within], found)
            held = name in BLOCKS and not aside and len(around) < DEEPEST
            if held:
                rank = MARKED if name == "article" or a.get("itemprop") == "articleBody" else MAIN if name == "main" or role == "main" else NAMED_SO if label.strip() and HOLDERS.search(label) else PLAIN
                around.append(len(self.keys))
                self.parents.append(self.keys[around[-2]] if len(around) > 1 else 0)
                self.keys.append(key)
                self.ranks.append(rank)
                self.named.append(named)
                self.tags.append(name)
            stack.append((name, key, aside, held, within))
            opened[name] = opened.get(name, 0) + 1
        flush()

    def holders(self) -> dict[int, tuple[int, int]]:
        """For each element that may hold the article: its rank and the text in it, by key."""
        out: dict[int, tuple[int, int]] = {}
        for e, n in self.mass.items():
            rank, had = out.get(self.keys[e], (self.ranks[e], 0))
            out[self.keys[e]] = (max(rank, self.ranks[e]), had + n)
        return out

    def marked(self) -> bool:
        """Whether text stands in an element that is marked as the article, outside NAMED ones."""
        return any(any(self.ranks[e] == MARKED for e in around) and not any(self.named[e] for e in around) for _, around in self.texts)

    def slots(self) -> dict[int, list[int]]:
        """For each container, by key: rank, key of the container around it, prose in it, prose that is no heading and in no container inside; and under key 0 the prose of the page."""
        out: dict[int, list[int]] = {0: [PLAIN, 0, 0, 0]}
        for e, key in enumerate(self.keys):
            if self.tags[e] in CONTAINERS:
                slot = out.setdefault(key, [PLAIN, 0, 0, 0])
                slot[0] = max(slot[0], self.ranks[e])
        for (text, around), linked, headed in zip(self.texts, self.linked, self.headed):
            prose = len(text) - linked
            within = [self.keys[e] for e in around if self.tags[e] in CONTAINERS]
            out[0][2] += prose
            for up, key in zip([0, *within], within):
                out[key][1] = up
            for key in dict.fromkeys(within):
                out[key][2] += prose
            if not headed:
                out[within[-1] if within else 0][3] += prose
        return out

    def text_places(self) -> dict[int, tuple[int, int]]:
        """For each text, by hash: the key of the innermost container around it and its prose, of all its occurrences in one."""
        out: dict[int, tuple[int, int]] = {}
        for (text, around), linked in zip(self.texts, self.linked):
            key = next((self.keys[e] for e in reversed(around) if self.tags[e] in CONTAINERS), 0)
            h = text_hash(text)
            out[h] = (key, out.get(h, (0, 0))[1] + len(text) - linked)
        return out

    def in_slot(self, key: int, constant: set[int]) -> str | None:
        """The texts in the elements with this key, without NAMED elements inside, lists of links and recurring texts; None if there are none."""
        held: list[tuple[str, int]] = []
        for (text, around), linked, links, headed in zip(self.texts, self.linked, self.links, self.headed):
            at = next((i for i, e in enumerate(around) if self.keys[e] == key), None)
            if at is not None and not any(self.named[e] for e in around[at + 1 :]):
                held.append((text, max(1, links) if not headed and 3 * linked > 2 * len(text) else 0))
        left: list[str] = []
        for only_links, run in groupby(held, key=lambda h: h[1] > 0):
            texts = list(run)
            if not only_links or sum(n for _, n in texts) < LIST:
                left += [t for t, _ in texts if text_hash(t) not in constant]
        left = left or [t for t, _ in held]
        return " ".join(left) if left else None

    def text(self, holders: list[int], constant: set[int]) -> str:
        own = self.holders()
        key = next((k for k in holders if k in own), None)
        if key is None and own:
            marked = [k for k, (rank, _) in own.items() if rank > PLAIN]
            key = max(marked or own, key=lambda k: (own[k], -list(own).index(k)))
        least = own[key][0] if key is not None else PLAIN
        ranked = [(t, max((self.ranks[e] for e in around), default=PLAIN)) for t, around in self.texts]
        held = [(t, rank) for t, rank in ranked if rank >= least]
        left = [t for t, rank in held if rank == MARKED or text_hash(t) not in constant]
        return " ".join(left or [t for t, _ in held])

    def beside(self) -> dict[int, int]:
        """For each text, by hash, a hash of the longest others: copies of an article are alike in it, other articles aren't."""
        own = sorted({(-len(t), text_hash(t)) for t, _ in self.texts})
        first = [h for _, h in own[: BESIDE + 1]]
        return {h: hash(tuple(x for x in first if x != h)[:BESIDE]) for _, h in own}


def text_hash(text: str) -> int:
    return zlib.crc32(text.encode()) | len(text) << 32


def page_text(source: str, marked: list[int], slots: list[int], constant: set[int]) -> str:
    """The page's text by its host's template: elements marked as the article, there or on the page, else the slots, else the page alone."""
    page = Page(source)
    own = page.holders()
    prose = sum(len(t) for t, _ in page.texts)
    if not slots or any(k in own for k in marked) or any(rank >= MAIN and n >= MARKED_SHARE * prose for rank, n in own.values()):
        return page.text(marked, constant)
    bare = Page(source, bare=True)
    keys = set(bare.keys)
    for key in slots:
        if key in keys and (text := bare.in_slot(key, constant)) is not None:
            return text
    return page.text([], constant)


ROOT, ELEMENT, CONSTANT = 0, 1, 2
SUMS = ("pages", "vector1", "vector2", "mass", "own", "total")
STATISTICS = "host string, kind int, token long, beside long, parent long, rank int, container int, " + ", ".join(f"{c} long" for c in SUMS)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, list[int]] = {}

    def rows() -> pa.RecordBatch:
        out = [(*k, *v) for k, v in seen.items()]
        seen.clear()
        names = [field.split()[0] for field in STATISTICS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 2, *[pa.int64()] * len(SUMS)))], names)

    for batch in batches:
        for host, source in zip(*(c.to_pylist() for c in batch.columns)):
            bare = Page(source or "", bare=True)
            marked = bare.marked()
            # recurring texts are those of the page as it is judged; one that marks its article needs none
            page = bare if marked else Page(source or "")
            own, slots, places = page.holders(), bare.slots(), bare.text_places()
            content, beside, total = zlib.crc32((source or "").encode()), page.beside(), slots[0][2]
            tokens = [(ROOT, 0, hash(tuple(list(beside)[: BESIDE + 1])), 0, PLAIN, 0, 1, 0, 0)]
            for key, n in bare.counts.items():
                rank, up, mass, direct = slots.get(key, (PLAIN, 0, 0, 0))
                tokens.append((ELEMENT, key, 0, up, max(rank, own.get(key, (PLAIN, 0))[0]), int(key in slots), n, mass, direct))
            if not marked and not any(r == MARKED for r, _ in own.values()):
                for h, other in {**bare.beside(), **beside}.items():
                    up, prose = places.get(h, (0, 0))
                    tokens.append((CONSTANT, h, other, up, PLAIN, 0, 1, prose, 0))
            for kind, token, other, up, rank, container, n, mass, direct in tokens:
                x = seen.setdefault((host, kind, token, other, up), [rank, container, *[0] * len(SUMS)])
                x[0], x[1] = max(x[0], rank), max(x[1], container)
                vector = hash((content, n, 0x9E3779B9))
                for i, v in enumerate((1, vector & 0x7FFFFFFF, vector >> 31 & 0x7FFFFFFF, mass, direct, total), 2):
                    x[i] += v
        if len(seen) > 200_000:
            yield rows()
    if seen:
        yield rows()
    trim()


def chosen_slots(tokens: list[dict], recurring: list[dict], of: int) -> tuple[list[int], list[int]]:
    """(elements marked as the article, article slots) of a host's template, the best and the innermost first.

    From its frequent tokens; the recurring texts are part of the template and no data
    of the slots that they stand in.  ``of`` is the number of the host's pages.
    """
    classes: dict[tuple, int] = {}
    for t in tokens:
        vector = t["pages"], t["vector1"], t["vector2"]
        classes[vector] = classes.get(vector, 0) + 1
    large = {t["token"]: t for t in tokens if classes[t["pages"], t["vector1"], t["vector2"]] > 1 or t["parent"] == 0}
    inside = {k: t for k, t in large.items() if t["container"]}

    def rooted(t: dict) -> bool:
        """Whether the classes of all containers around are valid too."""
        seen = set()
        while t["parent"]:
            if t["token"] in seen or t["parent"] not in inside:
                return False
            seen.add(t["token"])
            t = inside[t["parent"]]
        return True

    template = {k: t for k, t in inside.items() if rooted(t)}
    for k, t in template.items():
        t["total"] -= min(t["total"], sum(r["mass"] * t["pages"] // of for r in recurring))
    for r in recurring:
        at, first = r["parent"], True
        while at in template:
            template[at]["mass"] -= min(template[at]["mass"], r["mass"])
            template[at]["own"] -= min(template[at]["own"], r["mass"]) if first else 0
            at, first = template[at]["parent"], False
    share = {k: t["mass"] / max(1, t["total"]) for k, t in template.items()}
    marked = sorted((k for k, t in template.items() if t["rank"] >= MAIN and share[k] >= MARKED_SHARE), key=lambda k: (-template[k]["rank"], -share[k], k))
    dominant = {k for k in template if share[k] >= DOMINANT}
    slots = []
    for k in dominant - {template[k]["parent"] for k in dominant}:
        top = k
        while (up := template[top]["parent"]) in template and template[up]["parent"]:
            heads = template[up]["mass"] - template[k]["mass"] if _only_headings(up, top, template) else None
            if heads is None or template[up]["own"] > ADDED * template[k]["mass"]:
                break
            top = up
        slots.append(top)
    return marked, sorted(set(slots), key=lambda k: (-_depth(k, template), -share[k], k))


def _depth(key: int, template: dict[int, dict]) -> int:
    n = 0
    while (key := template[key]["parent"]) in template:
        n += 1
    return n


def _only_headings(up: int, child: int, template: dict[int, dict]) -> bool:
    """Whether a container's other containers hold hardly any prose."""
    others = sum(t["mass"] for k, t in template.items() if t["parent"] == up and k != child)
    return others <= ADDED * template[child]["mass"] and template[child]["pages"] >= template[up]["pages"] * (1 - ADDED)


def _template(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    marked, slots = chosen_slots([r for r in rows if r["kind"] == ELEMENT], [r for r in rows if r["kind"] == CONSTANT], rows[0]["of"])
    return pa.table([t.column("host").slice(0, 1), pa.array([marked], pa.list_(pa.int64())), pa.array([slots], pa.list_(pa.int64()))], names=["host", "marked", "slots"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, marked, slots, constant) for each host with a template, from pages (host, html)."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    most = [F.max("rank").alias("rank"), F.max("container").alias("container")]
    # an element that stands in no text has no parent here; the parent is a matter of the path else
    found = pages.mapInArrow(_statistics, STATISTICS).groupBy("host", "kind", "token", "beside").agg(F.max("parent").alias("parent"), *most, *sums)
    found = found.groupBy("host", "kind", "token").agg(F.count(F.lit(1)).alias("differing"), F.max("parent").alias("parent"), *most, *sums)
    found = written(found.where("pages > 1"), "page-tokens")
    hosts = found.where(F.col("kind") == ROOT).where(F.col("pages") >= LEAST_PAGES).select("host", F.col("pages").alias("of"), F.col("differing").alias("of_differing"))
    frequent = found.join(hosts, "host").where((F.col("kind") == ELEMENT) & (F.col("pages") >= F.greatest(F.lit(LEAST_PAGES), SPAN * F.col("of"))))
    recurring = found.join(hosts, "host").where((F.col("kind") == CONSTANT) & (F.col("of_differing") >= LEAST_PAGES) & (F.col("differing") >= F.greatest(F.lit(LEAST_PAGES), TEXT_SPAN * F.col("of_differing"))))
    both = frequent.unionByName(recurring)  # of a host at most 1 / SPAN times the tokens of a page of it and 1 / TEXT_SPAN times its texts
    chosen = both.select("host", "kind", "token", "parent", "rank", "container", "of", *SUMS).groupBy("host").applyInArrow(_template, "host string, marked array<long>, slots array<long>")
    constant = recurring.groupBy("host").agg(F.collect_list("token").alias("constant"))
    return hosts.select("host").join(chosen, "host", "left").join(constant, "host", "left")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.coalesce(host_and_path(F.col(url_col))[0], F.lit("")).alias("host"), F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"), F.col(url_col).cast("string").alias("url"))
    known = written(templates(rows.select("host", "html")), "templates")
    size = known.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(sum(F.greatest(F.size(c), F.lit(0)) for c in ("marked", "slots", "constant"))), F.lit(0)).alias("texts")).first()
    if size["hosts"] <= BROADCAST_HOSTS and size["texts"] <= BROADCAST_TEXTS:
        met = rows.join(F.broadcast(known), "host", "left")  # its size was checked
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt")
        each = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.select("*", salt).join(each, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(source or "", marked or [], slots or [], set(constant or ())) for source, marked, slots, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
        trim()

    return met.select("page_id", "url", "html", "marked", "slots", "constant").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
