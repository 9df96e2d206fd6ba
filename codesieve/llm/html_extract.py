r"""The main text of web pages, by tree scoring.

A page is read once into a tree of its block elements (void and unclosed elements and implied ends are understood, also
where a page breaks off). Elements that are never an article's text go first: menus, headers, footers, sidebars, adverts,
notices, forms, comments, scripts and the like, by element, role and the words of class and id. What is left is blocks of
text. Each block passes points for its length and its commas to the elements around it, the nearest most; an element's
points are discounted by its link density, the share of its text that lies in links. The element with most points, or the
article that it lies in, is the container; siblings with enough points, and sibling paragraphs that read like text, are
kept with it. Their blocks are the page's text, in page order.

Every step is linear in the page; pages are read where they lie, in batches of bounded bytes, without a shuffle.

Defined cases: a null or empty page, and one without text, give an empty text; character references are those of HTML5,
also without their semicolon, and are decoded once; a tag that the page's end cuts off is dropped, and what lies before
it stays; white space is what Unicode calls so; pages are read as they come, so repeated rows and ties don't matter;
null page_id and url are passed on; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, slices

# Element names as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote li dd dt td th caption figcaption summary address".split())
BLOCKS = PARAGRAPHS | frozenset("html head body article main section div center details dialog dl fieldset figure hgroup hr ol ul menu table thead tbody tfoot tr search".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - frozenset("html head body td th caption thead tbody tfoot tr".split()) | frozenset("aside footer form header nav".split())
#: Of each element: the open ones that it ends, and those beyond which it ends none.
IMPLIED = {
    "li": ("li", "ol ul menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr td th", "tbody thead tfoot table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()} | {"a": (frozenset(("a",)), BLOCKS)}
#: Elements that an end tag from inside doesn't reach beyond, unless it is a table's.
CELLS, TABLES = frozenset("td th caption".split()), frozenset("table thead tbody tfoot tr td th caption".split())
#: Elements that hold no article text, and roles that say so.
NEVER = frozenset("head script style noscript template iframe object embed applet canvas svg math audio video map nav aside footer form button select textarea input label fieldset dialog menu search title noembed noframes xmp".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class and id that name what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond cookie cookies consent gdpr "
    "notice notices notification alert popup popups modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars aside rail nav navbar navigation menu menus toolbar topbar pagination pager paging footer foot "
    "masthead related recommended recommendations share sharing shares social widget widgets skip search".split()
)
MAIN = frozenset(("article", "main"))

PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Points: of a block, for each comma, for each so many characters up to a most; shares of ancestors; what an element
#: has by its name; what a sibling needs.
LENGTH, MOST_LENGTH = 100, 3.0
SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)
OWN = dict.fromkeys(("article", "main"), 25.0) | dict.fromkeys(("div", "section"), 5.0) | dict.fromkeys(("blockquote", "pre", "td"), 3.0) | dict.fromkeys(("address", "ol", "ul", "dl", "dd", "dt", "li"), -3.0) | dict.fromkeys((*HEADINGS, "th"), -5.0)
SIBLING_SHARE, SIBLING_LEAST, LONG_SIBLING, LINKED = 0.2, 10.0, 80, 0.25
#: In a container that no element names as an article: what goes if more than this share of its text lies in links.
LISTS, MOST_LINKED = frozenset("div section ul ol dl table".split()), 0.5


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) of a page; kinds are text, open, close."""
    at, size, gone = 0, len(page), {}

    def find(what: str, start: int) -> int:
        """Where it stands next; what isn't found once isn't looked for again."""
        if gone.get(what):
            return -1
        k = page.find(what, start)
        gone[what] = k < 0
        return k

    lower = None
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        m = PLAIN.match(page, lt)
        attributes: dict[str, str] = {}
        if m:
            closing, name, at = m[1], m[2].lower(), m.end()
        else:
            nxt = page[lt + 1 : lt + 2]
            closing = "/" if nxt == "/" else ""
            m = NAME.match(page, lt + 1 + len(closing))
            if not m:
                if page.startswith("<!--", lt):
                    end = lt + 4 if page.startswith(">", lt + 4) else lt + 5 if page.startswith("->", lt + 4) else find("-->", lt + 4)
                    at = size if end < 0 else end + (3 if page.startswith("-->", end) else 1)
                elif nxt in ("!", "?", "/"):
                    end = find(">", lt)
                    at = size if end < 0 else end + 1
                else:
                    yield "text", "<", {}
                    at = lt + 1
                continue
            name, at = m[0].lower(), m.end()
            while True:
                m = ATTRIBUTE.match(page, at)
                if not m:
                    break
                at = m.end()
                if m[1].lower() in ("class", "id", "role", "hidden", "style", "aria-hidden"):
                    attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            end = find(">", at)
            if end < 0:
                return
            at = end + 1
        yield "close" if closing else "open", name, attributes
        if not closing and name in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # a letter whose lower case is longer
                lower = page
            end = -1 if gone.get("</" + name) else lower.find("</" + name, at)
            if end < 0:
                gone["</" + name] = True
                end = size
            if name == "title" or name == "textarea":
                yield "text", page[at:end], {}
            at = end


class Tree:
    """Block elements and blocks of text of a page. Lists by element: parent, name, dropped, holds (an article)."""

    def __init__(self, page: str):
        self.parent, self.name, self.dropped, self.holds = [-1], ["html"], [False], [False]
        #: (element, text, characters in links)
        self.blocks: list[tuple[int, str, int]] = []
        self.run: list[str] = []
        self.linked = 0
        #: What an element inside a line leaves unfinished, by that element.
        self.waiting: dict[int, tuple[list[str], int]] = {}
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.open: Counter[str] = Counter(["html"])
        for kind, value, attributes in tokens(page):
            if kind == "text":
                self.text(value)
            elif kind == "open":
                self.start(value, attributes)
            else:
                self.end(value)
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            self.blocks.append((self.stack[-1][1], text, self.linked))
        self.run, self.linked = [], 0

    def text(self, raw: str) -> None:
        if self.open["head"] and self.stack[-1][0] == "head" and not raw.isspace():
            self.pop("head")
        text = html.unescape(raw) if "&" in raw else raw
        self.run.append(text)
        if self.open["a"]:
            self.linked += len(text)

    def pop(self, name: str) -> None:
        """Close everything down to the nearest open element of a name."""
        while True:
            top, node = self.stack[-1]
            if len(self.stack) == 1:
                return
            if node != self.stack[-2][1]:
                self.flush()
            self.stack.pop()
            self.open[top] -= 1
            if node in self.waiting:
                self.run, self.linked = self.waiting.pop(node)
            if top == name:
                return

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "html" or (name == "body" and self.open["body"]):
            return
        if self.open["head"] and (name not in HEAD or name == "head"):
            if self.stack[-1][0] == "head":
                self.pop("head")
        if name in ENDS_P and self.open["p"]:
            self.pop("p")
        if name in IMPLIED:
            ended, within = IMPLIED[name]
            if any(self.open[x] for x in ended):
                for top, _ in reversed(self.stack):
                    if top in within:
                        break
                    if top in ended:
                        self.pop(top)
                        if len(ended) < 3:
                            break
        if name == "br" or name == "hr":
            self.run.append("\n")
        never = self.surrounds(name, attributes)
        if name in VOID:
            return
        node = self.stack[-1][1]
        if never or name in BLOCKS or name == "header":
            if never and name not in BLOCKS and name not in ENDS_P:
                self.waiting[len(self.parent)] = self.run, self.linked
                self.run, self.linked = [], 0
            else:
                self.flush()
            self.parent.append(node)
            self.name.append(name)
            self.dropped.append(never)
            self.holds.append(False)
            node = len(self.parent) - 1
            if name in MAIN and not never:
                up = node
                while up >= 0 and not self.holds[up]:
                    self.holds[up] = True
                    up = self.parent[up]
        self.stack.append((name, node))
        self.open[name] += 1

    def surrounds(self, name: str, attributes: dict[str, str]) -> bool:
        """Whether an element holds no text of an article."""
        if name in NEVER:
            return True
        if name in ("html", "body"):
            return False
        if not attributes:
            return False
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return True
        if attributes.get("role", "").lower() in NEVER_ROLES:
            return True
        if name in MAIN:
            return bool({"comment", "comments", "reply"} & {w.lower() for w in WORDS.findall(attributes.get("class", "") + " " + attributes.get("id", ""))})
        words = {w.lower() for w in WORDS.findall(attributes.get("class", "") + " " + attributes.get("id", ""))}
        return not SURROUNDINGS.isdisjoint(words)

    def end(self, name: str) -> None:
        if name == "br":
            self.run.append("\n")
        elif self.open[name] and name not in ("html", "body"):
            for k in range(len(self.stack) - 1, 0, -1):
                top, node = self.stack[k]
                if top == name:
                    if name not in BLOCKS and node == self.stack[k - 1][1] != self.stack[-1][1]:
                        del self.stack[k]  # blocks that were opened inside stay open
                        self.open[name] -= 1
                    else:
                        self.pop(name)
                    return
                if top in CELLS and name not in TABLES:
                    return


def kept_elements(tree: Tree) -> list[bool]:
    """Which elements stand, once those that surround the article are gone. What holds an article is never dropped for
    its name. Of an article's own header only headings stand."""
    out, header, inside = [], [], []
    for i, (up, name) in enumerate(zip(tree.parent, tree.name, strict=True)):
        above = up < 0 or out[up]
        inside.append(name in MAIN or (up >= 0 and inside[up]))
        below = up >= 0 and header[up]
        header.append((below or name == "header") and name not in HEADINGS and not tree.holds[i])
        gone = tree.dropped[i] and not tree.holds[i]
        if name == "header" and not inside[i] and not tree.holds[i]:
            gone = True
        out.append(above and not gone)
    return [k and not h for k, h in zip(out, header, strict=True)]


def main_text(page: str) -> str:
    """The main text of one page."""
    tree = Tree(page)
    stands = kept_elements(tree)
    blocks = [b for b in tree.blocks if stands[b[0]]]
    if not blocks:
        return ""
    n = len(tree.parent)
    points, chars, linked, touched = [0.0] * n, [0] * n, [0] * n, [False] * n
    for node, text, links in blocks:
        score = 1.0 + text.count(",") + min(len(text) / LENGTH, MOST_LENGTH)
        score *= 1 - min(links / len(text), 1.0)
        chars[node] += len(text)
        linked[node] += links
        up = tree.parent[node] if tree.name[node] in PARAGRAPHS else node
        for share in SHARES:
            if up < 0:
                break
            points[up] += score * share
            touched[up] = True
            up = tree.parent[up]
    for i in range(n - 1, 0, -1):  # children come after their parent
        chars[tree.parent[i]] += chars[i]
        linked[tree.parent[i]] += linked[i]
    total = [0.0] * n
    for i in range(n):
        if touched[i] and chars[i]:
            total[i] = (points[i] + OWN.get(tree.name[i], 0.0)) * (1 - min(linked[i] / chars[i], 1.0))
    candidates = [i for i in range(n) if touched[i]]
    best = max(candidates, key=lambda i: (total[i], -i)) if candidates else 0
    up = best
    while up >= 0:
        if tree.name[up] in MAIN:
            best = up
            break
        up = tree.parent[up]
    chosen = {best}
    need = max(SIBLING_LEAST, SIBLING_SHARE * total[best])
    if tree.name[best] not in MAIN:
        for i in range(1, n):
            if tree.parent[i] == tree.parent[best] and i != best and chars[i]:
                density = linked[i] / chars[i]
                reads = tree.name[i] in PARAGRAPHS and density < LINKED and (chars[i] >= LONG_SIBLING or tree.name[i] in HEADINGS or density == 0)
                if total[i] >= need or reads:
                    chosen.add(i)
    inside, bare = [False] * n, tree.name[best] not in MAIN
    for i in range(n):
        links = bare and tree.name[i] in LISTS and chars[i] and linked[i] / chars[i] > MOST_LINKED
        inside[i] = i in chosen or (tree.parent[i] >= 0 and inside[tree.parent[i]] and not links)
    return " ".join(text for node, text, _ in blocks if inside[node])


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page. pages: page_id, url, html."""
    bound_batches(spark)
    kinds = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, column="html"):
            texts = [main_text(page) if page else "" for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
