"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their nearest ancestors (all to the parent, half to the
grandparent, then ever less); containers are discounted by link density. The best container, or the article element
around it, is kept with siblings that score or read like it. Page furniture is taken out beforehand, by element, role,
class or id; classes, ids and forms only hint at furniture, so what they name stays if it holds an article or most of
the page's points, unless the article is plainly elsewhere: reader comments and sidebars go however long they are.
All steps take time in proportion to the page, however deep or broken it is: the scanner looks at no character twice.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Element names of the HTML standard, by what this module does with them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
REMOVED = frozenset(
    "script style noscript template nav footer aside button select textarea input label fieldset iframe object embed svg canvas audio video head title dialog menu".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCKS - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: An element that is implicitly closed by the start of another: which ones, and where the search for it ends.
CLOSED_BY = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tr"], ({"tr"}, {"table", "tbody", "thead", "tfoot"})),
    **dict.fromkeys(["option"], ({"option"}, {"select"})),
}
# Words in class names and ids, and roles, of what isn't the article.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "sidebar aside widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead header footer comment comments disqus replies respond responses reactions share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search skip".split()
)
#: Those of reader comments: one among other words is enough.
COMMENTS = frozenset("comment comments disqus replies respond responses reactions".split())
NEIGHBOUR = frozenset("has with without no".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
WORDS = re.compile(r"[a-z]+")
CONTAINERS = frozenset("article main body".split())
PARAGRAPHS = frozenset("p pre blockquote".split())
#: So many ancestors get points of a paragraph.
LEVELS = 8
SCORED = frozenset("p pre td blockquote li dd figcaption".split())


class Node:
    __slots__ = ("tag", "parent", "inside", "removed", "named", "score", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, removed: bool, named: int = 0):
        self.tag, self.parent, self.inside, self.removed, self.named = tag, parent, [], removed, named
        self.score, self.points, self.chars, self.linked = 0.0, 0.0, 0, 0


def is_furniture(tag: str, attrs) -> bool:
    """By element or role."""
    return tag in REMOVED or any(name == "hidden" or name == "role" and (value or "").strip().lower() in ROLES for name, value in attrs)


def named_as(tag: str, attrs) -> int:
    """By class or id: 2 if a name has words of furniture alone, or one of comments; 1 if it has one among others (of a paragraph that is 0: share-price). A form: 2."""
    if tag == "form":
        return 2
    found = [
        2 if FURNITURE.issuperset(words) or COMMENTS.intersection(words) else 1 for name,
        value in attrs if name in ("class", "id") and value for words in names_of(value) if FURNITURE.intersection(words)
    ]
    most = max(found, default=0)
    return 0 if most == 1 and tag in PARAGRAPHS else most


def names_of(value: str):
    """Words of each name in a class or id; a name such as has-sidebar or page-with-comments tells of a neighbour and is left out."""
    for name in value.split():
        words = WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if words and not NEIGHBOUR.intersection(words[:-1]):
            yield words


# Elements whose content is text up to their end tag; in the last two character references count.
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
REFERENCES = frozenset("textarea title".split())
OPENING = re.compile(r"<([A-Za-z/!?])")
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(\s*=\s*)?)?")
UNQUOTED = re.compile(r"[^\s>]*")
COMMENT_END = re.compile(r"--!?>")
ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
LONG_NUMBER = re.compile(r"&#(?:[xX][0-9a-fA-F]{8,}|[0-9]{8,});?")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def characters(text: str) -> str:
    """Character references decoded; a number beyond all characters is U+FFFD."""
    return unescape(LONG_NUMBER.sub("\ufffd", ZEROS.sub(r"&#\1", text))) if "&" in text else text


def attributes(html: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of a tag from behind its name, and the place behind the tag; -1 if it doesn't end."""
    out = []
    while True:
        m = ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1] is None:
            at = html.find(">", at) if at < len(html) else -1  # at once, but for the end of the page
            return out, at + 1 if at >= 0 else -1
        value = ""
        if m[2] is not None:
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return out, -1
                value, at = html[at + 1 : end], end + 1
            else:
                value = UNQUOTED.match(html, at)[0]
                at += len(value)
        out.append((m[1].lower(), characters(value)))


def tokens(html: str):
    """("data", text), ("start", name, attributes) and ("end", name) of a page, in one pass.

    A tag or comment that doesn't end takes the rest of the page, as in browsers, so nothing is looked at again.
    """
    at, n = 0, len(html)
    while at < n:
        opening = OPENING.search(html, at)
        if not opening:
            yield "data", characters(html[at:])
            return
        sign, follows = opening.start(), opening[1]
        name = TAG_NAME.match(html, sign + 1 + (follows == "/"))
        if sign > at:
            yield "data", characters(html[at:sign])
        if name:
            found, at = attributes(html, name.end())
            if at < 0:
                return
            tag = name[0].lower()
            if follows == "/":
                yield "end", tag
                continue
            yield "start", tag, found
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                inside = html[at : end.start() if end else n]
                if inside:
                    yield "data", characters(inside) if tag in REFERENCES else inside
                at = end.start() if end else n
        elif html.startswith("<!--", sign):
            end = COMMENT_END.search(html, sign + 2)
            at = end.end() if end else n
        else:
            end = html.find(">", sign)
            at = end + 1 if end >= 0 else n


class Tree:
    """A forgiving tree: implied ends, unknown ends and missing ends as browsers treat them, in outline.

    ``path`` holds the open elements, ``depths`` where on it each name stands and where blocks do: an end finds its
    element, or that there is none, without a walk.
    """

    def __init__(self):
        self.root = Node("html", None, False)
        self.path, self.depths = [self.root], {}
        self.named: list[Node] = []  # may be taken out for a class or id, or as a form

    def deepest(self, names) -> int:
        """Depth of the innermost open element of one of the names; 0 if there is none."""
        return max((self.depths[n][-1] for n in names if self.depths.get(n)), default=0)

    def close_to(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.depths[""].pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in ENDS_PARAGRAPH:
            self.end_implied({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div", "li", "blockquote"})
        if tag in HEADINGS and self.path[-1].tag in HEADINGS:
            self.close_to(len(self.path) - 1)
        if tag in CLOSED_BY:
            self.end_implied(*CLOSED_BY[tag])
        node = Node(tag, self.path[-1], is_furniture(tag, attrs), named_as(tag, attrs))
        if tag == "header":  # of a page; an article's own header keeps its headings
            node.removed = True
        if node.named and not node.removed and tag not in CONTAINERS:
            self.named.append(node)
        self.path[-1].inside.append(node)
        if tag not in VOID:
            for name in (tag, "") if tag in BLOCKS else (tag,):
                self.depths.setdefault(name, []).append(len(self.path))
            self.path.append(node)

    def end_implied(self, tags, until):
        depth = self.deepest(tags)
        if depth > self.deepest(until):
            self.close_to(depth)

    def handle_endtag(self, tag):
        depth = self.deepest((tag,))
        if depth and (tag in BLOCKS or depth > self.deepest(("",))):  # the end of an inline element doesn't close a block
            self.close_to(depth)

    def feed(self, html: str) -> None:
        for kind, *what in tokens(html):
            if kind == "data":
                self.path[-1].inside.append(what[0])
            elif kind == "start":
                self.handle_starttag(*what)  # a slash at its end means nothing in HTML
            else:
                self.handle_endtag(*what)


def walk(top: Node):
    """(node or text, its parent, entering) in page order, without recursion and without what is removed."""
    stack = [(top, None, True)]
    while stack:
        item, parent, entering = stack.pop()
        yield item, parent, entering
        if entering and isinstance(item, Node):
            stack.append((item, parent, False))
            stack += [(x, item, True) for x in reversed(item.inside) if not (isinstance(x, Node) and x.removed)]


def keep_headings(root: Node) -> None:
    """Headings of headers inside an article stay with the article."""
    stack = [(root, False)]
    while stack:
        node, article = stack.pop()
        article = article or node.tag in ("article", "main")
        for x in node.inside:
            if isinstance(x, Node):
                if x.tag == "header" and article:
                    found = [y for y, _, e in walk(x) if e and isinstance(y, Node) and y.tag in HEADINGS]
                    if found:
                        x.inside, x.removed = found, False
                        for y in found:
                            y.parent = x
                stack.append((x, article))


def score(root: Node) -> list[Node]:
    """Passes points upwards; gives the scored containers."""
    links = 0
    found: dict[int, Node] = {}
    own: dict[int, list] = {}  # node -> characters and commas of its own inline text
    for item, parent, entering in walk(root):
        if isinstance(item, Node):
            if item.tag == "a":
                links += 1 if entering else -1
            if not entering:
                if parent is not None:
                    parent.chars += item.chars
                    parent.linked += item.linked
                    if item.tag not in BLOCKS and id(item) in own:
                        a, b = own.setdefault(id(parent), [0, 0]), own[id(item)]
                        a[0] += b[0]
                        a[1] += b[1]
                chars, commas = own.get(id(item), (0, 0))
                if chars and (item.tag in SCORED or item.tag in BLOCKS and chars >= 25):
                    points, share, at = 1 + commas + min(chars / 100, 3), 1.0, item.parent if item.tag in SCORED else item
                    item.points += points
                    level = 0
                    while at is not None and level < LEVELS:
                        at.score += points * share
                        found[id(at)] = at
                        level += 1
                        share, at = 1 / (2 if level == 1 else 3 * level), at.parent
                if parent is not None:
                    parent.points += item.points
        elif parent is not None:
            text = " ".join(item.split())
            parent.chars += len(text)
            parent.linked += len(text) if links else 0
            mine = own.setdefault(id(parent), [0, 0])
            mine[0] += len(text)
            mine[1] += sum(text.count(c) for c in ",،、，")
    return list(found.values())


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def clear(root: Node) -> None:
    for item, _, entering in walk(root):
        if entering and isinstance(item, Node):
            item.score, item.points, item.chars, item.linked = 0.0, 0.0, 0, 0


#: Characters beside links that are an article's, and no stray line.
SOME = 140
#: Containers, from the outside in, that may turn out to be the page itself.
WRAPPERS = 5


def holders(root: Node) -> set[int]:
    """Nodes around a main element or an article of the page.

    Articles inside articles or among comments, those that are named as furniture themselves, and those with under a
    fifth of the best one's points (teasers) don't count.
    """
    articles, mains, depth = [], [], 0
    for item, _, entering in walk(root):
        if isinstance(item, Node) and (item.tag == "article" or item.named == 2 and item.tag != "form"):
            depth += 1 if entering else -1
            if entering and depth == 1 and not item.named:
                articles.append(item)
        elif isinstance(item, Node) and item.tag == "main" and entering:
            mains.append(item)
    best, out = max((x.points for x in articles), default=0.0), set()
    for at in [*(x for x in mains if x.chars), *(x for x in articles if x.chars and x.points >= 0.2 * best)]:
        while at is not None and id(at) not in out:
            out.add(id(at))
            at = at.parent
    return out


def outside(root: Node, closed: set[int]) -> int:
    """Characters that are in no link and in none of the nodes ``closed``."""
    chars, shut = 0, 0
    for item, _, entering in walk(root):
        if isinstance(item, Node):
            shut += (1 if entering else -1) * (id(item) in closed or item.tag == "a")
        elif not shut:
            chars += len("".join(item.split()))
    return chars


def take_out(root: Node, named: list[Node]) -> None:
    """Removes ``named``, but none that holds a main element or an article, and not what is most of the page.

    What a whole name tells of (ad, not ad-free), and comments, go whatever their length if an article's text is left
    without them. Where none is, the largest one around most of the page's points is its wrapper, and stays.
    """
    score(root)
    holding = holders(root)
    undecided = {id(x): x for x in named if id(x) not in holding}
    plain = outside(root, set(undecided)) >= SOME
    for _ in range(WRAPPERS):
        if plain or holding:
            break
        large = max((x for x in undecided.values() if 2 * x.points > root.points), key=lambda x: x.points, default=None)
        if large is None:
            break
        del undecided[id(large)]
        plain = outside(root, set(undecided)) >= SOME
    out = [x for x in undecided.values() if 2 * x.points <= root.points or x.named == 2 and (plain or holding)]
    clear(root)
    for x in out:
        x.removed = True


def drop_replies(root: Node) -> None:
    """Articles inside an article that has text of its own are replies to it or teasers, but for those with headings."""
    depth, own, inner, nested = 0, 0, [], None
    for item, _, entering in walk(root):
        if isinstance(item, str):
            own += len("".join(item.split())) if depth == 1 else 0
            continue
        if item.tag == "article":
            depth += 1 if entering else -1
            if entering and depth == 1:
                own, inner = 0, []
            elif entering and depth == 2:
                nested = [item, False]
                inner.append(nested)
            elif not entering and depth == 0 and own >= SOME:
                for x, headed in inner:
                    x.removed = not headed
        elif item.tag in HEADINGS and depth > 1 and nested:
            nested[1] = True


def main_nodes(root: Node, named: list[Node]) -> list[Node]:
    """The nodes whose text is the article, in page order; ``named`` ones are taken out unless nothing is left then."""
    if named:
        take_out(root, named)
    drop_replies(root)
    keep_headings(root)
    scored = score(root)
    if not scored and (out := [x for x in named if x.removed]):
        left = root.chars
        for x in out:
            x.removed = False
        clear(root)
        scored = score(root)
        for x in out:
            x.removed = not scored and left > 0
    if not scored:
        return [root]
    final = {id(n): n.score * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: final[id(n)])
    level, within = best, None
    while level is not None:
        within = level if level.tag in ("article", "main") else within
        level = level.parent
    best = within or best
    if best.parent is None:
        return [best]
    least = 0.2 * final.get(id(best), 0.0)
    out = []
    for x in best.parent.inside:
        if isinstance(x, Node) and not x.removed:
            like = final.get(id(x), 0.0) >= least > 0 and density(x) < 0.5
            reads = (x.tag == "p" or x.tag in HEADINGS) and (x.chars > 80 and density(x) < 0.25 or x.chars > 0 and density(x) == 0)
            if x is best or like or reads:
                out.append(x)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order: white space as single spaces, trimmed, empty ones left out."""
    out, now = [], []

    def end():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    for top in nodes:
        for item, _, _ in walk(top):
            if isinstance(item, str):
                now.append(item)
            elif item.tag in BLOCKS:
                end()
            elif item.tag == "br":
                now.append(" ")
        end()
    return out


def main_text(html: str | None) -> str:
    """The article of a page; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    return "\n\n".join(blocks(main_nodes(tree.root, tree.named)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text; long ones are read whole. Null ids and urls stay null, repeated rows give a
    row each, ties between containers go to the one that scored first in page order. An empty table gives an empty
    result; extra columns are left out.
    """

    def make():
        def run(rows):
            for i, url, html in rows:
                text = main_text(html)
                yield i, url, text, len(text)

        return run

    return map_rows(
        pages.select(
            F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html")
        ), f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long", make
    )
