"""Main text of web pages by composite text density.

A page becomes a small tree of numbers: each element's parent, characters, tags, characters in
links and links. Density is characters per tag, made smaller the more of them are links; an
element's sum is that of its children's densities and of its own bare text. The element of the
greatest sum is the article's core, and the least density on its path to the body is the threshold
that what lies beside the path must reach. A page that names its article (article or main) is
searched only there, and the named element is taken whole. What is no article wherever it stands
(scripts, menus, footers, forms, adverts, comments ...) is told by its tag, role or class and left
out of all sums but one: the body's share of links, against which an element's links are weighed.

Pages don't depend on each other: one Arrow pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import map_text
from claimweave.session import prepare, spread, without

# Names of elements, roles and class words in HTML pages.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg math".split())
NEVER_TEXT = frozenset("head nav footer aside button select datalist dialog object audio video canvas applet map menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promoted promotion nav navbar navigation menu menubar submenu breadcrumb "
    "breadcrumbs footer masthead sidebar sidenav sidebox cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing sharebar social related "
    "recommended recommendations comment comments commentlist disqus replies pagination pager paging toolbar widget widgets copyright colophon skiplink".split()
)
#: These count only outside the article and beside none of OWN_WORDS.
WEAK_WORDS = frozenset("header banner topbar notice notices notification notifications alert alerts disclaimer warning announcement overlay hidden print".split())
OWN_WORDS = frozenset("article post entry story content main page title body".split())
#: An element whose class says that there is, or isn't, such a thing beside it.
HAVING = frozenset("has no with without hide show".split())
WHOLE = frozenset(["html", "body", "main", "article"])
#: What ends an open paragraph, and list items and the like that end each other.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("html body table ul ol dl td th button object".split())
#: Parts of running text: kept beside the core unless they are links, however short.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr br".split()) | {"#"}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^\"'>]++|(?<==)\"[^\"]*+\"|(?<==\s)\"[^\"]*+\"|(?<==)'[^']*+'|[\"'])*+)(?P<close>>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop|href)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Elements in page order, by number; node 0 is the page. A bare text is an element named '#'."""

    def __init__(self):
        self.parent, self.name, self.noise, self.sure = [0], ["body"], [False], [False]
        self.text: dict[int, str] = {}  # of bare texts; a line feed where a block begins or ends

    def add(self, parent: int, name: str, noise: bool = False, sure: bool = False) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.noise.append(noise)
        self.sure.append(sure)
        return len(self.parent) - 1


def noise_of(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """(no part of an article, and that whatever it holds), by tag, role, class and id."""
    if name in NEVER_TEXT or (name == "header" and not inside):
        return True, True
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if rest else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDING.search(found.get("style", "")):
        return True, True
    if name in WHOLE and not (name == "article" and inside):
        return False, False
    if name == "form" or found.get("role", "").lower() in NOISE_ROLES or found.get("itemprop", "").lower() == "comment":
        return True, name != "form"
    for value in (found.get("class", ""), found.get("id", "")):
        for one in value.split():
            words = [w.lower() for w in WORDS.findall(one)]
            for at, word in enumerate(words):
                if at and words[at - 1] in HAVING:
                    continue
                if word in NOISE_WORDS:
                    return True, word.startswith("comment")
                if word in WEAK_WORDS and not OWN_WORDS.intersection(words) and not (inside and word in ("header", "banner")):
                    return True, False
    return False, False


def tree_of(page: str) -> Tree:
    """The page's elements as a browser would nest them, as far as text is concerned."""
    tree, open_, at, size = Tree(), [0], 0, len(page)
    within = {"article": 0, "main": 0, "head": 0}  # how many of them are open

    def bare(text: str):
        if text:
            tree.text[tree.add(open_[-1], "#")] = text

    def close(depth: int):
        if any(tree.name[n] not in INLINE for n in open_[depth:]):
            bare_break()
        for n in open_[depth:]:
            if tree.name[n] in within:
                within[tree.name[n]] -= 1
        del open_[depth:]

    def bare_break():
        tree.text[tree.add(open_[-1], "#")] = "\n"

    def close_above(names: set | frozenset, stop: frozenset):
        for depth in range(len(open_) - 1, 0, -1):
            if tree.name[open_[depth]] in names:
                return close(depth)
            if tree.name[open_[depth]] in stop:
                return None
        return None

    while at < size:
        less = page.find("<", at)
        if less < 0:
            bare(page[at:])
            break
        bare(page[at:less])
        found = TOKEN.match(page, less)
        if not found:  # a bare "<"
            bare("<")
            at = less + 1
            continue
        at, name = found.end(), (found["name"] or "").lower()
        if not name or not found["close"]:  # a comment, or a tag that the page's end cuts
            continue
        if found["end"]:
            block = name not in INLINE
            for depth in range(len(open_) - 1, 0, -1):
                if tree.name[open_[depth]] == name:
                    close(depth)
                    break
                if not block and tree.name[open_[depth]] not in INLINE:
                    break
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*+>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br" or name == "hr":
            bare_break()
        if name in VOID:
            continue
        if name == "body" or name == "html":
            continue
        if name in ENDS_P:
            close_above({"p"}, SCOPE)
        if name in ENDS:
            close_above(ENDS[name], frozenset(["table", "ul", "ol", "dl", "select"]))
        if within["head"]:  # a head without an end
            close_above({"head"}, frozenset())
        inside = within["article"] + within["main"] > 0
        if name not in INLINE:
            bare_break()
        noise, sure = noise_of(name, found["rest"], inside) if name not in INLINE or found["rest"] else (False, False)
        open_.append(tree.add(open_[-1], name, noise, sure))
        if name in within:
            within[name] += 1
    return tree


def without_noise(tree: Tree, spare: list[bool]) -> list[bool]:
    kept = [True] * len(tree.parent)
    for n in range(1, len(kept)):
        kept[n] = kept[tree.parent[n]] and (not tree.noise[n] or spare[n])
    return kept


def kept_nodes(tree: Tree) -> list[bool]:
    """Which nodes aren't noise.

    Where no article stays, and less than half of the text, a form or an element named like noise
    that holds an article, main or h1 is taken to be the page's frame, and none itself.
    """
    many = len(tree.parent)
    holds = [False] * many
    for n in range(many - 1, 0, -1):
        own = tree.name[n] in ("main", "h1") or (tree.name[n] == "article" and not tree.noise[n])
        if (own or holds[n]) and not (tree.noise[n] and tree.sure[n]):
            holds[n] = True
            holds[tree.parent[n]] = True
    strict = without_noise(tree, [False] * many)
    if not any(holds[n] and tree.noise[n] and not tree.sure[n] for n in range(many)):
        return strict
    loose = without_noise(tree, [holds[n] and not tree.sure[n] for n in range(many)])
    named, chars = False, [0, 0]
    for n, text in tree.text.items():
        size = len(text.strip())
        chars[0] += size if strict[n] else 0
        chars[1] += size if loose[n] else 0
        up = n
        while strict[n] and size and up and not named:
            up = tree.parent[up]
            named = tree.name[up] in ("article", "main")
    return strict if named or 2 * chars[0] >= chars[1] else loose


def counts(tree: Tree, kept: list[bool]) -> tuple[tuple[list[int], ...], float]:
    """(characters, tags, characters in links, links) of each kept node, and the share of links in the whole page with all noise."""
    many = len(tree.parent)
    linked = [False] * many
    chars, tags, link_chars, links = ([0] * many for _ in range(4))
    page = [0, 0]
    for n in range(1, many):
        linked[n] = linked[tree.parent[n]] or tree.name[n] == "a"
        own = len(tree.text[n].strip()) if n in tree.text else 0
        page[0] += own
        page[1] += own if linked[n] else 0
        if kept[n]:
            chars[n], link_chars[n] = own, own if linked[n] else 0
            tags[n], links[n] = int(n not in tree.text), int(tree.name[n] == "a")
    for n in range(many - 1, 0, -1):
        up = tree.parent[n]
        if kept[n]:
            chars[up] += chars[n]
            tags[up] += tags[n]
            link_chars[up] += link_chars[n]
            links[up] += links[n]
    return (chars, tags, link_chars, links), page[1] / page[0] if page[0] else 0.0


def density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """Characters per tag; the more of them are links, against the page's share, the less.

    The tags of an element are those in it and itself. Without any link on the page the logarithm
    has no base, and it is characters per tag.
    """
    if not chars:
        return 0.0
    plain = chars / max(1, tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + share * chars + math.e)
    if base <= 1.0:
        return plain
    return plain * max(0.0, math.log(chars / max(1, link_chars) * max(1, tags) / max(1, links))) / math.log(base)


def chosen(tree: Tree, kept: list[bool]) -> list[bool]:
    """Which nodes are the article."""
    many = len(tree.parent)
    (chars, tags, link_chars, links), share = counts(tree, kept)
    dense = [density(chars[n], tags[n], link_chars[n], links[n], share) if kept[n] else 0.0 for n in range(many)]
    sums = [0.0] * many
    for n in range(1, many):
        sums[tree.parent[n]] += dense[n]
    named = [False] * many
    for n in range(1, many):
        named[n] = kept[n] and (named[tree.parent[n]] or (tree.name[n] in ("article", "main") and chars[n] > 0))
    search = [n for n in range(many) if kept[n] and n not in tree.text and (named[n] or not any(named))]
    core = max(search, key=lambda n: (sums[n], -n))  # of equal sums the outer element
    if named[core]:
        top = core
        n = core
        while n:
            if tree.name[n] == "article" or (tree.name[n] == "main" and tree.name[top] != "article"):
                top = n
            n = tree.parent[n]
        taken = {top}
    else:
        path = [core]
        while path[-1]:
            path.append(tree.parent[path[-1]])
        least, sparse = min(dense[n] for n in path), min(chars[n] / max(1, tags[n]) for n in path)
        on_path, taken = set(path), {core}
        for n in range(1, many):
            if kept[n] and n not in on_path and tree.parent[n] in on_path and tree.parent[n] != core:
                mostly_links = 2 * link_chars[n] > chars[n]
                if not mostly_links and (tree.name[n] in RUNNING or tree.name[n] in INLINE or (dense[n] >= least and chars[n] >= sparse * max(1, tags[n]))):
                    taken.add(n)
    out = [False] * many
    for n in range(many):
        out[n] = kept[n] and (n in taken or (n > 0 and out[tree.parent[n]]))
    return out


def main_text(page: str) -> str:
    """The article of a page: character references decoded, white space as one space, blocks joined by one space."""
    tree = tree_of(page)
    take = chosen(tree, kept_nodes(tree))
    # a break stands in the element around a block, so breaks count wherever they are
    parts = [t if t == "\n" else html.unescape(t) for n, t in tree.text.items() if t == "\n" or take[n]]
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """keep (default all columns but html), text, n_chars: the main text of each page, empty if there is none.

    Null html: empty. Repeated rows stay. Empty table: no rows. Input columns named text or n_chars
    give way. Pages of any length are taken whole; nothing is dropped for its length.
    """
    prepare(pages.sparkSession)
    base = without(pages, ["text", "n_chars"])
    shown = keep or [c for c in base.columns if c != "html"]

    def start():
        def work(texts, _):
            found = [main_text(t.decode("utf-8", "replace")) for t in texts]
            return [found, [len(t) for t in found]]

        return work

    return map_text(spread(base.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*shown, "html"])])), shown, [("text", "string"), ("n_chars", "long")], start, text="html")
