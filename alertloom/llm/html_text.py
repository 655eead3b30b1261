"""Main text of web pages, with site templates removed by counting element subtrees.

Each page is parsed to a tree. Elements that stand for page furniture by their kind (menus, footers,
forms, scripts) or by the name of their class or id (sidebar, cookie-notice, comments) are dropped, unless
they are wrappers: they hold the page's main part, its only articles, or its title and most of its text.
Inside an article an id is only a heading's slug, except for comments. A header goes unless it is that of
an article or section. Of the other containers the subtrees are hashed, with their text, and counted per
host: a subtree that stands next to different texts on a large share of a host's different pages is its
template and is dropped too. Headings, paragraphs and quotations are never taken for a template, and lists,
tables and figures of an article only where it begins or ends; a share that is just reached counts.

The text is that of the page's articles, or of its main part, or else of its body. Blocks are joined by
an empty line; in a block all white space is one blank. A null or empty page gives an empty text. Pages
that are cut off are read as far as they go. A null url is a host of its own; rows that repeat a
page_id get a result each. An empty table gives no rows; columns beside the three are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.durable import written_once

# A subtree is a template if it is on so many pages of a host and on this share of them, in percent.
TEMPLATE_PAGES = 5
TEMPLATE_PERCENT = 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option dialog svg canvas object audio video map menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Containers whose subtrees are counted; the second kind is an article's own unless it stands at its edge.
CONTAINERS = frozenset("aside center details div footer form header menu nav section".split())
LISTED = frozenset("dl figure ol table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Opening one of these ends an open one of the listed kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIERS = frozenset("ul ol table article section div body html td th".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices newsletter subscribe subscription paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer topbar toolbar comment "
    "comments commentlist disqus respond reply replies share sharing social related recommended popup modal overlay login signup search "
    "pagination pager skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
# A class or id names furniture by its last word, or by its first if only words of this kind follow.
HOLDERS = frozenset(
    "area articles bar block bottom box button buttons container content form icons inner item items left link links list message overlay "
    "panel popup posts right section slot text thread title top unit widget wrap wrapper".split()
)
# Words that say what a wrapper has or lacks.
LAYOUT_WORDS = frozenset("and has hide hides no not non with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_TAG = re.compile(r"""<(?:!--(?:.*?-->|>|->)|!--|[!?][^>]*>|/(?![a-zA-Z])[^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD_ENDS = re.compile(r"[\s_\-]+")


class Element:
    """An element with its children, which are elements and texts.

    `furniture` is settled once the page is read; until then it says what the element's own tag tells.
    """

    __slots__ = ("name", "furniture", "children", "may_wrap", "in_article", "in_section")

    def __init__(self, name: str, parent: Element | None = None):
        self.name, self.furniture, self.may_wrap, self.children = name, False, False, []
        self.in_article = parent is not None and (parent.in_article or parent.name == "article")
        self.in_section = parent is not None and (parent.in_section or parent.name in ("article", "main", "section"))


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is made of such words."""
    for name in value.split():
        parts = [w for w in _WORD_ENDS.split(name) if w]
        if not parts or LAYOUT_WORDS & set(parts):
            continue
        if parts[-1] in words or (parts[0] in words and HOLDERS.issuperset(parts[1:])):
            return True
    return False


def _mark(element: Element, attributes: str) -> None:
    """Mark an element that its tag shows to be furniture; what may be a wrapper as well is settled later."""
    name = element.name
    if name in DROPPED:
        element.furniture, element.may_wrap = True, name == "form" and not element.in_article
        return
    if name == "header" and not element.in_section:
        element.furniture = element.may_wrap = True
    if not attributes.strip():
        return
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values)).lower()
        if key == "hidden":
            element.furniture, element.may_wrap = True, False
            return
        words = FURNITURE
        if name in ("article", "main") or (key == "id" and (element.in_article or name == "section")):
            words = COMMENTS
        by_name = key == "class" or (key == "id" and name not in HEADINGS)
        if (key == "role" and value in ROLES) or (by_name and name not in ("html", "body") and _names(value, words)):
            element.furniture = True
            element.may_wrap = name not in ("article", "main") and not element.in_article


def _settle(root: Element) -> None:
    """Take the mark from elements that wrap the main part, the only articles, or the title and most of the text."""
    size: dict[int, int] = {}
    holds: dict[int, set[str]] = {}
    order, todo = [], [(root, False)]
    loose_article = False  # an article outside all that is marked
    while todo:
        node, marked = todo.pop()
        if node.furniture and not node.may_wrap:
            continue
        marked = marked or node.furniture
        loose_article = loose_article or (node.name in ("article", "main") and not marked)
        order.append(node)
        todo.extend((c, marked) for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        mine, total = {node.name} & {"article", "main", "h1"}, 0
        for child in node.children:
            if isinstance(child, str):
                total += len(child.strip())
            elif id(child) in size:
                total += size[id(child)]
                mine = mine | holds[id(child)] if holds[id(child)] else mine
        size[id(node)], holds[id(node)] = total, mine
    whole = holds[id(root)]
    for node in order:
        if not (node.furniture and node.may_wrap):
            continue
        mine = holds[id(node)]
        most = "h1" in mine and node.name != "header" and 2 * size[id(node)] > size[id(root)] and not whole & {"article", "main"}
        if "main" in mine or ("article" in mine and (node.name == "form" or not loose_article)) or most:
            node.furniture = False


def parse(page: str) -> Element:
    """The tree of a page; unclosed and misplaced tags are taken as browsers do in the common cases."""
    root = Element("root")
    stack = [root]
    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            stack[-1].children.append(html.unescape(page[at:tag]))
        if tag == size:
            break
        found = _TAG.match(page, tag) or _LOOSE.match(page, tag)
        if found is None:
            if page[tag + 1 : tag + 2].isalpha() or page[tag + 1 : tag + 2] in ("/", "!", "?"):
                break  # a tag that the page's end cuts off
            stack[-1].children.append("<")
            at = tag + 1
            continue
        if found.group(0) == "<!--":
            break  # a comment that is never closed
        at = found.end()
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            _close(stack, name)
            continue
        if stack[-1].name == "head" and name not in IN_HEAD:
            stack.pop()  # its end tag may be left out
        _open_ends(stack, name)
        element = Element(name, stack[-1])
        _mark(element, found.group(3))
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            if end is None:
                break
            at = page.find(">", end.start()) + 1 or size
        elif name not in VOID and not (found.group(3).endswith("/") and name in ("svg", "path")):
            stack.append(element)
    _settle(root)
    return root


def _close(stack: list[Element], name: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if name not in BLOCKS and stack[k].name in BARRIERS:
            return


def _open_ends(stack: list[Element], name: str) -> None:
    ended = ENDS.get(name, set()) | ({"p"} if name in BLOCKS else set())
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in ended:
            del stack[k:]
            return
        if stack[k].name in BARRIERS and not (name in ("tr", "td", "th", "li") and stack[k].name in ended):
            return


def blocks_of(element: Element, drop: frozenset[int] | None = None, hashes: dict[int, int] | None = None) -> list[str]:
    """Texts of the blocks under an element, furniture and dropped subtrees left out."""
    found, parts = [], []

    def end() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append(text)

    todo: list = [element]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node is None:
            end()
        elif node.furniture or (drop and hashes and hashes.get(id(node)) in drop):
            parts.append(" ")
        else:
            is_block = node.name in BLOCKS
            if is_block:
                end()
                todo.append(None)
            elif node.name in ("br", "td", "th", "img"):
                parts.append(" ")
            todo.extend(reversed(node.children))
    end()
    return found


def _main_parts(root: Element) -> list[Element]:
    for name in ("article", "main", "body"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if isinstance(node, str) or node.furniture:
                continue
            if node.name == name:
                found.append(node)
            else:
                todo.extend(reversed(node.children))
        if found:
            return found
    return [root]


def _edges(part: Element) -> set[int]:
    """The elements with which a part begins and ends, as far down as they go."""
    found = set()
    for last in (False, True):
        node = part
        while isinstance(node, Element):
            found.add(id(node))
            shown = (c for c in (reversed(node.children) if last else node.children) if (c.strip() if isinstance(c, str) else not c.furniture))
            node = next(shown, None)
    return found


def subtree_hashes(part: Element) -> dict[int, int]:
    """By the identity of each container that may be a template: a hash of its kind, text and subtree."""
    edges = _edges(part) if part.name in ("article", "main") else None
    hashes: dict[int, int] = {}
    digests: dict[int, bytes] = {}
    todo = [(part, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children if not isinstance(c, str))
            continue
        # The digest of a subtree is made of its children's, so each node is read once.
        digest = hashlib.blake2b(node.name.encode(), digest_size=8)
        for child in node.children:
            digest.update(b"\0" + (" ".join(child.split()).encode() if isinstance(child, str) else digests[id(child)]))
        digests[id(node)] = digest.digest()
        counted = node.name in CONTAINERS or (node.name in LISTED and (edges is None or id(node) in edges))
        if counted and node is not part and not node.furniture:
            hashes[id(node)] = int.from_bytes(digest.digest(), "little", signed=True)
    return hashes


def _own_text(part: Element, hashes: dict[int, int]) -> tuple[int, dict[int, int]]:
    """A sum of hashes over the texts of a part, and how much of it is in the subtrees of each hash; furniture counts nothing."""
    sums: dict[int, int] = {}
    within: dict[int, int] = {}
    todo = [(part, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children if not isinstance(c, str) and not c.furniture)
            continue
        total = 0
        for child in node.children:
            if not isinstance(child, str):
                total += sums.get(id(child), 0)
            elif words := " ".join(child.split()):
                total += int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "little")
        sums[id(node)] = total
        if id(node) in hashes:
            within[hashes[id(node)]] = within.get(hashes[id(node)], 0) + total
    return sums[id(part)], within


def _rests(page: str) -> list[tuple[int | None, int]]:
    """(subtree, hash of the page's main text without it) for each subtree, and (None, hash of the main text)."""
    whole, inside = 0, {}
    for part in _main_parts(parse(page)):
        hashes = subtree_hashes(part)
        total, within = _own_text(part, hashes)
        whole += total
        for subtree in set(hashes.values()):
            inside[subtree] = inside.get(subtree, 0) + within.get(subtree, 0)
    cut = lambda value: (value + (1 << 63)) % (1 << 64) - (1 << 63)
    return [(None, cut(whole)), *[(subtree, cut(whole - part)) for subtree, part in inside.items()]]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows, found, rests = [], [], []
            for k, page in enumerate(part.column("html").to_pylist()):
                mine = _rests(page or "")
                rows += [k] * len(mine)
                found += [subtree for subtree, _ in mine]
                rests += [rest for _, rest in mine]
            kept = [part.column(c).take(pa.array(rows, pa.int64())) for c in ("page_id", "host")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.int64()), pa.array(rests, pa.int64())], ["page_id", "host", "subtree", "rest"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part, texts = batch.slice(at, 200), []
            for page, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist()):
                drop, found = frozenset(template or ()), []
                for piece in _main_parts(parse(page or "")):
                    found += blocks_of(piece, drop, subtree_hashes(piece) if drop else None)
                texts.append("\n\n".join(found))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url):
    """The lower-cased host of a url, or an empty one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(pages: DataFrame, template_pages: int = TEMPLATE_PAGES, template_percent: int = TEMPLATE_PERCENT) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType
    named = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    schema = T.StructType([T.StructField("page_id", kind), T.StructField("host", T.StringType()), T.StructField("subtree", T.LongType()), T.StructField("rest", T.LongType())])
    # Counted are the different texts that a subtree stands next to, of the different texts of the host, so copies of a page count once.
    seen = written_once(named.select("page_id", "host", "html").mapInArrow(_subtrees, schema), "page-subtrees")
    distinct = seen.groupBy("host", "subtree", "rest").agg(F.lit(1).alias("one"))
    of_host = distinct.where("subtree IS NULL").groupBy("host").agg(F.count("*").alias("pages"))
    counts = distinct.where("subtree IS NOT NULL").groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= template_pages)
    often = counts.join(of_host, "host").where(100 * F.col("n") >= template_percent * F.col("pages")).select("host", "subtree")
    often = written_once(often, "template-subtrees")
    hits = seen.join(often, ["host", "subtree"]).groupBy("page_id").agg(F.collect_set("subtree").alias("template"))
    hits = written_once(hits.withColumnRenamed("page_id", "hit_page"), "page-templates")
    joined = named.join(hits, F.col("page_id").eqNullSafe(F.col("hit_page")), "left").select("page_id", "url", "html", "template")
    out = T.StructType([T.StructField("page_id", kind), T.StructField("url", pages.schema["url"].dataType), T.StructField("text", T.StringType())])
    return joined.mapInArrow(_texts, out).withColumn("n_chars", F.length("text").cast("long"))
