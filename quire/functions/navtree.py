"""Navigation-tree extraction.

One HTML document in, one row per article link out. Spark has no HTML parser, so this is
the library's one Python stage: `extract` takes whole Arrow batches (`mapInArrow`) inside
the task that holds the documents, after small inputs have been dealt out to all cores;
everything downstream (dedupe, joins) is Spark. For SQL the same parser is a UDTF.

Semantics (matching the original selector-based recursion, emitted once per link):
  * the tree root is the first <ul id="tree"> (configurable);
  * an <li> is a folder when it has ANY descendant <span class="folder">; its name is
    the stripped text of the first such span (so an <li> without its own span takes
    the name of a nested folder);
  * a link <a class="linkMateria"> is emitted when it lies inside a non-folder <li>;
    its path is every folder <li> above that <li> whose FIRST descendant <ul> contains
    it, outermost first (a link in a folder's second <ul> does not get that folder);
  * a link sitting directly in a folder <li> (no non-folder <li> around it) is not
    emitted.
This is the deepest path the original recursion produces for the link; keeping the
deepest row per identifier afterwards (J1) gives the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}

PAGES = 1000  # of which the links are gathered before a batch goes out

NAV_SCHEMA = ("pos int, article_id string, identifier string, title string, protocol string, "
              "href string, hierarchy_path array<string>")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "pre", "post", "text")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children, self.text = [], []
        self.pre = self.post = 0

    def classes(self):
        return (self.attrs.get("class") or "").split()


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#document", {}, None)
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag == "li":  # an open <li> in list-item scope closes implicitly
            for i in range(len(self.stack) - 1, 0, -1):
                t = self.stack[i].tag
                if t == "li":
                    del self.stack[i:]
                    break
                if t in ("ul", "ol"):
                    break
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        node = _Node("#text", {}, self.stack[-1])
        node.text.append(data)
        self.stack[-1].children.append(node)


# Markup that needs no tokenizer state: text, end tags, and start tags whose attributes are all
# name="value"; a page with anything else (comments, scripts, bare < or quotes) goes to the parser.
_PLAIN = re.compile(r"""([^<]+)|</([a-zA-Z][a-zA-Z0-9]*)\s*>|<([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z_][-a-zA-Z0-9_:.]*="[^"]*")*)\s*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)="([^"]*)\"""")
# elements whose content the parser reads in a mode of its own
_RAW_TEXT = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"))


def _parse(html: str) -> _TreeBuilder:
    """The element tree of a page. Plain markup is cut by one pattern; both ways build the
    same tree."""
    b = _TreeBuilder()
    end = 0
    for m in _PLAIN.finditer(html):
        if m.start() != end:
            break
        end = m.end()
        text, close, tag, attrs = m.groups()
        if text is not None:
            b.handle_data(unescape(text) if "&" in text else text)
        elif close is not None:
            b.handle_endtag(close.lower())
        else:
            tag = tag.lower()
            if tag in _RAW_TEXT:
                end = -1
                break
            found = [(k.lower(), unescape(v) if "&" in v else v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else []
            b.handle_starttag(tag, found)
    if end == len(html):
        return b
    b = _TreeBuilder()
    try:
        b.feed(html)
        b.close()
    except Exception:  # malformed input: whatever was parsed so far is used
        pass
    return b


def _number(root):
    """Pre/post order numbers (iterative: deep trees must not hit the recursion limit)."""
    counter = 0
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.post = counter - 1
            continue
        node.pre = counter
        counter += 1
        stack.append((node, True))
        for ch in reversed(node.children):
            stack.append((ch, False))


def _iter(node):
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.children))


def _text(node) -> str:
    """Text of the subtree: every text node stripped, joined without separator."""
    return "".join(t.strip() for n in _iter(node) if n.tag == "#text" for t in n.text)


def _inside(x, anc) -> bool:
    return anc.pre <= x.pre <= anc.post


# What stands between one "<" and the next in plain markup: a tag, and the text behind it.
_PIECE = re.compile(r"""(/?[a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z_][-a-zA-Z0-9_:.]*="[^"]*")*)\s*>(.*)""", re.DOTALL)
_BARE = {}  # pieces without attributes and text: (tag, whether it opens); BARE of them at most
BARE = 1000


def _attributes(attrs: str) -> dict:
    return {k.lower(): unescape(v) if "&" in v else v for k, v in _ATTRIBUTE.findall(attrs)}


@lru_cache(1000)
def _classes(attrs: str) -> frozenset:
    return frozenset((_attributes(attrs).get("class") or "").split())


def _plain_links(html: str, root_tag: str, root_id: str | None, link_class: str | None, folder_class: str) -> list | None:
    """The links of a page of plain markup in one pass over its tags, without a tree: of the
    open elements only an <li> (its first folder span and first <ul> so far), a <ul> (whether it
    is open), a folder span and a link (their text) are remembered. None where a page, or
    the way it is asked for, needs the tree."""
    if root_tag in VOID:
        return None
    tags, recs = [], []  # the open elements and what is remembered of them
    root = None  # place of the tree root among them; -1 once it is closed
    lis, reading, links = [], [], []  # open <li> below the root, texts being read, links so far
    pieces = iter(html.split("<"))
    next(pieces)  # text before the first tag
    for piece in pieces:
        bare = _BARE.get(piece)
        if bare is not None:
            tag, opens = bare
            attrs = text = ""
        else:
            m = _PIECE.fullmatch(piece)
            if m is None:
                return None
            tag, attrs, text = m.groups()
            tag, opens = tag.lower(), tag[0] != "/"
            if not opens:
                if attrs:
                    return None
                tag = tag[1:]
            elif tag in _RAW_TEXT:
                return None
            if not attrs and not text and len(_BARE) < BARE:
                _BARE[piece] = tag, opens
        cut = -1  # the open elements from here on are closed
        if not opens:
            if tags and tags[-1] == tag:
                cut = len(tags) - 1
            elif tag in tags:
                cut = len(tags) - 1 - tags[::-1].index(tag)
        elif tag == "li":  # an open <li> in list-item scope closes implicitly
            for i in range(len(tags) - 1, -1, -1):
                t = tags[i]
                if t == "ul" or t == "ol":
                    break
                if t == "li":
                    cut = i
                    break
        if cut >= 0:
            while len(tags) > cut:
                tags.pop()
                rec = recs.pop()
                if rec is not None:
                    if rec[0] == "li":
                        lis.pop()  # the innermost one
                    elif rec[0] == "ul":
                        rec[1] = False
                    else:
                        reading.pop()  # likewise
            if root is not None and cut <= root:
                root = -1
        if opens:
            rec = None
            if root is None:
                if tag == root_tag and (root_id is None or attrs and _attributes(attrs).get("id") == root_id):
                    root = len(tags)
            elif root >= 0:
                if tag == "li":
                    rec = ["li", None, None, len(tags)]
                    lis.append(rec)
                elif tag == "ul":
                    rec = ["ul", True, len(tags)]
                    for li in reversed(lis):
                        if li[2] is not None:  # then those around it have one too
                            break
                        li[2] = rec
                elif tag == "span":
                    if attrs and folder_class in _classes(attrs):
                        rec = ["text"]
                        reading.append(rec)
                        for li in reversed(lis):
                            if li[1] is not None:
                                break
                            li[1] = rec
                elif tag == "a":
                    found = _attributes(attrs)
                    if not link_class or link_class in (found.get("class") or "").split():
                        rec = ["text"]
                        reading.append(rec)
                        links.append((found, rec, [(li, li[2][2] if li[2] is not None and li[2][1] else None) for li in lis]))
            if tag not in VOID:
                tags.append(tag)
                recs.append(rec)
        if text and reading:
            text = (unescape(text) if "&" in text else text).strip()
            for rec in reading:
                rec.append(text)
    rows = []
    for found, rec, above in links:
        leaf = next((li for li, _ in above if li[1] is None), None)
        if leaf is None:
            continue
        path = []
        for li, ul in above:
            if li is leaf:
                break
            if ul is not None and ul < leaf[3]:
                path.append("".join(li[1][1:]))
        rows.append((len(rows), found.get("data-materia-id", ""), found.get("identificador"), "".join(rec[1:]),
                     found.get("data-protocolo"), found.get("href"), path))
    return rows


def extract_links(html: str | None, root_tag: str = "ul", root_id: str | None = "tree",
                  link_class: str | None = "linkMateria", folder_class: str = "folder"):
    """Yield (pos, article_id, identifier, title, protocol, href, path) per link."""
    if not html:
        return
    rows = _plain_links(html, root_tag, root_id, link_class, folder_class)
    yield from _tree_links(html, root_tag, root_id, link_class, folder_class) if rows is None else rows


def _tree_links(html: str, root_tag: str, root_id: str | None, link_class: str | None, folder_class: str):
    """The same for any page, on its element tree."""
    b = _parse(html)
    _number(b.root)
    root = next((n for n in _iter(b.root) if n.tag == root_tag
                 and (root_id is None or n.attrs.get("id") == root_id)), None)
    if root is None:
        return
    folder_name, first_ul = {}, {}
    pos = 0
    for a in _iter(root):
        if a is root or a.tag != "a" or (link_class and link_class not in a.classes()):
            continue
        lis = []
        p = a.parent
        while p is not None and p is not root:
            if p.tag == "li":
                lis.append(p)
            p = p.parent
        if p is None:
            continue
        lis.reverse()  # outermost first
        for li in lis:
            if id(li) not in folder_name:
                span = next((n for n in _iter(li) if n is not li and n.tag == "span"
                             and folder_class in n.classes()), None)
                folder_name[id(li)] = _text(span) if span is not None else None
                first_ul[id(li)] = next((n for n in _iter(li) if n is not li and n.tag == "ul"), None)
        leaf = next((li for li in lis if folder_name[id(li)] is None), None)
        if leaf is None:
            continue
        path = []
        for li in lis:
            if li is leaf:
                break
            ul = first_ul[id(li)]
            if ul is not None and _inside(leaf, ul):
                path.append(folder_name[id(li)])
        yield (pos, a.attrs.get("data-materia-id", ""), a.attrs.get("identificador"), _text(a),
               a.attrs.get("data-protocolo"), a.attrs.get("href"), path)
        pos += 1


def nav_tree_udtf():
    """The UDTF: nav_tree(html, root_tag, root_id, link_class, folder_class)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=NAV_SCHEMA, useArrow=True)
    class NavTree:
        def eval(self, html, root_tag="ul", root_id="tree", link_class="linkMateria", folder_class="folder"):
            yield from extract_links(html, root_tag or "ul", root_id or None, link_class or None,
                                     folder_class or "folder")

    return NavTree


_UDTF = None


def nav_tree():
    """The UDTF object (created once per process)."""
    global _UDTF
    if _UDTF is None:
        _UDTF = nav_tree_udtf()
    return _UDTF


def register(spark, name: str = "nav_tree"):
    """Register for SQL: ``LATERAL nav_tree(html, 'ul', 'tree', 'linkMateria', 'folder')``."""
    from quire.session import ship_package
    ship_package(spark)
    spark.udtf.register(name, nav_tree())
    return name


def extract(df, html: str = "html", root_tag: str = "ul", root_id: str = "tree",
            link_class: str = "linkMateria", folder_class: str = "folder"):
    """Every document row with each of its links: the columns of ``df`` but ``html``, and those
    of ``NAV_SCHEMA`` behind them."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from quire.functions.rows import deal_out
    from quire.session import ship_package
    ship_package(df.sparkSession)
    keep = [c for c in df.columns if c != html]
    links = StructType.fromDDL(NAV_SCHEMA)
    schema = StructType([df.schema[c] for c in keep] + list(links))
    types = [pa.int32(), *[pa.string()] * 5, pa.list_(pa.string())]
    args = (root_tag or "ul", root_id or None, link_class or None, folder_class or "folder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = batch.column(html)
            for lo in range(0, len(page), PAGES):  # a slice's links at a time: long pages stay small
                at, rows = [], []
                for i, text in enumerate(page.slice(lo, PAGES).to_pylist(), lo):
                    for row in extract_links(text, *args):
                        at.append(i)
                        rows.append(row)
                if at:
                    at = pa.array(at)
                    columns = [batch.column(c).take(at) for c in keep]
                    columns += [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=keep + links.names)
    return deal_out(df).mapInArrow(run, schema)
