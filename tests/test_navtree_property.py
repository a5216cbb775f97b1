"""P8/P9 property: emitting each link once with its deepest folder path equals the
brute-force expansion (every `li` below a folder's first `ul` is visited with that
folder appended; every link inside a non-folder `li` is emitted with the current path)
followed by keep-deepest per identifier, ties to the first emission."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import navtree as N


def _desc(node, tag, cls=None):
    return [n for n in N._iter(node) if n is not node and n.tag == tag and (cls is None or cls in n.classes())]


def brute_force(html):
    b = N._TreeBuilder()
    b.feed(html)
    b.close()
    N._number(b.root)
    root = next((n for n in N._iter(b.root) if n.tag == "ul" and n.attrs.get("id") == "tree"), None)
    out = []
    if root is None:
        return out

    def visit(li, path):
        spans = _desc(li, "span", "folder")
        if spans:
            uls = _desc(li, "ul")
            if uls:
                for sub in _desc(uls[0], "li"):
                    visit(sub, path + [N._text(spans[0])])
        else:
            for a in _desc(li, "a", "linkMateria"):
                out.append((a.attrs.get("identificador"), list(path)))

    for li in _desc(root, "li"):
        visit(li, [])
    best = {}
    for ident, path in out:
        if ident not in best or len(path) > len(best[ident]):
            best[ident] = path
    return best


def once(html):
    best = {}
    for pos, _, ident, _, _, _, path in N.extract_links(html):
        if ident not in best or len(path) > len(best[ident][1]):
            best[ident] = (pos, path)
    return {k: v[1] for k, v in best.items()}


names = st.sampled_from(["A", "B", "C", "D"])
idents = st.sampled_from(["x1", "x2", "x3", "x4", "x5"])


@st.composite
def items(draw, depth=0):
    kind = draw(st.sampled_from(["link", "folder", "folder", "bare", "two_ul"]) if depth < 3 else st.just("link"))
    if kind == "link":
        return f'<li><a class="linkMateria" identificador="{draw(idents)}">t</a></li>'
    kids = "".join(draw(st.lists(items(depth + 1), min_size=0, max_size=3)))
    if kind == "folder":
        return f'<li><span class="folder">{draw(names)}</span><ul>{kids}</ul></li>'
    if kind == "two_ul":
        more = "".join(draw(st.lists(items(depth + 1), min_size=0, max_size=2)))
        return f'<li><span class="folder">{draw(names)}</span><ul>{kids}</ul><ul>{more}</ul></li>'
    return f"<li><ul>{kids}</ul></li>"  # li without its own span


@settings(max_examples=1000, deadline=None)
@given(st.lists(items(), min_size=1, max_size=4))
def test_once_equals_brute_force(tops):
    html = '<html><body><ul id="tree">' + "".join(tops) + "</ul></body></html>"
    assert once(html) == brute_force(html)
