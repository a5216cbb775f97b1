"""P8/P9 nav-tree extraction and J1 keep-deepest dedupe (FIXTURES §2, §3)."""

from pyspark.sql import functions as F

from quire.functions.navtree import extract, extract_links
from quire.operators.assemble import dedupe_keep_deepest, duplicates_removed


def tree(inner):
    return '<html><body><ul id="tree">' + inner + "</ul></body></html>"


def links(html):
    return [(r[2], r[3], r[4], r[6]) for r in extract_links(html)]


def test_nested():
    h = tree('<li><span class="folder">A</span><ul><li><span class="folder">B</span><ul><li>'
             '<a class="linkMateria" data-materia-id="1" identificador="X" data-protocolo="P"> T </a>'
             "</li></ul></li></ul></li>")
    assert links(h) == [("X", "T", "P", ["A", "B"])]


def test_root_link():
    assert links(tree('<li><a class="linkMateria" data-materia-id="2" identificador="Y">U</a></li>')) == \
        [("Y", "U", None, [])]


def test_second_ul_does_not_get_folder():
    h = tree('<li><span class="folder">A</span><ul></ul><ul><li><a class="linkMateria" identificador="Z">V</a>'
             "</li></ul></li>")
    assert links(h) == [("Z", "V", None, [])]


def test_link_directly_in_folder_li_is_skipped():
    h = tree('<li><span class="folder">A</span><a class="linkMateria" identificador="W">N</a><ul></ul></li>')
    assert links(h) == []


def test_li_without_own_span_takes_nested_name():
    h = tree('<li><ul><li><span class="folder">B</span><ul><li><a class="linkMateria" identificador="Q">M</a>'
             "</li></ul></li></ul></li>")
    assert links(h) == [("Q", "M", None, ["B", "B"])]


def test_missing_identifier_and_no_tree_and_noise():
    assert links(tree('<li><a class="linkMateria" data-materia-id="9">O</a></li>')) == [(None, "O", None, [])]
    assert links('<ul id="other"><li><a class="linkMateria" identificador="X">x</a></li></ul>') == []
    h = tree('<li><a class="x linkMateria y" identificador="K">k</a><a class="other" identificador="J">j</a></li>')
    assert links(h) == [("K", "k", None, [])]


def test_udtf_lateral_join(spark):
    docs = spark.createDataFrame(
        [(1, tree('<li><span class="folder">A</span><ul><li><a class="linkMateria" identificador="X">t</a>'
                  "</li></ul></li>")), (2, "<p>no tree</p>"), (3, None)], "doc int, html string")
    rows = extract(docs).select("doc", "identifier", "hierarchy_path").collect()
    assert [(r.doc, r.identifier, r.hierarchy_path) for r in rows] == [(1, "X", ["A"])]


def test_dedupe_golden(spark):
    df = spark.createDataFrame([
        ("1", "E2025-001", ["Root"], "Artigo Original", "A-001", 0),
        ("1", "E2025-001", ["Root", "Subfolder"], "Artigo em Subpasta", "A-001", 1),
        ("2", "E2025-001", ["Root"], "Outro Artigo", "B-002", 2),
    ], "article_id string, edition_id string, hierarchy_path array<string>, title string, identifier string, ord int")
    df = df.withColumn("depth", F.size("hierarchy_path"))
    out = {r.identifier: (r.title, r.depth) for r in dedupe_keep_deepest(df, key=("identifier",)).collect()}
    assert out == {"A-001": ("Artigo em Subpasta", 2), "B-002": ("Outro Artigo", 1)}
    assert duplicates_removed(df, key=("identifier",)).first().removed == 1


def test_dedupe_ties_and_keys(spark):
    df = spark.createDataFrame([
        ("X", "E1", ["A"], 0), ("X", "E1", ["C"], 1), ("Y", "E1", ["A"], 2), ("Y", "E2", ["C", "D"], 3),
    ], "identifier string, edition_id string, hierarchy_path array<string>, ord int").withColumn(
        "depth", F.size("hierarchy_path"))
    out = {r.identifier: r.hierarchy_path for r in dedupe_keep_deepest(df, key=("identifier",)).collect()}
    assert out == {"X": ["A"], "Y": ["C", "D"]}
    by_edition = dedupe_keep_deepest(df, key=("edition_id", "identifier")).count()
    assert by_edition == 3


def test_plain_pages_need_no_tree(monkeypatch):
    # one pass over plain markup gives what the element tree gives, and does not build it
    import random

    from quire.functions import navtree as N
    rnd = random.Random(2)
    parts = ['<ul>', '</ul>', '<ul id="tree">', '<li>', '</li>', '<span class="x folder">', '<span>', '</span>', ' t ', '&amp; x',
             '<a class="linkMateria" identificador="7" data-materia-id="a&amp;b" href="u">', '<a>', '</a>', '<br>', '<P>', '</p>', '<ol>', '</ol>']
    odd = ['<!-- c -->', '<script>x</script>', '< b', '</a x="y">', '<li y=3>']
    pages = ['<ul id="tree">' + "".join(rnd.choices(parts + (odd if k % 5 == 0 else []), k=rnd.randrange(1, 45))) for k in range(4000)]
    ways = [("ul", "tree", "linkMateria", "folder"), ("ul", None, None, "folder"), ("li", None, None, "folder")]
    want = [list(N._tree_links(p, *w)) for p in pages for w in ways]
    assert [list(N.extract_links(p, *w)) for p in pages for w in ways] == want and any(r[6] for x in want for r in x)
    monkeypatch.setattr(N, "_parse", None)
    plain = '<ul id="tree"><li><span class="folder">F</span><ul><li><a class="linkMateria" identificador="1">t</a></li></ul></li></ul>'
    assert [r[6] for r in N.extract_links(plain)] == [["F"]]
