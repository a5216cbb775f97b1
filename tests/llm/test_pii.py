import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quire.llm.pii import KINDS, LABELS, Graph, Model, added_spans, base_spans, beliefs, find, mask, redact, shape

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 14 <= len(d) <= 19 and slow_luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]():
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(9)
    parts = ["a@b.c", "@", "x.y+z@mail", ".com", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "1", ".", "4111 1111-1111 1111",
             "4111111111111112", "+1 (658) 555-3225", "+", "(", " ", "-", "é", "12345678901234", "_", "\n", "+44.20.7946.0958", "٣"]
    for _ in range(20000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(1, 9)))
        assert base_spans(t) == slow_base(t), t
    for t in ("1" * 20000, "a" * 200000, "1." * 50000, "a@" * 50000, "+1" + "." * 50000, "1 " * 50000, ".@." * 30000):
        base_spans(t)  # linear: ends at once


def test_beliefs_are_exact_on_trees():
    rng = np.random.default_rng(1)
    unary, pair = rng.normal(size=(5, 5)), rng.normal(size=(2, 5, 5))
    edges = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 0), (3, 4, 1)])
    want = np.zeros((5, 5))
    for ys in itertools.product(range(5), repeat=5):
        s = np.exp(sum(unary[i, y] for i, y in enumerate(ys)) + sum(pair[k, ys[i], ys[j]] for i, j, k in edges))
        for i, y in enumerate(ys):
            want[i, y] += s
    want /= want.sum(1, keepdims=True)
    assert np.abs(beliefs(unary, edges, pair, 200) - want).max() < 1e-4


def model():
    card, weak = shape("4111111111111111"), shape("411111111111")
    return Model([(0, card, 3, 900), (0, card, 0, 30), (0, weak, 0, 60), (0, weak, 3, 50), (0, shape("7"), 0, 5000),
                  (2, 3, 3, 400), (2, 0, 0, 400), (1, 0, 0, 300)])


def test_skip_edges_spread_a_label_over_the_document():
    bad = "4111 1111 1111"  # no base span: 12 digits
    text = f"pay 411111111111 now. {'word ' * 50}again 411111111111, please 4111111111111111."
    base = base_spans(text)
    assert [k for *_, k in base] == ["card"] and bad
    m = model()
    assert added_spans(text, base, m, .9) == []  # two uncertain tokens alone
    g = Graph("4111111111111111 x 4111-1111-1111-1111 y 4111111111111111", [])
    assert sorted(map(tuple, g.edges)) == [(0, 1, 1), (1, 2, 1)]
    u = m.unary(Graph("411111111111 a 411111111111", []))
    apart = beliefs(u, np.zeros((0, 3), int), m.pair)[:, 3]
    u[0] = [-9, -9, -9, 0, -9]  # one occurrence is certain
    tied = beliefs(u, np.array([(0, 1, 1)]), m.pair)[:, 3]
    assert tied[1] > .95 > apart[1]


def test_rows_nulls_and_training(spark, frame):
    rnd = random.Random(2)
    cards = ["4785380592391139", "4587121519400672", "4033858070449578", "4503905691731149"]
    rows = [(i, f"pay with {rnd.choice(cards)} or mail me.{i}@x.org from {rnd.randrange(256)}.1.2.3 call +1 (658) 555-{rnd.randrange(1000, 9999)} ok")
            for i in range(300)]
    rows += [(300 + i, f"room {i} has 3 beds and 12 chairs.") for i in range(300)]
    rows += [(700, "broken 4785380592391138 here and 4785380592391138 there"), (701, None), (702, ""), (None, "x@y.zz"), (701, "dup")]
    df = frame(rows).withColumn("base", F.lit("clash")).withColumn("spans", F.lit(1))
    out = {r.doc_id: r for r in find(df).collect()}
    for i, t in rows[:600]:
        assert out[i].base == ",".join(f"{k}:{a}:{b}" for a, b, k in slow_base(t))
        assert out[i].n_added == 0 and out[i].spans == out[i].base
    assert out[700].base == "" and out[700].spans == "card:7:23,card:33:49"
    assert out[702].spans == "" and out[None].spans == "email:0:6"
    red = redact(df)
    assert red.columns == df.columns
    got = {r.doc_id: r for r in red.where("doc_id is not null").collect()}
    assert got[0].text.startswith("pay with [CARD] or mail [EMAIL] from [IP] call [PHONE] ok") and got[0].n_chars == len(got[0].text)
    assert got[300].text == rows[300][1] and got[300].n_chars is None
    assert find(df.where("false")).count() == 0
    assert mask("ab cd", [(0, 2, "ip"), (1, 4, "card")]) == "[IP]d"
    assert LABELS[0] == "other"


def phones():
    """As a corpus of phone numbers that mostly repeat as they are would train it."""
    rows = [(0, shape(t), 4, 900) for t in ("+1", "(017)", "555-7713")]
    return Model([*rows, (0, shape("7"), 0, 5000), (0, shape("0175557713"), 0, 60), (0, shape("017-555-7713"), 0, 60),
                  (0, shape("017"), 0, 500), (1, 4, 4, 600), (1, 0, 0, 300), (2, 4, 4, 2000), (2, 0, 0, 2000)])


def test_skip_links_cross_token_borders():
    for other in ("017-555-7713", "0175557713", "10175557713", "(017) 555-7713"):
        text = f"call +1 (017) 555-7713 now {'word ' * 50}or {other} later"
        at = text.index(other, 30)
        got = added_spans(text, base_spans(text), phones())
        assert any(k == "phone" and a < at + len(other) and b >= at + len(other) for a, b, k in got), other
    g = Graph("+10175557713 a 0175557713 b 5557713 c 8880175557713", [])
    assert sorted(len(at) for _, at in g.hubs) == [3, 4]  # by suffix; the longest have one place
    assert Graph("+1 (017) 555-7713 a 12 b", []).hubs == []


def test_all_mentions_are_tied_to_the_only_base_span():
    other, n = "017-555-7713", 200
    for text in ("+1 (017) 555-7713 a " + f"{other} b " * n, f"{other} b " * n + "a +1 (017) 555-7713"):
        got = [x for x in added_spans(text, base_spans(text), phones()) if x[2] == "phone"]
        assert len(got) == n
    one = beliefs(np.log([[.5, .5], [.5, .5]]), np.array([(0, 1, 0)]), np.log([[[.9, .1], [.1, .9]]]))
    assert np.abs(one - .5).max() < 1e-9
    chain = np.array([(i, i + 1, 0) for i in range(80)])
    u = np.zeros((81, 2))
    u[0, 0] = -9
    assert beliefs(u, chain, np.log([[[.999, .001], [.001, .999]]]))[80, 1] > .9  # 80 hops


def test_long_texts_of_numbers_end_soon_in_little_memory():
    """A megabyte of single digits, of one digit, of equal pairs, and with a base span of zeros."""
    import resource
    import time
    rng = random.Random(1)
    m = model()
    texts = [" ".join(rng.choices("0123456789", k=500_000)), "0 " * 500_000, "00 " * 300_000, "12 34 " * 160_000,
             "0 " * 300_000 + "00000000000000", " ".join(f"{rng.randrange(10**8):08d}" for _ in range(110_000))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for t in texts:
        start = time.monotonic()
        added_spans(t, base_spans(t), m)
        assert time.monotonic() - start < 40
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # of all six


def test_runs_are_tied_without_a_base_span():
    broken = "4785 3805 9239 1138"  # fails the checksum
    g = Graph(f"{broken} a {broken} b 1138", [])
    assert [at for same, at in g.hubs if same] == [[(0, 3), (4, 7)]]
    assert Graph("1 2 3 4 5 6 7 a 1 2 3 4 5 6 7", []).hubs == []  # seven tokens, no anchor
    assert [len(at) for _, at in Graph("1 2 3 4 5 6 7 a 1234567", []).hubs] == [2]
