import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from quire.llm import filter_audit as X
from quire.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle_check import compare, duck_connect

COLUMNS = "doc_id bigint, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
                             ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)),
                             ("D", bool(re.search(r"[#$%&*|]", text)))) if bad}


def brute(rows, labels):
    """Walk every document through every order."""
    docs = []
    for i, text, part in rows:
        f = fails(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows):
            f.add("E")
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", f, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            here = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in here if f in d[1]]
                here = [d for d in here if f not in d[1]]
                mine = [d for d in docs if d[0] == part and f in d[1]]
                out[part, "".join(order), step] = (
                    len(here), len(gone), len(mine) - len(gone), sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, frame, rows, labels):
    docs = frame([(i, t, "en", p) for i, t, p in rows])
    return X.audit(docs, spark.createDataFrame(labels, COLUMNS))


def test_matches_brute_force(spark, frame):
    rng = random.Random(3)
    def text():
        t = " ".join(rng.choice(["word", "Ab", "x"]) + str(rng.randrange(rng.choice([20, 400]))) for _ in range(rng.choice([5, 49, 50, 90])))
        return rng.choice([t, t.upper(), t + " #", "", None, "same text", t + "\u00c9\u00a0x"])
    rows = [(rng.choice([i, i, i, None]), text(), rng.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [(7, "same text", "a")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = [tuple(r) for r in run(spark, frame, rows, labels).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, labels)


def test_query_matches_sql(spark, sf_small):
    r = compare(spark, "op13_filter_audit", QUERIES["op13_filter_audit"], ORACLE_SQL["op13_filter_audit"], sf_small, duck_connect(sf_small))
    assert r["ok"], r.get("why")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000, 4097])
def test_carry_save_counts_are_exact(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    want = ((words[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(0)
    assert (X.positional_popcount(words) == want).all()


def test_survival_words():
    for mask in range(32):
        word = int(X.survival_word(np.array([mask]))[0])
        assert word == sum(1 << s for s in range(32) if not s & mask)


def test_empty_tables_clashing_columns_and_long_texts(spark, frame):
    assert run(spark, frame, [], [(1, 1, 1)]).count() == 0
    docs = spark.createDataFrame([(1, "w " * 2_000_000, "p", 9, "k", True)], "doc_id bigint, text string, source string, fails int, key string, good boolean")
    got = X.audit(docs, spark.createDataFrame([(1, 1, 0, "x")], COLUMNS + ", part string")).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.removed, r.good_lost, r.toxic_lost, r.shapley) for r in got] == [(1, 1, 0, 120)] + [(0, 0, 0, 0)] * 4
    assert [r.kept for r in run(spark, frame, [(1, None, None)], []).where("filter_order = 'EDCBA'").orderBy("step").collect()] == [1, 1, 1, 1, 0]
