import random

import xxhash

from quire.llm.simhash import block_masks, dedup, hex16, near_links, simhash, simhash_groups
from pyspark.sql import functions as F


def slow_simhash(text, k=4):
    words = bytes(text or "", "utf-8").lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fs = list(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 40, 400]))]
        rows.append(" ".join(words))
        for _ in range(rnd.randrange(3)):  # near copies
            w = list(words)
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append("\t".join(w) if rnd.random() < .3 else " ".join(w).upper())
    rows += ["", None, "  \n", rows[0], rows[0], "x " * 30000, "É é A a"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def expected(rows):
    fp = {i: slow_simhash(t) for i, t in rows}
    comp = slow_components(set(fp.values()))
    least = {}
    for i, f in fp.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    return {i: (f"{f:016x}", least[comp[f]]) for i, f in fp.items()}


def test_fingerprint_against_definition():
    for _, t in corpus(3):
        assert simhash(t) == slow_simhash(t)
    assert simhash("A b\x85c") == slow_simhash("a b\x85c")  # 0x85 is no space here


def test_groups_match_brute_force(spark, frame):
    rows = corpus()
    g = simhash_groups(frame(rows))
    got = {r.doc_id: (r.h, r.component_id) for r in g.select("doc_id", hex16(F.col("fp")).alias("h"), "component_id").collect()}
    assert got == expected(rows)


def test_hot_blocks_are_split_without_losing_links(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = {base}
    cur = base
    for _ in range(300):  # a ball of near fingerprints, and a long chain
        f = base
        for b in rnd.sample(range(64), rnd.randrange(1, 7)):
            f ^= 1 << b
        fps.add(f)
        cur ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
        fps.add(cur)
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    from quire.llm.components import connected_components
    df = spark.createDataFrame(signed, "fp bigint")
    want = slow_components(fps)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    for chunk in (16, 4096):
        links = near_links(df, chunk=chunk)
        got = {}
        for r in connected_components(links).collect():
            got.setdefault(r.root, {r.root % (1 << 64)}).add(r.node % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_masks_cover_every_close_pair():
    masks = [m % (1 << 64) for m in block_masks(6, 4)]
    rnd = random.Random(1)
    for _ in range(500):
        d = 0
        for b in rnd.sample(range(64), 4):
            d |= 1 << b
        assert any(d & m == 0 for m in masks)


def test_dedup_keeps_one_row_and_clashing_columns(spark, frame):
    rows = [(5, "a b c d e f", "en", "fp"), (2, "A b c d e f", "en", None), (None, "a b c d e f", "en", "s"),
            (9, "other words go here now", "de", "s"), (9, "other words go here now", "de", "s"),
            (None, "q r s t u v w", None, None), (None, "q r s t u v w", None, None), (7, "", "en", "s"), (8, None, "en", "s")]
    df = frame(rows).withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1)).withColumn("_n", F.lit(3))
    out = dedup(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(2, "A b c d e f"), (9, "other words go here now"), (None, "q r s t u v w"), (7, "")], key=str)
    assert dedup(df.where("false")).count() == 0
