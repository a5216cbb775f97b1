import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from quire.llm.order_minhash import fingerprint_edits, likeness, signature, to_text

MASK = (1 << 64) - 1


def xx(parts, seed=42):
    for p in parts:
        b = p if isinstance(p, bytes) else p[0].to_bytes(p[1], "little", signed=True)
        seed = xxhash.xxh64(b, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def top33(h):
    return (h & MASK & ~(1 << 63)) >> 30


def slow_signature(text, k=2, ell=2, bins=64):
    words = (text or "").encode().split()
    if not words:
        return []
    if len(words) < 10:
        words, k = [c.encode() for c in text.strip(" \t\n\x0b\x0c\r")], 4
    h = [xx([w]) for w in words]
    km = [xx([(v, 8) for v in h])] if len(h) < k else [xx([(v, 8) for v in h[i:i + k]]) for i in range(len(h) - k + 1)]
    seen, items = {}, []
    for pos, v in enumerate(km):
        t = top33(v)
        o = seen[t] = seen.get(t, -1) + 1
        items.append((top33(xx([(t, 8)] if o == 0 else [(t, 8), (o, 4)])), pos))
    items.sort()
    out = []
    for b in range(bins):
        at = next((i for i, x in enumerate(items) if x[0] >> (33 - (bins.bit_length() - 1)) >= b), 0)
        win = [items[(at + j) % len(items)] for j in range(min(ell, len(items)))]
        d = xx([(v, 8) for v, _ in sorted(win, key=lambda x: x[1])])
        out.append(b << 24 | d & 0xFFFFFF)
    return out


def slow_likeness(a, b):
    used = len({x >> 24 for x in a} | {x >> 24 for x in b})
    return len(set(a) & set(b)) / used if used else 1.0


def texts(seed=2):
    rnd = random.Random(seed)
    vocab = [f"w{i}é" for i in range(30)]
    t = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 9, 60, 300]))) for _ in range(25)]
    return t + ["", None, " \n\t", "a", "a " * 3000, "x\x0by", "one two", "one two", t[0], t[0]]


def test_against_brute_force(spark, frame):
    ts = texts()
    rows = [(i * 2, t) for i, t in enumerate(ts)]
    out = {r.doc_id: r for r in fingerprint_edits(frame(rows)).withColumn("f", to_text(F.col("sig"))).collect()}
    assert len(out) == len(rows)
    for i, t in enumerate(ts):
        t, nxt = t or "", ts[(i + 1) % len(ts)] or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        r = out[i * 2]
        assert (r.text, r.edited) == (t, edited)
        assert list(r.sig) == slow_signature(t)
        assert list(r.edited_sig) == slow_signature(edited)
        assert abs(r.near_edited - slow_likeness(slow_signature(t), slow_signature(edited))) < 1e-12
        assert abs(r.near_next - slow_likeness(slow_signature(t), slow_signature(nxt))) < 1e-12
        assert r.f == "".join(f"{x:08x}" for x in slow_signature(t))
    assert out[0].f == out[2 * (len(ts) - 1)].f  # equal texts


def test_order_matters_and_likeness_falls_with_edits(spark):
    rnd = random.Random(4)
    a = [f"t{i}" for i in range(600)]
    blocks = [a[i:i + 20] for i in range(0, 600, 20)]
    rnd.shuffle(blocks)
    moved = [w for b in blocks for w in b]  # nearly the same k-mers, other order
    few = [w if rnd.random() > .03 else "zz" for w in a]
    many = [w if rnd.random() > .4 else "zz" for w in a]
    df = spark.createDataFrame([(" ".join(a), " ".join(x)) for x in (a, few, many, moved)], "a string, b string")
    same, few, many, moved = [r[0] for r in df.select(likeness(signature(F.col("a")), signature(F.col("b")))).collect()]
    assert same == 1 and few > .7 and many < .4 and moved < .75 < 1


def test_repeated_rows_null_ids_and_clashing_columns(spark, frame):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "e f g h i"), (1, "p q r s t u v w"), (3, "other text of three")]
    df = frame(rows).withColumn("kid", F.lit("x")).withColumn("th", F.lit(1)).withColumn("sig", F.lit(None))
    out = fingerprint_edits(df).collect()
    assert len(out) == 5
    assert len({(r.doc_id, r.edited) for r in out if r.text == "a b c d"}) == 1
    assert [r.next_id for r in out if r.doc_id is None] == [1]
    assert fingerprint_edits(df.where("false")).count() == 0


def test_native_plan(frame):
    df = fingerprint_edits(frame([(1, "a b c"), (2, "d e f")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert hashlib.sha256(b"").hexdigest()


def test_order_counts_in_short_texts(spark):
    """The same words: a passage moved (far in edit distance) against a word replaced (near)."""
    rnd = random.Random(7)
    pairs = []
    for n in (20, 60, 120):
        for r in range(60):
            w = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
            near = list(w)
            near[rnd.randrange(n)] = "other"
            pairs.append((n, " ".join(w), " ".join(w[n // 2:] + w[:n // 2]), " ".join(near)))
    df = spark.createDataFrame(pairs, "n int, a string, moved string, near string")
    sig = {c: signature(F.col(c)) for c in ("a", "moved", "near")}
    got = {r.n: r for r in df.select("n", likeness(sig["a"], sig["moved"]).alias("m"), likeness(sig["a"], sig["near"]).alias("e"))
           .groupBy("n").agg(F.avg("m").alias("m"), F.avg("e").alias("e")).collect()}
    for n, r in got.items():
        assert r.m < .6 < r.e and r.e > r.m + .2, (n, r.m, r.e)  # moved halves keep all k-mers but one, as a set


def test_a_text_without_spaces_survives_an_edit(spark):
    rnd = random.Random(8)
    t = "".join(rnd.choice("abcdefgh\u4e2d\U0001f600") for _ in range(400))
    df = spark.createDataFrame([(t, t[:200] + "z" + t[201:], t[::-1])], "a string, b string, c string")
    r = df.select(likeness(signature(F.col("a")), signature(F.col("b"))).alias("e"), likeness(signature(F.col("a")), signature(F.col("c"))).alias("o")).first()
    assert r.e > .8 and r.o < .2
