import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import quire.llm.context_mixing as cm
from quire.llm.context_mixing import Mixer, score_texts, text_words, train_mixer


def slow_base(rows):
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    c = Counter(w for i, t in rows if learn(i) for w in text_words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = text_words(t)
        out.append((i, not learn(i), len(w), sum(c[x] > 0 for x in w), n,
                    sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w)))
    return out


def corpus(n=400, seed=3):
    rnd = random.Random(seed)
    syl = ["ka", "lo", "mi", "nu", "per", "ra", "si", "to", "ve", "é"]
    common = ["the", "of", "and", "in"] * 4
    def word():
        return rnd.choice(common) if rnd.random() < .4 else "".join(rnd.choices(syl, k=rnd.randrange(1, 5)))
    return [(i, " ".join(word() for _ in range(rnd.randrange(1, 60))).capitalize() + ".") for i in range(n)]


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(got, sorted(slow_base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    return got


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = [r for r in check(score_texts(docs).collect(), rows) if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_base_and_both_ways_to_a_word(spark, frame, monkeypatch):
    rows = corpus() + [(500, None), (501, ""), (None, "of é\x85 \x00"), (None, None), (503, "z" * 70000), (504, "A a a\ta"), (504, "A a a\ta")]
    df = frame(rows).withColumn("word", F.lit(1)).withColumn("rest", F.lit("x")).withColumn("score", F.lit(2))
    got = check(score_texts(df).collect(), rows)
    assert all(r[6] < 0 for r in got)
    # the join serves the words that are not broadcast: the same results
    monkeypatch.setattr(cm, "TOP", 5)
    again = check(score_texts(df).collect(), rows)
    assert np.allclose([r[6] for r in got], [r[6] for r in again])


def test_spelling_is_a_probability(spark):
    words = [(w, 1, 1) for w in {x for _, t in corpus(100) for x in text_words(t)}]
    m, _ = train_mixer(spark.createDataFrame(words, "word binary, c bigint, c0 bigint").repartition(3))
    # the 256 bytes that may follow a prefix: as words that end there, or as longer ones
    for prefix in (b"", b"ka", b"kal", b"\xc3"):
        short = m.log_probability([prefix])[0]  # prefix and its closing space
        base = m.log_probability([prefix + bytes([x]) for x in range(256) if x != 32])
        closed = []
        for x in range(256):  # the chain of bits after a prefix sums to one
            if x == 32:
                continue
            w = prefix + bytes([x])
            close = last_byte(m, w + b" ", len(w))
            closed.append(base[len(closed)] - close)
        rest = chain(m, prefix)
        assert abs(np.exp(np.array(closed) - rest).sum() + np.exp(short - rest) - 1) < 1e-6


def last_byte(m, spelled, at):
    """Log probability of the byte at ``at`` of a spelled word, by hand."""
    out = 0.0
    for byte, hashes, _ in cm.segments([spelled[:-1]]):
        for b, bit, node, slot in cm.bits(byte[at:at + 1], hashes[:, at:at + 1]):
            p = m.refined(m.mix(b, *m.inputs(slot)), node)[0]
            out += math.log(p if bit[0] else 1 - p)
    return out


def chain(m, prefix):
    return sum(last_byte(m, prefix + b" ", i) for i in range(len(prefix)))


def test_counts_leave_one_out_and_long_words_in_segments(monkeypatch):
    m = Mixer()
    words = [b"abc", b"abd", b"", b"x" * 100]
    a = m.log_probability(words)
    assert np.allclose(a, [-8 * (len(w) + 1) * math.log(2) for w in words])  # untrained: a bit for a bit
    for byte, hashes, _ in cm.segments(words):
        for _, bit, _, slot in cm.bits(byte, hashes):
            for k in range(len(cm.ORDERS)):
                np.add.at(m.counts[k], (slot[k], bit), 1)
    m.freeze()
    byte, hashes, _ = next(cm.segments([b"abc"]))
    b, bit, _, slot = next(cm.bits(byte[2:3], hashes[:, 2:3]))
    x, state = m.inputs(slot, bit)  # "ab" was met twice, once is left
    assert state[0] == len(cm.ORDERS) and abs(abs(x[1, 0]) - math.log(1.2 / .2)) < 1e-5
    whole = m.log_probability(words)
    monkeypatch.setattr(cm, "SEGMENT", 7)
    assert np.allclose(whole, m.log_probability(words))


def test_classes_are_found_and_told(spark):
    rnd = random.Random(1)
    langs = [[f"{p}{i}" for i in range(40)] for p in "abc"]
    rows = [(" ".join(rnd.choices(langs[i % 3], k=40)),) for i in range(300)]
    found = cm.find_classes(spark.createDataFrame(rows, "text string").repartition(4))
    told = [found(set(text_words(t))) for (t,) in rows]
    assert all(len({told[i] for i in range(300) if i % 3 == k} & {told[i] for i in range(300) if i % 3 == j}) == 0
               for k in range(3) for j in range(k))
    evidence = np.zeros((1 << cm.CLASS_BITS, 2), np.float32)
    odds = cm.class_odds([b"abc", b""], evidence)
    assert np.abs(odds).max() < 1e-6


def test_nothing_to_learn_from_and_empty(spark, frame):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = score_texts(frame([(held, "ab c")])).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert abs(r.score + 8 * 6 * math.log10(2)) < 1e-6
    assert score_texts(frame([(1, "x")]).where("false")).count() == 0


def trained(texts, slots=12, told=None):
    """A text mixer that has seen ``texts``, stretch by stretch."""
    m = cm.TextMixer(np.full((2, 1 << cm.DEPTH), 1 / (1 << cm.DEPTH)), slots)
    numbers = [cm.Tokens()(text_words(t)) for t in texts]
    for code, ctx, kind, _ in m.parts(numbers, told or [i % 2 for i in range(len(texts))]):
        m.learn(code, ctx, kind)
        m.count(code, ctx)
    m.freeze()
    return m


def slow_gain(m, text, kind):
    """Word by word, bit by bit, from the definition."""
    words, out = text_words(text), 0.0
    h = [int(x) for x in cm.Tokens()(words)]
    shorts = [i for i, w in enumerate(words) if 0 < len(w) <= cm.SHORT]
    p, q, r, full = int(cm._P), int(cm._Q), int(cm._R), (1 << 64) - 1
    for i, w in enumerate(words):
        before = [j for j in shorts if j < i]
        one = h[before[-1]] if before else 7
        two = h[before[-2]] if len(before) > 1 else 9
        ctx = [((h[i - 1] if i else 1) + 1) * p & full, (one + 5) * q & full, ((one * p + two + 11) & full) * r & full]
        code = cm.word_code(w)
        for b in range(cm.DEPTH):
            node, bit = (1 << b) | (code >> (cm.DEPTH - b)), code >> (cm.DEPTH - 1 - b) & 1
            p0 = float(m.one[(kind << cm.DEPTH) + node])
            s, state, s0 = 0.0, 0, math.log(p0 / (1 - p0))
            xs = []
            for k, c in enumerate(ctx):
                slot = ((c ^ (node * q & full)) * r & full) >> (64 - m.slots)
                n0, n1 = m.counts[k][2 * slot:2 * slot + 2]
                xs.append(math.log((n1 + p0) / (n0 + 1 - p0)) - s0)
                state = state * 3 + (n0 + n1 > 0) + (n0 + n1 >= 4)
            s = min(max(s0 + sum(float(m.weights[b, state, k]) * x for k, x in enumerate(xs)), -8), 8)
            at = (s + 8) / 16 * (cm.BUCKETS - 1)
            low = min(int(at), cm.BUCKETS - 2)
            prob = (1 / (1 + math.exp(-s)) + m.refine[b, low] * (1 - at + low) + m.refine[b, low + 1] * (at - low)) / 2
            out += math.log(prob / p0 if bit else (1 - prob) / (1 - p0))
    return out


def test_what_the_order_gains_against_brute_force(monkeypatch):
    texts = [t for _, t in corpus(60)] + ["", None, "z " * 300, "of"]
    monkeypatch.setattr(cm, "SEGMENT", 101)  # stretches end inside texts
    m = trained(texts)
    told = [i % 2 for i in range(len(texts))]
    got = m.gain([cm.Tokens()(text_words(t)) for t in texts], told)
    want = [slow_gain(m, t, k) for t, k in zip(texts, told, strict=True)]
    assert np.abs(got - want).max() < 1e-3 and got.max() > 1


def test_codes_after_any_words_are_a_probability():
    m = trained([t for _, t in corpus(80)])
    ends = {}
    for w in (bytes((a, b)) for a in range(33, 127) for b in range(33, 127)):  # a word for each code
        ends.setdefault(cm.word_code(w), w)
    first = text_words("the of kalo")[:-1]
    n = cm.Tokens()
    gains = m.gain([n([*first, w]) for w in ends.values()], [0] * len(ends)) - m.gain([n(first)], [0])
    p0 = 1 / (1 << cm.DEPTH)
    assert len(ends) == 1 << cm.DEPTH and abs((np.exp(gains) * p0).sum() - 1) < 1e-4


def test_the_order_of_words_counts(spark, frame):
    rnd = random.Random(5)
    nouns = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "per") for b in ("ra", "si", "to", "ve")]
    def text(k):
        return " ".join(x for _ in range(30) for x in (("un", rnd.choice(nouns) + "a") if rnd.random() < .5 else ("le", rnd.choice(nouns) + "o")))
    rows = [(i, text(i)) for i in range(400)]
    mixed = [(1000 + i, " ".join(rnd.sample(t.split(), len(t.split())))) for i, t in rows]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    mixed = [(i, t) for i, t in mixed if i - 1000 in held and zlib.crc32(str(i).encode()) % 5 == 1]
    got = {r.doc_id: r for r in score_texts(frame(rows + mixed)).collect()}
    gap = [got[i - 1000].score - got[i].score for i, _ in mixed]
    assert len(gap) > 5 and min(gap) > 3 and all(abs(got[i].base_score - got[i - 1000].base_score) < 1e-6 for i, _ in mixed)


def test_weights_learn_from_every_stretch(monkeypatch):
    # every word of every text, however many stretches they fill, moves the weights
    seen = []
    learn = cm.TextMixer.learn
    monkeypatch.setattr(cm.TextMixer, "learn", lambda self, code, ctx, kind: (seen.append(len(code)), learn(self, code, ctx, kind))[1])
    monkeypatch.setattr(cm, "SEGMENT", 64)
    texts = [t for _, t in corpus(200)]
    model = cm.TextMixer(np.full((1, 1 << cm.DEPTH), 1 / (1 << cm.DEPTH)), 12)
    classes = cm.Classes({}, np.zeros((0, 0)))
    list(cm._learn_texts(model, classes)([pa.RecordBatch.from_pydict({"text": texts[:120]}), pa.RecordBatch.from_pydict({"text": texts[120:]})]))
    tokens = sum(len(text_words(t)) for t in texts)
    assert sum(seen) == tokens
    # the adaptive map has every bit of every word
    assert round(float(model.sums.sum())) == tokens * cm.DEPTH
