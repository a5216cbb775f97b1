import numpy as np
import pyarrow as pa

import quire.llm.context_mixing as cm
from tests.llm.test_context_mixing_batches import some_texts


def test_texts_are_split_together_as_one_by_one():
    texts = some_texts() + ["  a  B\x0b\x0cÉ\x1cd\x85 ", "\x00 \x00x", " ", "\t", "İ ẞ"]
    for col in (pa.array(texts), pa.array(["left out", *texts]).slice(1)):
        words, size = cm.split_texts(col)
        assert words.to_pylist() == [w for t in texts for w in cm.text_words(t)]
        assert size.tolist() == [len(cm.text_words(t)) for t in texts]


def test_a_batch_has_each_word_hashed_once(monkeypatch):
    # hashing and look-ups in Python grow with the distinct words of a batch, not with its words
    asked = []
    hashed = cm.hashed
    monkeypatch.setattr(cm, "hashed", lambda words: (asked.extend(words), hashed(words))[1])
    texts = some_texts()
    model = cm.TextMixer(np.full((1, 1 << cm.DEPTH), 1 / (1 << cm.DEPTH)), 12)
    list(cm._learn_texts(model, cm.Classes({}, np.zeros((0, 0))))([pa.RecordBatch.from_pydict({"text": texts})]))
    assert sorted(asked) == sorted({w for t in texts for w in cm.text_words(t)})


def test_words_of_one_batch_are_numbered_as_those_of_a_list():
    texts, marks = pa.array(some_texts()), {b"the": 0, b"of": 1, b"missing": 2}
    run, met = cm.Running(texts, cm.Tokens(marks)), cm.Met(texts, pa.array(marks, pa.binary()), cm.Codes())
    assert (run.numbers[run.at] == met.numbers[met.at]).all() and (run.known[run.at] == met.known[met.at]).all()
    assert (run.size == met.size).all() and (run.text == met.text).all()


def test_odds_are_made_once_for_all_batches(monkeypatch):
    made = []
    init = cm.Odds.__init__
    monkeypatch.setattr(cm.Odds, "__init__", lambda self, *a: (made.append(1), init(self, *a))[1])
    words, evidence = [b"ab", b"", b"abcde" * 9], np.random.default_rng(2).random((1 << cm.CLASS_BITS, 2)).astype("f4")
    batch = pa.RecordBatch.from_pydict({"word": words, "c": [1, 2, 3]})
    model = cm.Mixer()
    monkeypatch.setattr(cm, "SPELLED", 2)
    got = list(cm._score_words(model, evidence)([batch, batch]))
    assert len(made) == 1 and got[0].equals(got[1])
    words = got[0].column("word").to_pylist()
    odds = cm.class_odds(words, evidence)
    for k in range(2):
        assert np.allclose(got[0].column(f"s{k}").to_numpy(), model.log_probability(words) + odds[:, k])
    assert got[0].column("code").to_pylist() == [cm.word_code(w) for w in words]


def test_beginnings_are_spelled_once_with_the_same_results(monkeypatch):
    rnd = np.random.default_rng(3)
    words = [bytes(rnd.integers(97, 100, n).tolist()) for n in rnd.integers(1, 9, 400)] + [b"", b"ab" * 90, b"ab" * 91]
    words = [*sorted(set(words)), b"c", b"a"]
    batch = pa.RecordBatch.from_pydict({"word": words, "c": [3] * len(words), "c0": [1] * len(words), "c1": [2] * len(words)})
    for segment in (1 << 15, 37):
        monkeypatch.setattr(cm, "SEGMENT", segment)
        model, size = cm.Mixer(), 0
        for byte, hashes, word in cm.segments(words):
            new, of = cm.beginnings(byte, word)
            size += int(new.sum())
            assert (byte[new][of] == byte).all() and (hashes[:, new][:, of] == hashes).all()
            for _, bit, _, slot in cm.bits(byte, hashes):
                for k in range(len(cm.ORDERS)):
                    np.add.at(model.counts[k], (slot[k], bit), 1)
        assert size < .7 * sum(len(w) + 1 for w in words) or segment == 37
        parts = {}
        for b in cm._count_contexts(2)(iter([batch])):
            for part, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts[part] = np.frombuffer(cm.zlib.decompress(sums), "f4")
        got = np.concatenate([parts.get(i, np.zeros(cm.BLOCK, "f4")) for i in range(model.counts.size // cm.BLOCK)])
        assert (got == model.counts.ravel()).all()
        model.freeze()
        scored = next(cm._score_words(model, np.zeros((1 << cm.CLASS_BITS, 1), "f4"))([batch]))
        assert np.allclose(scored.column("s0").to_numpy(), model.log_probability(scored.column("word").to_pylist()))


def test_words_met_once_add_nothing_to_the_routes(spark):
    rows = [(w, c, c, -3.0) for w, c in (("a", 9), ("b", 4), ("c", 2))]
    once = [(f"x{i}", 1, 1, -5.0) for i in range(7)]
    make = lambda r: spark.createDataFrame(r, "word string, c bigint, c0 bigint, s0 double")
    assert np.allclose(cm.route_weights(make(rows + once), [22]), cm.route_weights(make(rows), [22]))
