import random

import numpy as np
import pyarrow as pa

import quire.llm.context_mixing as cm


def some_texts(n=300, seed=4):
    rnd = random.Random(seed)
    words = ["the", "of", "Un", "é", "kalo", "x" * 40, *(f"w{i}" for i in range(200))]
    return [" \t".join(rnd.choices(words, k=rnd.randrange(0, 40))) for _ in range(n)] + ["", None, "  of\x0bthe\r "]


def test_texts_are_read_together_as_one_by_one(monkeypatch):
    texts = some_texts()
    marks = {b"the": 0, b"of": 1, b"un": 2, b"missing": 3}
    company = np.random.default_rng(1).random((4, 4))
    classes = cm.Classes(marks, company + company.T, classes=2)
    read = cm.Tokens(marks)
    run = cm.Running(pa.array(texts), read)
    spelled = list(read)
    want = [w for t in texts for w in cm.text_words(t)]
    assert [spelled[i] for i in run.at] == want
    assert run.size.tolist() == [len(cm.text_words(t)) for t in texts]
    assert classes.of(run).tolist() == [classes(set(cm.text_words(t))) for t in texts]
    assert [int(x) & 1 for x in run.numbers[run.at]] == [int(0 < len(w) <= cm.SHORT) for w in want]
    assert [int(x) >> 1 & 255 for x in run.numbers[run.at]] == [cm.word_code(w) for w in want]
    monkeypatch.setattr(cm, "FLUSH", 10)  # what is forgotten is met anew
    again = cm.Running(pa.array(texts), read)
    assert [list(read)[i] for i in again.at] == want and (again.numbers[again.at] == run.numbers[run.at]).all()


def test_a_batch_of_long_texts_is_handled_in_parts(monkeypatch):
    # the arrays over a part's words are bounded, not those over a thousand long texts
    texts = some_texts(200) + ["a b " * 2000]
    batch = pa.RecordBatch.from_pydict({"text": texts, "learn": [True] * len(texts)})
    whole = list(cm._count_words(cm.Classes({}, np.zeros((0, 0))))([batch]))
    monkeypatch.setattr(cm, "PIECE", 1000)
    cut = [p.num_rows for p in cm.pieces(batch)]
    assert sum(cut) == len(texts) and len(cut) > 5
    assert list(cm._count_words(cm.Classes({}, np.zeros((0, 0))))([batch]))[-1].equals(whole[-1])
