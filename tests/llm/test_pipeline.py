import random

import corpus_pipeline
from quire.llm.packing import CAPACITY
from tests.llm.helpers import write_documents
from tests.llm.test_pii import slow_base
from tests.llm.test_quality_rules import slow as slow_rules
from tests.llm.test_simhash import expected as slow_groups


def rows(n=120):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randrange(6, 60))).capitalize() + "." for _ in range(rnd.randrange(1, 6))]
        if i % 7 == 0:
            lines.insert(1, "Home | News | Contact | Help")
        if i % 9 == 0:
            lines = [" ".join(w + "&&&" for w in x.split()) for x in lines]
        if i % 5 == 0:
            lines[-1] += f" Mail a.{i}@mail.example.com or +1 (658) 555-32{i % 90 + 10}."
        out.append((i, "\n".join(lines), "en", rnd.choice(["hot", "hot", "b", "c", None]), None))
        if i % 6 == 0:
            out.append((1000 + i, out[-1][1], "en", "copy", None))
    out += [(5000, None, "en", "b", None), (5001, "", "en", "b", None), (5002, "long " * 3 + " ".join(f"u{i}" for i in range(5000)) + ".", "en", "c", None)]
    return [r[:4] + (None if r[1] is None else len(r[1]),) for r in out]


def test_stages_against_brute_force(spark, tmp_dir):
    data = rows()
    write_documents(spark, tmp_dir, data)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    names = docs.columns
    (_, quality), (_, dedup), (_, pii), (_, mix), (_, pack) = corpus_pipeline.STAGES

    q = quality(spark, docs, tmp_dir)
    assert q.columns == names
    want = {}
    for i, t, *_ in data:
        s = slow_rules(t)
        if s[6]:
            want[i] = s[8] if s[7] else t
    got = {r.doc_id: r for r in q.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())

    d = dedup(spark, q, tmp_dir)
    keep = {c for _, c in slow_groups(list(want.items())).values()}
    assert d.columns == names and sorted(r.doc_id for r in d.collect()) == sorted(keep)

    p = pii(spark, d, tmp_dir)
    masked = {r.doc_id: r for r in p.collect()}
    assert p.columns == names and set(masked) == keep
    for i, r in masked.items():
        assert (r.text == want[i]) == (not slow_base(want[i])) and not slow_base(r.text) and r.n_chars == len(r.text)

    m = mix(spark, p, tmp_dir)
    taken = m.collect()
    words, size = {}, {}
    for r in masked.values():
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    times = {}
    for r in taken:
        assert r.text == masked[r.doc_id].text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert m.columns == names and max(times.values()) <= 2
    assert abs(sum(words.values()) - 1.5 * sum(size.values())) <= 4 * 5003

    k = pack(spark, m, tmp_dir).toPandas()
    assert k["piece_words"].sum() == sum(words.values()) and k["bin_words"].max() <= CAPACITY
    assert k.groupby(["bin_id", "cluster"]).size().max() == 1


def test_run_is_repeatable_and_takes_an_empty_table(spark, tmp_dir):
    write_documents(spark, tmp_dir + "/e", rows()[:0])
    assert corpus_pipeline.run(spark, tmp_dir + "/e").count() == 0


def test_run_ends_in_the_texts(spark, tmp_dir):
    data = [(i, " ".join(f"w{i * 7 + j * j % 97}" for j in range(40)).capitalize() + ". Mail a@b.example.com now.", "en",
             "abc"[i % 3], None) for i in range(30)]
    write_documents(spark, tmp_dir + "/t", data)
    made = corpus_pipeline.write_bins(spark, tmp_dir + "/t", tmp_dir + "/bins").collect()
    pieces = [p for b in made for p in b.pieces]
    assert pieces and len({(p.row, p.piece) for p in pieces}) == len(pieces)
    assert len({p.doc_id for p in pieces}) < len(pieces)  # copies of the mix
    assert all("[EMAIL]" in p.text and "@" not in p.text for p in pieces)
