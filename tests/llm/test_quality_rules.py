import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quire.llm.quality_rules import BOILERPLATE, MAX_LOST, apply_rules, clean

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cov = {i + j for i in range(len(w) - 4) if times[tuple(w[i:i + 5])] > 1 for j in range(5)}
    lines = text.split("\n")
    full = [x for x in lines if WORD.search(x)]
    kept, lost = [], 0
    for x in lines:
        lw = WORD.findall(x)
        bad = lw and (sum(bool(re.search(r"([#*$%&<>]{2,}|!!)\Z", y)) for y in lw) > .3 * len(lw)
                      or sum(y in "|>»·•" for y in lw) > .15 * len(lw)
                      or re.search(BOILERPLATE, x)
                      or not re.search(r"[.!?…][\"')\]]*([ \t-\r]|$)", x))
        if bad:
            lost += len(lw)
        else:
            kept.append(x)
    failed = len(w) < 10 or 100 * len(cov) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(cov), failed,
            not failed and lost <= MAX_LOST * len(w), lost, "\n".join(kept))


def texts():
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(40)] + ["a.", "b!", "c&&&", "d%%%", "E!!", "|", "é", "x\x0by", "<b>", "»"]
    out = [None, "", " ", "\n\n", "one. two", "a b c d e a b c d e", "w " * 25000, "Home | About | Contact | News\nA real line here."]
    out += ["Please read our Privacy Policy now.\nThe first sentence has a good many words in it, enough to stay."]
    for _ in range(150):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 7))]
        lines += rnd.sample(lines, 1) * rnd.randrange(3)
        out.append(rnd.choice(["\n", "\n\n", "\r\n"]).join(lines))
    return out


def test_against_brute_force(spark, frame):
    ts = texts()
    df = frame([(i, t) for i, t in enumerate(ts)])
    for r in apply_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.lost_words,
                r.clean_text) == slow(ts[r.doc_id]), ts[r.doc_id]


def test_native_plan_and_rows_kept(spark, frame):
    good = "This is a good sentence of more than ten words, all plain ones. And it ends."
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (None, good + "\nHome | News | More", None, None, 5),
            (4, None, None, None, None)]
    df = frame(rows).withColumn("text_", F.lit(1)).withColumn("lines", F.lit("x")).withColumn("c", F.lit("y"))
    out = clean(df)
    assert out.columns == df.columns
    assert [(r.doc_id, r.text, r.n_chars) for r in out.collect()] == [
        (1, good, len(good)), (1, good, len(good)), (None, good, len(good))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))
    assert apply_rules(df.where("false")).count() == 0
