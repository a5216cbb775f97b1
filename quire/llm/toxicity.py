"""Toxicity by weak supervision.

Many cheap voters look at a text: a lexicon learned from labelled rows (word beginnings, so a
family of inflected words is one entry, and whole short words), a fixed list of insults, and
patterns. A generative label model estimates from the votes of all documents how accurate each
voter is and which voters are correlated: each class has a log-linear model over the votes with
one term per voter and one per correlated pair, fitted by expectation maximisation over the
table of vote patterns (at most 2**12 patterns times three states of the label, whatever the
input). A label that a row has is one more voter, of a given accuracy. The posteriors
are the labels of a linear classifier over lexicon hits (sparse, one weight for each entry)
and votes, trained by L-BFGS whose sums are added up by partitions.

The lexicon is fitted on at most about ``LEARN_TEXTS`` labelled texts, chosen by hash: their
ids have a bounded size and are broadcast, so no text is ever shuffled, and the number of
entries is bounded by what these texts hold. All other counts cover all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import code_bucket, materialize, prepare

# General English insults, as beginnings of words.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile",
           "dumbass", "asshole", "bastard", "retard", "filthy", "shut up", "hate you")

LENGTHS = (4, 5, 6)  # of the word beginnings that a lexicon is learned from; shorter words count whole
SHORT = "="  # marks an entry that is a whole word shorter than every beginning
LEARN_TEXTS = 50_000  # distinct labelled texts that the lexicon is fitted on, about; all where there are fewer
MIN_SUPPORT = 3  # distinct toxic texts
MIN_PRECISION = 0.6
MIN_EVIDENCE = 18.0  # log-likelihood ratio against the base rate
GOLD = 0.9999  # accuracy of a given label, as a voter among the others
LEARNED = 6  # voters that share the learned lexicon
VOTERS = LEARNED + 6
PAIRS = 10
THRESHOLD = 0.3
_EDGE = ".,;:!?#*$%&|\"'()[]{}<>-_"


LEVELS = 3  # of a beginning in a text: there at all, in 1 % of the words, and twice besides


def tokens(text: str | None) -> Counter:
    """Lower-cased words without punctuation around them, and how often each occurs."""
    out: Counter = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        out[w.strip(_EDGE)] += n
    return out


def level(times: int, words: int) -> int:
    """The highest level that ``times`` occurrences among ``words`` words reach (0: none)."""
    if not times or 100 * times < words:
        return min(times, 1)
    return 3 if times > 1 else 2


def keys(word: str) -> list[str]:
    """The lexicon keys of a word: its beginnings, or the word itself if it is short."""
    n = len(word)
    if n < LENGTHS[0]:
        return [SHORT + word] if n else []
    return [word[:size] for size in LENGTHS if n >= size]


def beginnings(text: str | None) -> dict[str, int]:
    """Lexicon keys of a text and the level of each."""
    times: dict[str, int] = {}
    words = tokens(text)
    for w, n in words.items():
        for g in keys(w):
            times[g] = times.get(g, 0) + n
    total = sum(words.values())
    return {g: level(n, total) for g, n in times.items()}


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either class that hold a key, by its highest level, added up while the sums fit
    in memory."""
    count: dict[tuple[str, int], list[int]] = {}

    def out():
        return pd.DataFrame([(*k, *n) for k, n in count.items()], columns=["gram", "top", "toxic", "clean"])
    for pdf in batches:
        for text, y in zip(pdf["text"], pdf["y"], strict=True):
            for k in beginnings(text).items():
                c = count.get(k)
                if c is None:
                    c = count[k] = [0, 0]
                c[0 if y else 1] += 1
            if len(count) > 300_000:
                yield out()
                count.clear()
    yield out()


def _thin(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the entries of one stem, best first, those that overlap no better one."""
    chosen: list[int] = []
    pdf = pdf.sort_values(["evidence", "level", "gram"], ascending=[False, True, True], kind="stable")
    grams = pdf["gram"].tolist()
    for i, g in enumerate(grams):
        if not any(g.startswith(grams[c]) or grams[c].startswith(g) for c in chosen):
            chosen.append(i)
    return pdf.iloc[chosen][["gram", "level", "evidence"]]


def learn_lexicon(texts: DataFrame) -> list[tuple[str, int]]:
    """(key, level) entries that mark toxic texts, the clearest first. ``texts``: ``text, y`` of
    distinct texts.

    Every key that passes the thresholds is kept, but of one that is the beginning of another
    (or the same at another level) the clearer; entries of equal evidence go by level, then
    text. Counting and thinning are Spark's; the entries come to the driver.
    """
    base = texts.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not base[1] or not base[0] or base[0] == base[1]:
        return []
    p0 = float(base[0]) / base[1]
    n, t = F.col("toxic") + F.col("clean"), F.col("toxic")
    term = lambda k, p: F.when(k > 0, k * F.log(k / n / F.lit(p))).otherwise(0.0)
    sums = texts.mapInPandas(_grams, "gram string, top int, toxic bigint, clean bigint").groupBy("gram").agg(
        F.array(*[F.struct(F.lit(v).alias("level"), F.sum(F.when(F.col("top") >= v, F.col("toxic")).otherwise(0)).alias("toxic"),
                           F.sum(F.when(F.col("top") >= v, F.col("clean")).otherwise(0)).alias("clean"))
                  for v in range(1, LEVELS + 1)]).alias("s"))
    passed = (sums.select("gram", F.inline("s")).where((t >= MIN_SUPPORT) & (t >= MIN_PRECISION * n))
              .withColumn("evidence", 2 * (term(t, p0) + term(F.col("clean"), 1 - p0))).where(F.col("evidence") >= MIN_EVIDENCE)
              .select("gram", "level", "evidence", F.substring("gram", 1, LENGTHS[0]).alias("stem")))
    thinned = passed.groupBy("stem").applyInPandas(_thin, "gram string, level int, evidence double")
    return [(r.gram, r.level) for r in thinned.orderBy(F.desc("evidence"), "level", "gram").collect()]


class Voters:
    """Lexicon hits of a text (ascending entry numbers) and its votes (a bitmap, 1: toxic)."""

    def __init__(self, lexicon: list[tuple[str, int]]):
        self.entry = {g: i for i, (g, _) in enumerate(lexicon)}
        self.level = [v for _, v in lexicon]
        self.stems = {g[:LENGTHS[0]] for g in self.entry}  # most words stop here

    def hits(self, words: Counter) -> list[int]:
        times: dict[int, int] = {}
        for w, c in words.items():
            if (w[:LENGTHS[0]] if len(w) >= LENGTHS[0] else SHORT + w) in self.stems:
                for g in keys(w):
                    i = self.entry.get(g)
                    if i is not None:
                        times[i] = times.get(i, 0) + c
        total = sum(words.values()) if times else 0
        return sorted(i for i, c in times.items() if level(c, total) >= self.level[i])

    def __call__(self, text: str | None) -> tuple[list[int], int]:
        hits = self.hits(tokens(text))
        votes = 0
        for i in hits:
            votes |= 1 << i % LEARNED
        low = (text or "").lower()
        said = [x for x in INSULTS if x in low]
        insults, known = len(said), len(hits)
        for k, v in enumerate((insults >= 1, insults >= 2, known >= 2, known >= 1 and insults >= 1,
                               any(x + "!" in low or x + "?" in low for x in said),
                               any("you " + x in low or "you are " + x in low for x in said))):
            votes |= int(v) << LEARNED + k
        return hits, votes


class LabelModel:
    """P(y) and, by class, a log-linear model of the votes with chosen pair terms."""

    def __init__(self, voters: int = VOTERS, pairs: int = PAIRS, rounds: int = 12, gold: float = GOLD):
        self.n, self.max_pairs, self.rounds, self.gold = voters, pairs, rounds, gold
        self.states = (np.arange(1 << voters)[:, None] >> np.arange(voters)) & 1
        self.pairs: list[tuple[int, int]] = []

    def _phi(self) -> np.ndarray:
        return np.hstack([self.states, *[(self.states[:, [a]] * self.states[:, [b]]) for a, b in self.pairs]]).astype(float)

    def _fit_class(self, weight: np.ndarray, theta: np.ndarray, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
        """Maximum likelihood of one class by damped Newton steps over all vote states."""
        phi, total = self._phi(), weight.sum()
        theta = np.concatenate((theta, np.zeros(phi.shape[1] - len(theta))))
        mean = (weight @ phi + .5 * phi.mean(0)) / (total + .5)
        for _ in range(steps):
            s = phi @ theta
            p = np.exp(s - np.logaddexp.reduce(s))
            m = p @ phi
            grad = mean - m - 1e-3 * theta
            step = np.linalg.solve((phi * p[:, None]).T @ phi - np.outer(m, m) + 2e-3 * np.eye(len(m)), grad)
            theta = theta + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-4:
                break
        s = phi @ theta
        return theta, s - np.logaddexp.reduce(s)

    def fit(self, votes: np.ndarray, gold: np.ndarray, count: np.ndarray) -> LabelModel:
        """``gold``: 0, 1, or -1 where no label is known. ``count``: documents by row.

        A label is a voter that speaks on some rows; the votes can outvote one that is less
        than certain."""
        k = self.states[votes]
        known = gold >= 0
        if (gold == 1).any():
            prior = (count[gold == 1].sum() + 1) / (count[known].sum() + 2)
            q = np.where(known, np.where(gold == 1, self.gold, 1 - self.gold), np.where(k.any(1), .7, .02)).astype(float)
        else:
            prior, q = .1, np.where(k.any(1), .7, .02)
        theta = [np.zeros(self.n), np.zeros(self.n)]
        for r in range(self.rounds):
            dense = [np.bincount(votes, count * (q if y else 1 - q), 1 << self.n) for y in (0, 1)]
            if r == 2:
                self.pairs = self._correlated(dense)
            fits = [self._fit_class(w, t) for w, t in zip(dense, theta, strict=True)]
            theta, self.log_p = [f[0] for f in fits], [f[1] for f in fits]
            if not known.any():
                prior = float(np.clip(np.average(q, weights=count), .01, .5))
            self.prior = prior
            q = self.posterior(votes, gold)
        self.theta = theta
        return self

    def _correlated(self, dense) -> list[tuple[int, int]]:
        """Pairs of voters that depend on each other within the classes, most so first."""
        gain = np.zeros((self.n, self.n))
        for w in dense:
            x, tot = self.states, w.sum() + 4
            one = (w @ x + 1) / tot
            both = ((x * w[:, None]).T @ x + 1) / tot
            cells = (both, one[:, None] - both, one[None] - both, 1 - one[:, None] - one[None] + both)
            parts = (np.outer(one, one), np.outer(one, 1 - one), np.outer(1 - one, one), np.outer(1 - one, 1 - one))
            gain += tot * sum(np.maximum(c, 1e-12) * np.log(np.maximum(c, 1e-12) / e) for c, e in zip(cells, parts, strict=True))
        a, b = np.triu_indices(self.n, 1)
        order = np.argsort(-gain[a, b], kind="stable")[:self.max_pairs]
        return [(int(a[i]), int(b[i])) for i in order if gain[a[i], b[i]] > 10]

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) given the votes, and the label where ``gold`` is 0 or 1."""
        odds = np.log(self.prior / (1 - self.prior)) + self.log_p[1][votes] - self.log_p[0][votes]
        if gold is not None:
            odds = odds + np.where(gold >= 0, (2 * gold - 1) * np.log(self.gold / (1 - self.gold)), 0.0)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Linear:
    """Scores of (hits, votes): a weight for each entry, each vote, the number of hits (5 at
    most) and a constant."""

    def __init__(self, entries: int, theta: np.ndarray | None = None):
        self.entries, self.size = entries, entries + VOTERS + 2
        self.theta = np.zeros(self.size) if theta is None else theta

    def parts(self, hits, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and entries of the hits, and the dense columns."""
        size = np.fromiter(map(len, hits), np.int64, len(hits))
        at = np.repeat(np.arange(len(size)), size)
        entry = np.concatenate([np.asarray(h, np.int64) for h in hits]) if size.sum() else np.zeros(0, np.int64)
        v = (votes[:, None] >> np.arange(VOTERS)) & 1
        return at, entry, np.hstack((v, np.minimum(size, 5)[:, None], np.ones((len(size), 1)))).astype(float)

    def logit(self, parts) -> np.ndarray:
        at, entry, dense = parts
        return np.bincount(at, self.theta[entry], len(dense)) + dense @ self.theta[self.entries:]

    def score(self, hits, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.parts(hits, votes)), -30, 30)))

    def sums(self, hits, votes: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weighted log loss and its gradient."""
        at, entry, dense = p = self.parts(hits, votes)
        s = self.logit(p)
        miss = n * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - q)
        loss = (n * (np.logaddexp(0, s) - q * s)).sum()
        return np.concatenate(([loss], np.bincount(entry, miss[at], self.entries), dense.T @ miss))


def train_linear(rows: DataFrame, entries: int, steps: int = 40, shrink: float = 0.5) -> Linear:
    """Logistic weights on soft labels. ``rows``: ``hits, votes, q, n`` (n equal documents).

    L-BFGS: a step is one pass, from which a vector of the number of weights comes to the
    driver for each task."""
    reg = np.full(entries + VOTERS + 2, shrink)
    reg[-1] = 1e-6

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        model = Linear(entries, theta)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(model.size + 1)
            for pdf in batches:
                total += model.sums(pdf["hits"], pdf["votes"].to_numpy(), pdf["q"].to_numpy(float), pdf["n"].to_numpy(float))
            yield pd.DataFrame({"v": [total.tolist()]})
        got = rows.mapInPandas(run, "v array<double>").collect()
        total = np.sum([r.v for r in got], axis=0) if got else np.zeros(model.size + 1)
        return total[0] + .5 * reg @ theta ** 2, total[1:] + reg * theta

    theta = np.zeros(len(reg))
    loss, grad = at(theta)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = grad.copy(), []
        for s, y in reversed(memory):
            a.append(s @ d / (s @ y))
            d -= a[-1] * y
        d *= memory[-1][0] @ memory[-1][1] / (memory[-1][1] @ memory[-1][1]) if memory else 1 / max(1.0, float(np.abs(grad).max()))
        for (s, y), w in zip(memory, reversed(a), strict=True):
            d += s * (w - y @ d / (s @ y))
        step = 1.0
        while True:
            new = theta - step * d
            new_loss, new_grad = at(new)
            if new_loss <= loss - 1e-4 * step * (grad @ d) or step < 1e-4:
                break
            step /= 2
        if (new - theta) @ (new_grad - grad) > 1e-12:
            memory = [*memory[-9:], (new - theta, new_grad - grad)]
        done = loss - new_loss < 1e-6 * max(1.0, abs(loss))
        if new_loss < loss:
            theta, loss, grad = new, new_loss, new_grad
        if done:
            break
    return Linear(entries, theta)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", buckets: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Rows whose crc32 of the id modulo ``buckets`` is ``held_out`` teach no label; of the
    others every labelled row teaches the label model, and the lexicon is learned from at most
    about ``LEARN_TEXTS`` of their distinct texts. A null text counts as empty: no voter speaks,
    and it is scored like any text without hits; a null id counts as the empty text in crc32.
    Very long texts are read whole; a level counts a key's share of the words. Of several
    labels of one id the largest counts, and so it does for equal texts. Repeated rows are
    scored each. Other columns of both tables are not read, whatever their names. Without
    labels the fixed voters alone decide. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = code_bucket(F.col("doc_id"), buckets) == held_out
    y = (labels.select(F.col("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
         .where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(~out))
    y = materialize(y, "labels")
    # of equal texts one row teaches the lexicon, or a copied text would make its words look toxic
    same = materialize(src.select("doc_id", F.xxhash64("text").alias("th")).join(y, "doc_id")
                       .groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")), "distinct")
    share = LEARN_TEXTS / max(same.count(), 1)
    chosen = same.where(F.pmod(F.xxhash64("th", F.lit(7)), F.lit(1 << 20)) < F.lit(int(min(share, 1.0) * (1 << 20)))).select("doc_id", "y")
    # about LEARN_TEXTS ids at most: a bounded broadcast, and no text is shuffled
    lexicon = learn_lexicon(src.where(~out).join(F.broadcast(chosen), "doc_id").select("text", "y"))
    voters = Voters(lexicon)

    @F.pandas_udf("hits array<int>, votes int")
    def vote(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([voters(t) for t in texts], columns=["hits", "votes"])

    votes = materialize(src.select("doc_id", vote("text").alias("v")).select("doc_id", "v.hits", "v.votes"), "votes")
    seen = votes.where(~out).join(y, "doc_id", "left")
    table = (seen.groupBy("votes", F.coalesce("y", F.lit(-1)).alias("gold")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy("votes", "gold").toPandas())  # at most 3 * 2**VOTERS rows
    if not len(table):
        table = pd.DataFrame({"votes": [0], "gold": [-1], "n": [1]})
    model = LabelModel().fit(table["votes"].to_numpy(), table["gold"].to_numpy(), table["n"].to_numpy(float))
    states = np.arange(1 << VOTERS)
    odds = np.stack([model.posterior(states, np.full(len(states), g)) for g in (-1, 0, 1)])

    @F.pandas_udf("double")
    def label(v: pd.Series, gold: pd.Series) -> pd.Series:
        return pd.Series(odds[gold.to_numpy() + 1, v.to_numpy()])

    rows = (seen.groupBy("hits", "votes", F.coalesce("y", F.lit(-1)).alias("gold")).agg(F.count(F.lit(1)).alias("n"))
            .select("hits", "votes", label("votes", "gold").alias("q"), "n"))
    linear = train_linear(materialize(rows, "soft-labels"), len(lexicon))

    @F.pandas_udf("double")
    def score(h: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(linear.score(h, v.to_numpy()))

    return (votes.select("doc_id", out.alias("held_out"), score("hits", "votes").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
