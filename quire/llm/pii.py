"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans. The field labels every token that
holds a digit or an at sign: unary potentials come from the token's shape, chain potentials
from its neighbour, and skip potentials tie every token that repeats, or carries the same
digits, to one hub variable for all its places in the document, however far apart and however
the digits are cut into tokens. Message passing until nothing moves then settles one label for
all of them; a token that ends up as personal data without a base span is added.

All potentials are trained here, piece by piece, from the base spans of the corpus itself:
one pass counts shapes, neighbouring pairs and skip pairs by label (a table of bounded size).
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pack_row, prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
THRESHOLD = 0.95  # belief from which a token is added
SKIP_DIGITS = 7  # tokens of that many equal digits share a potential
RUN_DIGITS = 19  # a base span of digits has no more, so no longer run of tokens can equal one
RUN_TOKENS = 6  # tokens in a run that no base span or long token is like
TIE_DIGITS = 4  # tokens with fewer digits (and no at sign) are not tied by themselves
SLOW = 100  # rounds of message passing after which the steps are halved, and so on: it always ends

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^ \t-\r]+")


def luhn(digits: str) -> bool:
    d = np.frombuffer(digits.encode(), np.uint8).astype(np.int64)[::-1] - 48
    twice = d[1::2] * 2
    return int(d[::2].sum() + (twice - 9 * (twice > 9)).sum()) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same spans as the pattern finds from the left, in linear time: from each at sign the
    local part is looked for backwards, as far as the span before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    if not text or not _HINT.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _bucket(n: int, edges: tuple) -> int:
    return sum(n >= e for e in edges)


def shape(token: str) -> int:
    """Code of a token's shape; there are 2 * 2 * 10 * 5 * 2 * 3 * 3 of them."""
    digits = sum(c in "0123456789" for c in token)
    letters = sum(c.isalpha() for c in token)
    at = token.find("@")
    code = 0
    for value, size in ((at >= 0, 2), (at > 0 and "." in token[at:], 2),
                        (_bucket(digits, (1, 2, 4, 7, 10, 13, 14, 17, 20)), 10), (min(token.count("."), 4), 5),
                        (token.startswith("+"), 2), (_bucket(sum(c in "()-" for c in token), (1, 3)), 3),
                        (_bucket(letters, (1, 5)), 3)):
        code = code * size + int(value)
    return code


def periodic(digits: str) -> bool:
    """A string that repeats a part of at most half its length: no identifier by itself."""
    return any(digits[k:] == digits[:-k] for k in range(1, len(digits) // 2 + 1))


class Graph:
    """Candidate tokens of a text, their shapes, labels by base spans, and edges.

    Everything but the ties of runs is linear in the number of tokens; a run of tokens is
    looked at only where its last digits come twice.
    """

    def __init__(self, text: str, spans: list[tuple[int, int, str]]):
        found = [(m.start(), m.end(), i) for i, m in enumerate(_WORD.finditer(text)) if _HINT.search(m[0])]
        self.start, self.end, self.word = np.array(found, np.int64).reshape(-1, 3).T.copy()
        del found
        n = len(self.start)
        self.text, self.ordered = text, sorted(spans)
        self.label = np.zeros(n, np.int64)
        for a, b, kind in reversed(self.ordered):  # of two spans in a token the first counts
            lo, hi = np.searchsorted(self.end, a, "right"), np.searchsorted(self.start, b, "left")
            self.label[lo:hi] = LABELS.index(kind)
        codes: dict[str, int] = {}
        self.shape = np.fromiter((codes.get(t) if t in codes else codes.setdefault(t, shape(t)) for t in self.tokens()), np.int64, n)
        # neighbours, and the pairs of places (one and the next) that the skip potentials are counted from
        chain = np.flatnonzero(np.diff(self.word) == 1)
        number: dict[str, int] = {}
        key = np.fromiter((number.setdefault(self._key(t), len(number)) for t in self.tokens()), np.int64, n)
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(np.diff(key[order]) == 0)
        pair = np.stack((order[same], order[same + 1]), 1) if len(same) else np.zeros((0, 2), np.int64)
        pair = pair[(pair[:, 1] - pair[:, 0] > 1) | (self.word[pair[:, 1]] - self.word[pair[:, 0]] > 1)]
        pair = pair[np.argsort(pair[:, 1], kind="stable")]
        self.edges = np.concatenate((np.stack((chain, chain + 1, np.zeros_like(chain)), 1), np.column_stack((pair, np.ones(len(pair), np.int64)))))
        self.edges = self.edges[np.argsort(self.edges[:, 1], kind="stable")]

    def __len__(self) -> int:
        return len(self.start)

    def tokens(self) -> Iterator[str]:
        return (self.text[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True))

    @staticmethod
    def _key(token: str) -> str:
        digits = _NO_DIGIT.sub("", token)
        return digits if len(digits) >= SKIP_DIGITS and "@" not in token else token.strip(".,;:!?()[]{}\"'<>").lower()

    @cached_property
    def hubs(self) -> list[tuple[bool, list[tuple[int, int]]]]:
        places: dict[str, set] = {}
        for i, t in enumerate(self.tokens()):
            if "@" in t or len(_NO_DIGIT.sub("", t)) >= TIE_DIGITS:  # a short number that repeats says nothing
                places.setdefault(self._key(t), set()).add((i, i))
        anchors = {k for k in places if len(k) >= SKIP_DIGITS and not _NO_DIGIT.search(k) and not periodic(k)}
        base = []
        for a, b, kind in self.ordered:
            run = _NO_DIGIT.sub("", self.text[a:b])
            if kind != "email" and len(run) >= SKIP_DIGITS:
                at = int(np.searchsorted(self.start, a, "right")) - 1, int(np.searchsorted(self.start, b, "left")) - 1
                base.append((run, at))
                anchors.add(run)
        self._runs(anchors, places)
        for run, at in base:
            places.setdefault(run, set()).add(at)
        return self._hubs(places)

    def _runs(self, anchors: set[str], places: dict) -> None:
        """Runs of neighbouring tokens of digits (no letters), by all their digits.

        Two runs belong together if one's digits end with the other's, so they have their last
        SKIP_DIGITS digits in common: only ends of runs whose last digits come twice, or end an
        anchor (a base span, a long token), are looked at. Without an anchor a run has RUN_TOKENS
        tokens at most and is not periodic. Last digits that repeat themselves overlap: of such
        ends those that do not."""
        n = len(self)
        if not n:
            return
        size = np.zeros(n, np.int64)
        flat = []
        for i, t in enumerate(self.tokens()):
            if not any(c.isalpha() or c == "@" for c in t):
                d = _NO_DIGIT.sub("", t)
                size[i] = len(d)
                flat.append(d)
        digit = np.frombuffer("".join(flat).encode(), np.uint8).astype(np.int64) - 48
        del flat
        ends = np.cumsum(size)  # of each token, in ``digit``
        broken = np.concatenate(([True], (np.diff(self.word) != 1) | (size[1:] == 0) | (size[:-1] == 0)))
        first = np.maximum.accumulate(np.where(broken, np.arange(n), 0))  # of the token's stretch
        whole = np.flatnonzero((size > 0) & (ends - (ends - size)[first] >= SKIP_DIGITS))
        tail = np.zeros(len(whole), np.int64)
        for k in range(SKIP_DIGITS):
            tail = tail * 10 + digit[ends[whole] - SKIP_DIGITS + k]
        values, back, times = np.unique(tail, return_inverse=True, return_counts=True)
        anchored = np.isin(values, [int(a[-SKIP_DIGITS:]) for a in anchors])
        last: dict[int, int] = {}
        for at in np.flatnonzero((times > 1)[back] | anchored[back]).tolist():
            j, v = int(whole[at]), int(back[at])
            far = anchored[v]
            text = "%0*d" % (SKIP_DIGITS, values[v])
            if periodic(text):
                if last.get(v, -1) > ends[j] - SKIP_DIGITS:
                    continue
                last[v] = int(ends[j])
            i, run = j, "".join(map(str, digit[ends[j] - size[j]:ends[j]].tolist())) if size[j] <= RUN_DIGITS else ""
            while run and i > first[j] and (far or j - i + 1 < RUN_TOKENS) and len(run) + size[i - 1] <= RUN_DIGITS:
                i -= 1
                run = "".join(map(str, digit[ends[i] - size[i]:ends[i]].tolist())) + run
                if len(run) >= SKIP_DIGITS and (far or not periodic(run)):
                    places.setdefault(run, set()).add((i, j))

    @staticmethod
    def _hubs(places: dict) -> list[tuple[bool, list[tuple[int, int]]]]:
        """(identifying, places as first and last token) of every key with two places or more.
        A place of digits is also one of every key that its digits end with; a key all of
        whose places lie within those of one longer key says nothing new and is left out."""
        identity = lambda key: len(key) >= SKIP_DIGITS and not _NO_DIGIT.search(key)
        all_of = {key: set(at) for key, at in places.items()}
        ends: list[str] = []  # keys in reverse that the one at hand starts with
        for back in sorted(key[::-1] for key in places if identity(key)):
            while ends and not back.startswith(ends[-1]):
                ends.pop()
            for shorter in ends:
                all_of[shorter[::-1]] |= places[back[::-1]]
            ends.append(back)
        hubs, cover = [], {}
        for key in sorted(all_of, key=lambda k: (-len(k), k)):
            at, end = [], -1
            for i, j in sorted(all_of[key], key=lambda p: (p[1], -p[0])):  # the narrowest, without overlap
                if i > end:
                    at.append((i, j))
                    end = j
            if len(at) < 2:
                continue
            within = None
            for i, j in at if identity(key) else ():
                over = {h for a, b, h in cover.get(j, ()) if a <= i and j <= b}
                within = over if within is None else within & over
                if not within:
                    break
            if within:
                continue
            for i, j in at if identity(key) else ():
                for t in range(i, j + 1):
                    cover.setdefault(t, []).append((i, j, len(hubs)))
            hubs.append((identity(key) or "@" in key, at))
        return hubs

    def skip_edges(self) -> tuple[np.ndarray, list[set]]:
        """Edges from hub (numbered after the tokens) to token, and the labels that the base
        spans give to each hub: the place of an identifying key has its tokens' one label."""
        edges, known = [], []
        for h, (identifying, at) in enumerate(self.hubs):
            edges += [(len(self) + h, t, 1) for i, j in at for t in range(i, j + 1)]
            labels = [set(self.label[i:j + 1].tolist()) for i, j in at] if identifying else []
            known.append({y for s in labels if len(s) == 1 for y in s if y})
        return np.array(edges, np.int64).reshape(-1, 3), known


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Marginals of a pairwise model by loopy sum-product (exact on trees). ``edges``: rows
    (i, j, kind); ``pair[kind][label i, label j]``: log potentials. Without ``rounds`` it goes
    on until no message moves; steps get shorter where the messages keep swinging."""
    total = unary.copy()
    if len(edges):
        n = len(edges)
        src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        # edges of one kind and direction share a small table: no potentials are copied
        kind = np.concatenate((edges[:, 2], edges[:, 2] + len(pair)))
        tables = [np.exp(t - t.max()) for t in (*pair, *(p.T for p in pair))]
        groups = [(np.flatnonzero(kind == k), t) for k, t in enumerate(tables)]
        labels = unary.shape[1]

        def arrived(msg):
            return unary + np.stack([np.bincount(dst, msg[:, y], len(unary)) for y in range(labels)], 1)
        msg = np.zeros((2 * n, labels))
        for turn in itertools.count() if rounds is None else range(max(rounds, 1)):
            total = arrived(msg)
            most = 0.0
            part = 0.5 ** (1 + turn // SLOW)
            new = np.empty_like(msg)
            for at, table in groups:
                x = total[src[at]] - msg[np.where(at < n, at + n, at - n)]
                x -= x.max(1, keepdims=True)
                x = np.log(np.exp(x) @ table)
                x -= np.log(np.exp(x).sum(1, keepdims=True))
                new[at] = x
                if len(at):
                    most = max(most, float(np.abs(x - msg[at]).max()))
            step = most * part * 2
            msg = new if step < 1e-6 and turn < SLOW else msg + (new - msg) * part
            if step < 1e-6:
                break
        total = arrived(msg)
    total -= np.logaddexp.reduce(total, axis=1, keepdims=True)
    return np.exp(total)


class Model:
    """Potentials from counts: rows (part, a, b, n); part 0 shapes by label, 1 chain pairs,
    2 skip pairs."""

    def __init__(self, rows, smooth: float = 1.0):
        k = len(LABELS)
        shapes = {}
        pair = np.full((2, k, k), smooth / k)
        prior = np.full(k, smooth)
        for part, a, b, n in rows:
            if part == 0:
                shapes.setdefault(a, np.zeros(k))[b] += n
                prior[b] += n
            else:
                pair[part - 1, a, b] += n
        prior /= prior.sum()
        self.prior = np.log(prior)
        self.shapes = {s: np.log((c + smooth * prior) / (c.sum() + smooth)) for s, c in shapes.items()}
        # how much more often two labels meet on an edge than apart (symmetric for skips)
        pair[1] = (pair[1] + pair[1].T) / 2
        pair /= pair.sum((1, 2), keepdims=True)
        self.hub = np.log(pair[1].sum(1))
        self.pair = np.log(pair) - np.log(pair.sum(2, keepdims=True)) - np.log(pair.sum(1, keepdims=True))

    def unary(self, g: Graph, clamp: float = 12.0) -> np.ndarray:
        codes, at = np.unique(g.shape, return_inverse=True)
        u = np.array([self.shapes.get(int(s), self.prior) for s in codes]).reshape(-1, len(LABELS))[at]
        known = g.label > 0
        u[known] = -clamp  # a base span stays what it is
        u[known, g.label[known]] = 0.0
        return u

    def settle(self, g: Graph, clamp: float = 12.0) -> np.ndarray:
        """Beliefs of the tokens. A hub that base spans label is observed: no number of places
        that look otherwise outvotes them."""
        skips, known = g.skip_edges()
        hubs = np.tile(self.hub, (len(known), 1))
        for h, labels in enumerate(known):
            if labels:
                hubs[h] = -1e6
                hubs[h, list(labels)] = 0.0
        edges = np.concatenate((g.edges[g.edges[:, 2] == 0], skips))
        return beliefs(np.concatenate((self.unary(g, clamp), hubs)), edges, self.pair)[:len(g)]


def added_spans(text: str, base: list[tuple[int, int, str]], model: Model, threshold: float = THRESHOLD):
    """Spans that the field adds to the base spans; neighbouring tokens of one label join."""
    g = Graph(text, base)
    if not len(g) or (g.label > 0).all():
        return []
    p = model.settle(g)
    best = p.argmax(1)
    out, last = [], -2
    for i in np.flatnonzero((g.label == 0) & (best > 0) & (p.max(1) >= threshold)):
        a, b, w = int(g.start[i]), int(g.end[i]), int(g.word[i])
        t = text[a:b]
        a, b = a + len(t) - len(t.lstrip(".,;:!?[]{}\"'<>")), b - len(t) + len(t.rstrip(".,;:!?[]{}\"'<>"))
        kind = LABELS[best[i]]
        if out and last == w - 1 and out[-1][2] == kind:
            out[-1] = (out[-1][0], b, kind)
        elif b > a:
            out.append((a, b, kind))
        last = w
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()  # bounded: shapes x labels, and pairs of labels
    for pdf in batches:
        for text in pdf["text"]:
            if not text or not _HINT.search(text):
                continue
            g = Graph(text, base_spans(text))
            for rows in (np.stack((np.zeros_like(g.shape), g.shape, g.label), 1),
                         np.stack((g.edges[:, 2] + 1, g.label[g.edges[:, 0]], g.label[g.edges[:, 1]]), 1)):
                kinds, n = np.unique(rows, axis=0, return_counts=True)
                for k, c in zip(kinds.tolist(), n.tolist(), strict=True):
                    seen[tuple(k)] += c
    yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["part", "a", "b", "n"])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Potentials from all documents; the driver gets at most 3600 x 5 + 50 counts."""
    prepare(docs.sparkSession)
    counts = (docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(_count, "part int, a bigint, b bigint, n bigint")
              .groupBy("part", "a", "b").agg(F.sum("n").alias("n")))
    return Model([tuple(r) for r in counts.collect()])


def _say(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(text: str | None, model: Model, threshold: float = THRESHOLD):
    base = base_spans(text)
    if not text or not _HINT.search(text):
        return base, []
    return base, added_spans(text, base, model, threshold)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_added, base, spans`` for every row.

    The counts are those of the base spans; ``base`` and ``spans`` (base and added) list
    ``kind:start:end`` in code points, by start, then kind. A null text counts as empty and
    has none. Rows repeat as they come in, ids may be null, an empty table gives an empty
    result. Very long texts are read whole, in time and memory linear in their tokens; of labels
    that tie the first one counts. Other columns are not read, whatever their names. Without a
    ``model`` the potentials are trained on ``docs``.
    """
    prepare(docs.sparkSession)
    model = model or train(docs, text_col)
    names = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names) + ", n_added bigint, base string, spans string")
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, added = all_spans(t, model, threshold)
            n = Counter(k for *_, k in base)
            both = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]))) if added else base
            rows.append([*(n[k] for k in KINDS), len(added), _say(base), _say(both)])
        return pd.DataFrame(rows, columns=[*names, "n_added", "base", "spans"])

    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), spans(F.col(f"`{text_col}`")).alias("s"))
    return out.select("doc_id", "s.*")


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become the first's."""
    out, done = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", model: Model | None = None,
           threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span masked, columns as they were; ``length_col``, where the table
    has it, follows texts that change. Null texts stay null."""
    prepare(docs.sparkSession)
    model = model or train(docs, text_col)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(t):
            base, added = all_spans(t, model, threshold)
            return mask(t, base + added) if base or added else None
        return pd.Series([one(t) for t in texts], dtype=object)

    src = pack_row(docs)
    new = src.withColumn("_new", masked(F.col("_row").getField(text_col)))
    cols = []
    for c, t in docs.dtypes:
        col = F.col("_row").getField(c)
        if c == text_col:
            col = F.coalesce("_new", col)
        elif c == length_col:
            col = F.when(F.col("_new").isNotNull(), F.char_length("_new").cast(t)).otherwise(col)
        cols.append(col.alias(c))
    return new.select(*cols)


