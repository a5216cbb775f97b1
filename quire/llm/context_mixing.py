"""Language-model scores by online logistic context mixing.

A text is its words and one end, in order. Every word has a code of ``DEPTH`` bits, from a hash
of its ending; each bit is predicted from several hashed contexts that cross the words' borders:
the word before, the last short word, and the last two short words. Their counts become
stretched probabilities, and a mixer adds them to what the word frequencies of the text's class
say with weights that a gate chooses (the bit's place, and how well each context is known),
learned online as the texts go by; an adaptive map refines the result by what really happened at
that prediction. Given its code, a word has its share of the code's probability without context:

    log P(word | words before) = log P0(word) + sum over its bits of log p(bit | contexts) / p0(bit)

P0 has three routes: a word's frequency in texts of the same class, in all texts, and its
spelling; expectation maximisation fits how much each is trusted. A word is spelled byte by byte
and closed by a space (the end is the empty word); each bit of each byte is predicted from the
bytes before it in the word at several orders by a mixer of the same kind. Every counted word is
left out of its own statistics while the speller learns, so it serves words never seen. Classes
(in practice languages) are found from which frequent short words occur together.

All statistics come from all training texts: words are counted by Spark, contexts partition by
partition, and every distinct word is spelled once. The most frequent words, a fixed number,
travel to the tasks; the others are joined. Context tables are as large as the number of training
tokens asks for, up to 2**MAX_SLOTS slots.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import code_bucket, materialize, prepare, release

ORDERS = (1, 2, 3, 4, 6, 12)  # bytes before, within the word
SEEN = len(ORDERS) + 1  # states of the gate for each bit: the longest order seen, or none
SLOT_BITS = 18  # slots of one order's table
BLOCK = 1 << 14  # numbers in one row of a sum
RATE = 0.1
BUCKETS = 33  # of the adaptive map, over stretched probabilities from -8 to 8
SEGMENT = 1 << 15  # bytes handled at a time
NEAR = 1 << 14  # words scored at a time: their arrays stay in the processor's cache
TASKS = 256  # tasks that learn, at most: their sums meet in one group for each block
TOP = 1 << 16  # most frequent words that are broadcast
PIECE = 1 << 24  # bytes of text whose words are handled at once
SPELLED = 1 << 15  # words that are spelled together, in their order
FLUSH = 400_000  # distinct words that a task holds before it passes their counts on
CLASSES = 6
MARKS = 512  # short frequent words whose company tells the classes
MARK_BYTES = 5
CLASS_BITS = 16  # slots of the class evidence, by four bytes in a row
DEPTH = 8  # bits of a word's code
ENDING = 2  # bytes of a word that give its code
SHORT = 3  # bytes of a short word, at most
CONTEXTS = 3  # the word before, the last short word, the last two short words
KNOWN = 3  # how well a context is known: never seen, fewer than four times, more
MAX_SLOTS = 19  # bits; of one context's table
LOCAL_RATE = 0.02
COUNT_AT = 1 << 18  # words that are counted at once
_P, _Q, _R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
NODES = np.arange(1 << 8, dtype=np.uint64) * _Q  # hashes of the nodes of a bit tree


def segments(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The spelled words in parts of SEGMENT bytes: (byte, context hash by order, word index)."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    for s in range(0, len(flat), SEGMENT):
        end, margin = min(s + SEGMENT, len(flat)), min(s, ORDERS[-1])
        first, last = np.searchsorted(ends, (s, end - 1), side="right")
        inside = np.minimum(ends[first:last + 1], end) - np.maximum(starts[first:last + 1], s)
        word = np.repeat(np.arange(first, last + 1), inside)
        pos = np.arange(s, end) - np.repeat(starts[first:last + 1], inside)
        # bytes from one on: what lies before the word counts as a zero byte
        near = np.concatenate((np.zeros(ORDERS[-1] - margin, np.uint64), flat[s - margin:end].astype(np.uint64) + np.uint64(1)))
        h = np.zeros(end - s, np.uint64)
        hashes, k = np.empty((len(ORDERS), end - s), np.uint64), 0
        for i, order in enumerate(ORDERS):
            while k < order:
                k += 1
                h += np.where(pos >= k, near[ORDERS[-1] - k:len(near) - k], np.uint64(1))
                h *= _P
            np.add(h, np.uint64(order * int(_R) % (1 << 64)), out=hashes[i])
        yield flat[s:end].astype(np.int64), hashes, word


def bits(byte: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits: (place, bit, node of the byte's bit tree, slot by order)."""
    for b in range(8):
        node = (1 << b) | (byte >> (8 - b))
        slot = hashes ^ NODES.take(node)
        slot *= _R
        slot >>= np.uint64(64 - SLOT_BITS)
        yield b, (byte >> (7 - b)) & 1, node, slot.view(np.int64)


def beginnings(byte: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that follow each other share their beginning: which bytes of a segment the word
    before does not have in the same way, and for each byte the place among those that serves it."""
    begin = np.flatnonzero(np.diff(word, prepend=-1))
    size = np.diff(begin, append=len(word))
    pos = np.arange(len(word)) - np.repeat(begin, size)
    there = np.concatenate(([0], size[:-1]))  # bytes of the word before
    if len(there) > 1:  # the segment's first word may be the rest of one
        there[1] = 0
    before = np.repeat(np.concatenate(([0], begin[:-1])), size) + pos
    same = (pos < np.repeat(there, size)) & (byte.take(np.minimum(before, len(byte) - 1)) == byte)
    new = pos >= np.repeat(np.minimum.reduceat(np.where(same, len(word), pos), begin), size)
    # place by place, the last new byte serves those that follow it
    order = np.argsort(pos, kind="stable")
    of = np.empty(len(word), np.int64)
    of[order] = order[np.maximum.accumulate(np.where(new[order], np.arange(len(word)), 0))]
    return new, (np.cumsum(new) - 1)[of]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def chance(s: np.ndarray) -> np.ndarray:
    """`squash` of stretched probabilities within -8 and 8."""
    p = np.exp(-s)
    p += 1
    return np.divide(1, p, out=p)


def shared(at: np.ndarray, part: np.ndarray, size: int) -> np.ndarray:
    """Sums of an adaptive map: each event is split between its bucket ``at`` and the next one
    (two places on), which gets ``part``."""
    above = np.bincount(at, part, size)
    out = np.bincount(at, minlength=size) - above
    out[2:] += above[:-2]
    return out


def averaged(s: np.ndarray, refine: np.ndarray, at: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A mixer's prediction, averaged with the adaptive map between buckets ``at`` and ``at + 1``."""
    flat = refine.ravel()
    p = np.append(np.diff(flat), np.float32(0)).take(at)
    p *= part
    p += flat.take(at)
    p += chance(s)
    p *= np.float32(.5)
    return np.clip(p, 1e-6, 1 - 1e-6, out=p)


def likelihood(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """``p`` where the bit is one, else ``1 - p``; ``p`` is overwritten."""
    p -= 1 - bit.astype(np.float32)
    return np.abs(p, out=p)


class Mixer:
    """Tables of counts by order, weights by gate, and the adaptive map."""

    def __init__(self):
        self.counts = np.zeros((len(ORDERS), 1 << SLOT_BITS, 2), np.float32)
        self.weights = np.full((8, SEEN, len(ORDERS) + 1), 1.0 / len(ORDERS), np.float32)
        self.weights[:, :, -1] = 0  # the constant's
        self.sums = np.zeros((256, BUCKETS, 2), np.float32)  # of the adaptive map
        self.freeze()

    def freeze(self) -> None:
        """Stretched predictions of every slot, for use without further learning."""
        self.ready = np.log(self.counts[:, :, 1] + np.float32(.2)) - np.log(self.counts[:, :, 0] + np.float32(.2))
        own = squash(np.linspace(-8, 8, BUCKETS))[None]
        self.refine = ((self.sums[:, :, 1] + 20 * own) / (self.sums.sum(2) + 20)).astype(np.float32)  # few seen: the identity

    def inputs(self, slot: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions by order (and a constant), and the gate's state: the longest
        order that says anything. Given the bits, each event is left out of the counts that
        predict it."""
        x = np.full((len(ORDERS) + 1, slot.shape[1]), .3, np.float32)
        state = np.zeros(slot.shape[1], np.uint8)
        if bit is not None:
            own = np.empty(len(bit), np.complex64)
            own.imag = bit
            own.real = 1 - bit
        for k, s in enumerate(slot):
            if bit is None:
                self.ready[k].take(s, out=x[k], mode="clip")
            else:
                n = self.counts[k].view(np.complex64)[:, 0].take(s)  # both counts in one look-up
                n -= own
                n += np.complex64(.2 + .2j)
                np.divide(n.imag, n.real, out=x[k])
                np.log(x[k], out=x[k])
            np.maximum(state, (x[k] != 0).view(np.uint8) * np.uint8(k + 1), out=state)
        return x, state.astype(np.int64)

    def mix(self, b: int, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        s, w = np.zeros(x.shape[1], np.float32), np.ascontiguousarray(self.weights[b].T)
        for k in range(len(x)):
            term = w[k].take(state)
            term *= x[k]
            s += term
        return np.clip(s, -8, 8, out=s)

    def learn(self, b: int, bit: np.ndarray, node: np.ndarray, slot: np.ndarray) -> None:
        """One online step: each gate's weights move along the mean gradient of its events,
        and the adaptive map counts what happened at the prediction."""
        x, state = self.inputs(slot, bit)
        s = self.mix(b, x, state)
        pick = (np.arange(SEEN)[:, None] == state).astype(np.float32)
        n = pick.sum(1)
        step = pick @ (x * (bit.astype(np.float32) - chance(s))).T
        self.weights[b] += (RATE * np.minimum(n / 50, 1) / np.maximum(n, 1))[:, None] * step
        low, part = self.place(s)
        self.sums += shared((node * BUCKETS + low) * 2 + bit, part, self.sums.size).reshape(self.sums.shape)

    @staticmethod
    def place(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (s + np.float32(8)) * np.float32((BUCKETS - 1) / 16)
        low = np.minimum(at.astype(np.int32), BUCKETS - 2)
        at -= low.astype(np.float32)
        return low.astype(np.int64), at

    def refined(self, s: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Probability of a one: the mixer's, averaged with the adaptive map's."""
        low, part = self.place(s)
        return averaged(s, self.refine, node * BUCKETS + low, part)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability that each word is spelled."""
        out = np.zeros(len(words))
        for byte, hashes, word in segments(words):
            out += np.bincount(word, self.log_bytes(byte, hashes), len(words))
        return out

    def log_bytes(self, byte: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each byte."""
        total = np.ones(len(byte))
        for b, bit, node, slot in bits(byte, hashes):
            total *= likelihood(self.refined(self.mix(b, *self.inputs(slot)), node), bit)
        return np.log(total, out=total)


def class_slots(byte: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (((hashes[ORDERS.index(3)] + byte.astype(np.uint64)) * _Q * _R) >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


class Odds:
    """Odds of the classes by spelling. ``evidence``: counts of four-byte sequences by slot and
    class."""

    def __init__(self, evidence: np.ndarray, damp: float = 0.7):
        self.damp, self.prior = damp, np.log((evidence.sum(0) + 1) / (evidence.sum() + evidence.shape[1]))
        seen = np.log(evidence + .5 * np.exp(self.prior)) - np.log(evidence.sum(1, keepdims=True) + .5) - self.prior
        self.columns = np.ascontiguousarray(seen.T)

    def add(self, total: np.ndarray, byte: np.ndarray, hashes: np.ndarray, word: np.ndarray) -> None:
        """Adds what a segment tells to the sums by word and class."""
        self.add_slots(total, class_slots(byte, hashes), np.arange(len(byte)), word)

    def add_slots(self, total: np.ndarray, slot: np.ndarray, of: np.ndarray, word: np.ndarray) -> None:
        first, last = word[0], word[-1] + 1
        for k, column in enumerate(self.columns):
            total[first:last, k] += np.bincount(word - first, column.take(slot).take(of), last - first)

    def of(self, total: np.ndarray) -> np.ndarray:
        post = self.damp * total + self.prior
        return post - np.logaddexp.reduce(post, axis=1, keepdims=True) - self.prior


def class_odds(words: list[bytes], evidence: np.ndarray) -> np.ndarray:
    """log P(class | spelling) - log P(class) of each word, by its four-byte sequences."""
    odds, total = Odds(evidence), np.zeros((len(words), evidence.shape[1]))
    for segment in segments(words):
        odds.add(total, *segment)
    return odds.of(total)


def _sums(part: int, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = np.ascontiguousarray(numbers, "f4").ravel()
    for i in range(0, len(flat), BLOCK):
        if flat[i:i + BLOCK].any():
            yield pa.RecordBatch.from_pydict({"part": [part + i // BLOCK], "sums": [zlib.compress(flat[i:i + BLOCK].tobytes(), 1)]})


def _add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK)
    for x in pdf["sums"]:
        v = np.frombuffer(zlib.decompress(x), "f4")
        total[:len(v)] += v
    total = total.astype("f4")
    return pd.DataFrame({"part": [int(key[0])], "sums": [total.tobytes()]})


def _total(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sums over all partitions; their size is fixed by the model, not by the input."""
    out = np.zeros(size, np.float32)
    got = rows.mapInArrow(run, "part bigint, sums binary").groupBy("part").applyInPandas(_add, "part bigint, sums binary")
    for r in got.collect():
        v = np.frombuffer(bytes(r.sums), "f4")[:size - r.part * BLOCK]
        out[r.part * BLOCK:r.part * BLOCK + len(v)] = v
    return out


def _words_of(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(0).to_numpy(zero_copy_only=False).tolist()


def _spelled(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of some SPELLED rows, or PIECE bytes, with their words in order."""
    held, rows, size = [], 0, 0

    def out():
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        batch = batch.take(pc.sort_indices(batch.column(0)))
        return batch, _words_of(batch)
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= SPELLED or size >= PIECE:
            yield out()
            held, rows, size = [], 0, 0
    if held:
        yield out()


def _count_contexts(classes: int):
    """Counts of bits by context, and of four-byte sequences by class, over distinct words."""
    def run(batches):
        counts = np.zeros((len(ORDERS), 2 << SLOT_BITS), np.int64)
        evidence = np.zeros((classes, 1 << CLASS_BITS))
        for batch, words in _spelled(batches):
            c = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(classes)], 1).astype(float)
            share = c / np.maximum(c.sum(1, keepdims=True), 1)
            for byte, hashes, word in segments(words):
                new, of = beginnings(byte, word)
                byte, hashes, times = byte[new], hashes[:, new], np.bincount(of)
                places = [slot * 2 + bit for _, bit, _, slot in bits(byte, hashes)]
                for k in range(len(ORDERS)):  # one table after the other stays in the cache
                    for at in places:
                        np.add.at(counts[k], at[k], times)
                slot = class_slots(byte, hashes)
                for k in range(classes):
                    np.add.at(evidence[k], slot, np.bincount(of, share[:, k].take(word), len(slot)))
        yield from _sums(0, counts)
        yield from _sums(counts.size // BLOCK, evidence.T)
    return run


def _learn(model: Mixer):
    def run(batches):
        n = 0
        for batch in batches:
            words = _words_of(batch)
            n += len(words)
            for byte, hashes, _ in segments(words):
                for b, bit, node, slot in bits(byte, hashes):
                    model.learn(b, bit, node, slot)
        if n:
            w = np.zeros(BLOCK, "f4")
            w[:model.weights.size], w[-1] = model.weights.ravel() * n, n
            yield from _sums(0, w)
            yield from _sums(1, model.sums)
    return run


def train_mixer(words: DataFrame, classes: int = 1) -> tuple[Mixer, np.ndarray]:
    """Model and class evidence from distinct words, in an order that tells nothing.
    ``words``: ``word, c`` and one count for each class."""
    model = Mixer()
    got = _total(words, _count_contexts(classes), model.counts.size + (classes << CLASS_BITS))
    model.counts = got[:model.counts.size].reshape(model.counts.shape)
    evidence = got[model.counts.size:].reshape(-1, classes)
    learned = _total(words, _learn(model), BLOCK + model.sums.size)
    if learned[BLOCK - 1]:  # weights of the partitions, averaged by their words
        model.weights = (learned[:model.weights.size] / learned[BLOCK - 1]).reshape(model.weights.shape)
        model.sums = learned[BLOCK:].reshape(model.sums.shape)
    model.freeze()
    return model, evidence


def text_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end (the empty word)."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of some PIECE bytes of text, a row at least."""
    size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`text_words` of many texts in one array, and the number of each text's."""
    t = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # a space behind the last word: the empty word is split off there, in the empty text anyway
    t = pc.ascii_split_whitespace(pc.if_else(pc.equal(t, ""), t, pc.binary_join_element_wise(t, "", " ")))
    return t.flatten().cast(pa.binary()), np.diff(t.offsets.to_numpy()).astype(np.int64)


def _count_short(batches):
    count = Counter()
    for batch in (p for b in batches for p in pieces(b)):
        words, size = split_texts(batch.column(0))
        length = pc.binary_length(words).to_numpy()
        short = (length > 0) & (length <= MARK_BYTES)
        met = words.filter(pa.array(short)).dictionary_encode()
        kinds = len(met.dictionary)
        pair = np.unique(np.repeat(np.arange(len(size)), size)[short] * kinds + met.indices.to_numpy())  # once for a text
        if kinds:
            count.update(dict(zip(met.dictionary.to_pylist(), np.bincount(pair % kinds).tolist(), strict=True)))
        if len(count) > FLUSH:
            yield pa.RecordBatch.from_pydict({"word": list(count), "n": list(count.values())})
            count.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])


def _company(marks: dict):
    """How many texts hold each pair of marks."""
    def run(batches):
        total, listed = np.zeros((len(marks), len(marks)), np.float32), pa.array(marks, pa.binary())
        for batch in (p for b in batches for p in pieces(b)):
            words, size = split_texts(batch.column(0))
            mark = found(words, listed)
            there = np.zeros((len(size), len(marks)), np.float32)
            there[np.repeat(np.arange(len(size)), size)[mark >= 0], mark[mark >= 0]] = 1
            total += there.T @ there
        yield from _sums(0, total)
    return run


class Classes:
    """Classes of texts, told by their marks: P(class) and P(mark | class)."""

    def __init__(self, marks: dict, company: np.ndarray, classes: int = CLASSES, rounds: int = 150):
        self.marks = marks
        c = company.astype(float)
        own = np.diag(c).copy()
        np.fill_diagonal(c, 0)
        if len(marks) < 2 * classes or not c.any():
            self.prior, self.p = np.ones(1), np.ones((1, max(len(marks), 1)))
            return
        # seeds: frequent marks whose company differs most from that of the seeds before
        kept = c / np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        seeds = [int(own.argmax())]
        while len(seeds) < classes:
            seeds.append(int((np.log(own + 1) * (1 - (kept @ kept[seeds].T).max(1))).argmax()))
        p = c[seeds] + .01 * own / own.sum()
        p /= p.sum(1, keepdims=True)
        a = np.full(classes, 1 / classes)
        for _ in range(rounds):  # c is explained as a sum over classes of a * p * p'
            q = c / np.maximum((p.T * a) @ p, 1e-12)
            new = p * a[:, None] * (p @ q) + 1e-9
            a = new.sum(1) / new.sum()
            p = new / new.sum(1, keepdims=True)
        self.prior, self.p = a, p + .1 / len(marks)
        self.p /= self.p.sum(1, keepdims=True)

    def __call__(self, words: set) -> int:
        at = [self.marks[w] for w in self.marks.keys() & words]
        return int((np.log(self.prior) + np.log(self.p[:, at]).sum(1)).argmax())

    def of(self, run: Running | Met) -> np.ndarray:
        """The class of each text of ``run``, whose words were read with the marks as ``known``."""
        there = np.zeros((len(run.size), len(self.marks)))
        at = run.known[run.at]
        marked = at >= 0
        there[run.text[marked], at[marked]] = 1
        return (np.log(self.prior) + sum_columns(there, np.log(self.p[:, :len(self.marks)]))).argmax(1)


def sum_columns(there: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.einsum("tm,km->tk", there, weights)  # small: not worth the threads of a matrix product


def find_classes(texts: DataFrame) -> Classes:
    """``texts``: one column of training texts. MARKS words and their pairs reach the driver."""
    top = (texts.mapInArrow(_count_short, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(MARKS).collect())
    marks = {bytes(r.word): i for i, r in enumerate(top)}
    return Classes(marks, _total(texts, _company(marks), len(marks) ** 2).reshape(len(marks), -1) if marks else np.zeros((0, 0)))


def word_code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word[-ENDING:], 1) >> (64 - DEPTH)


class Codes(dict):
    """`word_code` of many words; endings are a few bytes, so there are few."""

    def __missing__(self, end: bytes) -> int:
        self[end] = code = word_code(end)
        return code

    def __call__(self, words: pa.Array) -> np.ndarray:
        ends = pc.binary_slice(words, -ENDING).dictionary_encode()
        return np.array([self[e] for e in ends.dictionary.to_pylist()], np.uint64).take(ends.indices.to_numpy())


    def numbers(self, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
        """The tops of the hashes, the codes, and whether the words are short."""
        low, size = np.uint64(1 + DEPTH), pc.binary_length(words).to_numpy()
        return hashes >> low << low | self(words) << np.uint64(1) | ((size > 0) & (size <= SHORT)).astype(np.uint64)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def checks(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.int64, len(words))


class Tokens(defaultdict):
    """Words met so far, with their places. For each ``hashes`` has the hash, ``numbers`` its top
    with the code and whether the word is short, and each of ``lists`` a number where the list
    has the word, else -1."""

    def __init__(self, *lists: dict):
        super().__init__()
        self.lists, self.codes = lists, Codes()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.default_factory = count().__next__  # a new word has the next place
        self.hashes = self.numbers = np.zeros(0, np.uint64)
        self.of = [np.zeros(0, np.int64) for _ in self.lists]

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self) > FLUSH:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.lists:
            new = list(islice(self, len(self.of[0]), None))
            self.of = [np.append(have, np.fromiter(map(there.get, new, repeat(-1)), np.int64, len(new)))
                       for there, have in zip(self.lists, self.of, strict=True)]
        return at

    def hash_new(self) -> None:
        """Fills ``hashes`` and ``numbers``; who only counts words does without."""
        new = list(islice(self, len(self.numbers), None))
        if new:
            h = hashed(new)
            number = self.codes.numbers(h, pa.array(new, pa.binary()))
            self.hashes, self.numbers = np.append(self.hashes, h), np.append(self.numbers, number)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        at = self.places(words)
        self.hash_new()
        return self.numbers[at]


class Running:
    """The words of many texts as places in ``tokens``, whose first list has the marks."""

    def __init__(self, texts: pa.Array, tokens: Tokens, hashes: bool = True):
        words, self.size = split_texts(texts)  # words of each text
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        met = words.dictionary_encode()  # each word is looked up once
        self.at = tokens.places(met.dictionary.to_numpy(zero_copy_only=False).tolist()).take(met.indices.to_numpy())
        if hashes:
            tokens.hash_new()
        self.known, self.numbers = tokens.of[0], tokens.numbers


def found(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Place of each word in the list, or -1."""
    return pc.index_in(words, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)


class Met:
    """`Running` with the distinct words of these texts alone: none is kept for the next ones."""

    def __init__(self, texts: pa.Array, marks: pa.Array, codes: Codes):
        words, self.size = split_texts(texts)
        self.text = np.repeat(np.arange(len(self.size)), self.size)
        met = words.dictionary_encode()
        self.at, self.column = met.indices.to_numpy().astype(np.int64), met.dictionary
        self.words = self.column.to_numpy(zero_copy_only=False).tolist()
        self.hashes, self.known = hashed(self.words), found(self.column, marks)
        self.numbers = codes.numbers(self.hashes, self.column)


def _before(h: np.ndarray, at: np.ndarray, start: np.ndarray, none: int) -> np.ndarray:
    """The words at places ``at``; ``none`` where that lies before the text's start."""
    return np.where(at >= start, h[np.maximum(at, 0)], np.uint64(none))


class TextMixer:
    """Predicts the code of each word of a running text from the words before it."""

    def __init__(self, prior: np.ndarray, slots: int):
        """``prior``: probability of each code without context, by class; ``slots``: bits of a
        table."""
        self.slots = slots
        mass = np.maximum(prior, 1e-12)
        one = np.full((len(mass), 1 << DEPTH), .5)
        for b in range(DEPTH):
            part = mass.reshape(len(mass), 1 << b, 2, -1).sum(3)
            one[:, 1 << b:2 << b] = part[:, :, 1] / part.sum(2)
        one = np.clip(one, 1e-5, 1 - 1e-5)
        self.one = one.ravel().astype(np.float32)  # by class and node: P(1) without context
        code = np.arange(1 << DEPTH)
        nodes = [(1 << b) | (code >> (DEPTH - b)) for b in range(DEPTH)]
        self.hashes = [NODES[node] for node in nodes]  # by code, for each bit
        self.ones = [code >> (DEPTH - 1 - b) & 1 for b in range(DEPTH)]
        # by class and code, for each bit: what an unseen context counts as, stretched and plain
        self.ready = [np.log(one / (1 - one))[:, node].ravel().astype(np.float32) for node in nodes]
        self.none = [(1 - one + 1j * one)[:, node].ravel().astype(np.complex64) for node in nodes]
        self.alone = np.zeros((len(mass), 1 << DEPTH))  # log of the code's probability without context
        for node, bit in zip(nodes, self.ones, strict=True):
            p = self.one.reshape(len(mass), -1)[:, node].astype(float)
            self.alone += np.log(np.where(bit, p, 1 - p))
        self.counts = np.zeros((CONTEXTS, 2 << slots), np.float32)
        self.weights = np.full((DEPTH, KNOWN ** CONTEXTS, CONTEXTS), .4, np.float32)
        self.sums = np.zeros((DEPTH, BUCKETS, 2), np.float32)  # of the adaptive map
        self.freeze()

    def freeze(self) -> None:
        own = squash(np.linspace(-8, 8, BUCKETS))[None]
        self.refine = ((self.sums[:, :, 1] + 200 * own) / (self.sums.sum(2) + 200)).astype(np.float32)

    @staticmethod
    def parts(texts: list[np.ndarray], told: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(code, context hashes, class, text index) of SEGMENT words at a time, in order."""
        if texts:
            yield from TextMixer.stretches(np.concatenate(texts), np.fromiter(map(len, texts), np.int64, len(texts)), told)

    @staticmethod
    def stretches(h: np.ndarray, size: np.ndarray, told, step: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """`parts` of texts that follow each other in ``h``, of so many words each; of ``step``
        words where that is given."""
        if not len(h):
            return
        text = np.repeat(np.arange(len(size)), size)
        start = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(len(h))
        short = np.maximum.accumulate(np.where(h & np.uint64(1) == 1, at, -1))  # the last short word so far
        last = np.concatenate(([-1], short[:-1]))
        second = np.where(last >= 0, last[np.maximum(last, 0)], -1)
        one, two = _before(h, last, start, 7), _before(h, second, start, 9)
        ctx = np.stack(((_before(h, at - 1, start, 1) + np.uint64(1)) * _P, (one + np.uint64(5)) * _Q, (one * _P + two + np.uint64(11)) * _R))
        code = (h >> np.uint64(1)).astype(np.int64) & ((1 << DEPTH) - 1)
        kind = np.array(told, np.int64)[text]
        step = step or SEGMENT
        for i in range(0, len(h), step):
            yield code[i:i + step], ctx[:, i:i + step], kind[i:i + step], text[i:i + step]

    def bits(self, code: np.ndarray, ctx: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bit of the codes: (place, bit, slot by context)."""
        for b in range(DEPTH):
            slot = ctx ^ self.hashes[b].take(code)
            slot *= _R
            slot >>= np.uint64(64 - self.slots)
            yield b, self.ones[b].take(code), slot.view(np.int64)

    def inputs(self, b: int, own: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched prediction without context, what each context adds, and the gate's state.
        ``own``: class and code in one number."""
        s0, none = self.ready[b].take(own), self.none[b].take(own)
        x, state = np.empty((CONTEXTS, len(own)), np.float32), np.zeros(len(own), np.uint8)
        for k in range(CONTEXTS):
            n = self.counts[k].view(np.complex64).take(slot[k])  # both counts in one look-up
            seen = n.real + n.imag
            state *= KNOWN
            state += (seen > 0).view(np.uint8)
            state += (seen >= 4).view(np.uint8)
            n += none
            np.divide(n.imag, n.real, out=x[k])
        np.log(x, out=x)
        x -= s0
        return s0, x, state.astype(np.int64)

    def mix(self, b: int, s0: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        s, w = s0.copy(), np.ascontiguousarray(self.weights[b].T)
        for k in range(CONTEXTS):
            term = w[k].take(state)
            term *= x[k]
            s += term
        return np.clip(s, -8, 8, out=s)

    def learn(self, code: np.ndarray, ctx: np.ndarray, kind: np.ndarray) -> None:
        """Predict a stretch of text with what is counted so far, and move the weights."""
        size = KNOWN ** CONTEXTS
        own = (kind << DEPTH) + code
        for b, bit, slot in self.bits(code, ctx):
            s0, x, state = self.inputs(b, own, slot)
            s = self.mix(b, s0, x, state)
            miss = bit.astype(np.float32) - chance(s)
            n = np.bincount(state, minlength=size)
            step = np.stack([np.bincount(state, miss * x[k], size) for k in range(CONTEXTS)], 1)
            self.weights[b] += (LOCAL_RATE * np.minimum(n / 50, 1) / np.maximum(n, 1))[:, None] * step
            low, part = Mixer.place(s)
            self.sums[b] += shared(low * 2 + bit, part, 2 * BUCKETS).reshape(BUCKETS, 2)

    def count(self, code: np.ndarray, ctx: np.ndarray) -> None:
        self.count_all([(code, ctx)])

    def count_all(self, stretches: list[tuple[np.ndarray, np.ndarray]]) -> None:
        met = np.zeros(self.counts.shape, np.int32)  # whole numbers: exact, however many
        for code, ctx in stretches:
            places = [slot * 2 + bit for _, bit, slot in self.bits(code, ctx)]
            for k in range(CONTEXTS):  # one table after the other stays in the cache
                for at in places:
                    np.add.at(met[k], at[k], np.int32(1))
        self.counts += met

    def gain(self, texts: list[np.ndarray], told: list[int]) -> np.ndarray:
        """Natural log of how much likelier each text is in its order than by P0 alone."""
        return self._gain(self.parts(texts, told), len(texts))

    def _gain(self, parts: Iterator, n: int) -> np.ndarray:
        out = np.zeros(n)
        for code, ctx, kind, text in parts:
            total, own = np.ones(len(code)), (kind << DEPTH) + code
            for b, bit, slot in self.bits(code, ctx):
                s = self.mix(b, *self.inputs(b, own, slot))
                total *= likelihood(averaged(s, self.refine[b], *Mixer.place(s)), bit)
            first, last = text[0], text[-1] + 1
            out[first:last] += np.bincount(text - first, np.log(total) - self.alone[kind, code], last - first)
        return out


def _learn_texts(model: TextMixer, classes: Classes):
    def run(batches):
        marks, codes, tokens, held, size = pa.array(classes.marks, pa.binary()), Codes(), 0, [], 0
        for batch in (p for b in batches for p in pieces(b)):
            words = Met(batch.column(0), marks, codes)
            for code, ctx, kind, _ in model.stretches(words.numbers[words.at], words.size, classes.of(words)):
                model.learn(code, ctx, kind)
                tokens += len(code)
                held.append((code, ctx))
                size += len(code)
                if size >= COUNT_AT:
                    model.count_all(held)
                    held, size = [], 0
        model.count_all(held)
        if tokens:
            w = np.zeros(BLOCK, "f4")
            w[:model.weights.size], w[-1] = model.weights.ravel() * tokens, tokens
            yield from _sums(0, w)
            yield from _sums(1, np.concatenate((model.sums.ravel(), np.zeros(BLOCK - model.sums.size, "f4"))))
            yield from _sums(2, model.counts)
    return run


def train_texts(texts: DataFrame, prior: np.ndarray, tokens: int, classes: Classes) -> TextMixer:
    """``texts``: one column of training texts, read in the order of their rows."""
    slots = int(min(max(math.ceil(math.log2(tokens + 1)) + 2, 12), MAX_SLOTS))
    model = TextMixer(prior, slots)
    got = _total(texts, _learn_texts(model, classes), 2 * BLOCK + model.counts.size)
    if got[BLOCK - 1]:  # weights of the partitions, averaged by their words; counts are sums
        model.weights = (got[:model.weights.size] / got[BLOCK - 1]).reshape(model.weights.shape)
        model.sums = got[BLOCK:BLOCK + model.sums.size].reshape(model.sums.shape)
        model.counts = np.ascontiguousarray(got[2 * BLOCK:].reshape(model.counts.shape))
    model.freeze()
    return model


def _count_words(classes: Classes):
    n = len(classes.prior)

    def out(place, count):
        return pa.RecordBatch.from_arrays([pa.array(list(place), pa.binary()), *(pa.array(c[:len(place)], pa.int64()) for c in count)],
                                          ["word", *(f"c{k}" for k in range(n))])

    def run(batches):
        place, count = Tokens(classes.marks), np.zeros((n, 0), np.int64)
        for batch in (p for b in batches for p in pieces(b)):
            words = Running(batch.column(0), place, hashes=False)
            if len(place) > count.shape[1]:
                count = np.concatenate((count, np.zeros((n, 2 * len(place) - count.shape[1]), np.int64)), 1)
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)[words.text]
            np.add.at(count.ravel(), classes.of(words)[words.text[learn]] * count.shape[1] + words.at[learn], 1)
            if len(place) > FLUSH:
                yield out(place, count)
                place, count = Tokens(classes.marks), np.zeros((n, 0), np.int64)
        yield out(place, count)
    return run


def _score_words(model: Mixer, evidence: np.ndarray):
    classes = evidence.shape[1]

    def run(batches):
        tell, codes = Odds(evidence), Codes()
        for batch, words in _spelled(batches):
            lp, odds = np.zeros(len(words)), np.zeros((len(words), classes))
            for byte, hashes, word in segments(words):
                new, of = beginnings(byte, word)
                byte, hashes, first, last = byte[new], hashes[:, new], word[0], word[-1] + 1
                lp[first:last] += np.bincount(word - first, model.log_bytes(byte, hashes).take(of), last - first)
                tell.add_slots(odds, class_slots(byte, hashes), of, word)
            odds = tell.of(odds)
            code = pa.array(codes(batch.column(0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashed(words).view(np.int64)), pa.array(checks(words)), code,
                                              *(pa.array(lp + odds[:, k]) for k in range(classes))],
                                             [*batch.schema.names, "key", "chk", "code", *(f"s{k}" for k in range(classes))])
    return run


def _score_texts(index: dict, known: np.ndarray, table: np.ndarray, classes: Classes, mixer: TextMixer):
    """Sums over the broadcast words of a text, its class by its marks, and what its order gains
    there; its other words as key, check and count."""
    columns = np.ascontiguousarray(table.T)

    def run(batches):
        marks, top, codes = pa.array(classes.marks, pa.binary()), pa.array(index, pa.binary()), Codes()
        for batch in (p for b in batches for p in pieces(b, 1)):
            words, texts = Met(batch.column(1), marks, codes), batch.num_rows
            told = classes.of(words)
            at = found(words.column, top).take(words.at)
            here = at >= 0
            text, at = words.text[here], at[here]
            sums = np.stack([np.bincount(text, column.take(at), texts) for column in columns], 1).astype(float)  # without words: integers
            # the other words: each once for a text, with its number there
            kinds = len(words.words)
            pair, ns = np.unique(words.text[~here] * kinds + words.at[~here], return_counts=True)
            ends = np.concatenate(([0], np.cumsum(np.bincount(pair // max(kinds, 1), minlength=texts))))
            pair %= max(kinds, 1)
            check = np.zeros(kinds, np.int64)
            check[pair] = 1
            rare = np.flatnonzero(check)
            check[rare] = checks([words.words[i] for i in rare.tolist()])
            rest = pa.StructArray.from_arrays([pa.array(words.hashes[pair].view(np.int64)), pa.array(check[pair]), pa.array(ns.astype(np.int64))], ["key", "chk", "n"])
            gain = mixer._gain(mixer.stretches(words.numbers[words.at], words.size, told, NEAR), texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64()), pa.array(words.size),
                 pa.array(np.bincount(text, known.take(at), texts).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(texts + 1) * len(columns), pa.int32()), pa.array(sums.ravel())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest), pa.array(gain), pa.array(told, pa.int32())],
                ["doc_id", "n_bytes", "n_tokens", "n_known", "sums", "rest", "gain", "kind"])
    return run


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts, ``most`` at most: all from a count on. The count
    comes from a histogram over 32 steps for each doubling, so no task sends its own top."""
    step = F.floor(F.log2(F.col("c")) * 32).cast("int")
    rows = words.where("c > 0").groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("s")).collect()
    least, total = None, 0
    for r in rows:
        total += r.n
        if total > most:
            break
        least = r.s
    return words.where(F.lit(False)) if least is None else words.where((F.col("c") > 0) & (step >= least))


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def route_weights(scored: DataFrame, sizes: list[int], rounds: int = 8) -> tuple[float, float, float]:
    """Trust in the routes (class frequency, frequency, spelling), by expectation maximisation
    over the training words; each occurrence is left out of the counts it is picked by."""
    total = sum(sizes)
    if total < 2:
        return 0.0, 0.0, 1.0
    trust = (.5, .3, .2)
    # a word met once is left out of all its counts: it speaks for the spelling alone
    again = materialize(scored.where("c > 1").select("c", *[f"{x}{k}" for x in "cs" for k in range(len(sizes))]), "again")
    for _ in range(rounds):
        sums = []
        for k, n in enumerate(sizes):
            c = F.col(f"c{k}")
            a = F.lit(trust[0]) * _safe(c - 1, F.lit(float(n - 1)))
            b = F.lit(trust[1]) * (F.col("c") - 1) / F.lit(float(total - 1))
            every = a + b + F.lit(trust[2]) * F.exp(f"s{k}")
            sums += [F.sum(F.when(c > 0, c * _safe(x, every)).otherwise(0.0)) for x in (a, b)]
        got = [float(x or 0) / total for x in again.agg(*sums).first()]
        first, second = max(sum(got[::2]), 1e-4), max(sum(got[1::2]), 1e-4)
        new = (first, second, max(1 - first - second, 1e-4))
        moved = max(abs(x - y) for x, y in zip(new, trust, strict=True))
        trust = tuple(x / sum(new) for x in new)
        if moved < 1e-3:
            break
    release(again)
    return trust


def _log_sum(parts: list[Column]) -> Column:
    """log of the sum of exponentials; null parts count as nothing."""
    top = F.greatest(*parts, F.lit(-1e300))
    return top + F.log(sum((F.coalesce(F.exp(p - top), F.lit(0.0)) for p in parts), F.lit(0.0)))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 5, held_out: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Texts whose id's crc32 modulo ``buckets`` is ``held_out`` teach nothing; all others do. A
    null text counts as empty (one token, the end; ``bits_per_byte`` is null without bytes); a
    null id counts as the empty text in crc32. Rows repeat as they come in. With nothing to
    learn from, ``base_score`` is 0 and every bit of a word costs one bit. Very long texts are
    scored whole; of equally frequent words none is preferred (a count is broadcast or joined as
    a whole). Other columns are not read, whatever their names. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    prepare(spark)
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = code_bucket(F.col("doc_id"), buckets) == held_out
    classes = find_classes(src.where(~out).select("text"))
    n = len(classes.prior)
    each = [f"c{k}" for k in range(n)]
    vocab = (src.select("text", (~out).alias("learn"))
             .mapInArrow(_count_words(classes), "word binary, " + ", ".join(f"{c} bigint" for c in each))
             .groupBy("word").agg(*[F.sum(c).alias(c) for c in each]))
    # hashed by word: an order that tells nothing
    vocab = materialize(vocab.select("word", sum((F.col(c) for c in each), F.lit(0)).cast("bigint").alias("c"), *each), "vocabulary")
    kinds, *sizes = vocab.agg(F.count_if(F.col("c") > 0), *[F.coalesce(F.sum(c), F.lit(0)) for c in each]).first()
    total = sum(sizes)
    texts_of = vocab.where(F.col("word") == F.lit(b"")).select(*each).first() or [0] * n  # one end in each text
    model, evidence = train_mixer(vocab.where("c > 0").coalesce(TASKS), n)
    scored = materialize(vocab.mapInArrow(_score_words(model, evidence), "word binary, c bigint, " + ", ".join(f"{c} bigint" for c in each)
                                          + ", key bigint, chk bigint, code int, " + ", ".join(f"s{k} double" for k in range(n))), "spelled")
    release(vocab)
    trust = route_weights(scored, sizes)
    tenth = math.log(10)
    base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (kinds + 1)))
    scores = []
    for k, size in enumerate(sizes):
        parts = [F.col(f"s{k}") + F.lit(math.log(trust[2]))]
        if trust[0] and size:
            parts.append(F.when(F.col(f"c{k}") > 0, F.log(F.col(f"c{k}") / F.lit(float(size))) + F.lit(math.log(trust[0]))))
        if trust[1]:
            parts.append(F.when(F.col("c") > 0, F.log(F.col("c") / F.lit(float(total))) + F.lit(math.log(trust[1]))))
        scores.append(_log_sum(parts).alias(f"p{k}"))
    names = [f"p{k}" for k in range(n)]
    words = scored.select("word", "key", "chk", "code", "c", base.alias("base"), *scores)
    # P0 of each code by class: of the training words by their own, of all others alike
    mass = np.zeros((n, 1 << DEPTH))
    for r in words.where("c > 0").groupBy("code").agg(*[F.sum(F.exp(x)).alias(x) for x in names]).collect():  # 2**DEPTH rows
        mass[:, r.code] = [r[x] for x in names]
    mass += np.maximum(1 - mass.sum(1, keepdims=True), 1e-6) / (1 << DEPTH)
    mixer = train_texts(src.where(~out).select("text"), mass, total, classes)
    top = frequent(words, TOP).drop("key", "chk", "code").toArrow()  # TOP words at most
    index = {w: i for i, w in enumerate(top.column("word").to_pylist())}
    known = np.ones(len(index))  # they occur in training texts
    table = np.stack([top.column(x).to_numpy() for x in ("base", *names)], 1).astype(float).reshape(-1, n + 1)
    seen = sum(texts_of)
    priors = [math.log((t + .5) / (seen + .5 * n)) for t in texts_of]
    shared = spark.sparkContext.broadcast((index, known, table, classes, mixer))

    def texts(batches):
        yield from _score_texts(*shared.value)(batches)

    rows = materialize(
        src.mapInArrow(texts, "doc_id bigint, n_bytes bigint, n_tokens bigint, n_known bigint, sums array<double>, "
                              "rest array<struct<key: bigint, chk: bigint, n: bigint>>, gain double, kind int")
        .withColumn("row", F.monotonically_increasing_id()), "texts")
    rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.key", "r.chk", "r.n")
    joined = rest.join(words.drop("word", "code"), ["key", "chk"])
    more = joined.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k2"),
                                     *[F.sum(F.col("n") * F.col(x)).alias(f"{x}_2") for x in ("base", *names)])
    both = rows.drop("rest").join(more, "row", "left")
    add = lambda x, i: F.col("sums")[i] + F.coalesce(f"{x}_2", F.lit(0.0))
    # half for the classes by P0, half for the told class with the order of the words: of all
    # texts together, one at most, as the told class is a function of the text
    ways = [add(x, i + 1) + F.lit(priors[i] - math.log(2)) for i, x in enumerate(names)]
    score = _log_sum([*ways, *[F.when(F.col("kind") == i, w + F.col("gain")) for i, w in enumerate(ways)]]) / F.lit(tenth)
    both = both.select("doc_id", "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"),
                       add("base", 0).alias("base_score"), score.alias("score"))
    return both.select("doc_id", (code_bucket(F.col("doc_id"), buckets) == held_out).alias("held_out"), "n_tokens", "n_known",
                       F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score",
                       F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
