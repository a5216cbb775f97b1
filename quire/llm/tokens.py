"""Token counts of whole texts by the whole-token shortcut.

A byte-level BPE vocabulary holds many strings that, met as a pre-token, come out as exactly
one token. `prove_whole` finds them offline, by encoding every vocabulary string alone. A
text is cut into pre-tokens with the tokenizer's own pattern; proven ones count one each,
and only the distinct rest is merged (by the library) and remembered.

The pattern engine here and the library's follow different Unicode versions. `SAME` lists
code point ranges in which both cut alike (a test goes through every code point); a text
with any other character, or with a special string, is given to the library as a whole.
"""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import prepare

LIMIT = 512
MEMO = 400_000  # remembered pre-tokens in a worker; a full memo starts anew
SAME = ((0x0000, 0x0557), (0x0561, 0x0586), (0x1E00, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x218B), (0x3040, 0x3096),
        (0x30A0, 0x30FF), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3))
OTHER = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAME) + "]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for U+0100 and on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str):
    """The tokenizer and its pre-token pattern; only byte-level BPE without changes to the
    text before it is supported."""
    from tokenizers import Tokenizer
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError("the shortcut needs a byte-level BPE without normalizer and prefix space")
    import public_tokenizers
    return Tokenizer.from_file(path), regex.compile(public_tokenizers.PATTERN)


def prove_whole(path: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    tok, pattern = load(path)
    letters = byte_letters()
    texts = []
    for v in tok.get_vocab(with_added_tokens=False):
        try:
            s = bytes(letters[c] for c in v).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character, or no byte string: never a pre-token
        if not OTHER.search(s) and pattern.findall(s) == [s]:
            texts.append(s)
    return {s: 1 for s, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1}


class TokenCounter:
    """Counts tokens in one Python worker."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tok, self.pattern = load(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.whole, self.memo = whole, dict(whole)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if OTHER.search(text) or any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        found = self.pattern.findall(text)
        new = list(set(found).difference(self.memo))
        if new:
            if len(self.memo) + len(new) > MEMO + len(self.whole):
                self.memo = dict(self.whole)
                new = list(set(found).difference(self.memo))
            self.memo.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False)),
                                 strict=True))
        return sum(map(self.memo.__getitem__, found))


_COUNTERS: dict[str, TokenCounter] = {}  # one per worker process and tokenizer


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null text counts as empty: no bytes, no tokens. Rows repeat as they come in, ids may
    be null, an empty table gives an empty result. Very long texts are counted whole; other
    columns are not read, whatever their names. ``path`` names a tokenizer file that every
    executor can read.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = path or tokenizer_path()
    whole = spark.sparkContext.broadcast(prove_whole(path))  # bounded by the vocabulary

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path, whole.value)
        return texts.map(_COUNTERS[path].count).astype("int64")

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
            .select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), count("text").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
