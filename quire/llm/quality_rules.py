"""Quality rules, line first, in DataFrame expressions only.

Every line is held against punctuation, navigation and boilerplate rules; lines that fail
are removed. A document is rejected if it loses too many of its words that way, or if it
fails the base rules on the whole text (too short, or too much of it in repeated windows).
Nothing leaves the row: there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.rows import keep_where
from quire.llm.common import SPACES, let, pack_row, unpack_row, words_array

MIN_WORDS = 10
WINDOW = 5
REPEAT_PCT = 20
MAX_LOST = 0.5  # share of a document's words in removed lines
NOISE_SHARE = 0.3  # of a line's words end in symbols: a punctuation failure
NAV_SHARE = 0.15  # of a line's words are separators: navigation
SYMBOLS = "#*$%&|<>"
NOISE_WORD = r"([#*$%&<>]{2,}|!!)"
SEPARATORS = r"[|>»·•]"
SENTENCE_END = r"[.!?…][\"')\]]*([ \t-\r]|$)"
BOILERPLATE = (r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|"
               r"accept (all )?cookies|enable javascript|javascript is (disabled|required)|lorem ipsum|"
               r"click here|read more|sign (in|up)|log in|skip to content|back to top|share (on|this)|"
               r"subscribe to our)")


def _chars_without(text: Column, drop: str) -> Column:
    return F.char_length(F.translate(text, drop, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    def covered(keys):
        pairs = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        def of(t):
            twice = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (F.get(t, i - 1)["k"] == t[i]["k"])
                             | (F.get(t, i + 1)["k"] == t[i]["k"]))
            starts = F.sort_array(F.transform(twice, lambda i: t[i]["i"]))
            # from each start to the next one, a window's length at most
            return let(starts, lambda s: F.aggregate(
                F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda j: F.least(F.lit(window), s[j] - s[j - 1])),
                F.lit(window), lambda a, x: a + x))
        return let(pairs, of)
    def windows(h):
        return F.when(F.size(h) <= window, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[h[i + j] for j in range(window)])))
    keys = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))


def judge_lines(text: Column) -> Column:
    """Array of ``struct<line, words, rule>``; ``rule`` names what the line fails (null: nothing).

    A line without words fails nothing.
    """
    def judged(line):
        n = F.regexp_count(line, F.lit(r"[^ \t-\r]+"))
        noise = F.regexp_count(line, F.lit(NOISE_WORD + r"(?=[ \t-\r]|\z)"))
        nav = F.regexp_count(line, F.lit(r"(?<![^ \t-\r])" + SEPARATORS + r"(?![^ \t-\r])"))
        rule = (F.when(n == 0, F.lit(None).cast("string"))
                .when(noise > n * NOISE_SHARE, F.lit("noise"))
                .when(nav > n * NAV_SHARE, F.lit("navigation"))
                .when(line.rlike(BOILERPLATE), F.lit("boilerplate"))
                .when(~line.rlike(SENTENCE_END), F.lit("punctuation")))
        return F.struct(line.alias("line"), n.alias("words"), rule.alias("rule"))
    return F.transform(F.split(text, "\n"), judged)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """Rules on every row: ``_row`` (the input), base counts, ``base_failed, lines, lost_words,
    clean_text, kept``.

    A null text counts as empty: no words, so it fails the base rules. Rows repeat as they
    come in, ids may be null, an empty table gives an empty result. Very long texts and lines
    are judged whole. Other columns stay inside ``_row``, so no name clashes.
    """
    src = pack_row(docs).withColumn("text", F.coalesce(F.col("_row").getField(text_col), F.lit("")))
    words = words_array(F.col("text"))
    counts = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).cast("bigint").alias("r")))
    full_lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    dup = let(full_lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = src.withColumns({"c": counts, "lines": judge_lines(F.col("text"))}).select(
        "_row", F.col("_row").getField(id_col).alias("doc_id"), F.col("c.n").alias("n_words"),
        _chars_without(F.col("text"), SPACES).cast("bigint").alias("word_chars"),
        (F.char_length("text") - _chars_without(F.col("text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        dup.cast("bigint").alias("n_dup_lines"), F.col("c.r").alias("n_repeat_words"), "lines",
        F.aggregate(F.filter("lines", lambda x: x["rule"].isNotNull()), F.lit(0),
                    lambda a, x: a + x["words"]).cast("bigint").alias("lost_words"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PCT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_words") <= max_lost * F.col("n_words")))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars",
          **params) -> DataFrame:
    """The documents that stay, their failing lines removed, in the columns of ``docs``.

    ``length_col``, where the table has it, is set to the new length in code points; a text
    that loses no line stays as it is, and so does its length.
    """
    # a plain filter would be pushed below the rules and judge every line twice
    kept = keep_where(apply_rules(docs, id_col, text_col, **params), F.col("kept")).select("_row", "lost_words", "clean_text")
    cut = F.col("lost_words") > 0
    cols = []
    for c, t in docs.dtypes:
        col = F.col("_row").getField(c)
        if c == text_col:
            col = F.when(cut, F.col("clean_text")).otherwise(col)
        elif c == length_col:
            col = F.when(cut, F.char_length("clean_text").cast(t)).otherwise(col)
        cols.append(col.alias(c))
    return kept.select(*cols)


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)),
judged AS (
  SELECT doc_id, line, len(lw) AS n,
         len(lw) > 0 AND (
           len(list_filter(lw, lambda x: regexp_matches(x, '{NOISE_WORD}$'))) > len(lw) * {NOISE_SHARE}
           OR len(list_filter(lw, lambda x: regexp_full_match(x, '{SEPARATORS}'))) > len(lw) * {NAV_SHARE}
           OR regexp_matches(line, '{BOILERPLATE}')
           OR NOT regexp_matches(line, '{SENTENCE_END.replace("'", "''")}')) AS failed
  FROM ln),
l AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (failed), 0) AS BIGINT) AS lost,
             count(*) FILTER (n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS dup
      FROM judged GROUP BY doc_id),
b AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(l.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, l.lost
  FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PCT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= {MAX_LOST} * n_words AS kept
FROM f
"""
