"""Document fingerprints by Order MinHash, in DataFrame expressions only.

A k-mer is ``k`` consecutive words, numbered by its occurrence in the text; a text of fewer
than ``FEW_WORDS`` words is cut into k-mers of ``CHAR_K`` code points. Each numbered k-mer has
one hash; its leading bits deal it to one of ``bins`` independent selections. A selection takes
its ``ell`` smallest k-mers, going on into the following bins (after the last the first) where
it holds fewer, so every tuple has ``ell`` k-mers if the text does. It puts them back in text
order and hashes that tuple: two texts agree in a bin only if the same k-mers win there in the
same order, which makes the share of agreeing bins follow edit distance rather than set overlap.

Everything happens inside one row on arrays of longs: hash (33 bits) and position (30 bits,
more than any text has words) share a long, so one primitive sort brings equal k-mers
together and another brings the bins together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import SPACES, let, materialize, ordered_index, words_array

K = 2
ELL = 2
BINS = 64
FEW_WORDS = 10
CHAR_K = 4
POS_BITS = 30
_POS = (1 << POS_BITS) - 1
_TOP = ~_POS & ((1 << 63) - 1)


def _pack(hash64: Column, pos: Column) -> Column:
    return hash64.bitwiseAND(F.lit(_TOP)).bitwiseOR(pos.cast("bigint"))


def _kmers(symbols: Column, k: int) -> Column:
    """Hashes of the windows of k symbols in text order; a shorter text is one window."""
    def windows(h):
        n = F.size(h)
        full = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(h))).otherwise(full)
    return let(F.transform(symbols, lambda w: F.xxhash64(w)), windows)


def _text_kmers(text: Column, k: int) -> Column:
    chars = F.split(F.trim(text, F.lit(SPACES)), "")
    return let(words_array(text), lambda w: F.when((F.size(w) > 0) & (F.size(w) < FEW_WORDS), _kmers(chars, CHAR_K)).otherwise(_kmers(w, k)))


def _numbered(kmers: Column) -> Column:
    """(hash of k-mer and occurrence number, position), packed, in hash order."""
    def runs(s):
        top = lambda x: F.shiftright(x, POS_BITS)
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (top(s[i]) != top(s[i - 1])))
        def one(st):
            def expand(a, j):
                size = F.coalesce(F.get(st, j + 1), F.size(s)) - a
                first = F.array(_pack(F.xxhash64(top(s[a])), s[a].bitwiseAND(F.lit(_POS))))
                more = F.transform(F.slice(s, a + 1, size), lambda x, o: F.when(
                    o == 0, _pack(F.xxhash64(top(x)), x.bitwiseAND(F.lit(_POS)))).otherwise(
                    _pack(F.xxhash64(top(x), o), x.bitwiseAND(F.lit(_POS)))))
                return F.when(size == 1, first).otherwise(more)
            return F.flatten(F.transform(st, expand))
        return let(starts, one)
    packed = let(kmers, lambda h: F.sort_array(F.transform(h, lambda x, i: _pack(x, i))))
    return let(packed, lambda s: F.when(F.size(s) == 0, s).otherwise(F.sort_array(runs(s))))


def signature(text: Column, k: int = K, ell: int = ELL, bins: int = BINS) -> Column:
    """Signature of a text: one int (bin number, 24 bits of the tuple's hash) for every bin,
    by bin. Null and wordless texts have none.

    ``bins`` must be a power of two, 64 at most.
    """
    if bins not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("bins must be a power of two, 64 at most")
    bin_of = lambda x: F.shiftright(x, 63 - (bins.bit_length() - 1)).cast("int")
    text_order = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_POS)), 33).bitwiseOR(F.shiftright(x, POS_BITS))
    hash33 = F.lit((1 << 33) - 1)

    def select(z):
        # z is in hash order: a bin's k-mers are neighbours, and the next bin's follow them
        def tuples(starts):
            round_ = F.concat(z, F.slice(z, 1, F.least(F.lit(ell - 1), F.size(z) - 1)))
            def of_bin(r, i):
                winners = F.slice(r, i + 1, F.least(F.lit(ell), F.size(z)))
                return F.xxhash64(F.transform(F.sort_array(F.transform(winners, text_order)),
                                              lambda y: y.bitwiseAND(hash33))).bitwiseAND(F.lit(0xFFFFFF))
            hashes = let(round_, lambda r: F.transform(starts, lambda i: of_bin(r, i)))
            def spread(t):  # an empty bin has the tuple of the next bin that is not
                served = F.transform(t, lambda h, j: F.array_repeat(h, bin_of(z[starts[j]]) - F.when(
                    j > 0, bin_of(F.get(z, F.get(starts, j - 1)))).otherwise(F.lit(-1))))
                return F.concat(F.flatten(served), F.array_repeat(t[0], F.lit(bins - 1) - bin_of(F.element_at(z, -1))))
            return F.transform(let(hashes, spread), lambda h, b: F.shiftleft(b.cast("bigint"), 24).bitwiseOR(h).cast("int"))
        starts = F.filter(F.sequence(F.lit(0), F.size(z) - 1), lambda i: (i == 0) | (bin_of(z[i]) != bin_of(z[i - 1])))
        return F.when(F.size(z) == 0, F.array().cast("array<int>")).otherwise(let(starts, tuples))
    return let(_numbered(_text_kmers(F.coalesce(text, F.lit("")), k)), select)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins (1 if neither text fills any, 0 if one alone does)."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 24))
    used = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def to_text(sig: Column) -> Column:
    """Eight hexadecimal digits for every filled bin: its number, then its tuple's hash."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ell: int = ELL,
                      bins: int = BINS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text replaces the last quarter of the code points by the head of the next
    document (ascending id, null ids last, rows of one id by text hash; after the last
    comes the first). A null text counts as empty. Rows equal in id and text count as one
    document and each get its result. Returns ``doc_id, text, edited, sig, edited_sig,
    next_sig, near_edited, near_next``; an empty table gives an empty result.

    The text is shuffled once: the next documents' heads and the documents themselves are
    read from the same exchange, and only a head of the needed length travels on.
    """
    sig = signature(F.col("text"), k, ell, bins)
    src = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
           # (kid, th) is the key of a document: id and text hash, whose last bit says "no id"
           .select("text", F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("kid"),
                   F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("bigint")).alias("th")))
    none = F.col("th").bitwiseAND(F.lit(1)) == 1
    own_id = F.when(~none, F.col("kid"))
    keys = (src.select("kid", "th", none.alias("none"), F.char_length("text").alias("n"))
            .groupBy("none", "kid", "th").agg(F.max("n").alias("n")))
    order = ordered_index(keys, [F.col("none"), F.col("kid"), F.col("th")])
    total = order.agg(F.count(F.lit(1))).first()[0]
    before = order.select(((F.col("_index") + 1) % F.lit(max(total, 1))).alias("_index"), F.col("kid").alias("to_kid"),
                          F.col("th").alias("to_th"), F.col("n").alias("to_n"))
    steps = materialize(order.select("_index", "kid", "th").join(before, "_index").drop("_index"), "steps")

    # One exchange serves both sides, so below it there is no lambda (Spark takes two plans that
    # hold one for different ones) and no column that a caller's projection could take from one
    # side alone. Each side computes the signature after it.
    rows = src.select("kid", "th", "text").repartition("kid", "th")
    once = Window.partitionBy("kid", "th").orderBy("kid")
    heads = (rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").join(steps, ["kid", "th"])
             .select(F.col("to_kid").alias("kid"), F.col("to_th").alias("th"), own_id.alias("next_id"),
                     F.substring(F.col("text"), F.lit(1), F.floor(F.col("to_n") / 4).cast("int")).alias("head"),
                     sig.alias("next_sig")))
    n = F.char_length("text")
    out = rows.join(heads, ["kid", "th"]).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("head")))
    out = out.withColumns({"sig": sig, "edited_sig": signature(F.col("edited"), k, ell, bins)})
    return out.select(own_id.alias("doc_id"), "next_id", "text", "edited", "sig", "edited_sig", "next_sig",
                      likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                      likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
