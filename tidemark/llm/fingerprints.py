"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions.

Terms are lower-cased runs of letters and digits. The lexicon is hashed: a term
belongs to one of ``SLOTS`` slots, and a slot's document frequency counts the
documents that hold any of its terms. Slots whose inverse document frequency lies in
the band form the lexicon; as a bitmap it has a fixed size, whatever the vocabulary.

A text keeps its distinct terms of the lexicon, sorted. A hash of each term deals the
lexicon into randomised subsets; the terms that a text has in each of ``SUBSETS``
subsets are hashed to ``DIGITS`` hexadecimal digits. The subsets hold a share of the
lexicon that halves with each scale. A text uses the scale at which a subset has one
or two of its terms and the next one, so that texts of any length react to edits alike
and texts of like length share a scale.

A fingerprint reads ``scale:hashes:hashes of the next scale``; a subset without terms
is all ``-``. Likeness is the share of equal hashes among the subsets that are filled
in either text, over the scales both have; it is 1 for equal fingerprints.

Copies can hold so many rows, and a table so few, that a text has no lexicon terms.
Texts with fewer than ``all_terms_below`` of them are printed over all their distinct
terms and marked by a fourth part, a hash of all these terms (of the text, if it has no
term). It is one more hash to compare, so that only texts of equal terms have likeness
1. Where just one of two texts is marked, both are compared over all their terms.

Defined results: null counts as the empty text; where ``all_terms_below`` is 0, its
default, texts without lexicon terms share one fingerprint; rows with an equal id follow a hash of their text, and rows equal in both
count as one document in the order of documents and are repeated in the result; a null
id is the first; the next document of the last, also of the only one, is the first.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_of

TERM = r"[\p{L}\p{N}]+"
SLOT_BITS = 20
SUBSETS = 32
DIGITS = 4
MIN_IDF = log(1 / 0.05)
MAX_IDF = log(1 / 0.0005)
NO_ID = -(1 << 63)
FEW_TERMS = 8  # the query's all_terms_below


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def _slot(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def lexicon_bitmap(texts: DataFrame, min_idf: float = MIN_IDF, max_idf: float = MAX_IDF) -> list[int]:
    """Words of 64 slots, the bits of slots whose IDF lies in the band set.

    Document frequencies are counted over all rows of (text); the result has
    2**SLOT_BITS bits, so at most 16,384 words reach the driver.
    """
    slots = F.array_distinct(F.transform(term_hashes(F.col("text")), _slot))
    held = texts.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))
    total = max(1, texts.count())
    idf = F.log(F.lit(float(total)) / F.col("df"))
    inside = held.where((idf >= min_idf) & (idf <= max_idf))
    words = inside.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")
    )
    bitmap = [0] * (1 << (SLOT_BITS - 6))
    for row in words.collect():
        bitmap[row["word"]] = row["bits"]
    return bitmap


def lexicon_terms(hashes: Column, bitmap: list[int]) -> Column:
    """Those of an array of term hashes that the lexicon has, in their order."""
    # One literal that folds to an array; its size is fixed by SLOT_BITS.
    words = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def inside(term: Column) -> Column:
        slot = _slot(term)
        word = F.get(words, F.shiftright(slot, 6).cast("int"))
        return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.filter(hashes, inside)


def fingerprint(terms: str) -> Column:
    """Fingerprint of a column of sorted terms."""
    scale = f"CAST(floor(log2(greatest(size({terms}) / {SUBSETS}, 1))) AS INT)"

    def hashes(step: int) -> str:
        period = f"shiftleft({SUBSETS}L, {scale} + {step})"
        place = f"pmod(shiftright(t, {SLOT_BITS}), {period})"
        dealt = f"filter({terms}, t -> {place} < {SUBSETS})"
        digest = f"lpad(right(lower(hex(xxhash64(own))), {DIGITS}), {DIGITS}, '0')"
        subset = f"filter(dealt, t -> {place} = j)"
        # A transform over one element names a value inside an expression.
        named = (
            f"transform(array({subset}), own -> IF(size(own) = 0, '{'-' * DIGITS}', {digest}))[0]"
        )
        return (
            f"transform(array({dealt}), dealt ->"
            f" array_join(transform(sequence(0, {SUBSETS - 1}), j -> {named}), ''))[0]"
        )

    return F.expr(f"concat_ws(':', CAST({scale} AS STRING), {hashes(0)}, {hashes(1)})")


def marked_fingerprint(terms: str, text: str) -> Column:
    """Fingerprint of a column of all sorted terms of a text, with the part that marks it."""
    whole = f"lower(hex(IF(size({terms}) = 0, xxhash64({text}), xxhash64({terms}))))"
    return F.concat_ws(":", fingerprint(terms), F.expr(f"lpad({whole}, 16, '0')"))


def is_marked(fingerprint: str) -> Column:
    return F.expr(f"split_part({fingerprint}, ':', 4) <> ''")


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes of two fingerprint columns, 0 to 1; null if either is null."""
    empty = "-" * DIGITS

    def scale(f: str) -> str:
        return f"CAST(split_part({f}, ':', 1) AS INT)"

    def part(f: str, k: int) -> str:
        return f"split_part({f}, ':', {k})"

    both = f"{scale(a)} = {scale(b)}"
    x = f"CASE WHEN {both} THEN concat({part(a, 2)}, {part(a, 3)}) WHEN {scale(a)} + 1 = {scale(b)} THEN {part(a, 3)} WHEN {scale(a)} = {scale(b)} + 1 THEN {part(a, 2)} ELSE '' END"
    y = f"CASE WHEN {both} THEN concat({part(b, 2)}, {part(b, 3)}) WHEN {scale(a)} + 1 = {scale(b)} THEN {part(b, 2)} WHEN {scale(a)} = {scale(b)} + 1 THEN {part(b, 3)} ELSE '' END"
    share = (
        f"transform(array(named_struct('x', {x}, 'y', {y})), p ->"
        f" aggregate(sequence(0, {2 * SUBSETS - 1}),"
        # Fingerprints that are not equal differ in the hash of the mark.
        f" named_struct('same', 0, 'filled', IF({part(a, 4)} = '', 0, 1)),"
        f" (s, k) -> transform(array(named_struct("
        f"'u', substring(p.x, k * {DIGITS} + 1, {DIGITS}), 'v', substring(p.y, k * {DIGITS} + 1, {DIGITS}))),"
        f" g -> named_struct('same', s.same + IF(g.u = g.v AND g.u NOT IN ('{empty}', ''), 1, 0),"
        f" 'filled', s.filled + IF(g.u NOT IN ('{empty}', '') OR g.v NOT IN ('{empty}', ''), 1, 0)))[0],"
        f" s -> IF(s.filled = 0, 0D, CAST(s.same AS DOUBLE) / s.filled)))[0]"
    )
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D ELSE {share} END")


def next_documents(keys: DataFrame, folder: str) -> DataFrame:
    """Each distinct (k, h) with the next one in order (next_k, next_h); the last has the first.

    Range partitions make ordered cells; within a cell the next row is a window's lead,
    the last row of a cell takes the first of the next cell. One row per cell is broadcast.
    """
    cells = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keys.repartitionByRange(cells, "k", "h").withColumn("_cell", F.spark_partition_id())
    placed = stored(placed, folder, "cells")
    own = F.struct("k", "h")
    following = F.lead(own).over(Window.partitionBy("_cell").orderBy("k", "h"))
    firsts = placed.groupBy("_cell").agg(F.min(own).alias("_first"))
    everything = Window.partitionBy()
    heads = firsts.select(
        "_cell",
        F.coalesce(
            F.lead("_first").over(everything.orderBy("_cell")), F.min("_first").over(everything)
        ).alias("_after"),
    )
    return (
        placed.withColumn("_next", following)
        .join(F.broadcast(heads), "_cell")
        .withColumn("_next", F.coalesce("_next", "_after"))
        .select("k", "h", "n", F.col("_next.k").alias("next_k"), F.col("_next.h").alias("next_h"))
    )


def _likeness_of_kind(shown: DataFrame, name: str, b: str, whole_b: str) -> DataFrame:
    """Adds the likeness of ``fingerprint`` and ``b``, over all terms where one alone is marked."""
    mixed = is_marked("fingerprint") != is_marked(b)
    sides = shown.withColumns(
        {
            "_a": F.when(mixed, F.col("_whole")).otherwise(F.col("fingerprint")),
            "_b": F.when(mixed, F.col(whole_b)).otherwise(F.col(b)),
        }
    )
    return sides.withColumn(name, likeness("_a", "_b"))


def edited_fingerprints(docs: DataFrame, folder: str, all_terms_below: int = 0) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likenesses between them.

    The edited text has its last quarter replaced by the start of the next document.
    The texts are shuffled once, by id; only the starts that the edits need move again.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
        F.xxhash64(text_of("text")).alias("h"),
        text_of("text").alias("text"),
    )
    bitmap = lexicon_bitmap(rows.select("text"))
    keys = rows.groupBy("k", "h").agg(F.max(F.length("text")).alias("n"))
    order = stored(next_documents(keys, folder), folder, "order")
    needs = order.select(
        F.col("next_k").alias("k"),
        F.col("next_h").alias("h"),
        F.col("k").alias("_to_k"),
        F.col("h").alias("_to_h"),
        F.expr("CAST(n div 4 AS INT)").alias("_cut"),
    )
    starts = (
        rows.join(needs, ["k", "h"])
        .select(F.col("_to_k").alias("k"), F.col("_to_h").alias("h"), F.expr("left(text, _cut)").alias("_start"))
        .groupBy("k", "h")
        .agg(F.max("_start").alias("_start"))
    )
    length = F.length("text")
    # The same columns by the same keys as above: the shuffle of the texts is reused.
    both = rows.join(starts, ["k", "h"]).select(
        "k",
        "h",
        length.cast("long").alias("n_chars"),
        "text",
        F.concat(F.expr("left(text, length(text) - CAST(length(text) div 4 AS INT))"), "_start").alias("_edited"),
    )
    hashed = both.select(
        "k",
        "h",
        "n_chars",
        "text",
        "_edited",
        F.sort_array(term_hashes(F.col("text"))).alias("_all"),
        F.sort_array(term_hashes(F.col("_edited"))).alias("_edited_all"),
    )
    terms = hashed.select(
        "*",
        F.sha2("_edited", 256).alias("edited_sha256"),
        lexicon_terms(F.col("_all"), bitmap).alias("_terms"),
        lexicon_terms(F.col("_edited_all"), bitmap).alias("_edited_terms"),
    )
    few, edited_few = (F.size(c) < all_terms_below for c in ("_terms", "_edited_terms"))
    whole = marked_fingerprint("_all", "text")
    edited_whole = marked_fingerprint("_edited_all", "_edited")
    printed = stored(
        terms.select(
            "k",
            "h",
            "n_chars",
            "edited_sha256",
            F.when(few, whole).otherwise(fingerprint("_terms")).alias("fingerprint"),
            F.when(edited_few, edited_whole)
            .otherwise(fingerprint("_edited_terms"))
            .alias("edited_fingerprint"),
            # The next document before this one may be marked, so every row has it.
            (whole if all_terms_below else F.lit(None).cast("string")).alias("_whole"),
            F.when(few != edited_few, edited_whole).alias("_edited_whole"),
        ),
        folder,
        "fingerprints",
    )
    following = (
        order.select("k", "h", "next_k", "next_h")
        .join(
            printed.groupBy(F.col("k").alias("next_k"), F.col("h").alias("next_h")).agg(
                F.max("fingerprint").alias("_next"), F.max("_whole").alias("_next_whole")
            ),
            ["next_k", "next_h"],
        )
        .select("k", "h", "_next", "_next_whole")
    )
    shown = _likeness_of_kind(
        printed.join(following, ["k", "h"]), "near_edited", "edited_fingerprint", "_edited_whole"
    )
    shown = _likeness_of_kind(shown, "near_next", "_next", "_next_whole")
    return shown.select(
        F.expr(f"nullif(k, {NO_ID + 1}L - 1L)").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )
