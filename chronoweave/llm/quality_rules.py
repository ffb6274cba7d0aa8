"""Quality rules whose thresholds come from quantile sketches of each language and source.

A document's measures (word length, symbols, repeated lines and passages) are taken in
one pass over the texts. A sketch counts values in buckets of a fixed relative width;
sketches merge by adding counts, so partial counts meet instead of rows, and those of a
source add up to those of its language. Quartiles read from a sketch give a group's
fences, and the measures joined with their group's fences give the verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch, column_of, map_arrow, recoded, with_groups

#: Words of a window that counts as repeated.
WINDOW = 8
#: A bucket is 1 / 2 ** SUB_BITS of its value wide at most.
SUB_BITS = 6
#: Groups of fewer documents take the fences of their language, and those of all documents where that is small too.
LEAST_ROWS = 200
#: Fences lie so many spreads beyond the quartiles.
FACTOR = 5
#: Fixed cutoffs of the base rules: fewer words, or more percent of the words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Rule: measure, what it is a share of (in thousandths), the least spread, and whether low values fail too.
RULES = {
    "word_length": ("word_chars", "n_words", 250, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeats": ("n_repeat_words", "n_words", 100, False),
}

#: White space as blanks, with and without line ends.
_SPACED = bytes.maketrans(bytes(range(9, 14)), b" " * 5)
_SPACED_LINES = bytes.maketrans(b"\x09\x0b\x0c\x0d", b" " * 4)

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which words stand in a window that is found twice or more in their own document.

    ids: a number for each different word; doc: the document of each, in order. Windows
    of equal hash are compared word by word.
    """
    marked = np.zeros(len(ids), bool)
    at = np.arange(max(len(ids) - width + 1, 0))
    at = at[doc[at] == doc[at + width - 1]] if len(at) else at
    if not len(at):
        return marked
    words, hashed = _mixed(ids), _mixed(doc[at] + (1 << 40))
    with np.errstate(over="ignore"):
        for j in range(width):
            hashed = hashed * np.uint64(0x100000001B3) + words[at + j]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    found = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    starts = np.concatenate([[True], hashed[found][1:] != hashed[found][:-1]])[: len(found)]
    found = at[found]
    first = found[starts][np.cumsum(starts) - 1]
    equal = doc[found] == doc[first]
    for j in range(width):
        equal &= ids[found + j] == ids[first + j]
    if not equal.all():  # different windows share a hash
        rows = np.stack([doc[found], *(ids[found + j] for j in range(width))], axis=1)
        _, own, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        found = found[count[own.reshape(-1)] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + width, -1)
    return np.cumsum(cover)[:-1] > 0


def _distinct(doc: np.ndarray, what: pa.Array, n: int) -> np.ndarray:
    """Number of different values of each document."""
    ids = what.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.bincount(np.unique(doc.astype(np.int64) << 32 | ids) >> 32, minlength=n)


def measures_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """Measures of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word)."""
    texts = pc.fill_null(texts, "")
    n = len(texts)

    def flat(lists: pa.Array, there: pa.Array) -> tuple[pa.Array, np.ndarray]:
        doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return lists.flatten().filter(there), doc[there.to_numpy(zero_copy_only=False)]

    split = pc.split_pattern(recoded(texts, _SPACED), " ")
    words, doc = flat(split, pc.greater(pc.binary_length(split.flatten()), 0))
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    bare = pc.split_pattern(recoded(texts, _SPACED_LINES), "\n").flatten()
    lines, line_doc = flat(pc.split_pattern(texts, "\n"), pc.greater(pc.binary_length(pc.ascii_trim(bare, " ")), 0))
    held = np.bincount(line_doc, minlength=n)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": np.bincount(doc, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": held - _distinct(line_doc, lines, n),
        "n_repeat_words": np.bincount(doc[repeated_words(ids, doc)], minlength=n),
        "n_lines": held,
    }


def group_key(value: Column) -> Column:
    """A key that is never null; null is a group of its own."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value.cast("string")))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang_key, source_key and the measures of each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), group_key(F.col(lang_col)).alias("lang_key"), group_key(F.col(source_col)).alias("source_key"), F.col(text_col).alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measures_of(column_of(batch, "text"))
        names = ["doc_id", "lang_key", "source_key"]
        return pa.record_batch([*(column_of(batch, c) for c in names), *(pa.array(found[m].astype(np.int64)) for m in _MEASURES)], [*names, *_MEASURES])

    return map_arrow(rows, one, "doc_id long, lang_key string, source_key string, " + ", ".join(f"{m} long" for m in _MEASURES))


def share(rule: str) -> Column:
    """A rule's value in thousandths, rounded down; 0 where there is nothing to share."""
    over, under, _, _ = RULES[rule]
    return F.when(F.col(under) > 0, F.floor(F.col(over) * 1000 / F.col(under))).otherwise(F.lit(0)).cast("long")


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value from 0 on: one for each value up to 2 ** (SUB_BITS + 1), then of a fixed relative width."""
    shift = F.length(F.bin(value)) - 1 - SUB_BITS
    wide = ((shift + 1) * (1 << SUB_BITS)).cast("long") + F.call_function("shiftright", value, shift) - (1 << SUB_BITS)
    return F.when(value < (1 << SUB_BITS), value).otherwise(wide)


def least_of(at: Column) -> Column:
    """The smallest value of a bucket."""
    wide = F.call_function("shiftleft", F.pmod(at, F.lit(1 << SUB_BITS)) + (1 << SUB_BITS), (F.shiftright(at, SUB_BITS) - 1).cast("int"))
    return F.when(at < (2 << SUB_BITS), at).otherwise(wide)


def sketches(rows: DataFrame, *keys: str) -> DataFrame:
    """Sketches of each rule's values in each group: keys, rule, bucket, held."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(share(r)).alias("bucket")) for r in RULES]))
    return rows.where("n_words > 0").select(*keys, values.alias("x")).groupBy(*keys, "x.rule", "x.bucket").agg(F.count("*").alias("held"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketches of larger groups from those of their parts: counts of a bucket add up."""
    return parts.groupBy(*keys, "rule", "bucket").agg(F.sum("held").alias("held"))


def quartiles(sketch: DataFrame, *keys: str, mark: str = "") -> DataFrame:
    """keys, rule, and (names ending in mark) n, low and high: the first and the third quartile."""
    group = W.partitionBy(*keys, "rule")
    ranked = sketch.withColumn("upto", F.sum("held").over(group.orderBy("bucket"))).withColumn("n", F.sum("held").over(group))
    at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("bucket")))
    found = ranked.groupBy(*keys, "rule").agg(F.max("n").alias(f"n{mark}"), at(1).alias("low"), at(3).alias("high"))
    return found.select(*keys, "rule", f"n{mark}", least_of(F.col("low")).alias(f"low{mark}"), least_of(F.col("high")).alias(f"high{mark}"))


def fences(own: DataFrame, factor: int = FACTOR, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang_key, source_key, held (documents), and for each rule the least and the most a document may have: <rule>_least, <rule>_most.

    own: sketches by lang_key and source_key. A group's spread is the distance of its
    quartiles, or the rule's least spread if larger: a source of copies does not narrow
    the fences of its other documents to nothing.
    """
    by_lang = merged(own, "lang_key")
    found = quartiles(own, "lang_key", "source_key").join(quartiles(by_lang, "lang_key", mark="_lang"), ["lang_key", "rule"])
    found = found.join(F.broadcast(quartiles(merged(by_lang), mark="_all")), "rule")  # a row for each rule
    pick = lambda c: F.when(F.col("n") >= least_rows, F.col(c)).when(F.col("n_lang") >= least_rows, F.col(f"{c}_lang")).otherwise(F.col(f"{c}_all"))
    floor = F.create_map(*[x for r, (_, _, least, _) in RULES.items() for x in (F.lit(r), F.lit(least))])[F.col("rule")]
    found = found.select("lang_key", "source_key", "rule", "n", pick("low").alias("low"), pick("high").alias("high"), floor.alias("floor"))
    reach = F.greatest(F.col("high") - F.col("low"), "floor") * factor
    found = found.withColumns({"least": F.col("low") - reach, "most": F.col("high") + reach})
    each = [F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{r}_{c}") for r in RULES for c in ("least", "most")]
    return found.groupBy("lang_key", "source_key").agg(F.max("n").alias("held"), *each)


def quality_rules(docs: DataFrame, factor: int = FACTOR, least_rows: int = LEAST_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base measures and verdict of each row of docs.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (the fixed rules), kept (no rule failed), failed (names of the rules
    that did, sorted, comma-joined; `base` for the fixed ones).

    The sketches cover all documents that have a word. A null language or source is a
    group of its own; a null text is an empty one and fails the base rules. Repeated
    rows and ids are rows of their own. An empty table gives an empty table. Other
    columns, of any name, are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = scratch.write(measured(docs, id_col, text_col, lang_col, source_col), "measures")
    own = scratch.write(sketches(rows, "lang_key", "source_key"), "sketches")
    limits = scratch.write(fences(own, factor, least_rows), "fences")
    found = with_groups(rows, limits, ["lang_key", "source_key"], "held")
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    off = {r: (share(r) > F.col(f"{r}_most")) | (F.lit(two) & (share(r) < F.col(f"{r}_least"))) for r, (_, _, _, two) in RULES.items()}
    names = F.concat_ws(",", F.array_sort(F.array_compact(F.array(F.when(base, F.lit("base")), *[F.when(x, F.lit(r)) for r, x in off.items()]))))
    found = found.select("doc_id", *_MEASURES[:-1], base.alias("base_failed"), names.alias("failed"))
    return found.select("doc_id", *_MEASURES[:-1], "base_failed", (F.col("failed") == "").alias("kept"), "failed")

