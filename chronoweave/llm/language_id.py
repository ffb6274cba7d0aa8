"""Language identification by character models with interpolated Kneser-Ney smoothing.

Each language has a model of its own, learnt from labelled texts. All models lie side
by side in sorted arrays of n-gram hashes with a log probability per language, so a
text's characters are looked up once for all of them. The language with the lowest
cross-entropy per character wins; a text whose cross-entropy lies far beyond that of
the language's own documents is marked as rejected.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import column_of, map_arrow, texts_of
from chronoweave.llm.mixing import uniform

UNDETERMINED = "und"
#: Documents a language's model is fitted on, about (a bounded sample of the labelled rows).
SAMPLE_DOCS = 3000
#: Characters scored at a time: longer texts go through in segments, batches in groups.
SEGMENT = 1 << 18
#: Characters up to which a text's evidence counts in full in the score.
EVIDENCE = 200.0
#: A text may lie so many times the way from the median to the 90th percentile beyond the median;
#: few letters lengthen it, as the spread falls with the root of their number.
REJECT_AT = 6.0
SHORT = 64.0
#: Where that is farther, it is this part of the way to the median of foreign text: past a half,
#: so that texts of two languages in equal parts stay.
FOREIGN = 2 / 3
#: Levels are measured on this part of the sample, with models of the rest, in languages of so many documents.
HELD, HELD_FROM = 0.2, 100

#: Odd multipliers of the n-gram hash, from the last character backwards (fixed values).
_HASH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, n_letters long, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """A text's lower-case letters as code points; any run of other characters is one 0.

    The text stands between two zeros; without letters it is empty.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    kept = np.where(letter, points, 0)
    kept = np.concatenate([[0], kept, [0]]).astype(np.uint32)
    return kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]


def _hash(*chars: np.ndarray) -> np.ndarray:
    """Hash of n-grams, the last character first."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(chars[0]), np.uint64)
        for c, m in zip(chars, _HASH, strict=False):
            out += (c.astype(np.uint64) + np.uint64(1)) * m
        return out ^ (out >> np.uint64(29))


class _Table:
    """A sorted hash array with a row of values for each n-gram."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


class LanguageModels:
    """Interpolated Kneser-Ney trigram models of several languages."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: by language, trigrams (rows of three code points, in reading order) and their counts."""
        self.langs = sorted(grams)
        alphabet = len(np.unique(np.concatenate([g for g, _ in grams.values()]))) + 1
        trigrams = np.unique(np.concatenate([g for g, _ in grams.values()]), axis=0)
        bigrams, unigrams = (np.unique(trigrams[:, k:], axis=0) for k in (1, 2))
        contexts = np.unique(trigrams[:, :2], axis=0)
        n = len(self.langs)
        one, two, three = np.empty((len(unigrams), n)), np.empty((len(bigrams), n)), np.empty((len(trigrams), n))
        off2, off3 = np.zeros((len(unigrams), n)), np.zeros((len(contexts), n))
        self.unseen = np.empty(n)
        row = lambda table: {tuple(r): i for i, r in enumerate(table.tolist())}
        at1, at2, at3, at_c = row(unigrams), row(bigrams), row(trigrams), row(contexts)
        for k, lang in enumerate(self.langs):
            g, c = grams[lang]
            c = c.astype(np.float64)
            # continuation counts: how many characters an n-gram was seen after
            g2, c2 = np.unique(g[:, 1:], axis=0, return_counts=True)
            g1, c1 = np.unique(g2[:, 1:], axis=0, return_counts=True)
            d3, d2, d1 = _discount(c), _discount(c2), _discount(c1)
            p1 = np.full(len(unigrams), d1 * len(g1) / c1.sum() / alphabet)
            self.unseen[k] = np.log(p1[0])
            p1[[at1[tuple(x)] for x in g1.tolist()]] += np.maximum(c1 - d1, 0) / c1.sum()
            # weight of the shorter context, 1 where the longer was never seen
            b, inverse = np.unique(g2[:, 0], return_inverse=True)
            total, kinds = np.bincount(inverse, c2), np.bincount(inverse)
            w2 = np.ones(len(unigrams))
            at_b = np.array([at1.get((x,), -1) for x in b.tolist()])
            w2[at_b[at_b >= 0]] = (d2 * kinds / total)[at_b >= 0]
            first2 = np.array([at1.get((x,), -1) for x in bigrams[:, 0].tolist()])
            p2 = np.where(first2 >= 0, w2[first2], 1.0) * p1[[at1[(x,)] for x in bigrams[:, 1].tolist()]]
            p2[[at2[tuple(x)] for x in g2.tolist()]] += np.maximum(c2 - d2, 0) / total[inverse]
            h, inverse = np.unique(g[:, :2], axis=0, return_inverse=True)
            inverse = inverse.reshape(-1)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            w3 = np.ones(len(contexts))
            w3[[at_c[tuple(x)] for x in h.tolist()]] = d3 * kinds / total
            p3 = w3[[at_c[tuple(x)] for x in trigrams[:, :2].tolist()]] * p2[[at2[tuple(x)] for x in trigrams[:, 1:].tolist()]]
            p3[[at3[tuple(x)] for x in g.tolist()]] += np.maximum(c - d3, 0) / total[inverse]
            one[:, k], two[:, k], three[:, k] = np.log(p1), np.log(p2), np.log(p3)
            off2[:, k], off3[:, k] = np.log(w2), np.log(w3)
        split = lambda t: [t[:, i] for i in range(t.shape[1] - 1, -1, -1)]
        self.p1, self.w2 = _Table(_hash(*split(unigrams)), one), _Table(_hash(*split(unigrams)), off2)
        self.p2, self.w3, self.p3 = _Table(_hash(*split(bigrams)), two), _Table(_hash(*split(contexts)), off3), _Table(_hash(*split(trigrams)), three)

    def log_probabilities(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log probability of each c after a, b: a row per place, a column per language."""
        at, found = self.p3.find(_hash(c, b, a))
        out = self.p3.values[at]
        if not found.all():
            a, b, c = a[~found], b[~found], c[~found]
            at2, found2 = self.p2.find(_hash(c, b))
            low = self.p2.values[at2]
            at1, found1 = self.p1.find(_hash(c))
            lower = np.where(found1[:, None], self.p1.values[at1], self.unseen.astype(np.float32))
            at_w, found_w = self.w2.find(_hash(b))
            lower = lower + np.where(found_w[:, None], self.w2.values[at_w], 0)
            low = np.where(found2[:, None], low, lower)
            at_w, found_w = self.w3.find(_hash(b, a))
            out[~found] = low + np.where(found_w[:, None], self.w3.values[at_w], 0)
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of each text under each language, and the characters counted (0: no letter)."""
        total, counted = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        held = 0

        def score() -> None:
            flat = np.concatenate([s for _, s in group])
            ends = np.cumsum([len(s) for _, s in group])
            # each sequence predicts all but its first two symbols
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            inside[ends - 2] = False
            places = np.flatnonzero(inside)
            logs = self.log_probabilities(flat[places], flat[places + 1], flat[places + 2])
            sizes = np.array([len(s) - 2 for _, s in group])
            np.add.at(total, [i for i, _ in group], np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64))
            np.add.at(counted, [i for i, _ in group], sizes)
            group.clear()

        for i, text in enumerate(texts):
            seq = symbols(text)
            for k in range(0, max(len(seq) - 2, 0), SEGMENT):
                part = seq[k : k + SEGMENT + 2]
                group.append((i, part))
                held += len(part)
                if held >= SEGMENT:
                    score()
                    held = 0
        if group:
            score()
        return -total / np.maximum(counted, 1)[:, None], counted


def _count_grams(train: DataFrame) -> DataFrame:
    """lang, held, gram (three code points packed in 63 bits), n."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, parts, grams, counts = [], [], [], []
        texts, of = texts_of(batch), list(zip(column_of(batch, "lang").to_pylist(), column_of(batch, "held").to_pylist(), strict=True))
        for lang, held in sorted(set(of)):
            seqs = [s.astype(np.uint64) for t, x in zip(texts, of, strict=True) if x == (lang, held) and len(s := symbols(t)) > 2]
            if seqs:
                g, n = np.unique(np.concatenate([(s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:] for s in seqs]), return_counts=True)
                langs.append(np.full(len(g), lang, object))
                parts.append(np.full(len(g), held))
                grams.append(g.astype(np.int64))
                counts.append(n)
        if not langs:
            return None
        return pa.record_batch([pa.array(np.concatenate(langs), pa.string()), *(pa.array(np.concatenate(x)) for x in (parts, grams, counts))], ["lang", "held", "gram", "n"])

    return map_arrow(train.select("text", "lang", "held"), count, "lang string, held boolean, gram long, n long").groupBy("lang", "held", "gram").agg(F.sum("n").alias("n"))


def _models(table) -> LanguageModels:
    grams = {}
    for lang, part in table.groupby("lang"):
        part = part.groupby("gram", as_index=False)["n"].sum()
        g = part["gram"].to_numpy(np.uint64)
        grams[lang] = (np.stack([(g >> np.uint64(s)) & np.uint64(0x1FFFFF) for s in (42, 21, 0)], 1).astype(np.int64), part["n"].to_numpy(np.int64))
    return LanguageModels(grams)


def fit_languages(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[LanguageModels | None, dict[str, tuple[float, float, float]]]:
    """Models and rejection levels from labelled: doc_id, text, lang.

    Fitted on about sample_docs documents of each language, drawn by a hash of the id;
    rows with a null language or text are left out. Without any, the models are None.
    A level is the median and the 90th percentile of the cross-entropies of the
    language's own documents, and the median of the nearest other language's documents
    under its model (without any other, half way to its own read backwards). Up to a
    tenth of odd documents in a language, however odd, does not widen it. Levels are
    measured with models of one part of the sample on the other; languages of few
    documents serve as both.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    held = (F.col("n") >= HELD_FROM) & F.coalesce(uniform(F.col("doc_id"), "lang-2") < HELD, F.lit(False))
    drawn = rows.join(F.broadcast(sizes), "lang").where(uniform(F.col("doc_id"), "lang-1") * F.col("n") < sample_docs).select("text", "lang", held.alias("held"), (held | (F.col("n") < HELD_FROM)).alias("measured"))  # a row per language
    table = _count_grams(drawn).toPandas()
    if table.empty:
        return None, {}
    models = _models(table)
    learnt = table[~table["held"]]
    # a language whose texts with letters are all among the held ones: every text serves as both
    part = _models(learnt) if set(learnt["lang"]) == set(models.langs) else models
    sent = labelled.sparkSession.sparkContext.broadcast(part)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        under = sent.value.langs
        texts, of = texts_of(batch), column_of(batch, "lang").to_pylist()
        ce, n = sent.value.cross_entropies(texts)
        other = under
        if len(under) == 1:
            ce, other = np.concatenate([ce, sent.value.cross_entropies([t[::-1] for t in texts])[0]], axis=1), [under[0], under[0]]
        ce = np.where(n[:, None] > 0, ce, np.nan)
        own = [x == y and k < len(under) for x in of for k, y in enumerate(other)]
        return pa.record_batch([pa.array(np.repeat(np.array(of, object), len(other)), pa.string()), pa.array(list(other) * len(of), pa.string()), pa.array(own, pa.bool_()), pa.array(ce.reshape(-1))], ["lang", "under", "own", "ce"])

    measured = map_arrow(drawn.where("measured").select("text", "lang"), measure, "lang string, under string, own boolean, ce double").where("not isnan(ce)")
    found = measured.groupBy("under", "own", "lang").agg(F.percentile("ce", F.array(F.lit(0.5), F.lit(0.9))).alias("q")).collect()
    own = {r["under"]: r["q"] for r in found if r["own"]}
    foreign = {x: min((r["q"][0] for r in found if r["under"] == x and not r["own"]), default=np.nan) for x in own}
    if len(models.langs) == 1:
        foreign = {x: (own[x][0] + y) / 2 for x, y in foreign.items()}
    return models, {x: (*q, foreign[x]) for x, q in own.items()}


class Judge:
    """Fitted models with their rejection levels, applied to lists of whole texts."""

    def __init__(self, models: LanguageModels | None, levels: dict[str, tuple[float, float, float]], reject_at: float):
        self.models = models
        langs = models.langs if models else []
        self.middle = np.array([levels.get(x, (np.inf,))[0] for x in langs])
        self.way = np.array([reject_at * max(q[1] - q[0], 0.05) if (q := levels.get(x)) else 0.0 for x in langs])
        self.least = np.array([FOREIGN * max(np.nan_to_num(q[2] - q[0]), 0.0) if (q := levels.get(x)) else 0.0 for x in langs])

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy, letters and rejection of each text."""
        if self.models is None:
            zeros = np.zeros(len(texts))
            return [UNDETERMINED] * len(texts), zeros, np.full(len(texts), np.nan), zeros.astype(np.int64), np.ones(len(texts), bool)
        ce, n = self.models.cross_entropies(texts)
        best = np.argmin(ce, axis=1)
        ce_best = ce[np.arange(len(texts)), best]
        weight = np.exp(-(ce - ce_best[:, None]) * np.minimum(n, EVIDENCE)[:, None])
        rejected = (n == 0) | (ce_best > self.middle[best] + np.maximum(self.least, self.way)[best] + self.way[best] * np.sqrt(SHORT / np.maximum(n, 1)))
        name = [self.models.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist(), strict=True)]
        return name, np.where(n > 0, 1 / weight.sum(axis=1), 0.0), np.where(n > 0, ce_best, np.nan), n, rejected


def identify_language(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, reject_at: float = REJECT_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text.

    labelled: doc_id, text, lang to learn from; docs' own language is not read.
    lang_pred is a learnt language, or `und` for null texts, texts without a letter and
    where nothing could be learnt. score is the winner's share of the languages'
    evidence. rejected marks `und` and texts unlike the winner's documents. A language
    of a single document works like any other; ties go to the first by name. Repeated
    rows are judged alike, null ids stay null, an empty table gives an empty one; other
    columns, of any name, are not read. docs pass row by row, without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Judge(*fit_languages(labelled, sample_docs), reject_at))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        name, *numbers = sent.value(texts_of(batch))
        return pa.record_batch([column_of(batch, "doc_id"), pa.array(name, pa.string()), *map(pa.array, numbers)], ["doc_id", "lang_pred", "score", "cross_entropy", "n_letters", "rejected"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), judge, SCHEMA)


def drop_rejected(docs: DataFrame, labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, reject_at: float = REJECT_AT, text_col: str = "text") -> DataFrame:
    """Rows of docs that identify_language does not reject, all columns as they are; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(Judge(*fit_languages(labelled, sample_docs), reject_at))
    return map_arrow(docs, lambda batch: batch.filter(pa.array(~sent.value(texts_of(batch, text_col))[-1])), docs.schema)
