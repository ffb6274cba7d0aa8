"""Quality rules, ranked search and vector codes against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

LONG = "ab cd é " * 40_000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id at all"), (None, None), (5, LONG), (6, "ünï 中文 😀 a\x00b # $ \x1c x"), (7, "All rights\nAll rights\n\nAll\trights\nAll rights"), (8, "w1 w2 w3 w4 w5 w6 w7 w8 " * 3)]
CLASHING = "doc_id long, text string, lang string, source string, n_words string, score int, block string, held string, rank int, bucket string, rule string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, None if k % 2 else "en", None, "x", 9, "b", "h", 1, "z", "r") for k, (i, t) in enumerate(EDGE)], CLASHING)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_measures():
    from chronoweave.llm import quality_rules as q

    rnd = random.Random(1)
    pieces = ["a", "b", "c ", "d\n", " ", "\t", "#", "é", "\x1d", "\x0b", "x y z w v u t s "]
    texts = [t for _, t in EDGE] + ["".join(rnd.choice(pieces) for _ in range(rnd.choice([5, 50, 900]))) for _ in range(200)]
    found = q.measures_of(pa.array(["before", *texts]).slice(1))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(found[m][k]) for m in names) for k in range(len(texts))] == [measures(t) for t in texts]


def test_repeated_words_of_equal_hash(monkeypatch):
    from chronoweave.llm import quality_rules as q

    monkeypatch.setattr(q, "_mixed", lambda x: np.zeros(len(x), np.uint64))
    ids, doc = np.array([1, 2, 3, 1, 2, 4, 1, 2]), np.array([0, 0, 0, 0, 0, 0, 1, 1])
    assert q.repeated_words(ids, doc, 2).tolist() == [True, True, False, True, True, False, False, False]


def test_sketch_buckets(spark):
    from pyspark.sql import functions as F

    from chronoweave.llm.quality_rules import bucket, least_of

    values = [*range(300), 1000, 4095, 4096, 123_456, 10**9, 10**15]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket(F.col("v")).alias("b")).withColumn("low", least_of(F.col("b"))).collect()
    for r in rows:
        assert r.low <= r.v < r.low + max(1, r.low / 64 + 1e-9) and (r.v >= 128 or r.b == r.v)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_sketches_merge(spark, sf_dir):
    """Sketches of parts of the rows, merged, are the sketch of all rows."""
    from chronoweave.llm.quality_rules import measured, merged, quartiles, sketches

    rows = measured(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    whole = sketches(rows, "lang_key")
    parts = sketches(rows.where("doc_id % 3 = 0"), "lang_key").unionByName(sketches(rows.where("doc_id % 3 > 0"), "lang_key"))
    assert sorted(map(tuple, merged(parts, "lang_key").collect())) == sorted(map(tuple, whole.collect()))
    for r in quartiles(whole, "lang_key").collect():
        over, under = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}[r.rule]
        values = sorted(1000 * x[over] // x[under] for x in rows.where("n_words > 0").collect() if x.lang_key == r.lang_key)
        for q, got in ((1, r.low), (3, r.high)):
            exact = values[(q * len(values) + 3) // 4 - 1]
            assert got <= exact <= got + got / 64 + 1


def test_quality_rules(spark, edge, none):
    from chronoweave.llm.quality_rules import quality_rules

    out = quality_rules(edge).collect()
    assert sorted(((r.doc_id, *r[1:6]) for r in out), key=str) == sorted(((i, *measures(t)) for i, t in EDGE), key=str)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (r.failed == "") for r in out)
    assert quality_rules(none).count() == 0
    # junk in one of two sources; the other's symbols are its habit
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    text = lambda tail: " ".join(word(rnd.randint(2, 9)) + tail for _ in range(60))
    rows = [(k, text(""), "en", "prose") for k in range(300)] + [(300 + k, text("#"), "en", "code") for k in range(300)] + [(600 + k, text("$$"), None, "prose") for k in range(20)] + [(700 + k, text("%%"), "en", "prose") for k in range(20)]
    kept = {r.doc_id: r.failed for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(kept[k] for k in range(600)) and all("symbols" in kept[k] for k in range(700, 720))


def test_groups_beyond_a_broadcast(spark):
    """Many groups: the large ones are broadcast, the others shuffled; no row is lost."""
    from chronoweave.llm.common import with_groups

    rows = spark.createDataFrame([(f"g{k % 7 if k % 2 else 0}", k) for k in range(200)] + [("alone", 999)], "g string, k long")
    groups = rows.where("g <> 'alone'").groupBy("g").count().selectExpr("g", "count held", "concat('of ', g) what")
    few, many = (sorted(map(tuple, with_groups(rows, groups, ["g"], "held", most).collect()), key=str) for most in (100, 3))
    assert few == many and len(many) == 201 and ("alone", 999, None, None) in many


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    """item, rank, id, score by the formula."""
    own = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(total, 1)
            s = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_bit_sliced_sums():
    from chronoweave.llm.lexical_search import Slices, _places, added, best_of

    rng = np.random.default_rng(1)
    for trial in range(30):
        n, block, parts = int(rng.integers(1, 300)), None, []
        block, total = Slices(n), np.zeros(n, np.int64)
        for t in range(int(rng.integers(1, 12))):
            at = np.sort(rng.choice(n, int(rng.integers(1, n + 1)), replace=False)).astype("<u4")
            x = rng.integers(0, 1 << int(rng.integers(1, 36)), len(at)) if trial % 2 else rng.integers(0, 3, len(at))
            total[at] += x
            parts.append(block.spread(str(t), at.tobytes(), [np.packbits((x >> b & 1).astype(np.uint8)).tobytes() for b in range(int(x.max()).bit_length())]))
        sums = added(parts, sum((1 << len(p)) - 1 for p in parts))
        assert sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:n].astype(np.int64) << b for b, s in enumerate(sums)).tolist() == total.tolist()
        for k in (1, 5, 50):
            sure, even = (set(_places(x).tolist()) for x in best_of(sums, k))
            least = np.sort(total)[::-1][k - 1] if n >= k else 0
            if (total > 0).sum() <= k:
                assert sure == set(np.flatnonzero(total).tolist()) and not even
            elif even:
                assert sure == set(np.flatnonzero(total > least).tolist()) and even == set(np.flatnonzero(total == least).tolist())
            else:
                assert len(sure) == k and sure == set(np.flatnonzero(total >= least).tolist())


def test_ranked_search(spark, sf_dir, edge, none, monkeypatch):
    from chronoweave.llm import lexical_search
    from chronoweave.llm.lexical_search import ranked_search

    got = lambda *x, **o: sorted(map(tuple, ranked_search(*x, **o).collect()), key=str)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain, asked = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    want = ranked(plain, asked, 50)
    assert got(docs, items) == want
    # small blocks, several passes, copies at the border of the ranking
    copies = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000))
    with monkeypatch.context() as m:
        m.setattr(lexical_search, "QUERY_BYTES", 400)
        m.setattr(lexical_search, "BLOCK", 50)
        assert got(copies.repartition(3), items, k=7) == ranked(plain + [x for x in plain if x[0] < 40] + [(i + 10_000, t) for i, t in plain], asked, 7)
    questions = [(1, "ONE ab"), (2, None), (None, "rights no 中文"), (3, "unheard of"), (1, "b😀 x"), (4, "")]
    wanted = spark.createDataFrame(questions, "item_id long, text string")
    assert got(edge, wanted) == ranked(EDGE, questions, 50)
    assert got(none, wanted) == got(edge, wanted.limit(0)) == []


def codes(vectors, parts=4, entries=256, rounds=4):
    """vec_id, code, error and the codebooks by a plain Lloyd iteration; vectors: (id, label, list)."""
    rows = sorted(((i, [math.floor(1024 * x) for x in v]) for i, _, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v in rows]).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
        own = far.argmin(axis=2)
        if step < rounds:
            for p in range(parts):
                for e in set(own[:, p].tolist()):
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    error = far.min(axis=2).sum(axis=1)
    return [(i, "".join(f"{c:02x}" for c in o), int(e)) for (i, _), o, e in zip(rows, own.tolist(), error, strict=True)], hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def check_codes(spark, rows, **options):
    from chronoweave.llm.vector_codes import vector_codes

    out = vector_codes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3), **options).collect()
    want, sha = codes([(i, la, [float(np.float32(x)) if x is not None else None for x in v] if v else v) for i, la, v in rows], **options)
    assert sorted(((r.vec_id, r.code, r.error) for r in out), key=str) == sorted(want, key=str) and {r.codebooks_sha256 for r in out} == {sha}
    return out


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(20, 16))
    rows = [(int(k), int(rng.integers(0, 3)) if k % 5 else None, (spots[k % 20] + 0.2 * rng.normal(size=16)).tolist()) for k in rng.permutation(700)]
    # copies, ties, a repeated id, a null id, unusable rows
    rows += [(1000 + k, 1, [0.0] * 16) for k in range(40)] + [(1000, 1, [0.5] * 16), (None, None, [0.25] * 16)]
    rows += [(2000, 1, None), (2001, 1, [None] * 16), (2002, 1, [float("nan")] * 16), (2003, 1, [float("inf")] * 16)]
    out = check_codes(spark, rows, entries=32)
    label = {r[0]: r[1] for r in rows}
    total = collections.Counter()
    for r in out:
        total[label[r.vec_id]] += r.error
    assert all(r.label_error == total[label[r.vec_id]] for r in out if r.vec_id != 1000)
    check_codes(spark, rows[:5])  # fewer vectors than entries
    check_codes(spark, rows[:1])


def test_vector_codes_edges(spark):
    from chronoweave.llm.vector_codes import LARGEST, vector_codes

    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_codes(none).count() == 0
    rows = [(1, 1, [1e30] * 8, 1), (2, 1, [-1e30] * 8, 2), (3, None, [0.5] * 3, 3), (4, 1, [], 4), (5, 2, [0.0] * 8, 5)]
    out = {r.vec_id: r for r in vector_codes(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, code int"), entries=2).collect()}
    assert set(out) == {1, 2, 3, 5} and out[3].code is None and out[3].label_error is None
    assert out[1].code == "00000000" and out[2].code == "01010101" and out[1].error == 8 * (LARGEST // 2) ** 2 == out[5].error
    with pytest.raises(ValueError):
        vector_codes(none, entries=257)


def test_heaps_pop_only_what_has_drifted():
    """Over rounds with small moves most parts stay where they are, unscanned, and all are right."""
    from chronoweave.llm.vector_codes import Heaps, Codebooks, scanned, squared

    rng = np.random.default_rng(5)
    spots = rng.integers(-4000, 4000, (32, 16))
    x = spots[rng.integers(0, 32, 6000)] + rng.integers(-300, 300, (6000, 16))
    books = Codebooks(x[None, :32].copy())
    own, slack = scanned(x, books.entries[0])
    heap, popped = Heaps.built(own, slack, 32), []
    for _ in range(6):
        before = own.copy()
        sums = np.zeros((32, 17), np.int64)
        np.add.at(sums, own, np.hstack([x, np.ones((len(x), 1), np.int64)]))
        books.sums[:] = 0
        books.moved([type("Row", (), {"part": 0, "entry": e, "sums": s.tolist()}) for e, s in enumerate(sums)])
        popped.append(len(heap.rescanned(x, own, books.entries[0], books.drift[0])))
        assert (own == squared(x, books.entries[0]).argmin(axis=1)).all()
        assert sorted(heap.members.tolist()) == list(range(6000)) and heap.sizes.tolist() == np.bincount(own, minlength=32).tolist()
        cuts = np.concatenate([[0], np.cumsum(heap.sizes)])
        assert all(k[i] <= k[j] for a, b in zip(cuts, cuts[1:]) for k in [heap.keys[a:b]] for i in range(len(k)) for j in (2 * i + 1, 2 * i + 2) if j < len(k))
        assert before.shape == own.shape
    assert popped[-1] < 3000
