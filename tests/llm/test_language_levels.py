"""Rejection levels: foreign and random letters go, short and mixed documents of the corpus stay."""

import random

import numpy as np
import pytest

FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. ",
    "O menino saiu de casa cedo pela manhã e caminhou até a praça onde os vizinhos conversavam sobre a chuva. ",
    "De jongen liep vroeg in de ochtend van huis naar het plein waar de buren spraken over de regen. ",
    "Pojken gick tidigt på morgonen hemifrån till torget där grannarna talade om regnet som inte hade fallit. ",
]


def letters(n, seed):
    return "".join(random.Random(f"letters {seed}").choices("abcdefghijklmnopqrstuvwxyz", k=n))


@pytest.fixture(scope="module")
def rows(spark):
    return [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("odd", [0.0, 0.03])
def test_rejection(spark, rows, odd):
    from chronoweave.llm.language_id import REJECT_AT, Judge, fit_languages

    schema = "doc_id long, text string, lang string"
    added = [(10**6 + k, letters(400, -1 - k), r.lang) for k, r in enumerate(rows) if k % 100 < 100 * odd]
    judge = Judge(*fit_languages(spark.createDataFrame([tuple(r) for r in rows] + added, schema)), REJECT_AT)
    rejected = lambda texts: judge(texts)[-1]
    assert rejected([t * k for t in FOREIGN for k in (1, 8)]).all()
    assert rejected([letters(n, 1000 * n + k) for n in (60, 200, 840) for k in range(20)]).all()
    assert rejected([r.text for r in rows]).sum() <= 2
    prose = [r.text for r in rows if r.text[:60].replace(" ", "").replace(".", "").replace(",", "").isalpha()]
    assert len(prose) > 300 and not rejected([t[:n] for t in prose for n in (20, 60)]).any()
    both = [a.text[:400] + " " + b.text[:400] for a, b in zip(rows, rows[1:]) if a.lang != b.lang]
    assert np.mean(rejected(both)) < 0.05


@pytest.mark.parametrize("langs", [("es",), ("es", "en")])
def test_levels_of_few_languages(spark, rows, langs):
    from chronoweave.llm.language_id import REJECT_AT, Judge, fit_languages

    own = [tuple(r) for r in rows if r.lang in langs]
    judge = Judge(*fit_languages(spark.createDataFrame(own, "doc_id long, text string, lang string")), REJECT_AT)
    assert judge([letters(200, 1), FOREIGN[0]])[-1].all()
    assert judge([t for _, t, _ in own])[-1].sum() <= 2
