import os
import random

import numpy as np
import pytest

from tests.conftest import rows
from tessela.llm import reading
from tessela.llm.prose import prose, sentences

EASY, HARD = "cat dog man hill red big boat lake".split(), "constitution institutional epistemology characterisation parliamentary considerable".split()


def text(hard, n=12, seed=0):
    rnd = random.Random(seed)
    if hard:
        return " ".join(f"Although the {rnd.choice(HARD)} determined the {rnd.choice(HARD)}, the {rnd.choice(HARD)} of an {rnd.choice(HARD)} represented the {rnd.choice(HARD)}." for _ in range(n))
    return " ".join(f"The {rnd.choice(EASY)} had a {rnd.choice(EASY)}. It was on the {rnd.choice(EASY)}." for _ in range(n))


GRADED = [(i, text(i % 2, 8, i), 1 + 2 * (i % 2)) for i in range(20)] + [(90, None, 1), (91, "x", None), (92, "", 2), (93, "un deux trois", 2)]


def test_prose_only():
    junk = "{{Infobox\n| a = The man of the hill was the one of the lake.\n}}\n{| class=x\n| The man of the hill was the one of the lake.\n|}\n* The man of the hill.\n# The man of it.\n<!-- The man of the hill was here -->\n== The head of the hill ==\n"
    junk += "<syntaxhighlight>the for of in a the</syntaxhighlight>\n{{Infobox river\n| name = the one of the hill\nDer Fluss war eine alte Kirche und das Dorf.\nlol lol lol lol lol\n😀 BANANA poop LOL WAS HERE\n"
    assert prose(junk) == []
    assert prose("'''Name''' — The [[x|man]] was<ref>The one of the few.</ref> on the&nbsp;hill.") == [b"name the man was on the hill".split()]
    assert prose("") == [] and len(prose("The cat was on the hill. " * 20_000)) == 20_000
    assert len(sentences("Seen with A. B. Name, No. 16. The cat was on it; It ran. 'So' it went")) == 4


def test_levels_on_tables(spark):
    docs = [(1, text(0)), (2, text(1)), (3, None), (4, ""), (5, "The cat was on the hill."), (6, "{{x}}\n" + text(1, 10) + "\n" + text(0, 3) + "\nlol lol lol"), (1, text(0))]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, grade_level string")
    g = spark.createDataFrame(GRADED, "ref_id long, text string, grade_level int")
    got = reading.reading_levels(d, g)
    assert {(r.doc_id, r.grade_level) for r in got.collect()} == {(1, 1), (2, 3), (6, 3)} and got.count() == 4
    assert reading.reading_levels(d.limit(0), g).count() == 0
    with pytest.raises(ValueError):
        reading.fit(g.limit(0))


def test_ordinal_fit_recovers_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = np.digitize(x @ [2.0, 0, -1] + rng.logistic(size=600) * 0.3, [-1, 1])
    w, cuts = reading.fit_ordinal(x, y, np.ones(600))
    assert w[0] > 0 > w[2] and abs(w[1]) < 0.3 and cuts[0] < cuts[1]
    assert (np.digitize(x @ w, cuts) == y).mean() > 0.85


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    data = [(r.text, r.grade_level) for r in spark.read.parquet("/root/testdata/sf0.01/graded_texts.parquet").orderBy("ref_id").collect()]
    model = reading.Model([x for i, x in enumerate(data) if i % 4])
    held = [x for i, x in enumerate(data) if i % 4 == 0]
    found = model.grades([t for t, _ in held])
    scored = [(f[2], g) for f, (_, g) in zip(found, held) if f]
    assert len(scored) >= 0.9 * len(held) and np.mean([a == b for a, b in scored]) >= 0.95


def test_words_are_counted_over_all_documents(spark, monkeypatch):
    from collections import Counter

    docs = [(i, t) for i, t in enumerate([text(0), text(1), None, "", "lol", text(0, 40, 3), text(1, 30, 4)])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = Counter(w for _, t in docs if t for s in prose(t) for w in s)
    assert {(w.encode(), n) for w, n in rows(reading.word_counts(df), "word", "n")} == set(want.items())
    counts, total = reading.corpus_words(df)
    assert counts == want and total == sum(want.values())
    monkeypatch.setattr(reading, "WORDS", 3)  # the counts sent out are bounded, the total isn't
    counts, total = reading.corpus_words(df)
    assert counts == dict(sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]) and total == sum(want.values())
    assert reading.corpus_words(df.limit(0)) == ({}, 0)
