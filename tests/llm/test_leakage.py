import random

import numpy as np

from tests.conftest import rows
from tessela.llm import leakage
from tessela.llm.markup import flat_words

RND = random.Random(8)
NOUNS = ["harbour", "lantern", "valley", "museum", "orchard", "captain", "village", "bridge", "winter", "teacher", "it", "was", "red", "big", "a", "the"]


def passage(seed, n=60):
    rnd = random.Random(seed)
    return [rnd.choice(NOUNS) + ("" if rnd.random() < 0.6 else str(rnd.randrange(30))) for _ in range(n)]


def edits(p, region):
    """Brute force: whether some stretch of n >= 20 words of p is in the region with at most n/10 edits."""
    for i in range(len(p) - 19):
        row = [0] * (len(region) + 1)
        for n, w in enumerate(p[i:], 1):
            new = [n]
            for j, x in enumerate(region, 1):
                new.append(min(row[j - 1] + (x != w), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= 20 and min(row) <= n // 10:
                return True
    return False


def scan(docs, table):
    return leakage.scan(*leakage.cleaned([t for _, t in docs]), table)


def test_alignment_equals_brute_force():
    rnd = random.Random(1)
    for k in range(150):
        p = passage(k, 45)
        part = p[(a := rnd.randrange(20)) : a + rnd.choice([15, 18, 20, 24, 30, 36])]
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(part))
            part = [part[:at] + part[at + 1 :], part[:at] + ["new"] + part[at:], part[:at] + ["new"] + part[at + 1 :]][rnd.randrange(3)]
        region = [rnd.choice(NOUNS) for _ in range(9)] + part + [rnd.choice(NOUNS) for _ in range(9)]
        table = leakage.passage_table([(0, [w.encode() for w in p])])
        ids = np.array([table["vocabulary"].get(w.encode(), 0) for w in region], np.int32)
        want = edits(p, region)
        assert bool(leakage.aligned([table["words"][0]], [ids])[0]) == want
        assert bool(scan([(0, " ".join(region))], table)) == want, (k, part)


def test_ways_of_writing():
    p = passage(99)
    text, plain = " ".join(p), [w.encode() for w in p]
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)
    forms = [
        text.upper(), text.replace(" ", "\n"), text.replace(" ", "&nbsp; "), wide, text.replace("a", "&#97;"), " ".join(f"'''{w}'''" for w in p), " ".join(f"[[Link|{w}]]" for w in p),
        " ".join(f"<span class=x>{w}</span><br />" for w in p), " ".join(w + "<ref name=y>Some, p. 4</ref>" for w in p), " ".join(w + "{{convert|5|km}} <!-- check -->" for w in p),
        text.replace("e", "é"), text.replace("o", "o­"), text.replace("a", "а"), text.replace("harbour", "har-\nbour"), "; ".join(p), "{{quote|1=" + text + "|x}}", "<!-- " + text + " -->",
        "{|\n|-\n| " + text + " || 7\n|}", "{{Infobox\n| note = " + text, "intro {{a|b={{quote|" + text + "}}}} end", "words<ref>" + text + "</ref> words",
    ]
    table = leakage.passage_table([(5, plain)])
    for f in forms:
        assert scan([(0, "Before it all. " + f + " And after.")], table) == [(0, 5)], f[:80]
    assert flat_words("--- ''' {{ [[ <ref> \x00 \x1a") == [b"\x1a"]


def test_texts_within_templates_comments_and_references():
    p = passage(77, 40)
    t = lambda a, b: " ".join(p[a:b])
    table = leakage.passage_table([(5, [w.encode() for w in p])])
    held = [
        t(0, 10) + " {{nowrap|" + t(10, 14) + "}} " + t(14, 25),  # a short argument in its place
        t(0, 8) + " {{lang|fr|" + t(8, 12) + "}} " + t(12, 30) + " {{small|" + t(30, 33) + "}} " + t(33, 40),
        "{{box|" + t(0, 7) + "|b=" + t(7, 14) + "|" + t(14, 21) + "}}",  # over several short arguments
        "{{quote|see [[a|" + t(0, 3) + "]] [[b|" + t(3, 5) + "]] " + t(5, 24) + "}}",  # links with pipes in an argument
        t(0, 9) + " <!-- " + t(9, 13) + " --> " + t(13, 26), "{{q|" + t(0, 12) + " {{convert|5|km|mi}} " + t(12, 24) + " {{nb|x}} z}}", "<ref>{{cite|" + t(0, 22) + "}}</ref>",
        "[[x|{{nowrap|" + t(0, 4) + "}}]] " + t(4, 24), "{{a|" + t(0, 20), " ".join(f"{{{{nowrap|{w}}}}}" for w in p), "pad " * 500 + t(0, 10) + "{{sub|" + t(10, 12) + "}}" + t(12, 22) + " pad" * 500,
    ]
    for h in held:
        assert scan([(0, h)], table) == [(0, 5)], h
    for h in ("{{a|" + t(0, 10) + "}} <!-- " + t(30, 40) + " -->", t(0, 12) + "<ref>" + t(20, 30) + "</ref>", "{{a|" + t(0, 17) + "}}", "\x01 " + t(0, 17) + " \x02"):
        assert scan([(0, h)], table) == [], h


def test_very_long_words_are_compared_whole():
    p = passage(78, 20)
    for i in (3, 9, 15):
        p[i] = "x" * 45 + p[i]
    table = leakage.passage_table([(5, [w.encode() for w in p])])
    other = lambda n: " ".join(w + "y" if w.startswith("xx") and i < n else w for i, w in enumerate(p))
    assert scan([(0, other(0))], table) == scan([(0, other(10))], table) == [(0, 5)]
    assert scan([(0, other(20))], table) == []  # three of twenty words differ, if only at their ends


def test_hits_in_portions_and_pieces_of_bytes(monkeypatch):
    import pyarrow as pa

    from tessela.llm.batches import pieces

    docs = [(i, "the " * 30 + " ".join(passage(i % 5)) + " the" * 30) for i in range(12)]
    table = leakage.passage_table([(k, [w.encode() for w in ["the"] * 25 + passage(k)]) for k in range(5)])
    want = scan(docs, table)
    monkeypatch.setattr(leakage, "_HITS", 97)
    assert scan(docs, table) == want and {k for _, k in want} == set(range(5))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 100, "", "c" * 5, "d"])], names=["i", "t"])
    assert [p.num_rows for p in pieces(iter([batch]), rows=4, size=16)] == [2, 1, 3] and [p.num_rows for p in pieces(iter([batch]), rows=2, size=1000)] == [2, 2, 2]


def test_tables(spark):
    p = [passage(i) for i in range(4)]
    items = [(1, " ".join(p[0]), "x"), (2, " ".join(p[0]).upper(), "x"), (3, " ".join(p[1][:19]), "x"), (4, None, "x"), (5, "", "x"), (None, " ".join(p[2]), "x"), (6, " ".join(p[3]), "x"), (6, " ".join(p[3]), "x")]
    docs = [(1, "So " + " ".join(p[0][5:30])), (2, " ".join(p[1])), (3, None), (4, ""), (5, "pad " * 40_000 + " ".join(p[3]) + " pad" * 40_000), (5, " ".join(p[3])), (6, " ".join(p[0][:12])), (7, " ".join(p[0] + p[3]))]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, passage string, doc_id string")
    want = {(1, 1), (1, 2), (5, 6), (7, 1), (7, 2), (7, 6)}
    assert rows(leakage.leaks(d, i)) == want
    assert rows(leakage.leaks(d, i, block=1)) == want
    assert leakage.leaks(d.limit(0), i).count() == leakage.leaks(d, i.limit(0)).count() == 0
