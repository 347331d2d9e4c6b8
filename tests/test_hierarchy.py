import random

from tests.conftest import rows
from tessela.operators.hierarchy import build_hierarchy, descendants

SCHEMA = "image string, method string, id int, parents array<int>, ingested_at long, depth string, root_id string, k0 int, fid int"


def table(spark, data):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in data], SCHEMA)


def brute(data):
    last = {}
    for i, m, n, p, t in data:
        if n is not None:
            parent = p[-1] if p else None
            key = (t is not None, t or 0, parent is not None, parent or 0)
            if (i, m, n) not in last or key > last[i, m, n][0]:
                last[i, m, n] = key, parent
    out = set()
    for (i, m, n), (_, p) in last.items():
        path, at, looped = [n], n, False
        while (up := last[i, m, at][1]) is not None and (i, m, up) in last:
            if up in path:
                looped = True
                break
            path.append(up)
            at = up
        out.add((i, m, n, p, -1, -1, None) if looped else (i, m, n, p, path[-1], len(path) - 1, tuple(path[::-1])))
    return out


def got(df):
    return {(r.image, r.method, r.id, r.parent_id, r.root_id, r.depth, r.path and tuple(r.path)) for r in df.collect()}


def test_edge_cases_and_clashing_columns(spark):
    data = [
        ("a", "m", 1, None, 1), ("a", "m", 2, [9, 1], 1), ("a", "m", 3, [2], 1), ("a", "m", 3, [2], 1),  # repeated
        ("a", "m", 4, [99], 1), ("a", "m", 5, [4], 1),  # a parent without a row
        ("a", "m", 6, [7], 1), ("a", "m", 7, [6], 1), ("a", "m", 8, [7], 1), ("a", "m", 10, [10], 1),  # cycles
        ("a", "m", None, [1], 1), ("b", "m", 2, [], 1), ("b", "m", 3, [None], 1),
        ("a", "n", 2, [1], 5), ("a", "n", 2, [3], 4), ("a", "n", 2, [8], None), ("a", "n", 1, [], 2), ("a", "n", 1, [2], 2),  # late, null and equal order
        (None, "m", 1, [], 1), (None, "m", 2, [1], 1), (None, None, 1, [2], 1),  # null keys are keys
    ]
    assert got(build_hierarchy(table(spark, data))) == brute(data)


def test_empty_table(spark):
    tree = build_hierarchy(table(spark, []))
    assert tree.count() == 0 and descendants(tree).count() == 0


def test_random_forests_with_one_hot_image(spark):
    rnd = random.Random(4)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice("abc"), "m", i, rnd.choice([None, [], [rnd.randrange(120)], [rnd.randrange(120), rnd.randrange(120)]]), rnd.randrange(3)) for i in range(100) for _ in range(2)]
    assert got(build_hierarchy(table(spark, data))) == brute(data)


def test_deep_chain_and_descendants(spark):
    tree = build_hierarchy(table(spark, [("a", "m", i, [i - 1] if i else None, 1) for i in range(12)]))
    pairs = rows(descendants(tree), "ancestor_id", "descendant_id", "distance")
    assert pairs == {(a, b, b - a) for b in range(12) for a in range(b)}


def test_chain_of_two_thousand_with_a_star_and_a_cycle(spark):
    n = 2000
    data = [("a", "m", i, [i - 1] if i else None, 1) for i in range(n)]
    data += [("a", "m", n + i, [n - 1], 1) for i in range(500)]  # many children of the deepest node
    data += [("a", "m", 9000 + i, [9000 + (i + 1) % 37], 1) for i in range(37)] + [("a", "m", 9500, [9001], 1)]
    tree = build_hierarchy(table(spark, data), with_path=False)
    got_ = {r.id: (r.root_id, r.depth) for r in tree.collect()}
    assert got_ == {**{i: (0, i) for i in range(n)}, **{n + i: (0, n) for i in range(500)}, **{9000 + i: (-1, -1) for i in range(37)}, 9500: (-1, -1)}
    jobs = len({f.rsplit("/", 2)[1] for f in tree.inputFiles()})
    assert jobs <= 14  # about log2 of the depth
