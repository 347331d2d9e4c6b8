"""Tree edit distance between small schema trees, and the cheapest edit script.

A tree is ``(label, children)``, children sorted by label. Distances are those
of Zhang and Shasha: insert, delete and relabel cost one each.
"""

from __future__ import annotations

from functools import lru_cache

Tree = tuple[str, tuple]


def parse_type(text: str) -> Tree:
    """The tree of a type text such as ``OBJECT<rings: ARRAY<number>>``; members are nodes over their type."""
    pos = 0

    def word() -> str:
        nonlocal pos
        start = pos
        quoted = False
        while pos < len(text) and (quoted or text[pos] not in "<>,:"):
            quoted ^= text[pos] == "`"
            pos += 1
        return text[start:pos].strip().strip("`")

    def node() -> Tree:
        nonlocal pos
        name = word()
        kids: list[Tree] = []
        if pos < len(text) and text[pos] == "<":
            pos += 1
            while pos < len(text) and text[pos] != ">":
                mark = pos
                label = word()
                if pos < len(text) and text[pos] == ":":
                    pos += 1
                    kids.append((label, (node(),)))
                else:
                    pos = mark
                    kids.append(node())
                if pos < len(text) and text[pos] == ",":
                    pos += 1
            pos += 1
        return (name, tuple(sorted(kids)))

    return node()


def size(tree: Tree) -> int:
    return 1 + sum(map(size, tree[1]))


@lru_cache(maxsize=4096)
def distance(a: Tree, b: Tree) -> int:
    """Least number of insertions, deletions and relabellings that turn ``a`` into ``b``."""

    def listed(tree: Tree) -> tuple[list[str], list[int], list[int]]:
        labels: list[str] = []
        left: list[int] = []

        def walk(t: Tree) -> int:
            first = -1
            for kid in t[1]:
                leaf = walk(kid)
                first = leaf if first < 0 else first
            labels.append(t[0])
            left.append(len(labels) - 1 if first < 0 else first)
            return left[-1]

        walk(tree)
        roots = {l: i for i, l in enumerate(left)}
        return labels, left, sorted(roots.values())

    la, left_a, keys_a = listed(a)
    lb, left_b, keys_b = listed(b)
    whole = [[0] * len(lb) for _ in la]
    for i in keys_a:
        for j in keys_b:
            io, jo = left_a[i], left_b[j]
            m, n = i - io + 2, j - jo + 2
            part = [[0] * n for _ in range(m)]
            for x in range(1, m):
                part[x][0] = part[x - 1][0] + 1
            for y in range(1, n):
                part[0][y] = part[0][y - 1] + 1
            for x in range(1, m):
                for y in range(1, n):
                    ia, jb = io + x - 1, jo + y - 1
                    gap = min(part[x - 1][y], part[x][y - 1]) + 1
                    if left_a[ia] == io and left_b[jb] == jo:
                        part[x][y] = min(gap, part[x - 1][y - 1] + (la[ia] != lb[jb]))
                        whole[ia][jb] = part[x][y]
                    else:
                        part[x][y] = min(gap, part[left_a[ia] - io][left_b[jb] - jo] + whole[ia][jb])
    return whole[-1][-1]


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment of a square cost matrix (Hungarian method)."""
    n = len(cost)
    inf = float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        way, least, used, j0 = [0] * (n + 1), [inf] * (n + 1), [False] * (n + 1), 0
        match[0] = i
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    column = [0] * n
    for j in range(1, n + 1):
        column[match[j] - 1] = j - 1
    return column


def script(gone: dict[str, str], new: dict[str, str], same: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The cheapest script that turns the fields ``gone`` (name to type) into ``new``.

    ``same`` holds the pairs of names whose contents agree: only these may be
    renamed. Deleting or adding a field costs its tree; a rename costs the tree
    edit distance of the two types plus a tenth for unlike names, so that it
    is chosen before delete and add, and the closest type and name among rivals.
    """
    a, b = sorted(gone), sorted(new)
    n = len(a) + len(b)
    ta = {x: parse_type(gone[x]) for x in a}
    tb = {x: parse_type(new[x]) for x in b}
    never = 1e6
    cost = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i < len(a) and j < len(b):
                x, y = a[i], b[j]
                if (x, y) in same:
                    whole = size(ta[x]) + size(tb[y])
                    likeness = len(set(zip(x, x[1:])) & set(zip(y, y[1:]))) / max(1, len(x) + len(y) - 2)
                    cost[i][j] = 0.9 * min(distance(ta[x], tb[y]), whole) + 0.1 * (1 - likeness)
                else:
                    cost[i][j] = never
            elif i < len(a):
                cost[i][j] = 1.0 + size(ta[a[i]]) if j - len(b) == i else never
            elif j < len(b):
                cost[i][j] = 1.0 + size(tb[b[j]]) if i - len(a) == j else never
    out, taken = [], set()
    for i, j in enumerate(assign(cost)):
        if i < len(a):
            if j < len(b):
                out.append(("renamed", a[i], b[j]))
                taken.add(b[j])
            else:
                out.append(("removed", a[i], ""))
    out += [("added", "", y) for y in b if y not in taken]
    return out
