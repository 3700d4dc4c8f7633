"""Union-free regular expressions over trees of blocks: pages of a host are aligned one after another into a wrapper.

A page is a tree of block elements. Sequences of children are aligned by a longest common subsequence of their keys. A
child that one side lacks becomes an optional group; equal neighbours, alone or in periods of up to four, fold into a
repeated group whose copies are aligned with each other; text of an element is a slot. No node holds alternatives.

The order of merging is fixed (by hash of the tree), so a wrapper depends on the pages alone. All walks are iterative:
depth and breaks of a page do not matter. A wrapper grows with the different places of a host's pages, not with pages.
"""

from __future__ import annotations

from bisect import bisect_left

#: siblings that repeat in periods up to this many fold; an occurrence of a key may align with those this far from its number
PERIODS, BAND = 4, 8
#: bare containers of these tags are told apart by what they hold first
BARE = ("div", "section")
#: tags that may hold the region of a text; others are its flow
CONTAINERS = frozenset("^ html body div section article main center td form aside nav header footer details dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OPTIONAL, REPEATED = 1, 2
CHROME, ARTICLE, OTHER = 0, 1, 2
#: how many times more text a place needs than another that its tag or class favours
TIE = 10


class Node:
    __slots__ = ("key", "kind", "flags", "kids", "into", "at")

    def __init__(self, key: str, kind: int, flags: int = 0):
        self.key, self.kind, self.flags, self.kids, self.into, self.at = key, kind, flags, [], None, -1

    @property
    def tag(self) -> str:
        return self.key.replace("@", ".").replace(">", ".").replace(":", ".").replace("!", ".").split(".", 1)[0]


def align(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of keys, occurrences of a key being at most BAND apart in number."""
    low, high_x, high_y = 0, len(x), len(y)
    while low < high_x and low < high_y and x[low].key == y[low].key:
        low += 1
    while high_x > low and high_y > low and x[high_x - 1].key == y[high_y - 1].key:
        high_x, high_y = high_x - 1, high_y - 1
    places: dict[str, list[int]] = {}
    for j in range(low, high_y):
        places.setdefault(y[j].key, []).append(j)
    ends: list[int] = []  # least place in y that ends a chain of each length
    chains: list[tuple] = []
    seen: dict[str, int] = {}
    for i in range(low, high_x):
        key = x[i].key
        if key not in places:
            continue
        k = seen[key] = seen.get(key, -1) + 1
        for j in reversed(places[key][max(0, k - BAND) : k + BAND + 1]):
            at = bisect_left(ends, j)
            chain = (i, j, chains[at - 1] if at else None)
            if at == len(ends):
                ends.append(j), chains.append(chain)
            elif j < ends[at]:
                ends[at], chains[at] = j, chain
    middle, chain = [], chains[-1] if chains else None
    while chain:
        middle.append(chain[:2])
        chain = chain[2]
    return [(i, i) for i in range(low)] + middle[::-1] + [(high_x + k, high_y + k) for k in range(len(x) - high_x)]


def merge(into: Node, other: Node) -> None:
    """Make `into` the wrapper of all that `into` and `other` stand for."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        b.into, a.flags = a, a.flags | b.flags
        kids, i, j = [], 0, 0
        for p, q in [*align(a.kids, b.kids), (len(a.kids), len(b.kids))]:
            for lone in (*a.kids[i:p], *b.kids[j:q]):
                lone.flags |= OPTIONAL
                kids.append(lone)
            if p < len(a.kids):
                kids.append(a.kids[p])
                stack.append((a.kids[p], b.kids[q]))
            i, j = p + 1, q + 1
        a.kids = kids


class Skeleton:
    """The folded tree of a page, built from its opening and closing tags; `at` holds the element of every block."""

    def __init__(self):
        self.root = Node("^", OTHER)
        self.path, self.at = [self.root], []

    def open(self, sig: str, kind: int) -> None:
        self.path.append(Node(sig, kind))

    def text(self) -> None:
        self.at.append(self.path[-1])

    def close(self) -> None:
        node = self.path.pop()
        if node.key in BARE:
            node.key += ">" + node.kids[0].key.split(">")[0] if node.kids else ":"
        kids = self.path[-1].kids
        kids.append(node)
        for p in range(1, PERIODS + 1):
            if len(kids) >= 2 * p and all(kids[-k].key == kids[-k - p].key for k in range(1, p + 1)):
                for k in range(p):
                    first, again = kids[-2 * p + k], kids[-p + k]
                    merge(first, again)
                    first.flags |= REPEATED
                del kids[-p:]
                break

    def done(self) -> tuple[list[tuple], list[int]]:
        """(rows of the tree, for every block the number of its row)."""
        while len(self.path) > 1:
            self.close()
        rows, found = flat(self.root), []
        for node in self.at:
            trail = []
            while node.into is not None:
                trail.append(node)
                node = node.into
            for passed in trail:
                passed.into = node
            found.append(node.at)
        return rows, found


def flat(root: Node) -> list[tuple[int, str, int, int]]:
    """(parent's number, key, kind, flags) of every node, parents first; numbers are kept in the nodes."""
    rows, stack = [], [(root, -1)]
    while stack:
        node, parent = stack.pop()
        node.at = len(rows)
        rows.append((parent, node.key, node.kind, node.flags))
        stack += [(kid, node.at) for kid in reversed(node.kids)]
    return rows


def grown(rows: list) -> Node:
    """The tree of such rows."""
    nodes: list[Node] = []
    for at, (parent, key, kind, flags) in enumerate(rows):
        node = Node(key, kind, flags)
        node.at = at
        nodes.append(node)
        if parent >= 0:
            nodes[parent].kids.append(node)
    return nodes[0]


def matched(page: list, wrapper: list) -> list[int]:
    """The wrapper's number of every node of a page, -1 where the alignment leaves one out."""
    out, stack = [-1] * len(page), [(grown(page), grown(wrapper))]
    while stack:
        a, b = stack.pop()
        out[a.at] = b.at
        stack += [(a.kids[i], b.kids[j]) for i, j in align(a.kids, b.kids)]
    return out


def region(page: list, weights: list[float]) -> tuple[list[bool], bool]:
    """(for every node whether its text belongs to the article, whether that is a marked article).

    weights: slot text of a node on the host's pages. From the root down, the group with most slot text is followed until
    the flow of an element has as much itself; headings on the way stay. Marks break ties: marked articles
    are kept unless another group has TIE times their text, and navigation and the like needs TIE times the others'."""
    root, below = grown(page), list(weights)
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack += reversed(node.kids)
    only_heads = [False] * len(page)
    for node in reversed(nodes):
        below[node.at] += sum(below[k.at] for k in node.kids)
        only_heads[node.at] = node.tag in HEADINGS or bool(node.kids) and not weights[node.at] and all(only_heads[k.at] for k in node.kids)
    marked = [n for n in nodes if n.kind == ARTICLE and (not n.at or page[n.at][0] < 0 or page[page[n.at][0]][2] != ARTICLE)]
    taken = {n.at for n in marked}

    def worth(n: Node) -> float:
        return 0.0 if n.at in taken else below[n.at] - inside[n.at] if n.kind != CHROME else below[n.at] / TIE

    inside = [0.0] * len(page)  # text of marked articles at or below a node
    for node in reversed(nodes):
        inside[node.at] = below[node.at] if node.at in taken else sum(inside[k.at] for k in node.kids)
    at, heads = root, []
    while True:
        flow = weights[at.at] + sum(below[k.at] for k in at.kids if k.tag not in CONTAINERS and k.kind != CHROME)
        groups = [k for k in at.kids if k.tag in CONTAINERS]
        best = max(groups, key=worth, default=None)
        if best is None or worth(best) <= flow:
            break
        heads += [k for k in at.kids if only_heads[k.at] and k.kind != CHROME and k is not best]
        at = best
    keep = [False] * len(page)
    use_marks = bool(marked) and TIE * inside[0] >= worth(at)
    stack = list(marked) if use_marks else [at, *heads]
    chrome = not use_marks and at.kind == CHROME
    while stack:
        node = stack.pop()
        keep[node.at] = True
        stack += [k for k in node.kids if k.kind != CHROME or chrome]
    return keep, use_marks
