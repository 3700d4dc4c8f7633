"""Aligned trees of pages: against brute force, and pages without telling tags or classes."""

import itertools
import random
import re

from lurewatch.llm import alignment, wrappers
from lurewatch.llm.alignment import OPTIONAL, REPEATED, Node, align, flat, grown, matched, merge

rng = random.Random(8)


def nodes(keys):
    return [Node(k, alignment.OTHER) for k in keys]


def longest(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(y))):
        best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_longest_common_subsequences():
    for _ in range(600):
        x, y = ("".join(rng.choices("abcd", k=rng.randrange(9))) for _ in range(2))
        pairs = align(nodes(x), nodes(y))
        assert len(pairs) == longest(x, y) and all(x[i] == y[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(pairs))


def tree(page):
    built = alignment.Skeleton()
    blocks, _ = wrappers.parse(page, built)
    rows, at = built.done()
    return rows, [(rows[n][1], text) for n, (_, _, text) in zip(at, blocks)]


def test_trees_fold_repeats_and_keep_the_place_of_every_text():
    rows, at = tree("<body><h1>A</h1><h2>1</h2><p>a<p>b<h2>2</h2><p>c<ul><li>x<li>y<p>z</ul></body>")
    assert [(k, f) for _, k, _, f in rows] == [("^", 0), ("body", 0), ("h1", 0), ("h2", REPEATED), ("p", REPEATED), ("ul", 0), ("li", REPEATED), ("p", OPTIONAL)]
    assert at == [("h1", "A"), ("h2", "1"), ("p", "a"), ("p", "b"), ("h2", "2"), ("p", "c"), ("li", "x"), ("li", "y"), ("p", "z")]
    assert tree("<div>ad</div><div><h1>T</h1></div><div>x</div>")[0][1:] == [(0, "div:", 2, 0), (0, "div>h1", 2, 0), (2, "h1", 2, 0), (0, "div:", 2, 0)]
    assert tree(None) == tree("") == ([(-1, "^", 2, 0)], [])


def test_merged_pages_find_all_their_places():
    for _ in range(100):
        pages = [tree("".join(f"<{t}>1</{t}>" for t in ("h1", "p", "ul", "table", "pre", "h2") if rng.random() < 0.7))[0] for _ in range(6)]
        root = grown(pages[0])
        for page in pages[1:]:
            merge(root, grown(page))
        wrapper = flat(root)
        for page in pages:
            assert [wrapper[w][1] for w in matched(page, wrapper)] == [k for _, k, _, _ in page]
        for at, (_, _, _, flags) in enumerate(wrapper):
            assert bool(flags & OPTIONAL) or all(at in matched(p, wrapper) for p in pages)


def test_deep_wide_and_alternating_trees():
    import time

    began = time.time()
    deep, _ = tree("<div>" * 60_000 + "x")
    assert len(deep) == 60_001 and len(tree("<p>a</p><h2>b</h2>" * 50_000)[0]) == 3
    wide = "".join(f"<div class={''.join(rng.choices('abcdef', k=5))}>v</div>" for _ in range(20_000))
    assert matched(tree(wide)[0], tree(wide)[0]) == list(range(len(tree(wide)[0])))
    assert matched(deep, deep) == list(range(len(deep)))
    assert alignment.region(deep, [0.0] * len(deep))[0] == [True] * len(deep)
    assert time.time() - began < 60


def page(i, rest="", ad="div", words=30):
    text = "".join(f"<p>{' '.join(rng.choices('red green blue black white'.split(), k=words))} {i} {j}</p>" for j in range(1 + i % 4))
    return f"<html><body><nav><ul><li>{i}</li><li>x{i}</li></ul></nav><div class='ad'>Buy {i} now or {i + 1}</div><article><h1>Title {i}</h1>{text}</article>{rest}<footer>&copy; {i}</footer></body></html>"


def bare(html):
    html = re.sub(r"(</?)(article|main|nav|footer)\b", r"\1div", html)
    return re.sub(r" class='[^']*'", "", html)


def extracted(spark, htmls, url="http://s.example/{}"):
    df = spark.createDataFrame([(i, url.format(i), h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in sorted(wrappers.extracted(df).collect(), key=lambda r: r.page_id)]


def test_the_wrapper_finds_the_article_without_marks(spark, monkeypatch):
    whole = [page(i, "<section>Read on</section>" if i % 3 else "") for i in range(20)]
    want = extracted(spark, whole)
    assert all(t.startswith(f"Title {i}\n") and t.count("\n") == 1 + i % 4 and "Buy" not in t for i, t in enumerate(want))
    stripped = [bare(h) for h in whole]
    assert extracted(spark, stripped) == want
    monkeypatch.setattr(wrappers, "FAN", 2)  # as many rounds of merging as there are halvings
    assert extracted(spark, stripped) == want
    monkeypatch.setattr(wrappers, "FEWEST", 10**9)  # the wrapper off
    assert not any(a == b for a, b in zip(extracted(spark, stripped), want))


def test_a_mark_does_not_outweigh_ten_times_its_text(spark):
    """Teasers in article elements beside a long text in a bare one."""
    htmls = [f"<body><article>Teaser {i}</article><div><h2>Head {i}</h2><p>{'long text ' * 60}{i}</p></div></body>" for i in range(6)]
    assert extracted(spark, htmls) == [f"Head {i}\n{'long text ' * 60}{i}" for i in range(6)]
    assert extracted(spark, htmls[:2]) == ["Teaser 0", "Teaser 1"]
