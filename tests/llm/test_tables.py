"""Pages and embeddings: held-out accuracy and recall; odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from vellum.llm import html, neighbours

PAGES = "page_id long, url string, html string"


def test_blocks():
    page = "<html><title>no</title><script>var x='<p>'</script><nav><ul><li><a href=x>one</a><li>two</ul></nav><!-- no --><article class='main x'><h1>Head &amp; tail</h1><p>a <b>bold</b><br>word<p>next</article>tail"
    got = html.blocks(page)
    assert [b.text for b in got] == ["one", "two", "Head & tail", "a bold word", "next", "tail"]
    assert got[0].link == 1.0 and got[1].link == 0.0 and got[2].path == ("html", "article", ".main", ".x", "h1") and got[5].path == ("html",)
    for broken in ("<", "<p", "a<b", "<p class='x", "</p></div>", "<!--", "<script>x", "a > b < c", "<>", "\x00", "<p>" * 3000):
        html.blocks(broken)


def test_blocks_of_deep_pages():
    """Work follows a page's length: unclosed elements, and closing tags of none, don't make it quadratic."""
    for page, n in (("<div>a" * 60_000, 60_000), ("<div>" * 60_000 + "</p>a" * 60_000, 60_000), ("<i><div>" + "<b>" * 60_000 + "</i>a" * 60_000, 1), ("<p class='x'>a" * 60_000, 60_000)):
        got = html.blocks(page)
        assert len(got) == n and html.features([got])[0].shape == (n, html.WIDTH)
    assert got[-1].path == ("p", ".x") and len(html.blocks("<div>a" * 300)[-1].path) == 300


def test_network_by_a_plain_loop():
    """Gates, states and output as the equations say, one block and one unit at a time."""
    from math import exp, tanh

    sigmoid = lambda z: 1 / (1 + exp(-z))
    r = np.random.RandomState(8)
    net = html.Network(4)
    x = r.normal(0, 1, (9, html.WIDTH)).astype(np.float32)
    got = net.probabilities(x, np.array([0, 5, 5, 9]))
    want = []
    for page in (x[:5], x[5:]):
        states = []
        for d, w in enumerate(net.W):
            h, c, seen = [0.0] * html.HIDDEN, [0.0] * html.HIDDEN, {}
            for t in range(len(page)) if d == 0 else reversed(range(len(page))):
                inputs = [*page[t].tolist(), *h, 1.0]
                z = [sum(v * float(w[k, j]) for k, v in enumerate(inputs)) for j in range(4 * html.HIDDEN)]
                n = html.HIDDEN
                for j in range(n):
                    c[j] = sigmoid(z[n + j]) * c[j] + sigmoid(z[j]) * tanh(z[3 * n + j])
                h = [sigmoid(z[2 * n + j]) * tanh(c[j]) for j in range(n)]
                seen[t] = h
            states.append(seen)
        want += [sigmoid(sum(float(o) * v for o, v in zip(net.out, [*states[0][t], *states[1][t], 1.0]))) for t in range(len(page))]
    assert np.abs(got - want).max() < 1e-4


def test_labeller_on_held_out_pages(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    net = html.train(pages[:120], epochs=10)
    parsed = [html.blocks(p) for p in pages[120:]]
    y = np.array([html.label(b) for p in parsed for b in p], float)
    for hide in (None, np.ones(len(parsed), bool)):
        p = net.probabilities(*html.features(parsed, hide))
        assert ((p >= 0.5) == (y == 1)).mean() > 0.97


def test_gradients():
    r = np.random.RandomState(0)
    net = html.Network()
    net.W = [w.astype(np.float64) for w in net.W]
    net.out = net.out.astype(np.float64)
    x, mask = r.normal(0, 1, (5, 3, html.WIDTH)), np.arange(5)[:, None] < np.array([5, 2, 4])[None, :]
    x = np.where(mask[:, :, None], x, 0)
    y, w = (r.rand(5, 3) > 0.5).astype(float), np.where(mask, 1.0, 0.0)

    def loss():
        p = net.forward(x, mask)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grads = net.gradients(x, mask, y, w)
    for k, (a, g) in enumerate(zip([*net.W, net.out], grads)):
        for _ in range(6):
            i = tuple(r.randint(0, s) for s in a.shape)
            old, e = a[i], 1e-4
            a[i] = old + e
            up = loss()
            a[i] = old - e
            down = loss()
            a[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 2e-3 * max(1, abs(g[i])), k


def test_extract(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert len(got) == pages.count() and all(r.n_content <= r.n_blocks for r in got.values())
    net = html.fit(pages)
    for r in pages.collect()[:10]:
        b = html.blocks(r.html)
        keep = net.probabilities(*html.features([b])) >= 0.5
        assert got[r.page_id].text == "\n\n".join(x.text for x, k in zip(b, keep) if k)


def test_extract_odd(spark):
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, None, "<p"), (None, None, "words"), (5, "u", "<p>a</p>" * 3000), (2, "u", "")], PAGES).withColumn("text", F.lit("x")).withColumn("n_blocks", F.lit(None).cast("int"))
    got = rows(html.extract(odd))
    assert len(got) == 6 and (1, None, 0, 0) in got and got.count((2, "", 0, 0)) == 2 and (None, "words", 1, 1) in got and any(r[2] == 3000 for r in got)
    assert rows(html.extract(odd.where("false"))) == []


VECTORS = "vec_id long, embedding array<float>, label int"


def recall(spark, data, k=10, **kw):
    ids = list(range(len(data)))
    df = spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in zip(ids, data)], VECTORS)
    got = {}
    for r in neighbours.neighbours(df, k, **kw).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, r.distance))
    x = np.array(data, np.float32)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    hits = 0
    for i in ids:
        assert [r for r, _, _ in sorted(got[i])] == list(range(1, k + 1))
        assert all(abs(d[i, n] - v) < 1e-2 for _, n, v in got[i])
        last = np.sort(d[i])[k - 1] + 1e-3
        hits += sum(d[i, n] <= last for _, n, _ in got[i])
    return hits / (k * len(ids))


@pytest.mark.parametrize("kind", ["clusters", "uniform"])
def test_recall(spark, kind):
    r = np.random.RandomState(4)
    data = r.normal(0, 1, (900, 16)) + (r.normal(0, 4, (12, 16))[r.randint(0, 12, 900)] if kind == "clusters" else 0)
    assert recall(spark, data, leaf=60) >= 0.9


def test_recall_of_the_table(spark):
    data = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert recall(spark, data, leaf=40) >= 0.9


def test_production_search_of_the_table(spark):
    """The registered query's parameters build a tree of many leaves, visit a part of it, and find what a plain
    loop over all vectors finds, for every id that 20 divides and no other."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors, width = neighbours._vectors(df)
    tree = neighbours.build(vectors, width)
    visits, measured = neighbours.calibrate(vectors, tree, width, 10, neighbours.RECALL)
    assert len(tree.leaves()) >= 15 and visits < len(tree.leaves()) and measured >= neighbours.RECALL and tree.count.sum() == df.count()
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    got = {}
    for r in neighbours.neighbours(df, every=neighbours.EVERY).collect():
        assert abs(r.distance - np.sqrt(((x[r.vec_id] - x[r.neighbour_id]) ** 2).sum())) < 1e-4
        got.setdefault(r.vec_id, []).append(r.distance)
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for i, ds in got.items():
        last = sorted(np.sqrt(((x[i] - v) ** 2).sum()) for j, v in x.items() if j != i)[9] + 1e-4
        assert len(ds) == 10
        hits += sum(d <= last for d in ds)
    assert hits >= 0.9 * 10 * len(got)


def test_outliers_and_equal_vectors(spark):
    """An outlier sees k others however few leaves are visited; a leaf of equal vectors is cut into slots."""
    r = np.random.RandomState(2)
    data = np.concatenate([r.normal(0, 0.01, (600, 4)), [[50, 50, 50, 50]], np.tile([3.0, 3, 3, 3], (3000, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in enumerate(data)], VECTORS)
    got = {}
    for row in neighbours.neighbours(df, 10, every=600, recall=0.1).collect():
        got.setdefault(row.vec_id, []).append(row)
    assert set(got) == set(range(0, 3601, 600)) and all(len(v) == 10 for v in got.values())
    assert {row.distance for row in got[1200]} == {0.0} and sorted(row.neighbour_id for row in got[1200]) == list(range(601, 611))
    tree = neighbours.build(neighbours._vectors(df)[0], 4)
    assert neighbours.Layout(tree, 8).parts.max() >= 3000 // neighbours.MOST_LEAF


def test_search_order_is_best_first():
    t = neighbours.Tree(1)
    t.centroid = np.array([[0], [-5], [5], [-6], [-4], [4], [9]], np.float32)
    t.child = [(1, 3), (3, 5), (5, 7), (0, 0), (0, 0), (0, 0), (0, 0)]
    t.count = np.array([0, 0, 0, 1, 1, 1, 1])
    assert t.orders(np.array([[-1.0]], np.float32), 4) == [[4, 3, 5, 6]] and t.nearest(np.array([[-5.6], [8]], np.float32)).tolist() == [3, 6]


def test_neighbours_odd(spark):
    n = None
    rows_ = [(1, [0.0, 0.0], 1), (2, [0.0, 1.0], n), (3, [0.0, 1.0], 1), (4, n, 1), (5, [n, 1.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0], 1), (n, [0.0, 0.0], 1), (8, [float("inf"), 0.0], 1), (9, [], 1)]
    df = spark.createDataFrame(rows_, VECTORS).withColumn("v", F.lit("x")).withColumn("q", F.lit(1)).withColumn("rank", F.lit(2))
    got = rows(neighbours.neighbours(df))
    assert got == [(1, 2, 1.0, 1), (1, 3, 1.0, 2), (2, 1, 1.0, 2), (2, 3, 0.0, 1), (3, 1, 1.0, 2), (3, 2, 0.0, 1)]
    assert rows(neighbours.neighbours(df.where("false"))) == [] and rows(neighbours.neighbours(df.where("vec_id = 1"))) == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(300)], VECTORS)
    got = neighbours.neighbours(same, 3, leaf=20).collect()
    assert len(got) == 900 and {r.distance for r in got} == {0.0} and sorted(r.neighbour_id for r in got if r.vec_id == 7) == [0, 1, 2]
