"""Page texts, whitening and Merkle proofs: against plain Python, and their defined cases."""

import hashlib
import html
import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.llm import htmltext, merkle, whitening
from foldwright.llm.queries import QUERIES

ARTICLE = "<article><h1>A title</h1><p>First words, <b>bold</b> ones.<p>Second &amp; last<br>line.</article>"
WANTED = "A title\nFirst words, bold ones.\nSecond & last line."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>no</title>{head}</head><body>{body}</body></html>"


def own_text(source):
    tree = htmltext.parse(source)
    best = htmltext.best_container(tree)
    return htmltext.text_at(tree, best.key) if best else ""


@pytest.mark.parametrize(
    "body",
    [
        ARTICLE,
        f"<nav><ul><li><a href=x>Menu</a></ul></nav>{ARTICLE}<footer>&copy; us</footer>",
        f"<header><h1>The site</h1></header><div class='wrap has-sidebar'>{ARTICLE}<aside>Other reads</aside></div>",
        ARTICLE.replace("</article>", "<div class=ad>Buy this now</div><form>Mail <input></form></article>"),
        ARTICLE.replace("</article>", "<section id=comments><p>I like it a lot</p></section></article>"),
        ARTICLE.replace("<p>", "<script>if (a</p>b) '<p>'</script><style>p{}</style><!-- <p>no -->\n<p>", 1),
        ARTICLE.replace("article", "main") + "<div class='cookie-notice'>We use cookies, a great many of them</div>",
        f"<div class=post>{ARTICLE[9:-10]}</div><div class='widget'>Some widget with text</div>",
        ARTICLE.replace("</article>", ""),
        ARTICLE.replace("First words", "First <span class='advert'>spam</span>words"),
    ],
)
def test_page_layouts(body):
    assert own_text(page(body)) == WANTED


def test_page_oddities():
    assert own_text("") == own_text("<p></p>") == own_text("<!-- only") == own_text("<script>x") == ""
    assert own_text("plain words  only") == "plain words only"
    assert own_text("a < b <c") == "a < b"
    assert own_text("<p>1 &lt 2 &#x41; &nosuch; &am") == "1 < 2 A &nosuch; &am"
    assert own_text("<table><tr><td>one<td>two<tr><td>three</table>") == "one\ntwo\nthree"
    assert own_text("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>") == "one\ntwo\nin\nthree"
    deep = own_text("<div>" * 50_000 + "deep" + "<p>x" * 50_000)
    assert deep.startswith("deep\nx\nx")


class PlainText(HTMLParser):
    """The article's blocks by the standard library's parser: another way to the same text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.blocks[-1] += " " if tag == "br" else ""
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def test_pages_against_the_standard_parser(spark, sf_dir):
    got = {r["page_id"]: r for r in QUERIES["op11_html_text"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        parser = PlainText()
        parser.feed(r["html"])
        blocks = [" ".join(b.split()) for b in parser.blocks]
        text = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], text, len(text))


def test_hosts_decide_together(spark):
    """A page whose chrome outweighs its text follows the others of its host; strangers stand alone."""
    story = lambda words: page(f"<div class='c1 body'><p>{words}</p></div><div class='c7 extra'><p>{'noise ' * 9}</p></div>")
    rows = [(i, "http://a.org/x", story("long words " * 30)) for i in range(5)] + [(5, "http://A.ORG/y", story("short"))]
    rows += [(6, "http://a.org/z", page("<p>other layout</p>")), (7, None, story("short")), (8, "nohost", None), (8, "nohost", None)]
    rows += [(None, "http://b.org", ""), (9, "http://a.org", story("").replace("c1", "c2"))]
    df = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], "page_id long, url string, html string, text string, keys int, _host int")
    got = htmltext.extract_text(df)
    assert got.columns == ["page_id", "url", "keys", "_host", "text", "text_path"]
    by = {}
    for r in got.collect():
        by.setdefault(r["page_id"], []).append((r["text"], r["text_path"]))
    assert by[0] == [(" ".join(["long words"] * 30), "html>body>div.body.c#")]
    assert by[5] == [("short", "html>body>div.body.c#")]
    assert by[6] == [("other layout", "html>body")]
    assert by[7][0][0].startswith(("short", "noise"))
    assert by[8] == [("", None)] * 2 and by[None] == [("", None)]
    assert by[9] == [("", None)]  # the host's container, with nothing in it
    assert htmltext.extract_text(df.limit(0)).collect() == []
    votes = {(r["host"], r["path"]): r["pages"] for r in htmltext.page_votes(df).collect()}
    assert votes["a.org", "html>body>div.body.c#"] == 5


def test_components_against_eigh():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3, 17, 64):
        turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
        for values in (np.logspace(0, -7, size), 1 + 0.1 * rng.random(size), np.repeat([3.0, 1.0], [size // 2, size - size // 2]), np.zeros(size)):
            a = (turn * values) @ turn.T
            a = (a + a.T) / 2
            got, vectors = whitening.spectral_components(a)
            assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13
            assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13
            assert np.abs(a @ vectors - vectors * got).max() < 1e-13


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    u, _, v = np.linalg.svd(a)
    assert np.abs(whitening.polar_factor(a) - u @ v).max() < 1e-13


def test_whitening_against_plain(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    whole = np.floor(np.array([r["embedding"] for r in rows], float) * 1024).astype(int) + 100_000
    n, sums = len(whole), whole.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(whole.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = (whole - sums / n) @ vectors[:, :8] / np.sqrt(values[:8])
    deviation = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in whole]
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = QUERIES["op12_whitening"](spark, sf_dir).toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for component, own in got.groupby("component"):
        at = own.vec_id.map(place).to_numpy()
        sign = np.sign(own.whitened.to_numpy() @ expected[at, component - 1])
        assert np.abs(own.whitened - sign * expected[at, component - 1]).max() < 1e-7
        assert abs(own.explained.iloc[0] - values[component - 1] / values.sum()) < 1e-12
        assert own.deviation.tolist() == [deviation[i] for i in at]


def test_whitening_cases(spark):
    kinds = "vec_id long, embedding array<double>, whitened double, lane int"
    frame = lambda rows: spark.createDataFrame([(i, v, 0.5, 1) for i, v in rows], kinds)
    good = [(None, [1.0, 2.0, 0.5]), (1, [0.0, 2.0, 1.0]), (1, [0.0, 2.0, 1.0]), (2, [3.0, 2.0, -1.0])]
    odd = [(3, None), (4, [None, 1.0, 1.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, [1.0]), (8, []), (9, [1e300, 0.0, 0.0])]
    got = whitening.whiten(frame(good + odd)).toPandas()
    assert len(got) == 4 * 3 and set(got.n) == {4} and sorted(got.vec_id.dropna().unique()) == [1, 2]
    assert set(got.component) == {1, 2, 3} and (got[got.component == 3].whitened == 0).all()  # the second entry never varies
    assert abs(got.identity_error - 1).max() < 1e-9
    equal = whitening.whiten(frame([(1, [1.0, 2.0])] * 3)).toPandas()
    assert (equal.explained == 0).all() and (equal.whitened == 0).all() and (equal.deviation == 0).all()
    assert whitening.whiten(frame([(1, [])])).collect() == [] == whitening.whiten(frame(good).limit(0)).collect()
    huge = whitening.whiten(frame([(1, [1e9]), (2, [-1e9])])).toPandas()
    assert huge.deviation.isna().all() and np.allclose(huge.whitened.abs(), 1)


def plain_digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return plain_digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([plain_digest("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def plain_proofs(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of (doc_id, source, lang, n_chars, text) rows."""
    none_first = lambda v: (v is not None, v or 0)
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (none_first(r[0]), plain_leaf(r))) for s in names}
    levels = {s: plain_levels([plain_leaf(r) for r in own]) for s, own in trees.items()}
    top = plain_levels([levels[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(trees[s]):
            path = plain_path(levels[s], i) + plain_path(top, k)
            folded = leaf = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                folded = plain_leaf((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for place, others in path:
                folded = plain_digest("".join(others[:place]) + folded + "".join(others[place:]))
            proof = plain_digest("".join(o for _, others in path for o in others))
            out.append((row[0], leaf, levels[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, at int, node int"


@pytest.mark.parametrize("hot,sources", [(1, 1), (17, 1), (256, 2), (257, 40), (4097, 300)])
def test_proofs_against_plain(spark, hot, sources):
    draw = random.Random(hot)
    word = lambda: draw.choice(["Äpfel", "", "Some Text", "lower", None])
    rows = [(i, "hot", word(), draw.choice([None, 5]), word()) for i in range(hot)]
    rows += [(i, f"s{draw.randrange(sources)}", "en", i, word()) for i in range(hot, hot + sources - 1)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(7)
    assert sorted((tuple(r) for r in merkle.proofs_after_tampering(df).collect()), key=repr) == plain_proofs(rows)


def test_proof_cases(spark):
    long = "Long TEXT " * 200_000
    rows = [(None, None, None, None, None), (None, None, "en", 1, "No Id"), (5, "", "en", 0, ""), (5, "", "en", 0, ""), (5, "", "en", 1, "Other")]
    rows += [(7, "a", "de", len(long), long), (8, "é", "fr", 1, "É"), (9, "z", "fr", None, "A")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    got = sorted((tuple(r) for r in merkle.proofs_after_tampering(df).collect()), key=repr)
    assert got == plain_proofs(rows)
    assert merkle.proofs_after_tampering(df.limit(0)).collect() == []
    manifest = merkle.build_manifest(df)
    assert manifest.root == got[0][3]
    for r in manifest.proofs(with_paths=True).collect():
        assert r["verified"] and merkle._folded(r["leaf"], [(p["place"], p["siblings"]) for p in r["path"]]) == manifest.root
        assert (r["source"] is None) == (r["doc_id"] is None)
    assert merkle.build_manifest(df.limit(0)).root is None
    changed = df.withColumn("text", F.when(F.col("doc_id") == 9, "B").otherwise(F.col("text")))
    assert merkle.build_manifest(changed).root != manifest.root
    assert html.unescape("&amp") == "&"
