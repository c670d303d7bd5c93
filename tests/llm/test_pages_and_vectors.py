"""Operators over pages and embeddings: odd cases and brute-force versions."""

import gzip
import hashlib
import html
import os
import random
import re

import numpy as np
import pytest
from fixtures import clashing, empty, read, rows
from pyspark.sql import functions as F

from sigspan.llm import block_neighbours, queries, rotation_codes, warc_chunks, wrapper_extract
from sigspan.llm.wrapper_extract import Rules, main_text

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>one</li><li>two</li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><header><h1>Head &amp; line</h1><p>by line</p></header>
<p>First <b>bo</b>ld&nbsp;text<br>next
line<p>Second &lt;tag&gt; &#233; a < b<script>var x = "</p>";</script><ul><li>item 1<li>item 2</ul>
<aside>beside</aside><form><p>sign up</p></form><section id="comments"><p>a reader</p></section></article></main>
<div class="ad">buy</div><footer>&copy; us</footer></body></html>"""


@pytest.fixture(scope="module")
def odd_pages(spark):
    big = "<article><p>" + "long text " * 20_000 + "</p></article>"
    pages = [
        (1, "http://a.org/1", PAGE), (2, "http://a.org/2", None), (3, "http://a.org/3", ""), (4, None, PAGE), (5, "http://b.org/x\r\ny", big),
        (6, "http://b.org/1", "<article><p>cut off &am"), (7, "http://b.org/2", "<article><p>cut off<p cla"), (7, "http://b.org/2", "<article><p>cut off<p cla"),
        (None, "http://b.org/3", PAGE), (8, "http://b.org/4", big), (9, "not a url", "plain words"), (10, "http://c.org/", "<p>x" * 40),
    ]
    return clashing(spark.createDataFrame(pages, "page_id long, url string, html string")).cache()


# --- 1 HTML extraction


def test_text_of_odd_pages(spark, odd_pages):
    found = {r["page_id"]: r for r in wrapper_extract.extract(odd_pages).collect()}
    article = "Head & line First bold text next line Second <tag> é a < b item 1 item 2"
    want = {1: article, 2: "", 3: "", 4: article, 6: "cut off &am", 7: "cut off", None: article, 9: "plain words"}
    assert {k: found[k]["text"] for k in want} == want
    assert found[5]["n_chars"] == len("long text " * 20_000) - 1 == len(found[5]["text"])
    assert found[10]["text"] == " ".join("x" * 40)
    assert wrapper_extract.extract(odd_pages).count() == odd_pages.count()
    assert wrapper_extract.extract(empty(spark, odd_pages)).count() == 0


def streams(pages):
    return [wrapper_extract.stream(list(wrapper_extract.blocks(p))) for p in sorted(set(pages))]


def rules(pages):
    """The rules of the pages of one template."""
    return Rules(wrapper_extract.rules_of(wrapper_extract.infer(streams(pages))))


def test_wrapper_inference():
    first = "<div><h2>news</h2><p>a</p><p>b</p><ul><li>1</li></ul></div>"
    second = "<div><h2>news</h2><p>c</p><ul><li>2</li><li>3</li></ul><h3>more</h3></div>"
    wrapper = wrapper_extract.infer(streams([first, second]))
    h2 = ("text", "div/h2", (wrapper_extract.hashed("news"),), 0, 2)
    assert h2 in wrapper  # a constant of the template, on two pages
    found = {name: (common, varies, pages) for name, common, varies, pages in wrapper_extract.texts_of(wrapper)}
    assert found["div/p"] == ((), 1, 2) and found["div/ul/li"] == ((), 1, 2)
    kinds = {sign: node[0] for node in wrapper for sign in str(node[1]).split("'") if node[0] in ("plus", "opt")}
    assert kinds["<p"] == "plus" and kinds["<li"] == "plus" and kinds["<h3"] == "opt"
    # aligning a page that the wrapper accepts changes nothing but the counts
    again = wrapper_extract.align(wrapper, streams([second])[0])
    assert wrapper_extract.matches(again, wrapper)
    # nor does the order of pages change what is found
    texts = lambda w: sorted(wrapper_extract.texts_of(w))
    assert texts(wrapper_extract.infer(streams([first, second])[::-1])) == texts(wrapper)


def test_wrappers_grow_with_kinds_of_elements_only():
    rng = random.Random(5)
    names = ["p", "h2", "ul", "blockquote", "pre"]
    pages = []
    for i in range(150):
        body = "".join(f"<{n}>{rng.random()}<b>x</b></{n}>" for n in rng.choices(names, k=rng.randint(3, 60)))
        pages.append(f"<article><h1>{i}</h1><div class=lead><p>Read on</p></div>{body}</article>")
    wrapper = wrapper_extract.infer(streams(pages))
    assert len(wrapper) < 40 and sum(1 for _ in wrapper_extract.texts_of(wrapper)) < 40
    assert "Read on" not in main_text(pages[0], rules(pages)) and "Read on" in main_text(pages[0], Rules({}))
    parts = [wrapper_extract.infer(streams(pages)[i : i + 40]) for i in range(0, 150, 40)]  # merged level by level
    merged = wrapper_extract.infer(parts)
    assert wrapper_extract.rules_of(merged) == wrapper_extract.rules_of(wrapper)


def test_alignment_decides(monkeypatch):
    """Without aligning, the wrapper of the first page alone calls nothing constant."""
    pages = [f"<article><h1>t{i}</h1><p>a{i}</p><div class=x><p>Our offer</p></div></article>" for i in range(5)]
    assert main_text(pages[0], rules(pages)) == "t0 a0"
    monkeypatch.setattr(wrapper_extract, "align", lambda wrapper, page, pages=True: wrapper)
    assert main_text(pages[0], rules(pages)) == "t0 a0 Our offer"


def test_template_text_outside_articles_is_dropped():
    pages = [f"<div><p>Welcome to us</p><div><p>story {i}</p></div></div>" for i in range(4)]
    assert main_text(pages[0], rules(pages)) == "story 0"


def test_marks_of_regions():
    text = lambda page: wrapper_extract.main_text(page, wrapper_extract.Rules({}))
    assert text('<div class="page with-sidebar"><p>all of it</p><nav>menu</nav></div>') == "all of it"
    assert text('<article><div class="entry-header"><h1>Title</h1><p>by me</p></div><p>body</p></article>') == "Title body"
    assert text('<div class="ad">buy</div><article></article>') == ""
    assert text('<div id="main-menu">a</div><div class="post"><p>b</p></div><ol class="comment-list"><li>c</ol>') == "b"
    assert text('<div role="main"><p>in</p></div><p>out</p>') == "in"


def test_sections_of_articles_stay():
    """Words that also name parts of an article drop nothing there."""
    text = lambda page: wrapper_extract.main_text(page, wrapper_extract.Rules({}))
    names = ["id=discussion", 'class="alert"', 'class="menu"', 'class="toc"', 'class="search"', 'class="share"']
    names += ['class="related work"', 'class="header"', 'class="widget"', 'id="skip"', 'id="cookies"']
    for name in names:
        assert text(f"<article><h1>t</h1><section {name}><p>a</p><ul><li>b</ul></section></article>") == "t a b", name
        assert text(f"<div {name}><p>a</p></div><p>b</p>") == "b", name
    for name in ['class="ad"', 'id="comments"', 'class="cookie-notice"', "role=search", 'class="newsletter signup"']:
        assert text(f"<article><h1>t</h1><div {name}><p>a</p></div></article>") == "t", name


def test_wrappers_decide(spark):
    """Constants of a template go and its slots stay, in articles and outside; marks alone say otherwise."""
    body = "<article><h1>t{i}</h1><div class=about><p>About us</p></div><p>same</p><p>p{i}</p><div class=share><p>Share it</p></div>{more}</article>"
    more = ["", "<div class=menu><p>dish {i}</p></div>", "<div class=note><p>Now on sale</p></div>"]
    plain = "<div class=top><p>Welcome</p></div><div class=menu><p>soup {i}</p></div><div class=body><p>b{i}</p><p>Ours</p></div>"
    pages = [(i, f"http://d.org/{i}", body.replace("{more}", more[i % 3]).replace("{i}", str(i))) for i in range(12)]
    pages += [(i, f"http://d.org/{i}", plain.replace("{i}", str(i))) for i in range(20, 30)]
    pages += [(i, "http://d.org/40", pages[0][2]) for i in range(40, 45)]  # copies
    pages += [(i, f"http://e.org/{i}", f"<i>{i}</i><article><p>one text</p></article>") for i in range(50, 54)]  # no slot in it
    want = {i: f"t{i} same p{i}" + (f" dish {i}" if i % 3 == 1 else "") for i in range(12)}
    want |= {i: f"soup {i} b{i}" for i in range(20, 30)} | {i: want[0] for i in range(40, 45)} | {i: "one text" for i in range(50, 54)}
    found = {r["page_id"]: r["text"] for r in wrapper_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == want
    many = pages[:12] * 1 + [(i, f"http://d.org/{i}", body.replace("{more}", "").replace("{i}", str(i))) for i in range(100, 300)]
    frame = spark.createDataFrame(many, "page_id long, url string, html string")
    assert wrapper_extract.wrappers(frame).count() == 1  # in two levels
    assert {r["text"] for r in wrapper_extract.extract(frame.where("page_id >= 100")).collect()} == {f"t{i} same p{i}" for i in range(100, 300)}
    alone = wrapper_extract.Rules({})
    assert sum(wrapper_extract.main_text(p[2], alone) != want[p[0]] for p in pages) >= 27


def brute_text(page):
    """For the given pages only: the blocks of their article."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    if not found:
        return ""
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<[a-z/][^>]*\Z", "", found[1]))
    parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in parts]
    return " ".join(b for b in parts if b)


@given
def test_html_query(spark):
    found = rows(queries.op1_html_extraction(spark, SF_DIR), "page_id", "url", "text", "n_chars")
    want = [(p["page_id"], p["url"], brute_text(p["html"]), len(brute_text(p["html"]))) for p in read(SF_DIR, "pages")]
    assert found == sorted(want, key=repr)


# --- 5 WARC


def brute_records(pages):
    payloads = [(p["page_id"], (p["html"] or "").encode()) for p in pages]
    first = {}
    for page_id, payload in payloads:
        if len(payload) >= 100 and page_id is not None:
            first[payload] = min(first.get(payload, page_id), page_id)
    found = []
    for page_id, payload in payloads:
        of = first.get(payload)
        again = of is not None and of != page_id
        digest = hashlib.sha256(payload).hexdigest()
        found.append((page_id, len(payload), digest, "revisit" if again else "response", of if again else None))
    return sorted(found, key=repr)


RECORD = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_records_of_odd_pages(spark, odd_pages, tmp_path):
    want = brute_records([r.asDict() for r in odd_pages.collect()])
    assert rows(warc_chunks.round_trip(odd_pages), *RECORD) == want
    small = warc_chunks.records(odd_pages, chunk=50).cache()  # headers and payloads in many pieces
    assert small.where("length(data) > 54").isEmpty() and small.where("chunk > 20").count() > 1000
    assert rows(warc_chunks.read(small), *RECORD) == want
    assert warc_chunks.round_trip(empty(spark, odd_pages)).count() == 0
    files = warc_chunks.export(warc_chunks.records(odd_pages.coalesce(1)), str(tmp_path)).collect()
    assert sum(f["records"] for f in files) == odd_pages.count()
    content = b"".join(gzip.open(f["path"]).read() for f in files)
    assert content.count(b"WARC/1.1\r\n") == odd_pages.count() and b"x%0D%0Ay" in content


def test_damaged_records_are_noticed(spark, odd_pages):
    records = warc_chunks.records(odd_pages.where("page_id = 1"))
    changed = records.withColumn("data", F.encode(F.regexp_replace(F.decode("data", "UTF-8"), "buy", "bye"), "UTF-8"))
    with pytest.raises(Exception, match="digest"):
        warc_chunks.read(changed).collect()


@given
def test_warc_query(spark):
    assert rows(queries.op5_warc(spark, SF_DIR), *RECORD) == brute_records(read(SF_DIR, "pages"))


# --- 9 neighbours and 10 near-duplicate vectors


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    found = [(i, (base[i % 6] + 0.1 * rng.standard_normal(8)).tolist(), i % 2) for i in range(120)]
    found += [(i, found[i % 7][1], 0) for i in range(120, 140)]  # copies: ties
    found += [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [1.0, None] * 4, 0), (204, [1.0, float("nan")] * 4, 0)]
    found += [(250, [float("inf")] + [1.0] * 7, 1), (300, [1.0, 2.0, 3.0], 1), (350, [2.0, 4.0, 6.5], 1), (400, base[0].tolist(), None)]
    found += [(450, (base[1] * 1e-30).tolist(), 1), (None, base[1].tolist(), 1), (2, found[2][1], 0), (500, [1e300] * 8, 0), (550, [1e300] * 8, 0)]
    schema = "vec_id long, embedding array<double>, label int"
    return clashing(spark.createDataFrame(found, schema)).cache()


def good(row):
    v = row["embedding"]
    return row["vec_id"] is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = (np.array(v) / np.abs(v).max() for v in (a, b))
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def brute_nearest(data):
    data = list({r["vec_id"]: r for r in data if good(r)}.values())
    found = {}
    for q in data:
        if q["vec_id"] % 50 == 0:
            others = [r for r in data if r["vec_id"] != q["vec_id"] and len(r["embedding"]) == len(q["embedding"])]
            scores = [(-cosine(q["embedding"], r["embedding"]), r["vec_id"]) for r in others]
            found[q["vec_id"]] = sorted(scores)[:5]
    return found


def check_nearest(found, data):
    want, got = brute_nearest(data), {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r
    assert got.keys() == {q for q, some in want.items() if some}
    for q, some in got.items():
        scores = [some[i + 1]["score"] for i in range(len(some))]
        assert scores == pytest.approx([-s for s, _ in want[q]], abs=1e-12)
        pairs = [(-some[i + 1]["score"], some[i + 1]["vec_id"]) for i in range(len(some))]
        assert pairs == sorted(pairs)
        apart = min((b - a for (a, _), (b, _) in zip(want[q], want[q][1:])), default=1)
        if apart > 1e-12:
            assert [p[1] for p in pairs] == [v for _, v in want[q]]


def test_nearest_of_odd_vectors(spark, odd_vectors):
    check_nearest(block_neighbours.search(odd_vectors).collect(), [r.asDict() for r in odd_vectors.collect()])
    assert block_neighbours.search(empty(spark, odd_vectors)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = block_neighbours.unit(rng.standard_normal((50, 16))), block_neighbours.unit(rng.standard_normal((60, 16)))
    qa, sa, _, ea = block_neighbours.quantised(a)
    qb, sb, lb, eb = block_neighbours.quantised(b)
    estimate = (qa.astype(int) @ qb.T.astype(int)) * sa[:, None] * sb
    assert (np.abs(estimate - a @ b.T) <= ea[:, None] * lb + eb).all()


def test_nearest_with_a_common_vector_and_ids_of_several_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    common, other = rng.standard_normal(16), rng.standard_normal(16)
    found = [(i, (common if i % 3 else rng.standard_normal(16)).tolist()) for i in range(3000)]
    found += [(50, other.tolist()), (50, (other * 2).tolist()), (100, other.tolist()), (100, (-other).tolist())]
    vectors = spark.createDataFrame(found, "vec_id long, embedding array<double>")
    monkeypatch.setattr(block_neighbours, "ROW_BLOCK", 128)
    known = block_neighbours.classes(block_neighbours.usable(vectors), 5)
    held = known.where(F.size("ids") > 1).collect()
    assert known.count() == 1004 and max(len(r["ids"]) for r in held) == 6
    got = {}
    for r in block_neighbours.search(vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    plain = {q: some for q, some in got.items() if q not in (50, 100)}
    data = {i: np.array(v) for i, v in found[:3000]}
    for q, some in plain.items():
        candidates = [(cosine(data[q], v), -i) for i, v in data.items() if i != q] + [(cosine(data[q], other), -50), (cosine(data[q], 2 * other), -50)]
        candidates += [(cosine(data[q], other), -100), (cosine(data[q], -other), -100)]
        want = sorted(candidates, reverse=True)[:5]
        assert [s for _, _, s in sorted(some)] == pytest.approx([s for s, _ in want], abs=1e-12)
        if q % 3:
            assert [i for _, i, _ in sorted(some)] == [i for i in range(1, 9) if i % 3 and i != q][:5]
    assert all(len(some) == 5 and all(i != q for _, i, _ in some) for q, some in got.items())


@given
def test_nearest_query(spark):
    check_nearest(queries.op9_nearest_neighbours(spark, SF_DIR).collect(), read(SF_DIR, "embeddings"))


def brute_links(data):
    usable = [r for r in {(r["vec_id"], str(r["embedding"]), r["label"]): r for r in data if good(r) and r["label"] is not None}.values()]
    parent = {r["vec_id"]: r["vec_id"] for r in data}
    count = dict.fromkeys(parent, 0)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(usable):
        for b in usable[k + 1 :]:
            same = a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]) and a["vec_id"] != b["vec_id"]
            if same and cosine(a["embedding"], b["embedding"]) >= 0.93:
                count[a["vec_id"]] += 1
                count[b["vec_id"]] += 1
                x, y = find(a["vec_id"]), find(b["vec_id"])
                parent[max(x, y)] = min(x, y)
    return sorted(((r["vec_id"], count[r["vec_id"]], find(r["vec_id"]), find(r["vec_id"]) == r["vec_id"]) for r in data), key=repr)


LINKS = ("vec_id", "n_links", "component_id", "kept")


def test_links_of_odd_vectors(spark, odd_vectors, monkeypatch):
    want = brute_links([r.asDict() for r in odd_vectors.collect()])
    assert rows(rotation_codes.near_vectors(odd_vectors), *LINKS) == want
    monkeypatch.setattr(rotation_codes, "GROUP", 16)  # many cells
    assert rows(rotation_codes.near_vectors(odd_vectors), *LINKS) == want
    assert rotation_codes.near_vectors(empty(spark, odd_vectors)).count() == 0


def test_estimates_are_unbiased_and_within_the_margin():
    rng = np.random.default_rng(6)
    dim, n = 64, 4000
    a = block_neighbours.unit(rng.standard_normal((n, dim)))
    side = rng.standard_normal((n, dim))
    side = block_neighbours.unit(side - np.einsum("ij,ij->i", side, a)[:, None] * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * side
    bits, factor = rotation_codes.encode(a)
    signs = 2.0 * np.unpackbits(bits, axis=1, count=dim) - 1
    estimate = np.einsum("ij,ij->i", signs, b @ rotation_codes.rotation(dim).T) / (np.sqrt(dim) * factor)
    assert abs(estimate.mean() - 0.93) < 0.005
    assert (np.abs(estimate - 0.93) <= rotation_codes.margin(factor, dim)).all()


@given
def test_links_query(spark):
    assert rows(queries.op10_embedding_near_dedup(spark, SF_DIR), *LINKS) == brute_links(read(SF_DIR, "embeddings"))


# --- 1 attributes


def tag_end(page, at):
    """Where the tag that begins at `at` ends, by the states of the HTML standard's tokeniser."""
    state, at = "tag name", at + 2
    while at < len(page):
        c, space = page[at], page[at] in "\t\n\f\r "
        at += 1
        if state == "double":
            state = "after value" if c == '"' else state
        elif state == "single":
            state = "after value" if c == "'" else state
        elif c == ">":
            return at
        elif state == "unquoted":
            state = "before name" if space else state
        elif state == "before value":
            state = state if space else {'"': "double", "'": "single"}.get(c, "unquoted")
        elif state == "after name" and c == "=" or state == "name" and c == "=":
            state = "before value"
        elif space:
            state = "after name" if state in ("name", "after name") else "before name"
        elif c == "/":
            state = "before name"
        elif state != "tag name":
            state = "name"
    return at


def test_tags_end_where_the_standard_says():
    rng = random.Random(8)
    for _ in range(20_000):
        page = "<p" + "".join(rng.choice("  ab=='\"/\t>") for _ in range(rng.randint(0, 14))) + rng.choice(["> text", ">", ""])
        assert wrapper_extract._TOKEN.match(page).end() == tag_end(page, 0), page


@pytest.mark.parametrize("attribute", ["title=Bob's", 'title="a"b"', "alt='5' tall'", '"', "'x", 'a"b=c', '="q"', "a=b'c\"d", "a = b\"", "x=\"a'b\" y='"])
def test_stray_quotes_lose_no_text(attribute):
    page = f"<article><p {attribute}>first</p><p>second</p></article>"
    if attribute.endswith("y='"):  # an open value runs to the next quote
        page = page.replace("second", "second's <b>third</b>")
        assert main_text(page, Rules({})) == "third"  # what follows the quote is a name and another
    else:
        assert main_text(page, Rules({})) == "first second"


def test_attributes_by_their_own_names():
    attributes = wrapper_extract.attributes_of(' data-id=ad CLASS="a b" class=ad title="id=footer" x=\'q"\'')
    assert attributes == {"data-id": "ad", "class": "a b", "title": "id=footer", "x": 'q"'}
