import random

import pytest

from chronoview.llm import pages

SCHEMA = "page_id long, url string, html string, host string, path string, text string"


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(
                table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 4])
def test_common_lines_are_a_longest_subsequence(monkeypatch, bits):
    monkeypatch.setattr(pages, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(1500):
        a = [rng.choice("abcdx") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcdy") for _ in range(rng.randint(0, 14))]
        pairs = pages.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) == lcs_length(a, b)


def extract(spark, data):
    frame = spark.createDataFrame([(*r, "h", "p", "t") for r in data], SCHEMA)
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in pages.extract(frame).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style>
<script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></ul></nav>
<!-- ad --><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>One  <i>t</i>wo
three<br>four<p>x < y &eacute; &#8364;</p><form><p>ask</p></form><section class="user-comments">
<p>nice</p></section><div class="readable">last</div></article>
<aside>side</aside><footer>&copy; us</footer></body></html>"""


def test_article_without_its_frame(spark):
    got = extract(spark, [(1, "http://a.org/x/1", ARTICLE)])
    text = "A & B\n\nOne two three four\n\nx < y é €\n\nlast"
    assert got[1, "http://a.org/x/1"] == (text, len(text))


def plain(body):
    return (f"<html><body><div>Site name</div><div>Home</div>{body}"
            "<div>All rights</div><div>Contact</div></body></html>")


def test_lines_shared_with_the_nearest_page_go(spark):
    rng = random.Random(3)
    bodies = [[" ".join(f"w{rng.randrange(999)}" for _ in range(12)) for _ in range(4)]
              for _ in range(6)]
    data = [(i, f"http://h.org/a/{i}", plain("".join(f"<p>{x}</p>" for x in b)))
            for i, b in enumerate(bodies)]
    data += [(9, "http://other.org/a/1", plain("<p>alone on its host</p>"))]
    got = extract(spark, data)
    for i, body in enumerate(bodies):
        assert got[i, f"http://h.org/a/{i}"][0] == "\n\n".join(body)
    assert got[9, "http://other.org/a/1"][0].startswith("Site name\n\nHome\n\nalone")


def test_copies_do_not_delete_each_other(spark):
    page = plain("".join(f"<p>line {i} of a long article text</p>" for i in range(20)))
    got = extract(spark, [(1, "http://h/a", page), (2, "http://h/b", page)])
    assert all("line 7 of a long" in text for text, _ in got.values())


def test_passages_that_articles_share_stay(spark):
    def article(*lines):
        return "<article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    got = extract(spark, [(1, "http://h/a", article("first page own line here", "quoted", "x y z")),
                          (2, "http://h/b", article("second page own text", "quoted", "u v w"))])
    assert all("quoted" in text for text, _ in got.values())


def prose(rng, n=12):
    return " ".join(f"w{rng.randrange(999)}" for _ in range(n))


def test_lines_outside_an_article_are_differenced(spark):
    rng = random.Random(4)
    leads, bodies = [prose(rng) for _ in range(4)], [prose(rng) for _ in range(4)]
    got = extract(spark, [(i, f"http://h/{i}", plain(
        f"<div>{leads[i]}</div><article><p>Share this page</p><p>{bodies[i]}</p>"
        f"<p>quoted by all</p><p>{bodies[i]} end</p></article>")) for i in range(4)])
    for i in (1, 2):
        assert got[i, f"http://h/{i}"][0].split("\n\n") == [
            leads[i], bodies[i], "quoted by all", bodies[i] + " end"]
    # One neighbour alone does not tell an article's frame.
    assert got[0, "http://h/0"][0].split("\n\n")[:2] == [leads[0], "Share this page"]


def test_a_short_article_in_a_large_plain_frame(spark):
    rng = random.Random(5)
    frame = "".join(f"<div>menu entry {i} of this large site</div>" for i in range(60))
    bodies = [prose(rng) for _ in range(4)]
    got = extract(spark, [(i, f"http://h/{i}", f"{frame}<p>{b}</p><div>All rights</div>")
                          for i, b in enumerate(bodies)])
    assert [got[i, f"http://h/{i}"][0] for i in range(4)] == bodies


def test_copies_side_by_side_look_further(spark):
    rng = random.Random(6)
    body = [prose(rng) for _ in range(5)]
    edited = [*body[:4], body[4] + " edited"]
    other = prose(rng)
    data = [(i, f"http://h/a/{i}", plain("".join(f"<p>{x}</p>" for x in (
        edited if i == 2 else body)))) for i in range(5)]
    data.append((9, "http://h/b", plain(f"<p>{other}</p>")))
    got = extract(spark, data)
    for i in range(5):
        assert got[i, f"http://h/a/{i}"][0] == "\n\n".join(edited if i == 2 else body)
    assert got[9, "http://h/b"][0] == other


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_results_do_not_depend_on_the_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    rng = random.Random(7)
    bodies = [prose(rng) for _ in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = extract(spark, [(i, f"http://h/{i:02}", plain(f"<p>{b}</p>"))
                              for i, b in enumerate(bodies)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert [got[i, f"http://h/{i:02}"][0] for i in range(40)] == bodies


def test_awkward_pages(spark):
    long = "<article>" + "<p>par</p>" * 20000 + "</article>"
    data = [(1, None, None), (2, "", ""), (3, "not a url", "no markup &amp; all"), (None, None, "<p>x"),
            (4, "http://h/1", "<div><p>cut <b"), (5, "http://h/2", "<!-- never closed <p>a"),
            (6, "http://h/3", "<script>never closed"), (7, "http://h/4", long),
            (7, "http://h/5", long), (8, "http://h/6", "</div></p><p>a</p></article>")]
    got = extract(spark, data)
    assert len(got) == len(data)
    assert got[1, None] == ("", 0) and got[2, ""] == ("", 0)
    assert got[3, "not a url"][0] == "no markup & all"
    assert got[None, None] == ("x", 1) and got[4, "http://h/1"] == ("cut", 3)
    assert got[5, "http://h/2"] == ("", 0) and got[6, "http://h/3"] == ("", 0)
    assert got[7, "http://h/4"][0].count("par") == 20000
    assert got[8, "http://h/6"] == ("a", 1)


def test_repeated_rows_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "http://h/a", "<p>x</p>", "h", "p", "t")] * 3, SCHEMA)
    assert pages.extract(frame).count() == 3
    assert pages.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("parts", [1, 6])
def test_copies_over_several_parts_find_the_pages_beyond(spark, parts):
    """More copies in a row than a part sees beyond its ends still lose their frame."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    rng = random.Random(8)
    body, first, last, lone = prose(rng), prose(rng), prose(rng), prose(rng)
    data = [(i, f"http://h/b/{i:03}", plain(f"<p>{body}</p>")) for i in range(120)]
    data += [(500, "http://h/a", plain(f"<p>{first}</p>")), (501, "http://h/c", plain(f"<p>{last}</p>"))]
    data += [(600 + i, f"http://z/{i:03}", plain(f"<p>{lone}</p>")) for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = extract(spark, data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(got) == len(data)
    assert {got[i, f"http://h/b/{i:03}"][0] for i in range(120)} == {body}
    assert got[500, "http://h/a"][0] == first and got[501, "http://h/c"][0] == last
    whole = f"Site name\n\nHome\n\n{lone}\n\nAll rights\n\nContact"  # a host of copies only
    assert {got[600 + i, f"http://z/{i:03}"][0] for i in range(60)} == {whole}


def test_searches_that_a_bound_ends_are_unsure(monkeypatch):
    rng = random.Random(9)
    text = prose(rng)

    def page(i, body, host="h"):
        return pages.read_page(i, None, host, f"/{i}", plain(f"<p>{body}</p>"))

    def unsure(host, rows, cut=False):
        done = [x for row in rows for x in host.add(row)] + host.end(cut)
        return {p.page_id for p, _ in done if p.unsure}
    copies = [page(i, text) for i in range(4)]
    assert unsure(pages.Host(), copies) == set()
    assert unsure(pages.Host(), copies, cut=True) == {0, 1, 2, 3}
    assert unsure(pages.Host(cut=True), [page(9, prose(rng), "g"), *copies]) == {9}
    monkeypatch.setattr(pages, "WAITING_CHARS", 1)
    assert unsure(pages.Host(), copies) == {0, 1, 2, 3}
