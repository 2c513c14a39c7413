"""Main text of pages, and repeated runs against a comparison of all windows."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from cohortlens.llm import pages

CASES = [
    ("<article><h1>T</h1><p>a<b>b</b> c&amp;d<br>e</article>", "T ab c&d e"),
    ("<nav>menu</nav><header>top</header><p>one</p><footer>end</footer>", "one"),
    ("<body><aside>side</aside><main><p>one</p><form>f<input></form><p>two</p></main><p>rest</p>", "one two"),
    ("<div class='ad'>buy</div><article><p>one<div class=\"comments\"><p>nice</p></div></article>", "one"),
    ("<article><p>one</p></article><section id=comments><article class='comment'>no</article></section>", "one"),
    ("<style>p{}</style><script>var t='</p><p>x';</script><p>a  \n b</p><!-- <p>c</p> -->", "a b"),
    ("<p>unclosed <b>bold<p>next", "unclosed bold next"),
    ("<p>1 &lt; 2 &#233;&#xe9;&copy; &unknown; a&nbsp;b</p>", "1 < 2 éé© &unknown; a b"),
    ("<article><p>x</p><div class='cookie-notice'>ok</div><ul><li>i<li>j</ul></article>", "x i j"),
    ("<p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><p>yes</p>", "yes"),
    ("<p title='a > b'>quoted</p><p title='open>broken</p>", "quoted broken"),
    ("a < b and 3 > 2", "a < b and 3 > 2"),
    ("<div class='has-sidebar'><p>whole page</p></div>", "whole page"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a b"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("<article></article>", ""),
    ("<article><header><h1>T</h1></header><p>x</p></article>", "T x"),
]


def test_pages_one_by_one():
    for page, text in CASES:
        assert pages.main_texts([page]) == [text], page


def naive(streams, run, least):
    places = {}
    for i, s in enumerate(streams):
        for at in range(len(s) - run + 1):
            places.setdefault(tuple(s[at:at + run]), []).append((i, at))
    masks = [np.zeros(len(s), bool) for s in streams]
    for found in places.values():
        if len({tuple(streams[i]) for i, _ in found}) >= least:
            for i, at in found:
                masks[i][at:at + run] = True
    return masks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=8), st.integers(1, 9), st.integers(2, 4))
def test_runs_equal_a_comparison_of_all_windows(streams, run, least):
    got = pages.repeated(streams, run, least)
    assert [m.tolist() for m in got] == [m.tolist() for m in naive(streams, run, least)]


def test_boilerplate_of_a_host_goes_and_unique_runs_stay():
    boiler = "this text stands on every single page of the host"
    made = [f"<div>{boiler}</div><div>u{i} text {i * 7} of page v{i}</div><div>{boiler} w{i} at last</div>" for i in range(5)]
    assert pages.main_texts(made) == [f"u{i} text {i * 7} of page v{i} w{i} at last" for i in range(5)]


def test_copies_are_no_boilerplate_and_articles_stay_whole():
    page = "<div>one two three four five six seven eight nine ten</div>"
    assert pages.main_texts([page] * 4) == ["one two three four five six seven eight nine ten"] * 4
    article = [f"<article>one two three four five six seven eight nine ten {i}</article>" for i in range(4)]
    assert pages.main_texts(article) == [f"one two three four five six seven eight nine ten {i}" for i in range(4)]


def test_outside_blocks_are_evidence_and_a_main_element_is_cleaned():
    note = "all rights of this site are reserved by its owners"
    marked = [f"<article>text {i}</article><footer>{note}</footer>" for i in range(3)]
    plain = f"<main><div>{note}</div><div>one two</div></main>"
    assert pages.main_texts([*marked, plain]) == ["text 0", "text 1", "text 2", "one two"]


def test_inline_advert_splits_no_word():
    assert pages.main_texts(["<p>one <span class='ad'>buy</span> two<b>three</b></p>"]) == ["one twothree"]


def test_query_rows(spark):
    random.seed(1)
    rows = [(i, f"https://h{i % 3}.org/{i}", f"<nav>n</nav><article>text {i}</article>", "x", "y") for i in range(40)]
    rows += [(1, "https://h1.org/1", "<article>text 1</article>", "x", "y"), (None, None, None, None, None), (50, "no url", "<p>a b</p>", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = pages.extracted(df, host_pages=5).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    assert by_id[7][0].text == "text 7" and by_id[7][0].n_chars == 6 and len(by_id[1]) == 2
    assert by_id[None][0].text == "" and by_id[None][0].url is None and by_id[50][0].text == "a b"
    assert pages.extracted(df.limit(0)).count() == 0


def test_whole_table_against_the_structure(spark):
    """Every page of the test table marks its article, so its text is that of its blocks."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    got = {r.page_id: r for r in pages.extracted(df).collect()}
    assert set(got) == set(html)
    import re
    from html import unescape
    for key, page in html.items():
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inner = re.sub(r"<(?:p|/p|br|h1|/h1)>", " ", inner)
        wanted = " ".join(unescape(re.sub(r"</?b>", "", inner)).split())
        assert got[key].text == wanted and got[key].n_chars == len(wanted)


def test_a_notice_on_few_pages_of_a_large_host(spark):
    """5,120 plain pages of one host, a ten-token notice on 20 of them: no group of pages has it often enough, the host has."""
    note = "this notice of ten tokens stands on very few pages"
    rows = [(i, f"https://big.org/{i}", f"<p>page {i} has words of its own number {i}</p>" + (f"<div>{note}</div>" if i % 256 == 7 else "")) for i in range(5120)]
    rows += [(9000 + i, f"https://small.org/{i}", f"<p>short {i}</p><div>{note}</div>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r.text for r in pages.extracted(df).collect()}
    assert len(got) == 5122 and not [k for k, t in got.items() if "notice" in t and k < 9000]
    assert all(got[i] == f"page {i} has words of its own number {i}" for i in range(5120))
    assert got[9000] == f"short 0 {note}", "two pages of a host do not make boilerplate"


def test_dealing_changes_nothing(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(random.choices(words, k=12)) for _ in range(8)]
    rows = []
    for i in range(90):
        body = "".join(f"<p>{x}</p>" for x in random.sample([*random.sample(shared, 2), " ".join(random.choices(words, k=20))], 3))
        rows.append((i, "https://h.org/x", f"<article>{body}</article>" if i % 4 == 0 else f"<main>{body}</main>" if i % 4 == 1 else body))
    rows += [rows[3]] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(str, pages.extracted(df, host_pages=1000).collect()))
    assert sorted(map(str, pages.extracted(df.repartition(5), host_pages=7).collect())) == whole
    assert pages.main_texts([r[2] for r in rows[:9]]) != [pages.main_texts([r[2]])[0] for r in rows[:9]], "there is something to remove"
