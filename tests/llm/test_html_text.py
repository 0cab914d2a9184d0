import pytest

from driftlens.llm.html_blocks import blocks_of
from driftlens.llm.html_layouts import labelled_pages
from driftlens.llm.html_text import ChainModel, default_model, main_blocks, main_text, op2_html_text


def test_blocks_of_broken_markup():
    page = "<p>a <b>b<br><p>c&amp;d &#233; <i>e</i></p><ul><li>f<li> g\n h</ul><script>var x='<p>';</script><div>i<p>j</div>k<table><tr><td>l<td>m</table>"
    assert [b.text for b in blocks_of(page)] == ["a b", "c&d é e", "f", "g h", "i", "j", "k", "l", "m"]
    assert blocks_of(None) == blocks_of("") == blocks_of("<!-- <p>no</p> --><style>p{}</style>") == []


def test_unseen_layouts():
    model, right, total = default_model(), 0, 0
    for page, labels in labelled_pages(150, seed=77):
        got = model.decode([b.marks for b in blocks_of(page)])
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right >= 0.99 * total


def test_viterbi_finds_the_best_path():
    import itertools
    import random
    rng = random.Random(1)
    for _ in range(50):
        model = ChainModel()
        model.moves[:] = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        model.first[:] = [rng.uniform(-2, 2) for _ in range(2)]
        model.lean = {m: rng.uniform(-2, 2) for m in "abc"}
        marks = [[rng.choice("abc")] for _ in range(rng.randint(1, 7))]
        score = lambda path: model.first[path[0]] + sum(model.lean[m[0]] * s for m, s in zip(marks, path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=len(marks)), key=score)
        assert tuple(model.decode(marks)) == best


@pytest.mark.parametrize("page, text", [
    ("<body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title of it</h1><p>Some words, said  here.</p><div class=ad>Buy this now, please.</div>"
     "<p>More &lt;words&gt; here.</p></article><section class=comments><p>I liked this, thanks.</p></section><footer>&copy; x</footer>",
     "Title of it\n\nSome words, said here.\n\nMore <words> here."),
    ("<body><div class=menu><a href=x>A</a></div><div class=entry-content><p>Only this, nothing else.</p><p>And that.</p></div><div class=sidebar><p>See also, more.</p></div>"
     "<form><label>Name</label></form><div class=cookie-notice>We use cookies, as all do.</div>", "Only this, nothing else.\n\nAnd that."),
])
def test_pages(page, text):
    assert "\n\n".join(b.text for b in main_blocks(page, default_model())) == text


def test_awkward_rows(spark, tmp_path):
    long = "<article>" + "<p>word and word, again.</p>" * 5000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (3, "u", long), (None, "u", "<p"), (5, "u", "plain words"), (6, "u", "<article><p>ok then.</article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): r for r in op2_html_text(spark, str(tmp_path)).collect()}
    assert got[1, "u"].text == got[2, None].text == "" and got[1, "u"].n_chars == 0
    assert got[3, "u"].text == "\n\n".join(["word and word, again."] * 5000) and got[3, "u"].n_chars == len(got[3, "u"].text)
    clash = df.selectExpr("*", "'x' AS text", "1 AS n_chars")
    assert main_text(clash).columns == ["page_id", "url", "text", "n_chars"] and main_text(clash).count() == 7
    assert main_text(df.limit(0)).count() == 0
