"""HTML extraction: the reading of blocks, held-out accuracy of the CRF, odd pages."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgermill.llm import html_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(rng, semantic=True):
    """A page with menus, header, adverts, sidebar, notices, comments, forms; and its main text."""
    body = [sentence(rng, rng.randint(8, 30)) for _ in range(rng.randint(2, 6))]
    title = sentence(rng, 4)
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 5))
    comments = "".join(f"<div class='comment'><p>{sentence(rng, 6)}</p></div>" for _ in range(rng.randint(0, 3)))
    paragraphs = "".join(f"<p>{p}</p>" for p in body)
    box = ("article", "article") if semantic else ('div class="post-body"', "div")
    html = (
        f"<html><head><title>{title}</title><style>p{{x:1}}</style><script>var a='<p>no</p>';</script></head><body>"
        f"<header><div class='logo'>{sentence(rng, 2)}</div></header><nav><ul>{nav}</ul></nav>"
        f"<div class='ad'>{sentence(rng, 5)}</div><div class='cookie-notice'>{sentence(rng, 7)}</div>"
        f"<{box[0]}><h1>{title}</h1>{paragraphs}<section class='comments'>{comments}</section></{box[1]}>"
        f"<aside class='sidebar'><p>{sentence(rng, 9)}</p></aside><form><label>{sentence(rng, 2)}</label></form>"
        f"<footer>&copy; {sentence(rng, 3)}</footer></body></html>"
    )
    return html, " ".join([title, *body])


def test_blocks_read_text_as_written():
    html = "<p>a&amp;b &lt;c&gt;\n\t  d<br>e<b>f</b></p><script>x</script><!-- hidden --><div>  é&#233;&nbsp;z </div>"
    assert [b[0] for b in html_text.blocks(html)] == ["a&b <c> d ef", "éé\xa0z"]
    assert html_text.blocks(None) == [] and html_text.blocks("") == [] and html_text.blocks("   ") == []
    assert [b[0] for b in html_text.blocks("<html><head><title>t</title><body><p>x</p>")] == ["x"]


def test_held_out_accuracy():
    rng = random.Random(2)
    pages = [page(rng) for _ in range(120)]
    data = [(html_text.features(b), [html_text.gold(x) for x in b]) for b in (html_text.blocks(h) for h, _ in pages)]
    model = html_text.fit(data[:80])
    right = total = 0
    for feats, labels in data[80:]:
        E = np.array([model["W"][f].sum(0) for f in feats])
        right += int((html_text.viterbi(E, model["T"], model["S"]) == np.array(labels)).sum())
        total += len(labels)
    assert right / total >= 0.97
    for html, text in pages[80:90]:
        assert html_text.main_text(html, model) == text
    # Without article markup only the blocks' own features are left: 13 of these 20 pages come out
    # exactly (measured); where every div of the training pages was boilerplate, a div-only
    # article is missed.
    plain = [page(rng, semantic=False) for _ in range(20)]
    found = sum(html_text.main_text(h, model) == t for h, t in plain)
    assert found >= 10


def test_extract_odd_pages(spark):
    rng = random.Random(4)
    pages = [page(rng) for _ in range(60)]
    long_body = " ".join(["word"] * 200_000) + "."
    rows = [(k, f"http://h/{k}", h) for k, (h, _) in enumerate(pages)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", pages[1][0].replace("</h1>", "</h1><p>" + long_body + "</p>")), rows[0], (103, "u", "<<<>>>&&")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert out[100]["text"] == "" and out[100]["n_chars"] == 0 and out[101]["text"] == ""
    title, _, rest = pages[1][1].partition(". ")
    assert out[102]["text"] == f"{title}. {long_body} {rest}"
    assert out[0]["text"] == pages[0][1]
    assert spark.createDataFrame([], "page_id long, url string, html string").transform(html_text.extract).count() == 0
