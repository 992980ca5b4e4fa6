"""License scans and main-text extraction on small planted texts."""

import pytest

from millrace.llm import extraction, licenses
from millrace.llm.extraction import Weights, extract

MIT_TEXT = licenses.TEMPLATES[4][1]


def scan(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)], "doc_id long, text string, lower string, found int").repartition(3)
    return {x.doc_id: x for x in licenses.scan(df, **more).collect()}


def test_phrases_and_places(spark):
    got = scan(spark, ["The MIT-License, and: mit license", None, "", "mitlicense license mit", "General\nPublic License apache license", "Émit license mit É license", "a " * 50_000 + "mit license"])
    assert [(x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for _, x in sorted(got.items())] == [
        (6, 2, 1, 4, "mit"), (0, 0, None, None, ""), (0, 0, None, None, ""), (3, 0, None, None, ""), (5, 2, 0, 3, "apache,gpl"), (5, 0, None, None, ""), (50_002, 1, 50_000, 50_000, "mit"),
    ]
    assert [x.score for _, x in sorted(got.items())] == [1, 0, 0, 0, 1, 0, 1]


def test_templates_by_containment(spark):
    words = MIT_TEXT.split()
    kept = list(dict.fromkeys(words))
    need = licenses.needed(len(kept))
    blocks = ["x\n" + MIT_TEXT.upper().replace(" ", ", ") + "\ny", " ".join(kept[-need:]), " ".join(kept[: need - 1]), " ".join(reversed(kept)) + " and more " * 50, "\n".join(kept)]
    got = scan(spark, blocks)
    assert [x.labels for _, x in sorted(got.items())] == ["mit", "mit", "", "mit", ""]
    assert got[1].score == pytest.approx(need / len(kept)) and all(x.base_labels == "" for x in got.values())


def test_wrapped_notices(spark):
    """Notices with line ends, as they stand in files; words that are strewn over paragraphs or far apart are none."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal"
    apache = " * you may not use this file except in compliance with the License.\r\n * You may obtain a copy of the License at\r\n *\r\n *     http://"
    short = "This text is released\nunder the\nMIT\nlicense"
    strewn = bsd.replace("\n", "\n//\n")
    far = "\n".join(x + " other words" * 40 for x in bsd.split("\n"))
    got = scan(spark, [f"A head\n\n{bsd}\n\nEnd", f"#!/bin/sh\n{mit}\n", apache, short, strewn, far, f"{'word ' * 5_000}\n{bsd}\n{'word ' * 5_000}"], phrases={})
    assert [x.labels for _, x in sorted(got.items())] == ["bsd", "mit", "apache", "mit", "", "", "bsd"]
    assert [x.score for _, x in sorted(got.items())] == [1, 1, 1, 1, 0, 0, 1]


def test_other_licenses_meet_no_template(spark):
    """A template is met where its own name stands, and within a window of a line."""
    others = ["Released under the BSD License", "released under\nthe BSD license", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0",
              "Licensed under the Mozilla Public License, Version 2.0", "This work is licensed under the GNU Free Documentation License, version 1.3"]
    own = ["Released under the MIT License", "released under MIT license", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0"]
    strewn = [(" x" * 500).join(MIT_TEXT.split()), f"{'x ' * 500}{MIT_TEXT}{' x' * 500}"]
    got = scan(spark, [*others, *own, *strewn], phrases={})
    assert [x.labels for _, x in sorted(got.items())] == [*[""] * 6, "mit", "mit", "cc-by-nc", "apache", "", "mit"]
    assert scan(spark, ["Released under the Apache License"])[0].labels == "apache"


def test_every_filter_is_exact(spark):
    """Against plain counting, with a template of every size and blocks around the threshold."""
    templates = [(f"t{m}", " ".join(f"k{j}" for j in range(m))) for m in range(1, 9)]
    texts = [" ".join(f"k{j}" for j in range(a, b)) + f" o{a}" * 3 for a in range(8) for b in range(a, 9)]
    got = scan(spark, texts, templates=templates, phrases={})
    for i, t in enumerate(texts):
        own = set(t.split())
        want = sorted(label for label, ws in licenses.template_words(templates) if 10 * len(own & set(ws)) >= 8 * len(ws))
        assert got[i].labels == ",".join(want), t
    assert scan(spark, [], templates=templates) == {} and scan(spark, ["mit license"], templates=[])[0].labels == "mit"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="with-sidebar">
<nav><ul><li><a href=/>Home page</a><li><a href=/b>Other page here</a></ul></nav><div class="cookie-notice">We use cookies on this site so accept them all now please</div>
<article><h1>Head &amp; line</h1><p>First  paragraph with <b>bold</b> words
and&nbsp;a line that goes on for long enough.<p>Second &lt;paragraph&gt; that was never closed but has many words too.
<div class="ad">Buy this thing now, it is cheap and good for you and all of your friends</div>
<form><input value=x>Your mail address here please</form><ul><li>one item of the list</li><li>another item of the list</li></ul>
<p>Last words of the text, of which there are some.</p></article>
<section class="comments"><h2>Comments</h2><p>I disagree with all that was said in the text above, by a reader.</p></section>
<aside>Related stories that you may like to read</aside><footer>&copy; somebody, all rights reserved for ever and a day</footer></body></html>"""
TEXT = """Head & line
First paragraph with bold words and a line that goes on for long enough.
Second <paragraph> that was never closed but has many words too.
one item of the list
another item of the list
Last words of the text, of which there are some."""


def test_extraction(spark):
    odd = [PAGE, None, "", "plain words without any markup", "<nav>only a menu</nav>", "<p>" * 3000 + "deep", "<p>cut <b", "< > <!-- open", "<script>never closed", PAGE.replace("article", "div")]
    df = spark.createDataFrame([(i, h, "text") for i, h in enumerate(odd * 3)], "page_id long, html string, __text string").repartition(3)
    weights = extraction.learn(df)
    assert weights.of["w"] > 0 > weights.of["nav"] and all(v < 0 for k, v in weights.of.items() if not k.startswith("w"))
    got = {x.page_id: x.main_text for x in extraction.extract_text(df, weights).collect()}
    assert len(got) == 30 and got[0] == TEXT == got[9]
    assert (got[1], got[2], got[3], got[4], got[5], got[6], got[8]) == ("", "", "plain words without any markup", "", "deep", "cut", "")
    assert extraction.extract_text(df.limit(0), weights).count() == 0
    unlabelled = extraction.learn(df.where("page_id % 10 between 1 and 4"))
    assert unlabelled.of == {} and extract(PAGE, unlabelled) == TEXT


def test_nothing_of_an_article_is_dropped(spark):
    """With the weights of the given pages, where lists and links stand in walls only."""
    weights = extraction.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    intro = "<h1>A head</h1><p>Short first paragraph.</p>"
    body = "<p>" + "and many more words of the text " * 8 + "</p>"
    box = '<nav><ul>' + '<li><a href="/x">Elsewhere on this site</a></li>' * 20 + "</ul></nav>"
    inside = [
        intro + body + "<ul><li>one</li><li>two</li></ul>",
        intro + body + "<table><tr><td>1</td><td>2</td></tr></table>",
        intro + '<p><a href="/a">Link</a></p>' * 30 + "<p>End.</p>",
        intro + box + body,
        intro + box.replace("nav>", "div>").replace("<div>", '<div class="related">') + body + "<p>End.</p>",
    ]
    for html in inside:
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{box}<article>{html}</article><footer>{box}&copy; all</footer></body></html>"
        parts = extraction.parse(page)
        assert extract(page, weights) == extraction.blocks_text([p for p in parts if p.inside]), html


def test_region_is_the_best_run():
    """The scan against all runs."""
    import random

    r = random.Random(3)
    for _ in range(200):
        parts = [extraction.Part("w", r.randint(1, 4), "x") if r.random() < 0.5 else extraction.Part(r.choice(["p", "div"])) for _ in range(r.randint(0, 15))]
        w = Weights({"w": 1.0, "p": -1.0, "div": -3.0})
        sums = [sum(w.score(p) for p in parts[a:b]) for a in range(len(parts)) for b in range(a, len(parts) + 1)]
        a, b = extraction.region(parts, w)
        assert sum(w.score(p) for p in parts[a:b]) == max([0.0, *sums])


def test_deep_pages_take_time_in_proportion():
    import time

    begin = time.process_time()
    parts = extraction.parse("<div>" * 16_000 + "text" + "</span></div>" * 16_000)
    assert time.process_time() - begin < 2 and sum(p.words for p in parts) == 1


def test_article_text_under_names_that_sound_like_something_else():
    page = (
        "<body><header><h1>Site</h1></header><p class='market-share'>Site chart.</p><article><header><h1>A title</h1></header>"
        "<p class='market-share'>Shares rose.</p><p class='ad'>Buy now!</p><h2 id='search'>How to search</h2><div class='ad-box'>Buy more!</div></article></body>"
    )
    assert extraction.blocks_text(extraction.parse(page)) == "A title\nShares rose.\nHow to search"


def test_quotes_that_are_never_closed():
    text = lambda page: extraction.blocks_text(extraction.parse(page))
    assert text('<p>a <a href="x>text</a> b</p>') == "a text b"
    assert text("<p>it's <i>d</i> \"e\"</p><p class='q>f</p>") == 'it\'s d "e"\nf'
    assert text("<p>1 < 2 <b>c</b><a href='x") == "1 < 2 c"
