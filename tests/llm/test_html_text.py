import random

import pytest

from quire.llm import html_text as m

LONG = "Some long paragraph with many words in it that tells a story about nothing much at all"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>Head</h1><p>One <b>tw</b>o&amp;three<br>four</p><p>x</p></article>", "Head\n\nOne two&three four\n\nx"),
        (f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article><p>{LONG}</p></article><footer>&copy; x</footer>", LONG),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p><aside><p>{LONG}</p></aside></main>", LONG),
        (f"<body><div class='post-content'><p>{LONG}</p></div><section id=comments><p>{LONG}</p></section><div class='cookie-banner'>{LONG}</div><form>{LONG}</form></body>", LONG),
        (f"<article><div class='ad'>{LONG}</div><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", LONG),
        (f"<article><script>var a = '<p>{LONG}</p>';</script><style>p {{}}</style><!-- <p>{LONG}</p> --><p>ok", "ok"),
        (f"<article><p>{LONG}<p><b>{LONG}<br><p>{LONG}</article>", f"{LONG}\n\n{LONG}\n\n{LONG}"),
        ("<article><p>a &lt;b&gt; &#233;&eacute; &am x</p></article>", "a <b> éé &am x"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        (f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div><div>{LONG} {LONG}</div>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><p>cut off <a href='x", f"{LONG}\n\ncut off"),
        ("<article><p> \n\t&nbsp; </p></article>", ""),
        (f"<head><title>t</title><body><article><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><button>Share it</button><p>a <a title=\"x>b</a></p></article>", f"{LONG}\n\na b"),
    ],
)
def test_pages(page, want):
    assert m.main_text(page) == want


PARAGRAPHS = [f"{LONG} {LONG} {LONG} {LONG} {n}" for n in range(5)]


@pytest.mark.parametrize("open_, close", [
    ("<div class='has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"), ("<div class='layout-with-banner'>", "</div>"), ("<div class='sidebar-layout'>", "</div>"),
    ("<form id=aspnetForm>", "</form>"), ("<div class=page-header-form>", "</div>"), ("<div id='siteHeader'>", "</div>"),
])
def test_article_inside_a_marked_layout_is_kept(open_, close):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<body>{open_}<nav><a href=/>Home</a></nav><article>{body}</article><footer>{LONG}</footer>{close}</body>"
    assert m.main_text(page) == "\n\n".join(PARAGRAPHS)


def test_density_overrules_a_doubtful_mark_only():
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert PARAGRAPHS[2] in m.main_text(f"<div class=banner>{body}</div>")
    assert m.main_text(f"<form>{body}</form><p>{LONG}</p>").startswith(PARAGRAPHS[0])
    for hard in ("<div class=comments>", "<div hidden>", "<aside>", "<div class=sidebar>"):
        assert m.main_text(f"{hard}{body}</div>") == ""
    assert m.main_text(f"<div hidden><article>{body}</article></div>") == ""


def test_link_list_inside_an_article_is_dropped():
    links = "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(6))
    assert m.main_text(f"<article><p>{PARAGRAPHS[0]}</p><ul>{links}</ul><p>{PARAGRAPHS[1]}</p></article>").split("\n\n")[:1] == PARAGRAPHS[:1]
    got = m.main_text(f"<article><p>{PARAGRAPHS[0]}</p><ul>{links}</ul><p>{PARAGRAPHS[1]}</p></article>")
    assert all(f"Other page {i}" not in got for i in range(1, 5)) and PARAGRAPHS[1] in got


@pytest.mark.parametrize("name", ["cookie-text", "footer-content", "sidebar-main", "ad-body", "newsletter-text", "share-text", "comment-body", "related-story"])
def test_any_sure_word_of_a_name_decides(name):
    body = f"<p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p>"
    assert m.main_text(f"<article><p>{PARAGRAPHS[2]}</p><div class={name}>{body}</div></article>") == PARAGRAPHS[2]
    assert m.main_text(f"<div class={name}>{body}</div>") == ""


@pytest.mark.parametrize("name", ["post type-post category-social", "post tag-legal", "hentry post-format-aside", "article hidden-mobile", "article ad-free", "post tag-newsletter category-ads"])
def test_articles_are_kept_whatever_their_kind(name):
    assert m.main_text(f"<article class='{name}'><p>{LONG}</p></article>") == LONG
    assert m.main_text(f"<nav>Menu</nav><main class='{name}'><p>{LONG}</p></main>") == LONG


@pytest.mark.parametrize("name", ["social-policy", "cookie-recipes", "legal-news"])
def test_long_text_outvotes_a_word_beside_others(name):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3])
    assert m.main_text(f"<ul><li><a href=/>Home</a></li></ul><div class='{name}'>{body}</div>") == "\n\n".join(PARAGRAPHS[:3])
    assert m.main_text(f"<article><p>{LONG}</p></article><div class='{name}'><a href=/>Three linked words</a></div>") == LONG


def test_random_names_around_articles():
    """Class words drawn at random on an article's tag never lose its text, and reader comments never enter it."""
    rng = random.Random(8)
    vocabulary = sorted(m.BOILERPLATE_WORDS - m.COMMENT_WORDS)
    for _ in range(300):
        name = " ".join(f"{rng.choice(['category', 'tag', 'post', 'type', 'format'])}-{rng.choice(vocabulary)}" for _ in range(rng.randint(1, 3)))
        comments = f"<div class='{rng.choice(['comment', 'comments-list', 'comment-7', 'reply'])}'><p>{PARAGRAPHS[0]}</p></div>"
        assert m.main_text(f"<nav><a href=/>x</a></nav><article class='{name}'><p>{LONG}</p>{comments}</article>") == LONG


def test_comments_formulas_and_page_classes():
    assert m.main_text(f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG} {LONG}</p></article>") == LONG
    assert m.main_text("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> here.</p></article>") == "Energy is E=mc2 here."
    assert m.main_text(f"<body class='single has-sidebar comments-open'><article class='post comments-open'><p>{LONG}</p></article></body>") == LONG
    assert m.main_text(f"<div class='main sidebar-left'><p>{LONG} {LONG}</p></div>") == f"{LONG} {LONG}"


def test_pages_without_names_are_read_by_words_and_links():
    short = ["A short opening line here", "Another short one follows it now", "And a last one to end"]
    assert m.main_text("<div class=post>" + "".join(f"<p>{x}</p>" for x in short) + "</div>") == "\n\n".join(short)
    assert m.main_text("<h1>Title of it</h1>" + "".join(f"<p>{x}</p>" for x in short)) == "\n\n".join(["Title of it", *short])
    links = "".join(f"<div><a href=/{i}>Menu {i}</a></div>" for i in range(5))
    assert m.main_text(f"{links}<div>{PARAGRAPHS[0]}</div><div>{PARAGRAPHS[1]}</div>{links}") == "\n\n".join(PARAGRAPHS[:2])


def _used(node):
    return {m.FEATURES[node[0]]} | _used(node[2]) | _used(node[3]) if isinstance(node, tuple) else set()


def test_tree_fits_its_table_and_uses_neighbours():
    assert all(m.classify(m.tree(), tuple(r[:-1])) == bool(r[-1]) for r in m.LABELLED)
    assert {"words", "link_density", "words_before", "link_density_before", "words_after"} <= _used(m.tree())


def test_held_out_blocks_without_names():
    """Pages of another make: precision and recall by density and neighbours alone."""
    rng = random.Random(5)
    right = kept = wanted = 0
    for _ in range(200):
        body = [" ".join(["word"] * rng.choice([8, 15, 30, 60, 120])) for _ in range(rng.randint(3, 9))]
        menu = [f"<li><a href=/>{' '.join(['menu'] * rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(3, 8))]
        got = m.main_text(f"<ul>{''.join(menu)}</ul>{''.join(f'<p>{x}</p>' for x in body)}<ul>{''.join(menu)}</ul>").split("\n\n")
        right += sum(x.startswith("word") for x in got)
        kept += len(got)
        wanted += len(body)
    assert right >= 0.9 * kept and right >= 0.9 * wanted


def test_long_pages_are_read_whole():
    paragraphs = [f"{LONG} number {i}" for i in range(5000)]
    assert m.main_text("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>") == "\n\n".join(paragraphs)


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t", 1), (1, "u", None, "t", 1), (None, None, "<p>", "t", 1)]
    got = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert sorted((r.n_chars, r.text) for r in got) == [(0, ""), (0, ""), (len(LONG), LONG)]
    assert m.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
