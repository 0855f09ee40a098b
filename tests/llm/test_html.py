import time

import pytest

from rolewise.llm.html_text import main_text

TEXT = "This is a paragraph, with commas, that is surely long enough to be the text of an article."


def test_article_keeps_captions_link_lists_and_sections_with_telling_names():
    html = f"""<body><div class="main-menu"><ul><li><a href="/">Home page</a></li></ul></div><article><h1>Title</h1><p>{TEXT}</p><figure><img src="x"><figcaption>A caption</figcaption></figure>
<section id="related-work"><h2>Related work</h2><p>{TEXT}</p></section><div id="ad-hoc-queries"><p>Ad hoc</p></div><section id="login"><p>How to log in</p></section>
<div class="ad">Buy now</div><div id="comments"><p>First, he said</p></div><div class="share-buttons"><a href="/s">Send it</a></div><nav><a href="/n">Next</a></nav>
<h2>References</h2><ul><li><a href="/1">First reference</a></li><li><a href="/2">Second reference</a></li></ul></article><footer>us</footer></body>"""
    assert main_text(html).split("\n\n") == ["Title", TEXT, "A caption", "Related work", TEXT, "Ad hoc", "How to log in", "References", "First reference", "Second reference"]


def test_menus_of_a_page_without_containers_go():
    assert main_text(f"<body><ul><li><a href='/'>Home page</a></li></ul><div class='left-sidebar'>Aside</div><p>{TEXT}</p></body>") == TEXT


@pytest.mark.parametrize("name", ["social-issues", "share-price-story", "ad-free", "menu-of-the-day", "layout-sidebar", "article-notice", "menu", "promo"])
def test_an_article_is_not_lost_to_a_name(name):
    html = f"<body><div class='{name}'><h1>Title</h1><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><div>Another block of thirty-eight letters</div></body>"
    assert main_text(html) == "\n\n".join(["Title", TEXT, TEXT, TEXT])


def test_a_form_around_a_page_and_comments_longer_than_the_article():
    comments = f"<div class='comment'><p>{TEXT}</p></div>" * 9
    html = f"<body><form><input name=a><div class='content'><h1>Title</h1><p>{TEXT}</p></div><div id='comments'>{comments}</div><button>Send</button></form></body>"
    assert main_text(html) == f"Title\n\n{TEXT}"
    assert main_text(f"<body><div><p>{TEXT}</p><p>{TEXT}</p></div><form><p>Your name, please, and your address as well, if you want to</p></form></body>") == f"{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("many", ["</div>", "</p>", "</x-y>", "<header>", "<div>", "<span>", "<x-y>", "<span><hr>a", "<p>a", "<li>a", "<table><tr><td>a", "<a href=x>b"])
def test_pages_take_linear_time(many):
    began = time.perf_counter()
    text = main_text("<p><div><span>" * 100 + many * 50_000 + f"<div><p>{TEXT}</p></div>")
    assert text is not None and time.perf_counter() - began < 4


@pytest.mark.parametrize("around", ["div id='main'", "article", "div class='post-body'"])
def test_what_is_no_article_within_one_goes(around):
    odd = "".join(f"<div {name}><p>Some words of this part, which is no article, and no more of it than that</p></div>" for name in (
        "class='notice'", "class='ad-wrapper'", "class='user-comments'", "class='cookie'", "class='alert alert-info'", "class='newsletter-box'", "id='menu'", "class='box notice-box'", "class='commentsBlock comments'", "class='topMenu'",
    ))
    end = around.split()[0]
    html = f"<body><{around}><h1>Title</h1><p>{TEXT}</p>{odd}<p>{TEXT}</p><div class='no-ads'><p>Ours</p></div></{end}></body>"
    assert main_text(html) == f"Title\n\n{TEXT}\n\n{TEXT}\n\nOurs"


def test_comments_longer_than_the_article_go_by_any_name_that_ends_so():
    comments = f"<div class='item'><p>{TEXT}</p></div>" * 9
    assert main_text(f"<body><article><p>{TEXT}</p><section class='user-comments'>{comments}</section></article></body>") == TEXT


def test_a_large_part_is_the_articles_own_whatever_its_name():
    html = f"<body><article><p>{TEXT}</p><div class='menu-of-today'><p>{TEXT}</p><p>{TEXT}</p></div></article></body>"
    assert main_text(html) == "\n\n".join([TEXT] * 3)


def test_short_paragraphs_beside_the_best_part_stay():
    html = f"<body><div id='wrap'><div><p>In short.</p></div><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><div><p>The end.</p></div><div class='footer'><p>Us</p></div><div><a href='/'>Home page of ours</a></div></div></body>"
    assert main_text(html) == "\n\n".join(["In short.", TEXT, TEXT, TEXT, "The end."])


def plain_score(html):
    """The container by points: each paragraph's to its parent, half of them to that one's, less by the share of links."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(html)
    up = {child: node for node in root.iter() for child in node}
    points, text = {}, lambda e: " ".join("".join(e.itertext()).split())
    for p in root.iter("p"):
        worth = 1 + text(p).count(",") + min(len(text(p)) / 100, 3) if len(text(p)) >= 25 else 0
        links = sum(len(text(a)) for a in p.iter("a")) / max(len(text(p)), 1)
        node, share = up.get(p), 1
        for share in (1, 2, 6, 9, 12):
            if node is None:
                break
            points[node] = points.get(node, 0) + worth * (1 - links) / share
            node = up.get(node)
    return max(points, key=points.get)


def test_the_best_container_is_that_of_a_plain_scoring():
    import random

    rng = random.Random(6)
    for _ in range(40):
        areas = []
        for k in range(rng.randrange(2, 5)):
            words = [" ".join(rng.choice(["one", "two,", "three", "four", "five,"]) + str(k) for _ in range(rng.randrange(8, 30))) for _ in range(rng.randrange(1, 9) if k else 9)]
            areas.append("".join(f"<p>{w}</p>" if rng.random() < 0.9 or not k else f"<p><a href='/'>{w}</a></p>" for w in words))
        rng.shuffle(areas)
        html = "<html><body>" + "".join(f"<div><div>{a}</div></div>" for a in areas) + "</body></html>"
        best = plain_score(html)
        wanted = [" ".join("".join(p.itertext()).split()) for p in best.iter("p")]
        got = main_text(html).split("\n\n")
        assert all(w in got for w in wanted), (wanted, got)
