"""Pages whose text is known by construction: marks, hidden parts and names inside lines, lookalikes of menus inside articles."""

import random

import pytest

from quillstream.llm.html_text import main_text

LONG = "This is a long paragraph of the article, with commas, and more than enough text to be the best container of the page."


@pytest.mark.parametrize(("page", "want"), [
    ('<p><span class="share">Share</span> The rest of this paragraph is text.</p>', 'The rest of this paragraph is text.'),
    ('<p>Visible words <span style="display:none">secret</span> end.</p>', 'Visible words end.'),
    (f'<article><p>{LONG}</p><p>Words <em class="ad">advert</em> after.</p></article>', f'{LONG}\n\nWords after.'),
    (f'<article><p>{LONG}</p><p title="is hidden now">Stays, of course.</p></article>', f'{LONG}\n\nStays, of course.'),
    (f'<article><p>{LONG}</p><section class="social-impact"><p>Impact text.</p></section></article>', f'{LONG}\n\nImpact text.'),
    (f'<article><p>{LONG}</p><p class="share-price">Price is 5.</p></article>', f'{LONG}\n\nPrice is 5.'),
    (f'<article><p>{LONG}</p><section id="related-work"><p>Related work text.</p></section></article>', f'{LONG}\n\nRelated work text.'),
    (f'<article><p>{LONG}</p><div class="menu"><p>Starter: a soup of the day, with bread, and a salad.</p><p>Main: fish with rice and greens.</p></div></article>', f'{LONG}\n\nStarter: a soup of the day, with bread, and a salad.\n\nMain: fish with rice and greens.'),
    (f'<article><p>{LONG}</p><aside><p>A note in the article that says something in a whole sentence, and more.</p></aside></article>', f'{LONG}\n\nA note in the article that says something in a whole sentence, and more.'),
    (f'<article><p>{LONG}</p><aside class="related"><ul><li><a href=x>One more story</a></li><li><a href=y>Another story here</a></li></ul></aside></article>', LONG),
    (f'<article><p>{LONG}</p><div class="share-buttons"><span>Share</span> <span>Tweet</span></div></article>', LONG),
    (f'<article><p>{LONG}</p></article><section class="comments"><article><p>Nice post, I like it, really, so much, and more, and more, and I tell you so.</p></article></section>', LONG),
    (f'<body><fieldset><p>{LONG}</p></fieldset></body>', LONG),
    (f'<nav><ul><li><a href=a>Home</a></li></ul><article><p>{LONG}</p></article>', LONG),
    (f'<nav><p>{LONG}</p>', LONG),
    (f'<article><p><label>Note</label> Text of it.</p><p>{LONG}</p></article>', f'Text of it.\n\n{LONG}'),
    (f'<article><p><a class="nav-link" href=x>Home</a> Text of it.</p><p>{LONG}</p></article>', f'Text of it.\n\n{LONG}'),
    (f'<article><p><span aria-hidden="true">*</span> Text of it.</p><p>{LONG}</p></article>', f'Text of it.\n\n{LONG}'),
    (f'<article><p>Before <button>Copy</button> after <svg><title>x</title><g><path d="m"/><text>icon</text></g></svg> it.</p><p>{LONG}</p></article>', f'Before after it.\n\n{LONG}'),
    (f'<article><p>One <script>var a="<p>";</script> line <style>p{{}}</style>here.</p><p>{LONG}</p></article>', f'One line here.\n\n{LONG}'),
    (f'<article><p>{LONG}</p><div class="newsletter-signup"><p>Sign up for our newsletter, with news, and more, every day of the week.</p></div></article>', LONG),
    (f'<article><p>{LONG}</p><div class="comments"><p>A reader says this and that, at some length, and ends it here.</p></div></article>', LONG),
])
def test_lines_and_lookalikes(page, want):
    assert main_text(page) == want


def made_page(rng):
    """A page and its text: every paragraph is made of words kept, in inline marks or bare, and of parts that don't belong to it."""
    word = lambda: "".join(rng.choice("abcdefghilmnorstuäé") for _ in range(rng.randrange(2, 9)))

    def line():
        shown, html = [], []
        for _ in range(rng.randrange(12, 60)):
            kind, w = rng.randrange(16), word()
            if kind < 9:
                html.append(w)
            elif kind == 9:
                html.append(f"<b>{w}</b>")
            elif kind == 10:
                html.append(f'<a href="/{w}" title="menu hidden">{w}</a>')
            elif kind == 11:
                html.append(f"<em><span class='x y'>{w}</span></em>")
            elif kind == 12:
                html.append(f"&lt;{w}&gt;<br/>")
                w = f"<{w}>"
            else:
                html.append(rng.choice([
                    f'<span style="display: none">{w}</span>', f"<button>{w}</button>", f'<span class="share">{w}</span>', f"<script>{w}</script>", f"<!-- {w} -->",
                    f'<i aria-hidden="true">{w}</i>', f"<span hidden>{w}</span>", f"<svg><g><text>{w}</text></g></svg>", f"<label>{w}</label>", f'<strong class="ad">{w}</strong>',
                ]))
                continue
            shown.append(w)
        return " ".join(html) + ".", (" ".join(shown) + (" ." if html[-1].endswith("<br/>") or not html[-1].endswith(shown[-1]) and "<" in html[-1] and kind > 12 else "."))

    blocks = [line() for _ in range(rng.randrange(3, 9))]
    tags = ["p", "section", "li", "blockquote", "h2"]
    body = "".join(f"<{t} class='{rng.choice(['', 'share-price', 'social-impact', 'lead'])}'>{h}</{t}>" for h, _ in blocks for t in [rng.choice(tags)])
    chrome = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>", "<div class='sidebar'><p>Side, bar.</p></div><footer>Foot.</footer>"
    return f"<html><body>{chrome[0]}<article>{body}</article>{chrome[1]}</body></html>", [text for _, text in blocks]


def test_made_pages():
    rng = random.Random(11)
    for _ in range(300):
        page, want = made_page(rng)
        assert [x.replace(" .", ".") for x in main_text(page).split("\n\n")] == [x.replace(" .", ".") for x in want]
