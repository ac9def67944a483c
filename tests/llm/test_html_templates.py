"""Main text of pages written from several templates; what is main text is known from the writing, not from rules."""
import random

import pytest

from shopfloor.llm import html_blocks

SENTENCES = [
    "It was the first snow of the year and all of us went out to see it from the hill.",
    "The village lies in a valley that was cut by a river on its way to the sea.",
    "We have been there with friends who are at home in the mountains and know the paths.",
    "In the morning the light is on the roofs, and by noon it has gone from the square.",
    "She had to wait for an hour at the station, but the train was not on the board."]
PITCHES = [
    "You will find that this is the best offer of the year and it is only here for you and for your friends.",
    "Join the thousands of readers who have been with us from the start and get all of the news in one letter."]


def prose(rng, n):
    return " ".join(rng.choice(SENTENCES) for _ in range(n))


def advert(rng, n):
    return "".join(f"<p>{' '.join(rng.choice(PITCHES) for _ in range(2))}</p>" for _ in range(n))


def cards(rng, n):
    return "".join(f"<article class='card'><h3>Snow {i}</h3><p>{prose(rng, 2)}</p></article>" for i in range(n))


NOISE = {
    "aside of cards": lambda r: f"<aside class='related'><h2>More</h2>{cards(r, 3)}</aside>",
    "footer article": lambda r: f"<footer><article><p>{prose(r, 2)}</p></article></footer>",
    "related div": lambda r: f"<div class='related'>{cards(r, 1)}</div>",
    "nav": lambda r: "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News of the day</a></li></ul></nav>",
    "long advert": lambda r: f"<div class='advertisement'>{advert(r, 4)}</div>",
    "newsletter form": lambda r: f"<form class='newsletter'>{advert(r, 3)}<input name=m><button>Go</button></form>",
    "consent": lambda r: f"<div id='cookie-consent'><p>{PITCHES[0]}</p></div>",
    "comments": lambda r: f"<section class='comments'><article><p>{prose(r, 3)}</p></article></section>",
}


def body(rng):
    """Blocks of an article and their texts: headings, paragraphs, a list with letters, a short aside of the author."""
    parts, texts = [], []

    def add(tag, text):
        parts.append(f"<{tag}>{text}</{tag}>")
        texts.append(text)

    add("h1", "On the snow")
    for k in range(rng.randint(3, 5)):
        add("p", prose(rng, rng.randint(1, 3)))
        if k == 1:
            add("h2", "The cases")
            parts.append("<ol>")
            for text in ("(a) first case", "(b) second case", "(c) third case"):
                add("li", text)
            parts.append("</ol>")
    add("p", prose(rng, 2))
    return parts, texts


WHOLES = ["<body>{before}<article>{body}</article>{after}</body>", "<body>{before}<main>{body}</main>{after}</body>",
          "<body>{before}<main><article>{body}</article>{after}</main></body>",
          "<body>{before}<div class='content'>{body}</div>{after}</body>",
          "<body><div class='layout has-sidebar'>{before}<section>{body}</section>{after}</div></body>"]


@pytest.mark.parametrize("whole", WHOLES)
@pytest.mark.parametrize("noise", sorted(NOISE))
def test_noise_before_and_after(whole, noise):
    for seed in range(5):
        rng = random.Random(seed)
        parts, texts = body(rng)
        page = whole.format(before=NOISE["nav"](rng), body="".join(parts), after=NOISE[noise](rng))
        assert html_blocks.main_text(page) == "\n".join(texts)


@pytest.mark.parametrize("whole", WHOLES)
@pytest.mark.parametrize("noise", ["aside of cards", "long advert", "newsletter form", "consent", "comments"])
def test_noise_inside_the_text(whole, noise):
    for seed in range(5):
        rng = random.Random(seed)
        parts, texts = body(rng)
        at = rng.randint(2, 4)
        page = whole.format(before=NOISE["nav"](rng), after="<footer>us</footer>",
                            body="".join([*parts[:at], NOISE[noise](rng), *parts[at:]]))
        assert html_blocks.main_text(page) == "\n".join(texts)


def test_an_advert_longer_than_the_article_and_copyright_lines():
    rng = random.Random(1)
    text = prose(rng, 2)
    page = f"<article><h1>Snow</h1><p>{text}</p><div class='ad-box'>{advert(rng, 6)}</div></article>"
    assert html_blocks.main_text(page) == f"Snow\n{text}"
    for line, kept in (("© 2024 The Valley", False), ("Copyright (c) 2024 us", False), ("(c) 2023 The Valley", False),
                       ("2024 © us", False), ("us 2024. All rights reserved.", False), ("(c) third case", True),
                       ("Copyright law", True), ("see case (c)", True)):
        page = f"<div><p>{text}</p><p>{text}</p><div>{line}</div></div>"
        assert html_blocks.main_text(page) == "\n".join([text, text, *[line] * kept]), line


def test_articles_named_after_their_readers_and_articles_in_forms():
    text = prose(random.Random(3), 4)
    for start, end in (("<article class='subscription'>", "</article>"), ("<form><article>", "</article></form>"),
                       ("<div class='widget'><article>", "</article></div>"), ("<main class=promo>", "</main>")):
        assert html_blocks.main_text(f"<nav><a href=a>Home</a></nav>{start}<p>{text}</p>{end}") == text
