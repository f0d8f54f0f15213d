"""Pages whose article no name gives away, and texts made to be slow."""

import time

import numpy as np
import pytest

from logloom.llm import decontamination, html_text, toxicity

LEAD = "A bridge is opened"
TEXTS = ["Engineers tested the new bridge over the river on Monday, and found that the cables held more weight than planned, the city said.",
         "Work began in spring. The first pillars were set in deep water, which took longer than thought.", "Traffic will open in the autumn, after the last checks."]
BODY = f"<h1>{LEAD}</h1>" + "".join(f"<p>{t}</p>" for t in TEXTS)
AROUND = {
    "div": "<div>{}</div>", "bare": "{}", "two": "<div><div>{}</div></div>", "wrap": '<div class="wrap">{}</div>', "section": "<section>{}</section>", "cell": "<table><tr><td>{}</td></tr></table>", "id": '<div id="b1">{}</div>'}
BESIDE = {
    "alone": "{}", "menu": "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>{}", "foot": "{}<footer>&copy; 2024 The Paper</footer>",
    "both": '<header><div class="logo">The Paper</div></header>{}<div class="footer"><a href=x>Terms</a></div>',
    "side": '<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>{}<div class="comments"><p>Nice text!</p></div>'}


@pytest.fixture(scope="module")
def fitted():
    return html_text.model()


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("beside", BESIDE)
def test_articles_without_a_name(fitted, around, beside):
    page = f"<html><head><title>x</title></head><body>{BESIDE[beside].format(AROUND[around].format(BODY))}</body></html>"
    assert html_text.extract_texts([page], fitted)[0] == "\n".join([LEAD, *TEXTS])


def test_short_pages_without_a_name(fitted):
    pages = ["<body><div><h1>Title</h1><p>One two three four five six seven eight.</p><p>More words here, and so on.</p></div></body>", "<body><p>One two three four five.</p><p>Six seven.</p></body>",
             "<body><div>" + "".join(f"<p>{t}</p>" for t in TEXTS * 2) + "</div></body>"]
    assert html_text.extract_texts(pages, fitted) == ["Title\nOne two three four five six seven eight.\nMore words here, and so on.", "One two three four five.\nSix seven.", "\n".join(TEXTS * 2)]


def test_names_inside_an_article_and_unclosed_pictures(fitted):
    inside = f'<body><article>{BODY}<section class="trending-section"><p>{TEXTS[0]}</p><p>{TEXTS[1]}</p></section><p>{TEXTS[2]}</p></article></body>'
    open_svg = f"<body><article>{BODY}<svg><path d=x><p>{TEXTS[1]}</p></article></body>"
    assert html_text.extract_texts([inside, open_svg], fitted) == ["\n".join([LEAD, *TEXTS, *TEXTS]), "\n".join([LEAD, *TEXTS, TEXTS[1]])]
    assert html_text.Page("<p>a</p><script>never closed <p>b</p>").pieces == html_text.Page("<p>a</p>").pieces


def seconds(work, n):
    began = time.process_time()
    work(n)
    return time.process_time() - began


@pytest.mark.parametrize("page", ["<div>{}</x>", "<x>", "<svg>", "<p><li>", "<ul><li></li>", "<td></li>", "<table></div>"])
def test_pages_take_time_in_proportion(fitted, page):
    """Eight times the page takes less than 24 times the time, at most; walking all open elements would take 64."""
    parts = page.split("{}")
    work = lambda n: html_text.Page("".join(p * n for p in parts))
    small = max(min(seconds(work, 2_000) for _ in range(3)), 0.01)
    assert seconds(work, 16_000) < 24 * small


@pytest.mark.parametrize("gap", [60, 100])
def test_segments_take_time_in_proportion(gap):
    work = lambda n: toxicity.segments([(i * gap, 5.0) for i in range(n)], toxicity.DRIFT)
    small = max(min(seconds(work, 4_000) for _ in range(3)), 0.005)
    assert seconds(work, 64_000) < 48 * small


def least_edits(item, doc):
    """Least edits of the whole item to a part of the document, all cells."""
    row = [0] * (len(doc) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(doc):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_items_that_repeat_themselves_against_all_cells():
    draw = np.random.default_rng(11)
    for n in range(60):
        piece = "".join(draw.choice(list("ab-"), int(draw.integers(1, 5)))) or "-"
        item = decontamination.normal("q" + piece * int(60 / len(piece)) + "".join(draw.choice(list("abcdef"), 40)) + piece * 3 + "x")
        own = list(item)
        for _ in range(int(draw.integers(0, 6))):
            at = int(draw.integers(len(own)))
            own[at:at + int(draw.integers(0, 2))] = "z" * int(draw.integers(0, 2))
        doc = decontamination.normal(piece * 30 + "".join(own) + piece * int(draw.integers(0, 40)))
        index, least = decontamination.build([(1, item), (2, "another item, " + piece * 30)]), least_edits(item, doc)
        got = {h["item_id"]: h for h in decontamination.find(doc, index)}
        assert (got[1]["edits"] if 1 in got else None) == (least if least <= index["budget"][0] else None)
        assert 1 not in got or least_edits(item, doc[got[1]["begin"]:got[1]["end"]]) == least


def test_stretches_lose_no_match(monkeypatch):
    monkeypatch.setattr(decontamination, "PAIRS", 50)
    monkeypatch.setattr(decontamination, "PIECE", 16)
    items = [(i, " ".join(f"word{(i * 7 + j * j) % 50}" for j in range(25))) for i in range(8)]
    text = " and then ".join(t[:90] + "!" + t[91:] for _, t in items) + "-" * 500 + items[3][1]
    got = sorted((h["item_id"], h["edits"]) for h in decontamination.find(text, decontamination.build(items)))
    assert got == [(i, int(i != 3)) for i, _ in items]


def test_rules_of_hyphens_take_time_by_their_length():
    words = "the answer of the question stands between two rules of marks that are long, and it is not found elsewhere in any text"
    index = decontamination.build([(1, "-" * 100 + words), (2, words + "=" * 50 + words[::-1]), (3, "-" * 80)])
    began = time.time()
    assert [h["item_id"] for h in decontamination.find("-" * 1_000_000, index)] == [3]
    assert time.time() - began < 10
    hits = decontamination.find("-" * 300_000 + words + "=" * 300_000, index)
    assert sorted((h["item_id"], h["edits"]) for h in hits) == [(1, 0), (3, 0)]
