"""HTML extraction: the line-block method against brute force, marks as a prior, hostile pages."""

import random
import time

import pytest

from tests.conftest import DATA
from tidewell.llm import html_extraction as H


def _plain_lines(weights):
    """Lines in a region, straight from the definition: in a window that reaches the dive and is joined to one that surges."""
    n = len(weights)
    windows = [tuple(range(i, i + H.WINDOW)) for i in range(n - H.WINDOW + 1)] or [tuple(range(n))]
    sums = {w: sum(weights[k] for k in w) for w in windows}
    high = max(sums.values())
    runs, run = [], []
    for w in windows:
        if high and sums[w] >= min(H.DIVE, high / 2):
            run.append(w)
        elif run:
            runs.append(run)
            run = []
    out, seen = [], -1
    for run in [*runs, run]:
        if any(sums[w] >= min(H.SURGE, high) for w in run):
            lines = sorted({k for w in run for k in w if k > seen})
            heavy = [k for k in lines if weights[k] >= min(H.EDGE, max(weights))]
            if heavy:
                out.append(set(range(heavy[0], heavy[-1] + 1)))
                seen = heavy[-1]
    return out


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("marked", [False, True])
def test_line_blocks(seed, marked):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 0, 0, 3, 20, 60, 200]) for _ in range(rng.randint(1, 40))]
    body = [f"<p>{'x' * n}</p>" if n else "<p><a href=x>link</a></p>" for n in lengths]
    texts = ["x" * n or "link" for n in lengths]
    weights, marks = list(lengths), []
    if marked:
        marks = [rng.random() < 0.3 for _ in lengths]
        weights = [n + H.MARK if m else n / H.BESIDE if any(marks) else n for n, m in zip(lengths, marks)]
        body = [f"<article>{x}</article>" if m else x for x, m in zip(body, marks)]
    found = _plain_lines(weights)
    keep = set().union(*found)
    for before, after in zip(found, found[1:]):
        between = range(max(before) + 1, min(after))
        size, linked = sum(len(texts[k]) for k in between), sum(len(texts[k]) for k in between if not lengths[k])
        if 2 * size <= min(sum(len(texts[k]) for k in x) for x in (before, after)) and 2 * linked <= size:
            keep |= set(between)
    got = H.main_text(f"<body>{''.join(body)}</body>")
    assert got == "\n".join(texts[k] for k in sorted(keep))


def test_menu_login_line_and_footer_go():
    prose = " ".join(f"word{k}" for k in range(60))
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><div>Welcome, log in</div><p>{prose}</p><div>Posted in: misc. 3 replies.</div><div>(c) 2024</div>"
    assert H.main_text(page) == prose


def test_a_mark_alone_is_no_surge():
    """Marked lines far from any text are dropped where the page has text; unmarked text beside the mark stays if it is long."""
    prose, links = "x" * 900, "<p><a href=x>a link</a></p>" * 5
    assert H.main_text(f"<p>{prose}</p>{links}<article><p>tiny</p></article>") == prose
    assert H.main_text(f"<article><p>{prose}</p></article>{links}<p>{prose}y</p>{links}<p>{'z' * 300}</p>").split("\n")[-1] == prose + "y"


def test_label_and_table_inside_the_article():
    page = f"<article><p>{'x' * 200}</p><p>Use the <label>label</label> tag</p><table class=related><tr><td>one</td><td>two</td></tr></table></article>"
    assert H.main_text(page) == f"{'x' * 200}\nUse the label tag\none\ntwo"


def test_lengths_decide_where_marks_are_taken_away():
    """The tables' pages give nearly the same text without their marks: by surge and dive alone."""
    import re

    import duckdb

    right = wrong = 0
    changed = 0
    for (page,) in duckdb.sql(f"SELECT html FROM '{DATA}/pages.parquet'").fetchall():
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)
        want, got = H.main_text(page).split("\n"), H.main_text(bare).split("\n")
        lost, more = set(want) - set(got), set(got) - set(want)
        changed += bool(lost or more)
        wrong += sum(map(len, lost | more))
        right += sum(map(len, want))
    assert changed and wrong < 0.03 * right


def test_names_inside_the_article_drop_no_text():
    page = '<article><h1>T</h1><p class="form-intro">real text one</p><div id="search-engines"><p>How search works</p></div><p class="tags">hm</p><h2 id="comments">On comments</h2></article>'
    assert H.main_text(page) == "T\nreal text one\nHow search works\nhm\nOn comments"


def test_adverts_between_unmarked_paragraphs():
    p = "<p>" + "word " * 40 + "</p>"
    page = f"<body>{p * 3}{'<div class=ad>buy</div>' * 3}{p * 3}</body>"
    assert H.main_text(page).count("\n") == 5 and "buy" not in H.main_text(page)


def test_a_teaser_does_not_hide_the_text():
    text = " ".join(f"word{k}" for k in range(200))
    page = f"<body><div><p>{text}</p></div><article><a href=x>Next: more</a></article><div>short, of the site</div></body>"
    assert H.main_text(page) == f"{text}\nNext: more"


def test_parts_of_the_article_are_all_kept():
    page = "<main><article><p>one</p></article><nav>menu</nav><article><p>two</p><footer>by</footer></article><ul><li><a href=x>a source</a></ul></main>"
    assert H.main_text(page) == "one\ntwo\na source"


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, "<i>" * 160_000 + "</b>" * 160_000, '<a ">" ' * 170_000, "<div>" + "<i>" * 150_000 + "<hr>" * 120_000,
     "</script" * 120_000, "<" * 1_000_000, "<p>" * 300_000, "<p " + "a='" * 300_000 + ">", '<p class="' + "a " * 500_000 + '">x'],
    ids=range(9),
)
def test_hostile_pages_take_linear_time(page):
    def seconds(x):
        began = time.process_time()
        H.main_text(x)
        return time.process_time() - began

    whole, part = seconds(page), seconds(page[: len(page) // 4])
    assert whole < max(10 * part, 2)
