"""Main text of HTML pages by line-block distribution.

The markup is stripped to a list of lines, one per block in page order. Blocks that
cannot be the article (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are no lines. A line weighs its characters outside
links, and MARK more if it is a heading or if the page marks it as the article
(article, main, role=main, articleBody). On a page with marks what lies beside them
weighs a part, 1 / BESIDE, and gets nothing for headings.

Weights are summed over windows of WINDOW lines. Text surges where a window's sum reaches
SURGE, and goes on, both ways, to where it dives: as far as windows reach DIVE. At
either end lines of less than EDGE are cut off, as a login line above or a byline below the
text. What lies between two such regions is kept if it is no longer than half the
shorter one, and not mostly links. A mark alone is no surge: WINDOW marked lines of no length stay under
it. So a mark adds to what the lengths say, and a teaser in <article> doesn't hide
a much longer text beside it. On a short page the surge is the highest sum, and the dive half of it
at most.

Outside of a marked article an element is taken for a menu, advert and so on by its
tag, role, or a class or id that begins or ends in a word for one. Inside, only by
tag or role, or where a container's whole class or id says it ("ad-box", "comments"):
paragraphs, headings, lists' items and cells are never judged by names there.

Nulls: a null page is an empty one: text '' and n_chars 0. Null ids and URLs are
carried along; columns other than page_id, url and html are not read. Rows are
independent, so an empty table gives an empty result and repeated rows are repeated.
Unclosed tags and quotes don't stop the extraction: an unclosed element ends with its
parent, an unclosed script or comment with the page. Pages of any length take time
in proportion to it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Sums of weights in a window at which text surges, and under which it dives.
SURGE, DIVE = 160, 100
#: Weight of a line at which text can begin or end; what a mark or a heading adds to a line's weight.
EDGE = MARK = 40
#: The weight of what lies beside the marked article is divided by this.
BESIDE = 5

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PLAIN = re.compile(r"[^>\"']*+")

#: Elements whose content is no markup.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes")}
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE_TAGS = frozenset(
    "nav footer aside form head menu dialog select option button label fieldset input audio video canvas map noscript "
    "template svg math object".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE_TAGS = frozenset(("article", "main"))
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words for what is not the article; a class or id that begins or ends in one of the first says so outside of an article.
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside "
    "related recommended share sharing social ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments disqus pagination pager "
    "copyright disclaimer popup modal toolbar".split()
)
_WEAK_WORDS = frozenset(
    "notice notices banner replies respond rail widget recommendations trending popular promotion privacy overlay register "
    "search form commentary reply discussion legal skip alert toast".split()
)
#: Words for the article's title, and those that count inside of a marked article.
_TITLE_WORDS = frozenset(("header", "masthead"))
_INSIDE_WORDS = (_NOISE_WORDS - _TITLE_WORDS) | {"notice", "notices", "banner", "replies", "respond"}
#: Words that say nothing of their own beside those.
_FILLERS = frozenset(
    "box bar block area section list container wrapper wrap panel inner outer content item items group unit slot left "
    "right top bottom main primary secondary site page the and by for post posts article articles reading reader readers "
    "thread links".split()
)
_CONTAINERS = frozenset("div section ul ol dl table figure details".split())
_ARTICLE_NAMES = frozenset(("articlebody", "articlecontent", "postcontent", "entrycontent", "maincontent"))
#: Tags whose open element of the same kind ends where the next begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # characters in links
    article: bool
    heading: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)}


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id."""
    text = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", text).lower()
    return [words for name in dict.fromkeys(text.split()) if (words := [w for w in re.split(r"[^a-z]+", name) if w])]


def _says_noise(words: list[str], in_article: bool, container: bool) -> bool:
    known = [w for w in words if w not in _FILLERS]
    if in_article:
        return container and bool(known) and _INSIDE_WORDS.issuperset(known)
    if known and all(w in _NOISE_WORDS or w in _WEAK_WORDS for w in known):
        return True
    return container and (words[0] in _NOISE_WORDS or words[-1] in _NOISE_WORDS)


def _is_noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _NOISE_TAGS and not (in_article and tag == "label") or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return True
    if attrs.get("role", "").lower() in _ROLES:
        return True
    return tag not in _ARTICLE_TAGS and any(_says_noise(w, in_article, tag in _CONTAINERS and not (in_article and tag == "table")) for w in _names(attrs))


def _marks_article(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _ARTICLE_TAGS or attrs.get("role") == "main" or attrs.get("itemprop", "").lower() == "articlebody":
        return True
    return bool(attrs) and any("".join(w) in _ARTICLE_NAMES for w in _names(attrs))


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, start and end tags in order; comments, declarations and raw text are skipped."""
    at, n, quotes = 0, len(page), True
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        head = page[lt + 1 : lt + 2]
        if head in ("!", "?"):
            yield "text", "", page[at:lt]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "text", "", html.escape(page[lt + 9 : n if end < 0 else end], quote=False)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                if end < 0:
                    at = lt
                    break
                at = end + 1
            continue
        name = _NAME.match(page, lt + 2 if head == "/" else lt + 1)
        if not name:  # a bare <, as in a < b
            following = page.find("<", lt + 1)
            following = n if following < 0 else following
            yield "text", "", page[at:following]
            at = following
            continue
        end, p = -1, name.end()
        while quotes:  # to the > outside of quotes
            p = _PLAIN.match(page, p).end()
            if p >= n:
                quotes = False  # none is left: from here on any > ends a tag
            elif page[p] == ">":
                end = p
                break
            else:
                p = page.find(page[p], p + 1) + 1
                if not p:
                    quotes = False
        if end < 0:
            end = page.find(">", name.end())
            if end < 0:
                break
        yield "text", "", page[at:lt]
        tag = name[0].lower()
        if head == "/":
            yield "end", tag, ""
        else:
            yield "start", tag, page[name.end() : end]
        at = end + 1
        if tag in _RAW and head != "/":
            close = _RAW[tag].search(page, at)
            if not close:
                return
            gt = page.find(">", close.end())
            at = n if gt < 0 else gt + 1
    if at < n:
        yield "text", "", page[at:]


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, without those that cannot be the article."""
    out: list[Line] = []
    # open elements: (tag, noise from here, article from here, link from here)
    stack: list[tuple[str, bool, bool, bool]] = []
    blocks: list[int] = []  # where in the stack the blocks are
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    noise = article = link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Line(text, linked, article, bool(blocks) and stack[blocks[-1]][0] in _HEADINGS))
        parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal noise, article, link
        if blocks and blocks[-1] >= k:
            flush()
            while blocks and blocks[-1] >= k:
                blocks.pop()
        open_tags.subtract(x[0] for x in stack[k:])
        del stack[k:]
        _, noise, article, link = stack[-1] if stack else ("", False, False, False)

    for kind, tag, rest in _tokens(page):
        if kind == "text":
            if rest and not noise:
                text = html.unescape(rest)
                parts.append(text)
                if link:
                    linked += len(" ".join(text.split()))
        elif kind == "end":
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            elif tag in _BLOCKS:
                flush()
        elif tag == "br":
            if not noise:
                parts.append(" ")
        else:
            if tag in _BLOCKS:
                # an open paragraph ends, with the inline elements in it
                if blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in _ENDS.get(tag, ())):
                    pop_to(blocks[-1])
                flush()
            if tag in _VOID or rest.endswith("/") and tag not in _BLOCKS:
                continue
            attrs = _attributes(rest) if rest.strip() else {}
            is_noise = noise or _is_noise(tag, attrs, article)
            article = not is_noise and (article or _marks_article(tag, attrs))
            noise, link = is_noise, link or tag == "a"
            if tag in _BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, noise, article, link))
            open_tags[tag] += 1
    flush()
    return out


def weigh(lines: list[Line]) -> list[float]:
    marks = any(x.article for x in lines)
    out = []
    for x in lines:
        outside = max(len(x.text) - x.linked, 0)
        if marks and not x.article:
            out.append(outside / BESIDE)
        else:
            out.append(outside + MARK * (x.article or x.heading))
    return out


def regions(weights: list[float]) -> list[tuple[int, int]]:
    """Ranges [i, j) of lines: windows that reach DIVE, side by side, one of which surges, without light lines at the ends."""
    n = len(weights)
    size = min(WINDOW, n)
    sums = [sum(weights[i : i + size]) for i in range(n - size + 1)]
    highest = max(sums, default=0)
    surge, dive = min(SURGE, highest), min(DIVE, highest / 2)
    edge = min(EDGE, max(weights, default=0))
    out: list[tuple[int, int]] = []
    i = 0
    while highest and i < len(sums):
        if sums[i] < dive:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j] >= dive:
            j += 1
        if max(sums[i:j]) >= surge:
            a, b = max(i, out[-1][1] if out else 0), j - 1 + size
            while a < b and weights[a] < edge:
                a += 1
            while b > a and weights[b - 1] < edge:
                b -= 1
            if a < b:
                out.append((a, b))
        i = j
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by newlines."""
    lines = lines_of(page)
    found = regions(weigh(lines))
    sizes = [sum(len(x.text) for x in lines[a:b]) for a, b in found]
    kept: list[str] = []
    for k, (a, b) in enumerate(found):
        if k:
            between = lines[found[k - 1][1] : a]
            size, linked = sum(len(x.text) for x in between), sum(x.linked for x in between)
            if 2 * size <= min(sizes[k - 1 : k + 1]) and 2 * linked <= size:
                kept += [x.text for x in between]
        kept += [x.text for x in lines[a:b]]
    return "\n".join(kept)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page; no shuffle."""
    kind = pages.select("page_id").schema[0].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string")).mapInArrow(
        _map, f"page_id {kind}, url string, text string, n_chars long"
    )


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
