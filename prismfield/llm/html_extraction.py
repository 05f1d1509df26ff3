"""Main-text extraction from HTML by tag-path ratios.

Every text block belongs to a root-to-leaf tag path, whose nodes carry their class words. Per
path the page's text length, punctuation and linked text are summed; the two ratios (text per
block and punctuation per block, both less linked text) are smoothed over neighbouring blocks
in page order, fused by their product, and thresholded to choose the content paths.
Elements and class words are features of the score, not verdicts: each kind of evidence for
menus, headers, footers, sidebars, notices, adverts, forms and readers' comments lowers a path's
fused ratio by a factor, `article` and `main` raise it. Only what a browser never shows as text
(scripts, styles, hidden elements) is left out beforehand.

Defined edge cases
- null or empty html, or html without text: empty string, n_chars 0.
- repeated pages get equal rows; an empty table gives no rows; extra columns are ignored.
- a very long page or a very deep one is scored as a whole; a path counts once whatever its depth.
- unclosed elements end with their parent; stray end tags are ignored; `p` and `li` close themselves.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<|[^<]+", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset({"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "object", "canvas", "head", "title", "xmp", "noembed"})
#: Elements whose content is not even markup.
OPAQUE = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed"})
#: Elements that seldom are part of the article.
FURNITURE = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "input", "label", "option"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
INLINE = frozenset({"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"})
CONTENT = frozenset({"article", "main"})
#: Elements that an opening tag of the key closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset({"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"})
#: Words of class, id and role that speak for furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-ads comment comments commentlist consent cookie cookies disqus footer gdpr "
    "header masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pagination pager paywall popup promo promoted promotion "
    "related recommended recommendations replies reply respond search share sharing shares sidebar signup skip skiplink social sponsor sponsored subscribe subscription taboola toolbar "
    "widget widgets alert complementary contentinfo search".split()
)
OF_ARTICLE = frozenset({"article", "entry", "post", "story"})
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


def _evidence(name: str, attributes: str) -> tuple[int, bool, str]:
    """Signs of furniture (two for an element, one for class words), whether hidden, and the node's label in a path."""
    signs, words = 2 * (name in FURNITURE), []
    if attributes and name not in ("body", "html"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                return signs, True, name
            if key in ("class", "id", "role"):
                words += _WORDS.findall(value)
        titled = not OF_ARTICLE.isdisjoint(words)  # an article's own header
        signs += any(w in MARKS and not (titled and w == "header") for w in words)
    return signs, False, ".".join([name, *words]) if words else name


def blocks(page: str) -> list[tuple[str, str, int, int, bool]]:
    """(path, text, linked characters, signs of furniture above, inside an article) of each block in page order."""
    out: list[tuple[str, str, int, int, bool]] = []
    stack: list[tuple[str, int, bool, str]] = []  # name, signs of furniture, raw, label
    text: list[str] = []
    linked, path, bad, raw, good, link = 0, "", 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            joined = " ".join((entities.unescape(joined) if "&" in joined else joined).split())
            if joined:
                out.append((path, joined, linked, bad, good > 0))
            text.clear()
        linked = 0

    def leave() -> None:
        nonlocal bad, raw, good, link, path
        name, signs, was_raw, _ = stack.pop()
        bad -= signs
        raw -= was_raw
        good -= name in CONTENT
        link -= name == "a"
        if name not in INLINE:
            path = "/".join(s[3] for s in stack if s[0] not in INLINE)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            part = m[0]
            if part[0] != "<" or part == "<":
                if not raw:
                    text.append(part)
                    if link:
                        linked += len(part.strip())
            elif part.startswith("<![CDATA["):
                pass
            continue
        name = name.lower()
        if m[1]:
            if not any(s[0] == name for s in stack):
                continue
            if name not in INLINE:
                flush()
            elif any(s[0] not in INLINE for s in stack[[i for i, s in enumerate(stack) if s[0] == name][-1] :]):
                continue  # an inline end tag does not close blocks
            while True:
                last = stack[-1][0]
                leave()
                if last == name:
                    break
            continue
        if name == "br":
            if not raw:
                text.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                if next((s[0] for s in reversed(stack) if s[0] not in INLINE), "") == "p":
                    while stack[-1][0] != "p":
                        leave()
                    leave()
            if name in CLOSES:
                while stack and (stack[-1][0] in CLOSES[name] or stack[-1][0] in INLINE and any(s[0] in CLOSES[name] for s in stack[-2:])):
                    leave()
        if name == "body":
            while stack and stack[-1][0] == "head":
                leave()
        if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
            continue
        if name in OPAQUE:  # nothing opens inside
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if end:
                at = page.find(">", at) + 1 or size
            continue
        signs, hidden, label = _evidence(name, m[3])
        hidden |= name in RAW
        stack.append((name, signs, hidden, label))
        bad += signs
        raw += hidden
        good += name in CONTENT
        link += name == "a"
        if name not in INLINE:
            path = "/".join(s[3] for s in stack if s[0] not in INLINE)
    flush()
    return out


def path_scores(found: list[tuple[str, str, int, int, bool]], radius: int = 2, furniture: float = 0.03, article: float = 2.0) -> dict[str, float]:
    """Fused ratio of each path: smoothed text ratio times smoothed punctuation ratio, per block, weighed by its unlinked share and its evidence."""
    length: dict[str, float] = {}
    marks: dict[str, float] = {}
    count: dict[str, int] = {}
    chars: dict[str, int] = {}
    weight: dict[str, float] = {}
    for path, text, linked, signs, good in found:
        count[path] = count.get(path, 0) + 1
        chars[path] = chars.get(path, 0) + len(text)
        length[path] = length.get(path, 0) + max(0, len(text) - linked)
        marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(text)) * (1 - min(1.0, linked / len(text)))
        weight[path] = furniture ** min(signs, 4) * (article if good else 1.0)
    series = [(p, length[p] / count[p], marks[p] / count[p]) for p, *_ in found]
    sums: dict[str, float] = {}
    for i, (p, *_) in enumerate(found):
        # what furniture says about its neighbours counts by its weight
        near = [(x, y, 1.0 if q == p else min(1.0, weight[q])) for q, x, y in series[max(0, i - radius) : i + radius + 1]]
        text_ratio = sum(w * x for x, _, w in near) / len(near)
        mark_ratio = sum(w * y for _, y, w in near) / len(near)
        sums[p] = sums.get(p, 0.0) + text_ratio * (1 + mark_ratio)
    own = {p: 0.02 + 0.98 * min(1.0, length[p] / chars[p]) for p in sums}
    return {p: weight[p] * own[p] * v / count[p] for p, v in sums.items()}


def extract(page: str | None, share: float = 0.09) -> str:
    """Blocks of the content paths, joined by line feeds: paths whose score reaches `share` of the page's best."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    scores = path_scores(found)
    # what two signs speak against sets no measure: a page of furniture alone has no article
    signs = {path: n for path, _, _, n, _ in found}
    least = share * max((v for p, v in scores.items() if signs[p] < 2), default=float("inf"))
    return "\n".join(text for path, text, *_ in found if scores[path] >= least and scores[path] > 0)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars (code points) of every page; one narrow pass."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
