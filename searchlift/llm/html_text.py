"""Main text of pages by two-pass block rules.

A page is cut into blocks at its block elements. The first pass labels each block by link
density, length and stop-word density as good, bad or undecided; scripts, forms, menus, footers and
containers that name themselves as such are left out as a whole. The second pass gives each
undecided block the label of its nearest decided neighbours (bad if they disagree, unless one is a
heading's follower). Where a page marks its article, the mark decides: every block inside stays but
those of such containers, and of article elements beside each other those go that have less than half
the text of the longest, which are teasers of other pages. On pages whose language has no stop words here, the density of sentence
punctuation stands in for theirs.

A container names itself by an element name, a role, or a class or id whose words are all cues or
words of layout (cookie-banner, post-comments; not search-trees). A form that holds all there is of a page is none. End tags may be missing as the
language allows (p, li, dt, dd, tr, td, head); an element ends at the latest with its parent.

Defined results: null and empty pages give the empty text and 0; very long pages are read whole, in
one pass; white space is that of Unicode, no-break spaces too; a page of a few words alone gives these, but for
links; one without any text outside of such containers the empty text; pages that repeat give equal rows;
empty tables give no rows; columns other than the html are passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlift.llm.common import table

#: Elements whose content is never text of the page.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|canvas|audio|video|title|select"
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
#: What follows a tag's name, quoted values with their marks, up to its end; no part is tried twice.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
MARKED = re.compile(r"<(?:article|main)\b", re.I)
ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split("|")}
#: Elements that end a block; of these, those that end an open paragraph.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr".split())
#: What the start of an element ends, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
IN_HEAD = frozenset("head meta link base title style script noscript template".split())
#: Elements, roles and class or id words that mark what is not the article, and words of layout that may stand beside them.
DROP = frozenset("nav footer aside form menu dialog button head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CUES = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social related recommended comment comments respond disqus livefyre commentlist commentform commentarea commentsection widget pager pagination login signup search skip toolbar".split())
LAYOUT = frozenset("area article articles bar block bottom box button buttons col column container content entry form global group header icon icons inner item items left legal link links list main module outer page panel post posts primary reader readers region right row secondary section site slot text thread threads top unit user users wrap wrapper zone".split())
#: Of the cues, those that make an outermost article element none.
ASIDE = frozenset("ad ads advert adverts advertisement sponsored promo related recommended comment comments".split())
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The commonest words of the four languages.
STOP = frozenset(
    "a an and are as at be but by for from has have he in is it its of on or that the this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einen er es für ist im in mit nicht sich sie sind und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par plus pour que qui se sont sur un une "
    "al así como con de del el en es la las lo los más mi no para pero por que se su sus un una y ya".split()
)
LONG, SHORT, LINKED, DENSE, SPARSE = 200, 70, 0.33, 0.30, 0.15
#: A page's language is known from this stop-word density on; else punctuation per character stands for it, on its own scale.
KNOWN, DENSE_MARKS, SPARSE_MARKS = 0.25, 0.010, 0.004
MARKS = re.compile(r"[.,;:!?…。，、；：！？।॥؟،؛·]")
#: Scripts that write a word in one or two characters: such a character counts as three.
WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


class _Block:
    __slots__ = ("parts", "linked", "heading", "article", "number")

    def __init__(self, heading: bool, article: bool, number: int):
        # number: of the outermost article element, from 1 on; 0 outside of one.
        self.parts, self.linked, self.heading, self.article, self.number = [], 0, heading, article, number


def _cue(name: str, cues: frozenset[str] = CUES) -> bool:
    words = [w.lower() for w in WORD_IN_NAME.findall(name)]
    return any(w in cues for w in words) and all(w in CUES or w in LAYOUT for w in words)


def _cued(tag: str, attrs: str, cues: frozenset[str] = CUES) -> bool:
    if "=" not in attrs:
        return "hidden" in attrs.lower().split()
    for m in ATTR.finditer(attrs):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        # The id of a heading repeats its words.
        if kind == "role" and value.lower() in ROLES or kind != "role" and not (kind == "id" and tag in HEADINGS) and any(_cue(x, cues) for x in value.split()):
            return True
    return bool(HIDDEN.search(attrs))


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of what is no text; the name is empty for comments, declarations and the elements of RAW.

    A tag whose quotes don't close ends at the next >. Looking for closing quotes may go over the
    page eight times in all; from then on they count nothing, so that no page takes longer than its length allows.
    """
    at, last, spent = 0, html.rfind(">"), 0
    missing: set[str] = set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:
            # No tag ends any more; a comment may still begin.
            at = html.find("<!--", at)
            if at < 0:
                return
            continue
        m = TAG.match(html, at)
        if not m and html[at + 1 : at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        if not m:
            end = html.index(">", at) + 1
            yield at, end, "", False, ""
            at = end
            continue
        name, rest = m[2].lower(), REST.match(html, m.end()) if spent <= 8 * len(html) else None
        if rest is None:
            spent += len(html) - at
            end = html.index(">", at) + 1
            attrs = html[m.end() : end - 1]
        else:
            end, attrs = rest.end(), rest[1]
        if name in ENDS and not m[1]:
            if not attrs.endswith("/") or name not in ("svg", "math"):
                close = None if name in missing else ENDS[name].search(html, end)
                if close is None:
                    missing.add(name)
                end = close.end() if close else len(html)
            yield at, end, "", False, ""
        else:
            yield at, end, name, m[1] == "/", attrs
        at = end


def blocks(html: str, forms: bool = False) -> list[_Block]:
    """Blocks in page order, without those of dropped containers; forms: what stands in forms stays."""
    out, at = [], 0
    stack: list[list] = []  # [name, dropped] of the elements that were opened; closed ones inside have no name
    where: dict[str, list[int]] = defaultdict(list)  # places of the open elements of a name
    kept_out: list[int] = []  # places of open forms that drop what is in them
    dropped = article = links = breaks = articles = 0
    block = _Block(False, False, 0)

    def flush(heading: bool = False) -> None:
        nonlocal block
        if block.parts:
            out.append(block)
        block = _Block(heading, article > 0, articles if where["article"] else 0)

    def close(to: int) -> None:
        """End the open elements from place `to` on."""
        nonlocal dropped, article
        while len(stack) > to:
            name, out_of = stack.pop()
            if name:
                where[name].pop()
                dropped -= out_of
                article -= name in ("article", "main")

    def end_open(names: set[str], beyond: set[str]) -> None:
        limit = max((where[x][-1] for x in beyond if where[x]), default=-1)
        found = [where[x][i] for x in names if where[x] and (i := bisect_right(where[x], limit)) < len(where[x])]
        if found:
            close(min(found))

    for start, end, name, closing, attrs in tokens(html):
        if start > at and not dropped:
            part = html[at:start]
            block.parts.append(part)
            if links:
                block.linked += len(part)
            if not part.isspace():
                breaks = 0
        at = end
        if not name:
            continue
        if closing:
            place = where[name][-1] if where[name] else None
            if name == "a":
                links = 0
            if name not in BLOCK:
                # The end of an inline element ends no block around it.
                if place is not None:
                    where[name].pop()
                    dropped -= stack[place][1]
                    stack[place] = ["", False]
                    while stack and not stack[-1][0]:
                        stack.pop()
                continue
            flush()
            if place is not None:
                close(place)
            links = 0
            flush()
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        if name in ENDS_P:
            end_open({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if name in IMPLIED:
            end_open(*IMPLIED[name])
        if name == "br":
            if not dropped:
                breaks += 1
                block.parts.append(" ")
                if breaks == 2:
                    flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ("article", "main"):
            # A form around the article is the page's, not a form in it.
            for place in kept_out:
                if place < len(stack) and stack[place][0] == "form" and stack[place][1]:
                    stack[place][1], dropped = False, dropped - 1
            kept_out.clear()
        outer = name in ("body", "html", "main") or name == "article" and not article and not (attrs and _cued(name, attrs, ASIDE))
        out_of = name in DROP and not (forms and name == "form") or name == "header" and not article or not outer and bool(attrs) and _cued(name, attrs)
        if name in BLOCK:
            flush()
            links = 0
        if name == "article" and not where["article"]:
            articles += 1
        where[name].append(len(stack))
        if out_of and name == "form":
            kept_out.append(len(stack))
        stack.append([name, out_of])
        dropped += out_of
        article += name in ("article", "main")
        if name == "a":
            links = 1
        elif name in BLOCK:
            flush(name in HEADINGS)
    if at < len(html) and not dropped:
        block.parts.append(html[at:])
    flush()
    return out


def _stops(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?") in STOP for w in words), len(words)


def _density(text: str, known: bool) -> float:
    """Stop words per word, or what punctuation says in their place, on the same scale."""
    if known:
        n, words = _stops(text)
        return n / max(1, words)
    marks = len(MARKS.findall(text)) / max(1, len(text))
    return DENSE if marks >= DENSE_MARKS else SPARSE if marks >= SPARSE_MARKS else 0.0


def _label(text: str, linked: int, heading: bool, known: bool, least: int) -> str:
    """good, bad or '' (undecided)."""
    if linked / max(1, len(text)) > LINKED:
        return "bad"
    if heading:
        return ""
    length = len(text) + 2 * len(WIDE.findall(text))
    if length < SHORT:
        return "bad" if linked else ""
    density = _density(text, known)
    if density >= DENSE:
        return "good" if length > least else ""
    return "" if density >= SPARSE else "bad"


def _nearest(labels: list[str]) -> list[str]:
    """Before each place, the last label that is decided."""
    out, last = [], ""
    for x in labels:
        out.append(last)
        last = x or last
    return out


#: An article element beside the longest one is part of the text from this share of its length on; a shorter one is a teaser.
TEASER = 0.5


def extract(html: str | None) -> str:
    html = html or ""
    marked = bool(MARKED.search(html))
    found = _main(blocks(html), marked)
    if not found and "<form" in html.lower():
        # A form around the whole page, as some servers write it, is no form of the page.
        found = _main(blocks(html, forms=True), marked)
    return found


def _main(page: list[_Block], marked: bool) -> str:
    """The text of blocks; marked: the page has an article, so that a few words outside of it are not its text."""
    found = []
    for b in page:
        text = " ".join(unescape("".join(b.parts)).split())
        if text:
            found.append((text, b.linked, b.heading, b))
    if any(b.article for *_, b in found):
        return "\n".join(x[0] for x in _article([x for x in found if x[3].article]))
    plain = [_stops(text) for text, linked, _, _ in found if linked <= LINKED * len(text)]
    known = sum(n for n, _ in plain) >= KNOWN * max(1, sum(w for _, w in plain))
    labels = [_label(*x[:3], known, LONG) for x in found]
    if "good" not in labels:
        # A page of short paragraphs alone: those that read like text stand for the long ones.
        labels = [_label(*x[:3], known, SHORT) for x in found]
    if "good" not in labels and not marked:
        # A page of a few words: what no rule calls bad is its text.
        labels = ["" if label or heading else "good" for label, (_, _, heading, _) in zip(labels, found, strict=True)]
        labels = [x or ("bad" if linked > LINKED * len(text) else "") for x, (text, linked, _, _) in zip(labels, found, strict=True)]
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    kept = []
    for (text, _, heading, _), own, left, right in zip(found, labels, before, after, strict=True):
        if own:
            good = own == "good"
        elif heading:
            good = right == "good"
        else:
            good = "good" in (left, right) and (left != "bad" and right != "bad" or len(text) >= SHORT)
        if good:
            kept.append(text)
    return "\n".join(kept)


def _article(found: list[tuple]) -> list[tuple]:
    """Of the marked blocks those of the article: what stands outside of article elements, and these but for teasers of others."""
    length: Counter = Counter()
    for text, linked, _, b in found:
        length[b.number] += max(0, len(text) - linked)
    least = TEASER * max(length.values())
    return [x for x in found if not x[3].number or length[x[3].number] >= least]


def main_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(extract)

    return text(html)


def op6(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
