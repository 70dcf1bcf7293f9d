"""Main text of web pages by two passes of block rules.

First pass: a page is cut into blocks at block-level tags, each with its text, link density and stop-word density.
Markup that names its part (nav, footer, class="ad" ...) decides a block; else its densities and length do, or leave it
open. Second pass: an open short block takes the label of its nearest decided neighbours. That it stands in an article
or main element is one feature: it speaks for open blocks, and never against a block that the first pass decided.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags, names and words of the rules.
SKIPPED = frozenset("script style noscript template iframe object svg canvas math select option textarea button audio video map head title datalist".split())
BOILER_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open tag of the same kind.
SELF_ENDING = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adslot adsense adbox banner banners sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer foot masthead topbar sidebar sidebars side aside widget widgets related recommended recommendations more-links share sharing social follow comment comments commentlist disqus replies respond reactions copyright legal disclaimer skip skip-link toolbar tags tagcloud toc".split()
)
#: Parts before a name that make it tell of something else.
NOT_ITSELF = frozenset("with without has have no not and".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog".split())
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this from at or an not have but they you which all were when we there can one "
    "der die das und in den von zu mit ist im für auf ein eine des dem sich als nicht auch es an werden aus er hat dass sie nach bei um "
    "le la les de des du et un une en que qui dans pour pas sur au par est plus ce il elle ne se son avec sont "
    "el los las y del se por con una para como su al lo más o pero sus no".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript")}
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/>\"']+)")
NAME_PART = re.compile(r"[^a-z]+")
WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    label: int | None  # 1 content, 0 boilerplate, None open
    inside: bool  # in an article or main element
    heading: bool
    words: int = 0
    form: str | None = None  # the form that it stands in


def _named(value: str) -> bool:
    """Whether a class or id names boilerplate: as a whole, or by its last part if that isn't negated or joined to others."""
    for name in value.split():
        parts = [x for x in NAME_PART.split(name) if x]
        if name in BOILER_NAMES or parts and parts[-1] in BOILER_NAMES and not NOT_ITSELF & set(parts[:-1]):
            return True
    return False


def _boiler(tag: str, attributes: str, inside: bool) -> bool | str:
    """Whether an element is boilerplate; "name" if only its class or id says so, "form" if it is a form, which may hold a whole page."""
    named: bool | str = "form" if tag == "form" else False
    if tag in BOILER_TAGS:
        return True
    if tag == "header" and not inside:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return named
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        if name == "hidden":
            return True
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in BOILER_ROLES or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            named = "name" if _named(value) else named
    return named


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with the first pass's labels."""
    out: list[Block] = []
    stack: list[tuple[str, bool | str, bool]] = []  # tag, in boilerplate, in content
    text: list[str] = []
    linked = 0
    links = 0
    heading = False
    seen = False  # an article or main element
    forms = 0
    unclosed: set[str] = set()  # skipped elements of which no end tag follows

    def close() -> None:
        nonlocal linked, text, heading
        words = html.unescape("".join(text)).split()
        if words:
            boiler, inside = stack[-1][1:] if stack else (False, False)
            joined = " ".join(words)
            form = boiler if isinstance(boiler, str) and boiler != "name" else None
            label = 0 if boiler and not form else None
            if label is None:
                found = WORD.findall(joined.lower())
                stops = sum(w in STOP_WORDS for w in found)
                density = stops / max(1, len(found))
                link = min(1.0, linked / max(1, len(joined)))
                if link > 0.5 and not inside:
                    label = 0
                elif len(found) >= 20 and (density >= 0.15 or inside):
                    label = 1
                elif len(found) >= 40 and density < 0.02 and not inside:
                    label = 0
            out.append(Block(joined, label, inside, heading, len(words), form))
        text, linked, heading = [], 0, False

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[1] is not None:
            text.append(html.escape(m[1]))
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS or tag in CONTENT_TAGS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in SKIPPED and tag != "head":
            stop = RAW_END.get(tag) or re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I)
            found = None if m[4].rstrip().endswith("/") or tag in unclosed else stop.search(page, at)
            if not found and not m[4].rstrip().endswith("/"):
                unclosed.add(tag)
            if found:
                closing = page.find(">", found.end())
                at = closing + 1 if closing >= 0 else end
            elif tag in RAW_END and not m[4].rstrip().endswith("/"):
                at = end
            text.append(" ")
            continue
        if tag in ("br", "hr") or tag in BLOCK_TAGS:
            if tag == "br":
                text.append(" ")
            else:
                close()
        if tag in VOID_TAGS or m[4].rstrip().endswith("/"):
            continue
        if tag == "a":
            links += 1
        if tag in SELF_ENDING and stack and stack[-1][0] in SELF_ENDING[tag]:
            stack.pop()
        if tag in BLOCK_TAGS or tag in CONTENT_TAGS or "=" in m[4]:
            boiler, inside = stack[-1][1:] if stack else (False, False)
            if tag in CONTENT_TAGS:
                boiler, seen = False if boiler not in (True, "name") or boiler == "name" and not seen else boiler, True  # a name never overrules the page's first article
            new = boiler if boiler is True else _boiler(tag, m[4], inside or tag in CONTENT_TAGS) or boiler
            if new == "form":
                forms += 1
                new = f"form{forms}"
            if new and not boiler:
                close()
            stack.append((tag, new, (inside or tag in CONTENT_TAGS) and not new))
        if tag[0] == "h" and tag[1:].isdigit():
            heading = True
    close()
    holders = {b.form for b in out if b.label == 1}
    for b in out:
        if b.form and b.form not in holders:  # a form around a whole page holds decided content, a mere form doesn't
            b.label = 0
    return out


def extract(page: str | None) -> str:
    """Main text of a page: its content blocks in page order, joined by line feeds."""
    found = blocks(page or "")
    article = any(b.inside and b.label == 1 for b in found)  # else an article is but a teaser or quote if there is content elsewhere
    elsewhere = any(not b.inside and b.label == 1 for b in found)
    articles = article or any(b.inside and b.label is None for b in found) and not elsewhere
    outside = [i for i, b in enumerate(found) if b.label is not None and not (articles and b.inside)]
    keep = []
    for i, b in enumerate(found):
        label = b.label
        if label is None and b.inside and articles:
            label = 1
        if label is None:
            at = bisect(outside, i)
            before, after = outside[at - 1] if at else None, outside[at] if at < len(outside) else None
            said = {found[k].label for k in (before, after) if k is not None}
            if b.heading:
                label = found[after].label if after is not None else 0
            elif not said:
                label = int(b.words >= 3 and not articles)
            elif len(said) == 1 and before is not None and after is not None:
                label = said.pop()
            else:  # the nearer one, content if both are as near
                label = -min((abs(k - i), -found[k].label) for k in (before, after) if k is not None)[1]
        if label:
            keep.append(b.text)
    return "\n".join(keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null html is empty; a page without content has text "" and n_chars 0.

    Equal rows give equal rows, null ids and urls stay null, other columns are not read, whole pages of any length are.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
