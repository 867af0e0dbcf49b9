"""Main text of web pages by composite text density.

A page becomes a tree of elements without scripts, styles, other raw text and hidden parts. For each node the composite text
density is its characters for each tag, adjusted for the share of characters and tags in links. Elements whose tags, roles,
classes or ids name menus, headers, footers, sidebars, notices, adverts, forms or comments are not taken out: their
characters weigh LIGHT in every density. The node whose children's densities sum up highest is the centre; the least density
on the way from it to the body is the threshold. From the body down every node at or above it contributes its subtree with
the greatest sum, without the parts of little weight whose density is below the threshold.

Defined results: null and empty pages, and pages with text of little weight alone, give the empty string; unclosed
and stray tags are repaired as browsers do for paragraphs, list items and cells; a comment, script or tag that never
ends runs to the end of the page; repeated rows and null ids pass through; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg canvas select".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br caption".split())
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "html", "body"}
#: What an opening tag ends, up to what encloses it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: What a character counts in parts that are named as something else than the main text.
LIGHT = 0.001
LEAVES_TAGS = frozenset("nav footer aside form button dialog menu fieldset head".split())
LEAVES_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner topbar footer foot sidebar side aside widget widgets rail "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus discussion respond replies reply "
    "pagination pager copyright legal toolbar search skip outbrain taboola".split()
)
#: What names other parts, unless they hold the text of the page.
REMARKS = frozenset("comment comments commentlist disqus replies respond".split())
#: A class or id with one of these parts tells the state of an element, not what it is.
STATES = frozenset("no not without has with is open opened closed enabled disabled on off active inactive allowed".split())
LEAVES_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"""<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<![^\s"'])(hidden)(?![^\s/>])""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NONE_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """The elements of a page in parallel lists; node 0 is the root. Text and blocks are kept in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.items: list[tuple[int, str | None]] = []  # (node, text), text None where a block begins or ends
        stack, at = [0], 0
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.items.append((stack[-1], source[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, name)
                continue
            if name in CLOSES_P:
                self._end(stack, {"p"}, {"table", "td", "th", "div", "article", "section", "button", "li"})
            if name in ENDS:
                self._end(stack, *ENDS[name])
            if name in BLOCKS:
                self.items.append((stack[-1], None))
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(m[3])
            if name in RAW:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                at = found.end()
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(node)
        if at < len(source):
            self.items.append((stack[-1], source[at:]))

    def _end(self, stack: list[int], names: set[str], limits: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                self.items.append((stack[k], None))
                del stack[k:]
                return
            if tag in limits:
                return

    def _close(self, stack: list[int], name: str) -> None:
        inline = name not in BLOCKS
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                if not inline:
                    self.items.append((stack[k], None))
                del stack[k:]
                return
            if inline and tag in BLOCKS:
                return

    def named(self) -> tuple[list[bool], list[bool]]:
        """Which nodes are no text or hidden, and which are named as something else than the main text, each with all below them."""
        n = len(self.tag)
        holds, inside, size, marks = [False] * n, [False] * n, [0] * n, [0] * n
        for node, text in self.items:
            size[node] += len("".join(text.split())) if text else 0
        for i in range(n - 1, 0, -1):  # children come after their parents
            own = self.tag[i] in ("article", "main", "h1") and not REMARKS & self._named(i)
            marks[i] += own and self.tag[i] != "h1"
            holds[self.parent[i]] |= holds[i] or own
            size[self.parent[i]] += size[i]
            marks[self.parent[i]] += marks[i]
        # where no article or main is named outside of it, an element with most of the text is the page's own
        rich = [2 * size[i] > size[0] and marks[i] == marks[0] for i in range(n)]
        out, light = [False] * n, [False] * n
        for i in range(1, n):
            p, tag = self.parent[i], self.tag[i]
            inside[i] = inside[p] or tag in ("article", "main")
            out[i] = out[p] or tag in RAW or tag == "head" or self._hidden(i)
            light[i] = light[p] or self._light(i, tag, inside[i], holds[i], rich[i])
        return out, light

    def _hidden(self, i: int) -> bool:
        for k, v, hidden in _ATTR.findall(self.attrs[i]) if self.attrs[i] and self.tag[i] not in ("html", "body", "main") else ():
            k, v = k.lower(), v.strip("\"'")
            if hidden or k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and _NONE_SHOWN.search(v)):
                return True
        return False

    def _named(self, i: int) -> set[str]:
        """The words of an element's class and id."""
        values = [v.strip("\"'") for k, v, _ in _ATTR.findall(self.attrs[i]) if k.lower() in ("class", "id")]
        parts = [[x.lower() for x in _PART.findall(name)] for v in values for name in v.split()]
        return {x for words in parts if len(words) == 1 or not STATES.intersection(words) for x in words}

    def _light(self, i: int, tag: str, inside: bool, holds: bool, rich: bool) -> bool:
        if tag in ("nav", "footer", "aside", "dialog") or (tag == "header" and not inside):
            return True
        if tag in LEAVES_TAGS and not holds:
            return True
        if not self.attrs[i] or tag in ("html", "body", "main"):
            return False
        if any(k.lower() == "role" and v.strip("\"'").lower() in LEAVES_ROLES for k, v, _ in _ATTR.findall(self.attrs[i])):
            return not holds
        words = LEAVES_WORDS & self._named(i)
        if not words or holds or rich:
            return False
        return bool(words & REMARKS) or tag != "article"

    def marked(self, gone: list[bool], light: list[bool], texts: list[str | None]) -> list[bool]:
        """Which nodes are content by composite text density."""
        n = len(self.tag)
        c, lc, t, lt, weighed = [0] * n, [0] * n, [0] * n, [0] * n, [0.0] * n
        link = [False] * n
        for i in range(1, n):
            link[i] = link[self.parent[i]] or self.tag[i] == "a"
        for (node, _), text in zip(self.items, texts, strict=True):
            if text:
                c[node] += len(text)
                weighed[node] += len(text) * (LIGHT if light[node] else 1.0)
                if link[node]:
                    lc[node] += len(text)
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = self.parent[i]
                c[p] += c[i]
                weighed[p] += weighed[i]
                lc[p] += lc[i]
                t[p] += t[i] + 1
                lt[p] += lt[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = lc[body] / c[body] if c[body] else 0.0
        # the share of links is that of all characters; only characters for each tag are weighed
        # tags within a line count as tags, yet sums are those of blocks
        solid = [i == 0 or (x in BLOCKS and x not in VOID) for i, x in enumerate(self.tag)]
        above = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            above[i] = p if solid[p] else above[p]
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            if gone[i] or not c[i]:
                continue
            density[i] = weighed[i] / max(t[i], 1)
            base = math.log(math.log(c[i] / max(c[i] - lc[i], 1) * lc[i] + share * c[i] + math.e))
            if base > 0:
                density[i] *= math.log(max(c[i] / max(lc[i], 1) * max(t[i], 1) / max(lt[i], 1), 1.0)) / base
            if i and solid[i]:
                total[above[i]] += density[i]
        for i in range(n):  # a block without dense blocks in it stands for itself
            if solid[i] and c[i] and not total[i]:
                total[i] = density[i]
        if all(gone[i] or light[i] or not c[i] for i in range(n) if solid[i] and i not in (0, body)) and not any(text and not light[node] for (node, _), text in zip(self.items, texts, strict=True)):
            return [False] * n
        best = list(range(n))  # node of the greatest sum within each subtree, the outermost if equal
        for i in range(n - 1, 0, -1):
            if not gone[i] and not light[i] and c[i]:
                p = self.parent[i]
                if total[best[i]] > total[best[p]]:
                    best[p] = best[i]
        node, limit = best[body] if c[body] else best[0], math.inf
        while node > 0:
            limit = min(limit, density[node])
            if node == body:
                break
            node = self.parent[node]
        mark, chosen = [False] * n, [False] * n
        for i in range(n):
            p = self.parent[i]
            # the walk comes to a node only through nodes at or above the threshold
            chosen[i] = not gone[i] and bool(c[i]) and (i == 0 or i == body or chosen[p]) and (density[i] >= limit or i in (0, body))
            if chosen[i]:
                mark[best[i]] = True
        for i in range(1, n):
            p = self.parent[i]
            faint = light[i] and not light[p] and density[i] < limit  # the root of a part of little weight
            mark[i] = (mark[i] or mark[p]) and not faint and not (light[i] and light[p] and not mark[p])
        return mark

    def text(self) -> str:
        gone, light = self.named()
        texts = [None if x is None or gone[node] else entities.unescape(x) for node, x in self.items]
        shown = [None if x is None else " ".join(x.split()) for x in texts]
        mark = self.marked(gone, light, shown)
        parts = [" " if text is None else text for (node, raw), text in zip(self.items, texts, strict=True) if raw is None or (text is not None and mark[node])]
        return " ".join("".join(parts).split())


def extract(source: str | None) -> str:
    """The main text of a page."""
    return Page(source).text() if source else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
