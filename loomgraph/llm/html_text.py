"""Main text of web pages by tree scoring.

Every paragraph earns points for its length and commas and passes them up: all to its container, half to the next
ancestor, and so on. A container's points are discounted by the share of its text that is links. The best
container is kept, with those of its siblings that score or read like it; menus, adverts, forms and the like inside
are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shipping import ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul noscript template button canvas object svg math video audio iframe".split()
)
TRACKED_INLINE = frozenset("a span label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("button option optgroup svg math canvas object video audio iframe noscript template body html head title".split())
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, {"td", "th", "table"}),
    "body": ({"head"}, set()),
}
BARRIERS = frozenset("table td th caption button object template".split())
PAST_BARRIERS = frozenset("table tr tbody thead tfoot body html".split())

OUT_TAGS = frozenset("head nav footer aside form button select textarea option script style noscript template iframe svg math canvas object dialog menu title legend".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav nav navbar navigation menu breadcrumb breadcrumbs "
    "footer cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login comment comments "
    "disqus replies respond discussion share sharing social related recommended recommendations widget toolbar pagination pager skip masthead "
    "topbar banner paywall outbrain taboola".split()
)
HEAD_NAMES = frozenset("header topheader siteheader".split())
GOOD_NAMES = frozenset("article body content entry main page post story text blog hentry".split())
NEUTRAL_BEFORE = frozenset("no has with without hide show".split())
NEVER_OUT = frozenset("html body main article".split())

TAG_MARK = re.compile("[>\"']")
LONG_NUMBER = re.compile(r"&#0*([0-9]+);?")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
NAME_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
COMMAS = re.compile("[,،、，]")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SENTENCE_END = re.compile(r"[.!?。！？](?:\s|$)")

MIN_PARAGRAPH = 25
PARAGRAPHS = frozenset("p pre td li blockquote dd".split())
PASSED_ON = 0.5
GOOD_WEIGHT = 1.25
SIBLING_SHARE = 0.2
SIBLING_FLOOR = 3.0
LONG_SIBLING = 80
LINK_LIST_SHARE = 0.66


def tag_end(s: str, at: int, dead: set[int]) -> int:
    """Place behind the `>` that ends a tag, quoted values skipped; 0 if a quote stays open.

    `dead` keeps the opening quotes that led to no end, so that a page reads each of its quotes once or twice.
    """
    passed = []
    while (m := TAG_MARK.search(s, at)) is not None:
        if m[0] == ">":
            return m.end()
        passed.append(m.start())
        close = -1 if m.start() in dead else s.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(passed)
    return 0


def decoded(text: str) -> str:
    """Text with its character references read; a number of more digits than a code point has stands for no character."""
    if "&#" in text:
        text = LONG_NUMBER.sub(lambda m: "\ufffd" if len(m[1]) > 7 else m[0] if len(m[0]) < 99 else f"&#{m[1]};", text)
    return html.unescape(text)


class Page:
    """The block tree of one page: nodes in document order, and blocks of inline text, each owned by a node.

    The open elements are a stack; the depths of each tag, of blocks and of barriers are kept beside it, so a tag finds
    what it closes without a scan and the work is linear in the page.
    """

    def __init__(self, source: str):
        self.tag, self.parent = ["#root"], [-1]
        self.good, self.out_tag, self.out_name, self.head = [False], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        out_tag, out_name, good, head = tag in OUT_TAGS, False, False, tag == "header"
        if attributes and tag not in NEVER_OUT or attributes and "class" in attributes:
            words: list[str] = []
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or "").strip("\"'")
                if key in ("class", "id"):
                    for name in value.split():
                        parts = [p.lower() for p in NAME_WORDS.findall(name)]
                        words += [p for i, p in enumerate(parts) if not i or parts[i - 1] not in NEUTRAL_BEFORE]
                elif key == "role":
                    out_tag = out_tag or value.lower() in OUT_ROLES
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN_STYLE.search(value):
                    out_tag = True
            out_name = not OUT_NAMES.isdisjoint(words)
            head = head or tag not in HEADINGS and not HEAD_NAMES.isdisjoint(words)
            good = not GOOD_NAMES.isdisjoint(words) and not out_name
        if tag in NEVER_OUT:
            out_tag, head = False, False
            out_name = out_name and tag == "article"
        self.good.append(good or tag in ("article", "main"))
        self.out_tag.append(out_tag)
        self.out_name.append(out_name)
        self.head.append(head)
        return len(self.tag) - 1

    def _read(self, s: str) -> None:
        stack, owners, links = [0], [0], 0
        held: list[str] = []
        depths: defaultdict[str, list[int]] = defaultdict(list)
        blocks_at, barriers_at = [0], [0]
        linked = 0
        dead: set[int] = set()
        at, n = 0, len(s)

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((owners[-1], text, min(linked, len(text))))
                held, linked = [], 0

        def keep(text: str) -> None:
            nonlocal linked
            if "&" in text:
                text = decoded(text)
            held.append(text)
            if links:
                linked += len(text.strip())

        def pop_to(depth: int) -> None:
            nonlocal links
            if blocks_at[-1] >= depth:
                flush()
            for i in stack[depth:]:
                depths[self.tag[i]].pop()
                links -= self.tag[i] == "a"
            for at_ in (blocks_at, barriers_at):
                while at_[-1] >= depth:
                    at_.pop()
            del stack[depth:], owners[depth:]

        while at < n:
            i = s.find("<", at)
            if i < 0:
                keep(s[at:])
                break
            if i > at:
                keep(s[at:i])
            c = s[i + 1 : i + 2]
            if c == "!":
                if s.startswith("<!--", i):
                    j = s.find("-->", i + 4) if not s.startswith(("<!-->", "<!--->"), i) else s.find(">", i) - 2
                    at = n if j < 0 else j + 3
                else:
                    j = s.find(">", i)
                    at = n if j < 0 else j + 1
                continue
            closing = c == "/"
            m = NAME.match(s, i + 1 + closing)
            if not m:
                if c in ("?", "/"):
                    j = s.find(">", i)
                    at = n if j < 0 else j + 1
                else:
                    keep("<")
                    at = i + 1
                continue
            tag = m[0].lower()
            stop = tag_end(s, m.end(), dead) or s.find(">", m.end()) + 1
            if not stop:
                break
            attributes = s[m.end() : stop - 1]
            at = stop
            if closing:
                depth = depths[tag][-1] if tag in depths and depths[tag] else 0
                behind_block = tag in TRACKED_INLINE and blocks_at[-1] > depth
                behind_barrier = tag not in PAST_BARRIERS and barriers_at[-1] > depth
                if depth and not behind_block and not behind_barrier:
                    pop_to(depth)
                continue
            if tag == "br" or tag == "wbr":
                held.append(" " if tag == "br" else "")
                continue
            if tag == "hr":
                flush()
                continue
            if tag in RAW:
                found = RAW_END[tag].search(s, at)
                j = found.start() if found else n
                at = (s.find(">", j) + 1 or n) if found else n
                continue
            if tag in VOID or tag not in BLOCK and tag not in TRACKED_INLINE:
                continue
            if tag in ("html", "body") and depths[tag]:
                continue
            if tag in CLOSES_P and blocks_at[-1]:
                t = self.tag[stack[blocks_at[-1]]]
                if t == "p" or t in HEADINGS and tag in HEADINGS:
                    pop_to(blocks_at[-1])
            if tag in IMPLIED_END:
                ends, scope = IMPLIED_END[tag]
                floor = max((depths[t][-1] for t in scope if depths[t]), default=0)
                if tag == "a":
                    floor = max(floor, blocks_at[-1])
                inside = (d[bisect_right(d, floor)] for t in ends if (d := depths[t]) and d[-1] > floor)
                lowest = min(inside, default=0)
                if lowest:
                    pop_to(lowest)
            if tag in BLOCK:
                flush()
            if attributes.endswith("/") and tag in ("svg", "math"):
                continue
            depth = len(stack)
            stack.append(self._open(tag, attributes, stack[-1]))
            owners.append(owners[-1] if tag in TRACKED_INLINE else stack[-1])
            links += tag == "a"
            depths[tag].append(depth)
            if tag in BLOCK:
                blocks_at.append(depth)
            if tag in BARRIERS:
                barriers_at.append(depth)
        flush()

    def _removed(self, by_name: bool) -> list[bool]:
        """Nodes that lie in something other than article text."""
        out = [False] * len(self.tag)
        inside = [False] * len(self.tag)
        heading = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            inside[i] = inside[p] or self.tag[i] == "article"
            # a head inside the article gives its headings; any other is left out whole
            in_head = heading[p] or self.head[i]
            heading[i] = in_head
            drop = self.out_tag[i] or by_name and self.out_name[i] or self.head[i] and not inside[i]
            out[i] = out[p] or drop
        titled = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            titled[i] = self.tag[i] in HEADINGS or not self.head[i] and titled[self.parent[i]]
            out[i] = out[i] or heading[i] and inside[i] and not titled[i]
        return out

    def main_text(self) -> str:
        kept = self._select(self._removed(True)) or self._select(self._removed(False))
        return "\n\n".join(kept)

    def _select(self, out: list[bool]) -> list[str]:
        n = len(self.tag)
        blocks = [b for b in self.blocks if not out[b[0]]]
        if not blocks:
            return []
        size, linked, points = [0] * n, [0] * n, [0.0] * n
        for owner, text, links in blocks:
            size[owner] += len(text)
            linked[owner] += links
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        for owner, text, _ in blocks:
            if len(text) < MIN_PARAGRAPH or self.tag[owner] in HEADINGS:
                continue
            worth = 1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)
            points[self.parent[owner] if self.tag[owner] in PARAGRAPHS else owner] += worth
        # each level passes on a share of all it has, so a page is one pass whatever its depth
        for i in range(n - 1, 0, -1):
            points[self.parent[i]] += PASSED_ON * points[i]
        if not any(points):
            return [text for _, text, _ in blocks]

        def density(i: int) -> float:
            return linked[i] / size[i] if size[i] else 0.0

        score = [p * (GOOD_WEIGHT if self.good[i] else 1) * (1 - density(i)) for i, p in enumerate(points)]
        best = max(range(n), key=lambda i: (score[i], -i))
        taken = {best}
        reading = {o for o, t, _ in blocks if SENTENCE_END.search(t)}
        over = self.parent[best]
        if over > 0 and self.tag[best] not in ("body", "html"):
            need = max(SIBLING_FLOOR, SIBLING_SHARE * score[best])
            for i in range(over + 1, n):
                if self.parent[i] != over or i == best or out[i] or not size[i]:
                    continue
                reads = self.tag[i] in ("p", "blockquote", "pre") and (size[i] > LONG_SIBLING and density(i) < 0.25 or density(i) == 0 and i in reading)
                title = self.tag[i] in HEADINGS and density(i) < 0.25
                if score[i] >= need or reads or title:
                    taken.add(i)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in taken or i > 0 and inside[self.parent[i]]
        # lists and boxes of links inside the article are menus
        prose = [False] * n
        for owner, text, links in blocks:
            if len(text) >= LONG_SIBLING and links < 0.3 * len(text):
                node = owner
                while node >= 0 and not prose[node]:
                    prose[node] = True
                    node = self.parent[node]
        n_links = [0] * n
        for i in range(n - 1, 0, -1):
            n_links[i] += self.tag[i] == "a"
            n_links[self.parent[i]] += n_links[i]
        menu = [False] * n
        for i in range(1, n):
            boxed = self.tag[i] in ("ul", "ol", "div", "section", "table", "dl") and i not in taken
            menu[i] = menu[self.parent[i]] or boxed and not prose[i] and n_links[i] >= 3 and density(i) > LINK_LIST_SHARE
        return [text for owner, text, _ in blocks if inside[owner] and not menu[owner]]


def main_text(source: str | None) -> str:
    """The main text of one page; empty for null, empty and text-less pages."""
    return Page(source).main_text() if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks keep page order and are joined by an empty line; nothing is capped. Null or empty html gives the empty
    text; null ids and urls and repeated rows are kept as they are; other columns are ignored. Nothing is shuffled.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
