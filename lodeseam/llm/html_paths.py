"""HTML extraction by tag-path ratios.

A page is read as a stream of tags and texts.  Every text stands on a root-to-leaf path of tags; for each path the
page's text length, words inside links and punctuation marks are summed.  A path's ratio (text length for each text
node), smoothed with the ratios of the paths that share its parent, and its punctuation for each text are fused by
multiplication; paths whose fused value reaches the page's threshold (a share of the length-weighted mean) are
content, and a short path (such as a heading) between content nodes of the same parent is content with them.
A path inside an ``article`` or ``main`` element counts one more punctuation mark for each text: its fused value is
raised, and decides like any other.

Out before that are texts on paths through an element that never holds an article (navigation, header and footer of the
page, forms, scripts), that is hidden, or whose class, id or role has a word for menus, adverts, notices, sidebars or
comments (unless ``has``, ``with``, ``no`` or the like stands before the word; ``article`` and ``main`` are never out by
their names, and ``main`` is not by its ancestors' either); and what follows a heading that says no more than
"comments", up to the end of the heading's parent or to the next heading of its rank.

The reader passes over the page once, with a constant number of steps for each tag, in any nesting.  An attribute's
value is quoted only after an equals sign; a quote that nothing closes ends with the tag.  A comment, and a script,
style, textarea or title, that nothing closes reaches to the end of the page, and so does a tag, as in browsers.

Output: character references are decoded, white space within a block becomes one space, blocks are trimmed and
joined in page order by two newlines (``joined_by``).

Defined results: null html gives an empty text; unclosed and stray tags are repaired as browsers do for paragraphs,
list items and table cells; a page without content gives an empty text; repeated rows are read alike, each by itself;
an empty table gives an empty result; other columns pass through, a clashing ``main_text`` (in any case) is replaced.
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
from pyspark.sql import types as T

from lodeseam.session import ship_package, small_batches

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"\s+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_NAME_WORDS = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
# Elements whose text is not markup, and is never content.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "xmp", "noembed"}
# Those that reach to the end of the page where no end tag follows; of others the start tag alone is skipped.
TO_END = {"script", "style", "textarea", "title"}
# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that begin a block.
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Elements that never hold an article's text.
OUT = {"nav", "footer", "aside", "form", "head", "menu", "button", "select", "option", "dialog", "search", "label", "input", "fieldset"} | RAW
# Words of class, id and role names that tell the same.
OUT_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "foot", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "respond", "reply", "replies", "widget", "pagination", "pager", "search", "copyright", "disclaimer", "complementary", "contentinfo", "dialog", "alert", "alertdialog", "tags", "hidden"}
# What an end of the paragraph, item or cell is implied by.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "menu", "div", "article", "section", "main", "body", "td", "th", "blockquote"}
# Words before one of those that take its meaning away.
NEGATING = {"has", "have", "with", "no", "not", "without", "show", "hide", "enable", "enabled", "is"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What a heading over reader comments says, beside a number.
COMMENT_TITLES = {"comments", "comment", "reader comments", "readers comments", "user comments", "leave a comment", "post a comment", "kommentare", "leserkommentare", "commentaires", "comentarios", "commenti", "reacties"}
PUNCTUATION = ".,;:!?。，、！？；：…"
THRESHOLD = 0.25


def _out_by_names(attributes: dict[str, str]) -> bool:
    for name in ("class", "id", "role"):
        if value := attributes.get(name):
            words = _NAME_WORDS.split(_HUMP.sub(r"\1-\2", value).lower())
            if any(w in OUT_NAMES and (i == 0 or words[i - 1] not in NEGATING) for i, w in enumerate(words)):
                return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return attributes.get("hidden", "false").lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(attributes.get("style", "")) is not None


class _Reader:
    """One pass over a page.  Paths are numbered: ``parent`` and ``leaf`` give a path's parent and last tag."""

    def __init__(self, page: str) -> None:
        self.page, self.end = page, len(page)
        self.parent, self.leaf = [-1], [""]
        self._numbers: dict[tuple[int, str], int] = {}
        self._unclosed: set[str] = set()  # quotes and raw elements that nothing closes from here on

    def child(self, path: int, tag: str) -> int:
        key = (path, tag)
        if key not in self._numbers:
            self._numbers[key] = len(self.leaf)
            self.parent.append(path)
            self.leaf.append(tag)
        return self._numbers[key]

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes of a tag from ``at`` on, and the place after it (past the end for a tag without one)."""
        page, found = self.page, {}
        while True:
            at = _GAP.match(page, at).end()
            if at >= self.end:
                return found, self.end + 1
            if page[at] == ">":
                if page[at - 1] == "/":
                    found["/"] = ""
                return found, at + 1
            m = _ATTRIBUTE.match(page, at)
            name, value, at = m[0].lower(), "", m.end()
            if m := _EQUALS.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                close = page.find(quote, at + 1) if quote in ("'", '"') and quote not in self._unclosed else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    if quote in ("'", '"'):
                        self._unclosed.add(quote)
                    m = _BARE.match(page, at)
                    value, at = m[0], m.end()
            found.setdefault(name, value)

    def after_raw(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element."""
        close = None if tag in self._unclosed else _RAW_END[tag].search(self.page, at)
        if close:
            past = self.page.find(">", close.end())
            return past + 1 if past >= 0 else self.end
        self._unclosed.add(tag)
        return self.end if tag in TO_END else at

    def blocks(self) -> Iterator[tuple[int, bool, bool, str, int]]:
        """Blocks in page order: path, out, inside an article, text, and its characters inside links."""
        page = self.page
        # Of each open element: tag, path, out by tag, out at all, inside an article, inside a link, nearest block and
        # nearest scope among it and those below.
        stack: list[tuple[str, int, bool, bool, bool, bool, int, int]] = []
        places: dict[str, list[int]] = defaultdict(list)  # of each tag, where in the stack
        root = ("", 0, False, False, False, False, -1, -1)
        parts: list[str] = []
        linked = 0
        begun: tuple[int, bool, bool] | None = None

        def take() -> tuple[int, bool, bool, str, int] | None:
            nonlocal parts, linked, begun
            text = _SPACES.sub(" ", "".join(parts)).strip() if begun else ""
            block = (*begun, text, linked) if text else None
            parts, linked, begun = [], 0, None
            return block

        def cut(size: int) -> None:
            while len(stack) > size:
                places[stack.pop()[0]].pop()

        at = 0
        while at < self.end:
            mark = page.find("<", at)
            while mark >= 0 and not (page[mark + 1 : mark + 2].isalpha() and page[mark + 1] < "\x7f" or page[mark + 1 : mark + 2] in ("/", "!", "?")):
                mark = page.find("<", mark + 1)
            text = page[at : mark if mark >= 0 else self.end]
            if text:
                _, path, _, out, inside, link, _, _ = stack[-1] if stack else root
                if begun is not None and begun[1] and not out:
                    take()  # what is out is of no more use
                if begun is None or begun[1] or not out:  # what is out within a block leaves the block whole
                    bare = text.strip()
                    if bare and begun is None:
                        begun = (path, out, inside)
                    plain = html.unescape(text) if "&" in text else text
                    parts.append(plain)
                    if link and bare:
                        linked += len(plain.strip())
            if mark < 0:
                break
            at = mark + 1
            if page[at] in "!?" or (page[at] == "/" and not _TAG_NAME.match(page, at + 1)):
                comment = page.startswith("!--", at) and not page.startswith((">", "->"), at + 3)
                past = page.find("-->" if comment else ">", at)
                at = self.end if past < 0 else past + (3 if comment else 1)
                continue
            ending = page[at] == "/"
            m = _TAG_NAME.match(page, at + ending)
            tag, at = m[0].lower(), m.end()
            if page[at : at + 1] == ">":
                attributes, at = {}, at + 1
            else:
                attributes, at = self.attributes(at)
            if at > self.end:
                break  # a tag without an end is none
            if tag in BLOCK and (block := take()):
                yield block
            if ending:
                # The nearest open one; an inline element's end does not reach out of a block.
                if places[tag] and (tag in BLOCK or places[tag][-1] > stack[-1][6]):
                    cut(places[tag][-1])
                continue
            if tag == "svg" and "/" in attributes:
                continue
            if tag in RAW:
                at = self.after_raw(tag, at)
                continue
            if tag in VOID:
                continue
            if tag in BLOCK:
                ends = CLOSES.get(tag, frozenset())
                while stack:
                    scope = stack[-1][7]
                    found = [p[i] for t in ("p", *ends) if (p := places[t]) and (i := bisect_right(p, scope)) < len(p)]
                    if found:
                        cut(min(found))
                    elif scope >= 0 and stack[scope][0] in ends:
                        cut(scope)
                    else:
                        break
            _, path, never, out, inside, link, block_at, scope_at = stack[-1] if stack else root
            never = never or tag in OUT or (tag == "header" and not inside) or (bool(attributes) and _hidden(attributes) and tag not in ("html", "body"))
            out = (out and tag != "main") or never or (bool(attributes) and tag not in ("html", "body", "article", "main") and _out_by_names(attributes))
            here = len(stack)
            places[tag].append(here)
            stack.append((tag, self.child(path, tag) if tag in BLOCK else path, never, out, inside or tag in ("article", "main"), link or tag == "a", here if tag in BLOCK else block_at, here if tag in SCOPE else scope_at))
        if block := take():
            yield block

    def without_comments(self, blocks: list[tuple[int, bool, bool, str, int]]) -> Iterator[tuple[int, bool, str, int]]:
        """Of the blocks that aren't out those that stand under no comments' heading: path, inside, text, linked."""
        zone, rank, under = -1, "", {}
        for path, out, inside, text, linked in blocks:
            if out:
                continue
            if zone >= 0:
                up, seen = path, []
                while up not in under and up > zone:
                    seen.append(up)
                    up = self.parent[up]
                below = under.get(up, up == zone)
                under.update(dict.fromkeys(seen, below))
                if below and not (self.leaf[path] in HEADINGS and self.leaf[path] <= rank):
                    continue
                zone = -1
            if self.leaf[path] in HEADINGS and len(text) < 40 and _NAME_WORDS.sub(" ", text.lower()).strip() in COMMENT_TITLES:
                zone, rank, under = self.parent[path], self.leaf[path], {}
                continue
            yield path, inside, text, linked


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def main_text(page: str | None, joined_by: str = "\n\n") -> str:
    if not page:
        return ""
    reader = _Reader(page)
    blocks = list(reader.without_comments(list(reader.blocks())))
    parent, leaf = reader.parent, reader.leaf
    if not blocks:
        return ""
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    raised = set()
    for path, inside, text, linked in blocks:
        if inside:
            raised.add(path)
        s = sums[path]
        s[0] += len(text) - linked
        s[1] += 1
        s[2] += sum(map(text.count, PUNCTUATION))
        s[3] += linked
    raw = {p: s[0] / s[1] for p, s in sums.items()}
    family: dict[int, list[float]] = defaultdict(list)
    for p, r in raw.items():
        family[parent[p]].append(r)
    near = {p: sum(r) / len(r) for p, r in family.items()}
    fused = {}
    for p, s in sums.items():
        smooth = 0.75 * raw[p] + 0.25 * near[parent[p]]
        fused[p] = smooth * (s[2] / s[1] + (p in raised)) * (1 - s[3] / max(1, s[0] + s[3]))
    total = sum(s[0] + s[3] for s in sums.values())
    mean = sum(fused[p] * (s[0] + s[3]) for p, s in sums.items()) / max(1, total)
    good = {p for p, v in fused.items() if v > 0 and v >= THRESHOLD * mean}
    if not good:
        return ""
    parents = {parent[p] for p in good}
    first = next(i for i, (p, *_) in enumerate(blocks) if p in good)
    last = max(i for i, (p, *_) in enumerate(blocks) if p in good)
    kept = []
    for i, (p, _, text, linked) in enumerate(blocks):
        heading = leaf[p] in HEADINGS and parent[p] in parents and i <= last
        between = first < i < last and parent[p] in parents and linked * 2 < len(text)
        if p in good or heading or between:
            kept.append(text)
    return joined_by.join(kept)


def extract_main_text(spark: SparkSession, pages: DataFrame, html_col: str = "html", joined_by: str = "\n\n") -> DataFrame:
    """The other columns of ``pages`` with main_text in place of the html."""
    ship_package(spark)
    small_batches(spark)
    keep = [c for c in pages.columns if c != html_col and c.lower() != "main_text"]
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").alias("main_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), joined_by) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields[:-1], T.StructField("main_text", T.StringType())]))
