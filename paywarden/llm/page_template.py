"""Main text of web pages by deducing each host's template from token equivalence classes.

A page is a sequence of tag tokens, told apart by the tag around them, and of text
tokens: the blocks of text, told apart by the tag around them and by hash. Tokens
with the same occurrence vector over the distinct pages of a host form an equivalence
class; the vector is compared by an order-free hash sum, so no host's pages ever meet
in one task. The class of tokens that occur once in every page is the template's
frame; other classes are valid when they have two tokens on half the pages.

The content element of a host is the outermost one that tags or word lists call an
article, if pages have one outside menus and the like. Where there is none, classes
decide: of the elements of valid classes the innermost one that holds more than half of
the host's distinct text, words of links not counted. Text in it is data: what lies in
elements that word lists call a menu, an advert and the like goes, and so does text of
the frame, or that comes and goes with a tag, in a marked element that never holds
anything else, as long as most of the page's content stays. A host of fewer than three
distinct pages, or a page that breaks the order of the frame, shows no template and is
read by the word lists alone.

The word lists are fixed values.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import blank, written

RAW = "script style noscript template iframe object svg math canvas audio video textarea select title".split()
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("head nav header footer aside form menu dialog button fieldset".split())
MAIN = {"article", "main"}
ROLES = {"main": True, "article": True, "navigation": False, "banner": False, "contentinfo": False, "complementary": False,
         "search": False, "form": False, "dialog": False, "alert": False, "menu": False, "menubar": False}
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar widget menu navbar nav "
    "navigation breadcrumb breadcrumbs pagination pager header masthead footer cookie cookies consent gdpr notice "
    "notification banner popup modal alert disclaimer comment comments disqus reply replies respond share sharing social "
    "newsletter subscribe subscription related recommended login signup search".split()
)
MAIN_WORDS = set("article-body article-content entry-content post-content post-body story-body main-content".split())
# An open element of these kinds ends where the next of a kind that cannot lie in it begins.
ENDS = {"p": INLINE | {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
IN_P = set("button map object ins del".split()) | INLINE

# Elements whose text is the author's when they carry no class.
PLAIN = set("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption address article main body html".split())

# A tag whose quotes hold no angle bracket: a try ends at the next bracket and never goes back, so tries are linear together.
_USUAL = re.compile(r"<(/?)([a-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>", re.I)
_NAME = re.compile(r"(/?)([a-z][^\s/<>]*)", re.I)
_RAW = re.compile("(?:" + "|".join(RAW) + r")\b", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class _Ends:
    """Where tags of a page end: the first `>` outside quotes. Marks are looked at once, however many tags stay open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.known: dict[int, int] = {}
        self.at: dict[str, list[int]] | None = None

    def _next(self, kind: str, start: int) -> int:
        if self.at is None:
            marks = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.at = {"any": marks} | {c: [k for k in marks if self.page[k] == c] for c in ">\"'"}
        places = self.at[kind]
        k = bisect_left(places, start)
        return places[k] if k < len(places) else -1

    def plain(self, start: int) -> int:
        return self.page.find(">", start) if start <= self.last else -1

    def tag(self, start: int) -> int:
        """The end of a tag whose attributes begin at `start`, -1 if it has none."""
        page, end = self.page, self.plain(start)
        # Short cut for pages whose quotes are all closed inside tags that end.
        if end < 0 or self.at is None and page.find('"', start, end) < 0 and page.find("'", start, end) < 0:
            return end
        trail, end = [], -1
        while (mark := self._next("any", start)) >= 0:
            if mark in self.known:
                end = self.known[mark]
                break
            trail.append(mark)
            if page[mark] == ">":
                end = mark
                break
            close = self._next(page[mark], mark + 1)
            if close < 0:
                break
            start = close + 1
        self.known.update(dict.fromkeys(trail, end))
        return end


def page_tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, closing, attributes) of the tags of a page, in order; what holds no text of its own has an empty name, comments None."""
    ends, at = None, page.find("<")
    while at >= 0:
        if m := _USUAL.match(page, at):
            name, end = m[2].lower(), m.end()
            if not m[1] and (raw := _RAW.match(name)):
                close = _RAW_END[raw[0]].search(page, end - 1)
                name, end = "", close.end() if close else len(page)
            yield at, end, name, bool(m[1]), m[3]
            at = page.find("<", end)
            continue
        ends = ends or _Ends(page)
        name, closing, attrs, end = None, False, "", -1
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(mark, at + len(mark) + 1)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = ends.plain(at) + 1
        elif m := _NAME.match(page, at + 1):
            stop = ends.tag(m.end())
            if stop >= 0 and not m[1] and (raw := _RAW.match(page, at + 1)):
                close = _RAW_END[raw[0].lower()].search(page, stop)
                name, end = "", close.end() if close else len(page)
            elif stop >= 0:
                name, closing, attrs, end = m[2].lower(), bool(m[1]), page[m.end() : stop], stop + 1
        if end > 0:
            yield at, end, name, closing, attrs
        at = page.find("<", end if end > 0 else at + 1)


# One attribute: its whole name, then its value.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Distinct pages of a host that show a template.
HOST_PAGES = 3
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^a-z0-9]+")


def _label(name: str, attrs: str) -> tuple[str, bool | None]:
    """The token's name with its classes, and whether by itself it is main (True), outside (False) or neither."""
    if not attrs or not attrs.strip():
        return name, True if name in MAIN else False if name in OUTSIDE else None
    label, kind = name, True if name in MAIN else False if name in OUTSIDE else None
    words: list[str] = []
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden":
            return name, False
        if key == "role" and value in ROLES:
            kind = ROLES[value]
        elif key == "itemprop" and value == "articlebody":
            kind = True
        elif key in ("class", "id"):
            words += value.split()
    if name in MAIN and any(w in OUTSIDE_WORDS for w in words):
        kind = False
    elif words and name not in ("html", "body") and kind is not True:
        if any(w in MAIN_WORDS for w in words):
            kind = True
        elif any(p in OUTSIDE_WORDS for w in words for p in _PART.split(w)):
            kind = False
    return ".".join([label, *words]), kind


def page_events(page: str) -> Iterator[tuple[str, str, bool | None]]:
    """("open", key, kind), ("close", key, None), ("break", "", None) and ("text", text, linked) in page order.

    A key is a tag token within the tag around it. Tags that cannot lie in an open
    one end it, and a closing tag without an open one is nothing.
    """
    stack: list[tuple[str, str]] = []
    still_open: Counter[str] = Counter()
    at, links = 0, 0

    def end(k: int):
        while len(stack) > k:
            name, key = stack.pop()
            still_open[name] -= 1
            yield "close", key, None

    for start, stop, name, closing, attrs in page_tags(page):
        if start > at:
            yield "text", page[at:start], links > 0
        at = stop
        if not name:
            if name == "":
                yield "text", " ", False
            continue
        if name in INLINE:
            if name == "br":
                yield "text", " ", False
            elif name == "a":
                links = 0 if closing else 1
            continue
        if closing:
            if still_open[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                yield from end(k)
            yield "break", "", None
            continue
        if stack and stack[-1][0] == "p" and name not in IN_P or stack and name in ENDS.get(stack[-1][0], ()):
            yield from end(len(stack) - 1)
        label, kind = _label(name, attrs)
        key = f"{stack[-1][1].rpartition('>')[2] if stack else ''}>{label}"
        if name in VOID:
            yield "break", "", None
            continue
        stack.append((name, key))
        still_open[name] += 1
        yield "open", key, kind
    if at < len(page):
        yield "text", page[at:], links > 0
    yield from end(0)


def page_blocks(page: str) -> Iterator[tuple[str, str, bool | int | None]]:
    """page_events with the text of each block in one piece: white space becomes one blank, blank blocks go.

    A block comes with about the number of its characters that are not a link's.
    """
    parts: list[tuple[str, bool]] = []

    def text():
        if parts and (whole := _SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()):
            linked = sum(len(p) for p, of_link in parts if of_link)
            yield "text", whole, len(whole) if not linked else max(0, len(whole) - linked)
        parts.clear()

    for event in page_events(page):
        if event[0] == "text":
            parts.append((event[1], bool(event[2])))
        else:
            yield from text()
            yield event
    yield from text()


def text_key(around: str, text: str) -> str:
    """The token of a block of text within the tag around it; no tag key holds a "#" of its own first character."""
    return f"#{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}>{around}"


def token_counts(page: str) -> list[tuple[str, int, int, bool | None, int, list[str] | None]]:
    """(key, occurrences, place of the first, kind, characters, elements around) of the open tags and blocks of text.

    "#" stands for the page itself; only text has characters, of links none, and elements
    around it. An element inside a menu and the like is no article, whatever it is called.
    """
    seen: dict[str, list] = {"#": [1, 0, None, 0, None]}
    place = 0
    # Per open element: its key, the distinct keys from the page to it once a text asks, and whether it lies in a menu and the like.
    stack: list[list] = [["", {"#": None}, False]]

    def around() -> dict:
        k = len(stack) - 1
        while stack[k][1] is None:
            k -= 1
        for j in range(k + 1, len(stack)):
            key, above = stack[j][0], stack[j - 1][1]
            stack[j][1] = above if key in above else above | {key: None}
        return stack[-1][1]

    for what, key, kind in page_blocks(page):
        if what == "open":
            place += 1
            barred = stack[-1][2]
            stack.append([key, None, barred or kind is False])
            seen.setdefault(key, [0, place, None if barred and kind else kind, 0, None])[0] += 1
        elif what == "close":
            stack.pop()
        elif what == "text":
            place += 1
            of_text = text_key(stack[-1][0], key)
            if of_text not in seen:
                seen[of_text] = [0, place, None, kind, list(around())]
            seen[of_text][0] += 1
    return [(k, *v) for k, v in seen.items()]


def main_text(
    page: str, frame: list[str] | None, main: list[str] | None, outside: list[str] | None,
    content: str | None = None, fixed: list[str] | None = None,
) -> str:
    """The main text of a page under its host's template: frame tokens in order, and those that are main or outside.

    `content` is the element that holds the main text, `fixed` the text tokens of the
    template. A page that breaks the order of the frame, or lacks the main token, is
    read by its own tags. White space of a block becomes one blank; blocks are
    joined by line feeds.
    """
    events = list(page_blocks(page))
    known_outside = set(outside or ())
    opened = Counter(k for what, k, _ in events if what == "open")
    ordered = set(frame or ()) & set(opened)
    in_order = [k for k in opened if k in ordered] == [k for k in frame or () if k in ordered] and all(opened[k] == 1 for k in ordered)
    decided = in_order and content in opened
    wanted = {content} if decided else set(main or ())
    template = set(fixed or ()) if decided else set()
    if not in_order or not wanted & set(opened):
        wanted = {k for what, k, kind in events if what == "open" and kind}
    blocks: list[tuple[str, bool]] = []
    inside, barred = 0, 0
    stack: list[tuple[str, int, int]] = []
    for what, key, kind in events:
        if what == "text":
            if not barred and (inside or not wanted):
                blocks.append((key, bool(template) and text_key(stack[-1][0] if stack else "", key) in template))
        elif what == "open":
            stack.append((key, inside, barred))
            is_main = key in wanted
            if is_main and decided:
                barred = 0  # the classes, not what lies around the element, say that it is main
            inside, barred = inside + is_main, barred + (not is_main and (kind is False or key in known_outside))
        elif what == "close":
            _, inside, barred = stack.pop()
    # The template's own words are the lesser part of a page's content, or they are no template.
    if 2 * sum(len(t) for t, own in blocks if own) < sum(len(t) for t, _ in blocks):
        blocks = [b for b in blocks if not b[1]]
    return "\n".join(t for t, _ in blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; the empty text for a null or odd one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


TOKENS = "host string, mark long, key string, n int, place int, kind boolean, chars long, around array<string>"


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
    for batch in batches:
        rows: tuple[list, ...] = tuple([] for _ in types)
        for host, mark, page in zip(*(c.to_pylist() for c in batch.columns)):
            for token in token_counts(page):
                for column, value in zip(rows, (host, mark, *token)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], [f.split()[0] for f in TOKENS.split(", ")])


def host_templates(pages: DataFrame) -> DataFrame:
    """One row per host: frame, main and outside tokens of its template, the content element and fixed texts.

    The occurrence vector of a token is summed up as the sum of a hash of (page,
    occurrences), so pages are combined before the shuffle and a host with a third
    of all pages costs no more than its distinct tokens. Exact copies are one page. The
    frame is the class of the page itself: tokens that occur once in every page, in the
    order of their mean place. A tag of any other class belongs to the template when
    half the pages have it.
    """
    marked = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("mark"), blank("html").alias("html"))
    counts = marked.mapInArrow(_count_tokens, TOKENS).dropDuplicates(["host", "mark", "key"])
    vectors = written(
        counts.groupBy("host", "key").agg(
            F.sum(F.xxhash64("mark", "n").cast("decimal(38,0)")).alias("vector"), F.count("*").alias("pages"),
            F.avg("place").alias("place"), F.max("n").alias("most"), F.max("kind").alias("kind"),
            F.max("chars").alias("chars"), F.max("around").alias("around"),
        )
    )
    is_text = F.col("around").isNotNull()
    whole = vectors.where("key = '#'").select("host", F.col("vector").alias("whole"), F.col("pages").alias("all_pages"))
    # Text that few pages have is in no class of the template.
    common = vectors.where(~is_text | (F.col("pages") >= HOST_PAGES)).join(whole, "host").where("key <> '#' AND 2 * pages >= all_pages")
    classes = common.groupBy("host", "vector").agg(F.count("*").alias("tokens"), F.count(F.when(~is_text, 1)).alias("tags"))
    token = written(common.join(classes, ["host", "vector"]).withColumn("in_frame", F.col("vector") == F.col("whole")))
    # The template's text: in a marked element that holds no slot anywhere on the host.
    tag = F.regexp_replace("key", "^#[0-9a-f]+>", "")
    own = is_text & (F.col("in_frame") | (F.col("tags") > 0)) & (F.col("all_pages") >= HOST_PAGES)
    fixed = token.where(own & ~F.element_at(F.split(tag, ">"), -1).isin(*PLAIN)).select("host", "key", tag.alias("tag"))
    slots = vectors.where(is_text).join(token.where(own).select("host", "key"), ["host", "key"], "left_anti").select("host", tag.alias("tag")).distinct()
    fixed = fixed.join(slots, ["host", "tag"], "left_anti").groupBy("host").agg(F.collect_list("key").alias("fixed"))
    # Characters of distinct text inside each element; "#" has those of the host.
    mass = vectors.where(is_text).select("host", F.explode("around").alias("key"), "chars").groupBy("host", "key").agg(F.sum("chars").alias("mass"))
    total = mass.where("key = '#'").select("host", F.col("mass").alias("total"))
    sole = ~is_text & (F.col("most") == 1) & (F.col("all_pages") >= HOST_PAGES)
    by_class = (F.col("in_frame") | (F.col("tokens") > 1)) & F.expr("2 * mass > total AND kind IS NULL")
    holds = (
        token.where(sole & F.coalesce("kind", F.lit(True))).join(mass, ["host", "key"]).join(total, "host").where((F.col("kind") & (F.col("mass") > 0)) | by_class)
        .groupBy("host").agg(F.coalesce(F.min_by("key", F.when(F.col("kind"), F.col("place"))), F.max_by("key", "place")).alias("content"))
    )
    ordered = F.sort_array(F.collect_list(F.when(F.col("in_frame") & ~is_text, F.struct("place", "key"))))
    return token.groupBy("host").agg(
        F.transform(ordered, lambda x: x["key"]).alias("frame"),
        F.collect_list(F.when(F.col("kind"), F.col("key"))).alias("main"),
        F.collect_list(F.when(~F.col("kind"), F.col("key"))).alias("outside"),
    ).join(holds, "host", "left").join(fixed, "host", "left")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, url, *rest = (c for c in batch.columns)
        texts = [main_text(*row) for row in zip(*(c.to_pylist() for c in rest))]
        yield pa.RecordBatch.from_arrays(
            [ids, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`; a null page has no text, a null url no host of its own."""
    templates = written(host_templates(pages))
    of_page = pages.select("page_id", "url", blank("html").alias("html"), host_of(F.col("url")).alias("host"))
    # Templates grow with the hosts: Spark sends them to all tasks while they are small and shuffles both sides beyond that.
    rows = of_page.join(templates, "host", "left").select("page_id", "url", "html", "frame", "main", "outside", "content", "fixed")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
