r"""Operator 6, HTML extraction with a tree-structured graphical model over the DOM.

Every block element is a node that is content or not.  A node's features (tag, role words of class and id, length and link
share of its own text, sentence ends) have likelihoods in each class, and a child's class depends on its parent's by a
potential for its kind (container, section or text block).  Messages are passed up from the leaves and down from the root
(sum-product, exact on a tree), and blocks whose content marginal is over one half are kept, whole.

Both kinds of potentials are counted on labelled pages: a bounded sample of the pages that mark their article, where nodes
inside it are content, except below menus, notices and the like.  A prior adds counts, so that templates without a labelled
page are read by their roles, text and neighbours.  What a mark as a menu, notice or form says is bounded, and a frame around
most of the page's text is not taken for one.  The labels of the sample use the same marks.  What is hidden, by the attribute or by
its style, is no text of the page; nor is readers' talk, by names that say nothing else, unless it is most of a page without an article.

Text of svg, select and template is no text of the page; without an end tag only their tag is passed over. Formulas and what
object, canvas, audio and video hold are text where they stand.

Blocks: character references are decoded, white space becomes one space, the ends are trimmed; blocks are joined by
``\n\n`` in page order.  Null and empty pages, and pages without content, give the empty string.  Repeated rows give equal
rows.  Pages of any length are read whole.  An empty table gives none.  Columns of the input with the names text and n_chars are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bound of the sample of labelled pages: those of the least hash of the html
FIT_PAGES = 2000
#: Count that the prior adds to features of texts and their sections; bound of what one learned feature may say
PRIOR, CLIP = 40.0, 4.0
#: Counts that the prior adds for nodes marked as a menu, notice, form and so on, and for children of them; bound of what the mark may say
MARKED, STRONG = 400.0, 9.0

# Fixed sets of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
UNREAD = frozenset("svg select template".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math object q rb rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
CONTAINER = frozenset("div section center table tbody thead tfoot tr td th ul ol dl main body html figure details".split())
SECTION = frozenset("article nav header footer aside form menu dialog fieldset address head button".split())
CLOSES_P = CONTAINER | SECTION | frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote hr li dt dd figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table".split())
# Fixed role words of class and id names.
AWAY = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended form search pagination pager copyright legal disclaimer skip toolbar complementary contentinfo".split())
AWAY_STARTS = ("advert", "breadcrumb", "cookie", "footer", "navi", "newsletter", "promo", "sidebar", "sponsor", "subscri")
AWAY_ENDS = ("banner", "footer", "menu", "nav", "sidebar")
HEADERS = frozenset("header masthead".split())
#: A name is of readers' talk if all its words are here and one of them is in TALK
TALK = frozenset("comment comments commentlist disqus replies".split())
TALKING = TALK | frozenset("area body box block child children container content item list main parent reader readers reply section text the thread user users view wrap wrapper".split())
WEAK = frozenset("ad ads share social related search form side legal alert notice notices header".split())
TOWARD = frozenset("article content main post entry story body text prose page".split())
AWAY_TAGS = frozenset("nav aside form menu dialog fieldset footer head button".split())

OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
STOPS = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORD = re.compile(r"[a-z]+")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
SENTENCE = re.compile(r"[.!?…:;]\s*$|[.!?…]\s")


class Tags:
    """The tags of a page one after another: start, end, whether it closes, name (empty for comments and the like), attributes.

    A quoted value runs to its quote.  Where that leaves no end of the tag, it ends at the next ``>``.  Quotes that have led to no end
    once aren't followed again, so the time is linear in the page.
    """

    def __init__(self, source: str) -> None:
        self.source, self.last, self.lost = source, source.rfind(">"), set()

    def end(self, at: int) -> int:
        """Behind the ``>`` that ends a tag whose name ends at ``at``; ``at`` lies before the last one of the page."""
        met, k = [], at
        while (stop := STOPS.search(self.source, k)) and stop.start() not in self.lost:
            if stop[0] == ">":
                return stop.end()
            met.append(stop.start())
            k = self.source.find(stop[0], stop.end()) + 1
            if not k:
                break
        self.lost.update(met)
        return self.source.index(">", at) + 1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        source = self.source
        while m := OPENS.search(source, at):
            if m[1]:
                end = source.find("-->", m.end())
                return m.start(), len(source) if end < 0 else end + 3, False, "", ""
            if m[2]:
                end = source.find(">", m.end())
                return m.start(), len(source) if end < 0 else end + 1, False, "", ""
            if m.end() > self.last:
                return None  # no tag ends any more: text
            end = self.end(m.end())
            return m.start(), end, bool(m[3]), m[4].lower(), source[m.end() : end - 1]
        return None


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag by name in lower case, the first of equal ones."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


@dataclass
class Page:
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    role: list[int] = field(default_factory=lambda: [0])
    size: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    ends: list[bool] = field(default_factory=lambda: [False])
    #: whether a node holds most of the page's text outside links, itself and below
    most: list[bool] = field(default_factory=list)
    #: node and text of each block in page order
    blocks: list[tuple[int, str]] = field(default_factory=list)


def role_of(tag: str, text: str) -> int:
    """1 toward content, -1 away from it, -2 if only because it is a header, -3 if a name joins a word of several meanings to others, -4 of readers' talk, -5 hidden."""
    if not text or tag in ("body", "html"):
        return 0
    have = attributes_of(text)
    if "hidden" in have or UNSEEN.search(have.get("style", "")):
        return -5
    names = [n for key in ("class", "id", "role") for n in have.get(key, "").lower().split()]
    parts = [set(WORD.findall(n)) for n in names]
    if any(x & TALK and x <= TALKING for x in parts):
        return -4
    if tag in ("article", "main"):
        return 0
    away = [x for x in parts if x & (AWAY - HEADERS) or any(w.startswith(AWAY_STARTS) or w.endswith(AWAY_ENDS) for w in x)]
    if away:
        if all(x & TOWARD for x in away):  # a frame of the content and something beside it
            return 0
        return -3 if all(len(x) > 1 and x & WEAK for x in away) else -1
    words = set().union(*parts)
    return -2 if words & HEADERS else 1 if words & TOWARD else 0


def end_of_raw(name: str, source: str, at: int) -> int:
    stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
    return stop.end() if stop else len(source)


def ends_of_unread(source: str) -> dict[int, int]:
    """Where the drawings, choices and templates of a page start and end; those without an end tag of their own aren't in it."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in UNREAD}
    tags, at = Tags(source), 0
    while tag := tags.after(at):
        start, at, closes, name, attributes = tag
        if name in RAW and not closes and not attributes.endswith("/"):
            at = end_of_raw(name, source, at)
        elif name in UNREAD and closes and opened[name]:
            found[opened[name].pop()] = at
        elif name in UNREAD and not closes and not attributes.endswith("/"):
            opened[name].append(start)
    return found


def parse(source: str) -> Page:
    """The tree of block elements and the blocks of text."""
    page = Page()
    stack: list[tuple[str, int]] = [("html", 0)]
    here, links = 0, 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                page.blocks.append((here, text))
                page.size[here] += len(text)
                page.ends[here] |= bool(SENTENCE.search(text))

    def close(upto: int) -> None:
        nonlocal here, links
        for name, node in stack[upto:]:
            if node >= 0:
                flush()
                break
        for name, _ in stack[upto:]:
            links -= name == "a"
        del stack[upto:]
        here = next(node for _, node in reversed(stack) if node >= 0)

    closed = None
    tags, at, end = Tags(source), 0, len(source)
    while at < end:
        tag = tags.after(at)
        piece = source[at : tag[0] if tag else end]
        if piece:
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            if links:
                page.linked[here] += len(text)
        if not tag:
            break
        start, at, closes, name, attributes = tag
        if not name:
            continue
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in VOID:
            if name in ("br", "hr", "img"):
                parts.append(" ")
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                at = end_of_raw(name, source, at)
            continue
        if name in UNREAD:
            if closed is None:
                closed = ends_of_unread(source)
            at = closed.get(start, at)
            continue
        if name in INLINE:
            stack.append((name, -1))
            links += name == "a"
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][1] >= 0:
                    break
        if name in CLOSED_BY:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSED_BY[name]:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        flush()
        page.parent.append(here)
        page.tag.append(name)
        page.role.append(role_of(name, attributes))
        for column, value in ((page.size, 0), (page.linked, 0), (page.ends, False)):
            column.append(value)
        here = len(page.tag) - 1
        stack.append((name, here))
    flush()
    plain = [size - linked for size, linked in zip(page.size, page.linked, strict=True)]
    for i in range(len(plain) - 1, 0, -1):
        plain[page.parent[i]] += max(plain[i], 0)
    page.most = [2 * x > plain[0] for x in plain]
    marked = any(page.tag[i] in ("article", "main") and page.role[i] > -4 for i in range(len(page.tag)))
    for i in range(1, len(page.tag)):  # all of what is hidden is hidden, and all of a talk is talk
        if page.role[i] == -4 and page.most[i] and not marked:
            page.role[i] = 0
        page.role[i] = min(page.role[i], page.role[page.parent[i]]) if page.role[page.parent[i]] <= -4 else page.role[i]
    return page


def kind(tag: str) -> int:
    return 0 if tag in CONTAINER else 1 if tag in SECTION else 2


def feature_names(page: Page, i: int) -> list[str]:
    tag = page.tag[i]
    marked = away(page, i)
    role = page.role[i]
    out = [("role -4" if role <= -4 else "role -1") if marked and tag not in AWAY_TAGS else "role -3" if role == -3 else f"role {max(role, 0)}"]
    if tag in SECTION and tag != "header":
        if marked or tag not in AWAY_TAGS:
            out.append(f"tag {tag}")
    elif tag not in CONTAINER and tag != "li":
        out.append(f"tag {'h' if tag[0] == 'h' else 'p' if tag == 'p' else 'other'}")
    if size := page.size[i]:
        out.append(f"text {min(3, size // 40)} {min(3, int(4 * page.linked[i] / size))} {int(page.ends[i])}")
    return out


def _up(page: Page, i: int) -> Iterator[int]:
    while (i := page.parent[i]) >= 0:
        yield i


def away(page: Page, i: int) -> bool:
    """Whether a node is marked as something other than text, by its tag or role words.

    A frame around most of the page's text is no menu, form or notice, whatever its name.
    """
    tag = page.tag[i]
    if page.role[i] <= -4:
        return True
    if page.most[i]:
        return False
    if page.role[i] == -1 or tag in AWAY_TAGS:
        return True
    return (tag == "header" or page.role[i] == -2) and not any(page.tag[j] in ("article", "main") for j in _up(page, i))


def link(page: Page, i: int) -> str:
    """The potential between a node and its parent."""
    p = page.parent[i]
    return f"{kind(page.tag[i])} {2 if page.role[p] <= -4 else int(away(page, p))}"


def known_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks one article: inside it, and not below something that isn't text of it."""
    if sum(t in ("article", "main") for t in page.tag) != 1:
        return None
    out = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        p = page.parent[i]
        out[i] = int((page.tag[i] in ("article", "main") or out[p] == 1) and not away(page, i))
    return out


@dataclass
class TreeModel:
    """Log-likelihood ratios of features, and P(child is content | parent is not, is) by kind of child and parent."""

    ratio: dict[str, float]
    given: dict[str, tuple[float, float]]

    @staticmethod
    def of(counts: dict[str, tuple[float, float]]) -> TreeModel:
        known = {k: list(v) for k, v in counts.items()}
        texts = [(f"text 3 0 {e}", 1) for e in (0, 1)] + [(f"text {n} {k} 0", 0) for n in range(4) for k in (2, 3)]
        strong = {"role -1", "role -4", *(f"tag {t}" for t in AWAY_TAGS)}
        for name, label, count in [(x, 1, PRIOR) for x in ("role 1", "tag article", "tag main", "tag p", "tag h")] + [(*x, PRIOR) for x in texts] + [(x, 0, MARKED) for x in strong] + [("role -3", 0, PRIOR)]:
            known.setdefault(name, [0.0, 0.0])[label] += count
        families: dict[str, list[float]] = {}
        for name, pair in known.items():
            family = families.setdefault(name.split()[0], [0.0, 0.0])
            for label in (0, 1):
                family[label] += pair[label] - MARKED * (name in strong and label == 0)  # what the prior says of marks is of nodes with marks
        ratio = {}
        for name, (a, b) in known.items():
            n0, n1 = families[name.split()[0]]
            if not name.startswith("given"):
                bound = STRONG if name in strong else CLIP
                ratio[name] = max(-bound, min(bound, math.log((b + 0.5) / (n1 + 1)) - math.log((a + 0.5) / (n0 + 1))))
        given = {}
        for k in range(3):
            pair = []
            for parent, (few, all_) in enumerate(((1.0, 40.0), (8.0, 10.0))):
                a, b = known.get(f"given {k} 0 {parent}", (0.0, 0.0))
                pair.append((b + few) / (a + b + all_))
            given[f"{k} 0"] = min(pair[0], 0.2), max(pair[1], 0.7)
            a, b = known.get(f"given {k} 1 0", (0.0, 0.0))
            low = max((b + 0.05) / (a + b + MARKED), math.exp(-STRONG))
            given[f"{k} 1"] = low, max(low, 0.02)  # texts in a marked frame say little for it
            given[f"{k} 2"] = math.exp(-STRONG), math.exp(-STRONG)
        return TreeModel(ratio, given)

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of being content, by sum-product."""
        n = len(page.tag)
        ratio = self.ratio
        up = [sum(ratio.get(f, 0.0) for f in feature_names(page, i)) for i in range(n)]
        sent = [0.0] * n
        links = ["", *(link(page, i) for i in range(1, n))]
        for i in range(n - 1, 0, -1):
            q0, q1 = self.given[links[i]]
            e = math.exp(max(-80.0, min(80.0, up[i])))
            sent[i] = math.log((q1 * e + 1 - q1) / (q0 * e + 1 - q0))
            up[page.parent[i]] += sent[i]
        up[0] += math.log(0.02 / 0.98)
        for i in range(1, n):
            q0, q1 = self.given[links[i]]
            d = math.exp(max(-80.0, min(80.0, up[page.parent[i]] - sent[i])))
            up[i] += math.log((q1 * d + q0) / ((1 - q1) * d + 1 - q0))
        return up


def extract(source: str, model: TreeModel) -> str:
    page = parse(source)
    odds = model.marginals(page)
    return "\n\n".join(text for node, text in page.blocks if odds[node] > 0)


def train(pages: DataFrame, column: str = "html") -> TreeModel:
    """Counts the potentials on the bounded sample of labelled pages."""
    marked = pages.where(F.col(column).rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64(column).alias("h"))
    ids = marked.distinct().orderBy("h").limit(FIT_PAGES)
    sample = pages.select(F.col(column).alias("html"), F.xxhash64(column).alias("h")).join(F.broadcast(ids), "h").dropDuplicates(["h"]).select("html")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for x in batch.column(0).to_pylist():
                page = parse(x)
                label = known_labels(page)
                if label is None:
                    continue
                for i in range(1, len(label)):
                    for f in (*feature_names(page, i), f"given {link(page, i)} {label[page.parent[i]]}"):
                        found.setdefault(f, [0, 0])[label[i]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (0, 1))], ["feature", "a", "b"])

    rows = sample.mapInArrow(counted, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return TreeModel.of({r.feature: (r.a, r.b) for r in rows})


def html_text(pages: DataFrame, column: str = "html", model: TreeModel | None = None) -> DataFrame:
    """Adds text and n_chars (code points) to the columns of ``pages`` without ``column``."""
    model = model or train(pages, column)
    rest = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    source = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column(len(rest)), "")
            step = 512
            for a in range(0, len(column), step):
                out = pa.array([extract(x.as_py(), model) for x in column.slice(a, step)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(a, step).columns[:-1], out, pc.cast(pc.utf8_length(out), pa.int64())], [*rest, "text", "n_chars"])

    return source.mapInArrow(run, StructType([*(source.schema[c] for c in rest), StructField("text", StringType()), StructField("n_chars", LongType())]))
