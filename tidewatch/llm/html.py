"""Operator 8: main text of HTML pages by two-pass block rules.

A page is cut in blocks at block-level tags, in one pass over its characters. What the page itself says is no article
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments; by tag, role or class name) goes, as
scripts and styles do. No tag says that a block is main text: pass one decides by the density of links, the length and
the density of stop words. Blocks of many links are boilerplate; long ones with enough stop words, and middling ones with many, are
main text. In pass two, blocks that are still ambiguous, most of them short, inherit the label of the nearest decided
blocks; a heading takes that of the next decided block; where two are as near and differ they are boilerplate, and
where no block of the page is decided they are main text.

Defined results: a null or empty page has an empty text, and so has one without any main block; tags and comments that
are never closed end with the page; repeated rows are extracted each by itself; an empty table gives an empty result;
a page may be as long as a string can be, and takes time in proportion to its length; extra columns pass through
:func:`extract`, whatever their names, but for ``text`` and ``n_chars``, which the new ones follow.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import batches_of, read_table, rows_of

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and a to in is that it was for on are as with his they at be this from have or by had not but what all were when we there can an your which their if will how about"
    " der die das und ist nicht mit von den dem ein eine zu auf für sich als auch es an werden aus er hat dass sie nach bei um am sind noch wie einem über im"
    " le la les un une des et est dans que qui pas pour sur ce au par plus se son avec il elle sont aux du ne en mais nous vous leur cette"
    " el los las de una y es por con no para su al lo como más pero sus ha este esta entre cuando muy sin sobre también hasta desde son o".split()
)
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’…"
#: Texts that browsers don't show as text, with all they hold.
_SILENT = frozenset("script style noscript template iframe svg object head select textarea button canvas audio video map datalist".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr input".split())
_BAD_TAGS = frozenset("nav header footer aside form dialog menu".split())
_BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar widget nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments reply replies respond disqus copyright pagination pager toolbar skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r"""=\s*["']|>""")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SPLIT = re.compile(r"[^a-z]+")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:\d{8,}|[xX][0-9a-fA-F]{7,});?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of a long and of a middling block; share of stop words in a long one (twice that in a middling one); share of linked characters.
LONG, SHORT, STOPS, LINKS = 140, 60, 0.12, 0.35
GOOD, BAD, UNSURE = 1, -1, 0


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond any character are U+FFFD, however long they are."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text) if "&" in text else text


def _marked(attributes: str) -> bool:
    """Whether a tag's attributes say that it holds boilerplate."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        match name.lower():
            case "hidden":
                return True
            case "style":
                if "display:none" in value.replace(" ", ""):
                    return True
            case "role":
                if value in _ROLES:
                    return True
            case "class" | "id":
                if not _BAD_NAMES.isdisjoint(_SPLIT.split(value)):
                    return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open" or "close", tag, attributes), in one pass; what scripts and the like hold is left out."""
    lower = re.sub("[A-Z]+", lambda x: x[0].lower(), page)
    unclosed: set[str] = set()  # silent tags that don't end any more
    at, text = 0, 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        begin = at
        if page.startswith("!--", at + 1):
            end = page.find("-->", at + 4)
            found, at = None, len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?") or page[at + 1 : at + 2] == "/" and not page[at + 2 : at + 3].isalpha():
            end = page.find(">", at + 1)
            found, at = None, len(page) if end < 0 else end + 1
        else:
            closing = page[at + 1 : at + 2] == "/"
            name = _NAME.match(page, at + 1 + closing)
            if not name:  # a "<" by itself
                at += 1
                continue
            at = name.end()
            while True:  # to the ">" that no quoted value holds
                m = _END.search(page, at)
                if m is None:
                    at = end = len(page)
                    break
                if m[0] == ">":
                    end, at = m.start(), m.end()
                    break
                at = page.find(m[0][-1], m.end()) + 1
                if not at:
                    at = end = len(page)
                    break
            found = ("close" if closing else "open", lower[name.start() : name.end()], page[name.end() : end])
        if begin > text:
            yield "text", page[text:begin], ""
        text = at
        if not found:
            continue
        kind, tag, attributes = found
        if tag in _SILENT:
            if kind == "open" and not attributes.endswith("/") and tag not in unclosed:
                end = lower.find(f"</{tag}", at)
                if end < 0:
                    unclosed.add(tag)
                if end >= 0 or tag != "head":
                    at = text = end if end >= 0 else len(page)
            continue
        yield found
    if text < len(page):
        yield "text", page[text:], ""


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, share of its characters in links, stands in something marked as boilerplate, is a heading)."""
    out: list[tuple[str, float, bool, bool]] = []
    stack: list[tuple[str, bool]] = []  # tag, boilerplate; with what it stands in
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    heading = in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((words, min(1.0, linked / len(words)), bool(stack) and stack[-1][1], heading))
            text.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for kind, tag, attributes in tokens(page):
        if kind == "text":
            raw = unescape(tag)
            text.append(raw)
            if in_link:
                linked += len(raw)
            continue
        closing = kind == "close"
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        if tag in _VOID or tag in _INLINE and (closing or not attributes or not _marked(attributes)):
            if closing and tag in _INLINE and stack and stack[-1][0] == tag:
                flush()
                pop()
            if tag == "hr":
                flush()
            continue
        flush()
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            heading = False
            in_link = in_link and tag in ("p", "div")
            continue
        # A paragraph ends where the next block starts; so does a list item at the next item.
        if stack and stack[-1][0] == "p" and tag not in _INLINE or stack and stack[-1][0] == tag == "li":
            pop()
        heading = tag in _HEADINGS
        stack.append((tag, bool(stack) and stack[-1][1] or tag in _BAD_TAGS or bool(attributes) and _marked(attributes)))
        opened[tag] += 1
    flush()
    return out


def stop_density(words: str) -> float:
    each = words.lower().split()
    return sum(w.strip(_PUNCTUATION) in STOP_WORDS for w in each) / len(each)


def classify(found: list[tuple[str, float, bool, bool]]) -> list[int]:
    """GOOD or BAD for each block that isn't marked as boilerplate, in their order."""
    found = [f for f in found if not f[2]]
    labels = []
    for words, links, _, _ in found:
        if links > LINKS:
            labels.append(BAD)
        elif len(words) >= SHORT and stop_density(words) >= (STOPS if len(words) >= LONG else 2 * STOPS):
            labels.append(GOOD)
        else:
            labels.append(UNSURE)
    decided = [i for i, x in enumerate(labels) if x != UNSURE]
    out = list(labels)
    k = 0
    for i, label in enumerate(labels):
        if label != UNSURE:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        before = decided[k - 1] if k else None
        after = decided[k] if k < len(decided) else None
        if found[i][3] and after is not None:
            out[i] = labels[after]
        elif before is None or after is None:
            near = after if before is None else before
            out[i] = GOOD if near is None else labels[near]
        elif i - before != after - i:
            out[i] = labels[before if i - before < after - i else after]
        else:
            out[i] = labels[before] if labels[before] == labels[after] else BAD
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    left = [words for words, _, marked, _ in found if not marked]
    return "\n".join(words for words, label in zip(left, classify(found), strict=True) if label == GOOD)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` without its page, and with ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in df.columns if c != html_col]
    inner = df.select(F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for (page,) in rows_of(iter([batch]), "_html")]
            own = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "_html"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(n for n, _ in own), "text", "n_chars"])

    ddl = "".join(f"_c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep)) + "text string, n_chars long"
    return inner.mapInArrow(work, ddl).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
