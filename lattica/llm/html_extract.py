"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# Element names of HTML by what they mean here.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset select button head".split())
CLOSED_BY = {"p": frozenset("p div ul ol li table section article h1 h2 h3 h4 h5 h6 nav footer header aside form blockquote pre main figure".split()), "li": frozenset(["li"]), "option": frozenset(["option"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
# Words in a class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent copyright disqus dialog"
    " footer form header login masthead menu modal nav navbar navigation navi newsletter notice notices pager pagination popup promo promoted promotion"
    " related recommended reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget"
    " complementary contentinfo search alert sidenav topbar bottombar gdpr paywall".split()
)
# Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his if in into is it its more not of on one or our she so that the their"
    " them there they this to was we were what when which who will with would you"
    " aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist man mit nach nicht noch nur"
    " oder sein sich sie sind so über um und unter vom von vor war wie wird zu zum zur"
    " au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son"
    " sont sur une un vous y"
    " al como con cuando del donde el ella ellos entre era eso esta este ha hasta hay la las lo los más me mi muy no nos o para pero por porque que se si"
    " sin sobre su sus también te tiene una uno unos ya".split()
)
# Frequent characters of Chinese and Japanese, which are written without spaces.
STOP_SIGNS = frozenset("的一是不了在人有我他这個个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里のにはをたがでてとしれさるいもなこ")
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
# Parts of a name that say what an element goes with or is filed under, not what it is.
BESIDES = frozenset("has no not with without hide category tag enabled disabled open closed on off layout wrapper container".split())
# Elements that hold prose, and marks that end sentences.
PROSE = frozenset("p pre blockquote dd".split())
SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f\u0964\u061f]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    linked: int  # code points within links
    outside: bool  # within an element that is no part of an article
    article: bool  # within an article or main element
    heading: bool
    prose: bool  # within an element for paragraphs
    within: tuple[int, ...] = ()  # the elements around it, numbered in page order
    verdict: bool | None = field(default=None)
    rule: str = ""  # what decided it


@dataclass(frozen=True)
class Rules:
    """Thresholds: characters of a short and of a long block, link density, stop-word density."""

    short: int = 70
    long: int = 200
    links: float = 0.35
    stop_low: float = 0.08
    stop_high: float = 0.16


def marked(attributes: str, article: bool = False) -> bool:
    """Whether a class, id or role names something beside the article, or the element is hidden.

    A header or banner is only so outside of an article, which may have its own. Attributes go by
    their whole names; a class such as cookie-notice counts by its parts, has-sidebar or
    no-comments does not count.
    """
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and value.strip() != "false":
            return True
        if name not in ("class", "id", "role"):
            continue
        for word in value.split():
            parts = set(re.split(r"[^a-z]+", word))
            named = MARKS & parts
            if named and not BESIDES & parts and not (article and named <= {"header", "banner"}):
                return True
    return False


def roles(attributes: str) -> list[str]:
    return [role for name, *values in ATTRIBUTE.findall(attributes) if name.lower() == "role" for role in "".join(values).lower().split()]


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, white space within each made one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # element, outside, article, its number
    buffer: list[str] = []
    linked, links, heading, at, end = 0, 0, False, 0, len(page)
    base = 0  # depth at which a link was opened; it may hold blocks, and ends at the latest with what it stands in

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            if text:
                prose = any(e[0] in PROSE for e in stack[-3:])
                out.append(Block(text, linked, bool(stack and stack[-1][1]), bool(stack and stack[-1][2]), heading, prose, tuple(e[3] for e in stack)))
        buffer.clear()
        linked = 0

    while at < end:
        tag = TOKEN.search(page, at)
        piece = page[at : tag.start() if tag else end]
        if piece:
            buffer.append(piece)
            if links:
                linked += len(piece.strip())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        closing, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if not name:  # a comment or declaration
            continue
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>|</{re.escape(name)}\Z", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if name == "a":
            links, base = (0, 0) if closing else (1, len(stack))
        if name in INLINE:
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if any(e[0] == name for e in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            _, outside, article, _ = stack[-1] if stack else ("", False, False, 0)
            inside = name in ("article", "main") or "main" in roles(attributes)
            # A header element within an article holds the article's own heading.
            beside = (name in OUTSIDE and not (name == "header" and article)) or (name not in ("html", "body") and marked(attributes, article or inside))
            stack.append((name, outside or beside, (article or inside) and not beside, at))
        heading = bool(stack) and re.fullmatch(r"h[1-6]", stack[-1][0]) is not None
        if len(stack) < base:
            links = 0
    flush()
    return out


def stop_density(text: str) -> float:
    """The share of stop words among the words, or, of a text written without spaces, that of frequent characters among the signs."""
    signs = UNSPACED.findall(text)
    if 2 * len(signs) > len(text):
        return sum(c in STOP_SIGNS for c in signs) / len(signs)
    tokens = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP for w in tokens) / max(1, len(tokens))


def classify(found: list[Block], rules: Rules = Rules()) -> list[Block]:
    """Set each block's verdict, True if it belongs to the article, and the rule that decided it.

    First pass, by the block alone: one mostly of links is out. One of at least `long` characters
    with some stop words, or `short` with many, is in. One without them is out, but undecided if
    it stands in an article element or is long and of sentences, as it may be in a language
    without stop words here. All others, and those under `short`, are undecided. Whatever the
    first pass would take in or leave open is out if its element is no part of an article, such
    as a footer or reader comments, which may well be prose.

    Second pass: an undecided block inherits from its nearest decided neighbours, of two from the
    one that shares more of the elements around it, then from the nearer, and at equal distance is in only if both are in; a heading inherits from the next decided
    block after it, and in an article element without such a one from that before. Neighbours are those that are within article or main elements too, or outside
    too. Of a page on which nothing is in so far, undecided blocks without any decided neighbour
    that is in are in where they stand in an article element, or, if there are none, in paragraphs.
    """
    for b in found:
        density, size = b.linked / max(1, len(b.text)), len(b.text)
        if UNSPACED.search(b.text):
            size *= 2  # a sign says about as much as half a word
        if density > rules.links:
            b.verdict, b.rule = False, "links"
            continue
        if size < rules.short:
            pass
        elif (stops := stop_density(b.text)) >= rules.stop_high or (stops >= rules.stop_low and size >= rules.long):
            b.verdict, b.rule = True, "stop words"
        elif stops < rules.stop_low and not b.article and not (b.prose and size >= rules.long and SENTENCE.search(b.text)):
            b.verdict, b.rule = False, "stop words"
        if b.outside and b.verdict is not False:
            b.verdict, b.rule = False, "element"
    for part in ([b for b in found if b.article], [b for b in found if not b.article]):
        _inherit(part)
    if not any(b.verdict for b in found):
        left = [b for b in found if b.rule in ("neighbours", "none")]
        for b in [b for b in left if b.article] or [b for b in left if b.prose]:
            b.verdict, b.rule = True, "only text"
    return found


def _inherit(found: list[Block]) -> None:
    """The second pass. Blocks beside the article, or of links, are no neighbours to one in an article element."""
    decided = [(k, b.verdict) for k, b in enumerate(found) if b.verdict is not None and not (b.article and not b.verdict)]
    k = 0
    for at, b in enumerate(found):
        while k < len(decided) and decided[k][0] < at:
            k += 1
        if b.verdict is None:
            before, after = decided[k - 1] if k else (-1, False), decided[k] if k < len(decided) else (-1, False)
            if b.heading:
                b.verdict = after[1] if after[0] >= 0 or not b.article else before[1]
            else:
                near = sorted((-_shared(b, found[j]), abs(j - at), verdict) for j, verdict in (before, after) if j >= 0)
                b.verdict = bool(near) and near[0][2] and not (len(near) > 1 and near[1][:2] == near[0][:2] and not near[1][2])
            b.rule = "neighbours" if max(before[0], after[0]) >= 0 else "none"


def _shared(a: Block, b: Block) -> int:
    """The number of elements around both."""
    return next((k for k, (x, y) in enumerate(zip(a.within, b.within)) if x != y), min(len(a.within), len(b.within)))


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks(page or "")) if b.verdict)


def rules_used(page: str | None) -> dict[str, int]:
    """The number of the page's blocks that each rule decided."""
    return dict(Counter(b.rule for b in classify(blocks(page or ""))))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text (empty if none) and n_chars (its code points).

    Columns named text and n_chars are replaced, all others are kept. Null html counts as empty.
    Unclosed, misnested and cut-off markup is read as far as it goes; no page is cut or dropped.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars", "_lattica_html")]
    schema = pages.select(*kept, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(parts):
        for part in parts:
            texts = [main_text(h.as_py()) for h in part.column("_lattica_html")]
            columns = [part.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "text", "n_chars"])

    return pages.select(*kept, F.col(html_col).alias("_lattica_html")).mapInArrow(run, schema)
