"""Main text of web pages by two passes of block rules (operator 2).

A page is cut into blocks at block-level tags. The first pass decides blocks by link density, length, the density of function words and the wording of notices; short
blocks and those in between stay open. The second pass gives each open block the label of its nearest decided neighbour. The rules
are the same inside an article element and without one. Markup sets what they start from: elements that never hold main text go, where a page marks an
article the blocks outside it go, and names of classes count only as long as they leave some text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.bpe import text_slices
from paperloom.llm.common import small_batches

# Frequent function words of the languages in the corpus.
STOP_WORDS = frozenset(
    "the of and to a in is it that for was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see could no make than been its who now did get may "
    "le la les de des du un une et est en que qui dans pour pas au aux sur se ce il elle ne par avec son sa ses plus ou mais nous vous ils "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über "
    "el los las y que del se con por una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre".split()
)
# Characters that play the part of function words where words aren't spaced, and the scripts that don't space them.
FUNCTION_CHARACTERS = frozenset("的一是不了在人有我他这个们来到说和就要也你以会可と の は が を に で た し て も な だ る れ".replace(" ", ""))
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
APART = frozenset("nav footer aside form head menu dialog select button fieldset".split())
ARTICLE = frozenset(["article", "main"])
#: Words of a class, an id or a role that mark what stands apart from the main text.
APART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond cookie cookies consent notice notices notification gdpr newsletter subscribe subscription signup login share sharing social related recommended widget popup modal overlay search contentinfo complementary form toolbar pagination pager".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NAME_PART = re.compile(r"[a-z]+")
#: Beginnings and ends of a name's word that tell as much as the whole word.
_NAME_ENDS = ("comment", "comments", "commentlist", "cookie", "cookies", "advert", "advertisement", "sidebar", "newsletter", "breadcrumb", "breadcrumbs", "sponsored")
#: Short blocks that say what they are.
_NOTICE = re.compile(
    r"(?:advertisements?|sponsored(?: content| links?)?|promoted(?: content)?|anzeige|publicité|publicidad|annonce)[\s.:!]*\Z"
    r"|share (?:this|on|via|with)\b|(?:tweet|share|print|email)(?:[\s|,/·•-]+(?:tweet|share|print|email|facebook|twitter|linkedin|whatsapp|pinterest|reddit))+[\s.]*\Z"
    r"|(?:we|this (?:web)?site|our (?:web)?site|this page)(?: and our partners)? uses? cookies\b|by (?:continuing|using|browsing)\b.{0,80}\bcookies\b|accept (?:all )?cookies\b"
    r"|wir verwenden cookies\b|nous utilisons des cookies\b|utilizamos cookies\b"
    r"|(?:subscribe to|sign up for) (?:our|the) newsletter\b|(?:leave|post|write) a (?:comment|reply)\b|\d+ comments?[\s.:]*\Z",
    re.I,
)
#: Parts of a name that say what a box has or lacks, not what it is.
_ABOUT = frozenset("no non not without with has have is hide".split())
_WORD = re.compile(r"\w+")
#: Marks of sentences, lists and tables.
_MARKS = re.compile(r"[.,;:!?|/()•·…。、，；：！？]")


@dataclass(frozen=True)
class Rules:
    """Limits of the first pass."""

    short: int = 70  # characters below which a block is left open
    links: float = 0.33  # share of characters in links above which it is bad
    some_links: float = 0.1  # share above which it is bad if it has few function words; without any mark it is, too
    notice: int = 160  # characters up to which a block may be a notice by its wording
    stop_good: float = 0.25  # share of function words from which a block is good
    stop_open: float = 0.12  # share from which it is left open
    unspaced: float = 0.3  # share of characters of unspaced scripts from which characters count instead of words
    unspaced_short: int = 25  # a short block in such a script
    unspaced_good: float = 0.08  # share of function characters from which such a block is good


@dataclass
class Block:
    text: str
    links: float
    apart: bool  # by an element
    named: bool  # by the name of a class, id or role
    article: int  # number of the article element it stands in, 0: none


def _is_named(attributes: str) -> bool:
    """Whether a class, id or role says that an element stands apart: cookie-notice does, no-sidebar doesn't."""
    for v in _NAMED.finditer(attributes):
        for name in (v[1] or v[2] or v[3] or "").lower().split():
            parts = _NAME_PART.findall(name)
            apart = not APART_NAMES.isdisjoint(parts) or any(p.startswith(_NAME_ENDS) or p.endswith(_NAME_ENDS) for p in parts)
            if apart and _ABOUT.isdisjoint(parts):
                return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with white space made single and references decoded."""
    out: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open elements: name, apart, named, article
    linked = depth = articles = 0
    apart, named, article = False, False, 0
    mute, mutes = "", 0  # an inline element that stands apart, and how often its name is open

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not mutes:
            decoded = html.unescape(raw) if "&" in raw else raw
            held.append(decoded)
            if depth:
                linked += len(decoded.strip())

    def flush() -> None:
        nonlocal linked
        if held:
            whole = " ".join("".join(held).split())
            if whole:
                out.append(Block(whole, linked / len(whole), apart, named, article))
            held.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        close, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1]:
                held.append(" ")
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                depth = 0 if close else 1
            if mutes:
                mutes += (-1 if close else 1) if name == mute and not rest.endswith("/") else 0
            elif not close and rest and name not in VOID and not rest.endswith("/") and (_HIDDEN.search(rest) or _is_named(rest)):
                mute, mutes = name, 1
            continue
        flush()
        mutes = 0
        if stack and stack[-1][0] == "p":  # the next block ends a paragraph, closed or not
            stack.pop()
            _, apart, named, article = stack[-1] if stack else ("", False, False, 0)
        if name in VOID or (close and name == "p"):
            continue
        if name == "body":
            stack.clear()
            apart, named, article = False, False, 0
            continue
        if close:
            if any(e[0] == name for e in stack):
                while stack.pop()[0] != name:
                    pass
                _, apart, named, article = stack[-1] if stack else ("", False, False, 0)
            continue
        apart = apart or name in APART or bool(rest and _HIDDEN.search(rest)) or (name == "header" and not article)
        named = named or ("=" in rest and _is_named(rest))
        if name in ARTICLE and not apart and not article:
            articles += 1
            article = articles
        if not rest.endswith("/"):
            stack.append((name, apart, named, article))
    text(page[at:])
    flush()
    return out


def first_pass(blocks: list[Block], rules: Rules = Rules()) -> list[bool | None]:
    """Good, bad or open, by link density, length, density of function words and the wording of notices.

    A page none of whose longer blocks has function words of the lists is in another language; there length and links decide. If no block
    is decided at all, as on a page of short blocks, those without links are good.
    """
    labels: list[bool | None] = []
    found = False
    for b in blocks:
        if b.links > rules.links or (len(b.text) <= rules.notice and _NOTICE.match(b.text)):
            labels.append(False)
            continue
        odd = len(UNSPACED.findall(b.text))
        if odd >= rules.unspaced * len(b.text):
            density, short, good, low = sum(c in FUNCTION_CHARACTERS for c in b.text) / odd, rules.unspaced_short, rules.unspaced_good, rules.unspaced_good / 2
        else:
            words = _WORD.findall(b.text.lower())
            density, short, good, low = sum(w in STOP_WORDS for w in words) / max(1, len(words)), rules.short, rules.stop_good, rules.stop_open
        if len(b.text) < short:
            labels.append(None)
            continue
        found = found or density >= low
        # tables and lists have few function words as well, so links or the want of any mark have to speak against a block, too
        against = b.links > rules.some_links or not _MARKS.search(b.text)
        labels.append(True if density >= good else False if density < low and against else None)
    if not found:
        longer = [b.links <= rules.links and len(b.text) >= rules.short for b in blocks]
        labels = [True if x else label for x, label in zip(longer, labels, strict=True)]
    if True not in labels:
        labels = [True if label is None else label for label in labels]
    return labels


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks get the label of the nearest decided neighbour within the page or their article. Between a good and a bad one as near, a block of an article is
    good and another one is bad. Where nothing is decided an article is good."""
    n = len(blocks)

    def nearest(order: range, step: int) -> list[tuple[int, bool | None]]:
        out: list[tuple[int, bool | None]] = [(0, None)] * n
        last: tuple[int, bool | None] = (0, None)
        for i in order:
            other = i - step
            if not 0 <= other < n or blocks[other].article != blocks[i].article:
                last = (other, None)
            if labels[i] is not None:
                last = (i, labels[i])
            out[i] = last
        return out

    before, after = nearest(range(n), 1), nearest(range(n - 1, -1, -1), -1)
    out = []
    for i, b in enumerate(blocks):
        (p, left), (q, right) = before[i], after[i]
        if left is None or right is None or left == right:
            label = right if right is not None else left
        else:
            label = left if i - p < q - i else right if q - i < i - p else None
        out.append(b.article > 0 if label is None else label)
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    """The good blocks, joined by one space; empty if there are none."""
    all_blocks = [b for b in blocks_of(page) if not b.apart]
    blocks = [b for b in all_blocks if not b.named] or all_blocks
    if any(b.article for b in all_blocks):
        blocks = [b for b in blocks if b.article] or [b for b in all_blocks if b.article]
    return " ".join(b.text for b, good in zip(blocks, second_pass(blocks, first_pass(blocks, rules)), strict=True) if good)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars for each row, by main_text over the whole page.

    Null and empty pages have the empty text; a null key or url stays null; repeated rows stay; an empty table gives an
    empty result; other columns are passed over. No shuffle: each task works on its own rows.
    """
    small_batches(pages.sparkSession)
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (key, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, given in text_slices(batches):
            texts = [main_text(p) for p in given]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("text"))
    found = rows.mapInArrow(run, f"key {kind}, url {url_kind}, text string, n_chars long")
    return found.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
