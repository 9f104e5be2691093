"""Main text of web pages by two passes of block rules.

The page is cut into blocks of text at block-level tags. Blocks in navigation, footers, forms and the
like, told by tag, role or class, are boilerplate from the start. The first pass judges each other
block by its own link density, length and share of stop words: good, bad, or, where it is too short or
too plain to tell, undecided. The second pass gives each undecided block the label that its nearest
decided neighbours have; where they differ, the nearer one's, and of equally near ones good only if
the block has stop words enough. Inside an <article> or <main> a block of SHORT characters needs no stop
words to be good; and where such elements hold more text than all good blocks outside, everything
outside is bad unseen. A paragraph of links inside is undecided, a list item of links bad.

Class and id names only count as a whole (``sidebar``, ``cookie-notice``, ``main-nav``, but not
``with-sidebar``), and as hints: where nothing is left of a page, they are set aside and the rules decide
alone. Where hardly a word of a page is a stop word, its language has no list here: then sentence marks
take their place.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, texts_of

#: Block rules: characters of a short and of a long block, shares of linked characters and of stop words.
SHORT, LONG, LINKED, STOP_LOW, STOP_HIGH = 70, 200, 0.5, 0.20, 0.30
#: Share of stop words of a whole page below which its language is taken for an unknown one.
UNKNOWN = 0.05

STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can do for from had has have he her his how i if in into is it its
    more my no not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kein man mit nach
    nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir zu zum zur
    au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur
    un une vous y à été être al como con cuando de del desde donde el ella en era es esta este ha hay la las lo los más me mi muy ni no nos o para pero por porque que
    se ser si sin sobre su sus también te tiene un una uno y ya che di il per sono non i gli da het een van op te dat niet zijn os um uma não em""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header
    hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements whose text is never main text; those of the second set only outside an article.
NEVER = frozenset("nav footer aside form fieldset select option button dialog menu head svg math object audio video canvas map template noscript label datalist".split())
OUTSIDE = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond consent cookie cookies
    gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login search sidebar rail widget widgets menu nav navbar navigation footer
    masthead pagination pager paging promo promoted promotion related recommended recommendations share sharing social sponsor sponsored toolbar skip""".split()
)
OUTSIDE_HINTS = frozenset(["header", "topbar", "head"])
#: Parts of a name that turn it into a statement on the layout, and those that only say what holds the thing named first.
LAYOUT = frozenset("with without no not non has have is in hide show open full wide left right".split())
HOLDERS = frozenset("area bar block box container content group holder inner item items links list module outer panel region row section slot unit wrap wrapper zone".split())

_token = re.compile(
    r"""<!--(?:.*?--!?>|[^>]*+>|.*)|<[!?][^>]*+(?:>|$)"""
    r"""|<(?P<raw>script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template)(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>(?:.*?</(?P=raw)(?=[\s/>])[^>]*+(?:>|$)|.*)"""
    r"""|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*+)(?:>|$)""",
    re.IGNORECASE | re.DOTALL,
)
_attribute = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_parts = re.compile(r"[a-z0-9]+")
_words = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"[.!?…。！？।؟]")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

GOOD, BAD, OPEN = 1, -1, 0


class Block:
    """A block's text and what is known of the elements around it. ``hinted``: only names speak against it; ``item``: in a list."""

    __slots__ = ("boiler", "hinted", "inside", "item", "linked", "pieces", "text")

    def __init__(self, boiler: bool = False, hinted: bool = False, inside: bool = False, item: bool = False) -> None:
        self.pieces: list[str] = []
        self.linked, self.boiler, self.hinted, self.inside, self.item, self.text = 0, boiler, hinted, inside, item, ""


def named(value: str, hints: frozenset) -> bool:
    """Whether one of the names in a class or id attribute is that of a thing in ``hints``."""
    for name in value.split():
        parts = _parts.findall(name)
        if parts and not LAYOUT.intersection(parts) and (parts[-1] in hints or (parts[0] in hints and HOLDERS.issuperset(parts[1:]))):
            return True
    return False


def role_of(name: str, rest: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is boilerplate, whether its names hint at that, whether it is the main part."""
    main, boiler, hinted = name in ("article", "main"), name in NEVER or (name in OUTSIDE and not inside), False
    if rest and not rest.isspace():
        for key, value in _attribute.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                if not main and name not in ("body", "html") and (named(value, HINTS) or (not inside and named(value, OUTSIDE_HINTS))):
                    hinted = True
                elif main and {"comment", "comments", "reply"}.intersection(_parts.findall(value)):
                    main, boiler = False, True
            elif key == "role":
                boiler, main = boiler or value in ROLES, main or value == "main"
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _hidden.search(value)):
                boiler = True
    return boiler, hinted and not boiler, main and not boiler and not hinted


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, white space and character references resolved, none empty."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open block elements: name, boilerplate, hinted, main part
    boiler = hinted = inside = items = 0
    links, breaks, at = 0, 0, 0
    now, last, lowered = Block(), {}, page.lower()

    def flush() -> None:
        nonlocal now
        now.text = " ".join("".join(now.pieces).split())
        if now.text:
            out.append(now)
        now = Block(boiler > 0, hinted > 0, inside > 0, items > 0)

    def text(piece: str) -> None:
        nonlocal breaks
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            now.pieces.append(piece)
            if not piece.isspace():
                breaks = 0
            if links:
                now.linked += len("".join(piece.split()))

    def ends(name: str) -> int:
        """Where the page's last end tag of this name starts; -1 if there is none."""
        if name not in last:
            last[name] = lowered.rfind(f"</{name}")
        return last[name]

    def leave(k: int) -> None:
        nonlocal boiler, hinted, inside, items
        for name, b, h, m in stack[k:]:
            boiler, hinted, inside, items = boiler - b, hinted - h, inside - m, items - (name == "li")
        del stack[k:]

    for m in _token.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                now.pieces.append(" ")
            continue
        name, closing = name.lower(), bool(m["close"])
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            now.pieces.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif name in BLOCK or (name in NEVER and name not in VOID):
            links, breaks = 0, 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        leave(k)
                        break
            elif name not in VOID:
                if name in ("p", "li", "tr", "td", "th", "option", "dt", "dd"):  # their end tags may be left out
                    if stack and stack[-1][0] == name:
                        leave(len(stack) - 1)
                elif stack and stack[-1][0] == "p":
                    leave(len(stack) - 1)
                if name in ("article", "main") and not inside and boiler + hinted:  # a menu that was never closed
                    leave(next(k for k, x in enumerate(stack) if x[1] or x[2]))
                b, h, main = role_of(name, m["rest"], inside > 0)
                stack.append((name, b, h, main))
                boiler, hinted, inside, items = boiler + b, hinted + h, inside + main, items + (name == "li")
            flush()
        elif m["rest"] and not closing and name not in VOID and ("class" in m["rest"] or "hidden" in m["rest"] or "role" in m["rest"] or "id" in m["rest"]):
            b, h, _ = role_of(name, m["rest"], inside > 0)
            if (b or h) and ends(name) >= at:
                flush()
                stack.append((name, b, h, False))
                boiler, hinted = boiler + b, hinted + h
                flush()
        elif closing and stack and stack[-1][0] == name:
            flush()
            leave(len(stack) - 1)
            flush()
    text(page[at:])
    flush()
    return out


def holds_most(blocks: list[Block], stops: list[float]) -> bool:
    """Whether <article> and <main> hold more text than the blocks outside that are good by themselves."""
    usable = [(b, s) for b, s in zip(blocks, stops, strict=True) if not b.boiler and b.linked <= LINKED * len(b.text)]
    inside = sum(len(b.text) for b, _ in usable if b.inside)
    return inside > sum(len(b.text) for b, s in usable if not b.inside and len(b.text) > LONG and s >= STOP_HIGH)


def densities(blocks: list[Block]) -> list[float]:
    """Each block's share of stop words; in a language without a list 1 for blocks with a sentence mark, else 0."""
    words = [_words.findall(b.text.lower()) for b in blocks]
    hits = [sum(w in STOP_WORDS for w in ws) for ws in words]
    if sum(hits) < UNKNOWN * sum(map(len, words)):
        return [float(bool(_sentence.search(b.text))) for b in blocks]
    return [h / len(ws) if ws else 0.0 for h, ws in zip(hits, words, strict=True)]


def classify(blocks: list[Block]) -> list[int]:
    """Both passes: GOOD or BAD for each block."""
    labels = _classify(blocks)
    if GOOD not in labels and any(b.hinted and not b.boiler for b in blocks):
        labels = _classify(blocks, hints=False)
    return labels


def _classify(blocks: list[Block], hints: bool = True) -> list[int]:
    stops_of = densities(blocks)
    boiler = [b.boiler or (hints and b.hinted) for b in blocks]
    whole = holds_most([b for b, out in zip(blocks, boiler, strict=True) if not out], [s for s, out in zip(stops_of, boiler, strict=True) if not out])
    labels, dense = [], []
    for b, stops, out in zip(blocks, stops_of, boiler, strict=True):
        n = len(b.text)
        if out or (whole and not b.inside) or (b.linked > LINKED * n and (b.item or not b.inside or n < SHORT)):
            labels.append(BAD)
            dense.append(False)
            continue
        dense.append(stops >= STOP_LOW)
        if b.linked > LINKED * n:
            labels.append(OPEN)
        elif n < SHORT:
            labels.append(BAD if b.linked and not b.inside else OPEN)
        elif b.inside or (stops >= STOP_HIGH and n > LONG):
            labels.append(GOOD)
        else:
            labels.append(OPEN if stops >= STOP_LOW else BAD)
    # boilerplate is no neighbour: a block between a menu and an article isn't the menu's
    near = [i for i, b in enumerate(blocks) if not boiler[i] and not (whole and not b.inside)]
    before, last = {}, None
    for i in near:
        before[i] = last
        if labels[i] != OPEN:
            last = i
    after, last = {}, None
    for i in reversed(near):
        after[i] = last
        if labels[i] != OPEN:
            last = i
    out = labels.copy()
    for i in near:
        if labels[i] == OPEN:
            a, z = before[i], after[i]
            if a is None and z is None:
                out[i] = GOOD if blocks[i].inside or dense[i] else BAD
            elif a is None or z is None or labels[a] == labels[z]:
                out[i] = labels[z if a is None else a]
            elif i - a != z - i:
                out[i] = labels[a if i - a < z - i else z]
            else:
                out[i] = GOOD if blocks[i].inside or dense[i] else BAD
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, label in zip(blocks, classify(blocks), strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    A null, empty or textless page gives the empty text. Rows are treated each by itself, so repeated
    rows give repeated results and an empty table none; whole pages are read, of any length, in one
    pass; further columns are ignored.
    """

    def start():
        def apply(batch):
            texts = [main_text(x) for x in texts_of(batch, "html")]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    return map_batches(pages.select("page_id", "url", F.col("html")), start, "page_id long, url string, text string, n_chars long")
