"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, with the tags and
the class, id and role words of all ancestors. Features are those and measures of the text;
a chain over the blocks in page order says which ones are the article, decoded by Viterbi.

The model is trained on the driver on at most `train_pages` pages of at most `train_chars` code points, those whose ids hash lowest,
that say themselves where their article is (one article or main element, or an articleBody),
and on pages composed from labelled fragments, for the kinds of blocks that the first lack.
In training the ancestors that gave a page its labels are hidden now and then, so that other
features learn to speak too. Extraction is one pass over whole pages, without a shuffle.

Null pages are empty and give an empty text; broken markup never fails, and takes time linear in the page: unclosed elements end
with the page, but heads, labels, buttons and the like at the next block, stray end tags are ignored, a quote that nothing closes is a character, raw elements closed in themselves hide nothing, and those without an
end only what comes before the next block. Ids and urls may be null or repeat. An empty table stays empty.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.tables import small_batches, text_of

TRAIN_PAGES = 300
TRAIN_CHARS = 200_000  # longer pages are extracted, but not trained on: the default of a parameter
EPOCHS = 12

# Fixed values of the format
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td
tfoot th thead title tr ul video audio iframe""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea svg iframe object".split())
CODE_TAGS = frozenset("script style textarea".split())  # never closed by a slash, and run on to the end of the page
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HIDDEN_TAGS = frozenset("head title button select option label legend".split())  # the head, and forms' own texts, which no main text has
FORMAT_TAGS = BLOCK_TAGS | frozenset("a abbr b big cite code del em font i ins kbd mark q s small span strong sub sup tt u var".split())

# a quote opens a value only behind an equals sign; elsewhere it is a character like any other
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|))*+)>", re.S)
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
LOST_QUOTES = 16  # tags without an end because of a quote, after which a page's quotes are not heeded
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_ENDS = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW_TAGS}
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


class _Element:
    """An open element; what it inherits is shared with its parent as long as it adds nothing."""

    __slots__ = ("tag", "tags", "words", "hidden")

    def __init__(self, tag: str, above: _Element | None, words: frozenset[str]):
        tags, inherited = (above.tags, above.words) if above else (frozenset(), frozenset())
        self.tag, self.tags = tag, tags if tag in tags else tags | {tag}
        self.words = inherited if words <= inherited else inherited | words
        self.hidden = tag in HIDDEN_TAGS or (above is not None and above.hidden)


@dataclass
class Block:
    text: str
    own: str  # tag of the innermost block-level ancestor
    tags: frozenset[str]  # of ancestors
    words: frozenset[str]  # of their class, id, role and itemprop
    linked: int  # code points inside links


def _attribute_words(source: str) -> frozenset[str]:
    if not source:
        return frozenset()
    words = set()
    for name, *values in _ATTRIBUTE.findall(source):
        words.update(_NAME.findall(" ".join(values).lower()))
        if name.lower() == "hidden":
            words.add("hidden")
    return frozenset(words)


class _Stack:
    """Open elements, with the places of each tag, so that no step looks through all of them."""

    def __init__(self):
        self.items: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.muted: list[int] = []  # raw elements without an end

    def push(self, item: _Element, muted: bool = False) -> None:
        at = len(self.items)
        self.items.append(item)
        self.places.setdefault(item.tag, []).append(at)
        if item.tag in BLOCK_TAGS:
            self.blocks.append(at)
        if muted:
            self.muted.append(at)

    def cut(self, at: int) -> None:
        for item in self.items[at:]:
            self.places[item.tag].pop()
        del self.items[at:]
        for places in (self.blocks, self.muted):
            while places and places[-1] >= at:
                places.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def _markup(page: str):
    """(start, end, closing, tag, attributes) of the tags of a page in order; the tag is empty for other markup."""
    at, last, lost, pattern = 0, page.rfind(">"), 0, _MARKUP
    while (at := page.find("<", at)) >= 0:
        if at > last and not page.startswith("<!--", at):
            return
        m = pattern.match(page, at)
        if m is None and pattern is _MARKUP and (m := _PLAIN.match(page, at)):
            lost += 1
            pattern = _PLAIN if lost >= LOST_QUOTES else _MARKUP
        if m is None:
            at += 1
            continue
        at = yield m.start(), m.end(), m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        at = m.end() if at is None else at


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order, in time linear in the page. With `known`, only names of
    classes and the like that are in it are noted, and tags that are in it or in the format."""
    out, stack, run, linked = [], _Stack(), [], 0
    unclosed = set()  # raw tags without an end: they hide text up to the next block or the end of their parent

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            top = stack.items[-1] if stack.items else None
            if text and not (top and top.hidden):
                own = stack.items[stack.blocks[-1]].tag if stack.blocks else "none"
                out.append(Block(text, own, top.tags if top else frozenset(), top.words if top else frozenset(), min(linked, len(text))))
            run.clear()
        linked = 0

    def pop(at: int) -> None:
        if stack.blocks and stack.blocks[-1] >= at:
            close()
        stack.cut(at)

    def words(text: str) -> None:
        nonlocal linked
        if text and not stack.muted:
            run.append(text)
            if any(e.tag == "a" for e in stack.items[-4:]):
                linked += len(text)

    def opened(tag: str, attributes: str = "") -> _Element:
        found = _attribute_words(attributes)
        name = tag if known is None or tag in FORMAT_TAGS or tag in known else "other"
        item = _Element(name, stack.items[-1] if stack.items else None, found if known is None else found & known)
        item.hidden = item.hidden or tag in HIDDEN_TAGS
        return item

    lower = page.lower()
    final = {tag: lower.rfind(f"</{tag}") for tag in HIDDEN_TAGS}  # where each is closed for the last time
    at, tags, jump = 0, _markup(page), None
    while True:
        try:
            begin, past, closing, tag, attributes = tags.send(jump)
        except StopIteration:
            break
        jump = None
        if begin < at:
            jump = at
            continue
        words(page[at:begin])
        at = past
        if not tag:
            continue
        if closing:
            found = stack.last((tag,))
            if found >= 0:
                pop(found)
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag in RAW_TAGS:
            if tag not in CODE_TAGS and attributes.rstrip().endswith("/"):
                continue
            stop = None if tag in unclosed else _RAW_ENDS[tag].search(page, at)
            if stop or tag in CODE_TAGS:
                at = jump = stop.end() if stop else len(page)
            else:
                unclosed.add(tag)  # looked for once: no end tag follows later ones either
                stack.push(opened(tag), muted=True)
            continue
        if tag in VOID_TAGS:
            if tag == "br":
                run.append("\n")
            elif tag == "hr":
                close()
            continue
        if tag in BLOCK_TAGS:
            if stack.muted:
                pop(stack.muted[0])
            # a control or head without an end tag ends where a block begins that it cannot hold
            open_ended = [p for t in HIDDEN_TAGS if t != tag and stack.places.get(t) and final[t] < begin for p in stack.places[t][:1]]
            if open_ended and tag not in HIDDEN_TAGS:
                pop(min(open_ended))
            ends, scope = stack.last(CLOSES.get(tag, ("p",))), stack.last(SCOPES.get(tag, ()))
            if tag == "p" and ends >= 0:
                scope = max((p for p in stack.blocks[-1:] if p != ends), default=-1)
            if ends > scope:
                pop(ends)
            close()
        if not attributes.rstrip().endswith("/"):
            stack.push(opened(tag, attributes))
    words(page[at:])
    close()
    return out


def _level(x: float, cuts: tuple[float, ...]) -> int:
    return sum(x >= c for c in cuts)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the binary features of each block."""
    out = []
    for i, b in enumerate(page):
        n, words = len(b.text), len(_WORD.findall(b.text))
        own = b.own
        names = {f"in:{t}" for t in b.tags} | {f"named:{w}" for w in b.words}
        names |= {
            f"tag:{own}", f"size:{_level(n, (20, 60, 120, 250, 600))}", f"words:{_level(words, (2, 5, 10, 25, 60))}",
            f"links:{_level(b.linked / n, (0.01, 0.3, 0.6, 0.95))}", f"stops:{_level(sum(map(b.text.count, '.!?')), (1, 2, 4))}",
            f"commas:{_level(b.text.count(','), (1, 3))}", f"at:{_level(i / len(page), (0.1, 0.3, 0.7, 0.9))}", f"own:{own}:{_level(n, (25, 120))}",
        }
        if b.text[-1] in ".!?\"”":
            names.add("ends")
        if "©" in b.text:
            names.add("copyright")
        if i == 0:
            names.add("first")
        if i == len(page) - 1:
            names.add("last")
        out.append(sorted(names))
    return out


@dataclass
class ChainField:
    """A binary linear-chain field: a weight per feature for the label 1, and weights of label pairs."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def unary(self, names: list[list[str]]) -> np.ndarray:
        score = np.zeros((len(names), 2))
        for i, row in enumerate(names):
            score[i, 1] = sum(self.weights[self.index[n]] for n in row if n in self.index)
        return score

    def known(self) -> frozenset[str]:
        """Tags and names that features may speak of."""
        return frozenset(n.split(":", 1)[1] for n in self.index if n.startswith(("in:", "named:")))

    def decode(self, names: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not names:
            return []
        score = self.unary(names).tolist()
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b, back = score[0][0] + self.first[0], score[0][1] + self.first[1], []
        for u, v in score[1:]:
            from_a, from_b = (a + p00 < b + p10), (a + p01 < b + p11)
            back.append((from_a, from_b))
            a, b = max(a + p00, b + p10) + u, max(a + p01, b + p11) + v
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def gradient(self, names: list[list[str]], labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of a page, and what was observed less what is expected: per block, pair and start."""
        u, n = self.unary(names), len(names)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = u[0] + self.first
        for i in range(1, n):
            alpha[i] = u[i] + np.logaddexp(alpha[i - 1, 0] + self.pairs[0], alpha[i - 1, 1] + self.pairs[1])
        for i in range(n - 2, -1, -1):
            after = beta[i + 1] + u[i + 1]
            beta[i] = np.logaddexp(self.pairs[:, 0] + after[0], self.pairs[:, 1] + after[1])
        z = np.logaddexp(*alpha[-1])
        p = np.exp(alpha + beta - z)
        joint = np.exp(alpha[:-1, :, None] + self.pairs + (u + beta)[1:, None, :] - z)
        seen = np.zeros((2, 2))
        np.add.at(seen, (labels[:-1], labels[1:]), 1)
        path = u[np.arange(n), labels].sum() + self.first[labels[0]] + self.pairs[labels[:-1], labels[1:]].sum()
        return path - z, labels - p[:, 1], seen - joint.sum(0), np.eye(2)[labels[0]] - p[0]

    def fit(self, pages: list[tuple[list[list[str]], list[int], frozenset[str]]], epochs: int = EPOCHS, rate: float = 0.3,
            penalty: float = 1e-4, hide: float = 0.3, seed: int = 5) -> ChainField:
        """Adaptive gradient steps page by page. The third item of a page names features to hide in a share of the steps."""
        for row in (r for names, _, _ in pages for r in names):
            for name in row:
                self.index.setdefault(name, len(self.index))
        self.weights = np.zeros(len(self.index))
        squares, pair_squares, first_squares = np.full(len(self.weights), 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
        rng = random.Random(seed)
        order = list(range(len(pages)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                names, labels, telling = pages[k]
                if rng.random() < hide:
                    names = [[n for n in row if n not in telling] for row in names]
                _, blocks_off, pairs_off, first_off = self.gradient(names, np.asarray(labels))
                grad: dict[int, float] = {}
                for off, row in zip(blocks_off.tolist(), names, strict=True):
                    for n in row:
                        grad[self.index[n]] = grad.get(self.index[n], 0.0) + off
                at = np.fromiter(grad, np.int64, len(grad))
                g = np.fromiter(grad.values(), np.float64, len(grad)) - penalty * self.weights[at]
                squares[at] += g * g
                self.weights[at] += rate * g / np.sqrt(squares[at])
                pair_squares += pairs_off ** 2
                self.pairs = self.pairs + rate * pairs_off / np.sqrt(pair_squares)
                first_squares += first_off ** 2
                self.first = self.first + rate * first_off / np.sqrt(first_squares)
        return self


# ---------------------------------------------------------------- labelled pages

OUTSIDE_TAGS = frozenset("nav footer aside form header menu dialog".split())
OUTSIDE_WORDS = frozenset("""ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer form header menu modal nav
navigation newsletter notice pager pagination popup promo related replies share sidebar social sponsor sponsored subscribe widget""".split())
_INSIDE = frozenset({"in:article", "in:main", "named:articlebody", "named:main", "named:article"})


def told_labels(page: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article, else None."""
    inside = [bool({"article", "main"} & set(b.tags)) or "articlebody" in b.words for b in page]
    if not any(inside):
        return None
    return [int(x and not (OUTSIDE_TAGS & set(b.tags) or OUTSIDE_WORDS & b.words)) for x, b in zip(inside, page, strict=True)]


def composed_pages(count: int, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Pages put together from labelled fragments, with and without telling elements, and the label of each leaf block."""
    rng = random.Random(seed)
    syllables = "ka lo mi ten ra su vel dor in at es por che li na bo".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice(".....!?")

    def prose() -> str:
        return " ".join(sentence(4, 18) for _ in range(rng.randint(1, 7)))

    def named(base: str) -> str:
        return rng.choice((f' class="{base}"', f' id="{base}"', f' class="{base}-box main-{base}"', f' class="site {base}"'))

    def links(tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{word().capitalize()}</a></{tag}>' for _ in range(rng.randint(2, 7)))

    makers = {
        "menu": lambda: rng.choice(("<nav><ul>{}</ul></nav>", "<div%s><ul>{}</ul></div>" % named(rng.choice(("menu", "nav", "navigation"))))).format(links()),
        "header": lambda: f"<header{named('header')}><div>{word().capitalize()} {word()}</div><p>{sentence(2, 6)}</p></header>",
        "notice": lambda: f"<div{named(rng.choice(('notice', 'cookie', 'banner')))}><p>{sentence(5, 14)}</p></div>",
        "ad": lambda: f"<div{named(rng.choice(('ad', 'ads', 'advert', 'sponsored', 'promo')))}>{sentence(4, 14)}</div>",
        "sidebar": lambda: f"<aside{named(rng.choice(('sidebar', 'related', 'widget')))}><h3>{word().capitalize()}</h3><p>{sentence(4, 16)}</p><ul>{links()}</ul></aside>",
        "form": lambda: f"<form{named(rng.choice(('subscribe', 'newsletter', 'search')))}><p>{sentence(3, 9)}</p><input><button>{word()}</button></form>",
        "comments": lambda: f"<{(t := rng.choice(('section', 'div')))}{named('comments')}><h3>{word()} ({rng.randint(1, 40)})</h3>" + "".join(
            f"<div{named('comment')}><b>{word()}</b><p>{prose()}</p></div>" for _ in range(rng.randint(1, 4))) + f"</{t}>",
        "footer": lambda: rng.choice(("<footer>{}</footer>", "<div%s>{}</div>" % named("footer"))).format(
            f"<p>&copy; {word()} {word()}</p>" if rng.random() < 0.6 else f"&copy; {word()}.example {sentence(2, 8)}"),
    }

    def part(kind: str) -> tuple[str, int]:
        source = makers[kind]()
        return source, len(blocks(source))

    out = []
    for _ in range(count):
        body: list[tuple[str, list[int]]] = []

        def add(kind: str, chance: float, body=body) -> None:
            if rng.random() < chance:
                source, n = part(kind)
                body.append((source, [0] * n))

        for kind, chance in (("header", 0.4), ("menu", 0.9), ("notice", 0.3), ("ad", 0.5)):
            add(kind, chance)
        start = rng.choice(("<article>", "<main>", f"<div{named('content')}>", "<div>", "<section>"))
        body.append((start, []))
        source = f"<h1>{sentence(3, 9)}</h1>"
        body.append((source, [1]))
        for _ in range(rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.08:
                body.append((f"<h2>{sentence(2, 6)}</h2>", [1]))
            elif kind < 0.14:
                n = rng.randint(2, 5)
                body.append(("<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(n)) + "</ul>", [1] * n))
            elif kind < 0.18:
                body.append((f"<blockquote>{prose()}</blockquote>", [1]))
            else:
                body.append((rng.choice(("<p>{}</p>", "<p><b>{}<br>", "<p>{} <a href='/x'>" + word() + "</a>.</p>", "<p>{}")).format(prose()), [1]))
            for inner in ("ad", "form", "sidebar"):
                add(inner, 0.05)
        add("comments", 0.15)
        body.append((f"</{start[1:].split()[0].rstrip('>')}>", []))
        for kind, chance in (("comments", 0.35), ("sidebar", 0.5), ("form", 0.3), ("ad", 0.2), ("footer", 0.9)):
            add(kind, chance)
        out.append(("<html><body>" + "".join(s for s, _ in body) + "</body></html>", [x for _, ls in body for x in ls]))
    return out


def train(pages: list[str], composed: int = 240) -> ChainField:
    """A field from the pages that tell their labels and from composed ones."""
    lessons = []
    for page, labels in composed_pages(composed):
        found = blocks(page)
        if len(found) == len(labels):
            lessons.append((features(found), labels, _INSIDE))
    for page in pages:
        found = blocks(page)
        labels = told_labels(found) if found else None
        if labels:
            lessons.append((features(found), labels, _INSIDE))
    return ChainField().fit(lessons)


def main_text(model: ChainField, page: str) -> str:
    found = blocks(page, model.known())
    return "\n".join(b.text for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES,
                 train_chars: int = TRAIN_CHARS, model: ChainField | None = None) -> DataFrame:
    """One row per row of pages: page_id, url and text, the article's blocks joined by line ends."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    if model is None:
        ids = rows.filter(F.col("page_id").isNotNull() & (F.length("html") <= train_chars)).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
        chosen = rows.filter(F.length("html") <= train_chars).join(F.broadcast(ids), "page_id").select("page_id", "html").orderBy("page_id", "html").limit(train_pages)
        model = train([r["html"] for r in chosen.collect()])  # at most train_pages pages

    def run(batches):
        for batch in batches:
            texts = [main_text(model, h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
