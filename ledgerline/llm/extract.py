"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: runs of text between block-level tags, with
the open elements above them.  Each block gets features of its ancestors' tags
and of the words in their classes and ids, and of its own text (length, links,
sentence marks, place).  A chain of two labels, main text or not, is trained
by L2-regularised maximum likelihood on labelled pages made by a seeded
generator, and decoded by Viterbi.  Text is joined from the main blocks.

Scripts, styles, comments, other markup and the head never become blocks.
End tags may be left out as in HTML: a block or text ends the head, a block
ends a paragraph, a list item its like, and block tags end graphics and
selections.  Other elements of the hidden kinds that nothing closes hide
nothing.
Parsing takes time in proportion to the page's length at any depth of nesting.

Defined results: a null, empty or textless page gives an empty text; a tag cut
off at the end of a page is dropped; an unclosed comment, script or style runs
to the end; ties go to main text; repeated rows get equal results.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select datalist".split())
RAW = frozenset("script style textarea title xmp iframe noscript".split())
#: What the start tag of an element closes if it is open in the same container.
LIKES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
OPTIONAL = frozenset(LIKES) | {"p"}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that a block's start tag ends, unless it is one of their own parts.
BROKEN_OUT_OF = frozenset("svg math select datalist".split())
IN_GRAPHICS = frozenset("g path rect circle ellipse line polyline polygon text tspan defs use symbol desc foreignobject lineargradient radialgradient stop clippath mask pattern marker filter image switch animate set view metadata title mrow mi mo mn ms mtext msup msub mfrac msqrt mroot mtable mtr mtd mover munder semantics annotation annotation-xml option optgroup hr script style template".split())

# Quotes count only behind "="; possessive loops keep a tag that never ends from being tried over and over.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


class Place:
    """An open element below others, and the features of all of them; ``kids`` are shared by pages."""

    __slots__ = ("above", "tag", "found", "kids", "ids")

    def __init__(self, above: Place | None, tag: str, found: frozenset):
        self.above, self.tag, self.found, self.kids, self.ids = above, tag, found, {}, None


class Places:
    """The tree of places; ``index`` bounds the features kept to those a model knows, ``most`` the places shared."""

    def __init__(self, index: dict[str, int] | None = None, most: int = 50_000):
        self.index, self.left = index, most
        self.root = Place(None, "none", frozenset())

    def below(self, above: Place, tag: str, names: str) -> Place:
        """The place of an element with words ``names`` in ``above``."""
        kid = above.kids.get((tag, names))
        if kid is None:
            new = {"in:" + tag, *("name:" + w for w in WORD.findall(names))}
            if self.index is not None:
                new = {f for f in new if f in self.index}
            kid = Place(above, tag, above.found if new <= above.found else above.found | new)
            if self.left > 0 and len(names) <= 200:
                self.left -= 1
                above.kids[tag, names] = kid
        return kid

    @staticmethod
    def features(at: Place) -> list[str]:
        """Features of a place."""
        pair = [f"pair:{at.above.tag}>{at.tag}"] if at.above is not None and at.above.above is not None else []
        return [*sorted(at.found), "own:" + at.tag, *pair]


def leaf_blocks(page: str, places: Places) -> list[tuple[str, Place, float]]:
    """(text, place, share of the text in links) of each leaf block."""
    out: list[tuple[str, Place, float]] = []
    names_of: list[str] = []  # open elements from the outermost in, their places, and where each name stands
    place_of: list[Place] = [places.root]
    open_at: dict[str, list[int]] = {}
    barriers: list[int] = []  # open elements that end tags left out don't reach beyond
    closes: dict[str, int] = {}
    lowered = ""
    text: list[str] = []
    where = places.root
    linked = total = hidden = 0
    at, end = 0, len(page)

    def last_close(name: str) -> int:
        """Where the page last closes an element of a name; -1 if nowhere."""
        nonlocal lowered
        found = closes.get(name)
        if found is None:
            lowered = lowered or page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            found = closes[name] = lowered.rfind("</" + name)
        return found

    def flush() -> None:
        nonlocal linked, total
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.append((said, where, linked / max(1, total)))
            text.clear()
        linked = total = 0

    def pop(depth: int) -> None:
        nonlocal hidden
        while len(names_of) > depth:
            gone = names_of.pop()
            place_of.pop()
            open_at[gone].pop()
            hidden -= gone in HIDDEN
            if barriers and barriers[-1] == len(names_of):
                barriers.pop()

    def push(name: str, names: str) -> None:
        nonlocal hidden
        open_at.setdefault(name, []).append(len(names_of))
        if name not in INLINE and name not in OPTIONAL:
            barriers.append(len(names_of))
        names_of.append(name)
        place_of.append(place_of[-1] if name in INLINE else places.below(place_of[-1], name, names))
        hidden += name in HIDDEN

    def say(part: str) -> None:
        nonlocal where, linked, total
        if not part:
            return
        if hidden and names_of[-1] == "head" and not part.isspace():
            pop(len(names_of) - 1)
        if not hidden:
            if not text:
                where = place_of[-1]
            text.append(part)
            size = len(part)
            total += size
            linked += size if open_at.get("a") else 0

    for m in iter(lambda: TAG.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name == "br" and text:
            text.append(" ")
        if closing:
            if open_at.get(name):
                pop(open_at[name][-1])
            continue
        if hidden and names_of[-1] == "head" and name not in IN_HEAD:
            pop(len(names_of) - 1)
        if name not in INLINE:
            if hidden and name not in IN_GRAPHICS:
                # The outermost of graphics and selections that holds this tag and has no container of blocks open inside.
                first = min((open_at[n][0] for n in BROKEN_OUT_OF if open_at.get(n)), default=None)
                if first is not None and not any(open_at[n][-1] > first for n in ("foreignobject", "annotation-xml") if open_at.get(n)):
                    pop(first)
            for own in (("p",), LIKES.get(name, ())):
                edge = barriers[-1] if barriers else -1
                k = max((open_at[n][-1] for n in own if open_at.get(n)), default=-1)
                if k > edge:
                    pop(k)
        if name in VOID or rest.endswith("/"):
            continue
        if (name in HIDDEN - BROKEN_OUT_OF and name not in ("head", "script", "style") or name in ("title", "textarea")) and last_close(name) < at:
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if name not in HIDDEN and name != "title":
                say(page[at : stop.start() if stop else end])
                flush()
            at = stop.end() if stop else end
            continue
        push(name, " ".join(x for found in NAMES.findall(rest) for x in found if x).lower() if rest else "")
    say(page[at:])
    flush()
    return out


def text_features(text: str, linked: float, place: int, count: int) -> list[str]:
    """Features of a block's text."""
    words = text.count(" ") + 1
    return [
        "bias", f"words:{min(7, words.bit_length())}", f"links:{0 if linked == 0 else 1 if linked < 0.3 else 2 if linked < 0.9 else 3}", f"ends:{text[-1] in '.!?'}", f"commas:{min(2, text.count(','))}",
        f"mark:{'©' in text or '|' in text}", f"third:{min(2, 3 * place // count)}", f"short-linked:{words < 6 and linked > 0.5}",
    ]


class ChainCRF:
    """Two labels in a chain; weights per feature and label, and per step."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.step = np.zeros((2, 2))
        self.places = Places()

    def blocks(self, page: str) -> list[tuple[str, Place, float]]:
        """Leaf blocks of a page."""
        return leaf_blocks(page, self.places)

    def ids(self, blocks: list[tuple[str, Place, float]], grow: bool = False) -> list[list[int]]:
        """Feature numbers of each block of a page."""
        out = []
        for k, (text, place, linked) in enumerate(blocks):
            own = place.ids
            if own is None:
                names = Places.features(place)
                own = place.ids = [self.index.setdefault(f, len(self.index)) for f in names] if grow else [self.index[f] for f in names if f in self.index]
            names = text_features(text, linked, k, len(blocks))
            out.append(own + ([self.index.setdefault(f, len(self.index)) for f in names] if grow else [self.index[f] for f in names if f in self.index]))
        return out

    def train(self, pages: list[tuple[list, list[int]]], *, epochs: int = 12, rate: float = 0.15, l2: float = 1e-4, seed: int = 2) -> None:
        """AdaGrad on the log likelihood by forward and backward sums."""
        made = [(self.ids(b, grow=True), y) for b, y in pages]
        self.w = np.zeros((len(self.index), 2))
        size_w, size_s = np.full_like(self.w, 1e-6), np.full((2, 2), 1e-6)
        order = random.Random(seed)
        for _ in range(epochs):
            order.shuffle(made)
            for ids, y in made:
                n = len(ids)
                emit = np.array([self.w[f].sum(0) for f in ids])
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = emit[0]
                for t in range(1, n):
                    forward[t] = emit[t] + np.logaddexp(forward[t - 1][0] + self.step[0], forward[t - 1][1] + self.step[1])
                for t in range(n - 2, -1, -1):
                    nxt = emit[t + 1] + backward[t + 1]
                    backward[t] = np.logaddexp(self.step[:, 0] + nxt[0], self.step[:, 1] + nxt[1])
                whole = np.logaddexp(*forward[-1])
                p = np.exp(forward + backward - whole)
                gs = np.zeros((2, 2))
                for t in range(1, n):
                    gs -= np.exp(forward[t - 1][:, None] + self.step + (emit[t] + backward[t])[None, :] - whole)
                    gs[y[t - 1], y[t]] += 1
                p[np.arange(n), y] -= 1
                flat, rows = np.concatenate(ids), np.repeat(np.arange(n), [len(f) for f in ids])
                used, back = np.unique(flat, return_inverse=True)
                g = np.zeros((len(used), 2))
                np.add.at(g, back, -p[rows])
                g -= l2 * self.w[used]
                size_w[used] += g * g
                self.w[used] += rate * g / np.sqrt(size_w[used])
                size_s += gs * gs
                self.step += rate * gs / np.sqrt(size_s)
        # Decoding needs one number per feature and three per step: all that matters is label 1 against label 0.
        self.margin = (self.w[:, 1] - self.w[:, 0]).tolist()
        self.places = Places(self.index)

    def decode(self, blocks: list[tuple[str, Place, float]]) -> list[int]:
        """Most probable labels of a page's blocks by Viterbi."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        margin, back = self.margin, []
        a = b = 0.0
        for t, ids in enumerate(self.ids(blocks)):
            e = sum([margin[f] for f in ids])
            if t:
                from0, from1 = (a + s00 > b + s10), (a + s01 > b + s11)
                a, b = (a + s00 if from0 else b + s10), (a + s01 if from1 else b + s11)
                back.append((0 if from0 else 1, 0 if from1 else 1))
            b += e
        label = int(b >= a)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """(html, main blocks) of made-up pages of many layouts."""
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it que ción ung sch eau ment".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=2, b=16: words(a, b).capitalize() + rng.choice([".", ".", ".", "", "?"])
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    named = lambda tag, names: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(names)}">'
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'

    def menu() -> str:
        plain = rng.random() < 0.25
        items = "".join(f"<li>{words(1, 3) if plain else link()}</li>" for _ in range(rng.randint(1, 9)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", named("div", ["menu", "navbar", "breadcrumb", "main-menu", "navigation", "top-nav"]) + f"<ul>{items}</ul></div>", f"<nav>{link()} | {link()} | {link()}</nav>", f'<div role="navigation"><ul>{items}</ul></div>'])

    def top() -> str:
        return rng.choice(["<header>", named("div", ["header", "site-header", "masthead", "page-header", "top-bar"])]) + rng.choice(["<h1>", "<p>", "<h2>"]) + words(1, 6) + rng.choice(["", f"<p>{prose(1, 2)}"]) + "</header></div>"

    def side() -> str:
        tag = rng.choice(["<aside>", named("div", ["sidebar", "side", "widget", "right-rail", "related", "related-posts", "recommended", "more-stories", "side-bar"]), named("section", ["related", "sidebar", "popular"])])
        inner = rng.choice([f"<h3>{words(1, 4)}</h3><ul>" + "".join(f"<li>{link(2, 8)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>", f"<p>{prose(1, 5)}</p>", f"<h4>{words(1, 4)}</h4><p>{prose(1, 4)}</p><p>{link(2, 5)}</p>", prose(1, 3)])
        return tag + inner + {"a": "</aside>", "d": "</div>", "s": "</section>"}[tag[1]]

    def notice() -> str:
        return named(rng.choice(["div", "p"]), ["cookie-notice", "notice", "cookie", "banner", "alert", "gdpr", "consent", "disclaimer", "popup", "modal", "warning", "notification"]) + prose(1, 4) + rng.choice(["", f"<button>{words(1, 2)}</button>"]) + "</p></div>"

    def advert() -> str:
        return rng.choice(["<!-- ad -->", ""]) + named("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "promotion"]) + rng.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", link(2, 6)]) + "</div>"

    def form() -> str:
        return rng.choice([f"<form><label>{words(1, 3)}</label><input name=q><button>{word()}</button></form>", f"<form {rng.choice(['', 'class=search', 'class=newsletter'])}><p>{prose(1, 3)}</p><input><select><option>{word()}<option>{word()}</select><textarea>{words(1, 4)}</textarea></form>", named("div", ["newsletter", "signup", "subscribe", "search", "login"]) + f"<p>{prose(1, 2)}</p><form><input></form></div>"])

    def comments() -> str:
        tag = rng.choice(["section", "div", "ol", "ul"])
        inner = "li" if tag in ("ol", "ul") else rng.choice(["div", "article", "p"])
        return named(tag, ["comments", "comment-list", "reader-comments", "responses", "discussion", "user-comments", "disqus"]) + rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(f'<{inner} class="{rng.choice(["comment", "reply", "comment-body"])}">' + rng.choice([prose(1, 4), f"<b>{word()}</b> {prose(1, 3)}", f"<p>{prose(1, 4)}</p>"]) + f"</{inner}>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    def share() -> str:
        return named(rng.choice(["div", "ul"]), ["share", "social", "tags", "byline-links", "social-links", "share-buttons", "pagination", "toolbar"]) + " ".join(link(1, 2) for _ in range(rng.randint(2, 5))) + "</ul></div>"

    def bottom() -> str:
        return rng.choice(["<footer>", named("div", ["footer", "site-footer", "bottom", "copyright", "page-footer"])]) + rng.choice([f"&copy; {word()}.example.com &middot; {prose(1, 3)}", f"<p>&copy; {words(1, 4)}</p><ul><li>{link()}</li><li>{link()}</li></ul>", f"<p>{prose(1, 3)}</p>{link()}", f"{words(2, 6)} | {link()} | {link()}"]) + "</footer></div>"

    junk_inside = [advert, advert, share, side, form, notice, comments]
    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(text: str, main=main) -> str:
            main.append(" ".join(text.split()))
            return text.replace("&", "&amp;")

        def body(keep=keep) -> str:
            kind = rng.random()
            if kind < 0.55:
                return "<p>" + keep(prose(1, 7)) + rng.choice(["</p>", "</p>", "\n"])
            if kind < 0.65:
                return "<p><b>" + keep(prose(1, 4)) + "<br><p>" + keep(prose(1, 5)) + "</p>"
            if kind < 0.72:
                return (h := rng.choice(["h2", "h3"])) and f"<{h}>" + keep(words(1, 7)) + f"</{h}>"
            if kind < 0.8:
                return (tag := rng.choice(["ul", "ol"])) and f"<{tag}>" + "".join("<li>" + keep(prose(1, 2)) + "</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
            if kind < 0.85:
                return "<blockquote>" + rng.choice(["", "<p>"]) + keep(prose(1, 3)) + "</blockquote>"
            if kind < 0.9:
                return "<table>" + "".join("<tr>" + "".join("<td>" + keep(words(1, 3)) + "</td>" for _ in range(2)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
            if kind < 0.94:
                return "<figure><img src=x><figcaption>" + keep(prose(1, 2)) + "</figcaption></figure>"
            a, b, c = words(1, 6), words(1, 3), words(1, 9)
            main.append(f"{a} {b} {c}.")
            return f'<p>{a} <a href="/{word()}">{b}</a> {c}.</p>'

        hold = rng.choice(["<article>", "<article>", "<main>", "<main><article>", named("div", ["content", "post", "entry-content", "article-body", "story", "main", "post-content", "article"]), named("section", ["article", "content", "story-body"])])
        shut = {"a": "</article>", "m": "</main>", "d": "</div>", "s": "</section>"}[hold[1]] if hold != "<main><article>" else "</article></main>"
        parts = [menu() if rng.random() < 0.85 else "", top() if rng.random() < 0.6 else "", notice() if rng.random() < 0.5 else "", advert() if rng.random() < 0.6 else "", side() if rng.random() < 0.4 else "", form() if rng.random() < 0.35 else ""]
        rng.shuffle(parts)
        inner = ["<h1>" + keep(words(1, 8)) + "</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 14)):
            inner.append(body())
            if rng.random() < 0.12:
                inner.append("</p>" + rng.choice(junk_inside)())
        tail = [comments() if rng.random() < 0.5 else "", side() if rng.random() < 0.4 else "", share() if rng.random() < 0.3 else "", advert() if rng.random() < 0.3 else "", notice() if rng.random() < 0.3 else "", form() if rng.random() < 0.3 else ""]
        rng.shuffle(tail)
        page = f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>" + "".join(parts) + hold + "".join(inner) + shut + "".join(tail) + (bottom() if rng.random() < 0.85 else "")
        out.append((page, main))
    return out


def labels(blocks: list, main: list[str]) -> list[int]:
    """Whether each block of a labelled page is main text; main blocks come in page order."""
    at, out = 0, []
    for text, _, _ in blocks:
        hit = at < len(main) and text == main[at]
        at += hit
        out.append(int(hit))
    return out


def fit(pages: int = 500, seed: int = 17) -> ChainCRF:
    """A field trained on ``pages`` labelled pages."""
    model = ChainCRF()
    made = [(model.blocks(page), main) for page, main in labelled_pages(pages, seed)]
    model.train([(blocks, labels(blocks, main)) for blocks, main in made if blocks])
    return model


def main_text(model: ChainCRF, page: str | None) -> str:
    """Main text of one page, its blocks joined by line ends."""
    blocks = model.blocks(page or "")
    return "\n".join(b[0] for b, y in zip(blocks, model.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", *, training_pages: int = 500) -> DataFrame:
    """``pages`` without ``html``, with text and n_chars in place of any of those names."""
    spark = pages.sparkSession
    model = spark.sparkContext.broadcast(fit(training_pages))  # its size depends on the generator only
    kept = [n for n in pages.columns if n not in (html, "text", "n_chars")]
    source = pages.select(*kept, html)
    schema = T.StructType([*(source.schema[n] for n in kept), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(model.value, x.as_py()) for x in part.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(each, schema)
