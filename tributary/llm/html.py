"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Each block has a vector: hashed tags,
class and id words of its path, hashed words of its text, and a few shares (links, length, place on the page). A bidirectional
LSTM in numpy reads the whole sequence in both directions and labels every block as main text or not, so a block is judged in
the context of the whole page. Blocks labelled main are joined in page order.

The labeller is trained here, on `TRAIN_PAGES` synthetic pages drawn from a grammar of layouts in which every block's label is
known by construction; the bound is a parameter. Training takes seconds on the driver and is the same each time.

Scripts, styles, head, templates, buttons, lists of choices and comments of the markup hold no blocks; graphics end where a block of
the page begins, buttons and lists of choices that another one follows before their end tag too, and other such elements are ignored
if nothing closes them. What a form holds is never main text, unless the form frames a page: it holds a page's parts (a heading of the
first rank, menus, headers, footers, articles, or what is named like one), and then the labeller judges its blocks as if it weren't there. From a
tag on whose quotes never close, quotes are read as plain signs. Character references are decoded, white space inside a block becomes
one space. Null or empty html: ''. Every row is answered; repeated rows alike; extra columns are ignored, whatever their names. Any
length is read whole, in time and memory in proportion to it, however deep its elements are nested.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

TRAIN_PAGES, EPOCHS, BATCH, HIDDEN, RATE, SEED = 4000, 3, 32, 16, 0.01, 11
#: A block is main text from this logit on, a probability of 0.27: to lose a paragraph costs more than to keep a line too many.
LEAST = -1.0
#: Share of blocks that are learned without their words; how much weights shrink at each step, in rates.
BLANK, DECAY = 0.3, 0.01
PATH_DIM, OWN_DIM, WORD_DIM, SHARES = 128, 64, 128, 8
WIDTH = PATH_DIM + OWN_DIM + WORD_DIM + SHARES
#: Characters of pages, and pages, that a worker reads at once.
STEP_CHARS, STEP_PAGES = 4_000_000, 500

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
#: The same where quotes are plain signs.
LOOSE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page: to the end of the page if unclosed; ended by blocks of the page as well; ignored if unclosed.
RAW = frozenset("script style textarea title".split())
FOREIGN = frozenset("svg math".split())
CHOICES = frozenset("button select".split())
SILENT = RAW | FOREIGN | CHOICES | frozenset("noscript template iframe object head canvas audio video datalist".split())
#: Elements that only a form around a page holds; names of such elements are in ARTICLES.
PAGE_PARTS = frozenset("h1 nav main article header footer aside".split())
BREAKOUT = r"<(?:p|div|h[1-6]|ul|ol|dl|table|pre|blockquote|section|article|main|nav|aside|header|footer|body)\b"
#: Elements that a new one of the key closes, up to a container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl blockquote td th".split())


class Node:
    """An open element: its tag and the words of its class, id and role, linked to the element around it."""

    __slots__ = ("tag", "words", "parent", "depth", "block", "form", "frame", "row")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None):
        self.tag, self.words, self.parent, self.row, self.frame = tag, words, parent, None, False
        self.depth = parent.depth + 1 if parent else 1
        self.block = self if tag not in INLINE else parent.block if parent else None
        self.form = self if tag == "form" else parent.form if parent else None

    def in_form(self) -> bool:
        """Whether a form that frames no page is around it."""
        form = self.form
        while form is not None and form.frame:
            form = form.parent.form if form.parent else None
        return form is not None


@dataclass
class Block:
    node: Node | None  # the innermost open element
    text: str
    linked: int  # characters inside of links
    form: bool = False  # content of a form


def _words(attributes: str) -> list[str]:
    found = []
    for m in NAMES.finditer(attributes):
        found += [w.lower() for w in PART.findall(m[1] or m[2] or m[3] or "")]
    return found


CHOICE = re.compile(r"</(button|select)\s*>|<(?:button|select)\b", re.I)
BLOCK = re.compile(BREAKOUT, re.I)


def _choice_end(text: str, tag: str, at: int) -> int | None:
    """Where a button or a list of choices ends: behind its end tag, or where another one or a block begins if that comes first; None if nowhere."""
    end = CHOICE.search(text, at)
    while end is not None and end[1] and end[1].lower() != tag:
        end = CHOICE.search(text, end.end())
    if end is None or end[1]:
        return end and end.end()
    block = BLOCK.search(text, at, end.start())
    return block.start() if block else end.start()


@functools.cache
def _end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>" + (rf"|(?={BREAKOUT})" if tag in FOREIGN else r"|(?=<body\b)" if tag == "head" else ""), re.I)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[Node] = []
    count: Counter[str] = Counter()  # of open elements
    endless: set[str] = set()  # elements that have no end from here on
    parts: list[str] = []
    links = linked = 0
    node: Node | None = None
    text = page or ""

    def flush() -> None:
        nonlocal linked
        if parts:
            body = " ".join("".join(parts).split())
            if body:
                out.append(Block(node, body, min(linked, len(body))))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, node
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            if not parts:
                if not piece.strip():
                    return
                node = stack[-1] if stack else None
            parts.append(piece)
            if links:
                linked += len(piece)

    def framed(inside: Node | None) -> None:
        """All forms around frame a page: they count as if they weren't there."""
        form = inside.form if inside else None
        while form is not None and not form.frame:
            form.frame, form.words = True, ()
            form = form.parent.form if form.parent else None

    def cut(k: int) -> None:
        nonlocal links
        for old in stack[k:]:
            count[old.tag] -= 1
            links -= old.tag == "a"
        del stack[k:]

    # behind the last > no tag can end, and one that needs its quotes to be plain signs is the last whose quotes are tried
    at, n, last, pattern = 0, len(text), text.rfind(">") + 1, TAG
    while at < n:
        m = pattern.search(text, at, last)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        close, tag, attributes = m[1], m[2], m[3]
        if pattern is TAG and m[5]:
            close, tag, attributes, pattern = m[4], m[5], m[6], LOOSE
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if close:
            if count[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
            continue
        if tag in SILENT:
            if tag in CHOICES:
                found = _choice_end(text, tag, at) if tag not in endless else None
                if found is None:
                    endless.add(tag)
                else:
                    at = found
            elif not attributes.rstrip().endswith("/") and tag not in endless:
                end = _end(tag).search(text, at)
                if end is not None:
                    at = end.end()
                elif tag in RAW:
                    at = n
                else:
                    endless.add(tag)
            continue
        ends = CLOSES.get(tag) or (("p",) if tag not in INLINE and tag not in VOID else ())
        if any(count[e] for e in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    cut(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            new = Node(tag, (tag, *_words(attributes)), stack[-1] if stack else None)
            if count["form"] and tag != "form" and (tag in PAGE_PARTS or tag not in INLINE and not NAMED.isdisjoint(new.words[1:])):
                framed(new.parent)
            stack.append(new)
            count[tag] += 1
            links += tag == "a"
    flush()
    for b in out:
        b.form = bool(b.node and b.node.in_form())
    return out


class Slots(dict):
    """The hashed place of each word; remembers a bounded number of words."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        place = self[word] = zlib.crc32(f"{self.dim}:{word}".encode("utf-8", "replace")) % self.dim
        return place


PATH_SLOTS, OWN_SLOTS, WORD_SLOTS = Slots(PATH_DIM), Slots(OWN_DIM), Slots(WORD_DIM)


def _row(node: Node) -> np.ndarray:
    """Hashed words of all elements around a node, then those of its innermost block; kept with the node."""
    missing = []
    while node is not None and node.row is None:
        missing.append(node)
        node = node.parent
    row = node.row if node is not None else np.zeros(PATH_DIM, np.float32)
    for n in reversed(missing):
        row = row.copy()
        row[[PATH_SLOTS[w] for w in n.words]] = 1
        n.row = row
    return row


def vectors(page: list[Block]) -> np.ndarray:
    """One row a block."""
    x = np.zeros((len(page), WIDTH), np.float32)
    count = len(page)
    for k, b in enumerate(page):
        if b.node is not None:
            x[k, :PATH_DIM] = _row(b.node)
            if b.node.block is not None:
                x[k, [PATH_DIM + OWN_SLOTS[w] for w in b.node.block.words]] = 1
        words = b.text.lower().split()
        hashed = np.bincount([WORD_SLOTS[w] for w in words], minlength=WORD_DIM)
        x[k, PATH_DIM + OWN_DIM : -SHARES] = hashed / max(float(np.sqrt(hashed @ hashed)), 1.0)
        size = len(b.text)
        x[k, -SHARES:] = (np.log1p(size) / 8, min(b.linked / size, 1), np.log1p(len(words)) / 6, sum(b.text.count(c) for c in ".,;:!?") / size, k / count, (count - k) / count, (b.node.depth if b.node else 0) / 10, b.text[-1] in ".!?\"'")
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one logistic output a block."""

    def __init__(self, rng: np.random.Generator):
        scale = 1 / np.sqrt(HIDDEN)
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (rng.standard_normal((WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
            self.p[f"U{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * scale).astype(np.float32)
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.p[f"b{d}"] = b
        self.p["V"] = (rng.standard_normal(2 * HIDDEN) * scale).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, d: str, z: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states for inputs z (time x pages x 4H) in the direction d; live (time x pages) masks padding."""
        u, steps, n = self.p[f"U{d}"], z.shape[0], z.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ u
            s = _sigmoid(g[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            v = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * v
            y = np.tanh(new)
            m = live[t][:, None]
            if keep:
                tape.append((t, i, f, o, v, c, h, y, m))
            c, h = np.where(m, new, c), np.where(m, o * y, h)
            out[t] = h
        return out, tape

    def logits(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        hf, _ = self._run("f", x @ self.p["Wf"] + self.p["bf"], live, False)
        hb, _ = self._run("b", x @ self.p["Wb"] + self.p["bb"], live, False)
        return hf @ self.p["V"][:HIDDEN] + hb @ self.p["V"][HIDDEN:] + self.p["c"][0]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        p, grad = self.p, {}
        runs = {d: self._run(d, x @ p[f"W{d}"] + p[f"b{d}"], live, True) for d in "fb"}
        hidden = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        a = hidden @ p["V"] + p["c"][0]
        n = live.sum()
        delta = ((_sigmoid(a) - y) * live / n).astype(np.float32)
        loss = float((np.logaddexp(0, np.where(y > 0, -a, a)) * live).sum() / n)
        grad["V"], grad["c"] = np.einsum("tn,tnh->h", delta, hidden), np.array([delta.sum()], np.float32)
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u = p[f"U{d}"]
            dz = np.zeros((*live.shape, 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh = dc = np.zeros((live.shape[1], HIDDEN), np.float32)
            for t, i, f, o, v, c, h, s, m in reversed(runs[d][1]):
                # delta is 0 where padded, so it only flows through live places
                dh = dh + delta[t][:, None] * p["V"][part]
                own_h, own_c = dh * m, dc * m
                k = own_c + own_h * o * (1 - s * s)
                g = np.concatenate([k * v * i * (1 - i), k * c * f * (1 - f), own_h * s * o * (1 - o), k * i * (1 - v * v)], axis=1)
                dz[t] = g
                du += h.T @ g
                dh, dc = g @ u.T + dh * ~m, k * f + dc * ~m
            flat = dz.reshape(-1, 4 * HIDDEN)
            grad[f"W{d}"], grad[f"U{d}"], grad[f"b{d}"] = x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)
        return grad, loss

    def label(self, pages: list[list[Block]], most: int = 20_000) -> list[np.ndarray]:
        """For each page, which blocks are main text (what a form holds never is); pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and len(pages[order[b]]) * (b + 1 - a) <= most:
                b += 1
            own = order[a:b]
            x, live = padded([vectors(pages[k]) for k in own])
            main = self.logits(x, live) > LEAST
            for j, k in enumerate(own):
                out[k] = main[: len(pages[k]), j] & ~np.array([b.form for b in pages[k]])
            a = b
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, live = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, True
    return x, live


#: The layouts' words: what wraps anything, what holds articles, what holds everything else.
WRAPPERS = "wrapper container page site row col inner layout body root app grid content-area main-wrapper".split()
ARTICLES = "content post entry article story main-content post-body article-body text entry-content page-content body-copy story-body post-content articleBody article-text".split()
NAMED = frozenset(w for name in ARTICLES for w in _words(f"class={name}")) - {"text", "body", "page", "copy"} | {"nav", "navbar", "footer", "header", "sidebar"}
OTHERS = (
    "nav navbar menu main-menu breadcrumb breadcrumbs sidebar side left-sidebar footer header masthead topbar ad ads advert advertisement adsense banner sponsor sponsored promo cookie cookie-banner consent "
    "notice gdpr alert popup modal overlay newsletter subscribe signup login share social sharing related related-posts recommended trending popular tags tag-list widget copyright legal pagination pager "
    "search toolbar skip-link disclaimer announcement notification links blogroll meta-links site-footer site-header author-bio read-more"
).split()
COMMENTS = "comments comment comment-list commentlist reply replies discussion responses disqus comment-body user-comments feedback".split()


#: Phrases of menus, notices, adverts and other frames of pages, and words that running text is full of, in four languages.
PHRASES = (
    "home|about|about us|contact|contact us|news|blog|login|log in|sign in|sign up|register|my account|search|menu|cart|checkout|shop|products|services|support|help|faq|careers|press|sitemap|archive|categories|tags|"
    "subscribe|subscribe to our newsletter|enter your email|follow us|share|share this|tweet|facebook|twitter|instagram|youtube|rss|email|print|read more|continue reading|related posts|related articles|you may also like|most popular|"
    "trending now|recent posts|previous|next|back to top|skip to content|advertisement|sponsored|sponsored content|ad|buy now|sale|shop now|order today|free shipping|special offer|limited time offer|cheap|"
    "privacy policy|terms of service|terms of use|cookie policy|we use cookies|accept all|accept cookies|this site uses cookies to improve your experience|all rights reserved|copyright|powered by|disclaimer|legal notice|"
    "startseite|über uns|kontakt|impressum|datenschutz|anmelden|registrieren|suche|warenkorb|werbung|anzeige|mehr lesen|weiterlesen|newsletter abonnieren|teilen|agb|alle rechte vorbehalten|nach oben|verwandte artikel|jetzt kaufen|"
    "accueil|à propos|nous contacter|mentions légales|connexion|inscription|rechercher|panier|publicité|partager|lire la suite|politique de confidentialité|tous droits réservés|articles similaires|acheter|s'abonner|"
    "inicio|acerca de|contacto|aviso legal|iniciar sesión|registrarse|buscar|carrito|publicidad|compartir|leer más|política de privacidad|todos los derechos reservados|artículos relacionados|comprar ahora|suscribirse"
).split("|")
RUNNING = (
    "the of and to in a is that it was for on are as with they be at this have from or had by but what some we can out other were all there when up use how said an each she which do their time if will way many then them would so these her him has more two could no than first been who its now people my made over did down only find long after thing our just name good sentence man think say great where help through much before line right too means old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask went men read need land different home us move try kind hand picture again change off play spell air away animal house point page letter mother answer found study still learn should world "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son elle mais comme ou si leur y dont tout nous sa fait été aussi bien ses cette entre "
    "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque"
).split()


class Grammar:
    """Draws labelled pages."""

    def __init__(self, rng: np.random.Generator):
        self.rng = random.Random(int(rng.integers(1 << 62)))
        letters = "abcdefghijklmnoprstuvwéèüñöäß"
        self.lexicon = ["".join(self.pick(letters) for _ in range(self.number(2, 10))) for _ in range(3000)]

    def number(self, low: int, high: int) -> int:
        return low + int(self.rng.random() * (high - low))

    def pick(self, options):
        return options[int(self.rng.random() * len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def text(self, low: int, high: int) -> str:
        """Words that no language has, or words of running text among them; sometimes with odd signs."""
        n = self.number(low, high)
        share, stops = self.pick([0.0, 0.3, 0.6]), self.pick([0.1, 0.1, 0.4])
        words = [self.pick(RUNNING) if self.chance(share) else self.pick(self.lexicon) for _ in range(n)]
        signs = self.pick([",", ".", ";"]) if self.chance(0.85) else self.pick(["*", "#", "-", "&", "%", "$", "/", "1", "9"]) * self.number(1, 4)
        for k in range(n):
            if self.chance(stops):
                words[k] += self.pick([signs, ",", "."])
        between = self.pick([" | ", " * ", " / ", " - "]) if self.chance(0.06) else " "
        out = between.join(words).capitalize() + (self.pick([" ©", " ©", " ®", " ™"]) if self.chance(0.08) else "")
        return out + self.pick([".", ".", ".", "", "!", "?"])

    def frame(self, low: int, high: int) -> str:
        """Text of menus and the like: often one of their phrases, alone or with other words."""
        if self.chance(0.5):
            return self.text(low, high)
        phrase = self.pick(PHRASES)
        phrase = self.pick([phrase, phrase.capitalize(), phrase.title()])
        return phrase if self.chance(0.6) else self.pick([f"{phrase}: {self.text(1, 6)}", f"{phrase} {self.text(1, 8)}", f"{phrase} | {self.pick(PHRASES)}"])

    def named(self, tag: str, words: list[str], body: str) -> str:
        extra = f" {self.pick(words)}" if self.chance(0.2) else ""
        return f'<{tag} {self.pick(["class", "class", "id"])}="{self.pick(words)}{extra}">{body}</{tag}>'

    def mark(self, body: str, main: bool) -> str:
        # private-use marks carry the label through parsing
        return f"{chr(0xE000 + main)}{body}"

    def links(self) -> str:
        items = [f'<a href="/x">{self.mark(self.frame(1, 4), False)}</a>' for _ in range(self.number(2, 9))]
        if self.chance(0.2):  # one block of links
            return self.pick(["{}", "<div>{}</div>", "<p>{}</p>"]).format(self.pick([" ", " | ", " · ", "&nbsp; "]).join(items))
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.7) else "".join(self.pick(["<div>{}</div>", "<span>{}</span><br>"]).format(x) for x in items)

    def plain(self, low: int = 2, high: int = 40) -> str:
        body = self.mark(self.frame(low, high), False)
        return self.pick(["{}", "<p>{}</p>", "<span>{}</span>", "<div>{}</div>", "<h3>{}</h3><p>" + self.mark(self.frame(3, 20), False) + "</p>"]).format(body)

    def form(self) -> str:
        if self.chance(0.4):
            return f"<form><h3>{self.mark(self.frame(1, 4), False)}</h3><p>{self.mark(self.pick([self.frame, self.text])(1, 25), False)}</p><input name=e></form>"
        return f"<form><label>{self.mark(self.frame(1, 4), False)}</label><input name=q><select><option>{self.frame(1, 3)}</option></select><button>{self.frame(1, 3)}</button></form>"

    def other(self) -> str:
        body = "".join(self.pick([self.links, self.plain, self.plain, self.form])() for _ in range(self.number(1, 3)))
        if self.chance(0.35):
            return f"<{(t := self.pick(['nav', 'aside', 'footer', 'header', 'aside']))}>{body}</{t}>"
        return self.named(self.pick(["div", "div", "section", "ul", "nav", "aside", "footer", "header", "p"]), OTHERS, body)

    def comments(self) -> str:
        one = lambda: self.named(self.pick(["div", "li", "article", "section"]), COMMENTS, f"<p>{self.mark(self.text(3, 60), False)}</p>" * 1)
        return self.named(self.pick(["div", "section", "ol"]), COMMENTS, (f"<h3>{self.mark(self.frame(1, 4), False)}</h3>" if self.chance(0.6) else "") + "".join(one() for _ in range(self.number(1, 6))))

    def paragraph(self) -> str:
        body = self.mark(self.text(1, self.pick([4, 90, 90, 90])), True)
        kind = self.rng.random()
        if kind < 0.6:
            return f"<p>{body}</p>"
        if kind < 0.7:
            return f"<p><b>{body}<br>"
        if kind < 0.76:
            return f"<h2>{self.mark(self.text(1, 8), True)}</h2>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{self.mark(self.text(1, 20), True)}</li>" for _ in range(self.number(1, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.88:
            return "<dl>" + "".join(f"<dt>{self.mark(self.text(1, 4), True)}<dd>{self.mark(self.text(2, 40), True)}" for _ in range(self.number(1, 5))) + "</dl>"
        if kind < 0.91:
            return f"<p>{body} <a href=/y>{self.text(1, 3)}</a> {self.text(1, 9)}</p>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.mark(self.text(1, 5), True)}</td></tr>" for _ in range(self.number(1, 4))) + "</table>"
        if kind < 0.96:  # articles may talk of what frames talk of
            return f"<p>{self.mark(self.text(2, 20) + ' ' + self.pick(PHRASES) + ' ' + self.text(2, 20), True)}</p>"
        return f"<div>{body}</div>"

    def prose(self, low: int, high: int) -> str:
        """Running text in paragraphs, in bare elements, in lines, or as definitions."""
        texts = [self.mark(self.text(8, 90), True) for _ in range(self.number(low, high))]
        style = self.rng.random()
        if style < 0.3:
            return "".join(f"<p>{x}</p>" for x in texts)
        if style < 0.6:
            return "".join(f"<div>{x}</div>" for x in texts)
        if style < 0.9:
            return self.pick(["<br><br>", "<br>", "<br /><br />"]).join(texts)
        return "<dl>" + "".join(f"<dt>{self.mark(self.text(1, 4), True)}</dt><dd>{x}</dd>" for x in texts) + "</dl>"

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(self.number(1, 14))] if self.chance(0.8) else [self.prose(1, 5), self.prose(1, 5)]
        if self.chance(0.3):  # something else between paragraphs, and often one right after it
            parts.insert(self.pick([self.number(0, len(parts) + 1), len(parts) - 1]), self.pick([self.form, self.form, self.other])())
        main = "".join(parts)
        title = f"<h1>{self.mark(self.text(1, 12), True)}</h1>"
        return (f"<header>{title}</header>" if self.chance(0.1) else title if self.chance(0.8) else "") + main

    def bare(self) -> str:
        """A page laid out by a table, or by elements without names."""
        many = lambda low: "".join(self.pick([self.links, self.links, self.plain])() for _ in range(self.number(low, 3)))
        main = (f"<h1>{self.mark(self.text(2, 12), True)}</h1>" if self.chance(0.7) else "") + self.prose(1, 9)
        if self.chance(0.3):  # nothing but text
            main = main if self.chance(0.5) else self.prose(1, 3)
            return self.pick(["{}", "<div>{}</div>", '<div id="{}">{{}}</div>'.format(self.pick(ARTICLES + WRAPPERS)), "<div><div>{}</div></div>"]).format(main)
        if self.chance(0.5):
            side = f"<td>{many(0)}</td>"
            middle = f"<tr>{side}<td>{main}</td></tr>" if self.chance(0.5) else f"<tr><td>{main}</td>{side}</tr>"
            return f"<table><tr><td>{many(1)}</td></tr>{middle}<tr><td>{many(0)}{self.mark('© ' + self.frame(2, 14), False)}</td></tr></table>"
        out = f"<div>{many(1)}</div><div>{main}</div><div>{many(0)}{self.mark('© ' + self.frame(2, 14), False)}</div>"
        return f"<div>{out}</div>" if self.chance(0.3) else out

    def page(self) -> str:
        if self.chance(0.25):
            return f"<html><head><title>{self.text(1, 9)}</title></head><body>{self.bare()}</body></html>"
        main = self.article()
        if self.chance(0.25):
            main += self.other()
        if self.chance(0.15):
            main = main.replace("</p>", "</p>" + self.named(self.pick(["div", "aside"]), OTHERS, self.plain()), 1)
        if self.chance(0.1):
            main += self.comments()
        kind = self.rng.random()
        body = f"<article>{main}</article>" if kind < 0.45 else f"<main>{main}</main>" if kind < 0.6 else self.named("div", ARTICLES, main) if kind < 0.9 else self.named("article", ARTICLES, main)
        if self.chance(0.15):
            body = f"<main>{body}</main>"
        before = "".join(self.other() for _ in range(self.number(0, 4)))
        after = (self.comments() if self.chance(0.3) else "") + "".join(self.other() for _ in range(self.number(0, 4)))
        if self.chance(0.5):
            after += f"<footer>{self.mark('© ' + self.frame(2, 14), False)}</footer>"
        out = before + body + after
        while self.chance(0.35):
            out = self.named("div", WRAPPERS, out)
        return f"<html><head><title>{self.text(1, 9)}</title></head><body>{out}</body></html>"

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        while True:
            page = blocks(self.page())
            labels = np.array([b.text[0] == chr(0xE001) for b in page], np.float32)
            for b in page:
                b.text = b.text.replace(chr(0xE000), "").replace(chr(0xE001), "") or "x"
            if page:
                x = vectors(page)
                # blocks without their words, so that what encloses them is learned for its own sake
                x[[self.chance(BLANK) for _ in page], PATH_DIM + OWN_DIM : -SHARES] = 0
                return x, labels


_trained: dict[tuple, Labeller] = {}


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """The labeller, fitted by Adam on synthetic pages; the same for the same arguments."""
    if (pages, epochs, seed) in _trained:
        return _trained[pages, epochs, seed]
    rng = np.random.default_rng(seed)
    grammar, model = Grammar(rng), Labeller(rng)
    data = [grammar.sample() for _ in range(pages)]
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step, steps = 0, epochs * -(-pages // BATCH)
    for _ in range(epochs):
        order = sorted(rng.permutation(pages).tolist(), key=lambda k: len(data[k][0]) // 8)
        batches = [order[a : a + BATCH] for a in range(0, pages, BATCH)]
        for k in rng.permutation(len(batches)).tolist():
            x, live = padded([data[i][0] for i in batches[k]])
            y = np.zeros(live.shape, np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(data[i][1]), j] = data[i][1]
            grad, _ = model.gradients(x, live, y)
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            norm = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            for name, g in grad.items():
                g = g / max(norm, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] = (model.p[name] * (1 - rate * DECAY) - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    _trained[pages, epochs, seed] = model
    return model


def _steps(pages: list[str | None]) -> Iterator[tuple[int, int]]:
    for a, b in tokens.chunks([len(p or "") for p in pages], STEP_CHARS):
        for k in range(a, b, STEP_PAGES):
            yield k, min(k + STEP_PAGES, b)


def main_text(page: list[Block], main: np.ndarray) -> str:
    return " ".join(b.text for b, m in zip(page, main, strict=True) if m)


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row of pages."""
    model = model or train()
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_main", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _steps(batch.column(2).to_pylist()):
                part = batch.slice(a, b - a)
                read = [blocks(h) for h in part.column(2).to_pylist()]
                marks = model.label(read)
                texts = [main_text(p, m) for p, m in zip(read, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, read), pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())], schema=pa.schema(fields))

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(common.table(spark, sf_dir, "pages"))
