"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of a page.

The project keeps no web pages, so this operator is general. Records: pages
(page_id, url, html, any further columns). A null html counts as empty; a page
without main text gives an empty text. Repeated rows are pages like any other.

A page is cut into leaf blocks, the text between two block-level tags. A block's
features are the tags, classes and ids of its ancestors and properties of its text;
its label is main or other. Weights are trained by gradient steps on the likelihood
of labelled pages and the best labels of a page found by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: tags that end a block of text, that hold no text to show, that
# have no end tag, and that an opening tag closes when it is still open.
BLOCKS = frozenset("address article aside blockquote body br button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
                   "title tr ul video audio".split())
HIDDEN = frozenset("script style noscript template textarea svg iframe title".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
          "option": {"option"}} | {t: {"p"} for t in ("div", "ul", "ol", "article", "section", "aside", "nav", "footer", "header", "h1", "h2", "h3", "h4", "h5", "h6",
                                                     "table", "form", "blockquote", "pre", "dl", "main", "figure", "hr", "address", "fieldset")}
# A scope keeps an end tag or an implied end inside it.
SCOPES = frozenset("html body table td th div article section aside nav footer header main ul ol dl form li".split())
TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>?", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDE = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
WORD = re.compile(r"[a-z]+")


def leaf_blocks(page: str | None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, ancestor marks, share of link text) of each leaf block, in page order; text is decoded, white space is one space."""
    page = page or ""
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked = plain = 0
    marks: tuple[str, ...] = ()
    hidden = links = 0

    def flush() -> None:
        nonlocal linked, plain
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, marks, linked / max(1, linked + plain)))
            parts.clear()
            linked = plain = 0

    def pop() -> None:
        nonlocal marks, hidden, links
        name, marks, hid = stack.pop()
        hidden -= hid
        links -= name == "a"

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not hidden:
            run = page[at:stop]
            parts.append(run)
            if links:
                linked += len(run)
            else:
                plain += len(run)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES and tag not in SCOPES:
                    break
            continue
        rest = m.group(3)
        if tag in ("script", "style", "textarea", "template", "noscript", "iframe", "title"):
            if not rest.endswith("/"):
                end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in EMPTY or rest.endswith("/"):
            continue
        implied = CLOSES.get(tag)
        if implied:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in implied:
                    while len(stack) > i:
                        pop()
                elif stack[i][0] in SCOPES:
                    break
        hid = tag in HIDDEN or bool(rest and HIDE.search(rest))
        stack.append((tag, marks, hid))
        hidden += hid
        links += tag == "a"
        if tag in BLOCKS or rest:
            new = [tag] if tag in BLOCKS else []
            for a, b, c in NAMES.findall(rest) if rest else ():
                new += ["." + w for w in WORD.findall((a or b or c).lower())]
            marks = marks + tuple(new)
    flush()
    return out


def text_marks(text: str, link_share: float) -> list[str]:
    """Features of a block's text."""
    words = text.count(" ") + 1
    low = text.lower()
    return [f"words{min(7, words.bit_length())}", f"links{int(link_share * 3.99)}", "stop" if text[-1] in ".!?…:\"'”" else "open",
            "sign" if "©" in text or "copyright" in low or "all rights" in low else "nosign", f"commas{min(2, text.count(','))}"]


def page_features(blocks: list[tuple[str, tuple[str, ...], float]], memo: dict) -> list[list[str]]:
    """Features per block: each ancestor mark, the nearest two tags, text features, and the ends of the page."""
    out = []
    for i, (text, marks, share) in enumerate(blocks):
        same = memo.get(marks)
        if same is None:
            tags = [t for t in marks if t[0] != "."]
            same = memo[marks] = [f"in:{t}" for t in set(marks)] + [f"tag:{tags[-1] if tags else ''}", f"path:{'>'.join(tags[-2:])}", "bias"]
        out.append(same + text_marks(text, share) + ([f"first{i}"] if i < 2 else []) + (["last"] if i == len(blocks) - 1 else []))
    return out


# ---- labelled pages -----------------------------------------------------------------------------

#: A private-use character that labelled main text carries through the parser.
MARK = "\ue000"

_SITE_PARTS = {
    "header": ["<header><div class='brand'>{s}</div></header>", "<div id='header'><h2>{s}</h2></div>", "<div class='top header'><span>{s}</span></div>"],
    "menu": ["<nav><ul>{l}</ul></nav>", "<ul class='menu'>{l}</ul>", "<div class='navbar'>{a}</div>", "<div role='navigation'>{a}</div>", "<div class='breadcrumbs'>{a}</div>"],
    "advert": ["<div class='ad'>{p}</div>", "<aside class='advert'>{p}</aside>", "<div id='sponsored'><p>{p}</p></div>", "<div class='ads banner'>{s}</div>", "<ins class='promo'>{p}</ins>"],
    "notice": ["<div class='cookie notice'><p>{p}</p><button>{s}</button></div>", "<div id='consent'>{p}</div>", "<div class='alert'>{s}</div>", "<div class='notice'>{p}</div>", "<dialog>{p}</dialog>"],
    "sidebar": ["<aside><h3>{s}</h3><ul>{l}</ul></aside>", "<div class='sidebar'><h3>{s}</h3><p>{p}</p></div>", "<div id='related'>{a}</div>", "<aside><p>{p}</p></aside>", "<div class='widget'>{p}</div>"],
    "form": ["<form><label>{s}</label><input name='q'><button>{s}</button></form>", "<form class='newsletter'><p>{p}</p><select><option>{s}</option></select></form>"],
    "comments": ["<section class='comments'><h3>{s}</h3><div class='comment'><p>{p}</p></div><div class='comment'><p>{p}</p></div></section>",
                 "<div id='comments'><ul><li>{p}</li><li>{p}</li></ul></div>", "<div class='replies'><article class='comment'><p>{p}</p></article></div>"],
    "footer": ["<footer>&copy; {s} &middot; {p}</footer>", "<div class='footer'><p>&copy; {s}</p>{a}</div>", "<footer><p>{p}</p><ul>{l}</ul></footer>", "<div id='footer'>{p}</div>"],
}
_FRAMES = ["<article>{x}</article>", "<main><article>{x}</article></main>", "<main>{x}</main>", "<div class='content'>{x}</div>", "<div id='article'>{x}</div>",
           "<div class='post body'>{x}</div>", "<section class='story'>{x}</section>", "<div itemprop='articleBody' class='entry'>{x}</div>", "<article>{x}</article>"]
_INNER = ["<p>{p}</p>", "<p>{p}<br>{p}</p>", "<p>{p}", "<p><b>{s}</b><br><p>{p}</p>", "<h2>{s}</h2>", "<ul><li>{p}</li><li>{s}</li></ul>", "<blockquote>{p}</blockquote>",
          "<table><tr><td>{s}</td><td>{s}</td></tr></table>", "<p>{p} <a href='/x'>{s}</a> {p}</p>", "<pre>{p}</pre>", "<p>{s}</p>", "<div>{p}</div>", "<p><b>{s}.<br>"]


def labelled_pages(n: int, seed: int = 7) -> list[tuple[list, list[int]]]:
    """n generated pages as (blocks, labels): site parts and articles in many layouts, each marked when it is written.

    Main blocks carry a private mark character that is taken off again, so labels
    follow the blocks through the parser.
    """
    rng = random.Random(seed)

    def words(k: int, mark: str) -> str:
        return " ".join(mark + "".join(rng.choice("abcdeghilmnoprstuäéß") for _ in range(rng.randint(1, 9))) for _ in range(k))

    def fill(form: str, mark: str) -> str:
        def text(kind: str) -> str:
            if kind == "s":
                return words(rng.randint(1, 6), mark)
            if kind == "p":
                return ". ".join(words(rng.choice((3, 8, 15, 30)), mark).capitalize() + (", " + words(3, mark)) * rng.randint(0, 2) for _ in range(rng.randint(1, 3))) + "."
            link = [f"<a href='/{i}'>{words(rng.randint(1, 3), mark)}</a>" for i in range(rng.randint(2, 6))]
            return " ".join(link) if kind == "a" else "".join(f"<li>{x}</li>" for x in link)

        return re.sub(r"\{([spla])\}", lambda m: text(m.group(1)), form)

    pages = []
    for _ in range(n):
        part = {k: [fill(rng.choice(v), "") for _ in range(rng.randint(0, 1) if k not in ("menu", "footer", "advert") else rng.randint(0, 2))] for k, v in _SITE_PARTS.items()}
        body = [fill(f"<{h}>{{s}}</{h}>", "") for h in [rng.choice(("h1", "h1", "h2"))] if rng.random() < 0.8]
        for _ in range(rng.choice((1, 2, 4, 8, 14))):
            body.append(fill(rng.choice(_INNER[:4] if rng.random() < 0.7 else _INNER), ""))
            if rng.random() < 0.12:
                body.append(fill(rng.choice(_SITE_PARTS[rng.choice(("advert", "form", "sidebar", "notice"))]), ""))
        article = rng.choice(_FRAMES).format(x="".join(body)) if rng.random() < 0.97 else ""
        page = ["<html><head><title>" + words(4, "") + "</title></head><body>", *part["header"], *part["menu"], *part["notice"], *part["advert"][:1]]
        page += [article, *part["comments"], *part["sidebar"], *part["advert"][1:], *part["form"], *part["footer"]]
        blocks, labels = [], []
        for text, marks, share in leaf_blocks("".join(page) + rng.choice(("</body></html>", ""))):
            labels.append(int("" in text))
            blocks.append((text.replace("", ""), marks, share))
        pages.append((blocks, labels))
    return pages


# ---- the field ----------------------------------------------------------------------------------

class Field:
    """A two-label linear chain: a weight per feature for label 1 against 0, and 2 x 2 transitions."""

    def __init__(self, weights: dict[str, float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, scores: list[float]) -> list[int]:
        """The best labels of a page by Viterbi."""
        m = self.moves
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            a0, a1, b0, b1 = a + m[0][0], b + m[1][0], a + m[0][1], b + m[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            a, b = max(a0, a1), max(b0, b1) + s
        label = [int(b > a)]
        for step in reversed(back):
            label.append(step[label[-1]])
        return label[::-1]


def train(pages: list[tuple[list, list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Adaptive gradient steps on the log-likelihood, one page at a time; gradients by forward and backward sums."""
    memo: dict = {}
    code: dict[str, int] = {}
    data = []
    for blocks, labels in pages:
        if blocks:
            feats = [[code.setdefault(f, len(code)) for f in x] for x in page_features(blocks, memo)]
            data.append((np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(feats)), [len(f) for f in feats]), np.array(labels)))
    w, g = np.zeros(len(code)), np.full(len(code), 1e-2)
    moves, gm = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    for _ in range(rounds):
        for feats, owner, y in data:
            n = len(y)
            s = np.bincount(owner, w[feats], n)
            e = np.c_[np.zeros(n), s]
            fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
            fw[0] = e[0]
            for i in range(1, n):
                x = fw[i - 1][:, None] + moves
                fw[i] = np.logaddexp(x[0], x[1]) + e[i]
            for i in range(n - 2, -1, -1):
                x = moves + (e[i + 1] + bw[i + 1])[None, :]
                bw[i] = np.logaddexp(x[:, 0], x[:, 1])
            z = np.logaddexp(*fw[-1])
            grad = np.bincount(feats, (y - np.exp(fw[:, 1] + bw[:, 1] - z))[owner], len(w)) - ridge * w
            g += grad**2
            w += rate * grad / np.sqrt(g)
            if n > 1:
                pair = np.exp(fw[:-1, :, None] + moves[None] + (e[1:] + bw[1:])[:, None, :] - z).sum(0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                step = seen - pair
                gm += step**2
                moves += rate * step / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in code.items() if w[i]}, moves.tolist())


def main_text(page: str | None, field: Field, memo: dict) -> str:
    """The blocks labelled main, in page order, joined by one space."""
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    weights, scores = field.weights, []
    for i, (text, marks, share) in enumerate(blocks):
        base = memo.get(marks)
        if base is None:
            base = memo[marks] = sum(weights.get(f, 0.0) for f in page_features([("x", marks, 0.0)], {})[0][:-len(text_marks("x", 0.0)) - 2])
        score = base + sum(weights.get(f, 0.0) for f in text_marks(text, share))
        if i < 2:
            score += weights.get(f"first{i}", 0.0)
        if i == len(blocks) - 1:
            score += weights.get("last", 0.0)
        scores.append(score)
    return " ".join(b[0] for b, y in zip(blocks, field.decode(scores), strict=True) if y)


def page_texts(pages: DataFrame, labelled: int = 400) -> DataFrame:
    """(page_id, url, text, n_chars) for every page. `labelled`: how many generated pages the field is trained on."""
    field = train(labelled_pages(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            texts = [main_text(p, field, memo) for p in b.column("html").to_pylist()]
            if len(memo) > 100_000:
                memo.clear()
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
