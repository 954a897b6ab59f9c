"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (text between two block tags) with the tags, classes and ids above them. Each block is in the
article or not; the field scores a label by ancestor and text features and by the label before, is trained by maximum likelihood
on labelled pages (laid out by ``labelled_pages`` from a seed: layouts with and without semantic tags), and decodes with Viterbi.
Training sees a fixed, small number of pages on the driver; all pages are decoded in Spark tasks, each on its own.

Cases: null or empty html gives the empty text. Unclosed and stray tags are borne as browsers do; scripts, styles, comments,
templates, frames, text areas and selections are never text; formulas and drawings are inline text, noscript and xmp are blocks. Pages of any length are read whole. Repeated rows each get their row; other columns are kept.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from featherloom.llm.bpe import _schema, _with

ROWS = 64
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "template", "textarea", "iframe", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "math",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "wbr"}
FOREIGN = {"math", "svg"}      # all tags inside these are inline
#: An opening tag on the left ends an open one on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
          "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Path:
    """An open tag below its parent's path. Blocks share paths, so that a page needs memory for its tags, however deep."""

    __slots__ = ("leaf", "new", "parent")

    def __init__(self, parent: "Path | None", new: tuple[str, ...], leaf: str):
        self.parent, self.new, self.leaf = parent, new, leaf      # features that no tag above has; the innermost block tag


ROOT = Path(None, ("any",), "-")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: Path, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _name(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role, as one string."""
    if "=" not in attributes:
        return tag
    words = {w for m in ATTRIBUTE.finditer(attributes) for w in re.findall(r"[a-z]+", (m[2] or m[3] or m[4] or "").lower())}
    return " ".join([tag, *sorted(words)])


@functools.lru_cache(4096)
def _tag_features(name: str) -> tuple[str, ...]:
    """Features of a tag with its words."""
    tag, *words = name.split(" ")
    return (() if tag in INLINE and tag != "a" else (f"tag {tag}",)) + tuple(f"word {w}" for w in words)


def leaf_blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, without empty ones. Character references are decoded, white space becomes one blank."""
    out: list[Block] = []
    tags: list[str] = []
    count: Counter[str] = Counter()       # open tags by name
    paths: list[Path] = [ROOT]
    above: list[tuple[str, ...]] = []      # features of each open tag
    seen: Counter[str] = Counter()
    parts: list[str] = []
    linked = foreign = 0

    def text(upto: str) -> None:
        nonlocal linked
        if upto:
            t = entities.unescape(upto) if "&" in upto else upto
            parts.append(t)
            linked += len(t) if count["a"] else 0

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(parts).split())
        if whole:
            out.append(Block(whole, paths[-1], linked))
        parts.clear()
        linked = 0

    def close(n: int) -> None:
        nonlocal foreign
        while len(tags) > n:
            tag = tags.pop()
            count[tag] -= 1
            foreign -= tag in FOREIGN
            seen.subtract(above.pop())
            paths.pop()

    at = 0
    while m := TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        inline, edge = tag in INLINE, len(tags)
        if foreign and not inline:
            edge = next(i for i, t in enumerate(tags) if t in FOREIGN)
            # a block, or the end of one around, leaves a formula or drawing that was not closed
            if (count[tag] and tag not in tags[edge:]) if m[1] else tag in ENDS_P:
                close(edge)
            else:
                inline = True
        if m[1]:
            if not inline:
                flush()
            if count[tag]:
                last = next(i for i in range(len(tags) - 1, -1, -1) if tags[i] == tag)
                # a closing inline tag does not reach out of its block
                if not inline or last >= edge or all(t in INLINE for t in tags[last:]):
                    close(last)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if tag == "xmp":       # a block of plain characters: neither tags nor references are read in it
            flush()
            end = re.compile(r"</xmp\s*>", re.I).search(html, at)
            parts.append(html[at : end.start()] if end else html[at:])
            flush()
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            parts.append(" ")
        if not inline:
            flush()
            if count["p"] and tag in ENDS_P:
                close(tags.index("p"))
            while tags and tags[-1] in ENDS.get(tag, ()):
                close(len(tags) - 1)
        if tag not in VOID and not m[3].endswith("/"):
            tags.append(tag)
            count[tag] += 1
            foreign += tag in FOREIGN
            features = _tag_features(_name(tag, m[3]))
            paths.append(Path(paths[-1], tuple(f for f in features if not seen[f]), paths[-1].leaf if tag in INLINE else tag))
            above.append(features)
            seen.update(features)
    text(html[at:])
    flush()
    return out


def path_features(path: Path) -> list[str]:
    found, at = [f"leaf {path.leaf}"], path
    while at is not None:
        found.extend(at.new)
        at = at.parent
    return sorted(found)


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    size = "1" if words < 2 else "3" if words < 4 else "8" if words < 9 else "20" if words < 21 else "more"
    out = [f"size {size}"]
    if 2 * b.linked > len(b.text):
        out.append("linked")
    if b.text[-1] in ".!?…:;\"'”»":
        out.append("ends")
    if "©" in b.text or "(c)" in b.text.lower()[:40]:
        out.append("rights")
    return out


class Field:
    """Weights of the chain: feature and label, label and label before."""

    def __init__(self):
        self.w: dict[str, list[float]] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]

    def scores(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        known: dict[Path, tuple[float, float]] = {}      # running sums down the paths of the page
        for b in blocks:
            open_, at = [], b.path
            while at is not None and at not in known:
                open_.append(at)
                at = at.parent
            base = known[at] if at is not None else (0.0, 0.0)
            for at in reversed(open_):
                more = self._sum(at.new)
                base = known[at] = (base[0] + more[0], base[1] + more[1])
            more = self._sum([f"leaf {b.path.leaf}", *text_features(b)])
            out.append((base[0] + more[0], base[1] + more[1]))
        return out

    def _sum(self, features: Sequence[str]) -> tuple[float, float]:
        got = [w for f in features if (w := self.w.get(f))]
        return sum(w[0] for w in got), sum(w[1] for w in got)

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        if not blocks:
            return []
        s, back = self.scores(blocks), []
        a, b = self.start[0] + s[0][0], self.start[1] + s[0][1]
        (t00, t01), (t10, t11) = self.step
        for x, y in s[1:]:
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00) + x, (b + t11 if from1 else a + t01) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> "Field":
        """Stochastic gradient on the log-likelihood, each weight with its own rate."""
        power: dict = defaultdict(lambda: 1e-6)

        def move(key, value: list[float], i: int, grad: float) -> None:
            grad -= decay * value[i]
            power[key, i] += grad * grad
            value[i] += rate * grad / math.sqrt(power[key, i])

        for _ in range(rounds):
            for blocks, gold in pages:
                if not blocks:
                    continue
                node, pair = self._marginals(self.scores(blocks))
                for k, (b, y) in enumerate(zip(blocks, gold, strict=True)):
                    for f in path_features(b.path) + text_features(b):
                        w = self.w.setdefault(f, [0.0, 0.0])
                        for i in (0, 1):
                            move(f, w, i, (y == i) - node[k][i])
                for k in range(1, len(blocks)):
                    for i in (0, 1):
                        for j in (0, 1):
                            move(("step", i), self.step[i], j, (gold[k - 1] == i and gold[k] == j) - pair[k - 1][i][j])
                for i in (0, 1):
                    move("start", self.start, i, (gold[0] == i) - node[0][i])
        return self

    def _marginals(self, s):
        """Label probabilities of each block and of each pair of neighbours, by forward and backward sums."""
        n, t = len(s), [[math.exp(v) for v in row] for row in self.step]
        e = [[math.exp(v - max(x)) for v in x] for x in s]
        m = max(self.start)
        f = [self._unit([math.exp(self.start[i] - m) * e[0][i] for i in (0, 1)])]
        for k in range(1, n):
            f.append(self._unit([sum(f[-1][i] * t[i][j] for i in (0, 1)) * e[k][j] for j in (0, 1)]))
        b = [[1.0, 1.0]]
        for k in range(n - 1, 0, -1):
            b.append(self._unit([sum(t[i][j] * e[k][j] * b[-1][j] for j in (0, 1)) for i in (0, 1)]))
        b.reverse()
        node = [self._unit([x[0] * y[0], x[1] * y[1]]) for x, y in zip(f, b, strict=True)]
        pair = []
        for k in range(1, n):
            p = [[f[k - 1][i] * t[i][j] * e[k][j] * b[k][j] for j in (0, 1)] for i in (0, 1)]
            total = sum(map(sum, p))
            pair.append([[v / total for v in row] for row in p])
        return node, pair

    @staticmethod
    def _unit(x: list[float]) -> list[float]:
        total = x[0] + x[1]
        return [x[0] / total, x[1] / total]


# Parts of the training pages: tags of holders, outer ones first, by what they hold; a question mark is a word that no other page has.
HOLDERS = {
    "article": ["article", "main", "main|article", "div class='content'", "div class='post body'", "div id='story'", "section class='entry content'", "div class='article text'",
                "div role='main'", "div class='?'", "div class='?'", "div class='?'|div class='?'", "div", "section", "div class='wrap'|div class='?'"],
    "header": ["header", "div class='header'", "div id='masthead'", "header class='site top'"],
    "menu": ["nav", "div class='menu'", "ul class='nav navigation'", "div id='navbar'", "div class='breadcrumb'", "nav class='menu'", "div class='pagination'", "div class='tags'"],
    "advert": ["div class='ad'", "div class='advert banner'", "aside class='ads'", "div id='sponsored'", "div class='promo'", "section class='advertisement'", "ins class='adsbygoogle'"],
    "sidebar": ["aside", "div class='sidebar'", "div id='side'", "aside class='widget related'", "section class='related'", "div class='recommended'"],
    "notice": ["div class='notice'", "div class='cookie banner'", "div id='consent'", "div class='alert'", "section class='newsletter subscribe'", "div class='popup modal'", "div role='alert'", "noscript"],
    "form": ["form", "form class='search'", "form id='login'", "div class='form'|form"],
    "comments": ["section class='comments'", "div id='comments'", "ol class='comment list'", "div class='comment'", "div class='discussion responses'", "div id='disqus thread'"],
    "footer": ["footer", "div class='footer'", "div id='foot'|footer", "div class='copyright'"],
}


def labelled_pages(count: int = 260, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Pages laid out at random from the parts above; a mark in front of each article text gives its label and is taken off again."""
    rng = random.Random(seed)
    mark = "\ue000"
    syllables = [a + b for a in "b c d f g l m n p r s t v".split() for b in ("a", "e", "i", "o", "u", "en", "ar", "is")]

    def words(lo: int, hi: int, end: str = "") -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))).capitalize() + end

    def sentence(lo: int, hi: int) -> str:
        return words(lo, hi, rng.choice([".", ".", ".", "!", "?", "", " ...", "%"]))

    def held(kind: str, inner: str) -> str:
        tags = [t.replace("?", words(1, 1).lower()) for t in rng.choice(HOLDERS[kind]).split("|")]
        return "".join(f"<{t}>" for t in tags) + inner + "".join(f"</{t.split()[0]}>" for t in reversed(tags))

    def link() -> str:
        return f"<a href='/x'>{words(1, 3)}</a>"

    def article() -> str:
        out = [f"<h{rng.choice('112')}>{mark}{sentence(1, 12)}</h1>"]
        for _ in range(rng.randint(1, 12)):
            body = mark + " ".join(sentence(1, 14) for _ in range(rng.choice([1, 1, 2, 5])))
            kind = rng.random()
            if kind < 0.7:
                out.append(f"<p>{rng.choice(['', '<b>', '<em>'])}{body}" + rng.choice(["</p>", "</p>", "<br>"]))
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{mark}{sentence(1, 9)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.88:
                out.append(f"<h2>{mark}{words(1, 5)}</h2>")
            elif kind < 0.92:
                out.append(f"<p>{body} <a href='/y'>{words(1, 3)}</a> {words(1, 6, '.')}</p>")
            elif kind < 0.95:
                out.append(f"<div>{body}</div>")
            elif kind < 0.98:
                listing = rng.choice(["pre", "xmp"])
                out.append(f"<noscript><p>{body}</p></noscript>" if rng.random() < 0.5 else f"<{listing}>{mark}{words(2, 12)}</{listing}>")
            else:
                out.append(f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 2)}</td></tr></table>")
            if rng.random() < 0.08:
                out.append(held(rng.choice(["advert", "notice", "form"]), other("advert")))
        return held("article", "".join(out))

    def other(kind: str) -> str:
        if kind == "menu":
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>" if rng.random() < 0.7 else " ".join(link() for _ in range(4))
        if kind == "form":
            return f"<label>{words(1, 3)}</label><input name='q'><button>{words(1, 2)}</button><p>{sentence(2, 8)}</p>"
        if kind == "footer":
            return f"<p>&copy; {words(1, 4)}.example &middot; {sentence(1, 9)}</p>" if rng.random() < 0.5 else f"&copy; {words(1, 3)} {sentence(1, 12)}"
        if kind == "comments":
            return f"<h3>{words(1, 3)}</h3>" + "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{sentence(3, 30)}</p></div>" for _ in range(rng.randint(1, 5)))
        if kind == "header":
            return f"<h1>{words(1, 3)}</h1><p>{words(2, 6)}</p>" if rng.random() < 0.5 else f"<div>{words(1, 4)}</div>"
        if kind == "sidebar":
            return f"<h3>{words(1, 3)}</h3><ul>" + "".join(f"<li>{link()}</li>" for _ in range(3)) + f"</ul><p>{sentence(4, 20)}</p>"
        return rng.choice([sentence(2, 14), f"<p>{sentence(3, 25)}</p>", f"<p>{words(1, 5)}</p>{link()}"])

    pages = []
    for _ in range(count):
        top = [k for k in ("header", "menu", "notice", "advert", "form", "sidebar") if rng.random() < 0.5]
        low = [k for k in ("sidebar", "advert", "comments", "form", "menu", "notice") if rng.random() < 0.4] + (["footer"] if rng.random() < 0.85 else [])
        rng.shuffle(top)
        body = "".join(held(k, other(k)) for k in top) + article() + "".join(held(k, other(k)) for k in low)
        page = f"<html><head><title>{words(2, 8)}</title></head><body>" + (f"<div class='page wrapper'>{body}</div>" if rng.random() < 0.3 else body) + "</body></html>"
        blocks = leaf_blocks(page)
        gold = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "") or "-"
        pages.append((blocks, gold))
    return pages


def trained_field(pages: list | None = None) -> Field:
    return Field().fit(labelled_pages() if pages is None else pages)


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html) if html else []
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text", field: Field | None = None) -> DataFrame:
    """Add ``into``: the article's blocks, one a line. A column of that name is replaced."""
    model = pages.sparkSession.sparkContext.broadcast(field or trained_field())   # some hundred weights

    def run(batches):
        for batch in batches:
            at_html = batch.schema.get_field_index(html)
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield _with(part, {into: pa.array([main_text(h, model.value) for h in part.column(at_html).to_pylist()], pa.string())})

    return pages.mapInArrow(run, _schema(pages, {into: StringType()}))
