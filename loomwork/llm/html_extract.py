"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in document order. Each block
becomes a vector: the mean of learnt vectors of its tag path (tags, classes, ids and roles, hashed; of
the innermost ``PATH`` elements also which is within which), the mean of learnt vectors of its hashed words, and a few
statistics. A bidirectional LSTM in numpy reads a whole page's blocks, so that every block is
classified with the context of the document, and the blocks it calls content make the page's text.

The network is trained in numpy on labelled pages that ``labelled_pages`` makes from a seed: layouts
of navigation, banners, sidebars, comments, advertisements and footers around articles, with and
without telling tags and class names. Labelled pages of one's own can be passed to ``train`` instead.

Scale: one map over the pages, no shuffle; the network is 100 kilobytes in the tasks' closure. Pages
of like length are read together; a page's length is not bounded.

Defined cases: a null or empty page has no blocks and the empty text; a null id passes through;
repeated rows give repeated results, whatever stands beside them; a block whose score ties with the
threshold is content; a very long page is read whole, in a group of its own length; an empty table gives
none; broken nesting closes as browsers close it. What scripts, styles, templates, text areas, frames and
``noscript`` hold is no text of the page. Columns beside the id and the page are never read.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import table
from ._words import Words, slices

PATH, PATHS, WORDS, DIMS, HIDDEN, STATS = 12, 512, 1024, 12, 24, 8
#: Generated pages that the built-in network is trained on.
PAGES, SEED = 500, 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|iframe|template)\b[^>]*+>(?P<inner>.*?)(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.I | re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: A start tag of the first kind ends an open element of the second, up to the nearest of the third.
_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "option": ("option", ("select",))}


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return (tag,)
    found = [tag]
    for m in _NAMED.finditer(attrs):
        kind = m[1][0].lower()
        found += [f"{kind}.{part.lower()}" for part in _PART.findall(m[2] or m[3] or m[4] or "")]
    return tuple(found)


def parse(page: str) -> tuple[str | None, list[tuple[tuple[tuple[str, ...], ...], str, int]]]:
    """Title, and for every leaf block its path (names of the innermost elements), its text with white
    space collapsed, and how many of its characters are links'."""
    title: str | None = None
    blocks: list[tuple[tuple[tuple[str, ...], ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter[str] = Counter()
    around: Counter[str] = Counter()  # names of all open elements
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                path = tuple(names for tag, names in stack[-PATH:] if tag not in _INLINE)
                if len(stack) > PATH:
                    path = (("*", *sorted(around)), *path)
                blocks.append((path, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        while stack:
            last, names = stack.pop()
            opened[last] -= 1
            if last not in _INLINE:
                for name in names:
                    around[name] -= 1
                    if not around[name]:
                        del around[name]
            if last == tag:
                return

    for m in _TOKEN.finditer(page):
        text, tag = m["text"], m["tag"]
        if text is not None:
            pieces.append(text)
            if opened["a"]:
                linked += len(text)
        elif tag is not None:
            tag = tag.lower()
            inline = tag in _INLINE
            if not inline:
                flush()
            if m["end"]:
                if opened[tag] > 0:
                    if inline and next((t for t, _ in reversed(stack) if t not in _INLINE or t == tag), tag) != tag:
                        continue  # an inline element that a block has cut stays open
                    close(tag)
            elif tag in _VOID:
                if tag == "br":
                    pieces.append("\n")
            else:
                if not inline and opened["p"] > 0:
                    close("p")
                if tag in _ENDS:
                    ends, within = _ENDS[tag]
                    if opened[ends] > 0 and next((t for t, _ in reversed(stack) if t == ends or t in within), "") == ends:
                        close(ends)
                elif tag == "a" and opened["a"] > 0:
                    close("a")
                if not m["attrs"].endswith("/"):
                    stack.append((tag, _names(tag, m["attrs"])))
                    opened[tag] += 1
                    if not inline:
                        around.update(stack[-1][1])
        elif m["raw"] is not None and m["raw"].lower() == "title" and title is None:
            title = " ".join(html.unescape(m["inner"]).split())
    flush()
    return title, blocks


@functools.lru_cache(maxsize=100_000)
def _path_ids(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Rows of the path table: every name, the innermost element's, and pairs of parent and child."""
    names = [n for element in path for n in element]
    if path:
        names += [f"={n}" for n in path[-1]] + [f"{a[0]}>{b[0]}" for a, b in zip(path, path[1:])]
    return np.array(sorted({zlib.crc32(n.encode()) % PATHS for n in names or ["none"]}), np.int64)


class Blocks:
    """Features of the blocks of some pages: ``first[p]:first[p + 1]`` are those of page p."""

    def __init__(self, pages: list[list[tuple]]):
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
        flat = [b for p in pages for b in p]
        self.paths = [b[0] for b in flat]
        self.texts = [b[1] for b in flat]
        ids = [_path_ids(p) for p in self.paths]
        self.path_count = np.array([len(x) for x in ids], np.int64)
        self.path_ids = np.concatenate([np.zeros(0, np.int64), *ids])
        words = Words(pa.array(self.texts, pa.large_string()))
        self.word_count = np.diff(words.first)
        self.word_ids = (words.hash % np.uint64(WORDS)).astype(np.int64)
        size = np.maximum(np.diff(words.off), 1)
        share = lambda chars: np.diff(np.concatenate([[0], np.cumsum(np.isin(words.raw, np.frombuffer(chars, np.uint8)))])[words.off]) / size
        length = np.array([len(t) for t in self.texts], np.float64)
        place = np.arange(len(flat)) - np.repeat(self.first[:-1], np.diff(self.first))
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(flat))
        self.stats = np.stack(
            [np.log1p(length) / 6, np.log1p(self.word_count) / 4, np.array([b[2] for b in flat], np.float64) / np.maximum(length, 1), 10 * share(b".,;:!?"), 5 * share(b"0123456789"), 5 * share(b"|/&@#"), 1 / (1 + place), 1 / left], 1
        ).astype(np.float32).reshape(len(flat), STATS)


def _bag(rows: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Means of a table's rows over consecutive groups of ids."""
    total = np.zeros((len(count), rows.shape[1]), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        total[some] = np.add.reduceat(rows[ids], at[some], axis=0) / count[some][:, None]
    return total


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """The network: two tables of vectors, an LSTM for each direction, and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = 2 * DIMS + STATS
        normal = lambda *shape, fan: rng.normal(0, fan**-0.5, shape).astype(np.float32)
        self.weights = {"paths": normal(PATHS, DIMS, fan=DIMS), "words": normal(WORDS, DIMS, fan=DIMS), "out": normal(2 * HIDDEN + size, 1, fan=2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for way in ("on", "back"):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.weights |= {f"{way}_x": normal(size, 4 * HIDDEN, fan=size), f"{way}_h": normal(HIDDEN, 4 * HIDDEN, fan=HIDDEN), f"{way}_b": bias}

    def _inputs(self, b: Blocks) -> np.ndarray:
        w = self.weights
        return np.concatenate([_bag(w["paths"], b.path_ids, b.path_count), _bag(w["words"], b.word_ids, b.word_count), b.stats], 1)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states over time steps; a padded step leaves the state as it is."""
        w, (steps, n, _) = self.weights, x.shape
        fed = x @ w[f"{way}_x"] + w[f"{way}_b"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = fed[t] + h @ w[f"{way}_h"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[t][:, None]
            if keep:
                kept.append((i, f, o, g, c, h, tanh))
            c, h = np.where(m, new, c), np.where(m, o * tanh, h)
            out[t] = h
        return out, kept

    @staticmethod
    def _padded(first: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers by time step and page, and which of them there are."""
        sizes = first[pages + 1] - first[pages]
        t = np.arange(sizes.max(initial=0))[:, None]
        mask = t < sizes
        return np.where(mask, first[pages] + t, 0), mask

    def scores(self, b: Blocks) -> np.ndarray:
        """The probability of every block to be content."""
        out = np.zeros(len(b.texts))
        if not len(out):
            return out
        x, w = self._inputs(b), self.weights
        sizes = np.diff(b.first)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < 256 and sizes[order[to]] <= 1.25 * sizes[order[at]] + 8:
                to += 1
            cells, mask = self._padded(b.first, order[at:to])
            fed = x[cells]
            on, _ = self._run("on", fed, mask, False)
            back, _ = self._run("back", fed[::-1], mask[::-1], False)
            z = np.concatenate([on, back[::-1], fed], 2) @ w["out"] + w["out_b"]
            out[cells[mask]] = _sigmoid(z[..., 0][mask])
            at = to
        return out

    def gradients(self, b: Blocks, pages: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over the blocks of some pages."""
        w, x = self.weights, self._inputs(b)
        cells, mask = self._padded(b.first, pages)
        fed = x[cells]
        on, kept_on = self._run("on", fed, mask, True)
        back, kept_back = self._run("back", fed[::-1], mask[::-1], True)
        top = np.concatenate([on, back[::-1], fed], 2)
        dz = ((_sigmoid(top @ w["out"] + w["out_b"])[..., 0] - truth[cells]) * mask / max(1, mask.sum())).astype(np.float32)[..., None]
        g = {"out": np.tensordot(top, dz, ([0, 1], [0, 1])), "out_b": dz.sum((0, 1))}
        dtop = dz @ w["out"].T
        dfed = dtop[..., 2 * HIDDEN :].copy()
        for way, kept, inputs, m, dout in (("on", kept_on, fed, mask, dtop[..., :HIDDEN]), ("back", kept_back, fed[::-1], mask[::-1], dtop[::-1, :, HIDDEN : 2 * HIDDEN])):
            dpre = np.zeros((*m.shape, 4 * HIDDEN), np.float32)
            before = np.stack([k[5] for k in kept])
            dh = dc = np.zeros((m.shape[1], HIDDEN), np.float32)
            for t in range(len(kept) - 1, -1, -1):
                i, f, o, cand, c, _, tanh = kept[t]
                there = m[t][:, None]
                dh = dh + dout[t]
                dn, dcn = dh * there, dc * there
                dcn = dcn + dn * o * (1 - tanh**2)
                dpre[t] = np.concatenate([dcn * cand * i * (1 - i), dcn * c * f * (1 - f), dn * tanh * o * (1 - o), dcn * i * (1 - cand**2)], 1)
                dh = np.where(there, dpre[t] @ w[f"{way}_h"].T, dh)
                dc = np.where(there, dcn * f, dc)
            g |= {f"{way}_x": np.tensordot(inputs, dpre, ([0, 1], [0, 1])), f"{way}_h": np.tensordot(before, dpre, ([0, 1], [0, 1])), f"{way}_b": dpre.sum((0, 1))}
            dx = dpre @ w[f"{way}_x"].T
            dfed += dx if way == "on" else dx[::-1]
        dinput = np.zeros_like(x)
        dinput[cells[mask]] = dfed[mask]
        for name, ids, count, cols in (("paths", b.path_ids, b.path_count, slice(0, DIMS)), ("words", b.word_ids, b.word_count, slice(DIMS, 2 * DIMS))):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], ids, np.repeat(dinput[:, cols] / np.maximum(count, 1)[:, None], count, axis=0))
        return g


def train(pages: list[tuple[str, list[bool]]], epochs: int = 5, seed: int = SEED) -> Labeller:
    """Fits the network to pages and, for each, which of its blocks (as ``parse`` gives them) are content."""
    net, rng = Labeller(seed), np.random.default_rng(seed)
    parsed = [parse(page)[1] for page, _ in pages]
    mean, square = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(pages))
        for part in np.array_split(order, max(1, len(order) // 16)):
            step += 1
            chosen = Blocks([parsed[p] for p in part])
            truth = np.array([y for p in part for y in pages[p][1]], np.float32)
            if not len(truth):
                continue
            for k, g in net.gradients(chosen, np.arange(len(part)), truth).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - np.float32(8e-3) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + np.float32(1e-7))
    return net


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages made from a seed, with the truth about each of their blocks."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    many = lambda a, b: range(int(rng.integers(a, b + 1)))
    syllables = "ka lo mi tre en ou sha dor ve ris tan el qua bi ñe ü é ção st er th an".split()
    made = lambda: "".join(pick(syllables) for _ in many(1, 4))
    lexicon = [made() for _ in range(400)]
    words = lambda a, b: " ".join(pick(lexicon) for _ in many(a, b))
    sentence = lambda: words(4, 18).capitalize() + pick([".", ".", ".", "?", "!"])
    prose = lambda a, b: " ".join(sentence() for _ in many(a, b))
    stock = "Home|About us|Contact|Log in|Sign up|Subscribe|Privacy policy|Terms of use|Share|Tweet|Read more|Next|Previous|Cookies|Accept|Search|Archive|Menu|Follow us".split("|")
    short = lambda: pick(stock) if rng.random() < 0.4 else words(1, 4)
    link = lambda text: f'<a href="/{pick(lexicon)}">{text}</a>'

    def wrap(body: str, tag: str, names: list[str]) -> str:
        named = f' {pick(["class", "class", "id"])}="{pick(names)}"' if rng.random() < 0.75 else ""
        return f"<{tag}{named}>{body}</{tag}>"

    def links(a: int, b: int) -> tuple[str, int]:
        items = [link(short()) for _ in many(a, b)]
        form = int(rng.integers(3))
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", len(items)
        if form == 1:
            return pick([" | ", " ", " &gt; "]).join(items), 1
        return "".join(f"<div>{x}</div>" for x in items), len(items)

    def boilerplate(kind: str) -> tuple[str, int]:
        if kind == "nav":
            body, k = links(3, 9)
            return wrap(body, pick(["nav", "div", "nav"]), ["nav", "menu", "navbar", "main-menu", "top-links"]), k
        if kind == "head":
            body, k = links(2, 5)
            return wrap(f"<div>{words(1, 4)}</div>" + body, pick(["header", "div"]), ["header", "masthead", "site-header", "banner"]), k + 1
        if kind == "ad":
            return wrap(prose(1, 2) if rng.random() < 0.7 else link(words(3, 9)), pick(["div", "div", "aside"]), ["ad", "ads", "advertisement", "sponsored", "promo"]), 1
        if kind == "side":
            body, k = links(3, 8)
            return wrap(f"<h3>{words(1, 3)}</h3>" + body, pick(["aside", "div"]), ["sidebar", "related", "widget", "recommended", "tags"]), k + 1
        if kind == "cookie":
            return wrap(f"<p>{pick(['We use cookies', 'This site uses cookies', 'Accept cookies'])} {words(3, 12)}.</p>", "div", ["cookie-notice", "consent", "popup", "overlay"]), 1
        if kind == "comments":
            k = len(many(1, 5))
            return wrap("".join(f"<div><span>{words(1, 2)}</span><p>{prose(1, 2)}</p></div>" for _ in range(k)), pick(["div", "section"]), ["comments", "comment-list", "replies"]), 2 * k
        if kind == "share":
            return wrap(" ".join(link(pick(["Share", "Tweet", "Print", "E-mail"])) for _ in many(2, 4)), "div", ["share", "social", "buttons"]), 1
        body, k = links(1, 5) if rng.random() < 0.5 else ("", 0)
        note = f"{pick(['&copy;', 'Copyright', 'All rights reserved', '(c)'])} {pick(lexicon)}.example.com {pick(['&middot;', '|', '-'])} {prose(1, 2) if rng.random() < 0.5 else words(2, 8)}"
        return wrap(f"<p>{note}</p>" + body, pick(["footer", "div"]), ["footer", "site-footer", "bottom", "legal"]), k + 1

    def content() -> tuple[str, int]:
        parts, k = [], 0
        title = words(3, 12).capitalize()
        if rng.random() < 0.85:
            parts.append(f"<h1>{title}</h1>")
            k += 1
        for _ in many(1, 9):
            form = rng.random()
            if form < 0.66:
                opening = pick(["<p>", "<p>", "<p><b>", "<p><i>", "<div>"])
                body = prose(1, 7) if rng.random() < 0.9 else words(2, 14)
                if rng.random() < 0.2:
                    body += " " + link(words(1, 3)) + " " + sentence()
                parts.append(f"{opening}{body}" + ("</div>" if opening == "<div>" else pick(["</p>", "</p>", "<br>", ""]) if opening == "<p>" else pick(["</b></p>", "<br>"]) if opening == "<p><b>" else "</i></p>"))
                k += 1
            elif form < 0.78:
                parts.append(f"<h2>{words(2, 6)}</h2>")
                k += 1
            elif form < 0.88:
                items = [f"<li>{sentence() if rng.random() < 0.6 else words(2, 9)}</li>" for _ in many(2, 6)]
                parts.append(f"<{(t := pick(['ul', 'ol']))}>" + "".join(items) + f"</{t}>")
                k += len(items)
            elif form < 0.92:
                cells = [f"<td>{words(1, 4)}</td>" for _ in many(2, 4)]
                parts.append("<table><tr>" + "".join(cells) + "</tr></table>")
                k += len(cells)
            elif form < 0.96:
                parts.append(f"<blockquote>{prose(1, 3)}</blockquote>")
                k += 1
            else:
                parts.append(f"<pre><code>{words(3, 20)}</code></pre>")
                k += 1
        return wrap("\n".join(parts), pick(["article", "article", "main", "div", "div", "section"]), ["content", "post", "entry", "article-body", "story", "text", "main"]), k

    out = []
    for _ in range(n):
        before = [x for x in ("cookie", "head", "nav", "ad", "nav", "side") if rng.random() < 0.45]
        after = [x for x in ("share", "ad", "side", "comments", "ad", "nav") if rng.random() < 0.3] + ["foot"] * (rng.random() < 0.8)
        body, truth = [], []
        for kind in before:
            text, k = boilerplate(kind)
            body.append(text)
            truth += [False] * k
        text, k = content()
        body.append(text)
        truth += [True] * k
        for kind in after:
            text, k = boilerplate(kind)
            body.append(text)
            truth += [False] * k
        whole = "\n".join(body)
        if rng.random() < 0.3:
            whole = wrap(whole, "div", ["page", "wrapper", "container"])
        page = f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{whole}</body></html>"
        if len(parse(page)[1]) == len(truth):  # a block that broken nesting has merged has no one truth
            out.append((page, truth))
    return out


@functools.cache
def trained(n: int = PAGES, seed: int = SEED) -> Labeller:
    """The built-in network; trained once in a process."""
    return train(labelled_pages(n, seed), seed=seed)


def _labelled(batches: Iterator[pa.RecordBatch], net: Labeller) -> Iterator[tuple[pa.RecordBatch, list[str | None], Blocks, np.ndarray]]:
    for batch in batches:
        for part in slices(batch, "html", limit=2 << 20, rows=2048):
            parsed = [parse(x or "") for x in part.column("html").to_pylist()]
            found = Blocks([p[1] for p in parsed])
            yield part, [p[0] for p in parsed], found, net.scores(found)


def _pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").alias("html"))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", net: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, block, path, score, content, text`` of every leaf block, in the page's order."""
    net = net or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found, score in _labelled(batches, net):
            of = np.repeat(np.arange(part.num_rows), np.diff(found.first))
            place = (np.arange(len(of)) - found.first[of]).astype(np.int32)
            path = [" > ".join(x[0] for x in p) for p in found.paths]
            yield pa.RecordBatch.from_arrays([part.column("page_id").take(pa.array(of)), pa.array(place), pa.array(path, pa.string()), pa.array(score), pa.array(score >= threshold), pa.array(found.texts, pa.string())], ["page_id", "block", "path", "score", "content", "text"])

    return _pages(pages, id_col, html_col).mapInArrow(work, "page_id long, block int, path string, score double, content boolean, text string")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", net: Labeller | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, title, n_blocks, n_content, text``: one row a page; the text is its content blocks
    with a blank line between them, the title that of the page's head (null if it has none)."""
    net = net or trained()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, titles, found, score in _labelled(batches, net):
            yes, text, count = score >= threshold, [], []
            for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
                chosen = [found.texts[a + int(k)] for k in np.flatnonzero(yes[a:b])]
                text.append("\n\n".join(chosen))
                count.append(len(chosen))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(titles, pa.string()), pa.array(np.diff(found.first).astype(np.int32)), pa.array(count, pa.int32()), pa.array(text, pa.string())], ["page_id", "title", "n_blocks", "n_content", "text"])

    return _pages(pages, id_col, html_col).mapInArrow(work, "page_id long, title string, n_blocks int, n_content int, text string")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and content of all pages."""
    return extract(table(spark, sf_dir, "pages"))
