"""HTML operators: a page is parsed once, in Arrow batches, for all the columns that are asked for."""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._rows import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)", re.I | re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "title", "textarea")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_FLAT = (*_HEADINGS, "p", "ul", "ol", "blockquote", "pre", "code", "a", "img")
#: What a cleaned page is without.
NOISE_TAGS = frozenset(("script", "style", "iframe", "noscript", "header", "footer", "nav"))
NOISE_CLASSES = frozenset(("advertisement", "ad", "banner", "sidebar", "menu", "comments", "related", "share", "social"))
NOISE_IDS = frozenset(("cookie-notice",))

DOCUMENT = (
    "struct<title:string,base_url:string,headings:array<struct<level:int,text:string>>,paragraphs:array<string>,links:array<struct<text:string,url:string>>,"
    "images:array<struct<alt:string,src:string>>,lists:array<struct<ordered:boolean,items:array<string>>>,code_blocks:array<struct<language:string,code:string>>,blockquotes:array<string>>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "start", "end", "inner", "inner_end")

    def __init__(self, tag: str, attrs: dict[str, str], start: int, inner: int):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.start, self.inner, self.inner_end, self.end = start, inner, inner, inner

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def pieces(self) -> Iterator[str]:
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.children)

    def text(self) -> str:
        """Trimmed, with runs of white space as one blank."""
        return " ".join("".join(self.pieces()).split())

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def parse(page: str, browser: bool = False) -> Node:
    """The tree of a page. With ``browser``, block elements close an open paragraph and list items each
    other; else elements nest as written."""
    root = Node("", {}, 0, 0)
    stack, at, n = [root], 0, len(page)
    opened: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are

    def close(to: int, start: int, end: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            if node.tag in opened:
                opened[node.tag].pop()
            node.inner_end, node.end = start, end if len(stack) == to else start

    while at < n and (m := _TOKEN.match(page, at)):
        at = m.end()
        if (text := m["text"]) is not None:
            stack[-1].children.append(entities.unescape(text) if "&" in text else text)
        elif (tag := m["tag"]) is not None:
            tag = tag.lower()
            if m["end"]:
                if opened.get(tag):
                    close(opened[tag][-1], m.start(), at)
                continue
            if browser:
                item = "li" if tag == "li" else "p" if tag in _ENDS_P else ""
                if opened.get(item):
                    k = opened[item][-1]
                    if item == "p" or not any(opened.get(x) and opened[x][-1] > k for x in ("ul", "ol")):
                        close(k, m.start(), m.start())
            attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m["attrs"])} if m["attrs"] else {}
            node = Node(tag, attrs, m.start(), at)
            stack[-1].children.append(node)
            if tag in _RAW:
                ends = _RAW[tag].search(page, at)
                node.inner_end, node.end = (ends.start(), ends.end()) if ends else (n, n)
                body = page[at : node.inner_end]
                node.children.append(entities.unescape(body) if tag in ("title", "textarea") else body)
                at = node.end
            elif tag not in _VOID and not m["attrs"].endswith("/"):
                opened.setdefault(tag, []).append(len(stack))
                stack.append(node)
    close(1, n, n)
    return root


def _first(root: Node, *tests: Callable[[Node], bool]) -> Node | None:
    for test in tests:
        if found := next((x for x in root.walk() if test(x)), None):
            return found
    return None


_MAIN = (lambda x: x.tag == "main", lambda x: x.tag == "article", lambda x: x.attrs.get("id") == "content", lambda x: "content" in x.classes(), lambda x: x.tag == "body")


def _title(root: Node) -> str:
    found = _first(root, lambda x: x.tag == "title")
    return found.text() if found else "No Title"


def _absolute(base: str, link: str) -> str:
    return link if not link or link.startswith(("http://", "https://")) else urljoin(base, link)


def _language(node: Node, plain: bool) -> str:
    names = node.classes()
    if plain:
        return next((c[9:] for c in names if c.startswith("language-")), "")
    return names[0].removeprefix("language-") if names else ""


def document(root: Node, base: str) -> dict:
    """A page's parts by kind: headings by level, then in order."""
    every = list(root.walk())
    texts: dict[int, str] = {}

    def loose(x: Node) -> str:
        if id(x) not in texts:
            texts[id(x)] = "".join(x.pieces()).strip()
        return texts[id(x)]

    some = lambda tag: [x for x in every if x.tag == tag]
    return {
        "title": next((loose(x) for x in some("title")), "No Title"), "base_url": base,
        "headings": [{"level": k + 1, "text": t} for k, h in enumerate(_HEADINGS) for x in some(h) if (t := loose(x))],
        "paragraphs": [t for x in some("p") if (t := loose(x))],
        "links": [{"text": t, "url": urljoin(base, x.attrs["href"])} for x in some("a") if "href" in x.attrs and (t := loose(x))],
        "images": [{"alt": x.attrs.get("alt", "image"), "src": urljoin(base, x.attrs["src"])} for x in some("img") if "src" in x.attrs],
        "lists": [{"ordered": tag == "ol", "items": items} for tag in ("ul", "ol") for x in some(tag) if (items := [t for li in x.walk() if li.tag == "li" and (t := loose(li))])],
        "code_blocks": [{"language": _language(x, True), "code": t} for x in every if x.tag in ("pre", "code") and (t := loose(x))],
        "blockquotes": [t for x in some("blockquote") if (t := loose(x))],
    }


def markdown(root: Node, url: str) -> str:
    """The main content in document order."""
    if not url and (base := _first(root, lambda x: x.tag == "base")):
        url = base.attrs.get("href", "")
    parts = [f"# {_title(root)}"]
    main = _first(root, *_MAIN)
    for x in main.walk() if main else ():
        if x.tag in _HEADINGS:
            parts.append("#" * int(x.tag[1]) + " " + x.text())
        elif x.tag == "p":
            parts.append(x.text())
        elif x.tag in ("ul", "ol"):
            items = [c.text() for c in x.children if isinstance(c, Node) and c.tag == "li"]
            parts.append("\n".join((f"{k}. " if x.tag == "ol" else "- ") + t for k, t in enumerate(items, 1)))
        elif x.tag == "blockquote":
            parts.append(f"> {x.text()}")
        elif x.tag == "pre":
            parts.append(f"```{_language(x, False)}\n{x.text()}\n```")
        elif x.tag == "img":
            parts.append(f"![{x.attrs.get('alt', 'image')}]({_absolute(url, x.attrs['src'])})" if x.attrs.get("src") else "")
    return "\n\n".join(p for p in parts if p).strip()


def _flat(root: Node, url: str) -> list[dict]:
    out = []
    for x in root.walk():
        if x.tag in _FLAT:
            row = {"type": x.tag, "content": x.text(), "href": None, "src": None, "alt": None, "items": None}
            if x.tag == "a" and x.attrs.get("href"):
                row["href"] = urljoin(url, x.attrs["href"])
            elif x.tag == "img" and x.attrs.get("src"):
                row |= {"src": urljoin(url, x.attrs["src"]), "alt": x.attrs.get("alt", "")}
            elif x.tag in ("ul", "ol"):
                row["items"] = [c.text() for c in x.children if isinstance(c, Node) and c.tag == "li"]
            out.append(row)
    return out


def kinds(root: Node) -> list[str]:
    """The types of the blocks, without their texts, which repeat for each level of nesting."""
    return [x.tag for x in root.walk() if x.tag in _FLAT]


def flat_json(root: Node, url: str) -> str:
    rows = [{k: v for k, v in r.items() if v is not None and k != "items"} for r in _flat(root, url)]
    return json.dumps({"url": url, "title": _title(root), "content": rows}, indent=2, ensure_ascii=False)


def _xml(text: str) -> str:
    return entities.escape(text, quote=False).replace('"', "&quot;").replace("'", "&apos;")


def flat_xml(root: Node, url: str) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<document>", f"  <url>{_xml(url)}</url>", f"  <title>{_xml(_title(root))}</title>", "  <content>"]
    for r in _flat(root, url):
        kind, body = r["type"], _xml(r["content"])
        if kind in _HEADINGS:
            out.append(f'    <heading level="{kind[1]}">{body}</heading>')
        elif kind == "a":
            out += [f'    <link href="{_xml(r["href"])}">{body}</link>'] if r["href"] else []
        elif kind == "img":
            out += [f'    <image src="{_xml(r["src"])}" alt="{_xml(r["alt"])}" />'] if r["src"] else []
        elif kind in ("ul", "ol"):
            out += [f'    <list type="{"ordered" if kind == "ol" else "unordered"}">', *(f"      <item>{_xml(i)}</item>" for i in r["items"]), "    </list>"]
        else:
            name = {"p": "paragraph", "blockquote": "blockquote"}.get(kind, "code")
            out.append(f"    <{name}>{body}</{name}>")
    return "\n".join([*out, "  </content>", "</document>"])


def links(root: Node, base: str) -> list[str]:
    """Different link targets in order, without scripts' and the page's own anchors."""
    found = (x.attrs["href"] for x in root.walk() if x.tag == "a" and "href" in x.attrs)
    return sorted({_absolute(base, h) for h in found if not h.startswith(("javascript:", "#"))})


def main_html(root: Node, page: str) -> str:
    found = _first(root, *_MAIN)
    return page[found.start : found.end] if found else page


def clean_html(root: Node, page: str) -> str:
    kept, at = [], 0
    for x in root.walk():
        if x.start >= at and (x.tag in NOISE_TAGS or NOISE_CLASSES.intersection(x.classes()) or x.attrs.get("id") in NOISE_IDS):
            kept.append(page[at : x.start])
            at = x.end
    return "".join([*kept, page[at:]])


def metadata(root: Node, url: str) -> dict:
    named = {k: x.attrs["content"] for x in reversed([x for x in root.walk() if x.tag == "meta" and x.attrs.get("content")]) for k in (x.attrs.get("name"), x.attrs.get("property")) if k}
    title = _first(root, lambda x: x.tag == "title")
    return {"title": title.text() if title else "", "description": named.get("description", ""), "keywords": named.get("keywords", ""), "og_title": named.get("og:title", ""), "og_image": named.get("og:image", ""), "url": url}


#: Columns that ``convert`` can add: type, whether the tree is the browser's, function of tree, page and URL.
OUTPUTS: dict[str, tuple[str, bool, Callable]] = {
    "document": (DOCUMENT, True, lambda r, p, u: document(r, u)),
    "markdown": ("string", False, lambda r, p, u: markdown(r, u)),
    "json": ("string", False, lambda r, p, u: flat_json(r, u)),
    "xml": ("string", False, lambda r, p, u: flat_xml(r, u)),
    "blocks": ("array<struct<type:string,content:string,href:string,src:string,alt:string,items:array<string>>>", False, lambda r, p, u: _flat(r, u)),
    "kinds": ("array<string>", False, lambda r, p, u: kinds(r)),
    "links": ("array<string>", True, lambda r, p, u: links(r, u)),
    "main_html": ("string", True, lambda r, p, u: main_html(r, p)),
    "clean_html": ("string", True, lambda r, p, u: clean_html(r, p)),
    "text": ("string", False, lambda r, p, u: r.text()),
    "metadata": ("struct<title:string,description:string,keywords:string,og_title:string,og_image:string,url:string>", False, lambda r, p, u: metadata(r, u)),
}


def convert(pages: DataFrame, *wanted: str, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and those wanted, of OUTPUTS, for every page; a null page is an empty one.
    What is made from a page takes many times its size, so a task makes and gives back ``BYTES`` of pages at
    a time, not a whole batch."""
    if unknown := [w for w in wanted if w not in OUTPUTS]:
        raise ValueError(f"unknown outputs: {unknown}")
    rows = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    schema = StructType.fromDDL(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), *(f"`{w}` {OUTPUTS[w][0]}" for w in wanted)]))
    target = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "_html")):
            found: dict[str, list] = {w: [] for w in wanted}
            for page, base in zip(part.column("_html").to_pylist(), part.column("_url").to_pylist()):
                trees: dict[bool, Node] = {}
                for w in wanted:
                    _, browser, make = OUTPUTS[w]
                    if browser not in trees:
                        trees[browser] = parse(page, browser)
                    found[w].append(make(trees[browser], page, base))
            arrays = [part.column(k) for k in keep] + [pa.array(found[w], target.field(w).type) for w in wanted]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *wanted])

    return rows.mapInArrow(work, schema)


def render(doc: Column) -> Column:
    """A document as markdown, kind after kind."""
    part = lambda name, row: F.transform(doc[name], row)
    bullets = lambda x: F.transform(x["items"], lambda t, i: F.concat(F.when(x["ordered"], F.concat((i + 1).cast("string"), F.lit(". "))).otherwise(F.lit("- ")), t))
    pieces = F.flatten(
        F.array(
            F.array(F.concat(F.lit("# "), doc["title"])),
            part("headings", lambda x: F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["text"])),
            doc["paragraphs"],
            part("links", lambda x: F.concat(F.lit("["), x["text"], F.lit("]("), x["url"], F.lit(")"))),
            part("images", lambda x: F.concat(F.lit("!["), x["alt"], F.lit("]("), x["src"], F.lit(")"))),
            part("lists", lambda x: F.array_join(bullets(x), "\n")),
            part("code_blocks", lambda x: F.concat(F.lit("```"), x["language"], F.lit("\n"), x["code"], F.lit("\n```"))),
            part("blockquotes", lambda x: F.concat(F.lit("> "), F.array_join(F.split(x, "\n"), "\n> "))),
        )
    )
    text = F.array_join(pieces, "\n\n")
    return F.trim(F.replace(F.replace(text, F.lit("\n\n\n\n"), F.lit("\n\n")), F.lit("\n\n\n"), F.lit("\n\n")))


def document_xml(doc: Column) -> Column:
    """A document as XML; sections that have nothing are left out."""
    from ..functions.text import escape_xml as e

    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    group = lambda name, rows: F.when(F.size(rows) > 0, tag(name, F.array_join(rows, ""))).otherwise(F.lit(""))
    each = lambda name, row: F.transform(doc[name], row)
    return tag(
        "document",
        F.concat(
            tag("title", e(doc["title"])), tag("base_url", e(doc["base_url"])),
            group("headings", each("headings", lambda x: F.concat(F.lit('<heading level="'), x["level"].cast("string"), F.lit('">'), e(x["text"]), F.lit("</heading>")))),
            group("paragraphs", each("paragraphs", lambda x: tag("paragraph", e(x)))),
            group("links", each("links", lambda x: F.concat(F.lit('<link href="'), e(x["url"]), F.lit('">'), e(x["text"]), F.lit("</link>")))),
            group("images", each("images", lambda x: F.concat(F.lit('<image src="'), e(x["src"]), F.lit('" alt="'), e(x["alt"]), F.lit('"/>')))),
            group("lists", each("lists", lambda x: tag("list", F.array_join(F.transform(x["items"], lambda t: tag("item", e(t))), "")))),
            group("code_blocks", each("code_blocks", lambda x: tag("code_block", e(x["code"])))),
            group("blockquotes", each("blockquotes", lambda x: tag("blockquote", e(x)))),
        ),
    )


def parse_markdown(text: str, base: str) -> dict:
    """A document from markdown, line by line. The line that ends a list is part of nothing."""
    lines = text.split("\n")
    title = next((x[2:].strip() for x in lines if x.startswith("# ")), "No Title")
    doc: dict = {"title": title, "base_url": base} | {k: [] for k in ("headings", "paragraphs", "links", "images", "lists", "code_blocks", "blockquotes")}
    code: list[str] | None = None
    language, items = "", None
    for line in lines:
        bare = line.strip()
        number = re.match(r"\d(?:.?.?)\. ", bare)
        if bare == f"# {title}":
            continue
        if line.startswith("#") and code is None:
            level = len(line) - len(line.lstrip("#"))
            if level <= 6 and line[level : level + 1] == " ":
                doc["headings"].append({"level": level, "text": line[level + 1 :].strip()})
        elif line.startswith("```"):
            if code is None:
                code, language = [], bare[3:].strip()
            else:
                doc["code_blocks"].append({"language": language, "code": "\n".join(code)})
                code = None
        elif code is not None:
            code.append(line)
        elif bare.startswith(("- ", "* ")) or number:
            items = [] if items is None else items
            items.append(bare[2:] if not number else bare[bare.find(". ") + 2 :])
        elif items is not None:
            doc["lists"].append({"ordered": False, "items": items})
            items = None
        elif line.startswith(">"):
            doc["blockquotes"].append(line[1:].strip())
        elif bare:
            doc["links"] += [{"text": m[1], "url": m[2]} for m in re.finditer(r"\[([^]]+)]\(([^)]+)\)", line)]
            doc["images"] += [{"alt": m[1], "src": m[2]} for m in re.finditer(r"!\[([^]]*)]\(([^)]+)\)", line)]
            doc["paragraphs"].append(bare)
    if items:
        doc["lists"].append({"ordered": False, "items": items})
    return doc


def markdown_document(rows: DataFrame, text: str = "markdown", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``document``, read from markdown."""
    held = rows.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    schema = StructType.fromDDL(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*keep).schema), f"document {DOCUMENT}"]))
    kind = to_arrow_schema(schema).field("document").type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "_text")):
            docs = [parse_markdown(t, u) for t, u in zip(part.column("_text").to_pylist(), part.column("_url").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(docs, kind)], names=[*keep, "document"])

    return held.mapInArrow(work, schema)


def convert_to(pages: DataFrame, kind: str, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """``content`` in an output format (an unknown one is markdown) and always ``markdown`` too."""
    name = kind.lower() if kind.lower() in ("json", "xml") else "markdown"
    wanted = ("markdown",) if name == "markdown" else (name, "markdown")
    return convert(pages, *wanted, html=html, url=url, keep=keep).select(*keep, F.col(name).alias("content"), "markdown")
