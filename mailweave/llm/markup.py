"""Clean text out of HTML, Markdown, wiki and LaTeX markup (problem 1).

Constructs are recognised first; only texts that hold some are parsed. Every such text becomes a tree, of its elements
(HTML) or of its blocks and links (other notations): paragraphs pass points for length and commas to their ancestors,
discounted by link density; the best container is kept with its siblings, and on the way up whatever isn't links, so
navigation and link farms fall away. Notations are rewritten to a uniform plain form: headings, lists, code blocks,
tables and formulas stay as `# heading`, `- item`, fenced code, `a | b` rows, `$formula$`.

The tree is built and walked with explicit stacks: depth costs nothing but memory, and work is linear in the text.
"""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from mailweave.functions.arrow import flat_map

# Element names; other words in angle brackets are text (addresses, comparisons).
ELEMENTS = (
    "a abbr b big blockquote body br center cite code dd del div dl dt em font h1 h2 h3 h4 h5 h6 head hr html i img ins kbd li link math meta nowiki o:p ol p pre q ref s samp script small source span "
    "strike strong style sub sup syntaxhighlight table tbody td tfoot th thead title tr tt u ul var"
).split()
BLOCKS = {"blockquote", "body", "center", "div", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "html", "li", "math", "ol", "p", "pre", "syntaxhighlight", "table", "tbody", "tr", "ul", "root", "td", "th"}
DROPPED = {"head", "link", "meta", "script", "style", "title"}
VOID = {"br", "hr", "img", "link", "meta", "source"}

_LEAD = r"^(?:[>|\s]|[A-Z]{1,3}>)*"
_TAG = rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?/?>|<!--|<!DOCTYPE"
#: construct -> (notation, substrings of which one must occur, pattern)
CONSTRUCTS: dict[str, tuple[str, tuple[str, ...], re.Pattern]] = {
    "tag": ("html", ("<",), re.compile(_TAG, re.I)),
    "entity": ("html", ("&",), re.compile(r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,6}|#[xX][0-9A-Fa-f]{2,5});")),
    "heading": ("markdown", ("# ",), re.compile(_LEAD + r"#{2,6} +\S|" + _LEAD + r"# +[A-Z]", re.M)),
    "fence": ("markdown", ("```", "~~~"), re.compile(_LEAD + r"(?:```|~~~)", re.M)),
    "bold": ("markdown", ("**",), re.compile(r"(?<![\w*])\*\*(?=[^\s*])[^*\n]*(?:\n[^*\n]+)?(?<=\S)\*\*(?![\w*])")),
    "bold_underscore": ("markdown", ("__",), re.compile(r"(?<![\w_])__(?=[^\s_])(?:[^_\n]|\n(?!\s*\n))+(?<=[^\s_])__(?![\w_])")),
    "italic": ("markdown", ("*",), re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+(?:\n[^*\n]+)?(?<=[^\s*])\*(?![\w*])")),
    "italic_underscore": ("markdown", ("_",), re.compile(r"(?<![\w_])_(?=[^\s_])[^_\n]+(?:\n[^_\n]+)?(?<=[^\s_])_(?![\w_])")),
    "strike": ("markdown", ("~~",), re.compile(r"~~(?=[^\s~])(?:[^~\n]|\n(?!\s*\n))+(?<=[^\s~])~~")),
    "link": ("markdown", ("](",), re.compile(r"!?\[[^\[\]]*\]\([^()\s]+(?:\s[^()]*)?\)")),
    "table_rule": ("markdown", ("---",), re.compile(_LEAD + r"\|?\s*:?-{3,}:?\s*\|[-:|\s]*$", re.M)),
    "table_row": ("markdown", ("|",), re.compile(r"^[>\s]*\|[^|\n]+\|[^\n]*\|\s*$", re.M)),
    "code": ("markdown", ("`",), re.compile(r"(?<!`)`[^`\n]+(?:\n[^`\n]+)?`(?!`)")),
    "wiki_heading": ("wiki", ("==",), re.compile(_LEAD + r"(={2,6})[^=\n]+\1\s*$", re.M)),
    "wiki_link": ("wiki", ("[[",), re.compile(r"\[\[[^\[\]]+\]\]")),
    "wiki_url": ("wiki", ("http",), re.compile(r"\[https?://[^\s\[\]]+ [^\[\]]+\]|\[[^\[\]|\n]+\|https?://[^\[\]]+\]")),
    "template": ("wiki", ("{{",), re.compile(r"\{\{[^{}]+\}\}")),
    "wiki_table": ("wiki", ("{|", "|}", "|-"), re.compile(r"\{\||" + _LEAD + r"\|[-}]\s*$", re.M)),
    "wiki_quotes": ("wiki", ("''",), re.compile(r"''+[^'\n]+(?:\n[^'\n]+)?''+")),
    "macro": ("wiki", ("{", "h", "bq", "||"), re.compile(r"\{(?:code|noformat|quote|panel|color|info|note)(?::[^}]*)?\}|" + _LEAD + r"(?:h[1-6]|bq)\. \S|" + _LEAD + r"\|\|[^|\n]+\|\|", re.M | re.I)),
    "command": ("latex", ("\\", "$$"), re.compile(r"\\(?:begin|end|section|subsection|subsubsection|paragraph|emph|textbf|textit|texttt|underline|href|url|footnote|cite|ref|label|title|author|frac|sqrt|documentclass|usepackage|text|SI|num|mathrm|caption)\*?\s*[\[{]|(?<![\w:\\./])\\[a-zA-Z]{3,}\b(?!\\)|\\item\b|\\\[|\\\(|\$\$|\\(?:frac|cdot|pi|Delta|leq|geq|times)\b|(?<!\\)\\\\[ \t]*$", re.M)),
    "formula": ("latex", ("$",), re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\\^_=][^$\n]*(?:\n[^$\n]+)?\$(?![\w$])")),
}


def constructs(text: str | None) -> list[str]:
    """The kinds of markup that text holds; none for NULL and empty texts."""
    if not text:
        return []
    return [k for k, (_, some, p) in CONSTRUCTS.items() if any(s in text for s in some) and p.search(text)]


class Node:
    """An element with its children (elements and strings), its score, and the sizes of its text: characters, commas, characters and number of links."""

    __slots__ = ("tag", "children", "parent", "score", "size", "commas", "linked", "links", "blocks")

    def __init__(self, tag: str, parent: Node | None = None) -> None:
        self.tag, self.parent, self.children, self.score = tag, parent, [], 0.0
        self.size = self.commas = self.linked = self.links = self.blocks = 0

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return "".join(out)

    @property
    def density(self) -> float:
        """The share of the text that is links."""
        return self.linked / self.size if self.size else 0.0

    @property
    def farm(self) -> bool:
        """Links and little else: navigation, lists of links."""
        return self.links >= FARM_LINKS and self.density > FARM_DENSITY


#: So many links that make up more than this share of a block's text are a link farm.
FARM_LINKS, FARM_DENSITY = 3, 0.5
_SCOPES = ("ul", "ol", "table", "tbody", "div", "body", "blockquote", "root")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.where: dict[str, list[int]] = {"root": [0]}  # tag -> its places among the open elements

    def _last(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else -1

    def _close(self, to: int) -> None:
        """Close all open elements from place `to` on."""
        while len(self.open) > max(to, 1):
            self.where[self.open.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _ELEMENT_SET:
            self.open[-1].children.append(self.get_starttag_text() or "")
            return
        if tag in ("p", "li", "tr", "td", "th"):  # an open one of the same scope ends here
            scope = max(self._last(t) for t in _SCOPES)
            ends = [at for t in ((tag, "td", "th") if tag == "tr" else (tag,)) if (at := self._last(t)) > scope]
            if ends:
                self._close(min(ends))
        node = Node(tag, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.where.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = self._last(tag)
        if at > 0:
            self._close(at)
        elif tag not in _ELEMENT_SET:
            self.open[-1].children.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


_ELEMENT_SET = set(ELEMENTS)


def parse(source: str) -> Node:
    """The tree of an HTML text; unclosed elements end with their parents, unknown ones stay text."""
    b = _Builder()
    b.feed(source)
    b.close()
    return b.root


_LINKS = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]+(?:\s[^()]*)?\)|\[\[(?:[^|\]]*\|)?([^\]]*)\]\]|\[https?://[^\s\[\]]+ ([^\[\]]+)\]|\[([^\[\]|\n]+)\|https?://[^\[\]]+\]|\\href\{[^}]*\}\{([^}]*)\}")


def block_tree(text: str) -> Node:
    """The tree of a text in another notation: a block per run of lines between blank ones (a code block is one), its links as elements."""
    root = Node("root")
    for n, part in enumerate(re.split(r"(```[^\n]*\n.*?```|\n[ \t]*\n\s*)", text, flags=re.S)):
        if n % 2:
            if part.startswith("```"):
                root.children.append(Node("pre", root))
                root.children[-1].children.append(part)
            else:
                root.children.append(part)
            continue
        if not part:
            continue
        block = Node("p", root)
        root.children.append(block)
        at = 0
        for m in _LINKS.finditer(part):
            block.children.append(part[at : m.start()])
            link = Node("a", block)
            link.children.append(m[0])
            block.children.append(link)
            at = m.end()
        block.children.append(part[at:])
    return root


def score(root: Node) -> list[Node]:
    """Sizes of all nodes and scores of containers, in two passes bottom-up; the containers.

    A paragraph gives 1 point, 1 a comma and up to 3 for its length; its parent gets all, the grandparent half.
    """
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        if x.tag not in DROPPED:
            todo.extend(c for c in x.children if not isinstance(c, str))
    seen: list[Node] = []
    for x in reversed(order):
        if x.tag in DROPPED:
            continue
        for c in x.children:
            if isinstance(c, str):
                x.size += len(" ".join(c.split()))
                x.commas += c.count(",")
            else:
                x.size, x.commas, x.linked, x.links = x.size + c.size, x.commas + c.commas, x.linked + c.linked, x.links + c.links
                x.blocks += c.blocks + (c.tag in BLOCKS)
        if x.tag == "a":
            x.linked, x.links = x.size, 1
    for x in order:
        if x.tag in ("p", "li", "td", "pre", "blockquote", "div") and not x.blocks and x.size >= 25:
            points = 1 + x.commas + min(x.size / 100, 3)
            for up, share in ((x.parent, 1.0), (x.parent.parent if x.parent else None, 0.5)):
                if up:
                    if not up.score:
                        seen.append(up)
                    up.score += points * share
    for x in seen:
        x.score *= 1 - x.density
    return seen


def kept_nodes(root: Node) -> list[Node | str]:
    """The best container with its siblings, and with what isn't a link farm beside it further up and in it, in document order.

    The root is taken for a container if no other stands out. A text that is a link farm as a whole is kept whole.
    """
    best = max(score(root), key=lambda x: x.score, default=root)
    if root.farm and best.score <= 0:
        return [root]
    path = {id(best)}
    up = best
    while up.parent:
        up = up.parent
        path.add(id(up))
    out: list[Node | str] = []
    todo: list[Node | str] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif id(x) in path and any(not isinstance(c, str) and (id(c) in path or c.farm) for c in x.children) and x.tag in ("root", "html", "body", "div", "center", "span"):
            todo.extend(reversed(x.children))  # its parts are judged one by one
        elif id(x) in path or not x.farm or (x.parent and 0 < best.score * 0.2 <= x.score):
            out.append(x)
    return out


def render(node: Node | str, out: list[str]) -> None:
    """Append node's plain text to out; line breaks are explicit."""
    todo: list[tuple[Node | str, bool, str]] = [(node, False, "")]
    while todo:
        x, after, mark = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        tag = x.tag
        if after:
            out.append("\n")
        elif tag in DROPPED:
            continue
        elif tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n")
        elif tag in ("pre", "syntaxhighlight"):
            out.append("\n```\n" + x.text().strip("\n") + "\n```\n")
        elif tag == "math":
            out.append(f"${x.text().strip()}$")
        elif tag[0] == "h" and tag[1:].isdigit():
            out.append("\n\n" + "#" * int(tag[1:]) + " " + " ".join(x.text().split()) + "\n\n")
        elif tag == "tr":
            cells = [" ".join(c.text().split()) for c in x.children if not isinstance(c, str) and c.tag in ("td", "th")]
            out.append("\n" + " | ".join(cells))
        else:
            block = tag in BLOCKS and tag != "li"
            if tag == "li":
                out.append("\n- " if mark != "ol" else "\n1. ")
            elif block:
                out.append("\n")
                todo.append((x, True, ""))
            todo.extend((c, False, "" if tag == "li" else tag) for c in reversed(x.children))


#: Marks of quoted lines, kept by the rules for lines; the second leaves bars to tables.
_QUOTE, _QUOTE_NO_BAR = r"^((?:[>| \t]|[A-Z]{1,3}>)*?)", r"^((?:[> \t]|[A-Z]{1,3}>)*)"
_REWRITE = [
    (re.compile(r"\\begin\{(?:verbatim|lstlisting)\}[^\n]*"), "```"), (re.compile(r"\\end\{(?:verbatim|lstlisting)\}"), "```"),
    (re.compile(r"\{(?:code|noformat)(?::[^}]*)?\}"), "\n```\n"), (re.compile(r"\{(?:quote|panel|color|info|note)(?::[^}]*)?\}", re.I), ""),
    (re.compile(r"\\\[\s*(.+?)\s*\\\]", re.S), r"$\1$"), (re.compile(r"\\\(\s*(.+?)\s*\\\)", re.S), r"$\1$"), (re.compile(r"\$\$\s*(.+?)\s*\$\$", re.S), r"$\1$"),
    (re.compile(r"\\begin\{equation\*?\}\s*(.+?)\s*\\end\{equation\*?\}", re.S), r"$\1$"),
    (re.compile(r"\\begin\{(?:itemize|enumerate|tabular|table|center|document)\}(?:\{[^}]*\})?[^\n]*\n?"), ""), (re.compile(r"\\end\{(?:itemize|enumerate|tabular|table|center|document)\}\n?"), ""),
    (re.compile(r"\\item\s*"), "- "), (re.compile(r"\\section\*?\{([^}]*)\}"), r"# \1"), (re.compile(r"\\subsection\*?\{([^}]*)\}"), r"## \1"), (re.compile(r"\\subsubsection\*?\{([^}]*)\}"), r"### \1"),
    (re.compile(r"\\href\{[^}]*\}\{([^}]*)\}"), r"\1"), (re.compile(r"\\(?:emph|textbf|textit|texttt|underline|url|text|num|footnote|title|caption|author|mathrm)\{([^{}]*)\}"), r"\1"), (re.compile(r"\\SI\{([^{}]*)\}\{([^{}]*)\}"), lambda m: f"{m[1]} {re.sub(r'[\\]([a-zA-Z]+)', r' \1', m[2]).strip()}"),
    (re.compile(r"\\(?:documentclass|usepackage)\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}[ \t]*\n?"), ""), (re.compile(r"~?\\(?:[a-zA-Z]*ref|cite[a-z]*|label)\*?\s*(?:\[[^\]]*\])*\{([^{}]*)\}"), lambda m: " " * (m[0][0] == "~") + m[1]),
    (re.compile(r"\\(?:sub)?paragraph\*?\{([^}]*)\}"), r"#### \1"), (re.compile(r"\\frac\{([^{}]*)\}\{([^{}]*)\}"), r"(\1)/(\2)"), (re.compile(r"\\sqrt\{([^{}]*)\}"), r"sqrt(\1)"),
    (re.compile(r"(?<![\w:\\./])\\(?:noindent|par|centering|newline|hline|maketitle|bigskip|smallskip|medskip|newpage)\b[ \t]*"), ""),
    (re.compile(r"^([^\n]*?) & ([^\n]*?)\s*\\\\[ \t]*$", re.M), lambda m: f"{m[1]} | {m[2].replace(' & ', ' | ')}"), (re.compile(r"\\\\[ \t]*$", re.M), ""),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?[ \t]*\n?"), ""), (re.compile(r"(?<![\w:\\./])\\[a-zA-Z]{3,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"), (re.compile(r"(?<![\w:\\./])\\([a-zA-Z]{3,})\b(?!\\)"), r"\1"),
    (re.compile(_QUOTE + r"(={2,6})[ \t]*([^=\n]+?)[ \t]*\2[ \t]*$", re.M), lambda m: m[1] + "#" * (len(m[2]) - 1) + " " + m[3]), (re.compile(_QUOTE + r"[hH]([1-6])\. (.+)$", re.M), lambda m: m[1] + "#" * int(m[2]) + " " + m[3]), (re.compile(_QUOTE + r"[bB][qQ]\. ", re.M), r"\1> "),
    (re.compile(r"^\{\|[^\n]*\n?|^\|\}\s*\n?|^\|-[^\n]*\n?", re.M), ""), (re.compile(_QUOTE + r"(?:\{\|[^\n]*|\|[-}][ \t]*)(?:\n|\Z)", re.M), ""), (re.compile(_QUOTE_NO_BAR + r"!\s*(.+)$", re.M), lambda m: m[1] + re.sub(r"\s*!!\s*", " | ", m[2])),
    (re.compile(_QUOTE + r"\|\|(.+?)\|\|[ \t]*$", re.M), lambda m: m[1] + " | ".join(x.strip() for x in m[2].split("||"))), (re.compile(_QUOTE_NO_BAR + r"\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*(?:\n|\Z)", re.M), ""), (re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$\n?", re.M), ""),
    (re.compile(r"^\|\s?(?=[^\n]*\|)([^\n]*?)\|?\s*$", re.M), lambda m: " | ".join(x.strip() for x in re.split(r"\|+", m[1]))), (re.compile(_QUOTE_NO_BAR + r"\|([^|\n]+\|[^\n]*)\|[ \t]*$", re.M), lambda m: m[1] + " | ".join(x.strip() for x in re.split(r"\|+", m[2]))),
    (re.compile(r"\[\[(?:File|Image|Datei):([^|\]]*)[^\]]*\]\]"), r"\1"), (re.compile(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]"), r"\1"), (re.compile(r"\[https?://[^\s\[\]]+ ([^\[\]]+)\]"), r"\1"), (re.compile(r"\[([^\[\]|\n]+)\|https?://[^\[\]]+\]"), r"\1"),
    (re.compile(r"!?\[([^\[\]]*)\]\([^()\s]+(?:\s[^()]*)?\)"), r"\1"), (re.compile(r"\{\{(?:[^|{}]*\|)?([^{}]*)\}\}"), r"\1"),
    (re.compile(r"''+([^'\n]+(?:\n[^'\n]+)?)''+"), r"\1"), (re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^*\n]*(?:\n[^*\n]+)?)(?<=\S)\*\*(?![\w*])"), r"\1"), (re.compile(r"(?<![\w_])__(?=[^\s_])((?:[^_\n]|\n(?!\s*\n))+)(?<=[^\s_])__(?![\w_])"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+(?:\n[^*\n]+)?)(?<=[^\s*])\*(?![\w*])"), r"\1"), (re.compile(r"(?<![\w_])_(?=[^\s_])([^_\n]+(?:\n[^_\n]+)?)(?<=[^\s_])_(?![\w_])"), r"\1"), (re.compile(r"~~(?=[^\s~])((?:[^~\n]|\n(?!\s*\n))+)(?<=[^\s~])~~"), r"\1"), (re.compile(r"(?<!`)`([^`\n]+(?:\n[^`\n]+)?)`(?!`)"), r"\1"), (re.compile(r"^\* (?=\S)", re.M), "- "),
]

#: The rule of _REWRITE from which on all formulas stand between dollar signs.
FORMULAS = 8


def clean(text: str | None) -> tuple[str | None, list[str]]:
    """(clean text, constructs found). Text without markup, NULL and empty text come back unchanged."""
    kinds = constructs(text)
    if not kinds:
        return text, kinds
    out = text.replace("\r\n", "\n").replace("\x00", "")
    if "entity" in kinds and re.search(r"&lt;/?(?:" + "|".join(ELEMENTS) + r")\b", out, re.I):
        out = html.unescape(out)  # escaped markup: one level of escaping off, then as usual
        kinds = kinds if "tag" in kinds else kinds + ["tag"]
    if "tag" in kinds:
        parts: list[str] = []
        for node in kept_nodes(parse(out)):
            render(node, parts)
        out = "".join(parts)
    elif "entity" in kinds:
        out = html.unescape(out)
    notations = {CONSTRUCTS[k][0] for k in kinds}
    if "link" in kinds or "wiki_link" in kinds or "wiki_url" in kinds or "\\href" in out:
        out = "".join(x if isinstance(x, str) else x.text() for x in kept_nodes(block_tree(out)))
    if notations != {"html"}:
        code: list[str] = []

        def keep(m: re.Match) -> str:
            code.append(m[0])
            return f"\x00{len(code) - 1}\x00"

        for n, (p, to) in enumerate(_REWRITE):
            if n == 4:  # code is as fenced as it gets: nothing below may touch it
                out = re.sub(r"```[^\n]*\n.*?```", keep, out, flags=re.S)
            if n == FORMULAS:  # likewise
                out = CONSTRUCTS["formula"][2].sub(keep, out)
            out = p.sub(to, out)
        while re.search("\x00\\d+\x00", out):  # a formula may hold code
            out = re.sub("\x00(\\d+)\x00", lambda m: code[int(m[1])], out)
    out = re.sub(r"[ \t\xa0]+$", "", out.replace("\x00", ""), flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", out).strip("\n"), kinds


def cleaned_texts(df: DataFrame, key: str, field: str) -> DataFrame:
    """(key, clean_text, constructs): one row per text that holds markup. No shuffle, no state between rows."""

    def make() -> object:
        def one(k: object, text: str) -> list[tuple]:
            out, kinds = clean(text)
            return [(k, out, kinds)] if kinds else []

        return one

    return flat_map(df.where(f"length({field}) > 0").select(key, field), make, f"{key} {df.schema[key].dataType.simpleString()}, clean_text string, constructs array<string>")
