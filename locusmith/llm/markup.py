"""Markup residue: HTML pages rendered as clean text with their structure, and leftover markup of four kinds in short texts.

A tree builder reads tags with implied ends; a renderer emits the visible text with block spacing, lists, aligned table
cells, code blocks and formulas. Markdown, wiki and LaTeX residue is then taken out of the text outside of code and
formulas; headings, list items and code blocks of all four kinds get one form.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from locusmith.llm.confusables import one_form
from locusmith.plans.store import spread

# Elements of HTML, MathML and of wiki text, by the way they are laid out.
BLOCK = frozenset("html body p div section article main address blockquote center dl dd dt fieldset figure figcaption form header footer aside nav h1 h2 h3 h4 h5 h6 hr li ol ul menu pre table caption thead tbody tfoot tr details summary legend title gallery references poem".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup tt u var wbr time data output button input select option textarea td th col colgroup link meta base iframe object param embed area map audio video source track picture canvas svg path".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle semantics annotation".split())
WIKI = frozenset("ref references nowiki gallery poem noinclude includeonly onlyinclude syntaxhighlight".split())
HIDDEN = frozenset("script style head template noscript iframe object svg audio video canvas annotation datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr mspace".split())
ELEMENTS = BLOCK | INLINE | MATH | WIKI | HIDDEN
#: Elements that end when one of the named elements starts.
ENDED_BY = {
    "p": BLOCK - {"html", "body"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}),
    "tbody": frozenset({"tbody", "tfoot"}),
    "option": frozenset({"option"}),
    "head": ELEMENTS - frozenset("html head title meta link base script style template noscript object".split()),
    **{f"h{i}": frozenset({"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6"}) for i in range(1, 7)},
}
#: An implied end does not reach beyond these.
SCOPE = frozenset({"table", "ul", "ol", "menu", "dl", "blockquote", "body", "html"})
BARE = "noshade|nowrap|checked|disabled|hidden|selected|compact|controls|readonly|multiple|async|defer|ismap|open|reversed"
ATTRIBUTE = rf"""\s+(?:[a-zA-Z_:][-\w:.]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+)|(?:{BARE})(?=[\s/>]))"""
TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{ATTRIBUTE})*)\s*(/?)>")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!(?:doctype|\[CDATA\[)[^>]*>|<\?[^>]*>|{TAG.pattern}", re.S | re.I)
STYLE_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_VALUE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=]+))?""")


@dataclass
class Node:
    name: str
    attributes: str = ""
    children: list[Node | str] = field(default_factory=list)

    @property
    def visible(self) -> bool:
        return self.name not in HIDDEN and not (self.attributes and hides(self.attributes))

    def attribute(self, name: str) -> str | None:
        """The value of an attribute; "" where it stands without one."""
        return next((value for key, value in attributes_of(self.attributes) if key == name), None)


def attributes_of(attributes: str) -> list[tuple[str, str]]:
    return [(m.group(1).lower(), html.unescape((m.group(2) or "").strip("\"'"))) for m in NAME_VALUE.finditer(attributes)]


def hides(attributes: str) -> bool:
    """Whether an element is hidden by its attribute of that name or by its style."""
    low = attributes.lower()
    if "hidden" not in low and "style" not in low:
        return False
    return any(name == "hidden" or name == "style" and STYLE_HIDDEN.search(value) for name, value in attributes_of(attributes))


#: The elements that end when the named one starts.
ENDS: dict[str, frozenset[str]] = {name: frozenset(ended for ended, by in ENDED_BY.items() if name in by) for name in ELEMENTS}


def build(text: str) -> Node:
    """The tree of a page, however deep. Unknown tags are text; unclosed elements end where their place says; stray end tags are dropped."""
    root = Node("#root")
    stack = [root]
    names: Counter[str] = Counter()  # of the open elements
    deepest = at = 0

    def close(depth: int) -> None:
        for node in stack[depth:]:
            names[node.name] -= 1
        del stack[depth:]

    for token in TOKEN.finditer(text):
        name = (token.group(2) or "").lower()
        if name and name not in ELEMENTS:
            continue
        if stack[-1].name in ("script", "style") and not (token.group(1) and name == stack[-1].name):
            continue  # raw text
        if token.start() > at:
            if stack[-1].name == "head" and text[at : token.start()].strip():
                close(len(stack) - 1)  # text ends the head
            stack[-1].children.append(text[at : token.start()])
        at = token.end()
        if not name:
            continue
        if token.group(1):
            if names[name]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        close(depth)
                        break
                    if stack[depth].name in SCOPE and name not in SCOPE:
                        break
            continue
        if any(names[ended] for ended in ENDS[name]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in ENDS[name]:
                    close(depth)
                elif stack[depth].name in SCOPE or stack[depth].name in ("noscript", "template") and names["head"]:
                    break
        node = Node(name, token.group(3) or "")
        stack[-1].children.append(node)
        if name not in VOID and not token.group(4):
            stack.append(node)
            names[name] += 1
            deepest = max(deepest, len(stack))
    if at < len(text):
        if stack[-1].name == "head" and text[at:].strip():
            stack.pop()
        stack[-1].children.append(text[at:])
    if deepest * 8 + 2000 > sys.getrecursionlimit():
        sys.setrecursionlimit(deepest * 8 + 2000)  # calls from Python to Python need no other stack
    return root


SPACE = re.compile(r"[ \t\r\n\f\xa0]{2,}|[\t\r\n\f\xa0]")
#: Noncharacters, which no text holds: around a formula, around the number of a kept mark, around that of a code block.
FORMULA_START, FORMULA_END, KEPT, CODE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
FORMULA = re.compile(f"{FORMULA_START}([^{FORMULA_START}{FORMULA_END}]*){FORMULA_END}")


def unmarked(text: str) -> str:
    return text.replace(FORMULA_START, "").replace(FORMULA_END, "")


def as_is(line: str) -> str:
    return line


class Renderer:
    """Emits the visible text of a tree: blocks apart by a blank line, lines within them collapsed.

    clean is applied to every line of running text, the text of headings and that of cells; code is never touched.
    """

    def __init__(self, clean: Callable[[str], str] = as_is) -> None:
        self.clean = clean
        self.blocks: list[str] = []
        self.line: list[str] = []
        #: whether there are blocks other than lines of text
        self.laid_out = False

    def end_block(self) -> None:
        text = "\n".join(SPACE.sub(" ", part).strip() for part in "".join(self.line).split("\x00")).strip()
        self.line = []
        if text:
            self.blocks.append("\n".join(map(self.clean, text.split("\n"))))

    def laid(self, block: str) -> None:
        self.blocks.append(block)
        self.laid_out = True

    def within(self, children: list[Node | str]) -> Renderer:
        """What the children of an element give on their own."""
        inner = Renderer(self.clean)
        inner.children(Node("", "", children))
        inner.end_block()
        return inner

    def inline(self, node: Node) -> str:
        """The text of a node on its own, in one line and not cleaned yet."""
        inner = Renderer()
        inner.children(node)
        inner.end_block()
        return SPACE.sub(" ", " ".join(inner.blocks)).strip()

    def children(self, node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                self.line.append(html.unescape(child))
            elif child.visible:
                self.element(child)

    def element(self, node: Node) -> None:
        name = node.name
        if name == "br":
            self.line.append("\x00")
        elif name == "hr":
            self.end_block()
        elif name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.end_block()
            if title := self.clean(self.inline(node)):
                self.laid("#" * int(name[1]) + " " + title)
        elif name in ("ul", "ol", "menu"):
            self.end_block()
            if lines := self.list_lines(node):
                self.laid("\n".join(lines))
        elif name == "pre":
            self.end_block()
            self.laid("```\n" + raw_text(node).strip("\n") + "\n```")
        elif name == "table":
            self.end_block()
            if rows := self.table_lines(node):
                self.laid("\n".join(rows))
        elif name == "math":
            self.line.append(f" {FORMULA_START}{formula(node)}{FORMULA_END} ")
        elif name in ("sup", "sub"):
            if inner := self.inline(node):
                note = name == "sup" and any(isinstance(c, Node) and c.name == "a" for c in node.children)
                plain = unmarked(inner)
                self.line.append(f"[{inner}]" if note else FORMULA_START + ("^" if name == "sup" else "_") + (plain if len(plain) == 1 else f"{{{plain}}}") + FORMULA_END)
        elif name in ("code", "tt", "kbd", "samp") and self.clean is not as_is:
            code = SPACE.sub(" ", raw_text(node)).strip()
            if code and "\n" not in code:
                self.line.append(f"{FORMULA_START}`{code}`{FORMULA_END}")
        elif name == "ref":
            if inner := self.inline(node):
                self.line.append(f" ({inner})")
        elif name == "blockquote":
            self.end_block()
            if blocks := self.within(node.children).blocks:
                self.laid("\n".join("> " + line for line in "\n\n".join(blocks).split("\n")))
        elif name in BLOCK:
            self.end_block()
            self.children(node)
            self.end_block()
        elif name in ("td", "th", "option"):
            self.line.append(" ")
            self.children(node)
            self.line.append(" ")
        else:
            self.children(node)

    def list_lines(self, node: Node) -> list[str]:
        """An item's first block stands beside its sign, the others below, indented: paragraphs, code, tables and lists of its own."""
        lines: list[str] = []
        start = node.attribute("start") or ""
        number = int(start) - 1 if re.fullmatch(r"-?\d{1,9}", start) else 0
        for child in node.children:
            if isinstance(child, str):
                if text := SPACE.sub(" ", html.unescape(child)).strip():
                    lines.append("- " + self.clean(text))
            elif child.name in ("ul", "ol", "menu"):
                lines += ["  " + line for line in self.list_lines(child)]
            elif child.visible:
                value = child.attribute("value") or ""
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number + 1
                inner = self.within(child.children if child.name == "li" else [child])
                own = [line for block in inner.blocks for line in block.split("\n")]
                if not own:
                    continue
                sign = f"{number}. " if node.name == "ol" else "- "
                if re.match(r"[ ]*(?:- |\d+\. |```)", own[0]) and inner.laid_out:
                    own.insert(0, "")  # the item has no text before its list or code
                lines.append((sign + own[0]).rstrip() if own[0] else sign.rstrip())
                lines += ["  " + line if line else "" for line in own[1:]]
        return lines

    def cell(self, node: Node) -> list[str]:
        """The lines of a cell: one for running text, more for lists, code and tables in it."""
        inner = self.within(node.children)
        lines = "\n".join(inner.blocks).split("\n") if inner.laid_out else [SPACE.sub(" ", " ".join(inner.blocks)).strip()]
        return [unmarked(line) for line in lines]

    def table_lines(self, node: Node) -> list[str]:
        rows: list[list[list[str]]] = []
        lines: list[str] = []

        def walk(at: Node, row: list[list[str]] | None) -> None:
            stray: list[Node | str] = []  # what stands between the parts of a table is shown before it

            def shown() -> None:
                lines.extend(line for block in self.within(list(stray)).blocks for line in block.split("\n"))
                stray.clear()

            for child in at.children:
                if isinstance(child, Node) and not child.visible:
                    continue
                if isinstance(child, str) or not holds_parts(child):
                    stray.append(child)
                    continue
                shown()
                if child.name == "tr":
                    walk(child, cells := [])
                    if cells:
                        rows.append(cells)
                elif child.name == "caption":
                    lines.append(self.clean(self.inline(child)))
                elif child.name not in ("td", "th"):
                    walk(child, row)
                elif row is None:
                    rows.append([self.cell(child)])
                else:
                    row.append(self.cell(child))
            shown()

        walk(node, None)
        width = [max((len(line) for r in rows if i < len(r) for line in r[i]), default=0) for i in range(max(map(len, rows), default=0))]
        for r in rows:
            for k in range(max(map(len, r))):
                lines.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, width)).rstrip())
        return lines


def holds_parts(node: Node) -> bool:
    """Whether an element is a part of a table or holds one."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.name in ("tr", "td", "th", "caption"):
            return True
        todo += [c for c in at.children if isinstance(c, Node)]
    return False


def raw_text(node: Node) -> str:
    return "".join(html.unescape(c) if isinstance(c, str) else "\n" if c.name == "br" else raw_text(c) for c in node.children)


def formula(node: Node) -> str:
    """A formula in one line: fractions as a/b, roots as sqrt(x), raised and lowered parts as ^{x} and _{x}."""
    parts = [c if isinstance(c, Node) else Node("mtext", "", [c]) for c in node.children if isinstance(c, Node) or c.strip()]
    inner = [formula(p) if p.children and any(isinstance(c, Node) for c in p.children) else SPACE.sub(" ", raw_text(p)).strip() for p in parts]
    pick: Callable[[int], str] = lambda i: inner[i] if i < len(inner) else ""
    braced: Callable[[int], str] = lambda i: pick(i) if len(pick(i)) == 1 else f"{{{pick(i)}}}"
    if node.name == "mfrac":
        return f"{pick(0)}/{pick(1)}"
    if node.name == "msqrt":
        return f"sqrt({' '.join(inner)})"
    if node.name in ("msup", "mover"):
        return f"{pick(0)}^{braced(1)}"
    if node.name in ("msub", "munder"):
        return f"{pick(0)}_{braced(1)}"
    if node.name in ("msubsup", "munderover"):
        return f"{pick(0)}_{braced(1)}^{braced(2)}"
    return " ".join(inner)


# --- leftover markup in running text -------------------------------------------------------------------------------

INVISIBLE = re.compile(r"[\xad​-‏⁠-⁤︀-️﻿]")
#: Places in which signs of markup are meant: paths, tallies, sets, measures, marks of the editor.
MEANT = re.compile(
    r"\b[A-Za-z]:(?:\\[\w.\-]+)+\\?"
    r"|\{[\d⁰¹²³⁴-⁹\s,;.]*[\d⁰¹²³⁴-⁹][\d⁰¹²³⁴-⁹\s,;.]*\}"
    r"|\[(?:sic|\.\.\.|…|!|\?)\]"
    r"|(?<=[^\W_])_(?=[^\W_])"
    r"|(?<=[^\W_][ ])(?:={2,3}|!=|<=|>=)(?=[ ][^\W_])|(?<=[^\W_])==(?=[^\W_])"
    r"|(?<![\\\w{}^_$'])\{[^\W\d_][^{}\\|\n<>]*\}(?![\w{}])"
    r"|(?<=[\d⁰¹²³⁴-⁹])'{2}(?!')"
)
HOLD = "\ue000"
#: Math between dollars or LaTeX brackets.
MATH_TEXT = re.compile(r"\$\$(.+?)\$\$|\$(?=[^\s\d$])([^$\n]*?[\\^_={}][^$\n]*?|[A-Za-z])\$|\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)
TEX_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "H": "\u030b", "c": "\u0327", "v": "\u030c", "u": "\u0306", "k": "\u0328", "r": "\u030a"}
TEX_LETTERS = {"ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "i": "ı", "j": "ȷ", "aa": "å", "AA": "Å", "ldots": "…", "dots": "…", "S": "§", "P": "¶", "dag": "†", "pounds": "£", "copyright": "©", "textbackslash": "\\", "textasciitilde": "~"}
ACCENT = re.compile(r"""\\(?:(['`^"~=.])\s*(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))|([Hcvukr])(?:\s*\{\s*\\?([A-Za-z])\s*\}|\s+([A-Za-z])(?![A-Za-z])))""")


def _accent(m: re.Match[str]) -> str:
    base = next(g for g in (m.group(2), m.group(3), m.group(5), m.group(6)) if g)
    return unicodedata.normalize("NFC", base + TEX_ACCENTS[m.group(1) or m.group(4)])


#: Named character references that may lack their semicolon.
LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
REFERENCE = re.compile(r"&(?:amp;)*(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};?|([A-Za-z][A-Za-z0-9]{1,31});|(" + "|".join(LEGACY) + r")(?![A-Za-z0-9=])|(nbsp)(?=\w))|&#[xX]?$")


def _reference(m: re.Match[str]) -> str:
    text = m.group()
    while (more := html.unescape(text)) != text:
        text = more
    return text


FENCE = re.compile(r"^[ ]*(?:```|~~~)[^\n`]*\n?(.*?)(?:^[ ]*(?:```|~~~)[ ]*$|\Z)", re.S | re.M)
#: (kind, pattern, what stays), in the order in which they are applied. Patterns see one space for every blank.
RULES: list[tuple[str, re.Pattern[str], str | Callable[[re.Match[str]], str]]] = [
    ("html", re.compile(r"<!--.*?(?:-->|\Z)|^[^<]*?-->", re.S), " "),
    # tags broken off at the end or at the start
    ("html", re.compile(r"""<(?:/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|["']?[^\s"'<>]*))*\s+[a-zA-Z-]+(?:\s*=\s*(?:["'][^"'<>]*|[^\s<>]*)["']?)|[a-zA-Z]{2,}[a-zA-Z0-9]*(?:\s+[a-zA-Z-]+)?)\s*/?\Z"""), ""),
    ("html", re.compile(r"""\A[^<>\n]*?(?:[\w-]+=(?:"[^"<>]*"|'[^'<>]*'|[-\w#]+)|["'/])\s*/?>"""), ""),
    ("html", re.compile(r"""\s/>|(?<=[\w"'])=["'][^"'<>]*["']\s*/?>"""), " "),
    # code
    ("markdown", FENCE, r"\1"),
    # tables
    ("wiki", re.compile(r"^\{\|[^\n]*\n?|^\|[-}+][^\n]*\n?|\{\|(?=\s*class=)[^\n]*", re.M), ""),
    ("markdown", re.compile(r"^[ ]*\|?(?:[ ]*:?-{2,}:?[ ]*\|)+[ ]*:?-*:?[ ]*$\n?", re.M), ""),
    ("markdown", re.compile(r"^[ ]*\|[ ]*(.*?)[ ]*\|?[ ]*$", re.M), lambda m: re.sub(r"[ ]*\|[ ]*", "  ", m.group(1))),
    # wiki
    ("wiki", re.compile(r"\[\[(?:Category|Kategória|Categoria|File|Fájl|Image|Kép):[^\]\n]*(?:\]\])?", re.I), ""),
    ("wiki", re.compile(r"\[\[(?:[^|\]\[\n]*\|)?([^\]\[\n]*)\]\]"), r"\1"),
    ("wiki", re.compile(r"\[\[(?:[^|\]\[\s]*\|)?|\]\]"), ""),
    ("wiki", re.compile(r"\{\{[^|{}\n]*\|([^{}]*)\}\}"), r"\1"),
    ("wiki", re.compile(r"\{\{[^{}\n]*?(?:\||\}\})|\{\{|\}\}"), ""),
    ("wiki", re.compile(r"__[A-Z]{3,}__\n?"), ""),
    ("wiki", re.compile(r"^(={2,6})[ ]*(.*?)[ ]*=+[ ]*$", re.M), r"\2"),
    ("markdown", re.compile(r"(?<=\S)\n[ ]*(?:={3,}|-{3,})[ ]*(?=\n|\Z)"), ""),
    ("wiki", re.compile(r"={2,6}"), ""),
    ("wiki", re.compile(r"'{2,5}(?=\S)(.+?)'{2,5}"), r"\1"),
    ("wiki", re.compile(r"\[https?://[^\s\]]+[ ]+([^\]\n]*)\]?"), r"\1"),
    # markdown
    ("markdown", re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:[ ]+\"[^\"]*\")?\)?"), r"\1"),
    ("markdown", re.compile(r"\]\([^()\s]*\)?|!\[(?=\w)"), ""),
    ("markdown", re.compile(r"\[\^[\w-]+\]:?"), ""),
    ("markdown", re.compile(r"\A[^\[\]\n]*?https?://\S+[ ]+[^\[\]]*\]"), lambda m: re.sub(r"https?://\S+[ ]+|\]", "", m.group())),
    ("markdown", re.compile(r"^[ ]{0,3}#{1,6}[ ]+(\S.*?)[ ]*#*$", re.M), r"\1"),
    ("markdown", re.compile(r"^[ ]{0,3}>+[ ]?", re.M), ""),
    ("markdown", re.compile(r"^[ ]{0,8}(?:[-+]|\*{1,4})[ ]+(?=\S)", re.M), ""),
    ("markdown", re.compile(r"~~(?=\S)(.+?)~~"), r"\1"),
    ("markdown", re.compile(r"~~"), ""),
    ("markdown", re.compile(r"(?<![\d*])\*{2,3}(?=\S)(.+?)(?<=\S)\*{2,3}", re.S), r"\1"),
    ("markdown", re.compile(r"\*{2,3}(?=[^\s\d*])|(?<=[^\s\d\U000f0000-\U000ffffd*])\*{2,3}"), ""),
    # LaTeX
    ("latex", re.compile(r"``|(?<![`\w])`(?=\w[^`\n]*')"), "“"),
    ("latex", re.compile(r"(?<=[^\s\d\U000f0000-\U000ffffd'])''(?!')(?=\W|\Z)|(?<=\d)''(?=[ ]\W[ ])"), "”"),
    ("markdown", re.compile(r"`"), ""),
    ("wiki", re.compile(r"'{2,5}"), ""),
    ("latex", ACCENT, _accent),
    ("latex", re.compile(r"\\(" + "|".join(sorted(TEX_LETTERS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}|[ ])?"), lambda m: TEX_LETTERS[m.group(1)]),
    ("latex", re.compile(r"~?\\(?:cite|ref|label|eqref|pageref|index|begin|end|includegraphics|vspace|hspace)\*?(?:\[[^\]]*\])*(?:\{[^{}]*\}?)?"), ""),
    ("latex", re.compile(r"\\(?:footnote|thanks)\{([^{}]*)\}?"), r" (\1)"),
    ("latex", re.compile(r"\\item\b[ ]*"), "\n- "),
    ("latex", re.compile(r"\\(?:par\b|\\|newline\b|linebreak\b)[ ]*"), "\n"),
    ("latex", re.compile(r"\{\\[A-Za-z]+[ ]+([^{}]*)\}?"), r"\1"),
    ("latex", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}?"), r"\1"),
    ("latex", re.compile(r"\\([&%$#_{}])"), r"\1"),
    ("latex", re.compile(r"\\[A-Za-z]*\*?[ ]*\{?"), ""),
    ("latex", re.compile(r"(?<=[^\s\d\U000f0000-\U000ffffd])\{(?!\})|\{(?=[^\W\d]{2})|(?<=[^\W\d])[,.;:!?”\"']?\}|\{\}"), ""),
    ("latex", re.compile(r"\$\$|\$(?=[A-Za-z\\(])|(?<=[^\s\d\U000f0000-\U000ffffd])~(?=[A-Z\d(])|[_^]\{[^{}]*\}?"), ""),
    # emphasis by single signs, whole or broken off
    ("markdown", re.compile(r"(?<![\w*])\*(?=[^\s*\d])(.+?)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    ("markdown", re.compile(r"(?<![\w*])\*(?=[^\W\d])|(?<=[^\W\d])[.,;:!?]?\*(?![\w*])"), lambda m: m.group().replace("*", "")),
    ("markdown", re.compile(r"(?<!\w)_{1,3}(?=\S)(.+?)(?<=\S)_{1,3}(?!\w)"), r"\1"),
    ("markdown", re.compile(r"(?<![\w_])_(?=[^\W\d_])|(?<=[^\W\d_])[.,;:!?”]?_(?![\w_])"), lambda m: m.group().replace("_", "")),
]
#: Of each rule, in the same order, the signs one of which it cannot match without ("\n" where the line's start is enough).
NEEDS = [
    "<-", "<", ">", ">=", "`~", "{|", "|-", "|",
    "[", "[", "[]", "{", "{}", "_", "=", "=-", "=", "'", "[",
    "[!", "]!", "[", ":", "#", ">", "-+*", "~", "~", "*", "*",
    "`", "'", "`", "'", "\\", "\\", "\\", "\\", "\\", "\\", "\\", "\\", "\\", "\\", "{}", "$~_^",
    "*", "*", "_", "_",
]
#: The element each rule makes of a match, in the same order, around what stays of it or hidden if nothing does; "" where the rule only writes one character or line for another.
BUILDS = [
    "hidden", "hidden", "hidden", "hidden", "pre", "", "", "tr",
    "hidden", "a", "hidden", "span", "hidden", "hidden", "h2", "hidden", "hidden", "b", "a",
    "a", "hidden", "hidden", "a", "h2", "", "", "del", "hidden", "b", "hidden",
    "", "", "hidden", "hidden", "", "", "hidden", "small", "", "", "em", "em", "", "hidden", "hidden", "hidden",
    "em", "hidden", "em", "hidden",
]
#: Private characters that stand for the start and the end of the n-th element of a text (a hidden one has its start only); a rule sees of them that they are
#: no letters, and takes a start for no character before a sign.
STARTS, ENDS_AT, MARKS = 0xF0000, 0x100000, 0xFFFD
MARK_CHARS = re.compile("[\U000f0000-\U000ffffd\U00100000-\U0010fffd]")


def grown(text: str, names: list[str]) -> Node:
    """The tree of a text with element marks. A mark inside another element ends it there, as an end tag does; a lost start or end leaves no trace."""
    root = Node("#root")
    stack, open_marks = [root], [-1]
    at = 0
    for m in MARK_CHARS.finditer(text):
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        code = ord(m.group())
        if code < ENDS_AT:
            node = Node(names[code - STARTS])
            stack[-1].children.append(node)
            if node.name != "hidden":
                stack.append(node)
                open_marks.append(code - STARTS)
        elif code - ENDS_AT in open_marks:
            depth = open_marks.index(code - ENDS_AT)
            del stack[depth:], open_marks[depth:]
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def visible_text(node: Node) -> str:
    """What is seen of a tree of leftover markup: everything but its hidden elements."""
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        elif at.name != "hidden":
            todo += reversed(at.children)
    return "".join(parts)


SIGN = re.compile(r"[<>&*_`#\[\]{}\\$'=~|^]|^[ ]*[-+]|\n[ ]*[-+]|https?:")


#: One line without any sign of markup, in letters of scripts whose look-alikes are letters too.
PLAIN = re.compile(r"(?!\s*[-+])[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf\u01c4-\u024f\u0370-\u037d\u0386-\u052f\u1e00-\u1fbc .,;:!?()\"’“”„–—…§/%-]*\Z")

#: Text that is the one form of itself: ASCII, the letters of Latin in one character each, and signs without a look-alike.
USUAL_LETTERS = re.compile(r"[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e“”„’–—…§]*\Z")

#: Code blocks: fences, elements of raw text and LaTeX environments, whole or broken off at the end.
LITERAL = re.compile(
    r"^[^\S\n]*(?P<fence>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<fenced>.*?)(?:^[^\S\n]*(?P=fence)[`~]*[^\S\n]*$|\Z)"
    r"|<(?P<tag>pre|syntaxhighlight)\b[^<>]*>(?P<element>.*?)(?:</(?P=tag)\s*>|\Z)"
    r"|\\begin\{(?P<name>verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\]|\{[^{}]*\})*\n?(?P<environment>.*?)(?:\\end\{(?P=name)\}|\Z)",
    re.S | re.M | re.I,
)
INLINE_CODE = re.compile(r"(?<!`)`([^`'\n]+)`(?!`)")
MATH_ENVIRONMENT = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.+?)(?:\\end\{\1\}|\Z)", re.S)
LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
SECTION = re.compile(r"[ ]*\n?[ ]*\\(" + "|".join(LEVELS) + r")\*?(?:\[[^\]\n]*\])?\{((?:[^{}]|\{[^{}]*\})*)(?:\}|\Z)[ ]*\n?")
LIST_STEP = re.compile(r"[ ]*\n?[ ]*\\(?:(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?[ ]*\n?|item\b(?:\[([^\]\n]*)\])?[ ]*)")
QUOTED = re.compile(r"^[ ]{0,3}>+[ ]?", re.M)
#: Tables: rows of Markdown with a rule below the first, and wiki tables.
ROWS = re.compile(r"^[ ]*\|[^\n]*\|[ ]*\n[ ]*\|?(?:[ ]*:?-+:?[ ]*\|)+[ ]*:?-*:?[ ]*(?:\n|\Z)(?:^[ ]*\|[^\n]*(?:\n|\Z))*", re.M)
WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)(?:^\|\}[^\n]*(?:\n|\Z)|\Z)", re.S | re.M)
RULE_LINE = re.compile(r"[ ]*\|?(?:[ ]*:?-+:?[ ]*\|)+[ ]*:?-*:?[ ]*\Z")


def table_of(rows: list[list[str]]) -> Node:
    """The tree of a table whose cells are text, cleaned for themselves."""
    return Node("table", "", [Node("tr", "", [Node("td", "", [html.escape(cleaned(cell.strip())[0])]) for cell in row]) for row in rows])


def markdown_rows(block: str) -> list[list[str]]:
    lines = [line.strip() for line in block.strip("\n").split("\n")]
    return [line.strip("|").split("|") for line in lines if not RULE_LINE.match(line)]


def wiki_rows(body: str) -> list[list[str]]:
    """Rows of a wiki table, one cell per line or several parted by || or !!; attributes before a single | are no text."""
    rows: list[list[str]] = [[]]
    for line in body.split("\n"):
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in ("|", "!") and not line.startswith("|+"):
            for cell in re.split(r"\|\||!!", line[1:]):
                attributes, bar, text = cell.partition("|")
                rows[-1].append(text if bar and "=" in attributes and "[" not in attributes else cell)
        elif line.strip() and rows[-1]:
            rows[-1][-1] += " " + line
    return [row for row in rows if row]


HEADING = re.compile(r"[ ]{0,3}(#{1,6})[ ]+(\S.*?)(?:[ ]+#+)?[ ]*$")
WIKI_HEADING = re.compile(r"(={2,6})[ ]*([^=\s](?:.*?(?=[ ]*=+[ ]*$)|[^=]*$))")
UNDERLINE = re.compile(r"[ ]*(={3,}|-{3,})[ ]*$")
BREAK = re.compile(r"[ ]*([-*_])(?:[ ]+\1){2,}[ ]*$")
LIST_ITEM = re.compile(r"([ ]{0,8})([-+]|\*{1,4}|\d{1,3}[.)])[ ]+(?=\S)")


def outlined(text: str, mark: Callable[[str], str], quotes: bool) -> str:
    """text with headings and list items of all kinds in one form, their signs given to mark: "## ", and "- " or "1. " after two blanks per level."""
    if quotes:
        text = QUOTED.sub("", text)
    text = SECTION.sub(lambda m: "\n" + mark("#" * LEVELS[m.group(1)] + " ") + m.group(2).strip() + "\n", text)
    open_lists: list[list] = []

    def step(m: re.Match[str]) -> str:
        if m.group(1) == "begin":
            open_lists.append([m.group(2), 0])
            return "\n"
        if m.group(1) == "end":
            del open_lists[-1:]
            return "" if open_lists else "\n"
        sign = "- "
        if open_lists and open_lists[-1][0] == "enumerate":
            open_lists[-1][1] += 1
            sign = f"{open_lists[-1][1]}. "
        return "\n" + mark("  " * max(0, len(open_lists) - 1) + sign) + (m.group(3) + " " if m.group(3) else "")

    text = LIST_STEP.sub(step, text)
    out: list[str] = []
    indents: list[int] = []  # of the list items that are open
    depth = -1  # of the last list item
    for line in text.split("\n"):
        if BREAK.match(line):
            continue
        if (m := HEADING.match(line)) or (m := WIKI_HEADING.match(line)):
            out.append(mark("#" * len(m.group(1)) + " ") + m.group(2))
        elif (m := UNDERLINE.match(line)) and out and out[-1].strip() and not re.search(rf"[|{KEPT}{CODE}]", out[-1]):
            out[-1] = mark("# " if m.group(1)[0] == "=" else "## ") + out[-1].strip()
        elif m := LIST_ITEM.match(line):
            indent, sign = len(m.group(1)), m.group(2)
            if len(sign) > 1 and sign[0] == "*":
                depth = min(len(sign) - 1, depth + 1)
            else:
                while indents and indents[-1] > indent:
                    indents.pop()
                if not indents or indents[-1] < indent:
                    indents.append(indent)
                depth = len(indents) - 1
            out.append(mark("  " * depth + (sign if sign[0].isdigit() else "-") + " ") + line[m.end() :])
            continue
        else:
            out.append(line)
            if not line.strip() or line[0] == " ":
                continue  # a list goes on after blank and indented lines
        indents, depth = [], -1
    return "\n".join(out)


def kept(text: str) -> tuple[str, list[str]]:
    """cleaned, with headings, lists, code blocks and formulas kept in the form that pages are rendered in."""
    kinds = cleaned(text)[1]
    return (stripped(text, True)[0], kinds) if kinds else (text, [])


def cleaned(text: str) -> tuple[str, list[str]]:
    """(text without its leftover markup, the kinds found): one line or passage, the signs of headings and lists go as well.

    What is markup is decided on the one form of the text's look, so that unusual letters and blanks neither hide nor
    feign any; the clean text is made of the characters as they are. A text without markup stays as it is.
    """
    if PLAIN.match(text) and "http" not in text:
        return text, []
    alike = text if USUAL_LETTERS.match(text) else one_form(text)
    clean, kinds = stripped(alike)
    if not kinds:
        return text, []
    return (clean if alike == text else stripped(text)[0]), kinds


def stripped(text: str, keep: bool = False) -> tuple[str, list[str]]:
    """(text without markup, kinds): tree building and rendering first, then the rules in turn.

    keep: code blocks are held before anything else, and headings and list items as outlined gives them.
    """
    text = INVISIBLE.sub("", text)
    marks: list[str] = []

    def mark(sign: str) -> str:
        marks.append(sign)
        return f"{KEPT}{len(marks) - 1}{KEPT}"

    def literal(m: re.Match[str], written: bool) -> str:
        if m.group("tag"):
            code = raw_text(build(m.group("element") if written else m.group("element").replace("&", "&amp;")))
        else:
            code = next(x for x in (m.group("fenced"), m.group("environment")) if x is not None)
        code = re.sub(r"[^\S\n\t]", " ", code).strip("\n").rstrip()
        marks.append(f"```{(m.group('info') or '').strip()}\n{code}\n```" if code.strip() else "")
        return f"{CODE}{len(marks) - 1}{CODE}"

    if keep:
        text = LITERAL.sub(lambda m: literal(m, True), text)
    text = re.sub(r"[^\S\n]", " ", text)
    if not SIGN.search(text) and not marks:
        return text, []
    kinds: set[str] = set()
    if "&" in text:
        more = REFERENCE.sub(lambda m: _reference(m) if m.group(1) is None or m.group(1) + ";" in html.entities.html5 else m.group(), text)
        if more != text:
            kinds.add("html")
            text = re.sub(r"[^\S\n]", " ", more)
            if keep:
                text = LITERAL.sub(lambda m: literal(m, False), text)
    tags = "<" in text and any(not m.group(2) or m.group(2).lower() in ELEMENTS for m in TOKEN.finditer(text))
    held: list[str] = []

    def hold(m: re.Match[str]) -> str:
        held.append(m.group())
        return f"{HOLD}{len(held) - 1}{HOLD}"

    def as_text(m: re.Match[str]) -> str:
        kinds.add("latex")
        held.append(next(g for g in m.groups() if g is not None).strip())
        return f"{HOLD}{len(held) - 1}{HOLD}"

    def inner(m: re.Match[str]) -> str:
        held.append(m.group(m.lastindex).strip())
        return f"{HOLD}{len(held) - 1}{HOLD}"

    def table(m: re.Match[str]) -> str:
        rows = wiki_rows(m.group(1)) if m.re is WIKI_TABLE else markdown_rows(m.group())
        if max(map(len, rows), default=0) < 2:
            return m.group()  # no more than one column: text between signs
        marks.append("\n".join(Renderer().table_lines(table_of(rows))))
        return f"{CODE}{len(marks) - 1}{CODE}\n"

    if keep:
        text = WIKI_TABLE.sub(table, ROWS.sub(table, text))
        text = INLINE_CODE.sub(inner, MATH_ENVIRONMENT.sub(inner, text))
        text = outlined(text, mark, not tags)
    if tags:
        kinds.add("html")
        # "&" is protected: what the references stood for is text by now
        renderer = Renderer()
        renderer.children(build(text.replace("&", "&amp;").replace("\n", "\x00")))
        renderer.end_block()
        text = "\n".join(renderer.blocks).replace("\x00", "\n")
        if keep:
            text = outlined(LITERAL.sub(lambda m: literal(m, False), text), mark, True)
    text = FORMULA.sub(inner, text)
    if "$" in text or "\\" in text:
        text = MATH_TEXT.sub(as_text, text)
    text = MEANT.sub(hold, text)
    there = set(text)
    names: list[str] = []
    for (kind, pattern, stays), needs, name in zip(RULES, NEEDS, BUILDS, strict=True):
        if there.isdisjoint(needs) or keep and pattern is FENCE:
            continue
        if not name:
            more = pattern.sub(stays, text)
        else:

            def wrapped(m: re.Match[str], name: str = name, stays=stays) -> str:
                inner = m.expand(stays) if isinstance(stays, str) else stays(m)
                if name == "hidden" and inner.strip():
                    return inner
                if len(names) == MARKS:
                    return inner  # so many elements in one text are left flat
                names.append(name)
                n = len(names) - 1
                return f"{chr(STARTS + n)}{inner}" if name == "hidden" else f"{chr(STARTS + n)}{inner}{chr(ENDS_AT + n)}"

            more = pattern.sub(wrapped, text)
        if more != text:
            kinds.add(kind)
            text, there = more, set(more)
    if names:
        text = visible_text(grown(text, names))
    for i in range(len(held) - 1, -1, -1):
        text = text.replace(f"{HOLD}{i}{HOLD}", held[i])
    text = re.sub(r"[ ]{2,}", " ", text).strip()
    if marks:
        text = re.sub(rf"^[ ]*({KEPT}\d+{KEPT})[ ]*", r"\1", text, flags=re.M)
        text = re.sub(rf"^{KEPT}\d+{KEPT}$\n?", "", text, flags=re.M)  # nothing is left of the line
        text = re.sub(rf"[ ]*\n?[ ]*({CODE}\d+{CODE})[ ]*\n?[ ]*", r"\n\1\n", text)
        text = re.sub(rf"[{KEPT}{CODE}](\d+)[{KEPT}{CODE}]", lambda m: marks[int(m.group(1))], text).strip("\n")
    return text, sorted(kinds)


def rendered(page: str) -> str:
    """A page as clean text: headings as # lines, lists, aligned tables, fenced code, formulas; leftover markup of other kinds removed outside code."""
    renderer = Renderer(lambda line: cleaned(line)[0])
    renderer.children(build(page))
    renderer.end_block()
    return unmarked("\n\n".join(renderer.blocks))


CLEANED = StructType([StructField("clean", StringType()), StructField("kinds", ArrayType(StringType()))])


@F.pandas_udf(CLEANED)
def cleaned_udf(texts: pd.Series) -> pd.DataFrame:
    memo = lru_cache(50_000)(kept)
    return pd.DataFrame([memo(t) if t is not None else (None, []) for t in texts], columns=["clean", "kinds"])


@F.pandas_udf(StringType())
def rendered_udf(pages: pd.Series) -> pd.Series:
    return pages.map(rendered, na_action="ignore")


def clean_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, clean, kinds): every row's text without leftover markup and the kinds found (html, latex, markdown, wiki).

    Headings are # lines, list items - or 1. lines, code blocks are fenced, formulas stay; a text without markup stays as it is.

    Null stays null, blank texts have no kinds; signs that are meant as text stay. Repeated rows stay repeated.
    """
    return df.select(key, cleaned_udf(F.col(text)).alias("_c")).select(key, "_c.clean", "_c.kinds")


def clean_pages(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, clean) of HTML pages; null stays null and an empty page gives an empty text."""
    return spread(pages.select(key, page)).select(key, rendered_udf(F.col(page)).alias("clean"))
