"""What Spark expressions can't read from Rust text: masks, comments, and the nesting of items.

A small helper for one file at a time: everything that is decided from these facts is a Spark expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from lintlake.functions.rust_nodes import Nodes

_QUOTED = re.compile(
    r'(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>\bb?r(?P<hash>#*)")|(?P<text>"(?:\\.|[^"\\])*"?)'
    r"|(?P<char>'(?:\\u\{[^}']*\}|\\x..|\\.|[^\\'\n])')",
    re.S,
)
_BLANK = re.compile(r"[^\n]")
_WORD = re.compile(r"[A-Za-z_]\w*|::|->|=>|[^\s\w]|\d\w*")
_OPEN, _CLOSE = "([{", ")]}"


def _block_comment_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def masked(text: str) -> tuple[str, str, list[tuple[int, str, bool]]]:
    """Text without literals; without literals and comments; and (line, text, is_doc) of the comments.

    Blanks take the place of what goes, so lines stay where they are.
    """
    kept, code, comments, at, line = [], [], [], 0, 1
    while m := _QUOTED.search(text, at):
        plain = text[at : m.start()]
        kept.append(plain)
        code.append(plain)
        line += plain.count("\n")
        if m["line"] is not None:
            part = m[0]
            comments.append((line, part.lstrip("/!").strip(), part.startswith(("///", "//!")) and not part.startswith("////")))
            kept.append(part)
            code.append(" " * len(part))
        elif m["block"] is not None:
            part = text[m.start() : _block_comment_end(text, m.start())]
            comments.append((line, part[2:].split("\n")[0].strip("*!/ \t\r"), part.startswith(("/**", "/*!")) and len(part) > 4))
            kept.append(part)
            code.append(_BLANK.sub(" ", part))
        else:
            part = m[0]
            if m["raw"] is not None:
                end = text.find('"' + m["hash"], m.end())
                part = text[m.start() : len(text) if end < 0 else end + 1 + len(m["hash"])]
            kept.append(_BLANK.sub(" ", part))
            code.append(kept[-1])
        line += part.count("\n")
        at = m.start() + len(part)
    return "".join(kept) + text[at:], "".join(code) + text[at:], comments


def _by_bytes(text: str) -> str:
    """One character for each byte, so that blanks in place of characters keep the places of bytes."""
    return text if text.isascii() else text.encode().decode("latin-1")


def _from_bytes(text: str) -> str:
    return text if text.isascii() else text.encode("latin-1").decode()


def byte_masks(text: str) -> tuple[str, str]:
    """The first two of `masked`, with one blank for each byte that goes."""
    kept, code, _ = masked(_by_bytes(text))
    return _from_bytes(kept), _from_bytes(code)


_SCOPED = re.compile(r'(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>\bb?r(?P<hash>#*)")|"(?:\\.|[^"\\])*"?', re.S)


def comment_scope(text: str) -> str:
    """The comments of a text and blanks for the other bytes.

    Unlike the masks, this scope knows no character literals: the quote in '"' opens a string here.
    """
    text, parts, at = _by_bytes(text), [], 0
    while m := _SCOPED.search(text, at):
        parts.append(_BLANK.sub(" ", text[at : m.start()]))
        end = m.end()
        if m["block"] is not None:
            end = _block_comment_end(text, m.start())
        elif m["raw"] is not None:
            close = text.find('"' + m["hash"], m.end())
            end = len(text) if close < 0 else close + 1 + len(m["hash"])
        whole = text[m.start() : end]
        parts.append(whole if m["line"] is not None or m["block"] is not None else _BLANK.sub(" ", whole))
        at = end
    return _from_bytes("".join(parts) + _BLANK.sub(" ", text[at:]))


class Scan:
    """Items of one file, from its code without literals and comments."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.masked, self.code, self.comments = masked(text)
        self.masked_lines = self.masked.split("\n")
        self.tokens = [(m[0], m.start()) for m in _WORD.finditer(self.code)]
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.code))]
        self.blocks: list[dict] = []
        self.items: list[dict] = []
        self.fields: list[dict] = []
        self.nodes: list[dict] = []
        self.error = None
        self.pair: dict[int, int] = {}
        stack = []
        for k, (t, _) in enumerate(self.tokens):
            if t in _OPEN:
                stack.append(k)
            elif t in _CLOSE:
                if not stack or _OPEN.index(self.tokens[stack[-1]][0]) != _CLOSE.index(t):
                    self.error = f"unbalanced {t}"
                    return
                self.pair[stack.pop()] = k
        if stack:
            self.error = f"unclosed {self.tokens[stack[-1]][0]}"
            return
        try:
            self._items(0, len(self.tokens), "", False, False, "")
            self.nodes = self._node_rows(Nodes([t for t, _ in self.tokens], self.pair).rows)
        except RecursionError:
            self.error, self.blocks, self.items, self.fields, self.nodes = "nested too deeply", [], [], [], []

    def _line(self, k: int) -> int:
        return bisect_right(self.starts, self.tokens[min(k, len(self.tokens) - 1)][1])

    def _node_rows(self, rows: list[list]) -> list[dict]:
        """Nodes with their lines, the code's offset at which they begin, and the function and block that they stand in."""
        out = []
        for node, past, parent, kind, text, first, last, whole in rows:
            above = out[parent] if parent >= 0 else None
            around = {"fn": None, "block": None} if above is None else {k: parent if above["kind"] == k else above[k] for k in ("fn", "block")}
            out.append({"node": node, "past": past, "parent": parent, "kind": kind, "text": text, "line": self._line(first), "end_line": self._line(last), "at": self.tokens[first][1], "whole": whole} | around)
        return out

    def _raw(self, a: int, b: int) -> str:
        return self.text[self.tokens[a][1] : self.tokens[b][1] + 1]

    def _items(self, k: int, end: int, module: str, test: bool, gated: bool, within: str) -> None:
        """`within`: empty in a module, impl, trait impl ("trait-impl") or a trait."""
        word = lambda i: self.tokens[i][0] if i < end else ""
        while k < end:
            first, attrs, public, bare, flags = k, [], False, False, set()
            while word(k) == "#":
                k += 1 + (word(k + 1) == "!")
                if k not in self.pair:
                    break
                attrs.append(self._raw(k, self.pair[k]))
                k = self.pair[k] + 1
            if word(k) == "pub":
                public, bare, k = True, True, k + 1
                if word(k) == "(":
                    bare, k = False, self.pair[k] + 1
            while word(k) in ("async", "unsafe", "const", "default", "extern"):
                flags.add(word(k))
                k += 1
            kind, name = word(k), word(k + 1)
            own_test = test or any(re.match(r"\[\s*(?:\w+\s*::\s*)*test\b", a) or re.match(r"\[\s*cfg\s*\(\s*(?:all\s*\([^)]*)?\btest\b", a) for a in attrs)
            own_gated = gated or any(re.match(r"\[\s*cfg\b", a) for a in attrs)
            documented = any(re.match(r"\[\s*doc\b", a) for a in attrs) or self._documented(first)
            stop = k
            while stop < end and word(stop) not in ("{", ";"):
                stop = self.pair.get(stop, stop) + 1
            body = self.pair.get(stop) if word(stop) == "{" else None
            about = {"name": name, "line": self._line(first), "module_path": module, "public": public, "externally_public": bare, "cfg_gated": own_gated, "test_context": own_test, "documented": documented, "within": within}
            if kind == "fn":
                self.items.append(about | {"kind": "method" if within else "function"})
                if body is not None and within != "trait":
                    self._function(first, k, stop, body, about, attrs, flags, own_test)
            elif kind in ("struct", "enum", "trait", "union"):
                self.items.append(about | {"kind": "struct" if kind == "union" else kind})
                if kind == "struct" and body is not None:
                    self._fields(stop, body, attrs)
            elif kind == "mod":
                self.items.append(about | {"kind": "mod", "inline": body is not None})
                if body is not None:
                    self._items(stop + 1, body, f"{module}::{name}" if module else name, own_test or name == "tests", own_gated, "")
            elif kind == "impl" and body is not None:
                self._items(stop + 1, body, module, own_test, own_gated, "trait-impl" if any(word(i) == "for" and word(i + 1) != "<" for i in range(k, stop)) else "impl")
            if kind == "const" or kind in ("static", "let", "type", "use") or flags & {"const"} and kind not in ("fn",):
                while stop < end and word(stop) != ";":
                    stop = self.pair.get(stop, stop) + 1
                body = None
            k = max(k, body if body is not None else stop) + 1

    def _documented(self, first: int) -> bool:
        at = self._line(first) - 2
        while at >= 0 and (not self.lines[at].strip() or self.lines[at].lstrip().startswith("#[")):
            at -= 1
        return at >= 0 and self.lines[at].lstrip().startswith("///")

    def _function(self, first: int, k: int, stop: int, body: int, about: dict, attrs: list[str], flags: set[str], test: bool) -> None:
        open_ = next((i for i in range(k + 2, stop) if self.tokens[i][0] == "("), None)
        if open_ is None:
            return
        signature = self.code[self.tokens[open_][1] + 1 : self.tokens[self.pair[open_]][1]]
        params, depth, at = [], 0, 0
        for i, c in enumerate(signature + ","):
            depth += (c in "([{<") - (c in ")]}" or (c == ">" and signature[i - 1 : i] not in ("-", "=")))
            if c == "," and depth <= 0:
                params.append(signature[at:i].strip())
                at = i + 1
        params = [p for p in params if p and not re.match(r"(?:&\s*)?(?:'\w+\s*)?(?:mut\s+)?self\b", p)]
        back = re.sub(r"\bwhere\b.*", "", self.code[self.tokens[self.pair[open_]][1] + 1 : self.tokens[stop][1]], flags=re.S).strip().removeprefix("->").strip()
        start, last = self._line(k), self._line(body)
        while start > 1 and (not self.lines[start - 2].strip() or self.lines[start - 2].lstrip().startswith(("#[", "///"))):
            start -= 1
        span = slice(start - 1, last)
        self.blocks.append(about | {
            "at": self.tokens[k][1], "start_line": start, "line_count": last - start + 1, "params": [re.sub(r"\s*:.*", "", p, flags=re.S).removeprefix("mut ").strip() for p in params], "body": "\n".join(self.lines[span]),
            "masked_body": "\n".join(self.masked_lines[span]), "code_body": "\n".join(self.code.split("\n")[span]),
            "is_test": any(re.match(r"\[\s*(?:\w+\s*::\s*)*test\b", a) for a in attrs), "is_async": "async" in flags, "is_unsafe": "unsafe" in flags,
            "returns_bool": back == "bool", "returns_result": bool(re.match(r"(?:\w+\s*::\s*)*Result\b", back)), "returns": bool(back),
            "ignored": any(re.fullmatch(r"\[\s*ignore\s*(?:=\s*\"\s*\")?\s*\]", a) for a in attrs),
        })

    def _fields(self, open_: int, close: int, attrs: list[str]) -> None:
        inner = self.text[self.tokens[open_][1] : self.tokens[close][1]]
        if any(re.search(r"\b(?:serde|Serialize|Deserialize)\b", a) for a in [*attrs, *re.findall(r"#\[[^\]]*\]", inner)]):
            return
        depth = 0
        for k in range(open_ + 1, close):
            t = self.tokens[k][0]
            depth += (t in "([{<") - (t in ")]}>")
            if t == "pub" and depth == 0 and self.tokens[k - 1][0] in "{,]":
                after = k + 1 if self.tokens[k + 1][0] != "(" else self.pair[k + 1] + 1
                if after == k + 1:
                    self.fields.append({"name": self.tokens[after][0], "line": self._line(k)})


_LOOP = re.compile(r"\b(for|while|loop)\b")
_FIXED_LOOP = re.compile(r"\bfor\s+[A-Za-z_][A-Za-z0-9_]*\s+in\s+&?[A-Z][A-Z0-9_]*(?:\s*\.iter\(\))?\s*\{?")


def loop_code(code: str) -> str:
    """The code of a body that lies between the braces of a loop that isn't over a constant, and blanks for the rest.

    A line with a loop's keyword makes a loop of the next brace that opens, the first one of that line included.
    """
    out, depth, loops, pending = [], 0, [], None
    for line in code.split("\n"):
        if _LOOP.search(line):
            pending = not _FIXED_LOOP.search(line)
        at, parts = 0, []
        for m in re.finditer("[{}]", line):
            parts.append(line[at : m.end()] if loops else " " * (m.end() - at))
            at = m.end()
            if m[0] == "{":
                depth += 1
                if pending:
                    loops.append(depth)
                pending = None
            else:
                while loops and loops[-1] >= depth:
                    loops.pop()
                depth = max(0, depth - 1)
        parts.append(line[at:] if loops else " " * (len(line) - at))
        out.append("".join(parts))
    return "\n".join(out)
