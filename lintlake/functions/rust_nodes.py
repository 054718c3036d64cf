"""Statements and expressions of Rust code as a preorder table: a node's subtree is the nodes from it up to `past`.

A small helper for one file at a time, over the tokens and bracket pairs of its scan; rules join the table with itself.

Kinds: fn, param, let, stmt, tail (a last statement without semicolon), item, block, if, while, for, loop, match, arm, closure, call,
method, macro, struct, array, repeat, index, tuple, await, name, binding. `text` is a name where there is one: of the
function, the last segment of a path or of a called one, the macro, the struct, the binding, or of a `let` that binds one plain name.
A node is `whole` if it is all of the expression that it stands in (all of an initial value, a tail, an arm's body).
"""

from __future__ import annotations

_CONTROL = {"if", "while", "for", "loop", "match"}
_ITEMS = {"pub", "fn", "struct", "enum", "union", "trait", "impl", "mod", "use", "type", "static", "extern", "macro_rules"}
_NOT_NAMES = _CONTROL | {"return", "break", "continue", "else", "in", "let", "move", "async", "unsafe", "as", "mut", "ref", "box", "dyn", "await", "where", "const", "static"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


def _is_name(word: str) -> bool:
    return bool(word) and (word[0].isalpha() or word[0] == "_")


class Nodes:
    """`rows` has [node, past, parent, kind, text, first, last, whole] with token numbers; the last token is part of the node."""

    def __init__(self, words: list[str], pair: dict[int, int]):
        self.words, self.pair, self.rows = words, pair, []
        self._statements(0, len(words), -1)

    def _word(self, k: int) -> str:
        return self.words[k] if 0 <= k < len(self.words) else ""

    def _open(self, kind: str, text: str, first: int, parent: int) -> int:
        self.rows.append([len(self.rows), 0, parent, kind, text, first, first, False])
        return len(self.rows) - 1

    def _close(self, node: int, last: int) -> None:
        self.rows[node][1], self.rows[node][6] = len(self.rows), last

    def _until(self, k: int, end: int, *stops: str) -> int:
        """The first of `stops` outside brackets."""
        while k < end and self.words[k] not in stops:
            k = self.pair.get(k, k) + 1
        return min(k, end)

    def _equals(self, k: int, end: int) -> int:
        """The `=` of a binding: outside brackets and type arguments."""
        angle = 0
        while k < end:
            w = self.words[k]
            if w == "=" and angle <= 0 and self._word(k + 1) != "=" and self._word(k - 1) not in "=<>!.":
                return k
            angle += (w == "<") - (w == ">")
            k = self.pair.get(k, k) + 1
        return end

    def _attributes(self, k: int, end: int) -> int:
        while k < end and self.words[k] == "#":
            k += 1 + (self._word(k + 1) == "!")
            k = self.pair.get(k, k) + 1
        return k

    def _statements(self, k: int, end: int, parent: int) -> None:
        while (k := self._attributes(k, end)) < end:
            w, past = self.words[k], k
            if w == ";":
                k += 1
                continue
            if self._starts_item(k):
                k = self._item(k, end, parent)
                continue
            if w == "let":
                past = self._until(k, end, ";")
                node = self._open("let", "", k, parent)
                self._let(k + 1, past, node)
                self._close(node, past - 1)
                k = past + 1
                continue
            after = k + 2 if self._word(k + 1) == ":" and self._word(k) not in _NOT_NAMES else k  # past a label, whose quote is no token of its own
            after += self._word(after) in ("unsafe", "async") and self._word(after + 1) == "{"
            if w == "'":
                after = k + 3
            if self._word(after) in _CONTROL or self._word(after) == "{":
                past = self._control_end(after, end)
                if self._word(past) in (".", "?"):
                    past = self._until(past, end, ";")
            elif _is_name(w) and self._word(k + 1) == "!" and self._word(k + 2) == "{":
                past = self.pair[k + 2] + 1
            else:
                past = self._until(k, end, ";")
            tail = past >= end
            node = self._open("tail" if tail else "stmt", "", k, parent)
            self._expression(k, past, node)
            self._close(node, past - 1)
            k = past + (self._word(past) == ";" and not tail)

    def _starts_item(self, k: int) -> bool:
        while self._word(k) in ("async", "unsafe", "const", "default"):
            if self._word(k + 1) in ("{", "move", "|"):
                return False
            if self._word(k) == "const" and _is_name(self._word(k + 1)) and self._word(k + 1) not in ("fn", "unsafe", "async", "extern"):
                return True
            if self._word(k) == "default" and self._word(k + 1) not in _ITEMS | {"async", "unsafe", "const"}:
                return False
            k += 1
        if self._word(k) == "union":
            return _is_name(self._word(k + 1))
        return self._word(k) in _ITEMS and self._word(k + 1) not in ("(", ".") or self._word(k) == "pub"

    def _item(self, k: int, end: int, parent: int) -> int:
        first = k
        if self._word(k) == "pub":
            k += 1
            k = self.pair[k] + 1 if self._word(k) == "(" else k
        while self._word(k) in ("async", "unsafe", "const", "default", "extern") and self._word(k + 1) in _ITEMS | {"async", "unsafe", "const", "extern"}:
            k += 1
        kind, stop = self._word(k), self._until(k, end, "{", ";")
        body = self.pair.get(stop) if self._word(stop) == "{" else None
        if kind == "fn":
            node = self._open("fn", self._word(k + 1), k, parent)
            opened = self._until(k + 2, stop, "(")
            if self._word(k + 2) == "<":  # a bound such as Fn(u8) in type arguments opens a bracket of its own
                opened, depth = k + 3, 1
                while opened < stop and depth:
                    depth += (self.words[opened] == "<") - (self.words[opened] == ">" and self.words[opened - 1] != "-")
                    opened += 1
            if self._word(opened) == "(":
                self._patterns(opened + 1, self.pair[opened], node, "param")
            if body is not None:
                self._block(stop, node)
            last = stop if body is None else body
            self._close(node, last)
            return last + 1
        node = self._open("item", kind, first, parent)
        if kind in ("mod", "impl", "trait") and body is not None:
            self._statements(stop + 1, body, node)
        elif kind in ("const", "static"):
            stop, body = self._until(k, end, ";"), None
            self._expression(self._equals(k, stop) + 1, stop, node)
        elif kind in ("use", "type"):
            stop, body = self._until(k, end, ";"), None
        last = stop if body is None else body
        self._close(node, min(last, end - 1))
        return last + 1

    def _patterns(self, k: int, end: int, parent: int, kind: str) -> None:
        """Patterns between commas, each with or without a type."""
        while k < end:
            angle, past, colon = 0, k, None
            while past < end and not (self.words[past] == "," and angle <= 0):
                if self.words[past] == ":" and colon is None:
                    colon = past
                if colon is not None:
                    angle += (self.words[past] == "<") - (self.words[past] == ">" and self.words[past - 1] != "-")
                past = self.pair.get(past, past) + 1
            past = min(past, end)
            first = self._attributes(k, past)
            if first < past:
                node = self._open(kind, "", first, parent)
                self._pattern(first, past if colon is None else colon, node)
                self._close(node, past - 1)
            k = past + 1

    def _pattern(self, k: int, end: int, parent: int) -> None:
        """Names that a pattern binds. What stands right of `@` binds none here."""
        while k < end:
            w = self.words[k]
            after = self._word(k + 1) if k + 1 < end else ""
            if w in ("(", "["):
                self._pattern(k + 1, self.pair[k], parent)
            elif w == "{":
                self._fields(k + 1, self.pair[k], parent)
            elif w == "'":
                k += 1
            elif _is_name(w) and w not in ("mut", "ref", "box", "self", "_") and self._word(k - 1) != "::" and after not in ("::", "(", "{", "!"):
                self._close(self._open("binding", w, k, parent), k)
                if after == "@":
                    k = self._until(k, end, ",", "|") - 1
            k = self.pair.get(k, k) + 1

    def _fields(self, k: int, end: int, parent: int) -> None:
        while k < end:
            past = self._until(k, end, ",")
            first = self._attributes(k, past)
            colon = self._until(first, past, ":")
            self._pattern(colon + 1 if colon < past else first, past, parent)
            k = past + 1

    def _let(self, k: int, end: int, parent: int) -> None:
        equals = self._equals(k, end)
        angle_free = self._until(k, equals, ":")
        name = k + (self._word(k) == "mut")
        if name + 1 == angle_free and _is_name(self._word(name)):
            self.rows[parent][4] = self._word(name)
        self._pattern(k, angle_free, parent)
        self._expression(equals + 1, end, parent)

    def _block(self, k: int, parent: int) -> int:
        node = self._open("block", "", k, parent)
        self._statements(k + 1, self.pair[k], node)
        self._close(node, self.pair[k])
        return self.pair[k] + 1

    def _control_end(self, k: int, end: int) -> int:
        """Past the last block of a control expression or block."""
        stop = self._until(k, end, "{")
        k = self.pair[stop] + 1 if stop < end else end
        while self._word(k) == "else" and k < end:
            stop = self._until(k, end, "{")
            k = self.pair[stop] + 1 if stop < end else end
        return k

    def _control(self, k: int, end: int, parent: int) -> int:
        kind, past = self.words[k], self._control_end(k, end)
        node = self._open(kind, "", k, parent)
        while k < past:
            stop = self._until(k, past, "{")
            head = k + 1
            if kind == "for":
                within = self._until(head, stop, "in")
                self._pattern(head, within, node)
                head = within + 1
            if self._word(head) == "if":  # else if
                head += 1
            if self._word(head) == "let":
                head = self._equals(head, stop) + 1
            self._expression(head, stop, node, literals=False)
            if stop >= past:
                break
            if kind == "match":
                self._arms(stop + 1, self.pair[stop], node)
            else:
                self._block(stop, node)
            k = self.pair[stop] + 1
        self._close(node, past - 1)
        return past

    def _arms(self, k: int, end: int, parent: int) -> None:
        while (k := self._attributes(k, end)) < end:
            arrow = self._until(k, end, "=>")
            node = self._open("arm", "", k, parent)
            body = arrow + 1
            past = self.pair[body] + 1 if self._word(body) == "{" else self._until(body, end, ",")
            if self._word(body) == "{" and past < end and self._word(past) in (".", "?"):
                past = self._until(past, end, ",")
            self._expression(body, past, node)
            self._close(node, max(past - 1, k))
            k = past + (self._word(past) == "," and past < end)

    def _closure(self, k: int, end: int, parent: int) -> int:
        node = self._open("closure", "", k, parent)
        stop = self._until(k + 1, end, "|")
        self._patterns(k + 1, stop, node, "param")
        body = stop + 1
        if self._word(body) == "->":
            body = self._until(body, end, "{")
        past = self.pair[body] + 1 if self._word(body) == "{" and body < end else self._until(body, end, ",", ";")
        self._expression(body, past, node)
        self._close(node, max(past - 1, k))
        return past

    def _after_operand(self, k: int, first: int) -> bool:
        w = self._word(k - 1) if k > first else ""
        return w in (")", "]", "}", "?", "await") or (bool(w) and (w[0].isalnum() or w[0] == "_") and w not in _NOT_NAMES)

    def _expression(self, k: int, end: int, parent: int, literals: bool = True) -> None:
        """Everything in a stretch of tokens that is an expression of the kinds above."""
        first = k
        while k < end:
            w, begun, made = self.words[k], k, len(self.rows)
            if w in _CONTROL and self._word(k - 1) != ".":
                k = self._control(k, end, parent)
            elif w == "{":
                k = self._block(k, parent)
            elif w in ("(", "["):
                repeat = w == "[" and self._until(k + 1, self.pair[k], ";") < self.pair[k]
                kind = "tuple" if w == "(" else "index" if self._after_operand(k, first) else "repeat" if repeat else "array"
                k = self._group(kind, "", k, k, parent)
            elif w == "|" and not self._after_operand(k, first):
                k = self._closure(k, end, parent)
            elif _is_name(w) and w not in _NOT_NAMES:
                k = self._named(k, end, parent, literals)
            elif w == "await" and self._word(k - 1) == ".":
                self._close(self._open("await", "", k, parent), k)
                k += 1
            else:
                k += 1
            if begun == first and k == end and len(self.rows) > made:
                self.rows[made][7] = True

    def _group(self, kind: str, text: str, first: int, opened: int, parent: int) -> int:
        node = self._open(kind, text, first, parent)
        self._expression(opened + 1, self.pair[opened], node)
        self._close(node, self.pair[opened])
        return self.pair[opened] + 1

    def _named(self, k: int, end: int, parent: int, literals: bool) -> int:
        """A path, and the call, macro or struct that it opens; `first` is where the path begins."""
        first, method = k, self._word(k - 1) == "."
        while self._word(k + 1) == "::" and k + 1 < end:
            if self._word(k + 2) == "<":
                depth, at = 1, k + 3
                while at < end and depth:
                    depth += (self.words[at] == "<") - (self.words[at] == ">" and self.words[at - 1] != "-")
                    at += 1
                if self._word(at) == "(" and at < end:
                    return self._group("method" if method else "call", self.words[k], first, at, parent)
                if self._word(at) != "::":
                    return at
                k = at - 1
            if not _is_name(self._word(k + 2)):
                return k + 2
            k += 2
        after, name = self._word(k + 1) if k + 1 < end else "", self.words[k]
        if after == "(":
            return self._group("method" if method else "call", name, first, k + 1, parent)
        if after == "!" and self._word(k + 2) in _CLOSE and k + 2 < end:
            return self._group("macro", name, first, k + 2, parent)
        if after == "{" and literals and (name[0].isupper() or first != k):
            return self._group("struct", name, first, k + 1, parent)
        if not method and after != ":":  # a field's name is none
            self._close(self._open("name", name, first, parent), k)
        return k + 1
