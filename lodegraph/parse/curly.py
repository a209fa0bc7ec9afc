"""TypeScript, JavaScript, Go and Java, from their tokens: top-level declarations, imports, calls and type names."""

from __future__ import annotations

import re
from typing import NamedTuple

from lodegraph.parse.facts import Facts, Import, Symbol, owner_at

LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<id>[^\W\d][\w$]*|[$@#][\w$]+)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|:=|<-|.)",
    re.S,
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Words that stand before a parenthesis without being called
NOT_CALLED = {"if", "for", "while", "switch", "catch", "return", "function", "func", "typeof", "await", "require", "import", "super", "new", "throw", "in", "of", "instanceof", "case", "do", "else", "range", "go", "defer", "select", "var", "const", "type", "struct", "interface", "synchronized", "try", "this", "async", "yield", "void", "delete", "constructor"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int


def lex(source: str) -> list[Token]:
    out, line = [], 1
    for m in LEX.finditer(source):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], line, m.start(), m.end()))
        line += m[0].count("\n")
    return out


def closing(t: list[Token], i: int) -> int:
    """Index of the token that closes the bracket at i; the last token where none does."""
    depth = 0
    for k in range(i, len(t)):
        if t[k].kind == "op":
            depth += (t[k].text in OPEN) - (t[k].text in CLOSE)
            if not depth:
                return k
    return len(t) - 1


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class Curly:
    """What the languages share: walk the top level, then all calls and types."""

    def parse(self, path: str, source: str) -> Facts:
        t, out = lex(source), Facts()
        i = 0
        while i < len(t):
            i = max(i + 1, self.top(source, t, i, out))
        classes = self.class_bodies(t)
        for k, x in enumerate(t[:-1]):
            if x.kind == "id" and t[k + 1].text == "(" and x.text not in NOT_CALLED and not self.declares(t, k, classes):
                out.calls.append((x.text, x.line, owner_at(out.symbols, x.line)))
        out.refs = [(n, line, owner_at(out.symbols, line)) for n, line in self.types(t)]
        return out

    def class_bodies(self, t: list[Token]) -> list[tuple[int, int]]:
        out = []
        for k, x in enumerate(t):
            if x.text in ("class", "interface", "enum") and (k == 0 or t[k - 1].text != "."):
                body = next((j for j in range(k, min(len(t), k + 200)) if t[j].text in "{;"), None)
                if body is not None and t[body].text == "{":
                    out.append((body, closing(t, body)))
        return out

    def declares(self, t, k, classes) -> bool:
        """Whether the name before a parenthesis is being declared: after function, func or new, or as a class member."""
        before = t[k - 1].text if k else ""
        if before in ("function", "func", "new", "*"):
            return True
        after = closing(t, k + 1) + 1
        for a, b in classes:
            if a < k < b and self.depth(t, a, k) == 1 and before not in (".", "=", "return", "?.") and after < len(t) and t[after].text in ("{", ":", ";", "throws"):
                return t[after].text in ("{", ":", "throws") or before not in ("=", ",", "(")
        return False

    @staticmethod
    def depth(t, a, k) -> int:
        return sum((x.text in OPEN) - (x.text in CLOSE) for x in t[a:k] if x.kind == "op")

    def symbol(self, source, t, first, last, name, kind, exported, **more) -> Symbol:
        return Symbol(name, kind, t[first].line, t[last].line + t[last].text.count("\n"), exported, source[t[first].start : t[last].end], **more)


class Script(Curly):
    """TypeScript and JavaScript."""

    DECLARE = {"function", "class", "interface", "type", "const", "let", "var"}

    def top(self, source, t, i, out) -> int:
        first, exported, default = i, False, False
        while i < len(t) and t[i].text in ("export", "default", "declare", "abstract", "async"):
            exported, default = exported or t[i].text == "export", default or t[i].text == "default"
            i += 1
        if i >= len(t):
            return i
        word = t[i].text
        if word == "import" and not exported and i + 1 < len(t) and t[i + 1].text not in ("(", "."):
            return self.imported(t, i, out)
        if exported and word == "{":
            end = closing(t, i)
            if not (end + 1 < len(t) and t[end + 1].text == "from"):
                k = i + 1
                while k < end:
                    if t[k].kind == "id" and t[k].text != "type":
                        out.symbols.append(self.symbol(source, t, first, end, t[k].text, "variable", True))
                        k += 2 if t[k + 1].text == "as" else 0
                    k += 1
            return end + 1
        if word not in self.DECLARE or (word == "type" and t[i + 1].kind != "id"):
            return self.statement_end(t, i) + 1
        if word in ("const", "let", "var"):
            end = self.statement_end(t, i)
            self.variables(source, t, first, i + 1, end, exported, out)
            return end + 1
        k = i + 1 + (t[i + 1].text == "*")
        name = t[k].text if t[k].kind == "id" else "default"
        if word == "function":
            p = next(j for j in range(k, len(t)) if t[j].text == "(")
            close = closing(t, p)
            body = self.body(t, close + 1)
            end = closing(t, body) if body is not None else self.statement_end(t, close)
            tail = source[t[close].end : t[body].start] if body is not None else ""
            out.symbols.append(self.symbol(source, t, first, end, name, self.function_kind(name), exported, default=default, signature=squeeze(source[t[p].start : t[close].end] + tail)))
            return end + 1
        if word == "type":
            end = self.statement_end(t, i)
            out.symbols.append(self.symbol(source, t, first, end, name, "type", exported, default=default))
            return end + 1
        body = next((j for j in range(k, len(t)) if t[j].text == "{"), len(t) - 1)
        end = closing(t, body)
        extends, implements = self.heritage(t, k + 1, body)
        kind = "type" if word == "interface" else "component" if name[:1].isupper() else "class"
        out.symbols.append(self.symbol(source, t, first, end, name, kind, exported, default=default, extends=extends, implements=implements))
        return end + 1

    @staticmethod
    def function_kind(name: str) -> str:
        return "hook" if re.match(r"use[A-Z]", name) else "component" if re.match(r"[A-Z]", name) else "function"

    @staticmethod
    def body(t, i) -> int | None:
        """The brace that opens a function's body, after a return type that may hold braces itself."""
        if i < len(t) and t[i].text == ":":
            i += 1
            if t[i].text == "{":
                i = closing(t, i) + 1
        while i < len(t) and t[i].text not in ("{", ";"):
            i = closing(t, i) + 1 if t[i].text in OPEN else i + 1
        return i if i < len(t) and t[i].text == "{" else None

    @staticmethod
    def statement_end(t, i) -> int:
        k = i
        while k < len(t):
            if t[k].text in OPEN and t[k].kind == "op":
                k = closing(t, k)
            elif t[k].text == ";":
                return k
            if k + 1 >= len(t):
                return k
            a, b = t[k], t[k + 1]
            if b.line > a.line + a.text.count("\n") and (a.kind != "op" or a.text in CLOSE) and (b.kind != "op" or b.text in ("{", "@")) and b.text not in ("instanceof", "in", "as", "extends", "of"):
                return k
            if b.kind == "op" and b.text in CLOSE:
                return k
            k += 1
        return len(t) - 1

    def variables(self, source, t, first, i, end, exported, out) -> None:
        k = i
        while k <= end:
            if t[k].kind == "id":
                value = k + 1
                while value <= end and t[value].text not in ("=", ","):
                    value = closing(t, value) + 1 if t[value].text in OPEN else value + 1
                kind, signature = "variable", ""
                if value < end and t[value].text == "=":
                    v = value + 1 + (t[value + 1].text == "async")
                    if t[v].text == "function":
                        v = next((j for j in range(v, end) if t[j].text == "("), v)
                        kind, signature = self.function_kind(t[k].text), squeeze(source[t[v].start : t[closing(t, v)].end])
                    elif t[v].text in ("(", "<") or (t[v].kind == "id" and v < end and t[v + 1].text == "=>"):
                        p = v if t[v].text != "<" else next((j for j in range(v, end) if t[j].text == "("), v)
                        close = closing(t, p) if t[p].text == "(" else p
                        arrow = next((j for j in range(close, min(end, close + 60)) if t[j].text in ("=>", "{", ";", ",")), None)
                        if arrow is not None and t[arrow].text == "=>":
                            kind, signature = self.function_kind(t[k].text), squeeze(source[t[p].start : t[arrow].start])
                out.symbols.append(self.symbol(source, t, first, end, t[k].text, kind, exported, signature=signature))
                if value + 1 <= end and t[value].text == "=" and t[value + 1].text == "require":
                    out.imports.append(Import(t[value + 3].text[1:-1], "require", [("default", t[k].text)], t[k].line))
                while value <= end and t[value].text != ",":
                    value = closing(t, value) + 1 if t[value].text in OPEN else value + 1
                k = value + 1
            elif t[k].text == "{" and k == i:
                close = closing(t, k)
                if close + 2 <= end and t[close + 2].text == "require":
                    names = [x.text for x in t[k:close] if x.kind == "id"]
                    out.imports.append(Import(t[close + 4].text[1:-1], "require", [(n, n) for n in names], t[k].line))
                return
            else:
                return

    @staticmethod
    def heritage(t, i, body) -> tuple[str | None, list[str]]:
        extends, implements, mode, depth = None, [], "", 0
        for k in range(i, body):
            x = t[k]
            depth += (x.text == "<") - (x.text == ">")
            if x.text in ("extends", "implements") and not depth:
                mode = x.text
            elif x.kind == "id" and not depth and mode and (t[k - 1].text in ("extends", "implements", ",")):
                if mode == "extends" and extends is None:
                    extends = x.text
                elif mode == "implements":
                    implements.append(x.text)
        return extends, implements

    @staticmethod
    def imported(t, i, out) -> int:
        end = next((j for j in range(i, len(t)) if t[j].kind == "str"), len(t) - 1)
        names, kind, k = [], "side-effect", i + 1 + (t[i + 1].text == "type")
        if t[k].kind == "id" and t[k].text != "from":
            names.append(("default", t[k].text))
            kind, k = "default", k + 1
        while k < end:
            if t[k].text == "*":
                names.append(("*", t[k + 2].text))
                kind, k = "namespace", k + 3
            elif t[k].text == "{":
                close, k = closing(t, k), k + 1
                kind = "named"
                while k < close:
                    if t[k].kind == "id" and not (t[k].text == "type" and t[k + 1].kind == "id" and t[k + 1].text != "as"):
                        renamed = t[k + 1].text == "as"
                        names.append((t[k].text, t[k + 2].text if renamed else t[k].text))
                        k += 2 * renamed
                    k += 1
            k += 1
        out.imports.append(Import(t[end].text[1:-1], kind, names, t[i].line))
        return end + 1

    def types(self, t):
        for k, x in enumerate(t):
            if x.kind != "id" or k == 0:
                continue
            before, after = t[k - 1].text, t[k + 1].text if k + 1 < len(t) else ""
            typed = before in ("class", "interface", "extends", "implements", "as", "keyof") or (before == "type" and after in ("=", "<"))
            typed = typed or (x.text[:1].isupper() and before in (":", "<", "|", "&", ",") and after in (")", ",", ";", "=", "{", ">", "[", "|", "&", "<", "=>", "/", "]") and (before != "," or after in (">", ",", "{")))
            if typed or (before == "<" and x.text[:1].isupper()):
                yield x.text, x.line


class Go(Curly):
    def declares(self, t, k, classes) -> bool:
        if super().declares(t, k, classes) or any(a < k < b and self.depth(t, a, k) == 1 for a, b in classes):
            return True
        line = next((x for x in t[max(0, k - 12) : k] if x.line == t[k].line), t[k])
        return line.text == "func" and t[k - 1].text == ")" and self.depth(t, next(j for j in range(k, -1, -1) if t[j].text == "func"), k) == 0

    @staticmethod
    def public(name: str) -> bool:
        return name[:1].isupper()

    def top(self, source, t, i, out) -> int:
        word = t[i].text
        if word == "import":
            group = t[i + 1].text == "("
            end = closing(t, i + 1) if group else next(j for j in range(i, len(t)) if t[j].kind == "str")
            for k in range(i + 1, end + 1):
                if t[k].kind == "str":
                    alias, path = t[k - 1], t[k].text.strip("\"`")
                    named = alias.kind == "id" and alias.text not in ("import", "_") and alias.line == t[k].line
                    dotted = alias.text in (".", "_") and alias.line == t[k].line
                    local = alias.text if named else path.rpartition("/")[2]
                    out.imports.append(Import(path, "namespace" if dotted else "named", [("*" if dotted else path.rpartition("/")[2], local)], t[k].line))
            return end + 1
        if word == "func":
            receiver = t[i + 1].text == "("
            k = closing(t, i + 1) + 1 if receiver else i + 1
            p = next(j for j in range(k, len(t)) if t[j].text == "(")
            body = closing(t, p) + 1
            while body < len(t) and t[body].text != "{" and t[body].line == t[body - 1].line:
                body = closing(t, body) + 1 if t[body].text in ("(", "[") else body + 1
            if body < len(t) and t[body].text == "{" and t[body - 1].text in ("interface", "struct"):
                body = next((j for j in range(closing(t, body) + 1, len(t)) if t[j].text == "{"), len(t) - 1)
            has = body < len(t) and t[body].text == "{"
            end = closing(t, body) if has else body - 1
            head = (source[t[i + 1].start : t[k - 1].end] + " " if receiver else "") + source[t[p].start : t[body - 1].end]
            out.symbols.append(self.symbol(source, t, i, end, t[k].text, "method" if receiver else "function", self.public(t[k].text), signature=squeeze(head)))
            return end + 1
        if word in ("type", "const", "var"):
            group = t[i + 1].text == "("
            end = closing(t, i + 1) if group else self.line_end(t, i)
            k = i + 2 if group else i + 1
            while k < end or (k == end and not group):
                last = self.line_end(t, k)
                last = min(last, end - 1) if group else end
                names = [k]
                while word != "type" and t[names[-1] + 1].text == ",":
                    names.append(names[-1] + 2)
                for n in names:
                    struct = word == "type" and any(t[j].text == "struct" for j in range(n + 1, min(n + 3, len(t))))
                    kind = "variable" if word != "type" else "class" if struct else "type"
                    if t[n].kind == "id" and t[n].text != "_":
                        out.symbols.append(self.symbol(source, t, k if group else i, last, t[n].text, kind, self.public(t[n].text)))
                k = last + 1
            return end + 1
        return self.line_end(t, i) + 1

    @staticmethod
    def line_end(t, i) -> int:
        k = i
        while k < len(t):
            if t[k].text in OPEN and t[k].kind == "op":
                k = closing(t, k)
            if k + 1 >= len(t) or t[k + 1].line > t[k].line + t[k].text.count("\n"):
                return k
            k += 1
        return len(t) - 1

    def types(self, t):
        seen = set()
        for k, x in enumerate(t[1:], 1):
            before, after = t[k - 1], t[k + 1].text if k + 1 < len(t) else ""
            typed = x.kind == "id" and after not in ("(", ".", ":=") and (before.kind == "id" and before.text not in ("package", "return", "func", "import", "range", "const", "var", "case", "go", "defer") and before.line == x.line or before.text in ("*", "]", "&") or (before.text == "." and x.text[:1].isupper() and after != "("))
            if typed and x.text not in ("struct", "interface", "func", "map", "chan", "range") and (x.text, x.line) not in seen:
                seen.add((x.text, x.line))
                yield x.text, x.line


class Java(Curly):
    MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "default", "synchronized", "native", "transient", "volatile", "strictfp", "sealed"}

    def top(self, source, t, i, out) -> int:
        if t[i].text == "import":
            end = next((j for j in range(i, len(t)) if t[j].text == ";"), len(t) - 1)
            path = "".join(x.text for x in t[i + 1 : end] if x.text != "static")
            last = path.rpartition(".")[2]
            out.imports.append(Import(path.removesuffix(".*"), "namespace" if last == "*" else "named", [(last, last)], t[i].line))
            return end + 1
        first, k, words = i, i, set()
        while k < len(t) and (t[k].text in self.MODIFIERS or t[k].text.startswith("@")):
            words.add(t[k].text)
            k = closing(t, k + 1) + 1 if t[k].text.startswith("@") and k + 1 < len(t) and t[k + 1].text == "(" else k + 1
        if k + 1 < len(t) and t[k].text in ("class", "interface", "enum", "record"):
            body = next((j for j in range(k, len(t)) if t[j].text == "{"), len(t) - 1)
            end = closing(t, body)
            extends, implements = self.parents(t, k + 2, body)
            if t[k].text == "interface" and extends is None and implements:
                extends, implements = implements[0], implements[1:]
            kind = "type" if t[k].text == "interface" else "class"
            out.symbols.append(self.symbol(source, t, first, end, t[k + 1].text, kind, "public" in words, extends=extends, implements=implements))
            self.members(source, t, body + 1, end, out)
            return end + 1
        return next((j for j in range(i, len(t)) if t[j].text == ";"), len(t) - 1) + 1

    @staticmethod
    def parents(t, i, body) -> tuple[str | None, list[str]]:
        lists: dict[str, list[str]] = {"extends": [], "implements": []}
        mode, depth = "", 0
        for k in range(i, body):
            depth += (t[k].text == "<") - (t[k].text == ">")
            if t[k].text in lists:
                mode = t[k].text
            elif mode and t[k].kind == "id" and not depth and t[k + 1].text != ".":
                lists[mode].append(t[k].text)
        return (lists["extends"] or [None])[0], lists["extends"][1:] + lists["implements"]

    def members(self, source, t, i, end, out) -> None:
        while i < end:
            first, words = i, set()
            while i < end and (t[i].text in self.MODIFIERS or t[i].text.startswith("@")):
                words.add(t[i].text)
                i = closing(t, i + 1) + 1 if t[i].text.startswith("@") and t[i + 1].text == "(" else i + 1
            k = i
            while k < end and t[k].text not in ("(", "=", ";", "{"):
                k += 1
            if k >= end:
                return
            if t[k].text == "(":
                close = closing(t, k)
                stop = next((j for j in range(close, end) if t[j].text in ("{", ";")), end - 1)
                last = closing(t, stop) if t[stop].text == "{" else stop
                if k - i >= 2:  # a constructor has no type before its name
                    out.symbols.append(self.symbol(source, t, first, last, t[k - 1].text, "method", "public" in words, signature=squeeze(source[t[k].start : t[close].end])))
                i = last + 1
            elif t[k].text == "{":
                i = closing(t, k) + 1
            else:
                last = next((j for j in self.flat(t, k, end) if t[j].text == ";"), end - 1)
                names = [k - 1] + [j + 1 for j in self.flat(t, k, last) if t[j].text == "," and t[j + 1].kind == "id"]
                for n in names:
                    if t[n].kind == "id" and k - i >= 2:
                        out.symbols.append(self.symbol(source, t, first, last, t[n].text, "variable", "public" in words))
                i = last + 1

    @staticmethod
    def flat(t, i, end):
        while i < end:
            if t[i].text in OPEN and t[i].kind == "op":
                i = closing(t, i)
            yield i
            i += 1

    def types(self, t):
        seen = set()
        for k, x in enumerate(t[1:], 1):
            after = t[k + 1].text if k + 1 < len(t) else ""
            if x.kind == "id" and x.text[:1].isupper() and t[k - 1].text not in (".", "import", "package") and after not in ("(", ".") and (x.text, x.line) not in seen:
                seen.add((x.text, x.line))
                yield x.text, x.line
