"""Python sources, by the standard library's parser."""

from __future__ import annotations

import ast

from lodegraph.parse.facts import Facts, Import, Symbol, owner_at


def _name(node: ast.expr) -> str | None:
    if isinstance(node, ast.Subscript):
        node = node.value
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


class Python:
    def parse(self, path: str, source: str) -> Facts:
        tree, lines = ast.parse(source), source.split("\n")
        public = self._all(tree)
        out = Facts()

        def add(name: str, kind: str, node, signature="", extends=None, implements=()):
            start = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            exported = name in public if public is not None else not name.startswith("_")
            out.symbols.append(Symbol(name, kind, start, node.end_lineno, exported, "\n".join(lines[start - 1 : node.end_lineno]), signature, False, extends, list(implements)))

        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                add(node.name, "function", node, f"({ast.unparse(node.args)}){result}")
            elif isinstance(node, ast.ClassDef):
                bases = [b for b in map(_name, node.bases) if b]
                add(node.name, "class", node, "", bases[0] if bases else None, bases[1:])
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    for leaf in target.elts if isinstance(target, (ast.Tuple, ast.List)) else [target]:
                        if isinstance(leaf, ast.Name) and leaf.id != "__all__":
                            add(leaf.id, "variable", node)
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    out.imports.append(Import(a.name, "namespace", [("*", a.asname or a.name.partition(".")[0])], node.lineno))
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                star = any(a.name == "*" for a in node.names)
                out.imports.append(Import(module, "namespace" if star else "named", [(a.name, a.asname or a.name) for a in node.names], node.lineno))
            elif isinstance(node, ast.Call) and (name := _name(node.func)):
                out.calls.append((name, node.lineno, owner_at(out.symbols, node.lineno)))
        typed = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = node.args
                typed += [a.annotation for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg] if a and a.annotation]
                typed += [node.returns] if node.returns else []
            elif isinstance(node, ast.AnnAssign):
                typed.append(node.annotation)
            elif isinstance(node, ast.ClassDef):
                typed += node.bases
            typed += getattr(node, "decorator_list", [])
        seen = set()
        for t in typed:
            for leaf in ast.walk(t):
                if isinstance(leaf, ast.Name) and (leaf.id, leaf.lineno, leaf.col_offset) not in seen:
                    seen.add((leaf.id, leaf.lineno, leaf.col_offset))
                    out.refs.append((leaf.id, leaf.lineno, owner_at(out.symbols, leaf.lineno)))
        return out

    @staticmethod
    def _all(tree: ast.Module) -> set[str] | None:
        for node in tree.body:
            if isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                return {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
        return None
