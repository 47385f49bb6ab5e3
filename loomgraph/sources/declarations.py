"""Declarations, references and file metadata of one Kotlin or Java source text."""

from __future__ import annotations

from dataclasses import dataclass, field

from loomgraph.sources.lexer import Token, closers, tokens

MODIFIERS = frozenset(
    "public private protected internal open abstract final sealed data enum annotation inner value inline override lateinit const suspend operator infix tailrec external "
    "companion expect actual vararg noinline crossinline reified static default native synchronized transient volatile strictfp non-sealed".split()
)
STARTERS = frozenset("class interface object fun val var typealias init constructor import package".split())
NOT_CALLS = frozenset("if for while when catch return throw try else do is as in fun class interface object constructor super this switch synchronized new assert".split())
PLATFORM = ("java.", "javax.", "kotlin.", "kotlinx.")
CONTEXT = 80


@dataclass
class Type:
    name: str
    kind: str
    at: int
    annotations: list[str] = field(default_factory=list)
    supertypes: list[str] = field(default_factory=list)
    modifiers: frozenset = frozenset()
    outer: str = ""
    companion: bool = False
    functions: list[tuple[str, int]] = field(default_factory=list)
    properties: list[tuple[str, int]] = field(default_factory=list)


class Source:
    """One parsed file: package, imports, types in order of appearance, top-level members and every function name."""

    def __init__(self, text: str, kotlin: bool):
        self.text, self.kotlin = text, kotlin
        self.ts = tokens(text, kotlin)
        self.close = closers(self.ts)
        self.package, self.imports = "", []
        self.types: list[Type] = []
        self.functions: list[tuple[str, int]] = []
        self.properties: list[tuple[str, int]] = []
        self.all_functions: list[str] = []
        self.super_calls: set[int] = set()
        self._body(0, len(self.ts), None)

    def _t(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def _name(self, i: int) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].kind == "name"

    def _dotted(self, i: int) -> tuple[str, int]:
        parts = [self._t(i)]
        i += 1
        while self._t(i) == "." and (self._name(i + 1) or self._t(i + 1) == "*"):
            parts.append(self._t(i + 1))
            i += 2
        return ".".join(parts), i

    def _angles(self, i: int) -> int:
        """Past a `<...>` that opens at i, if one does."""
        if self._t(i) != "<":
            return i
        depth = 0
        while i < len(self.ts):
            depth += (self._t(i) == "<") - (self._t(i) == ">")
            i += 1
            if not depth:
                break
        return i

    def _skip(self, i: int) -> int:
        return self.close.get(i, i) + 1

    def _body(self, i: int, end: int, owner: Type | None) -> None:
        modifiers, annotations = set(), []
        while i < end:
            t = self._t(i)
            if t == "@" and self._t(i + 1) != "interface":
                j = i + 1
                if self._t(j + 1) == ":" and self._t(j) in ("file", "get", "set", "field", "param", "property"):
                    j += 2
                name, j = self._dotted(j)
                annotations.append(name)
                i = self._skip(j) if self._t(j) == "(" else j
                continue
            if self.ts[i].kind == "name" and t in MODIFIERS and (self._name(i + 1) or self._t(i + 1) in "@<") and (t != "enum" or self._t(i + 1) == "class"):
                modifiers.add(t)
                i += 1
                continue
            if owner is None and t == "package":
                self.package, i = self._dotted(i + 1)
            elif owner is None and t == "import":
                static = self._t(i + 1) == "static"
                name, j = self._dotted(i + 1 + static)
                if not static:
                    self.imports.append((name, self.ts[i].at))
                i = j + 2 if self._t(j) == "as" else j
            elif t in ("class", "interface", "object", "enum", "record") and (self._name(i + 1) or t == "object") and (self.kotlin or self._name(i + 1)) and self._t(i - 1) != "::":
                i = self._type(i, end, t, modifiers, annotations, owner)
            elif self.kotlin and t == "fun" and self._t(i + 1) != "interface":
                i = self._function(i, end, owner)
            elif self.kotlin and t in ("val", "var"):
                i = self._property(i, end, owner)
            elif not self.kotlin and owner is not None:
                i = self._java_member(i, end, owner)
            elif t == "{":
                i = self._skip(i)
            else:
                i += 1
            modifiers, annotations = set(), []

    def _type(self, i: int, end: int, word: str, modifiers: set, annotations: list[str], owner: Type | None) -> int:
        named = self._name(i + 1)
        at = self.ts[i + 1].at if named else self.ts[i].at
        name = self._t(i + 1) if named and self._t(i + 1) not in ("{", ":") else "Companion"
        kind = "INTERFACE" if word == "interface" else "ENUM" if "enum" in modifiers or word == "enum" else "OBJECT" if word == "object" else "DATA_CLASS" if "data" in modifiers or word == "record" else "CLASS"
        outer = f"{owner.outer}{owner.name}." if owner else ""
        found = Type(name, kind, at, annotations, [], frozenset(modifiers), outer, word == "object" and "companion" in modifiers)
        self.types.append(found)
        i = self._angles(i + 1 + named)
        if self.kotlin:
            while self._t(i) in ("private", "internal", "protected", "public", "constructor", "@"):
                i = self._dotted(i + 1)[1] if self._t(i) == "@" else i + 1
            if self._t(i) == "(":
                i = self._skip(i)
            if self._t(i) == ":":
                i += 1
                while i < end and self._name(i):
                    name, i = self._dotted(i)
                    found.supertypes.append(name)
                    self.super_calls.add(self.ts[i - 1].at)
                    i = self._angles(i)
                    if self._t(i) == "(":
                        i = self._skip(i)
                    if self._t(i) == "by":
                        i = self._angles(self._dotted(i + 1)[1])
                        if self._t(i) == "(":
                            i = self._skip(i)
                        # a block that another block or a comma follows is the delegate's, not the body
                        if self._t(i) == "{" and self._t(self._skip(i)) in ("{", ","):
                            i = self._skip(i)
                    if self._t(i) != ",":
                        break
                    i += 1
        else:
            if self._t(i) == "(":
                i = self._skip(i)
            while i < end and self._t(i) not in ("{", ";"):
                if self._t(i) in ("extends", "implements"):
                    i += 1
                    while self._name(i):
                        name, i = self._dotted(i)
                        found.supertypes.append(name)
                        i = self._angles(i)
                        if self._t(i) != ",":
                            break
                        i += 1
                else:
                    i += 1
        if self._t(i) == "{":
            stop = self.close.get(i, end)
            inner = i + 1
            if kind == "ENUM":
                inner = self._entries(inner, stop, found)
            self._body(inner, stop, found)
            return stop + 1
        return i

    def _entries(self, i: int, end: int, owner: Type) -> int:
        """Enum entries are types of their own kind, named in their enum."""
        while i < end and self._name(i) and self._t(i) not in STARTERS and self._t(i) not in MODIFIERS:
            self.types.append(Type(self._t(i), "CLASS", self.ts[i].at, outer=f"{owner.outer}{owner.name}."))
            i += 1
            while self._t(i) in ("(", "{"):
                i = self._skip(i)
            if self._t(i) != ",":
                break
            i += 1
        return i + 1 if self._t(i) == ";" else i

    def _add(self, owner: Type | None, which: str, name: str, at: int) -> None:
        if which == "functions":
            self.all_functions.append(name)
        if owner is None or not owner.companion:
            getattr(owner or self, which).append((name, at))

    def _function(self, i: int, end: int, owner: Type | None) -> int:
        i = self._angles(i + 1)
        last = None
        while i < end and self._t(i) != "(":
            if self._name(i):
                last = i
            i = self._angles(i) if self._t(i) == "<" else i + 1
        if last is not None:
            self._add(owner, "functions", self._t(last), self.ts[last].at)
        return self._rest(self._skip(i), end)

    def _property(self, i: int, end: int, owner: Type | None) -> int:
        i = self._angles(i + 1)
        if self._t(i) == "(":
            return self._rest(self._skip(i), end)
        last = i
        while self._t(last + 1) == "." and self._name(last + 2):
            last += 2
        if self._name(last):
            self._add(owner, "properties", self._t(last), self.ts[last].at)
        return self._rest(last + 1, end)

    def _rest(self, i: int, end: int) -> int:
        """Past a body or an initialiser: to the next declaration that starts a line, or the end."""
        while i < end:
            t = self.ts[i]
            fresh = "\n" in self.text[self.ts[i - 1].at : t.at]
            if t.text == ";":
                return i + 1
            if t.text in ("(", "[", "{"):
                closed = self._skip(i)
                if t.text == "{" and self._t(i - 1) not in ("=", "by", "lazy", ")") or t.text == "{" and "\n" in self.text[self.ts[min(closed, len(self.ts)) - 1].at : self.ts[closed].at if closed < len(self.ts) else None]:
                    return closed
                i = closed
                continue
            if fresh and (t.text in STARTERS or t.text in MODIFIERS or t.text == "@"):
                return i
            i += 1
        return i

    def _java_member(self, i: int, end: int, owner: Type) -> int:
        last = None
        while i < end:
            t = self._t(i)
            if t == "(" and last is not None:
                self._add(owner, "functions", self._t(last), self.ts[last].at)
                i = self._skip(i)
                while i < end and self._t(i) not in ("{", ";"):
                    i += 1
                return self._skip(i) if self._t(i) == "{" else i + 1
            if t in ("=", ";", ",") and last is not None:
                self._add(owner, "properties", self._t(last), self.ts[last].at)
                last = None
                while i < end and self._t(i) not in (";", ","):
                    i = self._skip(i)
                if self._t(i) != ",":
                    return i + 1
            if t == "{":
                return self._skip(i)
            if self._name(i):
                last = i
            i = self._angles(i) if t == "<" else i + 1
        return i

    def line(self, at: int) -> int:
        return 1 + self.text.count("\n", 0, at)

    def qualified(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def symbols(self) -> list[tuple]:
        """(name, qualified_name, kind, line, package_name): types with their members, objects, then the file's own."""
        out = []
        plain = [t for t in self.types if t.kind != "OBJECT" or not self.kotlin]
        for t in plain:
            own = self.qualified(t.outer + t.name)
            out.append((t.name, own, t.kind, self.line(t.at), self.package))
            for kind, members in (("FUNCTION", t.functions), ("PROPERTY", t.properties)):
                out += [(f"{t.name}.{m}", f"{own}.{m}", kind, self.line(at), self.package) for m, at in members]
        out += [(t.name, self.qualified(t.outer + t.name), "OBJECT", self.line(t.at), self.package) for t in self.types if self.kotlin and t.kind == "OBJECT" and not t.companion]
        for kind, members in (("FUNCTION", self.functions), ("PROPERTY", self.properties)):
            out += [(m, self.qualified(m), kind, self.line(at), self.package) for m, at in members]
        return out

    def references(self) -> list[tuple]:
        """(target_name, target_qualified_name, kind, line, context, qualifier): imports, supertypes and, in Kotlin, calls."""
        known = {}
        for name, _ in self.imports:
            if not name.endswith("*"):
                known.setdefault(name.rpartition(".")[2], name)
        out = []
        for name, at in self.imports:
            path = name.removesuffix(".*")
            out.append((path.rpartition(".")[2], path, "IMPORT", self.line(at), f"import {name}", None))
        types = [t for t in self.types if t.kind != "OBJECT"] if self.kotlin else [t for t in self.types if not t.outer]
        for t in types:
            out += [(s.rpartition(".")[2], known.get(s.rpartition(".")[2]), "SUPERTYPE", self.line(t.at), s, None) for s in t.supertypes]
        if self.kotlin:
            out += [self._call(i, known) for i in self._calls()]
        return out

    def _calls(self) -> list[int]:
        heads = self.super_calls | {at for t in self.types for at in (t.at, *(a for _, a in t.functions))} | {at for _, at in self.functions}
        out = []
        for i, t in enumerate(self.ts[:-1]):
            if t.kind == "name" and t.text not in NOT_CALLS and self._t(i + 1) == "(" and t.at not in heads and self._t(i - 1) not in ("fun", "@", "class") and not (self._t(i - 1) == ":" and self._t(i - 3) == "@"):
                out.append(i)
        return out

    def _call(self, i: int, known: dict) -> tuple:
        t: Token = self.ts[i]
        stop = self.ts[self.close[i + 1]].at + 1 if i + 1 in self.close else len(self.text)
        kind = "CONSTRUCTOR" if t.text[0].isupper() else "CALL"
        behind = self._t(i - 1) in (".", "?.") and self._name(i - 2)
        return t.text, known.get(t.text), kind, self.line(t.at), self.text[t.at : stop][:CONTEXT], self._t(i - 2) if behind else None

    def metadata(self, file_name: str) -> tuple:
        """(package, qualified name, simple name, imports, annotations, supertypes, flags..., methods, line) of the file's one component."""
        first = next((t for t in self.types if t.kind != "OBJECT" and not t.outer), None) or next((t for t in self.types if t.kind == "OBJECT" and not t.companion), None)
        name = first.name if first else file_name.rpartition(".")[0]
        imports = [n for n, _ in self.imports if not n.startswith(PLATFORM)]
        methods = self.all_functions if self.kotlin else [m for m, _ in first.functions] if first else []
        kind = first.kind if first else ""
        return (
            self.package, self.qualified(name), name, imports, first.annotations if first else [], first.supertypes if first else [], kind == "INTERFACE",
            bool(first) and "abstract" in first.modifiers, kind == "OBJECT", kind == "DATA_CLASS", "KOTLIN" if self.kotlin else "JAVA", methods, self.line(first.at) if first else 1,
        )


def dependencies(text: str, excluded: frozenset = frozenset(), skipped: frozenset = frozenset()) -> list[tuple[str, str, str, str]]:
    """(scope, group, artifact, version) of build-script calls whose first argument is a coordinate of three parts or more."""
    ts, out = tokens(text), []
    for i, t in enumerate(ts[:-2]):
        if t.kind == "name" and ts[i + 1].text == "(" and ts[i + 2].kind == "string" and t.text not in excluded and t.text not in skipped:
            parts = ts[i + 2].text.strip('"').split(":")
            if len(parts) >= 3:
                out.append((t.text, *parts[:3]))
    return out
