"""C# sources: tokens, then declarations by their nesting. Statements within bodies are skipped by matching brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the language that a declaration may begin with, and its kinds of types.
MODIFIERS = set("public private protected internal static virtual override abstract async sealed readonly const new partial extern unsafe volatile required file ref fixed".split())
KINDS = ("class", "struct", "interface", "enum", "record")
TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*)|(?P<text>\$*@?\$*"|'(?:\\.|[^'\\\n])*')|(?P<name>@?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|.)""", re.S | re.M
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")


@dataclass
class Type:
    name: str
    namespace: str
    kind: str
    parent: str | None
    start: int
    end: int = 0
    partial: bool = False
    methods: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)


def _string_end(text: str, at: int, opening: str) -> int:
    """Where the string that ``opening`` begins at ``at`` ends: plain, verbatim, raw, each perhaps with holes, in which strings may stand."""
    quote = at + len(opening) - 1
    raw = re.compile('"{3,}').match(text, quote)
    if raw and "@" not in opening:
        end = text.find(raw[0], raw.end())
        while 0 <= end and text.startswith('"', end + len(raw[0])):
            end += 1
        return len(text) if end < 0 else end + len(raw[0])
    at, verbatim, holes = quote + 1, "@" in opening, "$" in opening
    while at < len(text):
        c = text[at]
        if c == '"':
            if not verbatim or not text.startswith('"', at + 1):
                return at + 1
            at += 2
        elif c == "\\" and not verbatim:
            at += 2
        elif c == "\n" and not verbatim:
            return at  # not closed on its line
        elif c == "{" and holes:
            at = at + 2 if text.startswith("{", at + 1) else _hole_end(text, at + 1)
        else:
            at += 1
    return at


def _hole_end(text: str, at: int) -> int:
    depth = 1
    while at < len(text) and depth:
        m = TOKEN.match(text, at)
        if m["text"] and m["text"].endswith('"'):
            at = _string_end(text, at, m["text"])
            continue
        depth += (m[0] == "{") - (m[0] == "}")
        at = m.end()
    return at


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, where it begins); comments, directives and white space are left out, strings and characters are ``""``."""
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        end = m.end()
        if m["text"]:
            out.append(('""', at))
            if m["text"].endswith('"'):
                end = max(_string_end(text, at, m["text"]), end)
        elif not m["skip"]:
            out.append((m[0], at))
        at = end
    return out


class _Reader:
    def __init__(self, text: str):
        self.toks, self.found = tokens(text), []
        self.toks.append(("", len(text)))

    def word(self, i: int) -> str:
        return self.toks[min(i, len(self.toks) - 1)][0]

    def behind(self, i: int) -> int:
        """Behind the bracket that closes the one at ``i``."""
        depth = 0
        while i < len(self.toks) - 1:
            depth += (self.word(i) in OPEN) - (self.word(i) in CLOSE)
            i += 1
            if not depth:
                break
        return i

    def generic(self, i: int) -> int:
        """Behind type arguments, if there are any at ``i``."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.toks) - 1:
            depth += (self.word(i) == "<") - (self.word(i) == ">")
            i = self.behind(i) if self.word(i) in OPEN else i + 1
            if not depth:
                break
        return i

    def type_end(self, i: int) -> int:
        """Behind the type at ``i``: a tuple, or names with arguments; then marks of arrays, pointers and nulls."""
        if self.word(i) == "(":
            i = self.behind(i)
        else:
            while self._is_name(i):
                i = self.generic(i + 1)
                if self.word(i) not in (".", "::"):
                    break
                i += 1
        while self.word(i) in ("?", "*") or (self.word(i) == "[" and self.word(i + 1) in ("]", ",")):
            i = self.behind(i) if self.word(i) == "[" else i + 1
        return i

    def _is_name(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and (w[0].isalpha() or w[0] in "_@")

    def statement_end(self, i: int) -> int:
        """Behind the next ``;`` outside brackets."""
        while i < len(self.toks) - 1 and self.word(i) not in (";", "}"):
            i = self.behind(i) if self.word(i) in OPEN else i + 1
        return i + (self.word(i) == ";")

    def declarations(self, i: int, space: str, owner: Type | None) -> int:
        """Reads declarations up to the ``}`` that ends them, or the end."""
        while i < len(self.toks) - 1 and self.word(i) != "}":
            i = self.declaration(i, space, owner)
            if isinstance(i, tuple):  # a namespace for the rest of the file
                i, space = i
        return i

    def declaration(self, i: int, space: str, owner: Type | None):
        while self.word(i) == "[":  # attributes
            i = self.behind(i)
        begin, said = i, set()
        while self.word(i) in MODIFIERS:
            said.add(self.word(i))
            i += 1
        w = self.word(i)
        if w == "namespace":
            end = self.type_end(i + 1)
            name = "".join(self.word(k) for k in range(i + 1, end))
            name = f"{space}.{name}" if space else name
            if self.word(end) == "{":
                return self.declarations(end + 1, name, None) + 1
            return end + 1, name
        if w in KINDS and self._is_name(i + 1) and (w != "record" or self.word(i + 2) in ("(", "{", ":", ";", "<") or self.word(i + 1) in KINDS):
            return self.type_declaration(i, begin, space, "partial" in said)
        if w in ("delegate", "event", "using", "extern", "global", "~", "implicit", "explicit"):
            i = self.skipped_head(i)
        elif owner is None or not w or not (self._is_name(i) or w == "("):
            i = self.skipped_head(i) if w not in OPEN else self.behind(i)
        else:
            i = self.member(i, owner)
        return max(i, begin + 1)

    def skipped_head(self, i: int) -> int:
        """Behind a declaration that has no members of interest: its body, or its ``;``."""
        while i < len(self.toks) - 1 and self.word(i) not in (";", "{", "}", "=>", "="):
            i = self.behind(i) if self.word(i) in OPEN else i + 1
        if self.word(i) == "{":
            i = self.behind(i)
            return self.statement_end(i + 1) if self.word(i) == "=" else i
        return i if self.word(i) == "}" else self.statement_end(i)

    def type_declaration(self, i: int, begin: int, space: str, partial: bool) -> int:
        kind = self.word(i)
        i += 2 if kind == "record" and self.word(i + 1) in ("class", "struct") else 1
        one = Type(self.word(i), space, kind, None, self.toks[begin][1], partial=partial)
        self.found.append(one)
        i = self.generic(i + 1)
        if self.word(i) == "(":
            i = self.behind(i)
        if self.word(i) == ":":
            end = self.type_end(i + 1)
            one.parent = "".join(self.word(k) for k in range(i + 1, end)) or None
            i = end
        while i < len(self.toks) - 1 and self.word(i) not in ("{", ";", "}"):
            i = self.behind(i) if self.word(i) in ("(", "[") else i + 1
        if self.word(i) == "{":
            i = self.behind(i) - 1 if kind == "enum" else self.declarations(i + 1, space, one)
        i += self.word(i) in ("}", ";")
        one.end = self.toks[i - 1][1] + 1
        return i

    def member(self, i: int, owner: Type) -> int:
        end = self.type_end(i)
        name = end
        while self.word(name + 1) in (".", "::") or (self.word(name + 1) == "<" and self.word(self.generic(name + 1)) == "."):  # an interface's member
            name = self.generic(name + 1) + 1
        if end > i and self._is_name(name) and self.word(name) not in ("operator", "this"):
            after = self.generic(name + 1)
            if self.word(after) == "(":
                owner.methods.append(self.word(name))
            elif self.word(after) in ("=", ";", ",") or (self.word(after) == "[" and self.word(after - 1) != "this"):
                return self.variables(name, owner)
        return self.skipped_head(i)

    def variables(self, i: int, owner: Type) -> int:
        while True:
            owner.fields.append(self.word(i))
            i += 1
            while i < len(self.toks) - 1 and self.word(i) not in (",", ";", "}"):
                i = self.generic(i) if self.word(i) == "<" and self._arguments(i) else self.behind(i) if self.word(i) in OPEN else i + 1
            if self.word(i) != ",":
                return i + (self.word(i) == ";")
            i += 1

    def _arguments(self, i: int) -> bool:
        """Whether ``<`` at ``i`` opens type arguments rather than compares: names, commas and the like up to its ``>``, and a bracket or dot behind."""
        end = self.generic(i)
        inside = all(self._is_name(k) or self.word(k) in ("<", ">", ",", ".", "?", "[", "]", "(", ")") for k in range(i, end))
        return inside and self.word(end) in ("(", ".", "{", "[")


def types(text: str) -> list[Type]:
    """All types of a source, outer ones before those within them."""
    reader = _Reader(text)
    i = 0
    while i < len(reader.toks) - 1:  # a ``}`` too many ends nothing
        i = reader.declarations(i, "", None) + 1
    return reader.found


TYPE = "name string, namespace string, kind string, parent string, methods array<string>, fields array<string>, partial boolean, file_path string, body string, start_line int, end_line int"


def csharp_types(files: DataFrame, roots: tuple[str, ...] = (), path_col: str = "rel_path", text_col: str = "text") -> DataFrame:
    """A row for each class, struct, interface, enum and record of ``files``, nested ones too; only of namespaces below ``roots``, if given. ``parent`` is the first type behind the colon. Null texts have none."""
    import pyarrow as pa

    shape = [(c.split(" ")[0], c.split(" ")[1]) for c in TYPE.split(", ")]
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines = [m.start() for m in re.finditer("\n", text or "")]
                for t in types(text or ""):
                    if not roots or t.namespace.split(".")[0] in roots:
                        rows.append((t.name, t.namespace, t.kind, t.parent, t.methods, t.fields, t.partial, path, text[t.start : t.end], bisect_right(lines, t.start) + 1, bisect_right(lines, t.end - 1) + 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(shape)], [n for n, _ in shape])

    return files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInArrow(run, TYPE)


def whole_types(found: DataFrame) -> DataFrame:
    """``csharp_types`` with the parts of a partial type as one: members in the order of files and lines, the first parent that a part names."""
    key = F.when(F.col("partial"), F.lit("")).otherwise(F.concat_ws(":", "file_path", F.col("start_line").cast("string"), "name"))
    parts = found.groupBy("namespace", "name", "kind", key.alias("_one")).agg(F.sort_array(F.collect_list(F.struct("file_path", "start_line", "parent", "methods", "fields"))).alias("p"))
    joined = lambda c: F.flatten(F.transform("p", lambda x: x[c]))
    parents = F.filter(F.transform("p", lambda x: x["parent"]), lambda x: x.isNotNull())
    return parts.select("name", "namespace", "kind", F.get(parents, F.lit(0)).alias("parent"), joined("methods").alias("methods"), joined("fields").alias("fields"), F.size("p").alias("parts"))


def type_blob(kind: Column, namespace: Column, name: Column, parent: Column, methods: Column, fields: Column) -> Column:
    """A type as text to embed: its signature, its methods, its fields, a line each."""
    head = F.concat(kind, F.lit(" "), namespace, F.lit("."), name, F.coalesce(F.concat(F.lit(" : "), parent), F.lit("")))
    return F.concat_ws("\n", head, F.concat(F.lit("methods: "), F.array_join(methods, ", ")), F.concat(F.lit("fields: "), F.array_join(fields, ", ")))
