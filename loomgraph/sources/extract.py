"""Facts of source files: symbols and unresolved observations.

``extract`` runs one Python function per file (Arrow batches, no shuffle) and gives
arrays of facts; ``tables`` explodes them.  Python is read with its own ``ast``;
the JavaScript family and the languages of ``LANGUAGE_RULES`` are scanned with
regular expressions over a copy of the source whose comments and strings are blanked
(an approximation: see the README).  The others yield their file symbol only; their
facts can be supplied as tables.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "id:string,semantic_key:string,language:string,kind:string,name:string,qualified_name:string,file:string,start_byte:bigint,end_byte:bigint,start_line:bigint,end_line:bigint"
SCHEMAS = {
    "symbols": SYMBOL,
    "references": "ref_id:string,file:string,source_id:string,target_name:string,binding_name:string,target_file_hint:string,kind:string,provenance:string,confidence:double,explanation:string,evidence_file:string,evidence_line:bigint",
    "calls": "call_id:string,file:string,caller_id:string,fallback_caller_id:string,callee_name:string,receiver_binding:string,receiver_type:string,receiver_call_start_byte:bigint,target_file_hint:string,provenance:string,confidence:double,explanation:string,resolvable:boolean,evidence_file:string,evidence_line:bigint,start_byte:bigint",
    "events": "event_id:string,file:string,owner_id:string,receiver:string,channel:string,action:string,callback_name:string,evidence_file:string,evidence_line:bigint",
    "returns": "owner_id:string,file:string,type_name:string",
    "routers": "file:string,name:string,prefix:string,application:boolean",
    "mounts": "file:string,parent:string,child:string,child_hint:string,prefix:string,line:bigint",
    "routes": "file:string,router:string,verb:string,path:string,handler_id:string,start_byte:bigint,end_byte:bigint,line:bigint,end_line:bigint",
    "formals": "owner_id:string,formal_name:string,parameter_index:bigint",
    "arguments": "file:string,caller_id:string,callee_name:string,argument_index:bigint,formal_name:string,target_name:string,line:bigint,call_start_byte:bigint",
    "invocations": "owner_id:string,parameter_index:bigint",
    "delegations": "owner_id:string,parameter_index:bigint,file:string,call_start_byte:bigint,argument_index:bigint",
    "includes": "file:string,include:string,quoted:boolean,line:bigint",
}
FACTS = ", ".join(f"`{name}` array<struct<{own}>>" for name, own in SCHEMAS.items())
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
ARROW = {name: pa.list_(pa.struct([(c.partition(":")[0], _ARROW[c.partition(":")[2]]) for c in own.split(",")])) for name, own in SCHEMAS.items()}
#: Fixed values.
VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "trace", "websocket")
EXPRESS = ("get", "post", "put", "patch", "delete", "options", "head", "all", "use")
CALLBACK_TAKERS = ("on", "once", "addEventListener", "then", "catch", "finally", "setTimeout", "setInterval", "setImmediate", "queueMicrotask", "requestAnimationFrame")
MAX_FORMALS = 64


def _short(text: str, n: int) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:n]


class Facts:
    """What one file yields."""

    def __init__(self, path: str, language: str, source: str):
        self.path, self.language, self.source = path, language, source
        self.out: dict[str, list[dict]] = {name: [] for name in SCHEMAS}
        self.starts = [0]
        for line in source.split("\n"):
            self.starts.append(self.starts[-1] + len(line.encode()) + 1)
        n = source.count("\n") + 1
        self.file_id = self.symbol("file", path, path, (0, len(source.encode())), (1, n))

    def symbol(self, kind: str, name: str, qualified: str, span: tuple[int, int], lines: tuple[int, int], discriminator: str = "") -> str:
        key = f"{self.language}|{kind}|{self.path}|{qualified}" + (f"|signature:{_short(discriminator, 16)}" if discriminator else "")
        made = dict(id=f"{key}#{len(self.out['symbols'])}", semantic_key=key, language=self.language, kind=kind, name=name, qualified_name=qualified, file=self.path, start_byte=span[0], end_byte=span[1], start_line=lines[0], end_line=lines[1])
        self.out["symbols"].append(made)
        return made["id"]  # for this file only, until ``settle``

    def settle(self) -> None:
        """Gives symbols their ids, everywhere; every member of a group of equal keys gets its place in the group."""
        groups: dict[str, list[dict]] = {}
        for s in self.out["symbols"]:
            groups.setdefault(s["semantic_key"], []).append(s)
        ids: dict[str, str] = {}
        for key, own in groups.items():
            for k, made in enumerate(own):
                if len(own) > 1:
                    made["semantic_key"] = f"{key}|duplicate:{k}"
                ids[made["id"]] = f"sym_{_short(made['semantic_key'], 24)}"
                made["id"] = ids[made["id"]]
        for rows in self.out.values():
            for row in rows:
                for column in ("source_id", "caller_id", "owner_id", "handler_id"):
                    if column in row:
                        row[column] = ids.get(row[column], row[column])

    def reference(self, source_id: str, target: str, kind: str, confidence: float, line: int, hint: str | None = None, binding: str | None = None, provenance: str = "syntax/reference", explanation: str = "") -> None:
        if target:
            self.out["references"].append(dict(ref_id=f"{self.path}#{len(self.out['references'])}", file=self.path, source_id=source_id, target_name=target, binding_name=binding or target, target_file_hint=hint, kind=kind, provenance=provenance, confidence=confidence, explanation=explanation or f"{kind} {target}", evidence_file=self.path, evidence_line=line))

    def call(self, caller: str, name: str, line: int, start: int, receiver: str | None = None, receiver_type: str | None = None, result_of: int | None = None, hint: str | None = None, provenance: str = "syntax/call", confidence: float = 1.0, explanation: str = "", resolvable: bool = True) -> None:
        if name:
            self.out["calls"].append(dict(call_id=f"{self.path}#{len(self.out['calls'])}", file=self.path, caller_id=caller, fallback_caller_id=None, callee_name=name, receiver_binding=receiver, receiver_type=receiver_type, receiver_call_start_byte=result_of, target_file_hint=hint, provenance=provenance, confidence=confidence, explanation=explanation or f"call to {name}", resolvable=resolvable, evidence_file=self.path, evidence_line=line, start_byte=start))


# --- Python ----------------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, facts: Facts):
        self.f, self.scope, self.owner = facts, [], [facts.file_id]
        self.types: list[dict[str, str]] = [{}]
        self.formals: list[list[str]] = [[]]
        self.locals: list[set[str]] = [set()]
        self.imports: dict[str, str] = {}

    def at(self, node: ast.AST) -> tuple[int, int]:
        return self.f.starts[node.lineno - 1] + node.col_offset, self.f.starts[node.end_lineno - 1] + node.end_col_offset

    def define(self, node, kind: str, discriminator: str = "") -> str:
        qualified = ".".join([*self.scope, node.name])
        return self.f.symbol(kind, node.name, qualified, self.at(node), (node.lineno, node.end_lineno), discriminator)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        own = self.define(node, "class")
        for base in node.bases:
            name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else ""
            if name != node.name:
                self.f.reference(own, name, "extends", 0.95, base.lineno)
        self.inside(node, own)

    def inside(self, node, own: str) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        self.owner.append(own)
        self.types.append({})
        function = not isinstance(node, ast.ClassDef)
        self.formals.append([a.arg for a in node.args.args] if function else [])
        self.locals.append({t.id for x in ast.walk(node) if isinstance(x, ast.Assign) for t in x.targets if isinstance(t, ast.Name)} if function else set())
        if function:
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                if isinstance(a.annotation, ast.Name):
                    self.types[-1][a.arg] = a.annotation.id
            if len(self.scope) > 1 and node.args.args and node.args.args[0].arg == "self":
                self.types[-1]["self"] = self.scope[-2]
        for child in node.body:
            self.visit(child)
        for stack in (self.scope, self.owner, self.types, self.formals, self.locals):
            stack.pop()

    def visit_FunctionDef(self, node) -> None:
        shape = " ".join(f"{ast.unparse(node.args)}->{ast.unparse(node.returns) if node.returns else ''}".split())
        own = self.define(node, "function", shape)
        if isinstance(node.returns, ast.Name):
            self.f.out["returns"].append(dict(owner_id=own, file=self.f.path, type_name=node.returns.id))
        plain = [a.arg for a in node.args.args]
        if not node.decorator_list and len(plain) + len(node.args.kwonlyargs) <= MAX_FORMALS:
            for k, name in enumerate(plain):
                self.f.out["formals"].append(dict(owner_id=own, formal_name=name, parameter_index=k))
        self.route(node, own)
        self.inside(node, own)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name != "*":
                self.f.reference(self.f.file_id, a.name, "imports", 0.9, node.lineno, provenance="syntax/python-import", explanation=f"imports {a.name} from {module}")
                if a.asname:
                    self.f.reference(self.f.file_id, a.asname, "imports", 0.9, node.lineno, provenance="syntax/python-import", explanation=f"imports {a.name} from {module}")
                self.imports[a.asname or a.name] = f"{module}.{a.name}"

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name] = a.name

    def hands(self, node: ast.Call, callee: str, start: int) -> None:
        """Names among a call's arguments: the caller's own parameters handed on, or functions given."""
        for k, (formal, value) in enumerate([*((None, a) for a in node.args), *((w.arg, w.value) for w in node.keywords)]):
            if not isinstance(value, ast.Name) or value.id in _WORDS:
                continue
            own = self.formals[-1]
            if value.id in own:
                self.f.out["delegations"].append(dict(owner_id=self.owner[-1], parameter_index=own.index(value.id), file=self.f.path, call_start_byte=start, argument_index=k))
            elif self.type_of(value.id) is None and value.id not in self.locals[-1]:
                self.f.out["arguments"].append(dict(file=self.f.path, caller_id=self.owner[-1], callee_name=callee, argument_index=k, formal_name=formal, target_name=value.id, line=node.lineno, call_start_byte=start))
                self.f.reference(self.owner[-1], value.id, "references", 0.9, node.lineno, provenance="syntax/function-reference", explanation=f"hands {value.id} to {callee}")

    def type_of(self, name: str) -> str | None:
        return next((t[name] for t in reversed(self.types) if name in t), None)

    def visit_Assign(self, node: ast.Assign) -> None:
        value = node.value
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id[:1].isupper():
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.types[-1][t.id] = value.func.id
        self.router(node)
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        start = self.at(node)[0]
        f = node.func
        if isinstance(f, ast.Name):
            self.f.call(self.owner[-1], f.id, node.lineno, start)
            if f.id in self.formals[-1] and f.id not in self.locals[-1]:  # calls what it was given
                self.f.out["invocations"].append(dict(owner_id=self.owner[-1], parameter_index=self.formals[-1].index(f.id)))
            self.hands(node, f.id, start)
        elif isinstance(f, ast.Attribute):
            base = f.value
            if isinstance(base, ast.Call):
                self.f.call(self.owner[-1], f.attr, node.lineno, start, result_of=self.at(base)[0])
            else:
                name = base.id if isinstance(base, ast.Name) else ast.unparse(base)
                self.f.call(self.owner[-1], f.attr, node.lineno, start, receiver=name, receiver_type=self.type_of(name))
            self.hands(node, f.attr, start)
        self.mount(node)
        self.django(node)
        self.generic_visit(node)

    # routers and routes

    def made_by(self, value: ast.AST) -> str | None:
        """Which FastAPI constructor a call names, if it was imported from there."""
        if not isinstance(value, ast.Call):
            return None
        f = value.func
        if isinstance(f, ast.Name):
            full = self.imports.get(f.id, "")
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            full = f"{self.imports.get(f.value.id, '')}.{f.attr}"
        else:
            return None
        return full.rpartition(".")[2] if full in ("fastapi.FastAPI", "fastapi.APIRouter") else None

    @staticmethod
    def literal(node: ast.AST | None, default: str | None = None) -> str | None:
        return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else default

    def prefix(self, call: ast.Call) -> str | None:
        given = next((k.value for k in call.keywords if k.arg == "prefix"), None)
        text = "" if given is None else self.literal(given)
        return text if text is not None and (text == "" or (text.startswith("/") and not text.endswith("/"))) else None

    def router(self, node: ast.Assign) -> None:
        kind = self.made_by(node.value)
        if kind and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and (prefix := self.prefix(node.value)) is not None:
            self.f.out["routers"].append(dict(file=self.f.path, name=node.targets[0].id, prefix=prefix, application=kind == "FastAPI"))

    def mount(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Attribute) and f.attr == "include_router" and isinstance(f.value, ast.Name) and node.args and (prefix := self.prefix(node)) is not None:
            child, hint = ast.unparse(node.args[0]), None
            first, _, rest = child.partition(".")
            if first in self.imports:  # a router of another file
                full = f"{self.imports[first]}.{rest}" if rest else self.imports[first]
                hint, _, child = full.rpartition(".")
            self.f.out["mounts"].append(dict(file=self.f.path, parent=f.value.id, child=child, child_hint=hint, prefix=prefix, line=node.lineno))

    def route(self, node, own: str) -> None:
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in VERBS and isinstance(d.func.value, ast.Name):
                path = self.literal(d.args[0] if d.args else next((k.value for k in d.keywords if k.arg == "path"), None))
                if path is not None and (path == "" or path.startswith("/")):
                    start, end = self.at(d)
                    self.f.out["routes"].append(dict(file=self.f.path, router=d.func.value.id, verb=d.func.attr.upper(), path=path, handler_id=own, start_byte=start, end_byte=end, line=d.lineno, end_line=d.end_lineno))

    def django(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name) and f.id in ("path", "re_path", "url") and len(node.args) > 1 and (text := self.literal(node.args[0])) is not None:
            handler, hint = node.args[1], None
            if isinstance(handler, ast.Call) and isinstance(handler.func, ast.Attribute) and handler.func.attr == "as_view":
                handler = handler.func.value
            if isinstance(handler, ast.Attribute) and isinstance(handler.value, ast.Name):
                name, hint = handler.attr, handler.value.id
            else:
                name = handler.id if isinstance(handler, ast.Name) else ""
            label = "ROUTE"
        elif isinstance(f, ast.Attribute) and f.attr == "register" and len(node.args) > 1 and (text := self.literal(node.args[0])) is not None:
            last = node.args[1]
            name, hint, label = (last.id if isinstance(last, ast.Name) else last.attr if isinstance(last, ast.Attribute) else ""), None, "VIEWSET"
            if not name.endswith(("View", "ViewSet")):
                return
        else:
            return
        if name:
            start, end = self.at(node)
            title = f"{label} /{text.lstrip('/')}"
            route = self.f.symbol("route", title, title, (start, end), (node.lineno, node.end_lineno), f"{start}")
            self.f.call(route, name, node.lineno, start, hint=hint, provenance="framework/django-route", confidence=0.98, explanation=f"{title} dispatches to {name}")


def python_facts(f: Facts) -> None:
    try:
        tree = ast.parse(f.source)
    except (SyntaxError, ValueError, RecursionError):
        return
    _Python(f).visit(tree)


# --- languages that are scanned ---------------------------------------------------------

_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_CLASS = re.compile(r"\b(class|interface)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{>]*>)?(?:\s+extends\s+([A-Za-z_$][\w$.]*))?(?:\s*<[^{>]*>)?(?:\s+implements\s+([\w$.,\s]+?))?\s*\{")
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(\((?:[^()]|\([^()]*\))*\)(?:\s*:\s*[\w$<>\[\]|. ]+)?)\s*\{|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\s*\*?\s*)?(\((?:[^()]|\([^()]*\))*\)(?:\s*:\s*[\w$<>\[\]|. ]+)?|[A-Za-z_$][\w$]*)\s*(?:=>\s*\{?|\{)")
_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|async|readonly|override)\s+)*([A-Za-z_$][\w$]*)\s*(\((?:[^()]|\([^()]*\))*\)(?:\s*:\s*[\w$<>\[\]|. ]+)?)\s*(\{|;)")
_IMPORT = re.compile(r"\bimport\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\s*(['\"])(.+?)\3")
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?:([A-Za-z_$][\w$]*)|\{([^}]*)\})\s*=\s*require\(\s*(['\"])(.+?)\3\s*\)")
_CALL = re.compile(r"(?:\b(new)\s+)?(?:([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\.)?\b([A-Za-z_$][\w$]*)\s*\(")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "constructor", "of", "in", "new", "delete", "void", "do", "else"}


def _blanked(source: str, strings: bool = True) -> str:
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if strings or m[0][:2] in ("//", "/*") else m[0], source)


class Around:
    """Nested spans (start, end, what); finds the innermost one around a place."""

    def __init__(self, spans: list[tuple]):
        self.own = sorted(spans, key=lambda o: (o[0], -o[1]))
        self.starts, self.above, stack = [o[0] for o in self.own], [], []
        for k, start in enumerate(self.starts):
            while stack and self.own[stack[-1]][1] <= start:
                stack.pop()
            self.above.append(stack[-1] if stack else -1)
            stack.append(k)

    def at(self, i: int) -> tuple | None:
        k = bisect_right(self.starts, i) - 1
        while k >= 0 and self.own[k][1] <= i:
            k = self.above[k]
        return self.own[k] if k >= 0 else None


class Scanned:
    """A source whose comments and strings are blanked, with places of its blocks, lines and owners."""

    def __init__(self, f: Facts, code: str):
        self.f, self.code = f, code
        self.lines = [m.start() for m in re.finditer("\n", f.source)]
        if f.source.isascii():
            self.bytes = None
        else:
            points = np.frombuffer(f.source.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.bytes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        self.ends: dict[int, int] = {}
        open_: list[int] = []
        pairs = {")": "(", "}": "{"}
        for m in re.finditer(r"[(){}]", code):
            if m[0] in "({":
                open_.append(m.start())
            elif open_ and code[open_[-1]] == pairs[m[0]]:
                self.ends[open_.pop()] = m.start()
        self.opened = {e: o for o, e in self.ends.items()}
        self.owners: list[tuple[int, int, str]] = []
        self._around: Around | None = None

    def byte(self, i: int) -> int:
        return i if self.bytes is None else int(self.bytes[min(i, len(self.bytes) - 1)])

    def line(self, i: int) -> int:
        return bisect_left(self.lines, i) + 1

    def block_end(self, opened: int) -> int:
        return self.ends.get(opened, len(self.code) - 1) + 1

    def add(self, kind: str, name: str, qualified: str, start: int, end: int, discriminator: str = "") -> str:
        own = self.f.symbol(kind, name, qualified, (self.byte(start), self.byte(end)), (self.line(start), self.line(max(start, end - 1))), discriminator)
        self.owners.append((start, end, own))
        self._around = None
        return own

    def owner_at(self, i: int) -> str:
        """The innermost symbol around a place."""
        if self._around is None:
            self._around = Around(self.owners)
        found = self._around.at(i)
        return found[2] if found else self.f.file_id

    def arguments(self, opened: int) -> list[tuple[int, int]]:
        """Places of the arguments of the call whose bracket opens there."""
        end = self.ends.get(opened)
        if end is None:
            return []
        out, depth, start = [], 0, opened + 1
        for m in re.compile(r"[][(){},]").finditer(self.code, opened + 1, end):
            if m[0] == "," and depth == 0:
                out.append((start, m.start()))
                start = m.end()
            else:
                depth += (m[0] in "([{") - (m[0] in ")]}")
        if out or self.code[start:end].strip() or self.f.source[start:end].strip():
            out.append((start, end))
        return out

    def result_of(self, at: int) -> int | None:
        """Where the call starts on whose result the name at a place is called."""
        before = self.code[:at].rstrip()
        if not before.endswith(".") or not (before := before[:-1].rstrip()).endswith(")"):
            return None
        opened = self.opened.get(len(before) - 1)
        m = re.search(r"(?:\bnew\s+)?[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*$", self.code[max(0, opened - 400) : opened]) if opened is not None else None
        return None if m is None else max(0, opened - 400) + m.start()


def _formals(text: str) -> list[str | None]:
    """Names of a parameter list; None for one that isn't a plain name."""
    inner = (text[text.find("(") + 1 : text.rfind(")")] if "(" in text else text).replace("=>", "  ").replace("->", "  ")
    out, depth, part = [], 0, ""
    for c in inner + ",":
        if c == "," and depth == 0:
            m = re.match(r"\s*(?:(?:public|private|protected|readonly)\s+)*([A-Za-z_$][\w$]*)\s*(?:\?|:|=|$)", part)
            if part.strip():
                out.append(m[1] if m else None)
            part = ""
        else:
            depth += (c in "([{<") - (c in ")]}>")
            part += c
    return out


def javascript_facts(f: Facts) -> None:
    plain = _blanked(f.source, strings=False)
    s = Scanned(f, _blanked(f.source))
    code = s.code
    classes: list[tuple[int, int, str]] = []
    formals: dict[str, list[str | None]] = {}

    def shaped(own: str, shape: str) -> None:
        names = _formals(shape)
        formals[own] = names
        for k, name in enumerate(names[:MAX_FORMALS]):
            if name:
                f.out["formals"].append(dict(owner_id=own, formal_name=name, parameter_index=k))
        if m := re.search(r"\)\s*:\s*([A-Za-z_$][\w$]*)\s*$", shape):
            f.out["returns"].append(dict(owner_id=own, file=f.path, type_name=m[1]))

    for m in _CLASS.finditer(code):
        end = s.block_end(m.end() - 1)
        own = s.add(m[1], m[2], m[2], m.start(), end)
        classes.append((m.end() - 1, end, m[2]))
        for kind, names in (("extends", m[3]), ("implements", m[4])):
            for name in (names or "").split(","):
                name = name.strip().rpartition(".")[2]
                if name and name != m[2]:
                    f.reference(own, name, kind, 0.95, s.line(m.start()))
        depth_one = re.sub(r"\{[^{}]*\}", lambda x: "{" + " " * (len(x[0]) - 2) + "}", code[m.end() : end - 1])
        for x in _METHOD.finditer(depth_one):
            if x[1] in _NOT_CALLS and x[1] != "constructor":
                continue
            at = m.end() + x.start(1)
            stop = s.block_end(m.end() + x.start(3)) if x[3] == "{" else m.end() + x.end()
            shaped(s.add("method", x[1], f"{m[2]}.{x[1]}", at, stop, " ".join(x[2].split())), x[2])
    for m in _FUNCTION.finditer(code):
        name = m[1] or m[3]
        brace = m.end() - 1
        end = s.block_end(brace) if code[brace] == "{" else (code.find("\n", m.end()) + 1 or len(code))
        shaped(s.add("function", name, name, m.start(), end, " ".join((m[2] or m[4]).split())), m[2] or m[4])
    for pattern, split in ((_IMPORT, r"\s+as\s+|\s+"), (_REQUIRE, r"\s*:\s*|\s+")):
        for m in pattern.finditer(plain):
            names = [(m[1], m[1])] if m[1] else []
            for part in (m[2] or "").split(","):
                words = re.split(split, part.replace("type ", "").strip())
                if words[0]:
                    names.append((words[0], words[-1]))
            for target, binding in names:
                f.reference(f.file_id, target, "imports", 0.95, s.line(m.start()), hint=m[4], binding=binding, provenance="syntax/import")

    defined = {start for start, _, _ in s.owners}
    types = dict(re.findall(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*new\s+([A-Za-z_$][\w$]*)", code))
    noted: dict[str, set[str]] = {}
    for name, kind in re.findall(r"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*([A-Za-z_$][\w$]*)\??\s*:\s*([A-Z][\w$]*)\s*[,)=]", code) + re.findall(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*:\s*([A-Z][\w$]*)\s*[=;]", code):
        noted.setdefault(name, set()).add(kind)
    types |= {name: min(kinds) for name, kinds in noted.items() if len(kinds) == 1 and name not in types}
    for m in _CALL.finditer(code):
        name, receiver = m[3], m[2]
        if name in _NOT_CALLS or m.start(3) in defined or re.search(r"\bfunction\s*\*?\s*$", code[max(0, m.start() - 20) : m.start()]):
            continue
        caller, line, start = s.owner_at(m.start()), s.line(m.start()), s.byte(m.start())
        given = s.arguments(m.end() - 1)
        texts = [plain[a:b].strip() for a, b in given]
        literal = re.fullmatch(r"(['\"])([^'\"\n]*)\1", texts[0]) if texts else None
        names = [t if _NAME.fullmatch(t) else None for t in texts]
        if receiver in ("app", "router") and name in EXPRESS and name != "use" and literal:
            end = s.ends.get(m.end() - 1, m.end())
            verb = f"{name.upper()} {literal[2]}"
            route = f.symbol("route", verb, verb, (start, s.byte(end)), (line, s.line(end)), str(start))
            for h in _NAME.findall(code[m.end() : end]):
                f.call(route, h.rpartition(".")[2], line, start, provenance="framework/express-route", confidence=0.98, explanation=f"{verb} runs {h}")
            continue
        receiver_type = None
        if receiver == "this":
            receiver_type = next((c for a, e, c in reversed(classes) if a <= m.start() < e), None)
        elif receiver:
            receiver_type = types.get(receiver)
        made_by = s.result_of(m.start(3)) if not receiver else None
        own_formals = formals.get(caller, [])
        if not receiver and name in own_formals:  # calls what it was given
            f.out["invocations"].append(dict(owner_id=caller, parameter_index=own_formals.index(name)))
        f.call(caller, name, line, start, receiver=receiver, receiver_type=receiver_type, result_of=None if made_by is None else s.byte(made_by))
        if receiver and literal and name in ("on", "once", "emit", "dispatchEvent"):
            register = name in ("on", "once")
            handler = names[1] if register and len(names) > 1 else None
            f.out["events"].append(dict(event_id=f"{f.path}#{len(f.out['events'])}", file=f.path, owner_id=caller, receiver=receiver, channel=literal[2], action="register" if register else "dispatch", callback_name=(handler or "").rpartition(".")[2] or None, evidence_file=f.path, evidence_line=line))
        taken = name in CALLBACK_TAKERS
        if taken:
            handler = next((n for n in names[1 if literal else 0 : 2 if literal else 1] if n), None)
            if handler:
                f.call(caller, handler.rpartition(".")[2], line, start, provenance="syntax/callback-registration", confidence=0.95, explanation=f"registers {handler} with {name}")
        for k, n in enumerate(names):
            if not n or "." in n or n in _WORDS:
                continue
            if n in own_formals:
                f.out["delegations"].append(dict(owner_id=caller, parameter_index=own_formals.index(n), file=f.path, call_start_byte=start, argument_index=k))
            else:
                f.out["arguments"].append(dict(file=f.path, caller_id=caller, callee_name=name, argument_index=k, formal_name=None, target_name=n, line=line, call_start_byte=start))
                if not taken:
                    f.reference(caller, n, "references", 0.9, line, provenance="syntax/function-reference", explanation=f"hands {n} to {name}")


_WORDS = {"true", "false", "null", "undefined", "this", "NaN", "Infinity", "arguments", "nil", "self", "None", "True", "False"}

#: What opens a type or a function, and what names another file, per language: (kind, pattern), a name in group ``n``,
#: bases in group ``b`` or clauses with them in ``h``, the type around in group ``o``.  A block in braces follows, or nothing.
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|sealed|partial|open|suspend|inline|data|export|default|const|unsafe|mutating|fileprivate|readonly|extern|operator|case|implicit|lazy|synchronized|native)\s+)*"
_ANY = r"[A-Za-z_][\w]*"
_TYPED = rf"(?<![\w.]){_MODS}(?!(?:return|new|else|throw|await|case|using|package|import|goto|delete|typedef)\b)(?:[A-Za-z_][\w:<>\[\],.?*& ]*?[\s*&>\]]+)(?P<n>~?{_ANY})\s*(?P<s>\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\))\s*(?:const\s*|noexcept\s*|override\s*|final\s*|throws\s+[\w., ]+)*"
LANGUAGE_RULES: dict[str, dict] = {
    "go": {
        "types": [("struct", rf"\btype\s+(?P<n>{_ANY})\s+struct\s*\{{"), ("interface", rf"\btype\s+(?P<n>{_ANY})\s+interface\s*\{{")],
        "functions": [rf"\bfunc\s+(?:\(\s*(?:{_ANY}\s+)?\*?(?P<o>{_ANY})(?:\[[^\]]*\])?\s*\)\s*)?(?P<n>{_ANY})\s*(?:\[[^\]]*\])?(?P<s>\([^{{]*?\))[^{{\n]*\{{"],
        "imports": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<h>[\w./-]+)"\s*$'],
    },
    "rust": {
        "types": [("struct", rf"\bstruct\s+(?P<n>{_ANY})[^;{{(]*[;{{(]"), ("enum", rf"\benum\s+(?P<n>{_ANY})[^{{]*\{{"), ("trait", rf"\btrait\s+(?P<n>{_ANY})(?:<[^{{]*?>)?(?:\s*:\s*(?P<b>[^{{]*?))?\s*\{{")],
        "blocks": rf"\bimpl(?:\s*<[^{{]*?>)?\s+(?:(?P<b>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<n>{_ANY})[^{{;]*\{{",
        "functions": [rf"\bfn\s+(?P<n>{_ANY})\s*(?:<[^(]*>)?\s*(?P<s>\([^{{;]*?\))[^{{;]*[{{;]"],
        "imports": [rf"\buse\s+(?:[\w]+::)*(?P<n>{_ANY})(?:\s+as\s+(?P<a>{_ANY}))?\s*;", rf"\buse\s+(?:[\w]+::)*\{{(?P<l>[^{{}}]*)\}}\s*;"],
    },
    "java": {"types": [("class", rf"\b(?:class|record)\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("interface", rf"\binterface\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("enum", rf"\benum\s+(?P<n>{_ANY})[^{{;]*\{{")], "functions": [_TYPED + r"[{;]"], "imports": [rf"\bimport\s+(?:static\s+)?(?:\w+\.)*(?P<n>{_ANY})\s*;"]},
    "csharp": {"types": [("class", rf"\b(?:class|record)\s+(?P<n>{_ANY})(?:<[^{{]*?>)?(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("struct", rf"\bstruct\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("interface", rf"\binterface\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("enum", rf"\benum\s+(?P<n>{_ANY})[^{{;]*\{{")], "functions": [_TYPED + r"(?:\{|=>|;)"], "imports": []},
    "c": {"types": [("struct", rf"\bstruct\s+(?P<n>{_ANY})\s*\{{"), ("enum", rf"\benum\s+(?P<n>{_ANY})\s*\{{")], "functions": [_TYPED + r"\{"], "imports": []},
    "cpp": {"types": [("class", rf"\bclass\s+(?P<n>{_ANY})(?:\s+final)?(?:\s*:\s*(?P<b>[^{{;]+?))?\s*\{{"), ("struct", rf"\bstruct\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{;]+?))?\s*\{{"), ("enum", rf"\benum\s+(?:class\s+)?(?P<n>{_ANY})[^{{;]*\{{")], "functions": [rf"(?P<o>{_ANY})::(?P<n>~?{_ANY})\s*(?P<s>\([^;{{}}]*?\))\s*(?:const\s*|noexcept\s*)*(?::[^{{;]*)?\{{", _TYPED + r"\{"], "imports": []},
    "kotlin": {"types": [("class", rf"\b(?:class|object)\s+(?P<n>{_ANY})[^{{\n:]*(?::\s*(?P<b>[^{{\n]+?))?\s*(?:\{{|$)"), ("interface", rf"\binterface\s+(?P<n>{_ANY})[^{{\n:]*(?::\s*(?P<b>[^{{\n]+?))?\s*(?:\{{|$)")], "functions": [rf"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<o>{_ANY})\.)?(?P<n>{_ANY})\s*(?P<s>\([^{{=]*?\))[^{{=\n]*(?:\{{|=|$)"], "imports": [rf"\bimport\s+(?:\w+\.)*(?P<n>{_ANY})(?:\s+as\s+(?P<a>{_ANY}))?"]},
    "swift": {"types": [("class", rf"\b(?:class|actor)\s+(?P<n>{_ANY})(?:<[^{{]*?>)?(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("struct", rf"\bstruct\s+(?P<n>{_ANY})(?:<[^{{]*?>)?(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("interface", rf"\bprotocol\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{"), ("enum", rf"\benum\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{")], "blocks": rf"\bextension\s+(?P<n>{_ANY})(?:\s*:\s*(?P<b>[^{{]+?))?\s*\{{", "functions": [rf"\bfunc\s+(?P<n>{_ANY})\s*(?:<[^(]*>)?(?P<s>\([^{{]*?\))[^{{\n]*(?:\{{|$)"], "imports": []},
    "php": {"types": [("class", rf"\bclass\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("interface", rf"\binterface\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("trait", rf"\btrait\s+(?P<n>{_ANY})\s*\{{")], "functions": [rf"\bfunction\s+&?(?P<n>{_ANY})\s*(?P<s>\([^{{;]*?\))[^{{;]*[{{;]"], "imports": [rf"^\s*use\s+(?:\w+\\)*(?P<n>{_ANY})(?:\s+as\s+(?P<a>{_ANY}))?\s*;"]},
    "dart": {"types": [("class", rf"\b(?:class|mixin)\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("enum", rf"\benum\s+(?P<n>{_ANY})[^{{;]*\{{")], "blocks": rf"\bextension\s+(?:{_ANY}\s+)?on\s+(?P<n>{_ANY})[^{{]*\{{", "functions": [_TYPED + r"(?:async\*?\s*|sync\*\s*)?(?:\{|=>|;)"], "imports": [r"\bimport\s+['\"](?P<h>[^'\"]+)['\"]"]},
    "scala": {"types": [("class", rf"\b(?:class|object)\s+(?P<n>{_ANY})(?P<h>[^{{\n]*)(?:\{{|$)"), ("trait", rf"\btrait\s+(?P<n>{_ANY})(?P<h>[^{{\n]*)(?:\{{|$)")], "functions": [rf"\bdef\s+(?P<n>{_ANY})\s*(?:\[[^\]]*\])?(?P<s>(?:\([^{{=]*?\))?)[^{{=\n]*(?:=\s*\{{|\{{|=|$)"], "imports": [rf"\bimport\s+(?:\w+\.)*(?P<n>{_ANY})\s*$"]},
}
LANGUAGE_RULES["arkts"] = {"types": [("component", rf"\bstruct\s+(?P<n>{_ANY})\s*\{{"), ("class", rf"\bclass\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{"), ("interface", rf"\binterface\s+(?P<n>{_ANY})(?P<h>[^{{;]*)\{{")], "functions": [rf"\bfunction\s+(?P<n>{_ANY})\s*(?P<s>\([^{{;]*?\))[^{{;]*\{{", rf"(?:^|[;{{}}\n])\s*{_MODS}(?!(?:if|for|while|switch|catch|return)\b)(?P<n>{_ANY})\s*(?P<s>\([^;{{}}()]*\))\s*(?::\s*[\w<>\[\]|. ]+)?\s*\{{"], "imports": [], "javascript": True}
_RULES = {name: {k: ([(kind, re.compile(p, re.MULTILINE)) for kind, p in v] if k == "types" else [re.compile(p, re.MULTILINE) for p in v] if isinstance(v, list) else re.compile(v) if isinstance(v, str) else v) for k, v in rules.items()} for name, rules in LANGUAGE_RULES.items()}
#: Clauses of a type's header; languages whose functions stand in types or at the top only; blocks that hold types.
_HERITAGE = re.compile(r"\b(extends|implements)\s+([\w.,\\ <>\[\]]+?)(?=\s*(?:\bextends\b|\bimplements\b|\bwith\b|\bpermits\b|$))")
_MEMBERS = ("java", "csharp", "dart", "cpp", "c", "arkts")
_SPACE_BLOCK = re.compile(r"\b(?:namespace\s+[\w.:]*|extern\s+)\s*$")
_ALWAYS = _NOT_CALLS | {"struct", "throw", "try", "case", "yield", "where", "elif"}
#: Words before a bracket that are no calls, by language.
_KEYWORDS = {
    "go": _ALWAYS | {"func", "go", "defer", "select", "range", "var", "const", "type"},
    "rust": _ALWAYS | {"fn", "match", "loop", "unsafe", "let"},
    "java": _ALWAYS | {"synchronized", "assert"},
    "csharp": _ALWAYS | {"using", "lock", "foreach", "when", "nameof", "sizeof", "default", "fixed"},
    "c": _ALWAYS | {"sizeof", "union", "_Alignof", "_Static_assert"},
    "cpp": _ALWAYS | {"sizeof", "union", "alignof", "decltype", "static_assert", "noexcept", "operator"},
    "kotlin": _ALWAYS | {"fun", "when", "val", "var"},
    "swift": _ALWAYS | {"func", "guard", "init", "let", "var"},
    "php": _ALWAYS | {"fn", "array", "list", "isset", "empty", "echo", "print", "match", "foreach", "elseif", "unset"},
    "dart": _ALWAYS | {"assert"},
    "scala": _ALWAYS | {"def", "match", "val", "var"},
    "arkts": _ALWAYS,
}
_RUST_TEXT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.DOTALL)
_HASH_TEXT = re.compile(r"#[^\n]*|//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.DOTALL)
_INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)', re.MULTILINE)


def braced_facts(f: Facts) -> None:
    """Types, functions, heritage, imports and calls of a language with blocks in braces."""
    rules, keywords = _RULES[f.language], _KEYWORDS[f.language]
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = (_RUST_TEXT if f.language == "rust" else _HASH_TEXT if f.language == "php" else _BLANK).sub(blank, f.source)
    if f.language in ("c", "cpp"):
        for m in _INCLUDE.finditer(f.source):
            f.out["includes"].append(dict(file=f.path, include=m[1] or m[2], quoted=m[1] is not None, line=f.source.count("\n", 0, m.start()) + 1))
        text = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", blank, text, flags=re.MULTILINE)
    s = Scanned(f, text)
    inside: list[tuple[int, int, str, str]] = []

    def bases(own: str, kind: str, names: str | None, at: int) -> None:
        for name in re.split(r",|\+|\bwith\b", re.sub(r"<[^<>]*>|\([^()]*\)", "", names or "")):
            name = re.split(r"[.:\\ ]", re.sub(r"\b(?:public|private|protected|virtual)\b", "", name).strip())[-1]
            if re.fullmatch(_ANY, name):
                f.reference(own, name, kind, 0.95, s.line(at))

    def block(m: re.Match) -> int:
        return s.block_end(m.end() - 1) if text[m.end() - 1] == "{" else m.end()

    for kind, pattern in rules["types"]:
        for m in pattern.finditer(text):
            groups, end = m.groupdict(), block(m)
            own = s.add(kind, m["n"], m["n"], m.start(), end)
            inside.append((m.end() - 1, end, m["n"], kind))
            bases(own, "extends", groups.get("b"), m.start())
            for word, names in _HERITAGE.findall(groups.get("h") or ""):
                bases(own, "implements" if word == "implements" else "extends", names, m.start())
    ids = {name: own["id"] for own in f.out["symbols"] for name in [own["name"]] if own["kind"] != "file"}
    for m in rules["blocks"].finditer(text) if "blocks" in rules else ():
        inside.append((m.end() - 1, block(m), m["n"], "block"))
        if m["b"] and m["n"] in ids:
            bases(ids[m["n"]], "implements", m["b"], m.start())
    defined: set[int] = set()
    types = Around(inside)
    braces = Around([(o, e + 1) for o, e in s.ends.items() if text[o] == "{"])
    for pattern in rules["functions"]:
        for m in pattern.finditer(text):
            name, at = m["n"], m.start("n")
            if name in keywords or at in defined:
                continue
            type_, block_ = types.at(at), braces.at(at)
            if f.language in _MEMBERS and block_ and (not type_ or type_[0] != block_[0]) and not _SPACE_BLOCK.search(text[max(0, block_[0] - 200) : block_[0]]):
                continue  # inside a function: a statement, or a call with a block
            owner = m.groupdict().get("o") or (type_[2] if type_ else None)
            defined.add(at)
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            own = s.add("method" if owner else "function", name, f"{owner}.{name}" if owner else name, start, block(m), " ".join(m["s"].split()))
            for k, formal in enumerate(_formals(m["s"])[:MAX_FORMALS] if m["s"] else []):
                if formal:
                    f.out["formals"].append(dict(owner_id=own, formal_name=formal, parameter_index=k))
    for pattern in rules["imports"]:
        for m in pattern.finditer(f.source):
            groups, line = m.groupdict(), s.line(m.start())
            if groups.get("h"):
                name = groups["h"].rpartition("/")[2].partition(".")[0]
                f.reference(f.file_id, name, "imports", 0.9, line, hint=groups["h"] if "/" in groups["h"] or "." in groups["h"] else None, provenance="syntax/import")
            elif groups.get("l"):
                for part in groups["l"].split(","):
                    words = part.split(" as ")
                    if re.fullmatch(_ANY, words[0].strip().rpartition("::")[2]):
                        f.reference(f.file_id, words[0].strip().rpartition("::")[2], "imports", 0.9, line, binding=words[-1].strip().rpartition("::")[2], provenance="syntax/import")
            else:
                f.reference(f.file_id, m["n"], "imports", 0.9, line, binding=groups.get("a") or m["n"], provenance="syntax/import")
    if rules.get("javascript"):
        for m in _IMPORT.finditer(_blanked(f.source, strings=False)):
            for part in [m[1] or "", *(m[2] or "").split(",")]:
                words = re.split(r"\s+as\s+", part.strip())
                if words[0]:
                    f.reference(f.file_id, words[0], "imports", 0.95, s.line(m.start()), hint=m[4], binding=words[-1], provenance="syntax/import")
    for m in re.finditer(rf"(?:(?P<r>{_ANY})\s*(?:\.|->|::|\?\.))?\b(?P<n>{_ANY})!?\s*\(", text):
        name, at = m["n"], m.start("n")
        if name in keywords or at in defined:
            continue
        receiver = m["r"]
        around = (types.at(at) or (0, 0, None))[2] if receiver in ("this", "self", "Self") else None
        known = receiver if receiver in ids else None
        made_by = s.result_of(at) if not receiver else None
        f.call(s.owner_at(at), name, s.line(at), s.byte(m.start()), receiver=receiver, receiver_type=around or known, result_of=None if made_by is None else s.byte(made_by))


def component_facts(f: Facts) -> None:
    """A component file: its scripts read as JavaScript at their places, and a component named as the file."""
    name = re.sub(r"\.[^.]*$", "", f.path.rpartition("/")[2])
    size, lines = len(f.source.encode()), f.source.count("\n") + 1
    f.symbol("component", name, name, (0, size), (1, lines))
    whole, kept, at = f.source, [], 0
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", whole, re.DOTALL | re.IGNORECASE):
        kept += [re.sub(r"[^\n]", lambda c: " " * len(c[0].encode()), whole[at : m.start(1)]), m[1]]
        at = m.end(1)
    f.source = "".join(kept)
    javascript_facts(f)
    f.source = whole


EXTRACTORS = {"python": python_facts, **dict.fromkeys(LANGUAGE_RULES, braced_facts), **dict.fromkeys(("typescript", "tsx", "javascript", "jsx"), javascript_facts), **dict.fromkeys(("vue", "svelte"), component_facts)}


def facts_of(path: str, language: str, source: str) -> dict[str, list[dict]]:
    f = Facts(path, language, source or "")
    if language in EXTRACTORS:
        EXTRACTORS[language](f)
    f.settle()
    return f.out


def extract(files: DataFrame) -> DataFrame:
    """One row per file (path, language, source): path and arrays of facts."""
    rows = files.select("path", "language", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                facts = [facts_of(r["path"], r["language"], r["source"]) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in part], pa.string()), *(pa.array([x[name] for x in facts], kind) for name, kind in ARROW.items())], ["path", *ARROW])

    return rows.mapInArrow(run, f"path string, {FACTS}")


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """Fact tables, and the ``contains`` edges from each file to its symbols; persist ``facts`` first."""
    from ..operators.resolve import edges

    out = {name: facts.select(F.explode(name).alias("x")).select("x.*") for name in SCHEMAS}
    own = facts.select(F.get("symbols", F.lit(0))["id"].alias("source_id"), F.explode(F.slice("symbols", F.lit(2), F.size("symbols"))).alias("x"))
    inside = own.select("source_id", F.col("x.id").alias("target_id"), F.col("x.file").alias("evidence_file"), F.col("x.start_line").alias("evidence_line"))
    out["contains"] = edges(inside, "contains", "syntax/containment", 1.0, "file contains symbol")
    return out
