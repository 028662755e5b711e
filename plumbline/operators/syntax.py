"""Syntax trees as rows: a provider turns a source text into nodes.

Two providers are built in.  Python sources go through the standard library's parser;
sources of the other languages through a lexer and a bracket parser that recognises
definitions, statements, calls and operators by their keywords.  Both speak the same
vocabulary of node types.  Vectors of different providers must not be mixed; PROVIDER is
stamped on models for that.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

PROVIDER = "builtin-1"

# Node types that are operators of the Halstead counts.
OPERATOR_TYPES = frozenset(
    "if_statement if elif_clause for_statement for for_in_statement while_statement while match_statement switch_statement case_clause case "
    "try_statement catch_clause except_clause finally_clause with_statement return_statement return break_statement break continue_statement continue "
    "raise_statement throw_statement call call_expression method_invocation assignment augmented_assignment variable_declarator short_var_declaration "
    "binary_operator unary_operator boolean_operator comparison_operator function_definition function_declaration method_definition class_definition class_declaration".split()
)
# A leaf whose type holds one of these is an operand.
OPERAND_PARTS = "identifier name literal number string integer float boolean true false null nil none".split()
# Node types that are units of code.
UNIT_TYPES = frozenset(
    "function_definition function_declaration method_definition method_declaration impl_item function_item class_definition class_declaration func_declaration func_literal".split()
)
#: Decision points of the cyclomatic count, one each, beside one a function.
DECISION_TYPES = frozenset("if_statement elif_clause for_statement while_statement case_clause catch_clause except_clause conditional_expression boolean_operator".split())
FUNCTION_TYPES = frozenset("function_definition function_declaration function_item method_definition method_declaration func_literal".split())


@dataclass
class Node:
    type: str
    start: int
    end: int
    text: str = ""
    kids: list[Node] = field(default_factory=list)
    error: bool = False

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def child(self, kind: str) -> Node | None:
        return next((k for k in self.kids if k.type == kind), None)


_PYTHON = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement",
    "While": "while_statement", "Try": "try_statement", "TryStar": "try_statement", "ExceptHandler": "except_clause", "With": "with_statement", "AsyncWith": "with_statement", "Return": "return_statement",
    "Break": "break_statement", "Continue": "continue_statement", "Raise": "raise_statement", "Call": "call", "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment",
    "BinOp": "binary_operator", "UnaryOp": "unary_operator", "BoolOp": "boolean_operator", "Compare": "comparison_operator", "Match": "match_statement", "match_case": "case_clause",
    "IfExp": "conditional_expression", "Module": "module", "Expr": "expression_statement", "Pass": "pass_statement", "Import": "import_statement", "ImportFrom": "import_from_statement",
}


def _python(source: str) -> Node:
    lines = source.split("\n")

    def build(n: ast.AST, line: int) -> Node:
        name = type(n).__name__
        start = getattr(n, "lineno", line)
        out = Node(_PYTHON.get(name, re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()), start, getattr(n, "end_lineno", start) or start)
        decorators = getattr(n, "decorator_list", [])
        if isinstance(n, ast.Name):
            return Node("identifier", start, start, n.id)
        if isinstance(n, ast.arg):
            out.type = "parameter"
            out.kids.append(Node("identifier", start, start, n.arg))
        if isinstance(n, ast.Constant):
            v = n.value
            kind = {True: "true", False: "false", None: "none"}[v] if v is None or isinstance(v, bool) else "integer" if isinstance(v, int) else "float" if isinstance(v, (float, complex)) else "string"
            return Node(kind, start, out.end, repr(v))
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.kids.append(Node("identifier", start, start, n.name))
        for kid in ast.iter_child_nodes(n):
            if kid in decorators or isinstance(kid, (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)):
                continue
            made = build(kid, start)
            if isinstance(n, ast.If) and len(n.orelse) == 1 and kid is n.orelse[0] and isinstance(kid, ast.If):
                made.type = "elif_clause"
            out.kids.append(made)
        if isinstance(n, ast.Attribute):
            out.kids.append(Node("identifier", out.end, out.end, n.attr))
        if decorators:
            first = decorators[0].lineno
            return Node("decorated_definition", first, out.end, "", [*(Node("decorator", d.lineno, d.end_lineno or d.lineno, ast.unparse(d), [build(d, d.lineno)]) for d in decorators), out])
        return out

    try:
        root = build(ast.parse(source), 1)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # MemoryError: too deeply nested for the parser
        return Node("module", 1, len(lines), "", [Node("ERROR", 1, len(lines), "", _tokens_tree(source, "python"), True)])
    root.start, root.end = 1, len(lines)
    return root


_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`[^`]*`)|(?P<number>\b\d[\w.]*)|(?P<word>[^\W\d]\w*|\$\w+)|(?P<op>&&|\|\||[=!<>]=|:=|=>|->|::|[-+*/%&|^]=|[-+*/%<>=!&|^~?])|(?P<punct>[(){}\[\];,.:@])""",
    re.S,
)
_STATEMENT = {
    "if": "if_statement", "for": "for_statement", "foreach": "for_statement", "while": "while_statement", "loop": "while_statement", "match": "match_statement", "switch": "switch_statement", "when": "switch_statement",
    "case": "case_clause", "try": "try_statement", "catch": "catch_clause", "rescue": "catch_clause", "finally": "finally_clause", "return": "return_statement", "break": "break_statement", "continue": "continue_statement",
    "throw": "throw_statement", "raise": "raise_statement", "unless": "if_statement", "elsif": "elif_clause",
}
_FUNCTION = {"javascript": "function", "typescript": "function", "go": "func", "rust": "fn", "kotlin": "fun", "ruby": "def"}
_TYPES = {"class": "class_declaration", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "interface": "interface_declaration", "mod": "mod_item", "impl": "impl_item"}


def _lex(source: str, language: str) -> list[tuple[str, str, int]]:
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        kind, text = m.lastgroup, m.group()
        if kind == "comment" and text[0] == "#" and language in ("rust", "c", "cpp", "javascript", "typescript"):
            kind = "attribute"
        out.append((kind, text, line))
    return out


def _tokens_tree(source: str, language: str) -> list[Node]:
    """Leaves of a text that does not parse."""
    return [_leaf(k, t, n) for k, t, n in _lex(source, language) if k in ("word", "number", "string")]


def _leaf(kind: str, text: str, line: int) -> Node:
    if kind == "word":
        kind = text if text in ("true", "false", "null", "nil") else "identifier"
    return Node({"string": "string_literal", "number": "number_literal"}.get(kind, kind), line, line + text.count("\n"), text)


def _brackets(source: str, language: str) -> Node:
    """Definitions, statements, calls and operators of a language with brackets."""
    tokens = [t for t in _lex(source, language) if t[0] != "comment"]
    root = Node({"go": "source_file", "rust": "source_file", "java": "program"}.get(language, "program"), 1, source.count("\n") + 1)
    opens, pairs = {"(": ")", "[": "]", "{": "}"}, {"(": "arguments", "[": "array", "{": "block"}
    stack: list[tuple[Node, str]] = [(root, "")]
    pending: list[Node] = []  # definitions and statements whose block is still to come
    keyword = _FUNCTION.get(language)
    k = 0
    while k < len(tokens):
        kind, text, line = tokens[k]
        top = (pending[-1] if pending else stack[-1][0])
        after = tokens[k + 1] if k + 1 < len(tokens) else ("", "", line)
        before = tokens[k - 1] if k else ("", "", line)
        if kind == "word" and text == keyword:
            in_class = any(n.type in ("class_declaration",) for n, _ in stack)
            n = Node({"rust": "function_item", "go": "function_declaration"}.get(language, "method_definition" if in_class else "function_declaration"), line, line)
            if language == "go" and after[1] == "(":
                n.type = "method_declaration" if len(stack) == 1 else "func_literal"
            top.kids.append(n)
            pending.append(n)
        elif kind == "word" and text in _TYPES and after[0] == "word" and (text != "impl" or language == "rust"):
            n = Node(_TYPES[text], line, line)
            top.kids.append(n)
            pending.append(n)
        elif kind == "word" and text in _STATEMENT:
            n = Node(_STATEMENT[text], line, line)
            top.kids.append(n)
            if n.type in ("if_statement", "for_statement", "while_statement", "match_statement", "switch_statement", "try_statement", "catch_clause", "finally_clause") and "{" in source:
                pending.append(n)
        elif kind == "word" and after[1] == "(" and language in ("java", "c", "cpp", "javascript", "typescript") and _has_body(tokens, k + 1) and (stack[-1][1] in ("", "}") and (before[0] == "word" or any(n.type == "class_declaration" for n, _ in stack))) and before[1] not in ("new", "return", "else", keyword):
            inside = any(n.type == "class_declaration" for n, _ in stack)
            kinds = {"java": "method_declaration", "c": "function_definition", "cpp": "function_definition"}
            n = Node(kinds.get(language, "method_definition" if inside else "function_declaration"), line, line, "", [_leaf(kind, text, line)])
            top.kids.append(n)
            pending.append(n)
        elif kind == "word" and after[1] == "(" and not (top.type in UNIT_TYPES and not top.child("identifier")):
            top.kids.append(Node("call_expression", line, line, "", [_leaf(kind, text, line)]))
        elif kind in ("word", "number", "string"):
            top.kids.append(_leaf(kind, text, line))
        elif kind == "attribute":
            pass
        elif kind == "op":
            name = {":=": "short_var_declaration", "=": "assignment", "=>": "arrow", "->": "arrow", "::": "path"}.get(text)
            name = name or ("boolean_operator" if text in ("&&", "||") else "comparison_operator" if text in ("==", "!=", "<", ">", "<=", ">=") else "augmented_assignment" if text[-1] == "=" else "conditional_expression" if text == "?" else "binary_operator")
            top.kids.append(Node(name, line, line, text))
            if text == "=>" and after[1] == "{":
                n = Node("arrow_function", line, line)
                top.kids.append(n)
                pending.append(n)
        elif text in opens:
            n = Node(pairs[text], line, line)
            if text == "#":
                pass
            top.kids.append(n)
            stack.append((n, opens[text]))
            if text == "{" and pending:
                n.pending = pending[:]  # closed with the block
                pending.clear()
            elif pending:
                n.pending = None
                n.held = pending[:]
                pending.clear()
        elif text in ")]}":
            if len(stack) > 1 and stack[-1][1] == text:
                n, _ = stack.pop()
                n.end = line
                for d in getattr(n, "pending", None) or []:
                    d.end = line
                pending.extend(getattr(n, "held", []))
            else:
                root.kids.append(Node("ERROR", line, line, text, [], True))
        elif text == ";":
            for d in pending:
                d.end = line
            pending.clear()
        k += 1
    if len(stack) > 1:
        root.kids.append(Node("ERROR", root.end, root.end, "", [], True))
    return root


def _has_body(tokens: list[tuple[str, str, int]], k: int) -> bool:
    """Whether the parentheses at ``k`` are followed by a block, type annotations aside."""
    depth = 0
    while k < len(tokens):
        depth += (tokens[k][1] == "(") - (tokens[k][1] == ")")
        k += 1
        if not depth:
            break
    while k < len(tokens) and (tokens[k][0] == "word" or tokens[k][1] in (":", "<", ">", "[", "]", ",", ".", "->")):
        k += 1
    return k < len(tokens) and tokens[k][1] == "{"


LANGUAGES = {"python", "javascript", "typescript", "go", "rust", "java", "c", "cpp", "ruby", "kotlin"}


def parse(source: str, language: str) -> Node | None:
    """The tree of a source text; None for languages that no provider knows."""
    language = language.lower()
    if language not in LANGUAGES:
        return None
    return _python(source) if language == "python" else _brackets(source, language)
