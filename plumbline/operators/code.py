"""Code metrics: units, Halstead, cyclomatic counts, tree histograms, feature vectors, declarations and regions.

A file's tree never leaves the task that parsed it: what comes out is a row a unit (or, on
request, a row a node, from which the same counts follow by aggregation).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import syntax
from plumbline.operators.syntax import DECISION_TYPES, FUNCTION_TYPES, OPERAND_PARTS, OPERATOR_TYPES, UNIT_TYPES, Node

BINS, WL_ROUNDS, LOW_LINES = 64, 3, 20
WARN_UNSUPPORTED, WARN_PARTIAL, WARN_SHORT, WARN_EMPTY = "language not supported", "partial parse", "fewer than 20 lines", "no tokens"


# --- one tree ---


def units(root: Node, source: str) -> list[tuple[str, int, int, str, Node]]:
    """(name, first line, last line, text, node) of the outermost units; the whole file as <module> if there is none."""
    lines = source.split("\n")
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.type in UNIT_TYPES:
            name = n.child("identifier")
            out.append((name.text if name else "<anonymous>", n.start, n.end, "\n".join(lines[n.start - 1 : n.end]), n))
        else:
            stack.extend(reversed(n.kids))
    return out or [("<module>", 1, len(lines), source, root)]


def is_operand(n: Node) -> bool:
    return not n.kids and n.type not in OPERATOR_TYPES and any(p in n.type.lower() for p in OPERAND_PARTS)


def halstead(root: Node) -> dict[str, float]:
    """Operators are distinct by type, operands by text; no volume with under two distinct symbols."""
    ops, args = Counter(), Counter()
    for n in root.walk():
        if n.type in OPERATOR_TYPES:
            ops[n.type] += 1
        elif is_operand(n):
            args[n.text] += 1
    return halstead_of(len(ops), len(args), sum(ops.values()), sum(args.values()))


def halstead_of(n1: int, n2: int, big1: int, big2: int) -> dict[str, float]:
    vocabulary = n1 + n2
    volume = (big1 + big2) * math.log2(vocabulary) if vocabulary >= 2 else 0.0
    difficulty = n1 / 2 * big2 / n2 if vocabulary >= 2 and n2 else 0.0
    return {"volume": volume, "difficulty": difficulty, "effort": volume * difficulty, "n1": n1, "n2": n2, "N1": big1, "N2": big2}


def cyclomatic(root: Node, text: str) -> dict[str, float]:
    """Decisions plus one a function, summed; without functions 1; density by lines that are not blank."""
    functions = sum(n.type in FUNCTION_TYPES for n in root.walk())
    decisions = sum(n.type in DECISION_TYPES for n in root.walk())
    nloc = sum(bool(x.strip()) for x in text.split("\n")) or text.count("\n") + 1
    complexity = functions + decisions if functions else 1
    return {"complexity": complexity, "nloc": nloc, "density": complexity / nloc}


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def wl_histogram(root: Node, rounds: int = WL_ROUNDS) -> list[float]:
    """Shares of the labels of all rounds in 64 bins; children's labels are sorted as decimal strings."""
    order = list(root.walk())
    depth = {id(root): 0}
    for n in order:
        for k in n.kids:
            depth[id(k)] = depth[id(n)] + 1
    label = {id(n): _digest(n.type) for n in order}
    bins = Counter(v % BINS for v in label.values())
    for _ in range(min(rounds, 5, max(max(depth.values()), 1))):
        label = {id(n): _digest(str(label[id(n)]) + "||" + "||".join(sorted(str(label[id(k)]) for k in n.kids))) for n in order}
        bins.update(v % BINS for v in label.values())
    total = sum(bins.values())
    return [bins[b] / total for b in range(BINS)]


def vector(node: Node, text: str) -> list[float]:
    h, c = halstead(node), cyclomatic(node, text)
    return [h["volume"], h["difficulty"], h["effort"], float(c["complexity"]), c["density"], *wl_histogram(node)]


# --- declarations ---

_CONST = re.compile(r"^[A-Z][A-Z_]*$")
_FIELD_BASES, _ENUM_BASES, _STUB_BASES, _CONFIG_BASES = {"TypedDict", "NamedTuple"}, {"Enum", "IntEnum", "StrEnum"}, {"Protocol"}, {"BaseModel"}


def _filled(lines: list[str], a: int, b: int) -> int:
    return sum(bool(x.strip()) for x in lines[a - 1 : b])


def _python_declarations(source: str) -> list[tuple[str, int, int, int]]:
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, out = source.split("\n"), []

    def name(n: ast.AST) -> set[str]:
        n = n.func if isinstance(n, ast.Call) else n.value if isinstance(n, ast.Subscript) else n
        full = ast.unparse(n)
        return {full, full.rsplit(".", 1)[-1]}

    idle = lambda n: isinstance(n, ast.Pass) or isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)
    stub = lambda n: isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and all(idle(x) or isinstance(x, ast.Expr) for x in n.body)
    span = lambda n: n.end_lineno - n.lineno + 1
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            deco, bases = {x for d in n.decorator_list for x in name(d)}, {x for b in n.bases for x in name(b)}
            kinds = [
                ("TYPE_DEFINITION", "dataclass" in deco or bool(bases & _FIELD_BASES), lambda x: isinstance(x, ast.AnnAssign)),
                ("TYPE_DEFINITION", bool(bases & _STUB_BASES), stub),
                ("ENUM_DECLARATION", bool(bases & _ENUM_BASES), lambda x: isinstance(x, ast.Assign)),
                ("CONFIG_MODEL", bool(bases & _CONFIG_BASES), lambda x: isinstance(x, (ast.AnnAssign, ast.Assign))),
            ]
            for kind, is_kind, counts in kinds:
                if is_kind:  # the first kind decides, even if the body does not fit
                    if all(counts(x) or idle(x) for x in n.body):
                        first = min([d.lineno for d in n.decorator_list] + [n.lineno])
                        count = len(n.decorator_list) + 1 + sum(span(x) for x in n.body if counts(x))
                        out.append((kind, first, n.end_lineno, min(count, n.end_lineno - first + 1)))
                    break
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
            if isinstance(target, ast.Name) and _CONST.match(target.id) and isinstance(n.value, ast.List) and n.value.elts and all(isinstance(e, ast.Dict) for e in n.value.elts):
                out.append(("CONST_TABLE", n.lineno, n.end_lineno, _filled(lines, n.lineno, n.end_lineno)))
    return out


#: How a top-level declaration of a bracket language begins: (kind, pattern of its first line, pattern that its body must not hold).
_BRACKET_RULES: dict[str, list[tuple[str, str, str | None]]] = {
    "javascript": [("CONST_TABLE", r"^(export\s+)?const\s+\w+\s*=\s*\[\s*(\{|$)", r"=>|\bfunction\b"), ("FIELD_ONLY_CLASS", r"^(export\s+(default\s+)?)?class\s+\w+", r"\)\s*\{")],
    "typescript": [
        ("TYPE_DEFINITION", r"^(export\s+)*(default\s+)?(interface|type)\s+\w+", None), ("ENUM_DECLARATION", r"^(export\s+)*(const\s+)?enum\s+\w+", r"=\s*[^,\n]*\("),
        ("CONST_TABLE", r"^(export\s+)*const\s+\w+[^=]*=\s*\[\s*(\{|$)", r"=>|\bfunction\b"),
    ],
    "go": [("TYPE_DEFINITION", r"^type\s+(\w+\s+struct|\()", None), ("ENUM_DECLARATION", r"^const\s*(\(|.*\biota\b)", None), ("CONST_TABLE", r"^var\s+\w+\s*=\s*[\[\]*\w.]*\{", r"\bfunc\b")],
    "rust": [
        ("CONST_TABLE", r"^(pub(\([^)]*\))?\s+)?(const|static)\s+\w+\s*:\s*&?(\'static\s+)?\[", None), ("ENUM_DECLARATION", r"^(pub(\([^)]*\))?\s+)?enum\s+\w+", r"[A-Za-z_]\w*\s*[({]\s*\w+[^\n]*\n"),
        ("TYPE_DEFINITION", r"^(pub(\([^)]*\))?\s+)?struct\s+\w+", None),
    ],
}


def _bracket_declarations(source: str, language: str) -> list[tuple[str, int, int, int]]:
    lines, out, k = source.split("\n"), [], 0
    while k < len(lines):
        for kind, begins, never in _BRACKET_RULES.get(language, []):
            if re.search(begins, lines[k]):
                depth, end = 0, k
                for j in range(k, len(lines)):
                    depth += sum(lines[j].count(c) for c in "{[(") - sum(lines[j].count(c) for c in "}])")
                    end = j
                    if depth <= 0:
                        break
                body = "\n".join(lines[k : end + 1])
                if not (never and re.search(never, body.split("{", 1)[-1] if kind == "ENUM_DECLARATION" else body)):
                    whole = language == "go"
                    out.append((kind, k + 1, end + 1, end - k + 1 if whole else max(_filled(lines, k + 1, end + 1), 1)))
                    k = end
                break
        k += 1
    return out


def code_lines(source: str, language: str) -> int:
    """Lines that are neither blank nor comment."""
    mark, block, inside, n = "#" if language in ("python", "ruby") else "//", language in ("javascript", "typescript", "go", "rust"), False, 0
    for x in map(str.strip, source.split("\n")):
        if block and inside:
            inside = "*/" not in x
        elif block and x.startswith("/*"):
            inside = "*/" not in x[2:]
        elif x and not x.startswith(mark):
            n += 1
    return n


def declarations(source: str, language: str) -> tuple[list[tuple[str, int, int, int]], float, bool, bool]:
    """Regions (kind, first, last, counted lines), their share of the code lines (at most 1), whether they dominate, and whether they are types only."""
    language = language.lower()
    found = _python_declarations(source) if language == "python" else _bracket_declarations(source, language)
    total = code_lines(source, language)
    share = min(1.0, sum(r[3] for r in found) / total) if total else 0.0
    dominant = share >= 0.6
    return found, share, dominant, dominant and all(r[0] in ("TYPE_DEFINITION", "ENUM_DECLARATION", "CONFIG_MODEL", "FIELD_ONLY_CLASS") for r in found)


# --- regions ---


def test_boundaries(root: Node | None, source: str, language: str) -> list[tuple[str, int, int]]:
    """(name, first, last) of test code: Python's Test classes and test functions at top level, Rust's cfg(test) modules with their attributes."""
    out = []
    if language == "python" and root is not None:
        for n in root.kids:
            inner = next((k for k in n.kids if k.type in ("class_definition", "function_definition")), n) if n.type == "decorated_definition" else n
            name = inner.child("identifier")
            if name and (inner.type == "class_definition" and name.text.startswith("Test") or inner.type == "function_definition" and name.text.startswith("test_")):
                out.append((name.text, n.start, n.end))
    if language == "rust":
        lines = source.split("\n")
        for m in re.finditer(r"^(?P<attributes>(?:#\[[^\n]*\]\s*\n)+)\s*(?:pub\s+)?mod\s+(?P<name>\w+)", source, re.M):
            if re.search(r"#\[\s*cfg\s*\(\s*test\s*\)\s*\]", m["attributes"]):
                first, depth, last = source.count("\n", 0, m.start()) + 1, 0, 0
                for j in range(source.count("\n", 0, m.start("name")), len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    last = j + 1
                    if depth <= 0 and "{" in "".join(lines[first - 1 : j + 1]):
                        break
                out.append((m["name"], first, last))
    return out


def regions(source: str, language: str) -> list[tuple[str, list[tuple[int, int]], str]]:
    """(label, spans, text) of production and test code, the one that begins first first; nothing without test code."""
    found = sorted(test_boundaries(syntax.parse(source, language), source, language.lower()), key=lambda b: b[1])
    if not found:
        return []
    lines, at, parts = source.split("\n"), 1, {"production": [], "test": []}
    for _, a, b in found:
        if at <= a - 1:
            parts["production"].append((at, a - 1))
        parts["test"].append((a, b))
        at = max(at, b + 1)
    if at <= len(lines):
        parts["production"].append((at, len(lines)))
    made = [(label, spans, "\n".join("\n".join(lines[a - 1 : b]) for a, b in spans)) for label, spans in parts.items() if spans]
    return sorted(made, key=lambda r: r[1][0][0])


# --- tables ---

Parser = Callable[[str, str], "Node | None"]


def unit_table(files: DataFrame, key: str, source: str = "source", language: str = "language", parse: Parser = syntax.parse) -> DataFrame:
    """A row a unit: its place, text, 69 features and a warning.  A file that cannot be parsed gives a row of zeros with a warning, never an error."""
    kind = dict(files.dtypes)[key]
    schema = f"{key} {kind}, unit_idx int, name string, start_line int, end_line int, unit_source string, features array<double>, partial_parse boolean, warning string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text, lang in zip(b[key], b[source], b[language], strict=True):
                text = text or ""
                root = parse(text, lang or "")
                if root is None:
                    rows.append((k, 0, "<module>", 1, text.count("\n") + 1, text, [0.0] * 69, False, WARN_UNSUPPORTED))
                    continue
                partial = any(n.error for n in root.walk())
                for i, (name, a, z, body, node) in enumerate(units(root, text)):
                    v = vector(node, body)
                    warning = WARN_PARTIAL if partial else WARN_EMPTY if v[0] == 0 else WARN_SHORT if z - a + 1 < LOW_LINES else None
                    rows.append((k, i, name, a, z, body, v, partial, warning))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in schema.split(", ")])

    return files.select(key, source, language).mapInPandas(run, schema)


def node_table(files: DataFrame, key: str, source: str = "source", language: str = "language", parse: Parser = syntax.parse) -> DataFrame:
    """A row a node: tree, node_id (in reading order), parent_id, child_idx, depth, type, n_children, text of leaves, lines, is_error."""
    kind = dict(files.dtypes)[key]
    schema = f"{key} {kind}, node_id int, parent_id int, child_idx int, depth int, type string, n_children int, text string, start_line int, end_line int, is_error boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        for b in batches:
            rows = []
            for k, text, lang in zip(b[key], b[source], b[language], strict=True):
                root = parse(text or "", lang or "")
                stack, n_id = [(root, None, 0, 0)] if root else [], 0
                while stack:
                    n, up, at, depth = stack.pop()
                    rows.append((k, n_id, up, at, depth, n.type, len(n.kids), n.text if not n.kids else "", n.start, n.end, n.error))
                    stack.extend((c, n_id, i, depth + 1) for i, c in reversed(list(enumerate(n.kids))))
                    n_id += 1
            out = pd.DataFrame(rows, columns=names)
            out["parent_id"] = out["parent_id"].astype("Int32")
            yield out

    return files.select(key, source, language).mapInPandas(run, schema)


def halstead_table(nodes: DataFrame, key: str) -> DataFrame:
    """Halstead counts of whole trees by aggregation over their nodes."""
    op = F.col("type").isin(sorted(OPERATOR_TYPES))
    arg = (F.col("n_children") == 0) & ~op & F.lower("type").rlike("|".join(OPERAND_PARTS))
    s = nodes.groupBy(key).agg(F.count_distinct(F.when(op, F.col("type"))).alias("n1"), F.count_distinct(F.when(arg, F.col("text"))).alias("n2"), F.count_if(op).alias("operators"), F.count_if(arg).alias("operands"))
    words = F.col("n1") + F.col("n2")
    volume = F.when(words >= 2, (F.col("operators") + F.col("operands")) * F.log2(words.cast("double"))).otherwise(0.0)
    difficulty = F.when((words >= 2) & (F.col("n2") > 0), F.col("n1") / 2 * F.col("operands") / F.col("n2")).otherwise(0.0)
    return s.withColumn("volume", volume).withColumn("difficulty", difficulty).withColumn("effort", F.col("volume") * F.col("difficulty"))


def declaration_table(files: DataFrame, key: str, source: str = "source", language: str = "language") -> DataFrame:
    """Per file: share of declarations, whether they dominate, whether they are types only, and the regions."""
    kind = dict(files.dtypes)[key]
    schema = f"{key} {kind}, ratio double, is_dominant boolean, is_pure_types boolean, regions array<struct<kind:string,start_line:int,end_line:int,lines:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text, lang in zip(b[key], b[source], b[language], strict=True):
                found, share, dominant, pure = declarations(text or "", lang or "")
                rows.append((k, share, dominant, pure, [dict(zip(("kind", "start_line", "end_line", "lines"), r, strict=True)) for r in found]))
            yield pd.DataFrame(rows, columns=[key, "ratio", "is_dominant", "is_pure_types", "regions"])

    return files.select(key, source, language).mapInPandas(run, schema)


def region_table(files: DataFrame, key: str, source: str = "source", language: str = "language") -> DataFrame:
    """A row a label: its order, first line and text, ready to be scored like a file."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, label, spans[0][0], body, lang) for k, text, lang in zip(b[key], b[source], b[language], strict=True) for i, (label, spans, body) in enumerate(regions(text or "", lang or ""))]
            yield pd.DataFrame(rows, columns=[key, "region_idx", "label", "start_line", "source", "language"])

    return files.select(key, source, language).mapInPandas(run, f"{key} {kind}, region_idx int, label string, start_line int, source string, language string")


def anti_patterns(unit: DataFrame, key: list[str]) -> DataFrame:
    """(key, name): much volume with a uniform tree; little branching with much difficulty."""
    from plumbline.functions.text_metrics import bin_entropy

    f = lambda i: F.get("features", F.lit(i))
    flat = bin_entropy(F.slice("features", 6, 64))
    names = F.array_compact(F.array(F.when((f(0) > 2000) & (flat < 3.0), "phantom_authorship"), F.when((f(4) < 0.02) & (f(1) > 30), "builders_trap")))
    return unit.select(*key, F.explode(names).alias("name"))


def evaluate_files(files: DataFrame, key: str, model=None, top: int = 3, source: str = "source", language: str = "language") -> DataFrame:
    """The whole evaluation: declarations and first unit of each file, projection and distance to the exemplars if there is a model, scores and decisions."""
    from plumbline.functions import scoring
    from plumbline.operators.evaluate import evaluate_texts
    from plumbline.operators.exemplars import nearest
    from plumbline.operators.model import project

    base = files.select(key, F.col(source).alias("source"), F.col(language).alias("language"))
    joined = base.join(declaration_table(base, key).select(key, "ratio", "is_dominant"), key)
    if model is None:
        return evaluate_texts(joined, key, "source", top, dominant="is_dominant")
    first = unit_table(base, key).where("unit_idx = 0").select(key, "features", "partial_parse")
    p = project(first, "features", model, F.col("partial_parse")).select(key, "l_drift", "l_virtue", "quality_flag")
    joined = joined.join(p, key, "left")
    ncd = None
    if model.exemplars:
        texts = files.sparkSession.createDataFrame(list(enumerate(model.exemplars)), "e int, t string")
        joined, ncd = joined.join(nearest(base, key, "source", texts, "e", "t"), key, "left"), "ncd"
    accept, reject = (d if v is None else v for v, d in ((model.accept, scoring.ACCEPT), (model.reject, scoring.REJECT)))
    return evaluate_texts(joined, key, "source", top, model.sigma_drift, model.sigma_virtue, "l_drift", "l_virtue", ncd, "is_dominant", accept, reject)


def samples(spark: SparkSession) -> DataFrame:
    """Small sources in several languages, for queries over code."""
    from plumbline.operators.code_samples import SAMPLES

    return spark.createDataFrame([(i, p, lang, s) for i, (p, lang, s) in enumerate(SAMPLES)], "file_id long, file_path string, language string, source string")
