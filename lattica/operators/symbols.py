"""Symbols of source files, resolution of imports and calls."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_pascal

#: A line's first match of its language gives the symbol.
PATTERNS = {
    "python": ((r"^class\s+(\w+)", "class"), (r"^(?:async\s+)?def\s+(\w+)", "func"), (r"^(?:import|from)\s+([\w.]+)", "import")),
    "go": ((r"^type\s+(\w+)\s+struct", "class"), (r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)", "func"), (r'^import\s+"([\w./]+)"', "import")),
    "java": ((r"^\s*(?:public|private|protected)?\s*(?:abstract\s+)?class\s+(\w+)", "class"), (r"^\s*(?:public|private|protected)?\s+\w+\s+(\w+)\s*\(", "func"), (r"^\s*import\s+([\w.]+)", "import")),
    "typescript": ((r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class"), (r"^(?:export\s+)?(?:async\s+)?function\s+(\w+)", "func"), (r"^import\s+.+\s+from\s+['\"](.+)['\"]", "import")),
}
#: First parts of imports that are no modules of a repository.
JAVA_SKIPPED = ("java", "javax", "sun", "android")


def extract_symbols(files: DataFrame) -> DataFrame:
    """path, language, kind, name, line of classes, functions and imports, by line patterns (path, language, content)."""
    lines = files.select("path", "language", F.posexplode(F.split("content", "\n", -1)).alias("pos", "text"))
    hit = None
    for language, rules in PATTERNS.items():
        for pattern, kind in rules:
            got = F.regexp_extract("text", pattern, 1)
            cond = (F.col("language") == language) & (got != "")
            value = F.struct(F.lit(kind).alias("kind"), got.alias("name"))
            hit = F.when(cond, value) if hit is None else hit.when(cond, value)
    return lines.withColumn("s", hit).where(F.col("s").isNotNull()).select("path", "language", "s.kind", "s.name", (F.col("pos") + 1).alias("line"))


def _members(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows = []

    def func(f, owner):
        args = ",".join(a.arg + (":" + ast.unparse(a.annotation) if a.annotation else "") for a in f.args.args)
        rows.append((path, "function", f.name, owner, f.lineno, args, ",".join(ast.unparse(d) for d in f.decorator_list), None))
        for c in ast.walk(f):
            if isinstance(c, ast.Call):
                attr = isinstance(c.func, ast.Attribute)
                name = c.func.attr if attr else getattr(c.func, "id", None)
                if name:
                    rows.append((path, "call", name, f"{owner}.{f.name}" if owner else f.name, c.lineno, str(len(c.args) + len(c.keywords)), None, ast.unparse(c.func.value).removeprefix("self.") if attr else None))

    for x in tree.body:
        if isinstance(x, ast.ClassDef):
            rows.append((path, "class", x.name, None, x.lineno, ",".join(ast.unparse(b) for b in x.bases), ",".join(ast.unparse(d) for d in x.decorator_list), None))
            for y in x.body:
                if isinstance(y, ast.FunctionDef | ast.AsyncFunctionDef):
                    func(y, x.name)
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            func(x, None)
    return rows


#: Rows that a task hands on at once.
ROWS = 1 << 13
MEMBERS = "path string, kind string, name string, owner string, line int, detail string, decorators string, receiver string"


def extract_members(files: DataFrame) -> DataFrame:
    """Classes (detail: bases), functions (detail: parameters) and calls (owner: caller, detail: argument count) of Python files."""

    def run(batches):
        rows: list[tuple] = []
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                rows += _members(p, c or "")
                # a batch of files holds many times as many members: no more than those of one file beyond ROWS are held
                while len(rows) >= ROWS:
                    yield pd.DataFrame(rows[:ROWS], columns=names)
                    rows = rows[ROWS:]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.col("language") == "python").select("path", "content").mapInPandas(run, MEMBERS)


def import_candidates(language, module, path):
    """Directories that an import may mean, best first, as array<string>."""
    parts = F.split(module, r"\.")
    upto = lambda p: F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(p, 1, n), "/"))
    here = F.regexp_replace(path, "/?[^/]*$", "")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    up = lambda d, n: F.when(n <= 0, d).otherwise(F.array_join(F.slice(F.split(d, "/"), 1, F.greatest(F.size(F.split(d, "/")) - n, F.lit(0))), "/"))
    base = up(here, dots - 1)
    tail = F.replace(F.regexp_replace(module, r"^\.+", ""), F.lit("."), F.lit("/"))
    relative = F.array(F.when(tail == "", base).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), tail)), base)
    py = F.when(dots > 0, relative).otherwise(upto(parts))
    go_parts = F.split(module, "/")
    go = F.when(module.contains("/"), F.transform(F.sequence(F.size(go_parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(go_parts, -n, n), "/")))
    steps = F.split(F.concat_ws("/", F.nullif(here, F.lit("")), module), "/")
    folded = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s.isin(".", ""), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    ts = F.when(module.startswith("./") | module.startswith("../"), F.array(F.array_join(folded, "/"), F.array_join(F.slice(folded, 1, F.greatest(F.size(folded) - 1, F.lit(0))), "/")))
    jp = F.split(F.regexp_replace(module, r"\.\*$", ""), r"\.")
    last2 = F.lower(F.array_join(F.slice(jp, -F.least(F.lit(2), F.size(jp)), F.lit(2)), "/"))
    java = F.when(~jp[0].isin(*JAVA_SKIPPED), F.concat(upto(jp), F.array(last2, F.lower(F.element_at(jp, -1)))))
    return F.coalesce(F.when(language == "python", py).when(language == "go", go).when(language.isin("typescript", "javascript"), ts).when(language == "java", java), F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module, target: the first candidate directory that is a module (column path); imports that resolve to none are left out."""
    c = imports.select("path", "module", F.posexplode(import_candidates(F.col("language"), F.col("module"), F.col("path"))).alias("pos", "target"))
    hit = c.join(modules.select(F.col("path").alias("target")).distinct(), "target")
    return hit.groupBy("path", "module").agg(F.min_by("target", "pos").alias("target"))


def module_deps(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct (src, dst) of modules that import one another."""
    r = resolve_imports(imports, modules)
    return r.select(F.regexp_replace("path", "/?[^/]*$", "").alias("src"), F.col("target").alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Distinct (src, dst) of functions (id, name, owner, seq) that call one another; calls: caller (id), receiver, callee.

    In order: the receiver's or caller's own Class.method, the method of the class that the last part
    of the receiver names in Pascal case, then as it stands, a bare function of that name (the last
    one registered), a name that is unique.
    """
    qualified = F.when(F.col("owner").isNull(), F.col("name")).otherwise(F.concat_ws(".", "owner", "name"))
    keyed = functions.select("id", "name", "owner", "seq", qualified.alias("q"))
    exact = keyed.groupBy(F.col("q").alias("key")).agg(F.max_by("id", "seq").alias("to"))
    unique = keyed.groupBy(F.concat(F.lit("~"), "name").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("to")).where("n = 1").drop("n")
    index = exact.union(unique)
    own = calls.join(functions.select(F.col("id").alias("caller"), F.col("owner").alias("caller_owner")), "caller")
    first = F.when(F.col("receiver").isin("self", "this", "cls"), F.concat_ws(".", "caller_owner", "callee")).when(F.col("receiver").isNotNull(), F.concat_ws(".", "receiver", "callee")).otherwise(F.col("callee"))
    nearest = F.element_at(F.split("receiver", r"\."), -1)
    pascal = F.when(F.col("receiver").isNotNull(), F.concat_ws(".", to_pascal(nearest), "callee"))
    named = F.when(F.col("receiver").contains("."), F.concat_ws(".", nearest, "callee"))
    keys = own.select("caller", "callee", "receiver", F.posexplode(F.array(first, pascal, named, F.concat(F.lit("~"), "callee"))).alias("pos", "key")).where(F.col("key").isNotNull())
    hit = keys.join(index, "key").groupBy("caller", "callee", "receiver").agg(F.min_by("to", "pos").alias("dst"))
    return hit.select(F.col("caller").alias("src"), "dst").where(F.col("src") != F.col("dst")).distinct()


def type_annotation_match(annotations: DataFrame, components: DataFrame) -> DataFrame:
    """src, dst: the first component (id, name, seq) whose name is a whole word of an annotation (src, annotation)."""
    w = annotations.select("src", "annotation", F.explode(F.regexp_extract_all("annotation", F.lit(r"(\w+)"), 1)).alias("name"))
    return w.join(components, "name").groupBy("src", "annotation").agg(F.min_by("id", "seq").alias("dst")).select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
