"""Symbols, references and module names from Python source files."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versioned import restaged, staged

ROW = "kind string, name string, local string, owner string, signature string, start int, stop int, target string, binding string"


def entity_id(kind: Column | str, *parts: Column) -> Column:
    """A stable id: the kind, and a digest of the parts that make the entity what it is."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    body = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat_ws(":", kind, F.substring(F.sha2(F.concat_ws("\u0000", kind, body), 256), 1, 32))


def module_names(files: DataFrame, path: str = "path") -> DataFrame:
    """``(path, module)``: the dotted module where an unbroken chain of packages leads to the file, otherwise null.

    A folder with an ``__init__.py`` is a package. Every folder above a file is one row, joined with the packages; the
    chain reaches up to the last folder that is none.
    """
    one = files.select(path).filter(F.col(path).isNotNull()).distinct()
    parts = F.split(path, "/")
    packages = one.filter(F.element_at(parts, -1) == "__init__.py").select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder")).distinct().withColumn("package", F.lit(True))
    above = one.filter(F.size(parts) > 1).select(path, F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")).withColumn("folder", F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.col("n")), "/"))
    broken = above.join(packages, "folder", "left").groupBy(path).agg(F.max(F.when(F.col("package").isNull(), F.col("n")).otherwise(0)).alias("last"))
    tail = F.slice(parts, F.col("last") + 1, F.size(parts))
    tail = F.transform(tail, lambda x: F.regexp_replace(x, r"\.py$", ""))
    named = F.array_join(F.filter(tail, lambda x: x != "__init__"), ".")
    return one.join(broken, path, "left").select(path, F.when(F.col("last") < F.size(parts) - 1, named).alias("module"))


def relative_module(level: int, tail: str | None, module: str, package: bool) -> str | None:
    """The module that a relative import names; None if it leads out of the top package."""
    if not level:
        return tail
    above = module.split(".") if package else module.split(".")[:-1]
    if level > len(above):
        return None
    return ".".join(above[: len(above) - level + 1] + ([tail] if tail else []))


class _Receiver(str):
    """The class whose instance (or itself) the first parameter of a method is."""


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_SCOPES = (*_FUNCTIONS, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)


def _bound_names(body: list) -> dict[str, tuple[int, bool]]:
    """How often each name is bound in a scope, and whether in a branch; nested scopes bind only their own names."""
    found: dict[str, tuple[int, bool]] = {}
    foreign: set[str] = set()
    todo = [(n, False) for n in body]
    while todo:
        node, branch = todo.pop()
        names = []
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            names = [node.name]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.asname or a.name.split(".")[0] for a in node.names]
        elif isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
            names = [node.id]
        elif isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)):
            names = [node.name] if node.name else []
        elif isinstance(node, ast.MatchMapping):
            names = [node.rest] if node.rest else []
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            foreign.update(node.names)
        for name in names:
            n, b = found.get(name, (0, False))
            found[name] = (n + 1, b or branch)
        if isinstance(node, _SCOPES):
            continue
        inside = branch or isinstance(node, _BRANCHES)
        if isinstance(node, _COMPREHENSIONS):  # targets are the comprehension's own; only := binds outside
            todo += [(x, inside) for x in ast.walk(node) if isinstance(x, ast.NamedExpr)]
            continue
        todo += [(x, inside) for x in ast.iter_child_nodes(node)]
    return {k: v for k, v in found.items() if k not in foreign}


class _Scope:
    """What names mean in a scope: a full name, a receiver, or None for what cannot be told."""

    def __init__(self, kind: str, body: list, params: list[str] = ()):
        self.kind, self.bound, self.now = kind, _bound_names(body), {}
        if kind == "function":  # a name that is bound anywhere in a function is its own everywhere in it
            self.now = dict.fromkeys([*self.bound, *params])

    def bind(self, name: str, target: str | None) -> None:
        n, branch = self.bound.get(name, (1, False))
        # of several bindings of which one is in a branch, the text does not tell which one holds
        self.now[name] = None if n > 1 and branch else target

    def later(self, name: str) -> str | None:
        """What the name means to a function that is called some time: only a single binding can be told."""
        return self.now[name] if self.bound.get(name, (1, False))[0] == 1 else None


class _Reader:
    """Declarations and references of one module in order; names resolve in the scopes around them.

    The tree is walked with a stack of its own: a handler yields the nodes below it, so no source is too deep.
    """

    def __init__(self, module: str, package: bool):
        self.module, self.package, self.rows = module, package, []
        self.owners: list[tuple[str, str]] = [(module, "module")]
        self.scopes: list[_Scope] = []
        self.starred = False

    def read(self, tree: ast.Module) -> list[dict]:
        top = _Scope("module", tree.body)
        for node in ast.walk(tree):  # what a function may bind anew at any time
            for name in node.names if isinstance(node, ast.Global) else ():
                top.bound[name] = (top.bound.get(name, (0, True))[0] + 1, True)
        for node in tree.body:  # names of the module are known everywhere in it
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and top.bound[node.name][0] == 1:
                top.now[node.name] = f"{self.module}.{node.name}"
        self.scopes.append(top)
        stack = [iter(tree.body)]
        while stack:
            node = next(stack[-1], None)
            if node is None:
                stack.pop()
            else:
                stack.append(self._below(node))
        return self.rows

    def _below(self, node: ast.AST) -> Iterator[ast.AST]:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            return self._declare(node)
        if isinstance(node, ast.Lambda):
            return self._lambda(node)
        if isinstance(node, _COMPREHENSIONS):
            return self._comprehension(node)
        if isinstance(node, ast.Import):
            self._import(node)
        elif isinstance(node, ast.ImportFrom):
            self._import_from(node)
        elif isinstance(node, ast.Call):
            self._call(node)
        elif isinstance(node, ast.Name) and isinstance(node.ctx, (ast.Store, ast.Del)):
            self.scopes[-1].bind(node.id, None)
        elif isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) and node.name:
            self.scopes[-1].bind(node.name, None)
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)):  # the value is read before its name is bound
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            return iter([*(x for x in ast.iter_child_nodes(node) if x not in targets), *targets])
        return ast.iter_child_nodes(node)

    def _add(self, kind: str, name: str, node: ast.AST, **more) -> None:
        self.rows.append({"kind": kind, "name": name, "owner": self.owners[-1][0], "start": node.lineno, "stop": node.end_lineno} | more)

    def _declare(self, node) -> Iterator[ast.AST]:
        owner, owner_kind = self.owners[-1]
        name = f"{owner}.{node.name}"
        if isinstance(node, ast.ClassDef):
            kind, signature = "class", f"({', '.join(map(_source, node.bases))})"
            for base in node.bases:
                target = self._dotted(base)
                if target:
                    self._add("INHERITS", name, base, target=target)
            outside = [*node.bases, *node.keywords]
        else:
            kind = "method" if owner_kind == "class" else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            signature = f"({_source(node.args)})"
            outside = [*node.args.defaults, *filter(None, node.args.kw_defaults)]
        self._add(kind, name, node, local=node.name, signature=signature)
        yield from [*node.decorator_list, *outside]
        self.scopes[-1].bind(node.name, name)
        scope = _Scope("class", node.body) if kind == "class" else _Scope("function", node.body, _parameters(node.args))
        first = next((a.arg for a in [*node.args.posonlyargs, *node.args.args]), None) if kind == "method" else None
        if first and first not in scope.bound and not any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list):
            scope.now[first] = _Receiver(owner)
        self.owners.append((name, kind))
        self.scopes.append(scope)
        yield from node.body
        self.scopes.pop()
        self.owners.pop()

    def _lambda(self, node: ast.Lambda) -> Iterator[ast.AST]:
        yield from [*node.args.defaults, *filter(None, node.args.kw_defaults)]
        self.scopes.append(_Scope("function", [node.body], _parameters(node.args)))
        yield node.body
        self.scopes.pop()

    def _comprehension(self, node) -> Iterator[ast.AST]:
        yield node.generators[0].iter
        own = {x.id for g in node.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
        self.scopes.append(_Scope("function", [], sorted(own)))
        for k, g in enumerate(node.generators):
            yield from [*([g.iter] if k else []), *g.ifs]
        yield from [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
        self.scopes.pop()

    def _bind(self, node: ast.AST, target: str | None, binding: str) -> None:
        self.scopes[-1].bind(binding, target)
        if target:
            self._add("IMPORTS", self.owners[-1][0], node, target=target, binding=binding)

    def _import(self, node: ast.Import) -> None:
        for a in node.names:
            first = a.name.split(".")[0]
            self._bind(node, a.name, a.asname or first)
            if not a.asname:
                self.scopes[-1].bind(first, first)

    def _import_from(self, node: ast.ImportFrom) -> None:
        base = relative_module(node.level, node.module, self.module, self.package)
        for a in node.names:
            if a.name == "*":
                self.starred = True
                if base:
                    self._add("IMPORTS", self.owners[-1][0], node, target=base, binding="*")
            else:
                self._bind(node, base and f"{base}.{a.name}", a.asname or a.name)

    def _call(self, node: ast.Call) -> None:
        self._add("CALLS", self.owners[-1][0], node, target=self._dotted(node.func), local=_chain(node.func))

    def _dotted(self, node: ast.AST) -> str | None:
        """The full name that an expression means as far as it can be told.

        An attribute of a method's first parameter is the class's own, one of a call ``A()`` is that of what it calls.
        Names that a parameter, an assignment, a loop or a second import may have bound mean nothing.
        """
        names: list[str] = []
        called = False
        while isinstance(node, (ast.Attribute, ast.Call)):
            if isinstance(node, ast.Attribute):
                names.insert(0, node.attr)
                node = node.value
            elif not names or called:  # what a result's method returns is not known
                return None
            else:
                node, called = node.func, True
        if not isinstance(node, ast.Name):
            return None
        found = self._lookup(node.id)
        if found is None or (isinstance(found, _Receiver) and not names):
            return None
        return ".".join([found, *names])

    def _lookup(self, name: str) -> str | None:
        own = self.scopes[-1]
        if name in own.now:
            return own.now[name]
        called_later = own.kind == "function"
        for scope in reversed(self.scopes[:-1]):
            if scope.kind != "class" and name in scope.now:  # a class's names are not seen from its methods
                return scope.later(name) if called_later else scope.now[name]
            called_later |= scope.kind == "function"
        # bound in the module further down: nothing yet for its own statements, a name of its own for functions
        if any(name in s.bound for s in self.scopes if s.kind != "class"):
            return None
        return f"{self.module}.{name}" if self.starred and not hasattr(builtins, name) else name


def _parameters(args: ast.arguments) -> list[str]:
    return [a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]]


def _source(node: ast.AST) -> str:
    try:
        return ast.unparse(node)
    except RecursionError:
        return "..."


def _chain(node: ast.AST) -> str | None:
    """A call's name as it is written, the part after anything that is no name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *names] if isinstance(node, ast.Name) else names) or None


def read_python(source: str | None, module: str, package: bool) -> list[dict]:
    """Rows of one file; a file that does not parse has one row of kind ``error``."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"kind": "error", "name": module, "start": getattr(e, "lineno", None) or 1, "signature": type(e).__name__}]
    return _Reader(module, package).read(tree)


def extract(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """Declarations and references of Python files: a row each, with the file's path and module.

    A file without a package chain is a module of its own stem. Each file is read by itself; null sources are empty,
    rows without a path are left out. A call whose target cannot be told has a null ``target`` and its name as written in
    ``local``; a star import binds ``*``.
    """
    named = files.select(path, source).filter(F.col(path).isNotNull()).join(module_names(files, path), path)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.py$", "")
    named = named.select(F.col(path).alias("path"), F.coalesce("module", stem).alias("module"), F.endswith(path, F.lit("__init__.py")).alias("package"), F.col(source).alias("source"))
    # Files are small and parsing is slow: without a number Spark puts thousands of files into one task by their bytes, and
    # by the path alone the repartition is left out, as the join has dealt by it.
    named = named.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "module")
    columns = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2
        for b in batches:
            paths, modules, packages, sources = (c.to_pylist() for c in b.columns)
            rows = [(p, m, r) for p, m, k, s in zip(paths, modules, packages, sources, strict=True) for r in read_python(s, m, k)]
            arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())]
            arrays += [pa.array([r[2].get(c) for r in rows], t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "module", *columns])

    return named.mapInArrow(run, f"path string, module string, {ROW}")


def symbols(extracted: DataFrame) -> DataFrame:
    """Declared symbols, once each, with a stable id.

    Equal ids are of one file, so rows are dealt out by files: a file's rows stay together, which compresses well.
    """
    own = extracted.filter(F.col("kind").isin("class", "function", "async_function", "method")).select("kind", "path", "name", "local", "signature", "start", "stop").repartition("path")
    out = own.select(entity_id("symbol", F.col("path"), F.col("name"), F.col("signature")).alias("entity_id"), "kind", "path", F.col("name").alias("qualified_name"), F.col("local").alias("local_name"), "signature", F.when(F.startswith("local", F.lit("_")), "private").otherwise("public").alias("visibility"), "start", "stop")
    return out.dropDuplicates(["path", "entity_id"])


def references(extracted: DataFrame) -> DataFrame:
    """Imports, calls and bases as unresolved relations with a stable id, dealt out by files like ``symbols``."""
    own = extracted.filter(F.col("kind").isin("IMPORTS", "CALLS", "INHERITS")).select("kind", "path", "name", "local", "target", "start", "binding").repartition("path")
    key = [F.col("path"), F.col("name"), F.coalesce("target", F.concat(F.lit("?"), "local")), F.col("start"), F.col("binding")]
    out = own.select("path", entity_id("relation", F.col("kind"), *key).alias("ref_id"), F.col("kind").alias("relation_type"), F.col("name").alias("source"), "target", "start", "binding")
    return out.dropDuplicates(["path", "ref_id"]).drop("path")


def overridable_calls(refs: DataFrame, declared: DataFrame) -> DataFrame:
    """Calls of a method that a subclass of its class overrides, so that the target is not certain: ``(ref_id, overrides)``.

    The subclasses are the closure of INHERITS. A round joins the paths found so far with each other, so their length
    doubles, until there is no new pair; every round is a table in the shared folder. Cycles add no pair twice.
    """
    closure = staged(refs.filter("relation_type = 'INHERITS' and target is not null").select(F.col("target").alias("base"), F.col("source").alias("sub")).distinct())
    while True:
        longer = closure.join(closure.select(F.col("base").alias("sub"), F.col("sub").alias("lower")), "sub").select("base", F.col("lower").alias("sub"))
        found = staged(longer.join(closure, ["base", "sub"], "left_anti").distinct())
        if found.isEmpty():
            break
        closure = restaged(closure.union(found), closure, found)
    calls = refs.filter("relation_type = 'CALLS' and target is not null").select("ref_id", F.regexp_extract("target", r"^(.*)\.[^.]+$", 1).alias("base"), F.element_at(F.split("target", r"\."), -1).alias("method"))
    lower = calls.join(closure.filter("base <> sub"), "base").select("ref_id", F.concat_ws(".", "sub", "method").alias("qualified_name"))
    return lower.join(declared.filter("kind = 'method'").select("qualified_name").distinct(), "qualified_name").groupBy("ref_id").agg(F.count("*").alias("overrides"))


def alias_bindings(extracted: DataFrame, declared: DataFrame) -> DataFrame:
    """``(name, target)``: the full name of each name that a module's imports bind in it, and what it stands for.

    A star import binds each public name that the module it names declares; those that it has by a star import itself
    are reached by another turn of ``resolve_aliases``, as the pair (module ``*``, module ``*``).
    """
    own = extracted.filter("kind = 'IMPORTS' and name = module")
    plain = own.filter("binding <> '*' and target <> concat_ws('.', module, binding)").select(F.concat_ws(".", "module", "binding").alias("name"), "target")
    stars = own.filter("binding = '*'").select("module", F.col("target").alias("of"))
    public = declared.filter("visibility = 'public' and kind <> 'method'").select(F.regexp_extract("qualified_name", r"^(.*)\.[^.]+$", 1).alias("of"), "local_name")
    bound = own.filter("binding <> '*' and not startswith(binding, '_')").select(F.col("module").alias("of"), F.col("binding").alias("local_name"))
    reach = staged(stars.filter("module <> of").distinct())
    while True:  # which modules' names a star import brings in, over chains of star imports
        longer = reach.join(reach.select(F.col("module").alias("of"), F.col("of").alias("far")), "of").select("module", F.col("far").alias("of")).filter("module <> of")
        found = staged(longer.join(reach, ["module", "of"], "left_anti").distinct())
        if found.isEmpty():
            break
        reach = restaged(reach.union(found), reach, found)
    if reach.isEmpty():  # without star imports no declaration is asked for
        return plain.distinct()
    starred = reach.join(public.union(bound).distinct(), "of").select(F.concat_ws(".", "module", "local_name").alias("name"), F.concat_ws(".", "of", "local_name").alias("target"))
    shadowed = plain.select("name").union(declared.select(F.col("qualified_name").alias("name")))
    return plain.union(starred.join(shadowed, "name", "left_anti")).distinct()


def _longest(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """``(key, hit)``: the row of ``names(name, ..)`` whose name is the longest dotted prefix of a row's ``target``.

    Prefixes are told apart first and names kept that are one. Both are tables, whose sizes Spark knows: as long as the
    names that are hit are few, the prefixes of all rows meet them where they are and are not shuffled.
    """
    cut = F.explode(F.sequence(F.lit(1), F.size(F.split("target", r"\."))))
    via = F.array_join(F.slice(F.split("target", r"\."), F.lit(1), F.col("_n")), ".")
    asked = staged(rows.filter("target is not null").select("target", cut.alias("_n")).select(via.alias("_via")).distinct())
    hits = staged(names.join(asked, F.col("name") == F.col("_via"), "left_semi"))
    prefixes = rows.filter("target is not null").select(key, "target", cut.alias("_n")).select(key, "_n", via.alias("_via"))
    found = prefixes.join(hits.select(F.struct(*names.columns).alias("_hit"), F.col("name").alias("_via")), "_via")
    return found.groupBy(key).agg(F.max_by("_hit", "_n").alias("hit"))


def _circular(links: DataFrame) -> DataFrame:
    """Names of ``links(name, via)`` whose chain never ends.

    Only names that others point to make up the way of a chain; the others go round if what they point to does. A round
    doubles how far a pointer reaches and leaves out names whose chain ends before. A chain of some length has names of
    every shorter length, so once a round leaves out none, those that are left go round in circles.
    """
    links = staged(links)
    passed = staged(links.select(F.col("via").alias("name")).distinct())
    ends = staged(links.join(passed, "name", "left_semi"))
    before, now = None, ends.count()
    while now and now != before:
        onward = ends.select(F.col("name").alias("via"), F.col("via").alias("far"))
        ends = restaged(ends.join(onward, "via").select("name", F.col("far").alias("via")), ends)
        before, now = now, ends.count()
    round_ = ends.select(F.col("name").alias("via"))
    return links.join(round_, "via", "left_semi").select("name")


def resolve_aliases(bindings: DataFrame) -> DataFrame:
    """``(name, target, state)``: what each name of ``bindings(name, target)`` stands for in the end.

    A name points to another, of which it may be a part (to ``pkg.tool.run`` where ``pkg.tool`` is an alias too). Pointers
    jump: a round replaces each by the pointer of what it points to, so chains halve, until none changes; every round is
    a table in the shared folder. A name bound to several targets is ``ambiguous``, one whose chain comes back to itself
    a ``cycle``; both keep the (first) target as written, and a name that leads to one takes its state. The others are
    ``resolved``. Nulls and names that stand for themselves are left out.
    """
    own = bindings.filter("name is not null and target is not null and name <> target")
    written = staged(own.groupBy("name").agg(F.min("target").alias("target"), F.when(F.min("target") < F.max("target"), "ambiguous").otherwise("open").alias("state")))
    first, total = written.select("name", F.col("target").alias("first")), written.count()
    links = _longest(written.filter("state = 'open'"), "name", written.select("name")).select("name", F.col("hit.name").alias("via"))
    circular = _circular(links).withColumn("circular", F.lit(True))
    state = F.when(F.col("circular"), "cycle").otherwise(F.col("state"))
    pointers = staged(written.join(circular, "name", "left").select("name", "target", state.alias("state"), F.lit(1).cast("long").alias("hops")))
    while not pointers.filter("state = 'open'").isEmpty():
        hits = _longest(pointers.filter("state = 'open'"), "name", pointers)
        moves = F.col("hit.state").isin("open", "resolved")
        hops = F.col("hops") + F.coalesce("hit.hops", F.lit(0))
        jumped = pointers.filter("state = 'open'").join(hits, "name", "left").select(
            "name",
            F.when(moves, F.concat("hit.target", F.substr(F.col("target"), F.length("hit.name") + 1))).otherwise(F.col("target")).alias("target"),
            # a chain of more steps than there are names comes back to one, by the parts that it has gathered
            F.when(F.col("hit").isNull(), "resolved").when(~moves, F.col("hit.state")).when(hops > total, "cycle").otherwise("open").alias("state"),
            hops.alias("hops"),
        )
        pointers = restaged(jumped.unionByName(pointers.filter("state <> 'open'")), pointers)
    target = F.when(F.col("state") == "resolved", F.col("target")).otherwise(F.col("first"))
    return pointers.join(first, "name").select("name", target.alias("target"), "state")


def dealiased(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """``references(ref_id, target)`` with the longest alias that a target begins with replaced by what it stands for.

    ``aliases`` are those of ``resolve_aliases``; targets that lead to a cycle or to several names become null.
    """
    hits = _longest(references, "ref_id", aliases)
    through = F.when(F.col("hit.state") == "resolved", F.concat("hit.target", F.substr(F.col("target"), F.length("hit.name") + 1)))
    return references.join(hits, "ref_id", "left").withColumn("target", F.when(F.col("hit").isNull(), F.col("target")).otherwise(through)).drop("hit")
