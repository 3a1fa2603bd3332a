"""Taint as relations: definitions, uses, arguments, returns and imports are rows, and taint is a fixpoint over their joins.

Every definition of a variable is a node. A use joins the last definition before it, in its function, else at the top
of its file, else in the file that it is imported from. Arguments lead to parameters and returns to callers, in the
same file or through imports. Joins are hinted to sort and merge: names compress well, so what looks small enough to
broadcast may not fit the driver. A fact is a node with a label, the kind of sink that it is still dangerous for, and keeps
the best confidence and its source. Each round joins only the facts that got better with the edges, until none does.
Labels of one node that share a fact are one row, as bits. Sinks lead nowhere, so they meet the facts once, at the end.
Steps are stored as compressed columns and deleted when the next ones stand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graphs import Steps
from quarry.operators.projects import resolve_modules
from quarry.sources import python_flows

SINKS = {"execute": "SQL-value", "executemany": "SQL-value", "system": "CMD-argument", "popen": "CMD-argument", "run": "CMD-argument", "eval": "CODE-execution", "exec": "CODE-execution", "render_template_string": "HTML-content", "open": "FILE-path"}
SOURCES = ("input", "request.args", "request.form", "request.json", "request.values", "request.data", "sys.argv", "os.environ")
SANITIZERS = {"int": set(SINKS.values()), "float": set(SINKS.values()), "quote": {"CMD-argument"}, "escape": {"HTML-content"}, "basename": {"FILE-path"}, "secure_filename": {"FILE-path"}}
#: What a call, a return or an import leaves of a confidence, and what a flow has whose sanitiser took the sink's label.
HOP, SANITIZED = 0.75, 0.3
#: The label that no sanitiser takes: it follows flows that are safe.
ANY = "*"
LABELS = (*sorted(set(SINKS.values())), ANY)
BITS = {label: 1 << i for i, label in enumerate(LABELS)}


def _names(flows: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of variable uses (path, scope, src, seq -> node, far), and scopes of called names (path, name -> to_path, to_scope).

    `far` is true where the definition is in another file. `imports` has path, alias, symbol and target_file.
    """
    defs = flows.where("dst_kind IN ('def', 'param') AND dst <> ''").select("path", "scope", F.col("dst").alias("name"), "seq").distinct()
    uses = flows.where("src_kind = 'var'").select("path", "scope", F.col("src").alias("name"), "seq").distinct()
    both = defs.select("*", F.lit(1).alias("own"), F.col("seq").alias("at")).unionByName(uses.select("*", F.lit(0).alias("own"), F.lit(None).cast("int").alias("at")))
    before = Window.partitionBy("path", "scope", "name").orderBy("seq", "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("at", F.last("at", ignorenulls=True).over(before)).where("own = 0").drop("own")
    top = defs.where("scope = ''").groupBy("path", "name").agg(F.max("seq").alias("top"))
    met = met.join(top.hint("merge"), ["path", "name"], "left")
    exported = imports.join(top.select(F.col("path").alias("target_file"), F.col("name").alias("symbol"), F.col("top").alias("there")).hint("merge"), ["target_file", "symbol"])
    exported = exported.groupBy("path", F.col("alias").alias("name")).agg(F.max_by(F.struct("target_file", "symbol", "there"), "line").alias("far"))
    met = met.join(exported.hint("merge"), ["path", "name"], "left")
    node = F.coalesce(_node("path", "scope", "name", "at"), F.when(F.col("scope") != "", _node("path", F.lit(""), "name", "top")), _node("far.target_file", F.lit(""), "far.symbol", "far.there"))
    is_far = F.col("at").isNull() & ((F.col("scope") == "") | F.col("top").isNull())
    uses = met.select("path", "scope", F.col("name").alias("src"), "seq", node.alias("node"), is_far.alias("far")).where("node IS NOT NULL")

    functions = flows.where("dst_kind = 'param' AND pos = -1").groupBy("path", F.col("label").alias("name")).agg(F.max_by("scope", "line").alias("to_scope"))
    called = flows.where("dst_kind = 'arg'").select("path", F.col("dst").alias("name")).union(flows.where("src_kind = 'call'").select("path", F.col("src").alias("name"))).distinct()
    called = called.withColumn("last", F.element_at(F.split("name", r"\."), -1)).withColumn("head", F.regexp_replace("name", r"\.?[^.]*$", ""))
    here = called.join(functions.withColumnRenamed("name", "last").hint("merge"), ["path", "last"]).select("path", "name", F.col("path").alias("to_path"), "to_scope", F.lit(0).alias("rank"))
    there = functions.select(F.col("path").alias("target_file"), F.col("name").alias("function"), "to_scope")
    by_symbol = called.join(imports.where("symbol IS NOT NULL").select("path", F.col("alias").alias("name"), F.col("symbol").alias("function"), "target_file").hint("merge"), ["path", "name"])
    by_module = called.join(imports.where("symbol IS NULL").select("path", F.col("alias").alias("head"), "target_file").hint("merge"), ["path", "head"]).withColumn("function", F.col("last"))
    away = by_symbol.select("path", "name", "function", "target_file").unionByName(by_module.select("path", "name", "function", "target_file"))
    away = away.join(there.hint("merge"), ["target_file", "function"]).select("path", "name", F.col("target_file").alias("to_path"), "to_scope", F.lit(1).alias("rank"))
    scopes = here.unionByName(away).groupBy("path", "name").agg(F.min(F.struct("rank", "to_path", "to_scope")).alias("to"))
    return uses, scopes.select("path", "name", "to.to_path", "to.to_scope")


def _node(path, scope, name, seq) -> Column:
    """A definition's name; null where any part is."""
    part = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(part(path), F.lit("#"), part(scope), F.lit("#"), part(name), F.lit("#"), part(seq).cast("string"))


def edges_of(flows: DataFrame, imports: DataFrame, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, sinks): src, dst, factor, cleaned, by, and for seeds (no src) source, path, line; sinks are edges into a sink call
    at path, line, with sink and label. What is stored on the way goes to `steps`."""
    steps = steps or Steps(flows.sparkSession)
    uses, scopes = _names(flows, imports)
    uses, scopes = steps.keep(uses), steps.keep(scopes)
    calls = scopes.select("path", F.col("name").alias("src"), F.concat("to_path", F.lit("#"), "to_scope", F.lit("#ret")).alias("returned"))
    args = scopes.select("path", F.col("name").alias("dst"), "to_path", "to_scope")
    params = flows.where("dst_kind = 'param' AND pos >= 0").select(F.col("path").alias("to_path"), F.col("scope").alias("to_scope"), "pos", _node("path", "scope", "dst", "seq").alias("param"))
    rows = flows.where("src_kind <> 'none'")
    var = rows.where("src_kind = 'var'").join(uses.hint("merge"), ["path", "scope", "src", "seq"]).withColumn("factor", F.when(F.col("far"), HOP).otherwise(1.0)).drop("far")
    call = rows.where("src_kind = 'call'").join(calls.hint("merge"), ["path", "src"]).withColumnRenamed("returned", "node").withColumn("factor", F.lit(HOP))
    seed = rows.where("src_kind = 'source'").withColumn("node", F.lit(None).cast("string")).withColumn("factor", F.col("confidence"))
    begun = steps.keep(var.unionByName(call).unionByName(seed))
    arg = begun.where("dst_kind = 'arg'").join(args.hint("merge"), ["path", "dst"]).join(params.hint("merge"), ["to_path", "to_scope", "pos"]).withColumn("to", F.col("param")).withColumn("factor", F.col("factor") * HOP)
    to = F.when(F.col("dst_kind") == "def", _node("path", "scope", "dst", "seq")).otherwise(F.concat("path", F.lit("#"), "scope", F.lit("#ret")))
    plain = begun.where("dst_kind IN ('def', 'ret')").withColumn("to", to)
    sink_node = F.concat("path", F.lit("#"), "scope", F.lit("#sink#"), "dst", F.lit("#"), F.col("line").cast("string"), F.lit("#"), F.col("seq").cast("string"))
    ends = begun.where("dst_kind = 'sink'").withColumn("to", sink_node)
    kept = [F.col("node").alias("src"), F.col("to").alias("dst"), "factor", "cleaned", "by", F.col("src").alias("source"), "path", "line"]
    return plain.select(*kept).unionByName(arg.select(*kept)), ends.select(*kept, F.col("dst").alias("sink"), "label")


def _bits(labels: Column) -> Column:
    """The bits of all labels that these are not."""
    return sum((F.when(F.array_contains(labels, x), 0).otherwise(bit) for x, bit in BITS.items()), F.lit(0))


def _fact(confidence, path, line, source, by) -> Column:
    """Facts compare by confidence, the highest first, then by place."""
    return F.struct((-F.round(confidence, 6)).alias("lost"), path.alias("source_path"), line.alias("source_line"), source.alias("source"), by.alias("by")).alias("best")


def _begun(edges: DataFrame, *more: str) -> DataFrame:
    """Facts of the edges without src, at their dst: node, labels, best."""
    c = F.col
    return edges.where("src IS NULL").select(c("dst").alias("node"), _bits(c("cleaned")).alias("labels"), _fact(c("factor"), c("path"), c("line"), c("source"), c("by")), *more)


def _led(facts: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """Facts (node, labels, best) led along the edges with src: node, labels, best; those without any label left are gone."""
    b = F.col("best")
    steps = edges.where("src IS NOT NULL").select(F.col("src").alias("from"), "dst", "factor", _bits(F.col("cleaned")).alias("passed"), F.col("by").alias("then"), *more)
    led = facts.join(steps.hint("merge"), facts["node"] == steps["from"])
    fact = _fact(-b["lost"] * F.col("factor"), b["source_path"], b["source_line"], b["source"], F.array_distinct(F.concat(b["by"], F.col("then"))))
    return led.select(F.col("dst").alias("node"), F.col("labels").bitwiseAND(F.col("passed")).alias("labels"), fact, *more).where("labels <> 0")


def _best(old: DataFrame | None, come: DataFrame) -> DataFrame:
    """The best fact of each node and label, labels with one fact as one row: node, labels, best, and `fresh`, the labels that got it from `come`.

    What comes is reduced where it stands first, so a node with very many edges is not one task's.
    """
    come = come.groupBy("node", "labels").agg(F.min("best").alias("best")).withColumn("new", F.lit(True))
    both = come if old is None else come.unionByName(old.select("node", "labels", "best", F.lit(False).alias("new")))
    # of equal facts the old one is the least, so only what is better is new
    least = [F.min(F.when(F.col("labels").bitwiseAND(bit) != 0, F.struct("best", "new"))).alias(f"b{bit}") for bit in BITS.values()]
    per = both.repartition("node").groupBy("node").agg(*least)
    each = F.array_compact(F.array(*[F.when(F.col(f"b{bit}").isNotNull(), F.struct(F.col(f"b{bit}.best").alias("best"), F.lit(bit).alias("bit"), F.col(f"b{bit}.new").alias("new"))) for bit in BITS.values()]))
    rows = per.select("node", each.alias("each")).select("node", "each", F.explode(F.array_distinct(F.col("each.best"))).alias("best"))
    mine = F.filter("each", lambda x: x["best"] == F.col("best"))
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda t, x: t + x["bit"])
    return rows.select("node", total(mine).alias("labels"), "best", total(F.filter(mine, lambda x: x["new"])).alias("fresh"))


def fixpoint(edges: DataFrame) -> tuple[DataFrame, Steps]:
    """The best fact of each node and label: node, labels (bits), best (lost, source_path, source_line, source, by); and where they are stored.

    Semi-naive: a round joins only facts that are new or better. Facts compare by confidence, then by
    place, and confidences only shrink along an edge, so a cycle ends and the result hangs on no order.
    """
    step = Steps(edges.sparkSession)
    known = step.keep(_best(None, _begun(edges)))
    while not (delta := known.where("fresh <> 0").select("node", F.col("fresh").alias("labels"), "best")).isEmpty():
        after = Steps(edges.sparkSession)
        known = after.keep(_best(known, _led(delta, edges)))
        step.drop()
        step = after
    return known.drop("fresh"), step


def solved(flows: DataFrame, imports: DataFrame) -> DataFrame:
    """Where taint meets a sink: path, source, source_path, source_line, sink, sink_type, sink_line, labels, sanitizers, confidence.

    One row a sink call, with its best source. Where sanitisers took the sink's own label on every way, the row is one of a safe
    flow: its labels lack the sink's type and its confidence is SANITIZED of what it was.
    """
    first, second, last = (Steps(flows.sparkSession) for _ in range(3))
    edges, sinks = edges_of(first.keep(flows), first.keep(imports), first)
    edges, sinks = second.keep(edges), second.keep(sinks)
    first.drop()
    known, third = fixpoint(edges)
    place = ("path", "line", "sink", "label")
    found = _led(known, sinks, *place).unionByName(_begun(sinks, *place))
    has = lambda bit: F.col("labels").bitwiseAND(bit) != 0
    own = sum((F.when(F.col("label") == x, F.lit(bit)).otherwise(0) for x, bit in BITS.items()), F.lit(0))
    per = found.groupBy("node", *place).agg(F.min(F.when(has(own), F.col("best"))).alias("open"), F.min(F.when(has(BITS[ANY]), F.col("best"))).alias("any"), F.bit_or("labels").alias("labels"))
    best = F.coalesce("open", "any")
    confidence = -best["lost"]
    sure = F.when(F.col("open").isNull(), F.round(confidence * SANITIZED, 6)).otherwise(confidence)
    labels = F.array_compact(F.array(*[F.when(has(bit), F.lit(x)) for x, bit in BITS.items() if x != ANY]))
    out = per.select("path", best["source"].alias("source"), best["source_path"].alias("source_path"), best["source_line"].alias("source_line"), "sink", F.col("label").alias("sink_type"), F.col("line").alias("sink_line"), labels.alias("labels"), best["by"].alias("sanitizers"), sure.alias("confidence"))
    out = last.keep(out)
    second.drop()
    third.drop()
    return out


def taint_paths(files: DataFrame) -> DataFrame:
    """Flows of Python files (path, content) that import one another by `path`; columns as in `solved`."""
    step = Steps(files.sparkSession)
    imports = resolve_modules(step.keep(python_flows.imports(files)), files).where("target_file IS NOT NULL")
    out = solved(python_flows.flows(files, SOURCES, SINKS, SANITIZERS), imports)
    step.drop()
    return out


def taint_findings(paths: DataFrame) -> DataFrame:
    """Flows whose sink still has its label: a confident one blocks, a semi-trusted source never does."""
    open_ = paths.where(F.array_contains("labels", F.col("sink_type")))
    trusted = F.col("source").rlike(r"^(os\.environ|sys\.argv)")
    sure = (F.col("confidence") >= 0.8) & ~trusted
    return open_.select("path", F.col("sink_line").alias("line"), F.concat(F.lit("taint-"), F.lower("sink_type")).alias("rule_id"), F.when(sure, "high").otherwise("medium").alias("severity"), sure.alias("is_blocker"), "source", "sink")


@dataclass(frozen=True)
class Dialect:
    """How a language assigns, and its sources, sinks (pattern -> type) and sanitisers (pattern -> types)."""

    assign: str
    sources: str
    sinks: dict
    sanitizers: dict


_ALL = tuple(sorted(set(SINKS.values())))
DIALECTS = {
    "javascript": Dialect(
        r"^\s*(?:const|let|var)?\s*([A-Za-z_$][\w$]*)\s*=\s*(.+?);?\s*$",
        r"\breq\.(?:query|body|params)\b|\bprocess\.argv\b|\blocation\.(?:search|hash)\b",
        {r"\.query\s*\(": "SQL-value", r"\bexec(?:Sync)?\s*\(": "CMD-argument", r"\beval\s*\(": "CODE-execution", r"\.innerHTML\s*=|\.send\s*\(": "HTML-content", r"\bfs\.\w+\s*\(": "FILE-path"},
        {r"\bparseInt\s*\(|\bNumber\s*\(": _ALL, r"\bescapeHtml\s*\(|DOMPurify\.sanitize\s*\(": ("HTML-content",), r"path\.basename\s*\(": ("FILE-path",)},
    ),
    "go": Dialect(
        r"^\s*(?:var\s+)?([A-Za-z_]\w*)(?:\s*,\s*\w+)?\s*:?=\s*(.+?)\s*$",
        r"\br\.URL\.Query\(\)|\br\.FormValue\(|\bc\.(?:Query|Param)\(|\bos\.Args\b",
        {r"\.(?:Query|Exec|QueryRow)\s*\(": "SQL-value", r"\bexec\.Command\s*\(": "CMD-argument", r"\bfmt\.Fprintf?\s*\(\s*w\b": "HTML-content", r"\bos\.(?:Open|ReadFile|WriteFile)\s*\(": "FILE-path"},
        {r"\bstrconv\.(?:Atoi|ParseInt)\s*\(": _ALL, r"template\.HTMLEscapeString\s*\(": ("HTML-content",), r"filepath\.(?:Clean|Base)\s*\(": ("FILE-path",)},
    ),
    "java": Dialect(
        r"^\s*(?:final\s+)?(?:[A-Z]\w*(?:<[^>]*>)?\s+)?([a-z_]\w*)\s*=\s*(.+?);\s*$",
        r"getParameter\(|getHeader\(|getQueryString\(|System\.getenv\(",
        {r"\.execute(?:Query|Update)?\s*\(": "SQL-value", r"\.exec\s*\(|new\s+ProcessBuilder\s*\(": "CMD-argument", r"\.println\s*\(": "HTML-content", r"new\s+File\s*\(|Paths\.get\s*\(": "FILE-path"},
        {r"Integer\.parseInt\s*\(|Long\.parseLong\s*\(": _ALL, r"escapeHtml\w*\s*\(": ("HTML-content",), r"FilenameUtils\.getName\s*\(": ("FILE-path",)},
    ),
}


def line_flows(files: DataFrame) -> DataFrame:
    """Rows of `python_flows.FLOWS` for JavaScript, Go and Java files, line by line: assignments, names outside of strings, sinks."""
    from quarry.operators.rules import lines

    out = None
    rows = lines(files)
    for language, d in DIALECTS.items():
        text = F.col("text")
        own = rows.where(F.col("language") == language)
        taken = F.flatten(F.array(*[F.when(text.rlike(p), F.array(*map(F.lit, cleaned))).otherwise(F.array().cast("array<string>")) for p, cleaned in d.sanitizers.items()]))
        by = F.array_compact(F.array(*[F.when(text.rlike(p), F.rtrim(F.regexp_replace(F.regexp_extract(text, p, 0), r"[( ]+$", ""))) for p in d.sanitizers]))
        nothing = F.lit(None).cast("string")
        ends = [F.when(text.rlike(d.assign), F.struct(F.lit("def").alias("dst_kind"), F.regexp_extract(text, d.assign, 1).alias("dst"), nothing.alias("label"), F.regexp_extract(text, d.assign, 2).alias("from")))]
        for p, label in d.sinks.items():
            name = F.regexp_replace(F.regexp_extract(text, p, 0), r"^[ (=.]+|[ (=.]+$", "")
            ends.append(F.when(text.rlike(p), F.struct(F.lit("sink").alias("dst_kind"), name.alias("dst"), F.lit(label).alias("label"), F.regexp_extract(text, f"(?:{p})(.*)$", 1).alias("from"))))
        met = own.withColumn("end", F.explode(F.array_compact(F.array(*ends)))).select("path", "line", "end.*", taken.alias("cleaned"), by.alias("by"))
        bare = F.regexp_replace("from", r"\"[^\"]*\"|'[^']*'", "")
        words = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))
        source = F.regexp_extract("from", f"({d.sources})", 1)
        named = F.transform(words, lambda w: F.struct(F.lit("var").alias("src_kind"), w.alias("src")))
        first = F.array(F.when(source != "", F.struct(F.lit("source").alias("src_kind"), source.alias("src"))).otherwise(F.struct(F.lit("none").alias("src_kind"), nothing.alias("src"))))
        met = met.withColumn("s", F.explode(F.when(source != "", first).otherwise(F.concat(first, named))))
        part = met.where("dst_kind = 'def' OR s.src_kind <> 'none'").select(
            "path", F.lit("").alias("scope"), F.col("line").alias("seq"), "line", "s.src_kind", "s.src", F.when(F.col("s.src_kind") == "source", 0.85).alias("confidence"),
            "dst_kind", "dst", F.lit(None).cast("int").alias("pos"), "label", "cleaned", "by",
        )
        out = part if out is None else out.unionByName(part)
    return out


def line_taint_paths(files: DataFrame) -> DataFrame:
    """Flows of JavaScript, Go and Java files (path, content, language), each file for itself; columns as in `solved`."""
    none = files.sparkSession.createDataFrame([], "path string, alias string, symbol string, target_file string, line int")
    return solved(line_flows(files), none)


#: Bare method names that suggest a sink, with words in parameters and modules that make it likelier.
SIGNALS = (
    ("SQL-value", ("execute", "query", "raw", "run_sql"), ("sql", "query", "statement"), ("db", "sql", "database")),
    ("CMD-argument", ("system", "popen", "spawn", "shell"), ("cmd", "command", "args"), ("os", "subprocess", "shell")),
    ("FILE-path", ("open", "read_file", "write_file"), ("path", "file", "filename"), ("io", "fs", "storage")),
)


def inferred_sink(method: Column, params: Column, module: Column) -> tuple[Column, Column]:
    """Sink type and confidence of a call: the first signal that lists the method; 0.6, and 0.1 for each hint, at most 0.9."""
    kind = score = None
    for name, methods, words, modules in SIGNALS:
        hit = method.isin(*methods)
        value = F.least(F.lit(0.9), F.lit(0.6) + F.when(F.arrays_overlap(params, F.array(*[F.lit(w) for w in words])), 0.1).otherwise(0.0) + F.when(F.lower(module).rlike("|".join(modules)), 0.1).otherwise(0.0))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        score = F.when(hit, value) if score is None else score.when(hit, value)
    return kind, F.round(score, 2)
