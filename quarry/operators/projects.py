"""A project's files as relations: which file an import means, which module a file belongs to, which names stand elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).when(rest == "", base).otherwise(F.concat(base, F.lit("/"), rest))


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports (path, module, level, ...) with `target_file`: the file of the project that each means, else null.

    Tried in this order: the module as a file, as a package, and its last part as a file beside the importing one. A
    level of one or more starts from the importing file's folder, one folder up for each level after the first (and not
    above the root). Each folder's imports are resolved once, by one equi-join of ranked candidates with the paths.
    """
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "^\\./", "")
    rows = imports.withColumn("folder", folder)
    asked = rows.select("folder", "module", "level").distinct()
    steps = F.split("folder", "/")
    up = F.greatest(F.lit(0), F.size(steps) - F.greatest(F.col("level") - 1, F.lit(0)))
    base = F.when(F.col("level") > 0, F.when(up > 0, F.array_join(F.slice(steps, F.lit(1), up), "/")).otherwise("")).otherwise("")
    stem = _joined(base, F.translate("module", ".", "/"))
    beside = _joined(F.col("folder"), F.concat(F.element_at(F.split("module", r"\."), -1), F.lit(".py")))
    tries = F.array(F.when(stem != "", F.concat(stem, F.lit(".py"))), _joined(stem, F.lit("__init__.py")), F.when(F.col("module") != "", beside))
    candidates = asked.select("folder", "module", "level", F.posexplode(tries).alias("rank", "target_file")).where("target_file IS NOT NULL")
    there = files.select(F.col("path").alias("target_file")).distinct()
    # broadcasts are chosen by compressed sizes, and paths compress well: the driver would hold what only looks small
    found = candidates.join(there.hint("merge"), "target_file").groupBy("folder", "module", "level").agg(F.min_by("target_file", "rank").alias("target_file"))
    return rows.join(found.hint("merge"), ["folder", "module", "level"], "left").select(*imports.columns, "target_file")


def owning_modules(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Paths (path) with `module`: the module (module, prefix, position) with the longest prefix that is the path or a folder of it.

    Of modules with one prefix the first by position; without any the top folder, `root` for a file in none, `unknown`
    without a path. Prefixes match whole folder names only. A path's folders are its join keys, so the table of
    modules can have any size.
    """
    asked = paths.select("path").distinct().withColumn("clean", F.translate("path", "\\", "/"))
    parts = F.split("clean", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = asked.where("clean <> '' AND clean <> 'unknown'").select("path", F.explode(folders).alias("prefix"))
    best = keyed.join(modules.select("module", "prefix", "position"), "prefix").groupBy("path").agg(F.max_by("module", F.struct(F.length("prefix"), -F.col("position"))).alias("owner"))
    fallback = F.when(F.size(parts) > 1, parts[0]).otherwise("root")
    known = F.when(F.coalesce(F.col("clean"), F.lit("")).isin("", "unknown"), "unknown").otherwise(F.coalesce("owner", fallback))
    found = asked.join(best, "path", "left").select(F.col("path").alias("of"), known.alias("module"))
    return paths.join(found, paths["path"].eqNullSafe(found["of"]), "left").drop("of")


WORD = r"[\p{L}\p{N}_]+"


def named_elsewhere(names: DataFrame, files: DataFrame) -> DataFrame:
    """Names (path, name, ...) with `elsewhere`: how many files (path, content) other than their own have the name as a whole word.

    Each file counts once a word, files of one path as one. Texts are dealt by path, so that a path's words are told apart where
    they stand and only counts of words travel.
    """
    dealt = files.select("path", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(WORD), F.lit(0)))
    counts = dealt.select("path", F.explode(words).alias("name")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    mine = names.groupBy("path").agg(F.collect_set("name").alias("mine"))
    own = dealt.join(mine.hint("merge"), "path").select("path", F.explode(F.array_intersect(words, "mine")).alias("name")).distinct().withColumn("own", F.lit(1))
    met = names.join(counts.hint("merge"), "name", "left").join(own.hint("merge"), ["path", "name"], "left")
    return met.select(*names.columns, (F.coalesce("files", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("elsewhere"))


def without_cross_file(orphans: DataFrame, files: DataFrame) -> DataFrame:
    """Orphans (path, kind, name, ...) without the functions and classes that another file names; imports and dead code are local."""
    exported = F.col("kind").isin("unreferenced_function", "unreferenced_class")
    asked = named_elsewhere(orphans.where(exported), files).where("elsewhere = 0").drop("elsewhere")
    return asked.unionByName(orphans.where(~exported))


# Fixed values of the cross-file check: what makes a constant's name sensitive, its sinks in order, what makes a line safe, and switches.
SENSITIVE = r"(?i)(password|secret|key|token|credential|api_key|db_url|database_url|redis_url)"
LOG_SINK = r"(?i)\b(logging\.(debug|info|warning|error|critical|exception)|logger\.(debug|info|warning|error|critical|exception|warn)|print|console\.(log|error|warn|debug|info)|log\.(Print|Printf|Println))\s*\("
SQL_SINK = r"(?i)\bcursor\.(execute|executemany)\s*\(|\bconn\.(execute|cursor)\s*\(|\bsession\.(execute|query)\s*\("
HTTP_SINK = r"(?i)headers\s*\[|\.set_header\s*\(|response\.headers\s*\[|add_header\s*\("
SAFE = r"(?i)\b(mask|redact|sanitize|scrub|hash|hmac|os\.path\.basename|filepath\.Clean|re\.sub)\s*\("
SWITCHED_OFF = r"(?i)\b(enable_dns_rebinding_protection|allow_cors|debug|ssl_verify|verify_ssl|check_hostname|csrf_protect|auth_required|require_auth|enforce_https)\s*=\s*(False|0|\"false\"|'false')"
COMMENT = r"^\s*(#|//|\*|/\*)"


def imported_secrets(constants: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, name, from_file): sensitive constants (path, name) that files import by name, or with a whole module.

    `imports` has path, symbol and target_file; a name that several files give is from the least of them.
    """
    given = constants.where(F.col("name").rlike(SENSITIVE)).select(F.col("path").alias("target_file"), "name").distinct()
    met = imports.where("target_file IS NOT NULL").select("path", "symbol", "target_file").distinct()
    # `from a import b` stands twice; the row without a symbol is then that of a module a.b
    named = met.where("symbol IS NOT NULL").join(given.withColumnRenamed("name", "symbol").hint("merge"), ["target_file", "symbol"]).withColumnRenamed("symbol", "name")
    whole = met.where("symbol IS NULL").drop("symbol").join(given.hint("merge"), "target_file")
    return named.select("path", "name", "target_file").unionByName(whole.select("path", "name", "target_file")).groupBy("path", "name").agg(F.min("target_file").alias("from_file"))


def cross_file_findings(files: DataFrame, secrets: DataFrame) -> DataFrame:
    """path, line, kind, name, from_file: protections that are switched off, and imported secrets (path, name, from_file) in a sink.

    Kinds are flag, log, sql and header, the first of the sinks that a line has. Comment lines count for nothing; a
    secret with a sanitiser within two lines is safe. The first secret on a line is named. Lines meet secrets by their words,
    and only files that import one are cut into words.
    """
    from pyspark.sql import Window

    from quarry.operators.rules import lines

    rows = lines(files, ("path",)).where(F.col("text") != "")
    plain = ~F.col("text").rlike(COMMENT)
    flags = rows.where(plain & F.col("text").rlike(SWITCHED_OFF)).select("path", "line", F.lit("flag").alias("kind"), F.regexp_extract("text", SWITCHED_OFF, 1).alias("name"), F.lit(None).cast("string").alias("from_file"))
    near = Window.partitionBy("path").orderBy("line").rangeBetween(-2, 2)
    mine = rows.join(secrets.select("path").distinct().hint("merge"), "path", "left_semi").withColumn("safe", F.max(F.col("text").rlike(SAFE)).over(near))
    kind = F.when(F.col("text").rlike(LOG_SINK), "log").when(F.col("text").rlike(SQL_SINK), "sql").when(F.col("text").rlike(HTTP_SINK), "header")
    words = mine.where(plain & ~F.col("safe")).withColumn("kind", kind).where("kind IS NOT NULL").select("path", "line", "kind", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("at", "name"))
    met = words.join(secrets.hint("merge"), ["path", "name"]).groupBy("path", "line", "kind").agg(F.min(F.struct("at", "name", "from_file")).alias("first"))
    return flags.unionByName(met.select("path", "line", "kind", "first.name", "first.from_file"))


def cross_file_check(files: DataFrame) -> DataFrame:
    """`cross_file_findings` of Python files (path, content), their constants and imports."""
    from quarry.sources import python_flows

    imports = resolve_modules(python_flows.imports(files), files)
    return cross_file_findings(files, imported_secrets(python_flows.constants(files), imports))
