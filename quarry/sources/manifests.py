"""Dependency manifests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def requirement(line: Column) -> tuple[Column, Column, Column]:
    """Name, extras and specifiers of a requirement line."""
    return F.regexp_extract(line, r"^([A-Za-z0-9._-]+)", 1), F.regexp_extract(line, r"\[([^\]]*)\]", 1), F.regexp_extract(line, r"((?:==|>=|<=|~=|!=|<|>)[^;\s]+)", 1)


def requirements(files: DataFrame) -> DataFrame:
    """path, name, extras, spec of all lines that are no comments or options."""
    rows = files.select("path", F.explode(F.split("content", "\n")).alias("raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"\s+#.*$", "")))
    name, extras, spec = requirement(F.col("raw"))
    return rows.where(~F.col("raw").rlike(r"^(#|-|$)")).select("path", name.alias("name"), extras.alias("extras"), spec.alias("spec"))


def package_json(files: DataFrame) -> DataFrame:
    """path, kind, name, version of the four kinds of dependency."""
    kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = files.select("path", F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds)).alias("j"))
    parts = [parsed.select("path", F.lit(k).alias("kind"), F.explode(f"j.{k}").alias("name", "version")) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pyproject(files: DataFrame) -> DataFrame:
    """path, kind, name, spec from TOML texts; a text that does not parse has no rows."""

    def run(batches):
        import re
        import tomllib

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    data = tomllib.loads(content or "")
                except tomllib.TOMLDecodeError:
                    continue
                project = data.get("project", {})
                groups = {"main": project.get("dependencies", []), **project.get("optional-dependencies", {})}
                for kind, items in groups.items():
                    for item in items:
                        m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*)", item)
                        if m:
                            rows.append((path, kind, m[1], m[2].strip()))
                poetry = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
                rows += [(path, "poetry", n, v if isinstance(v, str) else str(v.get("version", ""))) for n, v in poetry.items()]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "spec"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, name string, spec string")
