"""The dependency graph: import, test, configuration and link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.corpus import lines_of
from .lexical import ranked

EDGE = ["source_path", "target_path", "kind", "source_line", "edge_text", "source_content_sha"]
#: Names of configuration files, and those that are no target.
CONFIG_FILES = ("Cargo.toml", "package.json", "pyproject.toml", "tsconfig.json", "go.mod", "build.gradle", "pom.xml", "CMakeLists.txt")
CONFIG_TARGETS_SKIPPED = ("Cargo.toml", "package.json", "pyproject.toml", "tsconfig.json", "go.mod", "Cargo.lock", "package-lock.json")
#: Extensions that a test's source may have.
SOURCE_EXTENSIONS = ("rs", "py", "go", "ts", "tsx", "js")


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _candidates() -> Column:
    """Ordered target paths of an import line, by language."""
    line, d = F.trim("line"), _dir(F.col("path"))
    at = lambda pattern, group=1: F.regexp_extract(line, pattern, group)
    rust_mod = at(r"^(?:pub )?mod ([A-Za-z0-9_]+)")
    rust_use = at(r"^use (?:(?:crate|self|super)?::)*(?:(?:crate|self|super)::)*([A-Za-z0-9_]+)")
    rust = F.when(rust_mod != "", rust_mod).otherwise(rust_use)
    rust_ok = (rust != "") & ~rust.isin("self", "super", "crate")
    ts = F.regexp_extract(line, r"""(?:\sfrom\s+|^import\s+)['"](\.[^'"]*)['"]""", 1)
    base = F.concat(d, F.lit("/"), ts)
    python = at(r"^(?:import|from) ([A-Za-z0-9_]+)")
    p = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    none = F.array().cast("array<string>")
    return (
        F.when((F.col("language") == "rust") & rust_ok, F.array(p(d, "/", rust, ".rs"), p(d, "/", rust, "/mod.rs")))
        .when(F.col("language").isin("typescript", "tsx", "javascript", "jsx") & (ts != ""),
              F.array(base, *[F.concat(base, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")]))
        .when((F.col("language") == "python") & (python != ""),
              F.array(p(d, "/", python, ".py"), p(d, "/__init__.py"), p(python, ".py"), p(python, "/__init__.py")))
        .otherwise(none)
    )


def import_edges(files: DataFrame) -> DataFrame:
    """Imports whose first existing candidate is a file. Candidates are probed by
    an equi-join, so the path set is never collected. A Rust name that no
    candidate has may be a file name that exactly one file bears."""
    lines = lines_of(files).withColumn("cands", _candidates()).where(F.size("cands") > 0)
    keys = ["path", "line_no"]
    probes = lines.select(*keys, F.posexplode("cands").alias("place", "cand")).withColumn("cand", T.normalized_path(F.col("cand")))
    known = files.select(F.col("path").alias("cand"))
    found = probes.join(known, "cand").groupBy(*keys).agg(F.min(F.struct("place", "cand")).alias("f")).select(*keys, F.col("f.cand").alias("direct"))
    single = files.groupBy(_name(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only")).where("n = 1").select("base", "only")
    base = F.when(F.col("language") == "rust", _name(F.element_at("cands", 1)))
    hit = lines.withColumn("base", base).join(found, keys, "left").join(single, "base", "left")
    target = F.coalesce("direct", "only")
    return hit.where(target.isNotNull() & (target != F.col("path"))).select(
        F.col("path").alias("source_path"), target.alias("target_path"), F.lit("imports").alias("kind"),
        F.col("line_no").alias("source_line"), F.col("line").alias("edge_text"), F.col("content_sha").alias("source_content_sha"),
    )


def is_test_file(path: Column) -> Column:
    name, low = _name(path), F.lower(path)
    return (
        low.contains("/tests/") | low.contains("/test/") | name.rlike(r"(_test\.(rs|py|go)|\.(test|spec)\.tsx?)$") | name.startswith("test_")
    )


def test_edges_of(files: DataFrame) -> DataFrame:
    """Tests to the sources that their names point at."""
    path = F.col("path")
    stem = F.regexp_replace(F.regexp_replace(_name(path), r"\.[^.]*$", ""), r"^(test_)+|(_test)+$|(\.test)+$|(\.spec)+$", "")
    d = _dir(path)
    inside = d.rlike("/tests?$")
    parent = F.regexp_replace(d, "/[^/]*$", "")
    folders = F.filter(F.array(d, F.when(inside, parent), F.when(inside, F.concat(parent, F.lit("/src")))), lambda x: x.isNotNull())
    cands = F.flatten(F.transform(folders, lambda f: F.array(*[F.concat(f, F.lit("/"), stem, F.lit("." + e)) for e in SOURCE_EXTENSIONS])))
    tests = files.where(is_test_file(path)).select("path", "content_sha", F.explode(cands).alias("cand"))
    got = tests.join(files.select(F.col("path").alias("cand")), "cand").where("cand <> path").distinct()
    return got.select(
        F.col("path").alias("source_path"), F.col("cand").alias("target_path"), F.lit("tests").alias("kind"), F.lit(1).alias("source_line"),
        F.concat(F.lit("test heuristic: "), "path", F.lit(" tests "), "cand").alias("edge_text"), F.col("content_sha").alias("source_content_sha"),
    )


def config_edges(files: DataFrame, most: int = 50) -> DataFrame:
    """Configuration files to at most ``most`` files (by path) whose folder's
    path starts with theirs. The folder prefixes of each file are generated and
    joined by equality, so no pair of unrelated files is formed."""
    configs = files.where(_name(F.col("path")).isin(*CONFIG_FILES)).select(
        F.col("path").alias("source_path"), F.col("content_sha").alias("source_content_sha"), _dir(F.col("path")).alias("prefix")
    )
    folder = _dir(F.col("path"))
    prefixes = F.transform(F.sequence(F.lit(0), F.length(folder)), lambda n: F.substring(folder, F.lit(1), n))
    others = files.where(~_name(F.col("path")).isin(*CONFIG_TARGETS_SKIPPED)).select(F.col("path").alias("target_path"), F.explode(prefixes).alias("prefix"))
    pairs = others.join(configs, "prefix").where("source_path <> target_path")
    return ranked(pairs, ["target_path"], ["source_path"], most).select(
        "source_path", "target_path", F.lit("configures").alias("kind"), F.lit(1).alias("source_line"),
        F.concat(F.lit("config heuristic: "), "source_path", F.lit(" configures "), "target_path").alias("edge_text"), "source_content_sha",
    )


def build_graph(files: DataFrame) -> DataFrame:
    cols = lambda d: d.select(*EDGE)
    return cols(import_edges(files)).unionByName(cols(test_edges_of(files))).unionByName(cols(config_edges(files)))


def link_edges(pages: DataFrame) -> DataFrame:
    """Links of web pages: source_path (page), target_path (href), n_links."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    spread = pages.select(F.concat(F.lit("page/"), "page_id").alias("source_path"), F.explode(hrefs).alias("target_path"))
    return spread.groupBy("source_path", "target_path").agg(F.count("*").alias("n_links"))


def impact(edges: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """Edges that point at the given paths (path); only one step is defined."""
    if depth != 1:
        raise ValueError("only depth 1 is defined")
    return edges.join(targets.select(F.col("path").alias("target_path")), "target_path", "left_semi")


def tests_touching(edges: DataFrame, path: str | None = None) -> DataFrame:
    found = edges.where(F.col("kind") == "tests")
    return found.where((F.col("source_path") == path) | (F.col("target_path") == path)) if path else found


def edges_by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n_edges"))


def valid_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with whether they still hold: the source is unchanged and the
    target exists."""
    src = files.select(F.col("path").alias("source_path"), F.col("content_sha").alias("_sha"))
    dst = files.select(F.col("path").alias("target_path"), F.lit(True).alias("_known"))
    joined = edges.join(src, "source_path", "left").join(dst, "target_path", "left")
    reason = F.when(F.col("_sha").isNull(), "source_missing").when(F.col("_sha") != F.col("source_content_sha"), "source_stale").when(
        F.col("_known").isNull(), "target_missing").otherwise("ok")
    return joined.withColumn("reason", reason).drop("_sha", "_known")
