"""Files as artifacts: classes by path, coverage, notes in source, manifest dependencies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of source that is parsed, package manifests, and other files with a structure of their own.
SOURCES = "ts tsx js jsx mjs cjs py pyi go java rs c h cpp hpp cc cxx cs rb kt kts swift php tf tfvars".split()
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "Gemfile", "requirements.txt", "composer.json")
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
MAKEFILES = ("Makefile", "makefile", "GNUmakefile")
CI_FILES = (".gitlab-ci.yml", "Jenkinsfile")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def artifact_kind(path: Column) -> Column:
    """What a file with a structure of its own is, or null."""
    name, end = F.substring_index(path, "/", -1), extension(path)
    ci = end.isin("yml", "yaml") & path.contains(".github/workflows/") | name.isin(*CI_FILES) | (name == "config.yml") & path.contains(".circleci")
    kind = F.when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile").when(name.isin(*MANIFESTS), "package_manifest").when(ci, "ci_config").when(name.isin(*COMPOSE), "compose_file").when(name.isin(*MAKEFILES), "makefile")
    return kind.when((end == "sql") & F.lower(path).contains("migration"), "sql_migration")


def tier(path: Column) -> Column:
    """semantic, structured or opaque, by extension and name; no language is parsed in a shallow way only."""
    return F.when(extension(path).isin(*SOURCES), "semantic").when(artifact_kind(path).isNotNull(), "structured").otherwise("opaque")


def coverage(paths: DataFrame, column: str = "path") -> DataFrame:
    return paths.groupBy(tier(F.col(column)).alias("tier"), extension(F.col(column)).alias("extension")).agg(F.count("*").alias("files"))


def notes(texts: DataFrame, key: str, column: str = "text", words=("TODO", "FIXME", "HACK", "NOTE")) -> DataFrame:
    """(key, line, kind, note) of every line with one of the words."""
    lines = texts.select(key, F.posexplode(F.split(column, "\n")).alias("line", "text"))
    pattern = rf"\b({'|'.join(words)})\b[:\s]*([^\n]*)"
    return lines.where(F.col("text").rlike(pattern)).select(key, (F.col("line") + 1).alias("line"), F.regexp_extract("text", pattern, 1).alias("kind"), F.trim(F.regexp_extract("text", pattern, 2)).alias("note"))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, source) of manifests (path, text): Cargo, npm, Go and Python; each name once for each file and source."""
    name = F.substring_index("path", "/", -1)
    cases = (("Cargo.toml", "cargo", r'(?m)^([A-Za-z0-9_-]+)\s*=\s*(?:"|\{)'), ("package.json", "npm", r'"([@A-Za-z0-9/_.-]+)"\s*:\s*"[\^~]?[0-9]'), ("go.mod", "go", r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v[0-9]"), ("requirements.txt", "pip", r"(?m)^([A-Za-z0-9_.-]+)\s*(?:[=<>~!]|$)"))
    out = None
    for file, source, pattern in cases:
        part = files.where(name == file).select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1)))).alias("name"), F.lit(source).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def preview(text: Column, most: int = 120) -> Column:
    """The beginning of a text in one line; null for what isn't text."""
    line = F.trim(F.regexp_replace(F.substring(text, 1, most), r"\s+", " "))
    return F.when(F.substring(text, 1, most).contains("\x00") | (line == ""), None).otherwise(line)


def entry_points(files: DataFrame) -> DataFrame:
    """(path, script, module, symbol) that manifests (path, text) declare: Python scripts, npm binaries, Cargo binaries."""
    name = F.substring_index("path", "/", -1)
    section = F.regexp_extract("text", r"(?s)\[(?:project\.(?:gui-)?scripts|tool\.poetry\.scripts)\]\n(.*?)(?:\n\[|$)", 1)
    line = r'(?m)^([A-Za-z0-9_.-]+)\s*=\s*"([^":]*):?([^"]*)"'
    py = files.where(name == "pyproject.toml").select("path", F.explode(F.regexp_extract_all(section, F.lit(line), F.lit(0))).alias("l"))
    blank = lambda c: F.when(c == "", None).otherwise(c)
    py = py.select("path", F.regexp_extract("l", line, 1).alias("script"), blank(F.regexp_extract("l", line, 2)).alias("module"), blank(F.regexp_extract("l", line, 3)).alias("symbol"))
    bins = F.from_json(F.get_json_object("text", "$.bin"), "map<string,string>")
    npm = files.where(name == "package.json").select("path", F.explode(bins).alias("script", "module")).withColumn("symbol", F.lit(None).cast("string"))
    pair = r'(?s)\[\[bin\]\]\s*name\s*=\s*"([^"]+)"(?:\s*path\s*=\s*"([^"]+)")?'
    cargo = files.where(name == "Cargo.toml").select("path", F.explode(F.regexp_extract_all("text", F.lit(pair), F.lit(0))).alias("l"))
    script = F.regexp_extract("l", pair, 1)
    cargo = cargo.select("path", script.alias("script"), F.coalesce(blank(F.regexp_extract("l", pair, 2)), F.concat(F.lit("src/bin/"), script, F.lit(".rs"))).alias("module"), F.lit("main").alias("symbol"))
    return py.unionByName(npm).unionByName(cargo)


#: Words in a source file that start other programs, and those that open a comment line.
STARTS, EXECS = ("spawn", "subprocess", "Command::new"), ("execFile", "execa", "exec.Command")
COMMENT = r"(?://|#|\*)"


def detected(files: DataFrame, registry: list[str], owner: str, packages: dict[str, str], ports: dict[int, str]) -> DataFrame:
    """(repo, name, provider, source) of files (repo, path, text): what a repository needs beyond its manifests, each once.

    dockerfile: images of an owner that are built on. compose: such images, and builds of known projects. ci: repositories
    of the owner that a workflow checks out. protocol: packages (package: repository) that Rust and TypeScript import.
    subprocess: known repositories that a file names as a program, if it starts any. http: known services (port: service)
    on local ports, comment lines aside. registry: known repositories, a list of a known size.
    """
    text, base = F.col("text"), F.substring_index("path", "/", -1)
    last = lambda x: F.substring_index(x, "/", -1)
    tail = lambda x: F.substring_index(last(x), ":", 1)
    spaces = lambda x: F.regexp_replace(x, r"\s", " ")
    plain = lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")
    # What an entry of a compose file says; nothing if one of the rarer ends of a line is within it.
    entry = lambda x: plain(F.regexp_extract(F.trim(spaces(x)), "^(.*)$", 1))
    owned = lambda x: x.contains(owner)
    one_of = lambda names: lambda x: x.isin(*names)
    # Each pattern goes through a text once and takes what lies within a line; what a file says again says nothing new.
    every = lambda *patterns: F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(x), F.lit(1)) for x in patterns]))
    blank = r"[ \t\x0B\f\r]"
    begin = rf"(?md)^{blank}*"
    imports = (rf"{begin}use{blank}+([A-Za-z0-9_]+)::", rf"{begin}(?:import|export)\b[^\n\x85\u2028\u2029]*\bfrom{blank}+[\"']([^\"'\n]+)[\"']")
    step = r"(?m)uses:[^\n]*actions/checkout[^\n]*\n(?:[ \t]*(?![ \t]|-|repository:)[^\n]+\n)*[ \t]*repository:([^\n]*)"
    port = rf"{begin}{COMMENT}[^\n]*|(?:localhost|127\.0\.0\.1):([0-9]+)"
    has = lambda words: reduce(or_, [text.contains(w) for w in words])
    named = lambda r: has([f'"{r}"', f"'{r}'", f'"{r} ', f"'{r} ", r.upper().replace("-", "_") + "_BINARY"])
    compose, served = base.startswith("docker-compose") & base.endswith(".yml"), [str(p) for p, s in ports.items() if s in registry]
    keys = {
        "docker:": F.when(base.startswith("Dockerfile"), F.transform(F.filter(every(rf"{begin}FROM{blank}+(\S+)"), owned), tail)),
        "compose:": F.when(compose, F.transform(F.filter(F.transform(every(rf"{begin}image:([^\n]*)"), entry), owned), tail)),
        "compose-build:": F.when(compose, F.filter(F.transform(every(rf"{begin}build:([^\n]*)"), lambda x: last(F.regexp_replace(entry(x), "/+$", ""))), one_of(registry))),
        "ci:": F.when(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]*\.yml$"), F.transform(F.filter(F.transform(every(step), plain), owned), last)),
        "import:": F.when(base.rlike(r"\.(rs|ts)$"), F.filter(F.transform(every(*imports), spaces), one_of(packages))),
        "bin:": F.when(has(STARTS) | text.contains("exec") & has(EXECS), F.array_compact(F.array(*[F.when(named(r), F.lit(r)) for r in registry]))),
        "http:localhost:": F.when(has(["localhost:", "127.0.0.1:"]), F.filter(every(port), one_of(served))),
    }
    # The inner generator hands a text on as a column, so that nothing repeats the expression that makes it.
    found = files.select("repo", "path", F.explode(F.array("text")).alias("text")).select("repo", F.inline(F.array(*[F.struct(F.lit(p).alias("prefix"), k.alias("keys")) for p, k in keys.items()])))
    # A prefix and a key say all the rest, so nothing else is shuffled.
    found, prefix, key = found.select("repo", "prefix", F.explode("keys").alias("key")).distinct(), F.col("prefix"), F.col("key")
    by = lambda pairs, x: F.element_at(F.create_map(*[F.lit(str(v)) for pair in pairs.items() for v in pair]), x)
    provider = F.when(prefix == "import:", by(packages, key)).when(prefix == "http:localhost:", by(ports, key)).otherwise(key)
    source = by({"docker:": "dockerfile", "compose:": "compose", "compose-build:": "compose", "ci:": "ci", "import:": "protocol", "bin:": "subprocess", "http:localhost:": "http"}, prefix)
    return found.select("repo", F.concat(prefix, key).alias("name"), provider.alias("provider"), source.alias("source"))
