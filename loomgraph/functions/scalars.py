"""Scalar functions over names, signatures, paths and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.filters import tokens as code_tokens  # noqa: F401  (camelCase, snake_case and path words)

NESTING = 4  # depth of generics that strip_generics() takes off


def strip_generics(name: Column) -> Column:
    """`Map<K, Vec<V>>::get` -> `Map::get`."""
    for _ in range(NESTING):
        name = F.regexp_replace(name, "<[^<>]*>", "")
    return name


def leaf(name: Column) -> Column:
    """What follows the last `::` or `.`."""
    return F.regexp_extract(name, r"([^:.]*)$", 1)


def qualifier(name: Column) -> Column:
    """What stands before the last `::` or `.`; empty without one."""
    return F.regexp_replace(F.regexp_extract(name, r"^(.*)(::|\.)[^:.]*$", 1), r"(::|\.)$", "")


def symbol_leaf(name: Column) -> Column:
    """The leaf if it is an identifier, else null."""
    return F.when(leaf(name).rlike("^[A-Za-z_][A-Za-z0-9_]*$"), leaf(name))


def repo_token(name: Column) -> Column:
    return F.translate(F.lower(name), "_", "-")


def import_root(path: Column) -> Column:
    return F.regexp_extract(path, r"^@?([^/.:]+)", 1)


# First parts of a path below which each directory is a module of its own.
CONTAINERS = ("app", "apps", "cmd", "crates", "internal", "lib", "modules", "packages", "pkg", "services", "src")


def module_of(path: Column) -> Column:
    """The first directory of a path; below a container the first two; (root) without one, (unknown) without a path."""
    slashes = F.translate(path, "\\", "/")
    parts = F.filter(F.split(F.when(slashes.startswith("./"), F.substring(slashes, 3, 1 << 30)).otherwise(slashes), "/"), lambda x: x != "")
    n, first = F.size(parts), F.get(parts, F.lit(0))
    deep = F.when(first.isin(*CONTAINERS) & (n > 2), F.concat_ws("/", first, F.get(parts, F.lit(1)))).otherwise(first)
    return F.when(F.coalesce(path, F.lit("")) == "", "(unknown)").when(n <= 1, "(root)").otherwise(deep)


def token_estimate(text: Column) -> Column:
    """Words and punctuation marks, and a seventh of their number on top."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s])"), F.lit(1)))
    return (n + F.floor(n / 7)).cast("long")


def normalised_source(text: Column) -> Column:
    """Source without line comments, block comments, blank lines and white space at the ends of lines."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(//|#)[^\n]*", "")
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalised_source(text), 256)


def stability(lines: Column) -> Column:
    """How much a body's fingerprint says, by its length."""
    return F.when(lines <= 5, 0.25).when(lines <= 20, 0.5).when(lines <= 50, 0.75).otherwise(1.0)


def basis_points(confidence: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)) * 10000).cast("int")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def go_arity(signature: Column) -> Column:
    """Parameters of a Go signature; a function without any has 0."""
    inside = F.regexp_extract(signature, r"\(([^()]*)\)", 1)
    return F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ","))).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def expired(expires: Column, now: Column) -> Column:
    return F.coalesce(expires < now, F.lit(False))


# Words that say nothing in a question about code.
STOP_WORDS = (
    "a an and any are as at be been but by can could did do does for from had has have how i if in into is it its me my of on or our should so than that the their "
    "them then there these they this to was we were what when where which while who why will with would you your"
).split()


def question_tokens(text: Column, most: int = 8) -> Column:
    """The first words of a prose question that say something, of two characters at least."""
    words = F.array_distinct(code_tokens(text))
    return F.slice(F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 2)), 1, most)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in doubles; 1 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - dot(a, b) / norm)
