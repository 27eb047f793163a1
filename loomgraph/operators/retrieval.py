"""Lexical and vector retrieval, fusion and relevance metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut, dealt
from .filters import tokens

K1, B = 1.2, 0.75
#: Up to how many pairs of a query and a token go to every task; more meet the postings in a shuffle.
ASKED = 500_000
#: About how many postings that meet a query a task gets, each query counted.
MET = 1_000_000
# What a hit in each field weighs.
FIELD_WEIGHTS = {"name": 5.0, "signature": 3.0, "doc": 2.5, "surface": 2.2, "body": 1.5, "import": 1.4, "kind": 1.0, "path": 0.0}
# The same for files that aren't parsed, and for the words of a prose question.
ARTIFACT_WEIGHTS = {"kind": 1.0, "mime": 1.4, "preview": 2.0}
PROSE_WEIGHTS, EXACT_NAME = {"name": 3.0, "signature": 1.5, "file": 1.0}, 2.0
# Weights of the signals, and what proof counts more where it is required.
SIGNALS = {"lexical": 0.30, "semantic": 0.28, "graph": 0.18, "proof": 0.16, "provenance": 0.08}
PROOF_BIAS = 1.35


def postings(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """(key, token, tf): weighted term frequencies over the fields; those of weight 0 aren't searched."""
    every = F.array(*[F.struct(F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias("t"), F.lit(float(w)).alias("w")) for f, w in fields.items() if w])
    rows = docs.select(key, F.explode(every).alias("f")).select(key, F.explode("f.t").alias("token"), F.col("f.w").alias("w"))
    return rows.groupBy(key, "token").agg(F.sum("w").alias("tf"))


def bm25(posts: DataFrame, queries: DataFrame, key: str, limit: int | None = None, length: DataFrame | None = None, total: DataFrame | None = None) -> DataFrame:
    """(query, key, score): queries (query, token); k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only postings of query tokens take part in the join. Lengths (key, length) and their number and mean (docs, mean; one
    row) come from all postings unless they are given; then posts need hold those of the queries' tokens only. A posting's
    points are told before it meets the queries, of which a bounded number of pairs goes to all tasks.
    """
    if length is None:
        length = posts.groupBy(key).agg(F.sum("tf").alias("length"))
        total = length.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    hits = posts.join(queries.select("token").distinct(), "token", "left_semi")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    rows = hits.join(df, "token").join(length, key).join(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    points = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    rows, asked = rows.select("token", key, points.alias("points")), queries.select("query", "token").distinct()
    if asked.limit(ASKED + 1).count() <= ASKED:
        # postings are dealt out by document, once for all queries; what they make with the queries isn't shuffled
        met = df.join(asked.groupBy("token").agg(F.count("*").alias("n")), "token").agg(F.sum(F.col("df") * F.col("n")).alias("n")).first().n
        rows, asked = dealt(rows, key, rows=met or 0, each=MET), F.broadcast(asked)
    score = rows.join(asked, "token").groupBy("query", key).agg(F.sum("points").alias("score"))
    return top(score, "query", [F.desc("score"), key], limit) if limit else score


def scan(docs: DataFrame, queries: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """bm25 of queries (query, token) in one pass over documents without an index, for queries too few to be worth one: only their tokens' postings are shuffled, and a length for each document."""
    every = F.array(*[F.struct(F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias("t"), F.lit(float(w)).alias("w")) for f, w in fields.items() if w])
    rows = docs.select(key, every.alias("every"))
    length = F.aggregate("every", F.lit(0.0), lambda n, f: n + F.size(f["t"]) * f["w"])  # stands beside the tokens as the empty one, which no text has
    rows = rows.select(key, F.explode(F.concat("every", F.array(F.struct(F.array(F.lit("")).alias("t"), length.alias("w"))))).alias("f")).select(key, F.explode("f.t").alias("token"), F.col("f.w").alias("w"))
    wanted = queries.select("token").unionByName(queries.sparkSession.range(1).select(F.lit("").alias("token"))).distinct()
    found = cut(rows.join(wanted, "token", "left_semi").groupBy(key, "token").agg(F.sum("w").alias("tf")))
    length = found.where("token = '' and tf > 0").select(key, F.col("tf").alias("length"))
    return bm25(found.where("token <> ''"), queries, key, length=length, total=length.agg(F.count("*").alias("docs"), F.avg("length").alias("mean")))


def unified(lexical: DataFrame, vector: DataFrame, hops: DataFrame, anchor: str, entities: DataFrame, limit: int = 50) -> DataFrame:
    """(key, lexical, distance, hops, role): what the arms (key, lexical), (key, distance) and (key, hops) find, one row for each key.

    The lexical and the vector arm give their best `limit`, the arm of hops all but the anchor. Scores aren't combined here.
    """
    a = lexical.orderBy(F.desc("lexical"), "key").limit(limit)
    b = vector.orderBy("distance", "key").limit(limit)
    found = a.join(b, "key", "full_outer").join(hops.where(F.col("key") != anchor), "key", "full_outer")
    return found.join(entities.select(F.col("id").alias("key"), "role"), "key", "left")


def prose_scores(entities: DataFrame, words: Column) -> DataFrame:
    """Entities with the score of a question's words: what each weighs in the fields that have it, and more if it is the whole name."""
    has = lambda f: F.coalesce(F.size(F.array_intersect(tokens(F.col(f)), words)), F.lit(0))
    score = F.array_contains(words, F.lower("name")).cast("int") * EXACT_NAME
    for field, weight in PROSE_WEIGHTS.items():
        score = score + F.when(F.col(field).isNull(), 0.0).otherwise(has(field) * weight)
    return entities.withColumn("score", score.cast("double"))


def top(rows: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def normalised(score: Column, group: str) -> Column:
    """A score by the largest of its group; 0 where that is 0."""
    most = F.max(score).over(Window.partitionBy(group))
    return F.when(most > 0, score / most).otherwise(0.0)


def rrf(ranks: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """(query, id, score) of ranks (query, id, signal, rank)."""
    w = F.when(F.lit(False), 0.0)
    for signal, weight in weights.items():
        w = w.when(F.col("signal") == signal, float(weight))
    return ranks.groupBy("query", "id").agg(F.sum(w.otherwise(1.0) / (k + F.col("rank"))).alias("score"))


def signals_of(hits: DataFrame) -> DataFrame:
    """hits (query, id, bm25, distance, graph, proof, provenance; null: not found so) as the five signals of rank_candidates.

    Lexical and graph scores count by the largest of their query, distances as 1 less themselves, the others between 0 and 1.
    """
    by_most = lambda c: F.coalesce(normalised(F.coalesce(F.col(c), F.lit(0.0)), "query"), F.lit(0.0))
    given = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731  (greatest and least pass over nulls)
    near = F.greatest(F.lit(0.0), given(1 - F.col("distance")))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), given(F.col(c)))).alias(c)
    return hits.select("query", "id", by_most("bm25").alias("lexical"), near.alias("semantic"), by_most("graph").alias("graph"), unit("proof"), unit("provenance"))


# What each signal weighs where files are located.
LOCATE = {"traceback": 1.0, "search": 2.0, "multihop": 1.4, "test": 1.0, "snippet": 0.8, "import": 1.2, "error": 1.0, "embedding": 1.5, "cochange": 1.0, "projection": 5.0}


def locate(scores: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """Candidates of ten signals, fused: scores (query, id, signal, score).

    (query, id, each signal's share of the fused score, whether it is there, signals, fused, rank): the features that a
    learned ranker takes. A signal ranks its candidates by score, ids break ties; a share is weight / (k + rank).
    """
    place = F.row_number().over(Window.partitionBy("query", "signal").orderBy(F.desc("score"), "id"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in LOCATE.items() for x in pair]), F.col("signal"))
    rows = scores.where(F.col("signal").isin(*LOCATE)).withColumn("share", weight / (k + place))
    share = lambda s: F.coalesce(F.max(F.when(F.col("signal") == s, F.col("share"))), F.lit(0.0))
    wide = rows.groupBy("query", "id").agg(*[share(s).alias(f"{s}_score") for s in LOCATE], *[(share(s) > 0).cast("int").alias(f"{s}_present") for s in LOCATE], F.count_distinct("signal").cast("int").alias("signals"), F.round(F.sum("share"), 9).alias("fused"))
    return top(wide, "query", [F.desc("fused"), "id"], limit or 1 << 30)


def rank_candidates(rows: DataFrame, limit: int = 20, proof: bool = False) -> DataFrame:
    """rows (query, id, lexical, semantic, graph, proof, provenance), each in 0..1: weighted score, explanation and rank."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    if proof:
        rows = rows.where("proof > 0")
    score = sum((clamp(s) * (w * PROOF_BIAS if proof and s == "proof" else w) for s, w in SIGNALS.items()), F.lit(0.0))
    why = F.concat_ws("+", *[F.when(F.col(s) >= 0.5, s) for s in SIGNALS])
    return top(rows.withColumn("score", F.round(score, 6)).withColumn("why", why), "query", [F.desc("score"), "id"], limit)


def relevance(ranked: DataFrame, k: int, good: int = 2) -> DataFrame:
    """(query, ndcg, mrr, precision, recall) of ranked (query, rank, grade); k shrinks to the number of results.

    Gains are 2^grade - 1, discounts log2(rank + 1); grades from `good` on count as relevant.
    """
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "rank"))
    rows = ranked.withColumn("ideal", ideal).withColumn("n", F.count("*").over(Window.partitionBy("query"))).withColumn("k", F.least(F.lit(k), "n"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    by = lambda c: F.sum(F.when(F.col(c) <= F.col("k"), gain / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    hit = F.col("grade") >= good
    out = rows.groupBy("query").agg(by("rank").alias("dcg"), by("ideal").alias("best"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.count(F.when(hit & (F.col("rank") <= F.col("k")), 1)).alias("hits"), F.count(F.when(hit, 1)).alias("relevant"), F.max("k").alias("k"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select("query", F.round(part(F.col("dcg"), F.col("best")), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(part(F.col("hits"), F.col("k")), 6).alias("precision"), F.round(part(F.col("hits"), F.col("relevant")), 6).alias("recall"))


def tune(rows: DataFrame, grades: DataFrame, grid: list[dict[str, float]], k: int = 10) -> DataFrame:
    """(config, ndcg): mean NDCG of each weighting in a bounded grid, best first; all in one job."""
    spark = rows.sparkSession
    names = list(SIGNALS)
    table = spark.createDataFrame([(i, *[float(g[n]) for n in names]) for i, g in enumerate(grid)], "config int, " + ", ".join(f"w_{n} double" for n in names))
    scored = rows.join(F.broadcast(table)).withColumn("score", F.round(sum((F.col(n) * F.col(f"w_{n}") for n in names), F.lit(0.0)), 6))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("config", "query").orderBy(F.desc("score"), "id"))).join(grades, ["query", "id"])
    by = scored.select(F.concat_ws(":", "config", "query").alias("query"), "rank", "grade")
    return relevance(by, k).groupBy(F.split("query", ":")[0].cast("int").alias("config")).agg(F.round(F.avg("ndcg"), 6).alias("ndcg")).orderBy(F.desc("ndcg"), "config")
