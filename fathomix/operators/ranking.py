"""Fusion of ranked lists, diversification by path, tie-breaking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomix.functions import paths as P
from fathomix.storage import Scratch

#: Priorities of symbol types.
SYMBOL_PRIORITY = {"function": 100, "class": 95, "interface": 90, "type": 85, "method": 80, "constant": 75, "variable": 70, "property": 65, "string_literal": 30, "comment": 20, "unknown": 10}


@dataclass
class RankingConfig:
    """Weights and limits of the ranking stack, checked on creation."""

    alpha: float = 0.5
    beta: float = 0.4
    gamma: float = 0.1
    rrf_k: int = 60
    diversify: bool = True
    lambda_: float = 0.7
    max_per_file: int = 3
    tie_weights: dict = field(default_factory=lambda: {"symbol": 0.3, "path": 0.3, "language": 0.2, "identifier": 0.2})
    tie_threshold: float = 0.01
    candidate_limit: int = 200
    timeout_ms: int = 300
    top_k: int = 10

    def __post_init__(self):
        for name in ("alpha", "beta", "gamma", "lambda_"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if self.alpha + self.beta + self.gamma > 1 + 1e-9:
            raise ValueError("alpha + beta + gamma must not exceed 1")
        for name, low, high in (("rrf_k", 1, 1000), ("max_per_file", 1, 10), ("candidate_limit", 10, 1000), ("timeout_ms", 100, 5000), ("top_k", 1, 100)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")
        if abs(sum(self.tie_weights.values()) - 1) > 0.01:
            raise ValueError("tie weights must sum to 1")

    def extreme(self) -> bool:
        """Whether one list has all the weight."""
        return self.alpha >= 0.95 or self.beta >= 0.95 or self.alpha == 0 or self.beta == 0


def fuse(lexical: DataFrame, vector: DataFrame, keys: list[str], config: RankingConfig | None = None, limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of two lists with columns ``keys`` and rank (from 1).

    keys, lexical_rank, vector_rank, lexical_part, vector_part, score and final_rank; a side without the
    item adds nothing.  Each list is cut to the candidate limit before the join.
    """
    c = config or RankingConfig()
    best = lambda df, name: df.filter(F.col("rank") <= c.candidate_limit).groupBy(*keys).agg(F.min("rank").alias(name))
    both = best(lexical, "lexical_rank").join(best(vector, "vector_rank"), keys, "full")
    part = lambda w, r: F.coalesce(w / (c.rrf_k + F.col(r)), F.lit(0.0))
    both = both.withColumn("lexical_part", part(c.alpha, "lexical_rank")).withColumn("vector_part", part(c.beta, "vector_rank"))
    scored = both.withColumn("score", F.col("lexical_part") + F.col("vector_part")).orderBy(F.desc("score"), *keys).limit(limit or c.top_k)
    return scored.withColumn("final_rank", F.row_number().over(Window.orderBy(F.desc("score"), *keys)))


def mmr(rows: pd.DataFrame, config: RankingConfig) -> pd.DataFrame:
    """Rows of columns path and score in the order of maximal marginal relevance, at most so many a path."""
    rows = rows.sort_values(["score", *[c for c in rows.columns if c not in ("score", "path")]], ascending=[False] + [True] * (len(rows.columns) - 2), kind="stable")
    if not config.diversify or len(rows) <= 1 or rows["path"].nunique() == 1:
        return rows.assign(penalty=0.0, final_rank=range(1, len(rows) + 1))
    left, chosen, counts = rows.to_dict("records"), [], {}
    similar = {}

    def likeness(a: str, b: str) -> float:
        key = (a, b) if a < b else (b, a)
        if key not in similar:
            similar[key] = path_likeness(a, b)
        return similar[key]

    near = [0.0] * len(left)
    while left:
        best = max(range(len(left)), key=lambda i: (config.lambda_ * left[i]["score"] - (1 - config.lambda_) * near[i], -i))
        row, penalty = left.pop(best), near.pop(best)
        if counts.get(row["path"], 0) >= config.max_per_file:
            continue
        counts[row["path"]] = counts.get(row["path"], 0) + 1
        chosen.append({**row, "penalty": (1 - config.lambda_) * penalty if chosen else 0.0, "final_rank": len(chosen) + 1})
        near = [max(n, likeness(r["path"], row["path"])) for n, r in zip(near, left, strict=True)]
    return pd.DataFrame(chosen)


def path_likeness(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    previous = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        previous = row
    return 1 - previous[-1] / max(len(a), len(b))


def diversify(results: DataFrame, path: str = "file_path", score: str = "score", ties: list[str] | None = None, config: RankingConfig | None = None) -> DataFrame:
    """results in an order that weighs relevance against likeness of paths already chosen, and caps a path.

    The choice is sequential, so it works on the candidate limit's rows, the best ones, in one task.
    """
    c = config or RankingConfig()
    ties = ties or [path]
    other = [n for n in results.columns if n not in (path, score)]
    best = results.orderBy(F.desc(score), *ties).limit(c.candidate_limit).select(F.col(path).alias("path"), F.col(score).cast("double").alias("score"), *other)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in best.schema), "penalty double", "final_rank int"])

    def run(frames):
        every = [f for f in frames if len(f)]
        if every:
            yield mmr(pd.concat(every), c)

    return best.coalesce(1).mapInPandas(run, schema).withColumnsRenamed({"path": path, "score": score})


def symbol_priority(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in SYMBOL_PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit(SYMBOL_PRIORITY["unknown"])) / 100.0


def query_languages(query: str) -> set[str]:
    """Languages that a query names, or hints at by an extension."""
    found = {w for w in re.findall(r"[a-z+#-]+", query.lower()) if w in set(P.LANGUAGES.values())}
    return found | {P.LANGUAGES[e] for e in re.findall(r"\.[a-z]+\b", query.lower()) if e in P.LANGUAGES}


def break_ties(results: DataFrame, query: str, ties: list[str], config: RankingConfig | None = None) -> DataFrame:
    """results with tie_score and final score: where scores lie within the threshold of the best of their
    group, symbol type, path, language and identifier decide.

    results: file_path, symbol_type, symbol_name, language, score.  Ties are looked for among the candidate
    limit's best rows; all others follow them with a tie_score of 0 and no group.
    """
    c = config or RankingConfig()
    w = c.tie_weights
    languages = query_languages(query)
    words = [x.lower() for x in re.findall(r"\w+", query)]
    language = F.col("language").isin(*languages) if languages else F.lit(False)
    identifier = F.lower("symbol_name").isin(*words) if words else F.lit(False)
    combined = w["symbol"] * symbol_priority(F.col("symbol_type")) + w["path"] * P.priority(F.col("file_path")) + w["language"] * F.coalesce(language.cast("int"), F.lit(0)) + w["identifier"] * F.coalesce(identifier.cast("int"), F.lit(0))
    scratch = Scratch(results.sparkSession, "ties")
    listed = scratch.write(results.withColumn("combined", combined).orderBy(F.desc("score"), *ties).limit(c.candidate_limit))
    # Repeated rows count one by one: what is left of each, after the ones listed.
    columns = results.columns
    rest = results.exceptAll(listed.select(*columns))
    rows = listed.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), *ties, F.struct(*listed.columns).alias("row")))).alias("rows"))
    zero = F.struct(F.lit(None).cast("double").alias("head"), F.lit(0).alias("no"), F.expr("CAST(array() AS array<int>)").alias("groups"))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(a["head"] - x["row"]["score"] <= c.tie_threshold, F.lit(False))
        no = F.when(same, a["no"]).otherwise(a["no"] + 1)
        return F.struct(F.when(same, a["head"]).otherwise(x["row"]["score"]).alias("head"), no.alias("no"), F.concat(a["groups"], F.array(no)).alias("groups"))

    grouped = rows.select(F.explode(F.arrays_zip("rows", F.aggregate("rows", zero, step, lambda a: a["groups"]).alias("groups"))).alias("x")).select("x.rows.row.*", F.col("x.groups").alias("tie_group"))
    tied = F.count(F.lit(1)).over(Window.partitionBy("tie_group")) > 1
    out = grouped.withColumn("tie_score", F.when(tied, c.gamma * F.col("combined")).otherwise(0.0)).select(*columns, "tie_group", "tie_score")
    out = out.unionByName(rest.select(*columns, F.lit(None).cast("int").alias("tie_group"), F.lit(0.0).alias("tie_score")))
    return out.withColumn("final_score", F.col("score") + F.col("tie_score"))
