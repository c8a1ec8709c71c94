"""Quality by hierarchical empirical Bayes.

Evidence of a document is a logistic classifier over counts of its characters, words and lines, computed in built-in
functions.  Sites are levels of a hierarchy: a host, and paths below it.  Grouped sums of the classifier's
probabilities over all documents give each site a Beta posterior whose prior is its parent's mean, with a strength
fitted by the method of moments at that level, so sparse sites shrink to their parent and the global rate while large
ones keep their own.  A document's score adds to its own log-odds what its path's posterior, taken without the document
itself, adds to the global rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import in_training, sigmoid

FEATURES = ("words", "symbols", "pipes", "digits", "upper", "letters_a_word", "distinct_words", "distinct_lines", "words_a_line", "ends")


def features(text: Column) -> list[Column]:
    """Of a whole text; all 0 for a null or empty one."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.split(F.trim(text), r"\s+"), F.split(text, r"\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")

    def share(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))) / n

    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return [
        F.log1p(n_words), share("#$%&*@^~_=+<>{}[]"), share("|"), share("0123456789"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        letters / n_words, F.size(F.array_distinct(words)) / n_words, F.size(F.array_distinct(lines)) / n_lines,
        F.log1p(n_words / n_lines), share(".!?"),
    ]


def fit(rows: list[tuple], share: float, steps: int = 1500) -> dict:
    """Logistic regression on standardised features and their squares, the classes weighted to the given share of ones."""
    x, y = np.array([r[:-1] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r[-1] for r in rows], np.float64)
    share = min(max(share, 1e-4), 1 - 1e-4)
    if len(set(y)) < 2:
        return {"mean": [0.0] * len(FEATURES), "scale": [1.0] * len(FEATURES), "linear": [0.0] * len(FEATURES), "square": [0.0] * len(FEATURES), "bias": float(np.log(share / (1 - share)))}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    w = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    c = np.zeros(z.shape[1])
    mean_g, var_g = np.zeros_like(c), np.zeros_like(c)
    for t in range(1, steps + 1):
        g = z.T @ ((sigmoid(z @ c) - y) * w) + 1e-4 * c
        mean_g, var_g = 0.9 * mean_g + 0.1 * g, 0.99 * var_g + 0.01 * g * g
        c -= 0.05 * (mean_g / (1 - 0.9**t)) / (np.sqrt(var_g / (1 - 0.99**t)) + 1e-9)
    k = len(FEATURES)
    return {"mean": mean.tolist(), "scale": scale.tolist(), "linear": c[:k].tolist(), "square": c[k : 2 * k].tolist(), "bias": float(c[-1])}


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 6000) -> dict:
    """On a bounded sample of the training folds: at most max_docs rows, half of each class, first by hash; features only reach the driver."""
    own = labels.where(F.col("quality").isin(0, 1) & in_training("doc_id")).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("_y"))
    n, ones = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    parts = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs // 2) for y in (0, 1)]
    picked = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(parts[0].union(parts[1])), F.col("doc_id") == F.col("_id"))
    rows = picked.select("doc_id", *features(F.coalesce(F.col("text"), F.lit(""))), "_y").orderBy("doc_id").limit(2 * max_docs).collect()
    return fit([tuple(r)[1:] for r in rows], ones / n if n else 0.5)


def evidence(text: Column, model: dict) -> Column:
    """Log-odds of quality 1."""
    total = F.lit(model["bias"])
    for x, m, s, a, b in zip(features(text), model["mean"], model["scale"], model["linear"], model["square"]):
        z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (x - m) / s))
        total = total + a * z + b * z * z
    return total


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def strength(sites: DataFrame) -> float:
    """Method of moments: how many documents the parent's rate is worth to a site (_n documents of sum _s, parent's rate
    _parent) of a level; 10 where no site holds two."""
    s = sites.where(F.col("_n") > 1).select("_n", (F.col("_s") / F.col("_n")).alias("_m"), F.col("_parent"))
    r = s.agg(F.avg((F.col("_m") - F.col("_parent")) ** 2), F.avg(F.col("_parent") * (1 - F.col("_parent"))), F.avg(1 / F.col("_n"))).first()
    if r[0] is None or r[1] in (None, 0.0):
        return 10.0
    between = max(r[0] - r[1] * r[2], 1e-4 * r[1])
    return min(max(r[1] / between - 1, 1.0), 1e4)


def score_quality(docs: DataFrame, model: dict, host: Column, path: Column, pull: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, predicted of every row.

    host_rate and path_rate are posteriors without the document itself.  A null host or path is a site of its own.  Null
    and empty texts have the features of an empty text; very long texts are read whole.  Repeated rows count as often as
    they stand; ties do not arise; an empty table gives an empty table.  The site tables hold one row a site; sums over
    a hot site are combined before the shuffle.  Other columns than doc_id, text and those of host and path are not
    read, so they may have any name.
    """
    from .common import materialise

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), evidence(text, model).alias("evidence"))
    d = materialise(d.withColumn("_p", 1 / (1 + F.exp(-F.col("evidence")))), "quality")
    paths = materialise(d.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_s")), "quality-paths")
    hosts = materialise(paths.groupBy("_host").agg(F.sum("_n").alias("_hn"), F.sum("_s").alias("_hs")), "quality-hosts")
    n, s = paths.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_s"), F.lit(0.0))).first()
    rate = float(s / n) if n else 0.5
    k_host = strength(hosts.select(F.col("_hn").alias("_n"), F.col("_hs").alias("_s"), F.lit(rate).alias("_parent")))
    mean = (F.col("_hs") + k_host * rate) / (F.col("_hn") + k_host)
    sites = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = strength(sites.select("_n", "_s", mean.alias("_parent")))
    sites = sites.select(F.col("_host").alias("_h"), F.col("_path").alias("_q"), "_n", "_s", "_hn", "_hs")
    d = d.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q")))
    # A document's own evidence is in its score already, so the sums that speak for its site leave it out.
    prior = F.lit(rate) if n < 2 else (F.lit(float(s)) - F.col("_p")) / (n - 1)
    host_rate = (F.col("_hs") - F.col("_p") + k_host * prior) / (F.col("_hn") - 1 + k_host)
    d = d.withColumn("host_rate", host_rate)
    d = d.withColumn("path_rate", (F.col("_s") - F.col("_p") + k_path * F.col("host_rate")) / (F.col("_n") - 1 + k_path))
    score = 1 / (1 + F.exp(-(F.col("evidence") + pull * (logit(F.col("path_rate")) - logit(prior)))))
    return d.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host without www., in lower case, and first path segment of a URL: the levels for web pages."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    return F.regexp_extract(bare, r"^([^/:?#]*)", 1), F.regexp_extract(bare, r"^[^/?#]*/([^/?#]*)", 1)
