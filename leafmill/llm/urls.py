"""URL filters: rules on hosts and paths, and a logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """verdict for urls of the host or a subdomain of it whose path starts with path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


# The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path up to a query or fragment. Both are empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits; null without one."""
    pattern = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.pattern), r.pattern)):
        fits = rule.fits(host, path)
        pattern = (F if pattern is None else pattern).when(fits, F.lit(rule.pattern))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(rule.verdict))
    none = F.lit(None).cast("string")
    return (none, none) if pattern is None else (pattern.otherwise(none), verdict.otherwise(none))


def ngrams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of the host, its parts marked by dots, and of the path; the same n-gram in either is two."""

    def of(text: Column, mark: str) -> Column:
        parts = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i, n=n: F.concat(F.lit(mark), text.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>")) for n in sizes]
        return F.concat(*parts)

    return F.concat(of(F.concat(F.lit("."), host, F.lit(".")), "h"), of(F.concat(path, F.lit(" ")), "p"))


def train(labelled: DataFrame, host: str = "host", path: str = "path", label: str = "label", buckets: int = 1 << 14, max_rows: int = 20_000, iterations: int = 20) -> Transformer | None:
    """A model of label (1.0: block) from at most max_rows distinct labelled rows, half of them of each label, those with
    the least hashes; none without rows.

    Rows with a null in any of the three columns are left out. Copies of a row count once.
    """
    rows = labelled.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(label).cast("double").alias("label")).dropna().distinct()
    blocked, allowed = (rows.filter((F.col("label") > 0) == b).orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_rows // 2) for b in (True, False))
    rows = blocked.union(allowed).withColumn("ngrams", ngrams(F.col("host"), F.col("path")))
    if rows.isEmpty():
        return None
    steps = [HashingTF(inputCol="ngrams", outputCol="features", numFeatures=buckets, binary=True), LogisticRegression(maxIter=iterations, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows)


def judge(urls: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, model: PipelineModel | None = None, at_least: float = 0.5) -> DataFrame:
    """urls with host, path, rule, verdict and probability (of block, null where a rule decides or without a model).

    The longest rule that fits decides, else the model; without a model urls are allowed. These five columns replace
    columns of the same names.
    """
    host, path = host_and_path(F.col(url))
    out = urls.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    out = out.withColumns({"rule": rule, "verdict": verdict})
    if model is None:
        return out.withColumns({"probability": F.lit(None).cast("double"), "verdict": F.coalesce("verdict", F.lit("allow"))})
    kept = [c for c in out.columns if c not in ("probability", "rawPrediction", "prediction", "ngrams", "features")]
    scored = model.transform(out.select(*kept, ngrams(F.col("host"), F.col("path")).alias("ngrams")))
    p = F.when(F.col("rule").isNull(), vector_to_array("probability")[1])
    return scored.select(*kept, p.alias("probability")).withColumn("verdict", F.coalesce("verdict", F.when(F.col("probability") >= at_least, "block").otherwise("allow")))
