"""Verdicts on URLs: host and path rules first, boosted trees on lexical features for the rest.

The trees learn from the URLs that a rule decides. Everything here is DataFrame and SQL
functions and Spark's own boosted trees; no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIT_ROWS = 4000
TREES, DEPTH = 20, 4
SUFFIX_WEIGHT = 20.0


def host_of(url: Column) -> Column:
    """What lies between the first `://` and the next `/`, `?`, `#` or the end, A-Z folded."""
    found = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null; `block` wins ties."""
    choices = []
    for verdict, rule in rules:
        own_host, slash, own_path = rule.partition("/")
        fits = (host == own_host) | host.endswith(f".{own_host}")
        choices.append(F.when(fits & path.startswith(slash + own_path), F.struct(
            F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"),
            F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*choices))


def _entropy(text: Column) -> Column:
    """Bits per character of a text."""
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(
        F.length(c) > 0, F.length(text) - F.length(F.replace(text, c, F.lit("")))).otherwise(0))
    total = F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a - F.when(
        n > 0, n / total * F.log2(n / total)).otherwise(0.0))


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers drawn from the URL's characters alone."""
    text = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    rest = F.regexp_extract(text, "(?s)[?#](.*)$", 1)

    def count(pattern: str, of: Column = text) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    label = F.substring_index(host, ".", -1)
    segment = F.regexp_extract(path, "^/([^/]*)", 1)
    return {
        "url_length": F.length(text).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "query_length": F.length(rest).cast("double"),
        "depth": count("/[^/]", path), "labels": count("\\.", host) + 1,
        "digits": count("[0-9]") / size, "host_digits": count("[0-9]", host),
        "upper": count("[A-Z]") / size, "symbols": count("[^A-Za-z0-9]") / size,
        "hyphens": count("-"), "parameters": count("[?&][^=&#]*="), "escapes": count("%"),
        "entropy": _entropy(text), "host_entropy": _entropy(host),
        "secure": F.coalesce(text.startswith("https:"), F.lit(False)).cast("double"),
        "www": host.startswith("www.").cast("double"), "ends_in_slash": path.endswith("/").cast("double"),
        "dotted_name": count("\\.[a-z0-9]+$", path), "suffix_length": F.length(label).cast("double"),
        "segment_length": F.length(segment).cast("double"),
        "segment_first": F.ascii(segment).cast("double"),
        "segment_second": F.ascii(F.substring(segment, 2, 1)).cast("double"),
    }


def _suffix_share(suffix: Column, shares: dict[str, float], usual: float) -> Column:
    """Share of blocked URLs under a suffix, as learnt; the usual share elsewhere."""
    if not shares:
        return F.lit(usual)
    known = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.lit(usual))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
               fit_rows: int = FIT_ROWS, hold_out: Column | None = None) -> DataFrame:
    """One row per row: id, host, path, rule, verdict, block_score.

    `rules` are (verdict, host/path); one fits its host and all subdomains if the path starts
    with its path, and the longest that fits decides. The rest is judged by `TREES` boosted
    trees, fitted on at most `fit_rows` ruled URLs, those whose hashed id and URL come first;
    rows where `hold_out` is true teach nothing. `block_score` is the trees' chance of `block`
    for every row. If the ruled URLs all have one verdict, so has the rest; with none, `allow`.

    A null URL or one without `://` has an empty host and path and no rule, and is judged by
    what features it has. Null ids and repeated rows are judged like others. Other columns
    are not read.
    """
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parted = read.select("id", "url", host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"))
    ruled = parted.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    if hold_out is not None:
        ruled = ruled.withColumn("_out", F.coalesce(hold_out, F.lit(False)))
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    known = ruled.filter(F.col("ruled").isNotNull() if hold_out is None
                         else F.col("ruled").isNotNull() & ~F.col("_out"))
    sample = known.orderBy(F.xxhash64("id", "url"), "id", "url").limit(fit_rows).select(
        "host", (F.col("ruled.verdict") == "block").cast("double").alias("label"),
        *[c.alias(n) for n, c in features.items()]).persist()
    suffix = F.substring_index("host", ".", -1)
    seen = {r["suffix"]: (r["n"], r["bad"]) for r in sample.groupBy(suffix.alias("suffix")).agg(
        F.count("*").alias("n"), F.sum("label").alias("bad")).collect()}  # of fit_rows at most
    total, bad = (sum(x[i] for x in seen.values()) for i in (0, 1))
    out = [F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule")]
    if not total or bad in (0, total):
        rest = "block" if total and bad == total else "allow"
        sample.unpersist()
        return ruled.select(*out, F.coalesce("ruled.verdict", F.lit(rest)).alias("verdict"),
                            F.lit(1.0 if rest == "block" else 0.0).alias("block_score"))
    usual = bad / total
    shares = {s: (b + SUFFIX_WEIGHT * usual) / (n + SUFFIX_WEIGHT) for s, (n, b) in seen.items()}
    share = _suffix_share(suffix, shares, usual).alias("suffix_share")
    names = [*features, "suffix_share"]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=64)
    model = trees.fit(assembler.transform(sample.select("*", share).repartition(4)))
    sample.unpersist()
    scored = model.transform(assembler.transform(ruled.select(
        "id", "host", "path", "ruled", *[c.alias(n) for n, c in features.items()], share)))
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("ruled.verdict", F.when(
        score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"))
