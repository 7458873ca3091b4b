"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML; no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most labelled URLs that a fit looks at, by the hash of the URL.
FIT_URLS = 20_000
BLOCK_FROM = 0.5

#: Words of the default labelled URLs' hosts, dealt to both labels alike.
WORDS = "river garden library museum science weather history kitchen journal market school travel music health forest bridge studio harbor letters prize bonus deal click ticket".split()
#: Traits of a default URL and how often they occur with label 0 and 1. None decides alone; together they tell most URLs.
TRAITS = {"hyphens": (0.25, 0.55), "digits": (0.12, 0.45), "deep": (0.25, 0.6), "parameters": (0.2, 0.6), "token": (0.12, 0.5), "wordy": (0.2, 0.45), "suffix": (0.2, 0.6)}
#: Suffixes by the last trait, and the share of labels that are turned round.
USUAL, UNUSUAL, NOISE = ("com", "org", "net", "example.com", "example.org"), ("info", "top", "biz", "xyz", "example.net"), 0.03
DEFAULT_URLS = 12_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lowered; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are host + path; they hold for subdomains too."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "parameter_length", "longest_label", "vowel_ratio", "suffix_length", "suffix_rate"]


def lexical_features(df: DataFrame, suffix_rates: dict[str, float], prior: float) -> DataFrame:
    """df (with `url`) and the columns of FEATURES. A null url counts as empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    df = df.withColumns({"_url": url, "_host": host_of(url), "_path": path_of(url)})
    host, path, size = F.col("_host"), F.col("_path"), lambda c: F.length(c).cast("double")
    only = lambda c, pattern: size(F.regexp_replace(c, pattern, ""))
    share = lambda a, b: a / F.greatest(b, F.lit(1.0))
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    letters = F.filter(F.split(host, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(letters), lambda c: size(host) - size(F.replace(host, c)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - n / size(host) * F.log2(n / size(host)))
    suffix = F.substring_index(host, ".", -1)
    known = F.create_map(*[F.lit(x) for kv in sorted(suffix_rates.items()) for x in kv]) if suffix_rates else F.create_map(F.lit(""), F.lit(prior))
    rates = F.coalesce(F.try_element_at(known, suffix), F.lit(prior))
    return df.withColumns(
        {
            "url_length": size("_url"),
            "host_length": size(host),
            "path_length": size(path),
            "depth": only(path, "[^/]"),
            "labels": only(host, "[^.]"),
            "hyphens": only(host, "[^-]"),
            "digit_ratio": share(only(F.col("_url"), "[^0-9]"), size("_url")),
            "host_digit_ratio": share(only(host, "[^0-9]"), size(host)),
            "entropy": F.coalesce(entropy, F.lit(0.0)),
            "parameters": F.when(query == "", 0.0).otherwise(only(query, "[^&]") + 1),
            "parameter_length": size(query),
            "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), F.lit(0)).cast("double"),
            "vowel_ratio": share(only(host, "[^aeiou]"), size(host)),
            "suffix_length": size(suffix),
            "suffix_rate": rates,
        }
    ).drop("_url", "_host", "_path")


def default_labelled_urls(spark: SparkSession, rows: int = DEFAULT_URLS) -> DataFrame:
    """url, label (1: unwanted) and family (three URLs share one, and its host), made by rule from hashes of a number.

    Each trait is dealt by its own chance given the label, independently of the
    others, so both labels have hyphens, digits, depths, parameters, random
    tokens, long hosts and every suffix. These labels are synthetic: they show that the
    trees learn from several features, not how unwanted pages of the web look.
    """
    family = F.floor(F.col("id") / 3)
    chance = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), of), F.lit(10_000)) / 10_000
    pick = lambda salt, of, words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64(F.lit(salt), of), F.lit(len(words))) + 1).cast("int"))
    df = spark.range(rows).withColumn("family", family).withColumn("kind", F.pmod(F.xxhash64(F.lit("label"), "family"), F.lit(2)).cast("int"))
    of_host = {"hyphens", "digits", "wordy", "suffix"}
    for name, (good, bad) in TRAITS.items():
        df = df.withColumn(name, chance(name, F.col("family") if name in of_host else F.col("id")) < F.when(F.col("kind") == 1, bad).otherwise(good))
    dash = F.when(F.col("hyphens"), "-").otherwise("")
    host = F.concat(pick("a", "family", WORDS), dash, pick("b", "family", WORDS), F.when(F.col("wordy"), F.concat(dash, pick("c", "family", WORDS))).otherwise(""), F.when(F.col("digits"), F.pmod(F.xxhash64("family"), F.lit(990)).cast("string")).otherwise(""))
    suffix = F.when(F.col("suffix"), pick("u", "family", UNUSUAL)).otherwise(pick("s", "family", USUAL))
    folders = F.when(F.col("deep"), F.concat(pick("d", "id", WORDS), F.lit("/"), pick("e", "id", WORDS), F.lit("/"), pick("f", "id", WORDS), F.lit("/"))).otherwise("")
    page = F.when(F.col("token"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string"))
    query = F.when(F.col("parameters"), F.concat(F.lit("?ref="), pick("q", "id", WORDS), F.lit("&id="), F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(9999)).cast("string"))).otherwise(pick("t", "id", ("", "/", ".html", "#top", "?page=2")))
    url = F.concat(pick("h", "id", ("http://", "https://")), pick("w", "family", ("", "www.", "m.", "blog.")), host, F.lit("."), suffix, pick("l", "id", ("/", "/en/", "/fr/", "/de/", "/es/")), folders, page, query)
    label = F.when(chance("noise", F.col("id")) < NOISE, 1 - F.col("kind")).otherwise(F.col("kind"))
    return df.select(url.alias("url"), label.alias("label"), "family")


class UrlModel:
    """Trees and the suffix statistics that they were fitted with."""

    def __init__(self, trees: PipelineModel, suffix_rates: dict[str, float], prior: float):
        self.trees, self.suffix_rates, self.prior = trees, suffix_rates, prior

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df (with `url`) and the trees' probability of label 1; other columns stay, whatever their names, but one named `out`."""
        kept = [c for c in df.columns if c != out]
        slim = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("url"))
        scored = self.trees.transform(lexical_features(slim, self.suffix_rates, self.prior))
        return scored.select("_row.*", vector_to_array("probability").getItem(1).alias(out))

    def importances(self) -> dict[str, float]:
        """Each feature's share of the gain."""
        return dict(zip(FEATURES, self.trees.stages[-1].featureImportances.toArray().tolist(), strict=True))


def fit(labelled: DataFrame, rows: int = FIT_URLS) -> UrlModel:
    """Gradient-boosted trees from at most `rows` labelled URLs (url, label 0 or 1), taken by the hash of the URL."""
    sample = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("url"), "url").limit(rows)
    suffix = F.substring_index(host_of(F.col("url")), ".", -1)
    seen = sample.groupBy(suffix.alias("suffix")).agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")).orderBy("suffix").collect()  # of a bounded sample
    bad, n = sum(r["bad"] for r in seen), sum(r["n"] for r in seen)
    prior = (bad + 1) / (n + 2)
    rates = {r["suffix"]: (r["bad"] + 20 * prior) / (r["n"] + 20) for r in seen}
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, seed=1)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    # a bounded sample: one part, so that a round of boosting is one small task on any cluster
    fitted = trees.fit(assembler.transform(lexical_features(sample, rates, prior)).select("_features", "label").coalesce(1))
    return UrlModel(PipelineModel([assembler, fitted]), rates, prior)


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, block_from: float = BLOCK_FROM) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    The longest fitting rule decides, else the trees' probability. Null and
    malformed urls have an empty host and path and get the trees' verdict.
    Repeated rows stay; no other column is read.
    """
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"))
    scored = model.score(slim)
    host, path = host_of(F.coalesce("url", F.lit(""))), path_of(F.coalesce("url", F.lit("")))
    scored = scored.select("page_id", host.alias("host"), path.alias("path"), "score")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "score")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """filter_urls() of all pages, by a model of the default labelled URLs; malformed and null urls as it says."""
    model = fit(default_labelled_urls(spark))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), model).drop("score")
