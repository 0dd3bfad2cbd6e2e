"""URL filter: host and path rules, and logistic regression on hashed character n-grams for the rest.

Everything is column expressions; the model is fitted with Spark's own DataFrame
estimator on a small labelled URL table and applied as one array of weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule as written, host, path, verdict)
RULES = (
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
)

#: Labelled URLs: 1 is block
LABELLED = (
    ("https://ads.example.com/click?id=1", 1), ("http://ads-track.example.net/en/4", 1),
    ("https://track.example.org/pixel.gif", 1), ("https://adserver.example.com/banner/3", 1),
    ("http://clicktrack.example.net/redirect", 1), ("https://m.ads.example.net/de/88", 1),
    ("https://casino-bonus.example.com/slots", 1), ("http://best-casino.example.net/win", 1),
    ("https://poker.example.com/bonus", 1), ("https://betting.example.net/odds", 1),
    ("http://cheap-pills.example.com/buy", 1), ("https://viagra-shop.example.net/order", 1),
    ("https://xxx-videos.example.com/", 1), ("http://porn.example.net/watch", 1),
    ("https://spam-links.example.com/seo", 1), ("http://free-download.example.net/crack.exe", 1),
    ("https://warez.example.com/keygen", 1), ("http://phish-login.example.net/verify/account", 1),
    ("https://malware.example.com/payload.exe", 1), ("http://popup-ads.example.com/show", 1),
    ("https://tracker.example.net/beacon", 1), ("http://spam.example.com/offers", 1),
    ("https://affiliate-ads.example.net/go", 1), ("https://doubleads.example.com/en/12", 1),
    ("https://news.example.com/en/2024/story", 0), ("https://blog.example.net/de/beitrag", 0),
    ("http://docs.example.org/guide/intro", 0), ("https://wiki.example.net/article/Spark", 0),
    ("https://m.example.net/en/1234", 0), ("https://www.example.com/es/noticias/77", 0),
    ("http://library.example.org/books/9", 0), ("https://university.example.net/courses", 0),
    ("https://science.example.com/papers/5", 0), ("https://forum.example.net/fr/sujet/12", 0),
    ("https://recipes.example.com/en/soup.html", 0), ("http://museum.example.org/collection", 0),
    ("https://health.example.net/en/advice", 0), ("https://city.example.com/de/rathaus", 0),
    ("https://therea.example.net/en/24571", 0), ("http://tionsh.example.net/fr/25930", 0),
    ("https://blog.thering.example.com/en/7198", 0), ("https://history.example.org/es/siglo", 0),
    ("http://weather.example.net/en/forecast", 0), ("https://travel.example.com/es/madrid", 0),
    ("https://m.therha.example.net/en/35332/", 0), ("https://www.ththan.example.net/en/12938", 0),
    ("https://school.example.net/de/klasse", 0), ("https://code.example.com/en/tutorial", 0),
)

GRAMS = (3, 4)
BUCKETS = 2048
THRESHOLD = 0.5
REGULARISATION = 0.01


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, domain, start, says in sorted(RULES, key=lambda r: len(r[0])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _hashed(mark: str, text: Column, n: int) -> Column:
    count = F.greatest(F.char_length(text) - F.lit(n - 1), F.lit(1))
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"),
    )


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and path, each with its own marks; empty parts give those of the marks."""
    parts = []
    for mark, text in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), text, F.lit("$$"))
        for n in GRAMS:
            parts.append(_hashed(mark, framed, n))
    return F.concat(*parts)


@dataclass(frozen=True)
class UrlModel:
    bias: float
    weights: tuple[float, ...]

    def probability(self, host: Column, path: Column) -> Column:
        """Probability of block: the mean weight of the n-grams, scaled as in training."""
        found = grams(host, path)
        table = F.array(*(F.lit(w) for w in self.weights))
        total = F.aggregate(found, F.lit(0.0), lambda sum_, b: sum_ + F.element_at(table, b + 1))
        z = F.lit(self.bias) + total / F.sqrt(F.size(found).cast("double"))
        return 1 / (1 + F.exp(-z))


def train(labelled: DataFrame) -> UrlModel:
    """Fit on a small table (url, blocked); its size is the caller's bound. Rows with nulls are left out.

    An n-gram's value is its count over the root of the number of n-grams, so that
    long URLs do not outweigh short ones.
    """
    usable = labelled.select("url", F.col("blocked").cast("double").alias("label")).dropna()
    found = grams(host_of(F.col("url")), path_of(F.col("url")))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
        lambda b: F.size(F.filter(F.col("found"), lambda x: x == b)) / F.sqrt(F.size("found")),
    )
    rows = usable.withColumn("found", found).select(
        "label", array_to_vector(counts.cast("array<double>")).alias("features")
    )
    fitted = LogisticRegression(
        maxIter=100, regParam=REGULARISATION, standardization=False, aggregationDepth=2
    ).fit(rows)
    return UrlModel(float(fitted.intercept), tuple(float(w) for w in fitted.coefficients.toArray()))


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, block_probability), one per page.

    A null url, or one without `://`, has an empty host and path, which no rule
    fits, and is judged by the model like any other. Null ids are kept; repeated
    rows are judged alike; other columns are ignored; an empty table gives none.
    """
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(list(LABELLED), "url string, blocked int")
    model = train(labelled)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = parts.select(
        "*", rule.alias("rule"), verdict.alias("_says"),
        model.probability(F.col("host"), F.col("path")).alias("block_probability"),
    )
    learned = F.when(F.col("block_probability") >= THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_says", learned).alias("verdict"), "block_probability",
    )
