"""URL filter: a rule list, then logistic regression on hashed character n-grams.

Only DataFrame/SQL expressions: no Python runs on the executors.

* A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
  the end, A-Z lower-cased; its path goes on up to ``?``, ``#`` or the end.
  A null url, or one without ``://``, has an empty host and an empty path.
* A rule ``host/path`` fits its host and every subdomain when the url's path
  starts with the rule's path.  The longest fitting rule decides (ties: host,
  then path, in descending order).
* Other urls are judged by the model.  Features are the distinct hashed
  n-grams (3 to 5 characters) of ``<host>`` and of the path with digits
  written as 0, binary, scaled to unit length, plus a bias.

Training is full-batch gradient descent of the L2-regularised logistic loss.
The labelled table is small (at most ``max_labelled`` rows, a documented bound
on training rows only), so the descent runs in its dual form: the weight
vector is a combination of the training rows, w = sum(alpha_i x_i), and each
epoch updates alpha from the Gram matrix.  Both are array expressions in one
row; the result is one dense array of ``2**bits`` weights, used as a scalar
subquery, so its size is fixed.

Empty tables give an empty result; an empty labelled table gives weight zero
everywhere and the verdict ``allow``.  Repeated rows are judged alike.  Extra
columns of ``pages`` are kept only when listed in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the default labelled table: words seen in the host names of
# unwanted sites, and words of ordinary ones.
BLOCK_WORDS = ("adult", "ads", "bets", "betting", "bingo", "casino", "cheap", "click", "crack", "dating", "escort",
               "farm", "free", "gamble", "jackpot", "keygen", "loans", "lottery", "pharma", "pills", "poker", "porn",
               "replica", "sex", "slots", "spam", "torrent", "track", "viagra", "warez", "win", "xxx")
ALLOW_WORDS = ("academy", "archive", "art", "bakery", "bird", "blog", "books", "bridge", "city", "code", "college",
               "docs", "earth", "forum", "garden", "health", "help", "history", "home", "journal", "kitchen", "lab",
               "library", "map", "market", "mobile", "museum", "music", "nature", "news", "paper", "photo", "press",
               "radio", "recipes", "research", "review", "river", "school", "science", "shop", "sport", "story",
               "street", "studio", "support", "teacher", "theater", "the", "this", "thing", "train", "travel", "video",
               "weather", "wiki", "wood", "world", "writer", "www")
SUFFIXES = ("example.com", "example.org", "example.net")
PATHS = ("/en/1", "/de/22/", "/fr/333.html", "/es/4444")

BITS = 12
NGRAMS = (3, 4, 5)
MAX_LABELLED = 256
EPOCHS = 120
RATE = 15.0
L2 = 1e-4


def default_labelled(spark: SparkSession) -> DataFrame:
    """(url, label): label 1 is to be blocked; every word in a few url shapes."""
    rows = []
    for label, words in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)):
        for i, word in enumerate(words):
            other = words[(i * 7 + 3) % len(words)]
            rows.append((f"http://{word}.{SUFFIXES[i % 3]}{PATHS[i % 4]}", label))
            rows.append((f"https://www.{word}-{other}.{SUFFIXES[(i + 1) % 3]}{PATHS[(i + 1) % 4]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def deciding_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(len, host, path, rule, verdict) of the longest fitting rule, or null.

    ``rules``: (verdict, ``host/path``) pairs, a short list given by the caller.
    """
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        value = F.struct(F.lit(len(rule)).alias("len"), F.lit(h).alias("host"), F.lit("/" + p).alias("path"),
                         F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), value))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast(
        "struct<len:int,host:string,path:string,rule:string,verdict:string>")


def buckets(host: Column, path: Column, bits: int = BITS) -> Column:
    """Distinct feature buckets of a url: hashed n-grams of host and path."""
    def grams(kind: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(
            F.xxhash64(F.lit(kind), F.substring(text, i, F.lit(n))), F.lit(2 ** bits - 1)).cast("int"))

    texts = {"h": F.concat(F.lit("<"), host, F.lit(">")), "p": F.regexp_replace(path, "[0-9]+", "0")}
    parts = [grams(kind, text, n) for kind, text in texts.items() for n in NGRAMS]
    return F.array_distinct(F.concat(*parts, F.array(F.lit(2 ** bits - 1))))  # the last bucket is the bias


def train(labelled: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED, epochs: int = EPOCHS,
          rate: float = RATE, l2: float = L2) -> DataFrame:
    """One row (weights array<double>) of ``2**bits`` weights.

    Rows with a null label are left out; of more than ``max_labelled`` rows,
    those of smallest url hash are used.
    """
    url = F.col("url")
    rows = (labelled.where(F.col("label").isNotNull())
            .select(url, F.col("label").cast("double").alias("y"))
            .distinct().orderBy(F.xxhash64(url), "y").limit(max_labelled)
            .select("y", buckets(host_of(url), path_of(url), bits).alias("b"), F.xxhash64(url, "y").alias("i")))
    feats = rows.select("i", "y", F.explode("b").alias("b"), (1 / F.sqrt(F.size("b"))).alias("v"))
    other = feats.select(F.col("i").alias("j"), "b", F.col("v").alias("u"))
    gram = (feats.join(other, "b").groupBy("i", "y", "j").agg(F.sum(F.col("v") * F.col("u")).alias("k"))
            .groupBy("i", "y").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("row")))
    one = gram.agg(F.sort_array(F.collect_list(F.struct("i", "y", F.col("row.k").alias("k")))).alias("m"))

    def epoch(alpha: Column, _: Column) -> Column:
        def step(r: Column, a: Column) -> Column:
            f = F.aggregate(F.zip_with(r["k"], alpha, lambda k, x: k * x), F.lit(0.0), lambda s, x: s + x)
            p = 1 / (1 + F.exp(-f))
            return a - F.lit(rate) * ((p - r["y"]) / F.size("m") + F.lit(l2) * a)
        return F.zip_with(F.col("m"), alpha, step)

    start = F.transform("m", lambda _: F.lit(0.0))
    alpha = one.select(F.explode(F.arrays_zip(
        F.col("m.i").alias("i"), F.aggregate(F.sequence(F.lit(1), F.lit(epochs)), start, epoch).alias("alpha"))).alias("z"))
    found = (feats.join(alpha.select("z.i", "z.alpha"), "i").groupBy(F.col("b").cast("long").alias("id"))
             .agg(F.round(F.sum(F.col("v") * F.col("alpha")), 9).alias("w")))
    dense = labelled.sparkSession.range(2 ** bits).join(found, "id", "left").select("id", F.coalesce("w", F.lit(0.0)).alias("w"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("d")).select(F.col("d.w").alias("weights"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: DataFrame | None = None,
          threshold: float = 0.5, url_col: str = "url", keep: Sequence[str] = ("page_id",), bits: int = BITS) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and the model's score of every url."""
    weights = train(default_labelled(pages.sparkSession) if labelled is None else labelled, bits)
    out = (pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
           .withColumn("_rule", deciding_rule(F.col("host"), F.col("path"), rules))
           .withColumn("_b", buckets(F.col("host"), F.col("path"), bits))
           .withColumn("_w", weights.scalar()))
    dot = F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.get("_w", b)) / F.sqrt(F.size("_b"))
    score = 1 / (1 + F.exp(-dot))
    return out.withColumn("score", score).select(
        *keep, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"),
        "score")
