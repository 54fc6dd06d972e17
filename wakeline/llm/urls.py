"""URL filters: rules over hosts and paths, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path): a rule fits the host and its subdomains and paths that start with `path`.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: General vocabulary of host names. Stems of unwanted sites by kind of site, and of harmless ones by
#: subject; suffixes that either kind takes. Written without any crawl or table at hand; no entry is a host name.
BAD_STEMS = (
    "poker roulette blackjack slots jackpot casino betting lottery bingo gambling sportsbook wager "
    "viagra cialis xanax tramadol steroids pills pharmacy weightloss dietpill painkiller "
    "porn xxx erotic escort hentai camgirl nude milf fetish hookup adult stripper "
    "malware phishing keylogger trojan exploit botnet ransomware spyware "
    "warez keygen torrent serialz nulled cracked "
    "spam clickbait popunder adserver tracker adclick doubleads linkfarm seotraffic followers "
    "payday quickcash getrich bitcoindouble forexsignal ponzi freemoney prize replica fakewatch"
).split()
GOOD_STEMS = (
    "news weather recipe library museum garden travel school science history music software clinic council university "
    "football bookshop gallery wiki forum family nature math physics chemistry literature theatre market energy engineering "
    "docs baker bicycle bridge builder camera castle cinema coffee college computer cooking dance dentist design diary "
    "doctor economy editor education electric farmer fashion festival film fishing florist forest furniture geography "
    "geology grammar guitar harbour health hiking holiday hospital hotel housing insurance island jewelry journal justice "
    "kindergarten kitchen language lawyer lighthouse magazine maps medicine meteorology mountain newspaper observatory "
    "office opera orchestra painting parish park philosophy photo piano planet poetry police politics post press printing "
    "project railway record research restaurant river running sailing season shoes society sports station stories studio "
    "summer surgery teacher technology tennis theology tourism town training translation valley village vision volunteer "
    "walking water wedding wildlife window winter workshop world writer zoology"
).split()
SUFFIXES = "|online|24|club|hub|zone|the-|my|best-".split("|")
HOSTS = ("{}.com", "www.{}.net", "{}.org", "{}.info", "m.{}.co", "blog.{}.eu")
PATHS = ("", "/", "/index.html", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}", "/page/{n}")
#: Chance of a block that the regression assumes before it sees a url.
PRIOR = 0.2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def labelled_urls(spark: SparkSession, bad=BAD_STEMS, good=GOOD_STEMS) -> DataFrame:
    """The small labelled table (url, label), about 4,000 rows made by rule: each stem with some suffixes (those
    that end in - or are `my` come first), host forms and paths, dealt out alike to both labels, so only the stems
    tell them apart."""
    rows = []
    for label, stems in ((1.0, bad), (0.0, good)):
        for i, stem in enumerate(stems):
            for j, suffix in enumerate(SUFFIXES):
                name = suffix + stem if suffix.endswith("-") or suffix == "my" else stem + suffix
                for k in (0, 3):
                    n = i + j + k
                    path = PATHS[(3 * j + n) % len(PATHS)].format(n=1 + 37 * n % 900)
                    rows.append((f"https://{HOSTS[n % len(HOSTS)].format(name)}{path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def ngrams(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of ^host$ and ^path$, marked by which of the two they come from."""

    def of(text: Column, mark: str, n: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(n))))
        return F.when(F.length(framed) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(host, "h", n) for n in sizes), *(of(path, "p", n) for n in sizes))


def fit(
    labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), features: int = 1 << 16, prior: float = PRIOR
) -> PipelineModel:
    """Fit on the labelled table (url, label), which is small by contract; whole, whatever its order.

    Rows without a label are left out. The labels weigh `prior` and 1 - prior together, whatever their numbers.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.filter("label IS NOT NULL")
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.when(F.col("label") > 0, prior / max(1, share.get(1.0, 1))).otherwise((1 - prior) / max(1, share.get(0.0, 1)))
    rows = known.select(ngrams(host, path, sizes).alias("_grams"), "label", (weight * sum(share.values())).alias("_weight"))
    rows = rows.coalesce(1)
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    regression = LogisticRegression(
        featuresCol="_features", labelCol="label", rawPredictionCol="_raw", probabilityCol="_probability",
        predictionCol="_prediction", weightCol="_weight", regParam=0.0005, maxIter=60, standardization=False,
    )
    vectors = hashing.transform(rows).cache()
    model = PipelineModel([hashing, regression.fit(vectors)])
    vectors.unpersist()
    return model


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    none = F.lit(None).cast("string")
    text = reduce(lambda out, r: F.when(fits(r), F.lit(r[1] + r[2])).otherwise(out), reversed(ordered), none)
    action = reduce(lambda out, r: F.when(fits(r), F.lit(r[0])).otherwise(out), reversed(ordered), none)
    return text, action


def judge_urls(pages: DataFrame, model: PipelineModel, id_col="page_id", url_col="url", rules=RULES, sizes=(3, 4, 5)):
    """One row for each input row: page_id, host, path, rule, verdict, score (the method's chance of block).

    Row by row, without a shuffle. A null url or one without :// has empty host and path and is left to the
    method. Repeated rows give repeated rows, an empty table none; other columns, whatever their names, don't matter.
    """
    host, path = host_and_path(F.col("_url"))
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("_grams", ngrams(F.col("host"), F.col("path"), sizes))
    scored = model.transform(p).withColumn("score", vector_to_array("_probability")[1])
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "score")
