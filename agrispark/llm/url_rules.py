"""URL verdicts from pattern rules that are indexed by their rarest literal token. DataFrame functions only.

A pattern is literal text in which ``*`` is any run, ``^`` one character that
is no letter or digit (or an end of the url), a leading ``||`` the start of a
host name or of a label in it, and ``|`` at an end that end of the url. A site
rule is a host and a beginning of the path; it fits the host and all under it.
Both become regular expressions. A literal token of a rule is a run of
``[a-z0-9]`` that stands alone in every url that the rule fits, so an url
without the token can't fit. Of a rule's tokens the one that the fewest urls
have is its key in the index; an url's tokens fetch the rules under them by an
equi-join, and only those run their expressions. Rules without such a token
lie under the empty token, which every url has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agrispark.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict
SITES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: pattern, verdict; allowing patterns outweigh blocking ones
PATTERNS = [
    ("^casino^", "block"),
    ("^casino-film^", "allow"),
    ("^poker^online^", "block"),
    ("^free-bets^", "block"),
    ("^sports-betting^", "block"),
    ("^cheap-pills^", "block"),
    ("^online-pharmacy^", "block"),
    ("^payday^loan", "block"),
    ("||adult-", "block"),
    ("||adult-education.", "allow"),
    ("||xxx.", "block"),
    (".xxx/", "block"),
    ("^spam-farm^", "block"),
    ("^link-farm^", "block"),
    ("^ads-track^", "block"),
    ("||adserver.", "block"),
    ("^banner-ads^*.gif|", "block"),
    ("^free-download^*^crack^", "block"),
    ("^keygen^", "block"),
    ("^click-here^*^win^prize^", "block"),
]
#: Copies of the index that share the urls of a token where the join is a shuffle.
SALT = 16


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased, and from there up to ``? #`` or the end; else both empty."""
    found = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lowered(F.regexp_extract(url, found, 1)), F.regexp_extract(url, found, 2)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lowered(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])", r"\\$1")


def site_rules(sites: DataFrame) -> DataFrame:
    """``host, path, verdict`` as rules; the expression is for host and path, joined."""
    host, path = lowered(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    return sites.select(
        F.concat(host, path).alias("rule"),
        "verdict",
        F.lit(True).alias("site"),
        F.length(host).alias("weight"),
        F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), _quoted(host), F.when(path == "", r"(?:/.*)?\z").otherwise(_quoted(path))).alias("expression"),
        F.array_distinct(F.concat(tokens(host), F.regexp_extract_all(lowered(path), F.lit("(?<=[^a-z0-9])([a-z0-9]+)(?=[^a-z0-9])"), F.lit(1)))).alias("tokens"),
    )


def pattern_rules(patterns: DataFrame) -> DataFrame:
    """``pattern, verdict`` as rules; the expression is for the url, A-Z lower-cased."""
    given = lowered(F.coalesce("pattern", F.lit("")))
    body = F.regexp_replace(given, r"\A\|\|?|\|\z", "")
    body = F.regexp_replace(F.regexp_replace(_quoted(body), r"\\\*", ".*"), r"\\\^", r"(?:[^a-z0-9]|\\A|\\z)")
    head = F.when(given.startswith("||"), r"\A[^/?#]*://(?:[^/?#]*\.)?").when(given.startswith("|"), r"\A").otherwise("")
    return patterns.select(
        F.col("pattern").alias("rule"),
        "verdict",
        F.lit(False).alias("site"),
        F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("weight"),
        F.concat(F.lit("(?s)"), head, body, F.when(given.endswith("|") & (F.length(given) > 1), r"\z").otherwise("")).alias("expression"),
        F.array_distinct(F.regexp_extract_all(given, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))).alias("tokens"),
    )


def token_index(rules: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Each rule under its token that the fewest rows of ``urls`` have (ties: the longest, then the smallest); the empty one if it has none."""
    own = stored(rules.select("rule", "site", "verdict", F.explode("tokens").alias("token")))
    seen = urls.select(F.explode(tokens(F.col(url_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.join(own.select("token"), "token", "left_semi")  # counted first, so that a common token is few rows
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")
    best = own.join(seen, "token", "left").groupBy("rule", "site", "verdict").agg(F.min(rank)["token"].alias("token"))
    same = (F.col("a.rule").eqNullSafe(F.col("b.rule"))) & (F.col("a.site") == F.col("b.site")) & (F.col("a.verdict").eqNullSafe(F.col("b.verdict")))
    joined = rules.drop("tokens").alias("a").join(best.alias("b"), same, "left")
    return joined.select("a.*", F.coalesce("b.token", F.lit("")).alias("token"))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of ``urls`` with ``host, path, rule, verdict, pattern``.

    rule: the longest site rule that fits (ties: the longer host, then allow,
    then the smaller text), null if none. pattern: of urls without one, the
    allowing pattern that fits, else the blocking one (ties: the longest, then
    the smallest). verdict: that rule's, else allow. A null url has empty host
    and path, no rule, and is allowed. Rows may repeat; other columns stay,
    but those of the five names are replaced. An empty rule table allows all.
    Building the query counts the rules' tokens and writes the index.

    The index, being stored, has a known size, so Spark broadcasts it below its
    threshold and else shuffles, by token and salt: no task gets all urls of a
    common token. Urls are judged once each, however often they are given, and
    verdicts stay where the distinct urls are.
    """
    host, path = host_and_path(F.col(url_col))
    rows = urls.drop("host", "path", "rule", "verdict", "pattern").withColumns({"host": host, "path": path})
    index = stored(token_index(rules, urls, url_col)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = urls.select(F.col(url_col).alias("_url")).where("_url is not null").distinct()
    own_host, own_path = host_and_path(F.col("_url"))
    own = own.withColumns({"_place": F.concat(own_host, own_path), "salt": F.pmod(F.xxhash64("_url"), F.lit(SALT)).cast("int")})
    asked = own.withColumn("token", F.explode(F.array_append(tokens(F.col("_url")), F.lit(""))))
    target = F.when(F.col("site"), F.col("_place")).otherwise(lowered(F.col("_url")))
    fits = asked.join(index, ["token", "salt"]).where(F.regexp_like(target, F.col("expression")) & (~F.col("site") | F.col("_url").contains("://")))
    size = F.length("rule")
    rank = F.struct(
        (~F.col("site")).alias("a"),
        F.when(F.col("site"), -size).otherwise(-F.col("weight")).alias("b"),
        F.when(F.col("site"), -F.col("weight")).otherwise(-size).alias("c"),
        (F.col("verdict") != "allow").alias("d"),
        "rule",
        "verdict",
        "site",
    )
    best = fits.groupBy("_url").agg(F.min(rank).alias("best"))
    out = rows.join(best, rows[url_col] == best["_url"], "left").drop("_url")
    return out.withColumns(
        {
            "rule": F.when(F.col("best.site"), F.col("best.rule")),
            "verdict": F.coalesce("best.verdict", F.lit("allow")),
            "pattern": F.when(~F.col("best.site"), F.col("best.rule")),
        }
    ).drop("best")


def default_rules(spark: SparkSession) -> DataFrame:
    def table(rows: list[tuple], *names: str) -> DataFrame:
        return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))))

    return site_rules(table(SITES, "host", "path", "verdict")).unionByName(pattern_rules(table(PATTERNS, "pattern", "verdict")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, default_rules(spark)).select("page_id", "host", "path", "rule", "verdict", "pattern")
