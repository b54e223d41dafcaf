"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed key is host + path: it stands for its host, all subdomains, and every path that starts with its own. A URL's
possible keys are its host's suffixes with its path cut at the lengths that the list has. The Bloom filter is a table of
blocks of four 64-bit words; a key is looked up in the block of its hash by an equi-join, so the filter may be of any
size, and what passes is joined with the list itself, which removes false positives. The longest listed key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

#: Bits of a key in its block, and keys of a block on average: about one key in 3,000 passes falsely.
BITS, KEYS = 6, 12
WORDS = 4

# The rules of the query, as (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
# Sites that the query lists besides the rules unless it is given a table of others: gambling, pills, adult, spam and
# tracking; each with the endings com, net and org.
LISTED_SITES = ("ads-track.example", "adult-x.example", "casino-win.example", "cheap-pills.example", "free-bets.example", "spam-farm.example")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def site_of(host: Column) -> Column:
    """A host in canonical form, as sites are listed: escapes read, lower case, without user, port and the root's dots."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")
    read = F.when(F.instr(bare, "%") > 0, F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(F.translate(read, UPPER, LOWER), r"\.+\z", ""), r"\A\.+", "")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _mask(key: Column, word: int) -> Column:
    """The key's bits in that word of its block."""
    bits = [F.pmod(F.xxhash64(key, F.lit(k + 1)), F.lit(64 * WORDS)) for k in range(BITS)]
    one = [F.when(F.floor(b / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long")) for b in bits]
    out = one[0]
    for x in one[1:]:
        out = out.bitwiseOR(x)
    return out


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the filter of column key."""
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(*[F.bit_or(_mask(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)])


def rule_table(spark: SparkSession, rules=RULES, sites: DataFrame | None = None) -> DataFrame:
    """host, path, verdict, rule: the rules, and as blocked keys without a rule's name the listed sites.

    sites: a table of any size with a column site, e.g. a public block list; its sites are made canonical here.
    """
    named = spark.createDataFrame([(h, p, v, f"{h}{p}") for h, p, v in rules], "host string, path string, verdict string, rule string")
    if sites is None:
        sites = spark.createDataFrame([(f"{s}.{end}",) for s in LISTED_SITES for end in ("com", "net", "org")], "site string")
    listed = sites.select(site_of(F.translate("site", UPPER, LOWER)).alias("host")).where("host <> ''").distinct()
    return named.unionByName(listed.select("host", F.lit("/").alias("path"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule")))


def filter_urls(pages: DataFrame, listed: DataFrame, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row, in the order of no importance.

    listed: host, path, verdict, rule; rows with a rule come before those without, then the longest host + path wins, and
    of equal ones the least verdict. A URL that is null or has no :// has an empty host and path and fits nothing. An empty
    path is looked up as /, as browsers ask for it, and a host in canonical form (site_of), in keys without a rule only. URLs of any
    length are judged whole. Repeated rows are judged alike; null page
    ids are kept; an empty table gives an empty result, and an empty list the other verdict. Further columns are not read.
    """
    keys = staged(listed.select(F.concat(F.col("host"), F.lit(" "), F.col("path")).alias("key"), F.length("path").alias("at"), "verdict", "rule", (F.length("host") + F.length("path")).alias("length"), F.size(F.split("host", r"\.")).alias("labels")), "listed")
    n, longest = keys.agg(F.count("*"), F.max("labels")).first()
    lengths = [r[0] for r in keys.select("at").distinct().orderBy("at").collect()]
    blocks = max(1, -(-n // KEYS))

    seen = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    seen = seen.withColumn("site", site_of(F.col("host")))

    def suffixes(host: str) -> Column:
        labels = F.split(host, r"\.")
        return F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (longest or 1) + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    whole = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.length(whole))
    possible = lambda host: F.array_distinct(F.flatten(F.transform(suffixes(host), lambda s: F.transform(cuts, lambda k: F.concat(s, F.lit(" "), F.substring(whole, F.lit(1), k))))))
    asked = seen.select("url", (F.col("path") == "").alias("sites"), F.explode(possible("host")).alias("key"))
    asked = asked.unionByName(seen.where("site not in (host, '')").select("url", F.lit(True).alias("sites"), F.explode(possible("site")).alias("key")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    passes = F.lit(True)
    for w in range(WORDS):
        mask = _mask(F.col("key"), w)
        passes = passes & (F.col(f"w{w}").bitwiseAND(mask) == mask)
    hits = asked.join(bloom_blocks(keys, blocks), "block").where(passes).select("url", "sites", "key")
    exact = hits.join(keys.drop("labels"), "key").where(~F.col("sites") | F.col("rule").isNull())
    rank = F.struct(F.col("rule").isNotNull().alias("named"), F.col("length"), (F.col("verdict") != "allow").alias("v"))
    best = exact.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def _sql() -> str:
    rules = [f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in RULES]
    sites = [f"('{s}.{e}')" for s in LISTED_SITES for e in ("com", "net", "org")]
    bare = r"regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '')"
    site = rf"regexp_replace(regexp_replace(translate(CASE WHEN contains({bare}, '%') THEN coalesce(try(url_decode({bare})), {bare}) ELSE {bare} END, '{UPPER}', '{LOWER}'), '\.+$', ''), '^\.+', '')"
    return f"""
WITH rules(lhost, lpath, verdict, rule) AS (VALUES {", ".join(rules)}),
sites(name) AS (VALUES {", ".join(sites)}),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
sited AS (SELECT *, {site} AS site FROM parts),
hits AS (SELECT n, rule, verdict, length(lhost) + length(lpath) AS size FROM sited JOIN rules ON (host = lhost OR ends_with(host, '.' || lhost)) AND starts_with(path, lpath)
  UNION ALL SELECT n, NULL, 'block', 0 FROM sited JOIN sites ON site = name OR ends_with(site, '.' || name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY (rule IS NULL), size DESC, verdict DESC) AS k FROM hits)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM ranked WHERE k = 1) USING (n)"""


ORACLE = _sql()
