"""URL filters.

Two kinds of rules judge a URL. Address rules name a host (with its subdomains) and a beginning of the path; the longest
one that fits decides. Where none fits, pattern rules do: they are indexed by their rarest literal token, so the tokens of
a URL fetch the few rules that can match it, and only those run as regular expressions.

A pattern is text in which `*` stands for anything and `^` for a separator or the end. `||` before it anchors it to the
beginning of the host or of a label in it, `|` before or after it to the beginning or end of the URL, and `@@` before all
makes it an exception, which lifts the block of others. Letters A to Z match in either case.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import let, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]{2,}"
#: A token of a pattern that is one of every URL it matches: `*` and letters or digits on neither side.
WHOLE_TOKEN = r"(?<![a-z0-9*])([a-z0-9]{2,})(?![a-z0-9*])"
SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"
LABEL = r"\A[^:/?#]*://(?:[^/?#]*\.)?"
#: Rules that are a literal in every task; those of the commonest keys come first, others are joined by key.
MOST_RULES = 50_000
RULES = "array<struct<key:string,host:string,path:string,regex:string,blocks:boolean>>"


def lowered(c: Column) -> Column:
    """A to Z in lower case."""
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is after the first `://` up to `/`, `?`, `#` or the end, in lower case, and from there up to `?`, `#` or the
    end; both empty for null or without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lowered(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), "^[^?#]*", 0)


def section(path: Column) -> Column:
    """The first whole folder of a path, with the slash that ends it; empty if there is none."""
    return F.regexp_extract(path, "^/[^/]*/", 0)


def address_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, blocks), indexed by host and first folder of the path."""
    host = lowered(F.col("host"))
    key = F.concat(F.lit("h:"), host, section(F.col("path")))
    return rules.select(key.alias("key"), host.alias("host"), "path", F.lit(None).cast("string").alias("regex"), "blocks").distinct()


def pattern_rules(patterns: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rules (pattern) as regular expressions, each indexed by that one of its tokens which the least URLs have (then the
    longest). counts: key and n, of tokens that any have. A pattern without a whole token has an empty key, which all URLs have."""
    text = lowered(F.col("pattern"))
    text = F.regexp_replace(text, "^@@", "")
    label, begin, end = text.startswith("||"), text.startswith("|"), text.endswith("|")
    body = F.regexp_replace(F.regexp_replace(text, r"^\|\|?", ""), r"\|$", "")
    regex = F.regexp_replace(body, r"([.+?(){}\[\]\\$|])", r"\\$1")
    regex = F.replace(F.replace(regex, F.lit("^"), F.lit(SEPARATOR)), F.lit("*"), F.lit(".*"))
    regex = F.concat(F.when(label, LABEL).when(begin, r"\A").otherwise(""), regex, F.when(end, r"\z").otherwise(""))
    bounded = F.concat(F.when(begin, "|").otherwise("*"), body, F.when(end, "|").otherwise("*"))
    rules = patterns.where("pattern is not null").select("pattern", F.concat(F.lit("(?s)"), regex).alias("regex"), (~F.col("pattern").startswith("@@")).alias("blocks"), F.array_distinct(F.regexp_extract_all(bounded, F.lit(WHOLE_TOKEN))).alias("tokens")).distinct()
    none = F.lit(None).cast("string")
    each = rules.select("regex", "blocks", F.explode_outer("tokens").alias("token")).withColumn("key", F.concat(F.lit("t:"), F.coalesce("token", F.lit(""))))
    each = each.join(counts, "key", "left") if counts else each.withColumn("n", F.lit(0))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("token"), "key"))["key"]
    return each.groupBy("regex", "blocks").agg(rarest.alias("key")).select("key", none.alias("host"), none.alias("path"), "regex", "blocks")


def keys_of(url: Column, host: Column, path: Column, most_labels: int) -> Column:
    """What a URL looks rules up by: its tokens, and its host's endings of so many labels, also with its first folder."""
    tokens = F.transform(F.array_distinct(F.regexp_extract_all(url, F.lit(f"({TOKEN})"))), lambda t: F.concat(F.lit("t:"), t))
    labels = F.sequence(F.lit(1), F.least(F.lit(most_labels), F.size(F.split(host, r"\."))))
    ends = F.transform(labels, lambda k: F.concat(F.lit("h:"), F.call_function("substring_index", host, F.lit("."), -k)))
    deep = let(section(path), lambda s: F.when(s != "", F.transform(ends, lambda e: F.concat(e, s))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.array(F.lit("t:")), F.coalesce(tokens, F.array().cast("array<string>")), ends, deep))


class UrlFilter:
    """Address rules as a table (host, path, blocks), and patterns as one (pattern); the URLs that it is for tell which
    tokens are rare. Rules may be many: beyond MOST_RULES, those of rare keys are joined to the URLs that have these."""

    def __init__(self, addresses: DataFrame, patterns: DataFrame, urls: DataFrame, url: str = "url", most: int = MOST_RULES):
        """Null patterns, hosts and paths are no rules. Counts are over all URLs, of the keys that rules may have only."""
        self.addresses = written(address_rules(addresses.where("host is not null and path is not null and blocks is not null")), "url-addresses")
        self.most_labels = self.addresses.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
        patterns = written(patterns.select("pattern"), "url-patterns")
        wanted = patterns.select(F.explode(F.regexp_extract_all(lowered(F.col("pattern")), F.lit(f"({TOKEN})"))).alias("token"))
        wanted = wanted.select(F.concat(F.lit("t:"), "token").alias("key")).union(self.addresses.select("key")).union(patterns.limit(1).select(F.lit("t:"))).distinct()
        text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
        keys = urls.select(F.explode(keys_of(lowered(text), *host_and_path(text), self.most_labels)).alias("key"))
        counts = written(keys.join(wanted, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "url-keys")
        rules = self.addresses.unionByName(pattern_rules(patterns, counts)).join(counts, "key", "left")
        # The rules of a key stay together; none of a key that no URL has is needed.
        self.rules = written(rules.where("n is not null").withColumn("bin", F.floor(F.log2("n")).cast("int")), "url-rules")
        held, self.least = 0, 1 << 30
        for r in sorted(self.rules.groupBy("bin").count().collect(), reverse=True):
            held += r["count"]
            if held > most:
                break
            self.least = r["bin"]
        head = self.rules.where(F.col("bin") >= self.least)
        self.buckets = 1 << max(4, head.count().bit_length())
        entry = F.struct("key", "host", "path", "regex", "blocks")
        slots = head.groupBy(self.slot(F.col("key")).alias("k")).agg(F.collect_list(entry).alias("rules"))
        filled = slots.agg(F.map_from_entries(F.collect_list(F.struct("k", "rules"))).alias("m"))
        of = lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.array().cast(RULES))
        self.literal = written(filled.select(F.transform(F.sequence(F.lit(0), F.lit(self.buckets - 1)), of).alias("literal")), "url-literal")

    def slot(self, key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit(self.buckets - 1))

    def judge(self, df: DataFrame, url: str = "url") -> DataFrame:
        """df with host, path, rule (the address rule that decides, as host and path; null if none) and verdict (they replace
        columns of these names). Of rules equal in length, that of the longer host decides, then a block. A null URL
        has no host, path or rule, and is allowed. Rows are not exchanged; an empty table stays empty."""
        kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
        text = F.coalesce(F.col(f"`{url}`"), F.lit(""))
        host, path = host_and_path(text)
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), lowered(text).alias("url"), host.alias("host"), path.alias("path"))
        rows = rows.withColumn("keys", keys_of(F.col("url"), F.col("host"), F.col("path"), self.most_labels))
        if self.rules.where(F.col("bin") < self.least).isEmpty():
            return self.decided(rows.withColumn("more", F.array().cast(RULES)))
        rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "url-rows")
        # No key of these rules is in more URLs than those of the literal, so none is hot. Rules that don't fit go at once.
        tail = self.rules.where(F.col("bin") < self.least).withColumnsRenamed({"host": "r_host", "path": "r_path"})
        found = rows.select("at", "url", "host", "path", F.explode("keys").alias("key")).join(tail, "key")
        rule = F.struct("key", F.col("r_host").alias("host"), F.col("r_path").alias("path"), "regex", "blocks")
        fits = found.select("at", "url", "host", "path", rule.alias("r")).where(self.fits(F.col("r")))
        # What decides is one address and whether each kind of pattern hits, however many there are.
        kind = F.when(F.col("r.regex").isNull(), 2).otherwise(F.col("r.blocks").cast("int"))
        best = fits.groupBy("at", kind.alias("kind")).agg(F.max(F.struct(self.weight(F.col("r")).alias("weight"), "r")).alias("best"))
        more = best.groupBy("at").agg(F.collect_list("best.r").alias("more"))
        return self.decided(rows.join(more, "at", "left").withColumn("more", F.coalesce("more", F.array().cast(RULES))))

    @staticmethod
    def weight(r: Column) -> Column:
        """How much an address rule counts: its length, its host's, and whether it blocks."""
        return F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("host"), r["blocks"].alias("blocks"))

    @staticmethod
    def fits(r: Column) -> Column:
        """Whether a rule fits the columns url, host and path."""
        inside = (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return F.when(r["regex"].isNull(), inside & F.startswith(F.col("path"), r["path"])).otherwise(F.regexp(F.col("url"), r["regex"]))

    def decided(self, rows: DataFrame) -> DataFrame:
        """Rows (row, url, host, path, keys, more) with rule and verdict: candidates of the literal by key, and more."""
        rows = rows.withColumn("literal", self.literal.scalar())
        at = lambda k: F.filter(F.get("literal", self.slot(k)), lambda r: r["key"] == k)
        found = F.filter(F.flatten(F.transform("keys", at)), self.fits)
        rows = rows.select("row", "host", "path", F.concat(found, "more").alias("fits"))
        best = F.array_max(F.transform(F.filter("fits", lambda r: r["regex"].isNull()), lambda r: F.struct(self.weight(r).alias("weight"), F.concat(r["host"], r["path"]).alias("rule"))))
        rows = rows.withColumn("best", best)
        hit = lambda blocks: F.exists("fits", lambda r: r["regex"].isNotNull() & (r["blocks"] == blocks))
        blocked = F.when(F.col("best").isNotNull(), F.col("best.weight.blocks")).otherwise(hit(F.lit(True)) & ~hit(F.lit(False)))
        return rows.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


#: Rules of the query (host, path, blocks), which are the contract's, and its patterns: hosts and folders of spam.
ADDRESSES = [("org", "/", False), ("example.org", "/es/", True), ("example.org", "/en/1", True), ("com", "/fr/", False), ("com", "/de/", True)]
PATTERNS = [
    "||ads-track.", "||adult-x.", "||casino-*.example.", "||cheap-pills.", "||free-bets.", "||spam-farm.", "||ads.", "||adserver.", "/banners/*.gif", "/cgi-bin/",
    "/wp-login.php^", "^affid=", "^sessionid=*&phpsessid=", "|ftp://", ".exe|", "@@||docs.*/casino-", "@@^ref=editorial^",
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL of every page, judged."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(ADDRESSES, "host string, path string, blocks boolean"), spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return UrlFilter(*rules, pages).judge(pages).select("page_id", "host", "path", "rule", "verdict")


def values(rows: Iterable[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in rows)


#: Every pattern, as a plain expression on the URL in lower case, tried on every URL.
BLOCKS = [
    r"^[^:/?#]*://([^/?#]*\.)?(ads-track|adult-x|cheap-pills|free-bets|spam-farm|ads|adserver)\.", r"^[^:/?#]*://([^/?#]*\.)?casino-.*\.example\.", r"/banners/.*\.gif", "/cgi-bin/",
    r"/wp-login\.php([^a-z0-9_.%-]|\z)", "[^a-z0-9_.%-]affid=", "[^a-z0-9_.%-]sessionid=.*&phpsessid=", "^ftp://", r"\.exe\z",
]
ALLOWS = [r"^[^:/?#]*://([^/?#]*\.)?docs\..*/casino-", r"[^a-z0-9_.%-]ref=editorial([^a-z0-9_.%-]|\z)"]
OP13_SQL = f"""
with parts as (
  select page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') as low,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), cut as (
  select *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts
), fit as (
  select cut.page_id, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.blocks, length(r.host || r.path)) as blocks
  from cut join (values {values(ADDRESSES)}) r(host, path, blocks)
    on (cut.host = r.host or ends_with(cut.host, '.' || r.host)) and starts_with(cut.path, r.path)
  group by cut.page_id
)
select page_id, host, path, rule,
       case when coalesce(blocks, ({" or ".join(f"regexp_matches(low, '{p}', 's')" for p in BLOCKS)}) and not ({" or ".join(f"regexp_matches(low, '{p}', 's')" for p in ALLOWS)}))
            then 'block' else 'allow' end as verdict
from cut left join fit using (page_id)
"""
