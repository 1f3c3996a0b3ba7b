"""URL filters: fixed host and path rules, and association rules mined from labels.

Labels are the fixed rules' verdicts, and for pages that no fixed rule judges those of a table, by
id. Tokens of a URL: its host's labels, path segments and query keys. FP-growth over the labelled
bad URLs finds token sets of SUPPORT or more; a set's rule is kept if it is bad in CONFIDENCE or more
of all labelled URLs that have it, and LIFT times as often as all of them are, and no smaller kept set is as sure.
So the rules carry over what the fixed ones and the labels say to pages that neither speaks of. A
rule is filed under one token, its rarest; a URL looks up its tokens and checks the sets found.

The fit is bounded to FIT_ROWS labelled rows, the least by hash of id. Sets are exponential in the
tokens of a URL, so one of more than BASKET frequent tokens is mined in parts, of which every BLOCKS
tokens are together in one: sets of up to BLOCKS tokens come from whole URLs, longer ones from parts.
All counts that rules are judged by are of whole URLs. Matching uses all tokens.

Defined cases: a null URL or one without :// has an empty host and path, no rule and verdict allow;
of several fixed rules that fit the longest speaks, and of equally long ones the later in the list;
repeated rows each get their row; without labels, or without bad ones, only fixed rules speak.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed values of the contract: verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SUPPORT, CONFIDENCE, LIFT = 0.005, 0.6, 2.0
#: And a set is in so many bad URLs at least, however few are labelled.
LEAST = 10
FIT_ROWS, BASKET, BLOCKS = 200_000, 12, 3
#: Mined rules are broadcast up to so many, else the lookup is a shuffled join.
BROADCAST_RULES = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "^[\\s\\S]*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """rule and its verdict: the longest rule that fits (by host and path together), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: h:label, p:segment, q:key."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*+\\?([^#]*+)", 1)
    part = lambda name, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    keys = F.transform(F.split(query, "[&;]"), lambda x: F.regexp_extract(x, "^[^=]*+", 0))
    return F.array_distinct(F.concat(part("h:", F.split(host, "\\.")), part("p:", F.split(path, "/")), part("q:", keys)))


def parts(items: Column) -> Column:
    """items whole if they are BASKET or fewer, else parts of that size, of which every BLOCKS items are together in one."""
    size = BASKET // BLOCKS
    last = F.ceil(F.size(items) / size).cast("int") - 1
    block = lambda n: F.slice(items, n * size + 1, F.lit(size))
    some = F.flatten(F.transform(F.sequence(F.lit(0), last - 2), lambda i: F.flatten(F.transform(F.sequence(i + 1, last - 1), lambda j: F.transform(F.sequence(j + 1, last), lambda k: F.concat(block(i), block(j), block(k)))))))
    return F.when(F.size(items) <= BASKET, F.array(items)).otherwise(some)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, lift: float = LIFT) -> DataFrame:
    """tokens (sorted), by (the rarest), support, confidence; labelled: id, tokens, bad."""
    spark = labelled.sparkSession
    fitted = stored(labelled.where(F.size("tokens") > 0).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id", "tokens", "bad", F.monotonically_increasing_id().alias("row")), "url-labelled")
    empty = spark.createDataFrame([], "tokens array<string>, by string, support double, confidence double")
    n = fitted.count()
    bad = fitted.where("bad")
    least, n_bad = max(least, round(support * n)), bad.count()
    if n_bad < least:
        return empty
    each = bad.select("row", F.explode("tokens").alias("t"))
    frequent = each.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    baskets = each.join(frequent, "t").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "t")))["t"].alias("items"))
    baskets = stored(baskets.select(F.explode(parts(F.col("items"))).alias("items")), "url-baskets")
    held = baskets.count()
    if not held:
        return empty
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / held), numPartitions=8).fit(baskets).freqItemsets
    sets = stored(sets.select(F.array_sort("items").alias("tokens")).distinct(), "url-sets")
    df = fitted.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    filed = stored(filed_under(sets, df), "url-filed")
    counted = matches(fitted, filed).groupBy("tokens", "by").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"))
    sure = stored(counted.where((F.col("b") >= least) & (F.col("b") >= confidence * F.col("n")) & (F.col("b") * n >= lift * n_bad * F.col("n"))).select("tokens", "by", (F.col("b") / n).alias("support"), (F.col("b") / F.col("n")).alias("confidence")), "url-sure")
    # A set with a smaller kept set inside it that is as sure says nothing new; the smaller one is met through its filing token.
    small = sure.select(F.col("tokens").alias("inner"), F.col("by").alias("t"), F.col("confidence").alias("c"))
    idle = sure.select("tokens", "confidence", F.explode("tokens").alias("t")).join(small, "t").where((F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    return stored(sure.join(idle.select("tokens").distinct(), "tokens", "left_anti"), "url-rules")


def filed_under(sets: DataFrame, df: DataFrame) -> DataFrame:
    """tokens and by, the token of the fewest rows."""
    each = sets.select("tokens", F.explode("tokens").alias("t")).join(df, "t")
    return each.groupBy("tokens").agg(F.min(F.struct("n", "t"))["t"].alias("by"))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows' columns (but tokens), and the columns of each rule whose tokens a row all has."""
    mine_ = rules.limit(BROADCAST_RULES + 1)
    rules = F.broadcast(rules) if mine_.count() <= BROADCAST_RULES else rules
    probes = rows.withColumnRenamed("tokens", "own").withColumn("by", F.explode("own"))
    return probes.join(rules, "by").where(F.size(F.array_except("tokens", "own")) == 0).drop("own")


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, mined (the surest mined rule that fits, or null); one row for each row of pages.

    labels: label_id, quality, toxic; bad is quality 0 or toxic 1."""
    one = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    host, path = host_path(F.col("url"))
    rows = one.withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"tokens": tokens(F.col("url"), F.col("host"), F.col("path")), "rule": rule, "said": verdict})
    marks = labels.select(F.col(label_id).alias("id"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("bad")).groupBy("id").agg(F.bool_or("bad").alias("bad"))
    known = rows.select("id", "tokens", "said").join(marks, "id", "left").select("id", "tokens", F.coalesce(F.col("said") == "block", "bad").alias("bad"))
    found = mine(known.where("bad is not null"))
    by_url = matches(rows.select("url", "tokens").where("url is not null").distinct(), found)
    best = by_url.groupBy("url").agg(F.max(F.struct("confidence", "support", F.array_join("tokens", " ").alias("text")))["text"].alias("mined"))
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    joined = rows.drop("tokens").join(best, "url", "left")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "mined")
