"""URL filters: host suffixes and path starts of each URL, joined with the rules by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares; the whole digest is confirmed after it.
PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and for a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _folder(path: Column) -> Column:
    """A path up to its last slash, with it; empty if it has none."""
    return F.regexp_extract(path, "^.*/", 0)


def _hashed(df: DataFrame, host: str, folder: str) -> DataFrame:
    digest = F.sha2(F.concat(host, folder), 256)
    return df.withColumn("_kb_digest", digest).withColumn("_kb_prefix", F.substring("_kb_digest", 1, PREFIX_DIGITS))


def expressions(targets: DataFrame, labels: int, slashes: int) -> DataFrame:
    """Every host suffix of ``targets(host, path)`` with every folder that its path starts with, hashed.

    A suffix has up to ``labels`` labels and a folder up to ``slashes`` slashes: no more than the longest rule, so that
    a URL of any length has a bounded number of expressions and none that a rule could match is missing.
    """
    n = F.least(_count(F.col("host"), ".") + 1, F.lit(labels))
    deep = F.least(_count(F.col("path"), "/"), F.lit(slashes))
    wide = targets.filter(F.lit(labels > 0)).select("host", "path", F.explode(F.sequence(F.lit(1), n)).alias("_kb_k"), deep.alias("_kb_deep"))
    wide = wide.select("host", "path", F.expr("substring_index(host, '.', -_kb_k)").alias("_kb_host"), F.explode(F.sequence(F.lit(0), "_kb_deep")).alias("_kb_j"))
    folder = F.when(F.col("_kb_j") > 0, F.expr("concat(substring_index(path, '/', _kb_j), '/')")).otherwise("")
    return _hashed(wide.withColumn("_kb_folder", folder), "_kb_host", "_kb_folder")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every URL by ``rules(host, path, verdict)``.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The longest rule (its host
    and path together) wins; of equally long ones that with the longer host, then ``block``. Where no rule fits, as in
    any block list, the URL gets ``default`` and its rule is null.

    URLs are expanded into expressions (host suffixes times folders), which meet the rules in an equi-join on the first
    32 bits of a SHA-256; the whole digest, the host and the start of the path are confirmed then. Each distinct host
    and path is expanded once, so copies of a URL cost one row. The join is left to Spark: rules within its measured
    broadcast threshold are broadcast, larger ones are shuffled, and adaptive execution splits prefixes that very many
    expressions share (``com/``).

    Null URLs and URLs without ``://`` have an empty host and path, which only a rule of an empty host fits. Every row
    stays, with null and repeated ids too; other columns of ``pages`` are not read. A rule with a null is ignored; no
    rules, or no pages, are no error. Only built-in functions.
    """
    known = rules.select(F.translate("host", _UPPER, _LOWER).alias("_kb_host_r"), F.col("path").alias("_kb_path_r"), F.col("verdict").alias("_kb_verdict")).dropna()
    known = _hashed(known.distinct().withColumn("_kb_folder_r", _folder(F.col("_kb_path_r"))), "_kb_host_r", "_kb_folder_r")
    size = known.agg(F.max(_count(F.col("_kb_host_r"), ".") + 1), F.max(_count(F.col("_kb_folder_r"), "/"))).first()
    parsed = pages.select(F.col(id_col).alias("_kb_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    found = expressions(parsed.select("host", "path").distinct(), size[0] or 0, size[1] or 0)
    found = found.join(known.withColumnRenamed("_kb_digest", "_kb_digest_r"), "_kb_prefix")
    found = found.filter((F.col("_kb_digest") == F.col("_kb_digest_r")) & (F.col("_kb_host") == F.col("_kb_host_r")) & F.startswith("path", "_kb_path_r"))
    rule = F.concat("_kb_host_r", "_kb_path_r")
    order = F.struct(F.length(rule), F.length("_kb_host_r"), F.col("_kb_verdict") == "block", rule.alias("rule"), F.col("_kb_verdict").alias("verdict"))
    best = found.groupBy("host", "path").agg(F.max(order).alias("_kb_best"))

    out = parsed.join(best, ["host", "path"], "left")
    return out.select(F.col("_kb_id").alias(id_col), "host", "path", F.col("_kb_best.rule").alias("rule"), F.coalesce("_kb_best.verdict", F.lit(default)).alias("verdict"))
