"""Allow or block pages by their address.

Rules of host and path decide where one fits. Elsewhere a multinomial naive Bayes does, which the
pages that rules decide have taught. Its tokens are the words of the host and of the path. Host
names often run words together: the most probable split under the unigram counts of the words on
the pages is found with Viterbi, once per distinct label. Counts of words, labels and tokens meet in
joins; nothing but the rules is held in full.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import lower_ascii
from ledgerlake.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Letters by which words are looked up; longer ones are found by their first letters and then compared whole.
LOOKED_UP = 20
SMOOTHING = 1.0


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): of null urls and urls without ``://`` both are empty."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    whole = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = whole.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    return host.select(
        "page_id", lower_ascii(F.col("_host")).alias("host"),
        F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0).alias("path"),
    )


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls; of equally long ones the longest host."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, at, under in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(under)
        name = F.when(fits, F.lit(at + under)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def labels_of(host: Column) -> Column:
    """The runs of letters and digits of a host name."""
    return F.filter(F.split(host, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def path_key(path: Column) -> Column:
    """The words of a path, lower-cased and with numbers alike, as one text."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[^\p{L}\p{N}]+", " "))


def word_counts(pages: DataFrame, text: str = "html") -> DataFrame:
    """(word, n): lower-cased words of the pages' texts, without tags."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, r"[^\p{L}\p{N}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of a label; a word never seen costs more with every character.

    Of equally probable splits the one whose last word is longest.
    """
    letter, fresh = math.log(10), math.log(10 / max(total, 1))
    lengths = sorted({len(w) for w in counts})
    best: list[tuple[float, int]] = [(0.0, 0)]
    unseen = (0.0, 0)  # the best start of a word never seen, whatever its length
    for end in range(1, len(label) + 1):
        options = [(unseen[0] + fresh - end * letter, unseen[1])]
        for size in lengths:
            if size > end:
                break
            seen = counts.get(label[end - size : end], 0)
            if seen:
                options.append((best[end - size][0] + math.log(seen / total), size - end))
        value, start = max(options)
        best.append((value, -start))
        unseen = max(unseen, (best[end][0] + end * letter, -end))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def _split_labels(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("label").to_pylist(), batch.column("words").to_pylist())
            split = [best_split(label, {w["word"]: w["n"] for w in words}, total) for label, words in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(split, pa.list_(pa.string()))], names=["label", "split"]
            )

    return run


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, tokens): the words of each distinct host, in no fixed order.

    Only the substrings of labels are looked up, in a join with the word counts; words of any length are found.
    """
    labels = hosts.select("host", F.explode(labels_of(F.col("host"))).alias("label"))
    distinct = written(labels.select("label").distinct(), "labels")
    starts = distinct.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("_s"))
    parts = starts.select(
        "label", F.explode(F.sequence(F.lit(1), F.least(F.lit(LOOKED_UP), F.length("label") - F.col("_s") + 1))).alias("_n"), "_s"
    ).select("label", F.expr("substring(label, _s, _n)").alias("word")).distinct()
    heads = starts.where(F.length("label") - F.col("_s") >= LOOKED_UP).select("label", "_s", F.substr("label", F.col("_s"), F.lit(LOOKED_UP)).alias("_head"))
    long_words = counts.where(F.length("word") > LOOKED_UP).withColumn("_head", F.left("word", F.lit(LOOKED_UP)))
    held = heads.join(long_words, "_head").where(F.expr("substring(label, _s, length(word)) = word")).select("label", "word", "n").distinct()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    known = parts.join(counts, "word").select("label", "word", "n").unionByName(held).groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    listed = distinct.join(known, "label", "left").select(
        "label", F.coalesce("words", F.array().cast("array<struct<word:string,n:bigint>>")).alias("words")
    )
    split = listed.mapInArrow(_split_labels(total), "label string, split array<string>")
    return labels.join(split, "label").groupBy("host").agg(F.flatten(F.collect_list("split")).alias("tokens"))


def _ratios(tokens: DataFrame) -> DataFrame:
    """(token, ratio) from (token, allow, block): log of block's share over allow's, smoothed."""
    summed = written(tokens.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "tokens")
    all_ = summed.agg(
        F.coalesce(F.sum("allow"), F.lit(0)).alias("allow"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"),
        F.count(F.lit(1)).alias("v"),
    ).first()
    allow = (F.col("allow") + SMOOTHING) / (all_["allow"] + SMOOTHING * all_["v"])
    block = (F.col("block") + SMOOTHING) / (all_["block"] + SMOOTHING * all_["v"])
    return summed.select("token", (F.log(block) - F.log(allow)).alias("ratio"))


def judged(pages: DataFrame, rules=RULES, text: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of ``pages`` (page_id, url and a text).

    ``score`` is the log-odds of block under the classifier; it decides where no rule fits, block if
    above 0. Pages without tokens have the prior's score; if rules decide no page, all scores
    are 0 up to smoothing and the rest is allowed. Null urls have an empty host and path; repeated
    rows are judged alike; an empty table gives an empty one. Hosts and paths are counted once per
    distinct value before their tokens are listed, so a host with a third of the pages is one row.
    """
    name, says = ruled(F.col("host"), F.col("path"), rules)
    rows = written(parsed(pages).select("*", path_key(F.col("path")).alias("_key"), name.alias("rule"), says.alias("says")), "pages")
    votes = [F.count_if(F.col("says") == v).alias(v) for v in ("allow", "block")]
    hosts = written(rows.groupBy("host").agg(*votes), "hosts")
    paths = written(rows.groupBy("_key").agg(*votes), "paths")
    host_tokens = written(segmented(hosts, word_counts(pages, text)), "segmented").join(hosts, "host").select(
        "host", "allow", "block", F.explode("tokens").alias("_t")
    ).select("host", "allow", "block", F.concat(F.lit("host "), "_t").alias("token"))
    path_tokens = paths.where("_key <> ''").select("_key", "allow", "block", F.explode(F.split("_key", " ")).alias("_t")).select(
        "_key", "allow", "block", F.concat(F.lit("path "), "_t").alias("token")
    )
    ratios = written(
        _ratios(host_tokens.select("token", "allow", "block").unionByName(path_tokens.select("token", "allow", "block"))), "ratios"
    )
    prior = hosts.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in ("allow", "block")]).first()
    lean = math.log((prior["block"] + SMOOTHING) / (prior["allow"] + SMOOTHING))
    of_host = host_tokens.join(ratios, "token").groupBy("host").agg(F.sum("ratio").alias("_h"))
    of_path = path_tokens.join(ratios, "token").groupBy("_key").agg(F.sum("ratio").alias("_p"))
    scored = rows.join(of_host, "host", "left").join(of_path, "_key", "left").withColumn(
        "score", F.round(F.lit(lean) + F.coalesce("_h", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0)), 9)
    )
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict"), "score")
